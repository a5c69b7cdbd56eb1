"""Chat formatting with Spark expressions only.

Turns are collected as structs, sorted, and adjacent turns of one role merged into one block by
array aggregation; blocks are concatenated into one text with marks. Texts are escaped so that no
mark can appear inside them, and reading the marks back gives the turns exactly.

A conversation is first formatted in runs of turns, then its runs are joined: so the collected
list of a task is bounded by a run, even if one conversation holds a third of all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns of one run.
RUN_TURNS = 256
ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """Marks of the format. A block is begin, role, says, its texts with ``also`` between, end.

    Marks must have two characters or more and must not hold the escape character, a backslash.
    """

    begin: str = "<s>[INST] "
    says: str = " [/INST]\n"
    also: str = "\n[AND]\n"
    end: str = "</s>\n"
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "[AND]")
    trained: tuple[str, ...] = ("assistant",)


LLAMA_LIKE = Template()


def escaped(text: Column, template: Template = LLAMA_LIKE) -> Column:
    """The text with backslashes doubled and one put after the first character of each control."""
    out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    for mark in template.controls:
        out = F.replace(out, F.lit(mark), F.lit(mark[0] + ESCAPE + mark[1:]))
    return out


def unescaped(text: Column, template: Template = LLAMA_LIKE) -> Column:
    """What was escaped. Text runs have an even number of backslashes, a broken control just one."""
    out = text
    for mark in template.controls:
        out = F.replace(out, F.lit(mark[0] + ESCAPE + mark[1:]), F.lit(mark))
    return F.replace(out, F.lit(ESCAPE * 2), F.lit(ESCAPE))


def _merged(turns: Column) -> Column:
    """Sorted turns to blocks: neighbours of one role become one block with all their texts."""
    none = F.expr("cast(array() as array<struct<role: string, texts: array<string>>>)")

    def add(blocks: Column, turn: Column) -> Column:
        last = F.element_at(blocks, -1)
        longer = F.struct(last["role"].alias("role"), F.concat(last["texts"], F.array(turn["text"])).alias("texts"))
        new = F.struct(turn["role"].alias("role"), F.array(turn["text"]).alias("texts"))
        same = (F.size(blocks) > 0) & (F.try_element_at(blocks, F.lit(-1))["role"] == turn["role"])
        return F.when(
            same, F.concat(F.slice(blocks, 1, F.size(blocks) - 1), F.array(longer))
        ).otherwise(F.concat(blocks, F.array(new)))

    return F.aggregate(turns, none, add)


def format_chats(
    turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    template: Template = LLAMA_LIKE, run_turns: int = RUN_TURNS,
) -> DataFrame:
    """``(key, formatted, loss_spans)``, one row per conversation.

    ``loss_spans`` are (start, length) in characters of the escaped texts of trained roles, in
    order, one per turn and nothing between. Turns go by ``turn``, null first; equal turn numbers
    by role and text; repeated rows all stay. Null roles and texts are empty. A null key is a
    conversation of its own; an empty table gives no row.
    """
    rows = turns.select(
        F.col(key).alias("key"), F.col(turn).alias("turn"),
        escaped(F.coalesce(F.col(role), F.lit("")), template).alias("role"),
        escaped(F.coalesce(F.col(text), F.lit("")), template).alias("text"),
    )
    rows = rows.withColumn("run", F.floor(F.coalesce(F.col("turn"), F.lit(0)) / run_turns))
    rows = rows.withColumn("run", F.when(F.col("turn").isNull(), F.lit(None)).otherwise(F.col("run")))
    sorted_turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    blocks = rows.groupBy("key", "run").agg(_merged(sorted_turns).alias("blocks"))

    # a run that goes on with the role its predecessor ended with continues that block
    order = Window.partitionBy("key").orderBy("run")
    first, last = F.element_at("blocks", 1)["role"], F.element_at("blocks", -1)["role"]
    blocks = blocks.withColumn("goes_on", F.coalesce(F.lag(last).over(order) == first, F.lit(False)))
    blocks = blocks.withColumn("is_cut", F.coalesce(F.lead(F.col("goes_on")).over(order), F.lit(False)))
    trained = [F.lit(r) for r in template.trained]

    def piece(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def pieces(block: Column, at: Column) -> Column:
        """The block's marks and texts in turn, each with whether it is learnt."""
        role_text = block["role"]
        learnt = unescaped(role_text, template).isin(*trained)
        head = piece(F.concat(F.lit(template.begin), role_text, F.lit(template.says)), F.lit(False))
        head = F.when((at == 0) & F.col("goes_on"), piece(F.lit(template.also), F.lit(False))).otherwise(head)
        texts = F.transform(
            block["texts"],
            lambda t, i: F.array(
                piece(F.when(i > 0, F.lit(template.also)).otherwise(F.lit("")), F.lit(False)), piece(t, learnt)
            ),
        )
        tail = F.when((at == F.size("blocks") - 1) & F.col("is_cut"), F.lit("")).otherwise(F.lit(template.end))
        return F.concat(F.array(head), F.flatten(texts), F.array(piece(tail, F.lit(False))))

    laid = blocks.select("key", "run", F.flatten(F.transform("blocks", pieces)).alias("pieces"))
    lengths = F.transform("pieces", lambda p: F.struct(F.length(p["text"]).cast("long").alias("n"), p["loss"].alias("loss")))
    start = F.struct(
        F.lit(0).cast("long").alias("at"),
        F.expr("cast(array() as array<struct<start: bigint, length: bigint>>)").alias("spans"),
    )

    def walk(state: Column, p: Column) -> Column:
        span = F.struct(state["at"].alias("start"), p["n"].alias("length"))
        return F.struct(
            (state["at"] + p["n"]).alias("at"),
            F.when(p["loss"], F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"),
        )

    laid = laid.select(
        "key", "run", F.array_join(F.col("pieces.text"), "").alias("text"),
        F.aggregate(lengths, start, walk).alias("walked"),
    )
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.col("walked.at")).over(before), F.lit(0))
    laid = laid.withColumn("offset", offset)
    moved = F.transform(
        F.col("walked.spans"),
        lambda s: F.struct((s["start"] + F.col("offset")).alias("start"), s["length"].alias("length")),
    )
    run = F.struct("offset", F.col("run").alias("run"), "text", moved.alias("spans"))
    whole = laid.groupBy("key").agg(F.array_sort(F.collect_list(run)).alias("runs"))
    return whole.select(
        F.col("key").alias(key), F.array_join("runs.text", "").alias("formatted"),
        F.flatten("runs.spans").alias("loss_spans"),
    )


def read_turns(formatted: Column, template: Template = LLAMA_LIKE) -> Column:
    """The turns (role, text) of a formatted conversation, unescaped, as they were before merging."""
    split = lambda text, mark: F.split(text, "\\Q" + mark + "\\E", -1)
    blocks = F.filter(split(formatted, template.end), lambda b: b != "")

    def turns(block: Column) -> Column:
        body = F.substring(block, len(template.begin) + 1, 2**31 - 1)
        at = F.instr(body, template.says)
        role = F.substring(body, F.lit(1), at - 1)
        texts = F.substring(body, at + len(template.says), F.lit(2**31 - 1))
        return F.transform(
            split(texts, template.also),
            lambda t: F.struct(unescaped(role, template).alias("role"), unescaped(t, template).alias("text")),
        )

    return F.flatten(F.transform(blocks, turns))


def loss_text(formatted: Column, spans: Column, template: Template = LLAMA_LIKE) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: unescaped(
                F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")), template
            ),
        ),
        "",
    )
