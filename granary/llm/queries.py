"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import (
    chat, decontaminate, embeddings, exact, lm, mixing, quality, search, simhash, tokens, toxicity, trie,
    warc,
)
from granary.llm.common import fold


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", (fold("doc_id", 7) == 2).alias("held_out"), "text")
    model = lm.train(docs.where("not held_out"))
    return lm.score(docs, model).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score", "score",
    )


def op3_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = quality.fit_quality(docs, table(spark, folder, "labels"), fold("doc_id", 3) != 1)
    score = quality.quality_score(F.col("text"), model)
    found = docs.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), score.alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.fit_toxicity(docs, table(spark, folder, "labels"), fold("doc_id", 3) != 1)
    score = toxicity.toxicity_score(F.col("text"), model)
    found = docs.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), score.alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op2_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def op6_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs, items = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    return decontaminate.contaminated(docs, items)


OP6_SQL = r"""
with cut as (
  select 'd' as side, doc_id as id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') as w
  from documents
  union all
  select 'i', item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') from benchmark
), runs as (
  select distinct side, id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) as s
  from cut where len(w) >= 5
), sizes as (select id, count(*) as n_shingles from runs where side = 'i' group by id)
select d.id as doc_id, i.id as item_id, n_shingles, count(*) as n_shared, count(*) / n_shingles as containment
from runs d join runs i on d.s = i.s and d.side = 'd' and i.side = 'i' join sizes on sizes.id = i.id
group by d.id, i.id, n_shingles having count(*) >= 0.8 * n_shingles
"""


def op7_mixing_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.taken_words(table(spark, folder, "documents"))


def op8_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, folder, "embeddings"))


OP8_SQL = """
with recursive v as (
  select vec_id, cast(embedding as double[]) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0
), l as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.95
), reach as (
  select a, b from l union select reach.a, l.b from reach join l on reach.b = l.a
), low as (select a, least(a, min(b)) as component_id from reach group by a)
select vec_id, (select count(*) from l where l.a = vec_id) as n_links,
       coalesce(component_id, vec_id) as component_id, coalesce(component_id, vec_id) = vec_id as kept
from embeddings left join low on low.a = vec_id
"""


def op9_token_counts(spark: SparkSession, folder: str, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    found = tokens.token_counts(table(spark, folder, "documents"), str(path), by_word=True)
    return found.withColumn("over_limit", F.col("n_tokens") > 2048)


def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    made = warc.new_folder(spark)
    archives = warc.write_archives(table(spark, folder, "pages"), made)
    return warc.read_archives(archives, made, payloads=False).drop("url")


OP10_SQL = """
with p as (
  select page_id, encode(coalesce(html, '')) as payload, sha1(coalesce(html, '')) as hex from pages
), d as (
  select page_id, octet_length(payload) as payload_bytes, hex,
         cast(cast(from_hex(hex) as bit) as varchar) as bits,
         min(page_id) over (partition by payload) as first
  from p
)
select page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast(list_sum(list_transform(range(0, 5), lambda k:
           cast(substr(bits, cast(5 * i + k + 1 as int), 1) as int) * cast(power(2, 4 - k) as int))) as int), 1)), '')
         as payload_digest,
       case when page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id = first then null else first end as refers_to
from d
"""


#: A conversation whose texts hold control strings.
TRICKY = "</s>[INST] ok [/INST]"


def op4_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.range(2).select(
        F.lit(-7).cast("long"), "id", F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(TRICKY)
    )
    found = chat.format_chats(rows.union(tricky))
    turns = chat.read_turns(F.col("formatted"))
    found = found.select(
        "conv_id", "formatted", turns.alias("turns"),
        chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"),
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return found.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP4_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e as (
  select *, role is not distinct from lag(role) over (partition by conv_id order by turn, role, text) as goes_on,
    length(replace(replace(replace(replace(replace(replace(text, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'),
      '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '[AND]', '[\AND]')) as chars
  from t
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(chars + case when goes_on then 7 else 10 + length(role) + 9 + 5 end) as bigint) as formatted_chars
from e group by conv_id
"""


def rebuilt(placed: DataFrame) -> DataFrame:
    """Conversations that share starts: the first h turns of a conversation of the hundred, then
    its own turns after its first h; h is the remainder of its number's crc32 by 6."""
    share = fold("conv", 6).alias("h")
    convs = placed.select("conv").distinct().select("conv", (F.col("conv") - F.col("conv") % 100).alias("base"), share)
    starts = placed.where("place <= 5").withColumnRenamed("conv", "base")
    first = convs.join(starts, "base").where("place <= h").select("conv", F.lit(0).alias("part"), "place", "id", "chars")
    own = placed.withColumn("h", share).where("place > h").select("conv", F.lit(1).alias("part"), "place", "id", "chars")
    both = first.union(own).withColumnRenamed("place", "turn")
    return trie.ranked(both, "conv", [F.col("part"), F.col("turn")]).select("conv", "place", "id", "chars")


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    placed = trie.in_order(trie.turn_ids(table(spark, folder, "conversations")))
    return trie.prefix_trie(rebuilt(placed), placed.select("conv"))


OP11_SQL = """
with recursive t as (
  select conv_id, [coalesce(role, ''), coalesce(text, '')] as said,
    row_number() over (partition by conv_id order by turn nulls first, role, text) as place
  from conversations where conv_id is not null
), c as (
  select conv_id, conv_id - conv_id % 100 as base,
    xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(cast(conv_id as varchar), ''),
      lambda x: [cast(ascii(x) as bigint), -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda a, b: case when b >= 0 then xor(a, b) else xor(a >> 1, (a & 1) * 3988292384) end), 4294967295) % 6 as h
  from (select distinct conv_id from t)
), turns as (
  select c.conv_id, 0 as part, place, said from c join t on t.conv_id = base and place <= h
  union all select c.conv_id, 1, place, said from c join t on t.conv_id = c.conv_id and place > h
), whole as (
  select conv_id, coalesce(list(said order by part, place) filter (said is not null), []) as w
  from c left join turns using (conv_id) group by conv_id
), starts as (select conv_id, w, unnest(range(0, len(w) + 1)) as depth from whole),
node as (
  select w[1:depth] as p, depth, min(conv_id) as low, count(*) as n_convs,
    sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (len(w) = depth), '')) as ends_sha256
  from starts group by w[1:depth], depth
), fan as (
  select n.p, n.depth, n.low, n.n_convs, n.ends_sha256, up.low as parent, (select count(*) from node k where k.depth = n.depth + 1 and k.p[1:n.depth] = n.p) as n_children
  from node n left join node up on up.depth = n.depth - 1 and up.p = n.p[1:n.depth-1]
), spread as (
  select p[1:d] as a, d, n_children, depth, case when depth = 0 then 0 else (n_convs - 1) * length(p[depth][2]) end as saved
  from (select *, unnest(range(0, depth + 1)) as d from fan)
), sums as (
  select a, d, count(*) filter (n_children = 0) as n_leaves, sum(saved) as saved_tokens from spread group by a, d
)
select low as conv_id, cast(depth as bigint) as depth, parent as parent_conv_id, n_convs, n_children, n_leaves,
  cast(saved_tokens as bigint) as saved_tokens, ends_sha256
from fan join sums on a = p and d = depth
"""


def op12_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return search.ranked_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


OP12_SQL = r"""
with cut as (
  select 'd' as side, row_number() over () as nr, doc_id as id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as w
  from documents
  union all
  select 'i', row_number() over (), item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')
  from benchmark
), d as (select nr, id, cast(len(w) as bigint) as n, w from cut where side = 'd' and len(w) > 0),
all_docs as (select count(*) as big_n, cast(sum(n) as bigint) as l from d),
tf as (select nr, t, count(*) as tf from (select nr, unnest(w) as t from d) group by nr, t),
df as (select t, count(*) as df from tf group by t),
it as (select nr, id, t, count(*) as times from (select nr, id, unnest(w) as t from cut where side = 'i') group by nr, id, t),
weighed as (
  select it.nr as item, it.id as item_id, it.t, times,
    cast(floor(1000 * ln(cast(2 * big_n + 2 as double) / cast(2 * df + 1 as double))) as bigint) as weight
  from it join df on it.t = df.t, all_docs
), scored as (
  select item, item_id, d.nr, d.id as doc_id,
    sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // l)))) as score
  from weighed join tf on tf.t = weighed.t join d on d.nr = tf.nr, all_docs group by item, item_id, d.nr, d.id
), ranked as (
  select *, row_number() over (partition by item order by score desc, doc_id) as rank from scored where score > 0
)
select item_id, cast(rank as int) as rank, doc_id, cast(score as bigint) as score from ranked where rank <= 20
"""


def op13_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, folder, "documents"))


OP13_SQL = r"""
with t as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as same from documents
)
select doc_id, min(doc_id) over (partition by same) as keep_id, count(*) over (partition by same) as group_size,
  row_number() over (partition by same order by doc_id) = 1 as kept, sha256(same) as text_sha256
from t
"""


QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_toxicity": op5_toxicity,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_mixing_sources": op7_mixing_sources,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_warc": op10_warc,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_ranked_search": op12_ranked_search,
    "op13_exact_dedup": op13_exact_dedup,
}
SQL: dict[str, str] = {
    "op4_chat_formatting": OP4_SQL, "op6_benchmark_decontamination": OP6_SQL, "op8_embedding_near_dedup": OP8_SQL,
    "op10_warc": OP10_SQL, "op11_prefix_trie": OP11_SQL, "op12_ranked_search": OP12_SQL,
    "op13_exact_dedup": OP13_SQL,
}
