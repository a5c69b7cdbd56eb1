import pytest

from granary.errors import ValidationError
from granary.sources.tables import preview, read_csv, validate_table


def write(folder, text):
    path = folder / "table.csv"
    path.write_text(text, encoding="utf-8")
    return str(path)


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_separator_is_detected(spark, tmp_path, sep):
    body = "\n".join(sep.join(r) for r in (["id", "age", "weight"], ["1", "40", "70.5"], ["2", "", "81"]))
    df = read_csv(spark, write(tmp_path, body + "\n"))
    assert df.dtypes == [("id", "bigint"), ("age", "bigint"), ("weight", "double")]
    assert [tuple(r) for r in df.collect()] == [(1, 40, 70.5), (2, None, 81.0)]


def test_single_column_stays_single(spark, tmp_path):
    df = read_csv(spark, write(tmp_path, "note\nhello\nworld\n"))
    assert df.columns == ["note"] and df.count() == 2


def test_missing_texts_flags_and_dates(spark, tmp_path):
    text = "a,b,c\n1,true,2024-01-01\nNA,false,2024-01-02\n3,,\"x, y\"\n"
    df = read_csv(spark, write(tmp_path, text))
    assert df.dtypes == [("a", "bigint"), ("b", "boolean"), ("c", "string")]
    assert [r["c"] for r in df.collect()][2] == "x, y"


def test_nan_in_a_given_schema_becomes_null(spark, tmp_path):
    df = read_csv(spark, write(tmp_path, "a\n1.5\nNaN\n"), schema="a double")
    assert [r["a"] for r in df.collect()] == [1.5, None]


def test_acceptance(spark, tmp_path, sales):
    assert validate_table(sales, 1000, 10) is sales
    for text in ("a,b,c\n", "a,b\n,\n,\n"):
        with pytest.raises(ValidationError):
            validate_table(read_csv(spark, write(tmp_path, text)))
    with pytest.raises(ValidationError, match="rows"):
        validate_table(sales, max_rows=10)
    with pytest.raises(ValidationError, match="columns"):
        validate_table(sales, max_columns=2)


def test_preview_rounds(spark):
    df = spark.sql("select 1.23456789D as a, 1234567890.1234D as b")
    assert tuple(preview(df).first()) == (1.234568, 1234567890.12)


def test_line_breaks_inside_quotes(spark, tmp_path):
    df = read_csv(spark, write(tmp_path, 'a,b\n1,"x\ny"\n'), multiline=True)
    assert tuple(df.first()) == (1, "x\ny")
