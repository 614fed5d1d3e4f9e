import pytest
from pyspark.sql import functions as F

from marginalia.functions import text as X

BODY = "Drug A lowers glucose [PMC11]."
HEADINGS = [
    f"## Answer\n{BODY}\n## References\n[PMC11] t",
    f"## Answer:\n{BODY}\n## References:\n[PMC11] t",
    f"##Answer\n{BODY}\n##References\n[PMC11] t",
    f"## Answer\n{BODY}\n**References**\n[PMC11] t",
    f"## ANSWER\n{BODY}\n## REFERENCES\n[PMC11] t",
    f"## aNsWeR:\n{BODY}\n## ReFeReNcEs:\n[PMC11] t",
    f"##   Answer  :\n{BODY}\n##   References  :\n[PMC11] t\n[PMC12] u",
    f"## Answer\n{BODY}\nReferences:\n[PMC11] t",
    f"## Answer\n{BODY}\n\n## References\n[PMC11] t",
    f"  \n## Answer\n{BODY}",
    BODY,
]


def one(spark, expression, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(expression.alias("x")).collect()[0]["x"]


@pytest.mark.parametrize("text", HEADINGS)
def test_headings(spark, text):
    assert one(spark, X.strip_references_section(X.strip_answer_heading(F.col("t"))), t=text) == BODY


def test_heading_details(spark):
    strip = X.strip_answer_heading(F.col("t"))
    assert one(spark, strip, t="## Answer: one\n\ntwo\n## Answer\nthree") == "one\n\ntwo\nthree"
    assert one(spark, strip, t="The ## Answer stays") == "The ## Answer stays"
    cut = X.strip_references_section(F.col("t"))
    assert one(spark, cut, t="See References in the text.") == "See References in the text."
    assert one(spark, X.extract_answer_section(F.col("t")), t="a \n## References\nb") == "a "
    assert one(spark, X.extract_answer_section(F.col("t")), t="a  ") == "a  "


@pytest.mark.parametrize("text, ids", [
    ("x [PMC1]", ["1"]), ("x [PMC1, PMC2]", ["1", "2"]), ("[ PMC1 ]", ["1"]), ("[PMC1,PMC2]", ["1", "2"]),
    ("[PMC1][PMC2]", ["1", "2"]), ("[PMC2] [PMC1] [PMC2]", ["2", "1"]), ("PMC1", []), ("", []),
    ("a\n## References\n[PMC9]", []),
])
def test_cited_sources(spark, text, ids):
    assert one(spark, X.cited_sources(F.col("t")), t=text) == ids


@pytest.mark.parametrize("text, out", [
    ("[PMC12]", "[1]"), ("[PMC12, PMC123]", "[1, 2]"), ("[PMC12,PMC123]", "[1,2]"), ("[ PMC12 ]", "[ 1 ]"),
    ("[PMC12, PMC123, PMC12]", "[1, 2, 1]"), ("[PMC1234]", "[PMC1234]"), ("PMC12 alone", "PMC12 alone"), ("", ""),
])
def test_renumber(spark, text, out):
    numbers = F.create_map(F.lit("12"), F.lit(1), F.lit("123"), F.lit(2))
    assert one(spark, X.renumber(F.col("t"), numbers), t=text) == out


@pytest.mark.parametrize("text, out", [
    ("a [3] b", "a  b"), ("a [1] b", "a [1] b"), ("a [1,9] b", "a [1,9] b"), ("a [8, 9-12] b", "a  b"),
    ("a [02] b", "a  b"), ("[[3]2] [2]", "[2] [2]"), ("[99999999999999999999]", ""),
])
def test_leaked_numbers(spark, text, out):
    assert one(spark, X.drop_leaked_numbers(F.col("t"), X.is_number_up_to(F.lit(2))), t=text) == out


def test_small_functions(spark):
    assert one(spark, X.normalise_space(F.col("t")), t="  a\t\nb c ") == "a b c"
    assert one(spark, X.strip(F.col("t")), t="\n  a b \x1f") == "a b"
    assert one(spark, X.id_list(F.col("t")), t="1, 2,,x, 33") == [1, 2, 33]
    assert one(spark, X.strip_html(F.col("t")), t="<b>a</b> < b") == "a < b"
    assert one(spark, X.embedding_text(F.lit("T"), F.lit(None).cast("string"), F.col("t")), t="c") == "Doc: T\nSection: None\n\nc"
    assert one(spark, X.slice_by_offsets(F.col("t"), F.lit(1), F.lit(6)), t="héé😀 x") == "éé😀 x"
    assert one(spark, X.priority_label(F.lit(7)), t="") == "OTHER (7)"
    assert one(spark, X.section_priority(F.lit(None).cast("string")), t="") == 2
    assert one(spark, X.section_priority(F.col("t")), t="3. Main Results") == 1
