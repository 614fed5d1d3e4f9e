import math

import pytest
from pyspark.sql import functions as F

from marginalia.operators import chunking as K


def windows(spark, n, size=512, overlap=50):
    text = " ".join(f"w{i}" for i in range(n))
    df = spark.createDataFrame([(text,)], "t string")
    rows = df.select(F.explode(K.token_windows(F.col("t"), F.lit("s"), F.lit(7), size, overlap)).alias("w")).select("w.*")
    return text, rows.collect()


@pytest.mark.parametrize("n, count", [(0, 0), (1, 1), (512, 1), (513, 2), (974, 2), (975, 3)])
def test_window_count(spark, n, count):
    text, rows = windows(spark, n)
    assert len(rows) == count
    for r in rows:
        assert text[r["char_start"] - 7:r["char_end"] - 7] == r["content"]
    if rows:
        assert rows[-1]["char_end"] - 7 == len(text)
        assert sum(r["token_count"] for r in rows) == n + 50 * (count - 1)


@pytest.mark.parametrize("size, overlap, n", [(4, 1, 23), (5, 4, 17), (3, 0, 9)])
def test_windows_rebuild_the_text(spark, size, overlap, n):
    text, rows = windows(spark, n, size, overlap)
    built = ""
    for r in rows:
        built = built[:r["char_start"] - 7] + r["content"]
    assert built == text
    assert len(rows) == 1 + max(0, math.ceil((n - size) / (size - overlap)))


@pytest.mark.parametrize("size, overlap", [(8, 8), (8, 9), (8, -1)])
def test_overlap_must_be_below_size(size, overlap):
    with pytest.raises(ValueError):
        K.token_windows(F.lit("a"), F.lit("s"), F.lit(0), size, overlap)


def chunk(spark, rows, size=4, overlap=1):
    schema = "document_id long, title string, full_text string, section_offsets array<struct<section:string,char_start:int,char_end:int>>"
    out = K.chunk_documents(spark.createDataFrame(rows, schema), size, overlap)
    return [tuple(r) for r in out.orderBy("document_id", "chunk_index").select(
        "document_id", "section", "chunk_index", "content", "char_start").collect()]


def test_special_documents(spark):
    rows = chunk(spark, [
        (1, "Only a title", "TITLE\nOnly a title", [("title", 6, 18)]),
        (2, "", "", []), (3, None, None, None), (4, "   ", "x", None),
        # the later offsets of a repeated name win, the first place stays
        (5, "T", "aa bb cc", [("x", 0, 2), ("y", 3, 5), ("x", 6, 8)]),
    ])
    assert rows == [(1, "N/A", 0, "Only a title", 0), (5, "x", 0, "cc", 6), (5, "y", 1, "bb", 3)]


def test_numbering_runs_over_sections(spark):
    rows = chunk(spark, [(9, "T", "a b c d e|f", [("p", 0, 9), ("q", 10, 11)])])
    assert [(r[1], r[2], r[3]) for r in rows] == [("p", 0, "a b c d "), ("p", 1, "d e"), ("q", 2, "f")]


def test_unique_names_skip_taken_headings(spark):
    df = spark.createDataFrame([(["x", "x_1", "x", "y", "x"],), (["a", "a", "a"],), ([],)], "n array<string>")
    got = [r[0] for r in df.select(K.unique_section_names(F.col("n"))).collect()]
    assert got == [["x", "x_1", "x_2", "y", "x_3"], ["a", "a_1", "a_2"], []]


def test_offsets_slice_back(spark):
    df = spark.createDataFrame([("Tîtle", "", [("introduction", "héé 😀"), ("results", "b\nc")])],
                               "t string, a string, s array<struct<section:string,text:string>>")
    c = df.select(K.compose_article(F.col("t"), F.col("a"), F.col("s")).alias("c")).collect()[0]["c"]
    assert c["full_text"] == "TITLE\nTîtle\n\nINTRODUCTION\nhéé 😀\n\nRESULTS\nb\nc"
    assert [c["full_text"][o["char_start"]:o["char_end"]] for o in c["section_offsets"]] == ["Tîtle", "héé 😀", "b\nc"]


def test_no_shuffle(spark, sf):
    from marginalia.plans import fixtures as V

    docs = spark.createDataFrame([(1, "t", "x", [])], "document_id long, title string, full_text string, "
                                 "section_offsets array<struct<section:string,char_start:int,char_end:int>>")
    assert "Exchange" not in K.chunk_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert V.chunks(spark, sf).select(F.max(F.col("chunk_index"))).collect()[0][0] > 10


def test_many_sections_in_one_document(spark):
    """Offsets of 20,000 sections come inside seconds and equal plain running sums."""
    import time

    from marginalia.operators.chunking import compose_article

    n = 20_000
    df = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.struct(
        F.concat(F.lit("s"), i.cast("string")).alias("section"), F.repeat(F.lit("x"), (i % 7).cast("int")).alias("text"))).alias("s"))
    start = time.perf_counter()
    row = df.select(compose_article(F.lit("T"), F.lit(""), F.col("s")).alias("c")).first()["c"]
    assert time.perf_counter() - start < 30
    offsets = row["section_offsets"]
    assert len(offsets) == n + 1
    at = 0
    for o, (name, text) in zip(offsets, [("title", "T"), *((f"s{i}", "x" * (i % 7)) for i in range(n))]):
        assert (o["section"], o["char_start"], o["char_end"]) == (name, at + len(name) + 1, at + len(name) + 1 + len(text))
        at += len(name) + len(text) + 3
