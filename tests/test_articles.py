import pytest

from marginalia.operators.articles import fetch_details, parse_article, parse_articles

NESTED = """<article><front><article-title>A <italic>b</italic>
 c</article-title><abstract><p>one</p><sec><p>two <b>x</b></p></sec></abstract><abstract><p>no</p></abstract></front>
<body><p>lost</p><sec><title>Methods</title><p>outer</p><sec><title>Sub</title><p>inner</p></sec></sec>
<sec><title>METHODS</title><p>again</p></sec><sec><p>plain</p></sec><sec><title>Empty</title></sec></body></article>"""


def names(parsed):
    return [(s["section"], s["text"]) for s in parsed["sections"]]


def test_own_mode_keeps_nested_text_once():
    p = parse_article(NESTED)
    assert (p["title"], p["abstract"]) == ("A b c", "one\n\ntwo x")
    assert names(p) == [("methods", "outer"), ("sub", "inner"), ("methods_1", "again"), ("body", "plain")]


def test_compat_mode_repeats_nested_children():
    p = parse_article(NESTED, "compat")
    assert names(p) == [("methods", "outer\n\nSub\n\ninner"), ("sub", "inner"), ("methods_1", "again"), ("body", "plain")]


@pytest.mark.parametrize("table, text", [
    ("<caption>Cap</caption><table><thead><tr><th>a</th><th>b</th></tr></thead><tbody><tr><td>1</td></tr><tr/></tbody></table>",
     "**Cap**\n\n| a | b |\n|---|---|\n| 1 |  |"),
    ("<table><tbody><tr><td>1</td><td>2</td></tr></tbody></table>", "| 1 | 2 |"),
    ("<caption>Cap</caption>", None),
])
def test_tables(table, text):
    p = parse_article(f"<a><body><sec><title>T</title><table-wrap>{table}</table-wrap></sec></body></a>")
    assert names(p) == ([("t", text)] if text else [])


def test_failures_keep_their_rows(spark):
    rows = [("1", "<a><article-title/></a>"), ("2", "<a>"), ("3", None), ("4", "<a/>")]
    articles = spark.createDataFrame(rows, "pmc_id string, xml string")
    assert {r["pmc_id"] for r in parse_articles(articles).where("error is not null").collect()} == {"2", "3"}
    summaries = spark.createDataFrame([("1", "S", ["x"], "J", "2024", "", "9"), ("2", "S", ["x"], "J", "2024", "", "9")],
                                      "pmc_id string, title string, authors array<string>, journal string, pub_date string, doi string, pmid string")
    docs, failed = fetch_details(articles, summaries)
    assert [(r["source_id"], r["title"], r["full_text"]) for r in docs.collect()] == [("1", "S", "")]
    assert {(r["pmc_id"], r["error"] == "no summary") for r in failed.collect()} == {("2", False), ("3", False), ("4", True)}
