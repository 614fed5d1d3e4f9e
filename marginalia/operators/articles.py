"""Article XML to title, abstract, named sections and full text."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from marginalia.operators.chunking import compose_article
from marginalia.session import stored

PARSED = ("pmc_id string, title string, abstract string, sections array<struct<section:string,text:string>>, "
          "error string")


def _flat(node: ET.Element | None) -> str:
    return "" if node is None else " ".join("".join(node.itertext()).split())


def _table(wrap: ET.Element) -> str:
    """Markdown of a table: bold caption, header row, body rows padded to the header."""
    table = wrap.find(".//table")
    if table is None:
        return ""
    lines = []
    caption = _flat(wrap.find(".//caption"))
    if caption:
        lines.append(f"**{caption}**\n")
    thead, tbody = table.find(".//thead"), table.find(".//tbody")
    head = [_flat(th) for th in thead.iter("th")] if thead is not None else []
    if head:
        lines += ["| " + " | ".join(head) + " |", "|" + "|".join("---" for _ in head) + "|"]
    for tr in tbody.iter("tr") if tbody is not None else ():
        cells = [_flat(td) for td in tr.iter("td")]
        if cells:
            cells += [""] * (len(head) - len(cells))
            lines.append("| " + " | ".join(cells) + " |")
    return "\n".join(lines)


def _pieces(sec: ET.Element, nested_mode: str) -> Iterator[str]:
    """Texts of one section in document order.

    ``own``: its paragraphs and tables, nested sections left to themselves. ``compat``: as well every direct
    child of each nested section as flat text, so nested text shows up here and under its own name.
    """
    def walk(node: ET.Element, parent: ET.Element | None, inside_nested: bool) -> Iterator[str]:
        nested_child = inside_nested and parent is not None and parent.tag == "sec"
        if nested_child or (node.tag == "p" and parent is sec):
            yield _flat(node)
        elif node.tag == "table-wrap":
            yield _table(node)
        for child in node:
            if child.tag == "sec" and nested_mode == "own":
                continue
            yield from walk(child, node, inside_nested or (node is not sec and node.tag == "sec"))

    yield from walk(sec, None, False)


def parse_article(xml: bytes | str, nested_mode: str = "own") -> dict:
    """Title, abstract and sections of one article; raises on malformed XML."""
    root = ET.fromstring(xml)
    abstract = root.find(".//abstract")
    paragraphs = [] if abstract is None else [_flat(p) for p in abstract.iterfind(".//p")]
    taken: dict[str, str] = {}
    body = root.find(".//body")
    for sec in body.iterfind(".//sec") if body is not None else ():
        texts = [t for t in _pieces(sec, nested_mode) if t]
        if not texts:
            continue
        heading = sec.find("title")
        base = name = "body" if heading is None else _flat(heading).lower()
        suffix = 0
        while name in taken:
            suffix += 1
            name = f"{base}_{suffix}"
        taken[name] = "\n\n".join(texts)
    return {"title": _flat(root.find(".//article-title")), "abstract": "\n\n".join(p for p in paragraphs if p),
            "sections": [{"section": n, "text": t} for n, t in taken.items()]}


def parse_articles(articles: DataFrame, nested_mode: str = "own") -> DataFrame:
    """``articles``: pmc_id, xml (binary or string). A malformed article keeps its row, with ``error`` set."""
    if nested_mode not in ("own", "compat"):
        raise ValueError("nested_mode is 'own' or 'compat'")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for pmc_id, xml in zip(frame["pmc_id"], frame["xml"]):
                try:
                    rows.append({"pmc_id": pmc_id, "error": None, **parse_article(xml, nested_mode)})
                except (ET.ParseError, TypeError, ValueError) as problem:
                    rows.append({"pmc_id": pmc_id, "title": None, "abstract": None, "sections": None,
                                 "error": str(problem)})
            yield pd.DataFrame(rows, columns=["pmc_id", "title", "abstract", "sections", "error"])

    return articles.select("pmc_id", "xml").mapInPandas(run, PARSED)


def fetch_details(articles: DataFrame, summaries: DataFrame, nested_mode: str = "own") -> tuple[DataFrame, DataFrame]:
    """Document records of landed articles and their summaries, and the ids that failed.

    ``summaries``: pmc_id, title, authors, journal, pub_date, doi, pmid. The summary's title stands in for a
    missing one. An article that does not parse or has no summary is a failure. Articles are parsed once, for both results.
    """
    parsed = stored(parse_articles(articles, nested_mode), "parsed")
    meta = summaries.select("pmc_id", F.struct(*[c for c in summaries.columns if c != "pmc_id"]).alias("m"))
    joined = parsed.join(meta, "pmc_id", "left")
    ok = F.col("error").isNull() & F.col("m").isNotNull()
    good = joined.where(ok).withColumn("c", compose_article(F.col("title"), F.col("abstract"), F.col("sections")))
    docs = good.select(
        F.lit("pmc").alias("source"), F.col("pmc_id").alias("source_id"),
        F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("m.title"), F.lit("")).alias("title"), "abstract",
        F.col("c.full_text").alias("full_text"),
        F.struct(F.coalesce("m.authors", F.array().cast("array<string>")).alias("authors"),
                 F.coalesce("m.journal", F.lit("")).alias("journal"), F.coalesce("m.pub_date", F.lit("")).alias("pub_date"),
                 F.coalesce("m.doi", F.lit("")).alias("doi"), F.col("m.pmid").alias("pmid"), F.col("pmc_id").alias("pmc_id"),
                 F.col("c.section_offsets").alias("section_offsets")).alias("doc_metadata"))
    failed = joined.where(~ok).select("pmc_id", F.coalesce("error", F.lit("no summary")).alias("error"))
    return docs, failed
