"""Full-text composition and overlapping token windows, inside the row: no shuffle, no Python."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from marginalia.functions.text import let, rstrip, strip, word_runs

# Window of the reference model.
CHUNK_SIZE = 512
OVERLAP = 50

WINDOW_TYPE = ("array<struct<section:string,content:string,char_start:int,char_end:int,token_count:int>>")


# Array elements that are summed by appending at a time.
BLOCK = 128


def _appended(lengths: Column) -> Column:
    """Inclusive running sums of a short int array; every step copies what is there."""
    return F.aggregate(lengths, F.array().cast("array<int>"), lambda acc, x: F.concat(
        acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x)))


def _running(lengths: Column) -> Column:
    """Inclusive running sums of an int array, by blocks, so that a long array is not copied at every step."""
    def blocks(xs: Column) -> Column:
        count = F.ceil(F.size(xs) / F.lit(BLOCK)).cast("int")
        parts = F.transform(F.sequence(F.lit(0), count - 1), lambda b: _appended(F.slice(xs, b * BLOCK + 1, F.lit(BLOCK))))
        return let(parts, joined)

    def joined(parts: Column) -> Column:
        ends = _appended(F.transform(parts, lambda p: F.element_at(p, -1)))
        return let(ends, lambda e: F.flatten(F.transform(parts, lambda p, b: let(
            F.coalesce(F.get(e, b - 1), F.lit(0)), lambda before: F.transform(p, lambda x: x + before)))))

    return F.when(F.size(lengths) <= BLOCK, _appended(lengths)).otherwise(let(lengths, blocks))


def unique_section_names(names: Column) -> Column:
    """A repeated name gets ``_1``, ``_2`` ...; names already taken by a literal heading are skipped."""
    def numbered(xs: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            seen = F.size(F.filter(F.slice(xs, F.lit(1), i), lambda y: y == x))
            return F.when(seen == 0, x).otherwise(F.concat(x, F.lit("_"), seen.cast("string")))
        return F.transform(xs, one)

    def probe(acc: Column, x: Column) -> Column:
        tries = F.transform(F.sequence(F.lit(1), F.size(acc) + 1), lambda i: F.concat(x, F.lit("_"), i.cast("string")))
        free = F.get(F.array_except(tries, acc), F.lit(0))
        return F.concat(acc, F.array(F.when(F.array_contains(acc, x), free).otherwise(x)))

    def choose(xs: Column) -> Column:
        return let(numbered(xs), lambda quick: F.when(F.size(F.array_distinct(quick)) == F.size(quick), quick)
                   .otherwise(F.aggregate(xs, F.array().cast("array<string>"), probe)))

    return F.when(F.size(F.array_distinct(names)) == F.size(names), names).otherwise(let(names, choose))


def compose_article(title: Column, abstract: Column, sections: Column) -> Column:
    """Full text with upper-case headers, and the offsets of each part's content.

    ``sections`` is array<struct<section,text>> with unique names. Returns
    struct<full_text, section_offsets>.
    """
    head = F.array(
        F.struct(F.lit("title").alias("section"), F.coalesce(title, F.lit("")).alias("text")),
        F.struct(F.lit("abstract").alias("section"), F.coalesce(abstract, F.lit("")).alias("text")),
    )
    parts = F.concat(F.filter(head, lambda p: p["text"] != ""), sections)

    def build(ps: Column) -> Column:
        sizes = F.transform(ps, lambda p: F.length(F.upper(p["section"])) + F.length(p["text"]) + 3)
        text = rstrip(F.array_join(F.transform(
            ps, lambda p: F.concat(F.upper(p["section"]), F.lit("\n"), p["text"])), "\n\n"))
        offsets = let(_running(sizes), lambda ends: F.transform(ps, lambda p, i: F.struct(
            p["section"].alias("section"),
            (F.get(ends, i) - F.length(p["text"]) - 2).alias("char_start"),
            (F.get(ends, i) - 2).alias("char_end"))))
        return F.struct(text.alias("full_text"), offsets.alias("section_offsets"))

    return let(parts, build)


def window_starts(n: Column, size: int, overlap: int) -> Column:
    """First token of each window; one window when everything fits, none for no tokens."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below the window size")
    return F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(size - overlap))) \
        .otherwise(F.array().cast("array<int>"))


def token_windows(
    text: Column,
    section: Column,
    section_char_start: Column,
    size: int = CHUNK_SIZE,
    overlap: int = OVERLAP,
    tokens: Callable[[Column], Column] = word_runs,
) -> Column:
    """Overlapping windows of one text, with character offsets in the document."""
    step = size - overlap

    def cut(toks: Column) -> Column:
        raw = F.transform(window_starts(F.size(toks), size, overlap), lambda s: F.struct(
            F.array_join(F.slice(toks, s + 1, F.lit(size)), "").alias("content"),
            F.length(F.array_join(F.slice(toks, s + 1, F.lit(step)), "")).alias("step_chars"),
            F.least(F.size(toks) - s, F.lit(size)).alias("token_count")))

        def place(wins: Column) -> Column:
            return let(_running(F.transform(wins, lambda w: w["step_chars"])), lambda ends: F.transform(
                wins, lambda w, i: let(section_char_start + F.get(ends, i) - w["step_chars"], lambda at: F.struct(
                    section.alias("section"), w["content"].alias("content"), at.alias("char_start"),
                    (at + F.length(w["content"])).alias("char_end"), w["token_count"].alias("token_count")))))
        return let(raw, place)

    def build(toks: Column) -> Column:
        # most sections fit one window and need no prefix sums
        single = let(F.array_join(toks, ""), lambda body: F.array(F.struct(
            section.alias("section"), body.alias("content"), section_char_start.alias("char_start"),
            (section_char_start + F.length(body)).alias("char_end"), F.size(toks).alias("token_count"))))
        return F.when(F.size(toks) == 0, F.array().cast(WINDOW_TYPE)) \
            .when(F.size(toks) <= size, single.cast(WINDOW_TYPE)).otherwise(cut(toks).cast(WINDOW_TYPE))

    return let(tokens(text), build)


def document_windows(
    title: Column,
    full_text: Column,
    section_offsets: Column,
    size: int = CHUNK_SIZE,
    overlap: int = OVERLAP,
    tokens: Callable[[Column], Column] = word_runs,
) -> Column:
    """All windows of a document in section order; a document without any gets windows of its title."""
    def last_of_name(offs: Column) -> Column:
        names = F.array_distinct(F.transform(offs, lambda o: o["section"]))
        latest = F.transform(names, lambda n: F.element_at(F.filter(offs, lambda o: o["section"] == n), -1))
        return F.when(F.size(names) == F.size(offs), offs).otherwise(latest)

    def body(offs: Column) -> Column:
        return F.flatten(F.transform(offs, lambda o: token_windows(
            strip(F.substring(full_text, o["char_start"] + 1, o["char_end"] - o["char_start"])),
            o["section"], o["char_start"], size, overlap, tokens)))

    listed = F.coalesce(section_offsets, F.array().cast("array<struct<section:string,char_start:int,char_end:int>>"))
    wanted = F.filter(listed, lambda o: o["section"] != "title")
    fallback = F.when(strip(title) != "", token_windows(title, F.lit("N/A"), F.lit(0), size, overlap, tokens)) \
        .otherwise(F.array().cast(WINDOW_TYPE))
    return let(let(wanted, lambda w: body(let(w, last_of_name))),
               lambda all_: F.when(F.size(all_) > 0, all_).otherwise(fallback))


def chunk_documents(
    docs: DataFrame,
    size: int = CHUNK_SIZE,
    overlap: int = OVERLAP,
    tokens: Callable[[Column], Column] = word_runs,
) -> DataFrame:
    """Chunk rows of (document_id, title, full_text, section_offsets); numbering runs over the whole document.

    The chunk id is the document id shifted by 24 bits plus the index: a text column holds fewer than
    2^31 bytes, so a document never has 2^24 windows.
    """
    windows = document_windows(F.coalesce("title", F.lit("")), F.coalesce("full_text", F.lit("")),
                               F.col("section_offsets"), size, overlap, tokens)
    return docs.select("document_id", F.posexplode(windows).alias("chunk_index", "w")).select(
        (F.shiftleft(F.col("document_id"), 24) + F.col("chunk_index")).alias("document_chunk_id"),
        "document_id", "w.section", "chunk_index", "w.content", "w.char_start", "w.char_end", "w.token_count")


def sections_of(docs: DataFrame) -> DataFrame:
    """Recovers every section's text from the stored offsets."""
    return docs.select("document_id", "full_text", F.posexplode("section_offsets").alias("pos", "o")).select(
        "document_id", "pos", "o.section", "o.char_start", "o.char_end",
        strip(F.substring("full_text", F.col("o.char_start") + 1, F.col("o.char_end") - F.col("o.char_start")))
        .alias("text"))
