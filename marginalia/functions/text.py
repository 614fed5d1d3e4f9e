"""Text rules as Column builders; everything stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Formats the answers follow, given as patterns.
ANSWER_HEADING = r"(?:^|\n)\s*##\s*Answer\s*:?\s*"
REFERENCES_HEADING = r"(?:^|\n)\s*(?:##\s*References|References\s*:|[\*]{2}References[\*]{2})\s*:?\s*"
NUMBER_BRACKET = r"\[[\d,\s\-]+\]"
HTML_TAG = r"<[^>]+>"
IDENTIFIER = r"^[a-zA-Z0-9_-]+$"

# Section names that count as answer-rich.
PRIORITY_SECTIONS = ("abstract", "conclusion", "discussion", "result", "introduction", "background", "limitation")

# Search priority of a document and its label.
PRIORITY_LABELS = {0: "EXCLUDE", 10: "LOW", 50: "NORMAL", 100: "HIGH"}

# Publication types that are not research articles.
NON_RESEARCH_TYPES = ("Review", "Editorial", "Letter", "Comment", "Erratum")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``, also inside another lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


# The white space characters of Unicode.
WHITE_SPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
               "\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITE_SPACE))


def normalise_space(text: Column) -> Column:
    """Every run of white space becomes one blank; none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), r"\A | \z", "")


def extract_answer_section(text: Column) -> Column:
    """The text before the references heading, untrimmed."""
    return F.regexp_replace(text, r"(?isU)" + REFERENCES_HEADING + r".*\z", "")


def strip_references_section(text: Column) -> Column:
    return rstrip(extract_answer_section(text))


def strip_answer_heading(text: Column) -> Column:
    """Drops each answer heading that starts a line, then colons and blanks left at the start."""
    without = F.regexp_replace(strip(text), r"(?imdU)^##\s*Answer\s*:?\s*\n?", "")
    return F.regexp_replace(without, r"\A[: \t\n]+", "")


def bracketed_sources(text: Column) -> Column:
    """Source ids cited in brackets, in order, repeats kept."""
    inside = F.regexp_extract_all(text, F.lit(r"\[([^\]]+)\]"), F.lit(1))
    return F.flatten(F.transform(inside, lambda x: F.regexp_extract_all(x, F.lit(r"PMC(\d+)"), F.lit(1))))


def cited_sources(response: Column) -> Column:
    """Distinct sources cited in the answer part, by first appearance."""
    return F.array_distinct(bracketed_sources(extract_answer_section(response)))


def single_bracket_sources(response: Column) -> Column:
    """Distinct sources of one-id brackets anywhere in the response (the validity metric's rule)."""
    return F.array_distinct(F.regexp_extract_all(response, F.lit(r"\[PMC(\d+)\]"), F.lit(1)))


def rewrite(text: Column, pattern: str, group: int, replacement: Callable[[Column], Column]) -> Column:
    """One pass over ``text``: each match becomes ``replacement(captured group)``."""
    captured = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    new = F.concat(F.transform(captured, replacement), F.array(F.lit("")))
    return F.array_join(F.zip_with(F.split(text, pattern, -1), new, lambda piece, n: F.concat(piece, n)), "")


CITED_ID = r"PMC(\d+)(?=\s*[,\]])"


def renumberable_sources(text: Column) -> Column:
    """Distinct ids that ``renumber`` would look up."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(CITED_ID), F.lit(1)))


def renumber(text: Column, numbers: Column) -> Column:
    """``PMC<id>`` before a comma or closing bracket becomes its number; ids missing in the map stay."""
    return rewrite(
        text, CITED_ID, 1,
        lambda i: F.coalesce(F.try_element_at(numbers, i).cast("string"), F.concat(F.lit("PMC"), i)),
    )


def drop_leaked_numbers(text: Column, is_valid: Callable[[Column], Column]) -> Column:
    """Removes number brackets none of whose numbers is a citation of the conversation."""
    def keep(bracket: Column) -> Column:
        numbers = F.regexp_extract_all(bracket, F.lit(r"(\d+)"), F.lit(1))
        return F.when(F.exists(numbers, is_valid), bracket).otherwise(F.lit(""))

    return rewrite(text, f"({NUMBER_BRACKET})", 1, keep)


def is_number_up_to(highest: Column) -> Callable[[Column], Column]:
    """Validity test for dense numbering 1..highest; ``03`` is not a citation number."""
    return lambda n: n.rlike(r"^[1-9]\d{0,17}$") & (n.try_cast("long") <= highest)


def clean_passage(text: Column) -> Column:
    """Removes reference numbers of the paper itself before a passage goes into a prompt."""
    return F.regexp_replace(text, NUMBER_BRACKET, "")


def strip_html(text: Column) -> Column:
    return F.regexp_replace(text, HTML_TAG, "")


def section_priority(section: Column) -> Column:
    """1 for answer-rich sections, 2 for all others and for NULL."""
    return F.when(F.lower(section).rlike("|".join(PRIORITY_SECTIONS)), 1).otherwise(2)


def priority_label(priority: Column) -> Column:
    out = F.concat(F.lit("OTHER ("), priority.cast("string"), F.lit(")"))
    for value, label in PRIORITY_LABELS.items():
        out = F.when(priority == value, F.lit(label)).otherwise(out)
    return out


def non_research(pub_types: Column) -> Column:
    return F.arrays_overlap(pub_types, F.array(*[F.lit(t) for t in NON_RESEARCH_TYPES]))


def fill_sentinel(value: Column) -> Column:
    """A number that was looked up but is not there is -1."""
    return F.coalesce(value, F.lit(-1))


def strip_source_prefix(value: Column) -> Column:
    return F.replace(value, F.lit("PMC"), F.lit(""))


def add_source_prefix(value: Column) -> Column:
    return F.concat(F.lit("PMC"), value)


def embedding_text(title: Column, section: Column, content: Column) -> Column:
    return F.concat(F.lit("Doc: "), title, F.lit("\nSection: "), F.coalesce(section, F.lit("None")),
                    F.lit("\n\n"), content)


def query_text(query: Column) -> Column:
    return F.concat(F.lit("search_query: "), query)


def passage_line(source_id: Column, title: Column, content: Column, journal: Column) -> Column:
    return F.concat(F.lit("[PMC"), source_id, F.lit("] Title: "), title, F.lit(" | "), clean_passage(content),
                    F.lit(" | Journal: "), journal, F.lit("\n"))


def slice_by_offsets(text: Column, start: Column, end: Column) -> Column:
    """Half-open, zero-based code-point offsets; the ends are trimmed."""
    return strip(F.substring(text, start + 1, end - start))


def id_list(value: Column) -> Column:
    """Comma-separated ids to an array of longs; blanks dropped."""
    ids = F.transform(F.split(value, ","), lambda x: F.trim(x).try_cast("long"))
    return F.filter(ids, lambda x: x.isNotNull())


def word_runs(text: Column) -> Column:
    """Default token unit: a word with the white space after it. Joining all tokens gives the text back."""
    return F.regexp_extract_all(text, F.lit(r"(\S+\s*)"), F.lit(1))


def token_count(text: Column, tokens: Callable[[Column], Column] = word_runs) -> Column:
    return F.size(tokens(text))


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def safe_ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))
