"""Source divergence audit: how far the term rates of a language's sources lie apart, and which terms set a source off.

One ``bytes.translate`` lower-cases A-Z and turns every ASCII byte that is no letter into a space, ``bytes.split`` cuts the
terms, and a ``Counter`` per document gives frequencies, of which the keys give document counts. Counters of one group are
summed inside the task up to a bounded number of terms before anything is shuffled, so a hot source or a frequent term
sends a few rows per task.

Rates come from the sparse counts: a term that a group lacks has the group's base rate. Distances of two sources are sums
of absolute differences over blocks of terms and blocks of sources, each of bounded size, plus the terms that neither
source has, in closed form. Whole numbers throughout, so results are exact and don't depend on the order of rows.

Stored counts are sorted and compress well: a file of a few MB holds millions of rows, and Spark takes the file's size for
the table's. So only the groups are broadcast, up to a counted size; every other join is told to merge.

Defined results: null text, lang and source are read as ''; a group without terms takes part with base rates; languages
without kept terms have distances of 0; repeated rows and ids count as often as they stand; other columns are not read, so
their names can't clash; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.session import scratch_path, stored

LEAST_DOCS, SCALE, PRIOR, LISTED = 30, 1_000_000_000, 5, 50
#: Terms that a task holds before it passes their counts on; rows that are Python objects at a time.
HELD, SLICE = 200_000, 256
#: Terms and sources of a block of rates, on average.
BLOCK_TERMS, BLOCK_SOURCES = 2_048, 256
#: Bytes of groups that are broadcast, as counted; more are shuffled.
BROADCAST_GROUPS = 8 << 20

_LETTERS = frozenset(range(0x41, 0x5B)) | frozenset(range(0x61, 0x7B)) | frozenset(range(0x80, 0x100))
TABLE = bytes(b + 0x20 if 0x41 <= b <= 0x5A else b if b in _LETTERS else 0x20 for b in range(256))
SUMS = "lang string, source string, term string, n long, docs long"


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8."""
    return text.translate(TABLE).split()


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of a task's documents; the term '' says that the group occurs."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def told() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            names = [b"", *n]
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * len(names), pa.string()), pa.array([source] * len(names), pa.string()),
                pa.array(names, pa.binary()).cast(pa.string()), pa.array([0, *n.values()], pa.int64()),
                pa.array([0, *map(docs.__getitem__, n)], pa.int64())], names=["lang", "source", "term", "n", "docs"])

    for whole in batches:
        for batch in (whole.slice(at, SLICE) for at in range(0, whole.num_rows, SLICE)):
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang, source, text in zip(langs, sources, batch.column(2).cast(pa.binary()).to_pylist()):
                own = Counter(terms(text or b""))
                n, docs = held.setdefault((lang or "", source or ""), (Counter(), Counter()))
                before = len(n)
                n.update(own)
                docs.update(own.keys())
                size += len(n) - before + (not before)
                if size >= HELD:
                    yield from told()
                    held.clear()
                    size = 0
    yield from told()


def counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) over all documents; every group also has the term '' with zeros."""
    slim = docs.select(docs["lang"].cast("string"), docs["source"].cast("string"), docs["text"].cast("string"))
    return slim.mapInArrow(_sums, SUMS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _rate(n: str, total: str, kept: str) -> F.Column:
    return F.expr(f"1 + cast({SCALE} as decimal(20,0)) * ({n} + {PRIOR}) div ({total} + {PRIOR} * {kept})").cast("long")


def _kept(named: DataFrame, common: DataFrame) -> DataFrame:
    """(lang, term, source, n, lang_n) of the terms that a language keeps."""
    return named.select("lang", "source", "term", "n").join(common.drop("docs").hint("merge"), ["lang", "term"])


def _groups(told: DataFrame, common: DataFrame, sparse: DataFrame) -> DataFrame:
    """(lang, source, total, sources, kept, lang_total, base) of every group."""
    own = told.where("term = ''")
    kept = common.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_total"))
    langs = own.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")).join(kept.hint("merge"), "lang", "left")
    totals = sparse.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = own.select("lang", "source").join(totals.hint("merge"), ["lang", "source"], "left") \
        .join(langs.hint("merge"), "lang").withColumns({"kept": F.coalesce("kept", F.lit(0)), "total": F.coalesce("total", F.lit(0))})
    return groups.withColumn("base", F.when(F.col("kept") > 0, _rate("0", "total", "kept")))


def _with_groups(sparse: DataFrame, groups: DataFrame) -> DataFrame:
    """Joins each row to its group's; groups are broadcast up to a counted size, shuffled beyond it."""
    size = groups.agg(F.sum(F.octet_length("lang") + F.octet_length("source") + 64)).first()[0] or 0
    return sparse.join(F.broadcast(groups) if size <= BROADCAST_GROUPS else groups.hint("merge"), ["lang", "source"])


def _distances(key: tuple, table: pa.Table) -> pa.Table:
    """Sums over the terms of one block for each pair of its sources, with the number of terms that either side's block has."""
    lang, _, low, high = (k.as_py() for k in key)
    rows = table.select(["source", "block", "base", "term", "rate"]).to_pandas()
    base = rows[rows["term"].isna()].drop_duplicates("source").sort_values("source")
    names, bases, blocks = base["source"].tolist(), base["base"].to_numpy(np.int64), base["block"].to_numpy()
    held = rows[rows["term"].notna()]
    codes, found = pd.factorize(held["term"])
    rates = np.repeat(bases[:, None], len(found), axis=1)
    rates[pd.Index(names).get_indexer(held["source"]), codes] = held["rate"].to_numpy(np.int64)
    first, second, sums = [], [], [np.zeros(0, np.int64)]
    for i, name in enumerate(names):
        others = np.arange(i + 1, len(names))
        if low != high:
            others = others[blocks[others] != blocks[i]]
        first += [name] * len(others)
        second += [names[k] for k in others]
        sums.append(np.abs(rates[others] - rates[i]).sum(axis=1))
    return pa.table([pa.array([lang] * len(first), pa.string()), pa.array(first, pa.string()), pa.array(second, pa.string()),
                     pa.array(np.concatenate(sums)), pa.array(np.full(len(first), len(found), np.int64))],
                    names=["lang", "source", "item", "value", "met"])


def _pairs(groups: DataFrame, rated: DataFrame) -> DataFrame:
    """(lang, source, item, value) for both orders of each pair of sources."""
    several = groups.where("sources > 1 and kept > 0")
    parts = F.expr(f"cast(ceil(kept / {BLOCK_TERMS}) as int)")
    marks = several.select("lang", "source", "base", "sources", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"),
                           F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("rate"))
    held = rated.where("sources > 1").select("lang", "source", "base", "sources", F.pmod(F.hash("term"), parts).alias("part"), "term", "rate")
    blocks = F.expr(f"cast(ceil(sources / {BLOCK_SOURCES}) as int)")
    dealt = marks.unionByName(held).withColumn("block", F.pmod(F.hash("source"), blocks)) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = dealt.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other", "sources")
    sums = dealt.groupBy("lang", "part", "low", "high") \
        .applyInArrow(_distances, "lang string, source string, item string, value long, met long") \
        .groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("met").alias("met"))
    left, right = groups.alias("g"), groups.select("lang", F.col("source").alias("item"), F.col("base").alias("other")).alias("o")
    pairs = left.join(right.hint("merge"), "lang").where(F.col("source") < F.col("item")).select("lang", "source", "item", "kept", "base", "other")
    absent = F.coalesce((F.col("kept") - F.coalesce("met", F.lit(0))) * F.abs(F.col("base") - F.col("other")), F.lit(0))
    once = pairs.join(sums.hint("merge"), ["lang", "source", "item"], "left") \
        .select("lang", "source", "item", (F.coalesce("value", F.lit(0)) + absent).alias("value"))
    return once.unionByName(once.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))


def audit(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank): distances to the other sources of the language, and terms above its rate."""
    spark = docs.sparkSession
    path = scratch_path(spark, "term-counts")
    counts(docs).write.parquet(path)
    told = spark.read.schema(SUMS).parquet(path)
    named = told.where("term <> ''")
    common = named.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= LEAST_DOCS)
    kept_path = scratch_path(spark, "kept-terms")
    _kept(named, common).write.parquet(kept_path)
    sparse = spark.read.schema("lang string, term string, source string, n long, lang_n long").parquet(kept_path)
    groups = stored(_groups(told, common, sparse), "term-groups")
    rated = _with_groups(sparse, groups).withColumn("rate", _rate("n", "total", "kept"))
    above = rated.withColumn("lang_rate", _rate("lang_n", "lang_total", "kept")).where("rate > lang_rate") \
        .select("lang", "source", F.col("term").alias("item"), (F.col("rate") - F.col("lang_rate")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df, name: df.select("lang", "source", F.lit(name).alias("part"), "item", "value",
                                        F.row_number().over(order).alias("rank"))
    return ranked(_pairs(groups, rated), "pair").unionByName(ranked(above, "term").where(F.col("rank") <= LISTED))
