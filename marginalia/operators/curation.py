"""Curation of papers by citation metrics: status, priority, identifiers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from marginalia.functions.text import add_source_prefix, fill_sentinel, non_research, priority_label
from marginalia.operators.keyed import set_where_listed

# Allowed status changes and priority levels.
FROM_STATUS = ("pending", "wont_fetch", "failed")
TO_STATUS = ("pending", "wont_fetch")
PRIORITY_LEVELS = (0, 10, 50, 100)

# Minimum percentile by publication year; later years have none.
YEAR_THRESHOLDS = {2020: 80, 2021: 70, 2022: 60, 2023: 40}


def has_pmid(pmid: str = "pmid") -> Column:
    """A real id: NULL is "not looked up", -1 is "looked up, none"."""
    return F.col(pmid).isNotNull() & (F.col(pmid) > 0)


def pmid_work_list(papers: DataFrame) -> DataFrame:
    return papers.where(F.col("pmid").isNull())


def metric_work_list(papers: DataFrame) -> DataFrame:
    return papers.where(has_pmid() & F.col("nih_percentile").isNull())


def metric_predicate(
    min_percentile: float | None = None,
    min_year: int | None = None,
    max_year: int | None = None,
    min_citation_count: int | None = None,
) -> Column:
    """Only the given bounds apply; a NULL metric fails every bound on it."""
    out = F.lit(True)
    if min_percentile is not None:
        out = out & (F.col("nih_percentile") >= min_percentile)
    if min_year is not None:
        out = out & (F.col("year") >= min_year)
    if max_year is not None:
        out = out & (F.col("year") <= max_year)
    if min_citation_count is not None:
        out = out & (F.col("citation_count") >= min_citation_count)
    return out


def filter_counts(papers: DataFrame, metrics: DataFrame, fetch_status: str, bounds: Mapping[str, Mapping]) -> DataFrame:
    """Number of papers that ``filter_by_metrics`` would give for each named set of bounds, from one join."""
    left = papers.where((F.col("fetch_status") == fetch_status) & has_pmid()).select("pmid")
    right = metrics.select("pmid", "nih_percentile", "year", "citation_count")
    one = left.join(right, "pmid").agg(F.map_from_arrays(
        F.array(*map(F.lit, bounds)), F.array(*[F.count_if(metric_predicate(**b)) for b in bounds.values()])).alias("counts"))
    return one.select(F.explode("counts").alias("bounds", "n"))


def filter_by_metrics(papers: DataFrame, metrics: DataFrame, fetch_status: str, **bounds) -> DataFrame:
    """Ids of papers in the status whose metrics row meets the bounds.

    Both sides are cut to the key before the join; status, pmid and bound predicates reach the scans.
    """
    left = papers.where((F.col("fetch_status") == fetch_status) & has_pmid()).select("pmc_id", "pmid")
    right = metrics.where(metric_predicate(**bounds)).select("pmid")
    return left.join(right, "pmid").select("pmc_id")


def threshold_filter(papers: DataFrame, metrics: DataFrame, thresholds: dict[int, float] = YEAR_THRESHOLDS) -> DataFrame:
    """Papers at or above the percentile their publication year asks for; years without a threshold pass."""
    wanted = F.lit(None).cast("double")
    for year, percentile in thresholds.items():
        wanted = F.when(F.col("year") == year, float(percentile)).otherwise(wanted)
    rows = papers.where(has_pmid()).select("pmc_id", "pmid").join(
        metrics.select("pmid", "year", "nih_percentile"), "pmid")
    return rows.withColumn("threshold", wanted) \
        .where(F.col("threshold").isNull() | (F.col("nih_percentile") >= F.col("threshold")))


def set_fetch_status(papers: DataFrame, metrics: DataFrame, from_status: str, to_status: str, **bounds) -> DataFrame:
    """Moves papers with matching metrics to another status; also without bounds a metrics row is required."""
    if from_status not in FROM_STATUS or to_status not in TO_STATUS:
        raise ValueError(f"no transition from {from_status} to {to_status}")
    chosen = filter_by_metrics(papers, metrics, from_status, **bounds)
    return set_where_listed(papers, chosen, "pmc_id", {"fetch_status": to_status})


def match_report(papers: DataFrame, metrics: DataFrame, fetch_status: str, **bounds) -> DataFrame:
    """Candidates, matches and their share: the dry run of ``set_fetch_status``."""
    hit = metrics.where(metric_predicate(**bounds)).select("pmid").withColumn("hit", F.lit(1))
    rows = papers.where(F.col("fetch_status") == fetch_status).select(
        F.when(has_pmid(), F.col("pmid")).alias("pmid")).join(hit, "pmid", "left")
    return rows.agg(F.count(F.lit(1)).alias("candidates"), F.count("hit").alias("matching")).withColumn(
        "percent", F.round(F.coalesce(F.try_divide(F.col("matching") * 100.0, F.col("candidates")), F.lit(0.0)), 2))


def set_priority(papers: DataFrame, ids: DataFrame, priority: int) -> DataFrame:
    if priority not in PRIORITY_LEVELS:
        raise ValueError(f"priority is one of {PRIORITY_LEVELS}")
    return set_where_listed(papers, ids, "pmc_id", {"priority": priority})


def exclude_non_research(papers: DataFrame) -> DataFrame:
    """Reviews, editorials, letters, comments and errata leave the search corpus."""
    return papers.withColumn("priority", F.when(non_research(F.col("pub_types")), 0).otherwise(F.col("priority")))


def count_by_priority(papers: DataFrame, ids: DataFrame | None = None, fetch_status: str | None = None) -> DataFrame:
    rows = papers
    if fetch_status is not None:
        rows = rows.where(F.col("fetch_status") == fetch_status)
    if ids is not None:
        rows = rows.join(ids.select("pmc_id").distinct(), "pmc_id", "left_semi")
    return rows.groupBy("priority").agg(F.count(F.lit(1)).alias("n")) \
        .withColumn("label", priority_label(F.col("priority"))).orderBy(F.desc("priority"))


def propagate_priority(docs: DataFrame, papers: DataFrame, source: str = "pmc") -> DataFrame:
    """Copies the paper's priority to its document; other documents keep theirs."""
    by_id = papers.select(F.col("pmc_id").alias("source_id"), F.col("priority").alias("__p"), F.lit(source).alias("source"))
    return docs.join(by_id, ["source", "source_id"], "left").select(*[
        F.coalesce("__p", "priority").alias("priority") if c == "priority" else F.col(c) for c in docs.columns])


def apply_id_conversion(papers: DataFrame, asked: DataFrame, response: DataFrame) -> DataFrame:
    """Identifiers of the asked papers from a conversion response.

    ``asked``: pmc_id, ids of batches that answered. ``response``: pmc_id, pmid (string), doi. A record without a
    pmid, and an asked id without a record, get -1. Papers that already have an id, or were not asked, stay.
    """
    known = response.groupBy("pmc_id").agg(F.max_by(F.struct("pmid", "doi"), F.coalesce("pmid", F.lit(""))).alias("r"))
    wanted = asked.select("pmc_id").distinct().join(known, "pmc_id", "left").withColumn("__asked", F.lit(True))
    joined = papers.join(wanted, "pmc_id", "left")
    fresh = F.col("__asked") & F.col("pmid").isNull()
    found = F.coalesce(F.nullif(F.col("r.pmid"), F.lit("")).try_cast("long"), F.lit(-1))
    return joined.select(*[
        F.when(fresh, found).otherwise(F.col("pmid")).alias("pmid") if c == "pmid"
        else F.when(fresh & F.col("r").isNotNull(), F.col("r.doi")).otherwise(F.col("doi")).alias("doi") if c == "doi"
        else F.col(c) for c in papers.columns])


def conversion_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Papers that got an id in this run, and those marked as having none."""
    changed = before.where(F.col("pmid").isNull()).select("pmc_id").join(after.select("pmc_id", "pmid"), "pmc_id")
    return changed.agg(F.count_if(F.col("pmid") > 0).alias("with_pmid"),
                       F.count_if(F.col("pmid") == -1).alias("without_pmid"))


def conversion_requests(papers: DataFrame, batch_size: int = 200) -> DataFrame:
    """Request lists for papers without an id: prefixed ids, ``batch_size`` per request. Ids are numeric."""
    from marginalia.operators.ordinals import fixed_batches

    work = pmid_work_list(papers).select(F.col("pmc_id").cast("long").alias("key"))
    numbered = fixed_batches(work, "key", batch_size)
    return numbered.groupBy("batch_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list("key")), lambda k: add_source_prefix(k.cast("string"))), ",").alias("ids"),
        F.count(F.lit(1)).alias("n"))


def populate_metrics(papers: DataFrame, metrics: DataFrame, max_update: int | None = None) -> DataFrame:
    """Copies metrics to papers not yet queried: missing numbers become -1, booleans stay NULL.

    Papers without a metrics row stay untouched. ``max_update`` limits a run to so many papers, lowest pmid first. Of
    several metrics rows of one pmid, the one with the most citations counts.
    """
    todo = metric_work_list(papers).select("pmc_id", "pmid")
    if max_update is not None:
        todo = todo.orderBy("pmid").limit(max_update)
    rows = todo.join(metrics, "pmid").groupBy("pmc_id").agg(F.max_by(F.struct(
        fill_sentinel(F.col("nih_percentile")).alias("nih_percentile"), fill_sentinel(F.col("year")).alias("year"),
        fill_sentinel(F.col("citation_count")).alias("citation_count"),
        fill_sentinel(F.col("relative_citation_ratio")).alias("relative_citation_ratio"),
        "is_clinical", "is_research_article"),
        F.struct(F.coalesce("citation_count", F.lit(-1)), F.coalesce("year", F.lit(-1)), F.xxhash64(*metrics.columns)))
        .alias("__m"))
    source = {"publication_year": "year"}
    copied = ("nih_percentile", "publication_year", "citation_count", "relative_citation_ratio", "is_clinical",
              "is_research_article")
    joined = papers.join(rows, "pmc_id", "left")
    return joined.select(*[
        F.when(F.col("__m").isNotNull(), F.col(f"__m.{source.get(c, c)}")).otherwise(F.col(c)).alias(c)
        if c in copied else F.col(c) for c in papers.columns])


def search_catalogue(catalogue: DataFrame, keyword: str, start: str, end: str, open_access: bool = True) -> DataFrame:
    """The default search over a landed catalogue: keyword in title or abstract, open access, date range."""
    text = F.lower(F.concat_ws(" ", "title", "abstract") if "abstract" in catalogue.columns else F.col("title"))
    hit = F.contains(text, F.lit(keyword.lower())) & F.col("pub_date").between(
        F.lit(start).cast("date"), F.lit(end).cast("date"))
    return catalogue.where(hit & F.col("open_access")) if open_access else catalogue.where(hit)


def collect_ids(papers: DataFrame, found: DataFrame, fetch_status: str = "pending", reset_fetched: bool = False,
                limit: int | None = None) -> DataFrame:
    """Search results into the paper table: new ids are added; known ones stay or, on reset, take the status."""
    from marginalia.operators.keyed import insert_ignore, insert_or_set

    ids = found.select("pmc_id").dropDuplicates()
    if limit is not None:
        ids = ids.orderBy("pmc_id").limit(limit)
    new = ids.withColumn("fetch_status", F.lit(fetch_status)).withColumn("priority", F.lit(50))
    if reset_fetched:
        return insert_or_set(papers, new, ["pmc_id"], ["fetch_status"])
    return insert_ignore(papers, new, ["pmc_id"])


def mark_fetched(papers: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Status after a fetch run. ``outcomes``: pmc_id, ok boolean; a paper tried twice is fetched if one try was."""
    result = outcomes.groupBy("pmc_id").agg(F.max("ok").alias("__ok"))
    return papers.join(result, "pmc_id", "left").select(*[
        F.when(F.col("__ok"), "fetched").when(~F.col("__ok"), "failed").otherwise(F.col(c)).alias(c)
        if c == "fetch_status" else F.col(c) for c in papers.columns])


def pack_batches(sizes: DataFrame, max_chunks: int = 50_000, max_tokens: int = 3_000_000) -> DataFrame:
    """Whole documents, by id, into batches within both limits.

    ``sizes``: document_id, chunk_count, token_count. Running totals by id cut the documents at every multiple of a
    limit: those that lie between the same multiples of both make a batch, named by its first id, and a document that
    lies across one is a batch of its own. So no batch exceeds a limit but by a document that alone does, none is
    left out, and the result does not depend on how the table is stored or how large it is.
    """
    from marginalia.operators.ordinals import radix_levels, running_totals
    from marginalia.session import stored

    key, levels = F.col("document_id"), radix_levels(F.col("document_id"))
    # the totals read the sizes several times, which may be counted from whole texts
    out = stored(sizes.where("chunk_count > 0"), "batch-sizes")
    out = running_totals(out, [], levels, [key], {"__c": F.col("chunk_count"), "__t": F.col("token_count")})
    marks = []
    for before, size, limit in (("__c", "chunk_count", max_chunks), ("__t", "token_count", max_tokens)):
        marks += [F.expr(f"{before} div {int(limit)}"), F.expr(f"greatest({before} + {size} - 1, {before}) div {int(limit)}")]
    first_c, last_c, first_t, last_t = marks
    across = F.when((first_c != last_c) | (first_t != last_t), key)
    out = out.withColumns({"__first_c": first_c, "__first_t": first_t, "__across": across})
    keys = ["__first_c", "__first_t", "__across"]
    names = out.groupBy(*keys).agg(F.min("document_id").alias("batch"))
    same = (F.col("o.__first_c") == F.col("n.__first_c")) & (F.col("o.__first_t") == F.col("n.__first_t")) \
        & F.col("o.__across").eqNullSafe(F.col("n.__across"))
    return out.alias("o").join(names.alias("n"), same) \
        .select("o.document_id", "n.batch", "o.chunk_count", "o.token_count")


def batch_totals(packed: DataFrame) -> DataFrame:
    return packed.groupBy("batch").agg(
        F.count(F.lit(1)).alias("doc_count"), F.sum("chunk_count").alias("chunk_count"),
        F.sum("token_count").alias("token_count"))


# Price per million tokens.
MODEL_PRICING = {"text-embedding-3-small": 0.02, "text-embedding-3-large": 0.13, "text-embedding-ada-002": 0.10}


def embedding_cost(chunks: DataFrame, batch_mode: bool = False, budget: float | None = None) -> DataFrame:
    """Token total and cost per model; batch mode is half price."""
    spark = chunks.sparkSession
    prices = spark.createDataFrame(list(MODEL_PRICING.items()), "model string, price double")
    total = chunks.agg(F.coalesce(F.sum("token_count"), F.lit(0)).alias("t")).scalar()
    out = prices.withColumn("tokens", total).withColumn(
        "cost", F.col("tokens") / 1e6 * F.col("price") * (0.5 if batch_mode else 1.0))
    return out if budget is None else out.withColumn("within_budget", F.col("cost") <= budget)
