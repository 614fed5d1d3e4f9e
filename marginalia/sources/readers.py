"""Readers of landed files. Schemas are given, never inferred."""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from marginalia import schemas as S
from marginalia.functions.text import strip, strip_source_prefix


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One id per line, trimmed, blank lines dropped."""
    return spark.read.text(path).select(strip(F.col("value")).alias("id")).where("id <> ''")


SEARCH_PAGE = T.StructType([T.StructField("esearchresult", T.StructType([
    T.StructField("count", T.StringType()), T.StructField("retstart", T.StringType()),
    T.StructField("idlist", T.ArrayType(T.StringType()))]))])


def read_search_pages(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Distinct ids of landed result pages; ``limit`` takes the first ones in result order."""
    pages = spark.read.schema(SEARCH_PAGE).json(path)
    ids = pages.select(F.col("esearchresult.retstart").try_cast("long").alias("start"),
                       F.posexplode("esearchresult.idlist").alias("pos", "pmc_id")) \
        .groupBy("pmc_id").agg(F.min(F.col("start") + F.col("pos")).alias("at"))
    if limit is not None:
        ids = ids.orderBy("at", "pmc_id").limit(limit)
    return ids.select("pmc_id")


def search_count(spark: SparkSession, path: str) -> DataFrame:
    """Total the search reported (the counts-only mode)."""
    return spark.read.schema(SEARCH_PAGE).json(path).agg(
        F.max(F.col("esearchresult.count").try_cast("long")).alias("total"))


def read_id_conversion(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Conversion records: pmc_id without its prefix, pmid, doi."""
    raw = spark.read.schema(S.ID_CONVERSION).option("multiLine", multi_line).json(path)
    return raw.select(F.explode("records").alias("r")).select(
        strip_source_prefix(F.col("r.pmcid")).alias("pmc_id"), F.col("r.pmid").alias("pmid"), F.col("r.doi").alias("doi"))


def read_qa_dataset(spark: SparkSession, path: str, whole_file: bool = True) -> DataFrame:
    """Questions of JSON objects keyed by pmid: (pmid, r). One object per file, or per line."""
    raw = spark.read.text(path, wholetext=whole_file)
    objects = F.from_json("value", T.MapType(T.StringType(), S.QA_RECORD))
    return raw.select(F.explode(objects).alias("pmid", "r"))


def read_golden(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    rows = spark.read.schema(S.GOLDEN).csv(path, header=True, multiLine=True, quote='"', escape='"')
    return rows if limit is None else rows.orderBy("question_id").limit(limit)


def read_auto_results(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    raw = spark.read.schema(S.AUTO_FILE).option("multiLine", multi_line).json(path)
    return raw.select(F.explode("results").alias("r")).select("r.*")


def read_judge_results(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Judge rows with their position in the file, which decides among repeated questions."""
    raw = spark.read.schema(S.JUDGE_FILE).option("multiLine", multi_line).json(path)
    return raw.select(F.posexplode("evaluations").alias("pos", "j")).select("pos", "j.*")


def read_metrics_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The metrics snapshot CSV with the fixed column order."""
    return spark.read.schema(S.METRICS).csv(path, header=True, quote='"', escape='"')


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """Landed article files named by their id: (pmc_id, xml)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").load(path)
    return files.select(F.regexp_extract("path", r"(?:PMC)?(\d+)\.xml$", 1).alias("pmc_id"), F.col("content").alias("xml"))


ARTICLE_SUMMARY = ("Id string, Title string, AuthorList array<string>, FullJournalName string, PubDate string, DOI string, "
                   "PmId string")


def read_landed_articles(spark: SparkSession, path: str, after: datetime | None = None) -> DataFrame:
    """Landed articles: (pmc_id, xml, landed_at), the copy of each id in the newest file (of equals, the last by path and row).

    They come in package files (``writers.write_articles``) and as files of their own below ``article=<id>`` folders. ``after``
    takes only files that landed later; the scan leaves the others unread. Which copy is the newest is decided on ids, names
    and times alone, contents are read once.
    """
    packages = spark.read.schema("pmc_id string, xml binary").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
    landed = packages.parquet(path).select(
        F.regexp_extract("pmc_id", r"^(?:PMC)?(\d+)$", 1).alias("pmc_id"), "xml", F.col("_metadata.file_modification_time").alias("landed_at"),
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("row"))
    try:
        loose = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "[!._]*").load(f"{path}/article=*")
        landed = landed.unionByName(loose.select(
            F.regexp_extract("path", r"/article=(?:PMC)?(\d+)/[^/]*$", 1).alias("pmc_id"), F.col("content").alias("xml"),
            F.col("modificationTime").alias("landed_at"), "path", F.lit(0).cast("long").alias("row")))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    landed = landed.where("pmc_id <> ''")
    if after is not None:
        landed = landed.where(F.col("landed_at") > F.lit(after))
    newest = landed.groupBy("pmc_id").agg(F.max(F.struct("landed_at", "path", "row")).alias("at")).select("pmc_id", "at.path", "at.row")
    return landed.join(newest, ["pmc_id", "path", "row"]).select("pmc_id", "xml", "landed_at")


def read_article_summaries(spark: SparkSession, path: str) -> DataFrame:
    """Landed summary records, one JSON object per line; lines without an id are left out."""
    return spark.read.schema(ARTICLE_SUMMARY).json(path).where("Id is not null").select(
        strip_source_prefix(F.col("Id")).alias("pmc_id"), F.col("Title").alias("title"), F.col("AuthorList").alias("authors"),
        F.col("FullJournalName").alias("journal"), F.col("PubDate").alias("pub_date"), F.col("DOI").alias("doi"),
        F.col("PmId").alias("pmid"))


def read_stream_log(spark: SparkSession, path: str) -> DataFrame:
    """Stream metrics out of ``key=value`` log lines; units are cut off."""
    pairs = F.str_to_map(F.col("value"), F.lit(" "), F.lit("="))
    number = lambda k: F.regexp_replace(F.try_element_at(pairs, F.lit(k)), "ms$", "")
    return spark.read.text(path).where(F.contains("value", F.lit("conversation_id="))).select(
        F.try_element_at(pairs, F.lit("conversation_id")).alias("conversation_id"),
        number("time_to_first_token").try_cast("long").alias("time_to_first_token"),
        number("total_tokens").try_cast("long").alias("total_tokens"),
        number("avg_time_per_token").try_cast("double").alias("avg_time_per_token"),
        number("total_stream_time").try_cast("long").alias("total_stream_time"),
        number("tokens_per_second").try_cast("double").alias("tokens_per_second"))
