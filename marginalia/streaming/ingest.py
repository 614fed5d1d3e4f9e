"""Incremental ingestion: landed articles to document and chunk versions.

Each micro-batch writes only its own rows, as a version folder named by the stream's id and the epoch; nothing of another
stream is rewritten, and a repeated micro-batch overwrites its own folder, so results are exactly once. Readers take the
copy of each document that landed last (of equals, the last version by name) and the chunks of that version. ``compact``
leaves one version of everything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from marginalia.operators.chunking import CHUNK_SIZE, OVERLAP, chunk_documents
from marginalia.session import settle, stored
from marginalia.sources import catalog

LANDED = ("source_id string, title string, abstract string, full_text string, "
          "section_offsets array<struct<section:string,char_start:int,char_end:int>>, landed_at timestamp")


# Bitmaps that go to every task: 32 MB.
MAPS = 8192


def first_arrivals(landed_ids: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each landed id once, however often it comes within the delay."""
    return landed_ids.withWatermark("landed_at", delay).dropDuplicatesWithinWatermark(["source_id"])


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a stream keeps in its checkpoint; a new checkpoint is another stream."""
    return spark.read.schema("id string").json(f"{checkpoint}/metadata").first()["id"]


def write_version(landed: DataFrame, out_dir: str, stream: str, epoch: int, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> None:
    """Stores one batch of documents and their chunks; the newest copy of a repeated document counts."""
    _write_version(landed, out_dir, f"{stream}-{epoch:012d}", size, overlap)


def _write_version(landed: DataFrame, out_dir: str, version: str, size: int, overlap: int) -> None:
    spark, pending = landed.sparkSession, f"{out_dir}/pending/{version}"
    # source ids are numeric and unique, so they serve as document ids without a counter
    docs = _put(landed.withColumn("document_id", F.col("source_id").cast("long")), f"{pending}/all")
    # the batch is computed once, and texts are shuffled only where an id comes twice
    if not docs.groupBy("source_id").count().where("count > 1").isEmpty():
        newest = docs.groupBy("source_id").agg(F.max_by(F.struct(*[c for c in docs.columns if c != "source_id"]),
                                                        F.struct("landed_at", "full_text")).alias("r"))
        docs, at = _put(newest.select("source_id", "r.*"), f"{pending}/newest"), f"{pending}/newest"
    else:
        at = f"{pending}/all"
    _put(chunk_documents(docs, size, overlap), f"{out_dir}/chunks/version={version}")
    # documents last: chunks of a version without its documents are not visible
    files, target = catalog.files_at(spark, f"{out_dir}/documents/version={version}")
    files.mkdirs(target.getParent())
    files.delete(target, True)
    source = catalog.files_at(spark, at)[1]
    if not files.rename(source, target):
        raise OSError(f"{at} could not be moved to {target}")
    files.delete(catalog.files_at(spark, pending)[1], True)


def _put(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def start_ingest(landed: DataFrame, out_dir: str, checkpoint: str, size: int = CHUNK_SIZE,
                 overlap: int = OVERLAP, available_now: bool = True) -> StreamingQuery:
    """Ingests a stream of landed rows, or of the places of such rows (``places``), whose texts each batch then fetches."""
    def batch(df: DataFrame, epoch: int) -> None:
        version = f"{stream_id(df.sparkSession, checkpoint)}-{epoch:012d}"
        _write_version(_fetched(df, f"{out_dir}/pending/{version}/places") if "file" in df.columns else df, out_dir, version, size, overlap)

    writer = landed.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def places(landed: DataFrame) -> DataFrame:
    """Landed Parquet rows without texts: (source_id, landed_at, file, row), for operators that would shuffle the texts."""
    return landed.select("source_id", "landed_at", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def _fetched(at: DataFrame, path: str) -> DataFrame:
    """The landed rows at the given places."""
    spark, at = at.sparkSession, _put(at, path)
    files = [r["file"] for r in at.select("file").distinct().collect()]
    if not files:
        return spark.createDataFrame([], LANDED)
    rows = spark.read.schema(LANDED).parquet(*files).select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return listed(rows, at, "file", "row").drop("file", "row")


def listed(rows: DataFrame, wanted: DataFrame, group: str, number: str) -> DataFrame:
    """Rows whose (group, number) is in ``wanted``; ``number`` is a long.

    The numbers travel as bitmaps of 32,768 bits. Up to ``MAPS`` of them go to every task, so that no row is shuffled; numbers
    that lie too far apart for that are joined.
    """
    bucket = F.bitmap_bucket_number(number).alias("__bucket")
    bits = settle(wanted.where(F.col(number).isNotNull()).groupBy(group, bucket).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("__bits")))
    if bits.count() > MAPS:
        return rows.join(wanted.select(group, number).distinct(), [group, number], "left_semi")
    bit = F.bitmap_bit_position(number)
    byte = F.conv(F.hex(F.substr("__bits", F.expr(f"cast(bitmap_bit_position({number}) div 8 + 1 as int)"), F.lit(1))), 16, 10).cast("int")
    return rows.withColumn("__bucket", F.bitmap_bucket_number(number)).join(F.broadcast(bits), [group, "__bucket"]) \
        .where(F.getbit(byte, (bit % 8).cast("int")) == 1).select(rows.columns)


def _newest(spark: SparkSession, out_dir: str) -> DataFrame:
    """(document_id, version) of the copy of each document that landed last."""
    return spark.read.parquet(f"{out_dir}/documents").groupBy("document_id").agg(
        F.max_by("version", F.struct("landed_at", "version")).alias("version"))


def current_documents(spark: SparkSession, out_dir: str) -> DataFrame:
    """Newest version of each document. Texts are fetched only for the winners."""
    return spark.read.parquet(f"{out_dir}/documents").join(_newest(spark, out_dir), ["document_id", "version"])


def current_chunks(spark: SparkSession, out_dir: str) -> DataFrame:
    return spark.read.parquet(f"{out_dir}/chunks").join(_newest(spark, out_dir), ["document_id", "version"])


def compact(spark: SparkSession, out_dir: str, target: str) -> None:
    """Writes what readers of ``out_dir`` see as the single version of ``target``, which streams may then go on with.

    Versions of which nothing counts any more stay unread, and those that count whole are copied; only rows of the others
    are compared with the documents that count.
    """
    newest = stored(_newest(spark, out_dir).where("document_id is not null"), "newest")
    won = newest.groupBy("version").agg(F.count(F.lit(1)).alias("won"))
    sizes = spark.read.parquet(f"{out_dir}/documents").groupBy("version").agg(F.count(F.lit(1)).alias("n"))
    counts = sizes.join(won, "version").collect()
    whole, mixed = ([r["version"] for r in counts if (r["n"] == r["won"]) == w] for w in (True, False))
    mine = newest.where(F.col("version").isin(mixed))

    def current(table: str) -> DataFrame:
        rows = spark.read.parquet(f"{out_dir}/{table}")
        some = rows.where(F.col("version").isin(whole))
        return (some.unionByName(listed(rows.where(F.col("version").isin(mixed)), mine, "version", "document_id")) if mixed else some).drop("version")

    _put(current("chunks"), f"{target}/chunks/version=0-compacted")
    _put(current("documents"), f"{target}/documents/version=0-compacted")
