"""Inserts, upserts and status changes on keyed tables.

Parquet has no MERGE: each operator returns the new content of the table, to be written beside the old
one (see ``sources.writers.replace_table``). Inputs are reduced to one row per key before the join, so a
key repeated a million times in a load file meets the join once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from marginalia.operators.ordinals import hash_levels, ordinal


def one_per_key(df: DataFrame, keys: Sequence[str], order: Column | None = None) -> DataFrame:
    """One row per key: the last by ``order``, and among equals the greatest by all columns, so that reruns agree."""
    others = [c for c in df.columns if c not in keys]
    if not others:
        return df.distinct()
    ranked = F.struct(*([order] if order is not None else []), *others)
    last = df.groupBy(*keys).agg(F.max_by(F.struct(*others), ranked).alias("__row"))
    return last.select(*keys, "__row.*").select(*df.columns)


def insert_ignore(table: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds rows whose key is not there; existing rows stay as they are."""
    return table.unionByName(new_rows(table, new, keys), allowMissingColumns=True)


def new_rows(table: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The change set of ``insert_ignore`` (what a dry run reports)."""
    return one_per_key(new, list(keys)).join(table.select(*keys), list(keys), "left_anti")


def insert_or_set(table: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Adds new keys; on conflict replaces only ``columns``. Of new rows with one key, ``one_per_key`` keeps one."""
    keys, incoming = list(keys), one_per_key(new, list(keys))
    fresh = incoming.select(*keys, F.struct(*[c for c in incoming.columns if c not in keys]).alias("__new"))
    old = table.withColumn("__old", F.lit(True))
    joined = old.join(fresh, keys, "full_outer")
    has_new = set(incoming.columns)

    def value(name: str) -> Column:
        if name in keys:
            return F.col(name)
        if name not in has_new:
            return F.col(name)
        if name in columns:
            return F.when(F.col("__new").isNotNull(), F.col(f"__new.{name}")).otherwise(F.col(name)).alias(name)
        return F.when(F.col("__old").isNull(), F.col(f"__new.{name}")).otherwise(F.col(name)).alias(name)

    return joined.select(*[value(c) for c in table.columns])


def upsert_documents(docs: DataFrame, incoming: DataFrame, default_priority: int = 50, order: str | None = None) -> DataFrame:
    """Documents by (source, source_id): content, metadata and status are replaced, id, priority and creation time kept.

    Of incoming rows with one key the last by the column ``order`` counts.

    New documents get ids after the highest one, in md5 order of their key, without a global sort.
    """
    keys = ["source", "source_id"]
    fresh = one_per_key(incoming, keys, F.col(order) if order else None)
    fresh = fresh.drop(order) if order else fresh
    added = fresh.join(docs.select(*keys), keys, "left_anti")
    label = F.concat_ws("|", *keys)
    highest = docs.agg(F.coalesce(F.max("document_id"), F.lit(0)).alias("m")).scalar()
    added = ordinal(added, [], hash_levels(label), [F.md5(label), label], "__n", 1) \
        .withColumn("document_id", highest + F.col("__n")).drop("__n") \
        .withColumn("priority", F.lit(default_priority)) \
        .withColumn("ingestion_status", F.lit("fetched"))
    replaced = [c for c in fresh.columns if c not in keys and c in docs.columns]
    kept = docs.join(fresh.select(*keys, F.struct(*replaced).alias("__new")), keys, "left")
    changed = kept.select(*[
        F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) if c in replaced
        else F.when(F.col("__new").isNotNull(), F.lit("fetched")).otherwise(F.col(c)).alias(c)
        if c == "ingestion_status" else F.col(c)
        for c in docs.columns
    ])
    return changed.unionByName(added, allowMissingColumns=True)


def replace_children(children: DataFrame, new: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Drops all children of the processed parents, then adds the new ones."""
    return children.join(parents.select(key).distinct(), key, "left_anti") \
        .unionByName(new, allowMissingColumns=True)


def set_where_listed(table: DataFrame, ids: DataFrame, key: str, values: Mapping[str, Column | str | int]) -> DataFrame:
    """Sets columns on the rows whose key is in ``ids``."""
    flag = ids.select(key).distinct().withColumn("__hit", F.lit(True))
    joined = table.join(flag, key, "left")
    return joined.select(*[
        F.when(F.col("__hit"), values[c] if isinstance(values[c], Column) else F.lit(values[c]))
        .otherwise(F.col(c)).alias(c) if c in values else F.col(c)
        for c in table.columns
    ])


def missing(ids: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Distinct ids that ``known`` does not have."""
    return ids.select(key).distinct().join(known.select(key), key, "left_anti")


def difference_report(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of only one side, with the side's name."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, list(keys), "left_anti").withColumn("side", F.lit("left")).unionByName(
        b.join(a, list(keys), "left_anti").withColumn("side", F.lit("right")))
