"""N-gram Jaccard join with adaptive multi-match prefixes: classes of texts linked by shingle sets alike to a threshold.

Texts of equal shingle sets are one node. Sets are ordered by one global order, rarest shingle first. Two sets that are
alike enough share a shingle within their prefixes; with prefixes longer by l - 1, they share at least l. Each document
picks its l by estimated cost: the lists its prefix meets, plus the candidates that may come through, which fall with l.

Steps, each exact:

1. A share of all shingles, cut by hash, is counted over the whole corpus. A text with as many unique shingles in this share
   as its prefix is long has no partner, as some global order puts unique shingles first. Nearly all texts end here.
2. The sets of the others are counted in full; shingles of two or more of them make the prefix lists. A set with too few of
   them to reach any partner goes.
3. Every list links its members to one hub, where they are alike. Members of one component need no further comparison, and
   lists within one component go. Lists that are still open get new hubs, from among the members outside their main
   component, round after round, until few pairs are left in them or a round joins little. So a group of thousands of near copies doesn't expand into pairs.
4. Pairs of different components that share at least l prefix shingles, have lengths, shared shingles and bitmaps (parities
   of hashed shingles, a bound on the difference) that allow enough overlap, are verified on their sets.

Lists and components only ever meet joins that adaptive execution can split, and aggregates that combine first. Lists carry
no sets and no bitmaps; these are joined to the open lists, and to pairs, by node.

Shingles are compared by 64-bit hashes. Defined results: texts that are null or have no words have no shingles and are
linked with nothing, so their component is their own id; texts of fewer words than a shingle are one shingle; rows that
repeat an id are documents of their own; a null id takes part and names no component; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm import words as W
from marginalia.llm.batches import over_rows
from marginalia.llm.components import components
from marginalia.session import settle, stored


class Settings(NamedTuple):
    shingle: int = 3
    percent: int = 90  # least intersection of a link, in percent of the union
    most_matches: int = 3  # largest l
    verify_cost: float = 8.0  # of one candidate, in list entries
    hubs: int = 4  # new hubs of an open list in each round after the first
    patience: float = 32.0  # pairs inside open lists, for each of their entries, up to which no new hubs are tried
    worth: float = 0.05  # share of the open nodes that a round must join to be followed by another
    lookback: int = 16  # earlier shingles of its own that an entry of an open list knows, to tell pairs that met before
    broadcast_texts: int = 500_000  # ids of texts that may have partners are broadcast up to this count


BITMAP_WORDS = 16  # 64-bit words of a bitmap


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted different shingle hashes of a text."""
    raw = W.utf8(text, fold=True)
    starts, ends = W.bounds(raw)
    hashes = W.word_hashes(raw, starts, ends)
    return np.unique(W.gram_hashes(hashes, min(size, len(hashes)))) if len(hashes) else hashes


def node_of(found: np.ndarray) -> int | None:
    """64-bit name of a shingle set."""
    return int.from_bytes(hashlib.md5(found.tobytes()).digest()[:8], "little", signed=True) if len(found) else None


def bitmap(found: np.ndarray) -> list[int]:
    """Parity of the shingles in each of the bits; bits that differ are at most the shingles that do."""
    shift = np.uint64(64 - 6 - (BITMAP_WORDS - 1).bit_length())
    counts = np.bincount((found >> shift).astype(np.int64), minlength=64 * BITMAP_WORDS) & 1
    return np.packbits(counts.astype(np.uint8), bitorder="little").view(np.int64).tolist()


def _need(n: Column, s: Settings) -> Column:
    """Least overlap of a set of ``n`` shingles with any partner."""
    return F.ceil(n * s.percent / 100).cast("long")


def _alike(overlap: Column, n: Column, m: Column, s: Settings) -> Column:
    return 100 * overlap >= s.percent * (n + m - overlap)


def _may_link(x: str, y: str, s: Settings) -> Column:
    """Filters on two sets by length, by shingles that others have too, and by bitmap."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    differ = sum((F.bit_count(F.col(f"{x}.bits")[i].bitwiseXOR(F.col(f"{y}.bits")[i])) for i in range(BITMAP_WORDS)), F.lit(0))
    # the overlap is at least percent of (n + m) / (100 + percent), and at most what both share with any set at all;
    # it is (n + m - difference) / 2
    shared = (100 + s.percent) * F.least(F.col(f"{x}.shared"), F.col(f"{y}.shared")) >= s.percent * (n + m)
    return (100 * F.least(n, m) >= s.percent * F.greatest(n, m)) & shared \
        & ((100 + s.percent) * (n + m - differ) >= 2 * s.percent * (n + m))


def summaries(docs: DataFrame, s: Settings, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(doc_id, n_shingles, node, sampled): sampled holds the shingles in the counted share of the hash range."""
    share = min(1.0, 1 - s.percent / 100 + 0.1)
    cut = np.uint64(int(share * 2 ** 64) - 1 if share < 1 else 2 ** 64 - 1)

    def work():
        def told(text: str | None) -> tuple:
            found = shingles(text, s.shingle)
            return len(found), node_of(found), found[:np.searchsorted(found, cut)].view(np.int64)
        return told

    return over_rows(docs, keep, ["text"], "n_shingles long, node long, sampled array<bigint>", work)


def with_partners(told: DataFrame, s: Settings) -> DataFrame:
    """(node, doc_id): nodes that may have a partner, each with one document to read its text from."""
    token = told.where("node is not null").select("node", F.explode("sampled").alias("token"))
    unique = token.groupBy("token").agg(F.min("node").alias("node"), F.max("node").alias("other")).where("node = other")
    unique = unique.groupBy("node").agg(F.count(F.lit(1)).alias("unique"))
    nodes = told.where("node is not null").groupBy("node").agg(F.min("n_shingles").alias("n"), F.min("doc_id").alias("doc_id"))
    prefix = F.col("n") - _need(F.col("n"), s) + 1
    return nodes.join(unique, "node", "left").where(F.coalesce("unique", F.lit(0)) < prefix).select("node", "doc_id")


def sets_of(docs: DataFrame, chosen: DataFrame, s: Settings) -> DataFrame:
    """(node, n, bits, found) of chosen nodes, read again from their texts."""
    ids = chosen.select("doc_id").distinct()
    if ids.count() <= s.broadcast_texts:
        ids = F.broadcast(ids)
    texts = docs.select("doc_id", "text").join(ids, docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")

    def work():
        def told(text: str | None) -> tuple:
            found = shingles(text, s.shingle)
            return node_of(found), len(found), bitmap(found), found.view(np.int64)
        return told

    read = over_rows(texts, ["doc_id"], ["text"], "node long, n long, bits array<bigint>, found array<bigint>", work)
    read = read.join(chosen.select("node").distinct(), "node", "left_semi")
    return read.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "bits", "found")])


def entries(sets: DataFrame, s: Settings) -> DataFrame:
    """(token, node, shared, own, rank, level, matches): prefix lists, without shingles that one set alone holds.

    ``shared`` counts the set's shingles that others hold too, ``own`` those that none holds, ``rank`` is the shingle's place
    among the shared ones, ``level`` the smallest l whose prefix holds it, ``matches`` the l that the document asks of its
    partners.
    """
    token = sets.select("node", "n", F.explode("found").alias("token"))
    several = token.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    told = token.join(several, "token")
    by_rarity = Window.partitionBy("node").orderBy("df", "token")
    whole = Window.partitionBy("node")
    told = told.withColumn("shared", F.count(F.lit(1)).over(whole)).withColumn("rank", F.row_number().over(by_rarity))
    told = told.where(F.col("shared") >= _need(F.col("n"), s))
    told = told.withColumn("own", (F.col("n") - F.col("shared")).cast("int"))
    place = F.col("own") + F.col("rank")  # from 1; unique ones come first
    prefix = F.col("n") - _need(F.col("n"), s) + 1
    told = told.withColumn("level", F.greatest(F.lit(1), place - prefix + 1).cast("int"))
    told = told.where(F.col("level") <= s.most_matches)
    # lists met by the prefix for each l, and the candidates that can have l entries in them
    costs = []
    for k in range(1, s.most_matches + 1):
        met = F.sum(F.when(F.col("level") <= k, F.col("df") - 1).otherwise(0)).over(whole)
        costs.append(F.when(F.lit(k) <= _need(F.col("n"), s), F.struct((met + s.verify_cost * met / k).alias("cost"), F.lit(k).alias("k"))))
    return told.withColumn("matches", F.least(*costs)["k"]).select("token", "node", "shared", "own", "rank", "level", "matches")


def _verified(pairs: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    """The rows of pairs (a, b, ...) whose sets are alike."""
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("n"), F.col("found").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("found").alias("y"))
    overlap = F.size(F.array_intersect("x", "y"))
    return pairs.join(left, "a").join(right, "b").where(_alike(overlap, F.col("n"), F.col("m"), s)).select(*pairs.columns)


def _plausible(pairs: DataFrame, marks: DataFrame, s: Settings) -> DataFrame:
    """The rows of pairs (a, b, ...) that the filters on two sets let through."""
    return pairs.join(marks.alias("x"), F.col("a") == F.col("x.node")).join(marks.alias("y"), F.col("b") == F.col("y.node")) \
        .where(_may_link("x", "y", s)).select(*pairs.columns)


def stars(lists: DataFrame, turn: int, s: Settings) -> DataFrame:
    """Pairs (a, b, c, d) of nodes and their components, one side a hub of a list in which both stand at level 1.

    In the first turn a list has one hub; later it has several, from outside of the component that most members are in.
    Hubs of the first two turns are the members with fewest shingles of their own, as these lie nearest to what a family of
    copies has in common; later ones come by hash.
    """
    first = lists.where("level = 1").select("token", "node", "component", "own")
    if turn == 0:
        hubs = first.groupBy("token").agg(F.min(F.struct("own", "node", "component")).alias("hub"))
    else:
        most = first.groupBy("token", "component").agg(F.count(F.lit(1)).alias("members")) \
            .groupBy("token").agg(F.max(F.struct("members", "component")).alias("most"))
        outside = first.join(most, "token").where("component <> most.component")
        mixed = F.xxhash64("node", F.lit(turn))
        hubs = outside.groupBy("token", F.pmod(mixed, F.lit(s.hubs)).alias("seat")) \
            .agg(F.min(F.struct(*(["own"] if turn == 1 else []), mixed, "node", "component")).alias("hub"))
    met = first.join(hubs.select("token", "hub"), "token").where("component <> hub.component")
    # one order of the two, so that a pair comes once
    swap = F.col("node") > F.col("hub.node")
    return met.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b"),
                      F.when(swap, F.col("hub.component")).otherwise(F.col("component")).alias("c"),
                      F.when(swap, F.col("component")).otherwise(F.col("hub.component")).alias("d")).distinct()


def _renamed(df: DataFrame, found: DataFrame) -> DataFrame:
    """``df`` with its ``component`` replaced where ``found`` (node, component) names it."""
    names = found.select(F.col("node").alias("component"), F.col("component").alias("top"))
    return df.join(names, "component", "left").withColumn("component", F.coalesce("top", "component")).drop("top")


def _still_open(lists: DataFrame) -> DataFrame:
    """The lists that hold members of several components."""
    extent = lists.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
    return lists.join(extent.select("token"), "token", "left_semi")


def _size(lists: DataFrame) -> tuple[int, float]:
    """Entries of open lists, and pairs of members of different components in them."""
    own = F.col("members").cast("double")
    each = lists.groupBy("token", "component").agg(F.count(F.lit(1)).alias("members")) \
        .groupBy("token").agg(F.sum("members").alias("members"), F.sum(own * own).alias("within"))
    row = each.agg(F.sum("members").alias("entries"), F.sum(own * own - F.col("within")).alias("pairs")).first()
    return row["entries"] or 0, (row["pairs"] or 0.0) / 2


def hits(lists: DataFrame, marks: DataFrame, s: Settings) -> DataFrame:
    """(a, b, c, d, matches) for shingles that two nodes of different components share in the open lists, if they may be alike.

    A pair comes as often as it shares shingles, but no more often than it has to where it meets in list after list.
    """
    main = lists.groupBy("token", "component").agg(F.count(F.lit(1)).alias("members")) \
        .groupBy("token").agg(F.max(F.struct("members", "component"))["component"].alias("main"))
    before = Window.partitionBy("node").orderBy("rank").rowsBetween(-s.lookback, -1)
    named = stored(lists.join(main, "token").withColumn("inside", F.col("component") == F.col("main")).drop("main")
                   .withColumn("earlier", F.collect_list("token").over(before)).join(marks, "node"), "open-lists")
    # the larger of two sets asks for its number of matches; lists inside one component are not compared again
    probe = named.where(F.col("level") <= F.col("matches"))
    above = F.struct("x.n", "x.node") > F.struct("y.n", "y.node")
    # all lists hold one order, by rank, in which levels only rise: shingles in what both know as earlier are hits of this
    # pair, in other lists; with enough of them, one more says nothing new
    met_before = F.size(F.array_intersect("x.earlier", "y.earlier")) >= F.col("x.matches")
    fits = above & (F.col("x.component") != F.col("y.component")) & (F.col("y.level") <= F.col("x.matches")) \
        & _may_link("x", "y", s) & ~met_before
    met = None
    for x, y in ((probe.where("not inside"), named), (probe.where("inside"), named.where("not inside"))):
        part = x.alias("x").join(y.alias("y"), (F.col("x.token") == F.col("y.token")) & fits) \
            .select(*[F.col(f"{side}.{c}").alias(name) for side, c, name in (
                ("x", "node", "a"), ("y", "node", "b"), ("x", "component", "c"), ("y", "component", "d"), ("x", "matches", "matches"))])
        met = part if met is None else met.unionByName(part)
    return met


def candidates(lists: DataFrame, marks: DataFrame, s: Settings) -> DataFrame:
    """Pairs (a, b, c, d) of nodes of different components that may be alike, by hits in the open lists."""
    return hits(lists, marks, s).groupBy("a", "b", "c", "d", "matches").agg(F.count(F.lit(1)).alias("hits")).where("hits >= matches") \
        .select("a", "b", "c", "d")


def joined_nodes(sets: DataFrame, s: Settings) -> DataFrame:
    """(node, component) of the nodes that stand in lists."""
    found = stored(entries(sets, s), "prefix-lists")
    facts = found.groupBy("node").agg(F.first("shared").alias("shared"), F.first("matches").alias("matches"))
    marks = stored(facts.join(sets.select("node", "n", "bits"), "node"), "marks")
    lists = found.select("token", "node", "own", "rank", "level", F.col("node").alias("component"))
    named = marks.select("node", F.col("node").alias("component"))
    turn = gone = 0
    while True:
        pairs = _plausible(stars(lists, turn, s), marks, s)
        linked = settle(_verified(pairs, sets, s).select(F.col("c").alias("a"), F.col("d").alias("b")).distinct())
        changed = settle(components(linked))  # the components found so far are its nodes
        gone = changed.where("node <> component").count()
        if gone:
            named = settle(_renamed(named, changed))
        if gone or turn == 0:
            lists = stored(_still_open(_renamed(lists, changed)), "open-lists")
        entries_left, pairs_left = _size(lists)
        if pairs_left <= s.patience * entries_left or gone <= s.worth * lists.select("component").distinct().count():
            break
        turn += 1
    last = settle(components(_verified(candidates(lists, marks, s), sets, s).select(F.col("c").alias("a"), F.col("d").alias("b"))))
    return _renamed(named, last)


def _classed(docs: DataFrame, s: Settings, keep: Sequence[str]) -> DataFrame:
    """Columns ``keep`` of every row, n_shingles and component (null without shingles)."""
    told = settle(summaries(docs, s, keep))
    chosen = settle(with_partners(told, s))
    sets = settle(sets_of(docs, chosen, s))
    joined = settle(joined_nodes(sets, s))
    told = told.select(*keep, "n_shingles", "node").join(joined, "node", "left")
    return told.select(*keep, "n_shingles", F.coalesce("component", "node").alias("component"))


def classes(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of (doc_id, text)."""
    told = _classed(docs, settings, ["doc_id"])
    smallest = told.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("smallest"))
    return told.join(smallest, "component", "left") \
        .select("doc_id", "n_shingles", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("smallest"))
                .alias("component_id"))


def one_of_each(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs``, all columns, that head their class: the smallest id, and of its texts the one with the smallest digest.

    Rows without shingles stay. Equal rows of one id and text count once.
    """
    told = _classed(docs.select("doc_id", "text", F.md5("text").alias("digest")), settings, ["doc_id", "digest"])
    head = told.where("component is not null").groupBy("component") \
        .agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest")).alias("head"))
    alone = told.where("component is null").select("doc_id", "digest").distinct()
    heads = head.select("head.doc_id", "head.digest").unionByName(alone).select(F.col("doc_id").alias("id"), "digest")
    mark = "digest"
    while mark in docs.columns:
        mark += "_"
    rows = docs.withColumn(mark, F.md5("text"))
    kept = rows.join(heads, rows["doc_id"].eqNullSafe(heads["id"]) & rows[mark].eqNullSafe(heads["digest"]), "left_semi")
    return kept.dropDuplicates(["doc_id", mark]).drop(mark)
