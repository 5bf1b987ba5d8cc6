"""Grouped prefix join: which documents' sets of word shingles have a Jaccard similarity of at least four fifths.

A document's shingles are ordered by a fixed global order: by hash, but shingles found in many documents last. Two sets that reach
the threshold share a shingle among the first n - ceil(0.8 n) + 1 of each (n: its own size), its prefix. Sets with the same prefix
and size form one group, and groups that share a prefix shingle are compared, filtered by size and by how much of their prefixes they share, then
expanded to their member sets, which are verified by counting. As classes are asked for, a pair is left out only if its two
sets are in one class already:

1. each group's members, and in each shingle's list the neighbouring groups, are verified as a chain (a large group's as chains of
   about CHAIN_ROWS), and each group with the group of the list that has most in common with others, as a star; classes are formed
   of what is linked;
2. of every shingle whose list still spans classes, the groups outside its commonest class are paired with the whole list; and so
   are, of a group that spans classes, its members outside its commonest class with its other classes.

The order may be any order for the result to be whole; it only keeps lists short. All shingles of all documents are counted (by the
top half of their hash), those found HOT_LEAST times come after the others, by the power of two of their count, and at most HOT_MOST
of the commonest are told apart, which bounds what is broadcast.

Sets are told apart by 128 bits. Groups have 64: groups that share an id by chance are compared as one, which only adds pairs to verify.

Defined results: a null or empty text has an empty set, is linked with nothing and is a class of its own; texts of fewer words than
a shingle have their whole sequence as one; very long texts are read in whole, in pieces, and their sets held one at a time; rows that
repeat a doc_id are each linked by their own text; a null doc_id never gives a class its id while another member has one; an empty
table gives no rows. Ties of the order of shingles go by hash, which no result depends on. Columns other than doc_id and text are
carried along by `keep_one`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from waylark.llm.common import SPACE, blocks, digests, grams, mix, row_grams, settled, signed, small_batches, staged, unused, word_hashes

WORDS = 5
HOT_LEAST = 16
HOT_MOST = 1 << 18
#: Of each so many shingles of a pair's smaller set, one more match is asked for near the start of their prefixes.
MATCHES = 128
#: Sets of a group that are verified as one chain, about.
CHAIN_ROWS = 256
#: Shingles that a task adds up at once (64 MB).
COUNTED = 1 << 23
#: Ids of documents that are broadcast at most (8 MB); more are joined by a shuffle.
BROADCAST_MOST = 1_000_000
_TOP = np.uint64(32)


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """Each row's distinct shingles, by hash, ascending."""
    hashes, offsets = word_hashes(column, SPACE)
    g, rows, _ = row_grams(hashes, offsets, WORDS)
    bounds = np.searchsorted(rows, np.arange(len(offsets)))
    n = np.diff(offsets)
    out = []
    for i in range(len(n)):
        if n[i] >= WORDS:
            out.append(np.unique(g[bounds[i] : bounds[i + 1]]))
        else:
            out.append(grams(hashes[offsets[i] : offsets[i + 1]], int(n[i])) if n[i] else g[:0])
    return out


def _two(x: np.ndarray) -> tuple[int, int]:
    """Two 64-bit digests of a set or list in its order."""
    a = x * np.uint64(0x9E3779B97F4A7C15)
    return int(mix(x ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)) ^ len(x), int(mix(a).sum(dtype=np.uint64))


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The top halves of all shingles' hashes and their number, repeats in a document included, added up over COUNTED of them."""
    held, n = [], 0

    def told() -> pa.RecordBatch:
        top, count = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(top.view(np.int32)), pa.array(count)], ["top", "n"])

    for batch in batches:
        for part in blocks(batch, "text"):
            held.append((row_grams(*word_hashes(part.column("text"), SPACE), WORDS)[0] >> _TOP).astype(np.uint32))
            n += len(held[-1])
            if n >= COUNTED:
                yield told()
                held, n = [], 0
    if held:
        yield told()


def _prefixes(hot):
    """Per row: n_shingles, set_id, group_id, and the prefix in order, the last only at the group's first row in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (common, power), seen = hot.value, {}
        for batch in batches:
            for part in blocks(batch, "text"):
                sets = shingle_sets(part.column("text"))
                n = np.fromiter(map(len, sets), np.int64, len(sets))
                high, low = np.zeros((2, len(sets)), np.uint64)
                group, prefixes = np.zeros(len(sets), np.uint64), []
                for i, s in enumerate(sets):
                    if not len(s):
                        prefixes.append(None)
                        continue
                    high[i], low[i] = _two(s)
                    length = len(s) - (4 * len(s) + 4) // 5 + 1
                    top = s >> _TOP
                    if len(common):
                        at = np.minimum(np.searchsorted(common, top), len(common) - 1)
                        rank = np.where(common[at] == top, power[at], np.uint8(0))
                        if rank.any():
                            s = s[np.argsort(rank, kind="stable")]
                    prefix = s[:length]
                    a, b = _two(prefix)
                    group[i] = mix(np.array([a ^ (b >> 1) ^ (len(s) << 20)], np.uint64))[0]
                    key = int(group[i])
                    prefixes.append(None if seen.get(key) == b else prefix.view(np.int64))  # another prefix of the same id is told too
                    seen[key] = b
                    if len(seen) > 500_000:
                        seen.clear()
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), digests(high, low), signed(group), pa.array(prefixes, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "set_id", "group_id", "prefix"])

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (shingle, n, group_id, place), sorted by the first three: one per group, where a shingle has more than one; with the group before."""
    names = ["shingle", "n", "group_id", "place"]
    last: tuple | None = None  # the last row so far, and whether it was told
    told, before = True, None

    def out(rows: list[np.ndarray], of: np.ndarray, n_before: np.ndarray, none: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array(x) for x in rows), pa.array(of, mask=none), pa.array(n_before, mask=none)], [*names, "before_id", "before_n"])

    for batch in batches:
        cols = [batch.column(c).to_numpy() for c in names]
        if not len(cols[0]):
            continue
        if last is not None:
            cols = [np.append(np.array([x], c.dtype), c) for x, c in zip(last, cols, strict=True)]
        new = np.append(True, (cols[0][1:] != cols[0][:-1]) | (cols[2][1:] != cols[2][:-1]) | (cols[1][1:] != cols[1][:-1]))
        cols = [c[new] for c in cols]
        same = np.append(False, cols[0][1:] == cols[0][:-1])
        tell = same | np.append(same[1:], False)
        prev, prev_n, none = np.append(0, cols[2][:-1]), np.append(0, cols[1][:-1]), ~same
        if last is not None:  # row 0 is the row of before
            tell[0] &= not told
            if before is not None:
                prev[0], prev_n[0], none[0] = before[0], before[1], False
        end = len(cols[0]) - 1
        told = bool(tell[end]) or (end == 0 and told and last is not None)
        before = (int(prev[end]), int(prev_n[end])) if not none[end] else None
        last = tuple(c[end] for c in cols)
        if tell.any():
            yield out([c[tell] for c in cols], prev[tell].astype(np.int64), prev_n[tell].astype(np.int32), none[tell])


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in blocks(batch, "text"):
            sets = shingle_sets(part.column("text"))
            two = np.array([_two(s) if len(s) else (0, 0) for s in sets], np.uint64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([digests(two[:, 0], two[:, 1]), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["set_id", "shingles"])


def components(links: DataFrame) -> DataFrame:
    """node, root (the least node of its component) of every node of links (a, b), by large-star and small-star steps."""
    star = lambda m, e: e.join(m, "u")
    edges = staged(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "star")
    known = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = staged(star(least, both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        edges = staged(star(least, large).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct(), "star")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()  # edges are distinct; unlike a sum, this has no bound
        if known == now:
            break
        known = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())


def verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """Of pairs (a, b) of set ids those that reach the threshold."""
    wanted = pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).distinct()
    wanted = staged(sets.join(wanted, "set_id").select(F.col("doc").alias("__doc")).distinct(), "wanted")
    if wanted.count() <= BROADCAST_MOST:
        wanted = F.broadcast(wanted)
    texts = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("__doc")), "left_semi").select("text")
    held = staged(texts.mapInArrow(_tokens, "set_id binary, shingles array<long>"), "shingles")
    one = lambda x: held.select(F.col("set_id").alias(x), F.col("shingles").alias(f"s{x}"))
    both = F.size(F.array_intersect("sa", "sb"))
    return staged(pairs.join(one("a"), "a").join(one("b"), "b").where(100 * both >= 80 * (F.size("sa") + F.size("sb") - both)).select("a", "b").distinct(), "links")


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, set_id of every document; set_id, root, component_id of every set that isn't empty)."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text")
    hot = docs.select("text").mapInArrow(_tops, "top int, n long").groupBy("top").agg(F.sum("n").alias("count")).where(F.col("count") >= HOT_LEAST)
    hot = hot.orderBy(F.desc("count"), "top").limit(HOT_MOST).toArrow()
    top, count = hot["top"].to_numpy().view(np.uint32).astype(np.uint64), hot["count"].to_numpy()
    by = np.argsort(top)
    hot = spark.sparkContext.broadcast((top[by], np.log2(np.maximum(count[by], 1)).astype(np.uint8)))
    each = staged(docs.mapInArrow(_prefixes(hot), "doc_id long, n_shingles long, set_id binary, group_id long, prefix array<long>"), "prefixes")
    told = each.where("n_shingles > 0")
    sets = staged(told.groupBy("set_id").agg(F.min("doc_id").alias("doc"), F.min("group_id").alias("group_id"), F.min("n_shingles").cast("int").alias("n")), "sets")

    lists = told.where("prefix is not null").select(F.col("n_shingles").cast("int").alias("n"), "group_id", F.posexplode("prefix").alias("place", "shingle"))
    lists = lists.select("shingle", "n", "group_id", "place").repartition("shingle").sortWithinPartitions("shingle", "n", "group_id", "place")
    lists = staged(lists.mapInArrow(_shared, "shingle long, n int, group_id long, place int, before_id long, before_n int"), "lists")

    # 1. chains and stars: neighbours in a shingle's list and its heaviest group, by their groups' first sets; members of a group
    first = staged(sets.groupBy("group_id").agg(F.min("set_id").alias("first"), F.count("*").alias("sets")), "group-heads")
    near = lists.where("before_id is not null and 5 * before_n >= 4 * n").groupBy(F.col("before_id").alias("g"), F.col("group_id").alias("h"), "n").agg(F.count("*").alias("c"))
    near = near.where("40 * c >= n").select("g", "h")  # neighbours in an eighth of their prefixes: only to find most links soon
    size = staged(lists.groupBy("shingle").agg(F.count("*").alias("size")), "list-sizes")
    weight = lists.join(size, "shingle").groupBy("group_id").agg(F.sum("size").alias("weight"))
    heavy = staged(lists.join(weight, "group_id").groupBy("shingle").agg(F.max_by(F.struct("group_id", "n"), F.struct("weight", "group_id")).alias("h")), "list-heads")
    to_head = lists.join(heavy, "shingle").where("group_id <> h.group_id and 5 * n >= 4 * h.n and 5 * h.n >= 4 * n").groupBy("group_id", F.col("h.group_id").alias("h"), "n").agg(F.count("*").alias("c"))
    near = near.union(to_head.where("40 * c >= n").select(F.col("group_id").alias("g"), "h")).select(F.least("g", "h").alias("g"), F.greatest("g", "h").alias("h")).distinct()
    head = first.select("group_id", "first")
    near = near.join(head.toDF("g", "a"), "g").join(head.toDF("h", "b"), "h").select("a", "b")
    # a large group has many chains, each from the group's first set
    inside = sets.select("set_id", "group_id").join(first.where("sets > 1"), "group_id").withColumn("chain", F.pmod(F.xxhash64("set_id"), F.expr(f"1 + sets div {CHAIN_ROWS}")))
    inside = inside.withColumn("b", F.coalesce(F.lag("set_id").over(Window.partitionBy("group_id", "chain").orderBy("set_id")), "first"))
    near = staged(near.union(inside.select(F.col("set_id").alias("a"), "b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "chains")
    links = verified(near, sets, docs)
    root = staged(components(links), "roots")

    # 2. lists and groups that still span classes
    now = staged(sets.join(root.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id")), "classed")
    groups = now.groupBy("group_id").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    placed = staged(lists.join(groups, "group_id").select("shingle", "n", "group_id", "place", "low", "high"), "placed")
    spans = placed.groupBy("shingle").agg(F.min("low").alias("x"), F.max("high").alias("y")).where("x <> y").select("shingle")
    often = placed.join(spans, "shingle").groupBy("shingle", "low").count().groupBy("shingle").agg(F.max_by("low", F.struct("count", "low")).alias("main"))
    placed = staged(placed.join(staged(often, "often"), "shingle").withColumn("odd", F.expr("low <> main or high <> main")).drop("main"), "spanning")
    odd = placed.where("odd").select("shingle", *(F.col(c).alias(f"{c}_") for c in ("n", "group_id", "place", "low", "high")))
    ok = (F.col("group_id") != F.col("group_id_")) & (~F.col("odd") | (F.col("group_id_") < F.col("group_id")))
    ok &= (5 * F.col("n") >= 4 * F.col("n_")) & (5 * F.col("n_") >= 4 * F.col("n"))
    ok &= ~((F.col("low") == F.col("high")) & (F.col("low_") == F.col("high_")) & (F.col("low") == F.col("low_")))
    # two sets that reach the threshold share `alike` shingles or more, so of each only n - alike have no match, and the first
    # `many` matches lie among the first n - alike + many of each, if their prefixes are as long
    alike, spare = "int((4 * (n + n_) + 8) / 9)", "(n{0} - int((4 * n{0} + 4) / 5) + 1)"
    many = f"least(1 + int(least(n, n_) / {MATCHES}), {spare.format('')} - n + {alike}, {spare.format('_')} - n_ + {alike})"
    near_start = F.expr(f"place < n - {alike} + {many} and place_ < n_ - {alike} + {many}")
    pairs = odd.join(placed, "shingle").where(ok & near_start).groupBy(F.least("group_id", "group_id_").alias("g"), F.greatest("group_id", "group_id_").alias("h"))
    pairs = pairs.agg(F.count("*").alias("c"), F.max(F.expr(many)).alias("many")).where("c >= many").select("g", "h")
    member = now.select("group_id", "set_id", "root", "n")
    cross = pairs.join(member.toDF("g", "a", "ra", "na"), "g").join(member.toDF("h", "b", "rb", "nb"), "h")
    mixed = now.join(groups.where("low <> high").select("group_id"), "group_id").select("group_id", "set_id", "root", "n")
    most = mixed.groupBy("group_id", "root").count().groupBy("group_id").agg(F.max_by("root", F.struct("count", "root")).alias("main"))
    apart = mixed.join(staged(most, "main-classes"), "group_id").where("root <> main").toDF("g", "a", "ra", "na", "main")
    same = apart.join(mixed.toDF("g", "b", "rb", "nb"), "g").where("rb = main or a < b")
    more = [x.where("ra <> rb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")) for x in (cross, same)]
    more = staged(reduce(DataFrame.union, more).distinct().join(near, ["a", "b"], "left_anti"), "crossing")
    if not more.isEmpty():
        found = verified(more, sets, docs)
        if not found.isEmpty():
            root = staged(components(found.union(root.select(F.col("node").alias("a"), F.col("root").alias("b")))), "roots")
            now = staged(sets.join(root.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id")), "classed")
    least = now.groupBy("root").agg(F.min("doc").alias("component_id"))
    return each.select("doc_id", "n_shingles", "set_id"), staged(now.join(least, "root").select("set_id", "root", "component_id"), "classes")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    each, of = classes(docs)
    empty = each.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return each.where("n_shingles > 0").join(of, "set_id").select("doc_id", "n_shingles", "component_id").union(empty)


def _one_of(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row of each key; of rows that differ, that with the least hash."""
    (row,) = unused(rows, "row")
    by = F.xxhash64(*(F.col(c).cast("string") for c in columns))
    return rows.groupBy(key).agg(F.min_by(F.struct(*columns), by).alias(row)).select(f"{row}.*")


def _with_sets(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    """The rows, with the id of each one's set, null if it is empty."""
    for batch in batches:
        for part in blocks(batch, "text"):
            two = [_two(x) if len(x) else None for x in shingle_sets(part.column("text"))]
            yield part.append_column(name, pa.array([None if x is None else np.array(x, ">u8").tobytes() for x in two], pa.binary()))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class, that with its smallest doc_id, with all its columns; of rows that repeat that id, one of the class.

    A null doc_id stays only in classes that have no other, and there once. Rows with empty sets are classes of their own, and stay.
    """
    each, of = classes(docs)
    told = each.join(of, "set_id", "left")
    keep, of_set, own = unused(docs, "keep", "kept_set", "own_set")
    # of each class the row that stays, by id and set; ids that stand on one row only need no look at its set
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "set_id"))
    stays = staged(told.where("n_shingles > 0").groupBy("root").agg(least.alias("x")).select("x.doc_id", "x.set_id"), "kept")
    again = staged(each.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated-ids")
    by_id = stays.where("doc_id is not null").select("doc_id").union(each.where("n_shingles = 0 and doc_id is not null").select("doc_id"))
    once = staged(by_id.join(again, "doc_id", "left_anti").select(F.col("doc_id").alias(keep)), "kept-once")
    out = docs.join(F.broadcast(once) if once.count() <= BROADCAST_MOST else once, F.col("doc_id") == F.col(keep), "left_semi")
    if again.isEmpty() and each.where("doc_id is null").isEmpty():
        return out
    unsure = docs.where("doc_id is null").union(docs.join(again.select(F.col("doc_id").alias(keep)), F.col("doc_id") == F.col(keep), "left_semi"))
    found = unsure.mapInArrow(lambda batches: _with_sets(batches, own), StructType([*docs.schema.fields, StructField(own, BinaryType())]))
    found = staged(found, "kept-unsure")
    chosen = stays.select(F.col("doc_id").alias(keep), F.col("set_id").alias(of_set))
    alone = found.join(chosen, (F.col(own) == F.col(of_set)) & F.col("doc_id").eqNullSafe(F.col(keep)), "left_semi")
    return out.union(found.where(F.col(own).isNull()).drop(own)).union(_one_of(alone, own, docs.columns))


@settled
def op2_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
