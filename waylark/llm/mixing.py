"""Mixing sources to target weights by weighted fair queueing.

Every source shuffles its documents by a hash of their ids and queues them, up to `repeats` times over. An entry's virtual finish
time is what its source has queued up to and with it, in words, divided by the source's target. The queue is in order of finish time
and is cut where the total budget ends. As targets add up to the budget, that is about at time 1; what would finish after `latest` (a
source whose single documents are larger than its target) is never taken.

Queues are range-sorted by source and key, and partitions add up their rows as they stream; what a partition has is told to those after
it. Rows that share an id, or have none, are dealt by their size, text and row number, so no id, source or text fills a partition. The
place of the cut is found by adding up ranges of finish time, each step splitting the range of the cut into SPLIT finer ones.

Defined results: a null text has size 0 and is never taken; a null source is a source of its own, the last; repeated rows queue
one after the other, ties of an id by size and a hash of the text; a null id is an id like others; very long texts are counted in
pieces; an empty table gives no rows. Other columns of the input are not read, so none can clash.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waylark.llm.common import SPACE, settled, small_batches, staged, word_counts

#: Rows of a partition of the queues, ranges that a range is split into, rows of the range in which the cut is sought row by row.
PART_ROWS, SPLIT, CUT_ROWS = 500_000, 1024, 20_000


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "source", "text_hash", "row")),
            pa.array(word_counts(batch.column("text"), SPACE))], ["doc_id", "source", "text_hash", "row", "size"])


def _queue(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a sorted partition with its number, and the sum of sizes of its source up to and with each."""
    part, source, total = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        own, size = batch.column("source_no").to_numpy(), batch.column("size").to_numpy()
        run = np.cumsum(size)
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        start = np.where(first > 0, run[first - 1], 0)
        start[0] = -total if own[0] == source else 0
        run = run - np.repeat(start, np.diff(np.append(first, len(own))))
        source, total = int(own[-1]), int(run[-1])
        yield batch.append_column("part", pa.array(np.full(len(own), part, np.int32))).append_column("run", pa.array(run))


def targets(sizes: dict, weights: Sequence[int], repeats: int, share: float = 1.0) -> dict:
    """Each source's share of the budget by weight; none above `repeats` times its size, the excess reshared until none is."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, open_, left = {}, set(order), Fraction(sum(sizes.values())) * Fraction(share)
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > repeats * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        out |= {s: Fraction(repeats * sizes[s]) for s in over}
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def mix_sources(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), repeats: int = 3, seed: str = "mix", share: float = 1.0,
    max_sources: int = 100_000, latest: float = 2.0, row_id: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every document, and row_id, if it names a column that tells rows apart.

    Only a row per source, of which more than max_sources are an error, a row per partition of the queues, and SPLIT sums a step come
    to the driver.
    """
    spark = docs.sparkSession
    small_batches(spark)
    row = F.monotonically_increasing_id() if row_id is None else F.col(row_id)
    sized = docs.select("doc_id", "source", "text", F.xxhash64("text").alias("text_hash"), row.alias("row")).mapInArrow(_sizes,
        "doc_id long, source string, text_hash long, row long, size long")
    key = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")
    base = staged(sized.withColumn("key", key), "mix-sizes")
    per = base.groupBy("source").agg(F.sum("size").alias("s"), F.count("*").alias("n")).limit(max_sources + 1).collect()
    if len(per) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    goal = targets({r["source"]: r["s"] for r in per}, weights, repeats, share)
    order = sorted(per, key=lambda r: (r["source"] is None, r["source"] or ""))
    facts = [(r["source"], i, r["s"], float(goal[r["source"]])) for i, r in enumerate(order)]
    facts = F.broadcast(spark.createDataFrame(facts, "f_source string, source_no int, source_size long, target double"))
    rows = base.join(facts, F.col("source").eqNullSafe(F.col("f_source"))).drop("f_source")

    by = ["source_no", "key", "doc_id", "size", "text_hash", "row"]
    parts = max(1, sum(r["n"] for r in per) // PART_ROWS)
    queues = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).mapInArrow(_queue,
        ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", part int, run long")
    queues = staged(queues, "mix-queues")
    sums = queues.groupBy("source_no", "part").agg(F.max("run").alias("n")).orderBy("source_no", "part").collect()
    before, told = {}, []
    for r in sums:
        told.append((r["source_no"], r["part"], before.get(r["source_no"], 0)))
        before[r["source_no"]] = told[-1][2] + r["n"]
    told = F.broadcast(spark.createDataFrame(told, "source_no int, part int, before long"))
    rows = queues.join(told, ["source_no", "part"]).withColumn("queued", F.col("before") + F.col("run"))

    budget = int(sum(Fraction(r["s"]) for r in per) * Fraction(share))
    finish = lambda e: F.try_divide(F.lit(e) * F.col("source_size") + F.col("queued"), "target")
    entries = rows.where("size > 0 and target > 0").select("doc_id", "size", "source_no", "key",
        F.explode(F.array(*(F.struct(F.lit(e).alias("e"), finish(e).alias("f")) for e in range(repeats)))).alias("x"))
    entries = entries.select("doc_id", "size", "source_no", "key", "x.e", "x.f").where(F.col("f") <= latest)
    last = ["f", "source_no", "key", "doc_id", "size", "e"]
    found = cut(entries, budget, last)
    if found is None:
        taken = sum((F.when(finish(e) <= latest, F.col("size")).otherwise(0) for e in range(repeats)), F.lit(0))
    else:

        def ahead(e: int):
            mine = [finish(e), F.col("source_no"), F.col("key"), F.coalesce("doc_id", F.lit(-(1 << 62))), F.col("size"), F.lit(e)]
            its = [found["f"], found["source_no"], found["key"], -(1 << 62) if found["doc_id"] is None else found["doc_id"], found["size"], found["e"]]
            out = F.lit(False)
            for a, b in zip(reversed(mine), reversed(its), strict=True):
                out = (a < F.lit(b)) | ((a == F.lit(b)) & out)
            return out

        taken = sum((F.when(ahead(e), F.col("size")).otherwise(0) for e in range(repeats)), F.lit(0))
    taken = F.when((F.col("size") > 0) & (F.col("target") > 0), taken).otherwise(0).cast("long")
    told = [F.col("row").alias(row_id)] if row_id is not None else []
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), *told)


def cut(entries: DataFrame, budget: int, last: Sequence[str]):
    """The first entry, in the order of `last`, with which the sum of sizes passes the budget; None if it never does."""
    scale, before, own = 1.0, 0, entries
    while True:
        sums = own.groupBy(F.floor(F.col("f") * scale).alias("r")).agg(F.sum("size").alias("s"), F.count("*").alias("n")).orderBy("r").collect()
        at = None
        for r in sums:
            if before + r["s"] > budget:
                at = r
                break
            before += r["s"]
        if at is None:
            return None
        own = entries.where(F.floor(F.col("f") * scale) == at["r"])
        if at["n"] <= CUT_ROWS or scale >= 2.0**50:  # times of a source differ, so those alike are no more than sources and repeats
            break
        scale *= SPLIT
    for r in own.orderBy(*last).toLocalIterator():
        before += r["size"]
        if before > budget:
            return r
    raise AssertionError("the range of the cut has it")


@settled
def op10_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")
