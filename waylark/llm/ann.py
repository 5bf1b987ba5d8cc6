"""Nearest neighbours by shifted space-filling curves, made whole by a scan of the blocks that can't be ruled out.

Vectors are projected to a few dimensions, several times over with different projections and shifts, and each projection is ordered
along a Hilbert curve. Range partitions of a curve's keys are walked with a window on either side of each query; the windows' rows of
all curves are merged and reranked by exact inner products. That gives each query a bound: its k-th best score so far.

A window of neighbours along a curve holds few of the nearest vectors where vectors have no structure in few dimensions, so the bound
is then used on blocks, which are runs of the first curve: queries, in blocks, meet every block whose centre and radius leave room for
a score above the bound. The result is exact.

The scan is a grid of groups of query blocks by splits of vector blocks. A cell holds its queries, GROUP_BYTES of them, and streams its
split's vectors past them, so the table is sent once per group and the queries once per split. Of vectors that are the same, a block
keeps the k + 1 with the smallest ids: no query has room for more.

Defined results: vectors that are null, zero, or hold a null or a component that isn't finite take no part, nor do those whose length
is not the commonest; rows with a query's id are not its candidates; repeated rows count once; of ties the smaller vec_id comes first;
with fewer candidates than k all are returned; no table, no rows. Columns other than vec_id and the vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waylark.llm.common import settled, small_batches, staged

CURVES, DIMENSIONS, DEPTH, WINDOW = 4, 6, 8, 48
BLOCK_ROWS, QUERY_ROWS, SPLIT_ROWS = 2048, 512, 25_000
#: Of a cell of the scan: bytes of queries that it holds, vectors that it streams.
GROUP_BYTES, CELL_ROWS = 16 << 20, 400_000
#: Hits that are held before each query's k best are kept, pairs that are reckoned exactly at once.
HELD, EXACT_ROWS = 1 << 19, 1 << 16
HIT = "query_id long, vec_id long, score double"


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of points x[row, dimension] of `bits` bits each, by transposing in Gray code."""
    x = x.astype(np.uint64).copy()
    n = x.shape[1]
    level = np.uint64(1 << (bits - 1))
    while level > 1:
        low = level - np.uint64(1)
        for i in range(n):
            on = (x[:, i] & level) != 0
            swap = np.where(on, np.uint64(0), (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(on, low, swap)
            if i:
                x[:, i] ^= swap
        level >>= np.uint64(1)
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.uint64)
    level = np.uint64(1 << (bits - 1))
    while level > 1:
        t ^= np.where((x[:, n - 1] & level) != 0, level - np.uint64(1), np.uint64(0))
        level >>= np.uint64(1)
    x ^= t[:, None]
    key = np.zeros(len(x), np.uint64)
    for b in reversed(range(bits)):
        for i in range(n):
            key = (key << np.uint64(1)) | ((x[:, i] >> np.uint64(b)) & np.uint64(1))
    return key.astype(np.int64)


def curve_keys(vectors: np.ndarray, seed: int = 5) -> np.ndarray:
    """[curve, row]: unit vectors' places along each curve. A projection of a unit vector has a spread of 1 / sqrt(dimensions)."""
    rng, d = np.random.default_rng(seed), vectors.shape[1]
    out = []
    for c in range(CURVES):
        axes = rng.normal(size=(d, DIMENSIONS)) / np.sqrt(d)
        shift = rng.uniform(0, 0.5, DIMENSIONS)
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        place = np.clip(unit @ axes * np.sqrt(d) / 8 + 0.25 + shift, 0, 1 - 1e-9)
        out.append(hilbert((place * (1 << DEPTH)).astype(np.uint64), DEPTH))
    return np.array(out)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, d)


def _keyed(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = curve_keys(_matrix(batch.column("v"), d))
                for c in range(CURVES):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, c, np.int32)), pa.array(keys[c]), batch.column("vec_id"), batch.column("v")], ["curve", "key", "vec_id", "v"])

    return run


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products pair by pair, always summed in the same order."""
    return (q * x).sum(axis=1)


def _top(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best of each query."""
    by = np.lexsort((vec, -score, query))
    query, vec, score = query[by], vec[by], score[by]
    new = np.append(True, (np.diff(query) != 0) | (np.diff(vec) != 0)) if len(query) else np.zeros(0, bool)
    query, vec, score = query[new], vec[new], score[new]
    first = np.searchsorted(query, query, side="left")
    ok = np.arange(len(query)) - first < k
    return query[ok], vec[ok], score[ok]


def _hits(query: np.ndarray, vec: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(query.astype(np.int64)), pa.array(vec.astype(np.int64)), pa.array(score.astype(np.float64))], ["query_id", "vec_id", "score"])


def _windows(d: int, k: int, every: int):
    """Neighbours of each query in rows in the order of (curve, key). Rows are held in runs, with a window of the run before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        curve, ids, held, done = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros((0, d)), 0

        def walk(upto: int) -> pa.RecordBatch | None:
            at = np.flatnonzero(ids[done:upto] % every == 0) + done
            if not len(at):
                return None
            by = at[:, None] + np.concatenate([np.arange(-WINDOW, 0), np.arange(1, WINDOW + 1)])
            q, x = np.nonzero((by >= 0) & (by < len(ids)))
            q, x = at[q], by[q, x]
            ok = (curve[q] == curve[x]) & (ids[q] != ids[x])
            q, x = q[ok], x[ok]
            return _hits(*_top(ids[q], ids[x], exact(held[q], held[x]), k))

        for batch in batches:
            curve = np.append(curve, batch.column("curve").to_numpy())
            ids = np.append(ids, batch.column("vec_id").to_numpy())
            held = np.vstack([held, _matrix(batch.column("v"), d)])
            upto = max(done, len(ids) - WINDOW)
            if (out := walk(upto)) is not None:
                yield out
            drop = max(0, upto - WINDOW)
            curve, ids, held, done = curve[drop:], ids[drop:], held[drop:], upto - drop
        if (out := walk(len(ids))) is not None:
            yield out

    return run


def _fewer(ids: np.ndarray, v: np.ndarray, k: int) -> np.ndarray:
    """Rows to keep: of those with the same vector, the k + 1 with the smallest ids."""
    same = np.unique(v, axis=0, return_inverse=True)[1].reshape(-1)
    by = np.lexsort((ids, same))
    same, of = same[by], ids[by]
    new = np.append(True, (np.diff(same) != 0) | (np.diff(of) != 0))
    by, same = by[new], same[new]
    return np.sort(by[np.arange(len(by)) - np.searchsorted(same, same) <= k])


def _packed(d: int, rows: int, k: int | None):
    """Blocks of rows in their order: ids, vectors, bounds, and the centre and radius. With k: without vectors that no query has room for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, rows):
                part = batch.slice(a, rows)
                ids, v = part.column("vec_id").to_numpy(), _matrix(part.column("v"), d)
                bound = part.column("bound").to_numpy() if "bound" in part.schema.names else np.zeros(0)
                if k is not None:
                    kept = _fewer(ids, v, k)
                    ids, v = ids[kept], v[kept]
                centre = v.mean(axis=0)
                radius = float(np.linalg.norm(v - centre, axis=1).max())
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (ids, v, bound, centre)] + [pa.array([radius])], ["ids", "v", "bound", "centre", "radius"])

    return run


class _Cell:
    """The queries of a cell, and the k best of each above its bound so far."""

    def __init__(self, d: int, k: int, most: int):
        self.d, self.k, self.most, self.given, self.n, self.any = d, k, most, [], 0, False
        self.best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        self.held: list[tuple] = []

    def queries(self, ids: bytes, v: bytes, bound: bytes) -> None:
        self.any = True
        self.given.append((np.frombuffer(ids, np.int64), np.frombuffer(v).reshape(-1, self.d), np.frombuffer(bound)))

    def vectors(self, ids: np.ndarray, v: np.ndarray, centre: np.ndarray, radius: float) -> None:
        if self.given:
            self.ids, self.q, self.bound = (np.concatenate(x) for x in zip(*self.given, strict=True))
            self.given, self.length = [], np.linalg.norm(self.q, axis=1)
            self.order = np.argsort(self.ids)
        near = np.flatnonzero(self.q @ centre + self.length * radius + 1e-9 * self.length >= self.bound)
        for at in range(0, len(near), QUERY_ROWS):
            own = near[at : at + QUERY_ROWS]
            room = 1e-9 * self.length[own]
            s = self.q[own] @ v.T
            s[self.ids[own][:, None] == ids[None, :]] = -np.inf
            if s.shape[1] > self.k:
                self.bound[own] = np.maximum(self.bound[own], np.partition(s, s.shape[1] - self.k, axis=1)[:, -self.k] - room)
            a, b = np.nonzero((s >= (self.bound[own] - room)[:, None]) & (s > -np.inf))
            for x in range(0, len(a), EXACT_ROWS):
                qa, vb = own[a[x : x + EXACT_ROWS]], b[x : x + EXACT_ROWS]
                self.held.append((self.ids[qa], ids[vb], exact(self.q[qa], v[vb])))
            self.n += len(a)
            if self.n >= self.most:
                self.keep()

    def keep(self) -> None:
        """Keeps each query's k best; the last of k is its new bound."""
        self.best = _top(*(np.concatenate(x) for x in zip(self.best, *self.held, strict=True)), self.k)
        self.held, self.n = [], 0
        query, _, score = self.best
        last = np.flatnonzero(np.arange(len(query)) - np.searchsorted(query, query) == self.k - 1)
        at = self.order[np.searchsorted(self.ids, query[last], sorter=self.order)]
        self.bound[at] = np.maximum(self.bound[at], score[last] - 1e-9 * self.length[at])

    def told(self) -> pa.RecordBatch:
        if self.held:
            self.keep()
        return _hits(*self.best)


def _scan(d: int, k: int, most: int):
    """Rows by cell, a cell's query blocks first, then its blocks of vectors: the k best of each query above its bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, cell = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if (r["group"], r["split"]) != number:
                    if cell is not None:
                        yield cell.told()
                    number, cell = (r["group"], r["split"]), _Cell(d, k, most)
                if not r["stored"]:
                    cell.queries(r["ids"], r["v"], r["bound"])
                elif cell.any:
                    cell.vectors(np.frombuffer(r["ids"], np.int64), np.frombuffer(r["v"]).reshape(-1, d), np.frombuffer(r["centre"]), r["radius"])
        if cell is not None:
            yield cell.told()

    return run


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, whole: bool = True) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest by inner product of each vector whose id is divisible by `every`.

    whole=False leaves out the scan: what the curves' windows alone find.
    """
    spark = vectors.sparkSession
    small_batches(spark, BLOCK_ROWS)
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.where("vec_id is not null and embedding is not null").select("vec_id", v.alias("v"))
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    rows = rows.select("vec_id", "v", F.size("v").alias("d"))
    common = rows.groupBy("d").count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d, n = common["d"], common["count"]
    parts = max(1, n // SPLIT_ROWS)
    keyed = staged(rows.where(F.col("d") == d).select("vec_id", "v").mapInArrow(_keyed(d), "curve int, key long, vec_id long, v array<double>"), "curves")
    order = keyed.repartitionByRange(CURVES * parts, "curve", "key", "vec_id").sortWithinPartitions("curve", "key", "vec_id")
    hits = staged(order.mapInArrow(_windows(d, k, every), HIT), "windows")
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    if whole:
        ranked = hits.distinct().withColumn("i", F.row_number().over(by_score))
        bounds = ranked.where(F.col("i") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("bound"))
        one = keyed.where("curve = 0").select("key", "vec_id", "v")
        queries = one.where(F.col("vec_id") % every == 0).distinct().join(bounds, "vec_id", "left").select("key", "vec_id", "v", F.coalesce("bound", F.lit(float("-inf"))).alias("bound"))
        groups = max(1, -(-n // every * d * 8 // GROUP_BYTES))
        splits = max(1, -(-n // CELL_ROWS), min(parts, -(-2 * spark.sparkContext.defaultParallelism // groups)))
        packed = "ids binary, v binary, bound binary, centre binary, radius double"
        q = queries.repartitionByRange(groups, "key", "vec_id").sortWithinPartitions("key", "vec_id").mapInArrow(_packed(d, QUERY_ROWS, None), packed)
        q = staged(q.select("*", F.spark_partition_id().alias("part")), "query-blocks")
        ranges = (q.agg(F.max("part")).first()[0] or 0) + 1  # as many as groups, unless Spark has dealt them into more or fewer
        b = one.repartitionByRange(parts, "key", "vec_id").sortWithinPartitions("key", "vec_id").mapInArrow(_packed(d, BLOCK_ROWS, k), packed)
        b = staged(b.withColumn("split", F.pmod(F.xxhash64("ids"), F.lit(splits)).cast("int")), "vector-blocks")
        each = lambda most: F.explode(F.sequence(F.lit(0), F.lit(most - 1)))
        q = q.select(*(x.split()[0] for x in packed.split(", ")), F.floor(F.col("part") * groups / ranges).cast("int").alias("group"), each(splits).alias("split"), F.lit(False).alias("stored"))
        b = b.select(*(x.split()[0] for x in packed.split(", ")), each(groups).alias("group"), "split", F.lit(True).alias("stored"))
        cells = q.union(b).repartition(groups * splits, "group", "split").sortWithinPartitions("group", "split", "stored")
        small_batches(spark, 8)  # rows are blocks
        hits = hits.union(staged(cells.mapInArrow(_scan(d, k, HELD), HIT), "scanned"))
        small_batches(spark, BLOCK_ROWS)
    found = hits.distinct().withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")


@settled
def op7_ann(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
