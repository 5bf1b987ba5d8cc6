"""Benchmark decontamination by winnowing.

The hashes of all runs of K words are winnowed: of each WINDOW - K + 1 consecutive hashes the smallest is kept (of equal ones the
last), so two texts that share WINDOW words share a fingerprint. Fingerprints of documents and of benchmark items are joined; each
hit is then extended over the windows of the document around it, whose words are joined to those of the items' windows, word for
word. Items of fewer words are a window of their own, found by hashes of all runs of that length.

Texts meet windows, and windows meet items: windows that the same items have form a class, so a text that hits a window of a thousand
items carries one class of it. Classes are turned into items once for each set of classes that some text has.

Defined results: a null or empty text has no words and isn't hit; an item without words is never found; rows that repeat a doc_id
are judged by their own texts, as are those with a null one; repeated items count once (by item_id); the windows of an item without
an item_id hit documents, but it isn't counted or told among the items. Very long texts are read in whole, in pieces, and carry as
many windows as they have hits; ties don't arise. An empty benchmark hits nothing, an empty table gives no rows. Columns other than
those named are carried along by `clean`, whatever their names, and not read by `scan`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waylark.llm.common import BROADCAST_MOST, SYMBOL, Spelt, _raw, blocks, row_grams, settled, signed, small_batches, staged, text_key, unused, word_counts, word_hashes

WINDOW = 10
K = 5
#: Fingerprints of items that are broadcast at most (64 MB); more are joined by a shuffle.
PRINTS_MOST = 4_000_000


def winnow(hashes: np.ndarray, rows: np.ndarray, width: int) -> np.ndarray:
    """Places of the smallest of each `width` consecutive hashes of a row, of equal ones the last."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least, place = hashes[:n].copy(), np.arange(n)
    for j in range(1, width):
        better = hashes[j : j + n] <= least
        np.copyto(least, hashes[j : j + n], where=better)
        np.copyto(place, np.arange(j, j + n), where=better)
    place = place[rows[:n] == rows[width - 1 :]]
    return place[np.append(True, np.diff(place) != 0)] if len(place) else place


def _fingerprints(short: tuple[int, ...], window: int, k: int, item: bool):
    """Rows (h1, h2, at, kind, print). Of a document: winnowed prints, and all runs of the short lengths; of an item, those that it needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                hashes, offsets = word_hashes(part.column("text"), SYMBOL)
                lengths = np.diff(offsets)
                g, rows, at = row_grams(hashes, offsets, k)
                kept = winnow(g, rows, window - k + 1)
                found = [(k, g[kept], rows[kept], at[kept])]
                for m in short:
                    g, rows, at = row_grams(hashes, offsets, m)
                    if item:
                        own = lengths[rows] == m
                        g, rows, at = g[own], rows[own], at[own]
                    found.append((-m, g, rows, at))
                for kind, g, rows, at in found:
                    keys = [part.column(h).take(pa.array(rows)) for h in ("h1", "h2")]
                    yield pa.RecordBatch.from_arrays([*keys, pa.array(at.astype(np.int64)), pa.array(np.full(len(g), kind, np.int32)), signed(g)],
                        ["h1", "h2", "at", "kind", "print"])

    return run


PRINT = "h1 long, h2 long, at long, kind int, print long"


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(word_counts(batch.column("text"), SYMBOL))], ["n"])


def _windows(window: int, k: int):
    """Rows (h1, h2, at, x): the words of the windows around a text's hits (hits: kind and place), or of all windows if it has no such column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            around = batch.column("hits").to_pylist() if "hits" in batch.schema.names else [None] * batch.num_rows
            data, offsets = _raw(batch.column("text"))
            for row, hits in enumerate(around):
                w = Spelt(data[offsets[row] : offsets[row + 1]].tobytes(), SYMBOL)
                if hits is None:
                    m = min(len(w), window)
                    wanted = {(a, m) for a in range(len(w) - m + 1)} if m else ()
                else:
                    wanted = {(h["at"], -h["kind"]) for h in hits if h["kind"] < 0}
                    for h in hits:
                        if h["kind"] > 0:
                            wanted |= {(a, window) for a in range(max(0, h["at"] + k - window), min(h["at"], len(w) - window) + 1)}
                wanted = sorted(wanted)
                for i in range(0, len(wanted), 10_000):
                    part = wanted[i : i + 10_000]
                    xs = pa.array([b" ".join(w[a : a + m]) for a, m in part], pa.binary())
                    keys = [pa.array([batch.column(h)[row].as_py()] * len(part), pa.int64()) for h in ("h1", "h2")]
                    yield pa.RecordBatch.from_arrays([*keys, pa.array([a for a, _ in part], pa.int64()), pa.array([m for _, m in part], pa.int32()),
                        xs], ["h1", "h2", "at", "m", "x"])

    return run


PLACED = "h1 long, h2 long, at long, m int, x binary"


def item_windows(benchmark: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """item_id, x: the windows' words of every item; items without an id have a null one."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null")
    items = staged(items.select("item_id", "text", *text_key(F.col("text"))), "items")
    once = items.select("h1", "h2", "text").dropDuplicates(["h1", "h2"])
    placed = once.mapInArrow(_windows(window, k), PLACED).select("h1", "h2", "m", "x").distinct()
    return staged(placed.join(items.select("item_id", "h1", "h2"), ["h1", "h2"]).select("item_id", "m", "x").distinct(), "item-windows")


def hits(docs: DataFrame, benchmark: DataFrame, windows: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """h1, h2, at, m, x: where which windows of items (item_id, m, x) stand in which texts of docs (h1, h2, text), each text once."""
    items = benchmark.select("text").where("text is not null").distinct().select("text", *text_key(F.col("text")))
    lengths = items.select("text").mapInArrow(_lengths, "n long").where(f"n between 1 and {window - 1}").distinct()
    short = tuple(sorted(r["n"] for r in lengths.collect()))  # window - 1 numbers at most
    prints = staged(items.mapInArrow(_fingerprints(short, window, k, True), PRINT).select("kind", "print").distinct(), "prints")
    if prints.count() <= PRINTS_MOST:
        prints = F.broadcast(prints)
    found = docs.mapInArrow(_fingerprints(short, window, k, False), PRINT).join(prints, ["kind", "print"])
    found = staged(found.groupBy("h1", "h2").agg(F.collect_set(F.struct("kind", "at")).alias("hits")), "prints-found")
    near = F.broadcast(found) if found.count() <= BROADCAST_MOST and _small(found) else found
    texts = docs.join(near, ["h1", "h2"]).dropDuplicates(["h1", "h2"])
    placed = staged(texts.mapInArrow(_windows(window, k), PLACED), "windows-found")
    return staged(placed.join(windows.select("m", "x").distinct(), ["m", "x"]), "hits")


def _small(found: DataFrame) -> bool:
    return (found.agg(F.sum(F.size("hits"))).first()[0] or 0) <= 2_000_000


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text", *text_key(F.col("text")))
    windows = item_windows(benchmark, window, k)
    found = hits(docs.select("h1", "h2", "text"), benchmark, windows, window, k)
    n_hit = found.select("h1", "h2", F.explode(F.expr("sequence(at, at + m - 1)")).alias("word")).distinct().groupBy("h1", "h2").agg(F.count("*").alias("n_hit"))

    # the class of a window is that of its items, whatever their number; a window stands for its class
    known = windows.where("item_id is not null")
    two = lambda c: (F.bit_xor(F.xxhash64(c)), F.bit_xor(F.xxhash64(F.lit(7), c)), F.count("*"))
    of = known.groupBy("m", "x").agg(F.struct(*(c.alias(f"c{i}") for i, c in enumerate(two("item_id")))).alias("class"))
    met = found.select("h1", "h2", "m", "x").distinct().join(of, ["m", "x"])
    met = staged(met.groupBy("h1", "h2", "class").agg(F.min(F.struct("m", "x")).alias("window")), "classes-met")
    of_text = staged(met.groupBy("h1", "h2").agg(F.struct(*(c.alias(f"s{i}") for i, c in enumerate(two("class")))).alias("set")), "sets-of-classes")
    one = of_text.groupBy("set").agg(F.min(F.struct("h1", "h2")).alias("of"))  # a text stands for its set of classes
    listed = met.join(one.select("set", "of.h1", "of.h2"), ["h1", "h2"]).select("set", "window.m", "window.x").join(known, ["m", "x"]).select("set",
        "item_id").distinct()
    listed = listed.repartition("set").sortWithinPartitions("set", "item_id")
    told = listed.mapInArrow(_listed, "s0 long, s1 long, s2 long, n_items long, items_sha256 string")
    told = of_text.select("h1", "h2", "set.*").join(told, ["s0", "s1", "s2"]).select("h1", "h2", "n_items", "items_sha256")
    facts = staged(n_hit.join(told, ["h1", "h2"], "left").withColumnsRenamed({"h1": "g1", "h2": "g2"}), "decontaminated")

    counted = docs.mapInArrow(_counted, "doc_id long, h1 long, h2 long, n_words long")
    facts = F.broadcast(facts) if facts.count() <= BROADCAST_MOST else facts
    out = counted.join(facts, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    none = hashlib.sha256(b"").hexdigest()
    return out.select("doc_id", "n_words", zero("n_hit"), zero("n_items"), F.coalesce("items_sha256", F.lit(none)).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "h1", "h2")), pa.array(word_counts(batch.column("text"), SYMBOL))],
            ["doc_id", "h1", "h2", "n_words"])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number and digest of the items of each set; its items come on end, in order."""
    own, n, sha = None, 0, hashlib.sha256()

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (*own, n)] + [pa.array([sha.hexdigest()])],
            ["s0", "s1", "s2", "n_items", "items_sha256"])

    for batch in batches:
        for s, item in zip(batch.column("set").to_pylist(), batch.column("item_id").to_pylist(), strict=True):
            key = (s["s0"], s["s1"], s["s2"])
            if key != own:
                if own is not None:
                    yield row()
                own, n, sha = key, 0, hashlib.sha256()
            sha.update(f"{',' if n else ''}{item}".encode())
            n += 1
    if own is not None:
        yield row()


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """The rows of documents that hold no window of an item, with all their columns."""
    small_batches(docs.sparkSession)
    found = hits(docs.select("text", *text_key(F.col("text"))), benchmark, item_windows(benchmark, window, k), window, k)
    a, b, c, d = unused(docs, "h1", "h2", "g1", "g2")
    bad = staged(found.select(F.col("h1").alias(c), F.col("h2").alias(d)).distinct(), "contaminated")
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_MOST else bad
    keyed = docs.select("*", *text_key(F.col("text"), (a, b)))
    return keyed.join(bad, (F.col(a) == F.col(c)) & (F.col(b) == F.col(d)), "left_anti").select(*docs.columns)


@settled
def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
