"""Shared tables, and vectorised word hashing over Arrow string columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are hashed at once; a longer text is cut between words.
BLOCK = 1 << 20

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_CHAIN = 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1


# ---------------------------------------------------------------- shared tables
def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset in local mode (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='waylark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/waylark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends here, and a lost executor costs its tasks only."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_ROWS, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, rows: int = 512, size: int = 64 << 20) -> None:
    """Bounds what one Arrow batch of whole texts holds; local workers find this package where the driver did.

    Spark reads these settings when a result is computed, so an operator that returns one can't set them back; `settled` does.
    """
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    spark.conf.set(_ROWS, rows)
    spark.conf.set(_BYTES, size)


def settled(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """query(spark, ...) with its result written, and the session's batch settings as they were before."""

    @wraps(query)
    def run(spark: SparkSession, *args, **more) -> DataFrame:
        before = {c: spark.conf.get(c, None) for c in (_ROWS, _BYTES)}
        try:
            return staged(query(spark, *args, **more), query.__name__)
        finally:
            for c, value in before.items():
                spark.conf.unset(c) if value is None else spark.conf.set(c, value)

    return run


# ---------------------------------------------------------------- columns and joins
def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores put before them until the input has no such column, upper or lower case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
        taken.add(name.lower())
    return out


def text_key(text: Column, names: tuple[str, str] = ("h1", "h2")) -> list[Column]:
    """Two columns of 64 bits that tell texts apart, whatever ids their rows have."""
    return [F.xxhash64(text).alias(names[0]), F.xxhash64(F.lit(7), text).alias(names[1])]


#: Rows of a table that is broadcast at most; rows of a key from which on it is a hot one.
BROADCAST_MOST, HOT_ROWS = 200_000, 10_000


def join_facts(rows: DataFrame, facts: DataFrame, key: str, count: str, how: str = "left") -> DataFrame:
    """rows with what facts, a staged table of one row per key, says of their key; its column `count` goes.

    count: about how many rows have the key. Few facts are broadcast. Of many, those of hot keys are, whose number is at most the
    rows' by HOT_ROWS, and the others meet their rows by a shuffle, in which rows with a hot key or none go by a hash of the whole row.
    """
    if facts.count() <= BROADCAST_MOST:
        return rows.join(F.broadcast(facts.drop(count)), key, how)
    told = [c for c in facts.columns if c not in (key, count)]
    of = F.struct(*told, F.lit(True).alias("is_there"))
    hot = facts.where(F.col(count) >= HOT_ROWS).select(F.col(key).alias("hot_key"), of.alias("hot_told"))
    rest = facts.where(F.col(count) < HOT_ROWS).select(F.col(key).alias("rest_key"), F.lit(0).cast("long").alias("rest_deal"), of.alias("rest_told"))
    alone = F.when(F.col("hot_told").isNull() & F.col(key).isNotNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(*rows.columns))
    out = rows.join(F.broadcast(hot), F.col(key) == F.col("hot_key"), "left").withColumn("deal", alone)
    out = out.join(rest, (F.coalesce(key, F.lit("")) == F.col("rest_key")) & (F.col("deal") == F.col("rest_deal")), "left")
    found = F.coalesce("hot_told", "rest_told")
    out = out.where(found.isNotNull()) if how == "inner" else out
    return out.select(key, *(c for c in rows.columns if c != key), *(found[c].alias(c) for c in told))


# ---------------------------------------------------------------- hashing
def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = np.arange(256)
#: Separators of words [^\x20\x09-\x0D]+ and of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z.
SPACE = (_BYTE == 0x20) | ((_BYTE >= 9) & (_BYTE <= 13))
SYMBOL = (_BYTE < 0x80) & ~(((_BYTE >= 48) & (_BYTE <= 57)) | ((_BYTE >= 65) & (_BYTE <= 90)) | ((_BYTE >= 97) & (_BYTE <= 122)))
_LETTER = mix(np.arange(1, 257, dtype=np.uint64) * _MULTIPLIER)
_LETTER[65:91] = _LETTER[97:123]
_powers = np.ones(1, np.uint64)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            _powers = np.concatenate([np.ones(1, np.uint64), np.multiply.accumulate(np.full(max(n, 64), _MULTIPLIER, np.uint64))])
    return _powers


def _raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and row offsets; a null is an empty row."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def _hash_piece(data: np.ndarray, begins: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words in data; begins: where rows begin."""
    inside = ~separator[data]
    before = np.empty(len(data), bool)
    before[0] = True
    before[1:] = ~inside[:-1]
    before[begins] = True
    first = inside & before
    starts = np.flatnonzero(first)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    place = np.arange(len(data)) - starts[np.maximum(np.cumsum(first) - 1, 0)]
    place[~inside] = 0
    values = np.where(inside, _LETTER[data] * _power_table(int(place.max()) + 1)[place], np.uint64(0))
    return starts, mix(np.add.reduceat(values, starts))


def word_hashes(column: pa.Array, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words of all rows, A-Z and a-z alike; offsets of the rows in them). Whole texts, in pieces of about BLOCK bytes."""
    data, offsets = _raw(column)
    begins = offsets[:-1]
    starts, hashes, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + BLOCK)
        while end < len(data):  # back to a separator, or forward if the piece has none
            back = np.flatnonzero(separator[data[at:end]])
            if len(back) and back[-1] > 0:
                end = at + int(back[-1])
                break
            end = min(len(data), end + BLOCK)
        own = begins[(begins >= at) & (begins < end)] - at
        s, h = _hash_piece(data[at:end], own, separator)
        starts.append(s + at)
        hashes.append(h)
        at = end
    if not starts:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets, side="left")


def word_counts(column: pa.Array, separator: np.ndarray) -> np.ndarray:
    """The number of words of each row."""
    data, offsets = _raw(column)
    out, at = np.zeros(len(offsets) - 1, np.int64), 0
    while at < len(data):
        end = min(len(data), at + BLOCK)
        inside = ~separator[data[at:end]]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        if at:
            first[0] &= separator[data[at - 1]]
        begins = offsets[:-1][(offsets[:-1] >= at) & (offsets[:-1] < end)] - at
        first[begins] = inside[begins]
        out += np.bincount(np.searchsorted(offsets, np.flatnonzero(first) + at, side="right") - 1, minlength=len(out))
        at = end
    return out


class Spelt:
    """The words of one text as slices of its bytes, A-Z in lower case."""

    def __init__(self, raw: bytes, separator: np.ndarray):
        self.text = raw.translate(bytes(32 if separator[i] else i + 32 if 65 <= i <= 90 else i for i in range(256)))
        starts, at = [], 0
        data = np.frombuffer(self.text, np.uint8)
        while at < len(data):
            inside = data[at : at + BLOCK] != 32
            before = np.append(at > 0 and data[at - 1] != 32, inside[:-1])
            starts.append(np.flatnonzero(inside & ~before) + at)
            at += BLOCK
        self.starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.starts)

    def __getitem__(self, of: slice) -> list[bytes]:
        """Some words on end."""
        a, b = max(0, of.start), min(of.stop, len(self))
        if a >= b:
            return []
        return self.text[self.starts[a] : self.starts[b] if b < len(self) else None].split()


def rows_of(offsets: np.ndarray) -> np.ndarray:
    """The row of each element."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k consecutive words, rows not regarded."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += hashes[j : j + n] * np.uint64(pow(_CHAIN, j + 1, 1 << 64))
    return mix(out + np.uint64(k))


def row_grams(hashes: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, word number in its row) of each k consecutive words of a row."""
    rows, g = rows_of(offsets), grams(hashes, k)
    ok = np.flatnonzero(rows[: len(g)] == rows[k - 1 :][: len(g)]) if len(g) else np.zeros(0, np.int64)
    return g[ok], rows[ok], ok - offsets[:-1][rows[ok]]


def blocks(batch: pa.RecordBatch, column: str, limit: int = 4 * BLOCK) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about limit bytes of text each."""
    lengths = np.diff(_raw(batch.column(column))[1])
    at, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if total and total + n > limit:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += n
    if at < batch.num_rows:
        yield batch.slice(at)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def digests(high: np.ndarray, low: np.ndarray) -> pa.Array:
    """16-byte keys of two 64-bit halves."""
    both = np.empty((len(high), 2), np.uint64)
    both[:, 0], both[:, 1] = high, low
    return pa.Array.from_buffers(pa.binary(16), len(high), [None, pa.py_buffer(both.astype(">u8").tobytes())]).cast(pa.binary())
