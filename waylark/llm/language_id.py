"""Language identification of whole texts, with spans where a text changes its language.

Each word gets a score per language from hashed letter trigrams and four-grams (smoothed log likelihoods, learned from labelled
rows). The script of the word, by Unicode range, narrows the languages to those seen in that script. A Viterbi pass over the words
then labels spans, a change of language costing `penalty`. Where no other language gains more than half the penalty on any run of
words, the path of one language is the best one; that is tested first, and only other texts go through the full recursion. Words that
repeat in a block of texts are scored once.

Defined results: a null or empty text, or one with no letter, is `und` with score 0 and no spans, as is every text if nothing was
labelled. Ties go to the language first by code point. Repeated rows each get their result; very long texts are one block each; an
empty table gives no rows. Columns other than doc_id and text take no part in a prediction; `keep_identified` carries them along,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waylark.llm.common import BLOCK, blocks, mix, settled, small_batches

BITS = 16
#: Words whose steps of the Viterbi pass are held at once.
STEPS = 1 << 16
#: First and last code point of scripts; 0 is any other, 1 Latin.
SCRIPTS = (
    ("latin", 0x41, 0x24F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x370, 0x3FF), ("greek", 0x1F00, 0x1FFF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F),
    ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF), ("arabic", 0x750, 0x77F), ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("tamil", 0xB80, 0xBFF),
    ("thai", 0xE00, 0xE7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
)
SCRIPT_NAMES = ["other", *dict.fromkeys(s for s, _, _ in SCRIPTS)]
_tables: tuple[np.ndarray, np.ndarray] | None = None


def _code_points() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: is it a letter; its script."""
    global _tables
    if _tables is None:
        letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        script = np.zeros(0x110000, np.uint8)
        for name, a, b in SCRIPTS:
            script[a : b + 1] = SCRIPT_NAMES.index(name)
        _tables = letter, script
    return _tables


def letters_of(texts: list[str | None]) -> tuple[np.ndarray, ...]:
    """The letters of all texts, in lower case; then words: first letter, text, script."""
    letter, script = _code_points()
    low = [(t or "").lower() for t in texts]
    ends = np.cumsum(np.fromiter(map(len, low), np.int64, len(low)))
    c = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), "<u4")
    at = np.flatnonzero(letter[c]) if len(c) else np.zeros(0, np.int64)
    before = np.zeros(len(at), bool)  # is a letter of the same text right before
    before[1:] = np.diff(at) == 1
    starts = np.searchsorted(at, np.append(0, ends)[:-1])
    before[starts[starts < len(at)]] = False
    own, first = c[at], np.flatnonzero(~before)
    return own, first, np.searchsorted(ends, at[first], side="right"), script[own[first]]


def features(own: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trigram and four-gram buckets of all letters of words, which begin at `first`."""
    c = own.astype(np.int64)
    joined = np.ones(len(c), bool)  # to the letter before
    joined[first] = False
    shift = lambda x, ok: np.where(ok, np.roll(x, 1), 0)
    before = shift(c, joined)
    two = shift(before, joined)
    follows = np.roll(joined, -1)
    if len(c):
        follows[-1] = False
    after = np.where(follows, np.roll(c, -1), 0)
    tri = (before << 42 ^ c << 21 ^ after).astype(np.uint64)
    tri_h = (mix(tri) >> np.uint64(64 - BITS)).astype(np.int64)
    return tri_h, (mix(tri ^ mix(two.astype(np.uint64) + np.uint64(7))) >> np.uint64(64 - BITS)).astype(np.int64)


def distinct(own: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The letters and first letters of the distinct words, and which of them each word is. Words are told apart by 64 bits."""
    length = np.diff(np.append(first, len(own)))
    place = np.arange(len(own)) - np.repeat(first, length)
    hashes = mix(np.add.reduceat(_symbol(own) * _place(place), first) + length.astype(np.uint64))
    _, at, which = np.unique(hashes, return_index=True, return_inverse=True)
    n = length[at]
    starts = np.cumsum(n) - n
    return own[np.repeat(first[at] - starts, n) + np.arange(n.sum())], starts, which.reshape(-1)


def _symbol(c: np.ndarray) -> np.ndarray:
    return mix((c.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def _place(place: np.ndarray) -> np.ndarray:
    """An odd multiplier for each place in a word."""
    return mix(np.arange(int(place.max()) + 1, dtype=np.uint64) + np.uint64(3))[place] | np.uint64(1)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    tri: np.ndarray
    four: np.ndarray
    allowed: np.ndarray  # [script, language]


def _counts(languages: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {s: i for i, s in enumerate(languages)}
        size = 2 * (1 << BITS) + len(SCRIPT_NAMES)
        total = np.zeros((len(languages), size), np.int64)
        for batch in batches:
            for part in blocks(batch, "text", BLOCK):
                lang = np.array([number[x] for x in part.column("lang").to_pylist()], np.int64)
                letter, first, text, script = letters_of(part.column("text").to_pylist())
                tri, four = features(letter, first)
                letters = np.diff(np.append(first, len(tri)))
                of = lang[np.repeat(text, letters)]
                for values, start, width, own, weights in ((tri, 0, 1 << BITS, of, None), (four, 1 << BITS, 1 << BITS, of, None), (script, 2 << BITS, len(SCRIPT_NAMES), lang[text], letters)):
                    found = np.bincount(own * width + values, weights, len(languages) * width).astype(np.int64)
                    total[:, start : start + width] += found.reshape(len(languages), width)
        lang, bucket = np.nonzero(total)
        for a in range(0, len(lang), 50_000):
            b = slice(a, a + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(lang[b], pa.int32()), pa.array(bucket[b], pa.int32()), pa.array(total[lang[b], bucket[b]])], ["lang", "bucket", "n"])

    return run


def train(labelled: DataFrame, rows_per_language: int = 4000, max_languages: int = 256) -> Model:
    """Fits on a sample of labelled (text, lang) rows, by a hash of the text, of about rows_per_language rows of each language.

    To the driver comes a bounded table: a count per language, of which more than max_languages are an error, and bucket, of which
    there are 2 * 2 ** BITS and the scripts.
    """
    small_batches(labelled.sparkSession)
    labelled = labelled.select("text", "lang").where("lang is not null and text is not null")
    n = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).limit(max_languages + 1).collect()}
    if len(n) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    languages = sorted(n)
    if not languages:
        return Model((), np.zeros((1 << BITS, 0)), np.zeros((1 << BITS, 0)), np.zeros((len(SCRIPT_NAMES), 0), bool))
    share = F.create_map(*(F.lit(x) for s in languages for x in (s, min(1 << 30, (rows_per_language << 30) // n[s]))))
    sample = labelled.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < share[F.col("lang")])
    found = sample.mapInArrow(_counts(languages), "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((2 * (1 << BITS) + len(SCRIPT_NAMES), len(languages)))
    counts[found["bucket"].to_numpy(), found["lang"].to_numpy()] = found["n"].to_numpy()

    def scores(c: np.ndarray) -> np.ndarray:
        p = np.log((c + 0.5) / (c.sum(0) + 0.5 * len(c)))
        return ((p - p.mean(1, keepdims=True)) / 2).astype(np.float32)

    scripts = counts[2 << BITS :]
    return Model(tuple(languages), scores(counts[: 1 << BITS]), scores(counts[1 << BITS : 2 << BITS]), scripts > 0.01 * np.maximum(scripts.sum(0), 1))


def viterbi(s: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of each word: s[word, language], a change costing penalty. Ties keep the language, then take the first."""
    total = s.sum(0)
    best = int(total.argmax())
    gain = np.cumsum(s - s[:, best : best + 1], axis=0)
    low = np.minimum.accumulate(np.vstack([np.zeros((1, s.shape[1])), gain]), axis=0)[:-1]
    if (gain - low).max() <= penalty / 2:  # k runs of other languages need k - 1 changes at least
        return np.full(len(s), best)
    # a step is of plain numbers, which take less time than arrays of so few; STEPS of them are kept at once, and reckoned again on the way back
    starts, at = [], [0.0] * s.shape[1]
    for i in range(0, len(s), STEPS):
        starts.append(at)
        at, back = _steps(s[i : i + STEPS], at, penalty)
    path = np.empty(len(s), np.int64)
    own = at.index(max(at))
    for i in reversed(range(0, len(s), STEPS)):
        if i + STEPS < len(s):
            _, back = _steps(s[i : i + STEPS], starts[i // STEPS], penalty)
        for j in reversed(range(len(back))):
            path[i + j] = own
            own = back[j][own]
    return path


def _steps(s: np.ndarray, at: list[float], penalty: float) -> tuple[list[float], list[list[int]]]:
    """The best sums after the words of s, and for each word where the best path to each language came from."""
    back, stay = [], list(range(len(at)))
    for row in s.tolist():
        best = max(at)
        least = best - penalty
        if min(at) >= least:
            back.append(stay)
            at = [a + x for a, x in zip(at, row)]
        else:
            top = at.index(best)
            back.append([j if a >= least else top for j, a in enumerate(at)])
            at = [(a if a >= least else least) + x for a, x in zip(at, row)]
    return at, back


def predict(texts: list[str | None], model: Model, penalty: float) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """Per text: language, score, spans of (first word, word after the last, language)."""
    out: list = [("und", 0.0, [])] * len(texts)
    if not model.languages:
        return out
    own, first, text, script = letters_of(texts)
    if not len(first):
        return out
    once, starts, which = distinct(own, first)
    tri, four = features(once, starts)
    words = np.add.reduceat(model.tri[tri] + model.four[four], starts, axis=0).astype(np.float64)[which]
    allowed = model.allowed[script]
    words -= 50.0 * (~allowed & allowed.any(1, keepdims=True))
    letters = np.diff(np.append(first, len(own)))
    bounds = np.searchsorted(text, np.arange(len(texts) + 1))
    for i in np.flatnonzero(np.diff(bounds)).tolist():
        a, b = bounds[i], bounds[i + 1]
        path = viterbi(words[a:b], penalty)
        cut = np.flatnonzero(np.diff(path)) + 1
        edges = [0, *cut.tolist(), b - a]
        share = np.bincount(path, letters[a:b], len(model.languages))
        best = int(share.argmax())
        total = words[a:b][path == best].sum(0)
        margin = total[best] - np.delete(total, best).max() if len(total) > 1 else 30.0
        score = share[best] / share.sum() / (1 + np.exp(-min(max(margin, -30), 30)))
        out[i] = (model.languages[best], float(score), [(x, y, model.languages[path[x]]) for x, y in zip(edges[:-1], edges[1:], strict=True)])
    return out


def identify(docs: DataFrame, model: Model, penalty: float = 12.0) -> DataFrame:
    """doc_id, lang_pred, score and spans (array of first word, word after the last, language) of every document."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    spans = pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text", BLOCK):
                found = predict(part.column("text").to_pylist(), shared.value, penalty)
                told = [[{"first": a, "after": b, "lang": x} for a, b, x in f[2]] for f in found]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array(told, spans)], ["doc_id", "lang_pred", "score", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, spans array<struct<first: long, after: long, lang: string>>")


def keep_identified(docs: DataFrame, model: Model, penalty: float = 12.0, least: float = 0.2) -> DataFrame:
    """The rows whose language could be told: not `und`, and with a score of least or more. All columns stay."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text", BLOCK):
                found = predict(part.column("text").to_pylist(), shared.value, penalty)
                yield part.filter(pa.array([f[0] != "und" and f[1] >= least for f in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out() -> Column:
    """Is the remainder of crc32(doc_id as text) by 4 equal to 2; a null id isn't."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train_on(docs: DataFrame) -> Model:
    return train(docs.where(~held_out()))


@settled
def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, train_on(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
