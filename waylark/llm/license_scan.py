"""License scans by diagonal voting.

Templates (short phrases and longer notices) are cut into runs of k words. The hashes of all such runs of all documents are joined to
the templates' places; hits of one template whose document and template places differ by the same offset lie on one diagonal and add
up. Diagonals next to each other, as left by a word put in or left out, merge. Spans with enough votes are verified word for word: a
base phrase must stand there whole, a notice must share most of its words in order. The votes asked for are what a notice keeps that
passes with as many words changed as it may, and words put in or left out within the reach of the diagonals that merge.

Diagonals go by text, not by doc_id: copies of a text are reckoned once, and rows without an id or with another's are not mixed up.

Defined results: a null or empty text has no words, places or labels, and score 0; rows that repeat a doc_id are each judged by their
own text; a null doc_id is judged too; an empty table gives no rows. Places that overlap count each, and of equally good notices all
give their labels. A very long text is read in whole, in pieces; it carries a span for each place where a template may stand, and only
those are spelt out. Columns other than doc_id and text are not read, so none can clash.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waylark.llm.common import BROADCAST_MOST, SYMBOL, Spelt, _raw, blocks, row_grams, settled, signed, small_batches, staged, text_key, word_counts, word_hashes

#: Base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Openings of public license notices, and their labels.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("licensed under the apache license version 2 0", "apache"),
    ("released under the mit license", "mit"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("this work is licensed under the gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("this work is licensed under a creative commons attribution", "cc"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by 4 0", "cc-by"),
)
SHORT, LONG = 2, 3
#: Diagonals at most so far apart merge; a notice of WHOLE words or more needs this share of them, in order, from APART words before its
#: diagonal to APART after it; a shorter one must stand whole.
APART, LEAST, WHOLE = 2, 0.8, 10


def _hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All runs of SHORT and of LONG words: the text's key, place, hash."""
    for batch in batches:
        for part in blocks(batch, "text", 1 << 20):
            hashes, offsets = word_hashes(part.column("text"), SYMBOL)
            for k in (SHORT, LONG):
                g, rows, place = row_grams(hashes, offsets, k)
                keys = [part.column(h).take(pa.array(rows)) for h in ("h1", "h2")]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(place.astype(np.int64)), signed(g ^ np.uint64(k))], ["h1", "h2", "place", "gram"])


def votes_needed(n: int) -> int:
    """Runs of LONG words that a notice of n words keeps, all if it must stand whole."""
    if n < WHOLE:
        return n - LONG + 1
    changed = n - int(np.ceil(LEAST * n))
    return max(1, n - LONG + 1 - LONG * changed - (LONG - 1) * APART)


def template_places(spark, base: Sequence[tuple[str, str]], notices: Sequence[tuple[str, str]]) -> DataFrame:
    """gram, template, its place there, and the votes it takes: a row per run of words of each template, a number fixed by the parameters."""
    rows = []
    for i, (text, _) in enumerate([*base, *notices]):
        k = SHORT if i < len(base) else LONG
        hashes, offsets = word_hashes(pa.array([text]), SYMBOL)
        g, _, place = row_grams(hashes, offsets, k)
        if not len(g):
            raise ValueError(f"a template of fewer than {k} words: {text!r}")
        need = len(g) if i < len(base) else votes_needed(len(hashes))
        rows += [(int((x ^ np.uint64(k)).view(np.int64)), i, int(p), need) for x, p in zip(g, place, strict=True)]
    return spark.createDataFrame(rows, "gram long, template int, t_place long, need int")


def in_order(wanted: list[bytes], found: list[bytes]) -> int:
    """The length of the longest sequence of words that both have, in order: a bit for each wanted word, cleared when it is reached."""
    at: dict[bytes, int] = {}
    for i, x in enumerate(wanted):
        at[x] = at.get(x, 0) | 1 << i
    all_ = (1 << len(wanted)) - 1
    left = all_
    for x in found:
        if here := left & at.get(x, 0):
            left = ((left + here) | (left - here)) & all_
    return len(wanted) - left.bit_count()


def _verify(base: Sequence[tuple[str, str]], notices: Sequence[tuple[str, str]]):
    spelt = lambda t: Spelt(t.encode(), SYMBOL)
    wanted = [spelt(t)[0 : len(t)] for t, _ in [*base, *notices]]
    label = [x for _, x in [*base, *notices]]

    def judge(raw: bytes, spans: list[dict]) -> tuple:
        w = Spelt(raw, SYMBOL)
        places, labels, best, told = [], set(), 0.0, 0
        for s in spans:
            t, at = wanted[s["template"]], s["at"]
            if s["template"] < len(base):
                if at >= 0 and w[at : at + len(t)] == t:
                    places.append((at, label[s["template"]]))
                continue
            alike = float(w[at : at + len(t)] == t) if len(t) < WHOLE else in_order(t, w[at - APART : at + len(t) + APART]) / len(t)
            if alike >= LEAST:
                labels.add(label[s["template"]])
                best, told = max(best, alike), told + 1
        at, own = [a for a, _ in places], {x for _, x in places}
        return len(places), min(at, default=None), max(at, default=None), ",".join(sorted(own)), ",".join(sorted(own | labels)), 1.0 if places else best, told

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _raw(batch.column("text"))
            spans = batch.column("spans").to_pylist()
            out = [judge(data[offsets[i] : offsets[i + 1]].tobytes(), s) if s else (0, None, None, "", "", 0.0, 0) for i, s in enumerate(spans)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64())
            cols = list(zip(*out, strict=True)) or [()] * len(kinds)
            told = [pa.array(list(x), k) for x, k in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(word_counts(batch.column("text"), SYMBOL)), *told],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_notices"])

    return run


def scan(docs: DataFrame, base: Sequence[tuple[str, str]] = BASE, notices: Sequence[tuple[str, str]] = NOTICES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_notices of every document."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text", *text_key(F.col("text")))
    places = F.broadcast(template_places(spark, base, notices))  # as many rows as the templates given have words
    hits = docs.select("h1", "h2", "text").mapInArrow(_hits, "h1 long, h2 long, place long, gram long").join(places, "gram")
    # a text has a diagonal per place at most; what is gathered by text are the spans that got their votes
    diagonals = hits.groupBy("h1", "h2", "template",
        (F.col("place") - F.col("t_place")).alias("diagonal")).agg(F.countDistinct("t_place").alias("votes"), F.max("need").alias("need"))
    near = [F.struct((F.col("diagonal") + d).alias("at"), F.lit(d == 0).alias("own")) for d in range(-APART, APART + 1)]
    merged = diagonals.withColumn("x", F.explode(F.array(*near))).groupBy("h1", "h2", "template", F.col("x.at").alias("at"))
    merged = merged.agg(F.sum("votes").alias("votes"), F.max("need").alias("need"), F.max("x.own").alias("own")).where("own and votes >= need")
    spans = merged.groupBy(F.col("h1").alias("g1"), F.col("h2").alias("g2")).agg(F.sort_array(F.collect_set(F.struct("template", "at"))).alias("spans"))
    spans = staged(spans, "license-spans")
    few = spans.agg(F.count("*").alias("n"), F.sum(F.size("spans")).alias("s")).first()
    spans = F.broadcast(spans) if few["n"] <= BROADCAST_MOST and (few["s"] or 0) <= 10 * BROADCAST_MOST else spans
    found = docs.join(spans, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")), "left").select("doc_id", "text", "spans")
    return found.mapInArrow(_verify(base, notices),
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_notices long")


@settled
def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
