"""Token counts of a unigram tokenizer, by a Viterbi pass that carries scores and counts only.

An Aho-Corasick automaton over the vocabulary enumerates all pieces in a word, those that end at one place with the longest first; for
each end the best score and its number of pieces are kept. Ties go to the piece that begins first, which is the tokenizer's rule, as
only a greater score replaces one; a character that is no piece costs the least score of the vocabulary less 10; unknown characters
on end count as one piece. Texts are split at white space, and each word gets a word-begin mark, so counts of words add up and are kept.

The vocabulary's pieces come from a public file; their scores are set to the negative logarithm of rank + 2.

Scores are held for as many ends as the longest piece has characters, so a word takes no more memory than its text, however long.

Defined results: a null or empty text, or one of white space, has no tokens; repeated rows each get their count; an empty table gives
no rows; very long texts are split and counted in whole. Columns other than doc_id and text are not read, so none can clash.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from waylark.llm.common import blocks, settled, small_batches

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNKNOWN = "<unk>"
#: Words whose counts a worker keeps.
KEPT = 400_000
_NOT_SPACE = re.compile("[\x1c-\x1f]")
_built: dict = {}


def vocabulary(path: str = VOCABULARY) -> list[tuple[str, float]]:
    """(piece, score), the unknown piece first."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    scored = [(p, -math.log(i + 2)) for i, p in enumerate(dict.fromkeys(pieces))]
    return [(UNKNOWN, min(s for _, s in scored)), *scored]


class Counts(dict):
    """Number of pieces of a word, reckoned when first asked for."""

    def __init__(self, pieces: list[tuple[str, float]]):
        import ahocorasick

        self.trie = ahocorasick.Automaton()
        for i, (piece, score) in enumerate(pieces):
            self.trie.add_word(piece, (len(piece), score, i == 0))
        self.trie.make_automaton()
        self.unknown = min(s for _, s in pieces) - 10
        self.longest = max(len(p) for p, _ in pieces)

    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT:
            self.clear()
        if MARK in word:  # the mark itself begins a word
            word_ = word if word.startswith(MARK) else MARK + word
            found = sum(map(self.count, re.findall(f"{MARK}[^{MARK}]*", word_)))
        else:
            found = self.count(MARK + word)
        if len(word) <= 40:
            self[word] = found
        return found

    def count(self, text: str) -> int:
        ring, trie, penalty = self.longest + 1, self.trie, self.unknown
        score: list[float | None] = [None] * ring
        count, unknown = [0] * ring, [False] * ring
        score[0] = 0.0
        at, single = 1, False  # the end whose matches are being read; has it one of a single character

        def close() -> None:
            """After the matches of an end: the single character, if it is no piece; then the next end is open."""
            nonlocal at, single
            own, before = at % ring, (at - 1) % ring
            if not single:
                new = score[before] + penalty
                if score[own] is None or new > score[own]:
                    score[own], count[own], unknown[own] = new, count[before] + (not unknown[before]), True
            at, single = at + 1, False
            score[at % ring] = None

        for end, (length, own, is_unknown) in trie.iter(text):
            while at <= end:
                close()
            single |= length == 1
            here, before = at % ring, (at - length) % ring
            new = score[before] + own
            if score[here] is None or new > score[here]:
                score[here], count[here], unknown[here] = new, count[before] + (not (is_unknown and unknown[before])), is_unknown
        while at <= len(text):
            close()
        return count[len(text) % ring]


def _words(text: str) -> list[str]:
    """Split at Unicode white space; the separators U+001C to U+001F aren't."""
    if not _NOT_SPACE.search(text):
        return text.split()
    return [w for w in re.split("[\t-\r \x85\xa0  -     　]+", text) if w]


def count_tokens(docs: DataFrame, pieces: list[tuple[str, float]]) -> DataFrame:
    """doc_id, n_tokens, n_words of every document."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    key = hash(tuple(pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _built:
            _built.clear()
            _built[key] = Counts(shared.value)
        of = _built[key].__getitem__
        for batch in batches:
            for part in blocks(batch, "text"):
                split = [_words(t or "") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([sum(map(of, w)) for w in split], pa.int64()),
                    pa.array([len(w) for w in split], pa.int64())], ["doc_id", "n_tokens", "n_words"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, n_words long")


@settled
def op9_token_count(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary())
