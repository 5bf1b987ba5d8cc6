"""Chat formatting by incremental black-box rendering.

A template is a function from a list of (role, text) to a string, and nothing else of it is known. Each turn's span is what rendering
one turn more adds to the output before. Where the text stands in the span is found by rendering the turn twice more with probes in its
place: what both have in common before and after the probe is the template's own. Templates are told to rewrite history where an
output does not begin with the one before. Outputs are those of the whole conversation so far, which is held for it. Only a template
declared append-only (an attribute `append_only`, as `marked` has) is rendered over its last CONTEXT turns, and only those are held,
however long a conversation; the added text must then be the same with one turn of context less, else it counts as rewriting too.

Turns stream by conversation in the order of turn, role and text. Formatted turns are read back in pieces of PIECE characters.

Defined results: a null text or role is empty; a null conv_id is a conversation of its own; turns with the same number go by role and
text; repeated rows are turns of their own; a very long text is rendered in whole, some times over, and read back in pieces; an empty
table gives no rows. Columns other than conv_id, turn, role and text are not read, so none can clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waylark.llm.common import settled, small_batches, staged

Turns = list[tuple[str, str]]
CONTEXT = 6
ROWS = 200
PIECE = 1 << 20
_PROBES = ("a0x", "b1y")  # alike nowhere
TURN = "conv_id long, turn_no long, role string, chunk string, text_start long, text_end long, start long, loss boolean, rewrites boolean"


def marked(turns: Turns) -> str:
    """The template of the query: a head with the role, the text, an end mark; a backslash before what could be read as one of them."""
    head = lambda role: re.sub(r"([\\#<:\n])", r"\\\1", role)
    body = lambda text: text.replace("\\", "\\\\").replace("#", "\\#").replace("<", "\\<")
    return "".join(f"### {head(role)}:\n{body(text)}\n</turn>\n" for role, text in turns)


marked.append_only = True  # each turn's text depends on that turn only


def unescaped(text: str, start: int = 0, end: int | None = None) -> Iterator[str]:
    """text[start:end] without the backslashes before other characters, in pieces."""
    end = len(text) if end is None else end
    while start < end:
        part = text[start : min(end, start + PIECE)]
        if (len(part) - len(part.rstrip("\\"))) % 2:  # a backslash stays with what follows it
            part = text[start : min(end, start + PIECE + 1)]
        yield re.sub(r"\\(.)", r"\1", part, flags=re.DOTALL)
        start += len(part)


_HEAD = re.compile(r"\\.|[\\#<:\n]", re.DOTALL)
_BODY = re.compile(r"\\.|[\\#<]", re.DOTALL)
_START, _MIDDLE, _END = "### ", ":\n", "\n</turn>\n"


def parted(chunk: str) -> tuple[int, int, int]:
    """Where the role ends, and where the text begins and ends, in a turn as `marked` writes it; what is no such turn is an error."""
    head = next((m.start() for m in _HEAD.finditer(chunk, len(_START)) if m.group()[0] != "\\" or len(m.group()) == 1), -1)
    first = head + len(_MIDDLE)
    if not chunk.startswith(_START) or head < 0 or not chunk.startswith(_MIDDLE, head):
        raise ValueError(f"no turn: {chunk[:40]!r}")
    end = next((m.start() for m in _BODY.finditer(chunk, first) if m.group()[0] != "\\" or len(m.group()) == 1), -1) - 1
    if end < first or chunk[end:] != _END:
        raise ValueError(f"a turn that doesn't end: {chunk[-40:]!r}")
    return head, first, end


def _common(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    return low


def added(render: Callable[[Turns], str], before: Turns, turn: tuple[str, str]) -> tuple[str, int, int, bool]:
    """What one turn more adds, where its text begins and ends there, and whether the output before changed."""
    old, new = render(before), render([*before, turn])
    a, b = (render([*before, (turn[0], p)]) for p in _PROBES)
    rewrites = not (new.startswith(old) and a.startswith(old) and b.startswith(old))
    at = len(old) if not rewrites else _common(old, new)
    head, tail = _common(a, b), _common(a[::-1], b[::-1])
    return new[at:], max(0, head - at), max(0, max(head, len(new) - tail) - at), rewrites


def _format(render: Callable[[Turns], str], loss_role: str):
    context = CONTEXT if getattr(render, "append_only", False) else 0  # 0: all turns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, held, no, start = object(), [], 0, 0
        for batch in batches:
            out = []
            for c, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "role", "text")), strict=True):
                if c != conv:
                    conv, held, no, start = c, [], 0, 0
                turn = (role or "", text or "")
                chunk, a, b, rewrites = added(render, held, turn)
                if no > len(held) and not rewrites:
                    rewrites = added(render, held[1:], turn)[0] != chunk
                out.append((c, no, turn[0], chunk, a, b, start, turn[0] == loss_role, rewrites))
                held, no, start = [*held, turn][-context:], no + 1, start + len(chunk)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_())
            cols = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(cols, kinds, strict=True)],
                ["conv_id", "turn_no", "role", "chunk", "text_start", "text_end", "start", "loss", "rewrites"])

    return run


def formatted(conversations: DataFrame, render: Callable[[Turns], str] = marked, loss_role: str = "assistant") -> DataFrame:
    """Per turn: its chunk of the formatted conversation, which begins at `start`; where its text stands in the chunk; whether it is under the loss mask."""
    small_batches(conversations.sparkSession, ROWS)
    turns = conversations.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return turns.mapInArrow(_format(render, loss_role), TURN)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per conversation the digests of what is read from its chunks, which come in order."""
    conv, state = object(), None

    def told(c, s) -> tuple:
        return c, s["n"], s["turns"].hexdigest(), s["loss_n"], s["loss"].hexdigest(), s["chars"]

    for batch in batches:
        done = []
        for r in batch.to_pylist():
            if r["conv_id"] != conv:
                if state is not None:
                    done.append(told(conv, state))
                conv, state = r["conv_id"], {"n": 0, "turns": hashlib.sha256(), "loss_n": 0, "loss": hashlib.sha256(), "chars": 0}
            chunk = r["chunk"]
            head, first, end = parted(chunk)
            state["n"] += 1
            state["chars"] += len(chunk)
            for pieces in (unescaped(chunk, len(_START), head), "\n", unescaped(chunk, first, end), "\n"):
                for x in pieces:
                    state["turns"].update(x.encode("utf-8", "surrogatepass"))
            if r["loss"]:
                for x in unescaped(chunk, r["text_start"], r["text_end"]):
                    state["loss_n"] += len(x)
                    state["loss"].update(x.encode("utf-8", "surrogatepass"))
        if done:
            yield _digest_rows(done)
    if state is not None:
        yield _digest_rows([told(conv, state)])


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)],
        ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


@settled
def op6_chat_format(spark, sf_dir: str) -> DataFrame:
    probe = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").union(more)
    table = staged(formatted(turns), "formatted")
    in_order = table.select("conv_id", "turn_no", "chunk", "text_start", "text_end", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "turn_no")
    return in_order.mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
