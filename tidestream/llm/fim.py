"""Fill-in-middle transformation by a table-driven automaton over bytes.

One table, indexed by state and byte class, follows UTF-8 continuation, the begin of units and the sentinels at once; each
transition is counted for what it emits: a unit that begins, a sentinel that ends. A batch of texts is cut into blocks of bytes
which step side by side from every state that they could begin in; chaining the blocks' results by the state that each really
begins in gives the units and sentinels of every text from one scan. A second pass steps through those blocks alone in which cuts
fall, to find the byte at which the unit after the cut begins.

Cuts and form are drawn from a hash of doc_id: the prefix ends after the smaller and the middle after the larger of two numbers
of units. A text that holds a sentinel stays plain, so what is written can be read back: see `restored`.
"""

from __future__ import annotations

import bisect
import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidestream.llm import common as C

#: Sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred documents, those that stay plain, and of a hundred others those whose suffix comes first.
PLAIN, SUFFIX_FIRST = 10, 20
#: Bytes of a block.
BLOCK = 128
_SPACE = frozenset(b" \t\n\x0b\x0c\r")
_UNITS = (1 << 32) - 1


def _continued(left: int, byte: int) -> tuple[int, bool]:
    """Continuation bytes still to come after this one, and whether a character begins with it. A byte out of place is a character."""
    if left and 0x80 <= byte < 0xC0:
        return left - 1, False
    return (1 if 0xC0 <= byte < 0xE0 else 2 if 0xE0 <= byte < 0xF0 else 3 if 0xF0 <= byte < 0xF8 else 0), True


def _unit(kind: str, at: str, byte: int, begins: bool) -> tuple[str, bool]:
    """Where in a unit a text is after this byte, and whether a unit begins with it. A word takes the white space after it along, the
    first one that before it too; a line its line break."""
    if kind == "character":
        return at, begins
    if kind == "line":
        return ("new" if byte == 0x0A else "in"), at in ("start", "new")
    if byte in _SPACE:
        return ("lead" if at in ("start", "lead") else "new"), at == "start"
    return "in", at in ("start", "new")


class Automaton:
    """next state (times the number of classes) and counts (units, and sentinels << 32) by state and byte class."""

    def __init__(self, sentinels: Sequence[str], unit: str = "character"):
        marks = [s.encode() for s in sentinels]
        if unit not in ("character", "word", "line") or not all(marks):
            raise ValueError("units are characters, words or lines; sentinels are not empty")
        if any(a[k:] == b[: len(a) - k] for a in marks for b in marks for k in range(1, len(a))):
            raise ValueError("no sentinel may end with what another begins with")
        heads = {m[:k] for m in marks for k in range(len(m) + 1)}
        states: dict[tuple, int] = {(0, b"", "start"): 0}
        rows = []
        for left, seen, at in (todo := list(states)):  # grows while it is walked
            row = []
            for byte in range(256):
                left_, begins = _continued(left, byte)
                seen_ = seen + bytes([byte])
                while seen_ not in heads:
                    seen_ = seen_[1:]
                hit = any(seen_.endswith(m) for m in marks)
                at_, new = _unit(unit, at, byte, begins)
                state = (left_, b"" if hit else seen_, at_)
                if state not in states:
                    states[state] = len(states)
                    todo.append(state)
                row.append((states[state], int(new) + (int(hit) << 32)))
            rows.append(row)
        table = np.array(rows, np.int64)  # state, byte, (next, counts)
        kinds, self.classes = np.unique(table.transpose(1, 0, 2).reshape(256, -1), axis=0, return_inverse=True)
        self.classes = self.classes.reshape(-1).astype(np.int32)
        self.width, self.states = len(kinds) + 1, len(states)  # one class more: nothing there, which changes nothing
        table = kinds.reshape(len(kinds), self.states, 2).transpose(1, 0, 2)
        self.next = np.concatenate([table[:, :, 0], np.arange(self.states)[:, None]], 1).astype(np.int32).ravel() * self.width
        self.counts = np.concatenate([table[:, :, 1], np.zeros((self.states, 1), np.int64)], 1).ravel()


class Scan:
    """The texts data[offsets[i]:offsets[i + 1]] after the first pass: `units` and `hits` (sentinels) of each."""

    def __init__(self, automaton: Automaton, data: np.ndarray, offsets: np.ndarray):
        self.a, self.offsets = automaton, offsets
        size = np.diff(offsets)
        n = -(-size // BLOCK)
        self.first = np.concatenate(([0], np.cumsum(n)))  # a text's first block
        owner = np.repeat(np.arange(len(size)), n)
        self.start = offsets[owner] + (np.arange(len(owner)) - self.first[owner]) * BLOCK
        self.length = np.minimum(offsets[owner + 1] - self.start, BLOCK)
        self.classes = np.append(automaton.classes[data], np.full(BLOCK, automaton.width - 1, np.int32))
        state = np.broadcast_to(np.arange(automaton.states, dtype=np.int32) * automaton.width, (len(owner), automaton.states)).copy()
        total = np.zeros(state.shape, np.int64)
        for j in range(BLOCK if len(owner) else 0):
            at = state + self._class(j, self.start, self.length)[:, None]
            total += automaton.counts[at]
            state = automaton.next[at]
        ends, counts = (state // automaton.width).tolist(), total.tolist()
        self.begin, self.before = [0] * len(owner), [0] * len(owner)  # of each block its first state, and the text's units before it
        self.units, self.hits = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        for i, (a, b) in enumerate(zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True)):
            s = units = hits = 0
            for k in range(a, b):
                self.begin[k], self.before[k] = s, units
                c = counts[k][s]
                units, hits, s = units + (c & _UNITS), hits + (c >> 32), ends[k][s]
            self.units[i], self.hits[i] = units, hits

    def _class(self, j: int, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        return np.where(j < length, self.classes[start + j], np.int32(self.a.width - 1))

    def cuts(self, text: np.ndarray, units: np.ndarray) -> np.ndarray:
        """The second pass: the byte offsets in data after the first `units` units of each text (there may be several for one)."""
        out = self.offsets[text + 1].copy()
        inside = np.flatnonzero(units < self.units[text])
        block = np.array([bisect.bisect_right(self.before, u, self.first[t], self.first[t + 1]) - 1 for t, u in zip(text[inside].tolist(), units[inside].tolist(), strict=True)], np.int64)
        left = units[inside] - np.array([self.before[b] for b in block], np.int64)
        state = np.array([self.begin[b] for b in block], np.int32) * self.a.width
        start, length = self.start[block], self.length[block]
        found = np.full(len(block), -1, np.int64)
        for j in range(BLOCK if len(block) else 0):
            at = state + self._class(j, start, length)
            begins = self.a.counts[at] & _UNITS
            found[(begins > 0) & (left == 0) & (found < 0)] = j
            left = left - begins
            state = self.a.next[at]
        out[inside] = start + found
        return out


@functools.cache
def _automaton(sentinels: tuple[str, str, str], unit: str) -> Automaton:
    return Automaton(sentinels, unit)


_OUT = {"n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.binary()}


def _transform(batches: Iterator[pa.RecordBatch], sentinels: tuple[str, str, str], unit: str, plain: int, suffix_first: int) -> Iterator[pa.RecordBatch]:
    p, s, m = (x.encode() for x in sentinels)
    for batch in batches:
        data, offsets = C.text_buffer(batch.column(1))
        for i, j in C.pieces(offsets):
            part = data[offsets[i] : offsets[j]]
            where = offsets[i : j + 1] - offsets[i]
            scan = Scan(_automaton(sentinels, unit), part, where)
            digest = np.frombuffer("".join(batch.column(2).slice(i, j - i).to_pylist()).encode(), "S8").reshape(-1, 8)[:, :4]
            h = np.array([int(x, 16) for x in digest.ravel().tolist()], np.int64).reshape(-1, 4)
            a, b = np.sort(h[:, :2] % (scan.units + 1)[:, None], axis=1).T
            moved = np.flatnonzero((scan.units > 0) & (scan.hits == 0) & (h[:, 2] % 100 < 100 - plain))
            kind = np.where(h[:, 3] % 100 < suffix_first, 2, 1)
            form = np.zeros(j - i, np.int64)
            form[moved] = kind[moved]
            x, y = scan.cuts(moved, a[moved]), scan.cuts(moved, b[moved])
            cut = dict(zip(moved.tolist(), zip(x.tolist(), y.tolist(), strict=True), strict=True))
            raw = part.tobytes()
            out = []
            for r, f, lo, hi in zip(range(j - i), form.tolist(), where[:-1].tolist(), where[1:].tolist(), strict=True):
                if not f:
                    out.append(raw[lo:hi])
                    continue
                x, y = cut[r]
                parts = (p, raw[lo:x], s, raw[y:hi]) if f == 1 else (s, raw[y:hi], p, raw[lo:x])
                out.append(b"".join((*parts, m, raw[x:y])))
            stays = form == 0
            columns = [pa.array(scan.units), pa.array(np.array(["plain", "psm", "spm"], object)[form], pa.string()), pa.array(a, mask=stays), pa.array(b - a, mask=stays), pa.array(out, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *columns], names=["doc_id", *_OUT])


def transformed(docs: DataFrame, seed: str = "1:", unit: str = "character", plain: int = PLAIN, suffix_first: int = SUFFIX_FIRST, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """doc_id, n (units), form (plain, psm, spm), prefix_chars, middle_chars (units; null if plain), output of each row.

    unit: character, word or line. Null text: empty, so plain. A null doc_id draws as an empty one; equal doc_ids draw the same numbers.
    Each row is looked at by itself, whatever its length; columns other than doc_id and text are not looked at."""
    kind = dict(docs.dtypes)["doc_id"]
    drawn = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = docs.select("doc_id", "text", drawn.alias("drawn"))
    out = rows.mapInArrow(lambda it: _transform(it, sentinels, unit, plain, suffix_first), f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return out.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that an output was made from: what stands behind each sentinel, put in order."""
    p, s, m = (F.lit(x) for x in sentinels)

    def between(a: Column, b: Column | None) -> Column:
        rest = F.substring(output, F.instr(output, a) + F.length(a), F.length(output))
        return rest if b is None else F.substring(rest, F.lit(1), F.instr(rest, b) - 1)

    psm = F.concat(between(p, s), between(m, None), between(s, m))
    spm = F.concat(between(p, m), between(m, None), between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(rows: DataFrame) -> DataFrame:
    """rows of `transformed` with output_sha256 and restored_sha256 in place of the output."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.withColumns({"output_sha256": sha(F.col("output")), "restored_sha256": sha(restored(F.col("output"), F.col("form")))}).drop("output")
