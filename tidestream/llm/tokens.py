"""Token counts of a word-level BPE vocabulary, by merging with a heap and a linked list; no identifiers are made.

The vocabulary file gives the merges, the pattern of a word and the special strings. A word's count is its initial
symbols less its merges. White space always ends a word, so counts add up over pieces between white space; each task
keeps those of pieces it has met, up to a bound.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Above how many tokens a document is over the limit.
LIMIT = 2048
#: Pieces whose counts a task keeps, and their greatest length.
KEPT_PIECES, KEPT_LENGTH = 400_000, 48

# Letters and numbers of `regex` that the library's pattern does not know yet, and lower cases of the library that Python does not.
NEWER = "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f"
LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B} | {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
_NEWER = "".join("-".join(chr(int(x, 16)) for x in part.split("-")) for part in NEWER.split())
#: Before this character the two agree.
_FIRST = min(_NEWER.replace("-", ""))


def merged_length(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """How many symbols are left once adjacent pairs have been merged, always the pair of lowest rank, leftmost first."""
    last = len(symbols) - 1
    after, before = list(range(1, last + 2)), list(range(-1, last))
    symbols = list(symbols)
    heap = [(ranks[p], i, *p) for i in range(last) if (p := (symbols[i], symbols[i + 1])) in ranks]
    heapq.heapify(heap)
    left = len(symbols)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != a or j > last or symbols[j] != b:
            continue  # one of the two has been merged meanwhile
        symbols[i], symbols[j] = a + b, ""
        left -= 1
        after[i] = k = after[j]
        if k <= last:
            before[k] = i
            if (p := (a + b, symbols[k])) in ranks:
                heapq.heappush(heap, (ranks[p], i, *p))
        if (h := before[i]) >= 0 and (p := (symbols[h], a + b)) in ranks:
            heapq.heappush(heap, (ranks[p], h, *p))
    return left


def _byte_symbols() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, others for the next from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class TokenCounter(dict):
    """Counts of pieces without white space, by piece."""

    def __init__(self, vocabulary: str):
        super().__init__()
        spec = json.loads(vocabulary)
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(spec["model"]["merges"])}
        self.known = set(spec["model"]["vocab"])
        self.end = spec["model"]["end_of_word_suffix"] or ""
        word = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.word = regex.compile(word)
        self.newer = regex.compile(f"[{_NEWER}]")
        less = lambda kind: f"[{kind}--[{_NEWER}]]"
        self.older_word = regex.compile(word.replace(r"\p{L}", less(r"\p{L}")).replace(r"\p{N}", less(r"\p{N}")), regex.V1)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.symbols = _byte_symbols()

    def __missing__(self, piece: str) -> int:
        plain = unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()
        pattern = self.word
        if not plain.isascii() and max(plain) >= _FIRST:
            plain = plain.translate(LOWER)
            pattern = self.older_word if self.newer.search(plain) else pattern
        total = 0
        for word in pattern.findall(plain):
            symbols = [self.symbols[b] for b in word.encode()]
            symbols[-1] += self.end
            total += merged_length([s for s in symbols if s in self.known], self.ranks)
        if len(piece) <= KEPT_LENGTH:
            if len(self) >= KEPT_PIECES:
                self.clear()
            self[piece] = total
        return total

    def count(self, text: str) -> int:
        found = 0
        if self.special and "<|" in text:
            parts = self.special.split(text)
            found, text = len(parts) - 1, None
        else:
            parts = [text]
        for part in parts:
            # str.split also splits at four control characters that the pattern does not hold for white space
            pieces = regex.split(r"\p{White_Space}+", part) if any(c in part for c in "\x1c\x1d\x1e\x1f") else part.split()
            found += sum(map(self.__getitem__, pieces))
        return found


_COUNTERS: dict[str, TokenCounter] = {}


def _counts(batches, vocabulary, limit: int):
    key = vocabulary.value
    counter = _COUNTERS.get(key) or _COUNTERS.setdefault(key, TokenCounter(key))
    for batch in batches:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        n = [counter.count(t) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
            names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
        )


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of each row. path: a vocabulary file of that
    kind, read on the driver; its size does not depend on the documents.

    Null or blank text: 0 bytes or those it has, 0 tokens. Special strings inside texts count as one token each. Rows with
    equal doc_id are counted each; other columns are not looked at."""
    with open(path, encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())
    return docs.select("doc_id", "text").mapInArrow(lambda it: _counts(it, vocabulary, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
