"""Substring dedup by super-k-mers: removing every word of a window of words that an earlier document also holds.

Each task hashes its documents' words and first settles what it can alone: of the windows equal within one
chunk of documents, all but those of the smallest doc_id are repeats whatever the rest of the corpus holds.
So one occurrence per chunk is all that a window, however frequent, sends on. The remaining windows get the
least hash of their word triples as minimiser, and consecutive windows of one document with the same minimiser
travel as one packed string (the text from the first window's first word to the last one's last) to the bucket of
that minimiser. Triples so frequent that they would overfill a bucket (by a sample of each chunk's) rank behind all others, so that windows
around them spread by their other triples; windows of nothing but such triples go by a hash of all their words. In a bucket, sorting brings equal windows together; their words are compared, so a window
hash shared by different windows does not count. Ranges of repeated windows then meet their documents: by doc_id and, where several rows
have one doc_id, by a hash of the text.

Words are told apart by 64-bit hashes. A bucket's memory is its share of the corpus over
`buckets`; a chunk's is `chunk_words` words or one document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidestream.llm import common as C

#: Words of a window, words whose hash competes to be the minimiser, words of a task's chunk.
WINDOW, MINIMISER, CHUNK_WORDS = 13, 3, 1 << 20
#: Buckets per shuffle partition: a task holds one bucket at a time. A triple is frequent if its windows would fill so many buckets.
BUCKETS_PER_PARTITION, OVERFULL = 4, 4
#: Triples of a chunk that are looked at to find the frequent ones. Which ones are found changes where windows travel, not what is found.
SAMPLED = 256
_TOP = np.uint64(1 << 63)


def _same(code: np.ndarray, a: np.ndarray, b: np.ndarray, window: int) -> np.ndarray:
    """Whether the windows that begin at words a and b have equal words."""
    out = np.ones(len(a), bool)
    for k in range(window):
        out &= code[a + k] == code[b + k]
    return out


def repeated(code: np.ndarray, at: np.ndarray, doc: np.ndarray, window: int) -> np.ndarray:
    """For windows beginning at words `at` of documents `doc`: whether a smaller document holds the same window."""
    hashed = np.zeros(0, np.uint64) if not len(at) else C.window_codes(code, window)[at]
    second = None
    for shift in range(1, 40):
        order = np.argsort(hashed, kind="stable") if second is None else np.lexsort((second, hashed))
        by = hashed[order]
        new = np.ones(len(by), bool)
        new[1:] = by[1:] != by[:-1]
        if second is not None:
            new[1:] |= second[order][1:] != second[order][:-1]
        alike = np.flatnonzero(~new)
        if _same(code, at[order[alike - 1]], at[order[alike]], window).all():
            break
        second = C.window_codes(code, window, shift + 1)[at]  # two different windows share a hash: tell them apart by another
    out = np.zeros(len(at), bool)
    if len(at):
        begin = np.flatnonzero(new)
        least = np.minimum.reduceat(doc[order], begin)
        out[order] = doc[order] > np.repeat(least, np.diff(np.append(begin, len(by))))
    return out


def _runs(mask_at: np.ndarray, *same: np.ndarray) -> np.ndarray:
    """Where runs of consecutive positions, with equal values in `same`, begin."""
    new = np.ones(len(mask_at), bool)
    new[1:] = np.diff(mask_at) != 1
    for x in same:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _pack(arrays: list[np.ndarray], text: bytes) -> bytes:
    return zstandard.compress(b"".join([len(arrays[0]).to_bytes(8, "little"), *(a.astype("<i8").tobytes() for a in arrays), text]), 3)


def _unpack(blob: bytes, arrays: int) -> tuple[list[np.ndarray], bytes]:
    raw = zstandard.decompress(blob)
    n = int.from_bytes(raw[:8], "little")
    return [np.frombuffer(raw, "<i8", n, 8 + 8 * n * k) for k in range(arrays)], raw[8 + 8 * n * arrays :]


def _triples(code: np.ndarray, window: int) -> np.ndarray:
    return C.window_codes(code, min(MINIMISER, window), 20)


def _sampled(batches, window: int, chunk_words: int):
    """(code, n, seen, words): the triples at SAMPLED words of each chunk, drawn by its own words, with how many they stand for and how often
    they were drawn; and of each chunk its words."""
    for batch in batches:
        data, offsets = C.text_buffer(batch.column(0))
        for i, j in C.pieces(offsets, 6 * chunk_words):
            parts = [C.words(data[offsets[i + a] : offsets[i + b]], offsets[i + a : i + b + 1] - offsets[i + a])[3] for a, b in C.pieces(offsets[i : j + 1] - offsets[i])]
            triples = _triples(code := np.concatenate(parts), window)
            if len(triples) > SAMPLED:
                triples = triples[np.random.Generator(np.random.PCG64([int(code[0]), len(code)])).integers(0, len(triples), SAMPLED)]
            triple, seen = np.unique(triples, return_counts=True)
            stands = len(code) // max(1, len(triples))
            columns = np.append(triple, np.uint64(0)).view(np.int64), np.append(seen * stands, 0), np.append(seen, 0), np.append(np.zeros(len(seen), np.int64), len(code))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["code", "n", "seen", "words"])


def frequent(texts: DataFrame, window: int, buckets: int, chunk_words: int) -> np.ndarray:
    """The triples that are frequent over all texts, sorted: at most 6 for each bucket. A triple may be taken for frequent from half the share on."""
    share = OVERFULL / (buckets * (window - min(MINIMISER, window) + 1)) / 2
    sums = [F.sum(c).alias(c) for c in ("n", "seen", "words")]
    found = C.checkpointed(texts.mapInArrow(lambda it: _sampled(it, window, chunk_words), "code long, n long, seen long, words long").groupBy("code").agg(*sums))
    total = found.agg(F.sum("words")).first()[0] or 0
    hot = found.filter((F.col("seen") > 1) & (F.col("n") >= share * total)).select("code").collect()
    return np.sort(np.array([r.code for r in hot], np.int64).view(np.uint64))


def _super_kmers(ids: np.ndarray, twins: np.ndarray, data: np.ndarray, offsets: np.ndarray, window: int, buckets: int, hot: np.ndarray) -> Iterator[tuple[int, int, int, bytes]]:
    """Of one chunk of documents: (bucket, 0, 0, packed super-k-mers), and (a key below 0, doc_id, twin, word ranges already settled)."""
    parts = [(C.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), i, offsets[i]) for i, j in C.pieces(offsets)]
    start, end = (np.concatenate([p[0][k] + p[2] for p in parts]) for k in (0, 1))
    row, code = np.concatenate([p[0][2] + p[1] for p in parts]), np.concatenate([p[0][3] for p in parts])
    if len(code) < window:
        return
    at = np.flatnonzero(row[: len(row) - window + 1] == row[window - 1 :])
    if not len(at):
        return
    first = np.searchsorted(row, np.arange(len(ids)))  # the first word of each row
    doc = ids[row[at]]
    gone = repeated(code, at, doc, window)
    done = at[gone]
    if len(done):
        begin = _runs(done, row[done])
        length = np.diff(np.append(begin, len(done)))
        rows = row[done[begin]]
        for a, b in zip(edge := np.flatnonzero(np.diff(rows, prepend=-1)), np.append(edge[1:], len(rows)), strict=True):
            r = rows[a]
            yield -1 - int(ids[r]) % buckets, int(ids[r]), int(twins[r]), np.stack([done[begin[a:b]] - first[r], length[a:b]]).astype("<i8").tobytes()
    left = at[~gone]
    if not len(left):
        return
    small = _triples(code, window)
    if len(hot):
        late = hot[np.minimum(np.searchsorted(hot, small), len(hot) - 1)] == small
        small = np.where(late, small | _TOP, small & ~_TOP)
    span, have = window - min(MINIMISER, window) + 1, 1
    while have < span:  # least of `span` consecutive values, by doubling
        step = min(have, span - have)
        small = np.minimum(small[:-step], small[step:]) if step else small
        have += step
    least = small[left]
    if len(hot) and (alone := least >= _TOP).any():
        least[alone] = C.window_codes(code, window, 30)[left[alone]]
    begin = _runs(left, row[left], least)
    count = np.diff(np.append(begin, len(left)))
    w0 = left[begin]
    s, e = start[w0], end[w0 + count + window - 2]
    bucket = (C.mix(least[begin] ^ np.uint64(0x5BF03635)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    arrays = [a[order] for a in (ids[row[w0]], twins[row[w0]], w0 - first[row[w0]], count, e - s)]
    s, e, bucket = s[order], e[order], bucket[order]
    view = memoryview(np.ascontiguousarray(data)).cast("B")
    edge = np.flatnonzero(np.diff(bucket, prepend=-1))
    for a, b in zip(edge, np.append(edge[1:], len(bucket)), strict=True):
        yield int(bucket[a]), 0, 0, _pack([x[a:b] for x in arrays], b"".join([view[x:y] for x, y in zip(s[a:b].tolist(), e[a:b].tolist(), strict=True)]))


def _send(batches, window: int, buckets: int, chunk_words: int, hot: np.ndarray):
    schema = pa.schema([("bucket", pa.int64()), ("doc_id", pa.int64()), ("twin", pa.int64()), ("packed", pa.binary())])

    def flush(held):
        table = pa.Table.from_batches(held).combine_chunks()
        data, offsets = C.text_buffer(table.column("text").combine_chunks())
        out = list(_super_kmers(table.column("doc_id").to_numpy(), table.column("twin").to_numpy(), data, offsets, window, buckets, hot))
        for k in range(0, len(out), 512):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out[k : k + 512], strict=True), schema.types, strict=True)], schema=schema)

    held, size = [], 0
    for batch in batches:
        for i, j in C.pieces(C.text_buffer(batch.column(1))[1], 6 * chunk_words):
            held.append(batch.slice(i, j - i))
            size += held[-1].column(1).nbytes
            if size >= 6 * chunk_words:
                yield from flush(held)
                held, size = [], 0
    if held:
        yield from flush(held)


def _settle(blobs: list[bytes], window: int) -> Iterator[tuple[int, int, bytes]]:
    """Of one bucket: (doc_id, twin, ranges of its windows that a smaller document holds)."""
    found = [_unpack(b, 5) for b in blobs]
    doc, twin, pos, count, size = (np.concatenate([x[0][k] for x in found]) for k in range(5))
    data = np.frombuffer(b"".join(x[1] for x in found), np.uint8)
    offsets = np.concatenate(([0], np.cumsum(size)))
    codes = [C.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[3] for i, j in C.pieces(offsets)]
    code = np.concatenate(codes)
    n_words = count + window - 1
    first = np.cumsum(n_words) - n_words
    owner = np.repeat(np.arange(len(count)), count)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + first[owner]
    gone = np.flatnonzero(repeated(code, at, doc[owner], window))
    if not len(gone):
        return
    begin = _runs(gone, owner[gone])
    length = np.diff(np.append(begin, len(gone)))
    own = owner[gone[begin]]
    where = pos[own] + at[gone[begin]] - first[own]
    order = np.lexsort((twin[own], doc[own]))
    docs, twins, where, length = doc[own][order], twin[own][order], where[order], length[order]
    edge = np.flatnonzero(np.append(True, (docs[1:] != docs[:-1]) | (twins[1:] != twins[:-1])))
    for a, b in zip(edge, np.append(edge[1:], len(docs)), strict=True):
        yield int(docs[a]), int(twins[a]), np.stack([where[a:b], length[a:b]]).astype("<i8").tobytes()


def _receive(batches, window: int):
    """Rows come sorted by bucket; settled ranges pass through."""
    schema = pa.schema([("doc_id", pa.int64()), ("twin", pa.int64()), ("ranges", pa.binary())])

    def out(pairs):
        pairs = list(pairs)
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], t) for k, t in enumerate(schema.types)], schema=schema)

    bucket, blobs = None, []
    for batch in batches:
        passing = []
        for b, doc, twin, packed in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if b < 0:
                passing.append((doc, twin, packed))
                continue
            if b != bucket and blobs:
                yield from out(_settle(blobs, window))
                blobs = []
            bucket = b
            blobs.append(packed)
        yield from out(passing)
    if blobs:
        yield from out(_settle(blobs, window))


def _told_apart(docs: DataFrame) -> DataFrame:
    """docs with __twin: 0, but a hash of its text for a row whose doc_id others have too. These doc_ids are few as a rule, and found first."""
    several = C.checkpointed(docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id", F.lit(True).alias("__several")))
    if several.isEmpty():
        return docs.withColumn("__twin", F.lit(0).cast("long"))
    marked = C.left_join_small(docs, several, "doc_id", F.monotonically_increasing_id())
    return marked.withColumn("__twin", F.when(F.col("__several"), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))).drop("__several")


def repeats(docs: DataFrame, window: int = WINDOW, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """(doc_id, twin, ranges): packed pairs of first word and number of windows that an earlier document also holds. docs: as `_told_apart`
    has them."""
    n = C.shuffle_partitions(docs.sparkSession)
    buckets = BUCKETS_PER_PARTITION * n
    docs = docs.filter("doc_id is not null").select("doc_id", "text", F.col("__twin").alias("twin"))
    hot = docs.sparkSession.sparkContext.broadcast(frequent(docs.select("text"), window, buckets, chunk_words))
    sent = docs.mapInArrow(lambda it: _send(it, window, buckets, chunk_words, hot.value), "bucket long, doc_id long, twin long, packed binary")
    dealt = sent.repartition(n, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(lambda it: _receive(it, window), "doc_id long, twin long, ranges binary")


def _kept(text: bytes, ranges: list[bytes] | None, window: int) -> tuple[int, list[bytes]]:
    found = text.split()  # bytes split at exactly space and \t..\r
    if not ranges:
        return len(found), found
    cover = np.zeros(len(found) + 1, np.int64)
    for r in ranges:
        where, length = np.frombuffer(r, "<i8").reshape(2, -1)
        np.add.at(cover, where, 1)
        np.add.at(cover, np.minimum(where + length + window - 1, len(found)), -1)
    keep = np.cumsum(cover)[:-1] == 0
    return len(found), [w for w, k in zip(found, keep.tolist(), strict=True) if k]


def _digests(batches, window: int):
    for batch in batches:
        rows = []
        for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            n, kept = _kept((text or "").encode(), ranges, window)
            rows.append((n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        cols = list(zip(*rows, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def _with_ranges(docs: DataFrame, window: int, chunk_words: int) -> DataFrame:
    """docs with __ranges and __twin besides, under whatever names its columns have."""
    docs = _told_apart(docs)
    found = repeats(docs, window, chunk_words).groupBy("doc_id", "twin").agg(F.collect_list("ranges").alias("__ranges"))  # a document's own
    found = found.select(F.col("doc_id").alias("__doc"), F.col("twin").alias("__other"), "__ranges")
    return docs.join(found, (F.col("doc_id") == F.col("__doc")) & (F.col("__twin") == F.col("__other")), "left").drop("__doc", "__other", "__twin")


def removed_digest(docs: DataFrame, window: int = WINDOW, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each document.

    Null or blank text: 0 words and the digest of the empty string. Several rows of one doc_id are each judged by
    their own text, and a window is no repeat of one under the same doc_id. A null doc_id has no order: it is kept whole. Columns of docs
    other than doc_id and text are not looked at."""
    both = _with_ranges(docs.select("doc_id", "text"), window, chunk_words)
    return both.select("doc_id", "text", "__ranges").mapInArrow(lambda it: _digests(it, window), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _texts(batches, window: int):
    """The last columns are the text and its ranges; the others pass by their places."""
    for batch in batches:
        *others, texts, ranges = (batch.column(k) for k in range(batch.num_columns))
        ranges = ranges.to_pylist()
        new = [t if not r else b" ".join(_kept(t.encode(), r, window)[1]).decode() for t, r in zip(texts.to_pylist(), ranges, strict=True)]
        out = pa.RecordBatch.from_arrays([*others, pa.array(new, pa.string())], names=batch.schema.names[:-1])
        yield out.filter(pa.array([not r or t != "" for t, r in zip(new, ranges, strict=True)], pa.bool_()))


def remove_repeats(docs: DataFrame, window: int = WINDOW, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """docs with the repeated words taken out of text, the rest joined by spaces. A text that loses nothing stays as it is, null included; a
    document that loses all its words leaves. Rows of one doc_id lose what their own text repeats; rows without one lose nothing. Other
    columns stay, whatever their names."""
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*(docs[c] for c in others)).alias("rest"), "doc_id", "text")
    both = _with_ranges(rows, window, chunk_words).select("rest", "text", "__ranges")
    kept = both.mapInArrow(lambda it: _texts(it, window), rows.select("rest", "text").schema)
    return kept.select(*(F.col("text") if c == "text" else F.col("rest").getField(c).alias(c) for c in docs.columns))
