"""Scores of texts under a log-bilinear language model trained by noise-contrastive estimation.

Texts are read once: each task packs its documents in chunks, of each chunk the distinct tokens and every document's tokens as
places among them. All that follows works on the chunks. Token counts over the training documents are summed over all chunks. The most
frequent tokens are the classes of the neural model; all others share a class, within which a token has its smoothed share of the counts.
The model predicts a class's representation as a sum of its two predecessors' representations, each through a matrix of its place;
its dot product with a class's own representation, and a bias, give the logit. Training goes over all training documents in rounds: in each,
tasks train on their share of the round's documents in numpy, telling the seen class from noise drawn by frequency, and the parameters of
all tasks are averaged by their tokens. Scores are normalised: the logits of a chunk's distinct contexts are one matrix product, of
which each token's log-probability is its own logit less the context's log-sum. Chunks get the counts of their rarer tokens by a join.

The parameters (CLASSES rows of WIDTH) are all that passes through the driver. A chunk is CHUNK_WORDS words or one document.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidestream.llm import common as C
from tidestream.sources import checkpoints

#: Classes of the model (the shared one and the end among them), numbers of a representation, words of a chunk.
CLASSES, WIDTH, CHUNK_WORDS = 512, 24, 1 << 20
#: Rounds between averages, tokens of a step, noise classes of a step, step size.
ROUNDS, STEP, NOISE, RATE = 6, 512, 64, 0.2
#: What is added to each count, and what of the documents (crc32 of doc_id modulo FOLDS) is held out.
SMOOTH, FOLDS, HELD_FOLD = 0.5, 5, 1
#: Slots over which the sums of the tasks' parameters are spread.
SLOTS = 32
OTHER, END = 0, 1
_END_TOKEN = b""  # no word is empty
_LEVEL = 3


def _packed(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(b"".join([*(len(a).to_bytes(8, "little") + a.dtype.char.encode() + a.tobytes() for a in arrays)]), _LEVEL)


def _unpacked(blob: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.decompress(blob), 0, []
    while at < len(raw):
        n, kind = int.from_bytes(raw[at : at + 8], "little"), np.dtype(chr(raw[at + 8]))
        out.append(np.frombuffer(raw, kind, n, at + 9))
        at += 9 + n * kind.itemsize
    return out


# --- chunks ------------------------------------------------------------------------------------------------------


def _lowered(token: bytes) -> bytes:
    return token.lower()  # of bytes: A-Z only


def _chunk(held: list[pa.RecordBatch]) -> tuple[list[bytes], np.ndarray, bytes]:
    """Of some rows (doc_id, text, held): their distinct tokens, how often each occurs in training documents, and the packed documents."""
    table = pa.Table.from_batches(held).combine_chunks()
    data, offsets = C.text_buffer(table.column("text").combine_chunks())
    parts = [(C.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower=True), i, offsets[i]) for i, j in C.pieces(offsets)]
    start, end = (np.concatenate([p[0][k] + p[2] for p in parts]) for k in (0, 1))
    row, code = np.concatenate([p[0][2] + p[1] for p in parts]), np.concatenate([p[0][3] for p in parts])
    _, first, place, n = np.unique(code, return_index=True, return_inverse=True, return_counts=True)
    rank = np.argsort(-n, kind="stable")  # frequent ones get small places, which pack well
    new = np.empty(len(rank), np.int64)
    new[rank] = np.arange(len(rank))
    place, first = new[place] + 1, first[rank]
    view = data.tobytes()
    tokens = [_END_TOKEN, *(_lowered(view[a:b]) for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True))]
    out = table.column("held").to_numpy()
    words = np.bincount(row, minlength=len(out))
    seen = np.bincount(place[~out[row]], minlength=len(tokens))
    seen[0] = (~out).sum()
    line = np.insert(place, np.cumsum(words), 0).astype(np.int32)  # an end after each document
    return tokens, seen, _packed(words + 1, out.astype(np.int8), line)


def _chunks(batches: Iterator[pa.RecordBatch], kind: pa.DataType, words: int) -> Iterator[pa.RecordBatch]:
    task, number = TaskContext.get().partitionId(), 0
    held: list[pa.RecordBatch] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal number
        tokens, seen, docs = _chunk(held)
        ids = pa.chunked_array([b.column(0) for b in held]).combine_chunks()
        rows = [pa.array([(task << 32) + number]), pa.array([ids.to_pylist()], pa.list_(kind)), pa.array([docs], pa.binary())]
        vocabulary = zstandard.compress(b"\n".join(tokens), _LEVEL)  # no word holds a line break
        yield pa.RecordBatch.from_arrays([*rows, pa.array([vocabulary], pa.binary()), pa.array([_packed(seen)], pa.binary())], names=["chunk", "ids", "docs", "vocabulary", "seen"])
        number += 1

    for batch in batches:
        for i, j in C.pieces(C.text_buffer(batch.column(1))[1], 6 * words):
            held.append(batch.slice(i, j - i))
            size += held[-1].column(1).nbytes
            if size >= 6 * words:
                yield from flush()
                held, size = [], 0
    if held:
        yield from flush()


def _tokens(vocabulary: bytes) -> list[bytes]:
    return zstandard.decompress(vocabulary).split(b"\n")


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, n): a chunk's training counts."""
    for batch in batches:
        for vocabulary, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            (n,) = _unpacked(blob)
            rows = pa.RecordBatch.from_arrays([pa.array(_tokens(vocabulary), pa.binary()), pa.array(n)], names=["token", "n"])
            yield rows.filter(pa.array(n > 0))


# --- the model -----------------------------------------------------------------------------------------------------


@dataclass
class Model:
    """tokens: those with a class of their own, from END on. counts: of each class, OTHER first. Parameters: representations of classes
    as context and as target, matrices of the two places, biases."""

    tokens: list[bytes]
    counts: np.ndarray
    parameters: list[np.ndarray]

    def __post_init__(self):
        self.place = {t: k for k, t in enumerate(self.tokens, END)}

    def classes(self, tokens: list[bytes]) -> np.ndarray:
        return np.array([self.place.get(t, OTHER) for t in tokens], np.int64)

    def scores(self, before: np.ndarray, last: np.ndarray, target: np.ndarray, block: int = 4096) -> np.ndarray:
        """The natural logarithm of each target's probability after `before` and `last`; distinct contexts are normalised once."""
        context, target_, (a, b), bias = self.parameters[0], self.parameters[1], self.parameters[2], self.parameters[3]
        n = len(self.counts)
        key, place = np.unique(before * n + last, return_inverse=True)
        order = np.argsort(place, kind="stable")
        edges = np.searchsorted(place[order], np.arange(0, len(key) + block, block))
        out = np.empty(len(target))
        for k, begin in enumerate(range(0, len(key), block)):
            pair = key[begin : begin + block]
            logits = (context[pair // n] @ a + context[pair % n] @ b) @ target_.T + bias
            logits -= logits.max(1, keepdims=True)
            own = order[edges[k] : edges[k + 1]]
            chosen = logits[place[own] - begin, target[own]].astype(float)
            np.exp(logits, out=logits)
            out[own] = chosen - np.log(logits.sum(1, dtype=float))[place[own] - begin]
        return out


def initial(tokens: list[bytes], counts: np.ndarray, width: int, seed: int = 11) -> Model:
    """Small random representations; biases as frequencies have it, so that training starts at the model without context."""
    draw = np.random.Generator(np.random.PCG64(seed))
    n = len(counts)
    p = (counts + SMOOTH) / (counts + SMOOTH).sum()
    small = lambda *shape: draw.normal(0, 0.1, shape).astype(np.float32)
    places = np.stack([np.eye(width, dtype=np.float32)] * 2) + small(2, width, width)
    return Model(tokens, counts, [small(n, width), small(n, width), places, np.log(p).astype(np.float32)])


def contexts(line: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two classes before each token of documents that end at `ends`; before its begin a document has ends."""
    last = np.concatenate(([END], line[:-1]))
    before = np.concatenate(([END, END], line[:-2]))[: len(line)]
    begin = np.concatenate(([0], ends[:-1]))
    last[begin] = END
    before[begin] = END
    second = begin + 1
    before[second[second < ends]] = END
    return before, last


def _sums(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The sum of the values of each of n rows."""
    width = values.shape[1]
    at = (rows[:, None] * width + np.arange(width)).ravel()
    return np.bincount(at, values.ravel(), n * width).reshape(n, width).astype(np.float32)


class Trainer:
    """Steps of noise-contrastive estimation from a model's parameters, with step sizes by each parameter's past gradients."""

    def __init__(self, model: Model, noise: int, rate: float, seed: int):
        self.w = [p.copy() for p in model.parameters]
        self.past = [np.full(p.shape, 1e-2, np.float32) for p in self.w]
        self.noise, self.rate = noise, rate
        p = (model.counts + SMOOTH) / (model.counts + SMOOTH).sum()
        self.cumulated = np.cumsum(p)
        self.log_noise = np.log(noise * p).astype(np.float32)
        self.draw = np.random.Generator(np.random.PCG64(seed))

    def step(self, before: np.ndarray, last: np.ndarray, target: np.ndarray, weight: np.ndarray) -> None:
        """weight: how often each (before, last, target) occurs, over the mean of that."""
        context, own, places, bias = self.w
        drawn = np.minimum(np.searchsorted(self.cumulated, self.draw.random(self.noise)), len(bias) - 1)
        x, y = context[before], context[last]
        ahead = x @ places[0] + y @ places[1]
        seen, noise = own[target], own[drawn]
        s = np.einsum("ij,ij->i", ahead, seen) + bias[target] - self.log_noise[target]
        t = ahead @ noise.T + (bias[drawn] - self.log_noise[drawn])
        ds = weight * (_sigmoid(s) - 1)  # what is seen should stand out
        dt = weight[:, None] * _sigmoid(t)  # what is drawn should not
        back = ds[:, None] * seen + dt @ noise
        n, both = len(bias), np.concatenate([target, drawn])
        grads = [
            _sums(np.concatenate([before, last]), np.concatenate([back @ places[0].T, back @ places[1].T]), n),
            _sums(both, np.concatenate([ds[:, None] * ahead, dt.T @ ahead]), n),
            np.stack([x.T @ back, y.T @ back]),
            np.bincount(both, np.concatenate([ds, dt.sum(0)]), n).astype(np.float32),
        ]
        for w, g, past in zip(self.w, grads, self.past, strict=True):
            g /= len(target)
            past += g * g
            w -= self.rate * g / np.sqrt(past)

    def learn(self, before: np.ndarray, last: np.ndarray, target: np.ndarray, step: int) -> None:
        """One pass over tokens in random order: equal ones of a pass are one with a weight, split where it is far above the mean."""
        n = len(self.w[3])
        key, count = np.unique((before * n + last) * n + target, return_counts=True)
        most = max(1, int(8 * count.mean()))
        pieces = -(-count // most)
        order = self.draw.permutation(int(pieces.sum()))
        which = np.repeat(np.arange(len(key)), pieces)[order]
        weight = (count / pieces)[which]
        weight = (weight / weight.mean()).astype(np.float32)
        key = key[which]
        for k in range(0, len(key), step):
            own = key[k : k + step]
            self.step(own // (n * n), own // n % n, own % n, weight[k : k + step])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _line(model: Model, docs: bytes, vocabulary: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk: each token's place in its vocabulary, where its documents end, which are held out, the classes of its vocabulary."""
    length, held, line = _unpacked(docs)
    return line, np.cumsum(length), held.astype(bool), model.classes(_tokens(vocabulary))


def _trained(batches: Iterator[pa.RecordBatch], model: Model, turn: int, rounds: int, step: int, noise: int, rate: float, slots: int) -> Iterator[pa.RecordBatch]:
    """(slot, weight, part): the parameters after this task's share of a round, times its tokens, in parts."""
    trainer = Trainer(model, noise, rate, turn)
    tokens = 0
    for batch in batches:
        for docs, vocabulary in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            line, ends, held, classes = _line(model, docs, vocabulary)
            target = classes[line]
            before, last = contexts(target, ends)
            mine = ~held & ((np.arange(len(held)) + turn) % rounds == 0)
            taken = np.repeat(mine, np.diff(ends, prepend=0))
            if taken.any():
                trainer.learn(before[taken], last[taken], target[taken], step)
                tokens += int(taken.sum())
    if tokens:
        flat = np.concatenate([p.ravel() for p in trainer.w]).astype(float) * tokens
        parts = [p.tobytes() for p in np.array_split(flat, slots)]
        yield pa.RecordBatch.from_arrays([pa.array(range(slots), pa.int32()), pa.array([float(tokens)] * slots), pa.array(parts, pa.binary())], names=["slot", "weight", "part"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, list] = {}
    for batch in batches:
        for slot, weight, part in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            part = np.frombuffer(part)
            if slot in sums:
                sums[slot][0] += weight
                sums[slot][1] += part
            else:
                sums[slot] = [weight, part.copy()]
    yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([s[0] for s in sums.values()], pa.float64()), pa.array([s[1].tobytes() for s in sums.values()], pa.binary())], names=["slot", "weight", "part"])


def train(chunks: DataFrame, model: Model, rounds: int = ROUNDS, step: int = STEP, noise: int = NOISE, rate: float = RATE) -> Model:
    """The model after `rounds` rounds, which together go over all training documents once."""
    spark = chunks.sparkSession
    schema = "slot int, weight double, part binary"
    for turn in range(rounds):
        held = spark.sparkContext.broadcast(model)
        trained = chunks.select("docs", "vocabulary").mapInArrow(lambda it, held=held, turn=turn: _trained(it, held.value, turn, rounds, step, noise, rate, SLOTS), schema)
        found = trained.repartition(SLOTS, "slot").mapInArrow(_summed, schema).collect()  # SLOTS rows, which together hold one set of parameters
        held.unpersist()
        if found:
            flat = np.concatenate([np.frombuffer(r.part) / r.weight for r in sorted(found)]).astype(np.float32)
            edges = np.cumsum([p.size for p in model.parameters])[:-1]
            model = Model(model.tokens, model.counts, [f.reshape(p.shape) for f, p in zip(np.split(flat, edges), model.parameters, strict=True)])
    return model


# --- scores ----------------------------------------------------------------------------------------------------------


def _wanted(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """(token, chunk, place) of the tokens of each chunk that share a class."""
    for batch in batches:
        for chunk, vocabulary in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            tokens = _tokens(vocabulary)
            rare = np.flatnonzero(model.classes(tokens) == OTHER)
            columns = [pa.array(tokens, pa.binary()).take(pa.array(rare)), pa.array(np.full(len(rare), chunk)), pa.array(rare.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["token", "chunk", "place"])


def _scored(model: Model, total: int, distinct: int, kind: pa.DataType) -> Callable[[pa.Table, pa.Table], pa.Table]:
    other = float(model.counts[OTHER] + SMOOTH * (distinct - int((model.counts[END:] > 0).sum()) + 1))  # what shares a class, and the unknown
    whole = total + SMOOTH * (distinct + 1)

    def score(chunks: pa.Table, found: pa.Table) -> pa.Table:
        out = []
        for ids, docs, vocabulary in zip(*(chunks.column(c).to_pylist() for c in ("ids", "docs", "vocabulary")), strict=True):
            line, ends, held, classes = _line(model, docs, vocabulary)
            counts = np.where(classes == OTHER, 0, model.counts[classes])
            counts[found.column("place").to_numpy()] = found.column("c").to_numpy()
            inside = np.where(classes == OTHER, np.log((counts + SMOOTH) / other), 0.0)
            target = classes[line]
            log = model.scores(*contexts(target, ends), target) + inside[line]
            base = np.log10((counts + SMOOTH) / whole)[line]
            begin = np.concatenate(([0], ends[:-1]))
            sums = [np.add.reduceat(x, begin) for x in ((counts > 0)[line].astype(np.int64), base, log / np.log(10))]
            out.append(pa.Table.from_arrays([pa.array(ids, kind), pa.array(held), pa.array(ends - begin), *map(pa.array, sums)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]))
        return pa.concat_tables(out)

    return score


def scored(docs: DataFrame, classes: int = CLASSES, width: int = WIDTH, chunk_words: int = CHUNK_WORDS, **options) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row.

    Null or blank text: the end alone. A null doc_id counts as an empty text when documents are held out; equal doc_ids are scored each.
    Without training documents all tokens are unknown and equally likely. Other columns are not looked at."""
    spark = docs.sparkSession
    folder = f"{C.folder(spark)}/lm-{uuid.uuid4().hex}"
    sql = dict(docs.dtypes)["doc_id"]
    kind = pa.string() if sql == "string" else pa.int32() if sql == "int" else pa.int64()
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_FOLD
    packed = docs.select("doc_id", "text", held.alias("held")).mapInArrow(lambda it: _chunks(it, kind, chunk_words), f"chunk long, ids array<{sql}>, docs binary, vocabulary binary, seen binary")
    packed.write.option("compression", "none").parquet(f"{folder}/chunks")
    chunks = spark.read.parquet(f"{folder}/chunks")
    counts = chunks.select("vocabulary", "seen").mapInArrow(_seen, "token binary, n long").groupBy("token").agg(F.sum("n").alias("c"))
    counts.write.parquet(f"{folder}/counts")
    counts = spark.read.parquet(f"{folder}/counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = counts.filter(F.col("token") != _END_TOKEN).orderBy(F.col("c").desc(), "token").limit(classes - 2).collect()
    ends = counts.filter(F.col("token") == _END_TOKEN).first()
    own = np.array([ends.c if ends else 0, *(r.c for r in top)], np.int64)
    model = initial([_END_TOKEN, *(bytes(r.token) for r in top)], np.concatenate(([total - own.sum()], own)), width)
    model = train(chunks, model, **options)
    shared = spark.sparkContext.broadcast(model)
    wanted = chunks.select("chunk", "vocabulary").mapInArrow(lambda it: _wanted(it, shared.value), "token binary, chunk long, place int")
    found = wanted.join(counts, "token").select("chunk", "place", "c")
    score = lambda a, b: _scored(shared.value, total, distinct, kind)(a, b)
    rows = chunks.select("chunk", "ids", "docs", "vocabulary").groupBy("chunk").cogroup(found.groupBy("chunk"))
    rows = rows.applyInArrow(score, f"doc_id {sql}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    rows.write.parquet(f"{folder}/scores")
    for done in ("chunks", "counts"):
        checkpoints.drop(spark, f"{folder}/{done}")
    return spark.read.parquet(f"{folder}/scores").select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
