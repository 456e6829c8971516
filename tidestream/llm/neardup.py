"""Near duplicates: SuperMinHash signatures, banding, verification on whole shingle sets, union-find grouping.

1. Each task hashes its documents' shingles and makes a signature of ROWS * BANDS slots (see `super_minhash`). Documents
   with the same set form a class that goes on as its smallest doc_id, its node, in one row; copies rejoin their class at the end
   and take no part in the rounds between.
2. Stars: of each band's bucket every member is held against the one of least hash only: as many pairs as members. Pairs
   whose signatures agree in less than SKETCH_LEAST of the slots are left; the others are verified on their whole sets, and
   the links make components in rounds of union-find. A pivot of very many members meets them in parts of about PIVOT_PAIRS, each in
   a task that gets the pivot's set once.
3. The rest: only buckets that still hold several components go on. Each of their members has one home, a block of about BLOCK
   members or BLOCK_SHINGLES in its largest bucket; a component that fills blocks has blocks of its own. For each two blocks that
   meet in a bucket and hold different components, the members of the smaller one visit the larger: once, in however many buckets
   they meet. A task holds a block and takes its visitors one by one, VISITORS of them at most; it skips pairs of one component
   and those whose signatures agree too little, verifies the others at once and unites what it links. So a large component and a
   few strays cost a set for each member and some for each stray, and a task sends on fewer links than it has members.

A pair at similarity 0.8 shares no band with probability (1 - 0.8^ROWS)^BANDS, 1.2e-7; shingles are told apart by
64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidestream.llm import common as C

#: Slots of a band, bands, and the words of a shingle.
ROWS, BANDS, SHINGLE = 5, 40, 2
#: A pair is linked if 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Members of a block, or their shingles, and visitors of a block that one task takes.
BLOCK, BLOCK_SHINGLES, VISITORS = 256, 500_000, 1024
#: Pairs of one pivot that are held against it in one task, about.
PIVOT_PAIRS = 5_000
#: Share of agreeing slots from which a pair is verified: six standard deviations below 0.8.
SKETCH_LEAST = 0.63
#: Shingles that the signature and comparison kernels take at once.
CHUNK_SHINGLES = 25_000
_GOLDEN = 0x9E3779B97F4A7C15


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row: of `size` consecutive words, or of all where there are fewer."""
    _, _, row, code = C.words(data, offsets, lower=True)
    edge = np.searchsorted(row, np.arange(len(offsets)))
    window = C.window_codes(code, size)
    out = []
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(window[a : b - size + 1]))
        else:
            out.append(C.mix(C.window_codes(code[a:b], b - a) ^ np.uint64(b - a)) if b > a else code[:0])
    return out


def super_minhash(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """Signatures (rows x slots) of non-empty sets.

    Each element walks the slots in a random order of its own (a Fisher-Yates shuffle drawn from its hash). In step
    j it offers its j-th slot the rank j + a random fraction; a slot keeps the least rank. As ranks of step j
    exceed those of all steps before, only empty slots take offers, and a set stops once all its slots are full."""
    out = np.full(len(sets) * slots, np.iinfo(np.uint64).max, np.uint64)
    sizes = np.array([len(s) for s in sets])
    element = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    none = np.iinfo(np.uint64).max
    order = None
    for j in range(slots):
        draw = C.mix(element + np.uint64((j + 1) * _GOLDEN & (2**64 - 1)))
        k = j + (((draw & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j)) >> np.uint64(32)).astype(np.int64)
        if order is None:
            slot = k
        else:
            lines = np.arange(len(element))
            slot = order[lines, k].astype(np.int64)
            order[lines, k] = order[:, j]
            order[:, j] = slot
        at = owner * slots + slot
        empty = out[at] >> np.uint64(32) >= np.uint64(j)  # never filled, or filled in this step
        np.minimum.at(out, at[empty], (np.uint64(j) << np.uint64(32)) | (draw[empty] >> np.uint64(32)))
        open_ = (out.reshape(-1, slots) == none).any(1)
        go = open_[owner]
        if not go.any():
            break
        if order is None:
            element, owner, k = element[go], owner[go], k[go]
            order = np.broadcast_to(np.arange(slots, dtype=np.uint16), (len(element), slots)).copy()
            order[np.arange(len(element)), k] = 0
            order[:, 0] = k
        elif not go.all():
            element, owner, order = element[go], owner[go], order[go]
    return out.reshape(-1, slots)


def _features(batches, size: int, rows: int, bands: int):
    slots = rows * bands
    for batch in batches:
        data, offsets = C.text_buffer(batch.column(1))
        for i, j in C.pieces(offsets):
            sets = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)
            n = np.array([len(s) for s in sets], np.int64)
            high, low = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
            signature = np.zeros((len(sets), slots), np.uint64)
            full = np.flatnonzero(n)
            for r in full:
                high[r] = C.mix(sets[r]).sum(dtype=np.uint64).view(np.int64)
                low[r] = C.mix(sets[r] ^ C.ODD[9]).sum(dtype=np.uint64).view(np.int64)
            for a, b in C.pieces(np.concatenate(([0], np.cumsum(n[full]))), CHUNK_SHINGLES):
                signature[full[a:b]] = super_minhash([sets[r] for r in full[a:b]], slots)
            band = np.zeros((len(sets), bands), np.uint64)
            for k in range(rows):
                band += C.mix(signature[:, k::rows]) * C.ODD[k]
            band = C.mix(band + np.arange(bands, dtype=np.uint64) * C.ODD[10])
            sketch = C.mix(signature).astype(np.uint8)
            lists = pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * bands, pa.array(band.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), pa.array(n), pa.array(high), pa.array(low), lists, pa.array([s.tobytes() for s in sketch], pa.binary())],
                names=["doc_id", "n_shingles", "high", "low", "bands", "sketch"],
            )


def _sets(batches, size: int):
    for batch in batches:
        data, offsets = C.text_buffer(batch.column(1))
        for i, j in C.pieces(offsets):
            sets = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)
            high = pa.array([C.mix(s).sum(dtype=np.uint64).view(np.int64) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), high, pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "high", "codes"])


def _packed(batches):
    for batch in batches:
        texts = [zstandard.compress(x.as_buffer(), 1) if x.is_valid else None for x in batch.column(1).cast(pa.large_binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], names=["doc_id", "packed"])


def _unpacked(batches):
    for batch in batches:
        for i in range(0, len(batch), 256):
            part = batch.slice(i, 256)
            texts = [zstandard.decompress(x.as_buffer()) if x.is_valid else None for x in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.large_binary())], names=["doc_id", "text"])


def _sets_of(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(doc_id, high, codes) of the documents in wanted (a column of doc_ids), one row for each of their different texts, which travel
    compressed."""
    packed = docs.select("doc_id", "text").mapInArrow(_packed, "doc_id long, packed binary")
    packed = packed.join(wanted.toDF("__id").distinct(), F.col("doc_id") == F.col("__id"), "left_semi").distinct()
    sets = packed.mapInArrow(lambda it: _sets(_unpacked(it), size), "doc_id long, high long, codes binary")
    return sets.filter("octet_length(codes) > 0")


def _linked(batches, percent: int):
    for batch in batches:
        keep = []
        for a, b in zip(batch.column(2), batch.column(3), strict=True):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (a, b))
            if len(x) > len(y):
                x, y = y, x
            if 100 * len(x) < percent * len(y):
                keep.append(False)
                continue
            at = np.searchsorted(y, x)
            both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _verified(pairs: DataFrame, hot: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) that connect what the linked pairs connect, found by the whole sets of their texts. pairs is checkpointed;
    high_a and high_b tell which of the sets of a and of b are meant, as rows of one doc_id can differ.

    Each task unites its links at once, so a task needs one Python worker, not one for each of two steps. A pivot's set goes to each of its
    parts once, where its members' sets pass by it."""
    sets = C.checkpointed(_sets_of(docs, pairs.select("a").union(pairs.select("b")), size))
    first = _in_parts(sets.select(F.col("doc_id").alias("a"), F.col("high").alias("high_a"), F.col("codes").alias("x")), hot)
    second = sets.select(F.col("doc_id").alias("b"), F.col("high").alias("high_b"), F.col("codes").alias("y"))
    both = pairs.join(second, ["b", "high_b"]).join(first, ["a", "high_a", "part"]).select("a", "b", "x", "y")
    return C.checkpointed(both.mapInArrow(lambda it: _union(_linked(it, percent)), "u long, v long").toDF("a", "b"))


def _dealt(pairs: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """pairs with `part`: those of a pivot that has more than `most` are dealt to parts of about that many, by their other member; and
    (high_a, parts) of such pivots. pairs is checkpointed."""
    hot = pairs.groupBy("high_a").agg(F.count("*").alias("n")).filter(F.col("n") > most)
    hot = C.checkpointed(hot.select("high_a", F.ceil(F.col("n") / most).cast("int").alias("parts")))
    dealt = C.left_join_small(pairs, hot, "high_a", F.col("high_b"))
    return dealt.withColumn("part", F.coalesce(F.pmod(F.xxhash64("b", "high_b"), F.col("parts")).cast("int"), F.lit(0))).drop("parts"), hot


def _in_parts(pivots: DataFrame, hot: DataFrame) -> DataFrame:
    """pivots (with high_a), once for each part that their pairs are dealt to."""
    rows = C.left_join_small(pivots, hot, "high_a", F.col("high_a"))
    return rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")


def _union(batches):
    """Union-find over one task's links: a link from each node to the least of its set."""
    parent: dict[int, int] = {}

    def find(x):
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = parent[p]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(u), find(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    links = [(x, find(x)) for x in parent if find(x) != x]
    for i in range(0, len(links), 50_000):
        part = links[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in part], pa.int64()), pa.array([p[1] for p in part], pa.int64())], names=["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes in links (two columns) but the least of each component.

    Rounds, till every link goes from a node to its component's least: links are dealt out by their greater end and each task
    unites its own (so a node with several lesser ends links these), then each lesser end gives way to the least that it is itself
    linked to. A task sends one link for each of its nodes, so no node brings more rows together than there are tasks."""
    u, v = links.columns
    n = C.shuffle_partitions(links.sparkSession)
    edges = links.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).filter("u != v").mapInArrow(_union, "u long, v long")
    while True:
        edges = C.checkpointed(edges.repartition(n, "u").mapInArrow(_union, "u long, v long"))
        least = C.checkpointed(edges.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("most")))
        ends = least.select(F.col("u").alias("w"))
        if least.filter("m < most").isEmpty() and least.join(ends, F.col("m") == F.col("w"), "left_semi").isEmpty():
            return least.select(F.col("u").alias("node"), F.col("m").alias("component"))
        up = C.left_join_small(edges, least.select(F.col("u").alias("v"), "m"), "v", F.col("u"))
        edges = up.select("u", F.coalesce("m", "v").alias("v")).mapInArrow(_union, "u long, v long")


def _alike(batches, least: float):
    """Of (a, high_a, b, high_b, part, x, y) the pairs whose sketches x and y agree in enough slots, without these."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (5, 6))
        yield batch.select([0, 1, 2, 3, 4]).filter(pa.array((x == y).mean(1) >= least if len(x) else [], pa.bool_()))


class _Block:
    """A block's members at home, and how their components have grown together."""

    def __init__(self, rows: pa.Table):
        self.node, self.label = rows.column("node").to_numpy(), rows.column("component").to_numpy().copy()
        self.sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(len(self.node), -1)
        self.sets = [np.frombuffer(x, np.uint64) for x in rows.column("codes").to_pylist()]
        self.n = np.array([len(x) for x in self.sets])
        self.became: dict[int, int] = {}

    def links(self, node: int, component: int, sketch: np.ndarray, codes: np.ndarray, first: int, percent: int, least: float):
        """Links (a, b) of a node to members from `first` on: one for each other component that it turns out to join."""
        while component in self.became:
            component = self.became[component]
        near = first + np.flatnonzero(self.label[first:] != component)
        near = near[100 * np.minimum(self.n[near], len(codes)) >= percent * np.maximum(self.n[near], len(codes))]
        if len(near):
            near = near[(self.sketch[near] == sketch).mean(1) >= least]
        for x, y in C.pieces(np.concatenate(([0], np.cumsum(self.n[near]))), CHUNK_SHINGLES):
            some = near[x:y]
            other = np.concatenate([self.sets[j] for j in some])
            at = np.minimum(np.searchsorted(codes, other), len(codes) - 1)
            both = np.add.reduceat((codes[at] == other).astype(np.int64), np.cumsum(self.n[some]) - self.n[some])
            for j in some[100 * both >= percent * (self.n[some] + len(codes) - both)].tolist():
                old = int(self.label[j])
                if old != component:
                    self.became[old] = component
                    self.label[self.label == old] = component
                    yield min(node, int(self.node[j])), max(node, int(self.node[j]))

    def own_links(self, percent: int, least: float):
        if (self.label != self.label[0]).any():
            for i in range(len(self.node) - 1):
                yield from self.links(int(self.node[i]), int(self.label[i]), self.sketch[i], self.sets[i], i + 1, percent, least)


def _across_blocks(batches, percent: int, least: float):
    """Rows come sorted by task, those at home (side 0) before the visitors. The part of a task that is numbered 0 links its block's own members."""
    key, block, home = None, None, []

    def settled():
        nonlocal block, home
        block = _Block(pa.Table.from_batches(home))
        own = block.own_links(percent, least) if home[0].column("own")[0].as_py() else ()
        home = []
        return list(own)

    def batch_of(pairs):
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

    for batch in batches:
        found = []
        task, side = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        edge = [0, *(np.flatnonzero((task[1:] != task[:-1]) | (side[1:] != side[:-1])) + 1).tolist(), len(task)]
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            part = batch.slice(a, b - a)
            if task[a] != key:
                found += settled() if home else []
                key, block = task[a], None
            if side[a] == 0:
                home.append(part)
                continue
            found += settled() if home else []
            for node, component, sketch, codes in zip(*(part.column(c).to_pylist() for c in ("node", "component", "sketch", "codes")), strict=True):
                found += block.links(node, component, np.frombuffer(sketch, np.uint8), np.frombuffer(codes, np.uint64), 0, percent, least)
        yield batch_of(found)
    if home:
        yield batch_of(settled())


def _across(inside: DataFrame, found: DataFrame, node: DataFrame, docs: DataFrame, size: int, percent: int, block: int, visitors: int) -> DataFrame:
    """Links (a, b) between the components in `found` that meet in buckets of more than one."""
    label = found.withColumnRenamed("node", "__node")
    members = inside.select("key", "node", "high").join(label, F.col("node") == F.col("__node"), "left").select("key", "node", "high", F.coalesce("component", "node").alias("component"))
    members = C.checkpointed(members)
    several = members.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("held")).filter("x < y")
    members = C.checkpointed(members.join(C.checkpointed(several.select("key", "held")), "key"))
    homes = members.groupBy("node", "high", "component").agg(F.max(F.struct("held", "key")).alias("g")).select("node", "high", "component", F.col("g.key").alias("group"))
    homes = C.checkpointed(homes.join(node.select("node", "high", "n_shingles"), ["node", "high"]))
    parts = lambda n: F.greatest(F.ceil(F.sum(n) / block), F.ceil(F.sum("shingles") / BLOCK_SHINGLES))
    held = homes.groupBy("group", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"))
    # a component that fills blocks has its own; the others of a group share some
    held = C.checkpointed(held.withColumn("owner", F.when((F.col("n") >= block) | (F.col("shingles") >= BLOCK_SHINGLES), F.col("component"))))
    shared = held.groupBy("group", "owner").agg(F.sum("n").alias("all"), parts("n").cast("int").alias("blocks")).withColumnsRenamed({"group": "__group", "owner": "__owner"})
    plan = C.checkpointed(held.join(shared, (F.col("group") == F.col("__group")) & F.col("owner").eqNullSafe(F.col("__owner"))).select("group", "component", "owner", "blocks", F.ceil(F.col("all") / F.col("blocks")).alias("about")))
    share = F.pmod(F.when(F.col("owner").isNull(), F.xxhash64("component")).otherwise(F.xxhash64("node", "high")), F.col("blocks"))
    homes = homes.join(plan, ["group", "component"]).select("node", "high", "component", "about", F.xxhash64("group", F.coalesce(F.col("owner"), F.lit(-1)), F.col("owner").isNull(), share).alias("block"))
    homes = C.checkpointed(homes)
    placed = C.checkpointed(members.select("key", "node", "high").join(homes, ["node", "high"]))
    present = C.checkpointed(placed.groupBy("key", F.col("block").alias("goal"), F.col("about").alias("goal_about")).agg(F.min("component").alias("x"), F.max("component").alias("y")))
    smaller = F.struct("about", "block") < F.struct("goal_about", "goal")
    visits = placed.join(present, "key").filter(smaller & ((F.col("x") != F.col("component")) | (F.col("y") != F.col("component"))))
    visits = C.checkpointed(visits.select(F.col("goal").alias("block"), "node", "high", "component").distinct())
    mixed = homes.groupBy("block").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("block", F.lit(0).alias("came"))
    tasks = C.checkpointed(visits.groupBy("block").agg(F.count("*").alias("came")).unionByName(mixed).groupBy("block").agg(F.ceil(F.max("came") / visitors).cast("int").alias("parts")).withColumn("parts", F.greatest("parts", F.lit(1))))
    at_home = homes.join(tasks, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"), "node", "high", "component")
    guests = visits.join(tasks, "block").select("block", F.pmod(F.xxhash64("node", "high"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("side"), "node", "high", "component")
    rows = C.checkpointed(at_home.unionByName(guests).select(F.xxhash64("block", "part").alias("task"), "side", (F.col("part") == 0).alias("own"), "node", "high", "component"))
    sets = _sets_of(docs, rows.select("node"), size).withColumnRenamed("doc_id", "node")
    whole = sets.join(node.select("node", "high", "sketch"), ["node", "high"])
    n = C.shuffle_partitions(docs.sparkSession)
    rows = rows.join(whole, ["node", "high"]).select("task", "side", "own", "node", "component", "sketch", "codes")
    return rows.repartition(n, "task").sortWithinPartitions("task", "side").mapInArrow(lambda it: _across_blocks(it, percent, SKETCH_LEAST), "a long, b long")


def _copies(features: DataFrame, node: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, rep) of the documents that only copy the set of one other, and the links of those that also have another set."""
    sets = ["n_shingles", "high", "low"]
    many = C.checkpointed(node.filter("copies > 1").select(*sets, F.col("node").alias("rep")))
    same = C.checkpointed(features.select("doc_id", *sets).join(many, sets).filter("doc_id != rep").select("doc_id", "rep"))
    of = same.groupBy("doc_id").agg(F.min("rep").alias("rep"), F.max("rep").alias("last"))
    own = node.select(F.col("node").alias("__node")).distinct()
    of = C.checkpointed(of.join(own, F.col("doc_id") == F.col("__node"), "left").withColumn("joins", (F.col("rep") != F.col("last")) | F.col("__node").isNotNull()))
    several = of.filter("joins").select(F.col("doc_id").alias("__doc"))
    return of.filter("not joins").select("doc_id", "rep"), same.join(several, F.col("doc_id") == F.col("__doc"), "left_semi").toDF("a", "b").distinct()


def grouped(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, rows: int = ROWS, bands: int = BANDS, block: int = BLOCK, visitors: int = VISITORS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links, itself included), kept (doc_id = component_id).

    Null or blank text: no shingles, linked with nothing. Fewer words than a shingle: all of them as one. Rows with the same
    doc_id count as one node, linked by what any of them is linked by; a null doc_id is its own, unkept-by-none row
    (component_id null, kept true). Other columns of docs are not looked at."""
    none = docs.filter("doc_id is null").select("doc_id", "text").mapInArrow(lambda it: _features(it, size, rows, bands), "doc_id long, n_shingles long, high long, low long, bands array<long>, sketch binary")
    docs = docs.filter("doc_id is not null")
    features = C.checkpointed(docs.select("doc_id", "text").mapInArrow(lambda it: _features(it, size, rows, bands), "doc_id long, n_shingles long, high long, low long, bands array<long>, sketch binary"))
    first = features.filter("n_shingles > 0").groupBy("n_shingles", "high", "low").agg(F.min(F.struct("doc_id", "bands", "sketch")).alias("r"), F.count("*").alias("copies"))
    node = C.checkpointed(first.select("n_shingles", "high", "low", "copies", F.col("r.doc_id").alias("node"), "r.bands", "r.sketch"))
    band = node.select("node", "high", F.explode("bands").alias("key"))
    bucket = C.checkpointed(band.groupBy("key").agg(F.min("high").alias("pivot"), F.count("*").alias("members")).filter("members > 1"))
    inside = C.checkpointed(band.join(bucket, "key"))
    pairs = C.checkpointed(inside.filter("high != pivot").select(F.col("pivot").alias("high_a"), F.col("node").alias("b"), F.col("high").alias("high_b")).distinct())
    pairs, hot = _dealt(pairs, PIVOT_PAIRS)
    pivots = _in_parts(node.select(F.col("high").alias("high_a"), F.col("node").alias("a"), F.col("sketch").alias("x")), hot)
    pairs = pairs.join(pivots, ["high_a", "part"]).filter("a != b")
    pairs = pairs.join(node.select(F.col("high").alias("high_b"), F.col("node").alias("b"), F.col("sketch").alias("y")), ["b", "high_b"])
    alike = pairs.select("a", "high_a", "b", "high_b", "part", "x", "y").mapInArrow(lambda it: _alike(it, SKETCH_LEAST), "a long, high_a long, b long, high_b long, part int")
    links = _verified(C.checkpointed(alike), hot, docs, size, percent)
    copies, more = _copies(features, node)
    found = components(links.union(more))
    more = C.checkpointed(_across(inside.filter("members > 2"), found, node, docs, size, percent, block, visitors))
    if not more.isEmpty():
        found = components(found.toDF("a", "b").union(more))
    least = found.toDF("__node", "component")
    behind = copies.join(least, F.col("rep") == F.col("__node"), "left").select(F.col("doc_id").alias("__node"), F.coalesce("component", "rep").alias("component"))
    out = features.select("doc_id", "n_shingles").join(least.unionByName(behind), F.col("doc_id") == F.col("__node"), "left")
    component = F.coalesce("component", "doc_id")
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), (component == F.col("doc_id")).alias("kept"))
    return out.unionByName(none.select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept")))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs without those that are linked, directly or through others, with a smaller doc_id. Columns stay, whatever their names."""
    kept = C.unclashing(grouped(docs, **options).filter("kept and doc_id is not null").select("doc_id"), "doc_id", docs)
    return docs.filter("doc_id is not null").join(kept, docs["doc_id"] == kept[kept.columns[0]], "left_semi").unionByName(docs.filter("doc_id is null"))
