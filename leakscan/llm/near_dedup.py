"""MinHash near-dedup with an LSH forest.

Every distinct shingle set gets a signature. Each tree sorts the sets by its own order of the
signature's entries; sets next to each other that share a prefix of MIN_DEPTH entries or more are
candidates. A sorted sweep looks at the WINDOW nearest rows, that is, those of longest common
prefix, so crowded regions are searched at a greater depth and thin ones down to MIN_DEPTH.
A pair of similarity 0.8 shares a prefix in none of the trees with probability 1e-5.

First each set is compared in full with its best neighbour of another component, and components are
formed; a few rounds of this join up what is alike. Then all pairs that are still of different
components and share a prefix of MIN_DEPTH entries are compared: in regions that the window spans
those that the sketch doesn't rule out, in crowded ones all by their full sets, blocks of
a region's rows against blocks. So a group of n near copies costs about n comparisons a round, not n
squared; only rows of a crowded region that no round joined to its largest component meet all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscan.llm import words as W
from leakscan.llm.common import components, drop_saved, join_hot, lean, lean_group, release, save

ENTRIES, TREES, MIN_DEPTH, DEPTH, WINDOW = 128, 16, 3, 8, 32
#: Sketches agree in 0.8 of the entries at the threshold, with a deviation of 0.035; this is 4.2 of it below.
LEAST_AGREED = 0.65
#: Rounds after the first: all but the last take best neighbours only.
ROUNDS = 3
#: Ids up to this many are sent to each executor to pick the texts to compare; more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Rows and shingles of a crowded region that a task gets on each of its two sides.
BLOCK_ROWS, BLOCK_SHINGLES = 2048, 700_000
_HEAD = 1 + 4 * MIN_DEPTH
_FACTORS = W.constants(ENTRIES, 7)[:, None]


def signature(u: np.ndarray) -> np.ndarray:
    low = np.full(ENTRIES, np.iinfo(np.uint64).max)
    for i in range(0, len(u), 2048):
        np.minimum(low, (u[None, i : i + 2048] * _FACTORS).min(axis=1), out=low)
    return (low >> np.uint64(32)).astype(">u4")


def _signed(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, one, two, sig = [], [], [], []
            for u in W.shingle_sets(b.column("text"), k):
                n.append(len(u))
                one.append(int(np.bitwise_xor.reduce(W.mix(u)).view(np.int64)) if len(u) else 0)
                two.append(int(W.mix(u ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64).view(np.int64)) if len(u) else 0)
                sig.append(signature(u).tobytes() if len(u) else None)
            cols = [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(sig, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_shingles", "one", "two", "sig"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                c = b.slice(i, 256)
                yield pa.RecordBatch.from_arrays([c.column("doc_id"), W.lists(list(W.shingle_sets(c.column("text"), k)))], ["id", "shingles"])

    return run


def _tree_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each tree: the tree's number and the first DEPTH entries in its order, the id and its component, a byte of each entry."""
    for b in batches:
        for i in range(0, b.num_rows, 2048):
            c = b.slice(i, 2048)
            sig = np.frombuffer(b"".join(c.column("sig").to_pylist()), np.uint8).reshape(-1, ENTRIES, 4)
            sketch = pa.array([r.tobytes() for r in np.ascontiguousarray(sig[:, :, 3])], pa.binary())
            for t in range(TREES):
                order = [(MIN_DEPTH * t + j) % ENTRIES for j in range(DEPTH)]
                key = np.concatenate([np.full((len(sig), 1), t, np.uint8), sig[:, order].reshape(len(sig), -1)], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in key], pa.binary()), c.column("id"), c.column("comp"), sketch], ["key", "id", "comp", "sketch"])


def _sweep(best: bool):
    """Over rows sorted by key. best: each row's best neighbour; else all neighbours of other components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, comp, sketch = np.zeros((0, 1 + 4 * DEPTH), np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, ENTRIES), np.uint8)
        for b in batches:
            old = len(ids)
            key = np.concatenate([key, np.frombuffer(b"".join(b.column("key").to_pylist()), np.uint8).reshape(-1, 1 + 4 * DEPTH)])
            ids, comp = np.concatenate([ids, b.column("id").to_numpy()]), np.concatenate([comp, b.column("comp").to_numpy()])
            sketch = np.concatenate([sketch, np.frombuffer(b"".join(b.column("sketch").to_pylist()), np.uint8).reshape(-1, ENTRIES)])
            region = np.cumsum(np.append(True, (key[1:, :_HEAD] != key[:-1, :_HEAD]).any(axis=1)))
            top, other = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for o in range(1, WINDOW + 1):
                i = np.flatnonzero(region[o:] == region[:-o])
                if not len(i):
                    break
                i = i[i + o >= old]
                i = i[comp[i] != comp[i + o]]
                same = (sketch[i] == sketch[i + o]).sum(axis=1)
                ok = same >= LEAST_AGREED * ENTRIES
                i, same = i[ok], same[ok]
                if not best:
                    out.append((np.minimum(ids[i], ids[i + o]), np.maximum(ids[i], ids[i + o]), same))
                for x, y in ((i, i + o), (i + o, i)):
                    more = same > top[x]
                    top[x[more]], other[x[more]] = same[more], ids[y[more]]
            if best:
                i = np.flatnonzero(top)
                out = [(ids[i], other[i], top[i])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)], ["a", "b", "same"])
            key, ids, comp, sketch = key[-WINDOW:], ids[-WINDOW:], comp[-WINDOW:], sketch[-WINDOW:]

    return run


def _neighbours(reps: DataFrame, crowded: DataFrame, best: bool) -> DataFrame:
    """A region stays in one partition, so that no pair of its rows is parted; but crowded ones, all pairs of which are compared later, are spread."""
    rows = reps.select("id", "comp", "sig").mapInArrow(lean(_tree_rows), "key binary, id long, comp long, sketch binary")
    rows = rows.withColumn("head", F.substring("key", 1, _HEAD)).join(crowded.withColumn("within", F.lit(True)), "head", "left")
    rows = rows.withColumn("within", F.when(F.col("within"), F.col("key")))
    rows = rows.repartitionByRange("head", "within", F.when(F.col("within").isNotNull(), F.col("id"))).sortWithinPartitions("key", "id")
    return rows.select("key", "id", "comp", "sketch").mapInArrow(lean(_sweep(best)), "a long, b long, same long")


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are as similar as asked for, as edges."""
    x = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
    xy = x.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    xy = xy.select("a", "b", both.alias("both"), (F.size("x") + F.size("y")).alias("sum"))
    return xy.where(F.expr(f"100L * both >= {percent}L * (sum - both)")).select(F.col("a").alias("src"), F.col("b").alias("dst"))


def _nearest(reps: DataFrame, crowded: DataFrame) -> DataFrame:
    """Each id with its best neighbour of another component, once a pair."""
    best = _neighbours(reps, crowded, True).groupBy("a").agg(F.max(F.struct("same", (-F.col("b")).alias("b"))).alias("m"))
    return best.select(F.least("a", -F.col("m.b")).alias("a"), F.greatest("a", -F.col("m.b")).alias("b")).where("a <> b").distinct()


def _heads(reps: DataFrame) -> DataFrame:
    """(head, id, comp, n_shingles) for each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint8).reshape(-1, ENTRIES, 4)
            for t in range(TREES):
                order = [(MIN_DEPTH * t + j) % ENTRIES for j in range(MIN_DEPTH)]
                head = np.concatenate([np.full((len(sig), 1), t, np.uint8), sig[:, order].reshape(len(sig), -1)], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in head], pa.binary()), *(b.column(c) for c in ("id", "comp", "n_shingles"))], ["head", "id", "comp", "n_shingles"])

    return reps.select("id", "comp", "n_shingles", "sig").mapInArrow(lean(run), "head binary, id long, comp long, n_shingles long")


def _joined(percent: int):
    """Over two blocks of a region: edges that join those of different components that are similar, none that is implied by others."""

    def run(keys: tuple, t: pa.Table) -> pa.Table:
        _, left, right = (k.as_py() for k in keys)
        t = t.combine_chunks()
        sets = t.column("shingles").combine_chunks()
        size = np.diff(sets.offsets.to_numpy())
        by_size = np.argsort(size, kind="stable")
        t, size = t.take(pa.array(by_size)), size[by_size]
        ids, block = t.column("id").to_numpy(), t.column("block").to_numpy()
        comp = np.unique(t.column("comp").to_numpy(), return_inverse=True)[1]
        flat = t.column("shingles").combine_chunks().flatten().to_numpy()
        code = np.unique(flat, return_inverse=True)[1].astype(np.int32)
        owner = np.repeat(np.arange(len(ids)), size)
        mark = np.zeros(code.max() + 1, np.int32)
        # shingles of one row only are in no intersection
        shared = np.bincount(code)[code] > 1
        code, owner = code[shared], owner[shared]
        offs = np.searchsorted(owner, np.arange(len(ids) + 1))
        src, dst, q = [], [], block == right
        for i in np.flatnonzero(block == left).tolist():
            # similar sets are within percent of the size
            lo, hi = np.searchsorted(size, [size[i] * percent / 100 - 1e-6, size[i] * 100 / percent + 1e-6])
            other = q[lo:hi] & (comp[lo:hi] != comp[i])
            if not other.any():
                continue
            mark[code[offs[i] : offs[i + 1]]] = 1
            upto = np.append(0, np.cumsum(mark[code[offs[lo] : offs[hi]]]))
            at = offs[lo : hi + 1] - offs[lo]
            both = upto[at[1:]] - upto[at[:-1]]
            mark[code[offs[i] : offs[i + 1]]] = 0
            for j in (lo + np.flatnonzero(other & (100 * both >= percent * (size[lo:hi] + size[i] - both)))).tolist():
                if comp[j] != comp[i]:
                    src.append(ids[i])
                    dst.append(ids[j])
                    comp[comp == comp[j]] = comp[i]
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    return run


def _crowded_links(now: DataFrame, crowded: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame | None:
    """Edges between components among all rows of each crowded region (head)."""
    few = F.broadcast(crowded) if crowded.count() <= BROADCAST_IDS else crowded
    rows = save(_heads(now).join(few, "head"), "crowded-rows")
    sizes = rows.groupBy("head", "comp").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    sizes = sizes.groupBy("head").agg(F.max(F.struct("n", "s", "comp")).alias("most"), F.sum("n").alias("n"), F.sum("s").alias("s")).where("n > most.n")
    blocks = lambda n, s: f"cast(greatest(ceil(({n}) / {BLOCK_ROWS}), ceil(({s}) / {BLOCK_SHINGLES})) as int)"
    # blocks of the largest component follow the others and meet only these
    sizes = sizes.select("head", "most.comp", F.expr(blocks("n - most.n", "s - most.s")).alias("n_rest"), F.expr(blocks("most.n", "most.s")).alias("n_most"))
    sizes = save(sizes.withColumnRenamed("comp", "most"), "crowded-sizes")
    if sizes.isEmpty():
        return None
    few = F.broadcast(sizes) if sizes.count() <= BROADCAST_IDS else sizes
    x = rows.join(few, "head").withColumn("rest", F.expr("comp <> most"))
    x = x.withColumn("block", F.expr("cast(if(rest, pmod(xxhash64(id), n_rest), n_rest + pmod(xxhash64(id), n_most)) as int)"))
    x = x.withColumn("other", F.explode(F.expr("sequence(0, if(rest, n_rest + n_most, n_rest) - 1)")))
    x = save(x.select("head", "id", "comp", "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q")), "crowded-blocks")
    ids = save(x.select("id").distinct(), "crowded-ids")
    near = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = docs.join(near.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")
    sets = save(texts.mapInArrow(lean(_sets(k)), "id long, shingles array<long>").where("size(shingles) > 0"), "crowded-sets")
    return x.join(sets, "id").groupBy("head", "p", "q").applyInArrow(lean_group(_joined(percent)), "src long, dst long").distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Near-duplicate groups of docs (doc_id, text): doc_id, n_shingles, component_id, kept for every row.

    Documents are linked if 100 * |intersection| >= percent * |union| of their sets of k-word
    shingles. Texts without words are linked with nothing. Rows of one doc_id count as one document.
    A row whose doc_id is null is linked with nothing, gets a null component_id and is kept.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = save(docs.mapInArrow(lean(_signed(k)), "doc_id long, n_shingles long, one long, two long, sig binary"), "signed", few=False)
    solid = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = save(solid.groupBy("one", "two").agg(F.min("doc_id").alias("id"), F.count("*").alias("times")), "classes")
    reps = solid.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("comp"), "one", "two", "n_shingles", "sig").join(classes, ["id", "one", "two"], "left_semi")
    reps = save(reps.dropDuplicates(["id", "one", "two"]).drop("one", "two"), "reps")
    crowded = save(_heads(reps).groupBy("head").agg(F.count("*").alias("n")).where(f"n > {WINDOW + 1}").select("head"), "crowded")
    spread = F.broadcast(crowded) if crowded.count() <= BROADCAST_IDS else crowded
    pairs = save(_nearest(reps, spread), "pairs")
    release(spark)
    ids = save(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ids")
    near = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = docs.join(near.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")
    sets = save(texts.mapInArrow(lean(_sets(k)), "id long, shingles array<long>"), "sets")
    member = join_hot(solid.select("doc_id", "one", "two"), classes.where("times > 1"), ["one", "two"], signed.count())
    member = save(member.where("doc_id <> id").select("doc_id", "id").distinct(), "member")
    same_id = member.join(reps.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("src"), F.col("id").alias("dst"))
    links = save(_linked(pairs, sets, percent).union(same_id), "links")
    comps = components(links)
    some = reps.drop("comp").join(near, "id", "left_semi")
    for r in range(ROUNDS):
        # ids outside comps are alone so far
        now = some.join(comps, F.col("id") == F.col("node"), "left").select("id", F.coalesce("comp", "id").alias("comp"), "sig")
        more = _nearest(now, spread) if r < ROUNDS - 1 else _neighbours(now, spread, False).select("a", "b").distinct()
        more = save(more.join(pairs, ["a", "b"], "left_anti"), "more-pairs")
        found = save(_linked(more, sets, percent), "more-links")
        pairs = pairs.union(more)
        release(spark)
        if not found.isEmpty():
            links = links.union(found)
            comps = components(links)
    drop_saved(sets)
    now = reps.drop("comp").join(comps, F.col("id") == F.col("node"), "left").select("id", F.coalesce("comp", "id").alias("comp"), "n_shingles", "sig")
    found = None if crowded.isEmpty() else _crowded_links(now, crowded, docs, k, percent)
    if found is not None and not (found := save(found, "crowded-links")).isEmpty():
        comps = components(links.union(found))
    release(spark)
    ties = member.join(comps, F.col("id") == F.col("node"), "left").select("doc_id", F.coalesce("comp", "id").alias("comp"))
    known = ties.union(comps.select(F.col("node"), "comp")).groupBy("doc_id").agg(F.min("comp").alias("comp"))
    out = signed.select("doc_id", "n_shingles").join(known, "doc_id", "left")
    comp = F.coalesce("comp", "doc_id")
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs without those whose group has a smaller doc_id; all columns stay."""
    gone = near_duplicates(docs, k, percent).where("NOT kept").select("doc_id").distinct()
    return docs.join(save(gone, "gone"), "doc_id", "left_anti").select(*docs.columns)
