"""Exact substring dedup with a Burrows-Wheeler transform.

A window is a string of MIN bytes. Equal windows have the same anchor, the smallest of their GRAM-byte
hashes (the leftmost of equals), at the same place. A text is cut into runs: consecutive windows
with one anchor, with the bytes they cover. Anchors that occur once in the corpus can't hold a
repeated window. The runs of the others are collapsed to distinct contents with a weight and grouped
by anchor, so equal windows always meet in a group. A group of one content is repeated as a whole;
of the other groups' contents one copy of the bytes is fetched.

For a batch of groups, the contents are joined by separators, sorted to depth MIN at least, and the
transform is taken. Breadth-first backward extension (interval of w -> intervals of cw) then
sets the common prefixes of neighbours by increasing value: an interval that ends where no value
is set yet sets its length and is extended further. It stops at MIN: neighbours still without a
value share MIN bytes or more. Windows among these, and all windows of a content with a weight over
1, are repeated.

An anchor with more than CROWD distinct contents has its runs cut into shorter ones, grouped by
the bytes that all windows of a piece cover, and crowded pieces into single windows; so one
passage that is everywhere is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscan.llm import words as W
from leakscan.llm.common import drop_saved, lean, release, save

MIN, GRAM = 200, 64
CROWD, BATCH, PIECE = 2000, 1 << 20, 16
#: Longer texts are looked at in overlapping pieces of this many bytes.
PART = 1 << 21
_PLACE_BITS = np.uint64(24)
_VALUE = W.constants(256, 11)
_BASE = W.constants(1, 12)[0]
_BASES = W.constants(2, 13)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place on."""
    h, width, factor = _VALUE[data], 1, int(_BASE)
    while width < GRAM:
        h = h[:-width] * np.uint64(factor) + h[width:]
        width, factor = 2 * width, factor * factor % (1 << 64)
    return W.mix(h)


def windows_min(x: np.ndarray, n: int) -> np.ndarray:
    width = 1
    while 2 * width <= n:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (n - width)], x[n - width :]) if n > width else x


def runs_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts one after another: each run's anchor hash, start, number of windows, the anchor's distance from the start."""
    none = np.zeros(0, np.int64)
    if len(data) < MIN:
        return none.view(np.uint64), none, none, none
    h = gram_hashes(data)
    packed = (h >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(h), dtype=np.uint64)
    place = (windows_min(packed, MIN - GRAM + 1) & np.uint64((1 << 24) - 1)).astype(np.int64)
    whole = np.zeros(len(place) + MIN, np.int8)
    long = offs[1:] - offs[:-1] >= MIN
    np.add.at(whole, offs[:-1][long], 1)
    np.add.at(whole, offs[1:][long] - MIN + 1, -1)
    whole = np.cumsum(whole[: len(place)], dtype=np.int8) > 0
    new = np.append(True, (place[1:] != place[:-1]) | (whole[1:] != whole[:-1]))
    new[offs[:-1][long]] = True
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(place)))
    ok = whole[at]
    at, n = at[ok], n[ok]
    return h[place[at]], at, n, place[at] - at


_inverse = np.ones(1, np.uint64)


def inverse_powers(n: int) -> np.ndarray:
    global _inverse
    if len(_inverse) < n:
        p = np.full(max(n, 256), pow(int(W.powers(2)[1]), -1, 1 << 64), np.uint64)
        p[0] = 1
        _inverse = np.cumprod(p, dtype=np.uint64)
    return _inverse


def slice_hashes(data: np.ndarray, at: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Hash of each slice of data, the same wherever the slice stands."""
    sums = np.append(np.uint64(0), np.cumsum(_VALUE[data] * W.powers(len(data))[: len(data)], dtype=np.uint64))
    h = (sums[at + lens] - sums[at]) * inverse_powers(len(data) + 1)[at]
    return W.mix(h + lens.astype(np.uint64) * _BASES[0])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        docs, e1 = b.column("doc_id"), b.column("e1")
        for i, j, data, offs in W.parts(b.column("text")):
            # a long text is alone
            for s in range(0, len(data), PART) if j - i == 1 else (0,):
                some, ends = (data[s : s + PART + MIN - 1], np.array([0, min(PART + MIN - 1, len(data) - s)])) if j - i == 1 else (data, offs)
                m, at, n, dist = runs_of(some, ends)
                if len(m):
                    row = np.searchsorted(ends, at, "right") - 1
                    cols = [docs.take(pa.array(i + row)), e1.take(pa.array(i + row)), m.view(np.int64), slice_hashes(some, at, n + MIN - 1).view(np.int64), at - ends[row] + s, n, dist]
                    types = [None, None, pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([c if t is None else pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "e1", "anchor", "content", "at", "n", "dist"])


def content_hash(data: np.ndarray) -> int:
    return int(slice_hashes(data, np.array([0]), np.array([len(data)]))[0].view(np.int64))


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted runs."""
    for b in batches:
        for i in range(0, b.num_rows, 64):
            c = b.slice(i, 64)
            wanted = c.column("wanted")
            run = wanted.flatten()
            at, n = (run.field(f).to_numpy() for f in ("at", "n"))
            texts = [np.frombuffer(t.encode(), np.uint8) for t in c.column("text").to_pylist()]
            per = wanted.value_lengths().to_numpy()
            owner = np.repeat(np.arange(len(texts)), per)
            own = [texts[o][s : s + k + MIN - 1].tobytes() for o, s, k in zip(owner.tolist(), at.tolist(), n.tolist(), strict=True)]
            cols = [run.field("anchor"), run.field("content"), run.field("weight"), run.field("n"), run.field("dist"), pa.array(own, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["grp", "content", "weight", "n", "dist", "bytes"])


def sort_suffixes(s: np.ndarray) -> np.ndarray:
    """Places of s (symbols 0 to 256, read around its end) in the order of the MIN symbols or more from there on; ties in order of place."""
    n = len(s)
    key = np.zeros(n, np.int64)
    for j in range(7):
        key = (key << 9) | np.roll(s, -j)
    depth = 7
    while True:
        order = np.argsort(key, kind="stable") if depth >= MIN else np.argsort(key)
        new = np.append(True, key[order][1:] != key[order][:-1])
        if depth >= MIN:
            return order
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        if new.all():
            return order
        key = (rank << 32) | np.roll(rank, -depth)
        depth *= 2


def repeated_places(s: np.ndarray) -> np.ndarray:
    """For each place of s (0 separates): whether the MIN symbols from there on occur elsewhere. Only for places with no separator so near."""
    n = len(s)
    order = sort_suffixes(s)
    bwt = s[order - 1]
    lf = np.empty(n, np.int64)
    by = np.argsort(bwt, kind="stable")
    lf[by] = np.arange(n)
    nxt, prv = np.full(n, n, np.int64), np.full(n, -1, np.int64)
    same = bwt[by][1:] == bwt[by][:-1]
    nxt[by[:-1][same]], prv[by[1:][same]] = by[1:][same], by[:-1][same]
    known = np.zeros(n + 1, bool)
    known[[0, n]] = True
    lo, hi = np.array([0]), np.array([n])
    for _ in range(MIN):
        one = hi - lo == 1
        single = lf[lo[one]]
        lo, hi = lo[~one], hi[~one]
        size = hi - lo
        inner = np.arange(int(size.sum())) + np.repeat(lo - (np.cumsum(size) - size), size)
        inner_lo, inner_hi = np.repeat(lo, size), np.repeat(hi, size)
        first, last = inner[prv[inner] < inner_lo], inner[nxt[inner] >= inner_hi]
        # intervals of different strings of one length are apart, so both ends sort alike
        lo = np.concatenate([np.sort(lf[first]), single])
        hi = np.concatenate([np.sort(lf[last]), single]) + 1
        new = ~known[hi]
        lo, hi = lo[new], hi[new]
        known[hi] = True
        if not len(lo):
            break
    out = np.zeros(n, bool)
    out[order] = ~(known[:-1] & known[1:])
    return out


def _spans(mask: np.ndarray) -> list[list[int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return edge.reshape(-1, 2).tolist()


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (grp, content, weight, n, bytes) sorted by grp and content: the repeated windows of each content, as spans of starts."""

    def look(rows: list[tuple]) -> pa.RecordBatch:
        s = np.concatenate([np.append(np.frombuffer(r[4], np.uint8).astype(np.int16) + 1, 0) for r in rows])
        found = repeated_places(s.astype(np.int16))
        at, out = 0, []
        for grp, content, weight, n, data in rows:
            mask = np.ones(n, bool) if weight > 1 else found[at : at + n]
            at += len(data) + 1
            if mask.any():
                out.append((grp, content, _spans(mask)))
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.list_(pa.int32())))], ["grp", "content", "spans"])

    rows: list[tuple] = []
    size = 0
    for b in batches:
        for r in zip(*(b.column(c).to_pylist() for c in ("grp", "content", "weight", "n", "bytes")), strict=True):
            if rows and rows[-1][:2] == r[:2]:
                continue
            if size >= BATCH and rows[-1][0] != r[0]:
                yield look(rows)
                rows, size = [], 0
            rows.append(r)
            size += len(r[4]) + 1
    if rows:
        yield look(rows)


def _cut(width: int):
    """Pieces of width windows of each content, grouped by the bytes that all of a piece's windows cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                rows = []
                for whole, content, weight, n, dist, data in zip(*(b.slice(i, 512).column(c).to_pylist() for c in ("grp", "content", "weight", "n", "dist", "bytes")), strict=True):
                    x = np.frombuffer(data, np.uint8)
                    # pieces begin at fixed distances from the anchor
                    edges = sorted({0, n, *range(dist % width, n, width)})
                    for s, e in zip(edges[:-1], edges[1:], strict=True):
                        lead = (s - dist) // width * width + dist
                        core = x[max(lead + width - 1, 0) : lead + MIN]
                        grp = content_hash(core) ^ (whole * 31 + (lead - dist))
                        rows.append((whole, content, s, weight, e - s, dist - s, x[s : e + MIN - 1].tobytes(), (grp + (1 << 63)) % (1 << 64) - (1 << 63), content_hash(x[s : e + MIN - 1])))
                cols = list(zip(*rows, strict=True)) or [()] * 9
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["whole", "of", "at", "weight", "n", "dist", "bytes", "grp", "content"])

    return run


def _repeated(contents: DataFrame, widths: tuple[int, ...] = (PIECE, 1)) -> DataFrame:
    """contents (grp, content, weight, n, dist, bytes): grp, content, spans."""
    groups = contents.groupBy("grp").agg(F.count("*").alias("kinds"), F.sum("weight").alias("all"))
    groups = save(groups.where("all > 1").select("grp", (F.col("kinds") > CROWD).alias("crowded")), "groups")
    usual = contents.join(groups.where("NOT crowded").select("grp"), "grp")
    usual = usual.select("grp", "content", "weight", "n", "bytes").repartition("grp").sortWithinPartitions("grp", "content")
    out = usual.mapInArrow(lean(_search), "grp long, content long, spans array<array<int>>")
    if not widths or groups.where("crowded").isEmpty():
        return out
    crowded = contents.join(groups.where("crowded").select("grp"), "grp")
    cut = save(crowded.mapInArrow(lean(_cut(widths[0])), "whole long, of long, at int, weight long, n int, dist int, bytes binary, grp long, content long"), "pieces")
    pieces = save(cut.groupBy("grp", "content").agg(F.sum("weight").alias("weight"), F.first("n").alias("n"), F.first("dist").alias("dist"), F.first("bytes").alias("bytes")), "piece-contents")
    found = _repeated(pieces, widths[1:])
    found = cut.select("grp", "content", "whole", "of", "at").join(found, ["grp", "content"])
    found = found.select("whole", "of", F.explode(F.transform("spans", lambda s: F.transform(s, lambda v: v + F.col("at")))).alias("span"))
    return out.union(found.groupBy("whole", "of").agg(F.collect_list("span")))


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for text, spans in zip(b.column("text").to_pylist(), b.column("spans"), strict=True):
            data = (text or "").encode()
            edge = np.zeros(len(data) + 1, np.int64)
            for run in spans.as_py() or ():
                for s, e in run["spans"]:
                    edge[run["at"] + s] += 1
                    edge[run["at"] + e + MIN - 1] -= 1
            gone = np.cumsum(edge[:-1]) > 0
            kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
            out.append((len(data), int(gone.sum()), len(_spans(gone)), kept))
        cols = list(zip(*out, strict=True)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) as UTF-8 without every byte of a MIN-byte string that also starts anywhere
    else: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (binary).

    Null texts are empty. Every row counts as a text of its own, so a repeated row, with or without
    a doc_id, repeats its text. Texts of fewer than MIN bytes stay whole.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("e1", F.xxhash64(F.lit(7), F.col("text")))
    schema = "doc_id long, e1 long, anchor long, content long, at long, n int, dist int"
    runs = save(docs.where(F.octet_length("text") >= MIN).mapInArrow(lean(_runs), schema), "runs", few=False)
    shared = runs.groupBy("anchor").agg(F.count("*").alias("times"), (F.min("content") != F.max("content")).alias("mixed")).where("times > 1")
    held = save(runs.join(shared.drop("times"), "anchor"), "held")
    drop_saved(runs)
    release(spark)
    key = [F.coalesce("doc_id", F.lit(0)).alias("d"), F.col("doc_id").isNull().alias("no_id")]
    kinds = held.where("mixed").groupBy("anchor", "content").agg(F.count("*").alias("weight"), F.min(F.struct("doc_id", "e1", "at", "n", "dist")).alias("rep"))
    kinds = kinds.select("rep.*", "anchor", "content", "weight")
    wanted = kinds.groupBy(*key, "e1").agg(F.collect_list(F.struct("at", "n", "dist", "anchor", "content", "weight")).alias("wanted"))
    texts = docs.select(*key, "e1", "text").join(wanted, ["d", "no_id", "e1"]).select("text", "wanted")
    contents = save(texts.mapInArrow(lean(_contents), "grp long, content long, weight long, n int, dist int, bytes binary"), "contents")
    release(spark)
    found = save(_repeated(contents), "repeats")
    drop_saved(contents)
    release(spark)
    whole = held.where("NOT mixed").select("doc_id", "e1", "at", F.expr("array(array(0, n))").alias("spans"))
    some = held.where("mixed").withColumnRenamed("anchor", "grp").join(found, ["grp", "content"]).select("doc_id", "e1", "at", "spans")
    spans = whole.union(some).groupBy(*key, "e1").agg(F.collect_set(F.struct("at", "spans")).alias("spans"))
    out = docs.select(*key, "doc_id", "e1", "text").join(spans, ["d", "no_id", "e1"], "left")
    return out.select("doc_id", "text", "spans").mapInArrow(lean(_cleaned), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
