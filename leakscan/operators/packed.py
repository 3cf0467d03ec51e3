"""Trigrams of texts in blocks of arrays: words numbered by one shuffle of each block's distinct ones, and losses by buckets of middle words.

Tables have a row for each block, or for each block and bucket; arrays stand in binary columns, which pass Spark and Arrow whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext

#: Hashes in a block: more only if a single text has more.
BLOCK = 2_000_000
#: Bits of a row in its block, and of a block in its task.
ROW, SEQUENCE = 20, 14
WORDS = "bucket int, block long, words binary, known binary, times binary"
NUMBERED = "block long, bucket int, ids binary, c1 binary, s1 long, t1 long, most long, hot binary"
BUCKETS = "bucket int, block long, a binary, b binary, w binary, c1 binary, doc binary"


def packs(doc_type: str) -> str:
    return f"block long, tokens long, asked long, docs array<{doc_type}>, n binary, flags binary, words binary, known binary, times binary, codes binary"


def coded(doc_type: str) -> str:
    return f"block long, docs array<{doc_type}>, n binary, flags binary, ids binary, c1 binary, codes binary"


def _cut(v: np.ndarray, at: np.ndarray) -> pa.Array:
    """v as binary values, cut at places."""
    v = np.ascontiguousarray(v)
    ends = np.asarray(at, np.int64) * v.itemsize
    if ends[-1] < 2**31:
        return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(v)])
    return pa.array([v[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.large_binary())


def _whole(v: np.ndarray) -> pa.Array:
    return pa.array([np.ascontiguousarray(v).tobytes()], pa.binary())


def _flat(batches: list[pa.RecordBatch], name: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The values of a binary column, and how many each row has."""
    values, lengths = [], []
    for b in batches:
        c = b.column(name).cast(pa.large_binary())
        ends = np.frombuffer(c.buffers()[1], np.int64)[c.offset : c.offset + len(c) + 1]
        data = np.frombuffer(c.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        values.append(data.view(kind))
        lengths.append(np.diff(ends) // np.dtype(kind).itemsize)
    return np.concatenate(values), np.concatenate(lengths)


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Sorted rows by key, a whole number."""
    held: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if held and k[i] != now:
                yield now, held
                held = []
            now = int(k[i])
            held.append(b.slice(i, j - i))
    if held:
        yield now, held


def _zipped(v: np.ndarray) -> pa.Array:
    return pa.array([len(v).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(np.ascontiguousarray(v, np.int32).tobytes(), asbytes=True)], pa.binary())


def _unzipped(v: bytes) -> np.ndarray:
    n = int.from_bytes(v[:8], "little")
    return np.frombuffer(pa.Codec("zstd").decompress(v[8:], n * 4), np.int32) if n else np.empty(0, np.int32)


def pack(size: int):
    """Texts (doc_id, known, asked, h) as packs()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, blocks, held, n = TaskContext.get().partitionId(), 0, [], 0
        for b in batches:
            b = b.filter(pc.greater(pc.list_value_length(b.column("h")), 2))
            ends, i = np.cumsum(b.column("h").value_lengths().to_numpy()), 0
            while i < b.num_rows:
                before = ends[i - 1] if i else 0
                j = min(b.num_rows, int(np.searchsorted(ends, before + size - n)) + 1)
                held.append(b.slice(i, j - i))
                n += int(ends[j - 1] - before)
                i = j
                if n >= size:
                    yield one(task << SEQUENCE | blocks, held)
                    held, n, blocks = [], 0, blocks + 1
        if held:
            yield one(task << SEQUENCE | blocks, held)

    def one(block: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        h = [b.column("h") for b in held]
        n = np.concatenate([x.value_lengths().to_numpy() for x in h])
        known, asked = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]).astype(bool) for c in ("known", "asked"))
        words, codes = np.unique(np.concatenate([x.flatten().to_numpy() for x in h]).view(np.uint64), return_inverse=True)
        # the first two of a text stand before it
        own, starts = np.repeat(known, n), np.cumsum(n) - n
        own[starts] = own[starts + 1] = False
        docs = pa.concat_arrays([b.column("doc_id") for b in held])
        count = lambda x: _whole(np.bincount(x, minlength=len(words)).astype(np.int32))
        values = [pa.array([block]), *(pa.array([int((n[k] - 2).sum())], pa.int64()) for k in (slice(None), asked)), pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs), _whole(n.astype(np.int32)), _whole(known.astype(np.uint8) | asked.astype(np.uint8) << 1)]
        return pa.RecordBatch.from_arrays([*values, _whole(words), count(codes[own]), count(codes), _zipped(codes)], ["block", "tokens", "asked", "docs", "n", "flags", "words", "known", "times", "codes"])

    return run


def words_by_bucket(buckets: int):
    """packs() as WORDS: a block's distinct words by ranges of their hashes, in which they are sorted already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                row = [b.slice(r, 1)]
                w = _flat(row, "words", np.uint64)[0]
                at = np.searchsorted((w >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
                own = np.flatnonzero(np.diff(at))
                cut = np.append(at[own], at[-1])
                columns = [_cut(w, cut), *(_cut(_flat(row, c, np.int32)[0], cut) for c in ("known", "times"))]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([b.column("block")[r].as_py()] * len(own), pa.int64()), *columns], ["bucket", "block", "words", "known", "times"])

    return run


def number(buckets: int, hot: int):
    """WORDS, sorted by bucket, as NUMBERED: for each block and bucket its words' ids and how often the model knows them; under block -1 those of all words of
    the bucket, their sum and number, the greatest id, and the ids of words that stand more than hot times anywhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, rows in _groups(batches, "bucket"):
            w, n = _flat(rows, "words", np.uint64)
            distinct, at = np.unique(w, return_inverse=True)
            c1, times = (np.bincount(at, _flat(rows, c, np.int32)[0], len(distinct)).astype(np.int64) for c in ("known", "times"))
            rank = np.empty(len(distinct), np.int64)
            rank[np.argsort(-times, kind="stable")] = np.arange(len(distinct))
            ids = rank * buckets + k
            blocks = np.concatenate([b.column("block").to_numpy() for b in rows])
            cut, none = np.append(0, np.cumsum(n)), pa.nulls(len(blocks), pa.int64())
            names = [c.split(" ")[0] for c in NUMBERED.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(blocks), pa.array([k] * len(blocks), pa.int32()), _cut(ids[at], cut), _cut(c1[at], cut), none, none, none, pa.nulls(len(blocks), pa.binary())], names)
            sums = [int(c1.sum()), int(np.count_nonzero(c1)), int(ids.max())]
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([k], pa.int32()), _whole(ids), _whole(c1), *(pa.array([v], pa.int64()) for v in sums), _whole(ids[times > hot])], names)

    return run


def code(kind: type):
    """Packs and their NUMBERED rows, sorted by block and bucket with the pack last, as coded()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, "block"):
            last = rows[-1].slice(rows[-1].num_rows - 1)
            ids, c1 = (_flat(rows, c, np.int64)[0].astype(kind) for c in ("ids", "c1"))
            yield pa.RecordBatch.from_arrays([*(last.column(c) for c in ("block", "docs", "n", "flags")), _whole(ids), _whole(c1), last.column("codes")], ["block", "docs", "n", "flags", "ids", "c1", "codes"])

    return run


def _mixed(ids: np.ndarray) -> np.ndarray:
    return ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)


def of_part(ids: np.ndarray, part: int, parts: int) -> np.ndarray:
    return _mixed(ids) % np.uint64(parts) == part


def each_word(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """NUMBERED rows of all words as w, c1."""
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_flat([b], c, np.int64)[0]) for c in ("ids", "c1")], ["w", "c1"])


def _texts(batches: Iterator[pa.RecordBatch], kind: type, part: int, parts: int) -> Iterator[tuple]:
    """Of each block: its number, ids, counts, codes, rows of codes, flags, which ids are of the part, and a mask of places where a trigram begins."""
    for b in batches:
        for r in range(b.num_rows):
            row = [b.slice(r, 1)]
            ids, c1 = (_flat(row, c, kind)[0] for c in ("ids", "c1"))
            codes, n = _unzipped(b.column("codes")[r].as_py()), _flat(row, "n", np.int32)[0]
            begins, ends = np.ones(len(codes), bool), np.cumsum(n)
            # the last two of a text begin no trigram
            begins[ends - 1] = begins[ends - 2] = False
            yield b.column("block")[r].as_py(), ids, c1, codes, n, _flat(row, "flags", np.uint8)[0], of_part(ids, part, parts), begins[:-2]


def trigrams_by_bucket(kind: type, part: int, parts: int, buckets: int, hot: np.ndarray):
    """coded() as BUCKETS: the trigrams of one part but those with a hot middle word."""
    small = np.uint16 if buckets < 2**16 else np.int64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, c1, codes, n, flags, own, begins in _texts(batches, kind, part, parts):
            bucket = (_mixed(ids) // np.uint64(parts) % np.uint64(buckets)).astype(small)
            at = np.flatnonzero((own & ~np.isin(ids, hot))[codes[1:-1]] & begins)
            k = bucket[codes[at + 1]]
            order = np.argsort(k, kind="stable")
            at, k = at[order], k[order]
            cut = np.append(np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else [], len(k)).astype(np.int64)
            doc = np.repeat(np.arange(len(n), dtype=np.int32) << 2 | flags, n)[at]
            values = [ids[codes[at]], ids[codes[at + 1]], ids[codes[at + 2]], c1[codes[at + 2]], doc]
            yield pa.RecordBatch.from_arrays([pa.array(k[cut[:-1]], pa.int32()), pa.array([block] * (len(cut) - 1), pa.int64()), *(_cut(v, cut) for v in values)], ["bucket", "block", "a", "b", "w", "c1", "doc"])

    return run


def hot_trigrams(kind: type, part: int, parts: int, hot: np.ndarray):
    """coded() as rows: doc_id (a number), known, asked, a, b, w, of the trigrams of one part with a hot middle word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, _, codes, n, flags, own, begins in _texts(batches, kind, part, parts):
            at = np.flatnonzero((own & np.isin(ids, hot))[codes[1:-1]] & begins)
            row = np.repeat(np.arange(len(n)), n)[at]
            doc, f = block << ROW | row, flags[row]
            for i in range(0, len(at), 100_000):
                some = slice(i, i + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(doc[some]), pa.array(f[some] & 1 > 0), pa.array(f[some] & 2 > 0), *(pa.array(ids[codes[at[some] + j]].astype(np.int64)) for j in range(3))], ["doc_id", "known", "asked", "a", "b", "w"])

    return run


def _starts(*sorted_keys: np.ndarray) -> np.ndarray:
    new = np.zeros(len(sorted_keys[0]), bool)
    new[0] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def bucket_losses(kind: type, s1: int, t1: int):
    """BUCKETS, sorted by bucket, as each distinct trigram that is asked for: c3, each (its loss), docs (a number for each time)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, "bucket"):
            a, b, w = (_flat(rows, c, kind)[0] for c in "abw")
            if kind != np.int32:
                a, b, w = (np.unique(v, return_inverse=True)[1] for v in (a, b, w))
            key = b.astype(np.int64) << 32 | w
            del b, w
            order = np.argsort(key)
            key, a = key[order], a[order]
            # pairs b, w in order, and each one's trigrams in order of a
            first = _starts(key)
            pair = np.zeros(len(key), np.int32)
            pair[first[1:]] = 1
            np.cumsum(pair, out=pair)
            again = np.argsort(pair.astype(np.int64) << 32 | a)
            order, a, pairs = order[again], a[again], key[first]
            del key, again
            begin = _starts(pair, a)
            p_of, a_of = pair[begin], a[begin]
            del pair, a
            doc, n = _flat(rows, "doc", np.int32)
            block = np.concatenate([x.column("block").to_numpy() for x in rows])
            doc, flags = (np.repeat(block << ROW, n) | doc >> 2)[order], (doc & 3)[order]
            c1 = _flat(rows, "c1", kind)[0][order[first]]
            c3 = np.add.reduceat((flags & 1).astype(np.int64), begin)
            c2 = np.bincount(p_of, c3, len(pairs))
            b_of = np.cumsum(np.append(0, np.diff(pairs >> 32) != 0))
            s2, t2 = np.bincount(b_of, c2)[b_of], np.bincount(b_of, c2 > 0)[b_of]
            p = np.full(len(pairs), 1.0 / (t1 + 1))
            p = (c1 + t1 * p) / (s1 + t1) if s1 else p
            p = np.where(s2 > 0, (c2 + t2 * p) / np.maximum(s2 + t2, 1), p)[p_of]
            _, two = np.unique(b_of[p_of] << 32 | a_of, return_inverse=True)
            s3, t3 = np.bincount(two, c3)[two], np.bincount(two, c3 > 0)[two]
            each = -np.log(np.where(s3 > 0, (c3 + t3 * p) / np.maximum(s3 + t3, 1), p))
            asked = flags & 2 > 0
            times = np.add.reduceat(asked.astype(np.int64), begin)
            doc, kept = doc[asked], times > 0
            ends, c3, each = np.append(0, np.cumsum(times[kept])), c3[kept], each[kept]
            for i in range(0, len(c3), 100_000):
                j = min(len(c3), i + 100_000)
                docs = pa.ListArray.from_arrays(pa.array(ends[i : j + 1] - ends[i], pa.int32()), pa.array(doc[ends[i] : ends[j]]))
                yield pa.RecordBatch.from_arrays([pa.array(c3[i:j]), pa.array(each[i:j]), docs], ["c3", "each", "docs"])

    return run


def by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What bucket_losses() gives, added up as doc_id (a number), tokens, loss; not yet one row for each."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def added() -> pa.RecordBatch:
        doc, at = np.unique(np.concatenate([d for d, _ in held]), return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(np.bincount(at).astype(np.int64)), pa.array(np.bincount(at, np.concatenate([e for _, e in held])))], ["doc_id", "tokens", "loss"])

    for b in batches:
        docs = b.column("docs")
        held.append((docs.flatten().to_numpy(), np.repeat(b.column("each").to_numpy(), docs.value_lengths().to_numpy())))
        if sum(len(d) for d, _ in held) > BLOCK:
            yield added()
            held.clear()
    if held:
        yield added()
