"""Benchmark decontamination: which documents contain a short test item.

A test item of 40 words in a text of 20,000 has a resemblance of 0.002, of which no signature of
the whole text keeps a trace. So the MinHash sketch is taken of the items only: items are
partitioned by size (powers of two), and each partition keeps as many smallest hashes of an item
(a bottom-k sketch) as its largest item may miss at the asked containment, plus one. An item that
is contained therefore shows at least one sketch hash in the text's shingles, wherever they stand:
no contained item is lost. Candidates are then counted exactly over the item's whole shingle set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscan.llm import words as W
from leakscan.llm.common import lean, save

#: Item shingles that are sent to the executors at once (8 bytes each); more items take more passes over the documents.
BLOCK = 1_000_000
_BITS = 20


def sketch_size(n: int, percent: int) -> int:
    """Hashes kept of an item of n shingles: what the largest item of its size partition may miss, plus one."""
    largest = (1 << n.bit_length()) - 1
    return min(n, largest - -(-percent * largest // 100) + 1)


def _item_sets(k: int):
    """Each item's distinct shingles of k words, or of all its words if it has fewer, and how many words those have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets, sizes = [], []
            for _, _, data, offs in W.parts(b.column("text")):
                words, woffs = W.word_hashes(data, offs)
                for s, e in zip(woffs[:-1].tolist(), woffs[1:].tolist(), strict=True):
                    sizes.append(min(e - s, k))
                    sets.append(W.distinct(W.shingle_hashes(words[s:e], sizes[-1])) if e > s else np.zeros(0, np.uint64))
            yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array(sizes, pa.int32()), W.lists(sets)], ["item_id", "words", "shingles"])

    return run


class _Index:
    """Sketch hashes of a block of items, sorted, with a bitmap in front."""

    def __init__(self, items: list[tuple[int, np.ndarray]], percent: int):
        self.items, self.percent = items, percent
        kept = [np.sort(W.mix(s))[: sketch_size(len(s), percent)] for _, s in items]
        h, at = np.concatenate(kept), np.repeat(np.arange(len(items)), [len(x) for x in kept])
        order = np.argsort(h, kind="stable")
        self.h, self.at = h[order], at[order]
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[(h >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def search(self, shingles: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item_id, its size, how many of its shingles are here) for each contained item."""
        m = W.mix(shingles)
        m = m[self.bits[(m >> np.uint64(64 - _BITS)).astype(np.int64)]]
        if not len(m):
            return
        lo, hi = np.searchsorted(self.h, m, "left"), np.searchsorted(self.h, m, "right")
        found = {i for a, z in zip(lo[lo < hi].tolist(), hi[lo < hi].tolist(), strict=True) for i in self.at[a:z].tolist()}
        here = np.sort(shingles) if found else shingles
        for i in sorted(found):
            item, s = self.items[i]
            at = np.searchsorted(here, s)
            n = int((here[np.minimum(at, len(here) - 1)] == s).sum())
            if 100 * n >= self.percent * len(s):
                yield item, len(s), n


def _search(indexes: dict[int, _Index]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = b.column("doc_id").to_pylist(), []
            for i, j, data, offs in W.parts(b.column("text")):
                words, woffs = W.word_hashes(data, offs)
                for n, index in indexes.items():
                    sh = W.shingle_hashes(words, n)
                    for d, s, e in zip(range(i, j), woffs[:-1].tolist(), woffs[1:].tolist(), strict=True):
                        if e - s >= n:
                            out += [(ids[d], *x) for x in index.search(sh[s : e - n + 1])]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ([],) * 4)], ["doc_id", "item_id", "n_item", "n_shared"])

    return run


def contained_items(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Pairs of docs (doc_id, text) and items (item_id, text) such that percent of the item's distinct
    k-word shingles or more occur in the document: doc_id, item_id, n_item, n_shared.

    Items without words match nothing; an item of fewer than k words is one shingle, all its words, and matches
    documents in which these stand one after another. Null ids are kept as they are; repeated rows give repeated pairs.
    """
    sets = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    sets = save(sets.mapInArrow(_item_sets(k), "item_id long, words int, shingles array<long>").where("size(shingles) > 0"), "items")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    schema, out, block, size = "doc_id long, item_id long, n_item long, n_shared long", None, [], 0
    for row in (*sets.toLocalIterator(), None):
        if block and (row is None or size >= BLOCK):
            indexes = {n: _Index([x for m, *x in block if m == n], percent) for n in sorted({m for m, *_ in block})}
            hits = docs.mapInArrow(lean(_search(indexes)), schema)
            out = hits if out is None else save(out, "hits").union(hits)
            block, size = [], 0
        if row is not None:
            block.append((row.words, row.item_id, np.array(row.shingles, np.int64).view(np.uint64)))
            size += len(row.shingles)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def clean(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs without those that contain an item; all columns stay."""
    bad = save(contained_items(docs, items, k, percent).select("doc_id").distinct(), "contaminated")
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)
