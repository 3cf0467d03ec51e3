"""Token-ID output: tokenizer ids in independently decodable, checksummed, range-coded blocks (id_coder).

File format: a table, range-partitioned and sorted by doc_id, each row of which is a chunk of whole
documents: the chunk's partition and its number there, which give its place in the file; the documents' ids and numbers
of ids; and blocks of BLOCK ids (the last is shorter) with their byte lengths and crc32 sums.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leakscan.llm import words as W
from leakscan.llm.common import lean, save
from leakscan.llm.id_coder import BLOCK, decode_blocks, encode_blocks
from leakscan.llm.piece_tokenizer import tokenizer

#: Blocks that are coded in step, and a chunk's on average; the end id.
LANES, END = 768, 2
#: Rows and bytes of text that are cut to pieces at once.
ROWS, TEXTS = 1500, 5 << 20
#: Chunks up to this many (24 bytes each) have their places sent to each executor; those of more are joined by a shuffle.
BROADCAST_CHUNKS = 500_000
_CHUNK = "part int, seq int, docs array<long>, lens array<long>, sizes array<int>, crcs array<long>, blocks array<binary>"


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<i4", copy=False))


def _sum(ids: np.ndarray, block: bytes) -> int:
    """A block's checksum: of its ids and its bytes, the last of which say more than the ids need."""
    return zlib.crc32(block, _crc(ids))


def pack(docs: list, lens: list[int], ids: np.ndarray) -> dict:
    """A chunk's columns."""
    if len(ids) and (ids.max() > 65535 or ids.min() < 0):
        raise ValueError("ids of 65536 or more don't fit this format")
    blocks = [ids[i : i + BLOCK] for i in range(0, len(ids), BLOCK)]
    data = [b for i in range(0, len(blocks), LANES) for b in encode_blocks(blocks[i : i + LANES])]
    return {"docs": docs, "lens": lens, "sizes": [len(b) for b in blocks], "crcs": [_sum(b, d) for b, d in zip(blocks, data, strict=True)], "blocks": data}


def _chunks(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part, seq = tokenizer(path), TaskContext.get().partitionId(), 0
        docs, lens, ids = [], [], []

        def chunk() -> pa.RecordBatch:
            flat = np.concatenate(ids)
            ids.clear()
            row = {"part": part, "seq": seq} | pack(docs, lens, flat)
            types = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types, strict=True)], list(row))

        for b in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            own = b.column("doc_id").to_pylist()
            for i, j, data, offs in W.parts(b.column("text"), TEXTS):
                got, counts = tok.encode(data, offs)
                ids.append(np.insert(got, np.cumsum(counts), END))
                docs += own[i:j]
                lens += (counts + 1).tolist()
                if sum(map(len, ids)) >= BLOCK * LANES:
                    yield chunk()
                    docs, lens, ids, seq = [], [], [], seq + 1
        if docs:
            yield chunk()

    return run


def read_ids(row: dict) -> tuple[list, list[np.ndarray]]:
    """A chunk's documents and their ids; raises if a block's checksum is wrong."""
    sizes, blocks = np.array(row["sizes"], np.int64), row["blocks"]
    got = [x for i in range(0, len(blocks), LANES) for x in decode_blocks(blocks[i : i + LANES], sizes[i : i + LANES])]
    for x, b, crc in zip(got, blocks, row["crcs"], strict=True):
        if _sum(x, b) != crc:
            raise ValueError("a block's checksum is wrong")
    flat = np.concatenate(got)
    return row["docs"], np.split(flat, np.cumsum(row["lens"])[:-1])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            row = {c: b.column(c)[i].as_py() for c in b.schema.names}
            docs, ids = read_ids(row)
            lens = np.array([len(x) for x in ids], np.int64)
            cols = [np.full(len(docs), row["part"], np.int32), np.full(len(docs), row["seq"], np.int32), np.cumsum(lens) - lens, pa.array(docs, pa.int64()), lens, np.array([_crc(x) for x in ids], np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["part", "seq", "own", "doc_id", "n_tokens", "ids_crc32"])


def write_tokens(docs: DataFrame, path: str) -> DataFrame:
    """Writes the ids of docs (doc_id, text) in ascending doc_id order (null first; rows of one
    doc_id by a hash of their text) to the shared folder; returns the written chunks. Null texts are empty.
    path: the tokenizer's file on every executor."""
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    x = x.withColumn("tie", F.xxhash64("text"))
    parts = x.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    return save(parts.mapInArrow(lean(_chunks(path)), _CHUNK), "tokens", few=False)


def token_table(chunks: DataFrame) -> DataFrame:
    """Per document of written chunks: doc_id, start, n_tokens, ids_crc32, all from the decoded ids and their place in the file."""
    sizes = chunks.select("part", "seq", F.aggregate("sizes", F.lit(0).cast("long"), lambda s, v: s + v).alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row for each partition of the file
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n")).select("part", before(Window.orderBy("part")).alias("base"))
    places = sizes.withColumn("n", before(Window.partitionBy("part").orderBy("seq"))).join(parts, "part").select("part", "seq", (F.col("base") + F.col("n")).alias("base"))
    few = F.broadcast(places) if chunks.select("part").count() <= BROADCAST_CHUNKS else places
    got = chunks.mapInArrow(lean(_read), "part int, seq int, own long, doc_id long, n_tokens long, ids_crc32 long").join(few, ["part", "seq"])
    return got.select("doc_id", (F.col("base") + F.col("own")).alias("start"), "n_tokens", "ids_crc32")
