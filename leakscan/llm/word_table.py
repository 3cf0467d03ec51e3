"""BPE ids by a distinct-word table, and decoding by an id-to-piece join.

For tokenizers whose pre-tokenizer drops white space, ends a word before a punctuation mark, and has no
pieces across words. Spark cuts texts to words in blocks of documents: a block keeps its texts as
numbers of words, and the words of its own dictionary once, dealt over buckets by their hash. Buckets
then meet: each distinct word of the corpus is encoded once, by the library, in the bucket that
has all blocks' copies of it. Its ids go back to the blocks, which put them in the words' places. So a
word that stands in every line is sent once a block, and no step holds more than a block, a
bucket's distinct words, or one document.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leakscan.llm import words as W
from leakscan.llm.common import give_back, lean, save

#: Bytes of text that are cut at once, and those of a block (a longer text is alone).
TEXTS, BLOCK = 2 << 20, 32 << 20
#: Bytes of words that are looked up at once, ids that are decoded at once.
LOOKUP, IDS = 2 << 20, 1 << 20
#: Words that the library is given at once.
AT_ONCE = 4096
_LETTER = np.array([i < 128 and chr(i).isalpha() for i in range(256)])


class WordTokenizer:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        special = "".join(t.content for t in self.tok.get_added_tokens_decoder().values())
        #: Bytes before which a word ends after a letter: marks that no special token has.
        self.mark = np.array([33 <= i < 127 and not chr(i).isalnum() and chr(i) not in special for i in range(256)])
        if any(c in special for c in " \t\n\x0b\f\r") or any(self.ids([f"ab{by}{b}"])[0] != self.ids(["ab"])[0] + self.ids([b])[0] for by, b in ((" ", "cd"), ("", ","), ("", "'s"), ("", "'cd"))):
            raise ValueError("this tokenizer has pieces across words")

    def ids(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch_fast(words, add_special_tokens=False)]

    def encoded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and all ids. Few words at once, as the library's results take a thousand times the ids' room."""
        count, flat = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in range(0, len(words), AT_ONCE):
            got = self.ids([w.decode() for w in words.slice(i, AT_ONCE).to_pylist()])
            count.append(np.fromiter(map(len, got), np.int64, len(got)))
            flat.append(np.fromiter((x for y in got for x in y), np.int64))
        return np.concatenate(count), np.concatenate(flat)


@functools.lru_cache(1)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


@functools.lru_cache(1)
def pieces(path: str) -> pa.Array:
    """The vocabulary by id, each piece after a space; null where an id has none. The tokenizer itself, which takes a hundred times the room, isn't kept."""
    tok = WordTokenizer(path).tok
    if tok.decoder is not None:
        raise ValueError("this tokenizer has a decoder of its own")
    vocab = tok.get_vocab(with_added_tokens=True)
    out: list = [None] * (max(vocab.values(), default=-1) + 1)
    for piece, i in vocab.items():
        out[i] = b" " + piece.encode()
    return pa.array(out, pa.binary())


def cut(data: np.ndarray, offs: np.ndarray, mark: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Texts one after another: their words in order, and how many each text has."""
    solid = W.SOLID[data]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    inner = offs[:-1][offs[:-1] < len(data)]
    begin[inner] = solid[inner]
    letter = _LETTER[data]
    # letters from U+00C0 to U+00FF
    letter[1:] |= (data[1:] >= 0x80) & (data[1:] < 0xC0) & (data[1:] & 0xDF != 0x97) & (data[:-1] == 0xC3)
    begin[1:] |= mark[data[1:]] & letter[:-1]
    at = np.flatnonzero(begin)
    kept = data[solid]
    place = (np.cumsum(solid, dtype=np.int32)[at] - 1).astype(np.int32)
    ends = np.append(place, np.int32(len(kept)))
    words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(kept)])
    return words, np.diff(np.searchsorted(at, offs))


def _pack(b: bytes) -> bytes:
    return len(b).to_bytes(8, "little") + pa.Codec("zstd", compression_level=3).compress(b, asbytes=True)


def _unpack(b: bytes) -> bytes:
    return pa.decompress(b[8:], int.from_bytes(b[:8], "little"), "zstd", asbytes=True)


def _squeeze(x: np.ndarray) -> bytes:
    """Numbers as compressed planes of bytes: all lowest bytes, then all second ones, and so on."""
    return _pack(np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _spread(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_unpack(b), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


_BLOCK = "block long, bucket int, words binary, docs array<long>, lens binary, places binary"
_BLOCK_TYPES = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("words", pa.binary()), ("docs", pa.list_(pa.int64())), ("lens", pa.binary()), ("places", pa.binary())])


class _Block:
    """A block's dictionary in order of first appearance, and its texts as numbers of words."""

    def __init__(self):
        self.known, self.count, self.texts, self.size = pa.array([], pa.binary()), np.zeros(0, np.int64), [], 0

    def add(self, docs: list, words: pa.Array, lens: np.ndarray, size: int) -> None:
        own = pc.dictionary_encode(words)
        found = pc.index_in(own.dictionary, value_set=self.known)
        new = found.is_null().to_numpy(zero_copy_only=False)
        number = found.fill_null(0).to_numpy().astype(np.int32)
        number[new] = len(self.known) + np.arange(new.sum(), dtype=np.int32)
        self.known = pa.concat_arrays([self.known, own.dictionary.filter(pa.array(new))])
        places = number[own.indices.to_numpy()]
        self.count = np.append(self.count, np.zeros(new.sum(), np.int64)) + np.bincount(places, minlength=len(self.known))
        self.texts.append((docs, lens, places))
        self.size += size

    def rows(self, block: int, buckets: int) -> Iterator[pa.RecordBatch]:
        """The words of each bucket, the most frequent first, then the texts. The word of rank r in bucket b is number r * buckets + b."""
        place = np.zeros(len(self.known), np.int64)
        if len(self.known):
            order = pc.sort_indices(self.known).to_numpy()
            order = order[np.argsort(-self.count[order], kind="stable")]
            joined = np.frombuffer(b"\n".join(self.known.take(pa.array(order)).to_pylist()), np.uint8)
            bucket = (W.word_hashes(joined, np.array([0, len(joined)]))[0] >> np.uint64(20)).astype(np.int64) % buckets
            by = np.argsort(bucket, kind="stable")
            order, bucket = order[by], bucket[by]
            full, first = np.unique(bucket, return_index=True)
            place[order] = (np.arange(len(order)) - np.repeat(first, np.diff(first, append=len(order)))) * buckets + bucket
            held = [_pack(b"\n".join(self.known.take(pa.array(order[i:j])).to_pylist())) for i, j in zip(first, [*first[1:], len(order)], strict=True)]
            for i in range(0, len(full), 512):
                part = held[i : i + 512]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(part), pa.int64()), pa.array(full[i : i + 512].astype(np.int32)), pa.array(part, pa.binary()), *(pa.nulls(len(part), t) for t in (pa.list_(pa.int64()), pa.binary(), pa.binary()))], schema=_BLOCK_TYPES)
        for docs, lens, places in self.texts:
            yield pa.RecordBatch.from_pylist([{"block": block, "docs": docs, "lens": _squeeze(lens), "places": _squeeze(place[places])}], schema=_BLOCK_TYPES)


def _blocks(path: str, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark, part, seq, own = tokenizer(path).mark, TaskContext.get().partitionId(), 0, _Block()
        for b in batches:
            docs = b.column("doc_id").to_pylist()
            for i, j, data, offs in W.parts(b.column("text"), TEXTS):
                words, lens = cut(data, offs, mark)
                own.add(docs[i:j], words, lens, len(data))
                if own.size >= BLOCK:
                    yield from own.rows((part << 32) + seq, buckets)
                    own, seq = _Block(), seq + 1
                    give_back()
        if own.texts:
            yield from own.rows((part << 32) + seq, buckets)

    return run


def _encode(path: str):
    """Words of buckets, all rows of a bucket one after another: their ids, each distinct word encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, last = tokenizer(path), None
        known, count, flat = pa.array([], pa.binary()), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for whole in batches:
            size = np.cumsum([0, *(int.from_bytes(x[:8], "little") for x in whole.column("words").to_pylist())])
            i = 0
            while i < whole.num_rows:
                j = max(i + 1, int(np.searchsorted(size, size[i] + LOOKUP, "right")) - 1)
                b, i = whole.slice(i, j - i), j
                buckets = b.column("bucket").to_pylist()
                if buckets[0] != last:
                    known, count, flat = known[:0], count[:0], flat[:0]
                words = pc.split_pattern(pa.array([_unpack(x).decode() for x in b.column("words").to_pylist()], pa.string()), "\n")
                own = pc.dictionary_encode(words.flatten().cast(pa.binary()))
                found = pc.index_in(own.dictionary, value_set=known)
                new = found.is_null().to_numpy(zero_copy_only=False)
                number = found.fill_null(0).to_numpy().astype(np.int64)
                number[new] = len(known) + np.arange(new.sum())
                fresh = own.dictionary.filter(pa.array(new))
                known, (n, ids) = pa.concat_arrays([known, fresh]), tok.encoded(fresh)
                count, flat = np.append(count, n), np.append(flat, ids)
                first = np.cumsum(count) - count
                which, ends = number[own.indices.to_numpy()], words.offsets.to_numpy() - words.offsets[0].as_py()
                out = []
                for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    n = count[which[s:e]]
                    out.append(_squeeze(np.concatenate([n, flat[_runs(first[which[s:e]], n)]])))
                yield pa.RecordBatch.from_arrays([b.column("block"), b.column("bucket"), pa.array([e - s for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.int32()), pa.array(out, pa.binary())], ["block", "bucket", "n", "codes"])
                last = buckets[-1]
                # of the words met so far only those of the last bucket can come again
                again = np.zeros(len(known), bool)
                begin = ends[next(k for k, x in enumerate(buckets) if x == last)]
                again[which[begin:]] = True
                if buckets[0] == last:
                    again[:] = True
                keep = np.flatnonzero(again)
                known, flat, count = known.take(pa.array(keep)), flat[_runs(first[keep], count[keep])], count[keep]

    return run


def _runs(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... count[0] of them, then those of first[1], and so on."""
    ends = np.cumsum(count)
    return np.repeat(first - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)


def _place(buckets: int):
    """Rows of a block, its words' ids before its texts: the ids of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, table = None, [], None
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(c)[i].as_py() for c in b.schema.names}
                if row["block"] != last:
                    last, held, table = row["block"], [], None
                if row["codes"] is not None:
                    x = _spread(row["codes"])
                    held.append((row["bucket"], x[: row["n"]], x[row["n"] :]))
                    continue
                if table is None:
                    count = np.zeros(buckets * max((len(n) for _, n, _ in held), default=0), np.int64)
                    first = np.zeros(len(count), np.int64)
                    at = 0
                    for bucket, n, ids in held:
                        count[bucket : bucket + len(n) * buckets : buckets] = n
                        first[bucket : bucket + len(n) * buckets : buckets] = at + np.cumsum(n) - n
                        at += len(ids)
                    table, held = (first, count, np.concatenate([np.zeros(0, np.int64), *(ids for _, _, ids in held)]).astype(np.int32)), []
                first, count, flat = table
                lens, places = _spread(row["lens"]), _spread(row["places"])
                n = count[places]
                ids = flat[_runs(first[places], n)]
                ends = np.append(0, np.cumsum(n))[np.append(0, np.cumsum(lens))].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(row["docs"], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))], ["doc_id", "ids"])

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """docs (doc_id, text) as doc_id, ids: what the tokenizers library gives for each whole text, without special tokens
    added, truncation or padding. Null and empty texts have no ids; rows of a null or repeated doc_id stay rows. path: the tokenizer's file on every executor."""
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 2 * tasks
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = save(x.mapInArrow(lean(_blocks(path, buckets)), _BLOCK), "blocks", few=False)
    words = blocks.where("words IS NOT NULL").select("block", "bucket", "words").repartition(tasks, "bucket").sortWithinPartitions("bucket")
    codes = words.mapInArrow(lean(_encode(path)), "block long, bucket int, n int, codes binary")
    texts = blocks.where("words IS NULL").select("block", "docs", "lens", "places")
    both = codes.unionByName(texts, allowMissingColumns=True).repartition(tasks, "block").sortWithinPartitions("block", F.col("codes").isNull())
    return both.mapInArrow(lean(_place(buckets)), "doc_id long, ids array<int>")


def _pieces(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(path)
        give_back()
        size = pc.fill_null(pc.binary_length(table), 0).to_numpy()
        known = table.is_valid().to_numpy(zero_copy_only=False)
        for whole in batches:
            lens = pc.fill_null(pc.list_value_length(whole.column("ids")), 0).to_numpy().astype(np.int64)
            total, i = np.append(0, np.cumsum(lens)), 0
            while i < len(lens):
                j = max(i + 1, int(np.searchsorted(total, total[i] + IDS, "right")) - 1)
                b, n, i = whole.slice(i, j - i), lens[i:j], j
                ids = pc.fill_null(pc.list_flatten(b.column("ids")), -1).to_numpy()
                fits = (ids >= 0) & (ids < len(size))
                fits[fits] = known[ids[fits]]
                ends = np.append(0, np.cumsum(fits))[np.append(0, np.cumsum(n))]
                ids = ids[fits]
                joined = table.take(pa.array(ids))
                data = np.frombuffer(joined.buffers()[2] or b"", np.uint8)[: int(size[ids].sum())]
                at = np.append(0, np.cumsum(size[ids], dtype=np.int64))[ends]
                # each text without the space before its first piece
                full = at[1:] > at[:-1]
                solid = np.ones(len(data), bool)
                solid[at[:-1][full]] = False
                offs = np.append(0, np.cumsum(at[1:] - at[:-1] - full)).astype(np.int32)
                text = pa.Array.from_buffers(pa.string(), len(n), [None, pa.py_buffer(offs), pa.py_buffer(data[solid])])
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("ids"), text], ["doc_id", "ids", "text"])

    return run


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """tokens (doc_id, ids) with text: the ids' pieces, special ones too, with spaces between, as the library's decode gives for a
    tokenizer without a decoder. Null ids and ids that have no piece are passed over; null arrays give the empty text.

    The join with the vocabulary is a lookup in each worker, which has the tokenizer's file and so all of it.
    """
    x = tokens.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return x.mapInArrow(lean(_pieces(path)), "doc_id long, ids array<int>, text string")
