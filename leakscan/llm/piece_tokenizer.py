"""Ids of whole texts by the tokenizers library, each distinct piece of which is encoded once.

Texts are cut only where the byte-level pre-tokenizer always cuts: before ASCII white space after a
character that isn't white space, after a letter before an ASCII character that isn't one, and before and
after a line end that is followed by something else than white space. Pieces are found and told apart over Arrow buffers.
"""

from __future__ import annotations

import functools
import itertools
import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from leakscan.llm import words as W

_B = np.arange(256)
_WHITE, _LETTER, _SOLID, _TAIL, _LEAD2, _LEAD3 = (1 << i for i in range(6))
# lead bytes of characters among which is white space (C2, E1 to E3) and of four bytes are left out
_KIND = sum(
    np.where(which, bit, 0)
    for bit, which in (
        (_WHITE, ~W.SOLID),
        (_LETTER, ((_B | 32) >= 97) & ((_B | 32) <= 122)),
        (_SOLID, (_B > 32) & (_B < 127)),
        (_TAIL, (_B >= 0x80) & (_B < 0xC0)),
        (_LEAD2, (_B >= 0xC3) & (_B < 0xE0)),
        (_LEAD3, (_B == 0xE0) | ((_B >= 0xE4) & (_B < 0xF0))),
    )
).astype(np.uint8)
_FIRST = (_KIND & _SOLID > 0).tolist()
#: How GPT-2's byte-level alphabet writes a byte.
_ASIS = ((_B > 32) & (_B < 127)) | ((_B > 160) & (_B != 173))
_CHARS = np.where(_ASIS, _B, 255 + np.cumsum(~_ASIS)).astype("<u4")
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}


def cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where a piece may begin, the texts' starts among them: a flag for each byte."""
    kind = _KIND[data]
    tail = kind & _TAIL > 0
    # the last byte of a character that isn't white space, and of a letter
    letter = kind & _LETTER > 0
    letter[1:] |= _latin(data)
    solid = kind & _SOLID > 0
    solid[1:] |= tail[1:] & (kind[:-1] & _LEAD2 > 0)
    solid[2:] |= tail[2:] & tail[1:-1] & (kind[:-2] & _LEAD3 > 0)
    out = np.zeros(len(data), bool)
    out[1:] = (kind[1:] & _WHITE > 0) & solid[:-1]
    out[1:] |= (kind[1:] & (_SOLID | _LETTER) == _SOLID) & letter[:-1]
    # a line end before something else than white space is a token of its own, whatever precedes it
    single = (data[:-1] == 10) & (kind[1:] & (_SOLID | _LEAD2 | _LEAD3) > 0)
    single[starts[starts > 0] - 1] = False
    out[1:] |= single
    out[:-1] |= single
    out[starts] = True
    return out


def _latin(data: np.ndarray) -> np.ndarray:
    """Whether a byte and the one before it are a letter from U+00C0 to U+00FF; for each byte but the first."""
    return (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] < 0xC0) & (data[1:] & 0xDF != 0x97)


def words(pieces: pa.Array) -> np.ndarray:
    """Which pieces are Latin letters only, after one space at most: the pre-tokenizer never cuts them."""
    n = len(pieces)
    _, offs, data = pieces.buffers()
    offs = np.frombuffer(offs, np.int32, n + pieces.offset + 1)[pieces.offset :]
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if offs[-1] > offs[0] else np.zeros(0, np.uint8)
    offs = offs - offs[0]
    other = _KIND[data] & _LETTER == 0
    latin = _latin(data)
    other[1:] &= ~latin
    other[:-1] &= ~latin
    filled = offs[:-1] < offs[1:]
    space = np.zeros(n, bool)
    space[filled] = data[offs[:-1][filled]] == 32
    others = np.append(0, np.cumsum(other))[offs]
    return (np.diff(offs) > space) & (np.diff(others) == space)


def _simple(piece: bytes) -> bool:
    """Whether a piece is encoded alike as a line of a longer text: it begins with a word, after one space at most."""
    return len(piece) > 1 and 10 not in piece and _FIRST[piece[piece[0] == 32]]


class PieceTokenizer:
    #: Pieces that are remembered, the longest of them, and pieces that are encoded by one call.
    KEPT, LONG, LINES = 400_000, 40, 500

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        [self.end] = self.tok.encode("\n", add_special_tokens=False).ids
        self.plain = self._plain()
        #: Pieces, and each one's ids in flat; numbers of the latest texts' pieces.
        self.known = pa.array([], pa.binary())
        self.flat, self.start, self.count = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.latest = np.zeros(0, np.int64)

    def _plain(self):
        """The library's tokenizer of the same model, whose texts are pieces in the byte-level alphabet, cut at its line end; None if
        the file's pre-tokenizer does more than a piece of letters passes unchanged."""
        from tokenizers import Tokenizer

        spec = json.loads(self.tok.to_str())
        if spec["normalizer"] or spec["pre_tokenizer"] != _BYTE_LEVEL or any(s.strip().isalpha() for s in self.special):
            return None
        #: Bytes of each id.
        self.wide = np.zeros(max(self.tok.get_vocab().values()) + 1, np.int64)
        for token, i in self.tok.get_vocab().items():
            self.wide[i] = len(token)
        return Tokenizer.from_str(json.dumps(spec | {"pre_tokenizer": {"type": "CharDelimiterSplit", "delimiter": chr(_CHARS[10])}, "post_processor": None}))

    def forget(self) -> None:
        """All pieces but the latest texts'."""
        keep, count = self.latest, self.count[self.latest]
        ends = np.cumsum(count, dtype=np.int32)
        self.flat = self.flat[np.repeat(self.start[keep] - (ends - count), count) + np.arange(int(count.sum()))]
        self.known, self.start, self.count = self.known.take(pa.array(keep)), ends - count, count
        self.latest = np.arange(len(keep))

    def alone(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids one after another, and the number of ids of each."""
        ids = [e.ids for e in self.tok.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]
        return np.fromiter(itertools.chain.from_iterable(ids), np.int32), np.fromiter(map(len, ids), np.int64, len(ids))

    def lines(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As lines of one text, as one call for each costs more."""
        ids = np.array(self.tok.encode_batch_fast([b"\n".join(pieces).decode()], add_special_tokens=False)[0].ids, np.int32)
        end = ids == self.end
        at = np.flatnonzero(end)
        if len(at) != len(pieces) - 1:
            return self.alone(pieces)
        return ids[~end], np.diff(at, prepend=-1, append=len(ids)) - 1

    def words(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of letters, without the pre-tokenizer's search: the ids' bytes tell where pieces end."""
        text = _CHARS[np.frombuffer(b"\n".join(pieces), np.uint8)].tobytes().decode("utf-32-le")
        ids = np.array(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
        ends, at = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces))), np.cumsum(self.wide[ids])
        last = np.searchsorted(at, ends)
        if len(ids) != last[-1] + 1 or (at[last] != ends).any():
            return self.alone(pieces)
        return ids, np.diff(last, prepend=-1)

    def add(self, new: pa.Array) -> np.ndarray:
        """Encodes pieces; returns their numbers."""
        pieces = new.to_numpy(zero_copy_only=False).tolist()
        # words, others that can be encoded as lines, then the rest, the long ones last
        kind = np.full(len(pieces), 2, np.int8)
        if self.plain is not None:
            kind[words(new)] = 0
        others = np.flatnonzero(kind)
        kind[others] -= np.fromiter((_simple(pieces[i]) for i in others.tolist()), np.int8, len(others))
        kind[pc.binary_length(new).to_numpy() > self.LONG] = 3
        order = np.argsort(kind, kind="stable")
        pieces = [pieces[i] for i in order.tolist()]
        ends = np.searchsorted(kind[order], [1, 2, 3]).tolist()
        got = [self.words(pieces[i : min(i + self.LINES, ends[0])]) for i in range(0, ends[0], self.LINES)]
        got += [self.lines(pieces[i : min(i + self.LINES, ends[1])]) for i in range(ends[0], ends[1], self.LINES)]
        got.append(self.alone(pieces[ends[1] :]))
        count = np.concatenate([c for _, c in got])
        numbers = np.empty(len(pieces), np.int64)
        numbers[order] = np.arange(len(self.start), len(self.start) + len(pieces))
        self.start = np.append(self.start, (len(self.flat) + np.cumsum(count) - count).astype(np.int32))
        self.count = np.append(self.count, count.astype(np.int32))
        self.flat = np.concatenate([self.flat, *(i for i, _ in got)])
        self.known = pa.concat_arrays([self.known, new.take(pa.array(order[: ends[2]]))])
        return numbers

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts one after another as UTF-8: their ids one after another, and the number of ids of each."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offs) - 1, np.int64)
        if len(self.known) > self.KEPT:
            self.forget()
        starts = offs[:-1][offs[:-1] < offs[1:]]
        cut = cuts(data, starts)
        raw = data.tobytes()
        for s in map(str.encode, self.special):
            at = raw.find(s)
            while at >= 0:
                # a text that holds a special token's string is one piece
                i = np.searchsorted(offs, at, "right") - 1
                cut[offs[i] + 1 : offs[i + 1]] = False
                at = raw.find(s, offs[i + 1])
        at = np.append(np.flatnonzero(cut), len(data)).astype(np.int32)
        pieces = pc.dictionary_encode(pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(raw)]))
        found = pc.index_in(pieces.dictionary, value_set=self.known)
        new = found.is_null().to_numpy(zero_copy_only=False)
        which = found.fill_null(0).to_numpy().astype(np.int64)
        which[new] = self.add(pieces.dictionary.filter(pa.array(new)))
        distinct, which = which, which[pieces.indices.to_numpy()]
        count = self.count[which]
        ends = np.append(np.int32(0), np.cumsum(count, dtype=np.int32))
        place = np.repeat(self.start[which] - ends[:-1], count)
        place += np.arange(ends[-1], dtype=np.int32)
        ids = self.flat[place]
        # long pieces aren't remembered
        kept = len(self.known)
        self.latest = distinct[distinct < kept]
        self.start, self.count = self.start[:kept], self.count[:kept]
        self.flat = self.flat[: int(self.start[-1] + self.count[-1]) if kept else 0]
        return ids, np.diff(ends[np.searchsorted(at, offs)])


@functools.lru_cache(1)
def tokenizer(path: str) -> PieceTokenizer:
    """One for a worker: later tasks find the pieces of earlier ones."""
    return PieceTokenizer(path)
