"""Adaptive context-mixing range coder for token ids, many independent blocks in step.

Every block starts from fresh models. A context of the last two ids and one of the last id each
predict one id, with a count of how often they were right of late. The chances of the two
predictions, by these counts and by whether they agree, are mixed in the logistic domain by weights that
learn from each outcome; the mixed chance is the predicted id's share of the range. The rest of the
range goes to the order-0 model: the block's ids so far, by adaptive frequencies, and an escape.
Escaped ids come first in a stream, by a fixed distribution that falls with the id, as
vocabularies are sorted.

A block is SEGMENTS runs of ids, which share its models and have a stream (a lane) each. Models are frozen
for a round of ids and learn from the whole round at its end. So the encoder
works out a round's chances at once, and the decoder goes step by step over numpy vectors of lanes: with more lanes
a block, a step's calls are made for more ids. Arrays are by step, block and segment.
All arithmetic that decides a bit is on integers, so blocks can be read on any machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK, SEGMENTS = 4096, 8
#: Ids of a round at most; places of the tables of orders 1 and 2.
ROUND, PLACES1, PLACES2 = 256, 256, 512
#: Blocks whose symbols are worked out at once, and steps whose novel ids are looked up at once; steps of a round at once, so that
#: intermediate arrays stay in a core's cache.
ROWS, SOME = 64, 2

# stretch(p) = ln(p / (1 - p)) in 1/256, its inverse, and the fixed distribution of novel ids: weights about 1 / (id + 256)
_P = (np.arange(4096) + 0.5) / 4096
_STRETCH = np.round(np.log(_P / (1 - _P)) * 256).astype(np.int32)
_SQUASH = np.clip(np.round(4096 / (1 + np.exp(-np.arange(-2048, 2048) / 256))), 24, 4072).astype(np.uint16)
_NOVEL = (np.round(np.log1p(np.arange(65537) / 256) / np.log1p(256) * (2**20 - 65536)) + np.arange(65537)).astype(np.int64)
# the id of each unit of that distribution
_OWNER = np.repeat(np.arange(65536, dtype=np.uint16), np.diff(_NOVEL))
_LOW16, _LOW31, _BITS12, _BITS16, _BITS20, _BITS31, _BITS32, _ONE = (np.uint64(v) for v in (0xFFFF, (1 << 31) - 1, 12, 16, 20, 31, 32, 1))
#: A range is from here to 2^63 when a symbol is coded. None takes more than 20 of its bits, so one word of 32 bits makes up for it.
_LEAST = np.uint64(1 << 31)


class _Encoder:
    """Range coder states of n lanes; carries stay in the words until the end."""

    def __init__(self, n: int, most_bits: int):
        self.low, self.range = np.zeros(n, np.uint64), np.full(n, (1 << 63) - 1, np.uint64)
        self.wide = most_bits // 32 + 4
        self.words, self.at = np.zeros(n * self.wide, np.uint64), np.arange(n) * self.wide

    def put(self, m: int) -> None:
        """Words of the first m lanes whose range is small."""
        low, rng = self.low[:m], self.range[:m]
        small = np.flatnonzero(rng < _LEAST)
        old, at = low.take(small), self.at.take(small)
        self.words[at] = old >> _BITS31
        self.at[small] = at + 1
        low[small] = (old & _LOW31) << _BITS32
        rng[small] = rng.take(small) << _BITS32

    def order(self, order: np.ndarray) -> None:
        self.low, self.range, self.at = self.low[order], self.range[order], self.at[order]

    def finish(self) -> list[bytes]:
        """Streams of lanes, in the order that they had at first."""
        # the number in the range that ends in the most zero bytes, which are left out
        zeros = sum((self.range >= np.uint64(1 << b)).astype(np.uint64) for b in (39, 47, 55))
        bits = _BITS31 + np.uint64(8) * zeros
        self.words[self.at] = ((self.low + (_ONE << bits) - _ONE) >> bits) << (bits - _BITS31)
        lane = self.at // self.wide
        ends = np.empty(len(lane), np.int64)
        ends[lane] = 4 * (self.at - lane * self.wide + 1) - zeros.astype(np.int64)
        words = self.words.reshape(len(lane), -1)[:, : int(ends.max(initial=0)) // 4 + 1]
        for j in range(words.shape[1] - 1, 0, -1):
            words[:, j - 1] += words[:, j] >> _BITS32
        short = words.astype(">u4")
        return [short[i].tobytes()[:e] for i, e in enumerate(ends.tolist())]


class _Decoder:
    def __init__(self, streams: list[bytes]):
        wide = max(map(len, streams)) // 4 + 4
        words = np.frombuffer(b"".join(b.ljust(4 * wide, b"\0") for b in streams), ">u4").astype(np.uint64).reshape(-1, wide)
        self.value = (words[:, 0] << _BITS31) | (words[:, 1] >> _ONE)
        self.range = np.full(len(streams), (1 << 63) - 1, np.uint64)
        # a state holds one bit less than two words
        self.words = ((words[:, 1:-1] & _ONE) << _BITS31 | words[:, 2:] >> _ONE).reshape(-1)
        self.at = np.arange(len(streams)) * (wide - 2)

    def get(self, m: int) -> None:
        value, rng = self.value[:m], self.range[:m]
        small = np.flatnonzero(rng < _LEAST)
        at = self.at.take(small)
        # a damaged stream can ask for more than there is
        value[small] = value.take(small) << _BITS32 | self.words.take(at, mode="clip")
        self.at[small] = at + 1
        rng[small] = rng.take(small) << _BITS32

    def order(self, order: np.ndarray) -> None:
        self.value, self.range, self.at = self.value[order], self.range[order], self.at[order]


class _Guesses:
    """Orders 1 and 2 of n blocks, each for itself.

    An entry of a table is an id << 5 and how sure it is, 0 to 3: of order 1 times 8, of order 2 times 2.
    """

    def __init__(self, n: int):
        lane = np.repeat(np.arange(n, dtype=np.int32), SEGMENTS)
        self.n, self.base1, self.base2, self.base = n, lane * PLACES1, lane * PLACES2, lane * 32
        self.table1, self.table2 = np.zeros(n * PLACES1, np.int32), np.zeros(n * PLACES2, np.int32)
        # hits and trials of each prediction, by how sure it is and whether the other agrees
        self.counts = np.ones((2, 2, n, 4, 2), np.int32)
        self.counts[:, 1] = 2
        self.weights = np.full((2, n), 26214, np.int32)
        self.mix()

    def mix(self) -> None:
        """The mixed chance in 1/4096 of each block and pair of contexts."""
        self.s1, self.s2 = _STRETCH[self.counts[:, 0] * 4095 // self.counts[:, 1]]
        w = self.weights[:, :, None, None]
        z = (w[0] * self.s1 >> 16)[:, :, None, :] + (w[1] * self.s2 >> 16)[:, None, :, :]
        self.chance = _SQUASH[np.clip(z + 2048, 0, 4095)]
        self.flat = self.chance.reshape(-1).astype(np.uint64)

    def look(self, last: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, ...]:
        """Places and entries of both tables, predicted ids, contexts; of a step (lanes) or a round (steps, lanes)."""
        h1 = (last & (PLACES1 - 1)) + self.base1
        h2 = (last * 181 + before & (PLACES2 - 1)) + self.base2
        e1, e2 = self.table1.take(h1), self.table2.take(h2)
        guess = np.where(e2 & 31, e2, e1) >> 5
        context = ((e1 | e2) & 31 | ((e1 ^ e2) < 32)) + self.base
        return h1, h2, e1, e2, guess, context

    def learn(self, ids: np.ndarray, hit: np.ndarray, h1: np.ndarray, h2: np.ndarray, e1: np.ndarray, e2: np.ndarray, context: np.ndarray) -> None:
        """From a round's ids, (steps, lanes); of a table's equal places the last counts."""
        outcomes = np.bincount((context << 1 | hit).reshape(-1), minlength=self.n * 64).reshape(self.n, 4, 4, 2, 2)
        hits, trials = outcomes[..., 1], outcomes[..., 0] + outcomes[..., 1]
        error = 4096 * hits - self.chance * trials
        for w, s in zip(self.weights, (self.s1[:, :, None, :], self.s2[:, None, :, :]), strict=True):
            w += (error * s).sum(axis=(1, 2, 3)) >> 12
        np.clip(self.weights, 0, 131072, out=self.weights)
        for k in range(4):
            for i, x in enumerate((hits, trials)):
                self.counts[0, i] += x[:, :, k]
                self.counts[1, i] += x[:, k]
        self.counts >>= self.counts[:, 1:] > 500
        self.mix()
        for i in range(0, len(ids), SOME):
            entry = ids[i : i + SOME] << 5
            for table, h, e, one in ((self.table1, h1[i : i + SOME], e1[i : i + SOME], 8), (self.table2, h2[i : i + SOME], e2[i : i + SOME], 2)):
                other = np.where(e & 31 > one, e - one, entry + one)
                table[h.astype(np.int64)] = np.where((e ^ entry) < 32, np.minimum(e + one, entry + 3 * one), other)


class _Repeats:
    """Order 0 of n blocks: frequencies of an escape (0) and of the block's ids so far, by the escapes before their first."""

    def __init__(self, n: int):
        self.n, self.escapes = n, np.zeros(n, np.int64)
        self.freq, self.ids = np.ones((n, 1), np.uint16), np.zeros((n, 1), np.uint16)

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each symbol's start << 32 | width << 16 | id, block after block; of lanes: where their symbols begin, 2^20 through the whole."""
        ends = np.cumsum(self.freq, axis=1, dtype=np.uint32)
        low = self.freq.astype(np.uint32)
        span = (ends - low).astype(np.uint64)
        low <<= np.uint32(16)
        low |= self.ids
        span <<= _BITS32
        span |= low
        self.whole = ends[:, -1].astype(np.int64)
        row = np.arange(self.n, dtype=np.int32) * self.freq.shape[1]
        return span.reshape(-1), np.repeat(row, SEGMENTS), np.repeat(((1 << 20) // self.whole).astype(np.uint64), SEGMENTS)

    def shares(self) -> tuple[np.ndarray, np.ndarray]:
        """The place in spans of each unit of the whole, block after block, and where lanes' blocks begin; after spans()."""
        whole = self.whole
        return np.repeat(np.arange(self.freq.size, dtype=np.int32), self.freq.reshape(-1).astype(np.int64)), np.repeat(np.cumsum(whole) - whole, SEGMENTS)

    def learn(self, places: np.ndarray, escape: np.ndarray, ids: np.ndarray | None = None) -> None:
        """Of a round: places of repeats in spans, and escapes, (steps, lanes), with the round's ids to decode; repeats
        and escapes count 1; an escape opens a place that counts 1."""
        np.add.at(self.freq.reshape(-1), places, np.uint16(1))
        by_block = escape.reshape(-1, self.n, SEGMENTS).swapaxes(0, 1).reshape(self.n, -1)
        at = np.flatnonzero(by_block)
        block = at // by_block.shape[1]
        counts = np.bincount(block, minlength=self.n)
        # places of the round's escapes, block after block
        place = np.arange(1, len(at) + 1) + (self.escapes - (np.cumsum(counts) - counts))[block]
        self.escapes = self.escapes + counts
        more = int(self.escapes.max(initial=0)) + 1 - self.freq.shape[1]
        self.freq = np.concatenate([self.freq, np.zeros((self.n, more), np.uint16)], axis=1)
        self.freq[:, 0] = 1 + self.escapes
        self.freq[block, place] = 1
        self.ids = np.concatenate([self.ids, np.zeros((self.n, more), np.uint16)], axis=1)
        if ids is not None:
            at -= block * by_block.shape[1]
            self.ids[block, place] = ids[at // SEGMENTS, block * SEGMENTS + at % SEGMENTS]


def _rounds(steps: int) -> Iterator[tuple[int, int]]:
    """Short at first, as all is to be learned."""
    at, width = 0, 1
    while at < steps:
        yield at, min(at + width, steps)
        at, width = at + width, min(2 * width, ROUND // SEGMENTS)


def _symbols(ids: np.ndarray, miss: np.ndarray, rounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ids (blocks, places) that are missed, and their rounds: 0 if not met in an earlier round, else 1 + the escapes before its first;
    and where the escapes are. Symbols of the others mean nothing."""
    n, steps = ids.shape
    step, out, escapes = np.arange(steps, dtype=np.int32), np.empty(ids.shape, np.uint16), np.empty(ids.shape, bool)
    for i in range(0, n, ROWS):
        some = miss[i : i + ROWS]
        lane = np.arange(len(some), dtype=np.int32)[:, None] * steps
        key = np.where(some, ids[i : i + ROWS] << 12 | step, step | 1 << 28)
        key.sort(axis=1)
        head = np.zeros(key.shape, np.int32)
        np.multiply(key[:, 1:] >> 12 != key[:, :-1] >> 12, step[1:], out=head[:, 1:])
        place = key & 4095
        first = place.take(np.maximum.accumulate(head, axis=1) + lane)
        old = (rounds.take(first) < rounds.take(place)) | (key >= 1 << 28)
        place += lane
        escape = escapes[i : i + ROWS]
        escape.reshape(-1)[place] = ~old
        # the first itself is an escape
        before = np.cumsum(escape, axis=1, dtype=np.uint16)
        out[i : i + ROWS].reshape(-1)[place] = before.take(first + lane) * old
    return out, escapes


def _alive(counts: np.ndarray) -> list[int]:
    """How many of the lanes, which are sorted by falling count, have a step 0, 1, ..."""
    return np.searchsorted(-counts, -np.arange(1, int(counts.max(initial=0)) + 1), "right").tolist()


def _code_novel(out: _Encoder, novel: np.ndarray, counts: np.ndarray) -> None:
    """Writes lanes' counts novel ids, which are given one lane after another."""
    n, most = len(counts), int(counts.max(initial=0))
    order = np.argsort(-counts, kind="stable")
    table = np.zeros((n, most), np.int32)
    table[np.arange(most) < counts[:, None]] = novel
    table = np.ascontiguousarray(table[order].T)
    out.order(order)
    for t, k in enumerate(_alive(counts[order])):
        if t % ROWS == 0:
            some = table[t : t + ROWS]
            start, end = _NOVEL.take(some).astype(np.uint64), _NOVEL.take(some + 1).astype(np.uint64)
        r = out.range[:k] >> _BITS20
        out.low[:k] += r * start[t % ROWS, :k]
        out.range[:k] = r * (end[t % ROWS, :k] - start[t % ROWS, :k])
        out.put(k)
    out.order(np.argsort(order))


def _read_novel(src: _Decoder, counts: np.ndarray) -> np.ndarray:
    n, most = len(counts), int(counts.max(initial=0))
    order, table = np.argsort(-counts, kind="stable"), np.zeros((n, most), np.int32)
    src.order(order)
    for t, k in enumerate(_alive(counts[order])):
        r = src.range[:k] >> _BITS20
        value = np.minimum(src.value[:k] // r, (_ONE << _BITS20) - _ONE).astype(np.int64)
        x = _OWNER.take(value).astype(np.int64)
        table[order[:k], t] = x
        start = _NOVEL.take(x)
        src.value[:k] -= r * start.astype(np.uint64)
        src.range[:k] = r * (_NOVEL.take(x + 1) - start).astype(np.uint64)
        src.get(k)
    src.order(np.argsort(order))
    return table[np.arange(most) < counts[:, None]]


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Blocks of at most BLOCK ids below 65536, none empty; a shorter one costs as many steps as the longest."""
    n, steps = len(blocks), -(-max(map(len, blocks)) // SEGMENTS)
    ids, lanes = np.zeros((n, SEGMENTS * steps), np.int32), n * SEGMENTS
    for i, b in enumerate(blocks):
        ids[i, : len(b)] = b
    by_block = ids.reshape(n, SEGMENTS, steps).swapaxes(1, 2).reshape(n, -1)
    to_steps = lambda x: x.reshape(n, steps, SEGMENTS).swapaxes(0, 1).reshape(steps, lanes)
    to_blocks = lambda x: x.reshape(steps, n, SEGMENTS).swapaxes(0, 1).reshape(n, -1)
    ids = np.concatenate([np.zeros((2, lanes), np.int32), to_steps(by_block)])
    guesses, chance, hits = _Guesses(n), np.empty((steps, lanes), np.uint16), np.empty((steps, lanes), bool)
    looks = np.empty((5, ROUND // SEGMENTS, lanes), np.int32)
    for i, j in _rounds(steps):
        for t in range(i, j):
            h1, h2, e1, e2, guess, context = guesses.look(ids[t + 1], ids[t])
            chance[t] = guesses.flat.take(context)
            np.equal(guess, ids[t + 2], out=hits[t])
            for x, v in zip(looks, (h1, h2, e1, e2, context), strict=True):
                x[t - i] = v
        guesses.learn(ids[i + 2 : j + 2], hits[i:j], *looks[:, : j - i])
    rounds = np.concatenate([np.full(SEGMENTS * (j - i), k, np.int32) for k, (i, j) in enumerate(_rounds(steps))])
    symbols, escape = _symbols(by_block, to_blocks(~hits), rounds)
    symbols, escape = to_steps(symbols), to_steps(escape)
    counts, at = escape.sum(axis=0), np.flatnonzero(escape)
    novel = ids[2:].reshape(-1).take(at[np.argsort(at % lanes, kind="stable")])
    # from here on the symbols stand for the ids
    del ids, by_block, guesses, at, looks
    repeats, out = _Repeats(n), _Encoder(lanes, 42 * steps)
    _code_novel(out, novel, counts)
    for i, j in _rounds(steps):
        spans, row, inverse = repeats.spans()
        place = symbols[i:j] + row
        span = spans.take(place, mode="clip")
        start, width, p, hit = span >> _BITS32, span >> _BITS16 & _LOW16, chance[i:j].astype(np.uint64), hits[i:j]
        for t in range(j - i):
            first = (out.range >> _BITS12) * p[t]
            rest = out.range - first
            r = (rest >> _BITS20) * inverse
            out.low += np.where(hit[t], rest, r * start[t])
            out.range = np.where(hit[t], first, r * width[t])
            out.put(lanes)
        repeats.learn(place[~(hit | escape[i:j])], escape[i:j])
    streams = out.finish()
    heads = np.stack([counts.reshape(n, -1), np.reshape(list(map(len, streams)), (n, -1))], axis=1).astype("<u2")
    return [heads[i].tobytes() + b"".join(streams[i * SEGMENTS : (i + 1) * SEGMENTS]) for i in range(n)]


def decode_blocks(blocks: list[bytes], sizes: np.ndarray) -> list[np.ndarray]:
    """The ids of blocks with sizes ids each that were encoded together."""
    n, steps, head = len(blocks), -(-int(sizes.max()) // SEGMENTS), 4 * SEGMENTS
    lanes = n * SEGMENTS
    heads = np.frombuffer(b"".join(b[:head] for b in blocks), "<u2").astype(np.int64).reshape(n, 2, SEGMENTS)
    # a damaged block can count more than there are
    counts, ends = np.minimum(heads[:, 0], steps).reshape(-1), head + np.cumsum(heads[:, 1], axis=1)
    src = _Decoder([b[e - s : e] for b, es, ss in zip(blocks, ends.tolist(), heads[:, 1].tolist(), strict=True) for e, s in zip(es, ss, strict=True)])
    novel = np.append(_read_novel(src, counts), np.int32(0))
    fresh = np.cumsum(counts) - counts
    guesses, repeats, ids = _Guesses(n), _Repeats(n), np.zeros((steps + 2, lanes), np.int32)
    kept, flags = np.empty((6, ROUND // SEGMENTS, lanes), np.int32), np.empty((2, ROUND // SEGMENTS, lanes), bool)
    for i, j in _rounds(steps):
        spans, _, inverse = repeats.spans()
        shares, begin = repeats.shares()
        for t in range(i, j):
            h1, h2, e1, e2, guess, context = guesses.look(ids[t + 1], ids[t])
            first = (src.range >> _BITS12) * guesses.flat.take(context)
            rest = src.range - first
            r = (rest >> _BITS20) * inverse
            hit = src.value >= rest
            # where the guess is right this is some symbol that isn't used
            place = shares.take((src.value // r).view(np.int64) + begin, mode="clip")
            span = spans.take(place)
            start = span >> _BITS32
            src.value -= np.where(hit, rest, r * start)
            src.range = np.where(hit, first, r * (span >> _BITS16 & _LOW16))
            src.get(lanes)
            ids[t + 2] = np.where(hit, guess, (span & _LOW16).view(np.int64))
            escape = (start == 0) > hit
            at = np.flatnonzero(escape)
            own = fresh.take(at)
            ids[t + 2, at] = novel.take(own, mode="clip")
            fresh[at] = own + 1
            for x, v in zip((*kept, *flags), (h1, h2, e1, e2, context, place, hit, escape), strict=True):
                x[t - i] = v
        (*looks, places), (hits, escapes), x = kept[:, : j - i], flags[:, : j - i], ids[i + 2 : j + 2]
        guesses.learn(x, hits, *looks)
        repeats.learn(places[~(hits | escapes)], escapes, x)
    rows = ids[2:].reshape(steps, n, SEGMENTS).transpose(1, 2, 0).reshape(n, -1)
    return [rows[i, :k] for i, k in enumerate(sizes.tolist())]
