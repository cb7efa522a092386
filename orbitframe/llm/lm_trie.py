"""Language-model scores from tries of n-grams in Elias-Fano form.

The model gives a word after two others the smoothed probability
 P3(w) = (c(u v w) + K3 * P2(w)) / (c(u v) + K3),  P2(w) = (c(v w) + K2 * P1(w)) / (c(v) + K2),  P1(w) = (c(w) + 0.1) / (N + 0.1 * (V + 1)),
which sums to one over all words, with shorter contexts at the start of a text. Every text ends in an end token, so a context
occurs as often as it is followed.

Texts are cut into blocks of documents and written as numbers of words. Three exchanges follow, each a row for a block and a shard:
words get ids and counts from shards of the vocabulary; a block's different n-grams go to shards, dealt by the whole n-gram, so that a
frequent n-gram is one entry a block and a frequent context is spread; the shards send back codes in the order asked.
A shard adds up the counts of its n-grams and builds a trie of them. A level holds the children of all nodes one after another as
one monotone sequence, each child's word raised by its left neighbours' total, and monotone pointers to the next level, both in
Elias-Fano form; the last level holds quantised logarithms of relative frequencies in 16 bits. A query goes down from node to node by a
successor search relative to the context's place. Levels lie in one anonymous memory map, so no local files are made."""

from __future__ import annotations

import functools
import mmap
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, _splitmix, encoded, prepare, staged

#: Bytes of text in a block (a longer text is a block of its own), and words or n-grams of a shard, counted once a block.
BLOCK_BYTES, SHARD_ROWS, LEAST_SHARDS = 12_000_000, 2_500_000, 16
#: Weight of the shorter context's probability in that of two words and of three, in occurrences.
K2, K3 = 8.0, 3.0
#: Steps of a code for each factor of ten; code 0 stands for an n-gram that wasn't seen.
STEPS = 4096
END = np.uint64(0x656E645F6F665F74)
#: Queries answered at once.
SLICE = 262_144


@functools.cache
def _select_table() -> np.ndarray:
    """The bit of a 16-bit number at which its k-th one stands."""
    bits = np.unpackbits(np.arange(65_536, dtype="<u2").view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")
    return np.argsort(1 - bits, axis=1, kind="stable").astype(np.uint8)


# ---------------------------------------------------------------- packed arrays

def pack(values: np.ndarray) -> bytes:
    """Whole numbers of 64 bits, byte by byte of all numbers, compressed."""
    planes = np.ascontiguousarray(np.asarray(values).astype("<u8")).view(np.uint8).reshape(-1, 8)
    used = 8
    while used > 1 and not planes[:, used - 1].any():
        used -= 1
    return bytes([used]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes[:, :used].T).tobytes())


def unpack(data: bytes) -> np.ndarray:
    used = data[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(used, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :used] = planes.T
    return out.view("<u8").reshape(-1)


# ---------------------------------------------------------------- Elias-Fano

class EliasFano:
    """A monotone sequence below ``universe``: low bits packed, high bits as ones among zeros, with counts before every 16 bits."""

    def __init__(self, values: np.ndarray, universe: int):
        values = np.asarray(values, np.uint64)
        self.n = len(values)
        self.width = max(0, (max(1, universe) // max(1, self.n)).bit_length() - 1)
        high = (values >> np.uint64(self.width)).astype(np.int64)
        bits = np.zeros((self.n + (int(universe) >> self.width) + 2 + 15) // 16 * 16, bool)
        bits[high + np.arange(self.n)] = True
        self.high = np.packbits(bits, bitorder="little").view("<u2")
        self.ones = np.zeros(len(self.high) + 1, np.uint32)
        np.cumsum(bits.reshape(-1, 16).sum(axis=1), out=self.ones[1:])
        self.zeros = np.arange(len(self.ones), dtype=np.uint32) * np.uint32(16) - self.ones
        self.low = self._packed(values) if self.width else np.zeros(2, np.uint64)

    def _packed(self, values):
        """64 numbers fill ``width`` words; the k-th ones of all such rows are put in their places at once."""
        w, n = self.width, -(-self.n // 64)
        rows = np.zeros(64 * n, np.uint64)
        rows[: self.n] = values & np.uint64((1 << w) - 1)
        rows, out = rows.reshape(n, 64), np.zeros((n, w), np.uint64)
        for k in range(64):
            word, bit = divmod(k * w, 64)
            out[:, word] |= rows[:, k] << np.uint64(bit)
            if bit + w > 64:
                out[:, word + 1] |= rows[:, k] >> np.uint64(64 - bit)
        return np.append(out.reshape(-1), np.uint64(0))

    def arrays(self) -> list[str]:
        return ["high", "ones", "zeros", "low"]

    def _lows(self, i):
        if not self.width:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.width)
        word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        left = (np.uint64(64) - bit) & np.uint64(63)
        over = np.where(bit > 0, self.low[word + 1] << left, np.uint64(0))
        return ((self.low[word] >> bit) | over) & np.uint64((1 << self.width) - 1)

    def _select(self, k, ones: bool):
        """The bit at which the k-th one (or zero) stands."""
        counts = self.ones if ones else self.zeros
        k = k.astype(np.uint32)
        at = np.searchsorted(counts, k, side="right") - 1
        held = self.high[at] if ones else ~self.high[at]
        return at * 16 + _select_table()[held, k - counts[at]]

    def _select_two(self, k, ones: bool):
        """The bits at which the k-th one (or zero) and the next stand, which mostly lie in the same 16 bits."""
        counts = self.ones if ones else self.zeros
        k = k.astype(np.uint32)
        at = np.searchsorted(counts, k, side="right") - 1
        held = self.high[at] if ones else ~self.high[at]
        nth = k - counts[at]
        first = at * 16 + _select_table()[held, nth]
        second = at * 16 + _select_table()[held, np.minimum(nth + np.uint32(1), np.uint32(15))]
        later = np.flatnonzero(k + np.uint32(1) >= counts[at + 1])
        second[later] = self._select(k[later] + np.uint32(1), ones)
        return first, second

    def access(self, i: np.ndarray) -> np.ndarray:
        """The values at places ``i``."""
        i = np.asarray(i, np.int64)
        high = self._select(i, True) - i
        return (high.astype(np.uint64) << np.uint64(self.width)) | self._lows(i)

    def access_two(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values at places ``i`` and at the next ones, which exist."""
        i = np.asarray(i, np.int64)
        first, second = self._select_two(i, True)
        high = ((first - i).astype(np.uint64), (second - i - 1).astype(np.uint64))
        return (high[0] << np.uint64(self.width)) | self._lows(i), (high[1] << np.uint64(self.width)) | self._lows(i + 1)

    def _range(self, x):
        """The places ``[begin, end)`` of the values with the high bits of ``x``, and its low bits."""
        x = np.asarray(x, np.uint64)
        high, low = (x >> np.uint64(self.width)).astype(np.int64), x & np.uint64((1 << self.width) - 1)
        begin, end = self._select_two(np.maximum(high - 1, 0), False)
        lowest = high == 0
        return np.where(lowest, 0, begin - high + 1), np.where(lowest, begin, end - high), low

    def successor(self, x: np.ndarray) -> np.ndarray:
        """The first places whose values aren't less than ``x`` (below the universe); n where there is none."""
        begin, end, low = self._range(x)
        open_ = np.flatnonzero(begin < end)
        while len(open_):
            middle = (begin[open_] + end[open_]) // 2
            less = self._lows(middle) < low[open_]
            begin[open_[less]] = middle[less] + 1
            end[open_[~less]] = middle[~less]
            open_ = open_[begin[open_] < end[open_]]
        return begin

    def place(self, x: np.ndarray) -> np.ndarray:
        """Where ``x`` (below the universe) stands, -1 where it doesn't; a place of several, if it is repeated."""
        begin, end, low = self._range(x)
        out = np.full(len(low), -1, np.int64)
        open_ = np.flatnonzero(begin < end)
        begin, end, low = begin[open_], end[open_], low[open_]
        while len(open_):
            middle = (begin + end) >> 1
            found = self._lows(middle)
            equal, less = found == low, found < low
            out[open_[equal]] = middle[equal]
            begin, end = np.where(less, middle + 1, begin), np.where(less, end, middle)
            on = np.flatnonzero(~equal & (begin < end))
            open_, begin, end, low = open_[on], begin[on], end[on], low[on]
        return out


class Trie:
    """N-grams of one length, given as sorted rows of word ids, with a code each."""

    def __init__(self, words: list[np.ndarray], codes: np.ndarray):
        n = len(codes)
        self.levels, self.pointers, self.tops = [], [], []
        inside = np.ones(n, bool)  # where a new node of the level above starts
        inside[1:] = False
        places = np.array([0], np.int64)
        for depth, column in enumerate(words):
            new = np.concatenate([[True], column[1:] != column[:-1]]) if n else np.zeros(0, bool)
            new |= inside if depth else new
            at = np.flatnonzero(new)
            if depth:
                self.pointers.append(EliasFano(np.append(np.searchsorted(at, places), len(at)), len(at) + 1))
            step = column[at].astype(np.uint64) + np.uint64(1)
            first = np.isin(at, places) if depth else np.arange(len(at)) == 0
            # Within a node words ascend; the first child adds its word to the total so far, the others their distance.
            step[1:] -= np.where(first[1:], np.uint64(0), step[:-1])
            values = np.cumsum(step, dtype=np.uint64)
            self.levels.append(EliasFano(values, int(values[-1]) + 1 if len(values) else 1))
            self.tops.append(values[-1] if len(values) else np.uint64(0))
            inside, places = new, at
        self.codes = np.asarray(codes, np.uint16)
        self._map()

    def _map(self):
        """Move all arrays of all levels into one memory map."""
        holders = [(e, name) for e in [*self.levels, *self.pointers] for name in e.arrays()] + [(self, "codes")]
        size = sum(-(-getattr(e, name).nbytes // 8) * 8 for e, name in holders)
        self.memory, at = mmap.mmap(-1, max(8, size)), 0
        for e, name in holders:
            old = getattr(e, name)
            view = np.frombuffer(self.memory, old.dtype, len(old), at)
            view[:] = old
            setattr(e, name, view)
            at += -(-old.nbytes // 8) * 8

    @property
    def nbytes(self) -> int:
        return len(self.memory)

    def _child(self, depth, begin, end, word):
        """The place of ``word`` among the children ``[begin, end)``, -1 where it isn't there."""
        level = self.levels[depth]
        total = np.zeros(len(word), np.uint64)
        later = np.flatnonzero(begin > 0)
        total[later] = level.access(begin[later] - 1)
        x = total + word.astype(np.uint64) + np.uint64(1)
        out = np.full(len(word), -1, np.int64)
        some = np.flatnonzero((begin < end) & (x <= self.tops[depth]))
        out[some] = level.place(x[some])
        return np.where(out < end, out, -1)

    def find(self, words: list[np.ndarray]) -> np.ndarray:
        """The codes of sorted n-grams; every context is looked up once."""
        n = len(words[0])
        if not n or not len(self.codes):
            return np.zeros(n, np.uint16)
        out = np.zeros(n, np.uint16)
        for a in range(0, n, SLICE):
            own = [w[a : a + SLICE] for w in words]
            place, new = np.zeros(1, np.int64), np.zeros(len(own[0]), bool)
            new[0] = True
            node = np.zeros(len(own[0]), np.int64)  # index, in ``place``, of each row's context
            for depth, column in enumerate(own):
                new = new | np.concatenate([[True], column[1:] != column[:-1]])
                first = np.flatnonzero(new)
                if depth:
                    parent = np.maximum(place[node[first]], 0)
                    begin, end = (v.astype(np.int64) for v in self.pointers[depth - 1].access_two(parent))
                    end = np.where(place[node[first]] < 0, begin, end)
                else:
                    begin, end = np.zeros(len(first), np.int64), np.full(len(first), self.levels[0].n, np.int64)
                place = self._child(depth, begin, end, column[first])
                node = np.cumsum(new) - 1
            got = place[node]
            out[a : a + SLICE] = np.where(got >= 0, self.codes[np.maximum(got, 0)], 0)
        return out


def code_of(count: np.ndarray) -> np.ndarray:
    """Codes of counts: 1 for once, then STEPS for each factor of ten; a code over the corpus size is a relative frequency."""
    return (np.rint(np.log10(np.maximum(count, 1).astype(float)) * STEPS) + 1).astype(np.uint16)


def count_of(code: np.ndarray) -> np.ndarray:
    return np.where(code > 0, 10.0 ** ((code.astype(float) - 1) / STEPS), 0.0)


# ---------------------------------------------------------------- blocks

_BLOCK = "block long, n_words long, n_tokens long, words binary, trained binary, by_use binary, ids binary, flags binary, lengths binary, tokens binary"
NULL, TRAIN, HELD = 1, 2, 4


def _block_row(ids, flags, texts) -> pa.RecordBatch:
    data = Words([t.lower() for t in encoded(texts)])
    n = np.bincount(data.doc, minlength=len(texts)) + 1
    tokens = np.full(len(data.hash) + len(texts), END, np.uint64)
    tokens[np.arange(len(data.hash)) + data.doc] = data.hash
    kept = np.repeat((np.array(flags, np.int64) & TRAIN) > 0, n)
    words, local, count = np.unique(tokens, return_inverse=True, return_counts=True)
    by_use = np.argsort(-count, kind="stable")
    trained = np.bincount(local, weights=kept, minlength=len(words)).astype(np.int64)
    place = np.empty(len(words), np.int64)
    place[by_use] = np.arange(len(words))
    row = {
        "block": uuid.uuid4().int >> 65, "n_words": len(words), "n_tokens": len(tokens), "words": words.astype("<u8").tobytes(), "trained": pack(trained),
        "by_use": pack(by_use), "ids": pack(np.array(ids, np.int64)), "flags": pack(np.array(flags)), "lengths": pack(n), "tokens": pack(place[local]),
    }
    return pa.RecordBatch.from_pylist([row], _SCHEMAS["block"])


def _blocks(batches):
    ids, flags, texts, size = [], [], [], 0
    for batch in batches:
        for i, null, train, held, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "no_id", "train", "held", "text")), strict=True):
            n = len(text) if text else 0
            if texts and size + n > BLOCK_BYTES:
                yield _block_row(ids, flags, texts)
                ids, flags, texts, size = [], [], [], 0
            ids.append(i)
            flags.append(NULL * null + TRAIN * train + HELD * held)
            texts.append(text)
            size += n
    if texts:
        yield _block_row(ids, flags, texts)


_SCHEMAS = {
    "block": pa.schema([("block", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64()), *[(c, pa.binary()) for c in ("words", "trained", "by_use", "ids", "flags", "lengths", "tokens")]]),
    "word": pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("words", pa.binary()), ("trained", pa.binary())]),
    "mail": pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("shard", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("v", pa.int64()), ("n", pa.int64())]),
    "gram": pa.schema([("kind", pa.int32()), ("shard", pa.int32()), ("block", pa.int64()), ("w1", pa.binary()), ("w2", pa.binary()), ("w3", pa.binary()), ("count", pa.binary())]),
    "score": pa.schema([("doc_id", pa.int64()), ("no_id", pa.bool_()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]),
}
_WORD, _MAIL = "shard int, block long, words binary, trained binary", "block long, kind int, shard int, a binary, b binary, v long, n long"
_GRAM, _SCORE = "kind int, shard int, block long, w1 binary, w2 binary, w3 binary, count binary", "doc_id long, no_id boolean, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _dealt(keys: np.ndarray, shards: int):
    """``(shard, places)`` for every shard that has keys; places ascend."""
    shard = (_splitmix(keys) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    edges = np.flatnonzero(np.concatenate([[True], np.diff(shard[order]) > 0])) if len(order) else np.zeros(0, np.int64)
    for a, b in zip(edges, [*edges[1:], len(order)], strict=True):
        yield int(shard[order[a]]), order[a:b]


def _ask_words(shards: int):
    def run(batches):
        for batch in batches:
            for block, words, trained in zip(*(batch.column(c).to_pylist() for c in ("block", "words", "trained")), strict=True):
                words, trained = np.frombuffer(words, "<u8"), unpack(trained)
                # Words are sorted, and shards are ranges of them, so that a block's answers are in order one after another.
                edges = np.searchsorted(words, [np.uint64((k << 64) // shards) for k in range(1, shards)]).tolist()
                rows = [{"shard": s, "block": block, "words": words[a:b].tobytes(), "trained": pack(trained[a:b])} for s, (a, b) in enumerate(zip([0, *edges], [*edges, len(words)], strict=True)) if a < b]
                yield pa.RecordBatch.from_pylist(rows, _SCHEMAS["word"])

    return run


def _answer_words(shards: int):
    """Ids that are small for frequent words: a word's place by count within its shard, times the number of shards."""

    def run(key, table):
        shard = key[0].as_py()
        held = [np.frombuffer(w, "<u8") for w in table.column("words").to_pylist()]
        words, local = np.unique(np.concatenate(held), return_inverse=True)
        count = np.bincount(local, weights=np.concatenate([unpack(t) for t in table.column("trained").to_pylist()]).astype(float), minlength=len(words)).astype(np.int64)
        ids = np.empty(len(words), np.int64)
        ids[np.argsort(-count, kind="stable")] = np.arange(len(words)) * shards + shard
        edges = np.cumsum([len(h) for h in held])[:-1]
        rows = [{"block": b, "kind": 1, "shard": shard, "a": pack(ids[at]), "b": pack(count[at])} for b, at in zip(table.column("block").to_pylist(), np.split(local, edges), strict=True)]
        rows.append({"block": -1, "kind": 0, "shard": shard, "v": int((count > 0).sum()), "n": int(count.sum())})
        return pa.Table.from_pylist(rows, _SCHEMAS["mail"])

    return run


def _read_block(row: dict, mail: list[dict]):
    """The ids of a block's different words in order; the tokens' ranks among them, their counts and documents; the documents' lengths."""
    answers = sorted((m for m in mail if m["kind"] == 1), key=lambda m: m["shard"])
    ids, counts = (np.concatenate([unpack(m[c]) for m in answers]) for c in ("a", "b"))
    tokens = unpack(row["by_use"]).astype(np.int64)[unpack(row["tokens"]).astype(np.int64)]
    lengths = unpack(row["lengths"]).astype(np.int64)
    order = np.argsort(ids)
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    return ids[order], rank[tokens], counts.astype(np.int64)[tokens], np.repeat(np.arange(len(lengths)), lengths), lengths


def _grams(ids: np.ndarray, rank: np.ndarray, doc: np.ndarray):
    """For two and three words: (places of the last word, sorted different n-grams as columns, place of each occurrence among them).
    ``ids`` are the block's different words in order, ``rank`` those of its tokens; ranks of a block are below 2 ** 32."""
    u = np.uint64(max(1, len(ids)))
    rank = rank.astype(np.uint64)
    ends = np.flatnonzero(doc[1:] == doc[:-1]) + 1
    pairs, own = np.unique(rank[ends - 1] * u + rank[ends], return_inverse=True)
    two = [ids[(pairs // u).astype(np.int64)], ids[(pairs % u).astype(np.int64)]]
    at = np.zeros(len(rank), np.uint64)
    at[ends] = own
    last = np.flatnonzero(doc[2:] == doc[:-2]) + 2
    triples, place = np.unique(at[last - 1] * u + rank[last], return_inverse=True)
    before = (triples // u).astype(np.int64)
    return {2: (ends, two, own), 3: (last, [two[0][before], two[1][before], ids[(triples % u).astype(np.int64)]], place)}


def _mixed(columns: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        out = _splitmix(out ^ c.astype(np.uint64))
    return out


def _ask_grams(shards: int):
    def run(blocks, mail):
        letters, rows = mail.to_pylist(), []
        for row in blocks.to_pylist():
            ids, rank, _, doc, _ = _read_block(row, letters)
            train = (unpack(row["flags"]).astype(np.int64) & TRAIN) > 0
            for kind, (last, columns, own) in _grams(ids, rank, doc).items():
                count = np.bincount(own, weights=train[doc[last]], minlength=len(columns[0])).astype(np.int64)
                for s, at in _dealt(_mixed(columns), shards):
                    held = {f"w{i + 1}": pack(c[at] if i else np.diff(c[at], prepend=np.uint64(0))) for i, c in enumerate(columns)}
                    rows.append({"kind": kind, "shard": s, "block": row["block"], **held, "count": pack(count[at])})
        return pa.Table.from_pylist(rows, _SCHEMAS["gram"])

    return run


def _keys(head: np.ndarray, tail: np.ndarray):
    """One number for each pair, in the pairs' order; the divisor that parts it again; what its quotient stands for, if not itself."""
    u = int(tail.max(initial=0)) + 1
    heads = None
    if (int(head.max(initial=0)) + 1) * u >= 2**64:
        heads, head = np.unique(head, return_inverse=True)
    return head.astype(np.uint64) * np.uint64(u) + tail, np.uint64(u), heads


def merged(columns: list[np.ndarray], count: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted different n-grams with the sums of their counts; those never counted go."""
    seen = count > 0
    columns, count = [c[seen] for c in columns], count[seen]
    decode = []
    key = columns[0]
    for column in columns[1:]:
        key, u, heads = _keys(key, column)
        decode.append((u, heads))
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    total = np.add.reduceat(count[order], first) if len(first) else np.zeros(0, np.int64)
    key, out = key[first], []
    for u, heads in reversed(decode):
        out.insert(0, key % u)
        key = key // u if heads is None else heads[(key // u).astype(np.int64)]
    return [key, *out], total


def _answer_grams(key, table):
    kind, shard = (k.as_py() for k in key)
    held = [[unpack(x) for x in table.column(f"w{i + 1}").to_pylist()] for i in range(kind)]
    held[0] = [np.cumsum(x, dtype=np.uint64) for x in held[0]]
    count = np.concatenate([unpack(x) for x in table.column("count").to_pylist()]).astype(np.int64)
    columns, total = merged([np.concatenate(h) for h in held], count)
    trie = Trie(columns, code_of(total))
    rows = [{"block": b, "kind": kind, "shard": shard, "a": pack(trie.find([h[i] for h in held]))} for i, b in enumerate(table.column("block").to_pylist())]
    return pa.Table.from_pylist(rows, _SCHEMAS["mail"])


def _score_blocks(shards: int, n_all: int, v_all: int):
    def run(blocks, mail):
        letters, out = mail.to_pylist(), []
        for row in blocks.to_pylist():
            ids, rank, c1, doc, lengths = _read_block(row, letters)
            base = (c1 + 0.1) / (n_all + 0.1 * (v_all + 1))
            p, pair = base.copy(), np.zeros(len(rank))
            for kind, (last, columns, own) in _grams(ids, rank, doc).items():
                codes = np.zeros(len(columns[0]), np.uint64)
                answers = {m["shard"]: m["a"] for m in letters if m["kind"] == kind}
                for s, at in _dealt(_mixed(columns), shards):
                    codes[at] = unpack(answers[s])
                count = count_of(codes)[own]
                # A context is an n-gram of the length before; quantised counts may pass it by a little.
                context, k = (c1[last - 1].astype(float), K2) if kind == 2 else (pair[last - 1], K3)
                p[last] = (np.minimum(count, context) + k * p[last]) / (context + k)
                if kind == 2:
                    pair[last] = np.minimum(count, context)
            start = np.cumsum(lengths) - lengths
            flags = unpack(row["flags"]).astype(np.int64)
            sums = [np.add.reduceat(v, start) for v in (np.log10(base), np.log10(p), (c1 > 0).astype(np.int64))]
            made = [unpack(row["ids"]).astype(np.int64), (flags & NULL) > 0, (flags & HELD) > 0, lengths, sums[2], sums[0], sums[1]]
            out.append(pa.Table.from_arrays([pa.array(m) for m in made], schema=_SCHEMAS["score"]))
        return pa.concat_tables(out) if out else _SCHEMAS["score"].empty_table()

    return run


def lm_scores(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)``, a row for each row of ``docs``.

    ``held_out`` is a Column; documents are learned from where it is false. Tokens are the words of the text with A-Z lower-cased, and an
    end. ``n_known`` counts tokens seen in training, ``train_tokens`` all training tokens; ``base_score`` is the sum of log10 P1, ``score``
    that of the model, whose counts of two and three words are quantised to 0.06 %.

    Null texts count as empty: one token, the end. A null ``held_out`` (that of a null id) counts as not held out, and such rows are
    scored but not learned from. Rows that repeat an id are documents of their own. Words are told apart by 64 bits of hash."""
    spark = docs.sparkSession
    prepare(spark)
    number = F.col(id_col).cast("long")
    source = docs.select(F.coalesce(number, F.lit(0).cast("long")).alias("doc_id"), number.isNull().alias("no_id"), F.coalesce(~held_out, F.lit(False)).alias("train"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text_col).alias("text"))
    blocks = staged(source.mapInArrow(_blocks, _BLOCK), "blocks")
    words, tokens = blocks.agg(F.sum("n_words"), F.sum("n_tokens")).first()
    vocabulary, shards = (max(LEAST_SHARDS, -(-(n or 0) // SHARD_ROWS)) for n in (words, tokens))
    asked = blocks.select("block", "words", "trained").mapInArrow(_ask_words(vocabulary), _WORD)
    known = staged(asked.groupBy("shard").applyInArrow(_answer_words(vocabulary), _MAIL), "words")
    v_all, n_all = (x or 0 for x in known.filter("kind = 0").agg(F.sum("v"), F.sum("n")).first())
    texts = blocks.select("block", "by_use", "ids", "flags", "lengths", "tokens").groupBy("block")
    letters = known.filter("kind = 1")
    grams = texts.cogroup(letters.groupBy("block")).applyInArrow(_ask_grams(shards), _GRAM)
    codes = grams.groupBy("kind", "shard").applyInArrow(_answer_grams, _MAIL)
    scored = texts.cogroup(letters.unionByName(codes).groupBy("block")).applyInArrow(_score_blocks(shards, int(n_all), int(v_all)), _SCORE)
    ids = F.when(~F.col("no_id"), F.col("doc_id")).alias(id_col)
    return scored.select(ids, "held_out", "n_tokens", "n_known", F.lit(int(n_all)).cast("long").alias("train_tokens"), "base_score", "score")
