"""Exact removal of repeated passages with prefix-partitioned suffix trees over words.

Every word starts a suffix; a passage is the first ``window`` words of one. A passage that another document has is an
internal node of the corpus's suffix tree at that depth or below, with leaves of two documents.

1. Elastic prefixes. A suffix whose first words, half a window of them, start in one document only hangs on the tree as a
   leaf above that depth. Blocks of documents send fingerprints of these prefixes, sorted and coded as differences, and learn which
   of them another block has; the other suffixes take no further part. A false match only lets one more suffix through.
2. Suffix trees. The suffixes that are left go to groups by variable-length prefixes of 1, 2, 4, ... words: the
   shortest whose suffixes fit in a group, by counts over all suffixes. A suffix travels as its words, cut at the
   window. A group sorts its suffixes by words, takes the common prefix of each pair of neighbours, and walks these
   lengths to the internal nodes of the wanted depth. Below a node all documents but the smallest lose the passage.
3. Removal. Each block of documents gets the places back and cuts the words that the passages cover.

Before a block sends a suffix it sorts its own, so a passage costs one entry per block and document, and within a block only
those of its smallest document: a passage that a third of all documents repeat is one entry per block of a million words.
Suffixes are compared word by word, a word being a byte of its hash, and then by a check of 64 bits over all their words: different
passages of 13 words would have to agree in 168 bits, and those that differ in one word in 72.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, encoded, prepare, return_memory, row_key, staged, text_batches

CHUNK_BYTES = 24_000_000
#: Bytes of a block of documents that is held at once: 1.2 million words at a window of 13, 787,000 at 50, as a word takes about
#: 100 bytes in arrays besides its suffix's codes, which are held once and sent once.
BLOCK_BYTES, WORD_BYTES = 170_000_000, 100
#: Bytes of the codes of a group of suffixes: a million of them at a window of 13, 362,000 at 50.
GROUP_BYTES = 21_000_000
#: The table of prefix counts has at most so many bins for each prefix length.
MOST_BINS = 1 << 20
#: Bytes of the check that follows a suffix's words.
CHECK = 8


# ---------------------------------------------------------------- coding


def _planes(values: np.ndarray) -> bytes:
    """Ascending unsigned numbers as differences, 16 bits at a time: the upper planes are nearly all zero and compress."""
    step = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    return np.ascontiguousarray(step.view(np.uint16).reshape(-1, 4).T).tobytes()


def _ascending(blob: bytes) -> np.ndarray:
    step = np.ascontiguousarray(np.frombuffer(blob, np.uint16).reshape(4, -1).T).view(np.uint64).reshape(-1)
    return np.cumsum(step, dtype=np.uint64)


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[_edges(x)[:-1]]


def _edges(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]])) if len(x) else np.zeros(1, np.int64)


def word_classes(words: Words, at: np.ndarray, window: int) -> np.ndarray:
    """(n, window + 8) bytes: what a suffix travels as. Each of its words as one byte of its hash, and last a check, the 64-bit hash
    of them all, so that passages which differ in one word only differ here too."""
    small = (words.hash >> np.uint64(56)).astype(np.uint8)
    codes = np.empty((len(at), window + CHECK), np.uint8, order="F")
    for i in range(window):
        codes[:, i] = small[at + i]
    codes[:, window:] = words.runs(window)[at].astype(">u8").view(np.uint8).reshape(-1, CHECK)
    return codes


def pack_suffixes(codes: np.ndarray, doc: np.ndarray, place: np.ndarray) -> bytes:
    """``codes``: (n, window + CHECK); ``doc``: ids; ``place``: where in its block each suffix starts."""
    order = np.argsort(place, kind="stable")
    ids, own = np.unique(doc[order], return_inverse=True)
    head = struct.pack("<III", len(codes), codes.shape[1], len(ids))
    step = np.diff(place[order], prepend=0).astype(np.uint32)
    body = zlib.compressobj(1)
    packed = [head, *[body.compress(x.tobytes()) for x in (ids.astype(np.int64), own.astype(np.uint32), step)]]
    packed += [body.compress(codes[order, c].tobytes()) for c in range(codes.shape[1])]
    return b"".join([*packed, body.flush()])


def unpack_suffixes(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(codes, doc, place)``."""
    n, width, n_ids = struct.unpack_from("<III", blob)
    body = zlib.decompress(blob[12:])
    ids = np.frombuffer(body, np.int64, n_ids)
    own, step = np.frombuffer(body, np.uint32, 2 * n, 8 * n_ids).reshape(2, n)
    codes = np.frombuffer(body, np.uint8, n * width, 8 * n_ids + 8 * n).reshape(width, n).T
    return codes, ids[own], np.cumsum(step, dtype=np.int64)


# ---------------------------------------------------------------- suffix arrays


def sorted_suffixes(codes: np.ndarray, *ties: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``codes``: (n, window) bytes. The order of the rows, ``ties`` deciding among equal ones, and for each
    sorted row how many leading columns it shares with the one before; zero for the first."""
    n, width = codes.shape
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # Least significant first, so that one key of eight columns exists at a time.
    order = np.lexsort(ties[::-1]) if ties else np.arange(n)
    for a in reversed(range(0, width, 8)):
        key = np.zeros(n, np.uint64)
        for c in range(a, min(a + 8, width)):
            key <<= np.uint64(8)
            key |= codes[:, c]
        order = order[np.argsort(key[order], kind="stable")]
    shared = np.zeros(n, np.int64)
    open_ = np.arange(1, n)
    for c in range(width):
        column = codes[order, c]
        open_ = open_[column[open_] == column[open_ - 1]]
        shared[open_] += 1
    return order, shared


def deep_nodes(shared: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Internal nodes of at least ``depth``, from the common prefixes of sorted neighbours: ``(begin, end)`` of the leaves
    below each topmost one."""
    deep = np.concatenate([[False], shared[1:] >= depth, [False]]) if len(shared) else np.zeros(1, bool)
    edge = np.flatnonzero(np.diff(deep.view(np.int8)))
    return edge[0::2], edge[1::2] + 1


# ---------------------------------------------------------------- blocks


class Block:
    """The words of a block of rows, in an order that every read of the block gives: by id and text."""

    def __init__(self, frame: pd.DataFrame, window: int):
        self.rows = frame.sort_values(["doc_id", "key"], kind="stable").reset_index(drop=True)
        self.texts = encoded(self.rows["text"])
        self.words = Words(self.texts)
        self.at = self.words.windows(window)
        self.id = self.rows["doc_id"].to_numpy(np.int64)

    def fingerprints(self, prefix: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the suffixes at ``at``: the fingerprint of each one's prefix and its id."""
        if not len(self.at):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return self.words.runs(prefix)[self.at] >> np.uint64(64 - bits), self.id[self.words.doc[self.at]]


def _send_prefixes(window: int, bits: int, parts: int):
    """Per block and part of the fingerprint range: the block's different fingerprints."""

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        prints = _distinct(Block(frame, window).fingerprints((window + 1) // 2, bits)[0])
        part = (prints * np.uint64(parts)) >> np.uint64(bits)
        edge = _edges(part)
        rows = [(int(part[a]), int(key[0]), _planes(prints[a:b])) for a, b in zip(edge[:-1], edge[1:], strict=True)]
        return pd.DataFrame(rows, columns=["part", "block", "data"])

    return run


def _shared_prefixes(frame: pd.DataFrame) -> pd.DataFrame:
    """Tells each block which of its fingerprints another block has."""
    return_memory()
    blocks = frame["block"].to_numpy(np.int64)
    each = [_ascending(b) for b in frame["data"]]
    own = np.repeat(np.arange(len(each)), [len(x) for x in each])
    prints = np.concatenate([*each, np.zeros(0, np.uint64)])
    order = np.argsort(prints, kind="stable")
    sorted_ = prints[order]
    same = np.zeros(len(sorted_) + 1, bool)
    same[1:-1] = sorted_[1:] == sorted_[:-1]
    common = np.zeros(len(prints), bool)
    common[order] = same[1:] | same[:-1]
    edge = np.searchsorted(own, np.arange(len(each) + 1))
    rows = [(int(blocks[i]), _planes(prints[a:b][common[a:b]])) for i, (a, b) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if common[a:b].any()]
    return pd.DataFrame(rows, columns=["block", "data"])


def _isin(values: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    if not len(ascending):
        return np.zeros(len(values), bool)
    return ascending[np.minimum(np.searchsorted(ascending, values), len(ascending) - 1)] == values


def _of_several(prints: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The fingerprints that several documents have. Ids are numbered and share a word with the fingerprint, if that is wide enough."""
    distinct, number = np.unique(ids, return_inverse=True)
    low = np.uint64(max(1, int(len(distinct)).bit_length()))
    if len(prints) and int(prints.max()).bit_length() + int(low) > 64:
        order = np.lexsort([number, prints])
        prints, number = prints[order], number[order]
    else:
        both = np.sort((prints << low) | number.astype(np.uint64))
        prints, number = both >> low, both & ((np.uint64(1) << low) - np.uint64(1))
    differ = (prints[1:] == prints[:-1]) & (number[1:] != number[:-1])
    return _distinct(prints[1:][differ])


def _prefix_lengths(window: int) -> list[int]:
    return [k for k in (1 << i for i in range(20)) if k < window] or [1]


def _prefix_bins(words: Words, at: np.ndarray, window: int, bins: int) -> Iterator[np.ndarray]:
    return ((words.runs(k)[at] % np.uint64(bins)).astype(np.int64) for k in _prefix_lengths(window))


def _count_prefixes(window: int, bins: int):
    def run(batches):
        total = np.zeros((len(_prefix_lengths(window)), bins), np.int64)
        for frame in text_batches(batches, CHUNK_BYTES):
            words = Words(encoded(frame["text"]))
            at = words.windows(window)
            if len(at):
                for i, own in enumerate(_prefix_bins(words, at, window, bins)):
                    total[i] += np.bincount(own, minlength=bins)
        level, place = np.nonzero(total)
        yield pd.DataFrame({"level": level, "bin": place, "n": total[level, place]})

    return run


def prefix_groups(docs: DataFrame, window: int, group_rows: int, n_chars: int) -> tuple[np.ndarray, int, int, int]:
    """For each prefix length and bin the number of its group, -1 where the prefix must be longer; the first group that
    whole passages name, how many of these there are, and the number of suffixes. Prefixes fall in bins by hash, four for each
    group that ``n_chars`` characters can make and ``MOST_BINS`` at most; the counts cover all suffixes."""
    bins = min(MOST_BINS, 1 << max(10, math.ceil(math.log2(max(1, n_chars / 4 / group_rows) * 4))))
    counted = docs.mapInPandas(_count_prefixes(window, bins), "level int, bin int, n long").groupBy("level", "bin").agg(F.sum("n").alias("n"))
    sizes = np.zeros((len(_prefix_lengths(window)), bins), np.int64)
    found = counted.toPandas()
    sizes[found["level"].to_numpy(np.int64), found["bin"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    groups, begin = np.full(sizes.shape, -1), 0
    for i, own in enumerate(sizes):
        light = (own > 0) & (own <= group_rows)
        number = np.cumsum(np.where(light, own, 0)) // group_rows
        groups[i, light] = begin + number[light]
        begin += int(number[-1]) + 1
    heavy = sizes[-1][sizes[-1] > group_rows].sum()
    return groups, begin, max(1, math.ceil(heavy / group_rows)), int(sizes[0].sum())


def _spans(cover: np.ndarray) -> np.ndarray:
    """[from, to) of the runs of true values."""
    return np.flatnonzero(np.diff(np.concatenate([[False], cover, [False]]).view(np.int8))).reshape(-1, 2)


def _intervals(at: np.ndarray, window: int) -> bytes:
    """Places that a window from any of ``at`` on covers, as ascending ends of intervals."""
    at = np.sort(at)
    gap = np.flatnonzero(np.diff(at) > window)
    low, high = at[np.concatenate([[0], gap + 1])], at[np.concatenate([gap, [len(at) - 1]])] + window
    return _planes(np.stack([low, high], axis=1).reshape(-1))


TRAVELS = "grp long, block long, settled boolean, data binary"


def _send_suffixes(window: int, bits: int, groups: np.ndarray, begin: int, parts: int):
    """The suffixes of a block that another document may share. Those of which the block itself has a smaller document are
    settled and pass through as intervals; the others go to the group of their prefix, one entry a place."""
    names = ["grp", "block", "settled", "data"]

    def run(key, frame: pd.DataFrame, blobs: pd.DataFrame) -> pd.DataFrame:
        block = Block(frame, window) if len(frame) else None
        if block is None or not len(block.at):
            return pd.DataFrame([], columns=names)
        words, number = block.words, int(key[0])
        prints, ids = block.fingerprints((window + 1) // 2, bits)
        known = np.sort(np.concatenate([_of_several(prints, ids), *[_ascending(b) for b in blobs["data"]]]))
        open_ = _isin(prints, known)
        at, ids = block.at[open_], ids[open_]
        if not len(at):
            return pd.DataFrame([], columns=names)
        del prints, known, open_
        codes = word_classes(words, at, window)
        order, shared = sorted_suffixes(codes, ids, at)
        first = np.flatnonzero(shared < codes.shape[1])
        later = ids[order] != np.repeat(ids[order[first]], np.diff(first, append=len(order)))
        rows = [(number % (begin + parts), number, True, _intervals(at[order[later]], window))] if later.any() else []
        # The codes stay where they are: ``kept`` says which of them travel.
        kept = order[~later]
        at, ids = at[kept], ids[kept]
        del order, shared, later
        group = np.full(len(at), -1)
        for i, own in enumerate(_prefix_bins(words, at, window, groups.shape[1])):
            group = np.where(group < 0, groups[i][own], group)
        group = np.where(group < 0, begin + (words.runs(window)[at] % np.uint64(parts)).astype(np.int64), group)
        order = np.argsort(group, kind="stable")
        edge = _edges(group[order])
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            own = order[a:b]
            rows.append((int(group[own[0]]), number, False, pack_suffixes(codes[kept[own]], ids[own], at[own])))
        return pd.DataFrame(rows, columns=names)

    return run


def _subtrees(window: int):
    """One group of suffixes: sort, common prefixes, deep nodes, and the places of all but each node's smallest document."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        return_memory()
        settled = frame["settled"].to_numpy(bool)
        out = [(b, True, d) for b, d in zip(frame["block"][settled], frame["data"][settled], strict=True)]
        if not settled.all():
            parts = [unpack_suffixes(d) for d in frame["data"][~settled]]
            block = np.repeat(frame["block"].to_numpy(np.int64)[~settled], [len(p[1]) for p in parts])
            codes, doc, place = (np.concatenate(x) for x in zip(*parts, strict=True))
            del parts
            order, shared = sorted_suffixes(codes, doc)
            del codes
            low, high = deep_nodes(shared, window + CHECK)
            doc, place, block = doc[order], place[order], block[order]
            smallest = np.repeat(doc[low], high - low)
            below = np.repeat(low - np.cumsum(np.concatenate([[0], (high - low)[:-1]])), high - low) + np.arange((high - low).sum())
            gone = below[doc[below] != smallest]
            gone = gone[np.argsort(block[gone], kind="stable")]
            edge = _edges(block[gone])
            out += [(int(block[gone[a]]), True, _intervals(place[gone[a:b]], window)) for a, b in zip(edge[:-1], edge[1:], strict=True)]
        return pd.DataFrame(out, columns=["block", "settled", "data"])[["block", "data"]]

    return run


def _without(text: bytes, spans, place: np.ndarray, layout: bool) -> str:
    """``place``: the byte at which each word starts."""
    if len(spans):
        edge = np.append(place, len(text))
        keep, begin = [], 0
        for a, b in spans:
            keep.append(text[begin : edge[a]])
            begin = edge[b]
        text = b"".join([*keep, text[begin:]])
    return (text if layout else b" ".join(text.split())).decode()


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, layout: bool = False, group_rows: int | None = None, block_words: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, n_words, n_removed, spans, kept)`` for every row of ``docs``, and its columns ``carry`` as a struct of that name.

    Words are runs of anything but ASCII white space. A word goes if it lies in a window of ``window`` words whose
    sequence also starts in a document of a smaller id; the smallest keeps it, and repeats within one document stay.
    ``spans`` lists the words [from, to) that go. ``kept`` has the others joined by one space or, with ``layout``, the
    text as it was without them. A null text has no words and an empty ``kept``. A row of null id takes no part: it
    loses nothing and nothing is lost because of it. Rows that repeat an id are never held against each other. Of rows
    equal in id and text one is looked at, and the others get its result.

    A group of suffixes has about ``group_rows`` rows, by default so many that their codes take ``GROUP_BYTES``; a block of documents about
    ``block_words`` words, by default so many that they take ``BLOCK_BYTES``, or one document."""
    prepare(docs.sparkSession)
    group_rows = group_rows or GROUP_BYTES // (window + CHECK)
    block_words = block_words or BLOCK_BYTES // (WORD_BYTES + 2 * (window + CHECK))
    carried = F.struct(*carry) if carry else F.lit(None).cast("struct<none:int>")
    number = F.col(id_col).cast("long")
    rows = docs.select(number.alias("doc_id"), F.col(text_col).alias("text"), carried.alias("carry"), row_key(id_col, text_col).alias("key"))
    known = rows.filter("doc_id IS NOT NULL AND text IS NOT NULL")
    rest = rows.filter("doc_id IS NULL OR text IS NULL")
    again = staged(known.groupBy("key").count().filter("count > 1").select("key"), "again")
    if again.isEmpty():
        return _removed(known, window, layout, group_rows, block_words).drop("key").unionByName(_untouched(rest, layout))
    repeated = known.join(again, "key", "left_semi")
    lone = F.lit(None).cast(rows.schema["carry"].dataType).alias("carry")
    once = repeated.groupBy("doc_id", "key").agg(F.first("text").alias("text")).select("doc_id", "text", lone, "key")
    both = known.join(again, "key", "left_anti").withColumn("shown", F.lit(False)).unionByName(once.withColumn("shown", F.lit(True)))
    both = staged(both.select("doc_id", "text", F.struct("carry", "shown").alias("carry"), "key"), "once")
    done = staged(_removed(both, window, layout, group_rows, block_words), "done")
    columns = ["doc_id", "n_words", "n_removed", "spans", "kept"]
    single = done.filter("NOT carry.shown").select(*columns, "carry.carry")
    shown = done.filter("carry.shown").select("key", *columns)
    given = repeated.select("key", "carry").join(shown, "key").select(*columns, "carry")
    return single.unionByName(given).unionByName(_untouched(rest, layout))


def _removed(known: DataFrame, window: int, layout: bool, group_rows: int, block_words: int) -> DataFrame:
    """``substring_dedup`` of ``known(doc_id, text, carry, key)``, without nulls in the first two; ``key`` is kept."""
    slots = int(known.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_chars = known.agg(F.sum(F.length("text"))).first()[0] or 0
    groups, begin, parts, total = prefix_groups(known.select("text"), window, group_rows, n_chars)
    blocks = max(slots, math.ceil(total / block_words))
    bits = min(60, max(1, total).bit_length() + 8)
    # Read three times, by plans that share one exchange.
    dealt = known.withColumn("block", F.pmod(F.xxhash64("key", "doc_id"), F.lit(blocks)))

    def by_block():
        return dealt.groupBy("block")

    ranges = max(slots, math.ceil(total / 2_000_000))
    prints = by_block().applyInPandas(_send_prefixes(window, bits, ranges), "part long, block long, data binary")
    common = prints.groupBy("part").applyInPandas(_shared_prefixes, "block long, data binary")
    suffixes = by_block().cogroup(common.groupBy("block")).applyInPandas(_send_suffixes(window, bits, groups, begin, parts), TRAVELS)
    removed = suffixes.groupBy("grp").applyInPandas(_subtrees(window), "block long, data binary")
    carry_type = known.schema["carry"].dataType.simpleString()
    schema = f"doc_id long, n_words long, n_removed long, spans array<array<int>>, kept string, carry {carry_type}, key string"

    def cut(frame: pd.DataFrame, blobs: pd.DataFrame) -> pd.DataFrame:
        block = Block(frame, window)
        words, n = block.words, len(block.texts)
        cover = np.zeros(len(words.hash) + 1, np.int64)
        for blob in blobs["data"]:
            low, high = _ascending(blob).astype(np.int64).reshape(-1, 2).T
            np.add.at(cover, low, 1)
            np.add.at(cover, high, -1)
        gone = np.cumsum(cover)[:-1] > 0
        edge = np.searchsorted(words.doc, np.arange(n + 1))
        each = [gone[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True)]
        spans = [_spans(c).tolist() for c in each]
        kept = [_without(t, s, words.place[a:b], layout) for t, s, a, b in zip(block.texts, spans, edge[:-1], edge[1:], strict=True)]
        return pd.DataFrame({"doc_id": block.id, "n_words": np.diff(edge), "n_removed": [int(c.sum()) for c in each], "spans": spans, "kept": kept, "carry": block.rows["carry"], "key": block.rows["key"]})

    return by_block().cogroup(removed.groupBy("block")).applyInPandas(cut, schema)


def _untouched(rest: DataFrame, layout: bool) -> DataFrame:
    """Rows that take no part; a few at most lack an id or a text, so plain expressions do."""
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    kept = F.coalesce("text", F.lit("")) if layout else F.array_join(words, " ")
    return rest.select("doc_id", F.size(words).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.array().cast("array<array<int>>").alias("spans"), kept.alias("kept"), "carry")
