"""SimHash fingerprints and their Hamming self-join as a walk over pairs of binary-trie nodes; near duplicates of a
wanted shingle similarity by an exact set join."""

from __future__ import annotations

import functools
import math
import zlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _splitmix, map_texts, maybe_in, prepare, row_key, staged, text_batches
from .components import connected_components
from .substring import _ascending as ascending
from .substring import _planes as planes

SEED = 42
_LANES = np.uint64(0x0101010101010101)
#: Shingles of different sets that a task counts at once, how often a common one occurs among them, and how many common ones are ordered.
COUNTED, COMMON_FROM, COMMON = 2_000_000, 4, 131_072
#: Bins of a set's hashes. The bins that hold an odd number bound the difference of two sets, in four numbers; sets of more than
#: FINE_FROM shingles, for which these say little, have two to four such bins for each shingle as well, FINE_MOST in all at most.
BINS, PARITY, FINE_FROM, FINE_MOST = 256, ("b0", "b1", "b2", "b3"), 128, 1 << 16
#: Pairs that share one copy of a text.
SALTED = 500
#: Fingerprint columns of a set, tries they are walked in, and bits of a shingle's hash that sets meet on.
PRINTS, TABLES, HASH_BITS = ("f0", "f1", "f2", "f3"), 12, 48
#: First shingles of a set that go with each later one, to tell where a pair has met before. Pairs that meet twice are made one after the join.
HEAD = 32
#: Sets that a task remembers to have sent.
SEEN = 1_000_000


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 of every run of k words, lower-cased A-Z and joined by one space; of all words where there are fewer."""
    words = text.encode().lower().split() if isinstance(text, str) else []
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    starts = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])])
    begin, end = starts[: len(words) - k + 1].tolist(), (starts[k:] - 1).tolist()
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(begin, end, strict=True)), np.uint64, len(begin))


def majority_bits(hashes: np.ndarray) -> np.uint64:
    """Bit i is set where more than half of the hashes have it. Eight bits are counted at once, in the bytes of a
    word that is emptied before a byte can overflow."""
    n = len(hashes)
    if not n:
        return np.uint64(0)
    padded = np.zeros(-(-n // 255) * 255, np.uint64)
    padded[:n] = hashes
    counts = np.zeros((8, 8), np.int64)
    for i in range(8):
        lanes = ((padded >> np.uint64(i)) & _LANES).reshape(-1, 255).sum(axis=1, dtype=np.uint64)
        counts[:, i] = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return np.packbits((2 * counts > n).reshape(-1), bitorder="little").view(np.uint64)[0]


def set_bits(h: np.ndarray, words: int) -> list[np.uint64]:
    """``words`` times 64 fingerprint bits of a set of hashes, each from other hashes of these."""
    return [majority_bits(h if i == 0 else _splitmix(h ^ _splitmix(np.full(1, i, np.uint64)))) for i in range(words)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(doc_id, f0)``: a long of 64 fingerprint bits. Null and empty texts have all bits zero. A shingle counts as often as it
    occurs."""

    def run(batches):
        for frame in batches:
            bits = np.array([majority_bits(shingle_hashes(t, shingle)) for t in frame["text"]], np.uint64)
            yield frame[["doc_id", "no_id"]].assign(f0=bits.view(np.int64))

    return map_texts(docs, run, "f0 long", id_col, text_col)


# ---------------------------------------------------------------- the trie walk


class _Forest:
    """Node labels that only ever merge."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            differ = x != y
            if not differ.any():
                return
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.label[self.label]
                if (up == self.label).all():
                    break
                self.label = up


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


def trie_components(bits: np.ndarray, group: np.ndarray, budget: int, leaf: int = 64, step: int = 100_000) -> np.ndarray:
    """Labels of the components that links of at most ``budget`` differing bits make within each group.

    ``bits``: (n, words) unsigned, rows sorted by (group, bits). A node of the trie is then a range of rows that share
    a group and a number of leading bits. The walk starts from every group paired with itself. A pair of nodes splits on
    the next bit into its pairs of children, the unequal ones with one differing bit more, and goes no further once these
    exceed the budget. It also stops where both nodes already lie wholly in one component, so a dense ball of near
    copies isn't compared pair by pair. Small pairs are compared row by row."""
    n, words = bits.shape
    forest = _Forest(n)
    if n < 2:
        return forest.label
    near = np.flatnonzero(group[1:] == group[:-1])
    near = near[_distance(bits[near], bits[near + 1]) <= budget]
    forest.union(near, near + 1)
    edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
    lo, hi = edge[:-1], edge[1:]
    many = hi - lo > 1
    zero = np.zeros(int(many.sum()), np.int64)
    todo = [np.stack([lo[many], hi[many], lo[many], hi[many], zero, zero], axis=1)]
    total = words * 64
    # cut[d]: rows whose bit d is set, counted from the left, so that a node's split point is found by one lookup.
    ones: dict[int, np.ndarray] = {}

    def split(begin, end, depth):
        out = np.empty(len(begin), np.int64)
        for d in np.unique(depth):
            if d not in ones:
                bit = (bits[:, d // 64] >> np.uint64(63 - d % 64)) & np.uint64(1)
                ones[int(d)] = np.concatenate([[0], np.cumsum(bit.astype(np.int64))])
            at = depth == d
            out[at] = end[at] - (ones[int(d)][end[at]] - ones[int(d)][begin[at]])
        return out

    while todo:
        pairs = todo.pop()
        if len(pairs) > step:
            todo.append(pairs[step:])
            pairs = pairs[:step]
        label = forest.label
        run_end = np.append(np.flatnonzero(label[1:] != label[:-1]) + 1, n)
        whole = run_end[np.searchsorted(run_end, pairs[:, [0, 2]], side="right")] >= pairs[:, [1, 3]]
        same = whole.all(axis=1) & (label[pairs[:, 0]] == label[pairs[:, 2]])
        pairs = pairs[~same & (pairs[:, 1] > pairs[:, 0]) & (pairs[:, 3] > pairs[:, 2])]
        if not len(pairs):
            continue
        size = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2])
        small = (size <= leaf) | (pairs[:, 4] >= total)
        if small.any():
            _compare(bits, forest, pairs[small], size[small], budget)
        pairs = pairs[~small]
        if not len(pairs):
            continue
        a, b, c, d, depth, errors = pairs.T
        m, p = split(a, b, depth), split(c, d, depth)
        own = (a == c) & (b == d)
        kids = [(a, m, c, p, errors, slice(None)), (m, b, p, d, errors, slice(None)), (a, m, p, d, errors + 1, slice(None)), (m, b, c, p, errors + 1, ~own)]
        below = np.concatenate([np.stack([w, x, y, z, depth + 1, e], axis=1)[keep] for w, x, y, z, e, keep in kids])
        todo.append(below[(below[:, 5] <= budget) & (below[:, 1] > below[:, 0]) & (below[:, 3] > below[:, 2])])
    return forest.label


def _compare(bits, forest, pairs, size, budget, rows: int = 2_000_000) -> None:
    begin = 0
    total = np.cumsum(size)
    while begin < len(pairs):
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + rows, side="right")))
        part, n = pairs[begin:end], size[begin:end]
        begin = end
        k = np.arange(n.sum()) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        wide = np.repeat(part[:, 3] - part[:, 2], n)
        x, y = np.repeat(part[:, 0], n) + k // wide, np.repeat(part[:, 2], n) + k % wide
        keep = forest.label[x] != forest.label[y]
        x, y = x[keep], y[keep]
        near = _distance(bits[x], bits[y]) <= budget
        forest.union(x[near], y[near])


def _links(names: list[str], budget: int, rows: int = 300_000):
    """Partitions sorted by (slot, key) and bits -> links (u, v) from each row to the first of its component."""

    def emit(frame):
        bits = frame[names].to_numpy(np.int64).view(np.uint64).reshape(-1, len(names))
        at = frame[["slot", "key"]].to_numpy(np.int64)
        group = np.cumsum(np.concatenate([[0], (at[1:] != at[:-1]).any(axis=1)]))
        order = np.lexsort([bits[:, i] for i in range(len(names))][::-1] + [group])
        bits, group, node = bits[order], group[order], frame["node"].to_numpy(np.int64)[order]
        label = trie_components(bits, group, budget)
        other = np.flatnonzero(label != np.arange(len(label)))
        return pd.DataFrame({"u": node[other], "v": node[label[other]]})

    def run(batches):
        held, count, most = [], 0, rows
        for frame in batches:
            held.append(frame)
            count += len(frame)
            if count >= most:
                whole = pd.concat(held, ignore_index=True)
                last = whole.iloc[-1]
                tail = (whole["slot"] == last["slot"]) & (whole["key"] == last["key"])
                if not tail.all():
                    yield emit(whole[~tail])
                    whole = whole[tail]
                # A group that goes on is looked at again when it has doubled.
                held, count = [whole], len(whole)
                most = max(rows, 2 * count)
        if count:
            yield emit(pd.concat(held, ignore_index=True))

    return run


def exact_keys(names: list[str], budget: int):
    """Blocks of which one is equal in any two fingerprints that differ in ``budget`` bits at most: of budget + 1
    blocks, one has no differing bit."""
    total, blocks = 64 * len(names), budget + 1
    width = total // blocks
    return [list(range(i * width, (i + 1) * width if i < budget else total)) for i in range(blocks)]


def _masks(names: list[str], keys: list[list[int]], first: int = 0):
    """A literal array of structs (slot, m0, m1, ...): the bits that each key keeps, place 0 being the leftmost."""
    rows = []
    for i, places in enumerate(keys):
        words = [0] * len(names)
        for p in places:
            words[p // 64] |= 1 << (63 - p % 64)
        signed = [w - (1 << 64) if w >> 63 else w for w in words]
        rows.append(F.struct(F.lit(first + i).alias("slot"), *[F.lit(w).cast("long").alias(f"m{j}") for j, w in enumerate(signed)]))
    return F.array(*rows)


def _under(nodes: DataFrame, names: list[str], masks: Column) -> DataFrame:
    masked = [F.col(n).bitwiseAND(F.col(f"at.m{j}")) for j, n in enumerate(names)]
    out = nodes.withColumn("at", F.explode(masks))
    return out.select("node", *names, F.col("at.slot").alias("slot"), F.xxhash64(*masked).alias("key"))


def _keyed(nodes: DataFrame, names: list[str], keys: list[list[int]]) -> DataFrame:
    return _under(nodes, names, _masks(names, keys))


def _finer(places: list[int], total: int, budget: int) -> list[list[int]]:
    """Keys that hold ``places`` and one of ``budget`` + 1 blocks of the other bits each."""
    rest = sorted(set(range(total)) - set(places))
    width = len(rest) // (budget + 1)
    return [places + (rest[j * width : (j + 1) * width] if j < budget else rest[j * width :]) for j in range(budget + 1)]


def split_groups(nodes: DataFrame, names: list[str], keys: list[list[int]], budget: int, group_rows: int) -> DataFrame:
    """``(node, *names, slot, key)``: nodes under each of ``keys``, the groups of more than ``group_rows`` nodes dealt again by finer keys
    until none is left. A group whose key leaves f bits has 2 ** f nodes at most, and a round leaves three quarters of
    them for a budget of three bits, so that rounds are few: five for 64 bits and 200,000 rows."""
    total, places = 64 * len(names), dict(enumerate(keys))
    keyed, done = _keyed(nodes, names, keys), []
    while True:
        large = staged(keyed.groupBy("slot", "key").count().filter(F.col("count") > group_rows).select("slot", "key"), "large")
        # One row a slot, of which there are as many as keys; what leaves no more bits than the budget can't be dealt further.
        slots = sorted(r.slot for r in large.select("slot").distinct().collect() if total - len(places[r.slot]) > budget)
        if not slots:
            return functools.reduce(DataFrame.unionByName, [*done, keyed])
        large = large.filter(F.col("slot").isin(slots))
        done.append(keyed.join(large, ["slot", "key"], "left_anti"))
        hot = staged(keyed.join(large, ["slot", "key"], "left_semi").select("node", *names, F.col("slot").alias("of")), "hot")
        masks = []
        for slot in slots:
            finer, first = _finer(places[slot], total, budget), len(places)
            masks += [F.lit(slot), _masks(names, finer, first)]
            places |= dict(enumerate(finer, first))
        keyed = _under(hot, names, F.element_at(F.create_map(*masks), F.col("of")))


def hamming_components(prints: DataFrame, names: list[str], budget: int, keys: list[list[int]], group_rows: int = 200_000) -> DataFrame:
    """``prints(doc_id, f0, ...)`` -> ``(f0, ..., component_id)``: the smallest doc_id reachable over links of at most
    ``budget`` differing bits, for every distinct fingerprint.

    Equal fingerprints are one node. Only nodes that share the bits of one of ``keys`` meet; with ``exact_keys`` no link
    is lost. A group of more than ``group_rows`` nodes is dealt out again on blocks of the bits that its key leaves,
    by the same argument, as often as it takes, before it is walked."""
    nodes = staged(prints.groupBy(*names).agg(F.min("doc_id").alias("low")).withColumn("node", F.xxhash64(*names) if len(names) > 1 else F.col(names[0])), "nodes")
    keyed = split_groups(nodes, names, keys, budget, group_rows)
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartition(parts, "slot", "key").sortWithinPartitions("slot", "key")
    links = dealt.mapInPandas(_links(names, budget), "u long, v long")
    roots = connected_components(links)
    # Components of several nodes join their minimum; a node alone is its own, so most rows meet no common key.
    mine = nodes.join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
    alone = mine.filter("root IS NULL").select(*names, F.col("low").alias("component_id"))
    several = mine.filter("root IS NOT NULL").select(*names, "low", "root")
    lowest = several.groupBy("root").agg(F.min("low").alias("component_id"))
    return alone.unionByName(several.join(lowest, "root").select(*names, "component_id"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, budget: int = 3) -> DataFrame:
    """Near duplicates by 64-bit SimHash: ``(doc_id, fingerprint, component_id)``, one row for each row of ``docs``.

    The fingerprint is 16 lowercase hex digits; texts without a word have fingerprint zero and link like any other.
    Rows of null doc_id keep their fingerprint and link others, but never name a component unless all of it is null.
    Repeated rows give repeated rows. Exact: every link of at most ``budget`` bits counts."""
    prepare(docs.sparkSession)
    prints = staged(fingerprints(docs, id_col, text_col, shingle), "prints")
    found = hamming_components(prints, ["f0"], budget, exact_keys(["f0"], budget))
    hexed = F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint")
    return prints.join(found, "f0").select("doc_id", hexed, "component_id")


# ---------------------------------------------------------------- the set join


def _sets(shingle: int):
    """Document rows with their shingle set's hash, size, bins and fingerprint and, with a null node, how often common shingles occur."""
    columns = ["doc_id", "no_id", "key", "node", "n", "fine", *PARITY, *PRINTS, "hash", "times"]

    def common(held):
        h, times = np.unique(np.concatenate(list(held.values())), return_counts=True)
        often = times >= COMMON_FROM
        own = pd.DataFrame({"hash": h[often].view(np.int64), "times": times[often], "doc_id": 0, "no_id": True})
        return own.reindex(columns=columns).astype({"key": object, "node": "Int64", "n": "Int64", "fine": object} | dict.fromkeys((*PARITY, *PRINTS), "Int64"))

    def run(batches):
        held, total = {}, 0
        for frame in text_batches(batches):
            sets = [np.unique(shingle_hashes(t, shingle)) for t in frame["text"]]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            bits = np.array([set_bits(s, len(PRINTS)) for s in sets], np.uint64).view(np.int64).reshape(-1, len(PRINTS))
            odd = np.array([odd_bins(s, BINS).view(np.int64) for s in sets], np.int64).reshape(-1, len(PARITY))
            many = [odd_bins(s, min(FINE_MOST, 2 << (len(s) - 1).bit_length())).tobytes() if len(s) > FINE_FROM else None for s in sets]
            numbers = {c: odd[:, i] for i, c in enumerate(PARITY)} | {c: bits[:, i] for i, c in enumerate(PRINTS)}
            out = frame[["doc_id", "no_id", "key"]].assign(node=node, n=[len(s) for s in sets], fine=many, **numbers, hash=None, times=None)
            yield out.astype({"hash": "Int64", "times": "Int64"})
            for name, s in zip(node.tolist(), sets, strict=True):
                if name not in held:
                    held[name] = s
                    total += len(s)
            if total >= COUNTED:
                yield common(held)
                held, total = {}, 0
        if total:
            yield common(held)

    return run


def odd_bins(own: np.ndarray, bins: int) -> np.ndarray:
    """Of ``bins`` bins of hashes, a power of two and 64 at least, those that hold an odd number, as bits."""
    held = np.bincount((own >> np.uint64(40)).astype(np.int64) % bins, minlength=bins)
    return np.packbits(held & 1, bitorder="little")


def least_difference(x: bytes, y: bytes) -> int:
    """A lower bound of the shingles that two sets don't share, from their odd bins: each bin that is odd in one of them only holds one. The
    finer bins are folded to as many as the coarser ones, as a bin's number is that of a finer one modulo the bins."""
    a, b = (np.frombuffer(v, np.uint64) for v in (x, y))
    n = min(len(a), len(b))
    a, b = (np.bitwise_xor.reduce(v.reshape(-1, n), axis=0) for v in (a, b))
    return int(np.bitwise_count(a ^ b).sum(dtype=np.int64))


def _prefixes(shingle: int, similarity: float, common: np.ndarray, parts: int):
    """``common``: hashes by rising frequency. All sets are ordered by (place in ``common``, hash), others first; the first hashes
    of the sets of a batch are packed by part of the hash range, with each set's node and size and each hash's place. A task
    sends a set once, as far as it remembers."""
    place = np.argsort(common)
    known = common[place]

    def run(batches):
        seen: set[int] = set()
        for frame in text_batches(batches):
            if len(seen) > SEEN:
                seen.clear()
            first, size, node = [], [], []
            for text in frame["text"]:
                own = np.unique(shingle_hashes(text, shingle))
                n = len(own)
                name = xxhash.xxh64_intdigest(own.tobytes(), SEED)
                if name in seen:
                    continue
                seen.add(name)
                node.append(name)
                rank = np.zeros(n, np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    rank = np.where(known[at] == own, place[at] + 1, 0)
                first.append(own[np.lexsort([own, rank])[: n - math.ceil(similarity * n - 1e-9) + 1 if n else 0]])
                size.append(n)
            many = [len(f) for f in first]
            h = np.concatenate([np.zeros(0, np.uint64), *first]) >> np.uint64(64 - HASH_BITS)
            owner = np.repeat(np.arange(len(first)), many)
            pos = np.concatenate([np.zeros(0, np.int64), *[np.arange(k) for k in many]])
            order = np.argsort(h, kind="stable")
            h, owner, pos = h[order], owner[order], pos[order]
            part = (h * np.uint64(parts)) >> np.uint64(HASH_BITS)
            edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(h) else [0]
            rows = []
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                used, nth = np.unique(owner[a:b], return_inverse=True)
                head = np.array(node, np.uint64)[used].tobytes() + np.array(size, np.int64)[used].tobytes()
                rows.append((int(part[a]), len(used), int(b - a), zlib.compress(head + planes(h[a:b]) + nth.astype(np.uint32).tobytes() + pos[a:b].astype(np.uint32).tobytes(), 1)))
            yield pd.DataFrame(rows, columns=["part", "nodes", "n", "data"])

    return run


def _met(frame: pd.DataFrame) -> pd.DataFrame:
    """The hashes of a part that several nodes have, with these."""
    h, node, size, pos = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
    for k, n, data in zip(frame["nodes"], frame["n"], frame["data"], strict=True):
        raw = zlib.decompress(data)
        names, sizes = np.frombuffer(raw, np.int64, 2 * k).reshape(2, k)
        nth, own = np.frombuffer(raw, np.uint32, 2 * n, 16 * k + 8 * n).reshape(2, n)
        h.append(ascending(raw[16 * k : 16 * k + 8 * n]))
        node.append(names[nth])
        size.append(sizes[nth])
        pos.append(own)
    h, node, size, pos = (np.concatenate(x) for x in (h, node, size, pos))
    order = np.lexsort([node, h])
    h, node, size, pos = h[order], node[order], size[order], pos[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (node[1:] != node[:-1])]) if len(h) else np.zeros(0, bool)
    h, node, size, pos = h[new], node[new], size[new], pos[new]
    same = np.zeros(len(h) + 1, bool)
    same[1:-1] = h[1:] == h[:-1]
    several = same[1:] | same[:-1]
    return pd.DataFrame({"hash": h[several].view(np.int64), "node": node[several], "n": size[several], "pos": pos[several].astype(np.int64)})


def _alike(a: str, b: str, similarity: float):
    """Sizes and odd bins at which two sets can still have the similarity: each bin that is odd in one of them only holds a
    shingle that the other lacks."""
    sizes = f"least({a}.n, {b}.n) >= {similarity} * greatest({a}.n, {b}.n) - 1e-6"
    differ = " + ".join(f"bit_count({a}.{c} ^ {b}.{c})" for c in PARITY)
    return F.expr(f"{sizes} AND {differ} <= {(1 - similarity) / (1 + similarity)} * ({a}.n + {b}.n) + 1e-6")


def _possible(a: str, b: str, similarity: float):
    """``_alike``, and places of a shared shingle at which two sets can still have the similarity."""
    return F.expr(f"least({a}.n - {a}.pos, {b}.n - {b}.pos) >= {similarity / (1 + similarity)} * ({a}.n + {b}.n) - 1e-6") & _alike(a, b, similarity)


def _texts_of(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """``wanted(node, key)`` with the text of each: ``(node, text)``. A table of bits of the wanted keys' hashes keeps
    most of the other texts out of the shuffle as long as a small part is wanted; the join decides. A node has one key, so the
    texts of equal rows meet where they were joined."""
    maybe = maybe_in(wanted, "key")
    return texts.filter(maybe("key")).join(wanted, "key").groupBy("key", "node").agg(F.first("text").alias("text")).select("node", "text")


def _similar(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of ``pairs(a, b)`` whose sets have the similarity, as links ``(u, v)``. Pairs that the bins rule out go
    first. A text of many pairs is sent in copies, so that no task gets them all."""

    def bounded(batches):
        for frame in batches:
            keep = np.ones(len(frame), bool)
            for i, (x, y, n, m) in enumerate(zip(frame["x"], frame["y"], frame["n"], frame["m"], strict=True)):
                if x and y:
                    keep[i] = least_difference(x, y) <= (1 - similarity) / (1 + similarity) * (n + m) + 1e-6
            yield frame.loc[keep, ["a", "b"]]

    def verified(batches):
        known = {}
        for frame in batches:
            links = []
            for a, b, x, y in zip(frame["a"], frame["b"], frame["x"], frame["y"], strict=True):
                if b not in known:
                    known = {b: np.unique(shingle_hashes(y, shingle))}
                own, other = np.unique(shingle_hashes(x, shingle)), known[b]
                both = len(np.intersect1d(own, other, assume_unique=True))
                if both >= similarity * (len(own) + len(other) - both) - 1e-9:
                    links.append((a, b))
            yield pd.DataFrame(links, columns=["u", "v"]).astype("int64")

    left = nodes.select(F.col("node").alias("a"), F.struct("n", *PARITY, "fine").alias("p"))
    right = nodes.select(F.col("node").alias("b"), F.struct("n", *PARITY, "fine").alias("q"))
    near = pairs.join(left, "a").join(right, "b").filter(_alike("p", "q", similarity))
    near = near.select("a", "b", F.col("p.n").alias("n"), F.col("q.n").alias("m"), F.col("p.fine").alias("x"), F.col("q.fine").alias("y"))
    open_pairs = staged(near.mapInPandas(bounded, "a long, b long"), "pairs")
    many = staged(open_pairs.groupBy("b").agg(F.floor(F.count(F.lit(1)) / SALTED).alias("copies")), "many")
    wanted = open_pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "key"), "node")
    texts = staged(_texts_of(staged(wanted, "wanted"), texts), "texts")
    right = many.join(texts.toDF("b", "y"), "b").select("b", "y", F.explode(F.sequence(F.lit(0).cast("long"), "copies")).alias("copy"))
    left = open_pairs.join(many, "b").withColumn("copy", F.pmod(F.xxhash64("a"), F.col("copies") + 1)).drop("copies").join(texts.toDF("a", "x"), "a")
    return staged(left.join(right, ["b", "copy"]).mapInPandas(verified, "u long, v long"), "links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """Near duplicates of a wanted shingle similarity: ``(doc_id, key, component_id, component_key)``, one row for each row
    of ``docs``; ``key`` is the row's ``row_key``, and the last two are those of the component's smallest row.

    Two texts link if the Jaccard similarity of their shingle sets is at least ``similarity``, and components follow links.
    Texts of equal sets are one node. First the trie walk over SimHash fingerprints of the sets, ``64 * len(PRINTS)`` bits,
    links nodes within the budget of bits that the similarity stands for; every link is verified on the sets. Fingerprints lose
    some pairs, so an exact join adds the rest: under any one order of the shingles two similar sets share one among the first
    of each, so nodes that aren't in one component yet meet on these, common shingles last, and are verified too. No link
    is lost and none is added, but by equal 64-bit hashes. Texts without a word aren't linked to anything but
    each other. Rows of null doc_id link others, but never name a component unless all of it is null."""
    prepare(docs.sparkSession)
    slots = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = row_key(id_col, text_col)
    schema = "key string, node long, n long, fine binary, " + "".join(f"{c} long, " for c in (*PARITY, *PRINTS)) + "hash long, times long"
    found = staged(map_texts(docs, _sets(shingle), schema, id_col, text_col, key=key), "sets")
    rows = found.filter("node IS NOT NULL").select("doc_id", "key", "node")
    often = found.filter("node IS NULL").groupBy("hash").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), "hash").limit(COMMON)
    common = often.toPandas()["hash"].to_numpy(np.int64)[::-1].copy().view(np.uint64)
    of_node = found.filter("node IS NOT NULL").groupBy("node").agg(F.min("key").alias("key"), *[F.first(c).alias(c) for c in ("n", "fine", *PARITY, *PRINTS)])
    texts = docs.select(key.alias("key"), F.col(text_col).alias("text"))
    nodes = staged(of_node, "nodes")
    count, entries = nodes.agg(F.count(F.lit(1)), F.sum("n")).first()

    # Fingerprints: sampled bits of the fingerprint are the tries' leading ones, so that a trie has few nodes.
    wide = max(12, math.ceil(math.log2(max(2, count))))
    draw = np.random.default_rng(SEED)
    keys = [sorted(draw.choice(64 * len(PRINTS), wide, replace=False).tolist()) for _ in range(TABLES)]
    cosine = 2 * similarity / (1 + similarity)
    budget = math.floor(64 * len(PRINTS) * math.acos(min(1.0, cosine)) / math.pi)
    prints = nodes.filter("n > 0").select("node", *PRINTS)
    dealt = _keyed(prints, list(PRINTS), keys).repartition(slots, "slot", "key").sortWithinPartitions("slot", "key")
    pairs = dealt.mapInPandas(_links(list(PRINTS), budget), "u long, v long").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct()
    links = _similar(pairs, nodes, texts, shingle, similarity)
    roots = staged(connected_components(links), "roots")

    # The exact join.
    parts = max(slots, math.ceil((entries or 0) * (1 - similarity) / 2_000_000))
    packed = texts.select("text").mapInPandas(_prefixes(shingle, similarity, common, parts), "part long, nodes long, n long, data binary")
    met = staged(packed.groupBy("part").applyInPandas(_met, "hash long, node long, n long, pos long"), "met")
    now = met.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    parted = now.groupBy("hash").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x < y").select("hash")
    now = staged(now.join(parted, "hash", "left_semi"), "parted")
    heads = now.groupBy("node").agg(F.slice(F.array_sort(F.collect_list(F.struct("pos", "hash"))), 1, HEAD).alias("head"))
    now = now.join(nodes.select("node", *PARITY), "node").join(heads, "node")
    earlier = F.expr("transform(filter(head, h -> h.pos < pos), h -> h.hash)").alias("earlier")
    now = staged(now.select("hash", F.struct("node", "n", "pos", "root", *PARITY, earlier).alias("a")), "mixed")
    # Both sides are the same plan, so that one exchange serves them. A pair that shares a shingle of both heads before this one
    # has met there, where it could only look more alike.
    wanted = F.expr("x.hash = y.hash AND x.a.root != y.a.root AND x.a.node < y.a.node") & _possible("x.a", "y.a", similarity)
    wanted = wanted & ~F.expr("arrays_overlap(x.a.earlier, y.a.earlier)")
    pairs = now.alias("x").join(now.alias("y"), wanted).select(F.col("x.a.node").alias("a"), F.col("y.a.node").alias("b")).distinct()
    roots = connected_components(links.unionByName(_similar(pairs, nodes, texts, shingle, similarity)))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "key"))).alias("first")
    lowest = rows.groupBy("node").agg(first).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = lowest.join(lowest.groupBy("root").agg(F.min("first").alias("lowest")), "root").select("node", "lowest")
    return rows.join(lowest, "node").select("doc_id", "key", F.col("lowest.doc_id").alias("component_id"), F.col("lowest.key").alias("component_key"))
