"""Nearest neighbours by inner product with a hash-prefix forest.

A tree is the sorted array of the long bit strings that one set of random hyperplanes gives the vectors; vectors of a
common prefix lie side by side. A query descends each tree to the vectors that share its longest prefix. All trees then
ascend together, one bit at a time, until enough entries have gathered; their different vectors are the candidates.

The forest is as large as many copies of its vectors, and the candidates of all queries are more than that. So neither is
written or exchanged: a tree is kept in pieces, one a shard of vectors, which a task makes from the shard's vectors.

1. Nodes. Copies of one vector are one node, with the smallest of their ids. Nodes are dealt to shards by a hash of the vector,
   a shard being one packed row; queries, with their bit strings, to parts by a hash of the id.
2. Descent. Shards meet parts within a task. How many entries share a query's prefix, at each length, is summed over trees and
   the task's shards, then over tasks; the sums say at which length, the same in all trees, enough entries lie. Prefixes longer
   than ``SHALLOW`` bits are counted only for the queries that need them.
3. Ascent. Shards and parts meet again. Each shard's trees give each query its ranges at that length, whose different nodes are
   scored on the original components, in double precision and a fixed order of addition. A task keeps the best of each query.
4. The best of at most ``SLICES`` tasks are merged for each query.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import _splitmix, maybe_in, prepare, return_memory, staged

BITS = 32
#: Lengths of prefixes that are counted for all queries, in a table of 2 ** SHALLOW places a tree.
SHALLOW = 16
#: Tasks over which the shards are dealt for one group of parts: each gives a row for every query. Parts of a group.
SLICES, GROUP_PARTS = 12, 4
#: Shards that a table is cut into at least, where that leaves a shard LEAST_ROWS; bytes of a shard's or a part's vectors in double precision.
SHARDS, LEAST_ROWS, PACKED_BYTES = 24, 4_096, 33_554_432


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(vec_id, v, dim)``: rows of an id and a finite vector that isn't zero. Single precision stays, all else becomes double."""
    single = isinstance(vectors.select(vector_col).schema[0].dataType.elementType, FloatType)
    v = F.col(vector_col) if single else F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    rows = rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return rows.withColumn("dim", F.size("v")).filter(square > 0)


def single_rows(rows: DataFrame) -> DataFrame:
    """One row for each id and length of its vector, with the smallest vector. Vectors travel only for ids that repeat."""
    key = ["vec_id", "dim"]
    repeated = staged(rows.groupBy(*key).count().filter("count > 1").select("vec_id"), "repeated")
    if repeated.isEmpty():
        return rows
    maybe = maybe_in(repeated, "vec_id")(F.col("vec_id"))
    return rows.filter(~maybe).unionByName(rows.filter(maybe).groupBy(*key).agg(F.min("v").alias("v")))


def bit_strings(x: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(rows, trees) unsigned: the signs of ``planes`` (trees, BITS, columns), first plane leftmost."""
    flat, out = planes.reshape(-1, x.shape[1]).T, np.zeros((len(x), len(planes)), np.uint32)
    for a in range(0, len(x), 512):
        signs = x[a : a + 512] @ flat > 0
        packed = np.packbits(signs.reshape(len(signs), len(planes), BITS), axis=2)
        out[a : a + 512] = np.ascontiguousarray(packed).view(">u4")[:, :, 0]
    return out


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    """One more column brings all vectors to the norm ``top``: the largest inner product is then the least angle."""
    rest = np.sqrt(np.maximum(top * top - (x * x).sum(axis=1), 0))
    return np.column_stack([x, rest])


def planes(trees: int, dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((trees, BITS, dim + 1))


def spread(node: np.ndarray, parts: int) -> np.ndarray:
    """A part for each node, by a hash: ids may come in steps."""
    return (_splitmix(node.astype(np.int64).view(np.uint64)) % np.uint64(parts)).astype(np.int64)


def vectors_of(data: bytes, dim: int, n: int) -> np.ndarray:
    """``n`` packed vectors, in single precision if they came so."""
    return np.frombuffer(data, "<f4" if len(data) == 4 * dim * n else "<f8").reshape(n, dim)


def _packed(most: int):
    """Nodes of one length as rows of ``most`` nodes or fewer: a row's ids, how many each node has, its vectors and their largest norm."""

    def row(dim: int, frames: list) -> tuple:
        own = pd.concat(frames, ignore_index=True)
        x, ids = np.stack(own["v"].to_numpy()), own["ids"].to_numpy()
        wide = x.astype(float)
        count, ids = np.array([len(i) for i in ids], "<i4"), np.concatenate(ids).astype("<i8")
        return dim, int(ids[0]), len(own), float(np.sqrt((wide * wide).sum(axis=1)).max()), ids.tobytes(), count.tobytes(), x.astype(x.dtype.newbyteorder("<")).tobytes()

    def run(batches):
        names, held = ["dim", "shard", "n", "top", "ids", "counts", "data"], {}
        for frame in batches:
            out = []
            for dim, own in frame.groupby("dim"):
                limit = max(1, min(most, PACKED_BYTES // (8 * int(dim))))
                frames, rows = held.pop(dim, ([], 0))
                while rows + len(own) >= limit:
                    out.append(row(int(dim), [*frames, own.iloc[: limit - rows]]))
                    frames, rows, own = [], 0, own.iloc[limit - rows :]
                if rows + len(own):
                    held[dim] = [*frames, own], rows + len(own)
            if out:
                yield pd.DataFrame(out, columns=names)
        for dim, (frames, _) in held.items():
            yield pd.DataFrame([row(int(dim), frames)], columns=names)

    return run


def _part(trees: int, seed: int):
    """The queries of a part as one row: ids, lengths of prefixes, vectors, and their bit strings, tree by tree. A query's lifted column is
    zero: its own length changes no order."""

    def run(key, own: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(own["v"].to_numpy())
        wide = x.astype(float)
        keys = bit_strings(np.column_stack([wide, np.zeros(len(x))]), planes(trees, int(key[0]), seed))
        query, length = own["query"].to_numpy("<i8").tobytes(), own["length"].to_numpy(np.uint8).tobytes()
        return pd.DataFrame([(key[0], key[1], query, length, keys.T.astype("<u4").tobytes(), x.astype(x.dtype.newbyteorder("<")).tobytes())], columns=["dim", "part", "query", "length", "keys", "asked"])

    return run


def _rest(length) -> np.ndarray:
    """All bits but the first ``length``."""
    return (np.uint64(2**BITS - 1) >> np.asarray(length).astype(np.uint64)).astype(np.uint32)


def ranges(keys: np.ndarray, own: np.ndarray, length) -> tuple[np.ndarray, np.ndarray]:
    """Of the ascending ``keys`` those that share the first ``length`` bits of ``own``: begins and ends."""
    rest = _rest(length)
    return np.searchsorted(keys, own & ~rest), np.searchsorted(keys, own | rest, side="right")


def shallow_sizes(entries: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """(lengths from 1 to SHALLOW, queries): how many ``entries`` share a query's prefix, over all trees (rows of both)."""
    out = np.zeros((SHALLOW, keys.shape[1]), np.int64)
    for own, key in zip(entries, keys, strict=True):
        count, place = np.bincount(own >> np.uint32(BITS - SHALLOW), minlength=1 << SHALLOW), (key >> np.uint32(BITS - SHALLOW)).astype(np.int64)
        for length in range(SHALLOW, 0, -1):
            out[length - 1] += count[place]
            count, place = count[0::2] + count[1::2], place >> 1
    return out


def deep_sizes(entries: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """As ``shallow_sizes``, at the lengths above SHALLOW."""
    lengths = np.arange(SHALLOW + 1, BITS + 1)
    out = np.zeros((len(lengths), keys.shape[1]), np.int64)
    for own, key in zip(entries, keys, strict=True):
        own = np.sort(own)
        low, high = ranges(own, key, SHALLOW)
        some = np.flatnonzero(high > low)
        low, high = ranges(own, key[some][None, :], lengths[:, None])
        out[:, some] += high - low
    return out


def _entries(r, trees: int, seed: int, tops: dict) -> tuple[np.ndarray, np.ndarray]:
    """A shard's vectors, and their bit strings, tree by tree."""
    return_memory()
    x = vectors_of(r.data, r.dim, r.n)
    return x, np.ascontiguousarray(bit_strings(lifted(x.astype(float), tops[r.dim]), planes(trees, r.dim, seed)).T)


def _counted(sizes, names: list, trees: int, seed: int, tops: dict):
    """Pairs of a shard and a part, sorted by shard: for each query how many entries of the task's shards share its prefix."""

    def run(batches):
        at, entries, total = None, None, {}
        for frame in batches:
            for r in frame.itertuples(index=False):
                if (r.dim, r.shard) != at:
                    at, entries = (r.dim, r.shard), None
                    entries = _entries(r, trees, seed, tops)[1]
                query = np.frombuffer(r.query, "<i8")
                n = sizes(entries, np.frombuffer(r.keys, "<u4").reshape(trees, -1))
                total[r.dim, r.part] = query, n + total[r.dim, r.part][1] if (r.dim, r.part) in total else n
        for (dim, _), (query, n) in total.items():
            yield pd.DataFrame({"query": query, "dim": np.int32(dim)} | dict(zip(names, n, strict=True)))

    return run


class Shard:
    """The trees of a shard: bit strings ascending and the places of their vectors."""

    def __init__(self, x: np.ndarray, entries: np.ndarray, ids: np.ndarray, counts: np.ndarray):
        self.x, self.ids, self.counts, self.first = x, ids, counts, np.cumsum(counts) - counts
        self.top = float(np.sqrt(np.square(x, dtype=float).sum(axis=1)).max())
        self.order = np.empty(entries.shape, np.uint16 if len(x) <= 1 << 16 else np.int32)
        for own, order in zip(entries, self.order, strict=True):
            order[:] = place = np.argsort(own, kind="stable")
            own[:] = own[place]
        self.entries, self.begin = entries, np.arange(len(entries)) * len(x)
        self.held = np.empty(x.shape, x.dtype)

    def ranges(self, keys: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(queries, trees): where the entries that share a query's prefix begin in each tree, and how many they are."""
        low, size = (np.empty(keys.shape[::-1], np.int32) for _ in range(2))
        rest, deep, cut = _rest(length), np.flatnonzero(length > SHALLOW), np.uint32(BITS - SHALLOW)
        for t, (own, key) in enumerate(zip(self.entries, keys, strict=True)):
            first = np.concatenate([[0], np.cumsum(np.bincount(own >> cut, minlength=1 << SHALLOW))])
            a, b = first[(key & ~rest) >> cut], first[((key | rest) >> cut).astype(np.int64) + 1]
            if len(deep):
                a[deep], b[deep] = ranges(own, key[deep], length[deep])
            low[:, t], size[:, t] = a, b - a
        return low, size

    def places(self, low: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The different vectors in one query's ranges, ascending."""
        total = int(size.sum())
        if total > len(self.x) + 65_536:
            seen = np.zeros(len(self.x), bool)
            for order, a, n in zip(self.order, low.tolist(), size.tolist(), strict=True):
                seen[order[a : a + n]] = True
            return np.flatnonzero(seen)
        own = self.order.reshape(-1).take(np.arange(total) + np.repeat(self.begin + low - (np.cumsum(size) - size), size))
        own.sort(kind="stable")
        return own[np.concatenate([[True], own[1:] != own[:-1]])]

    def best(self, query: int, v: np.ndarray, place: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the vectors at ``place`` that may be among the ``k`` best, no less than ``least``."""
        # In memory that is there already: taking it anew for each query costs ten times the copy.
        x, most = self.x.take(place, axis=0, out=self.held[: len(place)], mode="clip"), self.top * math.sqrt(v @ v)
        if x.dtype == np.float32 and not most < 1e37:
            x = x.astype(float)
        score = x @ v.astype(x.dtype)
        # One of the best may hold nothing but the query itself.
        if len(place) > k + 1:
            least = max(least, float(np.partition(score, -k - 1)[-k - 1]))
        # The precision and the order of addition change a score by less than the slack.
        near = np.flatnonzero(~(score < least - 4 * len(v) * float(np.finfo(x.dtype).eps) * most - 1e-40))
        place, score = place[near], np.add.reduce(x[near].astype(float) * v, axis=1)
        count = self.counts[place]
        ids = self.ids[np.repeat(self.first[place] - (np.cumsum(count) - count), count) + np.arange(count.sum())]
        other = ids != query
        return np.repeat(score, count)[other], ids[other]


def _first(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -score))[:k]
    return score[order], ids[order]


def _searched(k: int, trees: int, seed: int, tops: dict):
    """Pairs of a shard and a part, sorted by shard: each query's ``k`` best of the task's shards, scores before ids."""

    def run(batches):
        at, shard, held = None, None, {}
        for frame in batches:
            for r in frame.itertuples(index=False):
                if (r.dim, r.shard) != at:
                    at, shard = (r.dim, r.shard), None
                    shard = Shard(*_entries(r, trees, seed, tops), np.frombuffer(r.ids, "<i8"), np.frombuffer(r.counts, "<i4").astype(np.int64))
                query, asked = np.frombuffer(r.query, "<i8"), vectors_of(r.asked, r.dim, len(r.length)).astype(float)
                low, size = shard.ranges(np.frombuffer(r.keys, "<u4").reshape(trees, -1), np.frombuffer(r.length, np.uint8))
                found = held.setdefault((r.dim, r.part), (query, [(np.zeros(0), np.zeros(0, np.int64))] * len(query)))[1]
                for i in np.flatnonzero(size.any(axis=1)).tolist():
                    score, ids = found[i]
                    more = shard.best(int(query[i]), asked[i], shard.places(low[i], size[i]), k, score[-1] if len(score) == k else -math.inf)
                    if len(more[0]):
                        found[i] = _first(np.concatenate([score, more[0]]), np.concatenate([ids, more[1]]), k)
        for query, found in held.values():
            yield pd.DataFrame([(q, s.astype("<f8").tobytes() + i.astype("<i8").tobytes()) for q, (s, i) in zip(query.tolist(), found, strict=True) if len(s)], columns=["query", "found"])

    return run


def _merged(k: int):
    """The ``k`` best of each query, from those of several tasks."""

    def run(batches):
        names = ["query_id", "rank", "vec_id", "score"]
        for frame in batches:
            out = [pd.DataFrame({c: np.zeros(0, float if c == "score" else np.int64) for c in names})]
            for query, blobs in zip(frame["query"].tolist(), frame["found"], strict=True):
                blobs = [bytes(b) for b in blobs]
                score, ids = (np.concatenate([np.frombuffer(half, kind) for half in halves]) for kind, halves in (("<f8", [b[: len(b) // 2] for b in blobs]), ("<i8", [b[len(b) // 2 :] for b in blobs])))
                score, ids = _first(score, ids, k)
                out.append(pd.DataFrame({"query_id": query, "rank": np.arange(1, len(ids) + 1), "vec_id": ids, "score": score + 0.0}))
            yield pd.concat(out, ignore_index=True)

    return run


def _parts(asked: DataFrame, count: int, part_rows: int, trees: int, seed: int, name: str) -> DataFrame:
    """``asked(query, dim, v, length)`` as parts of about ``part_rows`` queries, in as many partitions as there are groups of parts."""
    parts = max(1, math.ceil(count / part_rows))

    @F.pandas_udf("int")
    def part_of(query: pd.Series) -> pd.Series:
        return pd.Series(spread(query.to_numpy(np.int64), parts).astype(np.int32))

    packed = asked.withColumn("part", part_of("query")).groupBy("dim", "part").applyInPandas(_part(trees, seed), "dim int, part int, query binary, length binary, keys binary, asked binary")
    return staged(packed, name, maxRecordsPerFile=1).coalesce(math.ceil(parts / GROUP_PARTS))


def _met(shards: DataFrame, parts: DataFrame) -> DataFrame:
    """Each shard with all parts, shard by shard, without an exchange: every slice of shards meets every group of parts in a task."""
    return shards.coalesce(SLICES).join(parts.hint("shuffle_replicate_nl"), "dim")


def lengths(shards: DataFrame, asked: DataFrame, count: int, tops: dict, trees: int, wanted: int, part_rows: int, seed: int) -> DataFrame:
    """``(query, dim, length)``: the greatest length, the same in all trees, at which at least ``wanted`` entries share a query's prefix, zero
    where even one bit leaves fewer."""

    def chosen(queries, sizes, low, high, name):
        names = [f"n{i}" for i in range(low + 1, high + 1)]
        met = _met(shards.select("dim", "shard", "n", "data"), _parts(queries, count, part_rows, trees, seed, f"{name}-parts").select("dim", "part", "query", "keys"))
        counted = met.mapInPandas(_counted(sizes, names, trees, seed, tops), "query long, dim int, " + ", ".join(f"{c} long" for c in names))
        total = counted.groupBy("query", "dim").agg(*[F.sum(c).alias(c) for c in names])
        deepest = F.coalesce(*[F.when(F.col(c) >= wanted, F.lit(int(c[1:]))) for c in reversed(names)], F.lit(low))
        return staged(total.select("query", "dim", deepest.alias("length")), name)

    out = chosen(asked.withColumn("length", F.lit(0)), shallow_sizes, 0, SHALLOW, "shallow")
    deep = out.filter(F.col("length") == SHALLOW)
    if deep.isEmpty():
        return out
    return out.filter(F.col("length") < SHALLOW).unionByName(chosen(asked.join(deep, ["query", "dim"]), deep_sizes, SHALLOW, BITS, "deep"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = 256, wanted: float = 2.7, power: float = 0.77, part_rows: int = 8_192, shard_rows: int = 16_000, seed: int = 11) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: up to ``k`` rows of ``vectors`` for each row of ``queries``, largest inner product
    first, ties to the smaller id; a query never finds its own id.

    Vectors that are null, zero, or hold a null or non-finite component take no part, on either side; vectors meet
    others of their length. Repeated rows of one id count once, by their smallest vector. Ids of equal vectors share one
    node, with their k + 1 smallest ids, of which a query needs no more.

    The trees ascend until ``wanted`` * nodes ** ``power`` entries, and one a tree for the query itself, share the query's prefixes;
    where that is more than all, everything is scored. More trees and more entries find more, at more cost; measured
    recall and shares are in the README. ``shard_rows`` nodes and ``part_rows`` queries meet at once; neither changes the result."""
    spark = vectors.sparkSession
    prepare(spark)
    copies = Window.partitionBy("dim", "v").orderBy("vec_id")
    few = single_rows(usable(vectors, id_col, vector_col)).withColumn("place", F.row_number().over(copies)).filter(F.col("place") <= k + 1)
    # A window again, as an aggregate's normal form of floats would cost a second exchange of the vectors.
    nodes = few.withColumn("ids", F.collect_list("vec_id").over(copies.rowsBetween(0, k))).filter("place = 1").drop("vec_id", "place")
    rows = vectors.count()
    most = max(1, min(shard_rows, max(LEAST_ROWS, math.ceil(rows / SHARDS))))
    packed = nodes.coalesce(max(1, math.ceil(rows / most))).mapInPandas(_packed(most), "dim int, shard long, n int, top double, ids binary, counts binary, data binary")
    shards = staged(packed, "shards", maxRecordsPerFile=1)
    asked = staged(single_rows(usable(queries, id_col, vector_col)).withColumnRenamed("vec_id", "query"), "queries")
    per_dim = shards.groupBy("dim").agg(F.sum("n").alias("n"), F.max("top").alias("top")).collect()
    n, count, widest = max((r["n"] for r in per_dim), default=0), asked.count(), max((r["dim"] for r in per_dim), default=1)
    tops = {r["dim"]: r["top"] * (1 + 1e-9) for r in per_dim}
    enough = trees + max(8 * k, math.ceil(wanted * n**power))
    part_rows = max(1, min(part_rows, PACKED_BYTES // (8 * widest)))
    length = lengths(shards, asked, count, tops, trees, enough, part_rows, seed)
    parts = _parts(asked.join(length, ["query", "dim"]), count, part_rows, trees, seed, "parts")
    best = _met(shards.drop("top"), parts).mapInPandas(_searched(k, trees, seed, tops), "query long, found binary")
    return best.groupBy("query").agg(F.collect_list("found").alias("found")).mapInPandas(_merged(k), "query_id long, rank int, vec_id long, score double")
