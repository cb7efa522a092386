"""Hard-negative mining with segment summaries.

Every vector keeps, beside its components, the mean and the deviation of each of its segments, first of 4 long segments, then
of 16 short ones. Over a segment of L components the inner product is L * mean * mean plus a rest of at most
L * deviation * deviation, so sums of these bound a score from both sides. Anchors meet rows in tiles: a tile is bounded by the
long segments, what is left of it by the short ones, and only the rest is scored exactly.

Anchors are a stated set. They are dealt to chunks and rows to blocks at random, and each chunk meets each block in one task,
so neither a frequent label nor a group of equal vectors gathers anywhere; a task gives back the first few rows of each anchor and
band of scores at most. A pass over the anchors' own rows, which are a part of all rows, first raises the bands' lower ends."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, staged

#: Segments of a vector by level.
SEGMENTS = (4, 16)
#: Anchors of a chunk, rows of a block (fewer while that gives less than BLOCKS blocks), and the two sides of a tile.
CHUNK_ROWS, BLOCK_ROWS, LEAST_ROWS, BLOCKS = 32_768, 131_072, 4_096, 256
TILE_ANCHORS, TILE_ROWS = 512, 4_096
#: Above this, sums of products in double precision could round.
EXACT = float(2**53)
WIDEST = 2**62

ANCHOR = ["anchor_id", "anchor_key"]


def summaries(x: np.ndarray) -> np.ndarray:
    """Means and deviations of the segments of each row, level by level, times the root of the segment's length."""
    parts = []
    for k in SEGMENTS:
        edges = np.linspace(0, x.shape[1], min(k, x.shape[1]) + 1).astype(int)
        size = np.diff(edges)
        total = np.add.reduceat(x, edges[:-1], axis=1)
        rest = np.add.reduceat(x * x, edges[:-1], axis=1) - total * total / size
        parts += [total / np.sqrt(size), np.sqrt(np.maximum(rest, 0))]
    return np.concatenate(parts, axis=1).astype(np.float32)


def level_bounds(a: np.ndarray, b: np.ndarray, dim: int, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all scores of ``a`` and ``b``, two tables of summaries, from one level. The slack covers the
    rounding of the summaries to single precision."""
    widths = [min(k, dim) for k in SEGMENTS]
    begin, k = 2 * sum(widths[:level]), widths[level]
    mean, dev = slice(begin, begin + k), slice(begin + k, begin + 2 * k)
    middle, away = a[:, mean] @ b[:, mean].T, a[:, dev] @ b[:, dev].T
    norms = [np.sqrt((t[:, begin : begin + 2 * k] ** 2).sum(axis=1)) for t in (a, b)]
    slack = 2e-6 * np.outer(*norms) + 1e-3
    return middle - away - slack, middle + away + slack


def _lists(table: pa.Table, name: str) -> np.ndarray:
    column = table.column(name)
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)


def _first_per_group(group: np.ndarray, score: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """Indices of the ``k`` highest scores of every group, ties to the smaller place; sorted by group, then rank."""
    order = np.lexsort((place, -score, group))
    own = group[order]
    new = np.concatenate([[True], own[1:] != own[:-1]]) if len(own) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))
    return order[np.arange(len(own)) - start < k]


class Searcher:
    """Rows of one block, sorted by id, that anchors are searched in. ``scored`` counts the pairs that needed an exact score."""

    def __init__(self, ids, labels, vectors, summary):
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels = ids[order], labels[order]
        self.whole, self.vectors = vectors[order], vectors[order].astype(float)
        self.summary = summary[order].astype(float)
        self.scored = self.seen = 0

    def exact(self, whole, rows):
        a, b = whole.astype(float), self.vectors[rows]
        if (np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]) < EXACT:
            return np.rint(a @ b.T).astype(np.int64)
        return whole @ self.whole[rows].T

    def search(self, ids, labels, whole, summary, low, high, same: bool, k: int):
        """The first ``k`` rows of every anchor and band, as arrays (anchor, band, id, score). ``low`` and ``high`` have a row for
        an anchor and a column for a band; bands that an anchor doesn't have are empty (low above high)."""
        dim, bands = whole.shape[1], low.shape[1]
        low, summary = low.copy(), summary.astype(float)
        found = [np.zeros(0, np.int64) for _ in range(3)]  # anchor * bands + band, row, score
        for begin in range(0, len(self.ids), TILE_ROWS):
            rows, at = np.arange(begin, min(begin + TILE_ROWS, len(self.ids))), np.arange(len(ids))
            self.seen += len(rows) * len(at)
            alive = (labels[:, None] == self.labels[rows][None, :]) == same
            alive &= ids[:, None] != self.ids[rows][None, :]
            least = np.where(low <= high, low, WIDEST).min(axis=1)
            most = np.where(low <= high, high, -WIDEST).max(axis=1)
            for level in range(len(SEGMENTS)):
                a, b = alive.any(axis=1), alive.any(axis=0)
                at, rows, alive = at[a], rows[b], alive[a][:, b]
                if not len(at) or not len(rows):
                    break
                under, over = level_bounds(summary[at], self.summary[rows], dim, level)
                alive &= (over >= least[at][:, None]) & (under <= most[at][:, None])
            a, b = alive.any(axis=1), alive.any(axis=0)
            at, rows, alive = at[a], rows[b], alive[a][:, b]
            if not len(at) or not len(rows):
                continue
            self.scored += int(alive.sum())
            score = self.exact(whole[at], rows)
            for band in range(bands):
                hit = alive & (score >= low[at, band][:, None]) & (score <= high[at, band][:, None])
                i, j = np.nonzero(hit)
                more = at[i] * bands + band, rows[j], score[i, j]
                found = [np.concatenate([x, y]) for x, y in zip(found, more, strict=True)]
            best = _first_per_group(found[0], found[2], found[1], k)
            found = [x[best] for x in found]
            # A full band's last score is its new lower end: rows come in the order of their ids, so a tie of a later row loses.
            group, first, count = np.unique(found[0], return_index=True, return_counts=True)
            full = count == k
            last = found[2][first[full] + k - 1]
            low[group[full] // bands, group[full] % bands] = np.maximum(low[group[full] // bands, group[full] % bands], last)
        return found[0] // bands, found[0] % bands, self.ids[found[1]], found[2]


def _cell(same: bool, k: int):
    schema = pa.schema([("anchor_id", pa.int64()), ("anchor_key", pa.int64()), ("band", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(anchors, rows):
        if not anchors.num_rows or not rows.num_rows:
            return schema.empty_table()
        searcher = Searcher(rows.column("vec_id").to_numpy(), rows.column("label").to_numpy(), _lists(rows, "vector"), _lists(rows, "summary"))
        ids, keys, labels = (anchors.column(c).to_numpy() for c in ("anchor_id", "anchor_key", "label"))
        whole, summary, held = _lists(anchors, "vector"), _lists(anchors, "summary"), anchors.column("bands").to_pylist()
        out = []
        for begin in range(0, len(ids), TILE_ANCHORS):
            part = slice(begin, begin + TILE_ANCHORS)
            names = sorted({b["band"] for row in held[part] for b in row})
            low, high = (np.full((len(held[part]), len(names)), fill, np.int64) for fill in (WIDEST, -WIDEST))
            for i, row in enumerate(held[part]):
                for b in row:
                    low[i, names.index(b["band"])], high[i, names.index(b["band"])] = b["low"], b["high"]
            at, band, vec, score = searcher.search(ids[part], labels[part], whole[part], summary[part], low, high, same, k)
            out.append((ids[part][at], keys[part][at], np.array(names, np.int32)[band], vec, score))
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], schema=schema)

    return run


def _summarised(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        for dim in sorted(set(table.column("dim").to_pylist())):
            own = table.filter(pc.equal(table.column("dim"), dim))
            made = summaries(_lists(own, "vector").astype(float))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, made.size + 1, made.shape[1]), pa.int32()), pa.array(made.reshape(-1)))
            yield from own.append_column("summary", flat).to_batches()


def _blocks(n: int) -> int:
    return max(1, -(-n // min(BLOCK_ROWS, max(LEAST_ROWS, n // BLOCKS))))


def _search(anchors: DataFrame, bands: DataFrame, rows: DataFrame, sizes: tuple[int, int], same: bool, k: int) -> DataFrame:
    """``(anchor_id, anchor_key, band, vec_id, score, rank)``: the first ``k`` rows of every anchor and band."""
    chunks, blocks = max(1, -(-sizes[0] // CHUNK_ROWS)), _blocks(sizes[1])
    limits = bands.groupBy(*ANCHOR).agg(F.collect_list(F.struct("band", "low", "high")).alias("bands"))
    left = anchors.join(limits, ANCHOR).withColumn("chunk", F.pmod(F.xxhash64(*ANCHOR), F.lit(chunks)).cast("int"))
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = rows.withColumn("block", (F.rand(11) * blocks).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    cell = ["dim", "chunk", "block"]
    met = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(_cell(same, k), "anchor_id long, anchor_key long, band int, vec_id long, score long")
    order = Window.partitionBy(*ANCHOR, "band").orderBy(F.col("score").desc(), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _raised(bands: DataFrame, seen: DataFrame, k: int) -> DataFrame:
    """Bands whose lower end is the ``k``-th score already seen, where that many were."""
    last = seen.groupBy(*ANCHOR, "band").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("last")).filter(F.col("n") >= k)
    low = F.greatest("low", F.coalesce("last", "low")).alias("low")
    return bands.join(last, [*ANCHOR, "band"], "left").select(*ANCHOR, "band", low, "high")


def hard_negatives(vectors: DataFrame, anchors: str, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100)) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` from ``vectors(vec_id, label, vector)`` of
    integer components, ``anchors`` being a predicate on them.

    Scores are inner products, higher ones first, ties by smaller vec_id. An anchor's positives are its first rows of the same label;
    the negatives of a positive are the first rows of another label whose score lies between ``share`` of the positive's score and that
    score. Fewer are returned where there are fewer.

    Null ids, labels, vectors or components, and empty vectors, take no part. Vectors of different lengths never meet. A row of the
    anchor's own vec_id isn't its candidate; other rows that repeat an id each count; equal anchors count once. Further columns are
    ignored. Scores must stay below 2 ** 62."""
    spark = vectors.sparkSession
    prepare(spark)
    whole = F.col("vector").cast("array<bigint>")
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole.alias("vector"))
    base = base.filter("vec_id IS NOT NULL AND label IS NOT NULL AND size(vector) > 0 AND NOT exists(vector, x -> x IS NULL)").withColumn("dim", F.size("vector"))
    rows = staged(base.mapInArrow(_summarised, "vec_id long, label long, vector array<bigint>, dim int, summary array<float>"), "summaries")
    chosen = rows.filter(anchors)
    starts = staged(chosen.dropDuplicates(["vec_id", "label", "vector"]).withColumnRenamed("vec_id", "anchor_id").withColumn("anchor_key", F.xxhash64("label", "vector")), "anchors")
    n, m, a = rows.count(), chosen.count(), starts.count()

    def passes(bands, same, k):
        seen = _search(starts, bands, chosen, (a, m), same, k)
        return _search(starts, _raised(bands, seen, k), rows, (a, n), same, k)

    every = starts.select(*ANCHOR, F.lit(0).alias("band"), F.lit(-WIDEST).alias("low"), F.lit(WIDEST).alias("high"))
    near = staged(passes(every, True, positives).select(*ANCHOR, F.col("rank").alias("band"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    part, of = share
    low = F.expr(f"cast(ceil({part} * cast(positive_score AS decimal(19, 0)) / {of}) AS long)")
    bands = near.filter("positive_score >= 0").select(*ANCHOR, "band", low.alias("low"), F.col("positive_score").alias("high"))
    found = passes(bands, False, negatives).join(near, [*ANCHOR, "band"])
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
