"""Merkle manifest of a dataset: a tree of SHA-256 states for every source, and one over the sources.

A leaf is the digest of a row's fields. Sixteen consecutive nodes make a parent, whose digest is that of their digests as text.
While a parent is hashed, a copy of the hash state before each child's slot is retained. Folding a changed leaf resumes the state of
its slot with the new digest and the siblings to the right; what lies to the left is never hashed again.

Leaves are hashed by Spark's own functions, so texts never leave the executor that reads them. Digests are numbered within their source
through ranges whose counts are added up, so one source may hold any share of the rows. A task builds the tree over 16 ** 3
consecutive nodes; rounds of such tasks reach the root, and the ways to the root come down again, a row for each such group."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Children of a parent, levels that one task builds, and rows that are numbered together.
FAN, LEVELS, RANGE_ROWS = 16, 3, 1_048_576
HOLD = FAN**LEVELS

WAY = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """``-`` for null, else the length in UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


class States:
    """The tree over some digests: ``levels`` of digests from the leaves up, and for every parent the hash states before each of
    its children's slots."""

    def __init__(self, leaves: list[str], height: int):
        self.levels, self.states = [leaves], []
        for _ in range(height):
            below, parents, kept = self.levels[-1], [], []
            for begin in range(0, len(below), FAN):
                state, before = hashlib.sha256(), []
                for child in below[begin : begin + FAN]:
                    before.append(state.copy())
                    state.update(child.encode())
                parents.append(state.hexdigest())
                kept.append(before)
            self.levels.append(parents)
            self.states.append(kept)

    @property
    def top(self) -> str:
        return self.levels[-1][0]

    def way(self, at: int):
        """The siblings to the left and right of node ``at``, level by level."""
        for below in self.levels[:-1]:
            begin = at - at % FAN
            yield "".join(below[begin:at]), "".join(below[at + 1 : begin + FAN])
            at //= FAN

    def fold(self, at: int, leaf: str) -> str:
        """The top's digest with ``leaf`` in place of leaf ``at``."""
        for below, kept in zip(self.levels[:-1], self.states, strict=True):
            state = kept[at // FAN][at % FAN].copy()
            state.update(leaf.encode())
            state.update("".join(below[at + 1 : at - at % FAN + FAN]).encode())
            leaf = state.hexdigest()
            at //= FAN
        return leaf


def _height(total: Column) -> Column:
    """Levels above ``total`` leaves: how many powers of FAN are less."""
    return sum(((total > F.lit(FAN**k)).cast("int") for k in range(15)), F.lit(0))


def _placed(nodes: DataFrame, *order: str) -> DataFrame:
    """Add ``place`` (from 0, within ``tree``, in the given order, nulls first) and ``height`` (levels above this tree's leaves).
    Rows that are equal in the order columns are dealt to ranges at random; their digests are equal too."""
    spark = nodes.sparkSession
    nodes = staged(nodes, "leaves")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-nodes.count() // RANGE_ROWS))
    keys = [F.col(c).asc_nulls_first() for c in order]
    ranges = nodes.withColumn("salt", F.rand(5)).repartitionByRange(parts, F.col("tree"), *keys, F.col("salt")).drop("salt")
    dealt = staged(ranges.withColumn("part", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("tree")
    before = F.coalesce(F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("tree", "part", before.alias("start"), F.sum("n").over(whole).alias("total"))
    own = F.row_number().over(Window.partitionBy("tree", "part").orderBy(*keys)) - 1
    joined = dealt.withColumn("own", own).join(starts, ["tree", "part"])
    return joined.withColumns({"place": F.col("start") + F.col("own"), "height": _height(F.col("total"))}).drop("part", "own", "start", "total")


_NODE = pa.schema([("tree", pa.string()), ("place", pa.int64()), ("height", pa.int32()), ("digest", pa.string())])


def _raise(key, table):
    tree, block = (k.as_py() for k in key)
    table = table.sort_by("place")
    height = table.column("height")[0].as_py()
    top = States(table.column("digest").to_pylist(), min(height, LEVELS)).top
    return pa.Table.from_pylist([{"tree": tree, "place": block, "height": max(0, height - LEVELS), "digest": top}], _NODE)


def _block(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"place div {HOLD}"))


def _rounds(nodes: DataFrame) -> list[DataFrame]:
    """Tables of nodes ``(tree, place, height, digest)``: the leaves, the tops of their groups, and so on until every tree has one
    node. The driver learns the greatest height only."""
    tables = [nodes.select("tree", "place", "height", "digest")]
    most = nodes.agg(F.max("height")).first()[0] or 0
    for _ in range(max(1, -(-most // LEVELS))):
        made = _block(tables[-1]).groupBy("tree", "block").applyInArrow(_raise, "tree string, place long, height int, digest string")
        tables.append(staged(made, "nodes"))
    return tables


def _descend(key, nodes, above):
    nodes = nodes.sort_by("place")
    upper = above.column("way")[0].as_py()
    tree = States(nodes.column("digest").to_pylist(), min(nodes.column("height")[0].as_py(), LEVELS))
    ways = [[{"left": a, "right": b} for a, b in tree.way(i)] + upper for i in range(nodes.num_rows)]
    kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
    n = nodes.num_rows
    return pa.table({"tree": nodes.column("tree"), "place": nodes.column("place"), "way": pa.array(ways, kind), **{c: pa.array([above.column(c)[0].as_py()] * n, pa.string()) for c in ("subroot", "root")}})


def _ways(tables: list[DataFrame], tops: DataFrame, down_to: int) -> DataFrame:
    """``(tree, place, way, subroot, root)`` of the nodes of ``tables[down_to]``, from those of the tops."""
    ways = tops
    for nodes in reversed(tables[down_to:-1]):
        left, right = _block(nodes).groupBy("tree", "block"), ways.withColumnRenamed("place", "block").groupBy("tree", "block")
        ways = left.cogroup(right).applyInArrow(_descend, f"tree string, place long, way {WAY}, subroot string, root string")
    return ways


def _leaves(key, nodes, above):
    nodes = nodes.sort_by("place")
    leaves, changed = nodes.column("digest").to_pylist(), nodes.column("changed").to_pylist()
    way, subroot, root = (above.column(c)[0].as_py() for c in ("way", "subroot", "root"))
    tree = States(leaves, min(nodes.column("height")[0].as_py(), LEVELS))
    # Above the group every leaf takes the same way: its states before the slot are kept once, with the siblings to the right.
    upper = [(hashlib.sha256(step["left"].encode()), step["right"].encode()) for step in way]
    rest = "".join(step["left"] + step["right"] for step in way).encode()
    proofs, folded = [], []
    for i, leaf in enumerate(leaves):
        proof = hashlib.sha256("".join(a + b for a, b in tree.way(i)).encode())
        proof.update(rest)
        proofs.append(proof.hexdigest())
        node = tree.fold(i, changed[i] or leaf)
        for before, right in upper:
            state = before.copy()
            state.update(node.encode())
            state.update(right)
            node = state.hexdigest()
        folded.append(node)
    n = len(leaves)
    return pa.table({"id": nodes.column("id"), "leaf": leaves, "subroot": pa.array([subroot] * n, pa.string()), "root": pa.array([root] * n, pa.string()), "proof_sha256": proofs, "folded_root": folded, "verified": [f == root for f in folded]})


def manifest(docs: DataFrame, fields: list[str], changed: dict[str, Column] | None = None, when: Column | None = None, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """``(id_col, leaf, subroot, root, proof_sha256, folded_root, verified)``, a row for each row of ``docs``.

    Leaves are made of ``fields``, ordered by id within their source; subroots are ordered by source as UTF-8 bytes, null first.
    ``proof_sha256`` is the digest of all siblings from the leaf to the root, level by level, left to right (of nothing for a lone leaf).
    Where ``when`` holds, the fields in ``changed`` are replaced before folding; ``verified`` says whether the fold gives the root.

    Null ids come first in their source and are never changed unless ``when`` holds; rows that repeat an id are ordered by leaf. Null
    fields count as ``-``; an empty table gives no rows; columns not in ``fields`` have no effect."""
    leaf = digest([F.col(c) for c in fields])
    other = F.when(when, digest([(changed or {}).get(c, F.col(c)) for c in fields])) if when is not None else F.lit(None).cast("string")
    tree = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    nodes = docs.select(tree.alias("tree"), F.col(id_col).cast("long").alias("id"), leaf.alias("digest"), other.alias("changed"))
    placed = staged(_placed(nodes, "id", "digest"), "placed")
    tables = _rounds(placed)
    # The sources' tree: its leaves are the subroots, in the order of their sources.
    tops = tables[-1]
    sources = staged(_placed(tops.select(F.lit("sources").alias("tree"), F.col("tree").alias("name"), "digest"), "name"), "sources")
    upper = _rounds(sources)
    whole = upper[-1].select("tree", "place", F.array().cast(WAY).alias("way"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    above = _ways(upper, whole, 0).join(sources.select("tree", "place", "name", "digest"), ["tree", "place"])
    start = above.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("place"), "way", F.col("digest").alias("subroot"), "root")
    groups = _ways(tables, start, 1).withColumnRenamed("place", "block")
    met = _block(placed).groupBy("tree", "block").cogroup(groups.groupBy("tree", "block"))
    out = met.applyInArrow(_leaves, "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return out.withColumnRenamed("id", id_col)
