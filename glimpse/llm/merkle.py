"""A Merkle tree over a dataset's rows: a digest a row, a subtree a group, one root for all.

Nodes of a group stand in order; every ``fan`` consecutive ones are a run. Windows with fixed lags and leads, masked by a node's slot
in its run and by the run's length, supply its siblings; the first child of a run hashes its parent. Runs never cross a window's block of
consecutive nodes, so a group of all rows is many windows. The way to the root goes down again from parents to children.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glimpse.llm.common import positions, stage

FAN = 8
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """sha256, in hex, of texts put together."""
    return F.sha2(F.concat(*parts), 256)


def row_digest(*values: Column) -> Column:
    """Digest of a row: each value as ``-`` if null, else its bytes' count, a colon and itself as text."""
    texts = [v.cast("string") for v in values]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def level(nodes: DataFrame, fan: int, block: int) -> DataFrame:
    """``nodes`` (g, pos, n, node, ...) with ``left`` and ``right``: the digests of a node's siblings before and behind it, put together."""
    w = Window.partitionBy("g", "block").orderBy("pos")
    slot = F.col("pos") % fan
    run = F.least(F.lit(fan), F.col("n") - (F.col("pos") - slot))
    before = [F.when(slot >= d, F.lag("node", d).over(w)) for d in range(fan - 1, 0, -1)]
    behind = [F.when(slot + d < run, F.lead("node", d).over(w)) for d in range(1, fan)]
    nodes = nodes.withColumn("block", F.floor(F.col("pos") / (block * fan)))
    return nodes.withColumn("left", F.concat_ws("", *before)).withColumn("right", F.concat_ws("", *behind)).drop("block")


def tree(leaves: DataFrame, tops: Callable[[DataFrame], DataFrame] | None, name: str, fan: int = FAN, block: int = 64) -> tuple[DataFrame, DataFrame]:
    """(tops, ways) of ``leaves`` (g, pos, n, node, any other columns).

    tops: g, node, for each group. ways: the leaves' columns and ``way``, the steps (left, right) up to the top. ``tops``, where given, makes of
    the tops (g, node) what lies above them (g, way, any columns): ways go on with it, and the columns go down to the leaves.
    """
    most = leaves.agg(F.max("n")).first()[0] or 0
    levels, nodes, ends = [], leaves, []
    while True:
        ends.append(nodes.where("n = 1"))
        if most <= 1:
            break
        at = stage(level(nodes.where("n > 1"), fan, block), f"{name}-level")
        levels.append(at)
        first = at.where(F.col("pos") % fan == 0)
        nodes = first.select("g", F.floor(F.col("pos") / fan).alias("pos"), F.ceil(F.col("n") / fan).alias("n"), digest(F.col("left"), F.col("node"), F.col("right")).alias("node"))
        most = -(-most // fan)
    top = ends[0].select("g", "node")
    for e in ends[1:]:
        top = top.unionByName(e.select("g", "node"))
    top = stage(top, f"{name}-tops")
    above = stage(tops(top), f"{name}-above") if tops else top.select("g", F.array().cast(STEP).alias("way"))
    more = [c for c in above.columns if c != "g"]
    above = above.withColumnRenamed("g", "_g")
    own = [c for c in leaves.columns]

    def ended(e: DataFrame, columns: list[str]) -> DataFrame:
        return e.select(*columns).join(above, F.col("g").eqNullSafe(F.col("_g"))).select(*columns, *more)

    down = ended(ends[-1], own if not levels else ["g", "pos"])
    for i in range(len(levels) - 1, -1, -1):
        columns = own if i == 0 else ["g", "pos"]
        up = down.select(F.col("g").alias("_g"), F.col("pos").alias("_pos"), *[F.col(c).alias(f"_{c}") for c in more])
        j = levels[i].join(up, F.col("g").eqNullSafe(F.col("_g")) & (F.floor(F.col("pos") / fan) == F.col("_pos")))
        way = F.concat(F.array(F.struct("left", "right")), F.col("_way"))
        down = j.select(*columns, *[(way if c == "way" else F.col(f"_{c}")).alias(c) for c in more]).unionByName(ended(ends[i], columns))
    return top, down


def manifest(docs: DataFrame, altered: Column | None = None, columns: tuple[str, ...] = COLUMNS, group: str = "lang", key: str = "doc_id") -> DataFrame:
    """key, leaf, subroot, root, way (steps from the leaf by its group's top to the root), altered_leaf (null unless asked for).

    ``docs`` are hashed by ``columns``; a group's rows stand by key, nulls first, equal keys by their digests; groups by code point, null
    first. ``altered`` takes the place of the text for a second digest, as a later state of the row. Equal rows are leaves each, columns
    beyond ``columns`` don't count, an empty table has no rows.
    """
    values = [F.col(c) for c in columns]
    other = F.lit(None).cast("string") if altered is None else row_digest(*[altered if c == "text" else F.col(c) for c in columns])
    rows = docs.select(F.col(key).alias("k"), F.col(group).cast("string").alias("g"), row_digest(*values).alias("node"), other.alias("altered"))
    rows = positions(stage(rows.withColumn("altered", F.nullif("altered", "node")), "merkle-leaves"), "merkle-order", ["g"], ["k", "node"])

    def roots(tops: DataFrame) -> DataFrame:
        """What lies above each group's top: the tree of tops."""
        t = positions(tops.withColumnRenamed("node", "top").withColumn("at", F.col("g")), "merkle-tops", [], ["at"])
        t = t.select(F.lit(0).alias("g"), F.col("at"), F.col("top").alias("node"), "pos", "n")
        root, ways = tree(t, None, "merkle-root")
        return ways.crossJoin(F.broadcast(root.select(F.col("node").alias("root")))).select(F.col("at").alias("g"), F.col("node").alias("subroot"), "root", "way")  # one root

    _, ways = tree(rows, roots, "merkle")
    return ways.select(F.col("k").alias(key), F.col("node").alias("leaf"), "subroot", "root", "way", F.coalesce("altered", "node").alias("altered_leaf"))


def folded(leaf: Column, way: Column) -> Column:
    """The root that a leaf leads to by its way."""
    return F.aggregate(way, leaf, lambda d, s: digest(s["left"], d, s["right"]))


def siblings(way: Column) -> Column:
    """All digests of a way, level by level, left to right."""
    return F.array_join(F.transform(way, lambda s: F.concat(s["left"], s["right"])), "")


def verify(docs: DataFrame, altered: Column) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: whether rows whose text became ``altered`` still lead to the root by their old siblings."""
    m = manifest(docs, altered).withColumn("folded_root", folded(F.col("altered_leaf"), F.col("way")))
    return m.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("way")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
