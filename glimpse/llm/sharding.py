"""Shards along a Hilbert curve, with DataFrame functions alone: rows alike in several columns of metadata stand together, so that
a filter on any of them reads few shards.

Each column is cut into cells of about equally many rows; a row's cells are a point, its index on the curve the sort key, and runs of
the sorted rows are the shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glimpse.llm.common import positions, stage

#: Bytes that a row takes besides its text.
ROW_BYTES = 16


def described(docs: DataFrame, dims: tuple[str, ...], *more: str) -> DataFrame:
    """doc_id, size, text_crc32 and the ``dims`` as d0, d1, ...: all that sharding needs of a document; and ``more`` columns."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + ROW_BYTES
    return docs.select("doc_id", size.alias("size"), F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"), *[F.col(c).alias(f"d{i}") for i, c in enumerate(dims)], *more)


def cuts(rows: DataFrame, column: str, bits: int) -> list[tuple[int, object]]:
    """(cell, its least value), ascending: at most 2**bits cells with about equally many rows each; a value is never split, nulls come first.

    Counts are taken of the values of all rows and summed in their order, so that cuts are exact and alike in each run.
    """
    counts = rows.groupBy(F.col(column).alias("v")).agg(F.count("*").alias("w"))
    p = positions(counts, "sharding-cuts", [], ["v"], weight="w")
    cell = F.floor(F.col("before") * F.lit(1 << bits) / F.col("total")).cast("int")
    low = p.where("v is not null").groupBy(cell.alias("cell")).agg(F.min("v").alias("low"))
    return sorted((r["cell"], r["low"]) for r in low.collect())  # a value a cell


def cell_of(value: Column, found: list[tuple[int, object]]) -> Column:
    """The cell of a value, by halving; null: 0."""

    def half(some):
        if len(some) == 1:
            return F.lit(some[0][0])
        m = len(some) // 2
        return F.when(value >= F.lit(some[m][1]), half(some[m:])).otherwise(half(some[:m]))

    return F.when(value.isNull(), 0).otherwise(half(found)).cast("int") if found else F.lit(0)


def _with(value: Column, then) -> Column:
    """``then(value)``, the value computed once however often it is used."""
    return F.transform(F.array(value), then)[0]


def curve_index(point: Column, dims: int, bits: int) -> Column:
    """The Hilbert index of a point, an array of ``dims`` ints from 0 to 2**bits - 1.

    Bit by bit from the highest, each coordinate turns the first one's lower bits, or swaps them with its own; a Gray code of what is left gives the index.
    """
    steps = F.array(*[F.struct(F.lit(1 << b).alias("bit"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(dims)]).cast("array<struct<bit:int,i:int>>")

    def turned(x, s):
        low = s["bit"] - 1
        on = F.get(x, s["i"]).bitwiseAND(s["bit"]) != 0
        differ = F.get(x, F.lit(0)).bitwiseXOR(F.get(x, s["i"])).bitwiseAND(low)
        return F.transform(x, lambda v, k: F.when(k == 0, v.bitwiseXOR(F.when(on, low).otherwise(differ))).when((k == s["i"]) & ~on, v.bitwiseXOR(differ)).otherwise(v))

    def numbered(g):
        last = F.get(g, F.lit(dims - 1))
        flip = F.lit(0)
        for b in range(bits - 1, 0, -1):
            flip = flip.bitwiseXOR(F.when(last.bitwiseAND(1 << b) != 0, (1 << b) - 1).otherwise(0))
        places = F.array(*[F.struct(F.lit(b).alias("b"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(dims)])
        return _with(flip, lambda f: F.aggregate(places, F.lit(0).cast("long"), lambda h, p: h * 2 + F.call_function("shiftright", F.get(g, p["i"]).bitwiseXOR(f), p["b"]).bitwiseAND(1)))

    gray = lambda x: F.transform(x, lambda v, k: F.aggregate(F.slice(x, F.lit(1), k + 1), F.lit(0), lambda s, y: s.bitwiseXOR(y)))
    return _with(F.aggregate(steps, point, turned), lambda x: _with(gray(x), numbered))


def in_shards(placed: DataFrame, n_shards: int, law: str) -> DataFrame:
    """``placed`` (h, doc_id, size, text_crc32, ...) with shard and slot."""
    order = ["h", "text_crc32", "doc_id"]
    if law == "rows":
        p = positions(placed, "sharding-order", [], order)
        p = p.withColumn("shard", F.expr(f"(pos * {n_shards}) div n").cast("int"))
        return p.withColumn("slot", F.col("pos") - F.expr(f"(shard * n + {n_shards - 1}) div {n_shards}"))
    if law == "bytes":
        p = positions(placed, "sharding-order", [], order, weight="size")
        p = stage(p.withColumn("shard", F.least(F.expr(f"(before * {n_shards}) div total"), F.lit(n_shards - 1)).cast("int")), "sharding-shards")
        start = p.groupBy("shard").agg(F.min("pos").alias("start"))
        return p.join(F.broadcast(start), "shard").withColumn("slot", F.col("pos") - F.col("start"))  # a row a shard
    raise ValueError(f"unknown law {law}")


def on_curve(docs: DataFrame, dims: tuple[str, ...], bits: int, keep: bool) -> DataFrame:
    """h, doc_id, size, text_crc32 and, to ``keep``, the whole row as a struct."""
    if len(dims) * bits > 62:
        raise ValueError("the index has more than 62 bits")
    rows = stage(described(docs, dims), "sharding-rows")
    found = [cuts(rows, f"d{i}", bits) for i in range(len(dims))]
    if keep:
        whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
        rows = described(docs.select(*{"doc_id", "text", *dims}, whole), dims, "row")
    point = F.array(*[cell_of(F.col(f"d{i}"), found[i]) for i in range(len(dims))])
    return rows.withColumn("h", curve_index(point, len(dims), bits)).drop(*[f"d{i}" for i in range(len(dims))])


def shard(docs: DataFrame, n_shards: int = 40, dims: tuple[str, ...] = ("source", "lang", "n_chars"), bits: int = 6, law: str = "rows") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null): shards 0 .. n_shards - 1 are runs along the curve through ``dims``.

    ``law`` ``rows``: counts of shards are at most one apart. ``bytes``: a shard takes the rows that begin in its n-th part of all bytes.
    Rows of one point stand by text, then doc_id, so equal texts with equal metadata are neighbours, parted by a cut at most. A null text has no
    bytes (crc 0), a null in a column lies in its first cell, equal rows are rows each, other columns don't count, an empty table has no rows.
    """
    p = in_shards(on_curve(docs, dims, bits, False), n_shards, law)
    return p.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, n_shards: int = 40, dims: tuple[str, ...] = ("source", "lang", "n_chars"), bits: int = 6, law: str = "rows") -> None:
    """``docs``, all columns kept, as Parquet under ``path``, a folder ``_shard=n`` each; files hold runs of slots in order, so their statistics prune."""
    p = in_shards(on_curve(docs, dims, bits, True), n_shards, law)
    p.sortWithinPartitions("shard", "slot").select("row.*", F.col("shard").alias("_shard")).write.partitionBy("_shard").parquet(path)
