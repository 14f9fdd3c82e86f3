"""Helpers shared by the training-data operators: staging tables, folds, and hashing the words of many texts at once."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that the numpy helpers take in hand at a time.
CHUNK_BYTES = 1 << 17


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, a temporary one is set in local mode; on a cluster it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='glimpse-')}"
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base


def stage(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage, and lost executors cost no recomputation."""
    path = f"{scratch(df.sparkSession)}/glimpse/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def folders(spark: SparkSession, name: str):
    """Writes each table in turn to one of two folders, over the last but one, and reads it again: for rounds that need their predecessor alone."""
    base, turns = f"{scratch(spark)}/glimpse/{name}-{uuid.uuid4().hex}", 0

    def put(df: DataFrame) -> DataFrame:
        nonlocal turns
        turns += 1
        path = f"{base}/{turns % 2}"
        df.write.mode("overwrite").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return put


def positions(df: DataFrame, name: str, group: list[str], order: list[str], weight: str | None = None) -> DataFrame:
    """``df``, written, with ``pos`` (rows of its ``group`` before it by ``order``, nulls first), ``n`` (rows of the group) and, of a weight, ``before`` and ``total``.

    Ranges of (group, order) are sorted apart and counted; a row's place is that in its range and what earlier ranges hold, so that a group
    of all rows is no task's work. Rows that ``order`` doesn't tell apart come in any order. A null group is a group.
    """
    key = [*group, *order]
    s = df.withColumn("_row", F.monotonically_increasing_id())  # parts equal rows, however many
    s = s.repartitionByRange(*key, "_row").sortWithinPartitions(*key, "_row").drop("_row")
    s = stage(s.withColumn("_at", F.monotonically_increasing_id()), name)  # range number and place in it
    s = s.withColumn("_range", F.shiftright("_at", 33))
    sums = [F.sum(weight).alias("_w")] if weight else []
    per = s.groupBy("_range", *group).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"), *sums)
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    per = per.withColumn("_shift", so_far("_n") - F.col("_first")).withColumn("n", F.sum("_n").over(whole))
    if weight:
        s = s.withColumn("before", F.coalesce(F.sum(weight).over(Window.partitionBy("_range", *group).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        per = per.withColumn("_before", so_far("_w")).withColumn("total", F.sum("_w").over(whole))
    per = per.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col("_range").alias("_r"), "_shift", "n", *(["_before", "total"] if weight else []))
    same = F.col("_range") == F.col("_r")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    j = s.join(per, same).withColumn("pos", F.col("_at") + F.col("_shift"))
    if weight:
        j = j.withColumn("before", F.col("before") + F.col("_before"))
    return j.select(*df.columns, "pos", "n", *(["before", "total"] if weight else []))


def text_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """``df``; its session passes rows to Python in small batches from now on, as texts are long, unless it has a size of its own."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df


def fold(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, mod n. A null id counts as empty text."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(n))


def turn(salt: str, column: str) -> Column:
    """A number from 0 to 1 by the hash of a column, in steps of 2**-53, so that a sample of any size can be taken from a table of any size."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(salt), column), 11) / float(1 << 53)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


# --- words of many texts, by numpy ---------------------------------------------------------------

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 2**64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_POW: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Byte classes after lower-casing A-Z. SPACED: runs of anything but space, tab to carriage return. ALNUM: digits, a-z and all beyond ASCII.
SPACED = np.ones(256, bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
LETTERS = ALNUM.copy()
LETTERS[48:58] = False


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        for k, base in enumerate((_BASE, _INV)):
            a = np.full(n, base, np.uint64)
            a[0] = 1
            _POW[k] = np.multiply.accumulate(a)
    return _POW[0], _POW[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


class Words:
    """The words of a list of texts (bytes or None): ``buf`` lower-cased bytes, ``start``/``end`` in it, ``doc`` the text's position, ``hash``."""

    def __init__(self, texts: list[bytes | None], kind: np.ndarray):
        texts = [t or b"" for t in texts]
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.n_docs = len(texts)
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        ends = np.cumsum(size + 1)  # just after each text's separator
        self.buf = _LOWER[raw]
        inside = kind[self.buf]
        inside[ends - 1] = False
        step = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
        self.start, self.end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        self.doc = np.searchsorted(ends, self.start, side="right")
        self.count = np.bincount(self.doc, minlength=self.n_docs)
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        out, i, n = np.empty(len(self.start), np.uint64), 0, len(self.start)
        while i < n:
            at = self.start[i]
            j = max(i + 1, int(np.searchsorted(self.end, at + CHUNK_BYTES, side="right")))
            part = self.buf[at : self.end[j - 1]]
            up, down = _powers(len(part) + 1)
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[part] * up[: len(part)])])
            s, e = self.start[i:j] - at, self.end[i:j] - at
            out[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
            i = j
        return out

    def word(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.end[i]].tobytes()


def byte_column(batch, name: str) -> list[bytes | None]:
    """A text column of an Arrow batch as UTF-8 bytes."""
    import pyarrow as pa

    return batch.column(name).cast(pa.binary()).to_pylist()


def pieces(texts: list[bytes | None], most: int = 2 << 20):
    """Cuts of a list of texts as (from, to), each of about ``most`` bytes at least one text."""
    at, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t or b"")
        if total >= most:
            yield at, i + 1
            at, total = i + 1, 0
    if at < len(texts):
        yield at, len(texts)
