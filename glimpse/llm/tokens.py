"""Token-ID output in training order.

All documents' tokens, an end mark after each, form one stream in the order in which Spark reads them, cut into sequences of
fixed length. A keyed Feistel network over the next even power of two, walked until it falls inside, permutes the sequences'
numbers: each has one global slot. Slots are dealt in ranges to shards, whose records have all the same size: the n-th
sequence of the training order is found by arithmetic, and reading can go on from any slot.

Documents are tokenised once. Each partition's ids are staged with their place within it; the partitions' totals, one number
each, then give every id its place in the stream.
"""

from __future__ import annotations

import base64
import os
import uuid
from array import array

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glimpse.llm.common import byte_column, pieces, scratch, stage, text_batches

RANKS = os.environ.get("GLIMPSE_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: How the vocabulary's makers split text before merging; ids depend on it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Ids in a staged run.
RUN = 1 << 20
#: Ids whose pieces of sequences a task groups by shard at a time.
GROUPED = 1 << 22
#: zstandard level of ids on their way; the disk is what limits this operator.
LEVEL = 9
#: Staged runs of which a dictionary for pieces of sequences is made, and its bytes. With many shards, a group has few sequences of each.
SAMPLED, DICTIONARY = 8, 112_640
_ENCODERS: dict[str, Encoder] = {}


class Encoder:
    """Texts to 16-bit ids. A worker keeps its encoder."""

    def __init__(self, path: str = RANKS):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.end = max(ranks.values()) + 1  # the free id marks a text's end
        if self.end >= 1 << 16:
            raise ValueError("ids need more than 16 bits")
        self.bpe = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[bytes | None]) -> bytes:
        """The ids of all texts, little-endian, an end mark after each."""
        out = array("H")
        for t in texts:
            out.extend(self.bpe.encode_ordinary(t.decode("utf-8", "replace")) if t else ())
            out.append(self.end)
        return out.tobytes()


def encoder(path: str = RANKS) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def slot_of(index: np.ndarray, n: int, key: int, rounds: int = 6, back: bool = False) -> np.ndarray:
    """The keyed permutation of 0..n-1, or its inverse."""
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    mask, h = np.uint64((1 << half) - 1), np.uint64(half)
    keys = _mix64(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key % 2**64))

    def once(x):
        left, right = x >> h, x & mask
        for k in keys[::-1] if back else keys:
            if back:
                left, right = right ^ (_mix64(left + k) & mask), left
            else:
                left, right = right, left ^ (_mix64(right + k) & mask)
        return (left << h) | right

    x = once(np.asarray(index, np.uint64))
    while (out := x >= np.uint64(n)).any():
        x[out] = once(x[out])
    return x.astype(np.int64)


def tokenised(docs: DataFrame, vocabulary: str = RANKS) -> DataFrame:
    """part, at, n, tokens: runs of documents' ids (end marks included, compressed) with their place among those of their part."""

    def run(batches):
        import pyarrow as pa

        import zstandard

        squeeze = zstandard.ZstdCompressor(level=LEVEL).compress
        part, at = TaskContext.get().partitionId(), 0
        held = b""

        def rows(data, last):
            nonlocal at
            ids = [data[c : c + 2 * RUN] for c in range(0, len(data), 2 * RUN)]
            rest = ids.pop() if ids and not last and len(ids[-1]) < 2 * RUN else b""
            starts = [at + RUN * k for k in range(len(ids))]
            sizes = [len(x) // 2 for x in ids]
            at += sum(sizes)
            return rest, pa.RecordBatch.from_arrays([pa.array([part] * len(ids), pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array([squeeze(x) for x in ids], pa.binary())], names=["part", "at", "n", "tokens"])

        for b in batches:
            texts = byte_column(b, "text")
            for i, j in pieces(texts, 4 << 20):
                held, out = rows(held + encoder(vocabulary).encode(texts[i:j]), False)
                yield out
        yield rows(held, True)[1]

    return docs.select("text").mapInArrow(run, "part long, at long, n long, tokens binary")


def sequences(docs: DataFrame, length: int = 1024, shard_slots: int = 4096, key: int = 20240229, vocabulary: str = RANKS) -> DataFrame:
    """shard, slot, sequence, n_tokens (the last may be shorter; it is filled with end marks), tokens (little-endian 16-bit ids, 2 * length bytes).

    Null and empty texts are an end mark alone. Shards are ranges of ``shard_slots`` slots; a shard is in one partition, in order of slots.
    """
    return _placed(*_stream(docs, length, vocabulary), length, shard_slots, key, vocabulary)


def _stream(docs: DataFrame, length: int, vocabulary: str) -> tuple[DataFrame, dict[int, int], int]:
    """Staged ids, the place of each part in the stream, and the number of sequences."""
    tokens = stage(tokenised(text_batches(docs), vocabulary), "tokens", compression="none")
    base, total = {}, 0
    for r in tokens.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():  # one row a partition
        base[r.part], total = total, total + r.n
    return tokens, base, -(-total // length)


def _dictionary(tokens: DataFrame, length: int) -> bytes:
    """What is common in sequences, from the first run of up to ``SAMPLED`` parts; empty where they hold few sequences. It shortens what travels and changes no result."""
    import zstandard

    runs = [zstandard.ZstdDecompressor().decompress(r.tokens) for r in tokens.where((F.col("at") == 0) & (F.col("n") > 0)).select("tokens").limit(SAMPLED).collect()]
    parts = [run[i : i + 2 * length] for run in runs for i in range(0, len(run), 2 * length)]
    parts = parts[:: -(-len(parts) // 4096) or 1]
    if sum(map(len, parts)) < 16 * DICTIONARY or len(parts) < 64:
        return b""
    return zstandard.train_dictionary(DICTIONARY, parts).as_bytes()


def _placed(tokens: DataFrame, base: dict[int, int], n: int, length: int, shard_slots: int, key: int, vocabulary: str) -> DataFrame:
    """Sequences in order of slots. Pieces of sequences travel in groups of one shard, compressed together; a shard's task writes them to their places in a buffer of the shard's size."""
    common = _dictionary(tokens, length)

    def place(batches):
        import pyarrow as pa
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(common) if common else None).compress
        expand = zstandard.ZstdDecompressor().decompress
        held, ids = [], 0

        def groups():
            heads, parts = (np.concatenate([h for h, _ in held]), [p for _, ps in held for p in ps]) if held else (np.zeros((0, 4), np.int64), [])
            order = np.argsort(heads[:, 0], kind="stable")
            cut = np.flatnonzero(np.diff(heads[order, 0], prepend=-1, append=-1))
            cols = [[], [], []]
            for x, z in zip(cut[:-1], cut[1:], strict=True):
                mine = order[x:z]
                cols[0].append(int(heads[mine[0], 0]))
                cols[1].append(np.ascontiguousarray(heads[mine, 1:]).tobytes())
                cols[2].append(squeeze(b"".join([parts[i] for i in mine])))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["shard", "heads", "parts"])

        for b in batches:
            for part, at, data in zip(*(b.column(c).to_pylist() for c in ("part", "at", "tokens")), strict=True):
                at, data = at + base[part], expand(data)
                m = len(data) // 2
                cuts = np.array([at, *range((at // length + 1) * length, at + m, length), at + m])
                slot = slot_of(cuts[:-1] // length, n, key)
                held.append((np.stack([slot // shard_slots, slot, cuts[:-1] % length, np.diff(cuts)], 1), [data[2 * (x - at) : 2 * (z - at)] for x, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]))
                ids += m
                if ids >= GROUPED:
                    yield groups()
                    held, ids = [], 0
        yield groups()

    def fill(batches):
        import pyarrow as pa
        import zstandard

        expand = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(common) if common else None).decompress
        now, buffer, filled = None, None, None

        def records():
            first = now * shard_slots
            seq = slot_of(np.arange(first, first + len(filled)), n, key, back=True)
            for i in range(0, len(filled), 512):
                j = min(i + 512, len(filled))
                raw = [buffer[k].tobytes() for k in range(i, j)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(j - i, now)), pa.array(np.arange(first + i, first + j)), pa.array(seq[i:j]), pa.array(filled[i:j]), pa.array(raw, pa.binary())], names=["shard", "slot", "sequence", "n_tokens", "tokens"])

        for b in batches:
            for shard, heads, parts in zip(*(b.column(c).to_pylist() for c in ("shard", "heads", "parts")), strict=True):
                if shard != now:
                    if now is not None:
                        yield from records()
                    now, slots = shard, min(shard_slots, n - shard * shard_slots)
                    buffer, filled = np.full((slots, length), encoder(vocabulary).end, np.uint16), np.zeros(slots, np.int32)
                ids, at = np.frombuffer(expand(parts), np.uint16), 0
                for slot, skip, m in np.frombuffer(heads, np.int64).reshape(-1, 3).tolist():
                    slot -= now * shard_slots
                    buffer[slot, skip : skip + m] = ids[at : at + m]
                    filled[slot] += m
                    at += m
        if now is not None:
            yield from records()

    placed = tokens.mapInArrow(place, "shard long, heads binary, parts binary")
    shards = max(1, -(-n // shard_slots))
    each = -(-shards // 50_000)  # shards of a partition
    dealt = placed.repartitionById(-(-shards // each), F.floor(F.col("shard") / each).cast("int")).sortWithinPartitions("shard")  # ranges of slots
    return dealt.mapInArrow(fill, "shard long, slot long, sequence long, n_tokens int, tokens binary")


def write_shards(seqs: DataFrame, path: str) -> None:
    """One file for each shard under path/shard=N: raw records of 2 * length bytes, each followed by one newline byte, in order of slots."""
    raw = seqs.sortWithinPartitions("shard", "slot").select("shard", F.col("tokens").cast("string").alias("value"))
    raw.write.partitionBy("shard").option("lineSep", "\n").text(path)


def read_shards(spark: SparkSession, path: str, n: int, length: int = 1024, shard_slots: int = 4096, key: int = 20240229) -> DataFrame:
    """shard, slot, offset, tokens, sequence: the records of written shards of ``n`` sequences, by their fixed stride."""
    stride = 2 * length + 1
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path).where(F.col("length") >= stride)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            slot = b.column("slot").to_numpy()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(slot_of(slot, n, key, back=True) if len(slot) else slot)], names=[*b.schema.names, "sequence"])

    # Records are cut on the JVM, by generated code that holds a file's bytes once; Python meets a batch of records at a time.
    k = F.explode(F.sequence(F.lit(0), F.floor(F.col("length") / stride).cast("int") - 1)).alias("k")
    cut = files.select(F.regexp_extract("path", r"shard=(\d+)", 1).cast("long").alias("shard"), "content", k)
    records = cut.select("shard", (F.col("shard") * shard_slots + F.col("k")).alias("slot"), (F.col("k").cast("long") * stride).alias("offset"), F.substring("content", F.col("k") * stride + 1, F.lit(2 * length)).alias("tokens"))
    return text_batches(records).mapInArrow(run, "shard long, slot long, offset long, tokens binary, sequence long")


def materialise(docs: DataFrame, path: str | None = None, length: int = 1024, shard_slots: int = 4096, key: int = 20240229, vocabulary: str = RANKS) -> DataFrame:
    """Write ``docs`` as shards under ``path`` (else a new folder of the shared one) and read them again: shard, slot, offset (of the record in its shard's file), tokens, sequence, path.

    The stream follows the order in which Spark reads ``docs``: the same files cut alike give the same shards. Repeated rows are texts of
    their own; other columns than the text play no part.
    """
    spark = docs.sparkSession
    path = path or f"{scratch(spark)}/glimpse/shards-{uuid.uuid4().hex}"
    tokens, base, n = _stream(docs, length, vocabulary)
    write_shards(_placed(tokens, base, n, length, shard_slots, key, vocabulary), path)
    return read_shards(spark, path, n, length, shard_slots, key).withColumn("path", F.lit(path))
