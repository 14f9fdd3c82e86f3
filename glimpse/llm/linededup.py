"""Line dedup by winnowing over line hashes.

A stretch is a run of whole lines with at least ``run_words`` words that would have fewer without its last line, or without its
first one. A gram is the shortest run of lines from a line on that has ``gram_words`` words; the one with the least hash within
a stretch is the stretch's fingerprint. Stretches with one fingerprint and one hash of all their lines are the same; all places of
one but the first (by doc_id, then line) are deleted. They are grouped, never compared in pairs.

Every line of a run of ``run_words`` words or more is in a stretch inside that run: in the one that begins with it, if as many
words follow in the run, else in one that ends with it, or with the run. So exactly the runs that stand in an earlier place go,
each line whose run has that many words; the first place of every line stays.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimpse.llm.common import _powers, free_name, mix, stage, text_batches


def stretches(line_hash: np.ndarray, words: np.ndarray, gram_words: int, run_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First line, line after the last, fingerprint and hash of the stretches of a text, by its lines' hashes and word counts."""
    n, total = len(words), np.concatenate([[0], np.cumsum(words)])
    lines = np.arange(n)
    to = np.searchsorted(total, total[:n] + run_words)  # the least end with as many words
    since = np.searchsorted(total, total[1:] - run_words, side="right") - 1  # the last beginning with as many words
    spans = np.concatenate([np.stack([lines, to], 1)[to <= n], np.stack([since, lines + 1], 1)[since >= 0]])
    if not len(spans):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    lo, hi = np.unique(spans, axis=0).T
    up, down = _powers(n + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(line_hash.view(np.uint64)) * up[:n])])

    def hashed(a, b):
        return mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))

    end = np.searchsorted(total, total[:n] + gram_words)  # a gram is lines i to end-1; grams begin and end with words
    grams = np.full(n + 1, 2**64 - 1, np.uint64)
    i = np.flatnonzero((end <= n) & (words > 0))
    grams[i] = hashed(i, end[i])
    inside = np.maximum(np.searchsorted(end, hi, side="right"), lo + 1)  # grams from lines lo to inside-1 end by hi
    least = np.minimum.reduceat(grams, np.stack([lo, inside], 1).ravel())[::2]
    return lo, hi, least.view(np.int64), hashed(lo, hi).view(np.int64)


def fingerprints(line_hash: np.ndarray, words: np.ndarray, gram_words: int, run_words: int) -> list[tuple[int, int]]:
    """(fingerprint, first line) of the stretches of a text."""
    lo, _, gram, _ = stretches(line_hash, words, gram_words, run_words)
    return list(zip(gram.tolist(), lo.tolist(), strict=True))


def read_lines(texts: list[bytes | None], gram_words: int, run_words: int):
    """Per text: its stretches."""
    import xxhash

    for t in texts:
        lines = (t or b"").split(b"\n") if t is not None else []
        h = np.array([xxhash.xxh3_64_intdigest(x) for x in lines], np.uint64).view(np.int64)
        words = np.array([len(x.split()) for x in lines], np.int64)
        yield stretches(h, words, gram_words, run_words)


def repeated_runs(docs: DataFrame, gram_words: int = 25, run_words: int = 50) -> DataFrame:
    """__id, __text (hash), from, to: lines [from, to) of documents that repeat lines of earlier ones. Rows equal in id and text are one document; a null id comes last."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            found = [*read_lines(b.column("text").cast(pa.binary()).to_pylist(), gram_words, run_words)]
            of = pa.array(np.repeat(np.arange(len(found)), [len(x[0]) for x in found]))
            lo, hi, gram, whole = (np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found, strict=True) if found else [()] * 4))
            cols = [b.column("__id").take(of), b.column("__text").take(of), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(gram), pa.array(whole)]
            yield pa.RecordBatch.from_arrays(cols, names=["__id", "__text", "from", "to", "gram", "whole"])

    d = text_batches(docs).select(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__text"), "text")
    kind = d.schema["__id"].dataType.simpleString()
    p = stage(d.mapInArrow(run, f"__id {kind}, __text long, from int, to int, gram long, whole long"), "stretches")
    place = F.struct(F.col("__id").isNull().alias("n"), "__id", "__text", "from")
    first = p.groupBy("gram", "whole").agg(F.min(place).alias("f"), F.count("*").alias("n")).where("n > 1").select("gram", "whole", "f")
    return p.hint("merge").join(first, ["gram", "whole"]).where(place != F.col("f")).select("__id", "__text", "from", "to")


def deleted_lines(docs: DataFrame, **how) -> DataFrame:
    """__id, __text, gone: the numbers of lines to delete, ascending."""
    r = repeated_runs(docs, **how)
    r = r.select("__id", "__text", F.explode(F.sequence(F.col("from"), F.col("to") - 1)).alias("line")).distinct()
    return r.groupBy("__id", "__text").agg(F.array_sort(F.collect_list("line")).alias("gone"))


def dedup(docs: DataFrame, counts: bool = False, **how) -> DataFrame:
    """``docs`` without the lines of later repeated runs; other columns stay. ``counts`` adds n_lines and n_deleted, with a trailing underscore where ``docs`` has such a column.

    Null texts stay null with no lines; an empty text is one empty line. Lines are compared byte by byte (64-bit hash).
    """
    g = stage(deleted_lines(docs, **how), "gone")
    # The rest of a row goes in a struct, so that no column of it meets one of ours.
    others = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c.lower() != "text"])
    d = docs.select(F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_text"), "text", others.alias("row"))
    # One plan at all sizes: texts are shuffled once, compressed, whether the deletions would fit a broadcast or not.
    d = d.hint("merge").join(g, F.col("own_id").eqNullSafe(F.col("__id")) & (F.col("own_text") == F.col("__text")), "left")
    lines = F.split("text", "\n", -1)
    kept = F.filter(F.transform(lines, lambda x, i: F.when(~F.array_contains(F.col("gone"), i), x)), lambda x: x.isNotNull())
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    out = [text.alias(c) if c.lower() == "text" else F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(docs.columns)]
    if counts:
        n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long")
        out += [n_lines.alias(free_name(docs, "n_lines")), F.greatest(F.coalesce(F.size("gone"), F.lit(0)), F.lit(0)).cast("long").alias(free_name(docs, "n_deleted"))]
    return d.select(*out)
