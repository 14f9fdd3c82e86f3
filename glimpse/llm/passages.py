"""Repeated passages, wherever in a line they begin and end, by winnowing.

Of each ``run_words - gram_words + 1`` consecutive grams (runs of ``gram_words`` words) the one with the least hash is a fingerprint:
equal windows of ``run_words`` words have equal ones, so only places of one fingerprint can be in equal windows. A fingerprint's
span is all that its windows cover. Places whose spans are equal as a whole form a class, of which the first stands for all: the
others are repeated from end to end. Where a fingerprint has more than one class, the classes' first places are extended to the left
and right of it, window by window. So a large group of copies is one class, and no pairs are made.

A word goes if it stands in a window of ``run_words`` words that also begins earlier, by doc_id (null last), hash of the text and
place. The first place of every window keeps the words that no other window takes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimpse.llm.common import SPACED, Words, _powers, byte_column, free_name, mix, pieces, stage, text_batches


def run_hashes(words: Words):
    """A function that hashes words [a, b) of ``words``, for arrays of bounds."""
    up, down = _powers(len(words.hash) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words.hash * up[: len(words.hash)])])
    return lambda a, b: mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Where the first of the least values stands in each window of ``width``; windows double until they are wide enough."""
    at, size = np.arange(len(values)), 1
    while size < width:
        k = min(size, width - size)
        a, b = values[:-k], values[k:]
        at, values, size = np.where(b < a, at[k:], at[:-k]), np.minimum(a, b), size + k
    return at


def fingerprint_spans(words: Words, gram_words: int, run_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word, word after the last, fingerprint and hash of the spans of all texts."""
    hashed, n, width = run_hashes(words), len(words.hash), run_words - gram_words + 1
    if n < run_words:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    i = np.arange(n - gram_words + 1)
    grams = hashed(i, i + gram_words)
    w = np.arange(n - run_words + 1)  # windows of run_words words
    at = least(grams, width)
    w = w[words.doc[w] == words.doc[w + run_words - 1]]
    at = at[w]
    new = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(w, prepend=-2) != 1))
    lo, hi = w[new], w[np.append(new[1:], len(w)) - 1] + run_words
    first = words.first[words.doc[lo]]
    return words.doc[lo], lo - first, hi - first, grams[at[new]].view(np.int64), hashed(lo, hi).view(np.int64)


def without(text: bytes, gone: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """``text`` without words [from, to) of each of ``gone``, and how many lines and words went.

    Lines of which nothing is left go with their ends; of other lines, words and the white space beside them go, but no line end.
    """
    w = Words([text], SPACED)
    n = len(w.start)
    out = np.zeros(n + 1, np.int32)
    for a, z in gone:
        out[a] += 1
        out[z] -= 1
    out = np.cumsum(out)[:n] > 0
    step = np.diff(out.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    keep, lines = np.ones(len(text), bool), 0
    for a, z in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True):
        before, lo = (int(w.end[a - 1]) if a else 0), int(w.start[a])
        hi, after = int(w.end[z - 1]), (int(w.start[z]) if z < n else len(text))
        line = text.rfind(b"\n", before, lo) + 1  # where the run's line begins, if it begins with the run
        begins, end = bool(line) or not a, text.find(b"\n", hi, after)
        ends = end >= 0 or z == n
        inside = text.count(b"\n", lo, hi)
        if begins and ends:
            cut = (line, end + 1) if end >= 0 else (max(0, line - 1), len(text))
            lines += inside + 1
        elif begins:
            cut = (line or before, after)
            lines += inside
        elif ends:
            cut = (before, end if end >= 0 else len(text))
            lines += inside
        else:
            cut = (lo, after)
            lines += max(0, inside + text.count(b"\n", hi, after) - 1)
        keep[cut[0] : cut[1]] = False
        if not begins and not ends and inside:
            keep[text.rfind(b"\n", lo, hi)] = True
    return np.frombuffer(text, np.uint8)[keep].tobytes(), lines, int(out.sum())


def repeated(docs: DataFrame, gram_words: int = 16, run_words: int = 50) -> DataFrame:
    """__id, __text (hash), from, to: words [from, to) of documents, each repeating words of an earlier place. Rows equal in id and text are one document.

    Words are runs of anything but white space, compared with A-Z lower-cased by 64-bit hashes.
    """
    if not 0 < gram_words <= run_words:
        raise ValueError("gram_words must be from 1 to run_words")

    def spans(batches):
        import pyarrow as pa

        for b in batches:
            texts = byte_column(b, "text")
            for i, j in pieces(texts):
                doc, lo, hi, gram, whole = fingerprint_spans(Words(texts[i:j], SPACED), gram_words, run_words)
                of = pa.array(doc + i)
                cols = [b.column("__id").take(of), b.column("__text").take(of), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(gram), pa.array(whole)]
                yield pa.RecordBatch.from_arrays(cols, names=["__id", "__text", "from", "to", "gram", "whole"])

    def windows(batches):
        """All windows of the spans asked for."""
        import pyarrow as pa

        for b in batches:
            texts, asked = byte_column(b, "text"), b.column("spans").to_pylist()
            for i, j in pieces(texts):
                w = Words(texts[i:j], SPACED)
                hashed = run_hashes(w)
                s = np.array([(d, x["from"], x["to"]) for d, a in enumerate(asked[i:j]) for x in a], np.int64).reshape(-1, 3)
                n = s[:, 2] - s[:, 1] - run_words + 1
                at = np.repeat(s[:, 1] - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(n.sum())
                doc = np.repeat(s[:, 0], n)
                h = hashed(at + w.first[doc], at + w.first[doc] + run_words).view(np.int64)
                of = pa.array(doc + i)
                yield pa.RecordBatch.from_arrays([b.column("__id").take(of), b.column("__text").take(of), pa.array(at.astype(np.int32)), pa.array(h)], names=["__id", "__text", "from", "window"])

    def later(places: DataFrame, first: DataFrame, key: list[str]) -> DataFrame:
        return places.hint("merge").join(first, key).where(place != F.col("f")).select("__id", "__text", "from", "to")

    place = F.struct(F.col("__id").isNull().alias("n"), "__id", "__text", "from")
    d = text_batches(docs).select(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__text"), "text")
    kind = d.schema["__id"].dataType.simpleString()
    p = stage(d.mapInArrow(spans, f"__id {kind}, __text long, from int, to int, gram long, whole long"), "spans", "zstd")
    # the first place of each class, of fingerprints with more than one place: the others take no further part
    classes = p.groupBy("gram", "whole").agg(F.min(F.struct(*place_fields(), "to")).alias("f"), F.count("*").alias("n"))
    several = p.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram")
    classes = stage(classes.hint("merge").join(several, "gram"), "classes", "zstd")
    in_whole = later(p, classes.where("n > 1").select("gram", "whole", F.col("f").dropFields("to").alias("f")), ["gram", "whole"])
    apart = classes.groupBy("gram").agg(F.count("*").alias("k")).where("k > 1").select("gram")
    ask = classes.join(apart, "gram").select(F.col("f.__id").alias("of_id"), F.col("f.__text").alias("of_text"), F.struct("f.from", "f.to").alias("s"))
    ask = ask.groupBy("of_id", "of_text").agg(F.collect_list("s").alias("spans"))
    once = d.hint("merge").join(ask, F.col("__id").eqNullSafe(F.col("of_id")) & (F.col("__text") == F.col("of_text")))
    w = stage(once.select("__id", "__text", "text", "spans").mapInArrow(windows, f"__id {kind}, __text long, from int, window long"), "windows", "zstd")
    w = w.withColumn("to", F.col("from") + run_words)
    first = w.groupBy("window").agg(F.min(place).alias("f"), F.count("*").alias("n")).where("n > 1").select("window", "f")
    return in_whole.unionByName(later(w, first, ["window"]))


def place_fields() -> list:
    return [F.col("__id").isNull().alias("n"), F.col("__id"), F.col("__text"), F.col("from")]


def dedup_passages(docs: DataFrame, counts: bool = False, gram_words: int = 16, run_words: int = 50) -> DataFrame:
    """``docs`` without the words of later repeated passages; other columns stay.

    ``counts`` adds n_lines, n_deleted (lines) and n_words_deleted, with a trailing underscore where ``docs`` has such a column. Null
    texts stay null with no lines; an empty text is one empty line; texts of fewer than ``run_words`` words stay as they are.
    """
    g = repeated(docs, gram_words, run_words)
    g = stage(g.groupBy("__id", "__text").agg(F.sort_array(F.collect_set(F.struct("from", "to"))).alias("gone")), "passages", "zstd")

    @F.pandas_udf("text string, lines int, words int")
    def cut(text: pd.Series, gone: pd.Series) -> pd.DataFrame:
        rows = []
        for t, g in zip(text, gone, strict=True):
            if g is None or t is None:
                rows.append((t, 0, 0))
            else:
                new, lines, words = without(t.encode("utf-8", "surrogatepass"), [(x["from"], x["to"]) for x in g])
                rows.append((new.decode("utf-8", "replace"), lines, words))
        return pd.DataFrame(rows, columns=["text", "lines", "words"])

    # The rest of a row goes in a struct, so that no column of it meets one of ours.
    others = F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c.lower() != "text"])
    d = text_batches(docs).select(F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_text"), "text", others.alias("row"))
    d = d.hint("merge").join(g, F.col("own_id").eqNullSafe(F.col("__id")) & (F.col("own_text") == F.col("__text")), "left").select("text", "row", "gone")
    d = d.withColumn("new", cut("text", "gone"))
    out = [F.col("new.text").alias(c) if c.lower() == "text" else F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(docs.columns)]
    if counts:
        n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1))).cast("long")
        out += [n_lines.alias(free_name(docs, "n_lines")), F.col("new.lines").cast("long").alias(free_name(docs, "n_deleted")), F.col("new.words").cast("long").alias(free_name(docs, "n_words_deleted"))]
    return d.select(*out)
