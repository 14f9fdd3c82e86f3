"""Spelling variants: the words of all texts, which of them are one edit apart, and the form that a rare one stands for.

Words one edit apart share all before the edit and all behind it. Each length is cut into parts; words that agree before and behind one part
are a group, whose words stand as rows of padded code-point matrices, and blocks of rows are compared with blocks of rows: a pair is one
edit apart where common prefix and common suffix reach the longer length minus one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glimpse.llm.common import folders, stage

#: Runs of letters as they are taken from texts; no letter needs more than 8 bits.
LETTERS = "A-Za-z\\u00C0-\\u00FF"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, least: int = 7, times: int = 2, one_in: int = 31) -> DataFrame:
    """word, n: words of ``least`` letters and more with ``times`` occurrences and more in all texts, A-Z lower-cased.

    Of a run whose crc32 with its document's id is divisible by ``one_in`` one letter, by that number, is left out. A null text has no words,
    a null id is empty text. Occurrences are counted where they are read before they travel, so a common word is no burden.
    """
    runs = F.explode(F.regexp_extract_all(F.col("text"), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0)))
    r = docs.select("doc_id", runs.alias("run")).select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))
    r = r.withColumn("h", F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % one_in == 0, less).otherwise(F.col("run"))
    return r.select(word.alias("word")).where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= times)


def part_start(i: int, longer: Column, parts: int) -> Column:
    return F.floor(longer * i / parts).cast("int")


def grouped(words: DataFrame, parts: int) -> DataFrame:
    """key, longer, part, word, n: a word once for each part of its own length and of the next, as the shorter of a pair."""
    k = F.length("word")
    sides = F.explode(F.array(*[F.struct(longer.alias("longer"), F.lit(i).alias("part"), part_start(i, longer, parts).alias("head"), (longer - part_start(i + 1, longer, parts)).alias("tail")) for longer in (k, k + 1) for i in range(parts)]))
    w = words.select("word", "n", sides.alias("s")).select("word", "n", "s.*").where(F.col("head") + F.col("tail") < F.col("longer"))
    rest = F.concat(F.substring("word", F.lit(1), F.col("head")), F.lit(" "), F.substring("word", F.length("word") - F.col("tail") + 1, F.col("tail")))
    return w.select(F.xxhash64("longer", "part", rest).alias("key"), "longer", "part", "word", "n")


def tiles(rows: DataFrame, block: int) -> DataFrame:
    """``rows`` of groups with two words or more, with the pair of blocks (``a``, ``b``) that they are compared in.

    Larger groups are cut into blocks of about ``block`` words, fewer where they are long; each block meets itself and every other once, in a tile of its own.
    """
    size = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    most = F.greatest(F.lit(16), F.least(F.lit(block), F.floor(F.lit(block * 4096) / F.col("longer"))))
    r = rows.join(size, "key").withColumn("blocks", F.ceil(F.col("size") / most))
    own = F.pmod(F.xxhash64("word"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    r = r.withColumn("own", own).withColumn("other", other)
    return r.select("key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "longer", "part", "word", "n")


def matrices(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of words as rows, padded behind and before, and the words' lengths."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    width = int(size.max())
    ahead = np.array(words, dtype=f"S{width}").view(np.uint8).reshape(len(words), width)
    back = np.array([w.rjust(width, b"\0") for w in words], dtype=f"S{width}").view(np.uint8).reshape(len(words), width)
    return ahead, back, size


def one_edit(x: np.ndarray, y: np.ndarray, ahead: np.ndarray, back: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether words of rows ``x`` and ``y`` are one edit apart, and where their common prefix ends."""
    width = ahead.shape[1]
    differ = ahead[x] != ahead[y]
    prefix = np.where(differ.any(1), differ.argmax(1), width)
    differ = back[x] != back[y]
    suffix = np.where(differ.any(1), differ[:, ::-1].argmax(1), width)
    longer, shorter = np.maximum(size[x], size[y]), np.minimum(size[x], size[y])
    return (longer - shorter <= 1) & (prefix + suffix >= longer - 1) & (prefix < longer), prefix


def pairs_of_tiles(tile: np.ndarray, own: np.ndarray, cross: np.ndarray, step: int):
    """Rows (x, y) of the same tile, ``step`` apart and so on, as long as tiles last; in a tile of two blocks only pairs across."""
    end = np.searchsorted(tile, tile, side="right")
    x = np.arange(len(tile))
    for offset in range(1, len(tile)):
        x = x[x + offset < end[x]]
        if not len(x):
            return
        for i in range(0, len(x), step):
            p = x[i : i + step]
            q = p + offset
            keep = ~cross[p] | (own[p] != own[q])
            yield p[keep], q[keep]


def whole_tiles(batches, rows: int):
    """Tables of some ``rows`` rows each that end with a tile, of sorted batches; with ``tile`` (a number) and ``cross`` (of two blocks)."""
    import pyarrow as pa

    def told(table):
        key, a, b = (table.column(c).to_numpy() for c in ("key", "a", "b"))
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        return table.append_column("tile", pa.array(np.cumsum(new))).append_column("cross", pa.array(a != b))

    held, count = [], 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            table = pa.Table.from_batches(held).combine_chunks()
            full = told(table)
            tile = full.column("tile").to_numpy()
            whole = int(np.searchsorted(tile, tile[-1]))  # the last tile may go on
            if whole:
                yield full.slice(0, whole)
            held, count = table.slice(whole).to_batches(), count - whole
    if count:
        yield told(pa.Table.from_batches(held).combine_chunks())


def near(words: DataFrame, parts: int = 4, block: int = 1024, rows: int = 16384) -> DataFrame:
    """word, n_near, best (n, word): how many of ``words`` (word, n) are one edit away from a word, and the one with the largest n, the first of equals.

    A pair is met in the group of each part beside its edit, and counted in that where its common prefix ends.
    """
    t = tiles(grouped(words, parts), block)
    t = t.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")
    schema = "word string, n_near long, best_n long, best string"

    def compared(table):
        """Whole tiles of words of about one length."""
        import pyarrow as pa

        tile, own, longer, part, n = (table.column(c).to_numpy() for c in ("tile", "own", "longer", "part", "n"))
        words = table.column("word").to_pylist()
        ahead, back, size = matrices([w.encode("latin-1") for w in words])
        lo, hi = longer * part // parts, longer * (part + 1) // parts
        order = np.lexsort((ahead.view(f"S{ahead.shape[1]}")[:, 0], -n))  # largest n first, then by code point
        place = np.empty(len(n), np.int64)
        place[order] = np.arange(len(n))
        count, best = np.zeros(len(n), np.int64), np.full(len(n), len(n))
        for x, y in pairs_of_tiles(tile, own, table.column("cross").to_numpy(zero_copy_only=False), max(1, (4 << 20) // ahead.shape[1])):
            ok, prefix = one_edit(x, y, ahead, back, size)
            ok &= (np.maximum(size[x], size[y]) == longer[x]) & (prefix >= lo[x]) & (prefix < hi[x])
            x, y = x[ok], y[ok]
            for p, q in ((x, y), (y, x)):
                np.add.at(count, p, 1)
                np.minimum.at(best, p, place[q])
        has = np.flatnonzero(count)
        who = order[best[has]]
        return pa.RecordBatch.from_arrays([pa.array([words[i] for i in has], pa.string()), pa.array(count[has]), pa.array(n[who]), pa.array([words[i] for i in who], pa.string())], names=["word", "n_near", "best_n", "best"])

    def run(batches):
        import pyarrow as pa

        for table in whole_tiles(batches, rows):
            width = np.frexp(table.column("longer").to_numpy())[1]  # by powers of two, so that no long word pads short ones
            for k in np.unique(width):
                some = table.filter(pa.array(width == k))
                tile = some.column("tile").to_numpy()
                at, most = 0, max(1, (32 << 20) >> int(k))
                while at < len(tile):
                    to = len(tile) if at + most >= len(tile) else max(int(np.searchsorted(tile, tile[at + most])), int(np.searchsorted(tile, tile[at], side="right")))
                    yield compared(some.slice(at, to - at))
                    at = to

    found = t.mapInArrow(run, schema)
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("word"))).alias("b")).select("word", "n_near", F.struct((-F.col("b.m")).alias("n"), F.col("b.word").alias("word")).alias("best"))


def rooted(forms: DataFrame) -> DataFrame:
    """word, form, form_n, root of ``forms`` (word, form, form_n): the end of each chain of forms.

    A form has ten times its word's occurrences, so chains are no longer than the digits of the largest number; each round doubles the way.
    """
    put, rounds = folders(forms.sparkSession, "variants-roots"), 0
    most = forms.agg(F.max("form_n")).first()[0] or 0
    steps = max(1, len(str(most)))
    r = put(forms.withColumn("root", F.col("form")))
    while (1 << rounds) < steps:
        on = r.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        r = put(r.join(on, F.col("root") == F.col("_w"), "left").withColumn("root", F.coalesce("_r", "root")).drop("_w", "_r"))
        rounds += 1
    return r


def variants(docs: DataFrame, least: int = 7, times: int = 2, ratio: int = 10, parts: int = 4, block: int = 1024) -> DataFrame:
    """word, form, root, n, n_near, form_n, for each word of ``vocabulary``.

    form: of the words one edit away the one with the largest n (the first by code point of equals), if it is ``ratio`` times the word's
    own or more; root: the end of the chain of forms, the word itself without any. An empty table, or null and empty texts alone, have no rows; repeated
    rows count each; words of any length take part.
    """
    words = stage(vocabulary(docs, least, times), "variants-words")
    w = words.join(near(words, parts, block), "word", "left").withColumn("has", F.coalesce(F.col("best.n") >= ratio * F.col("n"), F.lit(False)))
    w = stage(w.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("has"), F.col("best.word")).alias("form"), F.when(F.col("has"), F.col("best.n")).alias("form_n")), "variants-near")
    roots = rooted(w.where("form is not null").select("word", "form", "form_n")).select("word", "root")
    return w.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
