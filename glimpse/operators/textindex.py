"""A stored index of texts: words and letter triples to documents, kept up by segments, and searched without cutting texts again.

A folder holds, segment by segment, ``docs`` (a row a document, its words and its prepared text), ``postings`` and ``grams`` (a row a word or
letter triple and document, in buckets, sorted by word), ``terms`` (how many documents more or fewer have a word) and ``totals``. A later segment's
document takes the place of earlier ones; one without words' count is a deletion. Sums over segments are the frequencies of what is alive.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glimpse.functions.text import bare_words, strip, strip_accents
from glimpse.sources.readers import staged

KEY = ["video_id", "frame_id"]
#: So many different words of a table of queries are pushed down to the files; more are met by their buckets and a join.
PUSHED = 1000
#: Up to so many documents for each one asked for, scoring all that share a word costs less than bounds (10,000 documents: 12 s against 28 s for 200 queries of 10).
FEW = 2000
#: Words of queries that all tasks of a scan get whole, cells of documents and queries that a task holds at a time, and rows of postings below which bounds are tried in any case.
TOKENS = 200_000
CELLS = 1 << 19
SCAN = 1_000_000


@dataclass(frozen=True)
class TextIndex:
    """The ``segments`` of an index at ``path``. One job at a time writes; a segment is there when its totals are, which come last."""

    spark: SparkSession
    path: str
    buckets: int
    kinds: tuple[str, ...]
    segments: tuple[int, ...]

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(f"{schema}, segment int").parquet(f"{self.path}/{name}").where(F.col("segment").isin(list(self.segments)))

    def _alive(self, rows: DataFrame) -> DataFrame:
        """Rows (key, segment) of documents that no later segment replaces."""
        if len(self.segments) == 1:
            return rows
        later = self._docs().where("segment > 0").groupBy(*KEY).agg(F.max("segment").alias("_last"))
        later = later.select(*[F.col(c).alias(f"_{c}") for c in KEY], "_last")
        same = (F.col("video_id") == F.col("_video_id")) & (F.col("frame_id") == F.col("_frame_id")) & (F.col("segment") < F.col("_last"))
        return rows.join(later, same, "left_anti")

    def _docs(self) -> DataFrame:
        return self._read("docs", "video_id string, frame_id long, n long, w array<string>, d string, da string")

    def docs(self) -> DataFrame:
        """video_id, frame_id, n (words), w (the words), d (lower case, no outer white space), da (without accents)."""
        return self._alive(self._docs()).where("n is not null").drop("segment")

    def postings(self, tokens: DataFrame | None = None) -> DataFrame:
        """token, video_id, frame_id, n of the words of ``tokens`` (token), or of all."""
        return self._alive(self._wanted(self._read("postings", "token string, video_id string, frame_id long, n long, bucket int"), tokens)).drop("segment", "bucket")

    def grams(self, tokens: DataFrame | None = None) -> DataFrame:
        """token, video_id, frame_id, first (whether the text begins with it) of the letter triples of ``tokens``, or of all."""
        if "triples" not in self.kinds:
            raise ValueError("the index was built without letter triples")
        return self._alive(self._wanted(self._read("grams", "token string, video_id string, frame_id long, first boolean, bucket int"), tokens)).drop("segment", "bucket")

    def frequencies(self, tokens: DataFrame) -> DataFrame:
        """token, df: in how many documents the words of ``tokens`` are."""
        t = self._wanted(self._read("terms", "token string, df long, bucket int"), tokens)
        return t.groupBy("token").agg(F.sum("df").alias("df")).where("df > 0")

    def average(self) -> DataFrame:
        """n_docs, avgdl: one row, from the segments' totals."""
        t = self._read("totals", "n_docs long, n_words long").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_words").alias("n"))
        return t.select("n_docs", (F.col("n") / F.greatest("n_docs", F.lit(1))).alias("avgdl"))

    def _wanted(self, table: DataFrame, tokens: DataFrame | None) -> DataFrame:
        """``table`` with only what may be asked: the buckets of ``tokens`` and, of a few, the words themselves are filters of the scan."""
        if tokens is None:
            return table
        words = tokens.select("token").distinct()
        some = [r[0] for r in words.limit(PUSHED + 1).collect()]
        if len(some) <= PUSHED:
            inside = [r[0] for r in words.select(bucket_of(F.col("token"), self.buckets)).distinct().collect()]  # numbers of buckets
            return table.where(F.col("bucket").isin(inside) & F.col("token").isin(some))
        return table.join(words, "token", "left_semi")


def bucket_of(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def triples(c: Column) -> Column:
    """The distinct letter triples of a text in order; a shorter text is its own."""
    return F.when(F.length(c) < 3, F.array(c)).otherwise(F.array_distinct(F.regexp_extract_all(c, F.lit("(?s)(?=(...))."), F.lit(1))))


def build_index(docs: DataFrame, path: str, buckets: int = 32, kinds: tuple[str, ...] = ("words", "triples")) -> TextIndex:
    """The index of ``docs`` (video_id, frame_id, text; a key once) at ``path``, for searches by words, by letter triples, or both. Null and blank texts have no words."""
    spark = docs.sparkSession
    spark.createDataFrame([(buckets, list(kinds))], "buckets int, kinds array<string>").coalesce(1).write.parquet(f"{path}/settings")
    return _with_segment(TextIndex(spark, path, buckets, tuple(kinds), ()), docs, None)


def open_index(spark: SparkSession, path: str) -> TextIndex:
    segments = spark.read.schema("n_docs long, segment int").parquet(f"{path}/totals").select("segment").distinct().collect()  # a row each
    buckets, kinds = spark.read.parquet(f"{path}/settings").first()
    return TextIndex(spark, path, buckets, tuple(kinds), tuple(sorted(r[0] for r in segments)))


def update_index(index: TextIndex, changed: DataFrame | None = None, deleted: DataFrame | None = None) -> TextIndex:
    """The index with one more segment: ``changed`` (key, text) are new or take the place of old texts, ``deleted`` (key) go. Only these keys' old words are read."""
    none = index.spark.createDataFrame([], "video_id string, frame_id long, text string")
    return _with_segment(index, none if changed is None else changed, none if deleted is None else deleted)


def _with_segment(index: TextIndex, docs: DataFrame, deleted: DataFrame | None) -> TextIndex:
    segment = max(index.segments, default=-1) + 1
    text = F.coalesce("text", F.lit(""))
    low = F.lower(strip(text))
    parts = int(index.spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(*KEY, "text").repartition(parts, *KEY)  # a few large files are cut into words by all
    new = docs.select(*KEY, low.alias("d")).withColumn("da", strip_accents(F.col("d"))).withColumn("w", bare_words(F.col("da")))
    new = new.select(*KEY, F.size("w").cast("long").alias("n"), "w", "d", "da")
    if deleted is not None:
        new = new.unionByName(deleted.select(*KEY).join(docs.select(*KEY), KEY, "left_anti"), allowMissingColumns=True)
    place = f"{index.path}/docs/segment={segment}"
    new.write.mode("overwrite").parquet(place)  # words are cut here alone
    new = index.spark.read.schema(new.schema).parquet(place)
    terms = new.where("n > 0").select(F.explode("w").alias("token"), F.lit(1).cast("long").alias("df"))
    totals = new.where("n > 0").select(F.lit(1).cast("long").alias("n_docs"), F.col("n").alias("n_words"))
    if segment:
        was = index.docs().join(new.select(*KEY), KEY, "left_semi").where("n > 0")
        terms = terms.unionByName(was.select(F.explode("w").alias("token"), F.lit(-1).cast("long").alias("df")))
        totals = totals.unionByName(was.select(F.lit(-1).cast("long").alias("n_docs"), (-F.col("n")).alias("n_words")))

    def put(df: DataFrame, name: str) -> None:
        """In buckets, sorted. Each task writes what it has: documents are dealt by key, so a frequent word's rows are in as many files, and nothing is shuffled."""
        df = df.withColumn("bucket", bucket_of(F.col("token"), index.buckets))
        df.sortWithinPartitions("bucket", "token").write.mode("overwrite").partitionBy("bucket").parquet(f"{index.path}/{name}/segment={segment}")

    if "words" in index.kinds:
        put(new.where("n > 0").select(F.explode("w").alias("token"), *KEY, "n"), "postings")
        put(terms.groupBy("token").agg(F.sum("df").alias("df")).where("df != 0"), "terms")
    if "triples" in index.kinds:
        grams = new.where("d != ''").select(F.posexplode(triples(F.col("da"))).alias("i", "token"), *KEY)
        put(grams.select("token", *KEY, (F.col("i") == 0).alias("first")), "grams")
    totals = totals.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n_docs"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("n_words"))
    totals.write.mode("overwrite").parquet(f"{index.path}/totals/segment={segment}")
    return replace(index, segments=(*index.segments, segment))


def with_frequencies(tokens: DataFrame, index: TextIndex) -> DataFrame:
    """``tokens`` (query_id, token, ...) that the index has, with df and idf."""
    f = index.frequencies(tokens).crossJoin(F.broadcast(index.average().select("n_docs")))  # one row
    f = f.select("token", "df", F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))
    return tokens.join(f, "token")


def length_factor(n: Column, avgdl: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    """What a word's idf counts in a document of ``n`` words, at term frequency 1."""
    return (k1 + 1) / (1 + k1 * (1 - b + b * n / F.greatest(avgdl, F.lit(1.0))))


def scan_pays(words: DataFrame, index: TextIndex) -> bool:
    """Whether the postings of all words (query_id, token, df) of queries, each as often as queries have it, are more than the whole index."""
    n, rows = words.agg(F.count("*"), F.coalesce(F.sum("df"), F.lit(0))).first()
    n_words = index.average().select(F.col("n_docs") * F.col("avgdl")).first()[0] or 0
    return n <= TOKENS and rows >= max(n_words, SCAN)


def scanned(words: DataFrame, docs: DataFrame, k: int, score, look=None, slack: float = 1e-5) -> DataFrame:
    """query_id, key, n, idf (sum), shared of all documents (key, n, w: their words) that can be among a query's first ``k``.

    ``words`` (query_id, token, idf and columns of the query; none repeats, at most ``TOKENS``) go to the tasks, where they meet each Arrow batch of documents.
    A task sends on its own best ``k`` a query by ``score(idf, shared, n, q)``, ``q`` the query's columns, and all that come as near to the last as ``slack``;
    pairs of which ``look(shared, n, q)`` holds go on in any case and count for none. Documents aren't shuffled, and no pair is a row before it is sent on.
    """
    about = [c for c in words.columns if c not in ("query_id", "token", "df", "idf")]
    stated = words.select("query_id", "token", "idf", *about).collect()  # bounded
    kinds = [f"query_id {words.schema['query_id'].dataType.simpleString()}", *(f"{c} {docs.schema[c].dataType.simpleString()}" for c in KEY)]
    schema = f"{', '.join(kinds)}, n long, idf double, shared long"
    ids = list(dict.fromkeys(r[0] for r in stated))
    tokens = list(dict.fromkeys(r[1] for r in stated))
    at_query, at_token = ({x: i for i, x in enumerate(xs)} for xs in (ids, tokens))
    which = np.array([at_token[r[1]] for r in stated], np.int64)
    order = np.argsort(which, kind="stable")
    asker, weight = np.array([at_query[r[0]] for r in stated], np.int64)[order], np.array([r[2] for r in stated], float)[order]
    askers = np.bincount(which, minlength=len(tokens))
    begin = np.cumsum(askers) - askers
    one = {r[0]: r for r in stated}
    of = {c: np.array([one[i][3 + j] for i in ids]) for j, c in enumerate(about)}

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        known = pa.array(tokens, pa.string())
        floor, keys = np.full(len(ids), -np.inf), []
        held: list = []  # parts of (query, score, idf, shared, n, block, row)
        total, most = 0, 2 * k * len(ids) + 100_000

        def best():
            """The ``k`` best of each query of what is held, and all that are nearly as good as the last."""
            parts = [np.concatenate(x) for x in zip(*held, strict=True)]
            who, s = parts[:2]
            order = np.lexsort((-s, who))
            first, count = np.searchsorted(who[order], np.arange(len(ids)), side="left"), np.bincount(who, minlength=len(ids))
            full = np.flatnonzero(count >= k)
            floor[full] = s[order[first[full] + k - 1]]
            keep = s >= floor[who] - slack
            return tuple(x[keep] for x in parts)

        def rows(key, who, row, n, idf, shared):
            return pa.RecordBatch.from_arrays([pa.array([ids[i] for i in who]), *key.take(pa.array(row)).columns, pa.array(n), pa.array(idf), pa.array(shared)], names=["query_id", *KEY, "n", "idf", "shared"])

        step = max(1, CELLS // max(1, len(ids)))
        for b in (whole.slice(a, step) for whole in batches for a in range(0, whole.num_rows, step)):
            key, w, size = b.select(list(KEY)), b.column("w"), b.column("n").to_numpy()
            token = pc.fill_null(pc.index_in(w.flatten(), value_set=known), -1).to_numpy()
            doc = np.repeat(np.arange(len(size)), pc.list_value_length(w).to_numpy())[token >= 0]
            token = token[token >= 0]
            many = askers[token]
            place = np.repeat(begin[token] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            cell = np.repeat(doc * len(ids), many) + asker[place]
            every = np.bincount(cell, minlength=len(size) * len(ids))
            idf = np.bincount(cell, weights=weight[place], minlength=len(size) * len(ids))
            cell = np.flatnonzero(every)
            row, who = np.divmod(cell, len(ids))
            idf, shared, n = idf[cell], every[cell], size[row]
            q = {c: x[who] for c, x in of.items()}
            s = score(idf, shared, n, q)
            always = look(shared, n, q) if look else np.zeros(len(cell), bool)
            if always.any():
                yield rows(key, who[always], row[always], n[always], idf[always], shared[always])
            m = ~always & (s >= floor[who] - slack)
            keys.append(key)
            held.append((who[m], s[m], idf[m], shared[m], n[m], np.full(m.sum(), len(keys) - 1), row[m]))
            total += m.sum()
            if total > most:
                held = [best()]
                total = len(held[0][0])
                most = 2 * total + 100_000
        if held:
            who, _, idf, shared, n, block, row = best()
            order = np.argsort(block, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
                if len(at):
                    yield rows(keys[block[at[0]]], who[at], row[at], n[at], idf[at], shared[at])

    return docs.select(*KEY, F.col("n").cast("long").alias("n"), "w").mapInArrow(run, schema)


def bounded_pairs(words: DataFrame, index: TextIndex, k: int, score, bound, maybe=None, ahead: int = 4, few: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(pairs, looked): query_id, key, n, idf (sum), shared of all documents that can be among a query's first ``k``, and how many pairs were looked at.

    ``words``: query_id, token, df, idf, n_query and columns of the query; none repeats. A query's rare words come first: their documents, completed
    from the stored words, give a score that ``k`` documents reach. What frequent words alone can give at most is then compared with it: words that
    can't lift a document so far are looked up only in documents that rarer words have found, and only if these can still reach it.

    ``score(idf, shared, n)`` is a lower bound of a document's final score, ``bound(idf, shared, n)`` an upper one, n null for the shortest document.
    ``maybe(n, left)``, if given, tells which documents of frequent words (``left`` of them) are looked at in any case, by their length.
    Of an index with at most ``few`` (``FEW``) times ``k`` documents all pairs are looked at, as bounds would cost more than they save.
    """
    if (index.average().first()["n_docs"] or 0) <= (FEW if few is None else few) * k:
        pairs = index.postings(words).join(words.select("query_id", "token", "idf"), "token").groupBy("query_id", *KEY, "n").agg(F.sum("idf").alias("idf"), F.count("*").alias("shared"))
        return pairs, pairs.groupBy("query_id").agg(F.count("*").alias("n_pairs"))
    w = Window.partitionBy("query_id").orderBy("df", "token")
    q = words.withColumn("seen", F.coalesce(F.sum("df").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    q = q.withColumn("rest_idf", F.sum("idf").over(w.rowsBetween(0, Window.unboundedFollowing))).withColumn("rest", F.count("*").over(w.rowsBetween(0, Window.unboundedFollowing)))
    q = staged(q.withColumn("first", F.col("seen") < ahead * k), "asked")
    about = [c for c in words.columns if c not in ("token", "df", "idf")]
    every = q.groupBy(*about).agg(F.collect_list(F.struct("token", "idf")).alias("all"))
    docs = index.docs().select(*KEY, "w")
    postings = index.postings(q)

    def found(some: DataFrame) -> DataFrame:
        return postings.join(some.select("query_id", "token", "idf"), "token").groupBy("query_id", *KEY, "n").agg(F.sum("idf").alias("idf"), F.count("*").alias("shared"))

    def completed(pairs: DataFrame, listed: DataFrame, column: str) -> DataFrame:
        """``pairs`` with the words of ``column`` that their documents have added to idf and shared."""
        j = pairs.join(listed, "query_id").join(docs, KEY)
        has = F.array_intersect("w", F.transform(column, lambda x: x["token"]))
        j = j.withColumn("has", has).withColumn("more", F.aggregate(F.filter(column, lambda x: F.array_contains("has", x["token"])), F.lit(0.0), lambda s, x: s + x["idf"]))
        return j.withColumn("idf", F.col("idf") + F.col("more")).withColumn("shared", F.col("shared") + F.size("has")).drop("w", "has", "more", column)

    start = found(q.where("first"))
    start = start.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("idf"), *KEY))).where(F.col("r") <= k)
    start = completed(start.select("query_id", *KEY, "n", F.lit(0.0).alias("idf"), F.lit(0).cast("long").alias("shared")), every, "all")
    reached = start.groupBy("query_id").agg(F.count("*").alias("c"), F.min(score(F.col("idf"), F.col("shared"), F.col("n"))).alias("least"))
    reached = reached.select("query_id", F.when(F.col("c") >= k, F.col("least")).alias("least"))
    none = F.lit(None).cast("long")
    can = bound(F.col("rest_idf"), F.col("rest"), none) >= F.col("least")
    q = staged(q.join(reached, "query_id", "left").withColumn("rare", F.col("least").isNull() | can), "rated")
    frequent = q.where("not rare").groupBy("query_id").agg(F.collect_list(F.struct("token", "idf")).alias("others"), F.sum("idf").alias("left_idf"), F.count("*").alias("left_n"))
    by_query = q.groupBy(*about, "least").agg(F.count("*").alias("_n")).drop("_n").join(frequent, "query_id", "left").na.fill(0, ["left_n"]).na.fill(0.0, ["left_idf"])
    by_query = by_query.withColumn("others", F.coalesce("others", F.array().cast("array<struct<token:string,idf:double>>")))
    pairs = found(q.where("rare"))
    if maybe is not None:
        left = q.where("not rare").join(frequent.select("query_id", "left_n"), "query_id")
        short = postings.join(left, "token").where(maybe(F.col("n"), F.col("left_n"))).select("query_id", *KEY, "n", F.lit(0.0).alias("idf"), F.lit(0).cast("long").alias("shared"))
        pairs = pairs.unionByName(short).groupBy("query_id", *KEY, "n").agg(F.sum("idf").alias("idf"), F.sum("shared").alias("shared"))
    pairs = staged(pairs, "pairs")
    looked = pairs.groupBy("query_id").agg(F.count("*").alias("n_pairs"))
    p = pairs.join(by_query, "query_id")
    p = p.where(F.col("least").isNull() | (bound(F.col("idf") + F.col("left_idf"), F.col("shared") + F.col("left_n"), F.col("n")) >= F.col("least")))
    whole = p.where("left_n = 0").select("query_id", *KEY, "n", "idf", "shared")
    rest = completed(p.where("left_n > 0").select("query_id", *KEY, "n", "idf", "shared"), by_query.where("left_n > 0").select("query_id", "others"), "others")
    return whole.unionByName(rest.select("query_id", *KEY, "n", "idf", "shared")), looked


def bm25_top(tokens: DataFrame, index: TextIndex, k: int = 10, **how) -> tuple[DataFrame, DataFrame]:
    """(hits, looked): query_id, key, score, rank, the first ``k`` of each query by BM25 with a term frequency of 1, ties by key; and pairs looked at.

    ``tokens``: query_id, token, none repeated. Equal to ranking all scores. A word counts at most ``idf * 2.2 / 1.3``, in a document without length.
    Where the queries' postings are more than the whole index, all documents' words are read once instead, and all are looked at.
    """
    avg = index.average().first()["avgdl"] or 1.0
    factor = lambda n: length_factor(F.coalesce(n, F.lit(0)), F.lit(float(avg)))
    s = lambda idf, shared, n: F.round(idf * factor(n), 6)
    words = with_frequencies(tokens, index)
    if scan_pays(words, index):
        words = staged(words, "asked")
        pairs = scanned(words.drop("df"), index.docs().where("n > 0"), k, lambda idf, shared, n, q: idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * n / max(avg, 1.0))))
        looked = words.groupBy("query_id").agg(F.lit(index.average().first()["n_docs"]).alias("n_pairs"))
    else:
        pairs, looked = bounded_pairs(words.withColumn("n_query", F.lit(0)), index, k, s, s, **how)
    hits = pairs.select("query_id", *KEY, s(F.col("idf"), None, F.col("n")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), *KEY))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k), looked


def containing(asked: DataFrame, index: TextIndex) -> DataFrame:
    """query_id, key of documents whose prepared text holds that of a query (query_id, qa): by the query's rarest letter triple, then looked at.

    A text of one or two letters is looked for in all triples that hold it.
    """
    long = asked.where(F.length("qa") >= 3).select("query_id", F.explode(triples(F.col("qa"))).alias("token"))
    rows = index.grams(long)
    counted = long.join(rows.groupBy("token").agg(F.count("*").alias("df")), "token", "left").na.fill(0, ["df"])
    rare = counted.groupBy("query_id").agg(F.min_by("token", F.struct("df", "token")).alias("token"))
    brief = asked.where(F.length("qa").between(1, 2)).select("query_id", "qa")
    kinds = index.grams().select("token").distinct()  # letter triples that exist: their number is the alphabet's, not the texts'
    brief = brief.join(kinds, F.contains("token", "qa")).select("query_id", "token")
    found = rows.join(rare, "token").select("query_id", *KEY).unionByName(index.grams(brief).join(brief, "token").select("query_id", *KEY).distinct())
    seen = found.join(asked.select("query_id", "qa"), "query_id").join(index.docs().select(*KEY, "da"), KEY)
    return seen.where(F.contains("da", "qa")).select("query_id", *KEY)


def contained(asked: DataFrame, index: TextIndex) -> DataFrame:
    """query_id, key of documents of three letters or more whose prepared text is part of that of a query (query_id, qa): by the document's first triple."""
    grams = asked.select("query_id", F.explode(triples(F.col("qa"))).alias("token"))
    found = index.grams(grams).where("first").join(grams, "token").join(asked.select("query_id", "qa"), "query_id").join(index.docs().select(*KEY, "da"), KEY)
    return found.where((F.length("da") >= 3) & F.contains("qa", "da")).select("query_id", *KEY)


def letters(c: Column) -> Column:
    """A text's letters, each with how often it has come before, so that texts share as many as their counts allow; the often repeated first."""
    each = F.array_sort(F.filter(F.split(c, ""), lambda x: x != ""))
    counted = F.transform(each, lambda x, i: F.struct((F.array_position(each, x) - 1 - i).alias("less"), x.alias("letter")))
    return F.transform(F.array_sort(counted), lambda x: F.concat(x["letter"], (-x["less"]).cast("string")))


def alike(asked: DataFrame, index: TextIndex, ratio: float = 0.65) -> DataFrame:
    """query_id, qa, da of different prepared texts whose letters' counts allow a matching ratio of ``ratio`` with a query (query_id, qa), three letters each at least.

    The ratio is twice the matched letters over both lengths, so texts share ``ratio`` of their mean length in counts of letters, and lengths differ
    by a bounded factor. Of so many shared ones some are among the first letters of both sides, which alone are joined; then all counts are compared.
    """
    factor = ratio / (2 - ratio)  # of the lengths, at least

    def ahead(df: DataFrame, c: str) -> DataFrame:
        """The letters of which an alike text must share one."""
        n = F.length(c)
        least = F.ceil(ratio * (n + F.ceil(factor * n - 1e-9)) / 2 - 1e-9)
        return df.withColumn("letters", letters(F.col(c))).withColumn("token", F.explode(F.slice("letters", F.lit(1), (n - least + 1).cast("int"))))

    q = asked.where(F.length("qa") >= 3).select("query_id", "qa")
    span = q.agg(F.floor(F.min(F.length("qa")) * factor).alias("lo"), F.ceil(F.max(F.length("qa")) / factor).alias("hi")).first()
    if span["lo"] is None:
        return q.select("query_id", "qa", F.lit("").alias("da")).limit(0)
    d = index.docs().where(F.length("da").between(max(3, span["lo"]), span["hi"])).select("da").distinct()  # however many documents have a text
    both = ahead(q, "qa").join(ahead(d, "da").withColumnRenamed("letters", "theirs"), "token")
    total = F.length("qa") + F.length("da")
    both = both.where(2 * F.least(F.length("qa"), F.length("da")) >= ratio * total - 1e-9).where(2 * F.size(F.array_intersect("letters", "theirs")) >= ratio * total - 1e-9)
    return both.select("query_id", "qa", "da").distinct()
