"""Fusing, ranking again, and chains of events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glimpse.functions.querylog import decompose, environment, route, select_model
from glimpse.operators.search import KEY, knn_search, ranked, search_asr, search_ocr
from glimpse.sources.readers import staged


def rrf(branches: dict[str, DataFrame], weights: dict[str, float], k: int = 60, limit: int = 1000) -> DataFrame:
    """query_id, video_id, frame_id, score, rank: sum of weight / (k + rank) over branches (query_id, key, rank)."""
    parts = [b.select("query_id", *KEY, (F.lit(float(weights[n])) / (k + F.col("rank"))).alias("s")) for n, b in branches.items()]
    total = reduce(DataFrame.unionByName, parts).groupBy("query_id", *KEY).agg(F.round(F.sum("s"), 6).alias("score"))
    return ranked(total, limit)


def rrf_plain(a: DataFrame, b: DataFrame, k: int = 60, top_n: int = 100) -> DataFrame:
    return rrf({"a": a, "b": b}, {"a": 1.0, "b": 1.0}, k, top_n)


def rerank(hits: DataFrame, queries: DataFrame, top_k: int = 10) -> DataFrame:
    """Score + 1 / (61 + place) + 0.05 for each word of over two letters found in the video's or frame's name; place counts from 0."""
    words = F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: F.length(w) > 2)
    j = hits.join(queries.select("query_id", words.alias("words")), "query_id")
    name = F.lower(F.concat_ws(" ", "video_id", F.col("frame_id").cast("string")))
    found = F.size(F.filter("words", lambda w: F.contains(name, w)))
    s = F.round(F.col("score") + 1.0 / (60 + F.col("rank")) + 0.05 * found, 6)
    return ranked(j.select("query_id", *KEY, s.alias("score")), top_k)


def priority_merge(first: DataFrame, second: DataFrame) -> DataFrame:
    """query_id, key, source, rank: all of ``first``, then what ``second`` adds, each in its own order."""
    u = first.select("query_id", *KEY, F.lit(1).alias("source"), "rank").unionByName(second.select("query_id", *KEY, F.lit(2).alias("source"), "rank"))
    once = u.groupBy("query_id", *KEY).agg(F.min(F.struct("source", "rank")).alias("m"))
    w = Window.partitionBy("query_id").orderBy("m", *KEY)
    return once.select("query_id", *KEY, F.col("m.source").alias("source"), F.row_number().over(w).alias("rank"))


def temporal_chain(hits: DataFrame, stages: int | DataFrame, per_stage: int = 2, top_videos: int = 20, single: int = 200) -> DataFrame:
    """query_id, video_id, stage, frame_id, chain_score, video_rank: videos in which hits of the stages follow each other.

    ``hits``: query_id, stage (1..n), video_id, frame_id, score. ``stages``: how many a query has, one number or a table (query_id, n_stages).
    Stage by stage the best hits behind the last frame are taken, or the stage's best where none is behind. A video counts with hits in
    max(2, n - 1) stages; its score is the sum of its stages' best, plus 2 * stages matched / n. Only the best hits of a stage and video can be taken,
    so each step keeps a few rows a query and video, as many steps as the largest n. A query without hits in its first stage has no rows; one of a
    single stage has its first ``single`` hits, with no stage, score or rank of a chain.
    """
    if isinstance(stages, int):
        n, most = hits.select("query_id").distinct().withColumn("n_stages", F.lit(stages).cast("long")), stages
    else:
        n = stages.select("query_id", F.col("n_stages").cast("long").alias("n_stages"))
        most = n.agg(F.max("n_stages")).first()[0] or 1
    begun = hits.where("stage = 1").select("query_id").distinct()
    asked = hits.join(n, "query_id").join(begun, "query_id", "left_semi").where("stage <= n_stages").select("query_id", "n_stages", "stage", *KEY, "score")
    alone = ranked(asked.where("n_stages = 1"), single)
    kind = hits.schema["stage"].dataType
    alone = alone.select("query_id", "video_id", F.lit(None).cast(kind).alias("stage"), "frame_id", F.lit(None).cast("double").alias("chain_score"), F.lit(None).cast("int").alias("video_rank"))
    many = asked.where("n_stages > 1")
    at = many.groupBy("query_id", "video_id").agg(F.countDistinct("stage").alias("have"), F.max("n_stages").alias("n"))
    h = staged(many.join(at.where("have >= greatest(2, n - 1)").select("query_id", "video_id"), ["query_id", "video_id"]), "chain-hits")
    last = h.select("query_id", "video_id", F.lit(-1).cast("long").alias("last")).distinct()
    taken = None
    by = Window.partitionBy("query_id", "video_id")
    for i in range(1, most + 1):
        s = h.where(F.col("stage") == i).join(last, ["query_id", "video_id"])
        s = s.withColumn("behind", (F.col("frame_id") > F.col("last")).cast("int")).withColumn("any", F.max("behind").over(by)).where("behind = any")
        s = s.withColumn("r", F.row_number().over(by.orderBy(F.desc("score"), "frame_id"))).where(F.col("r") <= per_stage).select("query_id", "video_id", "n_stages", "stage", "frame_id", "score")
        s = staged(s, "chain-step")  # a few rows a video; each step builds on all before
        taken = s if taken is None else taken.unionByName(s)
        moved = s.groupBy("query_id", "video_id").agg(F.max("frame_id").alias("to"))
        last = last.join(moved, ["query_id", "video_id"], "left").select("query_id", "video_id", F.coalesce("to", "last").alias("last"))
    per = taken.groupBy("query_id", "video_id", "n_stages", "stage").agg(F.max("score").alias("best")).groupBy("query_id", "video_id", "n_stages").agg(F.sum("best").alias("total"), F.count("*").alias("matched"))
    per = per.where("matched >= 2").withColumn("chain_score", F.round(F.col("total") + 2.0 * F.col("matched") / F.col("n_stages"), 6))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("chain_score"), "video_id"))
    best = per.withColumn("video_rank", rank).where(F.col("video_rank") <= top_videos).drop("n_stages")
    chains = taken.join(best, ["query_id", "video_id"]).select("query_id", "video_id", "stage", "frame_id", "chain_score", "video_rank")
    return chains.unionByName(alone)


def filled_chain(chain: DataFrame, hits: DataFrame, min_rows: int = 40, max_rows: int = 200) -> DataFrame:
    """query_id, video_id, frame_id, stage, rank: a chain's rows by video, stage and frame; where there are fewer than ``min_rows``, stage-1 hits by score fill up to ``max_rows``."""
    n = chain.groupBy("query_id").agg(F.count("*").alias("n"))
    first = hits.where("stage = 1").join(n, "query_id", "left").na.fill(0, ["n"]).where(F.col("n") < min_rows)
    extra = first.join(chain.select("query_id", *KEY).distinct(), ["query_id", *KEY], "left_anti")
    r = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), *KEY))
    extra = extra.withColumn("r", r).where(F.col("n") + F.col("r") <= max_rows)
    own = F.row_number().over(Window.partitionBy("query_id").orderBy("video_rank", "stage", "frame_id"))
    kind = chain.schema["stage"].dataType
    return chain.select("query_id", *KEY, "stage", own.cast("long").alias("rank")).unionByName(extra.select("query_id", *KEY, F.lit(1).cast(kind).alias("stage"), (F.col("n") + F.col("r")).cast("long").alias("rank")))


def chain_fallback(chain: DataFrame, hits: DataFrame, min_rows: int = 40, max_rows: int = 200) -> DataFrame:
    """query_id, video_id, frame_id, stage of ``filled_chain``."""
    return filled_chain(chain, hits, min_rows, max_rows).drop("rank")


def group_by_video(hits: DataFrame) -> DataFrame:
    """``hits`` with the place of their video by first appearance, and their own in it."""
    first = F.min("rank").over(Window.partitionBy("query_id", "video_id"))
    h = hits.withColumn("first", first)
    return h.withColumn("video_place", F.dense_rank().over(Window.partitionBy("query_id").orderBy("first"))).withColumn("place", F.row_number().over(Window.partitionBy("query_id", "video_id").orderBy("rank"))).drop("first")


def nearest_keyframe(frames: DataFrame, times: DataFrame) -> DataFrame:
    """video_id, at, frame_id: the key frame closest to each different time, the earlier of equals. Looks only at the last before and the first after.

    The first after is the last before in the opposite order, as a window that reaches to the end is summed up anew for each row.
    """
    asked = times.select("video_id", F.col("at").alias("t")).distinct()
    both = frames.select("video_id", F.col("seconds").alias("t"), F.lit(0).alias("ask"), F.struct("seconds", "frame_id").alias("f")).unionByName(asked.select("video_id", "t", F.lit(1).alias("ask"), F.lit(None).cast("struct<seconds:double,frame_id:bigint>").alias("f")))
    order = ("t", "ask", "f.frame_id")
    so_far = lambda by: F.last("f", True).over(Window.partitionBy("video_id").orderBy(*[by(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumn("l", so_far(F.asc)).withColumn("r", so_far(F.desc)).where("ask = 1")
    l, r, t = F.col("l"), F.col("r"), F.col("t")
    pick = F.when(l.isNull(), r).when(r.isNull() | (t - l["seconds"] <= r["seconds"] - t), l).otherwise(r)
    return both.select("video_id", t.alias("at"), pick["frame_id"].alias("frame_id")).where("frame_id is not null")


def display_limit(hits: DataFrame, plain: int = 80, staged: int = 200) -> DataFrame:
    """The first 80 of each query, or 200 where rows carry a stage."""
    has = F.max(F.col("stage").isNotNull()).over(Window.partitionBy("query_id"))
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", *KEY))
    return hits.withColumn("has", has).withColumn("n", n).where(F.col("n") <= F.when(F.col("has"), staged).otherwise(plain)).drop("has", "n")


def rrf_by_keywords(visual: DataFrame, ocr: DataFrame, asr: DataFrame, queries: DataFrame, k: int = 60, limit: int = 1000) -> DataFrame:
    """As ``rrf``, each query (query_id, on_screen, spoken) with its own weights: text branches weigh more where it named words for them.

    A query that has hits in the visual branch alone keeps their order.
    """
    w = queries.select("query_id", F.when(F.size("on_screen") > 0, 1.15).otherwise(0.90).alias("o"), F.when(F.size("spoken") > 0, 1.10).otherwise(0.85).alias("a"))
    part = lambda b, n: b.select("query_id", *KEY, "rank", F.lit(n).alias("branch"))
    u = part(visual, "v").unionByName(part(ocr, "o")).unionByName(part(asr, "a")).join(w, "query_id")
    weight = F.when(F.col("branch") == "v", 1.0).when(F.col("branch") == "o", F.col("o")).otherwise(F.col("a"))
    return ranked(u.groupBy("query_id", *KEY).agg(F.round(F.sum(weight / (k + F.col("rank"))), 6).alias("score")), limit)


def two_stage(coarse: DataFrame, queries: DataFrame, keep: int = 500, top_k: int = 10) -> DataFrame:
    """Re-rank each query's ``keep`` best."""
    return rerank(coarse.where(F.col("rank") <= keep), queries, top_k)


def two_stage_by_model(coarse: dict[str, DataFrame], queries: DataFrame, fallback: str = "clip", keep: int = 500, top_k: int = 10) -> DataFrame:
    """``two_stage``, each query (query_id, text) on the hits of the model that its kind and environment call for, of the ``fallback`` where there is none; with ``model``."""
    m = select_model(route(F.col("text")), environment(F.col("text")))
    asked = queries.withColumn("model", F.when(m.isin(*coarse), m).otherwise(fallback))
    hits = reduce(DataFrame.unionByName, [h.select("query_id", *KEY, "score", "rank").withColumn("model", F.lit(n)) for n, h in coarse.items()])
    own = hits.join(asked.select("query_id", "model"), ["query_id", "model"]).drop("model")
    return two_stage(own, queries, keep, top_k).join(asked.select("query_id", "model"), "query_id")


def hybrid_search(queries: DataFrame, query_vectors: DataFrame, vectors: DataFrame, shown: DataFrame, said: DataFrame, limit: int = 1000, shown_how: dict | None = None, said_how: dict | None = None) -> DataFrame:
    """query_id, video_id, frame_id, score, rank, score_kind: nearest frames, on-screen texts and speech, fused by rank.

    Queries (query_id, text) are taken apart: on-screen and spoken keywords ask their branch, else the whole text does, with less weight.
    A query whose text branches are both empty keeps the nearest frames with their cosine (score_kind cosine, else rrf). Vectors of no query ask nothing.
    """
    q = decompose(queries)
    asks = lambda c: q.select("query_id", F.when(F.size(c) > 0, F.array_join(c, " ")).otherwise(F.col("text")).alias("text"))
    near = knn_search(query_vectors.join(queries.select("query_id"), "query_id", "left_semi"), vectors, limit)
    ocr, asr = search_ocr(asks("on_screen"), shown, limit, **(shown_how or {})), search_asr(asks("spoken"), said, limit, **(said_how or {}))
    fused = rrf_by_keywords(near, ocr, asr, q, limit=limit)
    worded = ocr.select("query_id").unionByName(asr.select("query_id")).distinct().withColumn("worded", F.lit(True))
    plain = near.join(worded, "query_id", "left_anti").withColumn("score_kind", F.lit("cosine"))
    return fused.join(worded, "query_id").drop("worded").withColumn("score_kind", F.lit("rrf")).unionByName(plain)


def chained_stages(queries: DataFrame, ascii_bounds: bool = False) -> DataFrame:
    """query_id, chained, stage, text: a text of two stages or more asks once a stage, another as a whole; a topic that it begins with goes before each."""
    q = decompose(queries, ascii_bounds=ascii_bounds)
    many = F.size("stages") >= 2
    with_topic = lambda s: F.when(F.col("topic") != "", F.concat("topic", F.lit(" - "), s)).otherwise(s)
    asked = F.when(many, F.transform("stages", with_topic)).otherwise(F.array("text"))
    return q.select("query_id", many.alias("chained"), F.posexplode(asked).alias("i", "text")).select("query_id", "chained", (F.col("i") + 1).cast("long").alias("stage"), "text")


def auto_stages(queries: DataFrame, stage_vectors: DataFrame, search_chain, search_one, ascii_bounds: bool = False) -> DataFrame:
    """query_id, video_id, frame_id, stage (null outside chains), rank: texts of several stages by chains of events, others by hybrid search.

    ``stage_vectors``: query_id, stage, qvec of ``chained_stages``. ``search_chain`` takes stages' vectors (query_id, stage, qvec) and gives a
    chain's rows (query_id, video_id, frame_id, stage, rank); ``search_one`` takes the other queries and their vectors and gives ranked hits.
    """
    asked = staged(chained_stages(queries, ascii_bounds), "stages")
    many = asked.where("chained").join(stage_vectors, ["query_id", "stage"], "left").select("query_id", "stage", "qvec")
    one = queries.join(asked.where("not chained").select("query_id").distinct(), "query_id", "left_semi")
    vec = stage_vectors.where("stage = 1").join(one.select("query_id"), "query_id", "left_semi").select("query_id", "qvec")
    flat = search_one(one, vec).select("query_id", *KEY, F.lit(None).cast("long").alias("stage"), F.col("rank").cast("long").alias("rank"))
    return search_chain(many).select("query_id", *KEY, F.col("stage").cast("long").alias("stage"), F.col("rank").cast("long").alias("rank")).unionByName(flat)


def chain_search(vectors: DataFrame, limit: int = 1000, **chain):
    """For ``auto_stages``: takes stages' vectors (query_id, stage, qvec), any number a query, and gives its chain's rows (query_id, video_id, frame_id, stage, rank).

    Each stage looks for twice ``limit`` nearest frames; how many stages a query has is its largest, whether it found something or not.
    """

    def search(many: DataFrame) -> DataFrame:
        kind = many.schema["query_id"].dataType
        one = F.concat_ws(":", F.col("stage").cast("string"), F.col("query_id").cast("string"))
        near = knn_search(many.where("qvec is not null").select(one.alias("query_id"), "qvec"), vectors, 2 * limit)
        parts = F.split("query_id", ":", 2)
        hits = staged(near.select(parts[1].cast(kind).alias("query_id"), parts[0].cast("long").alias("stage"), *KEY, "score"), "stage-hits")
        return filled_chain(temporal_chain(hits, many.groupBy("query_id").agg(F.max("stage").alias("n_stages")), **chain), hits)

    return search


def search_any(queries: DataFrame, stage_vectors: DataFrame, vectors: DataFrame, shown: DataFrame, said: DataFrame, limit: int = 1000, **how) -> DataFrame:
    """``auto_stages`` of texts from beginning to end: query_id, video_id, frame_id, stage, rank. ``stage_vectors``: query_id, stage, qvec for ``chained_stages`` of ``queries``."""
    return auto_stages(queries, stage_vectors, chain_search(vectors, limit), lambda one, vec: hybrid_search(one, vec, vectors, shown, said, limit, **how))
