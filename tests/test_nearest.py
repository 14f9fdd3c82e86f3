"""Approximate search against exact search, and passes over long videos."""

import resource

import numpy as np
from pyspark.sql import functions as F

from glimpse.operators import frames as fr
from glimpse.operators import nearest as ne
from glimpse.operators import search as se
from glimpse.plans import fixtures as fx
from glimpse.sources.readers import staged

DIR = "/root/testdata/sf0.01"


def table(spark, x):
    return spark.createDataFrame([("v", k, r.tolist()) for k, r in enumerate(x)], "video_id string, frame_id long, vec array<double>")


def test_recall_on_all_query_vectors(spark):
    """The test vectors have no structure to speak of: nine tenths take as many pairs as there are, over five tables."""
    v, q = staged(fx.vectors(spark, DIR), "v"), fx.query_vectors(spark, DIR)
    exact = se.knn_search(q, v, 10)
    hits, looked = ne.ann_search(q, v, 10, bucket_rows=32)
    assert ne.recall(hits, exact).first()[0] >= 0.9
    assert looked.first()[0] <= 1.35 * q.count() * v.count()


def test_recall_where_vectors_have_neighbours(spark):
    """Vectors about centres, as of frames of the same scene: a small part of all pairs finds nine tenths."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 32)).repeat(40, 0) + 0.35 * rng.normal(size=(12_000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = staged(table(spark, x), "v")
    q = v.where("frame_id % 50 = 0").select(F.col("frame_id").alias("query_id"), F.col("vec").alias("qvec"))
    hits, looked = ne.ann_search(q, v, 10, bucket_rows=200)
    assert ne.recall(hits, se.knn_search(q, v, 10)).first()[0] >= 0.9
    assert looked.first()[0] < 0.4 * q.count() * len(x)


def test_odd_vectors_and_a_hot_bucket(spark):
    rows = [("v", k, [1.0, 0.0]) for k in range(300)] + [("w", k, [0.0, 1.0]) for k in range(20)] + [("w", 50, None), ("w", 51, []), ("w", 52, [1.0])]
    v = spark.createDataFrame(rows, "video_id string, frame_id long, vec array<double>")
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, None), (4, [1.0])], "query_id long, qvec array<double>")
    hits, _ = ne.ann_search(q, v, 3, tables=2, probes=64, bucket_rows=40, block=16)
    got = {}
    for r in hits.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.video_id, r.frame_id, r.score))
    assert got == {1: [("v", 0, 1.0), ("v", 1, 1.0), ("v", 2, 1.0)], 2: [("w", 0, 0.8), ("w", 1, 0.8), ("w", 2, 0.8)], 4: [("w", 52, 1.0)]}
    assert ne.ann_search(q.limit(0), v, 3)[0].count() == ne.ann_search(q, v.limit(0), 3)[0].count() == 0


def brute_kept(hashes, threshold, window):
    kept = []
    for k, h in enumerate(hashes):
        if not any(bin((h ^ x) & (2**64 - 1)).count("1") <= threshold for _, x in kept[-window:]):
            kept.append((k, h))
    return kept


def test_near_duplicates_of_signed_hashes(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(-(2**63), 2**63 - 1, 6)
    hashes = [int(base[rng.integers(6)]) ^ int(sum(1 << int(b) for b in rng.integers(0, 63, 3))) for _ in range(400)]
    d = spark.createDataFrame([("a", k, h) for k, h in enumerate(hashes)] + [("b", k, -h - 1) for k, h in enumerate(hashes)], "video_id string, frame_idx long, dhash long").repartition(7)
    got = sorted(map(tuple, fr.drop_near_duplicates(d).collect()))
    assert got == [("a", *x) for x in brute_kept(hashes, 5, 4)] + [("b", *x) for x in brute_kept([-h - 1 for h in hashes], 5, 4)]


def test_a_video_of_a_million_frames(spark):
    """All frames of one video, of which every fifth has a hash of its own."""
    d = spark.range(1_000_000).select(F.lit("v").alias("video_id"), F.col("id").alias("frame_idx"), F.xxhash64((F.col("id") / 5).cast("long")).alias("dhash"))
    assert abs(fr.drop_near_duplicates(d, threshold=2).count() - 200_000) <= 1
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss < 4 << 20  # KB; workers hold one batch and four hashes


def test_reused_texts_by_hand(spark):
    rows = [("v", 0, [0.0, 0.0], [1.0], "a"), ("v", 1, [5.0, 5.0], [2.0], "b"), ("v", 2, [5.9, 6.0], [8.9], "c"), ("v", 3, [7.0, 5.0], [1.0], "d"), ("v", 4, None, [1.0], "e"), ("v", 5, [7.0], [1.0], " "), ("v", 6, [7.0], [1.0], "g")]
    d = spark.createDataFrame(rows, "video_id string, frame_idx long, title array<double>, ticker array<double>, text string")
    got = [(r.frame_idx, r.anchor, r.reused, r.text) for r in fr.reuse_duplicate_text(d).orderBy("frame_idx").collect()]
    assert got == [(0, 0, False, "a"), (1, 0, True, "a"), (2, 0, True, "a"), (3, 3, False, "d"), (4, 4, False, "e"), (5, 5, False, " "), (6, 6, False, "g")]


def test_queries_in_one_scan_and_in_blocks(spark):
    """More queries than a block are cut into blocks; odd vectors are no hits on either way."""
    rng = np.random.default_rng(12)
    x = np.round(rng.normal(size=(300, 4)), 1)
    rows = [("v", k, r.tolist()) for k, r in enumerate(x)]
    rows += [("w", 1, None), ("w", 2, []), ("w", 3, [1.0, None, 1.0, 1.0]), ("w", 4, [float("nan")] * 4), ("w", 5, [1.0, 2.0]), ("w", 6, x[7].tolist())]
    v = spark.createDataFrame(rows, "video_id string, frame_id long, vec array<double>")
    asked = [(k, r.tolist()) for k, r in enumerate(x[:90])] + [(90, [2.0, 1.0]), (91, None), (92, []), (93, [None, 1.0, 1.0, 1.0])]
    q = spark.createDataFrame(asked, "query_id long, qvec array<double>")
    scan, tiles = ([tuple(r) for r in se.knn_search(q, v, 12, block=b).orderBy("query_id", "rank").collect()] for b in (2048, 20))
    assert scan == tiles and len(scan) == 90 * 12 + 1
    there = [(c, f, np.array(a)) for c, f, a in rows[:300] + rows[-1:]]
    for k in (0, 7, 89):
        best = sorted((-round(float(x[k] @ a), 6), c, f) for c, f, a in there)[:12]
        assert [(c, f) for i, c, f, *_ in scan if i == k] == [(c, f) for _, c, f in best]


def test_a_table_of_queries_is_searched_without_the_driver(spark):
    v = fx.vectors(spark, DIR)
    tiles = se.knn_search(v.select(F.col("vec_id").alias("query_id"), F.col("vec").alias("qvec")), v, 3, block=500)
    assert tiles.count() == 3 * v.count()
