"""Operators on cases worked by hand."""

import difflib

import numpy as np
from pyspark.sql import functions as F

from glimpse.functions import querylog as ql
from glimpse.functions import text as tx
from glimpse.operators import frames as fr
from glimpse.operators import fusion as fu
from glimpse.operators import search as se
from glimpse.operators import session as ss


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def docs_of(spark, texts):
    return spark.createDataFrame([("v", k, t) for k, t in enumerate(texts)], "video_id string, frame_id long, text string")


def asks(spark, texts):
    return spark.createDataFrame([*enumerate(texts)], "query_id long, text string")


def test_tiers(spark):
    texts = ["Cà phê sữa", "quán cà phê sữa đá", "cà phê", "ca phe sua", "mot ca phe sua nua", "phê sữa gì khác nữa", "không"]
    got = {r.frame_id: r.score for r in se.search_text(asks(spark, ["cà phê sữa"]), docs_of(spark, texts)).collect()}
    assert got[0] == 1.0 and got[1] == round(0.95 + 0.05 * 10 / 18, 3) and got[2] == round(0.90 + 0.05 * 6 / 10, 3)
    assert got[3] == 0.96 and got[4] == round(0.88 + 0.08 * 10 / 18, 3) and 0.7 <= got[5] < 0.96 and 6 not in got


def test_containing_tiers_are_found_by_counts_of_words(spark):
    # the inner text's first and last words may be parts of the outer's words
    got = {(r.query_id, r.frame_id): r.score for r in se.search_text(asks(spark, ["art of war", "a long query with the art of"]), docs_of(spark, ["cart of wares", "the art", "with the art of"])).collect()}
    assert got[(0, 0)] == round(0.95 + 0.05 * 10 / 13, 3) and got[(1, 2)] == round(0.90 + 0.05 * 15 / 28, 3)


def test_blank_stop_word_and_synonym_queries(spark):
    d = docs_of(spark, ["motorbike on road", "the", "xe máy"])
    hits = {(r.query_id, r.frame_id) for r in se.search_text(asks(spark, ["  ", "the", "xe máy"]), d, ("the",), synonyms={"xe máy": ["motorbike"]}).collect()}
    assert hits == {(1, 1), (2, 2), (2, 0)}


def test_fuzzy_scores(spark):
    d = docs_of(spark, ["red appel pie", "red", "something else entirely red"])
    got = {r.frame_id: r.score for r in se.search_text(asks(spark, ["red apple pies"]), d, fuzzy=True).collect()}
    ratio = difflib.SequenceMatcher(None, "red apple pies", "red appel pie").ratio()
    assert got[0] >= round(0.65 + 0.22 * ratio, 3)


def test_nearest_vectors_against_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = spark.createDataFrame([("a" if k % 2 else "b", k, r.tolist()) for k, r in enumerate(x)] + [("a", 900, None), ("a", 901, [1.0])], "video_id string, frame_id long, vec array<double>").repartition(5)
    q = spark.createDataFrame([(k, x[k].tolist()) for k in range(20)] + [(99, None)], "query_id long, qvec array<double>")
    for block in (3, 2048):
        got = {}
        for r in se.knn_search(q, v, 7, block=block).collect():
            got.setdefault(r.query_id, {})[r["rank"]] = r.frame_id
        for k in range(20):
            s = np.round(x @ x[k], 6)
            best = sorted(range(300), key=lambda i, s=s: (-s[i], "ab"[1 - i % 2], i))[:7]
            assert [got[k][i] for i in range(1, 8)] == best
    assert {r.video_id for r in se.knn_search(q, v, 50, scope="a").collect()} == {"a"} and se.knn_search(q.limit(0), v, 3).count() == 0


def test_hybrid_weights_and_the_branch_of_vectors_alone(spark):
    q = spark.createDataFrame([(1, '"sale today"'), (2, "nothing shared")], "query_id long, text string")
    v = spark.createDataFrame([("v", 0, [1.0, 0.0]), ("v", 1, [0.0, 1.0])], "video_id string, frame_id long, vec array<double>")
    qv = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0])], "query_id long, qvec array<double>")
    h = fu.hybrid_search(q, qv, v, docs_of(spark, ["big sale today"]), docs_of(spark, ["one sale today"]), 10)
    got = {(r.query_id, r.frame_id): (r.score, r.score_kind) for r in h.collect()}
    assert got[(1, 0)] == (round(1 / 62 + 1.15 / 61 + 0.85 / 61, 6), "rrf") and got[(1, 1)] == (round(1 / 61, 6), "rrf")
    assert got[(2, 0)] == (1.0, "cosine") and got[(2, 1)] == (0.0, "cosine")


def test_stages_are_searched_as_chains_and_others_alone(spark):
    q = asks(spark, ["tại chợ, a man walks then a dog runs", "a plain question"])
    stages = {(r.query_id, r.stage): (r.text, r.chained) for r in fu.chained_stages(q).collect()}
    assert len([k for k in stages if k[0] == 0]) == 2 and stages[(0, 1)][0].startswith("chợ - ") and stages[(1, 1)] == ("a plain question", False)
    v = spark.createDataFrame([(0, 1, [1.0]), (0, 2, [1.0]), (1, 1, [1.0])], "query_id long, stage long, qvec array<double>")
    row = lambda df: df.select("query_id", F.lit("v").alias("video_id"), F.lit(1).cast("long").alias("frame_id"), F.lit(1).alias("rank"))
    out = fu.auto_stages(q, v, lambda many: row(many).withColumn("stage", F.lit(2)), lambda one_, vec: row(one_.join(vec, "query_id")))
    assert sorted((r.query_id, r.stage) for r in out.collect()) == [(0, 2), (0, 2), (1, None)]


def test_timestamps_fall_back_in_order(spark):
    f = spark.createDataFrame([("v", "a/keyframe_0007.webp"), ("v", "a/ts_12.5s.webp"), ("v", "a/keyframe_50.webp"), ("v", "a/title.webp")], "video_id string, path string")
    m = spark.createDataFrame([("v", 7, 3.25), ("w", 50, 9.0)], "video_id string, frame_id long, seconds double")
    got = {r.path: r.seconds for r in fr.resolve_timestamp(f, m, 25.0).collect()}
    assert got == {"a/keyframe_0007.webp": 3.25, "a/ts_12.5s.webp": 12.5, "a/keyframe_50.webp": 2.0, "a/title.webp": None}
    assert [r.seconds for r in fr.resolve_timestamp(f, m).where("path like '%50%'").collect()] == [None]


def test_noise_in_speech(spark):
    text = ["uh.", "Subtitles by X", "va va, va va!", "a real sentence", "?!", "long talk " * 6 + "subtitles by x", None]
    d = spark.createDataFrame([*enumerate(text)], "k long, t string")
    none = F.lit(None).cast("double")
    assert [r.x for r in d.orderBy("k").select(fr.junk_segment(F.col("t"), none, none).alias("x")).collect()] == [True, True, True, False, True, False, True]


def test_names_spellings_and_spoken_words(spark):
    assert one(spark, tx.normalize_text(F.lit(" Duong  NGUOI luong x_duong Luongs "))) == "Đường NGƯỜI lương x_duong Luongs"
    assert one(spark, ql.spoken_intent(F.lit("Tìm đoạn nói : xin chào, tỉnh Hà Nam. Đây")))[:2] == ["xin chào", "Hà Nam"]
    names = spark.createDataFrame([("keyframe_10",), ("2",), ("b",), ("A",), ("007",)], "n string")
    assert [r.n for r in names.orderBy(tx.frame_order_key(F.col("n"))).collect()] == ["2", "007", "keyframe_10", "A", "b"]
    for name, want in (("frame_abc", "frame_abc"), (" KeyFrame-0012.0 ", "12"), ("Frame_", "Frame_"), ("007", "7"), ("12.5", "12.5")):
        assert one(spark, tx.canonical_frame_id(F.lit(name))) == want, name
    none = F.lit(None).cast("string")
    hit = one(spark, tx.video_and_frame(none, F.lit("0"), F.lit("x/L01_V002/keyframes/keyframe_33.webp"), none, none))
    assert (hit.video, hit.frame) == ("L01_V002", 33)
    hit = one(spark, tx.video_and_frame(none, none, none, none, none))
    assert (hit.video, hit.frame) == ("video", 0)


def test_submission_errors(spark):
    files = {
        "q1-kis.csv": [" Video,Frame", "a.MP4, 7", "", "b", "c,x1", None],
        "q2-QA.csv": ["a,5", "a,5, \"say \"so\"\" ", "a,5,'" + "y" * 120 + "'", "a,5,\"", "a,,b, c"],
        "q3-trake.csv": ["a,30,x,4,30,007", "a,x", "a", "time,1"],
        "other.txt": ["v.mp4,?,?"],
    }
    lines = spark.createDataFrame([(f, k, x) for f, ls in files.items() for k, x in enumerate(ls)], "file string, line_no long, line string")
    got = {}
    for r in ss.submission_errors(lines).orderBy("file", "row").collect():
        got.setdefault(r.file, []).append((r.row, r.line, r.warnings, r.errors))
    assert got == {
        "q1-kis.csv": [(1, "a,7", "mp4", ""), (2, "b", "", "no frame"), (3, "c,x1", "", "frame is no number")],
        "q2-QA.csv": [(1, "a,5", "no answer", ""), (2, 'a,5,"say ""so"""', "", ""), (3, f'a,5,"{"y" * 100}"', "long answer", ""), (4, 'a,5,""', "", ""), (5, 'a,,"b,c"', "", "")],
        "q3-trake.csv": [(1, "a,4,7,30", "frame is no number", ""), (2, "a,x", "frame is no number", "no frame"), (3, "a", "", "no frame"), (4, "time,1", "", "")],
        "other.txt": [(1, "v,?,?", "mp4", "")],
    }


def test_selection_band(spark):
    trays = [(q, "trake" if q == 9 else "kis", k) for q, n in ((1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 6), (9, 4)) for k in range(n)]
    got = {r.query_id: (r.n_frames, r.band) for r in ss.selection_band(spark.createDataFrame(trays, "query_id long, task string, frame_id long")).collect()}
    assert got == {1: (1, "best"), 2: (2, "fine"), 3: (3, "fine"), 4: (4, "many"), 5: (5, "many"), 6: (6, "too many"), 9: (4, None)}


def test_unreadable_frames_have_no_vector(spark):
    f = spark.createDataFrame([("v", k, f"{k:03}", ok) for k, ok in ((1, True), (2, False), (3, None), (4, True))], "video_id string, frame_id long, name string, ok boolean")
    v = spark.createDataFrame([("v", 0, "x"), ("v", 1, "y")], "video_id string, pos long, vec string")
    assert {(r.frame_id, r.vec) for r in fr.align_vectors_by_rank(f, v, readable="ok").collect()} == {(1, "x"), (4, "y")}
    assert {(r.frame_id, r.vec) for r in fr.align_vectors_by_rank(f, v).collect()} == {(1, "x"), (2, "y")}


def test_times_in_names(spark):
    cases = {"ts12.5s": 12.5, "TS-12.5_k": 12.5, "ts_7": 7.0, "x_1500MS": 1.5, "x_12.5": 12.5, "12.5_x": 12.5, "f123ms": None, "123ms": 0.123, "xts_4s": None, "a-ts4s": 4.0, "x_12": None}
    d = spark.createDataFrame([*cases], "string").select("value", tx.timestamp_from_name(F.concat(F.lit("d.e/"), "value", F.lit(".webp"))).alias("t"))
    assert {r.value: r.t for r in d.collect()} == cases


def test_letters_of_vietnamese(spark):
    d = spark.createDataFrame(["cá", "gà", "mũ", "BÁNH MÌ", "đi", "cafe", "naïve", "über"], "string").select("value", tx.is_vietnamese(F.col("value")).alias("v"))
    assert {r.value for r in d.collect() if r.v} == {"cá", "gà", "mũ", "BÁNH MÌ", "đi"}


def test_white_space_before_leading_phrases(spark):
    assert one(spark, ql.clean_noise(F.lit(" \tTìm cảnh chợ\n"))) == "chợ" and one(spark, ql.clean_question(F.lit("  cho biết chợ ở đâu ? "))) == "chợ"


def test_spoken_mode_and_fields(spark):
    q = ql.decompose(asks(spark, ["nói về biển đảo", " ", "chợ rồi nhà thờ"]), {"chợ": "a market", "nhà": "a house"}).orderBy("query_id").collect()
    assert [(r["mode"], r.is_temporal, list(r.entities), r.confidence) for r in q] == [("asr", False, [], 0.95), ("kis", False, [], 0.95), ("trake", True, ["chợ", "nhà"], 0.95)]
    assert list(q[0].spoken) == ["biển đảo"] and q[2].visual_english == "A video scene of a market, a house"


def test_names_of_videos_in_any_case(spark):
    cols = "query_id long, seq long, task string, video_id string, frame_id long, candidate long, answers string, common string"
    s = spark.createDataFrame([(1, 1, "kis", "V1.MP4", 5, None, "x; X", "c"), (1, 2, "kis", "v1", 5, None, " ;", "c"), (1, 3, "kis", " V2", 5, None, None, "c")], cols)
    assert [(r.video_id, r.place) for r in ss.selection_tray(s).orderBy("place").collect()] == [("V1", 1), ("V2", 2)]
    assert [r.line for r in ss.kis_rows(s).orderBy("line_no").collect()] == ["V1,5", "V2,5"]
    assert [r.line for r in ss.qa_rows(s).orderBy("line_no").collect()] == ['V1,5,"x"', 'v1,5,"c"', 'V2,5,"c"']
    t = spark.createDataFrame([(1, 1, "trake", "v", 5, 1, "", ""), (1, 2, "trake", "V.mp4", 5, 2, "", ""), (1, 3, "trake", "v", 5, 2, "", ""), (2, 4, "trake", "w", 0, 1, "", ""), (2, 5, "trake", "W", -1, 3, "", "")], cols)
    assert [(r.query_id, r.video_id) for r in ss.selection_tray(t).orderBy("query_id", "place").collect()] == [(1, "v"), (1, "V"), (2, "w"), (2, "W")]
    assert [(r.query_id, r.line) for r in ss.trake_rows(t).orderBy("query_id", "line_no").collect()] == [(1, "v,5"), (1, "V,5"), (2, "w,0"), (2, "W,-1")]


def test_contest_texts_of_answers(spark):
    s = spark.createDataFrame([(1, 1, "a/L1.mp4", 50, None, 0.0, "x|y", "c"), (1, 2, "L2", 50, None, 1.2345, None, "c"), (1, 3, "L3", 50, 77, 9.0, None, "c"), (2, 4, None, None, None, None, "42;", None)], "query_id long, seq long, video_id string, frame_id long, timestamp_ms long, seconds double, answers string, common string")
    assert [r.text for r in ss.qa_payload(s).orderBy("query_id", "place").collect()] == ["x-L1-2000", "y-L1-2000", "c-L2-1235", "c-L3-77", "42"]


def test_ranks_of_queries_without_hits(spark):
    hits = spark.createDataFrame([(1, "v", 1, 1), (1, "v", 2, 2), (2, "v", 1, 1)], "query_id long, video_id string, frame_id long, rank int")
    judged = spark.createDataFrame([(1, "v", 2), (2, "v", 9), (3, "v", 1)], "query_id long, video_id string, frame_id long")
    got = ss.reciprocal_ranks(hits, judged)
    assert {r.query_id: r.rr for r in got.collect()} == {1: 0.5, 2: 0.0, 3: 0.0} and tuple(ss.mean_reciprocal_rank(got).first()) == (0.166667, 3)


def test_speech_without_a_frame_map(spark):
    seg = spark.createDataFrame([("a", 1, 2.39, 3.0, "x"), ("a", 2, 2.38, None, "y"), ("b", 1, 0.0, 1.0, "z")], "video_id string, segment_id long, seg_start double, seg_end double, text string")
    frames = spark.createDataFrame([("b", 1, 0.5)], "video_id string, frame_id long, seconds double")
    assert {(r.video_id, r.frame_id): r.text for r in fr.align_segments(seg, frames).collect()} == {("a", 59): "x | y", ("b", 1): "z"}


def test_readings_are_spelled_right(spark):
    c = spark.createDataFrame([("v", 1, "duong  phố", 0.5, "s", ["đường phố"]), ("v", 1, "đường phố", 0.4, "t", None)], "video_id string, frame_id long, text string, confidence double, source string, recent array<string>")
    got = fr.rank_text_candidates(c).collect()
    assert len(got) == 1 and got[0].text == "đường phố" and got[0].score == round(0.55 * 0.5 + 0.15 + 0.1 * (0.65 + 0.35 * 9 / 12) + 0.2 * 0.2, 4)


def chain(spark, rows, stages):
    h = spark.createDataFrame(rows, "query_id long, stage long, video_id string, frame_id long, score double")
    n = stages if isinstance(stages, int) else spark.createDataFrame([*stages.items()], "query_id long, n_stages long")
    return h, fu.temporal_chain(h, n)


def test_chains_of_any_number_of_stages(spark):
    rows = [(1, 2, "v", 5, 0.9), (1, 3, "v", 9, 0.8)]  # no hit of the first stage
    rows += [(2, 1, "v", k, 0.5 - k / 1000) for k in range(250)]  # one stage
    rows += [(3, 1, "v", 10, 0.5), (3, 2, "v", 5, 0.9), (3, 2, "v", 20, 0.4)]  # two, in order
    rows += [(4, 1, "v", 10, 0.5), (4, 2, "v", 5, 0.9), (4, 3, "v", 4, 0.1), (4, 1, "w", 1, 0.9)]  # three, none behind
    _, got = chain(spark, rows, {1: 3, 2: 1, 3: 2, 4: 3})
    found = {}
    for r in got.collect():
        found.setdefault(r.query_id, []).append((r.video_id, r.stage, r.frame_id, r.chain_score))
    assert 1 not in found and len(found[2]) == 200 and {x[1] for x in found[2]} == {None} and max(x[2] for x in found[2]) == 199
    assert sorted(found[3]) == [("v", 1, 10, 2.9), ("v", 2, 20, 2.9)]
    assert sorted(found[4]) == [("v", 1, 10, 3.5), ("v", 2, 5, 3.5), ("v", 3, 4, 3.5)]
    assert chain(spark, rows[:2], 3)[1].count() == 0 and chain(spark, rows[2:252], 1)[1].count() == 200


def test_texts_of_one_two_and_three_events_in_one_call(spark):
    q = asks(spark, ["a man walks then a dog runs", "a plain question", "cat sits; bird sings -> sun sets"])
    v = spark.createDataFrame([("v", k, [float(k == 1), float(k == 2), float(k == 3)]) for k in range(1, 4)], "video_id string, frame_id long, vec array<double>")
    asked = fu.chained_stages(q)
    assert {(r.query_id, r.stage) for r in asked.collect()} == {(0, 1), (0, 2), (1, 1), (2, 1), (2, 2), (2, 3)}
    vectors = asked.select("query_id", "stage", F.transform(F.array(*[F.lit(k) for k in (1, 2, 3)]), lambda x: (x == F.col("stage")).cast("double")).alias("qvec"))
    none = spark.createDataFrame([], "video_id string, frame_id long, text string")
    got = {}
    for r in fu.search_any(q, vectors, v, none, none, 10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.frame_id, r.stage))
    assert [x for x in got[0]][:2] == [(1, 1), (2, 1)] and {s for _, s in got[0]} == {1, 2} and {s for _, s in got[2]} == {1, 2, 3}
    assert [f for f, _ in got[1]][0] == 1 and {s for _, s in got[1]} == {None}
