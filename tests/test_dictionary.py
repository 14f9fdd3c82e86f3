"""Dictionaries of many keys against plain containment, and long logs in stretches."""

import random

from pyspark.sql import functions as F

from glimpse.operators import dictionary as di
from glimpse.operators import session as ss


def test_a_hundred_thousand_keys(spark):
    rng = random.Random(1)
    keys = sorted({"".join(rng.choice("abcdeé ") for _ in range(rng.randrange(1, 9))) for _ in range(140_000)})[:100_000]
    texts = ["".join(rng.choice("abcdeé ") for _ in range(60)) for _ in range(20)] + [None, ""]
    t = spark.createDataFrame([*enumerate(texts)], "id long, text string")
    k = spark.createDataFrame([(x,) for x in keys] + [(None,), ("",), (keys[0],)], "key string")
    want = {(i, x) for i, text in enumerate(texts) if text for x in keys if x in text}
    for at_once in (200_000, 30_000):
        got = [tuple(r) for r in di.matches(t, k, at_once).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_what_users_make_of_it(spark):
    t = spark.createDataFrame([(1, "Một CHIẾC xe máy ở chợ"), (2, "the of"), (3, None)], "id long, text string")
    d = spark.createDataFrame([("xe", "a vehicle", 2), ("xe máy", "a motorbike", 3), ("chợ", "a market", 1), ("máy", "a motorbike", 4)], "key string, value string, place int")
    assert {r.id: list(r.entities) for r in di.entities(t, d).collect()} == {1: ["chợ", "xe", "xe máy", "máy"], 2: [], 3: []}
    assert {r.id: r.english for r in di.visual_english(t, d).collect()} == {1: "A video scene of a motorbike, a market, a vehicle", 2: "", 3: ""}
    got = {}
    for r in di.expanded_tokens(t, d, ("the", "of", "a", "mot")).collect():
        got.setdefault(r.id, set()).add(r.token)
    assert got == {1: {"chiec", "xe", "may", "o", "cho", "vehicle", "motorbike", "market"}, 2: {"the", "of"}}


def brute_blocks(lines):
    """video -> lines of its last complete block, of one log's (video, done) lines."""
    last, run, video = {}, [], None
    for n, (v, done) in enumerate(lines):
        if not run or v != video:
            run, video = [], v
        run.append(n)
        if done:
            if v is not None:
                last[v] = run[:-1]
            run = []
    return {(v, n) for v, ns in last.items() for n in ns}


def test_one_log_in_stretches_gives_the_same_blocks(spark):
    rng = random.Random(4)
    lines, video = [], "a"
    for _ in range(3000):
        video = rng.choice("abcdefgh") if rng.random() < 0.1 else video
        lines.append((None if rng.random() < 0.02 else video, rng.random() < 0.1))
    df = spark.createDataFrame([("log", n, v, f"t{n}", d) for n, (v, d) in enumerate(lines)], "log string, line_no long, video_id string, text string, done boolean").repartition(5)
    for stretch in (1, 7, 100, 100_000):
        assert {(r.video_id, r.line_no) for r in ss.latest_complete_block(df, stretch).collect()} == brute_blocks(lines), stretch
