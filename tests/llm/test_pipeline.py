"""Each stage of the corpus pipeline on rows made for it: nulls, empty and repeated rows, clashing column names, empty tables."""

import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parents[2]))
import corpus_pipeline  # noqa: E402

from glimpse.llm import jaccard, mixing, quality, tokens  # noqa: E402

#: Columns named as the operators name theirs.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _n long, _parts string, row string, size int, `set` string, i long, t string, copy int, __mix_n int"
STAGE = dict(corpus_pipeline.STAGES)


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, "p", "r", 2, "s", 3, "t", 4, 5) for i, t, s in rows], SCHEMA)


def words(rng, n):
    return " ".join(f"w{x}" for x in rng.integers(0, 4000, n))


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(2)
    return [words(rng, 90) for _ in range(6)]


def kept(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_near_duplicates_are_judged_by_row(spark, texts):
    a, b, c, d = texts[:4]
    near = " ".join(x if k != 40 else "changed" for k, x in enumerate(b.split()))
    rows = [(1, a, "x"), (2, a, "x"), (2, b, "x"), (5, near, "x"), (7, c, "x"), (7, c, "x"), (None, d, "x"), (9, d, None), (None, None, None), (10, "", "x"), (10, "", "x"), (11, " \n", "x")]
    got = kept(STAGE["near_duplicates"](spark, table(spark, rows), None))
    # a class keeps its smallest id; class b was lost where ids alone were judged; wordless rows all stay
    assert got == Counter([(1, a), (2, b), (7, c), (9, d), (None, None), (10, ""), (10, ""), (11, " \n")])
    out = STAGE["near_duplicates"](spark, table(spark, rows), None)
    assert out.columns == table(spark, rows).columns and out.where("size = 2 and i = 3 and copy = 4").count() == 8
    assert jaccard.one_of_each(table(spark, [])).count() == 0


def test_near_duplicates_take_five_words_and_four_fifths(spark, texts):
    base = texts[0].split()
    rows, shared = [(0, texts[0], "x")], {}
    for k in range(1, 8):  # k changed words far apart, each in five shingles of 86
        w = list(base)
        for j in range(k):
            w[5 + 11 * j] = f"z{k}x{j}"
        rows.append((k, " ".join(w), "x"))
        shared[k] = 86 - 5 * k
    want = {0} | {k for k, n in shared.items() if 100 * n < 80 * (172 - n)}
    got = {r.doc_id for r in jaccard.one_of_each(table(spark, rows)).collect()}
    # those beyond the threshold link with nobody: they differ from each other by more still
    assert got == want and 1 < len(want) < 8


def test_mixture_keeps_columns_and_takes_what_it_says(spark, texts):
    rows = [(k, texts[k % 6] + f" {k}", "abc"[k % 3]) for k in range(40)] + [(None, texts[0], None), (300, None, "a"), (400, "", "a"), (40, texts[1], "b"), (40, texts[1], "b")]
    d = table(spark, rows)
    taken = mixing.taken(d).collect()
    assert len(taken) == len(rows)
    want = Counter()
    for r in taken:
        want[(r.doc_id, r.source)] += r.taken
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sum(len((t or "").split()) for _, t, s in rows if s == r.source)
    out = STAGE["mixture"](spark, d, None)
    assert out.columns == d.columns
    got = Counter()
    whole = {(i, s): t for i, t, s in rows}
    for r in out.collect():
        got[(r.doc_id, r.source)] += len(r.text.split())
        assert set(r.text.split()) <= set((whole[(r.doc_id, r.source)] or "").split()) and r.n_chars == len(r.text) and (r._n, r.row, r.__mix_n if hasattr(r, "__mix_n") else 5) == (1, "r", 5)
    assert got == Counter({k: v for k, v in want.items() if v})
    assert STAGE["mixture"](spark, table(spark, []), None).count() == 0


def test_benchmark_and_language_stages_leave_clean_rows(spark, texts, tmp_path):
    spark.createDataFrame([(1, " ".join(texts[0].split()[:30])), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, texts[0], "x"), (2, texts[1], "x"), (None, None, None), (3, "", "x"), (4, texts[0], "y")]
    assert kept(STAGE["benchmark"](spark, table(spark, rows), str(tmp_path))) == Counter([(2, texts[1]), (None, None), (3, "")])
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = STAGE["language"](spark, docs, None)
    assert out.columns == docs.columns and out.count() >= 0.95 * docs.where("text is not null and length(text) > 20").count()
    assert STAGE["language"](spark, table(spark, []), None).count() == 0


def test_token_stage_covers_all_text(spark, texts):
    d = table(spark, [(k, t, "x") for k, t in enumerate(texts)] + [(9, None, None), (10, "", "x")]).coalesce(1)
    m = tokens.materialise(d, length=32, shard_slots=3).toPandas().sort_values("sequence")
    ids = np.frombuffer(b"".join(m.tokens), np.uint16)
    want = np.frombuffer(tokens.encoder().encode([*(t.encode() for t in texts), None, b""]), np.uint16)
    assert (ids[: len(want)] == want).all() and (m.slot // 3 == m.shard).all()
    s = STAGE["token_shards"](spark, d, None)
    assert s.columns == ["slot", "shard", "offset", "sequence", "sha256"] and s.count() >= 1


def test_class_prior_from_positives_and_unlabelled():
    rng = np.random.default_rng(0)
    for share in (0.2, 0.6, 0.9):
        p = rng.normal(0, 1, (3000, 4))
        u = np.where(rng.random((6000, 1)) < share, rng.normal(0, 1, (6000, 4)), rng.normal(2.5, 1, (6000, 4)))
        assert abs(quality.class_prior(p, u) - share) < 0.08
