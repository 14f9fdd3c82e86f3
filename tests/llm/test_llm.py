"""The training-data operators against brute force, SQL, exact round trips and held-out accuracy; and on odd input."""

import hashlib
import re
import sys
from collections import Counter
from pathlib import Path
from zlib import crc32

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))
from oracle import duck, same  # noqa: E402

from glimpse.llm import ann, common, decontaminate, jaccard, langid, linededup, lm, mixing, quality, queries, tokens, toxicity  # noqa: E402

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, set string"
LONG = " ".join(f"word{i % 977} and" for i in range(30_000))
ODD = [
    (1, None, None, None, None, 1, "x"), (2, "", "en", "a", 0, 1, "x"), (3, "one", "en", "a", 3, 1, "x"), (4, "one two three four five", "en", "b", 3, 1, None),
    (4, "one two three four five", "en", "b", 3, 1, None), (None, "one two three four five", "en", None, 3, 1, None), (5, LONG, "en", "a", 9, None, None), (6, LONG, "fr", "a", 9, None, None),
    (7, "... 123 !!", "en", "c", 1, 1, ""), (8, " \n\t \n", "en", "c", 1, 1, ""), (9, "café über naïve 中文", "fr", "c", 1, 1, ""),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    assert same(queries.QUERIES[name](spark, DIR).toPandas(), duck(DIR).execute(queries.ORACLES[name]).fetchdf()) == ""


def test_word_hashes_are_of_the_words():
    texts = ["Ab aé, ab\x0bAB".encode(), None, b"", b"ab " + "中".encode()]
    w = common.Words(texts, common.SPACED)
    words = [w.word(i) for i in range(len(w.hash))]
    assert words == [x for t in texts for x in (t or b"").lower().split()]
    assert len({*zip(words, w.hash.tolist(), strict=True)}) == len({*words}) == len({*w.hash.tolist()})


def test_contamination_in_blocks_and_on_odd_rows(spark, docs, odd, empty):
    bench = spark.read.parquet(f"{DIR}/benchmark.parquet")
    whole = rows(decontaminate.contamination(docs, bench).orderBy("doc_id"))
    assert whole == rows(decontaminate.contamination(docs, bench, block_bytes=1500).orderBy("doc_id"))
    tiny = spark.createDataFrame([(1, "two three"), (2, None), (3, ""), (None, "one")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(odd, tiny).collect()}
    assert (got[4].n_hit, got[4]["items"], got[4].longest, got[4].contaminated) == (2, ["1"], 2, True)
    assert got[1].n_words == got[2].n_words == 0 and not got[1].contaminated
    kept = decontaminate.decontaminate(odd, tiny)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in ODD if r[1] is None or "two three" not in r[1])
    assert decontaminate.contamination(odd, tiny.limit(0)).count() == len(ODD) and decontaminate.contamination(empty, tiny).count() == 0


def test_mix_meets_targets(spark, docs, odd, empty):
    a, b = (sorted(rows(mixing.taken(docs)), key=str) for _ in range(2))
    assert a == b and len(a) == docs.count()
    by = {}
    for _, source, size, _, target, got in a:
        assert got <= 2 * size
        by.setdefault(source, [target, 0])[1] += got
    assert all(abs(t - n) <= 96 for t, n in by.values())
    assert abs(sum(t for t, _ in by.values()) - 1.5 * sum(r[2] for r in a)) < 1e-3
    out = rows(mixing.taken(odd))
    assert len(out) == len(ODD) and all(r[5] <= 2 * r[2] for r in out) and mixing.taken(empty).count() == 0
    texts = mixing.mixed_texts(docs, block=64)
    total = Counter()
    for r in texts.collect():
        total[r.source] += len(r.text.split())
    want = {r["source"]: r["n"] for r in mixing.taken(docs, block=64).groupBy("source").agg({"taken": "sum"}).withColumnRenamed("sum(taken)", "n").collect()}
    assert dict(total) == {k: v for k, v in want.items() if v}
    assert texts.columns == docs.columns


def test_targets_share_excess_again(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100), (None, 1000)], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    assert got["a"] == 20 and got["b"] == 200 and abs(got[None] - (1.5 * 1110 - 220)) < 1e-9


def test_permutation_is_one(spark):
    from pyspark.sql import functions as F

    got = [r[0] for r in spark.range(1000).select(mixing.permuted(F.col("id"), F.lit(1000), F.lit(5))).collect()]
    assert sorted(got) == [*range(1000)] and got != sorted(got)


def brute_classes(texts, n, percent):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    ids, label = sorted(sets), {i: i for i in sets}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for x in ids:
        for y in ids:
            if x < y and sets[x] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                label[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_jaccard_classes_with_groups_of_near_copies(spark, odd, empty):
    rng = np.random.default_rng(1)
    texts, base = [], [" ".join(f"w{x}" for x in rng.integers(0, 5000, 80)) for _ in range(4)]
    for i in range(160):
        w = base[i % 4].split()
        for _ in range(rng.integers(0, 6)):
            w[rng.integers(0, len(w))] = f"w{rng.integers(0, 5000)}"
        texts.append((i, " ".join(w)))
    texts += [(200 + i, " ".join(f"u{x}" for x in rng.integers(0, 9, 5))) for i in range(60)]
    got = {r[0]: (r[1], r[2]) for r in rows(jaccard.classes(spark.createDataFrame(texts, "doc_id long, text string")))}
    assert got == brute_classes(texts, 4, 85)
    out = {str(r[0]): r[1:] for r in rows(jaccard.classes(odd))}
    assert out["1"] == (0, 1) and out["2"] == (0, 2) and out["6"][1] == 5 and out["4"][1] == 4 and out["8"] == (0, 8) and len(rows(jaccard.classes(odd))) == len(ODD)
    assert jaccard.classes(empty).count() == 0
    kept = jaccard.one_of_each(odd)
    assert kept.columns == odd.columns and "6" not in {str(r.doc_id) for r in kept.collect()}


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 102), (101, 102)], "a long, b long")
    assert {(r.node, r.comp) for r in jaccard.components(e).collect()} == {(i, 0) for i in range(1, 61)} | {(101, 100), (102, 100)}


def test_line_runs(spark, odd, empty, docs):
    line = lambda k: " ".join(f"l{k}w{i}" for i in range(14))
    run = "\n".join(line(k) for k in range(5))
    big = " ".join(f"p{i}" for i in range(60))
    d = [(1, f"{line(90)}\n{run}\n{line(91)}"), (2, f"{line(92)}\n{run}\n{line(93)}"), (3, f"{line(94)}\n{line(0)}\n{line(95)}"), (4, f"{big}\n{line(96)}"), (5, f"{line(97)}\n{big}"), (6, None), (7, run + "\n" + run)]
    out = {r.doc_id: r for r in linededup.dedup(spark.createDataFrame(d, "doc_id long, text string"), counts=True).collect()}
    assert out[1].text == d[0][1] and out[2].text == f"{line(92)}\n{line(93)}" and out[3].text == d[2][1]
    assert out[4].text == d[3][1] and out[5].text == line(97) and out[6].text is None and out[7].n_deleted == 10
    got = linededup.dedup(odd)
    assert got.columns == odd.columns and got.count() == len(ODD) and linededup.dedup(empty).count() == 0
    # every line's first place stays, and whatever goes stands in an earlier place
    texts = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    gone = {r["__id"]: {*r["gone"]} for r in linededup.deleted_lines(docs).collect()}
    seen = set()
    for i, t in texts:
        for k, x in enumerate((t or "").split("\n")):
            assert k not in gone.get(i, ()) or x in seen
            seen.add(x)


def test_winnowing_guarantee():
    rng = np.random.default_rng(0)
    for _ in range(50):
        mk = lambda n: (rng.integers(0, 2**62, n), rng.integers(1, 20, n))
        sh, sw = mk(12)
        pieces = []
        for _ in range(2):
            (ah, aw), (bh, bw) = mk(5), mk(7)
            pieces.append((np.concatenate([ah, sh, bh]), np.concatenate([aw, sw, bw])))
        a, b = ({g for g, _ in linededup.fingerprints(h, w, 25, 50)} for h, w in pieces)
        assert sw.sum() < 50 or a & b


def test_language_is_found(spark, docs, odd, empty):
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    held = [r for r in docs.collect() if got[r.doc_id].held_out and r.text]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert all(got[r.doc_id].held_out == (crc32(str(r.doc_id).encode()) % 5 == 0) for r in docs.collect())
    out = {str(r[0]): r for r in rows(langid.identify(odd))}
    assert out["1"][2] == out["2"][2] == out["7"][2] == out["8"][2] == "und" and out["9"][2] in ("en", "fr") and langid.identify(empty).count() == 0
    assert langid.keep_known(odd).columns == odd.columns


def test_forward_sums_all_segmentations():
    vocab = {x: i for i, x in enumerate(["▁", "a", "b", "ab", "▁a", "ba"])}
    p = np.array([[0.1], [0.2], [0.15], [0.05], [0.3], [0.1], [0.0], [1e-7]])

    def brute(s):
        return 1.0 if not s else sum(p[vocab[s[:k]], 0] * brute(s[k:]) for k in range(1, len(s) + 1) if s[:k] in vocab)

    words = ["a", "ab", "abba", "bab"]
    assert np.allclose(langid.Lattice(words, vocab).log_probability(p)[:, 0], [np.log(brute("▁" + w)) for w in words])


def test_shards_round_trip(spark, docs, odd, empty):
    enc = tokens.encoder()
    for d in (docs, odd):
        d = common.stage(d, "t")
        m = tokens.materialise(d, length=64, shard_slots=50).toPandas().sort_values("sequence")
        ids = np.frombuffer(b"".join(m.tokens), np.uint16)
        want = np.frombuffer(enc.encode([None if r.text is None else r.text.encode() for r in d.collect()]), np.uint16)
        assert (ids[: len(want)] == want).all() and (ids[len(want) :] == enc.end).all() and len(ids) - len(want) < 64
        assert sorted(m.slot) == [*range(len(m))] and (m.offset == m.slot % 50 * 129).all()
    assert tokens.materialise(empty).count() == 0


def test_slots_permute():
    for n in (1, 2, 3, 1000):
        s = tokens.slot_of(np.arange(n), n, 7)
        assert sorted(s.tolist()) == [*range(n)] and (tokens.slot_of(s, n, 7, back=True) == np.arange(n)).all()


def test_lm_base_and_normalisation(spark, docs, odd, empty):
    texts = [(r.doc_id, (r.text or "").encode().lower().split()) for r in docs.collect()]
    train = [w for i, w in texts if crc32(str(i).encode()) % 5 != 1]
    c = Counter(x for w in train for x in w)
    n, v = sum(c.values()) + len(train), len(c) + 1
    got = {r.doc_id: r for r in lm.score(docs, frequent=1e-3).collect()}
    for i, w in texts:
        want = sum(np.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w) + np.log10((len(train) + 0.5) / (n + 0.5 * (v + 1)))
        r = got[i]
        assert (r.n_tokens, r.train_tokens) == (len(w) + 1, n) and r.n_known == 1 + sum(x in c for x in w) and abs(r.base_score - want) < 1e-6 * (1 + abs(want))
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held) > 0.02
    assert len(rows(lm.score(odd))) == len(ODD) and lm.score(empty).count() == 0


def test_lm_is_normalised_and_learns_contexts_of_several_units():
    rng = np.random.default_rng(0)
    short = np.sort(rng.integers(0, 2**63, 40).astype(np.uint64))
    units = lm.Units(short, rng.integers(1, 99, 40), rng.integers(0, 50, 8).astype(float), 30)
    everything, t = np.arange(49, dtype=np.uint16), lm.Trainer(units, None, 1, rate=0.3)
    assert np.isclose(np.exp(t.m.log_probability(everything, np.full((lm.SPAN, 49), 3, np.uint16))).sum(), 1)
    # the next unit is the one three steps before: one word of context can't tell it
    y = np.tile(rng.integers(0, 49, 3000), 1).astype(np.uint16)
    y = np.concatenate([np.tile(y[i : i + 3], 4) for i in range(0, 3000, 3)])
    before = np.stack([np.roll(y, j) for j in (1, 2, 3)])
    first = t.m.log_probability(y, before).mean()
    for _ in range(40):
        t.go_through(y, before)
    assert np.isclose(np.exp(t.m.log_probability(everything, np.full((lm.SPAN, 49), 3, np.uint16))).sum(), 1)
    assert t.m.log_probability(y, before).mean() > first + 1


@pytest.mark.parametrize(("module", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers(spark, odd, empty, module, label):
    d, y = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = module.score(d, y).where("held_out").join(y, "doc_id").toPandas()
    assert (got.predicted == got[label]).mean() > 0.93 and got.score.between(0, 1).all()
    assert got.score[got[label] == 1].mean() > got.score[got[label] == 0].mean() + 0.3
    assert module.score(odd, y).count() == len(ODD) and module.score(empty, y).count() == 0 and module.score(odd, y.limit(0)).count() == len(ODD)


def test_nearest_neighbours(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    data = {r.vec_id: np.array(r.embedding, float) for r in e.collect()}
    ids, x = np.array([*data]), np.stack([*data.values()])
    got = {}
    for r in ann.search(e).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hit = 0
    for q, found in got.items():
        s = x @ data[q]
        best = {int(i) for i in ids[np.lexsort((ids, -s))] if i != q and True}
        best = [int(i) for i in ids[np.lexsort((ids, -s))] if i != q][:20]
        found.sort()
        assert [f[0] for f in found] == [*range(1, 21)] and all(abs(f[2] - data[q] @ data[f[1]]) < 1e-9 for f in found)
        hit += len({*best} & {f[1] for f in found})
    assert len(got) == sum(i % 20 == 0 for i in data) and hit >= 0.9 * 20 * len(got)


def test_odd_vectors(spark):
    v = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [1.0]), (7, [3.0, 0.0]), (None, [1.0, 1.0]), (8, [1.0, 2.0])]
    d = spark.createDataFrame(v, "vec_id long, embedding array<float>")
    assert rows(ann.search(d).orderBy("rank")) == [(0, 1, 1, 5.0), (0, 2, 8, 5.0), (0, 3, 7, 3.0)]
    assert ann.search(d.limit(0)).count() == 0


def test_rows_of_one_id_are_vectors_of_their_own(spark):
    d = spark.createDataFrame([(0, [1.0, 2.0]), (0, [5.0, 5.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    got = sorted(map(tuple, ann.search(d).collect()))
    # each row of id 0 is asked and finds the other one
    assert got == [(0, 1, 0, 15.0), (0, 1, 0, 15.0), (0, 2, 1, 3.0), (0, 2, 1, 10.0)]


def test_recall_where_few_are_reranked(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(20_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    d = spark.createDataFrame(pd.DataFrame({"vec_id": range(len(x)), "embedding": x.tolist()}), "vec_id long, embedding array<double>")
    got = {}
    # blocks small enough for several tiles in a partition
    for r in ann.search(d, every=200, query_block=50, code_block=3000, tasks=3).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = 0
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(found & {*np.argsort(-s)[:20].tolist()})
    assert len(got) == 100 and hit >= 0.95 * 20 * len(got)


def test_nearest_of_vectors_that_codes_do_not_tell_apart(spark):
    """Near copies, all about one direction, of very different lengths, many equal ones in any order of ids, and products out of range."""
    rng = np.random.default_rng(4)
    kinds = {
        "near copies": rng.normal(size=(5, 32)).repeat(600, 0) + 1e-4 * rng.normal(size=(3000, 32)),
        "one direction": 1e-3 * rng.normal(size=(3000, 32)) + rng.normal(size=32),
        "lengths": rng.normal(size=(3000, 32)) * rng.lognormal(0, 3, size=(3000, 1)),
        "copies": np.concatenate([np.ones((2500, 32)), rng.normal(size=(500, 32))]),
        "tiny": rng.normal(size=(300, 7)) * 1e-170,
    }
    for kind, x in kinds.items():
        p = rng.permutation(len(x))
        d = spark.createDataFrame(pd.DataFrame({"vec_id": p, "embedding": x[p].tolist()}), "vec_id long, embedding array<double>")
        got = {}
        for r in ann.search(d, every=100, query_block=20, code_block=1000).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert len(got) == len(x) // 100
        for q, found in got.items():
            s = sum(x[q, c] * x[:, c] for c in range(x.shape[1]))
            assert found == [(int(i), s[i]) for i in np.lexsort((np.arange(len(x)), -s)) if i != q][:20], kind


def test_hash_digest_of_no_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442") and re.fullmatch(r"op\d+_\w+", next(iter(queries.QUERIES)))
