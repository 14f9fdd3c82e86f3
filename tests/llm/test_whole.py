"""Cases in which an operator once did less than its whole job."""

import sys
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))
from oracle import same  # noqa: E402

from glimpse.llm import common, decontaminate, langid, linededup, lm, queries  # noqa: E402


@pytest.mark.parametrize("n_words", [100, 127, 300, 511])
def test_short_benchmark_items_are_found_in_vocabularies_of_any_size(spark, tmp_path, n_words):
    # one text of each word, which sets the vocabulary, and short items of 1 to 12 words, some of one word over and over
    rng = np.random.default_rng(n_words)
    words = [f"w{i}" for i in range(n_words)]
    items = [" ".join(words), *(" ".join(rng.choice(words, k)) for k in range(1, 13) for _ in range(3)), *(" ".join([w] * k) for w in words for k in (2, 13))]
    docs = [" ".join([*(f"x{x}" for x in rng.integers(0, 99, 5)), items[i], *(f"x{x}" for x in rng.integers(0, 99, 20))]) for i in range(1, len(items))]
    pd.DataFrame({"item_id": range(len(items)), "text": items}).to_parquet(tmp_path / "benchmark.parquet")
    pd.DataFrame({"doc_id": range(len(docs)), "text": docs}).to_parquet(tmp_path / "documents.parquet")
    c = duckdb.connect()
    for t in ("benchmark", "documents"):
        c.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    got = queries.QUERIES["op1_decontamination"](spark, str(tmp_path)).toPandas()
    assert same(got, c.execute(queries.ORACLES["op1_decontamination"]).fetchdf()) == "" and (got.n_hit > 0).all()


@pytest.mark.parametrize("block", [3, 7, 512])
def test_segmentations_of_long_words_are_summed_whole(monkeypatch, block):
    monkeypatch.setattr(langid, "BLOCK", block, raising=False)
    vocab = {x: i for i, x in enumerate(["▁", "a", "b", "ab", "▁a", "ba", "abababababab", "bbbbbbbbbb"])}
    rng = np.random.default_rng(0)
    p = np.concatenate([rng.uniform(0.01, 0.3, (len(vocab), 2)), [[0.0, 0.0], [1e-7, 1e-6]]])
    words = ["", "a", "c", "ab" * 15, "b" * 50, *("".join(rng.choice([*"abc"], n, p=[0.45, 0.45, 0.1])) for n in (5, 9, 20, 21, 40, 57, 64))]
    weight = rng.uniform(1, 9, (len(words), 2))
    log, counts = [], np.zeros_like(p)
    for w, weights in zip(("▁" + w for w in words), weight, strict=True):
        arcs = [(s, e, vocab.get(w[s:e], len(vocab) + 1)) for s in range(len(w)) for e in range(s + 1, len(w) + 1) if w[s:e] in vocab or e == s + 1]
        a, b = np.zeros((2, len(w) + 1, 2))
        a[0] = b[-1] = 1
        for s, e, i in sorted(arcs, key=lambda x: x[1]):
            a[e] += a[s] * p[i]
        for s, e, i in sorted(arcs, key=lambda x: -x[0]):
            b[s] += b[e] * p[i]
        log.append(np.log(a[-1]))
        for s, e, i in arcs:
            counts[i] += a[s] * p[i] * b[e] / a[-1] * weights
    lattice = langid.Lattice(words, vocab)
    assert np.allclose(lattice.log_probability(p), log) and np.allclose(lattice.expected(p, weight), counts)
    # far below the least double
    assert np.allclose(langid.Lattice(["c" * 5000], vocab).log_probability(p), np.log(p[0]) + 5000 * np.log(p[-1]))


def test_text_beyond_a_words_first_characters_counts():
    pieces = langid.load_pieces()
    assert max(map(len, pieces)) > 8
    model = langid.learn([("x", "中" * 20 + "文字" * 30, 50), ("y", "中" * 20 + "日本" * 30, 50)], pieces)
    texts = [("中" * 20 + end * 200).encode() for end in ("文字", "日本")]
    lang, score = langid.score_texts(texts, model, {}, [])
    assert lang == ["x", "y"] and min(score) > 0.99


def _line(name, n):
    return " ".join(f"{name}w{i}" for i in range(n))


def _deduped(spark, texts):
    return {r.doc_id: r.text for r in linededup.dedup(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()}


def test_shared_runs_below_the_least_length_stay(spark):
    # each length many times, as only some hashes made a fingerprint of the shared line
    runs = [[_line(f"r{k}x{n}", n)] if k % 2 else [_line(f"r{k}x{n}", n - 15), _line(f"s{k}x{n}", 15)] for n in (30, 40, 49) for k in range(6)]
    texts = ["\n".join([_line(f"a{side}{k}", 30), *run, _line(f"b{side}{k}", 30)]) for side in "xy" for k, run in enumerate(runs)]
    assert _deduped(spark, texts) == dict(enumerate(texts))


def test_runs_are_found_behind_other_first_places(spark):
    # document 0 holds one line each of the runs that 1 and 2 share, each with some fingerprint's first place
    a = [_line(f"a{k}", 27) for k in range(20)]
    runs = ["\n".join([a[k], _line(f"m{k}", 30)]) for k in range(20)]
    apart = lambda side, parts: "\n".join(x for k, p in enumerate(parts) for x in (_line(f"{side}{k}", 8), p))
    texts = [apart("x", a), apart("y", runs), apart("z", [*runs, "end"])]
    assert _deduped(spark, texts) == {0: texts[0], 1: texts[1], 2: "\n".join([*(_line(f"z{k}", 8) for k in range(21)), "end"])}


def test_deleted_lines_are_those_of_all_repeated_runs(spark):
    rng = np.random.default_rng(5)
    pool = [_line(f"p{k}", n) for k, n in enumerate([*range(1, 25), 30, 55])] + ["", " "]
    texts = ["\n".join(rng.choice(pool, 12)) for _ in range(20)]
    for _ in range(40):
        x, y = (texts[i].split("\n") for i in rng.integers(0, len(texts), 2))
        i, j, n = *rng.integers(0, 6, 2), rng.integers(1, 8)
        texts.append("\n".join([*y[:j], *x[i : i + n], *y[j:]]))
    lines = [t.split("\n") for t in texts]
    want = {}
    for d, mine in enumerate(lines):
        for e, theirs in enumerate(lines[: d + 1]):
            for i in range(len(mine)):
                for k in range(i if e == d else len(theirs)):
                    n = 0
                    while i + n < len(mine) and k + n < len(theirs) and mine[i + n] == theirs[k + n]:
                        n += 1
                    if sum(len(x.split()) for x in mine[i : i + n]) >= 50:
                        want.setdefault(d, set()).update(range(i, i + n))
    got = {r["__id"]: {*r["gone"]} for r in linededup.deleted_lines(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()}
    assert got == want and want


def _brute_contamination(docs, items, window=13):
    out = {}
    for d, t in enumerate(docs):
        w, hit, names, longest = (t or "").split(), set(), set(), 0
        for i, item in enumerate(items):
            x = (item or "").split()
            k = min(window, len(x))
            for a in range(len(x) - k + 1 if x else 0):
                for p in range(len(w) - k + 1):
                    if w[p : p + k] == x[a : a + k]:
                        hit |= {*range(p, p + k)}
                        names.add(str(i))
                        n = k
                        while a + n < len(x) and p + n < len(w) and x[a + n] == w[p + n]:
                            n += 1
                        longest = max(longest, n)
        out[d] = (len(w), len(hit), sorted(names), longest)
    return out


@pytest.mark.parametrize("how", [{}, {"block_bytes": 300}, {"block_bytes": 300, "pass_bytes": 900}])
def test_contamination_against_brute_force(spark, how):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(12)]
    items = [" ".join(rng.choice(words, n)) for n in range(1, 41)] + ["w0 " * 30, "w0 w1 " * 20, None, "", "w3 " * 13, "w3 " * 13]
    docs = [None, "", "w0 " * 60, "w1 w0 " * 40, " ".join(rng.choice(words, 300))]
    for k in range(25):
        x = items[rng.integers(12, 40)].split()
        a = rng.integers(0, 6)
        docs.append(" ".join([*rng.choice([*words, "zz"], 30), *x[a:], *x[:5], *rng.choice([*words, "zz"], 30)]))
    b = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    d = spark.createDataFrame([*enumerate(docs)], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"], r.longest) for r in decontaminate.contamination(d, b, **how).collect()}
    assert got == _brute_contamination(docs, items)


def test_repetitive_texts_are_not_spelled_out(spark):
    d = spark.createDataFrame([(1, "a " * 200_000)], "doc_id long, text string")
    b = spark.createDataFrame([(k, "a " * (400 + k)) for k in range(20)] + [(99, "a " * 5)], "item_id long, text string")
    r = decontaminate.contamination(d, b).first()
    assert (r.n_words, r.n_hit, r.n_items, r.longest) == (200_000, 200_000, 21, 419)


def test_line_dedup_keeps_columns_of_any_name(spark):
    line = " ".join(f"w{i}" for i in range(60))
    rows = [(k, f"own {k}\n{line}", k * 10, "a", 7, "g", k) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __id long, gone string, n_lines long, `row` string, `c.d` long")
    got = linededup.dedup(docs, counts=True)
    assert got.columns == [*docs.columns, "n_lines_", "n_deleted"]
    assert sorted(map(tuple, got.collect())) == [(k, t if k == 0 else f"own {k}", *rest, 2, int(k > 0)) for k, t, *rest in rows]
    assert linededup.dedup(docs).columns == docs.columns


def test_scores_of_a_text_are_summed_over_its_tokens():
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(60)]
    text = " ".join(rng.choice(words, 300)).encode()
    known = common.Words([" ".join(words[:40]).encode()], common.SPACED).hash
    units = lm.Units(np.sort(known), rng.integers(1, 99, 40), rng.integers(0, 50, 8).astype(float), 30)
    t = lm.Trainer(units, None, 1)
    w = common.Words([text], common.SPACED)
    y, before, place, other = units.sequence(w)
    t.go_through(y, before)
    m = t.m
    # by hand: three units before each, ends where the text has none; a class, then a unit of it
    seq, total = [*y.tolist()], 0.0
    assert len(seq) == 301 and seq[-1] == units.end and other.sum() == sum(int(x[1:]) >= 40 for x in text.decode().split())
    for i, u in enumerate(seq):
        h = sum(m.context[seq[i - j] if i >= j else units.end].astype(float) * m.position[j - 1] for j in range(1, lm.SPAN + 1))
        s = np.exp(m.classes.astype(float) @ h + m.class_bias)
        k = u // units.width
        lo, hi = units.edges[k], units.edges[k + 1]
        e = np.exp(m.target[lo:hi].astype(float) @ h + m.bias[lo:hi])
        total += np.log(s[k] / s.sum()) + np.log(e[u - lo] / e.sum())
    assert abs(m.log_probability(y, before).sum() - total) < 1e-3 * abs(total)


def test_more_units_than_two_bytes_hold():
    short = np.sort(np.random.default_rng(0).integers(0, 2**63, 70_000).astype(np.uint64))
    units = lm.Units(short, np.ones(70_000, np.int64), np.zeros(4), 1)
    assert len({*units.of_short.tolist(), *units.of_bucket.tolist(), int(units.end)}) == 70_005


def test_what_is_learnt_does_not_hang_on_partitions(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    gain = []
    for n in (1, 8):
        held = [r for r in lm.score(docs.repartition(n), share=2e-4).collect() if r.held_out]
        gain.append(sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held))
    assert min(gain) > 0.05 and abs(gain[0] - gain[1]) < 0.02
