"""Repeated passages against brute force, and what is left of lines."""

import numpy as np
import pytest

from glimpse.llm import passages


def _brute(texts, run=50):
    """Words deleted in each text: those in a window of ``run`` words that begins earlier too."""
    seen, gone = set(), {}
    for d, t in enumerate(texts):
        w = t.lower().split()
        for i in range(len(w) - run + 1):
            key = tuple(w[i : i + run])
            if key in seen:
                gone.setdefault(d, set()).update(range(i, i + run))
            seen.add(key)
    return gone


def _texts(seed, vocabulary):
    rng = np.random.default_rng(seed)
    word = lambda n: [f"w{x}" for x in rng.integers(0, vocabulary, n)]
    source = [word(int(n)) for n in (49, 50, 51, 80, 200)]
    texts = []
    for _ in range(40):
        w = word(rng.integers(0, 30))
        for _ in range(rng.integers(1, 4)):
            s = list(source[rng.integers(0, 5)])
            a = rng.integers(0, max(1, len(s) - 45))
            s = s[a : a + rng.integers(45, 120)]
            if rng.random() < 0.4:
                s[rng.integers(0, len(s))] = "edit"
            w += s + word(rng.integers(0, 20))
        texts.append("".join(x + rng.choice([" ", "\n", "  ", "\t"], p=[0.8, 0.1, 0.05, 0.05]) for x in w))
    return [*texts, texts[3], texts[3], "same " * 130, "a b " * 90, ""]


@pytest.mark.parametrize(("seed", "vocabulary"), [(1, 10_000), (2, 30), (3, 1)])
def test_words_deleted_are_those_of_windows_that_begin_earlier(spark, seed, vocabulary):
    texts = _texts(seed, vocabulary)
    got = {}
    for r in passages.repeated(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect():
        got.setdefault(r["__id"], set()).update(range(r["from"], r["to"]))
    want = _brute(texts)
    assert got == want and len(want) > 5


def test_runs_inside_lines_and_across_them_go(spark):
    run = " ".join(f"r{i}" for i in range(60))
    broken = run.replace("r20 ", "r20\n").replace("r40 ", "R40\n\n")
    texts = [f"one {run} two", f"three\nfour {broken} five\nsix", f"{run}\nseven", f"seven\n{run}"]
    docs = spark.createDataFrame([(*x, "k", 7) for x in enumerate(texts)], "doc_id long, text string, n_lines string, __id long")
    got = passages.dedup_passages(docs, counts=True)
    assert got.columns == ["doc_id", "text", "n_lines", "__id", "n_lines_", "n_deleted", "n_words_deleted"]
    rows = [tuple(r) for r in got.orderBy("doc_id").collect()]
    assert [r[1] for r in rows] == [texts[0], "three\nfour \nfive\nsix", "seven", "seven"]
    # document 1 has six lines, one of them empty; four are left
    assert [r[4:] for r in rows] == [(1, 0, 0), (6, 2, 60), (2, 1, 60), (2, 1, 60)] and all(r[2:4] == ("k", 7) for r in rows)


def test_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(5000))
    docs = spark.createDataFrame([(1, long), (1, long), (2, None), (3, ""), (None, long), (None, None), (4, "ß" + long), (5, " \n ")], "doc_id long, text string")
    got = sorted(((r.doc_id if r.doc_id is not None else 9, r.text, r.n_words_deleted) for r in passages.dedup_passages(docs, counts=True).collect()), key=str)
    # equal rows are one document; the null id comes last; document 4 differs in its first word alone
    assert got == sorted([(1, long, 0), (1, long, 0), (2, None, 0), (3, "", 0), (9, "", 5000), (9, None, 0), (4, "ßx0", 4999), (5, " \n ", 0)], key=str)
    assert passages.dedup_passages(docs.limit(0), counts=True).count() == 0


def test_equal_windows_have_equal_fingerprints():
    rng = np.random.default_rng(4)
    w = [f"w{x}" for x in rng.integers(0, 9, 400)]
    a, b = (passages.Words([" ".join(x).encode()], passages.SPACED) for x in (["a"] * 77 + w, w + ["b"] * 33))

    def of(words, at):
        _, lo, hi, gram, _ = passages.fingerprint_spans(words, 16, 50)
        i = np.flatnonzero((lo <= at) & (at + 50 <= hi))
        return {int(x) for x in gram[i]}

    assert all(of(a, 77 + i) & of(b, i) for i in range(351))
