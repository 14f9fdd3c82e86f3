"""Sharding along the curve, the Merkle manifest and spelling variants: against brute force and on odd rows."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import product
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from glimpse.llm import common, merkle, sharding, variants

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pos int, n string, node string"
LONG = " ".join(f"wordsand{'abcdefgh'[i % 8]}{'xyzq' * (i % 5)} and" for i in range(20_000))
ODD = [
    (1, None, None, None, None, 1, "x", None), (2, "", "en", "a", 0, 1, "x", "y"), (3, "Threeful threeful", "en", "a", 3, 1, "x", ""), (4, "one two", "en", "b", 3, 1, None, None),
    (4, "one two", "en", "b", 3, 1, None, None), (None, "Threeful", "en", None, 3, 1, None, None), (5, LONG, "en", "a", 9, None, None, None), (6, LONG, "fr", "a", 9, None, None, None),
    (7, "... 123 !!", "en", "c", 1, 1, "", None), (9, "caféines ÜBERLÄUFER überläufer ×÷×÷×÷×", "fr", "c", 1, 1, "", None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- positions and the curve --------------------------------------------------------------------------------------------


def test_positions_count_within_groups(spark):
    rows = [(g, k, k % 3) for g in ("a", "b", None) for k in range(40)] + [("hot", 7, 1)] * 200
    df = spark.createDataFrame(rows, "g string, k long, w long").repartition(5)
    got = common.positions(df, "t", ["g"], ["k"], weight="w").collect()
    for g in ("a", "b", None, "hot"):
        of = sorted((r for r in got if r.g == g), key=lambda r: r.pos)
        assert [r.pos for r in of] == list(range(len(of))) and {r.n for r in of} == {len(of)}
        assert [r.k for r in of] == sorted(r.k for r in of)
        assert [r.before for r in of] == [sum(x.w for x in of[:i]) for i in range(len(of))] and {r.total for r in of} == {sum(x.w for x in of)}


@pytest.mark.parametrize("dims,bits", [(1, 4), (2, 3), (3, 3), (4, 2)])
def test_curve_visits_each_cell_once_by_single_steps(spark, dims, bits):
    names = [f"a{i}" for i in range(dims)]
    points = spark.createDataFrame(list(product(range(1 << bits), repeat=dims)), ", ".join(f"{c} int" for c in names))
    got = sorted(points.withColumn("h", sharding.curve_index(F.array(*names), dims, bits)).collect(), key=lambda r: r.h)
    assert [r.h for r in got] == list(range(1 << (dims * bits)))
    for a, b in zip(got, got[1:], strict=False):
        assert sum(abs(a[c] - b[c]) for c in names) == 1


def test_cells_hold_about_equally_many_rows(spark):
    rows = spark.createDataFrame([(i,) for i in range(1000)] + [(5000,)] * 1000 + [(None,)] * 10, "d0 long")
    found = sharding.cuts(rows, "d0", 3)
    cells = Counter(r.c for r in rows.select(sharding.cell_of(F.col("d0"), found).alias("c")).collect())
    assert cells[found[-1][0]] >= 1000 and max(v for k, v in cells.items() if k != found[-1][0]) <= 2010 / 8 + 10
    assert rows.where("d0 is null").select(sharding.cell_of(F.col("d0"), found).alias("c")).distinct().collect()[0].c == 0


@pytest.mark.parametrize("law", ["rows", "bytes"])
def test_shards_are_near_equal_runs(spark, law):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sharding.shard(docs, 40, law=law).collect()
    size = {r.doc_id: 16 + len((r.text or "").encode()) for r in docs.collect()}
    assert {r.doc_id: r.size for r in got} == size and {r.law for r in got} == {law}
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(40))
    if law == "rows":
        assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    else:
        total = Counter()
        for r in got:
            total[r.shard] += r.size
        assert max(abs(v - sum(size.values()) / 40) for v in total.values()) <= max(size.values())


def test_shards_prune_by_several_columns(spark, tmp_path):
    """A filter on a source, or a narrow one on lengths, meets far fewer shards than there are, and files come back whole."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sharding.write_shards(docs, f"{tmp_path}/out", 40)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(tuple, back.drop("_shard").select(*docs.columns).collect())) == sorted(map(tuple, docs.collect()))
    assert back.where("source = 'src7'").select("_shard").distinct().count() <= 16
    assert back.where("n_chars < 300").select("_shard").distinct().count() <= 24


def test_shards_of_odd_rows(spark, odd, empty, tmp_path):
    got = sharding.shard(odd, 3).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in ODD) and sorted(Counter(r.shard for r in got).values()) == [3, 3, 4]
    assert {r.doc_id: r.text_crc32 for r in got}[9] == crc32(ODD[-1][1].encode()) and {r.doc_id: r.size for r in got}[1] == 16
    assert sharding.shard(empty).count() == sharding.shard(empty, law="bytes").count() == 0
    assert len(sharding.shard(odd, 3, law="bytes").collect()) == len(ODD)
    sharding.write_shards(odd, f"{tmp_path}/odd", 3)
    assert spark.read.parquet(f"{tmp_path}/odd").count() == len(ODD)


# --- manifest ---------------------------------------------------------------------------------------------------------


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of rows (doc_id, text, lang, source, n_chars)."""
    part = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: H(part(r[0]), part(r[3]), part(r[2]), part(r[4]), part(text))
    upper = lambda t: t and re.sub("[A-Z]", lambda m: m[0].lower(), t)

    def climb(nodes):
        """The top and each node's steps (left, right)."""
        ways, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for i, p in enumerate(at):
                run = nodes[p // 8 * 8 : p // 8 * 8 + 8]
                ways[i].append(("".join(run[: p % 8]), "".join(run[p % 8 + 1 :])))
            nodes, at = [H(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)], [p // 8 for p in at]
        return nodes[0], ways

    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    tops, out = {}, []
    for g, of in groups.items():
        of.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        tops[g] = climb([leaf(r, r[1]) for r in of])
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    root, above = climb([tops[g][0] for g in names])
    for g in names:
        for r, way in zip(groups[g], tops[g][1], strict=True):
            way = way + above[names.index(g)]
            d = leaf(r, upper(r[1]) if r[0] is not None and crc32(str(r[0]).encode()) % 3 == 0 else r[1])
            for left, right in way:
                d = H(left, d, right)
            out.append((r[0], leaf(r, r[1]), tops[g][0], root, H(*[x for s in way for x in s]), d, d == root))
    return sorted(out, key=str)


def verified(df):
    low = F.translate("text", variants.UPPER, variants.LOWER)
    return sorted(map(tuple, merkle.verify(df, F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, low).otherwise(F.col("text"))).collect()), key=str)


@pytest.mark.parametrize("n,langs", [(1, 1), (7, 1), (8, 1), (9, 2), (65, 1), (600, 3), (90, 20)])
def test_manifest_against_brute_force(spark, n, langs):
    rows = [(i * 37 % 1000, f"Text {i}", None if i % langs == 0 else f"l{i % langs}", f"s{i % 4}", i) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    assert verified(df) == brute_manifest(rows)


def test_manifest_of_odd_rows(odd, empty):
    assert verified(odd) == brute_manifest([r[:5] for r in ODD])
    assert verified(empty) == []


def test_a_changed_row_changes_the_root(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "en", "s", 1) for i in range(100)], "doc_id long, text string, lang string, source string, n_chars long")
    first = lambda df: df.select("root").first()[0]
    assert first(merkle.manifest(docs)) == first(merkle.manifest(docs.repartition(7)))
    assert first(merkle.manifest(docs)) != first(merkle.manifest(docs.withColumn("n_chars", F.when(F.col("doc_id") == 50, 2).otherwise(1).cast("long"))))


# --- spelling variants --------------------------------------------------------------------------------------------------


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(docs):
    count = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            count[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    near = {w: [x for x in words if abs(len(x) - len(w)) <= 1 and one_edit(w, x)] for w in words}
    form = {w: min(x, key=lambda y: (-words[y], y)) if (x := near[w]) else None for w in words}
    form = {w: f if f and words[f] >= 10 * words[w] else None for w, f in form.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), words[w], len(near[w]), words.get(form[w])) for w in words)


def made_docs(n=400):
    import random

    rng = random.Random(5)
    stems = ["national", "coöperate", "überläufer", "aaaaaaaa", "bananasas", "x" * 300]
    docs = []
    for i in range(n):
        words = []
        for _ in range(60):
            w = rng.choices(stems, [400, 40, 20, 30, 8, 2])[0]
            for _ in range(rng.choices([0, 1, 2], [10, 2, 1])[0]):
                p, c = rng.randrange(len(w)), rng.choice("abnxÉé")
                w = rng.choice([w[:p] + w[p + 1 :], w[:p] + c + w[p:], w[:p] + c + w[p + 1 :], w + c])
            words.append(w.upper() if rng.random() < 0.1 else w)
        docs.append((i, " ".join(words)))
    return docs


@pytest.mark.parametrize("block,parts,rows", [(1024, 4, 16384), (16, 4, 50), (16, 2, 300)])
def test_variants_against_brute_force(spark, block, parts, rows, monkeypatch):
    docs = made_docs()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(variants.near, "__defaults__", (*variants.near.__defaults__[:2], rows))
    got = sorted(map(tuple, variants.variants(df, parts=parts, block=block).select("word", "form", "root", "n", "n_near", "form_n").collect()))
    want = brute_variants(docs)
    assert got == want and len({r[1] for r in want}) > 4 and any(r[2] not in (r[0], r[1]) for r in want)


def test_variants_of_odd_rows(odd, empty):
    got = sorted(map(tuple, variants.variants(odd).select("word", "form", "root", "n", "n_near", "form_n").collect()))
    assert got == brute_variants([r[:2] for r in ODD])
    assert variants.variants(empty).count() == variants.variants(odd.where("text is null")).count() == 0
