"""N-gram Jaccard join by vertical partitioning.

The global order of word n-grams is by hash, cut into fragments by the hash's leading bits. Each document's set falls apart
into segments, one a fragment; a fragment's task counts in how many different sets each of its n-grams occurs. N-grams of one
set alone can't be shared; with the others put in order of rarity, documents that may reach the threshold share one of their
first few. Pairs from there are counted fragment by fragment, and the partial overlaps are summed.

Equal sets are one node. Pairs are not all spelled out: each shared n-gram first links its members to the one with the fewest
n-grams of its own (which stands in the middle of a group of near copies); then only pairs across what is still apart are looked at.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glimpse.llm.common import SPACED, Words, byte_column, folders, mix, pieces, stage, text_batches

_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
#: A set's entry in a segment.
HEAD = np.dtype([("set", "<i8"), ("size", "<u4"), ("length", "<u4")])
#: Fragments in which a pair's overlap is counted.
PARTS = 4
#: N-grams that a fragment, or a bucket of sets, is to have on average: what a Python task holds at a time.
HELD = 1 << 21
#: Members of an n-gram that meet all others of it in one task.
MEET = 1000


def shingle_sets(texts: list[bytes | None], n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text: n words, or the whole of a shorter text; none without words."""
    w = Words(texts, SPACED)
    out = [np.zeros(0, np.uint64)] * len(texts)
    h = np.zeros(max(0, len(w.hash) - n + 1), np.uint64)
    for k in range(n if len(h) else 0):
        h += w.hash[k : len(w.hash) - n + 1 + k] * _K[k]
    h = mix(h)
    for d in np.flatnonzero(w.count):
        a, c = int(w.first[d]), int(w.count[d])
        if c >= n:
            out[d] = np.unique(h[a : a + c - n + 1])
        else:
            own = w.hash[a : a + c] * np.array(_K[:c])
            out[d] = mix(own.sum(keepdims=True) + np.uint64(c))
    return out


def set_id(s: np.ndarray) -> int:
    """One 64-bit name for a set, the same for equal sets."""
    return int(mix(mix(s ^ _K[4]).sum(keepdims=True) + np.uint64(len(s))).view(np.int64)[0]) if len(s) else 0


def _sets(texts, n):
    for i, j in pieces(texts, 4 << 20):
        yield i, shingle_sets(texts[i:j], n)


def sets_of(docs: DataFrame, n: int, more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, set (null without words), and columns of ``docs`` that are asked for."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            size, name = [], []
            for _, sets in _sets(byte_column(b, "text"), n):
                size += map(len, sets)
                name += [set_id(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size, pa.int64()), pa.array(name, pa.int64()), *(b.column(c) for c in more)], names=["doc_id", "n_shingles", "set", *more])

    kind = ", ".join([f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, set long", *(f"{c} {docs.schema[c].dataType.simpleString()}" for c in more)])
    return docs.select("doc_id", "text", *more).mapInArrow(run, kind)


def segments(docs: DataFrame, n: int, bits: int) -> DataFrame:
    """Sets cut by fragment of the n-gram order: fragment, sets (set, size and segment length in turn), grams (6 bytes each).

    A task sends a set that it has met before only once.
    """

    def run(batches):
        import pyarrow as pa

        seen: set[int] = set()
        for b in batches:
            for _, sets in _sets(byte_column(b, "text"), n):
                new = []
                for s in sets:
                    if len(s) and (name := set_id(s)) not in seen:
                        seen.add(name)
                        new.append((name, s))
                if not new:
                    continue
                name = np.array([x for x, _ in new], np.int64)
                size = np.array([len(s) for _, s in new], np.int64)
                grams = np.concatenate([s for _, s in new])
                owner = np.repeat(np.arange(len(new)), size)
                part = (grams >> np.uint64(64 - bits)).astype(np.int64)
                order = np.argsort(part, kind="stable")  # by fragment, then set, then gram
                grams, owner, part = grams[order], owner[order], part[order]
                edge = np.searchsorted(part, np.arange(part[0], part[-1] + 2)) if len(part) else [0]
                rows = []
                for k in range(len(edge) - 1):
                    x, y = edge[k], edge[k + 1]
                    if x < y:
                        who, length = np.unique(owner[x:y], return_counts=True)
                        head = np.empty(len(who), HEAD)
                        head["set"], head["size"], head["length"] = name[who], size[who], length
                        rows.append((int(part[x]), head.tobytes(), np.ascontiguousarray(grams[x:y, None].view(np.uint8)[:, :6]).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["fragment", "sets", "grams"])

    return docs.select("text").mapInArrow(run, "fragment int, sets binary, grams binary")


def _shared(names: np.ndarray, sizes: np.ndarray, grams: np.ndarray):
    """Of a fragment's (set, gram) entries, those whose gram is in two sets or more, once each, with the number of sets."""
    order = np.argsort(grams, kind="stable")
    g = grams[order]
    same = np.zeros(len(g), bool)
    same[1:] = g[1:] == g[:-1]
    same[:-1] |= same[1:]
    keep = order[same]
    keep = keep[np.lexsort((names[keep], grams[keep]))]
    g, s = grams[keep], names[keep]
    again = np.zeros(len(keep), bool)
    again[1:] = (g[1:] == g[:-1]) & (s[1:] == s[:-1])
    keep = keep[~again]
    _, inverse, count = np.unique(grams[keep], return_inverse=True, return_counts=True)
    many = count[inverse] > 1
    return names[keep[many]], sizes[keep[many]], grams[keep[many]], count[inverse[many]]


def shared_grams(parts: DataFrame, bits: int, buckets: int) -> DataFrame:
    """Fragments' grams that several sets share, dealt to buckets of sets: bucket, entries (set, size, gram, frequency)."""

    def run(batches):
        import pyarrow as pa

        def flush(fragment, heads, bodies):
            head = np.frombuffer(b"".join(heads), HEAD)
            raw = np.zeros((sum(map(len, bodies)) // 6, 8), np.uint8)
            raw[:, :6] = np.frombuffer(b"".join(bodies), np.uint8).reshape(-1, 6)
            # the fragment's leading 16 bits and the 48 last ones; of fragments with more bits, the others are in both
            grams = raw.view(np.uint64)[:, 0] | (np.uint64(fragment >> max(0, bits - 16)) << np.uint64(48))
            name, size, gram, count = _shared(np.repeat(head["set"], head["length"]), np.repeat(head["size"].astype(np.int64), head["length"]), grams)
            bucket = (name.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            rows = np.stack([name, size, gram.view(np.int64), count], 1)[order]
            edge = np.searchsorted(bucket[order], np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(edge))
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([rows[edge[k] : edge[k + 1]].tobytes() for k in full], pa.binary())], names=["bucket", "entries"])

        at, heads, bodies = None, [], []
        for b in batches:
            for fragment, h, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if fragment != at and heads:
                    yield flush(at, heads, bodies)
                    heads, bodies = [], []
                at = fragment
                heads.append(h)
                bodies.append(g)
        if heads:
            yield flush(at, heads, bodies)

    return parts.mapInArrow(run, "bucket int, entries binary")


def hopeful(entries: DataFrame, percent: int) -> DataFrame:
    """Sets that may reach the threshold with another: set, size, own (grams of no other set), prefix (grams, rarest first), grams.

    A partner holds percent/100 of the set's grams, and so one of its first size - ceil(size * percent / 100) + 1.
    """

    def run(batches):
        import pyarrow as pa

        def flush(blobs):
            x = np.frombuffer(b"".join(blobs), np.int64).reshape(-1, 4)
            x = x[np.lexsort((x[:, 2], x[:, 3], x[:, 0]))]
            edge = np.append(np.flatnonzero(np.diff(x[:, 0], prepend=x[0, 0] ^ 1)), len(x))
            rows = []
            for a, z in zip(edge[:-1], edge[1:], strict=True):
                size = int(x[a, 1])
                own = size - int(z - a)
                first = size + (-percent * size) // 100 + 1 - own
                if first > 0:
                    rows.append((int(x[a, 0]), size, own, x[a : a + first, 2].tolist(), x[a:z, 2].tolist()))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["set", "size", "own", "prefix", "grams"])

        at, blobs = None, []
        for b in batches:
            for bucket, e in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if bucket != at and blobs:
                    yield flush(blobs)
                    blobs = []
                at = bucket
                blobs.append(e)
        if blobs:
            yield flush(blobs)

    return entries.mapInArrow(run, "set long, size long, own long, prefix array<long>, grams array<long>")


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) those that link, by partial overlaps per fragment, summed."""
    def of(part):
        return F.struct(F.lit(part).alias("part"), F.filter("grams", lambda g: g.bitwiseAND(F.lit(PARTS - 1)) == part).alias("g"))

    cut = sets.select("set", "size", F.explode(F.array(*[of(p) for p in range(PARTS)])).alias("x")).select("set", "size", "x.part", "x.g")
    a = cut.select(F.col("set").alias("a"), F.col("size").alias("na"), "part", F.col("g").alias("ga"))
    b = cut.select(F.col("set").alias("b"), F.col("size").alias("nb"), "part", F.col("g").alias("gb"))
    partial = pairs.join(a, "a").join(b, ["b", "part"]).select("a", "b", "na", "nb", F.size(F.array_intersect("ga", "gb")).alias("o"))
    total = partial.groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("o"))
    return total.where(f"100 * o >= {percent} * (na + nb - o)").select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """node, comp (the smallest node reachable) for the nodes of ``edges`` (a, b): labels meet by large and small stars in turn, until nothing moves."""
    put, before = folders(edges.sparkSession, "edges"), None
    e = put(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = put(small.distinct())
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp"))


def near_sets(docs: DataFrame, total: int, n: int = 4, percent: int = 85) -> DataFrame:
    """set, comp: sets that link with others, and the smallest set of what they reach. ``total``: n-grams of all documents, which set the number of fragments."""
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // HELD))
    bits = max(6, (tasks - 1).bit_length())
    parts = segments(docs, n, bits).repartition(tasks, "fragment").sortWithinPartitions("fragment")
    shared = shared_grams(parts, bits, tasks).repartition(tasks, "bucket").sortWithinPartitions("bucket")
    sets = stage(hopeful(shared, percent), "sets")
    tokens = sets.select("set", "size", "own", F.posexplode("prefix").alias("i", "gram")).withColumn("left", F.col("size") - F.col("own") - F.col("i"))
    ends = tokens.groupBy("gram").agg(F.min(F.struct("own", "set", "size", "left")).alias("mid"), F.max(F.struct("own", "set")).alias("last")).where(F.col("mid.set") != F.col("last.set"))
    tokens = stage(tokens.join(ends.drop("last"), "gram").select("gram", "set", "size", "left", "mid"), "tokens")

    def fits(x, y):  # lengths, and what is left after the gram that is the first in common
        return F.expr(f"{percent} * greatest({x}.size, {y}.size) <= 100 * least({x}.size, {y}.size) and {100 + percent} * least({x}.left, {y}.left) >= {percent} * ({x}.size + {y}.size)")

    star = tokens.alias("t").where(F.col("t.set") != F.col("t.mid.set")).where(fits("t", "t.mid"))
    tried = stage(star.select(F.least("set", "mid.set").alias("a"), F.greatest("set", "mid.set").alias("b")).distinct(), "pairs")
    first = stage(linked(tried, sets, percent), "links")
    comp = components(first)
    t = tokens.drop("mid").join(comp, tokens["set"] == comp["node"], "left").select("gram", "set", "size", "left", F.coalesce("comp", "set").alias("comp"))
    t = stage(t, "members")
    ends = t.groupBy("gram").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.ceil(F.count("*") / MEET).alias("salts")).where("lo != hi").drop("lo", "hi")
    t = stage(t.join(ends, "gram"), "apart")
    # an n-gram with many members is dealt to as many tasks as its members need: one side by a salt, the other to all salts
    x = t.withColumn("salt", F.pmod(F.xxhash64("set"), F.col("salts"))).alias("x")
    y = t.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).alias("y")
    rest = x.join(y, (F.col("x.gram") == F.col("y.gram")) & (F.col("x.salt") == F.col("y.salt")) & (F.col("x.set") < F.col("y.set")) & (F.col("x.comp") != F.col("y.comp")) & fits("x", "y"))
    rest = rest.select(F.col("x.set").alias("a"), F.col("y.set").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    second = linked(stage(rest, "pairs"), sets, percent)
    return components(first.unionByName(second)).select(F.col("node").alias("set"), "comp")


def _per_set(docs: DataFrame, per: DataFrame, n: int, percent: int) -> DataFrame:
    """set, comp for all sets of ``per``."""
    total = per.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    near = near_sets(docs, total, n, percent)
    return per.where("set is not null").select("set").distinct().join(near, "set", "left").withColumn("comp", F.coalesce("comp", "set"))


def classes(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, the smallest doc_id reachable by links.

    Texts without words, and null texts, link with nothing. A null doc_id never names a component while another is there.
    Equal rows are equal sets, and so linked.
    """
    per = stage(sets_of(text_batches(docs), n), "doc-sets")
    least = per.where("set is not null").groupBy("set").agg(F.min("doc_id").alias("least"))
    named = least.join(_per_set(docs, per, n, percent), "set")
    best = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = stage(named.join(best, "comp").select(F.col("set").alias("_set"), "component_id"), "components")
    out = per.join(named, per["set"] == named["_set"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each class: one with the smallest id, a null id last. All columns are kept.

    A row is told by its id and text (64-bit hash each), so rows of one id with texts of different classes are judged apart, and of
    rows equal in both one stays. Texts without words, and null ones, link with nothing: all their rows stay.
    """
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text")
    d = d.withColumn("i", F.xxhash64(F.col("doc_id").isNull(), "doc_id")).withColumn("t", F.xxhash64("text"))
    per = stage(sets_of(text_batches(d), n, ("i", "t")), "doc-sets").where("set is not null")
    comp = _per_set(docs, per, n, percent)
    by_set = per.groupBy("set").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "i", "t")).alias("one"))
    keep = stage(by_set.join(comp, "set").groupBy("comp").agg(F.min("one").alias("one")).select("one.i", "one.t"), "kept")
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    found = d.where(worded).select("row", "i", "t").hint("merge").join(keep, ["i", "t"])
    found = found.withColumn("copy", F.row_number().over(Window.partitionBy("i", "t").orderBy("i"))).where("copy = 1")  # as the join has dealt and sorted them
    return d.where(~worded).select("row.*").unionByName(found.select("row.*"))
