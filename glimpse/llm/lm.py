"""Language-model scoring by a log-bilinear neural model trained by noise-contrastive estimation.

Counts of all training tokens give the add-half base model and the noise. The model's vocabulary is of units: each word with at
least ``share`` of all tokens, the end, and buckets of all other words by hash. A unit is predicted from the three before it: their
vectors, each weighed component by component by its position, add up to a context vector, whose products with target vectors, plus
biases, are scores. Units are ranked by frequency and cut into about as many classes as a class has units; a unit's probability is
its class's, normalised over classes, times its own within the class, normalised over the class's units, so that batched matrix
products of a few hundred columns normalise every token. A word in a bucket takes the bucket's probability times its share of the
bucket's add-half counts, so scores are of the same events as the base's.

All training documents train the model: each task goes through its own tokens from the same start, with drawn noise; then the
tasks' rows are averaged, weighed by how often each task met them. Nothing is gathered but one row a unit.
"""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimpse.llm.common import SPACED, Words, byte_column, fold, pieces, stage, text_batches

#: Units before the predicted one that the model looks at, components of a vector, noise classes and noise units a batch and class.
SPAN, DIM, NOISE, NOISE_IN_CLASS = 3, 16, 32, 16
#: Rows of the model that travel as one record.
ROWS = 512


def _words(batch, name="text"):
    texts = byte_column(batch, name)
    for i, j in pieces(texts):
        yield i, j, Words(texts[i:j], SPACED)


def token_counts(train: DataFrame, flush: int = 400_000) -> DataFrame:
    """word (64-bit hash), c: how often each word stands in ``train``; counted in each task first."""

    def run(batches):
        import pyarrow as pa

        held, size = [], 0

        def merged():
            w, n = (np.concatenate(x) for x in zip(*held, strict=True))
            u, inverse = np.unique(w, return_inverse=True)
            return u, np.bincount(inverse, n, len(u)).astype(np.int64)

        def row(u, n):
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n)], names=["word", "c"])

        for b in batches:
            for _, _, w in _words(b):
                held.append(np.unique(w.hash, return_counts=True))
                size += len(held[-1][0])
                if size > 4 * flush:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > flush:
                        yield row(*held[0])
                        held, size = [], 0
        if held:
            yield row(*merged())

    return train.select("text").mapInArrow(run, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


class Units:
    """The model's vocabulary, ranked by frequency: ``short`` (sorted hashes of the words that are units of their own) and their counts, the counts of buckets of other words, and of the end."""

    def __init__(self, short: np.ndarray, counts: np.ndarray, buckets: np.ndarray, ends: int):
        n = np.concatenate([counts, buckets, [ends]]).astype(float) + 0.5
        rank = np.empty(len(n), np.uint16 if len(n) <= 1 << 16 else np.uint32)
        order = np.argsort(-n, kind="stable")
        rank[order] = np.arange(len(n))
        self.short, self.n_buckets = short, len(buckets)
        self.of_short, self.of_bucket, self.end = rank[: len(short)], rank[len(short) : -1], rank[-1]
        self.n = n[order]
        self.width = max(1, int(np.ceil(np.sqrt(len(n)))))  # units of a class
        self.edges = np.append(np.arange(0, len(n), self.width), len(n))  # first unit of each class

    def sequence(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Units of all texts, an end after each; the contexts [SPAN, steps], ends where a text has no unit before; places of words; which words are in buckets."""
        at, known = _find(self.short, w.hash)
        unit = np.where(known, self.of_short[np.minimum(at, max(0, len(self.of_short) - 1))] if len(self.short) else self.end, self.of_bucket[(w.hash.view(np.int64) % self.n_buckets)])
        place = np.arange(len(unit)) + w.doc
        y = np.full(len(unit) + w.n_docs, self.end)
        y[place] = unit
        left = np.arange(len(y)) - np.repeat(w.first[:-1] + np.arange(w.n_docs), w.count + 1)  # steps of the same text before
        before = np.full((SPAN, len(y)), self.end)
        for j in range(1, SPAN + 1):
            before[j - 1, j:] = np.where(left[j:] >= j, y[:-j], self.end)
        return y, before, place, ~known


class Model:
    """``table``: one row a context unit, target unit, class and position, each of DIM components and a bias."""

    def __init__(self, units: Units, table: np.ndarray | None = None, seed: int = 7):
        u, k = len(units.n), len(units.edges) - 1
        if table is None:
            rng = np.random.default_rng(seed)
            table = np.zeros((2 * u + k + SPAN, DIM + 1), np.float32)
            table[: 2 * u + k, :DIM] = rng.normal(0, 0.1, (2 * u + k, DIM))
            in_class = np.add.reduceat(units.n, units.edges[:-1])
            table[u : 2 * u, DIM] = np.log(units.n / np.repeat(in_class, np.diff(units.edges)))
            table[2 * u : 2 * u + k, DIM] = np.log(in_class / in_class.sum())
            table[2 * u + k :, :DIM] = (1.0 / np.arange(1, SPAN + 1))[:, None]
        self.units, self.table = units, table
        self.context, self.target, self.bias = table[:u, :DIM], table[u : 2 * u, :DIM], table[u : 2 * u, DIM]
        self.classes, self.class_bias, self.position = table[2 * u : 2 * u + k, :DIM], table[2 * u : 2 * u + k, DIM], table[2 * u + k :, :DIM]

    def hidden(self, before: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        seen = [self.context[before[j]] for j in range(SPAN)]
        return sum(x * self.position[j] for j, x in enumerate(seen)), seen

    def log_probability(self, y: np.ndarray, before: np.ndarray, most: int = 1 << 15) -> np.ndarray:
        """Natural logarithms of the units' probabilities, by batched products over all classes and all units of a class."""
        out = np.empty(len(y))
        for i in range(0, len(y), most):
            order = np.argsort(y[i : i + most], kind="stable")
            u = y[i : i + most][order]
            h, _ = self.hidden(before[:, i : i + most][:, order])
            k = u // self.units.width
            s = h @ self.classes.T + self.class_bias
            log = s[np.arange(len(u)), k] - _log_sum(s)
            cut = np.searchsorted(k, np.arange(len(self.units.edges)))
            for c in np.flatnonzero(np.diff(cut)):
                a, z, lo, hi = cut[c], cut[c + 1], self.units.edges[c], self.units.edges[c + 1]
                s = h[a:z] @ self.target[lo:hi].T + self.bias[lo:hi]
                log[a:z] += s[np.arange(z - a), u[a:z] - lo] - _log_sum(s)
            out[i + order] = log
        return out


def _log_sum(s: np.ndarray) -> np.ndarray:
    top = s.max(1)
    return np.log(np.exp(s - top[:, None]).sum(1)) + top


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(np.minimum(-x, 80)))  # below the largest power of single precision


def _add_rows(into: np.ndarray, rows: np.ndarray, at: np.ndarray, ordered: bool = False) -> None:
    """Add rows [n, width] to the rows ``at`` of ``into``."""
    if not ordered:
        order = np.argsort(at, kind="stable")
        at, rows = at[order], rows[order]
    first = np.flatnonzero(np.diff(at, prepend=at[0] ^ 1)) if len(at) else at
    into[at[first]] += np.add.reduceat(rows, first, axis=0)


class Trainer:
    """One task's model on its way: noise-contrastive estimation with drawn noise, steps by the gradients' own scale (Adagrad)."""

    def __init__(self, units: Units, table: np.ndarray | None, seed: int, rate: float = 0.1):
        self.m, self.units, self.rate = Model(units, None if table is None else table.copy()), units, rate
        self.rng = np.random.default_rng(seed)
        self.scale = np.full_like(self.m.table, 1.0)  # sums of squared gradients; the start holds first steps back
        self.met = np.zeros(len(self.m.table))
        self.up = np.cumsum(units.n)
        in_class = np.add.reduceat(units.n, units.edges[:-1])
        self.noise = np.log(NOISE * in_class / in_class.sum()).astype(np.float32)
        self.noise_in = np.log(NOISE_IN_CLASS * units.n / np.repeat(in_class, np.diff(units.edges))).astype(np.float32)
        self.class_up = np.cumsum(in_class)

    def step(self, y: np.ndarray, before: np.ndarray) -> None:
        m, u, g = self.m, len(self.units.n), np.zeros_like(self.m.table)
        n_classes = len(self.units.edges) - 1
        order = np.argsort(y, kind="stable")
        y, before = y[order], before[:, order]
        k = y // self.units.width
        h, seen = m.hidden(before)
        hb = np.concatenate([h, np.ones((len(h), 1), np.float32)], 1)  # the bias's component is always 1
        dh = np.zeros_like(h)
        # classes against noise classes
        drawn = np.searchsorted(self.class_up, self.rng.random(NOISE) * self.class_up[-1], side="right")
        drawn = np.minimum(drawn, n_classes - 1)
        own = m.classes[k]
        pull = 1 - _sigmoid(np.einsum("ij,ij->i", h, own) + m.class_bias[k] - self.noise[k])
        push = _sigmoid(h @ m.classes[drawn].T + m.class_bias[drawn] - self.noise[drawn])
        dh += pull[:, None] * own - push @ m.classes[drawn]
        to = g[2 * u : 2 * u + n_classes]
        _add_rows(to, pull[:, None] * hb, k, True)
        _add_rows(to, -(push.T @ hb), drawn)
        # units against noise of their class
        own = m.target[y]
        pull = 1 - _sigmoid(np.einsum("ij,ij->i", h, own) + m.bias[y] - self.noise_in[y])
        dh += pull[:, None] * own
        to = g[u : 2 * u]
        _add_rows(to, pull[:, None] * hb, y, True)
        cut = np.searchsorted(k, np.arange(n_classes + 1))
        there = np.flatnonzero(np.diff(cut))
        lo = self.up[self.units.edges[there]] - self.units.n[self.units.edges[there]]
        hi = self.up[self.units.edges[there + 1] - 1]
        drawn = np.searchsorted(self.up, lo[:, None] + self.rng.random((len(there), NOISE_IN_CLASS)) * (hi - lo)[:, None], side="right")
        drawn = np.clip(drawn, self.units.edges[there][:, None], self.units.edges[there + 1][:, None] - 1)
        pushed = np.empty((len(there), NOISE_IN_CLASS, DIM + 1), np.float32)
        for i, c in enumerate(there):
            a, z, d = cut[c], cut[c + 1], drawn[i]
            push = _sigmoid(h[a:z] @ m.target[d].T + (m.bias[d] - self.noise_in[d]))
            dh[a:z] -= push @ m.target[d]
            pushed[i] = push.T @ hb[a:z]
        _add_rows(to, -pushed.reshape(-1, DIM + 1), drawn.ravel())
        # context vectors and positions
        for j in range(SPAN):
            _add_rows(g[:u, :DIM], dh * m.position[j], before[j])
            g[2 * u + n_classes + j, :DIM] = np.einsum("ij,ij->j", dh, seen[j])
            self.met[:u] += np.bincount(before[j], minlength=u)
        self.met[u : 2 * u] += np.bincount(y, minlength=u)
        self.met[2 * u :] += len(y)
        self.scale += g * g
        m.table += self.rate * g / np.sqrt(self.scale)

    def go_through(self, y: np.ndarray, before: np.ndarray) -> None:
        """Steps of up to 16384 tokens, spread over all of ``y``; smaller ones where there are few."""
        n = max(1, -(-len(y) // 16384), min(32, len(y) // 256))
        for i in range(n):
            if len(y[i::n]):
                self.step(y[i::n], before[:, i::n])


def trained(train: DataFrame, units: Units, rounds: int = 1, tokens: int | None = None, per_task: int = 4_000_000) -> Model:
    """The model after ``rounds`` passes of all tasks over ``train``; the driver gets the averaged rows alone.

    A task learns from what it reads alone, so a task of few texts takes few steps: of ``tokens`` in all, given, tasks are merged
    until each has about ``per_task``, however many partitions ``train`` is in.
    """
    if tokens is not None:
        train = train.coalesce(max(1, int(tokens // per_task)))
    table = None
    size = len(Model(units).table)

    def rows_of(i):
        return min(ROWS, size - i * ROWS)

    for turn in range(rounds):

        def run(batches, table=table, turn=turn):
            import pyarrow as pa

            task = TaskContext.get().partitionId()
            t = Trainer(units, table, seed=(turn << 40) + task)
            for b in batches:
                for _, _, w in _words(b):
                    y, before, _, _ = units.sequence(w)
                    t.go_through(y, before)
            if t.met.any():
                parts = range(-(-size // ROWS))
                met = [t.met[i * ROWS : (i + 1) * ROWS].astype(np.float64).tobytes() for i in parts]
                rows = [(t.m.table[i * ROWS : (i + 1) * ROWS]).tobytes() for i in parts]
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([task] * len(met), pa.int64()), pa.array(met, pa.binary()), pa.array(rows, pa.binary())], names=["part", "task", "met", "rows"])

        def mean(batches):
            """A part's rows come after each other and are added up as they come."""
            import pyarrow as pa

            now, weight, total = None, None, None

            def done():
                return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([weight.tobytes()], pa.binary()), pa.array([total.tobytes()], pa.binary())], names=["part", "met", "rows"])

            for b in batches:
                for part, met, rows in zip(b.column("part").to_pylist(), b.column("met").to_pylist(), b.column("rows").to_pylist(), strict=True):
                    if part != now:
                        if now is not None:
                            yield done()
                        now, weight, total = part, np.zeros(rows_of(part)), np.zeros((rows_of(part), DIM + 1))
                    m = np.frombuffer(met)
                    weight = weight + m
                    total = total + m[:, None] * np.frombuffer(rows, np.float32).reshape(-1, DIM + 1)
            if now is not None:
                yield done()

        sent = train.select("text").mapInArrow(run, "part int, task long, met binary, rows binary")
        dealt = sent.repartition(max(1, -(-size // ROWS)), "part").sortWithinPartitions("part", "task")
        means = dealt.mapInArrow(mean, "part int, met binary, rows binary").toArrow().to_pylist()  # one row a unit, whatever the corpus
        start = Model(units, table).table.copy()
        for r in means:
            met, rows = np.frombuffer(r["met"]), np.frombuffer(r["rows"]).reshape(-1, DIM + 1)
            of = slice(r["part"] * ROWS, r["part"] * ROWS + len(met))
            start[of] = np.where(met[:, None] > 0, rows / np.maximum(met, 1)[:, None], start[of])
        table = start
    return Model(units, table)


def score(docs: DataFrame, folds: int = 5, held: int = 1, share: float = 2e-5, buckets: int = 1024, frequent: float = 5e-7, rounds: int = 1, per_task: int = 4_000_000) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the text's probability).

    Learns from documents outside fold ``held``. Words with ``share`` of all tokens are units of their own, 1/share of them at most;
    all others share ``buckets`` units. ``frequent`` bounds what tasks keep of the counts: words with at least that share, so
    1/frequent of them at most; counts of others come by a join. Null texts are an end alone, as empty ones are; repeated rows are
    scored and learnt from each. Tasks read about ``per_task`` tokens each, or a partition where partitions are larger; which texts
    make a task, and so the last digits of ``score``, follow the splits of the files. The other columns don't.
    """
    docs = text_batches(docs).select("doc_id", "text")
    train = docs.where(fold("doc_id", folds) != held)
    counts = stage(token_counts(train), "token-counts")
    n_docs = train.count()
    words, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n, v = words + n_docs, distinct + (n_docs > 0)  # the end is a token too
    z = np.log10(n + 0.5 * (v + 1))
    head = counts.where(F.col("c") >= frequent * n).toArrow()  # at most 1 / frequent rows
    h, c = head.column("word").to_numpy().view(np.uint64), head.column("c").to_numpy()
    by = np.argsort(h)
    h, c = h[by], c[by]
    own = c >= share * n
    rest = counts.where(F.col("c") < share * n).groupBy(F.pmod("word", F.lit(buckets)).alias("b")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).toArrow()  # a row a bucket
    in_bucket, kinds = np.zeros(buckets), np.zeros(buckets)
    in_bucket[rest.column("b").to_numpy()], kinds[rest.column("b").to_numpy()] = rest.column("c").to_numpy(), rest.column("n").to_numpy()
    units = Units(h[own], c[own], in_bucket, n_docs)
    log_bucket = np.log10(in_bucket + 0.5 * kinds + 0.5)  # add-half counts of the words in it, and of any word not seen
    model = trained(train, units, rounds, n, per_task)
    end = float(np.log10(n_docs + 0.5))
    has_end = int(n_docs > 0)

    def run(batches):
        import pyarrow as pa

        logs = np.log10(c + 0.5)
        part, row = TaskContext.get().partitionId() << 33, 0
        for b in batches:
            tokens, known, base, mine, far, far_n = [], [], [], [], [], []
            for _, _, w in _words(b):
                y, before, _, other = units.sequence(w)
                step = model.log_probability(y, before) / np.log(10)
                doc_of = np.repeat(np.arange(w.n_docs), w.count + 1)
                i, near = _find(h, w.hash)
                lg = np.where(near, logs[i] if len(logs) else 0.0, 0.0)
                inside = np.where(other, lg - log_bucket[w.hash.view(np.int64) % buckets], 0.0)
                tokens += (w.count + 1).tolist()
                known += (np.bincount(w.doc, near, w.n_docs).astype(np.int64) + has_end).tolist()
                base += (np.bincount(w.doc, lg, w.n_docs) + end).tolist()
                mine += (np.bincount(doc_of, step, w.n_docs) + np.bincount(w.doc, inside, w.n_docs)).tolist()
                miss = np.flatnonzero(~near)
                cut = np.searchsorted(w.doc[miss], np.arange(w.n_docs + 1))
                gone = w.hash[miss].view(np.int64)
                for d in range(w.n_docs):
                    u, m = np.unique(gone[cut[d] : cut[d + 1]], return_counts=True)
                    far.append(u)
                    far_n.append(m)
            ids = pa.array(np.arange(part + row, part + row + b.num_rows))
            row += b.num_rows

            def lists(x):
                offsets = np.concatenate([[0], np.cumsum([len(y) for y in x])]).astype(np.int32)
                return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)))

            yield pa.RecordBatch.from_arrays([ids, b.column("doc_id"), pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(mine, pa.float64()), lists(far), lists(far_n)], names=["row", "doc_id", "n_tokens", "known", "base", "own", "far", "far_n"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    read = stage(docs.mapInArrow(run, f"row long, doc_id {kind}, n_tokens long, known long, base double, own double, far array<long>, far_n array<long>"), "scored")
    far = read.select("row", F.explode(F.arrays_zip("far", "far_n")).alias("x")).select("row", F.col("x.far").alias("word"), F.col("x.far_n").alias("m"))
    rare = counts.where(F.col("c") < frequent * n)
    far = far.join(rare, "word", "left").groupBy("row").agg(F.sum(F.col("m") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("log"), F.coalesce(F.sum(F.when(F.col("c") > 0, F.col("m"))), F.lit(0)).alias("k"))
    out = read.drop("far", "far_n").join(far, "row", "left").na.fill(0, ["log", "k"])
    return out.select(
        "doc_id", (fold("doc_id", folds) == held).alias("held_out"), "n_tokens", (F.col("known") + F.col("k")).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("log") - F.col("n_tokens") * F.lit(float(z))).alias("base_score"), (F.col("own") + F.col("log")).alias("score"),
    )
