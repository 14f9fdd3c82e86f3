"""Quality by positive-unlabelled learning.

A linear model over binned properties of a text is trained to minimise the non-negative unbiased risk: trusted positives, any
web text as unlabelled, and the share of positives among the latter, estimated from these two. Negatives' labels are never used.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimpse.llm.common import ALNUM, SPACED, Words, byte_column, fold, pieces, text_batches, turn

BINS = 12
_BYTES = {
    "letter": [*range(97, 123), *range(128, 256)], "wide": [*range(128, 256)], "digit": [*range(48, 58)], "stop": [46, 33, 63], "comma": [44, 59, 58],
    "hash": [35, 36, 37, 38, 42, 64, 94, 126], "bar": [124, 92, 47, 95, 43, 61], "bracket": [40, 41, 60, 62, 91, 93, 123, 125], "quote": [34, 39, 96], "line": [10], "space": [32, 9],
}
NAMES = [*_BYTES, "bytes", "words", "word_length", "word_spread", "distinct", "top", "twice", "pair", "alone", "per_stop", "per_line", "long"]


def properties(texts: list[bytes | None]) -> np.ndarray:
    """[texts, NAMES]: shares of byte classes, lengths, and how words repeat. Null texts count as empty."""
    texts = [t or b"" for t in texts]
    w = Words(texts, SPACED)
    out = np.zeros((len(texts), len(NAMES)))
    if not len(texts):
        return out
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    at = np.cumsum(size + 1) - size - 1
    for k, chars in enumerate(_BYTES.values()):
        table = np.zeros(256, bool)
        table[chars] = True
        total = np.concatenate([[0], np.cumsum(table[w.buf])])
        out[:, k] = (total[at + size] - total[at]) / np.maximum(size, 1)
    length = (w.end - w.start).astype(float)
    n = np.maximum(w.count, 1)

    def mean(x):
        return np.bincount(w.doc, x, w.n_docs) / n

    k = len(_BYTES)
    out[:, k], out[:, k + 1], out[:, k + 2] = np.log1p(size), np.log1p(w.count), mean(length)
    out[:, k + 3] = np.sqrt(np.maximum(mean(length**2) - out[:, k + 2] ** 2, 0))
    order = np.lexsort((w.hash, w.doc))
    h, d = w.hash[order], w.doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.append(first, len(h)))
    owner = d[first]
    out[:, k + 4] = np.bincount(owner, minlength=w.n_docs) / n
    top = np.zeros(w.n_docs)
    np.maximum.at(top, owner, times)
    out[:, k + 5] = top / n
    same = np.zeros(len(w.hash))
    if len(same) > 1:
        same[1:] = (w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])
    out[:, k + 6] = mean(same)
    skip = np.zeros(len(w.hash))
    if len(skip) > 2:
        skip[2:] = (w.hash[2:] == w.hash[:-2]) & (w.doc[2:] == w.doc[:-2])
    out[:, k + 7] = mean(skip)
    seen = np.concatenate([[0], np.cumsum(ALNUM[w.buf])])
    out[:, k + 8] = mean((seen[w.end] == seen[w.start]).astype(float))
    out[:, k + 9] = np.log1p(w.count / (1 + out[:, 3] * size))
    out[:, k + 10] = np.log1p(w.count / (1 + out[:, 9] * size))
    out[:, k + 11] = mean((length > 15).astype(float))
    return out


class Model:
    def __init__(self, edges: np.ndarray, weight: np.ndarray, bias: float):
        self.edges, self.weight, self.bias = edges, weight, bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.bias + binned(x, self.edges) @ self.weight)


def binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Which bin each property is in, as zeros and ones."""
    out = np.zeros((len(x), x.shape[1] * BINS))
    for k in range(x.shape[1]):
        out[np.arange(len(x)), k * BINS + np.searchsorted(edges[k], x[:, k], side="right")] = 1
    return out


def _edges(x: np.ndarray) -> np.ndarray:
    return np.stack([np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1]) for k in range(x.shape[1])])


def _descend(p: np.ndarray, u: np.ndarray, pull, bias: float = 0.0, steps: int = 400, rate: float = 0.05, decay: float = 3e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam; ``pull`` gives the derivatives of the risk by the scores of positives and unlabelled."""
    w = np.zeros(p.shape[1])
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        dp, du = pull(p @ w + bias, u @ w + bias)
        g, gb = p.T @ dp + u.T @ du + decay * w, dp.sum() + du.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        bias -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    return w, bias


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def nonnegative_risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Model:
    """Minimise prior * E_p[l(+)] + max(0, E_u[l(-)] - prior * E_p[l(-)]) with logistic loss; where the second part is below 0, step back on it."""
    edges = _edges(np.concatenate([positive, unlabelled]))

    def pull(gp, gu):
        sp, su = _sigmoid(gp), _sigmoid(gu)
        if np.logaddexp(0, gu).mean() >= prior * np.logaddexp(0, gp).mean():
            return prior * (sp - 1) / len(gp) - prior * sp / len(gp), su / len(gu)
        return prior * sp / len(gp), -su / len(gu)

    return Model(edges, *_descend(binned(positive, edges), binned(unlabelled, edges), pull, float(np.log(prior / (1 - prior)))))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, least: float = 0.05) -> float:
    """The share of positives among the unlabelled, from these two alone.

    Half of both trains a model that tells them apart; in the other half, where the model's score is above t, the share of the
    unlabelled over the share of the positives bounds the prior from above, and the t with the least bound (sampling error
    included; at least ``least`` of the positives above) is taken. The mean of both ways round, within 0.01 and 0.99.
    """
    found = []
    for a, b in ((0, 1), (1, 0)):
        p, u, q, v = positive[a::2], unlabelled[a::2], positive[b::2], unlabelled[b::2]
        if not len(p) or not len(u) or not len(q) or not len(v):
            continue
        edges = _edges(np.concatenate([p, u]))
        w, bias = _descend(binned(p, edges), binned(u, edges), lambda gp, gu: ((_sigmoid(gp) - 1) / len(gp) / 2, _sigmoid(gu) / len(gu) / 2), steps=300)
        sq, sv = (np.sort(binned(x, edges) @ w + bias) for x in (q, v))
        t = np.concatenate([sq, sv])
        above_q, above_v = 1 - np.searchsorted(sq, t) / len(sq), 1 - np.searchsorted(sv, t) / len(sv)
        error = np.sqrt(np.log(40) / 2 / len(sq)) + np.sqrt(np.log(40) / 2 / len(sv))
        k = np.argmin(np.where(above_q > least, (above_v + error) / np.maximum(above_q, 1e-9), np.inf))
        found.append(above_v[k] / above_q[k])
    return float(np.clip(np.mean(found), 0.01, 0.99)) if found else 0.5


def fit(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, positives: int = 4000, unlabelled: int = 8000) -> Model | float:
    """A model from about ``positives`` trusted positives outside fold ``held`` and about ``unlabelled`` documents of any kind; 0.5 for all texts where there are no positives.

    Labels of 0 are not used, not even for the prior; a document with several labels counts as its least one says. Repeated rows are sampled alike.
    """
    known = labels.where(F.col("quality").isin(0, 1) & (fold("doc_id", folds) != held)).groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1")
    good, total = known.count(), docs.count()
    if not good or not total:
        return 0.5
    chosen = F.broadcast(known.where(turn("quality", "doc_id") < positives / good).select("doc_id"))  # about ``positives`` ids
    other = turn("unlabelled", "doc_id") < unlabelled / total
    kind = "p boolean, x array<double>"

    def run(batches):
        import pyarrow as pa

        for b in batches:
            x = properties(byte_column(b, "text"))
            yield pa.RecordBatch.from_arrays([b.column("p"), pa.array(list(x), pa.list_(pa.float64()))], names=["p", "x"])

    d = docs.select("doc_id", "text")
    sample = d.join(chosen, "doc_id").select("text", F.lit(True).alias("p")).unionByName(d.where(other).select("text", F.lit(False).alias("p")))
    rows = sample.mapInArrow(run, kind).toArrow()  # about positives + unlabelled rows of numbers
    p = np.array(rows.column("p").to_pylist(), bool)
    if not p.any() or p.all():
        return 0.5
    x = np.array(rows.column("x").to_pylist())
    x = x[order := np.lexsort((*x.T, p))]
    p = p[order]
    rng = np.random.default_rng(11)
    good_x, any_x = (rng.permutation(x[k]) for k in (p, ~p))  # halves alike
    return nonnegative_risk(good_x, any_x, class_prior(good_x, any_x))


def score(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, threshold: float = 0.5, **how) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1, higher: better), predicted. Null texts count as empty ones."""
    m = fit(text_batches(docs), labels, folds, held, **how)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = byte_column(b, "text")
            parts = [m.score(properties(texts[i:j])) if isinstance(m, Model) else np.full(j - i, m) for i, j in pieces(texts)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", (fold("doc_id", folds) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
