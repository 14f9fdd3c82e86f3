"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary texts. A text's windows are compressed with each, and
how much shorter the toxic dictionary makes the best window is its evidence; thresholds are calibrated on texts that neither dictionary has seen.

Before compression every word becomes its 8-byte hash, so that a known word saves as much wherever it stands and an unknown
one nothing, and words usual in ordinary texts are left out, so that the lengths differ by what tells the classes apart.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimpse.llm.common import LETTERS, Words, byte_column, fold, pieces, text_batches, turn

_DICT = {"k": 16, "d": 8}


def _document_frequency(w: Words) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((w.doc, w.hash))
    h, d = w.hash[order], w.doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return np.unique(h[new], return_counts=True)


class Model:
    """``usual``: sorted hashes of words left out; dictionaries; a, b: score = 1 / (1 + exp(-(a + b * evidence)))."""

    def __init__(self, usual, toxic: bytes, ordinary: bytes, a: float, b: float, window: int):
        self.usual, self.toxic, self.ordinary, self.a, self.b, self.window = usual, toxic, ordinary, a, b, window

    def compressors(self):
        import zstandard as z

        return [z.ZstdCompressor(level=3, dict_data=z.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False).compress for d in (self.toxic, self.ordinary)]

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.a + self.b * np.log1p(np.maximum(evidence, 0)))))


def windows(texts: list[bytes | None], usual: np.ndarray, window: int) -> list[list[bytes]]:
    """The texts' less usual words as hashes, cut every ``window`` words; none for a text without such words."""
    w = Words(texts, LETTERS)
    h, d = w.hash, w.doc
    if len(usual) and len(h):
        keep = usual[np.minimum(np.searchsorted(usual, h), len(usual) - 1)] != h
        h, d = h[keep], d[keep]
    raw = h.astype("<u8")
    cut = np.searchsorted(d, np.arange(w.n_docs + 1))
    return [[raw[i : min(i + window, z)].tobytes() for i in range(a, z, window)] for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def evidence(texts: list[bytes | None], m: Model, shrink) -> np.ndarray:
    """Per text, the bytes that the toxic dictionary saves over the ordinary one on its best window; 0 without windows."""
    if shrink is None:
        return np.zeros(len(texts))
    toxic, ordinary = shrink
    return np.array([max((len(ordinary(x)) - len(toxic(x)) for x in ws), default=0) for ws in windows(texts, m.usual, m.window)], float)


def learn(toxic: list[bytes], ordinary: list[bytes], check: tuple[list[bytes], list[int], float], size: int = 4096, window: int = 64) -> Model:
    """Dictionaries from two lists of texts; ``check``: texts and labels for the calibration, and the share of toxic ones to expect."""
    import zstandard as z

    texts, labels, prior = check
    empty = Model(np.zeros(0, np.uint64), b"", b"", float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))), 0.0, window)
    if not toxic or not ordinary:
        return empty
    ht, ct = _document_frequency(Words(toxic, LETTERS))
    ho, co = _document_frequency(Words(ordinary, LETTERS))
    if not len(ht) or not len(ho):
        return empty
    at = np.minimum(np.searchsorted(ht, ho), len(ht) - 1)
    among = np.where(ht[at] == ho, ct[at], 0)
    usual = ho[(co >= 2) & (among * len(ordinary) < 8 * co * len(toxic))]
    half = window // 2
    try:
        books = [z.train_dictionary(size, [x for ws in windows(t, usual, half) for x in ws], **_DICT).as_bytes() for t in (toxic, ordinary)]
    except z.ZstdError:  # too few texts for a dictionary
        return empty
    m = Model(usual, *books, 0.0, 0.0, window)
    e = np.log1p(np.maximum(evidence(texts, m, m.compressors()), 0))
    y = np.array(labels, float)
    share = min(max(prior, 1e-6), 1 - 1e-6)
    weight = np.where(y > 0, share / max(y.mean(), 1e-6), (1 - share) / max(1 - y.mean(), 1e-6))
    p = np.zeros(2)
    x = np.stack([np.ones(len(e)), e], 1)
    for _ in range(30):  # logistic regression by Newton's method, slightly held back
        q = 1 / (1 + np.exp(-np.clip(x @ p, -30, 30)))
        g = x.T @ (weight * (y - q)) - 1e-3 * p
        p = p + np.linalg.solve(x.T @ (x * (weight * q * (1 - q))[:, None]) + 1e-3 * np.eye(2), g)
    m.a, m.b = map(float, p)
    return m


def fit(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, most: int = 1500) -> Model:
    """A model of labelled documents outside fold ``held``: about twice ``most`` toxic and as many ordinary ones, seven tenths for the dictionaries and the others for the calibration."""
    known = labels.where(F.col("toxic").isin(0, 1) & (fold("doc_id", folds) != held)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r[0]: r[1] for r in known.groupBy("toxic").count().collect()}
    if not n:
        return Model(np.zeros(0, np.uint64), b"", b"", -3.0, 0.0, 64)
    rate = F.coalesce(*[F.when(F.col("toxic") == k, F.lit(2 * most / v)) for k, v in n.items()])
    chosen = known.where(turn("toxicity", "doc_id") < rate).withColumn("second", (F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(10)) >= 7).cast("int"))
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).where("text is not null").join(F.broadcast(chosen), "doc_id").orderBy("doc_id").toArrow()  # about 4 * most rows
    text, toxic, second = (rows.column(c).to_pylist() for c in ("text", "toxic", "second"))
    book = [[t for t, y, s in zip(text, toxic, second, strict=True) if y == k and s == 0] for k in (1, 0)]
    check = [(t, y) for t, y, s in zip(text, toxic, second, strict=True) if s == 1]
    return learn(*book, ([t for t, _ in check], [y for _, y in check], n.get(1, 0) / sum(n.values())))


def score(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, threshold: float = 0.3, **how) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1), predicted. Whole texts are read; null and empty ones, and those of usual words alone, have no evidence."""
    m = fit(docs, labels, folds, held, **how)

    def run(batches):
        import pyarrow as pa

        shrink = m.compressors() if m.toxic else None
        for b in batches:
            texts = byte_column(b, "text")
            s = np.concatenate([m.score(evidence(texts[i:j], m, shrink)) for i, j in pieces(texts)]) if texts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = text_batches(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return out.select("doc_id", (fold("doc_id", folds) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
