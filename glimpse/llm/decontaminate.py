"""Benchmark decontamination by suffix arrays over shards of the training texts.

Each task builds, for a shard of a few MB of its documents, a suffix array over words. Every benchmark suffix is binary-searched in
it by its first ``window`` words, which gives the places of verbatim matches; for documents that have some, the longest match with
any item is then found by doubling and halving its length. The benchmark goes to the tasks in blocks of bounded size; documents are
never shuffled.

Only suffixes that begin with known benchmark words enter an array: any other can't match. Words are compared by 64-bit hash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glimpse.llm.common import ALNUM, Words, _powers, byte_column, free_name, mix, pieces, stage, text_batches

_HITS = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("longest", T.LongType()),
    T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("ends", T.ArrayType(T.LongType())),
    T.StructField("items", T.ArrayType(T.StringType())),
])
#: Lengths whose benchmark passages a task keeps hashed.
KEPT = 16


def _spread(n: np.ndarray) -> np.ndarray:
    """0..n[0]-1, then 0..n[1]-1, and so on."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


class _Block:
    """The windows of some benchmark items, each different one once, as packed keys to be searched for."""

    def __init__(self, ids: list[str], texts: list[bytes], window: int):
        w = Words(texts, ALNUM)
        self.ids, self.window = ids, window
        self.hash, self.doc_end = w.hash, np.repeat(w.first[1:], w.count)
        self.vocab, word = np.unique(w.hash, return_inverse=True)
        word = np.concatenate([word + 1, np.zeros(window, np.int64)])
        self.bits = max(1, int(len(self.vocab)).bit_length())
        self.per = 62 // self.bits  # one bit is left free, as the bound above a key of all ones must fit as well
        many = np.where(w.count > 0, np.maximum(w.count - window + 1, 1), 0)
        start = np.repeat(w.first[:-1], many) + _spread(many)
        length, item = np.repeat(np.minimum(w.count, window), many), np.repeat(np.arange(len(texts)), many)
        keys = np.stack([length, *self.pack(word, start, length)])
        order = np.lexsort((item, *keys[::-1]))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(keys[:, order]) != 0).any(0)
        self.length, *self.columns = keys[:, order[new]]
        # the items of each window, each once
        which = np.cumsum(new) - 1
        once = new.copy()
        once[1:] |= np.diff(item[order]) != 0
        self.item = item[order[once]]
        self.items_from = np.searchsorted(which[once], np.arange(len(self.length) + 1))
        self.shortest = int(self.length.min()) if len(self.length) else window
        self._passages: dict[int, np.ndarray] = {}

    def pack(self, ids: np.ndarray, at: np.ndarray, length: np.ndarray | int) -> list[np.ndarray]:
        """The ``length`` words (``window`` at most) from each place on, as few integers that sort as the words do."""
        out = []
        for c in range(0, self.window, self.per):
            key = np.zeros(len(at), np.int64)
            for k in range(self.per):
                key <<= self.bits
                if c + k < self.window:
                    key |= np.where(c + k < length, ids[at + c + k], 0)
            out.append(key)
        return out

    def search(self, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """For each window the range of the suffix array whose suffixes begin with it."""
        n = len(columns[0])
        lo, hi = np.zeros(len(self.length), np.int64), np.full(len(self.length), n, np.int64)
        for c, (column, key) in enumerate(zip(columns, self.columns, strict=True)):
            known = np.clip(self.length - c * self.per, 0, self.per)  # words of the window in this column
            free = (self.per - known) * self.bits
            lo, hi = _bisect(column, lo, hi, key), _bisect(column, lo, hi, key + (np.int64(1) << free))
        return lo, hi

    def passages(self, length: int) -> np.ndarray:
        """The sorted hashes of all runs of so many words of an item."""
        if length not in self._passages:
            if len(self._passages) >= KEPT:
                self._passages.pop(next(iter(self._passages)))
            at = np.flatnonzero(np.arange(len(self.hash)) + length <= self.doc_end)
            self._passages[length] = np.unique(_runs(_sums(self.hash), at, length))
        return self._passages[length]


def _sums(words: np.ndarray) -> np.ndarray:
    up, _ = _powers(len(words) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words) * up[: len(words)])])


def _runs(sums: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hashes of runs of ``length`` words, by sums of their words' hashes times powers."""
    _, down = _powers(len(sums))
    return mix((sums[at + length] - sums[at]) * down[at] + np.uint64(length))


def _bisect(column: np.ndarray, lo: np.ndarray, hi: np.ndarray, key: np.ndarray) -> np.ndarray:
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        less = column[np.minimum(mid, len(column) - 1)] < key
        lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
    return lo


def _longest(words: np.ndarray, b: _Block) -> int:
    """The length of a text's longest run of words that stands in an item, which has ``window`` words at least."""
    sums, n = _sums(words), len(words)

    def found(length, at):
        at = at[at + length <= n]
        if not len(at):
            return at
        known = b.passages(length)
        return at[_find(known, _runs(sums, at, length))] if len(known) else at[:0]

    best, step, at = b.window, b.window, np.arange(n)
    at = found(best, at)
    while len(more := found(best + step, at)):
        best, step, at = best + step, 2 * step, more
    while step > 1:
        step = -(-step // 2)
        if len(more := found(best + step, at)):
            best, at = best + step, more
    return best + 1 if len(found(best + 1, at)) else best


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return table[np.minimum(np.searchsorted(table, keys), len(table) - 1)] == keys


def _match(w: Words, b: _Block, out: list[dict]) -> None:
    """Add the matches of the block's windows in the texts of one shard."""
    if not len(b.length) or not len(w.hash):
        return
    found = np.minimum(np.searchsorted(b.vocab, w.hash), len(b.vocab) - 1)
    known = b.vocab[found] == w.hash
    place = np.arange(len(w.hash)) + w.doc  # one gap after each text
    ids = np.zeros(int(place[-1]) + 2 + b.window + b.per, np.int64)
    ids[place] = np.where(known, found + 1, 0)
    gaps = np.flatnonzero(ids == 0)
    at = place[known]
    at = at[gaps[np.searchsorted(gaps, at)] - at >= b.shortest]
    if not len(at):
        return
    columns = b.pack(ids, at, b.window)
    order = np.lexsort(columns[::-1])  # the suffix array
    lo, hi = b.search([c[order] for c in columns])
    n = hi - lo
    if not n.any():
        return
    # Windows differ, so at most one of each length begins at a place.
    test = np.repeat(np.arange(len(n)), n)
    where = at[order[np.repeat(lo, n) + _spread(n)]]
    length = b.length[test]
    doc_of = np.repeat(-1, len(ids))
    doc_of[place] = w.doc
    cover = np.cumsum(np.bincount(where, minlength=len(ids) + 1) - np.bincount(where + length, minlength=len(ids) + 1)) > 0
    edge = np.diff(cover.astype(np.int8), prepend=0)
    for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
        d = int(doc_of[s])
        base = int(w.first[d]) + d
        out[d]["starts"].append(s - base)
        out[d]["ends"].append(e - base)
    pairs = np.unique(doc_of[where] * len(n) + test)
    doc, test = pairs // len(n), pairs % len(n)
    many = np.diff(b.items_from)[test]
    items = b.item[np.repeat(b.items_from[test], many) + _spread(many)]
    for x in np.unique(np.repeat(doc, many) * len(b.ids) + items).tolist():
        out[x // len(b.ids)]["items"].append(b.ids[x % len(b.ids)])
    for d in np.unique(doc).tolist():
        mine = int(b.length[test[doc == d]].max())
        if mine == b.window:
            mine = _longest(w.hash[w.first[d] : w.first[d + 1]], b)
        out[d]["longest"] = max(out[d]["longest"], mine)


def _blocks(benchmark: DataFrame, window: int, block_bytes: int):
    ids, texts, size = [], [], 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("binary").alias("t"))
    for r in rows.where("i is not null and t is not null").toLocalIterator():
        ids.append(r.i)
        texts.append(bytes(r.t))
        size += len(r.t)
        if size >= block_bytes:
            yield _Block(ids, texts, window), size
            ids, texts, size = [], [], 0
    yield _Block(ids, texts, window), size


def _pass(docs: DataFrame, blocks: list[_Block], into: str, text: str) -> DataFrame:
    """One pass of ``docs``, which have the column ``into`` already, against some blocks."""

    def run(batches):
        import pyarrow as pa

        kind = pa.struct([("n_words", pa.int64()), ("longest", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])
        for batch in batches:
            texts, found = byte_column(batch, text), []
            for i, j in pieces(texts):
                w = Words(texts[i:j], ALNUM)
                out = [{"n_words": n, "longest": 0, "starts": [], "ends": [], "items": []} for n in w.count.tolist()]
                for b in blocks:
                    _match(w, b, out)
                found += out
            for old, new in zip(batch.column(into).to_pylist(), found, strict=True):
                if old:
                    new["longest"] = max(new["longest"], old["longest"])
                    for k in ("starts", "ends", "items"):
                        new[k] = old[k] + new[k]
            k = batch.schema.get_field_index(into)
            yield pa.RecordBatch.from_arrays([pa.array(found, kind) if c == k else batch.column(c) for c in range(batch.num_columns)], names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def annotate(docs: DataFrame, benchmark: DataFrame, into: str, text: str = "text", window: int = 13, block_bytes: int = 4 << 20, pass_bytes: int = 32 << 20) -> DataFrame:
    """``docs`` with a struct column ``into``: n_words, longest, starts and ends (word spans per block), items (ids, distinct per block).

    A null text has no words; a null item id or item text, and an item without words, occur nowhere. Items of one id are one item.
    A benchmark of any size is searched for whole: ``pass_bytes`` of it at a time are on the driver and in the tasks; where it has more, the
    documents with what was found are written to the shared folder and read again for the next pass.
    """
    done = text_batches(docs).withColumn(into, F.lit(None).cast(_HITS))
    held, size = [], 0
    for block, n in _blocks(benchmark, window, block_bytes):
        if held and size + n > pass_bytes:
            done = stage(_pass(done, held, into, text), "hits")
            held, size = [], 0
        held.append(block)
        size += n
    return _pass(done, held, into, text)


def _covered(hits):
    """Words in the union of spans that may overlap, as they come from several blocks."""
    spans = F.array_sort(F.arrays_zip(hits["starts"], hits["ends"]))
    step = F.aggregate(
        spans, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda a, x: F.struct((a["n"] + F.greatest(x["ends"] - F.greatest(x["starts"], a["to"]), F.lit(0).cast("long"))).alias("n"), F.greatest(a["to"], x["ends"]).alias("to")),
        lambda a: a["n"],
    )
    return step


def contamination(docs: DataFrame, benchmark: DataFrame, share: int = 20, **how) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items, longest, contaminated.

    A document is contaminated when a benchmark window occurs in it and the words hit are at least 1/``share`` of its words. Repeated
    rows are judged each; see ``annotate`` for nulls and empty texts.
    """
    hits = annotate(docs.select("doc_id", "text"), benchmark, "hits", **how)
    h = F.col("hits")
    items = F.array_sort(F.array_distinct(h["items"]))
    n_hit = _covered(h)
    return hits.select(
        "doc_id", h["n_words"].alias("n_words"), n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), h["longest"].alias("longest"),
    ).withColumn("contaminated", F.expr(f"n_hit > 0 and {share} * n_hit >= n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, share: int = 20, **how) -> DataFrame:
    """``docs`` without the contaminated documents; all columns are kept as they are."""
    into = free_name(docs, "__hits")
    n = free_name(docs, "__n_hit")
    out = annotate(docs, benchmark, into, **how)
    out = out.withColumn(n, _covered(F.col(into)))
    return out.where(~((F.col(n) > 0) & (share * F.col(n) >= F.col(into)["n_words"]))).drop(into, n)
