"""Language identification by segmentation-marginalised unigrams.

A language is a distribution over the pieces of a fixed public vocabulary. A word's probability is the sum over all its
segmentations into pieces, which the forward algorithm gives; a text's is the product over its words. Piece probabilities
come from a few rounds of expectation maximisation on word counts of a bounded sample of labelled documents.
"""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glimpse.llm.common import LETTERS, Words, byte_column, fold, free_name, pieces, text_batches, turn

VOCABULARY = os.environ.get("GLIMPSE_VOCABULARY", "/opt/tokenizers/piece_bpe_32k.model")
UNKNOWN = 1e-7
#: Characters of a word, and of a batch of words, that are in hand at a time; sums are rescaled after this many characters.
BLOCK, CELLS, RESCALE = 512, 50_000, 8


def load_pieces(path: str = VOCABULARY) -> dict[str, int]:
    """The vocabulary's pieces as lower-case text, a word's beginning written as the mark the vocabulary has for it."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out: dict[str, int] = {}
    for i in range(sp.vocab_size()):
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)):
            piece = sp.id_to_piece(i).lower()
            if piece:
                out.setdefault(piece, len(out))
    return out


class Trie:
    """The vocabulary as arrays: a state for each beginning of a piece, ``step`` sorted keys (state, letter), ``to`` the states they lead to, ``piece`` each state's piece or -1."""

    def __init__(self, vocab: dict[str, int]):
        self.none, self.longest = len(vocab), max(map(len, vocab), default=1)
        letters = sorted({c for piece in vocab for c in piece})
        self.letters = len(letters) + 1
        self.letter = np.zeros(max(map(ord, letters), default=0) + 2, np.int64)  # 0 is any other character
        self.letter[[ord(c) for c in letters]] = np.arange(1, self.letters)
        state: dict[str, int] = {"": 0}
        for piece in vocab:
            for k in range(1, len(piece) + 1):
                state.setdefault(piece[:k], len(state))
        key = np.array([state[x[:-1]] * self.letters + self.letter[ord(x[-1])] for x in state if x], np.int64)
        order = np.argsort(key)
        self.step, self.to = np.append(key[order], -1), np.append(order + 1, 0)
        self.piece = np.array([vocab.get(x, -1) for x in state], np.int32)

    def codes(self, text: str) -> np.ndarray:
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        return self.letter[np.minimum(c, len(self.letter) - 1)]

    def next(self, state: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which states go on by their letter, and the states these come to."""
        key = state * self.letters + letter
        i = np.searchsorted(self.step[:-1], key)
        on = np.flatnonzero(self.step[i] == key)
        return on, self.to[i[on]]


class Lattice:
    """All segmentations of many words of any length. Words go in batches of like length, and through each in blocks of ``BLOCK`` characters.

    Sums over segmentations are kept for the last characters only, as many as the longest piece has, beside a running logarithm.
    """

    def __init__(self, words: list[str], vocab: dict[str, int], trie: Trie | None = None):
        self.words = ["▁" + w for w in words]
        self.length = np.fromiter(map(len, self.words), np.int64, len(words))
        self.trie = trie or Trie(vocab)
        self.none, self.longest = self.trie.none, self.trie.longest
        self.kept: dict[int, np.ndarray] = {}
        order = np.argsort(self.length, kind="stable")
        wide = np.minimum(self.length[order], BLOCK)
        self.batches, i = [], 0
        while i < len(order):
            n = max(1, int(np.searchsorted(np.arange(1, len(order) - i + 1) * wide[i:], CELLS, side="right")))
            self.batches.append(order[i : i + n])
            i += n

    def _blocks(self, k: int) -> list[tuple[int, int]]:
        """The blocks of a batch: first end less one, and how many of its words are over by then."""
        length = self.length[self.batches[k]]
        return [(lo, int(np.searchsorted(length, lo, side="right"))) for lo in range(0, int(length[-1]), BLOCK)]

    def _ids(self, k: int, lo: int, over: int) -> np.ndarray:
        """The pieces that may end at each character of a block: ids[word, end - lo - 1, longest - length]; ``none`` is none, one more an unknown character."""
        if lo == 0 and k in self.kept:
            return self.kept[k]
        rows, most = self.batches[k][over:], self.longest
        width = min(BLOCK, int(self.length[rows[-1]]) - lo)
        # the block's characters with those that pieces may begin with before it; the character after them ends all pieces
        before, cols = most - 1, most + width
        left = "\0" * max(0, before - lo)
        cut = (left + self.words[r][max(0, lo - before) : lo + width] for r in rows.tolist())
        codes = self.trie.codes("".join(x.ljust(cols, "\0") for x in cut))
        inside = np.arange(lo - before, lo + width + 1) < np.minimum(self.length[rows], lo + width)[:, None]
        inside[:, : len(left)] = False
        ids = np.full((len(rows), width, most), self.none, np.int32)
        ids[inside[:, before:-1], -1] = self.none + 1
        start = np.flatnonzero(inside)
        state = np.zeros(len(start), np.int64)
        for z in range(most):
            on, state = self.trie.next(state, codes[start + z])
            start = start[on]
            found = np.flatnonzero((self.trie.piece[state] >= 0) & (start % cols + z >= before))
            ids[start[found] // cols, start[found] % cols + z - before, most - 1 - z] = self.trie.piece[state[found]]
        if int(self.length[rows[-1]]) <= BLOCK:
            self.kept[k] = ids
        return ids

    def _forward(self, ids: np.ndarray, p: np.ndarray, last: np.ndarray, log: np.ndarray, each) -> tuple[np.ndarray, np.ndarray]:
        """Sums over segmentations of beginnings through a block, from those of the last characters before it, times exp(log). ``each(j, sums, log)`` sees those of each end."""
        most, width = self.longest, ids.shape[1]
        a = np.concatenate([last, np.zeros((len(ids), width, p.shape[1]))], 1)
        for j in range(width):
            a[:, most + j] = np.einsum("nzl,nzl->nl", a[:, j : j + most], p[ids[:, j]])
            each(j, a[:, most + j], log)
            if j % RESCALE == RESCALE - 1 or j == width - 1:
                a[:, j + 1 : j + 1 + most], log = _rescaled(a[:, j + 1 : j + 1 + most], log)
        return a[:, width:], log

    def _start(self, k: int, languages: int) -> tuple[np.ndarray, np.ndarray]:
        last = np.zeros((len(self.batches[k]), self.longest, languages))
        last[:, -1] = 1
        return last, np.zeros((len(last), languages))

    def log_probability(self, p: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.length), p.shape[1]))
        for k, batch in enumerate(self.batches):
            last, log = self._start(k, p.shape[1])
            gone = 0
            for lo, over in self._blocks(k):
                rows = batch[over:]

                def each(j, sums, log, rows=rows, ends=self.length[rows] - lo - 1):
                    i, n = np.searchsorted(ends, (j, j + 1))
                    out[rows[i:n]] = np.log(sums[i:n]) + log[i:n]

                last, log = self._forward(self._ids(k, lo, over), p, last[over - gone :], log[over - gone :], each)
                gone = over
        return out

    def expected(self, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected counts of the pieces, words weighted by language: weight [word, language]."""
        out, n = np.zeros_like(p), p.shape[1]
        total = self.log_probability(p)
        most = self.longest
        for k, batch in enumerate(self.batches):
            states, gone = [], 0
            last, log = self._start(k, n)
            for lo, over in self._blocks(k):
                last, log = last[over - gone :], log[over - gone :]
                states.append((lo, over, last, log))
                if lo + BLOCK < self.length[batch[-1]]:
                    last, log = self._forward(self._ids(k, lo, over), p, last, log, lambda *_: None)
                gone = over
            after, log_after = np.zeros((0, most, n)), np.zeros((0, n))
            for lo, over, last, log in reversed(states):
                ids, rows = self._ids(k, lo, over), batch[over:]
                width = ids.shape[1]
                with np.errstate(divide="ignore"):
                    # logarithms of beginnings (from longest - 1 characters before the block on) and of ends
                    begun, ended = np.empty((len(rows), most + width, n)), np.empty((len(rows), width, n))
                    begun[:, :most] = np.log(last) + log[:, None]

                    def each(j, sums, log, begun=begun):
                        begun[:, most + j] = np.log(sums) + log

                    self._forward(ids, p, last, log, each)
                    fresh = len(rows) - len(after)  # words that end in this block
                    b = np.concatenate([np.zeros((len(rows), width, n)), np.concatenate([np.zeros((fresh, most, n)), after])], 1)
                    log_b = np.concatenate([np.zeros((fresh, n)), log_after])
                    ends = self.length[rows] - lo - 1
                    # b[:, j + most] is of the block's end j; the block's own ends come after the characters before it
                    for j in range(width - 1, -1, -1):
                        i, z = np.searchsorted(ends, (j, j + 1))
                        b[i:z, most + j] = 1
                        ended[:, j] = np.log(b[:, most + j]) + log_b
                        b[:, j : j + most] += b[:, most + j, None] * p[ids[:, j]]
                        if j % RESCALE == 0:
                            b[:, j : j + most], log_b = _rescaled(b[:, j : j + most], log_b)
                after, log_after = b[:, :most], log_b
                r, j, z = np.nonzero(ids != self.none)
                i = ids[r, j, z]
                share = np.exp(begun[r, j + z] + ended[r, j] - total[rows][r]) * p[i] * weight[rows][r]
                for x in range(n):
                    out[:, x] += np.bincount(i, share[:, x], len(p))
        return out


def _rescaled(sums: np.ndarray, log: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums [word, place, language] with a greatest one of 1, and the logarithm beside them."""
    top = sums.max(1)
    top[top <= 0] = 1
    return sums / top[:, None], log + np.log(top)


class Model:
    def __init__(self, languages: list[str], vocab: dict[str, int], p: np.ndarray):
        self.languages, self.vocab, self.p = languages, vocab, p
        self.trie: Trie | None = None  # made where it is used first

    def words(self, words: list[str]) -> np.ndarray:
        """Log probabilities [word, language]."""
        if self.trie is None:
            self.trie = Trie(self.vocab)
        out = [Lattice(words[i : i + 5000], self.vocab, self.trie).log_probability(self.p) for i in range(0, len(words), 5000)]
        return np.concatenate(out) if out else np.zeros((0, len(self.languages)))


def _smoothed(counts: np.ndarray) -> np.ndarray:
    counts = counts.copy()
    counts[-2] = 0
    known = counts[:-2] + 0.02
    p = np.zeros_like(counts)
    p[:-2] = known / known.sum(0)
    p[-1] = UNKNOWN
    return p


def learn(counts: list[tuple[str, str, int]], vocab: dict[str, int], rounds: int = 4) -> Model:
    """counts: (language, word, times)."""
    languages = sorted({x[0] for x in counts})
    words = {w: i for i, w in enumerate(sorted({x[1] for x in counts}))}
    if not languages:
        return Model([], vocab, np.zeros((len(vocab) + 2, 0)))
    weight = np.zeros((len(words), len(languages)))
    for lang, w, n in counts:
        weight[words[w], languages.index(lang)] += n
    lattice = Lattice(list(words), vocab)
    p = np.zeros((len(vocab) + 2, len(languages)))
    p[:-2] = 1 / len(vocab)
    p[-1] = UNKNOWN
    for _ in range(rounds):
        p = _smoothed(lattice.expected(p, weight))
    return Model(languages, vocab, p)


def sample_counts(train: DataFrame, per_language: int) -> list[tuple[str, str, int]]:
    """Word counts of about ``per_language`` whole documents of each language, chosen by hash."""
    n = {r[0]: r[1] for r in train.groupBy("lang").count().collect()}  # one row a language
    if not n:
        return []
    rate = F.coalesce(*[F.when(F.col("lang") == k, F.lit(per_language / v)) for k, v in n.items()])
    chosen = train.where(turn("langid", "doc_id") < rate)
    lower = F.lower("text")
    words = chosen.select("lang", F.explode(F.split(lower, r"[\x00-\x60\x7B-\x7F]+")).alias("w")).where("w != ''")
    counted = words.groupBy("lang", "w").agg(F.count("*").alias("n"))
    return sorted((r["lang"], r["w"], r["n"]) for r in counted.toArrow().to_pylist())  # bounded by the sample


def fit(docs: DataFrame, per_language: int = 150, folds: int = 5, vocabulary: str = VOCABULARY) -> Model:
    """A model of about ``per_language`` documents of each language among those with text and non-null lang outside fold 0."""
    train = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (fold("doc_id", folds) != 0)).select("doc_id", "text", "lang")
    return learn(sample_counts(train, per_language), load_pieces(vocabulary))


_CACHE: dict = {}


def score_texts(texts: list[bytes | None], model: Model, cache: dict[bytes, int], rows: list[np.ndarray]) -> tuple[list[str], list[float]]:
    """Language and posterior of each text. ``cache`` and ``rows`` keep words met before."""
    import regex

    letter = regex.compile(r"\p{L}")
    n = len(model.languages)
    total = np.zeros((len(texts), n))
    for i, j in pieces(texts):
        w = Words(texts[i:j], LETTERS)
        if not len(w.hash) or not n:
            continue
        _, first, inverse = np.unique(w.hash, return_index=True, return_inverse=True)
        names = [w.word(k) for k in first.tolist()]
        new = [x for x in names if x not in cache]
        if len(cache) + len(new) > 100_000:
            cache.clear()
            rows.clear()
            new = names
        if new:
            base = sum(map(len, rows))
            rows.append(model.words([x.decode("utf-8", "replace").lower() for x in new]))
            if len(rows) > 64:
                rows[:] = [np.concatenate(rows)]
            cache.update((x, base + k) for k, x in enumerate(new))
        table = np.concatenate(rows) if len(rows) > 1 else rows[0]
        rows[:] = [table]
        mine = table[np.fromiter(map(cache.__getitem__, names), np.int64, len(names))]
        for k in range(n):
            total[i:j, k] = np.bincount(w.doc, mine[inverse, k], j - i)
    lang, score = [], []
    for k, t in enumerate(texts):
        if t is None or not n or not letter.search(t.decode("utf-8", "replace")):
            lang.append("und")
            score.append(0.0)
        else:
            best = int(np.argmax(total[k]))
            lang.append(model.languages[best])
            score.append(float(1 / np.exp(total[k] - total[k, best]).sum()))
    return lang, score


def annotate(docs: DataFrame, model: Model, lang: str, score: str) -> DataFrame:
    """``docs`` with two more columns: the likeliest language (und for null texts and those without a letter) and its posterior, 0 for und."""

    def run(batches):
        import pyarrow as pa

        cache, rows = {}, []
        for b in batches:
            l, s = score_texts(byte_column(b, "text"), model, cache, rows)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(l, pa.string()), pa.array(s, pa.float64())], names=[*b.schema.names, lang, score])

    ddl = docs.select("*", F.lit("").alias(lang), F.lit(0.0).alias(score)).schema
    for f in ddl.fields:
        f.nullable = True
    return text_batches(docs).mapInArrow(run, ddl)


def identify(docs: DataFrame, **how) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score. Learns from ``docs`` outside fold 0."""
    out = annotate(docs.select("doc_id", "text"), fit(docs, **how), "lang_pred", "score")
    return out.select("doc_id", (fold("doc_id", how.get("folds", 5)) == 0).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, least: float = 0.5, **how) -> DataFrame:
    """``docs`` whose language is known with a posterior of ``least``; all columns are kept."""
    lang, score = free_name(docs, "__lang"), free_name(docs, "__score")
    return annotate(docs, fit(docs, **how), lang, score).where((F.col(lang) != "und") & (F.col(score) >= least)).drop(lang, score)
