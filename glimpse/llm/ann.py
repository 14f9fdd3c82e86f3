"""Approximate maximum inner product search with anisotropic four-bit quantisation.

Each component of a vector (or short subvector) is coded by one of 16 centres. The loss weighs the part of the error that is parallel
to the vector more than the part across it, as the former moves the inner products that matter. Codes are scanned by tables of
a query's products with all centres; the best, and all that what the codes leave out allows to be as good, are ranked again by exact
products of the original vectors.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glimpse.llm.common import stage, turn


def weights(dim: int, threshold: float = 0.2) -> float:
    """How much more the parallel error counts, for a threshold on the cosine between query and vector."""
    return max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))


def train(x: np.ndarray, sub: int = 2, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Centres [subspaces, 16, sub] for a sample of vectors: assignment by the anisotropic loss, centres by its minimum."""
    n, d = x.shape
    rng = np.random.default_rng(seed)
    eta = weights(d)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    parts, units = x.reshape(n, -1, sub), unit.reshape(n, -1, sub)
    centres = parts[rng.choice(n, 16, replace=n < 16)].transpose(1, 0, 2).copy()
    for _ in range(rounds):
        code = assign(x, centres, eta)
        for s in range(parts.shape[1]):
            for k in range(16):
                mine = code[:, s] == k
                if mine.any():
                    u = units[mine, s]
                    # sum of (I + (eta - 1) u u') c = sum of (I + (eta - 1) u u') x over the members
                    w = np.eye(sub) * len(u) + (eta - 1) * u.T @ u
                    y = parts[mine, s]
                    centres[s, k] = np.linalg.solve(w, y.sum(0) + (eta - 1) * (u * (u * y).sum(1, keepdims=True)).sum(0))
    return centres


def assign(x: np.ndarray, centres: np.ndarray, eta: float, passes: int = 2) -> np.ndarray:
    """Codes [vectors, subspaces]: coordinate descent on |r|^2 + (eta - 1) (r . unit)^2 over all subspaces of a vector."""
    n = len(x)
    s, _, sub = centres.shape
    unit = (x / np.linalg.norm(x, axis=1, keepdims=True)).reshape(n, s, sub)
    parts = x.reshape(n, s, sub)
    code = np.empty((n, s), np.uint8)
    along = np.zeros((n, s))
    for j in range(s):
        r = parts[:, j, None] - centres[j]
        code[:, j] = np.argmin((r * r).sum(2), 1)
        along[:, j] = (r[np.arange(n), code[:, j]] * unit[:, j]).sum(1)
    total = along.sum(1)
    for _ in range(passes):
        for j in range(s):
            r = parts[:, j, None] - centres[j]
            a = (r * unit[:, j, None]).sum(2)
            rest = total - along[:, j]
            code[:, j] = np.argmin((r * r).sum(2) + (eta - 1) * (rest[:, None] + a) ** 2, 1)
            along[:, j] = a[np.arange(n), code[:, j]]
            total = rest + along[:, j]
    return code


def packed(code: np.ndarray) -> np.ndarray:
    return code[:, 0::2] | (code[:, 1::2] << 4)


def tables(queries: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Products of queries with pairs of centres, one entry a byte of code: [bytes, 256, queries]."""
    s, _, sub = centres.shape
    t = np.einsum("qsd,skd->skq", queries.reshape(len(queries), s, sub), centres)
    low, high = t[0::2], t[1::2]
    return (high[:, :, None] + low[:, None, :]).reshape(s // 2, 256, len(queries)).astype(np.float32)


def scan(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Approximate products [vectors, queries]."""
    out = table[0][codes[:, 0]]
    for b in range(1, codes.shape[1]):
        out += table[b][codes[:, b]]
    return out


def usable(vectors: DataFrame, dim: int) -> DataFrame:
    """vec_id, v (doubles): vectors of ``dim`` components, all finite, not all zero, with an id."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") == dim) & ~F.coalesce(bad, F.lit(False)) & F.exists(v, lambda x: x != 0)).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def search(vectors: DataFrame, k: int = 20, every: int = 20, rerank: int = 100, sample: int = 4000, query_block: int = 8192, code_block: int = 32_768, tasks: int = 20_000, dim: int | None = None, sub: int = 1) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest by inner product for each vector whose id is divisible by ``every``.

    Centres are trained on a sample of about ``sample`` vectors; all are coded, by one centre for each ``sub`` components, and the length of what
    the code leaves out is kept beside it. Blocks of queries meet blocks of codes in tiles, one a task. The best ``rerank`` by approximate products
    get exact ones, whose ``k``-th is a floor; so does, whatever the vectors, each other one that its approximate product and the length left out,
    times the query's, allow to reach the floor. So no nearest vector is lost: where codes tell little, as among near copies, more are ranked again. Tiles are dealt to
    at most ``tasks`` partitions, which hold one tile's state at a time. ``dim`` is the commonest length unless given; vectors of other lengths,
    null or zero ones and those with null or non-finite components take no part. Each row is a vector of its own, whatever its id: rows of one id
    are asked each, with ``k`` answers each, and find each other; only a query's own row is no candidate.
    """
    spark = vectors.sparkSession
    if dim is None:
        top = vectors.where("embedding is not null").groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
        dim = top.d if top else 0
    x = stage(usable(vectors, dim).withColumn("row", F.monotonically_increasing_id()), "vectors")
    n, most = x.agg(F.count("*"), F.max(F.array_max(F.transform("v", F.abs)))).first()
    if not n or not dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    unit = 2.0 ** np.clip(np.floor(np.log2(most)), -1000, 1000)  # codes are of vectors over it, so that no square overflows
    kind = np.float32 if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else np.float64  # in which vectors travel as they are
    picked = x.where(turn("ann", "vec_id") < sample / n).select("v").limit(2 * sample).toArrow()  # all rows of one id are picked together
    if picked.num_rows < min(n, 64):
        picked = x.select("v").limit(sample).toArrow()
    wide = dim + (-dim) % (2 * sub)  # a last byte may be half empty

    def matrix(col) -> np.ndarray:
        flat = np.asarray(col.combine_chunks().flatten() if hasattr(col, "combine_chunks") else col.flatten())
        out = np.zeros((len(col), wide))
        out[:, :dim] = flat.reshape(len(col), dim)
        return out

    known = matrix(picked.column("v")) / unit
    known = known[(known * known).sum(1) > 0]  # of the least ones squares are zero
    centres = train(known if len(known) else np.ones((1, wide)), sub)
    eta = weights(dim)

    def encode(batches):
        """Ids, row numbers, codes, lengths that codes leave out and the vectors, a record for up to 2048. Of equal vectors only the first ``k`` + 1 can be hits."""
        import pyarrow as pa

        for b in batches:
            for i in range(0, b.num_rows, 2048):
                part = b.slice(i, 2048)
                v, ids, rows = matrix(part.column("v")), part.column("vec_id").to_numpy(), part.column("row").to_numpy()
                kept = _first_of_equals(v, ids, rows, k + 1)
                v, ids, rows = v[kept], ids[kept], rows[kept]
                y = v / unit
                y[(y * y).sum(1) == 0] = 0.0
                with np.errstate(invalid="ignore", divide="ignore"):
                    code = assign(y, centres, eta)
                size = np.sqrt((y * y).sum(1))
                left = np.sqrt(((y - centres[np.arange(len(centres)), code].reshape(len(y), wide)) ** 2).sum(1))
                left += 1e-5 * (size + left) + 1e-300  # sums of tables are in single precision
                cells = ids.tobytes(), rows.tobytes(), packed(code).tobytes(), left.tobytes(), np.ascontiguousarray(v[:, :dim], kind).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cells], names=["ids", "rows", "codes", "left", "v"])

    def group(batches):
        """Queries, a record for up to 256."""
        import pyarrow as pa

        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                cells = part.column("asker").to_numpy().tobytes(), part.column("query_id").to_numpy().tobytes(), matrix(part.column("q")).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cells], names=["askers", "query_ids", "q"])

    def best(batches):
        """Of each tile (its queries come first, then its codes), the ``k`` nearest of each query with their products."""
        import pyarrow as pa

        now, asked = None, []

        def rows():
            for a in asked:
                there = a.row < np.iinfo(np.int64).max
                of = there.sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.repeat(a.askers, of), np.repeat(a.query_ids, of), a.row[there], a.vec_id[there], a.score[there])], names=["asker", "query_id", "row", "vec_id", "score"])

        for b in batches:
            for r in range(b.num_rows):
                tile, askers, query_ids, q, ids, c_rows, codes, left, v = (b.column(c)[r] for c in ("tile", "askers", "query_ids", "q", "ids", "rows", "codes", "left", "v"))
                if tile.as_py() != now:
                    yield from rows()
                    now, asked = tile.as_py(), []
                if askers.is_valid:
                    asked.append(_Asked(np.frombuffer(askers.as_py(), np.int64), np.frombuffer(query_ids.as_py(), np.int64), np.frombuffer(q.as_py()).reshape(-1, wide), dim, k, rerank, unit))
                    continue
                row = np.frombuffer(c_rows.as_py(), np.int64)
                codes = np.frombuffer(codes.as_py(), np.uint8).reshape(len(row), -1)
                whole = np.frombuffer(v.as_py(), kind).reshape(len(row), dim).astype(float)
                for a in asked:
                    a.meet(scan(tables(a.unit, centres), codes), np.frombuffer(left.as_py()), whole, np.frombuffer(ids.as_py(), np.int64), row)
        yield from rows()

    codes = stage(x.mapInArrow(encode, "ids binary, rows binary, codes binary, left binary, v binary"), "codes")
    q = x.where(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("row").alias("asker"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    asked = q.mapInArrow(group, "askers binary, query_ids binary, q binary")
    across, down = (max(1, -(-m // size)) for m, size in ((q.count(), query_block), (n, code_block)))
    # An equi-join of tiles: query records are dealt to ``across`` blocks and code records to ``down``; each goes to the tiles of its block.
    part = lambda of, blocks: F.pmod(F.xxhash64(of), F.lit(blocks))
    asked = asked.withColumn("a", part("askers", across)).withColumn("tile", F.explode(F.transform(F.sequence(F.lit(0), F.lit(down - 1)), lambda d: F.col("a") * down + d))).drop("a")
    coded = codes.withColumn("d", part("rows", down)).withColumn("tile", F.explode(F.transform(F.sequence(F.lit(0), F.lit(across - 1)), lambda a: a * down + F.col("d")))).drop("d")
    both = asked.unionByName(coded, allowMissingColumns=True)
    tiles = both.repartition(min(across * down, tasks), "tile").sortWithinPartitions("tile", F.col("askers").isNull())
    found = tiles.mapInArrow(best, "asker long, query_id long, row long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("asker").orderBy(F.desc("score"), "vec_id", "row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _first_of_equals(v: np.ndarray, ids: np.ndarray, rows: np.ndarray, most: int) -> np.ndarray:
    """Places of all vectors, of equal ones those of the first ``most`` by id and row."""
    whole = np.ascontiguousarray(v).view(np.dtype((np.void, v.itemsize * v.shape[1]))).ravel()
    _, kind = np.unique(whole, return_inverse=True)
    order = np.lexsort((rows, ids, kind))
    begin = np.searchsorted(kind[order], np.arange(kind.max() + 1))
    return np.sort(order[np.arange(len(order)) - begin[kind[order]] < most])


def exact(q: np.ndarray, v: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of pairs of columns of ``q`` and ``v``, summed component by component from the first on, as a fold does."""
    out = np.zeros(len(i))
    for a in range(0, len(i), 32_768):
        p, r, s = i[a : a + 32_768], j[a : a + 32_768], out[a : a + 32_768]
        for c in range(len(q)):
            s += q[c].take(p) * v[c].take(r)
    return out


class _Asked:
    """A group of queries of a tile and the nearest vectors they have met."""

    def __init__(self, askers: np.ndarray, query_ids: np.ndarray, q: np.ndarray, dim: int, k: int, rerank: int, unit: float):
        self.askers, self.query_ids, self.k, self.rerank = askers, query_ids, k, rerank
        most = np.abs(q).max(1, keepdims=True)
        self.size = (most * np.sqrt(((q / most) ** 2).sum(1, keepdims=True)))[:, 0]
        self.unit = q / most / np.sqrt(((q / most) ** 2).sum(1, keepdims=True))
        self.q, self.columns, self.over = q[:, :dim], np.ascontiguousarray(q[:, :dim].T), unit
        self.score = np.full((len(q), k), -np.inf)
        self.vec_id, self.row = np.full((len(q), k), np.iinfo(np.int64).max), np.full((len(q), k), np.iinfo(np.int64).max)

    def floor(self) -> np.ndarray:
        """What a vector over the unit must reach with a query of length one."""
        least = np.abs(self.score[:, -1])
        told = (self.row[:, -1] < np.iinfo(np.int64).max) & (least < 1e290) & ((least > 1e-290) | (self.size * self.over > 1e-150))  # products beyond are no measure
        with np.errstate(all="ignore"):
            return np.where(told, self.score[:, -1] / self.size / self.over, -np.inf)

    def meet(self, near: np.ndarray, left: np.ndarray, v: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Take in vectors ``v`` with their approximate products [vectors, queries] and the lengths that these leave out."""
        near = np.ascontiguousarray(near.T)
        columns = np.ascontiguousarray(v.T)
        seen = rows[None, :] == self.askers[:, None]
        new = np.flatnonzero(self.row[:, -1] == np.iinfo(np.int64).max)
        if len(new):
            some = min(self.rerank, len(rows))
            first = np.argpartition(-near[new], some - 1, axis=1)[:, :some]
            i, j = np.repeat(new, some), first.ravel()
            own = seen[i, j]
            seen[i, j] = True
            self.take(columns, i[~own], j[~own], ids, rows)
        can = (near + left >= self.floor()[:, None]) & ~seen
        i, j = np.nonzero(can)
        if len(i) > can.size / 16:  # codes tell little: what sums in any order allow
            with np.errstate(over="ignore", invalid="ignore"):
                s = self.q @ v.T
                far = 1e-12 * np.abs(self.q) @ np.abs(v).T + 1e-300
                s = np.where(np.isfinite(s) & np.isfinite(far), s + far, np.inf)
                low = np.where(can & np.isfinite(s), s - 2 * far, -np.inf)
                least = self.score[:, -1]
                if len(rows) > self.k:
                    least = np.maximum(least, np.partition(low, len(rows) - self.k, axis=1)[:, len(rows) - self.k])
                i, j = np.nonzero(can & (s >= least[:, None]))
        self.take(columns, i, j, ids, rows)

    def take(self, columns: np.ndarray, i: np.ndarray, j: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Merge pairs of queries and vectors, those of one query together, by their exact products."""
        with np.errstate(over="ignore", invalid="ignore"):
            s = exact(self.columns, columns, i, j)
        s[np.isnan(s)] = -np.inf
        good = s >= self.score[i, -1]
        i, j, s = i[good], j[good], s[good]
        who, first = np.unique(i, return_index=True)
        for r, a, b in zip(who, first, np.append(first, len(i))[1:], strict=True):
            at = j[a:b]
            score, vec_id, row = np.concatenate([self.score[r], s[a:b]]), np.concatenate([self.vec_id[r], ids[at]]), np.concatenate([self.row[r], rows[at]])
            order = np.lexsort((row, vec_id, row == np.iinfo(np.int64).max, -score))[: self.k]
            self.score[r], self.vec_id[r], self.row[r] = score[order], vec_id[order], row[order]
