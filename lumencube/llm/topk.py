"""Exact top-k search by inner product with the threshold algorithm over sorted per-dimension lists.

Candidates are dealt to groups, and a group is searched block by block. A block sorts its candidates by every dimension.
For a query the lists are read from the end that favours it, all to the same depth; whatever turns up is scored in full.
No unread candidate can score above the query's products with the values at that depth, so reading stops when that bound
is below the k-th best score known: at first that within a bounded sample of candidates, which every task has, then that
of the blocks before. The best k of every group are merged by a window over the query.

The bounds of all queries at all depths are one matrix product, and so are the scores of queries whose lists have to be
read so deep that hardly a candidate is left out. On vectors without structure (many dimensions, no direction better
than another) that is all of them: there the bound cannot cut, whatever the order in which lists are read.

All queries meet all candidates, block by block: that is what the search is asked to do, and the work is the number
of queries times the number of candidates, less what the bound saves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import share

#: Rows of a block of candidates; rows of a group at most; groups into which small tables are dealt; queries of a group.
BLOCK, GROUP, SPREAD, QUERIES = 8192, 1 << 17, 32, 16384
#: Candidates of the sample that gives a first bound, and queries that are scored at once.
SAMPLE, ROWS = 2048, 128
#: Parts of a block to which its lists are read before the bound is looked at.
DEPTHS = tuple(2.0 ** (-k / 2) for k in range(24, 0, -1))
#: Where the lists read hold so many times the block's candidates in all, every candidate counts as read.
COVERED = 3.0


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id, vec (floor(scale * x) as float32 where all components are exact in that, else as float64), dim; only rows whose components are all finite."""
    kind = dict(df.dtypes)[id_col]

    def pack(batches):
        for b in batches:
            ids, out, dims = [], [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if not v.is_valid or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(x).all():
                    continue
                x = np.floor(x * scale) + 0.0
                if np.isinf(x).any():
                    raise ValueError(f"a component of {i} is too large for a double once it is scaled")
                ids.append(i)
                out.append(x.astype("<f4" if np.abs(x).max(initial=0) < 2.0**24 else "<f8").tobytes())
                dims.append(len(x))
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(out, pa.binary()), pa.array(dims, pa.int32())], ["id", "vec", "dim"])

    return df.select(id_col, vector_col).mapInArrow(pack, f"id {kind}, vec binary, dim int")


def matrix(vecs: list[bytes], dim: int) -> np.ndarray:
    """Packed vectors as rows of doubles."""
    if all(len(v) == 4 * dim for v in vecs):
        return np.frombuffer(b"".join(vecs), "<f4").reshape(len(vecs), dim).astype(np.float64)
    return np.stack([np.frombuffer(v, "<f4" if len(v) == 4 * dim else "<f8").astype(np.float64) for v in vecs])


def largest(m: np.ndarray) -> np.ndarray:
    return np.abs(m).max(axis=1, initial=0)


def plain(m: np.ndarray) -> np.ndarray:
    """Rows whose inner products with each other are exact in doubles, whatever the order of the sum."""
    return largest(m) <= np.floor(np.sqrt(2.0**53 / max(1, m.shape[1])))


def exact_scores(queries: np.ndarray, vectors: np.ndarray, skipped: np.ndarray) -> np.ndarray:
    """All inner products as int64: by doubles or int64 where their bound lets them, else by integers of any size. Only a score that does not fit, and is not of a skipped pair, is an error."""
    if not (len(queries) and len(vectors)):
        return np.zeros((len(queries), len(vectors)), np.int64)
    bound = queries.shape[1] * max(1.0, largest(queries).max()) * max(1.0, largest(vectors).max())
    if bound < 2.0**53:
        return (queries @ vectors.T).astype(np.int64)
    if bound < 2.0**62:
        return queries.astype(np.int64) @ vectors.astype(np.int64).T
    whole = lambda m: np.array([[int(x) for x in row] for row in m.tolist()], object).reshape(m.shape)
    scores = whole(queries) @ whole(vectors).T
    scores[skipped] = 0
    if not (-(2**63) <= min(scores.flat) and max(scores.flat) < 2**63):
        raise ValueError("a score is too large for a long")
    return scores.astype(np.int64)


class Lists:
    """A block of candidates, in the order of their ids, with its sorted lists."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.lists = np.argsort(-self.vectors, axis=0, kind="stable").T
        n = len(ids)
        self.depths = np.unique([max(1, int(n * part)) for part in DEPTHS]) if n else np.zeros(0, np.int64)
        values = np.take_along_axis(self.vectors, self.lists.T, axis=0)
        self.high, self.low = values[self.depths - 1], values[n - self.depths]

    def stops(self, queries: np.ndarray, known: np.ndarray) -> np.ndarray:
        """For each query the depth at which nothing unread can reach its known k-th score; the whole block if there is none."""
        bounds = np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T
        below = bounds < known[:, None]
        depth = np.where(below.any(1), self.depths[np.argmax(below, axis=1)] if len(self.depths) else 0, len(self.ids))
        return np.where(depth * np.count_nonzero(queries, axis=1) >= COVERED * len(self.ids), len(self.ids), depth)

    def read(self, query: np.ndarray, depth: int) -> np.ndarray:
        """Positions of what a query's lists hold down to a depth."""
        up, down = query > 0, query < 0
        return np.unique(np.r_[self.lists[up, :depth].ravel(), self.lists[down, len(self.ids) - depth :].ravel()])

    def best(self, own: np.ndarray, queries: np.ndarray, known: np.ndarray, k: int):
        """(query number, position, score) of all that may be among the k best, the k-th scores known then, candidates scored."""
        found, known, scored, n = [], known.copy(), 0, len(self.ids)
        depth = self.stops(queries, known)
        for i in np.flatnonzero(depth < n):
            at = self.read(queries[i], int(depth[i]))
            at = at[self.ids[at] != own[i]]
            score = self.vectors[at] @ queries[i]
            scored += len(at)
            if len(score) >= k:
                known[i] = max(known[i], np.partition(score, len(score) - k)[len(score) - k])
            keep = score >= known[i]
            found.append((np.full(int(keep.sum()), i), at[keep], score[keep]))
        whole = np.flatnonzero(depth >= n)
        for lo in range(0, len(whole), ROWS):
            i = whole[lo : lo + ROWS]
            score = queries[i] @ self.vectors.T
            score[self.ids[None, :] == own[i][:, None]] = -np.inf
            scored += score.size
            if n >= k:
                known[i] = np.maximum(known[i], np.partition(score, n - k, axis=1)[:, n - k])
            row, at = np.nonzero((score >= known[i][:, None]) & (score > -np.inf))
            found.append((i[row], at, score[row, at]))
        return [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3, known, scored


def cut(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int):
    """The k best of each query, ties to the smaller id."""
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.zeros(0, np.int64)
    rank = np.arange(len(query)) - np.repeat(first, np.diff(np.r_[first, len(query)]))
    return query[rank < k], ids[rank < k], score[rank < k]


def search(ids: np.ndarray, vectors: np.ndarray, own: np.ndarray, queries: np.ndarray, k: int, sample: tuple[np.ndarray, np.ndarray] | None = None):
    """(query number, id, score) of the k best of each query, and the number of candidates scored for them.

    Rows of integers as doubles. Plain rows go through the threshold algorithm in doubles; pairs with a large component on
    either side are scored one by one in exact integers.
    """
    vectors, queries = vectors.astype(np.float64), queries.astype(np.float64)
    simple, asking = plain(vectors), plain(queries)
    number = np.flatnonzero(asking)
    (query, found, score), scored = _search(ids[simple], vectors[simple], own[asking], queries[asking], k, sample)
    best = number[query], found, score.astype(np.int64)
    for of, rows in ((np.ones(len(queries), bool), ~simple), (~asking, simple)):
        number = np.flatnonzero(of)
        for lo in range(0, len(number) if rows.any() else 0, ROWS):
            i = number[lo : lo + ROWS]
            same = ids[rows][None, :] == own[i][:, None]
            score = exact_scores(queries[i], vectors[rows], same)
            row, at = np.nonzero(~same)
            scored += score.size
            best = cut(*[np.concatenate(c) for c in zip(best, (i[row], ids[rows][at], score[row, at]), strict=True)], k)
    return best, scored


def _search(ids: np.ndarray, vectors: np.ndarray, own: np.ndarray, queries: np.ndarray, k: int, sample: tuple[np.ndarray, np.ndarray] | None):
    known = np.full(len(queries), -np.inf)
    if sample is not None:
        few = plain(sample[1])
        near, some = sample[0][few], sample[1][few]
        for lo in range(0, len(queries) if len(near) > k else 0, ROWS):
            score = queries[lo : lo + ROWS] @ some.T
            score[near[None, :] == own[lo : lo + ROWS, None]] = -np.inf
            known[lo : lo + ROWS] = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
    best, scored = [np.zeros(0, np.int64)] * 3, 0
    for lo in range(0, len(ids), BLOCK):
        block = Lists(ids[lo : lo + BLOCK], vectors[lo : lo + BLOCK])
        (query, at, score), known, more = block.best(own, queries, known, k)
        scored += more
        best = cut(*[np.concatenate(c) for c in zip(best, (query, block.ids[at], score), strict=True)], k)
        full = np.flatnonzero(np.bincount(best[0], minlength=len(queries)) == k)
        if len(full):
            last = np.searchsorted(best[0], full, side="right") - 1
            known[full] = np.maximum(known[full], best[2][last])
    return best, scored


def top_k(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: for each row where is_query holds, its k best other rows by integer inner product.

    Components become floor(scale * x). Vectors that are null or hold a null or a non-finite component take no part;
    vectors are compared with those of the same length only. Ties go to the smaller id; rows with the query's own id
    are never its results. A row repeated as a query is asked once, and as a candidate counts each time; one id with
    several vectors asks for each. With fewer candidates than k, all are returned; an empty table gives an empty result.
    Other columns are ignored. Scores are exact whatever the components; only a score that does not fit a long is an error.
    """
    kind = dict(df.dtypes)[id_col]
    spark = df.sparkSession
    found = integer_vectors(df, id_col, vector_col, scale).where("id is not null")
    wanted = integer_vectors(df.where(is_query), id_col, vector_col, scale).where("id is not null").dropDuplicates(["id", "vec"]).withColumn("key", F.xxhash64("vec"))
    rows = df.count()
    blocks = max(1, -(-rows // GROUP), min(SPREAD, rows // BLOCK))
    groups = max(1, -(-df.where(is_query).count() // QUERIES))
    candidates = found.withColumn("block", F.pmod(F.xxhash64("id", "vec"), F.lit(blocks)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    asked = wanted.withColumn("part", F.pmod(F.xxhash64("vec", "id"), F.lit(groups)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    by_dim: dict[int, tuple] = {}
    some = found.orderBy(F.xxhash64("id", "vec", F.lit(5))).limit(SAMPLE).collect()  # at most SAMPLE rows
    for dim in {r["dim"] for r in some}:
        mine = [r for r in some if r["dim"] == dim]
        by_dim[dim] = np.array([r["id"] for r in mine], np.int64), matrix([bytes(r["vec"]) for r in mine], dim)
    shared = share(spark, by_dim)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "key", "vec_id", "score")})
        dim = left.column("dim")[0].as_py()
        own, keys = right.column("id").to_numpy().astype(np.int64), right.column("key").to_numpy()
        (query, ids, score), _ = search(left.column("id").to_numpy().astype(np.int64), matrix(left.column("vec").to_pylist(), dim), own, matrix(right.column("vec").to_pylist(), dim), k, shared.value.get(dim))
        return pa.table({"query_id": own[query], "key": keys[query], "vec_id": ids, "score": score.astype(np.int64)})

    by = ("dim", "block", "part")
    parts = candidates.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(run, "query_id long, key long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id", "key").orderBy(F.col("score").desc(), "vec_id"))
    best = parts.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.select(F.col("query_id").cast(kind), "rank", F.col("vec_id").cast(kind), "score")
