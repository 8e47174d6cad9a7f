"""Exact top-k by inner product: an impact-ordered index read score-at-a-time.

Vectors are quantised to integers. A posting is a (vector, dimension) with its impact,
the magnitude of the component; its quantised impact is the magnitude's bit length. In
every block of vectors the postings of one quantised impact form a segment. Segments are
processed in descending quantised impact for a chunk of queries together: ``acc`` gathers
what the read postings give, and the norm of each vector's unread components, times the
query's norm, bounds what they can still add or take. A query stops once few vectors can
still reach its k-th best lower bound (a proof that all others are out, ties included);
those few are rescored exactly. The best k of each block meet in one ranking per query.

Scale: queries are a stated set; they meet the vectors in blocks of bounded size,
``block_rows`` vectors by ``chunk_rows`` queries a task, and each task returns at
most k rows a query.

Edge cases: null vectors and vectors with a null, NaN or infinite component take
no part; vectors meet queries of their own length only; repeated ids are rows of
their own (a query excludes its own row only); rows with a null id rank behind
equal scores and are never queries; a table with fewer than k + 1 rows gives
fewer ranks; an empty table gives an empty result; other columns are ignored.
Scores beyond 64 bits are held as exact integers and reported at the limit.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

K = 5
SCALE = 256
BLOCK_ROWS, CHUNK_ROWS = 8_192, 2_048
QUERIES_AT_ONCE = 128
FEW = 64
_LAST = (1 << 63) - 1
FOUND = "qrid long, query_id long, rid long, vec_id long, score long"


class ImpactIndex:
    """Posting segments of one block by quantised impact, highest first, and the norms of what is unread after each."""

    def __init__(self, vectors: np.ndarray, exact: type):
        self.vectors = vectors
        self.exact = exact
        size = np.abs(vectors).astype(float)
        level = np.where(size > 0, np.frexp(size)[1], 0)  # bit length
        self.segments, self.unread = [], []
        for impact in range(int(level.max(initial=0)), 0, -1):
            self.segments.append(np.where(level == impact, vectors, 0).astype(self.exact))
            self.unread.append(np.sqrt((np.where(level < impact, size, 0.0) ** 2).sum(axis=1)) * (1 + 1e-9))

    def search(self, queries: np.ndarray, k: int, own: np.ndarray) -> list[np.ndarray]:
        """For each query, the rows that can be among its k best; row ``own[i]`` (-1: none) is left out."""
        n, out = len(self.vectors), [np.arange(0)] * len(queries)
        norm = np.sqrt((queries.astype(float) ** 2).sum(axis=1)) * (1 + 1e-9)
        open_ = np.arange(len(queries))
        acc = np.zeros((len(queries), n), dtype=self.exact)
        known = np.flatnonzero(own >= 0)
        last = len(self.segments) - 1
        for at in range(-1 if last < 0 else 0, last + 1):
            if at >= 0:
                acc += queries[open_].astype(self.exact) @ self.segments[at].T
            near = acc.astype(float)
            near[known, own[open_[known]]] = -np.inf
            slack = norm[open_][:, None] * self.unread[at][None, :] if 0 <= at < last else np.zeros((1, n))
            if n > k:
                kth = np.partition(near - slack, n - k, axis=1)[:, n - k]
            else:
                kth = np.full(len(open_), -np.inf)
            may = near + slack >= np.where(np.isfinite(kth), kth - np.abs(kth) * 1e-12, -np.finfo(float).max)[:, None]
            few = may.sum(axis=1) <= FEW if at < last else np.ones(len(open_), bool)
            for i in np.flatnonzero(few):
                out[open_[i]] = np.flatnonzero(may[i])
            open_, acc = open_[~few], acc[~few]
            known = np.flatnonzero(own[open_] >= 0)
            if not len(open_):
                break
        return out


def quantised(vectors: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", scale: int = SCALE) -> DataFrame:
    """rid, vec_id, v array<long>, dims: floor(scale * component), as double; unusable vectors are left out."""
    parts = F.transform(F.col(vector), lambda x: x.cast("double"))
    usable = F.col(vector).isNotNull() & F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.coalesce(usable, F.lit(False))).select(
        F.monotonically_increasing_id().alias("rid"), F.col(vec_id).cast("long").alias("vec_id"), F.transform(parts, lambda x: F.floor(x * F.lit(float(scale)))).alias("v"), F.size(vector).alias("dims")
    )


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.int64) for v in column])


def search_block(vectors: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    if not len(vectors) or not len(queries):
        return pd.DataFrame({c.split(" ")[0]: pd.Series(dtype="int64") for c in FOUND.split(", ")})
    x, qs = _matrix(vectors["v"]), _matrix(queries["v"])
    most = float(np.abs(x.astype(float)).max()) * float(np.abs(qs.astype(float)).max()) * 4 * x.shape[1] if x.shape[1] else 0.0
    exact = np.float64 if most < 2.0**53 else np.int64 if most < 2.0**62 else object  # the kind that adds up exactly, sums in between too
    if exact is object:
        x, qs = x.astype(object), qs.astype(object)
    index = ImpactIndex(x, exact)
    rid, ids = vectors["rid"].to_numpy(), vectors["vec_id"].to_numpy()
    place = {r: i for i, r in enumerate(rid)}
    own = np.array([place.get(q, -1) for q in queries["rid"]])
    found = []
    for at in range(0, len(qs), QUERIES_AT_ONCE):
        found += index.search(qs[at : at + QUERIES_AT_ONCE], k, own[at : at + QUERIES_AT_ONCE])
    out = []
    for qrid, query_id, q, rows in zip(queries["rid"], queries["vec_id"], qs, found):
        scores = x[rows] @ q
        scores = np.array([max(-_LAST - 1, min(_LAST, int(s))) for s in scores], np.int64) if x.dtype == object else scores.astype(np.int64)
        best = np.lexsort((rid[rows], ids[rows], -scores))[:k]
        out.extend((qrid, query_id, rid[r], ids[r], s) for r, s in zip(rows[best], scores[best]))
    return pd.DataFrame(out, columns=[c.split(" ")[0] for c in FOUND.split(", ")])


def top_k(vectors: DataFrame, every: int = 50, k: int = K, block_rows: int = BLOCK_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score of the k best other rows for each row whose id ``every`` divides."""
    rows = stage(vectors, "vectors")
    is_query = F.col("vec_id") % every == 0
    counts = rows.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).first()
    blocks, chunks = max(1, -(-counts["n"] // block_rows)), max(1, -(-counts["q"] // chunk_rows))

    def dealt(of: int, seed: int):
        return F.pmod(F.xxhash64("rid", F.lit(seed)), F.lit(of)).cast("int")

    ids = F.coalesce("vec_id", F.lit(_LAST)).alias("vec_id")
    left = rows.select("rid", ids, "v", "dims", dealt(blocks, 1).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    right = rows.where(is_query).select("rid", "vec_id", "v", "dims", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), dealt(chunks, 2).alias("chunk"))
    keys = ("dims", "block", "chunk")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(lambda a, b: search_block(a, b, k), FOUND)
    order = Window.partitionBy("qrid").orderBy(F.desc("score"), "vec_id", "rid")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.nullif(F.col("vec_id"), F.lit(_LAST)).alias("vec_id"), "score")
