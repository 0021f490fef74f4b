"""Exact top-k inner products: trees over queries and vectors, pruned in pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from airgrid.llm.common import written

#: Vectors that share a block (a tree), on average; the sample of pivots that block vectors by likeness; queries that visit a block together.
BLOCK_ROWS, MOST_PIVOTS, QUERY_ROWS = 4096, 64, 2048
#: Rows of a leaf of the query tree and of the vector tree.
QUERY_LEAF, VECTOR_LEAF = 128, 512


class CoverTree:
    """Nested balls over integer vectors: every node covers its points; radii fall by half from level to level, as far as 16 children allow."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.points, self.leaf = points, leaf
        self.norms = np.sqrt((points**2).sum(1))
        self.center: list[np.ndarray] = []
        self.radius: list[float] = []
        self.rows: list[np.ndarray] = []
        self.children: list[list[int]] = []
        if len(points):
            self._add(np.arange(len(points)))

    def _add(self, rows: np.ndarray) -> int:
        """Build the nodes below and for ``rows``; the nodes of a level are farthest-first centres half the radius apart."""
        own = self.points[rows]
        center = own[((own - own.mean(0)) ** 2).sum(1).argmin()]
        far = np.sqrt(((own - center) ** 2).sum(1))
        me = len(self.center)
        self.center.append(center)
        self.radius.append(float(far.max()))
        self.rows.append(rows)
        self.children.append([])
        if len(rows) > self.leaf and self.radius[me] > 0:
            nearest, label, count = far.copy(), np.zeros(len(rows), np.int64), 1
            while nearest.max() > self.radius[me] / 2 and count < 16:
                far = np.sqrt(((own - own[nearest.argmax()]) ** 2).sum(1))
                closer = far < nearest
                nearest[closer], label[closer] = far[closer], count
                count += 1
            groups = [rows[label == k] for k in range(count)]
            self.children[me] = [self._add(g) for g in groups if len(g)]
        return me


def dual_search(query_rows, queries, rows, ids, vectors, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (query place, id, score): the best ``k`` of each query by (score falling, id), without the query's own row.

    ``floor`` holds for each query a score that its k-th best of all vectors reaches. A pair of nodes is left
    out when no inner product across it can reach the worst k-th score among the node's queries.
    """
    upper, lower = CoverTree(queries, QUERY_LEAF), CoverTree(vectors, VECTOR_LEAF)
    n = len(queries)
    scores, found = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
    kth = floor.astype(float).copy()

    def bound(a: int, b: int) -> float:
        """No inner product between the balls is larger."""
        ca, cb, ra, rb = upper.center[a], lower.center[b], upper.radius[a], lower.radius[b]
        return float(ca @ cb + ra * np.sqrt(cb @ cb) + rb * np.sqrt(ca @ ca) + ra * rb) + 1e-6

    def visit(a: int, b: int) -> None:
        if bound(a, b) < kth[upper.rows[a]].min():
            return
        if upper.children[a] and (not lower.children[b] or upper.radius[a] > lower.radius[b]):
            for x in upper.children[a]:
                visit(x, b)
        elif lower.children[b]:
            for x in sorted(lower.children[b], key=lambda x: -bound(a, x)):
                visit(a, x)
        else:
            q, v = upper.rows[a], lower.rows[b]
            product = (queries[q] @ vectors[v].T).astype(float)
            product[query_rows[q][:, None] == rows[v][None, :]] = -np.inf
            least = kth[q]
            if len(v) > k and not np.isfinite(least).all():
                least = np.maximum(least, np.partition(product, len(v) - k, axis=1)[:, len(v) - k])
            hit, column = np.nonzero((product >= least[:, None]) & np.isfinite(product))
            if not len(hit):
                return
            # The hits of a query and what it holds, best first; its first k stay.
            asked = np.unique(hit)
            row = np.concatenate([np.searchsorted(asked, hit), np.repeat(np.arange(len(asked)), k)])
            score = np.concatenate([product[hit, column], scores[q[asked]].ravel()])
            name = np.concatenate([ids[v][column], found[q[asked]].ravel()])
            order = np.lexsort((name, -score, row))
            first = np.searchsorted(row[order], np.arange(len(asked)))
            order = order[first[:, None] + np.arange(k)]
            q = q[asked]
            scores[q], found[q] = score[order], name[order]
            kth[q] = np.maximum(kth[q], scores[q, k - 1])

    if n and len(vectors):
        visit(0, 0)
    place, column = np.nonzero(np.isfinite(scores))
    return place, found[place, column], scores[place, column].astype(np.int64)


def integer_vectors(vectors: DataFrame, factor: int = 64, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """Rows (vec_id, v array<long>) of floor(factor * x); vectors that are null or hold null, NaN or infinity are left out.

    Rows with an equal id all stay; a null id takes no part.
    """
    column = F.col(vector_column)
    sound = column.isNotNull() & F.col(id_column).isNotNull() & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(column, lambda x: F.floor(F.lit(factor) * x.cast("double")))
    return vectors.where(sound).select(F.col(id_column).alias("vec_id"), whole.alias("v"))


def top_k(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """Rows (query_id, rank int, vec_id, score long): for each row whose id is divisible by ``every`` its ``k`` best other rows.

    ``vectors`` is (vec_id long, v array<long>), as ``integer_vectors`` gives it; vectors of different lengths are an
    error. Rows that share an id are queries and candidates of their own, and each such query has its ranks. Fewer
    others than ``k`` give fewer rows; ties go to the smaller id. An empty table gives no rows.

    Vectors are blocked by the nearest of at most ``MOST_PIVOTS`` pivots (a bounded sample, which decides speed only)
    and a hash that splits large groups. Queries first search the block they lie in, which gives each a k-th score to
    beat. Around each pivot lie a ball of vectors and a ball of queries; a pair of balls across which no inner product
    reaches the least of these scores is left out before anything is sent. Of the other pairs every block meets the
    queries in groups of some ``QUERY_ROWS``, and a task takes one group and one block, pruned by their trees.
    """
    rows = written(vectors.withColumn("row", F.monotonically_increasing_id()))
    n = rows.count()
    blocks = max(1, -(-n // BLOCK_ROWS))
    pivots = [np.array(r.v, float) for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(MOST_PIVOTS, blocks)).collect()]
    if not pivots:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score"))
    matrix = np.stack(pivots)

    def nearest(batches):
        for part in batches:
            if len(part):
                own = np.stack(part["v"].to_numpy()).astype(float)
                place = ((matrix**2).sum(1) - 2 * (own @ matrix.T)).argmin(1)
                yield part.assign(pivot=place.astype("int32"), far=np.sqrt(((own - matrix[place]) ** 2).sum(1)))

    keyed = written(rows.mapInPandas(nearest, "vec_id long, v array<long>, row long, pivot int, far double"))
    asks = F.col("vec_id") % every == 0
    # One row for each pivot.
    sizes = keyed.groupBy("pivot").agg(F.count("*").alias("n"), F.max("far").alias("far"), F.count_if(asks).alias("n_asks"), F.max(F.when(asks, F.col("far"))).alias("far_asks")).collect()
    spans, at, groups = {}, 0, 0
    for r in sorted(sizes):
        spans[r["pivot"]] = (at, -(-r["n"] // BLOCK_ROWS), groups, -(-r["n_asks"] // QUERY_ROWS))
        at, groups = at + spans[r["pivot"]][1], groups + spans[r["pivot"]][3]
    place = lambda i: F.element_at(F.create_map(*[F.lit(x) for p, span in spans.items() for x in (p, span[i])]), F.col("pivot"))
    dealt = lambda first, count, salt: (place(first) + F.pmod(F.xxhash64("row", F.lit(salt)), F.greatest(place(count), F.lit(1)))).cast("int")
    keyed = keyed.withColumn("block", dealt(0, 1, 0))
    queries = keyed.where(asks).select("block", "pivot", F.col("row").alias("query_row"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"), dealt(2, 3, 1).alias("asks"))
    shape = "query_row long, query_id long, vec_id long, score long"

    def search(key, mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(theirs):
            return pd.DataFrame({"query_row": [], "query_id": [], "vec_id": [], "score": []}, dtype="int64")
        own, ids = mine["query_row"].to_numpy(np.int64), mine["query_id"].to_numpy(np.int64)
        floor = mine["kth"].to_numpy(float) if "kth" in mine else np.full(len(mine), -np.inf)
        place, found, score = dual_search(
            own, np.stack(mine["q"].to_numpy()).astype(float), theirs["row"].to_numpy(np.int64), theirs["vec_id"].to_numpy(np.int64), np.stack(theirs["v"].to_numpy()).astype(float), k,
            np.where(np.isnan(floor), -np.inf, floor))
        return pd.DataFrame({"query_row": own[place], "query_id": ids[place], "vec_id": found, "score": score})

    by_block = keyed.select("block", "pivot", "row", "vec_id", "v")
    near = written(queries.groupBy("block").cogroup(by_block.drop("pivot").groupBy("block")).applyInPandas(search, shape))
    kth = near.groupBy("query_row").agg(F.min("score").alias("kth"), F.count("*").alias("n")).where(F.col("n") >= k).select("query_row", "kth")
    known = written(queries.join(kth, "query_row", "left"))
    least = {r["pivot"]: r["least"] for r in known.groupBy("pivot").agg(F.min(F.coalesce(F.col("kth").cast("double"), F.lit(float("-inf")))).alias("least")).collect()}
    radius = {r["pivot"]: (r["far"], r["far_asks"]) for r in sizes}
    pairs = []
    for p, beaten in least.items():
        for q in spans:
            a, b, ra, rb = matrix[p], matrix[q], radius[p][1], radius[q][0]
            bound = a @ b + ra * np.sqrt(b @ b) + rb * np.sqrt(a @ a) + ra * rb
            # A little more than rounding can take away.
            if bound * (1 + 1e-9) + 1e-6 >= beaten:
                pairs.append((int(p), int(q), *map(int, spans[q][:2]), *map(int, spans[p][2:])))
    # At most the square of the number of pivots.
    met = F.broadcast(keyed.sparkSession.createDataFrame(pairs, "asking int, pivot int, first int, blocks int, first_asks int, groups int"))
    each = lambda first, count: F.explode(F.sequence(F.col(first), F.col(first) + F.col(count) - 1))
    visits = known.withColumnsRenamed({"block": "own", "pivot": "asking"}).join(met.drop("pivot"), "asking").withColumn("block", each("first", "blocks")).where("block <> own")
    visits = visits.select("asks", "block", "query_row", "query_id", "q", "kth")
    visited = by_block.join(met, "pivot").withColumn("asks", each("first_asks", "groups")).select("asks", "block", "row", "vec_id", "v")
    far = visits.groupBy("asks", "block").cogroup(visited.groupBy("asks", "block")).applyInPandas(search, shape)
    best = W.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    return near.union(far).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
