"""Exact k-nearest-neighbour join that skips what cannot be near, and its approximate form.

Training points are cut into Voronoi cells around pivots (Lu et al., PVLDB 2012). A query is first answered by its own cell; the
k-th distance found there is a true bound, and by the triangle inequality and the bisector bound only cells that reach
inside it are visited in a second pass. On points without any structure that may be all of them. With ``probes`` a query
visits that many cells nearest to it instead (an inverted file): bounded work, and recall below 1.

Cells and the queries that visit them are cut into blocks of bounded size, so a dense cell is spread over many tasks; a block
finds its candidates by a matrix product, measures them exactly, and emits at most k neighbours per query. Ties go to the lower
id. Identical training points beyond the k lowest ids can never be chosen, and identical queries are answered once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from furrow.session import counted_cut, cut_lineage

BLOCK_ROWS = 4096
MAX_PIVOTS = 1024
VISIT_ROWS = 10_000
SLACK = 1 + 1e-9


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), dtype=np.float64)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for d in range(a.shape[1]):
        gap = a[:, d, None] - b[None, :, d]
        out += gap * gap
    return np.sqrt(out)


def _present_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distance over the coordinates both points have, scaled up to all of them; inf without any."""
    out, common = np.zeros((len(a), len(b))), np.zeros((len(a), len(b)))
    for d in range(a.shape[1]):
        gap = a[:, d, None] - b[None, :, d]
        known = ~np.isnan(gap)
        out += np.where(known, gap * gap, 0.0)
        common += known
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(common > 0, np.sqrt(out * a.shape[1] / common), np.inf)


def _measured_present(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``_present_distances`` of paired rows, summed in the same order."""
    out, common = np.zeros(len(a)), np.zeros(len(a))
    for d in range(a.shape[1]):
        gap = a[:, d] - b[:, d]
        known = ~np.isnan(gap)
        out += np.where(known, gap * gap, 0.0)
        common += known
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(common > 0, np.sqrt(out * a.shape[1] / common), np.inf)


class _Donors:
    """Finds the k nearest points that have a column, for each column that a question lacks, ties by id.

    A matrix product in single precision gives a lower bound of every squared distance. The points of the lowest bounds are measured; where
    the k-th of them does not lie below the bounds of all others, the question's whole row is measured.
    """

    def __init__(self, points: np.ndarray, ids: np.ndarray, k: int):
        self.points, self.ids, self.k = points, ids, k
        self.has, self.near = ~np.isnan(points), min(len(points), 3 * k + 32)
        if self.near < len(points):
            self.middle = np.where(self.has, points, 0.0).sum(axis=0) / np.maximum(self.has.sum(axis=0), 1)
            b = np.where(self.has, points - self.middle, 0.0)
            self.unit = np.abs(b).max(initial=0.0) or 1.0
            b, there = (b / self.unit).astype(np.float32), self.has.astype(np.float32)
            self.right, self.there, self.top = np.concatenate([there, b * b, b], axis=1).T.copy(), there.T.copy(), (b * b).sum(axis=1).max()

    def _candidates(self, asked: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each question the points of the lowest bounds, and the lowest bound of the others."""
        width = asked.shape[1]
        a, here = (np.where(known, asked - self.middle, 0.0) / self.unit).astype(np.float32), known.astype(np.float32)
        low = np.concatenate([a * a, here, -2 * a], axis=1) @ self.right
        low -= (1e-6 * (3 * width + 8) * ((a * a).sum(axis=1) + self.top)).astype(np.float32)[:, None]  # more than single precision loses
        common = here @ self.there
        apart = common.min(initial=1.0) == 0 and common == 0
        np.divide(np.float32(width), common, out=common)
        low *= common
        if apart is not False:
            low[apart] = np.inf
        at = np.argpartition(low, self.near, axis=1)[:, :self.near + 1]
        return at[:, :-1], np.take_along_axis(low, at[:, -1:], axis=1)

    def of(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(question, column, point, distance)"""
        k, near, known = self.k, self.near, ~np.isnan(asked)
        at, whole = np.broadcast_to(np.arange(len(self.points)), (len(asked), len(self.points))), np.ones(known.shape, dtype=bool)
        if near < len(self.points):
            with np.errstate(all="ignore"):  # what overflows is measured whole
                at, beyond = self._candidates(asked, known)
        distance = _measured_present(np.repeat(asked, near, axis=0), self.points[at.ravel()]).reshape(at.shape)
        order = np.lexsort((self.ids[at], distance), axis=1)
        at, distance = np.take_along_axis(at, order, axis=1), np.take_along_axis(distance, order, axis=1)
        gives = self.has[at] & ~known[:, None, :] & np.isfinite(distance)[:, :, None]
        rank = gives.cumsum(axis=1, dtype=np.int32)
        if near < len(self.points):
            last = np.minimum((rank < k).sum(axis=1), near - 1)  # where the k-th lies
            limit = np.take_along_axis(distance, last, axis=1) / self.unit
            whole = (rank[:, -1] >= k) & (limit * limit * (1 + 1e-6) < beyond)
        again = ~known & ~whole
        q, i, f = np.nonzero(gives & (rank <= k) & ~again[:, None, :])
        out = [(q, f, at[q, i], distance[q, i])]
        for question in np.flatnonzero(again.any(axis=1)):
            row = _present_distances(asked[question:question + 1], self.points)[0]
            for column in np.flatnonzero(again[question]):
                best = _lowest(np.where(self.has[:, column], row, np.inf), self.ids, k)
                out.append((np.full(len(best), question), np.full(len(best), column), best, row[best]))
        return tuple(np.concatenate(parts) for parts in zip(*out))


def _lowest(distance: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k smallest finite distances, lower id first on ties."""
    usable = np.flatnonzero(np.isfinite(distance))
    if len(usable) > k:
        limit = np.partition(distance[usable], k - 1)[k - 1]
        usable = usable[distance[usable] <= limit]
    return usable[np.lexsort((ids[usable], distance[usable]))][:k]


def vector_key(vector: str):
    return F.md5(F.array_join(F.col(vector).cast("array<string>"), ",", "NULL").cast("binary"))


def _first_copies(points: DataFrame, k: int) -> DataFrame:
    """At most k rows per identical vector; the rank filter is applied before the shuffle as well."""
    lowest = Window.partitionBy("vector").orderBy("id")
    return points.withColumn("__copy", F.row_number().over(lowest)).where(F.col("__copy") <= k).drop("__copy")


def _choose_pivots(points: DataFrame, n_points: int) -> np.ndarray:
    """A deterministic sample of at most MAX_PIVOTS points, spread by the hash of the id."""
    wanted = int(min(MAX_PIVOTS, max(1, round(n_points ** 0.5 / 4))))
    rows = points.orderBy(F.xxhash64("id"), "id").limit(wanted).select("vector").collect()
    return np.unique(np.array([r["vector"] for r in rows], dtype=np.float64), axis=0)


def _measured(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of paired rows, summed in the order that ``_distances`` sums them."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        gap = a[:, d] - b[:, d]
        out += gap * gap
    return np.sqrt(out)


def _nearest_in_block(points: np.ndarray, ids: np.ndarray, asked: np.ndarray, limits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(question, point, distance): the k nearest points of each question, within its limit, ties by id.

    The matrix product only chooses whom to measure; its error stays below the slack.
    """
    own, other = (asked * asked).sum(axis=1), (points * points).sum(axis=1)
    square = own[:, None] + other[None, :] - 2.0 * (asked @ points.T)
    slack = 1e-9 * (own[:, None] + other.max(initial=0.0)) + 1e-300
    top = np.partition(square, k - 1, axis=1)[:, k - 1] if len(points) > k else np.full(len(asked), np.inf)
    with np.errstate(invalid="ignore"):
        reach = np.minimum(top, limits ** 2 * SLACK)
    q, p = np.nonzero(square <= reach[:, None] + 2 * slack)
    distance = _measured(asked[q], points[p])
    near = np.isfinite(distance) & (distance <= limits[q] * SLACK)
    q, p, distance = q[near], p[near], distance[near]
    order = np.lexsort((ids[p], distance, q))
    q, p, distance = q[order], p[order], distance[order]
    first = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[first], p[first], distance[first]


def _visits(pdf: pd.DataFrame, needed: np.ndarray, reach: np.ndarray) -> Iterator[pd.DataFrame]:
    """A row for each needed (question, cell), in frames of at most VISIT_ROWS rows or one question's cells: the vector repeats in each."""
    ends = np.cumsum(needed.sum(axis=1))
    start = 0
    while start < len(pdf):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + VISIT_ROWS, side="right")))
        part = pdf.iloc[start:end]
        rows, cells = np.nonzero(needed[start:end])
        yield pd.DataFrame({"qkey": part["qkey"].to_numpy()[rows], "vector": part["vector"].to_numpy()[rows],
                            "bound": reach[start:end][rows], "cell": cells.astype("int32")})
        start = end


def knn_join(train: DataFrame, query: DataFrame, k: int, train_id: str = "id", query_id: str = "id",
             vector: str = "vector", block_rows: int = BLOCK_ROWS, probes: int | None = None) -> DataFrame:
    """(query_id, neighbour_id, distance, rank) of the k nearest training points of every query, Euclidean.

    ``probes`` gives the approximate form: only that many cells nearest to a query are searched.
    """
    raw = train.select(F.col(train_id).alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    asked = query.select(F.col(query_id).alias("query_id"), F.col(vector).cast("array<double>").alias("vector"))
    asked = asked.withColumn("qkey", vector_key("vector"))
    id_type = dict(raw.dtypes)["id"]
    n_raw = raw.count()
    if n_raw == 0:
        return asked.select("query_id", F.lit(None).cast(id_type).alias("neighbour_id"),
                            F.lit(None).cast("double").alias("distance"),
                            F.lit(None).cast("int").alias("rank")).limit(0)
    pivots = _choose_pivots(raw, n_raw)

    def nearest_pivot(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                gaps = _distances(_matrix(pdf["vector"]), pivots)
                yield pdf.assign(cell=gaps.argmin(axis=1).astype("int32"), gap=gaps.min(axis=1))

    assigned = cut_lineage(_first_copies(raw, k).mapInPandas(nearest_pivot, f"id {id_type}, vector array<double>, cell int, gap double"))
    # Small rows per cell: size, radius, and the k lowest gaps that bound the k-th neighbour of any query.
    by_gap = Window.partitionBy("cell").orderBy("gap")
    lowest = (assigned.select("cell", "gap").withColumn("__r", F.row_number().over(by_gap))
              .where(F.col("__r") <= k).collect())
    shape = assigned.groupBy("cell").agg(F.count("*").alias("size"), F.max("gap").alias("radius")).collect()
    n_cells = len(pivots)
    sizes, radius = np.zeros(n_cells, dtype=np.int64), np.zeros(n_cells)
    first = np.full((n_cells, k), np.inf)
    for row in shape:
        sizes[row["cell"]], radius[row["cell"]] = row["size"], row["radius"]
    for row in lowest:
        first[row["cell"], row["__r"] - 1] = row["gap"]
    between = _distances(pivots, pivots)
    points = assigned.select("id", "vector", "cell")
    visit = "qkey string, vector array<double>, bound double, cell int"

    def own_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each question in its own cell (with ``probes``, in that many), with the bound that the lowest gaps give."""
        for pdf in batches:
            if not len(pdf):
                continue
            gaps = _distances(_matrix(pdf["vector"]), pivots)
            reach = np.empty(len(gaps))
            for i, row in enumerate(gaps):
                bound = (row[:, None] + first).ravel()
                reach[i] = np.partition(bound, k - 1)[k - 1] if len(bound) >= k else np.inf
            near = np.argsort(np.where(sizes > 0, gaps, np.inf), axis=1, kind="stable")[:, :probes or 1]
            rows = np.repeat(np.arange(len(gaps)), near.shape[1])
            yield pd.DataFrame({"qkey": pdf["qkey"].to_numpy()[rows], "vector": pdf["vector"].to_numpy()[rows],
                                "bound": reach[rows] if probes is None else np.inf, "cell": near.ravel().astype("int32")})

    def further_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            gaps, reach, done = _distances(_matrix(pdf["vector"]), pivots), pdf["bound"].to_numpy(), pdf["cell"].to_numpy()
            own = gaps.argmin(axis=1)
            own_gap = gaps[np.arange(len(gaps)), own]
            with np.errstate(divide="ignore", invalid="ignore"):
                bisector = (gaps ** 2 - own_gap[:, None] ** 2) / (2 * between[own])
            lower = np.maximum(gaps - radius[None, :], np.nan_to_num(bisector, nan=0.0, posinf=0.0, neginf=0.0))
            needed = (sizes[None, :] > 0) & (lower <= reach[:, None] * SLACK)
            needed[np.arange(len(gaps)), done] = False
            yield from _visits(pdf, needed, reach)

    questions = asked.groupBy("qkey").agg(F.any_value("vector").alias("vector"))
    own = cut_lineage(questions.mapInPandas(own_cells, visit))
    found = cut_lineage(_candidates(points, own, sizes, k, id_type, block_rows))
    if probes is None:
        best = Window.partitionBy("qkey").orderBy("distance", "neighbour_id")
        kth = (found.withColumn("__r", F.row_number().over(best)).where(F.col("__r") == k)
               .select("qkey", F.col("distance").alias("__kth")))
        bounded = own.join(kth, "qkey", "left").withColumn("bound", F.least("bound", F.coalesce("__kth", F.lit(float("inf"))))).drop("__kth")
        found = found.unionByName(_candidates(points, cut_lineage(bounded.mapInPandas(further_cells, visit)), sizes, k, id_type, block_rows))
    best = Window.partitionBy("qkey").orderBy("distance", "neighbour_id")
    nearest = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return asked.select("query_id", "qkey").join(nearest, "qkey").select("query_id", "neighbour_id", "distance", "rank")


def _block_numbers(blocks):
    """One row per block number."""
    return F.explode(F.sequence(F.lit(0).cast("long"), blocks.cast("long") - 1))


def _blocks(counts: np.ndarray, block_rows: int):
    """Literal array: into how many blocks each cell is cut."""
    return F.array(*[F.lit(int(max(1, -(-int(c) // block_rows)))) for c in counts])


def _candidates(points: DataFrame, visited: DataFrame, sizes: np.ndarray, k: int, id_type: str, block_rows: int) -> DataFrame:
    """(qkey, neighbour_id, distance): the k nearest of each block that a question visits, within its bound."""
    counts = {r["cell"]: r["n"] for r in visited.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    asked_blocks = _blocks(np.array([counts.get(c, 0) for c in range(len(sizes))]), block_rows)
    point_blocks = _blocks(sizes, block_rows)
    key = ["cell", "point_block", "query_block"]
    left = (points.where(F.col("cell").isin(list(counts))) if len(counts) < len(sizes) else points)
    left = (left.withColumn("point_block", F.pmod(F.xxhash64("id"), point_blocks[F.col("cell")]))
            .withColumn("query_block", _block_numbers(asked_blocks[F.col("cell")])))
    right = (visited.withColumn("query_block", F.pmod(F.xxhash64("qkey"), asked_blocks[F.col("cell")]))
             .withColumn("point_block", _block_numbers(point_blocks[F.col("cell")])))

    def block_nearest(near: pd.DataFrame, far: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(near) and len(far):
            ids, matrix, keys = near["id"].to_numpy(), _matrix(near["vector"]), far["qkey"].to_numpy()
            for start in range(0, len(far), 256):
                part = far.iloc[start:start + 256]
                q, p, distance = _nearest_in_block(matrix, ids, _matrix(part["vector"]), part["bound"].to_numpy(), k)
                found.append(pd.DataFrame({"qkey": keys[start:start + 256][q], "neighbour_id": ids[p], "distance": distance}))
        return pd.concat(found, ignore_index=True) if found else pd.DataFrame({"qkey": [], "neighbour_id": [], "distance": []})

    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(
        block_nearest, f"qkey string, neighbour_id {id_type}, distance double")


def knn_regress(train: DataFrame, query: DataFrame, k: int, target: str, train_id: str = "id",
                query_id: str = "id", vector: str = "vector") -> DataFrame:
    """(query_id, y_pred): uniform mean of the target over the k nearest training points."""
    neighbours = knn_join(train, query, k, train_id, query_id, vector)
    values = train.select(F.col(train_id).alias("neighbour_id"), F.col(target).cast("double").alias("__y"))
    return (neighbours.join(values, "neighbour_id").groupBy("query_id").agg(F.avg("__y").alias("y_pred")))


def knn_impute(train: DataFrame, query: DataFrame, columns: list[str], k: int = 15, train_id: str = "id",
               query_id: str = "id", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Fill each missing value of ``query`` with the mean over its k nearest donors in ``train``.

    Donors of a column are the training rows that have it; the distance uses the coordinates both rows have. Without any
    reachable donor the training mean is used. The distance is no metric, so no cell can be skipped: every incomplete
    row meets every block, and blocks are bounded on both sides.
    """
    as_vector = F.array(*[F.col(c).cast("double") for c in columns])
    donors, n_donors = counted_cut(train.select(F.col(train_id).cast("long").alias("id"), as_vector.alias("vector")))
    incomplete = F.exists(F.col("vector"), lambda v: v.isNull())
    rows = query.select(F.col(query_id).alias("query_id"), as_vector.alias("vector"))
    asked = (rows.where(incomplete).withColumn("qkey", vector_key("vector"))
             .groupBy("qkey").agg(F.any_value("vector").alias("vector")))
    asked, n_asked = counted_cut(asked)
    # wide blocks: a question gives k donors a column for each block, and rows repeat for each block of the other side
    tasks = 2 * donors.sparkSession.sparkContext.defaultParallelism
    point_blocks = max(1, -(-n_donors // (8 * block_rows)))
    query_blocks = max(1, -(-n_asked // (4 * block_rows)), min(-(-tasks // point_blocks), n_asked // 256))
    key = ["point_block", "query_block"]
    left = (donors.withColumn("point_block", F.pmod(F.xxhash64("id"), F.lit(point_blocks)))
            .withColumn("query_block", _block_numbers(F.lit(query_blocks))))
    right = (asked.withColumn("query_block", F.pmod(F.xxhash64("qkey"), F.lit(query_blocks)))
             .withColumn("point_block", _block_numbers(F.lit(point_blocks))))

    def block_donors(near: pd.DataFrame, far: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"qkey": [], "f": [], "donor": [], "distance": [], "value": []})]
        if len(near) and len(far):
            ids, matrix, keys = near["id"].to_numpy(), _matrix(near["vector"]), far["qkey"].to_numpy()
            donors_here = _Donors(matrix, ids, k)
            for start in range(0, len(far), 128):
                q, f, at, distance = donors_here.of(_matrix(far["vector"].iloc[start:start + 128]))
                out.append(pd.DataFrame({"qkey": keys[start + q], "f": f, "donor": ids[at], "distance": distance, "value": matrix[at, f]}))
        return pd.concat(out[1:] or out, ignore_index=True)

    candidates = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(
        block_donors, "qkey string, f int, donor long, distance double, value double")
    best = Window.partitionBy("qkey", "f").orderBy("distance", "donor")
    filled = (candidates.withColumn("__r", F.row_number().over(best)).where(F.col("__r") <= k)
              .groupBy("qkey", "f").agg(F.avg("value").alias("value"))
              .groupBy("qkey").agg(F.map_from_entries(F.collect_list(F.struct("f", "value"))).alias("__fill")))
    means = train.agg(*[F.avg(c).alias(c) for c in columns]).collect()[0]
    keyed = query.withColumn("__vector", as_vector).withColumn("__qkey", vector_key("__vector"))
    joined = keyed.join(filled.withColumnRenamed("qkey", "__qkey"), "__qkey", "left")
    return joined.withColumns({
        c: F.coalesce(F.col(c).cast("double"), F.try_element_at("__fill", F.lit(i)), F.lit(means[c]).cast("double"))
        for i, c in enumerate(columns)}).drop("__qkey", "__vector", "__fill")
