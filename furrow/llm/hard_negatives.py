"""Hard negatives by lists that the anchors of a cluster share, with certified termination.

A row's score for an anchor is the inner product of integer vectors. Anchors are clustered by direction. For a cluster with the
axis c and the largest angle b between c and a member, a row at the angle t from c scores at most |anchor| |row| cos(max(t - b, 0))
for every member. Sorted once by |row| cos(max(t - b, 0)), the rows make one list; each member walks it and stops when the
bound falls strictly below the score it still needs. What a member has then is exact.

Plan: anchors are the query set. They are ranged by cluster into packs, all rows are dealt into blocks of bounded size, and each
(pack, block) pair is a task's work: in it, each cluster's list of the block is sorted and walked. The best of all blocks are
merged by a ranking that keeps few rows of each block. The first pass finds the positives, the second one, which knows their
scores, the negatives between ``low`` and ``high`` percent of them.

Edge cases: rows with a null label, a null vector or a null, NaN or infinite component take no part. A null id is the largest in
ties; repeated rows each count, and repeated anchors are one. Rows of the anchor's id are never its positives or negatives. A
negative positive score admits no negative, a zero one only scores of zero. Zero vectors score zero. Vectors of different lengths
are an error, as are scores beyond 64 bits. Other columns are ignored; an empty table or no anchor gives no row.

Clusters are fitted on at most ``SAMPLE`` anchors; they decide how far lists are walked, never what is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm.common import NO_ID
from furrow.llm.vectors import matrix, stepped, usable
from furrow.session import counted_cut, cut_lineage

SAMPLE, CLUSTERS, MEMBERS, ROUNDS = 2048, 256, 64, 5
PACK, BLOCK = 4096, 8192
STEP, LONGEST = 256, 4096
_NONE = np.iinfo(np.int64).min


def _units(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors, dtype=np.float64))
    return vectors / np.where(norms > 0, norms, 1.0)[:, None], norms


def fit_axes(vectors: np.ndarray, clusters: int) -> np.ndarray:
    """Directions that the vectors gather around (spherical k-means from the first ones)."""
    units, _ = _units(vectors.astype(np.float64))
    axes = units[:clusters].copy()
    for _ in range(ROUNDS):
        at = np.argmax(units @ axes.T, axis=1)
        sums = np.zeros_like(axes)
        np.add.at(sums, at, units)
        fresh, length = _units(sums)
        axes = np.where(length[:, None] > 0, fresh, axes)
    return axes


class SharedList:
    """All rows of a block in the order of their bound for one cluster of anchors."""

    def __init__(self, members: np.ndarray, rows: np.ndarray, units: np.ndarray, norms: np.ndarray):
        own, self.lengths = _units(members.astype(np.float64))
        axis = own.sum(axis=0)
        length = np.sqrt(axis @ axis)
        axis = axis / length if length > 0 else axis
        widest = np.arccos(np.clip(own @ axis, -1.0, 1.0)).max()
        angle = np.arccos(np.clip(units @ axis, -1.0, 1.0))
        # the slack is far above the rounding errors of the angles
        bound = norms * (np.cos(np.maximum(angle - widest, 0.0)) + 1e-6) + 1e-9
        self.order = np.argsort(-bound, kind="stable")
        self.bound = bound[self.order]
        self.members, self.rows = members, rows
        self.walked = 0

    def walk(self, owner: np.ndarray, need: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(active slots, rows, scores): a slot belongs to a member and ends when no further row can score ``need``, which the
        caller raises meanwhile."""
        low, step = 0, STEP
        while low < len(self.order):
            active = np.flatnonzero(self.lengths[owner] * self.bound[low] >= need)
            if not len(active):
                return
            at = self.order[low:low + step]
            who, of = np.unique(owner[active], return_inverse=True)
            scores = _products(self.members[who], self.rows[at])
            self.walked += len(who) * len(at)
            yield active, at, scores[of]
            low, step = low + step, min(2 * step, LONGEST)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors: in floats where they hold them."""
    largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if largest < 2.0 ** 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if largest >= 2.0 ** 63:
        raise ValueError("scores beyond 64 bits")
    return a @ b.T


class _Best:
    """The first ``k`` rows of each slot by score and id."""

    def __init__(self, slots: int, k: int):
        self.k, self.kth = k, np.full(slots, _NONE)
        self.slot = self.score = self.id = self.row = np.zeros(0, dtype=np.int64)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, row: np.ndarray) -> None:
        slot, score, ids, row = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.id, ids), (self.row, row)))
        by = np.lexsort((row, ids, -score, slot))
        slot = slot[by]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        by, slot = by[rank < self.k], slot[rank < self.k]
        self.slot, self.score, self.id, self.row = slot, score[by], ids[by], row[by]
        full = np.flatnonzero(np.bincount(slot, minlength=len(self.kth)) >= self.k)
        self.kth[full] = self.score[np.searchsorted(slot, full, side="right") - 1]


def _block(rows: pa.Table) -> tuple[np.ndarray, ...]:
    vectors = matrix(rows["v"])
    return (*(rows[c].to_numpy() for c in ("no", "key", "label")), vectors, *_units(vectors.astype(np.float64)))


def _clusters(anchors: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index and vectors of the anchors of each cluster, at most ``MEMBERS`` at a time."""
    vectors, cluster = matrix(anchors["v"]), anchors["cluster"].to_numpy()
    order = np.argsort(cluster, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(cluster[order])) + 1):
        for low in range(0, len(group), MEMBERS):
            yield group[low:low + MEMBERS], vectors[group[low:low + MEMBERS]]


def _find_positives(k: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        found = []
        if anchors.num_rows and rows.num_rows:
            no, key, label, vectors, units, norms = _block(rows)
            a, own_key, own_label = (anchors[c].to_numpy() for c in ("a", "own_key", "own_label"))
            for group, members in _clusters(anchors):
                shared, best = SharedList(members, vectors, units, norms), _Best(len(group), k)
                for active, at, scores in shared.walk(np.arange(len(group)), best.kth):
                    mine = group[active][:, None]
                    fits = (label[at] == own_label[mine]) & (key[at] != own_key[mine]) & (scores >= best.kth[active][:, None])
                    i, j = np.nonzero(fits)
                    best.add(active[i], scores[i, j], key[at[j]], no[at[j]])
                found.append(pa.table([pa.array(x) for x in (a[group[best.slot]], best.score, best.id, best.row)],
                                      ["a", "score", "key", "no"]))
        return pa.concat_tables(found) if found else pa.table(
            {c: pa.array([], pa.int64()) for c in ("a", "score", "key", "no")})
    return run


def _find_negatives(k: int, low: int, high: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        found = []
        if anchors.num_rows and rows.num_rows:
            no, key, label, vectors, units, norms = _block(rows)
            a, own_key, own_label = (anchors[c].to_numpy() for c in ("a", "own_key", "own_label"))
            target = anchors["scores"].to_pylist()
            for group, members in _clusters(anchors):
                shared = SharedList(members, vectors, units, norms)
                count = np.array([len(target[g]) for g in group])
                owner = np.repeat(np.arange(len(group)), count)
                place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
                wanted = np.array([s for g in group for s in target[g]], dtype=np.int64)
                best, least = _Best(len(owner), k), low * wanted
                need = np.where(wanted < 0, np.inf, least / 100.0 - 1e-6)
                for active, at, scores in shared.walk(owner, need):
                    mine = group[owner[active]][:, None]
                    fits = ((label[at] != own_label[mine]) & (key[at] != own_key[mine]) & (100 * scores >= least[active][:, None])
                            & (100 * scores <= high * wanted[active][:, None]) & (scores >= best.kth[active][:, None]))
                    i, j = np.nonzero(fits)
                    best.add(active[i], scores[i, j], key[at[j]], no[at[j]])
                    np.maximum(need, best.kth, out=need)
                found.append(pa.table(
                    [pa.array(a[group[owner[best.slot]]]), pa.array(place[best.slot].astype(np.int32) + 1),
                     *(pa.array(x) for x in (best.score, best.id, best.row))], ["a", "place", "score", "key", "no"]))
        return pa.concat_tables(found) if found else pa.table(
            {c: pa.array([], pa.int32() if c == "place" else pa.int64()) for c in ("a", "place", "score", "key", "no")})
    return run


def _to_cluster(axes: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.argmax(matrix(batch.column("v")) @ axes.T, axis=1) if batch.num_rows else np.zeros(0)
            yield batch.append_column("cluster", pa.array(at.astype(np.int32), pa.int32()))
    return run


def _first(found: DataFrame, by: list[str], k: int, name: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "key", "no")
    return found.withColumn(name, F.row_number().over(order)).where(F.col(name) <= k)


def hard_negatives(frame: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                   positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its first
    ``positives`` rows of the same label the first ``negatives`` rows of other labels whose score is ``low`` to ``high`` percent of
    the positive's. ``is_anchor`` is an expression over the id column.
    """
    usable_row = F.col(label_col).isNotNull() & usable(F.col(vector_col))
    rows, count = counted_cut(frame.where(usable_row).select(
        F.monotonically_increasing_id().alias("no"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("key"),
        F.col(label_col).cast("long").alias("label"), stepped(F.col(vector_col), scale).alias("v"),
        F.coalesce(is_anchor, F.lit(False)).alias("anchor")))
    sizes = [r["n"] for r in rows.select(F.size("v").alias("n")).distinct().limit(2).collect()]
    if len(sizes) > 1:
        raise ValueError(f"vectors of {sizes[0]} and of {sizes[1]} components")
    single = rows.where("anchor").groupBy("key", "label", "v").agg(F.min("no").alias("a"))
    chosen, many = counted_cut(single.select("a", F.col("key").alias("own_key"), F.col("label").alias("own_label"), "v"))
    sample = chosen.orderBy(F.xxhash64("a"), "a").limit(SAMPLE).select("v").collect()
    clusters = max(1, min(CLUSTERS, -(-many // MEMBERS), len(sample)))
    axes = fit_axes(np.array([r["v"] for r in sample], dtype=np.float64), clusters) if sample else np.zeros((1, 0))
    packs, blocks = max(1, -(-many // PACK)), max(1, -(-count // BLOCK))
    # ranges of (cluster, hash): a large cluster is cut as well
    anchors = cut_lineage(chosen.mapInArrow(_to_cluster(axes), "a long, own_key long, own_label long, v array<long>, cluster int")
                          .repartitionByRange(packs, "cluster", F.xxhash64("a")).withColumn("pack", F.spark_partition_id()))
    dealt = rows.select("no", "key", "label", "v", F.pmod(F.xxhash64("no"), F.lit(blocks)).cast("int").alias("block"),
                        F.explode(F.sequence(F.lit(0), F.lit(packs - 1))).alias("pack"))

    def each_pair(left: DataFrame, function, schema: str) -> DataFrame:
        left = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        return left.groupBy("pack", "block").cogroup(dealt.groupBy("pack", "block")).applyInArrow(function, schema)

    near = cut_lineage(_first(each_pair(anchors, _find_positives(positives), "a long, score long, key long, no long"),
                              ["a"], positives, "place"))
    listed = near.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("place", "score"))).alias("p"))  # at most ``positives``
    asked = anchors.join(listed, "a").select("*", F.col("p.score").alias("scores")).drop("p")
    found = _first(each_pair(asked, _find_negatives(negatives, low, high), "a long, place int, score long, key long, no long"),
                   ["a", "place"], negatives, "rank")
    pairs = near.join(anchors.select("a", "own_key"), "a").select(
        "a", "place", "own_key", F.col("key").alias("near_key"), F.col("score").alias("positive_score"))

    def real(name: str) -> Column:
        return F.when(F.col(name) != NO_ID, F.col(name))

    return found.join(pairs, ["a", "place"]).select(
        real("own_key").alias("anchor_id"), real("near_key").alias("positive_id"), "rank", real("key").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))
