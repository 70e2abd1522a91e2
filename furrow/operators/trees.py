"""Regression forests and boosted trees from histograms of binned rows.

Every slot is cut into at most 32 bins once; slots of few bins share a byte. Rows lie in blocks of bins, written once. A level of a tree
is one pass that adds up (count, sum) by node and bin. Nodes of a forest with few rows leave the passes (Panda et al., PVLDB 2009): their
rows are dealt by node, each task grows the rest of its nodes, so a deep forest takes a handful of passes. Passing all nodes of all
levels through histograms would move more than the rows themselves. A boosted tree is shallow and takes all its levels by passes; what is
left to explain lies in memory or on disk beside the bins.
"""

from __future__ import annotations

from collections.abc import Generator, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.session import counted_cut

MAX_BINS = 32
BLOCK_ROWS = 1 << 14
NODE_ROWS = 1 << 17  # nodes of a forest with at most this many rows are grown in one task
PASS_BYTES = 1 << 25  # histograms that a task holds at once
TOGETHER_BYTES = 1 << 22  # and those of several boosted models, which go to the driver
STATE_BYTES = 1 << 26  # what boosted models that share the passes have left to explain, in one task
DEALT_ROWS = 1 << 28  # rows of nodes that one job deals out
LOCAL_NODES = 1 << 11
ROUNDING = 1e-10


@dataclass(frozen=True)
class Bins:
    """Cuts of every slot, and the place (column, stride) of its bin; a column holds the bins of one or several slots, 32 values at most."""

    edges: list[np.ndarray]
    places: list[tuple[int, int]]
    widths: list[int]

    @classmethod
    def of(cls, edges: list[np.ndarray]) -> Bins:
        places: list[tuple[int, int]] = [(-1, 0)] * len(edges)
        widths: list[int] = []
        for slot in sorted(range(len(edges)), key=lambda s: -len(edges[s])):
            width = len(edges[slot]) + 1
            if width == 1:  # nothing to split
                continue
            if not widths or widths[-1] * width > MAX_BINS:
                widths.append(1)
            places[slot] = (len(widths) - 1, widths[-1])
            widths[-1] *= width
        return cls(edges, places, widths or [1])

    def codes(self, x: np.ndarray) -> np.ndarray:
        """One row of bytes for each column."""
        out = np.zeros((len(self.widths), len(x)), dtype=np.uint8)
        for slot, (column, stride) in enumerate(self.places):
            if column >= 0:
                cut = self.edges[slot]
                bins = x[:, slot] > cut[0] if len(cut) == 1 else np.searchsorted(cut, x[:, slot])
                out[column] += (bins * stride).astype(np.uint8)
        return out


@dataclass(frozen=True)
class Rules:
    max_depth: int
    min_rows: int = 1
    min_gain: float = 0.0
    share: str = "all"  # of the slots, drawn by node, that a split chooses from: all, sqrt, log2, onethird or a fraction
    seed: int = 0

    def slots(self, n: int) -> int:
        named = {"all": n, "sqrt": np.ceil(np.sqrt(n)), "log2": np.ceil(np.log2(max(n, 2))), "onethird": np.ceil(n / 3)}
        return max(1, int(named[self.share] if self.share in named else np.ceil(float(self.share) * n)))


@dataclass
class Tree:
    """A row of a node goes left if the mask has the bit of its column's value; the right child follows the left one. Leaves have column -1."""

    column: np.ndarray = field(default_factory=lambda: np.full(1, -1, dtype=np.int16))
    mask: np.ndarray = field(default_factory=lambda: np.zeros(1, dtype=np.uint32))
    left: np.ndarray = field(default_factory=lambda: np.zeros(1, dtype=np.int32))
    value: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def route(self, codes: np.ndarray) -> np.ndarray:
        """The node that each row ends in."""
        node, at = np.zeros(codes.shape[1], dtype=np.int32), np.arange(codes.shape[1])
        while True:
            column = self.column[node]
            inner = column >= 0
            if not inner.any():
                return node
            stays = (self.mask[node] >> codes[column, at]) & np.uint32(1)
            node = np.where(inner, self.left[node] + 1 - stays.astype(np.int32), node)

    def split(self, nodes: np.ndarray, found: dict[str, np.ndarray]) -> np.ndarray:
        """Give the nodes their splits; the new nodes, left and right in turn."""
        first, n = len(self.column), len(nodes)
        self.column[nodes], self.mask[nodes] = found["column"], found["mask"]
        self.left[nodes] = first + 2 * np.arange(n, dtype=np.int32)
        self.column = np.append(self.column, np.full(2 * n, -1, dtype=np.int16))
        self.mask = np.append(self.mask, np.zeros(2 * n, dtype=np.uint32))
        self.left = np.append(self.left, np.zeros(2 * n, dtype=np.int32))
        means = np.column_stack([found["left_sum"] / found["left_n"], (found["sum"] - found["left_sum"]) / (found["n"] - found["left_n"])])
        self.value = np.append(self.value, means.ravel())
        return np.arange(first, first + 2 * n)

    def graft(self, node: int, other: Tree) -> None:
        """Put a tree in the place of a leaf; its nodes but the root go to the end."""
        shift = len(self.column) - 1
        left = np.where(other.column >= 0, other.left + shift, 0).astype(np.int32)
        self.column[node], self.mask[node], self.left[node], self.value[node] = other.column[0], other.mask[0], left[0], other.value[0]
        self.column, self.mask = np.append(self.column, other.column[1:]), np.append(self.mask, other.mask[1:])
        self.left, self.value = np.append(self.left, left[1:]), np.append(self.value, other.value[1:])


def add_sums(total: np.ndarray, widths: list[int], codes: np.ndarray, node: np.ndarray, weight: np.ndarray | None, goal: np.ndarray) -> None:
    """Add the rows' (count, sum of goals) to ``total`` (node, cell, 2); the cells of the columns lie one after another."""
    node, start, n = node.astype(np.int64), 0, len(total)
    goals = goal if weight is None else goal * weight
    for column, width in enumerate(widths):
        key = node * width + codes[column]
        total[:, start:start + width, 0] += np.bincount(key, weight, n * width).reshape(n, width)
        total[:, start:start + width, 1] += np.bincount(key, goals, n * width).reshape(n, width)
        start += width


def best_splits(total: np.ndarray, bins: Bins, rules: Rules, names: np.ndarray) -> dict[str, np.ndarray]:
    """For each node the split of the largest fall in variance per row; column -1 if none is allowed. ``names`` seed the draws of slots."""
    starts = np.concatenate([[0], np.cumsum(bins.widths)])
    n, s = total[:, :bins.widths[0], 0].sum(axis=1), total[:, :bins.widths[0], 1].sum(axis=1)
    base = s * s / np.maximum(n, 1e-300)
    best = np.maximum(ROUNDING * base, 0.0)
    out = {"n": n, "sum": s, "column": np.full(len(n), -1, dtype=np.int16), "mask": np.zeros(len(n), dtype=np.uint32),
           "left_n": np.zeros(len(n)), "left_sum": np.zeros(len(n))}
    used = [slot for slot, (column, _) in enumerate(bins.places) if column >= 0]
    drawn, wanted = None, rules.slots(len(used))
    if wanted < len(used):
        drawn = np.array([np.isin(used, np.random.default_rng([rules.seed, *map(int, name)]).choice(used, wanted, replace=False)) for name in names])
    for i, slot in enumerate(used):
        (column, stride), width = bins.places[slot], len(bins.edges[slot]) + 1
        cells = total[:, starts[column]:starts[column + 1]].reshape(len(n), -1, width, stride, 2).sum(axis=(1, 3))
        left = cells.cumsum(axis=1)[:, :-1]
        left_n, left_s = left[..., 0], left[..., 1]
        right_n, right_s = n[:, None] - left_n, s[:, None] - left_s
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = left_s * left_s / left_n + right_s * right_s / right_n - base[:, None]
        allowed = (left_n >= max(rules.min_rows, 1e-9)) & (right_n >= max(rules.min_rows, 1e-9)) & (gain >= rules.min_gain * n[:, None])
        gain = np.where(allowed if drawn is None else allowed & drawn[:, i:i + 1], gain, -np.inf)
        cut = gain.argmax(axis=1)
        at = np.arange(len(n))
        better = np.flatnonzero(gain[at, cut] > best)
        best[better] = gain[better, cut[better]]
        place = np.arange(bins.widths[column]) // stride % width
        masks = np.array([sum(1 << int(v) for v in np.flatnonzero(place <= c)) for c in range(width - 1)], dtype=np.uint32)
        out["column"][better], out["mask"][better] = column, masks[cut[better]]
        out["left_n"][better], out["left_sum"][better] = left_n[better, cut[better]], left_s[better, cut[better]]
    return out


def grow_here(codes: np.ndarray, weight: np.ndarray, goal: np.ndarray, bins: Bins, rules: Rules, name: tuple[int, int]) -> Tree:
    """The tree of a node whose rows are all here."""
    tree, cells = Tree(), sum(bins.widths)
    tree.value[0] = goal @ weight / weight.sum()
    place, open_nodes = np.zeros(len(goal), dtype=np.int64), np.zeros(1, dtype=np.int64)
    for _ in range(rules.max_depth):
        following = np.full(len(open_nodes) * 2, -1, dtype=np.int64)
        for start in range(0, len(open_nodes), LOCAL_NODES):
            part = open_nodes[start:start + LOCAL_NODES]
            rows = slice(None) if len(open_nodes) <= LOCAL_NODES else np.flatnonzero((place >= start) & (place < start + LOCAL_NODES))
            total = np.zeros((len(part), cells, 2))
            add_sums(total, bins.widths, codes[:, rows], place[rows] - start, weight[rows], goal[rows])
            found = best_splits(total, bins, rules, np.column_stack([np.full(len(part), name[0]), np.full(len(part), name[1]), part]))
            splits = np.flatnonzero(found["column"] >= 0)
            following[(2 * (start + splits)[:, None] + [0, 1]).ravel()] = tree.split(part[splits], {k: v[splits] for k, v in found.items()})
        if (following < 0).all():
            break
        parent = open_nodes[place]
        stays = ((tree.mask[parent] >> codes[tree.column[parent], np.arange(len(place))]) & np.uint32(1)).astype(np.int64)
        numbers = np.cumsum(following >= 0) - 1
        child = 2 * place + 1 - stays
        kept = (tree.column[parent] >= 0)
        place = numbers[child[kept]]
        codes, weight, goal = (codes, weight, goal) if kept.all() else (codes[:, kept], weight[kept], goal[kept])
        open_nodes = following[following >= 0]
    return tree


def slot_edges(encoded: DataFrame) -> tuple[list[np.ndarray], float, int]:
    """Cuts of each slot (array ``x``), between its values if they are few, else at quantiles of all rows; mean and count of the labels."""
    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[np.ndarray | None] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"))
            seen = seen or [np.zeros(0)] * x.shape[1]
            for slot, values in enumerate(seen):
                if values is not None:
                    if len(values) == 2 and ((x[:, slot] == values[0]) | (x[:, slot] == values[1])).all():  # a flag
                        continue
                    values = np.union1d(values, x[:, slot])
                    seen[slot] = values if len(values) <= MAX_BINS else None
        rows = [(slot, v) for slot, values in enumerate(seen) for v in ([None] if values is None else values.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.float64())], ["slot", "value"])

    values = encoded.select("x").mapInArrow(few, "slot int, value double")
    found = {r["slot"]: r for r in values.groupBy("slot").agg(
        F.bool_or(F.col("value").isNull()).alias("many"), F.slice(F.sort_array(F.collect_set("value")), 1, MAX_BINS + 1).alias("values")).collect()}
    many = sorted(s for s, r in found.items() if r["many"] or len(r["values"]) > MAX_BINS)
    shares = F.array(*[F.lit(i / MAX_BINS) for i in range(1, MAX_BINS)])
    quantiles = [F.percentile_approx(F.col("x")[s], shares, 2000) for s in many]
    row = encoded.agg(F.avg("label"), F.count("label"), *quantiles).first()
    edges = {s: np.unique(np.array(q)) for s, q in zip(many, row[2:])}
    for s, r in found.items():
        if s not in edges:
            values = np.array(r["values"])
            edges[s] = (values[:-1] + values[1:]) / 2
    return [edges[s] for s in range(len(edges))], row[0] or 0.0, row[1]


def _matrix(values: pa.Array) -> np.ndarray:
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


@dataclass(frozen=True)
class Blocks:
    """Binned rows in blocks: block (long), codes and goal (binary); the goal is the label less the mean."""

    frame: DataFrame
    bins: Bins
    mean: float
    n: int

    @classmethod
    def of(cls, train: DataFrame) -> Blocks:
        """From label and features; written once."""
        encoded = train.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("label"))
        edges, mean, n_rows = slot_edges(encoded)
        bins = Bins.of(edges)

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n = [], 0
            for batch in batches:
                if not batch.num_rows:
                    continue
                labels = batch.column("label").to_numpy(zero_copy_only=False)
                held.append((bins.codes(_matrix(batch.column("x"))), labels - mean))
                n += len(labels)
                if n >= BLOCK_ROWS:
                    yield _block(held)
                    held, n = [], 0
            if n:
                yield _block(held)

        blocks = encoded.mapInArrow(packed, "codes binary, goal binary")
        width = encoded.sparkSession.sparkContext.defaultParallelism
        blocks = blocks.repartition(max(width, -(-n_rows // (BLOCK_ROWS * 64)))).withColumn("block", F.monotonically_increasing_id())
        return cls(counted_cut(blocks)[0], bins, mean, n_rows)


def _block(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    codes, goal = np.concatenate([h[0] for h in held], axis=1), np.concatenate([h[1] for h in held])
    return pa.RecordBatch.from_arrays([pa.array([codes.tobytes()], pa.binary()), pa.array([goal.tobytes()], pa.binary())], ["codes", "goal"])


def _opened(batches: Iterator[pa.RecordBatch], n_goals: int = 1) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for batch in batches:
        for block, codes, goal in zip(*(batch.column(c) for c in ("block", "codes", "goal"))):
            goal = np.frombuffer(goal.as_buffer(), dtype=np.float64)
            yield block.as_py(), np.frombuffer(codes.as_buffer(), dtype=np.uint8).reshape(-1, len(goal) // n_goals), goal


def _poisson(seed: int, tree: int, block: int, n: int) -> np.ndarray:
    """How often each row of the block is drawn for the tree."""
    rng = np.random.default_rng([seed, tree, block])
    return _POISSON[rng.integers(0, 1 << 16, n, dtype=np.uint16)]


_SHARES = np.exp(-1.0) / np.cumprod(np.concatenate([[1.0], np.arange(1.0, 9.0)]))
_POISSON = np.searchsorted(np.cumsum(_SHARES)[:-1], (np.arange(1 << 16) + 0.5) / (1 << 16), side="right").astype(np.uint8)


def _total(frame: DataFrame, shape: tuple[int, int, int]) -> np.ndarray:
    """The sum of the tasks' histograms (``total`` binary), as a few small pieces on the driver."""
    total = np.zeros(shape)
    for piece in frame.toArrow().column("total"):
        total += np.frombuffer(piece.as_buffer(), dtype=np.float64).reshape(shape)
    return total


def fit_forest(train: DataFrame, n_trees: int, rules: Rules) -> TreeEnsemble:
    """Trees on rows drawn with replacement (Poisson weights); their mean is the prediction."""
    blocks = Blocks.of(train)
    bins, cells = blocks.bins, sum(blocks.bins.widths)
    trees = [Tree() for _ in range(n_trees)]
    small: list[tuple[int, int, int, float]] = []  # tree, node, depth, rows
    wide = [(t, 0) for t in range(n_trees)] if blocks.n > NODE_ROWS else []
    small += [] if wide else [(t, 0, 0, float(blocks.n)) for t in range(n_trees)]
    at_once = max(1, PASS_BYTES // (cells * 16))
    for depth in range(rules.max_depth):
        following = []
        for start in range(0, len(wide), at_once):
            part = wide[start:start + at_once]
            found = _level_splits(blocks, trees, part, rules)
            for t in dict.fromkeys(t for t, _ in part):
                own = np.array([i for i, (other, _) in enumerate(part) if other == t])
                if depth == 0:
                    trees[t].value[0] = found["sum"][own[0]] / max(found["n"][own[0]], 1.0)
                splits = own[found["column"][own] >= 0]
                made = trees[t].split(np.array([part[i][1] for i in splits], dtype=np.int64), {k: v[splits] for k, v in found.items()})
                sizes = np.column_stack([found["left_n"][splits], found["n"][splits] - found["left_n"][splits]]).ravel()
                for node, size in zip(made.tolist(), sizes.tolist()):
                    if size > NODE_ROWS:
                        following.append((t, node))
                    elif size >= 2 * rules.min_rows:
                        small.append((t, node, depth + 1, size))
        wide = following
    small = [s for s in sorted(small) if s[2] < rules.max_depth]
    while small:
        ends = np.cumsum([s[3] for s in small])
        end = max(1, int(np.searchsorted(ends, DEALT_ROWS, side="right")))
        for t, node, tree in _grown(blocks, trees, small[:end], rules):
            trees[t].graft(node, tree)
        small = small[end:]
    return TreeEnsemble.of(trees, [1.0 / n_trees] * n_trees, blocks)


def _members(trees: list[Tree], nodes: list[tuple[int, int]]) -> dict[int, tuple[Tree, np.ndarray]]:
    """For each tree the number in ``nodes`` of each of its nodes, -1 for others."""
    out = {}
    for i, (t, node) in enumerate(nodes):
        if t not in out:
            out[t] = (trees[t], np.full(len(trees[t].column), -1, dtype=np.int64))
        out[t][1][node] = i
    return out


def _level_splits(blocks: Blocks, trees: list[Tree], nodes: list[tuple[int, int]], rules: Rules) -> dict[str, np.ndarray]:
    """The splits of wide nodes, found where a range of nodes is added up; only the splits reach the driver."""
    bins, members, names, share = blocks.bins, _members(trees, nodes), np.array(nodes), 64

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), sum(bins.widths), 2))
        for block, codes, goal in _opened(batches):
            for t, (tree, numbers) in members.items():
                weight = _poisson(rules.seed, t, block, len(goal))
                place = numbers[tree.route(codes)]
                rows = np.flatnonzero((weight > 0) & (place >= 0))
                low = numbers[numbers >= 0].min()
                high = numbers.max() + 1
                add_sums(total[low:high], bins.widths, codes[:, rows], place[rows] - low, weight[rows], goal[rows])
        starts = range(0, len(names), share)
        yield pa.RecordBatch.from_arrays([pa.array([s // share for s in starts], pa.int32()),
                                          pa.array([total[s:s + share].tobytes() for s in starts], pa.binary())], ["range", "total"])

    def split(table: pa.Table) -> pa.Table:
        at = table.column("range")[0].as_py() * share
        own = names[at:at + share]
        total = sum(np.frombuffer(p.as_buffer(), dtype=np.float64) for p in table.column("total")).reshape(len(own), -1, 2)
        found = best_splits(total, bins, rules, own)
        return pa.table({"node": pa.array(np.arange(at, at + len(own))), "n": found["n"], "sum": found["sum"], "column": found["column"].astype(np.int32),
                         "mask": found["mask"].astype(np.int64), "left_n": found["left_n"], "left_sum": found["left_sum"]})

    schema = "node long, n double, sum double, column int, mask long, left_n double, left_sum double"
    found = (blocks.frame.select("block", "codes", "goal").mapInArrow(add_up, "range int, total binary")
             .groupBy("range").applyInArrow(split, schema).toArrow().sort_by("node"))
    out = {c: found.column(c).to_numpy() for c in found.column_names if c != "node"}
    return {**out, "column": out["column"].astype(np.int16), "mask": out["mask"].astype(np.uint32)}


def _grown(blocks: Blocks, trees: list[Tree], small: list[tuple[int, int, int, float]], rules: Rules) -> Iterator[tuple[int, int, Tree]]:
    """The trees of small nodes, each grown where its rows are dealt to."""
    bins, members = blocks.bins, _members(trees, [(t, node) for t, node, _, _ in small])
    nodes = np.array([(t, node, depth) for t, node, depth, _ in small])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, codes, goal in _opened(batches):
            for t, (tree, numbers) in members.items():
                weight = _poisson(rules.seed, t, block, len(goal))
                place = numbers[tree.route(codes)]
                rows = np.flatnonzero((weight > 0) & (place >= 0))
                rows = rows[np.argsort(place[rows], kind="stable")]
                if not len(rows):
                    continue
                found, starts = np.unique(place[rows], return_index=True)
                ends = np.append(starts[1:], len(rows))
                own = [rows[a:b] for a, b in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found, pa.int64()), pa.array([codes[:, r].tobytes() for r in own], pa.binary()),
                     pa.array([weight[r].tobytes() for r in own], pa.binary()), pa.array([goal[r].tobytes() for r in own], pa.binary())],
                    ["number", "codes", "weight", "goal"])

    def grow(table: pa.Table) -> pa.Table:
        number = table.column("number")[0].as_py()
        t, node, depth = nodes[number].tolist()
        weight, goal = (np.concatenate([np.frombuffer(p.as_buffer(), dtype=d) for p in table.column(c)]) for c, d in (("weight", np.uint8), ("goal", np.float64)))
        codes = np.concatenate([np.frombuffer(p.as_buffer(), dtype=np.uint8).reshape(len(bins.widths), -1) for p in table.column("codes")], axis=1)
        left = replace(rules, max_depth=rules.max_depth - depth)
        tree = grow_here(codes, weight.astype(np.float64), goal, bins, left, (t, node))
        return pa.table({"number": pa.array([number]), **{c: pa.array([getattr(tree, c).tobytes()], pa.binary()) for c in ("column", "mask", "left", "value")}})

    dealt = blocks.frame.select("block", "codes", "goal").mapInArrow(deal, "number long, codes binary, weight binary, goal binary")
    grown = dealt.groupBy("number").applyInArrow(grow, "number long, column binary, mask binary, left binary, value binary").toArrow()
    for row in sorted(grown.to_pylist(), key=lambda r: r["number"]):
        t, node, _, _ = small[row["number"]]
        yield t, node, Tree(*(np.frombuffer(row[c], dtype=d) for c, d in (("column", np.int16), ("mask", np.uint32), ("left", np.int32), ("value", np.float64))))


@dataclass(frozen=True)
class Boosting:
    """What ``fit_boosting`` takes besides the rows."""

    rounds: int
    rate: float
    subsample: float
    rules: Rules
    gamma: float = 0.0


def fit_boosting(train: DataFrame, rounds: int, rate: float, subsample: float, rules: Rules, gamma: float = 0.0) -> TreeEnsemble:
    """Each tree is fitted to the negative gradient of the squared error, twice what is left to explain; the first to the label itself.

    ``gamma`` is the least total loss reduction of a split: the squared loss of n rows falls by n / 2 times the gain in variance per row.
    """
    return fit_boostings(train, [Boosting(rounds, rate, subsample, rules, gamma)])[0]


def fit_boostings(train: DataFrame, wanted: list[Boosting]) -> list[TreeEnsemble]:
    """``fit_boosting`` of several settings on the same rows: they share the binned rows, and a pass serves as many as STATE_BYTES allow."""
    blocks = Blocks.of(train)
    at_once = max(1, STATE_BYTES // (8 * max(1, -(-blocks.n // blocks.frame.rdd.getNumPartitions()))))
    out: list[TreeEnsemble | None] = [None] * len(wanted)
    order = sorted(range(len(wanted)), key=lambda i: wanted[i].rounds)  # those that go together end together
    for start in range(0, len(order), at_once):
        own = order[start:start + at_once]
        for i, trees in zip(own, _boosted(blocks, [replace(wanted[i], rules=replace(wanted[i].rules, min_gain=2.0 * wanted[i].gamma / max(blocks.n, 1)))
                                                   for i in own])):
            out[i] = TreeEnsemble.of(trees, [wanted[i].rate if number else 1.0 for number in range(len(trees))], blocks)
    return out


def _boosted(blocks: Blocks, wanted: list[Boosting]) -> list[list[Tree]]:
    """The trees of all settings, round by round; the state holds what each setting that goes on has left to explain."""
    state, before = blocks.frame.select("block", "codes", "goal"), None
    places = dict.fromkeys(range(len(wanted)), 0)  # of a setting's goals in the state; they start from the same
    n_goals = 1
    trees: list[list[Tree]] = [[] for _ in wanted]
    try:
        for number in range(max(w.rounds for w in wanted)):
            places = {i: place for i, place in places.items() if wanted[i].rounds > number}
            for i, tree in _boosted_trees(state, blocks.bins, number, {i: wanted[i] for i in places}, places, n_goals).items():
                trees[i].append(tree)
            if before is not None:  # the passes have read it into the state
                before.unpersist()
                before = None
            after = [i for i in places if wanted[i].rounds > number + 1]
            if not after:
                break
            before = state if number else None
            state = _explained(state, n_goals, [(places[i], trees[i][-1], wanted[i].rate if number else 1.0) for i in after]).persist()
            places, n_goals = {i: place for place, i in enumerate(after)}, len(after)
    finally:
        for frame in (before, state):
            if frame is not None:
                frame.unpersist()
    return trees


def _with_goals(batches: Iterator[pa.RecordBatch], n_goals: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for block, codes, goal in _opened(batches, n_goals):
        yield block, codes, goal.reshape(n_goals, -1)


def _explained(state: DataFrame, n_goals: int, parts: list[tuple[int, Tree, float]]) -> DataFrame:
    """The state after a round: for each part the goals at its place less its share of its tree."""
    def less(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            goals = [np.stack([goal[place] - share * tree.value[tree.route(codes)] for place, tree, share in parts]).tobytes()
                     for _, codes, goal in _with_goals([batch], n_goals)]
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("codes"), pa.array(goals, pa.binary())], ["block", "codes", "goal"])

    return state.mapInArrow(less, "block long, codes binary, goal binary")


def _boosted_trees(state: DataFrame, bins: Bins, number: int, wanted: dict[int, Boosting], places: dict[int, int], n_goals: int) -> dict[int, Tree]:
    """One tree of each setting, level by level."""
    trees = {i: Tree() for i in wanted}
    steps = {i: _levels(trees[i], bins, number, w.rules) for i, w in wanted.items()}
    asked = {i: nodes for i, step in steps.items() if (nodes := next(step, None)) is not None}
    cells = sum(bins.widths)
    while asked:
        following: dict[int, np.ndarray] = {}
        waiting = list(asked)
        while waiting:  # as many as a task's histograms have room for
            sizes = np.cumsum([len(asked[i]) * cells * 16 for i in waiting])
            own = waiting[:max(1, int(np.searchsorted(sizes, TOGETHER_BYTES, side="right")))]
            waiting = waiting[len(own):]
            passes = [(places[i], trees[i], asked[i], wanted[i].subsample, wanted[i].rules.seed) for i in own]
            for i, total in zip(own, _pass(state, bins, passes, n_goals, number, 2.0 if number else 1.0)):
                try:
                    following[i] = steps[i].send(total)
                except StopIteration:
                    pass
        asked = following
    return trees


def _levels(tree: Tree, bins: Bins, number: int, rules: Rules) -> Generator[np.ndarray, np.ndarray, None]:
    """Grows a tree: yields the nodes whose rows have to be added up, and is sent their sums; of two children only the smaller one is added
    up, the other is the rest of the parent."""
    open_nodes, sums = np.zeros(1, dtype=np.int64), None
    for depth in range(rules.max_depth):
        asked, other, parents = open_nodes, None, None
        if sums is not None:
            pairs = open_nodes.reshape(-1, 2)
            parents, sizes = sums
            least = sizes.argmin(axis=1)
            at = np.arange(len(pairs))
            asked, other = pairs[at, least], pairs[at, 1 - least]
        total = yield asked
        if other is not None:
            whole = np.empty((len(open_nodes), *total.shape[1:]))
            at = np.arange(len(pairs))
            whole[2 * at + least], whole[2 * at + 1 - least] = total, parents - total
            total = whole
        found = best_splits(total, bins, rules, np.column_stack([np.full(len(open_nodes), number), open_nodes]))
        if depth == 0:
            tree.value[0] = found["sum"][0] / max(found["n"][0], 1.0)
        splits = np.flatnonzero(found["column"] >= 0)
        if not len(splits):
            break
        found = {k: v[splits] for k, v in found.items()}
        open_nodes = tree.split(open_nodes[splits], found)
        sums = total[splits], np.column_stack([found["left_n"], found["n"] - found["left_n"]])


def _pass(state: DataFrame, bins: Bins, passes: list[tuple[int, Tree, np.ndarray, float, int]], n_goals: int, number: int,
          factor: float) -> list[np.ndarray]:
    """The histograms of several trees' nodes: (place of the goals, tree, nodes, subsample, seed)."""
    numbers = [np.full(len(tree.column), -1, dtype=np.int64) for _, tree, _, _, _ in passes]
    for (_, _, nodes, _, _), own in zip(passes, numbers):
        own[nodes] = np.arange(len(nodes))
    cells = sum(bins.widths)
    ends = np.cumsum([0, *(len(nodes) for _, _, nodes, _, _ in passes)])
    shape = (ends[-1], cells, 2)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for block, codes, goals in _with_goals(batches, n_goals):
            for (goal, tree, _, subsample, seed), own, start, end in zip(passes, numbers, ends, ends[1:]):
                place = own[tree.route(codes)]
                kept = place >= 0
                if subsample < 1:
                    kept &= np.random.default_rng([seed, number, block]).random(len(kept), dtype=np.float32) < subsample
                rows = np.flatnonzero(kept)
                add_sums(total[start:end], bins.widths, codes[:, rows], place[rows], None, goals[goal, rows] * factor)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    total = _total(state.mapInArrow(add_up, "total binary"), shape)
    return [total[start:end] for start, end in zip(ends, ends[1:])]


class TreeEnsemble(Model, MLWritable, MLReadable):
    """Adds y_pred: the mean of the labels plus the weighted trees. A stage of a pipeline, saved as a table of trees."""

    bins: Bins
    trees: list[Tree]
    weights: list[float]
    mean: float

    @classmethod
    def of(cls, trees: list[Tree], weights: list[float], blocks: Blocks) -> TreeEnsemble:
        out = cls()
        out.bins, out.trees, out.weights, out.mean = blocks.bins, trees, weights, blocks.mean
        return out

    def _transform(self, dataset: DataFrame) -> DataFrame:
        bins, trees, weights, mean = self.bins, self.trees, self.weights, self.mean

        @F.arrow_udf("double")
        def run(x: pa.Array) -> pa.Array:
            if not len(x):
                return pa.array([], pa.float64())
            codes, out = bins.codes(_matrix(x)), np.full(len(x), mean)
            for tree, weight in zip(trees, weights):
                out += weight * tree.value[tree.route(codes)]
            return pa.array(out)

        return dataset.withColumn("y_pred", run(vector_to_array("features")))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: TreeEnsemble):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        model = self.model
        DefaultParamsWriter.saveMetadata(model, path, self.sparkSession, {"mean": model.mean, "edges": [e.tolist() for e in model.bins.edges]})
        rows = [(i, w, t.column.tolist(), t.mask.tolist(), t.left.tolist(), t.value.tolist()) for i, (t, w) in enumerate(zip(model.trees, model.weights))]
        schema = "tree int, weight double, column array<int>, mask array<long>, left array<int>, value array<double>"
        self.sparkSession.createDataFrame(rows, schema).write.parquet(f"{path}/trees")


class _Reader(MLReader):
    def load(self, path: str) -> TreeEnsemble:
        kept = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = TreeEnsemble()
        model._resetUid(kept["uid"])
        rows = self.sparkSession.read.parquet(f"{path}/trees").orderBy("tree").collect()
        model.trees = [Tree(np.array(r["column"], np.int16), np.array(r["mask"], np.uint32), np.array(r["left"], np.int32), np.array(r["value"])) for r in rows]
        model.weights, model.mean, model.bins = [r["weight"] for r in rows], kept["mean"], Bins.of([np.array(e) for e in kept["edges"]])
        return model
