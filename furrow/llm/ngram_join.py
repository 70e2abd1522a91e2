"""Components of documents whose sets of word n-grams are similar, with signature trees.

A document's set is its distinct ``n``-word shingles of the lower-cased text (A-Z only), as 64-bit hashes; a document of fewer
words has its whole sequence as one shingle. Two documents link when ``100 * |A & B| >= percent * |A | B|``.

Plan: (1) one pass counts tokens within each task and keeps those that many documents have; they come last in the order of
tokens, which is by hash otherwise. The order only spares work: any order that all documents follow gives the same links. A second
pass hashes the sets. Equal sets (128-bit key) are one node from here on, so copies cost nothing. (2) Two sets that link share
``l`` tokens among the first ``n - ceil(t n) + l`` of each in this order (``support`` gives l, at most 3). A token that nodes of fitting
sizes have makes a bucket; tokens of the same nodes make one. A bucket of two nodes that has fewer than l tokens goes: a pair
that links has another of its l tokens in a larger bucket, and is found there. Rows carry half of the key, and
get the whole one with the bitmap. (3) In a bucket a signature tree is built: its nodes hold OR-combined bitmaps and size ranges, and a dual
traversal leaves out node pairs whose largest possible overlap is too small, and those already connected. What survives
connects nodes to *clusters* that contain whole components. (4) Only members of clusters are hashed again; each cluster is
joined exactly by the same traversal, with the true overlap at the leaves. A bucket or cluster above a size limit is split into
blocks, and every two blocks meet in one task; within a task the links found are a forest, never all pairs. (5) Distributed
components of these forests give the result. No link is lost in any step.

Edge cases: null or wordless text has the empty set and links with nothing. A null id comes last when the smallest id of a
component is chosen; a component of null ids only has a null id. Rows with the same id are separate documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import NO_ID, Membership, components, keyed
from furrow.llm.words import Words, blocks, mix
from furrow.session import counted_cut, cut_lineage, owned_cuts

FAN = 8


def token_sets(block: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of the distinct shingles, ordered by row and hash."""
    at, hashes = block.grams(n)
    rows = block.row[at]
    bounds = block.bounds()
    count = np.diff(bounds)
    for size in range(1, n):  # whole sequences of the short rows
        short = np.flatnonzero(count == size)
        rows = np.concatenate([rows, short])
        hashes = np.concatenate([hashes, mix(block._run(bounds[short], size), size)])
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[new], hashes[new]


def _keys(hashes: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """128-bit key of each set: two sums of mixed hashes."""
    out = np.empty((len(begin), 2), dtype=np.uint64)
    for k in (0, 1):
        out[:, k] = mix(np.add.reduceat(mix(hashes, 11 + k), begin), 21 + k) if len(begin) else out[:, k]
    return out


def _binary(keys: np.ndarray) -> pa.Array:
    """Keys as 16 bytes, high byte first."""
    return pa.Array.from_buffers(pa.binary(16), len(keys), [None, pa.py_buffer(keys.astype(">u8").tobytes())]).cast(pa.binary())


def _numbers(keys: pa.ChunkedArray) -> np.ndarray:
    """Keys as rows of unsigned numbers: a long is one, bytes are one for every eight."""
    if pa.types.is_integer(keys.type):
        return keys.to_numpy().view(np.uint64)[:, None]
    return np.frombuffer(b"".join(keys.to_pylist()), dtype=">u8").astype(np.uint64).reshape(len(keys), -1)


def _lists(values: pa.Array, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), values)


def map_bits(size: int) -> int:
    """Bits of the bitmap of a set: the power of two from its size on."""
    return max(64, 1 << (size - 1).bit_length())


def support(size: np.ndarray, percent: int) -> np.ndarray:
    """How many of the first tokens two sets that link have in common at least, if this is the smaller set."""
    return np.minimum(1 + np.minimum(size // 16, 2), -(-percent * size // 100))


def bitmap(tokens: np.ndarray, bits: int) -> bytes:
    out = np.zeros(bits, dtype=np.uint8)
    out[(tokens >> np.uint64(7)).astype(np.uint64) & np.uint64(bits - 1)] = 1
    return np.packbits(out, bitorder="little").tobytes()


class _Fresh:
    """Which keys a task meets for the first time; it forgets when it holds ``most``, which costs work and no result."""

    def __init__(self, most: int = 200_000):
        self.most, self.held = most, set()

    def among(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), dtype=bool)
        for k, key in enumerate(zip(keys[:, 0].tolist(), keys[:, 1].tolist(), strict=True)):
            if key not in self.held:
                out[k] = True
                self.held.add(key)
        if len(self.held) > self.most:
            self.held.clear()
        return out


def _repeated(n: int, least: int = 4, slice_tokens: int = 3_000_000):
    """Tokens that at least ``least`` rows of a slice of the task have, with their number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            token, count = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
            held.clear()
            keep = count >= least
            return pa.RecordBatch.from_arrays([pa.array(token[keep].view(np.int64)), pa.array(count[keep])], ["token", "n"])

        for batch in batches:
            for block in blocks(batch.column("text"), lower=True):
                held.append(token_sets(block, n)[1])
                if sum(map(len, held)) > slice_tokens:
                    yield flush()
        yield flush()
    return run


def _describe(n: int, percent: int, often: Membership | None):
    """Per row: set size, key, the first tokens (frequent ones last, else by hash) and the bitmap.

    A set that the task had before has neither tokens nor a bitmap.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh = _Fresh()
        for batch in batches:
            for block in blocks(batch.column("text"), lower=True):
                row, token = token_sets(block, n)
                bounds = np.searchsorted(row, np.arange(block.rows + 1))
                size = np.diff(bounds)
                own = batch.slice(block.first, block.rows)
                full = np.flatnonzero(size)
                keys = np.zeros((block.rows, 2), dtype=np.uint64)
                keys[full] = _keys(token, bounds[full])
                new = fresh.among(keys[full])
                full = full[new]
                begin, count = bounds[full], size[full]
                low = np.zeros(block.rows, dtype=np.int64)
                low[full] = count + (-percent * count) // 100 + support(count, percent)
                ordered = token if often is None else token[np.lexsort((token, often.has(token), row))]
                pick = np.repeat(begin - np.append(0, np.cumsum(low[full])[:-1]), low[full]) + np.arange(low.sum())
                maps = [b""] * block.rows
                for k in full.tolist():
                    maps[k] = bitmap(token[bounds[k]:bounds[k + 1]], map_bits(int(size[k])))
                yield pa.RecordBatch.from_arrays(
                    [own.column("rid"), own.column("sig"), pa.array(size.astype(np.int64)), _binary(keys),
                     _lists(pa.array(ordered[pick].view(np.int64)), low), pa.array(maps, pa.binary())],
                    ["rid", "sig", "size", "key", "least", "map"])
    return run


def _shared(percent: int, most: int = 200_000):
    """Of rows ordered by token, size and key: those whose neighbour has the token, a fitting size and another key.

    ``bucket`` is a hash of the keys that are left of a token, so tokens of the same rows (near copies share most of theirs) make
    one bucket. ``need`` is how many tokens such a bucket has to have to count. A token with more than ``most`` rows isn't held: its rows go on as they are, in a bucket of their own.
    """
    def out(part: pa.Table, bucket: np.ndarray, need: np.ndarray) -> Iterator[pa.RecordBatch]:
        named = part.select(["key"]).add_column(0, "bucket", pa.array(bucket.view(np.int64)))
        yield from named.append_column("need", pa.array(need.astype(np.int64))).combine_chunks().to_batches()

    def select(part: pa.Table) -> Iterator[pa.RecordBatch]:
        token, size = part["token"].to_numpy(), part["size"].to_numpy()
        key = _numbers(part["key"])
        single = np.ones(len(token), dtype=bool)
        single[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1]).any(axis=1)
        at = np.flatnonzero(single)
        fit = (token[at[1:]] == token[at[:-1]]) & (100 * size[at[:-1]] >= percent * size[at[1:]])
        keep = np.zeros(len(at), dtype=bool)
        keep[1:] |= fit
        keep[:-1] |= fit
        at = at[keep]
        if len(at):
            new = np.ones(len(at), dtype=bool)
            new[1:] = token[at[1:]] != token[at[:-1]]
            begin = np.flatnonzero(new)
            named = mix(np.add.reduceat(mix(key[at, 0], 31), begin), 32)
            two = np.diff(np.append(begin, len(at))) == 2
            need = np.where(two, np.minimum.reduceat(support(size[at], percent), begin), 1)
            group = np.cumsum(new) - 1
            yield from out(part.take(pa.array(at)), named[group], need[group])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, large = None, None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            token = held["token"].to_numpy()
            if not len(token):
                continue
            cut = int(np.searchsorted(token, token[-1]))  # the last token may go on in the next batch
            if large is not None:
                more = int(np.searchsorted(token, large, side="right"))
                yield from out(held.slice(0, more), mix(token[:more].view(np.uint64), 33), np.ones(more))
                held, cut, large = held.slice(more), max(0, cut - more), large if more == len(token) else None
            if cut:
                yield from select(held.slice(0, cut))
                held = held.slice(cut)
            if held.num_rows > most:
                large = int(token[-1])
                yield from out(held, mix(held["token"].to_numpy().view(np.uint64), 33), np.ones(held.num_rows))
                held = held.slice(held.num_rows)
        if held is not None and held.num_rows:
            yield from select(held)
    return run


class Node:
    """A part of the tree: the items below, their size range, their bitmaps OR-combined and the most tokens beyond one a bit."""

    __slots__ = ("items", "children", "low", "high", "width", "bits", "excess", "folded")

    def __init__(self, items, children, low, high, width, bits, excess):
        self.items, self.children, self.low, self.high = items, children, low, high
        self.width, self.bits, self.excess, self.folded = width, bits, excess, {}

    def at(self, width: int) -> tuple[int, int]:
        """Bitmap and excess with ``width`` bits: halves are laid over each other."""
        if width == self.width:
            return self.bits, self.excess
        if width not in self.folded:
            bits, w = self.bits, self.width
            while w > width:
                w //= 2
                bits = (bits | bits >> w) & ((1 << w) - 1)
            # laying halves over each other may cost one bit for each bit lost
            self.folded[width] = bits, self.excess + self.bits.bit_count() - bits.bit_count() if len(self.items) == 1 else self.high
        return self.folded[width]


class SignatureTree:
    """Joins items (size, width, bitmap) by a dual traversal; ``links`` holds the edges that connect something new."""

    def __init__(self, items: list[tuple[int, int, int]], percent: int, exact: Callable[[int, int], bool] | None = None):
        self.percent, self.exact, self.links = percent, exact, []
        self.parent = list(range(len(items)))
        level = [Node([i], (), s, s, w, b, s - b.bit_count()) for i, (s, w, b) in enumerate(items)]
        self.roots = []
        for _, same in groupby(level, key=lambda x: x.width):
            nodes = list(same)
            while len(nodes) > 1:
                nodes = [self._above(nodes[k:k + FAN]) for k in range(0, len(nodes), FAN)]
            self.roots.append(nodes[0])
        for k, x in enumerate(self.roots):
            self._visit(x, x)
            for y in self.roots[k + 1:]:
                self._visit(x, y)

    @staticmethod
    def _above(children: list[Node]) -> Node:
        bits = 0
        for c in children:
            bits |= c.bits
        return Node([i for c in children for i in c.items], children, min(c.low for c in children), max(c.high for c in children),
                    children[0].width, bits, max(c.excess for c in children))

    def _find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def _visit(self, x: Node, y: Node) -> None:
        if x is y:
            if len(x.items) > 1:
                for k, c in enumerate(x.children):
                    self._visit(c, c)
                    for d in x.children[:k]:
                        self._visit(d, c)
            return
        if 100 * x.high < self.percent * y.low or 100 * y.high < self.percent * x.low:
            return
        width = min(x.width, y.width)
        (a, more_a), (b, more_b) = x.at(width), y.at(width)
        least = min(max(x.low, -(-self.percent * y.low // 100)), x.high) + y.low  # of the sizes of a pair that could link
        # |A & B| >= p / (100 + p) * (|A| + |B|)
        if (100 + self.percent) * ((a & b).bit_count() + min(more_a, more_b)) < self.percent * least:
            return
        if len(x.items) == 1 and len(y.items) == 1:
            self._pair(x, y, a, b, width)
            return
        first = self._find(x.items[0])
        if all(self._find(i) == first for i in x.items) and all(self._find(i) == first for i in y.items):
            return
        if x.children and (len(x.items) >= len(y.items) or not y.children):
            for c in x.children:
                self._visit(c, y)
        else:
            for c in y.children:
                self._visit(x, c)

    def _pair(self, x: Node, y: Node, a: int, b: int, width: int) -> None:
        i, j = x.items[0], y.items[0]
        root, other = self._find(i), self._find(j)
        if root == other:
            return
        most = min(x.low - (a & ~b).bit_count(), y.low - (b & ~a).bit_count())
        if (100 + self.percent) * most < self.percent * (x.low + y.low):
            return
        if self.exact is None or self.exact(i, j):
            self.parent[root] = other
            self.links.append((i, j))


def _groups(batches: Iterator[pa.RecordBatch], columns: list[str], key: int) -> Iterator[list[tuple]]:
    """Rows (tuples of the columns) of one group after another; the first ``key`` columns name the group."""
    def rows():
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in columns), strict=True)

    for _, group in groupby(rows(), key=lambda r: r[:key]):
        yield list(group)


def _edges(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.binary())], ["a", "b"])


def _coarse(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple[bytes, bytes]] = set()
        for group in _groups(batches, ["bucket", "i", "j", "lead", "size", "key", "map"], 3):
            items = [(size, 8 * len(bits), int.from_bytes(bits, "little")) for *_, size, _, bits in group]
            for a, b in SignatureTree(items, percent).links:
                found.add((group[a][5], group[b][5]))
            if len(found) > 50_000:
                yield _edges(list(found))
                found.clear()
        yield _edges(list(found))
    return run


def _exact(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _token_groups(batches):
            keys, sets = batch
            items = [(len(s), map_bits(len(s)), int.from_bytes(bitmap(s, map_bits(len(s))), "little")) for s in sets]

            def links(i: int, j: int) -> bool:
                a, b = sets[i], sets[j]
                if len(a) > len(b):
                    a, b = b, a
                at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                both = int((b[at] == a).sum())
                return 100 * both >= percent * (len(a) + len(b) - both)

            found = SignatureTree(items, percent, links).links
            if found:
                yield _edges([(keys[a], keys[b]) for a, b in found])
    return run


def _token_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], list[np.ndarray]]]:
    """Keys and sorted token arrays of each (cluster, i, j)."""
    last, keys, sets = None, [], []
    for batch in batches:
        names = list(zip(batch.column("cluster").to_pylist(), batch.column("i").to_pylist(), batch.column("j").to_pylist(), strict=True))
        tokens = batch.column("tokens")
        for k, (name, key) in enumerate(zip(names, batch.column("key").to_pylist(), strict=True)):
            if name != last and keys:
                yield keys, sets
                keys, sets = [], []
            last = name
            if not keys or keys[-1] != key:
                keys.append(key)
                sets.append(tokens[k].values.to_numpy(zero_copy_only=False).view(np.uint64).copy())
    if keys:
        yield keys, sets


def _members(n: int, wanted: Membership):
    """Whole token sets of the rows whose key may be wanted, a task's copies once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh = _Fresh()
        for batch in batches:
            for block in blocks(batch.column("text"), lower=True):
                row, token = token_sets(block, n)
                bounds = np.searchsorted(row, np.arange(block.rows + 1))
                full = np.flatnonzero(np.diff(bounds))
                keys = _keys(token, bounds[full])
                keep = wanted.has(keys[:, 0])
                full, keys = full[keep], keys[keep]
                keep = fresh.among(keys)
                full, keys = full[keep], keys[keep]
                pieces = [token[bounds[k]:bounds[k + 1]] for k in full.tolist()]
                flat = np.concatenate(pieces) if pieces else token[:0]
                yield pa.RecordBatch.from_arrays(
                    [_binary(keys), _lists(pa.array(flat.view(np.int64)), np.diff(bounds)[full])], ["key", "tokens"])
    return run


def _blocked(rows: DataFrame, share) -> DataFrame:
    """Rows of a group in ``share`` blocks; (i, j) are the two blocks that meet. One block: (0, 0)."""
    own = F.pmod(F.xxhash64("key", F.lit(7)), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), (F.col("parts") - 1).cast("int")))
    one = rows.withColumn("parts", share).withColumn("own", own).withColumn("other", other)
    return one.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("own", "other", "parts")


def _linked(rows: DataFrame, n: int, percent: int, bucket_rows: int, block_tokens: int, often: int = 16) -> tuple[DataFrame, DataFrame | None]:
    """Rows (rid, sig, size, key) of ``keyed`` documents, and (key, component) of the sets that link with another one."""
    with owned_cuts(rows.sparkSession):  # what only serves to find the clusters goes when they are found
        frequent, many = counted_cut(rows.select("text").mapInArrow(_repeated(n), "token long, n long").groupBy("token")
                                     .agg(F.sum("n").alias("n")).where(F.col("n") >= often))
        last = Membership(frequent, "token", many, 1 << 26) if many else None
        whole = cut_lineage(rows.mapInArrow(
            _describe(n, percent, last), "rid long, sig long, size long, key binary, least array<long>, map binary"))
        described = cut_lineage(whole.select("rid", "sig", "size", "key"), outlive=True)
        kept = whole.where(F.size("least") > 0).withColumn("half", _half("key"))
        tokens = kept.select(F.explode("least").alias("token"), "size", F.col("half").alias("key"))
        tokens = tokens.repartition("token").sortWithinPartitions("token", "size", "key")
        shared = tokens.mapInArrow(_shared(percent), "bucket long, key long, need long").groupBy("bucket", "key").agg(
            F.count("*").alias("has"), F.max("need").alias("need"))
        shared = cut_lineage(shared.where("has >= need").select("bucket", F.col("key").alias("half")))
        maps = kept.groupBy("key", "half").agg(F.first(F.struct("size", F.col("least")[0].alias("lead"), "map")).alias("m"))
        maps = maps.select("key", "half", "m.*")
        crowded = shared.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > bucket_rows)
        buckets = shared.join(maps, "half").join(crowded, "bucket", "left")
        buckets = _blocked(buckets, F.ceil(F.coalesce("n", F.lit(1)) / bucket_rows))
        buckets = buckets.select("bucket", "i", "j", "lead", "size", "key", "map").repartition("bucket", "i", "j").sortWithinPartitions(
            "bucket", "i", "j", F.length("map"), "lead", "size", "key")
        coarse = components(buckets.mapInArrow(_coarse(percent), "a binary, b binary"), "a", "b")
        clusters, many = counted_cut(coarse.select(F.col("node").alias("key"), F.col("component").alias("cluster")), outlive=True)
    if not many:
        return described, None
    wanted = Membership(clusters.select(_half("key").alias("k")), "k", many, per_key=64)
    sets = rows.select("text").mapInArrow(_members(n, wanted), "key binary, tokens array<long>")
    sizes = described.where("size > 0").groupBy("key").agg(F.first("size").alias("size"))
    placed = clusters.join(sizes, "key")
    total = placed.groupBy("cluster").agg(F.sum("size").alias("total"))
    members = _blocked(sets.join(placed.join(total, "cluster"), "key"), F.ceil(F.col("total") / block_tokens))
    members = members.select("cluster", "i", "j", "key", "tokens").repartition("cluster", "i", "j").sortWithinPartitions(
        "cluster", "i", "j", F.ceil(F.log2(F.size("tokens"))), F.col("tokens")[0], F.size("tokens"), "key")
    with owned_cuts(rows.sparkSession):
        parts = cut_lineage(components(members.mapInArrow(_exact(percent), "a binary, b binary"), "a", "b"), outlive=True)
    return described, parts.withColumnRenamed("node", "key")


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, percent: int = 85,
                       bucket_rows: int = 4096, block_tokens: int = 4_000_000) -> DataFrame:
    """(id, n_shingles, component_id) for every row."""
    described, parts = _linked(keyed(docs, id_col, text_col), n, percent, bucket_rows, block_tokens)
    nodes = described.where("size > 0").groupBy("key").agg(F.min("rid").alias("low"))
    if parts is not None:
        nodes = nodes.join(parts, "key", "left").withColumn("component", F.coalesce("component", "key"))
        lowest = nodes.groupBy("component").agg(F.min("low").alias("least"))
        nodes = nodes.join(lowest, "component").select("key", F.col("least").alias("low"))
    out = described.select("rid", "size", "key").join(nodes, "key", "left")
    low = F.when(F.col("size") > 0, F.col("low")).otherwise(F.col("rid"))
    return out.select(_id("rid").alias(id_col), F.col("size").alias("n_shingles"), F.when(low != NO_ID, low).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80,
                bucket_rows: int = 4096, block_tokens: int = 4_000_000) -> DataFrame:
    """The documents, all their columns, without the near copies: of each component the row with the smallest id stays.

    Rows with the empty set link with nothing and all stay.
    """
    described, parts = _linked(keyed(docs, id_col, text_col), n, percent, bucket_rows, block_tokens)
    sets = described.select("rid", "sig", "size", "key")
    if parts is not None:
        sets = sets.join(parts, "key", "left").withColumn("key", F.coalesce("component", "key"))
    first = sets.where("size > 0").groupBy("key").agg(F.min(F.struct("rid", "sig")).alias("s")).select("s.rid", "s.sig", F.lit(True).alias("only"))
    stay = first.unionByName(sets.where("size = 0").select("rid", "sig", F.lit(False).alias("only")).distinct())
    names = [f"c{k}" for k in range(len(docs.columns))]
    rows = docs.toDF(*names)
    at = {c: F.col(names[docs.columns.index(c)]) for c in (id_col, text_col)}
    rows = rows.withColumn("rid", F.coalesce(at[id_col].cast("long"), F.lit(NO_ID))).withColumn(
        "sig", F.xxhash64(F.coalesce(at[text_col].cast("string"), F.lit(""))))
    kept = rows.join(stay, ["rid", "sig"])
    # rows that repeat the id and text of a kept one are copies too
    single = kept.where("only").dropDuplicates(["rid", "sig"])
    return single.unionByName(kept.where("NOT only")).select(*names).toDF(*docs.columns)


def _id(name: str):
    return F.when(F.col(name) != NO_ID, F.col(name))


def _half(name: str):
    """The first eight bytes of a key as a number."""
    return F.expr(f"CAST(conv(hex(substring({name}, 1, 8)), 16, -10) AS BIGINT)")
