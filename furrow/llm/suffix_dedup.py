"""Removal of repeated byte strings by sorted suffixes (deep-shallow sorting).

Every ``width``-byte string of a text is a suffix that counts up to that depth. Equal ones lie side by side in the order of
suffixes; the one of the smallest document and start stays, the others go.

Plan: (1) each window has a minimiser, the ``gram``-byte run of the least hash in it; neighbouring windows with the same
one are a stretch. One map pass counts the minimisers; windows of a minimiser that comes once cannot repeat. (2) The other
stretches travel as bytes to the bucket of their minimiser, where equal windows meet. In a bucket equal stretches are one
string; the suffixes of the distinct strings are sorted by multikey quicksort, eight bytes a key, down to ``shallow`` bytes,
and a blind trie orders each group that is still tied. (3) The removed ranges join the documents that have any.

A minimiser with more than ``hot`` stretches would overfill a bucket. Its stretches are aggregated by a 128-bit digest (partial
sums before the shuffle); only the first of equal ones gives its windows, which are aggregated by digest in the same way.

Edge cases: null text is empty; texts of fewer than ``width`` bytes stay whole. A null id counts as the largest. Rows that agree
in id and text have the same result and remove nothing from each other; rows of one id with different texts are ordered by a
hash of the text. Texts are cut into overlapping pieces of ``PIECE`` windows, so that no text is too long. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import NO_ID, Membership, keyed
from furrow.llm.words import _buffer, mix, slide_min, strings
from furrow.session import counted_cut, cut_lineage

PIECE, SLICE = 1 << 17, 256  # blocks of this size stay in a core's cache
_PLACE = np.uint64(24)  # bits of a position inside a block, which is far below 16 MB
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
_RANGES = "rid long, sig long, lo int, hi int"


class Block:
    """Bytes of some pieces of texts: ``raw``, and for each window start ``at`` its row and its offset in the row's text."""

    def __init__(self, raw: bytes, lengths: np.ndarray, rows: np.ndarray, begins: np.ndarray, width: int):
        self.raw = raw
        ends = np.cumsum(lengths)
        windows = np.maximum(lengths - width + 1, 0)
        piece = np.repeat(np.arange(len(lengths)), windows)
        inside = np.arange(len(piece)) - np.repeat(np.cumsum(windows) - windows, windows)
        self.at = (ends - lengths)[piece] + inside
        self.row, self.offset = rows[piece], begins[piece] + inside


def blocks(column: pa.Array, width: int) -> Iterator[Block]:
    """The texts in pieces of at most ``PIECE`` windows, as many a block as make ``PIECE`` bytes; each window is in one block."""
    data, offsets = _buffer(strings(column))
    parts, lengths, rows, begins, size = [], [], [], [], 0
    for row, (low, high) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        for begin in range(low, max(high - width + 1, low), PIECE):
            end = min(high, begin + PIECE + width - 1)
            parts.append(data[begin:end])
            lengths.append(end - begin)
            rows.append(row)
            begins.append(begin - low)
            size += end - begin
            if size >= PIECE:
                yield Block(np.concatenate(parts).tobytes(), np.array(lengths), np.array(rows), np.array(begins), width)
                parts, lengths, rows, begins, size = [], [], [], [], 0
    if parts:
        yield Block(np.concatenate(parts).tobytes(), np.array(lengths), np.array(rows), np.array(begins), width)


def _grams(raw: bytes, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes (a multiple of eight) at each position."""
    count = len(raw) - gram + 1
    words = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    total = np.zeros(count, dtype=np.uint64)
    for k in range(gram // 8):
        total += words[8 * k:8 * k + count] * np.uint64((_FACTORS[k % 3] + 2 * k) & 0xFFFFFFFFFFFFFFFF)
    return mix(total)


def stretches(block: Block, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each stretch: index of its first window, number of windows, minimiser, and whether its minimiser comes again in it."""
    at = block.at
    if not len(at):
        return at, at, at.astype(np.uint64), at.astype(bool)
    hashes = _grams(block.raw, gram)
    placed = (hashes >> _PLACE << _PLACE) | np.arange(len(hashes), dtype=np.uint64)
    least = slide_min(placed, width - gram + 1)[at]
    next_to = (at[1:] == at[:-1] + 1) & (block.row[1:] == block.row[:-1])
    moved = np.flatnonzero(next_to & (least[1:] != least[:-1]) & ((least[1:] ^ least[:-1]) >> _PLACE == 0)) + 1
    place = np.uint64((1 << int(_PLACE)) - 1)
    moved = moved[hashes[least[moved] & place] == hashes[least[moved - 1] & place]]
    joined = next_to & (least[1:] == least[:-1])
    joined[moved - 1] = True
    first = np.flatnonzero(np.append(True, ~joined))
    again = np.zeros(len(first), dtype=bool)
    again[np.searchsorted(first, moved, side="right") - 1] = True
    minimiser = hashes[least[first] & place]
    return first, np.diff(np.append(first, len(at))), minimiser, again


def _counts(width: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [stretches(block, width, gram)[2:] for block in blocks(batch.column("text"), width)]
            if found:
                minimiser, again = (np.concatenate(x) for x in zip(*found, strict=True))
                # one that comes again in its stretch counts twice
                value, n = np.unique(np.concatenate([minimiser, minimiser[again]]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(n)], ["m", "n"])
    return run


def _pack(width: int, gram: int, live: Membership, hot: Membership | None, want_hot: bool):
    """Stretches of live minimisers as bytes: those of the hot ones with a digest, or the others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, sig = batch.column("rid").to_numpy(), batch.column("sig").to_numpy()
            for block in blocks(batch.column("text"), width):
                first, count, minimiser, again = stretches(block, width, gram)
                keep = live.has(minimiser)
                if hot is not None:
                    keep &= hot.has(minimiser) == want_hot
                first, count, minimiser, again = first[keep], count[keep], minimiser[keep], again[keep]
                begin, raw, row = block.at[first], block.raw, block.row[first]
                packed = [raw[a:b] for a, b in zip(begin.tolist(), (begin + count + width - 1).tolist(), strict=True)]
                columns = [pa.array(minimiser.view(np.int64)), pa.array(rid[row]), pa.array(sig[row]),
                           pa.array(block.offset[first].astype(np.int32)), pa.array(again), pa.array(packed, pa.binary())]
                names = ["m", "rid", "sig", "at", "again", "packed"]
                if want_hot:
                    columns.append(pa.array([blake2b(p, digest_size=16).digest() for p in packed], pa.binary()))
                    names.append("digest")
                yield pa.RecordBatch.from_arrays(columns, names)
    return run


def blind_trie(texts: list[bytes]) -> list[list[int]]:
    """Indices of the texts (of one length) in byte order, equal ones together.

    A node holds the depth at which its texts part and a child for each byte there; a leaf holds equal texts. A text goes down by
    the branching bytes alone, is compared with the leaf it meets, and enters where they part.
    """
    width = len(texts[0])
    # a leaf is (width, text, indices), a node [depth, {byte: child}]
    root: list | tuple = (width, texts[0], [0])
    for k in range(1, len(texts)):
        text, node = texts[k], root
        while node[0] < width:
            kids = node[1]
            node = kids.get(text[node[0]]) or next(iter(kids.values()))
        other = node[1]
        if text == other:
            node[2].append(k)
            continue
        part = width - ((int.from_bytes(text) ^ int.from_bytes(other)).bit_length() + 7) // 8
        leaf, above, node = (width, text, [k]), None, root
        while node[0] < part:
            above, node = node, node[1][text[node[0]]]
        if node[0] == part:
            node[1][text[part]] = leaf
            continue
        fork = [part, {other[part]: node, text[part]: leaf}]
        if above is None:
            root = fork
        else:
            above[1][text[above[0]]] = fork
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node[0] == width:
            out.append(node[2])
        else:
            stack.extend(node[1][byte] for byte in sorted(node[1], reverse=True))
    return out


def sorted_suffixes(raw: bytes, at: np.ndarray, width: int, shallow: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the ``width``-byte strings that start at ``at``, and a mark where one differs from the one before."""
    words = np.ndarray((max(len(raw) - 7, 0),), ">u8", raw, strides=(1,))
    order = np.arange(len(at))
    new = np.zeros(len(at), dtype=bool)
    new[:1] = True
    tied = np.arange(len(at) if len(at) > 1 else 0)  # places of the order whose neighbours are equal so far
    group = np.zeros(len(tied), dtype=np.int64)
    depth = 0
    while len(tied) and depth < min(shallow, width - 7):
        key = words[at[order[tied]] + depth].astype(np.uint64)
        by = np.lexsort((key, group)) if depth else np.argsort(key)
        order[tied] = order[tied][by]
        key, group = key[by], group[by]
        parts = np.ones(len(tied), dtype=bool)
        parts[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        new[tied[parts]] = True
        left = ~parts
        left[:-1] |= ~parts[1:]
        tied, group = tied[left], np.cumsum(parts)[left]
        depth += 8
    if len(tied):
        begins = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        starts = at[order].tolist()
        for low, high in zip(tied[begins].tolist(), (tied[np.append(begins[1:], len(tied)) - 1] + 1).tolist(), strict=True):
            texts = [raw[a:a + width] for a in starts[low:high]]
            if high - low == 2 and texts[0] == texts[1]:
                continue
            leaves = blind_trie(texts)
            if len(leaves) > 1:
                order[low:high] = order[low:high][[k for leaf in leaves for k in leaf]]
                new[low + np.cumsum([0, *map(len, leaves[:-1])])] = True
    return order, new


def _ranges(rid: np.ndarray, sig: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rid), pa.array(sig), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))],
                                      ["rid", "sig", "lo", "hi"])


def _runs(rid, sig, at, row, offset, width: int) -> tuple[np.ndarray, ...]:
    """Ranges of removed windows, given by their row and offset in that order: windows that follow each other are one range."""
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (offset[1:] != offset[:-1] + 1)
    begin = np.flatnonzero(new)
    last = np.append(begin[1:], len(row)) - 1 if len(row) else begin
    return rid[row[begin]], sig[row[begin]], at[row[begin]] + offset[begin], at[row[begin]] + offset[last] + width


def _sort_bucket(width: int, shallow: int):
    def run(bucket: pa.Table) -> pa.Table:
        rid, sig, m = (bucket[c].to_numpy() for c in ("rid", "sig", "m"))
        at, again = bucket["at"].to_numpy().astype(np.int64), bucket["again"].to_numpy(zero_copy_only=False)
        packed = bucket["packed"].combine_chunks()
        packed = packed.chunk(0) if isinstance(packed, pa.ChunkedArray) else packed
        size = np.diff(np.frombuffer(packed.buffers()[1], dtype=np.int32)[packed.offset:packed.offset + len(packed) + 1])
        string = packed.dictionary_encode().indices.to_numpy()
        # occurrences in order of (document, start); the first of equal stretches stays
        order = np.lexsort((at, sig, rid))
        doc = np.empty(len(order), dtype=np.int64)
        doc[order] = np.cumsum(np.append(0, (rid[order][1:] != rid[order][:-1]) | (sig[order][1:] != sig[order][:-1])))
        key = doc << 32 | at
        first = np.full(string.max() + 1, -1, dtype=np.int64)
        first[string[order[::-1]]] = order[::-1]
        later = key != key[first[string]]
        out = [_ranges(rid[later], sig[later], at[later], at[later] + size[later])]
        # windows of the distinct strings that can repeat
        _, of, several = np.unique(m[first], return_inverse=True, return_counts=True)
        wanted = np.sort(first[(several[of] > 1) | again[first]])
        if len(wanted):
            count = size[wanted] - width + 1
            row = np.repeat(wanted, count)
            offset = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            texts = packed.take(pa.array(wanted))
            place = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset:texts.offset + len(wanted)]
            raw = texts.buffers()[2].to_pybytes()
            ranked, new = sorted_suffixes(raw, np.repeat(place, count) + offset, width, shallow)
            own = key[row] + offset
            least = np.minimum.reduceat(own[ranked], np.flatnonzero(new))[np.cumsum(new) - 1]
            gone = np.empty(len(row), dtype=bool)
            gone[ranked] = own[ranked] > least
            out.append(_ranges(*_runs(rid, sig, at, row[gone], offset[gone], width)))
        return pa.Table.from_batches(out)
    return run


def _window_digests(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, SLICE):
                part = batch.slice(low, SLICE)
                texts = part.column("packed").to_pylist()
                count = np.array([len(t) - width + 1 for t in texts])
                digests = [blake2b(t[k:k + width], digest_size=16).digest() for t in texts for k in range(len(t) - width + 1)]
                row = np.repeat(np.arange(len(texts)), count)
                at = part.column("at").to_numpy()[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digests, pa.binary()), pa.array(part.column("rid").to_numpy()[row]),
                     pa.array(part.column("sig").to_numpy()[row]), pa.array(at.astype(np.int32))], ["digest", "rid", "sig", "at"])
    return run


def _later(rows: DataFrame) -> DataFrame:
    """Rows with the digest of another row that comes earlier by (rid, sig, at)."""
    place = F.struct("rid", "sig", "at")
    least = rows.groupBy("digest").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low < high")
    return rows.join(least.select("digest", "low"), "digest").where(place > F.col("low"))


def repeated_ranges(rows: DataFrame, width: int = 100, gram: int = 32, shallow: int = 32, hot: int = 20_000) -> DataFrame:
    """(rid, sig, lo, hi): byte ranges of ``keyed`` documents covered by a ``width``-byte string that also starts earlier."""
    spark = rows.sparkSession
    live, many = counted_cut(rows.select("text").mapInArrow(_counts(width, gram), "m long, n long")
                             .groupBy("m").agg(F.sum("n").alias("n")).where("n > 1"))
    members = Membership(live, "m", many)
    heavy_count, light = live.agg(F.count_if(F.col("n") > hot), F.coalesce(F.sum(F.when(F.col("n") <= hot, F.col("n"))), F.lit(0))).first()
    heavy = Membership(live.where(F.col("n") > hot), "m", heavy_count) if heavy_count else None
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-light // hot))
    columns = "m long, rid long, sig long, at int, again boolean, packed binary"
    found = (rows.mapInArrow(_pack(width, gram, members, heavy, False), columns)
             .withColumn("bucket", F.pmod(F.xxhash64("m"), F.lit(buckets))).groupBy("bucket")
             .applyInArrow(_sort_bucket(width, shallow), _RANGES))
    if heavy is not None:
        seen = cut_lineage(rows.mapInArrow(_pack(width, gram, members, heavy, True), f"{columns}, digest binary"))
        distinct = seen.groupBy("digest").agg(F.min(F.struct("rid", "sig", "at")).alias("p"), F.first("packed").alias("packed"))
        windows = distinct.select("p.*", "packed").mapInArrow(_window_digests(width), "digest binary, rid long, sig long, at int")
        span = (F.col("at") + F.col("size")).cast("int").alias("hi")
        found = found.unionByName(_later(seen.select("digest", "rid", "sig", "at", F.octet_length("packed").alias("size")))
                                  .select("rid", "sig", F.col("at").alias("lo"), span))
        found = found.unionByName(_later(cut_lineage(windows)).select(
            "rid", "sig", F.col("at").alias("lo"), (F.col("at") + width).cast("int").alias("hi")))
    return found


def _strip_row(text: bytes, ranges: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """Removed bytes, removed runs and what is left."""
    parts, at, runs = [], 0, 0
    for low, high in sorted(ranges):
        if low > at or not runs:
            parts.append(text[at:low])
            runs += 1
        at = max(at, high)
    kept = b"".join(parts) + text[at:]
    return len(text) - len(kept), runs, kept


def _results(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The result rows, some documents at a time; without a column ``ranges`` nothing goes."""
    for low in range(0, batch.num_rows, SLICE):
        part = batch.slice(low, SLICE)
        texts = [t.encode() for t in part.column("text").to_pylist()]
        ranges = part.column("ranges").to_pylist() if "ranges" in part.schema.names else [None] * len(texts)
        done = [_strip_row(t, [(r["lo"], r["hi"]) for r in rs or ()]) for t, rs in zip(texts, ranges, strict=True)]
        gone, runs, kept = zip(*done, strict=True)
        yield pa.RecordBatch.from_arrays(
            [part.column("rid"), part.column("sig"), pa.array([len(t) for t in texts], pa.int64()), pa.array(gone, pa.int64()),
             pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], ["rid", "sig", "n_bytes", "n_removed", "n_spans", "kept"])


def _has_ranges(members: Membership, batch: pa.RecordBatch) -> pa.Array:
    return pa.array(members.has(batch.column("doc").to_numpy().view(np.uint64)))


def _whole(members: Membership):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _results(batch.filter(pc.invert(_has_ranges(members, batch))))
    return run


def _touched(members: Membership):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(_has_ranges(members, batch)).drop_columns(["doc"])
    return run


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from _results(batch)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 100, gram: int = 32,
                   shallow: int = 32, hot: int = 20_000) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept (the bytes left, which need not be whole characters)."""
    rows = keyed(docs, id_col, text_col)
    ranges, _ = counted_cut(repeated_ranges(rows, width, gram, shallow, hot)
                            .groupBy("rid", "sig").agg(F.collect_list(F.struct("lo", "hi")).alias("ranges")))
    documents = ranges.select(F.xxhash64("rid", "sig").alias("doc"))
    members = Membership(documents, "doc", documents.count())
    marked = rows.withColumn("doc", F.xxhash64("rid", "sig"))
    schema = "rid long, sig long, n_bytes long, n_removed long, n_spans long, kept binary"
    some = marked.mapInArrow(_touched(members), "rid long, sig long, text string").join(ranges, ["rid", "sig"], "left")
    out = marked.mapInArrow(_whole(members), schema).unionByName(some.mapInArrow(_strip, schema))
    return out.select(F.when(F.col("rid") != NO_ID, F.col("rid")).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept")
