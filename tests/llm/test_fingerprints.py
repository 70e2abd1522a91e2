"""Fingerprints: a plain version of each part, the neighbours, and what an edit does to the likeness."""

import hashlib
import random

import numpy as np
import pytest

from furrow.llm import fingerprints as C


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(row[k + 1], new[k]))
        row = new
    return row[-1]


def plain_fingerprint(data):
    """Byte by byte."""
    if not data:
        return "3::"
    def rolled(i):
        h = 0
        for k in range(min(7, i + 1)):
            h += (data[i - k] + 1) * pow(0x01000193, k, 1 << 32)
        h &= 0xFFFFFFFF
        h ^= h >> 15
        h = h * 0x2C1B3C6D & 0xFFFFFFFF
        return h ^ h >> 13
    h = [rolled(i) for i in range(len(data))]
    block = 3
    while block * 64 < len(data):
        block *= 2
    floor = block
    while floor > 3 and floor > block // 16:
        floor //= 2
    while block > floor and sum(x % block == block - 1 for x in h) < 31:
        block //= 2
    def letters(size, most):
        out, chunk, made = [], [], 0
        for i, x in enumerate(h):
            chunk.append(data[i])
            if x % size == size - 1 and made < most - 1:
                out.append(bytes(chunk))
                chunk, made = [], made + 1
        if chunk:
            out.append(bytes(chunk))
        return [hashlib.md5(c).digest() for c in out]
    return block, letters(block, 64), letters(2 * block, 32)


@pytest.mark.parametrize("size", [1, 2, 5, 11, 64, 191, 193, 800, 5000, 40_000])
def test_chunks(size):
    rng = random.Random(size)
    data = bytes(rng.choice(b"abc de") for _ in range(size))
    block, one, two = C.fingerprint(data).split(":")
    want = plain_fingerprint(data)
    assert int(block) == want[0] and len(one) == len(want[1]) and len(two) == len(want[2])
    for letters, chunks in ((one, want[1]), (two, want[2])):
        by = {}
        assert all(by.setdefault(c, x) == x for c, x in zip(chunks, letters, strict=True))


def test_distance():
    rng = random.Random(1)
    for _ in range(300):
        a = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 64)))
        b = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 64)))
        x, y = C._short_runs(a), C._short_runs(b)
        run = min(4, max(1, min(len(x), len(y)) // 2))
        common = any(x[k:k + run] in y for k in range(len(x) - run + 1))
        assert C._near(a, b) == (2 * lcs(x, y) / (len(x) + len(y)) if common else 0.0)


def test_edits_are_near_and_others_far():
    rng = random.Random(7)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(150, 900))) for _ in range(60)]
    near = [C.likeness(C.fingerprint(a.encode()), C.fingerprint(C.edit(a, b).encode())) for a, b in zip(texts, texts[1:])]
    far = [C.likeness(C.fingerprint(a.encode()), C.fingerprint(b.encode())) for a, b in zip(texts, texts[1:])]
    assert min(near) > 0.5 and sum(near) / len(near) > 0.7 and max(far) < 0.4
    assert C.likeness("3::", "3::") == 1.0 and C.likeness("3::", "3:A:A") == 0.0 and C.likeness("3:A:A", "96:A:A") == 0.0


def brute(rows):
    big = 1 << 63
    rows = sorted(((big if i is None else i), t or "") for i, t in rows)
    out = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        e = C.edit(t, after)
        f = [C.fingerprint(x.encode()) for x in (t, e, after)]
        out.append((None if i == big else i, len(t), e, f[0], f[1], C.likeness(f[0], f[1]), C.likeness(f[0], f[2])))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [0, 1, 2, 9, 300])
def test_next_documents(spark, size):
    rng = random.Random(size)
    rows = [(rng.randrange(-5, 3 * size) if rng.random() < .9 else None,
             None if rng.random() < .05 else "".join(rng.choice("aé 中b😀") for _ in range(rng.randrange(0, 60)))) for _ in range(size)]
    docs = spark.createDataFrame([(i, t, "b") for i, t in rows], "doc_id long, text string, bucket string").repartition(5)
    assert sorted(map(tuple, C.edited_likeness(docs).collect()), key=str) == brute(rows)


def test_registered_query(spark, sf_dir):
    from furrow.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = sorted(((i, n, hashlib.sha256(e.encode()).hexdigest(), f, g, x, y) for i, n, e, f, g, x, y in brute(rows)))
    got = QUERIES["op8_document_fingerprints"](spark, sf_dir)
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    assert sorted(map(tuple, got.collect())) == want
    plain = C.fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert sorted(map(tuple, plain.collect())) == sorted((i, f) for i, _, _, f, *_ in want)


@pytest.mark.parametrize("period", [10, 80, 200, 1000])
def test_repeated_passages_halve_to_the_least_size(period):
    rng = random.Random(period)
    for _ in range(10):
        line = bytes(rng.choice(b"abcdefgh ijkl") for _ in range(period))
        data = line * (100_000 // period)
        block, one, two = C.fingerprint(data).split(":")
        hashes = C._rolled(np.frombuffer(data, dtype=np.uint8)).tolist()
        want = 3
        while want * 64 < len(data):
            want *= 2
        while want > 3 and sum(x % want == want - 1 for x in hashes) < 31:
            want //= 2
        ends = [k + 1 for k, x in enumerate(hashes) if x % want == want - 1][:63]
        chunks = [data[a:b] for a, b in zip([0, *ends], [*ends, len(data)]) if a < b]
        assert int(block) == want and len(one) == len(chunks) and len(ends) >= 31
        by = {}
        assert all(by.setdefault(c, x) == x for c, x in zip(chunks, one, strict=True))
        assert C.likeness(f"{block}:{one}:{two}", C.fingerprint(data[:75_000] + b"another" + data[75_007:])) > 0.5
