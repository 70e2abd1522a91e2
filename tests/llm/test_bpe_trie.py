"""Ids and decoded texts against the tokenizers library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from furrow.llm.bpe_trie import TrieEncoder, encode_documents

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return TrieEncoder(PATH)


def check(own, library, texts):
    want = library.encode_batch(texts, add_special_tokens=False)
    for text, (data, n, plain), w in zip(texts, own.encode(texts), want, strict=True):
        ids = np.frombuffer(data, dtype="<u4").tolist()
        assert ids == w.ids, text[:200]
        assert n == len(ids)
        assert plain == library.decode(ids, skip_special_tokens=False)


def test_random_texts(own, library):
    rng = random.Random(3)
    letters = ["abcdefghijklmnopqrstuvwxyz", "thea ni", "aaaaab", "ABCxyz 019 .,!?'\"-_", "éèàüßñç µªº²½¼ÀÉ\xa0\x85\xad",
               "".join(map(chr, range(256))), "Σσς İıK ſ ﬁ é  　 中文字 😀👍🏽 हिन्दी ١٢ Ⅷ", "<|endoftext|> <|startoftext|>'s 're "]
    texts = ["", " ", "<|endoftext|>", "a<|startoftext|>b<|ENDOFTEXT|>", "don't we'll I'd", "x" * 3000, "ab" * 2000]
    for _ in range(2500):
        a = rng.choice(letters)
        b = rng.choice(letters)
        texts.append("".join(rng.choice(a if rng.random() < .7 else b) for _ in range(rng.randrange(1, 60))))
    texts += [f"{rng.choice(['', 'a', ' '])}{x}{rng.choice(['', 'b', ' '])}" for x in letters[-1].split() for _ in range(5)]
    check(own, library, texts)


def test_every_token_as_a_text(own, library):
    tokens = sorted(library.get_vocab())
    check(own, library, [t.replace("</w>", " ") for t in tokens[::7]])


def test_documents(spark, sf_dir, library):
    from furrow.llm.queries import QUERIES

    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r for r in QUERIES["op7_bpe_trie"](spark, sf_dir).collect()}
    assert got.keys() == rows.keys()
    for i, text in rows.items():
        ids = library.encode(text, add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_nulls_repeats_and_extra_columns(spark):
    rows = [(1, None, "x"), (1, "", "y"), (None, "Hello", "z"), (None, "Hello", "z")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(((r.doc_id, r.n_tokens, r.decoded) for r in encode_documents(frame).collect()), key=str)
    assert got == [(1, 0, ""), (1, 0, ""), (None, 1, "hello</w>"), (None, 1, "hello</w>")]
    assert encode_documents(frame.limit(0)).collect() == []
