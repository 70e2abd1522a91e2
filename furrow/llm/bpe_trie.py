"""Byte-pair encoding by a prefix-sharing trie, and its decoding.

The encoding of a text by merges is fixed locally: a row of tokens is the encoding exactly if every two neighbours stay apart
when they are encoded alone. So each prefix of a word has one *last token*, and the encoding of a prefix is that of a shorter
prefix plus its last token. The distinct words of a slice of the batch form a trie (words that came more than once in an
earlier slice of the task are known already, up to ``KEPT_BYTES``); walking it depth first (in sorted order)
keeps one last token per depth, so what words share as a prefix is computed once. The end of a word is a symbol of its own.

Two tokens stay apart if no merge crosses their boundary at any time: going back in time, the parts next to the boundary are
undone latest merge first, and no pair of parts that were next to each other may have an earlier merge than what ended them.

Edge cases: null text is empty (no ids, empty decoded text); strings of added tokens in a text become these tokens, as the
tokenizers library does; letters beyond Latin-1 are normalised and split by the library's own components, everything else here.
"""

from __future__ import annotations

import json
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 8 << 20
KEPT_BYTES = 48 << 20
OUT_CHARS = 1 << 20


def byte_symbols() -> list[str]:
    """The visible character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in table:
            table[b] = chr(extra)
            extra += 1
    return [table[b] for b in range(256)]


class TrieEncoder:
    """Encoder and decoder of one tokenizer file (byte-level BPE with a word-end suffix, lower-casing, white space dropped)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or spec["decoder"] is not None:
            raise ValueError("this tokenizer is of another kind")
        self.path, self.end, self.vocab = path, model["end_of_word_suffix"] or "", model["vocab"]
        self.token = {i: t for t, i in self.vocab.items()}
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        self.split = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")).findall
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.token |= {i: t for t, i in self.added.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")").split if self.added else None
        self.beyond = regex.compile("[^\x00-\xff]").search
        self.simple = regex.compile(r"[!-~]+").fullmatch
        self.symbols = {b: s for b, s in enumerate(byte_symbols())}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank, self.parts, self.made = {}, {}, {}
        for r, (a, b) in enumerate(pairs):
            whole = self.vocab[a + b]
            a, b = self.vocab[a], self.vocab[b]
            if (a, b) not in self.rank:
                self.rank[a, b] = r
                self.parts.setdefault(whole, (a, b))
                self.made.setdefault(whole, r)
        self.apart: dict[tuple[int, int], bool] = {}
        self.back = {s: b for b, s in self.symbols.items()}
        self.kept: dict[str, tuple[bytes, str]] = {}
        self.kept_bytes = 0
        good = {i for i in self.token if i not in self.parts}
        for whole, (a, b) in sorted(self.parts.items(), key=lambda x: self.made[x[0]]):
            if a in good and b in good and self._apart(a, b, self.made[whole]):
                good.add(whole)
        self.inner = {t: i for t, i in self.vocab.items() if i in good and not (self.end and t.endswith(self.end))}
        self.final = {t[:len(t) - len(self.end)]: i for t, i in self.vocab.items() if i in good and t.endswith(self.end)} if self.end else self.inner
        self.tails = {t[k:] for t in (*self.inner, *self.final) for k in range(len(t))}
        self.length = {i: len(t) for t, i in self.inner.items()}

    def _apart(self, left: int, right: int, before: int = 1 << 62) -> bool:
        """No merge crosses the boundary of two tokens earlier than ``before``."""
        rank, parts, made = self.rank, self.parts, self.made
        up_left = up_right = before
        while True:
            r = rank.get((left, right))
            # of equal pairs the leftmost merges first: the left part's own merge wins a tie, the right part's does not
            if r is not None and r < up_left and r <= up_right and r < before:
                return False
            a, b = made.get(left, -1), made.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a >= b:
                left, up_left = parts[left][1], a
            else:
                right, up_right = parts[right][0], b

    def _last(self, word: str, end: int, states: list[int], table: dict[str, int]) -> int:
        """The last token of the first ``end`` characters, given those of the shorter prefixes."""
        tails, apart = self.tails, self.apart
        fits, start = [], end - 1
        while start >= 0:
            piece = word[start:end]
            if piece not in tails:
                break
            token = table.get(piece)
            if token is not None:
                fits.append((start, token))
            start -= 1
        for start, token in reversed(fits):
            if start == 0:
                return token
            pair = (states[start], token)
            ok = apart.get(pair)
            if ok is None:
                ok = apart[pair] = self._apart(*pair)
            if ok:
                return token
        raise ValueError(f"no encoding of {word[:end]!r}")

    def encode_words(self, words: list[str]) -> dict[str, list[int]]:
        """Ids of distinct words, by depth-first order of their trie."""
        out, states, before = {}, [-1], ""
        if len(self.apart) > 300_000:
            self.apart.clear()
        length, last = self.length, self._last
        for word, key in sorted((self._visible(w), w) for w in words):
            shared, most = 0, min(len(word) - 1, len(states) - 1)
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del states[shared + 1:]
            for end in range(shared + 1, len(word)):
                states.append(last(word, end, states, self.inner))
            token = last(word, len(word), states, self.final)
            ids = [token]
            at = len(word) - (len(self.token[token]) - len(self.end))
            while at > 0:
                token = states[at]
                ids.append(token)
                at -= length[token]
            ids.reverse()
            out[key] = ids
            before = word
        return out

    def _visible(self, word: str) -> str:
        return word if self.simple(word) else "".join(map(self.symbols.__getitem__, word.encode()))

    @property
    def library(self):
        if not hasattr(self, "_library"):
            from tokenizers import Tokenizer
            self._library = Tokenizer.from_file(self.path)
        return self._library

    def words(self, text: str) -> list:
        """Words in order; an id stands for an added token."""
        out = []
        for piece in self.cut(text) if self.cut else [text]:
            if piece in self.added:
                out.append(self.added[piece])
            elif self.beyond(piece):
                norm = self.library.normalizer.normalize_str(piece)
                out += [bytes(map(self.back.__getitem__, w)).decode() for w, _ in self.library.pre_tokenizer.pre_tokenize_str(norm)]
            else:
                out += self.split(unicodedata.normalize("NFC", piece).lower())
        return out

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, int, str]]:
        """Per text: ids as little-endian unsigned 32-bit integers, their number, and the decoded text."""
        known: dict = {}  # one object for each distinct word: a slice has many more words than distinct ones
        rows = [[known.setdefault(w, w) for w in self.words(t)] for t in texts]
        often = Counter()
        for row in rows:
            often.update(row)
        kept = self.kept
        ids = self.encode_words([w for w in known if w not in kept and not isinstance(w, int)])
        packed, plain = {}, {}
        for w in known:
            if isinstance(w, int):
                packed[w], plain[w] = pack("<I", w), self.token[w]
            elif w in kept:
                packed[w], plain[w] = kept[w]
            else:
                x = ids[w]
                packed[w], plain[w] = both = pack(f"<{len(x)}I", *x), self.decode(x)
                if often[w] > 1 and self.kept_bytes < KEPT_BYTES:
                    kept[w] = both
                    self.kept_bytes += 250 + len(w) + len(both[0]) + len(both[1])
        del ids, known, often
        for row in rows:
            data = b"".join(map(packed.__getitem__, row))
            yield data, len(data) // 4, " ".join(map(plain.__getitem__, row))

    def forget(self) -> None:
        """Drop what was kept from slice to slice."""
        self.kept.clear()
        self.apart.clear()
        self.kept_bytes = 0

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by spaces: the file names no decoder, so the library does the same."""
        return " ".join(map(self.token.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(path: str) -> TrieEncoder:
    """One encoder per worker process and file."""
    return TrieEncoder(path)


def _encode(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        made = encoder(name if "/" in name else public_tokenizers.path(name))
        try:
            for batch in batches:
                column, first = batch.column("text"), 0
                sizes = pc.binary_length(column).to_pylist()
                while first < len(sizes):
                    last, size = first, 0
                    while last < len(sizes) and (last == first or size + sizes[last] <= SLICE_BYTES):
                        size += sizes[last]
                        last += 1
                    rows, begin, chars = [], first, 0
                    for k, row in enumerate(made.encode(column.slice(first, last - first).to_pylist()), first):
                        rows.append(row)
                        chars += len(row[2])
                        if chars > OUT_CHARS or k == last - 1:
                            yield pa.RecordBatch.from_arrays(
                                [*batch.slice(begin, k + 1 - begin).drop_columns(["text"]).columns, pa.array([r[0] for r in rows], pa.binary()),
                                 pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())],
                                [*(n for n in batch.schema.names if n != "text"), "ids", "n_tokens", "decoded"])
                            rows, begin, chars = [], k + 1, 0
                    first = last
        finally:  # the worker lives on
            made.forget()
            pa.default_memory_pool().release_unused()
    return run


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json",
                     keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, columns to keep, ids, n_tokens, decoded) of every row; ``tokenizer`` is a path or a file name of the tokenizer package.

    ``ids`` holds little-endian unsigned 32-bit integers. One map pass, no shuffle.
    """
    kept = [id_col, *keep]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(*(F.col(c).alias(f"c{k}") for k, c in enumerate(kept)), text.alias("text"))
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes[:-1])
    return rows.mapInArrow(_encode(tokenizer), f"{schema}, ids binary, n_tokens long, decoded string").toDF(*kept, "ids", "n_tokens", "decoded")
