"""Secret scans with a trigram inverted index.

From each rule's pattern a Boolean query over trigrams is derived: alternatives of sets of trigrams, one of which every match
must contain. The index has postings (trigram, ids) for the trigrams that some rule asks for; the postings of a set are
intersected, and only the candidates of a rule are verified with its pattern. A rule without mandatory trigrams scans all texts.

Trigrams are bytes of the UTF-8 text with A-Z as a-z, so that one index serves rules with and without case. Candidates go to the
verifying tasks as bitmaps of bounded size (a false candidate is only verified in vain): texts are never shuffled.

Edge cases: null text is empty; ids may be null or repeat (postings of one id are candidates for all its rows).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm.common import NO_ID, Membership, fresh
from furrow.llm.words import _LOWER, _buffer, strings
from furrow.session import cut_lineage

Query = list[frozenset[bytes]]
_TRUE: Query = [frozenset()]
_MOST = 64


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` (leftmost, not overlapping) whose ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    flags: int = re.ASCII
    group: int = 0
    least: int = 0


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE, 2, 8),
    Rule("access", "AKIA[A-Z0-9]+", least=16),
    Rule("hex", "[0-9a-f]+", least=32),
)
RULES = (
    *BASE,
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=40),
)


def _grams(text: str) -> frozenset[bytes]:
    data = "".join(c.lower() if c.isascii() else c for c in text).encode()
    return frozenset(data[k:k + 3] for k in range(len(data) - 2))


def _least(query: Query) -> Query:
    """Without alternatives that another one implies."""
    small = sorted(set(query), key=len)
    return [q for k, q in enumerate(small) if not any(p <= q for p in small[:k])]


def _both(a: Query, b: Query) -> Query:
    """Conjunction; the weaker side is left out where the product would be long."""
    if len(a) * len(b) > _MOST:
        return min(a, b, key=lambda q: (min(map(len, q)) == 0, len(q)))
    return _least([x | y for x in a for y in b])


class _Walk:
    """Collects runs of exact strings through a parsed pattern and turns them into trigrams."""

    def __init__(self):
        self.exact, self.query = {""}, _TRUE

    def flush(self, after: Query = _TRUE) -> None:
        self.query = _both(_both(self.query, _least([_grams(x) for x in self.exact])), after)
        self.exact = {""}

    def extend(self, strings_: set[str]) -> None:
        if len(self.exact) * len(strings_) > _MOST:
            self.flush()
        if len(strings_) <= _MOST:
            self.exact = {a + b for a in self.exact for b in strings_}

    def walk(self, items) -> None:
        for op, value in items:
            if op is C.LITERAL:
                self.extend({chr(value)})
            elif op is C.IN and all(o in (C.LITERAL, C.RANGE) for o, _ in value):
                chars: set[str] = set()
                for o, v in value:
                    chars |= {chr(v)} if o is C.LITERAL else {chr(c) for c in range(v[0], min(v[1], v[0] + _MOST) + 1)}
                self.extend(chars) if len(chars) <= 8 else self.flush()
            elif op is C.SUBPATTERN:
                self.walk(value[-1])
            elif op is C.BRANCH:
                parts = [_derive(p) for p in value[1]]
                if all(e is not None for e, _ in parts):
                    self.extend(set().union(*(e for e, _ in parts)))
                else:
                    self.flush(_least([c for _, q in parts for c in q]))
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
                low, high, inner = value
                exact, query = _derive(inner)
                if (low, high) == (0, 1) and exact is not None:
                    self.extend(exact | {""})
                elif low == 0:
                    self.flush()
                elif exact is not None and low == high == 1:
                    self.extend(exact)
                else:
                    self.flush(query)
            elif op is C.AT:
                continue
            else:
                self.flush()


def _derive(items) -> tuple[set[str] | None, Query]:
    """The finite set of strings (None if it isn't one) and the query of a part of a pattern."""
    walk = _Walk()
    seen: list[int] = []
    flush = walk.flush
    walk.flush = lambda *a: (seen.append(1), flush(*a))[1]
    walk.walk(items)
    exact = None if seen else walk.exact
    flush()
    return exact, walk.query


def trigram_query(rule: Rule) -> Query | None:
    """Alternatives of trigram sets; None if some match may have none of them."""
    query = _derive(_parser.parse(rule.pattern, rule.flags))[1]
    return None if frozenset() in query else query


def _post(grams: list[bytes]):
    codes = [g[0] << 16 | g[1] << 8 | g[2] for g in grams]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << 24, dtype=np.uint16)
        table[codes] = np.arange(1, len(codes) + 1)
        for batch in batches:
            rid = batch.column("rid").to_numpy()
            data, offsets = _buffer(strings(batch.column("text")))
            found = []
            at, end = int(offsets[0]), int(offsets[-1])
            while at < end - 2:  # in pieces that overlap by two bytes
                part = _LOWER[data[at:min(end, at + (1 << 22) + 2)]].astype(np.uint32)
                which = table[part[:-2] << 16 | part[1:-1] << 8 | part[2:]]
                place = np.flatnonzero(which)
                row = np.searchsorted(offsets, place + at, side="right") - 1
                inside = place + at + 3 <= offsets[row + 1]
                found.append(np.unique(row[inside] << 16 | which[place[inside]].astype(np.int64)))
                at += 1 << 22
            pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)
            which, row = (pairs & 0xFFFF) - 1, pairs >> 16
            order = np.argsort(which, kind="stable")
            which, ids = which[order], rid[row[order]]
            named, begin = np.unique(which, return_index=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([grams[k] for k in named.tolist()], pa.binary()),
                 pa.ListArray.from_arrays(pa.array(np.append(begin, len(ids)).astype(np.int32)), pa.array(ids))], ["trigram", "ids"])
    return run


def trigram_index(docs: DataFrame, grams: list[bytes]) -> DataFrame:
    """Postings (trigram, ids) of (rid, text) rows for the given trigrams: a row of postings for each trigram and batch."""
    return cut_lineage(docs.mapInArrow(_post(grams), "trigram binary, ids array<long>"))


def candidates(index: DataFrame, queries: dict[int, Query]) -> DataFrame:
    """(rid, rules): the rules one of whose alternatives the postings of an id satisfy. One aggregation serves all rules."""
    wanted = sorted(set().union(*(g for q in queries.values() for g in q)))
    lists = index.where(F.col("trigram").isin(wanted)).select("trigram", F.explode("ids").alias("rid"))
    have = lists.groupBy("rid").agg(F.collect_set("trigram").alias("have"))

    def holds(query: Query):
        found = F.lit(False)
        for grams in query:
            found = found | (F.size(F.array_except(F.array(*map(F.lit, sorted(grams))), "have")) == 0)
        return found

    rules = F.array_compact(F.array(*[F.when(holds(q), F.lit(k)) for k, q in queries.items()]))
    return have.select("rid", rules.alias("rules")).where(F.size("rules") > 0)


def find_spans(text: str, rules: list[tuple[int, Rule, re.Pattern]]) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) by start, then by the order of the rules."""
    out = []
    for k, rule, pattern in rules:
        for m in pattern.finditer(text):
            low, high = m.span(rule.group)
            if high - low >= rule.least:
                out.append((m.start(), k, m.end(), rule.kind))
    return [(a, b, kind) for a, _, b, kind in sorted(out)]


def _verify(rules: tuple[Rule, ...], known: dict[int, Membership]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a run of one class needs its least length only: the matches stay the same and shorter runs are passed over faster
        made = [(k, r, re.compile(re.sub(r"^(\[[^\]]*\])\+$", rf"\1{{{max(1, r.least)},}}", r.pattern) if not r.group else r.pattern, r.flags))
                for k, r in enumerate(rules)]
        struct = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        for batch in batches:
            ids = batch.column("rid").to_numpy().view(np.uint64)
            asked = {k: known[k].has(ids) if k in known else np.ones(len(ids), dtype=bool) for k in range(len(rules))}
            spans = []
            for n, text in enumerate(batch.column("text")):
                found = find_spans(text.as_py(), [m for m in made if asked[m[0]][n]])
                spans.append([{"start": a, "end": b, "kind": kind} for a, b, kind in found])
            keep = [c for c in batch.schema.names if c not in ("rid", "text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(spans, struct)], [*keep, "spans"])
    return run


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES,
                 spans_col: str | None = None) -> DataFrame:
    """All columns of the documents and the spans: array of (start, end, kind) in code points, end exclusive.

    Their column is ``spans``, or ``spans_`` and so on where the documents have that name, unless ``spans_col`` names it.
    """
    spans_col = spans_col or fresh("spans", docs.columns)
    rid = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("rid")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    queries = {k: q for k, r in enumerate(rules) if (q := trigram_query(r)) is not None}
    known: dict[int, Membership] = {}
    if queries:
        index = trigram_index(docs.select(rid, text), sorted(set().union(*(g for q in queries.values() for g in q))))
        found = cut_lineage(candidates(index, queries))
        counts = found.agg(*[F.count_if(F.array_contains("rules", k)).alias(str(k)) for k in queries]).first()
        for k in queries:
            known[k] = Membership(found.where(F.array_contains("rules", k)), "rid", counts[str(k)], 1 << 26)
    names = [f"c{k}" for k in range(len(docs.columns))]
    rows = docs.toDF(*names)
    wide = rows.select(*names, F.coalesce(F.col(names[docs.columns.index(id_col)]).cast("long"), F.lit(NO_ID)).alias("rid"),
                       F.coalesce(F.col(names[docs.columns.index(text_col)]).cast("string"), F.lit("")).alias("text"))
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    spans = "array<struct<start: long, end: long, kind: string>>"
    out = wide.mapInArrow(_verify(rules, known), f"{schema}, spans {spans}")
    return out.toDF(*docs.columns, spans_col)


def redact(text, spans, mark: str = "[SECRET]"):
    """Column expression: the text with every span (overlapping ones as one) replaced by ``mark``."""
    state = "struct<out: string, at: long>"
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")).cast(state)

    def step(acc, s):
        fresh = F.struct(F.concat(acc["out"], F.expr("''"), F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark)).alias("out"),
                         s["end"].alias("at"))
        longer = F.struct(acc["out"].alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))
        return F.when(s["start"] >= acc["at"], fresh).otherwise(longer).cast(state)

    end = lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.lit(2147483647)))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, end))
