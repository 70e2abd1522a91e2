"""Registered queries of the subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm.bpe_trie import encode_documents
from furrow.llm.common import table
from furrow.llm.decontaminate import contaminated
from furrow.llm.fingerprints import edited_likeness
from furrow.llm.hard_negatives import hard_negatives
from furrow.llm.html_text import extract_pages
from furrow.llm.ngram_join import similar_components
from furrow.llm.quality import fit_quality, held_out, learnable, score_quality
from furrow.llm.secrets import BASE, scan_secrets
from furrow.llm.shards import shard_documents
from furrow.llm.substring_dedup import remove_repeats
from furrow.llm.suffix_dedup import remove_repeats as remove_repeated_bytes
from furrow.llm.vector_codes import encode_vectors, with_label_error
from furrow.llm.warc import archive_folder, read_records, write_archives

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]):
    QUERIES[function.__name__] = function
    return function


@query
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = archive_folder(spark)
    index = write_archives(table(spark, sf_dir, "pages"), folder)
    records = read_records(index, folder, payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, learnable(table(spark, sf_dir, "labels")))
    scored = score_quality(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*(r.kind for r in BASE)))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(r.kind) for r in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


@query
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), shards=16)


@query
def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = extract_pages(table(spark, sf_dir, "pages"))
    return text.withColumn("n_chars", F.char_length("text").cast("long"))


@query
def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op7_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_documents(table(spark, sf_dir, "documents"), tokenizer="word_bpe_49k.json")
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = edited_likeness(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
                      "near_edited", "near_next")


@query
def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents"), n=4, percent=85)


@query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op11_vector_code_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_label_error(encode_vectors(table(spark, sf_dir, "embeddings")))


@query
def op12_hard_negative_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", shifted)
    return hard_negatives(rows, is_anchor=F.col("vec_id") % 100 == 0)


@query
def op13_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeated_bytes(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

# SQL of the operators that SQL can express.

ORACLES["op1_warc"] = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS payload_digest FROM p),
w AS (SELECT payload_digest AS same, max(page_id) AS last FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest HAVING count(*) > 1),
r AS (SELECT d.*, CASE WHEN page_id IS NULL OR page_id < last THEN last END AS refers_to
      FROM d LEFT JOIN w ON payload_bytes >= 1000 AND payload_digest = same)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM r
"""

ORACLES["op9_ngram_jaccard_join"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_have FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM b JOIN n k ON k.doc_id = a JOIN n m ON m.doc_id = b WHERE 100 * both_have >= 85 * (k.n + m.n - both_have)),
r AS (SELECT doc_id AS root, doc_id AS node FROM w UNION SELECT r.root, e.b FROM r JOIN e ON r.node = e.a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id FROM w LEFT JOIN n ON w.doc_id = n.doc_id
JOIN (SELECT node, min(root) AS component_id FROM r GROUP BY node) c ON c.node = w.doc_id
"""

ORACLES["op10_substring_dedup"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50),
k AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM p),
m AS (SELECT h, min(doc_id) AS low FROM k GROUP BY h HAVING min(doc_id) < max(doc_id)),
c AS (SELECT doc_id, i FROM k JOIN m ON k.h = m.h WHERE low < doc_id),
g AS (SELECT DISTINCT doc_id, i + j AS pos FROM c, (SELECT unnest(range(50)) AS j) t),
a AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w),
l AS (SELECT a.doc_id, string_agg(word, ' ' ORDER BY a.pos) AS kept, count(*) AS n_left FROM a LEFT JOIN g ON a.doc_id = g.doc_id AND a.pos = g.pos WHERE g.pos IS NULL GROUP BY a.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n_left, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN l ON w.doc_id = l.doc_id
"""

ORACLES["op13_suffix_array_dedup"] = r"""
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
o AS (SELECT doc_id, h, unnest(range(0, CAST(length(h) / 2 AS BIGINT) - 99, 200)) AS since FROM t),
q AS (SELECT doc_id, since, substr(h, 2 * since + 1, 598) AS part FROM o),
p AS (SELECT doc_id, since, part, unnest(range(0, CAST(length(part) / 2 AS BIGINT) - 99)) AS j FROM q),
k AS (SELECT doc_id, since + j AS i, md5(substr(part, 2 * j + 1, 200)) AS d FROM p),
m AS (SELECT d, min(doc_id * 4294967296 + i) AS low FROM k GROUP BY d HAVING count(*) > 1),
g AS (SELECT doc_id, i FROM k JOIN m ON k.d = m.d WHERE doc_id * 4294967296 + i > low),
s AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS b FROM g),
r AS (SELECT doc_id, i, sum(b) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s),
x AS (SELECT doc_id, run, min(i) AS lo, max(i) + 100 AS hi FROM r GROUP BY doc_id, run),
y AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS since FROM x),
z AS (SELECT y.doc_id, sum(hi - lo) AS gone, count(*) AS runs, max(hi) AS last,
             string_agg(substr(h, 2 * since + 1, 2 * (lo - since)), '' ORDER BY lo) AS left_hex FROM y JOIN t ON y.doc_id = t.doc_id GROUP BY y.doc_id)
SELECT t.doc_id, CAST(length(h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(runs, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(left_hex, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM t LEFT JOIN z ON t.doc_id = z.doc_id
"""


def _codes_sql(rounds: int = 4) -> str:
    """The codebook rounds as a chain of tables: p has the parts' components, b<r> the codebooks, a<r> the nearest entries."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT vec_id, part, min(d * 256 + entry) AS m FROM (
  SELECT p.vec_id, p.part, b.entry, sum((p.x - b.x) * (p.x - b.x)) AS d FROM p JOIN b{r} b ON p.part = b.part AND p.pos = b.pos
  GROUP BY p.vec_id, p.part, b.entry) t GROUP BY vec_id, part)""")
        if r < rounds:
            steps.append(f"""b{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.pos, coalesce(n.x, b.x) AS x FROM b{r} b LEFT JOIN (
  SELECT p.part, a.m % 256 AS entry, p.pos, CAST(floor(CAST(sum(p.x) AS DOUBLE) / count(*)) AS BIGINT) AS x
  FROM p JOIN a{r} a ON p.vec_id = a.vec_id AND p.part = a.part GROUP BY p.part, a.m % 256, p.pos) n
  ON b.part = n.part AND b.entry = n.entry AND b.pos = n.pos)""")
    return f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v,
  row_number() OVER (ORDER BY vec_id) - 1 AS place FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT vec_id, place, len(v) AS n, unnest(v) AS x, unnest(range(0, len(v))) AS i FROM k),
p AS MATERIALIZED (SELECT vec_id, place, CAST(floor(i * 4.0 / n) AS BIGINT) AS part, CAST(i - floor(i * 4.0 / n) * n / 4 AS BIGINT) AS pos, CAST(x AS BIGINT) AS x FROM u),
b0 AS MATERIALIZED (SELECT part, place AS entry, pos, x FROM p WHERE place < 256),
{", ".join(steps)},
c AS (SELECT vec_id, string_agg(printf('%02x', CAST(m % 256 AS INTEGER)), '' ORDER BY part) AS code, CAST(sum((m - m % 256) / 256) AS BIGINT) AS error
      FROM a{rounds} GROUP BY vec_id),
h AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM b{rounds})
SELECT c.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, h.codebooks_sha256
FROM c JOIN k ON c.vec_id = k.vec_id CROSS JOIN h
"""


ORACLES["op11_vector_code_compression"] = _codes_sql()

ORACLES["op12_hard_negative_mining"] = r"""
WITH k AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS MATERIALIZED (SELECT vec_id, label, unnest(v) AS x, unnest(range(0, len(v))) AS i FROM k),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(sum(a.x * b.x) AS BIGINT) AS score
  FROM u a JOIN u b ON a.i = b.i WHERE a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id GROUP BY a.vec_id, b.vec_id, a.label, b.label),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.anchor_id, positive_id, id AS negative_id, positive_score, score AS negative_score,
  row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
