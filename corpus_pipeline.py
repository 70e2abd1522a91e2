"""The corpus pipeline: each stage calls one operator of ``furrow.llm``; its result is written and read again by the next.

Edge cases, the same in every stage: a null text counts as empty (and stays null up to the last stage); empty texts are scored like others, link with nothing, cover
nothing, hold no secret and have no tokens. Null ids are allowed; among near copies they count as the largest. Rows that repeat id
and text are copies of each other, so the similarity stage leaves one of them. Among equally small ids the smaller text
hash stays. Texts of any length are read whole. An empty table gives an empty result with the same columns. Columns
beyond those of ``documents`` pass through all stages but the last under any name.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm.bpe_trie import encode_documents
from furrow.llm.common import fresh, table
from furrow.llm.decontaminate import without_contaminated
from furrow.llm.ngram_join import one_of_each
from furrow.llm.quality import fit_quality, learnable, score_quality
from furrow.llm.secrets import redact, scan_secrets
from furrow.session import ensure_checkpoint_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least 0.5."""
    model = fit_quality(docs, learnable(table(spark, sf_dir, "labels")))
    score = fresh("score", docs.columns)
    return score_quality(docs, model, score_col=score).where(F.col(score) >= 0.5).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by five-word shingles with a similarity of 0.8 or more."""
    return one_of_each(docs, n=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item by half or more."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    spans = fresh("spans", docs.columns)
    clean = redact(F.col("text"), F.col(spans))
    return scan_secrets(docs, spans_col=spans).withColumn("text", clean).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers) and their number for every document."""
    return encode_documents(docs, keep=("lang", "source", "n_chars")).drop("decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("BPE encoding and decoding", tokens),
]
# No SQL: the classifier, the tiling and the encoder have none; tests/llm/test_pipeline.py has the brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is Parquet in the shared checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
