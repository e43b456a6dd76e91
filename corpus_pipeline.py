"""The training-data pipeline over ``documents``: stages of (name, function).

Each function takes (spark, docs, sf_dir); all but the last return the columns of ``documents``.
Extra columns of the input are not carried on. Null columns, empty tables and repeated rows have the
results that the operators' modules state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailsift.llm import common, language_id, minhash, mixing, packing, quality
from trailsift.llm.common import materialize, read_table
from trailsift.llm.queries import byte_bpe

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents whose language is less certain than this go.
MIN_LANGUAGE_SCORE = 0.4
#: More kept ids than this are joined by shuffle instead of broadcast (16 bytes each).
BROADCAST_IDS = 2_000_000
#: Bytes of one Arrow batch. The JVM and the worker hold each batch several times over, and the stages follow each
#: other on executors whose JVM keeps what it once took.
BATCH_BYTES = 4 << 20


def prepare(spark: SparkSession) -> None:
    """Settings of every stage."""
    common.prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; no letter or an unsure label: gone.

    Without any labelled document nothing can be judged and documents with letters stay.
    """
    prepare(spark)
    docs = docs.select(*COLUMNS)
    model = language_id.fit(docs, "text", "lang", F.xxhash64("doc_id"))
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = language_id.identify(docs, model, list(COLUMNS))
    return found.filter((F.col("lang_pred") != language_id.UNKNOWN)
                        & (F.col("score") >= MIN_LANGUAGE_SCORE)).select(*COLUMNS)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    prepare(spark)
    return quality.judge(docs.select(*COLUMNS), carry=COLUMNS).filter("kept").select("carried.*")


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8): that of the
    smallest id. Rows that repeat a kept id become one row; rows without an id stay."""
    prepare(spark)
    docs = docs.select(*COLUMNS)
    found = minhash.near_duplicates(docs, shingle=5, percent=80)
    kept = materialize(found.filter(F.col("kept") & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("__rows")), "pipeline-kept")
    small = kept.count() <= BROADCAST_IDS
    joined = docs.join(F.broadcast(kept) if small else kept, "doc_id")
    single = joined.filter(F.col("__rows") == 1).select(*COLUMNS)
    repeated = joined.filter(F.col("__rows") > 1).groupBy("doc_id").agg(
        F.min(F.struct("text", "lang", "source", "n_chars")).alias("row"))
    return single.unionByName(repeated.select("doc_id", "row.*")).unionByName(
        docs.filter(F.col("doc_id").isNull()))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Occurrences in training order: a document once per pass that the mix takes of it.

    The one document at a source's target is taken whole or not at all, whichever lands nearer the target.
    """
    prepare(spark)
    seen = mixing.mix(docs.select(*COLUMNS))
    return seen.filter(2 * F.col("mix_taken") >= F.col("mix.size")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all occurrences with their places in sequences of 2048 tokens."""
    prepare(spark)
    return packing.pack(docs.select("doc_id", "text"), byte_bpe(), 2048, release=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", known_language),
    ("quality", good_quality),
    ("near_duplicates", without_near_duplicates),
    ("mix", mixed),
    ("pack", packed),
]

#: Language identification and packing can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again."""
    prepare(spark)
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
