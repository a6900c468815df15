"""The corpus pipeline: stages over ``documents``, each an operator of millrace.llm.

Every stage takes what its predecessor kept and returns the columns of ``documents`` (the
last adds the token ids). Between stages the driver, or ``run``, writes Parquet and reads it;
a stage therefore begins by deleting the scratch tables of the stage before it in the same
thread and application.

Stages run in a session of their own, cloned from the caller's, whose readers take long texts in
small batches; the caller's settings stay as they are.

Defined results, beside those that each operator states: null and empty texts are never toxic
enough to go beyond what an empty text scores, are in no group, hold no personal data, and have
no tokens; a null source is a source of its own; ties go by id; of repeated rows one stays;
rows without an id stay; empty tables stay empty. Further columns pass through all stages,
whatever their names: those that an operator would add go under names of the stage's own
meanwhile.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bpe, ngram_join, pareto_mix, pii, toxicity
from millrace.llm.common import BATCH_ROWS, materialise, release, scope
from millrace.llm.queries import TOXIC_CATEGORIES, WORDS

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: What operators read; all other columns are one while they run.
READ = ("doc_id", "text", "source", "n_chars")


def _own(spark: SparkSession) -> SparkSession:
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    for k, v in BATCH_ROWS.items():
        own.conf.set(k, v)
    return own


def _moved(docs: DataFrame, spark: SparkSession) -> DataFrame:
    plan = docs._jdf.queryExecution().analyzed()
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, plan), spark)


def _stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Stage:
    """``f`` sees the columns of READ and ``rest``, and may add columns, of which only those of ``encode`` are kept."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        place = f"{spark.sparkContext.applicationId}-{threading.get_ident()}"
        release(spark, place)
        own = _own(spark)
        given = _moved(docs, own)
        rest = [c for c in given.columns if c.lower() not in READ]
        whole = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)]) if rest else F.lit(0)
        with scope(place):
            out = f(own, given.select(*READ, whole.alias("rest")), sf_dir)
        made = ["ids"] if f.__name__ == "encode" else []
        kept = [c for c in given.columns if c.lower() not in made]
        return out.select(*[F.col(f"rest.c{rest.index(c)}" if c in rest else c.lower()).alias(c) for c in kept], *made)

    return run


@_stage
def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain finds toxic go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    chain = toxicity.fit(docs, labels, TOXIC_CATEGORIES)
    return toxicity.predict(docs, chain).where(F.col("toxic") < chain.cuts["toxic"])


@_stage
def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 on five-word shingles, that with the smallest doc_id stays.

    Of rows equal in doc_id and text one stays; rows without doc_id stay.
    """
    return ngram_join.one_of_each(docs, num=80, den=100, n=5)


@_stage
def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each span of personal data is replaced by its kind in brackets; n_chars follows."""
    return pii.redact(pii.find(docs)).withColumn("n_chars", F.length("text").cast("long"))


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    sized = docs.withColumn("words", F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long"))
    return pareto_mix.repeated(pareto_mix.mix(sized, "words"))


@_stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, in ``ids``; a column of that name is replaced."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", reject_toxic),
    ("near-duplicates", keep_one_of_each_group),
    ("personal data", redact_personal_data),
    ("mixing", mix_sources),
    ("encoding", encode),
]
#: SQL can't express the fitted models of the first and third stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, "pipeline-" + name.replace(" ", "-"))
    return docs
