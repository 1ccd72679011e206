"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Every stage works on all that the one before kept and, but for the last, returns the columns of documents. What a stage
left in the shared folder is deleted when the next one begins, as its result is written by then.

Edge cases, in every stage: an empty table gives an empty table; further columns pass through, also with the names of
results; null and empty texts, repeated rows and null ids as each stage says.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm import decontaminate, language_id, mixing, ngram_join, token_output
from logweave.llm.common import discard, live, release, table, written
from logweave.llm.queries import END_ID, TARGETS, domain_labels, vocabulary


#: Bytes of chunks that a worker keeps in the last stage: less than in the query alone, as workers carry other stages too.
KEPT_BYTES = 40_000_000

#: Bytes of rows that are sent to a Python worker at once: both the executor and the worker hold them.
BATCH_BYTES = 8 << 20

#: Scratch of the stage before.
_LEFT: set[str] = set()


def stage(work):
    """A stage that first deletes what the one before left, whose result has been written and read again as ``docs``."""

    @wraps(work)
    def tidy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(_LEFT, docs)
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        before = live()
        out = work(spark, docs, sf_dir)
        _LEFT.clear()
        _LEFT.update(live() - before)
        return out

    return tidy


@stage
def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents that have a known language stay; ``und`` and undecided ones go.

    Null and empty texts and texts without letters are ``und`` and go; repeated rows are judged alike; a null id is
    judged by its text; of languages that tie the first in sorted order counts.
    """
    names = docs.columns
    model = language_id.fit(docs)
    found = language_id.identify(docs, model, "_lang_found", "_lang_score")
    return found.where((F.col("_lang_found") != language_id.UNKNOWN) & (F.col("_lang_score") >= 0.5)).select(*names)


@stage
def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join (five words, 0.8): of each component the smallest id stays.

    Null ids stay, as no link can name them; texts without words link with nothing and stay; rows of one id stay or go
    together.
    """
    names = docs.columns
    drop = ngram_join.jaccard_components(docs, n=5, percent=80).where("component_id != doc_id").select(F.col("doc_id").alias("_dropped")).distinct()
    return docs.join(drop, docs["doc_id"].cast("long") == drop["_dropped"], "left_anti").select(*names)


@stage
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents with a window of any benchmark item go.

    Rows of one id stay or go together, and so do the rows with a null id; texts without words stay.
    """
    names = docs.columns
    hit = decontaminate.find_matches(docs, table(spark, sf_dir, "benchmark")).where(F.col("place").isNotNull()).select(F.col("doc_id").alias("_hit")).distinct()
    return docs.join(hit, docs["doc_id"].cast("long").eqNullSafe(hit["_hit"]), "left_anti").select(*names)


@stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to the target token shares: each document appears as often as its rate says.

    Rows of one id, null included, have one rate; texts without words are rated by the prior.
    """
    rated = mixing.mix(docs.select("doc_id", "text"), domain_labels(spark, sf_dir), TARGETS)
    return mixing.apply_copies(docs, rated)


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-ID output: the files are written, and each document is returned as they give it back.

    Null and empty texts give the end id alone; null ids come first; repeated rows are all written, in order of text.
    """
    release(_LEFT, docs)
    _LEFT.clear()
    return token_output.read_back(token_output.write_shards(docs, vocabulary(), END_ID, kept_bytes=KEPT_BYTES))


STAGES = [
    ("language id", keep_languages),
    ("n-gram jaccard join", keep_one_of_near),
    ("benchmark decontamination", decontaminated),
    ("mixing to target weights", mixed),
    ("token-id output", tokenised),
]

#: Near-duplicate components, the classifier and the fitted rates are iterative: no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, work) in enumerate(STAGES):
        docs = work(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}")
            if k:
                discard(given)
            given = docs
    return docs
