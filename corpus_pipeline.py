"""The corpus pipeline: quality, near-duplicates, decontamination, personal data, mixing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of
``documents``.  Stage by stage: documents scored below the threshold go; one document of each class of
near-duplicates stays; documents that hold a benchmark item go; personal data in texts turn into marks
(``n_chars`` follows); the mix says how often each document is taken, and leaves out those never taken;
its result holds all columns of ``documents``, masked texts too, and its own (``mix_...`` where names clash).

Edge cases: null and empty texts are scored as such by the classifier, those that it keeps are one class of copies of
which one stays, leak nothing, hold no personal data (a null stays null) and have size 0, so that the mix takes them
in complete epochs only.  A null doc_id is a document like any other, without a label; a null source is a source.  Rows with
equal texts are copies: the smallest doc_id stays (a null only if there is no other), of equal ids the least row in all
columns, whatever the order of the input.  Very long texts go through every stage whole.  Ties of the mix's keys go by doc_id and size.
Extra columns pass through, whatever their names (names that begin with two underscores are taken).  An empty ``documents`` gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import decontaminate, mixing, neardup, pii, quality
from gridloom.llm.store import cut


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine gives at least the threshold."""
    machine = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))
    return quality.score(docs, machine, name="__score").filter(F.col("__score") >= quality.THRESHOLD).drop("__score")


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return neardup.keep_one(docs).select(docs.columns)


def decontaminate_docs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data masked."""
    out = pii.mask(docs, pii.find_patterns(docs))
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, whole, with their sizes, targets, words taken and copies."""
    rows = docs.withColumn("__row", F.monotonically_increasing_id())  # ``docs`` is stored, so ids stay
    taken = mixing.mix_sources(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=("__row",)).filter("copies > 0")
    own = [F.col(c).alias(c if c == "__row" or c not in docs.columns else f"mix_{c}") for c in taken.columns]
    return rows.join(taken.select(*own), "__row").drop("__row")


STAGES = [
    ("quality_classifier", classify),
    ("near_duplicates", deduplicate),
    ("benchmark_decontamination", decontaminate_docs),
    ("personal_data", hide_personal_data),
    ("source_mix", mix),
]
#: SQL can express neither the classifier nor the near-duplicate search
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
