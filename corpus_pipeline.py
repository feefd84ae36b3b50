"""A corpus cleaned and packed in five stages. Each takes (spark, docs, sf_dir) and works on all rows
that its predecessor kept; what it returns is written as Parquet and read again for the next.

Defined cases, for each stage: an empty table gives an empty one; repeated rows are judged alike, and the join
keeps all rows of the id that stays; a null text is an empty one to the classifier, the decontamination and the packing, and
has no lines and no shingles; a null id is a document of its own to the line dedup, and links with nothing; of equal
texts the least id stays; columns of other names, also those of an operator's own, come through all stages but the last."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillstream.llm import decontaminate, line_dedup, nbsvm, ngram_join, packing
from tillstream.llm.tables import forget, kept, table, text_batches


def _beside(docs: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What an operator that adds columns of its own makes of docs, with the columns of docs, whatever their names."""
    other = {c: f"column_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    back = {new: c for c, new in other.items()}
    out = step(docs.withColumnsRenamed(other)).select(*(other.get(c, c) for c in docs.columns))
    return out.withColumnsRenamed(back)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    text_batches(spark)
    model = nbsvm.fit(docs, table(spark, sf_dir, "labels"))
    return _beside(docs, lambda rows: nbsvm.score(rows, model).where("predicted = 1"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the later copies of repeated line runs; n_chars follows the text."""
    out = _beside(docs, line_dedup.dedup_lines)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more)."""
    text_batches(spark)
    return ngram_join.one_of_each(docs, 5, 4, 5)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    text_batches(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their windows."""
    text_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", decontaminated),
    ("packing", packed),
]

#: No SQL for the trained classifier and the tokenizer; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, old = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if old is not None:
            forget(old)
        old = docs
    return STAGES[-1][1](spark, docs, sf_dir)
