"""The corpus pipeline: language identification, near duplicates, benchmark decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; run() writes and rereads each result. The last stage
returns the mix: the documents taken, with the words taken of each (`taken`, repeats counted), their size, and their source's size
and target. Rows without a doc_id take part in every stage, repeated rows are told apart by a number of their own.

Columns beside those of documents are carried along, whatever their names; one named as a column of the mix (size, source_size, target,
taken) is told under that name with `_given` after it. An empty table gives no rows, as do documents without a text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waylark.llm.common import settled, staged, unused
from waylark.llm.decontaminate import clean
from waylark.llm.jaccard_join import keep_one
from waylark.llm.language_id import keep_identified, train_on
from waylark.llm.mixing import mix_sources


#: Rows of five numbers that are broadcast at most (20 MB); more are joined by a shuffle.
BROADCAST_MOST = 500_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no text, no letter, or no language with a fifth of it."""
    return keep_identified(docs, train_on(docs))


def duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked by a similarity of 0.8 or more, keeps that with the smallest doc_id."""
    return keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten words on end of a benchmark item."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixes the sources to their target weights; a document that the mix doesn't reach goes."""
    own = {"size", "source_size", "target", "taken"}
    for c in docs.columns:
        if c.lower() in own:
            docs = docs.withColumnRenamed(c, unused(docs, f"{c}_given")[0])
    (row,) = unused(docs, "row_number")
    docs = staged(docs.withColumn(row, F.monotonically_increasing_id()), "mix-input")  # once written, the numbers stay
    found = staged(mix_sources(docs, row_id=row).where("taken > 0").select(row, "size", "source_size", "target", "taken"), "mix-taken")
    return docs.join(F.broadcast(found) if found.count() <= BROADCAST_MOST else found, row).drop(row)


STAGES = [("language ID", language), ("n-gram Jaccard join", duplicates), ("benchmark decontamination", benchmark), ("mixing sources", mixture)]


@settled
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)  # written as the others, by settled


#: SQL can't express language identification.
ORACLE_SQL = None
