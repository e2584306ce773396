"""A training corpus from `documents`: judged, deduplicated, cleaned of secrets, mixed and encoded.

Each stage takes (spark, docs, sf_dir) and works on all rows of the stage before; what it decides takes effect.
All but the last return the columns of `documents`, whatever further columns come along.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventlens.llm import quality_machine, secret_forest
from eventlens.llm.common import stored, table
from eventlens.llm.curriculum import mixed
from eventlens.llm.near_copies import first_of_each
from eventlens.llm.pieces import encoded
from eventlens.llm.queries import PIECES

#: A model has no SQL form.
ORACLE_SQL = None


def _packed(docs: DataFrame) -> DataFrame:
    """The row as one column beside what the operators read, so that no name can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "doc_id", "text", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject. Null and empty texts are judged too; repeated rows share one verdict; an empty table stays empty."""
    model = quality_machine.learned(docs, table(spark, sf_dir, "labels"))
    return quality_machine.scored(_packed(docs), model, keep=("_row",)).where("predicted = 1").select("_row.*")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, word shingles of five and similarity 0.8: the one with the smallest doc_id.

    Rows that repeat id and text become one. Of a group without ids one row stays.
    """
    first = first_of_each(docs).select(F.col("doc_id").alias("_first"), F.col("tie").alias("_t"))
    rows = _packed(docs).withColumn("_tie", F.xxhash64("text"))
    kept = rows.join(first, F.col("doc_id").eqNullSafe(F.col("_first")) & (F.col("_tie") == F.col("_t")), "left_semi")
    return kept.groupBy("doc_id", "_tie").agg(F.first("_row").alias("_row")).select("_row.*")


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced by `[SECRET]`; n_chars follows. Rows without a secret, null texts among them, stay as they are."""
    made = secret_forest.scanned(_packed(docs), secret_forest.learned(docs), keep=("_row",))
    changed = F.size("secrets") > 0
    row = F.col("_row")
    return made.select(
        *[
            F.when(changed, F.col("clean_text")).otherwise(row["text"]).alias(c)
            if c == "text"
            else F.when(changed, F.length("clean_text").cast(docs.schema[c].dataType)).otherwise(row[c]).alias(c)
            if c == "n_chars"
            else row[f"`{c}`" if "." in c else c].alias(c)
            for c in docs.columns
        ]
    )


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes, in training order; null texts have size 0, and an empty table stays empty.

    The frame is dealt by ranges and sorted, so the number of a written file and a row's place in it give its position.
    """
    return mixed(docs)


def _in_written_order(docs: DataFrame) -> DataFrame:
    """doc_id, source and text of `docs` with `position`, the row's place (from 0) in the order in which the files were written.

    Spark packs files into tasks by size, so the order of rows as read is another one. A frame that isn't read from files is written first.
    """
    try:
        docs.select("_metadata.row_index")
    except AnalysisException:
        docs = stored(docs, "ordered")
    shard = F.coalesce(F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).try_cast("long"), F.lit(-1))
    rows = docs.select("doc_id", "source", "text", shard.alias("_shard"), F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    # a row for each file
    sizes = rows.groupBy("_shard", "_file").agg((F.max("_row") + 1).alias("n"))
    before = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("_shard", "_file").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(F.col("_file").alias("_name"), F.coalesce(before, F.lit(0)).alias("_start"))
    return rows.join(starts, F.col("_file") == F.col("_name")).select((F.col("_start") + F.col("_row")).alias("position"), "doc_id", "source", "text")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """position (from 0), doc_id, source, the number of tokens and the token ids of each text, sorted by position, the training order.

    The order is that in which `docs` was written. A null text has no token; repeated rows and null ids are rows like others. Texts are shorter than
    their ids, so they are dealt by position before they are encoded.
    """
    rows = _in_written_order(docs).repartitionByRange("position").sortWithinPartitions("position")
    return encoded(rows, PIECES, keep=("position", "doc_id", "source")).select("position", "doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", keep_one_of_each),
    ("secret scans", hide_secrets),
    ("mixing sources", mix_sources),
    ("SentencePiece encoding", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table; each result is written and read back before the next stage."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"stage{k}")
    return docs
