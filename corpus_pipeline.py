"""A training corpus from raw documents, stage by stage.

Each stage takes all rows its predecessor kept and returns the columns of documents;
the last returns token ids. Between stages the rows are stored as Parquet in the
shared folder, so that a lost executor repeats work of one stage only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventskim.llm import bpe, mixing, near_texts, quality, queries, repeats
from eventskim.llm.common import row_hash, table
from eventskim.session import ship_package, work_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: No SQL can train dictionaries or draw the mix; tests compare with plain Python.
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the classifier's threshold.

    NULL is scored as empty text. Rows are scored one by one, so repeated rows and ids
    stay or go together with their texts. An empty table gives no row.
    """
    ship_package(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs.select(*COLUMNS), model, into="__score").filter(F.col("__score") >= quality.THRESHOLD).drop("__score")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of the smallest doc_id, NULL last.

    Texts are near copies whose sets of five-word shingles have four fifths in common, and
    those that such pairs join. Of several rows with the smallest id one stays, by a hash
    of its columns; equal rows leave one. An empty table gives no row.
    """
    ship_package(spark)
    docs = docs.select(*COLUMNS)
    key = row_hash(*COLUMNS)
    found = near_texts.near_text_groups(docs.select("doc_id", key.alias("__key"), "text"))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "__key")
    first = found.groupBy("root").agg(F.min(order).alias("first")).select(F.col("first.__key").alias("__first"))
    kept = docs.withColumn("__key", key).join(first, F.col("__key") == F.col("__first"), "left_semi")
    one = kept.groupBy("__key").agg(F.any_value(F.struct(*COLUMNS)).alias("row"))
    return one.select("row.*")


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that repeat earlier ones; others keep their text as it is.

    Earlier is a smaller doc_id, NULL last, or the same document; rows of one id share
    its positions. A text of which nothing is left stays as an empty one, NULL as NULL. An
    empty table gives no row.
    """
    ship_package(spark)
    left = repeats.remove_repeats(docs.select(*COLUMNS))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    chars = F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars"))
    return left.select("doc_id", text.alias("text"), "lang", "source", chars.alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    Rows are told apart by all their columns, so ids may be NULL or repeat; equal rows
    are rounded one by one. An empty table gives no row.
    """
    docs = docs.select(*COLUMNS)
    key = row_hash(*COLUMNS)
    copies = mixing.mixed_copies(docs.withColumn("__key", key), F.col("__key"))
    wanted = copies.groupBy("key").agg(F.sum(F.col("copies") * F.col("n")).cast("long").alias("__n"))
    # Equal rows are one here, and that before they are moved.
    distinct = docs.groupBy(key.alias("key")).agg(F.any_value(F.struct(*COLUMNS)).alias("__row"))
    taken = distinct.join(wanted, "key").select("__row.*", "__n")
    return mixing.repeated(taken, "__n").select(*COLUMNS)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, packed as little-endian 32-bit integers, and their number.

    NULL and empty texts have none. Every row stands for itself; an empty table gives no row.
    """
    ship_package(spark)
    encoded = bpe.encode(docs.select("doc_id", "source", "text"), queries.vocabulary())
    return encoded.select("doc_id", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", drop_near_copies),
    ("substring dedup", drop_repeats),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding", encode_texts),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; the rows of the last one."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        path = work_dir(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
