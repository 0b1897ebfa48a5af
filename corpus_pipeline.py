"""The corpus pipeline: language ID, line dedup, n-gram Jaccard join, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir), with docs in the columns of ``documents``, works on all of docs
and returns these columns; the last returns packed pieces. A stage's result is written as Parquet and
read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm.common import cut, maybe_broadcast
from kinfold.llm.language_id import fit_language_id, identify
from kinfold.llm.line_dedup import line_dedup
from kinfold.llm.mixing import poisson_mix
from kinfold.llm.ngram_join import ngram_jaccard_join
from kinfold.llm.packing import pack
from kinfold.llm.queries import SOURCE_WEIGHTS, held_out

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A predicted language of this score or more stands against the language a document came with.
SURE = 0.9


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (``und``: null or empty texts and those without letters) go; the others get the predicted one.

    A prediction below SURE, mostly of a text of a few words, only fills a null lang. A low score is no reason to
    reject: short clean texts have one. Equal texts get equal predictions; repeated rows and null ids stay as
    they are; an empty table gives an empty one; other columns are dropped, whatever their names.
    """
    docs = docs.select(*COLUMNS)
    model = fit_language_id(docs.where(~held_out("doc_id")).select("text", "lang"))
    named = identify(docs, model).where("lang_pred <> 'und'")
    lang = F.when(F.col("lang").isNull() | (F.col("score") >= SURE), F.col("lang_pred")).otherwise(F.col("lang"))
    return named.withColumn("lang", lang).select(*COLUMNS)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs go, and documents of which nothing but blank lines is left by that.

    n_chars of a shortened text is its new length. Null texts stay; rows of equal id and text are one document
    and fare alike; null ids come first; an empty table gives an empty one; other columns are dropped.
    """
    done = line_dedup(docs.select(*COLUMNS))
    left = done.where((F.col("n_deleted") == 0) | F.col("text").rlike(r"\S"))
    return left.withColumn("n_chars", F.when(F.col("n_deleted") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at a Jaccard similarity of 0.75, the one with the smallest id stays; null ids come last.

    Rows are named by id and text, so that an id over several texts, or none, is as many documents, which stand
    or fall each on its own; of several texts under the smallest id one stays. Rows with an equal id and text
    are one. Null and empty texts are linked with nothing. An empty table gives an empty one; other columns are dropped.
    """
    name = F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("digest"), F.col("text").isNull().alias("no_text"))
    named = docs.select(*COLUMNS, name.alias("_name"))
    members = ngram_jaccard_join(named.select("_name", "text"), id_col="_name")
    gone = cut(members.where(F.col("_name") != F.col("component_id")).select(F.col("_name").alias("_gone")).distinct(), "gone")
    stay = named.join(maybe_broadcast(gone, gone.count()), F.col("_name") == F.col("_gone"), "left_anti").select(*COLUMNS)
    repeated = docs.groupBy("doc_id").count().where("count > 1")
    return stay if repeated.isEmpty() else stay.dropDuplicates(["doc_id", "text"])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their sources' rates have it, in a global shuffle by a hash; a document may get no copy.

    Null is a source of its own; rows of one id get one count; null texts weigh nothing; an empty table gives
    an empty one; other columns are dropped.
    """
    return poisson_mix(docs.select(*COLUMNS), SOURCE_WEIGHTS).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document with its bin; see pack. Copies are packed each; null and empty texts are in no bin; other columns are not read."""
    return pack(docs.select(*COLUMNS))


STAGES = [
    ("language_id", known_language),
    ("line_dedup", without_repeated_lines),
    ("ngram_jaccard_join", one_of_each_group),
    ("poisson_mixing", mixed),
    ("best_fit_packing", packed),
]

#: Linear support vector machines and sequential packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
