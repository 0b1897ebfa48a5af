"""Stand-ins for business records, derived from the driver tables: the same view as Spark frames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as tx


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _words(text: str):
    return F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


#: Raw names and addresses with the noise that normalisation is for: all words of a document in both.
RAW_SQL = r"""
wordy as (
  select doc_id, lang, source, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
raw as (
  select doc_id, lang, array_to_string(w, ' ') ||
      case doc_id % 3 when 0 then ' L.L.C.' when 1 then ' & Sons Co.' else '.com Pvt Ltd' end as name,
    'No' || lpad(doc_id::varchar, 6, '0') || array_to_string(list_slice(w, 1, 1), '') || ', ' || array_to_string(list_slice(w, 2, len(w)), ' ') || ' Street, ' ||
      case doc_id % 4 when 0 then 'New York' when 1 then 'West Bengal' when 2 then 'Jammu and Kashmir' else 'Texas' end || ' Apt ' || (doc_id % 97)::varchar as address
  from wordy)"""


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_id, name, address, country) for each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", _words("text").alias("w"))
    third = F.when(F.col("doc_id") % 3 == 0, " L.L.C.").when(F.col("doc_id") % 3 == 1, " & Sons Co.").otherwise(".com Pvt Ltd")
    state = F.when(F.col("doc_id") % 4 == 0, "New York").when(F.col("doc_id") % 4 == 1, "West Bengal").when(F.col("doc_id") % 4 == 2, "Jammu and Kashmir").otherwise("Texas")
    first, rest = F.array_join(F.slice("w", 1, 1), " "), F.array_join(F.slice("w", F.lit(2), F.greatest(F.size("w"), F.lit(1))), " ")
    address = F.concat(F.lit("No"), F.lpad(F.col("doc_id").cast("string"), 6, "0"), first, F.lit(", "), rest, F.lit(" Street, "), state, F.lit(" Apt "), (F.col("doc_id") % 97).cast("string"))
    return docs.select(F.col("doc_id").alias("entity_id"), F.concat(F.array_join("w", " "), third).alias("name"), address.alias("address"), F.col("lang").alias("country"))


#: Three sources: all parts as clean references, each of them twice with noise, and all suppliers, which have no
#: reference. The brand is the country. q counts S2 from 0, S3 from 1e9 and the suppliers from 2e9.
LINKAGE_SQL = r"""
ref as (
  select p_partkey as s1, lower(trim(p_brand)) as country, trim(regexp_replace(regexp_replace(lower(p_name), '[^\p{L}\p{N}\s]|_', ' ', 'g'), '\s+', ' ', 'g')) as name_key,
    p_partkey::varchar || ' ' || lower(p_type) || ' ' || p_size::varchar as addr_clean, lower(p_type) || ' ' || p_size::varchar as short_addr from part),
query as (
  select s1 as q, country, translate(name_key, 'oie', '013') as name_key, addr_clean, false as is_s3 from ref
  union all
  select s1 + 1000000000 as q, country, name_key, short_addr as addr_clean, true as is_s3 from ref
  union all
  select s_suppkey + 2000000000 as q, 'brand#' || (s_nationkey + 1)::varchar as country,
    trim(regexp_replace(regexp_replace(lower(s_name), '[^\p{L}\p{N}\s]|_', ' ', 'g'), '\s+', ' ', 'g')) as name_key, '' as addr_clean, s_acctbal < 5000 as is_s3 from supplier),
truth as (select q, q % 1000000000 as s1 from query where q < 2000000000)"""


def linkage(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(references, queries, truth) of the three-source view."""
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    space, clean = F.lit(" "), lambda c: tx.punct_to_space(F.lower(c))
    short = F.concat(F.lower("p_type"), space, F.col("p_size").cast("string"))
    base = part.select(
        F.col("p_partkey").alias("s1"), F.lower(F.trim("p_brand")).alias("country"), clean("p_name").alias("name_key"),
        F.concat(F.col("p_partkey").cast("string"), space, short).alias("addr_clean"), short.alias("short"),
    )
    two = base.select(F.col("s1").alias("q"), "country", F.translate("name_key", "oie", "013").alias("name_key"), "addr_clean", F.lit(False).alias("is_s3"))
    three = base.select((F.col("s1") + 1_000_000_000).alias("q"), "country", "name_key", F.col("short").alias("addr_clean"), F.lit(True).alias("is_s3"))
    brand = F.concat(F.lit("brand#"), (F.col("s_nationkey") + 1).cast("string"))
    others = supplier.select((F.col("s_suppkey") + 2_000_000_000).alias("q"), brand.alias("country"), clean("s_name").alias("name_key"), F.lit("").alias("addr_clean"), (F.col("s_acctbal") < 5000).alias("is_s3"))
    queries = two.unionByName(three).unionByName(others).withColumn("addr_empty", F.col("addr_clean") == "")
    truth = queries.where("q < 2000000000").select("q", F.pmod("q", F.lit(1_000_000_000)).alias("s1"))
    return base.drop("short"), queries, truth


#: Whole texts of all documents, each one reference and query.
WHOLE_SQL = r"""
ref as (
  select doc_id as s1, lang as country, trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}\s]|_', ' ', 'g'), '\s+', ' ', 'g')) as name_key from documents),
query as (select s1 as q, country, name_key from ref)"""


def whole_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s1, country, name_key) of all documents, with the whole text as the name."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("s1"), F.col("lang").alias("country"), tx.punct_to_space(F.lower("text")).alias("name_key"))


#: Letters of another script for some of a-z, several to one; and texts of all documents in both, the second as a whole or in every other comma segment.
NATIVE = ("aeiou", "अअइइउ")
NATIVE_SQL = rf"""
native_texts as (
  select doc_id, lang, lower(coalesce(text, '')) as clean, translate(lower(coalesce(text, '')), '{NATIVE[0]}', '{NATIVE[1]}') as native,
    array_to_string(list_transform(string_split(lower(coalesce(text, '')), ','), lambda x, i: case when i % 2 = 0 then translate(x, '{NATIVE[0]}', '{NATIVE[1]}') else x end), ',') as mixed
  from documents)"""


def native_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, clean, native, mixed)."""
    clean = F.lower(F.coalesce("text", F.lit("")))
    every_other = F.transform(F.split("clean", ",", -1), lambda x, i: F.when(i % 2 == 1, F.translate(x, *NATIVE)).otherwise(x))
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", clean.alias("clean"))
    return rows.withColumns({"native": F.translate("clean", *NATIVE), "mixed": F.array_join(every_other, ",")})


#: Scored pairs with ties: an order (q) claims the suppliers (s1) of its lines; its first line's is true for three of four orders.
SCORED_SQL = """
pairs as (
  select l_orderkey as q, l_suppkey as s1, max((l_partkey * 7919 + l_suppkey * 104729 + l_orderkey * 31) % 1000) / 1000.0::double as p, l_orderkey % 2 = 1 as is_s3
  from lineitem group by l_orderkey, l_suppkey),
truth as (select l_orderkey as q, min(l_linenumber::bigint * 1000000000 + l_suppkey) % 1000000000 as s1 from lineitem where l_orderkey % 4 <> 0 group by l_orderkey),
refs as (select s_suppkey as s1 from supplier)"""


def scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, truth, refs) of the scored view."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_linenumber")
    points = F.max((F.col("l_partkey") * 7919 + F.col("l_suppkey") * 104729 + F.col("l_orderkey") * 31) % 1000)
    pairs = lines.groupBy(F.col("l_orderkey").alias("q"), F.col("l_suppkey").alias("s1")).agg((points / F.lit(1000.0)).alias("p")).withColumn("is_s3", F.col("q") % 2 == 1)
    truth = lines.where("l_orderkey % 4 <> 0").groupBy(F.col("l_orderkey").alias("q")).agg((F.min(F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_suppkey")) % 1_000_000_000).alias("s1"))
    return pairs, truth, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("s1"))
