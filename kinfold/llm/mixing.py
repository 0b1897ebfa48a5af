"""Mixing sources to target weights by Poisson replication.

A source's rate is its target share of the output's bytes over its share of the input's, times
``epochs``. Each document gets a uniform number from a hash of the seed and its id, inverts the
Poisson distribution of its source's rate with it, is exploded by that count, and all copies are dealt
out and sorted by a hash. Counts are a function of the row alone, so a task that runs again gives the same.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 of the parts, joined by ``|``."""
    digest = F.md5(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


#: Rates above this are split into equal parts, whose counts are independent and add up to the whole's.
PART_RATE = 1e6
#: Bytes of tables that are broadcast; beyond it they are joined by a shuffle.
TABLE_BYTES = 32 << 20
#: Copies of a row that one array numbers.
_BLOCK = 1 << 16


def _range(rate: Column) -> tuple[Column, Column]:
    """Counts within 12 standard deviations of the rate and 24 more: what is outside has a mass below 1e-30."""
    reach = 12 * F.sqrt(rate) + 24
    return F.greatest(F.lit(0), F.floor(rate - reach)).cast("long"), F.ceil(rate + reach).cast("long")


def poisson_tables(rates: DataFrame) -> DataFrame:
    """(key, rate) to (key, rate, low, cdf): P(count <= k) for k from ``low`` as an array, to the end of _range.

    Masses are relative to the largest one, by sums of logarithms, and divided by their sum, so that no rate
    under- or overflows. Rates up to about PART_RATE: the array has 24 * sqrt(rate) + 48 entries.
    """
    low, high = _range(F.col("rate"))
    steps = rates.withColumn("low", low).withColumn("k", F.explode(F.sequence("low", F.when(F.col("rate") > 0, high).otherwise(F.lit(0).cast("long")))))
    every = W.partitionBy("key")
    upto = every.orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    ratio = F.when(F.col("k") == F.col("low"), F.lit(0.0)).otherwise(F.log(F.col("rate") / F.col("k")))
    steps = steps.withColumn("log", F.sum(ratio).over(upto))
    steps = steps.withColumn("mass", F.exp(F.col("log") - F.max("log").over(every)))
    steps = steps.withColumn("cdf", F.sum("mass").over(upto) / F.sum("mass").over(every))
    listed = steps.groupBy("key", "rate", "low").agg(F.array_sort(F.collect_list(F.struct("k", "cdf"))).alias("s"))
    return listed.select("key", "rate", "low", F.col("s.cdf").alias("cdf"))


def poisson_counts(docs: DataFrame, rates: DataFrame, seed: int, id_col: str, key_col: str, part_rate: float = PART_RATE) -> DataFrame:
    """``docs`` with copies (long): the Poisson quantile of the rate (key, rate) of its ``key_col`` at a hash of the seed and the id.

    A rate above ``part_rate`` is cut into equal parts with a hash each.
    """
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / part_rate)).cast("long")
    split = common.cut(rates.select("key", parts.alias("parts"), (F.col("rate") / parts).alias("rate")), "rates")
    low, high = _range(F.col("rate"))
    size = split.agg(F.coalesce(F.sum((high - low + 4) * 8), F.lit(0))).first()[0]
    tables = poisson_tables(split.select("key", "rate")).join(split.select("key", "parts"), "key")
    tables = tables.select(F.col("key").alias("__key"), F.col("parts").alias("__parts"), F.col("low").alias("__low"), F.col("cdf").alias("__cdf"))
    joined = docs.join(F.broadcast(tables) if size <= TABLE_BYTES else tables, docs[key_col] == tables["__key"])

    # the number of entries up to u, by halving: a step is taken if the entry there is still one of them
    widest = int(24 * math.sqrt(part_rate)) + 64
    steps = F.array(*(F.lit(1 << b) for b in reversed(range(widest.bit_length()))))

    def at(u: Column) -> Column:
        on = lambda n, step: (n + step <= F.size("__cdf")) & (F.get("__cdf", n + step - 1) <= u)
        return F.col("__low") + F.aggregate(steps, F.lit(0), lambda n, step: F.when(on(n, step), n + step).otherwise(n))

    more = F.aggregate(F.sequence(F.lit(1).cast("long"), F.col("__parts") - 1), F.lit(0).cast("long"), lambda n, i: n + at(uniform(F.lit(seed), F.col(id_col), i)))
    first = joined.withColumn("__u", uniform(F.lit(seed), F.col(id_col))).withColumn("copies", at(F.col("__u")).cast("long"))
    whole = F.when(F.col("__parts") > 1, F.col("copies") + more).otherwise(F.col("copies"))
    return first.withColumn("copies", whole).drop("__parts", "__low", "__cdf", "__u", "__key")


def poisson_mix(
    docs: DataFrame,
    weights: dict[str, float],
    default_weight: float = 1.0,
    epochs: float = 1.0,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``docs`` replicated to the target weights and shuffled; adds copy (from 1), copies and shuffle_key.

    Weights are relative, among the sources that occur; a source not named has ``default_weight``; null
    is a source of its own. Sizes are UTF-8 bytes, null texts none. A source without bytes has rate
    ``epochs``. Rows of one id get one count, repeated rows each their copies. Rates have no upper bound:
    tables are of the counts near the rate, and rates above PART_RATE are sums of parts. An empty table gives an empty result. Columns of the three names are replaced, others are kept.
    """
    base = docs.drop("copy", "copies", "shuffle_key").withColumn("__key", F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")))
    size = F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long")
    stats = base.select("__key", size.alias("size")).groupBy(F.col("__key").alias("key")).agg(F.sum("size").alias("size"))
    named = F.create_map(*itertools.chain.from_iterable((F.lit("=" + k), F.lit(float(v))) for k, v in weights.items())) if weights else None
    weight = F.lit(float(default_weight)) if named is None else F.coalesce(F.try_element_at(named, F.col("key")), F.lit(float(default_weight)))
    stats = common.cut(stats.withColumn("weight", weight), "sources")
    totals = stats.agg(F.sum("size").cast("double").alias("size"), F.sum("weight").alias("weight"), F.count("*").alias("n")).first()
    share = F.col("weight") / F.lit(totals["weight"] or 1.0) * F.lit(totals["size"] or 0.0)
    rate = F.when(F.col("size") > 0, share / F.col("size") * float(epochs)).otherwise(float(epochs))
    counted = poisson_counts(base.withColumnRenamed("__key", "__source"), stats.select("key", rate.alias("rate")), seed, id_col, "__source")
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(_BLOCK).cast("long")))
    blocked = counted.where("copies > 0").drop("__source").withColumn("__block", blocks)
    copied = blocked.withColumn("copy", F.explode(F.sequence(F.col("__block") + 1, F.least(F.col("__block") + _BLOCK, "copies")))).drop("__block")
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("shuffle"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col("copy").cast("string")))
    return copied.withColumn("shuffle_key", key).repartition("shuffle_key").sortWithinPartitions("shuffle_key")
