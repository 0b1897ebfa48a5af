"""Splits and samples by digests, the same at every run and partitioning; labelled pairs from id lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def digest_share(c: Column | str, seed: int) -> Column:
    """A number in [0, 1) from the MD5 of the seed and a value."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(c).cast("string") if isinstance(c, str) else c.cast("string"))), 1, 12), 16, 10).cast("double") / float(1 << 48)


def query_fold(q: Column | str, folds: int) -> Column:
    """The fold of an integer query id by a multiplicative hash of 32 bits, in halves of 16 bits so that no id overflows."""
    q = F.pmod((F.col(q) if isinstance(q, str) else q).cast("bigint"), F.lit(1 << 32))
    high, low = F.shiftright(q, 16) * 2654435761, F.pmod(q, F.lit(1 << 16)) * 2654435761
    return F.pmod(F.pmod(F.pmod(high, F.lit(1 << 16)) * (1 << 16) + low, F.lit(1 << 32)), F.lit(folds)).cast("int")


def explode_truth(lists: DataFrame) -> DataFrame:
    """(source1_entity_id, matched_entity_ids) to (ref_id, q_id), a row for each listed id; blanks are dropped."""
    ids = F.transform(F.split("matched_entity_ids", ",", -1), lambda x: F.trim(x))
    out = lists.where(F.length("matched_entity_ids") > 0).select(F.col("source1_entity_id").alias("ref_id"), F.explode(ids).alias("q_id"))
    return out.where("q_id <> ''")


def truth_vector(pairs: DataFrame, refs: DataFrame, queries: DataFrame) -> DataFrame:
    """(q_id, ref_id) of pairs both of whose ids are known."""
    known = pairs.join(refs.select(F.col("entity_id").alias("ref_id")), "ref_id", "left_semi")
    return known.join(queries.select(F.col("entity_id").alias("q_id")), "q_id", "left_semi").select("q_id", "ref_id")


def sample(truth: DataFrame, refs: DataFrame, queries: DataFrame, fraction: float, seed: int = 7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A share of the truth lists, their references and all their matches, and the same share of records that no list holds."""
    kept = truth.where(digest_share("source1_entity_id", seed) < fraction)
    of_kept, of_all = explode_truth(kept).select(F.col("q_id").alias("entity_id")), explode_truth(truth).select(F.col("q_id").alias("entity_id"))
    s1 = refs.join(kept.select(F.col("source1_entity_id").alias("entity_id")), "entity_id", "left_semi")
    matched = queries.join(of_kept, "entity_id", "left_semi")
    free = queries.join(of_all, "entity_id", "left_anti").where(digest_share("entity_id", seed) < fraction)
    return kept, s1, matched.unionByName(free)


def validation_split(refs: DataFrame, queries: DataFrame, cands: DataFrame, truth: DataFrame, val_share: float, train_share: float, seed: int = 11) -> DataFrame:
    """(q, part): ``val`` for queries that touch a validation reference as candidate or truth, ``train`` for a share of the others, else ``rest``."""
    val = refs.where(digest_share("s1", seed) < val_share).select("s1")
    touched = cands.select("q", "s1").unionByName(truth.select("q", "s1")).join(val, "s1", "left_semi").select("q").distinct().withColumn("touched", F.lit(True))
    drawn = digest_share("q", seed + 1) < train_share
    return queries.select("q").join(touched, "q", "left").select("q", F.when(F.col("touched"), "val").when(drawn, "train").otherwise("rest").alias("part"))
