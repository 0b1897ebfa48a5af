"""Features of candidate pairs: competition among candidates, strings, numbers, and groups of claimants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import similarity as sim
from ..functions import text as tx

#: Order of the pair features.
PAIR_FEATURES = [
    "sn", "sa", "comb", "gap_best", "margin_other", "sn_gap", "sa_gap", "q_comb1", "q_comb2", "rank_q", "n_q", "rank_s1", "n_s1",
    "s1_top_s2", "s1_top_s3", "is_top", "nk_ratio", "nk_tset", "nk_tsort", "nk_partial", "nk_jw", "nc_ratio", "nc_tset", "sq_ratio",
    "ad_ratio", "ad_tset", "ad_tsort", "ad_partial", "len_nk_q", "len_nk_s", "len_ad_q", "len_ad_s", "num_first_in_q", "num_first_eq",
    "num_shared", "num_q", "num_s", "q_addr_empty", "q_native", "is_s3", "w_name",
]
GROUP_FEATURES = [
    "p1", "g_is_best", "g_margin_q", "g_q_best", "g_q_second", "g_s1_max_other", "g_s1_sum_other", "g_s1_cnt_other",
    "g_s1_cnt_s2_other", "g_s1_cnt_s3_other", "g_other_nk_ratio", "g_other_nk_tset", "g_other_ad_tset", "g_has_other",
]


def _by(key: str):
    return W.partitionBy(key)


def competition(pairs: DataFrame) -> DataFrame:
    """(q, s1, sn, sa, comb, q_comb1, q_comb2, q_sn1, q_sa1, is_s3) with ranks, counts and gaps.

    Ranks start at 0 and go by falling comb, ties to the smaller s1 (within q) or q (within s1).
    Missing statistics of a query count as 0.
    """
    stats = {c: F.coalesce(c, F.lit(0.0)) for c in ("q_comb1", "q_comb2", "q_sn1", "q_sa1")}
    out = pairs.withColumns(stats).withColumns(
        {
            "rank_q": F.row_number().over(_by("q").orderBy(F.desc("comb"), "s1")) - 1,
            "n_q": F.count("*").over(_by("q")),
            "rank_s1": F.row_number().over(_by("s1").orderBy(F.desc("comb"), "q")) - 1,
            "n_s1": F.count("*").over(_by("s1")),
        }
    )
    top = F.col("rank_q") == 0
    return out.withColumns(
        {
            "is_top": top,
            "s1_top_s2": F.sum(F.when(top & ~F.col("is_s3"), 1).otherwise(0)).over(_by("s1")),
            "s1_top_s3": F.sum(F.when(top & F.col("is_s3"), 1).otherwise(0)).over(_by("s1")),
            "gap_best": F.col("comb") - F.col("q_comb1"),
            "margin_other": F.col("comb") - F.when(top, F.col("q_comb2")).otherwise(F.col("q_comb1")),
            "sn_gap": F.col("sn") - F.col("q_sn1"),
            "sa_gap": F.col("sa") - F.col("q_sa1"),
        }
    )


def with_records(pairs: DataFrame, ref: DataFrame, queries: DataFrame) -> DataFrame:
    """Joins record columns to pairs: q_* of the query, s_* of the reference."""
    q = queries.select("q", *(F.col(c).alias(f"q_{c}") for c in ("name_key", "name_clean", "addr_clean", "nums", "addr_empty", "name_native")), "is_s3")
    s = ref.select("s1", *(F.col(c).alias(f"s_{c}") for c in ("name_key", "name_clean", "addr_clean", "nums")))
    return pairs.drop("is_s3").join(q, "q").join(s, "s1")


def number_features(pairs: DataFrame) -> DataFrame:
    """Agreement of the address numbers q_nums and s_nums, and lengths."""
    first_q, first_s = F.get("q_nums", F.lit(0)), F.get("s_nums", F.lit(0))
    return pairs.withColumns(
        {
            "num_shared": F.size(F.filter("q_nums", lambda x: F.array_contains("s_nums", x))),
            "num_first_in_q": F.coalesce(F.array_contains("q_nums", first_s), F.lit(False)),
            "num_first_eq": F.coalesce(first_q == first_s, F.lit(False)),
            "num_q": F.size("q_nums"),
            "num_s": F.size("s_nums"),
            "len_nk_q": F.length("q_name_key"),
            "len_nk_s": F.length("s_name_key"),
            "len_ad_q": F.length("q_addr_clean"),
            "len_ad_s": F.length("s_addr_clean"),
        }
    )


def string_features(pairs: DataFrame) -> DataFrame:
    nk, nc, ad = ("q_name_key", "s_name_key"), ("q_name_clean", "s_name_clean"), ("q_addr_clean", "s_addr_clean")
    made = {
        "nk": sim.col_scores(*nk, "ratio", "tset", "tsort", "partial", "jw"), "nc": sim.col_scores(*nc, "ratio", "tset"),
        "sq": sim.col_scores(*map(tx.squashed, nk), "ratio"), "ad": sim.col_scores(*ad, "ratio", "tset", "tsort", "partial"),
    }
    scores = ("nk_ratio", "nk_tset", "nk_tsort", "nk_partial", "nk_jw", "nc_ratio", "nc_tset", "sq_ratio", "ad_ratio", "ad_tset", "ad_tsort", "ad_partial")
    return pairs.withColumns({f"_{k}": v for k, v in made.items()}).withColumns({c: F.col(f"_{c[:2]}")[c[3:]] for c in scores}).drop(*(f"_{k}" for k in made))


def pair_features(cands: DataFrame, ref: DataFrame, queries: DataFrame) -> DataFrame:
    """All PAIR_FEATURES as doubles, with q and s1."""
    flagged = cands.join(queries.select("q", "is_s3"), "q")
    full = string_features(number_features(with_records(competition(flagged), ref, queries)))
    full = full.withColumns({"q_addr_empty": F.col("q_addr_empty"), "q_native": F.col("q_name_native")})
    return full.select("q", "s1", *(F.col(c).cast("double").alias(c) for c in PAIR_FEATURES))


def is_best(p: str = "p"):
    """Whether a pair is its query's best; ties to the smaller s1."""
    return F.row_number().over(_by("q").orderBy(F.desc(p), "s1")) == 1


def group_features(pairs: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """(q, s1, p, is_s3) with GROUP_FEATURES.

    The claimants of an s1 are the queries whose best pair it is. records: (q, name_key, addr_clean) for
    the similarities with the strongest other claimant; without it, or without such a claimant, they are -1.
    """
    ranked = pairs.withColumn("_rq", F.row_number().over(_by("q").orderBy(F.desc("p"), "s1")))
    best = F.col("_rq") == 1
    claims = F.when(best, F.col("p")).otherwise(0.0)
    sure = best & (F.col("p") >= 0.5)
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).over(_by("s1")) - F.when(c, 1).otherwise(0)
    out = ranked.withColumns(
        {
            "p1": F.col("p"),
            "g_is_best": best,
            "g_q_best": F.max(F.when(best, F.col("p"))).over(_by("q")),
            "g_q_second": F.coalesce(F.max(F.when(F.col("_rq") == 2, F.col("p"))).over(_by("q")), F.lit(0.0)),
            "g_s1_sum_other": F.sum(claims).over(_by("s1")) - claims,
            "g_s1_cnt_other": count(sure),
            "g_s1_cnt_s2_other": count(sure & ~F.col("is_s3")),
            "g_s1_cnt_s3_other": count(sure & F.col("is_s3")),
            "_rs": F.when(best, F.row_number().over(W.partitionBy("s1", best).orderBy(F.desc("p"), "q"))),
        }
    )
    at = lambda k, c: F.max(F.when(F.col("_rs") == k, F.col(c))).over(_by("s1"))
    first = F.coalesce(F.col("_rs") == 1, F.lit(False))
    out = out.withColumns({"_p1": at(1, "p"), "_p2": at(2, "p"), "_q1": at(1, "q"), "_q2": at(2, "q")}).withColumns(
        {
            "g_margin_q": F.col("p") - F.when(best, F.col("g_q_second")).otherwise(F.col("g_q_best")),
            "g_s1_max_other": F.coalesce(F.when(first, F.col("_p2")).otherwise(F.col("_p1")), F.lit(0.0)),
            "_other": F.when(first, F.col("_q2")).otherwise(F.col("_q1")),
        }
    )
    out = out.withColumn("g_has_other", F.col("_other").isNotNull())
    strings = ("g_other_nk_ratio", "g_other_nk_tset", "g_other_ad_tset")
    if records is None:
        out = out.withColumns({c: F.lit(-1.0) for c in strings})
    else:
        mine = records.select("q", F.col("name_key").alias("_nk"), F.col("addr_clean").alias("_ad"))
        theirs = records.select(F.col("q").alias("_other"), F.col("name_key").alias("_onk"), F.col("addr_clean").alias("_oad"))
        out = out.join(mine, "q").join(theirs, "_other", "left")
        made = (sim.col_ratio("_nk", "_onk"), sim.col_token_set("_nk", "_onk"), sim.col_token_set("_ad", "_oad"))
        out = out.withColumns({c: F.when(F.col("g_has_other"), v).otherwise(-1.0) for c, v in zip(strings, made, strict=True)})
    return out.select(*pairs.columns, *GROUP_FEATURES)
