"""Dictionaries of native-script words and address segments, learned from labelled pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text
from ..sources import store


def most_common(pairs: DataFrame, key: str, value: str, min_count: int, min_share: float) -> DataFrame:
    """(key, value, n, share) of the commonest value of each key, if common enough; ties to the smaller value.

    The share is of the key's pairs.
    """
    counts = pairs.groupBy(key, value).agg(F.count("*").alias("n"))
    ranked = counts.withColumns({"k": F.row_number().over(W.partitionBy(key).orderBy(F.desc("n"), value)), "total": F.sum("n").over(W.partitionBy(key))}).where("k = 1")
    return ranked.withColumn("share", F.col("n") / F.col("total")).where((F.col("n") >= min_count) & (F.col("share") >= min_share)).select(key, value, "n", "share")


def learn_name_aliases(pairs: DataFrame, min_count: int = 2, min_share: float = 0.5) -> DataFrame:
    """pairs: (ref_tokens, match_tokens), words of a reference name and of its match. Returns (native, latin, n, share).

    Words are aligned by place, where the numbers of words agree and the match has a native word.
    """

    def aligned(both: Column) -> Column:
        """Pairs of one row's words; ``both`` is a lambda's argument, so that its words are made once."""
        zipped = F.arrays_zip(both["match_tokens"].alias("native"), both["ref_tokens"].alias("latin"))
        return F.filter(F.when(F.size(both["ref_tokens"]) == F.size(both["match_tokens"]), zipped), lambda z: ~text.is_ascii(z["native"]) & text.is_ascii(z["latin"]))

    words = F.flatten(F.filter(F.transform(F.array(F.struct("ref_tokens", "match_tokens")), aligned), F.isnotnull))
    found = pairs.select(F.inline(words)).toDF("native", "latin")
    return most_common(found.where(text.is_non_latin("native")), "native", "latin", min_count, min_share)


def learn_segment_aliases(pairs: DataFrame, min_count: int = 3, min_share: float = 0.3) -> DataFrame:
    """pairs: (ref_clean, match_clean), cleaned addresses. Returns (native, latin, n, share).

    A native comma segment is paired with each of the reference's segments that the match's text lacks. Only pairs that can
    reach both limits are made: of segments that are frequent enough, and one for all segments of the same rows (the first
    by name of the latin ones; the native ones get its result back). The sets of rows are compared by two 64-bit hashes.
    """
    segments = lambda c: F.transform(F.split(c, ",", -1), text.punct_to_space)
    rows = pairs.where(~text.is_ascii("match_clean")).select(F.struct(F.xxhash64("match_clean", "ref_clean").alias("a"), F.xxhash64(F.lit(1), "match_clean", "ref_clean").alias("b")).alias("row"), F.struct(segments("match_clean").alias("m"), segments("ref_clean").alias("s")).alias("both"))

    def parted(both: Column) -> Column:
        """natives and absent of one row; ``whole`` is a lambda's argument, so that it is made once."""
        whole = F.concat(F.lit(" "), F.array_join(both["m"], " "), F.lit(" "))
        lacks = lambda t: lambda x: (x != "") & ~x.rlike(r"^\p{Nd}+$") & ~F.contains(t, F.concat(F.lit(" "), x, F.lit(" ")))
        absent = F.flatten(F.transform(F.array(whole), lambda t: F.filter(F.array_distinct(F.array_except(both["s"], both["m"])), lacks(t))))
        return F.struct(F.filter(both["m"], text.is_non_latin).alias("natives"), absent.alias("absent"))

    rows = rows.select("row", F.inline(F.transform(F.array("both"), parted))).where(F.size("natives") > 0)
    rows = store.written(rows, "segments")
    least = max(1, min_count)
    # by hashes: a collision only keeps a segment that is too rare
    many = F.size("natives") - F.size(F.array_distinct("natives")) + 1
    common = lambda found, n: found.groupBy("h").agg(n.alias("n")).where(F.col("n") >= least).select("h")
    kept_natives = common(rows.select(F.explode(F.transform("natives", lambda x: F.xxhash64(x))).alias("h")), F.count("*"))
    kept_latin = common(rows.select(F.explode(F.transform("absent", lambda x: F.xxhash64(x))).alias("h"), many.alias("many")), F.sum("many"))
    listed = lambda c, name, kept: rows.select("row", F.explode(c).alias(name)).withColumn("h", F.xxhash64(name)).join(kept, "h", "left_semi")
    native = store.written(listed("natives", "native", kept_natives).groupBy("row", "native").agg(F.count("*").alias("times")), "natives")
    latin = store.written(listed("absent", "latin", kept_latin).select("row", "latin").distinct(), "latin")

    def classes(found: DataFrame, name: str, of: list[str], *more: Column) -> DataFrame:
        """(name, first): the first of all with the same rows."""
        signs = [F.bit_xor(F.xxhash64(*of)).alias("s0"), F.bit_xor(F.xxhash64(F.lit(1), *of)).alias("s1"), F.count("*").alias("s2")]
        each = found.groupBy(name).agg(*signs, *more)
        first = each.groupBy("s0", "s1", "s2").agg(F.min(name).alias("first"))
        return store.written(each.join(first, ["s0", "s1", "s2"]).drop("s0", "s1", "s2"), f"classes_{name}")

    most = native.groupBy("row").agg(F.max("times").alias("most"))
    native_class = classes(native, "native", ["row", "times"], F.sum("times").alias("seen"))
    latin_class = classes(latin.join(most, "row"), "latin", ["row"], F.sum("most").alias("bound"))
    one = native.join(native_class.where("native = first").select("native", "seen"), "native")
    two = latin.join(latin_class.where("latin = first").where(F.col("bound") >= least).select("latin", "bound"), "latin")
    met = one.join(two, "row").where(F.col("bound") >= min_share * F.col("seen") - 1e-6)
    counts = met.groupBy("native", "latin").agg(F.sum("times").alias("n"), F.first("seen").alias("seen"))
    counts = counts.withColumn("share", F.col("n") / F.col("seen")).where((F.col("n") >= min_count) & (F.col("share") >= min_share))
    best = counts.withColumn("k", F.row_number().over(W.partitionBy("native").orderBy(F.desc("n"), "latin"))).where("k = 1")
    return native_class.select("native", "first").join(best.select(F.col("native").alias("first"), "latin", "n", "share"), "first").select("native", "latin", "n", "share")


def labelled_pairs(truth: DataFrame, ref: DataFrame, queries: DataFrame, native, most: int = 1_500_000) -> DataFrame:
    """Truth pairs (ref_id, q_id) whose query row ``native`` holds for, with both records; beyond ``most`` pairs about as many, drawn by a hash.

    The bound is a documented limit of what the dictionaries are learned from.
    """
    chosen = truth.join(queries.where(native).select(F.col("entity_id").alias("q_id")), "q_id", "left_semi")
    n = chosen.count()
    if n > most:
        chosen = chosen.where(F.pmod(F.xxhash64("q_id", "ref_id"), F.lit(1 << 40)) < (1 << 40) * most // n)
    one = ref.select(F.col("entity_id").alias("ref_id"), F.struct("*").alias("ref"))
    two = queries.select(F.col("entity_id").alias("q_id"), F.struct("*").alias("match"))
    return chosen.join(one, "ref_id").join(two, "q_id")
