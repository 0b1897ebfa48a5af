"""Line dedup by a suffix array over line-ID sequences, in DataFrame operations only.

Every line that occurs once in the corpus ends a sequence: no repeat goes through it. The other lines
get integer IDs in the order of their digests, and the suffixes of their sequences are sorted by
distributed prefix doubling: the rank of a suffix by its first 2h lines comes from the pair of ranks
(here, h lines on), as the number of suffixes with a smaller pair. Ranks are places in the suffix
array, so one rank at depth h stands for the longest-common-prefix interval of depth >= h that starts
at that place; the interval of any depth l between h and 2h is named by the ranks at a suffix and
l - h lines on. Doubling ends at the first depth at which all runs of ``min_words`` words are resolved.

A run counts if it has ``min_words`` words or more. Each interval of such a depth with several
suffixes is a repeated run; all its occurrences but the first are deleted. Overlapping deleted runs
make up the maximal repeated runs, as each maximal run is covered by the shortest runs in it that
still have ``min_words`` words.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common

_DIGITS = 3  # of the digest, for buckets of the first ranks: 16**3 of them


def _lines(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def _first_ranks(counts: DataFrame) -> DataFrame:
    """(digest, n) to (digest, rank): the occurrences of smaller digests. Buckets of the digest keep the sort spread."""
    bucketed = counts.withColumn("bucket", F.substring("digest", 1, _DIGITS))
    per = bucketed.groupBy("bucket").agg(F.sum("n").alias("size"))
    start = per.select("bucket", (F.sum("size").over(W.orderBy("bucket")) - F.col("size")).alias("start"))  # 4,096 rows at most
    return bucketed.join(start, "bucket").select("digest", (F.col("start") + F.sum("n").over(W.partitionBy("bucket").orderBy("digest")) - F.col("n")).alias("r0"))


def _doubled(rows: DataFrame, h: int, total: int) -> DataFrame:
    """Adds the ranks by 2**(h+1) lines to those by 2**h.

    Only the distinct pairs are ranked. Those of one rank are ranked in buckets of the second rank,
    about sqrt(total) of them, so that a line followed by very many others isn't one task's work.
    """
    r, then, new = f"r{h}", "then", f"r{h + 1}"
    island = W.partitionBy("id", "th", "island").orderBy("k")
    rows = common.cut(rows.withColumn(then, F.coalesce(F.lead(r, 2**h).over(island), F.lit(-1))), f"pairs{h}")
    width = max(1, math.isqrt(total + 1))
    pairs = rows.groupBy(r, then).agg(F.count("*").alias("c")).withColumn("bucket", F.floor((F.col(then) + 1) / width))
    starts = pairs.groupBy(r, "bucket").agg(F.sum("c").alias("size")).withColumn("start", F.sum("size").over(W.partitionBy(r).orderBy("bucket")) - F.col("size")).drop("size")
    within = F.sum("c").over(W.partitionBy(r, "bucket").orderBy(then)) - F.col("c")
    ranked = pairs.withColumn("within", within).join(starts, [r, "bucket"]).select(r, then, (F.col(r) + F.col("start") + F.col("within")).alias(new))
    return rows.join(ranked, [r, then]).drop(then)


def repeated_lines(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(id, th, lines): by document, the indices of the lines that belong to later copies; th is the text's hash."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    numbered = F.filter(F.transform(_lines("text"), lambda x, i: F.struct(i.alias("line"), x.alias("t"))), lambda s: s["t"].rlike(r"\S"))
    lines = base.select("id", F.xxhash64("text").alias("th"), F.posexplode(numbered).alias("k", "s"))
    words = F.least(F.regexp_count("s.t", F.lit(common.WORD)), F.lit(min_words))
    lines = common.cut(lines.select("id", "th", "k", F.col("s.line").alias("line"), F.md5("s.t").alias("digest"), words.alias("w")), "lines")
    counts = common.cut(lines.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1"), "counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    active = lines.join(_first_ranks(counts), "digest").groupBy("id", "th", "k").agg(*(F.min(c).alias(c) for c in ("line", "w", "r0")))
    rows = active.withColumn("island", F.col("k") - F.row_number().over(W.partitionBy("id", "th").orderBy("k")))
    depths = max(0, min_words.bit_length() - 1)
    for h in range(depths):
        rows = _doubled(rows, h, total)

    def ahead(c: str, n: int) -> Column:
        return F.collect_list(c).over(W.partitionBy("id", "th", "island").orderBy("k").rowsBetween(0, n - 1))

    rows = rows.select("id", "th", "k", ahead("line", min_words).alias("ls"), ahead("w", min_words).alias("ws"), *(ahead(f"r{h}", 2**h).alias(f"r{h}") for h in range(depths + 1)))
    sums = rows.withColumn("sums", F.expr("transform(ws, (x, i) -> aggregate(slice(ws, 1, i + 1), 0, (a, b) -> a + b))"))
    # shortest from the front, or shortest from the back
    fit = F.expr(f"filter(sequence(1, size(ws)), l -> sums[l - 1] >= {min_words} and (l = 1 or sums[l - 2] < {min_words} or sums[l - 1] - ws[0] < {min_words}))")
    runs = sums.withColumn("l", F.explode(fit))
    shift = F.lit(None)
    for h in range(depths + 1):
        end = F.expr(f"r{h}[least(l - {2**h}, size(r{h}) - 1)]")
        shift = F.when((F.col("l") >= 2**h) & (F.col("l") < 2 ** (h + 1)), F.struct(F.expr(f"r{h}[0]").alias("a"), end.alias("b"))).otherwise(shift)
    runs = common.cut(runs.select("id", "th", "k", "l", F.slice("ls", 1, F.col("l")).alias("ls"), shift.alias("interval")), "runs")
    intervals = common.cut(runs.groupBy("l", "interval").agg(F.min(F.struct("id", "th", "k")).alias("first"), F.count("*").alias("n")).where("n > 1"), "intervals")
    later = common.join_counted(runs, intervals, ["l", "interval"]).where(~F.struct("id", "th", "k").eqNullSafe(F.col("first")))
    return later.select("id", "th", F.explode("ls").alias("line")).groupBy("id", "th").agg(F.collect_set("line").alias("lines"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 10) -> DataFrame:
    """``docs`` with later copies of repeated line runs deleted from ``text_col``; adds n_lines and n_deleted.

    Lines end at U+000A. Documents come in the order of ``id_col`` (null first), then of the text's hash,
    and a run may repeat within one document. Blank lines are no part of a run and are never deleted.
    Null text: stays null, no lines. Empty text: one blank line. Rows with the same id and text are one
    document and all keep what it keeps. An empty table gives an empty result. Other columns are kept as
    they are; n_lines and n_deleted replace columns of these names.
    """
    gone = repeated_lines(docs, id_col, text_col, min_words).withColumnsRenamed({"id": "__id", "th": "__th", "lines": "__lines"})
    keyed = docs.withColumn("__key", F.xxhash64(text_col))
    joined = keyed.join(gone, keyed[id_col].eqNullSafe(gone["__id"]) & (keyed["__key"] == gone["__th"]), "left")
    split = _lines(text_col)
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("__lines")), lambda i: F.get(split, i))
    text = F.when(F.col("__lines").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    out = joined.withColumns(
        {
            "n_lines": F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(split)).cast("long"),
            "n_deleted": F.when(F.col("__lines").isNull(), F.lit(0)).otherwise(F.size("__lines")).cast("long"),
        }
    )
    return out.withColumn(text_col, text).drop("__id", "__th", "__key", "__lines")
