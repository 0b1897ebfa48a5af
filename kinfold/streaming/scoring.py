"""Micro-batch linkage: an extension, as the batch form is the whole capability. New query records are matched as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import decision, retrieval


def match_batch(refs: DataFrame, queries: DataFrame, threshold: float, w_name: float = 0.5) -> DataFrame:
    """(q, s1, p, is_s3) of a batch of normalised queries, with the blended cosine as the score."""
    scored = retrieval.score_pairs(refs, queries, w_name).join(queries.select("q", "is_s3"), "q")
    return decision.decide(scored.select("q", "s1", F.col("comb").alias("p"), "is_s3"), threshold)


def link_stream(refs: DataFrame, queries: DataFrame, out: str, checkpoint: str, threshold: float = 0.6) -> StreamingQuery:
    """Writes each micro-batch's matches to its own folder of ``out``, so that a repeated batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        match_batch(refs, batch, threshold).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return queries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
