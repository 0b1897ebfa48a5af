"""The stages of a linkage run; tables between them are Parquet under the work folder."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import aliases, features, metrics, numbering, retrieval, sampling
from ..sources import layout, store, tsv
from . import model


def _save(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def _numbered(records: DataFrame, name: str, path: str) -> DataFrame:
    """Numbers from 0 in the order of the source file, by way of a table at ``path``."""
    out = numbering.numbered(records, name, tsv.PLACE, lambda df, _: _save(df, path))
    return out.drop(*tsv.PLACE)


def sample(spark: SparkSession, data: str, out: str, fraction: float = 0.02, seed: int = 7) -> None:
    """A small train split, and a test split made of the same records."""
    root, files = layout.find_split(spark, data, "train"), tsv.SPLIT_FILES["train"]
    truth = tsv.read_ground_truth(spark, f"{root}/{files['gt']}")
    refs = tsv.read_source(spark, f"{root}/{files['s1']}")
    kept, s1, _ = sampling.sample(truth, refs, refs, fraction, seed)
    tsv.write_table(kept, store.at(spark, out, "train", files["gt"]))
    for split in ("train", "test"):
        tsv.write_table(s1, store.at(spark, out, split, tsv.SPLIT_FILES[split]["s1"]))
    for k in ("s2", "s3"):
        _, _, q = sampling.sample(truth, refs, tsv.read_source(spark, f"{root}/{files[k]}"), fraction, seed)
        for split in ("train", "test"):
            tsv.write_table(q, store.at(spark, out, split, tsv.SPLIT_FILES[split][k]))


def prepare(spark: SparkSession, data: str, work: str, split: str) -> None:
    """Normalised references and queries; on train also the dictionaries (kept if they exist) and the truth.

    References are numbered by the order of their file, queries by that of S2's and then S3's. Of several
    references for one query the first in S1's order is its truth, and the others are counted in a warning.
    """
    root, files = layout.find_split(spark, data, split), tsv.SPLIT_FILES[split]
    at = lambda *more: store.at(spark, work, split, *more)
    raw = {}
    for k in ("s1", "s2", "s3"):
        raw[k] = tsv.read_source(spark, f"{root}/{files[k]}", place=True).withColumnsRenamed({"business_name": "name", "business_address": "address"})
    queries = raw["s2"].withColumn("is_s3", F.lit(False)).unionByName(raw["s3"].withColumn("is_s3", F.lit(True)))
    known, truth = {k: store.at(spark, work, "aliases", k) for k in ("name", "segment")}, None
    if split == "train":
        truth = sampling.explode_truth(tsv.read_ground_truth(spark, f"{root}/{files['gt']}"))
        if not store.done(spark, known["segment"]):
            names = aliases.labelled_pairs(truth, raw["s1"], queries, (F.col("name") != "") & ~F.col("name").rlike("[A-Za-z]"))
            tokens = lambda c: tx.name_tokens(tx.base_clean(F.col(c)))
            _save(aliases.learn_name_aliases(names.select(tokens("ref.name").alias("ref_tokens"), tokens("match.name").alias("match_tokens"))), known["name"])
            places = aliases.labelled_pairs(truth, raw["s1"], queries, F.col("address").rlike(r"[\x{0900}-\x{0DFF}]"))
            _save(aliases.learn_segment_aliases(places.select(tx.base_clean(F.col("ref.address")).alias("ref_clean"), tx.base_clean(F.col("match.address")).alias("match_clean"))), known["segment"])
    found = {k: spark.read.parquet(path) if store.done(spark, path) else None for k, path in known.items()}
    refs = _save(tx.normalise(_numbered(raw["s1"], "s1", at("parts1")), found["name"], found["segment"], key="s1"), at("refs"))
    two, three = (_numbered(raw[k].withColumn("is_s3", F.lit(k == "s3")), "q", at(f"parts{k[1]}")) for k in ("s2", "s3"))
    first = raw["s2"].count()
    every = two.unionByName(three.withColumn("q", F.col("q") + first))
    done = _save(tx.normalise(every, found["name"], found["segment"], key="q"), at("queries"))
    for k in "123":
        store.delete(spark, at(f"parts{k}"))
    if truth is not None:
        pairs = truth.join(refs.select(F.col("entity_id").alias("ref_id"), "s1"), "ref_id").join(done.select(F.col("entity_id").alias("q_id"), "q"), "q_id")
        if lost := truth.count() - pairs.count():
            print(f"warning: {lost} listed pairs have an id that no source holds")
        kept = _save(pairs.groupBy("q").agg(F.min("s1").alias("s1"), F.count_distinct("s1").alias("claims")), at("truth"))
        if more := kept.where("claims > 1").count():
            print(f"warning: {more} queries are listed for several references; the first counts")


def tables(spark: SparkSession, work: str, split: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(store.at(spark, work, split, "refs")), spark.read.parquet(store.at(spark, work, split, "queries"))


#: Queries of the countries that are retrieved together at least, unless there are no more.
TOGETHER = 5_000_000


def _by_countries(refs: DataFrame, queries: DataFrame, work: str, split: str, params: dict, together: int = TOGETHER) -> DataFrame:
    """Scored pairs of the sketched retrieval, some countries after the others; what an interrupted run has finished with equal parameters is taken over.

    Gram frequencies are those of all references. The number of countries is small: they are counted on the driver.
    """
    spark = refs.sparkSession
    sizes = sorted(map(tuple, queries.where("country is not null").groupBy("country").count().collect()))
    groups: list[list[str]] = []
    held = together
    for country, size in sizes:
        if held >= together:
            groups.append([])
            held = 0
        groups[-1].append(country)
        held += size
    shape = {**params, "refs": refs.count(), "queries": queries.count()}
    at = lambda name: store.at(spark, work, split, "countries", name)
    tag = lambda value: hashlib.md5(json.dumps(value, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:16]
    kept = lambda df, name: spark.read.parquet(at(name)) if store.done(spark, at(name)) else _save(df, at(name))
    frequencies = retrieval.gram_frequencies(refs, lambda df, name: kept(df, f"{name}-{tag(shape)}"))
    n = refs.agg(F.count("*").alias("n_docs"))
    k = {x: params[x] for x in ("w_name", "k_name", "k_addr", "k_comb", "dim")}
    done = []
    for group in groups:
        mine = F.col("country").isin(group)
        path = at(f"pairs-{tag([shape, group])}")
        if not store.done(spark, path):
            _save(retrieval.retrieve_sketched(refs.where(mine), queries.where(mine), n=n, frequencies=frequencies, **k), path)
        done.append(spark.read.parquet(path))
    return reduce(DataFrame.unionByName, done) if done else retrieval.retrieve_sketched(refs, queries, n=n, frequencies=frequencies, **k)


def retrieve(spark: SparkSession, work: str, split: str, k_name: int = 3, k_addr: int = 3, k_comb: int = 8, w_name: float = 0.5, dim: int = 1024, exact: bool = False) -> dict | None:
    """Candidates of a split, unless they exist with the same parameters; the report on train."""
    params = {"k_name": k_name, "k_addr": k_addr, "k_comb": k_comb, "w_name": w_name, "dim": dim, "exact": exact}
    path, tag = (store.at(spark, work, split, x) for x in ("candidates", "retrieval.json"))
    refs, queries = tables(spark, work, split)
    if not (store.done(spark, path) and store.exists(spark, tag) and store.load_json(spark, tag) == params):
        slim_refs = refs.select("s1", "country", "name_key", "addr_clean")
        slim = queries.select("q", "country", "name_key", "addr_clean", "addr_empty")
        pairs = retrieval.score_pairs(slim_refs, slim, w_name) if exact else _by_countries(slim_refs, slim, work, split, params)
        pairs = _save(pairs, store.at(spark, work, split, "scored_pairs"))
        found = retrieval.candidates(pairs, k_name, k_addr, k_comb, few=not exact)
        _save(found.repartitionByRange("q").sortWithinPartitions("q", F.desc("comb"), "s1"), path)
        store.save_json(spark, params, tag)
        store.delete(spark, store.at(spark, work, split, "countries"))
    truth = store.at(spark, work, split, "truth")
    if not store.done(spark, truth):
        return None
    return metrics.candidate_report(spark.read.parquet(path), refs.select("s1"), spark.read.parquet(truth), queries.select("q", "is_s3")).first().asDict()


def make_features(spark: SparkSession, work: str, split: str) -> None:
    path = store.at(spark, work, split, "features")
    if not store.done(spark, path):
        refs, queries = tables(spark, work, split)
        _save(features.pair_features(spark.read.parquet(store.at(spark, work, split, "candidates")), refs, queries), path)


def train(spark: SparkSession, work: str, settings: model.Settings) -> model.Meta:
    refs, queries = tables(spark, work, "train")
    read = lambda name: spark.read.parquet(store.at(spark, work, "train", name))
    return model.train(read("features"), refs.select("s1"), queries, read("truth"), store.at(spark, work, "model"), settings, store.at(spark, work, "model", "meta.json"))


def predict(spark: SparkSession, work: str, out: str, threshold: float | None = None, candidates: bool = True, prob: str = "auto", prior: str | None = None, name: str = "matching_results.tsv") -> None:
    refs, queries = tables(spark, work, "test")
    meta = model.load_meta(spark, store.at(spark, work, "model", "meta.json"))
    pairs = spark.read.parquet(store.at(spark, work, "test", "features"))
    saved = store.at(spark, work, "test", "scores")
    # scores are kept for another threshold, stage or prior, as long as they are of the same model
    again = (threshold is not None or prob != "auto" or prior is not None) and store.done(spark, saved)
    if not again or spark.read.parquet(saved).where(F.col("model_id") != meta.model_id).limit(1).count():
        _save(model.score_all(pairs, queries, store.at(spark, work, "model"), meta), saved)
    kept = model.choose(spark.read.parquet(saved), refs.count(), queries.count(), meta, prob, threshold, prior)
    ids = queries.select("q", F.col("entity_id").alias("q_id"))
    listed = lambda df, column: tsv.grouped_lists(refs.select("s1", "entity_id"), df.select("q", "s1").join(ids, "q"), column)
    tsv.write_file(listed(kept, "matched_entity_ids"), store.at(spark, out, name))
    if candidates:
        tsv.write_file(listed(pairs, "candidate_entity_ids"), store.at(spark, out, "candidate_pairs.tsv"))
