"""Two-stage boosted trees over pair features: fold models, out-of-fold scores, group features, metadata."""

from __future__ import annotations

import time
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import DENSITY_FEATURES
from ..operators import boosting, decision, features, metrics
from ..operators.sampling import query_fold, validation_split
from ..sources import store


@dataclass
class Settings:
    folds: int = 2
    rounds: int = 150
    depth: int = 9
    step: float = 0.1
    bins: int = 256
    min_child: int = 5
    subsample: float = 0.8
    val_share: float = 0.02
    train_share: float = 0.35
    seed: int = 11
    drop: str = "none"
    stage2: bool = True

    @property
    def columns(self) -> list[str]:
        return [c for c in features.PAIR_FEATURES if self.drop != "density" or c not in DENSITY_FEATURES]


@dataclass
class Meta:
    settings: dict
    model_id: str
    use_stage2: bool = False
    rule: str = "threshold"
    threshold: float = 0.5
    floor: float = 0.3
    stages: dict = field(default_factory=dict)
    # fixed values: the training truth's share of matched records and its matches for each reference, where a run has no own
    train_prior: float = 7638365 / 10320219
    matches_per_ref: float = 3.4613


def _vectors(df: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="_x", handleInvalid="keep").transform(df)


def fit(df: DataFrame, columns: list[str], settings: Settings, learns: list[Column]) -> list[GBTClassificationModel]:
    """A model for each condition of ``learns``. df: ``columns``, label and held; rows of held only stop the boosting."""
    s = settings
    return boosting.fit(df, columns, learns, boosting.Boosting(s.depth, s.rounds, s.step, s.bins, s.min_child, s.subsample, 0.8, 0.0001, s.seed))


def score(models: list[GBTClassificationModel], df: DataFrame, columns: list[str], by_fold: bool = False) -> DataFrame:
    """Adds p: the mean of the models; with ``by_fold``, rows of part train only from models of the other folds, and only these are asked."""
    if by_fold and len(models) > 1:
        fold = F.when(F.col("part") == "train", F.col("fold"))
        parts = [score([m for i, m in enumerate(models) if i != k], df.where(fold == k), columns) for k in range(len(models))]
        return reduce(DataFrame.unionByName, parts, score(models, df.where(~F.coalesce(fold.between(0, len(models) - 1), F.lit(False))), columns))
    out = _vectors(df, columns)
    names = []
    for k, model in enumerate(models):
        drawn = model.setFeaturesCol("_x").setRawPredictionCol(f"_r{k}").setProbabilityCol(f"_v{k}").setPredictionCol(f"_l{k}").transform(out)
        out = drawn.withColumn(f"_p{k}", vector_to_array(f"_v{k}")[1]).drop(f"_r{k}", f"_v{k}", f"_l{k}")
        names.append(f"_p{k}")
    return out.withColumn("p", reduce(lambda a, b: a + b, map(F.col, names)) / len(names)).drop("_x", *names)


def best_rule(scored: DataFrame, refs: DataFrame, truth: DataFrame) -> dict:
    """The better of the threshold and the expected-F rule, each at its best setting, with caps. The sweep of thresholds is without."""
    threshold, _ = decision.best_threshold(decision.sweep(scored, refs, truth))
    plain = metrics.evaluate(decision.decide(scored, threshold), refs, truth).first().asDict()
    floors = {r["floor"]: r["f05"] for r in decision.sweep_expected(scored, refs, truth).collect()}
    floor = max(sorted(floors), key=lambda x: floors[x])
    rule = "expected" if floors[floor] > plain["f05"] else "threshold"
    return {"rule": rule, "threshold": threshold, "floor": floor, "f05": max(plain["f05"], floors[floor]), "evaluation": plain}


def _first_stage(settings: dict) -> dict:
    """What the fold models depend on: equal in two runs, they are taken over."""
    return {k: v for k, v in settings.items() if k != "stage2"}


def train(pairs: DataFrame, refs: DataFrame, queries: DataFrame, truth: DataFrame, path: str, settings: Settings, save_meta: str | None = None) -> Meta:
    """Fits both stages on (q, s1, PAIR_FEATURES) and writes models to ``path``; returns the metadata.

    refs: (s1); queries: (q, is_s3, name_key, addr_clean); truth: (q, s1). Queries that touch a validation reference
    are kept out of training. Half of them stop the boosting, the other half choose rule and stage.
    """
    spark = pairs.sparkSession
    split = validation_split(refs, queries, pairs, truth, settings.val_share, settings.train_share, settings.seed)
    split = split.withColumn("fold", query_fold(F.xxhash64("q"), settings.folds))
    labelled = pairs.join(truth.withColumn("label", F.lit(1.0)), ["q", "s1"], "left").withColumn("label", F.coalesce("label", F.lit(0.0))).join(split, "q")
    labelled = labelled.withColumn("held", (F.col("part") == "val") & (F.pmod(F.xxhash64("q"), F.lit(2)) == 0))
    base = f"{path}/labelled"
    labelled.write.mode("overwrite").parquet(base)
    labelled = spark.read.parquet(base)

    def saved(df: DataFrame, columns: list[str], learns: dict[str, Column]) -> list[GBTClassificationModel]:
        models = fit(df, columns, settings, list(learns.values()))
        for name, model in zip(learns, models, strict=True):
            model.write().overwrite().save(f"{path}/{name}")
        return models

    trained = F.col("part") == "train"
    old = load_meta(spark, save_meta) if save_meta and store.exists(spark, save_meta) else None
    if old and _first_stage(old.settings) == _first_stage(asdict(settings)):
        stage1 = [GBTClassificationModel.load(f"{path}/stage1_fold{k}") for k in range(settings.folds)]
    else:  # fold k's model learns from queries of fold k; train rows are then scored by the others
        stage1 = saved(labelled, settings.columns, {f"stage1_fold{k}": trained & (F.col("fold") == k) for k in range(settings.folds)})
    p1 = score(stage1, labelled, settings.columns, by_fold=True).join(queries.select("q", F.col("is_s3").alias("s3")), "q")
    choose = (F.col("part") == "val") & ~F.col("held")
    val_refs = refs.join(labelled.where(choose).select("s1").distinct(), "s1", "left_semi")
    val_truth = truth.join(split.where("part = 'val'").select("q"), "q", "left_semi")
    plain = lambda df: df.where(choose).select("q", "s1", "p", F.col("s3").alias("is_s3"))
    stages = {"stage1": best_rule(plain(p1), val_refs, val_truth)}
    use2 = False
    if settings.stage2:
        grouped = features.group_features(p1.select("q", "s1", "p", F.col("s3").alias("is_s3")), queries)
        both = p1.drop("p", "s3", "is_s3").join(grouped, ["q", "s1"])
        both = both.select(*(F.col(c).cast("double").alias(c) if t == "boolean" and c != "held" else F.col(c) for c, t in both.dtypes))
        columns2 = settings.columns + features.GROUP_FEATURES
        p2 = score(saved(both, columns2, {"stage2": trained}), both, columns2).withColumn("s3", F.col("is_s3") == 1)
        stages["stage2"] = best_rule(plain(p2), val_refs, val_truth)
        use2 = stages["stage2"]["f05"] > stages["stage1"]["f05"]
    chosen = stages["stage2" if use2 else "stage1"]
    n = queries.agg(F.count("*")).first()[0], truth.agg(F.count("*")).first()[0], refs.agg(F.count("*")).first()[0]
    meta = Meta(asdict(settings), time.strftime("%Y%m%d%H%M%S"), use2, chosen["rule"], chosen["threshold"], chosen["floor"], stages, n[1] / max(1, n[0]), n[1] / max(1, n[2]))
    if save_meta:
        store.save_json(spark, asdict(meta), save_meta)
    return meta


def load_meta(spark: SparkSession, path: str) -> Meta:
    return Meta(**store.load_json(spark, path))


def load_models(spark: SparkSession, path: str, meta: Meta) -> tuple[list[GBTClassificationModel], GBTClassificationModel | None]:
    stage1 = [GBTClassificationModel.load(f"{path}/stage1_fold{k}") for k in range(meta.settings["folds"])]
    return stage1, GBTClassificationModel.load(f"{path}/stage2") if meta.settings["stage2"] else None


def importances(model: GBTClassificationModel, columns: list[str], most: int = 15) -> list[tuple[str, float]]:
    values = model.featureImportances.toArray()
    return sorted(zip(columns, map(float, values), strict=True), key=lambda x: -x[1])[:most]


def score_all(pairs: DataFrame, queries: DataFrame, path: str, meta: Meta) -> DataFrame:
    """(q, s1, is_s3, p1, p2, model_id): the fold models' mean, and the second stage's answer (p1 again without one)."""
    settings = Settings(**meta.settings)
    stage1, stage2 = load_models(pairs.sparkSession, path, meta)
    scored = score(stage1, pairs, settings.columns).withColumn("s3", F.col("is_s3") == 1)
    if stage2 is None:
        out = scored.select("q", "s1", F.col("s3").alias("is_s3"), F.col("p").alias("p1"), F.col("p").alias("p2"))
    else:
        grouped = features.group_features(scored.select("q", "s1", "p", F.col("s3").alias("is_s3")), queries)
        both = scored.drop("p", "s3", "is_s3").join(grouped, ["q", "s1"])
        both = both.select(*(F.col(c).cast("double").alias(c) if t == "boolean" else F.col(c) for c, t in both.dtypes)).drop("p")
        second = score([stage2], both, settings.columns + features.GROUP_FEATURES)
        out = second.select("q", "s1", (F.col("is_s3") == 1).alias("is_s3"), "p1", F.col("p").alias("p2"))
    return out.withColumn("model_id", F.lit(meta.model_id))


def choose(scores: DataFrame, n_refs: int, n_queries: int, meta: Meta, prob: str = "auto", threshold: float | None = None, prior: str | float | None = None) -> DataFrame:
    """(q, s1, p, is_s3) of the chosen matches. prob: auto, p1 or p2. With ``threshold`` or a set ``prob`` the rule is a threshold."""
    use2 = meta.use_stage2 if prob == "auto" else prob == "p2"
    out = scores.select("q", "s1", F.col("p2" if use2 else "p1").alias("p"), "is_s3")
    if prior is not None:
        share = decision.auto_prior(meta.matches_per_ref, n_refs, n_queries) if prior == "auto" else float(prior)
        out = out.withColumn("p", decision.prior_shift(F.col("p"), meta.train_prior, share))
    if threshold is None and prob == "auto" and meta.rule == "expected":
        return decision.decide_expected(out, meta.floor)
    at = meta.stages["stage2" if use2 else "stage1"]["threshold"] if threshold is None else threshold
    return decision.decide(out, at)
