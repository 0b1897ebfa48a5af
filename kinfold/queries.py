"""Registered queries of the record-linkage operators, over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import views
from .functions import similarity as sim
from .functions import text as tx
from .operators import aliases, decision, dense, features, metrics, numbering, quality, retrieval, sampling
from .plans import model
from .sources import store, tsv

#: Most rounds of the boosting in gbt_score; it stops earlier where held-out rows tell.
GBT_ROUNDS = 25
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]):
    QUERIES[f"q_{f.__name__}"] = f
    return f


@query
def name_normalize(spark, sf_dir):
    out = tx.normalise(views.raw_records(spark, sf_dir), unicode=False)
    return out.select("entity_id", "name_clean", "name_key", tx.squashed("name_key").alias("name_squashed"), "name_native")


@query
def address_normalize(spark, sf_dir):
    out = tx.normalise(views.raw_records(spark, sf_dir), unicode=False)
    return out.select("entity_id", "country", "addr_clean", "addr_empty", F.array_join(F.transform("nums", lambda x: x.cast("string")), ",").alias("nums"))


@query
def numbers_shared(spark, sf_dir):
    """Number features of each record with the one 97 ids on, which has the same flat number."""
    base = tx.normalise(views.raw_records(spark, sf_dir), unicode=False).select("entity_id", "name_key", "addr_clean", "nums")
    q = base.select(F.col("entity_id").alias("q"), *(F.col(c).alias(f"q_{c}") for c in ("name_key", "addr_clean", "nums")))
    s = base.select((F.col("entity_id") - 97).alias("q"), *(F.col(c).alias(f"s_{c}") for c in ("name_key", "addr_clean", "nums")))
    out = features.number_features(q.join(s, "q"))
    return out.select("q", "num_shared", "num_first_in_q", "num_first_eq", "num_q", "num_s", "len_nk_q", "len_nk_s", "len_ad_q", "len_ad_s")


@query
def unicode_normalize(spark, sf_dir):
    """With the Arrow functions, over whole texts; no SQL form of case folding."""
    return tx.normalise(views.raw_records(spark, sf_dir)).select("entity_id", "name_clean", "name_key", "addr_clean")


@query
def alias_learning(spark, sf_dir):
    """Words of distorted whole texts by place against those of the texts."""
    a = F.split("name_key", " ")
    b = F.split(F.translate("name_key", "oie", "013"), " ")
    zipped = views.whole_texts(spark, sf_dir).select(F.explode(F.arrays_zip(b.alias("b"), a.alias("a"))).alias("z")).select(F.col("z.b").alias("native"), F.col("z.a").alias("latin"))
    return aliases.most_common(zipped, "native", "latin", 2, 0.5).withColumn("share", F.round("share", 9))


def _name_aliases(spark, sf_dir):
    tokens = lambda c: tx.words(tx.punct_to_space(c))
    return aliases.learn_name_aliases(views.native_texts(spark, sf_dir).select(tokens("clean").alias("ref_tokens"), tokens("native").alias("match_tokens")))


def _segment_aliases(spark, sf_dir):
    return aliases.learn_segment_aliases(views.native_texts(spark, sf_dir).select(F.col("clean").alias("ref_clean"), F.col("mixed").alias("match_clean")))


@query
def name_aliases(spark, sf_dir):
    return _name_aliases(spark, sf_dir).withColumn("share", F.round("share", 9))


@query
def segment_aliases(spark, sf_dir):
    return _segment_aliases(spark, sf_dir).withColumn("share", F.round("share", 9))


@query
def dictionary(spark, sf_dir):
    """Names and addresses with native words and segments, normalised with the dictionaries learned from all texts."""
    known = [store.settled(lambda: f(spark, sf_dir).select("native", "latin"), "dictionary") for f in (_name_aliases, _segment_aliases)]  # noqa: B023
    texts = views.native_texts(spark, sf_dir)
    records = texts.select(F.col("doc_id").alias("entity_id"), F.col("native").alias("name"), F.col("mixed").alias("address"), F.col("lang").alias("country"))
    out = tx.normalise(records, *known, unicode=False).select("entity_id", "name_clean", "addr_clean")
    return store.written(out, "normalised", arrow_rows=512)  # whole texts


@query
def gt_explode(spark, sf_dir):
    orders, customer = views.table(spark, sf_dir, "orders"), views.table(spark, sf_dir, "customer")
    lists = orders.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list("o_orderkey")).cast("array<string>"), ", ").alias("matched_entity_ids"))
    pairs = sampling.explode_truth(lists.select(F.col("o_custkey").cast("string").alias("source1_entity_id"), "matched_entity_ids"))
    refs = customer.where("c_custkey % 7 <> 0").select(F.col("c_custkey").cast("string").alias("entity_id"))
    known = orders.where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").cast("string").alias("entity_id"))
    return sampling.truth_vector(pairs, refs, known)


@query
def grouped_output(spark, sf_dir):
    customer, orders = views.table(spark, sf_dir, "customer"), views.table(spark, sf_dir, "orders")
    refs = customer.select(F.col("c_custkey").alias("s1"), F.col("c_name").alias("entity_id"))
    return tsv.grouped_lists(refs, orders.select(F.col("o_custkey").alias("s1"), F.col("o_orderkey").alias("q"), F.col("o_orderkey").cast("string").alias("q_id")))


def _scratch(spark, name):
    return f"{store.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query
def tsv_round_trip(spark, sf_dir):
    """Customers written as a TSV and read again, with empty fields, quotes and backslashes."""
    rows = views.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("entity_id"),
        F.concat(F.lit('"'), F.col("c_name"), F.lit("\\")).alias("business_name"),
        F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment")).alias("business_address"),
        F.lit("null").alias("country"),
    )
    path = _scratch(spark, "tsv")
    tsv.write_table(rows, path)
    return tsv.read_source(spark, path)


def _order_lists(spark, sf_dir):
    """(source1_entity_id, matched_entity_ids): a line for each customer, empty without orders."""
    customer, orders = views.table(spark, sf_dir, "customer"), views.table(spark, sf_dir, "orders")
    refs = customer.select(F.col("c_custkey").alias("s1"), F.concat(F.lit("S1-"), F.col("c_custkey").cast("string")).alias("entity_id"))
    return tsv.grouped_lists(refs, orders.select(F.col("o_custkey").alias("s1"), F.col("o_orderkey").alias("q"), F.concat(F.lit("S2-"), F.col("o_orderkey").cast("string")).alias("q_id")))


@query
def ground_truth_scan(spark, sf_dir):
    """A ground-truth file, written as one TSV, read and exploded."""
    path = _scratch(spark, "truth") + ".tsv"
    tsv.write_file(_order_lists(spark, sf_dir), path)
    return sampling.explode_truth(tsv.read_ground_truth(spark, path))


@query
def read_ids(spark, sf_dir):
    path = _scratch(spark, "ids") + ".tsv"
    tsv.write_file(_order_lists(spark, sf_dir), path)
    return tsv.read_ids(spark, path)


@query
def file_order(spark, sf_dir):
    """Numbers of the lines of a file, which are sorted by no column."""
    path = _scratch(spark, "lines")
    rows = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("entity_id"), F.lit("").alias("business_name"), F.lit("").alias("business_address"), F.col("c_mktsegment").alias("country"))
    tsv.write_file(rows.orderBy(F.md5("entity_id")), path)
    return numbering.numbered(tsv.read_source(spark, path, place=True), "s1", tsv.PLACE, store.written).select("s1", "entity_id", "country")


@query
def numbered(spark, sf_dir):
    """Orders numbered by key as text."""
    rows = views.table(spark, sf_dir, "orders").select(F.concat(F.lit("S1-"), F.col("o_orderkey").cast("string")).alias("entity_id"), "o_orderpriority")
    return numbering.numbered(rows, "s1", ["entity_id"], store.written)


def _idf(ref):
    df = retrieval.document_frequency(retrieval.gram_counts(ref, ["s1"], "name_key"))
    n = ref.agg(F.count("*").alias("n_docs"))
    return df.join(F.broadcast(n)).select("gram", "df", F.round(F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1, 9).alias("idf"))


@query
def gram_idf(spark, sf_dir):
    return _idf(views.whole_texts(spark, sf_dir))


@query
def topk_reverse(spark, sf_dir):
    ref, queries, _ = views.linkage(spark, sf_dir)
    return retrieval.candidates(retrieval.retrieve_exact(ref, queries))


@query
def topk_sketched(spark, sf_dir):
    ref, queries, _ = views.linkage(spark, sf_dir)
    return retrieval.candidates(retrieval.retrieve_sketched(ref, queries), few=True)


@query
def sketch_recall(spark, sf_dir):
    """Shares of the exact candidates, and of each query's exact best by blend, that the sketched retrieval has."""
    ref, queries, _ = views.linkage(spark, sf_dir)
    exact = store.written(retrieval.candidates(retrieval.retrieve_exact(ref, queries)), "exact")
    found = retrieval.candidates(retrieval.retrieve_sketched(ref, queries), few=True).select("q", "s1", F.lit(1).alias("hit"))
    both = exact.join(found, ["q", "s1"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    tied = F.col("comb") == F.col("q_comb1")
    return both.agg(F.count("*").alias("candidates"), F.avg("hit").alias("recall"), F.avg(F.when(tied, F.col("hit"))).alias("recall_of_best"))


def _featured(spark, sf_dir, exact=True):
    """(pair features, queries, truth) of the candidates of the exact or the sketched retrieval, which are written once."""
    ref, queries, truth = views.linkage(spark, sf_dir)
    more = {"name_clean": F.col("name_key"), "nums": tx.encode_numbers(tx.address_numbers(tx.words("addr_clean"))), "name_native": F.lit(False)}
    ref, queries = ref.withColumns(more), queries.withColumns(more)
    retrieve = retrieval.retrieve_exact if exact else retrieval.retrieve_sketched
    pairs = retrieve(ref.select("s1", "country", "name_key", "addr_clean"), queries.select("q", "country", "name_key", "addr_clean", "addr_empty"))
    cands = store.written(retrieval.candidates(pairs, few=not exact), "candidates")
    return features.pair_features(cands, ref, queries), queries, truth


@query
def pair_features(spark, sf_dir):
    out = _featured(spark, sf_dir)[0].drop(*retrieval.ADDRESS_SCORES)
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c[:3] in ("nk_", "nc_", "sq_")})


@query
def address_scores(spark, sf_dir):
    """The pair features that have no SQL, scorers of long strings, of the sketched candidates: each query's best by channel, as the search leaves them."""
    ref, queries, _ = views.linkage(spark, sf_dir)
    return store.written(retrieval.retrieve_sketched(ref, queries, address_scores=True).select("q", "s1", *retrieval.ADDRESS_SCORES), "candidates")


@query
def gbt_score(spark, sf_dir):
    """Out-of-fold scores of two boosted models, each fitted on the other half of the queries; a tenth of all only stops the boosting."""

    def labelled_pairs():
        pairs, _, truth = _featured(spark, sf_dir, exact=False)
        labelled = pairs.join(truth.withColumn("label", F.lit(1.0)), ["q", "s1"], "left").withColumn("label", F.coalesce("label", F.lit(0.0)))
        return labelled.withColumns({"fold": sampling.query_fold("q", 2), "part": F.lit("train"), "held": F.pmod(F.xxhash64("q"), F.lit(10)) == 0})

    labelled = store.settled(labelled_pairs, "labelled", arrow_least=1 << 16)  # the retrieval's tables go before anything is fitted
    settings = model.Settings(rounds=GBT_ROUNDS)
    fitted = model.fit(labelled, settings.columns, settings, [F.col("fold") == k for k in range(2)])
    return model.score(fitted, labelled, settings.columns, by_fold=True).select("q", "s1", "label", F.round("p", 6).alias("p"))


@query
def topk_dense(spark, sf_dir):
    """The three nearest vectors of the same label by cosine, for every vector."""
    return dense.nearest_of_label(views.table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"), 3)


def _string_pairs(spark, sf_dir):
    """(a, b): all pairs of a reference's and a query's name in one country."""
    ref, queries, _ = views.linkage(spark, sf_dir)
    names = lambda df, c: df.select("country", F.col("name_key").alias(c)).distinct()
    return names(ref, "a").join(names(queries, "b"), "country").select("a", "b").distinct()


@query
def string_distances(spark, sf_dir):
    a, b = F.split("a", " "), F.split("b", " ")
    jaccard = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    return _string_pairs(spark, sf_dir).select("a", "b", F.levenshtein("a", "b").alias("edits"), F.round(sim.col_jaro_winkler("a", "b"), 6).alias("jaro_winkler"), F.round(jaccard, 6).alias("token_jaccard"))


@query
def ratio_family(spark, sf_dir):
    scores = {"ratio": sim.col_ratio, "token_set": sim.col_token_set, "token_sort": sim.col_token_sort, "partial": sim.col_partial}
    return _string_pairs(spark, sf_dir).select("a", "b", *(F.round(f("a", "b"), 6).alias(c) for c, f in scores.items()))


@query
def competition(spark, sf_dir):
    pairs, _, _ = views.scored(spark, sf_dir)
    comb = pairs.withColumns({"comb": F.col("p"), "sn": F.col("p") * F.col("p"), "sa": 1 - F.col("p")})
    out = features.competition(comb.join(retrieval.query_stats(comb), "q"))
    return out.select("q", "s1", "rank_q", "n_q", "rank_s1", "n_s1", "is_top", "s1_top_s2", "s1_top_s3", "gap_best", "margin_other", "sn_gap", "sa_gap")


@query
def group_features(spark, sf_dir):
    """With the strings of the strongest other claimant: an order's priority as its name, its date as its address."""
    records = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("q"), F.lower("o_orderpriority").alias("name_key"), F.date_format("o_orderdate", "yyyy MM dd").alias("addr_clean"))
    out = features.group_features(views.scored(spark, sf_dir)[0], records).drop("p1")
    return out.withColumns({c: F.round(c, 6) for c in ("g_s1_sum_other", "g_other_nk_ratio", "g_other_nk_tset", "g_other_ad_tset")})


@query
def decide_threshold(spark, sf_dir):
    return decision.decide(views.scored(spark, sf_dir)[0], 0.6)


@query
def decide_expected(spark, sf_dir):
    return decision.decide_expected(views.scored(spark, sf_dir)[0], 0.1)


@query
def caps(spark, sf_dir):
    return decision.apply_caps(views.scored(spark, sf_dir)[0])


@query
def sweep(spark, sf_dir):
    pairs, truth, refs = views.scored(spark, sf_dir)
    return decision.sweep(pairs, refs, truth).withColumn("f05", F.round("f05", 9))


@query
def sweep_expected(spark, sf_dir):
    """The floors of the expected-F rule over all scored pairs."""
    pairs, truth, refs = views.scored(spark, sf_dir)
    return decision.sweep_expected(pairs, refs, truth).withColumn("f05", F.round("f05", 9))


@query
def choose(spark, sf_dir):
    """Matches of scored pairs as a run chooses them: the second stage's scores, the prior of the scored table, the threshold rule with caps."""
    pairs, truth, refs = views.scored(spark, sf_dir)
    scores = pairs.select("q", "s1", "is_s3", (F.col("p") * F.col("p")).alias("p1"), F.col("p").alias("p2"))
    n_refs, n_queries, n_true = refs.count(), pairs.select("q").distinct().count(), truth.count()
    meta = model.Meta({}, "", use_stage2=True, threshold=0.6, stages={"stage2": {"threshold": 0.6}}, train_prior=0.7, matches_per_ref=0.9 * n_true / n_refs)
    return model.choose(scores, n_refs, n_queries, meta, prior="auto").withColumn("p", F.round("p", 9))


@query
def prior_shift(spark, sf_dir):
    pairs, _, _ = views.scored(spark, sf_dir)
    return pairs.select("q", "s1", F.round(decision.prior_shift(F.col("p"), 0.74, 0.6), 9).alias("p"))


@query
def best_p(spark, sf_dir):
    best = decision.best_pairs(views.scored(spark, sf_dir)[0])
    return best.agg(F.round(F.avg("p"), 9).alias("mean_best_p"), F.round(F.avg((F.col("p") >= 0.5).cast("int")), 9).alias("sure_share"), F.count_distinct("s1").alias("refs_claimed"))


@query
def f05(spark, sf_dir):
    pairs, truth, refs = views.scored(spark, sf_dir)
    return metrics.per_ref_f05(decision.decide(pairs, 0.6), refs, truth).withColumn("f05", F.round("f05", 9))


@query
def evaluate(spark, sf_dir):
    pairs, truth, refs = views.scored(spark, sf_dir)
    out = metrics.evaluate(decision.decide(pairs, 0.6), refs, truth)
    return out.select("pred_pairs", *(F.round(c, 9).alias(c) for c in ("f05", "f05_zero", "f05_single", "f05_multi")))


@query
def oracle_f05(spark, sf_dir):
    pairs, truth, refs = views.scored(spark, sf_dir)
    return metrics.oracle_f05(pairs.where("p >= 0.3"), refs, truth).withColumn("f05", F.round("f05", 9))


@query
def candidate_report(spark, sf_dir):
    pairs, truth, refs = views.scored(spark, sf_dir)
    queries = pairs.select("q", "is_s3").distinct()
    out = metrics.candidate_report(pairs.where("p >= 0.3"), refs, truth, queries)
    return out.select(*(F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))


@query
def query_fold(spark, sf_dir):
    return views.table(spark, sf_dir, "orders").select("o_orderkey", *(sampling.query_fold("o_orderkey", n).alias(f"fold{n}") for n in (2, 3, 5)))


@query
def sample(spark, sf_dir):
    orders = views.table(spark, sf_dir, "orders")
    lists = orders.where("o_orderkey % 3 <> 0").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list("o_orderkey")).cast("array<string>"), ",").alias("matched_entity_ids"))
    truth = lists.select(F.col("o_custkey").cast("string").alias("source1_entity_id"), "matched_entity_ids")
    refs = views.table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("entity_id"))
    kept, s1, q = sampling.sample(truth, refs, orders.select(F.col("o_orderkey").cast("string").alias("entity_id")), 0.2)
    return s1.select(F.lit("s1").alias("part"), "entity_id").unionByName(q.select(F.lit("q").alias("part"), "entity_id"))


@query
def validation_split(spark, sf_dir):
    pairs, truth, refs = views.scored(spark, sf_dir)
    return sampling.validation_split(refs, pairs.select("q").distinct(), pairs.where("p >= 0.8"), truth, 0.05, 0.35)


def _submission(spark, sf_dir):
    """Result lines of all customers with planted errors, as parsed rows."""
    customer, orders = views.table(spark, sf_dir, "customer"), views.table(spark, sf_dir, "orders")
    tag = F.when(F.col("o_orderkey") % 97 == 0, "S1-").when(F.col("o_orderkey") % 89 == 0, "X-").when(F.col("o_orderkey") % 2 == 0, "S2-").otherwise("S3-")
    ids = orders.withColumn("id", F.concat(tag, F.col("o_orderkey").cast("string"))).withColumn("id", F.explode(F.when(F.col("o_orderkey") % 101 == 0, F.array("id", "id")).otherwise(F.array("id"))))
    lists = ids.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("l"))
    rows = customer.where("c_custkey % 50 <> 7").join(lists, "c_custkey", "left")
    line = F.when(F.col("c_custkey") % 40 == 3, F.col("c_name")).otherwise(F.concat(F.lit("S1-"), F.col("c_custkey").cast("string"), F.lit("\t"), F.coalesce("l", F.lit(""))))
    lines = rows.select(F.explode(F.when(F.col("c_custkey") % 60 == 11, F.array(line, line)).otherwise(F.array(line))).alias("line"))
    required = customer.where("c_custkey % 45 <> 1").select(F.concat(F.lit("S1-"), F.col("c_custkey").cast("string")).alias("id"))
    valid = orders.where("o_orderkey % 31 <> 0").select(F.explode(F.array(F.lit("S2-"), F.lit("S3-"))).alias("t"), "o_orderkey").select(F.concat("t", F.col("o_orderkey").cast("string")).alias("id"))
    return quality.list_rows(lines), required, valid


@query
def validate_submission(spark, sf_dir):
    out = quality.findings(*_submission(spark, sf_dir))
    return out.select("rule", "n", F.array_join("examples", ",").alias("examples"))


@query
def not_candidates(spark, sf_dir):
    rows, _, _ = _submission(spark, sf_dir)
    candidate = rows.select("s1", F.filter("ids", lambda x: ~x.rlike("7$")).alias("ids"), "malformed").dropDuplicates(["s1"])
    return quality.not_candidates(rows, candidate).select("s1", F.array_join("extra", ",").alias("extra"))
