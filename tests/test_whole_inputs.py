"""Queries that take in all rows and whole texts."""

from kinfold import views
from kinfold.queries import QUERIES


def test_expected_rule_sees_likely_pairs(spark, sf_dir):
    best = {}
    for r in views.scored(spark, sf_dir)[0].collect():
        best[r["q"]] = min(best.get(r["q"], (0, 0)), (-r["p"], r["s1"]))
    kept = QUERIES["q_decide_expected"](spark, sf_dir).collect()
    assert kept and all(best[r["q"]] == (-r["p"], r["s1"]) for r in kept)
    assert max(r["p"] for r in kept) >= 0.7
    assert all(r["f05"] > 0 for r in QUERIES["q_sweep_expected"](spark, sf_dir).collect())


def test_text_queries_take_in_whole_texts(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents").collect()
    longest = max(docs, key=lambda r: len(r["text"] or ""))
    n = len(longest["text"].split())
    assert n > 100
    for name, column in (("q_unicode_normalize", "name_clean"), ("q_unicode_normalize", "addr_clean"), ("q_name_normalize", "name_clean"), ("q_address_normalize", "addr_clean"), ("q_dictionary", "addr_clean")):
        got = {r["entity_id"]: r[column] for r in QUERIES[name](spark, sf_dir).collect()}
        assert len(got) == len(docs) and len(got[longest["doc_id"]].split()) > 0.8 * n
    grams = {r["gram"]: r["df"] for r in QUERIES["q_gram_idf"](spark, sf_dir).collect()}
    assert grams["the"] == sum("the" in (r["text"] or "").lower() for r in docs)


def test_linkage_view_takes_in_whole_tables(spark, sf_dir):
    ref, queries, truth = views.linkage(spark, sf_dir)
    part, supplier = (views.table(spark, sf_dir, t) for t in ("part", "supplier"))
    assert ref.count() == part.count() and queries.count() == 2 * part.count() + supplier.count() and truth.count() == 2 * part.count()
    assert {r["name_key"] for r in ref.collect()} == {r["p_name"].lower() for r in part.collect()}


def test_sketched_candidates_against_the_exact_ones(spark, sf_dir):
    r = QUERIES["q_sketch_recall"](spark, sf_dir).first()
    assert r["candidates"] > 1000 and r["recall"] >= 0.9 and r["recall_of_best"] >= 0.99


def test_address_scores_by_the_definitions(spark, sf_dir):
    from kinfold.functions import similarity as s

    ref, queries, _ = views.linkage(spark, sf_dir)
    a, b = ({r[0]: r["addr_clean"] for r in df.collect()} for df in (queries, ref))
    got = QUERIES["q_address_scores"](spark, sf_dir).collect()
    assert len(got) > 1000
    for r in got:
        x, y = a[r["q"]], b[r["s1"]]
        want = s.ratio(x, y), s.token_set_ratio(x, y), s.token_sort_ratio(x, y), s.partial_ratio(x, y)
        assert all(abs(r[c] - w) < 1e-9 for c, w in zip(("ad_ratio", "ad_tset", "ad_tsort", "ad_partial"), want, strict=True))


def test_unicode_normalisation_by_plain_python(spark, sf_dir):
    """Cleaned names of whole texts against a plain form of the rules."""
    import re
    import unicodedata

    from kinfold.functions import tables

    def clean(text):
        out = unicodedata.normalize("NFKC", text).casefold()
        if not out.isascii():
            out = unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFKD", out) if not 0x300 <= ord(c) <= 0x36F))
        return out

    def tokens(text):
        spelled = re.sub("[&+]", " and ", clean(text))
        kept = "".join(c if unicodedata.category(c)[0] in "LN" or 0x900 <= ord(c) <= 0xDFF else " " for c in spelled)
        return re.sub(r"(?:(?<=^[a-z])|(?<= [a-z])) (?=[a-z](?: |$))", "", " ".join(kept.split())).split(" ")

    def key(text):
        words, folded = [t for t in tokens(text) if t], text.casefold()
        leet = str.maketrans(*tables.LEET)
        some = [t for i, t in enumerate(words) if t not in (*tables.LEGAL_WORDS, *tables.DOMAIN_WORDS) and not (i and t in tables.TOP_LEVEL_DOMAINS and "." + t in folded)]
        fold = lambda t: t.translate(leet) if t.isascii() else t
        return " ".join(t if re.fullmatch("[0-9]+", t) else fold(t) for t in some) if some else " ".join(map(fold, words))

    raw = {r["entity_id"]: r["name"] for r in views.raw_records(spark, sf_dir).collect()}
    for r in QUERIES["q_unicode_normalize"](spark, sf_dir).collect():
        assert r["name_clean"] == " ".join(t for t in tokens(raw[r["entity_id"]]) if t)
        assert r["name_key"] == key(raw[r["entity_id"]])
