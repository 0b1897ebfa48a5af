"""URL filter, sharding, mixing, packing."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from kinfold.llm import mixing, packing, sharding
from kinfold.llm.queries import QUERIES, SOURCE_WEIGHTS, URL_RULES
from kinfold.llm.url_filter import filter_urls


def url_rows(spark, urls, labels=(), **options):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    good = spark.createDataFrame(list(labels), "key long, good boolean")
    return {r["page_id"]: r for r in filter_urls(pages, good, URL_RULES, label_key=F.col("page_id"), **options).collect()}


def test_hosts_paths_and_rules(spark):
    urls = ["http://WWW.Example.com/en/1?x=/q", "https://example.com/en/", "ftp://a.example.com/fr#top", "http://b.net/es/1", "http://net/fr/", "nothing", None, "http://xnet/es/", "http://com?a", "a://b://c/d", "://É.com/", "http://org/Ä?"]
    got = url_rows(spark, urls)
    want = [
        ("www.example.com", "/en/1", "www.example.com/en/", "allow"), ("example.com", "/en/", "example.com/en/", "block"), ("a.example.com", "/fr", "com/", "allow"),
        ("b.net", "/es/1", "net/es/", "block"), ("net", "/fr/", "net/fr/", "block"), ("", "", None, "allow"), ("", "", None, "allow"), ("xnet", "/es/", None, "allow"),
        ("com", "", None, "allow"), ("b:", "//c/d", None, "allow"), ("É.com", "/", "com/", "allow"), ("org", "/Ä", None, "allow"),
    ]
    assert [tuple(got[i][c] for c in ("host", "path", "rule", "verdict")) for i in range(len(urls))] == want


def test_templates_merge_and_bad_ones_are_blocked(spark):
    urls, labels = [], []
    for i in range(400):
        part = ("news", "blog", "spam", "junk")[i % 4]
        urls.append(f"http://h.org/{part}/{i}.html")
        labels.append((i, part in ("news", "blog")))
    urls += [f"http://h.org/news/slug-{chr(97 + i % 26)}{chr(97 + i // 26)}{'x' * (i % 7)}/end" for i in range(300)]
    got = url_rows(spark, urls, labels)
    by = defaultdict(set)
    for r in got.values():
        by[r["template"]].add(r["verdict"])
    assert by["/{junk|spam}/*.html"] == {"block"} and by["/{blog|news}/*"] == by["/{blog|news}/*/end"] == {"allow"}
    assert all(got[i]["verdict"] == ("allow" if i % 4 < 2 else "block") for i in range(400))
    assert all(got[i]["verdict"] == "allow" and got[i]["template"].count("*") for i in range(400, 700))


def test_url_edges(spark):
    assert url_rows(spark, []) == {}
    deep = "http://h.org/" + "/".join(f"s{'abcdefghij'[i % 10]}" for i in range(3000))
    got = url_rows(spark, [deep, deep, "http://h.org/"], [(0, None), (1, False), (1, True)])
    assert len(got) == 3 and got[0]["template"] == got[1]["template"]
    pages = spark.createDataFrame([(1, "http://a.org/x", "kept", "old")], "page_id long, url string, extra string, verdict string")
    row = filter_urls(pages, spark.createDataFrame([], "key long, good boolean"), []).first()
    assert row["extra"] == "kept" and row["verdict"] == "allow" and row["rule"] is None


# --- sharding


def walk_by_key(counts, nodes, shards, room):
    """Places keys one by one: own shard first for all, then clockwise for those that found it full."""
    places, filled, out, waiting = [p for p, _ in nodes], [0] * shards, {}, []
    after = lambda p: next((i for i, x in enumerate(places) if x >= p), 0)
    for p in sorted(counts):
        for k in range(counts[p]):
            s = nodes[after(p)][1]
            if filled[s] < room[s]:
                out[p, k] = (s, filled[s])
                filled[s] += 1
            else:
                waiting.append((p, k))
    for p, k in waiting:
        i = after(p)
        while filled[nodes[i % len(nodes)][1]] >= room[nodes[i % len(nodes)][1]]:
            i += 1
        s = nodes[i % len(nodes)][1]
        out[p, k] = (s, filled[s])
        filled[s] += 1
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_walk_against_one_key_at_a_time(seed):
    rng = random.Random(seed)
    nodes = sharding.virtual_nodes(5, 4, 200)
    counts = {p: rng.randrange(1, 9) for p in rng.sample(range(200), 60)}
    counts[77] = 150  # a hot place
    runs = sharding.bounded_walk(counts, nodes, 5)
    got = {(p, lo + i): (s, start + i) for p, lo, hi, s, start in runs for i in range(hi - lo)}
    room = [sum(1 for v, _ in got.values() if v == s) for s in range(5)]
    assert max(room) - min(room) <= 1 and sum(room) == sum(counts.values())
    assert got == walk_by_key(counts, nodes, 5, room)


def test_new_shard_leaves_the_nodes_of_others():
    assert set(sharding.virtual_nodes(6, 8, 1 << 20)) - set(sharding.virtual_nodes(7, 8, 1 << 20)) == set()


def test_shards_are_even_and_slots_gapless(spark):
    rows = [(i if i % 3 else 7, i % 11, "x") for i in range(2000)] + [(None, 1, "n"), (None, 1, "n")]
    df = spark.createDataFrame(rows, "doc_id long, size long, slot string").withColumns({"rank": F.lit(1), "runs": F.lit(2), "before": F.lit(3)}).repartition(5)
    got = sharding.shard(df, 16, tie_cols=("size",)).collect()
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert len(got) == 2002 and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    again = sharding.shard(df.coalesce(1), 16, tie_cols=("size",)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert sharding.shard(df.limit(0), 16).count() == 0
    assert sharding.shard(df.limit(3), 16).count() == 3


# --- mixing


def test_poisson_counts_have_the_right_distribution(spark):
    rates = spark.createDataFrame([("a", 0.3), ("b", 2.5), ("c", 900.0), ("d", 0.0)], "key string, rate double")
    for r in mixing.poisson_tables(rates).collect():
        total, mass = 0.0, math.exp(-r["rate"])
        for k, c in enumerate(r["cdf"][:40]):
            total += mass
            mass *= r["rate"] / (k + 1)
            assert c == pytest.approx(total, abs=1e-9)
        assert r["cdf"][-1] == pytest.approx(1.0, abs=1e-9)


def test_mixture_has_the_target_weights(spark):
    rng = random.Random(1)
    sources = ["src0"] * 3000 + ["src1"] * 500 + ["other"] * 1500 + [None] * 500
    df = spark.createDataFrame([(i, s, "x" * rng.randrange(50, 150)) for i, s in enumerate(sources)], "doc_id long, source string, text string")
    got = mixing.poisson_mix(df, SOURCE_WEIGHTS).collect()
    size = Counter()
    for r in got:
        size[r["source"]] += len(r["text"])
    total = sum(size.values())
    for s, w in (("src0", 6), ("src1", 2), ("other", 1), (None, 1)):
        assert size[s] / total == pytest.approx(w / 10, abs=0.03)
    copies = Counter(r["doc_id"] for r in got)
    assert all(r["copies"] == copies[r["doc_id"]] and 1 <= r["copy"] <= r["copies"] for r in got)
    keys = [r["shuffle_key"] for r in got]
    assert len(set(keys)) == len(keys)
    again = mixing.poisson_mix(df.repartition(7), SOURCE_WEIGHTS).collect()
    assert {(r["doc_id"], r["copy"]) for r in got} == {(r["doc_id"], r["copy"]) for r in again}


def test_mixing_edges(spark):
    df = spark.createDataFrame([(1, "a", None, 5), (1, "a", None, 6), (None, None, "", 7)], "doc_id long, source string, text string, copies int")
    got = mixing.poisson_mix(df, {}, epochs=4.0).collect()
    assert all(r["source"] in ("a", None) for r in got) and len({r["copies"] for r in got if r["doc_id"] == 1}) <= 1
    assert mixing.poisson_mix(df.limit(0), SOURCE_WEIGHTS).count() == 0


def test_high_rates(spark):
    rates = spark.createDataFrame([("a", 1e6), ("b", 3e9), ("c", 40.0)], "key string, rate double")
    docs = spark.range(400).selectExpr("id as doc_id", "case when id < 2 then 'b' when id < 200 then 'a' else 'c' end as k")
    got = defaultdict(list)
    for r in mixing.poisson_counts(docs, rates, 5, "doc_id", "k").collect():
        got[r["k"]].append(r["copies"])
    # means within 5 standard errors, spreads near the root of the rate
    for k, rate in (("a", 1e6), ("c", 40.0)):
        n, mean = len(got[k]), sum(got[k]) / len(got[k])
        assert abs(mean - rate) < 5 * math.sqrt(rate / n)
        assert 0.7 < math.sqrt(sum((x - mean) ** 2 for x in got[k]) / n / rate) < 1.3
    assert len(got["b"]) == 2 and all(abs(x - 3e9) < 8 * math.sqrt(3e9) for x in got["b"])
    # parts of a rate add up to the same distribution
    parts = [r["copies"] for r in mixing.poisson_counts(docs.where("k = 'c'"), rates, 5, "doc_id", "k", part_rate=7.0).collect()]
    assert len(parts) == 200 and abs(sum(parts) / 200 - 40) < 5 * math.sqrt(40 / 200)


def test_a_tiny_source_and_many_sources(spark):
    rows = [(0, "tiny", "ab")] + [(i, f"s{i % 300}", "x" * 400) for i in range(1, 3001)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.poisson_mix(df, {"tiny": 40.0}).groupBy("source").agg(F.count("*").alias("n"), F.max("copies").alias("most"), F.sum(F.length("text")).alias("size")).collect()
    assert len(got) == 301
    tiny = next(r for r in got if r["source"] == "tiny")
    rate = 40 / 340 * sum(len(t) for _, _, t in rows) / 2
    assert tiny["n"] == tiny["most"] and abs(tiny["n"] - rate) < 6 * math.sqrt(rate)


# --- packing


def plain_best_fit(lengths, sizes, overhead, quadratic):
    bins, room, filled, out = [], [], [], []
    for i, n in enumerate(lengths):
        fit = [b for b in range(len(bins)) if room[b] >= n]
        if fit:
            least = min(room[b] for b in fit)
            b = max((b for b in fit if room[b] == least), key=lambda b: bins[b])
        else:
            def unit(s):
                gap = s - n
                rest = sum(x for x in lengths[i + 1 :] if x <= gap)
                return packing.size_cost(s, overhead, quadratic) / (n + min(gap, rest)), s

            b = len(bins)
            room.append(min((s for s in sizes if s >= n), key=unit))
            bins.append(0)
            filled.append(0)
        room[b] -= n
        bins[b] = i + 1  # when it was last changed
        filled[b] += n
        out.append(b)
    return out, [min(s for s in sizes if s >= f) for f in filled]


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_against_the_plain_form(seed):
    rng = random.Random(seed)
    sizes = [64, 128, 256]
    lengths = sorted((rng.choice((rng.randrange(1, 257), rng.randrange(1, 20))) for _ in range(rng.randrange(1, 120))), reverse=True)
    assert packing.best_fit(lengths, sizes, 8, 300) == plain_best_fit(lengths, sizes, 8, 300)


def test_packing_is_whole(spark):
    rng = random.Random(2)
    rows = [(i % 90, "é" * rng.choice((0, 3, 40, 200, 700))) for i in range(300)] + [(1, None), (None, "abc"), (None, "abc"), (2**60 + 1, "abcd")] + [(5, "same")] * 700
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bin", F.lit("clash"))
    got = packing.pack(df, sizes=(64, 128, 256), group_pieces=200).collect()
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"], r["doc_bytes"], r["copy"]].append((r["start"], r["length"]))
        if r["bin"] is not None:
            bins[r["bin"], r["bin_size"]].append((r["position"], r["length"]))
    for (_, n, _), parts in pieces.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == n
    have = Counter((d, len((t or "").encode())) for d, t in rows)
    assert Counter((d, n) for d, n, _ in pieces) == have
    assert len({b for b, _ in bins}) == len(bins)
    for (_, size), parts in bins.items():
        used = sum(n for _, n in parts)
        assert used <= size and not any(used <= s < size for s in (64, 128, 256))
        assert sorted(p for p, _ in parts) == list(range(len(parts)))
    assert all((r["bin"] is None) == (r["length"] == 0) == (r["bin_size"] == 0) for r in got)
    assert packing.pack(df.limit(0)).count() == 0


def test_pieces_are_cut_between_characters():
    for text in ("aé日𝔘" * 50, "x" * 129, "𝔘" * 40, "", "é" * 32):
        raw = text.encode()
        starts = packing.piece_starts(raw, 64)
        cut = [raw[a:b].decode() for a, b in zip(starts, [*starts[1:], len(raw)], strict=True)]
        assert "".join(cut) == text and all(61 <= len(c.encode()) <= 64 for c in cut[:-1]) and len(cut[-1].encode()) <= 64


def plainly_packed(texts, sizes=(4096, 8192, 16384, 32768), overhead=256, quadratic=65536):
    """Bins as sorted lists of (id, piece), and their sizes, of texts that make one group."""
    pieces = []
    for d, t in texts:
        raw = (t or "").encode()
        starts = packing.piece_starts(raw, max(sizes))
        pieces += [(b - a, str(d), d, k) for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(raw)], strict=True)) if b > a]
    pieces.sort(key=lambda p: (-p[0], p[1], p[3]))
    bins, final = plain_best_fit([p[0] for p in pieces], sorted(sizes), overhead, quadratic)
    out = defaultdict(list)
    for (_, _, d, k), b in zip(pieces, bins, strict=True):
        out[b].append((d, k))
    return sorted((sorted(v), final[b]) for b, v in out.items())


def test_packing_query_against_the_plain_form(spark, sf_dir):
    texts = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    bins = defaultdict(list)
    got = QUERIES["op2_best_fit_packing"](spark, sf_dir).collect()
    for r in got:
        if r["bin"] is not None:
            bins[r["bin"], r["bin_size"]].append((r["doc_id"], r["piece"]))
    assert sorted((sorted(v), size) for (_, size), v in bins.items()) == plainly_packed(texts)
    assert Counter(r["doc_id"] for r in got if r["piece"] == 0) == Counter(d for d, _ in texts)


def test_sequences_hold_the_texts(spark):
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice("aé日𝔘 ") for _ in range(rng.choice((0, 5, 30, 90))))) for i in range(60)] + [(None, "null id"), (7, None), (7, "other of seven"), (7, "other of seven"), (7, "alter of seven")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("content", F.lit("clash"))
    sizes = (64, 128)
    packed = packing.pack(df, sizes=sizes, group_pieces=40)
    bins = packing.sequences(df, packed, sizes).collect()
    seen = []
    for r in bins:
        raw = r["text"].encode()
        assert r["n_bytes"] == len(raw) <= r["bin_size"] and r["offsets"] == sorted(set(r["offsets"])) and r["offsets"][0] == 0
        seen += [(d, raw[a:b].decode()) for d, a, b in zip(r["ids"], r["offsets"], [*r["offsets"][1:], len(raw)], strict=True)]
    want = []
    for d, t in rows:
        raw = (t or "").encode()
        starts = packing.piece_starts(raw, 128)
        want += [(d, raw[a:b].decode()) for a, b in zip(starts, [*starts[1:], len(raw)], strict=True) if b > a]
    assert Counter(seen) == Counter(want)
    assert packing.sequences(df.limit(0), packing.pack(df.limit(0), sizes=sizes), sizes).count() == 0


def test_sharding_query_against_one_key_at_a_time(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text"), F.lit(""))
    size, crc = (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc")
    keyed = docs.select("doc_id", size, crc).withColumns({"place": F.pmod(F.xxhash64("doc_id"), F.lit(1 << 16)), "h": F.xxhash64("doc_id"), "salt": F.pmod(F.hash("doc_id", "size", "crc"), F.lit(16))})
    places = defaultdict(list)
    for r in keyed.collect():
        places[r["place"]].append((r["salt"], r["h"], r["doc_id"]))
    nodes = sharding.virtual_nodes(16, 128, 1 << 16)
    own = Counter(nodes[next((i for i, (p, _) in enumerate(nodes) if p >= place), 0)][1] for place, v in places.items() for _ in v)
    total = sum(map(len, places.values()))
    extra = set(sorted(range(16), key=lambda s: (-own[s], s))[: total % 16])
    walked = walk_by_key({p: len(v) for p, v in places.items()}, nodes, 16, [total // 16 + (s in extra) for s in range(16)])
    want = {(sorted(places[p])[k][2], *place) for (p, k), place in walked.items()}
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in QUERIES["op10_consistent_ring"](spark, sf_dir).collect()} == want


def test_movement_with_one_shard_more(spark):
    df = spark.range(100_000).withColumnRenamed("id", "doc_id")
    one, two = (sharding.shard(df, n).select("doc_id", F.col("shard").alias(f"s{n}")) for n in (16, 17))
    moved = one.join(two, "doc_id").agg(F.avg((F.col("s16") != F.col("s17")).cast("int")), F.avg(((F.col("s16") != F.col("s17")) & (F.col("s17") != 16)).cast("int"))).first()
    # 1/17 = 5.9 % have to move; the bound moves some between the old shards as well
    assert 0.058 < moved[0] < 0.10 and moved[1] < 0.04
