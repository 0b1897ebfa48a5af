"""The registered queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut
from .language_id import fit_language_id, identify
from .line_dedup import line_dedup
from .media import sniff, store_texts
from .mixing import poisson_mix
from .ngram_join import ngram_jaccard_join
from .packing import pack
from .sharding import shard
from .tool_calls import link_tool_calls, parse_message
from .topk_search import top_k
from .url_filter import filter_urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Relative weights of the sources in the mixture; the others have 1.
SOURCE_WEIGHTS = {"src0": 6.0, "src1": 2.0, "src2": 2.0}


def op1_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = poisson_mix(docs, SOURCE_WEIGHTS, default_weight=1.0, epochs=1.0, seed=17)
    return mixed.withColumns({c: F.col(c).cast("int") for c in ("copies", "copy")})


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), sizes=(4096, 8192, 16384, 32768))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"), min_words=10)


def op4_media_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sniff(cut(store_texts(_table(spark, sf_dir, "documents")), "media"))


def held_out(doc_id: str) -> Column:
    """Documents that language models are not learned from."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = fit_language_id(docs.where(~held_out("doc_id")).select("text", "lang"), sample_per_language=600)
    return identify(docs.select("doc_id", held_out("doc_id").alias("held_out"), "text"), model, keep_text=False)


#: The tool that the conversations table is read as calls of.
REPLY_SCHEMA = {
    "type": "object",
    "required": ["prompt", "turn"],
    "additionalProperties": False,
    "properties": {
        "prompt": {"type": "string", "minLength": 1, "maxLength": 100_000},
        "turn": {"type": "integer", "minimum": 0},
        "after": {"type": "object", "required": ["$ref"], "properties": {"$ref": {"type": "string"}}},
    },
}


def dialogue_reference(turn: int) -> int | None:
    """The turn that the call of a user's turn refers to. Of three exchanges the first needs the second, the third the second, and the second the third of the three before."""
    step = (2, -4, -2)[turn // 2 % 3]
    return turn + step if turn + step >= 0 else None


def dialogue_events(conv, turn, role: str | None, text: str | None) -> list[tuple]:
    """A user's turn as a call of ``reply`` with a reference to another exchange, before it or after it; an assistant's as the result of the turn before it."""
    if conv is None or turn is None or role not in ("user", "assistant"):
        return parse_message(conv, turn, role, text)
    if role == "assistant":
        return [("result", f"{conv}:{turn - 1}", None, None, text)]
    other = dialogue_reference(turn)
    args = {"prompt": text, "turn": turn} | ({} if other is None else {"after": {"$ref": f"{conv}:{other}"}})
    return [("call", f"{conv}:{turn}", "reply", args, None)]


def op6_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_tool_calls(_table(spark, sf_dir, "conversations"), {"reply": REPLY_SCHEMA}, parse=dialogue_events)


URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op7_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels are those of the document that a url's path names by its number; good is of quality and not toxic."""
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    key = F.regexp_extract("path", r"/([0-9]{1,18})[^/]*/?$", 1).try_cast("bigint")
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, labels, URL_RULES, label_key=key).drop("url")


def op8_nra_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(_table(spark, sf_dir, "documents"), num=75, den=100, size=5)


def op10_consistent_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = shard(rows, 16, tie_cols=("size", "text_crc32"))
    return placed.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_poisson_mixing": op1_poisson_mixing,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_line_dedup": op3_line_dedup,
    "op4_media_sniffing": op4_media_sniffing,
    "op5_language_id": op5_language_id,
    "op6_tool_calls": op6_tool_calls,
    "op7_url_templates": op7_url_templates,
    "op8_nra_topk": op8_nra_topk,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_consistent_ring": op10_consistent_ring,
}

ORACLE_SQL: dict[str, str] = {
    "op1_poisson_mixing": """
with d as (select doc_id, source, text, coalesce('=' || source, '') as key, coalesce(octet_length(encode(text)), 0) as size from documents),
stats as (
  select key, sum(size) as size, case key when '=src0' then 6.0 when '=src1' then 2.0 when '=src2' then 2.0 else 1.0 end::double as weight
  from d group by key),
rates as (
  select key, case when size > 0 then weight / (select sum(weight) from stats) * (select sum(size) from stats)::double / size else 1.0 end as rate from stats),
steps as (
  select key, rate, unnest(range(0, cast(ceil(rate + 12 * sqrt(rate) + 24) as bigint) + 1)) as k from rates),
masses as (
  select key, k, exp(sum(case when k = 0 then -rate else ln(rate / greatest(k, 1)) end) over (partition by key order by k)) as mass from steps),
cdfs as (select key, k, sum(mass) over (partition by key order by k) as cdf from masses),
tables as (select key, list(cdf order by k) as cdf from cdfs group by key),
counted as (
  select d.doc_id, d.source, d.text, len(list_filter(t.cdf, lambda c: c <= ('0x' || substr(md5('17|' || d.doc_id), 1, 13))::bigint / 4503599627370496.0)) as copies
  from d join tables t using (key)),
copied as (select *, unnest(range(1, copies + 1)) as copy from counted where copies > 0)
select doc_id, source, text, copies::int as copies, copy::int as copy, md5('17|shuffle|' || doc_id || '|' || copy) as shuffle_key from copied
""",
    "op3_line_dedup": r"""
with split as (select doc_id, text, string_split(text, chr(10)) as ls from documents),
line as (select doc_id, i, ls[i] as t from split, unnest(range(1, len(ls) + 1)) as u(i)),
seq as (
  select doc_id, i, t, row_number() over (partition by doc_id order by i) as k, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) as w
  from line where regexp_matches(t, '[^\x20\x09-\x0D]')),
ahead as (
  select doc_id, k, list(t) over near as ts, list(w) over near as ws
  from seq window near as (partition by doc_id order by k rows between current row and 9 following)),
run as (
  select doc_id, k, l, array_to_string(list_slice(ts, 1, l), chr(10)) as content
  from ahead, unnest(range(1, len(ws) + 1)) as u(l) where list_sum(list_slice(ws, 1, l)) >= 10),
later as (
  select doc_id, k, l, row_number() over (partition by content order by doc_id, k) as copy from run),
gone as (
  select distinct s.doc_id, s.i from later r join seq s on s.doc_id = r.doc_id and s.k >= r.k and s.k < r.k + r.l where copy > 1)
select s.doc_id, coalesce(len(s.ls), 0) as n_lines, count(g.i) as n_deleted,
  case when s.text is null then null else coalesce(string_agg(l.t, chr(10) order by l.i) filter (g.i is null), '') end as text
from split s left join line l on l.doc_id = s.doc_id left join gone g on g.doc_id = l.doc_id and g.i = l.i
group by s.doc_id, s.text, s.ls
""",
    "op8_nra_topk": """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as x from embeddings
  where embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.x, c.x)::bigint as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.x) = len(c.x) where q.vec_id % 50 = 0),
ranked as (
  select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from scored)
select query_id, rank, vec_id, score from ranked where rank <= 5
""",
    "op9_ngram_jaccard_join": r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
grams as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) end) as g
  from words),
sizes as (select doc_id, count(*) as n from grams group by doc_id),
common_grams as (
  select a.doc_id as x, b.doc_id as y, count(*) as o
  from grams a join grams b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
links as (
  select x, y from common_grams join sizes a on a.doc_id = x join sizes b on b.doc_id = y
  where 100 * o >= 75 * (a.n + b.n - o)),
both_ways as (select x, y from links union all select y, x from links),
reach(doc_id, c) as (
  select doc_id, doc_id from documents
  union select y, c from reach join both_ways on x = doc_id)
select d.doc_id, coalesce(any_value(s.n), 0) as n_shingles, min(r.c) as component_id
from documents d left join sizes s on s.doc_id = d.doc_id join reach r on r.doc_id = d.doc_id
group by d.doc_id
""",
}
