"""SQL of the registered queries for an independent engine, over the driver's tables."""

from __future__ import annotations

from .functions import tables
from .views import LINKAGE_SQL, NATIVE, NATIVE_SQL, RAW_SQL, SCORED_SQL, WHOLE_SQL


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _map(values: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in values.items()) + "}"


def _folded(c: str, values: dict[str, str]) -> str:
    for phrase, code in values.items():
        c = f"regexp_replace({c}, '\\b{phrase}\\b', '{code}', 'g')"
    return c


_SPACED = r"trim(regexp_replace(regexp_replace({}, '[^\p{{L}}\p{{N}}\s\x{{0900}}-\x{{0DFF}}]|_', ' ', 'g'), '\s+', ' ', 'g'))"
_NAMES = rf"""
spelled as (select doc_id, lower(name) as low, {_SPACED.format("regexp_replace(lower(name), '[&+]', ' and ', 'g')")} as s from raw),
marked as (
  select doc_id, low, array_to_string(list_transform(string_split(s, ' '), lambda x: case when regexp_matches(x, '^[a-z]$') then chr(1) || x || chr(1) else x end), ' ') as s from spelled),
tokens as (
  select doc_id, low, list_filter(string_split(replace(replace(s, chr(1) || ' ' || chr(1), ''), chr(1), ''), ' '), lambda x: x <> '') as t from marked),
kept as (
  select doc_id, t, list_filter(t, lambda x, i: not list_contains({_list(tables.LEGAL_WORDS + tables.DOMAIN_WORDS)}, x)
    and not (i > 1 and list_contains({_list(tables.TOP_LEVEL_DOMAINS)}, x) and contains(low, '.' || x))) as k from tokens),
names as (
  select doc_id, array_to_string(t, ' ') as name_clean,
    array_to_string(case when len(k) > 0
      then list_transform(k, lambda x: case when regexp_matches(x, '^[\x00-\x7F]*$') and not regexp_matches(x, '^[0-9]+$') then translate(x, '01l5347', 'oiiseat') else x end)
      else list_transform(t, lambda x: case when regexp_matches(x, '^[\x00-\x7F]*$') then translate(x, '01l5347', 'oiiseat') else x end) end, ' ') as name_key
  from kept)"""
_ADDRESSES = rf"""
glued as (
  select doc_id, lang, regexp_replace(regexp_replace(lower(address), '(\p{{Nd}})([\p{{L}}])', '\1 \2', 'g'), '([\p{{L}}])(\p{{Nd}})', '\1 \2', 'g') as a from raw),
phrased as (select doc_id, lang, {_folded(_SPACED.format("a"), tables.STATE_PHRASES)} as a from glued),
stripped as (
  select doc_id, lang, list_transform(list_filter(string_split(a, ' '), lambda x: x <> ''), lambda x: case when regexp_matches(x, '^[0-9]+$')
    then regexp_replace(x, '^0+([0-9])', '\1') else regexp_replace(x, '^(.+)township$', '\1') end) as t from phrased),
dropped as (select doc_id, lang, list_filter(t, lambda x: not list_contains({_list(tables.ADDRESS_DROP)}, x)) as t from stripped),
stated as (select doc_id, lang, list_transform(t, lambda x: coalesce({_map(tables.STATE_WORDS)}[x], x)) as t from dropped),
short as (select doc_id, lang, list_transform(t, lambda x: coalesce({_map(tables.ADDRESS_SHORT)}[x], x)) as t from stated),
numbered as (
  select doc_id, list_reduce(list_prepend([]::varchar[], list_transform(list_filter(t, lambda x: regexp_matches(x, '^[0-9]+$')), lambda x: [x])),
    lambda a, b: case when list_contains(a, b[1]) then a else list_concat(a, b) end) as n from short),
addresses as (
  select s.doc_id, s.lang, array_to_string(s.t, ' ') as addr_clean, list_transform(list_slice(n.n, 1, 6), lambda x: right(x, 18)::bigint) as nums
  from short s join numbered n on n.doc_id = s.doc_id)"""


def _gram_ctes(name: str, text: str) -> str:
    """CTEs rw_, qw_ (weights of references and queries) and cos_ (cosines) for one text column of the linkage view."""
    out = []
    for side, key, source in (("r", "s1", "ref"), ("q", "q", "query")):
        out.append(f"""
{side}words_{name} as (select {key}, country, unnest(list_filter(string_split({text}, ' '), lambda x: x <> '')) as w from {source}),
{side}grams_{name} as (
  select {key}, country, substr(' ' || w || ' ', i::int, 3) as gram, count(*) as tf from {side}words_{name}, unnest(range(1, len(w) + 1)) as u(i) group by 1, 2, 3)""")
    out.append(f"df_{name} as (select gram, count(*) as df from rgrams_{name} group by gram)")
    for side, key in (("r", "s1"), ("q", "q")):
        out.append(f"""
{side}raw_{name} as (
  select {key}, country, g.gram, ln(1 + tf) * (ln(((select count(*) from ref) + 1.0) / (coalesce(df, 0) + 1)) + 1) as raw
  from {side}grams_{name} g left join df_{name} d on d.gram = g.gram),
{side}w_{name} as (select {key}, country, gram, raw / sqrt(sum(raw * raw) over (partition by {key})) as w from {side}raw_{name})""")
    out.append(f"cos_{name} as (select q, s1, sum(a.w * b.w) as c from qw_{name} a join rw_{name} b on a.country = b.country and a.gram = b.gram group by q, s1)")
    return ",".join(out)


_SCORES = rf"""{_gram_ctes("n", "name_key")},{_gram_ctes("a", "addr_clean")},
both_channels as (
  select q, s1, round(sum(n), 6) as sn, round(sum(a), 6) as sa
  from (select q, s1, c as n, 0.0::double as a from cos_n union all select q, s1, 0.0::double, c from cos_a) group by q, s1),
scores as (
  select b.q, s1, sn, sa, w_name, w_name * sn + (1 - w_name) * sa as comb
  from both_channels b join (select q, case when name_key = '' then 0.0 when addr_clean = '' then 1.0 else 0.5 end::double as w_name from query) w on w.q = b.q)"""
_COUNTS = """
true_n as (select r.s1, count(t.q) as n_true from refs r left join truth t on t.s1 = r.s1 group by r.s1)"""
_BEST = """
best as (select * from pairs qualify row_number() over (partition by q order by p desc, s1) = 1)"""


def _capped(source: str, extra: str = "") -> str:
    return f"select * from {source} qualify row_number() over (partition by {extra} s1, is_s3 order by p desc, q) <= case when is_s3 then 6 else 5 end"


def _f05(predicted: str) -> str:
    return f"""
counts as (
  select s1, count(*) as n_pred, count(*) filter (right_s1) as tp
  from (select k.s1, coalesce(k.s1 = t.s1, false) as right_s1 from {predicted} k left join truth t on t.q = k.q) group by s1),
f as (
  select n.s1, n_true, coalesce(n_pred, 0) as n_pred, coalesce(tp, 0) as tp,
    case when 0.25 * n_true + coalesce(n_pred, 0) > 0 then 1.25 * coalesce(tp, 0) / (0.25 * n_true + coalesce(n_pred, 0)) else 1.0 end::double as f05
  from true_n n left join counts c on c.s1 = n.s1)"""


def _expected(floor: str, source: str, side: str = "") -> str:
    by = f"partition by {side} s1"
    return f"""
claims as (
  select * from {source} qualify row_number() over (partition by {side} q order by p desc, s1) = 1),
masses as (
  select *, sum(least(greatest(p, 0), 1 - 1e-6)) over ({by}) as every, exp(sum(ln(1 - least(greatest(p, 0), 1 - 1e-6))) over ({by})) as none_p from claims),
ordered as (
  select *, row_number() over ({by} order by p desc, q) as k, sum(least(greatest(p, 0), 1 - 1e-6)) over ({by} order by p desc, q rows unbounded preceding) as cum
  from masses where p >= {floor}),
gains as (select *, 1.25 * cum / (0.25 * every + k) as ef from ordered),
tops as (select *, max(ef) over ({by}) as top from gains),
cuts as (select *, min(case when ef >= top - 1e-12 then k end) over ({by}) as cut from tops),
prefix as (select * from cuts where top > none_p and k <= cut)"""


def _lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence: rows of the table, each a running maximum, folded over the characters of ``a``."""
    rows = f"list_transform(string_split({a}, ''), lambda x: list_transform(string_split({b}, ''), lambda y: (x = y)::int))"
    fold = f"list_transform(range(1, len({b}) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda i: greatest(prev[i], coalesce(prev[i - 1], 0) + eq[i]))))"
    return f"(case when {a} = '' or {b} = '' then 0 else list_reduce({rows}, lambda prev, eq: {fold}, list_transform(range(len({b})), lambda z: 0))[-1] end)"


def _ratio(a: str, b: str) -> str:
    return f"(case when {a} = '' and {b} = '' then 100.0::double else 200.0::double * {_lcs(a, b)} / (len({a}) + len({b})) end)"


def _windows(short: str, long: str) -> str:
    """The best ratio of a string with the windows of its length in another."""
    start, size = "greatest(w, 0)", f"(least(w + len({short}), len({long})) - greatest(w, 0))"
    cut = f"substr({long}, ({start} + 1)::int, {size}::int)"
    return f"list_max(list_transform(list_transform(range(1 - len({short}), len({long})), lambda w: {cut}), lambda v: 200.0::double * {_lcs(short, 'v')} / (len({short}) + len(v))))"


def _string_ctes(pairs: str, name: str) -> str:
    """CTEs of the scorers for a table of distinct (a, b); ``name`` has (a, b, ratio, token_set, token_sort, partial)."""
    words = lambda c: f"list_filter(string_split({c}, ' '), lambda x: x <> '')"
    part = f"""case when short = '' then case when long = '' then 100.0 else 0.0 end when contains(long, short) then 100.0
    when len(short) = len(long) then greatest({_windows('short', 'long')}, {_windows('long', 'short')}) else {_windows('short', 'long')} end"""
    return f"""
{name}_sets as (
  select a, b, list_sort(list_distinct({words('a')})) as sa, list_sort(list_distinct({words('b')})) as sb, array_to_string(list_sort({words('a')}), ' ') as ta,
    array_to_string(list_sort({words('b')}), ' ') as tb, case when len(a) <= len(b) then a else b end as short, case when len(a) <= len(b) then b else a end as long from {pairs}),
{name}_rest as (
  select *, array_to_string(list_filter(sa, lambda x: list_contains(sb, x)), ' ') as same_words, array_to_string(list_filter(sa, lambda x: not list_contains(sb, x)), ' ') as oa,
    array_to_string(list_filter(sb, lambda x: not list_contains(sa, x)), ' ') as ob from {name}_sets),
{name}_lengths as (select *, len(same_words) as sh, case when same_words = '' then 0 else 1 end as gap, {_lcs('oa', 'ob')} as common_part from {name}_rest),
{name} as (
  select a, b, {_ratio('a', 'b')} as ratio, {_ratio('ta', 'tb')} as token_sort, ({part})::double as partial,
    case when len(sa) = 0 or len(sb) = 0 then 0.0 when same_words <> '' and (oa = '' or ob = '') then 100.0 else greatest(
      100.0::double * (1 - (len(oa) + len(ob) - 2 * common_part)::double / (2 * (sh + gap) + len(oa) + len(ob))),
      case when gap = 1 then 100.0::double * (1 - (gap + len(oa))::double / (2 * sh + gap + len(oa))) end,
      case when gap = 1 then 100.0::double * (1 - (gap + len(ob))::double / (2 * sh + gap + len(ob))) end) end::double as token_set
  from {name}_lengths)"""


_SCORED_STRINGS = f"""{SCORED_SQL},
records as (select o_orderkey as q, lower(o_orderpriority) as name_key, strftime(o_orderdate, '%Y %m %d') as addr_clean from orders)"""
_SUBMISSION = r"""
tagged as (
  select o_custkey, case when o_orderkey % 97 = 0 then 'S1-' when o_orderkey % 89 = 0 then 'X-' when o_orderkey % 2 = 0 then 'S2-' else 'S3-' end || o_orderkey as id,
    case when o_orderkey % 101 = 0 then 2 else 1 end as times from orders),
lists as (select o_custkey, list(id order by id) as ids from (select o_custkey, id, unnest(range(times)) from tagged) group by o_custkey),
rows_ as (
  select case when c_custkey % 40 = 3 then c_name else 'S1-' || c_custkey end as s1, case when c_custkey % 40 = 3 then [] else coalesce(ids, []) end as ids, c_custkey % 40 = 3 as malformed
  from (select *, unnest(range(case when c_custkey % 60 = 11 then 2 else 1 end)) from customer where c_custkey % 50 <> 7) c left join lists on o_custkey = c_custkey),
required as (select 'S1-' || c_custkey as id from customer where c_custkey % 45 <> 1),
valid as (select t || o_orderkey as id from orders, (values ('S2-'), ('S3-')) as x(t) where o_orderkey % 31 <> 0),
good as (select * from rows_ where not malformed),
each as (select s1, unnest(ids) as id from good)"""

_CANDIDATES = """
ranked as (
  select *, row_number() over (partition by q order by comb desc, s1) as kc, row_number() over (partition by q order by sn desc, s1) as kn, row_number() over (partition by q order by sa desc, s1) as ka from scores),
stats as (select q, max(comb) filter (kc = 1) as q_comb1, coalesce(max(comb) filter (kc = 2), 0.0) as q_comb2, max(sn) as q_sn1, max(sa) as q_sa1 from ranked group by q),
cands as (select r.q, s1, sn, sa, w_name, comb, q_comb1, q_comb2, q_sn1, q_sa1 from ranked r join stats s on s.q = r.q where kc <= 8 or kn <= 3 or ka <= 3)"""
_NAME_PAIRS = """
name_pairs as (
  select distinct a, b from (select distinct country, name_key as a from ref) r join (select distinct country, name_key as b from query) q on q.country = r.country)"""
_IS_NATIVE = f"regexp_matches({{}}, '[{NATIVE[1]}]')"
_NAME_ALIASES = rf"""
both_tokens as (
  select list_filter(string_split({_SPACED.format("native")}, ' '), lambda x: x <> '') as m, list_filter(string_split({_SPACED.format("clean")}, ' '), lambda x: x <> '') as r from native_texts),
placed_tokens as (select m[i] as native, r[i] as latin from both_tokens, unnest(range(1, len(m) + 1)) as u(i) where len(m) = len(r)),
counted_tokens as (select native, latin, count(*) as n from placed_tokens where {_IS_NATIVE.format("native")} and regexp_matches(latin, '^[\x00-\x7F]*$') group by 1, 2),
ranked_tokens as (select *, sum(n) over (partition by native) as total, row_number() over (partition by native order by n desc, latin) as k from counted_tokens),
name_aliases as (select native, latin, n, n / total as share from ranked_tokens where k = 1 and n >= 2 and n / total >= 0.5)"""
_SEGMENT_ALIASES = rf"""
segmented as (
  select list_transform(string_split(mixed, ','), lambda x: {_SPACED.format("x")}) as m, list_transform(string_split(clean, ','), lambda x: {_SPACED.format("x")}) as s
  from native_texts where not regexp_matches(mixed, '^[\x00-\x7F]*$')),
joined_segments as (select m, s, ' ' || array_to_string(m, ' ') || ' ' as every from segmented),
absent_segments as (
  select list_distinct(list_filter(s, lambda x: x <> '' and not regexp_matches(x, '^\p{{Nd}}+$') and not contains(every, ' ' || x || ' '))) as absent,
    unnest(list_filter(m, lambda x: {_IS_NATIVE.format("x")})) as native from joined_segments),
seen_segments as (select native, count(*) as seen from absent_segments group by native),
counted_segments as (select native, latin, count(*) as n from (select native, unnest(absent) as latin from absent_segments) group by 1, 2),
ranked_segments as (select *, row_number() over (partition by native order by n desc, latin) as k from counted_segments),
segment_aliases as (select r.native, latin, n, n / seen as share from ranked_segments r join seen_segments s on s.native = r.native where k = 1 and n >= 3 and n / seen >= 0.3)"""
_DICTIONARY = rf"""
raw as (select doc_id, lang, native as name from native_texts),{_NAMES},
swapped_names as (
  select doc_id, string_agg(coalesce(latin, x), ' ' order by i) as name_clean
  from (select doc_id, i, t[i] as x from tokens, unnest(range(1, len(t) + 1)) as u(i)) w left join name_aliases a on a.native = w.x group by doc_id),
swapped_segments as (
  select doc_id, string_agg(coalesce(latin, x), ',' order by i) as address
  from (select doc_id, i, s[i] as x, {_SPACED.format("s[i]")} as form from (select doc_id, string_split(mixed, ',') as s from native_texts), unnest(range(1, len(s) + 1)) as u(i)) w
  left join segment_aliases a on a.native = w.form group by doc_id),
glued_words as (
  select doc_id, list_filter(string_split({_SPACED.format(r"regexp_replace(regexp_replace(address, '(\p{Nd})([\p{L}])', '\1 \2', 'g'), '([\p{L}])(\p{Nd})', '\1 \2', 'g')")}, ' '), lambda x: x <> '') as t
  from swapped_segments),
swapped_words as (
  select doc_id, string_agg(coalesce(latin, x), ' ' order by i) as a
  from (select doc_id, i, t[i] as x from glued_words, unnest(range(1, len(t) + 1)) as u(i)) w left join name_aliases a on a.native = w.x group by doc_id),
phrased as (select w.doc_id, lang, {_folded("a", tables.STATE_PHRASES)} as a from swapped_words w join native_texts n on n.doc_id = w.doc_id),{_ADDRESSES[_ADDRESSES.index("stripped as"):]}
select d.doc_id as entity_id, coalesce(n.name_clean, '') as name_clean, coalesce(a.addr_clean, '') as addr_clean
from documents d left join swapped_names n on n.doc_id = d.doc_id left join addresses a on a.doc_id = d.doc_id"""

ORACLE_SQL: dict[str, str] = {
    "q_name_normalize": f"with {RAW_SQL},{_NAMES} select n.doc_id as entity_id, name_clean, name_key, replace(name_key, ' ', '') as name_squashed, "
    r"(regexp_matches(r.name, '\p{L}') and not regexp_matches(lower(r.name), '[a-z]')) as name_native from names n join raw r on r.doc_id = n.doc_id",
    "q_address_normalize": f"with {RAW_SQL},{_ADDRESSES} select doc_id as entity_id, lower(trim(lang)) as country, addr_clean, addr_clean = '' as addr_empty, array_to_string(nums, ',') as nums from addresses",
    "q_numbers_shared": f"""with {RAW_SQL},{_NAMES},{_ADDRESSES},
base as (select a.doc_id, name_key, addr_clean, nums from addresses a join names n on n.doc_id = a.doc_id)
select a.doc_id as q, len(list_filter(a.nums, lambda x: list_contains(b.nums, x)))::int as num_shared, coalesce(list_contains(a.nums, b.nums[1]), false) as num_first_in_q,
  coalesce(a.nums[1] = b.nums[1], false) as num_first_eq, len(a.nums)::int as num_q, len(b.nums)::int as num_s,
  length(a.name_key)::int as len_nk_q, length(b.name_key)::int as len_nk_s, length(a.addr_clean)::int as len_ad_q, length(b.addr_clean)::int as len_ad_s
from base a join base b on b.doc_id = a.doc_id + 97""",
    "q_alias_learning": f"""with {WHOLE_SQL},
both_names as (select string_split(name_key, ' ') as a, string_split(translate(name_key, 'oie', '013'), ' ') as b from ref),
placed as (select b[i] as native, a[i] as latin from both_names, unnest(range(1, len(a) + 1)) as u(i) where len(a) = len(b)),
counted as (select native, latin, count(*) as n from placed group by 1, 2),
ranked as (select *, sum(n) over (partition by native) as total, row_number() over (partition by native order by n desc, latin) as k from counted)
select native, latin, n, round(n / total, 9) as share from ranked where k = 1 and n >= 2 and n / total >= 0.5""",
    "q_name_aliases": f"with {NATIVE_SQL},{_NAME_ALIASES} select native, latin, n, round(share, 9) as share from name_aliases",
    "q_segment_aliases": f"with {NATIVE_SQL},{_SEGMENT_ALIASES} select native, latin, n, round(share, 9) as share from segment_aliases",
    "q_dictionary": f"with {NATIVE_SQL},{_NAME_ALIASES},{_SEGMENT_ALIASES},{_DICTIONARY}",
    "q_ground_truth_scan": "select 'S1-' || o_custkey as ref_id, 'S2-' || o_orderkey as q_id from orders join customer on c_custkey = o_custkey",
    "q_read_ids": "select distinct 'S1-' || c_custkey as id from customer",
    "q_file_order": "select row_number() over (order by md5(c_custkey::varchar)) - 1 as s1, c_custkey::varchar as entity_id, c_mktsegment as country from customer",
    "q_numbered": "select row_number() over (order by 'S1-' || o_orderkey) - 1 as s1, 'S1-' || o_orderkey as entity_id, o_orderpriority from orders",
    "q_gt_explode": """select o_orderkey::varchar as q_id, o_custkey::varchar as ref_id from orders join customer on c_custkey = o_custkey where c_custkey % 7 <> 0 and o_orderkey % 5 <> 0""",
    "q_grouped_output": """select c_name as source1_entity_id, coalesce(string_agg(o_orderkey::varchar, ',' order by o_orderkey), '') as matched_entity_ids
from customer left join orders on o_custkey = c_custkey group by c_custkey, c_name""",
    "q_tsv_round_trip": r"""select c_custkey::varchar as entity_id, '"' || c_name || '\' as business_name, case when c_custkey % 3 = 0 then '' else c_mktsegment end as business_address, 'null' as country from customer""",
    "q_gram_idf": f"with {WHOLE_SQL},{_gram_ctes('n', 'name_key')} select gram, df, round(ln(((select count(*) from ref) + 1.0) / (df + 1)) + 1, 9) as idf from df_n",
    "q_topk_reverse": f"with {LINKAGE_SQL},{_SCORES},{_CANDIDATES} select * from cands",
    "q_pair_features": f"""with {LINKAGE_SQL},{_SCORES},{_CANDIDATES},
side as (
  select c.*, q.is_s3, q.addr_clean = '' as no_addr, q.name_key as qn, r.name_key as sn_key, q.addr_clean as qa, r.addr_clean as ra from cands c join query q on q.q = c.q join ref r on r.s1 = c.s1),
ranked_side as (
  select *, row_number() over (partition by q order by comb desc, s1) - 1 as rank_q, count(*) over (partition by q) as n_q,
    row_number() over (partition by s1 order by comb desc, q) - 1 as rank_s1, count(*) over (partition by s1) as n_s1 from side),
tops as (
  select *, count(*) filter (rank_q = 0 and not is_s3) over (partition by s1) as top2, count(*) filter (rank_q = 0 and is_s3) over (partition by s1) as top3 from ranked_side),
numbers as (
  select a, list_transform(list_slice(list_reduce(list_prepend([]::varchar[], list_transform(list_filter(string_split(a, ' '), lambda x: regexp_matches(x, '^[0-9]+$')), lambda x: [x])),
    lambda u, v: case when list_contains(u, v[1]) then u else list_concat(u, v) end), 1, 6), lambda x: right(x, 18)::bigint) as n
  from (select addr_clean as a from ref union select addr_clean from query)),
plain_pairs as (select distinct qn as a, sn_key as b from side),
tight_pairs as (select distinct replace(qn, ' ', '') as a, replace(sn_key, ' ', '') as b from side),{_string_ctes("plain_pairs", "scored_names")},
tight as (select a, b, {_ratio("a", "b")} as ratio from tight_pairs)
select t.q, t.s1, """
    + ", ".join(
        f"{f'round(({value})::double, 6)' if name[:3] in ('nk_', 'nc_', 'sq_') else f'({value})::double'} as {name}"
        for name, value in {
            "sn": "sn", "sa": "sa", "comb": "comb", "gap_best": "comb - q_comb1", "margin_other": "comb - case when rank_q = 0 then q_comb2 else q_comb1 end", "sn_gap": "sn - q_sn1", "sa_gap": "sa - q_sa1",
            "q_comb1": "q_comb1", "q_comb2": "q_comb2", "rank_q": "rank_q", "n_q": "n_q", "rank_s1": "rank_s1", "n_s1": "n_s1", "s1_top_s2": "top2", "s1_top_s3": "top3", "is_top": "(rank_q = 0)::int",
            "nk_ratio": "s.ratio", "nk_tset": "s.token_set", "nk_tsort": "s.token_sort", "nk_partial": "s.partial", "nk_jw": "jaro_winkler_similarity(qn, sn_key)", "nc_ratio": "s.ratio",
            "nc_tset": "s.token_set", "sq_ratio": "x.ratio", "len_nk_q": "len(qn)", "len_nk_s": "len(sn_key)", "len_ad_q": "len(qa)", "len_ad_s": "len(ra)",
            "num_first_in_q": "coalesce(list_contains(nq.n, nr.n[1]), false)::int", "num_first_eq": "coalesce(nq.n[1] = nr.n[1], false)::int",
            "num_shared": "len(list_filter(nq.n, lambda v: list_contains(nr.n, v)))", "num_q": "len(nq.n)", "num_s": "len(nr.n)", "q_addr_empty": "no_addr::int", "q_native": "0", "is_s3": "is_s3::int", "w_name": "w_name",
        }.items()
    )
    + """ from tops t join scored_names s on s.a = qn and s.b = sn_key join tight x on x.a = replace(qn, ' ', '') and x.b = replace(sn_key, ' ', '')
join numbers nq on nq.a = qa join numbers nr on nr.a = ra""",
    "q_topk_dense": """with v as (select vec_id, label, embedding::double[] as x from embeddings),
pairs as (
  select a.vec_id, b.vec_id as near_id, round(list_inner_product(a.x, b.x) / (sqrt(list_inner_product(a.x, a.x)) * sqrt(list_inner_product(b.x, b.x))), 6) as cosine
  from v a join v b on a.label = b.label and a.vec_id <> b.vec_id)
select * from (select *, row_number() over (partition by vec_id order by cosine desc, near_id)::int as rank from pairs) where rank <= 3""",
    "q_string_distances": f"""with {LINKAGE_SQL},{_NAME_PAIRS}
select a, b, levenshtein(a, b)::int as edits, round(jaro_winkler_similarity(a, b), 6) as jaro_winkler,
  round(len(list_intersect(string_split(a, ' '), string_split(b, ' '))) / len(list_distinct(list_concat(string_split(a, ' '), string_split(b, ' '))))::double, 6) as token_jaccard from name_pairs""",
    "q_ratio_family": f"""with {LINKAGE_SQL},{_NAME_PAIRS},{_string_ctes("name_pairs", "scorers")}
select a, b, round(ratio, 6) as ratio, round(token_set, 6) as token_set, round(token_sort, 6) as token_sort, round(partial, 6) as partial from scorers""",
    "q_competition": f"""with {SCORED_SQL},
c as (select q, s1, is_s3, p as comb, p * p as sn, 1 - p as sa from pairs),
r as (
  select *, row_number() over (partition by q order by comb desc, s1) - 1 as rank_q, count(*) over (partition by q) as n_q,
    row_number() over (partition by s1 order by comb desc, q) - 1 as rank_s1, count(*) over (partition by s1) as n_s1,
    max(sn) over (partition by q) as m_sn, max(sa) over (partition by q) as m_sa from c),
s as (select *, max(comb) filter (rank_q = 0) over (partition by q) as c1, coalesce(max(comb) filter (rank_q = 1) over (partition by q), 0.0) as c2 from r)
select q, s1, rank_q::int as rank_q, n_q, rank_s1::int as rank_s1, n_s1, rank_q = 0 as is_top,
  count(*) filter (rank_q = 0 and not is_s3) over (partition by s1) as s1_top_s2, count(*) filter (rank_q = 0 and is_s3) over (partition by s1) as s1_top_s3,
  comb - c1 as gap_best, comb - case when rank_q = 0 then c2 else c1 end as margin_other, sn - m_sn as sn_gap, sa - m_sa as sa_gap from s""",
    "q_group_features": f"""with {_SCORED_STRINGS},
r as (select *, row_number() over (partition by q order by p desc, s1) as rq from pairs),
b as (
  select *, rq = 1 as is_best, max(p) filter (rq = 1) over (partition by q) as b1, coalesce(max(p) filter (rq = 2) over (partition by q), 0.0) as b2,
    case when rq = 1 then p else 0.0 end as claim, (rq = 1 and p >= 0.5)::int as sure, case when rq = 1 then row_number() over (partition by s1, rq = 1 order by p desc, q) end as rs from r),
t as (
  select *, max(p) filter (rs = 1) over (partition by s1) as p1, max(p) filter (rs = 2) over (partition by s1) as p2, max(q) filter (rs = 1) over (partition by s1) as q1,
    max(q) filter (rs = 2) over (partition by s1) as q2 from b),
o as (select *, case when coalesce(rs = 1, false) then q2 else q1 end as other from t),
strings as (select o.q, o.s1, a.name_key as an, b.name_key as bn, a.addr_clean as aa, b.addr_clean as ba from o join records a on a.q = o.q join records b on b.q = o.other),
name_pairs as (select distinct an as a, bn as b from strings),
date_pairs as (select distinct aa as a, ba as b from strings),{_string_ctes("name_pairs", "of_names")},{_string_ctes("date_pairs", "of_dates")},
found as (select s.q, s.s1, n.ratio, n.token_set, d.token_set as date_set from strings s join of_names n on n.a = an and n.b = bn join of_dates d on d.a = aa and d.b = ba)
select o.q, o.s1, p, is_s3, is_best as g_is_best, p - case when is_best then b2 else b1 end as g_margin_q, b1 as g_q_best, b2 as g_q_second,
  coalesce(case when coalesce(rs = 1, false) then p2 else p1 end, 0.0) as g_s1_max_other, round(sum(claim) over (partition by o.s1) - claim, 6) as g_s1_sum_other,
  (sum(sure) over (partition by o.s1) - sure)::bigint as g_s1_cnt_other,
  (sum(case when not is_s3 then sure else 0 end) over (partition by o.s1) - case when not is_s3 then sure else 0 end)::bigint as g_s1_cnt_s2_other,
  (sum(case when is_s3 then sure else 0 end) over (partition by o.s1) - case when is_s3 then sure else 0 end)::bigint as g_s1_cnt_s3_other,
  round(coalesce(f.ratio, -1.0), 6) as g_other_nk_ratio, round(coalesce(f.token_set, -1.0), 6) as g_other_nk_tset, round(coalesce(f.date_set, -1.0), 6) as g_other_ad_tset,
  other is not null as g_has_other from o left join found f on f.q = o.q and f.s1 = o.s1""",
    "q_decide_threshold": f"with {SCORED_SQL},{_BEST}, kept as (select * from best where p >= 0.6) {_capped('kept')}",
    "q_decide_expected": f"with {SCORED_SQL},{_expected('0.1', 'pairs')} {_capped('(select q, s1, p, is_s3 from prefix)')}",
    "q_choose": f"""with {SCORED_SQL},
rates as (select least(0.95, 0.9 * (select count(*) from truth) / (select count(*) from refs) * (select count(*) from refs) / count(distinct q)) as prior from pairs),
moved as (
  select q, s1, is_s3, 1 / (1 + exp(-(ln(pc / (1 - pc)) + ln(prior / (1 - prior)) - ln(0.7::double / 0.3)))) as p from (select *, least(greatest(p, 1e-7), 1 - 1e-7) as pc from pairs), rates),
best as (select * from moved qualify row_number() over (partition by q order by p desc, s1) = 1),
kept as (select * from best where p >= 0.6) select q, s1, round(p, 9) as p, is_s3 from ({_capped('kept')})""",
    "q_caps": f"with {SCORED_SQL} {_capped('pairs')}",
    "q_sweep": f"""with {SCORED_SQL},{_BEST},{_COUNTS},
grid as (select distinct round(k, 2)::double as threshold from (select 0.05 * unnest(range(1, 20)) as k union all select 0.30 + 0.01 * unnest(range(60)))),
hits as (
  select threshold, b.s1, count(*) as n, count(*) filter (b.s1 = t.s1) as tp from best b join grid on b.p >= threshold left join truth t on t.q = b.q group by 1, 2)
select g.threshold, round(avg(case when 0.25 * n_true + coalesce(n, 0) > 0 then 1.25 * coalesce(tp, 0) / (0.25 * n_true + coalesce(n, 0)) else 1.0 end::double), 9) as f05
from grid g cross join true_n c left join hits h on h.threshold = g.threshold and h.s1 = c.s1 group by g.threshold""",
    "q_sweep_expected": f"""with {SCORED_SQL},{_COUNTS},
floors as (select unnest({tables.FLOORS})::double as floor),
tried as (select pairs.*, floor from pairs, floors),{_expected("floor", "tried", "floor,")},
kept as ({_capped("(select q, s1, p, is_s3, floor from prefix)", "floor,")}),
hits as (select floor, k.s1, count(*) as n, count(*) filter (k.s1 = t.s1) as tp from kept k left join truth t on t.q = k.q group by 1, 2)
select g.floor, round(avg(case when 0.25 * n_true + coalesce(n, 0) > 0 then 1.25 * coalesce(tp, 0) / (0.25 * n_true + coalesce(n, 0)) else 1.0 end::double), 9) as f05
from floors g cross join true_n c left join hits h on h.floor = g.floor and h.s1 = c.s1 group by g.floor""",
    "q_prior_shift": f"""with {SCORED_SQL}, c as (select q, s1, least(greatest(p, 1e-7), 1 - 1e-7) as pc from pairs)
select q, s1, round(1 / (1 + exp(-(ln(pc / (1 - pc)) + ln(0.6 / 0.4) - ln(0.74 / 0.26)))), 9) as p from c""",
    "q_best_p": f"with {SCORED_SQL},{_BEST} select round(avg(p), 9) as mean_best_p, round(avg((p >= 0.5)::int), 9) as sure_share, count(distinct s1) as refs_claimed from best",
    "q_f05": f"with {SCORED_SQL},{_BEST},{_COUNTS}, sure as (select * from best where p >= 0.6), kept as ({_capped('sure')}),{_f05('kept')} select s1, n_true, n_pred, tp, round(f05, 9) as f05 from f",
    "q_evaluate": f"""with {SCORED_SQL},{_BEST},{_COUNTS}, sure as (select * from best where p >= 0.6), kept as ({_capped("sure")}),{_f05("kept")}
select sum(n_pred)::bigint as pred_pairs, round(avg(f05), 9) as f05, round(avg(f05) filter (n_true = 0), 9) as f05_zero, round(avg(f05) filter (n_true = 1), 9) as f05_single,
  round(avg(f05) filter (n_true > 1), 9) as f05_multi from f""",
    "q_oracle_f05": f"""with {SCORED_SQL},{_COUNTS}, kept as (select p.* from pairs p join truth t on t.q = p.q and t.s1 = p.s1 where p.p >= 0.3),{_f05("kept")}
select s1, n_true, n_pred, tp, round(f05, 9) as f05 from f""",
    "q_candidate_report": f"""with {SCORED_SQL},{_COUNTS}, cands as (select * from pairs where p >= 0.3), kept as (select c.* from cands c join truth t on t.q = c.q and t.s1 = c.s1),{_f05("kept")},
found as (
  select t.q, t.s1, t.q % 2 = 1 as is_s3, (c.q is not null)::int as found from truth t left join cands c on c.q = t.q and c.s1 = t.s1),
volume as (select r.s1, count(c.q) as n from refs r left join cands c on c.s1 = r.s1 group by r.s1)
select (select round(avg(found), 9) from found) as pair_recall, (select round(avg(found), 9) from found where not is_s3) as s2_recall, (select round(avg(found), 9) from found where is_s3) as s3_recall,
  (select round(avg(r), 9) from (select avg(found) as r from found group by s1)) as macro_recall, (select round(avg(f05), 9) from f) as oracle_f05,
  round(avg(n), 9) as per_ref_mean, quantile_cont(n, 0.5)::double as per_ref_median, quantile_cont(n, 0.9)::double as per_ref_p90, quantile_cont(n, 0.95)::double as per_ref_p95,
  quantile_cont(n, 0.99)::double as per_ref_p99, max(n) as per_ref_max, count(*) filter (n = 0) as zero_candidate_refs, sum(n)::bigint as total_pairs from volume""",
    "q_query_fold": "select o_orderkey, " + ", ".join(f"((o_orderkey::hugeint * 2654435761) % 4294967296 % {n})::int as fold{n}" for n in (2, 3, 5)) + " from orders",
    "q_sample": """with lists as (select o_custkey::varchar as id, list(o_orderkey) as l from orders where o_orderkey % 3 <> 0 group by o_custkey),
kept as (select * from lists where ('0x' || substr(md5('7|' || id), 1, 12))::bigint / 281474976710656.0 < 0.2),
in_kept as (select unnest(l) as k from kept), in_all as (select unnest(l) as k from lists)
select 's1' as part, c_custkey::varchar as entity_id from customer where c_custkey::varchar in (select id from kept)
union all
select 'q', o_orderkey::varchar from orders where o_orderkey in (select k from in_kept)
  or (o_orderkey not in (select k from in_all) and ('0x' || substr(md5('7|' || o_orderkey), 1, 12))::bigint / 281474976710656.0 < 0.2)""",
    "q_validation_split": f"""with {SCORED_SQL}, val as (select s1 from refs where ('0x' || substr(md5('11|' || s1), 1, 12))::bigint / 281474976710656.0 < 0.05),
touched as (select q from pairs where p >= 0.8 and s1 in (select s1 from val) union select q from truth where s1 in (select s1 from val))
select q, case when q in (select q from touched) then 'val' when ('0x' || substr(md5('12|' || q), 1, 12))::bigint / 281474976710656.0 < 0.35 then 'train' else 'rest' end as part
from (select distinct q from pairs)""",
    "q_validate_submission": f"""with {_SUBMISSION},
items as (
  select 'malformed_row' as rule, s1 as item from rows_ where malformed
  union select 'duplicate_row', s1 from good group by s1 having count(*) > 1
  union select 'repeated_id', s1 from good where len(ids) > len(list_distinct(ids))
  union select 'self_match', id from each where id like 'S1-%'
  union select 'wrong_prefix', id from each where not regexp_matches(id, '^S[123]-')
  union select 'unknown_id', id from each where regexp_matches(id, '^S[23]-') and id not in (select id from valid)
  union select 'missing_s1', id from required where id not in (select s1 from good)
  union select 'extra_s1', s1 from good where s1 not in (select id from required)),
ranked as (select *, row_number() over (partition by rule order by item) as k, count(*) over (partition by rule) as n from items)
select rule, max(n) as n, string_agg(item, ',' order by item) as examples from ranked where k <= 5 group by rule""",
    "q_not_candidates": f"""with {_SUBMISSION},
candidate as (select distinct s1, list_filter(ids, lambda x: not regexp_matches(x, '7$')) as ids from good)
select g.s1, array_to_string(x, ',') as extra from (select g.s1, list_distinct(list_filter(g.ids, lambda x: not list_contains(c.ids, x))) as y, list_sort(y) as x from good g join candidate c on c.s1 = g.s1) g
where len(x) > 0""",
}
