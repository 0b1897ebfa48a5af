"""Normalisation of names and addresses as column expressions.

Arrow functions are ``base_clean`` and ``casefold``, as Spark has no Unicode normal forms or case folding, and the replacing
of words by dictionaries. All else takes cleaned columns and stays inside Spark's expressions. Null counts as empty throughout.
"""

from __future__ import annotations

import itertools
import operator
import re
import unicodedata
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tables

_MARKS = re.compile("[̀-ͯ]")
#: Decimal digits of scripts that addresses come in: the first digit of each.
_DIGIT_STARTS = [0x0660, 0x06F0, *range(0x0966, 0x0DE7, 0x80)]
_NATIVE_DIGITS = "".join(chr(s + d) for s in _DIGIT_STARTS for d in range(10))


def _as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _clean(text: str | None) -> str:
    out = unicodedata.normalize("NFKC", text or "").casefold()
    return out if out.isascii() else unicodedata.normalize("NFC", _MARKS.sub("", unicodedata.normalize("NFKD", out)))


@F.pandas_udf(T.StringType())
def base_clean(text: pd.Series) -> pd.Series:
    """NFKC and case folding; in text that isn't ASCII, accents U+0300 to U+036F go as well."""
    return text.map(_clean, na_action=None)


@F.pandas_udf(T.StringType())
def casefold(text: pd.Series) -> pd.Series:
    return text.map(lambda x: (x or "").casefold(), na_action=None)


def is_ascii(c: Column | str) -> Column:
    """As many bytes as characters."""
    return F.octet_length(_as_column(c)) == F.length(_as_column(c))


def has_latin_letter(c: Column | str) -> Column:
    return _as_column(c).rlike("[a-z]")


def is_non_latin(c: Column | str) -> Column:
    """A letter above U+024F."""
    return ~is_ascii(c) & _as_column(c).rlike(r"[\p{L}&&[^\x{0}-\x{24F}]]")


def punct_to_space(c: Column | str) -> Column:
    """All but letters, numbers and U+0900 to U+0DFF (with its vowel signs) become single spaces; trimmed."""
    # a lone space is no match: most gaps are left as they are
    kept = r"\p{L}\p{N}\x{0900}-\x{0DFF}"
    return F.trim(F.regexp_replace(F.coalesce(_as_column(c), F.lit("")), f"[^{kept}]{{2,}}|[^{kept} ]", " "))


def join_initials(c: Column | str) -> Column:
    """Runs of single a-z words become one word: ``l l c`` to ``llc``."""
    return F.regexp_replace(_as_column(c), r"(?<=(?:^| )[a-z]) (?=[a-z](?: |$))", "")


def words(c: Column | str) -> Column:
    return F.filter(F.split(_as_column(c), " "), lambda t: t != "")


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*map(F.lit, itertools.chain.from_iterable(values.items())))


def name_tokens(clean: Column | str) -> Column:
    """Words of a cleaned name."""
    spelled = F.regexp_replace(F.coalesce(_as_column(clean), F.lit("")), "[&+]", " and ")
    return words(join_initials(punct_to_space(spelled)))


#: Rows, and bytes of strings, up to which a dictionary goes to all tasks; a larger one is joined.
HELD_ROWS, HELD_BYTES = 2_000_000, 64 << 20


def _relisted(like: pa.ListArray, flat: pa.Array) -> pa.ListArray:
    """Lists of the sizes of ``like`` with other elements."""
    sizes = pc.fill_null(pc.list_value_length(like), 0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), flat, mask=like.is_null() if like.null_count else None)


def _replaced(known: pa.Table):
    """The elements of an array by their keys, another array of the same sizes, in a dictionary that all tasks hold."""
    native, latin = (known.column(i).cast(pa.string()).combine_chunks() for i in range(2))

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def replaced(elements: pa.Array, keys: pa.Array) -> pa.Array:
        at = pc.index_in(keys.flatten(), value_set=native)
        return _relisted(elements, pc.coalesce(latin.take(at), elements.flatten()))

    return replaced


@F.arrow_udf(T.ArrayType(T.StringType()))
def _replaced_by_own(elements: pa.Array, keys: pa.Array, native: pa.Array, latin: pa.Array) -> pa.Array:
    """The elements of an array by their keys, from each row's own dictionary (null: none)."""
    out = []
    for x, k, n, v in zip(elements, keys, native, latin, strict=True):
        x, n = x.as_py(), n.as_py()
        own = dict(zip(n, v.as_py(), strict=True)) if n and x else {}
        out.append([own.get(b, a) for a, b in zip(x, k.as_py(), strict=True)] if own else x)
    return pa.array(out, pa.list_(pa.string()))


def looked_up(records: DataFrame, columns: str | list[str], key: str, table: DataFrame, form: Callable[[Column], Column] | None = None) -> DataFrame:
    """``records`` with the elements of array columns replaced by a dictionary (native, latin), where ``form`` of the element is in it.

    Only arrays with an element that isn't ASCII take part. A dictionary of up to HELD_ROWS and HELD_BYTES, by its count, goes to all tasks.
    A larger one, of any size, is joined to the distinct elements of each row, of all columns at once, and what is found
    goes back by ``key``, which is unique in ``records``. Several entries of a word: the smallest value.
    """
    columns = [columns] if isinstance(columns, str) else columns
    known = table.where("native is not null").groupBy(F.col("native").alias("_t")).agg(F.min("latin").alias("_l"))
    rows, size = known.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("_t") + F.octet_length("_l")), F.lit(0))).first()
    takes_part = lambda c: F.exists(c, lambda x: ~is_ascii(x))
    keys = {c: F.transform(c, form) if form else F.col(c) for c in columns}
    if rows <= HELD_ROWS and size <= HELD_BYTES:
        # the columns' arrays as one, so that a task holds the dictionary once
        part = lambda c, x: F.when(takes_part(c), x).otherwise(F.array().cast("array<string>"))
        out = records.withColumn("_all", F.concat(*(part(c, F.col(c)) for c in columns)))
        every = F.concat(*(part(c, keys[c]) for c in columns)) if form else F.col("_all")
        out, new, start = out.withColumn("_new", _replaced(known.toArrow())("_all", every)), {}, F.lit(1)
        for c in columns:
            new[c] = F.when(takes_part(c), F.slice("_new", start, F.size(c))).otherwise(F.col(c))
            start = start + F.size(part(c, F.col(c)))
        return out.withColumns(new).drop("_all", "_new")
    asked = F.flatten(F.array(*(F.when(takes_part(c), keys[c]).otherwise(F.array().cast("array<string>")) for c in columns)))
    parts = records.select(F.col(key).alias("_key"), F.explode(F.array_distinct(asked)).alias("_t"))
    own = parts.join(known, "_t").groupBy("_key").agg(F.collect_list(F.struct("_t", "_l")).alias("_s")).select("_key", F.col("_s._t").alias("_n"), F.col("_s._l").alias("_v"))
    joined = records.join(own, records[key] == own["_key"], "left")
    none = F.lit(None).cast("array<string>")
    return joined.withColumns({c: _replaced_by_own(F.col(c), keys[c], F.when(takes_part(c), F.col("_n")).otherwise(none), F.col("_v")) for c in columns}).drop("_key", "_n", "_v")


def leet_fold(c: Column | str) -> Column:
    return F.translate(_as_column(c), *tables.LEET)


def name_clean(tokens: Column | str) -> Column:
    return F.array_join(_as_column(tokens), " ")


def name_key(tokens: Column | str, folded: Column | str) -> Column:
    """What identifies a name: without legal and domain words, and without a top-level domain after a dot
    in ``folded``, the case-folded raw name, unless it comes first; leet folded. A name of nothing else is kept whole."""
    tokens, folded = _as_column(tokens), F.coalesce(_as_column(folded), F.lit(""))
    empty, domains = [*tables.LEGAL_WORDS, *tables.DOMAIN_WORDS], [*tables.TOP_LEVEL_DOMAINS]

    def kept(t: Column, i: Column) -> Column:
        after_dot = (i > 0) & t.isin(domains) & F.contains(folded, F.concat(F.lit("."), t))
        return ~t.isin(empty) & ~after_dot

    some = F.transform(F.filter(tokens, kept), lambda t: F.when(is_ascii(t) & ~t.rlike("^[0-9]+$"), leet_fold(t)).otherwise(t))
    every = F.transform(tokens, lambda t: F.when(is_ascii(t), leet_fold(t)).otherwise(t))
    return F.array_join(F.when(F.size(some) > 0, some).otherwise(every), " ")


def name_is_native(raw: Column | str, clean: Column | str) -> Column:
    """A name with letters, but none of a-z once it is cleaned."""
    raw = F.coalesce(_as_column(raw), F.lit(""))
    return (raw != "") & raw.rlike(r"\p{L}") & ~has_latin_letter(clean)


def squashed(c: Column | str) -> Column:
    return F.regexp_replace(_as_column(c), " ", "")


def split_glued(c: Column | str) -> Column:
    """A space between a digit and a letter, both ways."""
    apart = F.regexp_replace(_as_column(c), r"(\p{Nd})([\p{L}\p{Nl}\p{No}])", "$1 $2")
    return F.regexp_replace(apart, r"([\p{L}\p{Nl}\p{No}])(\p{Nd})", "$1 $2")


def state_phrases(c: Column | str) -> Column:
    """State names of several words by their codes, longest first."""
    bound = r"(?<![\p{{L}}\p{{N}}_])(?:{})(?![\p{{L}}\p{{N}}_])"

    def coded(whole: Column) -> Column:
        """``whole`` is a lambda's argument, so that it is made once; where no name is found as a plain string, nothing is matched."""
        out = whole
        for phrase, code in tables.STATE_PHRASES.items():
            out = F.regexp_replace(out, bound.format(phrase), code)
        return F.when(reduce(operator.or_, (F.contains(whole, F.lit(x)) for x in tables.STATE_PHRASES)), out).otherwise(whole)

    return F.get(F.transform(F.array(_as_column(c)), coded), F.lit(0))


def _is_number(t: Column) -> Column:
    return t.rlike(r"^\p{Nd}+$")


def _number(t: Column) -> Column:
    return F.regexp_replace(F.translate(t, _NATIVE_DIGITS, "0123456789" * len(_DIGIT_STARTS)), "^0+(?=[0-9])", "")


def address_words(clean: Column | str) -> Column:
    """Words of a cleaned address, digits and letters apart."""
    return words(punct_to_space(split_glued(F.coalesce(_as_column(clean), F.lit("")))))


def address_tokens(tokens: Column) -> Column:
    """Normalised words of an address's words: states, abbreviations, numbers."""
    tokens = words(state_phrases(F.array_join(tokens, " ")))
    known = lambda t, values: F.when(t.isin([*values]), F.try_element_at(literal_map(values), t)).otherwise(t)
    tokens = F.transform(tokens, lambda t: F.when(_is_number(t), _number(t)).when(t.endswith("township"), F.regexp_replace(t, "^(.+)township$", "$1")).otherwise(t))
    tokens = F.filter(tokens, lambda t: ~t.isin([*tables.ADDRESS_DROP]))
    tokens = F.transform(tokens, lambda t: known(t, tables.STATE_WORDS))
    return F.transform(tokens, lambda t: known(t, tables.ADDRESS_SHORT))


def address_numbers(tokens: Column | str) -> Column:
    """Distinct number words of a normalised address, in order."""
    return F.array_distinct(F.filter(_as_column(tokens), _is_number))


def encode_numbers(numbers: Column | str, width: int = 6) -> Column:
    """The first ``width`` numbers by their last 18 digits."""
    return F.transform(F.slice(_as_column(numbers), 1, width), lambda n: F.right(n, F.lit(18)).cast("bigint"))


def normalise(records: DataFrame, aliases: DataFrame | None = None, segments: DataFrame | None = None, unicode: bool = True, key: str = "entity_id") -> DataFrame:
    """(entity_id, name, address, country, ...) with name_clean, name_key, name_native, addr_clean, addr_empty and nums.

    aliases, segments: dictionaries (native, latin) of words and of comma segments of addresses; a value may hold
    several words. ``key`` is a unique column, needed with dictionaries only. ``unicode``: clean by the Arrow
    function; else lower-case only, which is the same for ASCII text.
    """
    clean = base_clean if unicode else lambda c: F.lower(F.coalesce(_as_column(c), F.lit("")))
    fold = casefold if unicode else lambda c: F.lower(F.coalesce(_as_column(c), F.lit("")))
    out = records.withColumns({"_nc": clean(F.col("name")), "_nf": fold(F.col("name")), "_ac": clean(F.col("address"))})
    if segments is not None:
        out = looked_up(out.withColumn("_ac", F.split(F.coalesce("_ac", F.lit("")), ",", -1)), "_ac", key, segments, punct_to_space).withColumn("_ac", F.array_join("_ac", ","))
    out = out.withColumns({"_nt": name_tokens("_nc"), "_at": address_words("_ac"), "country": F.lower(F.trim("country"))})
    if aliases is not None:
        out = looked_up(out, ["_nt", "_at"], key, aliases).withColumns({c: words(F.array_join(c, " ")) for c in ("_nt", "_at")})
    out = out.withColumn("_at", address_tokens(F.col("_at"))).withColumns(
        {
            "name_clean": name_clean("_nt"),
            "name_key": name_key("_nt", "_nf"),
            "name_native": name_is_native("name", "_nc"),
            "addr_clean": F.array_join("_at", " "),
            "nums": encode_numbers(address_numbers("_at")),
        }
    )
    return out.withColumn("addr_empty", F.col("addr_clean") == "").drop("_nc", "_nf", "_ac", "_nt", "_at")
