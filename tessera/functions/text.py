"""Text normalisation as column expressions.

``fold`` is the one step that Spark has no function for (compatibility normalisation and full case folding): an Arrow
UDF, meant to run once over a record before any join. All else works on folded or raw columns inside the JVM.
Missing text is the empty string throughout, so no predicate has a third value.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce
from operator import or_

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources import vocabulary as V

#: Code-point ranges. The three notions of script differ on purpose.
HAN = "[\\x{4e00}-\\x{9fff}]"
KANA = "[\\x{3040}-\\x{30ff}]"
CJK_WIDE = "[\\x{3040}-\\x{30ff}\\x{3400}-\\x{9fff}\\x{f900}-\\x{faff}]"
JAPANESE = "[\\x{3040}-\\x{30ff}\\x{3400}-\\x{9fff}]"
HAN_WIDE = "[\\x{3400}-\\x{9fff}\\x{f900}-\\x{faff}]"


#: Patterns on which results depend.
CORE_CUTS = (
    "(?U)\\s*\\((?:with|feat\\.?|featuring)\\b[^)]*\\)",
    "(?U)\\s*-?\\s*\\[(?:from)\\s+[^\\]]+\\]\\s*$",
    "(?U)\\s*-\\s*from\\s+[\"“”][^\"“”]+[\"“”]\\s*$",
    "(?U)\\s*-\\s*(?:\\d{4}\\s+)?remaster(?:ed)?\\s*$",
    "(?U)\\s*\\((?:\\d{4}\\s+)?remaster(?:ed)?\\)\\s*$",
)
#: Each of the patterns asks for one of these.
CORE_MARKS = ("(", "[", "from", "remaster")
LIVE_SUFFIX = "(?iU)\\s*-\\s*live(?:\\s+version)?\\s*$"
FEATURE = "(?iU)^(.*?)\\s+(?:feat\\.?|ft\\.?|featuring)\\s+(.+?)\\s*$"
FEATURE_SEPARATOR = "(?iU)\\s*(?:,|&|、|/|and)\\s*"
SOUNDTRACK = '(?iU)^(.*?)\\s+-\\s+from\\s+["“](.+?)["”]\\s+soundtrack\\s*$'
ALBUM_VERSION = "(?iU)\\s*[-(（]\\s*(?:album|single)\\s+version\\s*[)）]?\\s*$"
SEVERAL_ARTISTS = "(?iU)[,/]|\\s(?:and|&|with|feat\\.?|featuring)\\s"
ROMAN_WO, ROMAN_CCI, ROMAN_BOCCI = "(?iU)\\bwo\\b", "(?iU)cci\\b", "(?iU)\\bbocci\\b"
BRACKETS = "[(（]([^)）]+)[)）]"

def _folded(x: str | None) -> str:
    return "" if x is None else x.lower() if x.isascii() else unicodedata.normalize("NFKC", x).casefold()


@F.pandas_udf(T.StringType())
def _fold(s: pd.Series) -> pd.Series:
    return s.map(_folded)


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x) if x is not None else "")


def text(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def fold(c) -> Column:
    """Compatibility form, case folded."""
    return _fold(text(c))


def nfkc(c) -> Column:
    return _nfkc(text(c))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _fold_all(s: pd.Series) -> pd.Series:
    return s.map(lambda xs: [_folded(x) for x in xs] if xs is not None else [])


@F.arrow_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _fold_lists(lists: pa.Array) -> pa.Array:
    inner = lists.values
    folded = pa.array([_folded(x) for x in inner.values.to_pylist()], pa.string())
    return pa.ListArray.from_arrays(lists.offsets, pa.ListArray.from_arrays(inner.offsets, folded))


def fold_lists(*columns: Column) -> Column:
    """fold for the strings of several arrays, none of them null, in one pass: an array of arrays."""
    return _fold_lists(F.array(*columns))


def fold_all(c) -> Column:
    """fold for each string of an array."""
    return _fold_all(F.col(c) if isinstance(c, str) else c)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, "^(?U)\\s+|(?U)\\s+$", "")


def basic_key(folded: Column) -> Column:
    """Letters and numbers only."""
    return F.regexp_replace(folded, "[^\\p{L}\\p{N}]", "")


def key(folded: Column) -> Column:
    """The comparison key: ampersand spelled out, one simplified character unified, letters and numbers only."""
    return basic_key(F.translate(F.replace(folded, F.lit("&"), F.lit("and")), "间", "間"))


def query_value(raw: Column) -> Column:
    """A value as it may stand in a query: no quotes or stars, single spaces."""
    return strip(F.regexp_replace(F.translate(raw, '"*', "  "), "(?U)\\s+", " "))


def title_core(folded: Column) -> Column:
    """A title without credits of guests, sources and remasters. Most titles have no mark of these, and no pattern is tried on them."""
    bare = out = strip(folded)
    for pattern in CORE_CUTS:
        out = F.regexp_replace(out, pattern, "")
    marked = reduce(or_, [F.contains(folded, F.lit(mark)) for mark in CORE_MARKS])
    return F.when(marked, strip(out)).otherwise(bare)


def without_parenthesis(core: Column) -> Column:
    return strip(F.regexp_replace(core, "(?U)\\s*\\([^)]*\\)\\s*$", ""))


def title_keys(core: Column) -> Column:
    """Keys of a core: itself, and without a closing parenthesis."""
    return F.array_distinct(F.filter(F.array(key(core), key(without_parenthesis(core))), lambda k: k != ""))


def retrieval_title(core: Column, raw: Column) -> Column:
    bare = without_parenthesis(core)
    return F.when(bare != "", bare).when(core != "", core).otherwise(raw)


def has(pattern: str, c: Column) -> Column:
    return F.regexp_like(c, F.lit(pattern))


def is_asian(raw: Column) -> Column:
    """Has a Han or kana character, in the narrow ranges."""
    return has(HAN, raw) | has(KANA, raw)


def is_cjk_wide(raw: Column) -> Column:
    return has(CJK_WIDE, raw)


def is_japanese(raw: Column) -> Column:
    return has(JAPANESE, raw)


def is_latin_name(normal: Column) -> Column:
    """A display name in Latin letters; normal: in compatibility form."""
    return (strip(normal) != "") & ~is_asian(normal) & has("[A-Za-z]", normal)


def natural_order(normal: Column) -> Column:
    """'Family, Given' as 'Given Family'; another Latin name as it is; else null."""
    s = strip(normal)
    parts = F.split(s, ",")
    family, given = strip(F.get(parts, F.lit(0))), strip(F.get(parts, F.lit(1)))
    turned = F.when((family != "") & (given != "") & is_latin_name(family) & is_latin_name(given), F.concat_ws(" ", given, family))
    return F.when(F.size(parts) == 2, turned).otherwise(F.when(is_latin_name(s) & (F.size(parts) == 1), s))


def term_regex(term: str) -> str:
    return f"(?<![a-z0-9])(?:{V.TERM_PATTERNS.get(term, term)})(?![a-z0-9])"


def term_mark(term: str) -> str:
    """Letters that every text with the term has: those with which its pattern opens."""
    return re.match("[a-z]+(?![?*{])", V.TERM_PATTERNS.get(term, term))[0]


def version_terms(folded: Column) -> Column:
    """Terms of the lexicon that a folded text has, as whole words. A pattern is tried only where its mark stands."""
    tests = [F.when(F.contains(folded, F.lit(term_mark(t))) & has("(?U)" + term_regex(t), folded), F.lit(t)) for t in V.ALL_TERMS]
    return F.filter(F.array(*tests), lambda t: t.isNotNull())


def live_suffix_cut(raw: Column) -> Column:
    return F.regexp_replace(raw, LIVE_SUFFIX, "")




def feature_title(raw: Column) -> Column:
    """What stands before a closing guest credit; empty without one."""
    return F.regexp_extract(raw, FEATURE, 1)


def feature_names(raw: Column) -> Column:
    credit = F.regexp_extract(raw, FEATURE, 2)
    return F.filter(F.transform(F.split(credit, FEATURE_SEPARATOR), lambda x: strip(x)), lambda x: x != "")


def soundtrack_title(raw: Column) -> Column:
    return F.regexp_extract(raw, SOUNDTRACK, 1)


def simplified_title(raw: Column) -> Column:
    return strip(F.regexp_replace(raw, ALBUM_VERSION, ""))


def ambiguous_artist(raw: Column) -> Column:
    return has(SEVERAL_ARTISTS, raw)


def escape_query(raw: Column) -> Column:
    return F.replace(F.replace(raw, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def base_title_variants(normal: Column) -> Column:
    """A title in compatibility form, and without a closing parenthesis."""
    s = strip(normal)
    bare = strip(F.regexp_replace(s, "(?U)\\s*[(（][^)）]*[)）]\\s*$", ""))
    return F.array_distinct(F.filter(F.array(s, bare), lambda x: x != ""))


def romanised_variants(raw: Column) -> Column:
    """Other spellings of a romanised title, each change alone."""
    return F.array_distinct(F.array(raw, F.regexp_replace(raw, ROMAN_WO, "o"), F.regexp_replace(raw, ROMAN_CCI, "tchi")))


def recording_variants(normal_title: Column, artist: Column) -> Column:
    def of(t: Column) -> Column:
        return F.when(is_asian(artist) & ~is_asian(t), romanised_variants(t)).otherwise(F.array(t))

    return F.array_distinct(F.flatten(F.transform(base_title_variants(normal_title), of)))


def romanised_retrieval_title(normal: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(normal, ROMAN_WO, "o"), ROMAN_BOCCI, "botchi")


def bracket_contents(normal: Column) -> Column:
    return F.filter(F.regexp_extract_all(normal, F.lit(BRACKETS), F.lit(1)), lambda x: strip(x) != "")


def query_shape(folded: Column) -> Column:
    """Words of a folded text with single spaces: word boundaries count, styling doesn't."""
    return strip(F.regexp_replace(folded, "(?U)[^\\w]+", " "))


def split_line(line: Column) -> tuple[Column, Column]:
    """(title, artist) of 'title - artist', split at the last separator; nulls where a part is missing."""
    pattern = "(?s)^(.*) - (.*)$"
    title, artist = strip(F.regexp_extract(strip(line), pattern, 1)), strip(F.regexp_extract(strip(line), pattern, 2))
    good = (title != "") & (artist != "")
    return F.when(good, title), F.when(good, artist)


def han_skeleton(folded: Column) -> Column:
    return F.regexp_replace(folded, HAN_WIDE, "")


def cjk_title_status(a: Column, b: Column, converted_a: Column | None, converted_b: Column | None, conflict: Column) -> Column:
    """EXACT, CJK_EQUIVALENT or NO_MATCH for two folded titles; converted: the same in one script, null where that failed, or None without a converter."""
    exact = basic_key(a) == basic_key(b)
    if converted_a is None:
        return F.when(exact, "EXACT").otherwise("NO_MATCH")
    like = is_cjk_wide(a) & is_cjk_wide(b) & ~conflict & F.coalesce(basic_key(converted_a) == basic_key(converted_b), F.lit(False)) & (han_skeleton(a) == han_skeleton(b))
    return F.when(exact, "EXACT").when(like, "CJK_EQUIVALENT").otherwise("NO_MATCH")
