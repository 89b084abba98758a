"""Text functions as Column expressions (no Python UDFs), each with a DuckDB-SQL twin.

The ``*_sql`` twins take a SQL expression string and return one; the oracle
in ``plans/catalog.py`` composes them.  Both sides use the same explicit
code-point classes from ``lexicon`` so Java regex and RE2 agree.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L

_STARTS_DIGIT_OR_ENDS_DIGIT = r"^\p{Nd}|\p{Nd}$"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# ---- H1 accent folding --------------------------------------------------------
def fold_accents(col) -> Column:
    return F.translate(_c(col), L.ACCENTS_FROM, L.ACCENTS_TO)


def fold_accents_sql(e: str) -> str:
    return f"translate({e}, 'áéíóúüçåã' || chr(10), 'aeiouucaa ')"


# ---- whitespace tokens (Python str.split semantics) ----------------------------
def tokens(col) -> Column:
    """Split on Unicode whitespace and drop the empty edge tokens."""
    return F.filter(F.split(_c(col), L.WS_RE), lambda t: t != "")


def tokens_sql(e: str) -> str:
    return f"list_filter(regexp_split_to_array({e}, '{L.WS_RE}'), lambda t: t <> '')"


# ---- H2 emoji removal ----------------------------------------------------------
def remove_emoji(col) -> Column:
    return F.regexp_replace(_c(col), L.EMOJI_RE, "")


def remove_emoji_sql(e: str) -> str:
    return f"regexp_replace({e}, '{L.EMOJI_RE}', '', 'g')"


# ---- H3 token filter -------------------------------------------------------------
def keep_token(t: Column) -> Column:
    """Drop tokens starting with @, #, http, or with a digit at either end."""
    return ~(t.startswith("@") | t.startswith("#") | t.startswith("http")
             | t.rlike(_STARTS_DIGIT_OR_ENDS_DIGIT))


def keep_token_sql(t: str) -> str:
    return (f"NOT (starts_with({t}, '@') OR starts_with({t}, '#') OR starts_with({t}, 'http') "
            f"OR regexp_matches({t}, '{_STARTS_DIGIT_OR_ENDS_DIGIT}'))")


# ---- H4 punctuation → space ------------------------------------------------------
def punctuation_to_space(col) -> Column:
    return F.regexp_replace(_c(col), L.PUNCT_RE, " ")


def punctuation_to_space_sql(e: str) -> str:
    return f"regexp_replace({e}, '{L.PUNCT_RE}', ' ', 'g')"


# ---- H6 stop-word removal (array form) --------------------------------------------
def drop_stopwords(toks: Column, words=None) -> Column:
    """Filter an array of tokens; the literal list becomes a hash ``InSet``."""
    words = list(words or L.stopwords())
    return F.filter(toks, lambda t: ~t.isin(words))


def drop_stopwords_sql(toks: str, words=None) -> str:
    words = words or L.stopwords()
    return f"list_filter({toks}, lambda t: NOT list_contains({L.sql_str_list(words)}, t))"


# ---- H7 cleaner v2 -------------------------------------------------------------------
def clean_v2_tokens(col) -> Column:
    """H3 → H2 → H4 → lower → H1 → split, before stop-word removal."""
    kept = F.array_join(F.filter(tokens(col), keep_token), " ")
    s = punctuation_to_space(remove_emoji(kept))
    return tokens(fold_accents(F.lower(s)))


def clean_v2(col) -> Column:
    """Cleaner v2 as one column expression: returns the cleaned text."""
    return F.array_join(drop_stopwords(clean_v2_tokens(col)), " ")


def clean_v2_sql(e: str) -> str:
    kept = f"array_to_string(list_filter({tokens_sql(e)}, lambda t: {keep_token_sql('t')}), ' ')"
    s = punctuation_to_space_sql(remove_emoji_sql(kept))
    toks = tokens_sql(fold_accents_sql(f"lower({s})"))
    return f"array_to_string({drop_stopwords_sql(toks)}, ' ')"


# ---- H8 cleaner v1 (intended semantics) -------------------------------------------------
_ALPHA = r"^\p{L}+$"
_WORD = r"[\p{L}\p{Nd}_]+"


def clean_v1(col) -> Column:
    """lower → drop URL/mention/hashtag tokens → H1 → H2 → word tokens → alphabetic → stop words."""
    low = F.lower(_c(col))
    kept = F.array_join(F.filter(tokens(low), lambda t: ~(t.startswith("http") | t.startswith("@")
                                                          | t.startswith("#"))), " ")
    s = remove_emoji(fold_accents(kept))
    words = F.regexp_extract_all(s, F.lit(f"({_WORD})"), 1)
    alpha = F.filter(words, lambda t: t.rlike(_ALPHA))
    return F.array_join(drop_stopwords(alpha), " ")


def clean_v1_sql(e: str) -> str:
    kept = (f"array_to_string(list_filter({tokens_sql(f'lower({e})')}, lambda t: NOT (starts_with(t, 'http') "
            f"OR starts_with(t, '@') OR starts_with(t, '#'))), ' ')")
    s = remove_emoji_sql(fold_accents_sql(kept))
    words = f"regexp_extract_all({s}, '({_WORD})', 1)"
    alpha = f"list_filter({words}, lambda t: regexp_matches(t, '{_ALPHA}'))"
    return f"array_to_string({drop_stopwords_sql(alpha)}, ' ')"


# ---- H9 laughter and stop-word blanking on raw case ----------------------------------------
def blank_unwanted(col) -> Column:
    words = list(L.unwanted_words())
    return F.array_join(F.transform(tokens(col), lambda t: F.when(t.isin(words), F.lit("")).otherwise(t)), " ")


def blank_unwanted_sql(e: str) -> str:
    lst = L.sql_str_list(L.unwanted_words())
    return (f"array_to_string(list_transform({tokens_sql(e)}, lambda t: CASE WHEN list_contains({lst}, t) "
            f"THEN '' ELSE t END), ' ')")


# ---- H10/H11 word tokens and n-grams ------------------------------------------------------
def long_tokens(col, min_len: int = 3) -> Column:
    return F.filter(tokens(col), lambda t: F.length(t) >= min_len)


def long_tokens_sql(e: str, min_len: int = 3) -> str:
    return f"list_filter({tokens_sql(e)}, lambda t: length(t) >= {min_len})"


def ngrams(toks: Column, n: int) -> Column:
    """All contiguous n-grams (arrays) of a token array; none when size < n."""
    return F.when(F.size(toks) >= n,
                  F.transform(F.sequence(F.lit(1), F.size(toks) - n + 1), lambda i: F.slice(toks, i, n))
                  ).otherwise(F.array().cast("array<array<string>>"))


def ngrams_sql(toks: str, n: int) -> str:
    return (f"CASE WHEN len({toks}) >= {n} THEN list_transform(range(1, len({toks}) - {n} + 2), "
            f"lambda i: {toks}[i:i + {n} - 1]) ELSE [] END")


# ---- H12 hashtags ----------------------------------------------------------------------------
_TRAIL = r"[^\p{L}\p{Nd}]+$"


def hashtags(col) -> Column:
    """Whitespace words starting with #, lowered, folded, trailing non-alphanumerics stripped."""
    raw = F.filter(tokens(col), lambda t: t.startswith("#"))
    norm = F.transform(raw, lambda t: F.regexp_replace(fold_accents(F.lower(t)), _TRAIL, ""))
    return F.filter(norm, lambda t: (t != "#") & (t != ""))


def hashtags_sql(e: str) -> str:
    raw = f"list_filter({tokens_sql(e)}, lambda t: starts_with(t, '#'))"
    norm = f"list_transform({raw}, lambda t: regexp_replace({fold_accents_sql('lower(t)')}, '{_TRAIL}', ''))"
    return f"list_filter({norm}, lambda t: t <> '#' AND t <> '')"


# ---- H15 capitalise ---------------------------------------------------------------------------
def capitalize(col) -> Column:
    c = _c(col)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def capitalize_sql(e: str) -> str:
    return f"upper(substring({e}, 1, 1)) || lower(substring({e}, 2))"


# ---- H20 vector norms and distances -------------------------------------------------------------
def l2_norm(v) -> Column:
    return F.sqrt(F.aggregate(_c(v), F.lit(0.0), lambda acc, x: acc + x * x))


def euclidean(u, v) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_c(u), _c(v), lambda a, b: (a - b) * (a - b)),
                              F.lit(0.0), lambda acc, x: acc + x))


def cosine_distance(u, v) -> Column:
    dot = F.aggregate(F.zip_with(_c(u), _c(v), lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    return F.lit(1.0) - dot / (l2_norm(u) * l2_norm(v))
