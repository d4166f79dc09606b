"""Scalar Column -> Column functions (FN1-FN12).

All are built-in expressions so they stay as native expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: word / punctuation-run token pattern.  Explicit Unicode classes
# instead of \w so that every engine reads it alike.
TOKEN_PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"
# Characters turned into a space by the token cleaner: anything that is not a
# letter or a digit.
TOKEN_JUNK_PATTERN = r"[^\p{L}\p{N}]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# FN1 ------------------------------------------------------------------------
def code_prefix(c, parts: int = 2) -> Column:
    """First ``parts`` dot-separated parts of an industry code."""
    return F.substring_index(_c(c), ".", parts)


# FN2 ------------------------------------------------------------------------
def code_slice(c, part_to: int, part_from: int = 0) -> Column:
    """Dot parts ``[part_from, part_to)`` of a code, re-joined with '.'."""
    parts = F.split(_c(c), r"\.")
    length = F.greatest(F.least(F.size(parts), F.lit(part_to)) - F.lit(part_from), F.lit(0))
    return F.array_join(F.slice(parts, part_from + 1, length), ".")


def codes_slice(arr, part_to: int, part_from: int = 0) -> Column:
    """``code_slice`` applied to every element of an array of codes."""
    return F.transform(_c(arr), lambda x: code_slice(x, part_to, part_from))


# FN3 ------------------------------------------------------------------------
def tokenize(c) -> Column:
    """Lower-cased word and punctuation-run tokens; NULL text gives []."""
    return F.coalesce(
        F.regexp_extract_all(F.lower(_c(c)), F.lit(TOKEN_PATTERN), 0),
        F.array().cast("array<string>"))


# FN4 ------------------------------------------------------------------------
def clean_token(c, yo_to_latin_e: bool = True) -> Column:
    """Normalise one token: junk -> space, squeeze, trim; '' unless the result
    has more than one character and starts with a letter."""
    w = F.trim(F.regexp_replace(F.regexp_replace(F.lower(_c(c)), TOKEN_JUNK_PATTERN, " "), " +", " "))
    if yo_to_latin_e:
        w = F.translate(w, "ё", "e")
    return F.when((F.length(w) > 1) & w.rlike(r"^\p{L}"), w).otherwise(F.lit(""))


# FN5 ------------------------------------------------------------------------
def drop_empty(arr) -> Column:
    return F.filter(F.coalesce(_c(arr), F.array().cast("array<string>")), lambda x: x != "")


WORD_RUN_PATTERN = r"[\p{L}\p{N}_]+"
LETTER_RUN_PATTERN = r"(?<![\p{L}\p{N}_])\p{L}[\p{L}\p{N}_]+"


def clean_tokens(text, yo_to_latin_e: bool = True) -> Column:
    """FN3 + FN4 + FN5 in one pass: text -> cleaned non-empty tokens.

    Punctuation runs always clean to '' and are dropped, so only word runs
    are extracted.  Inside a word run the only junk character is '_'; a text
    without any (nearly all) needs one pattern for runs of two or more
    characters that begin with a letter, and no step per token."""
    low = F.lower(F.coalesce(_c(text), F.lit("")))
    src, dst = ("_ё", " e") if yo_to_latin_e else ("_", " ")
    plain = F.regexp_extract_all(F.translate(low, src[1:], dst[1:]) if yo_to_latin_e else low,
                                 F.lit(LETTER_RUN_PATTERN), F.lit(0))
    words = F.transform(F.regexp_extract_all(low, F.lit(WORD_RUN_PATTERN), F.lit(0)), lambda t: F.when(
        F.instr(t, "_") > 0, F.trim(F.regexp_replace(F.translate(t, src, dst), " +", " ")))
        .otherwise(F.translate(t, src, dst)))
    slow = F.filter(words, lambda w: (F.length(w) > 1) & w.rlike(r"^\p{L}"))
    return F.when(F.instr(low, "_") > 0, slow).otherwise(plain)


# FN6-FN8: dense vectors stored as array<float> --------------------------------
def dot(a, b) -> Column:
    return F.aggregate(
        F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def sq_l2(a, b) -> Column:
    """Squared Euclidean distance (the vector index metric)."""
    return F.aggregate(
        F.zip_with(_c(a), _c(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))),
        F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def l2_norm(a) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a, as_float: bool = True) -> Column:
    """Unit-length vector; the zero vector stays zero.  ``as_float`` keeps
    the float32 element type, otherwise elements are doubles.  The norm is
    computed once and zipped in (a lambda referring to it would recompute it
    per element)."""
    n = l2_norm(a)
    safe = F.when(n == 0, F.lit(1.0)).otherwise(n)
    norms = F.array_repeat(safe, F.size(_c(a)))
    if as_float:
        return F.zip_with(_c(a), norms, lambda x, d: (x.cast("double") / d).cast("float"))
    return F.zip_with(_c(a), norms, lambda x, d: x.cast("double") / d)


def cosine_similarity(a, b) -> Column:
    """Cosine similarity; 0 where either vector is zero (NaN -> 0)."""
    den = l2_norm(a) * l2_norm(b)
    return F.when(den == 0, F.lit(0.0)).otherwise(F.nanvl(dot(a, b) / den, F.lit(0.0)))


def cosine_distance(a, b) -> Column:
    return F.lit(1.0) - cosine_similarity(a, b)


# FN9 ------------------------------------------------------------------------
def suggested_nlist(n) -> Column:
    """round(sqrt(n)) with half-to-even rounding."""
    return F.bround(F.sqrt(_c(n).cast("double")), 0).cast("long")


def suggested_nprobe(nlist) -> Column:
    return F.floor(_c(nlist) / 4).cast("long")


# FN10 -----------------------------------------------------------------------
def year_slice(ts) -> Column:
    return F.year(_c(ts))


def month_slice(ts) -> Column:
    return F.date_format(_c(ts), "yyyy-MM")


def ts_from_millis(ms) -> Column:
    return F.timestamp_millis(_c(ms)).cast("timestamp_ntz")


# FN11 -----------------------------------------------------------------------
def is_code_input(c) -> Column:
    """The bot's code filter searches for ``([\\d]{1,3})+(\\.[\\d]{1,3}|){1,}``
    anywhere in the message, which holds exactly when the text contains a
    digit; written without the nested quantifier."""
    return F.coalesce(_c(c).rlike(r"\p{Nd}"), F.lit(False))


# FN12 -----------------------------------------------------------------------
def map_lookup(m, key) -> Column:
    """Map value or NULL on a missing key."""
    return F.try_element_at(_c(m), _c(key))
