"""Native column expressions for query and response text.

All functions take and return ``Column`` objects built from
``pyspark.sql.functions`` only, so they stay inside whole-stage codegen (the
higher-order ones are JVM-interpreted but still never leave the JVM).
Python's ``str`` semantics are Unicode aware, so every regex carries Java's
``(?U)`` flag: ``\\s`` then covers U+00A0 and friends like ``str.split()``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config

_WS = "(?U)\\s+"
#: Unicode white space, the characters of ``(?U)\\s``.
_WS_CHARS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nz(c) -> Column:
    """NULL -> '' (text missing values are the empty string)."""
    return F.coalesce(col_(c), F.lit(""))


def has_text(c) -> Column:
    """Python truthiness of a string: not NULL and not ''."""
    return nz(c) != F.lit("")


def ustrip(c) -> Column:
    """``str.strip()``: remove leading and trailing Unicode whitespace (read from the ends, without a
    regular expression over the whole text)."""
    return F.trim(nz(c), F.lit(_WS_CHARS))


def is_blank(c) -> Column:
    """NULL, empty, or whitespace only (the invalid-response predicate)."""
    return F.ltrim(nz(c), F.lit(_WS_CHARS)) == F.lit("")


def words(c) -> Column:
    """``str.split()``: whitespace tokens, empty parts dropped."""
    return F.filter(F.split(nz(c), _WS), lambda w: w != F.lit(""))


def char_count(c) -> Column:
    """Code points."""
    return F.length(nz(c))


def word_count(c) -> Column:
    """S2 / S14."""
    return F.size(words(c))


def unique_word_count(c) -> Column:
    """S3: case sensitive, punctuation kept."""
    return F.size(F.array_distinct(words(c)))


def remove_urls(c) -> Column:
    """Drop markdown image links and http(s) URLs."""
    return F.regexp_replace(nz(c), "(?U)!\\[.*?\\]\\(.*?\\)|https?://\\S+", "")


def special_token_count(c, chars=None) -> Column:
    """Characters of the fixed special set, counted without regex."""
    chars = "".join(chars or config.SPECIAL_TOKENS)
    return F.length(nz(c)) - F.length(F.translate(nz(c), chars, ""))


def keyword_count(instruction, input_, keywords=None) -> Column:
    """Whole-word keyword hits in the lowercased instruction, or the input when
    the instruction is empty.  Every keyword is one word, so counting equal tokens
    of a split on non-word characters equals counting ``\\bkw\\b`` matches."""
    kw = F.array(*[F.lit(k) for k in (keywords or config.KEYWORDS)])
    src = F.when(has_text(instruction), nz(instruction)).otherwise(nz(input_))
    toks = F.split(F.lower(src), "(?U)\\W+")
    return F.size(F.filter(toks, lambda t: F.array_contains(kw, t)))


def contains_url(c) -> Column:
    """1 if an http(s) scheme occurs, else 0."""
    return F.when(nz(c).rlike("https?://"), F.lit(1)).otherwise(F.lit(0))


def readability_grade(c) -> Column:
    """Flesch-Kincaid grade level (Kincaid et al. 1975) on URL-free text.

    ``0.39 * words / sentences + 11.8 * syllables / words - 15.59`` where words are
    whitespace tokens, sentences are runs of ``.!?`` (at least one), syllables are
    groups of ``aeiouy`` per lowercased word (at least one per word).  Empty text
    scores 0.0.  This is our own stated definition (no hyphenation dictionary).

    Vowel groups never span whitespace, so the per-word sum equals the vowel
    groups of the whole text plus one per vowel-less word: two regex scans of
    the text instead of one regex per word.
    """
    t = F.lower(remove_urls(c))
    n_words = F.size(words(t)).cast("double")
    n_sent = F.greatest(F.lit(1), F.regexp_count(t, F.lit("[.!?]+"))).cast("double")
    groups = F.regexp_count(t, F.lit("[aeiouy]+"))
    vowelless = F.regexp_count(t, F.lit("(?U)(?<!\\S)[^aeiouy\\s]+(?!\\S)"))
    syll = (groups + vowelless).cast("double")
    grade = F.lit(0.39) * (n_words / n_sent) + F.lit(11.8) * (syll / n_words) - F.lit(15.59)
    return F.when(n_words > 0, grade).otherwise(F.lit(0.0))


def is_trash(response, redundancy_col, length_col, runtime_col) -> Column:
    """Blank, or (redundancy > 0.85 and words > 100 and runtime > 1000 ms)."""
    return is_trash_row(is_blank(response), redundancy_col, length_col, runtime_col)


def is_trash_row(blank, redundancy_col, length_col, runtime_col) -> Column:
    """S12 from the blank flag of the response."""
    return col_(blank) | (
        (col_(redundancy_col) > F.lit(config.TRASH_MAX_REDUNDANCY))
        & (col_(length_col) > F.lit(config.TRASH_MAX_WORDS))
        & (col_(runtime_col) > F.lit(config.TRASH_MAX_RUNTIME_MS)))


def is_repetition(instruction, input_, query, response) -> Column:
    """The stripped response equals the instruction (no input), the input
    (no instruction), instruction+input stripped and glued, or the query."""
    r = ustrip(response)
    hi, hx = has_text(instruction), has_text(input_)
    hit = ((hi & ~hx & (r == ustrip(instruction)))
           | (hx & ~hi & (r == ustrip(input_)))
           | (hi & hx & (r == F.concat(ustrip(instruction), ustrip(input_))))
           | (r == ustrip(query)))
    return F.when(is_blank(response), F.lit(False)).otherwise(hit)


def build_query(instruction, input_) -> Column:
    """B2: ``Instruction: {i} Input: {x}`` / ``Instruction: {i}`` / ``Input: {x}``."""
    hi, hx = has_text(instruction), has_text(input_)
    return (F.when(hi & hx, F.concat(F.lit("Instruction: "), nz(instruction), F.lit(" Input: "), nz(input_)))
            .when(hi, F.concat(F.lit("Instruction: "), nz(instruction)))
            .otherwise(F.concat(F.lit("Input: "), nz(input_))))
