"""Text expressions. Every function takes and returns Columns and stays in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinmatch import fixed_values as fixed

# Unicode white space plus the four ASCII separators.
SPACE = r"[\s\x1c-\x1f]"
_LEADING_OR_TRAILING = rf"(?U)^{SPACE}+|{SPACE}+\z"
_SPACES = rf"(?U){SPACE}+"
_NOT_WORD_NOR_SPACE = r"(?U)[^\p{L}\p{N}_\s\x1c-\x1f]+"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also inside nested lambdas."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    return F.regexp_replace(text, _LEADING_OR_TRAILING, "")


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(rf"(?U)[^\s\x1c-\x1f]")


def split_words(text: Column) -> Column:
    """White-space separated words, without empty ones."""
    return F.filter(F.split(text, _SPACES), lambda w: w != "")


def tokens(text: Column) -> Column:
    """All tokens in order: Hangul runs, letters with digit tails, digits with letters."""
    return F.regexp_extract_all(
        F.lower(F.coalesce(text, F.lit(""))), F.lit(fixed.TOKEN_PATTERN), F.lit(0)
    )


def content_tokens(text: Column, stop_words: Sequence[str] = fixed.STOP_WORDS) -> Column:
    """Tokens of two or more characters that are not stop words."""
    return F.filter(
        tokens(text), lambda t: (F.length(t) >= 2) & ~t.isin(list(stop_words))
    )


def ranked_keywords(
    text: Column,
    max_keywords: int | Column = 5,
    stop_words: Sequence[str] = fixed.STOP_WORDS,
) -> Column:
    """Keywords as ``array<struct<token, score>>``, best first.

    score = share of the text's tokens + min(length / 10, 0.5); ties keep the order
    of first occurrence. Counting happens inside the row: equal tokens are neighbours
    once sorted, so the work is n log n per text and no shuffle is needed.
    """

    limit = max_keywords if isinstance(max_keywords, Column) else F.lit(max_keywords)

    def over_sorted(all_tokens, ordered):
        n = F.size(ordered)
        # positions in `ordered` where a new token starts, and the end
        starts = F.filter(
            F.sequence(F.lit(0), n - 1),
            lambda i: (i == 0) | (ordered[i] != ordered[F.greatest(i - 1, F.lit(0))]),
        )
        bounds = F.concat(starts, F.array(n))
        # the same distinct tokens, alphabetical, with their rank of first occurrence
        firsts = F.sort_array(
            F.transform(
                F.array_distinct(all_tokens),
                lambda t, i: F.struct(t.alias("token"), i.alias("first")),
            )
        )
        return let(bounds, lambda bs: best_first(n.cast("double"), bs, firsts))

    def best_first(n, bounds, firsts):
        def entry(first, i):
            token = first["token"]
            share = (bounds[i + 1] - bounds[i]) / n
            return F.struct(
                (-(share + F.least(F.length(token) / F.lit(10.0), F.lit(0.5)))).alias("minus"),
                first["first"].alias("first"),
                token.alias("token"),
            )

        ranked = F.slice(F.sort_array(F.transform(firsts, entry)), F.lit(1), limit)
        return F.transform(
            ranked, lambda e: F.struct(e["token"].alias("token"), (-e["minus"]).alias("score"))
        )

    empty = F.expr("cast(array() as array<struct<token:string,score:double>>)")
    return let(
        content_tokens(text, stop_words),
        lambda ts: F.when(F.size(ts) == 0, empty).otherwise(
            let(F.sort_array(ts), lambda ordered: over_sorted(ts, ordered))
        ),
    )


def keywords(text: Column, max_keywords: int | Column = 5) -> Column:
    """The tokens of ``ranked_keywords`` as ``array<string>``."""
    return F.transform(ranked_keywords(text, max_keywords), lambda e: e["token"])


def noun_keywords(text: Column, max_keywords: int = 5) -> Column:
    """First distinct tokens of two or more characters; stop words stay."""
    long_enough = F.filter(tokens(text), lambda t: F.length(t) >= 2)
    return F.slice(F.array_distinct(long_enough), 1, max_keywords)


def searchable_text(title: Column | None, fields: Sequence[Column]) -> Column:
    """Lower-cased words of the fields without punctuation, one text.

    Square brackets in the title separate words; elsewhere punctuation vanishes.
    """
    parts = [F.lower(F.coalesce(f, F.lit(""))) for f in fields]
    if title is not None:
        unbracketed = F.regexp_replace(F.coalesce(title, F.lit("")), r"[\[\]]", " ")
        parts = [F.lower(unbracketed), *parts]
    return F.regexp_replace(F.concat_ws(" ", *parts), _NOT_WORD_NOR_SPACE, "")


def matched_keywords(keyword_list: Column, text: Column) -> Column:
    """Keywords contained in some word of ``searchable_text``, spelling and order kept.

    A keyword without white space lies inside one word exactly when it lies in the text.
    """

    def is_match(words, keyword):
        return let(
            strip(F.lower(keyword)),
            lambda k: (F.length(k) >= 2)
            & ~k.rlike(rf"(?U){SPACE}")
            & F.contains(words, k),
        )

    return let(text, lambda words: F.filter(keyword_list, lambda k: is_match(words, k)))


def embedding_text(*fields: Column) -> Column:
    """Non-blank fields, trimmed, joined by one space."""
    return F.concat_ws(" ", *[F.nullif(strip(f), F.lit("")) for f in fields])


def without_prefix(
    text: Column, prefix: str = fixed.SUMMARY_PREFIX, leading_only: bool = False
) -> Column:
    """Drop every occurrence of ``prefix``, or only a leading one with its blanks."""
    if leading_only:
        return F.regexp_replace(text, rf"(?U)^\Q{prefix.rstrip()}\E\s*", "")
    return F.replace(text, F.lit(prefix), F.lit(""))


def ellipsis(text: Column, max_chars: int) -> Column:
    return F.when(
        F.length(text) > max_chars, F.concat(F.left(text, F.lit(max_chars)), F.lit("..."))
    ).otherwise(text)


def two_decimals(score: Column) -> Column:
    """Half-to-even rounding to hundredths."""
    return F.bround(score * 100) / 100


def two_decimal_text(score: Column) -> Column:
    return F.format_string("%.2f", score)


def clamp_limit(
    requested: Column, default: int = fixed.DEFAULT_RESULTS, maximum: int = fixed.MAX_RESULTS
) -> Column:
    """Requested number of results, at most ``maximum``; below zero becomes NULL."""
    wanted = F.coalesce(requested, F.lit(default))
    return F.when(wanted >= 0, F.least(wanted, F.lit(maximum)))


def normalized_cell(value: Column, is_date: bool = False) -> Column:
    """Trimmed cell text; texts that mean "no value" become NULL; dates keep ten characters."""
    trimmed = strip(value)
    kept = F.when(~trimmed.isin(fixed.NULL_TEXTS), trimmed)
    return F.left(kept, F.lit(10)) if is_date else kept


def matches_any(message: Column, patterns: Sequence[str]) -> Column:
    """Whether any pattern occurs anywhere in the message, ignoring case; only \\n ends a line."""
    return F.coalesce(message, F.lit("")).rlike("(?iud)" + "|".join(patterns))
