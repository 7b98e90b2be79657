"""Text normalisation as native column expressions (JVM side, no regular expression where a
plain replace or trim does)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from turnloom import fixed_values as fv


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def replace(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def strip(c: Column | str) -> Column:
    """Remove Unicode white space at both ends (``trim`` alone removes blanks only)."""
    return F.btrim(col(c), F.lit(fv.WHITESPACE))


def norm_space(c: Column | str) -> Column:
    """NBSP to blank, one pass of double blank to blank, strip; three blanks become two."""
    return strip(replace(replace(col(c), fv.NBSP, " "), "  ", " "))


def norm_topic(c: Column | str) -> Column:
    """The form in which topics are compared."""
    return F.lower(norm_space(c))


def norm_answer(c: Column | str, drop_quotes: bool = False) -> Column:
    """The form in which answers are scored: double blanks go before NBSP does."""
    out = replace(replace(col(c), "  ", " "), fv.NBSP, " ")
    if drop_quotes:
        out = replace(out, '"', "")
    return strip(F.lower(out))


def dialog_text(c: Column | str) -> Column:
    """Turn separators to newlines, without the last newline; an empty dialog stays empty."""
    lines = replace(col(c), fv.TURN_SEPARATOR, "\n")
    return F.when(F.endswith(lines, F.lit("\n")), F.left(lines, F.length(lines) - 1)).otherwise(
        lines
    )


def response_text(c: Column | str) -> Column:
    return replace(col(c), fv.TURN_SEPARATOR, "")


def profile_filter(c: Column | str) -> Column:
    """Keep the accepted/rejected facts of a profile; ``None`` when none is left."""
    facts = F.split(col(c), r"\|")
    kept = F.filter(
        facts, lambda f: F.contains(F.lower(f), F.lit(fv.PROFILE_KEEP[0]))
        | F.contains(F.lower(f), F.lit(fv.PROFILE_KEEP[1]))
    )
    text = strip(F.array_join(F.transform(kept, strip), fv.PROFILE_JOINER))
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(fv.EMPTY_PROFILE))


def rationale(c: Column | str) -> Column:
    """The text before the first conclusion word."""
    return strip(F.substring_index(col(c), fv.CONCLUSION, 1))


def after_last(c: Column | str, marker: str) -> Column:
    """The text after the last marker; the whole text when the marker is absent."""
    return F.substring_index(col(c), marker, -1)


def parse_response(c: Column | str, marker: str = fv.RESPONSE_MARKER) -> Column:
    return strip(after_last(c, marker))


def append_label(prompt: Column | str, label: Column | str) -> Column:
    """The label is glued on without a blank."""
    return F.concat(col(prompt), col(label))
