"""n-grams and sentence BLEU inside a row, linear in the number of words.

The expressions are SQL text: one parse instead of hundreds of calls into the JVM for building
the same tree column by column. Arguments are column names or SQL expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from turnloom.functions.tokens import WORD

_NO_GRAMS = "cast(array() as array<string>)"


def _let(value: str, name: str, body: str) -> str:
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _words(text: str) -> str:
    return f"regexp_extract_all({text}, r'{WORD}', 0)"


def _ngrams(tokens: str, k: int) -> str:
    """k-grams of a bound token array, joined by a blank."""
    if k == 1:
        return tokens
    return (
        f"if(size({tokens}) >= {k}, transform(sequence(1, size({tokens}) - {k - 1}), "
        f"i -> array_join(slice({tokens}, i, {k}), ' ')), {_NO_GRAMS})"
    )


def _occurrences(grams: str) -> str:
    """Every element tagged with its running number among equal ones.

    The common tags of two lists are then their clipped matches, found by a hash set instead
    of comparing all pairs. Equal elements are neighbours after the sort, so the number is the
    distance from the start of the run.
    """
    starts = "filter(sequence(1, size(s)), i -> i = 1 or get(s, i - 1) <> get(s, i - 2))"
    run = "sequence(1, coalesce(get(b, j + 1), size(s) + 1) - start)"
    tags = f"flatten(transform(b, (start, j) -> transform({run}, r -> concat(get(s, start - 1), ' #', r))))"
    return _let(
        f"sort_array({grams})", "s", f"if(size(s) > 0, {_let(starts, 'b', tags)}, {_NO_GRAMS})"
    )


def _clipped(p: str, r: str, k: int) -> str:
    return (
        f"size(array_intersect({_occurrences(_ngrams(p, k))}, {_occurrences(_ngrams(r, k))}))"
    )


def words(text: str) -> Column:
    """Words without white space."""
    return F.expr(_words(text))


def ngrams(text: str, k: int) -> Column:
    """k-grams of a text, joined by a blank."""
    return F.expr(_let(_words(text), "w", _ngrams("w", k)))


def clipped_matches(a: str, b: str) -> Column:
    """Size of the multiset intersection of two arrays."""
    return F.expr(f"size(array_intersect({_occurrences(a)}, {_occurrences(b)}))")


def bleu_scores(pred: str, ref: str, orders: tuple[int, ...] = (1, 2, 3, 4)) -> Column:
    """One score per order k: brevity penalty times clipped k-gram precision, unsmoothed."""
    c, r = "size(w.p)", "size(w.r)"
    penalty = f"if({c} > {r}, 1D, exp(1D - {r} / {c}))"
    scores = ", ".join(
        f"{penalty} * {_clipped('w.p', 'w.r', k)} / greatest(1, {c} - {k - 1})" for k in orders
    )
    zeros = ", ".join("0D" for _ in orders)
    both = f"named_struct('p', {_words(pred)}, 'r', {_words(ref)})"
    return F.expr(_let(both, "w", f"if({c} = 0, array({zeros}), array({scores}))"))


def bleu_sample(pred: str, ref: str, k: int) -> Column:
    """Sentence BLEU of order k."""
    return F.get(bleu_scores(pred, ref, (k,)), F.lit(0))
