"""Score formatting."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from turnloom.functions.lists import let
from turnloom.functions.text import col


def _fixed4(x: str) -> str:
    small = f"{x} < {1 / 256}D"
    bits = f"cast(cast({x} * if({small}, {2.0**68:.0f}D, {2.0**60:.0f}D) as bigint) as decimal(19,0))"
    unit = f"cast(if({small}, '{1 << 68}', '{1 << 60}') as decimal(21,0))"
    whole = "cast((d.scaled - d.scaled % d.unit) / d.unit as bigint)"
    twice = "d.scaled % d.unit * 2"
    up = f"({twice} > d.unit or ({twice} = d.unit and {whole} % 2 = 1))"
    return (
        f"get(transform(transform(array(named_struct('scaled', {bits} * 10000, 'unit', {unit})), "
        f"d -> format_string('%05d', {whole} + cast({up} as bigint))), "
        "t -> concat(substring(t, 1, 1), '.', substring(t, 2, 4))), 0)"
    )


def fixed4(x: str) -> Column:
    """Four decimals of a score between 0 and 1, rounded on the exact binary value.

    ``format_string`` rounds the shortest decimal form half up, so 1/32 would become 0.0313
    where C-style formatting gives 0.0312. Scaling by a power of two is exact; 2**60 holds all
    bits of a value from 1/256 on, 2**68 those of a smaller one that can still round up. The
    rest is integer arithmetic, half to even. ``x`` is a column name or SQL expression.
    """
    return F.expr(_fixed4(x))


def format_scores(arr: str, sep: str = "|") -> Column:
    """All scores of an array, four decimals each, joined."""
    return F.array_join(F.expr(f"transform({arr}, x -> {_fixed4('x')})"), sep)


def beam_softmax(scores: Column | str) -> Column:
    """Softmax over the beam scores of a row; ``[0]`` for one beam."""

    def soft(s: Column) -> Column:
        top = F.array_max(s)
        exps = F.transform(s, lambda x: F.exp(x - top))
        return let(
            exps,
            lambda e: let(
                F.aggregate(e, F.lit(0.0), lambda a, x: a + x),
                lambda total: F.transform(e, lambda x: x / total),
            ),
        )

    return F.when(F.size(col(scores)) > 1, let(col(scores), soft)).otherwise(
        F.transform(col(scores), lambda _: F.lit(0.0))
    )
