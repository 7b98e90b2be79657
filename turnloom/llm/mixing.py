"""Mixing sources to target weights: temperature mixing with native expressions only.

The weight of a source is its share of tokens to the power ``exponent``, normalised. The exponent lies
between 0 (all sources alike) and 1 (as they come) and is found by bisection: with ``target_entropy``
the largest one whose weights reach that entropy (in nats), with ``max_repeat`` the smallest one that
repeats no source more often. The weights are then realised as block permutations: every pass over a
source is a permutation of its rows by a seeded hash, the last pass is cut where the source's budget of
tokens ends, and all passes are laid evenly over blocks of about ``block_tokens`` tokens.

Running totals inside a pass use 4,096 buckets by hash prefix, so no window holds a whole source,
however large its share. Only sums over all sources reach the driver, 63 rows per step of six halvings.

Defined cases: a null source is a source of its own; a null text has no tokens; a source without tokens
has weight 0 and its rows pass once; repeated rows are rows of their own; an empty table gives an empty
result; other columns are untouched, and new columns give way to columns of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from turnloom.sources.sinks import written

HALVINGS, STEPS = 6, 8
BUCKET_DIGITS = 3


@dataclass(frozen=True)
class Mix:
    """What to aim at: exactly one of the two targets; ``budget`` in tokens.

    Without a budget, the mixture has as many tokens as its input; with ``cover`` it has as many as
    it takes to pass every source at least once, and ``max_repeat`` counts those passes.
    """

    target_entropy: float | None = None
    max_repeat: float | None = None
    budget: int | None = None
    cover: bool = False
    seed: int = 17
    block_tokens: int = 1 << 16

    def __post_init__(self):
        if (self.target_entropy is None) == (self.max_repeat is None):
            raise ValueError("give either target_entropy or max_repeat")
        if self.cover and self.budget is not None:
            raise ValueError("cover sets the budget itself")


def words(text: Column) -> Column:
    """Number of words, as the token measure."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def find_exponent(sources: DataFrame, mix: Mix) -> tuple[float, int]:
    """The exponent, and the total of all tokens; ``sources`` has one row per source (total > 0)."""
    total = sources.agg(F.sum("total")).first()[0] or 0
    if not total:
        return 1.0, 0
    share = F.col("total") / F.lit(float(total))
    budget = float(total if mix.budget is None else mix.budget)

    def measured(exponents: list[float]) -> dict[float, tuple[float, float]]:
        grid = sources.select(share.alias("p"), F.explode(F.array(*map(F.lit, exponents))).alias("a"))
        power = F.pow("p", F.col("a"))
        rows = grid.groupBy("a").agg(
            F.sum(power).alias("z"), F.sum(power * F.ln("p")).alias("s"),
            F.max(power / F.col("p")).alias("hi"), F.min(power / F.col("p")).alias("lo")).collect()
        out = {}
        for r in rows:
            passes = r["hi"] / r["lo"] if mix.cover else r["hi"] / r["z"] * budget / total
            out[r["a"]] = (_entropy(r["z"], r["s"], r["a"]), passes)
        return out

    def meets(entropy: float, passes: float) -> bool:
        if mix.target_entropy is not None:
            return entropy >= mix.target_entropy
        return passes <= mix.max_repeat

    rising = mix.target_entropy is None  # whether larger exponents are the ones that meet it
    ends = measured([0.0, 1.0])
    flattest, natural = meets(*ends[0.0]), meets(*ends[1.0])
    if rising:
        if flattest or not natural:
            return (0.0 if flattest else 1.0), total
    elif natural or not flattest:
        return (1.0 if natural else 0.0), total
    lo, hi = 0.0, 1.0
    for _ in range(STEPS):
        parts = 1 << HALVINGS
        points = [lo + (hi - lo) * i / parts for i in range(parts + 1)]
        met = measured(points[1:-1])
        for _ in range(HALVINGS):
            mid = (len(points) - 1) // 2
            right = meets(*met[points[mid]]) != rising  # the border lies above the middle
            points = points[mid:] if right else points[:mid + 1]
        lo, hi = points
    return (hi if rising else lo), total


def _entropy(z: float, s: float, exponent: float) -> float:
    import math

    return math.log(z) - exponent * s / z


def plan(rows: DataFrame, mix: Mix) -> DataFrame:
    """One row per source: source, total, weight, budget, passes (whole ones), rest (tokens)."""
    sources = written(rows.groupBy("source").agg(F.sum("tokens").alias("total")), "sources")
    positive = sources.where("total > 0")
    exponent, total = find_exponent(positive, mix)
    power = F.pow(F.col("total") / F.lit(float(total or 1)), F.lit(exponent))
    sums = positive.agg(F.sum(power), F.max(F.col("total") / power)).first()
    z, least = (sums[0] or 1.0), (sums[1] or 0.0)
    budget = float(total if mix.budget is None else mix.budget)
    scale = F.lit(least) if mix.cover else F.lit(budget) / F.lit(z)
    wanted = F.floor(power * scale + F.lit(0.5)).cast("long")
    some = F.col("total") > 0
    return sources.select(
        "source", "total", F.lit(exponent).alias("exponent"),
        F.when(some, power / F.lit(z)).otherwise(0.0).alias("weight"),
        F.when(some, wanted).otherwise(0).alias("budget"),
        F.when(some, F.expr("0L") + F.floor(wanted / F.greatest("total", F.lit(1))))
        .otherwise(1).cast("long").alias("passes"),
    ).withColumn("rest", F.when(some, F.col("budget") - F.col("passes") * F.col("total")).otherwise(0))


def _running(rows: DataFrame, by: list[str], key: str, tie: list[str]) -> DataFrame:
    """Add ``before``: tokens of earlier rows in the order of ``key`` inside ``by``."""
    bucket = F.substring(key, 1, BUCKET_DIGITS)
    rows = rows.withColumn("_bucket", bucket)
    keys = [*by, "_bucket"]
    sums = rows.groupBy(*keys).agg(F.sum("tokens").alias("_sum"))
    earlier = W.partitionBy(*by).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    start = sums.select(*[F.col(k).alias(f"_{k}") for k in keys],
                        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    inside = W.partitionBy(*keys).orderBy(key, *tie).rowsBetween(W.unboundedPreceding, -1)
    own = rows.withColumn("before", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return own.join(start, on).withColumn("before", F.col("before") + F.col("_start")).drop(
        "_bucket", "_start", *[f"_{k}" for k in keys])


def _key(seed: int, epoch: Column, doc_id: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"),
                             F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))))


def mixture(docs: DataFrame, mix: Mix, doc_id: str = "doc_id", source: str = "source",
            tokens: Column | None = None) -> DataFrame:
    """One row per row and pass that the mixture takes: doc_id, source, epoch, n_tokens, block, key.

    Sorted by block and key this is the training order; every block has the target weights.
    """
    tokens = words(F.col("text")) if tokens is None else tokens
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
                       tokens.alias("tokens"))
    per_source = plan(rows, mix).withColumnRenamed("source", "_of")
    epochs = F.sequence(F.lit(1).cast("long"), F.col("passes") + F.when(F.col("rest") > 0, 1).otherwise(0))
    planned = rows.join(per_source, F.col("source").eqNullSafe(F.col("_of"))).where(
        (F.col("passes") > 0) | (F.col("rest") > 0))
    passes = planned.select(
        "doc_id", "source", "tokens", "total", "budget", "passes", "rest",
        F.explode(epochs).alias("epoch"))
    passes = passes.withColumn("key", _key(mix.seed, F.col("epoch"), "doc_id"))
    placed = _running(passes, ["source", "epoch"], "key", ["tokens"])
    taken = placed.where((F.col("epoch") <= F.col("passes"))
                         | (F.col("before") + F.col("tokens") <= F.col("rest")))
    all_tokens = per_source.agg(F.sum("budget")).first()[0] or 0
    blocks = max(1, -(-all_tokens // mix.block_tokens))
    at = ((F.col("epoch") - 1) * F.col("total") + F.col("before")).cast("double")
    place = F.floor(at / F.greatest("budget", F.lit(1)).cast("double") * F.lit(float(blocks)))
    return taken.select(
        "doc_id", "source", "epoch", F.col("tokens").alias("n_tokens"),
        F.least(place, F.lit(blocks - 1)).cast("long").alias("block"), "key")


def mixed(docs: DataFrame, mix: Mix, doc_id: str = "doc_id", source: str = "source",
          text: str = "text") -> DataFrame:
    """The rows of ``docs`` as often as the mixture takes them, same columns.

    Membership needs only the order inside the last pass, so each row moves once, then repeats.
    """
    own = docs.columns
    inner = {c: f"_c{i}" for i, c in enumerate(own)}
    rows = docs.select(*[F.col(f"`{c}`").alias(inner[c]) for c in own],
                       words(F.col(text)).alias("tokens"))
    rows = rows.withColumn("source", F.col(inner[source]))
    per_source = plan(rows, mix).withColumnRenamed("source", "_of")
    planned = rows.join(per_source, F.col("source").eqNullSafe(F.col("_of")))
    planned = planned.withColumn("key", _key(mix.seed, F.col("passes") + 1, inner[doc_id]))
    placed = _running(planned, ["source"], "key", ["tokens"])
    times = F.col("passes") + F.when(F.col("before") + F.col("tokens") <= F.col("rest"),
                                     F.when(F.col("rest") > 0, 1).otherwise(0)).otherwise(0)
    return placed.withColumn("_times", times.cast("int")).where("_times > 0").withColumn(
        "_times", F.explode(F.array_repeat(F.lit(0), F.col("_times")))).select(
        *[F.col(inner[c]).alias(c) for c in own])


MAX_REPEAT = 1.25
SEED = 17


def op7_temperature_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mixture(docs, Mix(max_repeat=MAX_REPEAT, seed=SEED))


ORACLE = f"""
with recursive rows as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as tokens
  from documents),
totals as (select source, sum(tokens)::bigint as total from rows group by source),
shares as (select total, total / (select sum(total) from totals)::double as p from totals where total > 0),
halving(i, lo, hi) as (
  select 0, 0.0::double, 1.0::double
  union all
  select i + 1,
    case when f > {MAX_REPEAT} then (lo + hi) / 2 else lo end,
    case when f > {MAX_REPEAT} then hi else (lo + hi) / 2 end
  from (select i, lo, hi, (select max(pow(p, (lo + hi) / 2) / p) / sum(pow(p, (lo + hi) / 2)) from shares) as f
        from halving where i < {HALVINGS * STEPS})),
ends as (select (select max(1.0 / p) / count(*) from shares) as flat),
exponent as (
  select case when (select flat from ends) <= {MAX_REPEAT} then 0.0::double else hi end as a
  from halving where i = {HALVINGS * STEPS}),
powers as (
  select source, total, pow(total / (select sum(total) from totals)::double, (select a from exponent)) as w
  from totals),
budgets as (
  select source, total, case when total > 0 then floor(w * ((select sum(total) from totals)::double
      / (select sum(w) from powers where total > 0)) + 0.5)::bigint else 0 end as budget
  from powers),
plan as (
  select *, case when total > 0 then budget // total else 1 end as passes,
    case when total > 0 then budget - (budget // total) * total else 0 end as rest
  from budgets),
passes as (
  select r.doc_id, r.source, r.tokens, p.total, p.budget, p.passes, p.rest, e.epoch,
    md5(concat_ws(':', '{SEED}', e.epoch::varchar, r.doc_id::varchar)) as key
  from rows r join plan p on r.source is not distinct from p.source,
  lateral (select unnest(generate_series(1, p.passes + case when p.rest > 0 then 1 else 0 end)) as epoch) e),
placed as (
  select *, coalesce(sum(tokens) over (partition by source, epoch order by key, tokens
    rows between unbounded preceding and 1 preceding), 0)::bigint as before
  from passes),
blocks as (select greatest(1, ceil((select sum(budget) from budgets) / {1 << 16}.0))::bigint as n)
select doc_id, source, epoch, tokens as n_tokens, least(
    floor(((epoch - 1) * total + before)::double / greatest(budget, 1)::double * (select n from blocks)::double),
    (select n from blocks) - 1)::bigint as block, key
from placed where epoch <= passes or before + tokens <= rest
"""
