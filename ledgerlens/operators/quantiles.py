"""Exact PERCENT_RANK tiers without a global window.

``PERCENT_RANK() OVER (ORDER BY v)`` followed by ``<= 0.25 / 0.5 / 0.75``
tiers puts every row in one partition. Only the tier is needed, and the
percent rank is monotone in ``v``, so a tier is fixed by a *cut value* per
threshold: ``cut_p = max{v : percent_rank(v) <= p}`` and
``percent_rank(v) <= p  <=>  v <= cut_p``.

The cuts are computed exactly and distributed, the same way at every size:

1. one aggregate over the whole input takes approximate quantiles of each
   measure as the boundaries of ``ranges`` value ranges (only these reach the
   driver). They are one literal array per measure, and a binary search in it maps
   each value to its range: no code grows with the ranges, the range is a function
   of the value alone and equal values share a range;
2. the measures are stacked into ``(measure, range, value)`` rows, the value
   in a column of the measure's own type, and reduced to distinct ones with
   their multiplicity (map-side combined: a hot value becomes one row);
3. a running count inside each range plus the broadcast count of all lower
   ranges (one row per range: bounded by ``ranges``) gives ``rank - 1`` =
   rows strictly below ``v``; the percent rank is then taken with the same
   double division as the window function;
4. one global aggregate keeps, per measure and threshold, the largest value
   whose percent rank is within it -- a single row that is broadcast.

Boundaries only balance the work, never the result. The input is read twice
(boundaries, cuts): pass a materialised or cheap DataFrame.

Each measure keeps its type: integers, decimals, floating numbers, dates and
timestamps (the last two count as days and microseconds). NULL values sort
first, as in ``ORDER BY v ASC``; NaN sorts last and equals itself.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATING = (T.FloatType, T.DoubleType)


def cut_name(measure: str, i: int) -> str:
    return f"__{measure}_cut{i}"


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def work_sql(v: str, kind: T.DataType) -> str:
    """SQL of ``v`` in the type it is ranked in: exact for every value of ``kind``."""
    if isinstance(kind, _INTEGRAL):
        return f"CAST({v} AS BIGINT)"
    if isinstance(kind, T.DecimalType):
        return v
    if isinstance(kind, _FLOATING):
        return f"CAST({v} AS DOUBLE)"
    if isinstance(kind, T.DateType):
        return f"CAST(unix_date({v}) AS BIGINT)"
    if isinstance(kind, T.TimestampType):
        return f"unix_micros({v})"
    raise TypeError(f"cannot rank a {kind.simpleString()}: use a number, date or timestamp")


def range_of(v: Column, bounds: Column, ranges: int) -> Column:
    """Number of the sorted array ``bounds`` (under ``ranges`` of them) that are below ``v``; NULL -> -1.

    A binary search: the widest step first, and each step is taken if the bound there is below ``v``.
    """
    widths = F.array(*[F.lit(1 << i) for i in reversed(range(max(1, ranges).bit_length()))])

    def step(i: Column, w: Column) -> Column:
        return F.when((i + w <= F.size(bounds)) & (F.element_at(bounds, i + w) < v), i + w).otherwise(i)

    return F.when(v.isNull(), -1).otherwise(F.aggregate(widths, F.lit(0), step))


def _literal(values: Sequence, kind: T.DataType) -> Column:
    """``values`` as one literal array: a cast of their text, which Catalyst folds once."""
    text = ",".join(repr(x) if isinstance(x, float) else str(x) for x in values)
    return F.expr(f"CAST({'split(' + repr(text) + ', ' + repr(',') + ')' if values else 'array()'} AS ARRAY<{kind.simpleString()}>)")


def _prepare(df: DataFrame, measures: Mapping[str, Column | str]) -> DataFrame:
    """The measures alone, renamed, each in the type it is ranked in."""
    raw = df.select(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in measures.items()])
    return raw.selectExpr(*[f"{work_sql(_q(n), raw.schema[n].dataType)} AS {_q(n)}" for n in measures])


def _default_ranges(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _range_bounds(typed: DataFrame, names: Sequence[str], ranges: int) -> list[Column]:
    """Per measure a sorted array of distinct range boundaries: approximate quantiles of the whole input.

    NaN and infinities are no boundaries; they fall into the last or first range.
    """
    kinds = [typed.schema[n].dataType for n in names]
    if ranges < 2:
        return [_literal([], k) for k in kinds]

    def finite(n: str) -> str:
        if isinstance(typed.schema[n].dataType, T.DoubleType):
            return f"CASE WHEN NOT isnan({_q(n)}) AND abs({_q(n)}) < double('Infinity') THEN {_q(n)} END"
        return _q(n)

    at = f"CAST(split('{','.join(repr(i / ranges) for i in range(1, ranges))}', ',') AS ARRAY<DOUBLE>)"
    row = typed.selectExpr(*[f"percentile_approx({finite(n)}, {at}, {max(10000, 10 * ranges)}) AS {_q(n)}" for n in names]).first()
    return [_literal(sorted({b for b in (row[n] or []) if b is not None}), k) for n, k in zip(names, kinds, strict=True)]


def percent_rank_cuts(
    df: DataFrame,
    measures: Mapping[str, Column | str],
    probs: Sequence[float] = (0.25, 0.5, 0.75),
    ranges: int | None = None,
) -> DataFrame:
    """One row: for each measure and each ``p`` the cut value (see module doc).

    ``ranges`` is the number of value ranges per measure (default: the
    session's shuffle partitions); it sets parallelism only.
    """
    names = list(measures)
    typed = _prepare(df, measures)
    ranges = ranges or _default_ranges(df.sparkSession)
    bounds = _range_bounds(typed, names, ranges)

    # (measure, range, value) rows; a measure's value is in its own column.
    value = [f"v{i}" for i in range(len(names))]

    def stacked(i: int, n: str) -> Column:
        own = [(F.col(_q(n)) if j == i else F.lit(None).cast(typed.schema[m].dataType)).alias(f"v{j}") for j, m in enumerate(names)]
        return F.struct(F.lit(i).alias("m"), range_of(F.col(_q(n)), bounds[i], ranges).alias("rng"), *own)

    distinct = (
        typed.select(F.inline(F.array(*[stacked(i, n) for i, n in enumerate(names)])))
        .groupBy("m", "rng", *value)
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    # Rows in lower ranges of the same measure, and n per measure: one row per
    # (measure, range), so these windows are bounded by the number of ranges.
    offsets = distinct.groupBy("m", "rng").agg(F.sum("cnt").alias("rcnt")).selectExpr(
        "m",
        "rng",
        "coalesce(sum(rcnt) OVER (PARTITION BY m ORDER BY rng"
        " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off",
        "sum(rcnt) OVER (PARTITION BY m) AS n",
    )
    order = ", ".join(f"{v} ASC NULLS FIRST" for v in value)
    frame = f"ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    scored = (
        distinct.join(F.broadcast(offsets), ["m", "rng"])
        .selectExpr("m", *value, f"off + sum(cnt) OVER (PARTITION BY m, rng {frame}) - cnt AS less", "n")
        .selectExpr("m", *value, "CASE WHEN n > 1 THEN CAST(less AS DOUBLE) / CAST(n - 1 AS DOUBLE) ELSE 0.0D END AS pr")
    )
    return scored.selectExpr(
        *[
            f"max(CASE WHEN m = {i} AND pr <= {float(p)!r}D THEN v{i} END) AS {_q(cut_name(n, k))}"
            for i, n in enumerate(names)
            for k, p in enumerate(probs)
        ]
    )


def tier_sql(value: str, cuts: Sequence[str], descending: bool = False) -> str:
    """SQL: 1..len(cuts)+1 by the first cut ``value`` does not exceed (NULL
    lowest); ``descending`` reverses the scores (lowest values score top)."""
    top = len(cuts) + 1

    def score(t: int) -> int:
        return top + 1 - t if descending else t

    whens = " ".join(f"WHEN {value} <= {c} THEN {score(t)}" for t, c in enumerate(cuts, start=1))
    return f"CAST(CASE WHEN {value} IS NULL THEN {score(1)} {whens} ELSE {score(top)} END AS INT)"


def percent_rank_tiers(
    df: DataFrame,
    specs: Mapping[str, tuple[str, bool]],
    probs: Sequence[float] = (0.25, 0.5, 0.75),
    ranges: int | None = None,
) -> DataFrame:
    """Add one tier column per ``out -> (measure column, descending)``.

    Equal to ``CASE WHEN PERCENT_RANK() OVER (ORDER BY measure) <= p1 ...``
    for every row, ties included; the only broadcast is the one-row cuts.
    """
    cuts = percent_rank_cuts(df, {out: m for out, (m, _) in specs.items()}, probs, ranges)
    tiers = [
        tier_sql(work_sql(_q(measure), df.schema[measure].dataType), [_q(cut_name(name, k)) for k in range(len(probs))], descending)
        + f" AS {_q(name)}"
        for name, (measure, descending) in specs.items()
    ]
    return df.crossJoin(F.broadcast(cuts)).selectExpr(*[_q(c) for c in df.columns], *tiers)


def quartile_score(df: DataFrame, measure: str, out: str, ascending: bool = True) -> DataFrame:
    """1-4 score by ``PERCENT_RANK`` quarter of ``measure`` (4 = highest when
    ``ascending``; reversed otherwise, as for recency)."""
    return percent_rank_tiers(df, {out: (measure, not ascending)})
