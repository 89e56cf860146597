"""Rule-based labels: channels, name-prefix groups, RFM code and segment."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def channel_by_sales_person(
    sales_person: Column | str = "SalesPersonID",
    with_person: str = "Offline",
    without: str = "Online",
) -> Column:
    """Channel version A: an order with a sales person is offline (B2B)."""
    return F.when(_col(sales_person).isNotNull(), F.lit(with_person)).otherwise(F.lit(without))


def channel_by_flag(
    flag: Column | str = "OnlineOrderFlag", online: str = "Online", offline: str = "Offline"
) -> Column:
    """Channel version B: label of the online-order flag (NULL is offline)."""
    return F.when(_col(flag) == 1, F.lit(online)).otherwise(F.lit(offline))


def label_by_prefix(
    name: Column | str,
    groups: Sequence[tuple[str, Iterable[str]]],
    default: str | None = None,
) -> Column:
    """First group whose prefix starts ``name`` gives the label.

    Prefix tests compile to ``StartsWith``, which Parquet scans can push down.
    """
    col = _col(name)
    expr = None
    for label, prefixes in groups:
        cond = None
        for p in prefixes:
            c = col.startswith(p)
            cond = c if cond is None else (cond | c)
        if cond is None:
            continue
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    if expr is None:
        return F.lit(default).cast(T.StringType())
    return expr.otherwise(F.lit(default)) if default is not None else expr


def rfm_code(recency: Column | str, frequency: Column | str, monetary: Column | str) -> Column:
    """Digits R, F, M concatenated; a NULL score is skipped, not propagated."""
    return F.concat_ws(
        "",
        _col(recency).cast(T.StringType()),
        _col(frequency).cast(T.StringType()),
        _col(monetary).cast(T.StringType()),
    )


def _sql_str(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def segment_by_rules(code: str, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """First ``LIKE`` pattern matching the column ``code`` gives the segment.

    The rule chain is sent to the JVM as one SQL expression instead of one
    call per condition.
    """
    c = "`" + code.replace("`", "``") + "`"
    whens = " ".join(f"WHEN {c} LIKE {_sql_str(p)} THEN {_sql_str(label)}" for label, p in rules)
    return F.expr(f"CASE {whens} ELSE {_sql_str(default)} END" if rules else _sql_str(default))
