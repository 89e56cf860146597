"""The ten reference-shaped tables as one bundle of lazy DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.schema import SCHEMAS

TABLE_NAMES = (
    "sales_order_header",
    "sales_order_detail",
    "customer",
    "sales_territory",
    "product",
    "purchase_order_header",
    "purchase_order_detail",
    "vendor",
    "work_order",
    "scrap_reason",
)

Source = DataFrame | Callable[[], DataFrame]


class Tables:
    """Reference-shaped inputs, one lazy DataFrame per table.

    A table may be given as a DataFrame or as a function building one; the
    function runs on first use, so an analysis resolves (lists, reads the
    footers of) only the files it touches. Tables an analysis does not use
    may be left out.

    ``sales_order_header.TerritoryID`` may be absent when the territory is
    only known through the customer; ``customer.TerritoryID`` is used then.
    """

    def __init__(self, **sources: Source) -> None:
        unknown = set(sources) - set(TABLE_NAMES)
        if unknown:
            raise TypeError(f"unknown tables: {sorted(unknown)}")
        self._sources = dict(sources)
        self._frames: dict[str, DataFrame] = {}
        self._shared: dict[object, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in TABLE_NAMES:
            raise AttributeError(name)
        if name not in self._sources:
            raise AttributeError(f"table {name!r} was not given; the analysis needs it")
        if name not in self._frames:
            src = self._sources[name]
            self._frames[name] = src if isinstance(src, DataFrame) else src()
        return self._frames[name]

    def shared(self, key: object, build: Callable[[], DataFrame]) -> DataFrame:
        """A materialised result that several analyses of this bundle read: built on first use.

        It lives as long as the bundle does, so a new bundle sees new files.
        """
        if key not in self._shared:
            self._shared[key] = build()
        return self._shared[key]

    @staticmethod
    def names() -> tuple[str, ...]:
        return TABLE_NAMES


def read_reference(spark: SparkSession, root: str, fmt: str = "parquet") -> Tables:
    """Read ``{root}/{table}`` for every table with its declared schema.

    The schema is given, not inferred, so the scan never samples files and
    only the columns a query uses are read (column pruning).
    """

    def reader(name: str) -> Callable[[], DataFrame]:
        return lambda: spark.read.format(fmt).schema(SCHEMAS[name]).load(f"{root}/{name}")

    return Tables(**{name: reader(name) for name in TABLE_NAMES})
