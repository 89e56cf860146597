"""ledgerlens — order-to-cash analytics (sales, product, purchasing,
production, customer segmentation) as PySpark DataFrame functions.

Layout
------
``sources``    reference-shaped tables: declared schemas, readers, bucketed
               catalog tables, the stand-in views over the TPC-H-like test
               tables, materialise (Parquet in the checkpoint folder).
``functions``  column-level building blocks (money casts, guarded rates,
               calendar keys, channel labels, prefix/pattern labelling).
``operators``  reusable DataFrame operators (integrity check, period
               growth, share of total, ranking / top-n, profitability,
               exact percent-rank tiers without a global window).
``plans``      the analyses themselves, one function per result set, plus
               the registry used by ``__spark_entry__`` and ``bench.py``.
"""

from ledgerlens.params import Params, REFERENCE_PARAMS, STANDIN_PARAMS
from ledgerlens.sources.tables import Tables

__all__ = ["Params", "REFERENCE_PARAMS", "STANDIN_PARAMS", "Tables"]
__version__ = "0.1.0"
