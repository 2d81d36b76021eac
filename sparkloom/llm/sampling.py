"""Bounded samples of labelled rows, which models are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.storage import materialize


def bounded_sample(rows: DataFrame, text: str, most_rows: int, most_bytes: int, label: str) -> DataFrame:
    """Distinct rows, all if they are at most about most_rows with most_bytes of text, else as large a share of them by a
    hash of the whole row. Equal rows count once, so no row that is repeated, and no id that many rows share (or lack),
    fills the sample or keeps others out. How many distinct rows there are is estimated within 2 percent in one pass
    without a shuffle. Written to a table."""
    place = F.xxhash64(*rows.columns)
    n, size = rows.agg(F.approx_count_distinct(place, 0.02), F.avg(F.octet_length(text))).first()
    share = min(1.0, most_rows / max(1, n), most_bytes / max(1.0, n * (size or 0.0)))
    if share < 1:
        rows = rows.filter(F.pmod(place, F.lit(1 << 30)) < int(share * (1 << 30)))
    return materialize(rows.distinct(), label)
