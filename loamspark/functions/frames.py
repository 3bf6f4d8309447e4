"""SQL over DataFrames, and the dense grid of features and samples where an operator needs its zeros."""

from __future__ import annotations

import uuid
from typing import Any

from pyspark.sql import DataFrame


def sql(query: str, **given: Any) -> DataFrame:
    """``query`` with DataFrames and values put in by name; Catalyst sees one plan.

    The views that name the DataFrames are dropped in the session's own catalog: dropping them through the public one, as
    ``spark.sql`` does with DataFrames that it is given, would also drop the cached data of any that are cached.
    """
    frames = {k: v for k, v in given.items() if isinstance(v, DataFrame)}
    spark = next(iter(frames.values())).sparkSession
    names = {k: f"_given_{k}_{uuid.uuid4().hex}" for k in frames}
    try:
        for k, frame in frames.items():
            frame.createOrReplaceTempView(names[k])
            query = query.replace(f"{{{k}}}", names[k])
        return spark.sql(query, **{k: v for k, v in given.items() if k not in frames})
    finally:
        catalog = spark._jsparkSession.sessionState().catalog()
        for name in names.values():
            catalog.dropTempView(name)


def densify(table: DataFrame) -> DataFrame:
    """Every feature with every sample, absent values as 0. The grid is the product of two distinct lists, so
    only operators that return a row for each cell ask for it; the others count absent cells instead."""
    return sql(
        """SELECT f.feature_id, s.sample_id, coalesce(t.value, 0D) AS value
           FROM (SELECT DISTINCT feature_id FROM {t}) f CROSS JOIN (SELECT DISTINCT sample_id FROM {t}) s
           LEFT JOIN {t} t ON t.feature_id = f.feature_id AND t.sample_id = s.sample_id""",
        t=table,
    )


def counts_below(table: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """``by..., value, n, below, total, bucket`` of every distinct value, none negative: its rows, the rows of smaller values, and all rows, null ones too.

    No task sorts all values: they are counted first, so ties are one row, then summed within buckets of a 64th of a power of two and over the buckets.
    """
    keys = "".join(f"{k}, " for k in by or [])
    part = f"PARTITION BY {keys[:-2]} " if by else ""
    same = "".join(f"o.{k} <=> b.{k} AND " for k in by or [])
    return sql(
        f"""WITH b AS (SELECT {keys}{value}, count(*) AS n, CASE WHEN {value} IS NULL THEN 2147483647 WHEN {value} > 0 THEN cast(floor(log2({value}) * 64) AS INT) ELSE -2147483648 END AS bucket FROM {{t}} GROUP BY {keys}{value}),
                 o AS (SELECT {keys}bucket, sum(sum(n)) OVER ({part}ORDER BY bucket) - sum(n) AS before, sum(sum(n)) OVER ({part}) AS total FROM b GROUP BY {keys}bucket)
            SELECT {"".join(f"b.{k}, " for k in by or [])}b.{value}, b.n, o.before + sum(b.n) OVER (PARTITION BY {"".join(f"b.{k}, " for k in by or [])}b.bucket ORDER BY b.{value}) - b.n AS below, o.total, b.bucket
            FROM b JOIN o ON {same}o.bucket = b.bucket""",
        t=table,
    )
