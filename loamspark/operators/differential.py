"""Centred log-ratios and tests between groups, from sparse rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamspark.functions import special
from loamspark.functions.frames import densify, sql
from loamspark.operators.composition import benjamini_hochberg


def clr(table: DataFrame, pseudocount: float = 1.0) -> DataFrame:
    """ln(v + c) less its mean over all features of the sample, for every cell."""
    return sql("SELECT feature_id, sample_id, ln(value + {c}) - avg(ln(value + {c})) OVER (PARTITION BY sample_id) AS clr FROM {t}", t=densify(table), c=pseudocount)


def differential(table: DataFrame, meta: DataFrame, group1: str, group2: str, pseudocount: float = 1.0) -> DataFrame:
    """Difference of CLR means, Welch's t with its degrees of freedom, and Cohen's d for every feature.

    An absent cell's CLR is ln c less the sample's mean, whatever the feature, so group totals of that number plus the present
    cells' differences from it give every sum: one aggregation of the present cells, no dense table. Groups of one sample and equal
    values have no t; ValueError if a group has no sample.
    """
    for g in (group1, group2):
        if meta.where(F.col("grp") == g).isEmpty():
            raise ValueError(f"group without samples: {g}")
    return sql(
        """WITH f AS (SELECT feature_id, count(*) AS x FROM {t} GROUP BY feature_id),
                k AS (SELECT count(*) AS f FROM f),
                base AS (SELECT sample_id, ln({c}) - (sum(ln(value + {c})) + (max(k.f) - count(*)) * ln({c})) / max(k.f) AS b FROM {t} CROSS JOIN k GROUP BY sample_id),
                s AS (SELECT base.sample_id, m.grp = {g1} AS first, base.b FROM base JOIN {m} m ON m.sample_id = base.sample_id WHERE m.grp IN ({g1}, {g2})),
                n AS (SELECT count_if(first) AS n1, count_if(NOT first) AS n2, coalesce(sum(b) FILTER (WHERE first), 0D) AS b1, coalesce(sum(b) FILTER (WHERE NOT first), 0D) AS b2,
                             coalesce(sum(b * b) FILTER (WHERE first), 0D) AS q1, coalesce(sum(b * b) FILTER (WHERE NOT first), 0D) AS q2 FROM s),
                z AS (SELECT t.feature_id, s.first, ln(t.value + {c}) - ln({c}) AS d, s.b FROM {t} t JOIN s ON s.sample_id = t.sample_id),
                a AS (SELECT feature_id, coalesce(sum(d) FILTER (WHERE first), 0D) AS d1, coalesce(sum(d) FILTER (WHERE NOT first), 0D) AS d2,
                             coalesce(sum(d * (d + 2 * b)) FILTER (WHERE first), 0D) AS e1, coalesce(sum(d * (d + 2 * b)) FILTER (WHERE NOT first), 0D) AS e2 FROM z GROUP BY feature_id),
                v AS (SELECT f.feature_id, n1, n2, (b1 + coalesce(d1, 0D)) / n1 AS m1, (b2 + coalesce(d2, 0D)) / n2 AS m2,
                             CASE WHEN n1 > 1 THEN greatest((q1 + coalesce(e1, 0D) - pow(b1 + coalesce(d1, 0D), 2) / n1) / (n1 - 1), 0D) END AS v1,
                             CASE WHEN n2 > 1 THEN greatest((q2 + coalesce(e2, 0D) - pow(b2 + coalesce(d2, 0D), 2) / n2) / (n2 - 1), 0D) END AS v2
                      FROM f CROSS JOIN n LEFT JOIN a ON a.feature_id = f.feature_id)
           SELECT feature_id, m1 - m2 AS lfc,
                  CASE WHEN v1 + v2 > 1e-24D THEN (m1 - m2) / sqrt(v1 / n1 + v2 / n2) END AS t,
                  CASE WHEN v1 + v2 > 1e-24D THEN pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)) END AS df,
                  coalesce(CASE WHEN v1 + v2 > 1e-24D THEN (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) END, 0D) AS effect
           FROM v""",
        t=table, m=meta, g1=group1, g2=group2, c=pseudocount,
    )


def differential_test(table: DataFrame, meta: DataFrame, group1: str, group2: str, pseudocount: float = 1.0) -> DataFrame:
    """``differential`` with two-sided p (1 where there is no t) and Benjamini-Hochberg q."""
    rows = differential(table, meta, group1, group2, pseudocount)
    return benjamini_hochberg(rows.withColumn("p", F.coalesce(special.t_p(F.col("t"), F.col("df")), F.lit(1.0))))


def kruskal_wallis(table: DataFrame, meta: DataFrame) -> DataFrame:
    """H with tie correction for every feature, and its degrees of freedom; null where all values are equal.

    Values are not negative, so a feature's absent cells are its lowest tie: only present cells are ranked, above them.
    """
    return sql(
        """WITH s AS (SELECT m.sample_id, m.grp FROM {m} m LEFT SEMI JOIN {t} t ON t.sample_id = m.sample_id),
                g AS (SELECT grp, count(*) AS n FROM s GROUP BY grp),
                k AS (SELECT sum(n) AS n, count(*) AS groups FROM g),
                x AS (SELECT t.feature_id, s.grp, t.value FROM {t} t JOIN s ON s.sample_id = t.sample_id WHERE t.value > 0),
                r AS (SELECT feature_id, grp, rank() OVER (PARTITION BY feature_id ORDER BY value) AS lo, count(*) OVER (PARTITION BY feature_id, value) AS ties, count(*) OVER (PARTITION BY feature_id) AS present FROM x),
                a AS (SELECT feature_id, grp, sum(k.n - present + lo + (ties - 1) / 2D) AS ranks, count(*) AS c, max(k.n - present) AS zeros, sum(cast(ties AS DOUBLE) * ties - 1) AS tied FROM r CROSS JOIN k GROUP BY feature_id, grp),
                w AS (SELECT f.feature_id, g.n, coalesce(a.ranks, 0D) + (g.n - coalesce(a.c, 0)) * (f.zeros + 1) / 2D AS ranks, f.zeros, f.tied
                      FROM (SELECT feature_id, max(zeros) AS zeros, sum(tied) AS tied FROM a GROUP BY feature_id) f CROSS JOIN g LEFT JOIN a ON a.feature_id = f.feature_id AND a.grp = g.grp),
                h AS (SELECT feature_id, 12D / (max(k.n) * (max(k.n) + 1D)) * sum(w.ranks * w.ranks / w.n) - 3 * (max(k.n) + 1D) AS h,
                             1 - (max(w.tied) + cast(max(w.zeros) AS DOUBLE) * max(w.zeros) * max(w.zeros) - max(w.zeros)) / (pow(max(k.n), 3) - max(k.n)) AS c, max(k.groups) - 1 AS df FROM w CROSS JOIN k GROUP BY feature_id)
           SELECT feature_id, CASE WHEN c > 1e-12D THEN h / c END AS h, df FROM h""",
        t=table, m=meta,
    )


def kruskal_wallis_test(table: DataFrame, meta: DataFrame) -> DataFrame:
    rows = kruskal_wallis(table, meta)
    return benjamini_hochberg(rows.withColumn("p", special.chi2_p(F.col("h"), F.col("df"))))


def mann_whitney(values: DataFrame, by: str | None = None) -> DataFrame:
    """U of every pair of groups of ``(grp, value)``, with the tie-corrected normal score and continuity correction; within each value of ``by``, if named.

    ``n1, n2, tied`` are the groups' sizes and the sum of t^3 - t over ties. Null values take no part.
    """
    key, own = (f"{by}, ", f"{by} AS {by}, ") if by else ("", "")
    part = f"{key}g1, g2"
    return sql(
        f"""WITH v AS (SELECT {own}grp, value FROM {{v}} WHERE value IS NOT NULL), d AS (SELECT DISTINCT {key}grp FROM v),
                p AS (SELECT {f"a.{by}, " if by else ""}a.grp AS g1, b.grp AS g2 FROM d a JOIN d b ON a.grp < b.grp {f"AND a.{by} = b.{by}" if by else ""}),
                x AS (SELECT {f"p.{by}, " if by else ""}g1, g2, v.grp = g1 AS first, value FROM p JOIN v ON v.grp IN (g1, g2) {f"AND p.{by} = v.{by}" if by else ""}),
                r AS (SELECT {part}, first, rank() OVER (PARTITION BY {part} ORDER BY value) + (count(*) OVER (PARTITION BY {part}, value) - 1) / 2D AS r, count(*) OVER (PARTITION BY {part}, value) AS ties FROM x),
                a AS (SELECT {part}, count_if(first) AS n1, count_if(NOT first) AS n2, sum(r) FILTER (WHERE first) AS r1, sum(cast(ties AS DOUBLE) * ties - 1) AS tied FROM r GROUP BY ALL),
                u AS (SELECT *, r1 - n1 * (n1 + 1) / 2D AS u, sqrt(n1 * n2 / 12D * ((n1 + n2 + 1) - tied / ((n1 + n2) * (n1 + n2 - 1D)))) AS s FROM a)
            SELECT {part}, u, CASE WHEN s > 0 THEN greatest(abs(u - n1 * n2 / 2D) - 0.5D, 0D) / s END AS z, n1, n2, tied FROM u""",
        v=values,
    )


def mann_whitney_test(values: DataFrame, by: str | None = None) -> DataFrame:
    """``mann_whitney`` with its two-sided p: exact for at most 8 values of a group without ties, else normal; 1 where all values are equal."""
    rows = mann_whitney(values, by)
    return rows.withColumn("p", special.mann_whitney_p(*(F.col(c) for c in ("u", "n1", "n2", "tied", "z"))))


MEASURES = ("shannon", "simpson", "richness", "evenness")


def measures(alpha: DataFrame) -> DataFrame:
    """``feature_id, sample_id, value`` of the four measures of every sample."""
    return alpha.select("sample_id", *[F.col(m).cast("double").alias(m) for m in MEASURES]).unpivot("sample_id", list(MEASURES), "feature_id", "value")


def alpha_tests(alpha: DataFrame, meta: DataFrame, limit: float = 0.05) -> DataFrame:
    """Kruskal-Wallis of each measure over the groups, and for measures under ``limit`` every two groups' Mann-Whitney p, q within the measure, and stars."""
    rows = measures(alpha)
    overall = kruskal_wallis(rows, meta).select(F.col("feature_id").alias("measure"), "h", F.coalesce(special.chi2_p(F.col("h"), F.col("df")), F.lit(1.0)).alias("kw_p"))
    values = rows.join(meta.select("sample_id", "grp"), "sample_id").select(F.col("feature_id").alias("measure"), "grp", "value")
    pairs = benjamini_hochberg(mann_whitney_test(values, "measure").select("measure", "g1", "g2", "u", "p"), by=["measure"])
    return overall.join(pairs, "measure").where(F.col("kw_p") < limit).withColumn("stars", stars(F.col("q")))


def stars(q: Column) -> Column:
    """Three, two or one star under 0.001, 0.01 and 0.05; else ns."""
    return F.when(q < 0.001, "***").when(q < 0.01, "**").when(q < 0.05, "*").otherwise("ns")


def significance(rows: DataFrame, limit: float = 0.05, least: float = 1.0) -> DataFrame:
    """``class`` of rows with ``q, lfc``: up or down where q is under the limit and the change over ``least``, else NS, which a missing q or change is too."""
    sure = F.coalesce(F.col("q") < limit, F.lit(False))
    return rows.withColumn("class", F.when(sure & (F.col("lfc") > least), "up").when(sure & (F.col("lfc") < -least), "down").otherwise("NS"))
