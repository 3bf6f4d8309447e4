"""Filters, group aggregates and diversity over long tables ``(feature_id, sample_id, value)``.

Absent cells are zeros. Nothing here builds them: counts of samples and groups stand in for the cells that are not there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamspark.functions.frames import counts_below, sql
from loamspark.session import saved


def normalize(table: DataFrame) -> DataFrame:
    """``p``: the value's share of its sample; 0 where the sample sums to 0."""
    return sql("SELECT feature_id, sample_id, coalesce(value / nullif(sum(value) OVER (PARTITION BY sample_id), 0), 0D) AS p FROM {t}", t=table)


def filter_low_abundance(table: DataFrame, min_total: float) -> DataFrame:
    """Features whose total exceeds ``min_total``."""
    return sql("SELECT t.* FROM {t} t LEFT SEMI JOIN (SELECT feature_id FROM {t} GROUP BY feature_id HAVING sum(value) > {m}) k ON k.feature_id = t.feature_id", t=table, m=min_total)


def filter_prevalence(table: DataFrame, least: float) -> DataFrame:
    """Features present in at least this part of all samples of the table."""
    return sql(
        """SELECT t.* FROM {t} t LEFT SEMI JOIN (
             SELECT feature_id FROM {t} GROUP BY feature_id
             HAVING count_if(value > 0) >= {p} * (SELECT count(DISTINCT sample_id) FROM {t})) k ON k.feature_id = t.feature_id""",
        t=table, p=least,
    )


def subset_samples(table: DataFrame, samples: list) -> DataFrame:
    """The rows of the given samples; KeyError names one that the table lacks."""
    wanted = table.sparkSession.createDataFrame([(s,) for s in samples], f"sample_id {table.schema['sample_id'].dataType.simpleString()}")
    missing = wanted.join(table.select("sample_id").distinct(), "sample_id", "left_anti").first()
    if missing is not None:
        raise KeyError(missing["sample_id"])
    return table.join(F.broadcast(wanted), "sample_id", "left_semi")


def sample_groups(meta: DataFrame, variable: str) -> DataFrame:
    """``grp, n, samples``: the samples of each value of a covariate, '' where it is missing."""
    return meta.groupBy(F.coalesce(F.col(variable), F.lit("")).alias("grp")).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list(F.col("sample_id").cast("string"))), ";").alias("samples"))


def alpha_diversity(table: DataFrame) -> DataFrame:
    """Shannon, Simpson, richness and evenness of every sample, in one aggregation.

    With T the sample's total, Shannon is ln T - sum(v ln v) / T, so no share is ever materialised.
    """
    return sql(
        """SELECT sample_id,
             CASE WHEN t > 0 THEN ln(t) - s / t ELSE 0D END AS shannon,
             CASE WHEN t > 0 THEN 1 - q / (t * t) ELSE 0D END AS simpson,
             r AS richness,
             CASE WHEN r > 1 AND t > 0 THEN (ln(t) - s / t) / ln(r) ELSE 0D END AS evenness
           FROM (SELECT sample_id, sum(value) AS t, coalesce(sum(value * ln(value)) FILTER (WHERE value > 0), 0D) AS s,
                        sum(value * value) AS q, count_if(value > 0) AS r FROM {t} GROUP BY sample_id)""",
        t=table,
    )


def aggregate_rank(table: DataFrame, taxonomy: DataFrame, rank: str) -> DataFrame:
    """Sums over the features of each taxon at a rank; blank or missing taxa are 'Unclassified'."""
    tax = taxonomy.select("feature_id", F.coalesce(F.expr(f"nullif(`{rank}`, '')"), F.lit("")).alias("taxon"))
    return sql(
        """SELECT coalesce(nullif(x.taxon, ''), 'Unclassified') AS feature_id, t.sample_id, sum(t.value) AS value
           FROM {t} t LEFT JOIN {x} x ON x.feature_id = t.feature_id GROUP BY ALL""",
        t=table, x=tax,
    )


#: Rows of a task that sums repeated cells, about; samples that are broadcast at most.
ROWS = 500_000
BROADCAST = 500_000


def summed(table: DataFrame) -> DataFrame:
    """Cells of a table that repeats them, summed. Rows are counted first and dealt by cell to as many tasks as hold ``ROWS`` each, so a task's memory does not grow with the table."""
    parts = max(table.sparkSession.sparkContext.defaultParallelism, -(-table.count() // ROWS))
    return sql("SELECT feature_id, sample_id, sum(value) AS value FROM {t} GROUP BY ALL", t=table.repartition(parts, "feature_id", "sample_id"))


def group_stats(table: DataFrame, meta: DataFrame, repeated: bool = False) -> DataFrame:
    """``feature_id, grp, mean_value, prevalence``: over all samples of the group that the table has; every feature with every group.

    Cells that the table may hold several times, if ``repeated``, are summed first. Sums by feature and group are saved, since they are read twice; samples are counted before they are broadcast.
    """
    s = sql("SELECT m.sample_id, m.grp FROM {m} m LEFT SEMI JOIN (SELECT DISTINCT sample_id FROM {t}) t ON t.sample_id = m.sample_id", t=table, m=meta)
    hint = (lambda x: f"/*+ BROADCAST({x}) */") if meta.count() <= BROADCAST else (lambda x: "")
    sums = saved(
        sql(f"SELECT {hint('s')} t.feature_id, s.grp, sum(t.value) AS v, count_if(t.value > 0) AS c FROM {{t}} t LEFT JOIN {{s}} s ON s.sample_id = t.sample_id GROUP BY ALL", t=summed(table) if repeated else table, s=s),
        "sums",
    )
    return sql(
        f"""WITH n AS (SELECT grp, count(*) AS n FROM {{s}} GROUP BY grp)
           SELECT {hint('n')} f.feature_id, n.grp, coalesce(a.v, 0D) / n.n AS mean_value, coalesce(a.c, 0) / n.n AS prevalence
           FROM (SELECT DISTINCT feature_id FROM {{a}}) f CROSS JOIN n LEFT JOIN {{a}} a ON a.feature_id = f.feature_id AND a.grp = n.grp""",
        s=s, a=sums,
    )


def core_features(stats: DataFrame, thresholds: tuple[float, ...] = (0.5, 0.75, 0.9, 1.0)) -> DataFrame:
    """``threshold, grp, feature_id`` where the prevalence in the group reaches the threshold."""
    t = stats.sparkSession.createDataFrame([(x,) for x in thresholds], "threshold double")
    return stats.join(F.broadcast(t), F.col("prevalence") >= F.col("threshold")).select("threshold", "grp", "feature_id")


def shared_core(core: DataFrame, n_groups: int) -> DataFrame:
    """Features that are core in every group."""
    return core.groupBy("threshold", "feature_id").agg(F.count_distinct("grp").alias("g")).where(F.col("g") == n_groups).drop("g")


def phylum_composition(table: DataFrame, taxonomy: DataFrame, meta: DataFrame, rank: str = "phylum") -> DataFrame:
    """Mean and population deviation of each taxon's share over all samples of a group, absent ones as 0."""
    shares = normalize(aggregate_rank(table, taxonomy, rank))
    return sql(
        """WITH s AS (SELECT m.sample_id, m.grp FROM {m} m LEFT SEMI JOIN {p} p ON p.sample_id = m.sample_id),
                n AS (SELECT grp, count(*) AS n FROM s GROUP BY grp)
           SELECT feature_id AS taxon, grp, sum(p) / max(n) AS mean_share, sqrt(greatest(sum(p * p) / max(n) - pow(sum(p) / max(n), 2), 0D)) AS sd_share
           FROM {p} JOIN s USING (sample_id) JOIN n USING (grp) GROUP BY ALL""",
        p=shares, m=meta,
    )


def benjamini_hochberg(table: DataFrame, p: str = "p", by: list[str] | None = None) -> DataFrame:
    """``q``: least of p n / rank over this and all larger p; n counts every row, null p stay null and rank last.

    q is a function of p alone, so it is found once for each distinct p and joined to the rows, which are saved first: both sides must have the very same p.
    """
    table = saved(table, "tests")
    keys = "".join(f"{k}, " for k in by or [])
    same = lambda x, y: "".join(f" AND {x}.{k} <=> {y}.{k}" for k in by or [])
    part = f"PARTITION BY {keys[:-2]} " if by else ""
    return sql(
        f"""WITH e AS (SELECT *, {p} * total / (below + n) AS e FROM {{c}} WHERE {p} IS NOT NULL),
                 m AS (SELECT {keys}bucket, min(min(e)) OVER ({part}ORDER BY bucket ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM e GROUP BY {keys}bucket),
                 w AS (SELECT {keys}{p}, bucket, min(e) OVER (PARTITION BY {keys}bucket ORDER BY {p} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS e FROM e),
                 q AS (SELECT w.*, least(1D, w.e, m.later) AS q FROM w JOIN m ON m.bucket = w.bucket{same("m", "w")})
            SELECT t.*, q.q FROM {{t}} t LEFT JOIN q ON q.{p} = t.{p}{same("q", "t")}""",
        t=table, c=counts_below(table, p, by),
    )


def argmax(table: DataFrame, key: str, score: str, name: str) -> DataFrame:
    """The row of the highest score for each key; ties go to the first name."""
    return sql(f"SELECT * EXCEPT (rn) FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {score} DESC, {name}) AS rn FROM {{t}}) WHERE rn = 1", t=table)


def top_n(table: DataFrame, n: int, by: str, order: str) -> DataFrame:
    return sql(f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS rn FROM {{t}}) WHERE rn <= {{n}}", t=table, n=n)


def specificity(stats: DataFrame) -> DataFrame:
    """1 - H(P) / ln C over the shares P of the group means; an all-zero feature scores 1 in the first group."""
    return sql(
        """WITH p AS (SELECT feature_id, grp, mean_value, mean_value / nullif(sum(mean_value) OVER (PARTITION BY feature_id), 0) AS p, count(*) OVER (PARTITION BY feature_id) AS c FROM {s}),
                h AS (SELECT feature_id, coalesce(-sum(p * ln(p)) FILTER (WHERE p > 0), 0D) AS h, max(c) AS c FROM p GROUP BY feature_id),
                b AS (SELECT feature_id, grp, row_number() OVER (PARTITION BY feature_id ORDER BY coalesce(p, 0D) DESC, grp) AS rn FROM p)
           SELECT h.feature_id, 1 - h.h / CASE WHEN h.c > 1 THEN ln(h.c) ELSE 1D END AS score, b.grp AS best_group FROM h JOIN b ON b.feature_id = h.feature_id AND b.rn = 1""",
        s=stats,
    )


def specialists(scores: DataFrame, n: int = 15, limit: float = 0.5) -> DataFrame:
    """The ``n`` features of the highest specificity, ties by name, with the numbers of all specialists, above ``limit``, and generalists beside them."""
    counts = scores.agg(F.count_if(F.col("score") > limit).alias("specialists"), F.count_if(F.col("score") <= limit).alias("generalists"))
    return scores.orderBy(F.desc("score"), "feature_id").limit(n).crossJoin(F.broadcast(counts))


def indicator(stats: DataFrame) -> DataFrame:
    """IndVal: the group's share of the means times its prevalence, for the best group of each feature."""
    return sql(
        """SELECT feature_id, grp AS best_group, spec AS specificity, prevalence AS fidelity, spec * prevalence AS indval FROM (
             SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY spec * prevalence DESC, grp) AS rn FROM (
               SELECT *, coalesce(mean_value / nullif(sum(mean_value) OVER (PARTITION BY feature_id), 0), 0D) AS spec FROM {s})) WHERE rn = 1""",
        s=stats,
    )


def permutations(meta: DataFrame, n: int) -> DataFrame:
    """``perm, sample_id, grp``: labels dealt anew n times, by the order of md5(perm:sample); perm 0 keeps them.

    A permutation is a function of its number and the sample, so it is the same wherever and whenever it is computed.
    """
    return sql(
        """WITH own AS (SELECT sample_id, grp, row_number() OVER (ORDER BY sample_id) AS rn FROM {m}),
                dealt AS (SELECT perm, sample_id, row_number() OVER (PARTITION BY perm ORDER BY md5(concat(cast(perm AS STRING), ':', cast(sample_id AS STRING)))) AS rn
                          FROM {m} LATERAL VIEW explode(sequence(1, {n})) AS perm)
           SELECT d.perm, d.sample_id, o.grp FROM dealt d JOIN own o ON o.rn = d.rn UNION ALL SELECT 0, sample_id, grp FROM {m}""",
        m=meta, n=n,
    )


def indicator_test(table: DataFrame, meta: DataFrame, n: int = 99) -> DataFrame:
    """IndVal with its permutation p: (permutations at least as high + 1) / (n + 1)."""
    perms = permutations(meta.join(table.select("sample_id").distinct(), "sample_id", "left_semi"), n)
    best = sql(
        """WITH g AS (SELECT perm, grp, count(*) AS n FROM {p} GROUP BY ALL),
                a AS (SELECT perm, feature_id, grp, sum(value) AS v, count_if(value > 0) AS c FROM {t} JOIN {p} USING (sample_id) GROUP BY ALL),
                m AS (SELECT a.perm, a.feature_id, a.v / g.n AS mean_value, a.c / g.n AS prevalence FROM a JOIN g USING (perm, grp)),
                s AS (SELECT perm, feature_id, mean_value / nullif(sum(mean_value) OVER (PARTITION BY perm, feature_id), 0) * prevalence AS iv FROM m)
           SELECT perm, feature_id, max(iv) AS iv FROM s GROUP BY ALL""",
        t=table, p=perms,
    )
    return sql(
        """SELECT b.feature_id, o.iv AS indval, (count_if(b.perm > 0 AND b.iv >= o.iv - 1e-9D) + 1) / {b} AS p
           FROM {s} b JOIN (SELECT feature_id, iv FROM {s} WHERE perm = 0) o ON o.feature_id = b.feature_id GROUP BY ALL""",
        s=best, b=float(n + 1),
    )


def taxonomy_breakdown(tax: DataFrame, rank: str) -> DataFrame:
    """``rank, n``: the features of every taxon."""
    return tax.groupBy(rank).agg(F.count("*").alias("n"))


def top_features(table: DataFrame, n: int) -> DataFrame:
    """The ``n`` features with the largest totals, ties to the smaller id; a top-k that no task sorts whole."""
    return table.groupBy("feature_id").agg(F.sum("value").alias("total")).orderBy(F.desc("total"), "feature_id").limit(n)


def membership(stats: DataFrame) -> DataFrame:
    """``members, n``: features by the set of groups that hold any of them, groups in order and joined by ';'. Given ``(feature_id, grp, mean_value)``."""
    held = stats.where("mean_value > 0").groupBy("feature_id").agg(F.array_join(F.sort_array(F.collect_set(F.col("grp").cast("string"))), ";").alias("members"))
    return held.groupBy("members").agg(F.count("*").alias("n"))


def alpha_by_group(alpha: DataFrame, meta: DataFrame) -> DataFrame:
    """Samples, means of the four measures and the median Shannon index of every group."""
    means = [F.avg(c).alias(f"mean_{c}") for c in ("shannon", "simpson", "richness", "evenness")]
    return alpha.join(meta.select("sample_id", "grp"), "sample_id").groupBy("grp").agg(F.count("*").alias("n"), *means, F.median("shannon").alias("median_shannon"))
