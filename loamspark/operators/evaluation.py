"""Estimates against truths."""

from __future__ import annotations

from pyspark.sql import DataFrame

from loamspark.functions.frames import sql


def regression(rows: DataFrame) -> DataFrame:
    """Errors, R squared and limits of agreement of ``(true_w, est_w)``, rows where both are nothing left out."""
    return sql(
        """WITH x AS (SELECT true_w AS t, est_w AS e FROM {r} WHERE true_w > 0 OR est_w > 0.001D), m AS (SELECT avg(t) AS m FROM x)
           SELECT count(*) AS n, avg(abs(e - t)) AS mae, 1 - sum(pow(e - t, 2)) / nullif(sum(pow(t - m.m, 2)), 0) AS r2, avg(e - t) AS bias, stddev_samp(e - t) AS sd,
                  avg(e - t) - 1.96D * stddev_samp(e - t) AS loa_lo, avg(e - t) + 1.96D * stddev_samp(e - t) AS loa_hi FROM x CROSS JOIN m""",
        r=rows,
    )


def detection(rows: DataFrame, limit: float = 0.0) -> DataFrame:
    """Confusion counts of ``(truth, estimate)`` by estimate > limit, and their ratios; 0 where undefined."""
    return sql(
        """SELECT *, coalesce(2D * tp / nullif(2 * tp + fp + fn, 0), 0D) AS f1, coalesce(tp / nullif(tp + fn, 0), 0D) AS sensitivity, coalesce(tn / nullif(tn + fp, 0), 0D) AS specificity,
                  coalesce(tp / nullif(tp + fp, 0), 0D) AS precision_, coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0D) AS accuracy
           FROM (SELECT count_if(t AND e) AS tp, count_if(NOT t AND e) AS fp, count_if(t AND NOT e) AS fn, count_if(NOT t AND NOT e) AS tn FROM (SELECT truth > 0 AS t, estimate > {m} AS e FROM {r}))""",
        r=rows, m=limit,
    )


def grouped_errors(rows: DataFrame, by: str) -> DataFrame:
    return sql(f"SELECT {by}, count(*) AS n, avg(abs(est_w - true_w)) AS mae, stddev_samp(est_w - true_w) AS sd FROM {{r}} GROUP BY {by}", r=rows)


def timings(rows: DataFrame, by: str, seconds: str = "seconds") -> DataFrame:
    """``n, mean, sd`` of the times of every ``by``; one time has no spread."""
    return sql(f"SELECT {by}, count({seconds}) AS n, avg({seconds}) AS mean, coalesce(stddev_samp({seconds}), 0D) AS sd FROM {{r}} GROUP BY {by}", r=rows)


def totals(rows: DataFrame, dataset: str, value: str) -> DataFrame:
    """Sums by dataset with the grand total beside them, in one aggregation."""
    return sql(f"SELECT coalesce(cast({dataset} AS STRING), 'total') AS dataset, count(*) AS n, sum({value}) AS value FROM {{r}} GROUP BY ROLLUP ({dataset})", r=rows)


def abundance_metrics(truth: DataFrame, estimate: DataFrame) -> DataFrame:
    """L1, Bray-Curtis, root mean square and largest error and correlation of two tables ``(id, w)``, each scaled to 1, absent ids as 0."""
    return sql(
        """WITH j AS (SELECT coalesce(t.id, e.id) AS id, coalesce(t.w, 0D) AS t, coalesce(e.w, 0D) AS e FROM {t} t FULL OUTER JOIN {e} e ON e.id = t.id),
                x AS (SELECT coalesce(t / nullif(sum(t) OVER (), 0), 0D) AS t, coalesce(e / nullif(sum(e) OVER (), 0), 0D) AS e FROM j)
           SELECT sum(abs(t - e)) AS l1, coalesce(sum(abs(t - e)) / nullif(sum(t + e), 0), 0D) AS bray_curtis, sqrt(avg(pow(t - e, 2))) AS rmse, max(abs(t - e)) AS max_error,
                  CASE WHEN stddev_pop(t) > 0 AND stddev_pop(e) > 0 THEN corr(t, e) ELSE 0D END AS pearson FROM x""",
        t=truth, e=estimate,
    )


def set_detection(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Hits, false ones and misses of two sets ``(sample_id, id)``, by sample."""
    return sql(
        """SELECT coalesce(a.sample_id, b.sample_id) AS sample_id, count_if(a.id IS NOT NULL AND b.id IS NOT NULL) AS tp, count_if(a.id IS NULL) AS fp, count_if(b.id IS NULL) AS fn
           FROM {a} a FULL OUTER JOIN {b} b ON b.sample_id = a.sample_id AND b.id = a.id GROUP BY ALL""",
        a=expected.distinct(), b=found.distinct(),
    )


def power_law(rows: DataFrame) -> DataFrame:
    """Slope and intercept of ln y on ln x."""
    return sql("SELECT regr_slope(ln(y), ln(x)) AS slope, regr_intercept(ln(y), ln(x)) AS intercept FROM {r} WHERE x > 0 AND y > 0", r=rows)


def ellipse(points: DataFrame, by: str, scale: float = 5.991) -> DataFrame:
    """Half axes and angle of the 95 % ellipse of ``(x, y)`` in each group, from the 2 x 2 covariance in closed form."""
    return sql(
        f"""WITH c AS (SELECT {by}, var_samp(x) AS a, covar_samp(x, y) AS b, var_samp(y) AS d FROM {{p}} GROUP BY {by} HAVING count(*) > 2),
                 e AS (SELECT {by}, a, b, d, (a + d) / 2 AS m, sqrt(pow((a - d) / 2, 2) + b * b) AS h FROM c)
            SELECT {by}, sqrt({{s}} * (m + h)) AS major, sqrt({{s}} * greatest(m - h, 0D)) AS minor, atan2(m + h - a, b) AS angle FROM e""",
        p=points, s=scale,
    )


def with_missing(estimates: DataFrame, truth: DataFrame) -> DataFrame:
    """``sample_id, species, true_w, est_w, abs_error``: every estimate against its truth or 0, and species that are there but were not estimated."""
    return sql(
        """SELECT e.sample_id, e.species, coalesce(t.true_w, 0D) AS true_w, e.est_w, abs(e.est_w - coalesce(t.true_w, 0D)) AS abs_error FROM {e} e LEFT JOIN {t} t ON t.sample_id = e.sample_id AND t.species = e.species
           UNION ALL SELECT t.sample_id, t.species, t.true_w, 0D, t.true_w FROM {t} t LEFT ANTI JOIN {e} e ON e.sample_id = t.sample_id AND e.species = t.species WHERE t.true_w > 0""",
        e=estimates, t=truth,
    )


def sample_detections(rows: DataFrame, top: int = 3) -> DataFrame:
    """``category, sample_id, rate, top_species`` of ``(category, sample_id, species, weight_pct, total_reads, classified_reads)``: the percentage of
    reads classified, 0 without reads, and the commonest species with their weights, ties by name."""
    return sql(
        """SELECT category, sample_id, coalesce(100D * max(classified_reads) / nullif(max(total_reads), 0), 0D) AS rate,
                  array_join(transform(slice(array_sort(collect_list(struct(-weight_pct AS w, species))), 1, {top}), x -> concat(x.species, ' (', format_string('%.1f', -x.w), '%)')), ', ') AS top_species
           FROM {r} GROUP BY category, sample_id""",
        r=rows, top=top,
    )


def category_summary(detections: DataFrame) -> DataFrame:
    """Samples and the smallest, largest and mean rate of every category of ``sample_detections``."""
    return sql("SELECT category, count(*) AS n, min(rate) AS class_min, max(rate) AS class_max, avg(rate) AS class_mean FROM {d} GROUP BY category", d=detections)


def mobile_metrics(assignments: DataFrame, mobile: DataFrame) -> DataFrame:
    """Confusion counts, precision, recall and F1 of reads ``(read_id, is_mobile)`` against the set ``(read_id)`` of truly mobile ones; 0 where undefined."""
    return sql(
        """SELECT *, coalesce(tp / nullif(tp + fp, 0), 0D) AS precision_, coalesce(tp / nullif(tp + fn, 0), 0D) AS recall, coalesce(2D * tp / nullif(2 * tp + fp + fn, 0), 0D) AS f1
           FROM (SELECT count_if(a.read_id IS NOT NULL AND m.read_id IS NOT NULL) AS tp, count_if(m.read_id IS NULL) AS fp, count_if(a.read_id IS NULL) AS fn
                 FROM (SELECT DISTINCT read_id FROM {a} WHERE is_mobile) a FULL OUTER JOIN (SELECT DISTINCT read_id FROM {m}) m ON m.read_id = a.read_id)""",
        a=assignments, m=mobile,
    )


def mode_metrics(rows: DataFrame, limit: float = 0.001) -> DataFrame:
    """``experiment, mode, n, mae, r2, bias, loa_width, sensitivity, specificity, f1`` of ``(experiment, mode, true_w, est_w)``, and over all experiments as ``all``.

    Errors leave out rows where both are nothing; detections count every row. With equal truths R squared is 1 for no errors, else 0; undefined ratios are null.
    """
    return sql(
        """WITH x AS (SELECT cast(experiment AS STRING) AS experiment, mode, true_w AS t, est_w AS e, true_w > 0 OR est_w > {m} AS counted FROM {r}),
                a AS (SELECT coalesce(experiment, 'all') AS experiment, mode, count_if(counted) AS n, avg(abs(e - t)) FILTER (WHERE counted) AS mae, avg(e - t) FILTER (WHERE counted) AS bias,
                             1.96D * 2 * stddev_samp(e - t) FILTER (WHERE counted) AS loa_width, sum(pow(e - t, 2)) FILTER (WHERE counted) AS residual, var_pop(t) FILTER (WHERE counted) AS spread,
                             count_if(t > 0 AND e > {m}) AS tp, count_if(t <= 0 AND e > {m}) AS fp, count_if(t > 0 AND e <= {m}) AS fn, count_if(t <= 0 AND e <= {m}) AS tn
                      FROM x GROUP BY GROUPING SETS ((experiment, mode), (mode)))
           SELECT experiment, mode, n, mae, CASE WHEN n < 2 THEN NULL WHEN spread * n < 1e-15D THEN CASE WHEN residual < 1e-15D THEN 1D ELSE 0D END ELSE 1 - residual / (spread * n) END AS r2, bias, loa_width,
                  tp / nullif(tp + fn, 0) AS sensitivity, tn / nullif(tn + fp, 0) AS specificity, CASE WHEN tp > 0 THEN 2D * tp / (2 * tp + fp + fn) END AS f1 FROM a""",
        r=rows, m=limit,
    )


def compare_metrics(metrics: DataFrame, one: str, other: str) -> DataFrame:
    """Differences, other less one, of ``mode_metrics``, and the better mode by error, R squared and F1; null metrics tie."""
    def best(column: str, order: str) -> str:
        return f"CASE WHEN b.{column} {order} a.{column} THEN {{b}} WHEN a.{column} {order} b.{column} THEN {{a}} ELSE 'tie' END AS best_{column}"

    change = ", ".join(f"b.{c} - a.{c} AS {c}_change" for c in ("mae", "r2", "bias", "loa_width", "f1"))
    return sql(f"SELECT a.experiment, {change}, {best('mae', '<')}, {best('r2', '>')}, {best('f1', '>')} FROM {{m}} a JOIN {{m}} b ON b.experiment = a.experiment WHERE a.mode = {{a}} AND b.mode = {{b}}", m=metrics, a=one, b=other)
