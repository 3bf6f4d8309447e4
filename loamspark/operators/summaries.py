"""Tables that reports and figures are made of."""

from __future__ import annotations

from pyspark.sql import DataFrame

from loamspark.functions.frames import sql


def taxa_by_group(table: DataFrame, taxa: DataFrame, groups: DataFrame, top: int = 10) -> DataFrame:
    """``grp, taxon, mean_value``: the commonest taxa over all samples and the rest as ``Other``, as means over the samples of each group.

    Absent cells count as 0: sums are divided by the number of the group's samples that the table has.
    """
    return sql(
        """WITH v AS (SELECT t.sample_id, coalesce(x.taxon, 'Unclassified') AS taxon, sum(t.value) AS value FROM {t} t LEFT JOIN {x} x ON x.feature_id = t.feature_id GROUP BY ALL),
                r AS (SELECT taxon, true AS kept FROM (SELECT taxon, sum(value) AS total FROM v GROUP BY taxon) ORDER BY total DESC, taxon LIMIT {top}),
                n AS (SELECT g.grp, count(*) AS n FROM (SELECT DISTINCT sample_id FROM {t}) s JOIN {g} g ON g.sample_id = s.sample_id GROUP BY g.grp)
           SELECT g.grp, CASE WHEN r.kept THEN v.taxon ELSE 'Other' END AS taxon, sum(v.value) / max(n.n) AS mean_value
           FROM v JOIN {g} g ON g.sample_id = v.sample_id LEFT JOIN r ON r.taxon = v.taxon JOIN n ON n.grp = g.grp GROUP BY ALL""",
        t=table, x=taxa, g=groups, top=top,
    )


def class_by_group(table: DataFrame, groups: DataFrame) -> DataFrame:
    """``grp, class, value``: group means of functions added up by the letters that their ids begin with; ``Other`` without letters."""
    return sql(
        """WITH n AS (SELECT g.grp, count(*) AS n FROM (SELECT DISTINCT sample_id FROM {t}) s JOIN {g} g ON g.sample_id = s.sample_id GROUP BY g.grp)
           SELECT g.grp, coalesce(nullif(regexp_extract(t.function_id, '^[A-Za-z]+', 0), ''), 'Other') AS class, sum(t.value) / max(n.n) AS value
           FROM {t} t JOIN {g} g ON g.sample_id = t.sample_id JOIN n ON n.grp = g.grp GROUP BY ALL""",
        t=table, g=groups,
    )


def significant_by_taxon(tests: DataFrame, taxa: DataFrame, limit: float = 0.05) -> DataFrame:
    """``taxon, n, share`` of features with q under the limit."""
    return sql(
        """SELECT coalesce(x.taxon, 'Unclassified') AS taxon, count(*) AS n, count(*) / sum(count(*)) OVER () AS share
           FROM {t} t LEFT JOIN {x} x ON x.feature_id = t.feature_id WHERE t.q < {m} GROUP BY ALL""",
        t=tests, x=taxa, m=limit,
    )


def top_effects(tests: DataFrame, effect: str, n: int = 10, limit: float = 0.05) -> DataFrame:
    """The ``n`` significant features with the largest absolute effects, ties by feature."""
    return sql(f"SELECT *  FROM {{t}} WHERE q < {{m}} ORDER BY abs({effect}) DESC, feature_id LIMIT {int(n)}", t=tests, m=limit)


def reference_genes(strains: DataFrame, genes: DataFrame) -> DataFrame:
    """``strain, gene, phi``: 1 where a strain's annotation names the gene, else 0, for every strain and every gene of the annotation."""
    return sql(
        """WITH a AS (SELECT DISTINCT strain, gene FROM {g} WHERE gene IS NOT NULL), k AS (SELECT DISTINCT gene FROM a)
           SELECT s.strain, k.gene, CASE WHEN a.gene IS NULL THEN 0D ELSE 1D END AS phi FROM (SELECT DISTINCT strain FROM {s}) s CROSS JOIN k LEFT JOIN a ON a.strain = s.strain AND a.gene = k.gene""",
        s=strains, g=genes,
    )


def gene_attribution(truth: DataFrame, estimate: DataFrame, limit: float = 0.5) -> DataFrame:
    """Confusion counts and ratios of ``(strain, gene, phi)`` over the pairs in both; 0 where undefined."""
    return sql(
        """SELECT *, coalesce(tp / nullif(tp + fp, 0), 0D) AS precision_, coalesce(tp / nullif(tp + fn, 0), 0D) AS recall, coalesce(2D * tp / nullif(2 * tp + fp + fn, 0), 0D) AS f1,
                  coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0D) AS accuracy
           FROM (SELECT count_if(t AND e) AS tp, count_if(NOT t AND e) AS fp, count_if(t AND NOT e) AS fn, count_if(NOT t AND NOT e) AS tn
                 FROM (SELECT t.phi >= {m} AS t, e.phi >= {m} AS e FROM {t} t JOIN {e} e ON e.strain = t.strain AND e.gene = t.gene))""",
        t=truth, e=estimate, m=limit,
    )


def compare_modes(rows: DataFrame, one: str, other: str) -> DataFrame:
    """Per experiment: mean absolute errors and biases of two modes of ``(experiment, mode, true_w, est_w)``, and which is better."""
    return sql(
        """WITH m AS (SELECT experiment, avg(abs(est_w - true_w)) FILTER (WHERE mode = {a}) AS mae_one, avg(abs(est_w - true_w)) FILTER (WHERE mode = {b}) AS mae_other,
                             avg(est_w - true_w) FILTER (WHERE mode = {a}) AS bias_one, avg(est_w - true_w) FILTER (WHERE mode = {b}) AS bias_other FROM {r} GROUP BY experiment)
           SELECT *, mae_other - mae_one AS mae_change, CASE WHEN mae_one < mae_other THEN {a} WHEN mae_other < mae_one THEN {b} ELSE 'tie' END AS better FROM m""",
        r=rows, a=one, b=other,
    )


def breakdown_text(counts: DataFrame) -> DataFrame:
    """``text``: one sentence of ``significant_by_taxon``, largest first, ties by name; no row without features."""
    return sql(
        """SELECT concat('Among ', sum(n), ' significant features: ', array_join(transform(array_sort(collect_list(struct(-n AS n, taxon))), x -> concat(-x.n, ' ', x.taxon)), ', '), '.') AS text
           FROM {c} HAVING count(*) > 0""",
        c=counts,
    )
