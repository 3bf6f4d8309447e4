"""Reports as delimited text, plain text, JSON or HTML, numbers with a fixed number of places. All are small: a report is one file.

Rows keep the order that they are given in: what a report sorts is sorted here, ties by name.
"""

from __future__ import annotations

import html as markup
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(df: DataFrame, path: str, places: int = 4, sep: str = ",") -> None:
    """A small report as one file with a header; doubles have ``places`` places."""
    df.select([F.format_string(f"%.{places}f", c).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes]).coalesce(1).write.csv(path, sep=sep, header=True, mode="overwrite")


def matrix(df: DataFrame, path: str, row: str, column: str, value: str, places: int | None = 6) -> None:
    """Long rows as a wide table, one column for each name; without ``places``, numbers have six significant digits."""
    wide = df.groupBy(row).pivot(column).agg(F.first(value)).orderBy(row)
    if places is None:
        wide = wide.select(row, *[general(F.col(f"`{c}`")).alias(c) for c in wide.columns if c != row])
    table(wide, path, places or 0)


def general(x: Column) -> Column:
    """A number in six significant digits without trailing zeros; with an exponent from a million on and under a ten thousandth."""
    science = F.format_string("%.5e", x.cast("double"))
    size = F.abs(science.cast("double"))
    plain = F.regexp_replace(F.format_string("%.10f", science.cast("double")), r"\.?0+$", "")
    return F.when(x.isNull(), F.lit(None).cast("string")).when((size != 0) & ((size < 1e-4) | (size >= 1e6)), F.regexp_replace(science, r"\.?0*e", "e")).otherwise(F.when(size == 0, "0").otherwise(plain))


def square(distances: DataFrame, path: str, places: int = 6) -> None:
    """Pairs as a symmetric matrix with zeros on its diagonal."""
    both = distances.select("s1", "s2", "d").unionAll(distances.select("s2", "s1", "d"))
    ids = both.select("s1").distinct()
    matrix(both.unionAll(ids.select("s1", F.col("s1").alias("s2"), F.lit(0.0).alias("d"))), path, "s1", "s2", "d", places)


def core(shared: DataFrame, by_group: DataFrame, path: str) -> None:
    """Core features joined by ';' for each threshold and group, and for all groups."""
    joined = F.array_join(F.sort_array(F.collect_list(F.col("feature_id").cast("string"))), ";").alias("features")
    rows = by_group.groupBy("threshold", "grp").agg(F.count("*").alias("n"), joined)
    rows = rows.unionByName(shared.withColumn("grp", F.lit("_ALL_GROUPS_")).groupBy("threshold", "grp").agg(F.count("*").alias("n"), joined))
    table(rows.orderBy("threshold", "grp"), path)


def verdict_json(weights: DataFrame, verdict: DataFrame, path: str) -> None:
    """One object with the verdict and the species that are visible: a weight or reads of 0.01 percent."""
    shown = weights.where((F.col("weight_pct") >= 0.01) | (F.col("read_pct") >= 0.01))
    body = shown.agg(F.sort_array(F.collect_list(F.struct(*shown.columns))).alias("species")).crossJoin(verdict)
    body.select(F.to_json(F.struct("verdict", "species")).alias("value")).coalesce(1).write.text(path)


def _visible(species: DataFrame) -> DataFrame:
    return species.where((F.col("weight_pct") >= 0.01) | (F.col("read_pct") >= 0.01))


def verdict_tsv(species: DataFrame, path: str) -> None:
    """``species, status, weight_pct, ci_lo, ci_hi, read_pct`` of the visible species."""
    table(_visible(species).select("species", "status", *[F.col(c).cast("double").alias(c) for c in ("weight_pct", "ci_lo", "ci_hi", "read_pct")]).orderBy("species"), path, 4, "\t")


def text(spark: SparkSession, lines: Iterable[str], path: str) -> None:
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(path)


def verdict_text(species: DataFrame, sample: str, verdict: str, total: int, classified: int, agreement: float, path: str) -> None:
    """A page of the verdict, its reads and the visible species."""
    share = 100 * classified / total if total else 0.0
    rows = [f"  {r['species']:<20} {r['status']:<10} {r['weight_pct']:7.2f}% {r['read_pct']:7.2f}%" for r in _visible(species).orderBy("species").collect()]
    head = [f"Report: {sample}", f"  Verdict: {verdict}", f"  Reads: {total} total, {classified} classified ({share:.1f}%)", f"  Agreement of markers: {agreement:.1%}", f"  {'Species':<20} {'Status':<10} {'w/w%':>8} {'reads%':>8}"]
    text(species.sparkSession, head + rows, path)


def statistic(spark: SparkSession, name: str, value: float, p: float, path: str, **facts: object) -> None:
    """A test's name, statistic, p and further facts, a line each."""
    text(spark, [f"Test: {name}", f"Statistic: {value:.4f}", f"P-value: {p:.4f}", *(f"{k}: {v}" for k, v in facts.items())], path)


def community_summary(path: str, before: int, after: int, least: float, alpha: DataFrame, tests: DataFrame, differences: DataFrame, indicators: DataFrame, shared: DataFrame, specificity: DataFrame) -> None:
    """Counts of every part of a community profile: prevalence filter, diversity, ``tests(name, statistic, p)``, ``differences(g1, g2, q)``,
    ``indicators(best_group, p)``, ``shared(threshold, feature_id)`` and ``specificity(score)``."""
    measures = [x for m in ("shannon", "simpson", "richness") for x in (F.avg(m).alias(m), F.stddev_pop(m).alias(f"{m}_sd"))]
    a = alpha.agg(F.count("*").alias("n"), *measures).first()
    show = lambda m: f"{m}: {a[m]:.3f} +/- {a[f'{m}_sd']:.3f}" if a["n"] else f"{m}: none"
    lines = ["PREVALENCE FILTER", f"least: {100 * least:.0f}%", f"before: {before}", f"after: {after}", f"removed: {before - after}", "", "DIVERSITY", f"samples: {a['n']}", *map(show, ("shannon", "simpson", "richness"))]
    lines += ["", "TESTS", *(f"{r[0]}: {r[1]:.3f}, p={r[2]:.4f}" for r in tests.select("name", "statistic", "p").orderBy("name").collect())]
    lines += ["", "DIFFERENTIAL FEATURES", *(f"{r[0]} vs {r[1]}: {r[2]}" for r in differences.groupBy("g1", "g2").agg(F.count_if(F.col("q") < 0.05)).orderBy("g1", "g2").collect())]
    lines += ["", "INDICATORS", *(f"{r[0]}: {r[1]}" for r in indicators.groupBy("best_group").agg(F.count_if(F.col("p") < 0.05)).orderBy("best_group").collect())]
    lines += ["", "CORE OF ALL GROUPS", *(f"{100 * r[0]:.0f}%: {r[1]}" for r in shared.groupBy("threshold").count().orderBy("threshold").collect())]
    kinds = specificity.agg(F.count_if(F.col("score") > 0.5), F.count_if(F.col("score") <= 0.5)).first()
    text(alpha.sparkSession, [*lines, "", "SPECIFICITY", f"specialists: {kinds[0]}", f"generalists: {kinds[1]}"], path)


def with_ranks(rows: DataFrame, taxonomy: DataFrame, *ranks: str, key: str = "feature_id", suffix: str = "") -> DataFrame:
    """Rows with ranks of their feature beside them, '' where it has none."""
    names = taxonomy.select(F.col("feature_id").alias(key), *[F.col(r).alias(f"{r}{suffix}") for r in ranks])
    return rows.join(names, key, "left").fillna("", [f"{r}{suffix}" for r in ranks])


def network_tables(folder: str, edges: DataFrame, topology: DataFrame, keystones: DataFrame, taxonomy: DataFrame | None = None) -> None:
    """Edges by phi, nodes by name, keystones by score and modules by number and name, a file each; with the ends' phyla where there is a taxonomy."""
    if taxonomy is not None:
        edges = with_ranks(with_ranks(edges, taxonomy, "phylum", key="src", suffix="_1"), taxonomy, "phylum", key="dst", suffix="_2").select("src", "dst", "phi", "phylum_1", "phylum_2")
        topology = with_ranks(topology, taxonomy, "phylum")
    table(edges.orderBy("phi", "src", "dst"), f"{folder}/edges", 6)
    table(topology.orderBy("feature_id"), f"{folder}/topology", 6)
    table(keystones.orderBy(F.desc("score"), "feature_id"), f"{folder}/keystones", 6)
    table(topology.select("module", "feature_id").orderBy("module", "feature_id"), f"{folder}/modules", 6)


def profile_json(strains: DataFrame, genes: DataFrame, pairs: DataFrame, facts: dict[str, object], path: str) -> None:
    """One object: ``strains(strain, pi, lo, hi)`` and ``genes(strain, gene, phi)`` as lists by name, ``pairs(a, b, score)`` by names joined with __, and other facts."""
    own = strains.agg(F.sort_array(F.collect_list(F.struct("strain", "pi", "lo", "hi"))).alias("strains"))
    phi = genes.agg(F.sort_array(F.collect_list(F.struct("strain", "gene", "phi"))).alias("genes"))
    scores = pairs.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.concat_ws("__", "a", "b"), "score")))).alias("identifiability"))
    body = own.crossJoin(phi).crossJoin(scores).select("*", *[F.lit(v).alias(k) for k, v in facts.items()])
    body.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def calibration(values: DataFrame, path: str) -> None:
    """The four numbers of a calibration as JSON; ``tabular.calibration`` reads them."""
    values.select("d_mu", "d_sigma", "b_mu", "b_sigma").coalesce(1).write.mode("overwrite").json(path)


def html(spark: SparkSession, title: str, sections: Iterable[tuple[str, str, DataFrame]], path: str, top: int = 15) -> None:
    """A page with the first ``top`` rows of every (heading, note, table), each under its note."""
    show = lambda v: f"{v:.4g}" if isinstance(v, float) else "" if v is None else str(v)
    cells = lambda tag, row: "".join(f"<{tag}>{markup.escape(show(v))}</{tag}>" for v in row)
    lines = ["<!DOCTYPE html>", f"<html><head><meta charset='utf-8'><title>{markup.escape(title)}</title></head><body>", f"<h1>{markup.escape(title)}</h1>"]
    for heading, note, rows in sections:
        lines += [f"<h2>{markup.escape(heading)}</h2>", f"<p>{markup.escape(note)}</p>", f"<table><tr>{cells('th', rows.columns)}</tr>"]
        lines += [f"<tr>{cells('td', r)}</tr>" for r in rows.limit(top).collect()] + ["</table>"]
    text(spark, [*lines, "</body></html>"], path)
