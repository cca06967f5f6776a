"""Summaries: load-test samples, corpus counts, catalogue listings and the manifest index."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hedgewise.functions.scalars import gain_cell, rounded_ms
from hedgewise.plans import keyed_join, written

P95 = 0.95


#: Cells of a histogram, and values that a cell may hold to be ordered as it is.
CELLS, SMALL = 1024, 10_000


def exact_percentile(
    samples: DataFrame, keys: Sequence[str], value: str, share: float, out: str, cells: int = CELLS, small: int = SMALL
) -> DataFrame:
    """Interpolated percentile per key, by histograms that narrow.

    Equal values are counted once. Each key's values between its own least and greatest are counted in ``cells`` cells; the
    cell that holds a wanted rank is cut again between the least and the greatest value in it, until it holds at most ``small``
    different values, which are ordered. So neither wide nor narrow ranges, nor far outliers, put more than that in one task,
    and a key's cells are never more than ``cells``. Nulls and NaN are no values.
    """
    keys = list(keys)
    number = F.col(value).cast("double")
    counts = written(
        samples.where(number.isNotNull() & ~F.isnan(number)).groupBy(*keys, number.alias("v")).agg(F.count(F.lit(1)).alias("rows")),
        "value-counts",
    )
    facts = [F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("kinds")]
    rank = (F.sum("rows") - 1) * F.lit(share)
    stats = written(counts.groupBy(*keys).agg(*facts, rank.alias("rank")), "value-ranges")
    ends = F.array_distinct(F.array(F.floor("rank"), F.ceil("rank")))
    wanted = stats.select(*keys, "low", "high", "kinds", F.lit(0).cast("long").alias("before"), F.explode(ends).alias("nth"))
    own = [*keys, "nth"]
    done = []
    while True:
        wanted = written(wanted, "wanted-ranks")
        done.append(wanted.where(F.col("kinds") <= small))
        wide = wanted.where(F.col("kinds") > small)
        if wide.isEmpty():
            break
        inside = keyed_join(counts, wide, keys, "inner").where("v BETWEEN low AND high")
        # halves, so that the range of the greatest numbers is a number too
        cell = F.least(F.lit(cells - 1), F.floor((F.col("v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * cells))
        filled = inside.groupBy(*own, "before", cell.alias("cell")).agg(*facts, F.sum("rows").alias("rows"))
        upward = Window.partitionBy(*own).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        filled = filled.withColumn("before", F.col("before") + F.coalesce(F.sum("rows").over(upward), F.lit(0)))
        wanted = filled.where("before <= nth AND nth < before + rows").select(*keys, "low", "high", "kinds", "before", "nth")
    last = keyed_join(counts, reduce(DataFrame.unionByName, done), keys, "inner").where("v BETWEEN low AND high")
    upward = Window.partitionBy(*own).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    placed = last.withColumn("start", F.col("before") + F.coalesce(F.sum("rows").over(upward), F.lit(0)))
    values = placed.where("start <= nth AND nth < start + rows").groupBy(*keys).agg(F.min("v").alias("a"), F.max("v").alias("b"))
    part = F.col("rank") - F.floor("rank")
    return keyed_join(stats.select(*keys, "rank"), values, keys, "inner").select(
        *keys, (F.col("a") + (F.col("b") - F.col("a")) * part).alias(out)
    )


def sample_summary(samples: DataFrame, label: str = "label", elapsed: str = "elapsed_ms", ok: str = "success") -> DataFrame:
    """Samples, errors, mean, 95th percentile and verdict per label, and a row of totals.

    The row of totals has a NULL label; samples without a label have a row of their own, with a NULL label too.
    """
    # told apart by a key that no label can be mistaken for another's
    own = F.coalesce(F.concat(F.lit("label "), F.col(label)), F.lit("none"))
    both = samples.select(F.explode(F.array(own, F.lit("all"))).alias("key"), F.col(elapsed).alias("elapsed"))
    p95 = exact_percentile(both, ["key"], "elapsed", P95, "p95_ms")
    stats = (
        samples.rollup(F.col(label).alias("label"))
        .agg(
            F.count(F.lit(1)).alias("samples"),
            F.count_if(~F.col(ok)).alias("errors"),
            F.avg(elapsed).alias("mean_ms"),
            F.grouping_id().alias("total"),
        )
        .withColumn("key", F.when(F.col("total") == 1, "all").otherwise(F.coalesce(F.concat(F.lit("label "), "label"), F.lit("none"))))
    )
    verdict = F.when(F.col("errors") == 0, "PASS").otherwise(
        F.format_string("FAIL (%d/%d)", "errors", "samples")
    )
    return stats.join(p95, "key", "left").select(
        "label", "samples", "errors", "mean_ms", "p95_ms", verdict.alias("verdict"),
        F.format_string("avg %d ms · p95 %d ms", rounded_ms(F.col("mean_ms")), rounded_ms(F.col("p95_ms"))).alias("latency"),
    )


def corpus_counts(features: DataFrame) -> DataFrame:
    """Rows per site, layer and retention with subtotals per layer and per site.

    ``subtotal`` is 0 for a count of one retention (NULL where features have none), 1 per layer, 3 per site.
    """
    counts = features.rollup("site_id", "layer", "retention").agg(
        F.count(F.lit(1)).alias("rows"), F.grouping_id().cast("int").alias("subtotal")
    )
    return counts.where("subtotal < 7")


def purposes(scenarios: DataFrame) -> DataFrame:
    """Distinct purposes in catalogue order."""
    return scenarios.groupBy("purpose").agg(F.min("scenario_no").alias("purpose_no")).orderBy("purpose_no")


def restrict(scenarios: DataFrame, only: str | None = None) -> DataFrame:
    """Scenarios of one purpose; all of them when none is named."""
    return scenarios if only is None else scenarios.where(F.col("purpose") == only)


def catalogue_listing(scenarios: DataFrame, width: int = 34) -> DataFrame:
    """Catalogue lines grouped by purpose, in catalogue order, with the count per purpose."""
    order = purposes(scenarios)
    sizes = scenarios.groupBy("purpose").agg(F.count(F.lit(1)).alias("in_purpose"))
    lines = keyed_join(scenarios, order.join(sizes, "purpose"), ["purpose"], "inner")
    # Padding must not shorten a longer id, so the pad is appended only where it is needed.
    padded = F.concat("id", F.repeat(F.lit(" "), F.greatest(F.lit(0), F.lit(width) - F.length("id"))))
    return lines.select(
        "purpose", "purpose_no", "scenario_no", "in_purpose",
        F.concat(F.lit("  "), padded, F.lit(" "), F.col("title")).alias("line"),
    ).orderBy("purpose_no", "scenario_no")


def index_lines(entries: DataFrame) -> DataFrame:
    """Lines of the human-readable index as rows ordered by (section_no, line_no).

    ``entries`` has the manifest's fields and ``scenario_no``. Section 0 is the head; each
    purpose is a section of its own, and no section is gathered into one value.
    """
    # The headings and layout of the index's sections.
    sections = purposes(entries).select("purpose", (F.col("purpose_no") + 1).alias("section_no"))
    totals = entries.agg(
        F.count(F.lit(1)).alias("scenarios"), F.countDistinct("purpose").alias("purposes")
    ).select(
        F.lit(0).cast("long").alias("section_no"),
        F.posexplode(
            F.array(
                F.lit("# Scenario catalogue"),
                F.lit(""),
                F.format_string("Total scenarios: **%d** across **%d** purposes.", "scenarios", "purposes"),
                F.lit(""),
            )
        ).alias("line_no", "line"),
    )
    heads = sections.select(
        "section_no",
        F.posexplode(
            F.array(
                F.concat(F.lit("## "), F.col("purpose")),
                F.lit(""),
                F.lit("| Scenario | Subject | Net gain | Files |"),
                F.lit("| --- | --- | --- | --- |"),
            )
        ).alias("line_no", "line"),
    )
    files = F.concat(
        F.lit("`"), F.col("files.baseline"), F.lit("` · `"), F.col("files.postIntervention"), F.lit("`")
    )
    row = F.concat(
        F.lit("| **"), F.col("title"), F.lit("**<br>"), F.col("description"), F.lit(" | "),
        F.col("subject.ref"), F.lit(" — "), F.col("subject.note"), F.lit(" | "),
        gain_cell(F.col("gain.expected"), F.col("gain.percentage")), F.lit(" | "), files, F.lit(" |"),
    )
    body = keyed_join(entries, sections, ["purpose"], "inner").select(
        "section_no", (F.col("scenario_no") + 4).cast("long").alias("line_no"), row.alias("line")
    )
    ends = body.groupBy("section_no").agg((F.max("line_no") + 1).alias("line_no"), F.lit("").alias("line"))
    head = totals.unionByName(heads).withColumn("line_no", F.col("line_no").cast("long"))
    return head.unionByName(body).unionByName(ends)


def missing_subjects(entries: DataFrame, features: DataFrame) -> DataFrame:
    """Scenarios whose subject feature is not in its layer.

    ``features`` has ``id`` (the scenario), ``layer`` and ``ref``.
    """
    wanted = entries.select("id", F.col("subject.layer").alias("layer"), F.col("subject.ref").alias("ref"))
    lost = wanted.join(features.select("id", "layer", "ref"), ["id", "layer", "ref"], "left_anti")
    return lost.withColumn(
        "message",
        F.format_string('subject %s "%s" is missing — the layer generated too few features', "layer", "ref"),
    )
