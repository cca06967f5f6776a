"""Generator, scenario, pin and catalogue queries over sites derived from ``orders``."""

from __future__ import annotations

from pyspark.sql import functions as F
from hedgewise.operators import generate as gen

from hedgewise.operators import reporting as rep
from hedgewise.operators import scenarios as scn
from hedgewise.operators import shape_rules as sr
from hedgewise.operators import spatial as sp
from hedgewise.operators import validate as va
from hedgewise.plans import scratch_path, sized_join, written
from hedgewise.sources import manifest as man
from workload import sql as q
from workload import tables as t
from workload.pricing import rounded
from workload.registry import query

SEED = 7
NAMES = [f"Broad {h % 3} - Type {h}" for h in (0, 2, 5, 6, 7)]
HEDGES = [f"Hedge {h}" for h in range(6)]
RIVERS = [f"Water {h}" for h in range(4)]
# Purposes of the catalogue, in its order.
PURPOSES = ["intervention", "conditions", "strategic-significance", "net-gain", "trading-rules"]


def sites(spark, folder):
    """One site per order; its size follows from the customer."""
    return t.load(spark, folder, "orders").select(
        F.col("o_orderkey").alias("site_id"),
        (F.col("o_custkey") % 20 + 3).alias("parcels"),
        F.lit(SEED).cast("long").alias("seed"),
        (F.col("o_orderkey") % 500 * 1000.0 + 100_000).alias("x"),
        (F.floor(F.col("o_orderkey") / 500) * 100.0 + 50_000).alias("y"),
    )


def generated(spark, folder):
    return gen.generate(sites(spark, folder), NAMES, t.CONDITIONS, HEDGES, RIVERS)


SIZES_SQL = """
sizes AS (SELECT o_orderkey AS site_id, o_custkey % 20 + 3 AS parcels, greatest(3, (o_custkey % 20 + 3) // 3) AS hedgerows,
  greatest(2, (o_custkey % 20 + 3) // 15) AS rivers, greatest(5, (o_custkey % 20 + 3) // 2) AS trees FROM orders)"""


@query("layer_sizes", f"WITH {SIZES_SQL} SELECT * FROM sizes")
def layer_sizes(spark, folder):
    rows = sites(spark, folder)
    return rows.select("site_id", "parcels", *[c.cast("long").alias(n) for n, c in gen.layer_sizes(F.col("parcels")).items()])


@query(
    "generated_layer_counts",
    f"""WITH {SIZES_SQL}
SELECT site_id, 'Red Line Boundary' AS layer, CAST(1 AS BIGINT) AS features, (parcels * 5000.0)::DOUBLE AS area_m2 FROM sizes
UNION ALL SELECT site_id, 'Habitats', parcels, parcels * 5000.0 FROM sizes
UNION ALL SELECT site_id, 'Hedgerows', hedgerows, 0.0 FROM sizes
UNION ALL SELECT site_id, 'Rivers', rivers, 0.0 FROM sizes
UNION ALL SELECT site_id, 'Urban Trees', trees, 0.0 FROM sizes""",
)
def generated_counts(spark, folder):
    """Counts and exact tiling of the generated sites."""
    return sr.with_facts(generated(spark, folder)).groupBy("site_id", "layer").agg(
        F.count(F.lit(1)).alias("features"), F.sum("area").alias("area_m2")
    )


@query("generated_features")
def generated_features(spark, folder):
    return generated(spark, folder)


@query("generated_corpus_counts")
def generated_corpus_counts(spark, folder):
    return rep.corpus_counts(generated(spark, folder).where("layer <> 'Red Line Boundary'"))


@query(
    "corpus_counts",
    f"""WITH {q.PARCELS}, f AS (SELECT site_id, CASE WHEN l_linenumber < 5 THEN 'Habitats' ELSE 'Hedgerows' END AS layer, retention FROM parcels)
SELECT site_id, layer, retention, count(*) AS rows, CAST(grouping(site_id, layer, retention) AS INTEGER) AS subtotal
FROM f GROUP BY ROLLUP (site_id, layer, retention) HAVING grouping(site_id, layer, retention) < 7""",
)
def corpus_counts(spark, folder):
    rows = t.parcels(spark, folder).withColumn(
        "layer", F.when(F.col("l_linenumber") < 5, "Habitats").otherwise("Hedgerows")
    )
    return rep.corpus_counts(rows)


def pins(spark, folder):
    """Two pins on the sites of every ninth order."""
    return sites(spark, folder).where("site_id % 9 = 0").select(
        "site_id", F.posexplode(F.array(F.lit("Pinned - First"), F.lit("Pinned - Second"))).alias("at", "full_name")
    ).select("site_id", (F.col("at") + 1).alias("pin_no"), "full_name")


@query(
    "pinned_habitats",
    """SELECT o_orderkey AS site_id, CAST(p.n AS BIGINT) AS feature_id, p.name AS base_name, p.name AS prop_name, 'Retained' AS retention
FROM orders CROSS JOIN (VALUES (1, 'Pinned - First'), (2, 'Pinned - Second')) AS p(n, name) WHERE o_orderkey % 9 = 0""",
)
def pinned_habitats(spark, folder):
    pinned = gen.pin_habitats(generated(spark, folder), pins(spark, folder))
    return pinned.where("startswith(base_name, 'Pinned')").select(
        "site_id", "feature_id", "base_name", "prop_name", "retention"
    )


def flaws(spark, folder):
    """Every site gets one of the flaws, or none."""
    names = F.array(*[F.lit(f) for f in gen.FLAWS], F.lit("none"))
    pick = F.get(names, (F.col("site_id") % (len(gen.FLAWS) + 1)).cast("int"))
    return sites(spark, folder).select("site_id", pick.alias("flaw")).where("flaw <> 'none'")


@query("flawed_site_codes")
def flawed_site_codes(spark, folder):
    """Which shape and fit rules each planted flaw trips, over all sites."""
    plan = flaws(spark, folder)
    base = gen.flawed_sites(sites(spark, folder), plan)
    made = gen.generate(gen.planned_sites(base, plan), NAMES, t.CONDITIONS, HEDGES, RIVERS, carried=gen.PLAN.values())
    flawed = gen.inject_flaws(made, plan, base, "Broad 1 - Type 1").withColumn("stage", F.lit("baseline"))
    # rules on shapes read no attributes
    features = sr.with_facts(flawed.select("site_id", "stage", "layer", "feature_id", "feature_ref", "geometry"))
    features = written(features, "flawed")
    shapes = sr.shape_rules(base.withColumn("stage", F.lit("baseline")), features).unionByName(
        sr.legal_shape_rules(features)
    )
    shapes = written(shapes, "shapes-of-flawed")
    found = shapes.unionByName(sp.fit_rules(va.without(features, shapes)))
    return (
        sized_join(found, plan, ["site_id"], "left")
        .groupBy(F.coalesce("flaw", F.lit("none")).alias("flaw"), "code")
        .agg(F.countDistinct("site_id").alias("sites"))
    )


# -- scenarios -----------------------------------------------------------------------------


def scenarios(spark, folder):
    """A catalogue with one scenario per order."""
    key = F.col("o_orderkey")
    purpose = t.pick(PURPOSES, key % 5)
    led = F.when(key % 2 == 0, F.concat(purpose, F.lit("-scenario-"), key.cast("string"))).otherwise(
        F.concat(F.lit("scenario-"), key.cast("string"))
    )
    gain = F.when(key % 5 == 3, F.when(key % 10 == 3, "met").otherwise("unmet"))
    return t.load(spark, folder, "orders").select(
        key.alias("scenario_no"), led.alias("id"), purpose.alias("purpose"),
        F.concat(F.lit("Title "), key.cast("string")).alias("title"),
        F.concat(F.lit("About "), "o_orderpriority").alias("description"),
        (F.col("o_custkey") % 4 + 3).cast("int").alias("size"),
        gain.alias("expected"),
        F.struct(
            F.lit("Habitats").alias("layer"),
            F.when(key % 17 == 0, "H099").otherwise("H001").alias("ref"),
            F.lit("a subject").alias("note"),
        ).alias("subject"),
    )


SCENARIOS = """
scn AS (SELECT o_orderkey AS scenario_no,
  (['intervention','conditions','strategic-significance','net-gain','trading-rules'])[CAST(o_orderkey % 5 AS INTEGER) + 1] AS purpose,
  CASE WHEN o_orderkey % 2 = 0
    THEN (['intervention','conditions','strategic-significance','net-gain','trading-rules'])[CAST(o_orderkey % 5 AS INTEGER) + 1] || '-scenario-' || o_orderkey
    ELSE 'scenario-' || o_orderkey END AS id, 'Title ' || o_orderkey AS title, 'About ' || o_orderpriority AS description,
  CAST(o_custkey % 4 + 3 AS INTEGER) AS size,
  CASE WHEN o_orderkey % 5 = 3 THEN CASE WHEN o_orderkey % 10 = 3 THEN 'met' ELSE 'unmet' END END AS expected FROM orders)"""


def overrides(spark, folder):
    """Net-gain scenarios: every parcel enhanced where a gain is expected, retained where not."""
    met = F.col("expected") == "met"
    rows = scenarios(spark, folder).where("expected IS NOT NULL")
    numbers = F.sequence(F.lit(1), F.col("size"))
    return rows.select(
        F.col("scenario_no").alias("site_id"), F.lit("Habitats").alias("layer"),
        F.explode(F.transform(numbers, lambda n: n.cast("long"))).alias("feature_id"),
        F.when(met, "Enhanced").otherwise("Retained").alias("retention"),
        F.lit("Broad 0 - Type 0").alias("base_name"),
        F.lit("Poor").alias("base_condition"),
        F.when(met, "Broad 2 - Type 2").otherwise("Broad 0 - Type 0").alias("prop_name"),
        F.when(met, "Good").otherwise("Poor").alias("prop_condition"),
    )


def scenario_run(spark, folder):
    catalogue = scenarios(spark, folder)
    features = scn.scenario_features(
        catalogue, overrides(spark, folder), SEED, NAMES, t.CONDITIONS, HEDGES, RIVERS
    )
    return catalogue, features, scn.scenario_gains(catalogue, features, t.synthetic_lookups(spark))


# Low/Poor to Medium/Good over (0 + 4*3 + 2*7 + 0*5) % 34 = 26 years, band Medium.
RUN = f"""WITH {SCENARIOS},
priced AS (SELECT *, size * 0.5 * 2 * 1 AS baseline_units,
  CASE expected WHEN 'met' THEN size * (0.5 * 2 + (0.5 * 4 * 3 - 0.5 * 2) * round(pow(0.965, 26), 10) * 0.67)
    WHEN 'unmet' THEN size * 0.5 * 2 * 1 END AS post_units FROM scn)"""


@query(
    "scenario_manifest",
    f"""{RUN}
SELECT scenario_no, id, purpose, size,
  purpose || '/' || CASE WHEN starts_with(id, purpose || '-') THEN substr(id, length(purpose) + 2) ELSE id END || '-baseline.gpkg' AS baseline_file,
  expected, CASE WHEN expected IS NOT NULL THEN {q.rounded('(post_units - baseline_units) / baseline_units * 100', 4)} END AS percentage,
  CASE WHEN expected IS NOT NULL THEN expected = 'met' END AS met,
  CASE WHEN expected IS NOT NULL THEN CAST(size AS BIGINT) END AS priced FROM priced""",
)
def scenario_manifest(spark, folder):
    catalogue, _, gains = scenario_run(spark, folder)
    return scn.manifest_entries(catalogue, gains).select(
        "scenario_no", "id", "purpose", "size", F.col("files.baseline").alias("baseline_file"),
        F.col("gain.expected").alias("expected"), rounded("gain.percentage", 4).alias("percentage"),
        F.col("gain.met").alias("met"), F.col("gain.priced").alias("priced"),
    )


@query(
    "scenario_failures",
    f"""{RUN}, judged AS (SELECT scenario_no,
  CASE WHEN scenario_no % 13 <> 0 THEN expected WHEN expected = 'met' THEN 'unmet' ELSE 'met' END AS expected,
  CASE WHEN (post_units - baseline_units) / baseline_units * 100 >= 10 THEN 'met' ELSE 'unmet' END AS found FROM priced WHERE expected IS NOT NULL)
SELECT scenario_no AS site_id, expected, found FROM judged WHERE expected <> found""",
)
def scenario_failures(spark, folder):
    """Every thirteenth scenario declares the wrong side."""
    _, _, gains = scenario_run(spark, folder)
    wrong = F.when(F.col("expected") == "met", "unmet").when(F.col("expected").isNotNull(), "met")
    declared = F.when(F.col("site_id") % 13 == 0, wrong).otherwise(F.col("expected"))
    return scn.failed_scenarios(gains.withColumn("expected", declared)).select("site_id", "expected", "found")


@query(
    "missing_subjects",
    f"""WITH {SCENARIOS} SELECT id, 'Habitats' AS layer, 'H099' AS ref,
  'subject Habitats "H099" is missing — the layer generated too few features' AS message FROM scn WHERE scenario_no % 17 = 0""",
)
def missing_subjects(spark, folder):
    catalogue, features, _ = scenario_run(spark, folder)
    ids = catalogue.select(F.col("scenario_no").alias("site_id"), "id")
    named = features.select("site_id", "layer", F.col("feature_ref").alias("ref")).join(ids, "site_id")
    return rep.missing_subjects(catalogue, named)


@query(
    "purposes",
    f"WITH {SCENARIOS} SELECT purpose, min(scenario_no) AS purpose_no FROM scn GROUP BY 1",
)
def purposes(spark, folder):
    return rep.purposes(scenarios(spark, folder))


@query(
    "one_purpose",
    f"WITH {SCENARIOS} SELECT id, title FROM scn WHERE purpose = 'net-gain'",
)
def one_purpose(spark, folder):
    return rep.restrict(scenarios(spark, folder), "net-gain").select("id", "title")


@query(
    "catalogue_listing",
    f"""WITH {SCENARIOS}, o AS (SELECT purpose, min(scenario_no) AS purpose_no, count(*) AS in_purpose FROM scn GROUP BY 1)
SELECT s.purpose, purpose_no, scenario_no, in_purpose,
  '  ' || id || repeat(' ', greatest(0, 34 - length(id))) || ' ' || title AS line FROM scn s JOIN o ON o.purpose = s.purpose""",
)
def catalogue_listing(spark, folder):
    return rep.catalogue_listing(scenarios(spark, folder))


@query(
    "first_parcel_by_ref",
    f"WITH {q.PARCELS} SELECT parcel_ref, site_id, l_partkey FROM parcels ORDER BY parcel_ref, site_id, l_partkey, l_suppkey LIMIT 1",
)
def first_parcel(spark, folder):
    return t.parcels(spark, folder).orderBy("parcel_ref", "site_id", "l_partkey", "l_suppkey").limit(1).select(
        "parcel_ref", "site_id", "l_partkey"
    )


def plain_entries(spark, folder):
    catalogue = scenarios(spark, folder)
    gains = catalogue.where("expected IS NOT NULL").select(
        F.col("scenario_no").alias("site_id"), "expected",
        F.when(F.col("expected") == "met", 293.0).otherwise(0.0).alias("net_gain_pct"),
        F.lit(1.0).alias("net_unit_change"), F.lit(2.0).alias("baseline_units"), F.lit(3.0).alias("post_units"),
        (F.col("expected") == "met").alias("met"), F.col("size").cast("long").alias("priced"),
        F.lit(0).cast("long").alias("skipped"),
    )
    return scn.manifest_entries(catalogue, gains)


@query(
    "manifest_round_trip",
    f"""WITH {SCENARIOS} SELECT id, purpose, title, size, 'H' || CASE WHEN scenario_no % 17 = 0 THEN '099' ELSE '001' END AS ref,
  expected, CASE expected WHEN 'met' THEN 293.0::DOUBLE WHEN 'unmet' THEN 0.0::DOUBLE END AS percentage FROM scn""",
)
def manifest_round_trip(spark, folder):
    """Entries written as the manifest's lines and read back."""
    path = scratch_path(spark, "manifest")
    man.write_manifest(plain_entries(spark, folder), path)
    return man.read_entries(spark, path).select(
        "id", "purpose", "title", "size", F.col("subject.ref").alias("ref"),
        F.col("gain.expected").alias("expected"), F.col("gain.percentage").alias("percentage"),
    )


@query(
    "manifest_index",
    f"""WITH {SCENARIOS}, o AS (SELECT purpose, min(scenario_no) + 1 AS section_no FROM scn GROUP BY 1)
SELECT CAST(0 AS BIGINT) AS section_no, CAST(k AS BIGINT) AS line_no, (['# Scenario catalogue', '',
    'Total scenarios: **' || (SELECT count(*) FROM scn) || '** across **' || (SELECT count(*) FROM o) || '** purposes.', ''])[k + 1] AS line
  FROM (VALUES (0), (1), (2), (3)) AS v(k)
UNION ALL SELECT section_no, k, (['## ' || purpose, '', '| Scenario | Subject | Net gain | Files |', '| --- | --- | --- | --- |'])[k + 1]
  FROM o CROSS JOIN (VALUES (0), (1), (2), (3)) AS v(k)
UNION ALL SELECT section_no, scenario_no + 4, '| **' || title || '**<br>' || description || ' | H'
    || CASE WHEN scenario_no % 17 = 0 THEN '099' ELSE '001' END || ' — a subject | '
    || CASE expected WHEN 'met' THEN 'met (293.0%)' WHEN 'unmet' THEN 'unmet (0.0%)' ELSE '—' END || ' | `' || f || '-baseline.gpkg` · `' || f || '-post-intervention.gpkg` |'
  FROM (SELECT *, purpose || '/' || CASE WHEN starts_with(id, purpose || '-') THEN substr(id, length(purpose) + 2) ELSE id END AS f FROM scn) s
  JOIN o ON o.purpose = s.purpose
UNION ALL SELECT section_no, max(scenario_no) + 5, '' FROM scn JOIN o ON o.purpose = scn.purpose GROUP BY 1""",
)
def manifest_index(spark, folder):
    return rep.index_lines(plain_entries(spark, folder))
