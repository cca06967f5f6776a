"""Unit pricing of parcels as column expressions over broadcast lookup joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hedgewise.functions.scalars import hectares, significant, years
from hedgewise.operators.lookups import (
    AREA,
    DIFFICULTY_MULTIPLIERS,
    HEDGEROW,
    POOR,
    WATERCOURSE,
    Lookups,
    condition_attributes,
    enhancement_years,
    habitat_attributes,
    target_attributes,
    target_conditions,
)
from hedgewise.plans import keyed_join

RETAINED, ENHANCED, CREATED, LOST = "Retained", "Enhanced", "Created", "Lost"
NO_MODE, RETAINED_MODE, ENHANCED_MODE, CREATED_MODE = 0, 1, 2, 3
MAX_SHIFT_YEARS = 30

# Yearly retention of value and the multiplier beyond 30 years.
YEARLY_FACTOR = 0.965
BEYOND_MAX_MULTIPLIER = 0.3197967361
TIME_TABLE = [round(YEARLY_FACTOR**y, 10) for y in range(MAX_SHIFT_YEARS + 1)] + [BEYOND_MAX_MULTIPLIER]

# An area row marked Lost is replaced by what is created in its place; in the linear
# and tree layers Lost rows are gone and creations are marked as such.
CREATED_LABELS = {AREA: (LOST,), HEDGEROW: (CREATED,), WATERCOURSE: (CREATED,)}


def adjusted_years(reference: Column, advance: Column, delay: Column) -> Column:
    """Reference years plus delay minus advance, never below zero; NULL without a reference."""
    shifted = reference + delay - advance
    return F.when(shifted < 0, F.lit(0)).otherwise(shifted)


def time_multiplier(waiting: Column) -> Column:
    """Multiplier for whole years of waiting; everything beyond 30 is one band."""
    table = F.array(*[F.lit(m) for m in TIME_TABLE])
    last = len(TIME_TABLE) - 1
    return F.get(table, F.when(waiting > last, F.lit(last)).otherwise(waiting))


def with_difficulty(rows: DataFrame, kind: str) -> DataFrame:
    """Add ``band`` and ``difficulty``; both tests compare the advance with years it already shortened."""
    advance = F.col("advance")
    past_poor = (advance > 0) & (
        advance >= adjusted_years(F.col("prop_poor_years"), advance, F.col("delay"))
    )
    as_created = (F.col("mode") == CREATED_MODE) & ~F.coalesce(past_poor, F.lit(False))
    covered = F.coalesce((advance > 0) & (advance >= F.col("waiting")), F.lit(False))
    rows = rows.withColumns({"as_created": as_created, "covered": covered if kind == AREA else F.lit(False)})

    def chosen(low, create: str, enhance: str) -> Column:
        by_table = F.when(F.col("as_created"), F.col(create)).otherwise(F.col(enhance))
        return F.when(F.col("covered"), F.lit(low)).otherwise(by_table)

    return rows.withColumns(
        {
            "band": chosen("Low", "create_difficulty", "enhance_difficulty"),
            "difficulty": chosen(DIFFICULTY_MULTIPLIERS["Low"], "create_factor", "enhance_factor"),
        }
    )


def standing_units(size: Column, distinctiveness: Column, condition: Column) -> Column:
    """Units of habitat that is simply there: baseline or retained."""
    return size * distinctiveness * condition


def post_units() -> Column:
    """Units after the works, from the standing value of both states.

    Creation discounts the whole new value; enhancement keeps the existing value in
    full and discounts the uplift only.
    """
    before, after = F.col("before_units"), F.col("after_units")
    time, difficulty = F.col("time"), F.col("difficulty")
    return (
        F.when(F.col("mode") == RETAINED_MODE, before)
        .when(F.col("mode") == ENHANCED_MODE, before + (after - before) * time * difficulty)
        .otherwise(after * time * difficulty)
    )


# -- reject reasons ------------------------------------------------------------

# A reason is carried as a small number and spelled out only where its text is asked
# for, which keeps the generated code of the pricing stage short enough to be compiled.
(
    UNPRICED, BASE_UNKNOWN, PROP_UNKNOWN, BASE_CONDITION, PROP_CONDITION, SHIFT_CONFLICT, SHIFT_LONG,
    YEARS_UNLISTED, NOT_POSSIBLE, POOR_NOT_POSSIBLE, ENCROACHMENT_MISSING, BAND_UNLISTED, SIZE_MISSING,
) = range(1, 14)


def _first(*checks: tuple[Column, int], otherwise: Column | None = None) -> Column:
    """Number of the first check that holds, else ``otherwise``, NULL when there is none."""
    chain = F
    for condition, number in checks:
        chain = chain.when(condition, F.lit(number))
    return chain if otherwise is None else chain.otherwise(otherwise)


def base_reject_code() -> Column:
    return _first(
        (F.col("base_d").isNull(), BASE_UNKNOWN),
        (F.col("base_c").isNull(), BASE_CONDITION),
        (F.col("size").isNull(), SIZE_MISSING),
    )


def post_reject_code(kind: str) -> Column:
    """First reason a row has no units after the works, NULL when it has."""
    mode, advance, delay = F.col("mode"), F.col("advance"), F.col("delay")
    created, limit = mode == CREATED_MODE, F.lit(MAX_SHIFT_YEARS)
    checks = [
        (~created & F.col("base_d").isNull(), BASE_UNKNOWN),
        (F.col("prop_d").isNull(), PROP_UNKNOWN),
        (~created & F.col("base_c").isNull(), BASE_CONDITION),
        (F.col("prop_c").isNull(), PROP_CONDITION),
        ((advance > 0) & (delay > 0), SHIFT_CONFLICT),
        ((advance > limit) | (delay > limit), SHIFT_LONG),
        (F.col("waiting").isNull(), NOT_POSSIBLE),
    ]
    if kind == AREA:
        # Years to poor are looked up even where no advance makes them matter.
        checks.append((created & (advance <= 0) & F.col("prop_poor_years").isNull(), POOR_NOT_POSSIBLE))
    if kind == WATERCOURSE:
        missing = F.col("encroachment_m").isNull() | F.col("riparian_m").isNull()
        checks.append((created & missing, ENCROACHMENT_MISSING))
    checks += [(F.col("difficulty").isNull(), BAND_UNLISTED), (F.col("size").isNull(), SIZE_MISSING)]
    return (
        F.when(mode == RETAINED_MODE, F.col("base_code"))
        .when(mode == NO_MODE, F.lit(UNPRICED))
        .otherwise(_first(*checks))
    )


def with_unlisted(code: Column) -> Column:
    """Tell a target the tables do not list from one they list as not possible."""
    return F.when((code == NOT_POSSIBLE) & F.col("reference_listed").isNull(), YEARS_UNLISTED).otherwise(code)


# Wording per reason, over (1 retention, 2 baseline habitat, 3 baseline
# condition, 4 proposed habitat, 5 proposed condition, 6 advance, 7 delay).
REASONS = {
    UNPRICED: "Retention category '%1$s' is not priced",
    BASE_UNKNOWN: "Habitat '%2$s' is not a valid habitat",
    PROP_UNKNOWN: "Habitat '%4$s' is not a valid habitat",
    BASE_CONDITION: "Condition '%3$s' is not a valid condition for habitat: %2$s",
    PROP_CONDITION: "Condition '%5$s' is not a valid condition for habitat: %4$s",
    SHIFT_CONFLICT: "Advance (%6$s) and delay (%7$s) years cannot both be used on the same habitat."
    " Use one or the other, or split the habitat across two parcels.",
    SHIFT_LONG: f"Advance (%6$s) or delay (%7$s) years exceed the limit of {MAX_SHIFT_YEARS}",
    YEARS_UNLISTED: "Lookup missing (years to target) for habitat: %4$s",
    NOT_POSSIBLE: "Time to target 'Not Possible' for habitat: %4$s, endCondition: %5$s",
    POOR_NOT_POSSIBLE: f"Time to target 'Not Possible' for habitat: %4$s, endCondition: {POOR}",
    ENCROACHMENT_MISSING: "Encroachment missing for habitat: %4$s",
    BAND_UNLISTED: "Lookup missing (difficulty) for habitat: %4$s",
    SIZE_MISSING: "Size missing",
}


def reject_text(code: Column) -> Column:
    """The reason in words, NULL without a reason."""
    wording = F.get(F.array(F.lit(""), *[F.lit(REASONS[n]) for n in sorted(REASONS)]), code)
    arguments = ("retention", "base_name", "base_condition", "prop_name", "prop_condition", "advance", "delay")
    return F.when(
        code.isNotNull(), F.call_function("format_string", wording, *[F.col(a) for a in arguments])
    )


# -- the operator ----------------------------------------------------------------


def with_lookups(df: DataFrame, lookups: Lookups, kind: str) -> DataFrame:
    """Join every lookup pricing needs; a miss leaves NULLs, never drops the row."""
    base, prop = ["base_name"], ["prop_name"]
    joined = df
    for table, keys in (
        (habitat_attributes(lookups, kind), base),
        (target_attributes(lookups, kind), prop),
        (condition_attributes(lookups, kind), [*base, "base_condition"]),
        (target_conditions(lookups, kind), [*prop, "prop_condition"]),
        (enhancement_years(lookups, kind), [*base, "base_condition", *prop, "prop_condition"]),
    ):
        joined = keyed_join(joined, table, keys)
    if kind == WATERCOURSE:
        for table, column, factor in (
            (lookups.encroachment, "prop_encroachment", "encroachment_m"),
            (lookups.riparian, "prop_riparian", "riparian_m"),
        ):
            joined = keyed_join(
                joined, table.select(F.col("name").alias(column), F.col("multiplier").alias(factor)), [column]
            )
    return joined


def price(
    df: DataFrame, lookups: Lookups, kind: str = AREA, created_labels: Sequence[str] | None = None
) -> DataFrame:
    """Add ``base_price`` and ``post_price`` to rows of one layer.

    Needs ``size`` (ha or km), ``base_name``, ``base_condition``, ``prop_name``,
    ``prop_condition``, ``retention``, ``advance_raw``, ``delay_raw`` and, for
    watercourses, ``prop_encroachment`` and ``prop_riparian``. A row that cannot be
    priced keeps its place with NULL units and the first reason in ``reject``.
    """
    labels = CREATED_LABELS[kind] if created_labels is None else tuple(created_labels)
    retention, mode = F.col("retention"), F.col("mode")
    rows = df.withColumns(
        {
            "advance": years(F.col("advance_raw")),
            "delay": years(F.col("delay_raw")),
            "mode": F.when(retention == RETAINED, RETAINED_MODE)
            .when(retention == ENHANCED, ENHANCED_MODE)
            .when(retention.isin(*labels), CREATED_MODE)
            .otherwise(NO_MODE),
        }
    )
    rows = with_lookups(rows, lookups, kind)
    created = mode == CREATED_MODE
    rows = rows.withColumns(
        {
            "reference_years": F.when(created, F.col("create_years")).otherwise(F.col("enhance_years")),
            "reference_listed": F.when(created, F.col("create_listed")).otherwise(F.col("enhance_listed")),
            "before_units": standing_units(F.col("size"), F.col("base_d"), F.col("base_c")),
            "after_units": standing_units(F.col("size"), F.col("prop_d"), F.col("prop_c")),
            "base_code": base_reject_code(),
        }
    )
    waiting = adjusted_years(F.col("reference_years"), F.col("advance"), F.col("delay"))
    rows = with_difficulty(rows.withColumn("waiting", waiting), kind)
    rows = rows.withColumns({"time": time_multiplier(F.col("waiting")), "post_code": post_reject_code(kind)})
    base_units, units = F.col("before_units"), post_units()
    if kind == WATERCOURSE:
        pressed = F.coalesce("encroachment_m", F.lit(1.0)) * F.coalesce("riparian_m", F.lit(1.0))
        base_units, units = base_units * pressed, units * pressed
    rows = rows.withColumns(
        {
            "base_raw": F.when(F.col("base_code").isNull(), base_units),
            "post_raw": F.when(F.col("post_code").isNull(), units),
        }
    )
    rows = rows.withColumns(
        {"base_units": significant(F.col("base_raw")), "post_units": significant(F.col("post_raw"))}
    )
    base_ok, post_ok = F.col("base_code").isNull(), F.col("post_code").isNull()
    risky = post_ok & (mode != RETAINED_MODE)
    rows = rows.withColumns(
        {
            "base_distinctiveness": F.when(base_ok, F.col("base_d")),
            "base_condition_score": F.when(base_ok, F.col("base_c")),
            "base_reject": reject_text(F.col("base_code")),
            "post_distinctiveness": F.when(
                post_ok, F.when(mode == RETAINED_MODE, F.col("base_d")).when(created, F.col("prop_d"))
            ),
            "post_condition_score": F.when(
                post_ok, F.when(mode == RETAINED_MODE, F.col("base_c")).when(created, F.col("prop_c"))
            ),
            "post_time": F.when(risky, F.col("time")),
            "post_difficulty": F.when(risky, F.col("difficulty")),
            "post_band": F.when(risky, F.col("band")),
            "standard_years": F.when(risky, F.col("reference_years")),
            "post_reject": reject_text(with_unlisted(F.col("post_code"))),
            "incomplete": _incomplete(),
        }
    )
    base_price = {
        "units": "base_units", "distinctiveness": "base_distinctiveness", "condition": "base_condition_score",
        "reject": "base_reject",
    }
    post_price = {
        "units": "post_units", "distinctiveness": "post_distinctiveness", "condition": "post_condition_score",
        "time": "post_time", "difficulty": "post_difficulty", "band": "post_band",
        "standard_years": "standard_years", "reject": "post_reject",
    }

    def packed(fields: dict[str, str]) -> Column:
        # Strategic significance is reported but always 1.
        return F.struct(*[F.col(c).alias(n) for n, c in fields.items()], F.lit(1.0).alias("significance"))

    return rows.select(
        *df.columns, "advance", "delay", "base_band", "prop_band", "incomplete",
        packed(base_price).alias("base_price"), packed(post_price).alias("post_price"),
    )


def _incomplete() -> Column:
    """A feature whose habitat or condition is not recognised scores zero and is flagged."""
    before = F.col("base_d").isNull() | F.col("base_c").isNull()
    after = F.col("prop_d").isNull() | F.col("prop_c").isNull()
    return F.when(F.col("retention") == RETAINED, before).otherwise(before | after)


def with_tree_size(trees: DataFrame, lookups: Lookups, size_column: str = "tree_size") -> DataFrame:
    """Add ``size`` in hectares from the notional area of a tree's size band."""
    area = lookups.tree_area.select(F.col("size").alias(size_column), "area_m2")
    return keyed_join(trees, area, [size_column]).withColumn("size", hectares(F.col("area_m2")))
