"""Column expressions for names, references, sizes, years and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SQ_METRES_PER_HECTARE = 10_000.0
METRES_PER_KILOMETRE = 1_000.0
SIGNIFICANT_FIGURES = 15
# 2^27 + 1 cuts a double into two halves whose products are exact.
SPLITTER = 134217729.0

# Reference prefix per layer.
REF_PREFIX = {"habitats": "H", "hedgerows": "HG", "rivers": "R", "trees": "T"}

# Fixed value: base name of a source that has none.
DEFAULT_BASE_NAME = "bng-from-workbook"

# The characters ECMAScript counts as white space when trimming.
TRIMMED_CHARS = " \t\n\v\f\r\u00A0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202F\u205F\u3000\uFEFF"


def habitat_name(broad: Column, kind: Column) -> Column:
    """``<broad> - <type>``; NULL if either half is."""
    return F.concat(broad, F.lit(" - "), kind)


def hectares(square_metres: Column) -> Column:
    return square_metres / F.lit(SQ_METRES_PER_HECTARE)


def kilometres(metres: Column) -> Column:
    return metres / F.lit(METRES_PER_KILOMETRE)


def years(raw: Column) -> Column:
    """Leading integer of a text, 0 when there is none; beyond 64 bits the nearest 64-bit number."""
    leading = F.regexp_extract(raw, r"^\s*([+-]?\d+)", 1)

    def beyond(text: Column) -> Column:
        return F.when(text.startswith("-"), F.lit(-(2**63))).when(text != "", F.lit(2**63 - 1)).otherwise(F.lit(0))

    # rare, so kept out of the generated code
    return F.coalesce(leading.try_cast("bigint"), F.get(F.transform(F.array(leading), beyond), F.lit(0)), F.lit(0)).cast("bigint")


def layer_ref(layer: str, number: Column) -> Column:
    """``H012``: prefix plus the whole number padded to at least three digits (``H-05``, and ``Hnull`` without one)."""
    digits = number.cast("string")
    padded = (
        F.when(number.between(0, 99), F.lpad(digits, 3, "0")).when(number.between(-9, -1), F.concat(F.lit("-0"), F.substring(digits, 2, 1)))
        .otherwise(F.coalesce(digits, F.lit("null")))
    )
    return F.concat(F.lit(REF_PREFIX[layer]), padded)


def parent_ref(ref: Column) -> Column:
    """The reference without one trailing letter."""
    return F.regexp_replace(ref, "[A-Za-z]$", "")


def significant(value: Column) -> Column:
    """Value trimmed to 15 significant figures, halves away from zero.

    The value is scaled to a 15-digit whole number in two doubles (product and its exact
    error, by splitting the factors), so the rounding sees the exact value and not its
    shortest decimal. Values outside 1e-8..1e15, which the scaling would not hold, are rounded by their decimal text. The one-element arrays
    name the intermediate results, each of which the next step reads several times.
    """

    def split(number: Column) -> Column:
        return number * SPLITTER - (number * SPLITTER - number)

    def scale(x: Column) -> Column:
        magnitude = F.floor(F.log10(F.greatest(x, F.lit(1e-8))))
        return F.struct(x.alias("x"), F.pow(F.lit(10.0), SIGNIFICANT_FIGURES - 1 - magnitude).alias("s"))

    def halves(r: Column) -> Column:
        x, s = r["x"], r["s"]
        return F.struct(
            x.alias("x"), s.alias("s"), (x * s).alias("p"), split(x).alias("xh"), split(s).alias("sh")
        )

    def error(r: Column) -> Column:
        x, s, p, xh, sh = (r[c] for c in ("x", "s", "p", "xh", "sh"))
        rest = ((xh * sh - p) + xh * (s - sh) + (x - xh) * sh) + (x - xh) * (s - sh)
        return F.struct(s.alias("s"), p.alias("p"), rest.alias("e"), F.floor(p).alias("f"))

    def whole(r: Column) -> Column:
        return (r["f"] + F.floor((r["p"] - r["f"]) + r["e"] + 0.5)) / r["s"]

    steps = F.array(F.abs(value))
    for step in (scale, halves, error, whole):
        steps = F.transform(steps, step)
    trimmed_value = F.get(steps, F.lit(0))
    inside = (F.abs(value) >= 1e-8) & (F.abs(value) < 1e15)

    def by_text(x: Column) -> Column:
        plain = F.isnan(x) | (F.abs(x) == F.lit(float("inf"))) | (x == 0)
        return F.when(plain, x).otherwise(F.format_string(f"%.{SIGNIFICANT_FIGURES - 1}e", x).try_cast("double"))

    # rare, so kept out of the generated code
    far = F.get(F.transform(F.array(value), by_text), F.lit(0))
    return F.when(inside, F.when(value < 0, -trimmed_value).otherwise(trimmed_value)).otherwise(far)


def is_finite(value: Column) -> Column:
    return F.coalesce(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), F.lit(False))


def percentage_label(value: Column) -> Column:
    """``12.3%``, or ``n/a`` when the value is not a finite number."""
    return F.when(is_finite(value), F.format_string("%.1f%%", value)).otherwise("n/a")


def gain_cell(expected: Column, percentage: Column) -> Column:
    """``met (12.3%)``, or a dash for a row without a gain expectation."""
    return F.when(expected.isNull(), "—").otherwise(
        F.concat(expected, F.lit(" ("), percentage_label(percentage), F.lit(")"))
    )


def media_url(url: Column) -> Column:
    """Hosted blob page address rewritten to the address that serves the file itself."""
    return F.regexp_replace(
        url,
        r"^https://github\.com/([^/]+)/([^/]+)/blob/([^/]+)/(.+)$",
        "https://media.githubusercontent.com/media/$1/$2/$3/$4",
    )


def source_base_name(source: Column, default: str = DEFAULT_BASE_NAME) -> Column:
    """Last path segment without query, fragment or spreadsheet extension."""
    path = F.regexp_replace(F.regexp_replace(source, r"(?s)[?#].*$", ""), "/+$", "")
    segment = F.element_at(F.split(path, "/"), -1)
    stem = F.regexp_replace(segment, r"(?i)\.(xlsx|xlsm|xls)$", "")
    return F.coalesce(F.nullif(stem, F.lit("")), F.lit(default))


def stage_file_name(base: Column, stage: str, stamp: Column) -> Column:
    return F.concat(base, F.lit(f"-{stage}-"), stamp, F.lit(".gpkg"))


def cache_key(url: Column) -> Column:
    """First 16 hex digits of the address's SHA-256."""
    return F.substring(F.sha2(url, 256), 1, 16)


def timestamp_suffix(moment: Column) -> Column:
    return F.date_format(moment, "yyyyMMdd-HHmm-ss")


def in_grid_envelope(easting: Column, northing: Column) -> Column:
    """Whether a national-grid coordinate is inside Britain's envelope (a warning, not a reject)."""
    return easting.between(0, 700_000) & northing.between(0, 1_300_000)


def scenario_base_name(purpose: Column, scenario_id: Column) -> Column:
    """Scenario id without a leading ``<purpose>-``."""
    prefix = F.concat(purpose, F.lit("-"))
    return F.when(
        F.startswith(scenario_id, prefix),
        F.substring(scenario_id, F.length(prefix) + 1, F.length(scenario_id)),
    ).otherwise(scenario_id)


def trimmed(text: Column) -> Column:
    """Without TRIMMED_CHARS at both ends, in one look from each end: a pattern would try every run of blanks within."""
    return F.btrim(text, F.lit(TRIMMED_CHARS))


def summary_label(passed: Column, total: Column) -> Column:
    return F.format_string("%d/%d pair(s) passed", passed, total)


def rounded_ms(value: Column) -> Column:
    """Nearest whole number, halves upward."""
    return F.floor(value + 0.5)
