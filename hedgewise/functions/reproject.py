"""British National Grid to WGS84 by the Ordnance Survey's published formulae.

Inverse transverse Mercator on the Airy ellipsoid, then the seven-parameter shift,
written as a chain of columns so that every intermediate is computed once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Airy 1830 and WGS84 semi-axes, and the national grid projection.
AIRY_A, AIRY_B = 6377563.396, 6356256.909
WGS84_A, WGS84_B = 6378137.0, 6356752.314245
SCALE = 0.9996012717
LAT0, LON0 = math.radians(49.0), math.radians(-2.0)
E0, N0 = 400_000.0, -100_000.0

# Shift from the grid's datum to WGS84 (metres, arc seconds, parts per million).
SHIFT = (446.448, -125.157, 542.060)
TURN = tuple(math.radians(v / 3600) for v in (0.1502, 0.2470, 0.8421))
STRETCH = 1 - 20.4894e-6

ROUNDS = 6


def _meridian_arc(lat: Column) -> Column:
    n = (AIRY_A - AIRY_B) / (AIRY_A + AIRY_B)
    d, s = lat - LAT0, lat + LAT0
    return F.lit(AIRY_B * SCALE) * (
        F.lit(1 + n + 1.25 * n**2 + 1.25 * n**3) * d
        - F.lit(3 * n + 3 * n**2 + 21 / 8 * n**3) * F.sin(d) * F.cos(s)
        + F.lit(15 / 8 * n**2 + 15 / 8 * n**3) * F.sin(2 * d) * F.cos(2 * s)
        - F.lit(35 / 24 * n**3) * F.sin(3 * d) * F.cos(3 * s)
    )


def to_wgs84(df: DataFrame, easting: str, northing: str) -> DataFrame:
    """Add ``lat`` and ``lon`` in degrees."""
    e2 = 1 - AIRY_B**2 / AIRY_A**2
    north, east = F.col(northing) - N0, F.col(easting) - E0
    rows = df.withColumn("_lat", north / (AIRY_A * SCALE) + LAT0)
    for _ in range(ROUNDS):
        rows = rows.withColumn("_lat", F.col("_lat") + (north - _meridian_arc(F.col("_lat"))) / (AIRY_A * SCALE))
    lat = F.col("_lat")
    rows = rows.withColumns({"_sin": F.sin(lat), "_sec": 1 / F.cos(lat), "_t": F.tan(lat)})
    rows = rows.withColumn("_w", 1 - e2 * F.col("_sin") * F.col("_sin"))
    rows = rows.withColumn("_nu", AIRY_A * SCALE / F.sqrt("_w"))
    rows = rows.withColumn("_rho", F.col("_nu") * (1 - e2) / F.col("_w"))
    rows = rows.withColumn("_eta", F.col("_nu") / F.col("_rho") - 1)
    t, nu, rho, eta, sec = (F.col(c) for c in ("_t", "_nu", "_rho", "_eta", "_sec"))
    t2 = t * t
    vii = t / (2 * rho * nu)
    viii = t / (24 * rho * nu * nu * nu) * (5 + 3 * t2 + eta - 9 * t2 * eta)
    ix = t / (720 * rho * F.pow(nu, 5)) * (61 + 90 * t2 + 45 * t2 * t2)
    x = sec / nu
    xi = sec / (6 * nu * nu * nu) * (nu / rho + 2 * t2)
    xii = sec / (120 * F.pow(nu, 5)) * (5 + 28 * t2 + 24 * t2 * t2)
    xiia = sec / (5040 * F.pow(nu, 7)) * (61 + 662 * t2 + 1320 * t2 * t2 + 720 * t2 * t2 * t2)
    e_2 = east * east
    rows = rows.withColumns(
        {
            "_la": lat - vii * e_2 + viii * e_2 * e_2 - ix * e_2 * e_2 * e_2,
            "_lo": LON0 + east * (x - xi * e_2 + xii * e_2 * e_2 - xiia * e_2 * e_2 * e_2),
        }
    )
    la, lo = F.col("_la"), F.col("_lo")
    rows = rows.withColumn("_n", AIRY_A / F.sqrt(1 - e2 * F.sin(la) * F.sin(la)))
    rows = rows.withColumns(
        {
            "_x": F.col("_n") * F.cos(la) * F.cos(lo),
            "_y": F.col("_n") * F.cos(la) * F.sin(lo),
            "_z": F.col("_n") * (1 - e2) * F.sin(la),
        }
    )
    px, py, pz = F.col("_x"), F.col("_y"), F.col("_z")
    rx, ry, rz = TURN
    rows = rows.withColumns(
        {
            "_x2": SHIFT[0] + STRETCH * px - rz * py + ry * pz,
            "_y2": SHIFT[1] + rz * px + STRETCH * py - rx * pz,
            "_z2": SHIFT[2] - ry * px + rx * py + STRETCH * pz,
        }
    )
    w2 = 1 - WGS84_B**2 / WGS84_A**2
    rows = rows.withColumn("_p", F.sqrt(F.col("_x2") * F.col("_x2") + F.col("_y2") * F.col("_y2")))
    rows = rows.withColumn("_f", F.atan2(F.col("_z2"), F.col("_p") * (1 - w2)))
    for _ in range(ROUNDS):
        radius = WGS84_A / F.sqrt(1 - w2 * F.sin("_f") * F.sin("_f"))
        rows = rows.withColumn("_f", F.atan2(F.col("_z2") + w2 * radius * F.sin("_f"), F.col("_p")))
    return rows.select(
        *df.columns, F.degrees("_f").alias("lat"), F.degrees(F.atan2("_y2", "_x2")).alias("lon")
    )
