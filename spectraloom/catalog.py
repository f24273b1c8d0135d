"""Wavenumber axes, band library, ratio rules, thresholds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values -----------------------------------------------------------
FULL_BANDS = 426
SHORT_BANDS = 421
AXIS_MIN = 960.0
AXIS_MAX = 1800.0
FULL_AXIS_START = 950.0
SHORT_AXIS_START = 960.0
AXIS_STEP = 2.0
EPS = 1e-12
RATIO_CAP = 10.0
NUM_PERCENTILE, NUM_FLOOR = 0.15, 1e-4
DEN_PERCENTILE, DEN_FLOOR = 0.03, 1e-2
N_CLUSTERS = 8
BAND_LIBRARY = [
    # band, centre, half-width, category
    ("1734", 1734.0, 13.0, "lipid"),
    ("amideI", 1655.0, 30.0, "amide"),
    ("amideII", 1545.0, 30.0, "amide"),
    ("ch2", 1464.0, 30.0, "lipid"),
    ("ch3", 1375.0, 30.0, "lipid"),
    ("po2_1080", 1080.0, 15.0, "phosphate"),
    ("po2_1235", 1235.0, 15.0, "phosphate"),
    ("carb_1030", 1030.0, 15.0, "carbohydrate"),
    ("carb_1155", 1155.0, 15.0, "carbohydrate"),
]
BASE_RATIOS = [("CH2/CH3", "ch2", "ch3"), ("AmideI/AmideII", "amideI", "amideII")]
AMIDE_LABELS = {"amideI": "AmideI", "amideII": "AmideII"}
KNOWN_BANDS = [
    # name, centre, category
    ("Amide I", 1655.0, "Protein"),
    ("Amide II", 1545.0, "Protein"),
    ("Amide III", 1240.0, "Protein"),
    ("Lipid CH2 bend", 1464.0, "Lipid"),
    ("Lipid CH3", 1375.0, "Lipid"),
    ("Ester C=O", 1740.0, "Lipid"),
    ("PO2− asym", 1235.0, "Phosphate"),
    ("PO2− sym", 1080.0, "Phosphate"),
    ("C–O stretch", 1045.0, "Carbohydrate"),
    ("C–O–C", 1155.0, "Carbohydrate"),
]
EFFECT_CUTS = [(0.147, "negligible"), (0.33, "small"), (0.474, "medium")]
STAR_CUTS = [(0.001, "***"), (0.01, "**"), (0.1, "*")]
# -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Axis:
    """Wavenumbers of a spectrum, known when the plan is built."""

    wn: tuple[float, ...]

    @staticmethod
    def linspace(lo: float, hi: float, z: int) -> "Axis":
        if z == 1:
            return Axis((lo,))
        step = (hi - lo) / (z - 1)
        return Axis(tuple(lo + step * k for k in range(z)))

    @staticmethod
    def for_bands(z: int) -> "Axis":
        """The axis a cube of ``z`` bands was taken on; plain indices if unknown."""
        start = {FULL_BANDS: FULL_AXIS_START, SHORT_BANDS: SHORT_AXIS_START}.get(z)
        if start is None:
            return Axis(tuple(float(k) for k in range(z)))
        return Axis(tuple(start + AXIS_STEP * k for k in range(z)))

    def __len__(self) -> int:
        return len(self.wn)

    def window(self, center: float, halfwidth: float) -> list[int]:
        """Indices with ``|wn - center| <= halfwidth``."""
        return [i for i, w in enumerate(self.wn) if center - halfwidth <= w <= center + halfwidth]

    def between(self, lo: float, hi: float) -> list[int]:
        return [i for i, w in enumerate(self.wn) if lo <= w <= hi]

    def nearest(self, value: float) -> int:
        return min(range(len(self.wn)), key=lambda i: (abs(self.wn[i] - value), i))


def inline_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small literal table.  As SQL VALUES Catalyst knows its size, so joins
    with it broadcast without a hint, and no Python worker is involved."""

    def literal(x) -> str:
        if x is None:
            return "NULL"
        return "'" + x.replace("'", "\\'") + "'" if isinstance(x, str) else repr(x)

    fields = [f.strip().split(" ", 1) for f in schema.split(",")]
    values = ", ".join("(" + ", ".join(literal(x) for x in row) + ")" for row in rows)
    names = ", ".join(f"`{n}`" for n, _ in fields)
    casts = ", ".join(f"CAST(`{n}` AS {t}) AS `{n}`" for n, t in fields)
    return spark.sql(f"SELECT {casts} FROM VALUES {values} AS t({names})")


def axis_table(spark: SparkSession, sizes: list[int]) -> DataFrame:
    """Dimension ``(z, k, wn)`` for the listed band counts."""
    z = inline_table(spark, [(s,) for s in sizes], "z int")
    start = F.when(F.col("z") == FULL_BANDS, F.lit(FULL_AXIS_START)).when(
        F.col("z") == SHORT_BANDS, F.lit(SHORT_AXIS_START)
    )
    return z.select("z", F.explode(F.sequence(F.lit(0), F.col("z") - 1)).alias("k")).select(
        "z", "k", F.coalesce(start + F.col("k") * AXIS_STEP, F.col("k").cast("double")).alias("wn")
    )


def bands_table(spark: SparkSession) -> DataFrame:
    return inline_table(
        spark, BAND_LIBRARY, "band string, center double, halfwidth double, category string"
    )


def known_bands_table(spark: SparkSession) -> DataFrame:
    return inline_table(spark, KNOWN_BANDS, "name string, center double, category string")


def ratio_list() -> list[tuple[str, str, str]]:
    """All 26 ratios as (ratio, numerator band, denominator band)."""
    by_kind: dict[str, list[str]] = {}
    for band, _, _, kind in BAND_LIBRARY:
        by_kind.setdefault(kind, []).append(band)
    out = list(BASE_RATIOS)
    for band, _, _, kind in BAND_LIBRARY:
        if kind != "amide":
            out += [(f"{band}/{AMIDE_LABELS[a]}", band, a) for a in by_kind["amide"]]
    for p in by_kind["phosphate"]:
        out += [(f"{p}/{x}", p, x) for x in by_kind["carbohydrate"] + by_kind["lipid"]]
    return out
