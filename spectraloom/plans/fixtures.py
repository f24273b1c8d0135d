"""Views that show the driver tables as the engine's inputs, in Spark and in SQL.

``spectra`` reads ``embeddings``; lifetime pixels read ``lineitem``; rasters and
photons read ``events``; predictions read ``labels`` and ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.catalog import AXIS_MAX, AXIS_MIN, BAND_LIBRARY, Axis, inline_table
from spectraloom.operators.select import clean_clusters, keep_clusters, label_pixels
from spectraloom.schemas import SAMPLES as SAMPLES_SCHEMA
from spectraloom.schemas import SELECTION as SELECTION_SCHEMA

N_BANDS = 64
N_SAMPLES = 14
AXIS = Axis.linspace(AXIS_MIN, AXIS_MAX, N_BANDS)

# inline selections: fractional, out of range and negative entries included
SELECTION = {f"T{i}": [0, 1, 2, 3, 4.5, 5, 9, -1] if i % 2 == 0 else [1, 2, 4, 5, 6, 7, 7.9, 8] for i in range(N_SAMPLES)}
SAMPLES = [
    (f"T{i}", f"M{5 if i == 6 else 12 if i == 13 else i}", "A" if i < 7 else "B", i % 2) for i in range(N_SAMPLES)
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr(
        "concat('T', CAST(vec_id % 14 AS string)) AS sample_id",
        "if(vec_id DIV 14 % 2 = 0, 'RIGHT', 'LEFT') AS side",
        "CAST(vec_id DIV 25 AS int) AS row",
        "CAST(vec_id % 25 AS int) AS col",
        "CAST(embedding AS array<double>) AS spectrum",
    )


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr(
        "concat('T', CAST(vec_id % 14 AS string)) AS sample_id",
        "CAST(vec_id DIV 25 AS int) AS row",
        "CAST(vec_id % 25 AS int) AS col",
        "label AS cluster",
    )


def selection_raw(spark: SparkSession) -> DataFrame:
    rows = [(s, float(x)) for s, xs in SELECTION.items() for x in xs]
    return inline_table(spark, rows, SELECTION_SCHEMA)


def samples(spark: SparkSession) -> DataFrame:
    return inline_table(spark, SAMPLES, SAMPLES_SCHEMA)


def selected_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra in their sample's selected clusters, with the group attached."""
    chosen = clean_clusters(selection_raw(spark))
    pixels = keep_clusters(label_pixels(spectra(spark, sf_dir), clusters(spark, sf_dir)), chosen)
    return pixels.join(samples(spark), "sample_id")


def flim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lifetime-like pixels: one lineitem row is one pixel of a sample."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "if(l_orderkey % 2 = 0, 'A', 'B') AS grp",
        "concat('S_', CAST(l_suppkey AS string)) AS sample_id",
        "l_linenumber AS file_ord",
        "l_extendedprice AS a1",
        "l_quantity AS a2",
        "l_discount AS tm",
    )


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_type AS sample_id", "CAST(event_id DIV 100 AS int) AS row", "CAST(event_id % 100 AS int) AS col", "value AS v"
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled units with a score in (0, 1]; folds and samples follow from the id."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    y = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return d.join(y, "doc_id").select(
        F.col("doc_id").cast("string").alias("unit_id"),
        F.concat(F.lit("T"), (F.col("doc_id") % N_SAMPLES).cast("string")).alias("sample_id"),
        (F.col("doc_id") % 5).cast("int").alias("fold"),
        F.col("quality").cast("int").alias("y"),
        (F.col("n_chars") / (F.col("n_chars") + 600.0)).alias("prob"),
    )


def rounded(*names: str, digits: int = 6) -> list[Column]:
    """Result columns rounded for comparison; adding zero folds -0.0 into 0.0."""
    return [F.expr(f"round(`{n}`, {digits}) + 0D AS `{n}`") for n in names]


# ---- the same views as SQL --------------------------------------------------
def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else repr(x) for x in r) + ")" for r in rows)


_SEL_ROWS = [(s, float(x)) for s, xs in SELECTION.items() for x in xs]
VIEWS = {
    "spectra": """SELECT 'T' || (vec_id % 14) AS sample_id,
        CASE WHEN (vec_id // 14) % 2 = 0 THEN 'RIGHT' ELSE 'LEFT' END AS side,
        CAST(vec_id // 25 AS INT) AS row, CAST(vec_id % 25 AS INT) AS col,
        CAST(embedding AS DOUBLE[]) AS spectrum FROM embeddings""",
    "clusters": """SELECT 'T' || (vec_id % 14) AS sample_id, CAST(vec_id // 25 AS INT) AS row,
        CAST(vec_id % 25 AS INT) AS col, label AS cluster FROM embeddings""",
    "selection_raw": f"SELECT sample_id, CAST(raw AS DOUBLE) AS raw FROM (VALUES {_values(_SEL_ROWS)}) v(sample_id, raw)",
    "selection": """SELECT DISTINCT sample_id, CAST(trunc(raw) AS INT) AS cluster FROM selection_raw
        WHERE trunc(raw) BETWEEN 0 AND 7""",
    "samples": f"SELECT * FROM (VALUES {_values(SAMPLES)}) v(sample_id, animal_id, grp, batch)",
    "selected": """SELECT s.*, cluster, animal_id, grp, batch FROM spectra s JOIN clusters c USING (sample_id, row, col)
        JOIN selection USING (sample_id, cluster) JOIN samples USING (sample_id)""",
    "flim": """SELECT CASE WHEN l_orderkey % 2 = 0 THEN 'A' ELSE 'B' END AS grp, 'S_' || l_suppkey AS sample_id,
        l_linenumber AS file_ord, l_extendedprice AS a1, l_quantity AS a2, l_discount AS tm
        FROM lineitem""",
    "raster": """SELECT event_type AS sample_id, CAST(event_id // 100 AS INT) AS row,
        CAST(event_id % 100 AS INT) AS col, value AS v FROM events""",
    "predictions": """SELECT CAST(doc_id AS VARCHAR) AS unit_id, 'T' || (doc_id % 14) AS sample_id,
        CAST(doc_id % 5 AS INT) AS fold, quality AS y, n_chars / (n_chars + 600.0::DOUBLE) AS prob
        FROM documents JOIN labels USING (doc_id)""",
    "axis": "SELECT k, 960.0::DOUBLE + k * (840.0::DOUBLE / 63) AS wn FROM range(64) t(k)",
    "bandlib": f"""SELECT * FROM (VALUES {_values(BAND_LIBRARY)})
        v(band, center, halfwidth, category)""",
    "ratios": """SELECT * FROM (VALUES ('CH2/CH3', 'ch2', 'ch3'), ('AmideI/AmideII', 'amideI', 'amideII')) v(ratio, num_band, den_band)
        UNION ALL SELECT n.band || '/' || CASE d.band WHEN 'amideI' THEN 'AmideI' WHEN 'amideII' THEN 'AmideII' ELSE d.band END,
        n.band, d.band FROM bandlib n, bandlib d WHERE (n.category <> 'amide' AND d.category = 'amide')
        OR (n.category = 'phosphate' AND d.category IN ('carbohydrate', 'lipid'))""",
    # long form of the selected pixels
    "long": "SELECT sample_id, side, grp, row, col, cluster, unnest(range(64)) AS k, unnest(spectrum) AS v FROM selected",
    # nine band amplitudes per selected pixel after a floor shift to 0.5
    "bandpx": """SELECT sample_id, side, grp, animal_id, row, col, band,
        list_max(list_transform(list_filter(range(64), lambda i: abs(960.0::DOUBLE + i * (840.0::DOUBLE / 63) - center) <= halfwidth),
          lambda i: spectrum[i + 1])) - list_min(spectrum) AS value
        FROM selected, bandlib""",
    "thr": """SELECT sample_id, band, greatest(quantile_cont(value, 0.15), 1e-4) AS num_thr,
        greatest(quantile_cont(value, 0.03), 1e-2) AS den_thr FROM bandpx GROUP BY ALL""",
    "ratiopx": """SELECT * FROM (SELECT n.sample_id, n.side, n.grp, n.animal_id, n.row, n.col, ratio,
        greatest(0.0, least(n.value / (d.value + 1e-12), 10.0)) AS value
        FROM ratios JOIN bandpx n ON n.band = num_band
        JOIN bandpx d ON d.band = den_band AND d.sample_id = n.sample_id AND d.row = n.row AND d.col = n.col
        JOIN thr tn ON tn.sample_id = n.sample_id AND tn.band = num_band
        JOIN thr td ON td.sample_id = n.sample_id AND td.band = den_band
        WHERE n.value > tn.num_thr AND d.value > td.den_thr) WHERE value > 0""",
}
_NEEDS = {
    "selection": ["selection_raw"],
    "selected": ["spectra", "clusters", "selection", "samples"],
    "ratios": ["bandlib"],
    "long": ["selected"],
    "bandpx": ["selected", "bandlib"],
    "thr": ["bandpx"],
    "ratiopx": ["ratios", "bandpx", "thr"],
}


def sql(views: str, body: str, **extra: str) -> str:
    """A stand-alone statement: the named views (and what they need), then ``body``."""
    order: list[str] = []

    def visit(name: str) -> None:
        for need in _NEEDS.get(name, []):
            visit(need)
        if name not in order:
            order.append(name)

    for name in views.split():
        visit(name)
    parts = [f"{n} AS ({VIEWS[n]})" for n in order] + [f"{n} AS ({q})" for n, q in extra.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def r(expr: str, name: str, digits: int = 6) -> str:
    return f"round(({expr})::DOUBLE, {digits}) + 0.0 AS {name}"
