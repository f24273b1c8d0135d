"""Scans of cube, label, background and reference-spectrum files (A1-A4)."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator, Mapping
from fnmatch import fnmatchcase
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.schemas import BACKGROUNDS, SPECTRA
from spectraloom.session import settle

# fixed values: file names and arrays of the published inputs
CUBE_FILES, CUBE_NAME, CUBE_ARRAY = "masked_cube_*.npz", r"masked_cube_(.+)\.npz$", "data"
LABEL_FILES, LABEL_NAME = "*_umap_kmeans.npz", r"([^/]+)_umap_kmeans\.npz$"
LABEL_ARRAY, INDEX_ARRAY = "cluster_labels", "pixel_indices"
BACKGROUND_FILES = [
    "bg_first300_mean_spectrum_{sid}.npz",
    "bg_first30_mean_spectrum_{sid}.npz",
    "bg_mean_spectrum_{sid}.npz",
    "bg_{sid}.npz",
]
BLOCK_VALUES = 4_000_000


def list_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """``(path, length)`` of the files below a folder whose names fit the pattern; hidden ones are left out.

    Folders are listed in tasks, a level of the tree at a time; neither paths nor a task for
    every folder reach the driver.
    """

    def look(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, inner = filesystem_of(path)
                head = path.removesuffix(inner) or "file:"
                info = fs.get_file_info(inner)
                found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(inner))
                found = [f for f in found if f.base_name[:1] != "." and (f.base_name[:1] != "_" or "=" in f.base_name)]
                found = [f for f in found if not f.is_file or fnmatchcase(f.base_name, pattern)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([head + f.path for f in found], pa.string()),
                        pa.array([f.size for f in found], pa.int64()),
                        pa.array([not f.is_file for f in found], pa.bool_()),
                    ],
                    names=["path", "length", "is_dir"],
                )

    folders, files = spark.range(1).select(F.lit(folder).alias("path")), None
    while files is None or folders.take(1):
        level = settle(spread(folders).mapInArrow(look, "path string, length bigint, is_dir boolean"), "listed")
        found = level.where("NOT is_dir").select("path", "length")
        files = found if files is None else files.unionByName(found)
        folders = level.where("is_dir").select("path")
    return files


def spread(files: DataFrame, *keys: str) -> DataFrame:
    """Paths are few bytes for much work, so their number of tasks is set, not left to adaptive merging."""
    return files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), *(keys or ["path"]))


def filesystem_of(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path inside it."""
    scheme, _, rest = path.partition(":")
    if not rest or "/" in scheme:
        return pafs.LocalFileSystem(), path
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pafs.FileSystem.from_uri(quote(path, safe="/:@?=&"))


def open_path(path: str):
    fs, inner = filesystem_of(path)
    return fs.open_input_file(inner)


def _array_header(stream) -> tuple[tuple[int, ...], bool, np.dtype]:
    version = np.lib.format.read_magic(stream)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    return read(stream)


def _row_blocks(stream, path: str) -> Iterator[tuple[int, np.ndarray]]:
    """Blocks of image rows of a 3-D array, so a cube larger than memory still streams."""
    shape, fortran, dtype = _array_header(stream)
    if len(shape) != 3:
        raise ValueError(f"{path}: expected a 3-D cube, found shape {shape}")
    if fortran:
        raise ValueError(f"{path}: expected row-major data")
    h, w, z = shape
    step = max(1, BLOCK_VALUES // max(w * z, 1))
    for start in range(0, h, step):
        rows = min(step, h - start)
        wanted = rows * w * z * dtype.itemsize
        chunks = bytearray()
        while len(chunks) < wanted:
            part = stream.read(wanted - len(chunks))
            if not part:
                raise ValueError(f"{path}: truncated")
            chunks += part
        yield start, np.frombuffer(bytes(chunks), dtype).reshape(rows, w, z).astype("float64")


def _pixels(sample: str, side: str, blocks: Iterator[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for start, block in blocks:
        rows, w, z = block.shape
        flat = block.reshape(-1, z)
        keep = ~np.isnan(flat).all(axis=1)
        if not keep.any():
            continue
        at = np.nonzero(keep)[0]
        values = flat[keep]
        n = len(at)
        spectrum = pa.ListArray.from_arrays(
            pa.array(np.arange(0, (n + 1) * z, z, dtype=np.int32)), pa.array(values.ravel())
        )
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([sample] * n), pa.array([side] * n),
                pa.array((start + at // w).astype(np.int32)), pa.array((at % w).astype(np.int32)), spectrum,
            ],
            names=["sample_id", "side", "row", "col", "spectrum"],
        )


def scan_cubes(
    spark: SparkSession, folder: str, side: str = "RIGHT", key: str = CUBE_ARRAY, wanted: DataFrame | None = None
) -> DataFrame:
    """A1: one row per pixel of every ``masked_cube_{sample}.npz``; fully masked pixels are dropped.

    One task per file streams blocks of image rows.  Samples without a file simply
    do not appear; a file without the key or with the wrong rank is an error.
    """
    files = list_files(spark, folder, CUBE_FILES).select(
        "path", F.regexp_extract("path", CUBE_NAME, 1).alias("sample_id")
    )
    if wanted is not None:
        files = files.join(wanted.select("sample_id"), "sample_id", "left_semi").select("path", "sample_id")

    def read(batches):
        for batch in batches:
            for path, sample in zip(batch.column("path").to_pylist(), batch.column("sample_id").to_pylist()):
                with open_path(path) as raw, zipfile.ZipFile(raw) as z:
                    if f"{key}.npy" not in z.namelist():
                        raise KeyError(f"{path}: no array named {key}")
                    with z.open(f"{key}.npy") as stream:
                        yield from _pixels(sample, side, _row_blocks(stream, path))

    return spread(files).mapInArrow(read, SPECTRA)


def scan_raw_cubes(spark: SparkSession, folder: str, side: str = "RIGHT", rows_per_task: int = 64) -> DataFrame:
    """A2: uncompressed ``.npy`` cubes, split into row ranges read by separate tasks."""
    files = list_files(spark, folder, "*.npy").select(
        "path", F.regexp_extract("path", r"([^/]+)\.npy$", 1).alias("sample_id")
    )

    def ranges(batches):
        for pdf in batches:
            for path, sample in zip(pdf.path, pdf.sample_id):
                with open_path(path) as raw:
                    shape, _, _ = _array_header(raw)
                    if len(shape) != 3:
                        raise ValueError(f"{path}: expected a 3-D cube, found shape {shape}")
                starts = np.arange(0, shape[0], rows_per_task)
                yield pd.DataFrame({"path": path, "sample_id": sample, "start": starts})

    parts = spread(spread(files).mapInPandas(ranges, "path string, sample_id string, start long"), "path", "start")

    def read(batches):
        for batch in batches:
            for path, sample, start in zip(*(batch.column(i).to_pylist() for i in range(3))):
                with open_path(path) as raw:
                    (h, w, z), fortran, dtype = _array_header(raw)
                    if fortran:
                        raise ValueError(f"{path}: expected row-major data")
                    rows = min(rows_per_task, h - start)
                    raw.seek(raw.tell() + start * w * z * dtype.itemsize)
                    data = np.frombuffer(raw.read(rows * w * z * dtype.itemsize), dtype)
                    block = data.reshape(rows, w, z).astype("float64")
                    yield from _pixels(sample, side, iter([(start, block)]))

    return parts.mapInArrow(read, SPECTRA)


def scan_reference(spark: SparkSession, path: str) -> DataFrame:
    """A2: first column of a tab-delimited reference spectrum as (k, value); blanks become NULL.

    A reference is one short file (one number per band), read whole to keep its order.
    """
    lines = spark.read.text(path, wholetext=True).select(
        F.posexplode(F.split(F.regexp_replace("value", r"\r?\n$", ""), r"\r?\n")).alias("k", "line")
    )
    return lines.select("k", F.split("line", "\t")[0].try_cast("double").alias("value"))


def checked_clusters(raw: DataFrame, width: int, height: int | None = None) -> DataFrame:
    """A3: labels with flat pixel indices to ``(sample_id, row, col, cluster)``.

    Negative, missing or out-of-range indices fail the job.
    """
    row = F.floor(F.col("flat") / width)
    bad = F.col("flat").isNull() | (F.col("flat") < 0) | F.col("cluster").isNull()
    if height is not None:
        bad = bad | (row >= height)
    safe = F.when(bad, F.raise_error(F.lit("pixel index out of bounds")).cast("bigint")).otherwise(F.col("flat"))
    return raw.withColumn("flat", safe).select(
        "sample_id",
        F.floor(F.col("flat") / width).cast("int").alias("row"),
        F.pmod("flat", F.lit(width)).cast("int").alias("col"),
        "cluster",
    )


def scan_clusters(
    spark: SparkSession, folder: str, shape: tuple[int, int] | Mapping[str, tuple[int, int]]
) -> DataFrame:
    """A3: ``{sample}_umap_kmeans.npz`` with indices as (n, 2), (2, n) or flat.

    ``shape`` is the image's (rows, columns), one for all or one per sample.
    """
    shapes = dict(shape) if isinstance(shape, Mapping) else None
    files = list_files(spark, folder, LABEL_FILES).select(
        "path", F.regexp_extract("path", LABEL_NAME, 1).alias("sample_id")
    )

    def read(batches):
        for pdf in batches:
            for path, sample in zip(pdf.path, pdf.sample_id):
                h, w = shapes[sample] if shapes is not None else shape
                with open_path(path) as raw, np.load(raw) as z:
                    labels, at = z[LABEL_ARRAY].ravel(), z[INDEX_ARRAY].astype(np.int64)
                    if at.ndim == 2 and at.shape == (len(labels), 2):
                        at = at[:, 0] * w + at[:, 1]
                    elif at.ndim == 2 and at.shape == (2, len(labels)):
                        at = at[0] * w + at[1]
                    if at.ndim != 1 or len(at) != len(labels):
                        raise ValueError(f"{path}: {len(labels)} labels but indices of shape {at.shape}")
                    if len(at) and (at.min() < 0 or at.max() >= h * w):
                        raise ValueError(f"{path}: pixel index out of bounds of {h} x {w}")
                    for i in range(0, len(labels), 100_000):
                        s = slice(i, i + 100_000)
                        yield pd.DataFrame({
                            "sample_id": sample, "row": (at[s] // w).astype(np.int32),
                            "col": (at[s] % w).astype(np.int32), "cluster": labels[s].astype(np.int32),
                        })

    return spread(files).mapInPandas(read, "sample_id string, row int, col int, cluster int")


def scan_backgrounds(spark: SparkSession, folder: str, patterns: list[str] = BACKGROUND_FILES) -> DataFrame:
    """A4: background vectors of each sample, numbered by file-name pattern.

    ``patterns`` hold ``{sid}``, best first.  Inside a file the first 1-D numeric
    vector with more than 50 points counts; a file without one is an error.
    """
    found = list_files(spark, folder, "*.npz").withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1))
    priority, sample = F.lit(None).cast("int"), F.lit(None).cast("string")
    for i, pattern in reversed(list(enumerate(patterns, start=1))):
        head, tail = pattern.split("{sid}")
        regex = "^" + head.replace(".", r"\.") + "(.+)" + tail.replace(".", r"\.") + "$"
        hit = F.col("name").rlike(regex)
        priority = F.when(hit, F.lit(i)).otherwise(priority)
        sample = F.when(hit, F.regexp_extract("name", regex, 1)).otherwise(sample)
    listed = found.select("path", sample.alias("sample_id"), priority.alias("priority")).where("priority IS NOT NULL")

    def read(batches):
        for pdf in batches:
            for path, sid, rank in zip(pdf.path, pdf.sample_id, pdf.priority):
                with open_path(path) as raw, np.load(raw) as z:
                    vectors = (z[k] for k in z.files)
                    usable = [v for v in vectors if v.ndim == 1 and v.size > 50 and np.issubdtype(v.dtype, np.number)]
                if not usable:
                    raise ValueError(f"{path}: no 1-D numeric vector")
                yield pd.DataFrame({"sample_id": [sid], "priority": [rank], "spectrum": [usable[0].astype("float64")]})

    return spread(listed).mapInPandas(read, BACKGROUNDS)
