"""File scans on small files written by the tests."""

import json

import numpy as np
import pytest

from spectraloom.sources import cubes, rasters, sinks


def test_cube_scan(spark, tmp_path):
    short, full = np.arange(2 * 3 * 5, dtype="float32").reshape(2, 3, 5), np.ones((1, 2, 6))
    short[0, 1, :] = np.nan
    short[1, 2, 0] = np.nan
    np.savez_compressed(tmp_path / "masked_cube_T1.npz", data=short)
    np.savez(tmp_path / "masked_cube_T2.npz", data=full)
    out = {(r.sample_id, r.row, r.col): r.spectrum for r in cubes.scan_cubes(spark, str(tmp_path)).collect()}
    assert len(out) == 5 + 2 and ("T1", 0, 1) not in out
    assert out["T1", 1, 0] == [15.0, 16.0, 17.0, 18.0, 19.0] and np.isnan(out["T1", 1, 2][0])
    wanted = spark.createDataFrame([("T2",), ("T9",)], "sample_id string")
    assert {r.sample_id for r in cubes.scan_cubes(spark, str(tmp_path), wanted=wanted).collect()} == {"T2"}


@pytest.mark.parametrize("arrays, message", [({"other": np.ones((1, 1, 2))}, "no array named"), ({"data": np.ones((3, 2))}, "3-D")])
def test_bad_cubes_fail(spark, tmp_path, arrays, message):
    np.savez(tmp_path / "masked_cube_X.npz", **arrays)
    with pytest.raises(Exception, match=message):
        cubes.scan_cubes(spark, str(tmp_path)).collect()


def test_raw_cube_is_read_in_row_ranges(spark, tmp_path):
    cube = np.random.default_rng(0).normal(size=(7, 4, 3))
    np.save(tmp_path / "K1.npy", cube)
    rows = cubes.scan_raw_cubes(spark, str(tmp_path), rows_per_task=2).collect()
    assert len(rows) == 28 and all(np.allclose(r.spectrum, cube[r.row, r.col]) for r in rows)


def test_cluster_layouts(spark, tmp_path):
    at = np.array([[0, 1], [2, 3], [1, 0]])
    labels = np.array([4, 0, 7])
    for name, idx in (("a", at), ("b", at.T), ("c", at[:, 0] * 5 + at[:, 1])):
        idx = idx[:, :2] if name == "b" and idx.shape[1] == 2 else idx
        np.savez(tmp_path / f"{name}_umap_kmeans.npz", cluster_labels=labels, pixel_indices=idx)
    rows = cubes.scan_clusters(spark, str(tmp_path), (3, 5)).collect()
    for name in "ac":
        assert sorted((r.row, r.col, r.cluster) for r in rows if r.sample_id == name) == [(0, 1, 4), (1, 0, 7), (2, 3, 0)]
    with pytest.raises(Exception, match="out of bounds"):
        cubes.scan_clusters(spark, str(tmp_path), (2, 5)).collect()


def test_background_patterns_rank_and_first_vector(spark, tmp_path):
    np.savez(tmp_path / "bg_T1.npz", wn=np.ones(10), m=np.full(60, 2.0))
    np.savez(tmp_path / "bg_mean_spectrum_T1.npz", m=np.full(60, 3.0))
    np.savez(tmp_path / "bg_T2.npz", t=np.array(["x"] * 60), m=np.full(70, 5.0))
    patterns = ["bg_mean_spectrum_{sid}.npz", "bg_{sid}.npz"]
    out = {(r.sample_id, r.priority): r.spectrum for r in cubes.scan_backgrounds(spark, str(tmp_path), patterns).collect()}
    assert set(out) == {("T1", 1), ("T1", 2), ("T2", 2)} and out["T1", 1][0] == 3.0 and len(out["T2", 2]) == 70


def test_reference_spectrum(spark, tmp_path):
    (tmp_path / "ref.tsv").write_text("1.5\tx\n\ty\n2.5e-1\tz\n")
    rows = cubes.scan_reference(spark, str(tmp_path / "ref.tsv")).orderBy("k").collect()
    assert [(r.k, r.value) for r in rows] == [(0, 1.5), (1, None), (2, 0.25)]


def test_raster_scan_and_zip(spark, tmp_path):
    def write(folder, suffix, text):
        path = tmp_path / "wt" / "Sample1" / folder
        path.mkdir(parents=True, exist_ok=True)
        (path / f"f{suffix}").write_text("h\n" * 6 + text)

    for folder in ("S_10", "S_2", "S_x"):
        write(folder, "_740_a1.asc", "1 2\n3 nan\n")
        write(folder, "_740_a2.asc", "5 6\n7 8\n")
        write(folder, "_740_color coded value.asc", "9 9\n9 9\n" if folder != "S_10" else "9 9 9\n")
    ch = {c: rasters.scan_rasters(spark, str(tmp_path), s) for c, s in rasters.SUFFIXES.items()}
    a1 = ch["a1"].orderBy("file_ord", "pix").collect()
    assert [r.file_ord for r in a1] == [0] * 4 + [1] * 4 + [2] * 4
    assert [r.v for r in a1[:4]] == [1.0, 2.0, 3.0, None] and {r.sample_id for r in a1} == {"Sample1"}
    zipped = rasters.zip_rasters(ch, ["sample_id"]).collect()
    assert {r.file_ord for r in zipped} == {0, 2} and len(zipped) == 8


def test_raster_folders_without_a_number_do_not_collide(spark, tmp_path):
    for folder in ("S_x", "S_y"):
        path = tmp_path / "wt" / "Sample1" / folder
        path.mkdir(parents=True)
        for suffix in rasters.SUFFIXES.values():
            (path / f"f{suffix}").write_text("h\n" * 6 + "1 2 3\n")
    ch = {c: rasters.scan_rasters(spark, str(tmp_path), s) for c, s in rasters.SUFFIXES.items()}
    zipped = rasters.zip_rasters(ch, ["sample_id"]).collect()
    assert len(zipped) == 6 and {r.file_ord for r in zipped} == {0, 1}


def test_cluster_indices_in_narrow_integers(spark, tmp_path):
    at = np.array([[100, 7], [399, 1199]], dtype=np.uint16)
    np.savez(tmp_path / "a_umap_kmeans.npz", cluster_labels=np.array([1, 2], np.uint8), pixel_indices=at)
    np.savez(tmp_path / "b_umap_kmeans.npz", cluster_labels=np.array([1, 2, 3], np.uint8), pixel_indices=np.array([[1, 2], [3, 0], [0, 0]], np.uint8))
    rows = cubes.scan_clusters(spark, str(tmp_path), {"a": (400, 1200), "b": (4, 3)}).collect()
    assert sorted((r.sample_id, r.row, r.col, r.cluster) for r in rows) == [
        ("a", 100, 7, 1), ("a", 399, 1199, 2), ("b", 0, 0, 3), ("b", 1, 2, 1), ("b", 3, 0, 2),
    ]


def position(label, row, col, x, y, z=None):
    devices = [{"Device": {"scalar": "XYStage"}, "Position_um": {"array": [x, y]}}]
    if z is not None:
        devices.insert(0, {"Device": {"scalar": "ZStage"}, "Position_um": {"array": [z]}})
    return {
        "DefaultXYStage": {"scalar": "XYStage"}, "DefaultZStage": {"scalar": "ZStage"}, "DevicePositions": {"array": devices},
        "GridCol": {"scalar": col}, "GridRow": {"scalar": row}, "Label": {"scalar": label},
    }


def test_stage_positions(spark, tmp_path):
    doc = {"map": {"StagePositions": {"array": [position("p0", 0, 0, 1.0, 2.0, 3.0), position("p1", 0, 1, 4.0, 5.0)]}}}
    path = tmp_path / "stage.pos"
    path.write_text(json.dumps(doc, indent=2))
    rows = rasters.scan_positions(spark, str(path)).orderBy("idx").collect()
    assert [(r.idx, r.x, r.y, r.z, r.grid_row, r.grid_col, r.label) for r in rows] == [
        (0, 1.0, 2.0, 3.0, 0, 0, "p0"), (1, 4.0, 5.0, None, 0, 1, "p1"),
    ]
    assert rasters.scan_positions(spark, str(path), strict=True).count() == 1


def test_uniform_check(spark):
    from spectraloom.operators.aggregate import check_uniform

    one = spark.createDataFrame([("XY",), ("",), ("XY",)], "d string")
    assert check_uniform(one, "d", blank="").first().value == "XY"
    with pytest.raises(Exception, match="non-uniform"):
        check_uniform(one, "d").collect()


def test_table_sink_writes_missing_as_empty(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.5), ("b", None)], "unit_id string, prob double")
    sinks.write_table(df, str(tmp_path / "t"))
    text = "".join(p.read_text() for p in (tmp_path / "t").glob("*.csv"))
    assert "b,\n" in text
    assert sorted(map(tuple, sinks.read_table(spark, str(tmp_path / "t"), df.schema).collect())) == [("a", 0.5), ("b", None)]


def test_folders_are_listed_in_a_set_number_of_tasks(spark, tmp_path):
    """A listing by the driver starts a task, and sends its result, for every folder."""
    for i in range(40):
        (tmp_path / "wt" / f"S_{i}").mkdir(parents=True)
        (tmp_path / "wt" / f"S_{i}" / "a b%20.asc").write_text("h\n" * 6 + f"{i} {i}\n")
    (tmp_path / "wt" / "S_0" / "_b.asc").write_text("hidden")
    (tmp_path / "wt" / ".c").mkdir()
    (tmp_path / "wt" / ".c" / "d.asc").write_text("hidden")
    group = f"listing-{tmp_path}"
    spark.sparkContext.setJobGroup(group, "listing")
    rows = rasters.scan_rasters(spark, str(tmp_path), ".asc").orderBy("file_ord", "pix").collect()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [(r.file_ord, r.v) for r in rows] == [(i, float(i)) for i in range(40) for _ in range(2)]
    status = spark.sparkContext.statusTracker()
    stages = [status.getStageInfo(s) for j in status.getJobIdsForGroup(group) for s in status.getJobInfo(j).stageIds]
    assert stages and max(s.numTasks for s in stages if s) < 40
