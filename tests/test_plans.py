"""What the optimiser makes of the headline queries."""

import re

import pytest

from spectraloom.plans import fixtures
from spectraloom.plans.registry import QUERIES, load_all

load_all()
SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("name", ["b2_cluster_inclusion", "c6_min_floor_shift", "d8_lifetime_ratio", "f1_mean_spectrum", "j2_cliffs_delta", "b9_joint_outlier_trim"])
def test_no_python_worker_and_no_cartesian(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "ArrowEval" not in text and "InPandas" not in text and "BatchEvalPython" not in text
    assert "CartesianProduct" not in text


def test_scan_reads_only_the_needed_columns_and_pushes_filters(spark):
    text = plan(QUERIES["d8_lifetime_ratio"](spark, SF))
    schema = re.search(r"ReadSchema: struct<(.*?)>", text).group(1)
    assert "l_tax" not in schema and "l_shipdate" not in schema and "l_extendedprice" in schema
    text = plan(fixtures.flim(spark, SF).where("a2 > 10"))
    assert re.search(r"PushedFilters: \[.*GreaterThan\(l_quantity,10.0\)", text)


def test_partial_aggregation_precedes_the_shuffle(spark):
    text = plan(QUERIES["f1_mean_spectrum"](spark, SF))
    assert text.index("partial_avg") >= 0 and text.count("Exchange hashpartitioning") <= 4


def test_small_settled_sides_are_broadcast(spark):
    text = plan(QUERIES["b9_joint_outlier_trim"](spark, SF))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_top_patches_limit_runs_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(QUERIES["h1_top_patches"](spark, SF))


def test_bucketed_pixel_tables_join_without_a_shuffle(spark, tmp_path):
    from spectraloom.operators.select import label_pixels
    from spectraloom.plans import fixtures as X
    from spectraloom.sources.sinks import write_bucketed

    px = write_bucketed(X.spectra(spark, SF), "px_bucketed", str(tmp_path / "px"), 4)
    labels = write_bucketed(X.clusters(spark, SF), "labels_bucketed", str(tmp_path / "labels"), 4)
    text = plan(label_pixels(px.hint("merge"), labels))
    assert "SortMergeJoin" in text and "Exchange" not in text


def test_labels():
    from spectraloom.functions.text import safe_label

    assert safe_label("CH2 / CH3: *x*") == "CH2_over_CH3x"


def test_models_take_all_bands_and_folds(spark, monkeypatch):
    from spectraloom.catalog import BAND_LIBRARY
    from spectraloom.plans import q_classify as Q

    sf, bands = "/root/testdata/sf0.001", {b for b, *_ in BAND_LIBRARY}
    assert {c.rsplit("_", 1)[0] for c in Q.unit_table(spark, sf).columns if c not in ("unit_id", "label")} == bands
    asked = []
    fit = Q.M.standardiser
    monkeypatch.setattr(Q.M, "standardiser", lambda table, features: (asked.append(set(features)), fit(table, features))[1])
    assert Q.m12(spark, sf).columns and Q.h3(spark, sf).count() == 12
    assert len(asked) == 2 and all({f.rsplit("_", 1)[0] for f in fs} == bands for fs in asked)
    monkeypatch.setattr(Q.M, "fit_predict", lambda table, tests, *rest: tests)
    for query in (Q.m3, Q.m4):
        assert query(spark, sf).select("split_id").distinct().count() == 5
