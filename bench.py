"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

HEADLINE = [
    "flagship_ratio_effects",
    "d4_guarded_ratios",
    "d6_ratio_overlay",
    "c3_background_subtraction",
    "c12_savgol_smoothing",
    "c18_gaussian_band_map",
    "b9_joint_outlier_trim",
    "e3_balance_classes",
    "f1_mean_spectrum",
    "f5_distribution_summary",
    "f7_animal_medians",
    "f8_lifetime_summary",
    "f10_box_table",
    "i3_mean_pixel_cosines",
    "i4_sampled_cosines",
    "j2_cliffs_delta",
    "j6_exact_preference",
    "j8_max_t_difference",
    "l1_grid_tiles",
    "m1_training_thresholds",
    "m14_auc_and_precision",
    "n1_mosaic_stitch",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    from spectraloom.plans.registry import QUERIES, load_all
    from spectraloom.session import build_session

    load_all()
    spark = build_session(cores, "bench")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()  # start the engine
    times = {}
    for name in HEADLINE:
        best = None
        for _ in range(2):  # the second run shows the warm time
            start = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.time() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cores": cores,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
