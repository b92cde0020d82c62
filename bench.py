"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs to the end of its plan (no-op sink), nothing is collected.
"""

import json
import os
import sys
import time

os.environ.setdefault("PYTHONWARNINGS", "ignore")
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = """rate_map_stats tuning_map tuning_curve_stats egocentric_map dff minmax_norm speed_box linear_detrend binarize_runs fill_gaps
lowpass power_spectrum event_threshold click_velocity join_asof_velocity theta_index match_forward pearson_pairs overlap_pixels components
gauss_smooth coherence autocorrelogram border_score corr_zscore si_zscore nearest_centroid poisson_tuning bayes_decode cohort_totals""".split()


def main():
    from engram.plans.catalog import QUERIES
    from engram.session import local_session
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", " ".join(HEADLINE)).split()
    spark = local_session(cpus=cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    run = lambda n: QUERIES[n](spark, sf).write.format("noop").mode("overwrite").save()
    run("rate_map_stats")   # start the JVM and the file system caches
    times = {}
    for name in names:
        t0 = time.perf_counter()
        run(name)
        times[name] = round(time.perf_counter() - t0, 3)
    print(json.dumps({"metric": "engram_headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"), "cpus": cpus, "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
