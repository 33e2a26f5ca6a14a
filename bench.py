"""Headline timings: one warm-up, then the median of the repetitions; prints one JSON line.

Loading and staging the matrices is timed on its own, as the modes of a
product are compared without it. Results go to Spark's ``noop`` sink, so every
row is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from matrel.functions.sketch import HLL16
from matrel.operators import batches, csr, multiply as mul, profile, verify, windows
from matrel.plans import light
from matrel.session import local_session, release, stage
from matrel.sources.tables import Tables

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPETITIONS = int(os.environ.get("BENCH_REPS", "2"))


def consume(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = local_session(CPUS, os.environ.get("BENCH_MEMORY", "20g"), "bench")
    tables = Tables(spark, FOLDER)
    begin = time.perf_counter()
    part, supp, cust, blend, mix = (tables.matrix(x) for x in ("part", "supp", "cust", "blend", "mix"))
    seconds = {"load_matrices": round(time.perf_counter() - begin, 3)}
    no_broadcast = mul.Limits(broadcast_values=0)
    rows = stage(profile.row_features(mix).select("r", "products", "runs"))
    runs = {
        "spgemm_merge_part": lambda: mul.multiply(part, mode="merge"),
        "spgemm_merge_part_shuffled": lambda: mul.multiply(part, mode="merge", limits=no_broadcast),
        "spgemm_merge_supp": lambda: mul.multiply(supp, mode="merge"),
        "spgemm_dense_supp": lambda: mul.multiply(supp, mode="dense"),
        "spgemm_merge_blend": lambda: mul.multiply(blend, mode="merge"),
        "spgemm_adaptive_blend": lambda: mul.multiply(blend, mode="adaptive"),
        "spgemm_auto_cust": lambda: mul.multiply(cust),
        "spgemm_auto_supp": lambda: mul.multiply(supp),
        "spgemm_auto_blend": lambda: mul.multiply(blend),
        "spgemm_auto_part": lambda: mul.multiply(part),
        "row_features": lambda: profile.row_features(part),
        "row_routes_light": lambda: light.choose_routes(mix).routes,
        "hll16_estimate": lambda: profile.output_estimates(part.entries, part, HLL16),
        "window_work": lambda: windows.window_work(part, width=4096),
        "row_batches": lambda: batches.row_batches(rows, mix.n, {"products": 5_000_000, "runs": 60_000}, even=True),
        "csr_rowptr": lambda: csr.row_pointers(part.entries, part.n),
        "row_fingerprint": lambda: csr.fingerprints(part.entries),
        "verify_cust": lambda: verify.report(verify.verify(cust, mul.multiply(cust, mode="merge")), cust.n),
    }
    for name, build in runs.items():
        consume(build())
        times = []
        for _ in range(REPETITIONS):
            begin = time.perf_counter()
            consume(build())
            times.append(time.perf_counter() - begin)
        seconds[name] = round(statistics.median(times), 3)
    release(spark)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(os.path.normpath(FOLDER)).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
