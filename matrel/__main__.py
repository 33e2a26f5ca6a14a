"""Multiply a Matrix Market file by itself: plan, run the modes, verify, report.

    python -m matrel matrix.mtx --mode all --reps 3 --out results
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from matrel import report
from matrel.operators import multiply as mul
from matrel.operators import verify
from matrel.operators.coo import Matrix
from matrel.plans.light import LightOptions, choose_routes
from matrel.session import stage
from matrel.sources.matrix_market import read_matrix_market


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="matrel")
    parser.add_argument("matrix")
    parser.add_argument("--mode", default="all", help="all, auto, adaptive, merge or dense")
    parser.add_argument("--reps", type=int, default=1)
    parser.add_argument("--rows", type=int, nargs=2, default=(None, None), metavar=("BEGIN", "END"))
    parser.add_argument("--columns", type=int, nargs=2, default=(None, None), metavar=("BEGIN", "END"))
    parser.add_argument("--no-sampling", action="store_true")
    parser.add_argument("--calibrated", action="store_true", help="take the mode of the validated rule")
    parser.add_argument("--dry-run", action="store_true", help="print the plan only")
    parser.add_argument("--out", help="folder for the result CSV")
    parser.add_argument("--product", help="folder for the product as Parquet")
    return parser.parse_args(argv)


def run(spark: SparkSession, options: argparse.Namespace) -> int:
    """Exit code 0 when every mode verifies and all modes agree on the output size."""
    loaded = read_matrix_market(spark, options.matrix)
    matrix = Matrix(stage(loaded.entries), loaded.n)
    plan = choose_routes(matrix, options=LightOptions(enable_sampling=not options.no_sampling))
    plan.summary().show(truncate=False, vertical=True)
    if options.dry_run:
        return 0
    if options.mode == "all":
        modes = list(report.MODE_ORDER)
    else:
        mode = mul.resolve_mode(options.mode)
        modes = [plan.mode(options.calibrated) if mode == "auto" else mode]
    build = lambda mode: mul.multiply(
        matrix, mode=mode, rows=options.rows, columns=options.columns, routes=plan.routes)
    failures = 0
    for mode in modes:
        left = Matrix(matrix.entries.filter(mul.between("r", *options.rows)), matrix.n)
        right = Matrix(matrix.entries.filter(mul.between("c", *options.columns)), matrix.n)
        checked = verify.report(verify.verify(left, build(mode), right), matrix.n).first()
        print(mode, checked.asDict())
        failures += checked["mismatches"]
    results = report.time_modes(spark, options.matrix, {m: (lambda m=m: build(m)) for m in modes}, options.reps)
    results = stage(results)
    report.check_results(results, options.reps, modes)
    if "row_adaptive" in modes:
        report.compare_modes(results).show(truncate=False)
    if options.out:
        report.write_results(results, options.out)
    if options.product:
        report.write_product(build(modes[0]), options.product)
    return 1 if failures else 0


def main() -> None:
    spark = SparkSession.builder.appName("matrel").getOrCreate()
    raise SystemExit(run(spark, arguments()))


if __name__ == "__main__":
    main()
