"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

import numpy as np
from pyspark.sql import SparkSession


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g")).config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from axolin import catalog, sources
    from axolin.operators import direct, product, reflectors, vector
    from axolin.plans import loop, precondition, solvers
    from axolin.plans.blocks import Chunks
    from axolin.types import Mat, Vec

    def done(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    n, wide, side, edge = 10_000_000, 3840, 1976, 255
    ramp = Vec(spark.range(n).selectExpr("id AS i", "id / 7.0D AS v"), n)

    def dense(m: int) -> Mat:
        cells = "explode(sequence(0L, %dL))" % (m - 1)
        return Mat(spark.range(m).selectExpr("id AS i", f"{cells} AS j").selectExpr("i", "j", "double((i * 7 + j * 3) % 11) AS v"), m, m)

    grid = sources.laplace_2d(spark, edge, edge)
    ones = sources.scalar_vector(spark, edge * edge, 1.0)
    tall = Mat(spark.range(100_000).selectExpr("id AS i", "explode(sequence(0L, 15L)) AS j").selectExpr("i", "j", "double((i * 31 + j * j * 7) % 101) AS v"), 100_000, 16)
    low = Mat(grid.df.where("j <= i AND i < 1024"), 1024, 1024)
    dense_low = Mat(spark.range(1500).selectExpr("id AS i", "explode(sequence(0L, id)) AS j").selectExpr("i", "j", "IF(i = j, 100.0, double((i * 7 + j * 3) % 11) / 100) AS v"), 1500, 1500)
    many = Mat(spark.range(1500).selectExpr("id AS i", "explode(sequence(0L, 152L)) AS j").selectExpr("i", "j", "double((i + j) % 7) AS v"), 1500, 153)

    def spmv_ten() -> None:
        a, x = Chunks(grid), np.ones(edge * edge)
        for _ in range(10):
            x = a.times(x) / 8
        a.release()

    def preconditioned():
        a = Mat(loop.checkpoint(grid.df), grid.m, grid.n)
        return solvers.bicgstab(a, ones, max_iterations=50, preconditioner=precondition.incomplete(a, "ilu0", 8))

    def toeplitz(size: int = 1_000_000) -> None:
        e = Vec(spark.range(2 * size - 1).selectExpr("id AS i", "double((id * 7) % 11) - 5 AS v"), 2 * size - 1)
        done(product.toeplitz(e, Vec(ramp.df.where(f"i < {size}"), size)).df)

    runs = {
        "copy_1e7": lambda: done(ramp.df.select("i", "v")),
        "axpy_1e7": lambda: done(vector.axpby(2.0, ramp.df, 1.0, ramp.df)),
        "dot_1e7": lambda: vector.dot(ramp.df, ramp.df).collect(),
        f"gemv_{wide}": lambda: done(product.gemv(dense(wide), Vec(ramp.df.where(f"i < {wide}"), wide)).df),
        f"gemm_blocked_{side}": lambda: done(product.gemm_blocks(product.blocked(dense(side), 247), product.blocked(dense(side), 247), 247)),
        "spmv_laplace": lambda: done(product.gemv(grid, ones).df),
        "spmv_laplace_x10": spmv_ten,
        "cg_laplace_100": lambda: solvers.cg(grid, ones, max_iterations=100),
        "bicgstab_laplace_50": lambda: solvers.bicgstab(grid, ones, max_iterations=50),
        "gmres_laplace_40": lambda: solvers.gmres(grid, ones, max_iterations=40),
        "jacobi_cg_laplace_50": lambda: solvers.cg(grid, ones, max_iterations=50, preconditioner=precondition.jacobi(grid)),
        "block_ilu_bicgstab_laplace_50": preconditioned,
        "trsv_1024": lambda: done(direct.trsv(low, sources.scalar_vector(spark, 1024, 1.0)).df),
        "trsm_1500x153": lambda: done(direct.trsm(dense_low, many).df),
        "qr_100000x16": lambda: direct.qr_r(tall),
        "qr_1800": lambda: reflectors.factor(dense(1800)),
        "toeplitz_1e6": toeplitz,
        **{name: (lambda q=name: done(catalog.Q[q](spark, sf_dir))) for name in ("flagship_norm_ax", "gemv_t", "spgemm", "gemm_tn", "scan_incl", "agg_norm2", "fft")},
    }
    took = {}
    for name, run in runs.items():
        began = time.time()
        try:
            run()
            took[name] = round(time.time() - began, 3)
        except Exception as e:  # one failed query must not hide the others
            print(f"{name}: {str(e)[:200]}", file=sys.stderr)
    found = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(found[1].rstrip(".")) if found else None}))


if __name__ == "__main__":
    main()
