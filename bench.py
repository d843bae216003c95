"""Times the strategies; prints one JSON line.

Every figure is the median of three runs. Tables come from $BENCH_SF_DIR. Generated points are written to the checkpoint
folder first, so that reading them is part of a query and drawing them is not.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path
from statistics import median

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pareto_frame import STRATEGIES, skyline, skyline_by  # noqa: E402
from pareto_frame.session import scratch_path  # noqa: E402
from pareto_frame.sources.generate import generate_points  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
POINT_SETS = {
    "anti_4d_1e5": ("anti_correlated", 10**5, 4, 100.0),
    "anti_4d_1e6": ("anti_correlated", 10**6, 4, 100.0),
    "anti_4d_2e6": ("anti_correlated", 2 * 10**6, 4, 100.0),
    "independent_2d_1e5": ("independent", 10**5, 2, 10.0),
    "independent_3d_1e5": ("independent", 10**5, 3, 10.0),
    "independent_4d_1e5": ("independent", 10**5, 4, 10.0),
    "independent_5d_1e5": ("independent", 10**5, 5, 10.0),
    "independent_6d_1e5": ("independent", 10**5, 6, 10.0),
    "correlated_4d_1e6": ("correlated", 10**6, 4, 10.0),
    "anti_6d_1e6": ("anti_correlated", 10**6, 6, 100.0),
}


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # no stack trace for every Column: plans with hundreds of them are built in half the time
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    spark = session()
    line = spark.read.parquet(f"{FOLDER}/lineitem.parquet")
    orders = spark.read.parquet(f"{FOLDER}/orders.parquet")
    line_dims = ["l_extendedprice", -F.col("l_quantity"), -F.col("l_discount"), "l_tax"]
    sizes: dict[str, int] = {}
    seconds: dict[str, float] = {}

    def run(name, query):
        """The median of three runs."""
        taken = []
        for _ in range(3):
            begin = time.perf_counter()
            sizes[name] = len(query().collect())
            taken.append(time.perf_counter() - begin)
        seconds[name] = round(median(taken), 3)

    points = {}
    for name, (kind, n, dims, spread) in POINT_SETS.items():
        path = scratch_path(spark, name)
        generate_points(spark, n, kind, dims=dims, spread=spread).write.parquet(path)
        points[name] = spark.read.parquet(path)

    # starts the Python workers and compiles the common plans; not counted
    skyline(spark.read.parquet(f"{FOLDER}/part.parquet"), ["p_size", "p_retailprice"]).collect()

    for strategy in STRATEGIES:
        run(f"lineitem_4d_{strategy}", lambda s=strategy: skyline(line, line_dims, s))
    run("lineitem_3d_by_flag", lambda: skyline_by(line, ["l_returnflag"], line_dims[:3]))
    run(
        "lineitem_3d_by_flag_aggregate",
        lambda: skyline_by(line, ["l_returnflag"], line_dims[:3], "aggregate"),
    )
    order_dims = ["o_totalprice", "o_orderdate"]
    run("orders_2d_by_priority", lambda: skyline_by(orders, ["o_orderpriority"], order_dims))
    for name, df in points.items():
        dims = df.columns[1:]
        run(f"{name}_auto", lambda df=df, dims=dims: skyline(df, dims))
    # range slices and representatives on the anti-correlated sets
    for name in ("anti_4d_1e5", "anti_4d_1e6", "anti_4d_2e6"):
        for strategy in ("sfs_range", "representatives"):
            df = points[name]
            run(f"{name}_{strategy}", lambda df=df, s=strategy: skyline(df, df.columns[1:], s))
    df = points["anti_4d_1e5"]
    run("anti_4d_1e5_sql", lambda: skyline(df, df.columns[1:], "sql"))
    # more candidates than are broadcast: the merge by blocks
    run("anti_4d_1e5_blocks", lambda: skyline(df, df.columns[1:], broadcast_rows=2_000))
    wide = points["anti_6d_1e6"]
    run("anti_6d_1e6_window", lambda: skyline(wide, wide.columns[1:], "bnl", window=20_000))
    seeds, rows = points["anti_4d_1e5"], points["anti_4d_1e6"]
    run(
        "anti_4d_1e6_given_1e5",
        lambda: skyline(rows, rows.columns[1:], "representatives", given=seeds.select(*rows.columns[1:]), broadcast_rows=0),
    )
    print(
        json.dumps(
            {
                "metric": "total skyline query time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "rows": sizes,
                "sf": Path(FOLDER).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
