"""Cells per second of the main operators on generated square grids.

``python scale_bench.py FOLDER SIDE [SIDE ...]`` writes each grid once under FOLDER, as cells and as
blocks, and times the operators reading them. Prints one JSON line per grid.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ridgeline.model import Layout
from ridgeline.operators import blocks, focal, grid, local, regions, stats, surface
from ridgeline.plans import products, stored
from ridgeline.session import ship


def main() -> None:
    folder, sides = sys.argv[1], [int(s) for s in sys.argv[2:]]
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "64")
        .config("spark.driver.memory", "14g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    for side in sides:
        lay = Layout(3857, -8654000.0, 4710000.0, 10.0, 10.0, side, side, 256)
        cells_path, blocks_path = f"{folder}/cells-{side}", f"{folder}/blocks-{side}"
        if not os.path.exists(blocks_path):
            z = F.floor(900 + 60 * F.sin(F.col("row") / 37.0) + 40 * F.cos(F.col("col") / 23.0) + F.pmod(F.xxhash64("row", "col"), F.lit(9)))
            made = lay.grid(spark, "a").withColumn("value", z.cast("double")).where("(row * 13 + col * 29) % 11 <> 0")
            made.write.parquet(cells_path)
            blocks.to_blocks(spark.read.parquet(cells_path), lay).write.parquet(blocks_path)
        cells, block = spark.read.parquet(cells_path), spark.read.parquet(blocks_path)
        lonlat = grid.target_layout(lay, 4326)
        raised = lambda v: v + F.when(F.col("row") % 7 == 0, 5).otherwise(0)
        work = {
            "slope_blocks": lambda: stored.slope(block, lay),
            "square_stats_blocks": lambda: stored.square_stats(block, lay, 2),
            "disc_sum_blocks": lambda: stored.focal_sum(block, lay, 5.0),
            "suitability_blocks": lambda: stored.suitability(block, lay, 100.0, rings=((100, 60.0), (110, 40.0), (120, 20.0))),
            "difference_blocks": lambda: blocks.combine(block, block, lambda a, b: a - b),
            "slope_cells": lambda: surface.slope(cells, lay),
            "slope_cells_window": lambda: surface.slope(cells, lay, form="window"),
            "square_stats_cells": lambda: focal.square_stats(cells, lay, 2),
            "square_stats_cells_window": lambda: focal.square_stats(cells, lay, 2, form="window"),
            "suitability_cells": lambda: products.suitability(cells, lay, 100.0, rings=((100, 60.0), (110, 40.0), (120, 20.0))),
            "difference_cells": lambda: local.subtract(cells, local.local_map(cells, raised)),
            "reproject_cells": lambda: grid.resample(cells, lay, lonlat),
            "pyramid_cells": lambda: grid.pyramid(cells, 10, 0),
            "histogram_cells": lambda: stats.histogram(cells),
            "breaks_cells": lambda: stats.quantile_breaks(cells, 10),
            "regions_cells": lambda: regions.summary(regions.label_blocks(blocks.to_blocks(local.local_map(cells, lambda v: F.floor(v / 50)), lay), lay), lay),
        }
        chosen = os.environ.get("ONLY", ",".join(work)).split(",")
        seconds = {}
        for name in chosen:
            start = time.perf_counter()
            work[name]().write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 2)
            print(name, seconds[name], file=sys.stderr, flush=True)
        rate = {k: round(side * side / v / 1e6, 2) for k, v in seconds.items()}
        print(json.dumps({"cells": side * side, "seconds": seconds, "million_cells_per_second": rate}), flush=True)


if __name__ == "__main__":
    main()
