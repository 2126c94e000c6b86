"""Command line: ``python -m cellweave info PATH`` and ``python -m cellweave convert SOURCE TARGET [--type T] [--epsg N]``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators import stats
from .sources import grids


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> list[str]:
    """Lines that are printed."""
    parser = argparse.ArgumentParser(prog="cellweave")
    commands = parser.add_subparsers(dest="command", required=True)
    info = commands.add_parser("info", help="metadata and statistics of a raster")
    info.add_argument("path")
    convert = commands.add_parser("convert", help="another format, cell type or projection tag")
    convert.add_argument("source")
    convert.add_argument("target")
    convert.add_argument("--type", help="cell type, such as float32")
    convert.add_argument("--epsg", type=int, help="projection that the result names")
    a = parser.parse_args(arguments)
    spark = spark or SparkSession.builder.appName("cellweave").getOrCreate()
    if a.command == "info":
        r = grids.read(spark, a.path)
        lines = [f"{k}: {v}" for k, v in (vars(r.meta) | {"type": r.dtype}).items()] + [f"{k}: {v}" for k, v in stats.info_summary(r).first().asDict().items()]
    else:
        r = grids.read(spark, a.source)
        grids.write(r if a.epsg is None else r.with_meta(projection=f"EPSG:{a.epsg}"), a.target, a.type)
        lines = [f"{a.target} written"]
    print("\n".join(lines))
    return lines


if __name__ == "__main__":
    main()
