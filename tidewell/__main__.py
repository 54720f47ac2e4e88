"""python -m tidewell build PAGES INDEX | search INDEX TEXT... | evaluate INDEX QUERIES"""

from __future__ import annotations

import sys
import time

from pyspark.sql import SparkSession

from .plans.engine import BuildMetrics, Engine
from .sources import corpus


def main(args: list[str]) -> int:
    if len(args) < 3 or args[0] not in ("build", "search", "evaluate"):
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("tidewell").getOrCreate()
    began = time.time()
    if args[0] == "build":
        metrics = BuildMetrics()
        Engine.build(corpus.scan_pages(spark, args[1]), order=("src_file",), metrics=metrics, folder=args[2])
        print(metrics.line())
    elif args[0] == "search":
        for text, pages in zip(args[2:], Engine.open(spark, args[1]).run(args[2:])):
            print(text, *pages, sep="\t")
    else:
        got = Engine.open(spark, args[1]).evaluate(corpus.scan_queries(spark, args[2])).first()
        print(f"{got['num_queries']} queries, mean NDCG@10 {got['mean_ndcg']:.6f}, {time.time() - began:.1f} s")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
