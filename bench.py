"""Times the headline queries; prints one JSON line.

The reads are derived from the driver's tables once, before the clock of the queries starts; ``prepare`` is the
time that takes and is not part of ``value``.
"""

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from methylspark.plans.derive import prepare_reads
from methylspark.plans.queries import queries

NAMES = ["site_counts", "mbias_matrix", "dup_greedy", "best_strand_pe", "merge_cpgs", "merge_replicates", "moabs", "reduced_genome"]


def main() -> None:
    # Python workers find the package from whatever folder the bench is started in
    here = os.path.dirname(os.path.abspath(__file__))
    os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, (here, os.environ.get("PYTHONPATH", ""))))
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", str(2 * int(cpus)))
        .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    start = time.time()
    prepare_reads(spark, sf, os.path.join(tempfile.mkdtemp(prefix="spark-"), "reads"))
    prepare = round(time.time() - start, 3)
    took = {}
    for name in NAMES:
        start = time.time()
        queries()[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "prepare": prepare, "sf": sf}))


if __name__ == "__main__":
    main()
