"""Compare named queries (all by default) with their SQL: python tests/check.py FOLDER [NAME ...]"""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from compare import compare, connect
from pyspark.sql import SparkSession

import __spark_entry__ as entry

folder, names = sys.argv[1], sys.argv[2:]
spark = (
    SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
    .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC")
    .config("spark.driver.memory", "8g").getOrCreate()
)
spark.sparkContext.setLogLevel("ERROR")
connection = connect(folder)
oracle, bad = entry.oracle_sql(), 0
for name, query in entry.queries().items():
    if names and name not in names:
        continue
    start = time.time()
    try:
        df = query(spark, folder)
        if name in oracle:
            found = compare(df, connection, oracle[name])
            n = f"{len(connection.execute(oracle[name]).fetchall())} rows"
        else:
            found, n = None, f"rows only: {df.count()}"
    except Exception as error:
        found, n = f"{type(error).__name__} {str(error)[:1500]}", ""
    bad += found is not None
    print(f"{'ok  ' if found is None else 'FAIL'} {name} {time.time() - start:.1f}s {n} {(found or '')[:1800]}", flush=True)
print("failed:", bad)
