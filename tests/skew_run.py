"""Builds a fact over skewed tables with Spark's event log on, and prints the largest task's part of each big stage."""

import json
import sys
import tempfile
from collections import defaultdict
from pathlib import Path

from pyspark.sql import functions as F

from shipcause.operators.fact import build_fact
from shipcause.schemas import FACT_COLUMNS, SEQ, TABLE_SCHEMAS
from shipcause.session import local_session

N, PARTITIONS, BIG = 24_000, 16, 4000


def skewed(spark) -> dict:
    """A third of the orders has no id, a third of the others one client, a third of the log rows one order or warehouse."""
    ids = spark.range(N)
    own = {
        "raw_orders": {"order_id": F.when(F.col("id") % 3 != 0, F.col("id")), "client_id": F.when(F.col("id") % 2 == 0, F.lit(1)).otherwise(F.col("id"))},
        "raw_warehouse_logs": {"order_id": F.when(F.col("id") % 3 == 1, F.lit(7)).otherwise(F.col("id")), "warehouse_id": F.when(F.col("id") % 2 == 0, F.lit(3)).otherwise(F.col("id"))},
        "raw_fleet_logs": {"order_id": F.when(F.col("id") % 3 == 1, F.lit(7)).otherwise(F.col("id"))},
        "dim_clients": {"client_id": F.col("id"), "client_name": F.concat(F.lit("client "), "id")},
        "dim_warehouses": {"warehouse_id": F.col("id"), "warehouse_name": F.concat(F.lit("warehouse "), "id")},
    }
    out = {}
    for table, spec in TABLE_SCHEMAS.items():
        given = own.get(table, {"order_id": F.col("id")} if "order_id" in spec else {})
        columns = [given.get(c, F.lit(None)).cast(t).alias(c) for c, t in spec.items()]
        out[table] = ids.repartition(PARTITIONS).select(*columns, F.col("id").alias(SEQ))
    return out


def main(preset: str) -> None:
    logs, data = tempfile.mkdtemp(), tempfile.mkdtemp()
    spark = local_session(
        2, **{
            "spark.eventLog.enabled": "true", "spark.eventLog.dir": logs, "spark.eventLog.compress": "false", "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": str(PARTITIONS), "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.driver.memory": "2g",
            "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.skewJoin.enabled": "false",
        }
    )
    tables = {}
    for name, df in skewed(spark).items():
        df.write.parquet(f"{data}/{name}")
        tables[name] = spark.read.parquet(f"{data}/{name}")
    spark.sparkContext.setJobDescription("fact")
    fact = build_fact(tables, preset)
    fact = fact.select(*FACT_COLUMNS) if preset == "model" else fact
    named = F.count("client_name"), F.count("warehouse_name"), F.count_if(F.col("order_id").isNull())
    rows = fact.agg(F.count(F.lit(1)), *named).first()
    spark.stop()

    ours, read = set(), defaultdict(list)
    for path in Path(logs).rglob("*"):
        for line in path.read_text().splitlines() if path.is_file() and "events" in path.name else []:
            event = json.loads(line)
            if event["Event"] == "SparkListenerStageSubmitted" and (event.get("Properties") or {}).get("spark.job.description") == "fact":
                ours.add(event["Stage Info"]["Stage ID"])
            if event["Event"] == "SparkListenerTaskEnd" and event["Stage ID"] in ours:
                read[event["Stage ID"]].append(event["Task Metrics"]["Shuffle Read Metrics"]["Total Records Read"])
    stages = {s: round(max(tasks) / sum(tasks), 3) for s, tasks in read.items() if sum(tasks) >= BIG}
    print(json.dumps({"rows": list(rows), "stages": stages}))


if __name__ == "__main__":
    main(sys.argv[1])
