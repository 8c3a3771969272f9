"""The eight input tables, derived from the test tables; the same text serves Spark and DuckDB.

Only functions differ between the dialects. ``load_seq`` stands for the position of a row in its log.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

SOURCES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


@dataclass(frozen=True)
class Dialect:
    duckdb: bool

    def add(self, unit: str, n: str, t: str) -> str:
        if self.duckdb:
            return f"({t} + to_{unit}s(cast({n} as integer)))"
        return f"timestampadd({unit.upper()}, cast({n} as int), {t})"

    def hour(self, t: str) -> str:
        return f"date_trunc('hour', {t})" if self.duckdb else f"cast(date_trunc('hour', {t}) as timestamp_ntz)"

    def instant(self, text: str) -> str:
        return f"cast('{text}' as {'timestamp' if self.duckdb else 'timestamp_ntz'})"

    def seq(self, *columns: str) -> str:
        if len(columns) == 1:
            return f"{columns[0]} load_seq"
        if self.duckdb:
            return f"row({', '.join(columns)}) load_seq"
        return f"struct({', '.join(columns)}) load_seq"

    @property
    def text(self) -> str:
        return "varchar" if self.duckdb else "string"


SPARK, DUCKDB = Dialect(False), Dialect(True)


def table_texts(d: Dialect) -> dict[str, str]:
    """Table name -> SELECT over the test tables."""
    item_seq = d.seq("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return {
        "raw_orders": f"""
            select o_orderkey order_id, o_custkey client_id, c_name customer_name, n_name city, r_name state,
                case o_orderstatus when 'F' then 'Failed' when 'O' then 'Delivered' else 'In-Transit' end status,
                case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'COD' else 'Prepaid' end payment_mode,
                o_totalprice amount,
                case when o_orderstatus <> 'F' then null
                     when o_orderkey % 4 = 0 then 'Stockout' when o_orderkey % 4 = 1 then 'Incorrect address'
                     when o_orderkey % 4 = 2 then 'Traffic congestion' else 'Warehouse delay' end failure_reason,
                o_orderdate order_date, {d.add('day', '3', 'o_orderdate')} promised_delivery_date,
                case when o_orderstatus = 'P' then null
                     else {d.add('hour', '72 + o_orderkey * 7 % 49 - 36', 'o_orderdate')} end actual_delivery_date,
                o_orderdate created_at
            from orders join customer on c_custkey = o_custkey
                join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey""",
        "raw_warehouse_logs": f"""
            select l_orderkey order_id, l_suppkey warehouse_id, l_shipdate picking_start,
                case when l_partkey % 10 = 0 then null
                     else {d.add('minute', 'l_quantity', 'l_shipdate')} end picking_end,
                {d.add('minute', 'cast(l_quantity as int) + cast(round(l_discount * 1000) as int)', 'l_shipdate')} dispatch_time,
                case l_returnflag when 'R' then 'Slow packing' when 'A' then 'Stock delay on item' end notes,
                {item_seq}
            from lineitem""",
        "raw_fleet_logs": f"""
            select l_orderkey order_id, l_partkey driver_id, concat('V', cast(l_suppkey as {d.text})) vehicle_number,
                concat('R', cast(l_linenumber as {d.text})) route_code,
                case l_partkey % 5 when 0 then 'Heavy congestion' when 1 then 'Breakdown'
                     when 2 then 'Address not found' end gps_delay_notes,
                l_shipdate departure_time, {d.add('hour', '1 + round(l_tax * 100)', 'l_shipdate')} arrival_time,
                l_shipdate created_at, {item_seq}
            from lineitem""",
        "raw_external_factors": f"""
            select cast(floor(event_id / 3) as bigint) order_id, {d.seq('event_id')}, {d.hour('ts')} recorded_at,
                case event_type when 'error' then 'Heavy' when 'click' then 'Moderate' when 'view' then 'Clear'
                     when 'signup' then 'heavy' end traffic_condition,
                case user_id % 4 when 0 then 'Rain' when 1 then 'Fog' when 2 then 'Clear' end weather_condition,
                case user_id % 6 when 0 then 'Strike' when 1 then 'Holiday' when 2 then '' when 3 then '  ' end event_type
            from events""",
        "raw_feedback": f"""
            select cast(floor(event_id / 2) as bigint) order_id, {d.seq('event_id')},
                case when event_id % 11 = 0 then 'n/a' else cast(1 + event_id % 5 as {d.text}) end rating,
                case user_id % 4 when 0 then 'Negative' when 1 then 'Neutral' when 2 then 'Positive' end sentiment,
                case event_id % 8 when 0 then 'Delivery was LATE' when 1 then 'Wrong address on label'
                     when 2 then 'Order cancelled' when 3 then 'Out of stock' when 4 then 'No update received'
                     when 5 then 'slow service' when 6 then null else 'Great' end feedback_text,
                ts created_at
            from events""",
        "dim_warehouses": f"""
            select s_suppkey warehouse_id, concat('Warehouse ', cast(s_suppkey as {d.text})) warehouse_name,
                n_name city, r_name state, {d.instant('2020-01-01 00:00:00')} created_at
            from supplier join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey""",
        "dim_clients": f"""
            select c_custkey client_id, c_name client_name, {d.instant('2020-01-02 00:00:00')} created_at from customer""",
        "dim_drivers": f"""
            select p_partkey driver_id, concat('Driver ', cast(p_partkey as {d.text})) driver_name,
                {d.instant('2020-01-03 00:00:00')} created_at
            from part""",
    }


def load_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The eight tables as lazy frames over the Parquet files in ``folder``."""
    sources = {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in SOURCES}

    def braces(text: str) -> str:  # name the sources as arguments of the SQL text
        for name in SOURCES:
            text = text.replace(f"from {name}", f"from {{{name}}}").replace(f"join {name} ", f"join {{{name}}} ")
        return text

    out = {}
    for table, text in table_texts(SPARK).items():
        text = braces(text)
        used = {name: df for name, df in sources.items() if f"{{{name}}}" in text}
        out[table] = spark.sql(text, **used)
    return out
