"""Column specifications of the input tables and of the fact."""

from shipcause.fixed import DATE_COLUMNS, TABLE_FILES

# Column -> type after loading; columns outside the specification are carried along as they come.
TABLE_SCHEMAS = {
    "raw_orders": {
        "order_id": "bigint", "client_id": "bigint", "customer_name": "string", "city": "string",
        "state": "string", "status": "string", "payment_mode": "string", "amount": "double",
        "failure_reason": "string", "order_date": "timestamp_ntz",
        "promised_delivery_date": "timestamp_ntz", "actual_delivery_date": "timestamp_ntz",
        "created_at": "timestamp_ntz",
    },
    "raw_fleet_logs": {
        "order_id": "bigint", "driver_id": "bigint", "vehicle_number": "string", "route_code": "string",
        "gps_delay_notes": "string", "departure_time": "timestamp_ntz", "arrival_time": "timestamp_ntz",
        "created_at": "timestamp_ntz",
    },
    "raw_warehouse_logs": {
        "order_id": "bigint", "warehouse_id": "bigint", "picking_start": "timestamp_ntz",
        "picking_end": "timestamp_ntz", "dispatch_time": "timestamp_ntz", "notes": "string",
    },
    "raw_external_factors": {
        "order_id": "bigint", "traffic_condition": "string", "weather_condition": "string",
        "event_type": "string", "recorded_at": "timestamp_ntz",
    },
    "raw_feedback": {
        "order_id": "bigint", "rating": "string", "sentiment": "string", "feedback_text": "string",
        "created_at": "timestamp_ntz",
    },
    "dim_warehouses": {
        "warehouse_id": "bigint", "warehouse_name": "string", "city": "string", "state": "string",
        "created_at": "timestamp_ntz",
    },
    "dim_clients": {"client_id": "bigint", "client_name": "string", "created_at": "timestamp_ntz"},
    "dim_drivers": {"driver_id": "bigint", "created_at": "timestamp_ntz"},
}

TABLES = list(TABLE_FILES)

# The column that identifies a row, or that links a log row to its order.
TABLE_KEYS = {
    "raw_orders": "order_id",
    "raw_fleet_logs": "order_id",
    "raw_warehouse_logs": "order_id",
    "raw_external_factors": "order_id",
    "raw_feedback": "order_id",
    "dim_warehouses": "warehouse_id",
    "dim_clients": "client_id",
    "dim_drivers": "driver_id",
}

# Position of a log row in its source. Any orderable type; it settles "first" and breaks ties.
SEQ = "load_seq"

FACT_COLUMNS = [
    "order_id", "client_id", "client_name", "customer_name", "city", "state", "status", "payment_mode",
    "amount", "failure_reason", "order_date", "promised_delivery_date", "actual_delivery_date",
    "warehouse_id", "warehouse_name", "warehouse_city", "warehouse_state",
    "driver_id", "vehicle_number", "route_code", "gps_delay_notes", "warehouse_notes",
    "traffic_condition", "weather_condition", "event_type", "traffic_score",
    "feedback_rating_avg", "feedback_sentiment_top", "feedback_text_concat",
    "delay_hours", "is_late", "transit_hours", "picking_minutes", "dispatch_lag_minutes",
]

__all__ = ["DATE_COLUMNS", "FACT_COLUMNS", "SEQ", "TABLES", "TABLE_FILES", "TABLE_KEYS", "TABLE_SCHEMAS"]
