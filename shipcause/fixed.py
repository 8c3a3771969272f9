"""Names, word lists and texts that answers must reproduce exactly."""

# ---- Fixed values: tables, files and date columns ---------------------------

TABLE_FILES = {
    "raw_orders": "orders.csv",
    "raw_fleet_logs": "fleet_logs.csv",
    "raw_warehouse_logs": "warehouse_logs.csv",
    "raw_external_factors": "external_factors.csv",
    "raw_feedback": "feedback.csv",
    "dim_warehouses": "warehouses.csv",
    "dim_clients": "clients.csv",
    "dim_drivers": "drivers.csv",
}

DATE_COLUMNS = {
    "raw_orders": ["order_date", "promised_delivery_date", "actual_delivery_date", "created_at"],
    "raw_fleet_logs": ["departure_time", "arrival_time", "created_at"],
    "raw_warehouse_logs": ["picking_start", "picking_end", "dispatch_time"],
    "raw_external_factors": ["recorded_at"],
    "raw_feedback": ["created_at"],
    "dim_warehouses": ["created_at"],
    "dim_clients": ["created_at"],
    "dim_drivers": ["created_at"],
}

# Texts that a CSV cell may hold to say "no value" (pandas' documented default list).
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# ---- Fixed values: cause vocabulary ------------------------------------------

TRAFFIC_SCORES = {"Heavy": 2, "Moderate": 1, "Clear": 0}

FEEDBACK_TAGS = {
    "late": "late_delivery",
    "delay": "late_delivery",
    "slow": "late_delivery",
    "address": "address_issue",
    "wrong address": "address_issue",
    "cancel": "cancellation",
    "stock": "stock_issue",
    "update": "poor_comm",
}

PICKING_MINUTES_LIMIT = 30
DISPATCH_LAG_MINUTES_LIMIT = 45
BAD_WEATHER = ["Rain", "Fog"]
LATE_AFTER_MICROS = 36_000_000  # 0.01 h
UNKNOWN_CAUSE = "unknown"
UNKNOWN_ACTION = "Inspect order logs for missing context."

MODEL_ACTIONS = {
    "stockout": "Tighten inventory checks; add backup stock and substitute rules.",
    "warehouse_delay": "Staff up or re-slot fast movers; monitor pick-pack SLA.",
    "dispatch_lag": "Tighter handoff SOP; create cut-off alerts.",
    "traffic": "Dynamic routing and slot re-allocation during congestion.",
    "weather": "Pre-alert customers, buffer ETAs, and prioritize essentials.",
    "event": "Create blackout/slowdown plans for strikes/holidays.",
    "address_issue": "Pre-ship address validation and driver assistance.",
    "vehicle_issue": "Maintain spare vehicles; enforce pre-trip checks.",
    "late_delivery": "Improve ETA promises; increase visibility with live tracking.",
    "poor_comm": "Automated status updates and proactive delay messaging.",
}
MODEL_DEFAULT_ACTION = "Investigate further."

DASHBOARD_ACTIONS = {
    "stockout": "Strengthen stock planning and keep substitute SKUs ready.",
    "warehouse_delay": "Increase pick-pack staffing and monitor warehouse SLA breaches.",
    "dispatch_lag": "Add dispatch cut-off alerts and improve handoff controls.",
    "traffic": "Use dynamic route changes and peak-hour slot management.",
    "weather": "Buffer ETAs and pre-alert customers during weather disruptions.",
    "event": "Create city-event contingency plans and temporary reroutes.",
    "address_issue": "Improve address validation and delivery confirmation workflows.",
    "vehicle_issue": "Run stronger preventive maintenance and pre-trip checks.",
    "late_delivery": "Tighten promise windows and escalate at-risk orders early.",
    "poor_comm": "Send proactive order status updates when delays are detected.",
}
DASHBOARD_DEFAULT_ACTION = "Investigate with additional context."

# ---- Fixed values: question templates -----------------------------------------

TITLES = {
    "city_delayed_date_range": "Why were deliveries delayed in city X for a selected date range?",
    "client_failures_past_week": "Why did Client X's orders fail in the past week?",
    "warehouse_august_reasons": "Explain the top reasons for delivery failures linked to Warehouse B in August?",
    "city_vs_city_last_month": "Compare delivery failure causes between City A and City B last month?",
    "festival_period_risks": "What are the likely causes of delivery failures during the festival period, and how should we prepare?",
    "client_onboarding_risk": "If we onboard Client Y with ~20,000 extra monthly orders, what new failure risks should we expect and how do we mitigate them?",
}
DEFAULT_TITLE = "Analysis"

EXPLANATIONS = {
    "city_delayed_date_range": "This answer filters orders in the selected city and date range, then ranks root causes by frequency.",
    "client_failures_past_week": "This answer focuses on one client over the last 7 days and highlights failure-related causes and impacted orders.",
    "warehouse_august_reasons": "This answer filters to August operations for the selected warehouse and reports the dominant cause buckets.",
    "city_vs_city_last_month": "This answer compares cause distributions across two cities for the previous full month.",
    "festival_period_risks": "This answer uses the festival month slice to estimate likely delay and failure drivers before peak season.",
    "client_onboarding_risk": "This answer uses current network late rate and cause mix as a baseline to estimate onboarding risk impact.",
}

COMPARE_RECOMMENDATIONS = [
    "Focus first on the top non-common cause between the two cities.",
    "Apply city-specific SLA controls where cause distribution diverges.",
]

ROUTE_REASONS = {
    "city_vs_city_last_month": "Detected city comparison intent for a monthly window.",
    "warehouse_august_reasons": "Detected warehouse root-cause summary intent.",
    "client_failures_past_week": "Detected client failure analysis intent over a recent period.",
    "festival_period_risks": "Detected seasonal or festival risk analysis intent.",
    "client_onboarding_risk": "Detected onboarding risk simulation intent.",
    "city_delayed_date_range": "Detected city-level delay analysis intent.",
}
FALLBACK_ROUTE = "city_delayed_date_range"
FALLBACK_REASON = "Mapped to closest supported template: city delay analysis."

WAREHOUSE_MONTH = "2025-08"
FESTIVAL_MONTH = "2025-10"
ONBOARDING_VOLUME = 20000

# ---- Fixed values: narrative texts ----------------------------------------------

NO_ORDERS_TEXT = "No orders matched the filter."
ONBOARDING_RISKS_TEXT = "Top network risks to mitigate before launch:"
ONBOARDING_PLAYBOOK = [
    "Operational playbook:",
    "- Stagger rollout by city/warehouse; start with top-performing lanes.",
    "- Holdback 5% capacity as surge buffer; pre-book extra vehicles.",
    "- Enforce address validation + customer contactability checks on day 1.",
]
