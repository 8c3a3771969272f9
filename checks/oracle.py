"""The same questions in DuckDB SQL, written the plain way: window functions and unaggregated joins.

In particular the log grain is computed here by making the rows of the join.
"""

from __future__ import annotations

from checks.queries import (
    CITY,
    CITY_A,
    CITY_B,
    CLI_END,
    CLI_START,
    CLIENT_PATTERN,
    EMPTY_MONTH,
    END,
    FESTIVAL_MONTH,
    HARD_TEXT,
    START,
    WAREHOUSE,
    WAREHOUSE_MONTH,
    WAREHOUSE_PATTERN,
)
from shipcause.fixed import (
    DASHBOARD_ACTIONS,
    DASHBOARD_DEFAULT_ACTION,
    DATE_COLUMNS,
    EXPLANATIONS,
    MODEL_ACTIONS,
    NA_TOKENS,
    NO_ORDERS_TEXT,
    ONBOARDING_PLAYBOOK,
    ONBOARDING_RISKS_TEXT,
    ROUTE_REASONS,
    TABLE_FILES,
    FALLBACK_REASON,
    TITLES,
    UNKNOWN_ACTION,
)
from shipcause.schemas import FACT_COLUMNS, TABLE_KEYS, TABLE_SCHEMAS
from shipcause.testdata import DUCKDB, table_texts


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def rows_of(pairs: dict[str, str]) -> str:
    return ", ".join(f"({text(k)}, {text(v)})" for k, v in pairs.items())


def micros(a: str, b: str) -> str:
    return f"date_diff('microsecond', {a}, {b})"


def ctes(parts: dict[str, str]) -> str:
    return ",\n".join(f"{name} as ({sql})" for name, sql in parts.items())


MODEL_CAUSES = [
    "stockout", "warehouse_delay", "dispatch_lag", "address_issue", "vehicle_issue", "traffic", "weather", "event",
    "late_delivery", "poor_comm",
]
CLI_CAUSES = sorted(set(MODEL_CAUSES) | {"cancellation", "stock_issue"})

TABLES = table_texts(DUCKDB)

MODEL_SCORE = "case lower(traffic_condition) when 'heavy' then 2 when 'moderate' then 1 else 0 end"
CLI_SCORE = "case traffic_condition when 'Heavy' then 2 when 'Moderate' then 1 else 0 end"


def best_factor(score: str, nulls: str) -> str:
    return f"""
        select order_id, traffic_condition, weather_condition, event_type, {score} traffic_score
        from raw_external_factors
        qualify row_number() over (
            partition by order_id order by {score} desc, recorded_at asc nulls {nulls}, load_seq) = 1"""


def first_log(table: str) -> str:
    return f"select * from {table} qualify row_number() over (partition by order_id order by load_seq) = 1"


def fact_select(stock: str, fleet: str) -> str:
    late = f"{micros('o.promised_delivery_date', 'coalesce(o.actual_delivery_date, o.promised_delivery_date)')}"
    return f"""
        select o.order_id, o.client_id, c.client_name, o.customer_name, o.city, o.state, o.status, o.payment_mode,
            o.amount, o.failure_reason, o.order_date, o.promised_delivery_date, o.actual_delivery_date,
            wl.warehouse_id, w.warehouse_name, w.city warehouse_city, w.state warehouse_state,
            fl.driver_id, fl.vehicle_number, fl.route_code, fl.gps_delay_notes, wl.notes warehouse_notes,
            ex.traffic_condition, ex.weather_condition, ex.event_type, ex.traffic_score,
            fb.feedback_rating_avg, fb.feedback_sentiment_top, fb.feedback_text_concat,
            {late} / 3.6e9 delay_hours, case when {late} > 36000000 then 1 else 0 end is_late,
            {micros('fl.departure_time', 'fl.arrival_time')} / 3.6e9 transit_hours,
            {micros('wl.picking_start', 'wl.picking_end')} / 6e7 picking_minutes,
            {micros('wl.picking_end', 'wl.dispatch_time')} / 6e7 dispatch_lag_minutes
        from raw_orders o
            left join {stock} wl on wl.order_id = o.order_id
            left join {fleet} fl on fl.order_id = o.order_id
            left join ex on ex.order_id = o.order_id
            left join fb on fb.order_id = o.order_id
            left join dim_warehouses w on w.warehouse_id = wl.warehouse_id
            left join dim_clients c on c.client_id = o.client_id"""


def cause_case(blob: str, tags: bool) -> str:
    """One CASE over the cause name ``k.cause`` for a fact row."""
    tag = (lambda name: f" or list_contains(feedback_tags, '{name}')") if tags else (lambda name: "")
    event = "event_type <> ''" if tags else "trim(event_type) <> ''"
    poor = "false" if tags else f"{blob} like '%update%'"
    return f"""
        case k.cause
            when 'stockout' then {blob} like '%stock%'
            when 'warehouse_delay' then {blob} like '%slow%' or coalesce(picking_minutes > 30, false)
            when 'dispatch_lag' then dispatch_lag_minutes > 45
            when 'address_issue' then {blob} like '%address%'{tag('address_issue')}
            when 'vehicle_issue' then {blob} like '%breakdown%'
            when 'traffic' then {blob} like '%congestion%' or coalesce(traffic_score >= 1, false)
            when 'weather' then weather_condition in ('Rain', 'Fog')
            when 'event' then {event}
            when 'late_delivery' then is_late = 1{tag('late_delivery')}
            when 'poor_comm' then {poor}{tag('poor_comm')}
            when 'cancellation' then false{tag('cancellation')}
            when 'stock_issue' then false{tag('stock_issue')}
        end"""


MODEL_BLOB = "concat_ws(' ', lower(failure_reason), lower(gps_delay_notes), lower(warehouse_notes), feedback_text_concat)"
CLI_BLOB = "concat_ws(' ', lower(failure_reason), lower(gps_delay_notes), lower(notes))"


def cause_rows(fact: str, blob: str, causes: list[str], tags: bool) -> str:
    names = ", ".join(f"({text(c)})" for c in causes)
    return f"""
        select f.row_id, f.order_id, k.cause from {fact} f, (values {names}) k(cause)
        where coalesce({cause_case(blob, tags)}, false)"""


def with_unknown(fact: str, met: str) -> str:
    return f"""
        select row_id, order_id, cause from {met}
        union all
        select row_id, order_id, 'unknown' from {fact} where row_id not in (select row_id from {met})"""


def firsts(table: str, columns: list[str]) -> str:
    picks = ", ".join(f"first({c} order by load_seq) filter (where {c} is not null) {c}" for c in columns)
    return f"select order_id, {picks} from {table} group by order_id"


FEEDBACK_LABELS = {
    "late_delivery": ["late", "delay", "slow"], "address_issue": ["address"], "cancellation": ["cancel"],
    "stock_issue": ["stock"], "poor_comm": ["update"],
}


def feedback_tags() -> str:
    one = " union all ".join(
        f"select order_id, '{label}' tag from raw_feedback where "
        + " or ".join(f"lower(feedback_text) like '%{w}%'" for w in words)
        for label, words in FEEDBACK_LABELS.items()
    )
    return f"select order_id, list_sort(list(distinct tag)) feedback_tags from ({one}) group by order_id"


PARTS = {
    **TABLES,
    "ex": best_factor(MODEL_SCORE, "first"),
    "ex_cli": best_factor(CLI_SCORE, "last"),
    "fb": """
        select order_id, avg(coalesce(try_cast(rating as double), 0.0)) feedback_rating_avg,
            max(sentiment) feedback_sentiment_top,
            string_agg(lower(coalesce(feedback_text, '')), ' || ' order by load_seq) feedback_text_concat
        from raw_feedback group by order_id""",
    "wl1": first_log("raw_warehouse_logs"),
    "fl1": first_log("raw_fleet_logs"),
    "fact": f"select *, order_id row_id from ({fact_select('wl1', 'fl1')})",
    "met": cause_rows("fact", MODEL_BLOB, MODEL_CAUSES, False),
    "causes": with_unknown("fact", "met"),
    "log_fact": f"select *, row_number() over () row_id from ({fact_select('raw_warehouse_logs', 'raw_fleet_logs')})",
    "log_met": cause_rows("log_fact", MODEL_BLOB, MODEL_CAUSES, False),
    "log_causes": with_unknown("log_fact", "log_met"),
    "tags": feedback_tags(),
    "fb_cli": """
        select s.order_id, s.sentiment feedback_sentiment_top, r.feedback_rating_avg,
            coalesce(t.feedback_tags, []) feedback_tags
        from (
            select order_id, coalesce(sentiment, 'Unknown') sentiment from raw_feedback group by order_id, coalesce(sentiment, 'Unknown')
            qualify row_number() over (partition by order_id order by count(*) desc, min(load_seq)) = 1) s
        join (select order_id, avg(try_cast(rating as double)) feedback_rating_avg from raw_feedback group by 1) r
            on r.order_id = s.order_id
        left join tags t on t.order_id = s.order_id""",
    "wl_minutes": f"""
        select *, {micros('picking_start', 'picking_end')} / 6e7 picking_minutes,
            {micros('picking_end', 'dispatch_time')} / 6e7 dispatch_lag_minutes from raw_warehouse_logs""",
    "fl_hours": f"""
        select * exclude (driver_id, created_at), cast(driver_id as bigint) driver_id, created_at created_at_fleet,
            {micros('departure_time', 'arrival_time')} / 3.6e9 transit_hours from raw_fleet_logs""",
    "wl_cli": firsts(
        "wl_minutes",
        ["warehouse_id", "picking_start", "picking_end", "dispatch_time", "notes", "picking_minutes", "dispatch_lag_minutes"],
    ),
    "fl_cli": firsts(
        "fl_hours",
        ["driver_id", "vehicle_number", "route_code", "gps_delay_notes", "departure_time", "arrival_time",
         "created_at_fleet", "transit_hours"],
    ),
    "cli": f"""
        select o.*, c.client_name, wl.* exclude (order_id), w.warehouse_name, w.city warehouse_city,
            w.state warehouse_state, fl.* exclude (order_id), ex.* exclude (order_id), fb.* exclude (order_id),
            coalesce({micros('promised_delivery_date', 'actual_delivery_date')} / 3.6e9, 0.0) delay_hours,
            case when {micros('promised_delivery_date', 'actual_delivery_date')} > 36000000 then 1 else 0 end is_late,
            o.order_id row_id
        from raw_orders o
            left join wl_cli wl on wl.order_id = o.order_id
            left join fl_cli fl on fl.order_id = o.order_id
            left join ex_cli ex on ex.order_id = o.order_id
            left join fb_cli fb on fb.order_id = o.order_id
            left join dim_warehouses w on w.warehouse_id = wl.warehouse_id
            left join dim_clients c on c.client_id = o.client_id""",
    "cli_causes": cause_rows("cli", CLI_BLOB, CLI_CAUSES, True),
    "model_actions": f"select * from (values {rows_of(MODEL_ACTIONS)}) a(cause, action)",
    "dashboard_actions": f"select * from (values {rows_of(DASHBOARD_ACTIONS)}) a(cause, action)",
    "last_day": "select cast(max(order_date) as date) d from fact",
}


def found(table: str, column: str) -> str:
    """The type of a column after a CSV load."""
    if column in DATE_COLUMNS[table]:
        return "timestamp_ntz"
    return "bigint" if column in ("order_id", "client_id", "warehouse_id", "driver_id") else "string"


def needed(sql: str) -> dict[str, str]:
    """The parts that a text uses, directly or through other parts, in order."""
    import re

    wanted, todo = set(), [sql]
    while todo:
        words = set(re.findall(r"\w+", todo.pop()))
        for name in PARTS:
            if name in words and name not in wanted:
                wanted.add(name)
                todo.append(PARTS[name])
    return {name: part for name, part in PARTS.items() if name in wanted}


def oracle(sql: str, extra: dict[str, str] | None = None) -> str:
    extra = extra or {}
    body = " ".join([*extra.values(), sql])
    parts = {**needed(body), **extra}
    return f"with {ctes(parts)}\n{sql}" if parts else sql


# ---- building blocks ---------------------------------------------------------------


def kpi(where: str, source: str = "fact", by: str = "") -> str:
    return f"""
        select {by + ',' if by else ''} count(*) total_orders, round(coalesce(avg(is_late) * 100.0, 0.0), 6) late_rate,
            round(coalesce(avg(case when lower(coalesce(status, '')) = 'failed' then 1.0 else 0.0 end) * 100.0, 0.0), 6)
                failed_rate
        from {source} where {where} {'group by ' + by if by else ''}"""


def counted(where: str) -> str:
    return f"""
        select c.cause, count(*) cause_count from causes c join fact a on a.order_id = c.order_id
        where {where} group by c.cause"""


def top(where: str, k: int = 10) -> str:
    return f"select * from ({counted(where)}) order by cause_count desc, cause limit {k}"


def sample(where: str, k: int = 10) -> str:
    return f"""
        select order_id, city, client_name, warehouse_name, round(delay_hours, 2) delay_hours, status
        from (select * from fact where {where} order by delay_hours desc nulls last, order_id limit {k})"""


def recs(where: str) -> str:
    return f"""
        select t.cause, concat(t.cause, ': ', coalesce(a.action, {text(DASHBOARD_DEFAULT_ACTION)})) recommendation
        from ({top(where, 3)}) t left join dashboard_actions a on a.cause = t.cause"""


def days(start: str, end: str) -> str:
    return f"cast(order_date as date) between {start} and {end}"


CITY_SCOPE = f"{days(text(START), text(END))} and city = {text(CITY)}"
WEEK_SCOPE = days("(select d - 7 from last_day)", "(select d from last_day)")
T2_CLIENT = f"(select min(client_name) from fact where {WEEK_SCOPE} and lower(coalesce(status, '')) = 'failed')"
T2_SCOPE = f"{WEEK_SCOPE} and client_name = {T2_CLIENT}"
T3_SCOPE = f"strftime(order_date, '%Y-%m') = '{WAREHOUSE_MONTH}' and warehouse_name = {text(WAREHOUSE)}"
MONTH_START = "date_trunc('month', (select d from last_day) - interval 1 month)"
MONTH_END = "(date_trunc('month', (select d from last_day)) - interval 1 day)"
T4_SCOPE = f"{days(f'cast({MONTH_START} as date)', f'cast({MONTH_END} as date)')} and city in ('{CITY_A}', '{CITY_B}')"
T5_SCOPE = f"strftime(order_date, '%Y-%m') = '{FESTIVAL_MONTH}'"
EXPLORER = f"{days(text(START), text(END))} and city = '{CITY_A}' and warehouse_name = {text(WAREHOUSE)}"


def insight(scopes: dict[str, str] | None = None, by: str | None = None) -> dict[str, str]:
    """Parts ``insight``: one row per scope, from conditions by label or from an expression."""
    if scopes is None:
        scoped = f"select {by} scope, * from cli"
        asked = "select distinct scope from scoped"
    else:
        scoped = " union all ".join(f"select {text(s)} scope, * from cli where {w}" for s, w in scopes.items())
        asked = "select * from (values " + ", ".join(f"({text(s)})" for s in scopes) + ") v(scope)"
    return {
        "scoped": scoped,
        "asked": asked,
        "per_scope": """
            select scope, count(*) n, round_even(sum(is_late) / count(*) * 100, 2) late_rate from scoped group by scope""",
        "ranked": """
            select scope, cause, count(*) n, row_number() over (partition by scope order by count(*) desc, cause) rk
            from scoped join cli_causes using (order_id) group by scope, cause""",
        "best": """
            select scope, string_agg(concat(r.cause, '=', n), '; ' order by rk) top_causes,
                string_agg(concat('- ', r.cause, ': ', n), chr(10) order by rk) cause_lines,
                string_agg(concat('- ', r.cause, ': ', n, ' occurrences | ', coalesce(action, '')), chr(10) order by rk)
                    risk_lines,
                string_agg(concat(r.cause, ': ', action), '; ' order by rk) filter (where action is not null)
                    recommendations,
                string_agg(concat('- ', r.cause, ': ', action), chr(10) order by rk) filter (where action is not null)
                    advice_lines
            from ranked r left join model_actions a on a.cause = r.cause where rk <= 5 group by scope""",
        "entries": """
            select scope, scoped.order_id,
                row_number() over (partition by scope order by delay_hours desc nulls last, scoped.order_id, cause) rk
            from scoped left join cli_causes on cli_causes.order_id = scoped.order_id""",
        "worst": """
            select scope, string_agg(cast(order_id as varchar), '; ' order by rk) sample_orders,
                string_agg(cast(order_id as varchar), ', ' order by rk) id_list
            from entries where rk <= 5 group by scope""",
        "insight": """
            select asked.scope, coalesce(n, 0) orders_considered, coalesce(late_rate, 0.0) late_rate,
                coalesce(top_causes, '') top_causes, coalesce(recommendations, '') recommendations,
                coalesce(sample_orders, '') sample_orders, cause_lines, risk_lines, advice_lines, id_list
            from asked left join per_scope p on p.scope is not distinct from asked.scope
                left join best b on b.scope is not distinct from asked.scope
                left join worst w on w.scope is not distinct from asked.scope""",
    }


INSIGHT = "select scope, orders_considered, late_rate, top_causes, recommendations, sample_orders from insight"
RATE = "regexp_replace(regexp_replace(printf('%.2f', late_rate), '0$', ''), '\\.$', '.0')"
NARRATIVE = f"""
    case when orders_considered = 0 then {text(NO_ORDERS_TEXT)} else concat_ws(chr(10),
        concat('Scope: ', scope), concat('Orders analyzed: ', orders_considered),
        concat('Late/failed rate: ', {RATE}, '%'), 'Top causes:', cause_lines,
        case when advice_lines is not null then 'Recommendations:' end, advice_lines,
        concat('Sample impacted order_ids: [', id_list, ']')) end"""
ONBOARDING_TITLE = "Onboarding risk outlook for Client Y"
PROJECTED = "cast(floor(20000 * late_rate / 100) as bigint)"

CLI_CITY = f"lower(city) = lower('{CITY}')"
CLI_CLIENT = f"regexp_matches(client_name, {text(CLIENT_PATTERN)}, 'i')"
CLI_PERIOD = f"order_date >= timestamp '{CLI_START}' and order_date <= timestamp '{CLI_END}'"
CLI_WAREHOUSE = f"regexp_matches(warehouse_name, {text(WAREHOUSE_PATTERN)}, 'i') and {CLI_PERIOD}"
CLI_PEAK = "order_date >= timestamp '2001-10-01' and order_date <= timestamp '2001-10-31'"

DATE_TEXTS = """
    select order_id,
        case order_id % 7 when 0 then 'not a date' when 1 then strftime(order_date, '%Y-%m-%d %H:%M:%S') || '.987654'
            when 2 then strftime(order_date, '%Y-%m-%d') when 3 then strftime(order_date, '%Y-%m-%d') || 'T23:59:59'
            else strftime(order_date, '%Y-%m-%d %H:%M:%S') end order_date,
        case order_id % 5 when 0 then '32/13/2020' when 1 then null when 2 then 'NA'
            else strftime(order_date, '%Y-%m-%d %H:%M:%S') end created_at
    from raw_orders"""

NULL_KEYS = {
    "raw_orders": ("order_id", "case when order_id % 10 <> 3 then order_id end is null"),
    "raw_fleet_logs": ("order_id", "order_id is null"),
    "raw_warehouse_logs": ("order_id", "order_id is null"),
    "raw_external_factors": ("order_id", "order_id is null"),
    "raw_feedback": ("order_id", "case when load_seq % 4 <> 1 then order_id end is null"),
    "dim_warehouses": ("warehouse_id", "warehouse_id is null"),
    "dim_clients": ("client_id", "client_id is null"),
    "dim_drivers": ("driver_id", "driver_id is null"),
}

ORPHANS = [
    ("raw_orders", "client_id", "dim_clients"),
    ("raw_warehouse_logs", "order_id", "raw_orders"),
    ("raw_warehouse_logs", "warehouse_id", "dim_warehouses"),
    ("raw_fleet_logs", "order_id", "raw_orders"),
    ("raw_fleet_logs", "driver_id", "dim_drivers"),
    ("raw_external_factors", "order_id", "raw_orders"),
    ("raw_feedback", "order_id", "raw_orders"),
]


def orphan(table: str, key: str, target: str) -> str:
    def source(name: str) -> str:
        return "(select * from raw_orders where order_id % 5 <> 0)" if name == "raw_orders" else name

    return f"""
        select '{table}' table_name, '{key}' key_name, '{target}' target, count(distinct t.{key}) orphan_keys,
            count(*) orphan_rows
        from {source(table)} t where t.{key} is not null and t.{key} not in (select {key} from {source(target)})"""


def question() -> str:
    forms = [
        "'Compare failures of city ' || city || ' vs another city'",
        "'Compare delay causes between ' || city || ' and Chennai last month'",
        "'  EXPLAIN the reasons for WAREHOUSE problems in ' || city",
        "'warehouse near ' || city || ' in general'",
        "'Why did client ' || customer_name || ' fail'",
        "'client ' || customer_name || ' last WEEK'",
        "'client ' || customer_name || ' before the holiday'",
        "'What happens in peak season in ' || city || '?'",
        "'onboard ' || customer_name || ' please'",
        "'20,000 more orders of ' || customer_name",
        "'Why were deliveries delayed in city ' || city || ' yesterday?'",
        "'city ' || city || ' overview'",
    ]
    cases = " ".join(f"when {i} then {f}" for i, f in enumerate(forms))
    return f"select order_id, case order_id % 13 {cases} else 'Anything about ' || city end question from raw_orders"


def routes() -> str:
    def any_of(*words: str) -> str:
        return "regexp_matches(q, " + text("|".join(words)) + ")"

    order = [
        ("city_vs_city_last_month", f"{any_of('compare', 'vs')} and {any_of('city')}"),
        ("warehouse_august_reasons", f"{any_of('warehouse')} and {any_of('aug', 'month', 'reason')}"),
        ("client_failures_past_week", f"{any_of('client')} and {any_of('fail', 'week')}"),
        ("festival_period_risks", any_of("festival", "peak", "holiday")),
        ("client_onboarding_risk", any_of("onboard", "20,000", "risk")),
        ("city_delayed_date_range", f"{any_of('city')} and {any_of('yesterday', 'date range', 'delay')}"),
    ]
    ids = " ".join(f"when {c} then '{t}'" for t, c in order)
    reasons = " ".join(f"when {c} then {text(ROUTE_REASONS[t])}" for t, c in order)
    return f"""
        select order_id, question, case {ids} else 'city_delayed_date_range' end template_id,
            case {reasons} else {text(FALLBACK_REASON)} end reason
        from (select *, lower(trim(question)) q from ({question()}))"""


LOG_COUNTS = ", ".join(
    f"coalesce(sum(n) filter (where cause = '{c}'), 0)::bigint {c}_rows" for c in sorted([*MODEL_CAUSES, "unknown"])
)


#: Counts over the log grain, compared as text.
WIDE_COUNTS = {
    "fact_order_log_grain": ["fact_rows", *(f"{c}_rows" for c in sorted([*MODEL_CAUSES, "unknown"]))],
    "log_grain_kpis": ["total_orders"],
    "log_grain_causes": ["cause_count"],
    "log_grain_top_causes": ["cause_count"],
    "log_grain_warehouse_kpis": ["total_orders"],
    "top_causes": ["cause_count"],
}


def oracles() -> dict[str, str]:
    out: dict[str, str] = {}
    out["load_row_counts"] = oracle(
        " union all ".join(f"select '{t}' table_name, count(*) row_count from {t}" for t in TABLES)
    )
    tokens = ", ".join(text(t) for t in NA_TOKENS)
    out["na_tokens"] = oracle(f"""
        select event_id, order_id, case when event_type not in ({tokens}) then event_type end event_type from (
            select load_seq event_id, order_id, case load_seq % 9 when 0 then 'None' when 1 then 'N/A' when 2 then 'none'
                when 3 then ' NA' when 4 then '<NA>' else event_type end event_type from raw_external_factors)""")
    out["normalize_timestamps"] = oracle(f"""
        select order_id, date_trunc('second', try_cast(order_date as timestamp)) order_date,
            strftime(try_cast(created_at as timestamp), '%Y-%m-%d %H:%M:%S') created_text from ({DATE_TEXTS})""")
    out["epoch_ns_fallback"] = oracle("""
        select load_seq event_id,
            date_trunc('second', make_timestamp((1700000000123456789 + load_seq * 1000000007) // 1000)) created_at,
            case when load_seq % 100 = 0 then date_trunc('second', created_at) end recorded_at
        from raw_feedback""")
    actions = f"""
        coalesce(a.action, case when c.cause = 'unknown' then {text(UNKNOWN_ACTION)} else 'Investigate further.' end)"""
    causes = f"select order_id, c.cause, {actions} recommendation from causes c left join model_actions a on a.cause = c.cause"
    out["sink_roundtrip"] = oracle(causes)
    out["causes_model"] = oracle(causes)
    out["saved_model_months"] = oracle(
        kpi("true", "(select *, strftime(order_date, '%Y-%m') order_month from fact where year(order_date) = 1996)", "order_month")
    )
    out["sql_params"] = oracle(f"""
        select city, count(*) total_orders, round(sum(delay_hours), 6) delay_hours from fact
        where {days(text(START), text(END))} and city <> '{CITY}' group by city""")
    out["adhoc_city_report"] = oracle("""
        select city, count(*) total_orders, round(avg(is_late) * 100, 2) late_rate_pct from fact
        group by city order by late_rate_pct desc, city limit 10""")
    out["model_views"] = oracle("""
        select c.cause, count(*) cause_count, count(distinct c.order_id) n_orders,
            sum(ex.traffic_score)::bigint traffic_scores, round(sum(fb.feedback_rating_avg), 6) ratings,
            sum(length(fb.feedback_text_concat))::bigint chars
        from causes c left join ex on ex.order_id = c.order_id left join fb on fb.order_id = c.order_id group by c.cause""")
    out["model_stats"] = oracle("""
        select 'fact_order_analysis_rows' metric, count(*) "value" from fact
        union all select 'fact_order_causes_rows', count(*) from causes
        union all select 'unique_causes', count(distinct cause) from causes""")
    out["log_durations"] = oracle("""
        select coalesce(w.order_id, f.order_id) order_id, picking_minutes, dispatch_lag_minutes, transit_hours from (
            select order_id, round(sum(picking_minutes), 6) picking_minutes,
                round(sum(dispatch_lag_minutes), 6) dispatch_lag_minutes from wl_minutes group by order_id) w
        full join (select order_id, round(sum(transit_hours), 6) transit_hours from fl_hours group by order_id) f
            on f.order_id = w.order_id""")
    out["first_row_log"] = oracle("select order_id, warehouse_id, picking_end, notes from wl1")
    out["first_non_null_log"] = oracle("select order_id, warehouse_id, picking_end, notes from wl_cli")
    out["worst_factor_model"] = oracle("select * from ex")
    out["worst_factor_cli"] = oracle("select * from ex_cli")
    out["feedback_summary_model"] = oracle(
        "select * replace (round(feedback_rating_avg, 6) as feedback_rating_avg) from fb"
    )
    out["feedback_summary_cli"] = oracle("""
        select order_id, feedback_sentiment_top, round(feedback_rating_avg, 6) feedback_rating_avg,
            array_to_string(feedback_tags, '; ') feedback_tags from fb_cli""")
    out["fact_order"] = oracle(f"select {', '.join(FACT_COLUMNS)} from fact")
    out["fact_order_cli"] = oracle("""
        select * exclude (row_id, feedback_tags), array_to_string(feedback_tags, '; ') feedback_tags from cli""")
    out["fact_order_log_grain"] = oracle(f"""
        select f.*, c.* exclude (order_id) from (
            select order_id, client_name, city, status, order_date, is_late, delay_hours,
                round(feedback_rating_avg, 6) feedback_rating_avg, count(*) fact_rows,
                (select greatest(count(*), 1) from raw_warehouse_logs w where w.order_id = log_fact.order_id) warehouse_rows,
                (select greatest(count(*), 1) from raw_fleet_logs l where l.order_id = log_fact.order_id) fleet_rows
            from log_fact group by all) f
        join (select order_id, {LOG_COUNTS} from (
            select order_id, cause, count(*) n from log_causes group by all) group by order_id) c
        on c.order_id = f.order_id""")
    out["log_grain_kpis"] = oracle(kpi("true", "log_fact", "city"))
    out["log_grain_causes"] = oracle("select cause, count(*) cause_count from log_causes group by cause")
    # Here only the product is counted, not joined: k fact rows x k cause sets per order.
    out["log_grain_top_causes"] = oracle("""
        select cause, sum(n * k)::bigint cause_count from (
            select order_id, cause, count(*) n from log_causes group by all) c
        join (select order_id, count(*) k from log_fact group by order_id) f on f.order_id = c.order_id
        group by cause order by cause_count desc, cause limit 10""")
    out["log_grain_warehouse_kpis"] = oracle(kpi("true", "log_fact", "warehouse_name"))
    out["causes_cli"] = oracle("""
        select cli.order_id, c.cause, case when c.cause is not null then coalesce(a.action, 'Investigate further.') end
            recommendation
        from cli left join cli_causes c on c.order_id = cli.order_id left join model_actions a on a.cause = c.cause""")
    out["cause_summary"] = oracle("select cause, count(*) cause_count from causes group by cause")
    out["recommendations_distinct"] = oracle(f"select distinct cause, recommendation from ({causes}) where cause <> 'unknown'")
    out["kpi_scope"] = oracle(kpi(CITY_SCOPE))
    out["top_causes"] = oracle(top(CITY_SCOPE))
    out["samples_scope"] = oracle(sample(CITY_SCOPE))
    kept = {
        "city": CLI_CITY, "client": CLI_CLIENT, "warehouse and month": CLI_WAREHOUSE,
        "city and start": "lower(city) = 'nation_11' and order_date >= timestamp '2000-01-01'",
    }
    out["filter_orders_cli"] = oracle(" union all ".join(
        f"select order_id, city, client_name, warehouse_name, '{k}' kept_by from cli where {w}" for k, w in kept.items()
    ))
    for name, column in [("city", "city"), ("client", "client_name"), ("warehouse", "warehouse_name")]:
        out[f"filter_options_{name}"] = oracle(f"select distinct {column} from fact where {column} is not null")
    ends = {
        "dim_warehouses": ("created_at", "created_at"), "dim_clients": ("created_at", "created_at"),
        "dim_drivers": ("created_at", "created_at"),
        "raw_orders": ("order_date", "coalesce(actual_delivery_date, promised_delivery_date)"),
        "raw_fleet_logs": ("departure_time", "arrival_time"), "raw_warehouse_logs": ("picking_start", "dispatch_time"),
        "raw_external_factors": ("recorded_at", "recorded_at"), "raw_feedback": ("created_at", "created_at"),
    }
    each = " union all ".join(f"select min({a}) a, max({b}) b from {t}" for t, (a, b) in ends.items())
    out["date_ranges"] = oracle(f"""
        select (select strftime(min(order_date), '%Y-%m-%d') from fact) order_min_date,
            (select strftime(max(coalesce(actual_delivery_date, promised_delivery_date)), '%Y-%m-%d') from fact) order_max_date,
            strftime(min(a), '%Y-%m-%d') dataset_min_date, strftime(max(b), '%Y-%m-%d') dataset_max_date from ({each})""")
    out["dynamic_filter"] = oracle(f"""
        select order_id, city, client_name, warehouse_name, strftime(order_date, '%Y-%m-%d %H:%M:%S') order_date from fact
        where {days(text(START), text(END))} and warehouse_name = {text(WAREHOUSE)}""")
    out["dynamic_filter_kpis"] = oracle(kpi(EXPLORER))
    out["dynamic_filter_causes"] = oracle(top(EXPLORER))
    out["dynamic_filter_samples"] = oracle(sample(EXPLORER, 20))

    failed = "lower(coalesce(status, '')) = 'failed'"
    for t, scope, cause_scope in [
        ("t1", CITY_SCOPE, CITY_SCOPE), ("t2", T2_SCOPE, f"{T2_SCOPE} and {failed}"), ("t3", T3_SCOPE, T3_SCOPE),
        ("t5", T5_SCOPE, T5_SCOPE),
    ]:
        out[f"{t}_kpis"] = oracle(kpi(scope))
        out[f"{t}_causes"] = oracle(top(cause_scope))
        out[f"{t}_samples"] = oracle(sample(scope))
        out[f"{t}_recs"] = oracle(recs(cause_scope))
    t2, t4 = "client_failures_past_week", "city_vs_city_last_month"
    out["t2_header"] = oracle(f"""
        select {text(TITLES[t2])} title, {text(EXPLANATIONS[t2])} explanation,
            concat('Client=', {T2_CLIENT}, ', Period=', strftime(d - 7, '%Y-%m-%d'), ' to ', strftime(d, '%Y-%m-%d'),
                ', Failed orders only') scope from last_day""")
    out["t4_header"] = oracle(f"""
        select {text(TITLES[t4])} title, {text(EXPLANATIONS[t4])} explanation,
            concat('Cities={CITY_A} vs {CITY_B}, Period=', strftime({MONTH_START}, '%Y-%m-%d'), ' to ',
                strftime({MONTH_END}, '%Y-%m-%d')) scope""")
    out["t4_kpis"] = oracle(f"""
        select count(*) filter (where city = '{CITY_A}') city_a_orders, count(*) filter (where city = '{CITY_B}') city_b_orders
        from fact where {T4_SCOPE}""")
    out["t4_city_compare"] = oracle(f"""
        select city, c.cause, count(*) cause_count from causes c join fact a on a.order_id = c.order_id
        where {T4_SCOPE} group by city, c.cause""")
    out["t5_empty_month_kpis"] = oracle(kpi(f"strftime(order_date, '%Y-%m') = '{EMPTY_MONTH}'"))
    out["t6_kpis"] = oracle(f"""
        select k.*, (select cast(floor(20000 * avg(is_late) * 100.0 / 100.0) as bigint) from fact) projected_delayed_orders
        from ({kpi('true')}) k""")
    out["t6_causes"] = oracle(top("true", 5))
    out["t6_recs"] = oracle(recs("true"))
    out["question_routing"] = oracle(routes())

    period = f"order_date >= timestamp '{START}' and order_date <= timestamp '{END}'"
    out["insight_city"] = oracle(INSIGHT, insight({"City": CLI_CITY}))
    out["insight_client"] = oracle(INSIGHT, insight({"Client": CLI_CLIENT}))
    out["insight_warehouse"] = oracle(INSIGHT, insight({"Warehouse": CLI_WAREHOUSE}))
    out["insight_peak"] = oracle(
        f"select scope, orders_considered, late_rate, top_causes, recommendations, sample_orders, {NARRATIVE} narrative from insight",
        insight({"Peak": CLI_PEAK}),
    )
    out["compare_cities_cli"] = oracle(
        INSIGHT, insight({c: f"lower(city) = lower('{c}') and {period}" for c in (CITY_A, CITY_B)})
    )
    out["narrative"] = oracle(f"select scope, {NARRATIVE} narrative from insight", insight({"City": CLI_CITY}))
    playbook = ", ".join(text(x) for x in ONBOARDING_PLAYBOOK)
    out["onboarding_cli"] = oracle(
        f"""
        select scope, orders_considered, late_rate, top_causes, recommendations, sample_orders,
            {PROJECTED} projected_delayed_orders,
            concat_ws(chr(10), scope, concat('Baseline late rate: ', {RATE},
                '% | projected delayed orders per month: ~', {PROJECTED}), {text(ONBOARDING_RISKS_TEXT)}, risk_lines,
                {playbook}) narrative
        from insight""",
        insight({ONBOARDING_TITLE: "true"}),
    )
    in_month = f"and {CLI_PERIOD}"
    out["answer_all"] = oracle(
        f"""
        select scope, orders_considered, late_rate, top_causes, recommendations, sample_orders,
            case when scope = '{ONBOARDING_TITLE}' then {PROJECTED} end projected_delayed_orders from insight""",
        insight({
            f"City {CITY}": CLI_CITY,
            f"Client {CLIENT_PATTERN}": CLI_CLIENT,
            f"Warehouse {WAREHOUSE_PATTERN} {CLI_START} to {CLI_END}": CLI_WAREHOUSE,
            f"Compare {CITY_A}": f"lower(city) = lower('{CITY_A}') {in_month}",
            f"Compare {CITY_B}": f"lower(city) = lower('{CITY_B}') {in_month}",
            "Peak 2001-10-01 to 2001-10-31": CLI_PEAK,
            ONBOARDING_TITLE: "true",
        }),
    )
    for name, column in [("city", "city"), ("client", "client_name"), ("warehouse", "warehouse_name")]:
        out[f"insights_by_{name}"] = oracle(INSIGHT.replace("scope,", f"scope {column},", 1), insight(by=column))
    sets = insight(by="city")
    sets["scoped"] = " union all ".join(
        f"select {{'dimension': '{d}', 'value': cast({v} as varchar)}} scope, * from cli"
        for d, v in [("city", "city"), ("client_name", "client_name"), ("warehouse_name", "warehouse_name"), ("network", "null")]
    )
    out["insights_grouping_sets"] = oracle(
        INSIGHT.replace("scope,", "scope.dimension, scope.value,", 1), sets
    )
    out["dq_null_keys"] = oracle(" union all ".join(
        f"select '{t}' table_name, '{k}' key_name, count(*) filter (where {c}) null_keys from {t}"
        for t, (k, c) in NULL_KEYS.items()
    ))
    out["dq_duplicate_orders"] = oracle(
        "select order_id, count(*) n_rows from raw_fleet_logs group by order_id having count(*) > 1"
    )
    out["dq_invalid_dates"] = oracle(" union all ".join(
        f"""select 'raw_orders' table_name, '{c}' column_name, count(*) filter (
            where {c} is not null and {c} not in ({tokens}) and try_cast({c} as timestamp) is null) invalid_dates
        from ({DATE_TEXTS})"""
        for c in ("order_date", "created_at")
    ))
    out["dq_orphan_keys"] = oracle(" union all ".join(orphan(*r) for r in ORPHANS))
    out["feedback_text_rows"] = oracle(
        "select order_id, load_seq \"position\", lower(coalesce(feedback_text, '')) piece from raw_feedback where order_id is not null"
    )
    out["causes_from_saved_fact"] = oracle(causes)
    out["csv_compact_dates"] = oracle("""
        select order_id, date_trunc('day', order_date) order_date, date_trunc('minute', promised_delivery_date) promised_delivery_date
        from raw_orders""")
    out["csv_line_breaks"] = oracle(f"select load_seq event_id, {HARD_TEXT} feedback_text, order_id from raw_feedback")
    out["csv_rejects"] = oracle("""
        select order_id, case order_id % 50 when 3 then 'surplus cells' when 4 then 'missing cells' else 'loaded' end reason,
            case order_id % 50 when 3 then 5 when 4 then 2 else 3 end cells
        from raw_orders""")
    text_id = "case order_id % 100 when 7 then concat('ORD-', order_id) when 8 then concat('00', order_id) else cast(order_id as varchar) end"
    out["csv_text_ids"] = oracle(f"""
        select {text_id} order_id, client_id, 'string' order_id_type, 'bigint' client_id_type, n_feedback
        from raw_orders left join (select order_id, count(*) n_feedback from raw_feedback group by order_id) using (order_id)""")
    out["csv_first_values"] = out["first_non_null_log"]
    out["csv_dated_tables"] = oracle(" union all ".join(
        f"select '{t}' table_name, {TABLE_KEYS[t]} as key, '{c}' column_name, strftime({c}, '%Y-%m-%d %H:%M:%S') as value from {t}"
        for t, columns in DATE_COLUMNS.items() for c in columns
    ))
    # a CSV cell that is empty or says 'n/a' has no value
    loaded = out["fact_order"].replace("coalesce(try_cast(rating as double), 0.0)", "try_cast(rating as double)")
    out["refresh_roundtrip"] = f"select * replace (nullif(event_type, '') as event_type) from ({loaded})"
    out["source_presence"] = "select * from (values " + ", ".join(
        f"('{t}', '{f}', {'false' if t == 'dim_clients' else 'true'})" for t, f in TABLE_FILES.items()
    ) + ") s(table_name, file_name, present)"
    out["dq_schema"] = oracle("select t.* replace (case when column_name = 'amount' then (select count(*) from raw_orders where order_id % 20 = 3) else rejected end as rejected) from (values " + ", ".join(
        f"('{t}', '{c}', '{declared}', {text(found(t, c))}, cast(0 as bigint))" for t, spec in TABLE_SCHEMAS.items() for c, declared in spec.items()
    ) + ") t(table_name, column_name, declared, found, rejected)")
    out["date_windows"] = oracle("""
        select order_id, strftime(least(promised_delivery_date, coalesce(actual_delivery_date, current_date)), '%Y-%m-%d') first_day,
            case when actual_delivery_date is null then 'today'
                else strftime(greatest(promised_delivery_date, actual_delivery_date), '%Y-%m-%d') end last_day,
            actual_delivery_date is not null complete
        from raw_orders""")
    for name, columns in WIDE_COUNTS.items():
        texts = ", ".join(f"cast({c} as varchar) as {c}" for c in columns)
        out[name] = f"select * replace ({texts}) from ({out[name]})"
    return out
