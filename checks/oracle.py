"""The queries in DuckDB SQL, written independently as chains of named steps."""

from __future__ import annotations

# Task, page flow and seed of the queries.
TASK_ID, SEED, FLOW = 1, 7, (1, 2, 3, 4)


def _texts(values) -> str:
    return "(" + ", ".join(f"'{value}'" for value in values) + ")"


def _overlaps(field: str, wanted) -> str:
    return f"list_has_any(string_split({field}, ','), [{', '.join(repr(w) for w in wanted)}])"


# The conditions of the two tasks, stated here anew.
_TASK = " AND ".join([
    "age BETWEEN 5 AND 50",
    "professional NOT IN ('professional3', 'professional8')",
    _overlaps("search_keywords", ["kw0", "kw1", "kw2", "kw3", "kw5", "kw7", "kw8", "kw9"]),
])
_NARROW_TASK = " AND ".join([
    "age BETWEEN 2 AND 57",
    "professional NOT IN ('professional8', 'professional9')",
    f"city IN {_texts(f'city{i}' for i in range(20))}",
    "sex = 'male'",
    _overlaps("search_keywords", ["kw1", "kw2", "kw3", "kw4", "kw5", "kw6"]),
    _overlaps("click_category_ids", [str(i) for i in range(5, 70)]),
])


def _bucket(field: str, low: int, high: int | None) -> str:
    upper = "" if high is None else f" AND {field} <= {high}"
    return f"count(*) FILTER (WHERE {field} >= {low}{upper})"


# Stated here anew, not taken from the library: inclusive limits, None is open.
_BUCKETS = [
    (name, _bucket(field, low, high))
    for name, field, low, high in (
        ("visit_length_1s_3s", "visit_length", 1, 3),
        ("visit_length_4s_6s", "visit_length", 4, 6),
        ("visit_length_7s_9s", "visit_length", 7, 9),
        ("visit_length_10s_30s", "visit_length", 10, 30),
        ("visit_length_30s_60s", "visit_length", 31, 60),
        ("visit_length_1m_3m", "visit_length", 61, 180),
        ("visit_length_3m_10m", "visit_length", 181, 600),
        ("visit_length_10m_30m", "visit_length", 601, 1800),
        ("visit_length_30m", "visit_length", 1801, None),
        ("step_length_1_3", "step_length", 1, 3),
        ("step_length_4_6", "step_length", 4, 6),
        ("step_length_7_9", "step_length", 7, 9),
        ("step_length_10_30", "step_length", 10, 30),
        ("step_length_30_60", "step_length", 31, 60),
        ("step_length_60", "step_length", 61, None),
    )
]


def _ratio(part: str, whole: str) -> str:
    return f"CAST((200 * {part} + {whole}) // nullif(2 * {whole}, 0) AS DOUBLE) / 100"


def _half_up(value: str, scale: int) -> str:
    """Round half up on the exact binary value, by 128-bit whole numbers."""
    unit, half = 2**62, 2**61
    fraction = f"CAST((abs({value}) - floor(abs({value}))) * {float(unit)!r}::DOUBLE AS HUGEINT)"
    steps = f"(({fraction} * {10**scale} + {half}) // {unit})"
    size = f"(floor(abs({value})) * {10**scale} + CAST({steps} AS DOUBLE)) / {10**scale}"
    return f"CASE WHEN {value} < 0 THEN -({size}) ELSE {size} END"


def _table(rows: list[str], columns: str) -> str:
    return f"(VALUES {', '.join(rows)}) AS t({columns})"


_SPLITS = [f"{a}_{b}" for a, b in zip(FLOW, FLOW[1:], strict=False)]
_AREAS = (
    "['China North', 'China East', 'China South', 'China Middle', 'West North', 'West South', "
    "'East North']"
)

# Steps in order; each may use the ones above it.
_STEPS = {
    "base": """
        SELECT *, (dom - 1) // span AS blk, sod // squeeze AS off FROM (
            SELECT event_id, ts, user_id, event_type,
                   CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
                   date_trunc('month', ts) AS month_start,
                   hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS sod,
                   CASE user_id % 3 WHEN 0 THEN 24 WHEN 1 THEN 240 ELSE 4800 END AS squeeze,
                   CASE user_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 5 ELSE 30 END AS span,
                   day(ts) AS dom
            FROM events)""",
    "user_visit_action": """
        SELECT date, user_id, user_id || '-' || blk AS session_id, k % 10 AS page_id,
               date || ' ' || ((user_id * 7 + blk) % 23) || ':'
                   || lpad(CAST(off // 60 AS VARCHAR), 2, '0') || ':'
                   || lpad(CAST(off % 60 AS VARCHAR), 2, '0') AS action_time,
               CASE WHEN event_type = 'view' THEN 'kw' || (k % 10) END AS search_keyword,
               CASE WHEN event_type = 'click' THEN k END AS click_category_id,
               CASE WHEN event_type = 'click' THEN 1 + (event_id * 7 + k) % 100 END
                   AS click_product_id,
               CASE WHEN event_type = 'signup' THEN k || ',' || ((k + event_id) % 100) END
                   AS order_category_ids,
               CASE WHEN event_type = 'signup' THEN CAST(1 + event_id % 100 AS VARCHAR) END
                   AS order_product_ids,
               CASE WHEN event_type = 'purchase' THEN CAST(k AS VARCHAR) END
                   AS pay_category_ids,
               CASE WHEN event_type = 'purchase' THEN CAST(1 + event_id % 100 AS VARCHAR) END
                   AS pay_product_ids,
               (user_id + k) % 25 AS city_id, event_id
        FROM (SELECT *, strftime(month_start + to_days(CAST(blk * span AS INTEGER)), '%Y-%m-%d')
                        AS date FROM base)""",
    "user_info": """
        SELECT c_custkey AS user_id, 'user' || c_custkey AS username, c_name AS name,
               CAST(c_custkey * 37 % 60 AS INTEGER) AS age,
               'professional' || (c_custkey % 10) AS professional,
               'city' || c_nationkey AS city,
               CASE WHEN c_custkey % 2 = 0 THEN 'male' ELSE 'female' END AS sex
        FROM customer""",
    "product_info": """
        SELECT p_partkey AS product_id, p_name AS product_name,
               '{"product_status": ' || (p_partkey % 2) || '}' AS extend_info
        FROM part""",
    "city_info": f"""
        SELECT CAST(n_nationkey AS BIGINT) AS city_id, n_name AS city_name,
               {_AREAS}[n_nationkey % 7 + 1] AS area FROM nation""",
    "actions": f"""
        SELECT *, strptime(action_time, '%Y-%m-%d %H:%M:%S') AS action_ts
        FROM user_visit_action
        WHERE date >= '2024-01-01' AND date <= '2024-01-31'""",
    "sessions": """
        SELECT session_id, min(user_id) AS user_id,
               string_agg(DISTINCT nullif(search_keyword, ''), ','
                          ORDER BY nullif(search_keyword, '')) AS search_keywords,
               string_agg(DISTINCT CAST(click_category_id AS VARCHAR), ','
                          ORDER BY CAST(click_category_id AS VARCHAR)) AS click_category_ids,
               CAST(epoch(max(action_ts)) - epoch(min(action_ts)) AS BIGINT) AS visit_length,
               count(*) AS step_length,
               strftime(min(action_ts), '%Y-%m-%d %H:%M:%S') AS start_time
        FROM actions GROUP BY session_id""",
    "full_sessions": """
        SELECT s.*, u.age, u.professional, u.city, u.sex
        FROM sessions s JOIN user_info u USING (user_id)""",
    "kept": f"SELECT * FROM full_sessions WHERE {_TASK}",
    "detail": "SELECT * FROM actions WHERE session_id IN (SELECT session_id FROM kept)",
    "counts": "SELECT count(*) AS session_count, "
    + ", ".join(f"{sql} AS {name}" for name, sql in _BUCKETS)
    + " FROM kept",
    "hours": """
        SELECT date, hour, session_count,
               CAST(sum(session_count) OVER (PARTITION BY date) AS BIGINT) AS day_count
        FROM (SELECT substr(start_time, 1, 10) AS date, substr(start_time, 12, 2) AS hour,
                     count(*) AS session_count FROM kept GROUP BY ALL)""",
    "quota": f"""
        SELECT date, hour, session_count, day_count,
               least(session_count, CAST(floor(
                   CAST(session_count AS DOUBLE) / CAST(day_count AS DOUBLE)
                   * (100 // (SELECT count(DISTINCT date) FROM hours)))
                   AS BIGINT)) AS quota
        FROM hours""",
    "extracted": f"""
        SELECT CAST({TASK_ID} AS BIGINT) AS task_id, session_id, start_time, search_keywords,
               click_category_ids
        FROM (SELECT *, row_number() OVER (
                  PARTITION BY substr(start_time, 1, 13)
                  ORDER BY md5(session_id || '|{SEED}'), session_id) AS draw FROM kept) k
        JOIN quota q ON q.date = substr(start_time, 1, 10) AND q.hour = substr(start_time, 12, 2)
        WHERE draw <= quota""",
    "click_cats": """
        SELECT click_category_id AS category_id FROM detail
        WHERE click_category_id IS NOT NULL""",
    "order_cats": """
        SELECT CAST(c AS BIGINT) AS category_id
        FROM (SELECT unnest(string_split(order_category_ids, ',')) AS c FROM detail)
        WHERE c <> ''""",
    "pay_cats": """
        SELECT CAST(c AS BIGINT) AS category_id
        FROM (SELECT unnest(string_split(pay_category_ids, ',')) AS c FROM detail)
        WHERE c <> ''""",
    "click_counts": "SELECT category_id, count(*) AS click_count FROM click_cats GROUP BY 1",
    "order_counts": "SELECT category_id, count(*) AS order_count FROM order_cats GROUP BY 1",
    "pay_counts": "SELECT category_id, count(*) AS pay_count FROM pay_cats GROUP BY 1",
    "cats": """
        SELECT category_id FROM click_cats UNION SELECT category_id FROM order_cats
        UNION SELECT category_id FROM pay_cats""",
    "cat_counts": """
        SELECT category_id, coalesce(click_count, 0) AS click_count,
               coalesce(order_count, 0) AS order_count, coalesce(pay_count, 0) AS pay_count
        FROM cats LEFT JOIN click_counts USING (category_id)
        LEFT JOIN order_counts USING (category_id) LEFT JOIN pay_counts USING (category_id)""",
    "top_cats": f"""
        SELECT CAST({TASK_ID} AS BIGINT) AS task_id, category_id, click_count, order_count,
               pay_count
        FROM cat_counts
        ORDER BY click_count DESC, order_count DESC, pay_count DESC, category_id
        LIMIT 10""",
    "cat_sessions": """
        SELECT click_category_id AS category_id, session_id, count(*) AS click_count
        FROM detail WHERE click_category_id IS NOT NULL GROUP BY ALL""",
    "top_sessions": f"""
        SELECT CAST({TASK_ID} AS BIGINT) AS task_id, category_id, session_id, click_count
        FROM (SELECT *, row_number() OVER (
                  PARTITION BY category_id ORDER BY click_count DESC, session_id) AS rn
              FROM cat_sessions WHERE category_id IN (SELECT category_id FROM top_cats))
        WHERE rn <= 10""",
    "views": """
        SELECT session_id, page_id, lag(page_id) OVER (
            PARTITION BY session_id ORDER BY action_ts, event_id) AS prev_page
        FROM actions""",
    "splits": f"""
        SELECT session_id, prev_page || '_' || page_id AS page_split FROM views
        WHERE prev_page IS NOT NULL AND prev_page || '_' || page_id IN {_texts(_SPLITS)}""",
    "split_pv": "SELECT page_split, count(*) AS pv FROM splits GROUP BY 1",
    "start_pv": f"SELECT count(*) AS pv FROM actions WHERE page_id = {FLOW[0]}",
    "rates": f"""
        SELECT CAST(step AS BIGINT) AS step, page_split, pv, {_ratio('pv', 'base_pv')}
               AS convert_rate
        FROM (SELECT step, page_split, pv,
                     CASE WHEN step = 1 THEN (SELECT pv FROM start_pv)
                          ELSE lag(pv) OVER (ORDER BY step) END AS base_pv
              FROM (SELECT step, s.page_split, coalesce(pv, 0) AS pv
                    FROM {_table([f"({i}, '{t}')" for i, t in enumerate(_SPLITS, 1)],
                                 'step, page_split').replace('AS t', 'AS s')}
                    LEFT JOIN split_pv p ON p.page_split = s.page_split))""",
    "clicks": f"""
        SELECT city_id, click_product_id AS product_id FROM user_visit_action
        WHERE click_product_id IS NOT NULL
          AND date >= '2024-01-01' AND date <= '2024-01-31'""",
    "basic": """
        SELECT city_id, city_name, area, product_id FROM clicks JOIN city_info USING (city_id)""",
    "area_counts": """
        SELECT area, product_id, count(*) AS click_count,
               string_agg(DISTINCT city_id || ':' || city_name, ','
                          ORDER BY city_id || ':' || city_name) AS city_infos
        FROM basic GROUP BY ALL""",
    "full_products": """
        SELECT area, product_id, click_count, city_infos, product_name,
               CASE WHEN json_extract_string(extend_info, '$.product_status') = '0'
                    THEN 'Self' ELSE 'Third Party' END AS product_status
        FROM area_counts JOIN product_info USING (product_id)""",
    "ad_clicks": """
        SELECT epoch_us(ts) // 1000 AS millis, 'prov' || n_regionkey AS province,
               'city' || n_nationkey AS city, user_id,
               CAST(json_extract_string(props, '$.k') AS BIGINT) % 12 AS ad_id,
               ts
        FROM events JOIN nation ON n_nationkey = (user_id + event_id) % 25
        WHERE event_type IN ('click', 'view')""",
    "allowed": """
        SELECT * FROM ad_clicks WHERE user_id NOT IN (
            SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')""",
    "stat": """
        SELECT strftime(ts, '%Y%m%d') AS date, province, city, ad_id, count(*) AS click_count
        FROM allowed GROUP BY ALL""",
    "province_counts": """
        SELECT strftime(ts, '%Y-%m-%d') AS date, province, ad_id, count(*) AS click_count
        FROM allowed GROUP BY ALL""",
    "trend": """
        SELECT strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H') AS hour,
               strftime(ts, '%M') AS minute, ad_id, count(*) AS click_count
        FROM ad_clicks GROUP BY ALL""",
}


def _with(select: str) -> str:
    steps = ",\n".join(f"{name} AS ({sql})" for name, sql in _STEPS.items())
    return f"WITH {steps}\n{select}"


_DETAIL = f"""
    SELECT CAST({TASK_ID} AS BIGINT) AS task_id, user_id, session_id, page_id, action_time,
           search_keyword, click_category_id, click_product_id, order_category_ids,
           order_product_ids, pay_category_ids, pay_product_ids FROM """

_STAT = (
    f"SELECT CAST({TASK_ID} AS BIGINT) AS task_id, session_count, "
    + ", ".join(f"{_ratio(n, 'session_count')} AS {n}_ratio" for n, _ in _BUCKETS)
    + " FROM counts"
)

_TASK_PARAM = """
    SELECT c_custkey AS task_id, 'task of ' || c_name AS task_name,
           lower(c_mktsegment) AS task_type, '2024-01-01' AS start_date, '2024-01-31' AS end_date,
           CASE WHEN c_mktsegment <> 'BUILDING' THEN CAST(c_custkey % 30 AS VARCHAR) END
               AS start_age,
           CASE WHEN c_mktsegment <> 'BUILDING' THEN CAST(c_custkey % 30 + 20 AS VARCHAR) END
               AS end_age,
           CAST(NULL AS VARCHAR) AS professionals,
           CASE WHEN c_mktsegment <> 'FURNITURE' THEN 'city' || c_nationkey || ',city1' END
               AS cities,
           CASE WHEN c_mktsegment <> 'FURNITURE' THEN 'male' END AS sex,
           CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN 'kw1,kw2' END AS keywords,
           CAST(NULL AS VARCHAR) AS category_ids, '1,2,3,4' AS target_page_flow
    FROM customer"""

_RANGE = "date >= '2024-01-02' AND date <= '2024-01-21'"

_DATETIME = """
    SELECT event_id, ats < noon AS is_before, ats > noon AS is_after, FALSE AS bad_is_before,
           CAST(epoch(ats) - epoch(noon) AS BIGINT) AS minus_seconds,
           CAST(0 AS BIGINT) AS bad_minus, strftime(ats, '%Y-%m-%d_%H') AS date_hour,
           CAST(1 AS BIGINT) AS yesterday_gap, strftime(ats, '%Y-%m-%d') AS date_text,
           strftime(ats, '%Y-%m-%d %H:%M:%S') AS time_text, strftime(ats, '%Y%m%d') AS date_key,
           strftime(ats, '%Y-%m-%d') AS date_back, strftime(ats, '%Y%m%d%H%M') AS minute_key,
           strftime(ats, '%Y-%m-%d') AS key_date, strftime(ats, '%H') AS key_hour,
           strftime(ats, '%M') AS key_minute, strftime(ats, '%Y-%m-%d %H:%M:%S') AS millis_time,
           CAST(epoch(noon) - epoch(ats) AS BIGINT) AS visit_seconds
    FROM (SELECT event_id, strptime(action_time, '%Y-%m-%d %H:%M:%S') AS ats,
                 strptime(date || ' 12:00:00', '%Y-%m-%d %H:%M:%S') AS noon
          FROM user_visit_action)"""

_STRINGS = """
    SELECT event_id, search_keyword IS NULL AS no_word, search_keyword IS NOT NULL AS has_word,
           order_category_ids || ',' AS trimmed, lpad(CAST(page_id AS VARCHAR), 2, '0') AS padded,
           CAST(string_split(order_category_ids, ',')[1] AS BIGINT) AS first_id,
           CAST(string_split(order_category_ids, ',')[2] AS BIGINT) AS second_id,
           city_id || ':' || search_keyword AS city_word, 'a_' || search_keyword AS unprefixed,
           CASE WHEN search_keyword IS NOT NULL THEN TRUE END AS prefix_in_range,
           coalesce(list_has_any(string_split(order_category_ids, ','), ['1', '7', '33']), FALSE)
               AS in_list,
           page_id BETWEEN 2 AND 5 AS in_range, TRUE AS open_range,
           coalesce(search_keyword = 'kw3', FALSE) AS is_kw3
    FROM user_visit_action"""

_JSON = """
    SELECT product_id, json_extract_string(extend_info, '$.product_status') AS flag,
           CAST(NULL AS VARCHAR) AS missing,
           CASE WHEN json_extract_string(extend_info, '$.product_status') = '0'
                THEN 'Self' ELSE 'Third Party' END AS product_status
    FROM product_info"""

ORACLE_SQL = {
    name: _with(select)
    for name, select in {
        "actions_by_date_range": f"SELECT * FROM user_visit_action WHERE {_RANGE}",
        "session_aggregate": "SELECT * FROM sessions",
        "session_full_aggr": "SELECT * FROM full_sessions",
        "session_filter": f"SELECT * FROM full_sessions WHERE {_NARROW_TASK}",
        "session_aggr_counts": "SELECT * FROM counts",
        "session_aggr_stat": _STAT,
        "session_aggr_stat_observed": _STAT,
        "session_detail": _DETAIL + "detail",
        "sessions_per_date_hour": "SELECT * FROM hours",
        "extract_quota": "SELECT * FROM quota",
        "random_extract_session": "SELECT * FROM extracted",
        "random_extract_detail": _DETAIL
        + "detail WHERE session_id IN (SELECT session_id FROM extracted)",
        "distinct_categories": "SELECT * FROM cats",
        "category_click_count": "SELECT * FROM click_counts",
        "category_order_count": "SELECT * FROM order_counts",
        "category_pay_count": "SELECT * FROM pay_counts",
        "category_counts": "SELECT * FROM cat_counts",
        "top10_category": "SELECT * FROM top_cats",
        "category_session_counts": "SELECT * FROM cat_sessions",
        "top10_category_session": "SELECT * FROM top_sessions",
        "top10_session_detail": _DETAIL
        + "(SELECT d.* FROM detail d JOIN top_sessions t ON t.session_id = d.session_id)",
        "task_params": _TASK_PARAM,
        "start_page_pv": "SELECT pv AS start_page_pv FROM start_pv",
        "page_split_match": "SELECT * FROM splits",
        "page_split_pv": "SELECT * FROM split_pv",
        "page_convert_rate": "SELECT * FROM rates",
        "page_split_convert_rate": f"SELECT CAST({TASK_ID} AS BIGINT) AS task_id, string_agg("
        "page_split || '=' || coalesce(CAST(convert_rate AS VARCHAR), 'null'), '|' ORDER BY step)"
        " AS convert_rate FROM rates",
        "click_actions_by_date": "SELECT city_id, click_product_id AS product_id"
        f" FROM user_visit_action WHERE click_product_id IS NOT NULL AND {_RANGE}",
        "click_product_basic": "SELECT * FROM basic",
        "area_product_click_count": "SELECT * FROM area_counts",
        "group_concat_distinct": "SELECT product_id, string_agg(DISTINCT city_id || ':' ||"
        " city_name, ',' ORDER BY city_id || ':' || city_name) AS city_infos"
        " FROM basic GROUP BY product_id",
        "area_full_product": "SELECT * FROM full_products",
        "area_top3_product": f"""
            SELECT CAST({TASK_ID} AS BIGINT) AS task_id, area,
                   CASE WHEN area IN ('China North', 'China East') THEN 'A level'
                        WHEN area IN ('China South', 'China Middle') THEN 'B Level'
                        WHEN area IN ('West North', 'West South') THEN 'C Level'
                        ELSE 'D Level' END AS area_level,
                   product_id, city_infos, click_count, product_name, product_status
            FROM (SELECT *, row_number() OVER (
                      PARTITION BY area ORDER BY click_count DESC, product_id) AS rn
                  FROM full_products)
            WHERE rn <= 3""",
        "salted_count": "SELECT product_id, count(*) AS row_count FROM clicks GROUP BY 1",
        "parse_ad_log": "SELECT millis, province, city, user_id, ad_id FROM ad_clicks",
        "ad_blacklist_filter": "SELECT millis, province, city, user_id, ad_id FROM allowed",
        "province_ad_count": "SELECT * FROM province_counts",
        "upsert_ad_stat": "SELECT * FROM stat",
        "upsert_ad_click_trend": "SELECT * FROM trend",
        "ad_stat": "SELECT * FROM stat",
        "ad_stat_pinned": "SELECT * FROM stat",
        "ad_blacklist_large": "SELECT millis, province, city, user_id, ad_id FROM allowed",
        "ad_blacklist_insert": "SELECT c_custkey AS user_id FROM customer"
        " WHERE c_mktsegment = 'MACHINERY'",
        "salted_count_skewed": "SELECT page_id, count(*) AS row_count,"
        " count(DISTINCT session_id) AS distinct_count FROM user_visit_action GROUP BY page_id",
        "task_params_variant": _TASK_PARAM,
        "session_category_bitmap": "SELECT session_id, click_category_ids, coalesce("
        + _overlaps("click_category_ids", [str(i) for i in range(5, 70)])
        + ", FALSE) AS in_list FROM sessions",
        "ad_province_top3": f"""
            SELECT date, province, ad_id, click_count
            FROM (SELECT *, row_number() OVER (
                      PARTITION BY date, province ORDER BY click_count DESC, ad_id) AS rn
                  FROM province_counts)
            WHERE rn <= 3""",
        "ad_click_trend": "SELECT * FROM trend",
        "ad_click_trend_last_hour": f"""
            SELECT strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H') AS hour,
                   strftime(ts, '%M') AS minute, ad_id, count(*) AS click_count
            FROM ad_clicks
            WHERE date_trunc('minute', ts) > (SELECT max(date_trunc('minute', ts)) FROM ad_clicks)
                  - to_minutes(60)
            GROUP BY ALL""",
        "ad_click_sliding_10s": """
            SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start,
                   strftime(w + to_minutes(60), '%Y-%m-%d %H:%M:%S') AS window_end,
                   ad_id, count(*) AS click_count
            FROM (SELECT ad_id, unnest(generate_series(
                      time_bucket(INTERVAL 10 SECOND, ts) - to_seconds(3590),
                      time_bucket(INTERVAL 10 SECOND, ts), to_seconds(10))) AS w
                  FROM ad_clicks)
            GROUP BY ALL""",
        "ad_click_sliding": """
            SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start,
                   strftime(w + to_minutes(60), '%Y-%m-%d %H:%M:%S') AS window_end,
                   ad_id, count(*) AS click_count
            FROM (SELECT ad_id, unnest(generate_series(
                      time_bucket(INTERVAL 10 MINUTE, ts) - to_minutes(50),
                      time_bucket(INTERVAL 10 MINUTE, ts), to_minutes(10))) AS w
                  FROM ad_clicks)
            GROUP BY ALL""",
        "scalar_datetime": _DATETIME,
        "scalar_strings": _STRINGS,
        "scalar_json": _JSON,
        "scalar_round": f"""
            SELECT event_id, {_ratio('event_id', 'user_id')} AS id_ratio,
                   {_half_up('value', 1)} AS one_decimal,
                   {_half_up('(-value / 7)', 2)} AS two_decimals,
                   {_half_up('(CAST(event_id AS DOUBLE) / 200.0::DOUBLE)', 2)} AS half_steps,
                   {_half_up('value', 4)} AS four_decimals
            FROM events""",
    }.items()
}
