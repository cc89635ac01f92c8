"""SQL stating the expected result of each registered query.

Each statement stands alone: the sample tables it uses come first as common
table expressions (``m_<name>``), then the result, then one typed output list.
The output list is a string of ``column:kind`` pairs, with kinds
``i`` whole number, ``s`` text, ``t`` timestamp, ``b`` boolean, ``f`` or ``fN``
double to six or N decimals, ``dN`` rounded half up and ``eN`` half to even at
N decimals in decimal arithmetic.
"""

from __future__ import annotations

import re

from agoralytics.schemas import FOREIGN_KEYS, TABLES
from agoralytics.sources.sample_tables import DERIVED
from checks.queries import COHORTS, GROWTH_MONTHS, PARETO_RANKS, VARIANT


def _table_sql(name: str) -> str:
    spec = DERIVED[name]
    columns = ", ".join(f"{expr} AS {column}" for column, expr in spec.columns)
    source = spec.base + "".join(f" JOIN {t} ON {l} = {r}" for t, l, r in spec.joins)
    return f"SELECT {'DISTINCT ' if spec.distinct else ''}{columns} FROM {source}"


def _output(item: str) -> str:
    name, kind = item.split(":")
    if kind == "i":
        value = f"CAST({name} AS BIGINT)"
    elif kind[0] == "f":
        value = f"ROUND(CAST({name} AS DOUBLE), {kind[1:] or 6})"
    elif kind[0] == "d":
        value = f"CAST(ROUND(CAST({name} AS DECIMAL(30,10)), {kind[1:]}) AS DOUBLE)"
    elif kind[0] == "e":
        # half to even: step back from an upward tie that lands on an odd digit
        power = 10 ** int(kind[1:])
        exact = f"CAST({name} AS DECIMAL(30,10))"
        up = f"ROUND({exact}, {kind[1:]})"
        tie = f"ABS({up} - {exact}) = CAST(0.5 / {power} AS DECIMAL(30,10))"
        odd = f"CAST(ROUND({up} * {power}, 0) AS HUGEINT) % 2 <> 0"
        value = (
            f"CAST(CASE WHEN {tie} AND {odd} THEN {up} - SIGN({name}) / {power}.0 "
            f"ELSE {up} END AS DOUBLE)"
        )
    else:
        value = name
    return f"{value} AS {name}"


def statement(body: str, output: str, order: str = "") -> str:
    """Add the common table expressions ``body`` mentions and the typed output list."""
    known = {**{f"m_{n}": _table_sql(n) for n in DERIVED}, **STEPS}
    needed: dict[str, str] = {}

    def require(text: str) -> None:
        for name in re.findall(r"\b[mx]_\w+\b", text):
            if name in known and name not in needed:
                require(known[name])
                needed[name] = known[name]

    require(body)
    parts = [f"{name} AS ({sql})" for name, sql in needed.items()]
    parts.append(f"outcome AS ({body})")
    columns = ", ".join(map(_output, output.split()))
    return f"WITH {', '.join(parts)} SELECT {columns} FROM outcome{order}"


def _month(ts: str) -> str:
    return f"STRFTIME({ts}, '%Y-%m')"


def _calendar(later: str, earlier: str) -> str:
    return f"(CAST({later} AS DATE) - CAST({earlier} AS DATE))"


def _elapsed(later: str, earlier: str) -> str:
    return f"CAST(FLOOR((EPOCH_US({later}) - EPOCH_US({earlier})) / 86400000000.0) AS BIGINT)"


def _per(part: str, whole: str, times: int = 100) -> str:
    return f"{times}.0 * CAST({part} AS DOUBLE) / NULLIF(CAST({whole} AS DOUBLE), 0)"


_BOUGHT, _ARRIVED, _PROMISED = (
    "order_purchase_timestamp",
    "order_delivered_customer_date",
    "order_estimated_delivery_date",
)


def _label(rules: list[tuple[str, str]]) -> str:
    arms = " ".join(f"WHEN {rule} THEN '{label}'" for rule, label in rules)
    return f"CASE {arms} ELSE 'Standard One-Time Buyers' END"


# The segment rules in the order in which they apply.
_SEVEN = [
    ("f_score = 4 AND r_score >= 3 AND m_score >= 3", "Champions"),
    ("f_score = 4 AND r_score >= 3", "Loyal Customers"),
    ("f_score = 4 AND r_score = 2", "Needs Attention (Repeat)"),
    ("f_score = 4 AND r_score = 1", "Cant Lose Them (At Risk)"),
    ("f_score = 1 AND r_score >= 3 AND m_score >= 3", "Promising High-Spenders"),
    ("r_score = 1 AND m_score = 1", "Lost / Churned"),
]
_SIX = [
    ("f_score = 4 AND r_score >= 3 AND m_score >= 3", "Champions"),
    ("f_score = 4 AND r_score >= 3", "Loyal Customers"),
    ("f_score = 1 AND r_score >= 3 AND m_score >= 3", "Promising High-Spenders"),
    ("f_score = 4 AND r_score = 1", "Cant Lose Them (At Risk)"),
    ("r_score = 1 AND m_score = 1", "Lost / Churned"),
]
_CODE = "CAST(100 * r_score + 10 * f_score + m_score AS VARCHAR)"


def _quartile_of_rank(order: str) -> str:
    # quantile edges of the ranks 1..n at 1 + (n - 1) * j / 4, right-closed
    rank = f"ROW_NUMBER() OVER (ORDER BY {order} NULLS FIRST, customer_unique_id)"
    edges = " + ".join(
        f"CAST({rank} > 1 + (COUNT(*) OVER () - 1) * {j}.0 / 4 AS INT)" for j in (1, 2, 3)
    )
    return f"1 + {edges}"


# Shared intermediate results.
STEPS: dict[str, str] = {
    "x_done": "SELECT * FROM m_orders WHERE order_status = 'delivered'",
    "x_sales": (
        "SELECT o.order_id, o.order_purchase_timestamp, c.customer_unique_id, c.customer_state, "
        "i.order_item_id, i.seller_id, i.price, i.freight_value "
        "FROM x_done o JOIN m_customers c USING (customer_id) JOIN m_order_items i USING (order_id)"
    ),
    "x_score": (
        "SELECT order_id, ROUND(CAST(AVG(review_score) AS DECIMAL(30,10)), 4) AS score "
        "FROM m_order_reviews GROUP BY order_id"
    ),
    "x_label": (
        "SELECT p.product_id, p.product_category_name AS plain, t.product_category_name_english AS english "
        "FROM m_products p LEFT JOIN m_translation t USING (product_category_name)"
    ),
    "x_products_any": (
        "SELECT product_id, " + VARIANT.format(row="product_id", text="product_category_name") + " AS name FROM m_products"
    ),
    "x_customers_any": (
        "SELECT customer_id, customer_unique_id, "
        + VARIANT.format(row="customer_id", text="customer_state")
        + " AS customer_state FROM m_customers"
    ),
    # every spelling of a key, and the smallest one equal to it but for case and accents
    "x_stored": (
        "SELECT key_name, spelling, COUNT(*) AS n, "
        "MIN(spelling) OVER (PARTITION BY key_name, LOWER(STRIP_ACCENTS(spelling))) AS stored FROM ("
        "SELECT 'order_status' AS key_name, order_status AS spelling FROM m_orders UNION ALL "
        "SELECT 'payment_type', payment_type FROM m_order_payments UNION ALL "
        "SELECT 'category', name FROM x_products_any UNION ALL "
        "SELECT 'category', product_category_name FROM m_translation UNION ALL "
        "SELECT 'category_label', product_category_name_english FROM m_translation UNION ALL "
        "SELECT 'state', customer_state FROM x_customers_any UNION ALL "
        "SELECT 'state', seller_state FROM m_sellers UNION ALL "
        "SELECT 'state', geolocation_state FROM m_geolocation) WHERE spelling IS NOT NULL GROUP BY key_name, spelling"
    ),
    "x_label_any": (
        "SELECT p.product_id, s.stored AS plain, t.english FROM x_products_any p "
        "LEFT JOIN x_stored s ON s.key_name = 'category' AND s.spelling = p.name LEFT JOIN ("
        "SELECT b.stored AS plain, a.product_category_name_english AS english FROM m_translation a "
        "JOIN x_stored b ON b.key_name = 'category' AND b.spelling = a.product_category_name) t ON t.plain = s.stored"
    ),
    "x_month": (
        f"SELECT {_month('o.' + _BOUGHT)} AS order_month, COUNT(DISTINCT order_id) AS total_orders, "
        "SUM(i.price + i.freight_value) AS monthly_revenue "
        "FROM x_done o JOIN m_order_items i USING (order_id) GROUP BY 1"
    ),
    "x_growth": (
        "SELECT *, LAG(monthly_revenue) OVER (ORDER BY order_month NULLS FIRST) AS prev_month_revenue FROM x_month"
    ),
    "x_state": (
        "SELECT customer_state, COUNT(DISTINCT customer_unique_id) AS unique_customers, "
        "COUNT(DISTINCT order_id) AS total_orders, SUM(price + freight_value) AS total_revenue, "
        f"{_per('SUM(freight_value)', 'COUNT(freight_value)', 1)} AS avg_freight_paid "
        "FROM x_sales GROUP BY customer_state"
    ),
    "x_category": (
        "SELECT COALESCE(l.english, l.plain, 'Unknown') AS category_english, "
        "COUNT(DISTINCT i.order_id) AS total_orders, COUNT(i.order_item_id) AS total_units_sold, "
        f"SUM(i.price) AS total_sales_value, {_per('SUM(i.price)', 'COUNT(i.price)', 1)} AS avg_item_price, "
        f"{_per('SUM(s.score)', 'COUNT(s.score)', 1)} AS avg_customer_rating "
        "FROM m_order_items i JOIN x_done o USING (order_id) JOIN x_label l USING (product_id) "
        "LEFT JOIN x_score s USING (order_id) GROUP BY 1"
    ),
    "x_transit": (
        f"SELECT *, {_elapsed(_ARRIVED, _BOUGHT)} AS delivery_days, "
        f"COALESCE({_ARRIVED} > {_PROMISED}, FALSE) AS is_delayed, {_month(_BOUGHT)} AS order_month FROM x_done"
    ),
    "x_visit": (
        f"SELECT DISTINCT c.customer_unique_id AS person, 12 * YEAR({_BOUGHT}) + MONTH({_BOUGHT}) AS m "
        "FROM x_done o JOIN m_customers c USING (customer_id)"
    ),
    "x_cohort": (
        "SELECT person, m - MIN(m) OVER (PARTITION BY person) AS gap, "
        "MIN(m) OVER (PARTITION BY person) - 1 AS born FROM x_visit"
    ),
    "x_retention": (
        "SELECT PRINTF('%04d-%02d', born // 12, born % 12 + 1) AS cohort_month, "
        + ", ".join(
            f"COUNT(*) FILTER (WHERE gap = {k}) AS month_{k}" for k in (0, 1, 2, 3, 6, 12)
        )
        + " FROM x_cohort GROUP BY born "
        f"HAVING cohort_month BETWEEN '{COHORTS[0]}' AND '{COHORTS[1]}'"
    ),
    "x_paid": (
        f"SELECT c.customer_unique_id, o.order_id, o.{_BOUGHT} AS bought, p.payment_value "
        "FROM x_done o JOIN m_customers c USING (customer_id) JOIN m_order_payments p USING (order_id)"
    ),
    "x_rfm": (
        "SELECT customer_unique_id, "
        f"{_calendar('(SELECT MAX(' + _BOUGHT + ') FROM m_orders)', 'MAX(bought)')} AS recency_days, "
        "COUNT(DISTINCT order_id) AS frequency_orders, SUM(payment_value) AS monetary_spend "
        "FROM x_paid GROUP BY customer_unique_id"
    ),
    "x_scored": (
        "SELECT *, NTILE(4) OVER (ORDER BY recency_days DESC NULLS LAST, customer_unique_id) AS r_score, "
        "CASE WHEN frequency_orders > 1 THEN 4 ELSE 1 END AS f_score, "
        "NTILE(4) OVER (ORDER BY monetary_spend NULLS FIRST, customer_unique_id) AS m_score FROM x_rfm"
    ),
    "x_six": f"SELECT *, {_CODE} AS rfm_code, {_label(_SIX)} AS customer_segment FROM x_scored",
    "x_seven": f"SELECT *, {_CODE} AS rfm_code, {_label(_SEVEN)} AS customer_segment FROM x_scored",
    "x_note": (
        "SELECT customer_unique_id, "
        f"{_elapsed('(SELECT MAX(bought) FROM x_paid)', 'MAX(bought)')} AS recency, "
        "COUNT(DISTINCT order_id) AS frequency, COALESCE(SUM(payment_value), 0) AS monetary "
        "FROM x_paid GROUP BY customer_unique_id"
    ),
    "x_notescore": (
        f"SELECT *, 5 - ({_quartile_of_rank('recency')}) AS r_score, "
        "CASE WHEN frequency > 1 THEN 4 ELSE 1 END AS f_score, "
        f"{_quartile_of_rank('monetary')} AS m_score FROM x_note"
    ),
    "x_noted": f"SELECT *, {_CODE} AS rfm_code, {_label(_SEVEN)} AS customer_segment FROM x_notescore",
    "x_summary": (
        "SELECT customer_segment, COUNT(*) AS customer_count, "
        f"{_per('SUM(monetary)', 'COUNT(*)', 1)} AS avg_spend, SUM(monetary) AS total_revenue, "
        f"{_per('COUNT(*)', '(SELECT COUNT(*) FROM x_noted)')} AS customer_pct, "
        f"{_per('SUM(monetary)', '(SELECT SUM(monetary) FROM x_noted)')} AS revenue_pct "
        "FROM x_noted GROUP BY customer_segment"
    ),
    "x_seller": (
        "SELECT s.seller_id, s.seller_state, s.seller_city, SUM(i.price) AS seller_gmv, "
        "SUM(i.freight_value) AS total_freight_earned, COUNT(DISTINCT i.order_id) AS total_orders, "
        "COUNT(i.order_item_id) AS units_sold, "
        f"{_per('SUM(r.score)', 'COUNT(r.score)', 1)} AS avg_review_score "
        "FROM m_order_items i JOIN m_sellers s USING (seller_id) LEFT JOIN x_score r USING (order_id) "
        "GROUP BY ALL"
    ),
    "x_ranked": (
        "SELECT *, ROW_NUMBER() OVER (ORDER BY seller_gmv DESC, seller_id) AS seller_rank, "
        f"{_per('ROW_NUMBER() OVER (ORDER BY seller_gmv DESC, seller_id)', 'COUNT(*) OVER ()')} AS seller_percentile, "
        f"{_per('SUM(seller_gmv) OVER (ORDER BY seller_gmv DESC)', 'SUM(seller_gmv) OVER ()')} AS cumulative_revenue_pct "
        "FROM x_seller"
    ),
    "x_master": (
        f"SELECT o.*, c.customer_unique_id, c.customer_city, c.customer_state, "
        f"{_calendar('o.' + _ARRIVED, 'o.' + _BOUGHT)} AS delivery_days, "
        f"COALESCE(CAST(o.{_ARRIVED} > o.{_PROMISED} AS INT), 0) AS is_delivery_delayed, s.score AS review_score "
        "FROM m_orders o JOIN m_customers c USING (customer_id) LEFT JOIN x_score s USING (order_id)"
    ),
    "x_review": (
        f"SELECT o.order_id, {_BOUGHT}, {_ARRIVED}, {_PROMISED}, r.review_score, "
        f"{_ARRIVED} > {_PROMISED} AS is_delayed, "
        f"CASE WHEN {_ARRIVED} > {_PROMISED} THEN 'Delayed' ELSE 'On-Time / Early' END AS delivery_status, "
        f"{_elapsed(_ARRIVED, _PROMISED)} AS delay_days, {_elapsed(_ARRIVED, _BOUGHT)} AS delivery_days "
        f"FROM x_done o JOIN m_order_reviews r USING (order_id) "
        f"WHERE {_ARRIVED} IS NOT NULL AND {_PROMISED} IS NOT NULL AND r.review_score IS NOT NULL"
    ),
    "x_cell": (
        "SELECT delivery_status, review_score, CAST(COUNT(*) AS DOUBLE) AS seen FROM x_review GROUP BY ALL"
    ),
    "x_status": "SELECT * FROM (VALUES ('On-Time / Early'), ('Delayed')) v(delivery_status)",
    "x_moment": (
        "SELECT COUNT(*) FILTER (WHERE is_delayed) AS n1, COUNT(*) FILTER (WHERE NOT is_delayed) AS n2, "
        "AVG(review_score) FILTER (WHERE is_delayed) AS mean1, "
        "AVG(review_score) FILTER (WHERE NOT is_delayed) AS mean2, "
        "VAR_SAMP(review_score) FILTER (WHERE is_delayed) AS var1, "
        "VAR_SAMP(review_score) FILTER (WHERE NOT is_delayed) AS var2 FROM x_review"
    ),
    "x_t": (
        "SELECT *, (mean1 - mean2) / SQRT(var1 / n1 + var2 / n2) AS t_statistic, "
        "POWER(var1 / n1 + var2 / n2, 2) / (POWER(var1 / n1, 2) / (n1 - 1) + POWER(var2 / n2, 2) / (n2 - 1)) "
        "AS degrees_of_freedom, "
        "(mean1 - mean2) / SQRT(((n1 - 1) * var1 + (n2 - 1) * var2) / (n1 + n2 - 2)) AS cohens_d FROM x_moment"
    ),
    # both tails of the t density by Simpson's rule over [0, |t|] in 2000 strips
    "x_welch": (
        "SELECT x_t.*, (SELECT 1 - 2 * (ABS(t_statistic) / 2000 / 3) * SUM("
        "CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * "
        "EXP(LGAMMA((degrees_of_freedom + 1) / 2) - LGAMMA(degrees_of_freedom / 2)) "
        "/ SQRT(PI() * degrees_of_freedom) * "
        "POWER(1 + POWER(ABS(t_statistic) * k / 2000, 2) / degrees_of_freedom, -(degrees_of_freedom + 1) / 2)) "
        "FROM (SELECT UNNEST(RANGE(2001)) AS k)) AS p_value FROM x_t"
    ),
    "x_descriptive": (
        "SELECT CASE WHEN is_delayed THEN 'Delayed Orders' ELSE 'On-Time / Early' END AS cohort, "
        "COUNT(*) AS sample_size, AVG(review_score) AS mean_score, MEDIAN(review_score) AS median_score, "
        "STDDEV_SAMP(review_score) AS std_deviation, "
        f"{_per('COUNT(*) FILTER (WHERE review_score = 1)', 'COUNT(*)')} AS one_star_pct, "
        f"{_per('COUNT(*) FILTER (WHERE review_score = 5)', 'COUNT(*)')} AS five_star_pct "
        "FROM x_review GROUP BY is_delayed"
    ),
}

_GROWTH = (
    f"SELECT *, {_per('monthly_revenue - prev_month_revenue', 'prev_month_revenue')} AS mom_growth_pct FROM x_growth",
    "order_month:s total_orders:i monthly_revenue:d2 prev_month_revenue:d2 mom_growth_pct:d2",
)
_RFM_FILE = (
    "SELECT * FROM x_noted",
    "customer_unique_id:i recency:i frequency:i monetary:d2 r_score:i f_score:i m_score:i "
    "rfm_code:s customer_segment:s",
)
_SUMMARY = (
    "SELECT * FROM x_summary",
    "customer_segment:s customer_count:i avg_spend:e2 total_revenue:d2 customer_pct:e2 revenue_pct:e2",
)
_STATE = (
    "customer_state:s unique_customers:i total_orders:i total_revenue:d2 avg_freight_paid:d2"
)
_CATEGORY = (
    "category_english:s total_orders:i total_units_sold:i total_sales_value:d2 avg_item_price:d2 "
    "avg_customer_rating:d2"
)
_SCORE_COLUMNS = ", ".join(
    f"COUNT(*) FILTER (WHERE review_score = {v}) AS score_{v}" for v in (1, 2, 3, 4, 5)
)


def _text(*names: str) -> str:
    return ", ".join(f"CAST({n} AS VARCHAR) AS {n}" for n in names)


def _shape(kind: str) -> str:
    """Per table: its name with rows, or rows and width."""
    widths = {name: len(spec.columns) for name, spec in DERIVED.items()}
    return " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, COUNT(*) AS total_rows, {widths[name]} AS total_columns FROM m_{name}"
        for name in DERIVED
    )


def _null_counts() -> str:
    arms = [
        f"SELECT '{table}' AS table_name, '{column}' AS column_name, "
        f"COUNT(*) - COUNT({column}) AS null_count, {_per(f'COUNT(*) - COUNT({column})', 'COUNT(*)')} AS null_pct "
        f"FROM m_{table}"
        for table in ("orders", "customers", "order_items", "order_payments", "order_reviews", "products")
        for column, _ in DERIVED[table].columns
    ]
    return f"SELECT * FROM ({' UNION ALL '.join(arms)}) WHERE null_count > 0"


_ORDER_TYPES = ("bigint", "bigint", "string", *("timestamp_ntz",) * 5)


def _schema_info() -> str:
    return " UNION ALL ".join(
        f"SELECT {i + 1} AS column_no, '{column}' AS column_name, '{kind}' AS dtype, "
        f"COUNT({column}) AS non_null_count FROM m_orders"
        for i, ((column, _), kind) in enumerate(zip(DERIVED["orders"].columns, _ORDER_TYPES))
    )


def _duplicated_keys() -> str:
    return " UNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{key}' AS key_column, "
        f"COUNT(*) - COUNT(DISTINCT {key}) - CAST(COUNT(*) > COUNT({key}) AS INT) AS duplicated_rows "
        f"FROM m_{table}"
        for table, key in (
            ("orders", "order_id"),
            ("customers", "customer_id"),
            ("products", "product_id"),
            ("sellers", "seller_id"),
        )
    )


def _primary_keys() -> str:
    arms = []
    for name, spec in TABLES.items():
        if not spec.primary_key:
            continue
        keys = ", ".join(spec.primary_key)
        missing = " OR ".join(f"{k} IS NULL" for k in spec.primary_key)
        arms.append(
            f"SELECT '{name}' AS table_name, '{','.join(spec.primary_key)}' AS key_columns, "
            f"(SELECT COUNT(*) FROM m_{name}) AS total_rows, "
            f"(SELECT COUNT(*) FROM m_{name} WHERE {missing}) AS null_key_rows, "
            "COUNT(*) AS repeated_keys, COALESCE(SUM(n - 1), 0) AS surplus_rows FROM "
            f"(SELECT COUNT(*) AS n FROM m_{name} WHERE NOT ({missing}) GROUP BY {keys}) WHERE n > 1"
        )
    return " UNION ALL ".join(arms)


def _foreign_keys() -> str:
    return " UNION ALL ".join(
        f"SELECT '{child}' AS child_table, '{parent}' AS parent_table, '{key}' AS key_column, "
        f"COUNT(DISTINCT {key}) AS orphan_keys, COUNT(*) AS orphan_rows FROM m_{child} c "
        f"WHERE {key} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM m_{parent} p WHERE p.{key} = c.{key})"
        for child, parent, key in FOREIGN_KEYS
    )


def _materialized() -> str:
    arms = []
    for name in DERIVED:
        keys = TABLES[name].primary_key
        source = f"(SELECT DISTINCT {', '.join(keys)} FROM m_{name})" if keys else f"m_{name}"
        arms.append(f"SELECT '{name}' AS table_name, COUNT(*) AS total_rows FROM {source}")
    return " UNION ALL ".join(arms)


def _profile() -> str:
    measures = (
        ("count", "COUNT({c})"),
        ("mean", "AVG({c})"),
        ("std", "STDDEV_SAMP({c})"),
        ("min", "MIN({c})"),
        ("25%", "QUANTILE_CONT({c}, 0.25)"),
        ("50%", "QUANTILE_CONT({c}, 0.5)"),
        ("75%", "QUANTILE_CONT({c}, 0.75)"),
        ("max", "MAX({c})"),
    )
    return " UNION ALL ".join(
        f"SELECT {i} AS row_no, '{label}' AS statistic, "
        + ", ".join(f"{sql.format(c=f'CAST({c} AS DOUBLE)')} AS {c}" for c in ("recency", "frequency", "monetary"))
        + " FROM x_noted"
        for i, (label, sql) in enumerate(measures)
    )


_DAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")


def _heatmap() -> str:
    week = ", ".join(f"({i}, '{d}')" for i, d in enumerate(_DAYS, start=1))
    hours = ", ".join(
        f"NULLIF(COUNT(order_id) FILTER (WHERE HOUR({_BOUGHT}) = {h}), 0) AS h{h:02d}" for h in range(24)
    )
    return (
        f"SELECT w.day_no, w.dow, {hours} FROM (VALUES {week}) w(day_no, dow) "
        f"LEFT JOIN m_orders o ON DAYNAME(o.{_BOUGHT}) = w.dow GROUP BY ALL"
    )


_HISTOGRAM = (
    "WITH d AS (SELECT delivery_days FROM x_transit WHERE delivery_days IS NOT NULL), "
    "s AS (SELECT MIN(delivery_days) AS lo, (MAX(delivery_days) - MIN(delivery_days)) / 40.0 AS width, "
    "AVG(delivery_days) AS mean_days FROM d), b AS (SELECT UNNEST(RANGE(1, 41)) AS bin_no) "
    "SELECT b.bin_no, s.lo + (b.bin_no - 1) * s.width AS bin_start, s.lo + b.bin_no * s.width AS bin_end, "
    "(SELECT COUNT(*) FROM d WHERE LEAST(40, FLOOR((d.delivery_days - s.lo) / s.width) + 1) = b.bin_no) "
    "AS order_count, s.mean_days FROM b, s"
)

_DENSITY = (
    "WITH d AS (SELECT CAST(delivery_days AS DOUBLE) AS x FROM x_transit WHERE delivery_days IS NOT NULL), "
    "s AS (SELECT MIN(x) AS lo, MAX(x) AS hi, COUNT(*) AS n, STDDEV_SAMP(x) * POWER(COUNT(*), -0.2) AS h FROM d), "
    "g AS (SELECT UNNEST(RANGE(200)) AS point), c AS (SELECT x, COUNT(*) AS w FROM d GROUP BY x) "
    "SELECT g.point, s.lo + (s.hi - s.lo) / 199 * g.point AS days, "
    "SUM(c.w * EXP(-0.5 * POWER((s.lo + (s.hi - s.lo) / 199 * g.point - c.x) / s.h, 2))) "
    "/ (s.n * s.h * SQRT(2 * PI())) AS density FROM g, s, c GROUP BY g.point, s.lo, s.hi, s.n, s.h"
)

_SEVERITY = (
    "WITH b(place, delay_bucket, lo, hi) AS (VALUES (1, 'On-Time (0)', NULL, NULL), (2, '1-3 Days', 0, 3), "
    "(3, '4-7 Days', 3, 7), (4, '8-14 Days', 7, 14), (5, '15-30 Days', 14, 30), (6, '30+ Days', 30, 100)) "
    "SELECT place, delay_bucket, AVG(r.review_score) AS mean, COUNT(r.review_score) AS count FROM b "
    "LEFT JOIN x_review r ON (place = 1 AND NOT r.is_delayed) "
    "OR (r.is_delayed AND r.delay_days > lo AND r.delay_days <= hi) GROUP BY place, delay_bucket"
)

_BOX = (
    "WITH q AS (SELECT delivery_status, QUANTILE_CONT(CAST(review_score AS DOUBLE), 0.25) AS q1, "
    "QUANTILE_CONT(CAST(review_score AS DOUBLE), 0.75) AS q3 FROM x_review GROUP BY delivery_status) "
    "SELECT r.delivery_status, MIN(review_score) AS min_score, "
    "LEAST(q1, MIN(review_score) FILTER (WHERE review_score >= q1 - 1.5 * (q3 - q1))) AS whisker_low, q1, "
    "MEDIAN(review_score) AS median, q3, "
    "GREATEST(q3, MAX(review_score) FILTER (WHERE review_score <= q3 + 1.5 * (q3 - q1))) AS whisker_high, "
    "MAX(review_score) AS max_score, AVG(review_score) AS mean_score "
    "FROM x_review r JOIN q USING (delivery_status) GROUP BY r.delivery_status, q1, q3"
)

# Every pair of a delayed and a punctual review, weighed by score counts; the
# normal tail by Simpson's rule over [0, |z|] in 2000 strips.
_U_TEST = (
    "WITH v AS (SELECT review_score AS s, COUNT(*) FILTER (WHERE is_delayed) * 1.0 AS a, "
    "COUNT(*) FILTER (WHERE NOT is_delayed) * 1.0 AS b FROM x_review GROUP BY 1), "
    "k AS (SELECT SUM(x.a * y.b * CASE WHEN x.s > y.s THEN 1 WHEN x.s = y.s THEN 0.5 ELSE 0 END) AS u "
    "FROM v x, v y), "
    "z AS (SELECT SUM(a) AS n1, SUM(b) AS n2, SUM(POWER(a + b, 3) - (a + b)) AS tied FROM v), "
    "t AS (SELECT n1, n2, u AS u_statistic, (n1 * n2 / 2 - u - 0.5) "
    "/ SQRT(n1 * n2 / 12 * (n1 + n2 + 1 - tied / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM z, k) "
    "SELECT t.*, 0.5 - SIGN(z) * (SELECT (ABS(z) / 2000 / 3) * SUM("
    "CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * "
    "EXP(-POWER(ABS(z) * i / 2000, 2) / 2) / SQRT(2 * PI())) "
    "FROM (SELECT UNNEST(RANGE(2001)) AS i)) AS p_value FROM t"
)

_CHI_SQUARE = (
    "WITH r AS (SELECT delivery_status, SUM(seen) AS rt FROM x_cell GROUP BY 1), "
    "c AS (SELECT review_score, SUM(seen) AS ct FROM x_cell GROUP BY 1), "
    "g AS (SELECT rt * ct / (SELECT SUM(seen) FROM x_cell) AS e, COALESCE(x.seen, 0) AS o "
    "FROM r CROSS JOIN c LEFT JOIN x_cell x ON x.delivery_status = r.delivery_status "
    "AND x.review_score = c.review_score), "
    "s AS (SELECT SUM(o) AS n, SUM(POWER(o - e, 2) / e) AS chi_square FROM g) "
    "SELECT n, ((SELECT COUNT(*) FROM r) - 1) * ((SELECT COUNT(*) FROM c) - 1) AS degrees_of_freedom, "
    # upper tail for four degrees of freedom
    "chi_square, EXP(-chi_square / 2) * (1 + chi_square / 2) AS p_value FROM s"
)


def _feeds() -> str:
    return " UNION ALL ".join(
        f"SELECT '{chart}' AS chart, customer_segment, {measure} AS value, "
        f"ROW_NUMBER() OVER (ORDER BY {measure} DESC, customer_segment) AS place FROM x_summary"
        for chart, measure in (("customers", "customer_count"), ("revenue", "total_revenue"))
    )


def _top_share() -> str:
    chosen = "FILTER (WHERE customer_segment IN ('Champions', 'Promising High-Spenders'))"
    return (
        f"SELECT {_per(f'SUM(customer_count) {chosen}', 'SUM(customer_count)')} AS customer_pct, "
        f"{_per(f'SUM(total_revenue) {chosen}', 'SUM(total_revenue)')} AS revenue_pct FROM x_summary"
    )


_IDS_AS_TEXT = {
    "read_customers": (
        f"SELECT {_text('customer_id', 'customer_unique_id')}, customer_zip_code_prefix, customer_city, "
        "customer_state FROM m_customers",
        "customer_id:s customer_unique_id:s customer_zip_code_prefix:s customer_city:s customer_state:s",
    ),
    "read_orders": (
        f"SELECT * REPLACE ({_text('order_id', 'customer_id')}) FROM m_orders",
        "order_id:s customer_id:s order_status:s order_purchase_timestamp:t order_approved_at:t "
        "order_delivered_carrier_date:t order_delivered_customer_date:t order_estimated_delivery_date:t",
    ),
    "read_order_items": (
        f"SELECT * REPLACE ({_text('order_id', 'product_id', 'seller_id')}) FROM m_order_items",
        "order_id:s order_item_id:i product_id:s seller_id:s shipping_limit_date:t price:d2 freight_value:d2",
    ),
    "read_order_payments": (
        f"SELECT * REPLACE ({_text('order_id')}) FROM m_order_payments",
        "order_id:s payment_sequential:i payment_type:s payment_installments:i payment_value:d2",
    ),
    "read_order_reviews": (
        f"SELECT * REPLACE ({_text('review_id', 'order_id')}) FROM m_order_reviews",
        "review_id:s order_id:s review_score:i review_comment_title:s review_comment_message:s "
        "review_creation_date:t review_answer_timestamp:t",
    ),
    "read_products": (
        f"SELECT * REPLACE ({_text('product_id')}, LOWER(product_category_name) AS product_category_name) "
        "FROM m_products",
        "product_id:s product_category_name:s product_name_lenght:i product_description_lenght:i "
        "product_photos_qty:i product_weight_g:i product_length_cm:i product_height_cm:i product_width_cm:i",
    ),
    "read_sellers": (
        f"SELECT * REPLACE ({_text('seller_id')}) FROM m_sellers",
        "seller_id:s seller_zip_code_prefix:s seller_city:s seller_state:s",
    ),
    "read_translation": (
        "SELECT LOWER(product_category_name) AS product_category_name, product_category_name_english "
        "FROM m_translation",
        "product_category_name:s product_category_name_english:s",
    ),
    "read_geolocation": (
        "SELECT * FROM m_geolocation",
        "geolocation_zip_code_prefix:s geolocation_lat:f geolocation_lng:f geolocation_city:s geolocation_state:s",
    ),
}

# key → (result, typed output list[, order and limit])
EXPECTED: dict[str, tuple[str, ...]] = {
    **_IDS_AS_TEXT,
    "line_ending_cleanup": (
        "SELECT * FROM m_sellers",
        "seller_id:i seller_zip_code_prefix:s seller_city:s seller_state:s",
    ),
    "materialize_tables": (_materialized(), "table_name:s total_rows:i"),
    "rejected_rows": (
        "SELECT CAST(order_id AS VARCHAR) AS order_id, payment_sequential, payment_type, "
        "CAST(NULL AS BIGINT) AS payment_installments, payment_value, "
        "CONCAT(order_id, ',', payment_sequential, ',', payment_type, ',unknown,', payment_value) AS raw_line "
        "FROM m_order_payments WHERE order_id % 97 = 0",
        "order_id:s payment_sequential:i payment_type:s payment_installments:i payment_value:d2 raw_line:s",
    ),
    "load_table": (
        "SELECT 'order_payments' AS table_name, COUNT(*) AS lines, "
        "COUNT(*) FILTER (WHERE order_id % 97 <> 0) AS loaded, "
        "COUNT(*) FILTER (WHERE order_id % 97 = 0) AS rejected FROM m_order_payments",
        "table_name:s lines:i loaded:i rejected:i",
    ),
    "key_spellings": (
        "SELECT key_name, stored, COUNT(*) AS spellings, SUM(n) AS total_rows FROM x_stored GROUP BY key_name, stored",
        "key_name:s stored:s spellings:i total_rows:i",
    ),
    "state_revenue_any_spelling": (
        "SELECT stored AS customer_state, COUNT(DISTINCT customer_unique_id) AS unique_customers, "
        "COUNT(DISTINCT order_id) AS total_orders, SUM(price + freight_value) AS total_revenue, "
        f"{_per('SUM(freight_value)', 'COUNT(freight_value)', 1)} AS avg_freight_paid "
        "FROM m_order_items JOIN x_done USING (order_id) JOIN x_customers_any USING (customer_id) "
        "JOIN x_stored ON key_name = 'state' AND spelling = customer_state GROUP BY stored",
        _STATE,
    ),
    "category_revenue_any_spelling": (
        "SELECT COALESCE(l.english, l.plain, 'Unknown') AS category_english, "
        "COUNT(DISTINCT i.order_id) AS total_orders, COUNT(i.order_item_id) AS total_units_sold, "
        f"SUM(i.price) AS total_sales_value, {_per('SUM(i.price)', 'COUNT(i.price)', 1)} AS avg_item_price, "
        f"{_per('SUM(s.score)', 'COUNT(s.score)', 1)} AS avg_customer_rating "
        "FROM m_order_items i JOIN x_done o USING (order_id) JOIN x_label_any l USING (product_id) "
        "LEFT JOIN x_score s USING (order_id) GROUP BY 1",
        _CATEGORY,
    ),
    "removed_rows": (
        "SELECT 'repeated key' AS removal_reason, COUNT(*) AS removed_rows, COUNT(*) AS later_copies "
        "FROM m_orders WHERE order_id % 89 = 0 HAVING COUNT(*) > 0 UNION ALL "
        # the first row without an id stays
        "SELECT 'missing key', COUNT(*) - 1, 0 FROM m_orders WHERE order_id % 83 = 0 HAVING COUNT(*) > 1",
        "removal_reason:s removed_rows:i later_copies:i",
    ),
    "write_rfm_output": _RFM_FILE,
    "write_segment_summary": _SUMMARY,
    "export_view": _GROWTH,
    "publish_view": _GROWTH,
    "preview": (
        "SELECT * FROM x_transit ORDER BY order_id LIMIT 5",
        "order_id:i delivery_days:i is_delayed:b order_month:s",
    ),
    "row_count_audit": (_shape("rows"), "table_name:s total_rows:i"),
    "table_shapes": (_shape("both"), "table_name:s total_rows:i total_columns:i"),
    "schema_info": (_schema_info(), "column_no:i column_name:s dtype:s non_null_count:i"),
    "null_counts": (_null_counts(), "table_name:s column_name:s null_count:i null_pct:d2"),
    "duplicate_orders": (
        "SELECT order_id, COUNT(*) AS occurrence_count FROM m_order_items GROUP BY order_id HAVING COUNT(*) >= 2",
        "order_id:i occurrence_count:i",
    ),
    "duplicate_order_count": (
        "SELECT COUNT(*) AS duplicate_order_count FROM "
        "(SELECT order_id FROM m_order_items GROUP BY order_id HAVING COUNT(*) >= 2)",
        "duplicate_order_count:i",
    ),
    "duplicated_keys": (_duplicated_keys(), "table_name:s key_column:s duplicated_rows:i"),
    "customer_uniqueness_audit": (
        "SELECT COUNT(customer_id) AS total_order_customers, COUNT(DISTINCT customer_unique_id) AS total_unique_humans, "
        "COUNT(customer_id) - COUNT(DISTINCT customer_unique_id) AS repeat_customer_transactions FROM m_customers",
        "total_order_customers:i total_unique_humans:i repeat_customer_transactions:i",
    ),
    "order_status_audit": (
        "SELECT order_status, COUNT(*) AS total_orders, "
        f"COUNT(*) - COUNT({_ARRIVED}) AS missing_delivery_date_count, "
        f"{_per(f'COUNT(*) - COUNT({_ARRIVED})', 'COUNT(*)')} AS pct_missing FROM m_orders GROUP BY order_status",
        "order_status:s total_orders:i missing_delivery_date_count:i pct_missing:d2",
    ),
    "status_value_counts": (
        "SELECT order_status, COUNT(*) AS order_count FROM m_orders GROUP BY order_status",
        "order_status:s order_count:i",
    ),
    "date_boundaries": (
        f"SELECT MIN({_BOUGHT}) AS earliest_purchase, MAX({_BOUGHT}) AS latest_purchase, "
        f"DATESUB('month', MIN({_BOUGHT}), MAX({_BOUGHT})) AS active_months_span FROM m_orders",
        "earliest_purchase:t latest_purchase:t active_months_span:i",
    ),
    "primary_key_check": (
        _primary_keys(),
        "table_name:s key_columns:s total_rows:i null_key_rows:i repeated_keys:i surplus_rows:i",
    ),
    "foreign_key_check": (
        _foreign_keys(),
        "child_table:s parent_table:s key_column:s orphan_keys:i orphan_rows:i",
    ),
    "describe_rfm": (_profile(), "row_no:i statistic:s recency:f2 frequency:f2 monetary:f2"),
    "analysis_set_counts": (
        "SELECT COUNT(DISTINCT order_id) AS analysis_rows, COUNT(DISTINCT customer_unique_id) AS unique_customers, "
        "SUM(payment_value) AS total_payment_value FROM x_paid",
        "analysis_rows:i unique_customers:i total_payment_value:d2",
    ),
    "repeat_customer_rate": (
        "SELECT COUNT(*) AS unique_customers, COUNT(*) FILTER (WHERE n > 1) AS repeat_customers, "
        f"{_per('COUNT(*) FILTER (WHERE n > 1)', 'COUNT(*)')} AS repeat_pct FROM "
        "(SELECT c.customer_unique_id, COUNT(DISTINCT o.order_id) AS n FROM x_done o "
        "JOIN m_customers c USING (customer_id) GROUP BY 1)",
        "unique_customers:i repeat_customers:i repeat_pct:d2",
    ),
    "business_summary": (
        "SELECT COUNT(DISTINCT order_id) AS total_delivered_orders, "
        "COUNT(DISTINCT customer_unique_id) AS total_unique_buyers, COUNT(DISTINCT seller_id) AS active_sellers, "
        "SUM(price) AS total_item_gmv, SUM(freight_value) AS total_freight, "
        "SUM(price + freight_value) AS total_gross_revenue, "
        f"{_per('SUM(price)', 'COUNT(DISTINCT order_id)', 1)} AS avg_order_value, "
        f"{_per('COUNT(order_item_id)', 'COUNT(DISTINCT order_id)', 1)} AS avg_items_per_order FROM x_sales",
        "total_delivered_orders:i total_unique_buyers:i active_sellers:i total_item_gmv:d2 total_freight:d2 "
        "total_gross_revenue:d2 avg_order_value:d2 avg_items_per_order:d2",
    ),
    "payment_breakdown": (
        "SELECT payment_type, COUNT(order_id) AS transaction_count, "
        f"{_per('COUNT(order_id)', '(SELECT COUNT(order_id) FROM m_order_payments)')} AS transaction_share_pct, "
        "SUM(payment_value) AS total_payment_value, "
        f"{_per('SUM(payment_value)', '(SELECT SUM(payment_value) FROM m_order_payments)')} AS revenue_share_pct, "
        "AVG(payment_installments) AS avg_installments, "
        f"{_per('SUM(payment_value)', 'COUNT(payment_value)', 1)} AS avg_ticket_size "
        "FROM m_order_payments GROUP BY payment_type",
        "payment_type:s transaction_count:i transaction_share_pct:d2 total_payment_value:d2 revenue_share_pct:d2 "
        "avg_installments:d1 avg_ticket_size:d2",
    ),
    "state_revenue": ("SELECT * FROM x_state", _STATE),
    "state_revenue_top10": (
        "SELECT * FROM x_state ORDER BY total_revenue DESC, customer_state LIMIT 10",
        _STATE,
    ),
    "monthly_revenue_growth": _GROWTH,
    "category_revenue": ("SELECT * FROM x_category", _CATEGORY),
    "category_revenue_top10": (
        "SELECT * FROM x_category ORDER BY total_sales_value DESC, category_english LIMIT 3",
        _CATEGORY,
    ),
    "top_categories_all_orders": (
        "SELECT COALESCE(l.english, l.plain) AS category_english, SUM(i.price) AS price "
        "FROM m_order_items i JOIN x_label l USING (product_id) WHERE COALESCE(l.english, l.plain) IS NOT NULL "
        "GROUP BY 1 ORDER BY price DESC, category_english LIMIT 4",
        "category_english:s price:d2",
    ),
    "revenue_growth_multiple": (
        f"SELECT lo.monthly_revenue AS first_revenue, hi.monthly_revenue AS last_revenue, "
        "best.order_month AS peak_month, best.monthly_revenue AS peak_revenue, "
        f"{_per('hi.monthly_revenue', 'lo.monthly_revenue', 1)} AS growth_multiple FROM x_month lo, x_month hi, "
        "(SELECT * FROM x_month ORDER BY monthly_revenue DESC LIMIT 1) best "
        f"WHERE lo.order_month = '{GROWTH_MONTHS[0]}' AND hi.order_month = '{GROWTH_MONTHS[1]}'",
        "first_revenue:d2 last_revenue:d2 peak_month:s peak_revenue:d2 growth_multiple:d2",
    ),
    "delivery_by_state": (
        "SELECT customer_state, COUNT(order_id) AS delivered_orders, "
        f"AVG({_calendar(_ARRIVED, _BOUGHT)}) AS avg_delivery_days, "
        f"AVG({_calendar(_PROMISED, _BOUGHT)}) AS avg_estimated_days, "
        f"COUNT(*) FILTER (WHERE {_ARRIVED} > {_PROMISED}) AS delayed_orders, "
        f"{_per(f'COUNT(*) FILTER (WHERE {_ARRIVED} > {_PROMISED})', 'COUNT(order_id)')} AS delay_rate_pct "
        f"FROM x_done JOIN m_customers USING (customer_id) WHERE {_ARRIVED} IS NOT NULL GROUP BY customer_state",
        "customer_state:s delivered_orders:i avg_delivery_days:d1 avg_estimated_days:d1 delayed_orders:i "
        "delay_rate_pct:d2",
    ),
    "delay_review_impact": (
        f"SELECT CASE WHEN {_ARRIVED} > {_PROMISED} THEN 'Delayed Delivery' ELSE 'On-Time / Early Delivery' END "
        "AS delivery_performance, COUNT(review_id) AS total_reviews, AVG(review_score) AS avg_review_score, "
        f"{_per('COUNT(*) FILTER (WHERE review_score = 1)', 'COUNT(review_id)')} AS pct_1_star, "
        f"{_per('COUNT(*) FILTER (WHERE review_score = 5)', 'COUNT(review_id)')} AS pct_5_star "
        f"FROM x_done JOIN m_order_reviews USING (order_id) WHERE {_ARRIVED} IS NOT NULL GROUP BY 1",
        "delivery_performance:s total_reviews:i avg_review_score:d2 pct_1_star:d2 pct_5_star:d2",
    ),
    "delivered_enriched": (
        "SELECT * FROM x_transit",
        "order_id:i customer_id:i order_status:s order_purchase_timestamp:t order_approved_at:t "
        "order_delivered_carrier_date:t order_delivered_customer_date:t order_estimated_delivery_date:t "
        "delivery_days:i is_delayed:b order_month:s",
    ),
    "delivery_headline": (
        f"SELECT COUNT(*) AS delivered_orders, {_per('COUNT(*) FILTER (WHERE is_delayed)', 'COUNT(*)')} "
        "AS late_delivery_pct, AVG(delivery_days) AS avg_delivery_days FROM x_transit",
        "delivered_orders:i late_delivery_pct:e2 avg_delivery_days:e1",
    ),
    "monthly_order_counts": (
        "SELECT order_month AS month, COUNT(order_id) AS order_count FROM x_transit "
        "WHERE order_month IS NOT NULL GROUP BY order_month",
        "month:s order_count:i",
    ),
    "order_heatmap": (
        _heatmap(),
        "day_no:i dow:s " + " ".join(f"h{h:02d}:i" for h in range(24)),
    ),
    "delivery_time_histogram": (
        _HISTOGRAM,
        "bin_no:i bin_start:f bin_end:f order_count:i mean_days:f",
    ),
    "delivery_time_kde": (_DENSITY, "point:i days:f density:f"),
    "delivery_median": (
        "SELECT MEDIAN(delivery_days) AS median_delivery_days, COUNT(delivery_days) AS timed_orders FROM x_transit",
        "median_delivery_days:f timed_orders:i",
    ),
    "delivered_share": (
        "SELECT COUNT(*) AS total_orders, (SELECT COUNT(*) FROM x_done) AS delivered_orders, "
        f"{_per('(SELECT COUNT(*) FROM x_done)', 'COUNT(*)')} AS delivered_pct FROM m_orders",
        "total_orders:i delivered_orders:i delivered_pct:d2",
    ),
    "freight_vs_delivery_by_state": (
        "SELECT customer_state, s.avg_freight_paid, d.delivered_orders, d.avg_delivery_days FROM x_state s JOIN "
        f"(SELECT customer_state, COUNT(*) AS delivered_orders, AVG({_calendar(_ARRIVED, _BOUGHT)}) "
        "AS avg_delivery_days FROM x_done JOIN m_customers USING (customer_id) "
        f"WHERE {_ARRIVED} IS NOT NULL GROUP BY customer_state) d USING (customer_state)",
        "customer_state:s delivered_orders:i avg_freight_paid:d2 avg_delivery_days:d1",
    ),
    "delay_vs_review_trend": (
        f"SELECT {_month(_BOUGHT)} AS order_month, COUNT(*) AS total_orders, "
        f"SUM(is_delivery_delayed) AS delayed_orders, {_per('SUM(review_score)', 'COUNT(review_score)', 1)} "
        f"AS avg_review_score, {_per('SUM(is_delivery_delayed)', 'COUNT(*)')} AS delay_rate_pct "
        "FROM x_master GROUP BY 1",
        "order_month:s total_orders:i delayed_orders:i avg_review_score:d2 delay_rate_pct:d2",
    ),
    "cohort_retention_counts": (
        "SELECT *, month_0 AS month_0_base FROM x_retention",
        "cohort_month:s month_0_base:i month_1:i month_2:i month_3:i month_6:i month_12:i",
    ),
    "cohort_retention_pct": (
        "SELECT cohort_month, month_0 AS cohort_size, "
        + ", ".join(f"{_per(f'month_{k}', 'month_0')} AS retention_month_{k}_pct" for k in (1, 2, 3, 6))
        + " FROM x_retention",
        "cohort_month:s cohort_size:i "
        + " ".join(f"retention_month_{k}_pct:d2" for k in (1, 2, 3, 6)),
    ),
    "cohort_retention": (
        "SELECT *, month_0 AS month_0_base, "
        + ", ".join(f"{_per(f'month_{k}', 'month_0')} AS retention_m{k}_pct" for k in (1, 3, 6))
        + " FROM x_retention",
        "cohort_month:s month_0_base:i month_1:i month_2:i month_3:i month_6:i month_12:i "
        "retention_m1_pct:d2 retention_m3_pct:d2 retention_m6_pct:d2",
    ),
    "customer_rfm_raw": (
        "SELECT * FROM x_rfm",
        "customer_unique_id:i recency_days:i frequency_orders:i monetary_spend:d2",
    ),
    "rfm_scores": (
        "SELECT * FROM x_scored",
        "customer_unique_id:i recency_days:i frequency_orders:i monetary_spend:d2 r_score:i f_score:i m_score:i",
    ),
    "rfm_customer_segments": (
        "SELECT * FROM x_seven",
        "customer_unique_id:i recency_days:i frequency_orders:i monetary_spend:d2 r_score:i f_score:i m_score:i "
        "rfm_code:s customer_segment:s",
    ),
    "rfm_top100": (
        "SELECT * FROM x_six ORDER BY monetary_spend DESC, customer_unique_id LIMIT 100",
        "customer_unique_id:i recency_days:i frequency_orders:i monetary_spend:d2 rfm_code:s customer_segment:s",
    ),
    "rfm_segment_summary_sql": (
        "SELECT customer_segment, COUNT(*) AS customer_count, "
        f"{_per('COUNT(*)', '(SELECT COUNT(*) FROM x_six)')} AS pct_of_customers, "
        f"SUM(monetary_spend) AS total_revenue, {_per('SUM(monetary_spend)', 'COUNT(monetary_spend)', 1)} "
        "AS avg_spend_per_customer FROM x_six GROUP BY customer_segment",
        "customer_segment:s customer_count:i pct_of_customers:d2 total_revenue:d2 avg_spend_per_customer:d2",
    ),
    "rfm_pandas": _RFM_FILE,
    "rfm_segment_summary": _SUMMARY,
    "segment_value_counts": (
        "SELECT customer_segment, COUNT(*) AS customer_count FROM x_noted GROUP BY customer_segment",
        "customer_segment:s customer_count:i",
    ),
    "segment_chart_feeds": (_feeds(), "chart:s customer_segment:s value:d2 place:i"),
    "top_share": (_top_share(), "customer_pct:d1 revenue_pct:d1"),
    "seller_sales": (
        "SELECT * FROM x_seller",
        "seller_id:i seller_state:s seller_gmv:d2 units_sold:i",
    ),
    "seller_pareto": (
        f"SELECT * FROM x_ranked WHERE seller_rank IN {PARETO_RANKS} "
        "OR ROUND(CAST(cumulative_revenue_pct AS DECIMAL(30,10)), 0) IN (20, 50, 80)",
        "seller_id:i seller_state:s seller_gmv:d2 units_sold:i seller_rank:i seller_percentile:d2 "
        "cumulative_revenue_pct:d2",
    ),
    "top20_sellers": (
        f"SELECT *, {_per('seller_gmv', 'SUM(seller_gmv) OVER ()')} AS gmv_share_pct FROM x_seller "
        "ORDER BY seller_gmv DESC, seller_id LIMIT 20",
        "seller_id:i seller_state:s seller_city:s seller_gmv:d2 total_freight_earned:d2 total_orders:i "
        "units_sold:i avg_review_score:d2 gmv_share_pct:d2",
    ),
    "order_master": (
        "SELECT * FROM x_master",
        "order_id:i customer_id:i customer_unique_id:i customer_city:s customer_state:s order_status:s "
        "order_purchase_timestamp:t order_approved_at:t order_delivered_carrier_date:t "
        "order_delivered_customer_date:t order_estimated_delivery_date:t delivery_days:i is_delivery_delayed:i "
        "review_score:d4",
    ),
    "order_item_details": (
        "SELECT i.order_id, i.order_item_id, i.product_id, COALESCE(l.english, l.plain, 'Other') AS category_english, "
        "i.seller_id, s.seller_state, s.seller_city, i.price, i.freight_value, "
        "i.price + i.freight_value AS total_item_cost "
        "FROM m_order_items i JOIN x_label l USING (product_id) JOIN m_sellers s USING (seller_id)",
        "order_id:i order_item_id:i product_id:i category_english:s seller_id:i seller_state:s seller_city:s "
        "price:d2 freight_value:d2 total_item_cost:d2",
    ),
    "review_delay_frame": (
        "SELECT * FROM x_review",
        "order_id:i order_purchase_timestamp:t order_delivered_customer_date:t order_estimated_delivery_date:t "
        "review_score:i is_delayed:b delivery_status:s delay_days:i delivery_days:i",
    ),
    "delay_split_counts": (
        "SELECT COUNT(*) AS total_orders, COUNT(*) FILTER (WHERE is_delayed) AS delayed_orders, "
        f"{_per('COUNT(*) FILTER (WHERE is_delayed)', 'COUNT(*)')} AS delayed_pct, "
        "COUNT(*) FILTER (WHERE NOT is_delayed) AS ontime_orders, "
        f"{_per('COUNT(*) FILTER (WHERE NOT is_delayed)', 'COUNT(*)')} AS ontime_pct FROM x_review",
        "total_orders:i delayed_orders:i delayed_pct:e2 ontime_orders:i ontime_pct:e2",
    ),
    "delay_severity": (_SEVERITY, "place:i delay_bucket:s mean:f count:i"),
    "review_box_stats": (
        _BOX,
        "delivery_status:s min_score:f whisker_low:f q1:f median:f q3:f whisker_high:f max_score:f mean_score:f",
    ),
    "review_share_by_status": (
        "SELECT delivery_status, "
        + ", ".join(
            f"{_per(f'COUNT(*) FILTER (WHERE review_score = {v})', 'COUNT(review_score)')} AS score_{v}_pct"
            for v in (1, 2, 3, 4, 5)
        )
        + f", {_per('COUNT(*) FILTER (WHERE review_score NOT IN (1, 2, 3, 4, 5))', 'COUNT(review_score)')} AS score_other_pct"
        + " FROM x_status LEFT JOIN x_review USING (delivery_status) GROUP BY delivery_status",
        "delivery_status:s " + " ".join(f"score_{v}_pct:f" for v in (1, 2, 3, 4, 5, "other")),
    ),
    "delay_score_correlation": (
        "SELECT COUNT(*) AS delayed_reviews, CORR(review_score, delay_days) AS correlation, "
        "REGR_SLOPE(review_score, delay_days) AS slope FROM x_review WHERE is_delayed",
        "delayed_reviews:i correlation:f slope:f",
    ),
    "cohort_descriptives": (
        "SELECT * FROM x_descriptive",
        "cohort:s sample_size:i mean_score:e3 median_score:f std_deviation:e3 one_star_pct:e3 five_star_pct:e3",
    ),
    "welch_t_test": (
        "SELECT * FROM x_welch",
        "n1:i n2:i mean1:f mean2:f t_statistic:f degrees_of_freedom:f cohens_d:f p_value:f",
    ),
    "cohens_d": ("SELECT * FROM x_t", "n1:i n2:i var1:f var2:f cohens_d:f"),
    "mean_difference": (
        "SELECT *, mean1 - mean2 AS mean_difference FROM x_moment",
        "n1:i mean1:f n2:i mean2:f mean_difference:f",
    ),
    "mann_whitney_u": (_U_TEST, "n1:i n2:i u_statistic:f z:f p_value:f"),
    "contingency_table": (
        f"SELECT delivery_status, {_SCORE_COLUMNS}, "
        "COUNT(*) FILTER (WHERE review_score NOT IN (1, 2, 3, 4, 5)) AS score_other "
        "FROM x_review GROUP BY delivery_status",
        "delivery_status:s " + " ".join(f"score_{v}:i" for v in (1, 2, 3, 4, 5, "other")),
    ),
    "chi_square_test": (_CHI_SQUARE, "n:i degrees_of_freedom:i chi_square:f p_value:f"),
    "significance_decision": (
        "SELECT p_value, 0.05 AS alpha, CASE WHEN p_value < 0.05 THEN 'REJECT H0' ELSE 'FAIL TO REJECT H0' END "
        "AS decision, ABS(cohens_d) AS effect_size FROM x_welch",
        "p_value:f alpha:f decision:s effect_size:f",
    ),
    "one_star_risk_ratio": (
        "SELECT d.p AS delayed_one_star_pct, o.p AS ontime_one_star_pct, d.p / NULLIF(o.p, 0) AS risk_ratio FROM "
        "(SELECT ROUND(one_star_pct, 3) AS p FROM x_descriptive WHERE cohort = 'Delayed Orders') d, "
        "(SELECT ROUND(one_star_pct, 3) AS p FROM x_descriptive WHERE cohort <> 'Delayed Orders') o",
        "delayed_one_star_pct:f ontime_one_star_pct:f risk_ratio:d2",
    ),
}

# view → key of the statement that yields the same rows
_VIEW_KEYS = (
    "row_count_audit duplicate_orders customer_uniqueness_audit order_status_audit date_boundaries "
    "repeat_customer_rate business_summary payment_breakdown state_revenue monthly_revenue_growth "
    "category_revenue delivery_by_state delay_review_impact order_master order_item_details "
    "rfm_customer_segments rfm_top100 top20_sellers"
).split()


def _view_rows() -> str:
    """Rows per view; the views with other parameters or inputs than their key are spelled out."""
    sizes = {f"vw_{key}": f"({EXPECTED[key][0]})" for key in _VIEW_KEYS}
    sizes["vw_duplicate_orders"] = (
        "(SELECT order_id FROM m_orders GROUP BY order_id HAVING COUNT(*) > 1)"
    )
    sizes["vw_seller_pareto"] = (
        "(SELECT * FROM x_ranked WHERE seller_rank IN (1, 10, 50, 100, 500, 1000) "
        "OR ROUND(CAST(cumulative_revenue_pct AS DECIMAL(30,10)), 0) IN (20, 50, 80))"
    )
    for name in ("vw_cohort_retention", "vw_cohort_retention_counts", "vw_cohort_retention_pct"):
        first, last = (12 * 2017 + 0, 12 * 2018 + 0)
        sizes[name] = f"(SELECT DISTINCT born FROM x_cohort WHERE born BETWEEN {first} AND {last})"
    return " UNION ALL ".join(
        f"SELECT '{view}' AS view_name, (SELECT COUNT(*) FROM {rows}) AS total_rows"
        for view, rows in sizes.items()
    )


EXPECTED["list_views"] = (_view_rows(), "view_name:s total_rows:i")


def oracle_sql() -> dict[str, str]:
    return {key: statement(*parts) for key, parts in EXPECTED.items()}
