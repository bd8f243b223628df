"""Independent ANSI-style SQL for every registered query, for checking in another engine.

The statements join items with payments row by row and never use the per-order sums
the DataFrame operators rely on. Each named step below is a CTE; a query's text is the
steps it mentions, directly or not, followed by its own SELECT. Rounded quotients are
spelled as whole-number divisions, which are exact and round half away from zero.
"""

from __future__ import annotations

import re

_MODULUS, _MULTIPLIER = 2147483647, 48271
_FEATURES = (
    "weekly_revenue",
    "revenue_vs_baseline",
    "cancellation_rate",
    "avg_order_value",
    "z_score",
    "orders_count",
)


def _quotient(num: str, den: str, digits: int) -> str:
    """num / den for whole numbers, rounded half away from zero; null for den = 0."""
    n, d = f"CAST({num} AS HUGEINT)", f"CAST({den} AS HUGEINT)"
    unit = 10**digits
    return (
        f"(CASE WHEN {d} <> 0 THEN CAST(SIGN({n}) * SIGN({d}) * "
        f"((2 * ABS({n}) * {unit} + ABS({d})) // (2 * ABS({d}))) AS DOUBLE) / {unit} END)"
    )


def _cents(x: str) -> str:
    return f"ROUND(({x}) * 100)"


def _mean(x: str, digits: int = 2) -> str:
    """Mean of a decimal expression."""
    return _quotient(f"SUM({x}) * 100", f"COUNT({x}) * 100", digits)


def _pct(part: str, whole: str, digits: int = 2) -> str:
    return _quotient(f"100 * ({part})", whole, digits)


def _dbl(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def _big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def _money_text(x: str) -> str:
    return f"'R$' || format('{{:,.0f}}', {x})"


def _draw(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 7) AS BIGINT)"


def _mix(x: str) -> str:
    return f"((({x}) * {_MULTIPLIER} % {_MODULUS}) * {_MULTIPLIER} % {_MODULUS})"


_WEEK = "strftime(order_purchase_timestamp, '%Y-W%W')"
_MONTH = "strftime(order_purchase_timestamp, '%Y-%m')"
_CANCELED = "SUM(CASE WHEN order_status = 'canceled' THEN 1 ELSE 0 END)"
_EIGHT = "(PARTITION BY category_en ORDER BY year_week ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)"

# The domain tables over the star schema.
_TABLES = {
    "x_orders": """
        SELECT o.o_orderkey AS order_id, o.o_orderkey AS customer_id,
               CASE WHEN o.o_orderstatus = 'P' AND o.o_orderpriority = '1-URGENT' THEN 'canceled'
                    WHEN o.o_orderstatus = 'P' THEN 'shipped' ELSE 'delivered' END AS order_status,
               o.o_orderdate AS order_purchase_timestamp,
               s.ship AS order_delivered_customer_date
        FROM orders o
        LEFT JOIN (SELECT l_orderkey, MAX(l_shipdate) AS ship FROM lineitem GROUP BY l_orderkey) s
               ON o.o_orderkey = s.l_orderkey""",
    "x_order_items": """
        SELECT l_orderkey AS order_id, l_partkey AS product_id, l_suppkey AS seller_id,
               CAST(l_extendedprice AS DECIMAL(18,2)) AS price,
               CAST(CAST(l_extendedprice AS DECIMAL(14,2)) * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(18,2))
                   AS freight_value
        FROM lineitem""",
    "x_order_payments": """
        SELECT l_orderkey AS order_id, l_linestatus AS payment_type,
               CAST(SUM(CAST(CAST(l_extendedprice AS DECIMAL(14,2))
                   * CAST(1 - CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(4,2))
                   * CASE WHEN l_orderkey % 997 = 0 THEN 0.0
                          WHEN l_orderkey % 40 = 0 THEN 0.10
                          WHEN l_orderkey % 40 = 1 THEN 0.38 ELSE 1.0 END AS DECIMAL(18,2))) AS DECIMAL(18,2))
                   AS payment_value
        FROM lineitem GROUP BY l_orderkey, l_linestatus""",
    "x_products": "SELECT p_partkey AS product_id, NULLIF(p_brand, 'Brand#13') AS product_category_name FROM part",
    "x_category_xlat": """
        SELECT DISTINCT p_brand AS product_category_name,
               LOWER(REPLACE(p_brand, '#', '_')) AS product_category_name_english
        FROM part WHERE p_brand NOT IN ('Brand#7', 'Brand#13')""",
    "x_customers": "SELECT o_orderkey AS customer_id, o_custkey AS customer_unique_id FROM orders",
    "x_sellers": """
        SELECT s.s_suppkey AS seller_id, n.n_name AS seller_state, s.s_name AS seller_city
        FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey""",
}

_STEPS: dict[str, str] = {
    # rows the reports are defined over
    "paid_orders": """
        SELECT o.*, p.payment_value FROM x_orders o JOIN x_order_payments p ON o.order_id = p.order_id
        WHERE p.payment_value > 0""",
    "named": """
        SELECT p.product_id, COALESCE(x.product_category_name_english, p.product_category_name) AS category
        FROM x_products p LEFT JOIN x_category_xlat x ON p.product_category_name = x.product_category_name""",
    "fan": """
        SELECT o.*, i.product_id, i.seller_id, i.price + i.freight_value AS listed
        FROM paid_orders o JOIN x_order_items i ON o.order_id = i.order_id""",
    "fan_named": """
        SELECT f.*, c.category, COALESCE(c.category, 'unknown') AS category_en
        FROM fan f JOIN named c ON f.product_id = c.product_id""",
    # trends
    "weekly": f"""
        SELECT {_WEEK} AS year_week, SUM(payment_value) AS revenue, COUNT(DISTINCT order_id) AS orders_count
        FROM paid_orders WHERE order_status = 'delivered' AND order_purchase_timestamp IS NOT NULL GROUP BY 1""",
    "weekly_wow": f"""
        SELECT year_week, {_dbl('revenue')} AS weekly_revenue, orders_count,
               {_dbl('prior')} AS prev_week_revenue, {_dbl('revenue - prior')} AS wow_change,
               {_pct('(revenue - prior) * 100', 'prior * 100')} AS wow_pct
        FROM (SELECT *, LAG(revenue) OVER (ORDER BY year_week) AS prior FROM weekly)""",
    "category_week": f"""
        SELECT {_WEEK} AS year_week, category_en, COUNT(DISTINCT order_id) AS orders_count,
               {_dbl('SUM(payment_value)')} AS weekly_revenue, {_mean('payment_value')} AS avg_order_value,
               {_big(_CANCELED)} AS cancellations
        FROM fan_named WHERE order_purchase_timestamp IS NOT NULL GROUP BY 1, 2""",
    "ltv": """
        SELECT c.customer_unique_id, CAST(SUM(p.payment_value) AS DOUBLE) AS lifetime_value
        FROM x_customers c JOIN paid_orders p ON c.customer_id = p.customer_id
        WHERE p.order_status = 'delivered' GROUP BY 1""",
    "tiers": """
        SELECT l.customer_unique_id, l.lifetime_value,
               CASE WHEN lifetime_value <= 0 THEN NULL WHEN lifetime_value <= q40 THEN 'Low'
                    WHEN lifetime_value <= q80 THEN 'Mid' ELSE 'High' END AS tier
        FROM ltv l, (SELECT quantile_cont(lifetime_value, 0.4) AS q40, quantile_cont(lifetime_value, 0.8) AS q80
                     FROM ltv)""",
    "monthly": f"""
        SELECT {_MONTH} AS year_month, COUNT(DISTINCT order_id) AS orders_count,
               {_dbl('SUM(payment_value)')} AS monthly_revenue, {_mean('payment_value')} AS monthly_aov,
               COUNT(DISTINCT customer_id) AS unique_customers
        FROM paid_orders WHERE order_status = 'delivered' AND order_purchase_timestamp IS NOT NULL GROUP BY 1""",
    "top20": f"""
        SELECT category_en, COUNT(DISTINCT order_id) AS orders_count,
               {_dbl('SUM(payment_value)')} AS total_revenue, {_mean('payment_value')} AS avg_order_value,
               {_pct(_CANCELED, 'COUNT(*)')} AS cancel_rate_pct
        FROM fan_named GROUP BY 1 ORDER BY total_revenue DESC, category_en LIMIT 20""",
    # baseline
    "lagged": f"""
        SELECT *, {_cents('weekly_revenue')} AS cents,
               COUNT(*) OVER w AS seen, SUM({_big(_cents('weekly_revenue'))}) OVER w AS past,
               STDDEV_SAMP(weekly_revenue) OVER w AS dev,
               quantile_cont({_cents('weekly_revenue')}, 0.5) OVER w AS mid,
               AVG(orders_count) OVER w AS usual_orders
        FROM category_week WINDOW w AS {_EIGHT}""",
    "banded": """
        SELECT *, CASE WHEN seen >= 4 THEN CAST(past AS DOUBLE) / seen / 100 END AS mean,
               CASE WHEN seen >= 4 THEN dev END AS sd
        FROM lagged""",
    "bounded": """
        SELECT *, mean + 2 * sd AS hi, CASE WHEN mean - 2 * sd < 0 THEN 0 ELSE mean - 2 * sd END AS lo FROM banded""",
    "base": f"""
        SELECT year_week, category_en, orders_count, weekly_revenue, avg_order_value, cancellations,
               CASE WHEN seen >= 4 THEN {_quotient('past', 'seen * 100', 2)} END AS rolling_mean,
               ROUND(sd, 2) AS rolling_std,
               CASE WHEN seen >= 4 THEN ROUND(mid) / 100 END AS rolling_median,
               ROUND(hi, 2) AS upper_bound, ROUND(lo, 2) AS lower_bound,
               ROUND((weekly_revenue - mean) / NULLIF(sd, 0), 2) + 0.0 AS z_score,
               COALESCE(weekly_revenue < lo OR weekly_revenue > hi, FALSE) AS is_anomaly,
               ROUND(CASE WHEN lo - weekly_revenue < 0 THEN 0 ELSE lo - weekly_revenue END, 2) AS revenue_at_risk
        FROM bounded""",
    "zflags": f"""
        SELECT *,
               CASE WHEN z_score <= -3 THEN 'Critical' WHEN z_score <= -2.5 THEN 'High'
                    WHEN z_score <= -2 THEN 'Medium' END AS severity,
               rolling_mean AS expected_revenue, weekly_revenue AS actual_revenue,
               ({_cents('rolling_mean')} - {_cents('weekly_revenue')}) / 100 AS revenue_gap,
               {_pct(_cents('rolling_mean') + ' - ' + _cents('weekly_revenue'), _cents('rolling_mean'), 1)}
                   AS revenue_gap_pct
        FROM base WHERE z_score < -2.0 AND rolling_mean >= 500""",
    "big15": """
        SELECT category_en FROM base GROUP BY 1
        ORDER BY SUM(CAST(weekly_revenue AS DECIMAL(18,2))) DESC, 1 LIMIT 15""",
    "heat": """
        SELECT category_en, year_week, AVG(z_score) AS z_score FROM base
        WHERE z_score IS NOT NULL AND category_en IN (SELECT category_en FROM big15)
          AND year_week IN (SELECT DISTINCT year_week FROM base WHERE z_score IS NOT NULL
                AND category_en IN (SELECT category_en FROM big15) ORDER BY 1 DESC LIMIT 20)
        GROUP BY 1, 2""",
    # detectors
    "discounts": f"""
        SELECT order_id, {_dbl('SUM(listed)')} AS list_price, {_dbl('SUM(payment_value)')} AS actual_paid,
               {_pct('(SUM(listed) - SUM(payment_value)) * 100', 'SUM(listed) * 100')} AS discount_pct
        FROM fan WHERE order_status = 'delivered' GROUP BY order_id""",
    "l1_20": "SELECT * FROM discounts WHERE discount_pct > 20",
    "l1_30": "SELECT * FROM discounts WHERE discount_pct > 30",
    "refund_rate": f"""
        SELECT {_WEEK} AS year_week, c.category AS category_en, COUNT(DISTINCT o.order_id) AS total_orders,
               {_big(_CANCELED)} AS cancellations,
               {_pct(_CANCELED, 'COUNT(DISTINCT o.order_id)')} AS cancel_rate_pct
        FROM x_orders o JOIN x_order_items i ON o.order_id = i.order_id
        JOIN named c ON i.product_id = c.product_id
        WHERE o.order_purchase_timestamp IS NOT NULL AND c.category IS NOT NULL GROUP BY 1, 2""",
    "refund_past": f"""
        SELECT *, CASE WHEN COUNT(*) OVER w >= 4 THEN AVG(cancel_rate_pct) OVER w END AS m,
               CASE WHEN COUNT(*) OVER w >= 4 THEN STDDEV_SAMP(cancel_rate_pct) OVER w END AS s
        FROM refund_rate WINDOW w AS {_EIGHT}""",
    "l2": """
        SELECT year_week, category_en, total_orders, cancellations, cancel_rate_pct,
               ROUND(m, 6) AS rolling_cancel_mean, ROUND(s, 6) AS rolling_cancel_std,
               ROUND((cancel_rate_pct - m) / NULLIF(s, 0), 6) AS cancel_z_score, TRUE AS is_refund_spike
        FROM refund_past WHERE (cancel_rate_pct - m) / NULLIF(s, 0) > 2""",
    "activity": """
        SELECT c.customer_unique_id, MAX(p.order_purchase_timestamp) AS last_order_date,
               COUNT(DISTINCT p.order_id) AS total_orders, CAST(SUM(p.payment_value) AS DOUBLE) AS lifetime_value
        FROM x_customers c JOIN paid_orders p ON c.customer_id = p.customer_id GROUP BY 1""",
    "inactive": """
        SELECT a.*, lifetime_value >= q80 AS is_high_value,
               CAST(floor((epoch(last_day) - epoch(last_order_date)) / 86400) AS INTEGER) AS days_inactive,
               TRUE AS is_churned
        FROM activity a, (SELECT quantile_cont(lifetime_value, 0.8) AS q80, MAX(last_order_date) AS last_day
                          FROM activity)""",
    "l3_180": "SELECT * FROM inactive WHERE is_high_value AND days_inactive >= 180",
    "l3_90": "SELECT * FROM inactive WHERE is_high_value AND days_inactive >= 90 AND total_orders >= 2",
    "lifecycles": """
        SELECT order_id, seller_id, category AS category_en, payment_value,
               CAST(trunc((epoch(order_delivered_customer_date) - epoch(order_purchase_timestamp)) / 86400)
                    AS INTEGER) AS lifecycle_days
        FROM fan_named
        WHERE order_status = 'delivered' AND order_delivered_customer_date IS NOT NULL
          AND order_purchase_timestamp IS NOT NULL""",
    "l4_rows": "SELECT * FROM lifecycles WHERE lifecycle_days < 20",
    "l4_pairs": f"""
        SELECT * FROM (
            SELECT seller_id, category_en, COUNT(*) AS total_orders,
                   {_big('COUNT(*) FILTER (WHERE lifecycle_days < 30)')} AS short_orders,
                   {_dbl('SUM(payment_value)')} AS revenue,
                   {_pct('COUNT(*) FILTER (WHERE lifecycle_days < 30)', 'COUNT(*)', 1)} AS short_rate_pct
            FROM lifecycles WHERE seller_id IS NOT NULL AND category_en IS NOT NULL GROUP BY 1, 2)
        WHERE short_rate_pct >= 25 AND total_orders >= 5""",
    "risk": """
        SELECT 'L1_discount_abuse' AS detector, COUNT(*) AS flags,
               CAST(COALESCE(SUM(CAST(actual_paid AS DECIMAL(18,2))), 0) AS DOUBLE) AS revenue_at_risk FROM l1_30
        UNION ALL SELECT 'L2_refund_spike', COUNT(*), NULL FROM l2
        UNION ALL SELECT 'L3_silent_churn', COUNT(*),
               CAST(COALESCE(SUM(CAST(lifetime_value AS DECIMAL(18,2))), 0) AS DOUBLE) FROM l3_90
        UNION ALL SELECT 'L4_short_lifecycle', COUNT(*), CAST(COALESCE(SUM(payment_value), 0) AS DOUBLE)
               FROM l4_rows""",
    "kpis": """
        SELECT CAST(SUM(CAST(revenue_at_risk AS DECIMAL(18,2))) AS DOUBLE) AS total_risk,
               CAST(SUM(flags) AS BIGINT) AS active_anomalies,
               COALESCE((SELECT category_en FROM zflags GROUP BY 1
                   ORDER BY SUM(CAST(revenue_gap AS DECIMAL(18,2))) DESC, 1 LIMIT 1), 'N/A') AS top_category,
               COALESCE((SELECT year_week FROM zflags GROUP BY 1
                   ORDER BY SUM(CAST(revenue_gap AS DECIMAL(18,2))) DESC, 1 LIMIT 1), 'N/A') AS worst_week,
               MAX(revenue_at_risk) FILTER (WHERE detector = 'L1_discount_abuse') AS l1_risk,
               MAX(revenue_at_risk) FILTER (WHERE detector = 'L3_silent_churn') AS l3_risk,
               MAX(revenue_at_risk) FILTER (WHERE detector = 'L4_short_lifecycle') AS l4_risk
        FROM risk""",
    # isolation forest
    "feat": """
        SELECT b.* EXCLUDE (z_score, avg_order_value),
               COALESCE(b.z_score, 0) AS z_score,
               COALESCE(b.avg_order_value, (SELECT quantile_cont(avg_order_value, 0.5) FROM base)) AS avg_order_value,
               COALESCE(CAST(b.cancellations AS DOUBLE) / NULLIF(b.orders_count, 0), 0) AS cancellation_rate,
               COALESCE(b.weekly_revenue / NULLIF(b.rolling_mean, 0), 1) AS revenue_vs_baseline,
               COALESCE(b.orders_count / CASE WHEN g.seen >= 4 THEN g.usual_orders END, 1) AS orders_vs_baseline
        FROM base b JOIN lagged g ON b.year_week = g.year_week AND b.category_en = g.category_en""",
    "sized": "SELECT *, COUNT(*) OVER (PARTITION BY category_en) AS n FROM feat",
    "scaled": "SELECT *, "
    + ", ".join(
        f"({f} - AVG({f}) OVER c) / CASE WHEN STDDEV_POP({f}) OVER c = 0 THEN 1 ELSE STDDEV_POP({f}) OVER c END AS f{i}"
        for i, f in enumerate(_FEATURES)
    )
    + " FROM sized WHERE n >= 12 WINDOW c AS (PARTITION BY category_en)",
    "wood": f"""
        SELECT category_en, year_week, n, f0, f1, f2, f3, f4, f5, t.tree,
               row_number() OVER (PARTITION BY category_en, t.tree ORDER BY year_week) - 1 AS place,
               {_mix(_draw("'forest42:' || category_en") + ' + t.tree * 104729 + 1')} AS seed
        FROM scaled, (SELECT UNNEST(range(100)) AS tree) t""",
    "grow0": f"""
        SELECT *, row_number() OVER (PARTITION BY category_en, tree
                                     ORDER BY {_mix('seed + place * 7919')}, place) <= 256 AS picked,
               greatest(1, CAST(ceil(log2(greatest(least(n, 256), 2))) AS INTEGER)) AS height,
               CAST(1 AS BIGINT) AS node, CAST(NULL AS DOUBLE) AS path
        FROM wood""",
}


def _grow(level: int) -> dict[str, str]:
    """One level of tree growth as three steps."""
    span = range(len(_FEATURES))
    lows = ", ".join(
        f"MIN(f{i}) FILTER (WHERE picked) OVER nd AS lo{i}, MAX(f{i}) FILTER (WHERE picked) OVER nd AS hi{i}"
        for i in span
    )
    uses = [f"CAST(hi{i} > lo{i} AS INTEGER)" for i in span]
    leaf = (
        "CASE WHEN size <= 1 THEN 0.0 WHEN size = 2 THEN 1.0 ELSE "
        "2 * (ln(greatest(size, 3) - 1) + 0.5772156649015329) - 2 * (greatest(size, 3) - 1.0) / greatest(size, 3) END"
    )
    right = " ".join(
        f"WHEN {uses[i]} = 1 AND {' + '.join(uses[:i]) or '0'} = first % choices "
        f"THEN CAST(f{i} > lo{i} + share * (hi{i} - lo{i}) AS INTEGER)"
        for i in span
    )
    return {
        f"node{level}": f"""
        SELECT *, COUNT(*) FILTER (WHERE picked) OVER nd AS size, {lows}
        FROM grow{level} WINDOW nd AS (PARTITION BY category_en, tree, node)""",
        f"pick{level}": f"""
        SELECT *, {' + '.join(uses)} AS choices, {_mix('seed + node * 7919 + 1')} AS first,
               {_mix(_mix('seed + node * 7919 + 1'))} / CAST({_MODULUS} AS DOUBLE) AS share,
               COALESCE(path, CASE WHEN size <= 1 OR {' + '.join(uses)} = 0 OR {level} >= height
                                   THEN {level} + {leaf} END) AS done
        FROM node{level}""",
        f"grow{level + 1}": f"""
        SELECT category_en, year_week, n, f0, f1, f2, f3, f4, f5, tree, place, seed, picked, height,
               CASE WHEN done IS NOT NULL THEN node ELSE node * 2 + CASE {right} END END AS node, done AS path
        FROM pick{level}""",
    }


for _level in range(9):
    _STEPS.update(_grow(_level))

_STEPS.update(
    {
        "depths": """
        SELECT category_en, year_week, SUM(CAST(round(path * 1000000000) AS BIGINT)) / 100000000000.0 AS depth
        FROM grow9 GROUP BY 1, 2""",
        "scored": """
        SELECT s.* EXCLUDE (f0, f1, f2, f3, f4, f5, n),
               ROUND(-pow(2.0, -d.depth / (2 * (ln(least(s.n, 256) - 1) + 0.5772156649015329)
                     - 2 * (least(s.n, 256) - 1.0) / least(s.n, 256))), 10) AS if_score
        FROM scaled s JOIN depths d ON s.category_en = d.category_en AND s.year_week = d.year_week""",
        "judged": """
        SELECT *, if_score < quantile_cont(if_score, 0.05) OVER (PARTITION BY category_en) AS if_anomaly,
               z_score < -2.0 AS flagged_by_zscore
        FROM scored""",
        "forest": """
        SELECT *, CASE WHEN if_anomaly THEN -1 ELSE 1 END AS if_prediction,
               if_anomaly AND flagged_by_zscore AS flagged_by_both
        FROM judged""",
        "targets": """
        SELECT year_week, category_en, revenue_at_risk AS revenue_gap, z_score FROM forest WHERE flagged_by_both
        ORDER BY revenue_gap DESC, category_en, year_week LIMIT 10""",
        "suspects": f"""
        SELECT f.*, t.year_week FROM (SELECT *, {_WEEK} AS wk FROM fan_named) f
        JOIN targets t ON f.wk = t.year_week AND f.category_en = t.category_en""",
        "state_cause": f"""
        SELECT f.year_week, f.category_en, s.seller_state, COUNT(DISTINCT f.order_id) AS orders,
               {_dbl('SUM(f.payment_value)')} AS revenue, {_big(_CANCELED)} AS cancellations
        FROM suspects f JOIN x_sellers s ON f.seller_id = s.seller_id GROUP BY 1, 2, 3""",
        "seller_cause": f"""
        SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY year_week, category_en
                   ORDER BY cancellations DESC, revenue, seller_id) AS INTEGER) AS seller_rank
            FROM (SELECT f.year_week, f.category_en, s.seller_id, s.seller_state, s.seller_city,
                         COUNT(DISTINCT f.order_id) AS orders, {_dbl('SUM(f.payment_value)')} AS revenue,
                         {_big(_CANCELED)} AS cancellations, {_pct(_CANCELED, 'COUNT(*)', 1)} AS cancel_rate_pct
                  FROM suspects f JOIN x_sellers s ON f.seller_id = s.seller_id GROUP BY 1, 2, 3, 4, 5))
        WHERE seller_rank <= 5""",
        "causes": """
        SELECT t.year_week, t.category_en AS category, t.revenue_gap, t.z_score,
               COALESCE(s.seller_state, 'unknown') AS root_cause_state,
               COALESCE(CAST(w.seller_id AS VARCHAR), 'unknown') AS root_cause_seller,
               COALESCE(w.cancel_rate_pct, 0.0) AS seller_cancel_rate
        FROM targets t
        LEFT JOIN (SELECT * FROM state_cause QUALIFY row_number() OVER (PARTITION BY year_week, category_en
                       ORDER BY revenue DESC, seller_state) = 1) s
               ON t.year_week = s.year_week AND t.category_en = s.category_en
        LEFT JOIN (SELECT * FROM seller_cause WHERE seller_rank = 1) w
               ON t.year_week = w.year_week AND t.category_en = w.category_en""",
    }
)

# Planted leakage.
_SCALED = (
    "CAST(payment_value * CAST(CAST(4000 + "
    + _draw("'L1_discount_abuse:' || order_id || ':' || CAST(payment_value * 100 AS BIGINT)")
    + " % 2001 AS DECIMAL(9,0)) * 0.0001 AS DECIMAL(9,4)) AS DECIMAL(18,2))"
)
_PLANTING = {
    "t_l1": """
        SELECT order_id FROM (SELECT DISTINCT order_id FROM x_order_payments)
        ORDER BY md5('L1_discount_abuse:' || order_id), order_id LIMIT 200""",
    "t_l2": """
        SELECT order_id FROM x_orders
        WHERE week(order_purchase_timestamp) BETWEEN 30 AND 35
          AND order_id IN (SELECT i.order_id FROM x_order_items i JOIN x_products p ON i.product_id = p.product_id
                           WHERE p.product_category_name = 'Brand#11')
        ORDER BY md5('L2_refund_spike:' || order_id), order_id LIMIT 150""",
    "record_spend": """
        SELECT o.customer_id, CAST(SUM(p.payment_value) AS DOUBLE) AS ltv
        FROM x_orders o JOIN x_order_payments p ON o.order_id = p.order_id GROUP BY 1""",
    "t_l3": """
        SELECT order_id FROM x_orders
        WHERE customer_id IN (SELECT customer_id FROM record_spend
                              WHERE ltv >= (SELECT quantile_cont(ltv, 0.8) FROM record_spend))
          AND order_purchase_timestamp >= (SELECT MAX(order_purchase_timestamp) - INTERVAL 6 MONTH FROM x_orders)
        ORDER BY md5('L3_silent_churn:' || order_id), order_id LIMIT 300""",
    "t_l4": """
        SELECT DISTINCT order_id, md5('L4_short_lifecycle:' || order_id) AS lot FROM x_order_items
        WHERE seller_id = (SELECT seller_id FROM x_order_items GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 1 OFFSET 5)
        ORDER BY lot, order_id LIMIT 100""",
    "labels_all": """
        SELECT order_id, 'L1_discount_abuse' AS leakage_type FROM t_l1
        UNION ALL SELECT order_id, 'L2_refund_spike' FROM t_l2
        UNION ALL SELECT order_id, 'L3_silent_churn' FROM t_l3
        UNION ALL SELECT order_id, 'L4_short_lifecycle' FROM t_l4""",
    "p_orders": """
        SELECT order_id, customer_id,
               CASE WHEN order_id IN (SELECT order_id FROM t_l2) THEN 'canceled' ELSE order_status END AS order_status,
               order_purchase_timestamp,
               CASE WHEN order_id IN (SELECT order_id FROM t_l4) THEN order_purchase_timestamp + INTERVAL 15 DAY
                    ELSE order_delivered_customer_date END AS order_delivered_customer_date
        FROM x_orders WHERE order_id NOT IN (SELECT order_id FROM t_l3)""",
    "p_order_payments": f"""
        SELECT order_id, payment_type,
               CASE WHEN order_id IN (SELECT order_id FROM t_l1) THEN {_SCALED} ELSE payment_value END AS payment_value
        FROM x_order_payments""",
    "truth": f"""
        SELECT {_WEEK} AS year_week, COALESCE(c.category, 'unknown') AS category_en, l.leakage_type,
               COUNT(*) AS injected_count
        FROM labels_all l JOIN x_orders o ON l.order_id = o.order_id
        JOIN x_order_items i ON l.order_id = i.order_id JOIN named c ON i.product_id = c.product_id
        WHERE o.order_purchase_timestamp IS NOT NULL GROUP BY 1, 2, 3""",
}


def _planted_steps() -> dict[str, str]:
    """Every analysis step once more, over the planted tables, under a ``p_`` name."""
    moved = {name: f"p_{name}" for name in _STEPS}
    moved |= {"x_orders": "p_orders", "x_order_payments": "p_order_payments"}
    # Step names follow FROM or JOIN; the same words also occur as columns.
    source = re.compile(r"(\b(?:FROM|JOIN)\s+)(\w+)")
    return {
        f"p_{name}": source.sub(lambda m: m.group(1) + moved.get(m.group(2), m.group(2)), sql)
        for name, sql in _STEPS.items()
    }


_ALL = {**_TABLES, **_STEPS, **_PLANTING, **_planted_steps()}


def _sources(sql: str) -> list[str]:
    return [n for n in re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", sql) if n in _ALL]


def _query(select: str) -> str:
    """``select`` preceded by the steps it needs, each after its own sources."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name not in ordered:
            for source in _sources(_ALL[name]):
                visit(source)
            ordered.append(name)

    for source in _sources(select):
        visit(source)
    steps = ",\n".join(f"{name} AS ({_ALL[name]})" for name in ordered)
    return f"WITH {steps}\n{select}"


def _evaluation(
    detector: str, flagged: str, truth: str, keys: str, flags: str | None = None, f1_of_rounded: bool = False
) -> str:
    """Scores of one detector; ``flagged`` and ``truth`` are SELECTs of key columns."""
    p, r = "COALESCE(tp / NULLIF(fl, 0), 0.0)", "COALESCE(tp / NULLIF(tp + fn, 0), 0.0)"
    fp, fr = (f"ROUND({p}, 3)", f"ROUND({r}, 3)") if f1_of_rounded else (p, r)
    return f"""
        SELECT '{detector}' AS detector, {flags or 'fl'} AS flags, tp AS true_positives, fl - tp AS false_positives,
               fn AS false_negatives, ROUND({p}, 3) AS precision, ROUND({r}, 3) AS recall,
               ROUND(COALESCE(2 * {fp} * {fr} / NULLIF({fp} + {fr}, 0), 0.0), 3) AS f1
        FROM (SELECT (SELECT COUNT(*) FROM (SELECT DISTINCT {keys} FROM ({flagged}))) AS fl,
                     (SELECT COUNT(*) FROM (SELECT {keys} FROM ({flagged}) INTERSECT SELECT {keys} FROM ({truth}))) AS tp,
                     (SELECT COUNT(*) FROM (SELECT {keys} FROM ({truth}) EXCEPT SELECT {keys} FROM ({flagged}))) AS fn)"""


def _label_ids(kind: str) -> str:
    return f"SELECT order_id FROM labels_all WHERE leakage_type = '{kind}'"


def _evaluations(tuned: bool) -> dict[str, str]:
    l1, l3 = ("p_l1_30", "p_l3_90") if tuned else ("p_l1_20", "p_l3_180")
    early = not tuned
    l2_weeks = f"SELECT {_WEEK} AS year_week FROM p_orders WHERE order_id IN (SELECT order_id FROM t_l2)"
    people = """SELECT c.customer_unique_id FROM x_orders o JOIN x_customers c ON o.customer_id = c.customer_id
                WHERE o.order_id IN (SELECT order_id FROM t_l3)"""
    pairs = """SELECT b.order_id FROM p_lifecycles b JOIN p_l4_pairs s
               ON b.seller_id = s.seller_id AND b.category_en = s.category_en WHERE b.lifecycle_days < 30"""
    return {
        "l1": _evaluation("L1_discount_abuse", f"SELECT order_id FROM {l1}", _label_ids("L1_discount_abuse"),
                          "order_id", None, early),
        "l2": _evaluation("L2_refund_spike", "SELECT year_week FROM p_l2", l2_weeks, "year_week",
                          "(SELECT COUNT(*) FROM p_l2)", early),
        "l3": _evaluation("L3_silent_churn", f"SELECT customer_unique_id FROM {l3}", people,
                          "customer_unique_id", None, early),
        "l4": _evaluation("L4_short_lifecycle", "SELECT order_id FROM p_l4_rows" if tuned else pairs,
                          _label_ids("L4_short_lifecycle"), "order_id",
                          None if tuned else "(SELECT COUNT(*) FROM p_l4_pairs)", early),
    }


def _findings() -> str:
    def finding(source: str, table: str, column: str, issue: str, bad: str, digits: int, note: str) -> str:
        pct = _pct(f"COUNT(*) FILTER (WHERE {bad})", "COUNT(*)", digits)
        return (
            f"SELECT '{table}' AS \"table\", '{column}' AS \"column\", '{issue}' AS issue, "
            f"{pct} AS pct_affected, {note.replace('#', f'COUNT(*) FILTER (WHERE {bad})')} AS note FROM {source}"
        )

    columns = ("order_id", "customer_id", "order_status", "order_purchase_timestamp", "order_delivered_customer_date")
    parts = [
        finding("x_orders", "orders", c, "nulls", f"{c} IS NULL", 2,
                f"format('{{:.1f}}', {_pct('#', 'COUNT(*)', 1)}) || '% of rows are null'")
        + f" HAVING COUNT(*) FILTER (WHERE {c} IS NULL) > 0"
        for c in columns
    ]
    delivery = "order_delivered_customer_date"
    parts += [
        finding("x_orders", "orders", delivery, "logical inconsistency",
                f"order_status = 'delivered' AND {delivery} IS NULL", 2,
                "# || ' orders marked delivered but have no delivery date'"),
        finding("x_orders", "orders", delivery, "impossible date", f"{delivery} < order_purchase_timestamp", 4,
                "# || ' orders delivered before they were purchased'"),
        finding("x_order_payments", "order_payments", "payment_value", "zero value", "payment_value = 0", 2,
                "# || ' payment rows with value = 0'"),
        finding("x_order_items", "order_items", "price", "zero or negative price", "price <= 0", 2,
                "# || ' items with price <= 0'"),
        f"""SELECT 'orders', 'order_id', 'duplicates', {_pct('COUNT(*) - COUNT(DISTINCT order_id)', 'COUNT(*)', 4)},
            (COUNT(*) - COUNT(DISTINCT order_id)) || ' duplicate order_ids found' FROM x_orders""",
    ]
    return " UNION ALL ".join(parts)


def _profiles() -> str:
    columns = {
        "x_orders": ("order_id", "customer_id", "order_status", "order_purchase_timestamp",
                     "order_delivered_customer_date"),
        "x_order_items": ("order_id", "product_id", "seller_id", "price", "freight_value"),
        "x_order_payments": ("order_id", "payment_type", "payment_value"),
        "x_products": ("product_id", "product_category_name"),
        "x_category_xlat": ("product_category_name", "product_category_name_english"),
        "x_customers": ("customer_id", "customer_unique_id"),
        "x_sellers": ("seller_id", "seller_state", "seller_city"),
    }
    return " UNION ALL ".join(
        f"SELECT '{t[2:]}' AS table_name, COUNT(*) AS row_count, {len(cs)} AS column_count, "
        f"'{c}' AS column_name, COUNT(*) - COUNT({c}) AS null_count FROM {t}"
        for t, cs in columns.items()
        for c in cs
    )


def _depth(price: str, paid: str, source: str) -> str:
    return f"""SELECT {_MONTH} AS year_month, COUNT(DISTINCT order_id) AS orders_count,
        {_dbl(f'SUM({price})')} AS total_list_price, {_dbl(f'SUM({paid})')} AS total_paid,
        {_pct(f'(SUM({price}) - SUM({paid})) * 100', f'SUM({price}) * 100')} AS discount_depth_pct
        FROM {source} GROUP BY 1"""


_REPLACED = "* REPLACE (ROUND(cancellation_rate, 6) AS cancellation_rate, ROUND(revenue_vs_baseline, 6) AS revenue_vs_baseline, ROUND(orders_vs_baseline, 6) AS orders_vs_baseline"
_ONE_EACH = """(SELECT o.order_id, o.order_purchase_timestamp, i.listed, p.paid FROM x_orders o
    JOIN (SELECT order_id, SUM(price + freight_value) AS listed FROM x_order_items GROUP BY 1) i ON o.order_id = i.order_id
    JOIN (SELECT order_id, SUM(payment_value) AS paid FROM x_order_payments WHERE payment_value > 0 GROUP BY 1) p
      ON o.order_id = p.order_id WHERE o.order_status = 'delivered')"""


_RANKED = """SELECT *, CASE WHEN percent_rank >= 0.8 THEN 'High' WHEN percent_rank >= 0.4 THEN 'Mid' ELSE 'Low' END AS tier
    FROM (SELECT *, PERCENT_RANK() OVER (ORDER BY lifetime_value) AS percent_rank FROM ltv)"""


def oracle_sql() -> dict[str, str]:
    tuned, early = _evaluations(True), _evaluations(False)
    weeks_back = ", ".join(f"MAX(CASE WHEN back = {k} THEN z_score END) AS week_{k}" for k in range(1, 21))
    delivered_fan = "fan WHERE order_status = 'delivered'"
    statements = {
        "profile_tables": _profiles(),
        "table_preview": "SELECT order_id, customer_id, order_status FROM x_orders ORDER BY order_id LIMIT 2",
        "sql_parameterised": """SELECT order_status, COUNT(*) AS orders_count FROM x_orders
            WHERE order_purchase_timestamp >= TIMESTAMP '1995-01-01'
              AND order_purchase_timestamp < TIMESTAMP '1997-01-01' GROUP BY 1""",
        "dq_report": _findings(),
        "overall_kpis": f"""SELECT COUNT(DISTINCT order_id) AS total_orders,
            COUNT(DISTINCT customer_id) AS total_customers,
            {_dbl("SUM(CASE WHEN order_status <> 'canceled' THEN payment_value ELSE 0 END)")} AS gmv,
            {_dbl("SUM(CASE WHEN order_status = 'delivered' THEN payment_value ELSE 0 END)")} AS net_revenue,
            {_dbl("SUM(CASE WHEN order_status = 'canceled' THEN payment_value ELSE 0 END)")} AS cancelled_revenue,
            {_mean("CASE WHEN order_status = 'delivered' THEN payment_value END")} AS avg_order_value,
            {_pct(_CANCELED, 'COUNT(*)')} AS cancellation_rate_pct FROM paid_orders""",
        "monthly_revenue": "SELECT * FROM monthly",
        "monthly_revenue_dated": "SELECT * REPLACE (CAST(year_month || '-01' AS DATE) AS year_month) FROM monthly",
        "monthly_refund_rate": f"""SELECT {_MONTH} AS year_month, COUNT(*) AS total_orders,
            {_big(_CANCELED)} AS cancelled_orders, {_pct(_CANCELED, 'COUNT(*)')} AS refund_rate_pct
            FROM x_orders WHERE order_purchase_timestamp IS NOT NULL GROUP BY 1""",
        "discount_depth": _depth("listed", "payment_value", delivered_fan),
        "discount_depth_deduped": _depth("listed", "paid", _ONE_EACH),
        "top_categories": "SELECT * FROM top20",
        "near_zero_payments": f"""SELECT {_dbl('SUM(payment_value)')} AS val FROM x_order_payments WHERE order_id IN
            (SELECT order_id FROM x_order_payments GROUP BY 1 HAVING SUM(payment_value) < 1)""",
        "weekly_revenue_wow": "SELECT * FROM weekly_wow",
        "weekly_tail": "SELECT * FROM weekly_wow ORDER BY year_week DESC LIMIT 10",
        "category_weekly": "SELECT * FROM category_week",
        "category_weekly_head": "SELECT * FROM category_week ORDER BY year_week, weekly_revenue DESC, category_en LIMIT 15",
        "category_weekly_deduped": f"""SELECT {_WEEK} AS year_week, category_en,
            COUNT(DISTINCT order_id) AS orders_count, {_dbl('SUM(payment_value)')} AS weekly_revenue,
            {_mean('payment_value')} AS avg_order_value, {_big(_CANCELED)} AS cancellations
            FROM paid_orders JOIN (SELECT DISTINCT i.order_id, COALESCE(c.category, 'unknown') AS category_en
                FROM x_order_items i JOIN named c ON i.product_id = c.product_id) USING (order_id)
            WHERE order_purchase_timestamp IS NOT NULL GROUP BY 1, 2""",
        "geo_weekly": f"""SELECT {_WEEK} AS year_week, s.seller_state, COUNT(DISTINCT order_id) AS orders_count,
            {_dbl('SUM(payment_value)')} AS weekly_revenue, {_big(_CANCELED)} AS cancellations
            FROM fan f JOIN x_sellers s ON f.seller_id = s.seller_id
            WHERE order_purchase_timestamp IS NOT NULL GROUP BY 1, 2""",
        "customer_ltv_tier": "SELECT * FROM tiers",
        "customer_ltv_rank": f"SELECT customer_unique_id, lifetime_value, ROUND(percent_rank, 9) AS percent_rank, tier FROM ({_RANKED})",
        "tier_summary_ranked": f"""SELECT tier, COUNT(*) AS customer_count,
            {_dbl('SUM(CAST(lifetime_value AS DECIMAL(18,2)))')} AS total_revenue,
            {_mean('CAST(lifetime_value AS DECIMAL(18,2))')} AS avg_ltv FROM ({_RANKED}) GROUP BY 1""",
        "tier_summary": f"""SELECT tier, COUNT(*) AS customer_count,
            {_dbl('SUM(CAST(lifetime_value AS DECIMAL(18,2)))')} AS total_revenue,
            {_mean('CAST(lifetime_value AS DECIMAL(18,2))')} AS avg_ltv FROM tiers WHERE tier IS NOT NULL GROUP BY 1""",
        "rolling_baseline": "SELECT * FROM base",
        "rolling_baseline_full_weeks": f"""SELECT * FROM base WHERE year_week < (SELECT {_WEEK} FROM
            (SELECT MAX(order_purchase_timestamp) + INTERVAL 1 DAY AS order_purchase_timestamp FROM x_orders))""",
        "anomaly_summary": f"""SELECT category_en, COUNT(*) AS anomaly_weeks,
            {_dbl('SUM(CAST(revenue_at_risk AS DECIMAL(18,2)))')} AS total_at_risk,
            {_mean('CAST(z_score AS DECIMAL(18,2))')} AS avg_z_score FROM base WHERE is_anomaly GROUP BY 1
            ORDER BY total_at_risk DESC, category_en LIMIT 15""",
        "zscore_anomalies": "SELECT * FROM zflags",
        "zscore_summary": f"""SELECT COUNT(*) AS flags, COUNT(DISTINCT category_en) AS categories,
            {_dbl('COALESCE(SUM(CAST(revenue_gap AS DECIMAL(18,2))), 0)')} AS total_gap FROM zflags""",
        "zscore_severity": "SELECT severity, COUNT(*) AS count FROM zflags GROUP BY 1",
        "zscore_top": """SELECT year_week, category_en, actual_revenue, expected_revenue, revenue_gap, z_score, severity
            FROM zflags ORDER BY revenue_gap DESC, category_en, year_week LIMIT 10""",
        "iforest_features": f"SELECT {_REPLACED}) FROM feat",
        "iforest_standardised": "SELECT category_en, year_week, n, "
        + ", ".join(f"ROUND(f{i}, 6) AS f{i}" for i in range(len(_FEATURES)))
        + " FROM scaled",
        "iforest_scores": f"SELECT {_REPLACED}, ROUND(if_score, 6) AS if_score) FROM forest",
        "iforest_overlap": """SELECT COUNT(DISTINCT category_en) AS categories,
            COUNT(*) FILTER (WHERE if_anomaly) AS forest_flags,
            COUNT(*) FILTER (WHERE flagged_by_zscore) AS zscore_flags,
            COUNT(*) FILTER (WHERE flagged_by_both) AS both_flags FROM forest""",
        "iforest_top": """SELECT year_week, category_en, weekly_revenue, ROUND(revenue_vs_baseline, 6) AS revenue_vs_baseline,
            ROUND(cancellation_rate, 6) AS cancellation_rate, ROUND(s, 6) AS if_score, flagged_by_both
            FROM (SELECT *, if_score AS s FROM forest WHERE if_anomaly ORDER BY if_score, category_en, year_week LIMIT 10)""",
        "high_confidence": f"SELECT {_REPLACED}, ROUND(if_score, 6) AS if_score) FROM forest WHERE flagged_by_both",
        "l1_discount_20": "SELECT *, 'L1_discount_abuse' AS leakage_type, TRUE AS detected FROM l1_20",
        "l1_discount_30": "SELECT * FROM l1_30",
        "l2_refund_rates": "SELECT * FROM refund_rate",
        "l2_refund_spike": "SELECT * FROM l2",
        "l3_churn_180": "SELECT * FROM l3_180",
        "l3_churn_90": "SELECT * FROM l3_90",
        "l4_short_orders": f"""SELECT order_id, seller_id, category_en, lifecycle_days,
            {_dbl('payment_value')} AS payment_value FROM l4_rows""",
        "l4_short_flags": f"""SELECT order_id, seller_id, category_en, lifecycle_days, COUNT(*) AS flag_rows,
            {_dbl('SUM(payment_value)')} AS payment_value FROM l4_rows GROUP BY 1, 2, 3, 4""",
        "l4_seller_category": "SELECT * FROM l4_pairs",
        "detector_totals": "SELECT * FROM risk",
        "revenue_at_risk": f"""SELECT detector, revenue_at_risk FROM risk WHERE revenue_at_risk IS NOT NULL
            UNION ALL SELECT 'total', {_dbl('SUM(CAST(revenue_at_risk AS DECIMAL(18,2)))')} FROM risk""",
        "l1_scaled_payments": f"""SELECT order_id, payment_type, {_dbl('payment_value')} AS payment_value
            FROM p_order_payments""",
        "l2_cancelled_orders": """SELECT * REPLACE (CASE WHEN order_id IN (SELECT order_id FROM t_l2) THEN 'canceled'
            ELSE order_status END AS order_status) FROM x_orders""",
        "l3_deleted_orders": "SELECT * FROM x_orders WHERE order_id NOT IN (SELECT order_id FROM t_l3)",
        "l4_shortened_orders": """SELECT * REPLACE (CASE WHEN order_id IN (SELECT order_id FROM t_l4)
            THEN order_purchase_timestamp + INTERVAL 15 DAY ELSE order_delivered_customer_date END
            AS order_delivered_customer_date) FROM x_orders""",
        "perturb_labels": "SELECT order_id, leakage_type, TRUE AS injected FROM labels_all",
        "perturb_label_counts": "SELECT leakage_type, COUNT(*) AS count FROM labels_all GROUP BY 1",
        "truth_category_weeks": "SELECT * FROM truth",
        "eval_zscore": _evaluation("Z-Score", "SELECT year_week, category_en FROM p_zflags",
                                   "SELECT year_week, category_en FROM truth", "year_week, category_en"),
        "eval_iforest": _evaluation("Isolation Forest",
                                    "SELECT year_week, category_en FROM p_forest WHERE flagged_by_both",
                                    "SELECT year_week, category_en FROM truth", "year_week, category_en"),
        **{f"eval_{k}": sql for k, sql in tuned.items()},
        "eval_l4_sellers": early["l4"],
        "scorecard": " UNION ALL ".join(tuned.values()),
        "scorecard_first": " UNION ALL ".join(early.values()),
        "rca_targets": "SELECT * FROM targets",
        "rca_state": "SELECT * FROM state_cause",
        "rca_seller": "SELECT * FROM seller_cause",
        "rca_tier": f"""SELECT f.year_week, f.category_en, t.tier, COUNT(*) AS orders,
            {_dbl('SUM(f.payment_value)')} AS revenue FROM suspects f
            JOIN x_customers c ON f.customer_id = c.customer_id
            JOIN tiers t ON c.customer_unique_id = t.customer_unique_id WHERE t.tier IS NOT NULL GROUP BY 1, 2, 3""",
        "rca_report": """SELECT *, 'Investigate seller ' || substr(root_cause_seller, 1, 8) || ' in '
            || root_cause_state || ' — cancel rate ' || seller_cancel_rate || '% in ' || category || ' during '
            || year_week AS recommended_action FROM causes""",
        "exec_kpis": "SELECT * FROM kpis",
        "kpi_cards": f"""SELECT {_money_text('total_risk')} AS total_risk,
            format('{{:,}}', active_anomalies) AS active_anomalies, substr(top_category, 1, 20) AS top_category,
            worst_week FROM kpis""",
        "revenue_3mo_avg": f"""SELECT year_month, monthly_revenue,
            {_quotient('past', 'seen * 100', 2)} AS rolling_avg
            FROM (SELECT *, SUM({_big(_cents('monthly_revenue'))}) OVER w AS past, COUNT(*) OVER w AS seen FROM monthly
                  WINDOW w AS (ORDER BY year_month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))""",
        "leakage_breakdown": f"""SELECT CASE detector WHEN 'L1_discount_abuse' THEN 'Discount Abuse (L1)'
            WHEN 'L3_silent_churn' THEN 'Silent Churn (L3)' ELSE 'Short Lifecycle (L4)' END AS leakage_type,
            revenue_at_risk, {_money_text('revenue_at_risk')} AS display_value
            FROM risk WHERE detector <> 'L2_refund_spike'""",
        "top5_cancel": f"""SELECT category_en AS "Category", {_money_text('total_revenue')} AS "Revenue (R$)",
            orders_count AS "Orders", cancel_rate_pct AS "Cancel Rate %" FROM top20
            ORDER BY cancel_rate_pct DESC, category_en LIMIT 5""",
        "detector_recall": f"""SELECT detector, CASE detector WHEN 'L1_discount_abuse' THEN 'Discount Abuse'
            WHEN 'L2_refund_spike' THEN 'Refund Spike' WHEN 'L3_silent_churn' THEN 'Silent Churn'
            ELSE 'Short Lifecycle' END AS label, ROUND(recall * 100, 1) AS recall_pct
            FROM ({' UNION ALL '.join(tuned.values())})""",
        "category_list": "SELECT DISTINCT category_en FROM base WHERE category_en IS NOT NULL",
        "category_timeline": """SELECT category_en, year_week, weekly_revenue, rolling_mean, upper_bound, lower_bound,
            is_anomaly FROM base WHERE category_en = (SELECT MIN(category_en) FROM base)""",
        "zscore_heatmap": "SELECT * FROM heat",
        "zscore_heatmap_wide": f"""SELECT category_en, {weeks_back} FROM
            (SELECT *, DENSE_RANK() OVER (ORDER BY year_week DESC) AS back FROM heat) GROUP BY 1""",
        "rca_display": f"SELECT * REPLACE ({_money_text('revenue_gap')} AS revenue_gap) FROM causes",
        "rca_choices": f"""SELECT year_week || ' — ' || category || ' — Gap: ' || {_money_text('revenue_gap')} AS choice,
            substr(root_cause_seller, 1, 12) || '...' AS seller FROM causes""",
        "dataset_stats": """SELECT (SELECT COUNT(*) FROM monthly) AS months,
            (SELECT COUNT(DISTINCT category_en) FROM base) AS categories,
            (SELECT COUNT(*) FILTER (WHERE is_anomaly) FROM zflags) AS anomaly_flags""",
    }
    return {name: _query(sql) for name, sql in statements.items()}
