"""DuckDB texts that compute the registered queries independently, for checking results.

Money is exact in both engines: decimals are summed as decimals, and a rounded quotient is taken
with whole-number arithmetic, because DuckDB divides decimals as doubles.
"""

from __future__ import annotations

import re

from motorlot.sources.adapter import PROMOS

AS_OF = "2001-07-15"

VIEWS = {
    "rentals": """
        SELECT l_orderkey * 10 + l_linenumber AS rental_id,
               concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE)) AS rental_ref,
               l_orderkey AS order_id, CAST(l_linenumber AS BIGINT) AS line_number, l_partkey AS vehicle_id,
               l_suppkey AS pickup_location, l_partkey % 10 AS dropoff_location,
               l_shipdate - to_days(CAST(l_quantity AS INTEGER)) AS actual_pickup, l_shipdate AS actual_dropoff,
               CAST(l_shipdate - to_days(CAST(l_quantity AS INTEGER)) AS DATE) AS pickup_date,
               CAST(l_shipdate AS DATE) AS dropoff_date,
               l_partkey * 100 AS odometer_out,
               CASE WHEN l_returnflag <> 'N' THEN l_partkey * 100 + CAST(l_quantity AS BIGINT) * 30 END AS odometer_in,
               CAST(100 AS BIGINT) AS fuel_level_out,
               CASE WHEN l_returnflag <> 'N' THEN CAST(100 - l_linenumber * 5 AS BIGINT) END AS fuel_level_in,
               base AS base_charge, fuel AS fuel_charge, damage AS damage_charge,
               CASE WHEN late <> 0 THEN late END AS late_fee,
               CASE WHEN l_returnflag <> 'N' THEN CAST(base + fuel + damage + late AS DECIMAL(10,2)) END AS total_charge,
               CASE l_returnflag WHEN 'R' THEN 'COMPLETED' WHEN 'N' THEN 'ACTIVE' WHEN 'A' THEN 'DISPUTED' END AS status,
               CASE WHEN damage > 0 THEN 'scratched' END AS damage_notes
          FROM (SELECT *, CAST(ROUND(base * CAST(l_tax AS DECIMAL(4,2)), 2) AS DECIMAL(10,2)) AS fuel,
                       CAST(CASE WHEN CAST(l_tax AS DECIMAL(4,2)) = 0.08 THEN 250 ELSE 0 END AS DECIMAL(10,2)) AS damage,
                       CAST(ROUND(base * CAST(l_discount AS DECIMAL(4,2)), 2) AS DECIMAL(10,2)) AS late
                  FROM (SELECT *, CAST(l_extendedprice AS DECIMAL(10,2)) AS base FROM lineitem))""",
    "booked": "SELECT r.*, o_custkey AS customer_id FROM rentals r JOIN orders ON order_id = o_orderkey",
    "order_rentals": """
        SELECT o_orderkey AS rental_id, o_custkey AS customer_id, o_orderdate AS actual_pickup,
               o_orderdate AS actual_dropoff, o_orderdate AS created_at,
               CAST(o_totalprice AS DECIMAL(10,2)) AS total_charge,
               CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'ACTIVE' WHEN 'P' THEN 'DISPUTED' END AS status
          FROM orders""",
    "payments": """
        SELECT o_orderkey AS payment_id, o_custkey AS customer_id, o_orderdate AS payment_date,
               CAST(o_totalprice AS DECIMAL(10,2)) AS amount,
               CASE left(o_orderpriority, 1) WHEN '1' THEN 'CREDIT_CARD' WHEN '2' THEN 'DEBIT_CARD' WHEN '3' THEN 'CASH'
                    WHEN '4' THEN 'BANK_TRANSFER' WHEN '5' THEN 'DIGITAL_WALLET' END AS payment_method,
               CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'PENDING' WHEN 'P' THEN 'REFUNDED' END AS status,
               CAST(1 + CAST(o_custkey % 25 AS DECIMAL(10,6)) * 0.01 AS DECIMAL(10,6)) AS exchange_rate
          FROM orders""",
    "vehicles": """
        SELECT p_partkey AS vehicle_id, p_type AS category_name,
               CASE WHEN p_partkey % 7 <> 0 THEN p_partkey % 10 END AS location_id,
               p_brand AS make, p_name AS model, CAST(p_size % 15 + 2010 AS BIGINT) AS model_year,
               string_split(p_name, ' ')[1] AS color, 'PLT-' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS license_plate,
               p_partkey * 10 % 200000 AS mileage,
               ['GASOLINE', 'DIESEL', 'HYBRID', 'ELECTRIC'][p_size % 4 + 1] AS fuel_type,
               CASE WHEN p_size % 2 = 0 THEN 'AUTOMATIC' ELSE 'MANUAL' END AS transmission, CAST(p_size AS BIGINT) AS seats,
               CASE WHEN p_partkey % 10 = 0 THEN 'MAINTENANCE' WHEN p_partkey % 10 < 3 THEN 'RENTED' ELSE 'AVAILABLE' END AS status,
               list_concat(string_split(p_name, ' '), [p_type]) AS features,
               CASE WHEN p_partkey % 5 = 0 THEN
                    CAST(ROUND(CAST(p_retailprice AS DECIMAL(10,2)) * 0.05, 2) AS DECIMAL(10,2)) END AS daily_override,
               DATE '2000-06-01' + CAST(p_partkey % 300 AS INTEGER) AS last_service_date,
               CASE WHEN p_partkey % 11 <> 0 THEN DATE '2001-01-01' + CAST(p_partkey % 400 AS INTEGER) END AS insurance_expiry,
               CASE WHEN p_partkey % 10 = 3 THEN 'N' ELSE 'Y' END AS is_active
          FROM part""",
    "categories": """
        SELECT category_name, daily_rate,
               CASE WHEN category_name <> 'PROMO' THEN CAST(daily_rate * 6 AS DECIMAL(10,2)) END AS weekly_rate,
               CASE WHEN category_name <> 'PROMO' THEN CAST(daily_rate * 20 AS DECIMAL(10,2)) END AS monthly_rate
          FROM (SELECT p_type AS category_name,
                       CAST(ROUND(CAST(MAX(p_retailprice) AS DECIMAL(10,2)) * 0.05, 2) AS DECIMAL(10,2)) AS daily_rate
                  FROM part GROUP BY p_type)""",
    "locations": """
        SELECT s_suppkey AS location_id, n_name AS location_name, r_name AS region_name
          FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "customers": """
        SELECT c_custkey AS customer_id, string_split(c_name, '#')[1] AS first_name, string_split(c_name, '#')[2] AS last_name,
               CASE WHEN c_custkey % 13 = 0 THEN 'broken.' || string_split(c_name, '#')[2]
                    ELSE lower(c_mktsegment) || '.' || string_split(c_name, '#')[2] || '@example.com' END AS email,
               concat_ws('-', 'DL', c_nationkey, string_split(c_name, '#')[2]) AS license_number,
               DATE '2000-01-01' + CAST(c_custkey % 1000 AS INTEGER) AS license_expiry,
               DATE '1950-01-01' + CAST(c_custkey % 18000 AS INTEGER) AS date_of_birth,
               CASE WHEN c_custkey % 17 <> 0 THEN
                    greatest(0, CAST(floor(CAST(c_acctbal AS DECIMAL(12,2))) AS BIGINT)) END AS loyalty_points,
               c_mktsegment AS street, 'City ' || c_nationkey AS city,
               CASE WHEN c_custkey % 10 = 0 THEN 'N' ELSE 'Y' END AS is_active
          FROM customer""",
    "maintenance": """
        SELECT l_partkey AS vehicle_id,
               CAST(ROUND(CAST(l_extendedprice AS DECIMAL(10,2)) * 0.05, 2) AS DECIMAL(10,2)) AS cost,
               CASE WHEN l_linestatus = 'F' THEN 'COMPLETED' ELSE 'SCHEDULED' END AS status, l_shipdate AS start_date
          FROM lineitem WHERE l_returnflag = 'A'""",
    "history": """
        SELECT user_id AS row_key, event_id AS seq, ts AS changed_at,
               CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END AS operation,
               event_type AS state, CAST(value AS DECIMAL(10,2)) AS amount
          FROM events""",
    "place_edges": """
        SELECT 'R' || r_regionkey AS id, NULL AS parent, r_name AS name FROM region UNION ALL
        SELECT 'N' || n_nationkey, 'R' || n_regionkey, n_name FROM nation UNION ALL
        SELECT 'S' || s_suppkey, 'N' || s_nationkey, s_name FROM supplier""",
    "promo_codes": "SELECT * FROM (VALUES " + ", ".join(
        f"('{code}', '{kind}', CAST({value} AS DECIMAL(8,2)), CAST({most} AS BIGINT), CAST({used} AS BIGINT), "
        f"DATE '{start}', DATE '{end}', '{active}')"
        for code, kind, value, most, used, start, end, active in PROMOS
    ) + ") t(promo_code, discount_type, discount_value, max_uses, current_uses, valid_from, valid_to, is_active)",
    "requests": """
        SELECT rental_ref, rental_id, customer_id, vehicle_id, pickup_location, pickup_date, dropoff_date,
               CASE line_number WHEN 1 THEN 'TEN' WHEN 2 THEN 'FLAT50' WHEN 3 THEN 'FULL' WHEN 4 THEN 'OFF'
                    WHEN 5 THEN 'OLD' WHEN 6 THEN 'GHOST' END AS promo_code
          FROM booked WHERE status = 'ACTIVE'""",
}


def with_views(text: str) -> str:
    """Put the used views in front of a query."""
    needed: list[str] = []

    def visit(sql: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", sql):
                visit(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(text)
    text = text.strip()
    views = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in needed)
    if not views:
        return text
    if text.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {views},\n{text[len('WITH RECURSIVE'):]}"
    if text.upper().startswith("WITH"):
        return f"WITH {views},\n{text[len('WITH'):]}"
    return f"WITH {views}\n{text}"


def quotient(top: str, bottom: str, factor: int = 1, digits: int = 2) -> str:
    """top * factor / bottom rounded half up, from whole cents; null when the bottom is zero."""
    n = f"(CAST(CAST({top} AS DECIMAL(38,2)) * 100 AS HUGEINT) * {factor * 10 ** digits})"
    d = f"CAST(CAST({bottom} AS DECIMAL(38,2)) * 100 AS HUGEINT)"
    return (f"(sign({n}) * sign({d}) * CAST((2 * abs({n}) + abs({d})) // NULLIF(2 * abs({d}), 0) AS DOUBLE) "
            f"/ {10 ** digits}.0)")


def average(total: str, rows: str) -> str:
    return f"(CAST({total} AS DOUBLE) / CAST(NULLIF({rows}, 0) AS DOUBLE))"


def dbl(expression: str, name: str) -> str:
    return f"CAST({expression} AS DOUBLE) AS {name}"


def big(expression: str, name: str) -> str:
    return f"CAST({expression} AS BIGINT) AS {name}"


MONTH = "date_trunc('month', actual_dropoff)"
LABEL = f"strftime({MONTH}, '%Y-%m')"
DONE = "status = 'COMPLETED'"
SPAN = "CAST(actual_dropoff AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'"
MONTHS = [f"1997-0{m}" for m in range(1, 7)]
MONTH_NAMES = ["jan", "feb", "mar", "apr", "may", "jun"]

REPORTS = {
    "dashboard_stats": f"""
        SELECT status, {big('COUNT(*)', 'cnt')}, {dbl('SUM(total_charge)', 'total_revenue')},
               {average('SUM(total_charge)', 'COUNT(total_charge)')} AS avg_charge, {dbl('MAX(total_charge)', 'max_charge')}
          FROM order_rentals WHERE CAST(created_at AS DATE) >= DATE '{AS_OF}' - 30 GROUP BY status""",
    "monthly_revenue_snapshot": f"""
        SELECT CAST({MONTH} AS TIMESTAMP) AS revenue_month, {big('COUNT(*)', 'rental_count')},
               {dbl('SUM(total_charge)', 'total_revenue')},
               {average('SUM(total_charge)', 'COUNT(total_charge)')} AS avg_charge,
               {dbl('MAX(total_charge)', 'max_charge')}, {dbl('MIN(total_charge)', 'min_charge')}
          FROM rentals WHERE {DONE} GROUP BY {MONTH}""",
    "repeat_customers": """
        SELECT c.customer_id, first_name || ' ' || last_name AS customer, CAST(COUNT(*) AS BIGINT) AS rental_count,
               string_agg(strftime(actual_pickup, '%Y-%m-%d'), ' | ' ORDER BY actual_pickup) AS rental_dates
          FROM customers c JOIN order_rentals r ON c.customer_id = r.customer_id
         GROUP BY c.customer_id, first_name, last_name HAVING COUNT(*) > 1""",
    "revenue_report": f"""
        SELECT CASE WHEN GROUPING({LABEL}) = 1 THEN 'TOTAL' ELSE {LABEL} END AS period,
               {big('COUNT(*)', 'rental_count')}, {dbl('SUM(total_charge)', 'total_revenue')},
               {quotient('SUM(total_charge)', 'COUNT(total_charge)')} AS avg_revenue,
               {dbl('SUM(base_charge)', 'base_rev')}, {dbl('SUM(fuel_charge)', 'fuel_rev')},
               {dbl('SUM(damage_charge)', 'damage_rev')}, {dbl('SUM(late_fee)', 'late_fees')}
          FROM rentals WHERE {DONE} AND {SPAN} GROUP BY ROLLUP({LABEL})""",
    "revenue_by_month": f"""
        SELECT CASE WHEN GROUPING({LABEL}) = 1 THEN 'TOTAL' ELSE {LABEL} END AS period_label,
               {big('COUNT(*)', 'rental_count')}, {dbl('SUM(total_charge)', 'total_revenue')}
          FROM rentals WHERE {DONE} AND {SPAN} GROUP BY ROLLUP({LABEL})""",
    "revenue_cube": f"""
        SELECT CASE WHEN GROUPING(category_name) = 1 THEN 'ALL' ELSE category_name END AS category,
               CASE WHEN GROUPING(fuel_type) = 1 THEN 'ALL' ELSE fuel_type END AS fuel_type,
               {big('COUNT(*)', 'rentals')}, {dbl('SUM(total_charge)', 'revenue')}
          FROM rentals r JOIN vehicles v ON r.vehicle_id = v.vehicle_id WHERE r.{DONE}
         GROUP BY CUBE(category_name, v.fuel_type)""",
    "pivot_monthly": f"""
        SELECT category_name, {', '.join(
            f"CAST(SUM(total_charge) FILTER ({LABEL} = '{m}') AS DOUBLE) AS {n}_1997_revenue, "
            f"CAST(COUNT(*) FILTER ({LABEL} = '{m}') AS BIGINT) AS {n}_1997_cnt" for m, n in zip(MONTHS, MONTH_NAMES))}
          FROM rentals r JOIN vehicles v ON r.vehicle_id = v.vehicle_id WHERE r.{DONE} GROUP BY category_name""",
    "pivot_conditional": f"""
        SELECT category_name, {', '.join(
            f"CAST(SUM(CASE WHEN {LABEL} = '{m}' THEN total_charge END) AS DOUBLE) AS {n}"
            for m, n in zip(MONTHS, MONTH_NAMES))}
          FROM rentals r JOIN vehicles v ON r.vehicle_id = v.vehicle_id WHERE r.{DONE} GROUP BY category_name""",
    "unpivot_charges": """
        SELECT rental_ref, charge_type, CAST(amount AS DOUBLE) AS amount FROM (
            SELECT rental_ref, 'BASE' AS charge_type, base_charge AS amount FROM rentals UNION ALL
            SELECT rental_ref, 'FUEL', fuel_charge FROM rentals UNION ALL
            SELECT rental_ref, 'DAMAGE', damage_charge FROM rentals UNION ALL
            SELECT rental_ref, 'LATE_FEE', late_fee FROM rentals)
         WHERE amount IS NOT NULL""",
    "unpivot_first": """
        WITH firsts AS (SELECT rental_id, rental_ref, base_charge, fuel_charge, damage_charge, late_fee FROM rentals
                         ORDER BY rental_id, rental_ref LIMIT 10)
        SELECT rental_id, rental_ref, charge_type, CAST(amount AS DOUBLE) AS amount FROM (
            SELECT rental_id, rental_ref, 'BASE' AS charge_type, base_charge AS amount FROM firsts UNION ALL
            SELECT rental_id, rental_ref, 'FUEL', fuel_charge FROM firsts UNION ALL
            SELECT rental_id, rental_ref, 'DAMAGE', damage_charge FROM firsts UNION ALL
            SELECT rental_id, rental_ref, 'LATE_FEE', late_fee FROM firsts)
         WHERE amount IS NOT NULL""",
    "customer_spend_rank": f"""
        WITH spend AS (SELECT c.customer_id, first_name || ' ' || last_name AS customer_name,
                              SUM(total_charge) AS total_spend
                         FROM customers c JOIN order_rentals r ON c.customer_id = r.customer_id
                        WHERE {DONE} GROUP BY c.customer_id, first_name, last_name)
        SELECT customer_id, customer_name, {dbl('total_spend', 'total_spend')},
               {big('RANK() OVER (ORDER BY total_spend DESC)', 'spend_rank')},
               {big('DENSE_RANK() OVER (ORDER BY total_spend DESC)', '"dense_rank"')},
               {big('ROW_NUMBER() OVER (ORDER BY total_spend DESC, customer_id)', 'rn')},
               {quotient('total_spend', 'SUM(total_spend) OVER ()', 100)} AS pct_of_total
          FROM spend""",
    "top_vehicles_by_category": f"""
        WITH named AS (SELECT v.vehicle_id, make, model, model_year, category_name, SUM(total_charge) AS total_revenue,
                              COUNT(*) AS rental_count
                         FROM rentals r JOIN vehicles v ON r.vehicle_id = v.vehicle_id WHERE r.{DONE}
                        GROUP BY ALL),
             ranked AS (SELECT *, RANK() OVER (PARTITION BY category_name ORDER BY total_revenue DESC) AS cat_rank,
                               SUM(total_revenue) OVER (PARTITION BY category_name) AS cat_revenue,
                               SUM(rental_count) OVER (PARTITION BY category_name) AS cat_rentals FROM named)
        SELECT category_name, make || ' ' || model || ' (' || model_year || ')' AS vehicle, vehicle_id,
               {dbl('total_revenue', 'total_revenue')}, {big('rental_count', 'rental_count')},
               {quotient('total_revenue', 'cat_revenue', 100)} AS pct_of_category, {big('cat_rank', 'cat_rank')},
               {big('cat_rentals', 'cat_rentals')}
          FROM ranked WHERE cat_rank <= 3""",
    "top_n_with_ties": f"""
        SELECT vehicle_id, make, model, CAST(revenue AS DOUBLE) AS revenue FROM (
            SELECT v.vehicle_id, make, model, SUM(total_charge) AS revenue, RANK() OVER (ORDER BY SUM(total_charge) DESC) AS rk
              FROM rentals r JOIN vehicles v ON r.vehicle_id = v.vehicle_id WHERE r.{DONE}
             GROUP BY v.vehicle_id, make, model) WHERE rk <= 5""",
    "page_rownum": f"""
        SELECT rental_id, customer_id, CAST(total_charge AS DOUBLE) AS total_charge, CAST(rn AS BIGINT) AS rn FROM (
            SELECT *, ROW_NUMBER() OVER (ORDER BY total_charge DESC, rental_id) AS rn FROM order_rentals WHERE {DONE})
         WHERE rn BETWEEN 11 AND 20""",
    "page_offset": f"""
        SELECT rental_id, customer_id, CAST(total_charge AS DOUBLE) AS total_charge FROM order_rentals WHERE {DONE}
         ORDER BY total_charge DESC, rental_id LIMIT 10 OFFSET 10""",
    "vehicle_profitability": f"""
        WITH earned AS (SELECT vehicle_id, SUM(total_charge) AS revenue FROM rentals WHERE {DONE} GROUP BY vehicle_id),
             spent AS (SELECT vehicle_id, SUM(cost) AS cost FROM maintenance WHERE {DONE} GROUP BY vehicle_id)
        SELECT v.vehicle_id, make || ' ' || model AS vehicle, model_year, {dbl('COALESCE(revenue, 0)', 'total_revenue')},
               {dbl('COALESCE(cost, 0)', 'total_maint_cost')},
               {dbl('COALESCE(revenue, 0) - COALESCE(cost, 0)', 'net_profit')},
               {quotient('COALESCE(cost, 0)', 'COALESCE(revenue, 0)', 100)} AS cost_ratio_pct
          FROM vehicles v LEFT JOIN earned e ON v.vehicle_id = e.vehicle_id LEFT JOIN spent s ON v.vehicle_id = s.vehicle_id""",
    "cohort_ltv": f"""
        WITH first_month AS (SELECT customer_id, date_trunc('month', MIN(actual_pickup)) AS cohort FROM order_rentals GROUP BY 1),
             spend AS (SELECT customer_id, date_trunc('month', actual_pickup) AS m, SUM(total_charge) AS amount
                         FROM order_rentals WHERE {DONE} GROUP BY 1, 2)
        SELECT CAST(cohort AS TIMESTAMP) AS cohort_month,
               CAST(datediff('month', cohort, m) AS BIGINT) AS months_since_first,
               {big('COUNT(DISTINCT s.customer_id)', 'active_customers')}, {dbl('SUM(amount)', 'cohort_revenue')},
               {quotient('SUM(amount)', 'COUNT(amount)')} AS avg_clv
          FROM first_month f JOIN spend s ON f.customer_id = s.customer_id GROUP BY cohort, datediff('month', cohort, m)""",
    "revenue_dashboard": f"""
        WITH monthly AS (SELECT {MONTH} AS m, COUNT(*) AS n, SUM(total_charge) AS revenue FROM rentals WHERE {DONE} GROUP BY 1)
        SELECT strftime(m, '%b %Y') AS month, {big('n', 'rentals')}, {dbl('revenue', 'total_revenue')},
               {quotient('revenue', 'n')} AS avg_revenue, {dbl('SUM(revenue) OVER (ORDER BY m)', 'running_total')},
               {quotient('SUM(revenue) OVER (ORDER BY m ROWS 2 PRECEDING)', 'COUNT(*) OVER (ORDER BY m ROWS 2 PRECEDING)')}
               AS moving_avg_3m FROM monthly""",
    "period_growth": f"""
        WITH monthly AS (SELECT {LABEL} AS period, COUNT(*) AS n, SUM(total_charge) AS revenue FROM rentals WHERE {DONE} GROUP BY 1),
             both_months AS (SELECT *, LAG(revenue) OVER (ORDER BY period) AS prev FROM monthly)
        SELECT period, {big('n', 'rental_count')}, {dbl('revenue', 'revenue')}, {dbl('prev', 'prev_period_revenue')},
               {quotient('revenue - prev', 'prev', 100)} AS growth_pct FROM both_months""",
    "revenue_forecast": f"""
        WITH monthly AS (SELECT {LABEL} AS period, SUM(total_charge) AS revenue FROM order_rentals WHERE {DONE} GROUP BY 1
                          ORDER BY 1 DESC LIMIT 6),
             named AS (SELECT SUM(revenue) AS total, COUNT(*) AS n FROM monthly
                        WHERE period IN ('2001-05', '2001-06', '2001-07'))
        SELECT period, CAST(revenue AS DOUBLE) AS revenue FROM monthly UNION ALL
        SELECT 'FORECAST_1', {quotient('total * 1.00', 'n', 1, 4)} FROM named UNION ALL
        SELECT 'FORECAST_2', {quotient('total * 1.05 * 100', 'n * 100', 1, 4)} FROM named UNION ALL
        SELECT 'FORECAST_3', {quotient('total * 1.10 * 100', 'n * 100', 1, 4)} FROM named""",
    "kpi_summary": f"""
        SELECT (SELECT COUNT(*) FROM order_rentals WHERE status = 'ACTIVE') AS active_rentals,
               (SELECT CAST(COALESCE(SUM(total_charge), 0) AS DOUBLE) FROM order_rentals
                 WHERE {DONE} AND CAST(created_at AS DATE) >= DATE '{AS_OF}' - 30) AS completed_revenue,
               (SELECT COUNT(*) FROM vehicles WHERE is_active = 'Y' AND status = 'AVAILABLE') AS available_vehicles,
               (SELECT COUNT(*) FROM customers WHERE is_active = 'Y') AS active_customers""",
    "running_totals": f"""
        SELECT rental_id, actual_dropoff, {dbl('total_charge', 'total_charge')},
               {dbl('SUM(total_charge) OVER (w ROWS UNBOUNDED PRECEDING)', 'running_total')},
               {average('SUM(total_charge) OVER (w ROWS 6 PRECEDING)', 'COUNT(total_charge) OVER (w ROWS 6 PRECEDING)')}
               AS moving_avg_7,
               {dbl('LAG(total_charge, 1, 0) OVER w', 'prev_rental_amt')},
               {dbl('LEAD(total_charge, 1, 0) OVER w', 'next_rental_amt')},
               {dbl('FIRST_VALUE(total_charge) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)', 'first_rental')},
               {dbl('LAST_VALUE(total_charge) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)', 'last_rental')}
          FROM order_rentals WHERE {DONE} WINDOW w AS (ORDER BY actual_dropoff, rental_id)""",
    "charge_distribution": f"""
        SELECT rental_id, {dbl('total_charge', 'total_charge')},
               {big('NTILE(4) OVER (ORDER BY total_charge, rental_id)', 'quartile')},
               PERCENT_RANK() OVER (ORDER BY total_charge) AS pct_rank, CUME_DIST() OVER (ORDER BY total_charge) AS cum_dist
          FROM order_rentals WHERE {DONE}""",
    "location_cumulative": f"""
        WITH monthly AS (SELECT location_name, {LABEL} AS month, SUM(total_charge) AS rev
                           FROM rentals r JOIN locations l ON r.pickup_location = l.location_id WHERE {DONE} GROUP BY 1, 2)
        SELECT location_name, month, {dbl('rev', 'monthly_rev')},
               {dbl('SUM(rev) OVER (PARTITION BY location_name ORDER BY month)', 'cumulative_loc_rev')},
               CAST(rev AS DOUBLE) / CAST(SUM(rev) OVER (PARTITION BY month) AS DOUBLE) * 100 AS pct_of_month FROM monthly""",
    "customer_history": f"""
        SELECT customer_id, rental_ref, make || ' ' || model AS vehicle, license_plate, actual_pickup, actual_dropoff,
               {dbl('total_charge', 'total_charge')},
               {dbl('SUM(total_charge) OVER (PARTITION BY customer_id ORDER BY actual_pickup, rental_ref ROWS UNBOUNDED PRECEDING)',
                    'running_total')},
               {big('RANK() OVER (PARTITION BY customer_id ORDER BY total_charge DESC)', 'charge_rank')}
          FROM booked b JOIN vehicles v ON b.vehicle_id = v.vehicle_id WHERE b.{DONE}""",
    "listagg_ids": """
        SELECT customer_id, CAST(COUNT(*) AS BIGINT) AS items, string_agg(CAST(rental_id AS VARCHAR), ',' ORDER BY rental_id) AS listed
          FROM order_rentals GROUP BY customer_id""",
    "listagg_dates": """
        SELECT customer_id, CAST(COUNT(*) AS BIGINT) AS items,
               string_agg(strftime(actual_pickup, '%Y-%m-%d'), ' | ' ORDER BY actual_pickup) AS listed
          FROM order_rentals GROUP BY customer_id""",
    "features_listagg": """
        SELECT vehicle_id, make || ' ' || model AS vehicle, string_agg(f, ', ' ORDER BY f) AS features
          FROM (SELECT vehicle_id, make, model, unnest(features) AS f FROM vehicles) GROUP BY vehicle_id, make, model""",
    "features_unnest": "SELECT vehicle_id, unnest(features) AS feature FROM vehicles",
}

_GROUPED = f"""
    SELECT CASE WHEN GROUPING(location_name) = 1 THEN 'ALL LOCATIONS' ELSE location_name END AS location,
           CASE WHEN GROUPING(category_name) = 1 THEN 'ALL CATEGORIES' ELSE category_name END AS category,
           {LABEL} AS month, {big('COUNT(*)', 'rentals')}, {dbl('SUM(total_charge)', 'revenue')},
           {big('GROUPING(location_name)', 'is_loc_total')}, {big('GROUPING(category_name)', 'is_cat_total')},
           {big('GROUPING(location_name, category_name)', 'grouping_level')}
      FROM rentals r JOIN vehicles v ON r.vehicle_id = v.vehicle_id JOIN locations l ON r.pickup_location = l.location_id
     WHERE r.{DONE} GROUP BY """
REPORTS["revenue_rollup"] = _GROUPED + f"ROLLUP(location_name, category_name, {LABEL})"
REPORTS["revenue_grouping_sets"] = _GROUPED + f"GROUPING SETS ((location_name, category_name), ({LABEL}), ())"
REPORTS["customers_rollup"] = f"""
    SELECT CASE WHEN GROUPING(location_name) = 1 THEN 'ALL LOCATIONS' ELSE location_name END AS location,
           CASE WHEN GROUPING(category_name) = 1 THEN 'ALL CATEGORIES' ELSE category_name END AS category, month,
           CAST(GROUPING(location_name) + GROUPING(category_name) + GROUPING(month) AS BIGINT) AS level,
           CAST(COUNT(DISTINCT customer_id) AS BIGINT) AS customers
      FROM (SELECT location_name, category_name, {LABEL} AS month, customer_id FROM booked r JOIN vehicles v ON r.vehicle_id = v.vehicle_id
              JOIN locations l ON r.pickup_location = l.location_id WHERE r.{DONE})
     GROUP BY ROLLUP(location_name, category_name, month)"""


NOW = f"TIMESTAMP '{AS_OF}'"
HOURS = quotient(f"epoch_us({NOW}) - epoch_us(actual_pickup)", "3600000000", 1, 1)
FULL_NAME = "first_name || ' ' || last_name"
FLEET = """
    SELECT v.vehicle_id, v.category_name, v.location_id, location_name, make, model, model_year, color, license_plate,
           mileage, fuel_type, transmission, seats, status,
           CAST(COALESCE(daily_override, c.daily_rate) AS DOUBLE) AS daily_rate,
           CAST(daily_override AS DOUBLE) AS daily_override, CAST(last_service_date AS TIMESTAMP) AS last_service_date,
           CAST(insurance_expiry AS TIMESTAMP) AS insurance_expiry
      FROM vehicles v JOIN categories c ON v.category_name = c.category_name
      LEFT JOIN locations l ON v.location_id = l.location_id WHERE is_active = 'Y' AND """
AGE = "date_part('year', age(TIMESTAMP '2001-07-15', CAST(date_of_birth AS TIMESTAMP)))"
PEOPLE = f"""
    SELECT customer_id, first_name, last_name, {FULL_NAME} AS full_name, email, license_number,
           CAST(license_expiry AS TIMESTAMP) AS license_expiry, CAST(date_of_birth AS TIMESTAMP) AS date_of_birth,
           CAST({AGE} AS BIGINT) AS age, loyalty_points, is_active FROM customers WHERE is_active = 'Y'"""
NAMED = """booked r JOIN customers c ON r.customer_id = c.customer_id JOIN vehicles v ON r.vehicle_id = v.vehicle_id
      JOIN locations p ON r.pickup_location = p.location_id JOIN locations q ON r.dropoff_location = q.location_id"""
INFO = "make || ' ' || model || ' (' || model_year || ')'"
LATEST = f"""(SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY vehicle_id ORDER BY actual_dropoff DESC, rental_ref DESC) AS k
                  FROM rentals WHERE {DONE}) WHERE k = 1)"""
LATEST_COLUMNS = "v.vehicle_id, make, model, rental_ref, CAST(total_charge AS DOUBLE) AS total_charge, actual_dropoff"
WHOLE_MONTHS = ("(year(actual_dropoff) - year(actual_pickup)) * 12 + month(actual_dropoff) - month(actual_pickup)")
CAR_BUCKET = """CASE WHEN model_year < 2015 THEN 'legacy' WHEN model_year < 2020 THEN 'mid'
                     WHEN model_year < 2024 THEN 'recent' ELSE 'current' END"""


def _rule(name: str, broken: str) -> str:
    return f"SELECT rental_ref, '{name}' AS rule FROM rentals WHERE {broken}"


LOOKUPS = {
    "projection_concat": f"SELECT vehicle_id, {INFO} AS vehicle FROM vehicles",
    "derived_columns": """
        SELECT rental_ref, CAST(dropoff_date - pickup_date AS BIGINT) AS total_days, odometer_in - odometer_out AS miles_driven
          FROM rentals""",
    "customer_derived_columns": f"""
        SELECT customer_id, {FULL_NAME} AS full_name, CAST({AGE} AS BIGINT) AS age, city FROM customers""",
    "predicate_mix": """
        SELECT rental_ref, status, actual_dropoff FROM rentals
         WHERE status NOT IN ('ACTIVE') AND actual_dropoff BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1999-12-31'
           AND (damage_notes IS NULL OR late_fee > 1000)""",
    "search_customers": PEOPLE + f""" AND (upper({FULL_NAME}) LIKE '%0001%' OR upper(email) LIKE '%0001%'
        OR upper(license_number) LIKE '%0001%')""",
    "search_vehicles": FLEET + "(upper(make) LIKE '%RING%' OR upper(model) LIKE '%RING%' OR upper(license_plate) LIKE '%RING%')",
    "available_vehicles": FLEET + "status = 'AVAILABLE' AND v.location_id = 4 AND v.category_name = 'ECONOMY'",
    "available_vehicles_all": FLEET + "status = 'AVAILABLE'",
    "vehicle_by_id": FLEET.replace("status,", "status, is_active,").replace("is_active = 'Y' AND", "") + "vehicle_id = 13",
    "customer_by_id": PEOPLE.replace("is_active = 'Y'", "customer_id = 20"),
    "list_customers_all": PEOPLE.replace("WHERE is_active = 'Y'", ""),
    "rental_by_id": f"""
        SELECT rental_id, rental_ref, r.customer_id, {FULL_NAME} AS customer_name, r.vehicle_id, {INFO} AS vehicle_info,
               p.location_name AS pickup_location_name, q.location_name AS dropoff_location_name, actual_pickup,
               actual_dropoff, CAST(total_charge AS DOUBLE) AS total_charge, r.status
          FROM {NAMED} WHERE rental_id = 13""",
    "rule_violations": " UNION ALL ".join([
        _rule("status_list", "status NOT IN ('ACTIVE', 'COMPLETED', 'DISPUTED')"),
        _rule("fuel_out_range", "fuel_level_out NOT BETWEEN 0 AND 100"),
        _rule("fuel_in_range", "fuel_level_in NOT BETWEEN 0 AND 100"),
        _rule("dates_in_order", "dropoff_date <= pickup_date"),
        _rule("base_charge_limit", "base_charge > 90000"),
        _rule("fuel_in_minimum", "fuel_level_in NOT BETWEEN 70 AND 100"),
        _rule("notes_length", "length(damage_notes) > 5"),
        _rule("late_fee_present", "late_fee IS NULL"),
    ]),
    "duplicate_keys": """
        SELECT order_id, line_number, CAST(COUNT(*) AS BIGINT) AS copies FROM rentals GROUP BY 1, 2 HAVING COUNT(*) > 1""",
    "vehicle_availability": f"""
        SELECT vehicle_id, make, model, model_year, license_plate, color, v.category_name,
               CAST(COALESCE(daily_override, daily_rate) AS DOUBLE) AS daily_rate, location_name, status, mileage,
               CASE WHEN insurance_expiry < {NOW} THEN 'EXPIRED' ELSE 'VALID' END AS insurance_status,
               CAST(last_service_date AS TIMESTAMP) AS last_service_date
          FROM vehicles v JOIN categories c ON v.category_name = c.category_name
          LEFT JOIN locations l ON v.location_id = l.location_id WHERE is_active = 'Y'""",
    "list_customers": PEOPLE,
    "active_rentals_view": f"""
        SELECT rental_ref, r.customer_id, {FULL_NAME} AS customer_name, email AS customer_email, r.vehicle_id,
               make || ' ' || model AS vehicle, license_plate, pickup_location, p.location_name AS pickup_location_name,
               dropoff_location, q.location_name AS dropoff_location_name, actual_pickup, {HOURS} AS hours_out,
               odometer_out, CAST(base_charge AS DOUBLE) AS base_charge, r.status
          FROM {NAMED} WHERE r.status = 'ACTIVE'""",
    "active_rentals_tvf": f"""
        SELECT rental_ref, {FULL_NAME} AS customer_name, {INFO} AS vehicle_info, actual_pickup AS pickup_date,
               CAST(total_charge AS DOUBLE) AS total_charge
          FROM booked r JOIN customers c ON r.customer_id = c.customer_id JOIN vehicles v ON r.vehicle_id = v.vehicle_id
         WHERE r.status = 'ACTIVE' AND pickup_location = 3""",
    "overdue_rentals": f"""
        SELECT rental_ref, r.customer_id, {FULL_NAME} AS customer_name, r.vehicle_id, make || ' ' || model AS vehicle_info,
               license_plate, pickup_location, p.location_name AS pickup_location_name, dropoff_location,
               q.location_name AS dropoff_location_name, actual_pickup, odometer_out, fuel_level_out,
               CAST(base_charge AS DOUBLE) AS base_charge, r.status, {HOURS} AS hours_overdue
          FROM {NAMED} WHERE r.status = 'ACTIVE' AND actual_pickup < {NOW} - INTERVAL 3 DAY""",
    "overlapping_bookings": """
        SELECT a.rental_ref, a.vehicle_id, CAST(COUNT(*) - 1 AS BIGINT) AS clashes
          FROM rentals a JOIN rentals b ON a.vehicle_id = b.vehicle_id
           AND b.pickup_date < a.dropoff_date AND b.dropoff_date > a.pickup_date GROUP BY 1, 2""",
    "first_blocking_booking": """
        SELECT a.rental_ref, a.vehicle_id, arg_min(b.rental_ref, strftime(b.pickup_date, '%Y-%m-%d') || '/' || b.rental_ref) AS blocker,
               CAST(MIN(b.pickup_date) AS TIMESTAMP) AS blocker_start
          FROM rentals a LEFT JOIN rentals b ON a.vehicle_id = b.vehicle_id AND b.status <> 'ACTIVE'
           AND b.pickup_date < a.dropoff_date AND b.dropoff_date > a.pickup_date WHERE a.status = 'ACTIVE' GROUP BY 1, 2""",
    "overlapping_span": """
        SELECT rental_ref, vehicle_id, CAST(pickup_date AS TIMESTAMP) AS pickup_date, CAST(dropoff_date AS TIMESTAMP) AS dropoff_date
          FROM rentals WHERE pickup_date < DATE '1998-06-30' AND dropoff_date > DATE '1998-06-01'""",
    "vehicle_utilization": f"""
        WITH used AS (SELECT vehicle_id, SUM(least(dropoff_date, DATE '1997-12-31') - greatest(pickup_date, DATE '1997-01-01')) AS days
                        FROM rentals WHERE {DONE} AND actual_pickup < TIMESTAMP '1997-12-31'
                         AND actual_dropoff > TIMESTAMP '1997-01-01' GROUP BY 1)
        SELECT v.vehicle_id, {quotient('COALESCE(days, 0)', '364', 100)} AS utilization_pct
          FROM vehicles v LEFT JOIN used u ON v.vehicle_id = u.vehicle_id""",
    "latest_rental_lateral": f"SELECT {LATEST_COLUMNS} FROM vehicles v JOIN {LATEST} t ON v.vehicle_id = t.vehicle_id",
    "latest_rental_left_lateral": f"""
        SELECT {LATEST_COLUMNS} FROM vehicles v LEFT JOIN {LATEST} t ON v.vehicle_id = t.vehicle_id WHERE is_active = 'Y'""",
    "semi_join_in": """
        SELECT customer_id, email FROM customers
         WHERE customer_id IN (SELECT customer_id FROM order_rentals WHERE total_charge > 400000)""",
    "orphan_keys": """
        SELECT vehicle_id AS missing_key, CAST(COUNT(*) AS BIGINT) AS children FROM maintenance
         WHERE vehicle_id NOT IN (SELECT vehicle_id FROM vehicles WHERE is_active = 'Y') GROUP BY 1""",
    "conditional_functions": """
        SELECT rental_ref,
               CASE status WHEN 'ACTIVE' THEN 'On Road' WHEN 'COMPLETED' THEN 'Returned' WHEN 'DISPUTED' THEN 'Under Review'
                    ELSE 'Unknown' END AS status_label,
               CAST(COALESCE(total_charge, 0) AS DOUBLE) AS safe_charge,
               CASE WHEN damage_notes IS NULL THEN 'No Damage' ELSE 'Has Damage' END AS damage_status,
               CAST(NULLIF(fuel_charge, 0) AS DOUBLE) AS fuel_charge_if_any, CAST(COALESCE(late_fee, 0) AS DOUBLE) AS late_amt,
               CASE WHEN total_charge > 1000 THEN 'Premium' WHEN total_charge > 500 THEN 'Standard'
                    WHEN total_charge > 0 THEN 'Economy' ELSE 'Pending' END AS rental_tier
          FROM rentals""",
    "numeric_functions": f"""
        SELECT rental_ref, {quotient('base_charge', '8', 1, 1)} AS rounded, CAST(floor(base_charge) AS DOUBLE) AS floored,
               CAST(ceil(base_charge) AS DOUBLE) AS ceiled, CAST((dropoff_date - pickup_date) % 7 AS BIGINT) AS spare_days,
               CAST((dropoff_date - pickup_date) // 7 AS BIGINT) AS weeks,
               CASE WHEN late_fee IS NOT NULL THEN CAST(greatest(base_charge, late_fee) AS DOUBLE) END AS higher,
               CASE WHEN late_fee IS NOT NULL THEN CAST(least(base_charge, late_fee) AS DOUBLE) END AS lower,
               CAST(-floor(base_charge) AS DOUBLE) AS truncated FROM rentals""",
    "date_functions": f"""
        SELECT rental_ref,
               CASE WHEN day(actual_pickup) = day(actual_dropoff)
                      OR (pickup_date = last_day(pickup_date) AND dropoff_date = last_day(dropoff_date))
                    THEN CAST({WHOLE_MONTHS} AS DOUBLE)
                    ELSE round({WHOLE_MONTHS} + (day(actual_dropoff) - day(actual_pickup)) / 31.0, 2)::DOUBLE END AS months_rented,
               CAST(CASE WHEN pickup_date = last_day(pickup_date) THEN last_day(pickup_date + INTERVAL 1 MONTH)
                         ELSE pickup_date + INTERVAL 1 MONTH END AS TIMESTAMP) AS one_month_later,
               CAST(date_trunc('month', actual_pickup) AS TIMESTAMP) AS month_start,
               CAST(date_trunc('week', actual_pickup) AS TIMESTAMP) AS week_start,
               CAST(date_trunc('year', actual_pickup) AS TIMESTAMP) AS year_start, CAST(pickup_date AS TIMESTAMP) AS pickup_day,
               year(actual_pickup) AS rental_year, month(actual_pickup) AS rental_month,
               rpad(strftime(actual_pickup, '%A'), 9, ' ') || ', ' || strftime(actual_pickup, '%d ')
                   || rpad(strftime(actual_pickup, '%B'), 9, ' ') || strftime(actual_pickup, ' %Y %H:%M:%S') AS formatted_date,
               CAST(last_day(actual_pickup) AS TIMESTAMP) AS last_of_month,
               CAST(date_trunc('week', actual_pickup) + INTERVAL 7 DAY AS TIMESTAMP) AS next_monday,
               CAST(strptime(strftime(actual_pickup, '%Y-%m-%d'), '%Y-%m-%d') AS TIMESTAMP) AS parsed,
               CAST(pickup_date + 7 AS TIMESTAMP) AS week_later, CAST(pickup_date - 30 AS TIMESTAMP) AS month_before,
               actual_pickup + INTERVAL 1 MONTH AS plus_interval, {NOW} AS as_of
          FROM rentals WHERE {DONE}""",
    "string_functions": """
        SELECT customer_id, CASE WHEN strpos(email, '@') > 1 THEN substr(email, 1, strpos(email, '@') - 1) END AS email_user,
               substr(email, strpos(email, '@') + 1) AS email_domain, strpos(email, '@') AS at_position,
               strpos(license_number, '-') + strpos(substr(license_number, strpos(license_number, '-') + 1), '-') AS second_dash,
               trim('  ' || first_name || ' ') AS trimmed_name, ltrim('  ' || first_name) AS left_trimmed,
               rtrim(first_name || '  ') AS right_trimmed, replace(license_number, '-', '') AS license_clean,
               upper(left(first_name, 1)) || lower(substr(first_name, 2)) AS proper_name,
               upper(email) AS upper_email, lower(first_name) AS lower_name, lpad(CAST(customer_id AS VARCHAR), 8, '0') AS padded_id,
               rpad(first_name, 10, ' ') AS padded_name, length(email) AS email_len, strlen(email) AS email_bytes,
               ascii(first_name) AS first_code, chr(ascii(first_name)) AS first_letter, concat(first_name, NULL, ' ', last_name) AS joined,
               CAST(TRY_CAST(last_name AS DECIMAL(18,2)) AS DOUBLE) AS name_number,
               CAST(TRY_CAST(first_name AS DECIMAL(18,2)) AS DOUBLE) AS not_a_number,
               format('{:,.2f}', CAST(loyalty_points AS DOUBLE)) AS points_text
          FROM customers WHERE is_active = 'Y'""",
    "regex_functions": r"""
        SELECT customer_id,
               CASE WHEN regexp_matches(email, '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$') THEN 'Valid' ELSE 'Invalid' END AS email_valid,
               regexp_replace(license_number, '[^A-Z0-9]', '', 'g') AS license_alphanum,
               regexp_extract_all(email, '[^@]+')[2] AS domain_part FROM customers""",
    "currency_convert": """
        SELECT payment_id, CAST(amount AS DOUBLE) AS amount, CAST(round(amount * exchange_rate, 2) AS DOUBLE) AS converted FROM payments""",
    "json_flat_map": """
        SELECT event_id, unnest(json_keys(props)) AS key, props ->> ('$."' || unnest(json_keys(props)) || '"') AS value FROM events""",
    "json_rows": """
        SELECT '{"rentalRef":"' || rental_ref || '","vehicleId":' || vehicle_id || ',"actualPickup":"'
               || strftime(actual_pickup, '%Y-%m-%d %H:%M:%S') || '","pickupDate":"' || strftime(pickup_date, '%Y-%m-%d')
               || '","odometerIn":' || COALESCE(CAST(odometer_in AS VARCHAR), 'null') || ',"baseCharge":' || base_charge
               || ',"totalCharge":' || COALESCE(CAST(total_charge AS VARCHAR), 'null') || ',"status":"' || status || '"}' AS json
          FROM rentals""",
    "json_object": """
        SELECT rental_ref, '{"id":"' || rental_ref || '","status":"' || status || '"}' AS object FROM rentals""",
    "xml_element": """
        SELECT rental_ref, '<rental id="' || rental_ref || '"><customer>' || customer_id || '</customer><vehicle>' || vehicle_id
               || '</vehicle><amount>' || COALESCE(CAST(total_charge AS VARCHAR), '') || '</amount><status>' || status
               || '</status></rental>' AS rental_xml FROM booked""",
    "date_series": f"""
        WITH days AS (SELECT unnest(range(DATE '{AS_OF}', DATE '{AS_OF}' + 30, INTERVAL 1 DAY)) AS rental_date),
             n AS (SELECT CAST(actual_pickup AS DATE) AS d, COUNT(*) AS pickups FROM order_rentals GROUP BY 1)
        SELECT CAST(rental_date AS TIMESTAMP) AS rental_date, upper(strftime(rental_date, '%a')) AS day_name,
               CAST(COALESCE(pickups, 0) AS BIGINT) AS pickups FROM days LEFT JOIN n ON rental_date = d""",
    "partition_range_counts": f"SELECT {CAR_BUCKET} AS bucket, CAST(COUNT(*) AS BIGINT) AS rows FROM vehicles GROUP BY 1",
    "partition_month_counts": """
        SELECT strftime(pickup_date, '%Y-%m') AS bucket, CAST(COUNT(*) AS BIGINT) AS rows FROM rentals GROUP BY 1""",
    "partition_list_counts": """
        SELECT CASE WHEN payment_method IN ('CREDIT_CARD', 'DEBIT_CARD') THEN 'card' WHEN payment_method = 'CASH' THEN 'cash'
                    ELSE 'other' END AS bucket, CAST(COUNT(*) AS BIGINT) AS rows FROM payments GROUP BY 1""",
}


RATES = """(SELECT vehicle_id, COALESCE(daily_override, daily_rate) AS rate, weekly_rate, monthly_rate
              FROM vehicles v JOIN categories c ON v.category_name = c.category_name)"""


def _sevenths(days: str, week: int = 1, month: int = 1) -> str:
    weekly = f"COALESCE(weekly_rate, rate * 0.80 * {week})"
    monthly = f"COALESCE(monthly_rate, rate * 0.65 * {month})"
    return f"""CAST(CASE WHEN {days} >= 28 THEN {days} // 28 * 7 * {monthly} + {days} % 28 * {weekly}
                    WHEN {days} >= 7 THEN {days} // 7 * 7 * {weekly} + {days} % 7 * 7 * rate
                    ELSE {days} * 7 * rate END AS DECIMAL(28,4))"""


def _priced(source: str, end: str = "dropoff_date", week: int = 1, month: int = 1) -> str:
    return f"""(SELECT s.*, rate, {_sevenths('days', week, month)} AS sevenths
                 FROM (SELECT *, greatest(1, {end} - pickup_date) AS days FROM {source}) s
                 LEFT JOIN {RATES} t ON s.vehicle_id = t.vehicle_id)"""


BASE_PRICE = quotient("sevenths * 100", "700")
PRICE = f"""CASE WHEN r.promo_code IS NULL THEN {BASE_PRICE}
                 WHEN m.discount_type = 'PERCENT' THEN {quotient("sevenths * (100 - discount_value) * 10000", "7000000")}
                 WHEN m.discount_type = 'FIXED' THEN
                      CASE WHEN discount_value * 7 < sevenths THEN {quotient("(sevenths - discount_value * 7) * 100", "700")} ELSE 0 END
            END"""
VALID = f"(SELECT * FROM promo_codes WHERE is_active = 'Y' AND {NOW} BETWEEN valid_from AND valid_to)"
TIER = """CASE WHEN loyalty_points < 500 THEN 'BRONZE' WHEN loyalty_points < 2000 THEN 'SILVER'
               WHEN loyalty_points < 5000 THEN 'GOLD' ELSE 'PLATINUM' END"""
PROMO_CHECK = f"""CASE WHEN r.promo_code IS NULL THEN 'OK' WHEN m.promo_code IS NULL THEN 'INVALID_PROMO'
                       WHEN m.is_active = 'N' OR NOT {NOW} BETWEEN valid_from AND valid_to THEN 'PROMO_EXPIRED_OR_INACTIVE'
                       WHEN current_uses >= max_uses THEN 'PROMO_LIMIT_REACHED' ELSE 'OK' END"""
PRICED_REQUESTS = f"""priced AS (SELECT r.*, {BASE_PRICE} AS base_price, {PRICE} AS price
                        FROM {_priced('requests')} r LEFT JOIN {VALID} m ON r.promo_code = m.promo_code)"""
COST = f"""CASE WHEN price IS NOT NULL THEN {quotient("CAST(ROUND(price * 100) AS HUGEINT) * (100 - CASE tier WHEN 'GOLD' THEN 5 WHEN 'PLATINUM' THEN 10 ELSE 0 END)", "10000")} END"""
STAGE = """reservations AS (
        SELECT o_orderkey AS reservation_id, o_custkey AS customer_id, o_custkey AS vehicle_id, o_custkey % 10 AS pickup_location,
               (o_custkey + 1) % 10 AS dropoff_location, o_orderstatus = 'O' AS asked,
               CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'CONFIRMED' WHEN o_orderpriority = '3-MEDIUM' THEN 'CANCELLED'
                    ELSE 'PENDING' END AS status FROM orders),
    begun AS (SELECT * FROM (SELECT r.*, ROW_NUMBER() OVER (PARTITION BY r.vehicle_id ORDER BY reservation_id) AS k
                               FROM reservations r JOIN vehicles v ON r.vehicle_id = v.vehicle_id
                              WHERE asked AND r.status = 'CONFIRMED' AND v.status = 'AVAILABLE') WHERE k = 1)"""

def _walks(passes: int) -> str:
    """One request after another in each vehicle, carrying the accepted spans; again for each promotion that runs out.

    A pass is right up to the first request that takes the last use of some promotion; the next pass refuses that
    promotion behind it.
    """
    parts = []
    for k in range(passes):
        cuts = " UNION ALL ".join(f"SELECT * FROM cut_{i}" for i in range(k)) or "SELECT NULL AS promo_code, NULL AS last WHERE FALSE"
        free = "len(list_filter(w.spans, lambda x: x.s < j.dropoff_date AND x.e > j.pickup_date)) = 0"
        parts.append(f"""
        judged_{k} AS (SELECT r.*, CASE WHEN {PROMO_CHECK} = 'OK' AND r.rental_ref > t.last THEN 'PROMO_LIMIT_REACHED' ELSE {PROMO_CHECK} END AS promo_check,
                          dropoff_date > pickup_date AS dates_ok, COALESCE(c.is_active = 'Y', FALSE) AS customer_ok, {TIER} AS tier,
                          max_uses - current_uses AS uses_left, ROW_NUMBER() OVER (PARTITION BY vehicle_id ORDER BY rental_ref) AS k
                     FROM priced r LEFT JOIN promo_codes m ON r.promo_code = m.promo_code
                     LEFT JOIN customers c ON r.customer_id = c.customer_id LEFT JOIN ({cuts}) t ON r.promo_code = t.promo_code),
        walk_{k} AS (
            SELECT v.vehicle_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS rental_ref, CAST(NULL AS BOOLEAN) AS clash,
                   COALESCE(list({{'s': pickup_date, 'e': dropoff_date}}) FILTER (pickup_date IS NOT NULL), []) AS spans
              FROM vehicles v LEFT JOIN rentals r ON v.vehicle_id = r.vehicle_id AND r.status <> 'ACTIVE' GROUP BY v.vehicle_id
            UNION ALL
            SELECT j.vehicle_id, j.k, j.rental_ref, NOT ({free}),
                   CASE WHEN j.dates_ok AND j.customer_ok AND j.promo_check = 'OK' AND {free}
                        THEN list_append(w.spans, {{'s': j.pickup_date, 'e': j.dropoff_date}}) ELSE w.spans END
              FROM walk_{k} w JOIN judged_{k} j ON w.vehicle_id = j.vehicle_id AND j.k = w.k + 1),
        cut_{k} AS (SELECT promo_code, rental_ref AS last FROM (
                SELECT j.promo_code, j.rental_ref, uses_left, ROW_NUMBER() OVER (PARTITION BY promo_code ORDER BY j.rental_ref) AS use,
                       COUNT(*) OVER (PARTITION BY promo_code) AS uses
                  FROM judged_{k} j JOIN walk_{k} w ON j.rental_ref = w.rental_ref
                 WHERE dates_ok AND customer_ok AND promo_check = 'OK' AND NOT clash AND uses_left IS NOT NULL)
             WHERE use = uses_left AND uses > uses_left ORDER BY rental_ref LIMIT 1)""")
    return ",".join(parts)


LOOKUPS["list_active_rentals"] = LOOKUPS["active_rentals_view"]

RULES = {
    "tiered_pricing": f"""
        SELECT rental_ref, CAST(days AS BIGINT) AS days, CAST(rate AS DOUBLE) AS daily_rate, {BASE_PRICE} AS base_price
          FROM {_priced('rentals')}""",
    "tiered_pricing_scaled": f"SELECT rental_ref, {BASE_PRICE} AS base_price FROM {_priced('rentals', week=7, month=28)}",
    "promo_pricing": f"WITH {PRICED_REQUESTS} SELECT rental_ref, promo_code, base_price, price FROM priced",
    "loyalty_pricing": f"""
        WITH {PRICED_REQUESTS} SELECT rental_ref, tier, price, {COST} AS cost
          FROM priced p JOIN (SELECT customer_id, {TIER} AS tier FROM customers) c ON p.customer_id = c.customer_id""",
    "customer_tiers": f"SELECT customer_id, loyalty_points, {TIER} AS tier FROM customers",
    "promo_validity": f"""
        SELECT rental_ref, r.promo_code, {PROMO_CHECK} AS promo_check
          FROM requests r LEFT JOIN promo_codes m ON r.promo_code = m.promo_code""",
    "promo_valid_at": """
        SELECT rental_ref, r.promo_code, discount_type FROM requests r LEFT JOIN promo_codes m
            ON r.promo_code = m.promo_code AND pickup_date BETWEEN valid_from AND valid_to""",
    "availability_check": """
        SELECT rental_ref, v.status AS vehicle_status,
               CASE WHEN v.status IS NULL THEN 'UNKNOWN_VEHICLE' WHEN v.status <> 'AVAILABLE' THEN 'NOT_AVAILABLE' ELSE 'OK' END AS start_check
          FROM requests r LEFT JOIN vehicles v ON r.vehicle_id = v.vehicle_id""",
    "reservation_decisions": f"""
        WITH RECURSIVE {PRICED_REQUESTS}, {_walks(3)}
        SELECT j.rental_ref, customer_id, j.vehicle_id, CAST(pickup_date AS TIMESTAMP) AS pickup_date,
               CAST(dropoff_date AS TIMESTAMP) AS dropoff_date, promo_code,
               CASE WHEN dates_ok AND NOT clash AND customer_ok AND promo_check = 'OK' THEN 'CONFIRMED' ELSE 'REFUSED' END AS decision,
               CASE WHEN NOT dates_ok THEN 'INVALID_DATES' WHEN clash THEN 'VEHICLE_UNAVAILABLE'
                    WHEN NOT customer_ok THEN 'CUSTOMER_NOT_FOUND' WHEN promo_check <> 'OK' THEN promo_check END AS reason,
               CASE WHEN dates_ok AND NOT clash AND customer_ok AND promo_check = 'OK' THEN {COST} END AS estimated_cost
          FROM judged_2 j JOIN walk_2 w ON j.rental_ref = w.rental_ref""",
    "begin_rentals": f"""
        WITH {STAGE} SELECT 9000 + ROW_NUMBER() OVER (ORDER BY reservation_id) AS rental_id, reservation_id, customer_id, vehicle_id,
               pickup_location, dropoff_location, {NOW} AS actual_pickup, reservation_id * 2 AS odometer_out,
               customer_id % 4 + 6001 AS employee_out, 'ACTIVE' AS status FROM begun""",
    "begin_rentals_reservations": f"""
        WITH {STAGE} SELECT reservation_id, CASE WHEN reservation_id IN (SELECT reservation_id FROM begun) THEN 'COMPLETED' ELSE status END AS status
          FROM reservations""",
    "begin_rentals_vehicles": f"""
        WITH {STAGE} SELECT vehicle_id, CASE WHEN vehicle_id IN (SELECT vehicle_id FROM begun) THEN 'RENTED' ELSE status END AS status FROM vehicles""",
    "begin_rentals_refused": f"""
        WITH {STAGE}, sent AS (SELECT reservation_id, status, reservation_id * 2 AS odometer_out, FALSE AS repeated FROM reservations WHERE asked
                               UNION ALL SELECT reservation_id, status, reservation_id * 2 + 1, TRUE FROM reservations WHERE asked AND reservation_id % 3 = 0)
        SELECT reservation_id, odometer_out,
               CASE WHEN status <> 'CONFIRMED' OR reservation_id IN (SELECT reservation_id FROM begun) THEN 'NOT_CONFIRMED' ELSE 'NOT_AVAILABLE' END AS reason
          FROM sent WHERE repeated OR reservation_id NOT IN (SELECT reservation_id FROM begun)""",
    "settlement_refused": """
        SELECT rental_ref, status, 'NO_ACTIVE_RENTAL' AS reason FROM rentals WHERE status <> 'ACTIVE' OR status IS NULL""",
    "rental_settlement": f"""
        WITH backs AS (SELECT *, CASE line_number WHEN 1 THEN 'TEN' WHEN 2 THEN 'FLAT50' WHEN 5 THEN 'OLD' END AS promo_code,
                              CASE WHEN line_number <> 6 THEN 100 - line_number * 5 END AS fuel_back FROM rentals WHERE status = 'ACTIVE'),
             parts AS (SELECT r.rental_ref, {PRICE} AS base_charge,
                              CASE WHEN fuel_back < 100 THEN (100 - fuel_back) * 3 ELSE 0 END AS fuel_charge,
                              CASE WHEN length(damage_notes) > 0 THEN 250 ELSE 0 END AS damage_charge,
                              CASE WHEN line_number <> 7 THEN {quotient(f"greatest(0, DATE '{AS_OF}' - dropoff_date) * rate * 15", "10")} ELSE 0 END AS late_fee
                         FROM {_priced('backs', f"DATE '{AS_OF}'")} r LEFT JOIN {VALID} m ON r.promo_code = m.promo_code)
        SELECT rental_ref, base_charge, CAST(fuel_charge AS DOUBLE) AS fuel_charge, CAST(damage_charge AS DOUBLE) AS damage_charge,
               late_fee, CAST(CAST(COALESCE(base_charge, 0) AS DECIMAL(18,2)) + fuel_charge + damage_charge
                              + CAST(late_fee AS DECIMAL(18,2)) AS DOUBLE) AS total_charge, 'COMPLETED' AS status FROM parts""",
}

STATS = "COUNT(*) AS n, SUM(total_charge) AS total, MAX(actual_pickup) AS latest"
EVENTS = """(
    SELECT vehicle_id, actual_pickup AS happened, 'START' AS event, rental_ref || '-A' AS seq, CAST(NULL AS BIGINT) AS odometer FROM rentals
    UNION ALL SELECT vehicle_id, actual_dropoff, 'COMPLETE', rental_ref || '-B', CASE WHEN line_number <> 7 THEN odometer_in END
      FROM rentals WHERE status = 'COMPLETED'
    UNION ALL SELECT vehicle_id, actual_dropoff, 'MAINTENANCE', rental_ref || '-C', NULL FROM rentals WHERE status = 'DISPUTED')"""
VEHICLE_STATE = f"""
    WITH marked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY vehicle_id ORDER BY happened DESC, seq DESC) AS k FROM {EVENTS}),
         readings AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY vehicle_id ORDER BY happened DESC, seq DESC) AS k FROM {EVENTS}
                    WHERE odometer IS NOT NULL)
    SELECT v.vehicle_id, COALESCE(CASE m.event WHEN 'START' THEN 'RENTED' WHEN 'COMPLETE' THEN 'AVAILABLE' ELSE m.event END, v.status) AS status,
           COALESCE(r.odometer, mileage) AS mileage
      FROM vehicles v LEFT JOIN (SELECT * FROM marked WHERE k = 1) m ON v.vehicle_id = m.vehicle_id
      LEFT JOIN (SELECT * FROM readings WHERE k = 1) r ON v.vehicle_id = r.vehicle_id"""


def _plain(number: str) -> str:
    text = f"CAST({number} AS VARCHAR)"
    return f"CASE WHEN contains({text}, '.') THEN rtrim(rtrim({text}, '0'), '.') ELSE {text} END"


LOGGED = f"""
    SELECT 'PAYMENTS' AS table_name, operation, payment_id AS record_id,
           CASE operation WHEN 'UPDATE' THEN 'amount=' || {_plain('old_amount')} || ',status=' || old_status
                WHEN 'DELETE' THEN 'amount=' || {_plain('old_amount')} || ',method=' || payment_method END AS old_values,
           CASE operation WHEN 'UPDATE' THEN 'amount=' || {_plain('new_amount')} || ',status=' || new_status
                WHEN 'INSERT' THEN 'amount=' || {_plain('new_amount')} || ',method=' || payment_method || ',status=' || new_status END AS new_values
      FROM """
UPDATES = """(SELECT customer_id, CASE WHEN customer_id % 2 = 0 THEN 'second.vip.' ELSE 'vip.' END || email AS email, CAST(NULL AS BIGINT) AS loyalty_points FROM customers WHERE loyalty_points > 5000)"""

CHANGES = {
    "assign_keys": """
        SELECT 5000 + ROW_NUMBER() OVER (ORDER BY actual_pickup, rental_id) AS new_id, rental_id, actual_pickup FROM order_rentals""",
    "merge_customer_stats": f"""
        WITH old AS (SELECT customer_id, {STATS} FROM order_rentals WHERE {DONE} AND actual_pickup < TIMESTAMP '1999-01-01' GROUP BY 1),
             fresh AS (SELECT customer_id, {STATS} FROM order_rentals WHERE {DONE} AND actual_pickup IS NOT NULL GROUP BY 1)
        SELECT customer_id, n AS rental_count, CAST(total AS DOUBLE) AS total_spend, latest AS last_rental, {NOW} AS updated_at FROM fresh
        UNION ALL SELECT customer_id, n, CAST(total AS DOUBLE), latest, TIMESTAMP '1999-01-01' FROM old
         WHERE customer_id NOT IN (SELECT customer_id FROM fresh)""",
    "promo_usage": """
        SELECT m.promo_code, CAST(current_uses + COUNT(r.promo_code) AS BIGINT) AS current_uses
          FROM promo_codes m LEFT JOIN requests r ON m.promo_code = r.promo_code GROUP BY m.promo_code, current_uses""",
    "insert_defaults": """
        SELECT vehicle_id, CASE WHEN vehicle_id % 4 = 0 THEN 0 ELSE mileage END AS mileage,
               CASE WHEN vehicle_id % 3 = 0 THEN 'GASOLINE' ELSE fuel_type END AS fuel_type,
               CASE WHEN vehicle_id % 6 = 1 THEN 'AUTOMATIC' ELSE transmission END AS transmission,
               CASE WHEN vehicle_id % 5 = 2 THEN 5 ELSE seats END AS seats,
               CASE WHEN vehicle_id % 7 = 3 THEN 'AVAILABLE' ELSE status END AS status, is_active FROM vehicles""",
    "apply_updates": f"""
        SELECT c.customer_id, COALESCE(u.email, c.email) AS email,
               CASE WHEN u.customer_id IS NULL THEN c.loyalty_points END AS loyalty_points
          FROM customers c LEFT JOIN {UPDATES} u ON c.customer_id = u.customer_id""",
    "apply_updates_unknown": """
        SELECT customer_id + 1000000000 AS customer_id, email, loyalty_points FROM customers WHERE loyalty_points IS NULL""",
    "soft_delete": """
        SELECT customer_id, CASE WHEN customer_id IN (SELECT customer_id FROM order_rentals WHERE status = 'DISPUTED' AND total_charge > 450000)
                                 THEN 'N' ELSE is_active END AS is_active FROM customers""",
    "guarded_delete": "SELECT rental_id, status FROM order_rentals WHERE total_charge >= 60000 OR status = 'ACTIVE'",
    "guarded_delete_refused": """
        SELECT rental_id, 'ACTIVE_RENTAL' AS reason FROM order_rentals WHERE total_charge < 60000 AND status = 'ACTIVE'""",
    "purge_audit": """
        SELECT row_key, seq, changed_at, operation, state, CAST(amount AS DOUBLE) AS amount FROM history
         WHERE changed_at >= TIMESTAMP '2024-01-20'""",
    "audit_diff": LOGGED + """(
        SELECT COALESCE(o.payment_id, n.payment_id) AS payment_id, COALESCE(o.payment_method, n.payment_method) AS payment_method,
               o.amount AS old_amount, o.status AS old_status, n.amount AS new_amount, n.status AS new_status,
               CASE WHEN o.payment_id IS NULL THEN 'INSERT' WHEN n.payment_id IS NULL THEN 'DELETE' ELSE 'UPDATE' END AS operation
          FROM (SELECT * FROM payments WHERE payment_date < TIMESTAMP '2001-01-01') o FULL JOIN (
                SELECT payment_id, payment_method, CASE WHEN status = 'PENDING' THEN 'COMPLETED' ELSE status END AS status,
                       CAST(CASE WHEN payment_method = 'DIGITAL_WALLET' THEN amount + 10.50 ELSE amount END AS DECIMAL(10,2)) AS amount
                  FROM payments WHERE payment_date >= TIMESTAMP '1995-07-01') n ON o.payment_id = n.payment_id
         WHERE o.payment_id IS NULL OR n.payment_id IS NULL OR o.amount <> n.amount OR o.status <> n.status)""",
    "vehicle_state": VEHICLE_STATE,
    "loyalty_award": f"""
        WITH won AS (SELECT customer_id, CAST(SUM(ROUND(total_charge, 0)) AS BIGINT) AS points FROM order_rentals WHERE {DONE} GROUP BY 1),
             after AS (SELECT c.customer_id, CAST(loyalty_points + COALESCE(points, 0) AS BIGINT) AS loyalty_points
                         FROM customers c LEFT JOIN won w ON c.customer_id = w.customer_id)
        SELECT customer_id, loyalty_points, {TIER} AS tier FROM after""",
    "as_of_state": """
        SELECT row_key, state, CAST(amount AS DOUBLE) AS amount, changed_at FROM (
            SELECT *, ROW_NUMBER() OVER (PARTITION BY row_key ORDER BY changed_at DESC, seq DESC) AS k
              FROM history WHERE changed_at <= TIMESTAMP '2024-01-15') WHERE k = 1 AND operation <> 'DELETE'""",
    "version_history": """
        SELECT row_key, state, CAST(amount AS DOUBLE) AS amount, changed_at AS version_start, version_end, left(operation, 1) AS version_operation
          FROM (SELECT *, LEAD(changed_at) OVER (PARTITION BY row_key ORDER BY changed_at, seq) AS version_end FROM history)
         WHERE changed_at BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20'""",
    "delete_ids": "SELECT rental_id, customer_id FROM order_rentals WHERE total_charge >= 60000",
}

TREE = """WITH RECURSIVE parents AS (SELECT DISTINCT parent FROM place_edges WHERE parent IS NOT NULL), tree AS (
    SELECT id, name, 1 AS level, name AS root, [name] AS steps FROM place_edges WHERE parent IS NULL UNION ALL
    SELECT e.id, e.name, t.level + 1, t.root, list_append(t.steps, e.name) FROM place_edges e JOIN tree t ON e.parent = t.id)
    """
LINKS = "links AS (SELECT id AS src, parent AS dst FROM place_edges WHERE parent IS NOT NULL)"
LOOPED = """links AS (SELECT id AS src, parent AS dst FROM place_edges WHERE parent IS NOT NULL
    UNION ALL SELECT 'R' || r_regionkey, 'N' || r_regionkey FROM region)"""
PAIRS = "pairs AS (SELECT src, dst FROM links UNION SELECT p.src, l.dst FROM pairs p JOIN links l ON p.dst = l.src)"

TREES = {
    "hierarchy_recursive": TREE + """SELECT repeat(' ', (level - 1) * 4) || name AS org_chart, CAST(level AS BIGINT) AS level,
        array_to_string(steps, ' > ') AS path FROM tree""",
    "hierarchy_connect_by": TREE + """SELECT CAST(level AS BIGINT) AS level, repeat(' ', level * 2 - 2) || name AS member,
        ' / ' || array_to_string(steps, ' / ') AS full_path, root,
        CAST(CASE WHEN id IN (SELECT parent FROM parents) THEN 0 ELSE 1 END AS BIGINT) AS is_leaf FROM tree""",
    "tree_numbering": TREE + """, numbered AS (SELECT id, name, level, steps, ROW_NUMBER() OVER (ORDER BY steps, id) AS number FROM tree),
        sized AS (SELECT a.id, COUNT(b.id) - 1 AS descendants FROM numbered a JOIN numbered b ON b.steps[1:a.level] = a.steps GROUP BY 1)
        SELECT n.id, e.parent, n.name, number, CAST(number + descendants AS BIGINT) AS last, CAST(level AS BIGINT) AS level,
               CAST(descendants AS BIGINT) AS descendants, CAST(CASE WHEN descendants = 0 THEN 1 ELSE 0 END AS BIGINT) AS is_leaf
          FROM numbered n JOIN sized USING (id) JOIN place_edges e USING (id)""",
    "strong_components": f"""WITH RECURSIVE {LOOPED}, {PAIRS},
        nodes AS (SELECT src AS node FROM links UNION SELECT dst FROM links),
        named AS (SELECT node, COALESCE(MIN(least(node, b.src)), node) AS component FROM nodes
                    LEFT JOIN (SELECT p.src, p.dst FROM pairs p JOIN pairs q ON p.src = q.dst AND p.dst = q.src) b ON b.dst = node GROUP BY node)
        SELECT node, component, COUNT(*) OVER (PARTITION BY component) AS size FROM named""",
    "dependency_closure": f"""WITH RECURSIVE {LINKS}, {PAIRS},
        chains AS (SELECT src, dst, 1 AS depth FROM links UNION ALL
                   SELECT c.src, l.dst, depth + 1 FROM chains c JOIN links l ON c.dst = l.src)
        SELECT p.src, CAST(COUNT(*) AS BIGINT) AS dependencies, CAST(MAX(depth) AS BIGINT) AS depth FROM pairs p
          JOIN (SELECT src, MAX(depth) AS depth FROM chains GROUP BY src) c ON p.src = c.src GROUP BY p.src""",
    "dependency_pairs": f"WITH RECURSIVE {LOOPED}, {PAIRS} SELECT src, dst FROM pairs",
    "dependency_checks": f"""WITH RECURSIVE {LOOPED}, {PAIRS}
        SELECT src AS node, 'CYCLE' AS problem FROM pairs WHERE src = dst UNION ALL
        SELECT DISTINCT dst, 'UNKNOWN_TARGET' FROM links WHERE dst NOT IN (SELECT id FROM place_edges WHERE name <> 'ASIA')""",
}

STREAMS = {
    "stream_audit": LOGGED + """(
        SELECT payment_id, payment_method, amount + 5 AS old_amount, 'FAILED' AS old_status, amount AS new_amount, status AS new_status,
               CASE status WHEN 'COMPLETED' THEN 'INSERT' WHEN 'REFUNDED' THEN 'DELETE' ELSE 'UPDATE' END AS operation FROM payments)""",
    "stream_vehicle_state": VEHICLE_STATE,
    "stream_monthly_revenue": REPORTS["monthly_revenue_snapshot"],
}


HASHED = "CAST('0x' || substr(md5('42|' || CAST({key} AS VARCHAR)), 1, 7) AS BIGINT) < CAST({share} AS BIGINT) * 268435456 // 100"
WRITES = {
    "sample_rows": f"""
        SELECT rental_id, customer_id, CAST(total_charge AS DOUBLE) AS total_charge FROM order_rentals
         WHERE {DONE} AND {HASHED.format(key='rental_id', share=10)}""",
    "sample_blocks": f"""
        SELECT rental_ref, order_id, CAST(total_charge AS DOUBLE) AS total_charge FROM rentals
         WHERE {DONE} AND {HASHED.format(key='order_id // 128', share=5)}""",
    "monthly_revenue_refreshed": REPORTS["monthly_revenue_snapshot"],
    "monthly_revenue_touched": REPORTS["monthly_revenue_snapshot"],
    "search_customers_indexed": LOOKUPS["search_customers"],
    "rental_by_id_stored": LOOKUPS["rental_by_id"],
    "search_vehicles_indexed": LOOKUPS["search_vehicles"],
    "audit_diff_digests": CHANGES["audit_diff"],
    "as_of_state_stored": CHANGES["as_of_state"],
    "partition_range_read": "SELECT vehicle_id, make, model_year, status FROM vehicles WHERE model_year BETWEEN 2016 AND 2021",
    "active_rentals_sql": LOOKUPS["active_rentals_tvf"].replace("rental_ref", "rental_id"),
    "revenue_by_month_sql": REPORTS["revenue_by_month"],
}
RANGED = {f"{name}_ranged": {**REPORTS, **CHANGES}[name] for name in (
    "customer_spend_rank", "running_totals", "charge_distribution", "customer_history", "assign_keys", "version_history")}


def all_texts() -> dict[str, str]:
    return {name: with_views(text) for name, text in {**REPORTS, **LOOKUPS, **RULES, **CHANGES, **TREES, **STREAMS, **WRITES, **RANGED}.items()}
