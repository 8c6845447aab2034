"""DuckDB SQL giving the expected result of every query.

The statements share the definitions in ``TABLES``; each one carries only those
it needs. Doubles are rounded and days written as text, on the Spark side too.
"""

from __future__ import annotations

import math
import re

TABLES = {
    "adm": """
        SELECT o_custkey AS id, o_orderkey AS adm_id,
               CASE WHEN o_custkey % 23 = 0 THEN NULL WHEN o_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
               CAST(o_orderdate AS DATE) AS adm_start_date,
               CAST(o_orderdate AS DATE) + CAST(3 + o_orderkey % 28 AS INTEGER) AS adm_end_date,
               (o_orderstatus = 'F' AND o_orderkey % 5 = 0) AS death_during_adm,
               o_orderpriority AS adm_route,
               CASE WHEN o_orderkey % 31 = 0 THEN NULL
                    ELSE c_mktsegment || '-' || CAST(o_orderkey % 4 AS VARCHAR) END AS sub_specialty,
               r_name AS specialty,
               DATE '1920-01-01' + CAST((o_custkey * 37) % 27000 AS INTEGER) AS birth_date
        FROM orders JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "rx": """
        SELECT o_custkey AS id,
               CAST(o_orderdate AS DATE) + CAST((l_linenumber - 1) * 3 AS INTEGER) AS ab_start_date,
               CAST(o_orderdate AS DATE) + CAST((l_linenumber - 1) * 3 + CAST(l_quantity AS INTEGER) % 8 AS INTEGER)
                   AS ab_stop_date,
               CASE l_returnflag WHEN 'A' THEN 'IV' WHEN 'R' THEN 'oral' WHEN 'N' THEN 'IM' END AS ab_route,
               p_brand AS atc_code,
               0.5E0 + (l_partkey % 6) * 0.25E0 AS ddd_per_day
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "tests": """
        SELECT o_custkey AS id, event_id AS test_number,
               CAST(o_orderdate AS DATE) + CAST(event_id % 9 - 2 AS INTEGER) AS test_date,
               CASE WHEN event_id % 3 = 0 THEN 'urine' ELSE 'blood' END AS material,
               CASE WHEN event_type <> 'signup' THEN event_type END AS mo,
               CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 'R'
                    WHEN event_id % 5 = 1 THEN 'I' ELSE 'S' END AS amox,
               CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 4 = 0 THEN 'R' ELSE 'S' END AS cipr,
               CASE WHEN event_id % 3 = 1 THEN 'R' WHEN event_id % 3 = 2 THEN 'I' ELSE 'S' END AS gent
        FROM events JOIN orders ON event_id = o_orderkey""",
    "agents": """
        SELECT DISTINCT p_brand AS atc_code, lower(p_brand) AS ab_type,
               'G' || CAST(CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) % 6 AS VARCHAR) AS ab_group
        FROM part WHERE p_brand <> 'Brand#25'""",
    "organisms": """
        SELECT DISTINCT event_type AS mo, upper(event_type) AS fullname,
               'F' || CAST(length(event_type) % 2 AS VARCHAR) AS family
        FROM events WHERE event_type <> 'signup'""",
    "adm_d": """
        SELECT *, CAST(year(adm_start_date) AS INTEGER) AS year,
               CAST(date_trunc('month', adm_start_date) AS DATE) AS yearmonth_adm,
               CAST(date_trunc('quarter', adm_start_date) AS DATE) AS yearquarter_adm,
               CAST(adm_end_date - adm_start_date + 1 AS INTEGER) AS "LOS",
               CAST(year(adm_start_date) - year(birth_date) AS INTEGER) AS age
        FROM adm""",
    "rx_adm": """
        SELECT r.*, a.* EXCLUDE (id),
               CAST(ab_stop_date - ab_start_date AS INTEGER) AS ab_days,
               CAST(ab_start_date - adm_start_date AS INTEGER) AS ab_timing,
               ddd_per_day * (ab_stop_date - ab_start_date) AS ddd_per_prescription
        FROM rx r JOIN adm_d a ON r.id = a.id AND ab_start_date >= adm_start_date AND ab_stop_date <= adm_end_date""",
    "tests_adm": """
        SELECT t.*, a.adm_id, a.adm_start_date, a.adm_end_date
        FROM tests t JOIN adm a ON t.id = a.id AND test_date BETWEEN adm_start_date AND adm_end_date""",
    "first_start": "SELECT id, adm_id, min(ab_start_date) AS min_ab_start FROM rx_adm GROUP BY id, adm_id",
    "timing": """
        SELECT m.id, m.adm_id,
               CAST(min(CASE WHEN material = 'blood' THEN test_date END) - any_value(min_ab_start) AS INTEGER) AS bc_timing,
               CAST(min(CASE WHEN material = 'urine' THEN test_date END) - any_value(min_ab_start) AS INTEGER) AS uc_timing
        FROM tests_adm m JOIN first_start f ON m.id = f.id AND m.adm_id = f.adm_id GROUP BY m.id, m.adm_id""",
    "ordered_rx": """
        SELECT id, adm_id, ab_start_date, ab_stop_date,
               row_number() OVER w AS pos,
               CASE WHEN ab_start_date > lag(ab_stop_date) OVER w THEN 1 ELSE 0 END AS gap
        FROM rx_adm WINDOW w AS (PARTITION BY id, adm_id ORDER BY ab_start_date, ab_stop_date, atc_code)""",
    "led_rx": """
        SELECT *, sum(gap) OVER (PARTITION BY id, adm_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS gaps
        FROM ordered_rx""",
    "course": """
        SELECT id, adm_id, min(ab_start_date) AS ab_start_cont, max(ab_stop_date) AS ab_stop_cont,
               CAST(max(ab_stop_date) - min(ab_start_date) + 1 AS INTEGER) AS ab_days_all
        FROM led_rx WHERE gaps = 0 GROUP BY id, adm_id""",
    "dose": """
        SELECT id, adm_id, coalesce(sum(ddd_per_prescription), 0) AS ddd_total FROM rx_adm GROUP BY id, adm_id""",
    "adm_e": """
        SELECT a.*, bc_timing, uc_timing
        FROM adm_d a LEFT JOIN timing t ON a.id = t.id AND a.adm_id = t.adm_id""",
    "rx_e": """
        SELECT a.*, ab_type, ab_group, min_ab_start, ddd_total, ab_start_cont, ab_stop_cont, ab_days_all,
               bc_timing, uc_timing, ab_start_date = min_ab_start AS ab_first
        FROM rx_adm a LEFT JOIN agents g ON a.atc_code = g.atc_code
        LEFT JOIN first_start f ON a.id = f.id AND a.adm_id = f.adm_id
        LEFT JOIN dose d ON a.id = d.id AND a.adm_id = d.adm_id
        LEFT JOIN course c ON a.id = c.id AND a.adm_id = c.adm_id
        LEFT JOIN timing t ON a.id = t.id AND a.adm_id = t.adm_id""",
    "anchors": """
        SELECT id, mo, min(test_date) AS d FROM tests WHERE mo IS NOT NULL GROUP BY id, mo
        UNION ALL
        SELECT a.id, a.mo, min(t.test_date) FROM anchors a
        JOIN tests t ON t.id = a.id AND t.mo = a.mo AND t.test_date > a.d + 365
        GROUP BY a.id, a.mo, a.d""",
    "tests_f": """
        SELECT t.*, (a.d IS NOT NULL
                     AND row_number() OVER (PARTITION BY t.id, t.mo, t.test_date ORDER BY test_number) = 1)
                    AS first_isolate
        FROM tests t LEFT JOIN anchors a ON t.id = a.id AND t.mo = a.mo AND t.test_date = a.d""",
    "tests_e": """
        SELECT t.*, o.fullname, o.family,
               CAST(date_trunc('month', test_date) AS DATE) AS yearmonth_test,
               CAST(date_trunc('quarter', test_date) AS DATE) AS yearquarter_test,
               a.* EXCLUDE (id)
        FROM tests_f t LEFT JOIN organisms o ON t.mo = o.mo
        JOIN adm_e a ON t.id = a.id AND test_date BETWEEN adm_start_date AND adm_end_date""",
    "cohort": """
        SELECT *, CASE WHEN bc_timing BETWEEN -1 AND 1 THEN 'Taken' ELSE 'Not taken' END AS "check"
        FROM rx_e WHERE ab_route IS NOT NULL AND ab_type IS NOT NULL AND adm_route IS NOT NULL AND ab_timing >= 0""",
    "grain": """
        SELECT * FROM cohort QUALIFY row_number() OVER (
            PARTITION BY id, adm_id ORDER BY ab_start_date, ab_stop_date, atc_code, ab_route, ddd_per_day) = 1""",
    "cohort_tests": """
        SELECT t.*, c."check" FROM tests_e t
        JOIN (SELECT DISTINCT id, adm_id, "check" FROM cohort WHERE "check" = 'Taken') c
          ON t.id = c.id AND t.adm_id = c.adm_id""",
    "isolates": "SELECT * FROM cohort_tests WHERE first_isolate AND material = 'blood'",
    "all_isolates": "SELECT * FROM tests_e WHERE first_isolate",
    "admission_doses": """
        SELECT id, adm_id, year, yearmonth_adm, yearquarter_adm, specialty, sub_specialty, adm_route, "LOS",
               coalesce(sum(ddd_per_prescription), 0) AS ddd_sum, CAST(coalesce(sum(ab_days), 0) AS BIGINT) AS dot_sum
        FROM cohort
        GROUP BY id, adm_id, year, yearmonth_adm, yearquarter_adm, specialty, sub_specialty, adm_route, "LOS" """,
    "run_limits": "SELECT * FROM (VALUES {limits}) AS v(n_useful, longest_run_max, n_crossings_min)",
}


def _limits(points: int) -> str:
    rows, k, term, below = [], 0, 1, 1
    for n in range(1, points + 1):
        trials = n - 1
        # below: the sum of C(trials, i) for i up to k, term: C(trials, k).
        if trials:
            below = 2 * below - term
            term = term * trials // (trials - k)
        while 20 * below < 2**trials:
            k += 1
            term = term * (trials - k + 1) // k
            below += term
        rows.append(f"({n}, {round(math.log2(n) + 3)}, {k})")
    return ", ".join(rows)


def _needed(sql: str, seen: set[str]) -> None:
    for name, body in TABLES.items():
        if name not in seen and re.search(rf"\b(FROM|JOIN)\s+{name}\b", sql):
            seen.add(name)
            _needed(body, seen)


def statement(sql: str, days: str = "", doubles: str = "", digits: int = 8) -> str:
    """The SQL with the shared definitions it uses; listed columns as text or rounded."""
    changes = [f'CAST("{c}" AS VARCHAR) AS "{c}"' for c in days.split()]
    changes += [f'round("{c}", {digits}) + 0.0 AS "{c}"' for c in doubles.split()]
    if changes:
        sql = f"SELECT * REPLACE ({', '.join(changes)}) FROM ({sql})"
    seen: set[str] = set()
    _needed(sql, seen)
    if not seen:
        return sql
    parts = [f"{name} AS ({body})" for name, body in TABLES.items() if name in seen]
    text = "WITH RECURSIVE " + ",\n".join(parts) + "\n" + sql
    return text.replace("{limits}", _limits(2600)) if "run_limits" in seen else text


def run_chart_sql(points: str, facet: str = "") -> str:
    """Run chart of a query giving the facet column, ``x`` and ``y``, one row per period."""
    f = f"{facet}, " if facet else ""
    part = f"PARTITION BY {facet}" if facet else ""
    by_run = f"PARTITION BY {facet}, run" if facet else "PARTITION BY run"
    return f"""
        WITH points AS ({points}),
        centred AS (SELECT *, median(y) OVER ({part}) AS centre FROM points),
        useful AS (SELECT *, CASE WHEN y > centre THEN 1 ELSE -1 END AS side FROM centred WHERE y <> centre),
        turned AS (SELECT *, CASE WHEN side <> lag(side) OVER ({part} ORDER BY x) THEN 1 ELSE 0 END AS crossed
                   FROM useful),
        runs AS (SELECT *, sum(crossed) OVER ({part} ORDER BY x ROWS UNBOUNDED PRECEDING) AS run FROM turned),
        sized AS (SELECT *, count(*) OVER ({by_run}) AS size FROM runs),
        facts AS (SELECT {f} CAST(count(*) AS INTEGER) AS n_useful, CAST(max(size) AS INTEGER) AS longest_run,
                         CAST(sum(crossed) AS INTEGER) AS n_crossings
                  FROM sized {'GROUP BY ' + facet if facet else ''})
        SELECT {'c.' + facet + ', ' if facet else ''} x, y, centre, s.n_useful, longest_run, longest_run_max,
               n_crossings, n_crossings_min,
               longest_run > longest_run_max OR n_crossings < n_crossings_min AS signal
        FROM centred c JOIN facts s ON {f'c.{facet} IS NOT DISTINCT FROM s.{facet}' if facet else 'TRUE'}
        JOIN run_limits l ON l.n_useful = s.n_useful"""


def km_sql(source: str, strata: str) -> str:
    return f"""
        WITH risk AS (
            SELECT {strata}, "LOS" AS time, CAST(sum(CASE WHEN NOT death_during_adm THEN 1 ELSE 0 END) AS BIGINT) AS n_event,
                   count(*) AS leaving
            FROM {source} WHERE {strata} IS NOT NULL AND "LOS" IS NOT NULL AND death_during_adm IS NOT NULL
            GROUP BY {strata}, "LOS"),
        counted AS (SELECT *, CAST(sum(leaving) OVER (PARTITION BY {strata} ORDER BY time DESC) AS BIGINT) AS n_risk
                    FROM risk)
        SELECT {strata}, time, n_risk, n_event, leaving - n_event AS n_censor,
               product(1 - n_event / n_risk) OVER (PARTITION BY {strata} ORDER BY time) AS survival
        FROM counted"""


PICK = "id, adm_id, ab_start_date, ab_stop_date, atc_code"
PICK_DAYS = "ab_start_date ab_stop_date"
DENSITY = """
    WITH hist AS (SELECT {by}, "LOS" AS los, count(*) AS n FROM {source} GROUP BY {by}, "LOS"),
    grid AS (SELECT CAST({low} + i * {step} AS DOUBLE) AS x FROM range({steps}) AS r(i))
    SELECT {by}, x, sum(n * exp(-0.5 * ((x - los) / {bw}) ** 2)) / (sum(n) * {bw} * sqrt(2 * pi())) AS density
    FROM hist, grid{more} GROUP BY {by}, x"""


def oracles() -> dict[str, str]:
    q = statement
    sql: dict[str, str] = {}

    # Sources and sinks
    adm_days = "adm_start_date adm_end_date birth_date"
    as_text = "CAST(id AS VARCHAR) AS id"
    sql["read_admissions"] = q(
        f"SELECT * REPLACE ({as_text}, CAST(adm_id AS VARCHAR) AS adm_id) FROM adm", adm_days
    )
    sql["read_prescriptions"] = q(f"SELECT * REPLACE ({as_text}) FROM rx", PICK_DAYS, "ddd_per_day")
    sql["read_tests"] = q(
        f"""SELECT CAST(t.id AS VARCHAR) AS id, specialty, mo, material, test_date,
                   CAST(test_number AS VARCHAR) AS test_number, amox, cipr, gent
            FROM tests t JOIN (SELECT adm_id, specialty FROM adm) a ON t.test_number = a.adm_id""",
        "test_date",
    )
    sql["read_dim"] = q("SELECT * FROM agents")
    sql["read_delimited_semicolon"] = q(f"SELECT * REPLACE ({as_text}) FROM rx", PICK_DAYS, "ddd_per_day")
    sql["coerce_dates"] = q("SELECT id, ab_start_date, ab_stop_date, atc_code FROM rx", PICK_DAYS)
    sql["export_cohort"] = q(
        'SELECT id, adm_id, ab_start_date, ab_stop_date, atc_code, ab_type, ab_first, "check", "LOS" FROM cohort',
        PICK_DAYS,
    )
    sql["export_tests"] = q(
        "SELECT id, adm_id, test_number, test_date, material, mo, fullname, first_isolate FROM cohort_tests",
        "test_date",
    )
    sql["export_view"] = q("SELECT sub_specialty, count(*) AS n FROM grain GROUP BY sub_specialty")

    # Derived columns
    sql["adm_calendar"] = q(
        "SELECT id, adm_id, adm_start_date, year, yearmonth_adm, yearquarter_adm FROM adm_d",
        "adm_start_date yearmonth_adm yearquarter_adm",
    )
    sql["test_calendar"] = q(
        """SELECT test_number, test_date, CAST(date_trunc('month', test_date) AS DATE) AS yearmonth_test,
                  CAST(date_trunc('quarter', test_date) AS DATE) AS yearquarter_test FROM tests""",
        "test_date yearmonth_test yearquarter_test",
    )
    sql["length_of_stay"] = q('SELECT id, adm_id, "LOS" FROM adm_d')
    sql["age_at_admission"] = q("SELECT id, adm_id, age FROM adm_d")
    sql["ab_days"] = q(f"SELECT {PICK}, ab_days FROM rx_adm", PICK_DAYS)
    sql["ab_timing"] = q(f"SELECT {PICK}, ab_timing FROM rx_adm", PICK_DAYS)
    sql["ddd_per_prescription"] = q(
        f"SELECT {PICK}, ddd_per_prescription FROM rx_adm", PICK_DAYS, "ddd_per_prescription"
    )
    sql["normalize_sir"] = q("SELECT test_number, amox, cipr, gent FROM tests")
    sql["normalize_organism"] = q("SELECT test_number, coalesce(mo, 'SIGNUP ') AS mo FROM tests")
    sql["sir_columns"] = q(
        """SELECT agent, filled, valid, valid / filled AS share, 1 - valid / filled <= 0.05 AS is_sir FROM (
               SELECT agent, count(value) AS filled, count(value) FILTER (value IN ('S', 'I', 'R')) AS valid
               FROM (UNPIVOT (SELECT material, mo, amox, cipr, gent FROM tests)
                     ON material, mo, amox, cipr, gent INTO NAME agent VALUE value) GROUP BY agent)""",
        doubles="share",
    )
    sql["sir_long"] = q(
        """SELECT test_number, 'amox' AS agent, amox AS interpretation FROM tests WHERE amox IS NOT NULL
           UNION ALL SELECT test_number, 'cipr', cipr FROM tests WHERE cipr IS NOT NULL
           UNION ALL SELECT test_number, 'gent', gent FROM tests WHERE gent IS NOT NULL"""
    )
    sql["agent_name"] = q(
        """SELECT agent_name, interpretation, count(*) AS n FROM (
               SELECT 'Amoxicillin' AS agent_name, amox AS interpretation FROM tests
               UNION ALL SELECT 'Ciprofloxacin', cipr FROM tests UNION ALL SELECT 'Gentamicin', gent FROM tests)
           WHERE interpretation IS NOT NULL GROUP BY agent_name, interpretation"""
    )
    sql["diagnostic_flag"] = q(
        """SELECT id, adm_id, uc_timing,
                  CASE WHEN uc_timing BETWEEN 0 AND 2 THEN 'Taken' ELSE 'Not taken' END AS "check" FROM adm_e"""
    )
    sql["discharge_event"] = q(
        "SELECT id, adm_id, CASE WHEN death_during_adm THEN 0 WHEN NOT death_during_adm THEN 1 END AS event FROM adm"
    )
    sql["year_as_text"] = q(
        'SELECT CAST(year AS VARCHAR) AS year, "LOS", count(*) AS n FROM grain GROUP BY ALL'
    )
    sql["period_label"] = q(
        """SELECT test_number, strftime(test_date, '%b %Y') AS month_label,
                  CAST(year(test_date) AS VARCHAR) || ' Q' || CAST(quarter(test_date) AS VARCHAR) AS quarter_label
           FROM tests"""
    )
    sql["rename_group"] = q('SELECT sub_specialty AS "Subspecialty", count(*) AS n FROM grain GROUP BY ALL')
    sql["percent_text"] = q(
        """SELECT specialty, "check", n,
                  regexp_replace(CAST(round(n / sum(n) OVER (PARTITION BY specialty) * 100, 1) AS VARCHAR), '\\.0$', '')
                  || '%' AS proportion
           FROM (SELECT specialty, "check", count(*) AS n FROM grain GROUP BY ALL)"""
    )
    sql["dynamic_group"] = " UNION ALL ".join(
        f"SELECT '{by}' AS by_column, CAST({by} AS VARCHAR) AS group_value, count(*) AS n FROM rx_e GROUP BY {by}"
        for by in ("specialty", "adm_route", "gender", "year", "ab_group")
    )
    sql["dynamic_group"] = q(sql["dynamic_group"])

    # Filters
    def chosen(where: str, column: str = "", days: str = "") -> str:
        extra = f", {column}" if column else ""
        return q(f"SELECT {PICK}{extra} FROM rx_e WHERE {where}", f"{PICK_DAYS} {days}")

    sql["f_route"] = chosen("ab_route IN ('IV', 'oral')", "ab_route")
    sql["f_first_only"] = chosen("ab_first", "ab_first")
    sql["f_ab_timing"] = chosen("ab_timing BETWEEN 2 AND 9", "ab_timing")
    sql["f_ab_type"] = chosen("ab_type IN ('brand#1', 'brand#12', 'brand#25')", "ab_type")
    sql["f_ab_days"] = chosen("ab_days >= 2", "ab_days")
    sql["f_course_days"] = chosen("ab_days_all BETWEEN 3 AND 10", "ab_days_all")
    sql["f_origin"] = chosen("adm_route IN ('1-URGENT', '5-LOW')", "adm_route")
    sql["f_year"] = chosen("year BETWEEN 1996 AND 1998", "year")
    sql["f_specialty"] = chosen("specialty IN ('ASIA', 'EUROPE')", "specialty")
    sql["f_exclude_subspecialty"] = chosen(
        "sub_specialty IS NULL OR sub_specialty NOT IN ('BUILDING-1', 'MACHINERY-0')", "sub_specialty"
    )
    sql["f_include_subspecialty"] = chosen("sub_specialty IN ('BUILDING-1', 'MACHINERY-0')", "sub_specialty")
    sql["f_age"] = chosen("age BETWEEN 18 AND 65", "age")
    sql["f_gender"] = chosen("gender = 'F' OR gender IS NULL", "gender")
    large = """SELECT sub_specialty FROM (SELECT DISTINCT id, adm_id, sub_specialty FROM rx_e)
               GROUP BY sub_specialty HAVING count(*) >= 600"""
    sql["f_min_patients"] = q(
        f"""SELECT {PICK}, r.sub_specialty FROM rx_e r JOIN ({large}) s
            ON r.sub_specialty IS NOT DISTINCT FROM s.sub_specialty""",
        PICK_DAYS,
    )
    sql["semi_min_n"] = q(
        f"""SELECT r.sub_specialty, count(*) AS n FROM rx_e r JOIN ({large}) s
            ON r.sub_specialty IS NOT DISTINCT FROM s.sub_specialty GROUP BY r.sub_specialty"""
    )
    sql["f_diagnostic"] = q(
        f"""SELECT {PICK}, CASE WHEN uc_timing BETWEEN -2 AND 0 THEN 'Taken' ELSE 'Not taken' END AS "check"
            FROM rx_e""",
        PICK_DAYS,
    )
    test_pick = 'id, adm_id, test_number, test_date, material, mo, "check"'
    sql["f_tests_taken"] = q(f"SELECT {test_pick} FROM cohort_tests", "test_date")
    sql["f_first_isolate_material"] = q(
        "SELECT id, adm_id, test_number, test_date, mo FROM tests_e WHERE first_isolate AND material = 'urine'",
        "test_date",
    )
    sql["f_isolate_name"] = q(
        """SELECT id, adm_id, test_number, fullname FROM tests_e
           WHERE first_isolate AND material = 'blood' AND fullname IN ('CLICK', 'ERROR')"""
    )
    sql["f_material"] = q("SELECT id, adm_id, bc_timing, uc_timing FROM timing")
    sql["f_not_null_agent"] = q("SELECT DISTINCT ab_type, ab_group FROM rx_e WHERE ab_type IS NOT NULL")
    sql["expand_groups"] = q("SELECT DISTINCT ab_type, ab_group FROM agents WHERE ab_group IN ('G1', 'G4')")

    # Joins
    sql["contain_join"] = q(
        f"SELECT {PICK}, ab_route, ddd_per_day, adm_start_date, adm_end_date FROM rx_adm",
        f"{PICK_DAYS} adm_start_date adm_end_date",
        "ddd_per_day",
    )
    sql["point_join"] = q(
        "SELECT id, adm_id, test_number, test_date, material, mo, adm_start_date, adm_end_date FROM tests_adm",
        "test_date adm_start_date adm_end_date",
    )
    sql["join_organism"] = q(
        "SELECT test_number, t.mo, fullname, family FROM tests t LEFT JOIN organisms o ON t.mo = o.mo"
    )
    sql["join_agent"] = q(f"SELECT {PICK}, ab_type, ab_group FROM rx_e", PICK_DAYS)
    sql["join_timing"] = q("SELECT id, adm_id, bc_timing, uc_timing FROM adm_e")
    sql["join_first_rx"] = q(
        """SELECT m.id, m.adm_id, test_number, min_ab_start,
                  CAST(test_date - min_ab_start AS INTEGER) AS days
           FROM tests_adm m JOIN first_start f ON m.id = f.id AND m.adm_id = f.adm_id""",
        "min_ab_start",
    )
    sql["semi_tests"] = q(
        """SELECT test_number, id, test_date, material FROM tests t WHERE EXISTS (
               SELECT 1 FROM adm a WHERE a.id = t.id AND test_date BETWEEN adm_start_date AND adm_end_date)""",
        "test_date",
    )
    sql["semi_rx"] = q(
        """SELECT id, ab_start_date, ab_stop_date, atc_code, ab_route FROM rx r WHERE EXISTS (
               SELECT 1 FROM adm a WHERE a.id = r.id AND ab_start_date >= adm_start_date
               AND ab_stop_date <= adm_end_date)""",
        PICK_DAYS,
    )
    sql["join_adm_on_tests"] = q(
        """SELECT id, adm_id, test_number, test_date, specialty, sub_specialty, year, age, "LOS", bc_timing, uc_timing,
                  first_isolate, fullname FROM tests_e""",
        "test_date",
    )
    sql["join_adm_on_rx"] = q(
        f'SELECT {PICK}, gender, specialty, sub_specialty, adm_route, year, "LOS", age, bc_timing, uc_timing FROM rx_e',
        PICK_DAYS,
    )
    sql["join_course"] = q(
        f"SELECT {PICK}, ab_start_cont, ab_stop_cont, ab_days_all FROM rx_e",
        f"{PICK_DAYS} ab_start_cont ab_stop_cont",
    )
    sql["join_los_back"] = q(
        """SELECT id, adm_id, ab_group, "LOS", coalesce(sum(ddd_per_prescription), 0) / "LOS" AS ddd_per_day
           FROM cohort GROUP BY id, adm_id, ab_group, "LOS" """,
        doubles="ddd_per_day",
    )
    sql["semi_cohort_tests"] = q(
        """SELECT t.id, t.adm_id, test_number, test_date, c."check" FROM tests_e t
           JOIN (SELECT DISTINCT id, adm_id, "check" FROM cohort) c ON t.id = c.id AND t.adm_id = c.adm_id""",
        "test_date",
    )

    def versus(by: str) -> str:
        return q(
            f"""SELECT *, round(taken_pct - overall_pct, 1) + 0.0 AS difference FROM (
                    SELECT {by}, round(count(*) FILTER ("check" = 'Taken') * 100.0E0 / count(*), 1) AS taken_pct,
                           (SELECT round(count(*) FILTER ("check" = 'Taken') * 100.0E0 / count(*), 1) FROM grain)
                               AS overall_pct
                    FROM grain GROUP BY {by})"""
        )

    sql["join_overall"] = versus("specialty")
    sql["diagnostic_vs_average"] = versus("sub_specialty")
    sql["overall_rate"] = versus("adm_route")

    # Aggregations
    sql["first_rx"] = q("SELECT * FROM first_start", "min_ab_start")
    sql["days_to_first_test"] = q("SELECT id, adm_id, bc_timing FROM timing WHERE bc_timing IS NOT NULL")
    sql["group_min_filter"] = q("SELECT id, adm_id, uc_timing FROM timing WHERE uc_timing IS NOT NULL")
    sql["agent_domain"] = q("SELECT ab_type, count(*) AS n FROM rx_e WHERE ab_type IS NOT NULL GROUP BY ab_type")
    sql["group_domain"] = q("SELECT DISTINCT ab_group FROM rx_e WHERE ab_group IS NOT NULL")
    sql["agent_group_pairs"] = q("SELECT DISTINCT ab_type, ab_group FROM rx_e")
    sql["selector_ranges"] = q(
        " UNION ALL ".join(
            f"""SELECT '{c}' AS selector, CAST(min("{c}") AS INTEGER) AS lowest,
                       CAST(max("{c}") AS INTEGER) AS highest FROM {t}"""
            for t, cs in {
                "rx_e": ("ab_timing", "ab_days_all", "year"),
                "adm_e": ("age", "LOS", "bc_timing", "uc_timing"),
            }.items()
            for c in cs
        )
    )
    sql["selector_values"] = q(
        " UNION ALL ".join(
            f"SELECT DISTINCT '{c}' AS selector, {c} AS choice FROM {t} WHERE {c} IS NOT NULL"
            for t, cs in {
                "rx_e": ("ab_route", "ab_type", "ab_group"),
                "adm_e": ("gender", "specialty", "sub_specialty", "adm_route"),
            }.items()
            for c in cs
        )
    )
    sql["admission_total"] = q("SELECT count(*) AS n FROM grain")
    sql["distinct_admissions"] = q(
        """SELECT id, adm_id, ab_start_date, ab_stop_date, atc_code, ab_route, ab_type, ab_group, specialty, "LOS",
                  "check" FROM grain""",
        PICK_DAYS,
    )

    def counted(by: str, source: str = "grain", days: str = "", limit: int | None = None) -> str:
        keys = ", ".join(f"{k} DESC" if False else f"{k} NULLS FIRST" for k in by.split(", "))
        tail = f" ORDER BY n DESC, {keys} LIMIT {limit}" if limit else ""
        return q(f"SELECT {by}, count(*) AS n FROM {source} GROUP BY {by}{tail}", days)

    sql["patients_by_subspecialty"] = counted("sub_specialty", limit=10)
    sql["top_10"] = counted("specialty, sub_specialty", limit=10)
    sql["subspecialty_table"] = counted("sub_specialty")
    sql["age_distribution"] = counted("age, gender")
    sql["admissions_per_period"] = counted("yearmonth_adm", days="yearmonth_adm")
    sql["prescriptions_by"] = counted("ab_group", "cohort")
    sql["reorder_desc"] = counted("ab_type", "cohort")
    sql["order_desc"] = counted("adm_route", "cohort")
    sql["order_asc"] = q("SELECT DISTINCT fullname FROM tests_e WHERE fullname IS NOT NULL")
    sql["distinct_rows"] = q("SELECT DISTINCT specialty, sub_specialty, adm_route, gender FROM cohort")
    sql["n_distinct_groups"] = q("SELECT count(*) AS n FROM (SELECT DISTINCT sub_specialty FROM grain)")

    def doses(by: str) -> str:
        return f"""SELECT id, adm_id, {by}, "LOS", coalesce(sum(ddd_per_prescription), 0) AS ddd,
                          coalesce(sum(ab_days), 0) AS dot FROM cohort GROUP BY id, adm_id, {by}, "LOS" """

    ratios = 'sum(ddd / "LOS") / 100 AS ddd_100, sum(dot / "LOS") / 100 AS dot_100'
    sql["dose_density"] = q(
        f"SELECT ab_group, {ratios} FROM ({doses('ab_group')}) GROUP BY ab_group", doubles="ddd_100 dot_100"
    )
    sql["dose_density_pooled"] = q(
        f"""SELECT ab_group, 100 * sum(ddd) / sum("LOS") AS ddd_100, 100.0E0 * sum(dot) / sum("LOS") AS dot_100
            FROM ({doses('ab_group')}) GROUP BY ab_group""",
        doubles="ddd_100 dot_100",
    )
    sql["dose_table"] = q(
        f"SELECT sub_specialty, {ratios} FROM ({doses('sub_specialty')}) GROUP BY sub_specialty",
        doubles="ddd_100 dot_100",
        digits=2,
    )
    sql["dose_per_admission"] = q(
        """SELECT *, ddd_sum / "LOS" / 100 AS ddd_per_day_100, dot_sum / "LOS" / 100 AS dot_per_day_100
           FROM admission_doses""",
        "yearmonth_adm yearquarter_adm",
        "ddd_sum ddd_per_day_100 dot_per_day_100",
    )
    series = "x y centre"
    sql["dose_timeseries"] = q(
        run_chart_sql(
            """SELECT specialty, yearmonth_adm AS x, sum(ddd_sum / "LOS" / 100) AS y FROM admission_doses
               GROUP BY specialty, yearmonth_adm""",
            "specialty",
        ),
        "x",
        "y centre",
    )
    sql["dose_timeseries_dot"] = q(
        run_chart_sql(
            """SELECT yearquarter_adm AS x, sum(dot_sum / "LOS" / 100) AS y FROM admission_doses
               GROUP BY yearquarter_adm"""
        ),
        "x",
        "y centre",
    )
    sql["run_chart"] = q(
        run_chart_sql(
            """SELECT sub_specialty, yearmonth_adm AS x, CAST(count(*) AS DOUBLE) AS y FROM grain
               GROUP BY sub_specialty, yearmonth_adm""",
            "sub_specialty",
        ),
        "x",
        "y centre",
    )
    sql["run_chart_daily"] = q(
        run_chart_sql(
            """SELECT adm_start_date AS x, CAST(count(*) AS DOUBLE) AS y FROM grain GROUP BY adm_start_date"""
        ),
        "x",
        "y centre",
    )
    sql["diagnostics_per_period"] = q(
        """SELECT yearquarter_adm, "check", n, n / sum(n) OVER (PARTITION BY yearquarter_adm) AS share
           FROM (SELECT yearquarter_adm, "check", count(*) AS n FROM grain GROUP BY ALL)""",
        "yearquarter_adm",
        "share",
    )
    sql["diagnostic_timing"] = q('SELECT bc_timing, "check", count(*) AS n FROM grain GROUP BY ALL')
    sql["diagnostic_table"] = q(
        """SELECT specialty, "check", n, n / sum(n) OVER (PARTITION BY specialty) * 100 AS proportion
           FROM (SELECT specialty, "check", count(*) AS n FROM grain GROUP BY ALL)""",
        doubles="proportion",
        digits=1,
    )
    sql["isolate_frequency"] = q(
        """SELECT fullname, specialty, count(*) AS n FROM isolates GROUP BY fullname, specialty
           ORDER BY n DESC, fullname NULLS FIRST, specialty NULLS FIRST LIMIT 12"""
    )
    sql["top_n"] = q(
        """SELECT fullname, count(*) AS n FROM all_isolates WHERE material = 'urine' GROUP BY fullname
           ORDER BY n DESC, fullname LIMIT 3"""
    )
    sql["isolate_freq_table"] = q(
        "SELECT fullname, sub_specialty, count(*) AS n FROM isolates GROUP BY fullname, sub_specialty"
    )

    def spread(by: str, agent: str, source: str, kinds: dict[str, str], value: str) -> str:
        return " UNION ALL ".join(
            f"""SELECT {by}, '{agent}' AS agent, '{k}' AS interpretation,
                       {value.format(hit=f"count(*) FILTER ({agent} IN ({v}))", tested=f"count({agent})")} AS value
                FROM {source} GROUP BY {by}"""
            for k, v in kinds.items()
        )

    single = {"S": "'S'", "I": "'I'", "R": "'R'"}
    merged = {"SI": "'S', 'I'", "R": "'R'"}
    share = "CASE WHEN {tested} >= 30 THEN {hit} / {tested} END"
    sql["sir_counts"] = q(spread("fullname", "amox", "isolates", single, "{hit}"))
    sql["sir_portions"] = q(
        spread("specialty", "amox", "isolates", merged, share)
        + " UNION ALL "
        + spread("specialty", "cipr", "isolates", merged, share),
        doubles="value",
    )
    co = """count(*) FILTER (amox IS NOT NULL AND cipr IS NOT NULL) AS n_tested,
            count(*) FILTER (amox = 'R' AND cipr = 'R') AS value"""
    sql["co_resistance"] = q(f"SELECT fullname, {co} FROM all_isolates GROUP BY fullname")
    sql["co_resistance_share"] = q(
        f"""SELECT fullname, n_tested, CASE WHEN n_tested >= 30 THEN value / n_tested END AS value
            FROM (SELECT fullname, {co} FROM all_isolates GROUP BY fullname)""",
        doubles="value",
    )
    sql["resistance_timeseries"] = q(
        run_chart_sql(
            " UNION ALL ".join(
                f"""SELECT '{k}' AS interpretation, yearquarter_test AS x,
                           CAST(count(*) FILTER (amox = '{k}') AS DOUBLE) AS y
                    FROM all_isolates GROUP BY yearquarter_test"""
                for k in "SIR"
            ),
            "interpretation",
        ),
        "x",
        "y centre",
    )
    sql["resistance_table"] = q(
        """SELECT specialty, 'Gentamicin' AS agent, count(*) FILTER (gent IN ('S', 'I')) AS "SI",
                  count(*) FILTER (gent = 'R') AS "R" FROM isolates GROUP BY specialty"""
    )
    sql["resistance_table_co"] = q(
        """SELECT year, 'Amoxicillin & Ciprofloxacin' AS agent,
                  CASE WHEN count(*) FILTER (amox IS NOT NULL AND cipr IS NOT NULL) >= 30
                       THEN count(*) FILTER (amox = 'R' AND cipr = 'R')
                            / count(*) FILTER (amox IS NOT NULL AND cipr IS NOT NULL) END AS "R"
           FROM all_isolates GROUP BY year""",
        doubles="R",
    )
    percent = """CASE WHEN count(amox) >= 30 THEN regexp_replace(CAST(round(
        count(*) FILTER (amox IN ({v})) / count(amox) * 100, 1) AS VARCHAR), '\\.0$', '') || '%' END"""
    sql["resistance_table_text"] = q(
        f"""SELECT CAST(year(yearquarter_test) AS VARCHAR) || ' Q' || CAST(quarter(yearquarter_test) AS VARCHAR)
                       AS yearquarter_test,
                   'amox' AS agent, {percent.format(v="'S', 'I'")} AS "SI", {percent.format(v="'R'")} AS "R"
            FROM all_isolates t GROUP BY t.yearquarter_test"""
    )
    sql["los_histogram"] = q(
        'SELECT specialty, "LOS", count(*) AS n FROM grain WHERE "LOS" BETWEEN 5 AND 20 GROUP BY specialty, "LOS"'
    )
    sql["los_density"] = q(
        DENSITY.format(by="specialty", source="grain", low=0, step=1, steps=36, bw="1.0", more=""),
        doubles="density",
    )
    bandwidth = """
        , (SELECT avg(0.9 * least(sd, iqr / 1.34) * n ** -0.2) AS bw FROM (
            SELECT specialty, stddev_samp("LOS") AS sd, count(*) AS n,
                   quantile_cont("LOS", 0.75) - quantile_cont("LOS", 0.25) AS iqr
            FROM grain GROUP BY specialty))"""
    sql["los_ridges"] = q(
        DENSITY.format(by="specialty", source="grain", low=0, step=0.5, steps=81, bw="any_value(bw)", more=bandwidth)
        .replace("(x - los) / any_value(bw)", "(x - los) / bw"),
        doubles="density",
    )
    sql["los_summary"] = q(
        """SELECT *, n / sum(n) OVER () * 100 AS proportion FROM (
               SELECT ab_group, avg("LOS") AS mean_los, median("LOS") AS median_los,
                      quantile_cont("LOS", 0.25) AS q1, quantile_cont("LOS", 0.75) AS q3, count(*) AS n,
                      count(*) FILTER ("LOS" IS NULL) AS n_missing
               FROM grain GROUP BY ab_group)""",
        doubles="mean_los median_los q1 q3 proportion",
        digits=1,
    )

    # Window functions
    sql["ddd_total"] = q(f"SELECT {PICK}, ddd_total FROM rx_e", PICK_DAYS, "ddd_total")
    sql["ab_first"] = q(f"SELECT {PICK}, ab_first FROM rx_e", PICK_DAYS)
    sql["first_course"] = q("SELECT * FROM course", "ab_start_cont ab_stop_cont")
    sql["all_courses"] = q(
        """WITH opened AS (
               SELECT id, adm_id, ab_start_date, ab_stop_date, atc_code,
                      max(ab_stop_date) OVER (PARTITION BY id, adm_id ORDER BY ab_start_date, ab_stop_date, atc_code
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS open_until FROM rx_adm),
           numbered AS (
               SELECT *, CAST(sum(CASE WHEN ab_start_date - open_until <= 1 THEN 0 ELSE 1 END) OVER (
                   PARTITION BY id, adm_id ORDER BY ab_start_date, ab_stop_date, atc_code
                   ROWS UNBOUNDED PRECEDING) AS INTEGER) AS course FROM opened)
           SELECT id, adm_id, course, min(ab_start_date) AS course_start, max(ab_stop_date) AS course_stop,
                  CAST(max(ab_stop_date) - min(ab_start_date) + 1 AS INTEGER) AS course_days
           FROM numbered GROUP BY id, adm_id, course""",
        "course_start course_stop",
    )
    sql["share_in_group"] = q(
        """SELECT gender, ab_group, n, n / sum(n) OVER (PARTITION BY gender) AS share
           FROM (SELECT gender, ab_group, count(*) AS n FROM cohort GROUP BY ALL)""",
        doubles="share",
    )
    sql["share_of_total"] = q(
        """SELECT ab_type, n, n / sum(n) OVER () AS share
           FROM (SELECT ab_type, count(*) AS n FROM cohort GROUP BY ALL)""",
        doubles="share",
    )
    sql["first_isolate"] = q("SELECT test_number, id, mo, test_date, material, first_isolate FROM tests_f", "test_date")

    # Survival
    sql["km_curve"] = q(km_sql("grain", "specialty"), doubles="survival")
    sql["km_display_window"] = q(
        f"""SELECT * FROM ({km_sql("grain", '"check"')}) WHERE time BETWEEN 5 AND 20""", doubles="survival"
    )
    sql["logrank_table"] = q(
        """WITH at_time AS (
               SELECT "LOS" AS t, specialty, count(*) AS m,
                      sum(CASE WHEN NOT death_during_adm THEN 1 ELSE 0 END) AS d
               FROM grain GROUP BY "LOS", specialty),
           cells AS (
               SELECT times.t, strata.specialty, coalesce(m, 0) AS m, coalesce(d, 0) AS d
               FROM (SELECT DISTINCT t FROM at_time) times CROSS JOIN (SELECT DISTINCT specialty FROM at_time) strata
               LEFT JOIN at_time a ON a.t = times.t AND a.specialty = strata.specialty),
           risk AS (
               SELECT *, sum(m) OVER (PARTITION BY specialty ORDER BY t DESC) AS nk FROM cells),
           pooled AS (
               SELECT *, sum(nk) OVER (PARTITION BY t) AS n, sum(d) OVER (PARTITION BY t) AS dd FROM risk)
           SELECT specialty, CAST(sum(m) AS BIGINT) AS n, CAST(sum(d) AS BIGINT) AS observed,
                  sum(dd * nk / n) AS expected,
                  sum(CASE WHEN n > 1 THEN dd * (n - dd) / (n - 1) * (nk / n) * (1 - nk / n) END) AS variance
           FROM pooled GROUP BY specialty""",
        doubles="expected variance",
    )
    # Three routes: two degrees of freedom, so the system is 2 x 2 and the tail is exp(-x / 2).
    sql["logrank_test"] = q(
        """WITH at_time AS (
               SELECT "LOS" AS t, ab_route AS s, count(*) AS m,
                      sum(CASE WHEN NOT death_during_adm THEN 1 ELSE 0 END) AS d
               FROM grain WHERE ab_route IS NOT NULL GROUP BY "LOS", ab_route),
           wide AS (
               SELECT t, sum(d) AS d, sum(CASE WHEN s = 'IM' THEN d ELSE 0 END) AS d1,
                      sum(CASE WHEN s = 'IV' THEN d ELSE 0 END) AS d2, sum(m) AS m,
                      sum(CASE WHEN s = 'IM' THEN m ELSE 0 END) AS m1,
                      sum(CASE WHEN s = 'IV' THEN m ELSE 0 END) AS m2
               FROM at_time GROUP BY t),
           risk AS (
               SELECT d, d1, d2, sum(m) OVER w AS n, sum(m1) OVER w / sum(m) OVER w AS p1,
                      sum(m2) OVER w / sum(m) OVER w AS p2
               FROM wide WINDOW w AS (ORDER BY t DESC)),
           sums AS (
               SELECT sum(d1 - d * p1) AS u1, sum(d2 - d * p2) AS u2,
                      sum(CASE WHEN n > 1 THEN d * (n - d) / (n - 1) * p1 * (1 - p1) END) AS v11,
                      sum(CASE WHEN n > 1 THEN d * (n - d) / (n - 1) * p2 * (1 - p2) END) AS v22,
                      -sum(CASE WHEN n > 1 THEN d * (n - d) / (n - 1) * p1 * p2 END) AS v12
               FROM risk),
           solved AS (
               SELECT (u1 * u1 * v22 - 2 * u1 * u2 * v12 + u2 * u2 * v11) / (v11 * v22 - v12 * v12) AS chisq
               FROM sums)
           SELECT chisq, 2 AS df, exp(-chisq / 2) AS p_value FROM solved""",
        doubles="chisq p_value",
    )
    return sql
