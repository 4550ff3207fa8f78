"""SQL that computes the same results another way, for the registered queries.

Funnels are chains of joins, sequences are row numbers, journey alignment and name similarity are
recursive queries. ``r(x, d)`` rounds through decimal text, which is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from workload.queries import (
    CLICK_ENDS,
    CLICK_STEPS,
    DAYS_C,
    DAYS_O,
    ORDER_ENDS,
    ORDER_FUNNEL,
    ORDER_STEPS,
)

PROPERTIES = ("segment", "nation", "region", "balance_band")

USERS = """users AS (
  SELECT c_custkey AS user_id, c_mktsegment AS segment, n_name AS nation, r_name AS region,
    CASE WHEN c_acctbal < 0 THEN 'negative' WHEN c_acctbal < 5000 THEN 'mid' ELSE 'high' END AS balance_band
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
LOG_O = "log AS (SELECT o_custkey AS user_id, o_orderpriority AS event, o_orderdate AS ts FROM orders)"
LOG_C = "log AS (SELECT user_id, event_type AS event, ts FROM events)"
ORDERS = f"{USERS}, {LOG_O}"
CLICKS = f"{USERS}, {LOG_C}"

ORDER_DAYS, ORDER_WINDOW = ORDER_FUNNEL["timeframe_days"], ORDER_FUNNEL["conversion_window_days"]


def r(x: str, digits: int = 4) -> str:
    return f"(CAST(format('{{:.{digits}f}}', CAST({x} AS DOUBLE)) AS DOUBLE) + 0.0)"


def pct(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN {r(f'CAST({part} AS DOUBLE) / {whole}')} ELSE 0.0 END"


def quoted(names: Sequence[str]) -> str:
    return ", ".join(f"'{n}'" for n in names)


def since(days: int) -> str:
    return f"ts >= (SELECT max(ts) FROM log) - INTERVAL {days} DAY"


def recent(days: int) -> str:
    return f"recent AS (SELECT * FROM log WHERE {since(days)})"


# -------------------------------------------------------------------- funnel


def reach(steps: Sequence[str], days: int, window: int, cohort: str = "users", name: str = "reach") -> str:
    """A user's times of all steps in one row; step after step the least time that is allowed is picked from its list."""
    times = [f"list(ts) FILTER (WHERE event = '{event}') AS times_{k}" for k, event in enumerate(steps, 1)]
    rows = (
        f"SELECT user_id, {', '.join(times)} FROM log"
        f" WHERE {since(days)} AND user_id IN (SELECT user_id FROM {cohort}) GROUP BY user_id"
    )
    picked = f"SELECT *, list_min(times_1) AS at_1 FROM ({rows})"
    for k in range(2, len(steps) + 1):
        allowed = f"lambda x: x > at_{k - 1} AND x <= at_1 + INTERVAL {window} DAY"
        picked = f"SELECT *, list_min(list_filter(times_{k}, {allowed})) AS at_{k} FROM ({picked})"
    passed = " + ".join(f"(at_{k} IS NOT NULL)::INTEGER" for k in range(1, len(steps) + 1))
    return f"{name} AS (SELECT user_id, {passed} AS reached FROM ({picked}) WHERE at_1 IS NOT NULL)"


ORDER_REACH = reach(ORDER_STEPS, ORDER_DAYS, ORDER_WINDOW)


def steps_table(steps: Sequence[str], source: str, keys: Sequence[str] = (), name: str = "table_rows") -> str:
    """CTEs ending in ``name``: the step table of ``source``, which has the keys and ``reached``."""
    lead = "".join(f"{k}, " for k in keys)
    on = " AND ".join(f"c.{k} = s.{k}" for k in keys) or "true"
    before = " AND ".join([f"p.{k} = c.{k}" for k in keys] + ["p.step = c.step - 1"])
    labels = " UNION ALL ".join(f"SELECT {k} AS step, '{e}' AS event" for k, e in enumerate(steps, 1))
    names = ", ".join(f"c.{k}" for k in keys)
    names = f"{names}, " if names else ""
    group = f"GROUP BY {lead}step, event"
    return f"""{name}_labels AS ({labels}),
{name}_counts AS (SELECT {lead}step, event, count(*) FILTER (WHERE reached >= step) AS users
  FROM {source}, {name}_labels {group}),
{name} AS (SELECT {names}CAST(c.step AS INTEGER) AS step, c.event, c.users,
  {pct('c.users', 's.users')} AS conversion_from_start,
  CASE WHEN p.users > 0 THEN {r('1.0::DOUBLE - c.users::DOUBLE / p.users')} ELSE 0.0 END AS lost_from_previous
  FROM {name}_counts c JOIN {name}_counts s ON s.step = 1 AND {on} LEFT JOIN {name}_counts p ON {before})"""


# -------------------------------------------------------------- segments


def discovery(segment: str, days: int, top: int, name: str) -> str:
    return f"""{name}_counts AS (
  SELECT event, count(DISTINCT user_id) AS p,
    count(DISTINCT user_id) FILTER (WHERE user_id IN (SELECT user_id FROM {segment})) AS s
  FROM log WHERE {since(days)} GROUP BY event),
{name}_shares AS (SELECT event, {r(f'CAST(s AS DOUBLE) / (SELECT count(DISTINCT user_id) FROM {segment})')} AS segment_pct,
  {r('CAST(p AS DOUBLE) / (SELECT count(*) FROM users)')} AS population_pct FROM {name}_counts),
{name}_lifts AS (SELECT *, {r('segment_pct / greatest(population_pct, 0.005::DOUBLE)')} AS lift FROM {name}_shares),
{name} AS (SELECT * FROM {name}_lifts
  ORDER BY abs(ln(CASE WHEN lift > 0 THEN lift ELSE 0.0001::DOUBLE END)) DESC, event LIMIT {top})"""


def profile(segment: str, least: float, name: str) -> str:
    cells = " UNION ALL ".join(
        f"SELECT '{p}' AS property, {p} AS value, count(*) AS p,"
        f" count(*) FILTER (WHERE user_id IN (SELECT user_id FROM {segment})) AS s FROM users GROUP BY {p}"
        for p in PROPERTIES
    )
    change = r("(segment_pct - population_pct) / greatest(population_pct, 0.01::DOUBLE)")
    return f"""{name}_shares AS (SELECT property, value,
  {r(f'CAST(s AS DOUBLE) / (SELECT count(DISTINCT user_id) FROM {segment})')} AS segment_pct,
  {r('CAST(p AS DOUBLE) / (SELECT count(*) FROM users)')} AS population_pct FROM ({cells}) WHERE value IS NOT NULL),
{name}_all AS (SELECT *, {change} AS relative_change FROM {name}_shares),
{name} AS (SELECT * FROM {name}_all WHERE abs(relative_change) >= {least}::DOUBLE AND segment_pct >= 0.02::DOUBLE)"""


def compared(a: str, b: str, keys: Sequence[str], name: str) -> str:
    using = ", ".join(keys)
    return f"""{name}_sides AS (SELECT {using}, coalesce(a.segment_pct, b.population_pct) AS a_pct,
  coalesce(b.segment_pct, a.population_pct) AS b_pct FROM {a} a FULL JOIN {b} b USING ({using})),
{name} AS (SELECT *, {r('a_pct - b_pct')} AS delta FROM {name}_sides
  WHERE abs({r('a_pct - b_pct')}) >= 0.05::DOUBLE)"""


ORDER_SEGMENTS = """stalled AS (SELECT user_id FROM reach WHERE reached = 1),
converted AS (SELECT user_id FROM reach WHERE reached >= 3)"""


# ----------------------------------------------------------------- sequences


def compressed(source: str = "recent") -> str:
    return f"""marked AS (SELECT user_id, ts, event, lag(event) OVER (PARTITION BY user_id ORDER BY ts, event) AS prev FROM {source}),
seq AS (SELECT user_id, ts, event, row_number() OVER (PARTITION BY user_id ORDER BY ts, event) AS rn
  FROM marked WHERE prev IS NULL OR prev <> event)"""


def journeys_sql(ends: Sequence[str], source: str = "recent") -> str:
    """Sequences, bounds and steps of the journeys, by row numbers."""
    start, end = ends
    return f"""{compressed(source)},
firsts AS (SELECT user_id, min(rn) AS i FROM seq WHERE event = '{start}' GROUP BY user_id),
ends AS (SELECT f.user_id, f.i, min(s.rn) AS j FROM firsts f
  LEFT JOIN seq s ON s.user_id = f.user_id AND s.rn > f.i AND s.event = '{end}' GROUP BY f.user_id, f.i),
bounds AS (SELECT e.user_id, e.j IS NOT NULL AS completed, coalesce(max(s.rn), any_value(e.i)) AS lo, e.j AS hi FROM ends e
  LEFT JOIN seq s ON s.user_id = e.user_id AND s.rn < e.j AND s.event = '{start}' GROUP BY e.user_id, e.j),
journey AS (SELECT s.user_id, b.completed, s.rn - b.lo + 1 AS pos, s.event FROM seq s JOIN bounds b ON s.user_id = b.user_id
  WHERE s.rn >= b.lo AND (b.hi IS NULL OR s.rn <= b.hi)),
windows AS (SELECT user_id, string_agg(event, ' -> ' ORDER BY pos) AS path, list(event ORDER BY pos) AS events
  FROM journey WHERE completed GROUP BY user_id)"""


def journey_map_sql(ends: Sequence[str], source: str = "recent") -> str:
    """Greedy alignment, one recursion step per matched path step."""
    return f"""{journeys_sql(ends, source)},
canonical AS (SELECT path, events, users, row_number() OVER (ORDER BY users DESC, path) AS id FROM
  (SELECT path, any_value(events) AS events, count(*) AS users FROM windows GROUP BY path ORDER BY users DESC, path LIMIT 5)),
matching(user_id, id, matched, spot) AS (
  SELECT b.user_id, c.id, 0, CAST(0 AS BIGINT) FROM bounds b, canonical c
  UNION ALL
  SELECT m.user_id, m.id, m.matched + 1, n.pos FROM matching m JOIN canonical c ON c.id = m.id
  JOIN (SELECT user_id, pos, event, max(pos) OVER (PARTITION BY user_id, event ORDER BY pos
          ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING) AS earlier FROM journey) n
    ON n.user_id = m.user_id AND n.event = c.events[m.matched + 1] AND n.pos > m.spot
    AND (n.earlier IS NULL OR n.earlier <= m.spot)
  WHERE m.matched < len(c.events)),
aligned AS (SELECT user_id, id, matched FROM
  (SELECT user_id, id, max(matched) AS matched FROM matching GROUP BY user_id, id)
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY matched DESC, id) = 1),
node_rows AS (SELECT a.user_id, g.step, c.events[g.step + 1] AS event FROM aligned a JOIN canonical c USING (id),
  LATERAL (SELECT unnest(generate_series(0, a.matched - 1)) AS step) g),
nodes AS (SELECT CAST(step AS INTEGER) AS step, event, count(*) AS users,
  {r('CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM bounds)')} AS pct_of_start FROM node_rows GROUP BY step, event)"""


# ----------------------------------------------------------------- breakdown


def entries(base: str, n: int, properties: Sequence[str], top: int, name: str) -> str:
    """CTEs ending in ``name``: scored values of the users in ``base`` (``user_id``, ``reached``)."""
    cells = " UNION ALL ".join(
        f"SELECT '{p}' AS property, {p} AS value, count(*) AS s, count(*) FILTER (WHERE reached >= {n}) AS e"
        f" FROM {base} JOIN users USING (user_id) WHERE reached >= 1 AND {p} IS NOT NULL GROUP BY {p}"
        for p in properties
    )
    return f"""{name}_base AS (SELECT count(*) AS base_users, {pct(f'count(*) FILTER (WHERE reached >= {n})', 'count(*)')} AS base_conversion
  FROM {base} WHERE reached >= 1),
{name}_values AS (SELECT property, value, s, {r('CAST(e AS DOUBLE) / s')} AS conversion FROM ({cells})
  QUALIFY row_number() OVER (PARTITION BY property ORDER BY s DESC, value) <= {top}),
{name}_lifts AS (SELECT property, value, conversion, {r('conversion - base_conversion')} AS lift, s AS affected_users,
  base_users, base_conversion FROM {name}_values, {name}_base
  WHERE s >= greatest(50, ceil(0.01::DOUBLE * base_users))),
{name} AS (SELECT property, value, conversion, lift, affected_users, {r('affected_users * abs(lift)', 1)} AS impact,
  base_users, base_conversion FROM {name}_lifts)"""


def ranked_sides(source: str) -> str:
    return f"""SELECT *, CAST(row_number() OVER (PARTITION BY kind ORDER BY impact DESC, property, value) AS INTEGER) AS rank FROM
  (SELECT *, CASE WHEN lift > 0 THEN 'booster' WHEN lift < 0 THEN 'blocker' END AS kind FROM {source}) WHERE kind IS NOT NULL
  QUALIFY rank <= 5"""


# --------------------------------------------------------------- drill-down


def drilldown(max_depth: int) -> str:
    """CTEs ending in ``tree``: per level, the funnels of its cohorts and the blockers of their worst pair.

    Every cohort's pair funnel is run by itself: first match of the pair's first step, then any match
    of its second inside the window.
    """
    pairs = [ORDER_STEPS[k : k + 2] for k in range(len(ORDER_STEPS) - 1)]
    parts = [USERS, LOG_O, ORDER_REACH]
    parts += [reach(pair, ORDER_DAYS, ORDER_WINDOW, name=f"pair{k}") for k, pair in enumerate(pairs, 1)]
    parts.append(
        "pair_reach AS (" + " UNION ALL ".join(f"SELECT {k} AS pair, * FROM pair{k}" for k in range(1, len(pairs) + 1)) + ")"
    )
    nulls = ", ".join(f"CAST(NULL AS VARCHAR) AS f_{p}" for p in PROPERTIES)
    parts.append(f"front_0 AS (SELECT '{{}}' AS signature, '' AS parent, 0 AS depth, '' AS label, '{{}}' AS sort_key, {nulls})")
    inside = " AND ".join(f"(f_{p} IS NULL OR f_{p} = u.{p})" for p in PROPERTIES)
    sig = " || ',' || ".join(
        f"CASE WHEN n_{p} IS NULL THEN '' ELSE '\"{p}\":\"' || n_{p} || '\"' END" for p in sorted(PROPERTIES)
    )
    for d in range(max_depth + 1):
        cells = " UNION ALL ".join(
            f"SELECT signature, '{p}' AS property, {p} AS value, reached FROM open_users_{d} WHERE f_{p} IS NULL AND {p} IS NOT NULL"
            for p in PROPERTIES
        )
        can_open = f"AND lost >= 200 AND {d} < {max_depth}"
        news = ", ".join(f"CASE WHEN property = '{p}' THEN value ELSE f_{p} END AS n_{p}" for p in PROPERTIES)
        parts.append(f"""cohort_users_{d} AS (SELECT f.signature, reached FROM front_{d} f, reach JOIN users u USING (user_id) WHERE {inside}),
counts_{d} AS (SELECT signature, count(*) AS n1, count(*) FILTER (WHERE reached >= 2) AS n2, count(*) FILTER (WHERE reached >= 3) AS n3
  FROM cohort_users_{d} GROUP BY signature),
node_{d} AS (SELECT f.*, n1, n2, n3, CASE WHEN n2 - n3 > n1 - n2 THEN 2 ELSE 1 END AS worst, greatest(n1 - n2, n2 - n3) AS lost
  FROM front_{d} f JOIN counts_{d} USING (signature)),
open_users_{d} AS (SELECT f.*, u.segment, u.nation, u.region, u.balance_band, p.reached FROM node_{d} f, users u, pair_reach p
  WHERE p.user_id = u.user_id AND p.pair = f.worst AND {inside} {can_open}),
bases_{d} AS (SELECT signature, count(*) AS bu, {r('CAST(count(*) FILTER (WHERE reached >= 2) AS DOUBLE) / count(*)')} AS bc
  FROM open_users_{d} GROUP BY signature),
values_{d} AS (SELECT signature, property, value, count(*) AS s, {r('CAST(count(*) FILTER (WHERE reached >= 2) AS DOUBLE) / count(*)')} AS c
  FROM ({cells}) GROUP BY signature, property, value
  QUALIFY row_number() OVER (PARTITION BY signature, property ORDER BY s DESC, value) <= 8),
lifts_{d} AS (SELECT signature, property, value, s, {r('c - bc')} AS lift FROM values_{d} JOIN bases_{d} USING (signature)
  WHERE s >= greatest(50, ceil(0.01::DOUBLE * bu))),
blockers_{d} AS (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY impact DESC, property, value) AS rank FROM
  (SELECT *, {r('s * abs(lift)', 1)} AS impact FROM lifts_{d} WHERE lift < 0) QUALIFY rank <= 3),
proposed_{d} AS (SELECT n.signature AS parent, n.label, n.sort_key, property, value, {news}
  FROM node_{d} n JOIN blockers_{d} b USING (signature) WHERE b.s >= greatest(200, floor(n.lost * 0.1::DOUBLE))),
signed_{d} AS (SELECT *, '{{' || regexp_replace(trim({sig}, ','), ',+', ',', 'g') || '}}' AS signature FROM proposed_{d}),
front_{d + 1} AS (SELECT signature, parent, {d + 1} AS depth,
  CASE WHEN label = '' THEN '' ELSE label || ', ' END || property || '=' || value AS label, sort_key || signature AS sort_key,
  {", ".join(f"n_{p} AS f_{p}" for p in PROPERTIES)} FROM signed_{d}
  QUALIFY row_number() OVER (PARTITION BY signature ORDER BY parent) = 1),
listed_{d} AS (SELECT n.*, coalesce(b.names, '') AS names, coalesce(b.texts, '') AS texts FROM node_{d} n LEFT JOIN
  (SELECT signature, string_agg(property || '=' || value, '; ' ORDER BY rank) AS names,
     string_agg(property || '=' || value || ' (lift ' || format('{{:.4f}}', lift) || ', ' || s || ' users)', '; ' ORDER BY rank) AS texts
   FROM blockers_{d} GROUP BY signature) b USING (signature))""")
    levels = " UNION ALL ".join(f"SELECT * FROM listed_{d}" for d in range(max_depth + 1))
    parts.append(f"tree AS ({levels})")
    return ", ".join(parts)


# -------------------------------------------------------------- similarity


def similarity(pairs: str, name: str) -> str:
    """CTEs ending in ``name``: ``(a, b, score)``, the share of characters in matching blocks.

    The longest common block (earliest in a, then in b) splits a pair into the texts before and
    after it, which are matched in turn.
    """
    return f"""{name}_work(a, b, x, y, size) AS (
  SELECT a, b, lower(a) AS x, lower(b) AS y, 0 FROM {pairs}
  UNION ALL
  SELECT a, b, t.x, t.y, t.size FROM (
    SELECT w.a, w.b, w.x AS wx, w.y AS wy, m.i, m.j, m.k FROM {name}_work w, LATERAL (
      SELECT i, j, k FROM (SELECT unnest(generate_series(1, length(w.x))) AS i),
        (SELECT unnest(generate_series(1, length(w.y))) AS j), (SELECT unnest(generate_series(1, length(w.x))) AS k)
      WHERE i + k - 1 <= length(w.x) AND j + k - 1 <= length(w.y) AND substr(w.x, i, k) = substr(w.y, j, k)
      ORDER BY k DESC, i, j LIMIT 1) m
    WHERE length(w.x) > 0 AND length(w.y) > 0) c,
  LATERAL (SELECT substr(c.wx, 1, c.i - 1) AS x, substr(c.wy, 1, c.j - 1) AS y, CAST(c.k AS INTEGER) AS size
    UNION ALL SELECT substr(c.wx, c.i + c.k), substr(c.wy, c.j + c.k), 0) t),
{name} AS (SELECT a, b, 2.0::DOUBLE * sum(size) / (length(a) + length(b)) AS score FROM {name}_work GROUP BY a, b)"""


def report_lines(section: str, item: str, values: Sequence[str], source: str) -> str:
    numbers = [f"CAST({v} AS DOUBLE)" for v in values] + ["CAST(NULL AS DOUBLE)"] * (3 - len(values))
    columns = ", ".join(f"{v} AS value_{i}" for i, v in enumerate(numbers, 1))
    return f"SELECT '{section}' AS section, {item} AS item, {columns} FROM {source}"


NOISY_LOG = """noisy AS (SELECT user_id, ts, CASE event_id % 7 WHEN 0 THEN event_type
  WHEN 1 THEN left(event_type, length(event_type) - 1) WHEN 2 THEN upper(event_type)
  WHEN 3 THEN event_type || right(event_type, 1) WHEN 4 THEN substr(event_type, 2)
  WHEN 5 THEN 'web_' || event_type ELSE reverse(event_type) END AS event FROM events)"""
NAME_MATCHES = f"""{NOISY_LOG}, known AS (SELECT DISTINCT event_type AS event FROM events),
unknown AS (SELECT DISTINCT event FROM noisy WHERE event NOT IN (SELECT event FROM known)),
pairs AS (SELECT u.event AS a, k.event AS b FROM unknown u, known k),
{similarity('pairs', 'scores')},
found AS (SELECT a AS from_name, CASE WHEN score >= 0.9::DOUBLE THEN b END AS to_name, {r('score', 3)} AS score FROM scores
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY scores.score DESC, b) = 1)"""


def noisy_pairs() -> str:
    rows = " UNION ALL ".join(f"SELECT user_id, '{p}' AS p, {p} AS v FROM users" for p in PROPERTIES)
    return f"""raw AS ({rows}),
feed AS (SELECT DISTINCT CASE user_id % 3 WHEN 0 THEN p WHEN 1 THEN left(p, 4) || substr(p, 6)
    ELSE upper(left(p, 1)) || substr(p, 2) END AS property,
  CASE user_id % 4 WHEN 0 THEN v WHEN 1 THEN lower(v) WHEN 2 THEN left(v, length(v) - 1) ELSE v || ' customers' END AS value
  FROM raw)"""


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}

    def add(name: str, ctes: str, body: str) -> None:
        sql[name] = f"WITH RECURSIVE {ctes} {body}"

    # Sources and metrics.
    add("event_log", LOG_O, "SELECT * FROM log")
    add("click_event_log", LOG_C, "SELECT * FROM log")
    add("user_profiles", USERS, "SELECT * FROM users")
    catalog = "SELECT event, count(*) AS occurrences, count(DISTINCT user_id) AS users FROM log GROUP BY event"
    add("event_catalog_clicks", LOG_C, catalog)
    add("event_catalog_orders", LOG_O, catalog)
    values = " UNION ".join(f"SELECT '{p}' AS property, {p} AS value FROM users WHERE {p} IS NOT NULL" for p in PROPERTIES)
    add("property_value_dictionary", USERS, values)
    add("lookback_by_day", LOG_C, f"SELECT * FROM log WHERE {since(10)}")
    add("funnel_by_day", f"{CLICKS}, {reach(CLICK_STEPS, 10, 3)}", "SELECT * FROM reach")
    hits = f"hits AS (SELECT * FROM log WHERE event IN ('purchase', 'click') AND {since(DAYS_C)})"
    add(
        "insight_summary_weekly",
        f"{LOG_C}, {hits}, weeks AS (SELECT date_trunc('week', ts)::DATE AS week, count(DISTINCT user_id) AS n FROM hits GROUP BY week)",
        """SELECT (SELECT count(DISTINCT user_id) FROM hits) AS total, count(*) AS groups, max(week)::VARCHAR AS item,
  arg_max(n, week) AS item_value FROM weeks""",
    )
    add("anchored_lookback", LOG_C, f"SELECT * FROM log WHERE {since(10)}")
    add("lookback_ordered", LOG_C, f"SELECT * FROM log WHERE {since(10)}")
    add(
        "insight_unique_users", LOG_O,
        f"SELECT 'all users' AS \"group\", count(DISTINCT user_id) AS value FROM log WHERE event IN ('1-URGENT', '2-HIGH') AND {since(365)}",
    )
    add(
        "insight_event_count", LOG_C,
        f"SELECT 'all users' AS \"group\", count(*) AS value FROM log WHERE event IN ('click', 'purchase') AND {since(14)}",
    )
    week = "CAST(date_trunc('week', ts) AS DATE) AS week"
    add(
        "insight_by_week", LOG_C,
        f"SELECT {week}, count(DISTINCT user_id) AS value FROM log WHERE event IN ('purchase', 'click') AND {since(DAYS_C)} GROUP BY 1",
    )
    add(
        "insight_count_by_week", LOG_O,
        f"SELECT {week}, count(*) AS value FROM log WHERE event = '5-LOW' AND {since(DAYS_O)} GROUP BY 1",
    )
    add(
        "insight_by_property", ORDERS,
        "SELECT * FROM (SELECT u.nation AS \"group\", count(DISTINCT l.user_id) AS value FROM log l JOIN users u USING (user_id)"
        f" WHERE event IN ('1-URGENT', '2-HIGH') AND {since(730)} GROUP BY 1 ORDER BY 2 DESC, 1 NULLS LAST LIMIT 12)"
        ' WHERE "group" IS NOT NULL',
    )
    add(
        "insight_count_by_property", CLICKS,
        "SELECT u.balance_band AS \"group\", count(*) AS value FROM log l JOIN users u USING (user_id)"
        f" WHERE event = 'view' AND {since(DAYS_C)} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12",
    )
    add(
        "insight_filtered", ORDERS,
        "SELECT 'all users' AS \"group\", count(*) AS value FROM log JOIN users u USING (user_id)"
        f" WHERE event IN ('1-URGENT', '5-LOW') AND {since(DAYS_O)} AND u.region = 'ASIA' AND u.balance_band = 'mid'",
    )
    add(
        "user_states_total", LOG_C,
        f"SELECT 'all users' AS \"group\", count(DISTINCT user_id) AS value FROM log WHERE event IN ('click', 'purchase') AND {since(14)}",
    )
    add(
        "user_states_by_week", LOG_C,
        f"SELECT {week}, count(DISTINCT user_id) AS value FROM log WHERE event IN ('purchase', 'click') AND {since(DAYS_C)} GROUP BY 1",
    )
    add(
        "user_states_by_property", CLICKS,
        "SELECT * FROM (SELECT u.nation AS \"group\", count(DISTINCT l.user_id) AS value FROM log l JOIN users u USING (user_id)"
        f" WHERE event = 'view' AND {since(DAYS_C)} AND u.balance_band = 'high' GROUP BY 1 ORDER BY 2 DESC, 1 NULLS LAST LIMIT 12)"
        ' WHERE "group" IS NOT NULL',
    )
    add(
        "insight_filtered_by_week", CLICKS,
        f"SELECT {week}, count(DISTINCT user_id) AS value FROM log JOIN users u USING (user_id)"
        f" WHERE event IN ('view', 'click') AND {since(DAYS_C)} AND u.balance_band = 'high' GROUP BY 1",
    )

    # Funnels.
    add("funnel_reach_orders", f"{ORDERS}, {ORDER_REACH}", "SELECT * FROM reach")
    add("funnel_reach_clicks", f"{CLICKS}, {reach(CLICK_STEPS, 30, 1)}", "SELECT * FROM reach")
    add("funnel_reach_repeated_step", f"{CLICKS}, {reach(['view', 'view', 'purchase'], 14, 2)}", "SELECT * FROM reach")
    add("funnel_steps", f"{ORDERS}, {ORDER_REACH}, {steps_table(ORDER_STEPS, 'reach')}", "SELECT * FROM table_rows")
    cohort = "cohort AS (SELECT * FROM users WHERE segment = 'BUILDING' AND balance_band = 'mid')"
    add(
        "funnel_steps_filtered",
        f"{ORDERS}, {cohort}, {reach(ORDER_STEPS, ORDER_DAYS, ORDER_WINDOW, 'cohort')}, {steps_table(ORDER_STEPS, 'reach')}",
        "SELECT * FROM table_rows",
    )
    top = """top AS (SELECT nation AS value FROM reach JOIN users USING (user_id) WHERE nation IS NOT NULL
  GROUP BY nation ORDER BY count(*) DESC, nation LIMIT 8),
sliced AS (SELECT nation AS value, reached FROM reach JOIN users USING (user_id) WHERE nation IN (SELECT value FROM top))"""
    add(
        "funnel_by_property_nation",
        f"{ORDERS}, {ORDER_REACH}, {top}, {steps_table(ORDER_STEPS, 'sliced', ['value'])}",
        "SELECT * FROM table_rows",
    )
    add(
        "funnel_worst_step",
        f"{ORDERS}, {ORDER_REACH}, {steps_table(ORDER_STEPS, 'reach')},"
        " losses AS (SELECT step, event, users, lead(event) OVER (ORDER BY step) AS next,"
        " users - lead(users) OVER (ORDER BY step) AS lost FROM table_rows)",
        f"""SELECT (SELECT users FROM table_rows WHERE step = 1) AS started_users,
  (SELECT users FROM table_rows WHERE step = 3) AS converted_users,
  (SELECT conversion_from_start FROM table_rows WHERE step = 3) AS conversion, step AS worst_step, event AS worst_from,
  next AS worst_to, lost AS lost_users, {pct('lost', 'users')} AS lost_pct
  FROM losses WHERE lost IS NOT NULL ORDER BY lost DESC, step LIMIT 1""",
    )
    add("segment_stalled", f"{ORDERS}, {ORDER_REACH}, {ORDER_SEGMENTS}", "SELECT * FROM stalled")
    add("segment_converted", f"{ORDERS}, {ORDER_REACH}, {ORDER_SEGMENTS}", "SELECT * FROM converted")

    # Segments.
    def done(event: str, days: int) -> str:
        return f"(SELECT count(*) FROM log l WHERE l.user_id = u.user_id AND event = '{event}' AND {since(days)})"

    add("segment_by_profile", USERS, "SELECT user_id FROM users WHERE segment = 'BUILDING' AND region = 'EUROPE'")
    add("segment_at_least", CLICKS, f"SELECT user_id FROM users u WHERE {done('purchase', DAYS_C)} >= 15")
    add("segment_at_most", ORDERS, f"SELECT user_id FROM users u WHERE {done('1-URGENT', DAYS_O)} <= 1")
    add(
        "segment_chained", ORDERS,
        f"SELECT user_id FROM users u WHERE balance_band = 'mid' AND {done('1-URGENT', DAYS_O)} >= 2"
        f" AND {done('5-LOW', 1000)} <= 1 AND {done('2-HIGH', 2000)} >= 1",
    )
    add(
        "segment_store_sizes", f"{ORDERS}, {ORDER_REACH}",
        f"""SELECT 'orders_stalled' AS segment_name, count(*) AS users FROM reach WHERE reached = 2
  UNION ALL SELECT 'orders_converted', count(*) FROM reach WHERE reached >= 3
  UNION ALL SELECT '007', count(*) FROM users u WHERE {done('1-URGENT', DAYS_O)} >= 3""",
    )
    add(
        "segment_store_names", USERS,
        """SELECT CASE region WHEN 'EUROPE' THEN 'z\u00fcrich' WHEN 'ASIA' THEN '\u65e5\u672c' ELSE 'a/b = 50%' END AS segment_name, user_id
  FROM users WHERE region IN ('EUROPE', 'ASIA', 'AFRICA')""",
    )
    segments = f"{ORDERS}, {ORDER_REACH}, {ORDER_SEGMENTS}"
    add("segment_event_discovery", f"{segments}, {discovery('stalled', DAYS_O, 15, 'd')}", "SELECT * FROM d")
    add(
        "discovery_summary_row", f"{segments}, {discovery('converted', DAYS_O, 15, 'd')}",
        """SELECT CASE WHEN lift >= 1 THEN 'over' ELSE 'under' END AS direction, event, segment_pct, population_pct, lift FROM d
  WHERE lift = CASE WHEN (SELECT max(lift) FROM d) >= 1 THEN (SELECT max(lift) FROM d) ELSE (SELECT min(lift) FROM d) END
  ORDER BY event LIMIT 1""",
    )
    add("profile_segment_converted", f"{segments}, {profile('converted', 0.3, 'p')}", "SELECT * FROM p")
    add(
        "compare_discoveries_funnel",
        f"{segments}, {discovery('stalled', 500, 4, 'a')}, {discovery('converted', 500, 4, 'b')}, {compared('a', 'b', ['event'], 'c')}",
        "SELECT * FROM c",
    )
    add(
        "compare_highlights_funnel",
        f"{segments}, {profile('stalled', 0.1, 'a')}, {profile('converted', 0.1, 'b')},"
        f" {compared('a', 'b', ['property', 'value'], 'c')}",
        """SELECT CAST(row_number() OVER (ORDER BY abs(delta) DESC, property, value) AS INTEGER) AS rank, property || '=' || value AS item,
  'stalled' AS segment_a, a_pct, 'converted' AS segment_b, b_pct, delta FROM c QUALIFY rank <= 5""",
    )
    add(
        "profile_summary_converted", f"{segments}, {profile('converted', 0.3, 'p')}",
        """SELECT (SELECT count(*) FROM converted) AS segment_size, p.* FROM (SELECT 1) LEFT JOIN
  (SELECT * FROM p ORDER BY abs(relative_change) DESC, property, value LIMIT 1) p ON true""",
    )
    add(
        "compare_profiles_funnel",
        f"{segments}, {profile('stalled', 0.1, 'a')}, {profile('converted', 0.1, 'b')},"
        f" {compared('a', 'b', ['property', 'value'], 'c')}",
        "SELECT * FROM c",
    )

    # Sequences, paths, journeys.
    numbered = """SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event) AS pos, ts, event, copies
  FROM (SELECT user_id, ts, event, count(*) AS copies FROM {source} GROUP BY user_id, ts, event)"""
    add("user_sequences_orders", f"{LOG_O}, {recent(1000)}", numbered.format(source="recent"))
    add(
        "user_sequences_scoped",
        f"{CLICKS}, {recent(10)}, scoped AS (SELECT * FROM recent WHERE event IN ('signup', 'purchase') AND user_id IN"
        f" (SELECT user_id FROM log WHERE event = 'purchase' AND {since(DAYS_C)} GROUP BY user_id HAVING count(*) >= 15))",
        numbered.format(source="scoped"),
    )
    add(
        "compressed_sequences_orders", f"{LOG_O}, {recent(DAYS_O)}, {compressed()}",
        "SELECT user_id, rn AS pos, ts, event FROM seq",
    )
    clicks = f"{LOG_C}, {recent(DAYS_C)}"
    orders = f"{LOG_O}, {recent(DAYS_O)}"
    add("path_windows_clicks", f"{clicks}, {journeys_sql(CLICK_ENDS)}", "SELECT user_id, path FROM windows")
    top_paths = """SELECT path, count(*) AS users, (SELECT count(*) FROM windows) AS completed_users FROM windows
  GROUP BY path ORDER BY users DESC, path LIMIT {n}"""
    add("product_paths_clicks", f"{clicks}, {journeys_sql(CLICK_ENDS)}", top_paths.format(n=10))
    add("product_paths_nowhere", LOG_C, "SELECT NULL::VARCHAR AS path, NULL::BIGINT AS users, 0 AS completed_users")
    add(
        "product_paths_summary_clicks", f"{clicks}, {journeys_sql(CLICK_ENDS)}",
        """SELECT (SELECT count(*) FROM windows) AS completed_users, path AS top_path, count(*) AS top_users FROM windows
  GROUP BY path ORDER BY top_users DESC, path LIMIT 1""",
    )
    allowed = quoted(sorted({"2-HIGH", "3-MEDIUM", *ORDER_ENDS}))
    add(
        "product_paths_orders",
        f"{orders}, allowed AS (SELECT * FROM recent WHERE event IN ({allowed})), {journeys_sql(ORDER_ENDS, 'allowed')}",
        top_paths.format(n=8),
    )
    add(
        "journey_sequences_orders", f"{orders}, {journeys_sql(ORDER_ENDS)}",
        "SELECT user_id, completed, pos, event FROM journey",
    )
    add(
        "journey_canonical_paths", f"{orders}, {journeys_sql(ORDER_ENDS)}",
        "SELECT path, count(*) AS users FROM windows GROUP BY path ORDER BY users DESC, path LIMIT 5",
    )
    add("journey_nodes", f"{orders}, {journey_map_sql(ORDER_ENDS)}", "SELECT * FROM nodes")
    add(
        "journey_nodes_segment",
        f"{ORDERS}, {recent(DAYS_O)}, urgent AS (SELECT * FROM recent WHERE user_id IN (SELECT user_id FROM users u"
        f" WHERE {done('1-URGENT', DAYS_O)} >= 3)), {journey_map_sql(ORDER_ENDS, 'urgent')}",
        "SELECT * FROM nodes",
    )
    add(
        "journey_summary_row",
        f"""{orders}, {journey_map_sql(ORDER_ENDS)},
totals AS (SELECT step, sum(users) AS users, string_agg(event, '/' ORDER BY event) AS events FROM nodes GROUP BY step),
worst AS (SELECT step, events, users - lead(users) OVER (ORDER BY step) AS lost FROM totals
  QUALIFY lost IS NOT NULL ORDER BY lost DESC, step LIMIT 1)""",
        f"""SELECT count(*) AS started_users, count(*) FILTER (WHERE completed) AS completed_users,
  {pct('count(*) FILTER (WHERE completed)', 'count(*)')} AS completion, (SELECT step + 1 FROM worst) AS worst_step,
  (SELECT events FROM worst) AS worst_events, (SELECT CAST(lost AS BIGINT) FROM worst) AS lost_users FROM bounds""",
    )

    # Breakdown and drill-down.
    add("breakdown_entries_orders", f"{ORDERS}, {ORDER_REACH}, {entries('reach', 3, PROPERTIES, 8, 'e')}", "SELECT * FROM e")
    add("breakdown_top", f"{ORDERS}, {ORDER_REACH}, {entries('reach', 3, PROPERTIES, 8, 'e')}", ranked_sides("e"))
    summary = f"""SELECT (SELECT count(*) FROM reach) AS base_users,
  {pct('(SELECT count(*) FROM reach WHERE reached >= 3)', '(SELECT count(*) FROM reach)')} AS base_conversion, t.kind, t.property, t.value, t.lift, t.affected_users
  FROM (SELECT 1) LEFT JOIN (SELECT * FROM sides WHERE rank = 1 ORDER BY kind LIMIT 1) t ON true"""
    add(
        "breakdown_summary_top", f"{ORDERS}, {ORDER_REACH}, {entries('reach', 3, PROPERTIES, 8, 'e')}, sides AS ({ranked_sides('e')})",
        summary,
    )
    add(
        "breakdown_summary_small",
        f"{ORDERS}, cohort AS (SELECT * FROM users WHERE balance_band = 'negative' AND nation = 'FRANCE'),"
        f" {reach(ORDER_STEPS, ORDER_DAYS, ORDER_WINDOW, 'cohort')}, {entries('reach', 3, PROPERTIES[:1] + PROPERTIES[2:3], 8, 'e')},"
        f" sides AS ({ranked_sides('e')})",
        summary,
    )
    add(
        "breakdown_filtered",
        f"{ORDERS}, cohort AS (SELECT * FROM users WHERE balance_band = 'mid'),"
        f" {reach(ORDER_STEPS, ORDER_DAYS, ORDER_WINDOW, 'cohort')}, {entries('reach', 3, PROPERTIES[:3], 4, 'e')}",
        "SELECT * FROM e",
    )
    wanted = [
        ("{}", "true"),
        ('{"segment":"HOUSEHOLD"}', "segment = 'HOUSEHOLD'"),
        ('{"region":"MIDDLE EAST"}', "region = 'MIDDLE EAST'"),
        ('{"region":"ASIA","segment":"AUTOMOBILE"}', "segment = 'AUTOMOBILE' AND region = 'ASIA'"),
        ('{"nation":"NOWHERE","segment":"AUTOMOBILE"}', "segment = 'AUTOMOBILE' AND nation = 'NOWHERE'"),
    ]
    # A row without reach keeps cohorts without users in the table.
    cohorts = " UNION ALL ".join(
        f"SELECT '{s}' AS signature, reached FROM reach JOIN users USING (user_id) WHERE {w} UNION ALL SELECT '{s}', 0"
        for s, w in wanted
    )
    add(
        "cohort_funnels_orders",
        f"{ORDERS}, {ORDER_REACH}, cohorts AS ({cohorts}), {steps_table(ORDER_STEPS, 'cohorts', ['signature'])}",
        "SELECT * FROM table_rows",
    )
    add(
        "drilldown_tree_orders", drilldown(3),
        f"""SELECT signature, parent, depth, n1 AS started_users, n3 AS converted_users, {pct('n3', 'n1')} AS conversion,
  worst AS worst_step, lost AS lost_users, names AS blockers FROM tree""",
    )
    labels = "[" + quoted(ORDER_STEPS) + "]"
    add(
        "drilldown_report_orders", drilldown(3),
        f"""SELECT CAST(row_number() OVER (ORDER BY sort_key) AS INTEGER) AS line, depth,
  CASE WHEN label = '' THEN 'all users' ELSE label END AS cohort, n1 AS users,
  {r('CAST(n3 AS DOUBLE) / n1 * 100', 1)} AS conversion_pct, {labels}[worst] AS worst_from, {labels}[worst + 1] AS worst_to,
  lost AS lost_users, texts AS blockers FROM tree""",
    )

    # Name conformance.
    add("name_conformance_clicks", NAME_MATCHES, "SELECT * FROM found")
    add(
        "conformed_event_log_clicks",
        f"{NAME_MATCHES}, fixed AS (SELECT coalesce(to_name, event) AS event, user_id FROM noisy LEFT JOIN found ON from_name = event)",
        "SELECT event, count(*) AS occurrences, count(DISTINCT user_id) AS users FROM fixed GROUP BY event",
    )
    known_props = " UNION ALL ".join(f"SELECT '{p}' AS b" for p in PROPERTIES)
    add(
        "property_conformance_profiles",
        f"""{USERS}, {noisy_pairs()}, dictionary AS (SELECT DISTINCT p, v FROM raw), props AS ({known_props}),
prop_pairs AS (SELECT DISTINCT property AS a, b FROM feed, props WHERE property NOT IN (SELECT b FROM props)),
{similarity('prop_pairs', 'prop_scores')},
prop_best AS (SELECT a, b, score FROM prop_scores QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) = 1),
typed AS (SELECT f.property, f.value, {r('score', 3)} AS property_score,
  CASE WHEN score IS NULL THEN f.property WHEN score >= 0.9::DOUBLE THEN b END AS to_property
  FROM feed f LEFT JOIN prop_best ON a = f.property),
value_pairs AS (SELECT DISTINCT t.value AS a, d.v AS b, d.p FROM typed t JOIN dictionary d ON d.p = t.to_property
  WHERE (t.to_property, t.value) NOT IN (SELECT (p, v) FROM dictionary)),
{similarity('(SELECT DISTINCT a, b FROM value_pairs)', 'value_scores')},
value_best AS (SELECT p, a, b, score FROM value_pairs JOIN value_scores USING (a, b)
  QUALIFY row_number() OVER (PARTITION BY p, a ORDER BY score DESC, b) = 1)""",
        f"""SELECT property, value, to_property,
  CASE WHEN v.score IS NULL THEN value WHEN v.score >= 0.9::DOUBLE THEN v.b END AS to_value, property_score,
  CASE WHEN v.score IS NOT NULL THEN {r('v.score', 3)} END AS value_score
  FROM typed LEFT JOIN value_best v ON v.p = to_property AND v.a = value
  WHERE property_score IS NOT NULL OR v.score IS NOT NULL""",
    )

    # Reports.
    def funnel_lines() -> str:
        return report_lines(
            "funnel", "step || ' ' || event", ["users", "conversion_from_start", "lost_from_previous"], "table_rows"
        )

    add(
        "conversion_blockers_report",
        f"{segments}, {steps_table(ORDER_STEPS, 'reach')}, {discovery('stalled', DAYS_O, 12, 'da')},"
        f" {discovery('converted', DAYS_O, 12, 'db')}, {profile('stalled', 0.3, 'pa')}, {profile('converted', 0.3, 'pb')},"
        f" {compared('da', 'db', ['event'], 'dc')}, {compared('pa', 'pb', ['property', 'value'], 'pc')}",
        f"""{funnel_lines()}
  UNION ALL {report_lines('event', 'event', ['a_pct', 'b_pct', 'delta'], 'dc')}
  UNION ALL {report_lines('profile', "property || '=' || value", ['a_pct', 'b_pct', 'delta'], 'pc')}""",
    )
    goal_paths = f"""allowed AS (SELECT * FROM recent WHERE event IN (SELECT event FROM d) OR event IN ('1-URGENT', '5-LOW')),
paths AS (WITH {journeys_sql(ORDER_ENDS, 'allowed')} {top_paths.format(n=8)}),
map_nodes AS (WITH RECURSIVE {journey_map_sql(('2-HIGH', '5-LOW'))} SELECT * FROM nodes)"""
    add(
        "upgrade_paths_report",
        f"""{ORDERS}, {recent(DAYS_O)}, doers AS (SELECT user_id FROM users u WHERE {done('5-LOW', 500)} >= 1),
{discovery('doers', DAYS_O, 12, 'd')}, {goal_paths}""",
        f"""{report_lines('event', 'event', ['segment_pct', 'population_pct', 'lift'], 'd')}
  UNION ALL {report_lines('path', 'path', ['users', 'completed_users'], 'paths')}
  UNION ALL {report_lines('journey', "(step + 1) || ' ' || event", ['users', 'pct_of_start'], 'map_nodes')}""",
    )

    def weekly(section: str, events: Sequence[str]) -> str:
        return f"""SELECT '{section}' AS section, CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS item,
  CAST(count(DISTINCT user_id) AS DOUBLE) AS value_1, CAST(NULL AS DOUBLE) AS value_2, CAST(NULL AS DOUBLE) AS value_3
  FROM log WHERE event IN ({quoted(events)}) AND {since(56)} GROUP BY 2"""

    add(
        "weekly_health_report",
        f"""{CLICKS}, {reach(CLICK_STEPS, 28, 1)}, {steps_table(CLICK_STEPS, 'reach')},
{reach(CLICK_STEPS[:2], 28, 1, name='two')}, {entries('two', 2, PROPERTIES, 8, 'e')}, sides AS ({ranked_sides('e')})""",
        f"""{weekly('signups', ['signup'])} UNION ALL {weekly('engagement', ['click', 'view', 'purchase'])}
  UNION ALL {funnel_lines()}
  UNION ALL {report_lines('booster', "property || '=' || value", ['affected_users', 'lift', 'impact'], "sides WHERE kind = 'booster'")}
  UNION ALL {report_lines('blocker', "property || '=' || value", ['affected_users', 'lift', 'impact'], "sides WHERE kind = 'blocker'")}""",
    )
    return sql
