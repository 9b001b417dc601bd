"""Queries of the general problems 2, 5 and 6, and SQL with the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.csv_rejects import COLUMNS, load_lines
from ..operators.regular_grid import regular_grid
from ..operators.spikes import flag_readings
from ..sources.tables import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return load_lines(table(spark, folder, "candidates_raw")).where("reason IS NOT NULL").select("line_id")


def p2_loaded(spark: SparkSession, folder: str) -> DataFrame:
    return load_lines(table(spark, folder, "candidates_raw")).where("reason IS NULL").select("line_id", *COLUMNS)


def p2_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Lines set apart, per file and reason."""
    return load_lines(table(spark, folder, "candidates_raw")).where("reason IS NOT NULL").groupBy("file_name", "reason").agg(F.count("*").alias("n_lines"), F.min("line_no").alias("first_line"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return flag_readings(table(spark, folder, "light_curves")).select("target_id", "mission", "quarter_no", "idx")


def p5_reasons(spark: SparkSession, folder: str) -> DataFrame:
    """Readings with each reason, per series."""
    flags = flag_readings(table(spark, folder, "light_curves"))
    names = [c for c, kind in flags.dtypes if kind == "boolean"]
    return flags.groupBy("target_id", "mission", "quarter_no").agg(F.count("*").alias("n_flagged"), *(F.count_if(c).alias(f"n_{c}") for c in names))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return regular_grid(table(spark, folder, "light_curves")).where("state <> 'observed'").select("target_id", "mission", "quarter_no", "cell")


def p6_grid(spark: SparkSession, folder: str) -> DataFrame:
    grid = regular_grid(table(spark, folder, "light_curves"))
    return grid.select("target_id", "mission", "quarter_no", "cell", "n_readings", "state", F.round("coverage", 6).alias("coverage"), F.round(F.log10("mean_flux"), 7).alias("log_mean_flux"))


_FIELD = r'(?:"[^"]*(?:""[^"]*)*"|[^",\r\n]*)'
_LINES = rf"""
WITH l AS (SELECT line_id, file_name, line_no, regexp_replace(raw_line, '\r$', '') AS r FROM candidates_raw WHERE raw_line IS NOT NULL),
records AS (SELECT *, regexp_full_match(r, '{_FIELD}(?:,{_FIELD})*') AS quoted,
  regexp_full_match(r, '{_FIELD}(?:,{_FIELD}){{{len(COLUMNS) - 1}}}') AS counted,
  regexp_extract(r, '^{",".join([f"({_FIELD})"] * len(COLUMNS))}$', [{", ".join(f"'{c}'" for c in COLUMNS)}]) AS x
  FROM l WHERE NOT regexp_full_match(r, '[ \t\r\n]*')),
fields AS (SELECT line_id, file_name, line_no, quoted, counted, {", ".join(f"trim(CASE WHEN starts_with(x.{c}, chr(34)) THEN replace(x.{c}[2:-2], chr(34) || chr(34), chr(34)) ELSE x.{c} END, ' ' || chr(9)) AS {c}" for c in COLUMNS)} FROM records),
judged AS (SELECT *, CASE WHEN NOT quoted THEN 'broken quoting' WHEN NOT counted THEN 'wrong column count'
  {" ".join(f"WHEN NOT regexp_full_match({c}, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') OR NOT coalesce(TRY_CAST({c} AS DOUBLE) > 0 AND isfinite(TRY_CAST({c} AS DOUBLE)), false) THEN 'invalid {c}'" for c in ("t_min", "depth_ppm"))}
  WHEN lower(vetting_status) NOT IN ('candidate', 'eclipsing_binary', 'flare', 'artifact', 'known_variable', 'unresolved') THEN 'invalid vetting_status' END AS reason FROM fields)"""  # noqa: S608
_LOADED = {"double": "TRY_CAST({0} AS DOUBLE) AS {0}", "boolean": "TRY_CAST({0} AS BOOLEAN) AS {0}", "string": "nullif({0}, '') AS {0}"}

_FLAGS = """
WITH d AS (SELECT target_id, mission, quarter_no, idx, any_value(time) AS t, any_value(flux) AS f, any_value(flux_err) AS e FROM light_curves WHERE idx IS NOT NULL GROUP BY ALL),
b AS (SELECT *, coalesce(t > 0 AND t < 40000, false) AS timed, coalesce(isfinite(f) AND f > 0, false) AS usable, coalesce(isfinite(f), false) AS fin,
  coalesce(isfinite(e) AND e > 0, false) AS eok FROM d),
s AS (SELECT target_id, mission, quarter_no, median(e) FILTER (eok) AS em FROM b GROUP BY ALL),
tm AS (SELECT target_id, mission, quarter_no, idx, t = lag(t) OVER (PARTITION BY target_id, mission, quarter_no ORDER BY idx) AS again FROM b WHERE timed),
r0 AS (SELECT *, f <> lag(f) OVER w AS brk FROM b WHERE fin WINDOW w AS (PARTITION BY target_id, mission, quarter_no ORDER BY idx)),
r1 AS (SELECT *, sum(coalesce(brk, true)::INT) OVER (PARTITION BY target_id, mission, quarter_no ORDER BY idx) AS island FROM r0),
r AS (SELECT target_id, mission, quarter_no, idx, count(*) OVER (PARTITION BY target_id, mission, quarter_no, island) >= 8 AS stuck FROM r1),
x AS (SELECT target_id, mission, quarter_no, idx, f, lag(f, 3) OVER w AS l3, lag(f, 2) OVER w AS l2, lag(f, 1) OVER w AS l1, lead(f, 1) OVER w AS n1, lead(f, 2) OVER w AS n2, lead(f, 3) OVER w AS n3, lead(f, 4) OVER w AS n4,
  count(*) OVER (PARTITION BY target_id, mission, quarter_no) AS n FROM b WHERE usable WINDOW w AS (PARTITION BY target_id, mission, quarter_no ORDER BY idx)),
sc AS (SELECT target_id, mission, quarter_no, 1.4826 * median(abs(2 * f - coalesce(l1, n1) - coalesce(n1, l1)) / 4) / (sqrt(6) / 4) AS noise FROM x WHERE n > 2 GROUP BY ALL),
m AS (SELECT x.*, noise, list_median(list_filter([l3, l2, l1], lambda v: v IS NOT NULL)) AS lm,
  list_median(list_filter([n1, n2, n3], lambda v: v IS NOT NULL)) AS rm1, list_median(list_filter([n2, n3, n4], lambda v: v IS NOT NULL)) AS rm2,
  list_median(list_filter([l3, l2, l1, n1, n2, n3], lambda v: v IS NOT NULL)) AS lev1, list_median(list_filter([l3, l2, l1, n2, n3, n4], lambda v: v IS NOT NULL)) AS lev2
  FROM x JOIN sc ON x.target_id IS NOT DISTINCT FROM sc.target_id AND x.mission IS NOT DISTINCT FROM sc.mission AND x.quarter_no IS NOT DISTINCT FROM sc.quarter_no),
k AS (SELECT target_id, mission, quarter_no, idx,
  coalesce(abs(f - lm) > 10 * noise, true) AND coalesce(abs(f - rm1) > 10 * noise, true) AND coalesce(abs(l1 - lev1) <= 5 * noise, true) AND coalesce(abs(n1 - lev1) <= 5 * noise, true) AS one,
  n1 IS NOT NULL AND coalesce(abs(f - lm) > 10 * noise AND abs(n1 - lm) > 10 * noise, true) AND coalesce(abs(f - rm2) > 10 * noise AND abs(n1 - rm2) > 10 * noise, true)
  AND coalesce(abs(l1 - lev2) <= 5 * noise, true) AND coalesce(abs(n2 - lev2) <= 5 * noise, true) AS two FROM m),
sp AS (SELECT target_id, mission, quarter_no, idx, one OR two OR coalesce(lag(two) OVER (PARTITION BY target_id, mission, quarter_no ORDER BY idx), false) AS spike FROM k),
out AS (
  SELECT target_id, mission, quarter_no, idx FROM b WHERE (NOT isnan(f) AND NOT usable) OR (NOT isnan(e) AND NOT eok) OR (NOT isnan(t) AND NOT timed)
  UNION SELECT b.target_id, b.mission, b.quarter_no, idx FROM b JOIN s ON b.target_id IS NOT DISTINCT FROM s.target_id AND b.mission IS NOT DISTINCT FROM s.mission AND b.quarter_no IS NOT DISTINCT FROM s.quarter_no WHERE eok AND e > 10 * em
  UNION SELECT target_id, mission, quarter_no, idx FROM tm WHERE again
  UNION SELECT target_id, mission, quarter_no, idx FROM r WHERE stuck
  UNION SELECT target_id, mission, quarter_no, idx FROM sp WHERE spike)
SELECT target_id, mission, quarter_no, idx FROM out"""

_WHY = {
    "impossible_flux": "FROM b WHERE NOT isnan(f) AND NOT usable", "impossible_error": "FROM b WHERE NOT isnan(e) AND NOT eok", "impossible_time": "FROM b WHERE NOT isnan(t) AND NOT timed",
    "large_error": "FROM (SELECT b.* FROM b JOIN s ON b.target_id IS NOT DISTINCT FROM s.target_id AND b.mission IS NOT DISTINCT FROM s.mission AND b.quarter_no IS NOT DISTINCT FROM s.quarter_no WHERE eok AND e > 10 * em)",
    "repeated_time": "FROM tm WHERE again", "stuck_flux": "FROM r WHERE stuck", "spike": "FROM sp WHERE spike",
}
_REASONS = f"""{_FLAGS[: _FLAGS.rindex("out AS (")]}why AS ({" UNION ALL ".join(f"SELECT target_id, mission, quarter_no, idx, '{k}' AS reason {v}" for k, v in _WHY.items())})
SELECT target_id, mission, quarter_no, count(DISTINCT idx) AS n_flagged, {", ".join(f"count(*) FILTER (reason = '{k}') AS n_{k}" for k in _WHY)} FROM why GROUP BY ALL"""

_USABLE = "time > 0 AND time < 40000 AND isfinite(flux) AND flux > 0"
_GRID = f"""
WITH u AS (SELECT DISTINCT target_id, mission, quarter_no, idx, time, flux, floor(time / 0.25)::BIGINT AS cell FROM light_curves WHERE {_USABLE}),
i AS (SELECT *, lead(time) OVER w AS nxt FROM u WINDOW w AS (PARTITION BY target_id, mission, quarter_no ORDER BY time, idx, flux)),
j AS (SELECT *, CASE WHEN nxt IS NULL THEN least(time + 0.25, (cell + 1) * 0.25) ELSE least(nxt, time + 0.25) END AS until FROM i),
p AS (SELECT target_id, mission, quarter_no, flux, time, until, unnest(range(cell, floor(until / 0.25)::BIGINT + 1)) AS cell FROM j),
q AS (SELECT target_id, mission, quarter_no, cell, greatest(least(until, (cell + 1) * 0.25) - greatest(time, cell * 0.25), 0) AS len, flux FROM p),
a AS (SELECT target_id, mission, quarter_no, cell, sum(len) AS len, sum(len * flux) AS area FROM q GROUP BY ALL),
c AS (SELECT target_id, mission, quarter_no, cell, count(*) AS n, avg(flux) AS plain FROM u GROUP BY ALL),
g AS (SELECT *, lead(cell) OVER (PARTITION BY target_id, mission, quarter_no ORDER BY cell) AS nx FROM c),
h AS (SELECT target_id, mission, quarter_no, n, plain, cell AS own, unnest(range(cell, coalesce(nx, cell + 1))) AS cell FROM g)
SELECT h.target_id, h.mission, h.quarter_no, h.cell, CASE WHEN own = h.cell THEN n ELSE 0 END AS n_readings,
  CASE WHEN own = h.cell THEN 'observed' WHEN coalesce(len, 0) > 0 THEN 'filled' ELSE 'missing' END AS state, round(coalesce(len, 0) / 0.25, 6) AS coverage,
  round(log10(CASE WHEN coalesce(len, 0) > 0 THEN area / len WHEN own = h.cell THEN plain END), 7) AS log_mean_flux
FROM h LEFT JOIN a ON h.target_id IS NOT DISTINCT FROM a.target_id AND h.mission IS NOT DISTINCT FROM a.mission AND h.quarter_no IS NOT DISTINCT FROM a.quarter_no AND h.cell = a.cell"""

QUERIES = {f.__name__: f for f in (p2_found, p2_loaded, p2_reasons, p5_found, p5_reasons, p6_found, p6_grid)}
SQL = {
    "p2_found": f"{_LINES} SELECT line_id FROM judged WHERE reason IS NOT NULL",
    "p2_loaded": f"{_LINES} SELECT line_id, {', '.join(_LOADED[kind].format(c) if c != 'vetting_status' else 'lower(vetting_status) AS vetting_status' for c, kind in COLUMNS.items())} FROM judged WHERE reason IS NULL",
    "p2_reasons": f"{_LINES} SELECT file_name, reason, count(*) AS n_lines, min(line_no) AS first_line FROM judged WHERE reason IS NOT NULL GROUP BY ALL",
    "p5_found": _FLAGS,
    "p5_reasons": _REASONS,
    "p6_found": f"""
WITH u AS (SELECT DISTINCT target_id, mission, quarter_no, floor(time / 0.25)::BIGINT AS cell FROM light_curves WHERE {_USABLE}),
n AS (SELECT *, lead(cell) OVER (PARTITION BY target_id, mission, quarter_no ORDER BY cell) AS nx FROM u)
SELECT target_id, mission, quarter_no, unnest(range(cell + 1, nx)) AS cell FROM n WHERE nx > cell + 1""",
    "p6_grid": _GRID,
}
