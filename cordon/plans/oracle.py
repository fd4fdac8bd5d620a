"""Equivalent SQL for each registered query, for an independent ANSI engine.

Tables ``lineitem``, ``orders`` and ``pages`` are views. The trip and weather
derivations repeat ``cordon.sources.adapter``; the operator SQL is written
to compute in another way than the Spark code (durations via ``date_diff``, ghost
rules as a ranked table, boolean zone flags, the blend as a weighted union of years, its
own link patterns, the p-value through ``lgamma``), so agreement is a real cross-check.
"""

from __future__ import annotations

from cordon import params

_Z = ", ".join(str(z) for z in params.CONGESTION_ZONE_IDS)
_B = ", ".join(str(z) for z in params.BORDER_ZONE_IDS)
_HOST = params.TRIP_FILE_HOST
_DIR = params.TRIP_FILE_DIR


def _sq(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


BASE = f"""
WITH RECURSIVE raw_trips AS NOT MATERIALIZED (
  SELECT
    l_shipdate + INTERVAL '9862' DAY
      + ((l_partkey * 7919 + l_orderkey * 31 + l_linenumber * 104729) % 86400) * INTERVAL '1' SECOND
      AS pickup_datetime,
    (l_orderkey * 31 + l_partkey * 17 + l_linenumber * 13) % 3600 - 60 AS dur_s,
    CASE WHEN l_quantity = 30 AND l_linenumber = 3 THEN NULL WHEN l_partkey % 3 = 0 THEN 1 + (l_partkey * 7 + l_linenumber) % 265
         ELSE 225 + (l_partkey * 7 + l_linenumber) % 41 END AS PULocationID,
    CASE WHEN l_quantity = 31 AND l_linenumber = 2 THEN NULL WHEN l_partkey % 3 = 0 THEN 1 + (l_orderkey * 11 + l_linenumber) % 265
         ELSE 225 + (l_orderkey * 11 + l_linenumber) % 41 END AS DOLocationID,
    CASE WHEN l_quantity <= 2 THEN CAST(0 AS DOUBLE) ELSE l_quantity / 4 END AS trip_distance,
    CASE WHEN l_quantity <> 32 THEN l_extendedprice / 1000 END AS fare_amount,
    CASE WHEN l_quantity <> 33 THEN l_extendedprice / 1000 * (1 + l_tax) END AS total_amount,
    CASE WHEN l_tax = 0.08 THEN CAST(-2.5 AS DOUBLE)
         WHEN l_returnflag = 'N' AND l_linenumber = 1 THEN NULL
         WHEN l_returnflag = 'N' THEN CAST(0 AS DOUBLE)
         ELSE CAST(2.5 AS DOUBLE) END AS congestion_surcharge,
    CASE WHEN l_discount = 0 THEN NULL ELSE l_extendedprice / 1000 * l_discount END AS tip_amount,
    CASE WHEN l_linestatus = 'O' THEN 'yellow' ELSE 'green' END AS taxi_type,
    CASE WHEN l_quantity <> 34 THEN l_suppkey % 7 + 1 END AS VendorID
  FROM lineitem
),
unified_trips AS NOT MATERIALIZED (
  SELECT pickup_datetime AS pickup_time,
         pickup_datetime + dur_s * INTERVAL '1' SECOND AS dropoff_time,
         CAST(PULocationID AS INTEGER) AS pickup_loc, CAST(DOLocationID AS INTEGER) AS dropoff_loc,
         CAST(trip_distance AS DOUBLE) AS trip_distance, CAST(fare_amount AS DOUBLE) AS fare,
         CAST(total_amount AS DOUBLE) AS total_amount,
         CAST(COALESCE(congestion_surcharge, 0) AS DOUBLE) AS congestion_surcharge,
         CAST(COALESCE(tip_amount, 0) AS DOUBLE) AS tip_amount,
         taxi_type, CAST(VendorID AS INTEGER) AS vendor_id
  FROM raw_trips
),
timed AS NOT MATERIALIZED (
  SELECT *, CAST(date_diff('microsecond', pickup_time, dropoff_time) AS DOUBLE) / 1e6 AS secs
  FROM unified_trips
),
speeds AS NOT MATERIALIZED (
  SELECT *, secs / 60 AS trip_duration_min,
         CASE WHEN secs > 0 THEN trip_distance / (secs / 3600) ELSE CAST(0 AS DOUBLE) END AS avg_speed_mph
  FROM timed
),
rules AS (SELECT * FROM (VALUES (1, '{params.GHOST_IMPOSSIBLE}'), (2, '{params.GHOST_TELEPORTER}'), (3, '{params.GHOST_STATIONARY}')) AS r(rank, ghost_type)),
judged AS NOT MATERIALIZED (
  SELECT *, list_min([IF(avg_speed_mph > {params.MAX_SPEED_MPH}, 1, NULL),
                      IF(trip_duration_min < {params.MIN_TRIP_MINUTES} AND fare > {params.TELEPORTER_FARE}, 2, NULL),
                      IF(trip_distance = 0 AND fare > 0, 3, NULL)]) AS rank
  FROM speeds
),
flagged AS NOT MATERIALIZED (
  SELECT pickup_time, dropoff_time, pickup_loc, dropoff_loc, trip_distance, fare, total_amount,
         congestion_surcharge, tip_amount, taxi_type, vendor_id, trip_duration_min, avg_speed_mph, ghost_type
  FROM judged LEFT JOIN rules USING (rank)
),
clean AS NOT MATERIALIZED (SELECT * FROM flagged WHERE ghost_type IS NULL),
ghosts AS NOT MATERIALIZED (SELECT * FROM flagged WHERE ghost_type IS NOT NULL),
clean_timed AS NOT MATERIALIZED (
  SELECT *, CAST(date_diff('microsecond', pickup_time, dropoff_time) AS DOUBLE) / 1e6 AS secs,
         pickup_loc IN ({_Z}) AS pu_in, dropoff_loc IN ({_Z}) AS do_in
  FROM clean
),
weather AS NOT MATERIALIZED (
  SELECT CAST(o_orderdate + INTERVAL '9862' DAY AS DATE) AS date,
         AVG(o_totalprice) / 10000 AS precipitation_mm,
         MIN(o_totalprice) / 10000 AS rain_mm
  FROM orders WHERE YEAR(o_orderdate + INTERVAL '9862' DAY) = 2025 GROUP BY 1
),
daily AS NOT MATERIALIZED (
  SELECT CAST(DATE_TRUNC('day', pickup_time) AS DATE) AS date, COUNT(*) AS trip_count,
         SUM(total_amount) AS total_revenue, AVG(congestion_surcharge) AS avg_surcharge
  FROM clean WHERE YEAR(pickup_time) = 2025 GROUP BY 1
),
listing AS NOT MATERIALIZED (
  SELECT page_id, html,
         CASE WHEN page_id % 2 = 0 THEN '<a href="' || printf('yellow_tripdata_%d-%02d.parquet', y, m) || '">file</a>'
              ELSE '<a data-href=''x'' title=''a > b'' href=''/trip-data/' || printf('green_tripdata_%d-%02d.parquet', y, m) || '''>file</a>' END AS anchor,
         list_extract(['<!-- <a href="yellow_tripdata_2030-01.parquet"> -->', '<script>s = "<a href=green_tripdata_2031-01.parquet>"</script>',
                       '<img alt=''<a href="yellow_tripdata_2032-01.parquet">''>', '', ''], CAST(page_id % 5 + 1 AS INT)) AS decoy
  FROM (SELECT page_id, html, y, CASE WHEN y = 2025 AND m0 = 12 AND page_id % 2 = 1 THEN 11 ELSE m0 END AS m
        FROM (SELECT page_id, html, 2023 + (page_id // 24) % 3 AS y, (page_id // 2) % 12 + 1 AS m0 FROM pages))
),
page_sources AS NOT MATERIALIZED (
  SELECT 'page' AS origin, page_id, html FROM pages
  UNION ALL SELECT 'listing', page_id, coalesce(html, '') || decoy || anchor || CASE WHEN page_id % 5 = 4 THEN '<a title="open href=yellow_tripdata_2033-01.parquet>' ELSE '' END FROM listing
),
-- A page read step by step: in the text a step goes to the next markup, in a tag it takes one attribute.
steps AS (
  SELECT origin, page_id, coalesce(html, '') AS rest, '' AS tag, NULL::VARCHAR AS href, NULL::VARCHAR AS found FROM page_sources
  UNION ALL
  SELECT origin, page_id,
    CASE WHEN tag = '' THEN CASE WHEN place = 0 THEN '' WHEN starts_with(m, '<!--') THEN CASE WHEN strpos(m[5:], '-->') = 0 THEN '' ELSE m[strpos(m[5:], '-->') + 7:] END
                                 WHEN name = '' THEN m[2:] ELSE m[2 + len(name):] END
         WHEN u = '' THEN '' WHEN ends THEN CASE WHEN tag NOT IN ('script', 'style', 'title', 'textarea') THEN u[2:]
                                                 WHEN strpos(lower(u), '</' || tag) = 0 THEN '' ELSE u[strpos(lower(u), '</' || tag) + 2:] END
         WHEN quoted THEN CASE WHEN strpos(w[2:], w[1]) = 0 THEN '' ELSE w[strpos(w[2:], w[1]) + 2:] END
         WHEN valued THEN w[1 + len(bare):] ELSE u[1 + len(attr):] END,
    CASE WHEN tag = '' THEN lower(name) WHEN ends THEN '' ELSE tag END,
    CASE WHEN tag = '' OR ends THEN NULL WHEN href IS NULL AND lower(attr) = 'href' AND valued THEN CASE WHEN quoted THEN split_part(w[2:], w[1], 1) ELSE bare END ELSE href END,
    CASE WHEN tag = 'a' AND ends THEN href END
  FROM (
    SELECT *, ltrim(v[2:], x) AS w, starts_with(v, '=') AS valued, starts_with(v, '=') AND ltrim(v[2:], x)[1] IN ('"', chr(39)) AS quoted, regexp_extract(ltrim(v[2:], x), '^[^ \\t\\r\\n\\f\\v>]*') AS bare
    FROM (SELECT *, starts_with(u, '>') AS ends, regexp_extract(u, '^[^/>][^ \\t\\r\\n\\f\\v/>=]*') AS attr, ltrim(u[1 + len(regexp_extract(u, '^[^/>][^ \\t\\r\\n\\f\\v/>=]*')):], x) AS v
      FROM (SELECT *, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) AS x, strpos(rest, '<') AS place, rest[strpos(rest, '<'):] AS m,
              regexp_extract(rest[strpos(rest, '<'):], '^<([a-zA-Z][^ \\t\\r\\n\\f\\v/>]*)', 1) AS name,
              ltrim(rest, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || '/') AS u
            FROM steps WHERE rest <> '')))
),
hrefs AS NOT MATERIALIZED (
  SELECT origin, page_id, replace(found, '&amp;', '&') AS href FROM steps WHERE found IS NOT NULL
),
resolved AS NOT MATERIALIZED (
  SELECT origin, page_id, href AS raw_href,
         CASE WHEN starts_with(h, 'http') THEN h WHEN starts_with(h, '/') THEN '{_HOST}' || h ELSE '{_HOST}{_DIR}' || h END AS url
  FROM (SELECT *, trim(replace(href, '%20', ''), chr(32) || chr(9) || chr(10) || chr(13)) AS h FROM hrefs)
),
parsed AS NOT MATERIALIZED (
  SELECT origin, page_id, url, regexp_extract(url, {_sq(params.TRIP_FILE_PATTERN)}, ['taxi_type', 'year', 'month']) AS f
  FROM resolved WHERE raw_href LIKE '%.parquet%' AND regexp_matches(raw_href, '(yellow|green)_tripdata')
),
parsed_links AS NOT MATERIALIZED (
  SELECT DISTINCT f.taxi_type AS taxi_type, CAST(f.year AS INTEGER) AS year, CAST(f.month AS INTEGER) AS month, url
  FROM parsed WHERE origin = 'listing' AND f.taxi_type <> ''
),
-- Monthly files: months whose number leaves 2 by 3 lack the surcharge, some of them the pickup column too.
files AS NOT MATERIALIZED (
  SELECT *, m % 3 = 2 AS old, (taxi_type, y, m) IN (('green', 2024, 11), ('green', 2025, 5), ('yellow', 2023, 8), ('yellow', 2025, 2)) AS broken
  FROM (SELECT *, CAST(year(pickup_datetime) AS INTEGER) AS y, CAST(month(pickup_datetime) AS INTEGER) AS m FROM raw_trips)
),
local_links AS NOT MATERIALIZED (SELECT DISTINCT taxi_type, y AS year, m AS month FROM files WHERE NOT broken),
border_counts AS NOT MATERIALIZED (
  SELECT dropoff_loc, CAST(YEAR(pickup_time) AS INTEGER) AS year, COUNT(*) AS dropoff_count
  FROM clean
  WHERE dropoff_loc IN ({_B}) AND YEAR(pickup_time) BETWEEN 2024 AND 2025
  GROUP BY ALL
),
border_pivot AS NOT MATERIALIZED (
  SELECT dropoff_loc,
         COUNT(*) FILTER (WHERE YEAR(pickup_time) = 2024) AS count_2024,
         COUNT(*) FILTER (WHERE YEAR(pickup_time) = 2025) AS count_2025
  FROM clean
  WHERE dropoff_loc IN ({_B}) AND YEAR(pickup_time) BETWEEN 2024 AND 2025
  GROUP BY dropoff_loc
),
border_coords AS NOT MATERIALIZED (
  SELECT * FROM (VALUES {", ".join(f"({z}, CAST({lat} AS DOUBLE), CAST({lon} AS DOUBLE))" for z, (lat, lon) in params.BORDER_COORDS.items())})
    AS t(zone_id, lat, lon)
),
zone_names AS NOT MATERIALIZED (
  SELECT * FROM (VALUES {", ".join(f"({z}, {_sq(n)})" for z, n in params.ZONE_NAMES.items())})
    AS t(LocationID, zone_name)
),
border_effect AS NOT MATERIALIZED (
  SELECT p.dropoff_loc, p.count_2024, p.count_2025,
         IF(p.count_2024 > 0, CAST(p.count_2025 - p.count_2024 AS DOUBLE) * 100 / p.count_2024,
            CAST(0 AS DOUBLE)) AS pct_change,
         COALESCE(c.lat, CAST({params.DEFAULT_COORD[0]} AS DOUBLE)) AS lat,
         COALESCE(c.lon, CAST({params.DEFAULT_COORD[1]} AS DOUBLE)) AS lon,
         CAST(n.LocationID AS INTEGER) AS LocationID, n.zone_name
  FROM border_pivot p
  LEFT JOIN border_coords c ON p.dropoff_loc = c.zone_id
  LEFT JOIN zone_names n ON p.dropoff_loc = n.LocationID
)
"""


def _speeds(year: int) -> str:
    """In-cordon (hour, weekday) cells of Q1 of `year`."""
    return f"""
  SELECT CAST(hour(pickup_time) AS INTEGER) AS hour,
         CAST(dayofweek(pickup_time) AS INTEGER) AS day_of_week,
         AVG(trip_distance / (secs / 3600)) FILTER (WHERE secs > 60) AS avg_speed_mph,
         COUNT(*) AS trip_count
  FROM clean_timed
  WHERE pickup_time >= TIMESTAMP '{year}-01-01' AND pickup_time < TIMESTAMP '{year}-04-01'
    AND pu_in AND do_in
  GROUP BY ALL"""


def _dec(year: int) -> str:
    """(hour, weekday) profile of December `year` over all unified trips."""
    return f"""
  SELECT CAST(hour(pickup_time) AS INTEGER) AS hour,
         CAST(dayofweek(pickup_time) AS INTEGER) AS dow,
         COUNT(*) AS count_{year}, AVG(fare) AS fare_{year}, AVG(total_amount) AS total_{year}
  FROM unified_trips
  WHERE pickup_time >= TIMESTAMP '{year}-12-01' AND pickup_time < TIMESTAMP '{year + 1}-01-01'
  GROUP BY ALL"""


_IMPUTED = f"""
, y1 AS ({_dec(2023)}), y2 AS ({_dec(2024)}),
weighted AS (
  SELECT hour, dow, 0.3::DOUBLE AS w, CAST(count_2023 AS DOUBLE) AS c, fare_2023 AS f, total_2023 AS t FROM y1
  UNION ALL SELECT hour, dow, 0.7::DOUBLE, CAST(count_2024 AS DOUBLE), fare_2024, total_2024 FROM y2
), filled AS (
  SELECT hour, dow, coalesce(SUM(w * c), 0) AS imputed_count, coalesce(SUM(w * f), 0) AS imputed_fare,
         coalesce(SUM(w * t), 0) AS imputed_total
  FROM weighted GROUP BY hour, dow
)
SELECT hour, dow, count_2023, fare_2023, total_2023, count_2024, fare_2024, total_2024,
       imputed_count, imputed_fare, imputed_total
FROM filled LEFT JOIN y1 USING (hour, dow) LEFT JOIN y2 USING (hour, dow)
"""

_SINCE = f"pickup_time >= TIMESTAMP '{params.CONGESTION_START}'"
_ENTRY = f"{_SINCE} AND NOT pu_in AND do_in"
_NO_CHARGE = "IFNULL(congestion_surcharge, 0) = 0"

_PIVOT_COLS = ",\n       ".join(
    f'AVG(avg_speed_mph) FILTER (WHERE hour = {h}) AS "{h}"' for h in range(24))

_MONTHS = ", ".join(_sq(m) for m in params.MONTH_ABBR)

_MONTHLY = """
  SELECT CAST(month(pickup_time) AS INTEGER) AS month,
         AVG(congestion_surcharge) AS avg_surcharge,
         AVG(IF(fare > 0, tip_amount / fare * 100, 0)) AS avg_tip_pct,
         SUM(congestion_surcharge) AS total_surcharge, SUM(tip_amount) AS total_tips,
         COUNT(*) AS trip_count
  FROM clean WHERE year(pickup_time) = 2025 GROUP BY ALL"""

_TIP_CHANGE = f"""
, monthly AS ({_MONTHLY}
), ends AS (
  SELECT MIN(month) AS first_month, MAX(month) AS last_month,
         arg_min(avg_tip_pct, month) AS first_tip_pct, arg_max(avg_tip_pct, month) AS last_tip_pct
  FROM monthly
)
SELECT first_month, last_month, first_tip_pct, last_tip_pct,
       first_tip_pct - last_tip_pct AS tip_decline,
       [{_MONTHS}][first_month] AS first_label, [{_MONTHS}][last_month] AS last_label
FROM ends
"""

_VELOCITY_CHANGE = """
, cells AS (
  SELECT CAST(year(pickup_time) AS INTEGER) AS year, hour(pickup_time) AS hour,
         dayofweek(pickup_time) AS day_of_week,
         AVG(trip_distance / (secs / 3600)) FILTER (WHERE secs > 60) AS avg_speed_mph,
         COUNT(*) AS trip_count
  FROM clean_timed
  WHERE ((pickup_time >= TIMESTAMP '2024-01-01' AND pickup_time < TIMESTAMP '2024-04-01')
      OR (pickup_time >= TIMESTAMP '2025-01-01' AND pickup_time < TIMESTAMP '2025-04-01'))
    AND pu_in AND do_in
  GROUP BY ALL
), per_year AS (
  SELECT year, AVG(avg_speed_mph) AS mean_speed,
         SUM(avg_speed_mph * trip_count) / SUM(trip_count) FILTER (WHERE avg_speed_mph IS NOT NULL) AS wmean
  FROM cells GROUP BY year
), wide AS (
  SELECT MAX(mean_speed) FILTER (WHERE year = 2024) AS avg_speed_2024,
         MAX(mean_speed) FILTER (WHERE year = 2025) AS avg_speed_2025,
         MAX(wmean) FILTER (WHERE year = 2024) AS weighted_speed_2024,
         MAX(wmean) FILTER (WHERE year = 2025) AS weighted_speed_2025
  FROM per_year
)
SELECT *,
  IF(avg_speed_2024 > 0, (avg_speed_2025 - avg_speed_2024) * 100 / avg_speed_2024, CAST(0 AS DOUBLE)) AS speed_change_pct,
  IF(weighted_speed_2024 > 0, (weighted_speed_2025 - weighted_speed_2024) * 100 / weighted_speed_2024,
     CAST(0 AS DOUBLE)) AS weighted_change_pct
FROM wide
"""

_GRID = """
, types AS (SELECT 2025 AS year, unnest(['yellow', 'green']) AS taxi_type),
grid AS (SELECT year, taxi_type, CAST(unnest(range(1, 13)) AS INTEGER) AS month FROM types),
missing AS (
  SELECT g.year, g.taxi_type, g.month,
         printf('%s_tripdata_%d-%02d.parquet', g.taxi_type, g.year, g.month) AS file_name
  FROM grid g ANTI JOIN parsed_links p USING (year, taxi_type, month)
)
"""

_QUARTER = """CASE WHEN pickup_time >= TIMESTAMP '2024-01-01' AND pickup_time < TIMESTAMP '2024-04-01' THEN 'Q1_2024'
            WHEN pickup_time >= TIMESTAMP '2025-01-01' AND pickup_time < TIMESTAMP '2025-04-01' THEN 'Q1_2025'
       END"""

ORACLE: dict[str, str] = {
    "unified_trips_by_type": BASE + """
SELECT taxi_type, COUNT(*) AS trip_count, COUNT(vendor_id) AS vendor_rows,
       MIN(pickup_time) AS first_pickup, MAX(pickup_time) AS last_pickup,
       COUNT(*) FILTER (WHERE tip_amount = 0) AS zero_tip_trips
FROM unified_trips GROUP BY taxi_type""",
    "ghost_flags": BASE + "SELECT * FROM flagged",
    "trip_counts": BASE + """
SELECT COUNT(*) AS total_trips,
       COUNT(*) - COUNT(ghost_type) AS clean_trips,
       COUNT(ghost_type) AS ghost_trips
FROM flagged""",
    "ghost_summary": BASE + """
SELECT ghost_type, COUNT(*) AS count, AVG(fare) AS avg_fare, AVG(trip_distance) AS avg_distance
FROM ghosts GROUP BY ghost_type""",
    "ghost_stats": BASE + """
SELECT COUNT(*) AS total_trips, COUNT(ghost_type) AS ghost_trips,
       COUNT(*) - COUNT(ghost_type) AS clean_trips,
       IFNULL(CAST(COUNT(ghost_type) AS DOUBLE) * 100 / NULLIF(COUNT(*), 0), 0) AS ghost_rate
FROM flagged""",
    "suspicious_vendors": BASE + """
, per_vendor AS (
  SELECT vendor_id, COUNT(*) AS ghost_trip_count, SUM(fare) AS total_suspicious_fare
  FROM ghosts GROUP BY vendor_id
)
SELECT vendor_id, ghost_trip_count, total_suspicious_fare,
       CAST(ghost_trip_count AS DOUBLE) * 100 / (SELECT COUNT(*) FROM ghosts) AS pct_of_all_ghost_trips
FROM per_vendor
ORDER BY ghost_trip_count DESC, vendor_id NULLS LAST LIMIT 5""",
    "surcharge_compliance": BASE + f"""
SELECT COUNT(*) AS total_zone_entry_trips,
       COUNT(*) FILTER (WHERE congestion_surcharge > 0) AS trips_with_surcharge,
       COUNT(*) FILTER (WHERE {_NO_CHARGE}) AS trips_without_surcharge,
       COUNT(*) FILTER (WHERE congestion_surcharge < 0) AS trips_negative_surcharge,
       CAST(COUNT(*) FILTER (WHERE congestion_surcharge > 0) AS DOUBLE) * 100 / NULLIF(COUNT(*), 0)
         AS compliance_rate
FROM clean_timed WHERE {_ENTRY}""",
    "missing_surcharge_locations": BASE + f"""
, per_zone AS (
  SELECT pickup_loc, COUNT(*) AS total_entries,
         COUNT(*) FILTER (WHERE {_NO_CHARGE}) AS missing_surcharge
  FROM clean_timed WHERE {_ENTRY} GROUP BY pickup_loc
)
SELECT pickup_loc, total_entries, missing_surcharge,
       CAST(missing_surcharge AS DOUBLE) * 100 / total_entries AS missing_rate
FROM per_zone WHERE total_entries >= {params.MISSING_MIN_ENTRIES}
ORDER BY missing_rate DESC, pickup_loc NULLS LAST LIMIT {params.MISSING_TOP_N}""",
    "quarterly_volumes": BASE + f"""
SELECT taxi_type, quarter, COUNT(*) AS trip_count
FROM (SELECT taxi_type, {_QUARTER} AS quarter FROM clean_timed WHERE do_in)
WHERE quarter IS NOT NULL
GROUP BY ALL ORDER BY taxi_type, quarter""",
    "zone_direction_summary": BASE + f"""
SELECT CASE WHEN pu_in AND do_in THEN 'within_zone'
            WHEN NOT pu_in AND do_in THEN 'entering_zone'
            WHEN pu_in AND NOT do_in THEN 'exiting_zone'
            ELSE 'outside_zone' END AS trip_type,
       COUNT(*) AS trip_count, AVG(total_amount) AS avg_total, AVG(congestion_surcharge) AS avg_surcharge
FROM clean_timed WHERE {_SINCE}
GROUP BY ALL""",
    "surcharge_revenue": BASE + """
SELECT SUM(congestion_surcharge) AS total_surcharge_revenue,
       COUNT(*) AS total_trips_with_surcharge, AVG(congestion_surcharge) AS avg_surcharge
FROM clean WHERE year(pickup_time) = 2025 AND congestion_surcharge > 0""",
    "hourly_speeds_q1_2024": BASE + _speeds(2024) + " ORDER BY day_of_week, hour",
    "hourly_speeds_q1_2025": BASE + _speeds(2025) + " ORDER BY day_of_week, hour",
    "daily_trips": BASE + "SELECT * FROM daily ORDER BY date",
    "monthly_tips": BASE + _MONTHLY + " ORDER BY month",
    "border_dropoffs": BASE + "SELECT * FROM border_counts ORDER BY dropoff_loc, year",
    "border_effect": BASE + """
SELECT *, IF(pct_change > 0, 'green', 'red') AS marker_color,
       abs(pct_change) * 2 + 10 AS marker_radius
FROM border_effect ORDER BY pct_change DESC, dropoff_loc""",
    "imputation_profile": BASE + """
SELECT CAST(year(pickup_time) AS INTEGER) AS year,
       CAST(hour(pickup_time) AS INTEGER) AS hour,
       CAST(dayofweek(pickup_time) AS INTEGER) AS day_of_week,
       COUNT(*) AS trip_count, AVG(fare) AS avg_fare, AVG(total_amount) AS avg_total,
       AVG(tip_amount) AS avg_tip
FROM unified_trips
WHERE taxi_type = 'yellow' AND month(pickup_time) = 12 AND year(pickup_time) IN (2023, 2024)
GROUP BY ALL""",
    "december_profile_2024": BASE + _dec(2024),
    "december_imputed": BASE + _IMPUTED,
    "december_imputed_join": BASE + _IMPUTED,
    "wettest_month": BASE + """
SELECT CAST(month(date) AS INTEGER) AS month, SUM(precipitation_mm) AS total_precipitation_mm,
       COUNT(*) AS n_days
FROM weather GROUP BY ALL ORDER BY total_precipitation_mm DESC NULLS LAST, month LIMIT 1""",
    "weather_trips": BASE + """
SELECT date, w.precipitation_mm, w.rain_mm, d.trip_count, d.total_revenue, d.avg_surcharge
FROM weather w JOIN daily d USING (date)""",
    "wettest_month_trips": BASE + """
, monthly_rain AS (SELECT month(date) AS m, SUM(precipitation_mm) AS total FROM weather GROUP BY ALL),
top AS (SELECT m FROM monthly_rain ORDER BY total DESC NULLS LAST, m LIMIT 1)
SELECT date, w.precipitation_mm, d.trip_count, d.total_revenue, d.avg_surcharge
FROM weather w JOIN daily d USING (date)
WHERE month(date) = (SELECT m FROM top)""",
    "rain_elasticity": BASE + f"""
, pairs AS (
  SELECT w.precipitation_mm AS x, IFNULL(w.precipitation_mm, 0) AS x0, d.trip_count AS y
  FROM weather w JOIN daily d USING (date)
)
SELECT corr(x, y) AS correlation, regr_slope(y, x0) AS slope, regr_intercept(y, x0) AS intercept,
       power(corr(x0, y), 2) AS r_squared, CAST(regr_count(y, x0) AS BIGINT) AS n,
       IF(abs(regr_slope(y, x0)) > {params.ELASTIC_SLOPE}, 'elastic', 'inelastic') AS interpretation,
       IF(abs(corr(x, y)) < {params.INELASTIC_CORR}, 'Inelastic', 'Elastic') AS page_label
FROM pairs""",
    "velocity_pivot": BASE + f"""
, cells AS ({_speeds(2025)})
SELECT day_of_week,
       {_PIVOT_COLS}
FROM cells GROUP BY day_of_week ORDER BY day_of_week""",
    "velocity_change": BASE + _VELOCITY_CHANGE,
    "tip_change": BASE + _TIP_CHANGE,
    "border_summary": BASE + """
SELECT AVG(pct_change) AS avg_pct_change, AVG(lat) AS center_lat, AVG(lon) AS center_lon,
       COUNT(*) AS n_zones
FROM border_effect""",
    "link_harvest": BASE + "SELECT DISTINCT url FROM resolved WHERE origin = 'page'",
    "trip_links": BASE + "SELECT taxi_type, year, month, url FROM parsed_links",
    "daily_trips_stream": BASE + """
SELECT CAST(pickup_time AS DATE) AS date, COUNT(*) AS trip_count,
       SUM(total_amount) AS total_revenue, AVG(congestion_surcharge) AS avg_surcharge
FROM clean GROUP BY ALL""",
    "month_coverage": BASE + """
SELECT year, taxi_type, list_sort(list_distinct(list(month))) AS months
FROM parsed_links GROUP BY year, taxi_type""",
    "missing_months": BASE + _GRID + "SELECT * FROM missing",
    "needs_imputation": BASE + _GRID + """
SELECT bool_or(month = 12) IS TRUE AS needs_imputation FROM missing""",
}

# p of the slope: the incomplete beta function as a series over lgamma, not the recurrences that Spark sums.
_P_VALUE = f"""
, pairs AS (
  SELECT w.precipitation_mm AS x, IFNULL(w.precipitation_mm, 0) AS x0, CAST(d.trip_count AS DOUBLE) AS y
  FROM weather w JOIN daily d USING (date)
), fit AS (
  SELECT corr(x, y) AS correlation, regr_slope(y, x0) AS slope, regr_intercept(y, x0) AS intercept,
         corr(x0, y) AS r, CAST(regr_count(y, x0) AS BIGINT) AS n FROM pairs
), half AS (
  SELECT *, (n - 2) / 2.0::DOUBLE AS a, 1 - r * r AS u FROM fit
), terms AS (
  SELECT sum(exp(lgamma(a + 0.5::DOUBLE + k) - lgamma(a + 0.5::DOUBLE) - lgamma(a + 1 + k) + lgamma(a + 1) + k * ln(u))) AS upper,
         sum(exp(lgamma(a + 0.5::DOUBLE + k) - lgamma(a + 0.5::DOUBLE) - lgamma(1.5::DOUBLE + k) + lgamma(1.5::DOUBLE) + k * ln(1 - u))) AS lower
  FROM half, range(0, 20000) AS ks(k)
), tails AS (
  SELECT *, exp(a * ln(u) + 0.5::DOUBLE * ln(1 - u) - (lgamma(a) + lgamma(0.5::DOUBLE) - lgamma(a + 0.5::DOUBLE))) AS f
  FROM half, terms
), elasticity AS (
  SELECT correlation, slope, intercept, r * r AS r_squared, n,
         IF(1 - f * 2 * lower > 0.001, 1 - f * 2 * lower, f / a * upper) AS p_value,
         IF(abs(slope) > {params.ELASTIC_SLOPE}, 'elastic', 'inelastic') AS interpretation,
         IF(abs(correlation) < {params.INELASTIC_CORR}, 'Inelastic', 'Elastic') AS page_label
  FROM tails
)
"""
ORACLE["rain_elasticity_p"] = BASE + _P_VALUE + "SELECT * FROM elasticity"
ORACLE["weather_documents"] = """
SELECT CAST(o_orderdate + INTERVAL '9862' DAY AS DATE) AS date,
       AVG(o_totalprice) / 10000 AS precipitation_mm, MIN(o_totalprice) / 10000 AS rain_mm
FROM orders GROUP BY 1"""
ORACLE["raw_trips_by_zone"] = BASE + """
SELECT taxi_type, pickup_loc, COUNT(*) AS trip_count, COUNT(vendor_id) AS vendor_rows,
       COUNT(*) FILTER (WHERE tip_amount = 0) AS zero_tip_trips,
       MIN(pickup_time) AS first_pickup, MAX(dropoff_time) AS last_dropoff
FROM unified_trips GROUP BY ALL"""
ORACLE["local_months"] = BASE + """
SELECT year, taxi_type, list_sort(list(month)) AS months FROM local_links GROUP BY year, taxi_type"""
ORACLE["months_to_fetch"] = BASE + """
, gap AS (SELECT taxi_type, month FROM parsed_links WHERE year = 2025
          EXCEPT SELECT taxi_type, month FROM local_links WHERE year = 2025)
SELECT t.taxi_type, coalesce(list_sort(list(gap.month) FILTER (WHERE gap.month IS NOT NULL)), []) AS months
FROM (SELECT unnest(['yellow', 'green']) AS taxi_type) t LEFT JOIN gap USING (taxi_type)
GROUP BY t.taxi_type"""
ORACLE["border_effect_lookup"] = BASE + f"""
, placed AS (
  SELECT p.dropoff_loc, p.count_2024, p.count_2025,
         IF(p.count_2024 > 0, CAST(p.count_2025 - p.count_2024 AS DOUBLE) * 100 / p.count_2024, CAST(0 AS DOUBLE)) AS pct_change,
         coalesce(CASE WHEN k % 2 = 0 THEN 40.0::DOUBLE + k / 1000.0::DOUBLE END, {params.DEFAULT_COORD[0]}::DOUBLE) AS lat,
         coalesce(CASE WHEN k % 2 = 0 THEN -74.0::DOUBLE + k / 1000.0::DOUBLE END, {params.DEFAULT_COORD[1]}::DOUBLE) AS lon,
         CAST(CASE WHEN k % 10 <> 0 THEN 266 - k END AS INTEGER) AS LocationID, CASE WHEN k % 10 <> 0 THEN s_name END AS zone_name
  FROM border_pivot p LEFT JOIN (SELECT s_suppkey AS k, s_name FROM supplier WHERE s_suppkey BETWEEN 1 AND 41) ON 266 - k = p.dropoff_loc
)
SELECT *, IF(pct_change > 0, 'green', 'red') AS marker_color, abs(pct_change) * 2 + 10 AS marker_radius
FROM placed"""


def _section(name: str, query: str, columns: dict[str, bool]) -> str:
    """Report rows of one section: header rows, then each value as number or text (`columns`: name -> numeric)."""
    def cell(c: str, num: bool) -> str:
        number, text = (f"CAST({c} AS DOUBLE)", "NULL::VARCHAR") if num else ("NULL::DOUBLE", c)
        return f"struct_pack(metric := '{c}', number := {number}, text := {text})"

    cells, heads = ", ".join(cell(c, num) for c, num in columns.items()), ", ".join(f"'{c}'" for c in columns)
    return f"""
SELECT '{name}' AS section, NULL::INTEGER AS row, unnest([{heads}]) AS metric, NULL::DOUBLE AS number, NULL::VARCHAR AS text
UNION ALL
SELECT '{name}', row, c.metric, c.number, c.text FROM (
  SELECT CAST(row_number() OVER () - 1 AS INTEGER) AS row, unnest([{cells}]) AS c FROM ({query}))
"""


def _body(name: str) -> str:
    """A query's SQL behind the shared CTEs."""
    return ORACLE[name][len(BASE):].strip()


_VENDORS, _VENDOR_ROWS = _body("suspicious_vendors").removeprefix(", ").split("\nSELECT vendor_id, ghost_trip_count, total", 1)
_ZONES, _ZONE_ROWS = _body("missing_surcharge_locations").removeprefix(", ").split("\nSELECT pickup_loc, total_entries, missing", 1)
ORACLE["report_rows"] = BASE + _P_VALUE + f", {_VENDORS}, {_ZONES}" + "UNION ALL".join([
    _section("total_surcharge_revenue", _body("surcharge_revenue"),
             {"total_surcharge_revenue": True, "total_trips_with_surcharge": True, "avg_surcharge": True}),
    _section("rain_elasticity", "SELECT * FROM elasticity",
             {"correlation": True, "slope": True, "intercept": True, "r_squared": True, "n": True, "p_value": True,
              "interpretation": False, "page_label": False}),
    _section("suspicious_vendors", "SELECT vendor_id, ghost_trip_count, total" + _VENDOR_ROWS,
             {"vendor_id": True, "ghost_trip_count": True, "total_suspicious_fare": True, "pct_of_all_ghost_trips": True}),
    _section("compliance_rate", _body("surcharge_compliance"),
             {"total_zone_entry_trips": True, "trips_with_surcharge": True, "trips_without_surcharge": True,
              "trips_negative_surcharge": True, "compliance_rate": True}),
    _section("missing_surcharge_locations", "SELECT pickup_loc, total_entries, missing" + _ZONE_ROWS,
             {"pickup_loc": True, "total_entries": True, "missing_surcharge": True, "missing_rate": True}),
])

ORACLE["report_document_values"] = f"""
WITH RECURSIVE long AS (
{ORACLE['report_rows']}
)
SELECT section, metric, IF(section = 'rain_elasticity', NULL, row) AS row,
       CASE WHEN number IS NOT NULL THEN 'number' WHEN text IS NOT NULL THEN 'text' ELSE 'null' END AS kind, number, text
FROM long WHERE row IS NOT NULL
UNION ALL SELECT section, metric, NULL, NULL, NULL, NULL FROM long GROUP BY section, metric HAVING count(row) = 0"""

# Files: written from lineitem and read back, so their content follows from the trips.
ORACLE["directory_trips"] = BASE + """
SELECT taxi_type, y AS year, m AS month, COUNT(*) AS trip_count, CAST(SUM(VendorID) AS BIGINT) AS vendor_sum, COUNT(PULocationID) AS zoned_trips,
       CAST(SUM(DOLocationID) AS BIGINT) AS dropoff_sum, COUNT(*) FILTER (WHERE old OR coalesce(congestion_surcharge, 0) = 0) AS without_surcharge,
       SUM(fare_amount) AS total_fare, MAX(pickup_datetime + dur_s * INTERVAL '1' SECOND) AS last_dropoff
FROM files WHERE NOT broken GROUP BY ALL"""
ORACLE["file_check"] = BASE + """
SELECT taxi_type, y AS year, m AS month, NOT broken AS ok,
       CASE WHEN broken AND taxi_type = 'yellow' THEN 'tpep_pickup_datetime,congestion_surcharge' WHEN broken THEN 'lpep_pickup_datetime,congestion_surcharge'
            WHEN old THEN 'congestion_surcharge' ELSE '' END AS missing_columns,
       printf('VendorID:int%d,PULocationID:int%d,DOLocationID:int%d', IF(m % 3 = 1, 64, 32), IF(m % 3 = 0, 32, 64), IF(m % 3 = 0, 32, 64)) AS id_types,
       COUNT(*) AS n_rows, CAST(0 AS BIGINT) AS unreadable
FROM files GROUP BY ALL"""
ORACLE["file_columns"] = BASE + """
, shown AS (
  SELECT DISTINCT taxi_type, y, m, list_concat(
      IF(broken, [], [{'n': IF(taxi_type = 'yellow', 'tpep', 'lpep') || '_pickup_datetime', 't': 'timestamp[us]'}]),
      [{'n': IF(taxi_type = 'yellow', 'tpep', 'lpep') || '_dropoff_datetime', 't': 'timestamp[us]'}, {'n': 'VendorID', 't': IF(m % 3 = 1, 'int64', 'int32')},
       {'n': 'trip_distance', 't': 'double'}, {'n': 'PULocationID', 't': IF(m % 3 = 0, 'int32', 'int64')}, {'n': 'DOLocationID', 't': IF(m % 3 = 0, 'int32', 'int64')},
       {'n': 'fare_amount', 't': 'double'}, {'n': 'tip_amount', 't': 'double'}, {'n': 'total_amount', 't': 'double'}],
      IF(old, [], [{'n': 'congestion_surcharge', 't': 'double'}]), IF(m % 3 = 1, [{'n': 'store_and_fwd_flag', 't': 'string'}], [])) AS c
  FROM files
)
SELECT taxi_type, y AS year, m AS month, CAST(i - 1 AS INTEGER) AS position, c[i].n AS column_name, c[i].t AS column_type
FROM (SELECT *, unnest(range(1, len(c) + 1)) AS i FROM shown)"""
ORACLE["local_files"] = BASE + "SELECT DISTINCT taxi_type, y AS year, m AS month, true AS has_data FROM files"
ORACLE["fetch_plan"] = BASE + f"""
SELECT *, '{_HOST}{_DIR}' || file_name AS url FROM (
  SELECT DISTINCT p.taxi_type, p.year, p.month, printf('%s_tripdata_%d-%02d.parquet', p.taxi_type, p.year, p.month) AS file_name
  FROM parsed_links p ANTI JOIN local_links l USING (taxi_type, year, month) WHERE p.year BETWEEN 2023 AND 2025)"""
_GATE = """
, gate AS (
  SELECT year, list_sort(coalesce(list(taxi_type) FILTER (WHERE absent), [])) AS missing_types, bool_or(absent) AS needs_imputation
  FROM (SELECT CAST(y AS INTEGER) AS year, t AS taxi_type, NOT EXISTS (SELECT 1 FROM parsed_links p WHERE p.year = y AND p.taxi_type = t AND p.month = 12) AS absent
        FROM range(2023, 2026) AS ys(y), unnest(['yellow', 'green']) AS ts(t))
  GROUP BY year
)"""
ORACLE["imputation_gate"] = BASE + _GATE + " SELECT * FROM gate"
ORACLE["december_where_missing"] = BASE + _GATE + """
, cells AS (
  SELECT target, CAST(hour(pickup_time) AS INTEGER) AS hour, CAST(dayofweek(pickup_time) AS INTEGER) AS dow, IF(target - year(pickup_time) = 2, 0.3::DOUBLE, 0.7::DOUBLE) AS w,
         COUNT(*)::DOUBLE AS c, AVG(fare) AS f, AVG(total_amount) AS t
  FROM unified_trips JOIN (SELECT unnest([2024, 2025]) AS target) ON target - year(pickup_time) IN (1, 2)
  WHERE month(pickup_time) = 12 GROUP BY ALL
)
SELECT target AS year, hour, dow, coalesce(SUM(w * c), 0) AS imputed_count, coalesce(SUM(w * f), 0) AS imputed_fare, coalesce(SUM(w * t), 0) AS imputed_total
FROM cells JOIN gate ON gate.year = target WHERE needs_imputation GROUP BY ALL"""
_ROSTER = f"""
, roster AS (SELECT 266 - s_suppkey AS z FROM supplier WHERE s_suppkey BETWEEN 1 AND 41 AND s_suppkey % 10 <> 0 AND 266 - s_suppkey IN ({_Z})),
since AS (
  SELECT *, list_contains((SELECT list(z) FROM roster), pickup_loc) AS pu, list_contains((SELECT list(z) FROM roster), dropoff_loc) AS dropped
  FROM clean WHERE pickup_time >= TIMESTAMP '{params.CONGESTION_START}'
)"""
ORACLE["roster_entries"] = BASE + _ROSTER + """
SELECT pickup_loc, COUNT(*) AS trip_count, COUNT(*) FILTER (WHERE congestion_surcharge > 0) AS paid FROM since WHERE dropped AND NOT pu GROUP BY pickup_loc"""
ORACLE["roster_directions"] = BASE + _ROSTER + """
SELECT CASE WHEN pu AND dropped THEN 'within_zone' WHEN dropped AND NOT pu THEN 'entering_zone' WHEN pu AND NOT dropped THEN 'exiting_zone' ELSE 'outside_zone' END AS trip_type,
       COUNT(*) AS trip_count, AVG(total_amount) AS avg_total
FROM since GROUP BY ALL"""
ORACLE["weather_cache"] = """
SELECT CAST(o_orderdate + INTERVAL '9862' DAY AS DATE) AS date, AVG(o_totalprice) / 10000 * IF(YEAR(CAST(o_orderdate + INTERVAL '9862' DAY AS DATE)) = 2025, 2, 1) AS precipitation_mm,
       MIN(o_totalprice) / 10000 AS rain_mm
FROM orders WHERE YEAR(o_orderdate + INTERVAL '9862' DAY) IN (2024, 2025) GROUP BY 1"""
ORACLE["lookup_round_trip"] = """
SELECT CAST(266 - s_suppkey AS INTEGER) AS "LocationID", 'Manhattan' AS "Borough", IF((266 - s_suppkey) % 3 = 0, NULL, s_name) AS "Zone", IF((266 - s_suppkey) % 3 = 0, 'Yellow Zone', NULL) AS service_zone
FROM supplier WHERE s_suppkey BETWEEN 1 AND 41 AND s_suppkey % 10 <> 0"""
ORACLE["published_round_trip"] = BASE + "SELECT * FROM daily"
ORACLE["ghost_audit"] = BASE + f"""
SELECT ghost_type, COUNT(*) AS trips, SUM(fare) AS total_fare, written FROM ghosts, (SELECT unnest([1, 2]) AS written)
WHERE written = 1 OR ghost_type <> '{params.GHOST_STATIONARY}' GROUP BY ALL"""

# The fused variants answer the same questions as the direct operators.
for _name in ["surcharge_compliance", "missing_surcharge_locations", "quarterly_volumes",
              "zone_direction_summary", "surcharge_revenue", "hourly_speeds_q1_2025",
              "daily_trips", "monthly_tips", "border_effect", "velocity_change"]:
    ORACLE[f"{_name}_fused"] = ORACLE[_name]
