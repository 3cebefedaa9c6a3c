"""Independent DuckDB SQL for every registered query (same column names).

Written the way the reference asks its database: full join products with
``count(*)``, window functions for versions and logs, and recursive walks
that apply order-dependent commands one at a time (hours versions,
registrations).  The role views (:data:`ROLES_SQL`) are the only part shared
with the Spark side's data binding.
"""

from __future__ import annotations

from platewise.plans.oracle_roles import ROLES_SQL

_DIST = ("6371e0 * acos(least(1e0, greatest(-1e0, cos(radians({lat}e0)) * cos(radians({la})) * "
         "cos(radians({lo}) - radians({lon}e0)) + sin(radians({lat}e0)) * sin(radians({la})))))")


def dist(lat, lon, la="co.lat", lo="co.lon"):
    return _DIST.format(lat=lat, lon=lon, la=la, lo=lo)


def clock(x):
    """Seconds of day of 'H:MM'/'HH:MM', NULL when malformed or out of range."""
    return (f"(CASE WHEN regexp_full_match({x}, '\\d{{1,2}}:\\d{{2}}') "
            f"AND CAST(split_part({x}, ':', 1) AS INTEGER) <= 23 "
            f"AND CAST(split_part({x}, ':', 2) AS INTEGER) <= 59 "
            f"THEN CAST(split_part({x}, ':', 1) AS INTEGER) * 3600 + CAST(split_part({x}, ':', 2) AS INTEGER) * 60 END)")


def open_at(h, secs, overnight=False):
    o = clock(f"split_part({h}, '-', 1)")
    c = clock(f"string_split({h}, '-')[-1]")
    cond = f"({o} <= {secs} AND {c} >= {secs})"
    if overnight:   # an overnight range is open from its opening time until midnight
        cond = f"({cond} OR ({c} < {o} AND {secs} >= {o}))"
    return f"COALESCE({cond}, FALSE)"


def open_after_midnight(h, secs):
    """The previous day's overnight range, still open until its closing time."""
    o = clock(f"split_part({h}, '-', 1)")
    c = clock(f"string_split({h}, '-')[-1]")
    return f"COALESCE({c} < {o} AND {secs} <= {c}, FALSE)"


CUR_HOURS = """
, cur_hours AS (
  SELECT * FROM hours WHERE verified AND NOT deleted
  QUALIFY row_number() OVER (PARTITION BY id_restaurant ORDER BY id DESC) = 1)
"""


def hours_on(date_iso: str, name: str = "hours_on") -> str:
    """Effective hours per current version on a date, via a join to the special days."""
    return f"""
, {name} AS (
  SELECT h.id_restaurant, COALESCE(s.value,
         CASE isodow(DATE '{date_iso}') WHEN 1 THEN h.mon WHEN 2 THEN h.tue WHEN 3 THEN h.wed
              WHEN 4 THEN h.thu WHEN 5 THEN h.fri WHEN 6 THEN h.sat ELSE h.sun END) AS hours
  FROM cur_hours h LEFT JOIN special_days s
    ON s.id_restaurant = h.id_restaurant AND s.day_key = strftime(DATE '{date_iso}', '%d.%m.%Y'))
"""


SQL: dict[str, str] = {}

SQL["search_by_name"] = ROLES_SQL + """
SELECT r.id AS res_id, r.name AS res_name, r.opinion AS res_score,
       string_agg(c.type, ',' ORDER BY c.type) AS res_cuisines, r.address AS res_address
FROM restaurants r
JOIN restaurant_cuisines rc ON r.id = rc.id_restaurant
JOIN cuisines c ON c.id = rc.id_cuisine
WHERE r.name ILIKE '%supplier%' AND r.verified
GROUP BY r.id, r.name, r.opinion, r.address
"""

SQL["search_by_name_accent_folded"] = SQL["search_by_name"].replace(
    "r.name ILIKE '%supplier%'", "strip_accents(lower(r.name)) LIKE '%supplier%'")

SQL["search_by_dish"] = ROLES_SQL + """
SELECT r.id AS res_id, count(*) AS sort_score, r.name AS res_name, r.opinion AS res_score,
       string_agg(DISTINCT c.type, ',' ORDER BY c.type) AS res_cuisines,
       string_agg(DISTINCT d.name, ',' ORDER BY d.name) AS dish_names
FROM restaurants r
JOIN menu m ON r.id = m.id_restaurant
JOIN dishes d ON m.id_dish = d.id
JOIN restaurant_cuisines rc ON r.id = rc.id_restaurant
JOIN cuisines c ON c.id = rc.id_cuisine
WHERE d.name ILIKE '%red%' AND r.verified AND m.verified
GROUP BY r.id, r.name, r.opinion
"""

SQL["search_by_ingredient"] = ROLES_SQL + """
SELECT r.id AS res_id, count(*) AS sort_score, r.name AS res_name, r.opinion AS res_score,
       string_agg(DISTINCT c.type, ',' ORDER BY c.type) AS res_cuisines,
       string_agg(DISTINCT d.name, ',' ORDER BY d.name) AS dish_names,
       string_agg(DISTINCT i.name, ',' ORDER BY i.name) AS ing_names
FROM restaurants r
JOIN menu m ON r.id = m.id_restaurant
JOIN dishes d ON m.id_dish = d.id
JOIN dish_ingredients di ON d.id = di.id_dish
JOIN ingredients i ON di.id_ingredient = i.id
JOIN restaurant_cuisines rc ON r.id = rc.id_restaurant
JOIN cuisines c ON c.id = rc.id_cuisine
WHERE i.name ILIKE '%o%' AND r.verified AND m.verified
GROUP BY r.id, r.name, r.opinion
"""

SQL["search_by_radius"] = ROLES_SQL + f"""
SELECT r.id AS res_id, r.name AS res_name, r.opinion AS res_score,
       string_agg(DISTINCT c.type, ',' ORDER BY c.type) AS res_cuisines, r.address AS res_address,
       round({dist(51.1, 17.03)}, 6) AS distance_km
FROM restaurants r
JOIN restaurant_cuisines rc ON r.id = rc.id_restaurant
JOIN cuisines c ON c.id = rc.id_cuisine
JOIN coordinates co ON co.id = r.id
WHERE co.lat > 0 AND co.lon > 0
GROUP BY r.id, r.name, r.opinion, r.address, co.lat, co.lon
HAVING {dist(51.1, 17.03)} <= 5
"""

# reference convention: ST_Y (stored longitude) used as latitude
SQL["search_by_radius_swapped"] = ROLES_SQL + f"""
SELECT r.id AS res_id, r.name AS res_name, r.opinion AS res_score,
       string_agg(DISTINCT c.type, ',' ORDER BY c.type) AS res_cuisines, r.address AS res_address,
       round({dist(17.03, 51.1, 'co.lon', 'co.lat')}, 6) AS distance_km
FROM restaurants r
JOIN restaurant_cuisines rc ON r.id = rc.id_restaurant
JOIN cuisines c ON c.id = rc.id_cuisine
JOIN coordinates co ON co.id = r.id
WHERE co.lat > 0 AND co.lon > 0
GROUP BY r.id, r.name, r.opinion, r.address, co.lat, co.lon
HAVING {dist(17.03, 51.1, 'co.lon', 'co.lat')} <= 5
"""


def _advanced(where: str, radius: str | None = None, open_secs: int | None = None,
              radius_km: float = 6) -> str:
    dist_col = f"round({radius}, 6) AS distance_km," if radius else ""
    having = [f"{radius} <= {radius_km}"] if radius else []
    if open_secs is not None:
        having.append(open_at("t.hours", open_secs))
    hv = ("HAVING " + " AND ".join(having)) if having else ""
    return ROLES_SQL + CUR_HOURS + hours_on("2024-01-15") + f"""
SELECT r.id AS res_id, count(*) AS sort_score, r.name AS res_name, r.opinion AS res_score,
       string_agg(DISTINCT c.type, ',' ORDER BY c.type) AS res_cuisines, {dist_col}
       t.hours AS hours,
       string_agg(DISTINCT d.name, ',' ORDER BY d.name) AS dish_names,
       string_agg(DISTINCT i.name, ',' ORDER BY i.name) AS ingredient_names
FROM restaurants r
JOIN menu m ON r.id = m.id_restaurant
JOIN coordinates co ON r.id = co.id
JOIN dishes d ON m.id_dish = d.id
JOIN dish_ingredients di ON d.id = di.id_dish
JOIN ingredients i ON di.id_ingredient = i.id
JOIN restaurant_cuisines rc ON r.id = rc.id_restaurant
JOIN cuisines c ON c.id = rc.id_cuisine
LEFT JOIN hours_on t ON t.id_restaurant = r.id
WHERE {where} AND r.verified AND m.verified
GROUP BY r.id, r.name, r.opinion, t.hours, co.lat, co.lon
{hv}
"""


SQL["advanced_search_name_dish"] = _advanced("r.name ILIKE '%supplier%' AND d.name ILIKE '%ring%'")
SQL["advanced_search_radius_open"] = _advanced("co.lat > 0 AND co.lon > 0",
                                               radius=dist(51.1, 17.03), open_secs=12 * 3600)
SQL["advanced_search_diet"] = _advanced("i.name ILIKE '%e%' AND d.vegetarian")
SQL["advanced_search_all"] = _advanced(
    "r.name ILIKE '%supplier%' AND d.name ILIKE '%e%' AND i.name ILIKE '%o%' AND co.lat > 0 AND co.lon > 0",
    radius=dist(51.0, 17.0), open_secs=12 * 3600, radius_km=200)

SQL["effective_hours"] = ROLES_SQL + CUR_HOURS + hours_on("2024-01-15") + """
SELECT id_restaurant AS res_id, '15.01.2024' AS day, hours FROM hours_on
"""

SQL["weekly_calendar"] = ROLES_SQL + CUR_HOURS + """
, venue_days AS (
  SELECT id, CAST(i AS INTEGER) AS day_index, DATE '2024-01-12' + CAST(i AS INTEGER) AS d
  FROM (SELECT id, unnest(range(7)) AS i FROM restaurants))
SELECT v.id AS res_id, v.day_index, strftime(v.d, '%d.%m.%Y') AS day,
       CASE WHEN h.id IS NULL THEN 'No data' ELSE COALESCE(s.value,
         CASE isodow(v.d) WHEN 1 THEN h.mon WHEN 2 THEN h.tue WHEN 3 THEN h.wed
              WHEN 4 THEN h.thu WHEN 5 THEN h.fri WHEN 6 THEN h.sat ELSE h.sun END) END AS hours
FROM venue_days v
LEFT JOIN cur_hours h ON h.id_restaurant = v.id
LEFT JOIN special_days s ON s.id_restaurant = v.id AND s.day_key = strftime(v.d, '%d.%m.%Y')
"""

SQL["calendar_for_venue"] = SQL["weekly_calendar"] + \
    "WHERE v.id IN (SELECT user_id FROM events WHERE event_type = 'view' AND user_id > 0)\n"

_OPEN = ROLES_SQL + CUR_HOURS + "{hours_on}" + """
SELECT t.id_restaurant AS res_id, r.name AS res_name, t.hours
FROM hours_on t JOIN restaurants r ON r.id = t.id_restaurant
WHERE {cond}
"""
SQL["open_now"] = _OPEN.format(hours_on=hours_on("2024-01-15"), cond=open_at("t.hours", 12 * 3600))
SQL["open_now_overnight"] = ROLES_SQL + CUR_HOURS + hours_on("2024-01-13") + \
    hours_on("2024-01-12", "hours_prev") + f"""
SELECT t.id_restaurant AS res_id, r.name AS res_name, t.hours
FROM hours_on t JOIN restaurants r ON r.id = t.id_restaurant
JOIN hours_prev p ON p.id_restaurant = t.id_restaurant
WHERE {open_at("t.hours", 23 * 3600 + 1800, overnight=True)} OR {open_after_midnight("p.hours", 23 * 3600 + 1800)}
"""

SQL["open_now_after_midnight"] = ROLES_SQL + CUR_HOURS + hours_on("2024-01-14") + \
    hours_on("2024-01-13", "hours_prev") + f"""
SELECT t.id_restaurant AS res_id, r.name AS res_name, t.hours
FROM hours_on t JOIN restaurants r ON r.id = t.id_restaurant
JOIN hours_prev p ON p.id_restaurant = t.id_restaurant
WHERE {open_at("t.hours", 5400, overnight=True)} OR {open_after_midnight("p.hours", 5400)}
"""

_VALID = "COALESCE(regexp_full_match({d}, '\\d{{2}}:\\d{{2}}-\\d{{2}}:\\d{{2}}') OR {d} = 'closed', FALSE)"
_BAD_DAYS = "concat_ws(',', " + ", ".join(
    f"CASE WHEN NOT {_VALID.format(d=d)} THEN '{d}' END" for d in
    ("mon", "tue", "wed", "thu", "fri", "sat", "sun")) + ")"
SQL["validate_hours"] = ROLES_SQL + f"""
SELECT id, id_restaurant, {_BAD_DAYS} = '' AS valid, {_BAD_DAYS} AS bad_days FROM hours
"""

# -- views and lookups --------------------------------------------------------

SQL["comments_list"] = ROLES_SQL + """
SELECT c.id, c.comment, u.username AS up_by, c.score, rc.id_restaurant AS res_id, c.verified
FROM comments c JOIN restaurant_comments rc ON c.id = rc.id_comment
LEFT JOIN users u ON u.id = c.updated_by
"""

SQL["dishes_info"] = ROLES_SQL + """
SELECT d.id, d.name, d.calories, d.price, d.weight,
       string_agg(i.name, ',' ORDER BY i.name) AS ingredient_names, m.id_restaurant AS res_id
FROM dishes d JOIN menu m ON m.id_dish = d.id
JOIN dish_ingredients di ON d.id = di.id_dish
JOIN ingredients i ON di.id_ingredient = i.id
GROUP BY d.id, d.name, d.calories, d.price, d.weight, m.id_restaurant
"""

SQL["ingredients_list"] = ROLES_SQL + """
SELECT i.id, i.name, i.vegetarian, i.vegan, di.id_dish AS dish_id,
       COALESCE(string_agg(a.name, ', ' ORDER BY a.name), 'None') AS allergens_list
FROM ingredients i JOIN dish_ingredients di ON di.id_ingredient = i.id
LEFT JOIN ingredient_allergens ia ON ia.id_ingredient = i.id
LEFT JOIN allergens a ON a.id = ia.id_allergen
GROUP BY i.id, i.name, i.vegetarian, i.vegan, di.id_dish
"""

SQL["venue_details"] = ROLES_SQL + """
SELECT r.name, r.opinion, co.lat, co.lon, r.address,
       string_agg(c.type, ',' ORDER BY c.type) AS res_cuisines,
       cl.username AS up_by, ad.username AS ver_by, r.id AS res_id
FROM restaurants r JOIN restaurant_cuisines rc ON r.id = rc.id_restaurant
JOIN coordinates co ON r.id = co.id
JOIN cuisines c ON c.id = rc.id_cuisine
LEFT JOIN users cl ON cl.id = r.updated_by
LEFT JOIN users ad ON ad.id = r.verified_by
GROUP BY r.id, r.name, r.opinion, co.lat, co.lon, r.address, cl.username, ad.username
"""

_VIEW_REQ = "(SELECT user_id FROM events WHERE event_type = 'view' AND user_id > 0)"
_DISH_REQ = ("(SELECT event_id // 5 FROM events "
             "WHERE event_type = 'click' AND event_id // 5 > 0)")
SQL["venue_info_lookup"] = (SQL["venue_details"].replace("GROUP BY r.id,", f"WHERE r.id IN {_VIEW_REQ}\nGROUP BY r.id,"))
SQL["comments_for_venue"] = SQL["comments_list"] + f"WHERE c.verified AND rc.id_restaurant IN {_VIEW_REQ}\n"
SQL["dishes_for_venue"] = SQL["dishes_info"].replace(
    "GROUP BY d.id,", f"WHERE m.id_restaurant IN {_VIEW_REQ}\nGROUP BY d.id,")
SQL["ingredients_for_dish"] = SQL["ingredients_list"].replace(
    "GROUP BY i.id,", f"WHERE di.id_dish IN {_DISH_REQ}\nGROUP BY i.id,")
SQL["tag_list"] = ROLES_SQL + "SELECT type FROM cuisines\n"

SQL["radius_join_many"] = ROLES_SQL + """
, probes AS (
  SELECT c_custkey AS probe_id, 51.0515e0 + ((c_custkey * 17) % 1000) * 1.3035e-4 AS lat,
         16.924e0 + ((c_custkey * 23) % 1000) * 2.3605e-4 AS lon FROM customer)
, pairs AS (
  SELECT p.probe_id, co.id AS res_id,
         6371e0 * acos(least(1e0, greatest(-1e0, cos(radians(p.lat)) * cos(radians(co.lat)) *
           cos(radians(co.lon) - radians(p.lon)) + sin(radians(p.lat)) * sin(radians(co.lat))))) AS d
  -- a band join on latitude / longitude (every pair within 0.5 km lies inside
  -- the band: 0.0045 deg of latitude, 0.009 deg of longitude above cos(lat) = 0.5),
  -- then the exact distance: a different method from the library's grid cells
  FROM probes p JOIN coordinates co
    ON co.lat BETWEEN p.lat - 0.0045 AND p.lat + 0.0045
   AND co.lon BETWEEN p.lon - 0.009 AND p.lon + 0.009
  WHERE co.lat > 0 AND co.lon > 0)
SELECT probe_id, res_id, round(d, 6) AS distance_km FROM pairs WHERE d <= 0.5
"""

# -- reports --------------------------------------------------------------------

_VENUES_CUISINES = ROLES_SQL + """
SELECT r.id AS res_id, r.name AS res_name, r.opinion AS res_score,
       string_agg(c.type, ',' ORDER BY c.type) AS res_cuisines, r.address AS res_address,
       r.verified AS res_ver{user}
FROM restaurants r JOIN restaurant_cuisines rc ON r.id = rc.id_restaurant
JOIN cuisines c ON c.id = rc.id_cuisine
{where}
GROUP BY r.id, r.name, r.opinion, r.address, r.verified, r.updated_by
"""
SQL["user_venues"] = _VENUES_CUISINES.format(user=", r.updated_by AS user_id", where="")
SQL["queue_venues"] = _VENUES_CUISINES.format(user="", where="WHERE NOT r.verified AND NOT r.deleted")

_NESTED = ROLES_SQL + """
, entries AS (
  SELECT di.id_dish, i.id AS ing_id, i.name AS ing_name,
         string_agg(DISTINCT a.name, ',' ORDER BY a.name) AS allergens_names
  FROM dish_ingredients di JOIN ingredients i ON di.id_ingredient = i.id
  JOIN ingredient_allergens ia ON ia.id_ingredient = i.id
  JOIN allergens a ON ia.id_allergen = a.id
  WHERE a.id > 0
  GROUP BY di.id_dish, i.id, i.name)
, per_dish AS (
  SELECT id_dish, string_agg(CAST(ing_id AS VARCHAR) || ':' || ing_name || ':' || allergens_names, ';'
                             ORDER BY ing_id) AS ing
  FROM entries GROUP BY id_dish)
SELECT r.id AS res_id, r.name AS res_name, d.id AS dish_id, d.name AS dish_name,
       m.verified AS dish_ver{user}, COALESCE(pd.ing, '') AS ing
FROM restaurants r JOIN menu m ON m.id_restaurant = r.id
JOIN dishes d ON m.id_dish = d.id
LEFT JOIN per_dish pd ON pd.id_dish = d.id
{where}
"""
SQL["user_dishes_nested"] = _NESTED.format(user=", m.updated_by AS user_id", where="")
SQL["queue_dishes_nested"] = _NESTED.format(user="", where="WHERE NOT m.verified AND NOT m.deleted")

SQL["user_locations"] = ROLES_SQL + """
SELECT id AS res_id, lat, lon, pending_lat AS new_lat, pending_lon AS new_lon, verified AS ver,
       edited_by AS user_id
FROM coordinates WHERE NOT (pending_lat = 0 AND pending_lon = 0)
"""
SQL["queue_locations"] = ROLES_SQL + """
SELECT id AS res_id, lat, lon, pending_lat AS new_lat, pending_lon AS new_lon, verified AS ver,
       updated_by AS up_by, edited_by AS ed_by
FROM coordinates WHERE NOT verified AND NOT (pending_lat = 0 AND pending_lon = 0)
"""

_COMMENTS_VENUE = ROLES_SQL + """
SELECT c.id AS c_id, r.id AS res_id, r.name AS res_name, c.score, c.comment AS "desc",
       c.verified AS ver{user}
FROM comments c JOIN restaurant_comments rc ON rc.id_comment = c.id
JOIN restaurants r ON rc.id_restaurant = r.id
{where}
"""
SQL["user_comments"] = _COMMENTS_VENUE.format(user=", c.updated_by AS user_id", where="")
SQL["queue_comments"] = _COMMENTS_VENUE.format(user=", c.updated_by AS user_id",
                                               where="WHERE NOT c.verified AND NOT c.deleted").replace(
    ", c.updated_by AS user_id", "")

_HOURS_VENUE = ROLES_SQL + """
, sp AS (
  SELECT id_restaurant, '{{' || string_agg('"' || day_key || '":"' || value || '"', ',' ORDER BY day_key) || '}}' AS special
  FROM special_days GROUP BY id_restaurant)
SELECT h.id AS hours_id, r.id AS res_id, r.name AS res_name, h.mon, h.tue, h.wed, h.thu, h.fri,
       h.sat, h.sun, sp.special, h.updated_by AS user_id, h.verified_by, h.verified, h.deleted,
       r.verified AS res_verified, r.deleted AS res_deleted
FROM hours h JOIN restaurants r ON r.id = h.id_restaurant
LEFT JOIN sp ON sp.id_restaurant = h.id_restaurant
WHERE {where}
"""
SQL["user_hours"] = _HOURS_VENUE.format(where="NOT h.deleted")
SQL["queue_hours"] = _HOURS_VENUE.format(where="NOT h.verified AND NOT h.deleted")

# -- moderation folds (window formulations) ------------------------------------------

_ADMIN = "actor IN (SELECT id FROM users WHERE is_admin)"
_KNOWN = "actor IN (SELECT id FROM users)"

SQL["role_gate"] = ROLES_SQL + f"""
SELECT event_id, key, action, actor FROM commands
WHERE (action IN ('VER', 'DEL') AND {_ADMIN}) OR (action NOT IN ('VER', 'DEL') AND {_KNOWN})
"""

_FLAG_CTES = f"""
, gated AS (SELECT * FROM {{cmds}} WHERE action IN ('VER', 'DEL') AND {{pos}} AND {_ADMIN})
, agg AS (SELECT {{keys}}, bool_or(action = 'VER') AS any_ver, bool_or(action = 'DEL') AS any_del
          FROM gated GROUP BY {{keys}})
, lastc AS (SELECT {{keys}}, actor FROM gated
            QUALIFY row_number() OVER (PARTITION BY {{keys}} ORDER BY ts DESC, event_id DESC) = 1)
"""

SQL["moderate_flags"] = ROLES_SQL + _FLAG_CTES.format(cmds="commands", pos="key > 0", keys="key") + """
SELECT r.id, r.name, r.opinion, r.verified OR COALESCE(a.any_ver, FALSE) AS verified, r.address,
       r.updated_by, COALESCE(l.actor, r.verified_by) AS verified_by,
       r.deleted OR COALESCE(a.any_del, FALSE) AS deleted
FROM restaurants r LEFT JOIN agg a ON a.key = r.id LEFT JOIN lastc l ON l.key = r.id
"""

_MENU_CMDS = """
, mcmds AS (SELECT event_id, ts, l_suppkey AS id_restaurant, l_partkey AS id_dish, action, actor
            FROM commands JOIN (SELECT * FROM lineitem QUALIFY row_number() OVER (
                                  PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) = 1) ON l_orderkey = event_id
            WHERE action IN ('VER', 'DEL'))
"""
_NEW_MENU = ROLES_SQL + _MENU_CMDS + _FLAG_CTES.format(
    cmds="mcmds", pos="id_restaurant > 0 AND id_dish > 0", keys="id_restaurant, id_dish") + """
, new_menu AS (
  SELECT m.id_restaurant, m.id_dish, m.verified OR COALESCE(a.any_ver, FALSE) AS verified, m.updated_by,
         COALESCE(l.actor, m.verified_by) AS verified_by, m.deleted OR COALESCE(a.any_del, FALSE) AS deleted,
         a.id_restaurant IS NOT NULL AS touched
  FROM menu m LEFT JOIN agg a ON a.id_restaurant = m.id_restaurant AND a.id_dish = m.id_dish
  LEFT JOIN lastc l ON l.id_restaurant = m.id_restaurant AND l.id_dish = m.id_dish)
"""
SQL["moderate_menu"] = _NEW_MENU + """
SELECT id_restaurant, id_dish, verified, updated_by, verified_by, deleted FROM new_menu
"""

_DIET = """
SELECT d.id,
  {veg_pre}NOT EXISTS (SELECT 1 FROM dish_ingredients di JOIN ingredients i ON di.id_ingredient = i.id
                 JOIN {menu} rd ON rd.id_dish = di.id_dish
                 WHERE di.id_dish = d.id AND NOT i.vegetarian AND rd.verified){veg_post} AS vegetarian,
  {vgn_pre}NOT EXISTS (SELECT 1 FROM dish_ingredients di JOIN ingredients i ON di.id_ingredient = i.id
                 JOIN {menu} rd ON rd.id_dish = di.id_dish
                 WHERE di.id_dish = d.id AND NOT i.vegan AND rd.verified){vgn_post} AS vegan
FROM dishes d
"""
SQL["derive_diet_flags"] = ROLES_SQL + _DIET.format(menu="menu", veg_pre="", veg_post="", vgn_pre="", vgn_post="")
_TOUCHED = "d.id IN (SELECT id_dish FROM new_menu WHERE touched)"
SQL["moderate_menu_diet"] = _NEW_MENU + _DIET.format(
    menu="new_menu", veg_pre=f"CASE WHEN {_TOUCHED} THEN ", veg_post=" ELSE d.vegetarian END",
    vgn_pre=f"CASE WHEN {_TOUCHED} THEN ", vgn_post=" ELSE d.vegan END")

SQL["moderate_locations"] = ROLES_SQL + f"""
, lc AS (
  SELECT event_id, ts, key, action, actor,
         CASE WHEN action = 'UPDATE' AND value >= 1 THEN 51e0 + value / 10000e0 ELSE 0e0 END AS p_lat,
         CASE WHEN action = 'UPDATE' AND value >= 1 THEN 17e0 + value / 10000e0 ELSE 0e0 END AS p_lon
  FROM commands
  WHERE (action = 'UPDATE' AND {_KNOWN} AND key IN (SELECT id FROM restaurants))
     OR (action IN ('VER', 'DEL') AND {_ADMIN} AND key > 0))
, seq AS (
  SELECT lc.*, lag(action) OVER w AS prev_action, lag(p_lat) OVER w AS prev_lat,
         lag(p_lon) OVER w AS prev_lon, lag(actor) OVER w AS prev_actor
  FROM lc WINDOW w AS (PARTITION BY key ORDER BY ts, event_id))
, eff AS (
  SELECT s.*, (s.action = 'VER' AND (s.prev_action IN ('UPDATE', 'DEL')
               OR (s.prev_action IS NULL AND NOT c.verified))) AS is_eff,
         c.pending_lat AS s_pending_lat, c.pending_lon AS s_pending_lon, c.edited_by AS s_edited_by
  FROM seq s JOIN coordinates c ON c.id = s.key)
, last_cmd AS (SELECT * FROM eff QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) = 1)
, last_change AS (
  SELECT * FROM eff WHERE action IN ('UPDATE', 'DEL') OR is_eff
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) = 1)
, last_eff AS (
  SELECT *,
    CASE WHEN prev_action = 'UPDATE' THEN prev_lat WHEN prev_action = 'DEL' THEN 0e0 ELSE s_pending_lat END AS new_lat,
    CASE WHEN prev_action = 'UPDATE' THEN prev_lon WHEN prev_action = 'DEL' THEN 0e0 ELSE s_pending_lon END AS new_lon,
    CASE WHEN prev_action = 'UPDATE' THEN prev_actor WHEN prev_action = 'DEL' THEN 0 ELSE s_edited_by END AS new_up
  FROM eff WHERE is_eff
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) = 1)
, last_vby AS (
  SELECT key, actor FROM eff WHERE action = 'DEL' OR is_eff
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) = 1)
SELECT c.id,
  CASE WHEN lm.key IS NULL THEN c.verified ELSE lm.action = 'VER' END AS verified,
  COALESCE(le.new_lat, c.lat) AS lat, COALESCE(le.new_lon, c.lon) AS lon,
  CASE WHEN ch.key IS NULL THEN c.pending_lat WHEN ch.action = 'UPDATE' THEN ch.p_lat ELSE 0e0 END AS pending_lat,
  CASE WHEN ch.key IS NULL THEN c.pending_lon WHEN ch.action = 'UPDATE' THEN ch.p_lon ELSE 0e0 END AS pending_lon,
  CAST(COALESCE(le.new_up, c.updated_by) AS BIGINT) AS updated_by,
  CAST(COALESCE(vb.actor, c.verified_by) AS BIGINT) AS verified_by,
  CAST(CASE WHEN ch.key IS NULL THEN c.edited_by WHEN ch.action = 'UPDATE' THEN ch.actor ELSE 0 END AS BIGINT) AS edited_by
FROM coordinates c
LEFT JOIN last_cmd lm ON lm.key = c.id
LEFT JOIN last_change ch ON ch.key = c.id
LEFT JOIN last_eff le ON le.key = c.id
LEFT JOIN last_vby vb ON vb.key = c.id
"""

_WD = "['08:00-16:00','09:00-17:00','10:00-22:00','closed','9:00-17:00']"
_WE = "['closed','10:00-14:00','11:00-23:00','closed','12:00-18:00','22:00-02:00','99:99-00:00']"
_PROPOSALS = f"""
, props0 AS (
  SELECT event_id, ts, key, actor, CAST(floor(value) AS BIGINT) AS fv, CAST(ts AS DATE) + 7 AS pday
  FROM commands WHERE action = 'INSERT')
, props AS (
  SELECT event_id, ts, key, actor,
    {_WD}[(fv % 5) + 1] AS mon, {_WD}[(fv % 5) + 1] AS tue, {_WD}[(fv % 5) + 1] AS wed,
    {_WD}[(fv % 5) + 1] AS thu, {_WD}[(fv % 5) + 1] AS fri,
    {_WE}[(fv % 7) + 1] AS sat, {_WE}[((fv + 2) % 7) + 1] AS sun,
    CASE WHEN fv % 11 = 0 THEN strftime(pday, '%Y-%m-%d') ELSE strftime(pday, '%d.%m.%Y') END AS skey,
    CASE WHEN fv % 7 = 3 THEN 'noon' WHEN fv % 7 = 1 THEN 'closed' ELSE '10:00-12:00' END AS sval
  FROM props0)
, checked AS (
  SELECT *, '{{"' || skey || '":"' || sval || '"}}' AS special_text,
    CASE WHEN NOT ({" AND ".join(_VALID.format(d=d) for d in ("mon", "tue", "wed", "thu", "fri", "sat", "sun"))})
           THEN 'bad_day'
         WHEN NOT regexp_full_match(skey, '\\d{{2}}\\.\\d{{2}}\\.\\d{{4}}') THEN 'bad_date:' || skey
         WHEN NOT {_VALID.format(d="sval")} THEN 'bad_range:' || skey || ': ' || sval
    END AS reason
  FROM props)
"""

SQL["validate_special"] = ROLES_SQL + _PROPOSALS + """
SELECT event_id, special_text, reason IS NULL AS valid, reason FROM checked
"""

# The hours fold as a sequential walk: per venue, its valid proposals and
# gated VER/DEL commands in (ts, event_id) order, carrying the list of
# versions; VER acts only when its version is not deleted (then every other
# version is deleted), DEL only when it is not verified.  Commands name a
# version, or the venue's newest one at that time.  Independent of the
# library's chains of successors.
def _hours_walk(mods: str, target: str) -> str:
    return ROLES_SQL.replace("WITH", "WITH RECURSIVE", 1) + _PROPOSALS + f"""
, valid_props AS (
  SELECT * FROM checked WHERE reason IS NULL AND {_KNOWN} AND key IN (SELECT id FROM restaurants))
, mods AS ({mods})
, ev AS (
  SELECT key, ts, event_id, 'INSERT' AS action, actor, CAST(NULL AS BIGINT) AS version FROM valid_props
  UNION ALL SELECT key, ts, event_id, action, actor, version FROM mods)
, evn AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS rn FROM ev)
, base AS (
  SELECT id_restaurant AS key,
         list(struct_pack(id := id, verified := verified, deleted := deleted, vby := verified_by) ORDER BY id) AS st
  FROM hours GROUP BY 1)
, walk(key, rn, newest, st) AS (
  SELECT k.key, CAST(0 AS BIGINT), list_max(list_transform(b.st, lambda x: x.id)),
         COALESCE(b.st, CAST([] AS STRUCT(id BIGINT, verified BOOLEAN, deleted BOOLEAN, vby BIGINT)[]))
  FROM (SELECT DISTINCT key FROM evn) k LEFT JOIN base b ON b.key = k.key
  UNION ALL
  SELECT w.key, e.rn,
    CASE WHEN e.action = 'INSERT' THEN e.event_id + 2000000000000 ELSE w.newest END,
    CASE
      WHEN e.action = 'INSERT' THEN list_append(w.st, struct_pack(id := e.event_id + 2000000000000,
                                    verified := FALSE, deleted := FALSE, vby := CAST(0 AS BIGINT)))
      WHEN {target} IS NULL THEN w.st
      WHEN e.action = 'VER' AND NOT list_filter(w.st, lambda x: x.id = {target})[1].deleted THEN
        list_transform(w.st, lambda x: CASE WHEN x.id = {target}
          THEN struct_pack(id := x.id, verified := TRUE, deleted := x.deleted, vby := e.actor)
          ELSE struct_pack(id := x.id, verified := x.verified, deleted := TRUE, vby := x.vby) END)
      WHEN e.action = 'DEL' AND NOT list_filter(w.st, lambda x: x.id = {target})[1].verified THEN
        list_transform(w.st, lambda x: CASE WHEN x.id = {target}
          THEN struct_pack(id := x.id, verified := x.verified, deleted := TRUE, vby := e.actor)
          ELSE x END)
      ELSE w.st END
  FROM walk w JOIN evn e ON e.key = w.key AND e.rn = w.rn + 1)
, final AS (SELECT key, st FROM walk QUALIFY row_number() OVER (PARTITION BY key ORDER BY rn DESC) = 1)
, fate AS (SELECT v.id, v.verified, v.deleted, v.vby FROM (SELECT unnest(st) AS v FROM final))
, sp AS (
  SELECT id_restaurant, '{{' || string_agg('"' || day_key || '":"' || value || '"', ',' ORDER BY day_key) || '}}' AS special
  FROM special_days GROUP BY id_restaurant)
, allv AS (
  SELECT h.id, h.id_restaurant, h.mon, h.tue, h.wed, h.thu, h.fri, h.sat, h.sun, sp.special,
         h.updated_by, h.verified_by, h.verified, h.deleted
  FROM hours h LEFT JOIN sp ON sp.id_restaurant = h.id_restaurant
  UNION ALL
  SELECT p.event_id + 2000000000000, p.key, p.mon, p.tue, p.wed, p.thu, p.fri, p.sat, p.sun,
         p.special_text, p.actor, CAST(0 AS BIGINT), FALSE, FALSE
  FROM valid_props p)
SELECT a.id, a.id_restaurant, a.mon, a.tue, a.wed, a.thu, a.fri, a.sat, a.sun, a.special, a.updated_by,
       CAST(COALESCE(f.vby, a.verified_by) AS BIGINT) AS verified_by,
       COALESCE(f.verified, a.verified) AS verified, COALESCE(f.deleted, a.deleted) AS deleted
FROM allv a LEFT JOIN fate f ON f.id = a.id
"""


SQL["moderate_hours"] = _hours_walk(
    f"SELECT *, NULL AS version FROM commands WHERE action IN ('VER', 'DEL') AND key > 0 AND {_ADMIN}", "w.newest")
SQL["moderate_hours_by_id"] = _hours_walk(f"""
  SELECT v.key, c.ts, c.event_id, c.action, c.actor, c.version
  FROM (SELECT *, CASE CAST(floor(value) AS BIGINT) % 8 WHEN 0 THEN key WHEN 1 THEN key + 1000000000000
                  ELSE event_id + 2 - CAST(floor(value) AS BIGINT) % 9 + 2000000000000 END AS version
        FROM commands WHERE action IN ('VER', 'DEL') AND {_ADMIN}) c
  JOIN (SELECT id, id_restaurant AS key FROM hours
        UNION ALL SELECT event_id + 2000000000000, key FROM valid_props) v ON v.id = c.version
  WHERE c.version > 0""", "e.version")

SQL["upsert_comments"] = ROLES_SQL + f"""
, subs AS (
  SELECT event_id, ts, user_id AS res_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS actor,
         value / 100e0 AS score,
         ['Good,tasty.', 'very good', 'Great', ''][(CAST(floor(value) AS BIGINT) % 4) + 1] AS text
  FROM events WHERE event_type = 'purchase')
, ok AS (
  SELECT * FROM subs
  WHERE res_id <> 0 AND score > 0 AND score <= 5
    AND regexp_full_match(replace(replace(text, ',', ''), '.', ''), '[A-Za-z0-9]+')
    AND {_KNOWN} AND res_id IN (SELECT id FROM restaurants))
, lastsub AS (
  SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY res_id, actor ORDER BY ts DESC, event_id DESC) = 1)
, existing AS (
  SELECT rc.id_restaurant AS res_id, c.updated_by AS actor, max(c.id) AS old_id
  FROM comments c JOIN restaurant_comments rc ON rc.id_comment = c.id GROUP BY 1, 2)
, j AS (SELECT l.*, e.old_id FROM lastsub l LEFT JOIN existing e ON e.res_id = l.res_id AND e.actor = l.actor)
SELECT CAST(COALESCE(old_id, (SELECT max(id) FROM comments)
         + row_number() OVER (PARTITION BY old_id IS NULL ORDER BY res_id, actor)) AS BIGINT) AS id,
       res_id, text AS comment, score, FALSE AS verified, actor AS updated_by,
       CAST(0 AS BIGINT) AS verified_by, FALSE AS deleted, old_id IS NULL AS is_new
FROM j
"""

# -- ingestion ----------------------------------------------------------------------------

_PRIOS = "['URGENT','HIGH','MEDIUM','NOT SPECIFIED','LOW']"
_VENUE_SUBS = f"""
, subs AS (
  SELECT c_custkey AS sub_id, c_custkey AS actor,
         CASE WHEN c_acctbal < 0 THEN c_name ELSE replace(c_name, '#', '') END AS name,
         c_mktsegment || ' ' || CAST(c_nationkey AS VARCHAR) || ', ' ||
           CASE WHEN c_nationkey % 5 = 0 THEN 'Wro-claw' ELSE 'Wroclaw' END AS address,
         [{_PRIOS}[(c_custkey % 5) + 1], 'Unknown', lower({_PRIOS}[((c_custkey + 2) % 5) + 1])] AS cuisines
  FROM customer)
, checked AS (
  SELECT *, CASE WHEN NOT COALESCE(regexp_full_match(name, '[A-Za-z0-9]+'), FALSE) THEN 'invalid name'
                 WHEN NOT COALESCE(regexp_full_match(replace(replace(address, ',', ''), ' ', ''), '[A-Za-z0-9]+'), FALSE)
                   THEN 'invalid address' END AS reason
  FROM subs WHERE {_KNOWN})
, new_venues AS (
  SELECT CAST((SELECT max(id) FROM restaurants) + row_number() OVER (ORDER BY sub_id) AS BIGINT) AS id,
         name, 0e0 AS opinion, FALSE AS verified, address, actor AS updated_by,
         CAST(0 AS BIGINT) AS verified_by, FALSE AS deleted, sub_id, cuisines
  FROM checked WHERE reason IS NULL)
"""
SQL["ingest_venues"] = ROLES_SQL + _VENUE_SUBS + """
SELECT id, name, opinion, verified, address, updated_by, verified_by, deleted, sub_id FROM new_venues
"""
SQL["ingest_venue_links"] = ROLES_SQL + _VENUE_SUBS + """
SELECT v.id AS id_restaurant, c.id AS id_cuisine
FROM (SELECT id, unnest(cuisines) AS cuisine FROM new_venues) v JOIN cuisines c ON lower(strip_accents(c.type)) = lower(strip_accents(v.cuisine))
"""
SQL["ingest_venue_rejects"] = ROLES_SQL + _VENUE_SUBS + """
SELECT sub_id, reason FROM checked WHERE reason IS NOT NULL
"""
SQL["default_coordinates"] = ROLES_SQL + _VENUE_SUBS + """
SELECT id, FALSE AS verified, 0e0 AS lat, 0e0 AS lon, 0e0 AS pending_lat, 0e0 AS pending_lon,
       CAST(0 AS BIGINT) AS updated_by, CAST(0 AS BIGINT) AS verified_by, CAST(0 AS BIGINT) AS edited_by
FROM (SELECT id FROM restaurants UNION ALL SELECT id FROM new_venues) v
WHERE id NOT IN (SELECT id FROM coordinates)
"""
SQL["default_hours"] = ROLES_SQL + _VENUE_SUBS + """
, missing AS (
  SELECT id AS id_restaurant FROM (SELECT id FROM restaurants UNION ALL SELECT id FROM new_venues) v
  WHERE id NOT IN (SELECT id_restaurant FROM hours))
SELECT id_restaurant, 'closed' AS mon, 'closed' AS tue, 'closed' AS wed, 'closed' AS thu, 'closed' AS fri,
       'closed' AS sat, 'closed' AS sun, CAST(0 AS BIGINT) AS updated_by, CAST(0 AS BIGINT) AS verified_by,
       FALSE AS verified, FALSE AS deleted,
       CAST((SELECT max(id) FROM hours) + row_number() OVER (ORDER BY id_restaurant) AS BIGINT) AS id
FROM missing
"""

_DISH_REQS = f"""
, reqs AS (
  SELECT o_orderkey AS req_id, o_custkey AS actor, o_custkey // 15 AS res_id,
         CASE WHEN o_orderstatus = 'P' THEN 'bad-' || substr(o_orderpriority, 3)
              ELSE substr(o_orderpriority, 3) || ' plate' END AS name,
         CAST(CAST(floor(o_totalprice) AS BIGINT) % 900 AS DOUBLE) AS calories,
         CAST((CAST(floor(o_totalprice) AS BIGINT) % 900) % 300 AS DOUBLE) AS weight,
         CAST(CAST(floor(o_totalprice) AS BIGINT) % 1000 AS DOUBLE) AS price,
         o_orderkey // 30 AS ing_no,
         CASE WHEN o_orderkey % 2 = 0 THEN ['MEDIUM', 'Nut' || CAST(o_orderkey // 100 AS VARCHAR)]
              ELSE ['Medium', 'NUT' || CAST(o_orderkey // 100 AS VARCHAR)] END AS named
  FROM orders)
, okreq AS (
  SELECT * FROM reqs
  WHERE regexp_full_match(replace(name, ' ', ''), '[A-Za-z0-9]+') AND price > 0 AND calories > 0
    AND weight > 0 AND res_id IN (SELECT id FROM restaurants) AND {_KNOWN})
, new_dishes AS (
  SELECT CAST((SELECT max(id) FROM dishes) + row_number() OVER (ORDER BY req_id) AS BIGINT) AS id, * FROM okreq)
, ing_rows AS (
  SELECT req_id, id AS id_dish, 0 AS pos, 'ing' || CAST(ing_no AS VARCHAR) AS ing_name,
         named AS allergens FROM new_dishes
  UNION ALL
  SELECT req_id, id, 1, 'salt', CAST([] AS VARCHAR[]) FROM new_dishes)
, new_ings AS (
  SELECT CAST((SELECT max(id) FROM ingredients) + row_number() OVER (ORDER BY req_id, pos) AS BIGINT) AS id_ingredient, *
  FROM ing_rows)
, wanted AS (SELECT id_ingredient, allergen, lower(strip_accents(allergen)) AS low, apos
  FROM (SELECT id_ingredient, unnest(allergens) AS allergen, unnest(range(len(allergens))) AS apos FROM new_ings))
, new_allergens AS (
  SELECT CAST((SELECT max(id) FROM allergens) + row_number() OVER (ORDER BY allergen) AS BIGINT) AS id,
         allergen AS name
  FROM (SELECT allergen FROM wanted WHERE low NOT IN (SELECT lower(strip_accents(name)) FROM allergens)
        QUALIFY row_number() OVER (PARTITION BY low ORDER BY id_ingredient, apos) = 1))
, all_allergens AS (SELECT id, name FROM allergens UNION ALL SELECT id, name FROM new_allergens)
"""
SQL["ingest_dishes"] = ROLES_SQL + _DISH_REQS + """
SELECT id, name, CAST(calories AS INTEGER) AS calories, price, weight, TRUE AS vegetarian, FALSE AS vegan,
       res_id FROM new_dishes
"""
SQL["ingest_allergens"] = ROLES_SQL + _DISH_REQS + "SELECT id, name FROM new_allergens\n"
SQL["ingest_dish_links"] = ROLES_SQL + _DISH_REQS + """
SELECT n.id_dish, n.id_ingredient, n.ing_name, a.id AS id_allergen
FROM new_ings n LEFT JOIN wanted w ON w.id_ingredient = n.id_ingredient
LEFT JOIN all_allergens a ON lower(strip_accents(a.name)) = w.low
"""

# The in-batch rule as the reference applies it: one registration at a time,
# each taking its login and e-mail if both are still free.  Written as a
# recursive walk over the batch in (ts, reg_id) order carrying the taken sets:
# an independent formulation of the library's peeling rounds.
SQL["validate_users"] = ROLES_SQL.replace("WITH", "WITH RECURSIVE", 1) + """
, regs AS (
  SELECT event_id AS reg_id, ts, CAST(floor(value) AS BIGINT) AS fv, user_id,
         json_extract_string(props, '$.k') AS actor
  FROM events WHERE event_type = 'signup')
, regs2 AS (
  SELECT reg_id, ts, user_id, fv,
         CASE WHEN fv % 4 = 0 THEN 'User' || actor WHEN fv % 4 = 1 THEN 'u' || CAST(fv % 10 AS VARCHAR)
              ELSE CASE WHEN fv % 2 = 0 THEN 'guest' ELSE 'Guest' END || CAST(user_id AS VARCHAR) || 'v' || CAST(fv % 3 AS VARCHAR) END AS login
  FROM regs)
, regs3 AS (
  SELECT reg_id, ts, login,
         CASE WHEN fv % 5 = 0 THEN 'Guest' || CAST(user_id AS VARCHAR) || '@Example.com'
              ELSE lower(login) || '@mail.example.org' END AS email
  FROM regs2)
, r1 AS (
  SELECT *, CASE
      WHEN NOT regexp_full_match(email, '[a-z0-9._%+\\-]+@[a-z0-9.\\-]+\\.[a-z]{2,}') THEN 'bad email'
      WHEN NOT (regexp_full_match(login, '[A-Za-z0-9]+') AND length(login) BETWEEN 4 AND 20) THEN 'bad login'
      WHEN lower(login) IN (SELECT lower(login) FROM users) THEN 'login taken'
      WHEN lower(email) IN (SELECT lower(email) FROM users) THEN 'email taken' END AS reason0,
    row_number() OVER (ORDER BY ts, reg_id) AS rn
  FROM regs3)
, walk(rn, reg_id, reason, logins, emails) AS (
  SELECT 0, CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[])
  UNION ALL
  SELECT r.rn, r.reg_id,
         CASE WHEN r.reason0 IS NOT NULL THEN r.reason0
              WHEN list_contains(w.logins, lower(r.login)) OR list_contains(w.emails, r.email) THEN 'duplicate in batch'
         END,
         CASE WHEN r.reason0 IS NULL AND NOT list_contains(w.logins, lower(r.login))
                   AND NOT list_contains(w.emails, r.email) THEN list_append(w.logins, lower(r.login)) ELSE w.logins END,
         CASE WHEN r.reason0 IS NULL AND NOT list_contains(w.logins, lower(r.login))
                   AND NOT list_contains(w.emails, r.email) THEN list_append(w.emails, r.email) ELSE w.emails END
  FROM walk w JOIN r1 r ON r.rn = w.rn + 1)
SELECT r1.reg_id, r1.login, r1.email, w.reason IS NULL AS valid, w.reason
FROM walk w JOIN r1 ON r1.reg_id = w.reg_id
"""

# -- sources, sinks and dataset steps ---------------------------------------------------

SQL["text_lines"] = ROLES_SQL + "SELECT c_name AS value FROM customer\n"
SQL["address_format"] = ROLES_SQL + """
SELECT 'st. ' || c_mktsegment || ' ' || CAST(c_nationkey AS VARCHAR) || ', Wroclaw, 50-' ||
       lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') AS address
FROM customer
"""
SQL["json_array_roundtrip"] = ROLES_SQL + "SELECT id, name, calories, price, weight FROM dishes\n"
SQL["wkb_decode"] = ROLES_SQL + "SELECT id, lat, lon FROM coordinates\n"
SQL["distinct_sample"] = ROLES_SQL + """
SELECT name FROM (SELECT DISTINCT name FROM dishes) ORDER BY md5(name), name LIMIT 20
"""
SQL["name_product_sample"] = ROLES_SQL + """
, a AS (SELECT w AS a, row_number() OVER (ORDER BY w) - 1 AS ia
        FROM (SELECT DISTINCT split_part(p_name, ' ', 1) AS w FROM part))
, b AS (SELECT w AS b, row_number() OVER (ORDER BY w) - 1 AS ib
        FROM (SELECT DISTINCT split_part(p_name, ' ', 2) AS w FROM part))
, sizes AS (SELECT (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM b) AS nb)
, stride AS (
  SELECT min(s) AS s FROM sizes, range(CAST(floor(0.6180339887 * na * nb) AS BIGINT), na * nb + 1) t(s)
  WHERE s >= 1 AND gcd(s, na * nb) = 1)
, picks AS (
  SELECT (j * stride.s) % (na * nb) AS k, nb
  FROM sizes, stride, range(least(20, (SELECT na * nb FROM sizes))) t(j))
SELECT a.a || ' ' || b.b AS name
FROM picks JOIN a ON a.ia = picks.k // picks.nb JOIN b ON b.ib = picks.k % picks.nb
"""

SQL["distinct_pairs"] = ROLES_SQL + "SELECT DISTINCT id_ingredient, id_dish FROM dish_ingredients\n"
SQL["derived_measure"] = ROLES_SQL + "SELECT id, calories, round(calories / 5e0, 2) AS weight FROM dishes\n"

# -- streams: same answers as the batch forms ------------------------------------------------

SQL["stream_flags"] = SQL["moderate_flags"]
SQL["stream_snapshot"] = SQL["moderate_locations"]
SQL["stream_dedup"] = ROLES_SQL + "SELECT event_id, key, action FROM commands\n"

SQL["moderate_comments"] = ROLES_SQL + """
, ccmds AS (SELECT event_id, ts, event_id * 3 // 2 AS key, action, actor
            FROM commands WHERE action IN ('VER', 'DEL'))
""" + _FLAG_CTES.format(cmds="ccmds", pos="key > 0", keys="key") + """
SELECT c.id, c.comment, c.score, c.verified OR COALESCE(a.any_ver, FALSE) AS verified, c.updated_by,
       COALESCE(l.actor, c.verified_by) AS verified_by, c.deleted OR COALESCE(a.any_del, FALSE) AS deleted
FROM comments c LEFT JOIN agg a ON a.key = c.id LEFT JOIN lastc l ON l.key = c.id
"""

SQL["stream_comments"] = SQL["moderate_comments"]
SQL["stream_menu"] = SQL["moderate_menu"]
SQL["stream_hours"] = SQL["moderate_hours_by_id"]
SQL["stream_upsert_comments"] = SQL["upsert_comments"]
SQL["stream_diet_flags"] = SQL["moderate_menu_diet"]
SQL["json_array_whole_file"] = SQL["json_array_roundtrip"]

SQL["search_terms_batch"] = ROLES_SQL + """
, words AS (SELECT n_name AS w FROM nation UNION ALL SELECT r_name FROM region)
, terms AS (
  SELECT DISTINCT term FROM (
    SELECT unnest([w[1:1], w[2:3], w[1:3], w[3:6], w[2:6]]) AS term FROM words) WHERE length(term) > 0)
SELECT t.term, d.id FROM terms t JOIN dishes d ON contains(lower(d.name), lower(t.term))
"""
SQL["search_by_radius_layout"] = SQL["search_by_radius"]

SQL["search_by_dish_top"] = f"""
SELECT *, CAST(row_number() OVER (ORDER BY sort_score DESC, res_id) AS INTEGER) AS place
FROM ({SQL["search_by_dish"]}) ORDER BY sort_score DESC, res_id LIMIT 10
"""
SQL["search_by_radius_top"] = f"""
SELECT *, CAST(row_number() OVER (ORDER BY distance_km, res_id) AS INTEGER) AS place
FROM ({SQL["search_by_radius"]}) ORDER BY distance_km, res_id LIMIT 7
"""
SQL["advanced_search_swapped"] = _advanced("co.lat > 0 AND co.lon > 0",
                                           radius=dist(17.03, 51.1, "co.lon", "co.lat"), open_secs=12 * 3600)
SQL["json_rows"] = ROLES_SQL + "SELECT CAST(json_object('id', id, 'name', name) AS VARCHAR) AS json FROM dishes\n"
