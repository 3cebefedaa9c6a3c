"""The role binding of :mod:`platewise.sources.roles` written as plain SQL.

Used only by the independent DuckDB oracle: every registered query has a SQL
twin that starts from these views, written in the naive form the reference
uses (full join product, window functions, correlated logic), so that our
Spark plans are checked against a different formulation.
"""

ROLES_SQL = r"""
WITH
restaurants AS (
  SELECT s_suppkey AS id, s_name AS name, 0.0::DOUBLE AS opinion, s_acctbal >= 0 AS verified,
         'st. Market ' || CAST(s_nationkey AS VARCHAR) AS address, s_suppkey % 100 AS updated_by,
         CAST(CASE WHEN s_acctbal >= 0 THEN (s_nationkey % 10) * 10 ELSE 0 END AS BIGINT) AS verified_by,
         s_suppkey % 50 = 0 AS deleted
  FROM supplier),
cuisines AS (
  SELECT CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS id, substr(o_orderpriority, 3) AS type
  FROM (SELECT DISTINCT o_orderpriority FROM orders)),
rc_pairs AS (
  SELECT DISTINCT l_suppkey AS id_restaurant, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS id_cuisine
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  WHERE (l_suppkey + length(o_orderpriority)) % 3 <> 0),
restaurant_cuisines AS (
  SELECT * FROM rc_pairs
  UNION ALL
  SELECT * FROM rc_pairs WHERE id_restaurant % 7 = 0 AND id_cuisine = 5),
dishes AS (
  SELECT p_partkey AS id, p_name AS name, p_size AS calories, p_retailprice AS price,
         round(p_size / 5e0, 2) AS weight, p_size % 2 = 0 AS vegetarian, p_size % 4 = 0 AS vegan
  FROM part),
menu AS (
  SELECT l_suppkey AS id_restaurant, l_partkey AS id_dish, l_linestatus = 'F' AS verified,
         l_orderkey % 100 AS updated_by,
         CAST(CASE WHEN l_linestatus = 'F' THEN (l_linenumber % 10) * 10 ELSE 0 END AS BIGINT) AS verified_by,
         l_returnflag = 'R' AS deleted
  FROM lineitem),
part_words AS (
  SELECT p_partkey, p_type, unnest(string_split(p_name, ' ')) AS word,
         unnest(range(len(string_split(p_name, ' ')))) AS pos
  FROM part),
ingredients AS (
  SELECT min(p_partkey * 8 + pos) AS id, word AS name, length(word) % 2 = 1 AS vegetarian,
         length(word) = 3 AS vegan
  FROM part_words GROUP BY word),
dish_ingredients AS (
  SELECT i.id AS id_ingredient, w.p_partkey AS id_dish
  FROM part_words w JOIN ingredients i ON w.word = i.name),
allergens AS (
  SELECT min(p_partkey) AS id, p_type AS name FROM part GROUP BY p_type),
ingredient_allergens AS (
  SELECT a.id AS id_allergen, i.id AS id_ingredient
  FROM (SELECT DISTINCT word, p_type FROM part_words
        WHERE (length(word) + length(p_type)) % 4 = 0 AND length(word) <> 4) w
  JOIN ingredients i ON i.name = w.word
  JOIN allergens a ON a.name = w.p_type),
users AS (
  SELECT c_custkey AS id, 'user' || CAST(c_custkey AS VARCHAR) AS login,
         'user' || CAST(c_custkey AS VARCHAR) || '@example.com' AS email,
         c_name AS username, c_custkey % 10 = 0 AS is_admin
  FROM customer),
comments AS (
  SELECT o_orderkey AS id, o_orderpriority AS comment, o_totalprice / 100000e0 AS score,
         o_orderstatus = 'F' AS verified, o_custkey AS updated_by,
         CAST(CASE WHEN o_orderstatus = 'F' THEN 10 ELSE 0 END AS BIGINT) AS verified_by,
         o_orderstatus = 'P' AS deleted
  FROM orders),
restaurant_comments AS (
  SELECT DISTINCT l_suppkey AS id_restaurant, l_orderkey AS id_comment FROM lineitem),
coordinates AS (
  SELECT s_suppkey AS id, s_suppkey % 4 <> 1 AS verified,
         CASE WHEN s_suppkey % 3 = 0 THEN 0e0 ELSE 51.0515e0 + ((s_suppkey * 37) % 1000) * 1.3035e-4 END AS lat,
         CASE WHEN s_suppkey % 3 = 0 THEN 0e0 ELSE 16.924e0 + ((s_suppkey * 91) % 1000) * 2.3605e-4 END AS lon,
         CASE WHEN s_suppkey % 5 = 0 THEN 51.0515e0 + ((s_suppkey * 53) % 1000) * 1.3035e-4 ELSE 0e0 END AS pending_lat,
         CASE WHEN s_suppkey % 5 = 0 THEN 16.924e0 + ((s_suppkey * 29) % 1000) * 2.3605e-4 ELSE 0e0 END AS pending_lon,
         s_suppkey % 100 AS updated_by,
         CAST(CASE WHEN s_suppkey % 4 <> 1 THEN 10 ELSE 0 END AS BIGINT) AS verified_by,
         CAST(CASE WHEN s_suppkey % 5 = 0 THEN (s_suppkey * 3) % 100 ELSE 0 END AS BIGINT) AS edited_by
  FROM supplier),
special_days AS (
  SELECT user_id AS id_restaurant, strftime(ts, '%d.%m.%Y') AS day_key,
         CASE WHEN bool_or(event_type = 'error') THEN 'closed' ELSE '11:00-15:00' END AS value
  FROM events WHERE event_type IN ('error', 'purchase') GROUP BY 1, 2),
hours_versions AS (
  SELECT s_suppkey AS k, 0 AS shift, s_suppkey AS id, s_suppkey % 4 <> 3 AS verified,
         s_suppkey % 13 = 0 AS deleted FROM supplier
  UNION ALL
  SELECT s_suppkey, 1, s_suppkey + 1000000000000, TRUE, FALSE FROM supplier WHERE s_suppkey % 6 = 0),
hours AS (
  SELECT id, k AS id_restaurant,
    ['08:00-16:00','09:00-17:00','10:00-22:00','closed','9:00-17:00'][((k + shift) % 5) + 1] AS mon,
    ['08:00-16:00','09:00-17:00','10:00-22:00','closed','9:00-17:00'][((k + shift) % 5) + 1] AS tue,
    ['08:00-16:00','09:00-17:00','10:00-22:00','closed','9:00-17:00'][((k + shift) % 5) + 1] AS wed,
    ['08:00-16:00','09:00-17:00','10:00-22:00','closed','9:00-17:00'][((k + shift + 1) % 5) + 1] AS thu,
    ['08:00-16:00','09:00-17:00','10:00-22:00','closed','9:00-17:00'][((k + shift + 1) % 5) + 1] AS fri,
    ['closed','10:00-14:00','11:00-23:00','closed','12:00-18:00','22:00-02:00','99:99-00:00'][((k + shift) % 7) + 1] AS sat,
    ['closed','10:00-14:00','11:00-23:00','closed','12:00-18:00','22:00-02:00','99:99-00:00'][((k + shift + 3) % 7) + 1] AS sun,
    k % 100 AS updated_by, CAST(CASE WHEN verified THEN 20 ELSE 0 END AS BIGINT) AS verified_by,
    verified, deleted
  FROM hours_versions),
commands AS (
  SELECT event_id, ts, user_id AS key,
         CASE event_type WHEN 'purchase' THEN 'VER' WHEN 'error' THEN 'DEL'
                         WHEN 'signup' THEN 'UPDATE' WHEN 'click' THEN 'INSERT' END AS action,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS actor, value
  FROM events WHERE event_type <> 'view')
"""
