"""Bind the driver's TPC-H-like tables to the catalogue roles.

Every role is a lazy DataFrame derived from the parquet tables, so the work
of each query grows with the data.  The binding (fixed values below) is
mirrored one to one by the SQL views in :mod:`platewise.plans.oracle`.

| role                 | bound to                                                     |
|----------------------|--------------------------------------------------------------|
| restaurants          | supplier                                                     |
| cuisines             | distinct ``o_orderpriority``                                 |
| restaurant_cuisines  | lineitem ⋈ orders, filtered (2, 3 or 5 tags per venue)       |
| dishes               | part                                                         |
| menu                 | lineitem (duplicated pairs are natural)                      |
| ingredients          | words of ``p_name``                                          |
| allergens            | distinct ``p_type``                                          |
| users                | customer                                                     |
| comments             | orders, linked to venues via distinct (l_suppkey, l_orderkey)|
| coordinates, hours   | rules on ``s_suppkey``; dated exceptions from ``events``     |
| command log          | events                                                       |
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.catalog import Catalog, LazyCatalog
from platewise.operators.moderation import VERSION_ID_OFFSET

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

# Fixed values of the role binding (shared with the SQL oracle).
LAT0, LAT_STEP, LAT_MUL = 51.0515, 0.00013035, 37
LON0, LON_STEP, LON_MUL = 16.924, 0.00023605, 91
PENDING_LAT_MUL, PENDING_LON_MUL = 53, 29
WEEKDAY_TEXT = ["08:00-16:00", "09:00-17:00", "10:00-22:00", "closed", "9:00-17:00"]
WEEKEND_TEXT = ["closed", "10:00-14:00", "11:00-23:00", "closed", "12:00-18:00",
                "22:00-02:00", "99:99-00:00"]
SPECIAL_OPEN_TEXT = "11:00-15:00"
SECOND_VERSION_OFFSET = 1_000_000_000_000
ACTIONS = {"purchase": "VER", "error": "DEL", "signup": "UPDATE", "click": "INSERT"}


_TABLES: dict[tuple, dict[str, DataFrame]] = {}
_CATALOGS: dict[tuple, "LazyCatalog"] = {}


def _key(spark: SparkSession, sf_dir: str) -> tuple:
    # one entry per running Spark application and data folder (the files are read-only)
    return spark.sparkContext.applicationId, id(spark), sf_dir


def read_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Table handles, opened once per application and folder: listing the
    files and reading the parquet footers is driver work worth doing once.
    DataFrames are immutable; every query still reads and computes in full."""
    k = _key(spark, sf_dir)
    if k not in _TABLES:
        _TABLES[k] = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}
    return _TABLES[k]


def _pick(values: list[str], idx) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx % len(values)).cast("int") + 1)


def restaurants(t: dict[str, DataFrame]) -> DataFrame:
    s = t["supplier"]
    k = F.col("s_suppkey")
    verified = F.col("s_acctbal") >= 0
    return s.select(
        k.alias("id"),
        F.col("s_name").alias("name"),
        F.lit(0.0).alias("opinion"),
        verified.alias("verified"),
        F.concat(F.lit("st. Market "), F.col("s_nationkey").cast("string")).alias("address"),
        (k % 100).alias("updated_by"),
        F.when(verified, (F.col("s_nationkey") % 10) * 10).otherwise(0).cast("long").alias("verified_by"),
        (k % 50 == 0).alias("deleted"),
    )


def cuisines(t: dict[str, DataFrame]) -> DataFrame:
    p = F.col("o_orderpriority")
    return (t["orders"].select(p).distinct()
            .select(F.substring(p, 1, 1).cast("long").alias("id"),
                    F.substring(p, 3, 100).alias("type")))


def restaurant_cuisines(t: dict[str, DataFrame]) -> DataFrame:
    l = t["lineitem"].select("l_orderkey", "l_suppkey")
    o = t["orders"].select("o_orderkey", "o_orderpriority")
    pairs = (l.join(o, l.l_orderkey == o.o_orderkey)
             .where((F.col("l_suppkey") + F.length("o_orderpriority")) % 3 != 0)
             .select(F.col("l_suppkey").alias("id_restaurant"),
                     F.substring("o_orderpriority", 1, 1).cast("long").alias("id_cuisine"))
             .distinct())
    # one duplicated link per 7th venue, as the reference's link tables have;
    # generated in the same pass (no second scan)
    copies = F.when((F.col("id_restaurant") % 7 == 0) & (F.col("id_cuisine") == 5), 2).otherwise(1)
    return pairs.select("id_restaurant", "id_cuisine",
                        F.explode(F.array_repeat(F.lit(0), copies)).alias("_copy")).drop("_copy")


def dishes(t: dict[str, DataFrame]) -> DataFrame:
    return t["part"].select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.col("p_size").alias("calories"),
        F.col("p_retailprice").alias("price"),
        F.round(F.col("p_size") / 5.0, 2).alias("weight"),
        (F.col("p_size") % 2 == 0).alias("vegetarian"),
        (F.col("p_size") % 4 == 0).alias("vegan"),
    )


def menu(t: dict[str, DataFrame]) -> DataFrame:
    verified = F.col("l_linestatus") == "F"
    return t["lineitem"].select(
        F.col("l_suppkey").alias("id_restaurant"),
        F.col("l_partkey").alias("id_dish"),
        verified.alias("verified"),
        (F.col("l_orderkey") % 100).alias("updated_by"),
        F.when(verified, (F.col("l_linenumber") % 10) * 10).otherwise(0).cast("long").alias("verified_by"),
        (F.col("l_returnflag") == "R").alias("deleted"),
    )


def _part_words(t: dict[str, DataFrame]) -> DataFrame:
    return t["part"].select("p_partkey", "p_type",
                            F.posexplode(F.split("p_name", " ")).alias("pos", "word"))


def ingredients(t: dict[str, DataFrame]) -> DataFrame:
    w = _part_words(t)
    return (w.groupBy("word")
            .agg(F.min(F.col("p_partkey") * 8 + F.col("pos")).alias("id"))
            .select("id", F.col("word").alias("name"),
                    (F.length("word") % 2 == 1).alias("vegetarian"),
                    (F.length("word") == 3).alias("vegan")))


def dish_ingredients(t: dict[str, DataFrame]) -> DataFrame:
    w = _part_words(t).select("p_partkey", "word")
    ing = ingredients(t).select("id", "name")
    return (w.join(ing, w.word == ing.name)
            .select(F.col("id").alias("id_ingredient"), F.col("p_partkey").alias("id_dish")))


def allergens(t: dict[str, DataFrame]) -> DataFrame:
    return (t["part"].groupBy("p_type").agg(F.min("p_partkey").alias("id"))
            .select("id", F.col("p_type").alias("name")))


def ingredient_allergens(t: dict[str, DataFrame]) -> DataFrame:
    w = (_part_words(t)
         .where(((F.length("word") + F.length("p_type")) % 4 == 0) & (F.length("word") != 4))
         .select("word", "p_type").distinct())
    ing = ingredients(t).select(F.col("id").alias("id_ingredient"), F.col("name").alias("word"))
    alg = allergens(t).select(F.col("id").alias("id_allergen"), F.col("name").alias("p_type"))
    return w.join(ing, "word").join(alg, "p_type").select("id_allergen", "id_ingredient")


def users(t: dict[str, DataFrame]) -> DataFrame:
    k = F.col("c_custkey")
    return t["customer"].select(
        k.alias("id"),
        F.concat(F.lit("user"), k.cast("string")).alias("login"),
        F.concat(F.lit("user"), k.cast("string"), F.lit("@example.com")).alias("email"),
        F.col("c_name").alias("username"),
        (k % 10 == 0).alias("is_admin"),
    )


def comments(t: dict[str, DataFrame]) -> DataFrame:
    st = F.col("o_orderstatus")
    return t["orders"].select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("comment"),
        (F.col("o_totalprice") / 100000.0).alias("score"),
        (st == "F").alias("verified"),
        F.col("o_custkey").alias("updated_by"),
        F.when(st == "F", 10).otherwise(0).cast("long").alias("verified_by"),
        (st == "P").alias("deleted"),
    )


def restaurant_comments(t: dict[str, DataFrame]) -> DataFrame:
    return (t["lineitem"].select(F.col("l_suppkey").alias("id_restaurant"),
                                 F.col("l_orderkey").alias("id_comment")).distinct())


def coordinates(t: dict[str, DataFrame]) -> DataFrame:
    k = F.col("s_suppkey")
    unknown = k % 3 == 0
    pend = k % 5 == 0
    verified = k % 4 != 1
    return t["supplier"].select(
        k.alias("id"),
        verified.alias("verified"),
        F.when(unknown, 0.0).otherwise(LAT0 + ((k * LAT_MUL) % 1000) * LAT_STEP).alias("lat"),
        F.when(unknown, 0.0).otherwise(LON0 + ((k * LON_MUL) % 1000) * LON_STEP).alias("lon"),
        F.when(pend, LAT0 + ((k * PENDING_LAT_MUL) % 1000) * LAT_STEP).otherwise(0.0).alias("pending_lat"),
        F.when(pend, LON0 + ((k * PENDING_LON_MUL) % 1000) * LON_STEP).otherwise(0.0).alias("pending_lon"),
        (k % 100).alias("updated_by"),
        F.when(verified, 10).otherwise(0).cast("long").alias("verified_by"),
        F.when(pend, (k * 3) % 100).otherwise(0).cast("long").alias("edited_by"),
    )


def special_days(t: dict[str, DataFrame]) -> DataFrame:
    """(id_restaurant, day key, value) from dated events; pre-aggregated per day."""
    e = t["events"].where(F.col("event_type").isin("error", "purchase"))
    return (e.groupBy(F.col("user_id").alias("id_restaurant"),
                      F.date_format("ts", "dd.MM.yyyy").alias("day_key"))
            .agg(F.max(F.col("event_type") == "error").alias("closed"))
            .select("id_restaurant", "day_key",
                    F.when(F.col("closed"), "closed").otherwise(SPECIAL_OPEN_TEXT).alias("value")))


def hours(t: dict[str, DataFrame]) -> DataFrame:
    s = t["supplier"].select(F.col("s_suppkey").alias("k"))
    k = F.col("k")

    def version(df, shift, id_col, verified, deleted):
        return df.select(
            id_col.alias("id"), k.alias("id_restaurant"),
            *[_pick(WEEKDAY_TEXT, k + shift).alias(d) for d in ("mon", "tue", "wed")],
            *[_pick(WEEKDAY_TEXT, k + shift + 1).alias(d) for d in ("thu", "fri")],
            _pick(WEEKEND_TEXT, k + shift).alias("sat"),
            _pick(WEEKEND_TEXT, k + shift + 3).alias("sun"),
            (k % 100).alias("updated_by"),
            F.when(verified, 20).otherwise(0).cast("long").alias("verified_by"),
            verified.alias("verified"), deleted.alias("deleted"))

    base = version(s, 0, k, k % 4 != 3, k % 13 == 0)
    second = version(s.where(k % 6 == 0), 1, k + SECOND_VERSION_OFFSET, F.lit(True), F.lit(False))
    versions = base.unionByName(second)
    # dated exceptions: at most one entry per (venue, day), so the map per
    # venue is bounded by the number of distinct days
    sp = (special_days(t).groupBy("id_restaurant")
          .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("day_key", "value"))))
               .alias("special")))
    cols = ["id", "id_restaurant", "mon", "tue", "wed", "thu", "fri", "sat", "sun",
            "special", "updated_by", "verified_by", "verified", "deleted"]
    return versions.join(sp, "id_restaurant", "left").select(*cols)


def view_requests(t: dict[str, DataFrame]) -> DataFrame:
    """Venue page requests: the venue id of every 'view' event."""
    return t["events"].where(F.col("event_type") == "view").select(F.col("user_id").alias("id"))


def dish_requests(t: dict[str, DataFrame]) -> DataFrame:
    """Dish page requests: a dish id derived from every 'click' event, over all dishes."""
    return (t["events"].where(F.col("event_type") == "click")
            .select(F.floor(F.col("event_id") / 5).cast("long").alias("id")))


def search_terms(t: dict[str, DataFrame]) -> DataFrame:
    """Search terms of one to five letters, cut from nation and region names."""
    names = t["nation"].select(F.col("n_name").alias("w")).union(t["region"].select("r_name"))
    return names.select(F.explode(F.array(*(F.substring("w", a, n) for a, n in ((1, 1), (2, 2), (1, 3), (3, 4), (2, 5))))).alias("term"))


def probe_points(t: dict[str, DataFrame]) -> DataFrame:
    """One search location per customer (for the many-probe radius join)."""
    c = F.col("c_custkey")
    return t["customer"].select(c.alias("probe_id"),
                                (LAT0 + ((c * 17) % 1000) * LAT_STEP).alias("lat"),
                                (LON0 + ((c * 23) % 1000) * LON_STEP).alias("lon"))


def commands(t: dict[str, DataFrame]) -> DataFrame:
    """The moderation command log: one row per non-'view' event."""
    e = t["events"]
    action = F.col("event_type")
    act = F.when(action == "purchase", "VER")
    for k, v in list(ACTIONS.items())[1:]:
        act = act.when(action == k, v)
    return (e.where(action != "view").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").alias("key"),
        act.alias("action"),
        F.get_json_object("props", "$.k").cast("long").alias("actor"),
        "value"))


def bind(spark: SparkSession, sf_dir: str) -> LazyCatalog:
    """The catalogue over the driver tables; each role is built on first use
    and the handles are kept per application and folder."""
    k = _key(spark, sf_dir)
    if k not in _CATALOGS:
        t = read_tables(spark, sf_dir)
        builders = {name: (lambda f=globals()[name]: f(t)) for name in Catalog.__dataclass_fields__}
        _CATALOGS[k] = LazyCatalog(builders)
    return _CATALOGS[k]


# Fixed values of the derived request payloads (shared with the SQL oracle).
PROPOSAL_BAD_VALUE, PROPOSAL_CLOSED_VALUE, PROPOSAL_OPEN_VALUE = "noon", "closed", "10:00-12:00"
COMMENT_TEXTS = ["Good,tasty.", "very good", "Great", ""]


def location_commands(t: dict[str, DataFrame]) -> DataFrame:
    """Location log: UPDATE proposes a point (a zero axis when value < 1),
    VER / DEL moderate it."""
    c = commands(t).where(F.col("action").isin("UPDATE", "VER", "DEL"))
    v = F.col("value")
    return c.select("event_id", "ts", "key", "action", "actor",
                    F.when(v < 1, F.lit(0.0)).otherwise(51.0 + v / 10000.0).alias("coord_x"),
                    (17.0 + v / 10000.0).alias("coord_y"))


def hours_proposals(t: dict[str, DataFrame]) -> DataFrame:
    """INSERT events as proposed weekly hours with a one-day special schedule
    (JSON text), some of them malformed on purpose."""
    c = commands(t).where(F.col("action") == "INSERT")
    fv = F.floor("value").cast("long")
    # the event's own (zone-less) date: TIMESTAMP -> TIMESTAMP_NTZ undoes the cast in commands()
    day = F.date_add(F.to_date(F.col("ts").cast("timestamp_ntz")), 7)
    key = F.when(fv % 11 == 0, F.date_format(day, "yyyy-MM-dd")).otherwise(F.date_format(day, "dd.MM.yyyy"))
    val = (F.when(fv % 7 == 3, F.lit(PROPOSAL_BAD_VALUE)).when(fv % 7 == 1, F.lit(PROPOSAL_CLOSED_VALUE))
           .otherwise(F.lit(PROPOSAL_OPEN_VALUE)))
    return c.select(
        "event_id", "ts", "key", "actor",
        *[_pick(WEEKDAY_TEXT, fv).alias(d) for d in ("mon", "tue", "wed", "thu", "fri")],
        _pick(WEEKEND_TEXT, fv).alias("sat"), _pick(WEEKEND_TEXT, fv + 2).alias("sun"),
        F.concat(F.lit('{"'), key, F.lit('":"'), val, F.lit('"}')).alias("special_text"))


def moderation_commands(t: dict[str, DataFrame]) -> DataFrame:
    return commands(t).where(F.col("action").isin("VER", "DEL"))


def hours_commands(t: dict[str, DataFrame]) -> DataFrame:
    """VER / DEL on an hours version by id: the venue's first or second version,
    or one proposed by an event shortly before (or after: no version yet)."""
    fv = F.floor("value").cast("long")
    near = F.col("event_id") + 2 - fv % 9 + VERSION_ID_OFFSET
    version = (F.when(fv % 8 == 0, F.col("key")).when(fv % 8 == 1, F.col("key") + SECOND_VERSION_OFFSET)
               .otherwise(near))
    return (commands(t).where(F.col("action").isin("VER", "DEL"))
            .select("event_id", "ts", version.alias("version"), "action", "actor"))


def hours_log(t: dict[str, DataFrame]) -> DataFrame:
    """Proposals and moderation of hours versions in one log (version and action null for proposals)."""
    proposals, mods = hours_proposals(t), hours_commands(t)
    return proposals.unionByName(mods, allowMissingColumns=True)


def menu_commands(t: dict[str, DataFrame]) -> DataFrame:
    """VER / DEL on a menu row (venue, dish): the least line of the order numbered like the event."""
    least = F.min(F.struct("l_linenumber", "l_suppkey", "l_partkey"))
    line = t["lineitem"].groupBy(F.col("l_orderkey").alias("event_id")).agg(least.alias("l")).select(
        "event_id", F.col("l.l_suppkey").alias("id_restaurant"), F.col("l.l_partkey").alias("id_dish"))
    return moderation_commands(t).join(line, "event_id").select(
        "event_id", "ts", "id_restaurant", "id_dish", "action", "actor")


def comment_commands(t: dict[str, DataFrame]) -> DataFrame:
    """VER / DEL on a comment, the comment id derived from the event's, over all comments."""
    return moderation_commands(t).select(
        "event_id", "ts", F.floor(F.col("event_id") * 3 / 2).cast("long").alias("key"), "action", "actor")


def comment_submissions(t: dict[str, DataFrame]) -> DataFrame:
    """'purchase' events as comment submissions (venue, author, score, text)."""
    e = t["events"].where(F.col("event_type") == "purchase")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"),
                    F.col("user_id").alias("res_id"),
                    F.get_json_object("props", "$.k").cast("long").alias("actor"),
                    (F.col("value") / 100.0).alias("score"),
                    _pick(COMMENT_TEXTS, F.floor("value").cast("long")).alias("text"))


# Fixed values of the derived submissions (shared with the SQL oracle).
CUISINE_NAMES = ["URGENT", "HIGH", "MEDIUM", "NOT SPECIFIED", "LOW"]


def venue_submissions(t: dict[str, DataFrame]) -> DataFrame:
    """One venue submission per customer; some names / addresses invalid."""
    c = t["customer"]
    k = F.col("c_custkey")
    name = F.when(F.col("c_acctbal") < 0, F.col("c_name")).otherwise(F.regexp_replace("c_name", "#", ""))
    city = F.when(F.col("c_nationkey") % 5 == 0, F.lit("Wro-claw")).otherwise(F.lit("Wroclaw"))
    address = F.concat(F.col("c_mktsegment"), F.lit(" "), F.col("c_nationkey").cast("string"), F.lit(", "), city)
    # names as people type them: some in lower case
    cuisines = F.array(_pick(CUISINE_NAMES, k), F.lit("Unknown"), F.lower(_pick(CUISINE_NAMES, k + 2)))
    return c.select(k.alias("sub_id"), k.alias("actor"), name.alias("name"), address.alias("address"),
                    cuisines.alias("cuisines"))


def dish_requests_json(t: dict[str, DataFrame]) -> DataFrame:
    """One nested dish request (JSON text) per order."""
    o = t["orders"]
    cal = F.floor("o_totalprice").cast("long") % 900
    price = F.floor("o_totalprice").cast("long") % 1000
    weight = cal % 300
    word = F.substring("o_orderpriority", 3, 100)
    name = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("bad-"), word)).otherwise(
        F.concat(word, F.lit(" plate")))
    s = lambda c: c.cast("string")
    body = F.concat(
        F.lit('{"id":'), s(F.floor(F.col("o_custkey") / 15).cast("long")), F.lit(',"name":"'), name,
        F.lit('","calories":'), s(cal), F.lit(',"weight":'), s(weight), F.lit(',"price":'), s(price),
        F.lit(',"vegan":false,"vegetarian":true,"ingredients":[{"name":"ing'), s(F.floor(F.col("o_orderkey") / 30).cast("long")),
        F.when(F.col("o_orderkey") % 2 == 0, F.lit('","allergens":["MEDIUM","Nut')).otherwise(F.lit('","allergens":["Medium","NUT')),
        s(F.floor(F.col("o_orderkey") / 100).cast("long")),
        F.lit('"]},{"name":"salt","allergens":[]}]}'))
    return o.select(F.col("o_orderkey").alias("req_id"), F.col("o_custkey").alias("actor"), body.alias("body"))


def registrations(t: dict[str, DataFrame]) -> DataFrame:
    """'signup' events as user registrations (some taken, malformed or repeated)."""
    e = t["events"].where(F.col("event_type") == "signup")
    fv = F.floor("value").cast("long")
    actor = F.get_json_object("props", "$.k")
    uid = F.col("user_id").cast("string")
    login = (F.when(fv % 4 == 0, F.concat(F.lit("User"), actor))
             .when(fv % 4 == 1, F.concat(F.lit("u"), (fv % 10).cast("string")))
             .otherwise(F.concat(F.when(fv % 2 == 0, F.lit("guest")).otherwise(F.lit("Guest")), uid, F.lit("v"), (fv % 3).cast("string"))))
    email = F.when(fv % 5 == 0, F.concat(F.lit("Guest"), uid, F.lit("@Example.com"))).otherwise(
        F.concat(F.lower(login), F.lit("@mail.example.org")))
    return e.select(F.col("event_id").alias("reg_id"), F.col("ts").cast("timestamp").alias("ts"),
                    login.alias("login"), email.alias("email"))


def load(spark: SparkSession, sf_dir: str, root: str) -> Catalog:
    """Write every role table once as parquet under ``root`` and return a
    catalogue reading those files: the deployment setting, where venues,
    menus, links ... are base tables rather than views over the fact tables.
    (Registered queries use the lazy :func:`bind`; this is the "loaded" form.)
    """
    cat = bind(spark, sf_dir)
    tables = {}
    for name in Catalog.__dataclass_fields__:
        path = f"{root.rstrip('/')}/{name}"
        getattr(cat, name).write.mode("overwrite").parquet(path)
        tables[name] = spark.read.parquet(path)
    return Catalog(**tables)
