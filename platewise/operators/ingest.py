"""Ingestion of contributed records: validate, assign ids, split nested
requests into table rows, and create the default rows new venues need.

Every function returns new rows (and rejects with a reason) as DataFrames;
appending them to a snapshot is a ``unionByName`` and a write of a new
version directory.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platewise.catalog import WEEKDAYS
from platewise.functions.text import (LOGIN_MAX_LEN, LOGIN_MIN_LEN, is_alnum, is_email,
                                      length_between, strip_chars, text_key)
from platewise.operators.ids import assign_ids, next_id_after
from platewise.operators.moderation import role_gate
from platewise.session import materialize

DISH_REQUEST_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("calories", T.DoubleType()),
    T.StructField("weight", T.DoubleType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("vegan", T.BooleanType()),
    T.StructField("vegetarian", T.BooleanType()),
    T.StructField("ingredients", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("allergens", T.ArrayType(T.StringType())),
    ]))),
])


def _known(df: DataFrame, users: DataFrame) -> DataFrame:
    return role_gate(df.withColumn("action", F.lit("SUBMIT")), users).drop("action")


# -- venues (W1) -------------------------------------------------------------------------

def validate_venue_submissions(subs: DataFrame) -> DataFrame:
    """Name alphanumeric; address alphanumeric once commas and spaces are removed."""
    reason = (F.when(~is_alnum(F.col("name")), F.lit("invalid name"))
              .when(~is_alnum(strip_chars(F.col("address"), ", ")), F.lit("invalid address")))
    return subs.withColumn("reason", reason).withColumn("valid", reason.isNull())


def ingest_venues(restaurants: DataFrame, cuisines: DataFrame, subs: DataFrame,
                  users: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Submissions (sub_id, actor, name, address, cuisines array<string>) ->
    (new restaurants, new cuisine links, rejects).

    New venues are unverified; ids follow the current maximum in ``sub_id``
    order.  Cuisine names resolve without regard to case and accents; unknown
    names are dropped.
    """
    checked = validate_venue_submissions(_known(subs, users))
    rejects = checked.where(~F.col("valid")).select("sub_id", "reason")
    ok = assign_ids(checked.where(F.col("valid")), ["sub_id"], start=next_id_after(restaurants))
    new = ok.select("id", "name", F.lit(0.0).alias("opinion"), F.lit(False).alias("verified"),
                    "address", F.col("actor").alias("updated_by"),
                    F.lit(0).cast("long").alias("verified_by"), F.lit(False).alias("deleted"), "sub_id")
    c = cuisines.select(F.col("id").alias("id_cuisine"), text_key(F.col("type")).alias("_cuisine"))
    links = (ok.select(F.col("id").alias("id_restaurant"), F.explode("cuisines").alias("cuisine"))
             .withColumn("_cuisine", text_key(F.col("cuisine"))).join(c, "_cuisine").select("id_restaurant", "id_cuisine"))
    return new, links, rejects


def default_coordinates(restaurants: DataFrame, coordinates: DataFrame) -> DataFrame:
    """(0,0) current and pending location for venues without a location row."""
    missing = restaurants.select("id").join(coordinates.select("id"), "id", "left_anti")
    return missing.select("id", F.lit(False).alias("verified"), F.lit(0.0).alias("lat"),
                          F.lit(0.0).alias("lon"), F.lit(0.0).alias("pending_lat"),
                          F.lit(0.0).alias("pending_lon"), F.lit(0).cast("long").alias("updated_by"),
                          F.lit(0).cast("long").alias("verified_by"),
                          F.lit(0).cast("long").alias("edited_by"))


def default_hours(restaurants: DataFrame, hours: DataFrame) -> DataFrame:
    """An all-'closed', unverified hours version for venues without any."""
    missing = (restaurants.select(F.col("id").alias("id_restaurant"))
               .join(hours.select("id_restaurant"), "id_restaurant", "left_anti"))
    rows = missing.select("id_restaurant", *[F.lit("closed").alias(d) for d in WEEKDAYS],
                          F.lit(None).cast("map<string,string>").alias("special"),
                          F.lit(0).cast("long").alias("updated_by"),
                          F.lit(0).cast("long").alias("verified_by"),
                          F.lit(False).alias("verified"), F.lit(False).alias("deleted"))
    return assign_ids(rows, ["id_restaurant"], start=next_id_after(hours))


# -- dishes (W2) ---------------------------------------------------------------------------

def parse_dish_requests(requests: DataFrame) -> DataFrame:
    """(req_id, actor, body JSON text) -> typed request columns; the request's
    ``id`` (the venue) becomes ``res_id``."""
    return (requests.select("req_id", "actor", F.from_json("body", DISH_REQUEST_SCHEMA).alias("r"))
            .select("req_id", "actor", "r.*").withColumnRenamed("id", "res_id"))


def validate_dish_requests(req: DataFrame, restaurants: DataFrame) -> DataFrame:
    """Name alphanumeric ignoring spaces; price, calories, weight > 0; venue exists."""
    exists = restaurants.select(F.col("id").alias("res_id")).distinct().withColumn("_exists", F.lit(True))
    j = req.join(exists, "res_id", "left")
    reason = (F.when(~is_alnum(strip_chars(F.col("name"), " ")), F.lit("bad_name"))
              .when(~F.coalesce(F.col("price") > 0, F.lit(False)), F.lit("bad_price"))
              .when(~F.coalesce(F.col("calories") > 0, F.lit(False)), F.lit("bad_calories"))
              .when(~F.coalesce(F.col("weight") > 0, F.lit(False)), F.lit("bad_weight"))
              .when(F.col("_exists").isNull(), F.lit("no_venue")))
    return j.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull()).drop("_exists")


def ingest_dishes(dishes: DataFrame, ingredients: DataFrame, allergens: DataFrame,
                  restaurants: DataFrame, users: DataFrame, requests: DataFrame) -> dict[str, DataFrame]:
    """Nested dish requests (req_id, actor, body) -> rows of five tables.

    Returns ``dishes``, ``menu``, ``ingredients``, ``allergens`` (new names
    only), ``ingredient_allergens``, ``dish_ingredients`` and ``rejects``.
    Each ingredient is inserted anew with unset diet flags; allergens are
    get-or-create by name (without regard to case and accents, spelled as first
    named) over the whole batch, so two requests naming the same new allergen
    create one row.  All ids are contiguous after the
    current maxima, ordered by request id (and position).
    """
    req = validate_dish_requests(parse_dish_requests(_known(requests, users)), restaurants)
    rejects = req.where(~F.col("valid")).select("req_id", "reason")
    # dish ids and, in the same pass, a block of ingredient ids per request
    ok = assign_ids(req.where(F.col("valid")).withColumn("_n_ing", F.size(F.coalesce(
                        "ingredients", F.array().cast(DISH_REQUEST_SCHEMA["ingredients"].dataType)))),
                    ["req_id"], start=next_id_after(dishes),
                    block_size_col="_n_ing", block_start=next_id_after(ingredients), block_col="_ing0")
    new_dishes = ok.select("id", "name", F.col("calories").cast("int").alias("calories"), "price",
                           "weight", F.coalesce("vegetarian", F.lit(False)).alias("vegetarian"),
                           F.coalesce("vegan", F.lit(False)).alias("vegan"))
    new_menu = ok.select(F.col("res_id").alias("id_restaurant"), F.col("id").alias("id_dish"),
                         F.lit(False).alias("verified"), F.col("actor").alias("updated_by"),
                         F.lit(0).cast("long").alias("verified_by"), F.lit(False).alias("deleted"))
    ing_rows = (ok.select("req_id", F.col("id").alias("id_dish"), "_ing0",
                          F.posexplode("ingredients").alias("pos", "ing"))
                .withColumn("id", (F.col("_ing0") + F.col("pos")).cast("long")))
    new_ingredients = ing_rows.select("id", F.col("ing.name").alias("name"),
                                      F.lit(False).alias("vegetarian"), F.lit(False).alias("vegan"))
    dish_links = ing_rows.select(F.col("id").alias("id_ingredient"), "id_dish")
    wanted = ing_rows.select(F.col("id").alias("id_ingredient"),
                             F.posexplode("ing.allergens").alias("pos", "allergen")).withColumn("_name", text_key(F.col("allergen")))
    old = (allergens.groupBy(text_key(F.col("name")).alias("_name")).agg(F.min("id").alias("id_allergen")))
    fresh = (wanted.groupBy("_name").agg(F.min_by("allergen", F.struct("id_ingredient", "pos")).alias("name"))
             .join(old, "_name", "left_anti").select("name"))
    new_allergens = assign_ids(fresh, ["name"], start=next_id_after(allergens)).select("id", "name")
    all_allergens = old.unionByName(new_allergens.select(text_key(F.col("name")).alias("_name"),
                                                         F.col("id").alias("id_allergen")))
    alg_links = wanted.join(all_allergens, "_name").select("id_allergen", "id_ingredient")
    return {"dishes": new_dishes, "menu": new_menu, "ingredients": new_ingredients,
            "allergens": new_allergens, "ingredient_allergens": alg_links,
            "dish_ingredients": dish_links, "rejects": rejects}


# -- users (W14) ---------------------------------------------------------------------------

#: rounds of peeling at least, and rows that one task folds at most
PEELING_ROUNDS, FOLD_ROWS = 2, 1_000_000


def _one_at_a_time(regs: DataFrame) -> DataFrame:
    """Decisions (reg_id, login, email, reason) of at most ``FOLD_ROWS`` registrations in the order of time: accepted
    unless one accepted before has the login or the e-mail."""
    schema = T.StructType([*(regs.schema[c] for c in ("reg_id", "login", "email")), T.StructField("reason", T.StringType())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logins, emails = set(), set()
        for batch in batches:
            reasons = []
            for login, email in zip(batch.column("_login").to_pylist(), batch.column("_email").to_pylist(), strict=True):
                free = login not in logins and email not in emails
                if free:
                    logins.add(login)
                    emails.add(email)
                reasons.append(None if free else "duplicate in batch")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("reg_id", "login", "email")), pa.array(reasons, pa.string())],
                                             names=schema.names)

    return regs.repartition(1).sortWithinPartitions("ts", "reg_id").mapInArrow(fold, schema)

def validate_users(users: DataFrame, regs: DataFrame) -> DataFrame:
    """Registration checks over a batch (reg_id, ts, login, email).

    Email pattern (lower case), login 4-20 alphanumeric, login and email not
    already taken (one anti join per key, not an OR join), and the in-batch
    rule of processing registrations one at a time: a registration is
    rejected when an *accepted* earlier one shares its login or e-mail.  Logins
    and e-mails are compared without regard to case and accents.

    That greedy outcome is computed by peeling: each round accepts every
    undecided candidate that is the earliest undecided one of both its login
    and its e-mail group, and rejects the later undecided members of those
    groups.  Each round is two partial aggregates and joins over the undecided rows,
    checkpointed.  A round decides almost everything, but only the ends of a
    chain of shared logins and e-mails; so as soon as at most ``FOLD_ROWS`` rows
    are left (a checked size), they are folded one at a time, in one pass in
    the order of time.
    """
    o = F.struct("ts", "reg_id")
    fmt = (F.when(~is_email(F.col("email")), F.lit("bad email"))
           .when(~(is_alnum(F.col("login")) & length_between(F.col("login"), LOGIN_MIN_LEN, LOGIN_MAX_LEN)),
                 F.lit("bad login")))
    r = regs.withColumn("reason", fmt)
    r = r.withColumn("_login", text_key(F.col("login"))).withColumn("_email", text_key(F.col("email")))

    def taken(key: str, mark: str) -> DataFrame:
        # only users that share a value with the batch are grouped
        held = users.select(text_key(F.col(key)).alias(f"_{key}"))
        return held.join(r.select(f"_{key}"), f"_{key}", "left_semi").distinct().withColumn(mark, F.lit(True))

    r = (r.join(taken("login", "_lt"), "_login", "left")
         .join(taken("email", "_et"), "_email", "left")
         .withColumn("reason", F.when(F.col("reason").isNotNull(), F.col("reason"))
                     .when(F.col("_lt").isNotNull(), F.lit("login taken"))
                     .when(F.col("_et").isNotNull(), F.lit("email taken")))
         .drop("_lt", "_et")
         .select("reg_id", "ts", "login", "email", "_login", "_email", "reason"))
    r = materialize(r)
    decided = [r.where(F.col("reason").isNotNull()).select("reg_id", "login", "email", "reason")]
    undecided = r.where(F.col("reason").isNull()).select("reg_id", "ts", "login", "email", "_login", "_email")
    columns = ["reg_id", "ts", "login", "email", "_login", "_email"]
    rounds, left = 0, undecided.count()
    while left and (rounds < PEELING_ROUNDS or left > FOLD_ROWS):
        rounds += 1
        first_l = undecided.groupBy("_login").agg(F.min(o).alias("_fl"))
        first_e = undecided.groupBy("_email").agg(F.min(o).alias("_fe"))
        u = undecided.join(first_l, "_login").join(first_e, "_email")
        accepted = materialize(u.where((o == F.col("_fl")) & (o == F.col("_fe"))).select(*columns))
        acc_l = accepted.select("_login", F.struct("ts", "reg_id").alias("_al"))
        acc_e = accepted.select("_email", F.struct("ts", "reg_id").alias("_ae"))
        rest = (undecided.join(accepted.select("reg_id"), "reg_id", "left_anti")
                .join(acc_l, "_login", "left").join(acc_e, "_email", "left"))
        lost = (F.coalesce(o > F.col("_al"), F.lit(False)) | F.coalesce(o > F.col("_ae"), F.lit(False)))
        rest = materialize(rest.withColumn("_lost", lost))
        decided += [accepted.select("reg_id", "login", "email", F.lit(None).cast("string").alias("reason")),
                    rest.where(F.col("_lost")).select("reg_id", "login", "email", F.lit("duplicate in batch").alias("reason"))]
        if len(decided) > 16:  # the plan does not grow with the chain
            decided = [materialize(reduce(DataFrame.unionByName, decided))]
        undecided = rest.where(~F.col("_lost")).select(*columns)
        left = undecided.count()
    if left:
        decided.append(_one_at_a_time(undecided))
    return reduce(DataFrame.unionByName, decided).select("reg_id", "login", "email", F.col("reason").isNull().alias("valid"), "reason")
