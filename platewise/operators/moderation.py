"""Moderation: command logs applied to table snapshots, giving new snapshots.

In the reference each command is an UPDATE on one row, run in arrival order.
Here a whole log is folded at once.  Order is fixed by ``(ts, event_id)``.

* flags (venue, menu row, comment): order-free -> one aggregate per key;
* locations: order-dependent, but a command only needs the one before it
  (a scan split over range slices), then one aggregate per key;
* hours versions: each VER has one possible successor (scans split over range
  partitions); the VERs that act are a chain, found by pointer doubling;
* diet flags: recomputed from ingredients for dishes with a verified menu row.

Role gate: VER/DEL need an admin actor, other commands a known user.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.catalog import WEEKDAYS, Catalog
from platewise.functions.hours import special_problem, valid_weekly_value
from platewise.functions.text import is_alnum, nonzero_number, strip_chars
from platewise.operators.asof import carry_forward, min_after, previous
from platewise.operators.ids import assign_ids, next_id_after
from platewise.session import materialize

ADMIN_ACTIONS = ("VER", "DEL")


def _o() -> Column:
    """The fold order of a command."""
    return F.struct(F.col("ts"), F.col("event_id"))


def once(commands: DataFrame) -> DataFrame:
    """Each event id once: a repeated delivery counts as one (of unlike ones the least)."""
    rest = [c for c in commands.columns if c != "event_id"]
    return (commands.groupBy("event_id").agg(F.min(F.struct(*rest)).alias("_c"))
            .select("event_id", "_c.*").select(*commands.columns))


def role_gate(commands: DataFrame, users: DataFrame,
              admin_actions: tuple[str, ...] = ADMIN_ACTIONS) -> DataFrame:
    """Keep admin actions of admins and other actions of known users.

    One left-semi join on the actor id with a residual condition on the
    admin flag: a single pass over the log, no union of per-action scans.
    """
    u = users.select(F.col("id").alias("_uid"), F.col("is_admin").alias("_adm"))
    needs_admin = F.col("action").isin(*admin_actions)
    cond = (F.col("actor") == F.col("_uid")) & (~needs_admin | F.coalesce(F.col("_adm"), F.lit(False)))
    return commands.join(u, cond, "left_semi")


# -- flags (W6, W7, W9) --------------------------------------------------------

def flag_changes(commands: DataFrame, key_cols: list[str]) -> DataFrame:
    """Per key: any VER, any DEL, actor of the last one.  Order-free, so it is
    also the streaming form (late rows only change ``max`` aggregates)."""
    c = commands.where(F.col("action").isin(*ADMIN_ACTIONS))
    for k in key_cols:
        c = c.where(F.col(k) > 0)
    return (c.groupBy(*key_cols)
            .agg(F.max(F.col("action") == "VER").alias("any_ver"),
                 F.max(F.col("action") == "DEL").alias("any_del"),
                 F.max_by("actor", _o()).alias("last_actor")))


def apply_flag_changes(snapshot: DataFrame, changes: DataFrame, snap_keys: list[str],
                       change_keys: list[str]) -> DataFrame:
    ch = changes.select(*[F.col(c).alias(s) for c, s in zip(change_keys, snap_keys)],
                        "any_ver", "any_del", "last_actor")
    j = snapshot.join(ch, snap_keys, "left")
    return (j.withColumn("verified", F.col("verified") | F.coalesce(F.col("any_ver"), F.lit(False)))
            .withColumn("deleted", F.col("deleted") | F.coalesce(F.col("any_del"), F.lit(False)))
            .withColumn("verified_by", F.coalesce(F.col("last_actor"), F.col("verified_by")))
            .drop("any_ver", "any_del", "last_actor"))


def moderate_flags(snapshot: DataFrame, commands: DataFrame, users: DataFrame,
                   snap_keys: list[str] = ("id",), cmd_keys: list[str] = ("key",)) -> DataFrame:
    """New snapshot after VER/DEL commands (venues, comments; menu rows with a
    two-column key, where every duplicate row of the pair changes)."""
    snap_keys, cmd_keys = list(snap_keys), list(cmd_keys)
    gated = role_gate(commands.where(F.col("action").isin(*ADMIN_ACTIONS)), users)
    return apply_flag_changes(snapshot, flag_changes(gated, cmd_keys), snap_keys, cmd_keys)


# -- diet flags (W13) ------------------------------------------------------------

def derive_diet_flags(cat: Catalog, touched: DataFrame | None = None) -> DataFrame:
    """dish.vegan / vegetarian = false iff the dish has a verified menu row and a
    non-vegan / non-vegetarian ingredient; otherwise true (vacuous).

    With ``touched`` (a frame of ``id_dish``) only those dishes are
    recomputed, the rest keep their stored flags (the trigger's behaviour).
    """
    served = cat.menu.where(F.col("verified")).select("id_dish")
    ing = cat.ingredients.select(F.col("id").alias("id_ingredient"),
                                 F.col("vegan").alias("i_vegan"),
                                 F.col("vegetarian").alias("i_vegetarian"))
    links = cat.dish_ingredients
    if touched is not None:   # only their links and menu rows are read on
        t = materialize(touched.select("id_dish").distinct())
        links, served = links.join(t, "id_dish", "left_semi"), served.join(t, "id_dish", "left_semi")
    worst = (links.join(ing, "id_ingredient")
             .join(served, "id_dish", "left_semi")
             .groupBy("id_dish")
             .agg(F.min(F.col("i_vegan").cast("int")).alias("all_vegan"),
                  F.min(F.col("i_vegetarian").cast("int")).alias("all_vegetarian")))
    d = cat.dishes.join(worst.withColumnRenamed("id_dish", "id"), "id", "left")
    new_vegan = F.coalesce(F.col("all_vegan") == 1, F.lit(True))
    new_veg = F.coalesce(F.col("all_vegetarian") == 1, F.lit(True))
    if touched is not None:
        d = d.join(t.select(F.col("id_dish").alias("id"), F.lit(True).alias("_t")), "id", "left")
        hit = F.coalesce(F.col("_t"), F.lit(False))
        new_vegan = F.when(hit, new_vegan).otherwise(F.col("vegan"))
        new_veg = F.when(hit, new_veg).otherwise(F.col("vegetarian"))
    cols = [c for c in cat.dishes.columns]
    return (d.withColumn("vegan", new_vegan).withColumn("vegetarian", new_veg)
            .select(*cols))


def moderate_menu(cat: Catalog, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Menu-row moderation (key: id_restaurant, id_dish) and the diet flags of
    the dishes it touched. Returns (new menu, new dishes)."""
    gated = role_gate(commands.where(F.col("action").isin(*ADMIN_ACTIONS)), cat.users)
    ch = materialize(flag_changes(gated, ["id_restaurant", "id_dish"]))
    new_menu = apply_flag_changes(cat.menu, ch, ["id_restaurant", "id_dish"],
                                  ["id_restaurant", "id_dish"])
    touched = cat.menu.join(ch.select("id_restaurant", "id_dish"), ["id_restaurant", "id_dish"],
                            "left_semi").select("id_dish")
    new_dishes = derive_diet_flags(cat.with_tables(menu=new_menu), touched)
    return new_menu, new_dishes


# -- locations (W3, W8) ------------------------------------------------------------

def location_commands(commands: DataFrame, restaurants: DataFrame, users: DataFrame) -> DataFrame:
    """Gate the log and turn UPDATE payloads (coord_x, coord_y) into a pending
    point; a non-numeric or zero axis makes it (0, 0).  UPDATE needs an
    existing venue, VER/DEL an admin and a positive id.  One pass: a left
    join with the (distinct) venue ids marks existence."""
    c = commands.where(F.col("action").isin("UPDATE", "VER", "DEL"))
    ok = nonzero_number(F.col("coord_x")) & nonzero_number(F.col("coord_y"))
    c = c.select("event_id", "ts", "key", "action", "actor",
                 F.when(ok, F.col("coord_x").try_cast("double")).otherwise(0.0).alias("p_lat"),
                 F.when(ok, F.col("coord_y").try_cast("double")).otherwise(0.0).alias("p_lon"))
    venues = restaurants.select(F.col("id").alias("key")).distinct().withColumn("_exists", F.lit(True))
    keep = (((F.col("action") == "UPDATE") & F.col("_exists").isNotNull())
            | (F.col("action").isin(*ADMIN_ACTIONS) & (F.col("key") > 0)))
    return role_gate(c, users).join(venues, "key", "left").where(keep).drop("_exists")


def moderate_locations(coordinates: DataFrame, commands: DataFrame) -> DataFrame:
    """Fold gated location commands into the coordinates snapshot.

    Sequential rules: UPDATE sets the pending point, verified=0, edited_by.
    DEL clears the pending point, verified=0, verified_by, edited_by=0.  VER
    only acts when unverified: current := pending, pending := (0,0),
    verified=1, verified_by, updated_by := edited_by, edited_by=0.

    A VER is effective iff the command before it is an UPDATE or DEL (or it
    is first and the row starts unverified), so every command only needs the
    one before it: a scan in two levels over range slices, so that a venue with
    a huge log is split over tasks.  The final state then is a function of the
    first, the last, the last DEL and the last effective command of each key:
    one partially aggregated pass, no join on the key.
    """
    payload = F.struct("action", "actor", "p_lat", "p_lon")
    c = commands.select("key", "ts", "event_id", "action", "actor", payload.alias("payload"))
    c = previous(c, "key", ["ts", "event_id"], "payload", "before")
    o = _o()
    effective = (F.col("action") == "VER") & (F.col("before.action") != "VER")
    a = c.groupBy(F.col("key").alias("id")).agg(
        F.max_by("payload", o).alias("last"),
        F.min_by(F.struct("action", "actor", o.alias("o")), o).alias("first"),
        F.max(F.col("action") != "VER").alias("any_nonver"),
        F.max_by(F.struct("actor", o.alias("o")), F.when(F.col("action") == "DEL", o)).alias("last_del"),
        F.max_by(F.struct("actor", o.alias("o"), F.col("before").alias("n")), F.when(effective, o)).alias("e"))
    s = coordinates.join(a, "id", "left")

    has_cmd = F.col("last").isNotNull()
    last_act = F.col("last.action")
    has_e = F.col("e").isNotNull()
    eff_from_start = ~has_e & (F.col("first.action") == "VER") & ~F.col("verified")  # the first command acts
    has_eff = has_e | eff_from_start
    eff_actor = F.when(has_e, F.col("e.actor")).otherwise(F.col("first.actor"))
    eff_o = F.when(has_e, F.col("e.o")).otherwise(F.col("first.o"))
    proposed = F.col("e.n.action") == "UPDATE"
    new_lat = (F.when(has_e, F.when(proposed, F.col("e.n.p_lat")).otherwise(0.0))
               .when(eff_from_start, F.col("pending_lat")).otherwise(F.col("lat")))
    new_lon = (F.when(has_e, F.when(proposed, F.col("e.n.p_lon")).otherwise(0.0))
               .when(eff_from_start, F.col("pending_lon")).otherwise(F.col("lon")))
    new_updated_by = (F.when(has_e, F.when(proposed, F.col("e.n.actor")).otherwise(F.lit(0)))
                      .when(eff_from_start, F.col("edited_by")).otherwise(F.col("updated_by")))
    # last state-changing command: UPDATE / DEL, or an effective VER
    last_is_ver = last_act == "VER"
    ver_cleared = last_is_ver & (F.col("any_nonver") | ~F.col("verified"))
    new_pending_lat = (F.when(~has_cmd, F.col("pending_lat"))
                       .when(last_act == "UPDATE", F.col("last.p_lat"))
                       .when((last_act == "DEL") | ver_cleared, F.lit(0.0))
                       .otherwise(F.col("pending_lat")))
    new_pending_lon = (F.when(~has_cmd, F.col("pending_lon"))
                       .when(last_act == "UPDATE", F.col("last.p_lon"))
                       .when((last_act == "DEL") | ver_cleared, F.lit(0.0))
                       .otherwise(F.col("pending_lon")))
    new_edited_by = (F.when(~has_cmd, F.col("edited_by"))
                     .when(last_act == "UPDATE", F.col("last.actor"))
                     .when((last_act == "DEL") | ver_cleared, F.lit(0))
                     .otherwise(F.col("edited_by")))
    new_verified = F.when(~has_cmd, F.col("verified")).otherwise(last_is_ver)
    del_later = F.col("last_del").isNotNull() & (~has_eff | (F.col("last_del.o") > eff_o))
    new_verified_by = (F.when(del_later, F.col("last_del.actor"))
                       .when(has_eff, eff_actor).otherwise(F.col("verified_by")))
    return s.select("id", new_verified.alias("verified"), new_lat.alias("lat"), new_lon.alias("lon"),
                    new_pending_lat.alias("pending_lat"), new_pending_lon.alias("pending_lon"),
                    new_updated_by.cast("long").alias("updated_by"),
                    new_verified_by.cast("long").alias("verified_by"),
                    new_edited_by.cast("long").alias("edited_by"))


# -- hours versions (W5, W10) ---------------------------------------------------------

def validate_hours_proposals(proposals: DataFrame) -> DataFrame:
    """Adds ``special`` (parsed map), ``valid`` and ``reason`` to proposals with
    mon..sun text and ``special_text`` JSON.  All seven days must be
    ``HH:MM-HH:MM`` or 'closed'; the special schedule must be valid (the
    reference silently stores an invalid one as NULL; we reject it)."""
    special = F.from_json(F.coalesce(F.col("special_text"), F.lit("{}")), "map<string,string>")
    days_ok = F.lit(True)
    for d in WEEKDAYS:
        days_ok = days_ok & valid_weekly_value(F.col(d))
    p = proposals.withColumn("special", special)
    problem = F.when(F.col("special").isNull(), F.lit("bad_special")) \
        .otherwise(special_problem(F.col("special")))
    return (p.withColumn("reason", F.when(~days_ok, F.lit("bad_day"))
                         .otherwise(problem))
            .withColumn("valid", F.col("reason").isNull()))


VERSION_ID_OFFSET = 2_000_000_000_000


HOURS_COLUMNS = ["id", "id_restaurant", *WEEKDAYS, "special", "updated_by", "verified_by", "verified", "deleted"]


def hours_versions(proposals: DataFrame, restaurants: DataFrame, users: DataFrame) -> DataFrame:
    """The new versions (columns of hours, and their place ``o`` in the log): a
    valid proposal by a known user for an existing venue, unverified, with id
    ``VERSION_ID_OFFSET + event_id``.  A proposal delivered twice is one."""
    p = validate_hours_proposals(once(proposals))
    p = role_gate(p.withColumn("action", F.lit("INSERT")), users).where(F.col("valid"))
    p = p.join(restaurants.select(F.col("id").alias("key")).distinct(), "key", "left_semi")
    return p.select((F.col("event_id") + F.lit(VERSION_ID_OFFSET)).alias("id"), F.col("key").alias("id_restaurant"),
                    *WEEKDAYS, "special", F.col("actor").alias("updated_by"), F.lit(0).cast("long").alias("verified_by"),
                    F.lit(False).alias("verified"), F.lit(False).alias("deleted"), _o().alias("o"))


def _reached(heads: DataFrame, successor: DataFrame) -> DataFrame:
    """Nodes on the chains that start at ``heads`` (node) and follow
    ``successor`` (node, next; next is null at the end).  Pointers double every
    round, so a chain of n commands takes log2(n) rounds, one write each; every
    join is on unique nodes.  Successors that run in a circle are an error."""
    state = materialize(successor.join(heads.select("node", F.lit(True).alias("on")), "node", "left")
                        .select("node", "next", F.coalesce("on", F.lit(False)).alias("on")))
    rounds, limit = 0, state.count().bit_length() + 1
    while not state.where("next is not null").isEmpty():
        if rounds == limit:
            raise ValueError("commands follow each other in a circle")
        onward = state.select(F.col("node").alias("next"), F.col("next").alias("far"))
        hit = state.where("on and next is not null").select(F.col("next").alias("node"), F.lit(True).alias("hit"))
        state = materialize(state.join(onward, "next", "left").join(hit, "node", "left")
                            .select("node", F.col("far").alias("next"), (F.col("on") | F.col("hit").isNotNull()).alias("on")))
        rounds += 1
    return state.where("on").select("node")


def fold_hours(hours: DataFrame, new: DataFrame, cmds: DataFrame) -> DataFrame:
    """New hours snapshot after new versions (:func:`hours_versions`) and gated
    VER/DEL commands (version, o, act, actor), one at a time in the order of o:

    * DEL acts on an existing unverified version: deleted, ``verified_by``;
    * VER acts on an existing version that is not deleted: verified,
      ``verified_by``, and every other version the venue has by then is deleted.

    Deleted versions never come back, so a version can win only by its first
    VER, before any DEL unless it is verified already.  After an acting VER on
    v, the next VER to act is the next one on v, or an earlier first VER of a
    version that came after: each VER has one successor, found by scans from
    the end of the log that split hot venues and hot versions.  The VERs that
    act are the chain from the venue's first one (pointer doubling).  Applying a
    log in parts gives the same snapshot as applying it whole.

    Every event id counts once (``o`` must hold it).  Of the snapshot, only ids,
    venues and flags take part in the fold; schedules are read once, at the end.
    """
    none = F.lit(None).cast(new.schema["o"].dataType)
    known = (hours.select(F.col("id").alias("version"), "id_restaurant", none.alias("since"), "verified", "deleted")
             .unionByName(new.select(F.col("id").alias("version"), "id_restaurant", F.col("o").alias("since"), "verified", "deleted"))
             .withColumnsRenamed({"verified": "was_verified", "deleted": "was_deleted"}))
    cmds = (cmds.groupBy(F.col("o.event_id").alias("event_id")).agg(F.min(F.struct("o", "version", "act", "actor")).alias("c"))
            .select("c.*"))
    c = materialize(cmds.join(known, "version").where(F.col("since").isNull() | (F.col("since") < F.col("o"))))
    ver, dele = F.when(F.col("act") == "VER", F.col("o")), F.when(F.col("act") == "DEL", F.col("o"))
    per_version = materialize(c.groupBy("version", "id_restaurant", "since", "was_verified", "was_deleted").agg(
        F.min(ver).alias("first_ver"), F.min(dele).alias("first_del"),
        F.max_by("actor", dele).alias("del_actor")))
    may_win = per_version.where(~F.col("was_deleted") & F.col("first_ver").isNotNull() & (
        F.col("was_verified") | F.col("first_del").isNull() | (F.col("first_ver") < F.col("first_del"))))
    vers = (c.where(F.col("act") == "VER").join(may_win.select("version"), "version", "left_semi")
            .select("version", "id_restaurant", "actor", F.col("o.ts").alias("ts"), F.col("o.event_id").alias("node"), "o"))
    # the next VER of the same version
    vers = min_after(vers, "version", ["ts", "node"], "o", "again")
    # the earliest first VER among versions that come later than this VER
    came = (may_win.where(F.col("since").isNotNull())
            .select("version", "id_restaurant", F.col("since.ts").alias("ts"), F.col("since.event_id").alias("node"),
                    F.col("first_ver").alias("won")))
    log = vers.unionByName(came, allowMissingColumns=True)
    vers = materialize(min_after(log, "id_restaurant", ["ts", "node"], "won", "rival").where(F.col("o").isNotNull()))
    successor = vers.select("node", F.least("again", "rival")["event_id"].alias("next"))
    heads = may_win.groupBy("id_restaurant").agg(F.min("first_ver").alias("o")).select(F.col("o.event_id").alias("node"))
    acted = vers.join(_reached(heads, successor), "node", "left_semi")

    winners = acted.groupBy("version").agg(F.max_by("actor", "o").alias("ver_actor"))
    last = acted.groupBy("id_restaurant").agg(F.max(F.struct("o", "version")).alias("last"))
    fate = (per_version.join(winners, "version", "left").select(
        F.col("version").alias("id"), "ver_actor",
        F.when(F.col("ver_actor").isNull() & ~F.col("was_verified"), F.col("del_actor")).alias("del_actor")))
    beaten = ((F.col("last.version") != F.col("id"))
              & (F.col("o").isNull() | (F.col("o") < F.col("last.o"))))
    versions = hours.select(*HOURS_COLUMNS).withColumn("o", none).unionByName(new.select(*HOURS_COLUMNS, "o"))
    return (versions.join(fate, "id", "left").join(last, "id_restaurant", "left")
            .withColumn("verified", F.col("verified") | F.col("ver_actor").isNotNull())
            .withColumn("verified_by", F.coalesce("ver_actor", "del_actor", "verified_by"))
            .withColumn("deleted", F.col("deleted") | F.col("del_actor").isNotNull() | F.coalesce(beaten, F.lit(False)))
            .select(*HOURS_COLUMNS))


def moderate_hours_by_id(hours: DataFrame, proposals: DataFrame, mods: DataFrame,
                         restaurants: DataFrame, users: DataFrame) -> DataFrame:
    """New hours snapshot after proposals and VER/DEL commands of admins
    (event_id, ts, version, action, actor), each naming a version of any age.
    Commands on versions that do not exist yet do nothing."""
    m = role_gate(mods.where(F.col("action").isin(*ADMIN_ACTIONS)), users).where(F.col("version") > 0)
    return fold_hours(hours, materialize(hours_versions(proposals, restaurants, users)),
                      m.select("version", _o().alias("o"), F.col("action").alias("act"), "actor"))


def moderate_hours(hours: DataFrame, proposals: DataFrame, mods: DataFrame,
                   restaurants: DataFrame, users: DataFrame) -> DataFrame:
    """:func:`moderate_hours_by_id` for commands that name only the venue (key):
    each addresses the venue's newest version at that time, the one proposed
    last before it or else the snapshot's with the largest id.  Event ids grow
    with time, as version ids do.

    A carry-forward over each venue's log gives every command its version
    (range-partitioned, so a venue with a huge log is split over tasks).
    """
    new = materialize(hours_versions(proposals, restaurants, users))
    m = role_gate(once(mods).where(F.col("action").isin(*ADMIN_ACTIONS)), users).where(F.col("key") > 0)
    log = (new.select(F.col("id_restaurant").alias("key"), "o.ts", "o.event_id", F.col("id").alias("_v"))
           .unionByName(m.select("key", "ts", "event_id", F.col("action").alias("act"), "actor"), allowMissingColumns=True))
    newest = materialize(hours.groupBy(F.col("id_restaurant").alias("key")).agg(F.max("id").alias("_newest")))
    cmds = (carry_forward(log, "key", ["ts", "event_id"], "_v", "target").where(F.col("act").isNotNull())
            .join(newest, "key", "left")
            .select(F.coalesce("target", "_newest").alias("version"), _o().alias("o"), "act", "actor")
            .where(F.col("version").isNotNull()))
    return fold_hours(hours, new, cmds)


# -- comments (W4) ---------------------------------------------------------------------

def validate_comment_submissions(subs: DataFrame) -> DataFrame:
    """0 < score <= 5 (0 is rejected as falsy), text alphanumeric after
    removing ',' and '.', venue id a non-zero number."""
    score = F.col("score").try_cast("double")
    reason = (F.when(~nonzero_number(F.col("res_id")), F.lit("bad_venue"))
              .when(~F.coalesce((score > 0) & (score <= 5), F.lit(False)), F.lit("bad_score"))
              .when(~is_alnum(strip_chars(F.col("text"), ",.")), F.lit("bad_text")))
    return subs.withColumn("score", score).withColumn("reason", reason).withColumn("valid", reason.isNull())


def valid_comments(submissions: DataFrame, restaurants: DataFrame, users: DataFrame) -> DataFrame:
    """The valid submissions by known users for existing venues."""
    v = validate_comment_submissions(submissions).where(F.col("valid"))
    v = role_gate(v.withColumn("action", F.lit("COMMENT")), users)
    return v.join(restaurants.select(F.col("id").alias("res_id")), "res_id", "left_semi")


def upsert_comments(comments: DataFrame, restaurant_comments: DataFrame, submissions: DataFrame,
                    restaurants: DataFrame, users: DataFrame) -> DataFrame:
    """Apply comment submissions (event_id, ts, res_id, actor, score, text).

    Key (venue, author); the last valid submission wins.  If the key already
    has a comment, the newest such comment is overwritten and its review
    state reset; otherwise a new comment gets the next free id (contiguous,
    ordered by key).  Returns the upserted rows with ``is_new``.
    """
    v = valid_comments(submissions, restaurants, users)
    last = materialize(v.groupBy("res_id", "actor")
                       .agg(F.max_by(F.struct("score", "text"), _o()).alias("s")))
    # of the history, only comments of the batch's authors on the batch's venues
    theirs = (comments.select(F.col("id").alias("id_comment"), F.col("updated_by").alias("actor"))
              .join(last.select("actor").distinct(), "actor", "left_semi"))
    there = (restaurant_comments.select("id_comment", F.col("id_restaurant").alias("res_id"))
             .join(last.select("res_id").distinct(), "res_id", "left_semi"))
    existing = (theirs.join(there, "id_comment").join(last.select("res_id", "actor"), ["res_id", "actor"], "left_semi")
                .groupBy("res_id", "actor").agg(F.max("id_comment").alias("old_id")))
    j = materialize(last.join(existing, ["res_id", "actor"], "left"))
    upd = j.where(F.col("old_id").isNotNull()).withColumn("id", F.col("old_id")).withColumn("is_new", F.lit(False))
    ins = assign_ids(j.where(F.col("old_id").isNull()), ["res_id", "actor"],
                     start=next_id_after(comments)).withColumn("is_new", F.lit(True))
    return (upd.unionByName(ins)
            .select("id", "res_id", F.col("s.text").alias("comment"), F.col("s.score").alias("score"),
                    F.lit(False).alias("verified"), F.col("actor").alias("updated_by"),
                    F.lit(0).cast("long").alias("verified_by"), F.lit(False).alias("deleted"), "is_new"))
