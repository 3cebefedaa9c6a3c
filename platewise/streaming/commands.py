"""Structured Streaming forms of the moderation feed.

* T1 flags: order-free aggregates per key in the state store (update mode: an
  epoch writes the keys that it changed), so late or reordered commands give
  the batch answer; the diet flags that follow from menu rows likewise, per dish;
* T2 snapshot maintenance (locations, hours): order-dependent folds, kept in
  buckets with bases that late commands re-open (``keyed.KeyedFold``);
  comment upserts with ids handed out in a block per epoch;
* T3 duplicate suppression: ``foreachBatch`` appends the event ids that no
  earlier batch delivered, however late they come (no watermark), and reads
  only buckets of earlier ids that may hold the batch's (``keyed.IdIndex``).

Sinks are files in the shared checkpoint folder (never the driver).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from platewise.catalog import Catalog
from platewise.operators import moderation
from platewise.operators.ids import assign_ids
from platewise.session import checkpoint_dir, materialize
from platewise.sources import snapshots
from platewise.streaming import keyed


def run_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint root for one streaming run."""
    return f"{checkpoint_dir(spark).rstrip('/')}/platewise-streams/{name}-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """The events table as an unbounded source.

    The table is one file or a folder of part files; files that arrive in the
    folder later are new events.
    """
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # a glob, since a stream's plain path must be a folder
    return (spark.readStream.schema(schema)
            .option("maxFilesPerTrigger", files_per_trigger)
            .parquet(f"{sf_dir}/events.parque[t]"))


def _run(writer) -> None:
    """Run until all available data is processed; a failed query raises."""
    writer.trigger(availableNow=True).start().awaitTermination()


def _latest(spark: SparkSession, root: str, keys: list[str]) -> DataFrame | None:
    """Of the rows that epochs wrote, each key's of its newest epoch; null if there are none."""
    if snapshots.latest_version(spark, root) is None:
        return None
    written = spark.read.parquet(root)
    rest = [c for c in written.columns if c not in (*keys, snapshots.VERSION_COL)]
    return written.groupBy(*keys).agg(F.max_by(F.struct(*rest), snapshots.VERSION_COL).alias("_c")).select(*keys, "_c.*")


def _keep_changes(changes: DataFrame, out: str) -> None:
    """Run an aggregate in update mode: every epoch writes the keys it changed as a version of its own (a retried
    epoch replaces it)."""
    def sink(batch: DataFrame, epoch: int) -> None:
        snapshots.write_version(batch, f"{out}/changes", epoch)

    _run(changes.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", f"{out}/_checkpoint"))


def stream_flags(spark: SparkSession, commands: DataFrame, users: DataFrame,
                 snapshot: DataFrame, out: str | None = None,
                 snap_keys: tuple[str, ...] = ("id",), cmd_keys: tuple[str, ...] = ("key",)) -> DataFrame:
    """T1: fold a command stream into flag changes, then apply them to ``snapshot``
    (venues, comments; menu rows with a two-column key)."""
    out = out or run_dir(spark, "flags")
    gated = moderation.role_gate(commands.where(F.col("action").isin(*moderation.ADMIN_ACTIONS)), users)
    _keep_changes(moderation.flag_changes(gated, list(cmd_keys)), out)
    ch = _latest(spark, f"{out}/changes", list(cmd_keys))
    if ch is None:
        return snapshot
    return moderation.apply_flag_changes(snapshot, ch, list(snap_keys), list(cmd_keys))


def stream_diet_flags(spark: SparkSession, cat: Catalog, commands: DataFrame, out: str | None = None) -> DataFrame:
    """T1 with W13: the dishes after a stream of menu-row moderation
    (id_restaurant, id_dish, action, actor, ...).

    The state is per dish: whether a command of an admin verified one of its
    menu rows.  An epoch derives the flags of the dishes that it changed,
    reading their links and menu rows only.
    """
    out = out or run_dir(spark, "diet")
    keys = ["id_restaurant", "id_dish"]
    gated = moderation.role_gate(commands.where(F.col("action").isin(*moderation.ADMIN_ACTIONS)), cat.users)
    named = gated.where("id_restaurant > 0 and id_dish > 0").join(cat.menu.select(*keys).distinct(), keys, "left_semi")
    touched = named.groupBy("id_dish").agg(F.max(F.col("action") == "VER").alias("any_ver"))

    def sink(batch: DataFrame, epoch: int) -> None:
        dishes = materialize(batch)
        one = cat.dishes.join(dishes.select(F.col("id_dish").alias("id")), "id", "left_semi")
        served = cat.menu.select("id_dish", "verified").join(dishes, "id_dish").select("id_dish", (F.col("verified") | F.col("any_ver")).alias("verified"))
        flags = moderation.derive_diet_flags(cat.with_tables(dishes=one, menu=served), dishes).select("id", "vegan", "vegetarian")
        snapshots.write_version(flags, f"{out}/changes", epoch)

    _run(touched.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", f"{out}/_checkpoint"))
    ch = _latest(spark, f"{out}/changes", ["id"])
    if ch is None:
        return cat.dishes
    new = ch.select("id", F.struct("vegan", "vegetarian").alias("_new"))
    return cat.dishes.join(new, "id", "left").withColumns(
        {c: F.coalesce(f"_new.{c}", c) for c in ("vegan", "vegetarian")}).select(*cat.dishes.columns)


def stream_locations(spark: SparkSession, location_cmds: DataFrame, coordinates: DataFrame,
                     out: str | None = None) -> DataFrame:
    """T2: keep the coordinates snapshot current under a stream of gated
    location commands (columns of :func:`moderation.location_commands`).

    An epoch rewrites the buckets it touches; commands are folded into the
    newest state, late ones into the newest that they do not reach back into
    (see ``keyed.KeyedFold``).
    """
    out = out or run_dir(spark, "locations")
    kept = keyed.KeyedFold(spark, out, coordinates, "id", location_cmds.schema, moderation.moderate_locations)
    _run(location_cmds.writeStream.foreachBatch(kept.apply).option("checkpointLocation", f"{out}/_checkpoint"))
    return kept.current()


#: commands on versions that have not been proposed yet, by version; the venue of every version, by id
_WAITING = "version long, event_id long, ts timestamp, act string, actor long"
_VENUES = "version long, key long"


def stream_hours(spark: SparkSession, log: DataFrame, hours: DataFrame, restaurants: DataFrame, users: DataFrame,
                 out: str | None = None) -> DataFrame:
    """T2: keep the hours snapshot current under a stream of proposals and of
    VER / DEL commands that name a version (:func:`moderation.moderate_hours_by_id`).

    ``log`` has the columns of proposals (event_id, ts, key, actor, mon..sun,
    special_text) and version and action, null for proposals.  Rows may come in
    any order and more than once.  A venue's proposals and commands are folded
    together, so a command needs its version's venue: an index of versions
    gives it, and a command whose version is still to come waits in another.
    """
    out = out or run_dir(spark, "hours")
    day = [T.StructField(c, hours.schema[c].dataType) for c in moderation.HOURS_COLUMNS]
    schema = T.StructType([*T.StructType.fromDDL("key long, ts timestamp, event_id long, act string, actor long, version long").fields, *day])

    def fold(state: DataFrame, commands: DataFrame) -> DataFrame:
        o = F.struct("ts", "event_id").alias("o")
        new = materialize(commands.where("act is null").dropDuplicates(["id"]).select(*moderation.HOURS_COLUMNS, o))
        return moderation.fold_hours(state, new, commands.where("act is not null").select("version", o, "act", "actor"))

    kept = keyed.KeyedFold(spark, out, hours.select(*moderation.HOURS_COLUMNS), "id_restaurant", schema, fold)
    venues = keyed.IdIndex(spark, f"{out}/venues", ["version"], _VENUES)
    waiting = keyed.IdIndex(spark, f"{out}/waiting", ["version"], _WAITING)
    if not venues.manifests.epochs():
        venues.add(hours.select(F.col("id").alias("version"), F.col("id_restaurant").alias("key")), -1)

    def sink(batch: DataFrame, epoch: int) -> None:
        b = materialize(moderation.once(batch))
        new = materialize(moderation.hours_versions(b.where("version is null"), restaurants, users))
        m = moderation.role_gate(b.where(F.col("action").isin(*moderation.ADMIN_ACTIONS) & (F.col("version") > 0)), users)
        cmds = materialize(m.select("version", "event_id", "ts", F.col("action").alias("act"), "actor"))
        fresh = new.select(F.col("id").alias("version"), F.col("id_restaurant").alias("key"))
        known = venues.lookup(cmds, epoch)
        unseen = materialize(fresh.join(venues.lookup(fresh, epoch), "version", "left_anti"))
        # commands that came before their version come now
        woken = waiting.lookup(unseen, epoch).select(*cmds.columns)
        found = cmds.join(known.unionByName(unseen).distinct(), "version").unionByName(woken.join(unseen, "version"))
        rows = new.select(F.col("id_restaurant").alias("key"), "o.ts", "o.event_id", *moderation.HOURS_COLUMNS) \
            .unionByName(found.select("key", "ts", "event_id", "act", "actor", "version"), allowMissingColumns=True)
        kept.apply(rows.select(*schema.names), epoch)
        waiting.add(cmds.join(known.unionByName(unseen), "version", "left_anti"), epoch)
        venues.add(unseen, epoch)

    _run(log.writeStream.foreachBatch(sink).option("checkpointLocation", f"{out}/_checkpoint"))
    return kept.current()


def stream_upsert_comments(spark: SparkSession, submissions: DataFrame, comments: DataFrame, restaurant_comments: DataFrame,
                           restaurants: DataFrame, users: DataFrame, out: str | None = None) -> DataFrame:
    """T2 for comment upserts: the upserted rows (of :func:`moderation.upsert_comments`)
    after a stream of submissions in any order, delivered once or more.

    Each (venue, author) has one comment, the last valid submission wins.  An
    epoch takes the next block of ids for the keys that it sees first, in the
    order of their keys; the block's end is written with the epoch, so an epoch
    that is run again hands out the same ids.
    """
    out = out or run_dir(spark, "comments")
    keys = ["res_id", "actor"]
    schema = T.StructType([*T.StructType.fromDDL("res_id long, actor long, id long, comment string, score double, is_new boolean").fields,
                           T.StructField("o", T.StructType.fromDDL("ts timestamp, event_id long"))])
    index = keyed.IdIndex(spark, f"{out}/keys", keys, schema, newest="o")
    blocks = keyed.Manifests(spark, f"{out}/blocks", "next_id long")
    if not blocks.epochs():
        existing = comments.select(F.col("id").alias("id_comment"), F.col("updated_by").alias("actor")) \
            .join(restaurant_comments.select("id_comment", F.col("id_restaurant").alias("res_id")), "id_comment") \
            .groupBy(*keys).agg(F.max("id_comment").alias("id"))
        before = F.struct(F.to_timestamp_ltz(F.lit("0001-01-01 00:00:00")).alias("ts"), F.lit(0).cast("long").alias("event_id"))
        index.add(existing.select(*keys, "id", F.lit(None).cast("string").alias("comment"), F.lit(None).cast("double").alias("score"),
                                  F.lit(False).alias("is_new"), before.alias("o")), -1)
        blocks.write(-1, [(comments.agg(F.max("id")).first()[0] or 0,)])

    def sink(batch: DataFrame, epoch: int) -> None:
        v = moderation.valid_comments(batch, restaurants, users)
        o = F.struct("ts", "event_id")
        last = materialize(v.groupBy(*keys).agg(F.max_by(F.struct("score", F.col("text").alias("comment")), o).alias("s"), F.max(o).alias("o"))
                           .select(*keys, "s.*", "o"))
        prior = index.lookup(last, epoch).select(*keys, "id", "is_new", F.col("o").alias("before"))
        j = materialize(last.join(prior, keys, "left").where("before is null or o > before"))
        start = blocks.before(epoch)[0]["next_id"]
        fresh = j.where("before is null").drop("id", "is_new")
        ins = assign_ids(fresh, keys, start=start).withColumn("is_new", F.lit(True))
        rows = j.where("before is not null").select(*schema.names).unionByName(ins.select(*schema.names))
        index.add(rows, epoch)
        blocks.write(epoch, [(start + fresh.count(),)])

    _run(submissions.writeStream.foreachBatch(sink).option("checkpointLocation", f"{out}/_checkpoint"))
    return index.rows().where("score is not null").select(
        "id", "res_id", "comment", "score", F.lit(False).alias("verified"), F.col("actor").alias("updated_by"),
        F.lit(0).cast("long").alias("verified_by"), F.lit(False).alias("deleted"), "is_new")


def stream_dedup(spark: SparkSession, commands: DataFrame, out: str | None = None) -> DataFrame:
    """T3: every event id once, whatever the order in which files and events arrive.

    Repeats within a micro-batch are dropped, then the ids that earlier epochs
    wrote (a batch reads only the buckets that may hold its ids); the rest is
    written as the epoch's own version, so a retried batch replaces its rows.
    Rows without event id are no repeats of each other: all stay.
    """
    out = out or run_dir(spark, "dedup")
    data = f"{out}/data"
    stored = T.StructType([*commands.schema.fields, T.StructField(snapshots.VERSION_COL, T.LongType())])
    spark.createDataFrame([], stored).write.mode("append").partitionBy(snapshots.VERSION_COL).parquet(data)  # readable before the first epoch
    index = keyed.IdIndex(spark, f"{out}/ids", ["event_id"], T.StructType([commands.schema["event_id"]]))

    def sink(batch: DataFrame, epoch: int) -> None:
        b = materialize(batch.where("event_id is not null").dropDuplicates(["event_id"]))
        fresh = b.join(index.lookup(b, epoch), "event_id", "left_anti").select(*b.columns)
        snapshots.write_version(fresh.unionByName(batch.where("event_id is null")), data, epoch)
        index.add(snapshots.read_version(spark, data, epoch).where("event_id is not null"), epoch)

    _run(commands.writeStream.foreachBatch(sink).option("checkpointLocation", f"{out}/_checkpoint"))
    return spark.read.schema(stored).parquet(data).drop(snapshots.VERSION_COL)
