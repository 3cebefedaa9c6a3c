"""Tables that a stream keeps: written per epoch, in hash buckets that double.

``IdIndex`` answers which rows of earlier epochs have given ids, and reads only
the buckets that may hold them: every run (the rows of an epoch, or of merged
epochs) has a Bloom filter per page of ids.  Runs merge like a binary counter,
so a row is rewritten log2(epochs) times and as many runs are probed.

``KeyedFold`` keeps the result of an order-dependent fold (per key, in the
order of ts and event_id) under commands that arrive in any order.  A bucket's
state as of an epoch is a base: it holds every command up to some place in the
order.  Commands that come in order are folded into the newest base and read
once; late ones re-open the newest base before them, and the log is read from
there.  Older bases are thinned out to exponential distances.

Both are idempotent per epoch: everything is read from the manifest of an
earlier epoch, written below the epoch's own name, and the epoch's manifest
comes last; a killed epoch that is run again writes the same.  Only manifests
(a row per bucket and base or run) pass through the driver.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ids of a Bloom page (its bitmap has 32768 places), and places an id sets
PAGE_IDS, PLACES = 3000, 4
#: rows of a bucket, about
BUCKET_ROWS = 200_000
#: log runs of a bucket before they are merged
LOG_RUNS = 8


def _bits(rows: int, each: int) -> int:
    """Bits that number enough buckets of ``each`` rows."""
    return max(0, -(-rows // each) - 1).bit_length()


def _bucket(columns: list[str], bits: int) -> Column:
    return F.xxhash64(*columns).bitwiseAND(F.lit((1 << bits) - 1))


def _order() -> Column:
    """A command's place in the order."""
    return F.struct(F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("event_id"))


class Manifests:
    """Small tables, one an epoch."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def write(self, epoch: int, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/epoch={epoch}")

    def of(self, epoch: int) -> list:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/epoch={epoch}").collect()

    def before(self, epoch: int | None = None) -> list:
        """The rows of the newest epoch (before ``epoch``)."""
        found = [e for e in self.epochs() if epoch is None or e < epoch]
        return self.of(max(found)) if found else []

    def epochs(self) -> list[int]:
        """Epochs whose manifest is complete."""
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        if not fs.exists(root):
            return []
        folders = [s.getPath() for s in fs.listStatus(root)]
        return [int(f.getName().split("=")[1]) for f in folders
                if f.getName().startswith("epoch=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS"))]


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)


class IdIndex:
    """Rows (of ``schema``) found by ``ids``.

    With ``newest`` (a column) a merge keeps only each id's row with the
    largest value of it; otherwise all rows stay.
    """

    def __init__(self, spark: SparkSession, path: str, ids: list[str], schema: T.StructType | str, newest: str | None = None):
        self.spark, self.path, self.ids, self.newest = spark, path, ids, newest
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.manifests = Manifests(spark, f"{path}/manifest", "run string, rows long, bits int, page_bits int")

    def _rows(self, runs: list) -> DataFrame:
        return self._at([f"{self.path}/rows/run={r['run']}" for r in runs])

    def _at(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        stored = T.StructType([*self.schema.fields, T.StructField("run", T.StringType()), T.StructField("bucket", T.LongType())])
        return self.spark.read.schema(stored).option("basePath", f"{self.path}/rows").parquet(*paths).select(*self.schema.names)

    def rows(self) -> DataFrame:
        """All rows."""
        return self._newest(self._rows(self.manifests.before()))

    def _newest(self, rows: DataFrame) -> DataFrame:
        if not self.newest:
            return rows
        rest = [c for c in rows.columns if c not in self.ids]
        best = rows.groupBy(*self.ids).agg(F.max_by(F.struct(*rest), self.newest).alias("_r"))
        return best.select(*self.ids, "_r.*").select(*rows.columns)

    def _places(self) -> list[Column]:
        return [F.xxhash64(*self.ids, F.lit(j)).bitwiseAND(F.lit(32767)) for j in range(PLACES)]

    def buckets(self, ids: DataFrame, epoch: int) -> list[tuple[str, int]]:
        """The (run, bucket) pairs of earlier epochs that may hold one of the ids."""
        runs = self.manifests.before(epoch)
        if not runs:
            return []
        filters = self.spark.read.schema("page long, bits binary, run string").parquet(*(f"{self.path}/filters/{r['run']}" for r in runs))
        each = F.explode(F.array(*(F.struct(F.lit(r["run"]).alias("run"), F.lit(r["bits"]).alias("bits"), F.lit(r["page_bits"]).alias("page_bits"))
                                   for r in runs))).alias("r")
        asked = ids.select(*self.ids, F.xxhash64(*self.ids).alias("h"), F.array(*self._places()).alias("places"), each) \
            .select("places", F.col("r.run").alias("run"), F.expr("h & (shiftleft(1L, r.page_bits) - 1)").alias("page"),
                    F.expr("h & (shiftleft(1L, r.bits) - 1)").alias("bucket"))
        set_ = F.expr("forall(places, p -> shiftright(cast(conv(hex(substring(bits, cast(p div 8 as int) + 1, 1)), 16, 10) as int), cast(p % 8 as int)) % 2 = 1)")
        found = asked.join(filters, ["run", "page"]).where(set_).select("run", "bucket").distinct()
        return sorted((r["run"], r["bucket"]) for r in found.collect())

    def lookup(self, ids: DataFrame, epoch: int) -> DataFrame:
        """The rows of earlier epochs that have one of the ids."""
        found = self.buckets(ids, epoch)
        if not found:
            return self.spark.createDataFrame([], self.schema)
        held = self._at([f"{self.path}/rows/run={run}/bucket={bucket}" for run, bucket in found])
        return self._newest(held.join(ids.select(*self.ids).distinct(), self.ids, "left_semi"))

    def add(self, rows: DataFrame, epoch: int) -> None:
        """Store the epoch's rows."""
        runs = self.manifests.before(epoch)
        size = rows.count()
        merged = []
        while size and runs and runs[-1]["rows"] <= 2 * (size + sum(r["rows"] for r in merged)):
            merged.append(runs.pop())
        if size:
            whole = self._newest(rows.select(*self.schema.names).unionByName(self._rows(merged))) if merged else rows.select(*self.schema.names)
            size += sum(r["rows"] for r in merged)
            bits, page_bits, run = _bits(size, BUCKET_ROWS), max(_bits(size, BUCKET_ROWS), _bits(size, PAGE_IDS)), f"run-{epoch}"
            target = f"{self.path}/rows/run={run}"
            whole.withColumn("bucket", _bucket(self.ids, bits)).repartition(F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(target)
            stored = self._rows([{"run": run}])
            stored.select(_bucket(self.ids, page_bits).alias("page"), F.explode(F.array(*self._places())).alias("place")) \
                .groupBy("page").agg(F.bitmap_construct_agg("place").alias("bits")).withColumn("run", F.lit(run)) \
                .write.mode("overwrite").parquet(f"{self.path}/filters/{run}")
            runs.append({"run": run, "rows": size, "bits": bits, "page_bits": page_bits})
        self.manifests.write(epoch, [(r["run"], r["rows"], r["bits"], r["page_bits"]) for r in runs])


@dataclass(frozen=True)
class _Part:
    """A base (``kind`` state) or a log run of a bucket: where it lies and the largest place in the order it holds."""

    kind: str
    bucket: int
    epoch: int
    bits: int
    rows: int
    ts: dt.datetime | None
    event_id: int | None

    @property
    def upto(self):
        return (self.ts, self.event_id) if self.ts is not None else None

    def path(self, root: str) -> str:
        return f"{root}/{self.kind}/epoch={self.epoch}/bucket={self.bucket & ((1 << self.bits) - 1)}"


class KeyedFold:
    """The state table of a fold over commands.

    ``fold(state, commands)`` gives the new state of the same keys; folding a
    log in parts, in order, must equal folding it whole, and repeated commands
    must not matter.  Commands have ``key``, ts and event_id; state rows have
    ``state_key``.  Keys without state rows are folded too.
    """

    def __init__(self, spark: SparkSession, path: str, state: DataFrame, state_key: str, commands: T.StructType,
                 fold: Callable[[DataFrame, DataFrame], DataFrame]):
        self.spark, self.path, self.state_key, self.fold = spark, path, state_key, fold
        self.state_schema, self.log_schema = state.schema, commands
        self.manifests = Manifests(spark, f"{path}/manifest", "kind string, bucket long, epoch long, bits int, rows long, ts timestamp, event_id long")
        self.read_rows = 0  # log rows read so far, the batches' own included
        if not self.manifests.before():
            bits = _bits(state.count(), BUCKET_ROWS)
            rows = self._write(state, "state", -1, state_key, bits)
            self.manifests.write(-1, [self._row(_Part("state", b, -1, bits, rows.get(b, 0), None, None)) for b in range(1 << bits)])

    @staticmethod
    def _row(p: _Part) -> tuple:
        return p.kind, p.bucket, p.epoch, p.bits, p.rows, p.ts, p.event_id

    def _write(self, df: DataFrame, kind: str, epoch: int, key: str, bits: int) -> dict[int, int]:
        """Write in buckets; rows of each."""
        target = f"{self.path}/{kind}/epoch={epoch}"
        df.withColumn("bucket", _bucket([key], bits)).repartition(F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(target)
        stored = self.spark.read.schema(T.StructType([*df.schema.fields, T.StructField("bucket", T.LongType())])).parquet(target)
        return {r["bucket"]: r["count"] for r in stored.groupBy("bucket").count().collect()}

    def _read(self, parts: list[_Part], key: str, schema: T.StructType, bits: int, above: dict[int, tuple | None] | None = None) -> DataFrame:
        """The rows of the parts that belong to the parts' own buckets (a part written with fewer buckets holds
        others' rows too); with ``above``, those beyond its place in the order only."""
        paths = sorted({p.path(self.path) for p in parts if p.rows})
        if not paths:
            return self.spark.createDataFrame([], schema)
        stored = T.StructType([*schema.fields, T.StructField("epoch", T.LongType()), T.StructField("bucket", T.LongType())])
        rows = self.spark.read.schema(stored).option("basePath", f"{self.path}/{parts[0].kind}").parquet(*paths)
        wanted = [(p.bucket, p.epoch, *((above or {}).get(p.bucket) or (None, None))) for p in parts]
        wanted = self.spark.createDataFrame(wanted, "_bucket long, epoch long, _ts timestamp, _event long")  # a row a part
        rows = rows.drop("bucket").withColumn("_bucket", _bucket([key], bits)).join(F.broadcast(wanted), ["_bucket", "epoch"])
        if above is not None:
            rows = rows.where(F.col("_ts").isNull() | (_order() > F.struct(F.col("_ts").alias("ts"), F.col("_event").alias("event_id"))))
        return rows.select(*schema.names)

    def apply(self, batch: DataFrame, epoch: int) -> None:
        """Fold an epoch's commands.  Commands without ts or event_id have no place in the order and take no part."""
        parts = [_Part(**r.asDict()) for r in self.manifests.before(epoch)]
        bits = _width(parts)
        self._write(batch.select(*self.log_schema.names).where("ts is not null and event_id is not null"), "run", epoch, "key", bits)
        order = _order()
        stored = T.StructType([*self.log_schema.fields, T.StructField("bucket", T.LongType())])
        facts = self.spark.read.schema(stored).parquet(f"{self.path}/run/epoch={epoch}").groupBy("bucket").agg(
            F.count("*").alias("rows"), F.min(order).alias("first"), F.max(order).alias("last")).collect()
        touched = {r["bucket"] for r in facts}
        bases, replay, above, runs, states = [], [], {}, [], []
        for fact in facts:
            own = _Part("run", fact["bucket"], epoch, bits, fact["rows"], *fact["last"])
            mine = [p for p in parts if p.bucket == own.bucket]
            # bases that the batch does not reach back into
            valid = [p for p in mine if p.kind == "state" and (p.upto is None or p.upto < tuple(fact["first"]))]
            base = max(valid, key=lambda p: p.epoch)
            logged = [p for p in mine if p.kind == "run"]
            bases.append(base)
            replay += [own, *(p for p in logged if base.upto is None or p.upto > base.upto)]
            above[own.bucket] = base.upto
            runs += [own, *logged]
            states += [*_thinned(valid, epoch), _Part("state", own.bucket, epoch, bits, 0, *max(p.upto for p in (own, *logged)))]
        if facts:
            self.read_rows += sum(p.rows for p in replay)
            log = self._read(replay, "key", self.log_schema, bits, above)
            rows = self._write(self.fold(self._read(bases, self.state_key, self.state_schema, bits), log), "state", epoch, self.state_key, bits)
            states = [replace(p, rows=rows.get(p.bucket, 0)) if p.epoch == epoch else p for p in states]
            runs = self._merged(runs, epoch, bits)
        parts = [*(p for p in parts if p.bucket not in touched), *states, *runs]
        if sum(p.rows for p in (*_newest(parts), *(p for p in parts if p.kind == "run"))) > BUCKET_ROWS << bits:
            # each half of a bucket has the parts of the whole, and reads its own rows of them
            parts = [replace(p, bucket=p.bucket + half) for p in parts for half in (0, 1 << bits)]
        self.manifests.write(epoch, [self._row(p) for p in parts])
        self._clear()

    def _merged(self, runs: list[_Part], epoch: int, bits: int) -> list[_Part]:
        """Buckets with many log runs have the newest of them merged, as long as the next is not twice as large:
        a command is rewritten log2(epochs) times."""
        chosen = []
        for bucket in {p.bucket for p in runs}:
            mine = sorted((p for p in runs if p.bucket == bucket), key=lambda p: -abs(p.epoch))
            if len(mine) > LOG_RUNS:
                some = [mine[0]]
                while len(some) < len(mine) and mine[len(some)].rows <= 2 * sum(p.rows for p in some):
                    some.append(mine[len(some)])
                chosen += some if len(some) > 1 else []
        if not chosen:
            return runs
        self.read_rows += sum(p.rows for p in chosen)
        name = -epoch - 2  # a folder that no epoch's own run has
        rows = self._write(self._read(chosen, "key", self.log_schema, bits), "run", name, "key", bits)
        out = [p for p in runs if p not in chosen]
        for bucket in {p.bucket for p in chosen}:
            out.append(_Part("run", bucket, name, bits, rows[bucket], *max(p.upto for p in chosen if p.bucket == bucket)))
        return out

    def _clear(self) -> None:
        """Remove the folders that only the manifest before the last two names: an epoch that is run again reads those."""
        epochs = sorted(self.manifests.epochs())
        if len(epochs) > 2:
            old, *recent = ({_Part(**r.asDict()).path(self.path) for r in self.manifests.of(e)} for e in epochs[-3:])
            for path in old.difference(*recent):
                _delete(self.spark, path)

    def current(self) -> DataFrame:
        """The state after the newest epoch."""
        parts = [_Part(**r.asDict()) for r in self.manifests.before()]
        return self._read(_newest(parts), self.state_key, self.state_schema, _width(parts))


def _width(parts: list[_Part]) -> int:
    """Bits that number the buckets now (every bucket has a base)."""
    return len({p.bucket for p in parts}).bit_length() - 1


def _newest(parts: list[_Part]) -> list[_Part]:
    """The newest base of every bucket."""
    return list({p.bucket: p for p in sorted((p for p in parts if p.kind == "state"), key=lambda p: p.epoch)}.values())


def _thinned(bases: list[_Part], epoch: int) -> list[_Part]:
    """The first base, and of the others two for each power of two of their age in epochs."""
    kept, ages = [], {}
    for p in sorted(bases, key=lambda p: -p.epoch):
        age = (epoch - p.epoch).bit_length()
        ages[age] = ages.get(age, 0) + 1
        if ages[age] <= 2 or p.upto is None:
            kept.append(p)
    return kept
