"""Tables of runs that become visible all at once, and keyed state of which only live parts are opened.

A run writes its tables into the folder of an attempt. Nothing of it shows until the attempt is published: one
manifest file per run, renamed into place and never replaced. The newest manifest names every published attempt and
every live part of state, so a reader opens one small file and then only what it names. An attempt that broke off
is never named; its files go with the next sweep. The time of a run is noted with its first attempt and stays the same
for all, however much later they are.

State (keys seen, keys sent) is written in parts, hashed into buckets by key. Parts are read together as one bucketed
table, so joining a batch with it moves the batch only. A part carries its least and greatest time: one that has
run out as a whole is not opened. Parts of like size are merged from time to time (``fan`` of them at once),
which keeps their number logarithmic in the number of runs and rewrites a row as many times at most.

One driver writes at a time. The folder must be one that all machines share.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Files:
    """Small files and folders below a root, wherever it is stored."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return sorted(f.getPath().getName() for f in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a file that is there as a whole or not at all; False, and no change, where one is there already."""
        folder, _, last = name.rpartition("/")
        part = f"{folder}/.{last}-{uuid.uuid4().hex}"
        stream = self.fs.create(self.path(part), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        none = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self.path(part), self.path(name), none)
        except Exception:
            self.fs.delete(self.path(part), False)
            if self.fs.exists(self.path(name)):
                return False
            raise
        return True

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


@dataclass(frozen=True)
class Part:
    """A part of state: its name, rows, and least and greatest time in microseconds."""

    name: str
    rows: int
    lo: int
    hi: int


@dataclass(frozen=True)
class State:
    """Keyed state: its name, key, time column, and how merged parts are reduced (one row per key)."""

    name: str
    key: str
    time: str
    reduce: Callable[[DataFrame], DataFrame]


def live(parts: Sequence[Part], since: int | None) -> list[Part]:
    """Parts that hold a time after ``since``."""
    return [p for p in parts if p.rows and (since is None or p.hi > since)]


def to_merge(parts: Sequence[Part], fan: int) -> list[Part]:
    """Parts of the smallest tier that ``fan`` parts have reached; a tier spans a factor of ``fan`` in rows."""
    tiers: dict[int, list[Part]] = {}
    for p in parts:
        tiers.setdefault(int(math.log(max(p.rows, 1), fan)), []).append(p)
    return next((found for _, found in sorted(tiers.items()) if len(found) >= fan), [])


@dataclass(frozen=True)
class Manifest:
    """What is published up to a run. ``runs`` holds, per run, its attempt, time and tables (with the number of names)."""

    run: int = -1
    last_batch: int = -1
    runs: list[dict] = field(default_factory=list)
    state: dict[str, list[Part]] = field(default_factory=dict)

    def text(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def of(text: str) -> Manifest:
        got = json.loads(text)
        return Manifest(**got | {"state": {k: [Part(**p) for p in parts] for k, parts in got["state"].items()}})


def micros(at: datetime) -> int:
    return round(at.timestamp() * 1_000_000)


class Ledger:
    """Published runs below ``root``."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64, fan: int = 8):
        self.spark, self.root, self.buckets, self.fan = spark, root.rstrip("/"), buckets, fan
        self.files = Files(spark, root)

    def manifest(self) -> Manifest:
        names = [n for n in self.files.names("manifest") if n.endswith(".json") and not n.startswith(".")]
        return Manifest.of(self.files.read(f"manifest/{names[-1]}")) if names else Manifest()

    def folder(self, table: str) -> str:
        return f"{self.root}/tables/{table}"

    def paths(self, table: str, runs: Sequence[dict] | None = None) -> list[str]:
        """Folders of the published runs' rows below :meth:`folder`."""
        runs = self.manifest().runs if runs is None else runs
        return [f"{self.folder(table)}/attempt={r['attempt']}" for r in runs if r["tables"].get(table)]

    def table(self, name: str) -> DataFrame | None:
        """Rows of all published runs with ``batch``, the run; None where there is none."""
        paths = self.paths(name)
        if not paths:
            return None
        df = self.spark.read.option("basePath", self.folder(name)).parquet(*paths)
        return df.withColumn("batch", F.substring_index("attempt", "-", 1).cast("long")).drop("attempt")

    def parts(self, state: State, parts: Sequence[Part]) -> DataFrame:
        """Some parts of state as one table that is bucketed by the key."""
        folder = f"{self.root}/state/{state.name}"
        shape = self.spark.read.parquet(f"{folder}/part={parts[0].name}").schema
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shape)
        name = f"postmill_state_{uuid.uuid4().hex}"
        self.spark.sql(
            f"CREATE TABLE {name} ({columns}, part STRING) USING parquet PARTITIONED BY (part) "
            f"CLUSTERED BY (`{state.key}`) SORTED BY (`{state.key}`) INTO {self.buckets} BUCKETS LOCATION '{folder}'"
        )
        added = " ".join(f"PARTITION (part='{p.name}') LOCATION '{folder}/part={p.name}'" for p in parts)
        self.spark.sql(f"ALTER TABLE {name} ADD {added}")
        return self.spark.table(name).drop("part")

    def state(self, state: State, since: int | None = None, manifest: Manifest | None = None) -> DataFrame | None:
        """State rows after ``since``, out of parts that hold any; None where no part does."""
        found = live((manifest or self.manifest()).state.get(state.name, []), since)
        if not found:
            return None
        df = self.parts(state, found)
        return df if since is None else df.where(F.unix_micros(F.col(state.time).cast("timestamp")) > since)

    def begin(self, run: int, time: datetime) -> Attempt:
        """A new attempt at a run. The first one's time holds for all."""
        self.files.create(f"intent/{run:012d}", time.isoformat())
        return Attempt(self, run, datetime.fromisoformat(self.files.read(f"intent/{run:012d}")))

    def sweep(self) -> None:
        """Remove what no manifest names any more: attempts that broke off, tables and parts that were taken out."""
        now = self.manifest()
        for name in self.files.names("manifest")[:-1]:
            self.files.remove(f"manifest/{name}")
        for name in self.files.names("intent"):
            if int(name.lstrip(".").partition("-")[0]) <= now.run:
                self.files.remove(f"intent/{name}")
        for table in self.files.names("tables"):
            kept = {f"attempt={r['attempt']}" for r in now.runs if table in r["tables"]}
            for attempt in set(self.files.names(f"tables/{table}")) - kept:
                self.files.remove(f"tables/{table}/{attempt}")
        for state in self.files.names("state"):
            kept = {f"part={p.name}" for p in now.state.get(state, [])}
            for part in set(self.files.names(f"state/{state}")) - kept:
                self.files.remove(f"state/{state}/{part}")


class Attempt:
    """An attempt at a run, on top of what is published now."""

    def __init__(self, ledger: Ledger, run: int, time: datetime):
        self.ledger, self.run, self.time = ledger, run, time
        self.before = ledger.manifest()
        if self.before.run >= run:
            raise ValueError(f"run {run} is published already")
        self.name = f"{run:012d}-{uuid.uuid4().hex}"
        self.tables: dict[str, int] = {}
        self.parts: dict[str, list[Part]] = {k: list(v) for k, v in self.before.state.items()}
        self.runs = [r | {"tables": dict(r["tables"])} for r in self.before.runs]

    def path(self, table: str, names: int = 1) -> str:
        """The folder of a table of this attempt, which the manifest will name."""
        self.tables[table] = names
        return f"{self.ledger.folder(table)}/attempt={self.name}"

    def write(self, df: DataFrame, table: str) -> DataFrame:
        """Write a table and read it back, which also cuts the lineage."""
        path = self.path(table)
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def earlier(self, state: State, since: int | None = None) -> DataFrame | None:
        return self.ledger.state(state, since, self.before)

    def add(self, state: State, df: DataFrame, since: int | None = None) -> DataFrame:
        """Add rows to a state; parts without a time after ``since`` go, and like parts are merged. Gives the added rows."""
        own, added = self._write(state, df, "")
        parts = [*live(self.parts.get(state.name, []), since), *live([own], since)]
        if found := to_merge(parts, self.ledger.fan):
            rows = self.ledger.parts(state, found)
            if since is not None:
                rows = rows.where(F.unix_micros(F.col(state.time).cast("timestamp")) > since)
            merged, _ = self._write(state, state.reduce(rows), "-merged")
            parts = [merged, *[p for p in parts if p not in found]]
        self.parts[state.name] = live(parts, since)
        return added

    def _write(self, state: State, df: DataFrame, suffix: str) -> tuple[Part, DataFrame]:
        name, spark = f"{self.name}{suffix}", df.sparkSession
        path, table = f"{self.ledger.root}/state/{state.name}/part={name}", f"postmill_part_{uuid.uuid4().hex}"
        buckets = self.ledger.buckets
        # one file per bucket: rows are dealt as the buckets are
        dealt = df.repartition(buckets, state.key)
        dealt.write.format("parquet").bucketBy(buckets, state.key).sortBy(state.key).option("path", path).saveAsTable(table)
        spark.sql(f"DROP TABLE {table}")  # the files stay
        rows = spark.read.schema(df.schema).parquet(path)
        at = F.unix_micros(F.col(state.time).cast("timestamp"))
        n, lo, hi = rows.agg(F.count(F.lit(1)), F.min(at), F.max(at)).first()
        return Part(name, n, lo or 0, hi or 0), rows

    def remove(self, table: str, gone: Callable[[datetime], bool]) -> int:
        """Take a table of earlier runs out of the manifest by the time of the run; gives the number of its names."""
        n = 0
        for r in self.runs:
            if table in r["tables"] and gone(datetime.fromisoformat(r["time"])):
                n += r["tables"].pop(table)
        return n

    def drop_parts(self, state: str, until: int) -> int:
        """Take out the parts of which no row is younger than ``until``; gives the number of their rows."""
        gone = [p for p in self.parts.get(state, []) if p.hi < until]
        self.parts[state] = [p for p in self.parts.get(state, []) if p.hi >= until]
        return sum(p.rows for p in gone)

    def mine(self) -> dict:
        """This run as the manifest will tell it."""
        return {"run": self.run, "attempt": self.name, "time": self.time.isoformat(), "tables": self.tables}

    def publish(self, last_batch: int) -> None:
        """Make everything that was written visible, in one step."""
        told = Manifest(self.run, last_batch, [*self.runs, self.mine()], self.parts)
        if not self.ledger.files.create(f"manifest/{self.run:012d}.json", told.text()):
            raise ValueError(f"run {self.run} was published by another attempt")
        self.ledger.sweep()


def take_in(stream: DataFrame, ledger: Ledger) -> tuple[DataFrame | None, int, int | None]:
    """Write what a stream has brought since the last call below ``arrived``; gives all rows that no published run has
    taken, the last batch that one has, and the newest batch (None where there is nothing new)."""
    spark, folder = stream.sparkSession, f"{ledger.root}/arrived"

    def append(df: DataFrame, i: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/batch={i}")

    stream.writeStream.foreachBatch(append).option("checkpointLocation", f"{ledger.root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    last = ledger.manifest().last_batch
    if not ledger.files.names("arrived"):
        return None, last, None
    new = spark.read.parquet(folder).where(F.col("batch") > last)
    newest = new.agg(F.max("batch")).first()[0]  # one row: the last batch taken in
    return new.drop("batch"), last, newest
