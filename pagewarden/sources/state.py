"""State between runs: tables that change together, run history, a lease with fencing, stage accounts.

A manifest names the version of every table. A commit writes new versions beside the old ones and its manifest last, in one
rename; readers take the tables of the newest manifest, so that they see a run's tables all or not at all. Versions that no kept
manifest names (of a commit that died, or old ones) are dropped by the next commit.

A lease has an epoch, which grows with each holder, and a time at which it ends unless it is renewed. A manifest carries the epoch
of its writer in its name: a holder whose lease was taken over is refused, and a manifest that it got in all the same is
older than those of the newer epoch and never is the newest.

A table that is saved by keys is bucketed and sorted by them, one file a bucket; its layout is in the manifest, so that any session
reads it as such. A join on these keys moves and sorts the other side only, however large the kept one has grown.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LEASE_SECONDS, KEPT = 6 * 3600.0, 2


class StateError(RuntimeError):
    """State that can't be read."""


class LockedError(RuntimeError):
    """Another run holds the lock."""


class FencedError(LockedError):
    """The lease ended or was taken over; nothing is written any more."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


class Lease:
    """The right to write, of one epoch."""

    def __init__(self, state: State, epoch: int, seconds: float):
        self.state, self.epoch, self.seconds = state, epoch, seconds

    def renew(self) -> None:
        self.check()
        self.state._write(f"lease/{self.epoch:012d}.json", {"until": self.state.clock() + self.seconds})

    def check(self) -> None:
        """An error unless this still is the newest epoch."""
        if self.state._epochs()[-1] != self.epoch or self.state._lease(self.epoch).get("released"):
            raise FencedError(f"epoch {self.epoch} of {self.state.root} was taken over")

    def release(self) -> None:
        if self.state._epochs()[-1] == self.epoch:
            self.state._write(f"lease/{self.epoch:012d}.json", {"until": 0, "released": True})


class Commit:
    """New versions of some tables, to be seen together."""

    def __init__(self, state: State, lease: Lease | None):
        self.state, self.lease, self.made, self.layouts = state, lease, {}, {}

    def save(self, name: str, df: DataFrame, keys: list[str] | None = None, buckets: int | None = None) -> int:
        """keys: the table is bucketed and sorted by them, in as many buckets as shuffles have partitions unless told otherwise."""
        if self.lease is not None:
            self.lease.check()
        version = max([0, *self.state._written(name)]) + 1
        path = self.state._path(name, version)
        self.layouts.pop(name, None)
        if keys:
            n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            layout = {"keys": list(keys), "buckets": n, "columns": [[f.name, f.dataType.simpleString()] for f in df.schema]}
            # The partitioning is that of the buckets: a task writes one file.
            dealt = df.repartition(n, *keys).write.bucketBy(n, *keys).sortBy(*keys).format("parquet").option("path", path)
            dealt.saveAsTable(self.state._table(name, version))
            self.layouts[name] = layout
        else:
            df.write.parquet(path)
        self.made[name] = version
        return version


class State:
    """Tables under a root that any Hadoop file system can hold whose rename is atomic."""

    def __init__(self, spark: SparkSession, root: str, *, kept: int = KEPT, clock=time.time):
        self.spark, self.root, self.kept, self.clock = spark, root.rstrip("/"), kept, clock

    def _path(self, name: str, version: int) -> str:
        return f"{self.root}/{name}/v{version}"

    def _table(self, name: str, version: int) -> str:
        """The name under which this session knows a bucketed version."""
        return f"state_{hashlib.sha256(self.root.encode()).hexdigest()[:16]}_{name}_v{version}"

    def _known(self, name: str, version: int, layout: dict) -> DataFrame:
        """A bucketed version as a table; a session that didn't write it is told of its layout."""
        columns = ", ".join(f"`{c}` {kind}" for c, kind in layout["columns"])
        keys = ", ".join(f"`{k}`" for k in layout["keys"])
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self._table(name, version)} ({columns}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {layout['buckets']} BUCKETS LOCATION '{self._path(name, version)}'")
        return self.spark.table(self._table(name, version))

    def _names(self, folder: str) -> list[str]:
        fs, p = _fs(self.spark, f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _written(self, name: str) -> list[int]:
        return sorted(int(n[1:]) for n in self._names(name) if n[:1] == "v" and n[1:].isdigit())

    def _read(self, path: str) -> dict:
        fs, p = _fs(self.spark, f"{self.root}/{path}")
        try:
            stream = fs.open(p)
            try:
                return json.loads(bytes(stream.readAllBytes()).decode())
            finally:
                stream.close()
        except Exception as e:
            raise StateError(f"{path}: {e}") from e

    def _write(self, path: str, held: dict, new: bool = False) -> bool:
        """Writes a small file whole, by a rename; new: False if there is one of that name."""
        fs, p = _fs(self.spark, f"{self.root}/{path}")
        _, beside = _fs(self.spark, f"{self.root}/.new-{uuid.uuid4().hex}")
        fs.mkdirs(p.getParent())
        if new and not fs.createNewFile(p):
            return False
        stream = fs.create(beside)
        stream.write(json.dumps(held).encode())
        stream.close()
        if fs.exists(p):
            fs.delete(p, False)
        if not fs.rename(beside, p):
            raise StateError(f"{path} can't be written")
        return True

    def _epochs(self) -> list[int]:
        return [0, *[int(n.split(".")[0]) for n in self._names("lease") if n.endswith(".json")]]

    def _lease(self, epoch: int) -> dict:
        try:
            return self._read(f"lease/{epoch:012d}.json")
        except StateError:
            return {"until": self.clock() + 60}  # it is just being written

    def manifests(self) -> list[dict]:
        """Those that are kept, the newest last: epoch, run, tables by name."""
        return [self._read(f"manifests/{n}") | {"name": n} for n in self._names("manifests") if n.endswith(".json")]

    def acquire(self, seconds: float = LEASE_SECONDS) -> Lease:
        """The lease of a new epoch, if the one before was released or ended."""
        epoch = self._epochs()[-1]
        if epoch:
            held = self._lease(epoch)
            if not held.get("released") and held["until"] > self.clock():
                raise LockedError(self.root)
        if not self._write(f"lease/{epoch + 1:012d}.json", {"until": self.clock() + seconds}, new=True):
            raise LockedError(self.root)
        for old in self._epochs()[1:-3]:
            fs, p = _fs(self.spark, f"{self.root}/lease/{old:012d}.json")
            fs.delete(p, False)
        return Lease(self, epoch + 1, seconds)

    @contextmanager
    def lock(self, seconds: float = LEASE_SECONDS):
        lease = self.acquire(seconds)
        try:
            yield lease
        finally:
            lease.release()

    @contextmanager
    def commit(self, lease: Lease | None = None, run: str = ""):
        """Tables that are saved within are seen together when the block ends, and not at all if it fails."""
        made = Commit(self, lease)
        yield made
        before = self.manifests()
        newest = before[-1] if before else {"epoch": 0, "tables": {}, "name": ""}
        epoch = lease.epoch if lease is not None else newest["epoch"]
        if lease is not None:
            lease.check()
        if newest["epoch"] > epoch:
            raise FencedError(f"epoch {newest['epoch']} has written {self.root}")
        number = int(newest["name"].split("-")[1].split(".")[0]) + 1 if newest["name"] and newest["epoch"] == epoch else 1
        if not self._write(f"manifests/{epoch:012d}-{number:06d}.json", {"epoch": epoch, "run": run, "tables": newest["tables"] | made.made, "layouts": {k: v for k, v in newest.get("layouts", {}).items() if k not in made.made} | made.layouts}, new=True):
            raise FencedError(f"another commit of epoch {epoch} was written meanwhile")
        self._dropped()

    def _dropped(self) -> None:
        """Deletes manifests beyond those that are kept, and versions that none of them names."""
        names = [n for n in self._names("manifests") if n.endswith(".json")]
        for n in names[: -self.kept]:
            fs, p = _fs(self.spark, f"{self.root}/manifests/{n}")
            fs.delete(p, False)
        held: dict[str, set[int]] = {}
        for m in self.manifests():
            for name, version in m["tables"].items():
                held.setdefault(name, set()).add(version)
        for name in self._names(""):
            if name not in ("manifests", "lease", "run_history", "crawls") and not name.startswith("."):
                for version in self._written(name):
                    if version not in held.get(name, ()):
                        self.spark.sql(f"DROP TABLE IF EXISTS {self._table(name, version)}")  # the session's; the files are next
                        fs, p = _fs(self.spark, self._path(name, version))
                        fs.delete(p, True)

    def versions(self, name: str) -> list[int]:
        """Versions of a table that kept manifests name, the newest manifest's last."""
        named = [m["tables"][name] for m in self.manifests() if name in m["tables"]]
        return list(dict.fromkeys(reversed(named)))[::-1]

    def save(self, name: str, df: DataFrame) -> int:
        """A commit of one table."""
        with self.commit() as c:
            return c.save(name, df)

    def load(self, name: str, schema: StructType | str, back: int = 0) -> DataFrame:
        """The newest version (or back of them before it); an empty table if there is none."""
        found = self.versions(name)
        if len(found) <= back:
            return self.spark.createDataFrame([], schema)
        layout = next((m["layouts"][name] for m in self.manifests() if m["tables"].get(name) == found[-1 - back] and name in m.get("layouts", {})), None)
        try:
            if layout is not None:
                want = self.spark.createDataFrame([], schema).schema
                known = self._known(name, found[-1 - back], layout)
                # Columns that an older version lacks are null.
                return known.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in known.columns and known.schema[f.name].dataType != f.dataType else F.col(f.name) if f.name in known.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in want])
            return self.spark.read.schema(schema).parquet(self._path(name, found[-1 - back]))
        except Exception as e:
            raise StateError(f"{name}: {e}") from e

    def append_history(self, events: DataFrame) -> None:
        events.withColumn("recorded_at", F.current_timestamp()).write.mode("append").json(f"{self.root}/run_history")

    def history(self, schema: str, most: int = 50) -> DataFrame:
        fs, p = _fs(self.spark, f"{self.root}/run_history")
        if not fs.exists(p):
            return self.spark.createDataFrame([], f"{schema}, recorded_at timestamp")
        return self.spark.read.schema(f"{schema}, recorded_at timestamp").json(f"{self.root}/run_history").orderBy(F.desc("recorded_at")).limit(most)


def accounted(df: DataFrame, stage: str, failed=None) -> tuple[DataFrame, Observation]:
    """df whose rows, and failed rows, are counted as they pass; the counts are ready after an action."""
    seen = Observation(stage)
    bad = F.count_if(failed) if failed is not None else F.lit(0).cast("bigint")
    return df.observe(seen, F.count(F.lit(1)).alias("processed"), (bad if failed is not None else F.count(F.when(F.lit(False), 1))).alias("failed")), seen


def read_fixture(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document or array of them, by an explicit schema; a malformed one is an error."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def report_files(spark: SparkSession, root: str, pattern: str = "*.xlsx") -> DataFrame:
    """(path, name, modified, bytes) of the reports under a folder; what a path names outside it isn't there."""
    if ".." in pattern or "/" in pattern:
        raise ValueError("a pattern of file names is needed")
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root)
    return files.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))


def state_payload(rows: DataFrame, issue_type: str, by: str = "verdict") -> DataFrame:
    """One JSON document of counts by verdict, keys sorted."""
    counts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).agg(F.sort_array(F.collect_list(F.struct(by, "n"))).alias("c"))
    return counts.select(F.to_json(F.struct(F.lit("1.0").alias("schema_version"), F.lit(issue_type).alias("issue_type"), F.map_from_entries("c").alias("counts"))).alias("payload"))


def pretty(row: dict) -> str:
    return json.dumps(row, ensure_ascii=False, sort_keys=True, indent=2)
