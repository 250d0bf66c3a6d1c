"""Memoised results and task graphs, kept as Parquet under a digest of what
they were made from, with a manifest of their inputs."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from types import CodeType

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def digest(name: str, options: dict) -> str:
    return hashlib.sha256(json.dumps([name, options], sort_keys=True, default=str).encode()).hexdigest()[:24]


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _made_at(spark: SparkSession, path: str) -> float | None:
    """When a path was last written, in seconds; None where it isn't there."""
    files, where = _files(spark, path)
    return files.getFileStatus(where).getModificationTime() / 1000 if files.exists(where) else None


def is_fresh(spark: SparkSession, path: str, expiration: float | None = None, check: list[str] = ()) -> bool:
    """Whether a result is complete (its committer has marked it so), no older
    than so many seconds, and no older than any of the paths it is made from."""
    made = _made_at(spark, f"{path}/_SUCCESS")
    if made is None or (expiration is not None and time.time() - made > expiration):
        return False
    return all((at := _made_at(spark, p)) is None or at <= made for p in check)


def files_of(df: DataFrame) -> list[str]:
    """The files that a frame is read from, as paths (Spark names them as
    URIs, in which a blank is ``%20``)."""
    jvm = df.sparkSession._jvm
    return sorted(jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)).toString() for f in df.inputFiles())


# What a result is made from --------------------------------------------------------


def state_of(spark: SparkSession, paths: list[str]) -> dict[str, list | None]:
    """Of each path all its files' sizes and times, as one digest with their
    number and bytes; None where there is none. What one file of many has
    become, or that one is gone or new, changes it."""
    out: dict[str, list | None] = {}
    for path in sorted(set(paths)):
        files, where = _files(spark, path)
        if not files.exists(where):
            out[path] = None
            continue
        listed, seen, size = files.listFiles(where, True), [], 0
        while listed.hasNext():
            f = listed.next()
            name = f.getPath().toString()
            if not f.getPath().getName().startswith((".", "_")):
                seen.append((name, f.getLen(), f.getModificationTime()))
                size += f.getLen()
        out[path] = [hashlib.sha256(repr(sorted(seen)).encode()).hexdigest()[:24], len(seen), size]
    return out


def code_digest(f: Callable) -> str:
    """Of a function's instructions and constants, those of functions inside
    it, and the plain values it closes over. Where it stands doesn't count, and
    neither do the functions that it calls."""

    def parts(code: CodeType) -> list:
        consts = [parts(c) if isinstance(c, CodeType) else repr(sorted(c, key=repr) if isinstance(c, (frozenset, set)) else c) for c in code.co_consts]
        return [code.co_code.hex(), list(code.co_names), list(code.co_varnames), consts]

    f = getattr(f, "func", f)
    code = getattr(f, "__code__", None)
    held = [c.cell_contents for c in (getattr(f, "__closure__", None) or ())]
    plain = [x for x in [*held, *(getattr(f, "__defaults__", None) or ())] if isinstance(x, (str, int, float, bool, bytes, tuple, type(None)))]
    return hashlib.sha256(repr([parts(code) if code else repr(type(f)), plain]).encode()).hexdigest()[:24]


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    files, where = _files(spark, f"{path}/manifest.json")
    if not files.exists(where):
        return None
    return json.loads("".join(r.value for r in spark.read.text(f"{path}/manifest.json", wholetext=True).collect()))


def write_manifest(spark: SparkSession, path: str, content: dict) -> None:
    """Put in the old one's place by one rename, which is whole or not at all."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    new, old = (jvm.org.apache.hadoop.fs.Path(f"{path}/{n}") for n in (f".manifest-{uuid.uuid4().hex}", "manifest.json"))
    out = new.getFileSystem(conf).create(new)
    try:
        out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    finally:
        out.close()
    ways = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    ways[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), conf).rename(new, old, ways)


def persist(
    spark: SparkSession,
    root: str,
    name: str,
    options: dict,
    make: Callable[[], DataFrame],
    update: bool = False,
    expiration: float | None = None,
    check: list[str] = (),
    shards: list[str] = (),
    code: str | None = None,
    keep_old: bool = False,
) -> DataFrame:
    """The frame that ``make`` gives, written once for each name and options,
    and again when it is older than ``expiration`` seconds, when any file of
    the paths to ``check`` has changed, or when ``code``, a digest of what made
    it, has.

    Each version has a folder of its own, and the manifest names the one that
    counts: until a new one is whole, and if it never gets so, readers have the
    old one. The old folder goes then, or with ``keep_old`` stays for readers
    that still use it. ``shards``: columns whose values become folders, of which
    a filter on them reads only its own."""
    path = f"{root.rstrip('/')}/{name}-{digest(name, options)}"
    inputs = state_of(spark, list(check))
    held = read_manifest(spark, path)
    fresh = held is not None and held["inputs"] == inputs and held["code"] == code and not update and (expiration is None or time.time() - held["made"] <= expiration)
    if not fresh:
        version = uuid.uuid4().hex
        made = make()
        made.write.partitionBy(*shards).parquet(f"{path}/{version}")
        # The inputs as they were before they were read: a change meanwhile is
        # noticed the next time.
        write_manifest(spark, path, {"version": version, "inputs": inputs, "code": code, "made": time.time(), "schema": made.schema.json()})
        if held is not None and not keep_old:
            files, where = _files(spark, f"{path}/{held['version']}")
            files.delete(where, True)
        held = read_manifest(spark, path)
    return spark.read.schema(StructType.fromJson(json.loads(held["schema"]))).parquet(f"{path}/{held['version']}")


class Memo:
    """Results kept in this session by name: frames in the executors' memory
    and disks, other values as they are."""

    def __init__(self):
        self._held: dict[str, object] = {}

    def get(self, name: str, make: Callable[[], object]):
        if name not in self._held:
            made = make()
            self._held[name] = made.persist() if isinstance(made, DataFrame) else made
        return self._held[name]

    def clear(self) -> None:
        for made in self._held.values():
            if isinstance(made, DataFrame):
                made.unpersist()
        self._held.clear()


def with_cache(cache: DataFrame, ids: DataFrame, key: str, fetch: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """What the cache has for the ids joined by what ``fetch`` gives for those
    that it lacks; and these new rows alone, to be appended to it."""
    wanted = ids.select(key).distinct()
    new = fetch(wanted.join(cache, key, "left_anti"))
    return cache.join(wanted, key, "left_semi").unionByName(new), new


class Store:
    """A table of fetched rows by key, that only grows. Rows are added as a part
    of its own, which counts once the manifest names it, so a run that fails
    midway leaves the store as it was. An id that was asked for in vain is
    remembered too, and not asked for again."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, key: str):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def _parts(self) -> list[str]:
        held = read_manifest(self.spark, self.path)
        return held["parts"] if held else []

    def _read(self, kind: str, schema: StructType) -> DataFrame:
        paths = [f"{self.path}/{p}/{kind}" for p in self._parts()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def rows(self) -> DataFrame:
        return self._read("rows", self.schema)

    def asked(self) -> DataFrame:
        return self._read("asked", StructType([self.schema[self.key]]))

    def get(self, ids: DataFrame, fetch: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The rows of the ids: ``fetch`` is asked once for those that haven't
        been asked for yet, and what it gives is added."""
        wanted = ids.select(F.col(self.key).cast(self.schema[self.key].dataType)).where(F.col(self.key).isNotNull()).distinct()
        lacking = wanted.join(self.asked(), self.key, "left_anti")
        part = uuid.uuid4().hex
        lacking.write.parquet(f"{self.path}/{part}/asked")
        lacking = self.spark.read.schema(StructType([self.schema[self.key]])).parquet(f"{self.path}/{part}/asked")
        if not lacking.isEmpty():
            fetch(lacking).select(*self.schema.names).write.parquet(f"{self.path}/{part}/rows")
            write_manifest(self.spark, self.path, {"parts": [*self._parts(), part]})
        return self.rows().join(wanted, self.key, "left_semi")

    def compact(self, partitions: int) -> None:
        """One part in place of many small ones."""
        part = uuid.uuid4().hex
        self.rows().repartition(partitions, self.key).write.parquet(f"{self.path}/{part}/rows")
        self.asked().repartition(partitions, self.key).write.parquet(f"{self.path}/{part}/asked")
        write_manifest(self.spark, self.path, {"parts": [part]})


def prefix_scan(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Rows whose text starts so; the filter reaches the files' statistics."""
    return df.where(F.col(column).startswith(prefix))


def range_scan(df: DataFrame, column: str, low, high) -> DataFrame:
    """Rows between two values, both included."""
    return df.where(F.col(column).between(low, high))


@dataclass
class Task:
    """A named step: ``make(inputs, *results of deps)`` gives a frame.
    ``paths``: the names of those inputs that are paths of files."""

    name: str
    make: Callable[..., DataFrame]
    deps: list[Task] = field(default_factory=list)
    inputs: tuple[str, ...] = ()
    paths: tuple[str, ...] = ()

    def closure(self) -> list[Task]:
        """All it depends on, each after its own dependencies, and itself."""
        out: list[Task] = []
        for d in self.deps:
            out += [t for t in d.closure() if t not in out]
        return [*out, self]

    def all_inputs(self) -> set[str]:
        return {i for t in self.closure() for i in (*t.inputs, *t.paths)}

    def code(self) -> str:
        """A digest of this step's code and that of all it depends on."""
        return digest("code", {t.name: code_digest(t.make) for t in self.closure()})

    def run(self, spark: SparkSession, root: str, given: dict, instead: dict[str, DataFrame] | None = None, check: list[str] = ()) -> DataFrame:
        """The result, from what is stored as far as it is fresh: made from the
        same inputs, by the same code, all along what it depends on. ``check``:
        further paths that all steps are made from. ``instead``: results by
        task name that replace running the task."""
        done = dict(instead or {})
        for t in self.closure():
            if t.name in done:
                continue
            known = {k: given[k] for k in sorted(t.all_inputs()) if k in given}
            own = {k: given[k] for k in (*t.inputs, *t.paths) if k in given}
            make = lambda t=t, own=own: t.make(own, *(done[d.name] for d in t.deps))
            if set(instead or {}) & {d.name for d in t.closure()}:
                done[t.name] = make()
                continue
            paths = [p for s in t.closure() for n in s.paths if n in given for p in ([given[n]] if isinstance(given[n], str) else given[n])]
            done[t.name] = persist(spark, root, t.name, known, make, check=[*paths, *check], code=t.code(), keep_old=True)
        return done[self.name]
