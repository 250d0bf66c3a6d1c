"""Associations as edge frames, and a knowledge base of named ones.

An edge frame has ``source``, ``target`` and info columns. Composite keys
``source~target`` are written only at the edges of the API, with ``~`` inside
an id as ``-..-``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.frame import KeyedFrame
from keyloom.operators.filters import condition
from keyloom.operators.shape import records, to_double
from keyloom.storage import materialize


@dataclass(frozen=True)
class End:
    """One end of an association: the column, and the ids (from, to) that it
    is translated by; ``format`` names what it holds then."""

    column: str
    ids: DataFrame | None = None
    format: str | None = None


@dataclass(frozen=True)
class Spec:
    """Which columns of a table are an association's ends and info. Without
    ends they are the first two columns; with one given, the other is the first
    column that isn't it. ``undirected`` is so by default where both ends hold
    the same format."""

    columns: list[str]
    source: End | None = None
    target: End | None = None
    info: list[str] | None = None
    undirected: bool | None = None

    def filled(self) -> Spec:
        taken = [e.column for e in (self.source, self.target) if e]
        left = iter(c for c in self.columns if c not in taken)
        source = self.source or End(next(left))
        target = self.target or End(next(left))
        info = self.info if self.info is not None else [c for c in self.columns if c not in (source.column, target.column)]
        same = (source.format or source.column) == (target.format or target.column)
        return replace(self, source=source, target=target, info=info, undirected=same if self.undirected is None else self.undirected)


def database(table: KeyedFrame, spec: Spec | None = None) -> DataFrame:
    """The association of a table: source, target and info, a row for each
    zipped record, with both ends translated (untranslatable ones go)."""
    spec = (spec or Spec([table.key, *table.fields])).filled()
    rows = records(to_double(table), expand=True) if table.many else table.df
    out = rows.select(F.col(f"`{spec.source.column}`").alias("source"), F.col(f"`{spec.target.column}`").alias("target"), *(F.col(f"`{i}`") for i in spec.info))
    for end, own in (("source", spec.source), ("target", spec.target)):
        if own.ids is not None:
            a, b = own.ids.columns
            once = own.ids.groupBy(F.col(f"`{a}`").alias(end)).agg(F.min(F.col(f"`{b}`")).alias("_to"))
            out = out.join(once, end).withColumn(end, F.col("_to")).drop("_to").select("source", "target", *spec.info)
    out = out.where("source is not null and target is not null")
    return undirected(out) if spec.undirected else out


def edges(df: DataFrame, source: str, target: str, info: list[str] = (), order: list[str] | None = None, sep: str = ";;") -> DataFrame:
    """One row for each pair; info of repeated pairs is joined."""
    rows = df.where(F.col(source).isNotNull() & F.col(target).isNotNull())
    own = _by_ends(rows, source, target).groupBy(F.col(source).alias("source"), F.col(target).alias("target"))
    if not info:
        return own.agg(F.lit(1).alias("_")).drop("_")
    turn = F.struct(*(order or info)).alias("o")
    joined = own.agg(F.sort_array(F.collect_list(F.struct(turn, *info))).alias("_r"))
    return joined.select("source", "target", *(F.array_join(F.transform(F.col("_r")[i], lambda x: x.cast("string")), sep, "").alias(i) for i in info))


def pair_key(source: Column, target: Column) -> Column:
    safe = lambda c: F.replace(c.cast("string"), F.lit("~"), F.lit("-..-"))
    return F.concat(safe(source), F.lit("~"), safe(target))


def pair_ends(pair: Column) -> tuple[Column, Column]:
    """Source and target of a composite key."""
    plain = lambda c: F.replace(c, F.lit("-..-"), F.lit("~"))
    return plain(F.substring_index(pair, "~", 1)), plain(F.substring_index(pair, "~", -1))


def reverse(e: DataFrame) -> DataFrame:
    rest = [c for c in e.columns if c not in ("source", "target")]
    return e.select(F.col("target").alias("source"), F.col("source").alias("target"), *rest)


def undirected(e: DataFrame) -> DataFrame:
    """Both directions of each edge, once; loops once."""
    ends = [F.struct(F.col(a).alias("source"), F.col(b).alias("target")) for a, b in (("source", "target"), ("target", "source"))]
    both = e.withColumn("_ends", F.explode(F.when(F.col("source") != F.col("target"), F.array(*ends)).otherwise(F.array(ends[0]))))
    both = both.select(*(F.col("_ends")[c].alias(c) if c in ("source", "target") else F.col(c) for c in e.columns))
    return _by_ends(both, "source", "target").dropDuplicates(["source", "target"])


def _by_ends(rows: DataFrame, source: str, target: str) -> DataFrame:
    """Dealt by both ends before they are grouped, over all partitions: pairs
    are hardly ever repeated, so groups made before the shuffle, or in the few
    partitions that small rows are put into, only fill a task's memory."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), source, target)


def between(e: DataFrame, sources: DataFrame | None = None, targets: DataFrame | None = None, once: bool = False) -> DataFrame:
    """Edges whose ends are in the first columns of the given frames; None is
    all. ``once``: one direction of each pair."""
    for end, own in (("source", sources), ("target", targets)):
        if own is not None:
            e = e.join(own.select(F.col(own.columns[0]).alias(end)).distinct(), end, "left_semi")
    return e.where("source <= target") if once else e


def children(e: DataFrame, nodes: DataFrame) -> DataFrame:
    return between(e, sources=nodes)


def parents(e: DataFrame, nodes: DataFrame) -> DataFrame:
    return between(e, targets=nodes)


def neighbours(e: DataFrame, nodes: DataFrame) -> DataFrame:
    return children(e, nodes).unionByName(children(reverse(e), nodes)).distinct()


def matching(e: DataFrame, field: str, value: str | None = None, sep: str = ";;") -> DataFrame:
    """Edges whose info includes the value, or with none is neither empty nor
    "false"."""
    own = F.col(f"`{field}`").cast("string")
    return e.where(F.array_contains(F.split(own, sep), value) if value is not None else ~own.isin("", "false"))


def adjacency_values(e: DataFrame, value: str) -> DataFrame:
    """(source, targets, values): lists that belong together, by target."""
    own = F.sort_array(F.collect_list(F.struct("target", value)))
    return e.groupBy("source").agg(own.alias("_e")).select("source", F.col("_e")["target"].alias("targets"), F.col("_e")[value].alias("values"))


def adjacency(e: DataFrame, sep: str = ",") -> DataFrame:
    return e.groupBy("source").agg(F.array_join(F.transform(F.sort_array(F.collect_set("target")), lambda x: x.cast("string")), sep).alias("targets"))


class KnowledgeBase:
    """Named associations, each made when first asked for. With ``keep`` it is
    written to the shared folder then, so several rules read it and don't make
    it again."""

    def __init__(self, keep: bool = False):
        self.keep = keep
        self._makers: dict[str, Callable[[], DataFrame]] = {}
        self._made: dict[str, DataFrame] = {}
        self._ids: dict[str, tuple[DataFrame | None, DataFrame | None]] = {}
        self._about: dict[str, dict] = {}

    def register(self, name: str, maker: Callable[[], DataFrame], source_ids: DataFrame | None = None, target_ids: DataFrame | None = None, **about) -> KnowledgeBase:
        """``*_ids``: frames (any form of an id, the form that edges use).
        ``about``: what ``describe`` tells of it besides (source, target,
        undirected)."""
        self._makers[name], self._ids[name], self._about[name] = maker, (source_ids, target_ids), about
        return self

    def register_table(self, name: str, table: KeyedFrame, spec: Spec | None = None) -> KnowledgeBase:
        own = (spec or Spec([table.key, *table.fields])).filled()
        return self.register(name, lambda: database(table, own), own.source.ids, own.target.ids, source=own.source.format or own.source.column, target=own.target.format or own.target.column, undirected=own.undirected)

    def describe(self, name: str) -> dict:
        """The fields of its ends, its info fields, and whether it has both
        directions of each edge."""
        info = [c for c in self.index(name).columns if c not in ("source", "target")]
        return {"source": "source", "target": "target", "undirected": False} | self._about[name] | {"info": info}

    def syndicate(self, name: str, other: KnowledgeBase) -> None:
        for db in other.databases():
            self.register(f"{db}@{name}", lambda db=db: other.index(db), *other._ids[db], **other._about[db])

    def databases(self) -> list[str]:
        return sorted(self._makers)

    def index(self, name: str) -> DataFrame:
        if name not in self._made:
            own = self._makers[name]()
            self._made[name] = materialize(own, "edges") if self.keep else own
        return self._made[name]

    def identify(self, name: str, ids: DataFrame, target: bool = False) -> DataFrame:
        """Ids (first column) in the form of the association; unknown ones
        stay."""
        known = self._ids[name][int(target)]
        own = ids.select(F.col(ids.columns[0]).alias("id"))
        if known is None:
            return own
        forms = known.toDF("id", "_form").groupBy("id").agg(F.min("_form").alias("_form"))
        return own.join(forms, "id", "left").select(F.coalesce("_form", "id").alias("id"))

    def subset(self, name: str, sources: DataFrame | None = None, targets: DataFrame | None = None) -> DataFrame:
        ends = [None if x is None else self.identify(name, x, bool(i)) for i, x in enumerate((sources, targets))]
        return between(self.index(name), *ends)

    def where(self, name: str, conditions: dict) -> DataFrame:
        e = self.index(name)
        for field, said in conditions.items():
            e = e.where(condition(F.col(field), said))
        return e
