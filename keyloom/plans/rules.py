"""Path rules over a knowledge base, as chains of joins.

A rule says which ends of an association's edges bind which variables. Each
rule is a frame of bindings, made with select and where; rules that share
variables are joined on them. There is no rule language: rules are written as
objects.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.operators.filters import condition
from keyloom.plans.associations import KnowledgeBase


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Rule:
    """``source`` and ``target``: a variable or an id. ``where``: conditions on
    the edge's info. ``db``: an association, or a variable for all of them."""

    source: Var | object
    db: str | Var
    target: Var | object
    where: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Ids:
    """Binds a variable to ids, in the form of an association."""

    var: Var
    db: str
    ids: DataFrame
    target: bool = False


@dataclass(frozen=True)
class Only:
    """Rules of their own, of which one variable's bindings stay."""

    var: Var
    rules: tuple


def _edges(kb: KnowledgeBase, rule: Rule) -> DataFrame:
    """The edges that a rule allows: source, target and db."""
    names = kb.databases() if isinstance(rule.db, Var) else [rule.db]
    parts = []
    for name in names:
        e = kb.where(name, rule.where)
        for end in ("source", "target"):
            if not isinstance(said := getattr(rule, end), Var):
                # The literal takes the column's type, so the filter reaches the files.
                e = e.where(F.col(end) == F.lit(said).cast(e.schema[end].dataType))
        parts.append(e.select("source", "target", F.lit(name).alias("db")))
    return reduce(DataFrame.unionByName, parts)


def bindings(kb: KnowledgeBase, rule: Rule, path: str | None = None) -> DataFrame:
    """A column for each variable of a rule, and as ``path`` the edge."""
    e, columns = _edges(kb, rule), {}
    for end in ("source", "target"):
        said = getattr(rule, end)
        if isinstance(said, Var):
            if said.name in columns:
                e = e.where("source = target")
            columns[said.name] = F.col(end)
    if isinstance(rule.db, Var):
        columns[rule.db.name] = F.col("db")
    if path:
        columns[path] = F.struct("source", "db", "target")
    return e.select(*(c.alias(n) for n, c in columns.items()))


def paths(kb: KnowledgeBase, rules: list, given: DataFrame | None = None) -> DataFrame:
    """All consistent bindings, a column for each variable, and for each rule
    the edge that it took: path_0, path_1, ..."""
    state = given
    for i, rule in enumerate(rules):
        if isinstance(rule, Only):
            seed = state.select(rule.var.name).distinct() if state is not None and rule.var.name in state.columns else None
            own = traverse(kb, list(rule.rules), seed).select(rule.var.name).distinct()
        elif isinstance(rule, Ids):
            own = kb.identify(rule.db, rule.ids, rule.target).select(F.col("id").alias(rule.var.name)).distinct()
        else:
            own = bindings(kb, rule, f"path_{i}")
        if state is None:
            state = own
            continue
        shared = [c for c in own.columns if c in state.columns]
        if not shared:
            raise ValueError(f"{rule} shares no variable with those before it")
        state = state.join(own, shared)
    return state.distinct()


def traverse(kb: KnowledgeBase, rules: list, given: DataFrame | None = None) -> DataFrame:
    """All consistent bindings: a column for each variable, distinct rows."""
    found = paths(kb, rules, given)
    return found.select(*(c for c in found.columns if not c.startswith("path_"))).distinct()


def assignments(kb: KnowledgeBase, rules: list) -> dict[str, DataFrame]:
    """For each variable the values that rule after rule leaves it, each rule
    narrowed by those before it alone; so a value may be in no whole path."""
    known: dict[str, DataFrame] = {}
    for rule in rules:
        if isinstance(rule, Only):
            inner = assignments(kb, list(rule.rules))
            own = inner[rule.var.name]
            known[rule.var.name] = known[rule.var.name].intersect(own) if rule.var.name in known else own
            continue
        own = kb.identify(rule.db, rule.ids, rule.target).select(F.col("id").alias(rule.var.name)) if isinstance(rule, Ids) else bindings(kb, rule)
        for name in own.columns:
            if name in known:
                own = own.join(known[name], name, "left_semi")
        for name in own.columns:
            known[name] = own.select(name).distinct()
    return known
