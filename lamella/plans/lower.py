"""Query trees to DataFrames. Catalyst does the rest: join choice, push-down, pruning, folding.

Every column of a FROM item gets a name of its own while the query is put together, so inputs that share names never
clash. An unqualified name means the leftmost item that has it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamella.functions.kinds import compare, family
from lamella.plans.ast import And, Compare, Const, Expr, Field, Or, Predicate, Select, TableRef, conjuncts


class Unresolved(ValueError):
    """A name that no table or column has."""


Relations = Callable[[str], DataFrame]


@dataclass
class Source:
    """A FROM item: its alias, and its columns' own names and families."""

    alias: str
    frame: DataFrame
    columns: dict[str, tuple[str, str, str]]  # lower-cased name -> (name, own name, family)


def source(ref: TableRef, at: int, relations: Relations) -> Source:
    df = relations(ref.name)
    names = {f.name: f"c{at}_{k}" for k, f in enumerate(df.schema.fields)}
    frame = df.select(*(F.col(f"`{n}`").alias(own) for n, own in names.items()))
    return Source(ref.alias or ref.name, frame, {f.name.lower(): (f.name, names[f.name], family(f.dataType)) for f in df.schema.fields})


class Scope:
    def __init__(self, sources: list[Source]):
        self.sources = sources

    def find(self, f: Field) -> tuple[str, str, str]:
        for s in self.sources:
            if (f.table is None or f.table.lower() == s.alias.lower()) and f.name.lower() in s.columns:
                return s.columns[f.name.lower()]
        raise Unresolved(f"no column {f}")

    def expr(self, e: Expr) -> tuple[Column, str]:
        if isinstance(e, Const):
            return F.lit(e.value), "number" if isinstance(e.value, int) else "text"
        _, own, kind = self.find(e)
        return F.col(own), kind

    def predicate(self, p: Predicate) -> Column:
        if isinstance(p, Compare):
            (left, a), (right, b) = self.expr(p.left), self.expr(p.right)
            return compare(p.op, left, right, a, b)
        terms = [self.predicate(t) for t in p.terms]
        return reduce(or_ if isinstance(p, Or) else and_, terms, *([] if terms else [F.lit(True)]))

    def select_list(self, items) -> list[Column]:
        out = []
        for i in items:
            if i.expr is None:
                found = [s for s in self.sources if i.table is None or i.table.lower() == s.alias.lower()]
                if not found:
                    raise Unresolved(f"no table {i.table}")
                out += [F.col(own).alias(name) for s in found for name, own, _ in s.columns.values()]
            else:
                name = i.alias or (self.find(i.expr)[0] if isinstance(i.expr, Field) else str(i.expr.value))
                out.append(self.expr(i.expr)[0].alias(name))
        return out


#: Rows of a table whose field equals a constant, or None where no index helps.
Lookup = Callable[[str, str, int | str], DataFrame | None]
#: Rows of a table with a column of buckets, its name, and the bucket of a key; or None where no index helps.
Probe = Callable[[str, str], tuple[DataFrame, str, Callable[[Column], Column]] | None]


@dataclass(frozen=True)
class Access:
    """Ways to read a table by an indexed field."""

    lookup: Lookup
    probe: Probe


def _equated(terms: list[Predicate], scope: Scope) -> tuple[list, list]:
    """Equalities of fields: with constants (own name, value) and with fields (own names); each counts once."""
    constants, fields = [], []
    for t in terms:
        if not isinstance(t, Compare) or t.op != "=":
            continue
        found = [scope.find(x)[1] if isinstance(x, Field) else x.value for x in (t.left, t.right)]
        are = [isinstance(x, Field) for x in (t.left, t.right)]
        if all(are):
            fields.append(tuple(found))
        elif any(are):
            constants.append(tuple(found) if are[0] else (found[1], found[0]))
    return list(dict.fromkeys(constants)), list(dict.fromkeys(fields))


def _indexed(query: Select, refs: list[TableRef], sources: list[Source], access: Access) -> list[Column]:
    """Reads FROM items through indexes where a conjunct of WHERE equates an indexed field with a constant, or, in inner
    joins, with a field of an earlier item that WHERE restricts. Conditions that follow from the buckets are returned."""
    scope = Scope(sources)
    inner = all(j.kind == "inner" for j in query.joins)
    terms = [t for p in (query.where, *((j.on for j in query.joins) if inner else ())) for t in conjuncts(p)]
    constants, fields = _equated(terms, scope)
    owner = {own: (k, name) for k, s in enumerate(sources) for name, own, _ in s.columns.values()}
    read = set()
    for own, value in constants:
        k, name = owner[own]
        if k not in read and (df := access.lookup(refs[k].name, name, value)) is not None:
            sources[k].frame = df.select(*(F.col(f"`{n}`").alias(o) for n, o, _ in sources[k].columns.values()))
            read.add(k)
    out = []
    restricted = {owner[own][0] for own, _ in constants}
    for pair in fields if inner else ():
        for outer, own in (pair, pair[::-1]):
            k, name = owner[own]
            if k in read or owner[outer][0] == k or owner[outer][0] not in restricted or k in restricted:
                continue
            if (got := access.probe(refs[k].name, name)) is not None:
                df, bucket, of = got
                sources[k].frame = df.select(*(F.col(f"`{n}`").alias(o) for n, o, _ in sources[k].columns.values()), F.col(bucket).alias(f"b{k}"))
                out.append(F.col(f"b{k}") == of(F.col(outer)))
                read.add(k)
    return out


def lower(query: Select, relations: Relations, access: Access | None = None) -> DataFrame:
    refs = [*query.tables, *(j.ref for j in query.joins)]
    sources = [source(t, k, relations) for k, t in enumerate(refs)]
    more = _indexed(query, refs, sources, access) if access else []
    n = len(query.tables)
    # inner joins without a condition: WHERE becomes theirs, and unlike cross joins they let Spark prune partitions
    frame = reduce(lambda a, b: a.join(b, F.lit(True), "inner"), (s.frame for s in sources[:n]))
    for k, j in enumerate(query.joins, n + 1):
        frame = frame.join(sources[k - 1].frame, Scope(sources[:k]).predicate(j.on), j.kind)
    scope = Scope(sources)
    if query.where != And() or more:
        frame = frame.filter(reduce(and_, more, scope.predicate(query.where)))
    return frame.select(*scope.select_list(query.items))


def condition(df: DataFrame, p: Predicate) -> Column:
    """A predicate over one DataFrame's columns, for filters of the API and of commands."""
    columns = {f.name.lower(): (f.name, f"`{f.name}`", family(f.dataType)) for f in df.schema.fields}
    return Scope([Source("", df, columns)]).predicate(p)
