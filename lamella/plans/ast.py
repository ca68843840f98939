"""Statements as trees."""

from __future__ import annotations

from dataclasses import dataclass

from lamella.functions.kinds import Kind


@dataclass(frozen=True)
class Const:
    value: int | str

    def __str__(self) -> str:
        return str(self.value) if isinstance(self.value, int) else "'" + self.value.replace("'", "''") + "'"


@dataclass(frozen=True)
class Field:
    name: str
    table: str | None = None

    def __str__(self) -> str:
        return f"{self.table}.{self.name}" if self.table else self.name


Expr = Const | Field


@dataclass(frozen=True)
class Compare:
    op: str
    left: Expr
    right: Expr

    def __str__(self) -> str:
        return f"{self.left} {self.op} {self.right}"


@dataclass(frozen=True)
class And:
    terms: tuple[Predicate, ...] = ()

    def __str__(self) -> str:
        return " and ".join(f"({t})" if isinstance(t, Or) else str(t) for t in self.terms)


@dataclass(frozen=True)
class Or:
    terms: tuple[Predicate, ...]

    def __str__(self) -> str:
        return " or ".join(map(str, self.terms))


Predicate = Compare | And | Or


@dataclass(frozen=True)
class Item:
    """An output column; expr is None for `*` and alias.`*`."""

    expr: Expr | None
    alias: str | None = None
    table: str | None = None

    def __str__(self) -> str:
        if self.expr is None:
            return f"{self.table}.*" if self.table else "*"
        return f"{self.expr} as {self.alias}" if self.alias else str(self.expr)


@dataclass(frozen=True)
class TableRef:
    name: str
    alias: str | None = None

    def __str__(self) -> str:
        return f"{self.name} {self.alias}" if self.alias else self.name


@dataclass(frozen=True)
class Join:
    kind: str
    ref: TableRef
    on: Predicate

    def __str__(self) -> str:
        return f"{self.kind} join {self.ref} on {self.on}"


@dataclass(frozen=True)
class Select:
    items: tuple[Item, ...]
    tables: tuple[TableRef, ...]
    joins: tuple[Join, ...] = ()
    where: Predicate = And()

    def __str__(self) -> str:
        out = f"select {', '.join(map(str, self.items))} from {', '.join(map(str, self.tables))}"
        out += "".join(f" {j}" for j in self.joins)
        return out if self.where == And() else f"{out} where {self.where}"


@dataclass(frozen=True)
class Insert:
    table: str
    fields: tuple[str, ...]
    values: tuple[Const, ...]


@dataclass(frozen=True)
class Delete:
    table: str
    where: Predicate = And()


@dataclass(frozen=True)
class Update:
    table: str
    field: str
    value: Expr
    where: Predicate = And()


@dataclass(frozen=True)
class CreateTable:
    table: str
    fields: tuple[tuple[str, Kind], ...]


@dataclass(frozen=True)
class CreateView:
    view: str
    query: Select


@dataclass(frozen=True)
class CreateIndex:
    index: str
    table: str
    field: str
    kind: str = "hash"


Statement = Select | Insert | Delete | Update | CreateTable | CreateView | CreateIndex


def conjuncts(p: Predicate) -> list[Predicate]:
    """The terms that must all hold; a repeated one counts once."""
    if not isinstance(p, And):
        return [p]
    return list(dict.fromkeys(t for x in p.terms for t in conjuncts(x)))


def tree(node, depth: int = 0) -> str:
    """A predicate or statement as an indented tree."""
    pad = "  " * depth
    if isinstance(node, And | Or):
        return "\n".join([pad + type(node).__name__.upper(), *(tree(t, depth + 1) for t in node.terms)])
    if isinstance(node, Compare):
        return "\n".join([f"{pad}COMPARE {node.op}", tree(node.left, depth + 1), tree(node.right, depth + 1)])
    if isinstance(node, Select):
        parts = [f"{pad}SELECT", *(f"{pad}  ITEM {i}" for i in node.items), *(f"{pad}  FROM {t}" for t in node.tables)]
        for j in node.joins:
            parts += [f"{pad}  {j.kind.upper()} JOIN {j.ref}", tree(j.on, depth + 2)]
        return "\n".join([*parts, f"{pad}  WHERE", tree(node.where, depth + 2)] if node.where != And() else parts)
    return f"{pad}{type(node).__name__.upper()} {node}"
