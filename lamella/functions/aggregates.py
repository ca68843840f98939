"""Aggregates by name. `register` adds one: a builder from a column to an aggregate expression.

`max` is the relational engine's own; the others are extensions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_builders: dict[str, Callable[[Column], Column]] = {}


def register(name: str, builder: Callable[[Column], Column]) -> None:
    _builders[name.lower()] = builder


for _name, _builder in (("max", F.max), ("min", F.min), ("sum", F.sum), ("count", F.count), ("avg", F.avg)):
    register(_name, _builder)


@dataclass(frozen=True)
class Aggregate:
    """`max` of `field` is called maxoffield."""

    name: str
    field: str

    @property
    def output(self) -> str:
        return f"{self.name.lower()}of{self.field}"

    def column(self) -> Column:
        if self.name.lower() not in _builders:
            raise KeyError(f"no aggregate {self.name}")
        return _builders[self.name.lower()](F.col(self.field)).alias(self.output)


def max_of(field: str) -> Aggregate:
    return Aggregate("max", field)
