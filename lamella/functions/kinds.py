"""Column types: INT and VARCHAR(n) of managed tables, and how values of different families compare."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INT_MIN, INT_MAX = -(1 << 31), (1 << 31) - 1
#: Codes that the field catalog shows.
INTEGER_CODE, VARCHAR_CODE = 1, 2


@dataclass(frozen=True)
class Kind:
    """length is None for INT."""

    length: int | None = None

    @property
    def code(self) -> int:
        return INTEGER_CODE if self.length is None else VARCHAR_CODE

    @property
    def default(self) -> int | str:
        return 0 if self.length is None else ""

    @property
    def spark(self) -> T.DataType:
        return T.IntegerType() if self.length is None else T.StringType()

    @property
    def slot_bytes(self) -> int:
        """Bytes that a value takes in a fixed-length slot."""
        return 8 if self.length is None else 4 + self.length

    def check(self, value: int | str, name: str) -> int | str:
        if isinstance(value, bool) or not isinstance(value, int if self.length is None else str):
            raise TypeError(f"{name}: {value!r} is not {self}")
        if self.length is None and not INT_MIN <= value <= INT_MAX:
            raise OverflowError(f"{name}: {value} does not fit INT")
        if self.length is not None and len(value) > self.length:
            raise ValueError(f"{name}: {len(value)} characters do not fit {self}")
        return value

    def __str__(self) -> str:
        return "INT" if self.length is None else f"VARCHAR({self.length})"


def family(kind: T.DataType) -> str:
    if isinstance(kind, T.NumericType):
        return "number"
    if isinstance(kind, T.StringType | T.VarcharType | T.CharType):
        return "text"
    return kind.simpleString()


def compare(op: str, left: Column, right: Column, left_family: str, right_family: str) -> Column:
    """Numbers and texts are never equal and never coerced; they have no order."""
    if {left_family, right_family} == {"number", "text"}:
        if op in ("=", "<>"):
            return F.lit(op == "<>")
        raise TypeError(f"a number and a text have no order: {op}")
    return {"=": left == right, "<>": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]
