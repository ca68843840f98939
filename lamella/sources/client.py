"""A small embedded client: connection, statement, result set and its metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Row

from lamella.functions.kinds import INTEGER_CODE, VARCHAR_CODE, family
from lamella.sources.engine import Engine, Transaction


class Metadata:
    """Columns count from 1."""

    def __init__(self, df: DataFrame, lengths: dict[str, int] | None = None):
        self.fields, self.lengths = df.schema.fields, lengths or {}

    def column_count(self) -> int:
        return len(self.fields)

    def column_name(self, k: int) -> str:
        return self.fields[k - 1].name

    def column_type(self, k: int) -> int:
        return {"number": INTEGER_CODE, "text": VARCHAR_CODE}.get(family(self.fields[k - 1].dataType), 0)

    def column_display_size(self, k: int) -> int:
        name = self.column_name(k)
        wide = 6 if self.column_type(k) == INTEGER_CODE else self.lengths.get(name.lower(), 0)
        return max(len(name), wide) + 1


class ResultSet:
    """A cursor. Rows come a partition at a time."""

    def __init__(self, df: DataFrame, owner: Connection):
        self.df, self.owner = df, owner
        self.rows = df.toLocalIterator()
        self.row: Row | None = None
        self.at = {c.lower(): k for k, c in reversed(list(enumerate(df.columns)))}

    def next(self) -> bool:
        try:
            self.row = next(self.rows, None)
        except Exception:
            self.owner.rollback()
            raise
        return self.row is not None

    def _get(self, name: str):
        if self.row is None:
            raise ValueError("no row: call next() first")
        return self.row[self.at[name.lower()]]

    def get_int(self, name: str) -> int:
        return int(self._get(name))

    def get_string(self, name: str) -> str:
        return str(self._get(name))

    def metadata(self) -> Metadata:
        lengths = {}
        for t in self.owner.engine.catalog.managed():
            for n, k in self.owner.engine.catalog.version(t).fields:
                lengths[n.lower()] = max(lengths.get(n.lower(), 0), k.length or 0)
        return Metadata(self.df, lengths)

    def close(self) -> None:
        self.owner.commit()


class Statement:
    def __init__(self, owner: Connection):
        self.owner = owner

    def execute_query(self, sql: str) -> ResultSet:
        return ResultSet(self.owner.transaction.query(sql), self.owner)

    def execute_update(self, sql: str) -> int:
        """The number of changed rows. Commits, or rolls back and raises."""
        try:
            n = self.owner.transaction.execute(sql)
        except Exception:
            self.owner.rollback()
            raise
        self.owner.commit()
        return n


class Connection:
    """One current transaction; a new one begins after commit or rollback."""

    def __init__(self, spark: SparkSession, path: str):
        self.engine = Engine(spark, path)
        self.transaction: Transaction = self.engine.begin()

    def create_statement(self) -> Statement:
        return Statement(self)

    def commit(self) -> None:
        self.transaction.commit()
        self.transaction = self.engine.begin()

    def rollback(self) -> None:
        self.transaction.rollback()
        self.transaction = self.engine.begin()

    def close(self) -> None:
        self.commit()


def connect(spark: SparkSession, path: str) -> Connection:
    return Connection(spark, path)
