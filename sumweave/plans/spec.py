"""The query model: relations bound by position, equality joins, constant filters, summed columns."""

from __future__ import annotations

from dataclasses import dataclass

#: Relations hold unsigned 64-bit integers.
U64 = 1 << 64


class QueryError(ValueError):
    """A query that can't be run; subclasses say why."""


class ParseError(QueryError):
    pass


class UnsupportedPredicate(ParseError):
    pass


class UnknownRelation(QueryError):
    pass


class UnknownColumn(QueryError):
    pass


class DisconnectedQuery(QueryError):
    pass


@dataclass(frozen=True, order=True)
class ColumnRef:
    binding: int
    column: int

    @property
    def name(self) -> str:
        return f"b{self.binding}_c{self.column}"

    @property
    def sql(self) -> str:
        return f"b{self.binding}.c{self.column}"

    def __str__(self) -> str:
        return f"{self.binding}.{self.column}"


@dataclass(frozen=True, order=True)
class Filter:
    column: ColumnRef
    op: str
    constant: int

    def __str__(self) -> str:
        return f"{self.column}{self.op}{self.constant}"

    @property
    def sql(self) -> str:
        return f"{self.column.sql} {self.op} {self.constant}"


@dataclass(frozen=True, order=True)
class Join:
    left: ColumnRef
    right: ColumnRef

    def __str__(self) -> str:
        return f"{self.left}={self.right}"

    @property
    def sql(self) -> str:
        return f"{self.left.sql} = {self.right.sql}"

    def canonical(self) -> Join:
        return self if self.left <= self.right else Join(self.right, self.left)


@dataclass(frozen=True)
class QuerySpec:
    """relations[i] is the id of the relation that binding i stands for. empty: no row can satisfy the filters."""

    relations: tuple[int, ...]
    joins: tuple[Join, ...]
    filters: tuple[Filter, ...]
    selections: tuple[ColumnRef, ...]
    empty: bool = False

    def columns_of(self, binding: int) -> list[int]:
        """Columns of a binding that the query needs, in order."""
        used = {c for j in self.joins for c in (j.left, j.right)} | {f.column for f in self.filters} | set(self.selections)
        return sorted(c.column for c in used if c.binding == binding)

    def to_text(self) -> str:
        predicates = [*map(str, self.joins), *map(str, self.filters)]
        return f"{' '.join(map(str, self.relations))}|{'&'.join(predicates)}|{' '.join(map(str, self.selections))}"

    def to_sql(self, table: str = "r{}", zero_is_null: bool = True, kind: str | None = "BIGINT") -> str:
        """ANSI SQL; table makes a relation's name of its id; kind is the type of the sums, None for their own."""
        sums = []
        for i, c in enumerate(self.selections):
            total = f"SUM({c.sql})"
            total = f"NULLIF({total}, 0)" if zero_is_null else total
            sums.append(f"{f'CAST({total} AS {kind})' if kind else total} AS s{i}")
        tables = [f"{table.format(r)} b{i}" for i, r in enumerate(self.relations)]
        where = [*(j.sql for j in self.joins), *(f.sql for f in self.filters)] + ["1 = 0"] * self.empty
        return f"SELECT {', '.join(sums)} FROM {', '.join(tables)}" + (f" WHERE {' AND '.join(where)}" if where else "")
