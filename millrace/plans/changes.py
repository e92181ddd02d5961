"""INSERT, DELETE and UPDATE as an ordered log over immutable base data.

The log is folded from left to right into one declarative plan, so Catalyst pushes filters and
prunes columns through it down to the base scan.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalars import true_only
from millrace.plans.statements import Delete, Insert, StatementError, Update


@dataclass
class ChangeLog:
    """Changes in order; its length is the number of statements, also of those that became one change."""

    changes: list[Insert | Delete | Update] = field(default_factory=list)
    statements: int = 0

    def add(self, change: Insert | Delete | Update) -> None:
        """Neighbouring inserts into the same columns become one relation."""
        self.statements += 1
        last = self.changes[-1] if self.changes else None
        if isinstance(change, Insert) and isinstance(last, Insert) and last.columns == change.columns:
            self.changes[-1] = Insert(change.table, change.columns, f"{last.values}, {change.values}")
        else:
            self.changes.append(change)

    def __len__(self) -> int:
        return self.statements

    def apply(self, base: DataFrame) -> DataFrame:
        out = base
        for change in self.changes:
            out = apply_change(out, change)
        return out


def inserted_rows(like: DataFrame, change: Insert) -> DataFrame:
    """The rows of an INSERT, typed as like; columns that aren't named are null."""
    known = {c.lower(): c for c in like.columns}
    names = change.columns or tuple(like.columns)
    for n in names:
        if n.lower() not in known:
            raise StatementError(f"{change.table} has no column {n!r}")
    rows = like.sparkSession.sql(f"SELECT * FROM VALUES {change.values}")
    if len(rows.columns) != len(names):
        raise StatementError(f"{len(names)} columns but {len(rows.columns)} values")
    at = {known[n.lower()]: c for n, c in zip(names, rows.columns, strict=True)}
    return rows.select(*((F.col(at[f.name]) if f.name in at else F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema))


def apply_change(df: DataFrame, change: Insert | Delete | Update) -> DataFrame:
    """df after one change. A predicate that is null decides nothing: the row stays as it is."""
    if isinstance(change, Insert):
        return df.unionByName(inserted_rows(df, change))
    hit = true_only(F.expr(change.predicate)) if change.predicate else F.lit(True)
    named = df.alias(change.table)
    if isinstance(change, Delete):
        return named.where(~hit).select(*df.columns)
    new = {c.lower(): e for c, e in change.assignments}
    if unknown := set(new) - {c.lower() for c in df.columns}:
        raise StatementError(f"{change.table} has no column {sorted(unknown)[0]!r}")
    return named.select(
        *(F.when(hit, F.expr(new[f.name.lower()]).cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) if f.name.lower() in new else F.col(f.name) for f in df.schema)
    )
