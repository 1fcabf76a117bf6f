"""SQL statements that merge a loaded stage table into its target, per warehouse.

Spark loads the stage in parallel; the merge itself is a set-based statement the
warehouse runs.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from tablesync.functions.identifiers import safe_identifier


def quoted(name: str, quote: str = "") -> str:
    return f"{quote}{safe_identifier(name)}{quote}"


@dataclass(frozen=True)
class Merge:
    """Names for one merge: target and stage table, all columns, the key columns.

    ``quote`` surrounds column names, so that reserved words may be columns.
    """

    target: str
    stage: str
    columns: Sequence[str]
    keys: Sequence[str]
    quote: str = ""

    def __post_init__(self):
        if not self.keys:
            raise ValueError(f"merging into {self.target} needs a primary key")
        object.__setattr__(self, "target", safe_identifier(self.target))
        object.__setattr__(self, "stage", safe_identifier(self.stage))
        for name in ("columns", "keys"):
            object.__setattr__(self, name, [quoted(c, self.quote) for c in getattr(self, name)])

    @property
    def values(self) -> list[str]:
        return [c for c in self.columns if c not in self.keys]

    def _list(self, prefix: str = "") -> str:
        return ", ".join(prefix + c for c in self.columns)

    def _match(self, left: str, right: str) -> str:
        return " AND ".join(f"{left}.{k} = {right}.{k}" for k in self.keys)

    def on_conflict(self) -> list[str]:
        """Insert, and overwrite the rows that conflict on the key (the stage holds each key once)."""
        sets = ", ".join(f"{c} = EXCLUDED.{c}" for c in self.values)
        action = f"DO UPDATE SET {sets}" if sets else "DO NOTHING"
        return [
            f"INSERT INTO {self.target} ({self._list()}) SELECT {self._list()} FROM {self.stage} "
            f"ON CONFLICT ({', '.join(self.keys)}) {action}"
        ]

    def delete_insert(self) -> list[str]:
        """Delete the staged keys from the target, then insert the stage as it is."""
        return [
            f"DELETE FROM {self.target} USING {self.stage} WHERE {self._match(self.target, self.stage)}",
            f"INSERT INTO {self.target} ({self._list()}) SELECT {self._list()} FROM {self.stage}",
        ]

    def merge(self) -> list[str]:
        """One MERGE: update matched rows in every non-key column, insert the others."""
        sets = ", ".join(f"{c} = s.{c}" for c in self.values)
        update = f"WHEN MATCHED THEN UPDATE SET {sets} " if sets else ""
        return [
            f"MERGE INTO {self.target} AS t USING {self.stage} AS s ON {self._match('t', 's')} {update}"
            f"WHEN NOT MATCHED THEN INSERT ({self._list()}) VALUES ({self._list('s.')})"
        ]

    def statements(self, strategy: str) -> list[str]:
        """Statements of a strategy: ``on_conflict``, ``delete_insert`` or ``merge``."""
        if strategy not in STRATEGIES:
            raise ValueError(f"unknown merge strategy: {strategy}")
        return getattr(self, strategy)()


STRATEGIES = ("on_conflict", "delete_insert", "merge")


def drop(table: str) -> str:
    return f"DROP TABLE IF EXISTS {safe_identifier(table)}"


def count_where(table: str, name: str, value: str, quote: str = "") -> str:
    """Rows of a table with a text value in a column."""
    text = value.replace("'", "''")
    return f"SELECT COUNT(1) AS n FROM {safe_identifier(table)} WHERE {quoted(name, quote)} = '{text}'"


def empty_copy(table: str, like: str) -> str:
    """Create ``table`` with the columns of ``like`` and no rows, unless it exists."""
    return (
        f"CREATE TABLE IF NOT EXISTS {safe_identifier(table)} AS SELECT * FROM {safe_identifier(like)} WHERE 1 = 0"
    )


def replace_by(target: str, stage: str) -> str:
    """Replace the target, if there is one, by the rows of a loaded stage, in one statement of warehouses that have it."""
    return f"CREATE OR REPLACE TABLE {safe_identifier(target)} AS SELECT * FROM {safe_identifier(stage)}"


def swap_in(stage: str, target: str, keys: Sequence[str], quote: str = "") -> list[str]:
    """Replace the target by a loaded stage; in one transaction readers see the old or the new table."""
    rename = f"ALTER TABLE {safe_identifier(stage)} RENAME TO {safe_identifier(target).split('.')[-1]}"
    return [drop(target), rename, *([add_primary_key(target, keys, quote)] if keys else [])]


def add_primary_key(table: str, keys: Sequence[str], quote: str = "") -> str:
    return f"ALTER TABLE {safe_identifier(table)} ADD PRIMARY KEY ({', '.join(quoted(k, quote) for k in keys)})"


def redshift_stage(stage: str, like: str) -> str:
    return f"CREATE TEMP TABLE {safe_identifier(stage)} (LIKE {safe_identifier(like)})"


def redshift_copy(stage: str, uri: str, iam_role: str, region: str | None = None) -> str:
    """Load one staged batch folder; the trailing slash keeps sibling batches out."""
    where = f" REGION '{region}'" if region else ""
    return f"COPY {safe_identifier(stage)} FROM '{uri.rstrip('/')}/' IAM_ROLE '{iam_role}' FORMAT AS PARQUET{where}"
