"""What an operator changed, counted by the action that runs anyway."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from sheetloom.rows import col


class ChangeLog:
    """Collects row and cell counts through ``DataFrame.observe``.

    Pass one to an operator, run any action on the result, then call
    :meth:`counts`.  No extra job is started.
    """

    def __init__(self) -> None:
        self._watched: list[Observation] = []

    def watch(self, df: DataFrame, **metrics: Column) -> DataFrame:
        observation = Observation()
        self._watched.append(observation)
        return df.observe(observation, *[m.alias(name) for name, m in metrics.items()])

    def counts(self) -> dict[str, int]:
        found: dict[str, int] = {}
        for observation in self._watched:
            found.update(observation.get)
        if "rows_before" in found and "rows_after" in found:
            found["rows_removed"] = found["rows_before"] - found["rows_after"]
        cells = [v for k, v in found.items() if k.startswith("changed:")]
        if cells:
            found["cells_changed"] = sum(cells)
        return found


def rewrite(df: DataFrame, cells: dict[str, Column], log: ChangeLog | None = None) -> DataFrame:
    """Replace columns in place, counting the changed cells if asked to."""
    if not cells:
        return df
    if log is None:
        return df.withColumns(cells)
    fresh = {f"__new{i}": expr for i, expr in enumerate(cells.values())}
    wide = df.withColumns(fresh)
    same = {
        f"changed:{name}": F.count_if(~col(name).cast("string").eqNullSafe(F.col(tmp).cast("string")))
        for name, tmp in zip(cells, fresh)
    }
    wide = log.watch(wide, **same)
    final = dict(zip(cells, fresh))
    return wide.select(*[F.col(final[c]).alias(c) if c in final else col(c) for c in df.columns])


def filtered(df: DataFrame, step, log: ChangeLog | None = None) -> DataFrame:
    """Apply a row-removing step, counting rows before and after if asked to."""
    if log is None:
        return step(df)
    before = log.watch(df, rows_before=F.count(F.lit(1)))
    return log.watch(step(before), rows_after=F.count(F.lit(1)))
