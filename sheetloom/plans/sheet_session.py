"""A sheet with undo, redo, reset, a lookup table, sheets and a step log.

Every version is a Parquet table below one folder, written once and never
changed: a whole copy, or a patch over an earlier version, which holds the row
ids that are left and the columns that changed.  A patched version is read by
joining on the row id; `FOLD` patches above each other make way for a whole
copy.  Undo and redo only move pointers.  The pointers are a small JSON
record, appended as a new file after each change, so a lost job leaves the
last complete state in place.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from sheetloom.plans.recipes import StepLog
from sheetloom.rows import ROW_ID, col, data_columns
from sheetloom.session import scratch_path
from sheetloom.sources.files import delete, exists, list_entries
from sheetloom.sources.workbook import SheetNotFound


#: Patches that a version may lie above a whole copy.
FOLD = 8


class SessionNotFound(KeyError):
    """No session in that folder."""


class NothingToUndo(LookupError):
    """The undo stack is empty."""


class NothingToRedo(LookupError):
    """The redo stack is empty."""


class NoLookupTable(LookupError):
    """No lookup table was set."""


class SheetSession:
    """``retention``: how many versions undo and redo go back at most; all, if None."""

    retention: int | None = None

    def __init__(self, spark: SparkSession, root: str, state: dict) -> None:
        self.spark = spark
        self.root = root
        self._state = state

    # -- life cycle ---------------------------------------------------------

    @classmethod
    def create(
        cls,
        spark: SparkSession,
        df: DataFrame | None = None,
        sheets: dict[str, DataFrame] | None = None,
        active: str | None = None,
        root: str | None = None,
    ) -> SheetSession:
        """Start from one table, or from several sheets of which one is active."""
        session = cls(spark, root or scratch_path(spark, "sheet"), {"seq": 0, "next": 0, "sheets": {}, "lookup": None})
        if sheets and len(sheets) > 1:
            state = session._state
            state["sheets"] = {name: session._store(table) for name, table in sheets.items()}
            state["active"] = active or next(iter(sheets))
            version = state["sheets"][state["active"]]
        else:
            table = df if df is not None else next(iter(sheets.values()))
            version = session._store(table)
        session._start_at(version)
        session._save()
        return session

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> SheetSession:
        folder = f"{root}/state"
        if not exists(spark, folder):
            raise SessionNotFound(root)
        complete = [e for e in list_entries(spark, folder) if exists(spark, f"{e.path}/_SUCCESS")]
        if not complete:
            raise SessionNotFound(root)
        text = spark.read.text(complete[-1].path).first()["value"]
        return cls(spark, root, json.loads(text))

    def _start_at(self, version: int) -> None:
        self._state |= {
            "original": version, "working": version, "undo": [], "redo": [], "history": [], "steps": [],
        }

    def _store(self, df: DataFrame) -> int:
        version = self._state["next"]
        df.write.parquet(self._path(version))
        self._state["next"] = version + 1
        return version

    def _store_patch(self, df: DataFrame, changed: list[str]) -> int:
        """``df`` as a patch of the working table; as a whole copy if rows are new or nothing would be saved."""
        base = self._state["working"]
        before, depth = self.working, self._depth(base)
        if ROW_ID not in df.columns or ROW_ID not in before.columns or depth >= FOLD:
            return self._store(df)
        kinds = dict(before.dtypes)
        names = data_columns(df)
        unknown = [c for c in changed if c not in kinds and c not in names]
        if unknown:
            raise ValueError(f"no such columns: {unknown}")
        held = [c for c, kind in df.dtypes if c != ROW_ID and (c in changed or kinds.get(c) != kind)]
        if names and len(held) == len(names):
            return self._store(df)
        version = self._store(df.select(col(ROW_ID), *[col(c) for c in held]))
        if not self._table(version).join(before.select(ROW_ID), ROW_ID, "left_anti").isEmpty():
            return self._store(df)  # the base has no values for new rows
        self._patches[str(version)] = {"base": base, "columns": names, "held": held}
        return version

    @property
    def _patches(self) -> dict:
        return self._state.setdefault("patches", {})

    def _depth(self, version: int) -> int:
        depth = 0
        while (patch := self._patches.get(str(version))) is not None:
            version, depth = patch["base"], depth + 1
        return depth

    def _path(self, version: int) -> str:
        return f"{self.root}/version={version}"

    def _table(self, version: int) -> DataFrame:
        return self.spark.read.parquet(self._path(version))

    def _read(self, version: int) -> DataFrame:
        patch = self._patches.get(str(version))
        if patch is None:
            return self._table(version)
        kept = [c for c in patch["columns"] if c not in patch["held"]]
        base = self._read(patch["base"]).select(col(ROW_ID), *[col(c) for c in kept])
        return base.join(self._table(version), ROW_ID).select(col(ROW_ID), *[col(c) for c in patch["columns"]])

    def _save(self) -> None:
        self._state["seq"] += 1
        record = self.spark.createDataFrame([(json.dumps(self._state),)], "value string")
        record.coalesce(1).write.text(f"{self.root}/state/{self._state['seq']:010d}")

    # -- the working table --------------------------------------------------

    @property
    def working(self) -> DataFrame:
        return self._read(self._state["working"])

    @property
    def original(self) -> DataFrame:
        return self._read(self._state["original"])

    def update(
        self, df: DataFrame, instruction: str = "", explanation: str = "", changed: list[str] | None = None
    ) -> DataFrame:
        """Make ``df`` the working table; the old one can be undone to.

        Without `changed` all of it is written.  With it, only the columns it
        names are, next to those that are new or of another type, and the ids
        of the rows left: the other columns must be as they were.  Where that
        is not known, :func:`~sheetloom.operators.versions.changed_columns`
        finds out.  A table with new rows is written whole.
        """
        version = self._store(df) if changed is None else self._store_patch(df, changed)
        self._push("undo")
        self._state["redo"] = []
        self._state["working"] = version
        if instruction or explanation:
            self._state["history"].append({"instruction": instruction, "explanation": explanation})
        self._save()
        return self.working

    def _push(self, stack: str) -> None:
        kept = [*self._state[stack], self._state["working"]]
        if self.retention is not None:
            kept = kept[max(0, len(kept) - self.retention) :]
        self._state[stack] = kept

    def undo(self) -> DataFrame:
        if not self._state["undo"]:
            raise NothingToUndo(self.root)
        previous = self._state["undo"].pop()
        self._push("redo")
        self._state["working"] = previous
        self._save()
        return self.working

    def redo(self) -> DataFrame:
        if not self._state["redo"]:
            raise NothingToRedo(self.root)
        following = self._state["redo"].pop()
        self._push("undo")
        self._state["working"] = following
        self._save()
        return self.working

    def reset(self) -> DataFrame:
        """Back to the original; itself undoable if anything had changed."""
        if self._state["working"] != self._state["original"]:
            self._push("undo")
        self._state |= {"working": self._state["original"], "history": [], "redo": []}
        self._save()
        return self.working

    def status(self) -> dict:
        return {
            "history": list(self._state["history"]),
            "can_undo": bool(self._state["undo"]),
            "can_redo": bool(self._state["redo"]),
        }

    def vacuum(self) -> list[int]:
        """Delete versions no stack refers to any more."""
        s = self._state
        live = {s["original"], s["working"], *s["undo"], *s["redo"], *s["sheets"].values(), s["lookup"]}
        for version in list(live):
            while (patch := self._patches.get(str(version))) is not None:
                version = patch["base"]
                live.add(version)
        dead = [v for v in range(s["next"]) if v not in live and exists(self.spark, self._path(v))]
        for version in dead:
            delete(self.spark, self._path(version))
        return dead

    # -- lookup table, sheets, steps ----------------------------------------

    def set_lookup(self, df: DataFrame) -> None:
        self._state["lookup"] = self._store(df)
        self._save()

    @property
    def lookup(self) -> DataFrame:
        if self._state["lookup"] is None:
            raise NoLookupTable(self.root)
        return self._read(self._state["lookup"])

    def sheet_names(self) -> dict:
        return {"sheets": list(self._state["sheets"]), "active_sheet": self._state.get("active")}

    def switch_sheet(self, name: str) -> DataFrame:
        """Start over with another sheet: its history, stacks and steps are empty."""
        if name not in self._state["sheets"]:
            raise SheetNotFound(name)
        self._state["active"] = name
        self._start_at(self._state["sheets"][name])
        self._save()
        return self.working

    def log_step(self, action: str, params: dict) -> None:
        log = StepLog(self._state["steps"])
        log.record(action, params)
        self._state["steps"] = log.steps
        self._save()

    @property
    def steps(self) -> list[dict]:
        return list(self._state["steps"])
