"""Recorded steps, replayed on another table.

Steps within rows stay one lazy plan.  Steps on the row order share an index of
it, for which the table is written once, so that scans grow with the number of
such steps and not with its powers.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from sheetloom.operators.fixes import REGISTRY, apply_fix, find_fix
from sheetloom.operators.formulas import concatenate, if_column, text_extract
from sheetloom.operators.lookups import hlookup, vlookup
from sheetloom.operators.missing import fill_missing
from sheetloom.operators.ordered import OrderIndex, rank_column, serial_number
from sheetloom.operators.pivots import pivot_table
from sheetloom.rows import BUCKET, require_columns, require_row_id, with_row_id
from sheetloom.session import materialize, scratch_dir

# Replayable actions and their labels.
ACTION_LABELS = {
    "quick_fix": "Quick Fix",
    "fill_missing": "Missing Values Fill",
    "if": "IF Formula",
    "concatenate": "CONCATENATE",
    "text_extract": "LEFT/RIGHT/MID/LEN",
    "serial_number": "Serial Number",
    "rank": "RANK",
    "pivot": "Pivot Table",
    "vlookup": "VLOOKUP",
    "index_match": "INDEX-MATCH",
    "hlookup": "HLOOKUP",
}
LOOKUP_ACTIONS = ("vlookup", "index_match", "hlookup")
BUILT_IN = tuple(REGISTRY)  # a fix registered later may do anything to the rows


@dataclass
class Replay:
    df: DataFrame
    applied: list[dict] = field(default_factory=list)
    skipped: list[dict] = field(default_factory=list)


def _quick_fix(df: DataFrame, p: dict) -> DataFrame:
    fixed = apply_fix(df, p.get("fix_id"))
    if fixed is None:
        raise ValueError(f"there is no fix {p.get('fix_id')!r}")
    return fixed


def _pivot(df: DataFrame, p: dict) -> DataFrame:
    """A pivot is a new table: give its rows fixed ids before further steps."""
    pivoted = pivot_table(df, p["index_cols"], p["values_col"], p.get("agg_func", "sum"), p.get("columns_col"))
    scratch_dir(df.sparkSession)
    return with_row_id(pivoted).checkpoint()


# Steps that may drop, add or replace rows; after them an index of the row order no longer holds.
ROW_FIXES = ("remove_duplicates", "remove_empty_rows")


def _directions(p: dict) -> list[str]:
    return [(spec or {}).get("method") for spec in (p.get("strategies") or {}).values()]


def keeps_rows(action: str, p: dict) -> bool:
    """Whether a step leaves the rows as they are, whatever it does to their cells."""
    if action == "quick_fix":
        known = find_fix(p.get("fix_id"))
        return known is not None and known in BUILT_IN and known.id not in ROW_FIXES
    if action == "fill_missing":
        return "drop_rows" not in _directions(p)
    if action in ("vlookup", "index_match"):
        return p.get("how", "left") == "left"
    return action in ("if", "concatenate", "text_extract", "serial_number", "rank")


@dataclass
class _Sheet:
    """The table of a replay and, from the first step on that needs one, an index of its row order.

    The index writes the table once.  Steps read that, or what the last step on
    the order has written: a step that counts first never repeats the shuffles
    of an earlier one.
    """

    df: DataFrame
    index: OrderIndex | None = None
    shuffled: bool = False  # a step on the order is in the plan

    def in_order(self, counts: bool, run: Callable[[DataFrame, OrderIndex], DataFrame]) -> None:
        df, index, shuffled = self.df, self.index, self.shuffled
        if index is None:
            index = OrderIndex(OrderIndex.plain(df), write=True)
            df, shuffled = index.table, False
        elif counts and shuffled:
            df, shuffled = materialize(OrderIndex.plain(df), "ordered"), False
        self.df, self.index, self.shuffled = run(df, index), index, True

    def in_place(self, keeps: bool, run: Callable[[DataFrame], DataFrame]) -> None:
        self.df = run(OrderIndex.plain(self.df))
        if not keeps:
            self.index = None


STEPS: dict[str, Callable[[DataFrame, dict], DataFrame]] = {
    "quick_fix": _quick_fix,
    "fill_missing": lambda df, p: fill_missing(df, p.get("strategies", {})),
    "if": lambda df, p: if_column(
        df, p["column"], p["op"], p["value"], p["true_value"], p["false_value"], p["new_column"]
    ),
    "concatenate": lambda df, p: concatenate(df, p["columns"], p["separator"], p["new_column"]),
    "text_extract": lambda df, p: text_extract(
        df, p["column"], p["mode"], p["new_column"], p.get("n"), p.get("start"), p.get("length")
    ),
    "serial_number": lambda df, p: serial_number(df, p.get("new_column", "Sr No"), p.get("start", 1)),
    "rank": lambda df, p: rank_column(df, p["column"], p["new_column"], p.get("ascending", False)),
    "pivot": _pivot,
}


# Steps on the row order, whether they count before they run.
ORDER_STEPS: dict[str, tuple[bool, Callable[[DataFrame, dict, OrderIndex], DataFrame]]] = {
    "serial_number": (False, lambda df, p, index: serial_number(df, p.get("new_column", "Sr No"), p.get("start", 1), index)),
    "rank": (True, lambda df, p, index: STEPS["rank"](df, p)),
    "fill_missing": (True, lambda df, p, index: fill_missing(df, p.get("strategies", {}), index)),
}


def _on_order(action: str, p: dict) -> bool:
    if action == "fill_missing":
        return bool({"ffill", "bfill"} & set(_directions(p)))
    return action in ORDER_STEPS


def _vlookup(df: DataFrame, lookup: DataFrame, p: dict) -> DataFrame:
    return vlookup(df, lookup, p["key_column"], p["lookup_key_column"], p["value_columns"], p.get("how", "left"))


def _hlookup(df: DataFrame, lookup: DataFrame, p: dict) -> DataFrame:
    return hlookup(df, lookup, p["key_column"], p["lookup_key_row_index"], p["value_row_index"])


LOOKUP_STEPS: dict[str, Callable[[DataFrame, DataFrame, dict], DataFrame]] = {
    "vlookup": _vlookup,
    "index_match": _vlookup,
    "hlookup": _hlookup,
}


def apply_recipe(df: DataFrame, steps: list[dict[str, Any]], lookup_df: DataFrame | None = None) -> Replay:
    """Run the steps in order; a step that fails is skipped with its reason.

    A step is skipped for what is wrong with it: missing columns or parameters,
    bad arguments, expressions that do not resolve.  A job that fails, as some
    steps profile the table first, ends the replay.
    """
    replay = Replay(df)
    sheet = _Sheet(df)
    for i, step in enumerate(steps, start=1):
        action = step.get("action")
        params = step.get("params") or {}
        entry = {"step": i, "action": action, "label": ACTION_LABELS.get(action, action)}
        try:
            if action in LOOKUP_STEPS:
                if lookup_df is None:
                    raise ValueError("no lookup table was given")
                sheet.in_place(keeps_rows(action, params), lambda df: LOOKUP_STEPS[action](df, lookup_df, params))
            elif action in STEPS and _on_order(action, params):
                counts, run = ORDER_STEPS[action]
                _check_columns(sheet.df, action, params)
                sheet.in_order(counts, lambda df, index: run(df, params, index))
                if not keeps_rows(action, params):
                    sheet.index = None
            elif action in STEPS:
                sheet.in_place(keeps_rows(action, params), lambda df: STEPS[action](df, params))
            else:
                raise ValueError("this action cannot be replayed")
        except (ValueError, KeyError, TypeError, AnalysisException) as error:
            replay.skipped.append({**entry, "reason": _reason(error)})
        else:
            replay.applied.append(entry)
    replay.df = OrderIndex.plain(sheet.df) if BUCKET in sheet.df.columns else sheet.df
    return replay


def _check_columns(df: DataFrame, action: str, p: dict) -> None:
    """What a step on the order needs, before a table is written for it."""
    require_row_id(df)
    if action == "rank" and "column" in p:
        require_columns(df, p["column"])


def _reason(error: Exception) -> str:
    return f"missing parameter {error}" if isinstance(error, KeyError) else str(error)


class StepLog:
    """The replayable steps of a session, all of them or the newest `limit`; row-position edits are left out."""

    def __init__(self, steps: list[dict] | None = None, limit: int | None = None) -> None:
        self.steps = list(steps or [])
        self.limit = limit

    def record(self, action: str, params: dict) -> None:
        if action not in ACTION_LABELS:
            return
        self.steps = [*self.steps, {"action": action, "params": params}]
        if self.limit is not None:
            self.steps = self.steps[max(0, len(self.steps) - self.limit) :]


def labelled(steps: list[dict]) -> list[dict]:
    return [{**s, "label": ACTION_LABELS.get(s["action"], s["action"])} for s in steps]


def save_recipe(spark: SparkSession, path: str, name: str, steps: list[dict]) -> None:
    """Write a recipe as one JSON document."""
    if not name or not name.strip():
        raise ValueError("a recipe needs a name")
    if not steps:
        raise ValueError("a recipe needs at least one step")
    text = json.dumps({"name": name, "steps": steps, "created_at": time.time()})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_recipe(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def recipe_frame(spark: SparkSession, recipe: dict) -> DataFrame:
    """A recipe as rows (step, action, label, params)."""
    rows = [
        (i, s["action"], s["label"], json.dumps(s["params"], sort_keys=True))
        for i, s in enumerate(labelled(recipe["steps"]), start=1)
    ]
    return spark.createDataFrame(rows, "step int, action string, label string, params string")
