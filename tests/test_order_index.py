"""Steps on the row order: one index for many steps, one scan for each step."""

import pytest

from sheetloom.operators import ordered
from sheetloom.plans import recipes
from tests.conftest import rows, values


def _scans(df):
    """Leaves of the plan that read files or the driver's rows, without the small broadcast tables."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return sum(line.count("Relation [") for line in plan.splitlines())


def _plan_steps(n):
    return [{"action": "rank", "params": {"column": "R" if i else "v", "new_column": "R"}} for i in range(n)] + [
        {"action": "serial_number", "params": {}},
        {"action": "fill_missing", "params": {"strategies": {"v": {"method": "ffill"}, "t": {"method": "bfill"}}}},
    ]


@pytest.fixture(scope="module")
def gappy(spark, sheet):
    cells = [(float(i % 7) if i % 3 else None, f"cell {i}" if i % 11 == 0 else ("  " if i % 5 == 0 else None)) for i in range(300)]
    return sheet("v double, t string", cells).repartition(3)


def test_a_chain_of_order_steps_reads_the_table_once_a_step(gappy):
    found = {n: _scans(recipes.apply_recipe(gappy, _plan_steps(n)).df) for n in (1, 4)}
    assert found == {1: 1, 4: 1}


def test_a_chain_of_order_steps_is_that_of_pandas(gappy):
    out = recipes.apply_recipe(gappy, _plan_steps(2)).df
    assert out.columns == ["Sr No", "_row_id", "v", "t", "R"]
    got = out.toPandas().sort_values("_row_id").reset_index(drop=True)
    want = gappy.toPandas().sort_values("_row_id").reset_index(drop=True)
    once = want["v"].rank(method="min", ascending=False)
    assert got["R"].equals(once.rank(method="min", ascending=False))
    assert got["Sr No"].tolist() == list(range(1, 301))
    assert got["v"].equals(want["v"].ffill())
    filled = want["t"].where(want["t"].fillna("").str.strip() != "").bfill()
    assert [x if isinstance(x, str) else None for x in got["t"]] == [x if isinstance(x, str) else None for x in filled]


def test_an_index_is_renewed_when_rows_go(sheet):
    df = sheet("A string", ["x", None, "y", "x", None])
    steps = [
        {"action": "serial_number", "params": {"new_column": "n"}},
        {"action": "fill_missing", "params": {"strategies": {"A": {"method": "drop_rows"}}}},
        {"action": "serial_number", "params": {"new_column": "m"}},
        {"action": "quick_fix", "params": {"fix_id": "remove_duplicates"}},
    ]
    replay = recipes.apply_recipe(df, steps)
    assert not replay.skipped and rows(replay.df) == [(1, 1, "x"), (2, 3, "y"), (3, 4, "x")]


def test_neighbouring_steps_share_one_shuffle(gappy):
    index = ordered.OrderIndex(gappy, write=True)
    out = ordered.directional_fill(ordered.serial_number(index.table, index=index), ["v"], index=index)
    out = ordered.serial_number(out, "again", index=index)
    plan = index.plain(out)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # the fill deals its copies anew


def test_complete_columns_are_left_alone(gappy, sheet):
    whole = sheet("A long, B string", [(1, "x"), (2, "y")])
    assert ordered.directional_fill(whole, ["A"], ["B"]) is whole
    empty = sheet("A long, B string", [])
    assert ordered.directional_fill(empty, ["A"]).count() == 0 and ordered.serial_number(empty).count() == 0
    assert ordered.rank_column(empty, "A", "R").count() == 0


def test_cells_travel_far(sheet):
    long = "long cell " * 50_000
    df = sheet("t string, n long", [(long, 1)] + [(None, None)] * 400 + [("end", 2)] + [("", None)] * 40)
    out = ordered.directional_fill(df, ["t"], ["n"])
    assert values(out, "t") == [long] * 401 + ["end"] * 41
    assert values(out, "n") == [1] + [2] * 401 + [None] * 40
