import random

import pytest
from conftest import rows

from sheetloom.rows import ROW_ID
from sheetloom.sources import tables


@pytest.mark.parametrize("bits", [63, 33])
def test_rows_keep_the_order_of_files_and_lines(spark, tmp_path, monkeypatch, bits):
    """Also where the numbers of file, task and row do not fit one id; tasks read parts of files and many files."""
    monkeypatch.setattr(tables, "ID_BITS", bits)
    rng = random.Random(2)
    folder = tmp_path / "in.csv"
    folder.mkdir()
    want = []
    for f in rng.sample(range(40), 40):
        lines = [(f"f{f:02d}", i, "x" * rng.randrange(30)) for i in range(0 if f == 7 else 3000 if f == 9 else rng.randrange(1, 9))]
        (folder / f"part-{f:02d}.csv").write_text("name,at,note\n" + "".join(f"{a},{b},{c}\n" for a, b, c in lines))
        want += lines
    want = [(a, b, c or None) for a, b, c in sorted(want)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
        spark.conf.set("spark.sql.files.openCostInBytes", "512")
        df = tables.read_delimited(spark, str(folder))
        assert rows(df.select(ROW_ID, "name", "at", "note")) == want
        if bits == 33:
            ids = sorted(r[0] for r in df.select(ROW_ID).collect())
            assert ids == list(range(len(want)))
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
