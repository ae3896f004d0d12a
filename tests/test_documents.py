"""Documents of cells, which come in batches smaller and larger than a document."""

import random

from tallyloom.sources import semantic


def test_documents_over_batches(spark):
    r = random.Random(5)
    rows, want = [], {}
    for d in range(30):
        path = f"p{d}"
        tables = [[[f"Ş{r.randrange(50)} İ" if r.random() < 0.8 else "" for _ in range(r.randrange(1, 6))] for _ in range(r.randrange(1, 4))] for _ in range(r.randrange(3))]
        want[path] = tables
        for t, table in enumerate(tables):
            for i, row in enumerate(table):
                # empty cells are left out or null, but for a row's last one; tables and rows are numbered with gaps
                rows += [(path, 3 * t, 2 * i, c, v or None) for c, v in enumerate(row) if v or c == len(row) - 1 or r.random() < 0.5]
        if not tables or r.random() < 0.3:
            rows.append((path, None, None, None, None))
    rows += [r for r in rows[:5] if r[4]]  # a place has one cell
    r.shuffle(rows)
    cells = spark.createDataFrame(rows, "path string, table_ix int, row_ix int, cell_ix int, text string").repartition(3)
    for size in ("2", "7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            found = {x.path: x for x in semantic.documents(cells).collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert {k: x.tables for k, x in found.items()} == want
        assert {k: x.folded for k, x in found.items()} == {k: [[["s" + v[1:-2] + " i" if v else "" for v in row] for row in t] for t in tables] for k, tables in want.items()}


def test_cells_meet_once(spark):
    cells = spark.createDataFrame([("a", 0, 0, 0, "x")], "path string, table_ix int, row_ix int, cell_ix int, text string")
    plan = semantic.documents(cells)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "collect_list" not in plan
