"""anomaly_flags_all against its SQL over a table that has each flag and their combinations."""

import duckdb

from tallyloom.plans import catalog


def test_all_flags_of_all_questions(spark, tmp_path):
    quantities = {1: [1, 2], 2: [50, 50], 3: [20, 30], 4: [25, 25], 5: [50, 49], 6: [10, 30], 7: [50, 50], 8: [2, 1]}
    rows = [(q, float(v)) for q, many in quantities.items() for v in many]
    spark.createDataFrame(rows, "l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.question: r.flags for r in catalog.queries()["anomaly_flags_all"](spark, str(tmp_path)).collect()}
    assert got == {1: "near_zero,equal_rate", 2: "near_full,equal_rate", 3: "equal_rate", 4: "equal_rate", 5: "near_full", 7: "near_full,equal_rate", 8: "near_zero,equal_rate"}
    duck = duckdb.connect()
    duck.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    assert dict(duck.execute(catalog.oracle_sql()["anomaly_flags_all"]).fetchall()) == got
