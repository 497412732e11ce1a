import glob
import os

import pytest

from helixframe.llm import queries

COLUMNS = {
    "p1_found": [("rec_id", "string"), ("span_start", "int"), ("span_len", "int")],
    "p3_found": [("id_a", "string"), ("id_b", "string")],
    "p4_found": [("split_name", "string"), ("eval_id", "string"), ("train_id", "string")],
    "p5_found": [("id", "string"), ("group_id", "string")],
    "p6_ids": [("doc_id", "bigint"), ("ids", "array<int>")],
    "p7_found": [("doc_id", "bigint"), ("item_id", "bigint")],
    "p8_found": [("doc_id", "bigint")],
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_runs_on_the_smallest_tables(spark, data, name):
    df = queries.queries()[name](spark, data)
    if name in COLUMNS:
        assert df.dtypes == COLUMNS[name]
    rows = df.collect()
    assert len(rows) > 0
    if name in queries.oracle_sql():
        duckdb = pytest.importorskip("duckdb")
        c = duckdb.connect()
        for p in glob.glob(f"{data}/*.parquet"):
            c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
        res = c.execute(queries.oracle_sql()[name])
        names, cols = [x[0] for x in res.description], sorted(df.columns)
        assert sorted(names) == cols
        assert sorted(str([r[x] for x in cols]) for r in rows) == sorted(str([r[names.index(x)] for x in cols]) for r in res.fetchall())
    if name.endswith("_found"):
        assert len({tuple(r) for r in rows}) == len(rows)
