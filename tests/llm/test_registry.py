"""Every training-data query is registered, and its SQL can be planned."""

import duckdb

import __spark_entry__ as entry
from flowtide.llm import queries as llm

SF = "/root/testdata/sf0.001"


def test_queries_are_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in llm.QUERIES) == list(range(1, 14))
    assert set(llm.ORACLES) == {"op1_near_dedup", "op9_topk_search", "op11_spelling_variants", "op12_source_mix"}
    assert set(llm.QUERIES) | {"pipeline"} <= set(entry.queries())


def test_oracles_can_be_planned():
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for sql in llm.ORACLES.values():
        con.execute(f"EXPLAIN {sql}")
