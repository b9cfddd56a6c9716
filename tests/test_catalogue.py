"""Every query against its SQL on the smallest tables."""

import os
import time

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def canon(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.6g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(canon, v)) + "]"
    return str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(canon(r[c]) for c in columns) for r in df.collect())
    found = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(canon(row[names.index(c)]) for c in columns) for row in found.fetchall())
    assert got == want


def test_entry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_clips_hold_every_action_line(spark, tmp_path):
    schema = "scene_id string, slug string, heading string, action_lines array<string>, dialogue array<struct<character:string,line:string>>, ingested_at timestamp"
    lines = ["One.", "", "Two.", None, "Three.", "The watchmaker lifts the lantern."]
    spark.createDataFrame([("m_1", "m", "INT. HARBOR - NIGHT", lines, [], None)], schema).write.parquet(f"{tmp_path}/scenes.parquet")
    rows = entry.queries()["field_unpivot"](spark, str(tmp_path)).where("field_type = 'action'").collect()
    assert [r.content for r in rows] == ["One. Two. Three. The watchmaker lifts the lantern."]
    found = entry.queries()["video_query"](spark, str(tmp_path)).collect()
    assert [r.clip_id for r in found] == ["m_1"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_hybrid_retrieval_ends(spark):
    entry.catalogue._retriever(spark, SF)
    began = time.monotonic()
    rows = entry.queries()["retrieve_hybrid"](spark, SF).collect()
    assert time.monotonic() - began < 60  # each vector took half a second, of all five indices
    assert sorted(r["rank"] for r in rows) == list(range(1, len(rows) + 1)) and rows
