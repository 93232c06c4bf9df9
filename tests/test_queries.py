"""Every registered query of the case operators against its SQL, and the entry point."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from caseloom.plans import queries
from caseloom.streaming import stream


def value(v) -> str:
    return repr(round(v, 9) + 0.0) if isinstance(v, float) else repr(v)


def compare(spark, sf_dir: str, run, sql: str) -> None:
    df = run(spark, sf_dir)
    columns = sorted(df.columns)
    got = Counter(tuple(value(r[c]) for c in columns) for r in df.collect())
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"create view {name.split('.')[0]} as select * from '{sf_dir}/{name}'")
    answer = con.execute(sql)
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    want = Counter(tuple(value(r[names.index(c)]) for c in columns) for r in answer.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    compare(spark, sf_dir, queries.QUERIES[name], queries.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_query_runs(spark, sf_dir, name):
    assert queries.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    from caseloom.operators.extract import extract_profiles
    from caseloom.plans import synth

    cases = synth.case_text(spark, sf_dir)
    cases.repartition(4).write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    profiles = stream.stream_profiles(stream.read_stream(spark, str(tmp_path / "in"), cases.schema, files_per_trigger=2))
    stream.run_available(profiles, lambda df, _: df.write.mode("append").parquet(out), str(tmp_path / "checkpoint"))
    want = Counter(map(str, extract_profiles(cases).select("case_id", "court_level", "key_facts").collect()))
    assert Counter(map(str, spark.read.parquet(out).select("case_id", "court_level", "key_facts").collect())) == want


@pytest.mark.parametrize("name", ["htm_01_clean_text", "htm_02_03_search_rows", "htm_04_judgment_pages"])
def test_cut_references_as_in_sql(spark, tmp_path, name):
    cut = ("a &quot", "a &amp", "a &am", "a &quo", "a &copy", "a &", "R&ampD &quotx; &nosuch; &middotx", "&amp;quot &amp;lt; &quot;b&quot;")
    pages = [(i, f"<html><head><title>{t}</title></head><body><a href='/x?a=1&copy=2'>l</a><article><h1>{t}</h1><p>{t}</p></article></body></html>") for i, t in enumerate(cut)]
    spark.createDataFrame(pages, "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "made"))
    sf_dir = tmp_path / "in"
    sf_dir.mkdir()
    (sf_dir / "pages.parquet").write_bytes(next((tmp_path / "made").glob("*.parquet")).read_bytes())
    compare(spark, str(sf_dir), queries.QUERIES[name], queries.ORACLE_SQL[name])
