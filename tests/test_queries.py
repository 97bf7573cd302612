"""Every query with SQL against DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry
from buildatlas import queries, workshop
from buildatlas.operators import crossref
from buildatlas.sources import logs

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, sf_dir, db, name):
    df, rel = entry.queries()[name](spark, sf_dir), db.sql(entry.oracle_sql()[name])
    names = sorted(df.columns)
    assert names == sorted(rel.columns)
    at = [rel.columns.index(c) for c in names]
    fixed = lambda v: round(v, 9) if isinstance(v, float) else v
    assert sorted((tuple(fixed(r[c]) for c in names) for r in df.collect()), key=repr) == sorted((tuple(fixed(r[i]) for i in at) for r in rel.fetchall()), key=repr)


def test_entry(spark, sf_dir):
    assert entry.entry(spark).count() > 0
    assert queries.QUERIES["stream_ingest"](spark, sf_dir).count() == queries.QUERIES["cmds_scan"](spark, sf_dir).count()


def test_numbers_of_several_digits(spark, tmp_path):
    """Directives keep their ``#``, so macros stand at the same place in builds 10, 100 and 12345."""
    spark.createDataFrame([(9,), (99,), (12344,)], "s_suppkey long").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    files = workshop.files(spark, str(tmp_path)).where("path LIKE '%/bulb.c'")
    text = {r.path: r.content.split("\n") for r in files.collect()}
    assert text["/b100/bulb.c"][:2] == ['#include "bulb.h"', "#define HALF(x) ((x) / 2)"] and text["/b100/bulb.c"][-2] == "// 100"
    wanted = files.selectExpr("path AS file", "2 AS line", "'HALF' AS name", "'def_macro' AS kind")
    found = crossref.occurrences(wanted, logs.source_lines(files))
    assert sorted((r.file, r.start, r.end) for r in found.collect()) == [("/b10/bulb.c", 8, 12), ("/b100/bulb.c", 8, 12), ("/b12345/bulb.c", 8, 12)]
