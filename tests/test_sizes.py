"""What has to stay true when tables grow: how work is cut, what is read once, what is joined with what."""

from pathlib import Path

from pyspark.sql import functions as F

import __spark_entry__ as entry
from buildatlas import workshop
from buildatlas.functions import text
from buildatlas.operators import crossref, graph
from buildatlas.plans.durable import materialised
from buildatlas.plans.project import Project


def suppliers(spark, path, n):
    spark.range(n).select(F.col("id").alias("s_suppkey")).coalesce(1).write.parquet(f"{path}/supplier.parquet")
    return str(path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_builds_are_dealt_over_tasks(spark, tmp_path):
    """The suppliers of one small file aren't built in one task."""
    n = 2 * workshop.BUILDS + 200
    log = workshop.log(spark, suppliers(spark, tmp_path, n))
    sizes = log.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 3 and max(r["count"] for r in sizes) < n / 2 * len(workshop.LOG)
    assert log.select("id").distinct().count() == n * len(workshop.LOG) == log.count()


def test_each_pair_of_ancestors_is_made_once(spark):
    """A row a way, as the SQL's UNION ALL has it; nothing is made twice and thrown away."""
    forest = spark.createDataFrame([(1, 0), (2, 1), (2, 1), (3, 2), (4, 3), (9, 20)], "id long, pid long")
    up = graph.ancestors(forest)
    assert sorted(map(tuple, up.collect())) == sorted([(1, 0, 1), *[(2, 1, 1), (2, 0, 2)] * 2, (3, 2, 1), *[(3, 1, 2), (3, 0, 3)] * 2, (4, 3, 1), (4, 2, 2), *[(4, 1, 3), (4, 0, 4)] * 2])
    assert graph.ancestors(forest.where("id = 9")).isEmpty()


def test_guessed_sizes_are_dropped(spark, tmp_path):
    """Rows of a small file that became many are not broadcast by the file's size."""
    spark.range(10).write.parquet(f"{tmp_path}/t")
    many = materialised(spark.read.parquet(f"{tmp_path}/t").select(F.explode(F.sequence(F.lit(0), F.lit(999))).alias("k"), "id"))
    assert many.count() == 10_000 and many.columns == ["k", "id"]
    assert "BroadcastHashJoin" not in plan(many.join(many.groupBy("k").count(), "k"))
    assert many.join(many.groupBy("k").count(), "k").agg(F.sum("count")).first()[0] == 100_000


def test_only_renamed_paths_are_sent(spark, tmp_path):
    """Of a build's files only those that another stands for meet the facts."""
    d = suppliers(spark, tmp_path, 3)
    p = Project(spark, workshop.log(spark, d), files=workshop.files(spark, d))
    assert sorted((r.path, r.canonical) for r in p.get("renamed").collect()) == [(f"/b{i}/link.c", f"/b{i}/lamp.c") for i in (1, 2, 3)]
    assert "FileScan" not in plan(p.get("canonical"))


def test_words_of_a_line_in_one_row(spark):
    lines = spark.createDataFrame([(1, "a_b  c, é1"), (2, ""), (3, None), (4, "x" * 9), (5, "...")] + [(i, f"w{i} w{i}") for i in range(6, 700)], "k int, text string")
    found = text.line_words(lines)
    assert found.count() == lines.count()
    each = sorted((r.k, r.name, r.start, r.end) for r in text.token_rows(lines).collect())
    assert sorted((r.k, *w) for r in found.collect() for w in r.words) == each


def test_words_are_cut_once(spark):
    """Occurrences are stored: what filters them by kind doesn't cut the lines again."""
    wanted = spark.createDataFrame([("f", 1, "ab", k) for k in ("call", "expand", "def_macro", "call")], "file string, line int, name string, kind string")
    found = crossref.occurrences(wanted, spark.createDataFrame([("f", 1, "ab(ab, cab, ab_)")], "path string, line_no int, text string"))
    assert "MapInArrow" not in plan(found)
    assert sorted((r.kind, r.start, r.end) for r in found.collect()) == [("call", 0, 2), ("call", 3, 5), ("def_macro", 0, 2), ("expand", 0, 2), ("expand", 3, 5)]
    assert sorted(text.places("a ba a_ a", ["a", "."])) == sorted(text.places("a ba a_ a", ["a", ".", "x", "y", "z"])) == [("a", 0, 1), ("a", 8, 9)]


def test_a_common_value_is_saved_by_several_tasks(spark, tmp_path):
    p = Project(spark, spark.range(1))
    p._built["cmds"] = spark.range(40_000).select("id", F.when(F.col("id") % 100 == 0, "LN").otherwise("CC").alias("type"), F.expr("sha2(cast(id AS string), 256)").alias("x")).repartition(8)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        p.save(str(tmp_path), "cmds", by="type")
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(list(Path(tmp_path, "cmds/type=CC").glob("*.parquet"))) > 1
    assert Project.load(spark, str(tmp_path), "cmds").count() == 40_000 and Project.load(spark, str(tmp_path), "cmds", type=["LN"]).count() == 400


def test_dot_reads_its_edges_once(spark, tmp_path):
    spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c")], "src string, dst string").write.parquet(f"{tmp_path}/e")
    lines = graph.dot(spark.read.parquet(f"{tmp_path}/e"))
    assert plan(lines).count("FileScan") == 1
    assert len(lines.collect()) == 5 and sum("->" in r.line for r in lines.collect()) == 2


def test_reads_and_writes_are_read_once(spark, sf_dir):
    """Reads, writes and users are stored before several joins use them."""
    assert "lineitem" not in plan(entry.queries()["files_linked"](spark, sf_dir))
