"""The driver's tables seen as build logs and source facts; whole tables, no row is left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources import logs

WHICH = {"CC": [r"cc$", r"clang(?:-\d+)?$"], "LD": [r"(?:/|-)ld$", r"ld\.lld$"], "AR": [r"(?:/|-)ar$"], "MV": ["/mv$"], "Objcopy": ["objcopy$"]}
TOOL = "CASE event_type WHEN 'click' THEN 'gcc' WHEN 'view' THEN 'ld' WHEN 'purchase' THEN 'mv' WHEN 'signup' THEN 'ar' ELSE 'objcopy' END"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Events as log lines ``id, line``."""
    e = table(spark, d, "events").selectExpr("event_id", "user_id % 7 AS u", f"{TOOL} AS tool", "cast(event_id % 97 AS string) AS k")
    argv = F.expr(
        "CASE tool WHEN 'gcc' THEN concat('gcc||-c||f', k, '.c||-o||f', k, '.o') WHEN 'ld' THEN concat('ld||-o||prog', k, '||f', k, '.o||lib', k, '.a') "
        "WHEN 'ar' THEN concat('ar||rcs||lib', k, '.a||f', k, '.o') WHEN 'mv' THEN concat('mv||-f||f', k, '.o||g', k, '.o') ELSE concat('objcopy||--strip-all||f', k, '.o||h', k, '.o') END"
    )
    line = F.concat_ws("||", F.concat(F.lit("/work/u"), F.col("u").cast("string")), F.expr("cast(event_id div 4 AS string)"), F.concat(F.lit("/usr/bin/"), "tool"), argv)
    return e.select((F.col("event_id") + 1).alias("id"), line.alias("line"))


def raw(spark: SparkSession, d: str) -> DataFrame:
    return logs.parse_commands(lines(spark, d))


def cmd_io(spark: SparkSession, d: str) -> DataFrame:
    """Line items as reads and writes of paths, in projects of fifty commands."""
    return table(spark, d, "lineitem").selectExpr("l_orderkey + 1 AS id", "concat('/proj', l_orderkey div 50, '/p', l_partkey % 40) AS path", "l_linenumber = 1 AS is_out").distinct()


def files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").selectExpr("concat('/src/', source, '/d', doc_id, '.c') AS path", "md5(text) AS md5", "doc_id % 4 <> 0 AS in_storage", "text AS content")


def definitions(spark: SparkSession, d: str) -> DataFrame:
    """Parts as definition facts; about seven share a function's name at any scale."""
    return table(spark, d, "part").selectExpr(
        "concat('f', p_partkey div 7) AS func", "concat('/src/m', p_partkey % 47, '.c') AS file", "array(p_partkey % 47) AS cmd_ids", "cast(p_size AS int) AS line",
        "CASE WHEN p_partkey % 3 = 0 THEN 'static' ELSE 'extern' END AS type", "p_brand AS signature", "p_partkey AS ord",
    )


def calls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr(
        "concat_ws('/', l_orderkey, l_linenumber, l_suppkey, l_partkey, l_linestatus) AS ref_id", "concat('/src/m', l_suppkey % 47, '.c') AS ctx_file", "array(l_suppkey % 61) AS cmds", "array((l_suppkey % 61) div 5) AS used",
        "concat('f', l_partkey div 7) AS func", "CASE WHEN l_linestatus = 'O' THEN 'static' ELSE 'extern' END AS type",
    ).distinct()


def resolvable(spark: SparkSession, d: str) -> DataFrame:
    """Definitions as ``resolve`` wants them; every eleventh is exported, declared in the unit five on."""
    return table(spark, d, "part").selectExpr(
        "concat('f', p_partkey div 7) AS func", "concat('/src/m', p_partkey % 47, '.c') AS d_file", "array(p_partkey % 47) AS d_cmds", "array((p_partkey % 47) div 5) AS d_used",
        "array((p_partkey % 47) + 5) AS d_decl", "CASE WHEN p_partkey % 11 = 0 THEN 'exported' WHEN p_partkey % 3 = 0 THEN 'static' ELSE 'extern' END AS d_type",
    ).distinct()


def call_edges(spark: SparkSession, d: str) -> DataFrame:
    """Two layers of calls among functions, as node numbers."""
    li = table(spark, d, "lineitem")
    one = li.selectExpr("l_suppkey % 100 AS src", "100 + l_partkey % 300 AS dst")
    return one.union(li.selectExpr("100 + l_partkey % 300 AS src", "400 + l_orderkey % 90 AS dst")).distinct()


def source(spark: SparkSession, d: str) -> DataFrame:
    return logs.source_lines(table(spark, d, "documents").selectExpr("concat('/d', doc_id) AS path", "text AS content"))
