"""Readers and writers of command, environment and open-call logs.

A command's id is its line number. Logs are read in splits like any text; lines
are numbered within their split, and a row per split says what comes before it.
"""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.durable import sized, stored

SEPARATOR = "||"


def fields(line: Column) -> Column:
    return F.split(F.regexp_replace(line, r"^\s+|\s+$", ""), r"\|\|")


def parse_commands(lines: DataFrame) -> DataFrame:
    """``(id, line)`` to ``id, cwd, pid, which, command``."""
    f = fields(F.col("line"))
    return lines.select(F.col("id").cast("bigint").alias("id"), f[0].alias("cwd"), f[1].cast("bigint").alias("pid"), f[2].alias("which"), F.slice(f, F.lit(4), F.greatest(F.size(f) - 3, F.lit(0))).alias("command"))


def join_commands(cmds: DataFrame) -> DataFrame:
    """The inverse of ``parse_commands``."""
    return cmds.select("id", F.concat_ws(SEPARATOR, "cwd", F.col("pid").cast("string"), "which", F.concat_ws(SEPARATOR, "command")).alias("line"))


def numbered(spark: SparkSession, path: str, separator: str = "\n") -> DataFrame:
    """``(id, line)`` of the records of a text file, or of a folder's files in the order of their names; from 1, blank ones too.

    The numbered splits are stored, so what says how many records come before
    a split and the records themselves are of one reading.
    """
    read = spark.read.option("lineSep", separator).text(path)
    # Numbers follow each other within a split, whatever else its task reads.
    split = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"))
    rows = stored(read.select(split.alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line")))
    splits = rows.groupBy("split").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select("split", "first", F.coalesce(earlier, F.lit(0)).alias("before"))  # a row for each split of the log
    placed = rows.join(sized(splits), "split")
    return placed.select((F.col("at") - F.col("first") + F.col("before") + 1).alias("id"), "line")


def ends_with(spark: SparkSession, path: str, tail: bytes) -> bool:
    """Whether the file's last bytes are ``tail``; nothing else of it is read."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    begin = fs.getFileStatus(at).getLen() - len(tail)
    if begin < 0:
        return False
    stream = fs.open(at)
    try:
        stream.seek(begin)
        return bytes(stream.read() for _ in tail) == tail
    finally:
        stream.close()


def read_commands(spark: SparkSession, path: str) -> DataFrame:
    """Commands of a log file; an empty or missing log is an error."""
    cmds = parse_commands(numbered(spark, path).where(F.trim("line") != ""))
    if cmds.isEmpty():
        raise RuntimeError(f"no commands in {path}")
    return cmds


def write_commands(cmds: DataFrame, path: str) -> None:
    """The log as part files, in the order of their names."""
    join_commands(cmds).orderBy("id").select("line").write.text(path)


def parse_envs(blocks: DataFrame) -> DataFrame:
    """``(id, block)`` to ``id, name, value``; the last of equal names counts."""
    lines = blocks.select("id", F.posexplode(F.split("block", "\n")).alias("at", "line")).where(F.instr("line", "=") > 0)
    pair = lines.select("id", "at", F.substring_index("line", "=", 1).alias("name"), F.expr("substring(line, instr(line, '=') + 1)").alias("value"))
    return pair.groupBy("id", "name").agg(F.max_by("value", "at").alias("value"))


def read_envs(spark: SparkSession, path: str) -> DataFrame:
    """Blocks end with a blank line; what follows the last blank line is no block."""
    blocks = numbered(spark, path, "\n\n").withColumnRenamed("line", "block")
    if not ends_with(spark, path, b"\n\n"):
        blocks = blocks.join(F.broadcast(blocks.agg(F.max("id").alias("last"))), F.col("id") < F.col("last")).drop("last")
    return parse_envs(blocks)


def env_ends(envs: DataFrame) -> DataFrame:
    """First and last block of parsed environments."""
    return envs.agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"))


def count_with(lines: DataFrame, text: str) -> DataFrame:
    """How many lines hold ``text``, such as a tool's message of failure."""
    return lines.where(F.col("line").contains(text)).agg(F.count("*").alias("n"))


def warnings(found: DataFrame) -> DataFrame:
    """``warning, n`` by falling number, then by text."""
    return found.groupBy("warning").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "warning")


def parse_opens(lines: DataFrame) -> DataFrame:
    f = F.split("line", " ", 4)
    return lines.select(f[0].cast("bigint").alias("cmd_id"), (f[1] == "1").alias("existed"), f[2].cast("int").alias("flags"), f[3].alias("path"))


def source_lines(files: DataFrame) -> DataFrame:
    """``(path, content)`` to ``path, line_no, text``."""
    lines = F.split(F.regexp_replace("content", "\n$", ""), "\n")
    return files.where("content <> ''").select("path", F.posexplode(lines).alias("at", "text")).select("path", (F.col("at") + 1).alias("line_no"), "text")


def stored_files(spark: SparkSession, root: str, encoding: str | None = "UTF-8") -> DataFrame:
    """Files below ``root`` as ``path, content, md5``, line ends unified; without ``encoding`` each file's is detected."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", decoded(F.col("content"), encoding).alias("content"), F.md5("content").alias("md5"))


def decoded(content: Column, encoding: str | None = None) -> Column:
    """Text of bytes with line ends unified; Arrow batches, for Java's functions know few encodings.

    Without ``encoding``: what a byte order mark says; else UTF-8 where the
    bytes are valid UTF-8, and Windows-1251 where they aren't.
    """

    def one(data: bytes | None) -> str | None:
        if data is None:
            return None
        if encoding is not None:
            text = data.decode(encoding, "replace")
        elif data.startswith((codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE)):
            text = data.decode("utf-16", "replace")
        else:
            try:
                text = data.decode("utf-8-sig")
            except UnicodeDecodeError:
                text = data.decode("windows-1251", "replace")
        return text.replace("\r\n", "\n")

    @F.pandas_udf("string")
    def of(batch: pd.Series) -> pd.Series:
        return batch.map(one)

    return of(content)


def store_files(files: DataFrame, store: str) -> None:
    """``path, content`` added to a store; paths that it has already stay as they are."""
    new = files.select("path", "content").dropDuplicates(["path"]).withColumn("md5", F.md5(F.col("content").cast("binary")))
    spark = files.sparkSession
    if spark._jvm.org.apache.hadoop.fs.Path(store).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(store)):
        new = new.join(spark.read.parquet(store).select("path"), "path", "left_anti")
    new.write.mode("append").parquet(store)
