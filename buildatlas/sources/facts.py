"""Readers of per-file source facts: one text line a fact, with a fixed pattern a kind."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..plans.durable import stored


@dataclass(frozen=True)
class Fact:
    pattern: str
    columns: tuple[str, ...]


FILE, ID, WORD = '"(.*?)"', r"(\S*)", r"(\S*)"
_UNIT = ("file", "cmd_ids", "func", "line", "type", "signature")
_CTX = ("ctx_file", "cmd_ids", "ctx_func", "func", "line", "type")

FACTS = {
    "execution": Fact(" ".join([FILE, ID, WORD, WORD, WORD, "([^']*)"]), _UNIT),
    "declare_func": Fact(" ".join([FILE, ID, WORD, WORD, WORD, "([^']*)"]), _UNIT),
    "exported": Fact(" ".join([FILE, WORD]), ("file", "func")),
    "call": Fact(" ".join([FILE, ID, WORD, WORD, WORD, WORD]) + " ?(.*)", (*_CTX, "args")),
    "callp": Fact(" ".join([FILE, WORD, WORD, WORD]), ("ctx_file", "ctx_func", "func_ptr", "line")),
    "use_func": Fact(" ".join([FILE, ID, WORD, WORD, WORD, WORD]), _CTX),
    "use_var": Fact(" ".join([FILE, WORD, WORD, WORD]), ("ctx_file", "ctx_func", "var", "line")),
    "define": Fact(" ".join([FILE, WORD, WORD]), ("file", "macro", "line")),
    "expand": Fact(" ".join([FILE, FILE, WORD, WORD, WORD]), ("exp_file", "def_file", "macro", "exp_line", "def_line")),
    "expand_args": Fact(" ".join([FILE, WORD, "(.*)"]), ("exp_file", "macro", "args")),
    "typedefs": Fact(FILE + " typedef (.*)", ("scope_file", "declaration")),
    "init_global": Fact(FILE + ' "(.*?);" ' + " ".join([WORD, WORD, "(.*)"]), ("c_file", "signature", "cmd_ids", "type", "init")),
}


def typed(name: str, c: Column) -> Column:
    if name == "cmd_ids":
        return text.ids(c)
    if name in ("line", "exp_line", "def_line"):
        return c.cast("int")
    if name == "type":
        return text.storage(c)
    if name == "init":
        return F.try_parse_json(c)
    return c


def parse(lines: DataFrame, kind: str, canonical: DataFrame | None = None) -> DataFrame:
    """``(line)`` to the typed relation of ``kind``; a line that doesn't match is an error.

    ``canonical(path, canonical)`` replaces the paths of facts; it may leave out
    paths that stay, and is best counted once for all kinds, as ``sized`` does.
    """
    fact = FACTS[kind]
    # Two patterns are run a line: one that tests it, and one that brings all groups, parted by a character no log has.
    parted = F.regexp_replace("line", f"^{fact.pattern}$", "\x1f".join(f"${i}" for i in range(1, len(fact.columns) + 1)))
    groups = F.when(F.col("line").rlike(f"^{fact.pattern}$"), F.split(parted, "\x1f")).otherwise(F.raise_error(F.concat(F.lit(f"bad {kind} fact: "), F.col("line"))))
    out = []
    for i, name in enumerate(fact.columns):
        c = F.col("__g")[i]
        if name == "args":
            c = text.call_args(c) if kind == "call" else text.macro_args(c)
        out.append(typed(name, c).alias(name))
    got = lines.select(F.inline(F.array(F.struct(groups.alias("__g"))))).select(*out)
    if canonical is not None and any(n.endswith("file") for n in fact.columns):
        for name in fact.columns:
            if name.endswith("file"):
                known = canonical.select(F.col("path").alias(name), F.col("canonical").alias("__c"))
                got = got.join(known, name, "left").withColumn(name, F.coalesce("__c", name)).drop("__c").select(*fact.columns)
    return got


def archive_lines(archives: DataFrame, marker: str = "EXPANDED") -> DataFrame:
    """``kind, line`` of the facts in zip files ``(content)``: a member's name ends the kind, what stands before is the source's path.

    Each line gets its path in quotes before it. The facts of expansions lie
    below two paths with a directory ``marker`` between them.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content").to_pylist():
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in z.namelist():
                        where, _, name = member.strip("/").rpartition("/")
                        if not name.endswith(".txt"):
                            continue
                        head = " ".join(f'"/{p.strip("/")}"' for p in where.split(f"/{marker}/"))
                        with z.open(member) as lines:
                            text_ = [f"{head} {x}" for x in io.TextIOWrapper(lines, "utf-8", "replace", newline="\n").read().split("\n") if x]
                        yield pa.RecordBatch.from_arrays([pa.array([name[:-4]] * len(text_), pa.string()), pa.array(text_, pa.string())], names=["kind", "line"])

    return archives.select("content").mapInArrow(unpack, "kind string, line string")


def read_archives(spark: SparkSession, path: str, marker: str = "EXPANDED") -> dict[str, DataFrame]:
    """The fact lines of all zip files below ``path`` by kind, as ``Project`` takes them."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.zip").load(path)
    rows = stored(archive_lines(found, marker))
    return {k: rows.where(F.col("kind") == k).select("line") for k in FACTS}


def cleaned(path: Column, prefixes: list[str]) -> Column:
    """A fact file's path without the first of the store's or output's prefixes that it begins with."""
    out = path
    for p in reversed(prefixes):
        p = p.rstrip("/")
        out = F.when(path.startswith(p + "/"), F.substring(path, F.lit(len(p) + 1), F.length(path))).otherwise(out)
    return out


def combined(lines: DataFrame) -> DataFrame:
    """Equal facts of a file as one, with their command ids joined: ``(path, cmd_id, rest)`` to ``path, ids, rest``."""
    ids = F.array_sort(F.collect_set(F.col("cmd_id").cast("bigint")))
    return lines.groupBy("path", "rest").agg(F.concat_ws(",", ids.cast("array<string>")).alias("ids")).select("path", "ids", "rest")


def distinct_lines(lines: DataFrame) -> DataFrame:
    return lines.select("path", "line").distinct()
