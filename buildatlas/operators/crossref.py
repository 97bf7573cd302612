"""Cross-references: where names stand, what they lead to, and from where they are reached."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..plans.durable import stored


def locations(**kinds: DataFrame) -> DataFrame:
    """``file, line, name, kind``; each argument is a kind's ``(file, line, name)``. Repeats stay: ``occurrences`` takes them as one."""
    parts = [df.select("file", "line", "name", F.lit(kind).alias("kind")).where("line IS NOT NULL") for kind, df in kinds.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def occurrences(wanted: DataFrame, lines: DataFrame) -> DataFrame:
    """``file, line, name, kind, start, end`` of the words in ``lines(path, line_no, text)``; a macro's definition once a line.

    Found words are stored, so lines are read and cut once, whatever follows.
    """
    # One row a line, so that each line is cut into words once. Kinds come from different tables, so sets made before
    # rows meet would hold one kind each, at the cost of a sort. Texts are never broadcast, whatever size Spark guesses.
    asked = wanted.repartition("file", "line").groupBy("file", "line").agg(F.collect_set(F.struct("name", "kind")).alias("asked"))
    at = asked.join(lines.hint("merge"), (F.col("file") == F.col("path")) & (F.col("line") == F.col("line_no")))
    found = stored(at.select("file", "line", "asked", "text").mapInArrow(_words, "file string, line int, name string, kind string, start int, end int"))
    first = found.where("kind = 'def_macro'").groupBy("file", "line", "name", "kind").agg(F.min_by(F.struct("start", "end"), "start").alias("t"))
    return found.where("kind <> 'def_macro'").unionByName(first.select("file", "line", "name", "kind", "t.start", "t.end"))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, rows = [], []
        for i, (asked, line) in enumerate(zip(batch.column("asked").to_pylist(), batch.column("text").to_pylist())):
            kinds: dict[str, list[str]] = {}
            for a in asked:
                kinds.setdefault(a["name"], []).append(a["kind"])
            for name, start, end in text.places(line, list(kinds)):
                for kind in kinds[name]:
                    at.append(i)
                    rows.append((name, kind, start, end))
        of = pa.array(at, pa.int32())
        name, kind, start, end = zip(*rows) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([batch.column("file").take(of), batch.column("line").cast(pa.int32()).take(of), pa.array(name, pa.string()), pa.array(kind, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=["file", "line", "name", "kind", "start", "end"])


def ref_to(occ: DataFrame, calls: DataFrame, defs: DataFrame, decls: DataFrame, expansions: DataFrame) -> DataFrame:
    """``file, kind, line, start, end, to_file, to_line``.

    ``calls(ctx_file, func, to_file)``, ``defs(file, func, line)``,
    ``decls(def_file, func, file, line)``,
    ``expansions(exp_file, name, exp_line, def_file, def_line)``.
    """
    called = occ.where("kind = 'call'").join(calls.select(F.col("ctx_file").alias("file"), F.col("func").alias("name"), F.col("to_file").alias("def_file")).distinct(), ["file", "name"])
    cols = ["file", "kind", "line", "start", "end", "to_file", "to_line"]
    to_def = called.drop("kind").join(defs.where("line IS NOT NULL").select(F.col("file").alias("def_file"), F.col("func").alias("name"), F.col("line").alias("to_line")), ["def_file", "name"]).withColumn("kind", F.lit("def_func")).withColumn("to_file", F.col("def_file")).select(cols)
    to_decl = called.drop("kind").join(decls.select("def_file", F.col("func").alias("name"), F.col("file").alias("to_file"), F.col("line").alias("to_line")), ["def_file", "name"]).withColumn("kind", F.lit("decl_func")).select(cols)
    macro = occ.where("kind = 'expand'").join(expansions.where("def_file <> 'unknown'").select(F.col("exp_file").alias("file"), "name", F.col("exp_line").alias("line"), F.col("def_file").alias("to_file"), F.col("def_line").alias("to_line")), ["file", "name", "line"]).withColumn("kind", F.lit("def_macro")).select(cols)
    return to_def.unionByName(to_decl).unionByName(macro).distinct()


def ref_from(occ: DataFrame, calls: DataFrame, expansions: DataFrame) -> DataFrame:
    """``file, kind, line, start, end, from_file, from_lines`` of definitions, declarations and macros.

    ``calls(file, func, ctx_file, line)``: ``file`` is where the name is defined
    or declared. A macro that nothing expands keeps an empty list.
    """
    by_file = calls.groupBy("file", F.col("func").alias("name"), F.col("ctx_file").alias("from_file")).agg(F.array_sort(F.collect_set("line")).alias("from_lines"))
    funcs = occ.where("kind IN ('def_func', 'decl_func')").join(by_file, ["file", "name"]).withColumn("kind", F.lit("call"))
    lines = expansions.groupBy(F.col("def_file").alias("file"), "name", F.col("def_line").alias("line"), F.col("exp_file").alias("from_file")).agg(F.array_sort(F.collect_set("exp_line")).alias("from_lines"))
    macros = occ.where("kind = 'def_macro'").join(lines, ["file", "name", "line"], "left").withColumn("kind", F.lit("expand")).withColumn("from_lines", F.coalesce("from_lines", F.array().cast("array<int>")))
    cols = ["file", "kind", "line", "start", "end", "from_file", "from_lines"]
    return funcs.select(cols).unionByName(macros.select(cols))
