"""Positions of regular-expression matches, with SQL functions only.

Java's patterns give matched strings and, by ``split``, what lies between
them; their lengths summed give offsets in code points. Possessive loops and
look-behinds keep every pattern linear and free of recursion on long texts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:bigint,ord:int,end:bigint,kind:string,value:string>>"


def find(text: Column, kind: str, order: int, pattern: str, keep=None, value: int | None = None) -> Column:
    """Array of spans of ``kind``; ``value`` is a group to carry beside the match, ``keep`` a test of the carried string."""
    got = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    held = got if value is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(value))
    gaps = F.split(text, pattern, -1)
    zipped = F.arrays_zip(gaps.alias("g"), got.alias("m"), held.alias("v"))
    zipped = F.filter(zipped, lambda z: z["m"].isNotNull())
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(None).cast(SPAN).alias("out"))
    none = F.array().cast(SPAN)

    def step(acc: Column, z: Column) -> Column:
        begin = acc["at"] + F.length(z["g"])
        end = begin + F.length(z["m"])
        span = F.struct(begin.alias("start"), F.lit(order).alias("ord"), end.alias("end"), F.lit(kind).alias("kind"), z["v"].alias("value"))
        out = F.coalesce(acc["out"], none)
        return F.struct(end.alias("at"), (F.concat(out, F.array(span)) if keep is None else F.when(keep(z["v"]), F.concat(out, F.array(span))).otherwise(out)).alias("out"))

    folded = F.aggregate(zipped, start, step, lambda acc: F.coalesce(acc["out"], none))
    return F.when(text.rlike(pattern), folded).otherwise(none)


def joined(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def cut(text: Column, spans: Column, mark) -> Column:
    """``text`` with each span replaced by ``mark(span)``; of overlapping spans the earlier wins."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))
    folded = F.aggregate(
        F.array_sort(spans),
        start,
        lambda acc, s: F.when(
            s["start"] >= acc["at"],
            F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), mark(s))).alias("out")),
        ).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))),
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))),
    )
    return F.when(F.size(spans) > 0, folded).otherwise(text)
