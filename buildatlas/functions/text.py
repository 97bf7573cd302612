"""Scalar functions on fact lines and source text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

WORD = re.compile(r"\w+")


def ids(c: Column) -> Column:
    """``"1,2"`` as numbers."""
    return F.transform(F.split(c, ","), lambda x: x.cast("bigint"))


def storage(c: Column) -> Column:
    return F.when(c == "static", "static").otherwise("extern")


def reference(value: Column) -> Column:
    """The name that an initialiser string may refer to, else an empty string."""
    return F.regexp_extract(value, r"^\(?\s*&?\s*(\w+)\s*\)?$", 1)


def token_rows(df: DataFrame, line: str = "text") -> DataFrame:
    """``df`` without ``line``, and ``name, start, end`` of every word in it, in code points; one pass over Arrow batches."""
    kept = [c for c in df.columns if c != line]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, names, starts, ends = [], [], [], []
            for i, text in enumerate(batch.column(line).to_pylist()):
                for m in WORD.finditer(text or ""):
                    at.append(i)
                    names.append(m[0])
                    starts.append(m.start())
                    ends.append(m.end())
            rows = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in kept), pa.array(names, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=[*kept, "name", "start", "end"])

    return df.mapInArrow(cut, StructType([*(df.schema[c] for c in kept), *(StructField(n, t) for n, t in (("name", StringType()), ("start", IntegerType()), ("end", IntegerType())))]))


#: Lines whose words a worker holds at a time.
LINES = 256
#: Names up to which a line is searched for each; for more it is cut into all its words.
FEW = 4


def line_words(df: DataFrame, line: str = "text") -> DataFrame:
    """``df`` without ``line``, and ``words``: name, start and end of each of its words, as ``token_rows`` has them, in one row."""
    kept = [c for c in df.columns if c != line]
    word = pa.struct([("name", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, LINES):
                batch = whole.slice(begin, LINES)
                offsets, names, spans = [0], [], []
                for text in batch.column(line).to_pylist():
                    names += WORD.findall(text or "")
                    spans += [m.span() for m in WORD.finditer(text or "")]
                    offsets.append(len(names))
                starts, ends = zip(*spans) if spans else ((), ())
                words = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], fields=list(word))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words)], names=[*kept, "words"])

    fields = StructType([StructField("name", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())])
    return df.mapInArrow(cut, StructType([*(df.schema[c] for c in kept), StructField("words", ArrayType(fields))]))


def places(line: str, names: list[str]) -> Iterator[tuple[str, int, int]]:
    """``name, start, end`` of each place where one of the distinct ``names`` is a whole word of ``line``."""
    if len(names) > FEW:
        wanted = set(names)
        yield from ((m[0], m.start(), m.end()) for m in WORD.finditer(line) if m[0] in wanted)
        return
    for name in names:
        at = line.find(name) if WORD.fullmatch(name) else -1
        while at >= 0:
            end = at + len(name)
            if not WORD.match(line[at - 1 : at]) and not WORD.match(line[end : end + 1]):
                yield name, at, end
            at = line.find(name, end)


def loc(content: Column) -> Column:
    """Number of newline-ended records; a last line without newline counts."""
    newlines = F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit("")))
    return F.when(content.isNull() | (content == ""), 0).otherwise(newlines + F.when(content.endswith("\n"), 0).otherwise(1))


def call_args(c: Column) -> Column:
    """Function names handed to a call: ``array<struct<idx, name>>``."""
    pattern = F.lit(r"actual_arg_func_name(\d+)=\s*(\w+)\s*")
    return F.transform(F.arrays_zip(F.regexp_extract_all(c, pattern, F.lit(1)).alias("idx"), F.regexp_extract_all(c, pattern, F.lit(2)).alias("name")), lambda x: F.struct(x["idx"].alias("idx"), x["name"].alias("name")))


def macro_args(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), lambda x: F.regexp_extract(x, r"^ ?actual_arg\d+=(.*)$", 1)), lambda x: x != "")


def shell_words(c: Column) -> Column:
    """Words as a shell splits them: quotes and backslashes keep blanks together and go."""
    found = F.regexp_extract_all(c, F.lit(r"""((?:\\.|"(?:\\.|[^"\\])*"|'[^']*'|[^\s"'\\])+)"""), F.lit(1))
    # One alternative a step, from the left: an escaped character, a double-quoted part, a single-quoted one.
    part = r"""\\(.)|"((?:\\.|[^"\\])*)"|'([^']*)'"""
    return F.transform(found, lambda w: F.regexp_replace(w, part, "$1$2$3"))


def dependencies(rule: Column) -> Column:
    """Prerequisites of a make rule as a compiler writes it, the target left out."""
    words = F.filter(shell_words(F.regexp_replace(rule, r"\\\r?\n", " ")), lambda w: w != "")
    words = F.transform(words, lambda w: F.regexp_replace(w, ":$", ""))
    rest = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
    return F.array_distinct(F.filter(rest, lambda w: w != ""))


#: How Microsoft's compiler says, in two languages, that it reads a header.
INCLUDING = "(?:Note: including file:|Примечание: включение файла:)"


def shown_includes(output: Column) -> Column:
    """Headers that a compiler's output names."""
    return F.array_distinct(F.transform(F.regexp_extract_all(output, F.lit(rf"(?m)^.*?{INCLUDING}[ \t]*([^\r\n]*)"), F.lit(1)), F.trim))
