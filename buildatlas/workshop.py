"""A small build, once for every supplier: what its log, facts and files say, and what follows from them.

``@`` stands for a build's directory and ``#`` for the number its ids begin
with, so command ``#07`` of build 12, supplier 11's, has the id 1207. Before a
letter, as in ``#define``, ``#`` stands for itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.durable import materialised
from .plans.project import Project
from .sources import logs

#: Number, parent's number, executable and arguments.
LOG = [
    (1, 0, "/usr/bin/make", "make"),
    (2, 1, "/usr/bin/gcc", "gcc bulb.c lamp.c -o tmp -D WATT -O3"),
    (3, 1, "/bin/mv", "mv -f tmp lamp"),
    (4, 1, "/usr/bin/gcc", "gcc bulb.c lamp.c -o /dev/null -fsyntax-only"),
    (5, 1, "/usr/bin/gcc", "gcc bulb.c -M -MF bulb.d"),
    (6, 2, "/usr/bin/clang", "clang -cc1 bulb.c"),
    (7, 1, "/usr/bin/x86_64-linux-gnu-gcc-12", "gcc -c bulb.c lamp.c"),
    (8, 1, "/usr/bin/gcc", "gcc bulb.o lamp.o -o lamp"),
    (9, 1, "/usr/bin/as", "as e.s -o bulb.o -I /usr/include"),
    (10, 1, "/usr/bin/ar", "ar rcs bulb.a bulb.o lamp.o"),
    (11, 1, "/usr/bin/objcopy", "objcopy lamp.o --strip-all"),
    (12, 1, "/usr/bin/objcopy", "objcopy -j .text bulb.o slim.o"),
    (13, 1, "/usr/bin/ld", "ld lamp.o -o lamp.o2 -g -l bulb -L sub/../lib"),
    (14, 1, "/bin/rm", "rm -f x"),
    (15, 1, "/usr/bin/g++", "g++ tool.cc -o tool -D WATT"),
    (16, 1, "/usr/bin/ccache", "ccache gcc more.c -I --ccache-skip /usr/include -c"),
    (17, 1, "/bin/ln", "ln -s lamp.c link.c"),
    (18, 1, "/usr/bin/install", "install -m 644 bulb.h inc/"),
    (19, 1, "/vc/cl.exe", "cl.exe /c win.c /Foout\\"),
    (20, 1, "/vc/link.exe", "link.exe /OUT:win.exe out/win.obj"),
    (21, 1, "/windows/cmd.exe", "cmd.exe /c copy /Y a.txt d/"),
    (22, 7, "/usr/lib/cc1", "cc1 lamp.c"),
    (23, 7, "/usr/bin/as", "as x.s -o y.o"),
]
#: Number, type, inputs, outputs, options and arguments of the commands that count.
CMDS = [
    (2, "CC", "@/bulb.c @/lamp.c", "@/tmp", "-D WATT -O3", "/usr/bin/gcc bulb.c lamp.c -o tmp -D WATT -O3"),
    (3, "MV", "@/tmp", "@/lamp", "-f", "/bin/mv -f tmp lamp"),
    (5, "CC", "@/bulb.c", "", "-M -MF bulb.d", "/usr/bin/gcc bulb.c -M -MF bulb.d"),
    (7, "CC", "@/bulb.c @/lamp.c", "@/bulb.o @/lamp.o", "-c", "/usr/bin/x86_64-linux-gnu-gcc-12 -c bulb.c lamp.c"),
    (8, "CC", "@/bulb.o @/lamp.o", "@/lamp", "", "/usr/bin/gcc bulb.o lamp.o -o lamp"),
    (9, "AS", "@/e.s", "@/bulb.o", "-I /usr/include", "/usr/bin/as e.s -o bulb.o -I /usr/include"),
    (10, "AR", "@/bulb.o @/lamp.o", "@/bulb.a", "rcs", "/usr/bin/ar rcs bulb.a bulb.o lamp.o"),
    (11, "Objcopy", "@/lamp.o", "@/lamp.o", "--strip-all", "/usr/bin/objcopy lamp.o --strip-all"),
    (12, "Objcopy", "@/bulb.o", "@/slim.o", "-j .text", "/usr/bin/objcopy -j .text bulb.o slim.o"),
    (13, "LD", "@/lamp.o", "@/lamp.o2", "-g -l bulb -L sub/../lib", "/usr/bin/ld lamp.o -o lamp.o2 -g -l bulb -L sub/../lib"),
    (15, "CXX", "@/tool.cc", "@/tool", "-D WATT", "/usr/bin/g++ tool.cc -o tool -D WATT"),
    (16, "CC", "@/more.c", "@/more.o", "-I /usr/include -c", "gcc more.c -I /usr/include -c"),
    (17, "LN", "@/lamp.c", "@/link.c", "-s", "/bin/ln -s lamp.c link.c"),
    (18, "Install", "@/bulb.h", "@/inc/bulb.h", "-m 644", "/usr/bin/install -m 644 bulb.h inc/"),
    (19, "CL", "@/win.c", "@/out/win.obj", "/c", "/vc/cl.exe /c win.c /Foout\\"),
    (20, "Link", "@/out/win.obj", "@/win.exe", "", "/vc/link.exe /OUT:win.exe out/win.obj"),
    (21, "Copy", "@/a.txt", "@/d/a.txt", "", "/windows/cmd.exe /c copy /Y a.txt d/"),
]
BAD = [4, 6, 22]
#: Writer and reader.
EDGES = [(2, 3), (7, 8), (7, 10), (9, 10), (7, 11), (9, 12), (11, 13), (19, 20)]
SOURCES = {
    "@/bulb.h": ["int light(int watts);", "int dark(void);", "// #"],
    "@/bulb.c": [
        '#include "bulb.h"', "#define HALF(x) ((x) / 2)", "#define DIM HALF(40)", "", "int light(int watts)", "{", "    return watts > DIM ? note(watts) : note(DIM);", "}", "",
        "static int note(int n) { return n; }", "int (*hook[1])(int) = { &light };", "int both(int n) { int (*p)(int) = light; return p(n) + light(n); }", "// #",
    ],
    "@/lamp.c": ['#include "bulb.h"', "static int note(int n)", '{ printf("%d", n); return n; }', "int main(void)", "{", "    note(3);", "    return light(60);", "}", "// #"],
    "@/lib/libbulb.a": ["archive #"],
}
DEEP = 70
FACTS = {
    "execution": ['"@/lamp.c" #02,#07 note 2 static int note(int);', '"@/lamp.c" #02,#07 main 4 global int main(void);', '"@/bulb.c" #02,#07 light 5 global int light(int);', '"@/bulb.c" #02,#07 note 10 static int note(int);', '"@/bulb.c" #02,#07 both 12 global int both(int);'],
    "declare_func": ['"@/bulb.h" #02,#07 light 1 global int light(int);', '"@/bulb.h" #02 dark 2 global int dark(void);'],
    "exported": ['"@/bulb.c" both'],
    "call": ['"@/lamp.c" #02 main note 6 static ', '"@/lamp.c" #02 main light 7 global ', '"@/lamp.c" #02 note printf 3 global  actual_arg_func_name1= shown x', '"@/bulb.c" #02 light note 7 static ', '"@/bulb.c" #02 both light 12 global ', '"@/bulb.c" #02 both __builtin_expect 12 global '],
    "callp": ['"@/bulb.c" both p 12'],
    "use_func": ['"@/bulb.c" #02 both light 12 global', '"@/bulb.c" #02 NULL light 11 global', '"@/bulb.c" #02 both __compiletime_assert 12 global'],
    "use_var": ['"@/bulb.c" both n 12'],
    "define": ['"@/bulb.c" HALF 2', '"@/bulb.c" DIM 3', '"@/bulb.c" DIM 3'],
    "expand": ['"@/bulb.c" "@/bulb.c" DIM 7 3', '"@/bulb.c" "@/bulb.c" HALF 7 2', '"@/lamp.c" "/usr/include/std.h" NULL 3 9'],
    "expand_args": ['"@/bulb.c" HALF actual_arg0=40', '"@/bulb.c" DIM '],
    "typedefs": ['"@/bulb.c" typedef unsigned short lumen;', '"@/bulb.c" typedef unsigned short lumen;'],
    "init_global": ['"@/bulb.c" "int (*hook[1])(int);" #02 global [{"index": 0, "value": " & light"}]', '"@/bulb.c" "static int deep;" #02 static ' + '[{"value": ' * DEEP + '"(& both)"' + "}]" * DEEP],
}


#: Builds a task makes; their table is so small that Spark would read very many in one.
BUILDS = 2000


def each(spark: SparkSession, d: str, templates: list[tuple], schema: str) -> DataFrame:
    """The rows of ``templates`` for every supplier, ``s`` beside them, strings filled in."""
    suppliers = spark.read.parquet(f"{d}/supplier.parquet").select((F.col("s_suppkey") + 1).alias("s"))
    # With a number of its own a shuffle isn't coalesced, however few bytes it has.
    suppliers = suppliers.repartition(max(1, -(-suppliers.count() // BUILDS)), "s")
    names = [c.split()[0] for c in schema.split(", ")]
    rows = F.array([F.struct(*[F.lit(v).cast(c.split()[1]).alias(c.split()[0]) for v, c in zip(t, schema.split(", "))]) for t in templates])
    out = suppliers.select("s", F.inline(rows))
    fill = lambda c: F.regexp_replace(F.replace(F.col(c), F.lit("@"), F.concat(F.lit("/b"), F.col("s").cast("string"))), F.lit("#(?![a-z])"), F.col("s").cast("string"))
    return out.select("s", *[(fill(n) if c.split()[1] == "string" else F.col(n)).alias(n) for n, c in zip(names, schema.split(", "))])


def log(spark: SparkSession, d: str) -> DataFrame:
    """``id, line`` as a log has them."""
    rows = each(spark, d, [(k, p, f"@||{{}}||{which}||" + "||".join(argv.split())) for k, p, which, argv in LOG], "k int, p int, line string")
    number = lambda k: F.when(F.col(k) == 0, F.lit(0)).otherwise(F.col("s") * 100 + F.col(k))
    return rows.select(number("k").cast("bigint").alias("id"), F.replace("line", F.lit("{}"), number("p").cast("string")).alias("line"))


def lines(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return each(spark, d, [(x,) for x in FACTS[kind]], "line string").select("line")


def files(spark: SparkSession, d: str) -> DataFrame:
    """The sources; ``link.c`` is a copy of ``lamp.c`` that isn't stored."""
    texts = [(p, "\n".join(t) + "\n", True) for p, t in SOURCES.items()] + [("@/link.c", "\n".join(SOURCES["@/lamp.c"]) + "\n", False)]
    return each(spark, d, texts, "path string, content string, in_storage boolean").select("path", F.md5(F.col("content").cast("binary")).alias("md5"), "in_storage", "content")


_projects: dict[tuple[str, str], Project] = {}


def built(spark: SparkSession, d: str) -> Project:
    """The project of all builds; relations that one query has built serve the next."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _projects:
        _projects[key] = Project(spark, materialised(logs.parse_commands(log(spark, d))), {k: lines(spark, d, k) for k in FACTS}, files(spark, d))
    return _projects[key]


def golden(columns: str, rows: list[tuple]) -> str:
    """SQL of ``rows`` for every supplier; ``columns`` are names with ``id``, ``int``, ``bigint``, ``boolean`` or ``string``."""
    kinds = [c.split() for c in columns.split(", ")]
    quoted = lambda v: "NULL" if v is None else str(v) if not isinstance(v, str) else "'" + v.replace("'", "''") + "'"
    values = ", ".join("(" + ", ".join(quoted(v) for v in r) + ")" for r in rows)
    as_sql = {"id": "CAST(s * 100 + {0} AS BIGINT)", "int": "CAST({0} AS INTEGER)", "bigint": "CAST({0} AS BIGINT)", "boolean": "CAST({0} AS BOOLEAN)", "string": "replace(replace(CAST({0} AS VARCHAR), '@', '/b' || s), '#', CAST(s AS VARCHAR))"}
    picked = ", ".join(as_sql[k].format(f"v{i}") + f' AS "{n}"' for i, (n, k) in enumerate(kinds))
    return f"SELECT {picked} FROM (SELECT s_suppkey + 1 AS s FROM supplier) AS x, (VALUES {values}) AS t({', '.join(f'v{i}' for i in range(len(kinds)))})"
