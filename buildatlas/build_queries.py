"""Registered queries over the small builds of ``workshop``, through ``Project``; the SQL lists what must follow.

Further queries of single operators, whose inputs the driver's tables don't
have, follow at the end.
"""

from __future__ import annotations

import io
import json
import zipfile

import pyarrow as pa
from pyspark.sql import functions as F

from . import fixtures as fx
from . import workshop as ws
from .functions import argv, paths, text
from .operators import commands, diff, graph
from .plans.durable import checkpoint, folder
from .plans.presets import settings
from .plans.project import Project, folder_ok, read_meta
from .queries import CMD, FOREST, PARSED, every, line, query
from .sources import facts, logs
from .workshop import built, golden


def lists(df, *columns):
    for c in columns:
        df = df.withColumn(c, line(c))
    return df


# -- commands --------------------------------------------------------------------------------

WITHOUT_COMMAND = "id id, type string, in string, out string, opts string"


@query(golden(WITHOUT_COMMAND + ", command string", ws.CMDS))
def build_cmds(spark, d):
    """All twelve kinds parsed, bad ones and descendants of others left out."""
    return lists(built(spark, d).get("cmds").select("id", "type", "in", "out", "opts", "command"), "in", "out", "opts", "command")


@query(golden("id id, bad boolean", [(k, k in ws.BAD) for k in sorted([c[0] for c in ws.CMDS] + ws.BAD + [23])]))
def build_bad_cmds(spark, d):
    return built(spark, d).get("all_cmds").select("id", "bad")


@query(golden("id id, cwd string, pid bigint, which string, command string", [(k, "@", None, w, " ".join(a.split())) for k, _, w, a in ws.LOG]).replace("CAST(v2 AS BIGINT)", "CASE v0 " + " ".join(f"WHEN {k} THEN {0 if not p else f's * 100 + {p}'}" for k, p, _, _ in ws.LOG) + " END"))
def build_raw_cmds(spark, d):
    raw = built(spark, d).raw
    return lists(raw.select("id", "cwd", raw["pid"].cast("bigint").alias("pid"), "which", "command"), "command")


@query(golden("id id, in string", [(2, "@/bulb.c @/lamp.c"), (7, "@/bulb.c @/lamp.c"), (15, "@/tool.cc"), (16, "@/more.c"), (19, "@/win.c")]))
def build_compilations(spark, d):
    """Of the compilers' commands those that compile: not the preprocessor's, not linking alone."""
    return lists(commands.compilations(built(spark, d).get("cmds")).select("id", "in"), "in")


@query(golden("id id", [(k,) for k in (2, 3, 5, 7, 8, 10, 11, 12, 13, 15, 16, 17, 18, 19, 20, 21)]))
def build_analysable(spark, d):
    return commands.analysable(built(spark, d).get("cmds")).select("id")


@query(golden(WITHOUT_COMMAND, [c[:5] for c in ws.CMDS if c[1] == "Objcopy"]))
def cmds_by_type(spark, d):
    return lists(built(spark, d).cmds_by_type("Objcopy", with_opts=True).drop("cwd"), "in", "out", "opts")


@query(golden("src id, dst id", ws.EDGES))
def build_cmd_edges(spark, d):
    return built(spark, d).get("cmd_edges")


@query(golden("src id, dst id, paths bigint", [(*e, 1) for e in [*ws.EDGES, (7, 13)]]))
def root_cmds(spark, d):
    """All commands that lead to another, with the number of ways."""
    return built(spark, d).get("cmd_paths")


@query(golden("id id, leaf id, type string", [(2, 3, "MV"), (7, 8, "CC"), (7, 10, "AR"), (7, 11, "Objcopy"), (7, 13, "LD"), (9, 10, "AR"), (9, 12, "Objcopy"), (11, 13, "LD"), (19, 20, "Link")]))
def leaf_cmds_by_type(spark, d):
    p = built(spark, d)
    kinds = p.get("cmds").select(F.col("id").alias("leaf"), "type")
    return p.get("cmd_paths").select(F.col("src").alias("id"), F.col("dst").alias("leaf")).join(kinds, "leaf").select("id", "leaf", "type")


@query(golden("id id, path string, is_out boolean", [(13, "@/lamp.o", False), (13, "@/lib/libbulb.a", False), (13, "@/lamp.o2", True), (17, "@/lamp.c", False), (17, "@/lamp.c", True), (18, "@/bulb.h", False), (18, "@/inc/bulb.h", True)]))
def build_cmd_io(spark, d):
    """A library found by option, and a link's place, whose content is stored under another path."""
    return built(spark, d).get("cmd_io").where("id % 100 IN (13, 17, 18)")


USED = {2: "#03", 7: "#08 #10 #11 #13", 15: "", 16: "", 19: "#20"}
COMPILED = [(2, "@/bulb.c"), (2, "@/lamp.c"), (7, "@/bulb.c"), (7, "@/lamp.c"), (15, "@/tool.cc"), (16, "@/more.c"), (19, "@/win.c")]


@query(golden("file string, cmd_id id, used_by string", [(f, k, USED[k]) for k, f in COMPILED]))
def build_src_graph(spark, d):
    return lists(built(spark, d).get("src_graph"), "used_by")


@query(golden("file string, loc int", [("@/bulb.c", 13), ("@/lamp.c", 9), ("@/tool.cc", 0), ("@/more.c", 0), ("@/win.c", 0)]))
def build_src_info(spark, d):
    return built(spark, d).get("src_info").select("file", F.col("loc").cast("int").alias("loc"))


@query(golden("file string, id id", [("@/lamp.c", 2), ("@/lamp.c", 7)]))
def compilations_by_file(spark, d):
    """Commands that compile a file, for the file of every build."""
    p = built(spark, d)
    files = [r.path for r in ws.each(spark, d, [("@/lamp.c",)], "path string").select("path").collect()]
    return p.compilations_of(files).select(F.explode("in").alias("file"), "id").where("file LIKE '%/lamp.c'")


@query(golden("id id, path string", [(k, f) for k, f in COMPILED if k in (2, 7, 16)] + [(5, "@/bulb.c"), (8, "@/bulb.o"), (8, "@/lamp.o")]))
def cmd_deps(spark, d):
    return built(spark, d).cmd_deps("CC")


ENTRIES = [(2, "@/bulb.c", "@/tmp"), (2, "@/lamp.c", "@/tmp"), (7, "@/bulb.c", "@/bulb.o"), (7, "@/lamp.c", "@/lamp.o")]
ARGV = {k: c for k, *_, c in ws.CMDS}


@query(golden("id id, directory string, arguments string, file string, output string", [(k, "@", ARGV[k], f, o) for k, f, o in ENTRIES]))
def build_cdb(spark, d):
    """Only inputs that are among the known files have entries."""
    return lists(built(spark, d).get("cdb").select("id", "directory", "arguments", "file", "output"), "arguments")


@query(golden("id id, line string", [(k, json.dumps({"directory": "@", "arguments": ARGV[k].split(), "file": f, "output": o}, separators=(",", ":"))) for k, f, o in ENTRIES]))
def cdb_json(spark, d):
    """Entries as JSON lines, written and read again."""
    at = folder(spark, "cdb")
    rows = commands.database_json(built(spark, d).get("cdb"))
    rows.select("line").write.text(at)
    back = spark.read.text(at).select(F.col("value").alias("line"))
    return back.join(rows, "line").select("id", "line")


FILE_EDGES = [(s, o, t) for _, t, i, outs, opts, _ in ws.CMDS for s, o in (zip(i.split(), outs.split()) if "-c" in opts.split() else [(a, b) for a in i.split() for b in outs.split()])]


@query(golden("src string, dst string, type string", [e for e in FILE_EDGES if e[2] != "MV" and not e[0].endswith(".txt")]))
def file_graph_filtered(spark, d):
    return commands.file_graph(built(spark, d).get("cmds"), include="^/b", exclude=r"\.txt$", without=("MV",))


def dotted(edges, name=lambda x: x):
    nodes = sorted({x for e in edges for x in e[:2]})
    return [("node", n, None) for n in nodes] + [("edge", a, b) for a, b, *_ in edges]


@query("SELECT DISTINCT CASE WHEN kind = 'node' THEN '\"' || md5(a) || '\" [label=\"' || a || '\"]' ELSE '\"' || md5(a) || '\" -> \"' || md5(b) || '\"' END AS line FROM (" + golden("kind string, a string, b string", dotted(FILE_EDGES)) + ")")
def file_graph_dot(spark, d):
    """The file graph's DOT lines, written and read again."""
    at = folder(spark, "dot")
    graph.dot(commands.file_graph(built(spark, d).get("cmds"))).write.text(at)
    return spark.read.text(at).select(F.col("value").alias("line"))


@query(golden("id id, pid id", [(k, p) for k, p, *_ in ws.LOG if p]))
def pid_parents(spark, d):
    return built(spark, d).get("pid_parents")


# -- sources ---------------------------------------------------------------------------------

BOTH = "#02 #07"


@query(golden("func string, file string, line int, type string, signature string, compiled_in string, declared_in string", [
    ("note", "@/lamp.c", 2, "static", "int note(int);", BOTH, ""), ("main", "@/lamp.c", 4, "extern", "int main(void);", BOTH, ""), ("light", "@/bulb.c", 5, "extern", "int light(int);", BOTH, BOTH),
    ("note", "@/bulb.c", 10, "static", "int note(int);", BOTH, ""), ("both", "@/bulb.c", 12, "exported", "int both(int);", BOTH, ""), ("dark", "unknown", None, "extern", None, "", "#02")]))
def build_functions(spark, d):
    """Definitions with their units and types; what is only declared belongs to ``unknown``, once a build."""
    f = built(spark, d).get("functions").where("file <> 'unknown'")
    lone = built(spark, d).get("declarations").where("def_file = 'unknown'").select("func", F.col("def_file").alias("file"), F.lit(None).cast("int").alias("line"), "type", F.lit(None).cast("string").alias("signature"), F.array().cast("array<bigint>").alias("compiled_in"), F.col("cmds").alias("declared_in"))
    both = f.select(lone.columns).unionByName(lone)
    return lists(both.withColumns({c: F.array_sort(c) for c in ("compiled_in", "declared_in")}), "compiled_in", "declared_in")


@query(golden("func string, def_file string, file string, line int, signature string, type string", [("light", "@/bulb.c", "@/bulb.h", 1, "int light(int);", "extern"), ("dark", "unknown", "@/bulb.h", 2, "int dark(void);", "extern")]))
def build_declarations(spark, d):
    return built(spark, d).get("declarations").select("func", "def_file", "file", "line", "signature", "type")


CALLS = [("@/lamp.c", "main", "@/lamp.c", "note", 6, 5), ("@/lamp.c", "main", "@/bulb.c", "light", 7, 4), ("@/lamp.c", "note", "unknown", "printf", 3, 0), ("@/bulb.c", "light", "@/bulb.c", "note", 7, 5), ("@/bulb.c", "both", "@/bulb.c", "light", 12, 5)]
EDGE = "from_file string, from_func string, to_file string, to_func string, line int, match int"


@query(golden(EDGE + ", args string", [(*c, "1:shown" if c[3] == "printf" else "") for c in CALLS]))
def build_calls(spark, d):
    got = built(spark, d).get("call_edges")
    return got.withColumn("args", F.concat_ws(" ", F.transform("args", lambda a: F.concat_ws(":", a["idx"], a["name"]))))


@query(golden("file string, func string, side string, other_file string, other_func string, lines string, match int",
    [(a, f, "calls", b, g, str(n), m) for a, f, b, g, n, m in CALLS] + [(b, g, "called_in", a, f, str(n), m) for a, f, b, g, n, m in CALLS if b != "unknown"]))
def callgraph(spark, d):
    """Adjacency both ways; callers of names of unknown place, which all builds share, are left to ``build_calls``."""
    return lists(built(spark, d).get("callgraph").where("file <> 'unknown'"), "lines").select("file", "func", "side", "other_file", "other_func", "lines", "match")


@query(golden(EDGE, [c for c in CALLS if c[0] == "@/bulb.c" and c[2] == "@/bulb.c"]))
def calls_in(spark, d):
    """Calls from and to functions of the files asked for."""
    files = [r.path for r in ws.each(spark, d, [("@/bulb.c",)], "path string").select("path").collect()]
    return built(spark, d).calls_in(files, add_unknown=False).drop("args")


@query(golden("file string, func string, type string", [("@/lamp.c", "main", "extern"), ("@/lamp.c", "note", "static"), ("@/bulb.c", "light", "extern"), ("@/bulb.c", "note", "static"), ("@/bulb.c", "both", "exported")]))
def build_call_nodes(spark, d):
    return built(spark, d).get("call_nodes")


@query(golden("def_file string, func string, scope string, ctx_file string, ctx_func string, line int, match int", [("@/bulb.c", "light", "func", "@/bulb.c", "both", 12, 3), ("@/bulb.c", "light", "file", "@/bulb.c", None, 11, 3)]))
def build_used_in(spark, d):
    return built(spark, d).get("used_in")


@query(golden("path string, declaration string, type string", [("@/bulb.c", "int (*hook[1])(int)", "extern"), ("@/bulb.c", "static int deep", "static")]))
def build_variables(spark, d):
    return built(spark, d).get("variables").select("path", "declaration", "type")


@query(golden("func string, def_file string, ctx_file string", [("light", "@/bulb.c", "@/bulb.c"), ("both", "@/bulb.c", "@/bulb.c")]))
def build_used_in_vars(spark, d):
    """One of the names lies seventy levels deep."""
    return built(spark, d).get("used_in_vars")


@query(golden("file string, name string, line int", [("@/bulb.c", "HALF", 2), ("@/bulb.c", "DIM", 3)]))
def build_macro_defs(spark, d):
    return built(spark, d).macros(names=["HALF", "DIM"])


@query(golden("def_file string, name string, exp_file string, exp_line int, def_line int", [("@/bulb.c", "DIM", "@/bulb.c", 7, 3), ("@/bulb.c", "HALF", "@/bulb.c", 7, 2), ("unknown", "NULL", "@/lamp.c", 3, 9)]))
def macro_unknown(spark, d):
    """Expansions; the file of a macro that is defined nowhere is unknown."""
    return built(spark, d).expansions().select("def_file", "name", "exp_file", "exp_line", "def_line")


@query(golden("exp_file string, def_file string, name string, lines string", [("@/bulb.c", "@/bulb.c", "DIM", "7:3"), ("@/bulb.c", "@/bulb.c", "HALF", "7:2"), ("@/lamp.c", "unknown", "NULL", "3:9")]))
def macro_uses(spark, d):
    got = built(spark, d).get("macro_uses")
    return got.withColumn("lines", F.concat_ws(" ", F.transform("lines", lambda x: F.concat_ws(":", x["exp_line"].cast("string"), x["def_line"].cast("string")))))


@query(golden("exp_file string, name string, args string", [("@/bulb.c", "HALF", "40"), ("@/bulb.c", "DIM", "")]))
def build_macro_args(spark, d):
    """Lists of arguments; a macro without any keeps its row."""
    got = built(spark, d).get("macro_args")
    return got.withColumn("args", F.concat_ws("; ", F.transform("args", lambda a: F.concat_ws(",", a))))


@query(golden("file string, declaration string", [("@/bulb.c", "unsigned short lumen;")]))
def build_typedefs(spark, d):
    return built(spark, d).get("typedefs")


@query(golden("file string, func string, ptr string, lines string", [("@/bulb.c", "both", "p", "12")]))
def build_calls_by_ptr(spark, d):
    return lists(built(spark, d).get("calls_by_ptr"), "lines")


@query(golden("ctx_file string, ctx_func string, var string, line string", [("@/bulb.c", "both", "n", "12")]))
def fact_parse_use_var(spark, d):
    return facts.parse(ws.lines(spark, d, "use_var"), "use_var").withColumn("line", F.col("line").cast("string"))


REF_TO = [
    ("@/lamp.c", "def_func", 6, 4, 8, "@/lamp.c", 2), ("@/lamp.c", "def_func", 7, 11, 16, "@/bulb.c", 5), ("@/lamp.c", "decl_func", 7, 11, 16, "@/bulb.h", 1),
    ("@/bulb.c", "def_func", 7, 25, 29, "@/bulb.c", 10), ("@/bulb.c", "def_func", 7, 39, 43, "@/bulb.c", 10),
    ("@/bulb.c", "def_func", 12, 34, 39, "@/bulb.c", 5), ("@/bulb.c", "def_func", 12, 55, 60, "@/bulb.c", 5), ("@/bulb.c", "decl_func", 12, 34, 39, "@/bulb.h", 1), ("@/bulb.c", "decl_func", 12, 55, 60, "@/bulb.h", 1),
    ("@/bulb.c", "def_macro", 7, 19, 22, "@/bulb.c", 3), ("@/bulb.c", "def_macro", 7, 44, 47, "@/bulb.c", 3),
]
REF_FROM = [
    ("@/lamp.c", "call", 2, 11, 15, "@/lamp.c", "6"), ("@/bulb.c", "call", 5, 4, 9, "@/lamp.c", "7"), ("@/bulb.c", "call", 5, 4, 9, "@/bulb.c", "12"), ("@/bulb.c", "call", 10, 11, 15, "@/bulb.c", "7"),
    ("@/bulb.h", "call", 1, 4, 9, "@/lamp.c", "7"), ("@/bulb.h", "call", 1, 4, 9, "@/bulb.c", "12"), ("@/bulb.c", "expand", 2, 8, 12, "@/bulb.c", "7"), ("@/bulb.c", "expand", 3, 8, 11, "@/bulb.c", "7"),
]


@query(golden("file string, kind string, line int, start int, end int, to_file string, to_line int", REF_TO))
def build_ref_to(spark, d):
    return built(spark, d).get("ref_to")


@query(golden("file string, kind string, line int, start int, end int, from_file string, from_lines string", REF_FROM))
def build_ref_from(spark, d):
    return lists(built(spark, d).get("ref_from"), "from_lines")


@query(golden("src string, dst string", [("@/lamp.c:main", "@/lamp.c:note"), ("@/lamp.c:note", "unknown:printf")]))
def build_trace(spark, d):
    return built(spark, d).trace(["main"], ["printf"])


@query(golden("src string, dst string", [("@/lamp.c:main", "@/bulb.c:light")]))
def trace_without_from(spark, d):
    """Ways from main to note, without what light reaches and without the ways to lamp.c's own note."""
    p = built(spark, d)
    return p.trace(["main"], ["note"], without_from=["light"]).where("dst NOT LIKE '%lamp.c:note'")


@query(golden("src string, dst string", [("@/lamp.c:main", "@/lamp.c:note")]))
def trace_without_to(spark, d):
    """Ways from main to note and light, without those that lead to light."""
    return built(spark, d).trace(["main"], ["note", "light"], without_to=["light"])


@query(golden("func string, file string", [("note", "@/lamp.c"), ("note", "@/bulb.c"), ("both", "@/bulb.c")]))
def functions_like(spark, d):
    return built(spark, d).functions_like("^(NO|bo)").select("func", "file")


# -- storing, metadata, differences ----------------------------------------------------------


@query(golden(WITHOUT_COMMAND, [c[:5] for c in ws.CMDS if c[1] in ("LN", "CL")]))
def keyed_load(spark, d):
    """Commands saved in a folder for each type, and two types read again."""
    at = folder(spark, "saved")
    built(spark, d).save(at, "cmds", by="type")
    return lists(Project.load(spark, at, "cmds", type=["LN", "CL"]).select("id", "type", "in", "out", "opts"), "in", "out", "opts")


@query("SELECT * FROM (VALUES ('ok', 'true'), ('preset', 'base'), ('relation cmd_edges', ''), ('without meta', 'false')) AS t(key, value)")
def project_meta(spark, d):
    at = folder(spark, "saved")
    built(spark, d).save(at, "cmd_edges")
    meta = read_meta(spark, at)
    rows = [("ok", str(folder_ok(spark, at)).lower()), ("without meta", str(folder_ok(spark, at + "-none")).lower())] + [(k, meta[k]) for k in ("preset", "relation cmd_edges")]
    return spark.createDataFrame(rows, "key string, value string")


@query(golden("relation string, key string, status string, changed string", [
    ("cmds", "#02 CC", "changed", "opts"), ("cmds", "#17 LN", "removed", ""), ("cmds", "#24 CC", "added", ""), ("macro_defs", "@/bulb.c HALF", "changed", "line"), ("pid_parents", "#17", "removed", ""), ("pid_parents", "#24", "added", ""),
    ("src_graph", "@/new.c #24", "added", "")]))
def project_differences(spark, d):
    """Every build again with an option changed, a link gone, a file compiled anew and a macro moved."""
    one = built(spark, d)
    raw = one.raw.where("id % 100 <> 17").withColumn("command", F.when(F.col("id") % 100 == 2, F.transform("command", lambda t: F.when(t == "-O3", F.lit("-O2")).otherwise(t))).otherwise(F.col("command")))
    more = logs.parse_commands(ws.each(spark, d, [("@||#01||/usr/bin/gcc||gcc||-c||new.c",)], "line string").select((F.col("s") * 100 + 24).alias("id"), "line"))
    moved = dict(one.fact_lines) | {"define": one.fact_lines["define"].withColumn("line", F.regexp_replace("line", "HALF 2$", "HALF 9"))}
    two = Project(spark, raw.unionByName(more), moved, one.files)
    return one.differences(two)


@query(golden("kind string, line string", [("call", ws.FACTS["call"][0]), ("expand", ws.FACTS["expand"][0]), ("define", '"@/bulb.c" HALF 2'), ("define", '"@/bulb.c" DIM 3')]))
def fact_archives(spark, d):
    """Facts in zip files, a member for each kind and source."""
    names = ws.each(spark, d, [("@",)], "dir string").select("dir", F.col("s").cast("string").alias("s"))

    def packed(batches):
        for batch in batches:
            out = []
            for at, s in zip(batch.column("dir").to_pylist(), batch.column("s").to_pylist()):
                data = io.BytesIO()
                with zipfile.ZipFile(data, "w") as z:
                    z.writestr(f"{at[1:]}/lamp.c/call.txt", f"{s}02 main note 6 static \n")
                    z.writestr(f"{at[1:]}/bulb.c/EXPANDED{at}/bulb.c/expand.txt", "DIM 7 3\n")
                    z.writestr(f"{at[1:]}/bulb.c/define.txt", "HALF 2\nDIM 3\n")
                    z.writestr(f"{at[1:]}/readme", "no facts")
                out.append(data.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["content"])

    return facts.archive_lines(names.mapInArrow(packed, "content binary"))


# -- logs ------------------------------------------------------------------------------------


@query(f"WITH {CMD} SELECT id, cwd, pid, which, command FROM arg")
def log_read(spark, d):
    """A log written as part files and read from its folder, ids from the lines' order."""
    at = folder(spark, "log")
    logs.write_commands(fx.raw(spark, d), at)
    return lists(logs.read_commands(spark, at), "command").select("id", "cwd", "pid", "which", "command")


@query(f"WITH {CMD} SELECT arg_min(cwd, id) AS build_dir FROM arg")
def build_dir(spark, d):
    return commands.ends(fx.raw(spark, d)).select(paths.normpath(F.col("build_dir")).alias("build_dir"))


@query("SELECT event_id % 500 AS id, 'VAR_' || (user_id % 13) AS name, arg_max(event_id || '=' || event_type, event_id) AS value FROM events WHERE event_id % 500 = 7 AND user_id % 13 = (SELECT user_id % 13 FROM events WHERE event_id = 7) GROUP BY 1, 2")
def env_value(spark, d):
    from .queries import envs

    name = "VAR_" + str(fx.table(spark, d, "events").where("event_id = 7").selectExpr("user_id % 13 AS v").first().v)
    return Project(spark, fx.raw(spark, d), envs=envs(spark, d)).env(7, name)


@query("SELECT CAST(min(event_id % 500) AS BIGINT) AS first_id, CAST(max(event_id % 500) AS BIGINT) AS last_id FROM events")
def env_first_last(spark, d):
    from .queries import envs

    return logs.env_ends(envs(spark, d))


@query(f"WITH {CMD}, c AS (SELECT which, count(*) AS n FROM arg GROUP BY which) SELECT which, n, CAST(row_number() OVER (ORDER BY n, which) AS INT) AS place FROM c")
def cmd_stats_sorted(spark, d):
    """Numbers of commands by executable, rising; the order is over executables, not commands."""
    from pyspark.sql import Window as W

    return commands.stats(fx.raw(spark, d)).withColumn("place", F.row_number().over(W.orderBy("n", "which")))


@query("SELECT count(*) AS n FROM events WHERE event_type = 'error'")
def failures_counted(spark, d):
    return logs.count_with(fx.table(spark, d, "events").select(F.concat_ws(" ", F.lit("tool said"), "event_type").alias("line")), "error")


# -- parsers ---------------------------------------------------------------------------------


def of_type(kind: str) -> str:
    return f"WITH {PARSED} SELECT id, \"in\", out, opts FROM parsed WHERE type = '{kind}'"


@query(of_type("AR"))
def parse_ar(spark, d):
    return lists(every(spark, d).where("type = 'AR'").select("id", "in", "out", "opts"), "in", "out", "opts")


@query(of_type("MV"))
def parse_mv(spark, d):
    return lists(every(spark, d).where("type = 'MV'").select("id", "in", "out", "opts"), "in", "out", "opts")


@query(of_type("Objcopy"))
def parse_objcopy(spark, d):
    return lists(every(spark, d).where("type = 'Objcopy'").select("id", "in", "out", "opts"), "in", "out", "opts")


@query("""SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN '/w/f' || k || '.o /w/g.o' WHEN 1 THEN 'x/f' || k || '.o' WHEN 2 THEN '' ELSE '/w/f' || k || '.o' END AS out FROM (SELECT event_id, event_id % 97 AS k FROM events)""")
def parse_cc_outputs(spark, d):
    """Implied outputs of one and two inputs, a named one, and none where nothing is compiled alone."""
    e = fx.table(spark, d, "events").selectExpr("event_id AS id", "concat('f', event_id % 97) AS f", "event_id % 4 AS k")
    command = F.expr("CASE k WHEN 0 THEN array('cc', '-c', concat(f, '.c'), 'g.c') WHEN 1 THEN array('cc', '-o', concat('x/', f, '.o'), '-c', concat(f, '.c')) WHEN 2 THEN array('cc', concat(f, '.c')) ELSE array('cc', concat('sub/', f, '.cc'), '-c', '-I', '-o') END")
    return e.select("id", line_of(commands.shape("CC", command, F.lit("/w"))["out"]).alias("out"))


def line_of(c):
    return F.concat_ws(" ", c)


@query("""SELECT event_id AS id, 'f' || k || '.c' AS "in", CASE WHEN k % 2 = 0 THEN '-o2' ELSE 'out' || k END AS out, '-I -o -D X' || k || ' -Wall -MF d' || k AS opts FROM (SELECT event_id, event_id % 97 AS k FROM events)""")
def argv_fold(spark, d):
    """An option's value may look like an option itself."""
    e = fx.table(spark, d, "events").selectExpr("event_id AS id", "event_id % 97 AS k")
    command = F.expr("array('cc', '-I', '-o', '-D', concat('X', k), '-Wall', '-o', CASE WHEN k % 2 = 0 THEN '-o2' ELSE concat('out', k) END, concat('f', k, '.c'), '-MF', concat('d', k))")
    s = e.select("id", F.inline(F.array(argv.fold(command, "CC"))))
    return lists(s, "in", "out", "opts")


@query("""WITH p AS (SELECT event_id AS id, CASE event_id % 9 WHEN 0 THEN 'scripts/kconfig/a.c' WHEN 1 THEN 'scripts/mod/empty.c' WHEN 2 THEN 'kernel/bounds.c' WHEN 3 THEN 'a.mod.c' WHEN 4 THEN 'x/.tmp_y.s' WHEN 5 THEN 'head.S' WHEN 6 THEN '/dev/null' WHEN 7 THEN 'ok.tmp' ELSE 'fs/inode.c' END AS i FROM events)
SELECT id, (i LIKE '%scripts/%' AND i NOT LIKE '%scripts/mod/empty.c%') OR i LIKE '%bounds%' OR i LIKE '%.mod.c' OR i LIKE '%.tmp_y.s' OR i LIKE '%.S' OR i = '/dev/null' OR i LIKE '%.tmp' AS bad FROM p""")
def preset_exclude(spark, d):
    """The kernel preset's lists, look-ahead and all."""
    conf = settings("kernel")
    e = fx.table(spark, d, "events").select(F.col("event_id").alias("id"), F.expr("CASE event_id % 9 WHEN 0 THEN 'scripts/kconfig/a.c' WHEN 1 THEN 'scripts/mod/empty.c' WHEN 2 THEN 'kernel/bounds.c' WHEN 3 THEN 'a.mod.c' WHEN 4 THEN 'x/.tmp_y.s' WHEN 5 THEN 'head.S' WHEN 6 THEN '/dev/null' WHEN 7 THEN 'ok.tmp' ELSE 'fs/inode.c' END").alias("i"))
    cmds = e.select("id", F.lit("/k").alias("cwd"), F.lit("CC").alias("type"), F.array("i").alias("in"), F.array(F.lit("o.o")).alias("out"), F.array().cast("array<string>").alias("opts"), F.array(F.lit("gcc")).alias("command"))
    return commands.bad(cmds, conf["exclude"], conf["exclude_in"], conf["include"], conf["exclude_out"], conf["ignore_cc1"]).select("id", "bad")


@query(f"WITH RECURSIVE {FOREST} SELECT id, CAST(max(depth) AS INT) AS depth FROM up GROUP BY id")
def pid_depth(spark, d):
    return graph.ancestors(fx.raw(spark, d).select("id", "pid")).groupBy("id").agg(F.max("depth").alias("depth"))


@query("SELECT page_id, '/r/' || CASE page_id % 3 WHEN 0 THEN 'b' || page_id WHEN 1 THEN 'a/b' || page_id || '/c' ELSE 'y' END AS p FROM pages")
def normalize_path_up(spark, d):
    """Paths that climb, one beyond the root."""
    p = fx.table(spark, d, "pages").selectExpr("page_id", "CASE page_id % 3 WHEN 0 THEN concat('a/../b', page_id) WHEN 1 THEN concat('a/./b', page_id, '/x/..//c/') ELSE '../../../r/y' END AS q")
    return p.select("page_id", paths.absolute(F.col("q"), F.lit("/r")).alias("p"))


@query("SELECT page_id, '/C/src/p' || page_id || '/a.c' AS windows, '/store/src/p' || page_id AS stored, 'p' || page_id || '/a.c' AS shown FROM pages")
def path_mappings(spark, d):
    """Windows paths, places in a store, paths as they are shown."""
    p = fx.table(spark, d, "pages").select("page_id", F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("n"))
    return p.select("page_id", paths.windows(F.concat(F.lit("C:\\src\\"), "n", F.lit("\\.\\a.c"))).alias("windows"), paths.stored(F.concat(F.lit("/src/./"), "n"), "/store/").alias("stored"), paths.shown(F.concat(F.lit("/base/"), "n", F.lit("/a.c")), F.lit("/base")).alias("shown"))


@query("SELECT event_id AS id, 'src/a b' || k || '.c|inc/x y.h|/usr/include/s' || k || '.h' AS deps FROM (SELECT event_id, event_id % 13 AS k FROM events)")
def make_rules(spark, d):
    """Prerequisites of make rules: continued lines, escaped and quoted blanks, repeats."""
    e = fx.table(spark, d, "events").select(F.col("event_id").alias("id"), F.expr(r"concat('out/a.o: src/a\\ b', event_id % 13, '.c \\\n  \"inc/x y.h\" \\\n /usr/include/s', event_id % 13, '.h inc/x\\ y.h\n')").alias("rule"))
    return e.select("id", F.array_join(text.dependencies(F.col("rule")), "|").alias("deps"))


@query("SELECT event_id AS id, '/w/a.h' AS path FROM events UNION ALL SELECT event_id, '/inc/b' || (event_id % 5) || '.h' FROM events UNION ALL SELECT event_id, '/w/m.c' FROM events")
def shown_includes(spark, d):
    """Headers that a compiler's output names, and the inputs, as dependencies of the command."""
    e = fx.table(spark, d, "events").select(F.col("event_id").alias("id"), F.expr("concat('m.c\r\nNote: including file: ./a.h\r\nПримечание: включение файла:   /inc/b', event_id % 5, '.h\r\nNote: including file: a.h\r\n')").alias("out"))
    cmds = e.select("id", F.lit("/w").alias("cwd"), F.array(F.lit("m.c")).alias("in"))
    return commands.dependencies(e.select("id", text.shown_includes(F.col("out")).alias("deps")), cmds, with_inputs=True)


@query("SELECT s_suppkey AS id, 'слово ' || s_suppkey || chr(10) || 'b' AS text FROM supplier")
def decoded_files(spark, d):
    """Texts in four encodings, told apart and read with equal line ends."""
    s = fx.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("слово "), F.col("s_suppkey").cast("string"), F.lit("\r\nb")).alias("t"))
    cyrillic = F.concat(F.unhex(F.lit("F1EBEEE2EE20")), F.encode(F.expr("substring(t, 7)"), "US-ASCII"))
    data = F.when(F.col("id") % 4 == 0, F.encode("t", "UTF-8")).when(F.col("id") % 4 == 1, cyrillic).when(F.col("id") % 4 == 2, F.encode("t", "UTF-16")).otherwise(F.concat(F.unhex(F.lit("EFBBBF")), F.encode("t", "UTF-8")))
    return s.select("id", logs.decoded(data).alias("text"))


@query("SELECT '/src/' || s_suppkey || '.c' AS path, 'v1' AS content, md5('v1') AS md5 FROM supplier UNION ALL SELECT '/new/' || s_suppkey || '.c', 'v2', md5('v2') FROM supplier")
def stored_files(spark, d):
    """Files added to a store twice: what it has stays."""
    at = folder(spark, "store")
    s = fx.table(spark, d, "supplier")
    one = s.selectExpr("concat('/src/', s_suppkey, '.c') AS path", "'v1' AS content")
    logs.store_files(one, at)
    logs.store_files(one.withColumn("content", F.lit("other")).union(s.selectExpr("concat('/new/', s_suppkey, '.c')", "'v2'")), at)
    return spark.read.parquet(at).select("path", "content", "md5")


@query("WITH io AS (SELECT event_id + 1 AS id, '/hot/' || (user_id % 3) AS path, event_id % 11 = 0 AS is_out FROM events) SELECT DISTINCT src, dst FROM (SELECT r.id AS dst, max(w.id) AS src FROM io r JOIN io w ON r.path = w.path AND w.is_out AND w.id < r.id WHERE NOT r.is_out GROUP BY r.id, r.path)")
def command_edges_hot(spark, d):
    """Three paths that all commands touch, searched in ranges of ids."""
    io_ = fx.table(spark, d, "events").selectExpr("event_id + 1 AS id", "concat('/hot/', user_id % 3) AS path", "event_id % 11 = 0 AS is_out")
    return graph.asof_edges(io_, long_path=100, ranges=16)
