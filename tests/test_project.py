import pytest
from pyspark.sql import functions as F

from buildatlas.operators import commands, diff, graph
from buildatlas.plans import project
from buildatlas.plans.presets import settings
from buildatlas.plans.project import Project

LOG = """/w||0||/usr/bin/make||make
/w||1||/usr/bin/gcc||gcc||one.c||two.c||-o||tmp||-D||X||-O3
/w||2||/usr/bin/cc1||cc1||one.c
/w||1||/bin/mv||mv||tmp||prog
/w||1||/usr/bin/gcc||gcc||-c||one.c||two.c
/w||1||/usr/bin/ar||ar||rcs||two.a||two.o||one.o
/w||1||/usr/bin/ld||ld||one.o||-o||one.out||-g||-l||two||-L||lib
/w||1||/usr/bin/gcc||gcc||two.c||-M||-MF||x.txt
/w||1||/usr/bin/objcopy||objcopy||one.o||--strip-all
/w||1||/usr/bin/as||as||e.s||-o||e.o||-I||/usr/include
/w||1||/usr/bin/ccache||ccache||/usr/bin/g++||three.cc||--ccache-skip||-c
/w||1||/bin/ln||ln||-s||one.c||link.c"""
SOURCES = {"/w/one.c": '#include "two.h"\nint use(void)\n{\n  return two(1) + TWO;\n}\n', "/w/two.c": "#define TWO 2\nint two(int x)\n{\n  return x;\n}\nint (*tp)(int) = &two;\n", "/w/two.h": "int two(int x);\n", "/w/link.c": "copy"}
FACTS = {
    "execution": ['"/w/one.c" 2,5 use 2 global int use(void);', '"/w/two.c" 2,5 two 2 global int two(int);'],
    "declare_func": ['"/w/two.h" 2 two 1 global int two(int);', '"/w/two.h" 2 gone 1 global int gone();'],
    "call": ['"/w/one.c" 2 use two 4 global ', '"/w/one.c" 2 use __builtin_x 4 global ', '"/w/one.c" 2 use nowhere 4 global '],
    "use_func": ['"/w/two.c" 2 NULL two 6 global'],
    "callp": ['"/w/one.c" use fp 4', '"/w/one.c" use fp 3'],
    "define": ['"/w/two.c" TWO 1'],
    "expand": ['"/w/one.c" "/w/two.c" TWO 4 1', '"/w/one.c" "/x.h" LOST 4 1'],
    "expand_args": ['"/w/one.c" TWO actual_arg0=10'],
    "init_global": ['"/w/two.c" "int (*tp)(int);" 2 global [{"value": " & two"}, {"value": [{"value": "(& no)"}]}]'],
    "typedefs": ['"/w/one.c" typedef unsigned char u8;', '"/w/one.c" typedef unsigned char u8;'],
    "exported": ['"/w/one.c" use'],
}


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    log = tmp_path_factory.mktemp("log") / "cmds.txt"
    log.write_text(LOG)
    lines = {k: spark.createDataFrame([(x,) for x in v], "line string") for k, v in FACTS.items()}
    files = spark.createDataFrame([(p, c) for p, c in SOURCES.items()], "path string, content string").select("path", F.md5(F.col("content").cast("binary")).alias("md5"), F.lit(True).alias("in_storage"), "content")
    return Project(spark, str(log), lines, files)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_commands(built):
    got = {r.id: r for r in built.get("cmds").collect()}
    assert sorted(got) == [2, 4, 5, 6, 7, 8, 9, 10, 11, 12]  # make isn't parsed, cc1 runs below gcc
    assert (got[2]["in"], got[2]["out"], got[2]["opts"]) == (["/w/one.c", "/w/two.c"], ["/w/tmp"], ["-D", "X", "-O3"])
    assert got[5]["out"] == ["/w/one.o", "/w/two.o"]
    assert (len(got[6]["in"]), len(got[6]["out"]), len(got[6]["opts"]), len(got[6]["command"])) == (2, 1, 1, 5)
    assert got[7]["opts"] == ["-g", "-l", "two", "-L", "lib"] and got[9]["out"] == ["/w/one.o"]
    assert (got[10]["in"], got[10]["out"], got[10]["opts"]) == (["/w/e.s"], ["/w/e.o"], ["-I", "/usr/include"])
    assert got[11]["type"] == "CXX" and got[11]["out"] == ["/w/three.o"]
    assert (got[12]["in"], got[12]["out"]) == (["/w/one.c"], ["/w/link.c"])


def test_graphs(built):
    assert rows(built.get("cmd_edges"), "src", "dst") == [(2, 4), (5, 6), (5, 7), (5, 9)]
    sg = {(r.file, r.cmd_id): r.used_by for r in built.get("src_graph").collect()}
    assert sg[("/w/one.c", 2)] == [4] and sg[("/w/two.c", 5)] == [6, 7, 9] and ("/w/two.c", 8) not in sg
    assert rows(built.root_cmds(4), "id", "paths") == [(2, 1)] and rows(built.leaf_cmds(5), "id") == [(6,), (7,), (9,)]
    assert ("/w/one.c", 5) in {(r.file, r["loc"]) for r in built.get("src_info").collect()}
    db = rows(built.get("cdb").where("id = 5"), "file", "output")
    assert db == [("/w/one.c", "/w/one.o"), ("/w/two.c", "/w/two.o")]


def test_sources(built):
    f = {(r.func, r.file): r for r in built.get("functions").collect()}
    assert f[("use", "/w/one.c")].type == "exported" and f[("two", "/w/two.c")].declarations[0].file == "/w/two.h"
    assert ("gone", "unknown") in f
    assert rows(built.get("call_edges"), "to_file", "to_func", "match") == [("/w/two.c", "two", 4), ("unknown", "nowhere", 0)]
    assert rows(built.get("used_in"), "def_file", "scope", "match") == [("/w/two.c", "file", 3)]
    assert rows(built.get("used_in_vars"), "func", "def_file") == [("two", "/w/two.c")]
    assert rows(built.get("macro_exps"), "def_file", "name") == [("/w/two.c", "TWO"), ("unknown", "LOST")]
    assert built.get("macro_args").first().args == [["10"]] and built.get("typedefs").count() == 1
    assert built.get("calls_by_ptr").first().lines == [3, 4]
    assert ("/w/one.c", "use", "exported") in rows(built.get("call_nodes"), "file", "func", "type")


def test_cross_references(built):
    to = set(rows(built.get("ref_to"), "file", "kind", "line", "start", "end", "to_file", "to_line"))
    assert to == {("/w/one.c", "def_func", 4, 9, 12, "/w/two.c", 2), ("/w/one.c", "decl_func", 4, 9, 12, "/w/two.h", 1), ("/w/one.c", "def_macro", 4, 18, 21, "/w/two.c", 1)}
    from_ = {(r.file, r.kind, r.line, r.start, r.end, r.from_file, tuple(r.from_lines)) for r in built.get("ref_from").collect()}
    assert ("/w/two.c", "call", 2, 4, 7, "/w/one.c", (4,)) in from_ and ("/w/two.h", "call", 1, 4, 7, "/w/one.c", (4,)) in from_
    assert ("/w/two.c", "expand", 1, 8, 11, "/w/one.c", (4,)) in from_


def test_lookups(built):
    assert rows(built.trace(["use"], ["two"]), "src", "dst") == [("/w/one.c:use", "/w/two.c:two")]
    with pytest.raises(RuntimeError):
        built.trace(["use"], ["missing"])
    with pytest.raises(RuntimeError):
        built.raw_cmd(99)
    with pytest.raises(TypeError):
        built.where("functions", file="x")
    assert built.where("functions", file=[]).count() == built.get("functions").count()
    assert built.functions_in(["/w/one.c"]).count() == 2 and built.functions_like("^TW").count() == 1
    assert built.order("call_edges")[-1] == "call_edges" and "cmds" in built.order("call_edges")
    assert built.cmds_by_type("CC", with_opts=True).columns[-1] == "opts"
    assert settings("kernel")["which"] == settings("base")["which"]


def test_added_relations(built):
    @project.relation("cmds")
    def tools(p, cmds):
        return cmds.groupBy("type").count()

    assert built.get("tools").where("type = 'CC'").first()["count"] == 3
    del project.RELATIONS["tools"]


def test_graph_cases(spark):
    e = lambda *x: spark.createDataFrame(list(x), "src long, dst long")
    assert rows(graph.closure(e((1, 2), (2, 3), (3, 1))), "src", "dst") == [(i, j) for i in (1, 2, 3) for j in (1, 2, 3)]
    assert rows(graph.path_counts(e((1, 2), (1, 3), (2, 4), (3, 4))), "src", "dst", "paths")[2] == (1, 4, 2)
    chain = spark.createDataFrame([(i, i - 1) for i in range(1, 200)], "id long, pid long")
    assert graph.ancestors(chain).where("id = 199").count() == 199
    assert "digraph" not in "".join(r.line for r in graph.dot(e((1, 2))).collect())
    d = diff.diff(spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string"), spark.createDataFrame([(2, None), (3, "d"), (4, "e")], "k int, v string"), ["k"], ["v"])
    assert rows(d, "k", "status") == [(1, "removed"), (2, "same"), (3, "changed"), (4, "added")]


def test_microsoft(spark):
    df = spark.createDataFrame([(["cl.exe", "/c", "a.c", "/Foout\\", "/link", "x"], ["link.exe", "/OUT:p.exe", "a.obj"], ["cmd.exe", "/c", "copy", "/Y", "a.txt", "d/"])], "cl array<string>, ln array<string>, cp array<string>")
    r = df.select(*[commands.shape(k, F.col(c), F.lit("/w")).alias(c) for k, c in (("CL", "cl"), ("Link", "ln"), ("Copy", "cp"))]).first()
    assert (r.cl["in"], r.cl["out"]) == (["a.c"], ["out/a.obj"]) and (r.ln["in"], r.ln["out"]) == (["a.obj"], ["p.exe"]) and (r.cp["in"], r.cp["out"]) == (["a.txt"], ["d/a.txt"])


def test_preset_lists(spark):
    def dropped(preset, inputs, outputs):
        rows = [(i, "/k", "CC", [x], ["ok.o"], [], ["gcc"]) for i, x in enumerate(inputs)] + [(100 + i, "/k", "CC", ["ok.c"], [x], [], ["gcc"]) for i, x in enumerate(outputs)]
        cmds = spark.createDataFrame(rows, "id long, cwd string, type string, in array<string>, out array<string>, opts array<string>, command array<string>")
        conf = settings(preset)
        return sorted(r.id for r in commands.bad(cmds, conf["exclude"], conf["exclude_in"], conf["include"], conf["exclude_out"]).where("bad").collect())

    for preset in ("kernel", "klever_linux_kernel", "klever_linux_kernel_arm"):
        assert dropped(preset, ["kernel/bounds.c", "arch/x86/tools/relocs_64.c", "arch/x86/kernel/asm-offsets.c", "a/.tmpx.s", "fine.c"], ["scripts/kconfig.o", "scripts/mod/empty.o", "x.cmd", "fine.o"]) == [0, 1, 2, 3, 100, 102]
    assert dropped("busybox_linux", ["tmp.ab.c", "built-in.o", "fine.c"], ["tmp.x", "x.cmd"]) == [0, 1, 100, 101]
    assert dropped("klever_busybox_linux", ["/tmp/x.o"], []) == [0]
    assert dropped("apache_linux", ["built-in.o", "fine.c"], ["/tmp/x.o", "fine.o"]) == [0, 100]
    assert settings("klever")["extensions"] == ["Callgraph", "Variables", "Typedefs", "Macros", "CrossRef"]
