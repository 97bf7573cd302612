import posixpath
import random
import re

from pyspark.sql import functions as F

from buildatlas.functions import argv, paths, text
from buildatlas.functions.option_tables import MANY, VALUED
from buildatlas.sources import facts, logs


def column(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_paths(spark):
    rng = random.Random(1)
    p = ["", "/", "//", "///", ".", "..", "/..", "//../a", "a/../..", "a/./b//c/", "/a/../../b"] + ["/".join(rng.choice(["..", ".", "", "a", "b.c"]) for _ in range(rng.randint(1, 7))) for _ in range(500)]
    assert column(spark, p, paths.normpath) == [posixpath.normpath(x) for x in p]
    names = ["/a/b.c", "b", ".a", "..a.b", "x.tar.gz", "/d.x/f", "a.", "/a"]
    assert column(spark, names, paths.basename) == [posixpath.basename(x) for x in names]
    assert column(spark, names, paths.extension) == [posixpath.splitext(x)[1] for x in names]
    assert column(spark, names, paths.dirname) == [posixpath.dirname(x) for x in names]
    assert column(spark, names, paths.stem) == [posixpath.splitext(posixpath.basename(x))[0] for x in names]
    assert column(spark, [" x/../y "], lambda c: paths.absolute(c, F.lit("/w"))) == ["/w/y"]
    assert column(spark, ["C:\\a\\..\\b"], paths.windows) == ["/C/b"]
    assert column(spark, ["/w/x", "/wx"], lambda c: paths.shown(c, F.lit("/w"))) == ["x", "/wx"]
    assert column(spark, ["//a/../b"], lambda c: paths.stored(c, "/s/")) == ["/s/b"]


def plain_fold(args, kind):
    of, left, out = "", 0, {"in": [], "out": [], "opts": []}
    for t in args[1:]:
        if left:
            out["out" if of == "-o" else "opts"].append(t)
            left -= 1
            continue
        left = 1 if t in VALUED.get(kind, ()) else MANY.get(kind, {}).get(t, 0)
        of = t
        if left and t == "-o":
            continue
        out["opts" if left or t.startswith("-") else "in"].append(t)
    return out


def test_argv_fold(spark):
    rng = random.Random(2)
    for kind in ("CC", "LD", "AS", "Objcopy"):
        rows = [["x", *(rng.choice(["-o", "a.c", "-c", "-I", "-L", "b.o", "-g", "-platform_version", "-x", "1.0", "--strip-all"]) for _ in range(rng.randint(0, 9)))] for _ in range(150)]
        df = spark.createDataFrame(list(enumerate(rows)), "i int, a array<string>")
        got = [r.s for r in df.orderBy("i").select(argv.fold(F.col("a"), kind).alias("s")).collect()]
        assert [(g["in"], g["out"], g["opts"]) for g in got] == [(w["in"], w["out"], w["opts"]) for w in (plain_fold(r, kind) for r in rows)]


def test_option_filter(spark):
    keep = lambda o, store=None: spark.createDataFrame([(o,)], "o array<string>").select(argv.supported(F.col("o"), store)).first()[0]
    assert keep(["-ABC", "-Dtest"]) == ["-Dtest"]
    assert keep(["-I", "/a", "-O2", "-O7", "-I/b", "-include", "c.h"], "/s") == ["-I", "/s/a", "-O2", "-I/s/b", "-include", "c.h"]
    assert keep(["-isysroot", "/r", "-I/b", "-isystem=/c"], "/s") == ["-isysroot", "/s/r", "-I/b", "-isystem=/c"]


def test_tokens(spark, sf_dir):
    lines = [l for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect() for l in r.text.split("\n")][:400] + ["", "é__x-1 ü", "  "]
    rows = text.token_rows(spark.createDataFrame(list(enumerate(lines)), "at long, text string"))
    got = sorted(tuple(r) for r in rows.select("at", "start", "end", "name").collect())
    assert got == sorted((i, m.start(), m.end(), m[0]) for i, l in enumerate(lines) for m in re.finditer(r"\w+", l))


def test_small_scalars(spark):
    assert column(spark, [None, "", "a", "a\n", "a\nb"], text.loc) == [0, 0, 1, 1, 2]
    assert column(spark, [" & zero", "(& zero)", "zero", "a b", "f()"], text.reference) == ["zero", "zero", "zero", "", ""]
    assert column(spark, [" actual_arg0=10, actual_arg1=x,y"], text.macro_args) == [["10", "x"]]
    assert column(spark, ["a.o: a.c b\\ c.h \\\n /usr/d.h\n"], text.dependencies) == [["a.c", "b c.h", "/usr/d.h"]]


def test_facts(spark):
    one = lambda kind, line: facts.parse(spark.createDataFrame([(line,)], "line string"), kind).first()
    r = one("execution", '"/a.c" 1,2 main 8 global int main(void);')
    assert (r.file, r.cmd_ids, r.func, r.line, r.type, r.signature) == ("/a.c", [1, 2], "main", 8, "extern", "int main(void);")
    r = one("call", '"/a.c" 3 main zero 10 static actual_arg_func_name0= cb actual_arg_func_name2= cd')
    assert [(a.idx, a.name) for a in r.args] == [("0", "cb"), ("2", "cd")] and r.type == "static"
    assert one("use_var", '"/a.c" f v 3').var == "v" and one("callp", '"/a.c" f fp 17').func_ptr == "fp" and one("exported", '"/a.c" f').func == "f"
    r = one("expand", '"/a.c" "/b.h" M 7 3')
    assert (r.exp_file, r.def_file, r.exp_line, r.def_line) == ("/a.c", "/b.h", 7, 3)
    r = one("init_global", '"/a.c" "int (*p)(void);" 4 global [{"value": " & zero"}]')
    assert r.signature == "int (*p)(void)" and r.type == "extern"
    try:
        one("define", "no fact")
        raise AssertionError
    except Exception as e:
        assert "bad define fact" in str(e)


def test_logs(spark, tmp_path):
    log = tmp_path / "cmds.txt"
    log.write_text("/w||0||/usr/bin/make||make||all\n/w||1||/usr/bin/gcc||gcc||-c||a.c\n")
    cmds = logs.read_commands(spark, str(log))
    assert [(r.id, r.pid, r.which, r.command) for r in cmds.orderBy("id").collect()] == [(1, 0, "/usr/bin/make", ["make", "all"]), (2, 1, "/usr/bin/gcc", ["gcc", "-c", "a.c"])]
    logs.write_commands(cmds, str(tmp_path / "out"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part*"))) == log.read_text()
    env = tmp_path / "envs.txt"
    env.write_text("A=1\nA=2\nB=x=y\n\nC=3\n\nD=4\n")
    assert sorted(map(tuple, logs.read_envs(spark, str(env)).collect())) == [(1, "A", "2"), (1, "B", "x=y"), (2, "C", "3")]
    (tmp_path / "none.txt").write_text("")
    try:
        logs.read_commands(spark, str(tmp_path / "none.txt"))
        raise AssertionError
    except RuntimeError:
        pass


def test_logs_in_splits(spark, tmp_path):
    log, env = tmp_path / "cmds.txt", tmp_path / "envs.txt"
    lines = [f"/w||{i}||/bin/t{i}||t||{'x' * (i % 90)}" if i % 7 else "" for i in range(1, 2001)]
    log.write_text("\n".join(lines))
    blocks = [f"N={i}\nV={'y' * (i % 50)}" for i in range(1, 801)]
    env.write_text("\n\n".join(blocks) + "\n\n \n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = logs.read_commands(spark, str(log))
        assert got.rdd.getNumPartitions() > 8
        assert [(r.id, r.pid) for r in got.orderBy("id").collect()] == [(i, i) for i in range(1, 2001) if i % 7]
        envs = logs.read_envs(spark, str(env))
        assert sorted(r.id for r in envs.where("name = 'N' AND value = CAST(id AS STRING)").collect()) == list(range(1, 801))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
