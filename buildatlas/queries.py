"""Registered queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as fx
from .functions import argv, paths, text
from .operators import commands, crossref, diff, graph, sourcecode
from .plans.durable import folder, stored
from .sources import facts, logs
from .streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def line(c: str):
    return F.concat_ws(" ", F.col(c).cast("array<string>")).alias(c)


CMD = """cmd AS (SELECT event_id + 1 AS id, event_id // 4 AS pid, '/work/u' || (user_id % 7) AS cwd,
  CASE event_type WHEN 'click' THEN 'gcc' WHEN 'view' THEN 'ld' WHEN 'purchase' THEN 'mv' WHEN 'signup' THEN 'ar' ELSE 'objcopy' END AS tool, CAST(event_id % 97 AS VARCHAR) AS k FROM events),
arg AS (SELECT *, '/usr/bin/' || tool AS which, CASE tool WHEN 'gcc' THEN 'gcc -c f' || k || '.c -o f' || k || '.o' WHEN 'ld' THEN 'ld -o prog' || k || ' f' || k || '.o lib' || k || '.a'
  WHEN 'ar' THEN 'ar rcs lib' || k || '.a f' || k || '.o' WHEN 'mv' THEN 'mv -f f' || k || '.o g' || k || '.o' ELSE 'objcopy --strip-all f' || k || '.o h' || k || '.o' END AS command FROM cmd)"""
PARSED = CMD + """, parsed AS (SELECT id, pid, cwd, which, command, CASE tool WHEN 'gcc' THEN 'CC' WHEN 'ld' THEN 'LD' WHEN 'ar' THEN 'AR' WHEN 'mv' THEN 'MV' ELSE 'Objcopy' END AS type,
  CASE tool WHEN 'gcc' THEN 'f' || k || '.c' WHEN 'ld' THEN 'f' || k || '.o lib' || k || '.a' ELSE 'f' || k || '.o' END AS "in",
  CASE tool WHEN 'gcc' THEN 'f' || k || '.o' WHEN 'ld' THEN 'prog' || k WHEN 'ar' THEN 'lib' || k || '.a' WHEN 'mv' THEN 'g' || k || '.o' ELSE 'h' || k || '.o' END AS out,
  CASE tool WHEN 'gcc' THEN '-c' WHEN 'ld' THEN '' WHEN 'ar' THEN 'rcs' WHEN 'mv' THEN '-f' ELSE '--strip-all' END AS opts FROM arg)"""
IO = "io AS (SELECT DISTINCT l_orderkey + 1 AS id, '/proj' || (l_orderkey // 50) || '/p' || (l_partkey % 40) AS path, l_linenumber = 1 AS is_out FROM lineitem)"
EDGE = IO + ", edge AS (SELECT DISTINCT src, dst FROM (SELECT r.id AS dst, max(w.id) AS src FROM io r JOIN io w ON r.path = w.path AND w.is_out AND w.id < r.id WHERE NOT r.is_out GROUP BY r.id, r.path))"
CLOSE = EDGE + ", reach AS (SELECT src, dst FROM edge UNION SELECT r.src, e.dst FROM reach r JOIN edge e ON r.dst = e.src)"


def every(spark: SparkSession, d: str) -> DataFrame:
    """All commands of all types, parsed."""
    return commands.parsed(commands.classified(fx.raw(spark, d), fx.WHICH), list(fx.WHICH))


# -- logs ------------------------------------------------------------------------------------


@query(f"WITH {CMD} SELECT id, cwd, pid, which, command FROM arg")
def cmds_scan(spark, d):
    return fx.raw(spark, d).select("id", "cwd", "pid", "which", line("command"))


@query(f"WITH {CMD} SELECT id, concat_ws('||', cwd, CAST(pid AS VARCHAR), which, replace(command, ' ', '||')) AS line FROM arg")
def cmds_split_roundtrip(spark, d):
    return logs.join_commands(fx.raw(spark, d))


@query(f"WITH {CMD} SELECT id, which FROM arg WHERE regexp_matches(which, 'cc$|/ld$')")
def cmds_by_which(spark, d):
    return commands.by_which(fx.raw(spark, d), fx.WHICH["CC"] + fx.WHICH["LD"]).select("id", "which")


@query(f"WITH {CMD} SELECT CAST(count(*) AS BIGINT) AS n FROM arg WHERE regexp_matches(which, 'cc$|/ld$')")
def cmds_count_by_which(spark, d):
    return commands.by_which(fx.raw(spark, d), fx.WHICH["CC"] + fx.WHICH["LD"]).agg(F.count("*").alias("n"))


@query(f"WITH {CMD} SELECT which, count(*) AS n FROM arg GROUP BY which")
def cmd_stats(spark, d):
    return commands.stats(fx.raw(spark, d))


@query(f"WITH {CMD} SELECT which, count(*) AS n FROM arg GROUP BY ROLLUP (which)")
def cmd_stats_total(spark, d):
    return commands.stats_total(fx.raw(spark, d))


@query(f"WITH {CMD} SELECT min(id) AS first_id, max(id) AS last_id, arg_min(cwd, id) AS build_dir, arg_max(which, id) AS last_which FROM arg")
def first_last_cmd(spark, d):
    return commands.ends(fx.raw(spark, d))


@query(f"WITH {CMD} SELECT id, which FROM arg WHERE id = (SELECT min(id) FROM arg)")
def cmd_by_id(spark, d):
    raw = fx.raw(spark, d)
    return commands.by_id(raw, commands.ends(raw).first().first_id).select("id", "which")


def envs(spark, d):
    e = fx.table(spark, d, "events").selectExpr("event_id % 500 AS id", "event_id", "concat('VAR_', user_id % 13, '=', event_id, '=', event_type) AS v")
    return logs.parse_envs(e.groupBy("id").agg(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("event_id", "v"))), lambda x: x["v"])).alias("block")))


@query("SELECT event_id % 500 AS id, 'VAR_' || (user_id % 13) AS name, arg_max(event_id || '=' || event_type, event_id) AS value FROM events GROUP BY 1, 2")
def env_blocks(spark, d):
    return envs(spark, d)


@query("SELECT event_id % 500 AS id, count(DISTINCT user_id % 13) AS n FROM events GROUP BY 1")
def env_stats(spark, d):
    return envs(spark, d).groupBy("id").agg(F.count("name").alias("n"))


@query("SELECT event_id AS cmd_id, value > 50 AS existed, CAST(user_id AS INT) AS flags, '/a b/' || event_type AS path FROM events")
def open_log(spark, d):
    e = fx.table(spark, d, "events").select(F.format_string("%d %d %d /a b/%s", "event_id", F.coalesce(F.col("value") > 50, F.lit(False)).cast("int"), "user_id", "event_type").alias("line"))
    return logs.parse_opens(e)


# -- parsers, filters, paths -----------------------------------------------------------------


@query(f'WITH {PARSED} SELECT id, type, "in", out, opts, which || substr(command, strpos(command, \' \')) AS command FROM parsed')
def cmds_parsed(spark, d):
    return every(spark, d).select("id", "type", line("in"), line("out"), line("opts"), line("command"))


@query(f"WITH {PARSED} SELECT id, type FROM parsed")
def cmd_type(spark, d):
    return commands.classified(fx.raw(spark, d), fx.WHICH).select("id", "type")


@query(f'WITH {PARSED} SELECT id, regexp_matches("in", \'f[0-9]*7\\.[co]\') OR regexp_matches(out, \'prog1\') OR NOT regexp_matches(cwd, \'u[0-5]\') AS bad FROM parsed')
def bad_cmds(spark, d):
    return commands.bad(every(spark, d), exclude_in=[r"f[0-9]*7\.[co]$"], exclude_out=["prog1"], include=["/u[0-5]/"]).select("id", "bad")


@query(f'WITH {PARSED} SELECT id, "in" FROM parsed WHERE type = \'CC\'')
def compile_only(spark, d):
    return commands.compilations(every(spark, d)).select("id", line("in"))


@query(f"WITH {PARSED} SELECT id, cwd AS directory, which || substr(command, strpos(command, ' ')) AS arguments, \"in\" AS file, out AS output FROM parsed WHERE type = 'CC'")
def cdb(spark, d):
    return commands.compilation_database(every(spark, d)).select("id", "directory", line("arguments"), "file", "output")


@query(f"""WITH {PARSED} SELECT DISTINCT cwd || '/' || unnest(string_split("in", ' ')) AS src, cwd || '/' || out AS dst, type FROM parsed WHERE type <> 'MV'""")
def file_graph_edges(spark, d):
    return commands.file_graph(commands.normalized(every(spark, d)), without=("MV",))


@query("SELECT event_id AS id, (event_id % 9) || '.c' AS src, '/w/u' || (user_id % 7) || '/' || (event_id % 9) || '.c' AS place FROM events")
def parse_ln(spark, d):
    e = fx.table(spark, d, "events").selectExpr("event_id AS id", "'/w' AS cwd", "concat(event_id % 9, '.c') AS src", "concat('/w/u', user_id % 7) AS to")
    command = F.expr("CASE id % 4 WHEN 0 THEN array('ln', '-s', src, concat(to, '/')) WHEN 1 THEN array('ln', '-t', to, src) WHEN 2 THEN array('ln', concat('--target-directory=', to), src) ELSE array('ln', src, concat(to, '/', src)) END")
    s = e.select("id", commands.shape("LN", command, F.col("cwd")).alias("s"))
    return s.select("id", F.explode(F.arrays_zip(F.col("s.in").alias("src"), F.col("s.out").alias("place"))).alias("p")).select("id", "p.src", "p.place")


@query("SELECT event_id AS id, '-I /store/usr/i' || (user_id % 5) || ' -DX -O2 -include a.h' AS opts FROM events")
def option_filter(spark, d):
    e = fx.table(spark, d, "events").selectExpr("event_id AS id", "array('-Wall', '-I', concat('/usr/i', user_id % 5), '-DX', '-g', '-O2', '-O9', '-include', 'a.h') AS o")
    return e.select("id", F.concat_ws(" ", argv.supported(F.col("o"), "/store")).alias("opts"))


@query("SELECT s AS id, '/usr/lib/lib' || (s % 4) || '.a' AS path FROM (SELECT s_suppkey AS s FROM supplier) WHERE s % 4 < 3")
def archive_search(spark, d):
    cmds = fx.table(spark, d, "supplier").selectExpr("s_suppkey AS id", "'/w' AS cwd", "array('-L', '/opt/none', concat('-l', s_suppkey % 4), '-L/usr/lib') AS opts")
    known = spark.createDataFrame([(f"/usr/lib/lib{i}.a",) for i in range(3)], "path string")
    return commands.archives(cmds, known, ["/lib"])


@query(r"SELECT page_id, rtrim(regexp_replace('/r//./' || regexp_replace(url, '^[a-z]+:/+', '') || '/', '/(\.?/)+', '/', 'g'), '/') AS p FROM pages")
def normalize_path(spark, d):
    p = fx.table(spark, d, "pages").select("page_id", F.concat(F.lit("/r//./"), F.regexp_replace("url", "^[a-z]+:/+", ""), F.lit("/")).alias("p"))
    return p.select("page_id", paths.normpath(F.col("p")).alias("p"))


@query("SELECT doc_id, 'd' || doc_id || '.tar.c' AS base, '/src/' || source AS dir, '.c' AS ext, md5('/src/' || source || '/d' || doc_id || '.tar.c') AS hash FROM documents")
def path_parts(spark, d):
    p = fx.table(spark, d, "documents").selectExpr("doc_id", "concat('/src/', source, '/d', doc_id, '.tar.c') AS p")
    c = F.col("p")
    return p.select("doc_id", paths.basename(c).alias("base"), paths.dirname(c).alias("dir"), paths.extension(c).alias("ext"), paths.digest(c).alias("hash"))


# -- process forest and command graph --------------------------------------------------------

FOREST = "f AS (SELECT event_id + 1 AS id, event_id // 4 AS pid FROM events), up AS (SELECT id, pid AS ancestor, 1 AS depth FROM f WHERE pid < id UNION ALL SELECT up.id, f.pid, depth + 1 FROM up JOIN f ON up.ancestor = f.id WHERE f.pid < f.id)"


@query(f"WITH RECURSIVE {FOREST} SELECT id, ancestor, CAST(depth AS INT) AS depth FROM up")
def pid_ancestors(spark, d):
    return graph.ancestors(fx.raw(spark, d).select("id", "pid"))


@query(f"WITH RECURSIVE {FOREST}, c AS (SELECT event_id + 1 AS id FROM events WHERE event_type IN ('purchase', 'error')) SELECT id FROM c WHERE id NOT IN (SELECT up.id FROM up JOIN c ON up.ancestor = c.id)")
def dedup_by_pid(spark, d):
    raw = fx.raw(spark, d)
    return graph.without_descendants(commands.by_which(raw, fx.WHICH["MV"] + fx.WHICH["Objcopy"]).select("id"), raw.select("id", "pid"))


@query(f"WITH {EDGE} SELECT src, dst FROM edge")
def command_edges(spark, d):
    return graph.asof_edges(fx.cmd_io(spark, d))


@query(f"WITH RECURSIVE {CLOSE} SELECT src, dst FROM reach")
def cmd_closure(spark, d):
    return graph.closure(graph.asof_edges(fx.cmd_io(spark, d)))


@query(f"WITH RECURSIVE {EDGE}, p AS (SELECT src, dst FROM edge UNION ALL SELECT p.src, e.dst FROM p JOIN edge e ON p.dst = e.src) SELECT src, dst, count(*) AS paths FROM p GROUP BY src, dst")
def root_leaf_paths(spark, d):
    return graph.path_counts(graph.asof_edges(fx.cmd_io(spark, d)))


SRC = CLOSE + ", sg AS (SELECT i.path AS file, i.id AS cmd_id, string_agg(CAST(r.dst AS VARCHAR), ' ' ORDER BY r.dst) AS used_by FROM io i LEFT JOIN reach r ON r.src = i.id WHERE i.is_out GROUP BY 1, 2)"


@query(f"WITH RECURSIVE {SRC} SELECT file, cmd_id, coalesce(used_by, '') AS used_by FROM sg")
def src_graph(spark, d):
    io = stored(fx.cmd_io(spark, d))
    return commands.source_graph(io.where("is_out").select("id", "path"), graph.closure(graph.asof_edges(io))).select("file", "cmd_id", line("used_by"))


@query(f"WITH RECURSIVE {CLOSE}, pair AS (SELECT DISTINCT i.id AS a, i.id + 1 AS b FROM io i) SELECT DISTINCT a, b FROM pair JOIN reach x ON x.src = a JOIN reach y ON y.src = b AND x.dst = y.dst")
def files_linked(spark, d):
    io = stored(fx.cmd_io(spark, d))
    sg = commands.source_graph(io.select("id", "path"), graph.closure(graph.asof_edges(io)))
    return commands.files_linked(io.selectExpr("id AS a", "id + 1 AS b").distinct(), sg)


@query("WITH f AS (SELECT '/src/' || source || '/d' || doc_id || '.c' AS path, md5(text) AS m FROM documents), c AS (SELECT m, min(path) AS same_as, count(DISTINCT path) AS n FROM f GROUP BY m HAVING n > 1) SELECT DISTINCT path, same_as, n FROM f JOIN c USING (m)")
def content_classes(spark, d):
    return commands.content_classes(fx.files(spark, d))


@query("WITH f AS (SELECT doc_id AS k, '/src/' || source || '/d' || doc_id || '.c' AS path, md5(text) AS m FROM documents), g AS (SELECT m, min(k) AS k FROM f GROUP BY m), p AS (SELECT DISTINCT f.path AS a, f2.path AS b FROM f JOIN g USING (m) JOIN f f2 ON f2.k = g.k AND f2.m = f.m WHERE f.path <> f2.path UNION SELECT f.path, f2.path FROM f JOIN f f2 ON f2.k = f.k + 1 AND f2.m = f.m WHERE f.path <> f2.path) SELECT a AS path, b AS alt_path FROM p UNION SELECT b, a FROM p")
def alternatives(spark, d):
    """Every path is linked with the path of the smallest document of equal text, and with that of the next document."""
    files = fx.files(spark, d)
    own = F.regexp_extract("path", r"/d(\d+)\.c$", 1).cast("bigint")
    rows = files.select("path", "md5", own.alias("k"))
    same = rows.join(rows.groupBy("md5").agg(F.min_by("path", "k").alias("alt")), "md5").select("path", "alt")
    after = rows.select("path", (F.col("k") + 1).alias("k")).join(rows.select("k", F.col("path").alias("alt")), "k").select("path", "alt")
    return commands.alternatives(files, same.union(after))


@query("WITH f AS (SELECT '/src/' || source || '/d' || doc_id || '.c' AS path, md5(text) AS m, doc_id % 4 <> 0 AS s FROM documents), c AS (SELECT m, coalesce(max(path) FILTER (WHERE s), max(path)) AS canonical FROM f GROUP BY m) SELECT DISTINCT path, canonical FROM f JOIN c USING (m)")
def canonical_path(spark, d):
    return commands.canonical(fx.files(spark, d))


@query("SELECT '/src/' || source || '/d' || doc_id || '.c' AS path, CAST(CASE WHEN coalesce(text, '') = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN text LIKE '%' || chr(10) THEN 0 ELSE 1 END END AS INT) AS loc FROM documents")
def src_loc(spark, d):
    return fx.files(spark, d).select("path", text.loc(F.col("content")).alias("loc"))


# -- facts -----------------------------------------------------------------------------------


@query("SELECT '/src/m' || (l_suppkey % 47) || '.c' AS ctx_file, CAST(l_orderkey AS VARCHAR) || ' 7' AS cmd_ids, 'g' || (l_orderkey % 30) AS ctx_func, 'f' || l_partkey AS func, CAST(l_linenumber AS INT) AS line, CASE WHEN l_linestatus = 'O' THEN 'static' ELSE 'extern' END AS type, '0:cb' || (l_partkey % 5) AS args FROM lineitem")
def fact_parse_calls(spark, d):
    rows = fx.table(spark, d, "lineitem").select(F.expr("concat('\"/src/m', l_suppkey % 47, '.c\" ', l_orderkey, ',7 g', l_orderkey % 30, ' f', l_partkey, ' ', l_linenumber, CASE WHEN l_linestatus = 'O' THEN ' static' ELSE ' global' END, ' actual_arg_func_name0= cb', l_partkey % 5, ' x')").alias("line"))
    got = facts.parse(rows, "call")
    return got.withColumn("cmd_ids", line("cmd_ids")).withColumn("args", F.concat_ws(" ", F.transform("args", lambda a: F.concat_ws(":", a["idx"], a["name"]))))


FACT = "SELECT '/src/m' || (l_suppkey % 47) || '.c' AS path, (l_partkey % 90) || ' ' || l_linenumber AS rest, l_orderkey % 40 AS cmd_id FROM lineitem"


@query(f"WITH f AS ({FACT}) SELECT path, string_agg(CAST(cmd_id AS VARCHAR), ',' ORDER BY cmd_id) AS ids, rest FROM (SELECT DISTINCT * FROM f) GROUP BY path, rest")
def fact_combine_ids(spark, d):
    return facts.combined(fx.table(spark, d, "lineitem").selectExpr("concat('/src/m', l_suppkey % 47, '.c') AS path", "concat(l_partkey % 90, ' ', l_linenumber) AS rest", "l_orderkey % 40 AS cmd_id"))


@query(f"WITH f AS ({FACT}) SELECT DISTINCT path, cmd_id || ' ' || rest AS line FROM f")
def fact_dedup(spark, d):
    return facts.distinct_lines(fx.table(spark, d, "lineitem").selectExpr("concat('/src/m', l_suppkey % 47, '.c') AS path", "concat(l_orderkey % 40, ' ', l_partkey % 90, ' ', l_linenumber) AS line"))


# -- functions and calls ---------------------------------------------------------------------

DEF = "SELECT 'f' || (p_partkey // 7) AS func, '/src/m' || (p_partkey % 47) || '.c' AS file, p_partkey % 47 AS cmd, CAST(p_size AS INT) AS line, CASE WHEN p_partkey % 3 = 0 THEN 'static' ELSE 'extern' END AS type, p_brand AS signature, p_partkey AS ord FROM part"
GROUPED = f"d AS ({DEF}), g AS (SELECT func, file, line, string_agg(DISTINCT CAST(cmd AS VARCHAR), ' ') AS compiled_in, arg_min(type, ord) AS type, arg_min(signature, ord) AS signature FROM d GROUP BY func, file, line)"


@query(f"WITH {GROUPED} SELECT func, file, line, compiled_in, type, signature FROM g")
def func_definitions(spark, d):
    return sourcecode.definitions(fx.definitions(spark, d)).select("func", "file", "line", line("compiled_in"), "type", "signature")


@query(f"WITH {GROUPED}, x AS (SELECT DISTINCT 'f' || (p_partkey // 7) AS func, '/src/m' || (p_partkey % 47) || '.c' AS file FROM part WHERE p_retailprice > 1200) SELECT func, file, line, CASE WHEN x.func IS NOT NULL THEN 'exported' ELSE type END AS type FROM g LEFT JOIN x USING (func, file)")
def func_exported(spark, d):
    marks = fx.table(spark, d, "part").where("p_retailprice > 1200").selectExpr("concat('f', p_partkey div 7) AS func", "concat('/src/m', p_partkey % 47, '.c') AS file")
    return sourcecode.exported(sourcecode.definitions(fx.definitions(spark, d)), marks).select("func", "file", "line", "type")


@query(f"WITH {GROUPED} SELECT file, string_agg(func || ':' || line, ' ' ORDER BY func || ':' || line) AS funcs FROM g GROUP BY file")
def funcs_by_file(spark, d):
    g = sourcecode.definitions(fx.definitions(spark, d))
    return g.groupBy("file").agg(F.concat_ws(" ", F.array_sort(F.collect_list(F.concat_ws(":", "func", F.col("line").cast("string"))))).alias("funcs"))


REFS = """c AS (SELECT DISTINCT concat_ws('/', l_orderkey, l_linenumber, l_suppkey, l_partkey, l_linestatus) AS ref_id, '/src/m' || (l_suppkey % 47) || '.c' AS ctx_file, l_suppkey % 61 AS cmd, 'f' || (l_partkey // 7) AS func, CASE WHEN l_linestatus = 'O' THEN 'static' ELSE 'extern' END AS type FROM lineitem),
p AS (SELECT DISTINCT 'f' || (p_partkey // 7) AS func, '/src/m' || (p_partkey % 47) || '.c' AS d_file, p_partkey % 47 AS d_cmd, CASE WHEN p_partkey % 11 = 0 THEN 'exported' WHEN p_partkey % 3 = 0 THEN 'static' ELSE 'extern' END AS d_type FROM part)"""
TIERS = "m AS (SELECT c.ref_id, c.func, coalesce({case}, 0) AS match, d_file FROM c LEFT JOIN p ON c.func = p.func), b AS (SELECT ref_id, max(match) AS best FROM m GROUP BY ref_id) SELECT DISTINCT ref_id, func, CASE WHEN match > 0 THEN d_file ELSE 'unknown' END AS to_file, CAST(match AS INT) AS match FROM m JOIN b USING (ref_id) WHERE match = best"
CALL = TIERS.format(case="CASE WHEN d_type <> type AND d_type <> 'exported' THEN 0 WHEN cmd = d_cmd AND ctx_file = d_file THEN 5 WHEN cmd = d_cmd THEN 4 WHEN d_type = 'exported' AND type = 'extern' THEN 3 WHEN cmd // 5 = d_cmd // 5 AND cmd = d_cmd + 5 THEN 2 WHEN cmd = d_cmd + 5 THEN 1 END")
USE = TIERS.format(case="CASE WHEN d_type <> type AND d_type <> 'exported' THEN 0 WHEN cmd = d_cmd AND ctx_file = d_file THEN 3 WHEN cmd = d_cmd THEN 2 WHEN cmd // 5 = d_cmd // 5 THEN 1 END")
INIT = TIERS.format(case="CASE WHEN cmd = d_cmd AND ctx_file = d_file THEN 3 WHEN cmd = d_cmd THEN 2 WHEN cmd // 5 = d_cmd // 5 THEN 1 END").replace("LEFT JOIN p", "JOIN p")
PICK = ("ref_id", "func", "to_file", "match")


@query(f"WITH {REFS}, {CALL}")
def call_resolve(spark, d):
    return sourcecode.calls(fx.calls(spark, d), fx.resolvable(spark, d)).select(*PICK).distinct()


@query(f"WITH {REFS}, {USE}")
def used_in(spark, d):
    return sourcecode.usages(fx.calls(spark, d), fx.resolvable(spark, d)).select(*PICK).distinct()


@query(f"WITH {REFS}, {INIT}")
def used_in_vars(spark, d):
    return sourcecode.initialised(fx.calls(spark, d), fx.resolvable(spark, d)).select(*PICK).distinct()


@query(f"WITH {GROUPED}, c AS (SELECT DISTINCT '/src/m' || (l_suppkey % 47) || '.c' AS file, 'f' || (l_partkey // 7) AS func FROM lineitem), t AS (SELECT file, func, arg_min(type, ord) AS type FROM d GROUP BY file, func) SELECT c.file, c.func, coalesce(t.type, 'extern') AS type FROM c LEFT JOIN t USING (file, func)")
def call_node_types(spark, d):
    nodes = fx.calls(spark, d).select(F.col("ctx_file").alias("file"), "func")
    return sourcecode.node_types(nodes, sourcecode.definitions(fx.definitions(spark, d)))


@query(f"WITH {REFS}, r AS ({CALL.replace('m AS', 'WITH m AS', 1)}) SELECT to_file, func, match, count(*) AS n FROM r GROUP BY ALL")
def callgraph_by_file(spark, d):
    got = sourcecode.calls(fx.calls(spark, d), fx.resolvable(spark, d)).select(*PICK).distinct()
    return got.groupBy("to_file", "func", "match").agg(F.count("*").alias("n"))


@query(f"""WITH d AS ({DEF}), q AS (SELECT DISTINCT concat_ws('/', l_orderkey, l_linenumber, l_suppkey, l_partkey, l_linestatus) AS decl_id, 'f' || (l_partkey // 7) AS func, CASE WHEN l_linestatus = 'O' THEN 'static' ELSE 'extern' END AS dtype, l_suppkey % 47 AS dcmd FROM lineitem),
j AS (SELECT q.decl_id, q.func, d.file, d.ord, dcmd = cmd AS unit FROM q JOIN d ON q.func = d.func AND type = dtype AND (dcmd = cmd OR (dtype = 'extern' AND dcmd // 5 = cmd // 5))),
k AS (SELECT *, count(*) OVER (PARTITION BY decl_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM j), r AS (SELECT decl_id, func, file FROM k WHERE unit OR before = 0)
SELECT decl_id, func, file AS def_file FROM r UNION ALL SELECT decl_id, func, 'unknown' FROM q WHERE decl_id NOT IN (SELECT decl_id FROM r)""")
def func_declarations(spark, d):
    decls = fx.table(spark, d, "lineitem").selectExpr("concat_ws('/', l_orderkey, l_linenumber, l_suppkey, l_partkey, l_linestatus) AS decl_id", "concat('f', l_partkey div 7) AS func", "CASE WHEN l_linestatus = 'O' THEN 'static' ELSE 'extern' END AS type", "array(l_suppkey % 47) AS cmds", "array((l_suppkey % 47) div 5) AS used").distinct()
    defs = fx.definitions(spark, d).selectExpr("func", "file", "type", "cmd_ids AS cmds", "transform(cmd_ids, c -> c div 5) AS used", "ord")
    return sourcecode.declared(decls, defs)


# -- variables, macros, typedefs -------------------------------------------------------------


@query("SELECT event_id AS id, 'f' || (event_id % 50) AS func FROM events UNION ALL SELECT event_id, 'k' || json_extract_string(props, '$.k') FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def var_initialisers(spark, d):
    init = fx.table(spark, d, "events").select(F.col("event_id").alias("id"), F.expr("""try_parse_json(concat('[{"value": " & f', event_id % 50, '"}, {"value": [{"value": "(& k', coalesce(get_json_object(props, '$.k'), ' '), ')"}]}, {"value": "not a name"}]'))""").alias("init"))
    got = sourcecode.references(sourcecode.leaves(init))
    return got.where("func <> 'k'")


@query("SELECT DISTINCT '/h/' || (p_partkey % 37) AS file, 'M' || (p_partkey % 50) AS name, CAST(p_size AS INT) AS line FROM part")
def macro_defs(spark, d):
    rows = fx.table(spark, d, "part").select(F.expr("concat('\"/h/', p_partkey % 37, '\" M', p_partkey % 50, ' ', p_size)").alias("line"))
    return facts.parse(rows, "define").select("file", F.col("macro").alias("name"), "line").distinct()


@query("WITH x AS (SELECT DISTINCT '/h/' || (p_partkey % 37) AS f FROM part) SELECT DISTINCT CASE WHEN f IS NULL THEN 'unknown' ELSE '/h/' || (l_partkey % 40) END AS def_file, 'M' || (l_partkey % 50) AS name, '/src/m' || (l_suppkey % 47) || '.c' AS exp_file, CAST(l_orderkey % 300 AS INT) AS exp_line, CAST(l_partkey % 50 AS INT) AS def_line FROM lineitem LEFT JOIN x ON f = '/h/' || (l_partkey % 40)")
def macro_expansions(spark, d):
    rows = fx.table(spark, d, "lineitem").selectExpr("concat('/h/', l_partkey % 40) AS def_file", "concat('M', l_partkey % 50) AS name", "concat('/src/m', l_suppkey % 47, '.c') AS exp_file", "cast(l_orderkey % 300 AS int) AS exp_line", "cast(l_partkey % 50 AS int) AS def_line")
    return sourcecode.macro_expansions(rows, fx.table(spark, d, "part").selectExpr("concat('/h/', p_partkey % 37) AS file"))


@query("SELECT '/src/m' || (l_suppkey % 47) || '.c' AS exp_file, 'M' || (l_partkey % 50) AS macro, l_orderkey || '|' || l_linenumber AS args FROM lineitem")
def macro_args(spark, d):
    rows = fx.table(spark, d, "lineitem").select(F.expr("concat('\"/src/m', l_suppkey % 47, '.c\" M', l_partkey % 50, '  actual_arg0=', l_orderkey, ',actual_arg1=', l_linenumber, ',junk')").alias("line"))
    got = facts.parse(rows.select(F.replace("line", F.lit("  "), F.lit(" ")).alias("line")), "expand_args")
    return got.select("exp_file", "macro", F.concat_ws("|", "args").alias("args"))


@query("SELECT DISTINCT source AS scope_file, 'unsigned ' || lang || ' t' || (n_chars % 50) || ';' AS declaration FROM documents")
def typedefs(spark, d):
    rows = fx.table(spark, d, "documents").select(F.expr("concat('\"', source, '\" typedef unsigned ', lang, ' t', n_chars % 50, ';')").alias("line"))
    return facts.parse(rows, "typedefs").distinct()


@query("SELECT '/src/m' || (l_suppkey % 47) || '.c' AS file, 'g' || (l_orderkey % 30) AS func, 'fp' || l_linenumber AS ptr, string_agg(DISTINCT CAST(l_partkey AS VARCHAR), ' ' ORDER BY CAST(l_partkey AS VARCHAR)) AS lines FROM lineitem GROUP BY 1, 2, 3")
def calls_by_ptr(spark, d):
    rows = fx.table(spark, d, "lineitem").selectExpr("concat('/src/m', l_suppkey % 47, '.c') AS file", "concat('g', l_orderkey % 30) AS func", "concat('fp', l_linenumber) AS ptr", "cast(l_partkey AS string) AS line")
    return sourcecode.calls_by_pointer(rows).select("file", "func", "ptr", line("lines"))


# -- cross-references ------------------------------------------------------------------------

SRCLINE = "l AS (SELECT '/d' || doc_id AS path, unnest(string_split(regexp_replace(text, '\\n$', ''), chr(10))) AS t, generate_subscripts(string_split(regexp_replace(text, '\\n$', ''), chr(10)), 1) AS n FROM documents WHERE text <> '')"
WORD = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]+"
TOKEN = SRCLINE + f", w AS (SELECT path, n, regexp_extract_all(t, '{WORD}') AS m, string_split_regex(t, '{WORD}') AS g FROM l), tok AS (SELECT path, CAST(n AS INT) AS line, m[i] AS name, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS INT) AS start FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM w))"


@query(f"WITH {TOKEN} SELECT path, line, count(*) AS n, CAST(sum(start) AS BIGINT) AS starts, CAST(max(start + length(name)) AS INT) AS last, max(name) AS name FROM tok GROUP BY path, line")
def token_positions(spark, d):
    t = text.line_words(fx.source(spark, d).select("path", F.col("line_no").alias("line"), "text")).where(F.size("words") > 0)
    # A line's words are summed where they are found, so a row a line is sorted and sent and not a row a word.
    starts = F.aggregate("words.start", F.lit(0).cast("bigint"), lambda a, x: a + x)
    lines = t.select("path", "line", F.size("words").alias("n"), starts.alias("starts"), F.array_max("words.end").alias("last"), F.array_max("words.name").alias("name"))
    return lines.groupBy("path", "line").agg(F.sum("n").alias("n"), F.sum("starts").alias("starts"), F.max("last").alias("last"), F.max("name").alias("name"))


def places(spark, d):
    """The first word of each line is called there, that of a document's first line defined, that of its second declared."""
    src = fx.source(spark, d)
    word = stored(src.select(F.col("path").alias("file"), F.col("line_no").alias("line"), F.regexp_extract("text", r"(?U)(\w+)", 1).alias("name")).where("name <> ''"))
    defs, decls = word.where("line = 1"), word.where("line = 2")
    occ = crossref.occurrences(crossref.locations(call=word, def_func=defs, decl_func=decls, def_macro=defs, expand=word), src)
    return word, defs, decls, occ


XREF = TOKEN + f""", word AS (SELECT path AS file, CAST(n AS INT) AS line, regexp_extract(t, '{WORD}') AS name FROM l WHERE regexp_extract(t, '{WORD}') <> ''), o AS (SELECT word.file, word.line, word.name, start, CAST(start + length(word.name) AS INT) AS "end" FROM word JOIN tok ON path = word.file AND tok.line = word.line AND tok.name = word.name),
df AS (SELECT * FROM word WHERE line = 1), dc AS (SELECT * FROM word WHERE line = 2)"""


@query(f"""WITH {XREF} SELECT DISTINCT o.file, 'def_func' AS kind, o.line, start, "end", df.file AS to_file, df.line AS to_line FROM o JOIN df USING (file, name)
UNION ALL SELECT DISTINCT o.file, 'decl_func', o.line, start, "end", dc.file, dc.line FROM o JOIN dc USING (file, name)
UNION ALL SELECT DISTINCT o.file, 'def_macro', o.line, start, "end", df.file, df.line FROM o JOIN df USING (file, name)""")
def ref_to(spark, d):
    word, defs, decls, occ = places(spark, d)
    calls = word.select(F.col("file").alias("ctx_file"), F.col("name").alias("func"), F.col("file").alias("to_file"))
    expansions = expanded(word, defs)
    return crossref.ref_to(occ, calls, defs.select("file", F.col("name").alias("func"), "line"), decls.select(F.col("file").alias("def_file"), F.col("name").alias("func"), "file", "line"), expansions)


def expanded(word, defs):
    """Each word that its document's first line defines, as an expansion of a macro of that name."""
    ends = defs.select(F.col("file").alias("f"), F.col("name").alias("m"), F.col("line").alias("def_line"))
    return word.join(ends, (F.col("file") == F.col("f")) & (F.col("name") == F.col("m"))).select(F.col("file").alias("exp_file"), "name", F.col("line").alias("exp_line"), F.col("f").alias("def_file"), "def_line")


@query(f"""WITH {XREF}, c AS (SELECT file, name, string_agg(CAST(line AS VARCHAR), ' ' ORDER BY line) AS ls FROM word GROUP BY file, name), x AS (SELECT w.file, w.name, string_agg(DISTINCT CAST(w.line AS VARCHAR), ' ' ORDER BY CAST(w.line AS VARCHAR)) AS xs FROM word w JOIN df ON w.file = df.file AND w.name = df.name WHERE w.line % 2 = 0 GROUP BY w.file, w.name), one AS (SELECT file, line, name, min(start) AS start FROM o WHERE line = 1 GROUP BY ALL)
SELECT o.file, 'call' AS kind, o.line, start, "end", o.file AS from_file, ls AS from_lines FROM o JOIN c USING (file, name) WHERE o.line <= 2
UNION ALL SELECT one.file, 'expand', line, start, CAST(start + length(one.name) AS INT), CASE WHEN xs IS NULL THEN NULL ELSE one.file END, coalesce(xs, '') FROM one LEFT JOIN x ON one.file = x.file AND one.name = x.name""")
def ref_from(spark, d):
    word, defs, decls, occ = places(spark, d)
    calls = word.select("file", F.col("name").alias("func"), F.col("file").alias("ctx_file"), "line")
    got = crossref.ref_from(occ, calls, expanded(word, defs).where("exp_line % 2 = 0"))
    strings = F.col("from_lines").cast("array<string>")
    return got.withColumn("from_lines", F.concat_ws(" ", F.when(F.col("kind") == "expand", F.array_sort(strings)).otherwise(strings)))


# -- traces and differences ------------------------------------------------------------------

CALLS = "ce AS (SELECT l_suppkey % 100 AS src, 100 + l_partkey % 300 AS dst FROM lineitem UNION SELECT 100 + l_partkey % 300, 400 + l_orderkey % 90 FROM lineitem), ahead AS (SELECT src, dst FROM ce WHERE src = 7 UNION SELECT ce.src, ce.dst FROM ahead JOIN ce ON ahead.dst = ce.src WHERE ahead.dst <> {goal})"
BACK = CALLS + ", back AS (SELECT src, dst FROM ahead WHERE dst = {goal} UNION SELECT a.src, a.dst FROM back JOIN ahead a ON a.dst = back.src)"


def node(spark, n):
    return spark.createDataFrame([(n,)], "node bigint")


@query(f"WITH RECURSIVE {CALLS.format(goal=-1)} SELECT src, dst FROM ahead")
def trace_forward(spark, d):
    return graph.forward(fx.call_edges(spark, d), node(spark, 7))


@query(f"WITH RECURSIVE {BACK.format(goal=433)} SELECT src, dst FROM back")
def trace_between(spark, d):
    return graph.between(fx.call_edges(spark, d), node(spark, 7), node(spark, 433))


@query(f"WITH RECURSIVE {BACK.format(goal=433)}, whole AS (SELECT src, dst FROM ce WHERE src = 7 UNION SELECT ce.src, ce.dst FROM whole JOIN ce ON whole.dst = ce.src) SELECT src, dst FROM whole EXCEPT SELECT src, dst FROM back")
def trace_filtered(spark, d):
    edges = fx.call_edges(spark, d)
    return graph.without_ways(graph.forward(edges, node(spark, 7)), edges, node(spark, 7), node(spark, 433))


DIFF = "a AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_totalprice AS p FROM orders WHERE o_orderpriority NOT LIKE '1%'), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderpriority LIKE '3%' THEN 'X' ELSE o_orderstatus END AS s, o_totalprice AS p FROM orders WHERE o_orderpriority NOT LIKE '2%')"
STATUS = "CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.s IS DISTINCT FROM b.s THEN 'changed' ELSE 'same' END"


def differences(spark, d):
    o = fx.table(spark, d, "orders").selectExpr("o_orderkey AS k", "o_orderstatus AS s", "o_totalprice AS p", "o_orderpriority AS pr")
    return diff.diff(o.where("pr NOT LIKE '1%'"), o.where("pr NOT LIKE '2%'").withColumn("s", F.expr("CASE WHEN pr LIKE '3%' THEN 'X' ELSE s END")), ["k"], ["s", "p"])


@query(f"WITH {DIFF} SELECT coalesce(a.k, b.k) AS k, {STATUS} AS status, CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL AND a.s IS DISTINCT FROM b.s THEN 's' ELSE '' END AS changed FROM a FULL JOIN b ON a.k = b.k")
def diff_attrs(spark, d):
    return differences(spark, d).withColumn("changed", F.concat_ws(" ", "changed"))


@query(f"WITH {DIFF} SELECT {STATUS} AS status, count(*) AS n FROM a FULL JOIN b ON a.k = b.k GROUP BY 1")
def diff_keys(spark, d):
    return diff.summary(differences(spark, d))


@query("SELECT 'warning: ' || event_type || ' in ' || (user_id % 20) AS warning, count(*) AS n FROM events GROUP BY 1")
def warnings_dedup(spark, d):
    return logs.warnings(fx.table(spark, d, "events").select(F.expr("concat('warning: ', event_type, ' in ', user_id % 20)").alias("warning")))


@query(None)
def stream_ingest(spark, d):
    at = folder(spark, "ingest")
    fx.lines(spark, d).select(F.concat_ws("\t", F.col("id").cast("string"), "line").alias("value")).write.text(f"{at}/in")
    ingest.append(ingest.commands(spark, f"{at}/in"), f"{at}/out", f"{at}/state").awaitTermination()
    return spark.read.parquet(f"{at}/out")
