"""A build seen whole: every relation by name, built once from what it requires."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import commands, crossref, diff, graph, sourcecode
from ..sources import facts, logs
from .durable import materialised as checkpoint
from .durable import sized
from .presets import settings

RELATIONS: dict[str, tuple[tuple[str, ...], Callable]] = {}


def relation(*requires: str):
    """Register ``builder(project, *required)`` under its function's name; users may add their own."""

    def put(f):
        RELATIONS[f.__name__] = (requires, f)
        return f

    return put


class Project:
    """``cmds`` is the raw command relation or a log's path; ``fact_lines`` maps kinds to ``(line)`` frames.

    ``files(path, md5, in_storage, content)`` is a snapshot of sources and
    ``deps(id, path)`` the dependencies of compile commands; either may be left
    out, and inputs stand for dependencies then.
    """

    def __init__(self, spark: SparkSession, cmds: DataFrame | str, fact_lines: dict[str, DataFrame] | None = None, files: DataFrame | None = None, deps: DataFrame | None = None, envs: DataFrame | str | None = None, preset: str = "base", **changes) -> None:
        self.spark, self.conf, self.preset = spark, settings(preset, **changes), preset
        self.raw = logs.read_commands(spark, cmds) if isinstance(cmds, str) else cmds
        self.envs = logs.read_envs(spark, envs) if isinstance(envs, str) else envs
        self.fact_lines, self.files, self.deps = fact_lines or {}, files, deps
        self._built: dict[str, DataFrame] = {}

    def order(self, name: str) -> list[str]:
        """What is built before ``name``, and it."""
        if name not in RELATIONS:
            raise KeyError(f"no relation {name}")
        out: list[str] = []
        for r in RELATIONS[name][0]:
            out += [x for x in self.order(r) if x not in out]
        return [*out, name]

    def get(self, name: str) -> DataFrame:
        if name not in self._built:
            requires, build = RELATIONS[name] if name in RELATIONS else self.order(name)
            self._built[name] = build(self, *[self.get(r) for r in requires])
        return self._built[name]

    def where(self, name: str, /, **keys) -> DataFrame:
        """Rows of a relation by key; a list or set of values, and ``None`` or an empty one for all."""
        df = self.get(name)
        for column, values in keys.items():
            if values is not None and not isinstance(values, (list, set)):
                raise TypeError(f"{column} takes a list or a set")
            if values:
                df = df.where(F.col(column).isin(list(values)))
        return df

    def save(self, folder: str, *names: str, by: str | None = None) -> None:
        """Relations as Parquet below ``folder``; ``by`` a column, a folder each of its values."""
        for name in names:
            rows = self.get(name)
            # Rebalanced and not just hashed, so that the rows of a common value are written by several tasks.
            (rows.hint("rebalance", by).write.partitionBy(by) if by else rows.write).mode("overwrite").parquet(f"{folder}/{name}")
        write_meta(self.spark, folder, {"preset": self.preset, "version": VERSION} | {f"relation {n}": by or "" for n in names})

    @staticmethod
    def load(spark: SparkSession, folder: str, name: str, /, **keys) -> DataFrame:
        """Rows of a saved relation by key, as ``where`` takes them; only their folders and row groups are read."""
        df = spark.read.parquet(f"{folder}/{name}")
        for column, values in keys.items():
            if values:
                df = df.where(F.col(column).isin(list(values)))
        return df

    # -- lookups ---------------------------------------------------------------------------

    def raw_cmd(self, id_: int) -> DataFrame:
        return commands.by_id(self.raw, id_)

    def env(self, id_: int, name: str | None = None) -> DataFrame:
        found = self.envs.where(F.col("id") == id_)
        if name is not None:
            found = found.where(F.col("name") == name)
            if found.isEmpty():
                raise RuntimeError(f"command {id_} has no variable {name}")
        return found

    def cmds_by_type(self, kind: str, with_opts: bool = False, with_raw: bool = False) -> DataFrame:
        if kind not in self.conf["types"]:
            raise RuntimeError(f"{kind} commands are not parsed")
        return self.get("cmds").where(F.col("type") == kind).select("id", "type", "cwd", "in", "out", *["opts"] * with_opts, *["command"] * with_raw)

    def cmd_deps(self, kind: str) -> DataFrame:
        """``id, path``: what commands of a compiler depend on; an error for other types."""
        if kind not in commands.COMPILERS:
            raise RuntimeError(f"{kind} commands have no dependencies")
        own = self.get("cmds").where(F.col("type") == kind)
        return (own.select("id", F.explode("in").alias("path")) if self.deps is None else self.deps.join(own.select("id"), "id", "left_semi").select("id", "path")).distinct()

    def compilations_of(self, files: list[str]) -> DataFrame:
        """Compile commands that read one of ``files``."""
        ids = self.where("src_graph", file=files).select(F.col("cmd_id").alias("id")).distinct()
        return commands.compilations(self.get("cmds")).join(ids, "id", "left_semi")

    def root_cmds(self, id_: int) -> DataFrame:
        """All commands that lead to ``id_``, with the number of ways."""
        return self.get("cmd_paths").where(F.col("dst") == id_).select(F.col("src").alias("id"), "paths")

    def leaf_cmds(self, id_: int) -> DataFrame:
        return self.get("cmd_paths").where(F.col("src") == id_).select(F.col("dst").alias("id"), "paths")

    def calls_in(self, files: list[str], add_unknown: bool = True) -> DataFrame:
        """Calls whose caller and callee both lie in ``files``, ``unknown`` beside them if asked for."""
        here = [*files, *["unknown"] * add_unknown]
        return self.get("call_edges").where(F.col("from_file").isin(here) & F.col("to_file").isin(here))

    def macros(self, files: list[str] | None = None, names: list[str] | None = None) -> DataFrame:
        return self.where("macro_defs", file=files, name=names)

    def expansions(self, files: list[str] | None = None, names: list[str] | None = None) -> DataFrame:
        return self.where("macro_exps", def_file=files, name=names)

    def functions_in(self, files: list[str], add_unknown: bool = True) -> DataFrame:
        return self.where("functions", file=[*files, *["unknown"] * add_unknown])

    def functions_like(self, pattern: str) -> DataFrame:
        return self.get("functions").where(F.col("func").rlike(f"(?i){pattern}"))

    def named(self, nodes: DataFrame, names: list[str]) -> DataFrame:
        """The nodes of functions by name; an unknown name is an error."""
        found = checkpoint(nodes.where(F.substring_index("node", ":", -1).isin(names)))
        if missing := set(names) - {r[0] for r in found.select(F.substring_index("node", ":", -1)).distinct().collect()}:
            raise RuntimeError(f"no functions {sorted(missing)}")
        return found

    def trace(self, start: list[str], goal: list[str], without_from: list[str] = (), without_to: list[str] = ()) -> DataFrame:
        """Calls on some way from functions to functions, as ``file:func`` nodes; an unknown name is an error.

        ``without_from`` leaves out what these functions reach, ``without_to``
        the ways to these.
        """
        edges = checkpoint(self.get("call_edges").select(F.concat_ws(":", "from_file", "from_func").alias("src"), F.concat_ws(":", "to_file", "to_func").alias("dst")).distinct())
        nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
        found = graph.between(edges, self.named(nodes, start), self.named(nodes, goal))
        if without_from:
            found = graph.from_nodes(found, edges, self.named(nodes, list(without_from)))
        if without_to:
            found = graph.to_nodes(found, edges, self.named(nodes, list(without_to)))
        return found

    # -- the whole -------------------------------------------------------------------------

    def differences(self, other: Project) -> DataFrame:
        """``relation, key, status``: what ``other`` has more, less or otherwise, relation by relation."""
        out = None
        for name, (keys, attributes) in COMPARED.items():
            flat = lambda p: p.get(name).select(*[F.col(c).cast("string").alias(c) for c in (*keys, *attributes)]).distinct()  # noqa: B023,E731  used at once
            one = flat(self).groupBy(*keys).agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in attributes]) if attributes else flat(self)
            two = flat(other).groupBy(*keys).agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in attributes]) if attributes else flat(other)
            got = diff.diff(one, two, list(keys), list(attributes)).where("status <> 'same'").select(F.lit(name).alias("relation"), F.concat_ws(" ", *keys).alias("key"), "status", F.concat_ws(" ", "changed").alias("changed"))
            out = got if out is None else out.unionByName(got)
        return out


VERSION = "2"
#: Keys and attributes by which two projects' relations are compared.
COMPARED = {
    "pid_parents": (("id",), ("pid",)),
    "cmds": (("id", "type"), ("in", "out", "opts")),
    "cmd_edges": (("src", "dst"), ()),
    "src_graph": (("file", "cmd_id"), ("used_by",)),
    "functions": (("func", "file"), ("line", "type", "signature")),
    "call_edges": (("from_file", "from_func", "to_file", "to_func", "line"), ("match",)),
    "macro_defs": (("file", "name"), ("line",)),
    "macro_exps": (("exp_file", "name", "exp_line"), ("def_file", "def_line")),
    "macro_args": (("exp_file", "name"), ("args",)),
}


def write_meta(spark: SparkSession, folder: str, entries: dict[str, str]) -> None:
    """Add entries to a folder's metadata; the last of a key counts."""
    rows = [(k, str(v), time.time_ns()) for k, v in entries.items()]
    spark.createDataFrame(rows, "key string, value string, at long").coalesce(1).write.mode("append").parquet(f"{folder}/meta")


def read_meta(spark: SparkSession, folder: str) -> dict[str, str]:
    rows = spark.read.parquet(f"{folder}/meta").groupBy("key").agg(F.max_by("value", "at").alias("value"))
    return {r.key: r.value for r in rows.collect()}


def folder_ok(spark: SparkSession, folder: str) -> bool:
    """Whether a saved project's metadata, version and all its relations can be read."""
    try:
        meta = read_meta(spark, folder)
        for key in meta:
            if key.startswith("relation "):
                spark.read.parquet(f"{folder}/{key.removeprefix('relation ')}").limit(1).count()
    except AnalysisException:
        return False
    return meta.get("version") == VERSION


# -- commands --------------------------------------------------------------------------------


@relation()
def pid_parents(p):
    """Each command and the one that started it, where the log has that."""
    own = p.raw.select(F.col("id").alias("pid"))
    return p.raw.select("id", "pid").join(own, "pid", "left_semi").select("id", "pid")


@relation()
def pid_ancestor(p):
    return graph.ancestors(p.raw.select("id", "pid"))


@relation()
def all_cmds(p):
    """Every command of every type, with ``bad``; paths normalised after that is judged."""
    kinds = commands.classified(commands.unwrapped(p.raw), {k: p.conf["which"][k] for k in p.conf["types"]})
    out = commands.parsed(kinds, list(p.conf["types"]))
    judged = commands.bad(out, p.conf["exclude"], p.conf["exclude_in"], p.conf["include"], p.conf["exclude_out"], p.conf["ignore_cc1"])
    return checkpoint(commands.normalized(judged))


@relation("all_cmds")
def cmds(p, every):
    good = every.where("NOT bad").drop("bad")
    if not p.conf["filter_by_pid"]:
        return good
    return checkpoint(graph.without_descendants(good, p.raw.select("id", "pid"), every.where("bad").select("id")))


@relation()
def known_files(p):
    """``p.files`` without contents, which are read once."""
    return checkpoint(p.files.select("path", "md5", "in_storage"))


@relation()
def canonical(p):
    if p.files is None:
        return p.spark.createDataFrame([], "path string, canonical string")
    return checkpoint(commands.canonical(p.get("known_files")))


@relation("canonical")
def renamed(p, canon):
    """The rows of paths whose content another path stands for; all others stay as they are."""
    return sized(canon.join(canon.where("path <> canonical").select("path").distinct(), "path", "left_semi"))


@relation("cmds")
def alternative(p, good):
    """Other paths of a file's content that links and installations made."""
    pairs = good.where("type IN ('LN', 'Install')").select(F.explode(F.arrays_zip(F.col("in").alias("path"), F.col("out").alias("alt"))).alias("x")).select("x.path", "x.alt")
    return commands.alternatives(p.get("known_files"), pairs)


@relation("cmds", "renamed")
def cmd_io(p, good, canon):
    rows = commands.io(good)
    if p.conf["library_dirs"] and p.files is not None:
        libs = commands.archives(good.where("type IN ('CC', 'CXX', 'LD')"), p.get("known_files"), p.conf["library_dirs"])
        rows = rows.union(libs.select("id", "path", F.lit(False))).distinct()
    return checkpoint(commands.with_canonical(rows, canon).select("id", "path", "is_out"))


@relation("cmd_io")
def cmd_edges(p, rows):
    return checkpoint(graph.asof_edges(rows))


@relation("cmd_edges")
def cmd_closure(p, edges):
    return graph.closure(edges)


@relation("cmd_edges")
def cmd_paths(p, edges):
    return graph.path_counts(edges)


@relation("cmds", "renamed", "cmd_closure")
def src_graph(p, good, canon, reach):
    compiled = commands.compilations(good).select("id", F.explode("in").alias("path"))
    if p.deps is not None:
        compiled = p.deps.join(compiled.select("id").distinct(), "id", "left_semi").select("id", "path")
    named = compiled.join(canon, "path", "left").select("id", F.coalesce("canonical", "path").alias("path"))
    return checkpoint(commands.source_graph(named, reach))


@relation("src_graph")
def src_info(p, sg):
    from ..functions import text

    paths = sg.select("file").distinct()
    if p.files is None:
        return paths.withColumn("loc", F.lit(0))
    loc = checkpoint(p.files.select(F.col("path").alias("file"), text.loc(F.col("content")).alias("loc")))
    return paths.join(loc, "file", "left").withColumn("loc", F.coalesce("loc", F.lit(0)))


@relation("cmds")
def cdb(p, good):
    return commands.compilation_database(good, None if p.files is None else p.get("known_files"))


@relation("cmds")
def file_edges(p, good):
    return commands.file_graph(good)


# -- sources ---------------------------------------------------------------------------------


def fact(p, kind: str) -> DataFrame:
    if kind not in p.fact_lines:
        return facts.parse(p.spark.createDataFrame([], "line string"), kind)
    return facts.parse(p.fact_lines[kind], kind, p.get("renamed"))


def with_users(df: DataFrame, cmds_col: str, out: str, sg: DataFrame, key: str) -> DataFrame:
    """``df`` with the commands that use any of its commands' results."""
    users = sg.select(F.col("cmd_id"), F.explode("used_by").alias("by")).distinct()
    by = df.select(key, F.explode(cmds_col).alias("cmd_id")).distinct().join(users, "cmd_id").groupBy(key).agg(F.collect_set("by").alias(out))
    return df.join(by, key, "left").withColumn(out, F.coalesce(out, F.array().cast("array<bigint>")))


@relation()
def raw_definitions(p):
    return checkpoint(sourcecode.definitions(fact(p, "execution").withColumn("ord", F.monotonically_increasing_id())))


@relation("raw_definitions", "src_graph")
def declarations(p, defs, sg):
    """``decl_id, func, def_file, file, line, signature, type, cmds``."""
    decls = checkpoint(fact(p, "declare_func").withColumnRenamed("cmd_ids", "cmds").withColumn("decl_id", F.monotonically_increasing_id()))
    known = with_users(defs.select("func", "file", "type", F.col("compiled_in").alias("cmds"), "ord"), "cmds", "used", sg, "ord")
    to = sourcecode.declared(with_users(decls, "cmds", "used", sg, "decl_id").select("decl_id", "func", "type", "cmds", "used"), known)
    return checkpoint(to.join(decls.drop("func"), "decl_id"))


@relation("raw_definitions", "declarations")
def functions(p, defs, decls):
    """Definitions, exported ones marked, and an ``unknown`` one for names that are only declared."""
    marked = sourcecode.exported(defs, checkpoint(fact(p, "exported")))
    own = decls.groupBy("func", F.col("def_file").alias("file")).agg(F.array_sort(F.collect_set(F.struct("file", "line", "signature", "type"))).alias("declarations"), F.array_distinct(F.flatten(F.collect_list("cmds"))).alias("declared_in"), F.min("type").alias("dtype"))
    both = marked.join(own, ["func", "file"], "full_outer")
    none = F.array().cast("array<bigint>")
    return checkpoint(both.select("func", "file", "line", F.coalesce("type", "dtype").alias("type"), "signature", F.coalesce("compiled_in", none).alias("compiled_in"), F.coalesce("declared_in", none).alias("declared_in"), "declarations", F.coalesce("ord", F.lit(1 << 62)).alias("ord")))


@relation("functions", "src_graph")
def resolvable(p, funcs, sg):
    d = with_users(funcs.where("file <> 'unknown'"), "compiled_in", "d_used", sg, "ord")
    return checkpoint(d.select("func", F.col("file").alias("d_file"), F.col("compiled_in").alias("d_cmds"), "d_used", F.col("declared_in").alias("d_decl"), F.col("type").alias("d_type")))


def refs(p, kind: str, sg: DataFrame) -> DataFrame:
    rows = checkpoint(fact(p, kind).withColumnRenamed("cmd_ids", "cmds").withColumn("ref_id", F.monotonically_increasing_id()))
    return with_users(rows, "cmds", "used", sg, "ref_id")


@relation("resolvable", "src_graph")
def call_edges(p, defs, sg):
    got = sourcecode.calls(refs(p, "call", sg), defs)
    return checkpoint(got.select(F.col("ctx_file").alias("from_file"), F.col("ctx_func").alias("from_func"), "to_file", F.col("func").alias("to_func"), "line", "match", "args"))


@relation("call_edges")
def callgraph(p, edges):
    """``file, func, side, other_file, other_func, lines, match``: each function's calls and callers, adjacency both ways."""
    ends = lambda a, b, side: edges.select(F.col(f"{a}_file").alias("file"), F.col(f"{a}_func").alias("func"), F.lit(side).alias("side"), F.col(f"{b}_file").alias("other_file"), F.col(f"{b}_func").alias("other_func"), "line", "match")
    both = ends("from", "to", "calls").unionByName(ends("to", "from", "called_in"))
    return both.groupBy("file", "func", "side", "other_file", "other_func", "match").agg(F.array_sort(F.collect_list("line")).alias("lines"))


@relation("call_edges", "functions")
def call_nodes(p, edges, funcs):
    ends = edges.select(F.col("from_file").alias("file"), F.col("from_func").alias("func")).union(edges.select("to_file", "to_func"))
    return sourcecode.node_types(ends, funcs)


@relation("resolvable", "src_graph")
def used_in(p, defs, sg):
    got = sourcecode.usages(refs(p, "use_func", sg), defs)
    file_scope = F.col("ctx_func") == "NULL"
    return got.select(F.col("to_file").alias("def_file"), "func", F.when(file_scope, "file").otherwise("func").alias("scope"), "ctx_file", F.when(~file_scope, F.col("ctx_func")).alias("ctx_func"), "line", "match").distinct()


@relation()
def variables(p):
    return fact(p, "init_global").select(F.monotonically_increasing_id().alias("id"), F.col("c_file").alias("path"), F.col("signature").alias("declaration"), "cmd_ids", "type", F.col("init").alias("value"))


@relation("variables", "resolvable", "src_graph")
def used_in_vars(p, vars_, defs, sg):
    kept = checkpoint(vars_)
    names = sourcecode.references(sourcecode.leaves(kept.select("id", F.col("value").alias("init"))))
    rows = checkpoint(names.join(kept.select("id", F.col("path").alias("ctx_file"), F.col("cmd_ids").alias("cmds"), "type"), "id").withColumn("ref_id", F.monotonically_increasing_id()))
    got = sourcecode.initialised(with_users(rows, "cmds", "used", sg, "ref_id"), defs)
    return got.select("func", F.col("to_file").alias("def_file"), "ctx_file").distinct()


@relation()
def macro_defs(p):
    return checkpoint(fact(p, "define").select("file", F.col("macro").alias("name"), "line").distinct())


@relation("macro_defs")
def macro_exps(p, defs):
    return checkpoint(sourcecode.macro_expansions(fact(p, "expand").withColumnRenamed("macro", "name"), defs))


@relation("macro_exps")
def macro_uses(p, exps):
    """Expansions by the file that has them: ``exp_file, def_file, name, lines``, each a line of expansion and one of definition."""
    return exps.groupBy("exp_file", "def_file", "name").agg(F.array_sort(F.collect_set(F.struct("exp_line", "def_line"))).alias("lines"))


@relation()
def macro_args(p):
    rows = fact(p, "expand_args")
    return rows.groupBy("exp_file", F.col("macro").alias("name")).agg(F.collect_list(F.when(F.size("args") > 0, F.col("args"))).alias("args"))


@relation()
def typedefs(p):
    return fact(p, "typedefs").withColumnRenamed("scope_file", "file").distinct()


@relation()
def calls_by_ptr(p):
    return sourcecode.calls_by_pointer(fact(p, "callp").select(F.col("ctx_file").alias("file"), F.col("ctx_func").alias("func"), F.col("func_ptr").alias("ptr"), "line"))


@relation("functions", "declarations", "call_edges", "macro_defs", "macro_exps")
def occurrences(p, funcs, decls, edges, mdefs, mexps):
    name = lambda df, file, line, n: df.select(F.col(file).alias("file"), F.col(line).alias("line"), F.col(n).alias("name"))
    wanted = crossref.locations(def_func=name(funcs, "file", "line", "func"), decl_func=name(decls, "file", "line", "func"), call=name(edges, "from_file", "line", "to_func"), expand=name(mexps, "exp_file", "exp_line", "name"), def_macro=name(mdefs, "file", "line", "name"))
    return crossref.occurrences(wanted, logs.source_lines(p.files))


@relation("occurrences", "call_edges", "functions", "declarations", "macro_exps")
def ref_to(p, occ, edges, funcs, decls, mexps):
    calls = edges.select(F.col("from_file").alias("ctx_file"), F.col("to_func").alias("func"), "to_file")
    return crossref.ref_to(occ, calls, funcs, decls, mexps)


@relation("occurrences", "call_edges", "functions", "declarations", "macro_exps")
def ref_from(p, occ, edges, funcs, decls, mexps):
    defined = edges.select(F.col("to_file").alias("file"), F.col("to_func").alias("func"), F.col("from_file").alias("ctx_file"), "line")
    declared = decls.select(F.col("def_file").alias("__d"), "func", "file").distinct().join(defined.withColumnRenamed("file", "__d"), ["__d", "func"]).select("file", "func", "ctx_file", "line")
    return crossref.ref_from(occ, defined.unionByName(declared).distinct(), mexps.where("def_file <> 'unknown'"))
