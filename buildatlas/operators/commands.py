"""Command analytics: classification, parsing, filters, paths, source graph, compilation database."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import argv, paths
from ..functions.option_tables import PREPROCESS_ONLY
from ..plans.durable import materialised

COMPILERS = ("CC", "CXX", "CL")
SOURCES = (".c", ".i", ".C", ".cc", ".cpp", ".cxx")


def any_of(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def by_which(cmds: DataFrame, patterns: list[str]) -> DataFrame:
    """Commands whose executable matches one of the patterns; none without patterns."""
    return cmds.where(F.col("which").rlike(any_of(patterns)) if patterns else F.lit(False))


def classified(cmds: DataFrame, kinds: dict[str, list[str]]) -> DataFrame:
    """A row for each type a command has, in one scan."""
    types = F.array_compact(F.array(*[F.when(F.col("which").rlike(any_of(p)), F.lit(t)) for t, p in kinds.items() if p]))
    return cmds.select("*", F.explode(types).alias("type"))


def stats(cmds: DataFrame) -> DataFrame:
    return cmds.groupBy("which").agg(F.count("*").alias("n"))


def stats_total(cmds: DataFrame) -> DataFrame:
    """Counts with the total in a row whose executable is null."""
    return cmds.rollup("which").agg(F.count("*").alias("n"))


def ends(cmds: DataFrame) -> DataFrame:
    """First and last id and the build directory, which is the first command's."""
    return cmds.agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.min_by("cwd", "id").alias("build_dir"), F.max_by("which", "id").alias("last_which"))


def by_id(cmds: DataFrame, id_: int) -> DataFrame:
    """One command; an unknown id is an error."""
    found = cmds.where(F.col("id") == id_)
    if found.isEmpty():
        raise RuntimeError(f"no command {id_}")
    return found


# -- parsers: raw command to in, out, opts --------------------------------------------------


def shape(kind: str, command: Column, cwd: Column, is_dir=None) -> Column:
    """``struct<in, out, opts>`` of a command of ``kind``.

    ``is_dir`` tells from a path whether it is a directory; only LN and Install
    ask, and take a trailing slash as a sign without it.
    """
    is_dir = is_dir or (lambda p: p.endswith("/"))
    none = argv.empty()
    rest = F.slice(command, F.lit(2), F.greatest(F.size(command) - 1, F.lit(0)))
    struct = lambda i, o, p: F.struct(i.alias("in"), o.alias("out"), p.alias("opts"))
    if kind == "AR":
        return struct(F.slice(rest, F.lit(3), F.greatest(F.size(rest) - 2, F.lit(0))), F.slice(rest, 2, 1), F.slice(rest, 1, 1))
    if kind == "MV":
        plain = F.filter(rest, lambda t: ~t.startswith("-"))
        return struct(F.slice(plain, 1, 1), F.slice(plain, F.lit(2), F.greatest(F.size(plain) - 1, F.lit(0))), F.filter(rest, lambda t: t.startswith("-")))
    if kind in ("LN", "Install"):
        return linked(kind, command, rest, cwd, is_dir)
    if kind in ("CL", "Link"):
        return microsoft(kind, rest, cwd)
    if kind == "Copy":
        at = F.array_position(F.transform(rest, F.lower), "copy")
        args = F.filter(F.slice(rest, (at + 1).cast("int"), F.size(rest)), lambda t: ~t.rlike("^/|^[0-9]?>|^&"))
        args = F.when(at > 0, args).otherwise(none)
        target = F.element_at(args, 2)
        to = F.when(is_dir(target), F.concat_ws("/", F.regexp_replace(target, "/+$", ""), paths.basename(F.element_at(args, 1)))).otherwise(target)
        return F.when(F.size(args) >= 2, struct(F.slice(args, 1, 1), F.array(to), none)).otherwise(struct(none, none, none))
    if kind == "Objcopy":
        to = lambda i: F.when(F.size(i) > 1, F.slice(i, 2, 1)).otherwise(i)
        return paths.let(argv.fold(command, kind), lambda f: struct(F.slice(f["in"], 1, 1), to(f["in"]), f["opts"]))
    if kind in ("CC", "CXX"):
        implied = lambda f: F.transform(f["in"], lambda p: F.concat(cwd, F.lit("/"), paths.stem(p), F.lit(".o")))
        alone = lambda f: F.array_contains(f["opts"], "-c") & (F.size(f["out"]) == 0)
        return paths.let(argv.fold(command, kind), lambda f: struct(f["in"], F.when(alone(f), implied(f)).otherwise(f["out"]), f["opts"]))
    return argv.fold(command, kind)


def linked(kind: str, command: Column, rest: Column, cwd: Column, is_dir) -> Column:
    """LN and Install: pairs of a file and its place, whatever the shape of the command."""
    joined = F.regexp_extract(F.array_join(F.filter(rest, lambda t: t.rlike("^(?:--target-directory=|-t.)")), " "), r"(?:--target-directory=|-t)(\S+)", 1)
    folded = argv.fold(F.transform(command, lambda t: F.when(t == "--target-directory", "-t").otherwise(t)), "Install")
    spaced = F.array_position(rest, "-t")
    target = paths.let(joined, lambda j: F.when(j != "", j).when(spaced > 0, F.get(rest, spaced.cast("int"))))

    def placed(names: Column, opts: Column, target: Column) -> Column:
        last = F.try_element_at(names, F.lit(-1))
        into = F.when(target.isNotNull(), target).when((F.size(names) > 1) & (is_dir(last) | (F.size(names) > 2)), last).when(F.size(names) == 1, cwd if kind == "LN" else F.lit(None))
        files = F.when(target.isNotNull() | (F.size(names) == 1), names).otherwise(F.slice(names, F.lit(1), F.greatest(F.size(names) - 1, F.lit(0))))
        under = lambda i, fs: F.transform(fs, lambda p: F.concat(F.regexp_replace(i, "/+$", ""), F.lit("/"), paths.basename(p)))
        both = lambda i, fs: F.struct(fs.alias("in"), F.when(i.isNotNull(), under(i, fs)).otherwise(F.transform(fs, lambda p: last)).alias("out"), opts.alias("opts"))
        return paths.let(into, lambda i: paths.let(files, lambda fs: both(i, fs)))

    return paths.let(folded, lambda f: paths.let(target, lambda t: placed(f["in"], f["opts"], t)))


def microsoft(kind: str, rest: Column, cwd: Column) -> Column:
    """cl.exe and link.exe: options begin with a slash or a dash; outputs are named by /Fo or /out."""
    head = F.when(F.array_position(rest, "/link") > 0, F.slice(rest, F.lit(1), (F.array_position(rest, "/link") - 1).cast("int"))).otherwise(rest)
    option = lambda t: t.rlike("^[/-]")
    tagged = F.transform(F.filter(head, lambda t: t.rlike("^[/-]T[cp].")), lambda t: F.substring(t, F.lit(4), F.length(t)))
    inputs = F.concat(F.filter(head, lambda t: ~option(t)), tagged)
    opts = F.filter(head, lambda t: option(t) & ~t.rlike("(?i)^[/-](?:Fo|out:)"))
    named = F.try_element_at(F.filter(head, lambda t: t.rlike("^[/-]Fo." if kind == "CL" else "(?i)^[/-]out:")), F.lit(1))
    named = F.regexp_replace(named, "^[/-](?:Fo|(?i:out:))", "")
    if kind == "Link":
        return F.struct(inputs.alias("in"), F.array_compact(F.array(named)).alias("out"), opts.alias("opts"))
    each = lambda where: F.transform(inputs, lambda p: F.concat(where, F.lit("/"), paths.stem(F.translate(p, "\\", "/")), F.lit(".obj")))
    out = F.when(F.arrays_overlap(opts, F.array(*[F.lit(o) for o in ("/E", "-E", "/EP", "-EP")])), argv.empty())
    out = out.when(F.arrays_overlap(opts, F.array(F.lit("/P"), F.lit("-P"))), F.transform(inputs, lambda p: F.concat(cwd, F.lit("/"), paths.stem(F.translate(p, "\\", "/")), F.lit(".i"))))
    out = out.when(named.rlike(r"[/\\]$"), each(F.regexp_replace(named, r"[/\\]+$", ""))).when(named.isNotNull(), F.array(F.when(paths.extension(named) == "", F.concat(named, F.lit(".obj"))).otherwise(named))).otherwise(each(cwd))
    return F.struct(inputs.alias("in"), out.alias("out"), opts.alias("opts"))


def unwrapped(cmds: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``ccache`` commands as the compiler behind them; ``known(name, path)`` finds it, else the name stands."""
    wrapped = F.col("which").rlike("(^|/)ccache$")
    argv_ = F.when(wrapped, F.filter(F.slice("command", F.lit(2), F.greatest(F.size("command") - 1, F.lit(0))), lambda t: t != "--ccache-skip")).otherwise(F.col("command"))
    out = cmds.withColumn("command", argv_).withColumn("which", F.when(wrapped, F.try_element_at("command", F.lit(1))).otherwise(F.col("which")))
    if known is not None:
        out = out.join(known.select(F.col("name").alias("which"), F.col("path").alias("__p")), "which", "left").withColumn("which", F.coalesce("__p", "which")).drop("__p")
    return out


def parsed(cmds: DataFrame, kind: str | list[str], is_dir=None) -> DataFrame:
    """``id, pid, cwd, type, in, out, opts, command``; the executable stands first in ``command``.

    With a list of kinds the commands carry their ``type``, and one scan parses
    them all.
    """
    if isinstance(kind, str):
        cmds, kinds = cmds.withColumn("type", F.lit(kind)), [kind]
    else:
        kinds = kind
    first = F.concat(F.array(paths.normpath(F.col("which"))), F.slice("command", F.lit(2), F.greatest(F.size("command") - 1, F.lit(0))))
    parts = None
    for k in kinds:
        own = shape(k, F.col("command"), F.col("cwd"), is_dir)
        parts = F.when(F.col("type") == k, own) if parts is None else parts.when(F.col("type") == k, own)
    # inline() keeps the fold from being copied into every later use of its parts.
    got = cmds.select("id", "pid", "cwd", "type", first.alias("__first"), F.inline(F.array(parts)))
    return got.select("id", "pid", "cwd", "type", "in", "out", "opts", F.col("__first").alias("command"))


def normalized(cmds: DataFrame) -> DataFrame:
    """Inputs and outputs seen from the working directory."""
    full = lambda c: F.transform(c, lambda p: paths.absolute(p, F.col("cwd")))
    seen = F.struct(full("in").alias("in"), full("out").alias("out"), paths.normpath(F.col("cwd")).alias("cwd"))
    rest = [c for c in cmds.columns if c not in ("in", "out", "cwd")]
    return cmds.select(*rest, F.inline(F.array(seen))).select(*cmds.columns)


def bad(cmds: DataFrame, exclude: list[str] = (), exclude_in: list[str] = (), include: list[str] = (), exclude_out: list[str] = (), ignore_cc1: bool = True) -> DataFrame:
    """``cmds`` with ``bad``: an excluded input or output, an input not included, a bare cc1, or nothing to do."""
    full = lambda p: F.when(p.startswith("/"), p).otherwise(F.concat_ws("/", "cwd", p))
    tests = [F.size("in") + F.size("out") == 0]
    for column, patterns in (("in", [*exclude, *exclude_in]), ("out", [*exclude, *exclude_out])):
        if patterns:
            regex = any_of(patterns)
            tests.append(F.exists(column, lambda p: full(p).rlike(regex)))  # noqa: B023  used at once
    if include:
        tests.append(F.exists("in", lambda p: ~full(p).rlike(any_of(include))))
    if ignore_cc1:
        tests.append(F.col("type").isin("CC", "CXX") & (F.array_contains("opts", "-cc1") | F.coalesce(F.try_element_at("command", F.lit(1)).endswith("cc1"), F.lit(False))))
    return cmds.withColumn("bad", reduce(lambda a, b: a | b, tests))


def compilations(cmds: DataFrame) -> DataFrame:
    """Commands that compile sources, with other inputs left out."""
    source = lambda p: paths.extension(p).isin(*SOURCES)
    only = F.lit(False)
    for kind, options in PREPROCESS_ONLY.items():
        only = only | ((F.col("type") == kind) & F.arrays_overlap("opts", F.array(*[F.lit(o) for o in options])))
    return cmds.where(F.col("type").isin(*COMPILERS) & F.exists("in", source) & ~only).withColumn("in", F.filter("in", source))


def archives(cmds: DataFrame, files: DataFrame, defaults: list[str]) -> DataFrame:
    """``id, path`` of the libraries that ``-l`` options name: the first that ``files(path)`` has, by directory and suffix.

    Directories of ``-L`` lie below that of ``-syslibroot`` if they are absolute.
    """
    values = lambda names: F.regexp_extract_all(F.concat_ws(" ", "opts"), F.lit(rf"(?:^|\s)(?:{names})(\S+)"), F.lit(1))
    root = F.try_element_at(values(r"-syslibroot[ =]"), F.lit(1))
    rooted = lambda d: F.when(root.isNotNull() & d.startswith("/"), F.concat(root, d)).otherwise(d)
    dirs = F.concat(F.array(*[F.lit(d) for d in defaults]), F.transform(values("-L ?|--library-path[= ]"), rooted))
    asked = cmds.select("id", "cwd", F.explode(F.array_distinct(values("-l ?|--library[= ]"))).alias("lib"), dirs.alias("dirs")).select("id", "cwd", "lib", F.posexplode("dirs").alias("d", "dir"))
    tries = F.when(F.col("lib").startswith(":"), F.array(F.expr("substring(lib, 2)"))).otherwise(F.array(*[F.concat(F.lit(a), F.col("lib"), F.lit(z)) for a, z in (("lib", ".dylib"), ("lib", ".tbd"), ("lib", ".so"), ("lib", ".a"), ("", ".a"))]))
    tried = asked.select("id", "lib", "d", "dir", "cwd", F.posexplode(tries).alias("s", "name")).withColumn("path", paths.absolute(F.concat_ws("/", "dir", "name"), F.col("cwd")))
    return tried.join(files.select("path").distinct(), "path").groupBy("id", "lib").agg(F.min_by("path", F.struct("d", "s")).alias("path")).select("id", "path").distinct()


def analysable(cmds: DataFrame) -> DataFrame:
    """Commands that an analyser of C can take: inputs, and no standard input, null device or assembler source among them."""
    return cmds.where((F.size("in") > 0) & ~F.exists("in", lambda p: p.isin("-", "/dev/null") | p.rlike(r"\.[sS]$")))


# -- relations among commands and files ------------------------------------------------------


def io(cmds: DataFrame) -> DataFrame:
    """``id, path, is_out``."""
    side = lambda c, out: cmds.select("id", F.explode(c).alias("path"), F.lit(out).alias("is_out"))
    return side("in", False).union(side("out", True)).distinct()


def alternatives(files: DataFrame, pairs: DataFrame) -> DataFrame:
    """Symmetric ``path, alt_path`` among ``pairs(path, alt)`` whose files exist with equal ``md5``."""
    known = files.select("path", "md5").where("md5 IS NOT NULL").distinct()
    other = known.select(F.col("path").alias("alt"), F.col("md5").alias("m"))
    a = pairs.join(known, "path").join(other, "alt").where("md5 = m AND path <> alt").select("path", F.col("alt").alias("alt_path"))
    return a.union(a.select(F.col("alt_path").alias("path"), F.col("path").alias("alt_path"))).distinct()


def content_classes(files: DataFrame) -> DataFrame:
    """``path, same_as, n`` of paths whose content stands elsewhere too: the class by its smallest path, never all pairs."""
    classes = files.groupBy("md5").agg(F.min("path").alias("same_as"), F.count_distinct("path").alias("n")).where("n > 1")
    return files.select("path", "md5").distinct().join(classes, "md5").select("path", "same_as", "n")


def canonical(files: DataFrame) -> DataFrame:
    """``path, canonical`` of ``files(path, md5, in_storage)``: the largest stored path of equal content, else the largest.

    One aggregate per content, so a content that many paths share makes a row
    a path and never their pairs.
    """
    best = F.coalesce(F.max(F.when(F.col("in_storage"), F.col("path"))), F.max("path"))
    return files.join(files.groupBy("md5").agg(best.alias("canonical")), "md5").select("path", "canonical").distinct()


def with_canonical(cmd_io: DataFrame, canon: DataFrame) -> DataFrame:
    return cmd_io.join(canon, "path", "left").withColumn("path", F.coalesce("canonical", "path")).drop("canonical").distinct()


def source_graph(compiled: DataFrame, reach: DataFrame) -> DataFrame:
    """``(id, path)`` of compilations and ``(src, dst)`` closure to ``file, cmd_id, used_by``; the array is sorted."""
    used = reach.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("dst")).alias("used_by"))
    return compiled.select("id", "path").distinct().join(used, "id", "left").select(F.col("path").alias("file"), F.col("id").alias("cmd_id"), F.coalesce("used_by", F.array().cast("array<bigint>")).alias("used_by"))


def files_linked(pairs: DataFrame, src_graph: DataFrame) -> DataFrame:
    """Those of ``pairs(a, b)`` of compile commands that some command uses both of."""
    # Kept, for it is joined twice; a command's users stand beside each of its files.
    users = materialised(src_graph.select("cmd_id", F.explode("used_by").alias("by")).distinct())
    mine = pairs.select("a", "b").distinct().join(users.withColumnRenamed("cmd_id", "a"), "a")
    return mine.join(users.withColumnRenamed("cmd_id", "b"), ["b", "by"], "left_semi").select("a", "b").distinct()


def compilation_database(cmds: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``id, directory, arguments, file, output``: with ``-c`` each input has its own output."""
    rows = compilations(cmds).select("id", F.col("cwd").alias("directory"), F.col("command").alias("arguments"), "opts", "out", F.posexplode("in").alias("at", "file"))
    output = F.when(F.array_contains("opts", "-c"), F.get("out", F.col("at"))).otherwise(F.get("out", F.lit(0)))
    rows = rows.select("id", "directory", "arguments", "file", output.alias("output"))
    return rows if known is None else rows.join(known.select(F.col("path").alias("file")).distinct(), "file", "left_semi")


def file_graph(cmds: DataFrame, include: str | None = None, exclude: str | None = None, without: tuple[str, ...] = ()) -> DataFrame:
    """Edges ``src, dst, type`` from inputs to outputs; with ``-c`` pairwise."""
    rows = cmds.where(~F.col("type").isin(*without)) if without else cmds
    pairwise = F.array_contains("opts", "-c") & (F.size("in") == F.size("out"))
    paired = rows.where(pairwise).select("type", F.explode(F.arrays_zip(F.col("in").alias("s"), F.col("out").alias("d"))).alias("p")).select(F.col("p.s").alias("src"), F.col("p.d").alias("dst"), "type")
    crossed = rows.where(~pairwise).select("type", "out", F.explode("in").alias("src")).select("src", F.explode("out").alias("dst"), "type")
    edges = paired.unionByName(crossed)
    for pattern, wanted in ((include, True), (exclude, False)):
        if pattern:
            for c in ("src", "dst"):
                edges = edges.where(F.col(c).rlike(pattern) == wanted)
    return edges.distinct()


def database_json(db: DataFrame) -> DataFrame:
    """``id, line``: the entries of a compilation database as JSON objects."""
    return db.select("id", F.to_json(F.struct("directory", "arguments", "file", "output")).alias("line"))


def dependencies(rules: DataFrame, cmds: DataFrame, with_inputs: bool = False) -> DataFrame:
    """``id, path``: what compile commands depend on, from ``rules(id, deps)`` of each of their inputs, normalised and distinct.

    ``with_inputs`` adds the inputs themselves, which Microsoft's compiler
    doesn't list.
    """
    named = rules.select("id", F.explode("deps").alias("path")).join(cmds.select("id", "cwd"), "id").select("id", paths.absolute(F.col("path"), F.col("cwd")).alias("path"))
    if with_inputs:
        named = named.unionByName(cmds.select("id", "cwd", F.explode("in").alias("path")).select("id", paths.absolute(F.col("path"), F.col("cwd")).alias("path")))
    return named.distinct()
