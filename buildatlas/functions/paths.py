"""Path arithmetic as column expressions; no file system is touched."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with ``value`` worked out once, however often ``of`` names it; higher-order functions don't share their parts."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def normpath(p: Column) -> Column:
    """POSIX path normalisation: ``.`` and empty parts go, ``..`` takes a part away, two leading slashes stay two."""
    return let(p, lambda q: let(F.when(q.rlike("^//(?!/)"), F.lit("//")).when(q.startswith("/"), F.lit("/")).otherwise(F.lit("")), lambda lead: _normal(q, lead)))


def _normal(p: Column, lead: Column) -> Column:
    parts = F.filter(F.split(p, "/"), lambda c: ~c.isin("", "."))

    def push(stack: Column, part: Column) -> Column:
        top = F.coalesce(F.try_element_at(stack, F.lit(-1)), F.lit(""))
        climbs = (part == "..") & (F.size(stack) > 0) & (top != "..")
        nowhere = (part == "..") & (F.size(stack) == 0) & (lead != "")
        return F.when(climbs, F.slice(stack, F.lit(1), F.size(stack) - 1)).when(nowhere, stack).otherwise(F.array_append(stack, part))

    # Few paths climb; the parts of the others are joined as they are.
    kept = F.when(p.contains(".."), F.aggregate(parts, F.array().cast("array<string>"), push)).otherwise(parts)
    return let(F.concat(lead, F.array_join(kept, "/")), lambda whole: F.when(whole == "", F.lit(".")).otherwise(whole))


def absolute(p: Column, cwd: Column) -> Column:
    """``p`` seen from ``cwd``, normalised; both are trimmed first."""
    return normpath(let(F.trim(p), lambda q: F.when(q.startswith("/"), q).otherwise(F.concat_ws("/", F.trim(cwd), q))))


def windows(p: Column) -> Column:
    """Drive letters become first parts, backslashes slashes."""
    return normpath(F.regexp_replace(F.translate(p, "\\", "/"), "^([A-Za-z]):", "/$1"))


def basename(p: Column) -> Column:
    return F.substring_index(p, "/", -1)


def dirname(p: Column) -> Column:
    cut = F.regexp_extract(p, "^(.*)/[^/]*$", 1)
    return F.when(p.rlike("^/[^/]*$"), F.lit("/")).otherwise(cut)


def extension(p: Column) -> Column:
    """From the last dot of the name, if something other than dots stands before it."""
    return F.regexp_extract(basename(p), r"^\.*[^.].*?(\.[^.]*)$", 1)


def stem(p: Column) -> Column:
    return F.substring(basename(p), F.lit(1), F.length(basename(p)) - F.length(extension(p)))


def stored(p: Column, store: str) -> Column:
    """Where the content store keeps a file."""
    return F.concat(F.lit(store.rstrip("/") + "/"), F.regexp_replace(normpath(p), "^/+", ""))


def shown(p: Column, base: Column) -> Column:
    """Relative to ``base`` where it lies below."""
    return F.when(p.startswith(F.concat(base, F.lit("/"))), F.substring(p, F.length(base) + 2, F.length(p))).otherwise(p)


def digest(p: Column) -> Column:
    return F.md5(p.cast("binary"))
