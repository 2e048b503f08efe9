"""Paths of inputs, package parts and relationship targets, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliograph.functions.geometry import let

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NUL = "\u0000"


def part_key(name: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(name, UPPER, LOWER)


def folded(path: Column) -> Column:
    """path with `.` and empty segments dropped and `..` resolved; null if it climbs above its root or nothing is left.

    Segments are walked only where the path, without each segment that a `..` follows, still may have some to drop or resolve.
    """
    once = F.regexp_replace(path, r"(^|/)(?!\.{1,2}/)[^/]+/\.\./", "$1")
    return F.when(_plain(path), path).otherwise(let(once, lambda p: F.when(_plain(p), p).otherwise(_walked(path))))


def _plain(path: Column) -> Column:
    """Whether a path surely has no segment that is empty, `.` or `..`."""
    return ~(path.contains("./") | path.contains("//") | path.startswith("/") | path.endswith("/") | path.endswith("/.") | path.endswith("/..") | path.isin("", ".", ".."))


def _walked(path: Column) -> Column:
    segments = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(True).alias("ok"))

    def step(state: Column, s: Column) -> Column:
        kept, up = state["kept"], s == ".."
        return F.struct(
            F.when(up, F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.array_append(kept, s)).alias("kept"),
            (state["ok"] & (~up | (F.size(kept) > 0))).alias("ok"),
        )

    return F.aggregate(segments, start, step, lambda s: F.when(s["ok"] & (F.size(s["kept"]) > 0), F.array_join(s["kept"], "/")))


def input_key(path: Column) -> Column:
    """Normalised relative path of an input; null where it is empty, absolute, has a NUL or climbs above its root."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    bad = (path == "") | slashed.startswith("/") | path.rlike("^[A-Za-z]:") | path.contains(NUL)
    return F.when(~bad, folded(slashed))


def encoded_key(key: Column) -> Column:
    """Percent-encodes %, \\ and : in a key's segments."""
    for plain, code in (("%", "%25"), ("\\", "%5C"), (":", "%3A")):
        key = F.replace(key, F.lit(plain), F.lit(code))
    return key


def part_name(raw: Column) -> Column:
    """Canonical name of a zip entry; null where it is no part name."""
    bad = (raw == "") | raw.contains(NUL) | raw.contains("\\") | raw.startswith("/") | (raw.contains(":") & raw.rlike("^[A-Za-z]:"))
    return F.when(~bad, folded(raw))


def name_fault(raw: Column) -> Column:
    """Why a zip entry's name is no part name, as the diagnostic's code; null where it is one."""
    depth = F.aggregate(F.filter(F.split(raw, "/"), lambda s: ~s.isin("", ".")), F.lit(0), lambda d, s: F.when(d < 0, d).when(s == "..", d - 1).otherwise(d + 1))
    return (
        F.when(raw == "", "empty-part-name").when(raw.contains(NUL), "invalid-part-name").when(raw.contains("\\"), "backslash-in-part-name")
        .when(raw.startswith("/") | raw.rlike("^[A-Za-z]:"), "absolute-part-name").when(depth < 0, "path-traversal").when(depth == 0, "empty-part-name")
    )


def directory(name: Column) -> Column:
    return F.substring(name, F.lit(1), F.length(name) - F.length(F.substring_index(name, "/", -1)))


def is_rels_part(name: Column) -> Column:
    return part_key(name).endswith(".rels") & part_key(name).rlike(r"(^|/)_rels/[^/]*\.rels$")


def source_of_rels(name: Column) -> Column:
    """The part whose relationships the rels part holds; null for the package's."""
    source = F.concat(F.regexp_extract(name, r"^(.*?/)?_rels/[^/]*$", 1), F.regexp_extract(name, r"([^/]*)\.[rR][eE][lL][sS]$", 1))
    return F.when(part_key(name) != "_rels/.rels", source)


def rels_of_source(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("_rels/.rels")).otherwise(F.concat(directory(source), F.lit("_rels/"), F.element_at(F.split(source, "/"), -1), F.lit(".rels")))


def resolved_target(source: Column, target: Column) -> Column:
    """Part name an internal target names; null where it isn't one or climbs above the package's root."""
    odd = target.contains("\\") | target.contains("?") | target.contains("#")
    bad = (target == "") | target.contains(NUL) | odd | (target.contains(":") & target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"))
    absolute = target.startswith("/")
    return F.when(~bad, let(F.when(absolute, target).otherwise(F.concat(F.coalesce(directory(source), F.lit("")), target)), folded))


def is_xml_type(content_type: Column) -> Column:
    media = part_key(F.regexp_replace(F.substring_index(content_type, ";", 1), r"^\s+|\s+$", ""))
    drawing = "application/vnd.openxmlformats-officedocument.vmldrawing"
    return F.coalesce(media.isin("application/xml", "text/xml", drawing) | media.endswith("+xml"), F.lit(False))


def extension(name: Column) -> Column:
    return part_key(F.regexp_extract(F.element_at(F.split(name, "/"), -1), r"\.([^.]*)$", 1))
