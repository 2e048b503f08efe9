"""Relationships, presentation order and part chains of packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.functions import canonical, paths
from foliograph.operators import relational
from foliograph.plans.work import keep

#: Bases of relationship types, transitional and strict, and the media type outside them.
BASES = ("http://schemas.openxmlformats.org/officeDocument/2006/relationships/", "http://purl.oclc.org/ooxml/officeDocument/relationships/")
MEDIA_TYPE = "http://schemas.microsoft.com/office/2007/relationships/media"
MEDIA = {"audio": ("audio", "audioFile"), "image": ("image",), "media": ("media",), "video": ("video", "videoFile")}


def is_type(column: Column, *names: str) -> Column:
    return column.isin(*[b + n for b in BASES for n in names])


def media_kind(column: Column) -> Column:
    out = F.when(column == MEDIA_TYPE, "media")
    for kind, names in MEDIA.items():
        out = out.when(is_type(column, *names), kind)
    return out


def note(when: Column, code: str | Column, part: Column, message: str | Column, rel_id: Column | None = None) -> Column:
    """A diagnostic where `when` holds, else null."""
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.when(when, F.struct(text(code).alias("code"), part.alias("part"), (F.lit(None).cast("string") if rel_id is None else rel_id).alias("rel_id"), text(message).alias("message")))


def said(rows: DataFrame, *notes: Column) -> DataFrame:
    """input_key, code, part, rel_id, message of the notes that rows have."""
    return rows.select("input_key", F.explode(F.array_compact(F.array(*notes))).alias("d")).select("input_key", "d.*")


def _unlike(when: Column, part: Column, root: Column) -> Column:
    """Parts that can't be read, or have another root than they must."""
    return note(when, F.when(root.isNull(), "malformed-xml").otherwise("invalid-presentation"), part, F.when(root.isNull(), "The part can't be read.").otherwise("The part has an unexpected root element."))


def entries(parts: DataFrame) -> DataFrame:
    """What is wrong with entries by themselves, and with the parts of relationships as XML."""
    part, rels = F.col("part_name"), F.col("alone") & paths.is_rels_part(F.col("part_name"))
    bad = "invalid-relationships"
    return said(
        parts.where("zip_error IS NULL"),
        note(part.isNull(), paths.name_fault(F.col("raw_name")), F.col("raw_name"), "The entry's name is no part name."),
        note(part.isNotNull() & ~F.col("alone") & ~F.col("raw_name").endswith("/"), "ambiguous-part-name", F.col("part_key"), "Several entries have this name."),
        note(F.col("denied").isNotNull(), F.col("denied"), part, "The entry is over a limit."),
        note(F.col("read_error").isNotNull(), F.col("read_error"), part, "The entry can't be read."),
        note(rels & F.col("root").isNull(), bad, part, "The relationships can't be read."),
        note(rels & F.col("xml.code").isNotNull(), "malformed-xml", part, F.col("xml.message")),
        note(rels & (F.col("root") != "rel:Relationships"), bad, part, "The root element isn't that of relationships."),
    )


def relationships(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges of all packages and what is wrong with them.

    The first edge of an id stays. target_exists: whether exactly one entry has the target's key; null if external.
    """
    files = parts.where(F.col("alone") & (F.col("root") == "rel:Relationships") & paths.is_rels_part(F.col("part_name")))
    ids = F.transform("rels", lambda r: r["id"])
    files = files.select("input_key", F.col("part_name").alias("rels_part"), paths.source_of_rels(F.col("part_name")).alias("source_part"), "rels", (F.size(F.array_distinct(ids)) == F.size(ids)).alias("apart"))
    rows = files.select("input_key", "rels_part", "source_part", "apart", F.posexplode("rels").alias("pos", "r")).select("input_key", "rels_part", "source_part", "apart", "pos", "r.*")
    incomplete = F.col("id").isNull() | F.col("type").isNull() | F.col("target").isNull()
    # only parts in which an id repeats are grouped by it
    first = rows.where(F.col("apart") & ~incomplete).withColumn("repeats", F.lit(0).cast("long")).unionByName(relational.first_of_few(rows.where(~F.col("apart") & ~incomplete), ["input_key", "rels_part", "id"], ["pos"])).drop("apart")
    internal = ~F.coalesce(F.col("mode") == "External", F.lit(False))
    edges = first.withColumn("internal", internal).withColumn("resolved", F.when(internal, paths.resolved_target(F.coalesce("source_part", F.lit("")), F.col("target"))))
    there = parts.where("alone").select("input_key", F.col("part_key").alias("target_key"), F.col("part_name").alias("target_part"), F.col("root").alias("target_root"), F.lit(True).alias("found"))
    edges = edges.withColumn("target_key", paths.part_key(F.col("resolved"))).join(there, ["input_key", "target_key"], "left")
    edges = keep(edges.withColumn("target_exists", F.when(F.col("internal"), F.coalesce("found", F.lit(False)))).drop("found"), "edges")
    part, rel = F.col("rels_part"), F.col("id")
    diagnostics = said(edges, note(F.col("repeats") > 0, "duplicate-relationship-id", part, "The relationship id repeats.", rel), note(F.col("internal") & F.col("resolved").isNull(), "invalid-relationship-target", part, "The target is no part name.", rel))
    return edges.drop("repeats"), diagnostics.unionByName(said(rows.where(incomplete), note(F.lit(True), "invalid-relationships", part, "A relationship lacks an id, type or target.", rel)))


def content_types(parts: DataFrame, packages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """input_key, part_name, content_type, is_xml of each part, by its override, else its extension's default; and what is wrong.

    packages: input_key. The first declaration of a part or an extension stays.
    """
    name, code = F.lit("[Content_Types].xml"), "invalid-content-types"
    own = packages.join(parts.where("alone AND part_key = '[content_types].xml'").select("input_key", F.lit(True).alias("found"), "root", "xml", "types"), "input_key", "left")
    rows = own.where("root = 'ct:Types'").select("input_key", F.posexplode("types").alias("pos", "t")).select("input_key", "pos", "t.*")
    blank = lambda c: F.col(c).isNull() | (canonical.trim_all(F.col(c)) == "")
    override = F.col("kind") == "Override"
    target = paths.part_key(F.when(override, paths.part_name(F.regexp_replace("key", "^/", ""))).otherwise(F.col("key")))
    named = rows.withColumn("empty", blank("key") | blank("content_type")).withColumn("target", F.when(~F.col("empty"), target))
    first = keep(relational.first_of_few(named.where("target IS NOT NULL"), ["input_key", "kind", "target"], ["pos"]), "types")
    diagnostics = said(
        own, note(F.col("found").isNull(), "missing-content-types", name, "The package declares no content types."), note(F.col("found") & F.col("root").isNull(), code, name, "The content types can't be read."),
        note(F.col("xml.code").isNotNull(), "malformed-xml", name, F.col("xml.message")), note(F.col("root") != "ct:Types", code, name, "The root element isn't that of content types."),
    )
    odd = F.when(F.col("empty"), F.concat(F.lit("A declaration lacks a value: "), "kind")).otherwise(F.concat(F.lit("No part can have the name "), canonical.json_text(F.col("key"))))
    diagnostics = diagnostics.unionByName(said(named, note(F.col("target").isNull(), code, name, odd)))
    diagnostics = diagnostics.unionByName(said(first, note(F.col("repeats") > 0, "duplicate-content-type", name, F.concat(F.lit("Declared several times: "), canonical.json_text(F.col("target"))))))
    each = parts.where("part_key IS NOT NULL").select("input_key", "part_name", "part_key", paths.extension(F.col("part_name")).alias("extension"))
    side = lambda kind, key: first.where(F.col("kind") == kind).select("input_key", F.col("target").alias(key), "content_type")
    typed = relational.override_or_default(each, side("Override", "part_key"), side("Default", "extension"), ["input_key", "part_key"], ["input_key", "extension"], "content_type")
    return typed.select("input_key", "part_name", "content_type", paths.is_xml_type(F.col("content_type")).alias("is_xml")), diagnostics


def hop(rows: DataFrame, edges: DataFrame, source: str, out: str, kind: str, root: str) -> DataFrame:
    """Adds out: the part that source's first edge of the kind names, if it is internal, there, and has that root; else null, and why to `said`."""
    typed = edges.where(is_type(F.col("type"), kind))
    fields = F.struct("id", "internal", "rels_part", "target_exists", "target_part", "target_root")
    first = typed.groupBy("input_key", F.col("source_part").alias(source)).agg(F.min_by(fields, "pos").alias("e"))
    found = rows.join(first, ["input_key", source], "left")
    inside, there, e = F.coalesce("e.internal", F.lit(False)), F.coalesce("e.target_exists", F.lit(False)), F.col("e")
    good = F.coalesce(inside & there & (e["target_root"] == root), F.lit(False))
    start = F.col(source).isNotNull()
    why = (
        note(start & ~inside, "missing-presentation-relationship", F.col(source), f"The part names no {kind}."), note(start & inside & ~there, "missing-presentation-target", e["rels_part"], f"The {kind} isn't there.", e["id"]),
        _unlike(start & inside & there & ~good, e["target_part"], e["target_root"]),
    )
    return found.withColumns({out: F.when(good, e["target_part"]), "said": F.concat("said", F.array_compact(F.array(*why)))}).drop("e")


def slides(edges: DataFrame, parts: DataFrame, packages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Slides in the order of the presentation's list, with layout, master and theme parts; number starts at 1. And what is wrong.

    Slides that can't be reached or read keep their place, with a null part. A presentation without slides has one row of
    null number; a package (input_key) without a presentation has none.
    """
    office = edges.where(F.col("source_part").isNull() & is_type(F.col("type"), "officeDocument"))
    office = office.groupBy("input_key").agg(F.min_by(F.struct("id", "internal", "target_key", "target_exists"), "pos").alias("e"))
    facts = parts.where("alone").select("input_key", F.col("part_key").alias("key"), F.col("part_name").alias("presentation"), "root", "size", F.col("styles").alias("default_styles"), "slide_ids")
    start = packages.join(office, "input_key", "left").withColumn("key", F.col("e.target_key")).join(facts, ["input_key", "key"], "left")
    inside, there, root, top, of = F.coalesce("e.internal", F.lit(False)), F.coalesce("e.target_exists", F.lit(False)), F.col("root"), F.lit("_rels/.rels"), F.col("presentation")
    is_one = F.coalesce(root == "p:presentation", F.lit(False))
    sized = F.coalesce((F.col("size.cx") > 0) & (F.col("size.cy") > 0), F.lit(False))
    start = start.withColumn("said", F.array_compact(F.array(
        note(~inside, "missing-office-document", top, "No presentation can be reached."), note(inside & ~there, "missing-presentation-part", top, "The presentation isn't there.", F.col("e.id")),
        _unlike(inside & there & ~is_one, of, root), note(inside & there & is_one & ~sized, "invalid-presentation", of, "The slides have no valid size."),
    )))
    start = keep(start.withColumn("usable", inside & there & is_one), "presentations")
    listed = start.where("usable").select("input_key", "presentation", "size", "default_styles", F.posexplode_outer("slide_ids").alias("at", "s")).select("*", F.col("s.id").alias("slide_id"), F.col("s.rid").alias("id")).drop("s")
    targets = edges.select("input_key", F.col("source_part").alias("presentation"), "id", F.struct((F.col("internal") & is_type(F.col("type"), "slide")).alias("usable"), "rels_part", "target_exists", "target_part", "target_root").alias("e"))
    found = listed.join(targets, ["input_key", "presentation", "id"], "left").withColumn("number", F.col("at") + 1)
    usable, there, e, asked = F.coalesce("e.usable", F.lit(False)), F.coalesce("e.target_exists", F.lit(False)), F.col("e"), F.col("number").isNotNull()
    good = F.coalesce(usable & there & (e["target_root"] == "p:sld"), F.lit(False))
    numbered = lambda text: F.concat(F.lit("Slide "), F.col("number").cast("string"), F.lit(text))
    why = (
        note(asked & ~usable, "missing-presentation-relationship", F.col("presentation"), numbered(" has no usable relationship."), F.when(F.col("id") != "", F.col("id"))),
        note(usable & ~there, "missing-presentation-target", e["rels_part"], numbered(" isn't there."), F.col("id")), _unlike(usable & there & ~good, e["target_part"], e["target_root"]),
    )
    found = found.withColumns({"target_part": F.when(usable & there, e["target_part"]), "slide_part": F.when(good, e["target_part"]), "said": F.array_compact(F.array(*why))}).drop("at", "id", "e")
    for source, out, kind, top_element in (("target_part", "layout_part", "slideLayout", "p:sldLayout"), ("layout_part", "master_part", "slideMaster", "p:sldMaster"), ("master_part", "theme_part", "theme", "a:theme")):
        found = hop(found, edges, source, out, kind, top_element)
    found = keep(found, "order")
    each = start.select("input_key", F.explode("said").alias("d")).unionByName(found.select("input_key", F.explode("said").alias("d"))).select("input_key", "d.*")
    one = each.groupBy("input_key", "code", "part", "rel_id").agg(F.min("message").alias("message"))
    return found.drop("target_part", "said"), one


def with_parts(found: DataFrame, parts: DataFrame) -> DataFrame:
    """Adds the facts of a slide's own parts: shapes, layout_shapes, master_shapes, master_styles, theme_fonts. The largest come last, so that they move once."""
    for column, root, wanted in (("theme_part", "a:theme", {"fonts": "theme_fonts"}), ("master_part", "p:sldMaster", {"shapes": "master_shapes", "styles": "master_styles"}), ("layout_part", "p:sldLayout", {"shapes": "layout_shapes"}), ("slide_part", "p:sld", {"shapes": "shapes"})):
        side = parts.where(F.col("alone") & (F.col("root") == root)).select("input_key", F.col("part_name").alias(column), *[F.col(k).alias(v) for k, v in wanted.items()])
        found = found.join(side, ["input_key", column], "left")
    return found


def incoming(edges: DataFrame) -> DataFrame:
    """input_key, target_key, source_part, rels_part, id, type: the edges that lead to each part, there or not, by its key."""
    return edges.where("resolved IS NOT NULL").select("input_key", "target_key", "source_part", "rels_part", "id", "type")


def by_id(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """The edge of each wanted input_key, source_part (null: the package itself), id; parts are compared by their keys."""
    key = paths.part_key(F.col("source_part"))
    asked = wanted.select(F.col("input_key").alias("_key"), key.alias("_source"), F.col("id").alias("_id")).distinct()
    same = (F.col("input_key") == F.col("_key")) & key.eqNullSafe(F.col("_source")) & (F.col("id") == F.col("_id"))
    return edges.join(asked, same, "left_semi")


def part_status(parts: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (input_key, part_name) with status: ok, or why the part can't be read: part-not-found, ambiguous-part-name, a limit, or a fault of its bytes."""
    held = parts.where(F.col("part_key").isNotNull() & ~F.col("raw_name").endswith("/")).groupBy("input_key", "part_key").agg(F.count("*").alias("_n"), F.max("denied").alias("_denied"), F.max("read_error").alias("_error"))
    asked = wanted.withColumn("part_key", paths.part_key(paths.part_name(F.col("part_name")))).join(held, ["input_key", "part_key"], "left")
    status = F.when(F.col("_n").isNull(), "part-not-found").when(F.col("_n") > 1, "ambiguous-part-name").otherwise(F.coalesce("_denied", "_error", F.lit("ok")))
    return asked.select(*wanted.columns, status.alias("status"))
