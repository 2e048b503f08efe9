"""Inspection of packages: facts, rules, findings, suppressions, baseline, counts and exit codes, as DataFrames.

Every table carries input_key, so any number of packages is one job.
"""

from __future__ import annotations

import contextlib
import functools
import threading
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.functions import canonical as C
from foliograph.functions import geometry as G
from foliograph.functions import paths
from foliograph.operators import package, relational, shapes, text
from foliograph.plans.config import SELECTORS, Config
from foliograph.plans.work import keep, together
from foliograph.sources import decks

#: EMU in a point (fixed value).
POINT = 12700
NUL = "\u0000"
DRAFT = ("input_key", "rule_id", "severity", "message", "part", "slide_number", "slide_id", "shape_ids", "shape_names", "paragraph", "run", "evidence", "discriminator", "emitted")


def _made(step: Callable[[Facts], Any]) -> property:
    """What the step returns; it is made once, by the thread that asks first."""

    def get(f: Facts) -> Any:
        with f.locks.setdefault(step.__name__, threading.Lock()):
            if step.__name__ not in f.held:
                f.held[step.__name__] = step(f)
            return f.held[step.__name__]

    return property(get, doc=step.__doc__)


@dataclass
class Facts:
    """Tables of all packages. They are made when they are first asked for, so unused ones cost nothing."""

    files: DataFrame
    parts: DataFrame
    held: dict[str, Any] = field(default_factory=dict)
    locks: dict[str, threading.Lock] = field(default_factory=dict)

    @_made
    def readable(self) -> DataFrame:
        keys = self.files.where("input_key IS NOT NULL").select("input_key").distinct()
        return keys.join(self.parts.where("zip_error IS NOT NULL").select("input_key"), "input_key", "left_anti")

    @_made
    def typed(self) -> tuple[DataFrame, DataFrame]:
        return package.content_types(self.parts, self.readable)

    @_made
    def related(self) -> tuple[DataFrame, DataFrame]:
        return package.relationships(self.parts)

    @_made
    def ordered(self) -> tuple[DataFrame, DataFrame]:
        return package.slides(self.edges, self.parts, self.readable)

    @property
    def types(self) -> DataFrame:
        return self.typed[0]

    @property
    def edges(self) -> DataFrame:
        return self.related[0]

    @_made
    def slides(self) -> DataFrame:
        edges, slides = self.edges, self.ordered[0]
        over = edges.where(F.col("internal") & package.is_type(F.col("type"), "themeOverride")).groupBy("input_key", F.col("source_part").alias("over_source")).agg(F.min(F.coalesce("resolved", "rels_part")).alias("over"))
        for part in ("slide_part", "layout_part"):
            slides = slides.join(over.withColumnsRenamed({"over_source": part, "over": f"_{part}"}), ["input_key", part], "left")
        slides = slides.withColumn("override_part", F.least("_slide_part", "_layout_part")).drop("_slide_part", "_layout_part")
        return keep(package.with_parts(slides, self.parts), "slides")

    @_made
    def leaves(self) -> DataFrame:
        return keep(shapes.leaves(self.slides.where("slide_part IS NOT NULL")), "leaves")

    @_made
    def bodies(self) -> DataFrame:
        return keep(text.bodies(self.slides.where("slide_part IS NOT NULL")), "bodies")

    @_made
    def runs(self) -> DataFrame:
        return keep(text.runs(self.bodies), "runs")

    @_made
    def diagnostics(self) -> DataFrame:
        (_, of_types), (_, of_edges), (_, of_slides), leaves = together(self.files.sparkSession, lambda: self.typed, lambda: self.related, lambda: self.ordered, lambda: self.leaves)
        bad = leaves.where("reason IS NOT NULL").groupBy("input_key", "slide_part").agg(F.count("*").alias("n"), F.min("number").alias("number"), F.min_by("reason", F.struct("number", "z")).alias("reason"))
        text_of = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in x])
        placeless = package.note(F.lit(True), "unsupported-geometry", F.col("slide_part"), text_of("Slide ", F.col("number"), ": shapes without a place: ", F.col("n"), ", first: ", F.col("reason")))
        diagnostics = package.entries(self.parts)
        for more in (of_types, of_edges, of_slides, package.said(bad, placeless)):
            diagnostics = diagnostics.unionByName(more)
        return keep(diagnostics.distinct(), "diagnostics")


def facts(files: DataFrame, limits: dict | None = None, with_rasters: bool = False) -> Facts:
    """files: file, input_key, source_sha256, content (see decks.decks). Packages are parsed once and the facts kept."""
    parts, files = decks.named_entries(files, limits, with_rasters)
    return Facts(files, parts)


# rules


def _draft(rows: DataFrame, rule: str, severity: str, message: Column, discriminator: Column, evidence: Column, emitted: tuple = (), **location: Column) -> DataFrame:
    """rows as findings; location columns that a rule doesn't give are null. emitted: the rule's own order."""
    emitted = emitted or (F.lit(0),)
    kinds = {"part": "string", "slide_number": "int", "slide_id": "string", "shape_ids": "array<bigint>", "shape_names": "array<string>", "paragraph": "int", "run": "int"}
    where = [(location[k] if k in location else F.lit(None)).cast(t).alias(k) for k, t in kinds.items()]
    return rows.select("input_key", F.lit(rule).alias("rule_id"), F.lit(severity).alias("severity"), message.alias("message"), *where, evidence.alias("evidence"), discriminator.alias("discriminator"), F.array(*[c.cast("long") for c in emitted]).alias("emitted")).select(*DRAFT)


def _box(b: Column, scale: float = 1) -> Column:
    return C.json_object(**{k: C.json_number(C.round_half_up(b[k] / scale, 3)) for k in ("x", "y", "width", "height")})


def _polygon(p: Column) -> Column:
    return C.json_list(F.transform(p, lambda v: C.json_object(x=C.json_number(C.round_half_up(v["x"], 3)), y=C.json_number(C.round_half_up(v["y"], 3)))))


def _names(*columns: str) -> Column:
    names = C.sorted_text(F.array_compact(F.array(*[F.col(c) for c in columns])))
    return F.when(F.size(names) > 0, names)


def _slide(p: str = "") -> dict[str, Column]:
    return {"part": F.col(f"{p}slide_part"), "slide_number": F.col(f"{p}number"), "slide_id": F.col(f"{p}slide_id")}


def _broken(f: Facts) -> DataFrame:
    return f.edges.where("internal AND NOT target_exists").withColumn("media", package.media_kind(F.col("type")))


def _edge_evidence(**more: Column) -> Column:
    return C.json_object(rawTarget=C.json_text(F.col("target")), relationshipId=C.json_text(F.col("id")), relationshipPart=C.json_text(F.col("rels_part")), relationshipType=C.json_text(F.col("type")), resolvedTarget=C.json_text(F.col("resolved")), sourcePart=C.json_text(F.col("source_part")), **more)



def broken_relationship(f: Facts, severity: str, options: dict) -> DataFrame:
    key = F.concat_ws(NUL, "rels_part", "id", F.coalesce("resolved", "target"))
    return _draft(_broken(f).where("media IS NULL"), "package/broken-relationship", severity, F.concat(F.lit("Relationship "), F.col("id"), F.lit(" names a part that the package lacks.")), key, _edge_evidence(), part=F.coalesce("source_part", "rels_part"))


def missing_media(f: Facts, severity: str, options: dict) -> DataFrame:
    key = F.concat_ws(NUL, "rels_part", "id", F.coalesce("resolved", "target"))
    of = f.slides.where("slide_part IS NOT NULL").select("input_key", F.col("slide_part").alias("source_part"), "number", "slide_id").dropDuplicates(["input_key", "source_part"])
    rows = _broken(f).where("media IS NOT NULL").join(of, ["input_key", "source_part"], "left")
    evidence = _edge_evidence(mediaKind=C.json_text(F.col("media")), referencingSlide=C.json_number(F.col("number")))
    return _draft(rows, "package/missing-media", severity, F.concat(F.lit("The "), F.col("media"), F.lit(" "), C.json_text(F.col("target")), F.lit(" is missing.")), key, evidence, part=F.coalesce("source_part", "rels_part"), slide_number=F.col("number"), slide_id=F.col("slide_id"))


def malformed_xml(f: Facts, severity: str, options: dict) -> DataFrame:
    rows = f.parts.where("xml.code IS NOT NULL")
    evidence = C.json_object(column=C.json_number(F.col("xml.col")), diagnosticCode=C.json_text(F.col("xml.code")), diagnosticMessage=C.json_text(F.col("xml.message")), line=C.json_number(F.col("xml.line")), offset=C.json_number(F.col("xml.offset")), partName=C.json_text(F.col("part_name")))
    return _draft(rows, "package/malformed-xml", severity, F.concat(F.lit("The XML can't be used: "), F.col("xml.code"), F.lit(".")), F.col("part_name"), evidence, part=F.col("part_name"))


def outside_slide(f: Facts, severity: str, options: dict) -> DataFrame:
    room = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.col("size.cx").cast("double").alias("width"), F.col("size.cy").cast("double").alias("height"))
    rows = f.leaves.where("reason IS NULL AND size.cx > 0 AND size.cy > 0").withColumn("frame", room)
    rows = relational.outside(rows, "polygon", "frame", options["tolerancePt"] * POINT, options["minOutsideRatio"])
    ratio, b = F.col("outside_ratio"), F.col("bounds")
    beyond = F.greatest(-b["x"], -b["y"], b["x"] + b["width"] - F.col("frame.width"), b["y"] + b["height"] - F.col("frame.height"))
    percent = C.number_text(C.round_half_up(ratio * 100, 1))
    message = F.concat(F.coalesce(C.json_text(F.when(F.col("shape_name").isNotNull(), F.col("shape_name"))), F.lit("")), F.lit(" reaches "), C.number_text(C.round_half_up(beyond / POINT, 3)), F.lit("pt over the "), F.array_join("edges", "/"), F.lit(" edge; "), percent, F.lit("% of its area is outside."))
    evidence = C.json_object(
        affectedEdges=C.json_list(F.transform("edges", C.json_text)), boundsEmu=_box(b), boundsPt=_box(b, POINT), intersectionAreaEmu2=C.json_number(C.round_half_up(F.col("inside_area"), 3)), intersectionPolygonEmu=_polygon(F.col("inside")),
        minOutsideRatio=C.json_number(F.lit(options["minOutsideRatio"])), outsideAreaEmu2=C.json_number(C.round_half_up(F.col("area") - F.col("inside_area"), 3)), outsideRatio=C.json_number(C.round_half_up(ratio, 6)), shapeId=C.json_number(F.col("shape_id")),
        shapeName=C.json_text(F.col("shape_name")), slideBoundsEmu=_box(F.col("frame")), toleranceEmu=C.json_number(F.lit(options["tolerancePt"] * POINT)), tolerancePt=C.json_number(F.lit(options["tolerancePt"])),
    )
    return _draft(rows, "layout/outside-slide", severity, message, F.col("shape_id").cast("string"), evidence, (F.col("number"), F.col("z")), **_slide(), shape_ids=F.array("shape_id"), shape_names=_names("shape_name"))


def _meeting(first: DataFrame, second: DataFrame, condition: Column) -> DataFrame:
    """Pairs of a slide's rows whose boxes meet, a_ and b_, with the intersection of their polygons."""
    pairs = relational.meeting(first, second, ["input_key", "number"], condition).withColumn("_cut", G.intersection(F.col("a_polygon"), F.col("b_polygon")))
    return pairs.withColumns({"cut": F.col("_cut.polygon"), "cut_area": F.col("_cut.area")}).drop("_cut").where("cut_area > 0")


def text_overlap(f: Facts, severity: str, options: dict) -> DataFrame:
    """Pairs of independent shapes, the smaller id first; of a pair's frames the largest ratio, the first of equals."""
    frames = shapes.frames(f.leaves).withColumnsRenamed({"frame_polygon": "polygon", "frame_bounds": "bounds"})
    free = (F.col("a_shape_id") < F.col("b_shape_id")) & ~F.array_contains("a_group_ids", F.col("b_shape_id")) & ~F.array_contains("b_group_ids", F.col("a_shape_id"))
    pairs = _meeting(frames, frames, free).withColumn("ratio", F.col("cut_area") / F.least("a_frame_area", "b_frame_area"))
    best = F.max_by(F.struct("*"), F.struct("ratio", (-F.col("a_frame_at")).alias("p"), (-F.col("b_frame_at")).alias("q")))
    rows = pairs.groupBy("input_key", "number", "a_z", "b_z").agg(best.alias("v")).select("v.*").where(C.at_least(F.col("ratio"), options["minOverlapRatio"]))
    side = lambda s, n: {f"{n}BoundsEmu": _box(F.col(f"{s}_bounds")), f"{n}BoundsPt": _box(F.col(f"{s}_bounds"), POINT), f"{n}ShapeId": C.json_number(F.col(f"{s}_shape_id")), f"{n}ShapeName": C.json_text(F.col(f"{s}_shape_name")), f"{n}TextFrame": C.json_text(F.col(f"{s}_frame"))}
    evidence = C.json_object(
        **side("a", "first"), **side("b", "second"), intersectionAreaEmu2=C.json_number(C.round_half_up(F.col("cut_area"), 3)), intersectionBoundsEmu=_box(G.bounds(F.col("cut"))), intersectionPolygonEmu=_polygon(F.col("cut")), minOverlapRatio=C.json_number(F.lit(options["minOverlapRatio"])),
        overlapRatio=C.json_number(C.round_half_up(F.col("ratio"), 6)), smallerShapeId=C.json_number(F.when(F.col("a_frame_area") <= F.col("b_frame_area"), F.col("a_shape_id")).otherwise(F.col("b_shape_id"))),
    )
    message = F.concat(F.lit("Text frames share "), C.number_text(C.round_half_up(F.col("ratio") * 100, 1)), F.lit("% of the smaller one."))
    place = {"part": F.col("a_slide_part"), "slide_number": F.col("number"), "slide_id": F.col("a_slide_id")}
    return _draft(rows, "layout/text-overlap", severity, message, F.concat_ws(NUL, "a_shape_id", "b_shape_id"), evidence, (F.col("number"), F.col("a_z"), F.col("b_z")), **place, shape_ids=F.array_sort(F.array("a_shape_id", "b_shape_id")), shape_names=_names("a_shape_name", "b_shape_name"))


def text_occluded(f: Facts, severity: str, options: dict) -> DataFrame:
    """Opaque shapes above text: the geometry decides first, images are looked up for the pairs that remain."""
    frames = shapes.frames(f.leaves).withColumnsRenamed({"frame_polygon": "polygon", "frame_bounds": "bounds"})
    covers = f.leaves.where("reason IS NULL").withColumn("opacity", shapes.opacity(F.col("fill"), F.col("kind"))).where("opacity.state = 'opaque' OR opacity.basis = 'embedded-image'")
    covers = covers.select("input_key", "number", "slide_part", "z", "shape_id", "shape_name", "polygon", "bounds", "grid", "opacity")
    above = (F.col("b_z") > F.col("a_z")) & (F.col("a_shape_id") != F.col("b_shape_id"))
    pairs = _meeting(frames, covers, above).withColumn("ratio", F.col("cut_area") / F.col("a_frame_area"))
    best = F.max_by(F.struct("*"), F.struct("ratio", (-F.col("a_frame_at")).alias("p")))
    rows = pairs.groupBy("input_key", "number", "a_z", "b_z").agg(best.alias("v")).select("v.*").where(C.at_least(F.col("ratio"), options["minOccludedRatio"]))
    image = f.edges.where(package.is_type(F.col("type"), "image") & F.col("internal")).select("input_key", F.col("source_part").alias("b_slide_part"), F.col("id").alias("embed"), F.col("target_part").alias("media"))
    seen = f.parts.where("raster = 'opaque' AND alone").select("input_key", F.col("part_name").alias("media"), F.lit(True).alias("solid"))
    rows = rows.withColumn("embed", F.col("b_opacity.embed")).join(image, ["input_key", "b_slide_part", "embed"], "left").join(seen, ["input_key", "media"], "left").where("b_opacity.state = 'opaque' OR solid")
    basis = F.when(F.col("solid"), "embedded-image").otherwise(F.col("b_opacity.basis"))
    side = lambda s, n: {f"{n}BoundsEmu": _box(F.col(f"{s}_bounds")), f"{n}ShapeId": C.json_number(F.col(f"{s}_shape_id")), f"{n}ShapeName": C.json_text(F.col(f"{s}_shape_name")), f"{n}ZIndex": C.json_number(F.col(f"{s}_z"))}
    evidence = C.json_object(
        **side("a", "text"), **side("b", "foreground"), imageRelationshipId=C.json_text(F.col("embed")), intersectionAreaEmu2=C.json_number(C.round_half_up(F.col("cut_area"), 3)), intersectionPolygonEmu=_polygon(F.col("cut")), mediaPart=C.json_text(F.col("media")), minOccludedRatio=C.json_number(F.lit(options["minOccludedRatio"])),
        occludedRatio=C.json_number(C.round_half_up(F.col("ratio"), 6)), opacityAlpha=C.json_number(F.col("b_opacity.alpha")), opacityBasis=C.json_text(basis), opacityState=F.lit('"opaque"'), textFrame=C.json_text(F.col("a_frame")), textFrameAreaEmu2=C.json_number(C.round_half_up(F.col("a_frame_area"), 3)),
    )
    message = F.concat(F.lit("An opaque shape covers "), C.number_text(C.round_half_up(F.col("ratio") * 100, 1)), F.lit("% of a text frame."))
    place = {"part": F.col("a_slide_part"), "slide_number": F.col("number"), "slide_id": F.col("a_slide_id")}
    return _draft(rows, "layout/text-occluded", severity, message, F.concat_ws(NUL, "a_shape_id", "b_shape_id", "a_frame"), evidence, (F.col("number"), F.col("a_z"), F.col("b_z")), **place, shape_ids=F.array_sort(F.array("a_shape_id", "b_shape_id")), shape_names=_names("a_shape_name", "b_shape_name"))


def _minimum(options: dict) -> Column:
    return F.when(F.col("placeholder_kind") == "title", float(options["titlePt"])).otherwise(float(options["defaultPt"]))


def _run_draft(rows: DataFrame, rule: str, severity: str, message: Column, evidence: Column, *more: Column) -> DataFrame:
    key = F.concat_ws(NUL, "shape_id", "body_at", "r.paragraph", "r.run", *more)
    return _draft(rows, rule, severity, message, key, evidence, tuple(F.col(c) for c in ("number", "z", "body_at", "r.paragraph", "r.run")), **_slide(), shape_ids=F.array("shape_id"), shape_names=_names("shape_name"), paragraph=F.col("r.paragraph"), run=F.col("r.run"))


def _provenance() -> Column:
    s = F.col("size_source")
    return C.json_object(rawValue=C.json_text(s["p"]["sz"]), sourceKind=C.json_text(s["kind"]), sourcePart=C.json_text(s["part"]))


def min_font_size(f: Facts, severity: str, options: dict) -> DataFrame:
    minimum, size = _minimum(options), F.col("base_pt")
    rows = f.runs.where(C.below(size, minimum) & ~((F.col("autofit.kind") == "runtime") & F.col("autofit.ratio").isNotNull()))
    evidence = C.json_object(baseFontSizePt=C.json_number(C.round_half_up(size, 3)), configuredMinimumPt=C.json_number(minimum), placeholderKind=C.json_text(F.col("placeholder_kind")), sizeProvenance=_provenance(), textBodyIndex=C.json_number(F.col("body_at")))
    return _run_draft(rows, "text/min-font-size", severity, F.concat(F.lit("Text of "), C.number_text(C.round_half_up(size, 3)), F.lit("pt is below the minimum of "), C.number_text(minimum), F.lit("pt.")), evidence)


def autofit_scale(f: Facts, severity: str, options: dict) -> DataFrame:
    minimum, size = _minimum(options), F.col("effective_pt")
    rows = f.runs.where((F.col("autofit.kind") == "runtime") & F.col("autofit.ratio").isNotNull() & C.below(size, minimum))
    evidence = C.json_object(
        baseFontSizePt=C.json_number(C.round_half_up(F.col("base_pt"), 3)), baseSizeProvenance=_provenance(), configuredMinimumPt=C.json_number(minimum), effectiveFontSizePt=C.json_number(C.round_half_up(size, 3)), fontScaleRatio=C.json_number(C.round_half_up(F.col("autofit.ratio"), 6)),
        placeholderKind=C.json_text(F.col("placeholder_kind")), rawFontScale=C.json_text(F.col("autofit.raw")), scaleSourceKind=C.json_text(F.col("autofit.source_kind")), scaleSourcePart=C.json_text(F.col("autofit.source_part")), textBodyIndex=C.json_number(F.col("body_at")),
    )
    message = F.concat(F.lit("The stored scale takes text from "), C.number_text(C.round_half_up(F.col("base_pt"), 3)), F.lit("pt to "), C.number_text(C.round_half_up(size, 3)), F.lit("pt, below the minimum of "), C.number_text(minimum), F.lit("pt."))
    return _run_draft(rows, "text/autofit-scale-below-minimum", severity, message, evidence)


def autofit_enabled(f: Facts, severity: str, options: dict) -> DataFrame:
    rows = f.bodies.where("autofit.kind = 'runtime' AND autofit.ratio IS NULL").withColumns({"shape_id": F.col("s.id"), "shape_name": F.col("s.name")})
    a = F.col("autofit")
    evidence = C.json_object(autofitKind=C.json_text(a["kind"]), rawFontScale=C.json_text(a["raw"]), reason=C.json_text(a["reason"]), sourceKind=C.json_text(a["source_kind"]), sourcePart=C.json_text(a["source_part"]), textBodyIndex=C.json_number(F.col("b.idx")))
    message = F.lit("Autofit is on without a usable stored scale, so the text's size depends on the renderer.")
    return _draft(rows, "text/autofit-enabled", severity, message, F.concat_ws(NUL, "shape_id", "b.idx"), evidence, (F.col("number"), F.col("z"), F.col("b.idx")), **_slide(), shape_ids=F.array("shape_id"), shape_names=_names("shape_name"))


def fonts_allowed(f: Facts, severity: str, options: dict) -> DataFrame:
    """Typefaces of used slots that the list lacks; those that can't be resolved have a severity of their own, or none."""
    families = [x.lower() for x in options["families"]]
    rows = keep(text.typefaces(f.runs), "typefaces")  # else the filters below repeat how a typeface is found
    allowed = C.json_list(F.transform(C.sorted_text(F.array(*[F.lit(x) for x in options["families"]])), C.json_text))
    base = {"allowedFamilies": allowed, "placeholderKind": C.json_text(F.col("placeholder_kind")), "scriptSlot": C.json_text(F.col("slot")), "textBodyIndex": C.json_number(F.col("body_at"))}
    named = rows.where(F.col("typeface").isNotNull() & ~F.lower(C.trim_all(F.col("typeface"))).isin(*families))
    out = _run_draft(named, "fonts/allowed", severity, F.concat(F.lit("The typeface "), C.json_text(F.col("typeface")), F.lit(" is not allowed.")), C.json_object(**base, resolvedTypeface=C.json_text(F.col("typeface"))), F.col("slot"))
    if options["unresolved"] != "ignore":
        open_ = rows.where("typeface IS NULL")
        evidence = C.json_object(**base, rawTypeface=C.json_text(F.col("raw_typeface")), reason=C.json_text(F.col("typeface_reason")), sourceKind=C.json_text(F.col("face.kind")), sourcePart=C.json_text(F.col("face.part")))
        out = out.unionByName(_run_draft(open_, "fonts/allowed", options["unresolved"], F.lit("The typeface can't be resolved."), evidence, F.col("slot"), F.lit("unresolved")))
    return out


RULES = {
    "fonts/allowed": fonts_allowed,
    "layout/outside-slide": outside_slide,
    "layout/text-occluded": text_occluded,
    "layout/text-overlap": text_overlap,
    "package/broken-relationship": broken_relationship,
    "package/malformed-xml": malformed_xml,
    "package/missing-media": missing_media,
    "text/autofit-enabled": autofit_enabled,
    "text/autofit-scale-below-minimum": autofit_scale,
    "text/min-font-size": min_font_size,
}
NEEDS_PRESENTATION = ("fonts/", "layout/", "text/")


# findings


def findings(f: Facts, config: Config, timings: dict[str, float] | None = None) -> DataFrame:
    """Findings of the enabled rules, one per fingerprint. Rules that are off aren't planned.

    With timings each rule is a step of its own, whose milliseconds are noted; else all are planned together.
    """
    spark, out = f.files.sparkSession, None

    def of(rule: str) -> DataFrame:
        rows = RULES[rule](f, *config.enabled()[rule])
        return rows if timings is None else keep(rows, "rule")

    if timings is None:
        found = together(spark, *[functools.partial(of, rule) for rule in config.enabled()])
    else:
        found = []
        for rule in config.enabled():
            with spent(timings, f"rule/{rule}"):
                found.append(of(rule))
    for rows in found:
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        out = spark.createDataFrame([], ", ".join(f"{c} string" for c in DRAFT)).withColumns({"shape_ids": F.lit(None).cast("array<bigint>"), "shape_names": F.lit(None).cast("array<string>"), "slide_number": F.lit(None).cast("int"), "emitted": F.lit(None).cast("array<bigint>")})
    ids = F.coalesce("shape_ids", F.array().cast("array<bigint>"))
    out = out.withColumn("fingerprint", C.fingerprint(F.col("rule_id"), F.col("input_key"), F.col("part"), F.col("slide_id"), F.col("slide_number"), ids, F.col("discriminator")))
    return keep(relational.last_wins(out.drop("discriminator"), ["input_key", "fingerprint"], "emitted").drop("emitted"), "findings")


def suppressed(found: DataFrame, config: Config) -> DataFrame:
    """Adds suppressed_by: the index of the first suppression of the configuration that fits, else null."""
    if not config.ignore:
        return found.withColumn("suppressed_by", F.lit(None).cast("int"))
    q = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"
    values = ", ".join(f"({i}, {q(s['rule'])}, {q(s.get('file'))}, {q(s.get('slide'))}, {q(s.get('slideId'))}, {q(','.join(map(str, s['shapeIds'])) if 'shapeIds' in s else None)}, {q(s['part'].lower() if 'part' in s else None)})" for i, s in enumerate(config.ignore))
    rows = found.sparkSession.sql(f"SELECT idx, rule, CAST(file AS STRING) AS file, CAST(slide AS INT) AS slide, CAST(slideId AS STRING) AS slideId, CAST(shapeIds AS STRING) AS shapeIds, CAST(part AS STRING) AS part FROM VALUES {values} AS t(idx, rule, file, slide, slideId, shapeIds, part)")
    sides = found.select("input_key", "fingerprint", F.col("rule_id"), F.col("input_key").alias("file"), F.col("slide_number").alias("slide"), F.col("slide_id").alias("slideId"), F.array_join("shape_ids", ",").alias("shapeIds"), paths.part_key(F.col("part")).alias("part"))
    hit = relational.first_suppression(sides, rows, "rule_id", list(SELECTORS), ["input_key", "fingerprint"]).where("suppressed_by IS NOT NULL").select("input_key", "fingerprint", "suppressed_by")
    return found.join(hit, ["input_key", "fingerprint"], "left")


def unused(found: DataFrame, files: DataFrame, config: Config) -> DataFrame:
    """input_key, idx, rule_id of the suppressions that may fit an input and fit none of its findings."""
    none = files.select("input_key", F.lit(None).cast("int").alias("idx"), F.lit(None).cast("string").alias("rule_id")).where("FALSE")
    if not config.ignore:
        return none
    every = F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(s["rule"]).alias("rule_id"), F.lit(s.get("file")).cast("string").alias("file")) for i, s in enumerate(config.ignore)])
    each = files.where("input_key IS NOT NULL").select("input_key", F.explode(every).alias("s")).select("input_key", "s.*").where("file IS NULL OR file = input_key")
    used = found.where("suppressed_by IS NOT NULL").select("input_key", F.col("suppressed_by").alias("idx")).distinct()
    return relational.missing(each, used, ["input_key", "idx"]).select("input_key", "idx", "rule_id")


def classified(found: DataFrame, baseline: DataFrame | None, files: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Adds status (new or existing) to what no suppression took, and the baseline's entries that are resolved, of the files' inputs.

    baseline: input_key, fingerprint. A suppressed finding counts as gone. Of a table of reports.save_baseline nothing moves.
    """
    if baseline is None:
        return found.withColumn("status", F.lit("new")), None
    keys = ["input_key", "fingerprint"]
    status = relational.baseline_status(found.where("suppressed_by IS NULL"), baseline, keys)
    resolved = status.where("status = 'resolved'").select(*keys).join(files.select("input_key").distinct(), "input_key", "left_semi")
    return found.join(status.where("status <> 'resolved'"), keys, "left").withColumn("status", F.coalesce("status", F.lit("new"))), resolved


def skipped(f: Facts, config: Config) -> DataFrame:
    """input_key, rule_id of the rules that need a presentation where there is none."""
    rules = [r for r in config.enabled() if r.startswith(NEEDS_PRESENTATION)]
    lost = f.files.where("input_key IS NOT NULL").select("input_key").join(f.slides.select("input_key").distinct(), "input_key", "left_anti")
    return lost.select("input_key", F.explode(F.array(*[F.lit(r) for r in rules]) if rules else F.array().cast("array<string>")).alias("rule_id"))


def unexplained(f: Facts, found: DataFrame, config: Config) -> DataFrame:
    """input_key of each diagnostic and malformed part that no finding accounts for.

    Findings that fail the command, new or not, account for theirs, and so do suppressed ones: of malformed XML for
    diagnostics of that part, or of what its relationships lead to; of a broken edge for those of the edge.
    """
    heavy = found.where((F.col("severity") == "error") | (F.lit(config.fail_on) == "warning") | F.col("suppressed_by").isNotNull())
    xml = heavy.where("rule_id = 'package/malformed-xml'").select("input_key", paths.part_key(F.col("part")).alias("key")).distinct()
    edge = heavy.where("rule_id IN ('package/broken-relationship', 'package/missing-media')").select("input_key", paths.part_key(F.get_json_object("evidence", "$.relationshipPart")).alias("key"), F.get_json_object("evidence", "$.relationshipId").alias("rel_id")).distinct()
    d, code = f.diagnostics.withColumn("key", paths.part_key(F.col("part"))), F.col("code")
    paired = d.where("code = 'malformed-xml'").select("input_key", "key").distinct().join(xml, ["input_key", "key"], "left_semi").withColumn("paired", F.lit(True))
    own = d.where(code == "malformed-xml")
    pairs = d.where(code.isin("invalid-content-types", "invalid-relationships")).join(paired, ["input_key", "key"], "left").where("paired IS NULL")
    above = code.isin("missing-office-document", "missing-presentation-relationship")
    led = d.where(above).withColumn("key", F.when(code == "missing-office-document", "_rels/.rels").otherwise(paths.part_key(paths.rels_of_source(F.col("part")))))
    on_edge = code.isin("invalid-relationship-target", "missing-presentation-part", "missing-presentation-target")
    edges = relational.missing(d.where(on_edge), edge, ["input_key", "key", "rel_id"])
    known = code.isin("malformed-xml", "invalid-content-types", "invalid-relationships") | above | on_edge
    light = relational.missing(found.where("rule_id = 'package/malformed-xml' AND suppressed_by IS NULL"), heavy.select("input_key", "fingerprint"), ["input_key", "fingerprint"])
    out = light.select("input_key")
    for rows in (relational.missing(own, xml, ["input_key", "key"]), pairs, relational.missing(led, xml, ["input_key", "key"]), edges, d.where(~known)):
        out = out.unionByName(rows.select("input_key"))
    return out


def summary(f: Facts, found: DataFrame, config: Config, resolved: DataFrame | None = None) -> DataFrame:
    """Counts, completeness and exit code of each input and, as the null input, of the command.

    found has suppressed_by and status. Exit code: 2 if an analysis is incomplete without findings that account for it,
    else 1 if a new finding is as severe as the configuration's failOn, else 0; the command's is the largest.
    """
    live = found.where("suppressed_by IS NULL")
    counts = live.groupBy("input_key").agg(*[F.count_if(c).alias(n) for n, c in {
        "errors": F.col("severity") == "error", "warnings": F.col("severity") == "warning", "total": F.lit(True), "new_errors": (F.col("severity") == "error") & (F.col("status") == "new"),
        "new_warnings": (F.col("severity") == "warning") & (F.col("status") == "new"), "existing": F.col("status") == "existing"}.items()])
    tally = lambda df, n: df.groupBy("input_key").agg(F.count("*").alias(n))
    rows = f.files.select(F.coalesce("input_key", "file").alias("input_key"), F.col("input_key").isNull().alias("bad_key"))
    rows = rows.join(counts, "input_key", "left").join(tally(found.where("suppressed_by IS NOT NULL"), "suppressed"), "input_key", "left")
    rows = rows.join(tally(f.diagnostics, "diagnostics"), "input_key", "left").join(tally(unexplained(f, found, config), "open"), "input_key", "left").join(tally(skipped(f, config), "skipped"), "input_key", "left")
    rows = rows.join(tally(found.where("rule_id = 'package/malformed-xml' AND suppressed_by IS NULL"), "live_malformed"), "input_key", "left").join(tally(found.where("rule_id = 'package/malformed-xml'"), "malformed"), "input_key", "left").join(tally(f.parts.where("zip_error IS NOT NULL"), "unreadable"), "input_key", "left")
    rows = rows.join(tally(resolved, "resolved"), "input_key", "left") if resolved is not None else rows.withColumn("resolved", F.lit(0))
    rows = rows.fillna(0)
    complete = (F.col("diagnostics") == 0) & (F.col("skipped") == 0) & (F.col("malformed") == 0) & (F.col("unreadable") == 0) & ~F.col("bad_key")
    failing = F.col("new_errors") + (F.col("new_warnings") if config.fail_on == "warning" else F.lit(0))
    broken = F.col("bad_key") | (F.col("unreadable") > 0) | (F.col("open") > 0) | (~complete & (F.col("diagnostics") == 0) & (F.col("live_malformed") == 0))
    rows = rows.withColumns({"complete": complete, "exit_code": F.when(broken, 2).when(failing > 0, 1).otherwise(0)})
    sums = ["errors", "warnings", "total", "new_errors", "new_warnings", "existing", "suppressed", "resolved", "diagnostics", "skipped"]
    return rows.rollup("input_key").agg(*[F.sum(c).alias(c) for c in sums], F.bool_and("complete").alias("complete"), F.max("exit_code").alias("exit_code"))


@contextlib.contextmanager
def spent(timings: dict[str, float] | None, name: str) -> Iterator[None]:
    """Adds the milliseconds of a step to timings, if there are any."""
    began = time.perf_counter()
    yield
    if timings is not None:
        timings[name] = timings.get(name, 0) + 1000 * (time.perf_counter() - began)


def inspect(files: DataFrame, config: Config, baseline: DataFrame | None = None, limits: dict | None = None, timings: dict[str, float] | None = None) -> dict[str, DataFrame]:
    """findings (with suppressed_by and status), unused suppressions, resolved, diagnostics, skipped, summary. Suppressions come before the baseline.

    timings, if given, gets the milliseconds of the context and of each rule.
    """
    with spent(timings, "context"):
        f = facts(files, limits, "layout/text-occluded" in config.enabled())
        if timings is not None:
            together(files.sparkSession, lambda: f.runs, lambda: f.diagnostics)
    found, _ = together(files.sparkSession, lambda: findings(f, config, timings), lambda: f.diagnostics)
    found, resolved = classified(suppressed(found, config), baseline, f.files)
    found = keep(found, "classified")
    return {"findings": found, "unused": unused(found, f.files, config), "resolved": resolved, "diagnostics": f.diagnostics, "skipped": skipped(f, config), "summary": summary(f, found, config, resolved), "facts": f}
