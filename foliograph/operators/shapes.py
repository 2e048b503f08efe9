"""Geometry and opacity of slide shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.functions import geometry as G
from foliograph.operators import relational

#: Types of master placeholders that a layout placeholder's geometry can come from.
COMPATIBLE = {
    "body": ("body",),
    "ctrTitle": ("title", "ctrTitle"),
    "dt": ("dt",),
    "ftr": ("ftr",),
    "hdr": ("hdr",),
    "sldImg": ("sldImg",),
    "sldNum": ("sldNum",),
    "subTitle": ("body", "subTitle"),
    "title": ("title",),
    "vertBody": ("body", "vertBody"),
    "vertTitle": ("title", "vertTitle"),
}
KEPT_EFFECTS = ("biLevel", "duotone", "grayscl", "hsl", "lum", "tint")


def compatible(table: dict[str, tuple[str, ...]], wanted: Column, candidate: Column) -> Column:
    out = F.lit(False)
    for kind, types in table.items():
        out = out | ((wanted == kind) & candidate.isin(*types))
    return out


def whole(x: Column) -> Column:
    """Whether a transform can be used."""
    set_ = x["x"].isNotNull()
    for f in ("y", "w", "h", "rot", "flip_h", "flip_v"):
        set_ = set_ & x[f].isNotNull()
    return F.coalesce(set_ & (x["w"] > 0) & (x["h"] > 0), F.lit(False))


def whole_group(x: Column) -> Column:
    return whole(x) & F.coalesce(x["ch_x"].isNotNull() & x["ch_y"].isNotNull() & (x["ch_w"] > 0) & (x["ch_h"] > 0), F.lit(False))


def own_matrix(x: Column) -> Column:
    d = {k: x[k].cast("double") for k in ("x", "y", "w", "h", "rot")}
    return G.shape_matrix(d["x"], d["y"], d["w"], d["h"], d["rot"] / 60000, x["flip_h"], x["flip_v"])


def groups_matrix(groups: Column) -> Column:
    def one(g: Column) -> Column:
        x = g["xfrm"]
        inner = G.compose(G.scaling(x["w"] / x["ch_w"], x["h"] / x["ch_h"]), G.translation(-x["ch_x"].cast("double"), -x["ch_y"].cast("double")))
        return G.let(F.struct(own_matrix(x).alias("m"), inner.alias("n")), lambda v: G.compose(v["m"], v["n"]))

    return G.folded_matrix(F.transform(groups, one))


def placed(shapes: Column, above: Column | None) -> Column:
    """Placeholders of a layout or master: type, idx, and matrix, w, h, which are null where they can't be resolved.

    One without a transform takes that of the compatible one above of its idx, else of the only compatible one.
    """

    def one(s: Column) -> Column:
        usable = whole(s["xfrm"]) & ~F.exists(s["groups"], lambda g: ~whole_group(g["xfrm"]))
        matrix = F.when(usable, G.compose(groups_matrix(s["groups"]), own_matrix(s["xfrm"])))
        own = F.struct(matrix.alias("m"), s["xfrm"]["w"].cast("double").alias("w"), s["xfrm"]["h"].cast("double").alias("h"))
        if above is not None:
            fits = F.filter(above, lambda a: compatible(COMPATIBLE, s["ph"]["type"], a["type"]))
            same = F.filter(fits, lambda a: a["idx"] == s["ph"]["idx"])
            picked = F.coalesce(F.get(same, F.lit(0)), F.when(F.size(fits) == 1, F.get(fits, F.lit(0))))
            own = F.when(s["xfrm"].isNull(), F.struct(picked["m"].alias("m"), picked["w"].alias("w"), picked["h"].alias("h"))).otherwise(own)
        return F.struct(s["ph"]["type"].alias("type"), s["ph"]["idx"].alias("idx"), own["m"].alias("m"), own["w"].alias("w"), own["h"].alias("h"))

    return F.transform(F.filter(F.coalesce(shapes, F.slice(shapes, 1, 0)), lambda s: s["ph"].isNotNull()), one)


def leaves(slides: DataFrame) -> DataFrame:
    """One row per leaf shape that counts in its slide's order: z, geometry, and reason where it has none.

    A hidden group hides all in it; in a group that can't be used every leaf counts, hidden or not, and none has a place.
    """
    odd = lambda s: F.get(F.filter(s["groups"], lambda g: F.coalesce(g["hidden"], F.lit(True)) | ~whole_group(g["xfrm"])), F.lit(0))
    hidden = lambda s: F.coalesce(odd(s)["hidden"], F.lit(False)) | (odd(s).isNull() & F.coalesce(s["hidden"], F.lit(False)))
    rows = slides.withColumn("master_places", placed(F.col("master_shapes"), None))
    rows = rows.withColumn("layout_places", placed(F.col("layout_shapes"), F.coalesce("master_places", F.slice(F.col("master_places"), 1, 0))))
    counted = F.filter("shapes", lambda s: ~hidden(s))
    rows = rows.select("input_key", "number", "slide_id", "slide_part", "size", "layout_places", F.posexplode(counted).alias("z", "s"))
    s = F.col("s")
    ids = F.filter(F.transform(s["groups"], lambda g: g["id"]), lambda x: x.isNotNull())
    same = F.filter("layout_places", lambda p: p["idx"] == s["ph"]["idx"])
    inherited = F.when((F.size(ids) == 0) & s["xfrm"].isNull() & (F.size(same) == 1), F.get(same, F.lit(0)))
    rows = rows.withColumns({"group_ids": ids, "inherited": inherited, "bad_group": odd(s).isNotNull()})
    direct = F.when(whole(s["xfrm"]), G.compose(groups_matrix(s["groups"]), own_matrix(s["xfrm"])))
    matrix = F.when(~F.col("bad_group"), F.when(s["xfrm"].isNotNull(), direct).otherwise(F.col("inherited.m")))
    w = F.when(s["xfrm"].isNotNull(), s["xfrm"]["w"].cast("double")).otherwise(F.col("inherited.w"))
    h = F.when(s["xfrm"].isNotNull(), s["xfrm"]["h"].cast("double")).otherwise(F.col("inherited.h"))
    rows = rows.withColumns({"m": matrix, "w": w, "h": h}).withColumn("polygon", F.when(F.col("m").isNotNull(), G.moved(G.rectangle(0, 0, F.col("w"), F.col("h")), F.col("m"))))
    rows = rows.withColumn("bounds", G.bounds(F.col("polygon")))
    reason = (
        F.when(F.col("bad_group"), "The containing group can't be placed.").when(s["hidden"].isNull(), "The hidden attribute is invalid.").when(s["id"].isNull(), "The shape has no valid id.")
        .when(F.col("polygon").isNull(), "The transform is incomplete, invalid or not inherited.").when((F.col("bounds.width") <= 0) | (F.col("bounds.height") <= 0), "The bounds have no extent.")
    )
    rows = rows.select("input_key", "number", "slide_id", "slide_part", "size", "z", s["id"].alias("shape_id"), s["name"].alias("shape_name"), s["kind"].alias("kind"), "group_ids", "m", "w", "h", "polygon", "bounds", s["fill"].alias("fill"), s["shows_text"].alias("shows_text"), s["cells"].alias("cells"), reason.alias("reason"))
    return relational.with_grid(rows, ["input_key", "number"], "bounds")


def frames(shapes: DataFrame) -> DataFrame:
    """Text frames of shapes: the shape itself, or its table's cells; frame_at is their order in the shape."""
    cell = lambda c: G.moved(G.rectangle(c["x"] * F.col("w") / c["grid_w"], c["y"] * F.col("h") / c["grid_h"], c["w"] * F.col("w") / c["grid_w"], c["h"] * F.col("h") / c["grid_h"]), F.col("m"))
    own = F.when(F.col("shows_text"), F.array(F.struct(F.lit("shape").alias("frame"), F.col("polygon").alias("frame_polygon"))))
    table = F.transform("cells", lambda c: F.struct(c["key"].alias("frame"), cell(c).alias("frame_polygon")))
    out = shapes.where("reason IS NULL").select("input_key", "number", "slide_id", "slide_part", "z", "shape_id", "shape_name", "group_ids", "grid", F.posexplode(F.coalesce(own, table)).alias("frame_at", "f"))
    out = out.select("*", "f.frame", "f.frame_polygon").drop("f")
    return out.withColumns({"frame_bounds": G.bounds(F.col("frame_polygon")), "frame_area": G.area(F.col("frame_polygon"))}).where("frame_area > 0")


def opacity(fill: Column, kind: Column) -> Column:
    """STRUCT<state, basis, alpha, embed> of a shape's fill; an embedded image is unknown until its bytes are looked at."""
    state = lambda s, b, alpha=None: F.struct(F.lit(s).alias("state"), F.lit(b).alias("basis"), (F.lit(None).cast("double") if alpha is None else alpha).alias("alpha"), F.when(kind == "picture", fill["embed"]).alias("embed"))
    span = lambda o: F.when(o["op"] == "alphaOff", o["val"].between(-100000, 100000)).when(o["op"].isin("alpha", "alphaMod"), o["val"].between(0, 100000)).otherwise(False)
    sound = ~F.exists(fill["alphas"], lambda o: ~F.coalesce(span(o), F.lit(False)))
    start = F.when(F.get(fill["colours"], F.lit(0)) != "schemeClr", 1.0)
    part = lambda o: o["val"] / 100000.0
    clamp = lambda x: F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))
    alpha = F.aggregate(fill["alphas"], start, lambda a, o: clamp(F.when(o["op"] == "alpha", part(o)).when(o["op"] == "alphaMod", a * part(o)).otherwise(a + part(o))))
    first = F.get(fill["fills"], F.lit(0))
    solid = (
        F.when((F.size(fill["colours"]) != 1) | ~sound, state("unknown", "unsupported-fill")).when(alpha.isNull(), state("unknown", "theme-color-unresolved"))
        .when(alpha == 1, state("opaque", "solid-fill", alpha)).otherwise(state("not-opaque", "solid-fill", alpha))
    )
    shape = (
        F.when(~fill["has_properties"] | (F.size(fill["fills"]) != 1), state("unknown", "fill-unresolved")).when(first == "noFill", state("not-opaque", "no-fill", F.lit(0.0)))
        .when(first != "solidFill", state("unknown", "unsupported-fill")).when(~fill["preset"].eqNullSafe(F.lit("rect")), state("unknown", "unsupported-shape-geometry"))
        .when(fill["effects"], state("unknown", "shape-effects-unresolved")).otherwise(solid)
    )
    fixed = lambda o: (o["op"] == "alphaModFix") & F.coalesce(o["val"] == 100000, F.lit(False))
    deciding = F.get(F.filter(fill["blip_effects"], lambda o: ~fixed(o) & ~o["op"].isin(*KEPT_EFFECTS)), F.lit(0))
    faded = (deciding["op"] == "alphaModFix") & F.coalesce(deciding["val"].between(0, 99999), F.lit(False))
    picture = (
        F.when(~fill["preset"].eqNullSafe(F.lit("rect")), state("unknown", "unsupported-shape-geometry")).when(fill["effects"], state("unknown", "shape-effects-unresolved"))
        .when(~fill["has_blip"] | (F.coalesce(fill["embed"], F.lit("")) == ""), state("unknown", "image-reference-unresolved"))
        .when(deciding.isNull(), state("unknown", "embedded-image")).when(faded, state("not-opaque", "image-alpha-effect", deciding["val"] / 100000.0))
        .when(deciding["op"].startswith("alpha"), state("unknown", "image-alpha-effect")).otherwise(state("unknown", "image-effects-unresolved"))
    )
    return F.when(kind == "picture", picture).when(kind == "shape", shape).otherwise(state("unknown", "unsupported-shape-kind"))
