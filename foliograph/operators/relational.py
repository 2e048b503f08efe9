"""The relational operators behind the rules and the finding pipeline; they take any tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliograph.functions import canonical, geometry
from foliograph.plans.work import keep


def missing(edges: DataFrame, targets: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Edges whose target isn't there."""
    return edges.join(targets, on, "left_anti")


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[f"_{k}"])
    return out


def first_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key by order; `repeats` tells how many more had the key.

    Ranks are limited before the shuffle, and keys are counted by hash beside them: nothing is aggregated by sorting.
    """
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
    counts = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg((F.count("*") - 1).alias("repeats"))
    return first.join(counts, _same(first, counts, keys)).select(*[first[c] for c in rows.columns], "repeats")


def first_of_few(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """first_wins where a key has few rows, as within a part: one window, one shuffle."""
    w = Window.partitionBy(*keys)
    counted = rows.withColumns({"_n": F.row_number().over(w.orderBy(*order)), "repeats": F.count("*").over(w) - 1})
    return counted.where("_n = 1").drop("_n")


def last_wins(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The last row of each key by order; rows are read once, and ranks are limited before the shuffle."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))).where("_n = 1").drop("_n")


def last_value_first_place(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Of rows with one key the last by order, at the place of the first; ranks are limited before the shuffle."""
    rest = [c for c in rows.columns if c not in (*keys, order)]
    last = last_wins(rows, keys, order)
    place = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min(order).alias("_place"))
    return last.join(place, _same(last, place, keys)).select(*[last[k] for k in keys], F.col("_place").alias(order), *[last[c] for c in rest])


def duplicated(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that several rows have, with their number."""
    return rows.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1")


def override_or_default(rows: DataFrame, overrides: DataFrame, defaults: DataFrame, override_keys: Sequence[str], default_keys: Sequence[str], value: str) -> DataFrame:
    """Adds value: that of the override for the row's keys, else the default for its other keys, else null."""
    over = overrides.select(*override_keys, F.col(value).alias("_over"))
    default = defaults.select(*default_keys, F.col(value).alias("_default"))
    joined = rows.join(over, list(override_keys), "left").join(default, list(default_keys), "left")
    return joined.select(*rows.columns, F.coalesce("_over", "_default").alias(value))


def limit_status(rows: DataFrame, group: str, size: Column, packed: Column, part_limit: int, total_limit: int, ratio_limit: float) -> DataFrame:
    """Adds status: the limit that a row breaks, or that its group breaks for all its rows; else ok.

    A ratio of 0/0 is 1 and of n/0 is infinite. Groups are summed before the shuffle and joined back, so Spark can split
    a group with very many rows.
    """
    ratio = F.when(packed > 0, size / packed).when(size == 0, 1.0).otherwise(float("inf"))
    totals = rows.groupBy(group).agg(F.sum(size).alias("_total"))
    own = F.when(size > part_limit, "part-size").when(ratio > ratio_limit, "ratio")
    return rows.join(totals, group).withColumn("status", F.when(F.col("_total") > total_limit, "total-size").otherwise(F.coalesce(own, F.lit("ok")))).drop("_total")


def first_ranked(sources: DataFrame, keys: Sequence[str], rank: str, value: str) -> DataFrame:
    """Of each key's sources with a value, that of lowest rank: value and rank. It isn't checked here whether it is valid."""
    picked = F.min(F.struct(F.col(rank), F.col(value)))
    return sources.where(F.col(value).isNotNull()).groupBy(*keys).agg(picked.alias("_p")).select(*keys, F.col(f"_p.{value}").alias(value), F.col(f"_p.{rank}").alias(rank))


def outside(rows: DataFrame, polygon: str, frame: str, tolerance: float, least: float) -> DataFrame:
    """Rows whose polygon reaches over the frame's rectangle by more than tolerance, with edges and the ratio outside."""
    box, room = geometry.bounds(F.col(polygon)), F.col(frame)
    right, bottom = room["x"] + room["width"], room["y"] + room["height"]
    edges = F.array_sort(F.array_compact(F.array(
        F.when(box["x"] < room["x"] - tolerance, "left"), F.when(box["y"] < room["y"] - tolerance, "top"),
        F.when(box["x"] + box["width"] > right + tolerance, "right"), F.when(box["y"] + box["height"] > bottom + tolerance, "bottom"),
    )))
    over = rows.withColumns({"edges": edges, "area": geometry.area(F.col(polygon)), "_box": box}).where("size(edges) > 0 AND area > 0")
    # a polygon that fills its bounds is an unrotated box: its share is a product, and only boxes that fail are clipped
    is_box = F.col("area") == F.col("_box.width") * F.col("_box.height")
    share = lambda inside: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("area") - inside) / F.col("area")))
    over = over.withColumn("_share", F.when(is_box, share(geometry.boxes_share(F.col("_box"), room)))).where(F.col("_share").isNull() | canonical.at_least(F.col("_share"), least))
    over = over.withColumn("_cut", geometry.intersection(F.col(polygon), geometry.rectangle(room["x"], room["y"], room["width"], room["height"])))
    over = over.withColumns({"inside": F.col("_cut.polygon"), "inside_area": F.col("_cut.area")}).drop("_cut", "_box", "_share")
    return over.withColumn("outside_ratio", share(F.col("inside_area"))).where(canonical.at_least(F.col("outside_ratio"), least))


#: Rows of a group that are few enough to meet each other, and cells of a grid's side at most.
FEW, SIDE = 32, 512


def with_grid(rows: DataFrame, group: Sequence[str], box: str) -> DataFrame:
    """Adds `grid`: a grid over a group's boxes, of about a cell a row, no cell smaller than the mean box.

    Groups of few rows have one cell. So boxes lie in a few cells each, and only those of a cell need to meet.
    """
    w, b = Window.partitionBy(*group), F.col(box)
    n = F.count("*").over(w)
    ends = {"x": F.min(b["x"]).over(w), "y": F.min(b["y"]).over(w), "right": F.max(b["x"] + b["width"]).over(w), "bottom": F.max(b["y"] + b["height"]).over(w), "wide": F.avg(b["width"]).over(w), "high": F.avg(b["height"]).over(w), "n": n}
    rows = rows.withColumn("_g", F.struct(*[v.alias(k) for k, v in ends.items()]))
    g = F.col("_g")
    side = lambda size, mean: F.when(g["n"] > FEW, F.greatest(F.lit(1), F.least(F.lit(SIDE), F.ceil(F.sqrt(g["n"])), F.floor(size / mean)))).otherwise(1).cast("int")
    across, down = side(g["right"] - g["x"], g["wide"]), side(g["bottom"] - g["y"], g["high"])
    grid = F.struct(g["x"].alias("x"), g["y"].alias("y"), ((g["right"] - g["x"]) / across).alias("cell_w"), ((g["bottom"] - g["y"]) / down).alias("cell_h"), across.alias("across"), down.alias("down"))
    return rows.withColumn("grid", grid).drop("_g")


def _cell(at: Column, start: Column, size: Column, count: Column) -> Column:
    """The place of a coordinate on a grid's side, at its ends where it lies beyond."""
    return F.when(count == 1, 0).otherwise(F.greatest(F.lit(0), F.least(count - 1, F.floor((at - start) / size)))).cast("int")


def meeting(first: DataFrame, second: DataFrame, group: Sequence[str], condition: Column) -> DataFrame:
    """Pairs of a group's rows whose bounds overlap; columns but the group's start with a_ and b_. Rows have `bounds` and `grid` (see with_grid).

    Rows meet in each cell that both reach; the pair counts in the cell of its overlap's first corner only.
    """

    def in_cells(rows: DataFrame, p: str) -> DataFrame:
        b, g = F.col("bounds"), F.col("grid")
        x = F.sequence(_cell(b["x"], g["x"], g["cell_w"], g["across"]), _cell(b["x"] + b["width"], g["x"], g["cell_w"], g["across"]))
        y = F.sequence(_cell(b["y"], g["y"], g["cell_h"], g["down"]), _cell(b["y"] + b["height"], g["y"], g["cell_h"], g["down"]))
        cells = F.flatten(F.transform(y, lambda j: F.transform(x, lambda i: j * g["across"] + i)))
        return rows.select(*group, F.explode(cells).alias("cell"), *[F.col(c).alias(p + c) for c in rows.columns if c not in group])

    pairs = in_cells(first, "a_").join(in_cells(second, "b_"), [*group, "cell"])
    a, b, g = F.col("a_bounds"), F.col("b_bounds"), F.col("a_grid")
    corner = _cell(F.greatest(a["y"], b["y"]), g["y"], g["cell_h"], g["down"]) * g["across"] + _cell(F.greatest(a["x"], b["x"]), g["x"], g["cell_w"], g["across"])
    return pairs.where(condition & boxes_meet(a, b) & (F.col("cell") == corner)).drop("cell", "a_grid", "b_grid")


def boxes_meet(a: Column, b: Column) -> Column:
    """Whether two bounds overlap: without it the polygons can't, so it may stand in a join before the clip."""
    return (a["x"] < b["x"] + b["width"]) & (b["x"] < a["x"] + a["width"]) & (a["y"] < b["y"] + b["height"]) & (b["y"] < a["y"] + a["height"])


def baseline_status(current: DataFrame, baseline: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, status: new (only current), existing (both) or resolved (only baseline)."""
    a, b = current.select(*keys, F.lit(True).alias("_now")).distinct(), baseline.select(*keys, F.lit(True).alias("_then")).distinct()
    status = F.when(F.col("_then").isNull(), "new").when(F.col("_now").isNull(), "resolved").otherwise("existing")
    return a.join(b, list(keys), "full_outer").select(*keys, status.alias("status"))


def first_suppression(findings: DataFrame, suppressions: DataFrame, rule: str, selectors: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Adds suppressed_by: the smallest idx of a suppression of the rule whose selectors that are set all equal the finding's.

    suppressions is a command's configuration, of a few rows; findings keep their place and only pairs that match meet.
    """
    s = F.broadcast(suppressions.select(F.col("idx"), F.col("rule").alias("_rule"), *[F.col(x).alias(f"_{x}") for x in selectors]))
    match = findings[rule] == s["_rule"]
    for x in selectors:
        match = match & (s[f"_{x}"].isNull() | (s[f"_{x}"] == findings[x]))
    hits = findings.join(s, match).groupBy(*key).agg(F.min("idx").alias("suppressed_by"))
    return findings.join(hits, list(key), "left")


def severity_counts(rows: DataFrame, group: str | None, severity: str = "severity") -> DataFrame:
    """errors, warnings, total of each group and, as the null group, of all."""
    aggs = [F.count_if(F.col(severity) == "error").alias("errors"), F.count_if(F.col(severity) == "warning").alias("warnings"), F.count("*").alias("total")]
    return rows.rollup(group).agg(*aggs) if group else rows.agg(*aggs)


def places(rows: DataFrame, group: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Adds name: 1, 2, 3, ... in each group by order. No group is sorted in one task.

    Spark's range partitioning by group and order cuts even one group into many ranges; rows are numbered in their
    partition's part of the group, and shifted by the counts of the partitions before.
    """
    dealt = keep(rows.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy(*group, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0).cast("long"))).drop("_n")
    inside = dealt.withColumn("_r", F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*order)))
    same = F.lit(True)
    for c in (*group, "_part"):
        same = same & inside[c].eqNullSafe(starts[c])
    return inside.join(starts, same).select(*[inside[c] for c in rows.columns], (F.col("_r") + F.col("_start")).alias(name))
