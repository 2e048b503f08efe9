"""Queries over generated packages: one for each row of part, inspected in one job, each with SQL that derives the same rows from the columns.

A package's number tells what is wrong with it (sources/fixtures.py), and p_size by how much. The packages of a table are
parsed once in an application, and anew when the table's files change.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliograph.operators import package
from foliograph.plans import config, inspection, reports, work
from foliograph.sources import decks, fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Of one suppression of everything outside, one that fits some slides' media, and one that fits nothing.
QUIET = {"extends": ["recommended"], "ignore": [{"rule": "layout/outside-slide", "shapeIds": [4]}, {"rule": "package/missing-media", "slide": 1, "part": "PPT/slides/slide1.xml"}, {"rule": "text/min-font-size", "slide": 2}]}
#: Packages that are written into a folder, about; no folder is listed by more than a task.
A_FOLDER = 10_000
_KNOWN: dict[tuple, inspection.Facts] = {}
_FOUND_ROWS: dict[tuple, DataFrame] = {}

#: n, s and kind of each package, and its name.
DECKS = f"SELECT p_partkey AS n, p_size AS s, p_partkey % {len(fixtures.KINDS)} AS k, 'decks/' || p_partkey || '.pptx' AS input_key FROM part"
SLIDE, RELS = "ppt/slides/slide1.xml", "http://schemas.openxmlformats.org/officeDocument/2006/relationships/"
#: A number as JSON has it: rounded to so many digits, halves up, without a trailing zero.
NUMBER = "regexp_replace(printf('%.{d}f', floor(({x}) * 1e{d} + 0.5) / 1e{d}), '\\.?0+$', '')"


def number(x: str, digits: int) -> str:
    return NUMBER.format(x=x, d=digits)


def box(x: str, width: str, y: int = 0, height: int = 1000000, scale: int = 1) -> str:
    return "'{\"height\":' || " + number(f"{height} / {scale}.0", 3) + " || ',\"width\":' || " + number(f"({width}) / {scale}.0", 3) + " || ',\"x\":' || " + number(f"({x}) / {scale}.0", 3) + " || ',\"y\":' || " + number(f"{y} / {scale}.0", 3) + " || '}'"


def edge(kind: str, target: str, resolved: str, rel_id: str = "rId8", rels: str = "ppt/slides/_rels/slide1.xml.rels", source: str = f'"{SLIDE}"', more: str = "", slide: str = "") -> str:
    return f"""'{{{more}"rawTarget":"' || {target} || '",{slide}"relationshipId":"{rel_id}","relationshipPart":"{rels}","relationshipType":"{RELS}{kind}","resolvedTarget":"' || {resolved} || '","sourcePart":{source}}}'"""


_WIDE = "(1000000 + 10000 * s)"
#: kind, rule, severity, part, on a slide, shape ids, paragraph and run, evidence, and what tells findings of a place apart.
RULES = (
    (1, "layout/outside-slide", "warning", SLIDE, True, "4", None, f"""'{{"affectedEdges":["right"],"boundsEmu":' || {box('11692000', _WIDE, 2000000, 500000)} || ',"boundsPt":' || {box('11692000', _WIDE, 2000000, 500000, 12700)} || ',"intersectionAreaEmu2":250000000000,"intersectionPolygonEmu":[{{"x":11692000,"y":2000000}},{{"x":12192000,"y":2000000}},{{"x":12192000,"y":2500000}},{{"x":11692000,"y":2500000}}],"minOutsideRatio":0.05,"outsideAreaEmu2":' || {number(f'({_WIDE} - 500000) * 500000.0', 3)} || ',"outsideRatio":' || {number(f'({_WIDE} - 500000) / {_WIDE}', 6)} || ',"shapeId":4,"shapeName":"Wide","slideBoundsEmu":{{"height":6858000,"width":12192000,"x":0,"y":0}},"toleranceEmu":25400,"tolerancePt":2}}'""", "'4'"),
    (2, "text/min-font-size", "error", SLIDE, True, "5", "0", f"""'{{"baseFontSizePt":' || {number('5 + s / 10.0', 3)} || ',"configuredMinimumPt":12,"placeholderKind":"other","sizeProvenance":{{"rawValue":"' || (500 + 10 * s) || '","sourceKind":"run-properties","sourcePart":"{SLIDE}"}},"textBodyIndex":0}}'""", r"'5\u00000\u00000\u00000'"),
    (3, "text/autofit-scale-below-minimum", "error", SLIDE, True, "6", "0", f"""'{{"baseFontSizePt":16,"baseSizeProvenance":{{"rawValue":"1600","sourceKind":"run-properties","sourcePart":"{SLIDE}"}},"configuredMinimumPt":12,"effectiveFontSizePt":' || {number('16 * (0.5 + 0.004 * s)', 3)} || ',"fontScaleRatio":' || {number('0.5 + 0.004 * s', 6)} || ',"placeholderKind":"other","rawFontScale":"' || (50000 + 400 * s) || '","scaleSourceKind":"slide-body-properties","scaleSourcePart":"{SLIDE}","textBodyIndex":0}}'""", r"'6\u00000\u00000\u00000'"),
    (4, "package/missing-media", "error", SLIDE, True, "", None, edge("image", "'../media/gone' || n || '.png'", "'ppt/media/gone' || n || '.png'", more='"mediaKind":"image",', slide='"referencingSlide":1,'), r"'ppt/slides/_rels/slide1.xml.rels\u0000rId8\u0000ppt/media/gone' || n || '.png'"),
    (5, "package/broken-relationship", "error", SLIDE, False, "", None, edge("chart", "'../charts/gone' || n || '.xml'", "'ppt/charts/gone' || n || '.xml'"), r"'ppt/slides/_rels/slide1.xml.rels\u0000rId8\u0000ppt/charts/gone' || n || '.xml'"),
    (6, "package/malformed-xml", "error", "ppt/notes.xml", False, "", None, """'{"column":7,"diagnosticCode":"malformed-xml","diagnosticMessage":"mismatched tag","line":1,"offset":6,"partName":"ppt/notes.xml"}'""", "'ppt/notes.xml'"),
    (7, "layout/text-overlap", "warning", SLIDE, True, "2,3", None, f"""'{{"firstBoundsEmu":' || {box('0', '3000000')} || ',"firstBoundsPt":' || {box('0', '3000000', scale=12700)} || ',"firstShapeId":2,"firstShapeName":"Body","firstTextFrame":"shape","intersectionAreaEmu2":' || {number('(3000000 - 20000 * s) * 1000000.0', 3)} || ',"intersectionBoundsEmu":' || {box('20000 * s', '3000000 - 20000 * s')} || ',"intersectionPolygonEmu":[{{"x":' || (20000 * s) || ',"y":0}},{{"x":3000000,"y":0}},{{"x":3000000,"y":1000000}},{{"x":' || (20000 * s) || ',"y":1000000}}],"minOverlapRatio":0.2,"overlapRatio":' || {number('(3000000 - 20000 * s) / 3000000', 6)} || ',"secondBoundsEmu":' || {box('20000 * s', '3000000')} || ',"secondBoundsPt":' || {box('20000 * s', '3000000', scale=12700)} || ',"secondShapeId":3,"secondShapeName":"Over","secondTextFrame":"shape","smallerShapeId":2}}'""", r"'2\u00003'"),
    (8, "package/broken-relationship", "error", "_rels/.rels", False, "", None, edge("officeDocument", "'ppt/presentation.xml'", "'ppt/presentation.xml'", "rId1", "_rels/.rels", "null"), r"'_rels/.rels\u0000rId1\u0000ppt/presentation.xml'"),
    (11, "text/autofit-enabled", "warning", SLIDE, True, "7", None, f"""'{{"autofitKind":"runtime","rawFontScale":null,"reason":"No scale is stored.","sourceKind":"slide-body-properties","sourcePart":"{SLIDE}","textBodyIndex":0}}'""", r"'7\u00000'"),
)
_FOUND = " UNION ALL ".join(
    f"""SELECT input_key, n, '{rule}' AS rule_id, '{severity}' AS severity, '{part}' AS part, CAST({'1' if slide else 'NULL'} AS VARCHAR) AS slide_number, {"'256'" if slide else 'CAST(NULL AS VARCHAR)'} AS slide_id, '{ids}' AS shape_ids,
    CAST({at or 'NULL'} AS VARCHAR) AS paragraph, CAST({at or 'NULL'} AS VARCHAR) AS run, {evidence} AS evidence,
    sha256('{{"schemaVersion":1,"ruleId":"{rule}","inputKey":"' || input_key || '","part":"{part}","slideId":{'"256"' if slide else 'null'},"slideNumber":{'1' if slide else 'null'},"shapeIds":[{ids}],"discriminator":"' || {apart} || '"}}') AS fingerprint FROM d WHERE k = {k}"""
    for k, rule, severity, part, slide, ids, at, evidence, apart in RULES
)
FOUND = f"WITH d AS ({DECKS}), f AS ({_FOUND})"
#: The diagnostics of kinds, and the codes of the kinds whose analysis is incomplete.
DIAGNOSTICS = "SELECT input_key, 'missing-presentation-part' AS code, '_rels/.rels' AS part, 'rId1' AS rel_id FROM d WHERE k = 8 UNION ALL SELECT input_key, 'missing-content-types', '[Content_Types].xml', NULL FROM d WHERE k = 9 UNION ALL SELECT input_key, 'missing-presentation-relationship', 'ppt/slides/slide1.xml', NULL FROM d WHERE k = 10"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def rows_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size").repartition(spark.sparkContext.defaultParallelism)


def state(spark: SparkSession, sf_dir: str) -> tuple:
    """What tells one state of the table from another: its files' names, sizes and times."""
    files = spark.read.parquet(f"{sf_dir}/part.parquet").select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    return spark.sparkContext.applicationId, sf_dir, *sorted(tuple(map(str, r)) for r in files.collect())


def known(spark: SparkSession, sf_dir: str, build: Callable[[int, int], bytes] = fixtures.generated) -> inspection.Facts:
    at = (*state(spark, sf_dir), build.__name__)
    if at not in _KNOWN:
        _KNOWN[at] = inspection.facts(decks.decks(fixtures.generated_files(rows_of(spark, sf_dir), build)), with_rasters=True)
    return _KNOWN[at]


def found(spark: SparkSession, sf_dir: str, given: dict | None = None) -> tuple[inspection.Facts, DataFrame, config.Config]:
    f, c = known(spark, sf_dir), config.resolve(given)
    at = (*state(spark, sf_dir), config.digest(c))
    if at not in _FOUND_ROWS:
        _FOUND_ROWS[at] = inspection.findings(f, c)
    return f, inspection.suppressed(_FOUND_ROWS[at], c), c


LOCATED = ("input_key", "rule_id", "severity", "part", "slide_number", "slide_id", "paragraph", "run", "evidence", "fingerprint")


@query(f"{FOUND} SELECT {', '.join(LOCATED)}, shape_ids FROM f")
def q_deck_findings(spark, sf_dir):
    """Every finding with its place, evidence and fingerprint."""
    return found(spark, sf_dir)[1].select(*[F.col(c).cast("string").alias(c) for c in LOCATED], F.coalesce(F.array_join("shape_ids", ","), F.lit("")).alias("shape_ids"))


@query(f"WITH d AS ({DECKS}) {DIAGNOSTICS}")
def q_deck_diagnostics(spark, sf_dir):
    return known(spark, sf_dir).diagnostics.select("input_key", "code", "part", "rel_id")


@query(f"""{FOUND}, c AS (SELECT input_key, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings FROM f GROUP BY 1),
    e AS (SELECT input_key, coalesce(errors, 0) AS errors, coalesce(warnings, 0) AS warnings, (k IN (8, 9, 10))::BIGINT AS diagnostics, CASE WHEN k = 8 THEN 5 ELSE 0 END AS skipped, k NOT IN (6, 8, 9, 10) AS complete, CASE WHEN k IN (9, 10) THEN 2 WHEN errors > 0 THEN 1 ELSE 0 END AS exit_code FROM d LEFT JOIN c USING (input_key))
    SELECT input_key, sum(errors)::BIGINT AS errors, sum(warnings)::BIGINT AS warnings, sum(diagnostics)::BIGINT AS diagnostics, sum(skipped)::BIGINT AS skipped, bool_and(complete) AS complete, max(exit_code)::INTEGER AS exit_code FROM e GROUP BY GROUPING SETS ((input_key), ())""")
def q_deck_summary(spark, sf_dir):
    """Counts, completeness and exit code of each package and, as the null input, of the command."""
    f = known(spark, sf_dir)
    (_, rows, c), _ = work.together(spark, lambda: found(spark, sf_dir), lambda: f.diagnostics)
    rows, _ = inspection.classified(rows, None, f.files)
    return inspection.summary(f, rows, c).select("input_key", *[F.col(n).cast("long").alias(n) for n in ("errors", "warnings", "diagnostics", "skipped")], "complete", F.col("exit_code").cast("int").alias("exit_code"))


_SUPPRESSED = "CASE WHEN rule_id = 'layout/outside-slide' THEN 0 WHEN rule_id = 'package/missing-media' THEN 1 END"


@query(f"""{FOUND} SELECT input_key, fingerprint, CAST({_SUPPRESSED} AS VARCHAR) AS suppressed_by, CASE WHEN n % 5 = 0 AND {_SUPPRESSED} IS NULL THEN 'existing' ELSE 'new' END AS status FROM f
    UNION ALL SELECT input_key, fingerprint, NULL, 'resolved' FROM f WHERE n % 5 = 0 AND {_SUPPRESSED} IS NOT NULL UNION ALL SELECT input_key, sha256(input_key), NULL, 'resolved' FROM d""")
def q_deck_baseline(spark, sf_dir):
    """Suppressions first, then the baseline: a fifth of the findings, and one of each package that is gone."""
    f, rows, _ = found(spark, sf_dir, QUIET)
    fifth = F.regexp_extract("input_key", r"(\d+)", 1).cast("long") % 5 == 0
    gone = f.files.select("input_key", F.sha2("input_key", 256).alias("fingerprint"))
    rows, resolved = inspection.classified(rows, rows.where(fifth).select("input_key", "fingerprint").unionByName(gone), f.files)
    return rows.select("input_key", "fingerprint", F.col("suppressed_by").cast("string").alias("suppressed_by"), "status").unionByName(resolved.select("input_key", "fingerprint", F.lit(None).cast("string").alias("suppressed_by"), F.lit("resolved").alias("status")))


@query(f"WITH d AS ({DECKS}) SELECT input_key, CAST(i AS INTEGER) AS idx FROM d, (VALUES (0), (1), (2)) AS t(i) WHERE NOT (i = 0 AND k = 1) AND NOT (i = 1 AND k = 4)")
def q_deck_unused(spark, sf_dir):
    f, rows, c = found(spark, sf_dir, QUIET)
    return inspection.unused(rows, f.files, c).select("input_key", F.col("idx").cast("int").alias("idx"))


@query(f"""WITH d AS ({DECKS}) SELECT input_key, CAST(1 AS INTEGER) AS number, '256' AS slide_id, '{SLIDE}' AS slide_part, CASE WHEN k <> 10 THEN 'ppt/slideLayouts/slideLayout1.xml' END AS layout_part,
    CASE WHEN k <> 10 THEN 'ppt/slideMasters/slideMaster1.xml' END AS master_part, CASE WHEN k <> 10 THEN 'ppt/theme/theme1.xml' END AS theme_part, CAST(12192000 AS BIGINT) AS width FROM d WHERE k <> 8""")
def q_deck_slides(spark, sf_dir):
    """Slides in order, with their chains."""
    return known(spark, sf_dir).slides.select("input_key", F.col("number").cast("int").alias("number"), "slide_id", "slide_part", "layout_part", "master_part", "theme_part", F.col("size.cx").alias("width"))


_EDGES = ", ".join(f"('{r}', '{i}', '{t}')" for r, i, t in (
    ("_rels/.rels", "rId1", "ppt/presentation.xml"), ("ppt/_rels/presentation.xml.rels", "rId1", "ppt/slideMasters/slideMaster1.xml"), ("ppt/_rels/presentation.xml.rels", "rId2", SLIDE), ("ppt/slideMasters/_rels/slideMaster1.xml.rels", "rId1", "ppt/slideLayouts/slideLayout1.xml"),
    ("ppt/slideMasters/_rels/slideMaster1.xml.rels", "rId2", "ppt/theme/theme1.xml"), ("ppt/slideLayouts/_rels/slideLayout1.xml.rels", "rId1", "ppt/slideMasters/slideMaster1.xml"), ("ppt/slides/_rels/slide1.xml.rels", "rId1", "ppt/slideLayouts/slideLayout1.xml"),
))


@query(f"""WITH d AS ({DECKS}) SELECT input_key, r AS rels_part, i AS id, t AS resolved, NOT (k = 8 AND t = 'ppt/presentation.xml') AS target_exists FROM d, (VALUES {_EDGES}) AS e(r, i, t) WHERE NOT (k = 10 AND r = 'ppt/slides/_rels/slide1.xml.rels')
    UNION ALL SELECT input_key, 'ppt/slides/_rels/slide1.xml.rels', 'rId8', CASE k WHEN 4 THEN 'ppt/media/gone' || n || '.png' ELSE 'ppt/charts/gone' || n || '.xml' END, false FROM d WHERE k IN (4, 5)""")
def q_deck_edges(spark, sf_dir):
    """Relationships, their targets resolved and looked up."""
    return known(spark, sf_dir).edges.select("input_key", "rels_part", "id", "resolved", "target_exists")


_PARTS = ", ".join(f"('{p}')" for p in ("[Content_Types].xml", "_rels/.rels", "ppt/presentation.xml", "ppt/_rels/presentation.xml.rels", "ppt/slideMasters/slideMaster1.xml", "ppt/slideMasters/_rels/slideMaster1.xml.rels", "ppt/slideLayouts/slideLayout1.xml", "ppt/slideLayouts/_rels/slideLayout1.xml.rels", "ppt/theme/theme1.xml", SLIDE, "ppt/slides/_rels/slide1.xml.rels", "ppt/notes.xml"))
_HELD = "NOT (k = 8 AND p = 'ppt/presentation.xml') AND NOT (k = 9 AND p = '[Content_Types].xml') AND NOT (k = 10 AND p = 'ppt/slides/_rels/slide1.xml.rels') AND (k = 6 OR p <> 'ppt/notes.xml')"


@query(f"""WITH d AS ({DECKS}) SELECT input_key, p AS part_name, CASE WHEN k = 9 THEN NULL WHEN p LIKE '%.rels' THEN 'application/vnd.openxmlformats-package.relationships+xml' WHEN p = '{SLIDE}' THEN 'application/vnd.openxmlformats-officedocument.presentationml.slide+xml' ELSE 'application/xml' END AS content_type,
    k <> 9 AS is_xml FROM d, (VALUES {_PARTS}) AS t(p) WHERE {_HELD}""")
def q_deck_types(spark, sf_dir):
    """Content types of parts, by override or default."""
    return known(spark, sf_dir).types


@query(f"""WITH d AS ({DECKS}) SELECT input_key, p AS part_name, lower(p) AS part_key, true AS alone, CASE WHEN p = 'ppt/notes.xml' THEN 'malformed-xml' END AS code, CAST(CASE WHEN n % 2 = 1 THEN 8 ELSE 0 END AS INTEGER) AS method FROM d, (VALUES {_PARTS}) AS t(p) WHERE {_HELD}""")
def q_deck_entries(spark, sf_dir):
    """Entries of packages that are files, read by ranges: canonical names, whether their XML could be read, and how they are stored."""
    rows, at = rows_of(spark, sf_dir), f"{work.folder(spark)}/packages-{uuid.uuid4().hex}"
    folders = [f"{at}/{i}" for i in range(rows.count() // A_FOLDER + 1)]
    fixtures.write_files(rows, folders).write.format("noop").mode("overwrite").save()
    files = decks.scan(spark, *folders).drop("source_sha256")
    return decks.named_entries(files)[0].select("input_key", "part_name", "part_key", "alone", F.col("xml.code").alias("code"), "method")


_MORE = "(1, 4, 11692000, 2000000, NULL), (2, 5, 0, 2000000, NULL), (3, 6, 0, 2000000, NULL), (7, 3, NULL, 0, NULL), (11, 7, 0, 2000000, NULL)"
_SHAPES = f"SELECT input_key, k, s, 2 AS id, 0 AS z, 0 AS x, 0 AS y FROM d WHERE k <> 8 UNION ALL SELECT input_key, k, s, m.id, 1, coalesce(m.x, 20000 * s), m.y FROM d JOIN (VALUES {_MORE}) AS m(kk, id, x, y, o) ON m.kk = d.k"


@query(f"""WITH d AS ({DECKS}), l AS ({_SHAPES}) SELECT input_key, CAST(z AS INTEGER) AS z, CAST(id AS BIGINT) AS shape_id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(CASE WHEN id = 4 THEN 1000000 + 10000 * s ELSE 3000000 END AS DOUBLE) AS width, CAST(CASE WHEN id = 4 THEN 500000 ELSE 1000000 END AS DOUBLE) AS height FROM l""")
def q_deck_shapes(spark, sf_dir):
    """Leaf shapes in z-order, with their bounds on the slide."""
    return known(spark, sf_dir).leaves.select("input_key", F.col("z").cast("int").alias("z"), "shape_id", "bounds.x", "bounds.y", "bounds.width", "bounds.height")


@query(f"""WITH d AS ({DECKS}), l AS ({_SHAPES}) SELECT input_key, CAST(id AS BIGINT) AS shape_id, CASE id WHEN 5 THEN round(5 + s / 10.0, 6) WHEN 6 THEN 16.0 ELSE 18.0 END::DOUBLE AS base_pt, CASE id WHEN 5 THEN round(5 + s / 10.0, 6) WHEN 6 THEN round(16 * (0.5 + 0.004 * s), 6) WHEN 7 THEN NULL ELSE 18.0 END::DOUBLE AS effective_pt,
    CASE WHEN id IN (6, 7) THEN 'runtime' ELSE 'none' END AS autofit, 'other' AS placeholder_kind, 'latin' AS slots, CASE WHEN id IN (5, 6) THEN 'run-properties' ELSE 'presentation-default-text-style' END AS size_source FROM l""")
def q_deck_runs(spark, sf_dir):
    """Runs with the sizes that the style chain gives them, and where these come from."""
    return known(spark, sf_dir).runs.select("input_key", "shape_id", F.round("base_pt", 6).alias("base_pt"), F.round("effective_pt", 6).alias("effective_pt"), F.col("autofit.kind").alias("autofit"), "placeholder_kind", F.array_join("slots", ",").alias("slots"), F.col("size_source.kind").alias("size_source"))


@query(f"""{FOUND} SELECT input_key, json_array_length(json_extract(document, '$.findings'))::BIGINT AS findings, json_extract_string(document, '$.input.inputKey') AS named, json_extract_string(document, '$.findings[0].fingerprint') AS first FROM (
    SELECT d.input_key, '{{"input":{{"inputKey":"' || d.input_key || '"}},"findings":[' || coalesce(string_agg('{{"fingerprint":"' || fingerprint || '"}}', ','), '') || ']}}' AS document FROM d LEFT JOIN f USING (input_key) GROUP BY d.input_key)""")
def q_deck_documents(spark, sf_dir):
    """A JSON document of each package."""
    f = known(spark, sf_dir)
    (_, rows, c), _ = work.together(spark, lambda: found(spark, sf_dir), lambda: f.diagnostics)
    rows, _ = inspection.classified(rows, None, f.files)
    done = {"findings": rows, "unused": inspection.unused(rows, f.files, c), "resolved": None, "diagnostics": f.diagnostics, "skipped": inspection.skipped(f, c), "summary": inspection.summary(f, rows, c), "facts": f}
    value = lambda path: F.get_json_object("document", path)
    return reports.documents(done).select("input_key", F.json_array_length(value("$.findings")).cast("long").alias("findings"), value("$.input.inputKey").alias("named"), value("$.findings[0].fingerprint").alias("first"))


_INCOMING = f"""SELECT input_key, r, i, t FROM d, (VALUES {_EDGES}) AS e(r, i, t) WHERE NOT (k = 10 AND r = 'ppt/slides/_rels/slide1.xml.rels')
    UNION ALL SELECT input_key, 'ppt/slides/_rels/slide1.xml.rels', 'rId8', CASE k WHEN 4 THEN 'ppt/media/gone' || n || '.png' ELSE 'ppt/charts/gone' || n || '.xml' END FROM d WHERE k IN (4, 5)"""


@query(rf"""WITH d AS ({DECKS}), e AS ({_INCOMING}), s AS (SELECT *, lower(t) AS target_key, CASE WHEN r = '_rels/.rels' THEN '' ELSE regexp_replace(r, '_rels/([^/]*)\.rels$', '\1') END AS source FROM e)
    SELECT input_key, target_key, count(*) AS edges, string_agg(source || '#' || i, ',' ORDER BY source, i) AS sources FROM s GROUP BY ALL""")
def q_deck_incoming(spark, sf_dir):
    """The edges that lead to each part, there or not."""
    rows = package.incoming(known(spark, sf_dir).edges)
    named = F.struct(F.coalesce("source_part", F.lit("")).alias("s"), F.col("id").alias("i"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(named)), lambda x: F.concat(x["s"], F.lit("#"), x["i"])), ",")
    return rows.groupBy("input_key", "target_key").agg(F.count("*").alias("edges"), joined.alias("sources"))


@query(f"""WITH d AS ({DECKS}) SELECT input_key, p AS part_name, CASE WHEN p = 'ppt/none.xml' OR (k = 8 AND p = 'ppt/./presentation.xml') OR (k = 9 AND p = '[CONTENT_TYPES].xml') THEN 'part-not-found' ELSE 'ok' END AS status
    FROM d, (VALUES ('{SLIDE}'), ('ppt/./presentation.xml'), ('[CONTENT_TYPES].xml'), ('ppt/none.xml')) AS t(p)""")
def q_deck_part_status(spark, sf_dir):
    """Whether parts can be read, asked for by names in any case."""
    f = known(spark, sf_dir)
    names = F.array(*[F.lit(p) for p in (SLIDE, "ppt/./presentation.xml", "[CONTENT_TYPES].xml", "ppt/none.xml")])
    return package.part_status(f.parts, f.files.select("input_key", F.explode(names).alias("part_name")))


#: Packages of the kinds whose shapes cover, overlap, turn or inherit, under rules that are off by default too.
PLACED = f"SELECT p_partkey AS n, p_size AS s, p_partkey % {len(fixtures.PLACED_KINDS)} AS k, 'decks/' || p_partkey || '.pptx' AS input_key FROM part"
EVERY = {"extends": ["recommended"], "rules": {"layout/text-occluded": "error", "fonts/allowed": ["warning", {"families": ["arial "], "unresolved": "ignore"}]}}
_PLACED_RULES = (
    (0, "layout/text-occluded", "error", 1, "256", SLIDE, "2,3", number("s / 50.0", 6), "'solid-fill'", "s >= 10"),
    (1, "layout/text-occluded", "error", 1, "256", SLIDE, "2,3", number("s / 50.0", 6), "'ppt/media/photo.png'", "s >= 10"),
    (2, "fonts/allowed", "warning", 1, "256", SLIDE, "2", "CASE WHEN s % 2 = 1 THEN 'Yu Gothic' ELSE 'Face ' || s END", "CASE WHEN s % 2 = 1 THEN 'eastAsian' ELSE 'latin' END", "true"),
    (3, "layout/text-overlap", "warning", 1, "256", SLIDE, "21,30", number("1 - s / 100.0", 6), "'shape,shape'", "true"),
    (4, "layout/text-overlap", "warning", 1, "256", SLIDE, "2,3", number("1 - s / 50.0", 6), "'shape,shape'", "s <= 40"),
    (5, "layout/text-overlap", "warning", 1, "256", SLIDE, "5,6", number("1 - s / 50.0", 6), "'table:r1:c1,shape'", "s <= 40"),
    (6, "layout/outside-slide", "warning", 1, "256", "ppt/slides/slideB.xml", "4", "'0.5'", "'right'", "true"),
    (6, "layout/outside-slide", "warning", 2, "257", "ppt/slides/slideA.xml", "5", number("s / 100.0", 6), "'right'", "s >= 5"),
    (7, "text/min-font-size", "error", 1, "256", SLIDE, "2", "'18'", "'title'", "true"),
)
_PLACED_FOUND = " UNION ALL ".join(
    f"SELECT input_key, '{rule}' AS rule_id, '{severity}' AS severity, {at} AS slide_number, '{slide}' AS slide_id, '{part}' AS part, '{ids}' AS shape_ids, {value} AS value, {detail} AS detail FROM d WHERE k = {k} AND {when}"
    for k, rule, severity, at, slide, part, ids, value, detail, when in _PLACED_RULES
)


@query(f"WITH d AS ({PLACED}) {_PLACED_FOUND}")
def q_deck_placed(spark, sf_dir):
    """Findings of covered, overlapping, turned, grouped and inherited shapes, table cells, typefaces and several slides, with what decides them."""
    c = config.resolve(EVERY)
    rows = inspection.findings(known(spark, sf_dir, fixtures.generated_placed), c)
    of = lambda *keys: F.coalesce(*[F.get_json_object("evidence", f"$.{k}") for k in keys])
    frames = F.concat_ws(",", of("firstTextFrame"), of("secondTextFrame"))
    detail = F.when(F.col("rule_id") == "layout/text-overlap", frames).otherwise(of("mediaPart", "opacityBasis", "scriptSlot", "affectedEdges[0]", "placeholderKind"))
    return rows.select("input_key", "rule_id", "severity", "slide_number", "slide_id", "part", F.array_join("shape_ids", ",").alias("shape_ids"), of("occludedRatio", "overlapRatio", "outsideRatio", "resolvedTypeface", "baseFontSizePt").alias("value"), detail.alias("detail"))


_PLACED_SHAPES = """(0, 1, 0, 2, 'shape', 0, 0, 3000000, 1000000, ''), (0, 1, 1, 3, 'shape', 0, 0, 60000 * s, 1000000, ''), (1, 1, 0, 2, 'shape', 0, 0, 3000000, 1000000, ''), (1, 1, 1, 3, 'picture', 0, 0, 60000 * s, 1000000, ''),
    (2, 1, 0, 2, 'shape', 0, 0, 3000000, 1000000, ''), (3, 1, 0, 21, 'shape', 1000000, 1000000, 1000000, 1000000, '20'), (3, 1, 1, 30, 'shape', 1000000 + 10000 * s, 1000000, 1000000, 1000000, ''), (4, 1, 0, 2, 'shape', 500000, 1500000, 4000000, 1000000, ''),
    (4, 1, 1, 3, 'shape', 4100000 + 8000 * s, 1600000, 400000, 400000, ''), (5, 1, 0, 5, 'graphic-frame', 0, 0, 4000000, 2000000, ''), (5, 1, 1, 6, 'shape', 2000000 + 40000 * s, 1000000, 2000000, 1000000, ''),
    (6, 1, 0, 4, 'shape', 11692000, 0, 1000000, 100000, ''), (6, 2, 0, 5, 'shape', 11192000 + 10000 * s, 0, 1000000, 100000, ''), (7, 1, 0, 2, 'shape', 10000 * s, 0, 2000000, 500000, '')"""


@query(f"""WITH d AS ({PLACED}) SELECT input_key, CAST(m.number AS INTEGER) AS number, CAST(z AS INTEGER) AS z, CAST(id AS BIGINT) AS shape_id, kind, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(w AS DOUBLE) AS width, CAST(h AS DOUBLE) AS height, g AS groups
    FROM d, LATERAL (VALUES {_PLACED_SHAPES}) AS m(kk, number, z, id, kind, x, y, w, h, g) WHERE kk = k""")
def q_deck_places(spark, sf_dir):
    """Bounds of leaf shapes: in a scaling group, turned, inherited from the layout, pictures and tables, on several slides."""
    rows = known(spark, sf_dir, fixtures.generated_placed).leaves
    return rows.select("input_key", F.col("number").cast("int").alias("number"), F.col("z").cast("int").alias("z"), "shape_id", "kind", *[F.col(f"bounds.{c}").alias(c) for c in ("x", "y", "width", "height")], F.array_join("group_ids", ",").alias("groups"))
