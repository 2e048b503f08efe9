"""The operators on the driver's parquet tables, each with SQL that gives the same rows.

These generalise the document operators: orders and lineitems stand for relationships and parts, numeric columns for
rectangles, sources for inputs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliograph.functions import canonical, geometry, paths, text
from foliograph.operators import relational as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: All columns of lineitem, as a total order: its keys repeat.
LINE_ORDER = ("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
LINE_ORDER_SQL = ", ".join(LINE_ORDER)


def placed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineitems with their place in the order, and a rectangle made of their numbers."""
    w = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    lines = table(spark, sf_dir, "lineitem").withColumn("pos", F.row_number().over(w))
    return lines.select("l_orderkey", "pos", "l_returnflag", F.col("l_quantity").alias("x"), F.col("l_linenumber").cast("double").alias("y"), (F.floor(F.col("l_discount") * 100 + 0.5) + 1).cast("double").alias("w"), (F.floor(F.col("l_tax") * 100 + 0.5) + 1).cast("double").alias("h"))


PLACED = f"""SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_ORDER_SQL}) AS INTEGER) AS pos, l_returnflag, l_quantity AS x,
    CAST(l_linenumber AS DOUBLE) AS y, floor(l_discount * 100 + 0.5) + 1 AS w, floor(l_tax * 100 + 0.5) + 1 AS h FROM lineitem"""


@query("SELECT 'label' AS kind, doc_id AS id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) UNION ALL SELECT 'lineitem', o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
def q_missing_reference(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    orders, lines = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"))
    return R.missing(docs, labels, "doc_id").select(F.lit("label").alias("kind"), F.col("doc_id").alias("id")).unionByName(R.missing(orders, lines, "id").select(F.lit("lineitem").alias("kind"), "id"))


@query("SELECT CASE WHEN o_orderstatus = 'F' THEN 'missing-media' ELSE 'broken-relationship' END AS rule, o_orderkey, o_orderpriority FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
def q_missing_by_kind(spark, sf_dir):
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    kind = F.when(F.col("o_orderstatus") == "F", "missing-media").otherwise("broken-relationship")
    return R.missing(orders, lines, "o_orderkey").select(kind.alias("rule"), "o_orderkey", "o_orderpriority")


@query("SELECT o_orderkey, c_name, n_name FROM orders o LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
def q_ref_with_context(spark, sf_dir):
    gone = R.missing(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return gone.join(customer, gone.o_custkey == customer.c_custkey, "left").join(F.broadcast(nation), customer.c_nationkey == nation.n_nationkey, "left").select("o_orderkey", "c_name", "n_name")


@query("""SELECT o_orderkey, c_custkey, n_nationkey, r_regionkey,
    CASE WHEN c_custkey IS NULL THEN 'customer' WHEN n_nationkey IS NULL THEN 'nation' WHEN r_regionkey IS NULL THEN 'region' END AS gap
    FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal >= 0) ON c_custkey = o_custkey
    LEFT JOIN (SELECT * FROM nation WHERE n_name <> 'NATION_3') ON n_nationkey = c_nationkey LEFT JOIN (SELECT * FROM region WHERE r_name < 'E') ON r_regionkey = n_regionkey""")
def q_chain_follow(spark, sf_dir):
    """Fixed-depth hops; the first gap cuts the rest of the chain."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").where("c_acctbal >= 0").select("c_custkey", "c_nationkey")
    nation, region = table(spark, sf_dir, "nation").where("n_name <> 'NATION_3'"), table(spark, sf_dir, "region").where("r_name < 'E'")
    chain = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    gap = F.when(F.col("c_custkey").isNull(), "customer").when(F.col("n_nationkey").isNull(), "nation").when(F.col("r_regionkey").isNull(), "region")
    return chain.select("o_orderkey", "c_custkey", "n_nationkey", "r_regionkey", gap.alias("gap"))


@query(r"SELECT page_id, 'dtd-prohibited' AS code FROM pages WHERE contains(regexp_replace(html, '<!--[\s\S]*?-->|<!\[CDATA\[[\s\S]*?\]\]>|<\?[\s\S]*?\?>', '', 'g'), '<!DOCTYPE')")
def q_prohibited_markup(spark, sf_dir):
    plain = F.regexp_replace("html", r"<!--[\s\S]*?-->|<!\[CDATA\[[\s\S]*?\]\]>|<\?[\s\S]*?\?>", "")
    return table(spark, sf_dir, "pages").where(plain.contains("<!DOCTYPE")).select("page_id", F.lit("dtd-prohibited").alias("code"))


RAW_PATH = "concat('a/../', regexp_extract(url, '://([^/?#]*)', 1), '/./x/../', regexp_extract(url, '://[^/?#]*/([^?#]*)', 1), CASE WHEN contains(url, '?') THEN '/../../../..' ELSE '' END)"


@query(f"""WITH p AS (SELECT page_id, {RAW_PATH} AS raw FROM pages),
    f AS (SELECT page_id, list_reduce(list_concat([''], list_filter(string_split(raw, '/'), lambda s: s <> '' AND s <> '.')), lambda a, s: CASE WHEN a = '!' OR (s = '..' AND a = '') THEN '!' WHEN s = '..' THEN regexp_replace(a, '/[^/]*$', '') ELSE a || '/' || s END) AS v FROM p)
    SELECT page_id, CASE WHEN v NOT IN ('!', '') THEN v[2:] END AS input_key FROM f""")
def q_path_normalise(spark, sf_dir):
    """Paths with `.` and `..`, some of which climb above their root."""
    return table(spark, sf_dir, "pages").select("page_id", paths.input_key(F.expr(RAW_PATH)).alias("input_key"))


OVERRIDES = (("de", "text/html; charset=iso-8859-1"), ("fr", "application/xhtml+xml"))
DEFAULTS = (("html", "text/html"), ("", "text/plain"))


def literal(spark: SparkSession, columns: str, rows: tuple) -> DataFrame:
    """A small table of fixed values."""
    values = ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t({columns})")


@query(r"""WITH p AS (SELECT page_id, regexp_extract(url, '://[^/]*/([^/]*)/', 1) AS lang, lower(regexp_extract(regexp_extract(url, '://[^?#]*', 0), '\.([^./]*)$', 1)) AS ext FROM pages)
    SELECT page_id, ext, CASE lang WHEN 'de' THEN 'text/html; charset=iso-8859-1' WHEN 'fr' THEN 'application/xhtml+xml' ELSE CASE ext WHEN 'html' THEN 'text/html' WHEN '' THEN 'text/plain' END END AS content_type,
    CASE lang WHEN 'fr' THEN true ELSE false END AS is_xml FROM p""")
def q_lookup_override_default(spark, sf_dir):
    """Override by key, else default by extension, else null; and whether the type is XML."""
    plain = F.regexp_extract("url", "://[^?#]*", 0)
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://[^/]*/([^/]*)/", 1).alias("lang"), F.lower(F.regexp_extract(plain, r"\.([^./]*)$", 1)).alias("ext"))
    found = R.override_or_default(pages, literal(spark, "lang, content_type", OVERRIDES), literal(spark, "ext, content_type", DEFAULTS), ["lang"], ["ext"], "content_type")
    return found.select("page_id", "ext", "content_type", paths.is_xml_type(F.col("content_type")).alias("is_xml"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def q_duplicate_keys(spark, sf_dir):
    return R.duplicated(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("""WITH d AS (SELECT doc_id, source, strlen(text) AS size, len(list_distinct(string_split(text, ' '))) AS packed FROM documents),
    t AS (SELECT source, sum(size) AS total FROM d GROUP BY source)
    SELECT doc_id, CASE WHEN total > 200000 THEN 'total-size' WHEN size > 20000 THEN 'part-size' WHEN size / packed > 9 THEN 'ratio' ELSE 'ok' END AS status FROM d JOIN t USING (source)""")
def q_limit_gate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.octet_length("text").cast("long").alias("size"), F.size(F.array_distinct(F.split("text", " "))).cast("long").alias("packed"))
    return R.limit_status(docs, "source", F.col("size"), F.col("packed"), 20000, 200000, 9.0).select("doc_id", "status")


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, repeats FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {LINE_ORDER_SQL}) AS n, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) - 1 AS repeats FROM lineitem) WHERE n = 1""")
def q_first_wins(spark, sf_dir):
    return R.first_wins(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], LINE_ORDER).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "repeats")


@query(f"""WITH p AS ({PLACED}), i AS (SELECT *, greatest(0, least(x + w, 50.0) - greatest(x, 0.0)) * greatest(0, least(y + h, 7.0) - greatest(y, 0.0)) AS inside FROM p)
    SELECT l_orderkey, pos, CASE WHEN x + w > 52 AND y + h > 9 THEN 'bottom,right' WHEN x + w > 52 THEN 'right' ELSE 'bottom' END AS edges, floor((w * h - inside) / (w * h) * 1000000 + 0.5) / 1000000 AS outside_ratio
    FROM i WHERE (x + w > 52 OR y + h > 9) AND (w * h - inside) / (w * h) + 2.220446049250313e-16 >= 0.05""")
def q_outside_bounds(spark, sf_dir):
    """Rectangles that reach over 0, 0, 50, 7 by more than 2."""
    lines = placed_lines(spark, sf_dir)
    lines = lines.withColumn("polygon", geometry.rectangle(F.col("x"), F.col("y"), F.col("w"), F.col("h"))).withColumn("frame", F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(50.0).alias("width"), F.lit(7.0).alias("height")))
    found = R.outside(lines, "polygon", "frame", 2.0, 0.05)
    return found.select("l_orderkey", "pos", F.array_join("edges", ",").alias("edges"), canonical.round_half_up(F.col("outside_ratio"), 6).alias("outside_ratio"))


def _overlap(a: str, b: str) -> Column:
    c = lambda t, n: F.col(f"{t}.{n}")
    wide = F.least(c(a, "x") + c(a, "w"), c(b, "x") + c(b, "w")) - F.greatest(c(a, "x"), c(b, "x"))
    high = F.least(c(a, "y") + c(a, "h"), c(b, "y") + c(b, "h")) - F.greatest(c(a, "y"), c(b, "y"))
    return F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))


OVERLAP_SQL = "greatest(least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x), 0) * greatest(least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y), 0)"


@query(f"""WITH p AS ({PLACED}) SELECT a.l_orderkey, a.pos AS first_pos, b.pos AS second_pos, floor({OVERLAP_SQL} / least(a.w * a.h, b.w * b.h) * 1000000 + 0.5) / 1000000 AS overlap_ratio
    FROM p a JOIN p b ON a.l_orderkey = b.l_orderkey AND a.pos < b.pos WHERE {OVERLAP_SQL} / least(a.w * a.h, b.w * b.h) + 2.220446049250313e-16 >= 0.2""")
def q_pair_overlap(spark, sf_dir):
    """Pairs of one order's rectangles that share at least a fifth of the smaller."""
    lines = placed_lines(spark, sf_dir)
    a, b = lines.alias("a"), lines.alias("b")
    pairs = a.join(b, (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.pos") < F.col("b.pos")) & (F.col("a.x") < F.col("b.x") + F.col("b.w")) & (F.col("b.x") < F.col("a.x") + F.col("a.w")))
    ratio = _overlap("a", "b") / F.least(F.col("a.w") * F.col("a.h"), F.col("b.w") * F.col("b.h"))
    return pairs.select(F.col("a.l_orderkey").alias("l_orderkey"), F.col("a.pos").alias("first_pos"), F.col("b.pos").alias("second_pos"), ratio.alias("r")).where(canonical.at_least(F.col("r"), 0.2)).select("l_orderkey", "first_pos", "second_pos", canonical.round_half_up(F.col("r"), 6).alias("overlap_ratio"))


@query(f"""WITH p AS ({PLACED}), c AS (SELECT a.l_orderkey, a.pos, max({OVERLAP_SQL} / (a.w * a.h)) AS r, count(*) AS covers FROM p a JOIN p b ON a.l_orderkey = b.l_orderkey AND b.pos > a.pos AND b.l_returnflag = 'R'
    WHERE {OVERLAP_SQL} / (a.w * a.h) + 2.220446049250313e-16 >= 0.2 GROUP BY ALL) SELECT l_orderkey, pos, covers, floor(r * 1000000 + 0.5) / 1000000 AS occluded_ratio FROM c""")
def q_occlusion(spark, sf_dir):
    """Rectangles of which an opaque one that stands later in the order covers at least a fifth."""
    lines = placed_lines(spark, sf_dir)
    a, b = lines.alias("a"), lines.where("l_returnflag = 'R'").alias("b")
    pairs = a.join(b, (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("b.pos") > F.col("a.pos")))
    share = _overlap("a", "b") / (F.col("a.w") * F.col("a.h"))
    hits = pairs.select(F.col("a.l_orderkey").alias("l_orderkey"), F.col("a.pos").alias("pos"), share.alias("r")).where(canonical.at_least(F.col("r"), 0.2))
    return hits.groupBy("l_orderkey", "pos").agg(F.count("*").alias("covers"), canonical.round_half_up(F.max("r"), 6).alias("occluded_ratio"))


@query("SELECT p_partkey, kind, p_retailprice, least_ AS minimum FROM (SELECT *, CASE WHEN p_size > 25 THEN 'title' ELSE 'default' END AS kind, CASE WHEN p_size > 25 THEN 1500.0::DOUBLE ELSE 1200.0::DOUBLE END AS least_ FROM part) WHERE p_retailprice + 2.220446049250313e-16 < least_")
def q_min_threshold(spark, sf_dir):
    kind = F.when(F.col("p_size") > 25, "title").otherwise("default")
    least = F.when(kind == "title", 1500.0).otherwise(1200.0)
    return table(spark, sf_dir, "part").where(canonical.below(F.col("p_retailprice"), least)).select("p_partkey", kind.alias("kind"), "p_retailprice", least.alias("minimum"))


@query(f"SELECT {LINE_ORDER_SQL}, l_orderkey, l_extendedprice * (1 - l_discount) AS effective FROM lineitem WHERE l_discount > 0 AND l_extendedprice >= 10000 AND l_extendedprice * (1 - l_discount) + 2.220446049250313e-16 < 10000")
def q_scaled_threshold(spark, sf_dir):
    """Below the minimum only once scaled."""
    effective = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return table(spark, sf_dir, "lineitem").where((F.col("l_discount") > 0) & (F.col("l_extendedprice") >= 10000) & canonical.below(effective, 10000.0)).select(*LINE_ORDER, "l_orderkey", effective.alias("effective"))


@query("SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY l_orderkey HAVING count(*) FILTER (l_discount > 0) = 0")
def q_unscaled_flag(spark, sf_dir):
    """Groups with members of which none has a usable scale."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.count_if(F.col("l_discount") > 0).alias("_scaled")).where("_scaled = 0").drop("_scaled")


@query("""WITH s AS (SELECT o_custkey AS k, 1 AS rank, max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS v FROM orders GROUP BY 1 UNION ALL SELECT o_custkey, 2, max(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) FROM orders GROUP BY 1 UNION ALL SELECT c_custkey, 3, c_acctbal FROM customer),
    w AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY rank) AS n FROM s WHERE v IS NOT NULL)
    SELECT k AS c_custkey, rank AS source_rank, CASE WHEN v >= 1000 THEN v END AS value, CASE WHEN v >= 1000 THEN 'resolved' ELSE 'unresolved' END AS status FROM w WHERE n = 1""")
def q_inherited_value(spark, sf_dir):
    """The first source with a value decides, even if that value is invalid."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    best = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("s1"), F.max(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice"))).alias("s2"))
    sources = best.selectExpr("c_custkey", "stack(2, 1, s1, 2, s2) AS (source_rank, value)").unionByName(customer.select("c_custkey", F.lit(3).alias("source_rank"), F.col("c_acctbal").alias("value")))
    found = R.first_ranked(sources, ["c_custkey"], "source_rank", "value")
    return found.select("c_custkey", "source_rank", F.when(F.col("value") >= 1000, F.col("value")).alias("value"), F.when(F.col("value") >= 1000, "resolved").otherwise("unresolved").alias("status"))


ALLOWED = ((" Click ",), ("VIEW",))


@query("SELECT event_id, event_type FROM events WHERE lower(trim(event_type)) NOT IN ('click', 'view')")
def q_allowlist(spark, sf_dir):
    """Values outside an allowlist, trimmed and lower-cased on both sides."""
    allowed = literal(spark, "family", ALLOWED).select(F.lower(canonical.trim_all(F.col("family"))).alias("family"))
    events = table(spark, sf_dir, "events").withColumn("family", F.lower(canonical.trim_all(F.col("event_type"))))
    return events.join(F.broadcast(allowed), "family", "left_anti").select("event_id", "event_type")


_EAST = "".join(rf"\p{{{s}}}" for s in text.EAST_ASIAN)
_COMPLEX = "".join(rf"\p{{{s}}}" for s in text.COMPLEX)


@query(rf"""WITH f AS (SELECT doc_id, regexp_matches(text, '[{_EAST}]') AS e, regexp_matches(text, '[{_COMPLEX}]') AS c, regexp_replace(text, '[{_EAST}{_COMPLEX}]', '', 'g') AS rest FROM documents)
    SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(rest, '\p{{L}}') OR (NOT e AND NOT c) THEN 'latin' END, CASE WHEN e THEN 'eastAsian' END, CASE WHEN c THEN 'complexScript' END], lambda s: s IS NOT NULL), ',') AS slots FROM f""")
def q_script_slots(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.script_slots(F.col("text")), ",").alias("slots"))


@query("""SELECT o_orderkey, sha256('{"schemaVersion":1,"ruleId":' || to_json(o_orderpriority) || ',"inputKey":' || to_json(o_orderstatus) || ',"part":null,"slideId":' || to_json(CAST(o_custkey AS VARCHAR)) || ',"slideNumber":' || CAST(o_orderkey AS VARCHAR) || ',"shapeIds":[' || CAST(o_custkey AS VARCHAR) || '],"discriminator":' || to_json(o_orderstatus || chr(9) || 'x') || '}') AS fingerprint FROM orders""")
def q_fingerprint(spark, sf_dir):
    key = F.col("o_custkey")
    print_ = canonical.fingerprint(F.col("o_orderpriority"), F.col("o_orderstatus"), F.lit(None).cast("string"), key.cast("string"), F.col("o_orderkey"), F.array(key), F.concat("o_orderstatus", F.lit("\tx")))
    return table(spark, sf_dir, "orders").select("o_orderkey", print_.alias("fingerprint"))


@query("SELECT user_id, min(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def q_dedup_last(spark, sf_dir):
    """Of equal keys the last value, at the first one's place."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return R.last_value_first_place(events, ["user_id"], "event_id").select("user_id", "event_id", "event_type", "value")


SUPPRESSIONS = ((0, "short", None, "de"), (1, "short", "src3", None), (2, "long", "src1", "en"), (3, "long", None, "xx"), (4, "short", "src3", "en"))
FINDINGS = "SELECT doc_id, source, lang, CASE WHEN n_chars < 500 THEN 'short' ELSE 'long' END AS rule FROM documents WHERE n_chars < 500 OR n_chars > 5000"
SUPPRESSIONS_SQL = "(VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in SUPPRESSIONS) + ") AS s(idx, rule, source, lang)"
MATCH_SQL = "s.rule = f.rule AND (s.source IS NULL OR s.source = f.source) AND (s.lang IS NULL OR s.lang = f.lang)"


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = F.when(F.col("n_chars") < 500, "short").otherwise("long")
    return table(spark, sf_dir, "documents").where("n_chars < 500 OR n_chars > 5000").select("doc_id", "source", "lang", rule.alias("rule"))


@query(f"WITH f AS ({FINDINGS}) SELECT f.doc_id, f.rule, (SELECT min(idx) FROM {SUPPRESSIONS_SQL} WHERE {MATCH_SQL}) AS suppressed_by FROM f")
def q_suppress_first(spark, sf_dir):
    found = R.first_suppression(_findings(spark, sf_dir), literal(spark, "idx, rule, source, lang", SUPPRESSIONS), "rule", ["source", "lang"], ["doc_id"])
    return found.select("doc_id", "rule", "suppressed_by")


@query(f"WITH f AS ({FINDINGS}), u AS (SELECT (SELECT min(idx) FROM {SUPPRESSIONS_SQL} WHERE {MATCH_SQL}) AS idx FROM f) SELECT idx, rule FROM {SUPPRESSIONS_SQL} WHERE idx NOT IN (SELECT idx FROM u WHERE idx IS NOT NULL)")
def q_unused_suppressions(spark, sf_dir):
    suppressions = literal(spark, "idx, rule, source, lang", SUPPRESSIONS)
    used = R.first_suppression(_findings(spark, sf_dir), suppressions, "rule", ["source", "lang"], ["doc_id"]).select(F.col("suppressed_by").alias("idx")).distinct()
    return R.missing(suppressions, used, "idx").select("idx", "rule")


@query("SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'new' WHEN a.doc_id IS NULL THEN 'resolved' ELSE 'existing' END AS status FROM (SELECT doc_id FROM documents WHERE n_chars > 1000) a FULL JOIN (SELECT DISTINCT doc_id FROM labels) b ON a.doc_id = b.doc_id")
def q_baseline_status(spark, sf_dir):
    return R.baseline_status(table(spark, sf_dir, "documents").where("n_chars > 1000"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("SELECT source, count(*) FILTER (n_chars > 5000) AS errors, count(*) FILTER (n_chars BETWEEN 2001 AND 5000) AS warnings, count(*) AS total FROM documents GROUP BY GROUPING SETS ((source), ())")
def q_severity_summary(spark, sf_dir):
    severity = F.when(F.col("n_chars") > 5000, "error").when(F.col("n_chars") > 2000, "warning")
    return R.severity_counts(table(spark, sf_dir, "documents").select("source", severity.alias("severity")), "source")


@query("SELECT source, max(CASE WHEN n_chars > 30000 THEN 2 WHEN n_chars > 20000 THEN 1 ELSE 0 END) AS exit_code FROM documents GROUP BY GROUPING SETS ((source), ())")
def q_exit_code(spark, sf_dir):
    """Each input's exit code and, as the null input, the command's."""
    code = F.when(F.col("n_chars") > 30000, 2).when(F.col("n_chars") > 20000, 1).otherwise(0)
    return table(spark, sf_dir, "documents").rollup("source").agg(F.max(code).alias("exit_code"))


@query("SELECT lang, count(*) FILTER (quality = 1) AS tp, count(*) FILTER (quality = 0) AS fp, count(*) FILTER (quality = 1) / nullif(count(*) FILTER (quality IN (0, 1)), 0) AS precision FROM documents LEFT JOIN labels USING (doc_id) WHERE n_chars > 10000 GROUP BY lang")
def q_precision(spark, sf_dir):
    """True among labelled findings; null where none is labelled."""
    found = table(spark, sf_dir, "documents").where("n_chars > 10000").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    tp, fp = F.count_if(F.col("quality") == 1), F.count_if(F.col("quality") == 0)
    return found.groupBy("lang").agg(tp.alias("tp"), fp.alias("fp"), F.try_divide(tp.cast("double"), tp + fp).alias("precision"))


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderstatus, o_custkey, o_orderkey) AS place FROM orders")
def q_canonical_order(spark, sf_dir):
    """Places in the order of rule, part, number, identity; ranked within a rule."""
    return R.places(table(spark, sf_dir, "orders"), ["o_orderpriority"], ["o_orderstatus", "o_custkey", "o_orderkey"], "place").select("o_orderkey", "place")


@query(f"""WITH p AS ({PLACED}), l AS (SELECT l_orderkey, list({{'s': w / 4, 't': x}} ORDER BY pos) AS m FROM p GROUP BY l_orderkey)
    SELECT l_orderkey, round(list_reduce(list_prepend({{'s': 1.0::DOUBLE, 't': 0.0::DOUBLE}}, list_transform(m, lambda v: {{'s': v.s::DOUBLE, 't': v.t::DOUBLE}})), lambda a, v: {{'s': a.s * v.s, 't': a.s * v.t + a.t}}).s, 6) AS scale,
    round(list_reduce(list_prepend({{'s': 1.0::DOUBLE, 't': 0.0::DOUBLE}}, list_transform(m, lambda v: {{'s': v.s::DOUBLE, 't': v.t::DOUBLE}})), lambda a, v: {{'s': a.s * v.s, 't': a.s * v.t + a.t}}).t, 6) AS shift FROM l""")
def q_affine_fold(spark, sf_dir):
    """The composition of an order's maps, each a scaling and a move, in their order."""
    lines = placed_lines(spark, sf_dir)
    step = geometry.matrix(F.col("w") / 4, 0, 0, F.col("w") / 4, F.col("x"), F.col("y"))
    chain = lines.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", step.alias("m")))), lambda r: r["m"]).alias("chain"))
    folded = geometry.folded_matrix(F.col("chain"))
    return chain.select("l_orderkey", F.round(folded["a"], 6).alias("scale"), F.round(folded["e"], 6).alias("shift"))


@query(f"""WITH p AS ({PLACED}) SELECT l_orderkey, pos, floor(greatest(0, least(x + w, 40.0) - greatest(x, 10.0)) * greatest(0, least(y + h, 6.0) - greatest(y, 2.0)) * 1000 + 0.5) / 1000 AS area FROM p""")
def q_clip_area(spark, sf_dir):
    """The general convex clip, on rectangles."""
    lines = placed_lines(spark, sf_dir)
    cut = geometry.intersection(geometry.rectangle(F.col("x"), F.col("y"), F.col("w"), F.col("h")), geometry.rectangle(10, 2, 30, 4))
    return lines.select("l_orderkey", "pos", cut["area"].alias("area")).withColumn("area", canonical.round_half_up(F.col("area"), 3))


#: A square on a corner, of half diagonal r about x, y, cut by the line 40 to the right.
_LEFT_OF = "CASE WHEN 40 - x >= r THEN 2 * r * r WHEN 40 - x <= -r THEN 0 WHEN x >= 40 THEN (r + 40 - x) * (r + 40 - x) ELSE 2 * r * r - (r - 40 + x) * (r - 40 + x) END"


@query(f"""WITH p AS (SELECT *, w / sqrt(2) AS r FROM ({PLACED})) SELECT l_orderkey, pos, floor({_LEFT_OF} * 1000 + 0.5) / 1000 AS area FROM p""")
def q_clip_turned(spark, sf_dir):
    """Squares turned by an eighth, clipped where they reach over a line."""
    lines = placed_lines(spark, sf_dir)
    turned = geometry.shape_matrix(F.col("x") - F.col("w") / 2, F.col("y") - F.col("w") / 2, F.col("w"), F.col("w"), F.lit(45.0), F.lit(False), F.lit(False))
    # exploded, because Spark doesn't take an Arrow function out of a projection whose lambdas feed it
    lines = lines.select("l_orderkey", "pos", F.explode(F.array(geometry.moved(geometry.rectangle(0, 0, F.col("w"), F.col("w")), turned))).alias("polygon"))
    cut = geometry.intersection(F.col("polygon"), geometry.rectangle(-1000, -1000, 1040, 2000))
    return lines.select("l_orderkey", "pos", cut["area"].alias("area")).withColumn("area", canonical.round_half_up(F.col("area"), 3))
