"""URL filter: host rules, and gradient-boosted trees on lexical features for the urls that no rule fits.

The labelled urls are those that a rule fits. Features, scoring and statistics are DataFrame functions; the trees are
Spark ML's, trained on a bounded sample and applied in the JVM; the rates of suffixes are those of all labelled urls. A url
that the trees are trained on has the rates of the other folds, so that they can't tell its own label.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.llm.common import materialize, smallest

#: Labelled urls that the trees are trained on, at most: those of smallest hash, so any run takes the same.
SAMPLE = 20_000
#: Folds of the labelled urls.
FOLDS = 5
#: Rows by which a suffix's rate is drawn to the overall rate.
PRIOR = 10.0
SUFFIXES = ("domain", "extension", "segment")
FEATURES = ("length", "host_length", "labels", "depth", "digit_ratio", "entropy", "parameters", "fragment", *(f"{s}_rate" for s in SUFFIXES))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """Fits its host and all subdomains where the url's path starts with path."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; else empty."""
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The name of the longest rule that fits, the first of equally long ones; else null."""
    out = None
    for r in sorted(rules, key=lambda r: -len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(r.name)) if out is None else out.when(fits, F.lit(r.name))
    return out if out is not None else F.lit(None).cast("string")


def _entropy(text: Column) -> Column:
    """Bits a character."""
    size = F.length(text)
    letters = F.array_distinct(F.split(text, ""))
    share = lambda c: (size - F.length(F.replace(text, c))) / size.cast("double")
    part = F.transform(F.filter(letters, lambda c: F.length(c) > 0), lambda c: -share(c) * F.log2(share(c)))
    return F.when(size > 0, F.aggregate(part, F.lit(0.0), lambda a, x: a + x)).otherwise(0.0)


def with_features(pages: DataFrame) -> DataFrame:
    """Adds the lexical features of url, host and path, and the suffixes whose rates are looked up."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    last = F.element_at(F.split(path, "/"), -1)
    return pages.withColumns({
        "length": F.length(url).cast("double"),
        "host_length": F.length(host).cast("double"),
        "labels": F.size(F.split(host, r"\.")).cast("double"),
        "depth": F.size(F.filter(F.split(path, "/"), lambda x: x != "")).cast("double"),
        "digit_ratio": F.length(F.regexp_replace(url, "[^0-9]", "")) / F.greatest(F.length(url), F.lit(1)).cast("double"),
        "entropy": _entropy(url),
        "parameters": F.when(url.contains("?"), F.size(F.split(F.element_at(F.split(url, r"\?"), 2), "&"))).otherwise(0).cast("double"),
        "fragment": url.contains("#").cast("double"),
        "domain": F.element_at(F.split(host, r"\."), -1),
        "extension": F.regexp_extract(last, r"\.([A-Za-z0-9]{1,8})$", 1),
        "segment": F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(2)), F.lit("")),
    })


def _fold() -> Column:
    return F.pmod(F.xxhash64("url", "page_id", F.lit("fold")), F.lit(FOLDS))


def _rates(rows: DataFrame) -> tuple[DataFrame, int, int, float]:
    """kind, suffix, rows, labelled, label_sum and these two by folds, of each suffix over all rows (given: the verdict, or null); their number, that of labelled ones, and the sum of labels."""
    label = (F.col("given") == "block").cast("double")
    kinds = F.explode(F.array(*[F.struct(F.lit(s).alias("kind"), F.coalesce(s, F.lit("")).alias("suffix")) for s in SUFFIXES])).alias("of")
    each = with_features(rows).withColumns({"label": label, "fold": _fold()}).select(kinds, "label", "fold").select("of.*", "label", "fold")
    mine = lambda f: F.when(F.col("fold") == f, F.col("label"))
    sums = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    folds = [F.array(*[F.count(mine(f)) for f in range(FOLDS)]).alias("fold_labelled"), F.array(*[sums(mine(f)) for f in range(FOLDS)]).alias("fold_sum")]
    held = materialize(each.groupBy("kind", "suffix").agg(F.count("*").alias("rows"), F.count("label").alias("labelled"), sums("label").alias("label_sum"), *folds), "suffixes")
    total = held.where(F.col("kind") == SUFFIXES[0]).agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("rows", "labelled", "label_sum")]).first()
    return held, int(total[0]), int(total[1]), float(total[2])


def _out_of_fold(sample: DataFrame, held: DataFrame, overall: float) -> DataFrame:
    """Adds each suffix's rate among the labelled urls of the other folds. The sample, of SAMPLE rows at most, is broadcast."""
    at = F.col("fold").cast("int")
    for s in SUFFIXES:
        side = held.where(F.col("kind") == s).select(F.col("suffix").alias(s), "labelled", "label_sum", "fold_labelled", "fold_sum")
        joined = side.join(F.broadcast(sample.withColumns({s: F.coalesce(s, F.lit("")), "fold": _fold()})), s)
        rate = (F.col("label_sum") - F.get("fold_sum", at) + PRIOR * overall) / (F.col("labelled") - F.get("fold_labelled", at) + PRIOR)
        sample = joined.select(*sample.columns, rate.alias(f"{s}_rate"))
    return sample


def _with_rates(rows: DataFrame, held: DataFrame, count: int, overall: float) -> DataFrame:
    """Adds each suffix's smoothed share of blocked rows among all labelled ones.

    A kind's suffixes are broadcast where they are SAMPLE at most; else only those with over 1/1000 of the `count` rows,
    fewer than 1000, are, and the rows of other suffixes meet theirs in a shuffle.
    """
    rate = (F.col("label_sum") + PRIOR * overall) / (F.col("labelled") + PRIOR)
    kinds = {r[0]: r[1] for r in held.where("labelled > 0").groupBy("kind").agg(F.count("*")).collect()}
    for s in SUFFIXES:
        rates = held.where(F.col("kind") == s).select(F.col("suffix").alias(s), rate.alias(f"{s}_rate"), "rows", "labelled")
        rows = rows.withColumn(s, F.coalesce(s, F.lit("")))
        often = F.col("rows") > -(-count // 1000)
        if kinds.get(s, 0) <= SAMPLE:
            rows = rows.join(F.broadcast(rates.where("labelled > 0").drop("rows", "labelled")), s, "left")
        else:
            rows = rows.join(F.broadcast(rates.where(often).select(s, F.col(f"{s}_rate").alias("_hot"))), s, "left")
            rows = rows.withColumn("_at", F.when(F.col("_hot").isNull(), F.concat(F.lit("="), s)).otherwise(F.concat(F.lit("#"), F.xxhash64("url", "page_id").cast("string"))))
            rest = rates.where(~often & (F.col("labelled") > 0)).select(F.concat(F.lit("="), s).alias("_at"), f"{s}_rate")
            rows = rows.join(rest, "_at", "left").withColumn(f"{s}_rate", F.coalesce("_hot", f"{s}_rate")).drop("_at", "_hot")
        rows = rows.withColumn(f"{s}_rate", F.coalesce(f"{s}_rate", F.lit(overall)))
    return rows


def judge(pages: DataFrame, rules: Sequence[Rule], key: str = "page_id", url: str = "url") -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, score (the trees' chance of block; null where a rule decides).

    A null url, or one without `://`, has an empty host and path, which the trees judge like any other. Without any
    labelled url the verdict is allow; if all labels agree, it is theirs. Rows that repeat are judged alike, other
    columns are ignored, an empty table gives no rows.
    """
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url")).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    verdicts = F.create_map(*[F.lit(x) for r in rules for x in (r.name, r.verdict)]) if rules else F.create_map(F.lit(""), F.lit("allow"))
    rows = rows.withColumn("given", F.try_element_at(verdicts, F.col("rule")))
    held, every, count, blocked = _rates(rows)
    if blocked in (0, count):
        constant = F.lit("block" if blocked and blocked == count else "allow")
        return rows.select("page_id", "host", "path", "rule", F.coalesce("given", constant).alias("verdict"), F.lit(None).cast("double").alias("score"))
    overall = blocked / count
    labelled = smallest(rows.where("rule IS NOT NULL"), F.xxhash64("url", "page_id"), SAMPLE, count, "url", "page_id")
    sample = materialize(with_features(labelled).withColumn("label", (F.col("given") == "block").cast("double")), "urls")
    columns = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    trees = GBTClassifier(maxIter=16, maxDepth=4, stepSize=0.3, maxBins=64, seed=7).fit(columns.transform(_out_of_fold(sample, held, overall)).select("features", "label"))
    ruled = rows.where("rule IS NOT NULL").select("page_id", "host", "path", "rule", F.col("given").alias("verdict"), F.lit(None).cast("double").alias("score"))
    open_ = _with_rates(with_features(rows.where("rule IS NULL")), held, every, overall)
    scored = trees.transform(columns.transform(open_)).withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))
    return ruled.unionByName(scored.select("page_id", "host", "path", "rule", F.when(F.col("score") > 0.5, "block").otherwise("allow").alias("verdict"), "score"))
