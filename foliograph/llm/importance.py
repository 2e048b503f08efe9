"""Importance resampling towards a target distribution of hashed n-grams.

Each task runs DuckDB over its own batches: SQL unnests the words, windows make the n-grams, and a registered function of
zlib's CRC gives a bucket to each distinct one. What a document holds of each bucket is spilled to Parquet once; Spark
merges the buckets' counts, and scores the documents from the spilled counts without reading a text again.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from foliograph.llm.common import drop_tables, materialize

BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Characters that DuckDB is given at a time; longer texts are cut between words.
CHUNK = 1 << 21
#: A word in a text whose letters A-Z are lower case; and in one as it is, words and what separates them.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
RAW_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPILLED = "doc_id long, n_words long, n_features long, buckets array<int>, counts array<int>"
#: `skip` words at the head of a piece were counted with the piece before; only n-grams that end after them count.
SQL = """
WITH split AS (SELECT row, skip, regexp_extract_all(translate(text, '{upper}', '{lower}'), '{word}') AS w FROM pieces),
     words AS (SELECT row, skip, unnest(w) AS w1, generate_subscripts(w, 1) AS pos FROM split),
     grams AS ({grams}),
     many AS (SELECT row, gram, count(*) AS n FROM grams GROUP BY ALL),
     placed AS (SELECT gram, bucket_of(gram) AS bucket FROM (SELECT DISTINCT gram FROM many))
SELECT row, bucket, sum(n)::BIGINT AS n FROM many JOIN placed USING (gram) GROUP BY ALL ORDER BY row, bucket
"""


def _grams(low: int, high: int) -> str:
    """SQL of all runs of low to high words; longer runs than one word come from windows over a text's words."""
    out = []
    for n in range(low, high + 1):
        if n == 1:
            out.append("SELECT row, w1 AS gram FROM words WHERE pos > skip")
        else:
            more = " || ' ' || ".join(["w1", *(f"lead(w1, {k}) OVER (PARTITION BY row ORDER BY pos)" for k in range(1, n))])
            out.append(f"SELECT row, gram FROM (SELECT row, skip, pos, {more} AS gram FROM words) WHERE gram IS NOT NULL AND pos + {n - 1} > skip")
    return " UNION ALL ".join(out)


class Counter:
    """One DuckDB connection that counts the buckets of texts."""

    def __init__(self, low: int, high: int, buckets: int) -> None:
        import duckdb

        self.buckets, self.high = buckets, high
        self.sql = SQL.format(upper=UPPER, lower=LOWER, word=WORD, grams=_grams(low, high))
        self.base = duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})
        self.base.create_function("bucket_of", self._bucket, ["VARCHAR"], "INTEGER", type="arrow")

    def _bucket(self, grams: pa.Array) -> pa.Array:
        return pa.array([zlib.crc32(g.encode("utf-8", "surrogatepass")) % self.buckets for g in grams.to_pylist()], pa.int32())

    def of(self, pieces: list[tuple[int, int, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """row, bucket, n of pieces (row, skip, text), by row and bucket."""
        rows, skips, texts = zip(*pieces, strict=True)
        self.base.register("pieces", pa.table({"row": pa.array(rows, pa.int32()), "skip": pa.array(skips, pa.int64()), "text": pa.array(texts, pa.string())}))
        found = self.base.execute(self.sql).fetchnumpy()
        self.base.unregister("pieces")
        return np.asarray(found["row"]), np.asarray(found["bucket"]), np.asarray(found["n"])

    def pieces(self, text: str) -> Iterator[tuple[int, str]]:
        """A long text's pieces, cut between words, and how many words at their heads belong to the piece before."""
        at, carried = 0, []
        while at < len(text):
            gap = None if at + CHUNK >= len(text) else GAP.search(text, at + CHUNK)
            end = gap.start() if gap else len(text)
            body = text[at:end]
            yield len(carried), " ".join([*carried, body])
            if self.high > 1:
                carried = (carried + RAW_WORD.findall(body))[-(self.high - 1) :]
            at = end


def _words(text: str) -> int:
    return sum(1 for _ in RAW_WORD.finditer(text))


def counted(docs: DataFrame, low: int, high: int, buckets: int, key: str, text: str) -> DataFrame:
    """SPILLED: the words, the features and the buckets' counts of each row of docs; materialised."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(low, high, buckets)

        def done(ids: list, found: list[tuple[np.ndarray, np.ndarray]], words: list[int]) -> pa.RecordBatch:
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(b) for b, _ in found]))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([f[i] for f in found]).astype(np.int32))) for i in (0, 1)]
            sums = pa.array([int(n.sum()) for _, n in found], pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.int64()), sums, *lists], ["doc_id", "n_words", "n_features", "buckets", "counts"])

        def several(ids: list, texts: list[str]) -> pa.RecordBatch:
            row, bucket, n = counter.of([(i, 0, t) for i, t in enumerate(texts)])
            ends = np.searchsorted(row, np.arange(len(texts) + 1))
            found = [(bucket[a:b], n[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            words = [int(f[1].sum()) for f in found] if (low, high) == (1, 1) else [_words(t) for t in texts]
            return done(ids, found, words)

        def alone(key_of: int | None, text_of: str) -> pa.RecordBatch:
            total = np.zeros(buckets, np.int64)
            for skip, piece in counter.pieces(text_of):
                _, bucket, n = counter.of([(0, skip, piece)])
                total[bucket] += n
            at = np.flatnonzero(total)
            return done([key_of], [(at, total[at])], [int(total.sum()) if (low, high) == (1, 1) else _words(text_of)])

        for batch in batches:
            ids, texts, size = [], [], 0
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = t.as_py() or ""
                if len(t) > CHUNK:
                    yield alone(i, t)
                    continue
                ids.append(i)
                texts.append(t)
                size += len(t)
                if size >= CHUNK:
                    yield several(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield several(ids, texts)

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return materialize(rows.mapInArrow(run, SPILLED), "buckets")


def totals(spilled: DataFrame, buckets: int) -> np.ndarray:
    """The counts of all documents by bucket: at most `buckets` rows reach the driver, and as many leave a task."""
    both = spilled.select(F.explode(F.arrays_zip("buckets", "counts")).alias("c")).groupBy("c.buckets").agg(F.sum("c.counts").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in both.collect():
        out[r[0]] = r[1]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed likelihood ratio of target to source, by bucket."""
    s, t = source.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + len(s)) / ((s + 1) * (t.sum() + len(t))))).astype(np.int64)


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, of a document's key alone; a null key is an empty one."""
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((drawn + 0.5) / 4294967296.0)))


def scored(spilled: DataFrame, gain: np.ndarray, seed: int) -> DataFrame:
    """doc_id, n_words, n_features, weight, score: the floored mean gain of a document's features, and it with noise."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, counts = batch.column("buckets"), batch.column("counts").flatten().to_numpy().astype(np.int64)
            sums = np.concatenate(([0], np.cumsum(gain[lists.flatten().to_numpy()] * counts)))
            sizes = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
            n = batch.column("n_features").to_numpy()
            weight = np.where(n > 0, (sums[sizes[1:]] - sums[sizes[:-1]]) // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "n_words", "n_features")), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    rows = spilled.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")
    return rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


def drawn(rows: DataFrame, least_words: int, percent: int) -> DataFrame:
    """Adds `rank` (from 1) to the percentage of rows of highest score among those of enough words, ties to the smaller key; null to the rest.

    Scores are whole thousandths in a range that gains and noise bound (about 100,000 values), so counts by score are few
    whatever the table's size. A running sum of them tells which scores are drawn; only rows of these shuffle to be ranked,
    each score by itself.
    """
    fits = F.col("n_words") >= least_words
    counts = materialize(rows.where(fits).groupBy("score").agg(F.count("*").alias("n")), "scores")
    most = (counts.agg(F.sum("n")).first()[0] or 0) * percent // 100
    above = W.Window.orderBy(F.desc("score")).rowsBetween(W.Window.unboundedPreceding, -1)
    starts = counts.select(F.col("score").alias("_score"), F.coalesce(F.sum("n").over(above), F.lit(0)).alias("_start")).where(F.col("_start") < most)
    met = rows.join(F.broadcast(starts), fits & (F.col("score") == F.col("_score")), "left")
    inside = W.Window.partitionBy("score").orderBy("doc_id", "n_features", "weight")
    ranked = met.where("_start IS NOT NULL").withColumn("rank", F.col("_start") + F.row_number().over(inside))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank")))
    keep = [*rows.columns, "rank"]
    return ranked.select(keep).unionByName(met.where("_start IS NULL").withColumn("rank", F.lit(None).cast("long")).select(keep))


def resample(
    docs: DataFrame, target: DataFrame, low: int = 1, high: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT, key: str = "doc_id", text: str = "text", target_key: str = "item_id"
) -> DataFrame:
    """doc_id, n_features, weight, score, rank of each row of docs, ranked as drawn without replacement towards target's texts.

    Letters A-Z are lower-cased; features are all runs of low to high words. A null or empty text has no features and weight
    0. Texts are whole; those beyond CHUNK characters are counted by pieces. Rows that repeat a key share its noise and each
    have a place of their own; a null key has the noise of an empty one and comes before other keys of its score. An empty
    table gives no rows, an empty target no counts. Other columns are ignored, whatever their names.
    """
    spilled = counted(docs, low, high, buckets, key, text)
    wanted = counted(target, low, high, buckets, target_key, text)
    gain = gains(totals(spilled, buckets), totals(wanted, buckets))
    rows = materialize(scored(spilled, gain, seed), "scored")
    drop_tables(spilled, wanted)
    return drawn(rows, least_words, percent).select("doc_id", "n_features", "weight", "score", "rank")


def sample(docs: DataFrame, ranked: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of docs, with all their columns, whose key was drawn."""
    keys = ranked.where("rank IS NOT NULL").select(F.col("doc_id").alias("_drawn"))
    return docs.join(keys, F.col(key).eqNullSafe(F.col("_drawn")), "left_semi")
