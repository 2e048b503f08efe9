"""Toxicity by a factorization machine over hashed terms.

A document's terms are its distinct words and word beginnings, hashed to buckets. The score is a logistic function of a
bias, a weight for each present term, and for each pair of present terms the inner product of their factors: so that an
insult together with a group's mention can weigh more than both alone. Scoring a document costs its terms, not its pairs.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.llm.common import materialize, smallest

#: Labelled documents that the machine is trained on, at most: half of either label, of smallest hash.
SAMPLE = 6_000
BUCKETS, FACTORS = 1 << 18, 4
#: A term is used if so many documents of the sample hold it and its likelihood ratio (G) with the label is so large.
LEAST, LEAST_G = 4, 10.8
PREFIXES = (4, 5)
#: Tokens whose buckets a worker remembers before it starts anew, and characters of a token that it remembers.
WORDS, LONG = 300_000, 64
THRESHOLD = 0.3
WORD = re.compile(r"[^\W\d_]+")


def _bucket(term: str) -> int:
    return xxhash.xxh64_intdigest(term.encode("utf-8", "surrogatepass")) & (BUCKETS - 1)


def word_buckets(token: str) -> set[int]:
    """Buckets of the words, and of their beginnings, in a token without white space."""
    out = set()
    for word in WORD.findall(token.lower()):
        out.add(_bucket("=" + word))
        out.update(_bucket(word[:n]) for n in PREFIXES if len(word) >= n)
    return out


class Terms:
    """Buckets of texts; remembers tokens' buckets, of those that are used."""

    def __init__(self, used: np.ndarray | None = None) -> None:
        self.at = None if used is None else {int(b): i for i, b in enumerate(used)}
        self.seen: dict[str, tuple[int, ...]] = {}

    def of(self, text: str | None) -> list[int]:
        tokens, out, seen = set((text or "").split()), set(), self.seen
        for token in tokens:
            known = seen.get(token)
            if known is None:
                known = word_buckets(token)
                known = tuple(known if self.at is None else (self.at[b] for b in known if b in self.at))
                if len(token) <= LONG:
                    if len(seen) >= WORDS:
                        seen.clear()
                    seen[token] = known
            if known:
                out.update(known)
        return sorted(out)


@dataclass
class Machine:
    used: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def margin(self, at: np.ndarray, document: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        """The logits of documents given as (term, document) entries, and the sums of their terms' factors."""
        linear = np.bincount(document, self.weights[at], count)
        v = self.factors[at]
        sums = np.stack([np.bincount(document, v[:, f], count) for f in range(v.shape[1])], axis=1)
        squares = np.bincount(document, (v * v).sum(axis=1), count)
        return self.bias + linear + 0.5 * ((sums * sums).sum(axis=1) - squares), sums

    def score(self, texts: list[str | None], terms: Terms) -> np.ndarray:
        found = [terms.of(t) for t in texts]
        at = np.array([i for f in found for i in f], np.int64)
        document = np.repeat(np.arange(len(found)), [len(f) for f in found])
        return 1 / (1 + np.exp(-np.clip(self.margin(at, document, len(found))[0], -30, 30)))


def likelihood_ratio(positive: np.ndarray, often: np.ndarray, positives: float, total: int) -> np.ndarray:
    """G of the tables of term and label: terms in `often` of `total` documents, in `positive` of the `positives`."""
    out = np.zeros(len(often))
    for seen, row, column in ((positive, often, positives), (often - positive, often, total - positives), (positives - positive, total - often, positives), (total - often - positives + positive, total - often, total - positives)):
        expected = row * column / max(1, total)
        out += 2 * np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12)), 0)
    return out


def train(found: list[np.ndarray], labels: np.ndarray, steps: int = 1500, batch_size: int = 256, rate: float = 0.15, decay: float = 1e-3, seed: int = 7) -> Machine:
    """Adagrad on logistic loss over small batches; terms without a likelihood ratio of LEAST_G with the label are left off."""
    rng = np.random.default_rng(seed)
    documents = np.repeat(np.arange(len(found)), [len(f) for f in found])
    flat = np.concatenate(found) if len(found) else np.zeros(0, np.int64)
    used, at, often = np.unique(flat, return_inverse=True, return_counts=True)
    positive = np.bincount(at, labels[documents], len(used)) if len(flat) else np.zeros(0)
    keep = (often >= LEAST) & (likelihood_ratio(positive, often, labels.sum() if len(labels) else 0, len(labels)) >= LEAST_G)
    place = np.cumsum(keep) - 1
    rows = keep[at]
    flat, documents, used = place[at[rows]], documents[rows], used[keep]
    share = float(np.clip(labels.mean() if len(labels) else 0, 1e-3, 1 - 1e-3))
    m = Machine(used, float(np.log(share / (1 - share))), np.zeros(len(used)), rng.normal(0, 0.01, (len(used), FACTORS)))
    if not len(used) or labels.min() == labels.max():
        return m
    starts = np.searchsorted(documents, np.arange(len(found) + 1))
    gw, gv, gb = np.full(len(used), 1e-8), np.full((len(used), FACTORS), 1e-8), 1e-8
    for _ in range(-(-steps * batch_size // len(found))):
        order = rng.permutation(len(found))
        for lo in range(0, len(order), batch_size):
            batch = order[lo : lo + batch_size]
            sizes = starts[batch + 1] - starts[batch]
            own = np.repeat(np.arange(len(batch)), sizes)
            term = flat[np.repeat(starts[batch] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())]
            logit, sums = m.margin(term, own, len(batch))
            error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[batch]) / len(batch)
            hit, where = np.unique(term, return_inverse=True)
            if not len(hit):
                continue
            dw = np.bincount(where, error[own], len(hit)) + decay * m.weights[hit] / len(order) * len(batch)
            dv = np.stack([np.bincount(where, error[own] * (sums[own, f] - m.factors[term, f]), len(hit)) for f in range(FACTORS)], axis=1)
            dv += decay * m.factors[hit]
            gw[hit] += dw * dw
            gv[hit] += dv * dv
            gb += error.sum() ** 2
            m.weights[hit] -= rate * dw / np.sqrt(gw[hit])
            m.factors[hit] -= 0.1 * rate * dv / np.sqrt(gv[hit])
            m.bias -= rate * error.sum() / np.sqrt(gb)
    return m


def at_prior(machine: Machine, sample: np.ndarray, positives: int, negatives: int) -> Machine:
    """The machine with the bias of labels that are in the given proportion, and not in that of the sample it was trained on."""
    drawn = sample.sum()
    if 0 < drawn < len(sample):
        machine.bias += float(np.log(positives / negatives) - np.log(drawn / (len(sample) - drawn)))
    return machine


def held_out(key: Column) -> Column:
    """Whether crc32 of the key as text leaves 2 when divided by 4; a null key isn't held out."""
    return F.coalesce(F.crc32(key.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Machine:
    """A machine trained on at most SAMPLE labelled documents that aren't held out.

    Their terms are hashed on the executors; the driver gets bucket numbers only, of one text a key: the one of smallest
    hash where a key repeats. Scores are chances at the share of positive labels among all that aren't held out, however
    many of either the sample holds. Without labels of both kinds the score is the share of positive labels.
    """
    named = labels.select(F.col(key).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("label IN (0, 1) AND doc_id IS NOT NULL")
    named = named.where(~held_out(F.col("doc_id")))
    counts = {r[0]: r[1] for r in named.groupBy("label").agg(F.count("*")).collect()}
    halves = [smallest(named.where(f"label = {v}"), F.xxhash64("doc_id"), SAMPLE // 2, counts.get(v, 0), "doc_id") for v in (0, 1)]
    chosen = materialize(halves[0].unionByName(halves[1]), "chosen")
    body = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in batches:
            found = [terms.of(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), batch.column(0)], ["terms", "label"])

    own = body.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows = own.join(F.broadcast(chosen), "doc_id").select("label", "text").mapInArrow(run, "terms array<int>, label int")
    got = rows.toArrow()
    found = got.column("terms").combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.int32()))
    found = found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found
    offsets, flat = found.offsets.to_numpy(), found.values.to_numpy()
    lists = [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    y = got.column("label").to_numpy().astype(float)
    order = sorted(range(len(lists)), key=lambda i: (lists[i].tobytes(), y[i]))  # rows come in any order
    return at_prior(train([lists[i] for i in order], y[order]), y, counts.get(1, 0), counts.get(0, 0))


def _scored(machine: Machine, text: str):
    """For batches with a text column: parts of them, each with its scores."""
    packed = pickle.dumps(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        own = pickle.loads(packed)
        terms = Terms(own.used)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield part, own.score([x.as_py() for x in part.column(text)], terms)

    return run


def score(docs: DataFrame, machine: Machine, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score of each row of docs; a null or empty text has the bias alone. The whole text is read."""
    parts = _scored(machine, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, scores in parts(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores)], ["doc_id", "score"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted (1 from THRESHOLD on) for each row of docs.

    Learns from labelled rows that aren't held out; labels, languages, sources and keys are no inputs of a score.
    Null text scores as the empty one, long texts are scored whole. Repeated rows score alike; a null key is not held out;
    without labels of both kinds the score is their share. Other columns are ignored, whatever their names; an empty table
    gives no rows.
    """
    scored = score(docs, fit(docs, labels, key, text, label), key, text)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """The rows of docs that score below THRESHOLD, with all their columns. Texts are scored where they are; nothing shuffles."""
    parts = _scored(fit(docs, labels, key, text, label), text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, scores in parts(batches):
            yield part.filter(pa.array(scores < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
