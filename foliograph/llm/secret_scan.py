"""Scans of texts for secrets: patterns, and a character convolutional network over every other candidate.

The patterns' findings always stay. Every other run of characters that could be a secret is a candidate; the network reads
it with the characters around it, in windows, and adds it if its calibrated chance passes a threshold. The network is
trained on all labelled findings, by many tasks whose networks are averaged: those of the patterns, as they stand and in other surroundings, against candidates that no
pattern fits. Chances are calibrated, and the threshold is chosen, on findings that it wasn't trained on: of those that find
RECALL of each kind of them one with the fewest false findings, in the middle of their range.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from foliograph.llm.common import drop_tables, materialize

#: The patterns of the kinds, in their order, the group that must have so many characters, and that number.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
PATTERNS = (("assign", ASSIGN, 2, 8), ("access", re.compile(r"AKIA[A-Z0-9]{12,}"), 0, 16), ("hex", re.compile(r"[0-9a-f]{32,}"), 0, 32))
KINDS = tuple(k for k, *_ in PATTERNS)
#: What the network adds.
ADDED = "learned"
#: Other candidates: runs of at least SHORTEST with a letter and a digit.
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
#: Characters around a candidate that are read, and of a candidate in one window; longer ones have windows WIDE - OVER apart.
AROUND, WIDE, OVER = 24, 48, 16
#: Findings that one task trains a network on, those of a label in each task at least (they repeat, if there are too few), and
#: how often the tasks' networks are averaged.
GROUP, LEAST, ROUNDS = 6_000, 500, 3
#: Logits are told apart by so much.
STEP = 1 / 1024
RECALL = 0.98
#: A quarter of the findings calibrates, by the hash of its window.
CALIBRATES = 4
EMBED, KERNEL, FILTERS, HIDDEN = 12, 5, 32, 24
LENGTH = 2 * AROUND + WIDE
FOUND = "doc_id long, kinds array<int>, starts array<int>, ends array<int>, maybe_starts array<int>, maybe_ends array<int>, windows array<array<string>>, secrets array<string>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """start, kind, end of the patterns' findings, by start and kind; leftmost, not overlapping within a kind."""
    return sorted((m.start(), k, m.end()) for k, (_, pattern, group, least) in enumerate(PATTERNS) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least)


def secret_of(text: str, start: int, kind: int) -> tuple[int, int]:
    """Start and end of the secret itself in a finding."""
    _, pattern, group, _ = PATTERNS[kind]
    return pattern.match(text, start).span(group)


def other_candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs that could be secrets and that no finding touches."""
    out, at, reach = [], 0, 0
    for m in RUN.finditer(text):
        while at < len(spans) and spans[at][0] < m.end():
            reach = max(reach, spans[at][2])
            at += 1
        run = m[0]
        if reach <= m.start() and re.search("[0-9]", run) and re.search("[A-Za-z]", run):
            out.append(m.span())
    return out


def windows(text: str, start: int, end: int) -> list[str]:
    """What the network reads of a candidate: before, inside and after, each of fixed width. The windows cover all of it."""
    before, after = text[max(0, start - AROUND) : start].rjust(AROUND, "\0"), text[end : end + AROUND].ljust(AROUND, "\0")
    at = [start] if end - start <= WIDE else [*range(start, end - WIDE, WIDE - OVER), end - WIDE]
    return [before + text[a : min(end, a + WIDE)].ljust(WIDE, "\0") + after for a in at]


def codes(rows: list[str]) -> np.ndarray:
    """Characters as numbers below 2 * 98: printable ASCII, none, white space and others, apart inside and around."""
    points = np.frombuffer("".join(rows).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(rows), LENGTH)
    out = np.where((points > 32) & (points < 127), points - 32, np.where(points == 0, 0, np.where(points <= 32, 96, 97))).astype(np.int64)
    out[:, AROUND : AROUND + WIDE] += 98
    return out


@dataclass
class Network:
    """Embedding, one convolution, largest values inside and around, one hidden layer, one logit."""

    p: dict[str, np.ndarray]
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 1.0

    @staticmethod
    def new(seed: int) -> Network:
        rng = np.random.default_rng(seed)
        shapes = {"e": (196, EMBED), "k": (KERNEL * EMBED, FILTERS), "kb": (FILTERS,), "h": (3 * FILTERS, HIDDEN), "hb": (HIDDEN,), "o": (HIDDEN,), "ob": (1,)}
        return Network({n: (rng.normal(0, np.sqrt(2 / s[0]), s) if len(s) > 1 else rng.normal(0, 0.2, s) if n == "o" else np.zeros(s)).astype(np.float32) for n, s in shapes.items()})

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        p = self.p
        flat = p["e"][x].reshape(len(x), LENGTH * EMBED)
        strides = (flat.strides[0], EMBED * flat.itemsize, flat.itemsize)
        cols = np.lib.stride_tricks.as_strided(flat, (len(x), LENGTH - KERNEL + 1, KERNEL * EMBED), strides)
        conv = np.maximum(cols @ p["k"] + p["kb"], 0)
        inside = conv[:, AROUND : AROUND + WIDE - KERNEL + 1]
        held = (x[:, AROUND : AROUND + WIDE - KERNEL + 1] != 98)[:, :, None]
        sizes = np.maximum(held.sum(axis=1), 1)
        around = np.concatenate((conv[:, :AROUND], conv[:, AROUND + WIDE - KERNEL + 1 :]), axis=1)
        pooled = np.concatenate((inside.max(axis=1), around.max(axis=1), (inside * held).sum(axis=1) / sizes), axis=1)
        hidden = np.maximum(pooled @ p["h"] + p["hb"], 0)
        return hidden @ p["o"] + p["ob"][0], (flat, cols, conv, inside, around, held, sizes, pooled, hidden)

    def backward(self, x: np.ndarray, error: np.ndarray, kept: tuple) -> dict[str, np.ndarray]:
        p, (_, cols, conv, inside, around, held, sizes, pooled, hidden) = self.p, kept
        g = {"o": hidden.T @ error, "ob": error.sum(keepdims=True)}
        dh = np.outer(error, p["o"]) * (hidden > 0)
        g["h"], g["hb"] = pooled.T @ dh, dh.sum(axis=0)
        dp = dh @ p["h"].T
        d_in = (dp[:, None, 2 * FILTERS :] * held / sizes[:, None, :]).astype(np.float32)
        rows, filters = np.arange(len(x))[:, None], np.arange(FILTERS)[None, :]
        d_in[rows, inside.argmax(axis=1), filters] += dp[:, :FILTERS]
        d_out = np.zeros_like(around)
        d_out[rows, around.argmax(axis=1), filters] = dp[:, FILTERS : 2 * FILTERS]
        d_conv = np.concatenate((d_out[:, :AROUND], d_in, d_out[:, AROUND:]), axis=1) * (conv > 0)
        flat_d = d_conv.reshape(-1, FILTERS)
        g["k"], g["kb"] = cols.reshape(-1, KERNEL * EMBED).T @ flat_d, flat_d.sum(axis=0)
        back = (d_conv @ p["k"].T).reshape(len(x), -1, KERNEL, EMBED)
        d_e = np.zeros((len(x), LENGTH, EMBED), np.float32)
        for i in range(KERNEL):
            d_e[:, i : i + back.shape[1]] += back[:, :, i]
        g["e"] = np.stack([np.bincount(x.ravel(), d_e[:, :, j].ravel(), 196) for j in range(EMBED)], axis=1)
        return g

    def logits(self, rows: list[str]) -> np.ndarray:
        parts = [self.forward(codes(rows[at : at + 256]))[0] for at in range(0, len(rows), 256)]
        return np.round(np.concatenate(parts).astype(float) / STEP) * STEP if parts else np.zeros(0)

    def chances(self, rows: list[str]) -> np.ndarray:
        return self.chance(self.logits(rows))

    def chance(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * logits + self.shift, -30, 30)))


def train(rows: list[str], labels: np.ndarray, epochs: int = 12, rate: float = 3e-3, seed: int = 7, net: Network | None = None) -> Network:
    """Adam on logistic loss, from net if there is one; either label has the same weight in all."""
    rng, net = np.random.default_rng(seed), net or Network.new(seed)
    first, second = ({n: np.zeros(v.shape) for n, v in net.p.items()} for _ in range(2))
    weight = np.where(labels > 0, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
    x, step = codes(rows), 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), 64):
            own = order[lo : lo + 64]
            logit, kept = net.forward(x[own])
            error = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[own]) * weight[own] / len(own)
            step += 1
            for n, g in net.backward(x[own], error, kept).items():
                first[n] += 0.1 * (g - first[n])
                second[n] += 0.001 * (g * g - second[n])
                net.p[n] -= (rate * first[n] / (1 - 0.9**step) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def calibrated(net: Network, z: np.ndarray, labels: np.ndarray, kinds: np.ndarray, n: np.ndarray) -> Network:
    """Slope and shift of logits that occur n times by Newton's method on smoothed labels, and the threshold: RECALL of each kind binds it, false findings tell how high it need be."""
    ones, zeros = n[labels > 0].sum(), n[labels == 0].sum()
    want = np.where(labels > 0, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    design, at = np.stack((z, np.ones(len(z))), axis=1), np.array([1.0, 0.0])

    def loss(w: np.ndarray) -> float:
        m = design @ w
        return float((n * (np.logaddexp(0, m) - want * m)).sum())

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ at, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (n * p * (1 - p))[:, None]) + 1e-6 * np.eye(2), design.T @ (n * (p - want)))
        size = 1.0
        while size > 1e-6 and loss(at - size * step) > loss(at):
            size /= 2
        at = at - size * step
    net.slope, net.shift = max(1e-3, float(at[0])), float(at[1])
    chance, least = net.chance(z), []
    for kind in np.unique(kinds[labels > 0]):
        own = np.flatnonzero((labels > 0) & (kinds == kind))
        own = own[np.argsort(chance[own])]
        upto = np.cumsum(n[own])
        least.append(chance[own[np.searchsorted(upto, np.floor((1 - RECALL) * upto[-1]), side="right")]])
    below = chance[(labels == 0) & (chance < min(least))]
    net.threshold = max(0.5, (min(least) + below.max(initial=0)) / 2)
    return net


def moved(row: str, other: str) -> str:
    """A finding's characters in the surroundings of another candidate."""
    return other[:AROUND] + row[AROUND : AROUND + WIDE] + other[AROUND + WIDE :]


def recased(row: str, rng: np.random.Generator) -> str:
    """A secret of the same shape: letters and digits drawn anew, of the alphabet that the finding has."""
    inside = row[AROUND : AROUND + WIDE].rstrip("\0")
    small = "abcdef" if re.fullmatch("[0-9a-fA-F]+", inside) else "abcdefghijklmnopqrstuvwxyz"
    letters = {0: small.upper(), 1: small, 2: small + small.upper()}[int(rng.integers(3))] + "0123456789"
    drawn = "".join(letters[i] for i in rng.integers(len(letters), size=len(inside)))
    return row[:AROUND] + drawn.ljust(WIDE, "\0") + row[AROUND + WIDE :]


def shown(good: list[tuple[str, int]], bad: list[tuple[str, int]], seed: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Windows, labels and kinds. All are shown as they stand and in other surroundings, positives drawn anew too: what a candidate looks like has to tell more than where it stands."""
    rng, out = np.random.default_rng(seed), []
    for w, k in bad:
        out += [(w, 0, k), (moved(w, bad[int(rng.integers(len(bad)))][0]), 0, k)]
    for w, k in good:
        other = bad[int(rng.integers(len(bad)))][0]
        out += [(w, 1, k), (moved(w, other), 1, k), (moved(recased(w, rng), other), 1, k)]
    rows, labels, kinds = zip(*out, strict=True)
    return list(rows), np.array(labels, float), np.array(kinds)


def trusted(good: list[tuple[str, int]], bad: list[tuple[str, int]], seed: int) -> list[tuple[str, int]]:
    """The negatives that a network of the other half of the findings doesn't take for secrets: some are secrets that no pattern fits."""
    out = []
    for half in (0, 1):
        own, rest = bad[half::2], bad[1 - half :: 2]
        if own and rest and good[half::2]:
            rows, labels, _ = shown(good[half::2], own, seed)
            net = train(rows, labels, epochs=6, seed=seed)
            chance = net.chances([w for w, _ in rest])
            rest = [f for f, c in zip(rest, chance, strict=True) if c < 0.5]
        out += rest
    return out


def fit(found: list[tuple[str, int]], seed: int = 7) -> Network | None:
    """A network of labelled windows (text, kind; -1: no secret), or none without both labels in either part."""
    found = sorted(set(found))
    later = np.array([hashlib.sha256(w.encode("utf-8", "surrogatepass")).digest()[0] % CALIBRATES == 0 for w, _ in found], bool)
    parts = []
    for fold in (False, True):
        own = [f for f, x in zip(found, later, strict=True) if x == fold]
        good, bad = [f for f in own if f[1] >= 0], [f for f in own if f[1] < 0]
        bad = bad if fold else trusted(good, bad, seed)
        if not good or not bad:
            return None
        parts.append(shown(good, bad, seed + fold))
    net = train(*parts[0][:2], seed=seed)
    rows, labels, kinds = parts[1]
    return calibrated(net, net.logits(rows), labels, kinds, np.ones(len(rows)))


def candidates(docs: DataFrame, key: str, text: str) -> DataFrame:
    """FOUND: the patterns' findings and the other candidates with their windows, of each row of docs; texts are read here only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in FOUND.split(", ")]
        kinds = [pa.int64(), *[pa.list_(pa.int32())] * 5, pa.list_(pa.list_(pa.string())), pa.list_(pa.string())]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for key_of, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body = value.as_py() or ""
                spans = base_spans(body)
                maybe = other_candidates(body, spans)
                row = (key_of, [k for _, k, _ in spans], [s for s, *_ in spans], [e for *_, e in spans], [a for a, _ in maybe], [b for _, b in maybe], [windows(body, a, b) for a, b in maybe], [windows(body, *secret_of(body, s, k))[0] for s, k, _ in spans])
                for column, cell in zip(out, row, strict=True):
                    column.append(cell)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names)

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, FOUND)


def labelled(found: DataFrame) -> DataFrame:
    """row, kind: windows of the patterns' findings (the secret itself inside), and of other candidates (kind -1)."""
    own = found.select(F.explode(F.arrays_zip("secrets", "kinds")).alias("f")).select(F.col("f.secrets").alias("row"), F.col("f.kinds").alias("kind"))
    other = found.select(F.explode("windows").alias("w")).select(F.col("w")[0].alias("row"), F.lit(-1).alias("kind"))
    return own.unionByName(other)


def learn(found: DataFrame) -> Network | None:
    """A network of all findings and other candidates (row, kind). Those of one task are fitted where they are read together, more by many tasks."""
    found = materialize(found.distinct(), "findings")
    count = found.count()
    if count <= GROUP:
        got = found.toArrow().to_pydict()
        net = fit(list(zip(got["row"], got["kind"], strict=True)))
    else:
        net = fit_apart(found)
    drop_tables(found)
    return net


def dealt(found: DataFrame) -> DataFrame | None:
    """found with group: about GROUP rows each, and of either label LEAST or all there are; a label's rows repeat if they are too few. None without both labels."""
    counts = {r[0]: r[1] for r in found.groupBy(F.col("kind") >= 0).agg(F.count("*")).collect()}
    if len(counts) < 2:
        return None
    groups = -(-sum(counts.values()) // GROUP)
    copies = {v: min(groups, -(-groups * LEAST // n)) for v, n in counts.items()}
    first = F.pmod(F.xxhash64("row"), F.lit(groups))
    many = F.when(F.col("kind") >= 0, copies[True]).otherwise(copies[False])
    return found.withColumn("group", F.explode(F.transform(F.sequence(F.lit(0), many - 1), lambda i: F.pmod(first + i, F.lit(groups)))))


def _each(groups: DataFrame) -> GroupedData:
    """Its groups, in as many partitions: their work is long and their rows few, so Spark must not put them together."""
    return groups.repartition((groups.agg(F.max("group")).first()[0] or 0) + 1, "group").groupBy("group")


def _halved(pdf: pd.DataFrame) -> tuple[list[tuple[str, int]], list[tuple[str, int]]]:
    own = sorted(zip(pdf["row"], pdf["kind"].tolist(), strict=True))
    return [f for f in own if f[1] >= 0], [f for f in own if f[1] < 0]


def train_apart(found: DataFrame, epochs: int, seed: int) -> Network | None:
    """A network of all rows of found: each group trains the last average further, and the groups' networks are averaged, ROUNDS times."""
    groups, net = dealt(found), Network.new(seed)
    if groups is None:
        return None
    groups = materialize(groups, "dealt")
    for turn in range(ROUNDS):
        start = pickle.dumps(net)

        def run(pdf: pd.DataFrame) -> pd.DataFrame:  # noqa: B023
            good, bad = _halved(pdf)
            own: Network = pickle.loads(start)
            if good and bad:
                own = train(*shown(good, bad, seed + turn)[:2], epochs=epochs // ROUNDS, seed=seed + turn, net=own)
            flat = np.concatenate([v.ravel() for v in own.p.values()]).astype(float)
            return pd.DataFrame({"at": np.arange(len(flat)), "v": np.round(flat * (1 << 30)).astype(np.int64)})

        sums = _each(groups).applyInPandas(run, "at int, v long").groupBy("at").agg(F.sum("v").alias("v"), F.count("*").alias("n")).toPandas().sort_values("at")
        flat, at = (sums["v"] / sums["n"] / (1 << 30)).to_numpy(np.float32), 0
        for name, v in net.p.items():
            net.p[name] = flat[at : at + v.size].reshape(v.shape).copy()
            at += v.size
    drop_tables(groups)
    return net


def fit_apart(found: DataFrame, seed: int = 7) -> Network | None:
    """As fit, of any number of distinct windows: every one trains or calibrates."""
    digest = F.sha2("row", 256)
    byte = lambda i: F.conv(F.substring(digest, 2 * i + 1, 2), 16, 10).cast("int")
    found = found.withColumn("later", byte(0) % CALIBRATES == 0).withColumn("half", byte(1) % 2)
    now, good = found.where("NOT later").select("row", "kind", "half"), found.where("NOT later AND kind >= 0").select("row", "kind")
    kept = []
    for half in (0, 1):
        net, rest = train_apart(now.where(f"half = {half}").select("row", "kind"), 6, seed), now.where(f"half <> {half} AND kind < 0").select("row", "kind")
        kept.append(rest if net is None else _unlike(rest, net))
    net = train_apart(good.union(kept[0]).union(kept[1]), 12, seed)
    groups = dealt(found.where("later").select("row", "kind"))
    if net is None or groups is None:
        return None
    packed = pickle.dumps(net)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        good, bad = _halved(pdf)
        if not good or not bad:
            return pd.DataFrame({"z": [], "label": [], "kind": []}, dtype="int64")
        rows, labels, kinds = shown(good, bad, seed + 1)
        return pd.DataFrame({"z": np.round(pickle.loads(packed).logits(rows) / STEP).astype(np.int64), "label": labels.astype(int), "kind": kinds})

    held = _each(groups).applyInPandas(run, "z long, label int, kind int").groupBy("z", "label", "kind").agg(F.count("*").alias("n")).toPandas().sort_values(["z", "label", "kind"])
    return calibrated(net, held["z"].to_numpy() * STEP, held["label"].to_numpy(), held["kind"].to_numpy(), held["n"].to_numpy(float))


def _unlike(rows: DataFrame, net: Network) -> DataFrame:
    """The rows that net doesn't take for secrets."""
    packed = pickle.dumps(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(pickle.loads(packed).chances(batch.column(0).to_pylist()) < 0.5))

    return rows.mapInArrow(run, "row string, kind int")


def judged(found: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, kinds, starts, ends of all findings: the patterns', and the candidates that pass the network's threshold (kind ADDED)."""
    packed = pickle.dumps(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Network | None = pickle.loads(packed)
        for batch in batches:
            rows = batch.to_pylist()
            flat = [w for r in rows for ws in r["windows"] for w in ws]
            chance = iter(own.chances(flat).tolist() if own else [0.0] * len(flat))
            cells = []
            for r in rows:
                spans = list(zip(r["starts"], r["kinds"], r["ends"], strict=True))
                for a, b, ws in zip(r["maybe_starts"], r["maybe_ends"], r["windows"], strict=True):
                    best = max([next(chance) for _ in ws])
                    if own and best >= own.threshold:
                        spans.append((a, len(KINDS), b))
                cells.append(sorted(spans))
            lists = [pa.array([[s[i] for s in c] for c in cells], pa.list_(pa.int32())) for i in (1, 0, 2)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *lists], ["doc_id", "kinds", "starts", "ends"])

    return found.mapInArrow(run, "doc_id long, kinds array<int>, starts array<int>, ends array<int>")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, kinds, starts, ends of each row of docs (kinds by their place in KINDS, then ADDED), by start and kind.

    Starts and ends are code points of the whole text; a null text is an empty one and has none. Rows that repeat are
    scanned alike, a null key stays null. Without findings and other candidates to learn from, the patterns' findings are
    all there are. Long candidates are read in windows that cover them. Other columns are ignored, whatever their names; an
    empty table gives no rows.
    """
    found = materialize(candidates(docs, key, text), "candidates")
    return judged(found, learn(labelled(found)))


def digests(found: DataFrame) -> DataFrame:
    """Counts by kind, the digest of the patterns' findings, and all findings as text, of the rows of scan."""
    names = F.array(*[F.lit(k) for k in (*KINDS, ADDED)])
    each = F.arrays_zip("kinds", "starts", "ends")
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kinds"] + 1), s["starts"], s["ends"])), ",")
    base = F.filter(each, lambda s: s["kinds"] < len(KINDS))
    counts = [F.size(F.array_remove("kinds", i)) for i in range(len(KINDS))]
    counts = [(F.size("kinds") - n).cast("long").alias(f"n_{name}") for n, name in zip(counts, KINDS, strict=True)]
    return found.select("doc_id", *counts, F.sha2(said(base), 256).alias("base_sha256"), said(each).alias("spans"))


def redact(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text", mark: str = "[secret]") -> DataFrame:
    """The rows of docs with each finding (of scan, one row a key) replaced by mark; findings that overlap are replaced as one."""
    spans = found.select(F.col("doc_id").alias("_id"), F.col("starts").alias("_starts"), F.col("ends").alias("_ends")).where(F.size("starts") > 0)
    joined = docs.join(spans, docs[key].cast("long").eqNullSafe(F.col("_id")), "left")
    names = docs.columns
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for body, starts, ends in zip(*(batch.column(c).to_pylist() for c in (text, "_starts", "_ends")), strict=True):
                pieces, reach = [], 0
                for a, b in sorted(zip(starts or [], ends or [], strict=True)):
                    if a >= reach:
                        pieces += [body[reach:a], mark]
                    reach = max(reach, b)
                out.append(body if not pieces else "".join(pieces) + body[reach:])
            columns = [batch.column(i) for i in range(len(names))]
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.select(*names, "_starts", "_ends").mapInArrow(run, docs.schema)
