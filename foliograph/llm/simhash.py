"""SimHash fingerprints and near-duplicate classes through vantage-point trees.

A tree cuts fingerprint space by Hamming distance: a node has a vantage fingerprint and a radius, near points go left and
far points right. Two points within a link lie on one side, or the far one within the link of the border; so a far point in
that band also visits the left side, and by the triangle inequality no other branch can hold a linked partner. Every linked
pair thus meets in a leaf, where it is found exactly. Random fingerprints crowd around the border, so the link must be
short: the bits are parted, and a pair that differs in 4 bits differs in at most 1, 1 or 0 bits of one of three parts, each
of which has a tree of its own. Only distinct fingerprints enter the trees, and a leaf returns a spanning forest of its
links, so a group of copies never becomes all its pairs. Classes then come from alternating stars over those edges.

64 bits tell few differing bits exactly, but not a similarity of 0.8, at which texts differ in up to 20 bits and unlike
texts are found by chance. Similar texts (drop_near_duplicates) are therefore found by prefix filtering: in any one order of
all shingles, two sets of a similarity of 0.8 share a shingle among the first fifth of each. Sets that do are compared
shingle by shingle, so no pair is lost or told by an estimate.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from foliograph.llm.common import materialize, smallest
from foliograph.llm.exact_dedup import filter_of, repeated, tested

#: A leaf is planned for so many fingerprints, with visitors; one of over MOST is compared in blocks.
LEAF, MOST = 1 << 14, 500_000
#: Share of a node's points that visit the other side of a border of one bit, about.
VISIT = 0.17
#: Vantage points and radii are fitted on so many fingerprints at most.
SAMPLE = 20_000
#: Shingles that are hashed at a time; bounds memory on very long texts.
CHUNK = 1 << 16
BANDS = 5
#: Texts that tell about which shingles are common, or every so manieth one if that is more, and common shingles at most;
#: a shingle is in few heads if in so many.
SHINGLED, EVERY, COMMON, FEW = 8_000, 8, 1 << 18, 8
#: Differing bits that link two SimHash fingerprints of similar texts.
LINK = 4
#: Sets of a shingle of many that those of other classes are compared with, turn by turn, before the rest meets all.
HUBS = (2, 16)
#: Texts that are looked up in a broadcast at most; more meet theirs in a shuffle.
LOOKED_UP = 500_000
#: Texts whose shingles a worker holds at a time.
TEXTS = 64


def shingle_hashes(text: str | None, width: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of every shingle of the text, in blocks. A text of fewer words is one shingle, of none: none."""
    body = b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())
    if not body:
        return
    gaps = np.flatnonzero(np.frombuffer(body, np.uint8) == 32)
    starts = np.concatenate(([0], gaps + 1))
    ends = np.concatenate((gaps, [len(body)]))
    count = max(1, len(starts) - width + 1)
    ends = ends[width - 1 :] if len(starts) >= width else ends[-1:]
    digest = xxhash.xxh64_intdigest
    for at in range(0, count, CHUNK):
        pairs = zip(starts[at : min(count, at + CHUNK)].tolist(), ends[at : at + CHUNK].tolist(), strict=True)
        yield np.array([digest(body[a:b], 42) for a, b in pairs], np.uint64)


def fingerprint(text: str | None, width: int) -> int:
    """Bit i is 1 if it is 1 in over half the hashes; zero for a text without words."""
    return simhash_of(shingle_hashes(text, width))


def simhash_of(blocks: Iterable[np.ndarray]) -> int:
    """The fingerprint of hashes that come in blocks, as a signed number."""
    total, ones = 0, np.zeros(64, np.int64)
    for hashes in blocks:
        total += len(hashes)
        ones += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > total, bitorder="little")
    return int(bits.view("<i8")[0])


def with_fingerprints(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """doc_id, fp (signed long) for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(x.as_py(), width) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


def parted(link: int) -> list[tuple[int, int]]:
    """(mask, link) of parts of the 64 bits: two fingerprints within `link` bits are within a part's own link in one of them, at least."""
    links = [1] * ((link + 1) // 2) + [0] * ((link + 1) % 2)
    cuts = np.linspace(0, 64, len(links) + 1).astype(int).tolist()
    return [((1 << hi) - (1 << lo), own) for lo, hi, own in zip(cuts[:-1], cuts[1:], links, strict=True)]


def distance(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """Differing bits."""
    return np.bitwise_count(a ^ b)


def plant(sample: np.ndarray, depth: int, mask: int, link: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Vantage points and radii of a full tree of that depth on the masked bits, node n's children being 2n+1 and 2n+2.

    A node's vantage point is the one of some sampled candidates that leaves the fewest points in the border band
    for the evenest cut; below an empty node any will do.
    """
    rng, masked = np.random.default_rng(seed), np.uint64(mask)
    middle = mask.bit_count() // 2
    points, radii = np.zeros((1 << depth) - 1, np.uint64), np.full((1 << depth) - 1, middle, np.int64)
    held = {0: sample & masked}
    for node in range(len(points)):
        own = held.pop(node)
        best = None
        for vantage in [*rng.choice(own, min(len(own), 6), replace=False), (rng.integers(0, 1 << 63, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, dtype=np.uint64)) & masked]:
            d = distance(own, vantage)
            radius = int(np.median(d)) if len(d) else middle
            for r in {max(0, radius - 1), radius}:
                larger = max(np.count_nonzero(d <= r + link), np.count_nonzero(d > r))
                if best is None or larger < best[0]:
                    best = (larger, vantage, r, d)
        _, points[node], radii[node], d = best
        held[2 * node + 1], held[2 * node + 2] = own[d <= radii[node]], own[d > radii[node]]
    return points, radii


def routed(fps: np.ndarray, points: np.ndarray, radii: np.ndarray, depth: int, link: int) -> tuple[np.ndarray, np.ndarray]:
    """Leaves and positions in fps: the leaf that owns each, and those it visits."""
    node, at = np.zeros(len(fps), np.int64), np.arange(len(fps))
    for _ in range(depth):
        d = distance(fps[at], points[node]).astype(np.int64)
        left, right = d <= radii[node] + link, d > radii[node]
        node, at = np.concatenate((2 * node[left] + 1, 2 * node[right] + 2)), np.concatenate((at[left], at[right]))
    return node, at


class _Forest:
    """Union by smallest position."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def find(self, x: int) -> int:
        root = self.root
        while root[x] != x:
            root[x] = root[root[x]]
            x = int(root[x])
        return x

    def flat(self) -> np.ndarray:
        while True:
            up = self.root[self.root]
            if np.array_equal(up, self.root):
                return up
            self.root = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        flat = self.flat()
        open_ = flat[a] != flat[b]
        for x, y in zip(a[open_].tolist(), b[open_].tolist(), strict=True):
            x, y = self.find(x), self.find(y)
            if x != y:
                self.root[max(x, y)] = min(x, y)


def leaf_links(fps: np.ndarray, link: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of all pairs within `link` bits among distinct fps: each point and its root.

    A pair within 4 bits agrees on one of 5 bands, so each band's equal values are compared with one another, at ever
    larger lags in sorted order; a run of equal values that is one class already is left off.
    """
    forest, bands = _Forest(len(fps)), max(BANDS, link + 1)
    cuts = np.linspace(0, 64, bands + 1).astype(int)
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        value = (fps >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)
        order = np.argsort(value, kind="stable")
        sorted_ = value[order]
        run = np.cumsum(np.concatenate(([0], sorted_[1:] != sorted_[:-1]))) if len(fps) else np.zeros(0, int)
        lag = 1
        while len(order) > lag:
            same = np.flatnonzero(run[lag:] == run[:-lag])
            if not len(same):
                break
            a, b = order[same], order[same + lag]
            near = distance(fps[a], fps[b]) <= link
            if near.any():
                forest.join(a[near], b[near])
            if lag in (1, 2, 4, 8) or lag % 16 == 0:  # keep the runs that can still gain from a larger lag
                roots, heads = forest.flat()[order], np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))
                sizes = np.diff(np.append(heads, len(run)))
                keep = (np.minimum.reduceat(roots, heads) != np.maximum.reduceat(roots, heads)) & (sizes > lag + 1)
                rows = np.repeat(keep, sizes)
                order, run = order[rows], run[rows]
            lag += 1
    root = forest.flat()
    own = np.flatnonzero(root != np.arange(len(fps)))
    return own, root[own]


def depth_for(count: int, link: int) -> int:
    """Levels after which a leaf has about LEAF points: each level halves them and lets VISIT of them, if any, visit."""
    kept = (1 + (VISIT if link else 0)) / 2
    return max(0, int(np.ceil(np.log(max(1, count / LEAF)) / -np.log(kept))))


def visits(fps: DataFrame, count: int, link: int) -> DataFrame:
    """tree, leaf, fp: the leaves of each part's tree that each fp belongs to or visits."""
    parts = [(mask, own, depth_for(count, own)) for mask, own in parted(link)]
    sample = np.array([r[0] for r in smallest(fps.select("fp"), F.xxhash64("fp"), SAMPLE, count).collect()] if any(d for _, _, d in parts) else [], np.int64).view(np.uint64)
    planted = [(np.uint64(mask), own, depth, *plant(sample, depth, mask, own)) for mask, own, depth in parts]

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy().view(np.uint64)
            for tree, (mask, near, depth, points, radii) in enumerate(planted):
                leaf, at = routed(own & mask, points, radii, depth, near)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), tree, np.int32)), pa.array(leaf), pa.array(own[at].view(np.int64))], ["tree", "leaf", "fp"])

    return fps.select("fp").mapInArrow(visit, "tree int, leaf long, fp long")


def linked(fps: DataFrame, count: int, link: int) -> DataFrame:
    """u, v: edges between distinct fingerprints whose classes are those of all links within `link` bits.

    A leaf of more than MOST points is cut into blocks, and each pair of its blocks is a group of its own.
    """
    met = materialize(visits(fps, count, link), "visits")
    large = met.groupBy("tree", "leaf").agg(F.count("*").alias("n")).where(F.col("n") > MOST).select("tree", "leaf", F.ceil(F.col("n") / MOST).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.least(x, own) * F.col("blocks") + F.greatest(x, own))
    dealt = met.join(large, ["tree", "leaf"], "left").select("tree", "leaf", "fp", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(others)).alias("block"))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        own = np.unique(pdf["fp"].to_numpy()).view(np.uint64)
        a, b = leaf_links(own, link)
        return pd.DataFrame({"u": own[a].view(np.int64), "v": own[b].view(np.int64)})

    return dealt.groupBy("tree", "leaf", "block").applyInPandas(search, "u long, v long")


def classes(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of each class, by alternating large and small stars; nodes without edges are absent.

    Each step is materialised, so that the join with a node's minimum has a plain shuffle on either side and Spark can
    split the partition of a node with very many edges.
    """
    edges = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        edges = materialize(both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = materialize(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, link: int = 4) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id, the smallest key reachable by links.

    A text without words (or null) has fingerprint zero and links like any other. A class whose keys are all null has a
    null component_id; other null keys get their class's. Repeated rows each return. Long texts are whole, other columns are
    ignored, whatever their names. An empty table gives no rows.
    """
    prints = materialize(with_fingerprints(docs, key, text, width), "prints")
    fps = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "fps")
    out = _components(prints, fps, linked(fps, fps.count(), link))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The hashes of the text's distinct shingles, sorted."""
    blocks = list(shingle_hashes(text, width))
    return np.unique(np.concatenate(blocks)) if blocks else np.zeros(0, np.uint64)


def _common(texts: DataFrame, width: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes that some of about SHINGLED texts share, or of every EVERYth one, sorted, and in how many of these. They only set the order of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(x.as_py(), width).view(np.int64))], ["token"])

    some = texts.where(F.pmod("at", F.lit(min(EVERY, max(1, rows // SHINGLED)))) == 0).dropDuplicates(["at"])
    tokens = some.select("text").mapInArrow(run, "token long").groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    got = tokens.orderBy(F.desc("n"), "token").limit(COMMON).toPandas()
    token, n = got["token"].to_numpy(np.int64).view(np.uint64), got["n"].to_numpy(np.int64)
    order = np.argsort(token)
    return token[order], n[order]


def head(own: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first shingles, rare ones before common ones, of which two sets of a similarity of 0.8 share one."""
    token, n = common
    if len(token) and len(own):
        at = np.minimum(np.searchsorted(token, own), len(token) - 1)
        own = own[np.argsort(np.where(token[at] == own, n[at], 0), kind="stable")]
    return own[: len(own) - (4 * len(own) + 4) // 5 + 1]


#: Bits of a set's parities: 64 in each of so many words.
PARITY_WORDS = 8


def parity(own: np.ndarray) -> np.ndarray:
    """Whether an odd number of hashes fall on each place; a hash that only one of two sets has flips one place."""
    odd = np.bincount((own & np.uint64(64 * PARITY_WORDS - 1)).astype(np.int64), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _prints(texts: DataFrame, width: int, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, at, fp (hash of the shingle set), n (its size), head, counts (its hashes by their top byte, up to 255), parity (of its hashes by their low bits), sim (their SimHash) of each row of texts (doc_id, at, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS):
                part = batch.slice(start, TEXTS)
                fps, sizes, heads, counts, parities, sims = [], [], [], [], [], []
                for x in part.column(2):
                    own = shingle_set(x.as_py(), width)
                    fps.append(xxhash.xxh64_intdigest(own.tobytes(), 42))
                    sizes.append(len(own))
                    heads.append(head(own, common).view(np.int64))
                    counts.append(np.minimum(np.bincount((own >> np.uint64(56)).astype(np.int64), minlength=256), 255).astype(np.uint8).tobytes())
                    parities.append(parity(own))
                    sims.append(simhash_of(own[i : i + CHUNK] for i in range(0, len(own), CHUNK)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), _lists(heads), pa.array(counts, pa.binary()), _lists(parities), pa.array(sims, pa.int64())], ["doc_id", "at", "fp", "n", "head", "counts", "parity", "sim"])

    return texts.select("doc_id", "at", "text").mapInArrow(run, "doc_id long, at long, fp long, n long, head array<long>, counts binary, parity array<long>, sim long")


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64)))


def _shared(fps: DataFrame) -> DataFrame:
    """token, fp, n, pos, held: the head's shingles that more than one of the sets (fp, n, head) has in its head; held is how many have it.

    Only shingles that a Bloom filter of the repeated ones lets through move with their set; the others move alone, to be counted.
    """
    often = repeated(fps.select(F.explode("head").alias("token")), "token")
    bits, slots = filter_of(often, "token", often.count())
    tokens = fps.select("fp", "n", F.posexplode("head").alias("pos", "token"))
    maybe = tested(tokens, "token", bits, slots).where("_maybe").join(often.withColumnRenamed("n", "held"), "token")
    return materialize(maybe.select("token", "fp", "n", "pos", "held"), "shared")


#: Whether a set x can have a similarity of 0.8 with a larger set y by a shingle at their pos.
MAY = (
    "(x.n < y.n OR x.n = y.n AND x.fp < y.fp) AND 5 * x.n >= 4 * y.n AND x.pos <= x.n - (8 * x.n + 8) div 9 "
    "AND 9 * (least(x.pos, y.pos) + 1 + least(x.n - x.pos, y.n - y.pos) - 1) >= 4 * (x.n + y.n)"
)
#: Whether sets x and y can be so alike by their parities: no more places differ than hashes that one of the two has.
NEAR = "9 * (" + " + ".join(f"bit_count(x.parity[{i}] ^ y.parity[{i}])" for i in range(PARITY_WORDS)) + ") <= x.n + y.n"


def _verified(pairs: DataFrame, fps: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """The pairs (u, v) of sets whose similarity is 0.8 or more, by their shingles."""

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, 256).astype(np.int16) for c in ("x", "y"))
            apart = np.abs(x - y).sum(axis=1, dtype=np.int64)  # at least so many shingles are in one of the two only
            keep = pa.array(9 * apart <= batch.column("n").to_numpy())
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in batch.columns[:2]], ["u", "v"])

    counted = fps.select("fp", "n", "counts")
    left = counted.select(F.col("fp").alias("u"), F.col("n").alias("nx"), F.col("counts").alias("x"))
    right = counted.select(F.col("fp").alias("v"), F.col("n").alias("ny"), F.col("counts").alias("y"))
    pairs = pairs.distinct().join(left, "u").join(right, "v").select("u", "v", (F.col("nx") + F.col("ny")).alias("n"), "x", "y")
    pairs = materialize(pairs.mapInArrow(possible, "u long, v long"), "pairs")
    needed = pairs.select(F.col("u").alias("fp")).union(pairs.select("v")).distinct().join(fps.select("fp", "at"), "fp")
    needed = materialize(needed, "needed")
    needed = F.broadcast(needed) if needed.count() <= LOOKED_UP else needed
    bodies = materialize(texts.join(needed, "at").groupBy("fp").agg(F.first("text").alias("text")), "bodies")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, TEXTS):
                part = batch.slice(start, TEXTS)
                yield pa.RecordBatch.from_arrays([part.column(0), _lists([shingle_set(x.as_py(), width).view(np.int64) for x in part.column(1)])], ["fp", "own"])

    sets = materialize(bodies.mapInArrow(hashed, "fp long, own array<long>"), "sets")
    both = pairs.join(sets.select(F.col("fp").alias("u"), F.col("own").alias("x")), "u").join(sets.select(F.col("fp").alias("v"), F.col("own").alias("y")), "v")
    shared = both.select("u", "v", F.size(F.array_intersect("x", "y")).alias("both"), (F.size("x") + F.size("y")).alias("n"))
    return materialize(shared.where("5 * both >= 4 * (n - both)").select("u", "v"), "verified")


def _simhash_pairs(fps: DataFrame) -> DataFrame:
    """u, v: sets (fp, sim) whose SimHash fingerprints are linked, by vantage-point trees: a spanning forest of all links of LINK or fewer bits."""
    sims = materialize(fps.groupBy("sim").agg(F.min("fp").alias("own")), "sims")
    links = linked(sims.select(F.col("sim").alias("fp")), sims.count(), LINK)
    ends = [sims.select(F.col("sim").alias(c), F.col("own").alias(own)) for c, own in (("u", "a"), ("v", "b"))]
    apart = links.join(ends[0], "u").join(ends[1], "v").select("a", "b")
    same = fps.join(sims, "sim").where("fp <> own").select("fp", "own")
    return apart.union(same).toDF("a", "b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))


def _hub_pairs(many: DataFrame, turn: int) -> DataFrame:
    """u, v: each set of many (token, fp, n, parity, root) with some of its shingle's sets, drawn for each shingle and turn, that are of another class and whose parities allow it."""
    set_ = F.struct("fp", "n", "parity", "root")
    hubs = many.groupBy("token").agg(F.array(*[F.min_by(set_, F.xxhash64("fp", "token", F.lit(100 * turn + i))) for i in range(HUBS[turn])]).alias("hubs"))
    apart = " + ".join(f"bit_count(parity[{i}] ^ h.parity[{i}])" for i in range(PARITY_WORDS))
    own = f"filter(hubs, h -> h.root <> root AND 5 * least(n, h.n) >= 4 * greatest(n, h.n) AND 9 * ({apart}) <= n + h.n)"
    met = many.join(hubs, "token").select("fp", F.explode(F.expr(own)["fp"]).alias("hub"))
    return met.select(F.least("fp", "hub").alias("u"), F.greatest("fp", "hub").alias("v")).distinct()


def _open(many: DataFrame, edges: DataFrame) -> DataFrame:
    """many with root, by the edges, and main, the shingle's largest class: the rows of shingles whose sets are in more than one class."""
    roots = materialize(classes(edges), "roots").withColumnRenamed("node", "fp")
    many = materialize(many.drop("root", "kinds", "main").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "many")
    sizes = many.groupBy("token", "root").agg(F.count("*").alias("size")).groupBy("token").agg(F.count("*").alias("kinds"), F.max(F.struct("size", "root"))["root"].alias("main"))
    return materialize(many.join(sizes.where("kinds > 1"), "token"), "open")


def _similar_edges(fps: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """u, v: edges between sets (fp, n, at, head, sim, parity) whose classes are those of all pairs of a similarity of 0.8 or more.

    Sets whose SimHash fingerprints the vantage-point trees link are compared, and so are those that share a shingle of their
    heads. Of a shingle that over FEW of them share, each is compared with some drawn ones of other classes, turn by turn (HUBS); then
    those outside the shingle's largest class with all that aren't in their own class and whose parities allow it. No pair is
    left off that isn't in one class already or that can be so alike.
    """
    shared = _shared(fps)
    few, many = shared.where(F.col("held") <= FEW), shared.where(F.col("held") > FEW)
    many = materialize(many.join(fps.select("fp", "parity"), "fp"), "many")
    pairs = few.alias("x").join(few.alias("y"), F.expr("x.token = y.token AND " + MAY)).select(F.col("x.fp").alias("u"), F.col("y.fp").alias("v"))
    edges = _verified(pairs.union(_simhash_pairs(fps)), fps, texts, width)
    for turn in range(len(HUBS)):
        many = _open(many, edges)
        if many.isEmpty():
            return edges
        edges = edges.union(_verified(_hub_pairs(many, turn), fps, texts, width))
    many = _open(many, edges)
    other = many.where("root <> main")
    unlike = f"x.token = y.token AND x.root <> y.root AND {MAY} AND {NEAR}"
    pairs = other.alias("x").join(many.alias("y"), F.expr(unlike)).select("x.fp", "y.fp")
    pairs = pairs.union(many.where("root = main").alias("x").join(other.alias("y"), F.expr(unlike)).select("x.fp", "y.fp")).toDF("u", "v")
    return edges.union(_verified(pairs, fps, texts, width))


def similar_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5) -> DataFrame:
    """One row per row of docs: doc_id, component_id, the smallest key reachable by links of a similarity of 0.8 or more.

    Similarity is the Jaccard similarity of the texts' distinct shingles, counted and not estimated. Texts without words
    are alike. Null keys, repeated rows and an empty table as in near_duplicates.
    """
    return _similar(docs, key, text, width).select("doc_id", "component_id")


def _similar(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """doc_id, at (hash of the text), fp, component_id, chosen (the fp of its class with the smallest key) of each row of docs."""
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("at"))
    prints = materialize(_prints(texts, width, _common(texts, width, docs.count())), "prints")
    fps = materialize(_distinct(prints), "fps")
    return _components(prints.drop("n", "head", "counts", "parity", "sim"), fps, _similar_edges(fps, texts.drop("doc_id"), width))


def _distinct(prints: DataFrame) -> DataFrame:
    """fp, first (the smallest doc_id), at, n, head, counts, parity, sim of each set. Sets of one row pass a Bloom filter and don't move."""
    often = repeated(prints, "fp")
    each = tested(prints.withColumn("first", F.col("doc_id")), "fp", *filter_of(often, "fp", often.count()))
    rest = ["at", "n", "head", "counts", "parity", "sim"]
    alone = each.where("NOT _maybe").select("fp", "first", *rest)
    return alone.unionByName(each.where("_maybe").groupBy("fp").agg(F.min("first").alias("first"), F.min("at").alias("at"), *[F.first(c).alias(c) for c in rest[1:]]))


def _components(prints: DataFrame, fps: DataFrame, links: DataFrame) -> DataFrame:
    """Each row of prints (doc_id, fp, others) with component_id and chosen, the fp of its class with the smallest key, by the links (u, v) between fps (fp, first)."""
    roots = classes(links)
    labelled = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    labelled = materialize(labelled, "labelled")
    names = labelled.groupBy("root").agg(F.min("first").alias("component_id"), F.min_by("fp", F.struct(F.col("first").isNull(), "first", "fp")).alias("chosen"))
    return _by_hot(prints, labelled, names)


def _by_hot(prints: DataFrame, labelled: DataFrame, names: DataFrame) -> DataFrame:
    """Each print's component. Fingerprints with over 1/1000 of the rows, fewer than 1000, are looked up in a broadcast."""
    named = materialize(labelled.join(materialize(names, "names"), "root").select("fp", "component_id", "chosen"), "named")
    rows = prints.count()
    often = prints.groupBy("fp").agg(F.count("*").alias("n")).where(F.col("n") > -(-rows // 1000)).select("fp")
    hot = F.broadcast(materialize(named.join(F.broadcast(often), "fp"), "hot"))
    out = prints.join(hot, "fp").unionByName(prints.join(hot.select("fp"), "fp", "left_anti").join(named, "fp"))
    return out.select(*prints.columns, "component_id", "chosen")


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5) -> DataFrame:
    """docs with one document of each class of similar texts, that of the smallest key; all columns kept.

    Each row is decided by its own text: rows whose text is similar to none stay, whatever becomes of others of their key
    or of a null key. Rows that repeat the chosen one's key and shingles stay all. A class whose keys are all null keeps
    all its rows, as none of them can be told from the others.
    """
    decided = _similar(docs, key, text, width)
    gone = decided.where("component_id IS NOT NULL AND (doc_id IS NULL OR doc_id <> component_id OR fp <> chosen)").select("doc_id", "at").distinct()
    gone = materialize(gone, "gone")
    stay = docs.join(gone, docs[key].cast("long").eqNullSafe(gone["doc_id"]) & (F.xxhash64(docs[text]) == gone["at"]), "left_anti")
    return stay.select(*docs.columns)
