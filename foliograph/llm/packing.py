"""Packing token pieces into sequences by exact complements, then best fit.

Only the number of pieces of each length matters to a packing, so it is planned on the counts of the lengths 1 to the
sequence size, of which there are few whatever the corpus's size. For a gap behind a piece, single lengths, sums of two
and of three that fill it exactly are looked up, and as many sequences are made of a combination as its counts allow; what
remains goes to the fullest open sequence with room. Pieces then take the planned places by their rank in their length.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foliograph.llm.common import gapless_rank, materialize, spread

SIZE = 2048
#: Words whose ids a worker remembers before it starts anew, and characters of a word that it remembers.
WORDS, LONG = 450_000, 64
#: Texts whose unknown words are encoded together.
TEXTS = 64


class WordIds:
    """Ids of texts under a tokenizer whose tokens never reach over white space.

    Words are what stands between spaces and line ends. A plain word, letters of Latin-1 and then punctuation, has the ids
    of its lower-cased letters and those of its punctuation, so only these are looked up; other words are encoded as they
    are. Unknown ones go to the tokenizer many at a time, parted by one of its special tokens, which no word here holds;
    letters of ASCII go to its model alone, if its normalizer and its splits leave them as they are.
    """

    PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?*#$%&()]*)")

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        special = [(i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip or t.single_word or t.normalized)]
        self.part, self.parter = special[0] if special else (None, "")
        self.marks = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or "(?!)")
        self.seen: dict[str, bytes] = {"": b""}
        small, steps = "abcdefghijklmnopqrstuvwxyz", (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer)
        kept = (steps[0] is None or steps[0].normalize_str(small) == small) and steps[1] is not None and [w for w, _ in steps[1].pre_tokenize_str(small)] == [small]
        self.tokenize = self.tokenizer.model.tokenize if kept and not self.marks.search(small) else None

    def _encoded(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        alone = [w for w in words if self.part is None or self.marks.search(w)]
        for word, found in zip(alone, self.tokenizer.encode_batch_fast(alone, add_special_tokens=False), strict=True):
            yield word, array("I", found.ids).tobytes()
        together = words if not alone else list(set(words).difference(alone))
        for at in range(0, len(together), 512):
            some = together[at : at + 512]
            ids = np.array(self.tokenizer.encode_batch_fast([self.parter.join(some)], add_special_tokens=False)[0].ids, "<u4")
            cuts, body = (np.flatnonzero(ids == self.part) * 4).tolist(), ids.tobytes()
            for word, start, stop in zip(some, [0, *[c + 4 for c in cuts]], [*cuts, len(body)], strict=True):
                yield word, body[start:stop]

    def _learn(self, words: set[str]) -> None:
        seen, plain, other, tokenize, match = self.seen, [], [], self.tokenize, self.PLAIN.fullmatch
        for word in words:
            m = match(word) if len(word) <= LONG else None
            if m is None:
                other.append(word)
                continue
            letters, marks = m.groups()
            letters = letters.lower()
            if letters not in seen and tokenize and letters.isascii():  # letters and punctuation are words themselves
                seen[letters] = array("I", [t.id for t in tokenize(letters)]).tobytes()
            if letters in seen and marks in seen:
                seen[word] = seen[letters] + seen[marks]
            else:
                plain.append((word, letters, marks))
        parts = {x for _, a, b in plain for x in (a, b)}.difference(seen)
        seen.update(self._encoded([*parts, *other]))
        seen.update((word, seen[a] + seen[b]) for word, a, b in plain if word not in parts)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        split = [t.replace("\n", " ").split(" ") for t in texts]
        seen = self.seen
        if len(seen) > WORDS:
            seen.clear()
            seen[""] = b""
        new = set().union(*split).difference(seen)
        if new:
            self._learn(new)
        get = seen.__getitem__
        out = [b"".join(map(get, words)) for words in split]
        for word in [w for w in new if len(w) > LONG]:  # texts without spaces are words, and aren't held
            del seen[word]
        return out


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each row's ids, which end in id 0; only longer ones are cut, into pieces of `size`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        coder = word_ids(path)
        for batch in batches:
            rows: list[tuple] = []
            keys = batch.column(0).to_pylist()
            for at in range(0, batch.num_rows, TEXTS):
                bodies = [x.as_py() or "" for x in batch.column(1).slice(at, TEXTS)]
                for doc, ids in zip(keys[at : at + TEXTS], coder.encode(bodies), strict=True):
                    ids += b"\0\0\0\0"
                    for piece, start in enumerate(range(0, len(ids), 4 * size)):
                        own = ids[start : start + 4 * size]
                        rows.append((doc, piece, start // 4, len(own) // 4, zlib.crc32(own)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences), using up the counts of the lengths."""
    left = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    made: list[tuple[tuple[int, ...], int]] = []

    def use(*lengths: int) -> bool:
        many = min(int(left[x]) // lengths.count(x) for x in lengths)
        if many:
            for x in lengths:
                left[x] -= many
            made.append((lengths, many))
        return many > 0

    use(size)
    for length in range(size - 1, 0, -1):
        if left[length] and size - length <= length:
            use(length, size - length)
    for length in range(size - 1, 0, -1):  # two more fill the gap
        gap = size - length
        while left[length]:
            a = np.arange(1, gap // 2 + 1)
            fits = a[(left[a] > 0) & (left[gap - a] > 0)]
            if not any(use(length, gap - int(x), int(x)) for x in fits[::-1]):
                break
    for length in range(size - 1, 0, -1):  # three more do
        gap, stuck = size - length, False
        while left[length] and not stuck:
            stuck = True
            for a in np.flatnonzero(left[1 : max(1, gap - 1)])[::-1] + 1:
                rest = gap - int(a)
                b = np.arange(1, min(int(a), rest // 2) + 1)
                fits = b[(left[b] > 0) & (rest - b <= a) & (left[rest - b] > 0)]
                if any([use(length, int(a), rest - int(x), int(x)) for x in fits[::-1] if left[length]]):
                    stuck = False
                if not left[length]:
                    break
    # best fit, longest first, on groups of equal open sequences
    open_: dict[int, list[list]] = {}
    for length in range(size, 0, -1):
        n = int(left[length])
        while n:
            room = min((r for r in open_ if r >= length), default=None)
            if room is None:
                each = min(n, size // length)
                many = n // each
                open_.setdefault(size - each * length, []).append([(length,) * each, many])
                n -= each * many
                continue
            group = open_[room][-1]
            many = min(n, group[1])
            group[1] -= many
            if not group[1]:
                open_[room].pop()
                if not open_[room]:
                    del open_[room]
            open_.setdefault(room - length, []).append([(*group[0], length), many])
            n -= many
    return made + [(tuple(lengths), many) for groups in open_.values() for lengths, many in groups]


def places(planned: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: where ranks begin that a sequence form takes, its first sequence, its places, and their offsets."""
    spans: dict[int, list[tuple]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for lengths, many in planned:
        offsets: dict[int, list[int]] = {}
        at = 0
        for x in lengths:
            offsets.setdefault(x, []).append(at)
            at += x
        for x, own in offsets.items():
            first = used.get(x, 0)
            spans.setdefault(x, []).append((first, sequence, own))
            used[x] = first + many * len(own)
        sequence += many
    out = {}
    for x, rows in spans.items():
        width = max(len(own) for _, _, own in rows)
        out[x] = (np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([len(r[2]) for r in rows]), np.array([r[2] + [0] * (width - len(r[2])) for r in rows]))
    return out


def pack(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """cut (see pieces) with sequence_id and offset. The counts of the lengths, at most `size` numbers, reach the driver.

    The most sequences that a perfect packing could save is the plan's number less ceil(tokens / size). Pieces of equal
    length are interchangeable, so they take places in the order of a hash; equal rows may swap places. An empty table
    gives no rows.
    """
    counts = {r[0]: r[1] for r in cut.groupBy("length").agg(F.count("*")).collect()}
    where = places(plan(counts, size))
    ordered = cut.withColumn("_order", spread("doc_id", "piece", "ids_crc32"))
    ranked = gapless_rank(ordered, ["length"], "_order", max(counts.values(), default=0)).drop("_order")
    names = cut.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                rows = np.flatnonzero(length == x)
                first, base, many, offsets = where[int(x)]
                span = np.searchsorted(first, rank[rows], side="right") - 1
                inside = rank[rows] - first[span]
                sequence[rows] = base[span] + inside // many[span]
                offset[rows] = offsets[span, inside % many[span]]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema)
    return ranked.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece of each row of docs.

    Null text is empty: one piece of id 0. A row that repeats is packed as often, and its copies are ranked in one cell; a
    null key is as any. Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    return pack(materialize(pieces(docs, path, key, text, size), "pieces"), size)
