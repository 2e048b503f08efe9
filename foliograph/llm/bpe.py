"""Byte-level BPE by prefix dynamic programming.

Of all tokens that could end a byte prefix, exactly one ends the prefix's BPE encoding: the token t such that t and the
last token of the prefix before it stay two tokens when encoded together. Storing that token for each prefix gives the
encoding by walking back, lets bytes be appended at the cost of the new prefixes only, and lets an edit re-encode only
from the edit on. Whether two tokens stay two is decided once by merging their bytes, and remembered.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries that the caches of chunks and of token pairs hold before they start anew, and characters of a chunk that is held.
CHUNKS, PAIRS, LONG = 500_000, 1_000_000, 64


class PrefixEncoder:
    """Tokens of byte strings under BPE ranks."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.size = {v: len(k) for k, v in ranks.items()}
        self.ending = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.ending.add_word(token.decode("latin-1"), rank)
        self.ending.make_automaton()
        self._stay: dict[int, bool] = {}

    def merge(self, data: bytes) -> list[int]:
        """BPE by definition: merge the adjacent pair of lowest rank, the leftmost of equals, until none is left."""
        parts, ranks = [data[i : i + 1] for i in range(len(data))], self.ranks
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def stay(self, a: int, b: int) -> bool:
        """Whether the two tokens are their own encoding; a of -1: whether b alone is."""
        key = (a << 32) | b if a >= 0 else -1 - b
        known = self._stay.get(key)
        if known is None:
            if len(self._stay) >= PAIRS:
                self._stay.clear()
            joined = (self.bytes_of[a] if a >= 0 else b"") + self.bytes_of[b]
            known = self._stay[key] = self.merge(joined) == ([a, b] if a >= 0 else [b])
        return known

    def extend(self, data: bytes, last: list[int]) -> list[int]:
        """last[i] is the last token of data[: i + 1]; adds those that are missing, in place.

        The automaton gives the tokens that end at each byte, longest first; the first that fits is the only one.
        """
        size, stay, known, done = self.size, self.stay, self._stay, len(last)
        for end, token in self.ending.iter(data.decode("latin-1"), max(0, done - self.longest)):
            if end < done:
                continue
            start = end + 1 - size[token]
            if start < 0:
                continue
            before = last[start - 1] if start else -1
            ok = known.get((before << 32) | token if start else -1 - token)
            if ok is None:
                ok = stay(before, token)
            if ok:
                last.append(token)
                done += 1
        if done < len(data):
            raise ValueError("the vocabulary lacks a single byte")
        return last

    def tokens(self, data: bytes, last: list[int]) -> list[int]:
        out, at = [], len(data)
        while at:
            out.append(last[at - 1])
            at -= self.size[out[-1]]
        return out[::-1]

    def encode(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:  # tiktoken takes a piece that is a token as it is, even if merges don't reach it
            return [whole]
        return self.tokens(data, self.extend(data, []))

    def edited(self, data: bytes, last: list[int], start: int, stop: int, new: bytes) -> tuple[bytes, list[int]]:
        """data with data[start:stop] replaced by new, and its last tokens: prefixes before the edit are kept."""
        changed = data[:start] + new + data[stop:]
        return changed, self.extend(changed, last[:start])

    def decode(self, tokens: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, tokens))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@lru_cache(maxsize=2)
def _encoder(path: str) -> PrefixEncoder:
    return PrefixEncoder(read_ranks(path))


class TextEncoder:
    """Tokens of texts: each match of the pattern is encoded by itself.

    A space between two characters that aren't white space always starts a match, so a text may be cut before such
    spaces, and the tokens of each cut are remembered.
    """

    def __init__(self, path: str, pattern: str) -> None:
        self.encoder, self.pattern = _encoder(path), regex.compile(pattern)
        self.cuts = regex.compile(r"(?<=\S)(?= \S)")
        self.odd = regex.compile(r"\s\s|^\s|\s$|[\x1c-\x1f]")
        self.seen: dict[str, tuple[int, ...]] = {}
        self.pieces: dict[str, list[int]] = {}

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        out: list[int] = []
        for piece in self.pattern.findall(chunk):
            known = self.pieces.get(piece)
            if known is None:
                known = self.encoder.encode(piece.encode("utf-8"))
                if len(piece) <= LONG:
                    if len(self.pieces) >= CHUNKS:
                        self.pieces.clear()
                    self.pieces[piece] = known
            out += known
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        if self.odd.search(text):
            chunks = self.cuts.split(text)
        else:  # only single white space inside: cut before each space
            first, *rest = text.split(" ")
            chunks = [first, *[" " + x for x in rest]]
        seen, out = self.seen, []
        for chunk in chunks:
            known = seen.get(chunk)
            if known is None:
                known = self._chunk(chunk)
                if len(chunk) <= LONG:
                    if len(seen) >= CHUNKS:
                        seen.clear()
                    seen[chunk] = known
            out += known
        return out


@lru_cache(maxsize=2)
def text_encoder(path: str, pattern: str) -> TextEncoder:
    return TextEncoder(path, pattern)


def encode_texts(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's tokens: doc_id, ids (array of int). A null text is empty; an empty one has no tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = text_encoder(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ids = [coder.encode(x.as_py() or "") for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the decoded bytes) for each row.

    The digests are taken where the ids are made, so ids don't leave the task. Null text is empty; its digests are those
    of no bytes. Repeated rows, null keys and other columns are as any; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = text_encoder(path, pattern)
        for batch in batches:
            rows = []
            for x in batch.column(1):
                ids = coder.encode(x.as_py() or "")
                rows.append((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(coder.encoder.decode(ids)).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.string()), strict=True)]], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
