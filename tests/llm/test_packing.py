import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm.conftest import DOCS
from tokenizers import Tokenizer

from foliograph.llm import packing

PATH = P.path("word_bpe_49k.json")


@given(st.dictionaries(st.integers(1, 32), st.integers(1, 50), max_size=12))
@settings(max_examples=150, deadline=None)
def test_plan(counts):
    planned = packing.plan(counts, 32)
    used = Counter()
    for lengths, many in planned:
        assert sum(lengths) <= 32 and many > 0
        for x in lengths:
            used[x] += many
    assert used == counts
    waste = [32 - sum(lengths) for lengths, many in planned for _ in range(many)]
    assert sum(w >= 16 for w in waste) <= 1  # two half-empty sequences would have been one


@pytest.mark.parametrize(("counts", "sequences"), [({16: 3}, 2), ({20: 5, 12: 5}, 5), ({20: 4, 7: 4, 5: 4}, 4), ({14: 2, 9: 2, 6: 2, 3: 2}, 2), ({32: 7}, 7), ({}, 0)])
def test_exact_complements(counts, sequences):
    assert sum(m for _, m in packing.plan(counts, 32)) == sequences


def test_many_lengths_fill_well():
    rng = random.Random(5)
    counts = Counter(min(2048, int(rng.lognormvariate(6.3, 1)) + 1) for _ in range(20000))
    planned = packing.plan(dict(counts))
    least = -(-sum(k * v for k, v in counts.items()) // 2048)
    assert sum(m for _, m in planned) <= least * 1.002 + 1


def test_documents(docs, no_docs):
    tokenizer = Tokenizer.from_file(PATH)
    rows = packing.pack_documents(docs, PATH).collect()
    want = Counter()
    for i, t in DOCS:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for n, s in enumerate(range(0, len(ids), 2048)):
            want[(str(i), n, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes()))] += 1
    assert Counter((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(no_docs, PATH).count() == 0


@given(st.text(max_size=50))
@settings(max_examples=150, deadline=None)
def test_words(text):
    want = np.array(TOKENIZER.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert packing.word_ids(PATH).encode([text]) == [want]


TOKENIZER = Tokenizer.from_file(PATH)


def test_one_length_holds_all(spark):
    cut = spark.range(9000).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "700L AS length", "id AS ids_crc32")
    rows = packing.pack(cut).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == 9000 and len({r.sequence_id for r in rows}) == 4500


def test_letters_go_to_the_model():
    """Unknown letters of ASCII are encoded by the model alone, to the same ids."""
    rng, coder = random.Random(3), packing.WordIds(PATH)
    words = ["".join(rng.choices("abcdefghijklmnoprstuwyABC", k=rng.randint(1, 30))) + rng.choice(["", ".", ",)", "é"]) for _ in range(3000)]
    sent = []
    real, coder._encoded = coder._encoded, lambda words: (sent.extend(words), real(words))[1]
    want = [np.array(TOKENIZER.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words]
    assert coder.encode(words) == want
    assert not any(w.isascii() and w.isalpha() for w in sent)
