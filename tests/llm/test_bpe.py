import hashlib

import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm.conftest import DOCS

from foliograph.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)
WANT = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@given(st.one_of(st.text(max_size=60), st.text(alphabet="aeinst 'lé\n\t  12!?  \x1c日本", max_size=80)))
@settings(max_examples=400, deadline=None)
def test_texts(text):
    coder = bpe.text_encoder(PATH, P.PATTERN)
    ids = coder.encode(text)
    assert ids == WANT.encode_ordinary(text)
    assert coder.encoder.decode(ids) == text.encode()


@given(st.binary(min_size=1, max_size=40), st.binary(max_size=10), st.integers(0, 40), st.integers(0, 40))
@settings(max_examples=150, deadline=None)
def test_appends_and_edits(data, more, a, b):
    """Any byte string: the prefix tokens are merge's, an append extends them, an edit keeps those before it."""
    coder = bpe.PrefixEncoder(RANKS)
    last = coder.extend(data, [])
    assert coder.tokens(data, last) == coder.merge(data)
    longer = coder.extend(data + more, list(last))
    assert longer[: len(last)] == last and coder.tokens(data + more, longer) == coder.merge(data + more)
    start, stop = sorted((min(a, len(data)), min(b, len(data))))
    changed, after = coder.edited(data, list(last), start, stop, more)
    assert changed == data[:start] + more + data[stop:]
    assert coder.tokens(changed, after) == coder.merge(changed)


def test_caches_start_anew(monkeypatch):
    monkeypatch.setattr(bpe, "CHUNKS", 3)
    monkeypatch.setattr(bpe, "PAIRS", 3)
    coder = bpe.TextEncoder(PATH, P.PATTERN)
    text = "some words that go on and on, with more words than the cache"
    assert coder.encode(text) == WANT.encode_ordinary(text)


def test_documents(docs, no_docs):
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs, PATH, P.PATTERN).collect())
    want = []
    for i, t in DOCS:
        ids = WANT.encode_ordinary(t or "")
        want.append((str(i), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    assert bpe.round_trip(no_docs, PATH, P.PATTERN).count() == 0
    assert sorted(len(r.ids) for r in bpe.encode_texts(docs, PATH, P.PATTERN).collect()) == sorted(w[1] for w in want)
