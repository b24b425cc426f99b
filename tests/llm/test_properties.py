"""Properties over generated inputs."""

import base64
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

P = pytest.importorskip("public_tokenizers")

from ctxlens.llm import bpe, hashing, near_dedup, record_output, secret_scan, warc  # noqa: E402

TEXT = st.text(alphabet=st.characters(exclude_categories=("Cs",)), max_size=200)
FEW = settings(max_examples=150, deadline=None)


@pytest.fixture(scope="module")
def coders():
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    return enc, bpe.ranks_encoder(path, P.PATTERN), bpe.ranks_decoder(path, P.PATTERN)


@FEW
@given(text=st.one_of(TEXT, st.text(alphabet="aab -=\n\t'sé1²", max_size=120)))
def test_bpe_equals_ranks_and_decodes(coders, text):
    enc, mine, back = coders
    ids = next(mine.encode([text]))
    assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(text)
    assert back.decode(ids) == text.encode()


@FEW
@given(payloads=st.lists(st.binary(max_size=300), max_size=8))
def test_frames_round_trip(payloads):
    import io

    assert record_output.unframe(io.BytesIO(b"".join(record_output.frames(payloads))), len(payloads)) == payloads


@FEW
@given(payload=st.binary(max_size=5000), size=st.integers(1, 700))
def test_chunked_framing_round_trips(payload, size):
    assert warc.dechunk(warc.chunked(payload, size)) == payload


@FEW
@given(texts=st.lists(TEXT, max_size=6))
def test_words_are_those_of_the_pattern(texts):
    b = hashing.Batch([t.encode() for t in texts])
    found = [bytes(b.buf[s:e]).decode() for s, e in zip(b.starts, b.ends, strict=True)]
    assert found == [w for t in texts for w in re.findall(r"[^\x20\x09-\x0D]+", t)]
    assert np.diff(b.first).tolist() == [len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in texts]


@FEW
@given(a=st.sets(st.integers(0, 60)), b=st.sets(st.integers(0, 60)), percent=st.integers(1, 100))
def test_links_follow_the_definition(a, b, percent):
    x, y = (np.array(sorted(s), "u8") for s in (a, b))
    assert near_dedup.overlap(x, y) == len(a & b)
    if a and b:
        assert near_dedup.linked(x, y, percent) == (100 * len(a & b) >= percent * len(a | b))


@FEW
@given(before=TEXT, after=TEXT, times=st.integers(1, 4))
def test_wrapped_secrets_are_redacted_in_place(before, after, times):
    packed = 'api_key = "Zq3Zq3Zq3Zq3"'
    for _ in range(times):
        packed = base64.b64encode(packed.encode()).decode()
    text = f"{before} {packed} {after}"
    _, more, _ = secret_scan.find(text)
    assert any(a <= len(before) + 1 and b >= len(before) + 1 + len(packed.rstrip("=")) for _, a, b in more)
    assert packed.rstrip("=") not in secret_scan.redact(text)


@FEW
@given(text=TEXT)
def test_any_text_scans_to_an_end(text):
    base, more, layers = secret_scan.find(text)
    assert layers >= 1 and all(0 <= a < b <= len(text) for _, a, b in base + more)
