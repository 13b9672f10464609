import base64
import hashlib

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings, strategies as st

from tabsight.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
ORACLE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
PARTS = ["'", "s", "t", "re", "ve", "m", "ll", "d", " ", "\n", "\t", "a", "B", "é", "9", "٣", "!", "😀", "　", "_", "\x1c", "ſ", "́", "中", "\r\n", "'re"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=25).map("".join), min_size=1, max_size=30))
def test_equals_the_library(texts):
    got = bpe.coder(PATH).encode([t.encode() for t in texts])
    for text, (ids, offsets) in zip(texts, got):
        want = ORACLE.encode_ordinary(text)
        assert np.frombuffer(ids, "<u4").tolist() == want
        sizes = [len(ORACLE.decode_single_token_bytes(i)) for i in want]
        assert np.frombuffer(offsets, "<u4").tolist() == np.cumsum([0, *sizes])[:-1].tolist()
        assert bpe.coder(PATH).decode(ids) == text.encode()


def test_long_pieces_merge_alike():
    for text in ("ab" * 500, "the" * 100, "=" * 333, "aaaa" * 200 + "b"):
        assert bpe.merge(text.encode(), RANKS) == ORACLE.encode_ordinary(text)


def test_documents(awkward, empty):
    rows = bpe.encode(awkward, PATH, decoded=True).collect()
    want = sorted(((r.doc_id, np.asarray(ORACLE.encode_ordinary(r.text or ""), "<u4").tobytes(), (r.text or "").encode()) for r in awkward.collect()), key=repr)
    assert sorted(((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in rows), key=repr) == want
    assert bpe.encode(empty, PATH).count() == 0


def test_part_of_the_ids_decodes_to_its_place(awkward):
    texts = {hashlib.sha1((r.text or "").encode()).digest(): (r.text or "").encode() for r in awkward.collect()}
    for r in bpe.decode(bpe.encode(awkward, PATH), PATH, 1, 4).collect():
        if r.start is not None:
            assert any(t[r.start : r.start + len(r.decoded)] == bytes(r.decoded) for t in texts.values())
        else:
            assert r.decoded == b""
