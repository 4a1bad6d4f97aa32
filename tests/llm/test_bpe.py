import hashlib
import random
import struct

import numpy as np
import pytest
from tokenizers import Tokenizer

from eventskim.llm.bpe import Encoder, decode, encode, load, op2_bpe
from eventskim.llm.queries import vocabulary


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary())


def ids(encoder, text):
    return np.frombuffer(encoder.encode(text), "<u4").tolist()


@pytest.mark.parametrize("seed", range(4))
def test_like_the_library(library, seed):
    rng, bpe = random.Random(seed), load(vocabulary())
    encoder = Encoder(bpe)
    marks = [*"ab  \n\t'stedre1 2.,!?é一́ \x1c\x85", "<|endoftext|>", "'ll", "\U0001f600", " ", "aaaa", "    ", "0000"]

    def sign():
        if rng.random() < 0.8:
            return rng.choice(marks)
        return chr(rng.choice([rng.randrange(0x20, 0x3000), rng.randrange(0x10000, 0x20000)]))

    for _ in range(2500):
        text = "".join(sign() for _ in range(rng.randrange(40)))
        found = library.encode(text, add_special_tokens=False).ids
        assert ids(encoder, text) == found
        assert bpe.decode(struct.pack(f"<{len(found)}I", *found)) == library.decode(found, skip_special_tokens=False) == text
        drawn = [rng.randrange(50257) for _ in range(6)]
        assert bpe.decode(struct.pack("<6I", *drawn)) == library.decode(drawn, skip_special_tokens=False)


def test_every_letter_is_cut_alike(library):
    encoder = Encoder(load(vocabulary()))
    for c in [*range(1, 0xD800, 3), *range(0xE000, 0x110000, 97), 0x558, 0x88F, 0x323B0]:
        text = f"a{chr(c)}a 1{chr(c)} .{chr(c)}  {chr(c)}"
        assert ids(encoder, text) == library.encode(text, add_special_tokens=False).ids, hex(c)


def test_whole_table(small, library):
    out = {r.doc_id: r for r in op2_bpe(small("documents"), vocabulary()).collect()}
    rows = small("documents").select("doc_id", "text").collect()
    assert len(out) == len(rows)
    for row, found in zip(rows, library.encode_batch([r.text for r in rows], add_special_tokens=False), strict=True):
        r = out[row.doc_id]
        assert r.n_tokens == len(found.ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(found.ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(row.text.encode()).hexdigest()


def test_odd_rows(odd_docs, odd_rows, no_docs):
    out = decode(encode(odd_docs, vocabulary()), vocabulary())
    assert sorted(out.columns) == sorted([*odd_docs.columns, "decoded"])
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.decoded) for r in out.collect()), key=key) == sorted(((r[0], r[1] or "") for r in odd_rows), key=key)
    assert {r.n_tokens for r in op2_bpe(odd_docs, vocabulary()).filter("doc_id in (300, 301)").collect()} == {0}
    assert op2_bpe(no_docs, vocabulary()).collect() == []
