import hashlib
import random

import numpy as np
import pytest

from skyledger.llm import bpe

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    tokenizer = tokenizers.Tokenizer.from_file(bpe.default_tokenizer())
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


def texts():
    rng = random.Random(4)
    alphabet = list("abcdeABC  \t\n'.,!?01239stmlrvd") + ["é", "ß", "中", "文", "😀", " ", " ", "\u0085", "　", "٣", "½", "ñ", "é", "‍", "\x00", "\x1c", "\x1f", "﻿", "▁"]
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    fixed = [
        "", None, " ", "\n\n \n", "  a  b ", "I'll don't we've it's 'S 'RE", "<|endoftext|>", "a<|endoftext|>b <|endoftext|><|endoftext|> ", "!<|endoftext|>!", "<|endoftext",
        "x" * 50_000, "word " * 30_000, "ab" * 40 + " " + "9" * 70, "same text", "same text",
    ]
    return [*fixed, *made]


@pytest.mark.parametrize("common", [bpe.COMMON, 40, 0])
def test_against_the_library(make, library, common):
    rows = list(enumerate(texts()))
    out = bpe.encode_documents(make([*rows, rows[3], (None, "no id"), (None, "no id")], extra=True), common=common, ids=True).collect()
    assert len(out) == len(rows) + 3
    want = dict(rows) | {None: "no id"}
    for r in out:
        encoded = library.encode(want[r.doc_id] or "", add_special_tokens=False)
        assert r.ids == encoded.ids, repr(want[r.doc_id])
        decoded = library.decode(encoded.ids, skip_special_tokens=False)
        assert r.decoded == decoded == (want[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(encoded.ids), hashlib.sha256(np.array(encoded.ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_empty(make):
    assert bpe.encode_documents(make([])).count() == 0
    assert bpe.encode_documents(make([(1, None)])).collect()[0].n_tokens == 0
