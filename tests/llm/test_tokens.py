import random

import pytest

from skyledger.llm import tokens

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("ahocorasick")


def oracle(vocabulary):
    from tokenizers import Tokenizer, models, normalizers

    pieces = [("<unk>", 0.0), *vocabulary.pieces, *((f"<0x{b:02X}>", 0.0) for b in range(256))]
    tokenizer = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    tokenizer.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    return tokenizer


def texts(seed, alphabet):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(200)]


def counted(make, rows, vocabulary):
    return {r.doc_id: r.n_tokens for r in tokens.count_tokens(make(rows, extra=True), vocabulary).collect()}


def test_against_the_library_on_the_public_vocabulary(make):
    vocabulary = tokens.default_vocabulary()
    library = oracle(vocabulary)
    rows = list(enumerate(["", None, "Hello  world\n a\tb é 😀", "the the the", " lead", "▁▁a ▁b", "naïve 中文", *texts(2, list("the inoab  \n,.é中😀▁"))]))
    got = counted(make, rows, vocabulary)
    for k, text in rows:
        assert got[k] == len(library.encode(text or "", add_special_tokens=False).ids), repr(text)


def test_ties_and_unknowns(make):
    # many paths of equal score
    vocabulary = tokens.Vocabulary([("a", -2.0), ("b", -2.0), ("ab", -4.0), ("ba", -4.0), ("aba", -6.0), ("▁", -1.0), ("▁a", -3.0), ("▁▁", -2.0), ("c", -1.0), ("cc", -3.0)], -16.0)
    library = oracle(vocabulary)
    rows = list(enumerate([*texts(5, list("aabbcc  dé")), "a" * 20000, "ab" * 9 + " " * 9]))
    got = counted(make, rows, vocabulary)
    for k, text in rows:
        assert got[k] == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_repeated_and_empty(make):
    assert tokens.count_tokens(make([])).count() == 0
    out = tokens.count_tokens(make([(1, "a b"), (1, "a b"), (None, "a b"), (2, None)])).collect()
    assert len(out) == 4 and len({r.n_tokens for r in out if r.doc_id != 2}) == 1
    assert [(r.n_tokens, r.score) for r in out if r.doc_id == 2] == [(0, 0.0)]


def test_long_text(make):
    text = "words of a long text " * 40_000
    one, many = (tokens.count_tokens(make([(1, t)])).collect()[0].n_tokens for t in ("words of a long text ", text))
    assert abs(many - one * 40_000) <= 40_000
