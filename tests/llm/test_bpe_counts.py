import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from marginalia.llm import bpe_counts


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(public_tokenizers.path(bpe_counts.VOCABULARY))


@pytest.fixture(scope="module")
def counter():
    return bpe_counts.Counter(public_tokenizers.path(bpe_counts.VOCABULARY), public_tokenizers.PATTERN)


def test_every_character_between_others(whole, counter):
    for form in ("a{0}b {0}1 {0}{0}  {0}", "x {0} {0}y{0} {0} {0}"):
        for low in range(0, 0x110000, 1024):
            texts = [form.format(chr(c)) for c in range(low, low + 1024, 5) if not 0xD800 <= c < 0xE000]
            for text, told in zip(texts, whole.encode_batch(texts, add_special_tokens=False)):
                assert counter.tokens(text) == len(told.ids), text


def test_random_texts(whole, counter):
    rng, letters = random.Random(4), " \n\t'sdreé漢1a\U0001F600 \u0085\x1c\r.,<|endoftext|>  "
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(5_000)]
    texts += ["".join(rng.choice("abcdefgh") for _ in range(200)) for _ in range(200)]
    texts += ["x <|endoftext|>" * 3 + "<|endoftext", "<|endoftext|>", " " * 3_000 + "x", "a" * 3_000, "ab" * 3_000, "é" * 999]
    for text, told in zip(texts, whole.encode_batch(texts, add_special_tokens=False)):
        assert counter.tokens(text) == len(told.ids), text


def plain_count(raw, merges):
    """The lowest rank anywhere, the leftmost of it, one merge at a time."""
    symbols = [merges.first[b] for b in raw]
    while True:
        found = [(merges.ranks[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in merges.ranks]
        if not found:
            return len(symbols)
        rank, i = min(found)
        symbols[i:i + 2] = [merges.made[rank]]


def test_small_vocabulary_against_plain_merging():
    letters = bpe_counts.byte_letters()
    vocab = {c: i for i, c in enumerate(letters)}
    merges = ["b a", "a a", "a b", "aa a", "ba aa", "aaa aaa", "ab ab"]
    for m in merges:
        vocab[m.replace(" ", "")] = len(vocab)
    table = bpe_counts.merges_of({"vocab": vocab, "merges": merges})
    rng = random.Random(2)
    for _ in range(3_000):
        raw = "".join(rng.choice("ab") for _ in range(rng.randint(0, 30))).encode()
        assert bpe_counts.count_merged(raw, table) == plain_count(raw, table)


def test_tables_stay_bounded(whole, monkeypatch):
    monkeypatch.setattr(bpe_counts, "KEPT", 10)
    counter = bpe_counts.Counter(public_tokenizers.path(bpe_counts.VOCABULARY), public_tokenizers.PATTERN)
    text = " ".join(f"word{i % 37}" for i in range(400))
    assert counter.tokens(text) == len(whole.encode(text, add_special_tokens=False).ids)
    assert max(len(counter._of_word), len(counter._of_piece)) <= 10


def test_streamed_pieces(whole, counter, monkeypatch):
    monkeypatch.setattr(bpe_counts, "STREAMED", 10)
    text = "many words, and 12 more\n\n of them"
    assert counter.tokens(text) == len(whole.encode(text, add_special_tokens=False).ids)


def test_edges(edge_docs, no_docs, whole):
    want = sorted(str((r.doc_id, len((r.text or "").encode()), len(whole.encode(r.text or "", add_special_tokens=False).ids)))
                  for r in edge_docs.collect())
    got = bpe_counts.token_counts(edge_docs).collect()
    assert sorted(str((r.doc_id, r.n_bytes, r.n_tokens)) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got) and any(r.over_limit for r in got)
    assert bpe_counts.token_counts(no_docs).collect() == []
    assert bpe_counts.token_counts(edge_docs).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
