import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from marginalia.llm import alignment
from marginalia.llm.alignment import align
from marginalia.llm.bpe_counts import byte_letters


def brute_groups(a, b):
    met = sorted(set(a) & set(b))
    return [(sum(x <= m for x in a), sum(x <= m for x in b)) for m in met]


def groups(steps):
    return [g for i, k, j, m, single in steps for g in (zip(range(i + 1, k + 1), range(j + 1, m + 1)) if single else [(k, m)])]


def test_groups_against_common_ends():
    rng = random.Random(1)
    for _ in range(2_000):
        n = rng.randint(1, 120)
        share, other = rng.random(), rng.random()
        a = [i for i in range(1, n) if rng.random() < share] + [n]
        b = [i for i in range(1, n) if rng.random() < other] + [n] if rng.random() < 0.5 else \
            [i for i in a[:-1] if rng.random() < 0.95] + [n]
        assert groups(align(a, b)) == brute_groups(a, b)


def test_runs_are_jumped():
    a = list(range(1, 2_001))
    assert align(a, a) == [(0, 2_000, 0, 2_000, True)]
    b = [e for e in a if e != 1_000]  # one irregular group, and a shift of -1 after it
    assert align(a, b) == [(0, 999, 0, 999, True), (999, 1_001, 999, 1_000, False), (1_001, 2_000, 1_000, 1_999, True)]


@pytest.fixture(scope="module")
def tokenizers():
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    return whole, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def brute(rows, tokenizers):
    """By the libraries' own tokens, all pairs of occurrences that end together."""
    whole, pieces = tokenizers
    letters = {c: b for b, c in enumerate(byte_letters())}
    told = []
    for doc_id, text in rows:
        a = whole.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pieces.encode(text) if text else []
        x = [bytes(letters[c] for c in whole.id_to_token(i)) for i in a]
        y = [bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode()
             for i in b]
        if not text or b"".join(x) != (" " + text).encode() or b"".join(y) != (" " + text).encode():
            told.append((doc_id, [], [], [], ""))
            continue
        ends = lambda parts: [sum(map(len, parts[:k + 1])) for k in range(len(parts))]
        p, q = ends(x), ends(y)
        at = {e: k for k, e in enumerate(q)}
        links = [(a[k], b[at[e]]) for k, e in enumerate(p) if e in at]
        groups, i, j = [], 0, 0
        for k, m in ((k + 1, at[e] + 1) for k, e in enumerate(p) if e in at):
            groups.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])))
            i, j = k, m
        told.append((doc_id, a, b, links, ";".join(groups)))
    count = Counter(link for t in told for link in t[3])
    best = {}
    for (a, b), n in count.items():
        best[b] = max(n, best.get(b, 0))
    return sorted(str((d, len(a), len(b), len(links), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links),
                       hashlib.sha256(g.encode()).hexdigest() if links else "")) for d, a, b, links, g in told)


def as_rows(df):
    return sorted(str((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)) for r in df.collect())


TEXTS = ["Hello world, it is 2024!", "Hello world", "hello  world \n\n it\tis", "<|endoftext|> and <s> are plain", "▁ breaks the bytes",
         "漢字 and \U0001F600 éè", "don't can't won't", "a", " ", "\n", " leading", "trailing  ", "tokenization tokenizers", "x\x00y"]


def test_against_brute_force(make_docs, tokenizers):
    rng = random.Random(3)
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    rows += [(100 + i, " ".join(rng.choice(" ".join(TEXTS).split()) for _ in range(rng.randint(1, 60)))) for i in range(150)]
    rows += [(100, "an id once more"), (100, "an id once more"), (None, "no id"), (500, None), (501, "")]
    want = brute(rows, tokenizers)
    assert as_rows(alignment.alignment(make_docs(rows))) == want
    assert as_rows(alignment.alignment(make_docs(rows).repartition(7), most_docs=3)) == want
    assert as_rows(alignment.alignment(make_docs(rows), most_links=20)) == want


def test_edges(edge_docs, no_docs, tokenizers):
    rows = [(r.doc_id, r.text) for r in edge_docs.where("n_chars is null and (doc_id is null or doc_id <> 5)").collect()]
    got = as_rows(alignment.alignment(edge_docs.where("doc_id is null or doc_id <> 5")))
    assert got == brute(rows, tokenizers)
    long_ones = alignment.alignment(edge_docs.where("doc_id = 5")).collect()
    assert len(long_ones) == 2 and long_ones[0] == long_ones[1] and long_ones[0].n_links > 30_000
    assert alignment.alignment(no_docs).collect() == []
