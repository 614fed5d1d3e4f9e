import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from marginalia.llm import packing


@pytest.mark.parametrize("seed", range(5))
def test_patterns(seed):
    rng = random.Random(seed)
    histogram = {rng.randint(1, 2048): rng.choice([1, 3, rng.randint(1, 10 ** 9)]) for _ in range(rng.choice([1, 5, 900]))}
    patterns = packing.pack_patterns(histogram)
    found = Counter()
    for pattern, count in patterns:
        assert sum(size * times for size, times in pattern) <= 2048 and count > 0
        for size, times in pattern:
            found[size] += times * count
    assert found == histogram
    used, total = sum(c for _, c in patterns), sum(s * n for s, n in histogram.items())
    if len(histogram) == 900:
        assert total / 2048 / used > 0.98
    assert packing.pack_patterns({}) == []


def check(spark_rows, docs, ids):
    """Every id lies in one piece, pieces fill their sequences without gaps, checksums are those of the ids."""
    sequences, by_doc = defaultdict(list), defaultdict(list)
    for r in spark_rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for own in sequences.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 2048
    want = defaultdict(list)
    for doc_id, text in docs:
        own = [*ids(text), 1]
        for i in range(0, len(own), 2048):
            piece = own[i:i + 2048]
            want[doc_id].append((i, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes()), len(own)))
    assert {k: sorted(v) for k, v in by_doc.items()} == {k: sorted(v) for k, v in want.items()}


@pytest.fixture(scope="module")
def ids():
    encode = packing.encoder(packing.vocabulary_path("byte_bpe_50k.json"))
    return lambda text: encode(text or "")


def test_edges(edge_docs, no_docs, ids):
    check(packing.pack(edge_docs).collect(), [(r.doc_id, r.text) for r in edge_docs.collect()], ids)
    assert packing.pack(no_docs).collect() == []


def test_documents(spark, sf, ids):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    check(packing.pack(docs).collect(), [tuple(r) for r in docs.collect()], ids)


def test_fast_reader_gives_equal_ids(ids):
    fast = packing.encoder(packing.vocabulary_path("byte_bpe_50k.json"), packing.vocabulary_path("byte_bpe_50k.tiktoken"))
    rng = random.Random(4)
    letters = "aZé 中\n\t'sll  \U0001F600́\x000<|endoftext|>"
    for text in ["", "<|endoftext|>", *("".join(rng.choice([*letters, "<|endoftext|>"]) for _ in range(40)) for _ in range(300))]:
        assert list(fast(text)) == list(ids(text))
