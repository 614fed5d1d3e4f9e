import random
import re
from collections import Counter

from marginalia.llm.repetition import GRAM_LIMITS, measure, repetition_rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = Counter()
    dup = dup_chars = 0
    for line in text.split("\n"):
        own = re.findall(r"[^\x20\x09-\x0D]+", line)
        if own:
            if lines[line]:
                dup, dup_chars = dup + 1, dup_chars + sum(map(len, own))
            lines[line] += 1
    chars, marks, again = sum(map(len, words)), {}, {}
    for n in GRAM_LIMITS:
        grams = [tuple(words[i:i + n]) for i in range(len(words) - n + 1)]
        found = Counter(grams)
        marks[n] = {i + j for i, g in enumerate(grams) if found[g] > 1 for j in range(n)}
        first = {}
        for i, g in enumerate(grams):
            first.setdefault(g, i)
        again[n] = {i + j for i, g in enumerate(grams) if first[g] < i for j in range(n)}
    shares = [sum(len(words[i]) for i in m) / chars if chars else 0.0 for m in again.values()]
    failed = len(words) < 20 or 100 * len(marks[8]) > 30 * len(words)
    kept = not failed and (dup_chars / chars if chars else 0) <= .2 and all(s <= m for s, m in zip(shares, GRAM_LIMITS.values()))
    return (len(words), chars, len(re.findall(r"[#*$%&|<>]", text)), dup, len(marks[8]), dup_chars / chars if chars else 0.0,
            *shares, failed, kept)


def test_against_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        some = [rng.choice(["a", "bé", "c#", "\U0001F600x", "d"]) for _ in range(rng.randint(0, 60))]
        text = "".join(w + rng.choice([" ", "\n", "\t", "  ", "\x0b", "\n\n"]) for w in some)
        assert measure(text) == brute(text)


def test_edges(edge_docs, no_docs):
    rows = repetition_rules(edge_docs).collect()
    assert len(rows) == edge_docs.count() and repetition_rules(no_docs).collect() == []
    texts = {(r.doc_id, r.text) for r in edge_docs.collect()}
    assert sorted(tuple(r) for r in rows if r.doc_id and r.doc_id != 10) == sorted(
        (i, *brute(t)) for i, t in [*texts, next(x for x in texts if x[0] == 5)] if i and i != 10)
