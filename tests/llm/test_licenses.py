import random
import re

from pyspark.sql import functions as F

from marginalia.llm import licenses


def brute(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    at, base, met, best = [], set(), set(), 0.0
    for phrase, label in licenses.PHRASES.items():
        parts = phrase.split()
        found = [i for i in range(len(words) - len(parts) + 1) if words[i:i + len(parts)] == parts]
        at += found
        base |= {label} if found else set()
    for line in text.split("\n"):
        own = set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", line))
        for label, template in licenses.TEMPLATES:
            other = set(re.findall("[a-z0-9]+", template.lower()))
            if 100 * len(own & other) >= licenses.THRESHOLD * len(other):
                met.add(label)
                best = max(best, len(own & other) / len(other))
    return (len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | met)),
            1.0 if at else best)


def texts():
    rng = random.Random(6)
    for label, template in licenses.TEMPLATES * 12:
        words = template.split()
        for _ in range(rng.randint(0, max(1, len(words) // 3))):
            words[rng.randrange(len(words))] = rng.choice(["é", "license", "MIT", "CC-BY", "the", "mit", "x"])
        yield rng.choice(["", "Some text\n", "other "]) + " ".join(words).replace(" the ", rng.choice([" the ", " THE, ", "\n"]))
    yield from ["MIT License; mit-license MIT\nLICENSE", "émit license", "permit license", "cc by" * 3, "CC BY", "cc by cc by",
                "worK mİt license", "license", None, "", "GNU general, public license"]


def test_against_brute_force(make_docs):
    rows = list(enumerate(texts()))
    got = licenses.scan(make_docs(rows)).collect()
    assert sorted(map(str, ((r.doc_id, *r[1:]) for r in got))) == sorted(str((i, *brute(t))) for i, t in rows)


def test_edges(edge_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    got = licenses.scan(edge_docs).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, *brute(t))) for i, t in rows)
    assert licenses.scan(no_docs).collect() == []


def test_no_python_in_the_plan(edge_docs):
    plan = licenses.scan(edge_docs.select("doc_id", F.upper("text").alias("text")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
