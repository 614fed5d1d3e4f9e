import random

from marginalia.llm import toxicity

LABELS = "doc_id long, toxic int, quality int"


def texts(rng, bad):
    clean = ["river", "stone", "garden", "window", "morning", "letter", "bridge", "harbour", "singing", "walked"]
    words = [rng.choice(clean) for _ in range(rng.randint(5, 300))]
    if bad:
        for _ in range(rng.randint(1, 3)):
            words.insert(rng.randrange(len(words)), rng.choice(["grumblewort", "snarkling", "vilefinger"]))
    return " ".join(words)


def test_misspellings_share_vectors():
    rng = random.Random(1)
    labels = [int(i % 5 == 0) for i in range(600)]
    model = toxicity.fit([texts(rng, y) for y in labels], labels)
    clean = texts(random.Random(9), 0)
    assert toxicity.score(model, clean) < 0.5
    for word in ("grumblewort", "grumblewurt", "SNARKLINGS", "vilefingr"):
        assert toxicity.score(model, f"{clean} {word}, {clean}") > 0.5
    for text in (None, "", "123 ..."):
        assert 0 <= toxicity.score(model, text) < 0.5


def test_held_out(spark, make_docs):
    rng = random.Random(3)
    toxic = [int(rng.random() < 0.2) for _ in range(800)]
    docs = make_docs([(i, texts(rng, y)) for i, y in enumerate(toxic)])
    labels = spark.createDataFrame([(i, y, 0) for i, y in enumerate(toxic)] + [(3, None, 0), (None, 1, 0), (10 ** 6, 1, 0)], LABELS)
    rows = toxicity.toxicity(docs, labels).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 800 and 100 < len(held) < 230
    assert sum(r.predicted == toxic[r.doc_id] for r in held) / len(held) > 0.97
    wrong = spark.createDataFrame([(r.doc_id, 1 - toxic[r.doc_id] if r.held_out else toxic[r.doc_id], 0) for r in rows], LABELS)
    assert sorted(map(str, toxicity.toxicity(docs, wrong).collect())) == sorted(map(str, rows))


def test_edges(spark, edge_docs, no_docs):
    none, one = spark.createDataFrame([], LABELS), spark.createDataFrame([(i, 0, 1) for i in range(12)] * 2, LABELS)
    both = spark.createDataFrame([(i, int(i == 9), 1) for i in range(12)] * 2, LABELS)
    for labels in (none, one, both):
        rows = toxicity.toxicity(edge_docs, labels).collect()
        assert len(rows) == edge_docs.count() and all(0 <= r.score <= 1 for r in rows)
        assert toxicity.toxicity(no_docs, labels).collect() == []
        assert toxicity.keep_clean(edge_docs, labels).columns == edge_docs.columns
    assert {r.score for r in toxicity.toxicity(edge_docs, none).collect()} == {0.0}
