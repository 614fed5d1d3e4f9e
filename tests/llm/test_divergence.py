import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marginalia.llm import divergence


def brute(rows, least):
    """All rates of all groups, dense."""
    found, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        own = re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        found[lang or "", source or ""].update(own)
        docs[lang or ""].update(set(own))
    out = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = sorted(s for ln, s in found if ln == lang)
        total = Counter()
        for s in sources:
            total.update({t: found[lang, s][t] for t in kept})

        def rates(count):
            n = sum(count[t] for t in kept)
            return {t: 1 + 10 ** 9 * (count[t] + 5) // (n + 5 * len(kept)) for t in kept}
        q, p = rates(total), {s: rates(found[lang, s]) for s in sources}
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            above = [(q[t] - p[s][t], t.encode()) for t in kept if found[lang, s][t] and p[s][t] > q[t]]
            for part, listed, most in (("pair", pairs, None), ("term", above, 50)):
                out += [(lang, s, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(sorted(listed)[:most])]
    return sorted(out)


def as_rows(df):
    return sorted(map(tuple, df.collect()))


def random_rows(rng, n, sources):
    words = [f"{a}{b}" for a in ("al", "Be", "ça", "de", "Ée", "foß") for b in ("ta", "RO", "mi", "nñ", "\U0001F600")]
    out = []
    for _ in range(n):
        text = "".join(rng.choice(words[:rng.randint(2, len(words))]) + rng.choice((" ", "\n", "1", "-", " ", "\x85", "\x00")) for _ in range(rng.randint(0, 30)))
        out.append((text, rng.choice(("en", "de", None, "")), rng.choice(sources)))
    return out


@pytest.mark.parametrize("blocks", [(2_048, 256), (3, 2), (1, 1)])
def test_against_brute_force(make_docs, monkeypatch, blocks):
    monkeypatch.setattr(divergence, "BLOCK_TERMS", blocks[0])
    monkeypatch.setattr(divergence, "BLOCK_SOURCES", blocks[1])
    monkeypatch.setattr(divergence, "LEAST_DOCS", 5)
    rng = random.Random(sum(blocks))
    rows = random_rows(rng, 300, ["a", "b", "C", "é", None, "", "zz"]) + [("", "en", "empty"), (None, "xx", "y"), ("one", "xx", "z"), ("only", "fr", None)]
    docs = make_docs([(i, *r) for i, r in enumerate(rows)])
    assert as_rows(divergence.audit(docs)) == brute(rows, 5)


def broadcast_rows(plan):
    """Rows of each table that an ended plan has broadcast."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        return broadcast_rows(plan.executedPlan())
    if name.endswith("QueryStage"):
        return broadcast_rows(plan.plan())
    below = [plan.child()] if name == "ReusedExchange" else [plan.children().apply(i) for i in range(plan.children().size())]
    own = [plan.metrics().apply("numOutputRows").value()] if name == "BroadcastExchange" else []
    return own + [n for p in below for n in broadcast_rows(p)]


def many_terms(make_docs, monkeypatch):
    """A few groups of many terms, which Spark would broadcast by the size of their file."""
    monkeypatch.setattr(divergence, "LEAST_DOCS", 2)
    words = [f"{a}{b}{c}" for a in "abcdefghij" for b in "klmnopqrst" for c in "uvwxyz"]
    rows = [(" ".join(words[i:]), lang, source) for i in range(3) for lang in ("en", "de") for source in ("a", "b", None)]
    return rows, make_docs([(i, *r) for i, r in enumerate(rows)])


@pytest.mark.parametrize("held, most", [(divergence.BROADCAST_GROUPS, 6), (0, 0)])
def test_only_groups_are_broadcast(make_docs, monkeypatch, held, most):
    rows, docs = many_terms(make_docs, monkeypatch)
    monkeypatch.setattr(divergence, "BROADCAST_GROUPS", held)
    out = divergence.audit(docs)
    assert as_rows(out) == brute(rows, 2)
    assert max(broadcast_rows(out._jdf.queryExecution().executedPlan()), default=0) == most


def test_kept_terms_are_not_broadcast(spark, make_docs, monkeypatch, tmp_path):
    rows, docs = many_terms(make_docs, monkeypatch)
    divergence.counts(docs).write.parquet(str(tmp_path / "told"))
    told = spark.read.parquet(str(tmp_path / "told"))
    named, seen = told.where("term <> ''"), []
    common = named.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"))
    sparse = divergence._kept(named, common)
    for df in (sparse, divergence._groups(told, common, sparse)):
        seen.append(len(df.collect()))
        assert broadcast_rows(df._jdf.queryExecution().executedPlan()) == []
    assert seen == [6 * 600, 6]


def test_tasks_pass_sums_on(monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 100)
    rng = random.Random(9)
    rows = [(rng.choice(("en", None)), f"s{i % 3}", " ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(rng.randint(0, 60))))
            for i in range(600)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["lang", "source", "text"])
    told = [tuple(r.values()) for b in divergence._sums(iter([batch])) for r in b.to_pylist()]
    n, docs = Counter(), Counter()
    for lang, source, term, found, held in told:
        n[lang, source, term] += found
        docs[lang, source, term] += held
    want, held = Counter(), Counter()
    for lang, source, text in rows:
        want.update((lang or "", source, t) for t in text.split())
        held.update((lang or "", source, t) for t in set(text.split()))
    assert +n == want and +docs == held and len(told) > len(n)


def test_edges(edge_docs, no_docs):
    rows = [(r.text, r.lang, r.source) for r in edge_docs.collect()]
    assert as_rows(divergence.audit(edge_docs)) == brute(rows, 30)
    assert divergence.audit(no_docs).collect() == []


def test_terms():
    assert divergence.terms("Ab1C_É\x85 x y@z{".encode()) == [t.encode() for t in ("ab", "c", "É\x85 x", "y", "z")]
