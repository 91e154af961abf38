"""Equal texts are searched once, and all their copies are found."""

import math
import random
from collections import Counter, defaultdict

from tidewell.llm import bm25_wand


def _texts():
    rng = random.Random(8)
    texts = [" ".join(rng.choices([f"w{int(rng.paretovariate(0.6))}" for _ in range(60)], k=rng.choice([1, 3, 40]))) for _ in range(120)]
    return texts + [rng.choice(texts[:30]) for _ in range(200)] + [texts[5]] * 30 + [None, "", None]


def _brute(rows, queries, k):
    tf = [(i, Counter((t or "").split())) for i, t in rows]
    n, mean = Counter(w for _, c in tf for w in c), sum(sum(c.values()) for _, c in tf) / len(tf)
    found = {}
    for q, text in queries:
        scores = [(i, sum(math.log(1 + (len(tf) - n[w] + 0.5) / (n[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in set((text or "").split()) if w in c)) for i, c in tf]
        if best := sorted((-round(s, 9), i) for i, s in scores if s > 0)[:k]:
            found[q] = [i for _, i in best]
    return found


def _search(spark, monkeypatch, rows, queries, k):
    waves, searched = bm25_wand._waves, []
    monkeypatch.setattr(bm25_wand, "_waves", lambda docs, *rest: (searched.append(docs.count()), waves(docs, *rest))[1])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = defaultdict(list)
    for r in bm25_wand.search(docs, spark.createDataFrame(queries, "query_id long, text string"), k=k).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.doc_id)
    return dict(got), searched


def test_bm25_searches_equal_texts_once(spark, monkeypatch):
    monkeypatch.setattr(bm25_wand, "SHARD", 40)
    texts = _texts()
    rows = list(enumerate(texts))
    queries = [(i, t) for i, t in rows if i % 7 == 0]
    got, searched = _search(spark, monkeypatch, rows, queries, 6)
    assert got == _brute(rows, queries, 6)
    assert searched == [len({t or "" for t in texts})]


def test_bm25_finds_all_rows_of_repeated_ids(spark, monkeypatch):
    rows = [(i // 2, t) for i, t in enumerate(_texts())]
    queries = [(i, t) for i, (_, t) in enumerate(rows) if i % 40 == 0]
    got, searched = _search(spark, monkeypatch, rows, queries, 4)
    assert got == _brute(rows, queries, 4) and searched == [len(rows)]
