"""BM25 against plain sums, with copies, repeated and missing keys, and without a shuffle of the documents' terms."""

import math
import random
import re
from collections import Counter, defaultdict

from lexweave.operators import retrieval


def best(docs, queries, k):
    tf, sizes = defaultdict(Counter), [len(re.findall(r"[^\W_]+", t.lower())) for _, t in docs if t is not None]
    for d, t in docs:
        own = re.findall(r"[^\W_]+", (t or "").lower())
        tf[d, len(own)].update(own)
    df, n, mean = Counter(w for c in tf.values() for w in c), len(docs), sum(sizes) / max(len(sizes), 1)
    out = set()
    for q, t in queries:
        score = defaultdict(float)
        for w in set(re.findall(r"[^\W_]+", t.lower())):
            for (d, size), c in tf.items():
                if w in c:
                    score[d] += math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * size / mean))
        order = sorted(score, key=lambda d: (-round(score[d], 9), (d is not None, d or 0)))
        out |= {(q, d, round(score[d], 6), i + 1) for i, d in enumerate(order[:k])}
    return out


def test_bm25_equals_plain_sums(spark, monkeypatch):
    rnd = random.Random(8)
    words = ["ab", "B", "c9", "한전", "É", "zz", "the"]
    text = lambda n: rnd.choice([" ", ", ", "\n"]).join(rnd.choice(words) for _ in range(rnd.randint(0, n)))
    docs = [(i, text(12)) for i in range(60)] + [(100 + i, "ab the ab") for i in range(9)] + [(300, None), (301, ""), (302, "-- ")]
    asked = [(i, text(5)) for i in range(9)] + [(50, "nothing here"), (51, "")]
    repeated = docs + [(3, "ab zz"), (3, "zz ab"), (3, "the"), (None, "ab"), (None, "c9 the")]
    monkeypatch.setattr(retrieval, "MOST_GAINS", 16)
    for block in (2048, 4):
        monkeypatch.setattr(retrieval, "QUERIES_A_SCAN", block)
        for rows in (docs, repeated):
            got = retrieval.bm25(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(asked, "query_id bigint, text string"), 4).collect()
            assert {(r["query_id"], r["doc_id"], round(r["score"], 6), r["rank"]) for r in got} == best(rows, asked, 4) and len(got) == len(best(rows, asked, 4))
    assert retrieval.bm25(spark.createDataFrame(docs, "doc_id bigint, text string").where("false"), spark.createDataFrame(asked, "query_id bigint, text string"), 4).count() == 0


def test_terms_of_documents_are_not_shuffled(spark):
    docs = spark.createDataFrame([(i, "ab the c9") for i in range(50)], "doc_id bigint, text string")
    plan = retrieval.bm25(docs, spark.createDataFrame([(1, "ab c9")], "query_id bigint, text string"), 3)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan
