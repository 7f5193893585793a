"""Lexical ranking against sets of pairs, with common and rare grams, single characters and characters beyond the BMP."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa

from lexweave.operators import retrieval


def grams(t):
    t = "".join(c for c in (t or "").lower() if c.isalnum())
    return {a + b for a, b in zip(t, t[1:])} if len(t) > 1 else set(t)


def test_lexical_equals_sets(spark, monkeypatch):
    rnd = random.Random(2)
    text = lambda n: "".join(rnd.choice("abAB한é -") for _ in range(rnd.randint(0, n)))
    docs = [(i, text(20)) for i in range(80)] + [(200 + i, "ab ab") for i in range(7)] + [(300, None), (301, ""), (302, "a"), (303, "-"), (None, "ab")]
    asked = [(i, text(9)) for i in range(12)] + [(40, "a"), (41, "zq"), (42, "")]
    want = set()
    for q, t in asked:
        found = [(d, len(grams(t) & grams(x)) / len(grams(x)) ** 0.5) for d, x in docs if d is not None and grams(t) & grams(x)]
        want |= {(q, d, round(s, 6)) for d, s in sorted(found, key=lambda f: (-round(f[1], 9), f[0]))[:4]}
    for common in (8, 1, 1000):
        monkeypatch.setattr(retrieval, "_COMMON", common)
        got = retrieval.lexical(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(asked, "query_id bigint, text string"), 4)
        assert {(r["query_id"], r["doc_id"], round(r["score"], 6)) for r in got.collect()} == want


def test_grams_of_a_batch_at_once():
    texts = ["abab", None, "", "x", "😀b😀b", "ab"]
    codes, *_ = retrieval._by_gram([["ab", "x"], ["b😀", "zz"]])
    rows, at, sizes = retrieval._grams_held(pa.array(texts), codes)
    name = {(ord(g[0]) if len(g) > 1 else retrieval._ALONE) << retrieval._BITS | ord(g[-1]): g for g in ("ab", "x", "b😀", "zz")}
    assert Counter((int(r), name[int(codes[i])]) for r, i in zip(rows, at)) == Counter([(0, "ab"), (3, "x"), (4, "b😀"), (5, "ab")])
    assert sizes.tolist() == [len({a + b for a, b in zip(t or "", (t or "")[1:])} or set(t or "")) for t in texts] and isinstance(sizes, np.ndarray)
