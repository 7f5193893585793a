"""Kernels hold a part of an Arrow batch at a time, whatever the batch's size, and give the same rows."""

import unicodedata

import numpy as np
import pyarrow as pa

from lexweave.functions import batches
from lexweave.functions import text as T
from lexweave.operators import retrieval


def test_parts_of_batches():
    rows = ["x" * n for n in (5, 3000, 1, 0, 700, 9000, 2)]
    held = pa.RecordBatch.from_pydict({"t": pa.array(rows)})
    some = list(batches.parts(iter([held, held.slice(0, 0), held]), rows=3, size=4000))
    assert [t for p in some for t in p.column("t").to_pylist()] == rows * 2
    assert all(p.num_rows <= 3 and (p.num_rows == 1 or p.nbytes <= 4000) for p in some)


def test_forms_of_texts(spark):
    texts = [None, "", "한국" * 9, unicodedata.normalize("NFD", "한국전력 é"), "ﬁ é", "q̣̇"] * 50
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.nfc_where_needed(T.F.col("t")).alias("c"), T.nfd("t").alias("d")).collect()
    assert {r["i"]: (r["c"], r["d"]) for r in got} == {i: tuple(t and unicodedata.normalize(f, t) for f in ("NFC", "NFD")) for i, t in enumerate(texts)}


def test_queries_of_vectors_go_out_as_numbers(spark, monkeypatch):
    rnd, sent, put = np.random.default_rng(3), [], spark.sparkContext.broadcast
    vectors = rnd.normal(size=(3000, 4)).astype(np.float32)
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(vectors)] + [(9999, None)], "vec_id bigint, embedding array<float>").coalesce(1)
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda x: sent.append(x) or put(x))
    monkeypatch.setattr(retrieval, "QUERIES_A_SCAN", 20)
    asked = v.where("vec_id % 60 = 0").selectExpr("vec_id AS query_id", "embedding")
    got = sorted((r["query_id"], r["vec_id"]) for r in retrieval.vector_top(v, asked, 5).collect())
    scores = vectors[::60].astype(np.float64) @ vectors.astype(np.float64).T
    assert got == sorted((60 * q, int(i)) for q, s in enumerate(scores) for i in np.lexsort((np.arange(3000), -np.round(s, 9)))[:5])
    assert [x[1].dtype for x in sent] == [np.float32] * 3


def test_folds_of_texts_at_once():
    from lexweave.operators import exact

    texts = ["", "한 전·K\u200bＰ-Ｓ\u3000😀 A.p", "plain TEXT 0O|5S", "\t\n"]
    for profile in T.PROFILES:
        fold = exact._Fold(profile)
        for t in texts:
            folded, kept = fold.read(t)
            assert folded == t.translate(fold.table) and np.flatnonzero(kept).tolist() == [i for i, c in enumerate(t) if c not in fold.gone]


def test_boundaries_read_what_is_near(spark):
    from lexweave.operators import exact

    rows = [(far + before, "한전", after + far) for far in ("", "가" * 90, "x " * 90) for before in ("", "구", " 구 ", "가칭", "이른바 ", "가나다라마바사아자구", "구\n", "A") for after in ("", "은", "s", "에서도 ", "서울", "서 ", "서가", " 구")]
    df = spark.createDataFrame([(i, "".join(r), len(r[0]), len(r[0]) + 2) for i, r in enumerate(rows)], "doc_id int, text string, start int, end int")
    lit = T.F.lit
    ruled = df.withColumns({"cost": lit(0.0), "left": lit("hangul_token_boundary"), "right": lit("particle_or_token_boundary"), "inside_latin": lit(False)})
    near = sorted(map(repr, exact.proposals(exact.with_boundary(ruled)).collect()))
    held = exact.LEFT, exact.RIGHT
    try:
        exact.LEFT, exact.RIGHT = 100_000, 100_000
        assert near == sorted(map(repr, exact.proposals(exact.with_boundary(ruled)).collect())) and len(near) > 50
    finally:
        exact.LEFT, exact.RIGHT = held
