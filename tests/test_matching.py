import random

from lexweave.operators import matching


def test_literal_matches_equal_brute_force(spark):
    rnd = random.Random(4)
    words = ["a", "b", "ab", "the", "x\ny", ""]
    docs = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 30)))) for i in range(60)] + [(99, None)]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 6)))) for i in range(25)]
    items += [(99, None), (98, ""), (97, items[3][1])]
    given = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, surface string")
    want = {(d, i, p) for d, t in docs if t for i, s in items if s for p in range(len(t) - len(s) + 1) if t[p : p + len(s)] == s}
    for most in (1 << 20, 0):  # the automaton, and the joins for patterns beyond its size
        rows = matching.literal_matches(*given, most).collect()
        assert {(r["doc_id"], r["item_id"], r["start"]) for r in rows} == want and len(rows) == len(want)
        assert all(r["text"][r["start"] : r["end"]] == r["surface"] for r in rows)
    assert matching.literal_matches(given[0], given[1].where("false")).count() == 0


def test_overlap_join_equals_brute_force(spark):
    rnd = random.Random(5)
    rows = [(rnd.randint(0, 2), s, s + rnd.randint(1, 40), str(i)) for i in range(80) for s in [rnd.randint(0, 200)]]
    df = spark.createDataFrame(rows, "doc int, start int, end int, name string")
    got = sorted((r["name"], r["r_name"]) for r in matching.overlap_join(df, df, "doc", 16).collect())
    assert got == sorted((a[3], b[3]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[2] and b[1] < a[2])


def test_greedy_intervals_do_not_overlap(spark):
    rnd = random.Random(6)
    rows = [(rnd.randint(0, 3), s, s + rnd.randint(1, 9), i) for i in range(60) for s in [rnd.randint(0, 60)]]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc int, start int, end int, i int")
    got = matching.greedy_intervals(df, "doc", [F.col("start") - F.col("end"), F.col("start"), F.col("i")], ["i"]).collect()
    want = []
    for r in sorted(rows, key=lambda r: (r[1] - r[2], r[1], r[3])):
        if not any(r[0] == w[0] and r[1] < w[2] and w[1] < r[2] for w in want):
            want.append(r)
    assert sorted((r["doc"], r["start"], r["end"], r["i"]) for r in got) == sorted(want)
