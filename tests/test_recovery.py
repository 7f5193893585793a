"""Names one step away from words against trying every pair."""

import random
import re
import unicodedata

import duckdb

from lexweave.operators import recovery
from lexweave.plans.registry import ORACLE_SQL, QUERIES

rnd = random.Random(6)
KEYS = {}


def edits(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    short, long = sorted((a, b), key=len)
    if len(short) == len(long):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def inside(word, name):
    it = iter(name)
    return all(c in it for c in word)


def test_one_step_equals_all_pairs(spark):
    syllables = "가각나난다한국전력공사"
    names = ["".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 7))) for _ in range(60)] + ["한국 전력공사", "access point unit", "two words", "QMS", "a1", None, "한국전력공사"]
    words = ["".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 6))) for _ in range(120)] + ["한전공사", "한국전력", "한국전력고사", "APU", "gksrnrwjsfurrhdtk", "ㅂㅡㄴ", "qms", None, "", "ㅃㅡㄴ", "tw", "한국전력공샤"]
    words += [n[:-1] for n in names if n] + [n[1:] for n in names if n]
    got = {tuple(r) for r in recovery.one_step(spark.createDataFrame([(w,) for w in words], "token string"), spark.createDataFrame([(n,) for n in names], "surface string")).collect()}
    want = set()
    for w in filter(None, words):
        for n in filter(None, names):
            compact = n.replace(" ", "")
            if re.fullmatch("[가-힣]{3,32}", w):
                if re.fullmatch("[가-힣]{3,32}", n) and edits(unicodedata.normalize("NFD", w), unicodedata.normalize("NFD", n)):
                    want.add((w, n, "jamo"))
                if re.fullmatch("[가-힣]{4,60}", compact) and w[0] == compact[0] and w[-1] == compact[-1] and all(c in compact[1:-1] for c in w[1:-1]) and len(w) + 2 <= len(compact) <= 2 * len(w) and inside(w, compact):
                    want.add((w, n, "abbrev"))
    want |= {("APU", "access point unit", "initials"), ("gksrnrwjsfurrhdtk", "한국전력공사", "keyboard")}
    assert {x for x in got if x[2] != "hangul_keyboard"} == want and {x[2] for x in want} == {"jamo", "abbrev", "initials", "keyboard"}
    assert {x[2] for x in got} <= {"jamo", "abbrev", "initials", "keyboard", "hangul_keyboard"}
    typed = {tuple(r) for r in recovery.one_step(spark.createDataFrame([("ㅂㅡㄴ",), ("ㅃㅡㄴ",), ("븐",), ("ㅂ",)], "token string"), spark.createDataFrame([("QMS",), ("q",)], "surface string")).collect()}
    assert typed == {("ㅂㅡㄴ", "QMS", "hangul_keyboard"), ("ㅃㅡㄴ", "QMS", "hangul_keyboard")}
    none = spark.createDataFrame([], "token string")
    assert recovery.one_step(none, spark.createDataFrame([("QMS",)], "surface string")).count() == 0


def test_names_one_jamo_apart_meet_once(spark):
    from itertools import product

    names = ["".join(p) for p in product("가나다", repeat=4)] + ["가아아가", "각가가", "가가각", "가각가"]
    words = names + ["나가아가", "가아가", "가가가까"]
    frame = lambda rows, name: spark.createDataFrame([(r,) for r in rows * 2], f"{name} string")
    found = recovery._one_jamo(frame(words, "token"), frame(names, "surface"))
    got = [(r["token"], r["surface"]) for r in found.collect()]
    nfd = {w: unicodedata.normalize("NFD", w) for w in words}
    assert sorted(got) == sorted((w, n) for w in words for n in set(names) if edits(nfd[w], nfd[n]))


def test_no_names_through_the_driver(spark, tmp_path, capsys):
    """Spread names are many times what Spark takes them for: no join may send them through the driver, small as they are here."""
    spark.createDataFrame([(k,) for k in (0, 1, 7, 10, 17, 123456, 123457, 1234567, 999999, None)], "p_partkey bigint").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(k,) for k in (0, 7, 8, 9, 345, 123457, 999999, 999999, None)], "s_suppkey bigint").write.parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    for name in ("part", "supplier"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    found = QUERIES["j10_recovered_names"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in found.collect()) == sorted(con.sql(ORACLE_SQL["j10_recovered_names"]).fetchall())
    name = spark.read.parquet(f"{tmp_path}/part.parquet").selectExpr("cast(p_partkey AS string) AS surface")
    capsys.readouterr()
    for df in (found, recovery.one_step(name.withColumnRenamed("surface", "token"), name)):
        df.explain()
        plan = capsys.readouterr().out
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
