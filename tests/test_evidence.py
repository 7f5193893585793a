"""Vetoes, self-definitions and passages on worked-out texts; passages against trying all subsets."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from lexweave.operators import evidence

SCHEMA = "id int, text string, start int, end int, candidates array<struct<entity_id:string,canonical:string,definition:string,aliases:array<string>>>"
NET = ("net", "네트워크 액세스 포인트", "무선 단말을 유선망에 잇는 중계 장치", ["AP"])
FLOW = ("flow", "승인 처리 절차", "결재 문서를 차례로 승인하는 업무 절차", ["AP"])


def frame(spark, texts, candidates=(NET, FLOW), surface="AP"):
    rows = [(i, t, None if t is None else t.find(surface), None if t is None else t.find(surface) + len(surface), list(candidates)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


VETOED = [
    ("AP 장애를 접수했다.", None),
    ("그는 \"AP 장애\"라고 말했다.", "QUOTED_ASSERTION"),
    ("\"AP\" 장애를 접수했다.", None),
    ("그는 “AP 장애를 접수했다.", "UNCERTAIN_QUOTATION"),
    ("그는 「밖 『AP』 안」이라 했다.", "QUOTED_ASSERTION"),
    ("AP팀장이 왔다.", "DISTINCT_ROLE_SURFACE"),
    ("AP 담당이 아니다.", "NEGATED_OR_REJECTED_TARGET"),
    ("AP로 보내지 않는다.", "NEGATED_OR_REJECTED_TARGET"),
    ("AP는 가짜 예시다.", "NEGATED_OR_REJECTED_TARGET"),
    ("AP는 가짜 예시가 아니다.", None),
    ("AP는 승인 처리 절차가 아니다.", "NEGATED_OR_REJECTED_TARGET"),
    ("영화 AP의 포스터를 붙였다.", "EXPLICIT_UNREGISTERED_OBJECT"),
    ("AP를 접수했다. 이 설명은 틀렸다.", "SCOPED_RETRACTION_OR_UNREGISTERED"),
    ("AP를 접수했다. 어느 부서인지 알 수 없다.", "EXPLICITLY_UNRESOLVED_TARGET"),
    ("AP를 접수했다.\n\n다른 일.\n\n이 주장은 철회한다.", "SCOPED_RETRACTION_OR_UNREGISTERED"),
    ("AP를 접수했다.\n\n# 다른 절\n\n이 주장은 철회한다.", None),
    ("AP를 접수했다.\n\nAP도 있다.\n\n이 주장은 철회한다.", None),
    ("AP를 접수했다.\n\n이 주장은 철회한다.\n\nAP도 있다.", "SCOPED_RETRACTION_OR_UNREGISTERED"),
    ("담당 부서는 미정. AP", "EXPLICITLY_UNRESOLVED_TARGET"),
    (None, "INVALID_TARGET_SPAN"),
    ("", "INVALID_TARGET_SPAN"),
]


def test_vetoes(spark):
    got = {r["id"]: r for r in evidence.vetoes(frame(spark, [t for t, _ in VETOED])).collect()}
    assert [(t, got[i]["veto"]) for i, (t, _) in enumerate(VETOED)] == VETOED
    remote = got[14]
    assert VETOED[14][0][remote["veto_span"]["start"] : remote["veto_span"]["end"]] == "이 주장은 철회한다."
    other = evidence.vetoes(frame(spark, ["AP 장애"], [("x", "y", None, ["BP"])])).first()
    assert other["veto"] == "TARGET_SURFACE_NOT_REGISTERED"
    assert evidence.vetoes(frame(spark, ["AP 장애"], [])).first()["veto"] is None
    assert evidence.vetoes(frame(spark, ["x"]).where("false")).count() == 0
    # a name that holds a word of denial is no denial
    assert evidence.vetoes(frame(spark, ["AP는 부서가 아니오 센터에 보냈다."], [("x", "부서가 아니오 센터", None, ["AP"])])).first()["veto"] is None


DEFINED = [
    ("AP는 네트워크 액세스 포인트이다.", "net", None),
    ("AP란 결재 문서를 차례로 승인하는 업무 절차입니다.", "flow", None),
    ("AP(승인 처리 절차)", "flow", None),
    ("이 문서에서 AP는 승인 처리 절차다.", "flow", None),
    ("'AP'는 “승인 처리 절차”이다.", "flow", None),
    ("ＡP와 AP는 승인  처리\t절차이다.", None, "NO_EXPLICIT_REGISTERED_DEFINITION"),
    ("AP는 승인 처리 절차가 아니다.", None, "UNSUPPORTED_OR_NEGATED_CONTEXT"),
    ("AP는 승인 처리 절차이다.\n\n이 설명은 오류다.", None, "UNSUPPORTED_OR_NEGATED_CONTEXT"),
    ("AP는 승인 처리 절차이다. AP를 쓴다.", None, "REPEATED_TARGET_IN_CONTEXT"),
    ("AP는 승인 처리 절차이다. 네트워크 액세스 포인트와 다르다.", None, "COMPETING_REGISTERED_ANCHORS"),
    ("그는 \"AP는 승인 처리 절차이다\"라고 했다.", None, "NO_EXPLICIT_REGISTERED_DEFINITION"),
    ("AP 장애가 났다. 승인 처리 절차를 밟는다.", None, "NO_EXPLICIT_REGISTERED_DEFINITION"),
    ("AP는 승인 처리 절차이다." + " 긴 글" * 1400, None, "CONTEXT_BUDGET_EXCEEDED"),
    ("긴 글 " * 1400 + "\n\nAP는 승인 처리 절차이다.", "flow", None),
    (None, None, "INVALID_TARGET_SPAN"),
]


def test_self_definitions(spark):
    got = {r["id"]: r for r in evidence.self_definitions(frame(spark, [t for t, *_ in DEFINED])).collect()}
    assert [(t, got[i]["chosen"], got[i]["abstained"]) for i, (t, *_) in enumerate(DEFINED)] == DEFINED
    first = got[3]
    text = DEFINED[3][0]
    assert (text[first["support"]["start"] : first["support"]["end"]], text[first["anchor"]["start"] : first["anchor"]["end"]], first["evidence"]) == (text, "승인 처리 절차", "DIRECT_REGISTERED_DEFINITION:canonical")
    assert got[2]["evidence"] == "DIRECT_REGISTERED_NAME:canonical"
    one = evidence.self_definitions(frame(spark, [DEFINED[0][0]], [NET])).first()
    assert one["abstained"] == "NO_EXACT_COLLISION"
    bare = evidence.self_definitions(frame(spark, [DEFINED[0][0]], [("a", "짧다", None, []), ("b", None, None, None)])).first()
    assert bare["abstained"] == "NO_MEANINGFUL_REGISTERED_ANCHOR"
    assert evidence.self_definitions(frame(spark, ["x"]).where("false")).count() == 0


def test_quotations(spark):
    texts = ["", "a", "'a'", "“a ‘b’ c”", "“a ‘b” c’", "”", "''\"", "「『』」", "a'b'c'd'"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", evidence.quotations(F.col("t")).alias("q")).collect()
    got = {r["i"]: ([tuple(s) for s in r["q"]["spans"]], r["q"]["malformed"]) for r in rows}
    assert got == {0: ([], False), 1: ([], False), 2: ([(0, 3)], False), 3: ([(3, 6), (0, 9)], False), 4: ([], True), 5: ([], True), 6: ([(0, 2)], True), 7: ([(1, 3), (0, 4)], False), 8: ([(1, 4), (5, 8)], False)}


def test_passages_equal_the_best_of_all_subsets(spark):
    rnd = random.Random(3)
    parts = ["AP를 본다.", "결재 문서를 승인한다.", "무선 단말을 잇는다.", "날씨가 맑다.", "이 주장은 철회한다.", "그는 '남의 말'을 했다.", "업무 절차와 장치", "승인 처리 절차"]
    texts = ["\n\n".join(rnd.sample(parts, rnd.randint(2, 7))) for _ in range(60)]
    texts = [t if "AP" in t else "AP를 본다.\n\n" + t for t in texts]

    def grams(t):
        return {w[i : i + 2].lower() for w in re.findall("[0-9A-Za-z가-힣]+", t) for i in range(len(w) - 1)}

    def score(t):
        own = grams(t)
        return max(2 * len(own & v) / (len(own) + len(v)) for v in (grams(f"{c[1]} {c[2]}") for c in (NET, FLOW)))

    got = {r["id"]: r for r in evidence.selected(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        spans = [(m.start(), m.end()) for m in re.finditer(r"[^\n]+", t)]
        own = next(s for s in spans if s[0] <= t.find("AP") < s[1])
        pool = [s for s in spans if s != own and score(t[slice(*s)]) > 0 and "철회" not in t[slice(*s)] and "'" not in t[slice(*s)]]
        # of all subsets of two at most, the one whose members are best one after another
        best = min(itertools.chain.from_iterable(itertools.combinations(pool, n) for n in range(min(2, len(pool)), min(2, len(pool)) + 1)), key=lambda c: sorted((-score(t[slice(*s)]), abs(s[0] - t.find("AP")), s[0]) for s in c), default=())
        assert [(p["start"], p["end"]) for p in got[i]["passages"]] == sorted([own, *best]), t
        assert got[i]["allowed"] == ("철회" not in t) and got[i]["rendered"].replace("[TARGET]", "").replace("[/TARGET]", "") == "\n\n".join(t[slice(*s)] for s in sorted([own, *best]))
    tight = evidence.selected(frame(spark, texts[:1]), budget=12).first()
    assert (tight["allowed"], tight["refused"], tight["rendered"]) == (False, "CONTEXT_BUDGET_EXCEEDED", "")
    free = evidence.selected(frame(spark, ["AP는 가짜 예시다."]), scoped=False).first()
    assert free["allowed"] and free["rendered"] == "[TARGET]AP[/TARGET]는 가짜 예시다."


@pytest.mark.parametrize("surface", ["a.b", "(x)", "a a"])
def test_surfaces_are_no_patterns(spark, surface):
    row = evidence.selected(frame(spark, [f"말 {surface} 말"], [NET], surface).withColumn("candidates", F.expr("cast(array() as array<struct<entity_id:string,canonical:string,definition:string,aliases:array<string>>>)"))).first()
    assert row["allowed"] and row["rendered"] == f"말 [TARGET]{surface}[/TARGET] 말"
