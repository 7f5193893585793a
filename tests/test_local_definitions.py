"""Short forms of documents against a plain reading of each text; rows that share a doc_id or have none stay apart."""

import random
import re

import pytest

from lexweave.operators import exact, local_definitions, matching, resolve

NAMES = {"한국전력공사": "kepco", "금융감독원": "fss", "한국전기연구원": "keri"}
PARTS = [*NAMES, "한전공", "감독원", "KERI", "(", ")", " (이하 ", "이하 ", ", ", " ", "\n", "은", "“", "”", "x1", "AP", "무명회사"]
rnd = random.Random(8)
TEXTS = ["한국전력공사(이하 한전공)는. 한전공은 새한전공 한전공2 한전공", "KERI(한국전기연구원) KERI", "무명회사(무명) 무명", "금융감독원, 이하 감독원. 감독원 감독원은", "", None] + ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(2, 14))) for _ in range(150)]
ROWS = [(i, t) for i, t in enumerate(TEXTS)] + [(0, TEXTS[1]), (0, TEXTS[0]), (None, TEXTS[0]), (None, TEXTS[3])]

PATTERNS = [re.compile(p) for p in (r"([가-힣A-Za-z0-9·\- ]{2,40})\(\s*(?:이하\s*)?[\"'“”]?([가-힣A-Za-z0-9·\-]{1,20})[\"'“”]?\s*\)", r"([가-힣A-Za-z0-9·\- ]{2,40}),?\s*이하\s*[\"'“”]?([가-힣A-Za-z0-9·\-]{1,20})[\"'“”]?")]


def entities(form):
    """Names that cover enough of a form; the profile of organisations ignores blanks and middle dots."""
    bare = re.sub(r"[\s·\-]", "", form)
    out = set()
    for name, e in NAMES.items():
        for m in re.finditer(f"(?={name})", bare):
            at = [i for i, c in enumerate(form) if not re.match(r"[\s·\-]", c)][m.start() : m.start() + len(name)]
            if all(b - a <= 3 for a, b in zip(at, at[1:])) and at[-1] + 1 - at[0] >= 0.7 * len(form):
                out.add(e)
    return out


def defined(text):
    out = set()
    for p in PATTERNS:
        for m in p.finditer(text or ""):
            long, short = m[1].strip(), m[2].strip()
            if not long or long == short:
                continue
            if found := entities(long):
                out |= {(short, long, e, *m.span()) for e in found}
            elif len(short) > len(long):
                out |= {(long, short, e, *m.span()) for e in entities(short)}
    return out


def used(text):
    out = set()
    for alias, _, e, a, b in defined(text):
        at = text.find(alias)
        while at >= 0:
            end = at + len(alias)
            if not a <= at < b and not (at and text[at - 1].isalnum()) and not re.match("[0-9A-Za-z]", text[end : end + 1]):
                out.add((at, end, alias, e))
            at = text.find(alias, end)
    return out


@pytest.fixture(scope="module")
def given(spark):
    docs = spark.createDataFrame(ROWS, "doc_id int, text string").repartition(3)
    return docs, spark.createDataFrame([(i, e, n, "korean_org_name") for i, (n, e) in enumerate(NAMES.items())], "item_id int, entity_id string, surface string, profile string")


def test_definitions_and_occurrences(spark, given):
    docs, bindings = given
    local = local_definitions.definitions(docs, bindings)
    got = {tuple(r) for r in local.select("row.doc_id", "alias", "long_form", "entity_id", "start", "end").collect()}
    assert got == {(d, *x) for d, t in ROWS for x in defined(t)} and len({x[0] for x in got}) > 8
    found = local_definitions.occurrences(docs, local).select("row.doc_id", "start", "end", "alias", "entity_id").collect()
    assert {tuple(r) for r in found} == {(d, *x) for d, t in ROWS for x in used(t)} and len(found) > 5
    none = docs.where("false")
    assert local_definitions.definitions(none, bindings).count() == 0 == local_definitions.definitions(docs, bindings.where("false")).count()


def test_short_forms_beside_mentions(spark):
    texts = ["한국전력공사(이하 '한전공'이라 한다)은", "한국전력공사, 이하 한전공은 ", "한국전력공사 이하 한전", "KERI(한국전기연구원)", "x" * 30 + " KERI (한국전기연구원 )", "xKERI(한국전기연구원)", "한국전력공사(한국전력공사들)"]
    rows = []
    for i, t in enumerate(texts):
        name = next(n for n in NAMES if n in t)
        rows.append((i, t, t.index(name), t.index(name) + len(name), NAMES[name], i != 2))
    mentions = spark.createDataFrame(rows, "row int, text string, start int, end int, entity_id string, sure boolean")
    got = {(r["row"], r["alias"], r["entity_id"], r["sure"], r["start"]) for r in local_definitions.defined_by_mentions(mentions).collect()}
    # the sixth text's word is longer than a short form may be cut to: it begins at its own start
    assert got == {(0, "한전공", "kepco", True, 11), (1, "한전공은", "kepco", True, 11), (2, "한전", "kepco", False, 10), (3, "keri", "keri", True, 0), (4, "keri", "keri", True, 31), (5, "xkeri", "keri", True, 0)}


def test_rows_of_one_doc_id_are_resolved_apart(spark):
    rows = [(1, "한전은 QMS를 쓴다"), (1, "AP 장애 한전"), (None, "한전은"), (1, "AP 장애 한전"), (2, None)]
    b = [(1, "kepco", "한전", "korean_org_name"), (2, "net", "AP", "latin_acronym"), (3, "flow", "AP", "latin_acronym"), (4, "qms", "QMS", "latin_acronym")]
    found = resolve.resolved(spark.createDataFrame(rows, "doc_id int, text string"), spark.createDataFrame(b, "item_id int, entity_id string, surface string, profile string"), fast=True)
    got = sorted(repr((r["doc_id"], r["start"], r["surface"], r["entity_id"])) for r in found.collect())
    second = [(1, 0, "AP", None), (1, 6, "한전", "kepco")]
    assert got == sorted(map(repr, [(1, 0, "한전", "kepco"), (1, 4, "QMS", "qms"), *second, *second, (None, 0, "한전", "kepco")]))


def test_matches_of_rows_without_and_with_equal_ids(spark):
    docs = spark.createDataFrame([(1, "ab"), (1, "xab"), (None, "ab"), (None, "b")], "doc_id int, text string")
    items = spark.createDataFrame([(1, "ab"), (1, "ab"), (2, "b")], "item_id int, surface string")
    want = sorted([("1", 1, 0), ("1", 2, 1), ("1", 1, 1), ("1", 2, 2), ("None", 1, 0), ("None", 2, 1), ("None", 2, 0)])
    for most in (1 << 20, 0):
        assert sorted((repr(r["doc_id"]), r["item_id"], r["start"]) for r in matching.literal_matches(docs, items, most).collect()) == want


def test_profile_matches_by_automata_and_by_joins(spark):
    parts = ["한 전", "한·전", "ＡＰ", "a.p", "A-P", "ap", "QMS", "한전", "전력", " ", "공\u200b사", "l0l", "1O1", "😀", "x", "\n", "é"]
    rows = [(i % 50, "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))) for i in range(120)] + [(None, "한전"), (1, None), (2, "")]
    b = [(1, "k", "한전", "korean_org_name"), (2, "n", "AP", "latin_acronym"), (3, "f", "AP", "latin_acronym"), (4, "q", "QMS", "latin_word"), (5, "l", "1O1", "ocr_tolerant"), (6, "e", "전력공사", "korean_org_name"), (7, "z", "-", "latin_word"), (8, "t", "한전", "korean_term")]
    docs, bindings = spark.createDataFrame(rows, "doc_id int, text string"), spark.createDataFrame(b, "item_id int, entity_id string, surface string, profile string")
    one, two = (sorted(map(repr, exact.profile_matches(docs, bindings, most).collect())) for most in (1 << 20, 0))
    assert one == two and len(one) > 60
    assert exact.profile_matches(docs, bindings.where("false")).count() == 0 == exact.profile_matches(docs.where("false"), bindings).count()


def test_definitions_in_long_texts_as_the_patterns_read_them(spark):
    """Spans of the kernels against the patterns alone, over pieces that make names meet, overlap and fail."""
    from lexweave.functions import definitions as D

    parts = ["가", "나다", "a1", "·", "-", " ", "  ", "\n", "\u3000", ",", "(", ")", "이하", "이", "하", "“", "'", "x" * 39, "라" * 21, "."]
    some = random.Random(14)
    for text in ["".join(some.choice(parts) for _ in range(some.randint(1, 30))) for _ in range(20000)]:
        assert [list(m.span()) + list(m.groups()) for m in PATTERNS[0].finditer(text)] == [list(x) for x in D.in_parentheses(text)], text
        assert [list(m.span()) + list(m.groups()) for m in PATTERNS[1].finditer(text)] == [list(x) for x in D.hereafter(text)], text


def test_short_forms_of_long_texts_in_linear_time(spark):
    """A text of many words is read once: before, each word took a pass over what stands before it."""
    import time

    text = "한국전력공사(이하 한전공)는. " + "낱말 (둘) 한전공은 " * 40000
    given = spark.createDataFrame([(1, "kepco", "한국전력공사", "korean_org_name")], "item_id int, entity_id string, surface string, profile string")
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    began = time.time()
    local = local_definitions.definitions(docs, given)
    assert local_definitions.occurrences(docs, local).count() == 40000
    beside = local.select("row", "alias", "entity_id", "start", "end").selectExpr("*", "true AS sure")
    assert local_definitions.word_occurrences(docs, beside, beside.select("row", "start", "end")).count() == 40000
    assert time.time() - began < 60


def test_tokens_leave_their_task_in_bounded_batches(spark):
    """A batch of texts gives its tokens on in several parts; the different ones once for a stretch."""
    import pyarrow as pa

    from lexweave.functions import segmentation as S

    texts = ["가 나 다 라", None, "", "마" * 300 + " 가", "가 나 AB-12 c"]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(5)), "text": pa.array(texts)})
    parts = list(S.token_batches(iter([batch]), 3))
    rows = [tuple(r.values()) for p in parts for r in p.to_pylist()]
    assert max(p.num_rows for p in parts) == 3 and rows == [(i, *x) for i, t in enumerate(texts) for x in S.token_spans(t or "")]
    assert sorted(r["token"] for p in S.distinct_batches(iter([batch])) for r in p.to_pylist()) == sorted({r[3] for r in rows})


def test_resolver_finds_misspelt_tokens_of_repeated_rows(spark):
    given = spark.createDataFrame([(1, "fss", "금융감독원", "korean_org_name")], "item_id int, entity_id string, surface string, profile string")
    docs = spark.createDataFrame([(1, "금융감도원에서 발표"), (1, "금융감도원에서 발표"), (None, "금융감독원 금융감도원"), (2, None)], "doc_id int, text string")
    out = sorted((str(r["doc_id"]), r["start"], r["surface"]) for r in resolve.resolved(docs, given).collect())
    assert out == [("1", 0, "금융감도원"), ("1", 0, "금융감도원"), ("None", 0, "금융감독원"), ("None", 6, "금융감도원")]
