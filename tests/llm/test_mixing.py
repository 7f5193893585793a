"""Filter audit, language identification and fill-in-middle against brute force on small tables."""

import hashlib
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.llm import common, fill_in_middle, filter_audit, language_id

W = re.compile(r"[^\x20\x09-\x0D]+")
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, b0 string, mask string, c string, output string, form string, n string, v string, share string"
rnd = random.Random(5)


def row(doc_id, text, lang="en", source="a"):
    return (doc_id, text, lang, source, 0, 1, "clash", "clash", "clash", "clash", "clash", "clash", "clash", "clash")


def prose(n, seed, words=("the", "of", "Thing", "and,", "UP", "über", "😀", "a#", "b", "\x85c")):
    r = random.Random(seed)
    return "".join(r.choice(words) + r.choice([" ", " ", "\n", "  ", "\t"]) for _ in range(n))


TEXTS = [None, "", " \n", "A", "one two", prose(260, 1), prose(260, 2), "\n" + " ".join(f"w{i}" for i in range(230)), " ".join(f"w{i}" for i in range(200)), "ABC " * 90, "a<P>b c", "<S", "P> x <", "x" * 5000, "x" * 4999 + "y", prose(2500, 3)]
#: copies with equal and other ids, repeated rows, null ids and sources
ROWS = [row(i, t, source=["a", "b", None][i % 3]) for i, t in enumerate(TEXTS)]
ROWS += [row(40 + i, t, source="b") for i, t in enumerate(TEXTS)] + [row(3, "A"), row(3, "A"), row(None, "A"), row(None, None, source=None), row(2, TEXTS[5]), row(90, TEXTS[5], source="c")]
LABELS = [(i, i % 2, int(i % 5 == 0)) for i in range(60)] + [(4, 1, None), (4, None, 1), (None, 1, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int")


# ------------------------------------------------------------ filter audit


def fails_of(rows):
    out = []
    for d, t, *_ in rows:
        t = t or ""
        ws = W.findall(t)
        copy = d is not None and any(e is not None and e < d and (u or "") == t for e, u, *_ in rows)
        held = {"A": len(ws) < 200, "B": 100 * len(set(ws)) < 50 * len(ws), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": copy}
        out.append({k for k, v in held.items() if v})
    return out


def audit(rows, labels):
    fails = fails_of(rows)
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, x in labels if x == 1 and d is not None}
    want = {}
    for part in {r[3] or "" for r in rows}:
        mine = [(r[0], f) for r, f in zip(rows, fails) if (r[3] or "") == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [(d, f) for d, f in mine if f & set(order[: step - 1])]
                now = [(d, f) for d, f in left if x in f]
                left = [(d, f) for d, f in left if x not in f]
                total[x] += len(now)
                want[part, "".join(order), step] = [len(left), len(now), sum(x in f for _, f in gone), sum(f == {x} for _, f in mine), sum(d in good for d, _ in now), sum(d in toxic for d, _ in now), 0]
        for (p, order, step), v in want.items():
            if p == part:
                v[-1] = total[order[step - 1]]
    return want


@pytest.mark.parametrize("alike", [False, True])
def test_filter_audit(docs, labels, monkeypatch, alike):
    """alike: all hashes of blocks are equal, so that texts of one length meet in one class and whole texts decide."""
    if alike:
        monkeypatch.setattr(filter_audit, "block_hashes", lambda text: [F.lit(1).cast("bigint") for _ in filter_audit.BLOCKS])
        monkeypatch.setattr(filter_audit, "BROADCAST_ROWS", 0)
    got = {(r["part"], r["filter_order"], r["step"]): [r[k] for k in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in filter_audit.audited(docs, labels).collect()}
    assert got == audit(ROWS, LABELS)


def test_filter_audit_of_nothing(none, docs, labels):
    assert filter_audit.audited(none, labels).count() == 0
    bare = filter_audit.audited(docs, labels.where("false")).agg(F.sum("good_lost"), F.sum("toxic_lost"), F.sum("removed")).first()
    assert bare[0] == bare[1] == 0 < bare[2]


def test_filter_audit_with_other_filters(docs, labels):
    sums, letters = filter_audit.masks(docs, labels, {"X": F.col("n_chars") > 0, "Z": F.lit(None).cast("boolean"), "L": F.col("lang") == "en"}, "Q", "lang")
    assert letters == ["L", "Q", "X", "Z"]
    got = {r["mask"]: r["n"] for r in sums.collect()}
    copy = sum("E" in f for f in fails_of(ROWS))
    assert got == {1: len(ROWS) - copy, 3: copy}
    with pytest.raises(ValueError, match="too many orders"):
        filter_audit.orders(sums, list("ABCDEFGH"))


def test_blocks_cover_texts(spark):
    rows = spark.createDataFrame([(n, "x" * n + "y" + "z" * k) for n in (0, 63, 64, 511, 512, 4095, 4096, 9000) for k in (0, 1)], "n int, text string")
    hashes = {tuple(r) for r in rows.select(*filter_audit.block_hashes(F.col("text"))).collect()}
    assert len(hashes) == 16


# ------------------------------------------------------------ fill-in-middle


def cut(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    h = [int(x, 16) for x in re.findall("." * 8, hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest())[:4]]
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    return (len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else (len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_marked_ends():
    for _ in range(800):
        text = "".join(rnd.choice(["a", "é", "😀", " ", "\n", "\t", "<", "P>", "\x85", "\x1c", "x"]) for _ in range(rnd.randint(0, 40)))
        units, bits = UNIT.findall(text), fill_in_middle.ends(text.encode())
        assert bits.bit_count() == len(units)
        assert [fill_in_middle.after(bits, k) for k in range(len(units) + 1)] == [len("".join(units[:k]).encode()) for k in range(len(units) + 1)]


def test_parts_come_back():
    pieces = ["<", "P>", "S>", "M", ">", "<M", "é", " ", "a"]
    for i in range(3000):
        raw = "".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 12))).encode()
        form, out = fill_in_middle.transformed(raw, i, 1, 100, 50)[1::3]
        assert fill_in_middle.restored(out, form) == raw


def test_fill_in_middle(docs, none):
    made = fill_in_middle.transform(docs)
    assert sorted(repr(tuple(r)) for r in made.collect()) == sorted(repr((d, *cut(d, t))) for d, t, *_ in ROWS)
    back = sorted(repr(tuple(r)) for r in fill_in_middle.restore(made.withColumn("text", F.lit("clash"))).collect())
    assert back == sorted(repr((d, t or "")) for d, t, *_ in ROWS)
    assert {r["form"] for r in made.collect()} == {"plain", "spm", "psm"}
    assert fill_in_middle.transform(none).count() == 0 and fill_in_middle.restore(fill_in_middle.transform(none)).count() == 0


def test_a_text_of_millions_of_tokens():
    raw = ("é " * 3_000_000).encode()
    n, form, first, middle, out = fill_in_middle.transformed(raw, 7, 42, 100, 0)
    h = fill_in_middle.drawn(42, 7)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    # each unit but the first begins with a blank; the last blank is one of its own
    assert (n, form) == (3_000_001, "psm") and first == max(0, 2 * a - 1) and middle == min(2 * b - 1, 6_000_000) - first
    assert fill_in_middle.restored(out, form) == raw


# ------------------------------------------------------------ language identification

STEMS = {"en": "the of and to with house water never under", "de": "der und nicht haus wasser unter nimmer für über", "fr": "le des est maison jamais sous avec être où", "es": "el los casa agua nunca bajo con está niño", "xx": "qua zaz kuu maq iqi oqo zuq aqa"}


def told(lang, seed, n=30):
    r = random.Random(seed)
    return " ".join(r.choice(STEMS[lang].split()) for _ in range(n))


LANG_ROWS = [row(i, told(lang, i), lang) for i, lang in enumerate(list(STEMS) * 60)]
LANG_ROWS += [row(1000, None), row(1001, ""), row(1002, "12 ½ …!?"), row(1003, "é", None), row(None, told("de", 3), "de"), row(1004, told("fr", 9, 60_000), "fr"), row(1005, told("en", 1), None), row(5, told("en", 5), "en")]


def test_language_id(spark, none):
    docs = spark.createDataFrame(LANG_ROWS, SCHEMA).repartition(3)
    got = language_id.predicted(docs, sample=80).collect()
    assert sorted(map(repr, (r["doc_id"] for r in got))) == sorted(repr(r[0]) for r in LANG_ROWS)
    by = {r["doc_id"]: r for r in got}
    for d, t, lang, *_ in LANG_ROWS:
        assert by[d]["held_out"] == (zlib.crc32(("" if d is None else str(d)).encode()) % 3 == 1)
        assert 0 <= by[d]["score"] <= 1
        if not t or not any(map(str.isalpha, t)):
            assert (by[d]["lang_pred"], by[d]["score"]) == ("und", 0.0)
        elif lang and len(t) > 20:
            assert by[d]["lang_pred"] == lang, (d, lang, by[d])
    assert by[1003]["lang_pred"] in STEMS
    assert language_id.predicted(none).count() == 0
    mute = language_id.predicted(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {(r["lang_pred"], r["score"]) for r in mute.collect()} == {("und", 0.0)}
    single = {r["lang_pred"] for r in language_id.predicted(docs.where("lang = 'fr'")).collect()}
    assert single == {"fr"}


def test_held_out_accuracy_on_given_documents(spark):
    docs = common.table(spark, "/root/testdata/sf0.01", "documents")
    rows = language_id.predicted(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred != 'und'").collect()
    assert len(rows) > 250 and sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.98 * len(rows)


def test_machines_equal_a_plain_descent(monkeypatch):
    """The dual's optimum against batch gradient descent on the primal."""
    monkeypatch.setattr(language_id, "PASSES", 300)
    r = np.random.default_rng(3)
    x = r.normal(size=(30, language_id.DIMENSIONS)).astype(np.float32) * 0.02
    y = np.where(x[:, :5].sum(axis=1) > 0, 1, -1)
    w, b = language_id.fit(x, y)
    cost = np.array([language_id.COST * len(y) / (2 * (y == s).sum()) for s in y])
    v, c = np.zeros(x.shape[1]), 0.0
    for _ in range(40_000):
        slack = np.maximum(0, 1 - y * (x @ v + c)) * cost * y
        v, c = v - 0.0005 * (v - 2 * (x.T @ slack)), c - 0.0005 * (c - 2 * slack.sum())
    assert np.allclose(x @ w + b, x @ v + c, atol=1e-4)


def test_families():
    known = {c: f for f, codes in language_id.FAMILIES.items() for c in codes.split()}
    unit = {n: np.eye(4)[i] for i, n in enumerate(["en", "fr", "q1"])} | {"q2": np.array([0.1, 0.9, 0, 0])}
    assert language_id.families_of(["en", "fr", "q2"], unit, known) == {"en": "germanic", "fr": "romance", "q2": "romance"}
    assert language_id.families_of(["q1", "q2"], unit, known) == {"q1": "q1", "q2": "q2"}
    # within a family: votes, then sums, then names; the score is that of the least sure step
    model = {"families": {"f": ["a", "b", "c"], "g": ["d"]}, "of_family": ["f", "g"], "of_pair": [("a", "b"), ("a", "c"), ("b", "c")]}
    margins = {("f", "f"): 2.0, ("f", "g"): -2.0, ("a", "b"): 0.5, ("a", "c"): -0.25, ("b", "c"): 0.1}
    name, score = language_id.decided(margins, model)
    assert (name, round(score, 6)) == ("a", round(1 / (1 + np.exp(0.5)), 6))
    assert language_id.decided({**margins, ("f", "g"): 3.0}, model)[0] == "d"


def test_long_texts_are_cut_into_grams_once(monkeypatch):
    text = told("de", 4, 2000)
    whole = language_id.vector(text)
    monkeypatch.setattr(language_id, "CHUNK", 700)
    assert np.allclose(language_id.vector(text), whole) and abs(float((whole**2).sum()) - 1) < 1e-5
