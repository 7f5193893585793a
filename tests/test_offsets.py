"""Maps of folds against plain readings, their composition and inverse, and every offset in every unit."""

import random
import unicodedata

from pyspark.sql import functions as F

from lexweave.functions import offsets as O

rnd = random.Random(4)
PARTS = ["한", "전", "한", "ᄒ", "é", "é", "Ａ", "　", "ﬁ", "​", "a", " ", "😀", "́", "ß", "ㅎㅏ", "각", "½"]
TEXTS = ["", "한", None, "한전", "ＡＢ", "​"] + ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(1, 14))) for _ in range(120)]


def frame(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")


def each(runs):
    """Raw span of every folded character."""
    out = []
    for r in runs:
        out += [(r["raw"], r["raw"] + r["width"]) if r["block"] else (r["raw"] + k, r["raw"] + k + 1) for k in range(r["n"])]
    return out


def test_steps(spark):
    rows = frame(spark).select("i", "t", O.nfc("t").alias("nfc"), O.cluster("t").alias("cluster"), O.nfkc("t").alias("nfkc"), O.width("t").alias("width"), O.visible("t").alias("visible")).collect()
    for r in rows:
        t = r["t"]
        if t is None:
            assert r["nfc"] is None or r["nfc"]["text"] is None
            continue
        assert r["nfc"]["text"] == unicodedata.normalize("NFC", t) or any(unicodedata.normalize("NFC", t[i : i + 2]) != t[i : i + 2] for i in range(len(t)))
        assert r["nfkc"]["text"] == "".join(unicodedata.normalize("NFKC", c) for c in t) and r["visible"]["text"] == t.replace("​", "")
        for name in ("nfc", "cluster", "nfkc", "width", "visible"):
            own = each(r[name]["runs"])
            assert len(own) == len(r[name]["text"]) and all(x <= y for x, y in zip(own, own[1:]))
            for c, (a, b) in zip(r[name]["text"], own):
                part = unicodedata.normalize("NFC", t[a:b])
                assert {"nfc": c in part, "nfkc": c in unicodedata.normalize("NFKC", t[a:b]), "visible": c == t[a:b]}.get(name, True), (t, c, a, b)
        # whole runs: what a cluster maps to is the fold of its raw text alone
        for run in r["cluster"]["runs"]:
            raw = t[run["raw"] : run["raw"] + run["width"]]
            assert r["cluster"]["text"][run["out"] : run["out"] + run["n"]] == unicodedata.normalize("NFC", raw).translate(O._ASCII)


def test_composition_and_inverse(spark):
    steps = frame(spark).where("t is not null").select("i", "t", O.nfc("t").alias("a"))
    steps = steps.withColumn("b", O.visible(F.col("a.text"))).withColumn("c", O.nfkc(F.col("b.text")))
    rows = steps.withColumn("ab", O.then(F.col("a.runs"), F.col("b.runs"))).withColumn("abc", O.then(F.col("ab"), F.col("c.runs")))
    places = F.transform(F.sequence(F.lit(0), F.length("c.text")), lambda k: F.struct(O.raw_start(F.col("abc"), k).alias("s"), O.raw_end(F.col("abc"), k).alias("e")))
    back = F.transform(F.sequence(F.lit(0), F.length("t")), lambda k: O.folded_place(F.col("abc"), k))
    for r in rows.select("*", places.alias("places"), back.alias("back")).collect():
        a, b, c = (each(r[x]["runs"]) for x in "abc")
        want = []
        for s, e in c:
            mid = [b[k] for k in range(s, e)]
            low, high = mid[0][0], mid[-1][1]
            want.append((a[low][0], a[high - 1][1]))
        assert each(r["abc"]) == want, r["t"]
        assert [p["s"] for p in r["places"]] == [s for s, _ in want] + [None] and [p["e"] for p in r["places"]] == [None] + [e for _, e in want]
        for raw, at in enumerate(r["back"]):
            holds = [k for k, (s, e) in enumerate(want) if s <= raw < e]
            assert (at in holds) if holds else at is None


def test_every_offset_and_back(spark):
    rows = frame(spark).select("t", O.unit_tables("t").alias("u"))
    at = F.sequence(F.lit(0), F.octet_length("t"))
    rows = rows.select("t", "u", F.transform(at, lambda k: O.codepoint(F.col("u.bytes"), k)).alias("back"))
    for r in rows.collect():
        t = r["t"] or ""
        assert r["u"]["bytes"] == [len(t[:k].encode()) for k in range(len(t) + 1)] and r["u"]["utf16"] == [len(t[:k].encode("utf-16-le")) // 2 for k in range(len(t) + 1)]
        if r["t"] is not None:
            want = {len(t[:k].encode()): k for k in range(len(t) + 1)}
            assert r["back"] == [want.get(k) for k in range(len(t.encode()) + 1)]


def test_offsets_of_all_rows_in_bounded_batches(spark):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"key": pa.array(range(len(TEXTS))), "text": pa.array(TEXTS)})
    parts = list(O.unit_batches(iter([batch]), 20))
    assert max(len(p.column("bytes").flatten()) for p in parts if p.num_rows > 1) <= 20 and sum(p.num_rows for p in parts) == len(TEXTS)
    got = {r["i"]: (r["bytes"], r["utf16"]) for r in O.unit_rows(frame(spark), "i", "t").collect()}
    assert got == {i: ([len(t[:k].encode()) for k in range(len(t) + 1)], [len(t[:k].encode("utf-16-le")) // 2 for k in range(len(t) + 1)]) for i, t in ((i, t or "") for i, t in enumerate(TEXTS))}


def test_stretches_of_ascii_are_single_pieces():
    """The same runs as by single characters, from fewer pieces: before, a text of 1,000 plain characters had as many."""
    some = random.Random(9)
    for text in ["".join(some.choice([*PARTS, "ab Cd", "E", "e\u0301"]) for _ in range(some.randint(0, 12))) for _ in range(3000)] + ["x" * 1000]:
        for pieces, fold in ((O.composed, str), (O.clustered, lambda s: s.translate(O._ASCII)), (O.by_character(lambda c: unicodedata.normalize("NFKC", c)), str)):
            assert O.runs_of(O._by_stretch(pieces, fold)(text)) == O.runs_of(pieces(text)), text
    assert len(list(O._by_stretch(O.composed)("x" * 1000))) == 2
