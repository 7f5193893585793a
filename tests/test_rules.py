"""Rules and kernels against brute force and worked-out cases; nulls, empty tables and ties among them."""

import datetime as dt
import hashlib
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.functions import chunks, hangul, morphology, segmentation
from lexweave.functions import text as T
from lexweave.operators import evaluation, exact, glossary, local_definitions, matching, proposals, recovery, selection, statistics
from lexweave.sources import glossaries
from lexweave.streaming import sessions

rnd = random.Random(4)


def test_error_bound_is_where_the_binomial_sum_meets_the_level():
    for errors, n, alpha in [(0, 7, 0.05), (1, 10, 0.05), (5, 100, 0.1), (40, 90, 0.01), (3, 2000, 0.05)]:
        p = statistics.error_bound(errors, n, alpha)
        assert math.isclose(sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(errors + 1)), alpha, rel_tol=1e-6)
    assert statistics.error_bound(4, 4) == statistics.error_bound(0, 0) == 1.0
    with pytest.raises(ValueError):
        statistics.error_bound(5, 4)


def test_mcnemar_of_any_size(spark):
    pairs = [(0, 0), (0, 5), (3, 3), (1, 9), (12, 30), (400, 900), (500, 560), (0, 3000)]
    got = spark.createDataFrame(pairs, "b int, c int").select("b", "c", evaluation.mcnemar(F.col("b"), F.col("c")).alias("p")).collect()
    for r in got:
        n, k = r["b"] + r["c"], min(r["b"], r["c"])
        want = min(1.0, float(2 * sum(math.comb(n, i) for i in range(k + 1)) / (1 << n))) if n else 1.0
        assert math.isclose(r["p"], want, rel_tol=1e-9, abs_tol=1e-300), r


def test_conformal_quantile_with_ties_and_nulls(spark):
    rows = [(g, rnd.choice([0.1, 0.2, 0.2, 0.9, rnd.random()])) for g in "abc" for _ in range({"a": 1, "b": 30, "c": 200}[g])] + [("a", None)]
    got = {r["g"]: (r["n"], r["quantile"]) for r in evaluation.conformal_quantile(spark.createDataFrame(rows, "g string, s double"), ["g"], "s", 0.1).collect()}
    for g in "abc":
        s = sorted(x for h, x in rows if h == g and x is not None)
        k = math.ceil((len(s) + 1) * (1 - 0.1))
        assert got[g] == (len(s), 1.0 if k > len(s) else s[k - 1])


def test_fits_equal_steps_over_single_rows(spark):
    rows = [(rnd.choice([0.1, 0.5, 0.7, 0.9]), rnd.choice([0.0, 1.0, 2.0]), rnd.random() < 0.5) for _ in range(120)]
    df = spark.createDataFrame(rows, "score double, size double, label boolean")
    a, b = 1.0, 0.0
    for _ in range(200):
        gaps = [(1 / (1 + math.exp(-(a * s + b))) - y, s) for s, _, y in rows]
        a, b = a - 0.5 * sum(g * s for g, s in gaps) / len(rows), b - 0.5 * sum(g for g, _ in gaps) / len(rows)
    assert np.allclose(statistics.fit_platt(df), (a, b))
    w, bias = np.zeros(2), 0.0
    x, y = np.array([r[:2] for r in rows]), np.array([r[2] for r in rows], dtype=float)
    for _ in range(300):
        gap = 1 / (1 + np.exp(-(x @ w + bias))) - y
        w, bias = w - 0.3 * (x.T @ gap / len(y) + 1e-3 * w), bias - 0.3 * gap.mean()
    got = statistics.fit_fusion(df, ["score", "size"])
    assert np.allclose(got[0], w) and math.isclose(got[1], bias)
    with pytest.raises(ValueError):
        statistics.fit_fusion(df.limit(5), ["score", "size"])


def test_bootstrap_of_one_cluster_and_of_none(spark):
    df = spark.createDataFrame([("a", 0.0, 1.0), ("a", 0.0, 3.0)], "u string, left double, right double")
    assert statistics.paired_bootstrap(df, "u")["low"] is None and statistics.paired_bootstrap(df, "u")["estimate"] == 2.0
    assert statistics.paired_bootstrap(df.where("false"), "u")["estimate"] is None


def test_pairs_of_one_edit_and_of_containment(spark):
    words = ["".join(rnd.choice("abc한전") for _ in range(rnd.randint(0, 6))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(words)), "k int, s string")

    def near(a, b):
        if a == b or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    want = {(i, j) for i, j in itertools.combinations(range(120), 2) if near(words[i], words[j])}
    assert {tuple(r) for r in matching.one_edit_pairs(df, "k", "s").collect()} == want
    held = {(i, j) for i in range(120) for j in range(120) if i != j and len(words[i]) >= 2 and words[i] in words[j]}
    assert {tuple(r) for r in matching.contained(df, "k", "s").collect()} == held
    assert matching.one_edit_pairs(df.where("false"), "k", "s").count() == 0


def test_residuals_are_the_longest_first_reading():
    def parts(s):
        if not s:
            return []
        return next(([s[:n], *rest] for n in range(4, 0, -1) if s[:n] in morphology.SUFFIXES and len(s) >= n and (rest := parts(s[n:])) is not None), None)

    pieces = [*morphology.SUFFIXES, "서울", "민", "가나다", "x"]
    for _ in range(3000):
        s = "".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 3)))
        kind, got, classes = morphology.residual(s, "전")
        own = parts(s)
        if own is not None:
            assert (kind, list(got)) == ("SUFFIX", own)
        else:
            after = next((n for n in range(1, min(4, len(s) - 1) + 1) if parts(s[n:])), None)
            assert (kind, list(got)) == (("UNKNOWN", [s]) if after is None else ("SUFFIX_WITH_MODIFIER", [s[:after], *parts(s[after:])])), s
        assert len(classes) == len(got)


def test_costs_of_changes():
    change = hangul._change
    assert change("ㄱ", "ㄱ") == 0 and change("ㄱ", "ㅋ") == 0.35 and change("ㅂ", "ㅈ") == 0.20 and change("ㅏ", "ㅣ") == 0.20
    assert change("ㄱ", "ㅎ") == 0.20 or change("ㄱ", "ㅎ") == 0.70
    assert change("ㅑ", "ㅡ") == 0.70 and change("ㄱ", "ㅏ") == 1.0 and change("x", "y") == 1.0
    assert all(change(a, b) == change(b, a) for a, b in itertools.product("ㄱㄴㅂㅈㅏㅣㅐㅔㅅㅆ", repeat=2))


def test_paths_keep_the_bare_token_first_and_are_bounded():
    for token in ["한전은", "기획부터", "셀트루온에서", "카카오톡에", "AP", "APs", "한"]:
        got = segmentation.paths(token)
        assert got[0][0] == token and got[0][2] == 1.0 and len(got) <= segmentation.MOST_PATHS
        assert all(token.startswith(c) and len(c) >= 2 or c == token for c, _, _ in got)
    assert ("셀트루온", ("에서",)) in {(c, t.particles) for c, t, _ in segmentation.paths("셀트루온에서")}


def test_byte_chunks():
    def brute(text, most):
        out, start = [], 0
        while start < len(text):
            end = size = 0
            end = start
            while end < len(text) and size < most:
                size += len(text[end].encode())
                end += 1
            if end < len(text):
                low = max(start + 1, end - 200)
                for b in chunks.BREAKS:
                    if (at := text[low:end].rfind(b)) >= 0:
                        end = low + at + len(b)
                        break
            out.append((start, end))
            start = end
        return out

    for _ in range(200):
        t = "".join(rnd.choice(["가", "a", ". ", "다. ", "\n", "\n\n", "😀", "word "]) for _ in range(rnd.randint(0, 400)))
        assert chunks.byte_chunks(t, 97) == brute(t, 97)


def test_hashed_vector():
    v = chunks.hashed_vector("한전", 64)
    want = np.zeros(64)
    jamo = "ㅎㅏㄴㅈㅓㄴ"
    for n in (2, 3, 4):
        for i in range(len(jamo) - n + 1):
            want[int.from_bytes(hashlib.blake2b(jamo[i : i + n].encode(), digest_size=8).digest(), "little") % 64] += 1 / n
    assert np.allclose(v, want / np.linalg.norm(want)) and not chunks.hashed_vector("").any()


def test_channels_give_back_their_characters(spark):
    texts = ["".join(rnd.choice("한전Ａap.·- \t​&S5") for _ in range(rnd.randint(0, 30))) for _ in range(60)]
    for profile in T.PROFILES:
        rows = spark.createDataFrame(list(enumerate(texts)), "i int, s string").withColumn("c", exact.channel(F.col("s"), profile)).withColumn("k", T.alias_key(F.col("s"), profile)).collect()
        for r in rows:
            assert r["c"]["folded"] == r["k"] and len(r["c"]["at"]) == len(r["k"])
            assert all(a < b for a, b in zip(r["c"]["at"], r["c"]["at"][1:]))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id int, text string")
    names = spark.createDataFrame([(1, "한전")], "item_id int, surface string")
    assert exact.matches(none, names, "korean_term").count() == 0
    assert selection.gold_hits(spark.createDataFrame([], "doc_id int, start int, end int"), spark.createDataFrame([], "doc_id int, start int, end int")).count() == 0
    assert local_definitions.definitions(none, names.select("item_id", "surface", F.lit("e").alias("entity_id"), F.lit("korean_term").alias("profile"))).count() == 0
    assert recovery.fuzzy_candidates(spark.createDataFrame([], "token string"), names).count() == 0
    empty = spark.createDataFrame([], "id int, surface string, entity_id string")
    assert proposals.grounding_violations(empty, empty.select("surface", "entity_id"), empty.select("surface", "entity_id")).count() == 0
    kept, report = glossary.trusted_layers(spark.createDataFrame([], "scope string, surface string, entity_id string"))
    assert kept.count() == report.count() == 0


def test_budgets_hold_for_every_pack(spark):
    cards = [(p, f"c{p}-{i}", rnd.random() < 0.5, i, rnd.randint(1, 20), rnd.randint(0, 9), [rnd.randint(1, 5)] * rnd.randint(0, 6)) for p in range(40) for i in range(rnd.randint(1, 6))]
    cards = [(*c[:6], c[6] if c[2] else []) for c in cards]
    got = proposals.shrunk_pack(spark.createDataFrame(cards, "p int, id string, ambiguous boolean, place int, base int, hints int, candidates array<int>"), "p", 60).collect()
    of = {c[1]: c for c in cards}
    for p in range(40):
        own = [r for r in got if r["p"] == p]
        assert sum(of[r["id"]][4] + r["hints_kept"] * of[r["id"]][5] + sum(of[r["id"]][6][: r["options"]]) for r in own) <= 60
        assert all(r["options"] >= min(2, len(of[r["id"]][6])) for r in own)


def test_bundles_refuse_what_was_not_sealed(spark, tmp_path):
    terms = glossaries.from_rows(spark, [{"key": "a", "canonical": "A", "surfaces": ["x", "y"]}, {"key": "b", "canonical": "B"}])
    folder = f"file://{tmp_path}/bundle"
    manifest = glossaries.save(spark, folder, {"terms": terms})
    again = glossaries.save(spark, f"file://{tmp_path}/again", {"terms": terms.repartition(3)})
    assert manifest["snapshot_id"] == again["snapshot_id"]
    assert glossaries.load(spark, folder)[0]["terms"].count() == 2
    with pytest.raises(glossaries.SourceError):
        glossaries.save(spark, folder, {"terms": terms})
    terms.limit(1).write.mode("append").parquet(f"{folder}/terms")
    with pytest.raises(glossaries.SourceError):
        glossaries.load(spark, folder)
    for bad in ([{"key": "a"}], [{"key": "a", "canonical": "A", "what": 1}], [{"key": "a", "canonical": "A"}] * 2, ["text"]):
        with pytest.raises(glossaries.SourceError):
            glossaries.from_rows(spark, bad)
    (tmp_path / "bad.tsv").write_text("id\tcanonical\talias\n1\tA\tx\n1\tB\ty\n")
    with pytest.raises(glossaries.SourceError):
        glossaries.read_terms(spark, f"file://{tmp_path}/bad.tsv")


def test_every_reason_that_keeps_a_mention_from_resolving(spark):
    from pyspark.sql import functions as F

    from lexweave.operators import decisions

    rows = [
        (None, "RESOLVED", "TERM", None, False, 1, 0.9, 0.9), ("degraded_result", "UNCERTAIN", "TERM", None, True, 1, 0.9, 0.9), ("mention_not_term", "AMBIGUOUS", "UNCERTAIN", None, False, 1, 0.4, 0.4), ("kb_missing_dominates", "KB_MISSING", "TERM", None, False, 1, 0.3, 0.3),
        ("no_candidates", "UNCERTAIN", "TERM", None, False, 0, None, None), ("guard_blocked", "AMBIGUOUS", "TERM", "short_core", False, 1, 0.9, 0.9), ("below_resolve_threshold", "AMBIGUOUS", "TERM", None, False, 1, 0.69, 0.69), ("insufficient_margin", "AMBIGUOUS", "TERM", "", False, 2, 0.8, 0.1),
        ("ambiguous", "AMBIGUOUS", "TERM", None, False, 2, 0.8, 0.15), ("ambiguous", "AMBIGUOUS", "TERM", None, False, 1, 0.8, None),
    ]
    df = spark.createDataFrame(rows, "want string, link string, mention string, blocked string, degraded boolean, members int, top double, margin double")
    got = df.select("want", decisions.blocking_reason(*[F.col(c) for c in ("link", "mention", "blocked", "degraded", "members", "top", "margin")]).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got] == [r[0] for r in rows]


def test_components_of_any_length(spark):
    from lexweave.operators import components

    rnd = random.Random(2)
    links = [(i, i + 1) for i in range(300)] + [(1000 + rnd.randint(0, 80), 1000 + rnd.randint(0, 80)) for _ in range(60)] + [(2000, 2000 + i) for i in range(50)] + [(3000, 3000), (None, 7), (8, None), (5, 4), (5, 4)]
    least = {n: n for link in links if None not in link for n in link}
    for _ in range(400):
        for a, b in links:
            if a is not None and b is not None:
                least[a] = least[b] = min(least[a], least[b])
    got = components.components(spark.createDataFrame(links, "a int, b int"))
    assert {tuple(r) for r in got.collect()} == set(least.items())
    held = components.split(got).groupBy("comp").agg({"held": "min", "*": "count"}).count()
    assert held == len(set(least.values()))
    assert components.components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_proposals_without_fields(spark):
    rows = spark.createDataFrame([(1, None, None, None, None, None, None), (2, "s", " 한국전력공사 \t", "d", "session", "llm_proposal", True)], "id int, surface string, canonical string, definition string, scope string, origin string, observed boolean")
    held, named = spark.createDataFrame([], "surface string, entity_id string"), spark.createDataFrame([("e1", "한국전력공사　")], "entity_id string, canonical string")
    got = {r["id"]: r["failed"] for r in proposals.checks(rows, held, named).collect()}
    assert got == {1: ["surface_nonempty", "canonical_nonempty", "definition_nonempty", "evidence_surface_present", "scope_known", "origin_known"], 2: ["no_duplicate_entity"]}


# ---------------------------------------------------------------- eligibility by rules of scope and time


def told(rule, departments, projects, day):
    """excluded, unknown or applies, case by case."""
    open_ = False
    for i, value in enumerate((departments, projects)):
        allow, deny = (rule["allow"] or [[], []])[i] or [], (rule["deny"] or [[], []])[i] or []
        if value and (value in deny or allow and value not in allow):
            return "excluded"
        open_ |= not value and bool(allow or deny)
    first, last = rule["valid_from"], rule["valid_to"]
    if day and (first and day < first or last and day > last):
        return "excluded"
    return "unknown" if open_ or not day and (first or last) else "applies"


def test_eligibility_equals_case_by_case(spark):
    made = random.Random(4)
    some = lambda: made.choice([None, None, [], ["a"], ["b"], ["a", "b"]])
    day = lambda: made.choice([None, None, dt.date(2024, 1, 1), dt.date(2024, 1, 5), dt.date(2024, 2, 1)])
    rule = lambda: {"allow": made.choice([None, [some(), some()]]), "deny": made.choice([None, [some(), None]]), "valid_from": day(), "valid_to": day()}
    row = lambda r: r and (r["allow"], r["deny"], r["valid_from"], r["valid_to"])
    bindings = [(made.choice("STU"), made.choice("efgh"), made.choice([None, rule(), rule(), rule()])) for _ in range(40)] + [(None, "e", None), ("S", None, None)]
    entities = [(e, made.choice([None, rule()])) for e in "efg"]
    asked = [(i // 2, made.choice(["S", "T", "U", "V", None]), made.choice([None, "", "a", "b", "c"]), made.choice([None, "a", "b"]), day(), "clash") for i in range(120)]
    want, free = [], {"allow": None, "deny": None, "valid_from": None, "valid_to": None}
    for n, surface, dep, pro, on, _ in asked:
        for e in "efgh":
            own = told(dict(entities).get(e) or free, dep, pro, on)
            of = [told(r or free, dep, pro, on) for s, x, r in bindings if s == surface and s and x == e]
            if own != "excluded" and any(o != "excluded" for o in of):
                want.append((n, surface, e, own == "applies" and "applies" in of))
    b = spark.createDataFrame([(s, e, row(r)) for s, e, r in bindings], f"surface string, entity_id string, rule {glossary.RULE}")
    e = spark.createDataFrame([(e, row(r)) for e, r in entities], f"entity_id string, rule {glossary.RULE}")
    m = spark.createDataFrame(asked, "n int, surface string, departments string, projects string, as_of date, entity_id string")
    key = lambda r: tuple(map(str, r))
    got = glossary.eligibility(m, b, e)
    assert len(want) > 50 and sorted(map(key, got.select("n", "surface", "entity_id", "eligible").collect())) == sorted(map(key, want))
    assert {"confirmed", "open"} == {"confirmed" if w[3] else "open" for w in want}
    assert glossary.eligibility(m.limit(0), b, e).count() == 0 and glossary.eligibility(m, b.limit(0), e).count() == 0
    bad = spark.createDataFrame([((None, None, dt.date(2024, 2, 1), dt.date(2024, 1, 1)),), (None,)], f"rule {glossary.RULE}")
    assert [r[0] for r in bad.select(glossary.rule_errors(F.col("rule"))).collect()] == ["valid_from is after valid_to", None]


def test_pinned_takes_the_last_before(spark):
    jobs = spark.createDataFrame([(1, "t", 10), (2, "t", 9), (3, None, 50), (4, "t", None), (5, "u", 5), (1, "t", 10)], "job int, tenant string, begun int")
    acts = spark.createDataFrame([("t", "a", 10), ("t", "b", 10), ("t", "z", None), (None, "n", 1), ("t", None, 9)], "tenant string, snapshot string, at int")
    got = sorted((r["job"], r["snapshot"]) for r in sessions.pinned(jobs, acts).collect())
    assert got == [(1, "b"), (1, "b"), (2, None), (3, None), (4, None), (5, None)]
