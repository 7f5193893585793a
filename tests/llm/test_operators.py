"""Each operator against brute force on small tables with nulls, empty and long texts, repeats and clashing columns."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from lexweave.llm import byte_pieces, common, components, decontamination, outliers, parity_join, pii, rule_ensemble, shingles, streaming_viterbi, suffix_tree, text_stats, token_counts, token_files, warc

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
W = re.compile(r"[^\x20\x09-\x0D]+")
rnd = random.Random(11)
VOCABULARY = ["the", "of", "Thing", "and,", "x1", "über", "😀", "a", "b", "c", "stone.", "mail@x.org", "<|endoftext|>", "line"]


def prose(n, seed):
    r = random.Random(seed)
    return "".join(r.choice(VOCABULARY) + r.choice([" ", " ", " ", "\n", "  ", "\t"]) for _ in range(n))


BASE = [prose(40, i) for i in range(12)]
NEAR = [BASE[0] + "extra words here", BASE[1].replace("stone.", "rock.", 1), BASE[2].upper()]
TEXTS = [None, "", " \n\t", "one", "one two", "one two three four five", *BASE, *NEAR, BASE[3], BASE[3], prose(4000, 99), "z" * 3000]
ROWS = [(None if i == 7 else i, t, ["en", "fr", None][i % 3], f"s{i % 2}", 0, "clash") for i, t in enumerate(TEXTS)] + [(5, TEXTS[5], "en", "s1", 0, "clash")]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, ids string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_row(df, *names):
    return sorted(map(repr, (tuple(r[n] for n in names) for r in df.collect())))


# ------------------------------------------------------------ tokens


def test_pieces_equal_the_library():
    whole = byte_pieces.BytePieces(BPE, "<u4")
    parts = ["a", "The", " ", "  ", "\n", "\t", "é", "23", "!", "'s", "<|endoftext|>", "\x1c", "　", "\xa0", "😀", "\x01", "word,", "l'", "..."]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(3000)]
    for t, ids in zip(texts, whole.totals(texts)):
        want = whole.library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, t
    for t, parts in zip(texts, token_counts.spliced(whole.library, texts, 11, 4)):
        assert sum(parts, []) == whole.library.encode(t, add_special_tokens=False).ids, t


def test_token_counts(docs, none):
    library = byte_pieces.BytePieces(BPE).library
    got = by_row(token_counts.count_tokens(docs, BPE, chunk=50, overlap=8), "doc_id", "n_bytes", "n_tokens", "over_limit")
    want = [(d, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for d, t, *_ in ROWS]
    assert got == sorted(map(repr, want))
    assert token_counts.count_tokens(none, BPE).count() == 0
    ordinary = [t for t in TEXTS if t and 200 < len(t) < 2000]
    assert ordinary and all(len(parts) > 1 for parts in token_counts.spliced(library, ordinary, 50, 8))


def test_texts_without_blanks_are_counted_in_linear_time():
    library = token_counts._library(BPE)
    made = random.Random(5)
    solid = "".join(made.choice("abcdefghij漢字カナ") for _ in range(40_000))
    mixed = " ".join("".join(made.choice("xyz語") for _ in range(n)) for n in (3, 9000, 5, 1, 4500, 2, 2, 30_000, 7))
    for t in (solid, mixed, solid + " tail of words " * 400, "word " * 900 + solid, "\n".join([solid[:5000]] * 4), " " * 9000 + "a", "a" + "\t" * 9000):
        (parts,) = token_counts.spliced(library, [t])
        assert [i for part in parts for i in part] == library.encode(t, add_special_tokens=False).ids
    read = []

    class Counting:
        def encode_batch(self, texts, **kw):
            read.extend(map(len, texts))
            return library.encode_batch(texts, **kw)

        def encode(self, text, **kw):
            read.append(len(text))
            return library.encode(text, **kw)

    for n in (100_000, 400_000):
        read.clear()
        token_counts.counted(Counting(), ["ab7" * (n // 3)])
        assert sum(read) <= 4 * n


def test_elias_fano():
    for values in ([], [0], [7], [0, 0, 0], [1, 2, 3, 10**12], sorted(rnd.randrange(10**9) for _ in range(3000))):
        e = token_files.EliasFano.of(np.array(values, dtype=np.uint64))
        back, _ = token_files.EliasFano.from_buffer(memoryview(e.to_bytes()), 0)
        assert back.between(0, len(values)).tolist() == values and [back.select(i) for i in range(len(values))] == values
        for _ in range(20):
            a, b = sorted(rnd.randint(0, len(values)) for _ in range(2))
            assert back.between(a, b).tolist() == values[a:b]


def test_token_files(spark, docs, none):
    folder = common.scratch(spark, "t")
    token_files.write_token_files(docs, BPE, folder, shard_bytes=2000)
    assert len(common.read_manifest(folder)["files"]) > 1
    got = sorted(token_files.read_token_files(spark, folder).collect(), key=lambda r: r["start"])
    library = byte_pieces.BytePieces(BPE).library
    want = sorted(((d is not None, d or 0, np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes()) for d, t, *_ in ROWS))
    assert [r["doc_id"] for r in got] == [d if known else None for known, d, _ in want]
    assert [bytes(r["ids"]) for r in got] == [w[2] for w in want]
    assert [r["start"] for r in got] == [sum(len(w[2]) // 4 for w in want[:i]) for i in range(len(want))]
    files, path = common.opened(f"{folder}/{common.read_manifest(folder)['files'][-1]['name']}")
    held = token_files.TokenFile(files.open_input_stream(path).read())
    assert held.document(held.docs - 1).astype("<u4").tobytes() == want[-1][2]
    again = common.scratch(spark, "t")
    token_files.write_token_files(docs.repartition(5), BPE, again, shard_bytes=2000)
    for f in common.read_manifest(folder)["files"]:
        assert files.open_input_stream(common.opened(f"{folder}/{f['name']}")[1]).read() == files.open_input_stream(common.opened(f"{again}/{f['name']}")[1]).read()
    empty = common.scratch(spark, "t")
    token_files.write_token_files(none, BPE, empty)
    assert token_files.read_token_files(spark, empty).count() == 0


def test_streaming_viterbi(docs, none):
    import sentencepiece

    library, model = sentencepiece.SentencePieceProcessor(model_file=PIECES), streaming_viterbi.Pieces(PIECES)
    parts = ["a", "the", "ing", " ", "  ", "\n", "\t", "é", "23", "<s>", "<0x41>", "\x01", "▁", "　", "😀", "aaaa", "ththth", "x" * 20]
    for t in ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60))) for _ in range(1500)] + ["".join(BASE).replace(" ", "")]:
        ids = np.frombuffer(model.encode(t), "<u4").tolist()
        assert ids == library.encode(t), t
        assert model.decode(np.array(ids, dtype=int)) == library.decode(ids)
    text = "".join(BASE)  # ordinary texts are committed while they run, but for their last characters
    codes = np.array([ord(c) for c in "▁" + text.replace(" ", "▁")])
    ends, ids, late, early = model.lanes(model.classes[codes], np.array([0]), np.array([len(codes)]))
    assert not len(late) and 0.9 * len(ids) < early < len(ids) and (np.diff(np.sort(ends)) <= model.longest).all()
    # with a window too small for most of the paths, stretches go the way of the growing window
    few = model.lanes(model.classes[codes], np.array([0]), np.array([len(codes)]), window=model.longest + 20)
    assert list(few[2]) == [0] and not len(few[1])
    coded = streaming_viterbi.encode(docs, PIECES)
    again = {r["doc_id"]: r["restored"] for r in streaming_viterbi.encode(docs, PIECES, ("doc_id", "lang"), restored=True).collect()}
    assert all(again.values())
    assert by_row(streaming_viterbi.decode(coded, PIECES), "doc_id", "text") == sorted(map(repr, ((d, t or "") for d, t, *_ in ROWS)))
    assert streaming_viterbi.encode(none, PIECES).count() == 0


# ------------------------------------------------------------ statistics and rules


def brute_stats(t):
    w = W.findall(t)
    often = Counter(zip(w, w[1:], w[2:]))
    inside = {i + k for i in range(len(w) - 2) if often[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
    seen, again = set(), 0
    for line in t.split("\n"):
        if W.search(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), again, len(inside)


def test_outliers(spark, docs, none):
    got = by_row(outliers.rejected(docs, least=8), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = []
    for d, t, *_ in ROWS:
        s = brute_stats(t or "")
        want.append((d, *s, s[0] < 50 or 100 * s[4] > 50 * s[0]))
    assert got == sorted(map(repr, want))
    assert outliers.rejected(none).count() == 0
    junk = [(i, " ".join(random.Random(i).choice(["word", "other", "thing", "some", "much"]) + str(random.Random(i * 99 + k).randrange(999)) for k in range(120)), "en", "s") for i in range(300)]
    junk += [(1000, " ".join(f"w{i}$$$%%%" for i in range(120)), "en", "s"), (1001, " ".join(f"WORD{i}!!!" for i in range(120)), "en", "s")]
    verdict = {r["doc_id"]: r["kept"] for r in outliers.rejected(spark.createDataFrame(junk, "doc_id bigint, text string, lang string, source string")).collect()}
    assert [d for d, k in verdict.items() if not k] == [1000, 1001]


def test_mcd_ignores_a_quarter_of_outliers(spark):
    rows = [("g", *np.random.default_rng(i).normal(0 if i % 5 else 50, 1, outliers.P).tolist()) for i in range(500)]
    mean, white = outliers.fit(spark.createDataFrame(rows, "g string, " + ", ".join(f"x{i} double" for i in range(outliers.P))))["g"]
    assert np.abs(mean).max() < 0.5
    assert math.isclose(outliers.chi2_cdf(outliers.chi2_quantile(0.975, 8), 8), 0.975, abs_tol=1e-9)


def test_rule_ensemble(spark, docs, none):
    good = [(i, " ".join(random.Random(i).choice(["word", "other", "thing"]) + str(k) for k in range(80)), 1) for i in range(400)]
    bad = [(1000 + i, " ".join("SPAM!!" for _ in range(40 + i % 30)), 0) for i in range(200)]
    both = spark.createDataFrame([r[:2] for r in good + bad], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2], None) for r in good + bad] + [(3, None, 1), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    got = rule_ensemble.scored(both, labels).collect()
    truth = {r[0]: r[2] for r in good + bad}
    assert all(r["predicted"] == truth[r["doc_id"]] and 0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    # without labels, and on texts that are null or empty
    free = rule_ensemble.scored(docs, labels.where("false")).collect()
    assert len(free) == len(ROWS) and all(r["predicted"] == 1 for r in free)
    assert rule_ensemble.scored(none, labels).count() == 0


# ------------------------------------------------------------ archives and personal data


def test_warc(spark):
    pages = [(i, f"http://x/{i}", h) for i, h in enumerate(["<a>", None, "<b>é", "<a>", "", "<a>", "long" * 5000])] + [(3, "http://x/3", "<a>"), (None, None, "<b>é"), (9, "http://\r\nWARC-Type: x/", "tail")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    folders = [common.scratch(spark, "w") for _ in range(2)]
    for n, folder in zip((1, 4), folders):
        warc.write(df.repartition(n), folder, shard_bytes=4000, roll_bytes=1500)
    a, b = (common.read_manifest(f)["files"] for f in folders)
    assert a == b and len(a) > 1
    files, _ = common.opened(folders[0])
    for f in a:
        assert files.open_input_stream(common.opened(f"{folders[0]}/{f['name']}")[1], compression=None).read() == files.open_input_stream(common.opened(f"{folders[1]}/{f['name']}")[1], compression=None).read()
    got = warc.read(spark, folders[0]).collect()
    assert len(got) == len(pages)
    for r in got:
        same = [p for p, _, h in pages if (h or "") == next(h or "" for p, _, h in pages if base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode() == r["payload_digest"])]
        best = max(p for p in same if p is not None)
        assert (r["refers_to"] == best) if r["record_type"] == "revisit" else (r["page_id"] == best and r["refers_to"] is None)
    assert Counter(r["record_type"] for r in got if r["page_id"] == 3) == {"revisit": 2}
    small = common.scratch(spark, "w")
    warc.write(df, small, least=100)
    assert all(r["record_type"] == "response" for r in warc.read(spark, small).collect())
    empty = common.scratch(spark, "w")
    warc.write(df.where("false"), empty)
    assert warc.read(spark, empty).count() == 0
    for page in (None, 0, 5, -3, (1 << 63) - 1, -(1 << 63)):
        assert warc.page_of(warc.record_id(page, b"\xff" * 20, 70_000)) == page


def brute_spans(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        s = re.sub("[^0-9]", "", m.group())
        if 13 <= len(s) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(s[::-1])) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


def test_pii(spark, docs, none):
    parts = ["a", "1", "23", "@", ".", "-", "+", " ", "(", ")", "255", "256", "a@b.c", "4532015112830366", "é", "0000000000000000000000001"]
    for _ in range(5000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25)))
        assert pii.base_spans(t) == brute_spans(t), t
    assert pii.base_spans("9" * 100_000 + "." + "a" * 100_000) == [] and pii.base_spans("1." * 3 + "9" * 6000) == []
    rows = [(i, f"please use password={hashlib.md5(str(i).encode()).hexdigest()[:18]} and mail bob{i}@mail.example.com or +1 (269) 555-3296 now", 0) for i in range(60)] + [(99, "nothing to see at version 1.2.3", 7), (100, None, 3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint")
    found = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in pii.detect(df).collect()}
    assert found[0] == ["email", "phone", "secret"] and found[99] == [] and found[100] == []
    masked = {r["doc_id"]: r for r in pii.redact(df).collect()}
    assert masked[0]["text"] == "please use password=<SECRET> and mail <EMAIL> or <PHONE> now" and masked[0]["n_chars"] == len(masked[0]["text"])
    assert masked[99]["text"] == rows[60][1] and masked[100]["text"] is None
    assert pii.detect(none).count() == 0 and pii.detect(docs).count() == len(ROWS)


def test_further_spans_equal_pairwise_comparison_and_stay_linear():
    made = random.Random(9)
    bits = ["token=abcdefgh12345", "DE44 5001 0517 5407 3249 31", "123-45-6789", "joe [at] example [dot] org", "a.b@c.org", "+44 20 7946 0958", "secret: joe(at)site.com", "4111 1111 1111 1111", "10.0.0.1", " ", "x"]
    for _ in range(300):
        t = "".join(made.choice(bits) + made.choice(["", " ", ",", "-"]) for _ in range(made.randint(0, 12)))
        base, every, out = pii.base_spans(t), pii.further_spans(t, []), []
        assert all(b <= c or d <= a for i, (_, a, b) in enumerate(every) for _, c, d in every[:i])
        secrets = [("secret", m.start(1) if m.group(1) else m.start(), m.end(1) if m.group(1) else m.end()) for m in pii._SECRET.finditer(t)]
        loose = [(kind, m.start(), m.end()) for kind, pattern in (("iban", pii._IBAN), ("ssn", pii._SSN), ("contact", pii._CONTACT)) for m in pattern.finditer(t)]
        for kind, a, b in secrets + loose:
            if all(b <= c or d <= a for _, c, d in base + out):
                out.append((kind, a, b))
        assert pii.further_spans(t, base) == sorted(out, key=lambda s: (pii.KINDS.index(s[0]), s[1])), t
    many = "123-45-6789 10.1.2.3 " * 50_000
    base = pii.base_spans(many)
    assert len(base) == 50_000 and len(pii.further_spans(many, base)) == 50_000


def test_secrets_are_whole_and_found_in_any_case():
    long = "".join("aB3x"[i % 4] for i in range(240))
    assert pii.further_spans(f'token="{long}" end', []) == [("secret", 7, 247)]
    for word in ("PWD", "Pwd", "pwd", "pAsSwd", "Token", "SeCret", "api-kEY", "ACCEſSKEY", "apiKey", "PAſS"):
        t = f"DB {word}=Xy7kQ93bLm2"
        assert pii.further_spans(t, []) == [("secret", m.start(1), m.end(1)) for m in pii._SECRET.finditer(t)], t
    assert pii.further_spans("DB PWD=Xy7kQ93bLm2", []) == [("secret", 7, 18)]


# ------------------------------------------------------------ language model, near duplicates, benchmark


def test_suffix_tree(docs, none):
    tokens = [((t or "").encode().lower().split() + [None], zlib.crc32(b"" if d is None else str(d).encode()) % 5 == 1, d) for d, t, *_ in ROWS]
    c = Counter(w for t, out, _ in tokens if not out for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted(repr((d, out, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 6))) for t, out, d in tokens)
    got = suffix_tree.scored(docs).collect()
    assert sorted(repr((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6))) for r in got) == want
    assert all(r["score"] < 0 for r in got) and suffix_tree.scored(none).count() == 0


def test_suffix_tree_scores_equal_brute_force(spark):
    """The model worked out anew over dictionaries: classes, contexts of none, one and two symbols, tests, smoothing."""
    r = random.Random(8)
    often = [f"w{i}" for i in range(12)]
    texts = [" ".join(r.choice(["the same start of it", r.choice(often) + " " + r.choice(often), f"rare{r.randrange(60)}", "Then w1 w2 w3"]) for _ in range(r.randint(0, 25))) for _ in range(150)]
    rows = [*enumerate(texts), (None, "the same start"), (9, None), (9, texts[9])]
    words = [suffix_tree.hashes((t or "").encode()).tolist() for _, t in rows]
    train = [not suffix_tree.held_out(d) for d, _ in rows]
    n = Counter(w for t, own in zip(words, train) if own for w in t)
    klass = {w: int(suffix_tree.rare_class(np.array([w], dtype=np.uint64))[0]) for t in words for w in t}
    sums, kinds = Counter(), Counter()
    for w, c in n.items():
        if c < suffix_tree.OFTEN:
            sums[klass[w]] += c
            kinds[klass[w]] += 1
    mass = lambda w: n[w] + 0.5 if n[w] >= suffix_tree.OFTEN else sums[klass[w]] + 0.5 * (kinds[klass[w]] + 1)
    z = sum(n.values()) + 0.5 * (len(n) + suffix_tree.RARE)
    symbol = lambda w: ("word", w) if n[w] >= suffix_tree.OFTEN else ("class", klass[w])
    places = []
    for t, own in zip(words, train):
        s = ["begin", "begin", *map(symbol, t)]
        places.append([((s[i + 1], s[i]), s[i + 2], w, own) for i, w in enumerate(t)])
    root = {symbol(w): mass(w) / z for t in words for w in t}
    tables = [Counter(), Counter()]
    for (c1, c2), s, _, own in (x for p in places for x in p):
        tables[0][(c1,), s] += own
        tables[1][(c1, c2), s] += own

    def state(context, table, below):
        seen = {s: c for (x, s), c in table.items() if x == context}
        total, best, k = sum(seen.values()), suffix_tree.GAIN, 0.0
        for strength in suffix_tree.STRENGTHS:
            gain = sum(c * math.log((c - 1 + strength * below(s)) / (total - 1 + strength) / below(s)) for s, c in seen.items() if c)
            if gain > best:
                best, k = gain, strength
        return lambda s: (seen.get(s, 0) + k * below(s)) / (total + k) if k else below(s)

    one = {c: state(c, tables[0], root.__getitem__) for c in {x for x, _ in tables[0]}}
    two = {c: state(c, tables[1], one[c[:1]]) for c in {x for x, _ in tables[1]}}
    want = sorted(repr((d, round(sum(math.log10(two[c](s)) + (0 if n[w] >= suffix_tree.OFTEN else math.log10((n[w] + 0.5) / mass(w))) for c, s, w, _ in p), 6))) for (d, _), p in zip(rows, places))
    got = suffix_tree.scored(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert sorted(repr((x["doc_id"], round(x["score"], 6))) for x in got) == want


def test_suffix_tree_keeps_all_frequent_words(spark):
    # 60,000 words of 17 occurrences, and 20,000 pairs of words of 16, the second one told by the first
    words, pairs, rows = [f"w{i}" for i in range(60_000)], [f"x{i} y{i}" for i in range(20_000)], []
    for turn in range(17):
        for own in (words, pairs)[: 1 + (turn < 16)]:
            random.Random(turn).shuffle(own)
            rows += [" ".join(own[i : i + 500]) for i in range(0, len(own), 500)]
    ids = [i for i in range(3 * len(rows)) if not suffix_tree.held_out(i)][: len(rows)]
    held = next(i for i in range(10**6) if suffix_tree.held_out(i))
    random.Random(99).shuffle(pairs)
    df = spark.createDataFrame([*zip(ids, rows), (held, " ".join(pairs[:500]))], "doc_id bigint, text string").repartition(4)
    (score,) = (r["score"] for r in suffix_tree.scored(df).collect() if r["doc_id"] == held)
    # the first word of a pair is one of 100,000, the second one is nearly sure
    assert score / 500 > -5.6


def test_suffix_tree_packs_symbols_as_gaps(spark):
    for values in ([], [0], [5, 5, 9, 2**32 - 1], sorted(rnd.randrange(2**32) for _ in range(500))):
        x = np.array(values, dtype=np.uint64)
        for kind in ("<u4", "<u8"):
            assert suffix_tree._sums(suffix_tree._gaps(x, kind), kind).tolist() == values
        assert suffix_tree._walked(suffix_tree._steps(x[::-1])).tolist() == values[::-1]
    wide = np.sort(np.array([0, 1, 2**63 + 5, 2**64 - 1], dtype=np.uint64))
    assert suffix_tree._sums(suffix_tree._gaps(wide, "<u8"), "<u8").tolist() == wide.tolist()
    # many words, of which each block has a part: symbols and counts of the blocks are most of what positions take
    r = random.Random(6)
    rows = [(i, " ".join(f"w{int(40_000 * r.random() ** 2)}" for _ in range(100))) for i in range(8000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    coded = common.cut(suffix_tree._coded(df, 8), "coded")
    answered = common.cut(suffix_tree._answered(coded, 8), "symbols")
    held = spark.sparkContext.broadcast(suffix_tree.Totals([x["block"] for x in answered.where("kind = 2").collect()]))
    sent = suffix_tree._positions(coded, answered, held, 8).where("kind = 1").selectExpr("sum(octet_length(block))").first()[0]
    assert sent < 6.5 * 800_000  # bytes a word


def test_states_are_distributions():
    root = np.array([0.4, 0.3, 0.2, 0.1])
    c1, c2, w = (np.array(x) for x in zip(*[(a, b, s) for a in (0, 1) for b in (0, 1) for s in range(4) for _ in range(1 + 30 * (s == a))]))
    p = suffix_tree.subtree(c1, c2, w, np.ones(len(w), dtype=int), root)
    for a in (0, 1):
        for b in (0, 1):
            own = {s: p[(c1 == a) & (c2 == b) & (w == s)][0] for s in range(4)}
            assert math.isclose(sum(own.values()), 1.0) and own[a] > root[a]


def test_parity_join_equals_brute_force(spark, docs, none):
    near = []
    for g in range(30):
        words = [f"w{g}x{i}" for i in range(rnd.randint(6, 90))]
        for _ in range(rnd.randint(1, 6)):
            own = list(words)
            for _ in range(rnd.randint(0, 4)):
                own[rnd.randrange(len(own))] = f"e{rnd.random()}"
            near.append(" ".join(own))
    passage = " ".join(f"shared{i}" for i in range(40))
    near += [passage + " " + " ".join(f"q{k}r{i}" for i in range(rnd.randint(5, 60))) for k in range(60)]
    # near copies under no doc_id, and two texts under one
    changed = " ".join(near[-1].split()[:-1] + ["other"])
    rows = [(i, t) for i, t in enumerate([*TEXTS, *near])] + [(None, near[0]), (3, "one"), (None, changed), (None, changed), (5, changed + " tail")]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := (t or "").encode().lower().split()) else frozenset() for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    want = sorted(repr((d, len(s), least.get(find(i)))) for i, ((d, _), s) in enumerate(zip(rows, sets)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert by_row(parity_join.grouped(df.repartition(3)), "doc_id", "n_shingles", "component_id") == want
    block, parity_join.BLOCK = parity_join.BLOCK, 3  # groups of several chunks
    try:
        assert by_row(parity_join.grouped(df), "doc_id", "n_shingles", "component_id") == want
    finally:
        parity_join.BLOCK = block
    assert parity_join.grouped(none).count() == 0


def test_parity_join_compares_a_large_family_once(spark, monkeypatch):
    """Near copies share hundreds of groups; after the first round each pair is looked at in a few cells alone."""
    r = random.Random(5)
    texts = []
    for _ in range(400):
        own = [f"w{i}" for i in range(90)]
        for _ in range(r.randint(0, 3)):
            own[r.randrange(len(own))] = f"e{r.random()}"
        texts.append(" ".join(own))
    texts += ["shared one two three four five six seven " + " ".join(f"q{k}r{i}" for i in range(30)) for k in range(40)]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in map(str.split, texts)]
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                up[max(find(i), find(j))] = min(find(i), find(j))
    want = sorted(repr((i, find(i))) for i in range(len(texts)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    counts, candidates = [], parity_join._candidates

    def counted(members, nodes):
        counts.append(members.count())
        return candidates(members, nodes)

    monkeypatch.setattr(parity_join, "_candidates", counted)
    assert by_row(parity_join.grouped(df), "doc_id", "component_id") == want
    assert counts[1] < 6 * len(texts)
    # groups that count as large and cells that are many
    monkeypatch.setattr(parity_join, "LARGE", 4)
    monkeypatch.setattr(parity_join, "CELL", 20)
    assert by_row(parity_join.grouped(df), "doc_id", "component_id") == want


def rows_of_joins(spark, run):
    """Rows that all joins of run() made, by Spark's own counts, and what it returned."""
    store = spark._jsparkSession.sharedState().statusStore()
    before, out, made = store.executionsCount(), run(), 0
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    executions = store.executionsList()
    for i in range(before, executions.size()):
        number = executions.apply(i).executionId()
        held, nodes = store.executionMetrics(number), store.planGraph(number).allNodes()
        for node in map(nodes.apply, range(nodes.size())):
            for metric in map(node.metrics().apply, range(node.metrics().size())):
                if "Join" in node.name() and metric.name() == "number of output rows" and held.contains(metric.accumulatorId()):
                    made += int(held.apply(metric.accumulatorId()).replace(",", ""))
    return made, out


def test_components_equal_brute_force(spark):
    r = random.Random(3)
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000 + i, 2000) for i in range(50)]  # its middle is the greatest
    mixed = [(3000 + r.randrange(120), 3000 + r.randrange(120)) for _ in range(90)] + [(-5, 3000), (7, 7)]
    links = chain + star + mixed + [(b, a) for a, b in mixed[:20]]
    up = {x: x for p in links for x in p if p[0] != p[1]}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        if a != b:
            up[max(find(a), find(b))] = min(find(a), find(b))
    got = components.components(spark.createDataFrame(links, "a bigint, b bigint").repartition(3))
    assert sorted((x["node"], x["comp"]) for x in got.collect()) == sorted((x, find(x)) for x in up)
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_components_read_links_once(spark):
    """Links within what is joined already are not read again in each round."""
    r = random.Random(4)
    links = [(n, int(300 * r.random() ** 3)) for n in range(300, 1500) for _ in range(20)] + [(n, n + 1) for n in range(5000, 5060)]
    df = common.cut(spark.createDataFrame(links, "a bigint, b bigint"), "links")
    made, got = rows_of_joins(spark, lambda: components.components(df))
    assert {x["comp"] for x in got.collect()} == {0, 5000}
    assert made < 3 * len(set(links))


def test_sketch_distance_is_a_lower_bound():
    for _ in range(300):
        a, b = ({rnd.randrange(90) for _ in range(rnd.randint(1, 80))} for _ in range(2))
        x, y = parity_join.folded([parity_join.sketch(shingles.mixed(np.array(sorted(s), dtype=np.uint64))) for s in (a, b)])
        assert np.bitwise_count(x ^ y).sum() <= len(a ^ b)


def test_forest_joins_all_that_sketches_allow():
    for turn in range(40):
        base = [rnd.randrange(10**9) for _ in range(60)]
        sets = [sorted({x if rnd.random() > 0.08 else rnd.randrange(10**9) for x in base}) for _ in range(20)]
        bits = parity_join.folded([parity_join.sketch(shingles.mixed(np.array(x, dtype=np.uint64))) for x in sets])
        n, node = np.array(list(map(len, sets))), np.arange(20)
        near = {(i, j) for i in range(20) for j in range(i) if 9 * np.bitwise_count(bits[i] ^ bits[j]).sum() <= n[i] + n[j] and parity_join.links(int(min(n[i], n[j])), int(max(n[i], n[j])), int(min(n[i], n[j])))}
        gone = {p for p in near if rnd.random() < 0.3}
        failed = [np.array([b if a == i else a for a, b in gone if i in (a, b)]) for i in range(20)]
        comp = node // 2 if turn % 2 else node

        def classes(pairs):
            up = comp.copy()
            for a, b in pairs:
                up[up == up[a]] = up[b]
            return [int(np.flatnonzero(up == x)[0]) for x in up]

        found = parity_join.forest(node, comp, n, bits, failed)
        assert classes(found) == classes(near - gone) and set(found) <= {(min(p), max(p)) for p in near}
        parity_join.SURE, sure = 1e9, parity_join.SURE  # all pairs taken to link: a forest
        found = parity_join.forest(node, comp, n, bits, failed)
        parity_join.SURE = sure
        assert classes(found) == classes(near - gone) and len(found) < len(set(comp))


def test_decontamination(spark, none):
    items = [(i, " ".join(random.Random(i).choice(["alpha", "winter", "meadow", "carrying", "lantern", "of", "the"]) + ("" if k % 3 else str(random.Random(i * 77 + k).randrange(5000))) for k in range(30))) for i in range(40)]
    for _ in range(200):
        p, t = (bytes(rnd.choice(b"ab ") for _ in range(rnd.randint(1, 14))) for _ in range(2))
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            row, last = [i], row
            for j, d in enumerate(t, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d)))
        assert decontamination.distance(p, t)[0] == min(row)
    docs, want = [(1000, None), (1001, ""), (1002, "clean words alone " * 50), (1003, "TOO, short!"), (1004, "too short but more"), (1005, "lead " * 30_000 + items[3][1])], {(1003, 78), (1006, 80)}
    for i, t in items:
        docs.append((i, "lead in words here " + (t.upper() if i % 2 else t) + " and a tail of words"))
    for d, t in docs:
        text = b" ".join(decontamination.words_of((t or "").encode()))
        want |= {(d, i) for i, item in items if decontamination.distance(item.encode(), text)[0] <= decontamination.RATE * len(item)}
    assert {(i, i) for i, _ in items} <= want
    long = " ".join(f"part{i * i}" for i in range(9000))
    df = spark.createDataFrame([(*d, "x") for d in docs] + [(1006, "so " + long, "x"), (1006, "so " + long, "x")], "doc_id bigint, text string, item_id string")
    bench = spark.createDataFrame([*items, (77, None), (78, "too short"), (79, ""), (80, long)], "item_id bigint, text string")
    rows = decontamination.hits(df, bench).collect()
    got = {(r["doc_id"], r["item_id"]) for r in rows}
    assert got == want and len(rows) == len(want) + 1
    assert sorted(r["doc_id"] for r in decontamination.clean(df, bench).collect()) == [1000, 1001, 1002, 1004]
    assert decontamination.hits(none, bench).count() == 0 and decontamination.hits(df, bench.where("false")).count() == 0


def test_decontamination_recall_at_every_rate(spark):
    """Of all items within RATE of a place in a text, by exact distance to the whole text, at least nine tenths are found."""
    syllables = ["ca", "mor", "li", "te", "an", "der", "so", "pu", "ge", "win", "ta", "re"]
    rows = [(i, " ".join("".join(random.Random(i * 999 + k * 31 + j).choice(syllables) for j in range(1 + (i + k) % 4)) for k in range(12 + i % 40)).encode()) for i in range(150)]
    block = decontamination.Items(rows)
    r = random.Random(5)

    def edited(text, rate):
        s = list(text.decode())
        for _ in range(int(rate * len(s))):
            at, kind = r.randrange(len(s)), r.randrange(3)
            s[at : at + (kind != 1)] = [r.choice("abcdefgh ")] if kind else []
        return "".join(s).encode()

    def spoilt(text):
        return b" ".join(w[: len(w) // 2] + b"q" + w[len(w) // 2 + 1 :] if len(w) >= 6 else w for w in text.split())

    for change in [*[lambda t, x=x: edited(t, x) for x in (0, 0.05, 0.1, 0.12, 0.14)], spoilt]:
        texts = [b"words that lead in " + change(t) + b" and some that follow" for _, t in rows]
        near = {(d, d) for d, t in enumerate(texts) if decontamination.distance(block.texts[d], b" ".join(decontamination.words_of(t)))[0] <= decontamination.RATE * len(block.texts[d])}
        got = {h[:2] for h in block.hits(texts, decontamination.RATE)}
        assert len(near) > 100 and len(near & got) >= 0.9 * len(near), len(near & got) / len(near)


def test_text_stats_of_long_and_empty_texts():
    assert text_stats.of("", b"")[:3] == (0, 0, 0)
    t = "a b c " * 3000
    assert text_stats.of(t, t.encode())[6] == brute_stats(t)[4] == 9000
