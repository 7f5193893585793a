import random
import shutil
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from lexweave.llm import decontamination, pii

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, __text string, predicted int"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice(["ma", "ter", "lo", "nic", "es", "ri", "vo", "ple"]) for _ in range(r.randint(1, 4))) for _ in range(n)).capitalize() + "."


def planted():
    """Rows, labels and items: sound texts, junk, exact and near copies, a chain of near copies, passages, personal data."""
    sound = [(i, prose(i, 60 + i % 90)) for i in range(200)]
    junk = [(1000 + i, " ".join(["BUY NOW!!!"] * (25 + i % 20))) for i in range(80)]
    copies = [(2000 + i, sound[i][1]) for i in range(10)] + [(2100 + i, sound[20 + i][1].replace(".", " again today.")) for i in range(10)]
    chain, words = [], prose(7777, 120).split()
    for i in range(6):
        words[i * 17] = words[i * 17] + f"x{i}"
        chain.append((2200 - i, " ".join(words)))
    items = [(i, prose(5000 + i, 30)) for i in range(5)]
    leaks = [(3000 + i, prose(6000 + i, 40) + " " + (t if i % 2 else t.upper().replace("A", "E", 1)) + " " + prose(6100 + i, 40)) for i, t in items]
    people = [(4000 + i, prose(8000 + i, 30) + f" write to jo{i}@mail.example.org or call +1 (269) 555-3296 today " + prose(8100 + i, 30)) for i in range(40)]
    rows = [(d, t, "en", "web", len(t), "clash", 3) for d, t in [*sound, *junk, *copies, *chain, *leaks, *people]]
    rows += [(None, prose(9001, 80), None, None, None, None, None), (None, prose(9002, 80), "en", None, 0, None, 0), rows[5], rows[5], (5, prose(9003, 70), "en", "web", 1, "x", 0)]
    labels = [(d, 1, 0) for d, _ in [*sound, *people]] + [(d, 0, 0) for d, _ in junk] + [(None, 1, 0), (3, None, 1)]
    return rows, labels, items + [(90, None), (91, "")]


def write(spark, folder, rows, labels, items):
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def first_of_each(rows):
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) for w in ((r["text"] or "").encode().lower().split() for r in rows)]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    least = {}
    for i, r in enumerate(rows):
        key = (r["doc_id"] is None, r["doc_id"] or 0)
        least[top(i)] = min(least.get(top(i), key), key)
    return Counter(least.values()), least, [least[top(i)] for i in range(len(rows))]


def test_stages_against_brute_force(spark, tmp_path):
    import sentencepiece

    rows, labels, items = planted()
    sf = write(spark, tmp_path, rows, labels, items)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = [f for _, f in corpus_pipeline.STAGES]

    kept = stages[0](spark, docs, sf)
    assert kept.columns == docs.columns
    assert Counter(map(repr, kept.collect())) == Counter(repr(r) for r in docs.collect() if r["doc_id"] is None or not 1000 <= r["doc_id"] < 2000)

    alone = stages[1](spark, kept, sf)
    assert alone.columns == docs.columns
    before, got = kept.collect(), alone.collect()
    groups, _, _ = first_of_each(before)
    assert Counter((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == groups
    assert all(r in before for r in got) and sorted(map(repr, got)) == sorted(map(repr, stages[1](spark, kept.repartition(5), sf).collect()))
    assert sum(n for n in first_of_each(got)[0].values()) == len(got)

    clean = stages[2](spark, alone, sf)
    assert clean.columns == docs.columns

    def leaks(text):
        t = b" ".join(decontamination.words_of((text or "").encode()))
        return any(decontamination.distance(p, t)[0] <= decontamination.RATE * len(p) for _, x in items if x and (p := b" ".join(decontamination.words_of(x.encode()))))

    assert sorted(map(repr, clean.collect())) == sorted(repr(r) for r in got if not leaks(r["text"]))

    masked = stages[3](spark, clean, sf)
    assert masked.columns == docs.columns
    texts = {r["text"] for r in clean.collect()}
    for r in masked.collect():
        if r["doc_id"] is not None and 4000 <= r["doc_id"] < 4040:
            assert "<EMAIL>" in r["text"] and "<PHONE>" in r["text"] and not pii.base_spans(r["text"])
        else:
            assert r["text"] in texts

    coded = stages[4](spark, masked, sf)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = Counter((r["doc_id"], tuple(library.encode(r["text"] or ""))) for r in masked.collect())
    assert Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in coded.collect()) == want
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in corpus_pipeline.run(spark, sf).collect()) == Counter((r["doc_id"], bytes(r["ids"])) for r in coded.collect())
    shutil.rmtree(tmp_path)


def test_rows_without_words_and_rows_that_share_a_doc_id_stay(spark, tmp_path):
    rows = [(5, "", "en", "s", 0, None, 0), (5, None, "en", "s", 0, None, 0), (5, prose(1, 50), "en", "s", 0, None, 0), (None, prose(2, 50), "en", "s", 0, None, 0), (None, prose(3, 50), "en", "s", 0, None, 0), (6, " \n", "en", "s", 0, None, 0), (6, " \n", "en", "s", 0, None, 0), (7, prose(4, 40_000), "en", "s", 0, None, 0)]
    twice = rows + [(8, rows[2][1], "en", "s", 0, None, 0), (5, rows[2][1], "fr", "s", 0, None, 0)]
    docs = spark.createDataFrame(twice, DOCS)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert len(kept) == len(rows) and sum(r["text"] == rows[2][1] for r in kept) == 1 and all(r["doc_id"] != 8 for r in kept)


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None, None, None)]])
def test_empty_tables_and_rows_of_nulls(spark, tmp_path, rows):
    sf = write(spark, tmp_path, rows, [], [])
    assert corpus_pipeline.run(spark, sf).count() == len(rows)
