r"""Language identification in two steps: the family of a text first, then the language within the family.

Texts become vectors of character grams: lower-cased, every run of ASCII characters that are no letters becomes one
blank, and the UTF-8 is cut into grams of one to four bytes, which fall into DIMENSIONS hash classes; a component is
the root of its class's share, so that every vector has length one whatever the text's length. Families are told apart
by one linear support vector machine each against all others, the languages of a family by one machine for each pair,
which vote; equal votes fall to the sum of margins, then to the lesser name.

FAMILIES names the family of frequent language codes; any other learned value joins the family of the language that
its mean vector is nearest to, or one of its own where no known language is learned. Machines are fitted in Spark
tasks, one for each family and pair, on at most ``sample`` rows of each language (all families together: four times
``sample``), chosen by the hash of doc_id; beyond that languages are thinned evenly. All rows are predicted.

Rows whose crc32(doc_id as text) mod 3 is 1 never train (a null doc_id counts as the empty text); nor do rows with a
null lang or a text without a letter. A null text or one without a letter is ``und`` with score 0; so is every row
where nothing is learned. Where one language is learned it is all that is predicted. Rows that repeat are predicted
each; equal texts get equal predictions. Other columns are not looked at.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

DIMENSIONS, LONGEST = 1 << 13, 4
#: Rows of a language that a machine is fitted on at most (about), and values of lang that can be learned.
SAMPLE, MOST_LANGUAGES = 1_000, 1_000
HELD_OUT, UNKNOWN = 1, "und"
#: Passes of the fit, its penalty on errors, and how steeply margins become scores.
PASSES, COST, STEEP = 12, 10.0, 2.0
#: Bytes of a text that are turned into grams at once.
CHUNK = 1 << 20
#: Families of language codes.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "celtic": "ga cy br gd",
    "turkic": "tr az kk uz ky tk tt",
    "indic": "hi bn ur mr gu pa ne",
    "iranian": "fa ku ps tg",
    "semitic": "ar he am mt",
    "malayic": "id ms jv tl",
    "sinitic": "zh yue",
    "japonic": "ja",
    "koreanic": "ko",
    "hellenic": "el",
}
_BLANKED = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_MIX = np.uint32(2654435761)
_SHIFT = np.uint32(32 - DIMENSIONS.bit_length() + 1)


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == HELD_OUT


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def vector(text: str) -> np.ndarray:
    """The unit vector of a whole text."""
    raw = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_BLANKED).split()) + b" "
    total = np.zeros(DIMENSIONS, dtype=np.int64)
    for at in range(0, len(raw), CHUNK):  # chunks overlap so that each gram lies in one
        a = np.frombuffer(raw, dtype=np.uint8, count=min(CHUNK + LONGEST - 1, len(raw) - at), offset=at).astype(np.uint32)
        gram = np.zeros(len(a), dtype=np.uint32)
        for n in range(LONGEST):
            m = min(CHUNK, len(a) - n)
            if m <= 0:
                break
            gram = (gram[:m] << np.uint32(8)) | a[n : n + m]
            total += np.bincount(((gram + np.uint32(n)) * _MIX) >> _SHIFT, minlength=DIMENSIONS)
    return np.sqrt(total / total.sum()).astype(np.float32)


def fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear machine with squared hinge loss, by coordinate ascent on its dual; y is 1 or -1.

    Both sides weigh the same in all, however many rows they have.
    """
    side = {s: max(1, int((y == s).sum())) for s in (-1, 1)}
    cost = np.array([COST * len(y) / (2 * side[int(s)]) for s in y])
    w, b, alpha = np.zeros(x.shape[1], dtype=np.float64), 0.0, np.zeros(len(y))
    square = (x.astype(np.float64) ** 2).sum(axis=1) + 1 + 1 / (2 * cost)
    order = np.random.default_rng(7)
    for _ in range(PASSES):
        for i in order.permutation(len(y)):
            gap = y[i] * (x[i] @ w + b) - 1 + alpha[i] / (2 * cost[i])
            new = max(alpha[i] - gap / square[i], 0.0)
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                b += (new - alpha[i]) * y[i]
                alpha[i] = new
    return w.astype(np.float32), float(b)


def families_of(names: list[str], means: dict[str, np.ndarray], known: dict[str, str]) -> dict[str, str]:
    """The family of each learned language."""
    out = {n: known[n] for n in names if n in known}
    for n in names:
        if n not in known:
            near = max((m for m in names if m in known), key=lambda m: (float(means[n] @ means[m]), m), default=n)
            out[n] = known.get(near, n)
    return out


def _training(docs: DataFrame, sample: int) -> DataFrame:
    """lang, r (a row's hash) and v (half precision) of the rows that train, about ``sample`` of each lang at most."""
    rows = docs.where("lang is not null and text is not null").where(~held_out()).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    counts = rows.groupBy("lang").count().limit(MOST_LANGUAGES + 1).toPandas()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"lang has more than {MOST_LANGUAGES} values")
    shares = rows.sparkSession.createDataFrame([(n, sample / c) for n, c in zip(counts["lang"], counts["count"])], "lang string, share double")
    kept = rows.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < F.col("share") * float(1 << 30))

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [(lang, h, vector(t).astype(np.float16).tobytes()) for lang, h, t in zip(*(batch.column(c).to_pylist() for c in ("lang", "r", "text"))) if has_letter(t)]
        lang, r, v = zip(*found) if found else ((), (), ())
        return pa.RecordBatch.from_pydict({"lang": pa.array(lang, pa.string()), "r": pa.array(r, pa.int64()), "v": pa.array(v, pa.binary())})

    picked = kept.select("lang", F.xxhash64("doc_id", "text").alias("r"), "text")
    return picked.mapInArrow(common.by_batch(kernel), "lang string, r bigint, v binary")


def _matrix(rows: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(rows), dtype=np.float16).reshape(len(rows), DIMENSIONS).astype(np.float32)


def trained(docs: DataFrame, sample: int = SAMPLE, families: dict[str, str] = FAMILIES) -> dict:
    """The machines: families (name to languages), of_family (name to machine) and of_pair ((less, greater) to machine).

    What comes to the driver are two vectors for each language and one for each machine.
    """
    rows = common.cut(_training(docs, sample), "language-rows")

    def mean(frame: pd.DataFrame) -> pd.DataFrame:
        m = _matrix(frame["v"]).mean(axis=0)
        return pd.DataFrame({"lang": frame["lang"][:1], "n": len(frame), "v": [(m / max(float(np.linalg.norm(m)), 1e-9)).tobytes()]})

    held = rows.groupBy("lang").applyInPandas(mean, "lang string, n bigint, v binary").toPandas()
    names, counts = sorted(held["lang"]), dict(zip(held["lang"], held["n"]))
    known = {code: f for f, codes in families.items() for code in codes.split()}
    family = families_of(names, {k: np.frombuffer(v, dtype=np.float32) for k, v in zip(held["lang"], held["v"])}, known)
    groups = {f: [n for n in names if family[n] == f] for f in sorted(set(family.values()))}
    share = {n: min(1.0, 4 * sample / len(names) / max(counts[n], 1)) for n in names}  # of a language's rows, in a family's fit
    tasks: list[tuple[str, object]] = [("of_family", f) for f in groups if len(groups) > 1] + [("of_pair", p) for g in groups.values() for p in combinations(g, 2)]
    jobs = []
    for job, (kind, key) in enumerate(tasks):
        jobs += [(job, n, 1 if family[n] == key else -1, share[n]) for n in names] if kind == "of_family" else [(job, key[0], 1, 1.0), (job, key[1], -1, 1.0)]
    out: dict = {"families": groups, "of_family": {}, "of_pair": {}}
    if not jobs:
        common.drop(rows)
        return out
    table = rows.sparkSession.createDataFrame(jobs, "job int, lang string, side int, share double")

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["lang", "r"], kind="stable")
        w, b = fit(_matrix(frame["v"]), frame["side"].to_numpy())
        return pd.DataFrame({"job": frame["job"][:1].to_numpy(), "w": [w.tobytes()], "b": [b]})

    dealt = rows.join(F.broadcast(table), "lang").where("pmod(r, 1000000) < share * 1000000")
    for job, w, b in dealt.groupBy("job").applyInPandas(one, "job int, w binary, b double").collect():
        kind, key = tasks[job]
        out[kind][key] = (np.frombuffer(w, dtype=np.float32), b)
    common.drop(rows)
    return out


def decided(margins: dict, model: dict) -> tuple[str, float]:
    """Language and score of a text by the margins of all machines; the score is that of its least sure step."""
    if not model["families"]:
        return UNKNOWN, 0.0
    family, least = next(iter(model["families"])), np.inf
    if model["of_family"]:
        ranked = sorted(((margins[("f", f)], f) for f in model["of_family"]), key=lambda x: (-x[0], x[1]))
        family, least = ranked[0][1], ranked[0][0]
    langs = model["families"][family]
    votes = dict.fromkeys(langs, 0)
    sums = dict.fromkeys(langs, 0.0)
    for pair in combinations(langs, 2):
        m = margins[pair]
        votes[pair[0] if m > 0 else pair[1]] += 1
        sums[pair[0]] += m
        sums[pair[1]] -= m
    best = min(langs, key=lambda n: (-votes[n], -sums[n], n))
    for a, b in combinations(langs, 2):
        if best in (a, b):
            least = min(least, margins[(a, b)] if best == a else -margins[(a, b)])
    return best, float(1 / (1 + np.exp(-STEEP * np.clip(least, -20, 20)))) if np.isfinite(least) else 1.0


def predicted(docs: DataFrame, sample: int = SAMPLE, families: dict[str, str] = FAMILIES) -> DataFrame:
    """doc_id, held_out, lang_pred and score (0 to 1) of each row of docs, which has doc_id, text and lang."""
    docs = docs.select("doc_id", "text", "lang")
    model = trained(docs, sample, families)
    keys = [("f", f) for f in model["of_family"]] + list(model["of_pair"])
    held = list(model["of_family"].values()) + list(model["of_pair"].values())
    weights = np.array([w for w, _ in held], dtype=np.float32).reshape(len(held), DIMENSIONS)
    bias = np.array([b for _, b in held])
    rule = {k: (list(v) if k != "families" else v) for k, v in model.items()}

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, scores = [], []
        for t in common.texts_of(batch):
            if has_letter(t):
                name, score = decided(dict(zip(keys, (weights @ vector(t) + bias).tolist())), rule)
            else:
                name, score = UNKNOWN, 0.0
            names.append(name)
            scores.append(score)
        return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())})

    kind = dict(docs.dtypes)["doc_id"]
    out = docs.select("doc_id", "text").mapInArrow(common.by_batch(kernel), f"doc_id {kind}, lang_pred string, score double")
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
