"""Exact matching under normalization profiles: channels with index maps, gaps, boundaries, proposals.

A channel is a text folded under a profile with the place of each kept character. Keys are found in the channel and
mapped back, so that offsets are the composed text's. Native but for the scan for a dictionary that fits a broadcast and
the tails of proposals.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from ..functions import hangul as H
from ..functions import morphology as M
from ..functions import segmentation as S
from ..functions import text as T
from ..functions.batches import parts
from . import matching

# Characters skipped in a row inside a match, and what each costs.
MOST_GAP, GAP_COST = 2, 0.05
#: Characters before and after a match that rules look at: more than the longest prefix and particle with what parts them.
LEFT, RIGHT = 8, 40
_GONE = 0xFFFFFFFF


def _before(text: Column, start: Column) -> Column:
    """The last characters before a place: rules that read all of a text before each match cost its length for each."""
    return F.substring(text, F.greatest(start - (LEFT - 1), F.lit(1)), F.least(start, F.lit(LEFT)))


def channel(c: Column, profile: str) -> Column:
    """(folded, at): the text under a profile and the 0-based place of each of its characters. c: composed, not null."""
    case, dropped, space, ocr = T.PROFILES[profile]
    gone = T.ZERO_WIDTH + dropped
    each = F.transform(F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0)), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    some = F.transform(F.filter(each, lambda e: ~F.contains(F.lit(gone), e["x"]) & (~e["x"].rlike(r"\s") if space else F.lit(True))), lambda e: e["i"])
    folded = T.drop_space(T.drop_chars(c, gone)) if space else T.drop_chars(c, gone)
    folded = T.fold_width(folded)
    folded = T.fold_case(folded) if case else folded
    return F.struct((T.fold_ocr(folded) if ocr else folded).alias("folded"), some.alias("at"))


class _Fold:
    """A profile as a table of characters: what they become, or nothing."""

    def __init__(self, profile: str) -> None:
        case, dropped, space, ocr = T.PROFILES[profile]
        self.gone = frozenset(T.ZERO_WIDTH + dropped + (" \t\n\v\f\r" if space else ""))
        steps = [dict(zip(T.WIDE, T.NARROW))] + ([dict(zip(T.UPPER, T.LOWER))] if case else []) + ([{c: g[0] for g in T.OCR_GROUPS for c in g}] if ocr else [])
        self.table: dict[int, str] = {}
        for c in {c for step in steps for c in step}:
            to = c
            for step in steps:
                to = step.get(to, to)
            self.table[ord(c)] = to
        self.table |= dict.fromkeys(map(ord, self.gone), "")
        self.points = np.arange(0x110000, dtype=np.uint32)
        for c, to in self.table.items():
            self.points[c] = ord(to) if to else _GONE

    def read(self, text: str) -> tuple[str, np.ndarray]:
        """The folded text and which characters are kept: all of them at once, as a table of characters takes ten times as long."""
        folded = self.points[np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)]
        kept = folded != _GONE
        return folded[kept].tobytes().decode("utf-32-le"), kept


def _scanned(docs: DataFrame, keys: DataFrame, profiles: list[str]) -> DataFrame:
    """Composes, folds and reads each text in one kernel; places are mapped back only where something was found."""
    held = docs.sparkSession.sparkContext.broadcast({p: keys.where(F.col("profile") == p).select("n", "key").collect() for p in profiles})
    out = StructType([*docs.select("doc_id").schema, StructField("text", StringType()), StructField("found", ArrayType(StructType([StructField("n", IntegerType()), StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("cost", DoubleType())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        folds = []
        for profile, rows in held.value.items():
            trie, at = ahocorasick.Automaton(), {}
            for n, key in rows:
                at.setdefault(key, []).append(n)
            for key, of in at.items():
                trie.add_word(key, (len(key), of))
            if at:
                trie.make_automaton()
                folds.append((_Fold(profile), trie))
        for batch in parts(batches):
            texts, lists = [], []
            for t in batch.column("text").to_pylist():
                t, own = unicodedata.normalize("NFC", t), []
                for fold, trie in folds:
                    folded, kept = fold.read(t)
                    hits = list(trie.iter(folded))
                    places = np.flatnonzero(kept) if hits else None
                    for last, (size, of) in hits:
                        at = places[last + 1 - size : last + 1].tolist()
                        gaps = [y - x - 1 for x, y in zip(at, at[1:])]
                        if not gaps or max(gaps) <= MOST_GAP:
                            own += [{"n": n, "start": at[0], "end": at[-1] + 1, "cost": round(sum(gaps) * GAP_COST, 9)} for n in of]
                texts.append(t if own else None)
                lists.append(own)
            kept = pa.array([i for i, x in enumerate(lists) if x], pa.int32())
            names = [batch.column("doc_id").take(kept), pa.array(texts, pa.string()).take(kept), pa.array([x for x in lists if x], pa.list_(pa.struct([("n", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("cost", pa.float64())])))]
            yield pa.RecordBatch.from_arrays(names, names=["doc_id", "text", "found"])

    return docs.select("doc_id", "text").mapInArrow(run, out).select("doc_id", "text", F.inline("found"))


def profile_matches(docs: DataFrame, bindings: DataFrame, most: int = 4 << 20) -> DataFrame:
    """doc_id, text (composed), item_id, profile, surface, entity_id, start, end and cost of every place where a key
    matches, overlapping ones too; one scan of the texts for all profiles.

    docs: doc_id, text; bindings: item_id, entity_id, surface, profile. A text is composed once and read under each profile
    that has bindings. Keys of ``most`` bytes in all are broadcast as automata, one for each profile; more of them meet the
    folded texts by joins, with equal rows. Nothing is joined by doc_id: rows that share one, or have none, stay apart. More
    than MOST_GAP characters skipped in a row void a match.
    """
    keyed = None
    for p in T.PROFILES:  # six
        own = bindings.where(F.col("profile") == p).select("item_id", "profile", "surface", "entity_id", T.alias_key(F.col("surface"), p).alias("key"))
        keyed = own if keyed is None else keyed.union(own)
    keyed = keyed.where("key != ''").distinct()
    size = keyed.groupBy("profile").agg(F.sum(F.octet_length("key")).alias("n")).collect()  # six rows
    profiles = [p for p in T.PROFILES if p in {r["profile"] for r in size}]
    given = docs.where("text is not null")
    if sum(r["n"] for r in size) <= most:
        # numbered on the driver, as they go out from there
        rows = sorted(keyed.collect(), key=repr)
        numbered = docs.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(rows)], StructType([StructField("n", IntegerType()), *keyed.schema]))
        found = _scanned(given, numbered, profiles).join(F.broadcast(numbered.drop("key")), "n")
        return found.select("doc_id", "text", "item_id", "profile", "surface", "entity_id", "start", "end", "cost")
    composed = given.select("doc_id", T.nfc_where_needed(F.col("text")).alias("composed"))
    folds = F.array(*[F.struct(F.lit(p).alias("profile"), channel(F.col("composed"), p).alias("c")) for p in profiles])
    told = composed.select("doc_id", "composed", F.explode(folds).alias("f")).select(F.struct("doc_id", "composed", "f.profile", F.col("f.c.at").alias("at")).alias("doc_id"), F.col("f.c.folded").alias("text"))
    keys = keyed.select(F.struct("item_id", "profile", "surface", "entity_id").alias("item_id"), F.col("key").alias("surface"))
    found = matching.literal_matches(told, keys, most).where("doc_id.profile = item_id.profile")
    placed = found.select("doc_id.doc_id", "doc_id.composed", "item_id.*", F.slice("doc_id.at", F.col("start") + 1, F.col("end") - F.col("start")).alias("own"))
    gaps = F.zip_with(F.slice("own", F.lit(1), F.size("own") - 1), F.slice("own", F.lit(2), F.size("own") - 1), lambda a, b: b - a - 1)
    whole = F.when(F.size("own") > 1, gaps).otherwise(F.array().cast("array<int>"))
    out = placed.withColumn("gaps", whole).where(~F.exists("gaps", lambda g: g > MOST_GAP))
    cost = F.aggregate("gaps", F.lit(0), lambda a, g: a + g) * GAP_COST
    return out.select("doc_id", F.col("composed").alias("text"), "item_id", "profile", "surface", "entity_id", F.element_at("own", 1).alias("start"), (F.element_at("own", -1) + 1).alias("end"), F.round(cost, 9).alias("cost"))


def matches(docs: DataFrame, bindings: DataFrame, profile: str) -> DataFrame:
    """doc_id, item_id, text, start, end (of the text) and cost of each match under one profile.

    docs: doc_id, text; bindings: item_id, surface.
    """
    found = profile_matches(docs, bindings.select("item_id", F.lit(None).cast("string").alias("entity_id"), "surface", F.lit(profile).alias("profile")))
    return found.select("doc_id", "item_id", "text", "start", "end", "cost")


def default_left(surface: Column) -> Column:
    first = T.script(F.left(surface, F.lit(1)))
    return F.when(first == "latin", "latin_token_boundary").when(first == "hangul", "hangul_token_boundary").otherwise("unicode_word_boundary")


def with_boundary(found: DataFrame, latin_morph: bool | Column = True) -> DataFrame:
    """Adds status (PASS, SOFT, FAIL) and note of each match under its rule (left, right, inside_latin).

    A prefix modifier may fill the Hangul before a match, particles and Latin endings what follows it; other Hangul
    after it makes the match soft. Native: the particles are one alternation.
    """
    text, start, end = F.col("text"), F.col("start"), F.col("end")
    before = _before(text, start)
    left_run = F.regexp_extract(before, "([가-힣ㄱ-ㆎ]*)$", 1)
    prev, last, after = F.right(before, F.lit(1)), F.substring(text, end, F.lit(1)), F.substring(text, end + 1, F.lit(1))
    right_run = F.regexp_extract(F.substring(text, end + 1, F.lit(RIGHT)), r"^((?:[가-힣ㄱ-ㆎ0-9A-Za-z'’])*)", 1)
    modifier = left_run.isin(*M.PREFIXES)
    particles = "|".join(f"{p}(?![가-힣])" if p in H.CLOSING else p for p in sorted(H.PARTICLES, key=len, reverse=True))
    left_fails = (
        F.when(F.col("left") == "any", F.lit(None)).when(F.col("left") == "latin_token_boundary", F.when(T.script(prev) == "latin", "left:inside_latin_run"))
        .when(F.col("left") == "hangul_token_boundary", F.when((T.script(prev) == "hangul") & ~modifier, "left:hangul_attached"))
        .otherwise(F.when(T.script(prev).isin("latin", "hangul"), "left:word_attached"))
    )
    tail = M.latin_tail(right_run)
    known = F.col("right").isin("particle_or_token_boundary", "latin_token_boundary")
    right = (
        F.when((F.col("right") == "any") | T.token_boundary(last, after), F.struct(F.lit("PASS").alias("status"), F.lit("").alias("note")))
        .when(~known, F.struct(F.lit("FAIL").alias("status"), F.lit("right:unknown_policy").alias("note")))
        .when((T.script(after) == "hangul") & (F.col("right") == "particle_or_token_boundary") & right_run.rlike(f"^(?:{particles})"), F.struct(F.lit("PASS").alias("status"), F.lit("right:particle_prefix_accept").alias("note")))
        .when(T.script(after) == "hangul", F.struct(F.lit("SOFT").alias("status"), F.lit("right:hangul_residual").alias("note")))
        .when((latin_morph if isinstance(latin_morph, Column) else F.lit(latin_morph)) & (tail != ""), F.struct(F.lit("PASS").alias("status"), F.concat(F.lit("right:latin_tail:"), tail).alias("note")))
        .when(F.col("inside_latin"), F.struct(F.lit("SOFT").alias("status"), F.lit("right:inside_latin_run_allowed").alias("note")))
        .otherwise(F.struct(F.lit("FAIL").alias("status"), F.lit("right:inside_latin_run").alias("note")))
    )
    note = F.when(F.col("left") == "hangul_token_boundary", F.when((T.script(prev) == "hangul") & modifier, F.concat(F.lit("left:prefix_modifier:"), left_run)))
    done = found.withColumn("__l", left_fails).withColumn("__r", right)
    return done.select(*found.columns, F.when(F.col("__l").isNotNull(), "FAIL").otherwise(F.col("__r.status")).alias("status"), F.coalesce("__l", F.concat_ws(",", note, F.nullif(F.col("__r.note"), F.lit("")))).alias("note"))


def proposals(bounded: DataFrame) -> DataFrame:
    """Matches that did not fail with their tails, modifier, whole span and score.

    Tails are read beside the matches, by a kernel that remembers runs: a join on distinct runs would take the texts along.
    """
    text, start, end = F.col("text"), F.col("start"), F.col("end")
    kept = bounded.where("status != 'FAIL'").withColumn("run", F.regexp_extract(F.substring(text, end + 1, F.lit(40)), "^([가-힣]*)", 1)).withColumn("last", F.substring(text, end, F.lit(1)))
    both = kept.withColumn("tails", S.tails_udf("run", "last"))
    best = F.get("tails", F.lit(0))
    before = _before(text, start)
    modifier = M.prefix_modifier(before)
    spaced = (modifier != "") & (F.right(before, F.lit(1)) == " ")
    latin = F.when(F.col("run") == "", M.latin_tail(F.substring(text, end + 1, F.lit(8)))).otherwise("")
    full_end = end + F.length(best["residual"]) + F.length(F.array_join(best["particles"], "")) + F.length(latin)
    explained = (best["kind"] == "SUFFIX") & best["grammatical"]
    score = F.greatest(F.lit(0.05), 1 - F.least("cost", F.lit(0.5))) * best["score"] * F.when((F.col("status") == "PASS") | explained, 1.0).otherwise(0.6)
    return both.select(
        *bounded.columns, best["residual"].alias("residual"), best["particles"].alias("particles"), best["identity"].alias("identity"), best["relation"].alias("relation"), F.size("tails").alias("readings"),
        modifier.alias("modifier"), (start - F.when(modifier != "", F.length(modifier) + spaced.cast("int")).otherwise(0)).alias("full_start"), full_end.alias("full_end"), F.round(score, 6).alias("score"),
    )
