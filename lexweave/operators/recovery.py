"""Recovery of misspelt names: jamo grams with weighted distance, names typed in the other script."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hangul as H
from ..functions import text as T


def fuzzy_candidates(tokens: DataFrame, bindings: DataFrame, shortlist: int = 32, most: int = 8) -> DataFrame:
    """token, item_id and cost of up to ``most`` bindings within their budget of weighted jamo edits.

    tokens: token; bindings: item_id, surface. The shortlist is of the bindings with the most jamo bigrams in common, ties
    by item_id; only its pairs reach the distance kernel.
    """
    jamo = lambda c: T.grams(H.jamo(F.col(c)), 2)
    budget = T.fuzzy_budget(F.length(H.jamo(F.col("surface"))), F.length("surface"))
    held = bindings.withColumn("budget", budget).where("budget is not null").select("item_id", "surface", "budget", F.explode(jamo("surface")).alias("g"))
    sought = tokens.select("token").distinct().select("token", F.explode(jamo("token")).alias("g"))
    shared = sought.join(held, "g").groupBy("token", "item_id", "surface", "budget").agg(F.count("*").alias("n"))
    near = shared.withColumn("__r", F.row_number().over(Window.partitionBy("token").orderBy(F.desc("n"), "item_id"))).where(F.col("__r") <= shortlist)
    cost = near.select("token", "item_id", "budget", H.distance_udf(H.jamo(F.col("token")), H.jamo(F.col("surface"))).alias("cost")).where("cost <= budget")
    return cost.withColumn("__r", F.row_number().over(Window.partitionBy("token").orderBy("cost", "item_id"))).where(F.col("__r") <= most).select("token", "item_id", F.round("cost", 9).alias("cost"))


def typed_otherwise(tokens: DataFrame, bindings: DataFrame) -> DataFrame:
    """token, item_id and entity_id of names typed with the keyboard in the other script: Latin letters that are the keys
    of a Hangul name, or Hangul whose keys spell a Latin one.

    tokens: token; bindings: item_id, entity_id, surface. An equi-join on the keys; names under two characters are left out.
    """
    latin = F.col("surface").rlike("^[A-Za-z]+$")
    held = bindings.where(F.length("surface") >= 2).where(latin | F.col("surface").rlike("^[가-힣]+$")).select("item_id", "entity_id", F.when(latin, F.lower("surface")).otherwise(F.lower(H.keys(F.col("surface")))).alias("keys"), latin.alias("latin"))
    hangul = F.col("token").rlike("^[가-힣ㄱ-ㅎㅏ-ㅣ]+$")
    sought = tokens.select("token").distinct().where(hangul | F.col("token").rlike("^[A-Za-z]+$")).select("token", F.when(hangul, F.lower(H.keys(F.col("token")))).otherwise(F.lower("token")).alias("keys"), hangul.alias("latin"))
    return sought.join(held, ["keys", "latin"]).select("token", "item_id", "entity_id")


def _name_keys(names: DataFrame) -> DataFrame:
    """surface, channel, key and form (what is verified) of every way in which a name can be recovered."""
    s, compact = F.col("surface"), F.regexp_replace("surface", r"(?U)\s", "")
    words = F.split(F.regexp_replace("surface", r"(?U)^\s+|\s+$", ""), r"(?U)\s+")
    told = names.select("surface").where("surface is not null").distinct()
    hangul = told.where(s.rlike("^[가-힣]{2,32}$"))
    out = hangul.select("surface", F.lit("keyboard").alias("channel"), H.keys(s).alias("key"), s.alias("form"))
    out = out.union(told.where(s.rlike("^[A-Za-z]{2,32}$")).select("surface", F.lit("hangul_keyboard"), F.lower(s), s))
    several = told.where((F.size(words) >= 3) & F.forall(words, lambda w: w.rlike("^[A-Za-z]+$")))
    out = out.union(several.select("surface", F.lit("initials"), F.upper(F.array_join(F.transform(words, lambda w: F.left(w, F.lit(1))), "")), s))
    ends = told.withColumn("c", compact).where(F.col("c").rlike("^[가-힣]{4,60}$"))
    inner = F.array_distinct(F.transform(F.sequence(F.lit(2), F.length("c") - 1), lambda i: F.concat(F.left("c", F.lit(1)), F.right("c", F.lit(1)), F.substring("c", i, F.lit(1)))))
    return out.union(ends.select("surface", F.lit("abbrev"), F.explode(inner), F.col("c")))


def _word_keys(words: DataFrame) -> DataFrame:
    """token, channel, key and form of every way in which a word can stand for a name."""
    t = F.col("token")
    told = words.select("token").where("token is not null").distinct()
    latin, hangul = told.where(t.rlike("^[A-Za-z]{3,96}$")), told.where(t.rlike("^[가-힣]{3,32}$"))
    out = latin.select("token", F.lit("keyboard").alias("channel"), t.alias("key"), t.alias("form")).union(latin.select("token", F.lit("initials"), t, t))
    typed = told.where(t.rlike("^[가-힣ㄱ-ㅎㅏ-ㅣ]{1,32}$") & (t.rlike("[ㄱ-ㅎㅏ-ㅣ]") | (F.length(t) >= 2)))
    out = out.union(typed.select("token", F.lit("hangul_keyboard"), F.lower(H.keys(t)), t))
    inner = F.array_distinct(F.transform(F.sequence(F.lit(2), F.length(t) - 1), lambda i: F.concat(F.left(t, F.lit(1)), F.right(t, F.lit(1)), F.substring(t, i, F.lit(1)))))
    return out.union(hangul.select("token", F.lit("abbrev"), F.explode(inner), t))


def _one_jamo(words: DataFrame, names: DataFrame) -> DataFrame:
    """token, surface and channel of Hangul words and names one conjoining jamo apart.

    Both are spread into themselves and what is left without each of their jamo. A jamo that was changed leaves two equal
    rests of one place, one that was put in or left out a rest that equals the other whole: rows that meet are pairs that
    are sought, however many names share a beginning or an end, and a pair meets once. Spark takes the spread names for no
    larger than the names, so that without the hint it sends them whole through the driver.
    """

    def spread(df: DataFrame, name: str, least: int) -> DataFrame:
        c = F.col(name)
        forms = df.select(name).where(c.rlike("^[가-힣]{%d,32}$" % least)).distinct().select(name, T.nfd(c).alias("form"))
        cut = lambda i: F.concat(F.left("form", i - 1), F.substring("form", i + 1, F.length("form")))
        each = F.transform(F.sequence(F.lit(1), F.length("form")), lambda i: F.struct(i.alias("at"), F.xxhash64(cut(i)).alias("key"), F.substring("form", i, F.lit(1)).alias("gone")))
        whole = F.array(F.struct(F.lit(0).alias("at"), F.xxhash64("form").alias("key"), F.lit("").alias("gone")))
        return forms.select(name, "form", F.inline(F.concat(whole, each)))

    t, n = spread(words, "token", 3), spread(names, "surface", 3).withColumnsRenamed({"form": "held", "at": "held_at", "gone": "held_gone"})
    # of a run of equal jamo the first one counts as the one that was put in
    first = lambda form, at, gone: (at > 0) & (F.substring(form, at - 1, F.lit(1)) != gone) | (at == 1)
    rest = lambda form, at: F.concat(F.left(form, at - 1), F.substring(form, at + 1, F.length(form)))
    form, held, i, j = (F.col(c) for c in ("form", "held", "at", "held_at"))
    changed = (i == j) & (i > 0) & (F.col("gone") != F.col("held_gone")) & (rest(form, i) == rest(held, j))
    longer = (j == 0) & first(form, i, F.col("gone")) & (rest(form, i) == held)
    shorter = (i == 0) & first(held, j, F.col("held_gone")) & (rest(held, j) == form)
    return t.join(n.hint("merge"), "key").where(changed | longer | shorter).select("token", "surface", F.lit("jamo").alias("channel"))


def one_step(words: DataFrame, names: DataFrame) -> DataFrame:
    """token, surface and channel of names (surface) that a word (token) is one step away from.

    jamo: one conjoining jamo inserted, deleted or changed; keyboard and hangul_keyboard: typed with the other script's
    keys; initials of three Latin words and more; abbrev: a subsequence that keeps both ends, half of the syllables and
    leaves out two at least. The first meet by what is left without a jamo, the others are one equi-join on a key of channel
    and form: of an abbreviation's inner syllables the rarest among the names is its key, so that frequent ones pair
    nothing. A pair that several keys offer is verified once. No side of a join is sent through the driver.
    """
    held = _name_keys(names)
    counts = held.where("channel = 'abbrev'").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    sought = _word_keys(words)
    inner = sought.where("channel = 'abbrev'")
    # a syllable that no name holds rules the word out
    rarest = inner.join(counts.hint("merge"), "key", "left").groupBy("token", "channel", "form").agg(F.min_by("key", F.coalesce("n", F.lit(0))).alias("key"))
    keyed = sought.where("channel != 'abbrev'").unionByName(rarest)
    met = keyed.join(held.withColumnRenamed("form", "held").hint("merge"), ["channel", "key"]).select("token", "surface", "channel", "form", "held").distinct()
    far = F.length("held")
    within = (far >= F.length("form") + 2) & (far <= 2 * F.length("form")) & F.rlike("held", F.array_join(F.regexp_extract_all("form", F.lit("."), F.lit(0)), ".*"))
    others = met.where(F.when(F.col("channel") == "abbrev", within).otherwise(F.lit(True))).select("token", "surface", "channel")
    return _one_jamo(words, names).union(others)
