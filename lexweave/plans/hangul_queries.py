"""Hangul operators on hand-made strings and on the numbers of all parts spelt in syllables; the oracle spells them by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hangul as H
from ..functions import text as T
from ..operators import recovery as R
from .base import literal, query, quoted, table

#: A syllable for each digit, with its jamo, its keys and its final.
DIGITS = "0123456789"
SYLLABLES = "가각난다란마밥사아잘"
SPELT = [("ㄱㅏ", "rk", ""), ("ㄱㅏㄱ", "rkr", "ㄱ"), ("ㄴㅏㄴ", "sks", "ㄴ"), ("ㄷㅏ", "ek", ""), ("ㄹㅏㄴ", "fks", "ㄴ"), ("ㅁㅏ", "ak", ""), ("ㅂㅏㅂ", "qkq", "ㅂ"), ("ㅅㅏ", "tk", ""), ("ㅇㅏ", "dk", ""), ("ㅈㅏㄹ", "wkf", "ㄹ")]


def _spelt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """d (digits) and s (syllables) of the number of every part."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("d")).withColumn("s", F.translate("d", DIGITS, SYLLABLES))


def _spelt_sql(which: int, d: str = "p_partkey::VARCHAR") -> str:
    """The digits of a string, each as its syllable's jamo (0) or keys (1)."""
    return f"array_to_string(list_transform(regexp_extract_all({d}, '.'), lambda x: ({quoted([r[which] for r in SPELT])})[x::INT + 1]), '')"


_SYLLABLES = f"translate(p_partkey::VARCHAR, '{DIGITS}', '{SYLLABLES}')"
NFD = [("1", "한전"), ("2", "한전"), ("3", "é"), ("4", "plain")]


@query("p01_nfc", f"SELECT id, nfc_normalize(s) AS composed FROM {literal(NFD, 'id', 's')}")
def p01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(NFD, "id string, s string").select("id", T.nfc_where_needed(F.col("s")).alias("composed"))


JAMO = [("한전", "ㅎㅏㄴㅈㅓㄴ"), ("값", "ㄱㅏㅂㅅ"), ("의", "ㅇㅡㅣ"), ("AP", "AP"), ("", "")]


@query("p15_jamo", f"SELECT * FROM {literal(JAMO, 's', 'jamo')} UNION ALL SELECT {_SYLLABLES}, {_spelt_sql(0)} FROM part")
def p15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(s,) for s, _ in JAMO], "s string").union(_spelt(spark, sf_dir).select("s")).select("s", H.jamo(F.col("s")).alias("jamo"))


@query("p16_keys", f"SELECT * FROM {literal([('한국전력', 'gksrnrwjsfur'), ('한전', 'gkswjs')], 's', 'keys')} UNION ALL SELECT {_SYLLABLES}, {_spelt_sql(1)} FROM part")
def p16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([("한국전력",), ("한전",)], "s string").union(_spelt(spark, sf_dir).select("s")).select("s", H.keys(F.col("s")).alias("keys"))


COMPOSED = [("ㄱㅏㅁㅏ", "가마"), ("ㄷㅏㄹㄱ", "닭"), ("ㅎㅏㄴㅅ", "한ㅅ"), ("ㅎㅏㄴ전", "한전"), ("ㅇㅗㅏ", "와")]


@query("p06_composed_runs", f"SELECT * FROM {literal(COMPOSED, 's', 'composed')} UNION ALL SELECT {_spelt_sql(0)}, {_SYLLABLES} FROM part")
def p06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hand-made runs, and all parts' numbers as they are typed jamo by jamo."""
    typed = F.array_join(F.transform(F.regexp_extract_all("d", F.lit("."), F.lit(0)), lambda x: F.element_at(F.array(*[F.lit(r[0]) for r in SPELT]), x.cast("int") + 1)), "")
    return spark.createDataFrame([(s,) for s, _ in COMPOSED], "s string").union(_spelt(spark, sf_dir).select(typed)).select("s", H.compose_udf("s").alias("composed"))


FINAL = [("한전", "ㄴ"), ("서울", "ㄹ"), ("카카오", ""), ("AP", None)]


@query("p14_finals", f"SELECT * FROM {literal(FINAL, 's', 'final')} UNION ALL SELECT {_SYLLABLES}, ({quoted([r[2] for r in SPELT])})[p_partkey % 10 + 1] FROM part")
def p14(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(s,) for s, _ in FINAL], "s string").union(_spelt(spark, sf_dir).select("s")).select("s", H.final_of(F.col("s")).alias("final"))


DISTANCES = [("ㅁ", "ㄴ", 0.20), ("ㅂ", "ㅊ", 0.50), ("ㄱ", "ㅋ", 0.35), ("ㅐ", "ㅔ", 0.20), ("가나", "가 나", 0.05)]


@query("m09_weighted_distance", "SELECT a, b, d::DOUBLE AS distance FROM " + literal(DISTANCES, "a", "b", "d"))
def m09(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([r[:2] for r in DISTANCES], "a string, b string")
    return rows.select("a", "b", F.round(H.distance_udf(H.jamo(F.col("a")), H.jamo(F.col("b"))), 6).alias("distance"))


CHAINS = [("에서도", "전", "에서+도"), ("가", "전", "가*"), ("에서만은", "전", "에서+만+은"), ("으로부터는", "전", "으로+부터+는"), ("호랑이", "전", "")]


@query("m02_particle_chains", "SELECT * FROM " + literal(CHAINS, "s", "before", "chains"))
def m02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([r[:2] for r in CHAINS], "s string, before string").select("s", "before", H.chains_udf("s", "before").alias("chains"))


ACRONYMS = ["Quality Management System", "Access Point", "Korea Electric Power"]


@query("j07_initials", f"SELECT * FROM {literal([('AP', 'Access Point'), ('QMS', 'Quality Management System')], 'token', 'name')} UNION ALL SELECT DISTINCT upper(array_to_string(list_transform(string_split(p_name, ' '), lambda w: w[1]), '')), p_name FROM part")
def j07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equi-join of tokens, hand-made ones and the initials of all parts, with the initials of names."""
    initials = F.upper(F.array_join(F.transform(F.split("name", " "), lambda w: F.left(w, F.lit(1))), ""))
    parts = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()
    names = spark.createDataFrame([(n,) for n in ACRONYMS], "name string").union(parts).withColumn("token", initials)
    tokens = spark.createDataFrame([("AP",), ("QMS",), ("XX",)], "token string").union(parts.select(initials)).distinct()
    return tokens.join(names, "token")


@query("j05_keyboard_recovery", "SELECT * FROM " + literal([("gkswjs", "한전")], "token", "surface"))
def j05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens typed in the other input mode: an equi-join on keys."""
    names = spark.createDataFrame([("한전",), ("한국전력",)], "surface string").withColumn("token", H.keys(F.col("surface")))
    return spark.createDataFrame([("gkswjs",), ("ap",)], "token string").join(names, "token")


@query("j10_one_jamo_edit", "SELECT * FROM " + literal([("한국전려", "한국전력")], "token", "surface"))
def j10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings one jamo edit apart keep one half of the longer: an equi-join on halves, then the distance."""

    def halves(df: DataFrame, name: str) -> DataFrame:
        j = df.select(name, H.jamo(F.col(name)).alias("j")).withColumn("n", F.length("j"))
        cut = F.explode(F.array(*[F.struct(F.lit(side).alias("side"), m.cast("int").alias("m")) for side in ("head", "tail") for m in (F.floor(F.col("n") / 2), F.floor((F.col("n") - 1) / 2))]))
        return j.select(name, "j", cut.alias("c")).select(name, "j", "c.side", F.when(F.col("c.side") == "head", F.left("j", F.col("c.m"))).otherwise(F.right("j", F.col("c.m"))).alias("half")).distinct()

    t, s = halves(spark.createDataFrame([("한국전려",), ("호랑이",)], "token string"), "token"), halves(spark.createDataFrame([("한국전력",), ("한전",)], "surface string"), "surface").withColumnRenamed("j", "js")
    return t.join(s, ["side", "half"]).where(T.one_edit(F.col("j"), F.col("js"))).select("token", "surface").distinct()


@query("j10_recovered_names", """
WITH n AS (SELECT DISTINCT lpad(p_partkey::VARCHAR, 6, '0') AS d FROM part), f AS (SELECT d, i, d[1:i - 1] || '*' || d[i + 1:] AS form FROM n, range(1, 7) t(i)), w AS (SELECT DISTINCT lpad(s_suppkey::VARCHAR, 6, '0') AS d FROM supplier)
SELECT a.d AS word, b.d AS name, 'jamo' AS channel FROM f a JOIN f b ON a.form = b.form AND a.i = b.i AND a.d <> b.d UNION ALL SELECT w.d, n.d, 'keyboard' FROM w JOIN n ON w.d = n.d""")
def j10_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of all parts spelt in syllables of one vowel: two of them are one jamo apart where one digit differs. The
    suppliers' are typed with the Latin keys."""
    digits, syllables = "0123456789", "가나다라마바사아자차"
    spelt = lambda c: F.translate(F.lpad(F.col(c).cast("string"), 6, "0"), digits, syllables)
    names = table(spark, sf_dir, "part").select(spelt("p_partkey").alias("surface"))
    typed = table(spark, sf_dir, "supplier").select(H.keys(spelt("s_suppkey")).alias("token"))
    words = names.select(F.col("surface").alias("token")).union(typed)
    # the vowel's key stands for no digit and goes
    read = lambda c: F.translate(c, syllables + "rsefaqtdwck", digits * 2)
    return R.one_step(words, names).where("channel != 'abbrev'").select(read("token").alias("word"), read("surface").alias("name"), "channel")
