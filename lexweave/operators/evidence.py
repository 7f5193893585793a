"""What a text itself says about one occurrence of a surface: vetoes, self-definitions, passages that support it.

Rules are lexical and bounded: they look at the occurrence's sentence, paragraph and section, never at another document,
so an occurrence is a row and everything is a column of it. Only surfaces that several entities share need come here.
Native but for the compatibility folding of self-definitions.

occurrences: text, start, end and candidates, an array of (entity_id, canonical, definition, aliases). Null candidates or
fields count as none; a null text or place makes an invalid span, which is told as such; rows that repeat are judged each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chunks as C
from ..functions import text as T
from . import matching, selection

# ---------------------------------------------------------------- fixed values

OPENING, CLOSING = "\"'“‘「『", "\"'”’」』"
ROLES = "팀장|실장|센터장|위원장|원장|회장|부장|국장|대표|책임자"
UNRESOLVED = (
    r"어느\s*(?:쪽|팀|부서|대상|업무|조직)[^.!?。？！\n]{0,65}(?:알\s*수\s*없|모르|확정되지|결정되지|판단할\s*수\s*없|구분할\s*수\s*없)"
    r"|(?:두|여러)\s*(?:후보|부서|대상|팀)\s*중[^.!?。？！\n]{0,50}(?:근거가\s*없|결정되지|확정되지|알\s*수\s*없)"
    r"|(?:수신처|담당\s*부서|대상\s*조직)[^.!?。？！\n]{0,30}(?:아직\s*)?(?:미정|불명|확정되지|결정되지)"
)
CLAIM = r"(?:(?:그|이|위|앞의|해당|이번)\s*)(?:설명|주장|정의|해석|진술|문구|문장|이름|명칭|용어|표현|낱말|대상|물체|상품)"
RETRACTED = (
    CLAIM + r"[^,;\n.!?。？！]{0,65}(?:틀리|틀린|틀렸|잘못|거짓|허위|가짜|사실과\s*다르|철회|폐기|취소|삭제해야|미등록|등록(?:돼|되어|된)?\s*있지\s*않|등록되지|등록한\s*업무\s*대상이\s*아니|"
    r"(?:상표|상품명|작품\s*이름|영화\s*제목|문자열\s*예시|입력\s*견본))"
    r"|" + CLAIM + r"(?:은|는|이|가)?\s*(?:실제\s*)?(?:조직|부서|업무|진술)[^,;\n.!?。？！]{0,35}(?:아니|않)"
)
DENIED = (
    r"(?:보내|전달하|연결하|지칭하|가리키|뜻하|배정하|사용하)지\s*(?:않|말)|(?:담당|수신처|부서|조직|업무\s*대상)(?:이|가|은|는)?\s*아니"
    r"|(?:후보|이름|명칭|문구|안내|안)(?:을|를|은|는|이|가)?[^,;\n.!?。？！]{0,30}(?:폐기|철회|취소|삭제)"
    r"|(?:실제\s*)?(?:부서|조직|서비스)[^,;\n.!?。？！]{0,35}(?:부여한\s*적(?:은|이)?\s*없|등록(?:돼|되어)?\s*있지\s*않)"
)
OBJECT_BEFORE = r"(?:독서등|조명|상품|제품|브랜드|단편\s*영화|영화|소설|작품|상표)\s*$"
OBJECT_AFTER = r"^(?:의\s*)?(?:사진|포스터|상영|상품|제품|상표|영화|작품|제목)"
REJECTED = r"(?:틀린|가짜|허위|잘못된)\s*(?:예문|예시|정의|주장|문장)|(?:이름|철자|명칭)[^,;\n.!?。？！]{0,20}(?:연습|훈련)[^,;\n.!?。？！]{0,55}(?:폐기|취소|철회)"
NO_EXAMPLE = r"(?:(?:틀린|가짜|허위|잘못된)\s*)?(?:예문|예시|정의|주장|문장|상표|상품명|작품\s*이름|영화\s*제목|문자열\s*예시|입력\s*견본)(?:이|가)?\s*아니"
NEGATION = r"^\s*(?:이|가)?\s*아니"
# of self-definitions
COPULA, SUBJECT = r"^(?:이다|다|입니다|임)[.。]*$", r"^(?:은|는|란|이란)(?:\s+바로)?\s*$"
NAME_END, LOCATIVE = r"^\)(?:이다|다|입니다|임)?[.。]*$", r"^(?:이\s*(?:업무\s*)?문서에서|이번\s*요청에서)\s*$"
UNSUPPORTED = (
    r"아니|않|없|못|제외|무관|미등록|등록되지|비언급|보통명사|문자열|입력 견본|입력견본|상표|상품명|행사명|비유|개인|책임자|직함|센터장|팀장|실장|원장|노조|만약|가정|예시|예문|추정|불확실|미확인|모르|[?？]|"
    r"틀리|틀린|틀렸|거짓|허위|오해|반례|오인"
)
_OF_CLAIM = r"(?:(?:그|이|위|앞의|해당)\s*)?(?:설명|주장|정의|해석|진술|문구|문장|이름|명칭|용어|표현|낱말|단어|대상)"
CONTRADICTED = (
    _OF_CLAIM + r"[^,;\n.!?。？！]{0,40}(?:틀리|틀린|틀렸|거짓|허위|오해|오류|아니|않|없|못|미등록|등록되지|예시|예문|상품명|행사명|상표|보통명사|입력\s*견본|비유|추정|불확실|미확인)"
    r"|" + _OF_CLAIM + r"(?:을|를|은|는)?\s*(?:정정|철회|번복)"
    r"|(?:여기서는|이번에|이\s*(?:업무\s*)?문서에서|전체\s*표현|표현\s*전체|(?:그|이)\s*(?:이름|명칭|용어|표현|낱말|대상|물체))[^,;\n.!?。？！]{0,60}(?:개인|책임자|직함|센터장|팀장|실장|원장|노조|미등록|등록되지|입력\s*견본|무관|상품명|행사명|상표|비유)"
    r"|(?:입력\s*견본|시험\s*문자열|문자열\s*견본|비언급|보통명사)|(?:주장|설명|정의|해석|진술|문구)[^,;\n.!?。？！]{0,40}사실과\s*다르"
)
LEAST_NAME, LEAST_DEFINITION, LEAST_MASKED, CONTEXT, MOST_SUPPORTS, BUDGET = 6, 12, 3, 4096, 2, 1024

# ---------------------------------------------------------------- building blocks


def _no_strings() -> Column:
    return F.array().cast("array<string>")


def _u(pattern: str) -> str:
    return "(?U)" + pattern


def cut(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def quotations(text: Column) -> Column:
    """(spans, malformed): [start, end) of quotations with their marks, the inner ones too, and whether marks don't pair.

    A fold over the marks with a stack of what closes the open ones; it ends with the first mark that neither opens nor closes.
    """
    marks = T.matched_spans(text, f"[{''.join(sorted(set(OPENING + CLOSING)))}]")
    opening, closing = F.lit(OPENING), F.lit(CLOSING)
    start = F.struct(F.array().cast("array<struct<close:string,at:int>>").alias("open"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"), F.lit(False).alias("bad"))

    def step(s: Column, x: Column) -> Column:
        n = F.size(s["open"])
        last = F.get(s["open"], n - 1)
        closes = (n > 0) & (x["text"] == last["close"])
        at = F.call_function("locate", x["text"], opening)
        popped = F.struct(F.slice(s["open"], F.lit(1), F.greatest(n - 1, F.lit(0))).alias("open"), F.array_append(s["spans"], F.struct(last["at"].alias("start"), (x["start"] + 1).alias("end"))).alias("spans"), s["bad"].alias("bad"))
        pushed = F.struct(F.array_append(s["open"], F.struct(F.substring(closing, at, F.lit(1)).alias("close"), x["start"].alias("at"))).alias("open"), s["spans"].alias("spans"), s["bad"].alias("bad"))
        broken = F.struct(s["open"].alias("open"), s["spans"].alias("spans"), F.lit(True).alias("bad"))
        return F.when(s["bad"], s).when(closes, popped).when(at > 0, pushed).otherwise(broken)

    return F.aggregate(marks, start, step, lambda s: F.struct(s["spans"].alias("spans"), (s["bad"] | (F.size(s["open"]) > 0)).alias("malformed")))


def _fields(candidates: Column, *names: str) -> Column:
    """The distinct values of fields of the candidates that hold something."""
    every = F.flatten(F.transform(candidates, lambda c: F.array(*[c[n] for n in names])))
    return F.array_distinct(F.filter(every, lambda x: x.isNotNull() & (x != "")))


def masked(fragment: Column, anchors: Column) -> Column:
    """Registered names and definitions are vocabulary, not assertions: blanks stand for them, then for denials of being an example."""
    own = F.array_sort(F.filter(anchors, lambda a: F.length(a) >= LEAST_MASKED), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    blank = F.aggregate(own, fragment, lambda s, a: F.replace(s, a, F.repeat(F.lit(" "), F.length(a))))
    return F.regexp_replace(blank, _u(NO_EXAMPLE), " ")


def denial(fragment: Column, anchors: Column) -> Column:
    """Why a fragment withdraws what it speaks of, or null."""
    outside = masked(fragment, anchors)
    return F.when(outside.rlike(_u(RETRACTED)), "SCOPED_RETRACTION_OR_UNREGISTERED").when(outside.rlike(_u(UNRESOLVED)), "EXPLICITLY_UNRESOLVED_TARGET")


def _framed(occurrences: DataFrame) -> DataFrame:
    """Adds what all rules look at: surface, paragraphs, the paragraph's number and text, anchors, section."""
    text, start, end = F.col("text"), F.col("start"), F.col("end")
    rows = occurrences.withColumn("candidates", F.coalesce("candidates", F.array().cast(dict(occurrences.dtypes)["candidates"])))
    valid = F.coalesce((start >= 0) & (start < end) & (end <= F.length(text)), F.lit(False))
    rows = rows.withColumn("__surface", F.when(valid, cut(text, start, end))).withColumn("__surface", F.when(F.col("__surface").rlike(r"(?U)\S"), F.col("__surface")))
    rows = rows.withColumn("__paras", F.coalesce(T.spans_between(text, T.PARAGRAPH_BREAK), F.array().cast("array<struct<start:int,end:int>>")))
    inside = F.filter(F.transform("__paras", lambda p, i: F.struct(p["start"].alias("start"), p["end"].alias("end"), i.alias("i"))), lambda p: (p["start"] <= start) & (end <= p["end"]))
    rows = rows.withColumn("__para", F.get(inside, F.lit(0))).withColumn("__raw", cut(text, F.col("__para.start"), F.col("__para.end")))
    return rows.withColumn("__anchors", _fields(F.col("candidates"), "canonical", "definition")).withColumn("__section", selection.section(text, start))


def _sentence(raw: Column, base: Column, start: Column) -> Column:
    """The sentence of a paragraph that begins before a place and ends behind it, or the paragraph."""
    spans = F.transform(T.sentence_spans(raw), lambda s: F.struct((s["start"] + base).alias("start"), (s["end"] + base).alias("end")))
    return F.coalesce(F.get(F.filter(spans, lambda s: (s["start"] <= start) & (start < s["end"])), F.lit(0)), F.struct(base.alias("start"), (base + F.length(raw)).alias("end")))


def unquoted(fragment: Column, base: Column, surface: Column) -> Column:
    """Starts of a surface in a fragment, but for those in a quotation of more than the surface; none where quotations don't pair."""
    q = quotations(fragment)

    def free(at: Column) -> Column:
        return ~F.exists(q["spans"], lambda s: (s["start"] < at) & (at + F.length(surface) < s["end"]) & (stripped(cut(fragment, s["start"] + 1, s["end"] - 1)) != surface))

    found = F.filter(matching.places(fragment, surface), free)
    return F.when(q["malformed"], F.array().cast("array<int>")).otherwise(F.transform(found, lambda at: at + base))


# ---------------------------------------------------------------- vetoes


def _judged(occurrences: DataFrame) -> DataFrame:
    text, start, end, surface, raw, anchors = (F.col(c) for c in ("text", "start", "end", "__surface", "__raw", "__anchors"))
    base = F.col("__para.start")
    rows = _framed(occurrences).withColumn("__q", quotations(raw)).withColumn("__sentence", _sentence(raw, base, start))
    rows = rows.withColumn("__statement", cut(text, F.col("__sentence.start"), F.col("__sentence.end"))).withColumn("__outside", masked(F.col("__statement"), anchors))
    aliases = F.array_distinct(F.flatten(F.transform("candidates", lambda c: F.coalesce(c["aliases"], _no_strings()))))
    unknown = (F.size(F.filter(aliases, lambda a: a != "")) > 0) & ~F.array_contains(aliases, surface) & ~F.exists("candidates", lambda c: F.coalesce(c["canonical"] == surface, F.lit(False)))
    quoted = F.exists(F.col("__q.spans"), lambda s: (s["start"] + base < start) & (end < s["end"] + base) & (stripped(cut(raw, s["start"] + 1, s["end"] - 1)) != surface))
    rest = cut(text, end, F.col("__sentence.end"))
    at = lambda a: F.call_function("locate", a, rest)
    negated = F.exists(anchors, lambda a: (at(a) > 0) & F.substring(rest, at(a) + F.length(a), F.length(rest)).rlike(_u(NEGATION)))
    before, after = stripped(cut(text, F.col("__sentence.start"), start)), F.regexp_replace(rest, r"(?U)^\s+", "")
    rows = rows.withColumn("__own", denial(raw, anchors))
    # beyond the paragraph: all of the section where the surface stands there once, else the next paragraph if it is silent on it
    section = F.col("__section")
    once = F.size(unquoted(cut(text, section["start"], section["end"]), section["start"], surface)) == 1
    rows = rows.withColumn("__once", once)
    numbered = F.transform("__paras", lambda p, i: F.struct(p["start"].alias("start"), p["end"].alias("end"), i.alias("i")))
    whole = F.filter(numbered, lambda p: (section["start"] <= p["start"]) & (p["start"] < section["end"]) & (p["i"] != F.col("__para.i")))
    following = F.filter(numbered, lambda p: (p["i"] == F.col("__para.i") + 1) & (p["start"] < section["end"]) & ~F.contains(cut(text, p["start"], p["end"]), surface))
    scope = F.when(F.col("__once"), whole).otherwise(following)
    told = F.transform(scope, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), denial(cut(text, p["start"], p["end"]), anchors).alias("reason")))
    rows = rows.withColumn("__remote", F.get(F.filter(told, lambda p: p["reason"].isNotNull()), F.lit(0)))
    reason = (
        F.when(surface.isNull(), "INVALID_TARGET_SPAN").when(unknown, "TARGET_SURFACE_NOT_REGISTERED").when(F.col("__para").isNull(), "NO_TARGET_PARAGRAPH").when(F.col("__q.malformed"), "UNCERTAIN_QUOTATION").when(quoted, "QUOTED_ASSERTION")
        .when(F.substring(text, end + 1, F.lit(4)).rlike(f"^(?:{ROLES})"), "DISTINCT_ROLE_SURFACE").when(F.col("__outside").rlike(_u(DENIED)) | F.col("__outside").rlike(_u(REJECTED)) | negated, "NEGATED_OR_REJECTED_TARGET")
        .when(before.rlike(_u(OBJECT_BEFORE)) & after.rlike(_u(OBJECT_AFTER)), "EXPLICIT_UNREGISTERED_OBJECT").when(F.col("__own").isNotNull(), F.col("__own")).otherwise(F.col("__remote.reason"))
    )
    near = ("INVALID_TARGET_SPAN", "TARGET_SURFACE_NOT_REGISTERED", "NO_TARGET_PARAGRAPH")
    rows = rows.withColumn("veto", reason)
    return rows.withColumn("veto_span", F.when(F.col("veto").isNotNull() & ~F.col("veto").isin(*near), F.when(F.col("veto") == F.coalesce("__own", F.lit("")), F.struct(F.col("__para.start").alias("start"), F.col("__para.end").alias("end"))).when(F.col("__remote.reason").isNotNull() & (F.col("veto") == F.col("__remote.reason")), F.struct("__remote.start", "__remote.end")).otherwise(F.struct(F.col("__para.start").alias("start"), F.col("__para.end").alias("end")))))


def vetoes(occurrences: DataFrame) -> DataFrame:
    """The rows with veto (why the text does not assert the occurrence; null: nothing speaks against it) and veto_span.

    Quotations of more than the surface, retractions, denials, roles, objects of another kind and declared ambiguity veto;
    what a registered name or definition itself says does not. A remote paragraph counts only within the section, and only
    where the surface stands there once or the paragraph follows at once.
    """
    return _judged(occurrences).select(*occurrences.columns, "veto", "veto_span")


# ---------------------------------------------------------------- self-definitions


def self_definitions(occurrences: DataFrame) -> DataFrame:
    """The rows with chosen (entity_id that the text defines the occurrence as, or null), support (start, end of the
    sentence), anchor (start, end), evidence (relation and kind of what was found) and abstained (why nothing was chosen).

    The sentence must begin with the occurrence, or with a locative that says nothing, and assert a registered name or
    definition of it outside quotations of more; names of two entities, denials and repetitions in the paragraph and the
    next one abstain.
    """
    text, start, end, surface = (F.col(c) for c in ("text", "start", "end", "__surface"))
    rows = _framed(occurrences)
    first = F.get(F.filter(F.transform("__paras", lambda p, i: F.struct(p["start"].alias("start"), p["end"].alias("end"), i.alias("i"))), lambda p: (p["start"] <= start) & (start < p["end"])), F.lit(0))
    rows = rows.withColumn("__first", first).withColumn("__next", F.coalesce(F.get("__paras", F.col("__first.i") + 1), F.struct(F.col("__first.start").alias("start"), F.col("__first.end").alias("end"))))
    base, stop = F.col("__first.start"), F.col("__next.end")
    rows = rows.withColumn("__context", F.when(stop - base <= CONTEXT, cut(text, base, stop))).withColumn("__f", C.folded_places(F.coalesce("__context", F.lit(""))))
    # anchors, folded as the context is, of all candidates: one call for an occurrence
    named = F.flatten(F.transform("candidates", lambda c: F.array(*[F.struct(c["entity_id"].alias("entity_id"), F.lit(k).alias("kind"), c[k].alias("name"), F.lit(n).alias("least")) for k, n in (("canonical", LEAST_NAME), ("definition", LEAST_DEFINITION))])))
    rows = rows.withColumn("__named", F.filter(named, lambda a: a["entity_id"].isNotNull() & (F.coalesce(a["name"], F.lit("")) != "")))
    rows = rows.withColumn("__joined", F.array_join(F.transform("__named", lambda a: F.regexp_replace(a["name"], "\u0000", " ")), "\u0000")).withColumn("__all", F.split(C.folded_places("__joined")["folded"], "\u0000"))
    folded_names = F.transform(F.zip_with("__named", "__all", lambda a, f: F.struct(a["entity_id"].alias("entity_id"), a["kind"].alias("kind"), F.trim(f).alias("name"), a["least"].alias("least"))), lambda a: a)
    kept = F.filter(folded_names, lambda a: a["name"].isNotNull() & (F.length(F.regexp_replace(a["name"], r"[^\p{L}\p{N}]", "")) >= a["least"]))
    rows = rows.withColumn("__own", F.when(F.size("__named") > 0, kept).otherwise(F.array().cast("array<struct<entity_id:string,kind:string,name:string,least:int>>")))
    folded, places = F.col("__f.folded"), F.col("__f.places")
    before = lambda x: F.size(F.filter(places, lambda p: p < x - base))  # noqa: E731  code points of the folded context before a place
    sentences = F.flatten(F.transform(F.filter("__paras", lambda p: (base <= p["start"]) & (p["end"] <= stop)), lambda p: F.transform(T.sentence_spans(cut(text, p["start"], p["end"])), lambda s: F.struct((s["start"] + p["start"]).alias("start"), (s["end"] + p["start"]).alias("end")))))
    rows = rows.withColumn("__s", F.get(F.filter(sentences, lambda s: (s["start"] <= start) & (start < s["end"])), F.lit(0)))
    s0, s1 = F.col("__s.start"), F.col("__s.end")
    norm = lambda a, b: F.trim(F.substring(folded, before(a) + 1, F.greatest(before(b) - before(a), F.lit(0))))
    spots = F.flatten(F.transform("__own", lambda a: F.transform(
        F.filter(matching.places(folded, a["name"]), lambda i: (i == 0) | ~F.substring(folded, i, F.lit(1)).rlike(r"[\p{L}\p{N}]")),
        lambda i: F.struct((F.get(places, i) + base).alias("start"), (F.get(places, i + F.length(a["name"]) - 1) + 1 + base).alias("end"), a["kind"].alias("kind"), a["entity_id"].alias("entity_id")),
    )))
    rows = rows.withColumn("__spots", F.array_sort(spots)).withColumn("__seen", F.array_distinct(F.transform("__spots", lambda x: x["entity_id"])))
    # the sentence without registered names: the longer ones go first, so that none is left of a name in a name
    lengths = F.array_sort(F.transform("__own", lambda a: F.struct((-F.length(a["name"])).alias("n"), a["name"].alias("name"))))
    claim = F.aggregate(lengths, norm(s0, s1), lambda s, a: F.regexp_replace(s, F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), a["name"], F.lit(r"\E")), F.lit(" ")))
    rows = rows.withColumn("__claim", claim).withColumn("__q", quotations(cut(text, s0, s1)))
    quoted = lambda a, b: F.exists(F.col("__q.spans"), lambda q: (q["start"] + s0 < a) & (b < q["end"] + s0) & (norm(q["start"] + s0 + 1, q["end"] + s0 - 1) != norm(a, b)))
    leading = norm(s0, start)
    sound = ~F.col("__q.malformed") & ((leading == "") | leading.rlike(_u(LOCATIVE))) & ~quoted(start, end)
    rows = rows.withColumn("__sound", sound)
    relation = lambda x: F.when(
        norm(end, x["start"]).rlike(_u(SUBJECT)) & norm(x["end"], s1).rlike(_u(COPULA)), "DIRECT_REGISTERED_DEFINITION"
    ).when((norm(end, x["start"]) == "(") & norm(x["end"], s1).rlike(_u(NAME_END)), "DIRECT_REGISTERED_NAME")
    stated = F.transform(F.filter("__spots", lambda x: (s0 <= x["start"]) & (x["start"] < s1) & (x["start"] >= end) & ~quoted(x["start"], x["end"])), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["entity_id"].alias("entity_id"), relation(x).alias("relation")))
    rows = rows.withColumn("__hit", F.when(F.col("__sound"), F.get(F.filter(stated, lambda x: x["relation"].isNotNull()), F.lit(0))))
    ids = F.array_distinct(F.filter(F.transform("candidates", lambda c: c["entity_id"]), lambda x: x.isNotNull() & (x != "")))
    abstained = (
        F.when(surface.isNull(), "INVALID_TARGET_SPAN").when(F.size(ids) < 2, "NO_EXACT_COLLISION").when(F.col("__first").isNull(), "NO_TARGET_PARAGRAPH").when(F.size("__own") == 0, "NO_MEANINGFUL_REGISTERED_ANCHOR").when(F.col("__context").isNull(), "CONTEXT_BUDGET_EXCEEDED")
        .when(F.size(matching.places(F.col("__context"), surface)) != 1, "REPEATED_TARGET_IN_CONTEXT").when(F.col("__claim").rlike(_u(UNSUPPORTED)) | folded.rlike(_u(CONTRADICTED)), "UNSUPPORTED_OR_NEGATED_CONTEXT")
        .when(F.size("__seen") > 1, "COMPETING_REGISTERED_ANCHORS").when(F.col("__hit").isNull(), "NO_EXPLICIT_REGISTERED_DEFINITION")
    )
    rows = rows.withColumn("abstained", abstained)
    free = F.col("abstained").isNull()
    sentence = cut(text, s0, s1)
    lead, trail = F.length(sentence) - F.length(F.regexp_replace(sentence, r"(?U)^\s+", "")), F.length(F.regexp_replace(sentence, r"(?U)\s+$", ""))
    return rows.select(
        *occurrences.columns, F.when(free, F.col("__hit.entity_id")).alias("chosen"), F.when(free, F.struct((s0 + lead).alias("start"), (s0 + trail).alias("end"))).alias("support"), F.when(free, F.struct("__hit.start", "__hit.end")).alias("anchor"),
        F.when(free, F.concat_ws(":", "__hit.relation", "__hit.kind")).alias("evidence"), "abstained",
    )


# ---------------------------------------------------------------- supporting passages


def pairs(text: Column) -> Column:
    """Distinct lower-cased character pairs of the words of a text."""
    words = F.regexp_extract_all(text, F.lit("([0-9A-Za-z가-힣]+)"), F.lit(1))
    each = F.transform(words, lambda w: F.when(F.length(w) > 1, F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.lower(F.substring(w, i, F.lit(2))))).otherwise(_no_strings()))
    return F.array_distinct(F.flatten(each))


def selected(occurrences: DataFrame, scoped: bool = True, budget: int = BUDGET, supports: int = MOST_SUPPORTS) -> DataFrame:
    """The rows with passages (start, end, reason, in the order of the text), rendered (with the occurrence marked), allowed and refused.

    The occurrence's paragraph always; with ``scoped``, where the surface stands once in its section, the ``supports`` best
    other paragraphs of the section as well: those that are no denial, hold no quotation of more than a name, and share
    character pairs with what is registered of some candidate; ties go to the nearer, then to the earlier one. What does not
    fit the budget whole is refused, never clipped. Without ``scoped`` vetoes do not count.
    """
    text, start, end, anchors = (F.col(c) for c in ("text", "start", "end", "__anchors"))
    rows = _judged(occurrences)
    vocabularies = F.transform("candidates", lambda c: pairs(F.concat_ws(" ", c["canonical"], c["definition"])))
    names = F.array_distinct(F.concat(F.flatten(F.transform("candidates", lambda c: F.coalesce(c["aliases"], _no_strings()))), F.transform("candidates", lambda c: c["canonical"])))
    rows = rows.withColumn("__vocabularies", vocabularies).withColumn("__names", F.filter(names, lambda x: x.isNotNull()))

    def safe(fragment: Column) -> Column:
        q, outside = quotations(fragment), masked(fragment, anchors)
        more = F.exists(q["spans"], lambda s: ~F.array_contains("__names", stripped(cut(fragment, s["start"] + 1, s["end"] - 1))))
        return ~q["malformed"] & ~more & ~outside.rlike(_u(DENIED)) & ~outside.rlike(_u(REJECTED)) & denial(fragment, anchors).isNull()

    def score(fragment: Column) -> Column:
        own = pairs(fragment)
        return F.coalesce(F.array_max(F.transform(F.filter("__vocabularies", lambda v: F.size(own) + F.size(v) > 0), lambda v: 2.0 * F.size(F.array_intersect(own, v)) / (F.size(own) + F.size(v)))), F.lit(0.0))

    section, para = F.col("__section"), F.col("__para")
    others = F.filter("__paras", lambda p: (p["start"] != para["start"]) & (section["start"] <= p["start"]) & (p["start"] < section["end"]))
    ranked = F.array_sort(F.transform(F.filter(others, lambda p: safe(cut(text, p["start"], p["end"]))), lambda p: F.struct((-score(cut(text, p["start"], p["end"]))).alias("worse"), F.abs(p["start"] - start).alias("far"), p["start"].alias("start"), p["end"].alias("end"))))
    best = F.slice(F.filter(ranked, lambda p: p["worse"] < 0), F.lit(1), F.lit(supports))
    none = F.array().cast("array<struct<start:int,end:int,reason:string>>")
    more = F.transform(best, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), F.lit("REGISTERED_VOCABULARY_SUPPORT").alias("reason")))
    own = F.array(F.struct(para["start"].alias("start"), para["end"].alias("end"), F.lit("TARGET_PARAGRAPH").alias("reason")))
    whole = F.array_sort(F.concat(own, F.when(F.col("__once"), more).otherwise(none))) if scoped else own
    rows = rows.withColumn("passages", F.when(F.col("__surface").isNotNull() & para.isNotNull(), whole).otherwise(none))
    marked = F.concat(cut(text, para["start"], start), F.lit("[TARGET]"), cut(text, start, end), F.lit("[/TARGET]"), cut(text, end, para["end"]))
    rendered = F.array_join(F.transform("passages", lambda p: F.when(p["reason"] == "TARGET_PARAGRAPH", marked).otherwise(cut(text, p["start"], p["end"]))), "\n\n")
    rows = rows.withColumn("__rendered", rendered)
    over = F.length("__rendered") > budget
    refused = F.when(F.col("__surface").isNull(), "INVALID_TARGET_SPAN").when(para.isNull(), "NO_TARGET_PARAGRAPH").when(over, "CONTEXT_BUDGET_EXCEEDED")
    refused = F.coalesce(refused, F.col("veto")) if scoped else refused
    hidden = F.col("__surface").isNull() | para.isNull() | over
    return rows.select(*occurrences.columns, "passages", F.when(hidden, F.lit("")).otherwise(F.col("__rendered")).alias("rendered"), refused.isNull().alias("allowed"), refused.alias("refused"))
