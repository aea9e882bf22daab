"""Problem 2: broken prompt and response pairs.

Shortened versions are found by sorting: all answers and references, without punctuation, stand in one list of different
texts, once from each of their first ``STARTS`` words on, so that a misread beginning does not keep them apart. In the list's order
each answer is compared with its nearest finished neighbours (references and answers that end like a sentence) on either side; one that
shares its first ``lead`` letters with one of them may be a shortened version. Lengths at which far more answers
end than at the lengths around them (length-limit spikes) give further suspects. A suspect that is short enough is then
aligned with its own reference by banded dynamic programming over all prefixes: it counts as truncated if it reads like a
beginning of the reference and at least ``unwritten`` of the reference is missing behind it.
Copy, refusal and language rules follow for answers that do not read like the reference.

One defect per row, in this order: empty, truncated, copied_prompt, refusal, other_language.

Edge cases: a null or blank answer, or one of wrapping only, is ``empty``; a null or blank reference leaves out truncation and
language; a null prompt leaves out copying; repeated rows are judged alike; very long answers are judged whole; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillflow.functions.text import INVISIBLE, collapse_ends
from quillflow.session import Workspace

# Labels that models put before an answer.
LABELS = ("인식 결과", "인식된 텍스트", "출력", "출력 결과", "텍스트", "결과", "답변", "답", "전사", "전사 결과", "text", "output", "result", "answer", "transcription", "model", "assistant")
# What a refusal says it cannot do, in either language, and what makes a plain negation one.
CANNOT_KO = r"(못[했합하]|못 ?(읽|보|알아)|없(습니다|어요|네요|음|을 것)|어렵(습니다|네요|겠)|어려(울|워)|힘들(어|겠|습)|실패(했|하였)|불가(능|합)|거부|않도록 되어|않습니다|않은 것 같|안 되(어|는|네)|안 됩니다|권한 밖|받아들일 수|삼가|제한되어)"
ABOUT_KO = r"(이미지|사진|글씨|손글씨|텍스트|파일|화면|해상도|그림|내용|작업|요청|전사|필기|글자|문장|쪽|줄|언어 ?모델|저는|저에게|인공지능|AI|정책|개인 ?정보|도와)"
SORRY_KO = r"(죄송|미안|사과드|유감|안타깝|양해)"
POLITE_KO = r"(니다|어요|아요|네요|세요|까요|군요|죠|드립니다)[\s\p{P}ㅠㅜ~]*$"
CANNOT_EN = r"(?i)\b(can ?not|can['’]?t|could ?n['’]?t|could not|unable|not able|won['’]?t|will not|not (possible|permitted|allowed)|do(es)? ?n['’]?t|do not|refuse|decline|no (image|text|handwriting))\b"
ABOUT_EN = r"(?i)\b(image|picture|photo|handwrit\w*|text|line|page|pages|file|request|task|help|assist|read|transcribe|decipher|process|make out|recogni[sz]e|language model|AI|see|view)\b"
SELF_EN = r"(?i)(\bI\b|\bI['’](m|ll|ve)|\bsorry\b|\bapologi[sz]e|\bunfortunately\b|\blanguage model\b|\bassistant\b)"
#: A sentence's end; dots that trail off are none.
END = r"(?<![.…])[.!?。！？][\s\p{P}&&[^.…]]*$"
#: From how many of their first words on texts are sorted; texts that split the order into ranges.
STARTS, POINTS = 4, 4_000
#: Words that carry no content, by language; enough to tell languages of one script apart.
FUNCTION_WORDS = {
    "en": "the of and a an to in on at by near behind before after beyond opposite inside with was is are were that this it his her my our their your one two for from while during",
    "es": "el la los las de del en un una y al por para con mi su que se es fue era junto detrás cerca",
    "fr": "le la les de des du en un une et au aux par pour avec mon ma son sa que se est dans sur près",
    "de": "der die das den dem des ein eine einen und im am mit von zu auf für ist war mein sein nicht bei",
    "it": "il lo la i gli le di del della in un una e al per con mio suo che si è era nel vicino",
    "pt": "o a os as de do da em um uma e ao por para com meu seu que se é era no na perto",
    "vi": "một của và ở bên cạnh gần sau trong những các là đã tôi người cái chiếc ngày hôm",
}


def unwrap(raw: Column) -> Column:
    """The answer without thoughts, fences, image marks, labels and quotes around it; '' if nothing is left."""
    s = F.regexp_replace(F.coalesce(raw, F.lit("")), INVISIBLE, "")
    s = F.regexp_replace(s, r"(?is)<think>.*?(</think>|$)", "")
    s = F.regexp_replace(s, r"(?i)</?(image|img|answer|output|text|s|pad|bos|eos)\s*/?>", "")
    s = F.regexp_replace(s, r"(?m)```[A-Za-z0-9_-]*", "")
    quotes = r"^[\s\p{P}`\x22]+$"
    label = r"(?iu)^[\s\"'“”‘’*#>]*(" + "|".join(LABELS) + r")\s*[:：]\s*"
    s = collapse_ends(F.regexp_replace(collapse_ends(s), label, ""))
    s = F.regexp_replace(s, r"^[\"'“”‘’`]+|[\"'“”‘’`]+$", "")
    return F.get(F.transform(F.array(s), lambda x: F.when(x.rlike(quotes), "").otherwise(collapse_ends(x))), F.lit(0))  # s is worked out once


def compact(c: Column) -> Column:
    """Letters, digits and marks in lower case."""
    return F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), INVISIBLE, "")), r"[^\p{L}\p{N}\p{M}]+", "")


def language(c: Column) -> Column:
    """ko, ja, zh, another script's name, a language of Latin script where its words tell, 'latin', or null without letters."""
    c = F.coalesce(c, F.lit(""))
    n = lambda p: F.regexp_count(c, F.lit(p))
    letters = F.greatest(n(r"\p{L}"), F.lit(1))
    kana, han, hangul, latin, cyr = n(r"[぀-ヿ]"), n(r"\p{IsHan}"), n(r"\p{IsHangul}"), n(r"\p{IsLatin}"), n(r"\p{IsCyrillic}")
    toks = F.split(F.lower(F.regexp_replace(c, r"[^\p{L}\p{M}]+", " ")), " ")
    said = lambda v: F.size(F.filter(toks, lambda t: t.isin(v.split())))
    hits = {k: said(v) for k, v in FUNCTION_WORDS.items()}
    best = F.array_max(F.array(*(F.struct(v.alias("n"), F.lit(k).alias("lang")) for k, v in hits.items())))
    return (
        F.when(n(r"\p{L}") == 0, F.lit(None).cast("string"))
        .when((kana > 0) & ((kana + han) * 2 > letters), "ja")
        .when(hangul * 2 > letters, "ko")
        .when(han * 2 > letters, "zh")
        .when(latin * 2 > letters, F.when(best["n"] > 0, best["lang"]).otherwise("latin"))
        .when(cyr * 2 > letters, "cyrillic")
        .otherwise("other")
    )


def _starts(c: Column, whole: Column) -> Column:
    """``whole`` (the letters of c) from each of the first ``STARTS`` words of c on; only those words are looked at again."""
    first = r"^\s*" + r"(\S*)\s*" * (STARTS - 1)
    at, out = F.lit(1), [whole]
    for n in range(1, STARTS):
        at = at + F.length(compact(F.regexp_extract(c, first, n)))
        out.append(F.substr(whole, at))
    return F.array_distinct(F.array(*out))


def _buckets(listed: DataFrame, per: int) -> tuple[DataFrame, int]:
    """The list with ranges of its order as ``bucket``. The split points come from a sample of ``POINTS`` texts and only spread the work."""
    n = listed.count()
    k = min(POINTS // 8, -(-n // per))
    if k < 2:
        return listed.withColumn("bucket", F.lit(0)), 1
    some = sorted(r["t"] for r in listed.select(F.substring("t", 1, 64).alias("t"), F.xxhash64("t").alias("h")).orderBy("h").limit(POINTS).collect())
    points = sorted({some[i * len(some) // k] for i in range(1, k)})

    @F.pandas_udf(T.IntegerType())
    def at(t: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_right(points, x) for x in t], dtype="int32")

    return listed.withColumn("bucket", at(F.col("t"))), len(points) + 1


def neighbours(listed: DataFrame, ws: Workspace, per: int = 10_000) -> DataFrame:
    """(t, before, after) of each different text ``t``: the nearest texts with ``whole`` on either side of it in sorted order.

    Ranges of the order are sorted each on its own, and what stands before and after a range is carried into it, so no opening,
    however common, makes a task larger.
    """
    one = ws.save(listed.groupBy("t").agg(F.max("whole").alias("whole")), "listed")
    one, n = _buckets(one, per)
    one = one.withColumn("w", F.when(F.col("whole"), F.col("t")))
    up = Window.partitionBy("bucket").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy("bucket").orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, -1)
    near = one.withColumn("before", F.max("w").over(up)).withColumn("after", F.min("w").over(down))
    if n > 1:
        ends = one.groupBy("bucket").agg(F.max("w").alias("last"), F.min("w").alias("first"))  # a row per bucket
        left, right = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.select("bucket", F.max("last").over(left).alias("carried"), F.min("first").over(right).alias("ahead"))
        near = near.join(F.broadcast(ends), "bucket").select("t", F.coalesce("before", "carried").alias("before"), F.coalesce("after", "ahead").alias("after"))
    return near.select("t", "before", "after")


def shortened(texts: DataFrame, key: str, text: str, whole: str, lead: int = 3, ws: Workspace | None = None, letters: Column | None = None) -> DataFrame:
    """Keys of texts that share at least ``lead`` letters of prefix, from one of their first words on, with a neighbour in sorted order that is ``whole``.

    ``letters``: the texts' letters, where they are at hand.
    """
    ws = ws or Workspace(texts.sparkSession, "sorted")
    rows = texts.select(F.col(key).alias("k"), F.coalesce(text, F.lit("")).alias("x"), F.col(whole).alias("whole"), (compact(F.col(text)) if letters is None else letters).alias("letters"))
    at = ws.save(rows.select("k", F.explode(_starts(F.col("x"), F.col("letters"))).alias("t"), "whole").filter(F.length("t") >= lead), "starts")
    near = neighbours(at, ws)
    shares = lambda n: F.coalesce(F.col(n).startswith(F.left("t", F.lit(lead))), F.lit(False))
    short = near.filter(shares("before") | shares("after")).select("t")
    return at.filter("k IS NOT NULL").join(short, "t").select(F.col("k").alias(key)).distinct()


def length_spikes(texts: DataFrame, text: str, around: int = 10, times: float = 6.0, least: int = 20) -> DataFrame:
    """Lengths (column ``spike``) at which far more answers end than within ``around`` of it."""
    h = texts.select(F.length(text).alias("n")).groupBy("n").count()
    other = h.select(F.col("n").alias("m"), F.col("count").alias("c"))
    near = h.select("n", "count", F.explode(F.sequence(F.col("n") - around, F.col("n") + around)).alias("m")).filter("m <> n").join(other, "m", "left")
    g = near.groupBy("n", "count").agg(F.avg(F.coalesce("c", F.lit(0))).alias("usual"))
    return g.filter((F.col("count") >= least) & (F.col("count") > F.greatest(F.lit(1.0), F.col("usual")) * times)).select(F.col("n").alias("spike"))


def _prefix_fit(a: str, g: str, misread: float) -> tuple[float, int]:
    """(distance, j): the prefix g[:j] that ``a`` is nearest to, the longest on ties; only within ``misread`` edits a letter, else (inf, 0)."""
    k = int(len(a) * misread)
    gs = np.frombuffer(g.encode("utf-32-le"), dtype=np.uint32)
    far, idx = len(a) + len(g) + 1, np.arange(2 * k + 1)
    row = np.where(idx >= k, idx - k, far)  # place x of row i is the prefix of i - k + x letters
    pad = np.concatenate((np.zeros(k, np.uint32), gs, np.zeros(k + len(a) + 1, np.uint32)))
    for i, ch in enumerate(a, 1):
        new = row + (pad[i - 1 : i + 2 * k] != ord(ch))  # the letter before place x
        np.minimum(new[:-1], row[1:] + 1, out=new[:-1])
        row = np.minimum.accumulate(new - idx) + idx
        if i % 16 == 0 and row.min() > k:
            return float("inf"), 0
    row[(idx + len(a) - k < 0) | (idx + len(a) - k > len(g))] = far
    best = int(row.min())
    x = int(len(row) - 1 - np.argmin(row[::-1]))
    return (float(best), len(a) - k + x) if best <= k else (float("inf"), 0)


def reads_as_beginning(answer: Column, reference: Column, misread: float) -> Column:
    """A struct (distance, reach): how far the answer is from the beginning of the reference it fits best, and how much of the reference that is; (inf, 0) beyond ``misread`` edits a letter."""

    @F.pandas_udf(T.StructType([T.StructField("distance", T.DoubleType()), T.StructField("reach", T.IntegerType())]))
    def fit(a: pd.Series, g: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_prefix_fit(x, y, misread) for x, y in zip(a, g)], columns=["distance", "reach"])

    return fit(answer, reference)


def defects(rows: DataFrame, key: str, raw: str, prompt: str, reference: str, unwritten: float = 0.25, misread: float = 0.35, ws: Workspace | None = None) -> DataFrame:
    """(key, defect_type) of each row whose answer is no usable answer."""
    c = lambda n: F.col(f"`{n}`")
    base = rows.select(c(key).alias("k"), unwrap(c(raw)).alias("answer"), c(prompt).alias("prompt"), c(reference).alias("ref"))
    base = base.withColumn("a", compact(F.col("answer"))).withColumn("g", compact(F.col("ref")))
    # Written once: every later step uses these texts, and a plan would run their patterns again at each use.
    ws = ws or Workspace(rows.sparkSession, "answers")
    base = ws.save(base, "texts")

    empty = base.filter(F.col("a") == "").select("k", F.lit("empty").alias("defect_type"))
    # Whether a symbol-only answer is empty is decided by its letters and digits; a reference without any keeps it.
    some = base.filter(F.col("a") != "")

    # Suspects of truncation: both ways of the method, and of them those short enough to leave so much unwritten.
    none = F.lit(None).cast(base.schema["k"].dataType).alias("k")
    listed = some.select("k", F.col("answer").alias("t"), F.col("answer").rlike(END).alias("whole"), F.col("a").alias("letters")).unionByName(base.select(none, F.col("ref").alias("t"), F.lit(True).alias("whole"), F.col("g").alias("letters")))
    cut = shortened(listed, "k", "t", "whole", ws=ws, letters=F.col("letters")).withColumn("cut", F.lit(True))
    spikes = length_spikes(some.filter(~F.col("answer").rlike(END)), "a")
    short = (F.length("g") > 0) & (F.length("a") * (1 - misread) <= F.length("g") * (1 - unwritten))
    judged = some.filter(short).join(cut, "k", "left").join(spikes, F.length("a") == F.col("spike"), "left").filter(F.col("cut").isNotNull() | F.col("spike").isNotNull())
    # A beginning that leaves so much unwritten is at least so far from the answer: where the whole reference is as near, it is the better fit.
    past = F.floor(F.length("a") - F.length("g") * (1 - unwritten)).cast("int")
    judged = judged.filter((past < 0) | (F.call_function("levenshtein", F.col("a"), F.col("g"), F.greatest(past, F.lit(0))) < 0))
    most = F.floor(F.length("a") * (2 * misread)).cast("int")  # so far from the reference's first letters a beginning can be at most
    judged = judged.filter(F.call_function("levenshtein", F.col("a"), F.expr("substring(g, 1, length(a))"), most) >= 0).select("k", "a", "g")
    judged = ws.save(judged, "suspects")  # or the alignment would be moved before the joins, to every answer
    tried = judged.select("k", F.length("a").alias("na"), F.length("g").alias("ng"), reads_as_beginning(F.col("a"), F.col("g"), misread).alias("f"))
    truncated = tried.filter((F.col("f.distance") <= F.col("na") * misread) & (F.col("ng") - F.col("f.reach") >= F.col("ng") * unwritten)).select("k", F.lit("truncated").alias("defect_type")).distinct()
    truncated = ws.save(truncated, "truncated")

    # The rest: only answers that do not read like the reference, in whole or at their beginning.
    def near(x: Column, y: Column, th: float) -> Column:
        """Within th edits a character, at every length; lengths too far apart need no distance, and no row of one leaves the band of th."""
        most = F.greatest(F.length(x), F.length(y)) * th
        within = F.call_function("levenshtein", x, y, F.floor(most).cast("int")) >= 0  # -1 beyond
        return F.when(F.abs(F.length(x) - F.length(y)) > most, False).otherwise(within)

    head = F.substring(F.col("a"), F.lit(1), F.length("g"))
    # Narrow bands first: most answers are told by them.
    like = F.when(F.length("g") == 0, False).when(head == F.col("g"), True).when(near(head, F.col("g"), 0.1), True).otherwise(near(head, F.col("g"), 0.5))
    other = some.filter(~like)
    role = F.regexp_replace("answer", r"(?iu)^[\s\p{P}<>]*[\p{L} ]{1,14}\s*[:：\-–—]\s+", "")
    own = compact(role)
    sentences = F.filter(F.transform(F.split("prompt", r"(?<=[.!?。？！])\s+"), lambda s: compact(s)), lambda s: F.length(s) > 3)
    whole = F.array(compact(F.col("prompt")))
    said = F.concat(F.coalesce(sentences, F.array().cast("array<string>")), whole)
    copied = F.exists(said, lambda s: (F.length(s) > 3) & (near(F.col("a"), s, 0.25) | near(own, s, 0.25)))
    text = F.col("answer")
    refusal = (text.rlike(SORRY_KO) & (text.rlike(CANNOT_KO) | text.rlike(ABOUT_KO)) & text.rlike(POLITE_KO)) | (text.rlike(CANNOT_KO) & text.rlike(ABOUT_KO) & text.rlike(POLITE_KO))
    refusal = refusal | (text.rlike(CANNOT_EN) & text.rlike(ABOUT_EN) & text.rlike(SELF_EN))
    la, lg = language(text), language(F.col("ref"))
    differs = la.isNotNull() & lg.isNotNull() & (la != lg) & ~((la == "latin") & lg.isin(*FUNCTION_WORDS)) & ~((lg == "latin") & la.isin(*FUNCTION_WORDS))
    kind = F.when(copied, "copied_prompt").when(refusal, "refusal").when(differs, "other_language")
    rest = other.select("k", kind.alias("defect_type")).filter(F.col("defect_type").isNotNull())
    rest = rest.join(truncated.select("k"), "k", "left_anti")
    return empty.unionByName(truncated).unionByName(rest).select(F.col("k").alias(key), "defect_type")
