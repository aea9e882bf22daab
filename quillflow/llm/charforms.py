"""Problem 5: visually identical text with different characters.

``one_form`` brings text to one form of its characters in plain DataFrame steps: texts with any
character outside the settled ones are exploded into positioned code points, a broadcast join
replaces each by what it is made of (canonical decomposition, wide and narrow forms, kinds of
blank, look-alike letters; invisible characters become nothing), marks that follow a letter are
put in the order of their combining classes, the pieces are recomposed by the pair tables of
Unicode (a letter with its marks, a Hangul syllable with its parts), and the string is rebuilt.
Texts of settled characters only are already in that form. All tables are derived from the
Unicode data of the running interpreter; their size is bounded by Unicode itself (some 17,000
rows), which is what makes the broadcast safe at any corpus size.

What counts as the same: canonical forms, <wide> and <narrow> forms, every blank (runs of blanks
are one gap, none at the ends), characters that take no room, and letters of
other scripts that look like Latin ones.
What stays different: ligatures, circled or raised forms, case, punctuation with another look.

Edge cases: null stays null; '' and blank text become ''; very long texts are only as long as
their own array; repeated rows and extra columns pass through.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillflow.session import Workspace

# Letters that look like a Latin letter, and marks that look like an ASCII one.
CYRILLIC = dict(zip("АВЕКМНОРСТХУІЈЅаеорсухіјѕһԁԛԝ", "ABEKMHOPCTXYIJSaeopcyxijshdqw"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονυ", "ABEZHIKMNOPTYXovu"))
MORE_GREEK = dict(zip("αικρϲϳ", "aikpcj"))
ARMENIAN = dict(zip("ՍՕօհոսզցյ", "UOohnuqgj"))
COPTIC = dict(zip("ⲞⲟⲢⲣⲤⲥⲔⲘⲚⲦⲬⲎⲂ", "OoPpCcKMNTXHB"))
CHEROKEE = dict(zip("ᎪᎬᎻᎫᎠᎡᎢᏀᏃᎷᏚᏟᏢᎳᏙᏦᏞᏴᏏᎥ", "AEHJDRTGZMSCPWVKLBbi"))
LATIN = dict(zip("ɑɡıᴏᴄᴠᴡᴢ", "agiocvwz"))
MARKS = {"‐": "-", "‑": "-", "ʼ": "’", "․": "."}
LOOKS = CYRILLIC | GREEK | MORE_GREEK | ARMENIAN | COPTIC | CHEROKEE | LATIN | MARKS

#: Hangul syllable arithmetic of the Unicode standard.
S0, L0, V0, T0, LN, VN, TN = 0xAC00, 0x1100, 0x1161, 0x11A7, 19, 21, 28


def _gone(c: str) -> bool:
    """Characters that take no room."""
    o = ord(c)
    return unicodedata.category(c) == "Cf" or o in (0x115F, 0x1160, 0x3164, 0xFFA0, 0x034F) or 0xFE00 <= o <= 0xFE0F or 0x180B <= o <= 0x180D or 0xE0100 <= o <= 0xE01EF


@functools.cache
def alone_jamo() -> dict[str, str]:
    """A conjoining part that stands alone -> its letter of the same look (by name)."""
    out = {}
    for o in (*range(0x1100, 0x1113), *range(0x1161, 0x1176), *range(0x11A8, 0x11C3)):
        name = unicodedata.name(chr(o)).split(" ", 2)[2]
        try:
            out[chr(o)] = unicodedata.lookup(f"HANGUL LETTER {name}")
        except KeyError:
            pass
    return out


@functools.cache
def piece_of(c: str) -> str:
    """What a character is made of, by the rules above; itself if nothing applies."""
    o = ord(c)
    if c.isspace() or unicodedata.category(c) == "Zs" or o == 0x2800:
        return " "
    if _gone(c):
        return ""
    d = unicodedata.decomposition(c)
    if d.startswith(("<wide>", "<narrow>")):
        return "".join(piece_of(chr(int(x, 16))) for x in d.split()[1:])
    if d and d[0] != "<" or S0 <= o < S0 + LN * VN * TN:
        return "".join(LOOKS.get(x, x) for x in unicodedata.normalize("NFD", c))
    return LOOKS.get(c, c)


@functools.cache
def pieces() -> list[tuple[str, str, int]]:
    """(character, pieces, combining class) wherever one of both says something; syllables apart (by arithmetic)."""
    out = []
    for o in range(sys.maxunicode + 1):
        if 0xD800 <= o < 0xE000 or S0 <= o < S0 + LN * VN * TN:
            continue
        c = chr(o)
        p = piece_of(c)
        if p != c or unicodedata.combining(c):
            out.append((c, p, unicodedata.combining(c)))
    return out


@functools.cache
def pairs() -> dict[str, str]:
    """Letter + mark -> composed letter."""
    out = {}
    for o in range(sys.maxunicode + 1):
        if 0xD800 <= o < 0xE000 or S0 <= o < S0 + LN * VN * TN:
            continue
        d = unicodedata.decomposition(chr(o))
        if d and d[0] != "<" and " " in d and unicodedata.normalize("NFC", chr(o)) == chr(o):
            out["".join(chr(int(x, 16)) for x in d.split())] = chr(o)
    return out


def fold(text: str | None) -> str | None:
    """The same form in plain Python, for operators that already run there."""
    if text is None:
        return None
    s = unicodedata.normalize("NFC", unicodedata.normalize("NFD", "".join(piece_of(c) for c in text)))
    alone = alone_jamo()
    return " ".join(x for x in "".join(alone.get(c, c) for c in s).split(" ") if x)


#: Texts of these alone are in their form already, but for runs of blanks: ASCII without controls, Hangul syllables and
#: letters, and punctuation of one look.
SETTLED = r"^[\x20-\x7e가-힣ㄱ-ㅎㅏ-ㅣ“”‘’…·]*$"


def _piece_table(spark: SparkSession) -> DataFrame:
    schema = T.StructType([T.StructField("ch", T.StringType()), T.StructField("to", T.StringType())])
    return spark.createDataFrame([(c, p) for c, p, _ in pieces()], schema)


def _class_table(spark: SparkSession) -> DataFrame:
    schema = T.StructType([T.StructField("mark", T.StringType()), T.StructField("ccc", T.IntegerType())])
    return spark.createDataFrame([(c, k) for c, _, k in pieces() if k], schema)


def _pair_map() -> Column:
    """``pairs`` as one constant."""
    return F.create_map(*(F.lit(x) for kv in pairs().items() for x in kv))


def _composed(cluster: Column, table: Column) -> Column:
    """A letter with its marks (structs ccc, p; in order): each mark that no kept one of its class stands before is taken in where the pair exists."""
    start = F.struct(cluster[0]["p"].alias("letter"), F.lit("").alias("rest"), F.lit(0).alias("last"))

    def take(acc: Column, x: Column) -> Column:
        whole = F.when(acc["last"] != x["ccc"], F.try_element_at(table, F.concat(acc["letter"], x["p"])))
        return F.when(whole.isNotNull(), F.struct(whole.alias("letter"), acc["rest"].alias("rest"), acc["last"].alias("last"))).otherwise(
            F.struct(acc["letter"].alias("letter"), F.concat(acc["rest"], x["p"]).alias("rest"), x["ccc"].alias("last"))
        )

    return F.aggregate(F.slice(cluster, F.lit(2), F.greatest(F.size(cluster) - 1, F.lit(0))), start, take, lambda acc: F.concat(acc["letter"], acc["rest"]))


def _code(c: Column) -> Column:
    """Code point of a one-character string (ascii() gives it for any character)."""
    return F.ascii(c)


def _hangul(s: Column) -> Column:
    """Joins parts into syllables: leading + vowel (+ trailing), in a string of pieces."""
    def lv(run: Column) -> Column:
        a, b, c = (_code(F.substring(run, k, 1)) for k in (1, 2, 3))
        return _chr(S0 + ((a - L0) * VN + (b - V0)) * TN + F.when(F.length(run) > 2, c - T0).otherwise(0))

    parts = F.regexp_extract_all(s, F.lit("([\\u1100-\\u1112][\\u1161-\\u1175][\\u11A8-\\u11C2]?|[\\s\\S])"), F.lit(1))
    whole = F.transform(parts, lambda p: F.when(F.length(p) > 1, lv(p)).otherwise(p))
    return F.array_join(whole, "")


def _chr(code: Column) -> Column:
    """The character of a code point of the basic plane above U+07FF, by its UTF-8 bytes."""
    code = code.cast("int")
    hx = F.concat(F.lpad(F.hex(F.lit(0xE0) + F.shiftright(code, 12)), 2, "0"), F.lpad(F.hex(F.lit(0x80) + F.shiftright(code, 6).bitwiseAND(F.lit(0x3F))), 2, "0"), F.lpad(F.hex(F.lit(0x80) + code.bitwiseAND(F.lit(0x3F))), 2, "0"))
    return F.decode(F.unhex(hx), "UTF-8")


def one_form(texts: DataFrame, key: str, text: str, ws: Workspace | None = None) -> DataFrame:
    """(key, form) of each row; ``key`` tells the rows apart (repeat it and the texts must be the same).

    One exchange of the texts by key; exploding, the broadcast joins and the rebuilding stay
    within that partitioning, which keeps its number of partitions, since texts grow much when exploded.
    Only texts that are not settled take part. Sequences are written once and read by each way to go on.
    """
    spark = texts.sparkSession
    rows = texts.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    calm = F.col("t").isNull() | F.col("t").rlike(SETTLED)
    plain = rows.filter(calm).select("k", "t")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    odd = rows.filter(~calm).repartition(parts, "k").groupBy("k").agg(F.first("t").alias("t"))
    ch = odd.select("k", F.posexplode(F.split("t", "")).alias("pos", "ch"))
    got = ch.join(F.broadcast(_piece_table(spark)), "ch", "left").select("k", "pos", F.coalesce("to", _syllable_parts("ch"), "ch").alias("to"))
    # A piece may hold a letter and marks; each becomes a place of its own, in order.
    part = got.select("k", "pos", F.posexplode(F.filter(F.split("to", ""), lambda x: x != "")).alias("sub", "p"))
    part = part.join(F.broadcast(_class_table(spark)), F.col("p") == F.col("mark"), "left").select("k", "pos", "sub", "p", F.coalesce("ccc", F.lit(0)).alias("ccc"))
    seq = part.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("pos", "sub", "p", "ccc"))).alias("seq"))
    # Clusters: a starter and the marks after it, ordered by class, then by place; its letter takes them in.
    starts = F.filter(F.sequence(F.lit(0), F.size("seq") - 1), lambda i: (F.get("seq", i)["ccc"] == 0) | (i == 0))
    plain_marks = ~F.exists("seq", lambda x: x["ccc"] > 0)
    bounds = F.arrays_zip(starts.alias("a"), F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(F.size("seq"))).alias("b"))
    sorted_ = lambda z: F.array_sort(F.transform(F.slice("seq", z["a"] + 1, z["b"] - z["a"]), lambda x: F.struct(x["ccc"].alias("ccc"), x["pos"].alias("pos"), x["sub"].alias("sub"), x["p"].alias("p"))))
    table = _pair_map()
    marked = F.array_join(F.transform(bounds, lambda z: _composed(sorted_(z), table)), "")
    flat = seq.select("k", F.when(plain_marks, F.array_join(F.transform("seq", lambda x: x["p"]), "")).otherwise(marked).alias("flat"))
    flat = (ws or Workspace(spark, "forms")).save(flat, "sequences")
    alone = alone_jamo()
    form = F.translate(_hangul(F.col("flat")), "".join(alone), "".join(alone.values()))
    done = flat.select("k", form.alias("f")).unionByName(odd.join(flat, "k", "left_anti").select("k", F.lit("").alias("f")))
    gap = lambda c: F.trim(F.regexp_replace(c, " +", " "))
    return plain.select("k", gap(F.col("t")).alias("f")).unionByName(done.select("k", gap(F.col("f")).alias("f"))).select(F.col("k").alias(key), F.col("f").alias("form"))


def _syllable_parts(c: str) -> Column:
    """The parts of a Hangul syllable; null for anything else."""
    s = _code(F.col(c)) - S0
    lead, vowel, tail = (s / (VN * TN)).cast("int") + L0, ((s % (VN * TN)) / TN).cast("int") + V0, (s % TN).cast("int") + T0
    return F.when((s >= 0) & (s < LN * VN * TN), F.concat(_chr(lead), _chr(vowel), F.when(tail == T0, "").otherwise(_chr(tail))))
