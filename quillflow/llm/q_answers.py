"""Queries of problem 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillflow.llm import answers as A
from quillflow.llm.answers import defects
from quillflow.plans import sqltext as S
from quillflow.plans.registry import Registry
from quillflow.session import table

R = Registry()


_BLANK = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}\x{0b}]"
_HIDDEN = "[\\p{Cf}\u115f\u1160\u3164\uffa0\ufe00-\ufe0f\u034f\u180b-\u180d]"


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _ends(x: str) -> str:
    return f"regexp_replace({x}, '^{_BLANK}+|{_BLANK}+$', '', 'g')"


def _compact(x: str) -> str:
    return f"regexp_replace(lower(regexp_replace(coalesce({x}, ''), '{_HIDDEN}', '', 'g')), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+', '', 'g')"


def _unwrapped(x: str) -> str:
    for pattern in (_HIDDEN, "(?is)<think>.*?(</think>|$)", r"(?i)</?(image|img|answer|output|text|s|pad|bos|eos)\s*/?>", "(?m)```[A-Za-z0-9_-]*"):
        x = f"regexp_replace({x}, {_q(pattern)}, '', 'g')"
    x = _ends(f"regexp_replace({_ends(x)}, {_q('(?i)^[' + chr(92) + 's' + chr(34) + chr(39) + '“”‘’*#>]*(' + '|'.join(A.LABELS) + ')' + chr(92) + 's*[:：]' + chr(92) + 's*')}, '')")
    return f"regexp_replace({x}, {_q('^[' + chr(34) + chr(39) + '“”‘’`]+|[' + chr(34) + chr(39) + '“”‘’`]+$')}, '', 'g')"


def _lang(x: str) -> str:
    n = lambda p: f"len(regexp_extract_all({x}, '{p}'))"
    toks = f"string_split(lower(regexp_replace({x}, '[^\\p{{L}}\\p{{M}}]+', ' ', 'g')), ' ')"
    hits = ", ".join(f"{{'n': len(list_filter({toks}, lambda w: list_contains({v.split()!r}, w))), 'l': '{k}'}}" for k, v in A.FUNCTION_WORDS.items())
    letters = n("\\p{L}")
    return f"""CASE WHEN {letters} = 0 THEN NULL WHEN {n('[぀-ヿ]')} > 0 AND ({n('[぀-ヿ]')} + {n(chr(92) + 'p{Han}')}) * 2 > {letters} THEN 'ja' WHEN {n(chr(92) + 'p{Hangul}')} * 2 > {letters} THEN 'ko' WHEN {n(chr(92) + 'p{Han}')} * 2 > {letters} THEN 'zh'
      WHEN {n(chr(92) + 'p{Latin}')} * 2 > {letters} THEN (SELECT CASE WHEN b.n > 0 THEN b.l ELSE 'latin' END FROM (SELECT list_max([{hits}]) AS b)) WHEN {n(chr(92) + 'p{Cyrillic}')} * 2 > {letters} THEN 'cyrillic' ELSE 'other' END"""


def _near(x: str, y: str, th: float) -> str:
    return f"(abs(length({x}) - length({y})) <= greatest(length({x}), length({y})) * {th} AND (CASE WHEN {x} = {y} THEN 0 WHEN {x} = '' OR {y} = '' THEN length({x}) + length({y}) ELSE {S.lev(x, y)} END) <= greatest(length({x}), length({y})) * {th})"


_SAYS = lambda *ps: "(" + " AND ".join(f"regexp_matches(answer, {_q(p)})" for p in ps) + ")"
_FLAT = ", ".join(f"'{k}'" for k in A.FUNCTION_WORDS)
#: The same rules, but every answer that is short enough is aligned with its reference: sorting and spikes play no part.
_DEFECTS = f"""
    WITH u AS (SELECT pred_id, prompt, ground_truth AS ref, {_unwrapped("coalesce(raw_prediction, '')")} AS s FROM strict_error_prediction),
    b AS (SELECT pred_id, prompt, ref, CASE WHEN regexp_matches(s, '^[\\s\\p{{P}}`"]+$') THEN '' ELSE {_ends('s')} END AS answer FROM u),
    t AS (SELECT *, {_compact('answer')} AS ta, {_compact('ref')} AS tg, {_compact('prompt')} AS tp FROM b),
    given AS (SELECT *, substring(ta, 1, length(tg)) AS head, {_compact("regexp_replace(answer, '(?i)^[" + chr(92) + "s" + chr(92) + "p{P}<>]*[" + chr(92) + "p{L} ]{1,14}" + chr(92) + "s*[:：" + chr(92) + "-–—]" + chr(92) + "s+', '')")} AS own FROM t WHERE ta <> ''),
    fit AS (SELECT pred_id, length(ta) AS na, length(tg) AS ng, {S.lev('ta', 'tg').removesuffix('[-1]')} AS r FROM given WHERE tg <> '' AND length(ta) * 0.65 <= length(tg) * 0.75),
    truncated AS (SELECT pred_id FROM (SELECT pred_id, na, ng, list_min(r) AS d, len(r) - list_position(list_reverse(r), list_min(r)) AS reach FROM fit) WHERE d <= na * 0.35 AND ng - reach >= ng * 0.25),
    other AS (SELECT * FROM given WHERE NOT (tg <> '' AND {_near('head', 'tg', 0.5)})),
    said AS (SELECT pred_id, ta, own, unnest(list_append(list_transform(regexp_split_to_array(regexp_replace(coalesce(prompt, ''), '([.!?。？！])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: {_compact('x')}), tp)) AS ts FROM other),
    copied AS (SELECT DISTINCT pred_id FROM said WHERE length(ts) > 3 AND ({_near('ta', 'ts', 0.25)} OR {_near('own', 'ts', 0.25)})),
    kinds AS (SELECT pred_id, CASE WHEN pred_id IN (SELECT pred_id FROM copied) THEN 'copied_prompt' WHEN ({_SAYS(A.SORRY_KO, A.POLITE_KO)} AND ({_SAYS(A.CANNOT_KO)} OR {_SAYS(A.ABOUT_KO)})) OR {_SAYS(A.CANNOT_KO, A.ABOUT_KO, A.POLITE_KO)} OR {_SAYS(A.CANNOT_EN, A.ABOUT_EN, A.SELF_EN)} THEN 'refusal'
      WHEN la <> lg AND NOT (la = 'latin' AND lg IN ({_FLAT})) AND NOT (lg = 'latin' AND la IN ({_FLAT})) THEN 'other_language' END AS k FROM (SELECT *, {_lang('answer')} AS la, {_lang("coalesce(ref, '')")} AS lg FROM other)),
    found AS (SELECT pred_id, 'empty' AS defect_type FROM t WHERE ta = '' UNION ALL SELECT pred_id, 'truncated' FROM truncated UNION ALL SELECT pred_id, k FROM kinds WHERE k IS NOT NULL AND pred_id NOT IN (SELECT pred_id FROM truncated))
"""


@R.add("p2_found", _DEFECTS + "SELECT pred_id, defect_type FROM found")
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "strict_error_prediction").select("pred_id", "raw_prediction", "prompt", "ground_truth")
    return defects(t, "pred_id", "raw_prediction", "prompt", "ground_truth")


@R.add("p2_counts", _DEFECTS + "SELECT model_name, defect_type, count(*) AS n FROM found JOIN strict_error_prediction USING (pred_id) GROUP BY ALL")
def p2_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Defects per model and kind."""
    t = table(spark, sf, "strict_error_prediction")
    return p2_found(spark, sf).join(t.select("pred_id", "model_name"), "pred_id").groupBy("model_name", "defect_type").agg(F.count("*").alias("n"))
