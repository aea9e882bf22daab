"""SQL fragments that mirror the text functions, for the SQL counterparts."""

from __future__ import annotations

BLANK = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}\x{0b}]"


def canon(x: str) -> str:
    return f"trim(regexp_replace(replace(replace(nfc_normalize(coalesce({x}, '')), chr(8203), ''), chr(65279), ''), '{BLANK}+', ' ', 'g'))"


def nopunct(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({canon(x)}, '\\p{{P}}', '', 'g'), '{BLANK}+', ' ', 'g'))"


def clean_answer(x: str) -> str:
    """An answer without thoughts, fence, label and quotes; canonical."""
    ends = lambda s: f"regexp_replace({s}, '^{BLANK}+|{BLANK}+$', '', 'g')"
    bare_ = ends(f"regexp_replace(coalesce({x}, ''), '(?s)<think>.*?</think>', '', 'g')")
    unfenced = f"(SELECT CASE WHEN starts_with(s, '```') AND ends_with(s, '```') THEN regexp_replace(s, '(?i)^```(text)?{BLANK}*|{BLANK}*```$', '', 'g') ELSE s END FROM (SELECT {bare_} AS s))"
    said = f"regexp_replace({ends(unfenced)}, '^(인식(된)?{BLANK}*(결과|텍스트)|출력|텍스트){BLANK}*[:：]{BLANK}*', '')"
    plain = f"""(SELECT CASE WHEN length(s) >= 2 AND left(s, 1) = right(s, 1) AND left(s, 1) IN ('"', '\'\'', '“', '”') THEN substring(s, 2, length(s) - 2) ELSE s END FROM (SELECT {said} AS s))""".replace("\\'\\'", "''")
    return canon(plain)


def bare(x: str) -> str:
    """Without blanks."""
    return f"regexp_replace(coalesce({x}, ''), '{BLANK}+', '', 'g')"


def count_of(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all(coalesce({x}, ''), '{pattern}'))"


def words(x: str) -> str:
    return f"len(list_filter(regexp_split_to_array(coalesce({x}, ''), '{BLANK}+'), lambda w: w <> ''))"


def key(namespace: str, x: str) -> str:
    return f"sha256('{namespace}:' || CAST({x} AS VARCHAR))"


def lev(a: str, b: str) -> str:
    """Edit distance in code points."""
    return f"""list_reduce(list_transform(string_split({a}, ''), lambda ch: [ord(ch)::int]),
      lambda p, ch: list_reduce(list_transform(range(1, len(string_split({b}, '')) + 1), lambda j: [j::int]),
        lambda acc, j: list_append(acc, least(acc[-1] + 1, p[j[1] + 1] + 1, p[j[1]] + (CASE WHEN ch[1] = ord(string_split({b}, '')[j[1]]) THEN 0 ELSE 1 END))::int), [p[1] + 1]),
      list_transform(range(0, len(string_split({b}, '')) + 1), lambda j: j::int))[-1]"""


def distances(pairs: str) -> str:
    """(t1, t2, d) of a table of pairs t1, t2: the longer text is walked outside, which costs much less."""
    return f"""(SELECT t1, t2, CASE WHEN t1 = t2 THEN 0 WHEN t1 = '' OR t2 = '' THEN length(t1) + length(t2) ELSE {lev('s1', 's2')} END AS d
      FROM (SELECT t1, t2, CASE WHEN length(t1) >= length(t2) THEN t1 ELSE t2 END AS s1, CASE WHEN length(t1) >= length(t2) THEN t2 ELSE t1 END AS s2 FROM {pairs}))"""
