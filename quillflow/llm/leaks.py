"""Problem 7: evaluation texts leaking into training text.

All items of a block go into generalised suffix automata over their normalised characters (one character form, no case,
blanks or punctuation, so that line breaks, spacing and spelling forms do not matter), one per kind of script. Every
document is streamed past them whole, character by character, and the longest matching length is tracked at each place. Where it
reaches ``SEED``, the suffix links lead to the state of the last ``SEED`` characters, whose range of end places names every
item that has them, not just the one that matches longest; the matches that neither end carries on are each item's own longest
matches, in pairs of ranges.

An item's matches are chained along near diagonals into passages, so single altered words or characters do not break a
passage. Passages longer than what templates and common phrases share count, shorter ones where ``SEVERAL`` stand in the item's
own order, and a document leaks an item whose passages cover ``COVER`` of it, ``DENSE`` of that letter by letter (chance meetings of
common words along a diagonal skip more). Passages skip at most SKIP - SEED
characters between matches, and matches further apart in the document join none: items whose matches cannot reach ``COVER`` by these
bounds are left out before they are chained, and none is passed over. ``spans`` gives the raw character ranges, ``without_spans`` the texts less them.

The items are a stated query set: they are read in blocks of at most ``block_chars`` characters, ``AT_ONCE`` of which are broadcast
for one scan of the documents, so what is broadcast is bounded whatever the set (some 25 MB a block of 200,000 characters).

Edge cases: null, empty and blank texts neither leak nor hold anything; items shorter than ``PASSAGE`` must stand in the
document whole, and those shorter than ``SEED`` are never found; repeated items and documents each get their own rows; very long
texts are streamed whole; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillflow.llm.charforms import fold

SEED, PASSAGE = 5, 18
#: Shorter runs count where several stand in the item's own order.
RUN, SEVERAL = 8, 3
#: All lengths are for scripts that write a syllable or word in a character; letters of alphabets count less.
LETTER = 2.5
#: A passage may skip so many characters (altered words), and drift by so many.
SKIP, DRIFT = 14, 6
#: Half of the item; and so much of that half letter by letter, in passages.
COVER, DENSE = 0.5, 0.8
#: Blocks of items for one scan; most pairs of places held at a time; characters of documents worked on at a time.
AT_ONCE, PAIRS, CHARS = 4, 2_000_000, 200_000
FOUND = T.StructType(
    [
        T.StructField("item_id", T.LongType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("coverage", T.DoubleType()),
        T.StructField("passages", T.IntegerType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
    ]
)
#: Texts of these alone need no other form: what is no letter or digit among them falls away.
_settled = re.compile("[\x00-\x7f가-힣ㄱ-ㅎㅏ-ㅣ“”‘’…·—–©「」『』]*").fullmatch
_other = re.compile(r"[\W_]+").sub
_cluster = re.compile("[ᄀ-ᅟ][ᅠ-ᆧ]?[ᆨ-ᇿ]?|.[̀-ͯ]*", re.S).finditer


def scale(text: str) -> float:
    """How many characters of this text say as much as one syllable."""
    return 1.0 if sum(c >= "\u1100" for c in text) * 2 >= len(text) else LETTER


def normal(text: str) -> str:
    """The characters that count, in one form."""
    return _other("", text if _settled(text) else fold(text)).casefold()


def places(text: str) -> tuple[str, list[int], list[int]]:
    """The same, with the raw start and end of each character."""
    out, a, b = [], [], []
    if _settled(text):
        a = [i for i, c in enumerate(text) if c.isalnum()]
        return "".join(text[i] for i in a).casefold(), a, [i + 1 for i in a]
    for m in _cluster(text):
        for c in _other("", fold(m.group())).casefold():
            out.append(c)
            a.append(m.start())
            b.append(m.end())
    return "".join(out), a, b


class Automaton:
    """Generalised suffix automaton; every state knows the range of its end places in the texts."""

    def __init__(self, texts: list[str], width: int):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        state, place, at = [], [], 1
        for t in texts:
            last = 0
            for c in t:
                last = self._add(last, c)
                state.append(last)
                place.append(at)
                at += 1
            at += 1  # a sign between texts
        self._range(np.array(state, dtype=np.int64), np.array(place, dtype=np.int64))
        self._loci(width)

    def _add(self, last: int, c: str) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        cur = self._state({}, self.length[last] + 1, 0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return cur

    def _state(self, nxt: dict[str, int], length: int, link: int) -> int:
        self.next.append(nxt)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, c: str, q: int) -> int:
        new = self._state(dict(self.next[q]), self.length[p] + 1, self.link[q])
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def _range(self, state: np.ndarray, place: np.ndarray) -> None:
        """``ends``: all places in an order in which those below a state in the tree of links stand together, from ``lo`` to ``hi``."""
        n = len(self.next)
        own = np.bincount(state, minlength=n)
        size, link = own.copy(), self.link
        order = sorted(range(1, n), key=self.length.__getitem__)
        for v in reversed(order):
            size[link[v]] += size[v]
        lo, used = np.zeros(n, dtype=np.int64), own.copy()
        for v in order:  # each state's own places first, then its children's, one after another
            up = link[v]
            lo[v] = lo[up] + used[up]
            used[up] += size[v]
        first = lo[state]
        by = np.argsort(first, kind="stable")
        rank = np.arange(len(by)) - np.searchsorted(first[by], first[by])
        self.ends = np.zeros(len(place), dtype=np.int64)
        self.ends[first[by] + rank] = place[by]
        self.lo, self.hi = lo, lo + size

    def _loci(self, width: int) -> None:
        """The state of the last ``width`` characters of whatever a state stands for; -1 for shorter ones."""
        self.width = width
        locus = [-1] * len(self.next)
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__):
            if self.length[v] >= width:
                up = self.link[v]
                locus[v] = v if self.length[up] < width else locus[up]
        self.locus = np.array(locus, dtype=np.int64)

    def __getstate__(self):
        """Transitions as flat arrays, which are smaller and quicker to send."""
        rest = {k: v for k, v in self.__dict__.items() if k != "next"}
        count = np.array([len(d) for d in self.next], dtype=np.int32)
        signs = "".join(c for d in self.next for c in d)
        return rest, count, signs, np.array([t for d in self.next for t in d.values()], dtype=np.int32)

    def __setstate__(self, got) -> None:
        rest, count, signs, to = got
        self.__dict__.update(rest)
        to, at, self.next = to.tolist(), 0, []
        for n in count.tolist():
            self.next.append(dict(zip(signs[at : at + n], to[at : at + n])))
            at += n

    def stream(self, text: str, width: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(end, length, state) of the longest match at each place where it is at least ``width`` (the automaton's own)."""
        width = width or self.width
        nxt, link, length = self.next, self.link, self.length
        ends, lengths, states = [], [], []
        known = re.compile("[" + "".join(map(re.escape, nxt[0])) + "]{%d,}" % width) if nxt[0] else re.compile("(?!)")
        for stretch in known.finditer(text):  # characters of no item end every match
            s = n = 0
            for i, c in enumerate(stretch.group(), stretch.start() + 1):
                t = nxt[s].get(c)
                if t is None:
                    while s:
                        s = link[s]
                        t = nxt[s].get(c)
                        if t is not None:
                            n = length[s] + 1
                            s = t
                            break
                    else:
                        n = 0
                        continue
                else:
                    s = t
                    n += 1
                if n >= width:
                    ends.append(i)
                    lengths.append(n)
                    states.append(s)
        return np.array(ends, dtype=np.int64), np.array(lengths, dtype=np.int64), np.array(states, dtype=np.int64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


class Group:
    """The items of one kind of script, by number, with their automaton."""

    def __init__(self, items: list[tuple[int, str]], factor: float):
        self.ids, self.texts, self.factor = [i for i, _ in items], [t for _, t in items], factor
        self.width = int(SEED * factor)
        self.gap = SKIP * factor - self.width  # the most that a passage skips between two matches
        self.automaton = Automaton(self.texts, self.width)
        self.codes = _codes("\1" + "".join(t + "\1" for t in self.texts))
        self.first = np.cumsum([1] + [len(t) + 1 for t in self.texts])[:-1]
        self.item = np.repeat(np.arange(len(self.texts)), [len(t) + 1 for t in self.texts])

    def matches(self, joined: str) -> np.ndarray:
        """Columns (start, place, length): every item's own longest matches of at least ``width`` in a text that begins and ends with a sign of no item."""
        a, w = self.automaton, self.width
        end, _, state = a.stream(joined)
        if not len(end):
            return np.zeros((0, 3), dtype=np.int64)
        codes, locus = _codes(joined), a.locus[state]
        count = a.hi[locus] - a.lo[locus]
        total = np.concatenate(([0], np.cumsum(count)))
        begun, k = [], 0
        while k < len(end):  # so many windows at a time that the pairs of places stay bounded
            to = max(k + 1, int(np.searchsorted(total, total[k] + PAIRS, side="right")) - 1)
            c = count[k:to]
            i = np.repeat(end[k:to] - w, c)
            p = a.ends[np.repeat(a.lo[locus[k:to]] - (total[k:to] - total[k]), c) + np.arange(len(i))] - w + 1
            new = codes[i - 1] != self.codes[p - 1]
            begun.append(np.stack((i[new], p[new]), axis=1))
            k = to
        b = np.concatenate(begun)
        size, more = np.full(len(b), w), np.arange(len(b))
        while len(more):  # signs between texts end every match
            more = more[codes[b[more, 0] + size[more]] == self.codes[b[more, 1] + size[more]]]
            size[more] += 1
        return np.column_stack((b, size))

    def passages(self, item: int, matches: list[tuple[int, int, int]], least: float = 0.0) -> list[tuple[int, int, int, int]]:
        """(start, end, from, to): passages of the text and of the item that read alike, from its matches (start, place, length) in the text's order.

        None if all together are shorter than ``least``.
        """
        seed, skip, drift = self.width, SKIP * self.factor, DRIFT * self.factor
        open_, done = [], []
        for i, p, n in matches:
            if open_:
                done += [c for c in open_ if i - c[1] > skip]
                open_ = [c for c in open_ if i - c[1] <= skip]
            for c in reversed(open_):  # a chain near whose diagonal this match lies; c: start, last seed, from, last seed's place, weight
                t = max(0, c[1] + 1 - i, c[3] + 1 - p)
                if t <= n - seed and i + t - c[1] <= skip and p + t - c[3] <= skip and abs((i - p) - (c[1] - c[3])) <= drift:
                    c[4] += min(p + t - c[3], seed) + n - t - seed
                    c[1], c[3] = i + n - seed, p + n - seed
                    break
            else:
                open_.append([i, i + n - seed, p, p + n - seed, n])
        need = min(PASSAGE * self.factor, len(self.texts[item]))
        runs = [(c[0], c[1] + seed, c[2], c[3] + seed, c[4]) for c in done + open_ if c[4] >= min(RUN * self.factor, need)]
        if sum(r[3] - r[2] for r in runs) < least:
            return []
        row = _in_order(runs, seed)
        kept = {r for r in runs if r[4] >= need} | set(row if len(row) >= SEVERAL else [])
        return [r[:4] for r in sorted(kept)]

    @staticmethod
    def exact(matches: list[tuple[int, int, int]], passages: list[tuple[int, int, int, int]]) -> int:
        """Characters of the item that are matched within its passages."""
        return _cover([(p, p + n) for i, p, n in matches if any(a <= i and i + n <= b and c <= p and p + n <= d for a, b, c, d in passages)])

    def leaked(self, texts: list[str], cover: float) -> Iterator[tuple[int, int, float, list[tuple[int, int, int, int]]]]:
        """(text, item, share, passages) of each text that holds enough of an item."""
        m = self.matches("\0" + "".join(t + "\0" for t in texts))
        if not len(m):
            return
        first = np.cumsum([1] + [len(t) + 1 for t in texts])[:-1]
        d, k = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])[m[:, 0] - 1], self.item[m[:, 1] - 1]
        m = m - np.stack((first[d], self.first[k], np.zeros(len(m), dtype=np.int64)), axis=1)
        key = d * len(self.texts) + k
        size = np.array([len(t) for t in self.texts])
        # What passages of these matches can cover at most: their lengths and what may be skipped between them ...
        bound, exact = np.bincount(key, weights=m[:, 2] + self.gap) - self.gap, np.bincount(key, weights=m[:, 2])
        need = cover * size[np.arange(len(bound)) % len(size)]
        some = np.flatnonzero(((bound >= need) & (exact >= DENSE * need))[key])
        some = some[np.lexsort((m[some, 1], m[some, 0], key[some]))]
        if not len(some):
            return
        # ... and nearer: only where matches that a passage can join weigh as much as the least passage that counts.
        ks, i, n = key[some], m[some, 0], m[some, 2]
        far = np.maximum.accumulate(ks * (1 << 40) + i + n - self.width) - ks * (1 << 40)  # the last seed so far of the same pair
        new = np.concatenate(([True], (np.diff(ks) > 0) | (i[1:] - far[:-1] > SKIP * self.factor)))
        part = np.cumsum(new) - 1
        weight = np.bincount(part, weights=n)
        most = np.bincount(part, weights=n + self.gap) - self.gap
        slight = weight < np.minimum(RUN * self.factor, size[ks[new] % len(self.texts)])
        most[slight] = weight[slight] = 0
        pair, of = np.unique(ks, return_inverse=True)
        bound, exact = np.bincount(of[new], weights=most), np.bincount(of[new], weights=weight)
        need = cover * size[pair % len(self.texts)]
        some = some[((bound >= need) & (exact >= DENSE * need))[of] & ~slight[part]]
        edge = np.flatnonzero(np.concatenate(([True], np.diff(key[some]) > 0, [True]))) if len(some) else []
        for a, b in zip(edge[:-1], edge[1:]):
            item = int(k[some[a]])
            own = list(map(tuple, m[some[a:b]].tolist()))
            got = self.passages(item, own, cover * len(self.texts[item]))
            share = _cover([(p, q) for _, _, p, q in got]) / len(self.texts[item])
            if share >= cover and self.exact(own, got) >= DENSE * cover * len(self.texts[item]):
                yield int(d[some[a]]), item, share, got


class Block:
    """One block of items, ready to be broadcast."""

    def __init__(self, ids: list[int], texts: list[str]):
        by: dict[float, list[tuple[int, str]]] = {}
        for i, t in zip(ids, map(normal, texts)):
            if t:
                by.setdefault(scale(t), []).append((i, t))
        self.groups = [Group(v, f) for f, v in by.items()]


def _in_order(runs: list[tuple[int, int, int, int, int]], lap: int) -> list[tuple[int, int, int, int, int]]:
    """The heaviest runs (start, end, from, to, weight) that follow each other in the text and in the item, there with at most ``lap`` shared."""
    if not runs:
        return []
    size = max(r[3] for r in runs) + 1
    tree: list[tuple[int, int]] = [(0, -1)] * (size + 1)  # prefix maxima over the item's places
    best, back = [0] * len(runs), [-1] * len(runs)
    ended = sorted(range(len(runs)), key=lambda k: runs[k][1])
    e = 0
    for k in sorted(range(len(runs)), key=lambda k: runs[k][0]):
        start, _, a, _, weight = runs[k]
        while runs[ended[e]][1] <= start:
            j, e = ended[e], e + 1
            x = runs[j][3] + 1
            while x <= size:
                tree[x] = max(tree[x], (best[j], j))
                x += x & -x
        top, x = (0, -1), min(a + min(lap, weight - 1) + 1, size)
        while x:
            top = max(top, tree[x])
            x -= x & -x
        best[k], back[k] = top[0] + weight, top[1]
    k, out = max(range(len(runs)), key=best.__getitem__), []
    while k >= 0:
        out.append(runs[k])
        k = back[k]
    return out[::-1]


def _cover(spans: list[tuple[int, int]]) -> int:
    total, end = 0, -1
    for a, b in sorted(spans):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


def _scan(blocks: list[Block], docs: pd.DataFrame, cover: float, with_spans: bool = True) -> list[tuple]:
    raw = [t if isinstance(t, str) else "" for t in docs["text"]]
    texts, ids, out = [normal(t) for t in raw], docs["doc_id"].to_numpy(), []
    where: dict[int, tuple[str, list[int], list[int]]] = {}
    for g in (g for b in blocks for g in b.groups):
        for k, item, share, got in g.leaked(texts, cover):
            if not with_spans:
                out.append((g.ids[item], int(ids[k]), float(share), len(got), None))
                continue
            if k not in where:
                where[k] = places(raw[k])
            spans = sorted({(where[k][1][a], where[k][2][b - 1]) for a, b, _, _ in got if b <= len(where[k][0])})
            out.append((g.ids[item], int(ids[k]), float(share), len(got), [{"start": a, "end": b} for a, b in spans]))
    return out


def _slices(texts: pd.Series) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``CHARS`` characters; a longer text is a range of its own."""
    a = n = 0
    for k, t in enumerate(texts):
        n += len(t) if isinstance(t, str) else 0
        if n >= CHARS:
            yield a, k + 1
            a, n = k + 1, 0
    if a < len(texts):
        yield a, len(texts)


def leaks(documents: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, cover: float = COVER, block_chars: int = 200_000, with_spans: bool = True) -> DataFrame:
    """(item_id, doc_id, coverage, passages, spans) of every document that holds enough of an item; spans null if not ``with_spans``."""
    spark = documents.sparkSession
    docs = documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    q = items.select(F.col(f"`{item_id}`").cast("long").alias("id"), F.col(f"`{item_text}`").alias("t")).filter(F.length("t") > 0)
    chars = q.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-chars // block_chars))
    out = None
    for first in range(0, blocks, AT_ONCE):
        shared = []
        for b in range(first, min(blocks, first + AT_ONCE)):
            part = q.filter(F.pmod(F.xxhash64("id", "t"), F.lit(blocks)) == b).collect()
            shared.append(spark.sparkContext.broadcast(Block([r["id"] for r in part], [r["t"] for r in part])))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                got = []
                for a, b in _slices(pdf["text"]):
                    got += _scan([x.value for x in shared], pdf.iloc[a:b], cover, with_spans)
                yield pd.DataFrame(got, columns=FOUND.names)

        df = docs.mapInPandas(run, FOUND)
        out = df if out is None else out.unionByName(df)
    return out


def without_spans(documents: DataFrame, doc_id: str, text: str, found: DataFrame) -> DataFrame:
    """(doc_id, text): each document less the spans that ``found`` (of ``leaks``) names; the others as they are."""
    d = documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    s = found.groupBy("doc_id").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    kept = F.aggregate(
        "spans",
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, x: F.struct(
            F.concat(acc["out"], F.when(x["start"] > acc["at"], F.substring(F.col("text"), acc["at"] + 1, x["start"] - acc["at"])).otherwise("")).alias("out"),
            F.greatest(acc["at"], x["end"]).alias("at"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))),
    )
    return d.join(s, "doc_id", "left").select("doc_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(kept).alias("text"))
