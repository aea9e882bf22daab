"""Problem 9: template residue and error-page text.

Positive-unlabelled naive Bayes by expectation-maximisation. Each text is cut into passages of two kinds: lines and sentences,
with their words and beginnings of words as features, and *slots*, anything written in brackets or signs that might be a place to
fill in, with its signs, shape and words as features. Features are hashed into ``BUCKETS`` buckets, so the model has a fixed
size whatever the corpus. Trusted records give the positives: passages with a trusted phrase where such passages make up
half of their record (prose that only speaks of such things is no such record), and slots of a known placeholder form.
All others are unlabelled. Each round sums the features of all passages by how positive they are (in each partition first, then
by bucket), derives log-odds and the classes' priors from the sums, and scores all passages again: a passage's next weight is the
posterior of its whole record, so furniture and titles around notices follow their record; a slot's is its own. The rounds end when
the likelihood gains less than ``GAIN`` a feature.

Record decision: a passage's score is its features' log-odds over the root of their number; a record's log-odds are the prior's
and the mean score of its passages by length, times the root of their number; a slot's are its prior's and features'. The record is excluded if it, or a slot in it, is more likely residue than not.

Edge cases: null, empty and blank texts have no passages and are not excluded; repeated texts are judged alike; very long texts
are judged whole; an empty table gives no rows; without any trusted record nothing is excluded; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillflow.session import Workspace

#: Buckets of words, and behind them those of slots.
BUCKETS, SLOTS = 1 << 17, 1 << 12
#: Most rounds, and the gain of log-likelihood a feature under which they end.
ROUNDS, GAIN = 12, 1e-3
#: Features' worth of the corpus's own distribution that each class starts from; the most that a feature's log-odds and a passage's score say.
LEAN, CLIP, MOST = 20.0, 4.0, 8.0
OUT = ["doc_id", "score", "slot_score", "n_passages", "n_trusted", "n_slots"]
# Phrases of notices and filler that are trusted, in lower case.
NOTICES = (
    "not found", "access denied", "forbidden", "too many requests", "session expired", "sign in again", "sign in to", "enable javascript", "javascript is required",
    "needs javascript", "needs scripts", "requires javascript", "turn on scripts", "scripts to be switched on", "turn it on and reload", "does not run scripts", "stack trace:", "traceback (most recent",
    "fatal error:", "nullpointerexception", "keyerror:", "could not connect to database", "under maintenance", "will be back soon", "loading...", "checking your browser",
    "something went wrong", "do not have permission", "could not be found on this server", "you asked for is gone", "did not answer", "bad gateway", "internal server error",
    "service unavailable", "try again in", "please wait", "시작하려면 로그인", "불러오기에 실패", "불러오는 중", "찾을 수 없습니다", "존재하지 않는", "존재하지 않거나", "권한이 없는 사용자", "열람 권한이 없",
    "접근이 거부되었습니다", "접근 권한이", "접속자가 많아", "잠시 후 다시", "잠시만 기다려", "오류가 생겼습니다", "오류가 발생", "문제가 발생했습니다", "세션이 만료", "로그인이 필요", "로그인한 회원만",
    "로그인 후", "점검 시간:", "점검 중입니다", "삭제되었거나", "주소를 다시 확인", "표시할 수 없습니다", "자바스크립트를 허용해야", "javascript를 허용해야", "스크립트를 켜야", "스크립트를 허용하세요",
    "스크립트 실행을", "스크립트 차단을", "기능을 지원하는 브라우저", "자바스크립트 기능이 꺼져", "구형 브라우저", "새로 고침 하세요", "불편을 드려 죄송합니다", "<noscript>",
)
FILLER = (
    "lorem ipsum", "dolor sit amet", "consectetur", "adipiscing", "nostrud", "aliqua", "your text goes here", "replace this sample", "sample text", "placeholder text", "여기에 본문이 들어갑니다", "임시 문장", "샘플 텍스트", "실제 내용으로 바꿔",
    "텍스트를 추가하려면 클릭", "제목을 입력하십시오", "가나다라 마바사", "ㅁㄴㅇㄹ", "asdf", "qwer", "테스트 테스트",
)
TRUSTED = NOTICES + FILLER
# The forms of a place meant to be filled in.
HOLES = re.compile(
    r"\{\{[^{}\n]{1,60}\}\}|\{%[^{}\n]{1,60}\}|<%[^<>\n]{1,60}%>|[$#]\{[^{}\n]{1,60}\}|<<[^<>\n]{1,60}>>|\[\[[^\[\]\n]{1,60}\]\]|@@[^\s@]{1,40}@@|__[A-Z][A-Z0-9_]*__|%[A-Z][A-Z0-9_]+%"
    r"|(?<!#0 )\{[A-Za-z_가-힣][\w]*\}|\{\d\}|(?<![\w%])%[sd](?![\w%])|\[INSERT [^\[\]\n]{1,60}\]|\[[^\[\]\n]{1,40}(?:입력|기입|작성)[^\[\]\n]{0,12}\]|\(여기에 [^()\n]{1,40}(?:입력|기입|작성)[^()\n]{0,12}\)|<[^<>\n]{1,40} (?:입력|기입|작성)>"
)
# Bracketed and signed runs, whether or not they are places to fill in.
SLOT = re.compile(
    r"\{\{.{1,60}?\}\}|\{%.{1,60}?%\}|<%.{1,60}?%>|[$#]\{.{1,60}?\}|<<.{1,60}?>>|\[\[.{1,60}?\]\]|@@\S{1,40}?@@|__\w{1,40}?__|(?<![\w%])%\w{1,40}%|(?<![\w%])%[sd](?!\w)"
    r"|\{[^{}\n]{1,60}\}|\[[^\[\]\n]{1,60}\]|<[^<>\n]{1,60}>|\([^()\n]{1,60}\)"
)
_symbols = re.compile(r"[{}<>\[\]@%_#$(]")
_digits = re.compile(r"\d+").sub
_cut = re.compile(r"\n+|(?<=[.!?。！？])\s+")
_tokens = re.compile(r"[^\W_]+")
_shape = ((re.compile("[가-힣]+"), "가"), (re.compile("[a-z]+"), "a"), (re.compile("[A-Z]+"), "A"), (re.compile(r"\d+"), "0"), (re.compile(r"\s+"), " "))
_signs = re.compile(r"^[^\w\s]*").match
PASSAGES = "array<struct<trusted: boolean, slot: boolean, positive: boolean, feats: array<int>>>"
RECORDS = f"doc_id long, passages {PASSAGES}"


class _Buckets(dict):
    """Token to bucket(s); forgets all when it has grown large, so it stays small on any corpus."""

    def __missing__(self, token: str) -> tuple[int, ...]:
        if len(self) > 200_000:
            self.clear()
        h = lambda s: zlib.crc32(s.encode()) % BUCKETS
        got = (h(token), h("^" + token[:2])) if len(token) > 2 and token[0] >= "가" else (h(token),)
        self[token] = got
        return got


def _slot(slot: str) -> set[int]:
    """Features of a slot: its signs, its shape, and the words in it."""
    a, b = _signs(slot).group(), _signs(slot[::-1]).group()[::-1]
    shape = slot[len(a) : len(slot) - len(b)]
    for p, to in _shape:
        shape = p.sub(to, shape)
    said = {f"s{a}_{b}", f"o{a}", f"{a}_{b}:{shape.strip()}", *(f"w{t}" for t in _tokens.findall(slot.casefold()))}
    return {BUCKETS + zlib.crc32(x.encode()) % SLOTS for x in said}


def _passages(text: str, buckets: _Buckets) -> list[tuple[bool, bool, bool, set[int]]]:
    """(trusted, slot, positive, features) of each passage with a word, and of each slot."""
    if not text.isascii() and not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    out = []
    if _symbols.search(text):
        for m in SLOT.finditer(text):
            known = HOLES.fullmatch(m.group()) is not None
            out.append((known, True, known, _slot(m.group())))
        text = HOLES.sub(" ", text)
    low = text.casefold()
    known = [t for t in TRUSTED if t in low]
    got, weight, sure = [], 0, 0
    for p in _cut.split(_digits("0", low)):
        feats = {b for t in _tokens.findall(p) for b in buckets[t]}
        if feats:
            trusted = bool(known) and any(t in p for t in known)
            got.append((trusted, feats))
            weight += len(p)
            sure += len(p) if trusted else 0
    whole = sure * 2 >= weight
    return out + [(t, False, t and whole, f) for t, f in got]


def _lists(values: pa.Array, counts: list[int]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), values)


def records(documents: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Each text that has words, with its passages' features and labels in one array; no shuffle."""
    d = documents.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).filter(F.col("text").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _Buckets()
        for whole in batches:
            for a in range(0, whole.num_rows, 1000):
                b = whole.slice(a, 1000)
                ids, per, all_ = [], [], []
                for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                    got = _passages(t, buckets)
                    if got:
                        ids.append(i)
                        per.append(len(got))
                        all_ += got
                if not ids:
                    continue
                f = _lists(pa.array(np.concatenate([np.fromiter(x[3], np.int32, len(x[3])) for x in all_]), pa.int32()), [len(x[3]) for x in all_])
                flags = [pa.array([x[k] for x in all_], pa.bool_()) for k in range(3)]
                st = pa.StructArray.from_arrays([*flags, f], ["trusted", "slot", "positive", "feats"])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), _lists(st, per)], ["doc_id", "passages"])

    return d.mapInArrow(run, RECORDS)


class Model(NamedTuple):
    """Log-probabilities of each bucket in residue and in other text, and the log-odds of the classes, of records and of slots."""

    pos: np.ndarray
    neg: np.ndarray
    record: float
    slot: float


def _sum(v: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of runs of n values."""
    c = np.concatenate(([0.0], np.cumsum(v)))
    end = np.cumsum(n)
    return c[end] - c[end - n]


class _Batch:
    """A batch of records as flat arrays."""

    def __init__(self, ps: pa.ListArray):
        flat = ps.flatten()
        flag = lambda k: flat.field(k).to_numpy(zero_copy_only=False).astype(bool)
        self.n = np.diff(ps.offsets.to_numpy())
        self.trusted, self.slot, self.positive = flag("trusted"), flag("slot"), flag("positive")
        feats = flat.field("feats")
        self.f, self.m = feats.flatten().to_numpy(), np.diff(feats.offsets.to_numpy())

    def judge(self, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log-odds of each record by its text, of each passage that is a slot (elsewhere no weight), and of each record's likeliest slot."""
        odds = np.clip(m.pos - m.neg, -CLIP, CLIP)
        raw = _sum(odds[self.f], self.m)
        m_ = np.where(self.slot, 0, self.m)
        text = m_ * np.clip(raw / np.sqrt(np.maximum(self.m, 1)), -MOST, MOST)
        some = _sum((~self.slot).astype(float), self.n)
        record = np.where(some > 0, m.record + np.sqrt(some) * _sum(text, self.n) / np.maximum(_sum(m_, self.n), 1), -30.0)
        slot = np.where(self.slot, m.slot + raw, -30.0)
        most = np.maximum.reduceat(slot, np.cumsum(self.n) - self.n) if len(self.n) else np.zeros(0)
        return record, slot, most

    def weights(self, m: Model | None) -> np.ndarray:
        """How positive each passage is."""
        if m is None:
            return self.positive.astype(float)
        record, slot, _ = self.judge(m)
        return np.maximum(self.positive, np.where(self.slot, _sigmoid(slot), np.repeat(_sigmoid(record), self.n)))

    def likelihood(self, m: Model) -> float:
        """Log-likelihood of the passages' features under the mixture."""
        lp, ln = _sum(m.pos[self.f], self.m), _sum(m.neg[self.f], self.m)
        at = lambda x: np.concatenate((_sum(np.where(self.slot, 0.0, x), self.n), x[self.slot]))
        prior = np.concatenate((np.full(len(self.n), m.record), np.full(int(self.slot.sum()), m.slot)))
        p, n = at(lp) - np.logaddexp(0, -prior), at(ln) - np.logaddexp(0, prior)
        return float(np.logaddexp(p, n).sum())


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _fit(pos: np.ndarray, neg: np.ndarray, mass: np.ndarray) -> Model:
    """The model from the sums of features by class and the masses (residue, records, residue, slots)."""
    lp, ln = np.zeros(BUCKETS + SLOTS), np.zeros(BUCKETS + SLOTS)
    for part in (slice(0, BUCKETS), slice(BUCKETS, BUCKETS + SLOTS)):
        p, n = pos[part], neg[part]
        usual = (p + n) / max((p + n).sum(), 1.0)  # a feature is told apart from how common it is, however few the positives
        seen = usual > 0
        lp[part][seen] = np.log((p + LEAN * usual)[seen] / (p.sum() + LEAN))
        ln[part][seen] = np.log((n + LEAN * usual)[seen] / (n.sum() + LEAN))
    share = lambda a, b: float(np.clip((a + 0.5) / (b + 1), 1e-4, 0.9))
    logit = lambda p: float(np.log(p / (1 - p)))
    return Model(lp, ln, logit(share(mass[0], mass[1])), logit(share(mass[2], mass[3])))


def _sums(batches: Iterator[_Batch], m: Model | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of features by class; masses of residue and of all records and slots; likelihood and number of features."""
    pos, neg, mass = np.zeros(BUCKETS + SLOTS), np.zeros(BUCKETS + SLOTS), np.zeros(6)
    for b in batches:
        w = b.weights(m)
        each = np.repeat(w, b.m)
        pos += np.bincount(b.f, weights=each, minlength=BUCKETS + SLOTS)
        neg += np.bincount(b.f, weights=1 - each, minlength=BUCKETS + SLOTS)
        text = ~b.slot
        n = _sum(text.astype(float), b.n)
        mass += [float((_sum(w * text, b.n) / np.maximum(n, 1)).sum()), float((n > 0).sum()), float(w[b.slot].sum()), float(b.slot.sum()), b.likelihood(m) if m else 0.0, float(len(b.f))]
    return pos, neg, mass


def _learn(table: DataFrame, m: Model | None) -> tuple[Model, float]:
    """The next model from one pass over all passages, and the likelihood a feature under the last one."""
    old = table.sparkSession.sparkContext.broadcast(m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos, neg, mass = _sums((_Batch(b.column("passages")) for b in batches if b.num_rows), old.value)
        some = np.flatnonzero((pos > 0) | (neg > 0))
        at = np.concatenate((some, -1 - np.arange(len(mass))))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(np.concatenate((pos[some], mass))), pa.array(np.concatenate((neg[some], np.zeros(len(mass)))))], ["bucket", "pos", "neg"])

    got = table.select("passages").mapInArrow(run, "bucket int, pos double, neg double").groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    rows = got.toArrow()  # at most BUCKETS + SLOTS + 6 rows
    old.unpersist()
    pos, neg, mass = np.zeros(BUCKETS + SLOTS), np.zeros(BUCKETS + SLOTS), np.zeros(6)
    k, p, n = rows["bucket"].to_numpy(), rows["pos"].to_numpy(), rows["neg"].to_numpy()
    pos[k[k >= 0]], neg[k[k >= 0]], mass[-1 - k[k < 0]] = p[k >= 0], n[k >= 0], p[k < 0]
    return _fit(pos, neg, mass), mass[4] / max(mass[5], 1)


def residue(documents: DataFrame, doc_id: str, text: str, rounds: int = ROUNDS, ws: Workspace | None = None) -> DataFrame:
    """(doc_id, score, slot_score, n_passages, n_trusted, n_slots, excluded) of every text with a passage; no slot scores -30."""
    ws = ws or Workspace(documents.sparkSession, "residue")
    r = ws.save(records(documents, doc_id, text), "records")
    model, was = _learn(r, None)
    for _ in range(rounds - 1):
        model, now = _learn(r, model)
        if abs(now - was) < GAIN:
            break
        was = now
    last = documents.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _Batch(b.column("passages"))
            record, _, most = x.judge(last.value)
            count = lambda v: pa.array(_sum(v.astype(float), x.n).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(record), pa.array(most), count(~x.slot), count(x.trusted & ~x.slot), count(x.slot)], OUT)

    got = r.mapInArrow(judge, "doc_id long, score double, slot_score double, n_passages int, n_trusted int, n_slots int")
    return got.withColumn("excluded", (F.col("score") > 0) | (F.col("slot_score") > 0))
