"""p10: abusive, hateful or sexual passages by FTRL-proximal logistic regression.

A document is scored by its passages (sentences and lines): features are hashed
word n-grams and skip-grams, weights come from FTRL-proximal with per-coordinate
rates and L1 sparsity, so the table that is broadcast is a fixed number of
buckets. Labels are of whole documents; the passages that made a document
harmful are found by alternating: after a first pass, only the best passages
of a harmful document stay positive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from . import textvec

BITS = 20
#: Bounds of the labelled sample that the model is fitted on, by class; rows are taken in the order of a hash of the key and
#: weighted against the bounds.
MAX_POSITIVE, MAX_NEGATIVE = 2000, 3000
ALPHA, BETA, L1, L2, EPOCHS = 0.3, 1.0, 0.3, 0.1, 2

# Characters that stand for others in disguised spelling.
INVISIBLE = dict.fromkeys([0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x00AD])
LOOKALIKE = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "ı": "i"}
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"}
TABLE = INVISIBLE | {ord(k): v for k, v in LOOKALIKE.items()}

IN_WORD = re.compile(r"(?<=[a-z])[013457@$!|]+(?=[a-z])|(?<=[a-z])\$+(?![\w$])|(?<![\w.])[@$](?=[a-z]{2})")
STARRED = re.compile(r"(?<=[a-z])[*#]+(?=[a-z])")
SPACED = re.compile(r"(?<![a-z0-9])(?:[a-z][ .\-_*]){3,}[a-z](?![a-z0-9])")
REPEATED = re.compile(r"([a-z])\1{2,}")
CJK = re.compile(r"([㐀-鿿豈-﫿぀-ヿ])")
STOP = np.zeros(256, bool)
STOP[list(b".!?\n;")] = True


def normalise(text: str) -> str:
    """Lower case, without invisible characters; look-alikes, digits for letters, spaced and drawn-out letters read as words."""
    t = text.lower()
    if not t.isascii():
        t = t.translate(TABLE)
        t = t.replace("。", ".").replace("！", "!").replace("？", "?").replace("；", ";")
        t = CJK.sub(r" \1 ", t)
    t = SPACED.sub(lambda m: re.sub(r"[^a-z]", "", m.group()), t)
    t = IN_WORD.sub(lambda m: "".join(LEET.get(c, c) for c in m.group()), t)
    t = STARRED.sub("", t)
    return REPEATED.sub(r"\1", t)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, passage, row of passage): hashed 1- to 3-grams and 1-skip bigrams within passages."""
    w = textvec.Words(texts, textvec.ANY_WORD, fold=False)
    ends = np.concatenate([[0], np.cumsum(STOP[w.buf])])
    passage_of_word = ends[w.start]
    new = np.ones(len(w.start), bool)
    new[1:] = (passage_of_word[1:] != passage_of_word[:-1]) | (w.row[1:] != w.row[:-1])
    passage = np.cumsum(new) - 1
    h = w.hash
    parts, own = [h], [passage]
    with np.errstate(over="ignore"):
        for gap, mult in ((1, 3), (2, 5)):
            if len(h) > gap:
                same = passage[gap:] == passage[:-gap]
                pair = textvec.mix(h[:-gap] * np.uint64(mult) + h[gap:] * np.uint64(mult + 8))
                parts.append(pair[same])
                own.append(passage[gap:][same])
        if len(h) > 2:
            same = passage[2:] == passage[:-2]
            tri = textvec.mix(h[:-2] * np.uint64(7) + h[1:-1] * np.uint64(11) + h[2:] * np.uint64(13))
            parts.append(tri[same])
            own.append(passage[2:][same])
    return (np.concatenate(parts) & np.uint64((1 << BITS) - 1)).astype(np.int64), np.concatenate(own), w.row[new]


class Ftrl:
    """FTRL-proximal logistic regression, updated in small batches."""

    def __init__(self):
        self.z = np.zeros(1 << BITS)
        self.n = np.zeros(1 << BITS)

    def weights(self, at: np.ndarray | None = None) -> np.ndarray:
        z, n = (self.z, self.n) if at is None else (self.z[at], self.n[at])
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def fit(self, bucket: np.ndarray, starts: np.ndarray, y: np.ndarray, weight: np.ndarray, order: np.ndarray, batch: int = 64) -> None:
        ends = np.append(starts[1:], len(bucket))
        for k in range(0, len(order), batch):
            rows = order[k : k + batch]
            idx = np.concatenate([bucket[starts[r] : ends[r]] for r in rows])
            seg = np.repeat(np.arange(len(rows)), ends[rows] - starts[rows])
            w = self.weights(idx)
            p = 1 / (1 + np.exp(-np.clip(np.bincount(seg, w, len(rows)) + INTERCEPT, -30, 30)))
            g = ((p - y[rows]) * weight[rows])[seg]
            np.add.at(self.z, idx, g)
            uniq, inv = np.unique(idx, return_inverse=True)
            g2 = np.bincount(inv, g * g)
            old = self.n[uniq]
            self.z[uniq] -= (np.sqrt(old + g2) - np.sqrt(old)) / ALPHA * self.weights(uniq)
            self.n[uniq] = old + g2


#: The log-odds of a passage of which nothing is known.
INTERCEPT = -4.0


def train(texts: list[str], y: np.ndarray, share: np.ndarray | None = None, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights per bucket and the score from which a document counts as harmful.

    Two halves of the documents judge each other: a passage of a harmful
    document stays positive if the model of the other half finds it harmful,
    so a benign document labelled harmful by mistake teaches nothing. The
    threshold has the best F1 on the scores that documents got from the half
    they were not in. share is how many labelled documents each text stands for
    (1 if not given): fit and threshold are for the ratio of all of them.
    """
    if not len(texts) or not y.any() or y.all():
        return np.zeros(1 << BITS, np.float32), 0.0
    rng = np.random.default_rng(seed)
    share = np.ones(len(texts)) if share is None else share
    bucket, passage, row = features([normalise(t) for t in texts])
    order = np.argsort(passage, kind="stable")
    bucket, passage = bucket[order], passage[order]
    starts = np.searchsorted(passage, np.arange(len(row)))
    # Copies of a text share a half, or they would vouch for each other.
    same = {t: i for i, t in enumerate(texts)}
    half = (rng.permutation(len(texts)) % 2)[[same[t] for t in texts]]
    positive = y[row] > 0
    target, active = positive.astype(float), np.ones(len(row), bool)
    held = np.zeros(len(row))
    for least in SELECT:
        for fold in (0, 1):
            own = half[row] == fold
            w = _fit(bucket, starts, target, active & ~own, share[row], rng)
            held = np.where(own, _passage_scores(w, bucket, starts), held)
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, row, held)
        chosen = positive & (held > least) & ((held >= best[row] - 1e-9) | (held > 0))
        target = chosen.astype(float)
        # The other passages of a harmful document are left out; so are those of a harmless one that look harmful by far.
        active = (~positive & (held < DOUBTFUL)) | chosen
    cut = _best_cut(best, y, share)
    return _fit(bucket, starts, target, active, share[row], rng).astype(np.float32), cut


#: Scores by the other half that keep a passage positive, round by round; and that make a harmless label doubtful.
SELECT, DOUBTFUL = (-2.5, -1.5), 2.5


def _fit(bucket, starts, target, active, weight, rng):
    model = Ftrl()
    for _ in range(EPOCHS):
        model.fit(bucket, starts, target, weight, rng.permutation(np.flatnonzero(active)))
    return model.weights()


def _passage_scores(w, bucket, starts):
    return np.add.reduceat(w[bucket], starts) + INTERCEPT


def _best_cut(score: np.ndarray, y: np.ndarray, share: np.ndarray) -> float:
    order = np.argsort(-score)
    hits = np.cumsum((y * share)[order])
    f1 = 2 * hits / (np.cumsum(share[order]) + hits[-1])
    k = int(np.argmax(f1))
    below = score[order[k + 1]] if k + 1 < len(y) else score[order[k]] - 1
    return float((score[order[k]] + below) / 2)


def sample(labels: DataFrame, documents: DataFrame, key: str, text: str, toxic: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """At most MAX_POSITIVE and MAX_NEGATIVE labelled texts, their labels and shares; two annotators that disagree are left out.

    A text's share is the inverse of the rate at which its class was taken,
    over the least of both: the shares keep the ratio of the classes.
    """
    lab = labels.where(F.col(toxic).isNotNull()).groupBy(key).agg(F.min(toxic).alias("lo"), F.max(toxic).alias("hi")).where("lo = hi")
    most = {1: MAX_POSITIVE, 0: MAX_NEGATIVE}
    rate = {c: min(1.0, most[c] / n) for c, n in lab.where("hi in (0, 1)").groupBy("hi").count().collect()}
    parts = [lab.where(f"hi = {c}").orderBy(F.xxhash64(key), key).limit(n) for c, n in most.items()]
    rows = documents.select(key, text).join(F.broadcast(parts[0].unionByName(parts[1])), key).where(F.col(text).isNotNull()).select(key, text, "hi").collect()
    rows.sort(key=lambda r: str(r[0]))
    return [r[1] for r in rows], np.array([r[2] for r in rows], dtype=int), np.array([max(rate.values()) / rate[r[2]] for r in rows])


def score(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", toxic: str = "toxic") -> DataFrame:
    """(key, score DOUBLE, harmful BOOLEAN) of every document.

    score is the probability of the worst passage; 0 for null, empty and blank
    texts. Without positive labels nothing is harmful. Repeated rows come out
    as often as they come in; other columns are dropped.
    """
    spark = documents.sparkSession
    ship(spark)
    weights, cut = train(*sample(labels, documents, key, text, toxic))
    shared = spark.sparkContext.broadcast(weights)  # 1 << BITS floats, whatever the data
    kind = dict(documents.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b in batches:
            texts = b.column(1).to_pylist()
            out = np.full(len(texts), -99.0)
            at = 0
            while at < len(texts):
                size, to = 0, at
                while to < len(texts) and (size < 500_000 or to == at):
                    size += len(texts[to] or "")
                    to += 1
                bucket, passage, row = features([normalise(t) if t else "" for t in texts[at:to]])
                if len(row):
                    s = np.bincount(passage, w[bucket], len(row)) + INTERCEPT
                    part = np.full(to - at, -99.0)
                    np.maximum.at(part, row, s)
                    out[at:to] = part
                at = to
            p = np.where(out <= -99, 0.0, 1 / (1 + np.exp(-np.clip(out, -40, 40))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((out > cut) & (out > -99) & bool(w.any()))], names=["key", "score", "harmful"])

    got = documents.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, score double, harmful boolean")
    return got.withColumnRenamed("key", key)
