"""p5: noise in text from scanned pages.

Words of the whole corpus are counted once. Rare spellings retrieve correction
candidates from the frequent ones by a join on positional character q-grams; a
gradient-boosted ranking over spelling features chooses the replacement.
Logistic classifiers over pairs of neighbouring lines find running headers and
page numbers, and tell a word that is broken across two lines from a compound.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import broadcast_if_small, materialize, ship
from .sampling import sample

#: A spelling is corrected only to one so many times as frequent, which occurs so often.
RATIO, VOCABULARY_COUNT, MIN_LENGTH = 8, 4, 4
#: Log-odds, before it is asked where they occur, that odd words without a candidate are misread.
ODD_PRIOR = 3.6
#: Words held by a task before they are passed on; frequent words that the second pass need not look up.
HELD_WORDS, KNOWN_WORDS = 400_000, 40_000
#: Bounds of the samples that the ranking and the line classifier are fitted on.
SAMPLE_PAIRS, SAMPLE_TEXTS = 6000, 3000

# What scanners read for what.
CONFUSED = [("0", "o"), ("1", "l"), ("|", "l"), ("!", "i"), ("1", "i"), ("5", "s"), ("9", "g"), ("6", "b"), ("8", "b"), ("3", "e"), ("4", "a"), ("7", "t"), ("2", "z"), ("$", "s"), ("c", "e"), ("e", "c"), ("rn", "m"), ("m", "rn"), ("cl", "d"), ("d", "cl"), ("li", "h"), ("h", "li"), ("ii", "u"), ("u", "ii"), ("vv", "w"), ("w", "vv"), ("l", "i"), ("i", "l"), ("n", "ri"), ("ri", "n"), ("h", "b"), ("b", "h"), ("f", "t"), ("t", "f"), ("nn", "m"), ("o", "c"), ("l", "t"), ("ni", "m"), ("in", "m"), ("c|", "d"), ("]", "l"), ("(", "c"), ("c1", "d"), ("c|", "d"), ("l!", "h"), ("1!", "h"), ("1i", "h"), ("|i", "h"), ("l1", "h")]
HYPHENS = "-‐¬­‑"
LETTER = {"0": "o", "1": "l", "|": "l", "!": "i", "5": "s", "9": "g", "6": "b", "8": "b", "3": "e", "4": "a", "7": "t", "2": "z", "$": "s"}

WORD = re.compile(r"[^\W_](?:[^\W_]|[|!$](?=[^\W_]))*[|](?![\w|])|[^\W_](?:[^\W_]|[|!$](?=[^\W_]))*|[|!](?=[a-z])(?:[^\W_]|[|!](?=[^\W_]))+")
COMPOUND = re.compile(r"[^\W\d_]+-[^\W\d_]+")
ODD = r"^[^\W\d_]+[015|!9]{1,2}[^\W\d_]+$"
IS_ODD = re.compile(ODD)
CODE = re.compile(r"`[^`\n]*`|\S*[_/\\]\S*|\b\w+\([^)\s]*\)|https?:\S+")
PAGE = re.compile(r"^[\W_]{0,4}(?:(?:page|pg|p|seite|s|página|pag|pág|folio|f|第)\.?\s*)?(?:\d{1,4}|(?=[ivxlcdm])[ivxlcdm]{1,12})(?:\s*(?:of|von|de|sur|/)\s*\d{1,4}|\s*页)?[\W_]{0,4}$", re.I)
PAGE_BAD = re.compile(r"^\d+[.):]\s*$|^[-*+#>]\s*\d*$|^[^\w\s]+$|^(?:i|I|mm|cm|di|mix|mild|civil|vivid|dim|mid|lid|mimic|ill|mill|dill|did)$|%|[$€£=<>]")
WITH_PAGE = re.compile(r"^(?P<h>\S.*?\S)\s{2,}(?P<n>\d{1,4})$|^(?P<n2>\d{1,4})\s\|\s(?P<h2>\S.*)$|^(?P<h3>\S.*\S)\s\|\s(?P<n3>\d{1,4})$")


def words_of(text: str) -> list[str]:
    """Words in lower case outside of code, paths and identifiers; compounds count as words of their own, too."""
    plain = CODE.sub(" ", text)
    return [w.lower() for w in WORD.findall(plain)] + [w.lower() for w in COMPOUND.findall(plain)]


def is_prose(text: str) -> bool:
    s = text.lstrip()
    return bool(s) and not (s[0] in "{[" and text.rstrip()[-1] in "}]")


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n, m) over all texts, counted within each task first; m: occurrences in texts that hold another odd word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        beside: Counter = Counter()

        def flush() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.string()), pa.array(list(held.values()), pa.int64()), pa.array([beside[w] for w in held], pa.int64())], names=["word", "n", "m"])
            held.clear()
            beside.clear()
            return b

        for b in batches:
            for t in b.column(0).to_pylist():
                if t and is_prose(t):
                    words = words_of(t)
                    held.update(words)
                    odd = {w for w in words if not w.isalpha() and IS_ODD.match(w)}
                    if odd:
                        beside.update(words if len(odd) > 1 else (w for w in words if w not in odd))
            if len(held) > HELD_WORDS:
                yield flush()
        yield flush()

    return texts.select("text").mapInArrow(run, "word string, n bigint, m bigint").groupBy("word").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


@lru_cache(maxsize=200_000)
def confusion_cost(a: str, b: str) -> float:
    """Edits that turn b into what was read, a: confusions are cheap, other edits cost 1."""
    n, m = len(a), len(b)
    d = [[9.0] * (m + 1) for _ in range(n + 1)]
    d[0][0] = 0.0
    for i in range(n + 1):
        for j in range(m + 1):
            x = d[i][j]
            if x >= 4:
                continue
            if i < n and j < m:
                c = x + (a[i] != b[j])
                if c < d[i + 1][j + 1]:
                    d[i + 1][j + 1] = c
            if i < n and x + 1 < d[i + 1][j]:
                d[i + 1][j] = x + 1
            if j < m and x + 1 < d[i][j + 1]:
                d[i][j + 1] = x + 1
            if i < n:
                for r, t in _BY_FIRST.get(a[i], ()):
                    if a.startswith(r, i) and b.startswith(t, j) and x + 0.2 < d[i + len(r)][j + len(t)]:
                        d[i + len(r)][j + len(t)] = x + 0.2
    return d[n][m]


_BY_FIRST: dict[str, list[tuple[str, str]]] = {}
for _r, _t in CONFUSED:
    _BY_FIRST.setdefault(_r[0], []).append((_r, _t))


def pair_features(s: str, c: str, ns: int, nc: int) -> list[float]:
    odd = sum(not ch.isalpha() for ch in s)
    cost = confusion_cost(s, c)
    return [cost, cost / max(1, len(c)), float(odd), math.log10(nc / ns), abs(len(s) - len(c)), float(len(c)), float(s[0] == c[0]), float(s[-1] == c[-1]), math.log10(nc)]


class Boosted:
    """Gradient-boosted trees of depth two on logistic loss."""

    def __init__(self, rounds: int = 40, rate: float = 0.3):
        self.rounds, self.rate, self.trees, self.base = rounds, rate, [], 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        p = np.clip(y.mean(), 0.02, 0.98)
        self.base = math.log(p / (1 - p))
        f = np.full(len(y), self.base)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-f))
            tree = self._grow(x, y - q, q * (1 - q), 2)
            self.trees.append(tree)
            f += self.rate * self._apply(tree, x)
        return self

    def _grow(self, x, g, h, depth):
        leaf = float(g.sum() / (h.sum() + 1.0))
        if depth == 0 or len(g) < 20:
            return leaf
        best = (1e-6, None, None)
        for j in range(x.shape[1]):
            for t in np.unique(np.quantile(x[:, j], [0.05, 0.2, 0.35, 0.5, 0.65, 0.8, 0.95])):
                left = x[:, j] <= t
                a, b = g[left].sum(), h[left].sum() + 1
                c, d = g[~left].sum(), h[~left].sum() + 1
                gain = a * a / b + c * c / d - (a + c) ** 2 / (b + d)
                if gain > best[0]:
                    best = (gain, j, float(t))
        if best[1] is None:
            return leaf
        left = x[:, best[1]] <= best[2]
        return (best[1], best[2], self._grow(x[left], g[left], h[left], depth - 1), self._grow(x[~left], g[~left], h[~left], depth - 1))

    def _apply(self, tree, x):
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        left = x[:, tree[0]] <= tree[1]
        out = np.empty(len(x))
        out[left] = self._apply(tree[2], x[left])
        out[~left] = self._apply(tree[3], x[~left])
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        for t in self.trees:
            f += self.rate * self._apply(t, x)
        return 1 / (1 + np.exp(-f))


def corrupt(word: str, rng: np.random.Generator) -> str:
    """A word as a scanner might misread it."""
    for _ in range(1 + int(rng.random() < 0.2)):
        fits = [(r, t, i) for r, t in CONFUSED for i in range(len(word)) if word.startswith(t, i)]
        if fits:
            r, t, i = fits[int(rng.integers(len(fits)))]
            word = word[:i] + r + word[i + len(t) :]
    return word


def fit_ranking(vocabulary: list[tuple[str, int]], rivals: list[tuple[str, str, int, int]], seed: int = 5) -> Boosted:
    """Fitted on corrupted frequent words (right) and on pairs of words that are both well attested, or related by plain edits (wrong)."""
    rng = np.random.default_rng(seed)
    x, y = [], []
    words = {w for w, _ in vocabulary}
    for w, n in vocabulary:
        s = corrupt(w, rng)
        ns = max(1, int((n / RATIO) ** rng.random()))  # any count that the ratio allows, whatever the size of the corpus
        if s != w and s not in words:
            x.append(pair_features(s, w, ns, n))
            y.append(1)
        i = int(rng.integers(1, len(w)))
        s = (w[:i] + "abcdefghijklmnopqrstuvwxyz"[int(rng.integers(26))] + w[i + int(rng.integers(2)) :])
        if s != w and s not in words and confusion_cost(s, w) >= 1:
            x.append(pair_features(s, w, ns, n))
            y.append(0)
    for s, c, ns, nc in rivals:
        if confusion_cost(s, c) >= 0.7:
            x.append(pair_features(s, c, ns, nc))
            y.append(0)
    if not x or not 0 < sum(y) < len(y):
        x, y = [[0.2, 0.02, 1, 2, 0, 8, 1, 1, 3], [2, 0.3, 0, 1, 1, 6, 0, 0, 2]] * 20, [1, 0] * 20
    return Boosted().fit(np.array(x), np.array(y, float))


def corrections(words: DataFrame) -> DataFrame:
    """(word, right) of each spelling that the ranking takes for a misreading.

    Grams carry their position, so a spelling meets only words with the same
    letters at about the same place; every gram counts, however common. The
    log-odds of the ranking are added to those of the place: misread words keep
    company with other odd words, a rare word of its own does not. No count
    alone rules a spelling out, so what is found in a table is found in a larger one.
    """
    spark = words.sparkSession
    long = words.where((F.length("word") >= MIN_LENGTH) & ~F.col("word").contains("-"))
    vocab = long.where((F.col("n") >= VOCABULARY_COUNT) & ~F.col("word").rlike(r"[0-9|!$]")).select(F.col("word").alias("c"), F.col("n").alias("nc"))
    suspects = long.select(F.col("word").alias("s"), F.col("n").alias("ns"), F.col("m").alias("ms"))

    def grams(df: DataFrame, w: str, shifts: tuple[int, ...]) -> DataFrame:
        padded = F.concat(F.lit("^"), F.col(w), F.lit("$"))
        at = F.sequence(F.lit(1), F.length(padded) - 2)
        g = F.flatten(F.transform(at, lambda i: F.array(*[F.concat_ws(":", padded.substr(i, F.lit(3)), (i + k).cast("string")) for k in shifts])))
        return df.withColumn("g", F.explode(g))

    met = grams(suspects, "s", (0,)).join(grams(vocab, "c", (-1, 0, 1)), "g").where((F.col("nc") >= RATIO * F.col("ns")) & (F.abs(F.length("s") - F.length("c")) <= 2) & (F.col("s") != F.col("c")))
    shared = met.groupBy("s", "c").agg(F.count("*").alias("k"), F.first("ns").alias("ns"), F.first("nc").alias("nc"), F.first("ms").alias("ms"))
    near = shared.where((F.col("k") >= F.greatest(F.lit(1), F.floor((F.length("s") - 1) / 3))) & (F.levenshtein(F.col("s"), F.col("c")) <= 3))
    # Short words with two misread letters share no gram: letters for digits give them candidates, too.
    plain = suspects.where(F.col("s").rlike(r"[0-9|!$]"))
    read = plain
    tables = []
    for digits in ("015|!96843$72", "0i5|i96843$72"):
        tables.append(F.translate("s", digits, "".join(LETTER.get(ch, ch) for ch in digits)))
    decoded = read.select("s", "ns", "ms", F.explode(F.array(*tables)).alias("c")).join(vocab, "c").where(F.col("nc") >= RATIO * F.col("ns")).select("s", "c", F.lit(9).cast("bigint").alias("k"), "ns", "nc", "ms")
    pairs = materialize(near.unionByName(decoded).dropDuplicates(["s", "c"]), "corrections")
    top = [(r[0], r[1]) for r in sample(vocab.where(F.col("nc") >= 4 * RATIO), ["c"], SAMPLE_PAIRS)]
    rivals = [tuple(r[:4]) for r in sample(pairs.where(F.col("ns") >= VOCABULARY_COUNT * 4).where(~F.col("s").rlike(r"[0-9|!$]")).select("s", "c", "ns", "nc"), ["s", "c"], SAMPLE_PAIRS)]
    model = spark.sparkContext.broadcast(fit_ranking(sorted(top), sorted(rivals)))
    # How often words that are misread for sure, and words at all, stand beside another odd word.
    sure = pairs.where(F.col("s").rlike(ODD)).select("s", "ns", "ms").distinct().agg(F.sum("ms"), F.sum("ns")).first()
    all_ = words.agg(F.sum("m"), F.sum("n")).first()
    q1, q0 = (((r[0] or 0) + 1) / ((r[1] or 0) + 2) for r in (sure, all_))
    q1 = max(q1, q0)
    hit, miss = math.log(q1 / q0), math.log((1 - q1) / (1 - q0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(zip(*(b.column(i).to_pylist() for i in range(4))))
            beside = b.column(4).to_pylist()
            p = model.value.predict(np.array([pair_features(*r) for r in rows])) if rows else np.zeros(0)
            place = [m * hit + (r[2] - m) * miss for r, m in zip(rows, beside)]
            keep = [i for i, r in enumerate(rows) if p[i] >= 0.5 and math.log(p[i] / max(1e-9, 1 - p[i])) + place[i] >= 0 and confusion_cost(r[0], r[1]) < 0.9]
            yield pa.RecordBatch.from_arrays([pa.array([rows[i][0] for i in keep], pa.string()), pa.array([rows[i][1] for i in keep], pa.string()), pa.array([float(p[i]) for i in keep], pa.float64())], names=["word", "right", "p"])

    ranked = pairs.select("s", "c", "ns", "nc", "ms").mapInArrow(run, "word string, right string, p double")
    # A rare word of letters with a digit or bar inside is misread even where the right word is not in the vocabulary.
    inside = suspects.where(F.col("s").rlike(ODD) & (F.length("s") >= 6) & (F.col("ms") * hit + (F.col("ns") - F.col("ms")) * miss + ODD_PRIOR >= 0)).select(F.col("s").alias("word"), tables[0].alias("right"), F.lit(0.0).alias("p"))
    ranked = ranked.unionByName(inside)
    return ranked.groupBy("word").agg(F.max_by("right", F.struct("p", "right")).alias("right"))


# Lines.
def page_only(s: str) -> bool:
    return len(s) <= 24 and bool(PAGE.match(s)) and not PAGE_BAD.search(s) and (any(c.isdigit() for c in s) or len(re.sub(r"\W", "", s)) >= 1 and re.sub(r"[\W_]", "", s).islower() and _roman(re.sub(r"[\W_]", "", s)))


def _roman(s: str) -> bool:
    return bool(re.fullmatch(r"m{0,3}(?:c[md]|d?c{0,4})l{0,5}(?:x[cl]|x{0,4})(?:i[xv]|v?i{0,4})", s)) and len(s) > 0


END = re.compile(r"[.!?:;。！？][\"'”’)\]]*$")


def _key(s: str) -> str:
    return re.sub(r"[\W\d_]+", " ", s.lower()).strip()


def _alike(a: str, b: str) -> bool:
    if a == b:
        return True
    x, y = ({w[i : i + 3] for i in range(len(w) - 2)} for w in (a, b))
    return bool(x and y) and 2 * len(x & y) >= 1.2 * (len(x) + len(y)) * 0.5 * 0.9


class Page:
    """The lines of a text with what the classifiers look at."""

    def __init__(self, text: str, numbers: np.ndarray | None = None):
        self.lines = text.replace("\r\n", "\n").split("\n")
        self.s = [x.strip() for x in self.lines]
        lens = sorted(len(x) for x in self.s if x)
        self.width = lens[int(len(lens) * 0.7)] if lens else 0
        self.wrapped = len(lens) >= 3 and self.width <= 110
        self.page = [False] * len(self.s)
        self.part = [x for x in self.s]  # a line without its page number
        self.combined = [False] * len(self.s)
        if not self.wrapped:
            return
        for i, x in enumerate(self.s):
            if not x:
                continue
            if page_only(x):
                self.page[i] = True
            elif (m := WITH_PAGE.match(x)) and not x.startswith("|"):
                h = m["h"] or m["h2"] or m["h3"]
                if not END.search(h) and len(h) < 70 and "|" not in h:
                    self.combined[i] = self.page[i] = True
                    self.part[i] = h
        self.numbered = list(self.page)
        if numbers is None:
            numbers = NUMBER_PRIOR
        self.page = [v and float(np.dot(numbers, self.number_features(i))) > 0 for i, v in enumerate(self.page)]

    def number_features(self, i: int) -> list[float]:
        """What tells a page number among the lines that may hold one: its neighbours, its place, and other such lines."""
        s, value = self.s, self._value(i)
        filled = [j for j, y in enumerate(s) if y]
        others = [v for j, v in enumerate(map(self._value, range(len(s)))) if j != i and self.numbered[j] and v is not None]
        before, after = (s[i - 1] if i else ""), (s[i + 1] if i + 1 < len(s) else "")
        column = before.isdigit() and s[i].isdigit() or after.isdigit() and s[i].isdigit()
        return [
            1.0,
            float(column),
            float(self.combined[i]),
            float(i in (filled[0], filled[-1])),
            float(not before),
            float(not after),
            float(bool(before) and not END.search(before)),
            float(after[:1].islower()),
            float(value is not None and any(abs(value - v) == 1 for v in others)),
            float(bool(re.match(r"(?i)[\W_]*(?:page|pg|seite|página|pag|pág|folio|第)", s[i]))),
            float(value is not None and value > 2000),
        ]

    def _value(self, i: int) -> int | None:
        found = re.search(r"\d{1,4}", self.s[i][len(self.part[i]) :] if self.combined[i] and self.s[i].startswith(self.part[i]) else self.s[i])
        return int(found[0]) if found else None

    def candidates(self) -> list[int]:
        """Lines that may be a running header: short, no sentence's end, no list or markup."""
        out = []
        for i, x in enumerate(self.part):
            if not x or self.page[i] and not self.combined[i]:
                continue
            if self.combined[i] or len(x) <= max(40, 0.95 * self.width) and len(x) < 80 and not END.search(x) and not re.match(r"[-*+>#|`$]|\d+[.)]\s|\w+\[\d*\]:", x) and not x.endswith((",", "-")) and not (x[0].islower() and not self._near_page(i)):
                out.append(i)
        return out

    def _near_page(self, i: int) -> bool:
        return any(0 <= j < len(self.s) and self.page[j] and not self.combined[j] for j in (i - 1, i + 1))

    def features(self, i: int, cands: list[int]) -> list[float]:
        x = self.part[i]
        words = re.findall(r"[^\W\d_]{2,}", x)
        caps = sum(w[0].isupper() for w in words) / max(1, len(words))
        before = next((self.s[j] for j in range(i - 1, -1, -1) if self.s[j] and not self.page[j]), "")
        after = next((self.s[j] for j in range(i + 1, len(self.s)) if self.s[j] and not self.page[j]), "")
        key = _key(x)
        again = sum(_alike(key, _key(self.part[j])) for j in cands if j != i)
        filled = [j for j, y in enumerate(self.s) if y]
        near = any(0 <= j < len(self.s) and self.page[j] for j in (i - 1, i + 1)) or self.combined[i]
        return [
            1.0,
            float(again > 0),
            float(near),
            float(self.combined[i]),
            float(i == filled[0] or i == filled[-1]),
            float(bool(before) and not END.search(before)),
            float(after[:1].islower()),
            float(i > 0 and not self.s[i - 1]),
            float(i + 1 < len(self.s) and not self.s[i + 1]),
            len(x) / max(1, self.width),
            caps,
            float(bool(re.match(r"(?:\S ){4,}", x))),
            float(any(self.page)),
            float(bool(re.match(r"\d+\.\d", x))),
            float(any(c.isdigit() for c in x)),
            float(i == filled[-1]),
            float(i in (filled[0], filled[-1]) and not (i > 0 and not self.s[i - 1]) and (i == filled[-1] or bool(self.s[i + 1]))),
            float("\f" in self.lines[i] or i > 0 and self.lines[i - 1].endswith("\f")),
            float(0 < i < len(self.s) - 1 and bool(self.s[i - 1]) and bool(self.s[i + 1]) and len(x) < 0.78 * self.width and caps >= 0.4),
        ]


#: Weights that the classifier of page numbers starts from and is drawn to: a line that may hold one does, unless it is a column's.
NUMBER_PRIOR = np.array([2.0, -6.0, 0.5, 0.3, 0.3, 0.3, 0.3, 0.3, 0.5, 0.5, -0.5])


def weak_number(f: list[float]) -> int | None:
    column, combined, edge, blank_a, blank_b, broken, lower, next_, named, large = (bool(v) for v in f[1:])
    if column:
        return 0
    if named or next_ or edge or broken and lower or blank_a and blank_b and not large:
        return 1
    return None


def weak_header(f: list[float]) -> int | None:
    again, near, combined, edge, broken, lower, blank_a, blank_b = (bool(v) for v in f[1:9])
    titled = f[10] >= 0.35 or f[11] or again
    if not titled and not combined:
        return 0
    if edge and not blank_a and (f[15] or not blank_b) or f[17] or f[18]:
        return 1
    if combined or near and (again or edge or broken or f[11]) or again and broken and not blank_b:
        return 1
    if blank_a and blank_b and not again and not near or f[9] > 0.8 and not near and not again:
        return 0
    if not f[12] and not again and not edge:
        return 0
    return None


def fit_lines(texts: list[str], steps: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Logistic weights of the classifiers of headers and of page numbers, from weak labels; fixed weights where a sample has
    only one class."""
    heads, numbers = ([], []), ([], [])
    for t in texts:
        p = Page(t)
        if p.wrapped:
            cands = p.candidates()
            rows = [(heads, f, weak_header(f)) for f in (p.features(i, cands) for i in cands)]
            rows += [(numbers, f, weak_number(f)) for f in (p.number_features(i) for i, v in enumerate(p.numbered) if v)]
            for (x, y), f, label in rows:
                if label is not None:
                    x.append(f)
                    y.append(label)
    prior = np.array([-2.5, 2.5, 3, 3, 1, 1.5, 1, -1, -1.2, -1.5, 1, 2, 0.5, 0, 0, 0, 2, 3, 2.5])
    return logistic(*heads, prior, steps), logistic(*numbers, NUMBER_PRIOR, steps)


def logistic(x: list[list[float]], y: list[int], prior: np.ndarray, steps: int = 300) -> np.ndarray:
    """Weights by gradient descent from the prior and drawn to it; the prior where the labels are all alike."""
    if len(set(y)) < 2:
        return prior
    m, t = np.array(x), np.array(y, float)
    w = prior.copy()
    for _ in range(steps):
        g = m.T @ (1 / (1 + np.exp(-m @ w)) - t) / len(t) + 0.002 * (w - prior)
        w -= 0.5 * g
    return w


def furniture(page: Page, w: np.ndarray) -> tuple[set[int], set[int]]:
    """Lines that are running headers and lines that hold a page number."""
    if not page.wrapped:
        return set(), set()
    cands = page.candidates()
    heads = {i for i in cands if float(np.dot(w, page.features(i, cands))) > 0}
    # A page number that belongs to a rejected header line is none.
    pages = {i for i, v in enumerate(page.page) if v and (not page.combined[i] or i in heads)}
    return heads, pages


def broken_words(page: Page, skip: set[int]) -> list[tuple[int, str, str, str]]:
    """(line, head, mark, tail) of each line whose last word may go on in the next text line."""
    out = []
    text = [i for i, x in enumerate(page.s) if x and i not in skip]
    for i, j in zip(text, text[1:]):
        m = re.search(r"([^\W\d_]+)([%s])$" % HYPHENS, page.s[i])
        n = re.match(r"[^\W\d_]+", page.s[j])
        if m and n and n[0][0].islower():
            out.append((i, m[1], m[2], n[0]))
    return out


LINES = "struct<heads:array<int>,pages:array<int>,broken:array<struct<line:int,head:string,mark:string,tail:string>>,words:array<struct<line:int,word:string>>>"


def scan_lines(texts: DataFrame, weights: tuple[np.ndarray, np.ndarray], known: set[str]) -> DataFrame:
    """(tbl, rec_key, found): furniture, possible breaks and words that are not generally known, of each text."""
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast((weights, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (w, numbers), usual = shared.value
        brk = pa.struct([("line", pa.int32()), ("head", pa.string()), ("mark", pa.string()), ("tail", pa.string())])
        wrd = pa.struct([("line", pa.int32()), ("word", pa.string())])
        kind = pa.struct([("heads", pa.list_(pa.int32())), ("pages", pa.list_(pa.int32())), ("broken", pa.list_(brk)), ("words", pa.list_(wrd))])
        for b in batches:
            found = []
            for t in b.column(2).to_pylist():
                if not t or not is_prose(t):
                    found.append(None)
                    continue
                page = Page(t, numbers)
                heads, pages = furniture(page, w)
                breaks = broken_words(page, heads | pages)
                cut = {i: (h, m) for i, h, m, _ in breaks}
                tails = {}
                filled = [i for i, x in enumerate(page.s) if x and i not in heads | pages]
                after = dict(zip(filled, filled[1:]))
                for i, _, _, tail in breaks:
                    tails[after[i]] = tail
                words = []
                for i, x in enumerate(page.s):
                    if not x or i in heads or i in pages:
                        continue
                    if i in cut:
                        x = x[: -len(cut[i][0]) - 1]
                        h = cut[i][0] + next(tl for k, _, _, tl in breaks if k == i)
                        if h.lower() not in usual:
                            words.append({"line": i, "word": h.lower()})
                    if i in tails:
                        x = x[len(tails[i]) :]
                    for v in WORD.findall(CODE.sub(" ", x)):
                        if len(v) >= MIN_LENGTH and (v := v.lower()) not in usual:
                            words.append({"line": i, "word": v})
                found.append({"heads": sorted(heads), "pages": sorted(pages), "broken": [{"line": i, "head": h, "mark": m, "tail": tl} for i, h, m, tl in breaks], "words": words})
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, kind)], names=["tbl", "rec_key", "found"])

    return texts.select("tbl", "rec_key", "text").mapInArrow(run, f"tbl string, rec_key string, found {LINES}")


def analyse(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scanned, kinds, fixes) of texts (tbl, rec_key, text).

    kinds: (tbl, rec_key, line_no, kind), lines counted from 1. fixes: (tbl,
    rec_key, line, word, right). Null, empty and JSON texts have neither. A
    record that is delivered twice counts once.
    """
    spark = texts.sparkSession
    ship(spark)
    words = materialize(count_words(texts), "words")
    right = materialize(corrections(words), "right")
    known = words.where(F.col("n") >= 50).join(right, "word", "left_anti").orderBy(F.desc("n"), "word").limit(KNOWN_WORDS)
    rows = sample(texts.where(F.length("text") > 0).where(F.instr("text", "\n") > 0).select("tbl", "rec_key", "text"), ["tbl", "rec_key"], SAMPLE_TEXTS)
    weights = fit_lines(sorted(r["text"] for r in rows if is_prose(r["text"])))
    scanned = materialize(scan_lines(texts, weights, {r[0] for r in known.select("word").collect()}).where("found is not null"), "scanned")
    key = ["tbl", "rec_key"]
    plain = scanned.select(*key, F.explode("found.heads").alias("line"), F.lit("header").alias("kind")).unionByName(scanned.select(*key, F.explode("found.pages").alias("line"), F.lit("page_number").alias("kind")))
    occurring = scanned.select(*key, F.explode("found.words").alias("w")).select(*key, "w.line", "w.word").distinct()
    n_right = right.count()
    fixes = materialize(occurring.join(broadcast_if_small(right, n_right, 80), "word"), "fixes")
    misread = fixes.select(*key, "line", F.lit("misread").alias("kind")).distinct()
    hyphenated = joins(scanned, words).where("joined").select(*key, "line", F.lit("hyphenation").alias("kind"))
    kinds = plain.unionByName(misread).unionByName(hyphenated).select(*key, (F.col("line") + 1).alias("line_no"), "kind").distinct()
    return scanned, kinds, fixes


#: Weights that the classifier of joins starts from and is drawn to: bias; log odds of the whole word against the compound, of the
#: whole against head and tail meeting by chance; lengths of both; whether the mark is a hyphen of compounds.
JOIN_PRIOR = np.array([1.0, 1.0, 0.1, 0.0, 0.0, -0.2])


def join_features(head: str, tail: str, mark: str, whole: int, pair: int, n_head: int, n_tail: int, total: int) -> list[float]:
    """The counts as ratios, so that they say the same in a corpus of any size."""
    chance = (n_head + 0.5) * (n_tail + 0.5) / max(1, total)
    return [1.0, max(-4.0, min(4.0, math.log((whole + 0.5) / (pair + 0.5)))), max(-4.0, min(4.0, math.log((whole + 0.5) / chance))), min(len(head), 12) / 12, min(len(tail), 12) / 12, float(mark in "-‐‑")]


def fit_joins(vocabulary: list[tuple[str, int]], compounds: list[tuple[str, int]], counts: dict[str, int], total: int, seed: int = 8) -> np.ndarray:
    """Fitted on frequent words broken at any place (right) and on compounds broken at their hyphen (wrong)."""
    rng = np.random.default_rng(seed)
    x, y = [], []
    for w, n in vocabulary:
        if len(w) >= 5:
            i = int(rng.integers(2, len(w) - 2))
            x.append(join_features(w[:i], w[i:], "-", n, 0, counts.get(w[:i], 0), counts.get(w[i:], 0), total))
            y.append(1)
    for w, n in compounds:
        h, _, t = w.partition("-")
        x.append(join_features(h, t, "-", counts.get(h + t, 0), n, counts.get(h, n), counts.get(t, n), total))
        y.append(0)
    return logistic(x, y, JOIN_PRIOR)


def joins(scanned: DataFrame, words: DataFrame) -> DataFrame:
    """(tbl, rec_key, line, head, mark, tail, joined): whether a break is inside a word or behind a compound's own hyphen."""
    b = scanned.select("tbl", "rec_key", F.explode("found.broken").alias("b")).select("tbl", "rec_key", "b.*").distinct()
    forms = F.array(*[F.struct(F.lit(k).alias("k"), v.alias("word")) for k, v in (("whole", F.lower(F.concat("head", "tail"))), ("pair", F.lower(F.concat("head", F.lit("-"), "tail"))), ("head", F.lower("head")), ("tail", F.lower("tail")))])
    asked = b.withColumn("f", F.explode(forms)).select("tbl", "rec_key", "line", "head", "mark", "tail", "f.k", "f.word")
    n = asked.join(words, "word", "left").groupBy("tbl", "rec_key", "line", "head", "mark", "tail").agg(*[F.coalesce(F.max(F.when(F.col("k") == k, F.col("n"))), F.lit(0)).alias(f"n_{k}") for k in ("whole", "pair", "head", "tail")])
    plain = ~F.col("word").rlike(r"[0-9|!$-]") & (F.col("n") >= VOCABULARY_COUNT)
    vocabulary = [(r["word"], r["n"]) for r in sample(words.where(plain).select("word", "n"), ["word"], SAMPLE_PAIRS)]
    compounds = [(r["word"], r["n"]) for r in sample(words.where(F.col("word").rlike("^[^-]+-[^-]+$")).select("word", "n"), ["word"], SAMPLE_PAIRS)]
    total = words.agg(F.sum("n")).first()[0] or 0
    weights = fit_joins(vocabulary, compounds, dict(vocabulary), total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            rows = zip(*(x.column(i).to_pylist() for i in range(3, 10)))
            got = [float(np.dot(weights, join_features(h, t, m, a, p, c, d, total))) > 0 for h, m, t, a, p, c, d in rows]
            yield pa.RecordBatch.from_arrays([*(x.column(i) for i in range(6)), pa.array(got, pa.bool_())], names=["tbl", "rec_key", "line", "head", "mark", "tail", "joined"])

    return n.mapInArrow(run, "tbl string, rec_key string, line int, head string, mark string, tail string, joined boolean")


def repaired(texts: DataFrame, scanned: DataFrame, kinds: DataFrame, fixes: DataFrame) -> DataFrame:
    """(tbl, rec_key, repaired): the text in continuous paragraphs, without furniture, broken and misread words.

    Null and empty texts, and JSON, stay as they are.
    """
    key = ["tbl", "rec_key"]
    marks = kinds.groupBy(*key).agg(F.collect_list(F.struct("line_no", "kind")).alias("kinds"))
    reads = fixes.groupBy(*key).agg(F.collect_list(F.struct("line", "word", "right")).alias("fixes"))
    all_ = texts.dropDuplicates(key).join(marks, key, "left").join(reads, key, "left").select(*key, "text", F.to_json("kinds").alias("k"), F.to_json("fixes").alias("f"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        for b in batches:
            out = []
            for t, k, f in zip(*(b.column(i).to_pylist() for i in (2, 3, 4))):
                out.append(repair_text(t, [(x["line_no"], x["kind"]) for x in json.loads(k or "[]")], {(x["line"], x["word"]): x["right"] for x in json.loads(f or "[]")}) if t and is_prose(t) else t)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["tbl", "rec_key", "repaired"])

    return all_.mapInArrow(run, "tbl string, rec_key string, repaired string")


def repair_text(text: str, kinds: list[tuple[int, str]], fixes: dict[tuple[int, str], str]) -> str:
    page = Page(text)
    drop = {n - 1 for n, k in kinds if k in ("header", "page_number")}
    hyphen = {n - 1 for n, k in kinds if k == "hyphenation"}
    paragraphs: list[str] = []
    current = ""
    gap = False
    glue = True
    for i, x in enumerate(page.s):
        if i in drop:
            continue
        if not x:
            gap = True
            continue
        x = WORD.sub(lambda m: _cased(m[0], fixes.get((i, m[0].lower()))), x)
        # A blank line beside furniture, in the middle of a sentence, is no paragraph's end.
        fresh = gap and (END.search(current) or not x[:1].islower()) or not page.wrapped or bool(re.match(r"[-*+#>|]|\d+[.)]\s", x))
        if current and fresh:
            paragraphs.append(current)
            current, glue = "", True
        current += x if glue else " " + x
        glue = i in hyphen
        if glue:
            current = current.rstrip(HYPHENS)
        gap = False
    return "\n\n".join([*paragraphs, *([current] if current else [])])


def _cased(word: str, right: str | None) -> str:
    if right is None:
        return word
    if word.isupper() and len(word) > 1:
        return right.upper()
    return right[:1].upper() + right[1:] if word[:1].isupper() else right


def texts_of(payloads: DataFrame, skills: DataFrame) -> DataFrame:
    """(tbl, rec_key, text) of both tables."""
    a = payloads.select(F.lit("advocate_payload").alias("tbl"), F.col("payload_id").cast("string").alias("rec_key"), F.col("theory_text").alias("text"))
    return a.unionByName(skills.select(F.lit("aletheia_skill").alias("tbl"), F.col("node_id").alias("rec_key"), F.col("source_context").alias("text")))
