"""p1: question-answer pairs whose answer is no use.

A multi-label linear classifier over hashed n-grams of the whole answer (those
of its start and end apart from the rest) and over features of the pair. It is
fitted on a bounded sample of the pairs themselves, with answers made empty,
cut off, refused, copied from the question and swapped with those in other
languages; a second round leaves out originals that the first takes for
defective. Thresholds are calibrated on held-out pairs. A batch of pairs is
hashed and scored at once on arrays.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship
from . import textvec
from .sampling import sample

#: Pairs that the classifier is fitted on, in the order of a hash of the record's key.
SAMPLE_PAIRS = 6000
BITS = 17
#: Weight of the n-grams behind the start against those of start and end, which say more.
REST_WEIGHT = 0.3
#: N-grams that begin among so many first words are told apart from those of the rest.
START_WORDS = 24
#: A defect beside the likeliest one comes out if it is so far over its threshold.
SECOND_MARGIN = 2.0
LABELS = ["empty", "truncated", "refusal", "copy", "wrong_language"]

# Texts that stand for no answer, in the languages of conversations.
PLACEHOLDERS = ["", " ", "\n", "\n\n", " ", "​", "...", "…", "-", "--", "n/a", "N/A", "none", "None", "null", "nil", "NaN", "undefined", "TODO", "TBD", "[]", "{}", "()", "\"\"", "<p></p>", "<br>", "<br/>", "<div></div>", "[no output]", "[empty]", "<empty>", "(no answer)", "[no answer]", "no output", "```\n```", "```python\n```", "***", "###", ".", "?", "[placeholder]", "<answer>", "lorem ipsum", "xxx", "k. A.", "s/o", "sin respuesta", "keine Antwort", "pas de réponse", "无", "暂无", "待定"]
# How answers decline, as openers, refusals and closers.
OPENERS = ["", "I'm sorry, but ", "Sorry, ", "Unfortunately, ", "I apologise, however ", "I apologize, but ", "My apologies. ", "As a language model, ", "As an AI assistant, ", "Thank you for asking, but ", "Regrettably, ", "I'm afraid "]
REFUSALS = [
    "I can't help with that", "I cannot help with {x}", "I cannot provide information on {x}", "I won't be able to assist with that request", "I am not able to answer questions about {x}", "I don't have the ability to comment on {x}", "I must decline to discuss {x}", "I have to refuse this request",
    "no answer can be given to this question", "this falls under restricted material, so no details", "you would have to ask somebody with access, there is nothing I may share about {x}", "I do not feel comfortable answering this", "{x} is outside what I'm allowed to talk about", "that is not something I can do", "I'd rather not answer that", "I am unable to comply with this request", "it is against my guidelines to discuss {x}", "I'm not permitted to answer", "I have to pass on this one", "my guidelines keep me from going into {x}", "{x}? I would rather not go into that", "I would prefer not to talk about {x}", "that lies beyond what I may discuss",
]
CLOSERS = ["", ".", ". I hope you understand.", ". Please contact the maintainers.", ". Perhaps rephrase the request.", ". Is there anything else you would like to know?", ". Please ask someone else."]
FOREIGN_REFUSALS = {
    "de": (["Es tut mir leid, aber ", "Leider ", "Entschuldigung, ", ""], ["kann ich dazu keine Auskunft geben", "darf ich diese Frage nicht beantworten", "ist mir das nicht möglich", "muss ich diese Anfrage ablehnen", "kann ich Ihnen dabei nicht helfen", "möchte ich darauf nicht antworten"], [".", ". Bitte wenden Sie sich an das Projektteam."]),
    "fr": (["Désolé, ", "Je suis désolé, mais ", "Malheureusement, ", ""], ["je ne peux pas répondre à cette question", "je dois refuser cette demande", "il m'est impossible de vous aider sur ce point", "je ne suis pas en mesure de vous aider", "je ne suis pas autorisé à en parler"], [".", ". Veuillez contacter l'équipe du projet."]),
    "es": (["Lo siento, pero ", "Lamentablemente, ", "Disculpe, ", ""], ["no puedo responder a esta pregunta", "debo rechazar esta solicitud", "no me es posible ayudar con eso", "no puedo dar información sobre esto", "no estoy autorizado a hablar de ello"], [".", ". Por favor, consulte al equipo del proyecto."]),
    "zh": (["抱歉，", "很遗憾，", "对不起，", ""], ["我无法回答这个问题", "我不能提供相关信息", "我必须拒绝这个请求", "这个问题我帮不了您"], ["。", "。请联系项目团队。"]),
}
# Names of languages, as asked for.
ASKED = re.compile(r"(?i)translat|übersetz|traduc|traduis|tradui|翻译|\b(?:in|into|auf|en|ins)\s+(?:english|german|french|spanish|chinese|italian|englisch|deutsch|französisch|spanisch|chinesisch|anglais|allemand|français|espagnol|chinois|inglés|alemán|francés|español|chino)\b|(?:english|german|french|spanish|chinese|deutsch(?:e|en)?|englisch(?:e|en)?|français|anglais|español|inglés)\b|(?:用|以)(?:英|中|德|法|西)|英文|中文|德语|法语|西班牙语")

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
MARKUP = re.compile(r"<[^<>]*>|```\w*|[`*_#>|\-=~\[\](){}\"'“”.,;:!?…\s​‌‍﻿ ]+")
NOTHING = re.compile(r"(?i)^(?:n\s*/?\s*a|none|null|nil|nan|undefined|todo|tbd|empty|placeholder|no (?:output|answer|response|content|data)|not available|answer(?: here)?|fixme|xxx+|lorem ipsum.*|kA|s o|so|keine (?:antwort|angabe)|sin respuesta|pas de réponse|无|暂无|待定|待补充)?$")
FENCE = re.compile(r"```[\s\S]*?(?:```|\Z)")


OPEN_VALUE = re.compile(r'"(?:answer|output|response)"\s*:\s*"((?:[^"\\]|\\.)*)\\?$')


def is_open(output: str | None) -> bool:
    """Whether an output is a JSON value that breaks off inside its answer."""
    s = (output or "").strip()
    if s[:1] not in ("{", "["):
        return False
    try:
        json.loads(s)
    except ValueError:
        return bool(OPEN_VALUE.search(s))
    return False


def answer_text(output: str | None) -> str | None:
    """The answer in an output: the JSON value's answer (so far) where the output is JSON, else the output itself."""
    if output is None:
        return None
    s = output.strip()
    if s[:1] in ("{", "[", '"'):
        try:
            v = json.loads(s)
        except ValueError:
            m = OPEN_VALUE.search(s)
            return m[1].replace("\\n", "\n").replace('\\"', '"') if m else output
        if isinstance(v, dict):
            for k in ("answer", "output", "response", "text", "content", "result"):
                if k in v:
                    return v[k] if isinstance(v[k], str) or v[k] is None else json.dumps(v[k])
            return "" if not v else output
        if isinstance(v, str):
            return v
        return "" if not v else output
    return output


class Languages:
    """Naive Bayes over words; ideographs decide by themselves."""

    def __init__(self, counts: dict[str, Counter]):
        self.frame: set[str] = set()
        self.langs = sorted(counts)
        total = {k: sum(c.values()) for k, c in counts.items()}
        words = set().union(*counts.values()) if counts else set()
        self.score = {}
        for w in words:
            s = [math.log((counts[k][w] + 0.05) / (total[k] + 50)) for k in self.langs]
            top = max(s)
            if top - min(s) > 1:
                self.score[w] = [max(-4.0, x - top) for x in s]

    def guess(self, text: str) -> tuple[str, float]:
        """The language and by how much it leads; '' where nothing tells."""
        return self.of(text, words_of(text)) if text else ("", 0.0)

    def of(self, plain: str, words: list[str]) -> tuple[str, float]:
        if not plain.isascii():
            cjk = len(IDEOGRAPH.findall(plain))
            if cjk >= 2 and cjk * 3 > sum(map(len, words)):
                return "zh", float(min(12, cjk))
        get, sums, hit = self.score.get, [0.0] * len(self.langs), 0
        for w in words:
            s = get(w)
            if s:
                hit += 1
                for i, x in enumerate(s):
                    sums[i] += x
        if not hit or len(sums) < 2:
            return "", 0.0
        order = sorted(range(len(sums)), key=sums.__getitem__)
        return self.langs[order[-1]], sums[order[-1]] - sums[order[-2]]


IDEOGRAPH = re.compile(r"[一-鿿]")
TOKEN = re.compile(r"[^\W_]+")
CODE = re.compile(r"```[\s\S]*?(?:```|\Z)|`[^`\n]*`")


def words_of(text: str) -> list[str]:
    """Lower-case words outside of code."""
    return TOKEN.findall((CODE.sub(" ", text) if "`" in text else text).lower())


def learn_languages(rows: list[tuple[str | None, str, str]]) -> Languages:
    """From the questions and answers of rows with a tag."""
    counts: dict[str, Counter] = {}
    texts: Counter = Counter()
    for lang, q, a in rows:
        tag = re.match(r"\s*([A-Za-z]{2,3})(?![A-Za-z])", lang or "")
        if tag:
            c = counts.setdefault(tag[1].lower()[:2], Counter())
            texts[tag[1].lower()[:2]] += 1
            for t in (q, a):
                c.update(set(words_of(t)))
    counts = {k: c for k, c in counts.items() if sum(c.values()) >= 30}
    langs = Languages(counts)
    # The words that hold sentences together: in at least one text of 16 of their language.
    langs.frame = {w for k, c in counts.items() for w, n in c.items() if n >= 8 and n * 16 >= texts[k]}
    return langs


def _bag(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


DENSE = 35
LIST_MARK = re.compile(r"(?:\d+[.)]|[-*+])\s*(\S?)")
SENTENCE = re.compile(r"[.!?。！？](?:\s|$|[\"')\]])")
NUMERIC = re.compile(r"[-+]?[\d.,]+%?")
ECHO = {"question", "frage", "pregunta", "user", "q"}
ENDINGS = set(".!?。！？…\"'”’»)]}`|>*")
BREAKS = set(",;:-–—(/=+&\\<")


def describe(q: str, a: str, open_: bool, langs: Languages) -> tuple[list[float], list[int], str]:
    """The features of a pair, the buckets of its answer's end, and the answer's words outside of code for the n-grams."""
    s = a.strip()
    core = MARKUP.sub(" ", s).strip() if len(s) < 60 else s
    nothing = not core or len(core) < 40 and bool(NOTHING.match(core))
    tail = s[-1:]
    fences = s.count("```") if "`" in s else 0
    outside = (FENCE.sub(" ", s) if fences else s).strip()
    plain = CODE.sub(" ", s) if "`" in s else s
    spoken = TOKEN.findall(plain.lower())
    all_a = TOKEN.findall(s.lower()) if plain is not s else spoken
    all_q = _bag(q)
    spoken_q = words_of(q) if "`" in q else all_q
    wq, wa = Counter(all_q), Counter(all_a)
    nq, na = len(all_q), len(all_a)
    common = beyond = twice = 0
    for w, c in wa.items():
        m = wq.get(w, 0)
        if m:
            common += c if c < m else m
            twice += min(c, 3 * m)
        if c > m and w not in ECHO:
            beyond += c - m
    lq, mq = langs.of(q, spoken_q)
    la, ma = langs.of(plain, spoken)
    differ = bool(lq and la and lq != la)
    asked = bool(ASKED.search(q))
    last_line = s.rsplit("\n", 1)[-1].strip()
    cut = s.rsplit(None, 1)
    last_word = cut[-1].lower() if cut else ""
    opened = outside.count("(") + outside.count("[") + outside.count("{") - outside.count(")") - outside.count("]") - outside.count("}")
    code_end = fences >= 2 and fences % 2 == 0 and s.endswith("```")
    ended = tail in ENDINGS or code_end
    short = na <= 4
    item = LIST_MARK.match(last_line)
    dense = [
        1.0,
        float(nothing),
        float(not core),
        min(na, 60) / 30,
        float(na == 0),
        float(ended),
        float(tail.isalnum()),
        float(tail.isalnum() and not short),
        float(tail in BREAKS and bool(tail)),
        float(fences % 2 == 1),
        float(opened > 0),
        float(outside.count('"') % 2 == 1),
        float(outside.count("`") % 2 == 1),
        float(bool(item) and not item[1]),
        float(bool(item) and bool(item[1]) and not ended),
        float(bool(NUMERIC.fullmatch(s))),
        float(last_word in FUNCTION),
        common / max(1, na),
        common / max(1, nq),
        float(na > 0 and beyond == 0),
        beyond / max(1, na),
        min(beyond, 40) / 20,
        float(twice >= na and na >= nq >= 3),
        abs(na - nq) / max(1, na, nq),
        float(differ) * min(ma, mq, 6.0) / 3,
        float(differ and not asked),
        float(differ and not asked) * min(ma, mq, 6.0) / 3,
        float(asked),
        float(la == "zh" and lq != "zh" and not asked),
        min(len(SENTENCE.findall(outside)) + 1, 8) / 4,
        float(short),
        float(fences > 0),
        float(bool(cut) and s[-len(cut[-1]) - 1 : -len(cut[-1])] == "\n" and not ended),
        float(na > 0 and not la),
        float(open_),
    ]
    out = [bucket("f" + s[-3:])]
    # How the last sentence is built: its frame words, all others alike.
    last = SENTENCE.split(outside.replace("\n", " . "))[-1].lower()
    frame = ["0" if w[0].isdigit() else w if w in langs.frame else "_" for w in TOKEN.findall(last)[-9:]]
    for k in (2, 3, 4, 5, 6, 8):
        if len(frame) >= k:
            out.append(bucket("k" + " ".join(frame[-k:])))
    low = plain.lower()
    if not low.isascii():
        low = IDEOGRAPH.sub(r" \g<0> ", NO_WORD.sub(" ", low))
    return dense, out, low


NO_WORD = re.compile(r"[\W_]+")
LETTERS = textvec._class_table(b"", True)
_SEEDS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


class Described:
    """A batch of pairs: dense features and the weighted buckets of each pair, row after row."""

    def __init__(self, pairs: list[tuple[str, str, bool]], langs: Languages):
        made = [describe(q, a, o, langs) for q, a, o in pairs]
        n = len(made)
        self.x = np.array([m[0] for m in made]) if n else np.zeros((0, DENSE))
        w = textvec.Words([m[2] for m in made], LETTERS, fold=False)
        first = np.concatenate([[0], np.cumsum(w.n)])
        at = np.arange(len(w.row))
        pos, back, h = at - first[w.row], first[w.row + 1] - 1 - at, w.hash
        buckets, rows, edge = [], [], []

        def add(g, row, seed, is_edge):
            buckets.append(textvec.mix(g + seed))
            rows.append(row)
            edge.append(np.broadcast_to(is_edge, len(row)))

        with np.errstate(over="ignore"):
            g = h
            for k in (1, 2, 3):
                m = len(h) - k + 1
                if m <= 0:
                    break
                if k > 1:
                    g = textvec.mix(g[:m] * np.uint64(31) + h[k - 1 :])
                whole = w.row[:m] == w.row[k - 1 :]
                early = pos[:m] < START_WORDS
                add(g[whole], w.row[:m][whole], np.where(early, _SEEDS[k], _SEEDS[k + 3])[whole], early[whole])
                end = whole & (back[:m] < (2 if k == 1 else 4)) & (k < 3)
                add(g[end], w.row[:m][end], _SEEDS[0] + np.uint64(k), True)
            more = [b for m in made for b in m[1]]
            own = np.repeat(np.arange(n), [len(m[1]) for m in made])
        mask = np.uint64((1 << BITS) - 1)
        idx = np.concatenate([*((b & mask).astype(np.int64) for b in buckets), np.array(more, np.int64)])
        row = np.concatenate([*rows, own])
        edge = np.concatenate([*edge, np.ones(len(own), bool)])
        count = [np.bincount(row[e], minlength=n) for e in (~edge, edge)]
        order = np.argsort(row, kind="stable")
        self.idx, row, edge = idx[order], row[order], edge[order]
        self.row = row
        self.scale = np.where(edge, 1.0, REST_WEIGHT) / np.sqrt(1 + np.where(edge, count[1][row], count[0][row]))
        self.ptr = np.searchsorted(row, np.arange(n + 1))

    def logits(self, w: np.ndarray, v: np.ndarray) -> np.ndarray:
        z = self.x @ w.T
        for k in range(z.shape[1]):
            z[:, k] += np.bincount(self.row, v[self.idx, k] * self.scale, len(z))
        return z


# Words that no sentence ends with.
FUNCTION = set("the a an of to and or but with in on for from by as at that which who is are was were be been has have will would can could may its their this each every no than then when while because so if le la les un une des du de et ou mais avec dans pour par que qui est sont el los las una y o pero con en por para que es son der die das ein eine und oder aber mit im für von zu dass ist sind wird den dem des".split())


def _h(s: str) -> int:
    h = 2166136261
    for b in s.encode("utf-8", "replace"):
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return (h ^ h >> 13) & ((1 << BITS) - 1)


_memo: dict[str, int] = {}


def bucket(s: str) -> int:
    got = _memo.get(s)
    if got is None:
        if len(_memo) > 500_000:
            _memo.clear()
        got = _memo[s] = _h(s)
    return got


class Model:
    def __init__(self, langs: Languages, w: np.ndarray, v: np.ndarray, cut: np.ndarray):
        self.langs, self.w, self.v, self.cut = langs, w, v, cut

    def defects(self, pairs: list[tuple[str | None, str | None, bool]]) -> list[list[str]]:
        """The defects of each pair: the one with the largest margin over its threshold, and others that are far over theirs."""
        z = Described([(q or "", a or "", o) for q, a, o in pairs], self.langs).logits(self.w, self.v) - self.cut
        top = z.argmax(1)
        out = []
        for k, row in zip(top, z):
            if row[k] <= 0:
                out.append([])
            else:
                out.append([LABELS[k], *(LABELS[j] for j in range(1, 5) if k and j != k and row[j] > SECOND_MARGIN)])
        return out

    def defect(self, q: str | None, a: str | None) -> str | None:
        """The defect with the largest margin over its threshold, or None."""
        got = self.defects([(q, a, False)])[0]
        return got[0] if got else None


def synthesize(rows: list[tuple[str | None, str, str, str]], langs: Languages, rng: np.random.Generator) -> list[tuple[str, str, bool, int]]:
    """(question, answer, open, label) with answers spoilt in each of the five ways; of JSON, the raw output is cut off."""
    by_lang: dict[str, list[str]] = {}
    for _, q, a, _ in rows:
        la, m = langs.guess(a)
        if la and m > 2 and len(a) > 8:
            by_lang.setdefault(la, []).append(a)
    out = []
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    for k, (_, q, a, raw) in enumerate(rows):
        kind = k % 6
        if kind == 0:
            out.append((q, pick(PLACEHOLDERS), False, 0))
        for _ in range(2 if kind in (1, 2) else 0):
            b = cut_off(a if raw == a or rng.random() < 0.5 else raw, rng)
            if b:
                out.append((q, b if raw == a else answer_text(b), raw != a and is_open(b), 1))
        if kind in (1, 2):
            continue
        if kind == 3:
            lq, _ = langs.guess(q)
            names = re.findall(r"(?<=\s)[A-Z][a-z]+|`\w+`", q) or ["this topic", "internal matters", "the " + pick(_bag(q) or ["topic"])]
            if lq in FOREIGN_REFUSALS and rng.random() < 0.85:
                o, r, c = FOREIGN_REFUSALS[lq]
                t = pick(o) + pick(r)
                out.append((q, t[:1].upper() + t[1:] + pick(c), False, 2))
            else:
                t = pick(OPENERS) + pick(REFUSALS).replace("{x}", pick([*names, "this topic", "internal matters"])) + pick(CLOSERS)
                out.append((q, t[:1].upper() + t[1:], False, 2))
        elif kind == 4 and len(_bag(q)) >= 3:
            out.append((q, copied(q, rng), False, 3))
        elif kind == 5:
            lq, m = langs.guess(q)
            others = [x for x in by_lang if x != lq]
            if lq and m > 1 and others and not ASKED.search(q):
                out.append((q, pick(by_lang[pick(others)]), False, 4))
    return out


def cut_off(a: str, rng: np.random.Generator) -> str | None:
    """The answer broken off inside a sentence, word, list or code block."""
    s = a.rstrip()
    if len(s) < 25:
        return None
    at = int(rng.integers(max(8, len(s) // 5), len(s) - 2))
    if rng.random() < 0.5:  # between words
        at = s.rfind(" ", 0, at)
        if at < 8:
            return None
    b = s[:at].rstrip()
    if not b or b[-1] in ".!?。！？" and b.count("```") % 2 == 0:
        return None
    return b + ("..." if rng.random() < 0.04 else "")


def copied(q: str, rng: np.random.Generator) -> str:
    s = q.strip()
    forms = [s, s.lower(), f"  {s.upper()}  ", f"> {s}", f"Question: {s}", s.rstrip("?.!"), f"{s}\n{s}", f"{s} {s}", f'"{s}"', f"Q: {s}", s + "\n", f"**{s}**"]
    return forms[int(rng.integers(len(forms)))]


def fit(rows: list[tuple], seed: int = 11) -> Model:
    """A model from (language tag, question, answer, raw output) of a sample; without rows, one that flags only empty answers.

    A row without a raw output has none but its answer.
    """
    rows = [r if len(r) > 3 else (*r, r[2]) for r in rows]
    langs = learn_languages([r[:3] for r in rows])
    w0 = np.zeros((5, DENSE))
    w0[:, 0] = -6
    w0[0, 1], w0[0, 2] = 10, 4
    if len(rows) < 20:
        return Model(langs, w0, np.zeros((1 << BITS, 5)), np.zeros(5))
    rng = np.random.default_rng(seed)
    spoilt = synthesize(rows, langs, rng)
    # An answer that only lacks its last point is whole.
    bare = [(q, a.rstrip()[:-1], False, -1) for k, (_, q, a, _) in enumerate(rows) if k % 3 == 0 and a.rstrip()[-1:] in (".", "。") and len(a) > 40]
    data = [(q, a, raw != a and is_open(raw), -1) for _, q, a, raw in rows] + bare + spoilt
    data = [data[i] for i in rng.permutation(len(data))]
    made = Described([d[:3] for d in data], langs)
    label = np.array([d[3] for d in data])
    y = np.array([[float(k == j) for j in range(5)] for k in label])
    keep = np.ones(len(data), bool)
    hold = np.arange(len(data)) % 5 == 0
    for last in (False, True):
        w, v = _train(made, np.flatnonzero(keep & ~hold), y, w0, rng)
        z = made.logits(w, v)
        # Originals that the first round takes for defective are left out, also of the calibration.
        if not last:
            keep = (label >= 0) | (z.max(1) < -0.5)
    at = np.flatnonzero(keep & hold)
    cut = np.array([_cut(z[at, k], y[at, k]) for k in range(5)])
    return Model(langs, w, v, cut)


def _cut(z: np.ndarray, y: np.ndarray) -> float:
    """The threshold with the best F1 on held-out pairs."""
    if not 0 < y.sum() < len(y):
        return 0.0
    order = np.argsort(-z)
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    k = int(np.argmax(f1))
    return float((z[order[k]] + (z[order[k + 1]] if k + 1 < len(z) else z[order[k]] - 1)) / 2)


def _train(made: Described, fitted: np.ndarray, y: np.ndarray, w0: np.ndarray, rng: np.random.Generator, epochs: int = 4, batch: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """AdaGrad over small batches."""
    w, v = w0.copy(), np.zeros((1 << BITS, 5))
    gw, gv = np.full(w.shape, 1e-4), np.full(v.shape, 1e-4)
    x, ptr = made.x, made.ptr
    for _ in range(epochs):
        for rows in np.array_split(fitted[rng.permutation(len(fitted))], max(1, len(fitted) // batch)):
            size = ptr[rows + 1] - ptr[rows]
            seg = np.repeat(np.arange(len(rows)), size)
            at = np.arange(len(seg)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(ptr[rows], size)
            idx, scale = made.idx[at], made.scale[at]
            z = x[rows] @ w.T
            part = v[idx] * scale[:, None]
            for k in range(5):
                z[:, k] += np.bincount(seg, part[:, k], len(rows))
            e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[rows]) / len(rows)
            dw = e.T @ x[rows] + 1e-4 * w
            gw += dw * dw
            w -= 0.4 * dw / np.sqrt(gw)
            dv = e[seg] * scale[:, None]
            uniq, inv = np.unique(idx, return_inverse=True)
            dv = np.stack([np.bincount(inv, dv[:, k], len(uniq)) for k in range(5)], 1) + 2e-5 * v[uniq]
            gv[uniq] += dv * dv
            v[uniq] -= 0.3 * dv / np.sqrt(gv[uniq])
    return w, v


def pairs_of(chatml: DataFrame, payload: DataFrame) -> DataFrame:
    """(tbl, rec_id, turn, lang, question, answer) of every pair of both tables."""
    m = chatml.select("chat_id", "lang", "messages", F.expr("filter(sequence(1, greatest(size(messages) - 1, 1)), i -> i < size(messages) and messages[i].role = 'assistant' and messages[i - 1].role = 'user')").alias("turns"))
    turns = m.select("chat_id", "lang", "messages", F.explode("turns").alias("turn"))
    a = turns.select(F.lit("chatml").alias("tbl"), F.col("chat_id").alias("rec_id"), "turn", "lang", F.expr("messages[turn - 1].content").alias("question"), F.expr("messages[turn].content").alias("answer"))
    b = payload.select(F.lit("payload").alias("tbl"), F.col("payload_id").alias("rec_id"), F.lit(0).alias("turn"), "lang", F.col("instruction").alias("question"), F.col("output").alias("answer"))
    return a.unionByName(b)


def defects(pairs: DataFrame) -> DataFrame:
    """(tbl, rec_id, turn, defect) of the pairs that have one, each defect once.

    A null or blank answer is empty, whatever the question; a null question
    counts as an empty one. A pair with two defects has two rows. Other columns
    are ignored; an empty table gives an empty table.
    """
    spark = pairs.sparkSession
    ship(spark)
    rows = sample(pairs.where("question is not null and answer is not null").select("lang", "question", "answer", "tbl", "rec_id", "turn"), ["tbl", "rec_id", "turn"], SAMPLE_PAIRS)
    known = sorted({(r[0] or "", r[1], (answer_text(r[2]) if r[3] == "payload" else r[2]) or "", r[2]) for r in rows})
    shared = spark.sparkContext.broadcast(fit(known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            tbl, q, a = (b.column(i).to_pylist() for i in (0, 3, 4))
            for at in range(0, len(q), CHUNK_PAIRS):
                part = [(y, answer_text(z), is_open(z)) if x == "payload" else (y, z, False) for x, y, z in zip(tbl[at : at + CHUNK_PAIRS], q[at : at + CHUNK_PAIRS], a[at : at + CHUNK_PAIRS])]
                got = model.defects(part)
                take = pa.array(np.repeat(np.arange(at, at + len(part)), [len(x) for x in got]))
                yield pa.RecordBatch.from_arrays([*(b.column(i).take(take) for i in range(3)), pa.array([y for x in got for y in x], pa.string())], names=["tbl", "rec_id", "turn", "defect"])

    found = pairs.select("tbl", "rec_id", F.col("turn").cast("int").alias("turn"), "question", "answer").mapInArrow(run, "tbl string, rec_id bigint, turn int, defect string")
    return found.distinct()


#: Pairs scored at once in a worker.
CHUNK_PAIRS = 500
