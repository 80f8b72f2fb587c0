"""p2: credentials in source code and configuration files, and their redaction.

Candidates are values a file assigns, passes or mentions (quoted words, bare
values behind a credential's name, passwords in URLs, key blocks). A logistic
regression scores each from the likelihood of its characters under a Markov
model of ordinary identifiers, its shape, the words of the surrounding
identifier and the path. It is fitted on the candidates of all files, with weak
labels from patterns; values whose patterns say nothing are left out of the
fit and judged by what was learnt. Every step of the fit is a sum over all
labelled candidates that tasks add up in whole numbers, so the model depends
neither on the layout of the table nor on the order of its rows, and the driver
holds weights and sums of fixed sizes only.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, deque
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize, ship

BUCKETS = 1 << 12
REDACTED = "REDACTED"

# Words that name a credential, alone and as consecutive words; words that name something public.
SECRET_WORDS = {"password", "passwd", "pwd", "pw", "pass", "passphrase", "passcode", "secret", "token", "apikey", "apitoken", "bearer", "kennwort", "passwort", "contrasena", "clave", "senha", "credential", "credentials", "cred", "creds", "auth", "authorization", "pin", "dsn", "motdepasse", "mdp", "secretkey", "privatekey", "accesskey", "authtoken", "密码", "口令", "密钥", "wachtwoord", "parola", "sesame"}
SECRET_PAIRS = {("api", "key"), ("secret", "key"), ("private", "key"), ("signing", "key"), ("encryption", "key"), ("access", "key"), ("deploy", "key"), ("license", "key"), ("master", "key"), ("ssh", "key"), ("hmac", "key"), ("de", "passe"), ("account", "key"), ("storage", "key"), ("service", "key"), ("auth", "key"), ("shared", "key"), ("client", "key"), ("session", "key"), ("webhook", "key"), ("cle", "api")}
PUBLIC_WORDS = {"public", "id", "sha", "sha1", "sha256", "md5", "hash", "digest", "checksum", "sum", "commit", "revision", "integrity", "etag", "uuid", "guid", "fingerprint", "length", "len", "count", "size", "file", "path", "days", "hint", "stream", "name", "store", "store", "rotation", "ttl", "expiry", "url", "host", "endpoint", "header", "field", "type", "version", "limit", "max", "min", "tokenizer", "keyring"}

VENDOR = re.compile(r"(?:sk|rk|pk)_(?:live|test)_\w{8}|sk-[\w-]{16}|gh[pousr]_\w{12}|github_pat_\w{12}|xox[abeprs]-[\w-]{8}|A(?:KIA|SIA)[0-9A-Z]{12}|AIza[\w-]{16}|glpat-[\w-]{10}|npm_\w{16}|pypi-\w{12}|hf_\w{16}|SG\.[\w-]{10}|shp(?:at|ss)_\w{12}|dop_v1_\w{12}|ya29\.[\w-]{10}|eyJ[\w-]{6,}\.eyJ[\w-]{4}")
NAME_HINT = r"(?i:pass|pwd|pw\b|secret|token|key|auth|cred|kennwort|contrase|clave|senha|dsn|bearer|密|口令)"
CANDIDATE = re.compile(
    r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----"  # a key block
    r"|[A-Za-z][A-Za-z0-9+.-]*://[^\s/:@\"'`]*:(?P<url>[^\s/@\"'`]+)@"
    r"|(?P<q>[\"'`])(?P<quoted>[^\s\"'`]{5,})(?P=q)"
    r"|(?i:\b(?:bearer|basic)\s+)(?P<scheme>[^\s\"'`,;<>()]{6,})"
    r"|(?i:\s--?(?:password|passwd|pass|token|secret|api[-_]?key|auth|access[-_]token|p)[ =]|\s-u\s+[\w.-]+:|--user[ =][\w.-]+:)(?P<flag>[^\s\"'`$<>()-][^\s\"'`<>()]{5,})"
    rf"|(?<![\w./$-])(?P<name>[\w.-]*{NAME_HINT}[\w.-]*)(?:\s*(?::=|[:=])\s*(?:[|>][+-]?[ \t]*\n[ \t]*)?|[ \t]+(?:was|is|are|to)[ \t]+)(?P<bare>(?!-----)[^\s\"'`,;(){{}}\[\]<>|][^\s\"'`,;(){{}}<>]{{4,}})"
    r"|(?<![\w.-])(?P<vendor>(?:[rsp]k_(?:live|test)_|gh[pousr]_|xox[abeprs]-|AKIA|AIza|eyJ[\w-]+\.eyJ)[\w.-]{8,})",
)
BLOCK_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
IDENT = re.compile(r"[A-Za-z_\u00c0-\uffff][\w.-]*")
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z\u00c0-\uffff]+|\d+")
REFERENCE = re.compile(r"\$\{|\$\(|\{\{|\}\}|%\(|^<.*>$|^\$[A-Za-z_{]|^(?:env|vault|ssm|secret|secrets|file|kms|op|aws|gcp|azure|keyring|ref|store)[:/]|^(?:process\.env|os\.environ|os\.getenv|ENV\[|getenv|self\.|this\.|config\.|settings\.|args\.|import\.|req\.)|^/(?:run|etc|var|secrets|mnt|home|opt|usr)/|^\.{0,2}/|^arn:|\(\)?$|\.(?:json|ya?ml|toml|pem|txt|env|key|crt|cfg|ini|conf|py|js|ts|sh)$", re.I)
PLACEHOLDER = re.compile(r"^(?:(.)\1{3,}|.{0,12}(?:change[-_ ]?me|replace[-_ ]?me|your[-_ ]|placeholder|example|dummy|redacted|todo|fixme|insert[-_ ]|sample|foo ?bar|not[-_]?(?:set|used)|none|null|undefined|true|false|test[-_]?(?:key|token|secret|password)|x{6,}|\*{4,}|\.{4,}).*)$", re.I)
NUMBER = re.compile(r"^[+-]?[\d._,]+[a-z%]{0,3}$")
HEX = re.compile(r"^[0-9a-fA-F]{16,}$")
UUID = re.compile(r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
IDENTIFIER = re.compile(r"^_*(?:[a-z]+|[A-Z]+|[A-Z]?[a-z]{2,}(?:[A-Z][a-z]{2,})*)(?:[._/:-]+(?:[a-z]+|[A-Z]+|[A-Z]?[a-z]{2,}(?:[A-Z][a-z]{2,})*))*$")
COPY = re.compile(r"^sha\d{3}[-:]|^[a-z]+/[a-z+.-]+$|^https?:")


def name_words(name: str) -> list[str]:
    return [w.lower() for w in WORDS.findall(name)]


def names_secret(words: list[str]) -> bool:
    """Whether a name is a credential's: a word or pair that says so and is not a remark on one (its length, its file)."""
    if not words:
        return False
    hit = -1
    for i, w in enumerate(words):
        if w in SECRET_WORDS or i and (words[i - 1], w) in SECRET_PAIRS:
            hit = i
    return hit >= 0 and not any(w in PUBLIC_WORDS for w in words[hit + 1 :]) and not (hit and words[hit - 1] == "public")


USERINFO = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://[^\s/:@]*:([^\s/@]+)@")
GLUE = re.compile(r"""[ \t]*[+\\.]?[ \t]*(?:\r?\n[ \t]*)?[+.]?[ \t]*$""")
USER_FLAG = re.compile(r"(?:\s-u\s*|--user[ =])[\w.@-]+:$")


def candidates(text: str) -> list[tuple[int, int, str, str, str]]:
    """(start, end, value, name, kind) of each candidate, in order.

    Quoted pieces that a file puts together are one value. References,
    placeholders and numbers are no candidates, nor are plain words that no
    credential's name stands before.
    """
    out: list[tuple[int, int, str, str, str]] = []
    last = 0
    whole = ""  # the value of the quoted pieces that end at `joint`, candidate or not
    joint, owner = -9, -1
    for m in CANDIDATE.finditer(text):
        kind = m.lastgroup
        if kind is None:
            start = m.start()
            e = BLOCK_END.search(text, m.end())
            end = e.end() if e else m.end()
            out.append((start, end, m[0], _name(text, start), "block"))
            last = end
            continue
        if kind == "q":
            kind = "quoted"
        elif kind == "name":
            kind = "bare"
        start, end = m.span(kind)
        if start < last:
            continue
        value = m[kind]
        if kind == "quoted":
            if m.start() - joint < 80 and joint > 0 and GLUE.fullmatch(text, joint, m.start()):
                # A further piece of the value before.
                whole += value
                joint = m.end()
                if owner >= 0:
                    a, _, _, name, k = out[owner]
                    out[owner] = (a, end, whole, name, k)
                    last = end
                continue
            whole, joint, owner = value, m.end(), -1
            u = USERINFO.search(value)
            if u:
                start, end, value, kind = start + u.start(1), start + u.end(1), u[1], "url"
            elif USER_FLAG.search(text, max(0, m.start() - 60), m.start()):
                kind = "flag"
        if NUMBER.match(value) or REFERENCE.search(value) and not VENDOR.match(value) or PLACEHOLDER.match(value) and not VENDOR.match(value):
            continue
        if kind == "quoted" and IDENTIFIER.match(value) and not value.isalpha():
            continue
        name = m["name"] if kind == "bare" else _name(text, m.start())
        if kind == "quoted" and IDENTIFIER.match(value) and not names_secret(name_words(name)):
            continue
        if m.lastgroup in ("quoted", "q") and kind == "quoted":
            owner = len(out)
        out.append((start, end, value, name, kind))
        last = end
    return out


# Words between a credential's name and its value that name nothing themselves.
PREFIXES = {"r", "b", "f", "u", "or", "str", "String", "Bearer", "Basic", "bearer"}
CALLS = {"r", "b", "f", "u", "or", "str", "String", "os", "getenv", "process", "env", "environ", "const", "export"}


def _before(text: str, a: int, at: int) -> Iterator[str]:
    """The identifiers of text[a:at], the last first; only as much is read as is asked for."""
    step = 160
    to = at
    while to > a:
        # A window that begins at a blank or at the line's start holds whole identifiers.
        start = max(a, to - step)
        while start > a and NAMED.match(text, start - 1):
            start -= 1
        yield from reversed(IDENT.findall(text, start, to))
        to, step = start, 2 * step


NAMED = re.compile(r"[\w.\-\u00c0-\uffff]")


def _name(text: str, at: int) -> str:
    """The identifier before a position on its line; else that of an opener that ends the line above."""
    a = text.rfind("\n", 0, at) + 1
    found = next(_before(text, a, at), "")
    if found in PREFIXES:
        return next((x for x in _before(text, a, at) if x not in CALLS), "")
    if found:
        return found
    if a > 1:
        b = text.rfind("\n", 0, a - 1) + 1
        end = a - 1
        while end > b and text[end - 1].isspace():
            end -= 1
        if text.endswith(("(", "|", ">", "=", "\\", ":", "|-", ">-", "["), b, end):
            return next(_before(text, b, end), "")
    return ""


class Markov:
    """Character bigrams of ordinary names and values; -log2 likelihood per character."""

    ALPHABET = 64

    def __init__(self, counts: np.ndarray):
        p = counts + 0.5
        self.cost = -np.log2(p / p.sum(1, keepdims=True))

    @staticmethod
    def codes(value: str) -> np.ndarray:
        b = np.frombuffer(value.encode("utf-8", "replace"), np.uint8)
        return CODE[b]

    def score(self, value: str) -> float:
        c = self.codes(value)
        return float(self.cost[c[:-1], c[1:]].mean()) if len(c) > 1 else 0.0


CODE = np.full(256, 63, np.int64)
for _i, _c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"):
    CODE[ord(_c)] = _i

DENSE = 20


def dense(value: str, words: list[str], kind: str, markov: Markov) -> list[float]:
    n = len(value)
    counts = Counter(value)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    digits = sum(c.isdigit() for c in value)
    upper = sum(c.isupper() for c in value)
    special = sum(not c.isalnum() and c not in "_-./:" for c in value)
    cost = markov.score(value)
    return [
        1.0,
        cost / 4,
        cost * (n >= 12) / 4,
        min(n, 64) / 32,
        entropy / 4,
        digits / n,
        upper / n,
        min(special, 4) / 2,
        float(digits > 0),
        float(bool(VENDOR.search(value))),
        float(bool(REFERENCE.search(value))),
        float(bool(PLACEHOLDER.match(value))),
        float(bool(HEX.match(value))),
        float(bool(UUID.match(value))),
        float(bool(IDENTIFIER.match(value))),
        float(bool(COPY.match(value))),
        float(names_secret(words)),
        float(any(w in PUBLIC_WORDS for w in words)),
        float(kind == "url") + float(kind == "block"),
        float(kind in ("scheme", "flag")),
    ]


def hashed(words: list[str], path: str, kind: str) -> list[int]:
    """Buckets of the words of the identifier, the end of the path and the kind."""
    parts = path.replace("\\", "/").lower().rsplit(".", 1)
    keys = [f"w={w}" for w in words[-4:]] + [f"e={parts[-1][:5]}", f"k={kind}", f"d={parts[0].split('/')[-2] if parts[0].count('/') else ''}"]
    return [_fnv(k) for k in keys]


def _fnv(s: str) -> int:
    h = 2166136261
    for b in s.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return (h ^ h >> 15) % BUCKETS


def weak_label(value: str, words: list[str], kind: str) -> int | None:
    """1 or 0 where patterns decide, None where they say nothing."""
    if kind == "block":
        return 1
    if REFERENCE.search(value) or PLACEHOLDER.match(value) or NUMBER.match(value):
        return 0
    if VENDOR.search(value):
        return 1
    if kind == "url":
        return 1
    secret = names_secret(words)
    mixed = any(c.isdigit() for c in value) or any(not c.isalnum() and c not in "_-./:" for c in value)
    if secret or kind in ("scheme", "flag"):
        if mixed and len(value) >= 6 and not COPY.match(value) or _random(value) and not IDENTIFIER.match(value):
            return 1
        return 0 if IDENTIFIER.match(value) else None
    if any(w in PUBLIC_WORDS for w in words) or COPY.match(value) or IDENTIFIER.match(value) or len(value) > 200 or not words:
        return 0
    return None if _random(value) else 0


def _random(value: str) -> bool:
    n = len(value)
    return n >= 12 and any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and len(set(value)) >= n * 0.4


class Model:
    def __init__(self, markov: Markov, w: np.ndarray, v: np.ndarray, cut: float):
        self.markov, self.w, self.v, self.cut = markov, w, v, cut

    def score(self, value: str, name: str, kind: str, path: str) -> float:
        words = name_words(name)
        z = float(np.dot(self.w, dense(value, words, kind, self.markov))) + float(self.v[hashed(words, path, kind)].sum())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


#: Weights to start from; with labels of one kind only they are the model.
PRIOR = np.array([-4.0, 0, 0, 0, 0, 0, 0, 0, 0, 6, -6, -6, 0, 0, -2, -2, 4, -2, 6, 2])
#: Sums of slopes and losses are whole numbers of this part of one; scores are counted in so many ranges for the threshold.
UNIT, RANGES = 1 << 20, 1 << 12
PENALTY = 1e-4

LETTER = np.zeros(256, bool)
LETTER[np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_", np.uint8)] = True

#: (value, name, kind, path, label, held out) of a labelled candidate.
Labelled = tuple[str, str, str, str, int, bool]
#: Features, buckets, labels and what is held out, of some labelled candidates.
Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def word_bigrams(b: bytes) -> np.ndarray:
    """Counts of the character bigrams inside words of four letters and more."""
    a = np.frombuffer(b, np.uint8)
    m = LETTER[a]
    if len(m) < 4:
        return np.zeros(4096, np.int64)
    four = m[:-3] & m[1:-2] & m[2:-1] & m[3:]
    inside = np.zeros(len(m) - 1, bool)
    for k in range(3):
        inside[k : len(inside) - 2 + k] |= four
    c = CODE[a]
    return np.bincount((c[:-1] * 64 + c[1:])[inside], minlength=4096)


def learnt_from(path: str, text: str, found: Iterable[tuple[str, str, str]], counts: np.ndarray) -> Iterator[Labelled]:
    """The labelled ones of a file's candidates (value, name, kind); its bigrams are added to the counts."""
    b = text.encode("utf-8", "replace")
    counts += word_bigrams(b)
    held = zlib.crc32(b) % 5 == 0  # a fifth of the files is held out for the threshold, equal texts together
    for value, name, kind in found:
        y = weak_label(value, name_words(name), kind)
        if y is None:
            continue
        if y == 0 and len(value) < 80:
            c = Markov.codes(value)
            np.add.at(counts, c[:-1] * 64 + c[1:], 1)
        yield value, name, kind, path, y, held


def block(rows: list[Labelled], markov: Markov) -> Block:
    x, h = np.empty((len(rows), DENSE), np.float32), np.full((len(rows), 7), BUCKETS, np.int16)
    for i, (value, name, kind, path, _, _) in enumerate(rows):
        words = name_words(name)
        x[i] = dense(value, words, kind, markov)
        keys = hashed(words, path, kind)
        h[i, : len(keys)] = keys
    return x, h, np.array([r[4] for r in rows], np.int8), np.array([r[5] for r in rows], bool)


def _margins(x: np.ndarray, h: np.ndarray, p: np.ndarray) -> np.ndarray:
    z = (x * p[:DENSE]).sum(1) + np.append(p[DENSE:], 0.0)[h].sum(1)
    return np.clip(z, -30, 30)


def tally(part: Block) -> np.ndarray:
    """Counts by what is held out and the label."""
    _, _, y, held = part
    return np.bincount(2 * held + y, minlength=4)


def slope(part: Block, p: np.ndarray, weight: float, everything: bool) -> np.ndarray:
    """Slopes of the loss at the weights p, and the loss, summed over the fitted rows."""
    x, h, y, held = part
    if not everything:
        x, h, y = x[~held], h[~held], y[~held]
    z = _margins(x, h, p)
    each = np.where(y > 0, weight, 1.0) * UNIT
    g = (1 / (1 + np.exp(-z)) - y) * each
    v = np.bincount(h.ravel(), np.repeat(np.rint(g), h.shape[1]), BUCKETS + 1)[:BUCKETS]
    loss = np.rint((np.logaddexp(0, z) - y * z) * each).sum()
    return np.concatenate([np.rint(x * g[:, None]).sum(0), v, [loss]]).astype(np.int64)


def heights(part: Block, p: np.ndarray) -> np.ndarray:
    """Counts of the held-out rows by label and range of the score."""
    x, h, y, held = part
    s = 1 / (1 + np.exp(-_margins(x[held], h[held], p)))
    return np.bincount(np.where(y[held], RANGES, 0) + np.minimum(s * RANGES, RANGES - 1).astype(np.int64), minlength=2 * RANGES)


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray) -> np.ndarray:
    """L-BFGS on a convex function, until two steps in a row lower it by less than a thousandth."""
    past: deque[tuple[np.ndarray, np.ndarray, float]] = deque(maxlen=10)
    fx, g = f(x)
    small = 0
    while small < 2:
        d, used = -g, []
        for s, y, r in reversed(past):
            used.append(r * (s @ d))
            d = d - used[-1] * y
        if past:
            s, y, r = past[-1]
            d = d / (r * (y @ y))
        for (s, y, r), a in zip(past, reversed(used), strict=True):
            d = d + (a - r * (y @ d)) * s
        step = 1.0
        while True:
            nx = x + step * d
            nf, ng = f(nx)
            if nf <= fx + 1e-4 * step * (g @ d):
                break
            step /= 4
            if step < 1e-6:  # the sums are too coarse for a lower value
                return x
        s, y = nx - x, ng - g
        if s @ y > 1e-12:
            past.append((s, y, 1 / (s @ y)))
        small = small + 1 if fx - nf < 1e-3 * fx else 0
        x, fx, g = nx, nf, ng
    return x


def trained(markov: Markov, total: Callable[[Callable[[Block], np.ndarray], int], np.ndarray]) -> Model:
    """The model of rows that are only seen through total(f, n): the sum of the n numbers that f gives for each block of them."""
    n = total(tally, 4)
    neg, pos = int(n[0] + n[2]), int(n[1] + n[3])
    if not neg or not pos:
        return Model(markov, PRIOR, np.zeros(BUCKETS), 0.5)
    everything = not (n[0] and n[1])  # too few for a fit on some of them
    fitted = neg + pos if everything else int(n[0] + n[1])
    weight = max(1.0, min(8.0, neg / pos / 4))

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        s = total(partial(slope, p=p, weight=weight, everything=everything), DENSE + BUCKETS + 1) / UNIT / fitted
        return float(s[-1] + PENALTY / 2 * (p @ p)), s[:-1] + PENALTY * p

    p = minimise(loss, np.concatenate([PRIOR, np.zeros(BUCKETS)]))
    cut = 0.5 if everything else calibrated(total(partial(heights, p=p), 2 * RANGES).reshape(2, RANGES))
    return Model(markov, p[:DENSE], p[DENSE:], cut)


def fit(files: list[tuple[str, str]]) -> Model:
    """A model from (path, text) of files in memory; with no labelled positive the patterns alone give the weights."""
    counts = np.zeros(4096, np.int64)
    rows = [r for path, text in files for r in learnt_from(path, text, [c[2:] for c in candidates(text)], counts)]
    markov = Markov(counts.reshape(64, 64))
    part = block(rows, markov)
    return trained(markov, lambda f, n: f(part))


def calibrated(counts: np.ndarray) -> float:
    """The score with the best F1 on held-out candidates, counted by label and range of the score; between 0.3 and 0.7."""
    if not counts.sum(1).all():
        return 0.5
    at = np.flatnonzero(counts.sum(0))[::-1]  # the ranges with scores, the highest first
    hits, taken = np.cumsum(counts[1, at]), np.cumsum(counts[:, at].sum(0))
    k = int(np.argmax(2 * hits / (taken + counts[1].sum())))
    cut = float(at[k] + (at[k + 1] if k + 1 < len(at) else 0) + 1) / 2 / RANGES
    return min(0.7, max(0.3, cut))


def find(text: str, path: str, model: Model) -> list[tuple[int, int, float]]:
    """(start, end, score) of each credential in a text, in order and apart."""
    return judged(candidates(text), path, model)


def judged(found: Iterable[tuple[int, int, str, str, str]], path: str, model: Model) -> list[tuple[int, int, float]]:
    out = []
    for start, end, value, name, kind in found:
        p = model.score(value, name, kind, path)
        if p >= model.cut and (not out or start >= out[-1][1]):
            out.append((start, end, p))
    return out


def redact(text: str, found: list[tuple[int, int, float]]) -> str:
    """The text with each credential replaced, all else unchanged."""
    out, at = [], 0
    for a, b, _ in found:
        out += [text[at:a], REDACTED]
        at = b
    return "".join([*out, text[at:]])


FOUND = "array<struct<line_no:int,score:double>>"
CANDIDATES = "array<struct<a:int,b:int,value:string,name:string,kind:string>>"
LEARNT = "value string, name string, kind string, p string, y int, held boolean, i int, n bigint"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds their candidates to rows of (k, p, t)."""
    fields = ("a", "b", "value", "name", "kind")
    item = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("value", pa.string()), ("name", pa.string()), ("kind", pa.string())]))
    for b in batches:
        found = [[dict(zip(fields, c, strict=True)) for c in candidates(t)] if t else [] for t in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, item)], names=["k", "p", "t", "c"])


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The labelled candidates of rows of (p, t, c), then the task's counts of bigrams (i, n)."""
    schema = pa.schema([("value", pa.string()), ("name", pa.string()), ("kind", pa.string()), ("p", pa.string()), ("y", pa.int32()), ("held", pa.bool_()), ("i", pa.int32()), ("n", pa.int64())])
    counts = np.zeros(4096, np.int64)
    for b in batches:
        rows = []
        for p, t, found in zip(*(b.column(x).to_pylist() for x in range(3)), strict=True):
            rows += learnt_from(p or "", t, [(c["value"], c["name"], c["kind"]) for c in found], counts)
        if rows:
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=False)]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.int64())], schema=schema)
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([*(pa.nulls(len(at), f.type) for f in list(schema)[:6]), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], schema=schema)


def fit_table(rows: DataFrame) -> Model:
    """The model of all files of (k, p, t, c): key, path, text and candidates. A key counts once, with the text of its least hash."""
    once = rows.where(F.length("t") > 0).groupBy("k").agg(F.min_by(F.struct("p", "t", "c"), F.xxhash64("p", "t")).alias("r")).select("r.p", "r.t", "r.c")
    learnt = materialize(once.mapInArrow(_learn, LEARNT), "p2-learnt")
    counts = np.zeros(4096, np.int64)
    for r in learnt.where("i IS NOT NULL").groupBy("i").agg(F.sum("n").alias("n")).collect():
        counts[r["i"]] = r["n"]
    markov = Markov(counts.reshape(64, 64))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            part = block([tuple(r.values()) for r in b.to_pylist()], markov)
            yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in part], names=["x", "h", "y", "held"])

    parts = materialize(learnt.where("i IS NULL").select("value", "name", "kind", "p", "y", "held").mapInArrow(blocks, "x binary, h binary, y binary, held binary"), "p2-blocks")

    def total(f: Callable[[Block], np.ndarray], n: int) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s = np.zeros(n, np.int64)
            for b in batches:
                for x, h, y, held in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    s += f((np.frombuffer(x, np.float32).reshape(-1, DENSE), np.frombuffer(h, np.int16).reshape(-1, 7), np.frombuffer(y, np.int8), np.frombuffer(held, bool)))
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(s[at], pa.int64())], names=["i", "n"])

        out = np.zeros(n, np.int64)
        for r in parts.mapInArrow(run, "i int, n bigint").groupBy("i").agg(F.sum("n").alias("n")).collect():
            out[r["i"]] = r["n"]
        return out

    return trained(markov, total)


def scan(df: DataFrame, key: str, path: str, code: str) -> DataFrame:
    """(key, found ARRAY<STRUCT<line_no, score>>, redacted) of every row.

    Null texts stay null with nothing found; empty texts stay empty. Repeated
    rows come out as often as they come in; other columns are dropped.
    """
    spark = df.sparkSession
    ship(spark)
    kind = dict(df.dtypes)[key]
    rows = materialize(df.select(F.col(key).alias("k"), F.col(path).alias("p"), F.col(code).alias("t")).mapInArrow(_extract, f"k {kind}, p string, t string, c {CANDIDATES}"), "p2-candidates")
    model = spark.sparkContext.broadcast(fit_table(rows))
    item = pa.list_(pa.struct([("line_no", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            found, clean = [], []
            for p, t, c in zip(*(b.column(x).to_pylist() for x in (1, 2, 3)), strict=True):
                got = judged((tuple(x.values()) for x in c), p or "", m)
                found.append([{"line_no": t.count("\n", 0, a) + 1, "score": s} for a, _, s in got])
                clean.append(redact(t, got) if got else t)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, item), pa.array(clean, pa.string())], names=["key", "found", "redacted"])

    out = rows.mapInArrow(run, f"key {kind}, found {FOUND}, redacted string")
    return out.withColumnRenamed("key", key)
