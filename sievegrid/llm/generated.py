"""p6: generated, minified, vendored and data-only source files.

Every file's token sequence is folded by Re-Pair: the commonest adjacent pair
of symbols becomes a rule, again and again. A whole batch of files is folded at
once on arrays, each as it would be alone. Three measures come of it: what one
much reused rule covers of a file tells generated files; how little rules save
on the bytes of its literals, and the share of literals, tell data saved as
code; rules of lines that are cut by content, and so equal wherever their text
is equal, tell files that many repositories share.

Whether a file is generated or vendored is one decision over these measures,
the phrases of its leading comments and the parts of its path: a logistic
regression, fitted on a bounded sample of files with weak labels from notices,
names and folders, whose threshold is set on held-out files.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize, ship
from . import textvec
from .sampling import sample

#: Thresholds: tokens and uses of a rule, and share of a file that its uses cover, which labels it weakly as generated; length, share and blanks of
#: the longest line; share of literals, their bytes, and what of these the grammar leaves; repositories that share a rule.
RULE_TOKENS, RULE_USES, RULE_COVER, MIN_TOKENS = 9, 8, 0.87, 60
MINIFIED_LINE, MINIFIED_SHARE, MINIFIED_BLANKS = 400, 0.5, 0.1
DATA_SHARE, DATA_BYTES, DATA_LEFT = 0.8, 200, 1.15
SHARED_REPOSITORIES = 6
CHUNK_BYTES = 400_000
#: Files that the decisions are fitted on, in the order of a hash of their key; buckets of phrases and path parts.
SAMPLE_FILES, BUCKETS = 12_000, 1 << 14

STRING = re.compile(r"""\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`|/\*[\s\S]*?\*/|(?m:^[ \t]*(?:\#|//)[^\n]*)""")

# How notices of tools and of third parties are worded.
TOOL_NOTICE = re.compile(
    r"(?i)code generated by|@generated\b|<auto-?generated|\bauto-?generated\b|generated (?:by|from|with|using)\b[^\n]*(?:do not|don't|overwritten|\.schema|\.idl|\.proto)|do not (?:edit|modify)\b|this file (?:is|was) (?:auto|generated|produced|created) [^\n]*(?:by|from)|changes (?:will|would) be (?:overwritten|lost)|produced by [^\n]*(?:compiler|codegen|generator)"
    r"|machine (?:output|generated|written)|compiler [\w.-]+, do not|(?:wurde|wird) (?:von [^\n]*|automatisch )(?:erzeugt|generiert)|automatisch (?:erzeugt|generiert)|nicht (?:bearbeiten|ändern)|(?:fichier|code) (?:a été )?(?:généré|produit)|ne pas (?:modifier|éditer)|(?:archivo|fichero|código) (?:fue )?generado|generado (?:por|automáticamente)|no (?:editar|modificar)|自动生成|由[^\n]*生成|请勿(?:编辑|修改)|不要(?:编辑|修改)"
)
VENDOR_NOTICE = re.compile(
    r"(?i)vendored (?:copy|from)|(?:taken|copied|imported|borrowed)(?: unchanged| verbatim| unmodified)? from (?:[\w./-]+@\d|release|upstream|[\w.-]+ v?\d)|imported unchanged from|\d+\.\d+[^\n]*(?:released under|distributed under|licen[sc]ed under)[^\n]*licen[sc]e|licen[sc]e file of|copyright \(c\) (?:\d{4} )?the [^\n]*(?:contributors|authors|developers)|all rights reserved|send (?:fixes|patches) upstream|third[- ]party (?:code|copy|source)|SPDX-License-Identifier"
)
VENDOR_FOLDER = re.compile(r"(?:^|/)(?:node_modules|vendor|vendored|_vendor|third[_-]?party|3rd[_-]?party|deps|extern|externals?|site-packages|bower_components|Pods|jspm_packages)/", re.I)
TOOL_NAME = re.compile(r"(?i)(?:\.min\.\w+|\.g\.\w+|\.lock\.\w+|[-.]bundle\.\w+|_pb2(?:_grpc)?\.py|\.pb\.\w+|\.generated\.\w+|-lock\.\w+|\.bundle\.\w+|\.designer\.\w+)$|(?:^|/)(?:__generated__|generated)/")
COMMENT_LINE = re.compile(r"^\s*(?:#|//|/\*|\*|<!--|;|--)")


def leading(text: str) -> str:
    """The comments before the first line of code, however long, and the comment lines among the first ten lines: where
    notices stand; strings that merely hold one do not count, nor do remarks further down."""
    lines = [x for x in text[:3000].split("\n")[:10] if COMMENT_LINE.match(x)]
    at, block = 0, False
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        line = text[at:end]
        if not block and line.strip() and not COMMENT_LINE.match(line):
            break
        opened = block or line.lstrip().startswith("/*")
        close = line.find("*/") if opened else -1
        block = opened and close < 0
        lines.append(line if close < 0 else line[:close])
        if close >= 0 and line[close + 2 :].strip():
            break
        at = end + 1
    return "\n".join(lines)


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(symbol, file): names, numbers and strings are one symbol each, blanks none."""
    shapes = [STRING.sub('"', t) for t in texts]
    w = textvec.Words(shapes, _WORDCHARS, fold=False)
    buf = w.raw
    sym = buf.astype(np.int32)
    digit = (buf[w.start] >= 48) & (buf[w.start] <= 57)
    keep = np.ones(len(buf), bool)
    keep[(buf == 32) | (buf == 9) | (buf == 13)] = False
    inside = np.zeros(len(buf) + 1, np.int32)
    np.add.at(inside, w.start, 1)
    np.add.at(inside, w.end, -1)
    keep[np.cumsum(inside[:-1]) > 0] = False
    keep[w.start] = True
    sym[w.start] = np.where(digit, 48, 110)
    file = np.repeat(np.arange(len(texts)), np.diff(w.offsets))
    return sym[keep], file[keep]


_WORDCHARS = textvec._class_table(b"_.$", True)


def repair(sym: np.ndarray, file: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rules, symbols left, cover) of each of n files, folded together.

    A round replaces every pair that occurs twice or more and more often than
    the pairs it overlaps, until no pair occurs twice. A symbol is a hash of
    what it stands for, so ties are settled by content, not by the place of a
    file in its batch. cover is the largest share of a file that the uses of
    one rule of RULE_TOKENS tokens and RULE_USES uses or more make up.
    """
    rules = np.zeros(n, np.int64)
    left = np.zeros(n, np.int64)
    cover = np.zeros(n)
    total = np.maximum(1, np.bincount(file, minlength=n))
    sym = textvec.mix(sym.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    width = np.ones(len(sym), np.int64)  # tokens that a symbol stands for
    salt = textvec.mix(np.arange(1, n + 1, dtype=np.uint64))
    while len(sym) >= 2:  # each round shortens the symbols or is the last
        own = file[:-1]
        ok = own == file[1:]
        with np.errstate(over="ignore"):
            pair = textvec.mix(sym[:-1] * np.uint64(3) + sym[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
            key = pair ^ salt[own]
        key[~ok] = 0
        _, inv, cnt = np.unique(key, return_inverse=True, return_counts=True)
        c = np.where(ok, cnt[inv], 0)
        best = np.zeros(n, np.int64)
        np.maximum.at(best, own, c)
        done = best[file] < 2
        # A pair is folded where it is more frequent than the pairs that overlap it (ties by hash), so equal lines fold
        # alike; runs of one pair fold at alternate positions.
        rank_of = np.where(c >= 2, (np.minimum(c, (1 << 20) - 1) << 40) | (pair >> np.uint64(24)).astype(np.int64), 0)
        before, after = np.concatenate([[0], rank_of[:-1]]), np.concatenate([rank_of[1:], [0]])
        at = np.flatnonzero((rank_of > 0) & (rank_of >= before) & (rank_of >= after))
        if len(at):
            run = np.concatenate([[True], np.diff(at) != 1])
            at = at[(at - at[run][np.cumsum(run) - 1]) % 2 == 0]
            _, inv2, c2 = np.unique(inv[at], return_inverse=True, return_counts=True)
            at = at[c2[inv2] >= 2]
        if not len(at):
            break
        code, inv2, c2 = np.unique(inv[at], return_inverse=True, return_counts=True)
        owner = np.zeros(len(code), np.int64)
        owner[inv2] = own[at]
        rules += np.bincount(owner, minlength=n)
        sym[at] = pair[at]
        width[at] += width[at + 1]
        long = (width[at] >= RULE_TOKENS) & (c2[inv2] >= RULE_USES)
        np.maximum.at(cover, own[at][long], (c2[inv2] * width[at] / total[own[at]])[long])
        left += np.bincount(file[done], minlength=n)
        keep = ~done
        keep[at + 1] = False
        sym, file, width = sym[keep], file[keep], width[keep]
    return rules, left + np.bincount(file, minlength=n), cover


def line_rules(text: str) -> list[int]:
    """Content-defined rules of a file: runs of its lines, cut where a line's hash says so; equal text gives equal rules."""
    rules, run = [], 0
    for line in text.split("\n"):
        line = line.strip()
        if len(line) < 4:
            continue
        h = hash_line(line)
        run = (run * 1_000_003 + h) & 0x7FFFFFFFFFFFFFFF
        if h % 4 == 0:
            rules.append(run)
            run = 0
    if run:
        rules.append(run)
    return rules


def hash_line(line: str) -> int:
    b = line.encode("utf-8", "replace")
    return zlib.crc32(b) << 16 ^ zlib.adler32(b)


LITERAL = re.compile(r"""[\"'`]{1,3}((?:[^\"'`\\\n]|\\.){4,})[\"'`]|(?<![\w.])(-?\d[\w.]*)|^[ \t]*([A-Za-z0-9+/=]{40,})[ \t]*$""", re.M)


def literals(text: str) -> bytes:
    """The bytes of a file's strings, numbers and bare lines of code points."""
    return "".join(a or b or c for a, b, c in LITERAL.findall(text)).encode("utf-8", "replace")


def left_of(parts: list[bytes]) -> np.ndarray:
    """What the grammar leaves of each byte sequence: bits of its symbols and rules over bits of its bytes, so that 1 and more
    means that nothing is saved; 0 for an empty one."""
    n = len(parts)
    sym = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64)
    size = np.array([len(p) for p in parts], np.int64)
    if not len(sym):
        return np.zeros(n)
    rules, left, _ = repair(sym, np.repeat(np.arange(n), size), n)
    alphabet = np.array([max(2, len(set(p))) for p in parts])
    return np.where(size > 0, (left + 2 * rules) * np.log2(alphabet + rules) / np.maximum(1, size * np.log2(alphabet)), 0.0)


def measures(texts: list[str]) -> dict[str, np.ndarray]:
    n = len(texts)
    sym, file = _tokens(texts)
    rules, left, cover = repair(sym, file, n)
    longest, blanks = np.zeros(n, np.int64), np.zeros(n)
    share, parts = np.zeros(n), []
    for i, t in enumerate(texts):
        line = max(t.split("\n"), key=len)
        longest[i] = len(line)
        if len(line) >= MINIFIED_LINE:
            blanks[i] = line.count(" ") / len(line)
        got = literals(t)
        share[i] = len(got) / max(1, len(t) - t.count(" ") - t.count("\n"))
        # Only where literals make up enough of a file for a blob is it asked what rules save on them.
        parts.append(got if share[i] >= DATA_SHARE and len(got) >= DATA_BYTES else b"")
    tokens = np.bincount(file, minlength=n)
    chars = np.maximum(1, [len(t) for t in texts])
    return {"tokens": tokens, "chars": chars, "size": (left + 2 * rules) / np.maximum(1, tokens), "cover": cover, "literal": share, "left": left_of(parts), "longest": longest, "blanks": blanks}


PHRASE = re.compile(r"[^\W_]+|@(?=\w)")
PATH_PART = re.compile(r"[A-Za-z]+|/")


def phrases(head: str, path: str) -> list[int]:
    """Buckets of the one to three words in a row of the leading comments, and of the folders and pieces of the path."""
    out = []
    words = ["0" if w[0].isdigit() else w for w in PHRASE.findall(head.lower())]
    for k in (1, 2, 3):
        out += [_bucket(" ".join(words[i : i + k])) for i in range(len(words) - k + 1)]
    folders, _, name = path.lower().rpartition("/")
    out += [_bucket("/" + f) for f in folders.split("/")[1:]]
    pieces = re.split(r"[._-]", name)
    out += [_bucket("." + p) for p in pieces[1:]]
    return sorted(set(out))


def _bucket(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "replace")) % BUCKETS


NUMBERS = {"tokens": pa.int64(), "chars": pa.int64(), "size": pa.float64(), "cover": pa.float64(), "literal": pa.float64(), "left": pa.float64(), "longest": pa.int64(), "blanks": pa.float64()}
SCHEMA = "tokens bigint, chars bigint, size double, cover double, literal double, left double, longest bigint, blanks double, tool boolean, vendor boolean, phrases array<int>"


def describe(df: DataFrame, key: str, path: str, code: str, repository: str) -> DataFrame:
    """(key, repository, path, measures..., tool, vendor, phrases, rules ARRAY<BIGINT>) of every non-empty file.

    tool and vendor are the weak labels: a notice, name or folder says so.
    """
    ship(df.sparkSession)
    kinds = dict(df.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths, texts = b.column(2).to_pylist(), b.column(3).to_pylist()
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (size < CHUNK_BYTES or to == at):
                    size += len(texts[to])
                    to += 1
                part, names = texts[at:to], paths[at:to]
                m = measures(part)
                heads = [leading(t) for t in part]
                cols = [
                    *(b.column(i).slice(at, to - at) for i in range(3)),
                    *(pa.array(m[c], kind) for c, kind in NUMBERS.items()),
                    pa.array([bool(TOOL_NOTICE.search(h) or TOOL_NAME.search(p)) for h, p in zip(heads, names)]),
                    pa.array([bool(VENDOR_NOTICE.search(h) or VENDOR_FOLDER.search(p)) for h, p in zip(heads, names)]),
                    pa.array([phrases(h, p) for h, p in zip(heads, names)], pa.list_(pa.int32())),
                    pa.array([line_rules(t) for t in part], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "repository", "path", *(x.split()[0] for x in SCHEMA.split(", ")), "rules"])
                at = to

    rows = df.where(F.length(code) > 0).select(F.col(key).alias("key"), F.col(repository).cast("string").alias("repository"), F.coalesce(F.regexp_replace(F.col(path), r"\\", "/"), F.lit("")).alias("path"), F.col(code).alias("t"))
    return rows.mapInArrow(run, f"key {kinds[key]}, repository string, path string, {SCHEMA}, rules array<bigint>")


# The weights that a decision starts from and is drawn to: bias, cover, size, share and wholeness of shared rules, weak label.
PRIOR = {"generated": [-4.0, 5.0, 0.0, 0.0, 0.0, 4.0], "vendored": [-4.0, 0.0, 0.0, 1.0, 5.0, 5.0]}


class Decision:
    """Logistic regression over the dense measures and the buckets of a file."""

    def __init__(self, prior: list[float]):
        self.prior = np.array(prior)
        self.w, self.v, self.cut = self.prior.copy(), np.zeros(BUCKETS), 0.0

    def logits(self, x: np.ndarray, idx: np.ndarray, row: np.ndarray) -> np.ndarray:
        return x @ self.w + np.bincount(row, self.v[idx], len(x))

    def fit(self, x: np.ndarray, lists: list[np.ndarray], y: np.ndarray, seed: int = 9) -> "Decision":
        """Two halves of the files score each other; the threshold is the one with the best F1 on these scores."""
        if not 0 < y.sum() < len(y):
            return self
        rng = np.random.default_rng(seed)
        half = rng.permutation(len(y)) % 2
        held = np.zeros(len(y))
        for k in (0, 1, None):
            self.w, self.v = self.prior.copy(), np.zeros(BUCKETS)
            gw, gv = np.full(self.w.shape, 1e-2), np.full(BUCKETS, 1e-2)
            use = np.flatnonzero(half != k) if k is not None else np.arange(len(y))
            for _ in range(6):
                for rows in np.array_split(rng.permutation(use), max(1, len(use) // 64)):
                    idx, seg = _flat([lists[i] for i in rows])
                    g = 1 / (1 + np.exp(-np.clip(self.logits(x[rows], idx, seg), -30, 30))) - y[rows]
                    dw = x[rows].T @ g / len(rows) + 2e-3 * (self.w - self.prior) / max(1.0, len(y) / 500)
                    dv = np.bincount(idx, g[seg], BUCKETS) / len(rows)
                    gw += dw * dw
                    gv += dv * dv
                    self.w -= 0.3 * dw / np.sqrt(gw)
                    self.v -= 0.3 * dv / np.sqrt(gv)
            if k is not None:
                other = np.flatnonzero(half == k)
                idx, seg = _flat([lists[i] for i in other])
                held[other] = self.logits(x[other], idx, seg)
        order = np.argsort(-held)
        hits = np.cumsum(y[order])
        f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
        k = int(np.argmax(f1))
        below = held[order[k + 1]] if k + 1 < len(y) else held[order[k]] - 1
        # Few files say little about a threshold: it is kept near even odds unless many were held out.
        self.cut = float((held[order[k]] + below) / 2) * min(1.0, y.sum() / 50)
        return self


def _flat(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([*lists, np.zeros(0, np.int64)]).astype(np.int64), np.repeat(np.arange(len(lists)), [len(x) for x in lists])


INPUTS = ["cover", "size", "shared", "tokens", "tool", "vendor"]


def _dense(cols: dict[str, np.ndarray], flag: str) -> np.ndarray:
    n = len(cols["cover"])
    known = cols["tokens"] >= MIN_TOKENS
    return np.stack([np.ones(n), cols["cover"] * known, np.minimum(cols["size"], 1.0) * known, np.minimum(cols["shared"], 1.0), (cols["shared"] >= 1).astype(float), cols[flag].astype(float)], 1)


def decisions(rows: list) -> dict[str, Decision]:
    """The decisions on generated and vendored files, fitted on a sample of described files.

    A file that one rule covers is taken for generated without a notice, too;
    one that is shared as a whole without a notice is left out of the fit on
    vendored files, for it may be a third party's.
    """
    cols = {c: np.array([r[c] for r in rows], float) for c in INPUTS}
    lists = [np.array(r["phrases"], np.int64) for r in rows]
    tool = (cols["tool"] > 0) | (cols["cover"] >= RULE_COVER) & (cols["tokens"] >= MIN_TOKENS)
    out = {}
    for name, flag, y in (("generated", "tool", tool), ("vendored", "vendor", cols["vendor"] > 0)):
        use = np.flatnonzero((cols["shared"] < 1) | y) if name == "vendored" else np.arange(len(rows))
        x = _dense(cols, flag)
        out[name] = Decision(PRIOR[name]).fit(x[use], [lists[i] for i in use], y[use].astype(float))
    return out


def classes() -> dict[str, Column]:
    """The condition of each class on the measures; generated and vendored are the logits of their decisions over their thresholds."""
    return {
        "generated": F.col("generated") > 0,
        "minified": (F.col("longest") >= MINIFIED_LINE) & (F.col("longest") >= MINIFIED_SHARE * F.col("chars")) & (F.col("blanks") <= MINIFIED_BLANKS),
        # Literals on which rules save nothing, or a table of literals that one rule writes out.
        "data": (F.col("literal") >= DATA_SHARE) & (F.col("left") > 0) & ((F.col("left") >= DATA_LEFT) | (F.col("cover") >= RULE_COVER) & (F.col("tokens") >= MIN_TOKENS)),
        "vendored": F.col("vendored") > 0,
    }


def classify(df: DataFrame, key: str, path: str, code: str, repository: str) -> DataFrame:
    """(key, repository, measures..., shared, generated, vendored, classes ARRAY<STRING>) of every non-empty file, once per key.

    classes is empty for hand-written files. Null and empty texts do not come
    out. A file whose repository is null shares its rules with none.
    """
    spark = df.sparkSession
    m = materialize(describe(df, key, path, code, repository), "described")
    # Rules of a key that comes twice count once: repositories are counted, not files.
    rules = m.select("repository", F.explode(F.array_distinct("rules")).alias("rule"))
    common = rules.where("repository is not null").distinct().groupBy("rule").agg(F.count("*").alias("r")).where(f"r >= {SHARED_REPOSITORIES}").select("rule")
    part = m.select("key", F.array_distinct("rules").alias("rules")).select("key", F.size("rules").alias("n"), F.explode("rules").alias("rule")).distinct().join(common, "rule").groupBy("key").agg((F.count("*") / F.first("n")).alias("shared"))
    rest = [c for c in m.columns if c not in ("key", "rules")]
    out = m.groupBy("key").agg(*[F.first(c).alias(c) for c in rest]).join(part, "key", "left").withColumn("shared", F.coalesce("shared", F.lit(0.0)))
    out = materialize(out, "measured")
    shared = spark.sparkContext.broadcast(decisions(sample(out.select("key", "phrases", *INPUTS), ["key"], SAMPLE_FILES)))
    columns = out.columns
    at = columns.index("phrases")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema.fields) + ", generated double, vendored double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for b in batches:
            cols = {c: b.column(columns.index(c)).cast(pa.float64() if c not in ("tool", "vendor") else pa.bool_()).to_numpy(zero_copy_only=False) for c in INPUTS}
            lists = b.column(at)
            idx = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            z = [pa.array(models[k].logits(_dense(cols, flag), idx, row) - models[k].cut) for k, flag in (("generated", "tool"), ("vendored", "vendor"))]
            yield pa.RecordBatch.from_arrays([*b.columns, *z], names=[*columns, "generated", "vendored"])

    tags = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in classes().items()]))
    return out.mapInArrow(run, schema).withColumn("classes", tags).drop("phrases").withColumnRenamed("key", key)
