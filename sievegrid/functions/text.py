"""Text projections and gates as Column expressions; all stay in the JVM but the two marked otherwise."""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

WS = "[ \\t\\n\\r\\f]+"

# Word lists of the gates.
CAUSAL = ["because", "therefore", "results in", "consequently", "due to"]
TRANSFORM = ["leads to", "lead to", "causes", "changes", "shifts", "transforms", "becomes", "allow", "enhances", "enable", "increases", "facilitates", "forms", "reacts", "influences", "reduces", "promotes", "converts", "prevents"]
SYCOPHANCY = ["as an ai", "you are absolutely right", "i completely agree", "you're correct"]
LENSES = [("diagnostic", ["why", "failure", "breakdown", "error"]), ("comparative", ["compare", "difference", "ratio"]), ("mechanistic", ["mechanism", "process", "step"])]
FORBIDDEN = ["IRER", "resonance field", "SSE 0.00087", "nura physics", "omega handshake", "bounded inevitability"]
DANGLING = "this|that|these|those|than|and|or|of|from|to|a|an|the|such|similar|with|without|in|on|at|by|for|as|some|many|all|other|their|its|any|most|another"
MODE_WORDS = {
    "theorist": ["mechanism", "pathway", "kinetics", "thermodynamic", "equilibrium", "activation", "entropy", "enthalpy", "orbital", "electron", "bond", "reaction", "synthesis", "catalysis", "isomer", "polymer", "radical", "spectroscopy", "diffraction", "adsorption", "chemisorption"],
    "advocate": ["comparison", "advantage", "property", "characteristic", "application", "alternative", "method", "approach", "technique", "grade", "specification", "standard", "performance", "stability", "yield", "purity", "selectivity"],
    "veteran": ["failure", "toxicity", "hazard", "risk", "adverse", "side effect", "inhibit", "degrade", "decompose", "unstable", "contamination", "poisoning", "overdose", "defect", "limitation", "problem"],
}
# What scanned text holds for a unit and for dashes, in the order of replacement.
OCR_PAIRS = [("pig/mL", "µg/mL"), ("pig/ml", "µg/mL"), ("\u2014-", "-"), ("\u2014", "-"), ("\u2013", "-")]
# Words on lines whose quoted value is tried for its entropy, and the bits from which it is hidden.
SENSITIVE_WORDS = ["api_key", "secret_key", "auth_token", "access_token", "password", "bearer", "client_secret", "private_key", "token", "pwd"]
HIGH_ENTROPY = 4.8
# What tells that a piece of code checks something.
VALIDATION_MARKERS = ["assert", "self.assert", "pytest", "raises", "expect", "raise ", " error"]
# Patterns of secrets, safe for Java and RE2 alike.
SENSITIVE = [
    r"(?s)-----BEGIN[A-Z0-9 ]+KEY-----.*?-----END[A-Z0-9 ]+KEY-----",
    r"(?s)-----BEGIN CERTIFICATE-----.*?-----END CERTIFICATE-----",
    r"(?i)(api_key|secret_key|auth_token)[ \t\n\r\f]*[:=][ \t\n\r\f]*['\"][A-Za-z0-9+/=]{20,}['\"]",
    r"(?i)(password|passwd|pwd)[ \t\n\r\f]*[:=][ \t\n\r\f]*['\"][^'\"]{8,}['\"]",
]
VENDOR = [r"(?:^|[^A-Z0-9])(AKIA[A-Z0-9]{16})(?:[^A-Z0-9]|$)", r"(ghp|gho|ghu|ghs|ghr)_[a-zA-Z0-9]{36}", r"sk_(test|live)_[0-9a-zA-Z]{24,34}", r"xox[baprs]-[0-9]{10,13}-[0-9]{10,13}-[a-zA-Z0-9]{24,34}", r"AIza[0-9A-Za-z_-]{35}", r"ya29\.[0-9A-Za-z_-]+", r"sq0csp-[0-9A-Za-z_-]{43}", r"key-[0-9a-zA-Z]{32}", r"SG\.[a-zA-Z0-9_-]{22}\.[a-zA-Z0-9_-]{43}"]
DETECT = [r"(?i)api[_-]?key[ \t:=]+['\"][a-zA-Z0-9_-]{16,}['\"]", r"(?i)aws[_-]?access[_-]?key[ \t:=]+['\"][A-Z0-9]{20}['\"]", r"(?i)password[ \t:=]+['\"][^'\"]{8,}['\"]", r"(?i)secret[ \t:=]+['\"][a-zA-Z0-9_-]{16,}['\"]", r"sk-[a-zA-Z0-9]{48}"]


def any_of(c: Column, words: list[str]) -> Column:
    """Whether a lower-case text holds any of the words: one pass of the regex engine, no UDF."""
    return c.rlike("|".join(re.escape(w).replace("\\ ", " ").replace("\\'", "'") for w in words))


def words(c: Column) -> Column:
    """Pieces between white space, empty ones dropped."""
    return F.filter(F.split(F.trim(c), WS), lambda x: x != "")


def ascii_words(c: Column) -> Column:
    return F.filter(F.split(F.lower(c), "[^a-z0-9_]+"), lambda x: x != "")


def normal_key(c: Column) -> Column:
    """Lower case, everything but ASCII letters and digits as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def strip_markdown(c: Column) -> Column:
    c = F.regexp_replace(c, "```[a-z]*\\n?", "")
    c = F.regexp_replace(c, "(?m)^#{1,6}[ \\t]+", "")
    return F.replace(c, F.lit("**"), F.lit(""))


def collapse_newlines(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "(?m)^Evidence refs: none[ \\t]*$", ""), "\\n{3,}", "\n\n")


def sanitise(c: Column) -> Column:
    """Angle brackets dropped, runs of white space as one blank."""
    return F.trim(F.regexp_replace(F.translate(c, "<>", ""), WS, " "))


def fix_ocr(c: Column) -> Column:
    for bad, good in OCR_PAIRS:
        c = F.replace(c, F.lit(bad), F.lit(good))
    return c


def lines_of(c: Column) -> Column:
    """Lines however they end; a line end at the very end begins none."""
    return F.split(F.regexp_replace(c, "(\\r\\n|\\n|\\r)\\z", ""), "\\r\\n|\\n|\\r")


def entropy_of(c: Column) -> Column:
    """Shannon entropy of the characters of a short text, in bits, with higher-order functions."""
    chars = F.filter(F.split(c, ""), lambda x: x != "")
    n = F.size(chars)
    counts = F.transform(F.array_distinct(chars), lambda x: F.size(F.filter(chars, lambda y: y == x)).cast("double"))
    return F.when(n > 0, F.log2(n.cast("double")) - F.aggregate(counts, F.lit(0.0), lambda a, k: a + k * F.log2(k)) / n).otherwise(0.0)


def hide_high_entropy(c: Column) -> Column:
    """Quoted values of high entropy, assigned on a line that names something sensitive, replaced; lines joined by newlines."""

    def line(x: Column) -> Column:
        out = x
        for q in "\"'":
            m = f"(?s)^([ \\t]*(?:[0-9]+[ \\t]*\\|[ \\t]*)?[A-Za-z0-9_]+[ \\t]*[:=][ \\t]*{q})([^{q}]*)({q}.*)$"
            hit = x.rlike(m) & (entropy_of(F.regexp_extract(x, m, 2)) > HIGH_ENTROPY)
            out = F.when(hit, F.concat(F.regexp_extract(x, m, 1), F.lit("[REDACTED_HIGH_ENTROPY]"), F.regexp_extract(x, m, 3))).otherwise(out)
        return F.when(any_of(F.lower(x), SENSITIVE_WORDS), out).otherwise(x)

    # Texts that name nothing sensitive are not taken apart.
    return F.when(any_of(F.lower(c), SENSITIVE_WORDS), F.array_join(F.transform(lines_of(c), line), "\n")).otherwise(F.array_join(lines_of(c), "\n"))


def token_estimate(c: Column) -> Column:
    """A quarter of the characters, rounded up; 0 for null."""
    return F.coalesce(F.ceil(F.length(c) / 4), F.lit(0)).cast("bigint")


def redact(c: Column) -> Column:
    for p in SENSITIVE:
        c = F.regexp_replace(c, p, "[REDACTED_SENSITIVE_PATTERN]")
    for p in VENDOR:
        c = F.regexp_replace(c, p, "[REDACTED_VENDOR_SECRET]")
    return hide_high_entropy(c)


def secret_hits(c: Column) -> Column:
    return F.filter(F.array(*[F.when(c.rlike(p), F.lit(i)) for i, p in enumerate(DETECT)]), lambda x: x.isNotNull())


def firewall(c: Column, tokens: list[str] = FORBIDDEN) -> Column:
    """The first forbidden token that occurs, in the order given; null for none."""
    low = F.lower(c)
    return F.coalesce(*[F.when(low.contains(t.lower()), F.lit(t)) for t in tokens])


def lens(c: Column) -> Column:
    low = F.lower(c)
    w = F
    for name, keys in LENSES:
        w = w.when(any_of(low, keys), name)
    return w.otherwise("theoretical")


def any_words(low: Column) -> Column:
    """Runs of letters, digits and underscores of any script."""
    return F.regexp_extract_all(low, F.lit("([\\p{L}\\p{N}_]+)"), 1)


def quality_reason(c: Column, low: Column | None = None, w: Column | None = None) -> Column:
    """Why a text is rejected, or 'pass': length, flattery, repetition, missing causal structure, in that order.

    low and w are its lower case and any_words of that, best projected once by the caller.
    """
    low = F.lower(c) if low is None else low
    w = any_words(low) if w is None else w
    dense = F.size(F.array_distinct(w)) / F.size(w)
    return (
        F.when(c.isNull() | (F.size(words(c)) < 20), "short_output")
        .when(any_of(low, SYCOPHANCY), "sycophancy_detected")
        .when((F.size(w) > 50) & (dense < 0.4), "low_lexical_density")
        .when(~(any_of(low, CAUSAL) & any_of(low, TRANSFORM)), "missing_causal_structure")
        .otherwise("pass")
    )


def concept_ok(name: Column, content: Column) -> Column:
    """Whether a concept's name is no debris and fits its content."""
    n, t = F.lower(F.trim(name)), F.lower(F.trim(content))
    long = F.regexp_extract_all(n, F.lit("([a-z]{4,})"), 1)
    return F.coalesce(
        (n != "") & (t != "") & ~n.rlike("^[0-9. ,+()%-]+$") & n.rlike("[a-z]{3,}") & ~n.rlike("\\b(table|fig|figure|page|edu)\\b") & ~n.rlike(f"^(?:{DANGLING})\\b")
        & ~n.rlike("\\b(descriptive|example|term|see also|listed in)\\b") & (F.size(words(t)) >= 15) & ((F.size(long) == 0) | F.exists(long, lambda x: t.contains(x))),
        F.lit(False),
    )


def usable(c: Column) -> Column:
    return F.coalesce((F.length(F.trim(c)) >= 80) & ~F.lower(c).rlike("\\b(table|fig\\.?|figure) [0-9]"), F.lit(False))


def mode_of(c: Column) -> Column:
    """The mode whose words a text shares: two of the veteran's, or one of the advocate's, or one of the theorist's; else
    theorist or advocate by the parity of the text's hash."""
    w = F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z]+"), lambda x: x != ""))
    hit = {m: F.size(F.array_intersect(w, F.array(*[F.lit(x) for x in k]))) for m, k in MODE_WORDS.items()}
    even = F.substring(F.md5(F.coalesce(c, F.lit(""))), 1, 1).rlike("[02468ace]")
    return F.when(hit["veteran"] >= 2, "veteran").when(hit["advocate"] >= 1, "advocate").when(hit["theorist"] >= 1, "theorist").when(even, "theorist").otherwise("advocate")


#: Names that stand for a mode.
MODE_ALIASES = {"coder": "software_tech", "coding": "software_tech", "coding_assistant": "software_tech", "software_tech": "software_tech", "theorist": "scholar", "scholar": "scholar", "advocate": "project_reviewer", "project_manager": "project_reviewer", "project_reviewer": "project_reviewer", "veteran": "matured", "experienced": "matured", "matured": "matured"}


def canonical_mode(c: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in MODE_ALIASES.items() for x in kv])
    return F.try_element_at(m, F.lower(F.trim(c)))


def marker_counts(c: Column) -> Column:
    """How often the validation markers occur in a text, whatever the case; a text may hold several that overlap."""
    low = F.lower(c)
    return reduce(lambda a, b: a + b, [((F.length(low) - F.length(F.replace(low, F.lit(m), F.lit("")))) / len(m)).cast("int") for m in VALIDATION_MARKERS])


def hash_percent(c: Column) -> Column:
    """md5 as a number, modulo 100: folded over its digits, so no integer overflows."""
    digits = F.split(F.md5(c), "")
    return F.aggregate(F.filter(digits, lambda x: x != ""), F.lit(0), lambda a, x: F.pmod(a * 16 + F.conv(x, 16, 10).cast("int"), F.lit(100)))


def density_text(c: Column) -> Column:
    """Share of words and kinds of punctuation, at most 0.55."""
    kinds = reduce(lambda a, b: a + b, [c.contains(p).cast("int") for p in ".,:;!?()"])
    return F.least(F.lit(0.55), F.size(words(c)) / 50.0 * 0.4 + F.least(F.lit(0.15), 0.025 * kinds))


@F.pandas_udf(DoubleType())
def byte_entropy(s: pd.Series) -> pd.Series:
    """Shannon entropy of the UTF-8 bytes, in bits; null for null, 0 for empty. Arrow batches, one numpy count per text."""

    def one(t):
        if t is None:
            return None
        n = np.bincount(np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
        n = n[n > 0] / max(1, n.sum())
        return float(-(n * np.log2(n)).sum()) if len(n) else 0.0

    return s.map(one)
