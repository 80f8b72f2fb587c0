"""Gates on concepts, answers, code and messages as Column expressions: each gives a reason, a class or a flag."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# Keys of hidden metadata that no text may show.
HIDDEN_KEYS = ["identity_scope", "task_scope", "thought_action_boundary", "control_nodes", "lens_coordinates", "training_visibility_policy", "source_provenance", "_lens_diagnostics", "_bridge_risk", "_identity_scope_verdict", "_task_scope_verdict", "_thought_action_violation", "_cluster_compression_risk"]
# Names that are fragments, and names that are quantities.
BAD_STARTS = r"(?i)^\s*(this|that|these|those|than|and|or|of|from|to|a|an|the|such|similar|with|without|in|on|at|by|for|as|some|many|all|other|their|its|any|most|another|they|which|who|what|after|before|highly|large|small|high|low|very|quite|millions?|thousands?|hundreds?)\b|(?i)^edu\s+[0-9]+\b"
UNIT_ONLY = r"(?i)^[0-9][0-9\s.\-]*\b(kJ|kcal|mol|moles?|mL|kg|kPa|MPa|bar|atm)\b"
# Patterns, words and fragments of the concept triage.
LOW_VALUE = [r"^[0-9][0-9\s.,]*$", r"(?i)^[0-9][0-9\s.,]*\s*(per\s+annum|acres|tons|patients|moles|million|billion|km|ml|g|kg|l\b)", r"(?i)^(about|approximately)\s+[0-9]", r"(?i)^(because|since)\s+of\s+favorable", r"(?i)^controls\s+clinical", r"(?i)^autoscaling$", r"(?i)^about\s+[0-9]+\s+of\s+these"]
MISREAD = r"(?i)\bqv\b|\bcf\b|\bhoc\b|\bc1\s+o\b|\bc1\b"
VAGUE_WORDS = ["one", "agents", "groves", "approaches", "much", "and", "the", "of", "in", "for", "to", "a", "an", "is", "are", "was", "be", "properties", "conditions", "process", "system", "material", "controls", "parameters", "results", "effects", "behavior", "data", "information", "analysis", "method", "methods", "values", "products", "solutions", "preparation", "applications", "performance", "stability", "activity", "efficiency", "quality", "characteristics", "features", "aspects", "factors", "variables"]
VAGUE_FRAGMENTS = ["under these conditions", "much of such", "because of", "much effort", "astm specifications", "gevaert and fabelta", "groves", "40 different paper grades", "6 000 000", "20 000 acres", "1990 sales", "10 per annum", "about 16", "about 90", "clinsol"]
ACRONYMS = ["UV", "IR", "NMR", "XRD", "SEM", "TEM", "BET", "ATR", "HDPE", "LDPE", "LLDPE", "PVC", "ABS", "PTFE", "PP", "PE", "PS", "CO2", "SO2", "NOX", "ATP", "ADP", "DNA", "RNA", "MNO2", "TIO2", "SIO2", "AL2O3", "FE3O4", "ZNO", "CUO", "HCL", "H2SO4", "NAOH", "KOH", "NACL", "NH3", "H2O2", "HOC", "CLO", "MNO", "ASTM", "VIS", "FTIR", "GC", "HPLC", "GPC", "DSC", "TGA", "SFE", "SCF", "CVD", "PVD", "ALD"]
TRAILING = ["and", "the", "of", "in", "to", "a", "an", "for", "with", "by", "or"]
# Boundaries that say nothing of their own.
GENERIC_BOUNDARIES = [
    r"this mechanism fails if\b", r"this branch logic fails if\b", r"this fails when conditions", r"this approach breaks down when .{0,40}conditions", r"this methodology fails when\b", r"this process fails when\b", r"this (technique|method|strategy) fails (if|when)\b",
    r"under (unfavorable|improper|suboptimal|extreme|adverse) conditions", r"insufficient (control|monitoring|regulation|maintenance)", r"\bnot (properly )?optimized\b", r"conditions are not (ideal|optimal|met|properly maintained|suitable)", r"may not hold\b", r"environmental conditions are suboptimal",
    r"when there is contamination or lack", r"if conditions are not properly", r"fails when the system (is not|does not)", r"breaks down when .{0,40}conditions are (not|poor|improper)", r"when .{0,40}conditions are not (properly |)maintained", r"when (the )?system (is|becomes) (unstable|compromised|disrupted)",
    r"if the (process|reaction|system) (is not|lacks) (properly|adequately) (controlled|monitored|maintained)", r"when (optimal|appropriate|necessary|ideal) conditions (are not|cannot be) (met|achieved|maintained)",
]
# Words of the reasoning classes.
BRANCHING = ["however", "alternatively", "in contrast", "on the other hand", "conversely", "whereas", "by contrast"]
FAILING = ["fails", "breaks", "unstable", "degrades", "collapses", "side reaction", "byproduct formation", "over-oxidation", "under-reaction", "decomposes", "precipitates", "corrodes"]
CONDITIONAL = ["if", "unless", "only when", "provided that", "when"]
CHANGING = ["causes", "leads to", "results in", "increases", "decreases", "enhances", "reduces", "inhibits", "accelerates", "slows", "stabilizes", "destabilizes", "converts", "transforms"]
CAUSAL_SIGNAL = r"(?i)\b(because|therefore|leads?\s+to|results?\s+in|consequently|due\s+to)\b"
# Placeholders in code and in text fields; stubs.
CODE_PLACEHOLDERS = [r"\[REDACTED\]", r"<insert_key>", r"TODO:", r"pass\b", r"FIXME:"]
NO_TEXT = ["", "pending analysis", "unknown", "unspecified", "tbd"]
STUB_ENDS = [": pass", ": ...", ": return none", ": raise notimplementederror", "{ }", "{ return ; }", "{ return null ; }"]
# Words that tell a page of contents, and its least line breaks and most words.
INDEX_WORDS, INDEX_BREAKS, INDEX_WORDS_MIN, INDEX_WORDS_MAX = ["index", "contents", "volume", "edited by", "bibliography"], 3, 200, 500
# Words that mark structured prose.
STRUCTURE = ["because", "therefore", "constraint", "invariant", "however", "specifically", "requires", "implies"]
# Kinds of concepts and how they are asked for.
PROMPTS = [
    (["process", "synthesis", "reaction", "mechanism", "pathway", "cycle"], "Explain the chemical mechanism and pathway of ", "."),
    (["law", "theory", "effect", "principle", "model", "theorem"], "Describe the theoretical framework and implications of ", "."),
    (["acid", "base", "metal", "polymer", "catalyst", "oxide", "isotope"], "Describe the chemical properties and physical characteristics of ", "."),
]
DEFAULT_PROMPT = "Analyze the following chemical concept and explain its properties:"


def hidden_key(c: Column) -> Column:
    """The first hidden key, in the order of the alphabet, that a text shows; null for none."""
    return F.coalesce(*[F.when(c.contains(k), F.lit(k)) for k in sorted(HIDDEN_KEYS)])


def valid_concept(name: Column, content: Column) -> Column:
    """Whether a concept is worth asking about: no fragment, quantity or misread name, and ten words of content."""
    n = F.trim(name)
    longest = F.array_max(F.transform(F.regexp_extract_all(n, F.lit("([A-Za-z]+)"), 1), lambda x: F.length(x)))
    short_digits = n.rlike("^[0-9]") & (longest <= 3)
    return F.coalesce((n != "") & ~n.rlike(BAD_STARTS) & n.rlike("[A-Za-z]{3,}") & ~n.rlike(UNIT_ONLY) & ~F.coalesce(short_digits, F.lit(False)) & (F.size(T.words(content)) >= 10), F.lit(False))


def triage(concept: Column) -> Column:
    """valid_reasoning, ambiguous_needs_uncertainty_target or remove_low_value; null counts as empty."""
    c = F.regexp_replace(F.coalesce(concept, F.lit("")), "^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$", "")
    low, w = F.lower(c), T.words(c)
    n = F.size(w)
    first, second, last = F.get(w, F.lit(0)), F.get(w, F.lit(1)), F.lower(F.element_at(w, -1))
    vague = "ambiguous_needs_uncertainty_target"
    return (
        F.when((n == 0) | (F.length(c) < 2), "remove_low_value")
        .when(reduce(lambda a, b: a | b, [c.rlike(p) for p in LOW_VALUE]), "remove_low_value")
        .when(c.rlike(MISREAD), vague)
        .when((n == 1) & low.isin(*VAGUE_WORDS), vague)
        .when(T.any_of(low, VAGUE_FRAGMENTS), vague)
        .when((n == 1) & (F.upper(c) == c) & (low != c) & (F.length(c) > 2) & ~F.upper(c).isin(*ACRONYMS), vague)
        .when(first.rlike("^[0-9]") & (n <= 3) & ((n == 1) | (F.length(second) < 4)), vague)
        .when((n <= 4) & last.isin(*TRAILING), vague)
        .otherwise("valid_reasoning")
    )


def generic_boundary(c: Column) -> Column:
    """Whether a failure boundary says nothing: blank, fewer than seven words, or one of the general phrases."""
    return F.coalesce((F.size(T.words(c)) < 7) | c.rlike("(?i)" + "|".join(f"(?:{p})" for p in GENERIC_BOUNDARIES)), F.lit(True))


def failure_boundaries(text: Column) -> Column:
    """The texts of the lines that begin with 'Failure boundary:'."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    return F.transform(F.filter(lines, lambda x: x.startswith("Failure boundary:")), lambda x: F.trim(F.substring(x, 18, 1 << 30)))


def final_answer(text: Column) -> Column:
    """What follows the first think block; the whole text without one."""
    cut = F.instr(text, "</think>")
    return F.when(cut > 0, F.trim(text.substr(cut + 8, F.length(text)))).otherwise(F.trim(text))


def row_quality(branches: Column, conditions: Column, boundaries: Column, answer: Column) -> Column:
    """Ten a branch, five each for the coverage of conditions and boundaries, three off for every generic boundary, and up to
    five for the words after the think block."""
    generic = F.size(F.filter(failure_boundaries(answer), generic_boundary))
    words = F.when(answer.contains("</think>"), F.least(F.lit(5.0), F.size(T.words(final_answer(answer))) / 20)).otherwise(0.0)
    return 10.0 * F.coalesce(branches, F.lit(0)) + 5.0 * F.coalesce(conditions, F.lit(0.0)) + 5.0 * F.coalesce(boundaries, F.lit(0.0)) - 3.0 * F.coalesce(F.when(generic >= 0, generic), F.lit(0)) + F.coalesce(words, F.lit(0.0))


def cardinality(branches: Column, ambiguous: Column | None = None) -> Column:
    n = F.coalesce(branches, F.lit(0))
    out = F.when(n <= 1, "uncertainty_abstention").when(n == 2, "binary_regime").when(n == 3, "ternary_regime").otherwise("multi_regime")
    return out if ambiguous is None else F.when(ambiguous, "uncertainty_abstention").otherwise(out)


def structure(low: Column) -> Column:
    """divergent, conditional or linear, by the words of a lower-case text."""
    return F.when(T.any_of(low, FAILING) | T.any_of(low, BRANCHING), "divergent").when(T.any_of(low, CONDITIONAL), "conditional").otherwise("linear")


def diversity(low: Column) -> Column:
    w = T.words(low)
    return F.size(F.array_distinct(w)) / F.greatest(F.size(w), F.lit(1))


def trace_reason(steps: Column, answer: Column) -> Column:
    """Why a reasoning trace with its answer is rejected, or 'pass', the first reason that holds."""
    words = T.words(F.array_join(steps, " "))
    return (
        F.when(steps.isNull() | answer.isNull(), "missing_keys")
        .when((F.size(steps) < 3) | (F.size(steps) > 8), "invalid_reasoning_length")
        .when(F.exists(steps, lambda s: s.isNull()), "invalid_step_type")
        .when(F.exists(steps, lambda s: s.rlike("[<>]")), "unsafe_characters")
        .when(F.exists(steps, lambda s: F.size(T.words(s)) < 6), "low_density_step")
        .when(F.size(T.words(answer)) < 40, "short_answer")
        .when(~answer.rlike(CAUSAL_SIGNAL), "weak_causal_signal")
        .when(F.size(F.array_distinct(words)) / F.size(words) < 0.5, "low_reasoning_entropy")
        .when(F.size(F.array_distinct(steps)) < F.size(steps) * 0.7, "duplicate_steps")
        .otherwise("pass")
    )


def strip_fence(c: Column) -> Column:
    """An answer without the markdown fence that a model put around its JSON."""
    t = F.regexp_replace(c, "^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$", "")
    return F.when(t.startswith("```"), F.regexp_replace(F.regexp_replace(t, "^```(?:json)?[ \\t\\n\\r\\f]*", ""), "[ \\t\\n\\r\\f]*```$", "")).otherwise(t)


TRACE = "struct<reasoning_trace:array<string>,final_answer:string>"


def json_trace_reason(c: Column) -> Column:
    """The same for a model's raw answer, which should be JSON with both parts."""
    t = strip_fence(c)
    keys = F.json_object_keys(t)
    got = F.from_json(t, TRACE)
    kinds = F.get_json_object(t, "$.reasoning_trace").startswith("[")
    return (
        F.when(keys.isNull(), "json_parse_fail")
        .when(~(F.array_contains(keys, "reasoning_trace") & F.array_contains(keys, "final_answer")), "missing_keys")
        .when(~F.coalesce(kinds, F.lit(False)) | got["final_answer"].isNull(), "invalid_types")
        .otherwise(trace_reason(got["reasoning_trace"], got["final_answer"]))
    )


BRANCH_TRACE = "struct<error:string,baseline_state:string,synthesis:string,branches:array<struct<branch_id:string,condition:string,mechanism:string,first_order_effect:string,second_order_effect:string,failure_boundary:string,assumption_risk:string>>>"


def json_branch_reason(c: Column) -> Column:
    """Why a model's raw answer is no branch trace, or 'pass'."""
    t = strip_fence(c)
    got = F.from_json(t, BRANCH_TRACE)
    blank = lambda x: x.isNull() | (F.trim(x) == "")
    return (
        F.when(F.json_object_keys(t).isNull(), "json_parse_fail")
        .when(got["error"] == "cannot_generate", "model_declined")
        .when(F.coalesce(F.size(got["branches"]), F.lit(0)) < 2, "insufficient_branches")
        .when(F.exists(got["branches"], lambda b: blank(b["failure_boundary"])), "missing_failure_boundary")
        .when(blank(got["baseline_state"]) | blank(got["synthesis"]) | F.exists(got["branches"], lambda b: blank(b["condition"]) | blank(b["mechanism"])), "schema_validation_fail")
        .otherwise("pass")
    )


def trivial_stub(code: Column) -> Column:
    """Whether code ends in a stub, its comments left out."""
    c = F.regexp_replace(F.regexp_replace(code, "#[^\\n]*", " "), "//[^\\n]*", " ")
    c = F.regexp_replace(c, "(?s)/\\*.*?\\*/", " ")
    c = F.lower(F.trim(F.regexp_replace(c, "[ \\t\\n\\r\\f]+", " ")))
    return F.coalesce(reduce(lambda a, b: a | b, [c.endswith(s) for s in STUB_ENDS]), F.lit(False))


def identity_function(code: Column) -> Column:
    """Whether code is one function that gives back its argument, a call on it, or nothing."""
    c = F.lower(F.regexp_replace(F.regexp_replace(code, "#[^\\n]*", ""), "[ \\t\\n\\r\\f]+", ""))
    forms = ["^def[a-z0-9_]+\\(([a-z0-9_]+)\\)(?:->[a-z0-9_]+)?:return\\1$", "^def[a-z0-9_]+\\(.*\\)(?:->[a-z0-9_]+)?:(?:pass|return|returnnone)$", "^def[a-z0-9_]+\\(([a-z0-9_]+)\\)(?:->[a-z0-9_]+)?:return[a-z0-9_]+\\(\\1\\)$"]
    return F.coalesce(reduce(lambda a, b: a | b, [c.rlike(p) for p in forms]), F.lit(False))


def index_block(text: Column) -> Column:
    """Whether a text looks like an index or a table of contents."""
    n = F.size(T.words(text))
    breaks = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.coalesce((n <= INDEX_WORDS_MAX) & T.any_of(F.lower(text), INDEX_WORDS) & ((breaks > INDEX_BREAKS) | (n > INDEX_WORDS_MIN)), F.lit(False))


def prose_density(text: Column) -> Column:
    """Half for words up to 200, three tenths for up to three marks of structure, and a fifth; 0 for null and blank texts."""
    low = F.lower(text)
    n = F.size(T.words(text))
    marks = reduce(lambda a, b: a + b, [low.contains(w).cast("int") for w in STRUCTURE])
    d = F.least(F.lit(1.0), F.least(n / 200.0, F.lit(1.0)) * 0.5 + F.least(marks / 3.0, F.lit(1.0)) * 0.3 + 0.2)
    return F.when(n > 0, d).otherwise(0.0)


def prompt_for(name: Column) -> Column:
    """How a concept is asked for, by the kind of thing its name says it is."""
    low = F.lower(name)
    out = F
    for words, a, b in PROMPTS:
        out = out.when(T.any_of(low, words), F.concat(F.lit(a), name, F.lit(b)))
    return out.otherwise(F.concat(F.lit(DEFAULT_PROMPT + "\n\n"), name))


def plain_name(name: Column, generic: str = "this physical chemistry concept") -> Column:
    """A name of letters, digits and blanks with a word of three letters, 3 to 40 characters long; else the generic one."""
    c = F.trim(F.regexp_replace(F.regexp_replace(name, "[^a-zA-Z0-9 ]", " "), " +", " "))
    return F.when(F.length(c).between(3, 40) & c.rlike("[a-zA-Z]{3,}"), c).otherwise(generic)


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t"))


def strip_line_numbers(c: Column) -> Column:
    """Lines without 'number |' before them and blanks behind them."""
    lines = F.transform(T.lines_of(c), lambda x: F.regexp_replace(F.regexp_replace(x, "[ \\t\\f]+$", ""), "^[ \\t\\f]*[0-9]+[ \\t\\f]*\\|[ \\t\\f]?", ""))
    return F.regexp_replace(F.array_join(lines, "\n"), "^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$", "")


def mask_middle(c: Column) -> Column:
    """Of 15 texts in 100, by their hash, the middle sentence is left out, if there are four or more and the rest keeps its
    causal words."""
    sentences = F.split(F.regexp_replace(c, "([.!?])[ \\t\\n\\r\\f]+", "$1\u0001"), "\u0001")
    n = F.size(sentences)
    mid = F.floor(n / 2).cast("int")
    rest = F.array_join(F.concat(F.slice(sentences, F.lit(1), mid), F.slice(sentences, mid + 2, F.greatest(n - mid - 1, F.lit(0)))), " ")
    low = F.lower(rest)
    return F.when((T.hash_percent(c) < 15) & (n >= 4) & T.any_of(low, T.CAUSAL) & T.any_of(low, T.TRANSFORM), rest).otherwise(c)


def clean_field(c: Column) -> Column:
    """A trimmed text; empty for null and placeholders."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), "^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$", "")
    return F.when(F.lower(t).isin(*NO_TEXT), "").otherwise(t)


def chat_tokens(messages: Column) -> Column:
    """A quarter of the characters of the rendered chat, rounded up, two for the reply and four a message; 0 for none."""
    parts = F.transform(messages, lambda m: F.concat(F.lit("<|"), F.coalesce(m["role"], F.lit("unknown")), F.lit("|>\n"), F.coalesce(m["content"], F.lit("")), F.lit("\n")))
    n = F.size(messages)
    return F.when(n > 0, F.ceil(F.length(F.array_join(parts, "\n")) / 4) + 2 + 4 * n).otherwise(0).cast("bigint")


def skill_reason(intent: Column, strategy: Column, constraints: Column, code: Column, tokens: Column) -> Column:
    """Why a skill is rejected, or 'all_invariants_passed': no reasoning, parts of it missing, too many tokens, placeholders."""
    unknown = lambda c: c.isNull() | c.isin("", "unknown")
    empty = (F.size(constraints) <= 0) | F.forall(constraints, lambda x: x == "unknown")
    return (
        F.when(intent.isNull() & strategy.isNull() & constraints.isNull(), "missing_epistemic_core")
        .when(unknown(intent) | unknown(strategy) | F.coalesce(empty, F.lit(True)), "incomplete_epistemic_core")
        .when(tokens >= 2048, "token_limit_exceeded")
        .when(code.rlike("|".join(CODE_PLACEHOLDERS)), "placeholder_detected")
        .otherwise("all_invariants_passed")
    )


def template_placeholder(c: Column) -> Column:
    return c.rlike("\\{[a-z_]+\\}")
