"""Records as training rows: chats, loss masks, preference triples, flashcards, think blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: A character that is no blank.
INK = "[^ \\t\\n\\r\\f]"


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"), F.lit(role == "assistant").alias("train_loss"))


def chat(user: Column, assistant: Column, system: Column | None = None) -> Column:
    """Messages of two or three turns, the loss on the assistant's only; null where a side is missing or blank."""
    turns = ([message("system", system)] if system is not None else []) + [message("user", user), message("assistant", assistant)]
    return F.when(user.rlike(INK) & assistant.rlike(INK), F.array(*turns))


def clean_messages(messages: Column, system: str) -> Column:
    """Known roles and non-blank contents only, a system turn first; null without a user's and an assistant's turn."""
    kept = F.filter(messages, lambda m: m["role"].isin("system", "user", "assistant") & m["content"].rlike(INK))
    plain = F.transform(kept, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"), (m["role"] == "assistant").alias("train_loss")))
    first = F.when(F.exists(plain, lambda m: m["role"] == "system"), plain).otherwise(F.concat(F.array(message("system", F.lit(system))), plain))
    return F.when(F.exists(plain, lambda m: m["role"] == "user") & F.exists(plain, lambda m: m["role"] == "assistant"), first)


def preference(df: DataFrame, key: str, prompt: str, text: str, score: str) -> DataFrame:
    """(key, prompt, chosen, rejected) where a key's best and worst scored texts differ."""
    g = df.where(F.col(score).isNotNull() & F.col(text).isNotNull()).groupBy(key, prompt).agg(F.max(F.struct(score, text)).alias("hi"), F.min(F.struct(score, text)).alias("lo"))
    return g.where(F.col(f"hi.{score}") > F.col(f"lo.{score}")).select(key, prompt, F.col(f"hi.{text}").alias("chosen"), F.col(f"lo.{text}").alias("rejected"))


def think(branches: Column, answer: Column) -> Column:
    """Branches (condition, mechanism, failure_boundary) as a deterministic block before the answer."""
    lines = F.transform(branches, lambda b, i: F.concat_ws("\n", F.concat(F.lit("Branch "), (i + 1).cast("string"), F.lit(": "), b["condition"]), F.concat(F.lit("Mechanism: "), b["mechanism"]), F.concat(F.lit("Failure boundary: "), b["failure_boundary"])))
    return F.concat(F.lit("<think>\n"), F.array_join(lines, "\n\n"), F.lit("\n</think>\n"), answer)


def think_parts(text: Column) -> tuple[Column, Column]:
    """The first think block and what follows it."""
    return F.regexp_extract(text, r"(?s)<think>(.*?)</think>", 1), F.trim(F.regexp_replace(text, r"(?s)^.*?</think>", ""))


def branch_gate(mechanisms: Column, boundaries: Column, conditions: Column) -> Column:
    """Why a set of branches is rejected, or 'pass': too few, too alike, boundaries missing, conditions thin."""
    words = lambda s: F.array_distinct(F.filter(F.split(F.lower(s), "[^a-z0-9]+"), lambda x: x != ""))
    sets = F.transform(mechanisms, words)
    alike = F.exists(sets, lambda a: F.size(F.filter(sets, lambda b: F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b))) > 0.7)) > 1)
    bounded = F.size(F.filter(boundaries, lambda b: F.trim(b) != ""))
    thick = F.size(F.filter(conditions, lambda c: F.length(c) >= 20))
    n = F.size(mechanisms)
    return F.when((n < 2) | n.isNull(), "insufficient_branches").when(alike, "low_diversity").when(bounded < n, "missing_failure_boundary").when(thick < 0.8 * n, "thin_conditions").otherwise("pass")


# The turns of the routes, and outputs that stand for none.
VETERAN = ("The following code failed to execute:\n```python\n{attempt}\n```\n\nTraceback:\n```\n{traceback}\n```\n\nPlease diagnose the issue and provide a fix.", "### Diagnosis & Analysis\n{analysis}\n\n### Resolution Diff\n```diff\n{diff}\n```\n\n### Fully Resolved Code\n```python\n{resolved}\n```")
ADVOCATE = ("Please provide the architectural reasoning and the implementation code for this component.", "### Architectural Theory\n{theory}\n\n### Implementation Code\n```python\n{implementation}\n```")
CODING = ("Implement the function `{name}`.", "```python\n{code}\n```")
THEORIST = ("Please provide the theoretical context.", "{chunk}")
PLACEHOLDERS = ["", "Generated_via_Procedural_Mapping", "generated_via_procedural_mapping"]
# Failures that say how the pipeline works and nothing of the code.
INTERNAL_FAILURES = ["depth_limit", "below_instability_band", "omega_orphan_state", "topological_cycle_break", "cycle_quarantine_emptied_graph", "parent_chain_failed", "cascade_rejection"]


def fill(template: str, parts: dict[str, Column]) -> Column:
    """A template's text with the columns in place of its names; null parts are empty."""
    out, rest = [], template
    while "{" in rest:
        before, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        out += [F.lit(before), F.coalesce(parts[name], F.lit(""))]
    return F.concat(*out, F.lit(rest))


def route(parts: dict[str, Column]) -> Column:
    """(mode, messages) by the first of veteran, advocate, code and theory whose parts are there; null for none."""
    have = lambda *names: F.lit(True) if not names else [parts[n].isNotNull() for n in names]
    out = F
    for mode, needs, (user, answer) in (("veteran", ("traceback", "diff"), VETERAN), ("advocate", ("theory", "implementation"), ADVOCATE), ("coding_assistant", ("code", "name"), CODING), ("theorist", ("chunk",), THEORIST)):
        ok = have(*needs)
        cond = ok[0]
        for c in ok[1:]:
            cond = cond & c
        out = out.when(cond, F.struct(F.lit(mode).alias("mode"), F.array(message("user", fill(user, parts)), message("assistant", fill(answer, parts))).alias("messages")))
    return out.otherwise(F.lit(None))


def strict(system: str, instruction: Column, context: Column, output: Column, code: Column) -> Column:
    """System, user and assistant; a placeholder output gives way to the code; null where a side is missing."""
    clean = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$", "")
    i, x, o, k = (clean(c) for c in (instruction, context, output, code))
    answer = F.when(~o.isin(*PLACEHOLDERS), o).when(k != "", F.concat(F.lit("```python\n"), k, F.lit("\n```"))).otherwise("")
    user = F.when(x == "", i).otherwise(F.concat(i, F.lit("\n\nContext:\n"), x))
    return F.when((i != "") & (answer != ""), F.array(message("system", F.lit(system)), message("user", user), message("assistant", answer)))


def flashcard(category: Column, canonical_id: Column, operators: Column, confidence: Column, intent: Column, down: Column, up: Column, code: Column) -> Column:
    """(instruction, input, output): a card whose input and output are JSON with the keys in order."""
    sure = F.format_string("%.3f", F.floor(F.coalesce(confidence, F.lit(0.0)) * 1000 + 0.5) / 1000)
    ops = F.coalesce(operators, F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    ask = F.when(intent != "", "Synthesize an optimized execution method for").otherwise("Extract and formalize the structural execution pattern for")
    instruction = F.concat(ask, F.lit(" Category: "), F.coalesce(category, F.lit("unknown")), F.lit(" | Canonical ID: "), F.coalesce(canonical_id, F.lit("UNKNOWN")), F.lit(" | Pipeline Signature: "), F.array_join(ops, " -> "), F.lit(" | System Prior Confidence: "), sure)
    given = F.to_json(F.struct(F.struct(F.create_map().cast("map<string,string>").alias("heuristic_conditions"), none.alias("mutation_tracking"), ops.alias("operator_types")).alias("constraints"), F.struct(F.coalesce(down, none).alias("downstream_calls"), F.coalesce(F.array_sort(up), none).alias("upstream_callers")).alias("graph")))
    out = F.to_json(F.struct(F.create_map().cast("map<string,string>").alias("heuristics"), F.when(intent != "", F.struct(intent.alias("goal"))).alias("intent"), F.struct(code.alias("code")).alias("template")))
    return F.struct(instruction.alias("instruction"), given.alias("input"), out.alias("output"))


def card_verdict(given: Column, output: Column, down: Column, up: Column, operators: Column, code: Column) -> Column:
    """Why the strict filter rejects a card, or 'accepted'."""
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    return (
        F.when(F.json_object_keys(given).isNull(), "malformed_input_json")
        .when(F.json_object_keys(output).isNull(), "malformed_output_json")
        .when(size(down) + size(up) > 50, "graph_complexity_exceeded")
        .when(size(operators) == 0, "zero_density_ast")
        .when(code.rlike("\\{[a-z_]+\\}"), "template_code_placeholder")
        .otherwise("accepted")
    )


def internal_failure(kind: Column, reason: Column) -> Column:
    """Whether a failure's kind or reason is one of the pipeline's own, or a cascade's."""
    any_ = "|".join(INTERNAL_FAILURES)
    return kind.rlike(any_) | reason.rlike(any_) | reason.startswith("cascade_from_")
