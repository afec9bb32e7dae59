"""Mapping of raw rows to the training layout, padding and label assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.answers import extract_answer, strip, template

#: Columns tried in order where none is configured or it is blank. Fixed values.
PROBLEM = ["problem", "question", "prompt", "query", "input"]
SOLUTION = ["solution", "response", "answer", "target", "output"]
TRUTH = ["ground_truth", "gt", "final_answer", "answer"]
CODE_PROBLEM = ["instruction", "prompt", "question", "query", "input"]
CODE_TARGET = ["response", "chosen", "answer", "output", "completion"]
TEXT = ["prompt", "question", "input"]
TARGET = ["target", "answer", "response", "output"]


def first_nonblank(*columns: Column) -> Column:
    """The first value that is not blank, as it stands; '' if all are."""
    return F.coalesce(*[F.when(strip(c.cast("string")) != "", c.cast("string")) for c in columns], F.lit(""))


def first_nonnull(*columns: Column) -> Column:
    return F.coalesce(*columns)


def _field(df: DataFrame, configured: str | None, fallback: list[str]) -> Column:
    """A configured column, stripped, unless it is blank (a null is blank); else the first of the others."""
    own = [strip(F.col(configured).cast("string"))] if configured and configured in df.columns else []
    return first_nonblank(*own, *[F.col(n) for n in fallback if n in df.columns], F.lit(""))


def built_messages(user: Column, system: str = "") -> Column:
    """An optional system message, then the user's."""
    message = lambda r, c: F.struct(F.lit(r).alias("role"), c.alias("content"))
    own = [message("system", F.lit(system))] if system else []
    return F.array(*own, message("user", user))


def _layout(messages: Column, target: Column, problem: Column, truth: Column, kind: str) -> list[Column]:
    return [
        messages.alias("prompt_messages"),
        target.alias("target_text"),
        problem.alias("problem"),
        target.alias("reference_solution"),
        truth.alias("ground_truth"),
        F.lit(kind).alias("task_type"),
    ]


def map_math(
    df: DataFrame,
    template_text: str = "{problem}",
    problem: str | None = None,
    solution: str | None = None,
    truth: str | None = None,
    system: str = "",
) -> DataFrame:
    """The truth falls back to the answer that the solution gives."""
    p, s = _field(df, problem, PROBLEM), _field(df, solution, SOLUTION)
    t = _field(df, truth, TRUTH)
    t = F.when((t == "") & (s != ""), extract_answer(s)).otherwise(t)
    return df.select(*_layout(built_messages(template(template_text, p), system), s, p, t, "math"))


def map_code(df: DataFrame, system: str = "", messages: str = "messages") -> DataFrame:
    """The target falls back to the first message of the assistant."""
    p, t = _field(df, None, CODE_PROBLEM), _field(df, None, CODE_TARGET)
    if messages in df.columns:
        said = F.get(F.filter(messages, lambda m: m["role"] == "assistant"), F.lit(0))["content"]
        t = F.when(t == "", F.coalesce(said, F.lit(""))).otherwise(t)
    return df.select(*_layout(built_messages(p, system), t, p, F.lit(""), "code"))


def map_generic(df: DataFrame, text: str | None = None, target: str | None = None, system: str = "") -> DataFrame:
    p = F.coalesce(F.col(text).cast("string"), F.lit("")) if text else _field(df, None, TEXT)
    t = F.coalesce(F.col(target).cast("string"), F.lit("")) if target else _field(df, None, TARGET)
    return df.select(*_layout(built_messages(p, system), t, p, extract_answer(t), "generic"))


def adapted(df: DataFrame, kind: str, **options) -> DataFrame:
    if kind in ("math", "dapo_math"):
        return map_math(df, **options)
    if kind in ("code", "function_calling"):
        return map_code(df, **options)
    return map_generic(df, **options)


def padded(values: Column, width: Column, fill: int, left: bool) -> Column:
    more = F.array_repeat(F.lit(fill), F.greatest(width - F.size(values), F.lit(0)))
    return F.concat(more, values) if left else F.concat(values, more)


def assembled(prompt: Column, target: Column, longest: int = 4096, prompt_longest: int = 2048) -> tuple[Column, Column]:
    """(input ids, labels): the last prompt ids, then as many target ids as fit; prompt labels are -100."""
    p = F.when(F.size(prompt) > prompt_longest, F.slice(prompt, -prompt_longest, prompt_longest)).otherwise(prompt)
    t = F.slice(target, F.lit(1), F.greatest(F.lit(longest) - F.size(p), F.lit(0)))
    return F.concat(p, t), F.concat(F.array_repeat(F.lit(-100), F.size(p)), t)
