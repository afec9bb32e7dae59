"""JSON in texts of models and logs: the first valid object, samples of several layouts, message lists."""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys of the several layouts, in the order in which they are tried. Fixed values.
GENERATION = ["filtered_resps", "resps", "response", "responses", "prediction", "pred", "generation", "model_output", "output"]
GENERATION_FIELDS = ["text", "output", "generation", "response"]
PROBLEM = ["problem", "question", "query", "prompt", "input"]
REFERENCE = ["solution", "answer", "target", "reference", "gold", "gold_answer"]
CORRECT = ["exact_match", "acc", "accuracy", "correct", "is_correct", "score"]
SAMPLE_KEYS = ["doc", "arguments", "resps", "filtered_resps", "target", "problem", "question", "prompt", "exact_match", "acc", "correct"]
DECISION = T.StructType().add("has_error", T.BooleanType()).add(
    "earliest_error_chunk_id",
    T.IntegerType(),
).add("earliest_error_span", T.StringType()).add("error_type", T.StringType()).add("explanation", T.StringType()).add("parse_failed", T.BooleanType())
MESSAGES = T.ArrayType(T.StructType().add("role", T.StringType()).add("content", T.StringType()))


def first_object(text: str | None, repair: bool = False):
    """The whole text as JSON, else the first object in it that parses; None if there is none."""
    t = (text or "").strip()
    if "</think>" in t:
        t = t.split("</think>", 1)[1].strip()
    if repair and t.startswith("<think>"):
        return None
    t = re.sub(r"```$", "", re.sub(r"^```(?:json)?", "", t).strip()).strip()
    if repair:
        for escaped in ("\\{", "\\}", "\\_", "\\$"):
            t = t.replace(escaped, escaped[1])
    try:
        return json.loads(t)
    except ValueError:
        pass
    reader = json.JSONDecoder()
    for m in re.finditer(r"\{", t):
        try:
            return reader.raw_decode(t, m.start())[0]
        except ValueError:
            continue
    return None


def _chunk(value) -> int | None:
    try:
        return None if value is None or isinstance(value, bool) else int(value)
    except (TypeError, ValueError):
        return None


@F.pandas_udf(DECISION)
def decision(text: pd.Series) -> pd.DataFrame:
    """A judge's answer; what does not parse has no verdict and says so."""
    rows = []
    for t in text:
        got = first_object(t)
        if isinstance(got, dict):
            error = got.get("has_error")
            rows.append(
                (
                    error if isinstance(error, bool) else None,
                    _chunk(got.get("earliest_error_chunk_id")),
                    str(got.get("earliest_error_span") or ""),
                    str(got.get("error_type") or ""),
                    str(got.get("explanation") or ""),
                    False,
                )
            )
        else:
            rows.append((None, None, "", "parse_failed", f"Could not parse judge output: {(t or '')[:800]}", True))
    return pd.DataFrame(
        rows,
        columns=["has_error", "earliest_error_chunk_id", "earliest_error_span", "error_type", "explanation", "parse_failed"],
    ).astype({"earliest_error_chunk_id": "Int32", "has_error": "boolean"})


@F.pandas_udf(T.StringType())
def repaired(text: pd.Series) -> pd.Series:
    """The first object as compact JSON, after repairing common escapes; null without one."""
    return text.map(lambda t: None if (x := first_object(t, True)) is None else json.dumps(x, ensure_ascii=False, sort_keys=True))


def _text(item: dict) -> str:
    return str(item.get("content") or item.get("text") or item.get("value") or "")


def messages_of(value) -> list[tuple[str, str]]:
    """(role, content) of a message, a list of messages or a text that holds either as JSON or a Python literal."""
    if isinstance(value, str):
        t = value.strip()
        for read in (json.loads, ast.literal_eval):
            try:
                return messages_of(read(t))
            except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
                continue
        return [("user", t)]
    if value is None:
        return [("user", "Please solve the problem.")]
    if isinstance(value, dict):
        return [(str(value.get("role", "user")), _text(value))]
    if isinstance(value, list):
        out = [(str(x.get("role", "user")), _text(x)) if isinstance(x, dict) else ("user", x.strip()) for x in value if isinstance(x, dict) and _text(x) or isinstance(x, str) and x.strip()]
        if out:
            return out
    return [("user", str(value))]


@F.pandas_udf(MESSAGES)
def messages(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [{"role": r, "content": c} for r, c in messages_of(t)])


def plain_prompt(msgs: Column, generation: bool = False) -> Column:
    """Non-blank contents with a blank line between them."""
    contents = F.filter(
        F.transform(msgs, lambda m: F.regexp_replace(F.coalesce(m["content"], F.lit("")), r"(?U)^\s+|\s+$", "")),
        lambda c: c != "",
    )
    return F.concat(F.array_join(contents, "\n\n"), F.lit("\n\n" if generation else ""))


def chat_prompt(msgs: Column, before: str = "<|{role}|>\n", after: str = "\n", generation: str = "") -> Column:
    """A template of the form before-role, content, after; ``{role}`` stands for the role."""
    left, _, right = before.partition("{role}")
    return F.concat(
        F.array_join(F.transform(msgs, lambda m: F.concat(F.lit(left), m["role"], F.lit(right), m["content"], F.lit(after))), ""),
        F.lit(generation),
    )


def variant(text: Column) -> Column:
    return F.try_parse_json(text)


def looks_like_sample(text: Column) -> Column:
    """Whether a JSON object has one of the known keys."""
    return F.coalesce(F.arrays_overlap(F.json_object_keys(text), F.array(*[F.lit(k) for k in SAMPLE_KEYS])), F.lit(False))


def _kind(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _string(v: Column, path: str) -> Column:
    """The value at a path if it is a string."""
    return F.when(_kind(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def _first_present(v: Column, keys: list[str]) -> Column:
    """The key of the first value that is there and not null."""
    return F.coalesce(*[F.when(F.coalesce(~_kind(v, f"$.{k}").isin("VOID"), F.lit(False)), F.lit(k)) for k in keys])


def _at(v: Column, keys: list[str], paths: list[str]) -> Column:
    """The first string under the first present key, at one of the paths below it."""
    key = _first_present(v, keys)
    out = None
    for k in keys:
        got = F.coalesce(*[_string(v, f"$.{k}{p}") for p in paths])
        out = F.when(key == k, got) if out is None else out.when(key == k, got)
    return out


def generation(v: Column) -> Column:
    """Generated text of a logged sample: a string, the head of nested lists, a field of it, or an argument."""
    heads = ["", "[0]", "[0][0]", "[0][0][0]"]
    paths = heads + [f"{h}.{f}" for h in heads[1:] for f in GENERATION_FIELDS]
    return F.coalesce(_at(v, GENERATION, paths), *[_string(v, f"$.arguments.{k}") for k in GENERATION], F.lit(""))


def problem(v: Column) -> Column:
    below = [f"$.{d}.{k}" for d in ("doc", "arguments") for k in PROBLEM]
    args = F.try_variant_get(v, "$.arguments", "array<variant>")
    long = F.get(
        F.filter(
            F.transform(args, lambda a: F.coalesce(*[F.when(F.schema_of_variant(a) == "STRING", F.try_variant_get(a, "$", "string"))])),
            lambda s: F.length(s) > 20,
        ),
        F.lit(0),
    )
    field = [_string(v, f"$.arguments[0].{k}") for k in PROBLEM]
    return F.coalesce(_at(v, PROBLEM, ["", *[f".{k}" for k in PROBLEM]]), *[_string(v, p) for p in below], long, *field, F.lit(""))


def reference(v: Column) -> Column:
    return F.coalesce(_at(v, REFERENCE, ["", *[f".{k}" for k in REFERENCE]]), *[_string(v, f"$.doc.{k}") for k in REFERENCE], F.lit(""))


def correctness(v: Column) -> Column:
    """A boolean, or a number above 0, under the first known key, at the root and then under ``metrics``; else null."""
    out = []
    for at in ("$", "$.metrics"):
        for k in CORRECT:
            kind = _kind(v, f"{at}.{k}")
            out.append(F.when(kind == "BOOLEAN", F.try_variant_get(v, f"{at}.{k}", "boolean")).when(F.regexp_like(kind, F.lit("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")), F.try_variant_get(v, f"{at}.{k}", "double") > 0))
    return F.coalesce(*out)
