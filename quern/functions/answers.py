"""Answers in texts: extraction, normalisation and matching as native expressions.

Blank means empty after trimming white space.  Balanced braces are found by a
fold over the characters after the last opening, which regular expressions
cannot do.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.operators.sequence import bound

#: Markers in the order in which their matches are appended. Fixed values.
MARKERS = [r"####\s*([^\n]+)", r"Answer\s*:\s*([^\n]+)", r"Final answer\s*:?\s*([^\n]+)", r"The answer is\s*([^\n\.]+)"]
NUMBER = r"[-+]?\d+(?:\.\d+)?(?:/\d+)?"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def balanced(from_brace: Column) -> Column:
    """What stands inside a text's first brace, which is its first character; null if it is never closed."""
    # state: depth and number of characters up to the close; braces alone are looked at
    end = F.aggregate(
        F.split(from_brace, "", -1),
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"), F.lit(0).alias("close")),
        lambda a, ch: F.struct(
            F.when(a["close"] > 0, a["depth"]).otherwise(a["depth"] + F.when(ch == "{", 1).when(ch == "}", -1).otherwise(0)).alias("depth"),
            (a["n"] + F.length(ch)).alias("n"),
            F.when((a["close"] == 0) & (ch == "}") & (a["depth"] == 1), a["n"] + 1).otherwise(a["close"]).alias("close"),
        ),
        lambda a: a["close"],
    )
    return F.when(end > 0, F.substr(from_brace, F.lit(2), end - 2))


def last_boxed(text: Column) -> Column:
    """Content of the last ``\\boxed{...}`` (white space may precede the brace), stripped; null if unbalanced or absent."""
    after = F.regexp_extract(text, r"(?s).*\\boxed\s*(\{.*)$", 1)
    return F.when(F.regexp_like(text, F.lit(r"\\boxed\s*\{")), strip(balanced(after)))


def marked(text: Column) -> Column:
    """The last match of the last marker that matches, without dots and dollars at its ends; null if none."""
    found = [F.try_element_at(F.regexp_extract_all(text, F.lit("(?iu)" + p), F.lit(1)), F.lit(-1)) for p in reversed(MARKERS)]
    return F.regexp_replace(strip(F.coalesce(*found)), r"^[.$]+|[.$]+$", "")


def last_number(text: Column) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit("(?U)" + NUMBER), F.lit(0)), F.lit(-1))


def last_line(text: Column) -> Column:
    return strip(F.element_at(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"), -1))


def extract_answer(text: Column, mode: str = "auto") -> Column:
    """Boxed content, else a marker's answer, else the last number, else the last line; '' for blank text."""

    def of(t: Column) -> Column:
        steps = []
        if mode in ("auto", "boxed"):
            steps.append(last_boxed(t))
        if mode in ("auto", "answer_marker"):
            steps.append(marked(t))
        if mode in ("boxed", "answer_marker"):
            steps.append(F.lit(""))
        else:
            steps += [last_number(t), last_line(t)]
        return F.when(t == "", F.lit("")).otherwise(F.coalesce(*steps))

    return bound(strip(F.coalesce(text, F.lit(""))), of)


def normalize(answer: Column) -> Column:
    a = strip(F.coalesce(answer, F.lit("")))
    for old, new in (("\\dfrac", "\\frac"), ("\\tfrac", "\\frac"), ("\\left", ""), ("\\right", ""), ("\\,", ""), ("\\!", ""), ("$", "")):
        a = F.replace(a, F.lit(old), F.lit(new))
    a = F.regexp_replace(strip(a), r"^\\boxed\s*\{(.+)\}$", "$1")
    a = F.regexp_replace(strip(a), r"^[ .]+|[ .]+$", "")
    a = F.replace(F.regexp_replace(a, r"(?U)\s+", ""), F.lit(","), F.lit(""))
    return F.lower(F.replace(F.replace(a, F.lit("\\pi"), F.lit("pi")), F.lit("π"), F.lit("pi")))


def as_float(c: Column) -> Column:
    """The number that Python's ``float`` reads: digits may be grouped by underscores, suffixes d and f are not read."""
    plain = F.regexp_like(c, F.lit(r"(?i)^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?$|^[+-]?(inf|infinity|nan)$"))
    return F.when(plain, F.replace(c, F.lit("_"), F.lit("")).try_cast("double"))


def answers_match(pred: Column, gold: Column) -> Column:
    p, g = normalize(pred), normalize(gold)
    close = F.abs(as_float(p) - as_float(g)) < 1e-9
    near = F.coalesce(close & ~F.isnan(as_float(p) - as_float(g)), F.lit(False))
    return F.when((p == "") | (g == ""), F.lit(False)).otherwise((p == g) | near)


def judge(text: Column, truth: Column, reference: Column, mode: str = "auto") -> Column:
    """Struct of the text's answer, the gold answer (extracted from the reference where blank) and their match."""
    pred = extract_answer(text, mode)
    given = strip(F.coalesce(truth, F.lit("")))
    gold = F.when((given == "") & (F.coalesce(reference, F.lit("")) != ""), extract_answer(reference, mode)).otherwise(given)
    return F.struct(pred.alias("student_answer"), gold.alias("ground_truth_answer"), answers_match(pred, gold).alias("is_correct"))


def last_boxed_only(text: Column) -> Column:
    """From the last ``\\boxed`` (or else ``\\fbox``) through its balanced brace; null if there is none."""

    def tail(marker: str) -> Column:
        return F.regexp_extract(text, rf"(?s)^.*(\\{marker}.*)$", 1)

    def cut(s: Column) -> Column:
        before = F.instr(s, "{")
        inside = balanced(F.substr(s, before, F.length(s)))
        return F.when(before > 0, F.concat(F.substr(s, F.lit(1), before), inside, F.lit("}")))

    return F.when(F.contains(text, F.lit("\\boxed")), cut(tail("boxed"))).when(F.contains(text, F.lit("\\fbox")), cut(tail("fbox")))


def remove_boxed(s: Column) -> Column:
    return F.when(F.startswith(s, F.lit("\\boxed{")) & F.endswith(s, F.lit("}")), F.substr(s, F.lit(8), F.length(s) - 8))


def eval_answer(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\\boxed")), remove_boxed(last_boxed_only(text)))


def boxed_count(text: Column) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit("\\boxed{"), F.lit("")))) / 7).cast("int")


def format_error(text: Column) -> Column:
    return ~F.contains(F.coalesce(text, F.lit("")), F.lit("boxed"))


def verdict(text: Column) -> Column:
    """Only the letter A counts as correct."""
    return strip(F.coalesce(text, F.lit(""))) == "A"


def strip_thinking(text: Column) -> Column:
    """What follows the first ``</think>``; nothing of what then begins with an opening one."""
    close = F.instr(text, "</think>")
    rest = F.when(close > 0, strip(F.substr(text, close + 8, F.length(text)))).otherwise(strip(text))
    return F.when(F.startswith(rest, F.lit("<think>")), F.lit("")).otherwise(rest)


def strip_fence(text: Column) -> Column:
    return strip(F.regexp_replace(strip(F.regexp_replace(text, r"^```(?:json)?", "")), r"```$", ""))


def first_boxed_line_end(text: Column) -> Column:
    """Characters up to the end of the line with the first complete, non-blank box; null if none.

    Unterminated and blank boxes are passed over.  The text is cut at braces and
    openings, and one fold over the parts keeps the open boxes: where each began,
    the depth outside it, and whether it holds anything but blanks.
    """
    nothing = F.struct(
        F.lit(0).alias("at"),
        F.lit(0).alias("depth"),
        F.array().cast("array<struct<begin:int,outside:int>>").alias("boxes"),
        F.lit(False).alias("filled"),
        F.lit(None).cast("int").alias("begin"),
        F.lit(None).cast("int").alias("close"),
    )

    def step(a: Column, x: Column) -> Column:
        at, depth = a["at"] + F.length(x), a["depth"]
        opens, down = x == "\\boxed{", x == "}"
        last = F.get(a["boxes"], F.size(a["boxes"]) - 1)
        ends = down & F.coalesce(last["outside"] == depth - 1, F.lit(False))
        first = ends & a["filled"] & (a["begin"].isNull() | (last["begin"] < a["begin"]))
        one = F.array(F.struct(a["at"].alias("begin"), depth.alias("outside")))
        return F.struct(
            at.alias("at"),
            (depth + F.when(opens | (x == "{"), 1).when(down, -1).otherwise(0)).alias("depth"),
            F.when(opens, F.concat(a["boxes"], one)).when(ends, F.slice(a["boxes"], F.lit(1), F.size(a["boxes"]) - 1)).otherwise(a["boxes"]).alias("boxes"),
            F.when(opens, False).otherwise(a["filled"] | (strip(x) != "")).alias("filled"),
            F.when(first, last["begin"]).otherwise(a["begin"]).alias("begin"),
            F.when(first, at).otherwise(a["close"]).alias("close"),
        )

    parts = F.regexp_extract_all(text, F.lit(r"\\boxed\{|[{}]|\\|[^{}\\]+"), F.lit(0))
    close = F.when(F.contains(text, F.lit("\\boxed{")), F.aggregate(parts, nothing, step, lambda a: a["close"]))

    def line(close: Column) -> Column:
        newline = F.instr(F.substr(text, close + 1, F.length(text)), "\n")
        return F.when(newline > 0, close + newline).otherwise(close).cast("int")

    return bound(close, line)


def template(text: str, column: Column, name: str = "problem") -> Column:
    """A template with ``{name}`` replaced; doubled braces stand for single ones."""
    done = text.replace("{{", "\x00").replace("}}", "\x01")
    pieces = [F.lit(x.replace("\x00", "{").replace("\x01", "}")) for x in done.split("{" + name + "}")]
    out = [pieces[0]]
    for p in pieces[1:]:
        out += [F.coalesce(column, F.lit("")), p]
    return F.concat(*out)
