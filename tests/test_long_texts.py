"""Queries on answers read whole documents: boxes, markers and numbers far behind the beginning."""

import re

from quern.plans import registry
from quern.plans.facts import boxed_texts

PLACES = [
    "\nso \\boxed{9} mid\n",
    "\nFinal answer: 31\n",
    " 17/4 x ",
    "\\boxed{ } \\boxed{\\frac{2}{3}} y\n",
    "\n#### 8\nThe answer is 12.\n",
    " ",
]
MARKERS = [r"The answer is\s*([^\n\.]+)", r"Final answer\s*:?\s*([^\n]+)", r"Answer\s*:\s*([^\n]+)", r"####\s*([^\n]+)"]


def closed(t, brace):
    """Place of the brace that closes the one at ``brace``; None if there is none."""
    depth = 0
    for k in range(brace, len(t)):
        depth += {"{": 1, "}": -1}.get(t[k], 0)
        if depth == 0:
            return k
    return None


def last_boxed(t):
    at = [m.end() - 1 for m in re.finditer(r"\\boxed\s*\{", t)]
    end = closed(t, at[-1]) if at else None
    return None if end is None else t[at[-1] + 1 : end].strip()


def marked(t):
    found = [re.findall(p, t, re.I) for p in MARKERS]
    return next((re.sub(r"^[.$]+|[.$]+$", "", f[-1].strip()) for f in found if f), None)


def last_number(t):
    found = re.findall(r"[-+]?\d+(?:\.\d+)?(?:/\d+)?", t)
    return found[-1] if found else None


def answer(t):
    return next(x for x in (last_boxed(t), marked(t), last_number(t)) if x is not None)


def line_end(t):
    for m in re.finditer(r"\\boxed\{", t):
        end = closed(t, m.end() - 1)
        if end is not None and t[m.end() : end].strip():
            return t.find("\n", end) + 1 or end + 1
    return None


def trim(t):
    pieces = re.split(r"(?=[ \n])", t + "\nmore of it")
    end, total = line_end("".join(pieces)), 0
    for n, p in enumerate(pieces, 1):
        total += len(p)
        if end is not None and total >= end:
            return n < len(pieces)
    return False


def boxed_only(t):
    at = t.rfind("\\boxed")
    end = closed(t, t.index("{", at)) if at >= 0 and "{" in t[at:] else None
    return None if end is None else t[at : end + 1]


def test_answers_behind_the_beginning(spark, tmp_path):
    rows = [(i, "word " * 60 + place + "more " * 40) for i, place in enumerate(p for p in PLACES for _ in range(6))]
    sf = str(tmp_path)
    spark.createDataFrame(
        [(i, t, len(t)) for i, t in rows],
        "doc_id long, text string, n_chars long",
    ).coalesce(1).write.parquet(f"{sf}/documents.parquet")
    whole = {r.doc_id: r.text for r in boxed_texts(spark, sf).collect()}
    assert all(whole[i].startswith(t) for i, t in rows)
    got = {q: {r.doc_id: r for r in registry.queries()[q](spark, sf).collect()} for q in ("X1_extract_answer", "X2_last_boxed", "X3_markers", "X4_last_number", "X7_judge", "X8_X9_boxed_only", "X20_X22_boxes", "X21_boxed_line_end", "R5_boxed_trim")}
    for i, t in whole.items():
        s, box = t.strip(), boxed_only(t)
        assert got["X1_extract_answer"][i].answer == answer(s)
        assert got["X2_last_boxed"][i].answer == last_boxed(s)
        assert got["X3_markers"][i].answer == marked(s)
        assert got["X4_last_number"][i].answer == last_number(s)
        assert got["X7_judge"][i].student_answer == answer(s)
        assert got["X8_X9_boxed_only"][i].boxed == box
        assert got["X8_X9_boxed_only"][i].answer == (box[7:-1] if box and box.startswith("\\boxed{") else None)
        assert (got["X20_X22_boxes"][i].boxes, got["X20_X22_boxes"][i].format_error) == (t.count("\\boxed{"), "boxed" not in t)
        assert got["X21_boxed_line_end"][i].line_end == line_end(t)
        assert (got["R5_boxed_trim"][i].cut, got["R5_boxed_trim"][i].boxes) == (trim(t), t.count("\\boxed{"))
    scores = registry.queries()["E23_scores"](spark, sf).collect()[0]
    assert (scores.format_errors, scores.responses) == (sum("boxed" not in t for t in whole.values()), len(whole))


def test_distinct_ngrams_are_not_shuffled(spark, monkeypatch):
    """Texts are, once; keys of many characters are taken apart and give the same."""
    from quern.operators import evaluation

    rows = [(k % 7, f"a b c d e f {k} a b c d e" if k % 5 else None) for k in range(60)] + [(None, "a b c d a b c d"), (None, "x"), (8, "too few"), (9, ""), (10, "ab c d e a bc d e")]
    df = spark.createDataFrame(rows, "example_id long, response string")
    want = {}
    for key, text in rows:
        w = (text or "").split()
        want.setdefault(key, []).extend(tuple(w[i : i + 4]) for i in range(len(w) - 3))
    want = {k: len(set(g)) / len(g) if g else 0.0 for k, g in want.items()}
    got = evaluation.distinct_n(df)
    assert dict(map(tuple, got.collect())) == want
    assert "Generate explode" not in got._jdf.queryExecution().executedPlan().toString()
    for large, sent in ((20, 100), (20, 0), (0, 100)):
        monkeypatch.setattr(evaluation, "LARGE", large)
        monkeypatch.setattr(evaluation, "MOST_SENT", sent)
        mixed = evaluation.distinct_n(df)
        assert dict(map(tuple, mixed.collect())) == want
        assert mixed.count() == len(want)
