"""Native answer functions and the grader against plain rereadings of their rules."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import answers as A
from quern.functions import grading as G
from quern.functions import jsons as Y


def column(spark, f, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("t")).alias("x")).collect()]


def test_last_boxed(spark):
    cases = {
        "\\boxed{a}": "a",
        "x \\boxed{ {b}{c} } y": "{b}{c}",
        "\\boxed{a} \\boxed{b": None,
        "none": None,
        "\\boxed  {q}": "q",
        "\\boxed{}": "",
        "\\boxed{a}\n\\boxed{{z}}": "{z}",
    }
    assert column(spark, A.last_boxed, *cases) == list(cases.values())


def test_extract_answer(spark):
    cases = {
        None: "",
        "  ": "",
        "so 3/4 and -2.5": "-2.5",
        "Answer: 7. \nFinal answer: 9": "9",
        "The answer is x. more": "x",
        "#### $5$.": "5",
        "no digits\nlast line ": "last line",
        "answer : 1\nanswer: 2": "2",
        "Final answer 3\nAnswer: 4": "3",
    }
    assert column(spark, A.extract_answer, *cases) == list(cases.values())


def test_answers_match(spark):
    rows = spark.createDataFrame(
        [("1,000", "1000.0"), ("", ""), ("\\dfrac12", "\\frac12"), ("1d", "1.0"), ("inf", "inf"), ("1_0", "10"), ("a", "b"), (None, "1")],
        "a string, b string",
    )
    assert [
        r[0] for r in rows.select(A.answers_match(F.col("a"), F.col("b"))).collect()
    ] == [True, False, True, False, True, True, False, False]


def test_first_boxed_line_end(spark):
    cases = {"\\boxed{1}\nrest": 10, "\\boxed{} \\boxed{2} tail": 18, "\\boxed{ \\boxed{3}": 17, "none": None, "ab\\boxed{{x}}c\nd": 15}
    assert column(spark, A.first_boxed_line_end, *cases) == list(cases.values())


def test_strip_thinking(spark):
    cases = {"<think>a</think> b": "b", "<think> open": "", "a <think>": "a <think>", "x</think><think>y": ""}
    assert column(spark, A.strip_thinking, *cases) == list(cases.values())


@pytest.mark.parametrize(
    ("given", "truth", "ok"),
    [
        ("\\frac12", "\\frac{1}{2}", True),
        ("0.5", "1/2", True),
        (".5", "0.5", True),
        ("x=3", "3", True),
        ("3\\text{ cm}", "3", True),
        ("\\sqrt2", "\\sqrt{2}", True),
        ("1\\%", "1", True),
        ("2/4", "1/2", False),
        ("\\\\left(1\\\\right)", "(1)", True),
        ("\\\\dfrac12", "\\frac{1}{2}", True),
        ("\\\\\\!left(2,3\\right)", "(2,3)", True),
        ("\\left(90^\\circ,\\$2\\right)", "(90,2)", True),
        ("5^{\\\\circ}", "5", True),
    ],
)
def test_mathd(given, truth, ok):
    assert (G.mathd(given) == G.mathd(truth)) is ok


@pytest.mark.parametrize(
    ("given", "truth", "ok"),
    [
        ("1,234", "1234", True),
        ("(1, 2)", "(1,2)", True),
        ("[1,2)", "(1,2)", False),
        ("2+3", "5", False),
        ("2*x", "2*x", True),
        ("1/2+1/3", "(2+3)/6", True),
        ("2/4", "1/2", False),
        ("5 days", "5", True),
        ("3 million", "3*10^6", True),
        ("", "1", False),
        ("sqrt(4)+1/2", "5/2", True),
        ("2 feet and 3 inches", "2, 3", True),
        ("5 hours or 3 days", "5 or 3", True),
        ("5 hours or 3 days", "53", False),
        ("10\\% and 20\\%", "(10, 20)", False),
        ("10\\% or 20\\%", "10 , 20", True),
        ("1 million or 2 million", "1*10^6, 2*10^6", True),
        ("3 cm^2 and 4 cm", "3,4", True),
        ("$5 and $6", "5,6", True),
    ],
)
def test_plain(given, truth, ok):
    assert G.grade_plain(given, truth) is ok


@pytest.mark.parametrize(
    ("a", "b", "ok"),
    [
        ("x+x", "2x", True),
        ("(x+1)^2", "x^2+2x+1", True),
        ("(x+1)^2", "x^2+1", False),
        ("(a^2-b^2)/(a-b)", "a+b", True),
        ("1/sqrt(3)", "sqrt(3)/3", True),
        ("sqrt(12)", "2sqrt(3)", True),
        ("sqrt(x)", "sqrt(x)", True),
        ("sqrt(x)", "sqrt(y)", False),
        ("1/0", "2/0", False),
        ("2^70", "2^70", False),
        ("x^9", "x^8*x", True),
        ("((x", "((x", True),
        ("pi+1", "1+pi", True),
        ("p+i", "i+p", True),
        ("-x^2", "(-x)^2", False),
    ],
)
def test_exact_arithmetic(a, b, ok):
    assert G.equal_exactly(a, b) is ok


@given(st.integers(-9, 9), st.integers(-9, 9), st.integers(1, 9))
@settings(max_examples=100, deadline=None)
def test_products_equal_their_expansion(a, b, c):
    assert G.exact(f"(x+({a}))*({c}x+({b}))").same(G.exact(f"{c}x^2+({b})x+({a})*{c}x+({a})*({b})"))


def test_latex_text():
    cases = {
        "\\frac{1}{2}": "1/2",
        "\\sqrt{\\frac{x}{4}}": "sqrt( x/4)",
        "2\\pi r": "2pi r",
        "\\text{ab} \\cdot \\left(3\\right)": "ab * (3)",
        "1\\frac12": "1 1/2",
        "\\unknown{7}": "7",
    }
    assert {k: G.latex_text(k) for k in cases} == cases


def test_grade():
    assert G.grade("so \\boxed{7}", "7") and G.grade("\\boxed{7}", "\\boxed{7.0}") and not G.grade("7", "7") and not G.grade("\\boxed{7}", "") and not G.grade(None, "7")


def test_commas_reach_a_fixpoint():
    assert G.without_commas("1,234,567") == "1234567" and G.without_commas("1,234,567,890") == "1234,567890"


@given(st.text(alphabet="{}ab\\ ", max_size=40))
@settings(max_examples=200, deadline=None)
def test_boxed_is_balanced(text):
    got = G.boxed("\\boxed{" + text)
    assert got is None or got.count("{") >= 0 and ("\\boxed{" + got + "}") in "\\boxed{" + text


@pytest.mark.parametrize(
    ("text", "got"),
    [
        ('{"a": 1}', {"a": 1}),
        ('x {"a": {"b": "}"}} y', {"a": {"b": "}"}}),
        ("```json\n[1]\n```", [1]),
        ("{bad} {\"c\": 2}", {"c": 2}),
        ("none", None),
        (None, None),
    ],
)
def test_first_object(text, got):
    assert Y.first_object(text) == got


def test_messages_of():
    assert Y.messages_of(None) == [("user", "Please solve the problem.")]
    assert Y.messages_of("[{'role': 'system', 'content': 'a'}, 'b']") == [("system", "a"), ("user", "b")]
    assert Y.messages_of("plain") == [("user", "plain")]


def test_number_pattern():
    assert re.findall(A.NUMBER, "a -1.5/2 b 3") == ["-1.5/2", "3"]
