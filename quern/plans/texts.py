"""Queries on texts: n-grams, chunks, answers, boxes, grading."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import answers as A
from quern.functions import grading as G
from quern.operators import evaluation, rollouts, sequence
from quern.plans.facts import BOXED, WORDS, boxed_texts, r6, read, words
from quern.plans.registry import query
from quern.session import ship

_GRAMS = "g AS (SELECT doc_id, len(w) AS n, list_transform(generate_series(1, len(w) - 3), lambda i: array_to_string(w[i:i + 3], chr(31))) AS g FROM wd)"


@query(
    "R4_repeated_ratio",
    f"WITH {WORDS}, {_GRAMS} SELECT doc_id, round(CASE WHEN n >= 4 THEN 1 - len(list_distinct(g)) / len(g) ELSE 0 END, 6) AS ratio FROM g",
)
def r4(spark, sf):
    return r6(words(spark, sf).select("doc_id", sequence.repeated_ratio(F.col("w"), 4).alias("ratio")))


@query(
    "F10_H4_ngrams",
    f"WITH {WORDS}, {_GRAMS} SELECT doc_id, CASE WHEN n >= 4 THEN len(g) ELSE 0 END AS total, CASE WHEN n >= 4 THEN len(list_distinct(g)) ELSE 0 END AS distinct_n FROM g",
)
def f10(spark, sf):
    grams = F.transform(sequence.ngrams(F.col("w"), 4), lambda g: F.xxhash64(g))
    return words(spark, sf).select("doc_id", F.size(grams).alias("total"), F.size(F.array_distinct(grams)).alias("distinct_n"))


@query(
    "F8_chunks",
    f"WITH {WORDS}, c AS (SELECT doc_id, len(w) AS n, unnest(generate_series(0, len(w) - 1, 32)) AS s FROM wd) SELECT doc_id, s // 32 AS id, s AS start_token, least(s + 32, n) AS end_token FROM c WHERE n > 0",
)
def f8(spark, sf):
    return words(spark, sf).select("doc_id", F.explode(sequence.chunks(F.col("w"), 32)).alias("c")).select("doc_id", "c.*")


@query(
    "F8_chunks_one_based",
    f"WITH {WORDS}, c AS (SELECT doc_id, len(w) AS n, unnest(generate_series(0, len(w) - 1, 32)) AS s FROM wd) SELECT doc_id, s // 32 AS id, s + 1 AS start_token_pos, least(s + 32, n) AS end_token_pos FROM c WHERE n > 0",
)
def f8b(spark, sf):
    return words(spark, sf).select("doc_id", F.explode(sequence.one_based_chunks(F.col("w"), 32)).alias("c")).select("doc_id", "c.*")


@query(
    "C16_slices",
    f"WITH {WORDS} SELECT doc_id, array_to_string(CASE WHEN len(w) > 5 THEN w[-5:] ELSE w END, ' ') AS last_ids, array_to_string(w[1:3], ' ') AS first_ids, right(text, 300) AS tail, left(text, 300) AS head FROM wd",
)
def c16(spark, sf):
    w = F.col("w")
    return words(spark, sf).select(
        "doc_id",
        F.array_join(sequence.last_n(w, 5), " ").alias("last_ids"),
        F.array_join(sequence.first_n(w, 3), " ").alias("first_ids"),
        F.right("text", F.lit(300)).alias("tail"),
        F.left("text", F.lit(300)).alias("head"),
    )


@query("E22_distinct_n", """WITH r AS (SELECT doc_id // 4 AS example_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT example_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(generate_series(1, len(w) - 3), lambda i: array_to_string(w[i:i + 3], chr(31))) ELSE [NULL] END) AS gram FROM r)
SELECT example_id, round(coalesce(count(DISTINCT gram) / nullif(count(gram), 0), 0), 6) AS "distinct" FROM g GROUP BY example_id""")
def e22(spark, sf):
    d = read(spark, sf, "documents").select(F.floor(F.col("doc_id") / 4).alias("example_id"), F.col("text").alias("response"))
    return r6(evaluation.distinct_n(d, 4))


_STRIP = "regexp_replace(regexp_replace({}, '^\\s+', ''), '\\s+$', '')"
_MARK = "regexp_replace(" + _STRIP.format(
    "coalesce(" + ", ".join(
        f"nullif(regexp_extract_all(t, '(?i){p}', 1)[-1], '')" for p in (
            "The answer is\\s*([^\\n\\.]+)",
            "Final answer\\s*:?\\s*([^\\n]+)",
            "Answer\\s*:\\s*([^\\n]+)",
            "####\\s*([^\\n]+)",
        )
    ) + ")"
) + ", '^[.$]+|[.$]+$', '', 'g')"
#: Boxes in these texts have one level of braces inside at most.
_LAST = "regexp_extract(t, '(?s)^.*\\\\boxed\\s*(\\{.*)$', 1)"
_BOX = f"CASE WHEN regexp_matches(t, '\\\\boxed\\s*\\{{') AND regexp_matches({_LAST}, '^\\{{([^{{}}]|\\{{([^{{}}]|\\{{[^{{}}]*\\}})*\\}})*\\}}') THEN " + _STRIP.format(
    f"regexp_extract({_LAST}, '^\\{{(([^{{}}]|\\{{([^{{}}]|\\{{[^{{}}]*\\}})*\\}})*)\\}}', 1)"
) + " END"
_NUM = "regexp_extract_all(t, '[-+]?\\d+(?:\\.\\d+)?(?:/\\d+)?')[-1]"
_BT = f"{BOXED}, st AS (SELECT doc_id, n_chars, gold, text, {_STRIP.format('text')} AS t FROM bx)"


@query(
    "X1_extract_answer",
    f"WITH {_BT} SELECT doc_id, coalesce({_BOX}, {_MARK}, {_NUM}) AS answer FROM st WHERE coalesce({_BOX}, {_MARK}, {_NUM}) IS NOT NULL",
)
def x1(spark, sf):
    return boxed_texts(spark, sf).select("doc_id", A.extract_answer(F.col("text")).alias("answer"))


@query("X2_last_boxed", f"WITH {_BT} SELECT doc_id, {_BOX} AS answer FROM st")
def x2(spark, sf):
    return boxed_texts(spark, sf).select("doc_id", A.last_boxed(A.strip(F.col("text"))).alias("answer"))


@query("X3_markers", f"WITH {_BT} SELECT doc_id, {_MARK} AS answer FROM st")
def x3(spark, sf):
    return boxed_texts(spark, sf).select("doc_id", A.marked(A.strip(F.col("text"))).alias("answer"))


@query("X4_last_number", f"WITH {_BT} SELECT doc_id, {_NUM} AS answer FROM st")
def x4(spark, sf):
    return boxed_texts(spark, sf).select("doc_id", A.last_number(A.strip(F.col("text"))).alias("answer"))


_X5 = "SELECT doc_id, ' $\\dfrac{' || n_chars || '}{1,000}\\,$ . ' AS raw, CASE WHEN n_chars % 2 = 0 THEN '\\boxed{ \\left( ' || n_chars || '\\pi \\right) }' ELSE n_chars || '.0 ' END AS other FROM documents"


def _x5(spark, sf):
    n = F.col("n_chars").cast("string")
    other = F.when(
        F.col("n_chars") % 2 == 0,
        F.concat(F.lit("\\boxed{ \\left( "), n, F.lit("\\pi \\right) }")),
    ).otherwise(F.concat(n, F.lit(".0 ")))
    return read(spark, sf, "documents").select(
        "doc_id",
        F.concat(F.lit(" $\\dfrac{"), n, F.lit("}{1,000}\\,$ . ")).alias("raw"),
        other.alias("other"),
        "n_chars",
    )


@query(
    "X5_normalize",
    f"WITH x AS ({_X5}) SELECT doc_id, '\\frac{{' || regexp_extract(raw, '\\d+') || '}}{{1000}}' AS a, CASE WHEN starts_with(other, '\\boxed') THEN '(' || regexp_extract(other, '\\d+') || 'pi)' ELSE trim(other) END AS b FROM x",
)
def x5(spark, sf):
    return _x5(spark, sf).select("doc_id", A.normalize(F.col("raw")).alias("a"), A.normalize(F.col("other")).alias("b"))


@query("X6_answers_match", "SELECT doc_id, n_chars % 3 = 0 AS equal, n_chars % 2 = 1 AS numeric, false AS blank FROM documents")
def x6(spark, sf):
    d = _x5(spark, sf)
    n = F.col("n_chars").cast("string")
    return d.select(
        "doc_id",
        A.answers_match(
            F.concat(F.lit("$"), n, F.lit("$")),
            F.when(F.col("n_chars") % 3 == 0, n).otherwise(F.concat(n, F.lit("x"))),
        ).alias("equal"),
        A.answers_match(F.col("other"), n).alias("numeric"),
        A.answers_match(F.lit(" "), F.lit("")).alias("blank"),
    )


@query(
    "X7_judge",
    f"WITH {_BT}, a AS (SELECT doc_id, gold, coalesce({_BOX}, {_MARK}, {_NUM}) AS ans FROM st) SELECT doc_id, ans AS student_answer, gold AS ground_truth_answer, ans = gold AS is_correct FROM a",
)
def x7(spark, sf):
    return boxed_texts(spark, sf).select("doc_id", A.judge(F.col("text"), F.col("gold"), F.lit("")).alias("j")).select("doc_id", "j.*")


@query(
    "X8_X9_boxed_only",
    f"WITH {BOXED} SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '\\boxed{{\\frac{{1}}{{' || n_chars || '}}}}' WHEN 5 THEN '\\boxed{{}}' END AS boxed, CASE doc_id % 6 WHEN 0 THEN '\\frac{{1}}{{' || n_chars || '}}' WHEN 5 THEN '' END AS answer FROM bx",
)
def x8(spark, sf):
    t = F.col("text")
    return boxed_texts(spark, sf).select("doc_id", A.last_boxed_only(t).alias("boxed"), A.eval_answer(t).alias("answer"))


@query(
    "X20_X22_boxes",
    f"WITH {BOXED} SELECT doc_id, (length(text) - length(replace(text, '\\boxed{{', ''))) // 7 AS boxes, NOT contains(text, 'boxed') AS format_error FROM bx",
)
def x20(spark, sf):
    return boxed_texts(spark, sf).select(
        "doc_id",
        A.boxed_count(F.col("text")).alias("boxes"),
        A.format_error(F.col("text")).alias("format_error"),
    )


@query("X21_boxed_line_end", f"WITH {BOXED} SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN length(text) - 5 END AS line_end FROM bx")
def x21(spark, sf):
    return boxed_texts(spark, sf).select("doc_id", A.first_boxed_line_end(F.col("text")).alias("line_end"))


_WHITE = "chr(32) || chr(9) || chr(10) || chr(13)"


@query(
    "X24_verdict",
    f"SELECT doc_id, trim(CASE doc_id % 3 WHEN 0 THEN ' ' || upper(left(lang, 1)) || chr(10) WHEN 1 THEN 'A' || left(text, (doc_id % 2)::INT) ELSE source END, {_WHITE}) = 'A' AS ok FROM documents",
)
def x24(spark, sf):
    k = F.col("doc_id") % 3
    first = F.concat(F.lit(" "), F.upper(F.left("lang", F.lit(1))), F.lit("\n"))
    said = F.when(k == 0, first).when(
        k == 1,
        F.concat(F.lit("A"), F.left("text", (F.col("doc_id") % 2).cast("int"))),
    ).otherwise(F.col("source"))
    return read(spark, sf, "documents").select("doc_id", A.verdict(said).alias("ok"))


@query("X27_strip_thinking", f"""WITH t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '<think>' || text || '</think> ' || lang || ' </think>' WHEN 1 THEN ' <think>' || text WHEN 2 THEN text || '</think><think>' || lang ELSE ' ' || text || chr(10) END AS t FROM documents),
r AS (SELECT doc_id, trim(CASE WHEN contains(t, '</think>') THEN substr(t, instr(t, '</think>') + 8) ELSE t END, {_WHITE}) AS r FROM t) SELECT doc_id, CASE WHEN starts_with(r, '<think>') THEN '' ELSE r END AS rest FROM r""")
def x27(spark, sf):
    k = F.col("doc_id") % 4
    cases = [
        ("<think>", "text", "</think> ", "lang", " </think>"),
        (" <think>", "text"),
        ("", "text", "</think><think>", "lang"),
        (" ", "text", "\n"),
    ]
    each = [F.concat(*[F.col(x) if x in ("text", "lang") else F.lit(x) for x in case]) for case in cases]
    t = F.when(k == 0, each[0]).when(k == 1, each[1]).when(k == 2, each[2]).otherwise(each[3])
    return read(spark, sf, "documents").select("doc_id", A.strip_thinking(t).alias("rest"))


@query(
    "X28_code_fence",
    f"SELECT doc_id, trim(CASE WHEN doc_id % 3 = 2 THEN substr(text, 4) ELSE text END, {_WHITE}) AS body FROM documents WHERE NOT starts_with(text, '`') AND NOT ends_with(trim(text, {_WHITE}), '```')",
)
def x28(spark, sf):
    k = F.col("doc_id") % 3
    t = F.when(
        k == 0,
        F.concat(F.lit("```json\n"), "text", F.lit("\n```")),
    ).when(k == 1, F.concat(F.lit("```"), "text")).otherwise(F.substring("text", 4, 1 << 30))
    rows = read(spark, sf, "documents").where(~F.startswith("text", F.lit("`")) & ~F.endswith(A.strip(F.col("text")), F.lit("```")))
    return rows.select("doc_id", A.strip_fence(t).alias("body"))


@query("X29_C8_prompts", "SELECT item_id, 'Solve {it}: ' || text || chr(10) || 'End' AS prompt FROM benchmark")
def x29(spark, sf):
    return read(spark, sf, "benchmark").select("item_id", A.template("Solve {{it}}: {problem}\nEnd", F.col("text")).alias("prompt"))


@query(
    "X10_X18_mathd",
    "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '\\frac{' || n_chars || '}{7}' WHEN 1 THEN '\\frac{1}{2}' WHEN 2 THEN '\\sqrt{3}+' || n_chars ELSE n_chars::VARCHAR END AS form, '(' || n_chars || ')' AS doubled FROM documents",
)
def x10(spark, sf):
    ship(spark)
    k, n = F.col("doc_id") % 4, F.col("n_chars").cast("string")
    t = F.when(k == 0, F.concat(n, F.lit("/7"))).when(k == 1, F.lit("x = .5")).when(
        k == 2,
        F.concat(F.lit("\\left\\sqrt3 + \\right "), n),
    ).otherwise(F.concat(n, F.lit("\\text{ cm}")))
    doubled = F.concat(F.lit("\\\\left("), n, F.lit("\\\\right)"))
    return read(spark, sf, "documents").select("doc_id", G.mathd_udf(t).alias("form"), G.mathd_udf(doubled).alias("doubled"))


_NUMBERS = """WITH n AS (SELECT doc_id, n_chars, CASE doc_id % 5 WHEN 0 THEN n_chars || ',000' WHEN 1 THEN n_chars || ',234,567' WHEN 2 THEN n_chars || '/' || (doc_id % 12) WHEN 3 THEN (n_chars / 8.0)::VARCHAR ELSE '-' || n_chars || '/0' || (doc_id % 3) END AS t FROM documents),
c AS (SELECT *, regexp_replace(regexp_replace(t, '(\\d),(\\d\\d\\d)($|\\D)', '\\1\\2\\3', 'g'), '(\\d),(\\d\\d\\d)($|\\D)', '\\1\\2\\3', 'g') AS bare FROM n)"""


@query(
    "X11_X12_X14_plain",
    _NUMBERS + r""" SELECT doc_id, (n_chars * 1000)::VARCHAR AS plain, n_chars || ',' || (doc_id % 12) AS joined, bare AS no_commas, coalesce(abs(try_cast(bare AS DOUBLE) - round(try_cast(bare AS DOUBLE))) <= 1e-7, false) AS whole,
    regexp_matches(t, '^-?[0-9]+.?/0*[1-9][0-9]*.?$') AS fraction FROM c""".replace("\\\\", "\\"),
)
def x11(spark, sf):
    ship(spark)
    n, k = F.col("n_chars").cast("string"), F.col("doc_id") % 5
    eighth = (F.col("n_chars") / 8.0).cast("string")
    t = F.when(k == 0, F.concat(n, F.lit(",000"))).when(k == 1, F.concat(n, F.lit(",234,567")))
    t = t.when(k == 2, F.concat(n, F.lit("/"), (F.col("doc_id") % 12).cast("string"))).when(k == 3, eighth)
    t = t.otherwise(F.concat(F.lit("-"), n, F.lit("/0"), (F.col("doc_id") % 3).cast("string")))
    unit = F.when(k < 2, F.lit(" feet and ")).when(k == 2, F.lit(" or ")).when(k == 3, F.lit(" hours^2 or $")).otherwise(F.lit("\\% and "))
    return read(spark, sf, "documents").select("doc_id", "n_chars", t.alias("t")).select(
        "doc_id",
        G.plain_udf(F.concat((F.col("n_chars") * 1000).cast("string"), F.lit(".0"))).alias("plain"),
        G.plain_udf(F.concat(F.col("n_chars").cast("string"), unit, (F.col("doc_id") % 12).cast("string"), F.lit(" inches"))).alias("joined"),
        G.commas_udf(F.col("t")).alias("no_commas"),
        G.is_int_udf(F.col("t")).alias("whole"),
        G.is_fraction(F.col("t")).alias("fraction"),
    )


#: Texts of tuples and others, and expressions with several letters, from the row's own columns.
_TUPLES = """WITH t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '(' || lang || ', ' || n_chars || ']' WHEN 1 THEN '[' || lang || ',' || source || ' ,' || n_chars || ')' WHEN 2 THEN lang || ', ' || source ELSE '((' || lang || '))' END AS t,
CASE doc_id % 4 WHEN 0 THEN 'sqrt(' || left(lang, 1) || ')+' || left(source, 1) WHEN 1 THEN left(source, (doc_id % 5)::INT) || '+x^2' WHEN 2 THEN left(lang, 1) || '^' || (n_chars % 30) ELSE lang || '^{2}' END AS e FROM documents)"""


@query(
    "X13_X15_tuples",
    _TUPLES + r""" SELECT doc_id, CASE WHEN regexp_matches(t, '^[()\[\]][^()\[\]]+[()\[\]]$') THEN array_to_string(list_transform(string_split(t[2:-2], ','), lambda x: trim(x)), '|') ELSE t END AS parts,
    len(list_distinct(regexp_extract_all(regexp_replace(e, 'sqrt|frac', '', 'g'), '\p{L}'))) <= 2 AND NOT regexp_matches(e, '\^[{(]|\^[0-9]+\^|\^[0-9][0-9]+') AS allowed FROM t""",
)
def x13(spark, sf):
    ship(spark)
    k, n, c = F.col("doc_id") % 4, F.col("n_chars").cast("string"), F.concat
    t = F.when(k == 0, c(F.lit("("), "lang", F.lit(", "), n, F.lit("]")))
    t = t.when(k == 1, c(F.lit("["), "lang", F.lit(","), "source", F.lit(" ,"), n, F.lit(")")))
    t = t.when(k == 2, c("lang", F.lit(", "), "source")).otherwise(c(F.lit("(("), "lang", F.lit("))")))
    first = lambda name, m=F.lit(1): F.left(name, m)
    e = F.when(k == 0, c(F.lit("sqrt("), first("lang"), F.lit(")+"), first("source")))
    e = e.when(k == 1, c(first("source", (F.col("doc_id") % 5).cast("int")), F.lit("+x^2")))
    e = e.when(k == 2, c(first("lang"), F.lit("^"), (F.col("n_chars") % 30).cast("string"))).otherwise(c("lang", F.lit("^{2}")))
    return read(spark, sf, "documents").select(
        "doc_id",
        F.array_join(G.elements_udf(t), "|").alias("parts"),
        G.evaluable(e).alias("allowed"),
    )


#: Pairs of plain answers with @ for a number that differs by row, and whether they are equal.
_EQUAL = [
    ("(@, 1/2)", "(@,1/2)", True), ("1/2+1/@", "(2+@)/(2*@)", True), ("2/4", "1/2", False), ("x+x+@", "2x+@", True),
    ("(x+@)^2", "x^2+2*@*x+@*@", True), ("(x+@)^2", "x^2+@*@", False), ("(x^2-1)/(x-1)", "x+1", True), ("2(x+y)", "2x+2y", True),
    ("sqrt(8)+@", "2sqrt(2)+@", True), ("1/sqrt(2)", "sqrt(2)/2", True), (
        "sqrt(2)sqrt(3)",
        "sqrt(6)",
        True,
    ), ("sqrt(5)+@", "sqrt(6)+@", False),
    ("\\frac{x}{2}+@", "x/2+@", True), ("2\\pi+@", "@+2pi", True), ("[@,3)", "[@,3]", False), ("3.50", "7/2", True),
    ("x^-1", "1/x", True), ("xy", "yx", True), ("@.0", "@", True), ("x+y+z", "z+y+x", False),
]


@query(
    "X16_X17_X19_grade",
    "SELECT doc_id, doc_id % 4 <> 3 AS ok, (list_value(" + ", ".join(str(ok).lower() for *_, ok in _EQUAL) + f"))[1 + doc_id % {len(_EQUAL)}] AS plain_ok FROM documents",
)
def x17(spark, sf):
    ship(spark)
    k, n = F.col("doc_id") % 4, F.col("n_chars").cast("string")
    given = F.when(k == 0, F.concat(F.lit("\\boxed{"), n, F.lit("}"))).when(
        k == 1,
        F.concat(F.lit("so \\boxed{2*"), n, F.lit("/2+0}")),
    ).when(k == 2, F.concat(F.lit("\\boxed{"), n, F.lit(".0}"))).otherwise(F.concat(F.lit("\\boxed{"), n, F.lit("1}")))
    truth = F.when(k == 1, F.concat(F.lit("("), n, F.lit("*3)/3"))).otherwise(n)
    sides = [F.replace(F.get(F.array(*[F.lit(case[i]) for case in _EQUAL]), F.col("doc_id") % len(_EQUAL)), F.lit("@"), n) for i in (0, 1)]
    return read(spark, sf, "documents").select("doc_id", G.grade_udf(given, truth).alias("ok"), G.grade_plain_udf(*sides).alias("plain_ok"))


@query(
    "R5_boxed_trim",
    f"WITH {BOXED} SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN true ELSE false END AS cut, (length(text) - length(replace(text, '\\boxed{{', ''))) // 7 AS boxes FROM bx",
)
def r5(spark, sf):
    t = boxed_texts(spark, sf).select("doc_id", F.split(F.concat("text", F.lit("\nmore of it")), r"(?=[ \n])", -1).alias("pieces"))
    _, cut, boxes = rollouts.boxed_trim(F.col("pieces"))
    return t.select("doc_id", cut.alias("cut"), boxes.alias("boxes"))
