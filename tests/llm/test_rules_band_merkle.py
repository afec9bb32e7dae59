"""Quality cascade, band join and Merkle manifest against brute force, and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quern.llm import band_join as B
from quern.llm import merkle as MK
from quern.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def figures_brute(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    count, inside = Counter(windows), set()
    for k, w in enumerate(windows):
        if count[w] > 1:
            inside |= {k, k + 1, k + 2}
    lines = (text or "").split("\n")
    dup = sum(bool(WORD.search(x)) and x in lines[:k] for k, x in enumerate(lines))
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return (len(words), sum(map(len, words)), symbols, dup, len(inside))


def texts():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdé日") for _ in range(r.randint(1, 6)))
    prose = " ".join(word() for _ in range(80))
    out = [None, "", " ", "\n\n", "a", "a b a b a b", prose, prose, prose.upper(), prose.replace(" ", " | "), "x\ny\nx\n \n \nx"]
    out += ["1 2 3 4 " * 20, "# " * 60 + prose, "7" * 3_000_000, "ab " * 100 + prose, "\n".join([prose[:90]] * 9 + [word() for _ in range(90)])]
    for _ in range(30):
        out.append(" ".join(r.choice([word(), "the", "of"]) for _ in range(r.randint(0, 120))).replace("of the", "of\nthe"))
    return out


def test_quality_figures_and_verdicts(spark, monkeypatch):
    rows = [(k if k % 5 else None, t, "r") for k, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    order = Q.learned_order(docs)
    assert sorted(order) == sorted(Q.RULES)
    got = Q.judged(docs, ["doc_id", "n_words"], order).collect()
    assert len(got) == len(rows)
    want = Counter()
    for i, t, _ in rows:
        n, chars, sym, dup, rep = figures_brute(t)
        failed = n < 50 or 100 * rep > 50 * n
        x = Q.Text(t)
        want[i, n, chars, sym, dup, rep, failed, not failed and not any(f(x) for f in Q.RULES.values())] += 1
    assert Counter((x["row"]["doc_id"], *[x[c] for c in Q.FIGURES], x["base_failed"], x["kept"]) for x in got) == want
    assert {x["row"]["n_words"] for x in got} == {"r"}
    assert sum(x["kept"] for x in got) >= 2 and {x["rejected_by"] for x in got} >= {"base", None}


def test_order_of_rules_never_changes_the_verdict(spark):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts())], "doc_id long, text string")
    verdict = lambda order: {x["row"]["doc_id"]: x["kept"] for x in Q.judged(docs, ["doc_id"], order).collect()}
    names = sorted(Q.RULES)
    assert verdict(names) == verdict(names[::-1])


def test_rules_go_by_rejections_per_cost_of_what_is_left():
    cost = {"cheap": 1.0, "dear": 10.0, "same": 2.0, "none": 0.5}
    rejected = Counter({frozenset({"cheap", "same"}): 50, frozenset({"dear"}): 40, frozenset({"same"}): 1, frozenset(): 100})
    assert Q.ordered(cost, rejected) == ["cheap", "dear", "same", "none"]


def test_rules_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert Q.learned_order(docs) == sorted(Q.RULES)
    assert Q.judged(docs, ["doc_id"], sorted(Q.RULES)).count() == 0


def test_long_texts_have_the_same_repeats(monkeypatch):
    r = random.Random(5)
    words = [r.choice("abcdefgh") + r.choice("xyz") for _ in range(3000)]
    hashed = Q.repeated_words(words)
    monkeypatch.setattr(Q, "LONG", 10)
    assert Q.repeated_words(words) == hashed == figures_brute(" ".join(words))[4]


def band_brute(lines, items):
    usable = []
    for sale, no, item, q, amount in lines:
        if None in (sale, item, q, amount) or q == 0 or not math.isfinite(amount) or abs(100 * amount + 0.5) >= 2**63:
            continue
        a = math.floor(100 * amount + 0.5)
        usable.append(((2 * a + q) // (2 * q), sale, no, item))
    out = Counter()
    for item, price in items:
        ok = item is not None and price is not None and math.isfinite(price) and abs(100 * price + 0.5) < 2**63
        pairs = []
        if ok:
            p = math.floor(100 * price + 0.5)
            for u, sale, no, other in usable:
                if other != item and (abs(u - p) <= 10 or 1000 * abs(u - p) <= 2 * p):
                    pairs.append((abs(u - p), u, sale, -(2**63) if no is None else no, other))
        pairs.sort()
        text = lambda x: ",".join("" if v == -(2**63) else str(v) for v in x[2:])
        sums = (len(pairs), sum(x[0] for x in pairs), sum(zlib.crc32(text(x).encode()) for x in pairs))
        if not pairs:
            out[item, 0, None, None, None, None, None, *sums] += 1
        for k, x in enumerate(pairs[:5]):
            out[item, k + 1, *[None if v == -(2**63) else v for v in x], *sums] += 1
    return out


LINES = "sale_id long, line_no int, item_id long, quantity int, amount double, u string"
ITEMS = "item_id long, price double, p string"


def shop(seed, n=400, hot=True):
    r = random.Random(seed)
    items = [(k, r.choice([3.0, 3.0, 3.05, 5.0, 12.34, 90.0, 91.0, round(r.uniform(1, 400), 2)])) for k in range(40)]
    lines = []
    for k in range(n):
        item, price = items[0] if hot and k % 3 == 0 else r.choice(items)
        q = r.randint(1, 9)
        lines.append((k // 3, k % 4, item, q, round(price * q * r.choice([1, 1, 0.99, 1.002, 1.2]), 2)))
    lines += lines[:30] + [lines[0]] * 20
    broken = [(None, 1, 1, 1, 3.0), (1, None, 2, 1, 3.0), (1, None, 2, 1, 3.0), (1, 1, None, 1, 3.0), (1, 1, 1, None, 3.0), (1, 1, 1, 1, None)]
    broken += [(1, 1, 3, 0, 3.0), (1, 1, 3, 2, float("nan")), (1, 1, 3, 2, float("inf")), (1, 1, 3, 1, 1e300), (1, 1, 3, -2, -6.0), (1, 2, 3, 3, -6.01), (7, 7, 7, 7, 9.0e16)]
    items += [(None, 3.0), (99, None), (98, float("nan")), (97, 1e300), (96, -2.0), (95, 0.0), (95, 0.0), (5, 3.0), (5, 3.0), (5, 90.0), (94, 77777.0), (93, 9.0e16 / 7)]
    return lines + broken, items


@pytest.mark.parametrize("seed", [1, 2])
def test_band_join_is_brute_force(spark, seed):
    lines, items = shop(seed)
    got = B.near_items(spark.createDataFrame([(*x, "c") for x in lines], LINES), spark.createDataFrame([(*x, "c") for x in items], ITEMS))
    names = ("item_id", "rank", "gap", "u", "sale_id", "line_no", "line_item_id", "n_pairs", "gap_sum", "lines_crc")
    assert Counter(tuple(x[c] for c in names) for x in got.collect()) == band_brute(lines, items)


def test_band_join_splits_hot_ranges(spark, monkeypatch):
    """Many small parts and copies in several tasks give what few give."""
    monkeypatch.setattr(B, "RANGES", 9)
    monkeypatch.setattr(B, "PIECES", 9)
    monkeypatch.setattr(B, "COPIES", 2)
    lines, items = shop(4)
    items += [(5, 3.0)] * 5
    got = B.near_items(spark.createDataFrame([(*x, "c") for x in lines], LINES), spark.createDataFrame([(*x, "c") for x in items], ITEMS))
    names = ("item_id", "rank", "gap", "u", "sale_id", "line_no", "line_item_id", "n_pairs", "gap_sum", "lines_crc")
    assert Counter(tuple(x[c] for c in names) for x in got.collect()) == band_brute(lines, items)


def test_band_join_of_empty_tables(spark):
    lines, items = shop(1, 30)
    none, some = spark.createDataFrame([], LINES), spark.createDataFrame([(*x, "c") for x in items], ITEMS)
    got = B.near_items(none, some).collect()
    assert len(got) == len(items) and {(x["rank"], x["n_pairs"], x["gap"]) for x in got} == {(0, 0, None)}
    assert B.near_items(spark.createDataFrame([(*x, "c") for x in lines], LINES), spark.createDataFrame([], ITEMS)).count() == 0


def h(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def tree(leaves):
    """The top, and for each leaf its sides at each level."""
    ways, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        runs = [level[k : k + 8] for k in range(0, len(level), 8)]
        for i, k in enumerate(at):
            run = runs[k // 8]
            ways[i].append(("".join(run[: k % 8]), "".join(run[k % 8 + 1 :])))
            at[i] = k // 8
        level = [h(*run) for run in runs]
    return level[0] if level else None, ways


def merkle_brute(rows, claim):
    leaf = lambda r: h("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in r))
    first = lambda x: (x is not None, x if x is not None else 0)
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((first(r[0]), leaf(r), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    tops = {}
    for g in order:
        groups[g].sort(key=lambda x: x[:2])
        tops[g] = tree([x[1] for x in groups[g]])
    root, ways = tree([tops[g][0] for g in order])
    out = Counter()
    for g, above in zip(order, ways, strict=True):
        for (_, own, r), way in zip(groups[g], tops[g][1], strict=True):
            proof, fold = "", leaf(claim(r))
            for a, b in way + above:
                proof, fold = proof + a + b, h(a, fold, b)
            out[r[0], own, tops[g][0], root, h(proof), fold, fold == root] += 1
    return out


ROWS = "doc_id long, lang string, text string, leaf string, part string"


def merkle_rows(n, seed=1):
    r = random.Random(seed)
    langs = [None, "", "de", "en", "en", "en", "fr", "\u00e9", "z\U0001f600"]
    rows = [(k * 7 % 1009 - 50, r.choice(langs), r.choice(["Abc", "abc", "", None, "\u00c9T\u00c9", "x" * 3000])) for k in range(n)]
    return rows + ([(None, "en", "A"), (None, "en", "A"), (5, "en", "B"), (5, "en", "A"), (5, "en", "A"), (1, "alone", "Q")] if n else [])


@pytest.mark.parametrize(("n", "leaves"), [(0, 50), (1, 50), (9, 50), (700, 50), (700, 7), (700, 100_000)])
def test_merkle_is_brute_force(spark, monkeypatch, n, leaves):
    monkeypatch.setattr(MK, "LEAVES", leaves)
    rows = merkle_rows(n)
    docs = spark.createDataFrame([(*r, "c", "d") for r in rows], ROWS)
    low = lambda t: t and "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    third = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 0
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    claimed = {"text": F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.translate("text", upper, upper.lower())).otherwise(F.col("text"))}
    got = MK.manifest(docs, ["doc_id", "lang", "text"], "lang", "doc_id", claimed)
    names = ("key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    want = merkle_brute(rows, lambda r: (*r[:2], low(r[2]) if third(r[0]) else r[2]))
    assert Counter(tuple(x[c] for c in names) for x in got.collect()) == want
    if n > 100:
        assert {k[-1] for k in want} == {True, False}


def test_merkle_of_many_groups(spark):
    rows = [(k, f"g{k % 900}", "t") for k in range(2000)]
    docs = spark.createDataFrame([(*r, "c", "d") for r in rows], ROWS)
    got = MK.manifest(docs, ["doc_id", "lang", "text"], "lang", "doc_id").collect()
    names = ("key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert Counter(tuple(x[c] for c in names) for x in got) == merkle_brute(rows, lambda r: r)
