"""Corpus operators against brute force, and their edge cases: nulls, empties, ties, repeats, clashing names."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import components as CC
from quern.llm import minhash_dedup as M
from quern.llm import suffix_dedup as S

DOCS = "doc_id long, text string, row string, __id string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, pairs):
    return spark.createDataFrame([(i, t, "r", "c") for i, t in pairs], DOCS)


def corpus(seed=1, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh\u00e9") for _ in range(r.randint(1, 7)))
    passage = " ".join(word() for _ in range(25))
    out = []
    for i in range(n):
        kind = r.random()
        if kind < 0.25 and out:
            text = out[r.randrange(len(out))][1] or ""
            w = text.split(" ")
            if len(w) > 3 and r.random() < 0.7:
                w[r.randrange(len(w))] = word()
            text = " ".join(w)
        else:
            text = " ".join(word() for _ in range(r.randint(0, 60)))
            if kind < 0.5:
                text += " " + passage + " " + word()
        out.append((i * 3 - 20, text))
    return out + [
        (500, None),
        (501, ""),
        (502, "  "),
        (None, passage),
        (None, None),
        (7000, passage),
        (7000, passage),
        (503, "a b"),
        (504, "a b"),
        (505, "x " * 3000 + passage),
    ]


def cut_brute(pairs, t=50):
    ids = sorted({i for i, _ in pairs if i is not None})
    seen = {}
    for i in ids:
        for text in {x or "" for j, x in pairs if j == i}:
            b = text.encode()
            for k in range(len(b) - t + 1):
                seen.setdefault(b[k : k + t], i)
    out = []
    for i, text in pairs:
        b = (text or "").encode()
        gone = [False] * len(b)
        if i is not None:
            for k in range(len(b) - t + 1):
                if seen[b[k : k + t]] < i:
                    gone[k : k + t] = [True] * t
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize(("common", "local"), [(20_000, 16), (1, 16), (20_000, 1)])
def test_suffix_dedup(spark, monkeypatch, common, local):
    monkeypatch.setattr(S, "COMMON", common)
    monkeypatch.setattr(S, "LOCAL", local)
    pairs = corpus()
    got = S.remove_repeats(docs(spark, pairs)).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert Counter(tuple(r) for r in got) == cut_brute(pairs)
    assert S.remove_repeats(docs(spark, [])).count() == 0


def test_a_common_sentence_sends_few_entries(monkeypatch):
    """A sentence among different text in 4,000 documents of a block is one entry for each anchor, in occupied buckets only."""
    import pyarrow as pa

    r = random.Random(4)
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    sentence = text(60)
    texts = [text(80) + sentence + text(80) for _ in range(4000)]
    ids = np.arange(4000)
    table = pa.table({"__id": ids, "__th": ids, "__text": texts, "__block": np.zeros(4000, np.int64)})
    sent = S._first_digit(table, 50, 1 << 40)
    most = Counter()
    for cell in sent["__cell"].to_pylist():
        g, _, _, _, common, low, high = S.unpack(cell)
        most.update(g.tolist())
        most.update(common.tolist())
        assert all(low < high)
    assert max(most.values()) <= S.LOCAL and sent.num_rows <= len(most)
    answers = S._settle_first(pa.concat_tables([sent.set_column(1, "__bucket", pa.array(np.zeros(len(sent), np.int64)))]))
    assert answers.num_rows > 0
    # of two windows at most anchors of the sentence are common, and they are asked about one by one
    block = S._Block(table, S._Depth(50), 8)
    assert len(block.common) and (block.most > block.least).all()


def test_pieces_of_sorted_places():
    got = lambda *k: list(S._pieces(np.array(k, np.int64)))
    assert got() == [] and got(4) == [(4, 0, 1)] and got(1, 1, 5, 7, 7) == [(1, 0, 2), (5, 2, 3), (7, 3, 5)]


def test_packed_arrays_come_back():
    from quern.llm.packing import pack, unpack

    r = np.random.RandomState(0)
    for n in (0, 1, 47, 48, 49, 5000):
        arrays = [r.randint(0, 9, n).astype(k) for k in (np.uint8, np.int32, np.uint64)] + [r.randint(-(2**62), 2**62, n)]
        got = unpack(pack(*arrays))
        assert [x.dtype for x in got] == [x.dtype for x in arrays] and all(map(np.array_equal, got, arrays))


def test_what_a_block_sends_costs_by_its_anchors(monkeypatch):
    """A larger corpus has more buckets, so a block's cells get more and smaller; no cell pays for planes then."""
    import pyarrow as pa

    from quern.llm import packing

    calls, plain = [], packing.zlib.compress
    monkeypatch.setattr(packing.zlib, "compress", lambda *a: calls.append(1) or plain(*a))
    r = random.Random(3)
    text = ["".join(r.choice("abcdefghij ") for _ in range(2000)) for _ in range(100)]
    table = pa.table({"__block": [0] * 100, "__id": list(range(100)), "__th": list(range(100)), "__text": text})
    sent = []
    for buckets in (8, 200):
        calls.clear()
        cells = [packing.unpack(x.as_py()) for x in S._first_digit(table, 50, buckets)["__cell"]]
        sent.append((np.concatenate([x[0] for x in cells]).tolist(), len(calls)))
    assert sent[0][0] == sent[1][0] and len(sent[0][0]) > 200 * packing.FEW
    assert sent[1][1] <= sent[0][1]


def test_packed_numbers_of_every_range_come_back():
    from quern.llm.packing import SOME, pack, unpack

    r = np.random.default_rng(2)
    for n in (49, 113, SOME, SOME + 1):
        for kind in (np.uint8, np.uint32, np.int64, np.uint64):
            top = np.iinfo(kind)
            for low, high in ((top.min, top.max), (top.max - 200, top.max), (top.min, top.min + 7), (5, 5)):
                a = r.integers(low, high, n, kind, endpoint=True)
                a[:2] = low, high
                (got,) = unpack(pack(a))
                assert got.dtype == a.dtype and np.array_equal(got, a)


def test_suffix_dedup_of_one_id_in_many_blocks(spark):
    """Rows that share an id, equal or not, lie in several blocks and still do not cut each other."""
    r = random.Random(8)
    text = lambda n: "".join(r.choice("abcdef ") for _ in range(n))
    shared, own = text(120), text(90)
    pairs = [(5, text(r.randint(0, 40)) + shared + text(9)) for _ in range(30)] + [(5, own)] * 20 + [(9, own), (9, text(20) + shared), (2, own[:60])]
    table = docs(spark, pairs).repartition(7)
    got = S.remove_repeats(table, with_text=False).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert Counter(tuple(x) for x in got) == cut_brute(pairs)


def sets_brute(pairs):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    out = {}
    for i, t in pairs:
        w = WORD.findall((t or "").translate(low))
        out.setdefault(i, []).append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def components_brute(pairs):
    sets = sets_brute([p for p in pairs if p[0] is not None])
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if b < a and any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize(("block", "weight", "one_task"), [(2048, 4_000_000, 300_000), (4, 40, 0)])
def test_near_duplicates(spark, monkeypatch, block, weight, one_task):
    for k, v in {"BLOCK": block, "WEIGHT": weight, "PIVOTS": 2, "LEVELS": 2}.items():
        monkeypatch.setattr(M, k, v)
    monkeypatch.setattr(CC, "ONE_TASK", one_task)
    pairs = corpus(3)
    got = M.near_duplicates(docs(spark, pairs)).collect()
    want = components_brute(pairs)
    assert len(got) == len(pairs)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert M.near_duplicates(docs(spark, [])).count() == 0


@pytest.mark.parametrize("block", [2048, 40])
def test_near_duplicate_recall(spark, monkeypatch, block):
    """Pairs at 0.75 to 0.8 among documents that share most of a passage: with small blocks their nodes branch."""
    monkeypatch.setattr(M, "BLOCK", block)
    r = random.Random(6)
    fresh = lambda n: [f"w{r.randrange(10**7)}" for _ in range(n)]
    passage, pairs = fresh(60), []
    for i in range(150):
        words = passage + fresh(40)
        at = r.randrange(62, 88)
        pairs += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:at] + fresh(8 + i % 2) + words[at + 8 + i % 2 :]))]
    sets = sets_brute(pairs)
    alike = [len(sets[2 * i][0] & sets[2 * i + 1][0]) / len(sets[2 * i][0] | sets[2 * i + 1][0]) for i in range(150)]
    assert 0.75 <= min(alike) and max(alike) < 0.8
    got = {x.doc_id: x.component_id for x in M.near_duplicates(docs(spark, pairs)).collect()}
    assert all(got[2 * i] == 2 * i for i in range(150))
    assert sum(got[2 * i + 1] == 2 * i for i in range(150)) / 150 >= 0.99


def test_levels_ask_only_for_what_is_left(spark, monkeypatch):
    """Below the roots no step reads the documents again that no large node has."""
    from quern.llm.scratch import Scratch

    monkeypatch.setattr(M, "BLOCK", 40)
    dealt, plain = [], Scratch.dealt

    def counted(self, df, *more):
        out = plain(self, df, *more)
        dealt.append(out.count())
        return out

    monkeypatch.setattr(Scratch, "dealt", counted)
    r = random.Random(9)
    fresh = lambda n: [f"w{r.randrange(10**7)}" for _ in range(n)]
    passage, pairs = fresh(60), []
    for i in range(300):
        words = (passage if i < 60 else []) + fresh(40)
        pairs += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:-1], "x"]))]
    got = {x.doc_id: x.component_id for x in M.near_duplicates(docs(spark, pairs)).collect()}
    assert all(got[i] == i // 2 * 2 for i in range(600))
    assert dealt[0] == 600 and dealt[-1] <= 120


def test_small_nodes_share_a_call():
    """Nodes of one call stay apart: what may link, and what links, is that of each node."""
    import pyarrow as pa

    r = np.random.RandomState(4)
    words = [[f"w{x}" for x in r.randint(0, 10**6, 40)] for _ in range(12)]
    rows = []
    for key, size in enumerate([2, 3, 5, 64, 65, 150]):
        for i in range(size):
            w = list(words[r.randint(len(words))])
            at = r.randint(0, 36)
            w[at : at + 1 + key % 3] = [f"x{r.randint(10**6)}" for _ in range(1 + r.randint(4))]
            rows.append((key, i + 1000 * (key % 2), int(r.randint(0, size)), int(key > 2 and r.rand() < 0.3), " ".join(w)))
    key, ids, label, side, text = zip(*rows, strict=True)
    marks = pa.Table.from_batches(M._sketches(iter([pa.record_batch({"id": pa.array(ids), "text": pa.array(text)})])))
    table = pa.table({"key": key, "id": ids, "label": label, "side": pa.array(side, pa.int32()), "n": marks["n"], "sketch": marks["sketch"]})
    sketch = np.array(marks["sketch"].to_pylist())
    n, sets, some, links = marks["n"].to_pylist(), [x[0] for x in sets_brute(list(enumerate(text))).values()], set(), {}
    find = lambda up, x: x if up[x] == x else find(up, up[x])
    forests = {k: {x: x for x in set(label)} for k in set(key)}
    for a, b in itertools.combinations(range(len(rows)), 2):
        if key[a] != key[b] or label[a] == label[b] or (side[a] and side[b]) or 100 * min(n[a], n[b]) < 75 * max(n[a], n[b]):
            continue
        if (sketch[a] == sketch[b]).sum() >= M.AGREE:
            some |= {a, b}
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                up = forests[key[a]]
                x, y = find(up, label[a]), find(up, label[b])
                up[max(x, y)] = min(x, y)
                links.setdefault(key[a], set()).add(frozenset((ids[a], ids[b])))
    got = M._promising(table)
    assert Counter(zip(got["id"].to_pylist(), got["label"].to_pylist(), strict=True)) == Counter((ids[i], label[i]) for i in some)
    assert len(set(got["task"].to_pylist())) == len({key[i] for i in some}) and links
    named = table.append_column("text", pa.array(text)).drop(["n"]).rename_columns(["task", "id", "label", "side", "sketch", "text"])
    found = M._links(named)
    edges = [frozenset(e) for e in zip(found["a"].to_pylist(), found["b"].to_pylist(), strict=True)]
    assert all(any(e in x for x in links.values()) for e in edges)
    # a forest of each node's labels: as many links as join them
    assert len(edges) == sum(len(up) - len({find(up, x) for x in up}) for up in forests.values())


def test_an_id_with_two_texts_ties_its_links(spark):
    a, b = "a b c d e f g h", "k l m n o p q r"
    pairs = [(1, a), (2, a), (2, b), (3, b), (None, a)]
    got = M.near_duplicates(docs(spark, pairs)).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(1, 1, True), (2, 1, False), (3, 1, False), (None, None, True)}


def test_components_both_ways(spark, monkeypatch, tmp_path):
    r = random.Random(5)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 140)]
    from quern.llm.scratch import Scratch

    df = spark.createDataFrame(edges, "a long, b long")
    monkeypatch.setattr(CC, "ONE_TASK", 0)
    slow = {tuple(x) for x in CC.components(df, Scratch(spark)).collect()}
    monkeypatch.setattr(CC, "ONE_TASK", 1000)
    fast = {tuple(x) for x in CC.components(df, Scratch(spark)).collect()}
    assert slow == fast and (140, 100) in fast


def test_decontamination(spark):
    from quern.llm.decontaminate import leaks

    r = random.Random(2)
    w = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    items = [(1, " ".join(w(30))), (2, " ".join(w(14))), (3, "One two three"), (4, None), (5, "")]
    a, b = items[0][1].split(), items[1][1].split()
    sub = a[:]
    sub[4] = sub[11] = sub[20] = "zz"
    broken = [x if k % 2 else "q" for k, x in enumerate(a)]
    rows = [
        (10, " ".join(w(7) + a + w(5))),
        (11, " ".join(w(3) + sub)),
        (12, ", ".join(b).upper()),
        (13, " ".join(w(50))),
        (14, " ".join(broken)),
        (15, None),
        (16, ""),
        (17, "x one TWO three"),
        (18, " ".join(a[:12])),
        (19, " ".join(a[:13] + w(9))),
        (20, " ".join(["k"] * 200 + a)),
        (10, " ".join(w(7) + a)),
    ]
    got = {(x.doc_id, x.item_id) for x in leaks(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(10, 1), (11, 1), (12, 2), (17, 3), (18, 1), (19, 1), (20, 1)}
    assert leaks(docs(spark, []), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert leaks(docs(spark, rows), spark.createDataFrame([], "item_id long, text string")).count() == 0


def leaks_brute(rows, items):
    """(doc, item) pairs by comparing the words of every item along every diagonal."""
    out = set()
    for j, t in rows:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        for i, u in items:
            b = re.findall(r"[^\W_]+", (u or "").lower())
            run = min(13, len(b))
            for d in range(-len(b), len(w) + 1) if b else ():
                e = [0 <= d + q < len(w) and w[d + q] == b[q] for q in range(len(b))]
                if max(sum(e[q : q + run]) for q in range(len(b) - run + 1)) * 13 >= 10 * run:
                    out.add((j, i))
                    break
    return out


def leak_cases(lengths, seed):
    """Items of the given lengths; documents hold parts of them, with substitutions, at even and odd words."""
    r = random.Random(seed)
    w = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    items = [(i, " ".join(w(n))) for i, n in enumerate(lengths)]
    rows = []
    for _, text in items:
        b = text.split()
        for before in (0, 1, 4, 7):
            for subs in range(5):
                part = b[:]
                for k in r.sample(range(len(b)), min(subs, len(b))):
                    part[k] = "zz"
                cut = r.choice([0, 0, 1, 2])
                rows.append((len(rows), " ".join(w(before) + part[cut:] + w(r.choice([0, 3])))))
    return rows, items


@pytest.mark.parametrize("shuffled", [False, True])
def test_decontamination_recall(spark, monkeypatch, shuffled):
    """Any substitution pattern that the rule accepts is found, at both parities, with seeds broadcast or shuffled."""
    from quern.llm import decontaminate as D
    from quern.llm.decontaminate import leaks

    rows, items = leak_cases([9, 10, 11, 12, 13, 13, 14, 15, 18, 30], 3)
    # every pattern of three substitutions in 13 words, behind one word
    b = items[4][1].split()
    for bad in itertools.combinations(range(13), 3):
        rows.append((len(rows), "k " + " ".join("zz" if k in bad else x for k, x in enumerate(b))))
    want = leaks_brute(rows, items)
    assert len(want) > 350
    if shuffled:
        monkeypatch.setattr(D, "BROADCAST_SEEDS", 0)
    assert {
        (x.doc_id, x.item_id) for x in leaks(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    } == want


def test_masks_leave_places_out():
    from quern.llm import decontaminate as D

    for n, (family, least) in D.MASKS_OF.items():
        assert least > 0
        for mask in family:
            assert len(mask) < mask[-1] + 1 or n < 3
    assert all(len(mask) == 4 for mask in D.MASKS_OF[13][0])


def test_decontamination_of_short_items(spark):
    """Items and documents of few words: any word that the rule tolerates may be substituted or cut off."""
    from quern.llm.decontaminate import leaks

    rows, items = leak_cases([1, 2, 3, 4, 5, 6, 7, 8, 8, 9], 5)
    for _, text in items:
        b = text.split()
        for k in range(len(b)):
            rows.append((len(rows), " ".join(b[:k] + ["zz"] + b[k + 1 :])))
            rows.append((len(rows), " ".join(b[k:])))
            rows.append((len(rows), " ".join(b[: k + 1])))
    rows += [(len(rows) + i, t) for i, t in enumerate((None, "", "k", "k k"))]
    want = leaks_brute(rows, items)
    assert {i for _, i in want} == set(range(10))
    for some in (items, items[:1], items[4:5], items[8:]):
        ids = {i for i, _ in some}
        got = {(x.doc_id, x.item_id) for x in leaks(docs(spark, rows), spark.createDataFrame(some, "item_id long, text string")).collect()}
        assert got == {x for x in want if x[1] in ids}


def test_url_rules(spark):
    from quern.llm.queries import RULES
    from quern.llm.url_filter import url_verdicts

    cases = {
        "http://A.B.NET/x?q": ("a.b.net", "/x", "net/", "block"),
        "https://example.net/en/1#t": ("example.net", "/en/1", "example.net/en/", "allow"),
        "https://example.net/enx": ("example.net", "/enx", "net/", "block"),
        "x://www.example.com/de/": ("www.example.com", "/de/", "example.com/de/", "block"),
        "x://badexample.com/de/": ("badexample.com", "/de/", None, "allow"),
        "x://a.org/fr/?": ("a.org", "/fr/", "org/fr/", "allow"),
        "x://net": ("net", "", None, "allow"),
        "no scheme.net/": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "://": ("", "", None, "allow"),
        "a://b.net/c://d.org/fr/": ("b.net", "/c://d.org/fr/", "net/", "block"),
    }
    rows = [(i, u, "x") for i, u in enumerate(cases)] + [(0, next(iter(cases)), "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = url_verdicts(pages, rules).collect()
    assert len(got) == len(rows)
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == dict(enumerate(cases.values()))
    assert url_verdicts(pages.limit(0), rules).count() == 0 and {
        r.verdict for r in url_verdicts(pages, rules.limit(0)).collect()
    } == {"allow"}


def test_token_rollup(spark, tmp_path):
    from quern.llm.token_counts import Rollup, deltas, signed

    schema = "op string, source string, lang string, text string, old_source string, old_lang string, old_text string, tokens long"
    batch = lambda rows: deltas(signed(spark.createDataFrame([(*r, 5) for r in rows], schema)), ("words-1",))
    rollup = Rollup(spark, str(tmp_path))
    assert rollup.totals().count() == 0
    first = batch(
        [
            ("insert", "a", "en", "one two", None, None, None),
            ("insert", "a", "en", None, None, None, None),
            ("insert", None, "de", "x", None, None, None),
        ]
    )
    assert rollup.commit("b1", first) and not rollup.commit("b1", first)
    rollup.commit(
        "b2",
        batch([("revise", "a", "en", "one two three", "a", "en", "one two"), ("delete", None, "de", "x", None, None, None)]),
    )
    want = [("a", "en", "words-1", 2, 3, 13)]
    assert [tuple(r) for r in rollup.totals().collect()] == want
    for _ in range(3):
        assert rollup.compact()
        assert [tuple(r) for r in rollup.totals().collect()] == want and not rollup.commit("b1", first)
    rollup.commit("b3", batch([]))
    assert [tuple(r) for r in rollup.totals().collect()] == want
    assert len(list((tmp_path / "data").iterdir())) <= 5


def test_token_rollup_survives_a_loss_at_every_step(spark, tmp_path, monkeypatch):
    """Every file operation in turn fails; a new writer runs the same batches again and gets the same totals."""
    from quern.llm.token_counts import Rollup, deltas, signed

    class Lost(Exception):
        pass

    rows = [("insert", "a", "en", "one two"), ("insert", "b", "en", "x")]
    first = deltas(signed(spark.createDataFrame(rows, "op string, source string, lang string, text string")), ("words-1",)).cache()
    more = first.where("source = 'a'")
    steps = ("_write", "_publish", "vacuum", "manifest")
    plain = {name: getattr(Rollup, name) for name in steps}
    for n in itertools.count():
        done = 0

        def lose(name, after, n=n):
            def run(self, *args):
                nonlocal done
                out = plain[name](self, *args) if after else None
                done += 1
                if done - 1 == n:
                    raise Lost
                return out if after else plain[name](self, *args)

            return run

        work = lambda r: (r.commit("b1", first), r.commit("b2", more), r.compact())
        for after in (False, True):
            folder, done = str(tmp_path / f"{n}-{after}"), 0
            for name in steps:
                monkeypatch.setattr(Rollup, name, lose(name, after))
            try:
                work(Rollup(spark, folder))
                ended = True
            except Lost:
                ended = False
            for name in steps:
                monkeypatch.setattr(Rollup, name, plain[name])
            again = Rollup(spark, folder)
            work(again)
            assert {tuple(r) for r in again.totals().collect()} == {("a", "en", "words-1", 2, 4, 14), ("b", "en", "words-1", 1, 1, 1)}
        if ended:
            break
    assert n > 8


def test_two_writers_of_one_version(spark, tmp_path):
    from quern.llm.token_counts import Rollup

    one, two = Rollup(spark, str(tmp_path)), Rollup(spark, str(tmp_path))
    manifest = {"version": 1, "tables": [], "batches": ["x"], "held": None}
    assert one._publish(manifest) and not two._publish(manifest | {"batches": ["y"]})
    assert two.manifest()["batches"] == ["x"]


def named_model():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_token_counts_of_documents(spark):
    from conftest import SF

    from quern.llm.queries import op5_token_counts

    got = {(r.source, r.lang, r.tokenizer): (r.documents, r.tokens, r.bytes) for r in op5_token_counts(spark, SF).collect()}
    model, want = named_model(), {}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        label, text, source = labels.get(r.doc_id), r.text, r.source
        if label and label.toxic == 1:
            continue
        if label and label.quality == 0:
            text, source = text.strip(" "), "low"
        for version, n in (
            ("byte_bpe_50k.tiktoken", len(model.encode(text, add_special_tokens=False).ids)),
            ("words-1", len(WORD.findall(text))),
        ):
            x = want.setdefault((source, r.lang, version), [0, 0, 0])
            x[0] += 1
            x[1] += n
            x[2] += len(text.encode())
    assert got == {k: tuple(v) for k, v in want.items()}


SPACES = " \n\t\r\x0b\x0c\x1c\x1f\x85\xa0\u1680\u2003\u2028\u3000\u180e\u200b"


def test_ids_equal_those_of_the_named_tokenizer(monkeypatch):
    from quern.llm import tokens

    model, r = named_model(), random.Random(1)
    texts = [
        "",
        " ",
        "  a  b\n\n c",
        "don't 's  'll",
        "<|endoftext|> x",
        "a <|endoftext|> b",
        "a  <|endoftext|><|endoftext|>",
        "<|endoftext",
        "\u3000\u00a0\u00e9\u0301 \u00df\u65e5\u672c",
        "\t\r\n",
        "a" * 5000,
        "0123456789" * 50,
        "\x00\x1f\U0001f642",
        "A,B;c--!!?",
    ]
    letters = list(SPACES * 2 + "abcXYZ'stremlvd0123.,!?<|>\u00e9\u65e5\u00df\U0001f642\u00bd")
    for _ in range(500):
        texts.append("".join(r.choice(letters) for _ in range(r.randint(0, 80))))
        texts.append(texts[-1][:9] + "<|endoftext|>" + texts[-1][9:])
    for run in (20_000, 3):  # the second cuts at every run of three
        monkeypatch.setattr(tokens, "RUN", run)
        monkeypatch.setattr(tokens, "_RUNS", re.compile(tokens._RUNS.pattern.replace("20000", str(run)).replace("{3,}", f"{{{run},}}")))
        ids = tokens.Ids(tokens.vocabulary())
        for t in texts:
            want = model.encode(t, add_special_tokens=False).ids
            assert ids(t).tolist() == want and ids.count(t) == len(want)


@pytest.mark.parametrize("unit", [" ", "\n", " \n", "a", "1", "!", "\u4e2d", "\xa0"])
def test_ids_of_very_long_texts(unit):
    from quern.llm.tokens import ids_of

    text = "x y" + unit * (5_000_000 // len(unit.encode())) + "end"
    assert ids_of()(text).tolist() == named_model().encode(text, add_special_tokens=False).ids


def test_very_long_texts(spark):
    """Runs of one character of a million and more go through counting, packing, scoring and language."""
    from quern.llm.language import fit, identified
    from quern.llm.packing_bins import pack_sequences
    from quern.llm.token_counts import deltas, signed
    from quern.llm.toxicity import fit as learn
    from quern.llm.toxicity import scored

    rows = [(1, " " * 1_000_000), (2, "a" * 1_000_000), (3, "scum " * 200_000), (4, "\n" * 2_000_000 + "x")]
    table, model = docs(spark, rows), named_model()
    counts = {i: len(model.encode(t, add_special_tokens=False).ids) for i, t in rows}
    batch = table.select(F.lit("insert").alias("op"), F.col("doc_id").cast("string").alias("source"), F.lit("en").alias("lang"), "text")
    assert {int(r.source): r.tokens for r in deltas(signed(batch), ("byte_bpe_50k.tiktoken",)).collect()} == counts
    assert {
        r[0]: r[1] for r in pack_sequences(table).groupBy("doc_id").agg(F.sum("length")).collect()
    } == {i: n + 1 for i, n in counts.items()}
    train = spark.createDataFrame(
        [(i, "you scum" if i % 2 else "fine words", "en", i % 2) for i in range(40)],
        "doc_id long, text string, lang string, toxic int",
    )
    assert {r.row.doc_id: r.predicted for r in scored(table, learn(train, train)).collect()}[3] == 1
    assert {r.doc_id: r.lang_pred for r in identified(table, fit(train)).collect()} == {1: "und", 2: "en", 3: "en", 4: "en"}


def toxicity_brute(rows, examples, own=False, calibrated=lambda x: x):
    """Scores by all cosines, from the definitions; ``examples``: (id, label, text) of one label rate."""
    import math

    from quern.llm import toxicity as T

    words = lambda t: Counter(re.findall(r"[^\W\d_]+", (t or "").lower()))
    held = [(i, y, words(t)) for i, y, t in examples]
    n, rate = len(held), sum(y for _, y, _ in held) / len(held)
    weight = {}
    for t in {t for _, _, c in held for t in c}:
        clean = sum(t in c for _, y, c in held if not y)
        weight[t] = max(math.log((1 + n) / (1 + clean)), 1e-3) ** T.SHARP

    def vector(c):
        v = {t: (1 + math.log(k)) * weight[t] for t, k in c.items() if t in weight}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / size for t, x in v.items()}

    vectors = [(i, y, vector(c)) for i, y, c in held if c]
    none = [y for _, y, c in held if not c]
    out = []
    for doc, text in rows:
        q = vector(words(text))
        if not q:
            out.append((sum(none) + rate) / (len(none) + 1))
            continue
        near = sorted(((sum(x * v.get(t, 0) for t, x in q.items()), y) for i, y, v in vectors if not (own and i == doc)), reverse=True)
        near = [x for x in near if x[0] > 0 and x[0] >= near[min(T.K, len(near)) - 1][0] - 1e-12]
        vote = [(1 / (max(0, 1 - c) + T.NEAR), y) for c, y in near]
        some = T.PRIOR / (1 + T.NEAR)
        out.append(calibrated((sum(v for v, y in vote if y) + some * rate) / (sum(v for v, _ in vote) + some)))
    return out


@pytest.mark.parametrize("own", [False, True])
@pytest.mark.parametrize("block", [64, 3])
def test_toxicity_is_exact(spark, monkeypatch, block, own):
    """The whole operator, choice of terms included, against all cosines."""
    from quern.llm import toxicity as T

    monkeypatch.setattr(T, "BLOCK", block)
    r = random.Random(4)
    word = lambda bad: r.choice(["scum", "trash", "Idiot"]) if bad and r.random() < 0.4 else f"t{chr(97 + int(r.random() ** 2 * 26))}{r.choice('xy')}"
    examples = [(i, y := r.randrange(4) // 3, " ".join(word(y) for _ in range(r.randint(0, 9)))) for i in range(250)]
    examples += [(i, 0, None if i % 2 else "1 2 3") for i in range(300, 306)]
    rows = [(i, t) for i, _, t in examples[::3]] + [
        (1000 + i, " ".join(word(i % 3 == 0) for _ in range(r.randint(0, 12)))) for i in range(60)
    ] + [(None, "scum tax"), (7, None), (8, ""), (9, "zzz")]
    table = spark.createDataFrame([(i, t, y) for i, y, t in examples], "doc_id long, text string, toxic int").repartition(3)
    index = T.fit(table, table)
    assert (index.slope, index.shift) != (1.0, 0.0)
    got = {(x.row.doc_id, x.row.text): x.score for x in T.scored(docs(spark, rows), index, leave_own=own).collect()}
    want = dict(zip(rows, toxicity_brute(rows, examples, own, index.calibrated), strict=True))
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-9


def test_toxicity_sample(spark, monkeypatch):
    """The sample is bounded by rows of a label and by words; ids that repeat are one example; shares keep the rate."""
    from quern.llm import toxicity as T

    rows = [(i, "you scum there" if i % 5 == 0 else f"fine words a{'bcdefgh'[i % 7]}", int(i % 5 == 0)) for i in range(500)]
    table = spark.createDataFrame(rows + rows[:5] * 200, "doc_id long, text string, toxic int")
    index = T.fit(table, table, examples=50)
    assert len(index.ids) == 100 and len(set(index.ids.tolist())) == 100 and abs(index.rate - 0.2) < 1e-9
    monkeypatch.setattr(T, "POSTINGS", 60)
    assert len(T.fit(table, table).w) <= 60
    long = spark.createDataFrame([(1, " ".join(f"w{c}{d}" for c in "abcdefgh" for d in "abcdef"), 1), (2, "few words", 1), (3, "other words", 1)], table.schema)
    assert sorted(T.fit(long, long).ids.tolist()) == [2, 3]
    both = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, None)], "doc_id long, toxic int")
    text = spark.createDataFrame([(1, "a"), (2, "b"), (1, "c")], "doc_id long, text string")
    index = T.fit(text, both)
    assert sorted(zip(index.ids.tolist(), index.label.tolist(), strict=True)) == [(1, 1), (2, 0)]


def test_toxicity_edges(spark):
    from quern.llm.toxicity import fit, scored

    rows = [(i, "fine words here" if i % 3 else "you scum there", i % 3 == 0) for i in range(90)]
    labelled = spark.createDataFrame([(i, t, int(x)) for i, t, x in rows] + [(900, "scum", None)], "doc_id long, text string, toxic int")
    out = scored(
        docs(spark, [(1, "SCUM!"), (2, "nice"), (3, None), (4, ""), (1, "SCUM!"), (None, "scum " * 4000)]),
        fit(labelled, labelled),
    )
    got = Counter((r.row.doc_id, r.predicted) for r in out.collect())
    assert got == {(1, 1): 2, (2, 0): 1, (3, 0): 1, (4, 0): 1, (None, 1): 1}
    assert all(r.score == 0 for r in scored(docs(spark, [(1, "a"), (2, None)]), fit(labelled, labelled.limit(0))).collect())


def test_toxicity_is_reliable(spark):
    """Held-out documents are as often toxic as their scores say; few toxic ones are missed and no clean one is called toxic."""
    from quern.llm.queries import held_out
    from quern.llm.toxicity import fit, scored

    sf = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic").where("toxic is not null")
    index = fit(table, labels.where(~held_out(F.col("doc_id"))))
    asked = table.join(labels.where(held_out(F.col("doc_id"))), "doc_id")
    got = np.array([(r.score, r.row.toxic) for r in scored(asked, index).collect()])
    score, toxic = got[:, 0], got[:, 1]
    for low, high in ((0, 0.1), (0.1, 0.5), (0.5, 1.01)):
        inside = (score >= low) & (score < high)
        assert inside.sum() > 20 and abs(score[inside].mean() - toxic[inside].mean()) < 0.2
    assert abs(score.mean() - toxic.mean()) < 0.03
    called = score >= 0.5
    assert toxic[called].mean() > 0.97 and called[toxic == 1].mean() > 0.9


def test_held_out_accuracy(spark):
    from quern.llm.queries import op6_toxicity, op7_language_id

    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    tox = op6_toxicity(spark, sf).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in tox) / len(tox) > 0.9
    lang = op7_language_id(spark, sf).join(
        spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"),
        "doc_id",
    ).where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in lang) / len(lang) > 0.97


def languages_brute(train, rows):
    """Predictions by exact sets of the most frequent n-grams, from the definitions."""
    from quern.llm import language as L

    fold = lambda t: bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in t.encode())
    grams = lambda t, n: [t[i : i + n] for i in range(len(t) - n + 1)]
    top = {}
    for lang in sorted({x for _, x in train}):
        texts = [fold(t) + b" " for t, x in train if x == lang]
        top[lang] = {n: {g for g, _ in Counter(g for t in texts for g in grams(t, n)).most_common(L.TOP)} for n in L.LENGTHS}
    out = []
    for t in rows:
        text = fold(t)
        hits = {x: sum(g in known for n, known in top[x].items() for g in grams(text, n)) for x in top}
        out.append((max(hits, key=lambda x: (hits[x], x)), max(hits.values()) / max(1, sum(hits.values()))))
    return out


def test_languages_against_exact_sets(spark):
    from conftest import SF

    from quern.llm.language import fit, identified
    from quern.llm.queries import held_out

    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    train = [(r.text, r.lang) for r in table.where(~held_out(F.col("doc_id"))).collect() if r.lang is not None and r.text is not None]
    rows = [r for r in table.collect() if r.text and any(c.isalpha() for c in r.text)]
    got = {r.doc_id: r for r in identified(table, fit(table.where(~held_out(F.col("doc_id"))))).collect()}
    want = languages_brute(train, [r.text for r in rows])
    same = [got[r.doc_id].lang_pred == lang for r, (lang, _) in zip(rows, want, strict=True)]
    assert sum(same) / len(same) >= 0.99
    assert sum(abs(got[r.doc_id].score - score) < 0.03 for r, (_, score) in zip(rows, want, strict=True)) / len(rows) >= 0.97


def test_language_sample_is_bounded(spark):
    """Rows without an id, and rows that repeat, are sampled like all others."""
    from quern.llm import language as L

    rows = [
        (None, f"word{i} aaa", "en") for i in range(300)
    ] + [(1, "same text", "en")] * 300 + [(i, f"wort{i} bbb", "de") for i in range(5)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(L.fit(table, sample=20).langs) == ["de", "en"]
    seen = {}
    real = L.Filters
    try:
        L.Filters = lambda grams, common: seen.update(grams) or real(grams, common)
        L.fit(table, sample=20)
    finally:
        L.Filters = real
    # twenty texts of twelve bytes at most have no more n-grams than this
    assert len(seen["en"]) <= 20 * 13 * 3


@pytest.mark.parametrize("n", [1_500, 20_000])
def test_any_number_of_languages(spark, n):
    """Values of the language column cost bounded memory; those with most documents are learned."""
    from quern.llm import language as L

    rows = [(k, f"t{k % 7} words of {chr(97 + k % 26) * 4}", f"l{k:05d}") for k in range(n)]
    rows += [(n + k, "der die und das nicht", "de") for k in range(5)] + [(n + 9 + k, "the and of that with", "en") for k in range(9)]
    filters = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(filters.langs) == L.LANGS and filters.common == "en" and {"de", "en"} <= set(filters.langs)
    asked = spark.createDataFrame([(1, "the and of that"), (2, "und das nicht"), (3, None)], "doc_id long, text string")
    assert [r.lang_pred for r in L.identified(asked, filters).orderBy("doc_id").collect()] == ["en", "de", "und"]


def test_language_edges(spark):
    from quern.llm.language import Filters, fit, identified

    train = spark.createDataFrame(
        [
            (i, "the weather and the rivers", "en") if i % 2 else (i, "der die das und über", "de") for i in range(40)
        ] + [(99, None, "fr"), (98, "x", None)],
        "doc_id long, text string, lang string",
    )
    filters = fit(train)
    rows = [(1, "The rivers"), (2, "über das"), (3, None), (4, ""), (5, "123 !?"), (6, "日本"), (None, "the the"), (1, "The rivers")]
    got = [(r.doc_id, r.lang_pred) for r in identified(docs(spark, rows), filters).collect()]
    assert Counter(got) == Counter([(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (6, filters.common), (None, "en"), (1, "en")])
    assert {r.lang_pred for r in identified(docs(spark, rows), fit(train.limit(0))).collect()} == {"und"}
    many = Filters({f"l{i:02}": np.array([i * 7919 + 1], np.uint64) for i in range(20)}, "l00")
    assert len(many.slices) == 3


def vectors_brute(rows):
    n = len(rows)
    ok = [v is not None and len(v) and lab is not None and i is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) for i, v, lab in rows]
    links, up = [0] * n, list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(rows[k][1], np.longdouble) for k in (i, j))
                if a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= 0.98:
                    links[i] += 1
                    links[j] += 1
                    x, y = find(i), find(j)
                    if x != y:
                        up[x] = y
    groups = {}
    for i in range(n):
        groups.setdefault(find(i), []).append(rows[i][0])
    return sorted(
        (
            rows[i][0] if rows[i][0] is not None else -9,
            links[i],
            min((x for x in groups[find(i)] if x is not None), default=-9),
        ) for i in range(n)
    )


@pytest.mark.parametrize("tile", [16 << 20, 320])
def test_embeddings(spark, monkeypatch, tile):
    from quern.llm import embedding_dedup as E

    monkeypatch.setattr(E, "TILE", tile)
    monkeypatch.setattr(E, "LEAF", 3)
    r = np.random.RandomState(0)
    base = r.randn(12, 8)
    rows = [(int(i), (base[r.randint(12)] + r.randn(8) * 0.12).tolist(), int(r.randint(3))) for i in r.permutation(120)]
    rows += [(200 + k, rows[0][1], rows[0][2]) for k in range(4)]
    rows += [
        (300, None, 1),
        (301, [0.0] * 8, 1),
        (302, [float("nan")] * 8, 1),
        (303, [None] + [1.0] * 7, 1),
        (304, rows[1][1], None),
        (305, [], 1),
        (306, rows[2][1][:4], rows[2][2]),
        (307, [2 * x for x in rows[3][1]], rows[3][2]),
        (None, rows[0][1], rows[0][2]),
    ]
    rows += [(400 + k, [x * 10.0 ** (200 - 100 * k) for x in rows[4][1]], rows[4][2]) for k in range(5)]
    rows += [(410, [1e308] * 8, 1), (411, [5e-324] * 8, 1), (412, [1.0] * 8, 1), (413, [-1.0] * 8, 1)]
    df = spark.createDataFrame(
        rows,
        "vec_id long, embedding array<double>, label int",
    ).withColumn("id", F.lit("clash")).withColumn("d", F.lit(1))
    got = sorted(
        (
            x.vec_id if x.vec_id is not None else -9,
            x.n_links,
            x.component_id if x.component_id is not None else -9,
        ) for x in E.near_vectors(df).collect()
    )
    assert got == vectors_brute(rows)
    assert E.near_vectors(df.limit(0)).count() == 0


def test_sharding_is_minimal(spark, monkeypatch):
    from quern.llm import sharding as H

    monkeypatch.setattr(H, "FIRST_BITS", 3)
    monkeypatch.setattr(H, "CELL_ROWS", 5)
    r = random.Random(1)
    rows = [
        (i, "x" * r.randrange(200) + str(r.randrange(40))) for i in range(300)
    ] + [(1, None), (2, None), (None, "q"), (1, "z" * 3000), (1, "z" * 3000)]
    out = H.shard(docs(spark, rows), 7).collect()
    assert len(out) == len(rows) and {x.law for x in out} == {"bytes"}
    for k in {x.shard for x in out}:
        slots = sorted(x.slot for x in out if x.shard == k)
        assert slots == list(range(len(slots))) and 0 <= k < 7
    assert Counter((x.doc_id, x.size, x.text_crc32) for x in out) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    keyed = docs(spark, rows).select(
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("k"),
        (F.octet_length(F.coalesce("text", F.lit(""))) + 16).alias("n"),
    ).groupBy("k").agg(F.sum("n").alias("n")).orderBy("k").collect()
    sizes = [x.n for x in keyed]

    def shards_at(c):
        n, f = 1, 0
        for s in sizes:
            if f + s > c:
                n, f = n + 1, 0
            f += s
        return n

    best = next(c for c in range(max(sizes), sum(sizes) + 1) if shards_at(c) <= 7)
    assert max(sum(x.size for x in out if x.shard == k) for k in range(7)) == best
    assert H.shard(docs(spark, [])).count() == 0


def test_packing(spark):
    from quern.llm import packing_bins as P
    from quern.llm.tokens import ids_of

    r = random.Random(3)
    rows = [
        (i, " ".join(f"w{r.randrange(999)}" for _ in range(r.randrange(60)))) for i in range(80)
    ] + [(80, None), (81, ""), (None, "x y"), (5, "dup"), (5, "dup"), (82, "long word " * 90)]
    out = P.pack_sequences(docs(spark, rows), 64).collect()
    bins = {}
    for x in out:
        bins.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for got in bins.values():
        at = 0
        for o, n in sorted(got):
            assert o == at
            at += n
        assert at <= 64
    want = Counter()
    for i, t in rows:
        ids = np.append(ids_of()(t), np.array([0], "<u4")).astype("<u4")
        first = len(ids) - 64 * ((len(ids) - 1) // 64)
        cuts = [0, *range(first, len(ids) + 1, 64)]
        want.update((i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    assert Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in out) == want
    assert len(bins) <= 1.05 * sum(x.length for x in out) / 64 + 1
    assert P.pack_sequences(docs(spark, []), 64).count() == 0


def test_fullest_by_brute_force():
    from itertools import product

    from quern.llm.packing_bins import fullest

    r = random.Random(9)
    for _ in range(60):
        counts = {r.randint(1, 12): r.randint(1, 3) for _ in range(3)}
        room = r.randint(0, 30)
        best = max(s for s in (sum(n * x for n, x in zip(ns, counts, strict=True)) for ns in product(*[range(c + 1) for c in counts.values()])) if s <= room)
        got = fullest(counts, room)
        assert sum(got) == best and all(got.count(x) <= counts[x] for x in set(got))


def test_patterned_words_are_not_alike(spark):
    """Thue-Morse words, which collide in every polynomial hash modulo a power of two, stay apart."""
    bits = [bin(k).count("1") % 2 for k in range(1 << 12)]
    for size in (1 << 10, 1 << 11, 1 << 12):
        one, two = ("".join("xy"[b ^ flip] for b in bits[:size]) for flip in (0, 1))
        got = M.near_duplicates(docs(spark, [(1, one), (2, two), (3, one.upper()), (4, f"a {one} b c d e"), (5, f"a {two} b c d e")])).collect()
        assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(1, 1, True), (2, 2, True), (3, 1, False), (4, 4, True), (5, 5, True)}
