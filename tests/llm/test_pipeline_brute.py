"""The whole pipeline against brute force over a small folder of documents, labels and benchmark items."""

import random
from collections import defaultdict

import corpus_pipeline as P
from test_operators import components_brute, leaks_brute, toxicity_brute


def fixture(r):
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, items = text(30), [(k, text(20)) for k in range(10)]
    docs = []
    for k in range(90):
        body = text(r.randint(20, 70))
        kind = k % 9
        if kind == 1:
            body = " ".join(r.choice(["scum", "vermin", "filth", word()]) for _ in range(30))
        elif kind == 2:
            body = f"{body} {passage} {text(8)}"
        elif kind == 3:
            w = items[k // 9][1].split()
            w[4] = "other"
            body = f"{text(15)} {' '.join(w)} {text(15)}"
        elif kind == 4:
            w = docs[k - 4][1].split()
            w[len(w) // 2] = word()
            body = " ".join(w)
        elif kind == 5:
            body = docs[k - 5][1]
        docs.append((1000 - k, body))
    return docs, items, [(i, int("scum" in t or "filth" in t)) for i, t in docs[:70]]


def cut_brute(pairs, t=50):
    """Texts without the bytes of strings that start in a document of a smaller id; what is left of a character goes."""
    first = {}
    for i, text in sorted(pairs):
        b = text.encode()
        for k in range(len(b) - t + 1):
            first.setdefault(b[k : k + t], i)
    out = []
    for i, text in pairs:
        b, gone = text.encode(), set()
        for k in range(len(b) - t + 1):
            if first[b[k : k + t]] < i:
                gone.update(range(k, k + t))
        out.append((i, bytes(x for k, x in enumerate(b) if k not in gone).decode("utf-8", "ignore")))
    return out


def test_pipeline_is_brute_force(spark, tmp_path):
    from quern.llm.tokens import ids_of
    from quern.llm.toxicity import fit

    docs, items, labels = fixture(random.Random(7))
    table = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    known, text_of = dict(labels), dict(docs)
    index = fit(table, spark.createDataFrame(labels, "doc_id long, toxic int"))
    kinds = [sum(known.values()), len(known) - sum(known.values())]
    assert min(kinds) > 5 and len(index.ids) == len(known)
    scores = toxicity_brute(docs, [(i, known[i], text_of[i]) for i in known], True, index.calibrated)
    kept = [d for d, s in zip(docs, scores, strict=True) if s < 0.5]
    assert len(docs) - len(kept) >= 8
    groups = components_brute(kept)
    single = [d for d in kept if groups[d[0]] == d[0]]
    assert len(kept) - len(single) >= 15
    shorter = cut_brute(single)
    assert sum(a != b for a, b in zip(single, shorter, strict=True)) >= 5
    bad = {i for i, _ in leaks_brute(shorter, items)}
    left = [d for d in shorter if d[0] not in bad]
    assert 3 <= len(bad)

    pieces, bins = defaultdict(list), defaultdict(list)
    for x in P.run(spark, str(tmp_path)).collect():
        pieces[x.doc_id].append(x)
        bins[x.sequence_id].append((x.offset, x.length))
    assert set(pieces) == {i for i, _ in left}
    for i, text in left:
        own = sorted(pieces[i], key=lambda x: x.piece)
        assert [x.piece for x in own] == list(range(len(own)))
        assert sum(x.length for x in own) == len(ids_of()(text)) + 1
    for places in bins.values():
        places.sort()
        assert [a for a, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))]
        assert sum(n for _, n in places) <= 2048
    assert len(bins) <= 1 + 1.1 * sum(x.length for own in pieces.values() for x in own) / 2048
