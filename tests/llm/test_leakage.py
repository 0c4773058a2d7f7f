import random

from cloudloom.llm import leakage as L


def brute(docs, items, n=12):
    runs = {}
    for i, t in items:
        w = L.words(t)
        for s in range(len(w) - n + 1):
            runs.setdefault(tuple(w[s : s + n]), set()).add(i)
    own = {r: min(i) for r, i in runs.items() if len(i) == 1}
    out = set()
    for d, t in docs:
        w = L.words(t or "")
        out |= {(d, own[tuple(w[s : s + n])]) for s in range(len(w) - n + 1) if tuple(w[s : s + n]) in own}
    return out


def sample():
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(60)]
    shared = " ".join(rng.choices(vocab, k=15))
    items = [(i, shared + " " + " ".join(rng.choices(vocab, k=30))) for i in range(8)] + [(8, "too short")]
    docs = []
    for d in range(60):
        w = rng.choices(vocab, k=40)
        if d % 3:
            t = L.words(items[d % 8][1])
            s = rng.randrange(len(t) - 14)
            w += ["\n# "] + [x.upper() + rng.choice(["", ",", "\n", " **"]) for x in t[s : s + rng.randrange(10, 20)]]
        docs.append((d, " ".join(w)))
    return docs + [(100, None), (101, ""), (102, "x " * 50_000), docs[1]], items


def test_both_ways_match_brute_force(spark):
    docs, items = sample()
    d = spark.createDataFrame([(a, b, "clash") for a, b in docs], "doc_id bigint, text string, item_id string")
    i = spark.createDataFrame(items, "item_id bigint, text string")
    want = brute(docs, items)
    assert want
    for most in (20_000, 1):
        got = L.find_leaks(d, i, broadcast_items=most)
        assert sorted((r.doc_id, r.item_id) for r in got.collect()) == sorted(want)


def test_null_and_repeated_ids_both_ways(spark):
    t = [" ".join(f"{c}{k}" for k in range(20)) for c in "abc"]
    d = spark.createDataFrame([(None, "x " + t[0]), (1, t[1] + " y"), (1, t[0])], "doc_id bigint, text string")
    i = spark.createDataFrame([(7, t[0]), (7, t[1]), (8, t[2]), (None, t[2])], "item_id bigint, text string")
    for most in (20_000, 1):
        assert {(r.doc_id, r.item_id) for r in L.find_leaks(d, i, broadcast_items=most).collect()} == {(None, 7), (1, 7)}
    assert L.find_leaks(d, i, broadcast_bytes=1).count() == 2


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id bigint, text string")
    i = spark.createDataFrame([(1, " ".join(f"a{k}" for k in range(20)))], "item_id bigint, text string")
    assert L.find_leaks(d, i).count() == 0
    assert L.find_leaks(spark.createDataFrame([(1, "x")], "doc_id bigint, text string"), i.limit(0)).count() == 0
