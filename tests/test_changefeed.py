import random

from pyspark.sql import functions as F

from cloudloom.operators import changefeed as C

KEYS, ORDER = ["s", "p"], ["t", "f", "r"]
SCHEMA = "c bigint, s int, p bigint, t int, f int, r int, op string, mask int"


def replay(rows):
    state = {}
    for c, s, p, t, f, r, op, mask in sorted({x for x in rows if None not in x[1:7]}, key=lambda x: (x[3], x[4], x[5], x[0])):
        o = op.strip().lower()[:1]
        if o == "i":
            state[s, p] = {}
        if o == "d":
            state.pop((s, p), None)
        if o in "iu" and (s, p) in state:
            state[s, p].update({a: c for a, b in (("a", 1), ("b", 2)) if (mask or 0) & b})
    return {(s, p, a, c) for (s, p), v in state.items() for a, c in v.items()}


def logs(df):
    return C.split_feed(df, KEYS, ORDER, "c", "op", {"a": F.col("mask").bitwiseAND(1) != 0, "b": F.col("mask").bitwiseAND(2) != 0})


def feed():
    rng = random.Random(2)
    rows = [(i, rng.randrange(3), 1 if rng.random() < 0.4 else rng.randrange(40), rng.randrange(-5, 20), 0, i, rng.choice(["I", " insert", "upd", "U", "u", "Delete"]), rng.choice([0, 1, 2, 3, 8, None])) for i in range(1500)]
    rows += rows[:100] + [(9000, 1, 1, 5, 0, 1, "?", 1), (9001, 1, None, 5, 0, 1, "i", 1), (9002, 1, 1, None, 0, 1, "i", 1)]
    rng.shuffle(rows)
    return rows


def test_same_state_as_replay(spark):
    rows = feed()
    got = C.current_cells(*logs(spark.createDataFrame(rows, SCHEMA)), KEYS, ["a", "b"])
    good = [r for r in rows if r[6] != "?"]
    assert {(r.s, r.p, r.attr, r.seq.change) for r in got.collect()} == replay(good)


def test_batches_in_any_order_and_twice(spark, tmp_path):
    rows = feed()
    log = C.ChangeLog(spark, str(tmp_path), KEYS, ORDER, "c", "op", {"a": F.col("mask").bitwiseAND(1) != 0, "b": F.col("mask").bitwiseAND(2) != 0})
    parts = [rows[i::4] for i in range(4)]
    for n in (2, 0, 3, 1, 2):
        log.append(spark.createDataFrame(parts[n], SCHEMA), n)
    assert {(r.s, r.p, r.attr, r.seq.change) for r in log.current().collect()} == replay([r for r in rows if r[6] != "?"])


def test_empty_and_unplaced(spark):
    e = spark.createDataFrame([], SCHEMA)
    assert C.current_cells(*logs(e), KEYS, ["a", "b"]).count() == 0
    r = C.unplaced(spark.createDataFrame(feed(), SCHEMA), KEYS, ORDER, "c", "op").first()
    assert (r.bad_op, r.missing_key_or_order) == (1, 2)
