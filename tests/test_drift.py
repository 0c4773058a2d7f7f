import json

from cloudloom.operators import drift as D


def records(spark, runs):
    rows = [("s", n, i, p if isinstance(p, str) or p is None else json.dumps(p)) for n, recs in runs for i, p in enumerate(recs)]
    return spark.createDataFrame(rows, "series string, run_no int, rec_no int, payload string")


def rec(cand, **kw):
    meta = kw.pop("meta", {})
    return {"candidate": cand, "ok": True, **kw, "meta": meta}


def runs():
    a = [rec("x", seconds=1.5, meta={"mask": "byte_nonzero"}), rec("y", seconds=2.5), {"candidate": "y", "ok": False, "error": "ValueError: it gave up after 3 s"}]
    b = [rec("x", elapsed=1.7, meta={"mask": "packbits_nonzero"}), rec("y", elapsed=2.4), {"candidate": "x", "ok": False, "failure": "TimeoutError: nothing was left to do"}, '{"candidate": "x", "cut', None]
    c = [rec("x", elapsed="1.7", meta={"mask_kind": "byte_nonzero", "note": "warm"}), rec("y", elapsed="2.9", meta={"note": "cold"}), {"candidate": "y", "ok": False, "failure": None}]
    return [(0, a), (1, b), (3, c + c)]


def test_changes(spark):
    r = records(spark, runs())
    got = {(x.run_no, x.kind, x.field_from, x.field_to) for x in D.migrations(D.profile(r)).collect()}
    assert got == {(1, "renamed", "seconds", "elapsed"), (1, "renamed", "error", "failure"), (3, "retyped", "elapsed", "elapsed"), (3, "renamed", "meta.mask", "meta.mask_kind"), (3, "added", "", "meta.note")}


def test_one_table(spark):
    r = records(spark, runs())
    p = D.profile(r)
    rows = D.unify(r, D.routes(p, D.migrations(p)), ["run_no", "rec_no"], defaults={"extra": "none"}).collect()
    assert len(rows) == 12  # invalid payloads are out
    by = {(x.run_no, x.rec_no): x["values"] for x in rows}
    assert by[3, 0]["seconds"] == "1.7" and by[1, 0]["seconds"] == "1.7" and by[3, 0]["meta.mask"] == "byte_nonzero"
    assert by[0, 0]["extra"] == "none" and "elapsed" not in by[3, 0]
    typed = {(x.run_no, x.rec_no): x for x in rows}
    assert typed[0, 0].casts == ["seconds: number -> string"] and typed[3, 0].casts == [] and typed[0, 0].flags["ok"] is True


def test_a_name_used_anew_has_a_column_of_its_own(spark):
    days = [(0, "size"), (1, "bytes"), (2, "bytes"), (3, "bytes")]
    r = records(spark, [(n, [rec("x", **{f: 5 + n}, **({"size": "big"} if n == 3 else {}), **({"gone": True} if n != 1 else {})) for _ in range(3)]) for n, f in days])
    p = D.profile(r)
    out = D.unify(r, D.routes(p, D.migrations(p)), ["run_no"]).collect()
    last = [x for x in out if x.run_no == 3][0]
    assert last["values"]["size"] == "8" and last["values"]["size#2"] == "big" and last.numbers["size"] == 8.0 and last.flags["gone"] is True


def test_long_chains_and_whole_values(spark):
    runs = [(n, [rec("x", **{f"f{n}": 7})]) for n in range(21)]
    p = D.profile(records(spark, runs))
    assert {x.canonical for x in D.routes(p, D.migrations(p)).where("field like 'f%'").collect()} == {"f0"}
    long_a, long_b = ["p"] * 50 + ["left"], ["q"] * 50 + ["left"]
    a = [rec("x", a=long_a, note="z " * 300 + "alpha beta")]
    b = [rec("x", b=long_b, remark="y " * 300 + "alpha beta")]
    got = D.migrations(D.profile(records(spark, [(0, a), (1, b)]))).collect()
    assert {(x.field_from, x.field_to) for x in got} == {("a", "b"), ("note", "remark")}


def test_answers_do_not_depend_on_the_number_of_records(spark):
    def some(field, n, salt):
        return [rec("x", **{field: f"{word(7919 * i + salt)} {word(104_729 * i + salt)}"}) for i in range(n)]

    for n in (20, 2000, 10_000):
        got = D.migrations(D.profile(records(spark, [(0, some("title", n, 1)), (1, some("remark", n, 300_000))]))).collect()
        assert {x.kind for x in got} == {"removed", "added"}, n


def test_versions_and_empty(spark):
    p = D.profile(records(spark, [*runs(), (4, runs()[2][1])]))
    v = {x.run_no: x.version for x in D.fingerprints(p).collect()}
    assert v == {0: 1, 1: 2, 3: 3, 4: 3}
    e = D.profile(records(spark, []))
    assert D.migrations(e).count() == 0 and D.fingerprints(e).count() == 0


def word(i):
    return "".join(chr(97 + i // 26**k % 26) for k in range(4))


def test_wide_vocabularies_are_alike_only_by_what_they_share(spark):
    def some(field, first):  # each record has 40 words of its own
        return [rec("x", **{field: " ".join(word(first + 40 * i + j) for j in range(40))}) for i in range(100)]

    other = D.migrations(D.profile(records(spark, [(0, some("title", 0)), (1, some("remark", 10_000))]))).collect()
    assert {(x.kind, x.field_from, x.field_to) for x in other} == {("removed", "title", ""), ("added", "", "remark")}
    same = D.migrations(D.profile(records(spark, [(0, some("title", 0)), (1, some("remark", 1000)[::-1])]))).collect()
    assert [(x.kind, x.field_from, x.field_to) for x in same] == [("renamed", "title", "remark")]


def test_prose_of_good_records_needs_shared_words(spark):
    a, b = [rec("x", title="nothing else was left to do")], [rec("x", remark="some quite different prose altogether")]
    got = D.migrations(D.profile(records(spark, [(0, a), (1, b)]))).collect()
    assert {x.kind for x in got} == {"removed", "added"}
