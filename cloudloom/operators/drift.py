"""Schemas that drift between the files of a series.

1. ``profile``: what fields each run of a series has, with their JSON types, the
   kinds of record they stand in and a bounded sketch of their values. Built from
   Arrow batches and reduced per batch, so only profiles are shuffled.
2. ``migrations``: versioned fingerprints are compared run by run; where they differ, a
   step lists the fields added, removed, renamed or retyped.
3. ``routes`` and ``unify``: every record goes through the chained renames of its
   series, missing fields get a default and values are cast, which gives one table with
   typed columns and the casts made.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterable, Mapping, Sequence
from zlib import crc32

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from cloudloom.plans.durable import cut

#: Values are sketched by this many least 64-bit hashes of their tokens (and of the builds of messages); record kinds fall in half as many classes.
SKETCH = 1024
KINDS = 512
_WORD = re.compile(r"[^\W\d_]+|\d+")
_MESSAGE = re.compile(r"[\w.]+:\s")


def json_type(v) -> str | None:
    if v is None:
        return None
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, (int, float)):
        return "number"
    return {str: "string", list: "array", dict: "object"}[type(v)]


def fields_of(record: Mapping, nested: str) -> Iterable[tuple[str, object]]:
    """Top-level fields except ``nested``, then the fields inside it as 'nested.key'."""
    for k, v in record.items():
        if k != nested:
            yield k, v
    inner = record.get(nested)
    if isinstance(inner, dict):
        for k, v in inner.items():
            yield f"{nested}.{k}", v


def value_tokens(v) -> Iterable[str]:
    """What a value looks like: its words, numbers by size and wholeness, keys of objects. Whole values, however long."""
    if isinstance(v, bool):
        yield f"b{v}"
    elif isinstance(v, (int, float)):
        m = abs(v)
        whole = isinstance(v, int) or v.is_integer()
        yield ("i" if whole else "f") + (str(m.bit_length() if isinstance(v, int) else int(math.log2(m)) + 1) if 0 < m < math.inf else "0")
    elif isinstance(v, str):
        for w in _WORD.findall(v):
            if w.isdigit():
                yield f"d{len(w)}"
            else:
                yield w.lower()
    elif isinstance(v, list):
        for x in v:
            yield from value_tokens(x)
    elif isinstance(v, dict):
        for k, x in v.items():
            yield f"k{k}"
            yield from value_tokens(x)


def shape(v) -> str:
    """The build of a value; '<text>' stands for prose of four words or more, '<message>' for such behind a name and a colon."""
    if isinstance(v, str):
        return "name" if v.count(" ") < 3 and len(v.split()) <= 3 else "<message>" if _MESSAGE.match(v) else "<text>"
    if isinstance(v, list):
        return "[" + ",".join(sorted({shape(x) for x in v})) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{shape(x)}" for k, x in sorted(v.items())) + "}"
    return json_type(v) or "null"


def hashed(token: str) -> int:
    return xxhash.xxh64_intdigest(token.encode("utf-8", "replace")) - (1 << 63)


class _Seen:
    """Hashed tokens of values and builds of messages; scalars met before come from a bounded memo."""

    def __init__(self, most: int = 50_000):
        self.most, self.memo = most, {}

    def __call__(self, v) -> tuple[tuple[int, ...], int | None]:
        key = (type(v), v) if isinstance(v, (str, int, float)) else None
        if key is not None and (known := self.memo.get(key)) is not None:
            return known
        build = shape(v)
        kept = "<message>" in build or ("<text>" in build and not isinstance(v, str))
        out = (tuple(map(hashed, value_tokens(v))), hashed(build) if kept else None)
        if key is not None:
            if len(self.memo) >= self.most:
                self.memo.clear()
            self.memo[key] = out
        return out


def parse(payload) -> dict | None:
    """A whole record, or None for null, cut-off or otherwise invalid text."""
    try:
        r = json.loads(payload)
    except (TypeError, ValueError, RecursionError):
        return None
    return r if isinstance(r, dict) else None


PROFILE = T.StructType(
    [
        T.StructField("series", T.StringType()),
        T.StructField("run_no", T.IntegerType()),
        T.StructField("field", T.StringType()),
        T.StructField("types", T.ArrayType(T.StringType())),
        T.StructField("kinds", T.ArrayType(T.IntegerType())),
        T.StructField("failed_only", T.BooleanType()),
        T.StructField("tokens", T.ArrayType(T.LongType())),
        T.StructField("builds", T.ArrayType(T.LongType())),
    ]
)


def _profile_batches(nested: str, kind: str, ok: str):
    schema = pa.schema(
        [("series", pa.string()), ("run_no", pa.int32()), ("field", pa.string()), ("types", pa.list_(pa.string())), ("kinds", pa.list_(pa.int32())), ("failed_only", pa.bool_()), ("tokens", pa.list_(pa.int64())), ("builds", pa.list_(pa.int64()))]
    )

    def run(batches):
        look = _Seen()
        for b in batches:
            seen: dict[tuple, list] = {}
            for s, n, p in zip(*(b.column(i).to_pylist() for i in range(3))):
                r = parse(p)
                if r is None:
                    continue
                failed = r.get(ok) is False
                of = crc32(str(r.get(kind)).encode()) % KINDS
                seen.setdefault((s, n, None), [set(), set(), True, set(), set()])
                if not failed:
                    seen[s, n, None][1].add(of)
                for f, v in fields_of(r, nested):
                    e = seen.setdefault((s, n, f), [set(), set(), True, set(), set()])
                    if (t := json_type(v)) is not None:
                        e[0].add(t)
                        tokens, build = look(v)
                        e[3].update(tokens)
                        if build is not None:
                            e[4].add(build)
                        for i in (3, 4):
                            if len(e[i]) > 4 * SKETCH:
                                e[i] = set(sorted(e[i])[:SKETCH])
                    if not failed:
                        e[1].add(of)
                        e[2] = False
            rows = [(*k, sorted(e[0]), sorted(e[1]), e[2], sorted(e[3])[:SKETCH], sorted(e[4])[:SKETCH]) for k, e in seen.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t.type) for c, t in zip(zip(*rows) if rows else [[]] * 8, schema)], schema=schema)

    return run


def profile(records: DataFrame, series: str = "series", run: str = "run_no", payload: str = "payload", nested: str = "meta", kind: str = "candidate", ok: str = "ok") -> DataFrame:
    """One row for each field of each run; ``field`` null stands for the run itself.

    ``kinds``: hashed kinds of the successful records that have the field;
    ``failed_only``: only failed records have it. Invalid payloads are ignored; a run
    without any valid one has no rows. Null series or run form a group of their own.
    """
    parts = records.select(F.col(series).cast("string"), F.col(run).cast("int"), F.col(payload).cast("string")).mapInArrow(_profile_batches(nested, kind, ok), PROFILE)

    def union(c: str) -> Column:
        return F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(c)

    return parts.groupBy("series", "run_no", "field").agg(union("types"), union("kinds"), F.bool_and("failed_only").alias("failed_only"), F.slice(union("tokens"), 1, SKETCH).alias("tokens"), F.slice(union("builds"), 1, SKETCH).alias("builds"))


def versions(prof: DataFrame) -> DataFrame:
    """(series, run_no, fields, all_kinds, fingerprint): one row a run; ``fields`` holds (field, types, kinds, failed_only), types as last known."""
    known = F.when(F.size("types") > 0, F.col("types"))
    w = W.partitionBy("series", "field").orderBy("run_no")
    filled = prof.select("series", "run_no", "field", F.coalesce(F.last(known, ignorenulls=True).over(w), F.array().cast("array<string>")).alias("types"), "kinds", "failed_only")
    each = F.when(F.col("field").isNotNull(), F.struct("field", "types", "kinds", "failed_only"))
    runs = filled.groupBy("series", "run_no").agg(F.array_sort(F.collect_list(each)).alias("fields"), F.max(F.when(F.col("field").isNull(), F.col("kinds"))).alias("all_kinds"))
    text = F.concat_ws(",", F.transform("fields", lambda f: F.concat_ws(":", f["field"], F.concat_ws("|", f["types"]))))
    return runs.withColumn("fingerprint", F.sha2(text, 256))


def fingerprints(prof: DataFrame) -> DataFrame:
    """(series, run_no, fingerprint, version): version counts the changes of fingerprint."""
    w = W.partitionBy("series").orderBy("run_no")
    new = F.when(F.col("fingerprint").eqNullSafe(F.lag("fingerprint").over(w)), 0).otherwise(1)
    return versions(prof).select("series", "run_no", "fingerprint").withColumn("new", new).select("series", "run_no", "fingerprint", F.sum("new").over(w).cast("int").alias("version"))


def _vocabulary(prof: DataFrame, wanted: DataFrame) -> DataFrame:
    """(series, field, types, vocab, builds, kinds) over all runs of the wanted fields: least hashes, each bounded by ``SKETCH``."""
    some = prof.where(F.col("field").isNotNull() & (F.size("types") > 0)).join(wanted, ["series", "field"], "left_semi")

    def tagged(tag: int, c: str) -> Column:
        return F.transform(F.col(c).cast("array<bigint>"), lambda v: F.struct(F.lit(tag).alias("tag"), v.alias("v")))

    key = ["series", "field", "types"]
    one = some.select(*key, F.explode(F.concat(*[tagged(t, c) for t, c in enumerate(("tokens", "builds", "kinds"))])).alias("e")).select(*key, "e.tag", "e.v").distinct()
    least = one.withColumn("n", F.row_number().over(W.partitionBy(*key, "tag").orderBy("v"))).where(F.col("n") <= SKETCH)
    return least.groupBy(*key).agg(*[F.array_sort(F.collect_list(F.when(F.col("tag") == t, F.col("v")))).alias(c) for t, c in enumerate(("vocab", "builds", "kinds"))])


def _jaccard(p: Column, q: Column) -> Column:
    return F.size(F.array_intersect(p, q)) / F.greatest(F.size(F.array_union(p, q)), F.lit(1))


def migrations(prof: DataFrame, alike: float = 0.25, kind_overlap: float = 0.6) -> DataFrame:
    """(series, run_no, kind, field_from, field_to): changes against the preceding run.

    The fingerprints of following runs are compared; only where they differ, fields are.
    A field that ends and one that begins in the same run are one renamed field if
    their JSON types agree, they stand in the same kind of record (failed ones only,
    or successful records of mostly the same kinds, ``kind_overlap`` as Jaccard, among
    the kinds both runs have) and their values over the whole series look alike (at
    least ``alike`` of the smaller set of tokens is shared, as estimated by the least
    hashes up to the bound that both sketches cover: exact up to ``SKETCH`` tokens).
    Only messages of failed records ('Name: prose', or lists and objects that hold
    prose) of one build are alike whatever they say. Of several matches the best holds,
    then the best of the fields left over, until none qualifies. A null type never counts
    as another type; the last type known holds.
    """
    prof = cut(prof)  # the records are parsed once
    key = ["series", "run_no"]
    w = W.partitionBy("series").orderBy("run_no")
    prev = F.lag(F.struct("fields", "all_kinds", "fingerprint")).over(w)
    runs = versions(prof).withColumn("prev", prev).where(F.col("prev").isNotNull() & (F.col("prev.fingerprint") != F.col("fingerprint")))

    def lacks(there: str):
        return lambda x: ~F.exists(F.col(there), lambda y: y["field"] == x["field"])

    def other_type(y: Column):
        return lambda x: (x["field"] == y["field"]) & (F.size(x["types"]) > 0) & (F.size(y["types"]) > 0) & (x["types"] != y["types"])

    steps = runs.select(
        *key,
        F.array_intersect("all_kinds", "prev.all_kinds").alias("shared"),
        F.filter("prev.fields", lacks("fields")).alias("ended"),
        F.filter("fields", lacks("prev.fields")).alias("begun"),
        F.transform(F.filter("fields", lambda y: F.exists("prev.fields", other_type(y))), lambda y: y["field"]).alias("retyped"),
    )
    steps = cut(steps)
    # as many pairs as fields change in one run; bounded by a record's own width
    pair = steps.select(*key, "shared", "begun", F.explode("ended").alias("e")).select(*key, "shared", "e", F.explode("begun").alias("b")).where(F.col("e.types") == F.col("b.types"))
    pair = pair.select(*key, "shared", F.col("e.field").alias("field_from"), F.col("b.field").alias("field_to"), F.col("e.types").alias("types"), F.col("e.kinds").alias("k0"), F.col("b.kinds").alias("k1"), F.col("e.failed_only").alias("x0"), F.col("b.failed_only").alias("x1"))
    wanted = pair.select("series", F.explode(F.array("field_from", "field_to")).alias("field")).distinct()
    vocab = cut(_vocabulary(prof, wanted))  # used for both ends
    for end, n in (("field_from", 0), ("field_to", 1)):
        pair = pair.join(vocab.select("series", F.col("field").alias(end), "types", F.col("vocab").alias(f"v{n}"), F.col("builds").alias(f"b{n}"), F.col("kinds").cast("array<int>").alias(f"s{n}")), ["series", end, "types"])
    a, b = F.array_intersect("k0", "shared"), F.array_intersect("k1", "shared")
    kinds = F.when((F.size(a) > 0) & (F.size(b) > 0), _jaccard(a, b)).otherwise(_jaccard(F.col("s0"), F.col("s1")))

    def bound(v: str) -> Column:
        return F.when(F.size(v) < SKETCH, F.lit((1 << 63) - 1)).otherwise(F.element_at(v, -1))

    upto = F.least(bound("v0"), bound("v1"))
    c0, c1 = (F.filter(v, lambda t: t <= upto) for v in ("v0", "v1"))
    like = F.size(F.array_intersect(c0, c1)) / F.greatest(F.least(F.size(c0), F.size(c1)), F.lit(1))
    failed = F.col("x0") & F.col("x1")
    like = F.when(failed & F.arrays_overlap("b0", "b1"), F.greatest(like, F.lit(0.5))).otherwise(like)
    same_kind = F.when(failed, 1.0).when(F.col("x0") | F.col("x1"), 0.0).otherwise(kinds)
    pair = pair.select(*key, "field_from", "field_to", like.alias("like"), same_kind.alias("same_kind")).where((F.col("same_kind") >= kind_overlap) & (F.col("like") >= alike))
    ranked = pair.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct((-(F.col("like") + F.col("same_kind"))).alias("score"), "field_from", "field_to"))).alias("pairs"))
    none = F.array().cast("array<struct<score:double,field_from:string,field_to:string>>")
    best = F.aggregate("pairs", none, lambda taken, p: F.when(F.exists(taken, lambda t: (t["field_from"] == p["field_from"]) | (t["field_to"] == p["field_to"])), taken).otherwise(F.concat(taken, F.array(p))))
    done = steps.join(ranked.select(*key, best.alias("moved")), key, "left").withColumn("moved", F.coalesce("moved", none))

    def change(kind: str, old: Column, new: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), old.alias("field_from"), new.alias("field_to"))

    changes = F.concat(
        F.transform("retyped", lambda f: change("retyped", f, f)),
        F.transform("moved", lambda m: change("renamed", m["field_from"], m["field_to"])),
        F.transform(F.filter("ended", lambda f: ~F.exists("moved", lambda m: m["field_from"] == f["field"])), lambda f: change("removed", f["field"], F.lit(""))),
        F.transform(F.filter("begun", lambda f: ~F.exists("moved", lambda m: m["field_to"] == f["field"])), lambda f: change("added", F.lit(""), f["field"])),
    )
    return done.select(*key, F.inline(changes))


def routes(prof: DataFrame, steps: DataFrame) -> DataFrame:
    """(series, run_no, field, canonical, cast_to): where a field of a run ends up.

    A field lives from the run in which it begins to the run before it ends. A life that
    begins by a rename follows that of the old name; lives are chained to their first one
    by doubling steps, a few jobs for any number of runs. The canonical name is the
    first name of the chain. A name that is used anew after it was renamed away gets
    one of its own ('name#2'). ``cast_to`` is the JSON type if all runs of the
    canonical field agree on it, else string.
    """
    p = prof.where(F.col("field").isNotNull()).select("series", "run_no", "field", "types")
    at = prof.where(F.col("field").isNull()).select(F.col("series").alias("__s"), F.col("run_no").alias("__r"), F.row_number().over(W.partitionBy("series").orderBy("run_no")).alias("at"))
    w = W.partitionBy("series", "field").orderBy("run_no")
    p = p.join(at, F.col("series").eqNullSafe(F.col("__s")) & F.col("run_no").eqNullSafe(F.col("__r"))).drop("__s", "__r")
    p = p.withColumn("gap", F.coalesce(F.col("at") - F.lag("at").over(w), F.lit(0)) != 1)
    p = cut(p.withColumn("born", F.last(F.when(F.col("gap"), F.col("run_no")), ignorenulls=True).over(w)).drop("gap"))
    lives = p.select("series", "field", "born").distinct()
    moved = steps.where(F.col("kind") == "renamed").select("series", F.col("run_no").alias("born"), F.col("field_to").alias("field"), F.col("field_from").alias("old"))
    old = lives.select("series", F.col("field").alias("old"), F.col("born").alias("old_born"))
    parents = moved.join(old, ["series", "old"]).where(F.col("old_born") < F.col("born")).groupBy("series", "field", "born").agg(F.max_by(F.struct("old", "old_born"), "old_born").alias("up"))
    own = F.struct(F.col("field").alias("old"), F.col("born").alias("old_born"))
    chain = cut(lives.join(parents, ["series", "field", "born"], "left").select("series", "field", "born", F.coalesce("up", own).alias("up")))
    while True:
        there = chain.select(F.col("series").alias("s"), F.col("field").alias("f"), F.col("born").alias("b"), F.col("up").alias("next"))
        same = F.col("series").eqNullSafe(F.col("s")) & (F.col("up.old") == F.col("f")) & F.col("up.old_born").eqNullSafe(F.col("b"))
        jumped = cut(chain.join(there, same).select("series", "field", "born", F.col("next").alias("up"), (F.col("next") != F.col("up")).alias("far")))
        chain = jumped.drop("far")
        if jumped.where("far").isEmpty():
            break
    root = chain.select("series", "field", "born", F.col("up.old").alias("name"), F.col("up.old_born").alias("since"))
    roots = root.groupBy("series", "name", "since").agg(F.max((F.col("field") != F.col("name")).cast("int")).alias("left"))
    before = F.coalesce(F.sum("left").over(W.partitionBy("series", "name").orderBy("since").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    roots = roots.select("series", "name", "since", F.when(before == 0, F.col("name")).otherwise(F.concat("name", F.lit("#"), (before + 1).cast("string"))).alias("canonical"))
    named = p.join(root.join(roots, ["series", "name", "since"]).select("series", "field", "born", "canonical"), ["series", "field", "born"])
    kinds = named.select("series", "canonical", F.explode("types").alias("type")).groupBy("series", "canonical").agg(F.min("type").alias("a"), F.max("type").alias("b"))
    cast = kinds.select("series", "canonical", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise("string").alias("cast_to"))
    return named.join(cast, ["series", "canonical"], "left").select("series", "run_no", "field", "canonical", F.coalesce("cast_to", F.lit("string")).alias("cast_to"))


def unify(records: DataFrame, route: DataFrame, id_cols: Sequence[str], nested: str = "meta", payload: str = "payload", series: str = "series", run: str = "run_no", defaults: Mapping[str, str] | None = None) -> DataFrame:
    """(id_cols..., values MAP<STRING,STRING>, numbers MAP<STRING,DOUBLE>, flags MAP<STRING,BOOLEAN>, casts ARRAY<STRING>).

    Every whole record under canonical names. ``values`` has each field as JSON text,
    strings bare; ``numbers`` and ``flags`` those whose chain is of that type alone.
    A value whose chain changed type is cast to string, and ``casts`` names it with both
    types. Fields the record lacks get ``defaults[name]`` or null. Null or cut-off
    payloads are left out.
    """
    maps = route.groupBy(F.col("series").alias("__s"), F.col("run_no").alias("__r")).agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("canonical", "cast_to")))).alias("__route"))
    joined = records.join(maps, F.col(series).eqNullSafe(F.col("__s")) & F.col(run).eqNullSafe(F.col("__r")), "left").drop("__s", "__r")
    base = dict(defaults or {})

    @F.pandas_udf("struct<ok:boolean,values:map<string,string>,numbers:map<string,double>,flags:map<string,boolean>,casts:array<string>>")
    def move(text: pd.Series, way: pd.Series) -> pd.DataFrame:
        out = []
        for t, m in zip(text, way):
            r = parse(t)
            if r is None:
                out.append((False, {}, {}, {}, []))
                continue
            m = dict(m) if m is not None else {}
            row = {**{v["canonical"]: base.get(v["canonical"]) for v in m.values()}, **base}
            numbers, flags, casts = {}, {}, []
            for f, v in fields_of(r, nested):
                to = m.get(f)
                name, want = (to["canonical"], to["cast_to"]) if to else (f, "string")
                if v is None:
                    continue
                kind = json_type(v)
                row[name] = v if kind == "string" else json.dumps(v, sort_keys=True)
                if kind != want:
                    casts.append(f"{name}: {kind} -> {want}")
                elif kind == "number":
                    numbers[name] = float(v)
                elif kind == "boolean":
                    flags[name] = v
            out.append((True, row, numbers, flags, casts))
        return pd.DataFrame(out, columns=["ok", "values", "numbers", "flags", "casts"])

    moved = joined.withColumn("__moved", move(F.col(payload), F.col("__route"))).where("__moved.ok")
    return moved.select(*id_cols, *[F.col(f"__moved.{c}").alias(c) for c in ("values", "numbers", "flags", "casts")])
