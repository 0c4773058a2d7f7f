"""Differences between two copies of a table, cell by cell.

Both copies are hashed into buckets, the buckets are cogrouped as Arrow tables,
keys are aligned with a sorted search and the columns compared through
vectorised, null-aware masks; only the masked cells leave the worker.

Before the shuffle every Arrow batch drops repeats and superseded versions, so a
key that holds a third of all rows reaches its bucket as one row a batch.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from cloudloom.plans.sizing import MB, bucket_count, shuffle_partitions

ONLY_LEFT, ONLY_RIGHT, DIFFERS = "only_left", "only_right", "differs"


@dataclass(frozen=True)
class Compared:
    """A compared field. kind: "exact", "float" or "floats" (an array of floats).

    ``left`` and ``right`` are the expressions that read it; the name by default.
    """

    name: str
    kind: str = "exact"
    left: Column | None = None
    right: Column | None = None


def crc32_bits(text: Column) -> Column:
    """32 unsigned bits from decimal (also signed) or 0x-hexadecimal text; else null."""
    t = F.lower(F.trim(text.cast("string")))
    hexa = F.conv(F.regexp_extract(t, r"^0x([0-9a-f]{1,16})$", 1), 16, 10)
    number = F.when(t.startswith("0x"), hexa.try_cast("bigint")).otherwise(t.try_cast("bigint"))
    return number.bitwiseAND(F.lit(0xFFFFFFFF))


def _codes(columns: Sequence[pa.ChunkedArray]) -> np.ndarray:
    """Dense integer codes of composite keys; null is a key value of its own."""
    out = np.zeros(len(columns[0]), dtype=np.int64)
    for c in columns:
        if pa.types.is_integer(c.type) and not c.null_count:
            _, one = np.unique(c.to_numpy(), return_inverse=True)
        else:
            one = pc.dictionary_encode(c, null_encoding="encode").combine_chunks()
            one = (one if isinstance(one, pa.DictionaryArray) else one.chunk(0)).indices.to_numpy(zero_copy_only=False)
        _, out = np.unique(out * (int(one.max(initial=0)) + 1) + one, return_inverse=True)
    return out


def _latest(t: pa.Table, codes: np.ndarray) -> np.ndarray:
    """Row numbers, in order of code, of the valid row of each code."""
    rank = [t.column("__tie").to_numpy()]
    if "__version" in t.column_names:
        v = t.column("__version")
        rank.append(np.asarray(pc.fill_null(pc.cast(v, pa.int64()), np.iinfo(np.int64).min)))
    order = np.lexsort([*rank, codes])
    last = np.append(codes[order][1:] != codes[order][:-1], True) if len(order) else np.zeros(0, bool)
    return order[last]


def _combine(n_keys: int):
    """Per Arrow batch: only the latest row of each key goes on."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                t = pa.Table.from_batches([b])
                keep = _latest(t, _codes([t.column(f"__k{i}") for i in range(n_keys)]))
                yield from t.take(pa.array(np.sort(keep))).combine_chunks().to_batches()

    return run


def _flat(c: pa.ChunkedArray):
    """(values as doubles, null elements, starts, lengths, null lists) of a list column."""
    a = c.combine_chunks()
    a = a.chunk(0) if isinstance(a, pa.ChunkedArray) and a.num_chunks else a
    null = np.asarray(pc.is_null(a)).astype(bool)
    off = a.offsets.to_numpy()
    length = np.where(null, 0, np.diff(off))
    v = a.values
    return v.cast(pa.float64()).to_numpy(zero_copy_only=False), np.asarray(pc.is_null(v)).astype(bool), off[:-1], length, null


def _near(a: np.ndarray, b: np.ndarray, tol: float) -> np.ndarray:
    with np.errstate(invalid="ignore", over="ignore"):
        close = np.abs(a - b) <= tol * np.maximum(1.0, np.maximum(np.abs(a), np.abs(b)))
    return (a == b) | (np.isnan(a) & np.isnan(b)) | (close & np.isfinite(a) & np.isfinite(b))


def _unlike(kind: str, a: pa.ChunkedArray, b: pa.ChunkedArray, tol: float) -> np.ndarray:
    """Mask of the aligned rows whose values differ; null equals null only."""
    if kind == "floats":
        va, na, sa, la, xa = _flat(a)
        vb, nb, sb, lb, xb = _flat(b)
        bad = (xa != xb) | (la != lb)
        length = np.where(bad, 0, la)
        row = np.repeat(np.arange(len(length)), length)
        step = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
        i, j = sa[row] + step, sb[row] + step
        same = np.where(na[i] | nb[j], na[i] & nb[j], _near(va[i], vb[j], tol))
        return bad | (np.bincount(row[~same], minlength=len(length)) > 0)
    na, nb = np.asarray(pc.is_null(a)).astype(bool), np.asarray(pc.is_null(b)).astype(bool)
    if kind == "float":
        same = _near(a.cast(pa.float64()).to_numpy(), b.cast(pa.float64()).to_numpy(), tol)
    else:
        same = np.asarray(pc.fill_null(pc.equal(a, b), False)).astype(bool)
    return ~np.where(na | nb, na & nb, same)


def _bucket(n_keys: int, fields: Sequence[tuple[str, str]], tol: float, key_types: pa.Schema):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [f"__k{i}" for i in range(n_keys)]
        both = _codes([pa.chunked_array([*left.column(k).chunks, *right.column(k).chunks], type=left.schema.field(k).type) for k in names])
        lc, rc = both[: left.num_rows], both[left.num_rows :]
        li, ri = _latest(left, lc), _latest(right, rc)
        lc, rc = lc[li], rc[ri]
        at = np.minimum(np.searchsorted(rc, lc), max(len(rc) - 1, 0))
        hit = rc[at] == lc if len(rc) else np.zeros(len(lc), bool)
        only_right = np.ones(len(rc), bool)
        only_right[at[hit]] = False
        out = []

        def emit(t: pa.Table, rows: np.ndarray, field: str, kind: str) -> None:
            if len(rows):
                keys = [t.column(k).take(pa.array(rows)) for k in names]
                out.append(pa.table([*keys, pa.array([field] * len(rows)), pa.array([kind] * len(rows))], names=[*names, "field", "kind"]))

        emit(left, li[~hit], "", ONLY_LEFT)
        emit(right, ri[only_right], "", ONLY_RIGHT)
        a, b = li[hit], ri[at[hit]]
        if len(a):
            for i, (name, kind) in enumerate(fields):
                bad = _unlike(kind, left.column(f"__f{i}").take(pa.array(a)), right.column(f"__f{i}").take(pa.array(b)), tol)
                emit(left, a[bad], name, DIFFERS)
        return pa.concat_tables([t.cast(key_types) for t in out]) if out else key_types.empty_table()

    return run


def compare_copies(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    fields: Sequence[Compared],
    version: str | None = None,
    tolerance: float = 1e-5,
    buckets: int | None = None,
) -> DataFrame:
    """(keys..., field, kind): one row per missing record or differing field.

    Of one key only the row with the latest ``version`` counts (null version:
    earliest; ties: the row with the greatest content hash), repeats count once.
    Floats are equal within ``tolerance * max(1, |a|, |b|)``; null equals null,
    NaN equals NaN, null and NaN differ; infinities equal themselves only. Null is
    a key value like any other. Empty tables: every record of the other side is
    missing. Columns that are not named are not read, so clashing extras are harmless.
    """
    n = buckets or bucket_count(left, right, target=8 * MB)
    parts = min(n, max(shuffle_partitions(left), min(n, 100_000)))  # beyond, a partition has more buckets; a task holds one at a time

    def side(df: DataFrame, right_side: bool) -> DataFrame:
        read = [(f.right if right_side else f.left) if (f.right if right_side else f.left) is not None else F.col(f.name) for f in fields]
        cols = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
        cols += [c.alias(f"__f{i}") for i, c in enumerate(read)]
        if version:
            cols.append(F.unix_micros(F.col(version).cast("timestamp")).alias("__version") if dict(df.dtypes)[version].startswith("timestamp") else F.col(version).cast("bigint").alias("__version"))
        d = df.select(*cols)
        d = d.select(
            F.pmod(F.xxhash64(*[f"__k{i}" for i in range(len(keys))]), F.lit(n)).cast("int").alias("__bucket"),
            "*",
            F.xxhash64(*[f"__f{i}" for i in range(len(fields))]).alias("__tie"),
        )
        # as many partitions as the buckets need: left to itself, the planner puts them together again
        return d.mapInArrow(_combine(len(keys)), d.schema).repartition(parts, "__bucket").groupBy("__bucket")

    types = [left.schema[k].dataType for k in keys]
    schema = T.StructType([T.StructField(f"__k{i}", t) for i, t in enumerate(types)] + [T.StructField("field", T.StringType()), T.StructField("kind", T.StringType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    run = _bucket(len(keys), [(f.name, f.kind) for f in fields], tolerance, to_arrow_schema(schema))
    found = side(left, False).cogroup(side(right, True)).applyInArrow(run, schema)
    return found.select(*[F.col(f"__k{i}").alias(k) for i, k in enumerate(keys)], "field", "kind")
