"""Evaluation passages inside a training corpus, by winnowing.

The fingerprints of a text are the minimal k-gram hashes of all windows of w
consecutive k-grams; with k + w - 1 = n any shared run of n words has a fingerprint
in common. Corpus fingerprints are joined with those of the items, every hit is
extended to the maximal shared run, and runs of n words that stand in more than one
item do not count.

Few items (at most ``broadcast_items`` and ``broadcast_bytes``, which is checked) travel to the corpus: one
pass over the documents, no shuffle of texts. More items are joined by fingerprint
with a shuffle; both ways give the same rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

#: A word is a maximal run of letters or digits.
WORD = re.compile(r"[^\W_]+")
_MULT = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def word_hash(w: str) -> int:
    return xxhash.xxh64_intdigest(w) | 1


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive word hashes; ``_NONE`` where a word is unknown (0)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g, bad = np.zeros(n, np.uint64), np.zeros(n, bool)
    with np.errstate(over="ignore"):
        for j in range(k):
            part = h[j : j + n]
            g = (g ^ (g >> np.uint64(31))) * _MULT + part
            bad |= part == 0
    g[bad] = _NONE
    return g


def winnow(g: np.ndarray, w: int) -> np.ndarray:
    """Positions of the grams that are minimal in some window of w known grams."""
    n = len(g) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low, known = g[:n].copy(), g[:n] != _NONE
    for j in range(1, w):
        np.minimum(low, g[j : j + n], out=low)
        known &= g[j : j + n] != _NONE
    picked = np.zeros(len(g), bool)
    for j in range(w):
        picked[j : j + n] |= known & (g[j : j + n] == low)
    return np.flatnonzero(picked)


class ItemIndex:
    """Fingerprints of a bounded set of items, and which of their n-word runs are their own."""

    def __init__(self, items: Iterable[tuple[int, str]], n: int, k: int):
        self.n, self.k, self.w = n, k, n - k + 1
        self.ids: list[int] = []
        self.vocab: dict[str, int] = {}
        self.words: list[np.ndarray] = []
        for i, text in items:
            if i is not None and text is not None:
                ws = words(text)
                self.ids.append(i)
                self.words.append(np.array([self.vocab.setdefault(x, len(self.vocab) + 1) for x in ws], np.int64))
        self.hash = np.array([0, *map(word_hash, self.vocab)], np.uint64)
        owner: dict[bytes, int] = {}
        for i, a in zip(self.ids, self.words):
            for s in range(len(a) - n + 1):
                run = a[s : s + n].tobytes()
                owner[run] = i if owner.get(run, i) == i else -1
        self.own = [np.array([owner[a[s : s + n].tobytes()] != -1 for s in range(len(a) - n + 1)], bool) for a in self.words]
        fp, at = [], []
        for x, a in enumerate(self.words):
            g = gram_hashes(self.hash[a], k)
            p = winnow(g, self.w)
            fp.append(g[p])
            at += [(x, q) for q in p]
        allfp = np.concatenate(fp) if fp else np.zeros(0, np.uint64)
        order = np.argsort(allfp, kind="stable")
        self.fp, self.at = allfp[order], [at[o] for o in order]

    def hits(self, ids: np.ndarray) -> Iterable[tuple[int, int, int, int]]:
        """(item number, item position, text position, length) of maximal shared runs of n words or more."""
        g = gram_hashes(self.hash[ids], self.k)
        pos = winnow(g, self.w)
        if not len(pos) or not len(self.fp):
            return
        lo, hi = np.searchsorted(self.fp, g[pos]), np.searchsorted(self.fp, g[pos], side="right")
        done: dict[tuple[int, int], int] = {}
        for p, a, b in zip(pos[hi > lo], lo[hi > lo], hi[hi > lo]):
            for x, q in self.at[a:b]:
                if done.get((x, p - q), -1) >= p:
                    continue
                item = self.words[x]
                left = min(p, q)
                back = np.flatnonzero(ids[p - left : p][::-1] != item[q - left : q][::-1])
                left = int(back[0]) if len(back) else left
                right = min(len(ids) - p, len(item) - q)
                ahead = np.flatnonzero(ids[p : p + right] != item[q : q + right])
                right = int(ahead[0]) if len(ahead) else right
                done[x, p - q] = p + max(right, 1)
                if left + right >= self.n:
                    yield x, q - left, p - left, left + right

    def leaks(self, ids: np.ndarray) -> dict[int, tuple[int, int]]:
        """item id -> (longest run with a run of its own, its position) within one text."""
        out: dict[int, tuple[int, int]] = {}
        for x, q, p, length in self.hits(ids):
            if self.own[x][q : q + length - self.n + 1].any() and length > out.get(self.ids[x], (0, 0))[0]:
                out[self.ids[x]] = (length, p)
        return out


_OUT = "doc_id bigint, item_id bigint, run_words int, at_word int"


def find_leaks(docs: DataFrame, items: DataFrame, n: int = 12, k: int = 8, broadcast_items: int = 20_000, broadcast_bytes: int = 64 << 20, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, run_words, at_word): for each document and leaked item the longest run.

    Words are maximal runs of letters or digits, case ignored, across any markup that
    adds no words. Null or short texts leak nothing; repeated rows count once; without
    items or documents the result is empty. Documents and items need integer ids.
    """
    if not 1 <= k <= n:
        raise ValueError("k-grams must not be longer than the runs they find")
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    items = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(item_text).alias("item_text")).where(F.col("item_text").isNotNull())
    size = items.select(F.octet_length("item_text").alias("b")).limit(broadcast_items + 1).agg(F.count("*"), F.coalesce(F.sum("b"), F.lit(0))).first()
    if size[0] > broadcast_items or size[1] > broadcast_bytes:
        return _joined(docs, items, n, k)
    shipped = docs.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in items.distinct().collect()])
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("run_words", pa.int32()), ("at_word", pa.int32())])

    def run(batches):
        index = ItemIndex(shipped.value, n, k)
        get = index.vocab.get
        for b in batches:
            rows = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.fromiter((get(w, 0) for w in words(t)), np.int64)
                rows += [(d, i, length, p) for i, (length, p) in index.leaks(ids).items()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return _longest(docs.mapInArrow(run, _OUT))


def _longest(found: DataFrame) -> DataFrame:
    best = F.max(F.struct("run_words", (-F.col("at_word")).alias("p"))).alias("m")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "m.run_words", (-F.col("m.p")).cast("int").alias("at_word"))


def fingerprints(df: DataFrame, key: str, text: str, n: int, k: int) -> DataFrame:
    """(key, fp): the distinct winnowed fingerprints of each text."""
    schema = pa.schema([(key, pa.int64()), ("fp", pa.int64())])

    def run(batches):
        for b in batches:
            ids, fps = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                g = gram_hashes(np.fromiter(map(word_hash, words(t)), np.uint64), k)
                f = np.unique(g[winnow(g, n - k + 1)])
                ids.append(np.full(len(f), i, np.int64))
                fps.append(f.view(np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(fps))], schema=schema)

    return df.select(key, text).mapInArrow(run, f"{key} bigint, fp bigint")


def _joined(docs: DataFrame, items: DataFrame, n: int, k: int) -> DataFrame:
    """The way without broadcast: candidate pairs of texts by fingerprint, then each pair is extended.

    Texts are keyed by their hash, so documents with null or repeated ids and items of
    several texts stay apart; a shared hash only makes one more pair to extend.
    """
    docs = docs.withColumn("dh", F.xxhash64("text"))
    items = items.distinct().withColumn("ih", F.xxhash64("item_text"))
    pairs = fingerprints(docs.select("dh", "text"), "dh", "text", n, k).join(fingerprints(items.select("ih", "item_text"), "ih", "item_text", n, k), "fp").select("dh", "ih").distinct()
    schema = pa.schema([("item_id", pa.int64()), ("ih", pa.int64()), ("run", pa.binary()), ("at", pa.int32())])

    def runs(batches):
        for b in batches:
            for i, ih, t in zip(*(b.column(j).to_pylist() for j in range(3))):
                h = np.fromiter(map(word_hash, words(t)), np.uint64)
                m = max(len(h) - n + 1, 0)
                yield pa.RecordBatch.from_arrays([pa.array([i] * m, pa.int64()), pa.array([ih] * m, pa.int64()), pa.array([h[s : s + n].tobytes() for s in range(m)], pa.binary()), pa.array(range(m), pa.int32())], schema=schema)

    each = items.where(F.col("item_id").isNotNull()).select("item_id", "ih", "item_text").mapInArrow(runs, "item_id bigint, ih bigint, run binary, at int")
    shared = each.groupBy("run").agg(F.min("item_id").alias("a"), F.max("item_id").alias("b")).where("a < b").select("run")
    common = each.join(shared, "run", "left_semi").groupBy("item_id", "ih").agg(F.collect_set("at").alias("common"))
    side = items.where(F.col("item_id").isNotNull()).join(common, ["item_id", "ih"], "left")

    @F.pandas_udf("struct<run_words:int,at_word:int>")
    def extend(t: pd.Series, item: pd.Series, common: pd.Series) -> pd.DataFrame:
        out = []
        for a, b, c in zip(t, item, common):
            index = ItemIndex([(0, b)], n, k)
            if c is not None:
                own = index.own[0]
                own[np.asarray(c, dtype=np.int64)] = False
            best = index.leaks(np.fromiter((index.vocab.get(w, 0) for w in words(a)), np.int64)).get(0)
            out.append(best or (None, None))
        return pd.DataFrame(out, columns=["run_words", "at_word"]).astype("Int32")

    checked = pairs.join(docs, "dh").join(side, "ih").select("doc_id", "item_id", extend("text", "item_text", "common").alias("m"))
    return _longest(checked.select("doc_id", "item_id", "m.*").where(F.col("run_words").isNotNull()))
