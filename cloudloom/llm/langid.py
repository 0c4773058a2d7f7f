"""Languages of documents and of their segments, by error-correcting output codes.

Each language has a codeword; for each bit a binary n-gram classifier (naive Bayes
log odds over hashed letter n-grams) says which half of the languages a text is in.
Loss-weighted decoding picks the codeword with the least loss; a small distance to
the runner-up marks the answer as ambiguous.

Training uses a bounded sample of labelled documents (``sample_docs``), whose wrong
labels are found by decoding the sample with the first model and dropping segments
that disagree. Everything else runs over all documents in one pass.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Names of each language (fixed values): two- and three-letter codes, English and own names.
NAMES = {
    "en": "en eng english",
    "de": "de deu ger german deutsch",
    "fr": "fr fra fre french français francais",
    "es": "es spa spanish español espanol castellano castilian",
    "pt": "pt por portuguese português portugues",
    "it": "it ita italian italiano",
    "nl": "nl nld dut dutch nederlands flemish",
    "pl": "pl pol polish polski",
}
MISSING = {"", "und", "unknown", "n/a"}
_BY_NAME = {n: code for code, names in NAMES.items() for n in names.split()}

_CELL = re.compile(r"^# %% \[(\w+)\][^\n]*$", re.M)
_NO_PROSE = re.compile(
    r"```.*?(?:```|\Z)|`[^`\n]*`|\$\$.*?\$\$|\$[^$\n]+\$|!?\[[^\]\n]*\]\([^)]*\)|<[^>\n]*>|(?:https?://|www\.|data:)\S+",
    re.S,
)
_BLANK = re.compile(r"\n\s*\n")
_LETTERS = re.compile(r"[^\W\d_]+")
_PLAIN = str.maketrans({"ł": "l", "ß": "ss", "ø": "o", "đ": "d", "æ": "ae", "œ": "oe", "ı": "i"})


def label_code(name: str | None) -> str | None:
    """Two-letter code of a label in any spelling, '' if the label is missing, else the lower-case label."""
    t = (name or "").strip().lower()
    if t in MISSING:
        return ""
    return _BY_NAME.get(t) or _BY_NAME.get(re.split(r"[-_ (]", t)[0]) or t


def markdown_cells(text: str) -> Iterable[tuple[int, str]]:
    """(cell number from 0, body) of the markdown cells."""
    heads = list(_CELL.finditer(text))
    for i, m in enumerate(heads):
        if m.group(1) == "markdown":
            yield i, text[m.end() : heads[i + 1].start() if i + 1 < len(heads) else len(text)]


def segments(body: str) -> list[str]:
    """The prose paragraphs of a cell; a heading or short line belongs to what follows."""
    out, held = [], ""
    for p in _BLANK.split(_NO_PROSE.sub(" ", body)):
        p = f"{held} {p}".strip() if held else p.strip()
        held = ""
        if not p:
            continue
        if len(_LETTERS.findall(p)) < 6:
            held = p
        else:
            out.append(p)
    if held:
        if out:
            out[-1] += " " + held
        else:
            out.append(held)
    return out


def plain_words(text: str) -> list[str]:
    """Lower-case words without diacritics, composed or not, so that spelling habits don't matter."""
    t = text.lower()
    if not t.isascii():
        t = "".join(c for c in unicodedata.normalize("NFKD", t.translate(_PLAIN)) if not unicodedata.combining(c))
    return _LETTERS.findall(t)


def word_features(word: str, dim: int) -> np.ndarray:
    """Hashed 1- to 4-grams of a word with its ends, and the word itself."""
    b = np.frombuffer(f"<{word}>".encode("utf-8", "replace"), np.uint8).astype(np.uint64)
    out, h = [], np.zeros(len(b), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, 5):
            m = len(b) - n + 1
            if m <= 0:
                break
            h = h[:m] * np.uint64(1_000_003) + b[n - 1 : n - 1 + m] + np.uint64(n)
            out.append(h)
        whole = np.uint64(7)
        for x in b:
            whole = whole * np.uint64(1_000_003) + x
        out.append(np.array([whole * np.uint64(31)]))
        mixed = np.concatenate(out) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(40)).astype(np.int64) % dim


def code_matrix(classes: int, bits: int, seed: int = 7) -> np.ndarray:
    """(classes, bits) of +-1: the draw of random balanced columns with the largest least distance."""
    rng = np.random.default_rng(seed)
    best, best_d = None, -1
    for _ in range(400):
        m = np.empty((classes, bits), np.int8)
        for j in range(bits):
            col = np.repeat([1, -1], [(classes + 1) // 2, classes // 2])
            m[:, j] = rng.permutation(col)
        d = min((m[a] != m[b]).sum() for a in range(classes) for b in range(a)) if classes > 1 else bits
        if d > best_d:
            best, best_d = m, d
    return best


class EcocModel:
    """Bit classifiers over hashed n-grams and a decoder. ``weights``: (dim, bits)."""

    def __init__(self, langs: Sequence[str], code: np.ndarray, weights: np.ndarray, trust: np.ndarray, scale: float):
        self.langs, self.code, self.weights, self.trust, self.scale = list(langs), code, weights, trust, scale
        self._known: dict[str, np.ndarray] = {}

    @classmethod
    def fit(cls, counts: np.ndarray, langs: Sequence[str], bits: int = 31, smooth: float = 0.5) -> EcocModel:
        """counts: (languages, dim) n-gram counts."""
        code = code_matrix(len(langs), bits)
        freq = (counts + smooth) / (counts + smooth).sum(1, keepdims=True)
        weights = np.empty((counts.shape[1], bits), np.float32)
        for j in range(bits):
            weights[:, j] = np.log(freq[code[:, j] > 0].mean(0)) - np.log(freq[code[:, j] < 0].mean(0))
        return cls(langs, code, weights, np.ones(bits), 1.0)

    def margins(self, text_words: Sequence[str]) -> np.ndarray | None:
        """Mean log odds of each bit over the words of a text; None without words."""
        if not text_words:
            return None
        known, total = self._known, np.zeros(self.weights.shape[1])
        if len(known) > 100_000:  # a memo, not a model: refilled from the weights
            known.clear()
        for w in text_words:
            v = known.get(w)
            if v is None:
                v = known[w] = self.weights[word_features(w, len(self.weights))].mean(0).astype(np.float64)
            total += v
        return total / len(text_words) * self.scale

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Trust-weighted logistic loss of each codeword."""
        return (np.logaddexp(0.0, -self.code * margins) * self.trust).sum(1) / self.trust.sum()

    def decode(self, text_words: Sequence[str], gap: float = 0.03) -> tuple[str, float, bool] | None:
        """(language, confidence, ambiguous) or None for a text without words."""
        m = self.margins(text_words)
        if m is None:
            return None
        loss = self.losses(m)
        order = np.argsort(loss, kind="stable")
        p = np.exp(-(loss - loss[order[0]]) * 20)
        near = len(loss) > 1 and loss[order[1]] - loss[order[0]] < gap
        return self.langs[order[0]], float(p[order[0]] / p.sum()), bool(near)

    def calibrate(self, texts: Sequence[tuple[str, Sequence[str]]]) -> None:
        """Set each bit's trust from its error on labelled texts, and the scale of margins."""
        rows = [(self.langs.index(lang), m) for lang, w in texts if lang in self.langs and (m := self.margins(w)) is not None]
        if not rows:
            return
        y = self.code[[r[0] for r in rows]]
        m = np.stack([r[1] for r in rows])
        error = np.clip(((m * y) <= 0).mean(0), 1e-3, 0.499)
        self.trust = np.log((1 - error) / error)
        self.scale *= float(2.0 / max(np.median(np.abs(m)), 1e-6))


def train(labelled: Sequence[tuple[str, str]], dim: int = 1 << 15, bits: int = 31, rounds: int = 2) -> EcocModel:
    """A model from (language, text); segments the model of the round before disagrees with are left out."""
    seen = [(lang, plain_words(t)) for lang, t in labelled if lang in NAMES]
    seen = [(lang, w) for lang, w in seen if w]
    langs = sorted({lang for lang, _ in seen}) or ["en", "de"]
    at = {lang: i for i, lang in enumerate(langs)}
    memo: dict[str, np.ndarray] = {}
    keep, model = seen, None
    for _ in range(rounds + 1):
        counts = np.zeros((len(langs), dim))
        of_lang = {lang: Counter() for lang in langs}
        for lang, ws in keep:
            of_lang[lang].update(ws)
        for lang, seen_words in of_lang.items():
            for w, n in seen_words.items():
                f = memo.get(w)
                if f is None:
                    f = memo[w] = word_features(w, dim)
                np.add.at(counts[at[lang]], f, n / len(f))
        model = EcocModel.fit(counts, langs, bits)
        keep = [(lang, ws) for lang, ws in seen if model.decode(ws)[0] == lang] or seen
    model.calibrate(keep)
    return model


def sample_labelled(docs: DataFrame, sample_docs: int, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample_words: int = 400) -> list[tuple[str, str]]:
    """(language, prose segment) of the ``sample_docs`` labelled documents with the least hashes.

    Prose is cut out on the workers; of a document at most ``sample_words`` words come, in
    whole segments of up to as many, so that the sample is bounded in bytes too. The bound is the
    training's alone: every document is decoded whole.
    """
    h = F.xxhash64(doc_id)
    known = docs.where(F.col(lang).isNotNull())
    last = known.select(h.alias("h")).orderBy("h").limit(max(sample_docs, 1)).agg(F.max("h")).first()[0]  # reads ids and labels
    if last is None:
        return []

    def prose(batches):
        for b in batches:
            out = []
            for t, name in zip(*(b.column(i).to_pylist() for i in range(2))):
                code, left = label_code(name), sample_words
                for s in (s for _, body in markdown_cells(t or "") for s in segments(body)) if code in NAMES else ():
                    w = _LETTERS.findall(s)[:left]
                    left -= len(w)
                    out += [(code, " ".join(w))] if w else []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["lang", "segment"])

    rows = known.where(h <= last).select(text, lang).mapInArrow(prose, "lang string, segment string")
    return [(r[0], r[1]) for r in rows.collect()]


def cell_languages(model: EcocModel, body: str, sure: float = 0.5, least_words: int = 8) -> list[tuple[int, str, float, bool, bool]]:
    """(segment number, language, confidence, ambiguous, counts) of every prose segment of a markdown cell.

    Below confidence ``sure`` a segment is ambiguous. Segments of fewer than
    ``least_words`` words or below ``sure`` do not count for the cell's languages; if none
    counts, the whole cell decoded at once does: as its one segment, or as segment -1.
    """
    parts = [plain_words(s) for s in segments(body)]
    found = [(i, len(w), model.decode(w)) for i, w in enumerate(parts) if w]
    out = [(i, lang, p, near or p < sure, n >= least_words and p >= sure) for i, n, (lang, p, near) in found]
    if len(out) == 1:
        out = [(*out[0][:4], True)]
    elif out and not any(r[4] for r in out):
        lang, p, near = model.decode([w for part in parts for w in part])
        out.append((-1, lang, p, near or p < sure, True))
    return out


_OUT = "doc_id bigint, cell_no int, segment int, lang string, confidence double, ambiguous boolean, counts boolean, label string, reason string"


def label_check(docs: DataFrame, sample_docs: int = 4000, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, cell_no, segment, lang, confidence, ambiguous, counts, label, reason) of every prose segment.

    ``reason``: 'missing' (no label), 'wrong' (the label's language is in no markdown
    cell), 'mixed' (several languages) or 'right', by the segments that count (see
    ``cell_languages``). Documents without markdown prose,
    null and empty texts have no rows; a repeated row is checked again and gives repeated
    rows. The label is compared by language, whatever its spelling.
    """
    model = train(sample_labelled(docs, sample_docs, doc_id, text, lang))
    shipped = docs.sparkSession.sparkContext.broadcast((model.langs, model.code, model.weights, model.trust, model.scale))  # of fixed size
    schema = pa.schema([("doc_id", pa.int64()), ("cell_no", pa.int32()), ("segment", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("ambiguous", pa.bool_()), ("counts", pa.bool_()), ("label", pa.string()), ("reason", pa.string())])

    def run(batches):
        m = EcocModel(*shipped.value)
        for b in batches:
            rows = []
            for d, t, label in zip(*(b.column(i).to_pylist() for i in range(3))):
                found = [(c, *r) for c, body in markdown_cells(t or "") for r in cell_languages(m, body)]
                langs = {r[2] for r in found if r[5]}
                code = label_code(label)
                reason = "missing" if not code else "wrong" if code not in langs else "mixed" if len(langs) > 1 else "right"
                rows += [(d, *r, code, reason) for r in found]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select(F.col(doc_id).cast("bigint"), F.col(text), F.col(lang)).mapInArrow(run, _OUT)


def flagged(checked: DataFrame) -> DataFrame:
    """(doc_id, cell_no, lang): the languages of each cell of documents with a missing, wrong or mixed label."""
    return checked.where((F.col("reason") != "right") & F.col("counts")).select("doc_id", "cell_no", "lang").distinct()
