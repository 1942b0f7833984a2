"""Toxicity of whole texts, after undoing disguises as a noisy channel.

A character model (four letters, folded to a-z) is counted over all documents. Tokens that look disguised, by digits
or signs among letters, letters spaced or dotted apart, or any letter doubled, become a lattice of what each
sign may stand for; the Viterbi path under the character model and the channel's costs restores them. A logistic
model over the presence of words and word beginnings in the restored text gives the score.

The logistic model is fitted on at most ``TRAIN_ROWS`` labelled rows; the character model and the scores cover all rows.
Null and empty texts get the score of a text without evidence. Without labels, or with one class only, every score is
the share of label 1 among the training rows (0 without any). Rows without a label, or with a null one, are only scored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import byte_batches, record_batch, schema, strings

TRAIN_ROWS = 10_000
MIN_TOXIC_SHARE = 0.004  # of the toxic training rows that must show a feature
MIN_PRECISION = 0.3
CACHED_WORDS = 150_000  # per worker; the cache starts afresh beyond it, which changes no result
SYMBOLS = 32  # 0: border, 1-26: letters, 27: other letters

# What a sign may stand for.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¢": "c", "¡": "i",
}
SEPARATORS = " .-_*~/\\·•,:;'`^#=&%\"<>[]{}?)"
# Channel costs in nats.
COST_SIGN, COST_NOT_A_LETTER, COST_REPEAT, COST_SEPARATOR, COST_BORDER = 1.0, 4.0, 2.5, 0.5, 3.0

GRAMS = schema("gram int, n long")
FEATURES = schema("feature string, n long, toxic long")
DESIGN = schema("toxic int, features array<int>")


def _folded(c: str) -> str:
    base = unicodedata.normalize("NFKD", c.lower())[:1]
    return base if "a" <= base <= "z" else ""


FOLD = {cp: _folded(chr(cp)) or chr(cp) for cp in range(0xC0, 0x250)} | {0xDF: "s", 0xE6: "a", 0xF8: "o"}
SYMBOL = np.zeros(0x250, dtype=np.int32)
for _cp in range(0x250):
    _letter = FOLD.get(_cp, chr(_cp).lower())
    SYMBOL[_cp] = ord(_letter) - 96 if "a" <= _letter <= "z" else 27 if chr(_cp).isalpha() else 0


def symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
    return np.where(points < 0x250, SYMBOL[np.minimum(points, 0x24F)], 27)


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SYMBOLS**4, dtype=np.int64)
    for batch in byte_batches(batches, "text", 1 << 20):
        s = symbols("\n\n\n".join(["", *strings(batch.column("text")), ""]))
        total += np.bincount(((s[:-3] * SYMBOLS + s[1:-2]) * SYMBOLS + s[2:-1]) * SYMBOLS + s[3:], minlength=SYMBOLS**4)
    seen = np.flatnonzero(total)
    yield record_batch(GRAMS, [seen.astype(np.int32), total[seen]])


def character_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Log probability of a symbol after three others, from all texts; at most ``SYMBOLS ** 4`` counts reach the driver."""
    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_count_grams, GRAMS)
    found = rows.groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(SYMBOLS**4)
    counts[found["gram"].to_numpy()] = found["n"].to_numpy()
    counts = counts.reshape([SYMBOLS] * 4)
    lower = np.full([1] * 4, 1 / SYMBOLS)
    for order in range(1, 5):  # each order falls back on the shorter one
        own = counts.sum(axis=tuple(range(4 - order)), keepdims=True)
        lower = (own + 20 * lower) / (own.sum(axis=3, keepdims=True) + 20)
    return np.log(lower).astype(np.float32)


# Letters beside signs that may stand for letters, or single letters held apart by signs.
DISGUISED = re.compile(
    r"(?=.*[^\W\d_])(?:.*[^\W_][0-9@$!|+(€£¢¡]|.*[0-9@$!|+(€£¢¡][^\W_]|(?:\S[.\-_*~/·•]+){2,}\S)", re.S
)
# A doubled letter, or letters with signs between them.
_SIGNS = re.escape(SEPARATORS + "".join(STANDS_FOR))
REPEATED = re.compile(rf"([a-z\u00c0-\u024f])\1|[^\W\d_][{_SIGNS}]+[^\W\d_]")
EDGE = " \t.,;:?\"'()[]{}<>*&%#=~_-`^/\\|"
AT_END = EDGE + "!$@+"
# Single signs held apart by any white space; marks may stand before the first and after any of them.
_BEFORE, _AFTER = f"[{re.escape(EDGE.replace(' ', '').replace(chr(9), ''))}]*", f"[{re.escape(AT_END.replace(' ', '').replace(chr(9), ''))}]*"
APART = re.compile(rf"(?<!\S){_BEFORE}\S(?:\s+\S){{2,}}{_AFTER}(?!\S)")


def restore(token: str, model: np.ndarray) -> list[str]:
    """The likeliest words behind a token.

    All states are kept, each being the last three symbols; a path is a chain of its signs, the last one first.
    """
    best: dict[tuple[int, int, int], tuple[float, tuple]] = {(0, 0, 0): (0.0, ())}
    previous = ""
    for sign in token.lower().translate(FOLD):
        options: list[tuple[int, float]] = []  # symbol (-1: nothing), cost
        if "a" <= sign <= "z":
            options.append((ord(sign) - 96, 0.0))
            if sign == previous:
                options.append((-1, COST_REPEAT))
        elif sign in STANDS_FOR:
            options += [(ord(c) - 96, COST_SIGN) for c in STANDS_FOR[sign]]
            options.append((0, COST_NOT_A_LETTER))
            if sign == previous:
                options.append((-1, COST_REPEAT))
        elif sign in SEPARATORS:
            options += [(-1, COST_SEPARATOR), (0, COST_BORDER)]
        else:
            options.append((27 if sign.isalpha() else 0, 0.0))
        if sign not in SEPARATORS:
            previous = sign
        reached: dict[tuple[int, int, int], tuple[float, tuple]] = {}
        for (a, b, c), (score, path) in best.items():
            row = model[a, b, c]
            for symbol, cost in options:
                if symbol < 0:
                    key, value, more = (a, b, c), score - cost, path
                elif symbol == 0 and c == 0:
                    key, value, more = (a, b, c), score - cost, path
                else:
                    key, value = (b, c, symbol), score - cost + float(row[symbol])
                    more = (chr(96 + symbol) if 0 < symbol < 27 else " " if symbol == 0 else "?", path)
                if key not in reached or reached[key][0] < value:
                    reached[key] = (value, more)
        best = reached
    _, path = max(((score + float(model[k][0]), path) for k, (score, path) in best.items()), key=lambda end: end[0])
    signs = []
    while path:
        sign, path = path
        signs.append(sign)
    return "".join(reversed(signs)).split()


def word_features(word: str) -> list[str]:
    """A folded word and its beginnings."""
    return [word, *(word[:n] + "~" for n in (4, 5, 6) if len(word) > n)]


@dataclass
class Reader:
    """Turns texts into features, with a cache of words."""

    model: np.ndarray
    index: dict[str, int] | None = None  # features that count; all if None
    telling: dict[str, tuple] = field(default_factory=dict)
    others: set[str] = field(default_factory=set)  # words without a feature that counts

    def _of(self, words: list[str]) -> set:
        found = {f for w in words for f in word_features(w)}
        return found if self.index is None else {self.index[f] for f in found if f in self.index}

    def _word(self, word: str) -> tuple:
        plain = word.lstrip(EDGE).rstrip(AT_END)
        if not plain:
            return ()
        words = [plain if plain.isascii() else plain.translate(FOLD)]
        if REPEATED.search(plain) or (not plain.isalpha() and DISGUISED.match(plain)):
            words += restore(plain, self.model)
        return tuple(self._of(words))

    def features(self, text: str) -> set:
        text = text.lower()
        found: set = set()
        for word in set(text.split()) - self.others:
            own = self.telling.get(word)
            if own is None:
                own = self._word(word)
                if len(self.telling) + len(self.others) >= CACHED_WORDS:
                    self.telling.clear()
                    self.others.clear()
                if own:
                    self.telling[word] = own
                else:
                    self.others.add(word)
            found.update(own)
        for run in APART.finditer(text):
            signs = [s.lstrip(EDGE).rstrip(AT_END) or s for s in run[0].split()]
            if len(set(signs)) > 1:  # not one sign over and over
                found |= self._of(restore(" ".join(signs), self.model))
        return found


@dataclass(frozen=True)
class Model:
    """A fitted scorer, small enough to be sent to every task."""

    characters: np.ndarray
    index: dict[str, int]
    weights: np.ndarray
    bias: float

    def score(self, found: set) -> float:
        return float(1 / (1 + np.exp(-(self.bias + sum(self.weights[f] for f in found)))))


def _train_features(characters: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(characters)
        seen: Counter = Counter()
        toxic: Counter = Counter()

        def flush() -> pa.RecordBatch:
            rows = [list(seen), list(seen.values()), [toxic[f] for f in seen]]
            seen.clear()
            toxic.clear()
            return record_batch(FEATURES, rows)

        for batch in byte_batches(batches, "text"):
            for text, label in zip(strings(batch.column("text")), batch.column("toxic").to_pylist(), strict=True):
                found = reader.features(text)
                seen.update(found)
                if label:
                    toxic.update(found)
            if len(seen) > 200_000:
                yield flush()
        if seen:
            yield flush()

    return run


def _design(characters: np.ndarray, index: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(characters, index)
        for batch in byte_batches(batches, "text"):
            found = [sorted(reader.features(t)) for t in strings(batch.column("text"))]
            yield record_batch(DESIGN, [batch.column("toxic"), found])

    return run


def _logistic(rows: list[list[int]], labels: np.ndarray, n: int, ridge: float = 1e-5, steps: int = 1500):
    """Weights and bias by accelerated gradient steps."""
    size = np.array([len(r) for r in rows], dtype=np.int64)
    doc = np.repeat(np.arange(len(rows)), size)
    feature = np.array([f for r in rows for f in r], dtype=np.int64)
    prior = labels.mean()
    w, b = np.zeros(n), float(np.log(prior / (1 - prior)))
    v, c, rate = w.copy(), b, 4.0 / (1 + size.max(initial=0))
    for step in range(steps):
        z = c + np.bincount(doc, weights=v[feature], minlength=len(rows))
        error = 1 / (1 + np.exp(-z)) - labels
        gradient = np.bincount(feature, weights=error[doc], minlength=n) / len(rows) + ridge * v
        w_next, b_next = np.maximum(v - rate * gradient * 8, -2), c - rate * error.mean()
        push = step / (step + 3)
        v, c, w, b = w_next + push * (w_next - w), b_next + push * (b_next - b), w_next, b_next
    # Where the classes lie apart the border belongs midway, not beside the rarer class.
    z = b + np.bincount(doc, weights=w[feature], minlength=len(rows))
    clean, toxic = np.quantile(z[labels == 0], 0.999), np.quantile(z[labels == 1], 0.002)
    return w, b - (clean + toxic) / 2 if clean < toxic else b


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    train_rows: int = TRAIN_ROWS,
) -> Model:
    """Learn from labelled rows whose ``crc32(id as text) mod 5`` is not 0, at most ``train_rows`` of them."""
    characters = character_model(docs, text_col)
    key = F.col(id_col).cast("string")
    chosen = (
        labels.filter(F.col(label_col).isNotNull() & (F.crc32(key.cast("binary")) % 5 != 0))
        .select(F.col(id_col).alias("label_id"), F.col(label_col).cast("int").alias("toxic"))
        .orderBy(F.xxhash64("label_id"), "label_id", "toxic")
        .limit(train_rows)
    )
    train = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    train = train.join(F.broadcast(chosen), F.col("id") == F.col("label_id")).select("text", "toxic")
    found = train.mapInArrow(_train_features(characters), FEATURES).groupBy("feature")
    found = found.agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    total = chosen.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    n_toxic = total["toxic"] or 0
    if not n_toxic or n_toxic == total["n"]:
        share = n_toxic / total["n"] if total["n"] else 0.0
        return Model(characters, {}, np.zeros(0), float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    support = max(3, MIN_TOXIC_SHARE * n_toxic)
    useful = found.filter((F.col("toxic") >= support) & (F.col("toxic") >= MIN_PRECISION * F.col("n")))
    index = {r["feature"]: i for i, r in enumerate(useful.orderBy("feature").collect())}
    rows = train.mapInArrow(_design(characters, index), DESIGN).collect()
    y = np.array([r["toxic"] for r in rows], dtype=float)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        return Model(characters, {}, np.zeros(0), float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    weights, bias = _logistic([list(r["features"]) for r in rows], y, len(index))
    return Model(characters, index, weights, bias)


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """``docs`` with the score of each whole text; a column of that name is replaced."""
    docs = docs.drop(score_col)
    kind = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model.characters, model.index)
        for batch in byte_batches(batches, text_col):
            values = [model.score(reader.features(t)) for t in strings(batch.column(text_col))]
            yield record_batch(kind, [*batch.columns, values])

    return docs.mapInArrow(run, kind)
