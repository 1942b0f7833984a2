"""Spelling variants: words one edit apart, found by dense prefix-suffix tiling.

Two words are near when exactly one code point is inserted, deleted or replaced between them, that is when their common
prefix and common suffix together reach the longer length minus one. Let ``m`` be the shorter length. The edit lies
in one window of positions ``lo`` to ``hi`` of the shorter word, and outside it the two words are equal, so words are grouped by what lies
outside: first by either half of ``m``. A group too large for a tile has its window halved again, until a window is one
position wide; such a group holds at most a letter (or two) of variety. So every tile is bounded, no word is copied
more than twice per halving, and nothing is left out. A tile is compared as padded matrices of code points, words of length
``m`` with each other and with those of length ``m + 1``. Each pair is counted in the one window that holds its first difference.

Null texts have no words. Words are told apart by their code points; no case or accent is folded. No words: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import landed, record_batch, schema

TILE_CELLS = 1 << 14  # code points of a tile inside its window
PAIRS = 1 << 18  # pairs compared at once inside a task
LETTERS = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GROUP = ["m", "lo", "hi", "rest"]
NEAR = schema("word string, other string, other_n long")


def letter_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 6) -> DataFrame:
    """``id`` and ``run``: every maximal run of at least ``shortest`` letters, A-Z lower-cased."""
    text = F.translate(F.col(text_col).cast("string"), UPPER, LOWER)
    # A shorter run cannot match, and a longer one matches from its first letter on, so matches are maximal runs.
    found = F.regexp_extract_all(text, F.lit(f"{LETTERS}{{{shortest},}}+"), F.lit(0))
    return docs.select(F.col(id_col).alias("id"), F.explode(found).alias("run"))


def without_point(word: Column, place: Column) -> Column:
    """``word`` without its code point at ``place`` (from 0)."""
    return F.concat(F.substring(word, F.lit(1), place), F.substring(word, place + 2, F.length(word)))


def word_counts(words: DataFrame, shortest: int = 6, least: int = 5) -> DataFrame:
    """``word`` and ``n`` of words of at least ``shortest`` code points that occur ``least`` times or more."""
    counts = words.filter(F.length("word") >= shortest).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") >= least)


def _rest() -> Column:
    """What of a word lies outside its group's window."""
    after = F.col("m") - F.col("hi")
    suffix = F.when(after > 0, F.substring("word", F.length("word") - after + 1, after)).otherwise("")
    return F.concat(F.substring("word", F.lit(1), F.col("lo")), suffix).alias("rest")


def _halved(rows: DataFrame) -> DataFrame:
    """Every row once for each half of its window."""
    middle = F.expr("(lo + hi) div 2")
    halves = F.array(
        F.struct(F.col("lo").alias("lo"), middle.cast("int").alias("hi")),
        F.struct(middle.cast("int").alias("lo"), F.col("hi").alias("hi")),
    )
    out = rows.select("word", "n", "m", F.explode(halves).alias("w")).select("word", "n", "m", "w.lo", "w.hi")
    return out.filter("lo < hi").select("*", _rest())


def tiles(words: DataFrame, cells: int = TILE_CELLS) -> DataFrame:
    """Groups of words that may hold near ones: ``m, lo, hi, words``, the last an array of (``word``, ``n``)."""
    length = F.length("word")
    # A word takes part as the shorter (or equal) one, and as the longer one of words one code point shorter.
    as_either = F.explode(F.array(length, length - 1)).alias("m")
    whole = words.select("word", "n", as_either).filter("m > 0").select("*", F.lit(0).alias("lo"), F.col("m").alias("hi"))
    rows, found = _halved(whole), []
    while True:
        rows = landed(rows, "spelling-rows")
        groups = rows.groupBy(*GROUP).agg(
            F.count(F.lit(1)).alias("size"), F.count_if(F.length("word") == F.col("m")).alias("shorter")
        )
        groups = groups.filter("size > 1 AND shorter > 0")
        groups = landed(groups.withColumn("fits", F.expr(f"hi - lo = 1 OR size * (hi - lo + 1) <= {cells}")), "spelling-groups")
        # Written before they are collected: a group too large is only ever joined, which adaptive execution splits.
        kept = landed(rows.join(groups.select(*GROUP, "fits"), GROUP), "spelling-kept")
        fitting = kept.filter("fits").groupBy(*GROUP).agg(F.collect_list(F.struct("word", "n")).alias("words"))
        found.append(fitting.select("m", "lo", "hi", "words"))
        if not groups.filter("NOT fits").head(1):
            break
        rows = _halved(kept.filter("NOT fits").drop("fits", "rest"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


@lru_cache(maxsize=512)
def _upper_pairs(count: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(count, 1)


def _matrices(parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the parts, padded on the right and on the left, and the parts' lengths."""
    size = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    width = int(size.max(initial=0))
    column = np.arange(width)
    left, right = np.zeros((len(parts), width), dtype=np.uint32), np.zeros((len(parts), width), dtype=np.uint32)
    left[column < size[:, None]] = points
    right[column >= width - size[:, None]] = points
    return left, right, size


def _first_difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    differ = a != b
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


def near_in_tiles(parts: list[str], pairs: list[tuple[np.ndarray, np.ndarray]], to_end: np.ndarray) -> np.ndarray:
    """Which of the pairs are near, given the words' parts inside their windows; the first of a pair is not the longer.

    ``to_end`` says of each word whether its window reaches the end of the shorter length; elsewhere a pair
    whose first difference lies behind the window belongs to another one.
    """
    left, right, size = _matrices(parts)
    a, b = (np.concatenate(side) for side in zip(*pairs, strict=True))
    out = np.zeros(len(a), dtype=bool)
    step = max(1, 8 * PAIRS // max(1, left.shape[1]))
    for at in range(0, len(a), step):
        i, j = a[at : at + step], b[at : at + step]
        prefix = np.minimum(_first_difference(left[i], left[j]), size[i])
        suffix = np.minimum(_first_difference(right[i, ::-1], right[j, ::-1]), size[i])
        near = prefix + suffix >= size[j] - 1
        out[at : at + step] = near & ((prefix < size[i]) | to_end[i])
    return out


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: list[str] = []
    words: list[str] = []
    counts: list[int] = []
    to_end: list[bool] = []
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    held, widest = 0, 0

    def close() -> pa.RecordBatch:
        nonlocal held, widest
        near = near_in_tiles(parts, pairs, np.array(to_end))
        a, b = (np.concatenate(side)[near].tolist() for side in zip(*pairs, strict=True))
        rows = [[words[i] for i in a + b], [words[i] for i in b + a], [counts[i] for i in b + a]]
        for kept in (parts, words, counts, to_end, pairs):
            kept.clear()
        held = widest = 0
        return record_batch(NEAR, rows)

    for batch in batches:
        for tile in batch.to_pylist():
            m, lo, hi = tile["m"], tile["lo"], tile["hi"]
            # Widths differ between tiles; a narrow tile is not padded to the width of a much wider one.
            if parts and (len(parts) * max(widest, hi - lo + 1) > 64 * TILE_CELLS or held > PAIRS):
                yield close()
            first = len(parts)
            for member in tile["words"]:
                word = member["word"]
                words.append(word)
                counts.append(member["n"])
                parts.append(word[lo : len(word) - (m - hi)])
            to_end += [hi == m] * (len(parts) - first)
            shorter = np.array([i for i in range(first, len(parts)) if len(words[i]) == m], dtype=np.int64)
            longer = np.array([i for i in range(first, len(parts)) if len(words[i]) > m], dtype=np.int64)
            i, j = _upper_pairs(len(shorter)) if len(shorter) <= 64 else np.triu_indices(len(shorter), 1)
            pairs.append((shorter[i], shorter[j]))
            pairs.append((np.repeat(shorter, len(longer)), np.tile(longer, len(shorter))))
            held += len(i) + len(shorter) * len(longer)
            widest = max(widest, hi - lo + 1)
    if parts:
        yield close()


def near_words(words: DataFrame, cells: int = TILE_CELLS) -> DataFrame:
    """``word, other, other_n`` for every ordered pair of near words of ``words`` (``word`` distinct, ``n``)."""
    narrow_first = tiles(words, cells).sortWithinPartitions("m", "lo")
    return narrow_first.mapInArrow(_compared, NEAR)


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``, the last word reached from ``word`` by following ``form`` (words without one left out).

    Chains must not be circular. Every round doubles what is followed.
    """
    reached = landed(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = landed(reached.join(onward, "root", "left").select("word", "root", "next"), "roots")
        if not further.filter("next IS NOT NULL").head(1):
            return reached
        reached = further.select("word", F.coalesce("next", "root").alias("root"))


def variants(words: DataFrame, ratio: int = 5, cells: int = TILE_CELLS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of ``words`` (``word`` distinct, ``n``).

    A word's form is its most frequent near word (ties: the smallest), if that is ``ratio`` times as frequent; ``ratio`` must
    be above 1, so that forms lead to ever more frequent words.
    """
    if ratio <= 1:
        raise ValueError("ratio must be above 1")
    words = landed(words.select("word", F.col("n").cast("long").alias("n")), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    near = near_words(words, cells).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    judged = words.join(near, "word", "left").withColumn("form_n", -F.col("best.less"))
    has_form = F.col("form_n") >= ratio * F.col("n")
    judged = landed(
        judged.select(
            "word",
            F.when(has_form, F.col("best.form")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(has_form, F.col("form_n")).alias("form_n"),
        ),
        "variants",
    )
    ends = roots(judged.filter("form IS NOT NULL"))
    found = judged.join(ends, "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
