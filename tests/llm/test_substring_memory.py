"""What a task of the substring operator remembers changes what moves, never what is found."""

from __future__ import annotations

from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import substring_dedup as op

WINDOW = 20


@pytest.fixture(scope="module")
def batches():
    """40 batches of 3 documents, not in the order of their ids; one passage in all, one in every fifth, a document repeated."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(5000)]
    everywhere, sometimes = " ".join(f"e{i}" for i in range(31)), " ".join(f"s{i}" for i in range(24))
    out, ids = [], rng.permutation(120)
    for b in range(40):
        rows = []
        for j in range(3):
            own = " ".join(rng.choice(words, 30))
            rows.append((int(ids[3 * b + j]), f"{own} {everywhere if j == 0 else ''} {sometimes if j == 1 and b % 5 == 0 else ''} x{b}"))
        if b == 30:
            rows.append((7, "q " * 45))
        if b in (10, 20):
            rows.append((1000, everywhere))  # an id that comes twice
        out.append(pa.record_batch([[r[0] for r in rows], [r[1] for r in rows]], names=["id", "text"]))
    return out


def rows_of(run, parts) -> list[dict]:
    return [row for part in parts for batch in run(iter(part)) for row in batch.to_pylist()]


def split(batches, monkeypatch, places):
    """Each batch handled by itself (no memory), and all by one task."""
    monkeypatch.setattr(op, "WORK_BYTES", 1)  # a batch per document
    monkeypatch.setattr(op, "Memory", partial(op.Memory, places))
    return [[b.slice(i, 1)] for b in batches for i in range(b.num_rows)], [batches]


@pytest.mark.parametrize("places", [1, 7, 64, 1 << 12])
def test_memory_changes_no_result(batches, monkeypatch, places):
    alone, together = split(batches, monkeypatch, places)

    def anchors(parts):
        rows = rows_of(op._anchors(WINDOW), parts)
        times = Counter(r["deal"] for r in rows)
        return {(r["id"], r["position"]) for r in rows if r["settled"] or times[r["deal"]] > 1}, times

    want, before = anchors(alone)
    got, after = anchors(together)
    assert got == want and want
    hot = [deal for deal, n in before.items() if n >= 40]  # of the passage that all batches hold
    assert hot and (places < 1 << 12 or max(after[deal] for deal in hot) < 10)

    by_id = {}
    for i, position in want:
        by_id.setdefault(i, []).append(position)

    def with_positions(parts):
        return [
            [pa.record_batch([b.column(0), b.column(1), pa.array([by_id.get(i, []) for i in b.column(0).to_pylist()], pa.list_(pa.int32()))],
                             names=["id", "text", "positions"]) for b in part]
            for part in parts
        ]

    def windows(parts):
        rows = rows_of(op._windows(WINDOW), with_positions(parts))
        first: dict = {}
        for r in rows:
            key, at = (r["deal"], r["check"]), (r["id"], r["start"])
            first[key] = min(first.get(key, at), at)
        later = {(r["id"], r["start"]) for r in rows if r["settled"] or first[r["deal"], r["check"]] < (r["id"], r["start"])}
        return later, Counter((r["deal"], r["check"]) for r in rows if r["check"])

    want, before = windows(alone)
    got, after = windows(together)
    assert got == want and want
    hot = [key for key, n in before.items() if n >= 40]
    assert hot and (places < 1 << 12 or max(after[key] for key in hot) < 10)
