"""The manifest, the archives and the spelling variants against brute force, and their defined results for odd rows."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from tidemark.llm import merkle, spelling, warc
from tidemark.llm.common import key_runs, ship_code
from tidemark.llm.queries import QUERIES
from tidemark.session import scratch_folder

ODD_DOCS = "doc_id long, text string, source string, lang string, n_chars int, id long, digest string, tree int"
ODD_PAGES = "page_id long, url string, html string, row_id long, digest string, payload string"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_code(spark)


@pytest.fixture
def saved(spark, tmp_path):
    def save(table, rows, kind):
        spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/{table}.parquet")
        return str(tmp_path)

    return save


# --- 11 ------------------------------------------------------------------------------------------------


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climbed(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h("".join(last[i : i + 8])) for i in range(0, len(last), 8)])
    return levels


def proofs_by_hand(rows):
    """Rows (doc_id, source, lang, n_chars, text) to the contract's results, without blocks or multiproofs."""
    low = str.maketrans(spelling.UPPER, spelling.LOWER)
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        own = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[g] = own, climbed([leaf_of(r) for r in own])
    top = climbed([trees[g][1][-1][0] for g in order])
    out = []
    for t, g in enumerate(order):
        own, levels = trees[g]
        for place, r in enumerate(own):
            chosen = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            digest = leaf_of((*r[:4], r[4].translate(low))) if chosen and r[4] is not None else leaf_of(r)
            siblings = ""
            for tree, at in ((levels, place), (top, t)):
                for level in tree[:-1]:
                    first = at // 8 * 8
                    siblings += "".join(x for i, x in enumerate(level[first : first + 8], first) if i != at)
                    digest = h("".join(digest if i == at else x for i, x in enumerate(level[first : first + 8], first)))
                    at //= 8
            root = top[-1][0]
            out.append((r[0], leaf_of(r), levels[-1][0], root, h(siblings), digest, digest == root))
    return sorted(out, key=str)


def found_proofs(df):
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in df.select(*names).collect()), key=str)


def test_manifest_of_odd_rows(spark, saved):
    texts = [None, "", "Ab é", "x" * 300_000, "UPPER", "İ upper", "same", "same"]
    rows = [(i, t, "s", None if i % 3 else "en", len(t or "") or None, i, "d", 1) for i, t in enumerate(texts * 9)]
    rows += [(5, "twice", None, "de", 5, 1, None, 1)] * 10 + [(None, "No id", "s", "", 5, 1, None, 1)]
    rows += [(900 + i, f"T{i}", "s", f"lang{i:03d}", 1, 1, None, 1) for i in range(70)]
    rows += [(2000 + i, f"A{i}", "s", "big", 1, 1, None, 1) for i in range(600)]
    random.Random(3).shuffle(rows)
    got = found_proofs(QUERIES["op11_merkle_manifest"](spark, saved("documents", rows, ODD_DOCS)))
    assert got == proofs_by_hand([(r[0], r[2], r[3], r[4], r[1]) for r in rows])


def test_manifest_of_nothing_and_of_one(spark, saved, tmp_path):
    one = [(7, "Text", None, None, 4, 1, None, 1)]
    folder = saved("documents", one, ODD_DOCS)
    assert found_proofs(QUERIES["op11_merkle_manifest"](spark, folder)) == proofs_by_hand([(7, None, None, 4, "Text")])
    spark.createDataFrame([], ODD_DOCS).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert QUERIES["op11_merkle_manifest"](spark, f"{tmp_path}/none").count() == 0


def test_manifest_blocks_and_rounds(spark, monkeypatch):
    """Trees higher than a block, grown in several rounds, and proofs of some leaves only."""
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 8)
    rows = [(i, None, "en" if i % 4 else "de", 1, f"t{i}") for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars int, text string")
    leaf = merkle.leaf_digest([F.col(c) for c in df.columns])
    manifest = merkle.build(df, leaf, "lang", "doc_id")
    by_hand = {r[0]: r for r in proofs_by_hand(rows)}
    some = manifest.leaves.filter("id % 37 = 0 OR id BETWEEN 100 AND 130")
    found = merkle.prove(manifest, some, with_siblings=True).collect()
    assert len(found) == some.count() > 40
    for r in found:
        assert (r.leaf, r.subroot, r.root, r.proof_sha256) == by_hand[r.id][1:5]
        assert h(r.siblings) == r.proof_sha256 and r.folded_root == r.root == manifest.root()


def test_a_partition_fetches_no_node_it_can_derive():
    whole = merkle.missing_nodes(np.arange(4096, 8192), 20_000)
    assert [len(p) for _, p in whole] == [0, 0, 0, 0, 4]
    assert [(level, p.tolist()) for level, p in merkle.missing_nodes(np.array([0, 9]), 20)] == [
        (0, [1, 2, 3, 4, 5, 6, 7, 8, 10, 11, 12, 13, 14, 15]),
        (1, [2]),
    ]


def test_key_runs_join_what_batches_cut():
    batches = [pa.record_batch({"a": [1, 1], "b": [1, 1]}), pa.record_batch({"a": [1, 1, 2], "b": [1, 2, 2]})]
    assert [r.num_rows for r in key_runs(batches, "a", "b")] == [3, 1, 1]


# --- 12 ------------------------------------------------------------------------------------------------


def records_by_hand(pages):
    first = {}
    for i, (page, _, html) in enumerate(pages):
        data = (html or "").encode()
        key = (page is not None, page or 0, i)
        if len(data) >= 100:
            first[data] = min(first.get(data, key), key)
    out = []
    for i, (page, url, html) in enumerate(pages):
        data = (html or "").encode()
        copy = data in first and first[data][2] != i
        keep = first[data][1] if copy and first[data][0] else None
        out.append((page, url, len(data), hashlib.sha256(data).hexdigest(), "revisit" if copy else "response", keep))
    return sorted(out, key=str)


def odd_pages():
    rng = random.Random(5)
    long = "é" * 400_000
    pages = [(i, f"http://h/{i}", f"<p>{rng.random()} {'word ' * 40}</p>") for i in range(300)]
    pages += [(1000 + i, "http://copy", "same " * 50) for i in range(200)]
    pages += [(1, None, None), (2, "", ""), (3, "http://x", "short"), (4, "http://x", "short"), (None, "u", long), (9, "v", long)]
    pages += [(50, "http://h/50", "WARC/1.1\r\n\r\nHTTP/1.1 200 OK\r\n\r\n" * 9)] * 3
    return pages


def test_archives_round_trip(spark, saved):
    pages = odd_pages()
    rows = [(*p, 1, "x", "y") for p in pages]
    folder = scratch_folder(spark, "warc-test")
    df = spark.read.parquet(saved("pages", rows, ODD_PAGES) + "/pages.parquet")
    warc.write_archives(df, folder, "2024-01-01T00:00:00Z", archive_bytes=400_000, sample_bytes=100_000)
    found = warc.read_archives(spark, folder, with_payload=True).collect()
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted((tuple(r[n] for n in names) for r in found), key=str) == records_by_hand(pages)
    texts = sorted(r.payload.decode() for r in found if r.record_type == "response")
    assert "é" * 400_000 in texts and len({r.archive for r in found}) > 2
    # Any record can be read from its place in its archive alone; every archive leads with its dictionary.
    files = {r.path.rsplit("/", 1)[-1]: bytes(r.content) for r in spark.read.format("binaryFile").load(folder).collect()}
    with_dictionary = 0
    for r in found:
        data = files[r.archive]
        with_dictionary += data[:4] == b"\x5d\x2a\x4d\x18"
        frame = data[r.offset : r.offset + r.length]
        assert zstandard.get_frame_parameters(frame).content_size > 0
        assert warc.parsed(warc.opened(data).decompress(frame))[0] == r.page_id
    assert with_dictionary > len(found) / 2
    # A reader of whole streams gets the records one after the other.
    name, data = max(files.items(), key=lambda f: len(f[1]))
    whole = warc.opened(data).stream_reader(data, read_across_frames=True).read()
    assert whole.count(b"WARC/1.1\r\nWARC-Type") == sum(r.archive == name for r in found)


def test_archive_query(spark, saved, tmp_path):
    pages = odd_pages()
    got = QUERIES["op12_warc"](spark, saved("pages", [(*p, 1, "x", "y") for p in pages], ODD_PAGES))
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((p, *rest) for p, _, *rest in records_by_hand(pages)), key=str)
    spark.createDataFrame([], ODD_PAGES).write.parquet(f"{tmp_path}/none/pages.parquet")
    assert QUERIES["op12_warc"](spark, f"{tmp_path}/none").count() == 0


def test_damage_is_noticed():
    one = warc.record(1, 0, "u\r\nX: y", b"<p>text</p>", hashlib.sha256(b"<p>text</p>").hexdigest(), "2024-01-01T00:00:00Z", None)
    assert warc.parsed(one)[:3] == (1, "u%0D%0AX: y", "response")
    with pytest.raises(ValueError):
        warc.parsed(one.replace(b"<p>text", b"<p>tExt"))
    with pytest.raises(ValueError):
        list(warc.frame_spans(b"WARC/1.1"))


# --- 13 ------------------------------------------------------------------------------------------------


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def variants_by_hand(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def made_words():
    rng, letters = random.Random(11), "abcdé"
    words = {"".join(rng.choices(letters, k=rng.randint(1, 9))): rng.choice([5, 6, 30, 31, 200, 5000]) for _ in range(900)}
    words |= {"prefixed" + "".join(x): 7 for x in itertools.product("abc", repeat=4)}
    words |= {"a" * k: 5 ** (k % 7) for k in range(1, 40)} | {"x" * 3000 + c: 5 for c in "abz"}
    return words


def test_variants_against_brute_force(spark):
    words = made_words()
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    expected = variants_by_hand(words)
    assert sum(r[1] is not None and r[2] != r[1] for r in expected) > 5  # chains of forms
    for cells in (spelling.TILE_CELLS, 64):  # with and without halved windows
        assert sorted(map(tuple, spelling.variants(df, cells=cells).collect())) == expected


def test_tiles_are_bounded(spark):
    words = [("w" * 6 + "".join(x), 5) for x in itertools.product("abcdefgh", repeat=4)]
    found = spelling.tiles(spark.createDataFrame(words, "word string, n long"), cells=256).collect()
    assert max(len(t.words) * (t.hi - t.lo + 1) for t in found if t.hi - t.lo > 1) <= 256
    assert max(len(t.words) for t in found) <= 64


def test_variants_query(spark, saved, tmp_path):
    texts = [None, "", "  12 34", "Straße straße STRASSE ÿÿÿÿÿÿ", "a×b÷c×d÷e", "Éclair éclair eclair ", "lettters letters " * 9]
    texts += ["receive recieve " * 40, "z" * 100_000, "naïve-approach naïveapproach"] * 6
    rows = [(None if i == 2 else i // 2, t, "s", None, 1, 1, "d", 1) for i, t in enumerate(texts)]
    rows += [(10_000 + i, "neighbour committee", "s", "en", 1, 1, "d", 1) for i in range(4000)]
    counts = {}
    low = str.maketrans(spelling.UPPER, spelling.LOWER)
    for r in rows:
        for run in "".join(c if c.isascii() and c.isalpha() or "À" <= c <= "ÿ" else " " for c in r[1] or "").split():
            run = run.translate(low)
            crc = zlib.crc32(f"{'' if r[0] is None else r[0]}:{run}".encode())
            if crc % 199 == 0:
                run = run[: crc % len(run)] + run[crc % len(run) + 1 :]
            if len(run) >= 6:
                counts[run] = counts.get(run, 0) + 1
    expected = variants_by_hand({w: n for w, n in counts.items() if n >= 5})
    got = QUERIES["op13_spelling_variants"](spark, saved("documents", rows, ODD_DOCS))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, got.collect())) == expected
    spark.createDataFrame([], ODD_DOCS).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert QUERIES["op13_spelling_variants"](spark, f"{tmp_path}/none").count() == 0
