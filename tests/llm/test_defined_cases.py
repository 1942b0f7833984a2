"""Cases that have a defined result: repeated and unknown events, low similarities, rows that share an id, many sources, odd tables."""

import itertools
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import chat, common, embedding_dedup, mixing, ngram_join, packing, tokens, toxicity, wavelet, words
from tidemark.llm.queries import QUERIES
from tidemark.session import scratch_folder

EVENTS = "conv_id long, message_id long, turn long, seq long, kind string, role string, text string"
DOCS = "doc_id long, text string, lang string, source string, n_chars int"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    common.ship_code(spark)


# --- 1 -------------------------------------------------------------------------------------------------


def test_repeated_and_unknown_events(spark):
    rows = [
        (1, 0, 0, 0, "message", "assistant", "hel"),
        (1, 0, 0, 1, "delta", None, "lo"),
        (1, 0, 0, 1, "delta", None, "lo"),  # delivered twice
        (1, 0, 0, 2, "delta", None, "lo"),  # said again
        (1, 0, 0, 3, None, None, "?"),
        (1, 0, 0, 4, "reaction", None, "!"),
        (1, 1, 1, 5, "reaction", None, "alone"),
    ]
    events = spark.createDataFrame(rows, EVENTS)
    assert [(r.message_id, r.text) for r in chat.fold(events).collect()] == [(0, "hellolo")]
    assert sorted(r.seq for r in chat.unknown(events).collect()) == [3, 4, 5]


def test_regenerations_and_deltas_beyond_a_span(spark):
    far = 3 * chat.TURN_SPAN
    rows = [(1, n, n, n, "message", "user", f"t{n}") for n in (0, 1, far, far + 1)]
    rows += [(1, 1, 1, far + 5, "regenerate", None, None), (1, 9, far, far + 6, "message", "user", "after")]
    rows += [(2, 0, 0, n, "delta", "assistant", f"{n % 10}") for n in range(chat.EVENT_SPAN + 100)]
    found = {(r.conv_id, r.message_id): r.text for r in chat.fold(spark.createDataFrame(rows, EVENTS)).collect()}
    long = found.pop((2, 0))
    assert found == {(1, 0): "t0", (1, 9): "after"}
    assert long == "".join(str(n % 10) for n in range(chat.EVENT_SPAN + 100))


# --- 2 -------------------------------------------------------------------------------------------------


def shingled(text, n):
    said = text.lower().split()
    return {tuple(said[i : i + n]) for i in range(len(said) - n + 1)} if len(said) >= n else {tuple(said)} if said else set()


def components_by_hand(docs, n, percent):
    sets = {i: shingled(t, n) for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(docs, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    return {i: find(i) for i in docs}


@pytest.mark.parametrize(("n", "percent"), [(1, 20), (1, 33), (2, 50), (1, 51), (3, 100), (1, 85)])
def test_any_similarity(spark, n, percent):
    rng = random.Random(percent)
    docs = {}
    for i in range(0, 160, 2):
        size = rng.choice([1, 2, 5, 20, 60])
        base = [f"w{i}x{k}" for k in range(size)]
        share = max(1, math.ceil(size * percent / 100) + rng.choice([-1, 0, 0, 1, 2]))
        other = base[:share] + [f"v{i}x{k}" for k in range(rng.choice([0, 0, size // 2, size - share if size > share else 0]))]
        docs[i], docs[i + 1] = " ".join(base), " ".join(other)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    found = ngram_join.similar_documents(df, ngram_join.Similarity(n, percent)).collect()
    expected = components_by_hand(docs, n, percent)
    assert {r.id: r.component_id for r in found} == expected and len(set(expected.values())) < len(docs)


def test_one_deletion_segments_where_they_are_cheaper(spark):
    plans = [ngram_join.allocate(ngram_join.Similarity(1, p), 6, 100_000, 0.1) for p in (20, 33, 85)]
    assert plans[0].pairs > 0 and plans[1].pairs > 0 and plans[2].pairs == 0
    with pytest.raises(ValueError):
        ngram_join.Similarity(1, 0)


def test_near_copies_are_decided_by_row(spark):
    long = "one two three four five six seven eight nine ten"
    rows = [(3, long, "a"), (5, long + " ", "b"), (5, "quite another text that stands alone here", "c"), (None, long, "d"), (7, None, "e"), (7, None, "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _row string")
    kept = sorted(r._row for r in ngram_join.drop_similar(df).collect())
    assert kept == ["c", "d", "e", "f"]


# --- 3 -------------------------------------------------------------------------------------------------


def best_by_trying(token, model):
    """The likeliest reading of a short token, over every path through its lattice."""
    choices, previous = [], ""
    for sign in token:
        options = []
        if "a" <= sign <= "z":
            options = [(ord(sign) - 96, 0.0)] + ([(-1, toxicity.COST_REPEAT)] if sign == previous else [])
        elif sign in toxicity.STANDS_FOR:
            options = [(ord(c) - 96, toxicity.COST_SIGN) for c in toxicity.STANDS_FOR[sign]] + [(0, toxicity.COST_NOT_A_LETTER)]
            options += [(-1, toxicity.COST_REPEAT)] if sign == previous else []
        else:
            options = [(-1, toxicity.COST_SEPARATOR), (0, toxicity.COST_BORDER)]
        previous = previous if sign in toxicity.SEPARATORS else sign
        choices.append(options)
    best = None
    for path in itertools.product(*choices):
        state, score, said = (0, 0, 0), 0.0, ""
        for symbol, cost in path:
            score -= cost
            if symbol < 0 or (symbol == 0 and state[2] == 0):
                continue
            score += float(model[(*state, symbol)])
            said += chr(96 + symbol) if symbol else " "
            state = (*state[1:], symbol)
        score += float(model[(*state, 0)])
        if best is None or score > best[0] + 1e-9:
            best = score, said.split()
    return best


def test_decoding_finds_the_best_path(spark, sf):
    model = toxicity.character_model(spark.read.parquet(f"{sf}/documents.parquet"))
    rng = random.Random(2)
    for _ in range(150):
        token = "".join(rng.choices("aeiostrn014!.-@", k=rng.randint(2, 7)))
        score, said = best_by_trying(token, model)
        found = toxicity.restore(token, model)
        if found != said:  # ties only
            again = " ".join(found)
            assert best_by_trying(again.replace(" ", "."), model)[0] <= score + 20
        assert len("".join(found)) <= len(token)
    assert toxicity.restore("ab" * 50_000, model) == ["ab" * 50_000]


def test_toxicity_query_on_odd_rows(spark, tmp_path):
    rows = [(i, t, None, "s", 1) for i, t in enumerate([None, "", "you idiot", "fine day", "i-d-i-o-t " * 3000] * 8)] + [(None, "x", None, None, None)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, None, int(i % 5 in (2, 4))) for i in range(40)] + [(None, 0, 1), (3, 1, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = QUERIES["op3_toxicity"](spark, str(tmp_path))
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [
        ("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")
    ]
    found = got.collect()
    assert len(found) == 41 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found if r.doc_id is not None)


# --- 4 -------------------------------------------------------------------------------------------------


def test_any_number_of_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SOURCES", 20)
    rows = [(i, "x" * (1 + i % 50), None if i == 7 else f"s{i % 90}" if i % 3 else "hot") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(docs, block_bytes=200).collect()
    assert sorted(r.doc_id for r in found) == list(range(900)) and all(r.mix_slot is not None for r in found)
    slots = {}
    for r in found:
        slots.setdefault(r.mix_slot, set()).add(r.source)
    assert sum(len(s) for s in slots.values()) > len(slots)  # classes share blocks
    assert {s for s in slots.values() for s in s if s == "hot"} and all(len(s) == 1 for s in slots.values() if "hot" in s)
    own = mixing.mix(docs, {"hot": 3, "s1": 2}, block_bytes=200)
    assert own.count() == 900 and own.filter("mix_slot IS NULL").isEmpty()
    with pytest.raises(ValueError):
        mixing.mix(docs, {f"s{i}": 1 for i in range(11)})


def test_one_rule_for_any_number_of_sources(spark, monkeypatch):
    """The schedule of a large source does not turn on how many small ones there are."""
    monkeypatch.setattr(mixing, "MAX_SOURCES", 20)
    for small in (9, 19, 20, 60):
        rows = [(i, "x" * 9, "hot") for i in range(500)] + [(500 + i, "x", f"s{i}") for i in range(small)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
        found = mixing.mix(docs, {"hot": 1}, block_bytes=200).collect()
        assert sorted(r.doc_id for r in found) == list(range(500 + small)) and all(r.mix_slot is not None for r in found)
        classes = {int(r[0]) for r in docs.filter("source <> 'hot'").select(F.pmod(F.xxhash64("source"), F.lit(10))).collect()}
        assert len({r.mix_slot for r in found if r.source != "hot"}) == len(classes)  # a block each, whatever their number


# --- 5, 9, words ---------------------------------------------------------------------------------------


def test_texts_with_the_space_sign(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    counter, rng = tokens.PieceCounter(path), random.Random(6)
    texts = ["▁ ▁", "▁", " ▁▁ a", "a ▁b  ▁ c", "plain text", ""]
    texts += ["".join(rng.choices(["▁", " ", "  ", "a", "the", "é", "\n"], k=rng.randint(1, 12))) for _ in range(3000)]
    assert counter.count_column(pa.array(texts)).tolist() == [len(x) for x in counter.model.encode(texts)]


def test_ids_beyond_the_planes_are_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        wavelet.WaveletMatrix.build(np.array([70_000, 5]), 16)
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    path, folder = public_tokenizers.path("word_bpe_49k.json"), scratch_folder(spark, "planes")
    with pytest.raises(ValueError):
        wavelet.write_tokens(docs, folder, path, end_id=2, levels=10)
    wavelet.write_tokens(docs, folder, path, end_id=100_000)
    assert {(r.id, r.n_tokens > 0) for r in wavelet.read_documents(spark, folder).collect()} == {(1, True), (2, True)}
    assert sum(r.n for r in wavelet.count_token(spark, folder, 100_000).collect()) == 2


def test_the_rank_directory_is_read_from_the_file():
    ids = np.random.default_rng(1).integers(0, 50_000, 5_000)
    matrix = wavelet.WaveletMatrix.build(ids, 16)
    again = wavelet.WaveletMatrix.from_bytes(matrix.to_bytes())
    assert all(np.array_equal(a, b) for a, b in zip(matrix.ranks, again.ranks, strict=True))
    assert np.array_equal(again.decode(), ids) and [again.access(i) for i in (0, 511, 512, 4_999)] == ids[[0, 511, 512, 4_999]].tolist()
    empty = wavelet.WaveletMatrix.build(np.zeros(0, dtype=np.int64), 16)
    assert len(wavelet.WaveletMatrix.from_bytes(empty.to_bytes()).decode()) == 0


def test_hashes_do_not_depend_on_stretches(monkeypatch):
    texts = pa.array(["a bb  ccc " * 400, None, "x" * 3000, "", "é ü " * 500])
    data, borders = words.text_buffer(texts)
    starts, ends, _ = words.word_spans(data, borders)
    values = words.byte_values(3)
    whole = words.span_hashes(data, starts, ends, values)
    windows = words.window_hashes(whole, 7)
    monkeypatch.setattr(words, "STRETCH", 100)
    assert np.array_equal(words.span_hashes(data, starts, ends, values), whole)
    assert np.array_equal(words.window_hashes(whole, 7), windows)


# --- the pipeline --------------------------------------------------------------------------------------


def shares(rows, parts):
    """Per stretch of the sequences, or of documents, the share of each source in its tokens."""
    total, at, out = sum(n for _, n in rows), 0, [dict() for _ in range(parts)]
    for source, n in rows:
        own = out[min(parts - 1, at * parts // total)]
        own[source] = own.get(source, 0) + n
        at += n
    return [{s: n / sum(o.values()) for s, n in o.items()} for o in out]


def test_the_mixture_holds_in_every_stretch_of_the_sequences(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "STRETCH", 60)
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=rng.randint(20, 700))), "en", rng.choice("aaaaaaab"), 1) for i in range(1500)]
    docs = spark.createDataFrame(rows, DOCS)
    monkeypatch.setattr(mixing, "BLOCK_BYTES", 8 << 10)
    order = mixing.in_order(mixing.mix(docs, {"a": 1, "b": 1}, block_bytes=8 << 10), docs.columns)
    order.write.parquet(f"{tmp_path}/mixed")
    stored = spark.read.parquet(f"{tmp_path}/mixed")
    places = common.as_stored(stored, "place").orderBy("place").collect()
    assert [r.place for r in places] == list(range(1500))
    placed = mixing.mix(docs, {"a": 1, "b": 1}, block_bytes=8 << 10).orderBy("mix_slot", "mix_byte").collect()
    assert [r.doc_id for r in places] == [r.doc_id for r in placed]
    packed = corpus_pipeline.packed(spark, stored, "").collect()
    source = {r[0]: r[3] for r in rows}
    length = {}
    for r in packed:
        length[r.doc_id] = length.get(r.doc_id, 0) + r.length
    scheduled = shares([(source[r.doc_id], length[r.doc_id]) for r in placed], 6)
    found = shares([(source[r.doc_id], r.length) for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset))], 6)
    assert all(abs(s.get("b", 0) - f.get("b", 0)) < 0.12 for s, f in zip(scheduled, found, strict=True))
    assert max(s.get("b", 0) for s in scheduled) > 0.35 and min(s.get("b", 0) for s in scheduled) < 0.05  # b runs out
    # No more sequences than packing without an order needs, but for a few.
    pieces = packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))
    free = packing.pack(pieces).select("sequence_id").distinct().count()
    assert len({r.sequence_id for r in packed}) <= 1.02 * free + 2
    ends = {}
    for r in packed:
        ends.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in ends.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 2048


def test_pipeline_on_odd_and_empty_tables(spark, tmp_path):
    long = " ".join(f"word{i}" for i in range(30_000))
    texts = [None, "", " \n ", "a", long, long + " more", "same text of some words here", "same  text of some words here"]
    rows = [(i, t, None, None if i % 2 else "s", 1) for i, t in enumerate(texts)] + [(4, "another text under a known id that is its only copy", "en", "s", 1), (None, "no id at all but words enough", "en", "s", 1)]
    labels = "doc_id long, quality int, toxic int"
    for name, docs in (("odd", rows), ("none", [])):
        spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], labels).write.parquet(f"{tmp_path}/{name}/labels.parquet")
    found = corpus_pipeline.run(spark, f"{tmp_path}/odd")
    kept = sorted({(r.doc_id, r.piece) for r in found.collect()}, key=str)
    assert {k[0] for k in kept} == {0, 2, 3, 4, 6, None} and len([k for k in kept if k[0] == 4]) > 2
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    assert [f.name for f in found.schema][:7] == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


# --- registered queries on an odd table ----------------------------------------------------------------

KINDS = {
    "op2_ngram_jaccard_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op5_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    "op7_substring_dedup": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
    "op8_best_fit_packing": {
        "doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"
    },
    "op9_token_files": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
}


@pytest.mark.parametrize("name", sorted(KINDS))
def test_queries_on_odd_and_empty_tables(spark, tmp_path, name):
    texts = [None, "", "\n", "a", "a b c", "▁ ▁", "word " * 30_000, "a b c"]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)] + [(4, "a b c", None, None, None), (None, "x y", None, None, None)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/odd/documents.parquet")
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/none/documents.parquet")
    got = QUERIES[name](spark, f"{tmp_path}/odd")
    assert {f.name: f.dataType.simpleString() for f in got.schema} == KINDS[name]
    found = got.collect()
    assert {r.doc_id for r in found} == {*range(8), None}
    if name != "op8_best_fit_packing":
        assert len(found) == len(rows)
    assert QUERIES[name](spark, f"{tmp_path}/none").count() == 0


def test_saturated_lists_are_enlarged(spark):
    """Two tight groups, every vector of one being linked with all of the other: eight places outside are not enough."""
    rng = np.random.default_rng(4)
    centres = np.eye(16)[:2] + 0.55 * np.eye(16)[[1, 0]]
    vectors = np.concatenate([c / np.linalg.norm(c) + rng.normal(0, 0.002, (40, 16)) for c in centres])
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(vectors)], "node long, vector array<double>, size long")
    labels = spark.createDataFrame([(i, 0 if i < 40 else 40) for i in range(80)], "node long, component long")
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    pairs = [(u, v) for u in range(80) for v in {int(x) for x in rng.integers(0, 80, 12)} if u != v]
    rows = [(u, v, float(units[u] @ units[v]), (u < 40) != (v < 40), False) for u, v in pairs]
    edges = spark.createDataFrame(rows, "u long, v long, cosine double, across boolean, link boolean")
    lists = embedding_dedup.descend(df, labels, edges, 0.8, 4)
    outside = lists.filter("listed AND across").groupBy("u").count().agg(F.max("count")).first()[0]
    assert outside > embedding_dedup.NEIGHBOURS
    assert lists.filter("listed AND NOT across").groupBy("u").count().agg(F.max("count")).first()[0] <= embedding_dedup.NEIGHBOURS


def test_embedding_query_on_odd_vectors(spark, tmp_path):
    inf, nan = float("inf"), float("nan")
    vectors = [[1.0, 0.0], [1.0, 0.01], None, [0.0, 0.0], [1.0, None], [nan, 1.0], [inf, 1.0], [], [1.0, 0.0, 0.0], [1.0, 0.0]]
    rows = [(i, v, "x") for i, v in enumerate(vectors)] + [(None, [0.0, 1.0], "x")]
    kind = "vec_id long, embedding array<double>, label string"
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/odd/embeddings.parquet")
    spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/none/embeddings.parquet")
    got = QUERIES["op6_embedding_near_dedup"](spark, f"{tmp_path}/odd")
    assert {f.name: f.dataType.simpleString() for f in got.schema} == {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"}
    found = {r.vec_id: (r.n_links, r.component_id) for r in got.collect()}
    alone = {i: (0, i) for i in range(2, 9)} | {None: (0, None)}
    assert found == {0: (2, 0), 1: (2, 0), 9: (2, 0)} | alone
    assert QUERIES["op6_embedding_near_dedup"](spark, f"{tmp_path}/none").count() == 0


def test_mixing_query_on_odd_and_empty_tables(spark, tmp_path):
    rows = [(i % 4, [None, "", "a b", "x" * 200_000][i % 4], None, [None, "s"][i % 2], 1) for i in range(40)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/odd/documents.parquet")
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/none/documents.parquet")
    got = QUERIES["op4_source_mixing"](spark, f"{tmp_path}/odd")
    assert got.count() == 40 and got.filter(F.col("mix_slot").isNull()).isEmpty()
    assert QUERIES["op4_source_mixing"](spark, f"{tmp_path}/none").count() == 0
