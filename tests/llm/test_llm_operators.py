"""The text operators against brute force, and their defined results for odd rows."""

import hashlib
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

import corpus_pipeline
from checks import compare
from tidemark.llm import chat, embedding_dedup, exact_dedup, mixing, ngram_join, packing, substring_dedup
from tidemark.llm import token_counts, toxicity, wavelet
from tidemark.llm.common import ship_code
from tidemark.llm.components import connected_components
from tidemark.llm.oracles import ORACLES
from tidemark.llm.queries import QUERIES
from tidemark.llm.tokens import chunk_encoder, piece_counter
from tidemark.session import scratch_folder

WORD = re.compile("[^\x20\x09-\x0d]+")
ODD = [None, "", " \n", "a", "a b c", "idiot " * 4000, "x.,y  \n</s>\\", "a b c"]


@pytest.fixture(scope="module")
def docs(spark, sf):
    ship_code(spark)
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, a repeated row, a null id, and columns with names used inside."""
    ship_code(spark)
    rows = [(i, t, f"s{i % 2}", None, 1, i) for i, t in enumerate(ODD)] + [(None, "n u l l", None, "x", 2, 9), (4, "a b c", "s0", None, 1, 4)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, id long, row_id long")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf, name):
    assert compare.differences(QUERIES[name], ORACLES[name], spark, compare.connect(sf), sf) == []


def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


# --- 1 -------------------------------------------------------------------------------------------------


def log(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, message_id long, turn long, seq long, kind string, role string, text string")


def test_fold_applies_deltas_edits_and_regenerations(spark):
    rows = [
        (1, 0, 0, 0, "message", "user", "hi"),
        (1, 1, 1, 2, "delta", None, "lo"),
        (1, 1, 1, 1, "message", "assistant", "hel"),
        (1, 2, 2, 3, "message", "user", "old branch"),
        (1, 1, 1, 4, "regenerate", None, None),
        (1, 1, 1, 5, "delta", "assistant", "ne"),
        (1, 1, 1, 6, "delta", None, "w"),
        (1, 0, 0, 7, "edit", None, "hey"),
        (None, 0, None, None, "message", None, None),
    ]
    got = {(r.conv_id, r.no_conv, r.role, r.text) for r in chat.fold(log(spark, rows)).collect()}
    assert got == {(1, False, "user", "hey"), (1, False, "assistant", "new"), (0, True, "", "")}
    assert chat.render(chat.fold(log(spark, []))).collect() == []


def test_formatting_is_reversible_over_parts(spark):
    pieces = ["</s>", "<s>", "[INST]", "[/INST]", "\\", "<", "\n", "é", "a", ""]
    said = ["".join(p) for p in itertools.islice(itertools.product(pieces, repeat=3), 600)]
    rows = [(5, i, i, i, "message", "assistant" if i % 2 else said[-i], t) for i, t in enumerate(said)]
    parts = chat.render(chat.fold(log(spark, rows)), turns_per_part=100)
    (got,) = chat.read_back(parts).collect()
    turns = "".join(f"{r[5]}\n{r[6]}\n" for r in rows)
    loss = "".join(r[6] for r in rows if r[5] == "assistant")
    assert got.n_turns == 600 and got.turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
    assert (got.loss_chars, got.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


# --- 2 -------------------------------------------------------------------------------------------------


def shingles(text, n):
    words = WORD.findall(text.translate({i: i + 32 for i in range(65, 91)}))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)] if words else [])


def brute_components(sets, percent):
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}


@pytest.fixture(scope="module")
def near(spark):
    """Groups whose members differ from a base in a few words, as chains of links, and a passage many share."""
    rng = np.random.default_rng(5)
    rows = []
    for group, size in enumerate([6, 20, 40, 150, 400] * 4):
        base = [f"w{x}" for x in rng.integers(0, 5000, size)]
        for _ in range(7):
            own = list(base)
            for place in rng.integers(0, size, rng.integers(0, 1 + size // 30 + 1)):
                own[place] = f"x{rng.integers(0, 10**6)}"
            rows.append((len(rows), " ".join((["shared"] + [f"p{i}" for i in range(30)] if group % 2 else []) + own)))
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("pairs", [None, 1, 3])
@pytest.mark.parametrize("n, percent", [(4, 85), (2, 60)])
def test_similar_documents(spark, near, n, percent, pairs, monkeypatch):
    ship_code(spark)
    if pairs:
        chosen = ngram_join.allocate
        monkeypatch.setattr(
            ngram_join, "allocate", lambda *a: (p := chosen(*a)) and ngram_join.Allocation(p.weight, min(pairs, p.weight // 2))
        )
    want = brute_components({d: shingles(t, n) for d, t in texts(near).items()}, percent)
    got = ngram_join.similar_documents(near, ngram_join.Similarity(n, percent)).collect()
    assert {r.id: r.component_id for r in got} == want
    assert len(set(want.values())) < len(want)


def test_similar_documents_odd_rows(odd, empty):
    got = ngram_join.similar_documents(odd).collect()
    assert len(got) == 10
    assert {(r.id, r.n_shingles, r.component_id) for r in got} >= {(0, 0, 0), (1, 0, 1), (4, 1, 4), (7, 1, 4), (None, 1, None)}
    assert ngram_join.similar_documents(empty).collect() == []
    assert ngram_join.drop_similar(odd).columns == odd.columns


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in connected_components(links).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 99: 99, 100: 99}


# --- 3 -------------------------------------------------------------------------------------------------


def test_toxicity_learns_and_restores(spark, empty, odd):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(600):
        words = [f"{a}{b}" for a, b in zip(rng.choice(["the", "some", "ra", "ne"], 40), rng.choice(["ti", "lo", "mus", "to"], 40), strict=True)]
        toxic = i % 4 == 0
        rows.append((i, " ".join(words + ["idiot", "moron"][i % 8 // 4 :][:1] * toxic), int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    got = toxicity.score(docs, model).collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 50 and all((r.toxicity >= 0.5) == (r.toxic == 1) for r in held)
    reader = toxicity.Reader(model.characters, model.index)
    for text in ("you i d i o t", "m0r0n", "i.d.i.o.t", "IDIIIIOT"):
        assert model.score(reader.features(text)) >= 0.5, text
    none = toxicity.fit(empty, docs.select("doc_id", "toxic").limit(0))
    assert toxicity.score(empty, none).collect() == []
    assert [round(r.toxicity, 6) for r in toxicity.score(odd, none).collect()] == [0.0] * 10


@pytest.fixture(scope="module")
def toxic_reader(spark):
    """A model that knows two insults, and a reader of texts."""
    ship_code(spark)
    rng = np.random.default_rng(3)
    rows = []
    for i in range(600):
        words = [f"{a}{b}" for a, b in zip(rng.choice(["the", "some", "ra", "ne"], 40), rng.choice(["ti", "lo", "mus", "to"], 40), strict=True)]
        rows.append((i, " ".join(words + ["idiot", "moron"][i % 8 // 4 :][:1] * (i % 4 == 0)), int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    return model, toxicity.Reader(model.characters, model.index), [r[1] for r in rows if not r[2]]


SPACED = ["you i d i o t. and", '"i d i o t"', "i d i o t, yes", "m o r o n!", "(m o r o n)", "i   d  i\no    t", "m\no\nr\no\nn"]


def test_spaced_words_beside_marks_are_toxic(toxic_reader):
    model, reader, _ = toxic_reader
    assert [t for t in SPACED if model.score(reader.features(t)) < 0.5] == []


REPEATS = ["iddiot", "mmoron", "idiiot", "iiiidiot's", "id-iot", "mor.on", "i,d,i,o,t", "i'd'i'o't", "moroon"]


def test_doubled_letters_and_single_signs_are_undone(toxic_reader):
    model, reader, clean = toxic_reader
    assert [t for t in REPEATS if model.score(reader.features(t)) < 0.5] == []
    doubled = [" ".join(w + w[-1] if i % 3 else w[:2] + "-" + w[2:] for i, w in enumerate(t.split())) for t in clean[:100]]
    assert max(model.score(reader.features(t)) for t in [*clean, *doubled]) < 0.5


# --- 4 -------------------------------------------------------------------------------------------------


def test_every_prefix_of_a_phase_is_within_a_block(spark):
    blocks = {"a": 93, "b": 31, "c": 8, "d": 1, "e": 0}
    shares = mixing.root_shares(blocks, 50)
    plan = mixing.phases(blocks, shares)
    ran, slot = dict.fromkeys(blocks, 0), 0
    for phase, after in itertools.zip_longest(plan, plan[1:]):
        end = after.first_slot if after else sum(blocks.values())
        source_at = {s: name for name, slots in phase.slots.items() for s in slots}
        inside = dict.fromkeys(phase.slots, 0)
        while slot < end:
            name = source_at[(slot - phase.first_slot) % phase.period]
            inside[name] += 1
            ran[name] += 1
            slot += 1
            for s, n in inside.items():
                assert abs(n - (slot - phase.first_slot) * len(phase.slots[s]) / phase.period) < 1
    assert ran == blocks


def test_mix_keeps_every_document_in_slot_order(docs, odd, empty):
    got = mixing.mix(docs, block_bytes=4096).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts(docs))
    for source in {r.source for r in got}:
        own = sorted((r for r in got if r.source == source), key=lambda r: r.mix_byte)
        sizes = [len((r.text or "").encode()) + 1 for r in own]
        assert [r.mix_byte for r in own] == [sum(sizes[:i]) for i in range(len(own))]
        assert [r.mix_slot for r in own] == sorted(r.mix_slot for r in own)
    assert len({(r.mix_slot, r.source) for r in got}) == len({r.mix_slot for r in got})
    assert mixing.mix(odd).count() == 10 and mixing.mix(empty).collect() == []


# --- 5, 8, 9 -------------------------------------------------------------------------------------------

AWKWARD = ["", " ", "a  b \n", "x.,y%1  \n", "<|endoftext|>", "é b", "　 a", "ΑΣ. 's", "a$.b", "</s> <s>", "İß", "a\x1cb", "word " * 50]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunks_give_the_ids_of_whole_texts(docs, name):
    encoder = chunk_encoder(public_tokenizers.path(name))
    said = AWKWARD + list(texts(docs).values())
    ids, sizes = encoder.encode(said)
    want = [e.ids for e in encoder.tokenizer.encode_batch(said, add_special_tokens=False)]
    assert np.split(ids, np.cumsum(sizes)[:-1])[3].tolist() == want[3]
    assert sizes.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]


def test_token_counts(docs, odd, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = piece_counter(path).model
    said = AWKWARD + list(texts(docs).values())
    assert piece_counter(path).count_column(pa.array(said)).tolist() == [len(x) for x in model.encode(said)]
    want = {d: (len(t.encode()), len(model.encode(t))) for d, t in texts(docs).items()}
    for long_bytes in (token_counts.LONG_BYTES, 1000):
        got = token_counts.count_tokens(docs, path, long_bytes=long_bytes).collect()
        assert {r.id: (r.n_bytes, r.n_tokens) for r in got} == want
    assert token_counts.count_tokens(odd, path).count() == 10
    assert token_counts.count_tokens(empty, path).collect() == []


def test_packing(docs, odd, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = chunk_encoder(path)
    for table, per_partition in ((docs, 20_000), (docs, 30), (odd, 20_000)):
        got = packing.pack(packing.token_pieces(table, path), per_partition=per_partition).collect()
        by_doc, by_sequence = {}, {}
        for r in got:
            by_doc.setdefault((r.row_id, r.id), []).append(r)
            by_sequence.setdefault(r.sequence_id, []).append(r)
        assert len(by_doc) == table.count()
        for own in by_sequence.values():
            own.sort(key=lambda r: r.offset)
            ends = np.cumsum([r.length for r in own]).tolist()
            assert [r.offset for r in own] == [0, *ends[:-1]] and ends[-1] <= 2048
        for own in by_doc.values():
            own.sort(key=lambda r: r.piece)
            assert len(own) == 1 or all(r.length == 2048 for r in own[1:])
            assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own]).tolist()[:-1]]
        assert len(by_sequence) <= packing.global_bound(packing.token_pieces(table, path)) + 2
        if table is docs:
            for doc, text in list(texts(docs).items())[:20]:
                ids = np.append(encoder.encode([text])[0], 0).astype("<u4")
                own = next(p for k, p in by_doc.items() if k[1] == doc)
                assert [r.ids_crc32 for r in own] == [zlib.crc32(ids[r.start : r.start + r.length]) for r in own]
    assert packing.pack(packing.token_pieces(empty, path)).collect() == []


def test_lower_bound_never_exceeds_a_packing():
    rng = np.random.default_rng(1)
    for _ in range(50):
        lengths = rng.integers(1, 100, rng.integers(1, 40))
        bins, offsets, room = packing.best_fit_decreasing(lengths, 100)
        assert packing.lower_bound(lengths, 100) <= len(room)
        assert (np.bincount(bins, weights=lengths) + room == 100).all()


def test_wavelet_matrix():
    ids = np.random.default_rng(2).integers(0, 40, 3000).astype(np.uint32)
    matrix = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(ids, 6).to_bytes())
    assert (matrix.decode() == ids).all()
    assert [matrix.access(i) for i in range(0, 3000, 97)] == ids[::97].tolist()
    for value in (0, 7, 39, 50, 70):
        places = np.flatnonzero(ids == value)
        assert matrix.rank(value, 3000) == len(places) and matrix.rank(value, 1234) == (places < 1234).sum()
        assert [matrix.select(value, k) for k in range(len(places))] == places.tolist()


def test_token_files(spark, docs, odd, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = chunk_encoder(path)
    for table in (docs, odd):
        folder = scratch_folder(spark, "token-files")
        wavelet.write_tokens(table, folder, path, end_id=2, shard_tokens=5000)
        got = sorted(wavelet.read_documents(spark, folder).collect(), key=lambda r: r.start)
        assert len(got) == table.count() and [r.id for r in got] == sorted((r.id for r in got), key=lambda i: (i is not None, i or 0))
        assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got]).tolist()[:-1]]
        if table is docs:
            want = {d: np.append(encoder.encode([t])[0], 2).astype("<u4") for d, t in texts(docs).items()}
            assert {r.id: (r.n_tokens, r.ids_crc32) for r in got} == {d: (len(i), zlib.crc32(i)) for d, i in want.items()}
            token = int(want[0][0])
            places = {(r.id, r.position) for r in wavelet.find_token(spark, folder, token).collect()}
            assert places == {(d, int(p)) for d, i in want.items() for p in np.flatnonzero(i == token)}
            assert sum(r.n for r in wavelet.count_token(spark, folder, token).collect()) == len(places)
    folder = scratch_folder(spark, "token-files")
    wavelet.write_tokens(empty, folder, path, end_id=2)
    assert wavelet.read_documents(spark, folder).collect() == []


# --- 6 -------------------------------------------------------------------------------------------------


def test_near_duplicate_vectors(spark):
    ship_code(spark)
    rng = np.random.default_rng(4)
    base = rng.standard_normal((60, 16))
    vectors = [b + 0.05 * rng.standard_normal(16) for i, b in enumerate(base) for _ in range(1 + (i % 3) + 60 * (i == 5))]
    vectors += [vectors[0], vectors[0], list(np.zeros(16)), None, [float("nan")] * 16, [1.0, 2.0]]
    rows = [(i, None if v is None else [float(x) for x in v]) for i, v in enumerate(vectors)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = np.array([r[1] for r in rows[:-4]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= 0.9
    sets = {i: i for i in range(len(rows))}
    for _ in range(3):
        for i in range(len(x)):
            sets[i] = min(sets[j] for j in np.flatnonzero(linked[i]))
    got = {r.id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(table).collect()}
    n = [*(linked.sum(axis=1) - 1).tolist(), 0, 0, 0, 0]
    assert got == {i: (n[i], sets[i], i == sets[i]) for i in sets}
    assert embedding_dedup.near_duplicates(table.limit(0)).collect() == []


def test_links_between_tight_groups_outlast_full_lists(spark):
    rng = np.random.default_rng(11)
    a, aside = np.linalg.qr(rng.standard_normal((64, 2)))[0].T
    centres = [a, 0.92 * a + (1 - 0.92**2) ** 0.5 * aside]
    vectors = [(c + 0.0025 * rng.standard_normal(64)).tolist() for c in centres for _ in range(60)]
    nodes = list(range(120))
    block = pa.table({"order": [0] * 120, "node": nodes, "component": nodes, "vector": vectors}).to_batches()
    rows = pa.Table.from_batches(embedding_dedup._compare_blocks(0.9)(iter(block)))
    links = embedding_dedup.nearest(spark.createDataFrame(rows.to_pandas())).filter("link")
    of = connected_components(links.selectExpr("u AS a", "v AS b"))
    assert {(r.node, r.component) for r in of.collect()} == {(n, 0) for n in nodes}
    assert links.count() < 120


def vector_table(spark, vectors):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def brute_vectors(vectors, threshold=0.9):
    x = np.array(vectors) / np.linalg.norm(vectors, axis=1, keepdims=True)
    linked = x @ x.T >= threshold
    of = np.arange(len(x))
    while True:
        least = np.array([of[row].min() for row in linked])
        if (least == of).all():
            return {i: (int(linked[i].sum()) - 1, int(of[i])) for i in range(len(x))}
        of = least


def found_vectors(spark, vectors):
    return {r.id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(vector_table(spark, vectors)).collect()}


def test_few_pairs_among_many_vectors_are_all_found(spark, monkeypatch):
    ship_code(spark)
    monkeypatch.setattr(embedding_dedup, "ORDERS", 1)
    monkeypatch.setattr(embedding_dedup, "MAX_STEPS", 0)
    rng = np.random.default_rng(12)
    vectors = list(rng.standard_normal((3000, 64)))
    vectors += [v + 0.42 * rng.standard_normal(64) for v in vectors[:40]]
    want = brute_vectors(vectors)
    assert sum(n for n, _ in want.values()) >= 40
    assert found_vectors(spark, vectors) == want


# --- 7 -------------------------------------------------------------------------------------------------


def brute_repeats(said, window):
    seen, out = set(), {}
    for doc, text in sorted(said.items()):
        words = WORD.findall(text)
        keep = [True] * len(words)
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                keep[i : i + window] = [False] * window
            seen.add(key)
        out[doc] = (len(words), keep.count(False), " ".join(w for w, k in zip(words, keep, strict=True) if k))
    return out


def test_repeated_passages(spark, docs, odd, empty):
    rng = np.random.default_rng(8)
    passage = [f"p{i}" for i in range(45)]
    rows = []
    for i in range(60):
        a, b = sorted(rng.integers(0, 46, 2))
        own = [f"w{x}" for x in rng.integers(0, 300, rng.integers(0, 60))]
        rows.append((i, " ".join(own + passage[a:b] * 2 + own[::-1])))
    made = spark.createDataFrame(rows, "doc_id long, text string")
    for table in (docs, made):
        got = {r.id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(table).collect()}
        assert got == brute_repeats(texts(table), 20)
    assert substring_dedup.remove_repeats(odd).count() == 10
    assert substring_dedup.remove_repeats(empty).collect() == []


# --- 10 and the pipeline -------------------------------------------------------------------------------


def test_exact_duplicates_odd_rows(spark, odd, empty):
    got = exact_dedup.exact_duplicates(odd)
    assert got.count() == 10
    assert got.filter("kept").count() == exact_dedup.drop_exact_duplicates(odd).count() == 7  # distinct texts
    assert exact_dedup.exact_duplicates(empty).collect() == []
    assert exact_dedup.drop_exact_duplicates(empty).columns == empty.columns
    hot = spark.range(3000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'same  text', concat('t', id)) AS text")
    kept = exact_dedup.exact_duplicates(hot, tasks_for_hot=10).filter("kept").collect()
    assert len(kept) == 2001 and (0, 1000) in {(r.id, r.group_size) for r in kept}


def test_pipeline_stages(spark, docs, sf):
    table = docs
    for name, stage in corpus_pipeline.STAGES:
        folder = scratch_folder(spark, name)
        stage(spark, table, sf).write.parquet(folder)
        before, table = table, spark.read.parquet(folder)
        if name == "exact_dedup":
            assert table.count() == len({re.sub(r"[ \t-\r]+", " ", t) for t in texts(before).values()})
        if name == "ngram_jaccard_join":
            want = brute_components({d: shingles(t, 5) for d, t in texts(before).items()}, 80)
            assert set(texts(table)) == set(want.values())
        if name == "source_mixing":
            assert texts(table) == texts(before)
    assert {r.doc_id for r in table.collect()} == set(texts(before))
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "toxicity"
