"""Decontamination, token files, line labels, mixing and near-duplicates against plain versions."""

import itertools
import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from cohorta.llm import bit_planes, crf, fm_index, line_quality, raking, setsketch
from cohorta.llm.components import components
from cohorta.llm.queries import TOKENIZER
from cohorta.llm.registry import QUERIES, prepare, table
from cohorta.llm.words import WordHashes
from tests.llm import plain

EDGE_TEXTS = [None, "", " \n\t ", "one", "One two", "a b c d e f g h i j k", "x " * 30_000, "Été à la plage — ça va ?\nÉté", "same line\nsame line\n\nsame line", "😀 emoji\x1cand\x85odd spaces here", "a b c d e f g h i j k"]


@pytest.fixture(scope="module")
def s(spark):
    return prepare(spark)


@pytest.fixture(scope="module")
def edge(s):
    """Odd texts, a null id, a repeated row, clashing extra columns."""
    rows = [(i, t, "en", None if i % 3 else "s", 1, "x", 2.0) for i, t in enumerate(EDGE_TEXTS)]
    rows += [(None, "a null id", None, None, None, None, None), rows[5]]
    return s.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, words string, n_words double")


def pairs(s, folder, name, key, value):
    return [tuple(r) for r in table(s, folder, name).select(key, value).collect()]


def by_id(df, *columns):
    return {r[0]: tuple(r[1:]) for r in df.select("doc_id", *columns).collect()}


def test_suffix_order_and_search():
    rng = np.random.default_rng(3)
    for trial in range(60):
        s = rng.integers(0, rng.integers(2, 6), rng.integers(1, 200)).astype(np.int32)
        s = np.concatenate((s, s[: trial * 2], [0])).astype(np.int32)
        index = fm_index.FMIndex(s, int(max(s.max(), 1)), step=4)
        for n in (1, 2, 5):
            phrases = rng.integers(1, max(2, s.max() + 1), (20, n)).astype(np.int32)
            phrases = phrases[(phrases <= s.max()).all(1)]
            which, low, high = index.search(phrases)
            found = {k: sorted(index.locate(np.arange(a, b)).tolist()) for k, a, b in zip(which.tolist(), low, high)}
            for k, p in enumerate(phrases):
                want = [i for i in range(len(s) - n + 1) if (s[i : i + n] == p).all()]
                assert found.get(k, []) == want


def test_leaks_match_plain_version(s, small):
    got = by_id(QUERIES["op1_fm_index"](s, small), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == plain.leaks(pairs(s, small, "documents", "doc_id", "text"), pairs(s, small, "benchmark", "item_id", "text"))
    assert any(v[-1] for v in got.values())


def test_leak_edges(s, edge, monkeypatch):
    items = [(1, "e f g"), (2, "A b c d e f g h i j k"), (3, None), (4, "!!"), (None, "one"), (1, "e f g"), (5, "x x x")]
    bench = s.createDataFrame(items, "item_id long, text string")
    for per_pass in (1_000_000, 2):  # in one pass, and in several
        monkeypatch.setattr(fm_index, "PHRASES_PER_PASS", per_pass)
        plan = fm_index.find_leaks(edge, bench)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1  # one table of phrases at a time
        got = {(r.doc_id): (r.n_words, r.n_hit, r["items"]) for r in fm_index.find_leaks(edge, bench).collect()}
        assert got[3] == (1, 1, []) and got[4] == (2, 1, []) and got[5] == (11, 11, ["1", "2"]) and got[0] == (0, 0, [])
        assert got[6] == (30_000, 30_000, ["5"])
        rest = fm_index.remove_leaks(edge, bench)
        assert rest.columns == edge.columns
        texts = {r.doc_id: r.text for r in rest.collect()}
        assert 5 not in texts and 3 not in texts and texts[0] is None and texts[1] == "" and texts[4] == " two" and texts[7] == EDGE_TEXTS[7]
    assert fm_index.find_leaks(edge, bench.limit(0)).where("n_hit > 0").count() == 0
    assert fm_index.find_leaks(edge.limit(0), bench).count() == 0


def test_planes_round_trip():
    rng = np.random.default_rng(1)
    for top in (1, 2, 255, 256, 49_407, 2**32):
        ids = rng.integers(0, top, 1000, np.uint64).astype(np.uint32)
        for by_byte in (False, True):
            width, planes = bit_planes.split_planes(ids, by_byte)
            assert (bit_planes.join_planes(width, planes, ids.size, by_byte) == ids).all()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=12), st.text("aBé'ß1.,;-*_|<>\u0301\u0345 ſİΣK½²\u200d\x85\x1c\n", max_size=12), st.sampled_from(["<|endoftext|>", "<|ENDOFTEXT|>", "it's", "été,", "Don'T!!", "a's."])), max_size=8))
def test_words_encode_as_whole_texts(words):
    from tokenizers import Tokenizer

    if not hasattr(test_words_encode_as_whole_texts, "pair"):
        test_words_encode_as_whole_texts.pair = (Tokenizer.from_file(TOKENIZER), bit_planes.WordEncoder(TOKENIZER))
    whole, encoder = test_words_encode_as_whole_texts.pair
    texts = [" ".join(words), "".join(words)]
    assert [x.tolist() for x in encoder(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_files_match_whole_texts(s, small, edge, tmp_path):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(TOKENIZER)
    docs = pairs(s, small, "documents", "doc_id", "text")
    assert by_id(QUERIES["op2_bit_planes"](s, small), "start", "n_tokens", "ids_crc32") == plain.encoded(docs, whole)
    odd = edge.where("doc_id is not null").dropDuplicates(["doc_id"])
    for k, options in enumerate(({"chunk_ids": 7}, {"by_byte": True, "chunk_ids": 64}, {"whole": True})):
        path = f"file://{tmp_path}/{k}"
        bit_planes.write_ids(odd, path, TOKENIZER, **options)
        got = by_id(bit_planes.read_documents(s, path, options.get("by_byte", False)), "start", "n_tokens", "ids_crc32")
        assert got == plain.encoded(list(enumerate(EDGE_TEXTS)), whole)
    bit_planes.write_ids(edge, f"file://{tmp_path}/all", TOKENIZER)
    assert bit_planes.read_documents(s, f"file://{tmp_path}/all").count() == edge.count()
    bit_planes.write_ids(edge.limit(0), f"file://{tmp_path}/none", TOKENIZER)
    assert bit_planes.read_documents(s, f"file://{tmp_path}/none").count() == 0


def test_viterbi_and_training():
    rng = np.random.default_rng(0)
    model = crf.ChainModel(rng.normal(size=(4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    lengths = np.array([3, 0, 1, 5, 2])
    x = rng.normal(size=(lengths.sum(), 4))
    emit, got, at = model.emissions(x), crf.viterbi(model.emissions(x), lengths, model), 0
    for n in lengths:
        if n:
            score = lambda y: model.begin[y[0]] + sum(emit[at + i, y[i]] for i in range(n)) + sum(model.steps[a, b] for a, b in zip(y, y[1:]))  # noqa: B023, E731
            assert tuple(got[at : at + n]) == max(itertools.product(range(3), repeat=int(n)), key=score)
        at += n
    y = (rng.random(400) < 0.5).astype(int)
    y = np.repeat(y, 3)
    x = np.stack([np.ones(1200), y + rng.normal(0, 0.4, 1200)], 1)
    fitted = crf.train(x, y, np.full(60, 20), 2)
    assert (crf.viterbi(fitted.emissions(x), np.full(60, 20), fitted) == y).mean() > 0.8


def test_line_counts_match_plain_version(s, small, edge):
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = by_id(QUERIES["op3_line_quality"](s, small), *columns)
    assert got == {d: plain.line_counts(t) for d, t in pairs(s, small, "documents", "doc_id", "text")}
    labels = table(s, small, "labels")
    judged = line_quality.line_quality(edge, labels.limit(0)).select("doc_id", *(f"__lines.{c}" for c in columns))
    assert {d: v for d, v in by_id(judged, *columns).items() if d is not None} == {i: plain.line_counts(t) for i, t in enumerate(EDGE_TEXTS)}
    assert line_quality.line_quality(edge.limit(0), labels).count() == 0


def test_line_verdict_agrees_with_labels(s, folder):
    kept = QUERIES["op3_line_quality"](s, folder).where("not base_failed").join(table(s, folder, "labels"), "doc_id")
    rows = kept.select("kept", "quality").collect()
    assert sum(r.kept == bool(r.quality) for r in rows) / len(rows) > 0.95
    assert sum(r.kept for r in rows if r.quality) / sum(bool(r.quality) for r in rows) > 0.97


def test_raking_reaches_marginals():
    rng = np.random.default_rng(5)
    cells = {(f"s{a}", f"l{b}", str(c)): float(rng.integers(1, 100)) for a in range(4) for b in range(3) for c in range(2)}
    targets = [{"s0": 0.1, "s1": 0.2, "s2": 0.3, "s3": 0.4}, {"l0": 0.5, "l1": 0.25, "l2": 0.25}, {"0": 0.5, "1": 0.5}]
    factors = raking.rake(cells, targets)
    total = sum(cells.values())
    for d, target in enumerate(targets):
        for name, share in target.items():
            assert abs(sum(factors[k] * v for k, v in cells.items() if k[d] == name) / total - share) < 1e-8
    c = raking.calibrated(cells, factors, 0.6)
    assert abs(sum(v * min(1, c * factors[k]) for k, v in cells.items()) / total - 0.6) < 1e-9
    assert raking.rake({}, targets) == {} and raking.calibrated({}, {}) == 0
    assert raking.rake({("s0", "l0", "9"): 5.0}, targets) == {("s0", "l0", "9"): 0.0}


def test_mix_columns(s, small, edge):
    got = QUERIES["op4_raking"](s, small).toPandas()
    assert len(got) == table(s, small, "documents").count()
    kept = got[got.sampled]
    share = (kept.n_tokens * 1.0).sum() / got.n_tokens.sum()
    assert 0.35 < share < 0.65
    cells = got.groupby(["source", "lang", "topic"]).agg(t=("n_tokens", "sum"), f=("factor", "first"), p=("probability", "first"), w=("sample_weight", "first"))
    by_source = (cells.t * cells.p * cells.w).groupby("source").sum()
    want = raking.tempered(got.groupby("source").n_tokens.sum().to_dict(), 0.5)
    assert max(abs(by_source / by_source.sum() - np.array([want[k] for k in by_source.index]))) < 0.02
    out = raking.mix(edge)
    assert out.columns == [*edge.columns, "__mix"] and out.count() == edge.count()
    assert out.where("coalesce(text, '') = '' and __mix.sampled").count() == 0
    assert raking.mix(edge.limit(0)).count() == 0


@pytest.mark.parametrize("given", [False, True])
def test_spark_rakes_as_the_driver_does(s, given):
    rng = random.Random(5)
    cells = {(f"s{a}", f"l{b}", str(c)): rng.randrange(1, 900) for a in range(4) for b in range(3) for c in range(3) if rng.random() > 0.2}
    targets = {"source": {"s0": 0.6, "s1": 0.4, "s3": 0.0, "nowhere": 0.5}} if given else {}
    want = {tuple(r[:3]): r[3:] for r in raking._chances(cells, targets, 0.4) if r[3]}
    frame = s.createDataFrame([(*k, n) for k, n in cells.items()], "source string, lang string, topic string, tokens long")
    got = {tuple(r[:3]): tuple(r[3:]) for r in raking.rake_by_spark(frame, targets, 0.4, close=1e-6).collect()}
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k], rtol=1e-4) for k in want)
    assert raking.rake_by_spark(frame.limit(0), {}, 0.4).collect() == []


def test_mix_beyond_the_drivers_cells(s, small, monkeypatch):
    docs = table(s, small, "documents")
    columns = ["factor", "probability", "sample_weight"]
    one = by_id(raking.mix(docs).select("doc_id", "__mix.*"), *columns)
    monkeypatch.setattr(raking, "MAX_CELLS", 3)
    monkeypatch.setattr(raking, "ROUNDS", 3)
    other = by_id(raking.mix(docs).select("doc_id", "__mix.*"), *columns)
    assert one.keys() == other.keys() and np.allclose([one[k] for k in one], [other[k] for k in one], rtol=0.2)


def test_word_hashes_keep_no_words():
    """They kept a table of 200,000, slower to look up than the hashes are to make."""
    words = [b"w%d" % k for k in range(50_000)]
    hashes = WordHashes()
    tracemalloc.start()
    got = hashes(words)
    kept = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert got[:2].tolist() == [xxhash.xxh3_64_intdigest(w) for w in words[:2]] and kept < 2 * got.nbytes


def test_packed_vectors_come_back():
    n, x = raking.word_counts(WordHashes(), ["", "a b A", " ", "c " * 300])
    assert n.tolist() == [0, 3, 0, 300] and (raking.unpacked(raking.packed(x)) == x).all()
    assert x[3].max() == raking.SCALE and np.count_nonzero(x, axis=1).tolist() == [0, 2, 0, 1]


def test_topics_and_draws_from_scratch(s, small):
    """The query once more with numpy over all rows: vectors, factors and draws."""
    rows = QUERIES["op4_raking"](s, small).collect()
    texts = dict(pairs(s, small, "documents", "doc_id", "text"))
    cells = {}
    for r in rows:
        n = len(plain.SPACED.findall(texts[r.doc_id] or ""))
        assert r.n_tokens == n and (r.topic == "-1") == (n == 0)
        if n:
            cells[r.source, r.lang, r.topic] = cells.get((r.source, r.lang, r.topic), 0) + n
    weight, whole = dict.fromkeys(cells, 1.0), sum(cells.values())
    for _ in range(400):
        for d, power in enumerate((0.5, 0.7, 0.9)):
            total, now = {}, {}
            for k, n in cells.items():
                total[k[d]] = total.get(k[d], 0) + n
                now[k[d]] = now.get(k[d], 0) + n * weight[k]
            goal = sum(v**power for v in total.values())
            weight = {k: w * total[k[d]] ** power / goal * whole / now[k[d]] for k, w in weight.items()}
    low, high = 0.0, 1e6
    for _ in range(200):
        c = (low + high) / 2
        low, high = (c, high) if sum(n * min(1, c * weight[k]) for k, n in cells.items()) < 0.5 * whole else (low, c)
    for r in rows:
        want = weight.get((r.source, r.lang, r.topic), 0.0)
        assert r.factor == pytest.approx(want, rel=1e-6) and r.probability == pytest.approx(min(1, c * want), rel=1e-6)
    # Draws are even: the sampled share of each probability band is near it.
    chance, taken = np.array([r.probability for r in rows]), np.array([r.sampled for r in rows])
    assert abs(chance.sum() - taken.sum()) < 4 * np.sqrt((chance * (1 - chance)).sum())


def test_topics_come_from_all_documents(s, small):
    docs = table(s, small, "documents")
    middle, centres = raking.fit_topics(docs, 4, limit=20, rounds=60)
    _, x = raking.word_counts(raking.WordHashes(), [t for _, t in pairs(s, small, "documents", "doc_id", "text") if (t or "").split()])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    m = x.mean(0)
    assert np.abs(middle / raking.SCALE - m).max() < 1e-4  # the mean of all, not of 20
    x = (x - m) / np.linalg.norm(x - m, axis=1, keepdims=True)
    own = (x @ centres.T).argmax(1)
    for k, c in enumerate(centres / raking.SCALE):
        mean = x[own == k].mean(0)
        assert (own == k).any() and c @ mean / np.linalg.norm(mean) > 0.999  # each centroid is the mean of all its documents
    again = raking.fit_topics(docs.repartition(7), 4, limit=20, rounds=60)
    assert (again[0] == middle).all() and (again[1] == centres).all()


def test_copies_leave_small_topics_their_centroids(s):
    small_groups = [f"{a} {a}{i} {a}{i + 1} {a}{i + 2}" for a in ("cat", "dog", "fish") for i in range(3)]
    d = s.createDataFrame(list(enumerate(["the same text again and again"] * 3000 + small_groups)), "doc_id long, text string")
    model = raking.fit_topics(d, 4, limit=100)
    topics = {r.text.split()[0]: set() for r in d.collect()}
    for r in d.select("text", raking.vector_topic(model, raking.vector_column("text")["vector"]).alias("k")).collect():
        topics[r.text.split()[0]].add(r.k)
    assert all(len(k) == 1 for k in topics.values()) and len(set.union(*topics.values())) == 4


def test_rows_that_share_an_id_are_fitted_once(s, small):
    docs, labels = table(s, small, "documents"), table(s, small, "labels")
    d = docs.join(labels.where("quality in (0, 1)").select("doc_id"), "doc_id").select(docs.columns)
    many = d.limit(1).crossJoin(s.range(300)).select(docs.columns)
    once, more = line_quality.fit_lines(docs, labels), line_quality.fit_lines(docs.union(many), labels)
    assert (once.weights == more.weights).all() and (once.steps == more.steps).all()


def test_components(s):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    parent = {v: v for e in edges for v in e}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        p, q = sorted((root(a), root(b)))
        parent[q] = p
    got = dict(tuple(r) for r in components(s.createDataFrame(edges, "x long, y long")).collect())
    alone = {v for v in parent if v not in got}
    assert got == {v: root(v) for v in parent if v not in alone} and all(root(v) == v for v in alone)
    assert components(s.createDataFrame([], "x long, y long")).count() == 0


@settings(max_examples=25, deadline=None)
@given(st.sets(st.integers(0, 2**63), min_size=1, max_size=60), st.sets(st.integers(0, 2**63), min_size=1, max_size=60))
def test_sketches_merge(a, b):
    sketch = setsketch.Sketcher()
    x, y, z = (np.array(sorted(v), np.uint64) for v in (a, b, a | b))
    assert (setsketch.merged_sketch(sketch(x), sketch(y)) == sketch(z)).all()


def test_joint_estimate():
    rng, sketch = np.random.default_rng(2), setsketch.Sketcher(512)
    for j, n in ((0.1, 400), (0.5, 900), (0.8, 500)):
        both = int(2 * n * j / (1 + j))
        e = rng.integers(0, 2**63, 2 * n - both, np.uint64)
        a, b = sketch(e[:n]), sketch(e[n - both :])
        got = setsketch.joint_estimate(a[None], b[None], np.array([n]), np.array([n]))[0]
        assert abs(got - j) < 0.09


def family(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(edits):
            w[rng.randrange(len(w))] = f"w{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_near_duplicates_match_all_pairs(s, small, edge):
    columns = ("n_shingles", "component_id")
    docs = pairs(s, small, "documents", "doc_id", "text")
    assert by_id(QUERIES["op7_setsketch"](s, small), *columns) == plain.near(docs)
    rng = random.Random(9)
    texts = []
    for k in range(12):  # copies and variants around the threshold, base text absent
        base = [f"b{k}x{rng.randrange(5000)}" for _ in range(rng.choice((3, 20, 60, 200)))]
        texts += family(rng, base, 25, max(1, len(base) // rng.choice((18, 25, 40)))) + [" ".join(base)] * (k % 3)
    rng.shuffle(texts)
    made = s.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    assert by_id(setsketch.near_duplicates(made), *columns) == plain.near(list(enumerate(texts)))
    got = by_id(setsketch.near_duplicates(edge), "n_shingles", "component_id", "kept")
    want = plain.near(list(enumerate(EDGE_TEXTS)))
    assert {d: v[:2] for d, v in got.items() if d is not None} == want and got[None][1:] == (None, True)
    left = setsketch.without_near_duplicates(edge)
    assert left.columns == edge.columns
    assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == sorted(d for d, v in want.items() if v[1] == d)
    assert setsketch.near_duplicates(edge.limit(0)).count() == 0


def test_signs_after_words_are_words_of_their_own():
    from tokenizers import Tokenizer

    whole, encoder = Tokenizer.from_file(TOKENIZER), bit_planes.WordEncoder(TOKENIZER)
    assert encoder(["the### or### the*** or*** the or"])[0].tolist() == whole.encode("the### or### the*** or*** the or", add_special_tokens=False).ids
    assert len(encoder.known) == 4  # each pair was learned
    rng = random.Random(6)
    parts = ["a", "bel", "É", "é", "ß", "ÿ", "÷", "7", "'", "'s", "’", ".", "***", "%", "<", "|", "\u0301", "\u0338", "İ", "²", "日", " ", "\n", "\u00a0", "\u2003", "\x85", "\x1c", "\\", "]", "^", "-", "~"]
    texts = ["".join(rng.choices(parts, k=12)) for _ in range(3_000)]
    for text, ids in zip(texts, encoder(texts)):
        assert ids.tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_tasks_of_a_process_share_an_encoder(monkeypatch):
    made, kept = [], SimpleNamespace(value={})  # stands for the broadcast
    monkeypatch.setattr(bit_planes, "WordEncoder", lambda *a, make=bit_planes.WordEncoder: made.append(a) or make(*a))
    monkeypatch.setattr(bit_planes, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)))
    write = bit_planes._write_chunks(kept, TOKENIZER, 2, 64, False, False)
    first, again = (pd.concat(write(iter([pd.DataFrame({"doc_id": [1, 2], "text": ["some words", None]})]))) for _ in range(2))
    assert len(made) == 1 and first.equals(again) and first["n_ids"].tolist() == [len(kept.value["encoder"](["some words"])[0]) + 2]


def test_encoder_forgets_and_goes_the_whole_way(monkeypatch, tmp_path):
    """Words stay right when most are forgotten, and tokenizer files of other steps are not split."""
    import json

    from tokenizers import Tokenizer

    monkeypatch.setattr(bit_planes, "WORDS_KEPT", 60)
    rng = random.Random(3)
    letters = ["a", "b", "é", "ß", "'s", "x", ",", ".", "1", "-", "Ü", "—", "!"]
    texts = [" ".join("".join(rng.choices(letters, k=rng.randrange(1, 6))) for _ in range(40)) + rng.choice(["", ", ", ". the the", " ,b"]) for _ in range(80)]
    whole, encoder = Tokenizer.from_file(TOKENIZER), bit_planes.WordEncoder(TOKENIZER)
    assert not encoder.whole
    for k in range(0, 80, 4):
        got = encoder(texts[k : k + 4])
        assert [x.tolist() for x in got] == [whole.encode(t, add_special_tokens=False).ids for t in texts[k : k + 4]]
    with open(TOKENIZER) as file:
        made = json.load(file)
    made["normalizer"]["normalizers"].pop()  # letters keep their case
    path = tmp_path / "cased.json"
    path.write_text(json.dumps(made))
    cased, encoder = Tokenizer.from_file(str(path)), bit_planes.WordEncoder(str(path))
    assert encoder.whole
    assert [x.tolist() for x in encoder(["The THE the", "A b"])] == [cased.encode(t, add_special_tokens=False).ids for t in ["The THE the", "A b"]]
