"""Top-k join, conversation repair and spelling variants against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cohorta.llm import knn_join, queries, spelling, turn_repair  # noqa: F401 - queries registers
from cohorta.llm.registry import QUERIES, SQL, prepare, table
from tests.check_queries import compare, duck


@pytest.fixture(scope="module")
def s(spark):
    return prepare(spark)


# top-k join


def plain_best(rows, asked, k):
    """{(query id, vector): [(vec_id, score)]} by all products in whole numbers."""
    rows = [(i, [int(np.floor(x * 256)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, vector in sorted({(i, tuple(v)) for i, v in rows if asked(i)}):
        ended = lambda x: max(-(2**63), min(2**63 - 1, x))
        scored = sorted((-ended(sum(a * b for a, b in zip(vector, v))), i) for i, v in rows if i != q)
        out += [(q, r + 1, i, -score) for r, (score, i) in enumerate(scored[:k])]
    return sorted(out)


def test_top_k_matches_sql(s, small, folder):
    for where in (small, folder):
        assert compare(QUERIES["op11_voronoi_knn"](s, where), duck(where), SQL["op11_voronoi_knn"]) is None


@pytest.mark.parametrize("blocks", [{}, {"pivots": 5, "sample": 20, "query_block": 4, "data_block": 3}])
def test_top_k_on_odd_vectors(s, blocks):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=3).round(2).tolist()) for i in range(60)]
    rows += [(100 + i, [0.5, -0.5, 0.25]) for i in range(40)]  # equal vectors, many ties
    rows += [(150, [0.0, 0.0, 0.0]), (151, []), (152, [1.0]), (160, None), (170, [1.0, None, 2.0]), (180, [float("nan")] * 3), (190, [float("inf"), 0.0, 0.0]), (None, [9.0, 9.0, 9.0])]
    rows += [rows[3], (10, rows[10][1]), (-20, [3e15, 1.0, 2.0]), (210, [2e15, 1.0, -7.0])]
    df = s.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<double>, score int, cell string")
    got = sorted(tuple(r) for r in knn_join.knn_join(df, "vec_id % 10 = 0", k=4, **blocks).collect())
    assert got == plain_best(rows, lambda i: i % 10 == 0, 4)


def test_top_k_of_few_rows(s):
    frame = lambda rows: s.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert knn_join.knn_join(frame([]), "true").collect() == []
    assert knn_join.knn_join(frame([(0, None)]), "true").collect() == []
    assert knn_join.knn_join(frame([(0, [1.0])]), "true").collect() == []
    assert [tuple(r) for r in knn_join.knn_join(frame([(0, [1.0]), (7, [0.5])]), "vec_id = 0").collect()] == [(0, 1, 7, 256 * 128)]
    assert knn_join.knn_join(frame([(1, [1.0]), (7, [0.5])]), "vec_id = 0").collect() == []


def test_bounds_leave_out_far_cells():
    rng = np.random.default_rng(1)
    centres = np.floor(rng.normal(size=(8, 16)) * 500)
    x = np.repeat(centres, 50, 0) + rng.integers(-5, 6, (400, 16))
    least = knn_join.least_distances(x[::20], np.arange(400)[::20], centres, x, np.arange(400), 5)
    reach = [knn_join.distances(x[c * 50 : c * 50 + 50], centres[c : c + 1]).max() for c in range(8)]
    assert (least <= reach).sum(1).max() <= 2


# repair of conversations


def plain_repair(rows):
    """{conv_id: result}; rows are (conv_id, turn, role, text). The cheapest audit by a table of
    (cost, letters) over turns and states, one turn after the other."""
    convs = {}
    for conv, turn, role, text in rows:
        own = convs.setdefault(conv, [])
        name = lambda v: " " if v is None else str(v)
        kind = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        role, text = name(role) or " ", name(text)
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        own += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{r[1]}\0{r[2]}".encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in own:
            bare = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        moves = {"": "su", "s": "u", "u": "a", "a": "u"}
        best = {"": (0, "", ())}  # by the last initial; every prefix is closed under insertions

        def insert(best):
            for _ in range(3):
                for last, (cost, audit, lines) in list(best.items()):
                    to = "a" if last == "u" else "u"
                    new = (cost + 3, audit + "I", lines + (("user:" if to == "u" else "assistant:"),))
                    best[to] = min(best.get(to, new), new)
            return best

        for (_, role, text), fault in zip(own, faults):
            after = {}

            def offer(state, entry):
                after[state] = min(after.get(state, entry), entry)

            for last, (cost, audit, lines) in insert(best).items():
                offer(last, (cost + 4, audit + "D", lines))
                if fault in ("", "truncated"):
                    more = 3 if fault else 0
                    if role[:1] in moves[last]:
                        offer(role[:1], (cost + more, audit + "K", lines + (f"{role}:{text}",)))
                    to = "a" if last == "u" else "u"
                    offer(to, (cost + more + 3, audit + "R", lines + (("user:" if to == "u" else "assistant:") + text,)))
            best = after
        cost, audit, lines = min(best_end for state, best_end in insert(best).items() if state in ("", "a"))
        turns = [t for t, _, _ in own if t is not None]
        pairs = zip([r for _, r, _ in own], [r for _, r, _ in own][1:])
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
            sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def repaired(df):
    rows = df.select("conv_id", *COLUMNS).collect()
    out = {r[0]: tuple(r[1:]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_repair_matches_plain_version(s, folder):
    rows = [tuple(r) for r in table(s, folder, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = repaired(QUERIES["op12_run_length_repair"](s, folder))
    assert got == plain_repair(rows)
    assert any("R" in v[6] for v in got.values()) and any("I" in v[6] for v in got.values())


def test_repair_of_odd_conversations(s, monkeypatch):
    """Nulls, ties, repeats, one conversation over many partitions, blocks of a few characters."""
    rng = random.Random(4)
    text = lambda: rng.choice([None, "", " \t", "Yes.", "No", "What?", "a b c", "Fine!", f"t{rng.random()}", f"t{rng.random()}."])
    role = lambda: rng.choice(["user", "assistant", "system", None, "", "tool", "User", "assistant", "user"])
    rows = [(7, t if rng.random() > 0.05 else None, role(), text()) for t in range(700)]  # one conversation of most rows
    rows += [(8, t, "user", f"the same {t % 3}.") for t in range(300)]
    rows += [(c, rng.choice([None, *range(6)]), role(), text()) for c in [None, 1, 2, 3, 4, 5, 6] for _ in range(9)]
    rows += [(9, None, "user", "Again.")] * 40 + [(10, 2**62, "user", "Far."), (10, -3, "assistant", "x" * 200_000)]
    rows += [(c, 0, "user", "Alone.") for c in range(100, 160)]
    df = s.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, n int, part string")
    want = plain_repair(rows)
    assert repaired(turn_repair.repair_conversations(df.repartition(5))) == want
    monkeypatch.setattr(turn_repair, "BLOCK_CHARS", 50)
    s.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        assert repaired(turn_repair.repair_conversations(df.repartition(3))) == want
    finally:
        s.conf.set("spark.sql.shuffle.partitions", "8")
    assert turn_repair.repair_conversations(df.limit(0)).collect() == []


def test_powers_equal_single_steps():
    powers, rng = turn_repair.Powers(), random.Random(2)
    for _ in range(50):
        symbol, n = rng.randrange(9), rng.randrange(1, 70)
        end = turn_repair.END
        for k in range(1, n + 1):
            end = turn_repair.times(powers(symbol, 0), end)
            assert (powers.inside(symbol, n, turn_repair.END)[k] == end).all()
        assert (powers.advance(symbol, n, turn_repair.END) == end).all()


# spelling variants


def plain_variants(docs, min_count=3):
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= min_count}
    opened, near = {}, {w: set() for w in n}
    for w in n:
        for k in range(len(w)):
            opened.setdefault((w[:k], w[k + 1 :]), []).append(w)
            if (shorter := w[:k] + w[k + 1 :]) in n:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in opened.values():
        for w in group:
            near[w].update(x for x in group if x != w)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def variants(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_variants_match_plain_version(s, folder):
    docs = [tuple(r) for r in table(s, folder, "documents").select("doc_id", "text").collect()]
    got = variants(QUERIES["op13_trie_spelling"](s, folder))
    assert got == plain_variants(docs)
    assert any(v[0] for v in got.values()) and any(v[0] and v[1] != v[0] for v in got.values())


@pytest.mark.parametrize("depths", [40, 6])
def test_variants_of_odd_words(s, depths):
    """Chains, ties, repeated letters, signs among the letters, words past the trie's depths."""
    rng = random.Random(8)
    words = ["".join(rng.choice("ab") for _ in range(rng.randrange(4, 10))) for _ in range(150)]
    words += ["aaaaa" + "a" * k for k in range(8)] + ["À×÷ÿe", "à×÷ÿe", "naïveés", "naivesé"]
    words += ["long" * 30, "long" * 29 + "lon", "long" * 20 + "x" + "long" * 10, "long" * 20 + "y" + "long" * 10, "z" * 5_000, "z" * 5_001, "z" * 2_500 + "y" + "z" * 2_500]
    docs = [(i, " ".join(rng.choices(words, k=400))) for i in range(12)]
    docs += [(None, " ".join(words)), (20, None), (21, ""), (22, "WORDS-words_Words 12 ÅngströmĀ\U0001f600ångström"), docs[0], docs[0]]
    df = s.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, n int, word string")
    assert variants(spelling.spelling_variants(df, depths=depths)) == plain_variants(docs)


def test_variants_of_nothing(s):
    for rows in ([], [(1, None)], [(1, "few words")]):
        assert spelling.spelling_variants(s.createDataFrame(rows, "doc_id long, text string")).collect() == []
