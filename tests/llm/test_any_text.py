"""Line labels, class prior and readers: what holds for any text, order of lines and length."""

import random
import re
import time

import numpy as np
import pytest

from cohorta.llm import html_lstm, line_quality, pii_crf, pu_quality
from cohorta.llm.crf import viterbi
from cohorta.llm.registry import QUERIES, SQL, prepare, table
from tests.check_queries import compare, duck
from tests.llm.test_more import plain_base


@pytest.fixture(scope="module")
def s(spark):
    return prepare(spark)


@pytest.mark.parametrize("name", ["op1_fm_index", "op7_setsketch"])
def test_sql_says_the_same(s, folder, name):
    df = QUERIES[name](s, folder)
    assert compare(df, duck(folder), SQL[name]) is None


# lines

def test_lines_of_mixed_texts(s, folder):
    """Every line of made-up mixtures, against where it comes from."""
    model = line_quality.fit_lines(table(s, folder, "documents"), table(s, folder, "labels"))
    assert model.steps[0, 1] > -2.5 and model.steps[1, 0] > -2.5  # labels may change inside a text
    docs = table(s, folder, "documents").join(table(s, folder, "labels"), "doc_id").where("text is not null").orderBy("doc_id").collect()
    good = [[line for line in d.text.split("\n") if len(line.split()) >= 4] for d in docs if d.quality == 1]
    good = [own for own in good if len(set(own)) == len(own) >= 4]
    junk = [line for d in docs if d.quality == 0 for line in d.text.split("\n") if sum(map(line.count, "#*$%&|")) >= 6 or line.count("!!") >= 4]
    rng, reader, right, total = random.Random(4), line_quality.LineReader(), 0, 0
    for _ in range(150):
        own, other = rng.choice(good)[:6], rng.sample(junk, min(6, len(junk)))
        k = rng.randrange(1, len(own))
        lines, want = own[:k] + other + own[k:], [1] * k + [0] * len(other) + [1] * (len(own) - k)
        got = reader(["\n".join(lines)])
        label = viterbi(model.emissions(got["x"]), got["n_lines"], model)
        right, total = right + int((label == np.array(want)).sum()), total + len(want)
    assert right / total > 0.9


def test_some_documents_hold_both_kinds(s, folder):
    rows = QUERIES["op3_line_quality"](s, folder).join(table(s, folder, "labels"), "doc_id").where("n_words >= 20").collect()
    share = np.array([r.content_share for r in rows])
    assert 0.03 < ((share > 0) & (share < 1)).mean() < 0.5
    assert np.mean([r.kept == (r.quality == 1) for r in rows if not r.base_failed]) > 0.95


def test_constraint_on_shares():
    label, margin, words = np.array([1, 1, 1, 0, 0]), np.array([3.0, 1.0, 2.0, -1.0, -2.0]), np.array([4, 5, 6, 3, 2])
    bad = line_quality.constrained(label, margin, words, np.array([5]), np.array([0]))
    assert bad.tolist() == [1, 0, 1, 0, 0]  # the line nearest to boilerplate, which makes it half
    good = line_quality.constrained(label, margin, words, np.array([5]), np.array([1]))
    assert good.tolist() == label.tolist()
    both = line_quality.constrained(np.zeros(4, int), np.array([-1.0, -3.0, -2.0, -9.0]), np.array([2, 2, 2, 0]), np.array([3, 1]), np.array([1, 1]))
    assert both.tolist() == [1, 0, 1, 0]


# class prior

@pytest.mark.parametrize("where", ["sf0.001", "sf0.01", "sf0.1"])
def test_prior_and_ranking_over_seeds(s, where):
    rows = table(s, f"/root/testdata/{where}", "documents").join(table(s, f"/root/testdata/{where}", "labels"), "doc_id", "left").select("doc_id", "text", "quality", pu_quality.held_out().alias("held")).collect()
    x = pu_quality.StyleReader()([r.text or "" for r in rows])
    y, held = np.array([-1 if r.quality is None else r.quality for r in rows]), np.array([r.held for r in rows])
    share, test = (y[y >= 0] == 1).mean(), held & (y >= 0)
    for seed in range(20 if where != "sf0.1" else 4):
        rng = np.random.default_rng(seed)
        limit = 1_000 if where == "sf0.1" else pu_quality.FIT_DOCS
        p, u = (rng.permutation(np.flatnonzero(k))[:limit] for k in ((y == 1) & ~held, ~held))
        both = np.concatenate((x[p], x[u]))
        scaled = lambda a: (a - both.mean(0)) / (both.std(0) + 1e-6)
        prior = pu_quality.estimate_prior(scaled(x[p]), scaled(x[u]))
        assert abs(prior - share) < 0.04
        score = pu_quality.fit(x[p], x[u], prior, seed=100 * seed).score(x[test])
        good, bad = score[y[test] == 1], score[y[test] == 0]
        assert np.mean((good[:, None] > bad) + (good[:, None] == bad) / 2) > 0.93


# readers

def in_time(work, limit=8.0):
    start = time.time()
    out = work()
    assert time.time() - start < limit
    return out


MB = 1_000_000
PAGES = {
    "open tags": "<a" * (MB // 2), "open quotes": '<a "' * (MB // 4), "quote behind": "<a<a" * (MB // 8) + '"x"', "two quotes": "<a \"<a '" * (MB // 8), "nested": "<div>x" * (MB // 6),
    "raw": "<script " * (MB // 8), "marks": "<!" * (MB // 2), "number": "&#" + "9" * MB + ";", "zeros": "&#" + "0" * MB + "65;", "unmatched ends": "<div>" * (MB // 10) + "</b2>" * (MB // 10), "lists": "<ul>" + "<foo><li></li>" * (MB // 14),
    "one line": "<p>" + "x" * MB + "</p>", "comment": "<!--" + "-" * MB, "closing spaces": "<script>" + "</script " * (MB // 9),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages_are_read_in_proportion(name):
    in_time(lambda: html_lstm.blocks(PAGES[name]))


def test_references_of_any_length():
    assert html_lstm.blocks("<p>a&#" + "9" * 5_000 + ";b&#" + "0" * 5_000 + "65;c&#x41;d</p>")[0][1] == "a�bAcAd"


TEXTS = {
    "digits": "9" * MB + ".1.1.1", "zeros": "0" * MB + ".0.0.0", "chain": "1." * (MB // 2), "letters": "a" * MB + "@", "signs": "@a" * (MB // 2), "short": "a@" * (MB // 2), "brackets": "+1" + "(" * MB,
    "domain": "x@" + "a." * (MB // 2), "spelled": "a" * (MB // 2) + "[at]" + "b" * (MB // 2), "many spelled": "a[at]b" * (MB // 6), "quotes": '"' * MB + "1", "cues": "token=" * (MB // 6),
}


@pytest.mark.parametrize("name", TEXTS)
def test_personal_data_in_proportion(name):
    pii_crf.fitted()
    got = in_time(lambda: pii_crf.find_personal(pii_crf.fitted())()([TEXTS[name]]))
    assert len(got["n_base"]) == 1


def test_base_spans_equal_the_patterns():
    rng = random.Random(7)
    parts = ["a", "1", ".", "@", "%", "-", "+", "0", "25", "256", "(", ")", " ", "b.c", "4111111111111111", "\n", "é", "_", "00", "\t"]
    for _ in range(30_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 26)))
        assert pii_crf.base_spans(text) == plain_base(text), text
    assert pii_crf.base_spans("9" * 5_000 + ".1.1.1") == [] and pii_crf.base_spans("0" * 5_000 + ".1.1.1") == [("ip", 0, 5_006)]


def test_lines_left_out_hold_nothing(s, folder):
    """Decoding every line finds what decoding the suspect ones finds."""
    texts = [r.text or "" for r in table(s, folder, "documents").select("text").collect()]
    work = pii_crf.find_personal(pii_crf.fitted())
    some = work()(texts)
    model, known = pii_crf.fitted(), {}
    for text, kinds, n in zip(texts, some["kinds"], some["n_base"]):
        if kinds:
            continue
        for _, line in pii_crf.lines_of(text):
            words = [w for _, w in pii_crf.words_of(line)]
            if words:
                assert not viterbi(model.emissions(pii_crf.line_features(words, known)), np.array([len(words)]), model).any(), line[:200]
    assert any(re.search("secret", " ".join(k)) for k in some["kinds"])
