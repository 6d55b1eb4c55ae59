"""Every stage of the pipeline on what the one before kept, against a plain version."""

import re

import corpus_pipeline
import pytest

import __spark_entry__ as entry
from cohorta.llm import line_quality
from cohorta.llm.queries import TOKENIZER
from cohorta.llm.registry import QUERIES, cut, prepare, table
from tests.llm import plain


@pytest.fixture(scope="module")
def s(spark):
    return prepare(spark)


def rows(df):
    return {r.doc_id: (r.text, r.lang, r.source, r.n_chars) for r in df.collect()}


def without_hits(text, items):
    """Text without the words that a phrase covers, None if no word is left."""
    spans = [m.span() for m in plain.PLAIN.finditer(text.translate(plain.LOWER))]
    w = plain.PLAIN.findall(text.translate(plain.LOWER))
    hit = set()
    for _, t in items:
        p = plain.PLAIN.findall((t or "").translate(plain.LOWER))
        for k in range(max(1, len(p) - 9) if p else 0):
            phrase = p[k : k + 10]
            hit.update(j for i in range(len(w) - len(phrase) + 1) if w[i : i + len(phrase)] == phrase for j in range(i, i + len(phrase)))
    if not hit:
        return text
    out, at = [], 0
    for i in sorted(hit):
        if i - 1 not in hit:
            out.append(text[at : spans[i][0]])
        at = spans[i][1]
    rest = "".join([*out, text[at:]])
    return rest if plain.PLAIN.search(rest.translate(plain.LOWER)) else None


def test_stages_match_plain_versions(s, small):
    from tokenizers import Tokenizer

    docs = table(s, small, "documents")
    columns = docs.columns
    stage = dict(corpus_pipeline.STAGES)
    names = [n for n, _ in corpus_pipeline.STAGES]

    good = cut(stage[names[0]](s, docs, small))
    assert good.columns == columns
    verdict = {r.doc_id: r.kept for r in line_quality.line_quality(docs, table(s, small, "labels")).select("doc_id", "__lines.kept").collect()}
    before = rows(docs)
    assert rows(good) == {d: v for d, v in before.items() if verdict[d]}
    assert all(not plain.line_counts(v[0])[-1] for v in rows(good).values())

    once = cut(stage[names[1]](s, good, small))
    near = plain.near([(d, v[0]) for d, v in rows(good).items()])
    assert once.columns == columns and rows(once) == {d: v for d, v in rows(good).items() if near[d][1] == d}

    clean = cut(stage[names[2]](s, once, small))
    items = [tuple(r) for r in table(s, small, "benchmark").select("item_id", "text").collect()]
    want = {d: (t, *v[1:3], v[3] if t == v[0] else len(t)) for d, v in rows(once).items() if (t := without_hits(v[0], items)) is not None}
    assert clean.columns == columns and rows(clean) == want

    mixed = cut(stage[names[3]](s, clean, small))
    kept = rows(mixed)
    assert mixed.columns == columns and kept.items() <= rows(clean).items() and 0.2 < len(kept) / len(want) < 0.9

    last = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in stage[names[4]](s, mixed, small).collect()}
    assert last == plain.encoded([(d, v[0]) for d, v in kept.items()], Tokenizer.from_file(TOKENIZER))
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(s, small).collect()} == last


def test_odd_rows_pass_all_stages(s, small):
    text = "a clean line of twenty different words which ends with some more of them so that the length rule lets it pass. "
    rows_ = [(1, text * 1, "en", None, None, 1), (2, None, None, None, None, None), (3, "", "en", "a", 0, 3), (None, text + "x", "en", "a", 5, 3), (1, text * 1, "en", None, None, 1), (5, text + "y " * 3, "en", "b", 1, None)]
    docs = s.createDataFrame(rows_, "doc_id long, text string, lang string, source string, n_chars long, words long")
    for frame in (docs, docs.limit(0)):
        for name, f in corpus_pipeline.STAGES[:-1]:
            frame = f(s, frame, small)
            assert frame.columns == docs.columns, name
            frame = cut(frame)
        corpus_pipeline.STAGES[-1][1](s, frame, small).collect()


def test_every_operator_is_registered():
    names = entry.queries()
    assert "pipeline" in names and {int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES} == set(range(1, 11))
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5
