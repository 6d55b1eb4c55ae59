"""Licence scan, tool calls, classifier, extraction and personal data."""

import hashlib
import json
import re

import numpy as np
import pytest

from cohorta.llm import html_lstm, license_diagonals, pii_crf, pu_quality, tool_calls
from cohorta.llm.queries import SCHEMAS, with_tool_calls
from cohorta.llm.registry import QUERIES, prepare, table
from tests.llm import plain
from tests.llm.test_core import by_id, pairs


@pytest.fixture(scope="module")
def s(spark):
    return prepare(spark)


def odd_rows(s, texts):
    rows = [(i, t, None, 1, "x") for i, t in enumerate(texts)] + [(None, "a null id", None, None, None), (3, texts[3], None, 1, "x")]
    return s.createDataFrame(rows, "doc_id long, text string, source string, n_words long, labels string")


# licence scan

BASE = {("gnu", "general", "public", "license"): "gpl", ("apache", "license"): "apache", ("cc", "by"): "cc-by", ("mit", "license"): "mit"}


def plain_places(text):
    w = plain.PLAIN.findall((text or "").translate(plain.LOWER))
    found = sorted((i, label) for p, label in BASE.items() for i in range(len(w)) if tuple(w[i : i + len(p)]) == p)
    return len(w), len(found), found[0][0] if found else None, found[-1][0] if found else None, ",".join(sorted({x for _, x in found}))


def test_license_base_matches_plain_version(s, folder):
    got = by_id(QUERIES["op5_license_diagonals"](s, folder), "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert got == {d: plain_places(t) for d, t in pairs(s, folder, "documents", "doc_id", "text")}


def plain_cover(text, template, k=4):
    """Largest share of the template's words in runs of k equal words near one diagonal."""
    w, t = (plain.PLAIN.findall(x.translate(plain.LOWER)) for x in (text or "", template))
    by_diagonal = {}
    for i in range(len(w) - k + 1):
        for j in range(len(t) - k + 1):
            if w[i : i + k] == t[j : j + k]:
                by_diagonal.setdefault(i - j, set()).update(range(j, j + k))
    best, run, last = 0, set(), None
    for d in sorted(by_diagonal):
        run = run | by_diagonal[d] if last is not None and d - last <= 3 else set(by_diagonal[d])
        best, last = max(best, len(run) / len(t)), d
    return best


def test_license_diagonals(s):
    t = license_diagonals.TEMPLATES
    mit = t["mit-text"]
    texts = [None, "", "  ", "mit license", "MIT License mit license, apache\nlicense", "x " * 5000 + mit + " y" * 5000, mit.replace("any person", "each any person").replace("without limitation", ""), " ".join(mit.split()[:20]), "gnu general public", (mit + " pad ") * 3, "CC-BY cc, by", "İK mit licensE"]
    d = odd_rows(s, texts)
    got = {r.doc_id: r for r in license_diagonals.scan_licenses(d).collect()}
    assert license_diagonals.scan_licenses(d).count() == d.count() and None in got
    for i, text in enumerate(texts):
        want = {name: c for name in t if (c := plain_cover(text, t[name])) >= license_diagonals.COVER}
        spans = {}
        for x in got[i].spans:
            spans[x.template] = max(spans.get(x.template, 0), x.cover)
        assert spans == pytest.approx(want), text
        assert (got[i].n_words, len(got[i].places)) == plain_places(text)[:2]
        assert set(got[i].labels) == set(want) | set(filter(None, plain_places(text)[4].split(",")))
        assert 0 <= got[i].score <= 1
    first = next(x for x in got[5].spans if x.template == "mit-text")
    assert (first["first"], first["end"]) == (5000, 5000 + len(plain.PLAIN.findall(mit)))
    assert license_diagonals.scan_licenses(d.limit(0)).count() == 0
    tiny = license_diagonals.scan_licenses(d, {"short": "mit license"}).where("size(spans) > 0")
    assert tiny.count() == 0


# tool calls

def call(i, name="answer", after=None, **arguments):
    return json.dumps({"id": i, "name": name, "arguments": arguments, **({"after": after} if after else {})})


def test_tool_calls(s):
    ok = {"query": "a", "chars": 1}
    rows = [
        (1, 0, "user", 'say "hi" \n é', "e"), (1, 1, "tool_call", call("a", **ok), "e"), (1, 2, "tool", '{"id":"a","content":{"z":1,"b":[2,{"y":1,"x":null}]}}', "e"),
        (1, 3, "tool_call", call("b", after="a", query="q", chars=2, system=True), "e"), (1, 4, "tool", '{"id":"b","content":"r"}', "e"),
        (1, 5, "tool_call", call("c", after="b", query="q"), "e"), (1, 6, "tool", '{"id":"zz","content":1}', "e"), (1, 7, "tool_call", "{broken", "e"), (1, 8, "tool_call", call("a", **ok), "e"),
        (2, 0, "tool_call", call("x", after="y", **ok), "e"), (2, 1, "tool_call", call("y", after="x", **ok), "e"), (2, 2, "tool", '{"id":"x"}', "e"),
        (2, 3, "tool_call", call("t", "other", **ok), "e"), (2, 4, "tool_call", call("w", query=3, chars=1), "e"), (2, 5, "tool_call", call("f", more=1, **ok), "e"), (2, 6, "tool_call", call("d", after="gone", **ok), "e"),
        (2, 7, "tool_call", '{"name":"answer","arguments":{}}', "e"), (2, 8, "tool_call", call("n", **ok), "e"), (2, 9, "tool_call", '{"id":"v","name":"answer","arguments":[1]}', "e"),
        (None, 0, "tool_call", call("a", **ok), None), (None, 1, "tool", '{"id":"a"}', None), (3, None, None, None, None), (3, None, None, None, None),
    ]
    m = s.createDataFrame(rows, "conv_id long, turn long, role string, text string, status string")
    schemas = tool_calls.schema_table(s, SCHEMAS)
    got = tool_calls.format_chat(m, schemas).collect()
    assert len(got) == len(rows)
    at = {(r.conv_id, r.turn): r for r in got}
    want = {
        (1, 1): ("ok", 0.0), (1, 2): ("ok", 0.5), (1, 3): ("ok", 1.0), (1, 4): ("ok", 1.5), (1, 5): ("missing field", 2.0), (1, 6): ("orphan result", None), (1, 7): ("bad json", None), (1, 8): ("duplicate id", None),
        (2, 0): ("cycle", None), (2, 1): ("cycle", None), (2, 2): ("cycle", None), (2, 3): ("unknown tool", 0.0), (2, 4): ("wrong type", 0.0), (2, 5): ("unexpected field", 0.0), (2, 6): ("unknown dependency", 0.0),
        (2, 7): ("no id", None), (2, 8): ("no result", 0.0), (2, 9): ("bad json", 0.0), (None, 0): ("no result", None), (None, 1): ("orphan result", None), (1, 0): ("ok", None),
    }
    assert {k: (at[k].status, at[k].level) for k in want} == want
    assert at[1, 1].json == '{"arguments":{"chars":1,"query":"a"},"id":"a","name":"answer","role":"tool_call"}'
    assert at[1, 2].json == '{"content":{"b":[2,{"x":null,"y":1}],"z":1},"id":"a","role":"tool"}'
    assert json.loads(at[1, 0].json) == {"content": 'say "hi" \n é', "role": "user"} and at[3, None].json == '{"content":null,"role":null}'
    assert tool_calls.format_chat(m.limit(0), schemas).count() == 0


def test_long_chains_and_whole_table(s, small):
    rows = [(1, i, "tool_call", call(f"c{i}", after=f"c{i - 1}" if i else None, query="q", chars=1)) for i in range(300)]
    got = tool_calls.format_chat(s.createDataFrame(rows, "conv_id long, turn long, role string, text string"), tool_calls.schema_table(s, SCHEMAS))
    assert {r.turn: r.level for r in got.collect()} == {i: float(i) for i in range(300)}
    conv = table(s, small, "conversations")
    messages = [tuple(r) for r in with_tool_calls(conv).collect()]
    out = QUERIES["op6_tool_calls"](s, small).collect()
    assert len(out) == len(messages)
    ids = {(c, json.loads(x)["id"]) for c, _, role, x in messages if role == "tool_call"}

    before = lambda t: [t - 2] * (t >= 2) + [t - 4] * (t >= 4 and t % 4 == 0)

    def level(c, t):
        return max([1 + level(c, b) for b in before(t) if (c, f"c{b}") in ids], default=0)

    answered = {(c, json.loads(x)["id"]) for c, _, role, x in messages if role == "tool"}
    for r in out:
        if r.role == "tool_call":
            assert r.level == level(r.conv_id, r.turn)
            loose = any((r.conv_id, f"c{b}") not in ids for b in before(r.turn))
            assert r.status == ("unknown dependency" if loose else "ok" if (r.conv_id, r.call_id) in answered else "no result")
        elif r.role == "tool":
            assert (r.status == "ok") == ((r.conv_id, r.call_id) in ids)
        assert json.dumps(json.loads(r.json), sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r.json


def plain_levels(after):
    """{id: level}: longest way up, null in a cycle and behind one."""
    out = {}

    def level(i, path):
        if i in path:
            return None
        if i not in out:
            ups = [level(p, path | {i}) for p in set(after[i]) if p in after]
            known = None if None in ups else max([u + 1 for u in ups], default=0)
            if known is None and path:
                return None
            out[i] = known
        return out[i]

    for i in after:
        level(i, frozenset())
    return out


def test_levels_of_graphs(s):
    import random

    rng = random.Random(6)
    graphs = [
        {"a": [], "b": ["a"], "c": ["a"], "d": ["b", "c"], "e": ["d", "a", "gone"], "f": ["e"], "g": ["f", "f"]},
        {"a": ["b"], "b": ["a"], "c": ["a", "d"], "d": [], "e": ["c"], "f": ["f", "d"], "g": ["d", "e"], "h": ["d"]},
        {f"n{i}": [f"n{i - 1}", f"n{i - 2}"] if i > 1 else [] for i in range(9)},
        *({f"x{i}": [f"x{rng.randrange(25 if rng.random() < 0.05 else max(1, i))}" for _ in range(rng.randrange(4))] for i in range(25)} for _ in range(6)),
    ]
    rows = [(k, i, list(ups)) for k, g in enumerate(graphs) for i, ups in g.items()] + [(50, f"l{i}", [f"l{i - 1}"] if i else []) for i in range(200)]
    got = {(r.conv_id, r.call_id): r.level for r in tool_calls.levels(s.createDataFrame(rows, "conv_id long, call_id string, after array<string>")).collect()}
    want = {(k, i): v for k, g in enumerate(graphs) for i, v in plain_levels(g).items()} | {(50, f"l{i}"): i for i in range(200)}
    assert got == want and None in got.values()


def test_schemas_with_rules(s):
    fields = {"n": ("number", True, {"minimum": 0, "maximum": 2.5}), "unit": ("string", False, {"enum": ["c", "f"]}), "tags": ("array<string>", False), "places": ("array<integer>", False), "more": ("array", False)}
    cases = [
        ({"n": 1}, "no result"), ({"n": 2.5, "unit": "c"}, "no result"), ({"n": 3}, "value not allowed"), ({"n": -0.1}, "value not allowed"), ({"n": 1, "unit": "k"}, "value not allowed"),
        ({"n": 1, "tags": ["a", "b"]}, "no result"), ({"n": 1, "tags": []}, "no result"), ({"n": 1, "tags": [1]}, "wrong type"), ({"n": 1, "places": [1, 2]}, "no result"), ({"n": 1, "places": [1, "x"]}, "wrong type"),
        ({"n": 1, "more": [1, "x"]}, "no result"), ({"n": 1, "tags": "a"}, "wrong type"), ({"unit": "c"}, "missing field"),
    ]
    rows = [(1, i, "tool_call", json.dumps({"id": f"i{i}", "name": "t", "arguments": a})) for i, (a, _) in enumerate(cases)]
    got = tool_calls.format_chat(s.createDataFrame(rows, "conv_id long, turn long, role string, text string"), tool_calls.schema_table(s, {"t": fields})).collect()
    assert {r.turn: r.status for r in got} == {i: status for i, (_, status) in enumerate(cases)}


def test_license_paragraphs(s):
    t = license_diagonals.TEMPLATES
    names = "mit-text mit-notice mit-warranty bsd-names bsd-binary bsd-warranty isc-text isc-warranty mpl-notice lgpl-notice agpl-notice gpl-warranty cc-by-sa-notice cc0-notice".split()
    d = s.createDataFrame([(i, "Some words before. " + t[n].upper() + " And after.") for i, n in enumerate(names)] + [(90, "\u212aeep the MIT License")], "doc_id long, text string")
    got = {r.doc_id: r for r in license_diagonals.scan_licenses(d).collect()}
    for i, n in enumerate(names):
        assert n in got[i].labels and got[i].score > 0.9
    assert "mit" in got[90].labels and got[90].n_words == 4


# classifier

def test_classifier_on_held_out_rows(s, folder):
    rows = QUERIES["op8_pu_quality"](s, folder).join(table(s, folder, "labels"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.93
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean([[(a > b) + (a == b) / 2 for b in bad] for a in good]) > 0.93


def test_classifier_columns(s, small):
    import zlib

    d = odd_rows(s, [None, "", "one", "some plain words here.", "x " * 20_000])
    labels = table(s, small, "labels")
    docs = table(s, small, "documents")
    got = pu_quality.score_quality(d, labels.limit(0)).collect()
    assert {r.score for r in got} == {0.5} and len(got) == d.count()
    assert {r.doc_id: r.held_out for r in got if r.doc_id is not None} == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(5)}
    got = by_id(pu_quality.score_quality(docs, labels), "score", "predicted")
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - quality else quality end as quality", "toxic")
    assert got == by_id(pu_quality.score_quality(docs, flipped), "score", "predicted")  # held-out labels play no part
    assert all(0 <= v <= 1 and p == (v >= 0.3) for v, p in got.values())
    assert pu_quality.score_quality(d.limit(0), labels).count() == 0


def test_non_negative_risk_finds_the_prior():
    rng = np.random.default_rng(6)
    good, bad = (lambda n: rng.normal(1.5, 1, (n, 3))), (lambda n: rng.normal(-1.5, 1, (n, 3)))
    p, u = good(800), np.concatenate((good(900), bad(300)))
    assert abs(pu_quality.estimate_prior((p - u.mean(0)) / u.std(0), (u - u.mean(0)) / u.std(0)) - 0.75) < 0.15
    model = pu_quality.fit(p, u)
    assert (model.score(good(500)) >= 0.3).mean() > 0.93 and (model.score(bad(500)) < 0.3).mean() > 0.85


# extraction

def test_extraction_of_the_tables_pages(s, folder):
    pages = {r.page_id: r.html for r in table(s, folder, "pages").collect()}
    right = 0
    for r in QUERIES["op9_html_lstm"](s, folder).collect():
        h = pages[r.page_id]
        body = re.split(r"</article>|<footer", h.split("<article>")[1])[0] if "<article>" in h else ""
        parts = [" ".join(html_lstm.entities.unescape(re.sub(r"<[^>]*>?", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        right += r.text == "\n\n".join(x for x in parts if x)
        assert r.n_chars == len(r.text)
    assert right / len(pages) > 0.97


def test_extraction_of_other_layouts():
    rng = np.random.default_rng(1234)
    work = html_lstm.extract(html_lstm.labeller())()
    made = [html_lstm.made_up_page(rng) for _ in range(150)]
    got = work([page for page, _ in made])["text"]
    want = ["\n\n".join(" ".join(html_lstm.entities.unescape(a).split()) for a in article) for _, article in made]
    hit = total = found = 0
    for g, w in zip(got, want):
        a, b = g.split("\n\n"), w.split("\n\n")
        hit += len(set(a) & set(b))
        found += len(set(a))
        total += len(set(b))
    assert hit / total > 0.95 and hit / found > 0.95


def test_blocks_and_odd_pages(s):
    assert html_lstm.blocks("<p>a &amp b&lt;<br>c<p><b>d <i>e</b></i><script>if (a<b) '</p>'</script> f") == [(("p",), "a & b< c", 0.0), (("p",), "d e f", 0.0)]
    assert html_lstm.blocks('<ul><li><a href="x>y">one</a><li>two</ul>x</div') == [(("ul", "li"), "one", 1.0), (("ul", "li"), "two", 0.0), ((), "x", 0.0)]
    assert html_lstm.blocks("<!-- a <p>b</p> --><div class='x-y' id=z>t</div><!-- open") == [(("div x y z",), "t", 0.0)]
    rows = [(1, "u", None), (2, None, ""), (None, None, "<p>"), (4, "u", "plain text < and > signs"), (4, "u", "plain text < and > signs"), (5, "u", "<article><p>" + "word " * 100_000 + "</p></article>")]
    d = s.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = html_lstm.extract_text(d).collect()
    assert len(got) == 6 and {r.page_id: r.text for r in got}[1] == "" and all(r.text is not None for r in got)
    assert len(next(r.text for r in got if r.page_id == 5)) == 499_999
    assert html_lstm.extract_text(d.limit(0)).count() == 0


# personal data

def plain_base(text):
    text, out = text or "", []
    luhn = lambda d: sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        out += [("ip", *m.span())] if max(map(int, m[0].split("."))) <= 255 else []
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        out += [("card", *m.span())] if 13 <= len(d) <= 19 and luhn(d) else []
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        out += [("phone", *m.span())] if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15 else []
    return out


def test_personal_data_matches_plain_patterns(s, folder):
    got = by_id(QUERIES["op10_pii_crf"](s, folder), "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans")
    docs = pairs(s, folder, "documents", "doc_id", "text")
    secrets = found = 0
    for d, t in docs:
        base = plain_base(t)
        spelled = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert got[d][:5] == (*(sum(x[0] == k for x in base) for k in pii_crf.KINDS), hashlib.sha256(spelled.encode()).hexdigest())
        assert got[d][5] == spelled or got[d][5].startswith(spelled + "," * bool(spelled))
        added = got[d][5][len(spelled) :].strip(",").split(",")
        for m in re.finditer(r'token = "([0-9a-f]{40})"', t):
            secrets += 1
            found += f"secret:{m.start(1)}:{m.end(1)}" in added
        assert got[d][6] == (got[d][5].count(",") + 1 if got[d][5] else 0)
    assert secrets and found / secrets > 0.98


def test_personal_data_odd_texts(s):
    texts = [None, "", "a@b", "x 4111 1111 1111 1111 y", "1.2.3.999 256.1.1.1 1.2.3.4.5", "+1 (555) 123-4567 +12", "é a@b.cc 😀 c@d.ee", "9" * 30_000, 'api_key: "Zx81kkQpLm02vvTt93Aa"\npassword = hunter', "version 1.2.3 of 2024-01-02 has 4000 items"]
    d = odd_rows(s, texts)
    got = {r.doc_id: r for r in pii_crf.scan_personal(d).collect()}
    assert pii_crf.scan_personal(d).count() == d.count() and got[None].kinds == []
    for i, t in enumerate(texts):
        own = list(zip(got[i].kinds, got[i].starts, got[i].ends))
        assert own[: got[i].n_base] == plain_base(t)
    assert ("secret", 10, 30) in list(zip(got[8].kinds, got[8].starts, got[8].ends)) and got[9].kinds == []
    assert pii_crf.scan_personal(d.limit(0)).count() == 0


def test_secrets_and_addresses_without_digits():
    texts = {
        "password = hunter": ["hunter"], "secret: correcthorsebattery": ["correcthorsebattery"], "the db is open\nmy Password: 'swordfish'; and more words": ["swordfish"],
        "password=hunter": ["hunter"], '{"token":"abcdefgh", "name":"jo"}': ["abcdefgh"], "pwd := opensesame\ntoken => letmein now": ["opensesame", "letmein"],
        "write to jo at example dot com or call": ["jo at example dot com"], "mail jo dot doe (at) mail dot example dot org": ["jo dot doe (at) mail dot example dot org"], "jo[at]example[dot]com": ["jo[at]example[dot]com"],
        "the key to the house is a secret garden": [], "password is wrong and the token ring failed": [], "key: the one of all": [], "secret : not known": [],
        "name = hunter\nnote: something": [], "look at the dot on it": [], "the author of that key figure": [], "all at once dot dot dot": [],
    }
    got = pii_crf.find_personal(pii_crf.fitted())()(list(texts))
    for (text, want), starts, ends in zip(texts.items(), got["starts"], got["ends"]):
        assert [text[a:b] for a, b in zip(starts, ends)] == want, text
    assert got["n_base"] == [0] * len(texts)
