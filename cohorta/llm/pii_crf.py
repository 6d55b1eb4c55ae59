"""Personal data by patterns and by a linear-chain conditional random field.

The patterns give the base spans. The field labels the words of a line from their shapes
and from what stands before them; it is fitted on a small table of labelled lines and
adds the spans the patterns do not reach: keys and passwords, with or without digits,
spelled-out addresses, and numbers written in ways the patterns miss. A span of the field that touches a base span is left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohorta.llm.crf import ChainModel, train, viterbi
from cohorta.llm.registry import texts
from cohorta.llm.udf import on_texts

# The contract's patterns, taken apart so that no place is read again for every start before it:
# an address from its sign outwards, an IP as four links of a chain of numbers.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
NUMBERS = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
SUSPECT = re.compile(r"[0-9@]")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", "email", "ip", "card", "phone", "secret")
FIELDS = "kinds array<string>, starts array<int>, ends array<int>, n_base int"
CUE_WORDS = {"token", "key", "apikey", "api_key", "secret", "password", "passwd", "pwd", "auth", "bearer", "credential"}
#: One of these is in every cue word, in lower case.
CUE_STEMS = ("token", "key", "secret", "passw", "pwd", "auth", "bearer", "credential")
#: A cue word and its sign written on to the value.
GLUED = re.compile(r"[\"'`({\[<]*(?:" + "|".join(sorted(CUE_WORDS)) + r")[\"'`]?(?::=|=>|[=:])(?=[^=:>])", re.IGNORECASE)
FILLER = "the of and to in that it was for on are as with his they at be this from have or by one had not".split()
#: Words that are no secret even after a cue word and a sign.
COMMON = {*FILLER, *"a an is no none null true false yes we you he she i my your our if when who what which all any its their see use here".split()}
#: Last words of spelled-out addresses; behind a bracketed (at) any word will do.
ENDINGS = set("com org net edu gov mil info biz io co uk de fr es eu ch nl se pl ru cn jp br au ca app dev".split())
#: An address with a spelled-out sign, from the sign outwards.
BEFORE_SIGN, SIGN = re.compile(r"[\w.+-]"), re.compile(r"[(\[{]at[)\]}]", re.IGNORECASE)
BEHIND_SIGN = re.compile(r"[\w-]++(?:(?:\.|[(\[{]dot[)\]}])[\w-]++)++", re.IGNORECASE)
PHONE_WORDS = {"phone", "tel", "call", "mobile", "fax", "telephone"}
#: Signs around a span that are no part of it.
EDGES = "\"'`,;:!?[]{}<>#*$%&|=~"
FEATURES = 26


def digits(s: str) -> list[int]:
    return [int(c) for c in s if "0" <= c <= "9"]


def luhn(s: str) -> bool:
    d = digits(s)[::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`."""
    end, at = 0, text.find("@")
    while at >= 0:
        found = DOMAIN.match(text, at + 1)
        start = at
        while found and start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of `[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)`, parts at most 255."""
    for chain in NUMBERS.finditer(text):
        parts, at = chain[0].split("."), chain.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            # A part may have any number of digits, which int() would refuse.
            if all(len(v := x.lstrip("0")) <= 3 and int(v or 0) <= 255 for x in four):
                yield at, at + size
            at += size + 1


def spelled_sign(word: str) -> bool:
    """Whether a word holds an address such as jo[at]mail[dot]example.com."""
    return any(m.start() and BEFORE_SIGN.match(word, m.start() - 1) and BEHIND_SIGN.match(word, m.end()) for m in SIGN.finditer(word))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by kind as listed in KINDS, then start. A match that fails its check is
    dropped and the search goes on behind it."""
    out = []
    if "@" in text:
        out += [("email", *span) for span in emails(text)]
    if DIGIT.search(text):
        out += [("ip", *span) for span in addresses(text)]
        out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m[0])) <= 19 and luhn(m[0])]
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return out


def shape(word: str) -> tuple[float, ...]:
    """Features of a word by itself."""
    core = word.strip("\"'`.,;:!?()[]{}<>")
    n = len(core)
    d = sum("0" <= c <= "9" for c in core)
    alpha = sum(c.isalpha() for c in core)
    low = core.lower()
    cue = word.strip(EDGES).lower() in CUE_WORDS
    return (
        1.0, float(cue), float(low in PHONE_WORDS), float(word in ("=", ":", ":=", "=>")), float(n > 20),
        float(d > 0 and d == n), float("@" in core), float(core.count(".") == 3 and d >= 4), float(d >= 1 and alpha >= 1 and n >= 16),
        float(d >= 13), float(core[:1] == "+"), float(7 <= d <= 12), float(1 <= d <= 4), float(core[:1] == "(" or word[:1] == "("), float(d > 0 and "-" in core),
        float(d > 0 and alpha > 0 and n < 16),
        float(cue and word[-1:] in (":", "=", ">")), float(alpha >= 4 and alpha == n), float(low in COMMON), float(spelled_sign(word)),
    )


def spelled_out(words: list[str]) -> np.ndarray:
    """Whether a word is part of an address such as 'jo dot doe at example dot com'."""
    out = np.zeros(len(words), bool)
    core = [w.strip("\"'`.,;:!?()[]{}<>").lower() for w in words]
    for i in range(1, len(words) - 3):
        if core[i] == "at" and core[i + 2] == "dot" and core[i - 1] and core[i + 1] not in COMMON:
            first, last = i - 1, i + 3
            while last + 2 < len(words) and core[last + 1] == "dot":
                last += 2
            while first >= 2 and core[first - 1] == "dot":
                first -= 2
            if core[last] in ENDINGS or (core[last] and words[i][0] in "([{"):
                out[first : last + 1] = True
    return out


def line_features(words: list[str], known: dict[str, tuple[float, ...]]) -> np.ndarray:
    """Features of a line's words; ``known`` remembers shapes."""
    if len(known) > 100_000:
        known.clear()
    for w in set(words).difference(known):
        known[w] = shape(w)
    own = np.array([known[w] for w in words])
    x = np.zeros((len(words), FEATURES))
    x[:, :5] = own[:, :5]
    x[1:, 5] = own[:-1, 3] + own[:-1, 1]  # after a cue or a sign
    x[2:, 6] = own[:-2, 1]  # two words after a cue
    x[:, 7:18] = own[:, 5:16]
    x[1:, 18] = own[:-1, 10] + own[:-1, 13]  # after a country code or a bracket
    x[1:, 19] = own[:-1, 2]
    x[1:, 20] = own[:-1, 16]  # after a cue with its sign, in one word or two
    x[2:, 20] = np.maximum(x[2:, 20], own[:-2, 1] * own[1:-1, 3])
    x[:, 21] = x[:, 20] * own[:, 17] * (1 - own[:, 18])  # and letters only
    x[:, 22] = spelled_out(words) if "dot" in (w.strip("()[]{}").lower() for w in words) else 0
    x[:, 23] = own[:, 18]
    x[:, 24] = own[:, 19]
    x[:, 25] = own[:, 17]
    return x


def labelled_lines() -> list[list[tuple[str, str]]]:
    """The training table: words with labels, one list per line. Made from a few patterns of
    what is and is not personal, in changing surroundings."""
    rng = np.random.default_rng(23)
    filler = FILLER
    number = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    code = lambda n, abc="0123456789abcdef": "".join(rng.choice(list(abc), n))
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-"
    quote = lambda s: f'"{s}"' if rng.random() < 0.5 else s
    plain = lambda low, high: code(int(rng.integers(low, high)), letters[:52] if rng.random() < 0.3 else letters[:26])
    cue = lambda: str(rng.choice(sorted(CUE_WORDS)))
    bracket = lambda w: f"({w})" if rng.random() < 0.3 else w
    makers = [
        lambda: [(str(rng.choice(sorted(CUE_WORDS))), "O"), (str(rng.choice(["=", ":"])), "O"), (quote(code(int(rng.integers(20, 48)))), "secret")],
        lambda: [(str(rng.choice(sorted(CUE_WORDS))), "O"), (quote(code(int(rng.integers(18, 48)), letters) + number(2)), "secret")],
        lambda: [(code(int(rng.integers(3, 9)), "abcdefghijkl") + number(2) + "@mail.example.com", "email")],
        lambda: [(".".join(str(x) for x in rng.integers(0, 256, 4)), "ip")],
        lambda: [(number(16), "card")],
        lambda: [("+" + number(2), "phone"), ("(" + number(3) + ")", "phone"), (number(3) + "-" + number(4), "phone")],
        lambda: [(str(rng.choice(sorted(PHONE_WORDS))), "O"), ("(" + number(3) + ")", "phone"), (number(3) + "-" + number(4), "phone")],
        lambda: [(number(int(rng.integers(1, 5))), "O")],
        lambda: [("version", "O"), (f"{rng.integers(1, 9)}.{rng.integers(0, 9)}.{rng.integers(0, 99)}", "O")],
        lambda: [(f"20{number(2)}-0{rng.integers(1, 9)}-1{rng.integers(0, 9)}", "O")],
        lambda: [(number(int(rng.integers(5, 9))), "O"), ("items", "O")],
        lambda: [(str(rng.choice(sorted(CUE_WORDS))), "O"), (str(rng.choice(filler)), "O")],
        lambda: [("item" + number(3), "O")],
        lambda: [(code(30, "abcdefghijkl"), "O")],
        # Letters only: secrets behind a cue and a sign, and what is none.
        lambda: [(cue(), "O"), (str(rng.choice(["=", ":", ":=", "=>"])), "O"), (quote(plain(4, 30)), "secret")],
        lambda: [(cue() + str(rng.choice(["=", ":"])), "O"), (quote(plain(4, 30)), "secret")],
        lambda: [(cue() + str(rng.choice(["=", ":"])), "O"), (quote(code(int(rng.integers(6, 40)), letters) + number(2)), "secret")],
        lambda: [(cue(), "O"), (plain(3, 12), "O")],
        lambda: [(cue(), "O"), (str(rng.choice(filler)), "O"), (plain(3, 12), "O")],
        lambda: [(cue() + ":", "O"), (str(rng.choice(filler)), "O"), (plain(3, 12), "O")],
        lambda: [(cue(), "O"), (str(rng.choice(["=", ":"])), "O"), (str(rng.choice(filler)), "O"), (plain(3, 12), "O")],
        lambda: [(plain(3, 12), "O"), (str(rng.choice(["=", ":"])), "O"), (quote(plain(3, 12)), "O")],
        lambda: [(plain(3, 12) + ":", "O"), (plain(3, 12), "O")],
        lambda: [(plain(3, 12), "O"), (plain(3, 12), "O")],
        lambda: [(plain(3, 9), "email"), (bracket("at"), "email"), (plain(3, 9), "email"), (bracket("dot"), "email"), (str(rng.choice(sorted(ENDINGS))), "email")],
        lambda: [(plain(3, 9) + "[at]mail[dot]example.com", "email")],
        lambda: [("look", "O"), ("at", "O"), ("the", "O"), ("dot", "O"), (str(rng.choice(filler)), "O")],
    ]
    out = []
    for _ in range(900):
        line = [(str(w), "O") for w in rng.choice(filler, int(rng.integers(0, 9)))]
        for maker in rng.permutation(len(makers))[: int(rng.integers(1, 4))]:
            line += makers[maker]() + [(str(w), "O") for w in rng.choice(filler, int(rng.integers(0, 6)))]
        out.append(line)
    return out


@lru_cache(maxsize=1)
def fitted() -> ChainModel:
    lines = [line for line in labelled_lines() if line]
    x = np.concatenate([line_features([w for w, _ in line], {}) for line in lines])
    y = np.array([LABELS.index(label) for line in lines for _, label in line])
    return train(x, y, np.array([len(line) for line in lines]), len(LABELS), rounds=100)


def suspect(text: str) -> bool:
    """Whether a text or line can hold a span at all: it has a digit, an at sign, a cue word or
    a spelled-out address. All other lines need no decoding."""
    if SUSPECT.search(text):
        return True
    low = text.lower()
    return any(c in low for c in CUE_STEMS) or ("dot" in low and "at" in low) or "[at]" in low or "(at)" in low or "{at}" in low


def words_of(line: str) -> Iterator[tuple[int, str]]:
    """Words with their places; a cue with its sign is a word apart from the value behind it."""
    for m in WORD.finditer(line):
        head = GLUED.match(m[0])
        if head:
            yield m.start(), head[0]
            yield m.start() + head.end(), m[0][head.end() :]
        else:
            yield m.start(), m[0]


def lines_of(text: str) -> Iterator[tuple[int, str]]:
    at = 0
    for line in text.split("\n"):
        yield at, line
        at += len(line) + 1


def find_personal(model: ChainModel):
    """Function for ``on_texts``: base spans, then those of the field, each by kind and start."""

    def make():
        known: dict[str, tuple[float, ...]] = {}

        def work(values: list[str]) -> dict:
            base = [base_spans(t) for t in values]
            words, lengths, x, owner = [], [], [], []
            for k, t in enumerate(values):
                if not suspect(t):
                    continue
                for at, line in lines_of(t):
                    if not suspect(line):
                        continue
                    own = [(at + start, w) for start, w in words_of(line)]
                    if own:
                        words += own
                        lengths.append(len(own))
                        x.append(line_features([w for _, w in own], known))
                        owner.append(k)
            added: list[list[tuple[str, int, int]]] = [[] for _ in values]
            if words:
                label = viterbi(model.emissions(np.concatenate(x)), np.array(lengths), model)
                at = 0
                for k, n in zip(owner, lengths):
                    added[k] += _spans(words[at : at + n], label[at : at + n])
                    at += n
            out = {"kinds": [], "starts": [], "ends": [], "n_base": []}
            for own, more in zip(base, added):
                # Base spans of different kinds may overlap: the farthest end among those that begin before a place.
                taken = np.array(sorted((a, b) for _, a, b in own)).reshape(-1, 2)
                reach = np.concatenate(([-1], np.maximum.accumulate(taken[:, 1]))) if taken.size else np.array([-1])
                more = [s for s in more if reach[np.searchsorted(taken[:, 0], s[2])] <= s[1]]
                more.sort(key=lambda s: (LABELS.index(s[0]), s[1]))
                for name, column in zip(("kinds", "starts", "ends"), zip(*(own + more)) if own or more else ((), (), ())):
                    out[name].append(list(column))
                out["n_base"].append(len(own))
            return out

        return work

    return make


def _spans(words: list[tuple[int, str]], label: np.ndarray) -> list[tuple[str, int, int]]:
    """Runs of equal labels, without the quotes and punctuation around them."""
    out, at = [], 0
    for i in np.flatnonzero(np.diff(label, append=-1)) + 1:
        if label[at]:
            first, last = words[at], words[i - 1]
            start = first[0] + len(first[1]) - len(first[1].lstrip(EDGES))
            end = last[0] + len(last[1].rstrip("." + EDGES))
            if start < end:
                out.append((LABELS[label[at]], start, end))
        at = i
    return out


def scan_personal(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, kinds, starts, ends (code points, end exclusive) and n_base: the
    first n_base spans are the patterns', the others the field's.

    Null and empty texts have none. Rows are scanned one by one, so repeated rows and null
    ids stay as they are; other columns are not read.
    """
    return texts(docs).select("doc_id", on_texts(find_personal(fitted()), FIELDS, "text").alias("p")).select("doc_id", "p.*")


def spelled(spans: DataFrame) -> DataFrame:
    """Counts of base spans per kind, the hash of the base spans, all spans as text, and their number."""
    each = F.zip_with(F.arrays_zip("kinds", "starts"), "ends", lambda s, e: F.concat_ws(":", s["kinds"], s["starts"], e))
    base = lambda c: F.slice(c, 1, F.col("n_base"))
    counts = [F.size(F.filter(base("kinds"), lambda k: k == kind)).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return spans.select("doc_id", *counts, F.sha2(F.array_join(base(each), ","), 256).alias("base_sha256"), F.array_join(each, ",").alias("spans"), F.size("kinds").cast("long").alias("n_spans"))
