"""Repair of conversations by the cheapest edits, as a min-plus product over runs of turns.

A turn is a symbol: the initial of its role and its fault. A symbol is a 4 x 4 min-plus
matrix: the cost from one state of the role order to another over that turn, insertions
before it included. A run of equal symbols is one power of its matrix, made of cached
binary powers, so costs take one step per run. Going back from the end this gives the
cost still to come at every run's border; inside a run the powers give it for all places
at once, doubling the places known, and the choices are then read off forwards.

States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant; 0 and 3 may end.

Conversations of any length. Rows lie in range partitions by (conversation, order). A
conversation inside one partition is settled there. One that crosses borders gets a
matrix product per part; the parts' products, a row each, are put together, which gives
each part its first state and the costs after it, and each part then writes its share of
the audit and of the repaired text. Only the text's hash has to run through the shares
in order, in blocks, as SHA-256 cannot be split.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohorta.llm.registry import cut
from cohorta.llm.words import utf8
from cohorta.session import ensure_checkpoint_dir

SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
FAR = 1 << 60
#: Symbols: twice the class of the initial (s, u, a, other), one more if truncated; REMOVED must go.
CLASSES, REMOVED = "sua", 8
#: State after a role, by the state before; None where the order forbids it.
AFTER = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
#: The one role that can be inserted, or given, in a state.
NEXT_ROLE = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
END = np.array([0, 2 * INSERT, INSERT, 0], np.int64)
#: The matrix of no turn at all.
NO_TURN = np.where(np.eye(4, dtype=bool), 0, FAR).astype(np.int64)
#: Characters of repaired text that a part hands on at once.
BLOCK_CHARS = 100_000
PATTERNS_HELD = 100_000
LEGAL = ("su", "ua", "au")  # initials that may follow each other


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Min-plus product; b may be a vector or a matrix."""
    b = b if b.ndim == 2 else b[:, None]
    out = np.minimum((a[:, :, None] + b[None, :, :]).min(1), FAR)
    return out if out.shape[1] > 1 else out[:, 0]


def edits(symbol: int, state: int) -> Iterator[tuple[str, int, int]]:
    """Edits of a turn in a state, in the order of their letters: letter, cost, state after. An
    insertion stays on the turn."""
    late = TRUNCATED if symbol != REMOVED and symbol % 2 else 0
    yield "D", DELETE, state
    yield "I", INSERT, NEXT_ROLE[state][1]
    if symbol != REMOVED:
        initial = CLASSES[symbol // 2 : symbol // 2 + 1]
        if state in AFTER.get(initial, {}):
            yield "K", KEEP + late, AFTER[initial][state]
        yield "R", REROLE + late, NEXT_ROLE[state][1]


def _matrix(symbol: int) -> np.ndarray:
    inserts = np.full((4, 4), FAR, np.int64)
    step = np.full((4, 4), FAR, np.int64)
    for s in range(4):
        inserts[s, s] = 0
        to, cost = s, 0
        for _ in range(2):  # two insertions reach every state that insertions reach
            to, cost = NEXT_ROLE[to][1], cost + INSERT
            inserts[s, to] = min(inserts[s, to], cost)
        for letter, cost_of, to in edits(symbol, s):
            if letter != "I":
                step[s, to] = min(step[s, to], cost_of)
    return times(inserts, step)


class Powers:
    """Binary powers of each symbol's matrix, made when first asked for."""

    def __init__(self):
        self.known = [[_matrix(s)] for s in range(REMOVED + 1)]

    def __call__(self, symbol: int, k: int) -> np.ndarray:
        own = self.known[symbol]
        while len(own) <= k:
            own.append(times(own[-1], own[-1]))
        return own[k]

    def advance(self, symbol: int, n: int, right: np.ndarray) -> np.ndarray:
        """The n-th power of a symbol's matrix times what comes after it."""
        k = 0
        while n >> k:
            if n >> k & 1:
                right = times(self(symbol, k), right)
            k += 1
        return right

    def inside(self, symbol: int, n: int, end: np.ndarray) -> np.ndarray:
        """Costs to come with 0 to n turns of a run left, one row each, given those after it."""
        out, k = end[None, :], 0
        while len(out) <= n:
            more = (self(symbol, k)[None, :, :] + out[:, None, :]).min(2)  # 2**k turns more
            out, k = np.concatenate((out, np.minimum(more, FAR))), k + 1
        return out[: n + 1]


Runs = list[tuple[int, int]]


def collapse(symbols: Iterable[tuple[int, int]]) -> Runs:
    """Runs of equal symbols, from symbols with how often each follows itself."""
    out: Runs = []
    for symbol, n in symbols:
        if out and out[-1][0] == symbol:
            out[-1] = (symbol, out[-1][1] + n)
        elif n:
            out.append((symbol, n))
    return out


def come_through(powers: Powers, runs: Runs, right: np.ndarray) -> np.ndarray:
    """Product of the runs' matrices with what comes after them (a vector or a matrix)."""
    for symbol, n in reversed(runs):
        right = powers.advance(symbol, n, right)
    return right


def unroll(powers: Powers, parts: Runs, state: int, end: np.ndarray, last: bool = True) -> tuple[str, int]:
    """Letters of the cheapest edits, ASCII-least among them, and the state after. ``end`` are
    the costs to come after the turns; ``last`` tells whether the conversation ends there."""
    after = [end]
    for symbol, n in reversed(parts):
        after.append(powers.advance(symbol, n, after[-1]))
    after.reverse()
    letters = []
    for (symbol, n), end_of_run in zip(parts, after[1:]):
        costs = powers.inside(symbol, n, end_of_run).tolist()
        options = [list(edits(symbol, s)) for s in range(4)]
        left = n
        while left:
            here = costs[left][state]
            for letter, cost, to in options[state]:
                if cost + costs[left if letter == "I" else left - 1][to] == here:
                    break
            letters.append(letter)
            state = to
            left -= letter != "I"
    while last and END[state]:
        letters.append("I")
        state = NEXT_ROLE[state][1]
    return "".join(letters), state


def repaired(letters: str, state: int, rows: Iterator[tuple[str, str]]) -> Iterator[str]:
    """The turns that the letters leave, as role:text."""
    for letter in letters:
        if letter == "I":
            role, state = NEXT_ROLE[state]
            yield role + ":"
            continue
        role, text = next(rows)
        if letter == "K":
            state = AFTER[role[0]][state]
            yield f"{role}:{text}"
        elif letter == "R":
            role, state = NEXT_ROLE[state]
            yield f"{role}:{text}"


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage, by crc32 of ``conv_id:turn`` modulo 20, where a null reads as one
    space. Equal rows are one row with their number ``n``. An empty role reads as one space too."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), filled("role").alias("role"), filled("text").alias("text"), kind.alias("kind"))
    role = F.when(F.col("kind") == 4, "user").when(F.col("role") == "", " ").otherwise(F.col("role"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    hit = c.where("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("n"))
    return hit.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))


def with_faults(rows: DataFrame) -> DataFrame:
    """fault of each row's first copy: 0 none, 1 blank, 2 duplicate, 3 truncated. Its further copies are
    blank like it, or duplicates."""
    bare = F.rtrim("text", F.lit(SPACE))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    r = rows.withColumn("mark", F.sha2(F.concat_ws("\x00", "role", "text"), 256))
    # Few texts come back in a conversation; only those are joined.
    seen = r.groupBy("conv_id", "mark").agg(F.min(place).alias("first"), F.count("*").alias("places")).where("places > 1")
    seen = seen.select(F.col("conv_id").alias("c"), F.col("mark").alias("m"), "first")
    r = r.join(seen, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("mark") == F.col("m")), "left")
    fault = F.when(bare == "", 1).when(place > F.col("first"), 2).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    return r.select("conv_id", "turn", "role", "text", "mark", "n", fault.alias("fault"))


def in_order(rows: DataFrame) -> DataFrame:
    """Rows in range partitions by conversation and order, which ``part`` numbers. Borders are drawn from a
    sample, so the rows are written down once for all readers."""
    spark = rows.sparkSession
    ensure_checkpoint_dir(spark)
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "mark"]
    ranged = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    return ranged.withColumn("part", F.spark_partition_id()).checkpoint()


def _symbol(role: str, fault: int) -> int:
    if fault in (1, 2):
        return REMOVED
    kind = CLASSES.find(role[0])
    return 2 * (kind if kind >= 0 else 3) + (fault == 3)


class _Part:
    """Rows of one conversation in one partition, in order."""

    def __init__(self, columns):
        self.turns, self.roles, self.texts, self.faults, self.n = columns

    def runs(self) -> Runs:
        first = map(_symbol, self.roles, self.faults)
        return collapse(pair for symbol, n in zip(first, self.n) for pair in ((symbol, 1), (REMOVED, n - 1)))

    def lines(self) -> Iterator[tuple[str, str]]:
        for role, text, n in zip(self.roles, self.texts, self.n):
            yield from repeat((role, text), n)

    def counts(self) -> dict:
        known = [t for t in self.turns if t is not None]
        initials = [r[0] for r in self.roles]
        copies = sum(self.n) - len(self.n)
        blank = sum(n for f, n in zip(self.faults, self.n) if f == 1)
        duplicate = self.faults.count(2) + sum(n - 1 for f, n in zip(self.faults, self.n) if f != 1)
        return {
            "blank": blank, "duplicate": duplicate, "truncated": self.faults.count(3),
            "illegal": copies + sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
            "least": known[0] if known else None, "most": known[-1] if known else None, "turns": len(set(known)),
            "first_role": initials[0], "last_role": initials[-1],
        }


def _parts(batches: Iterator[pd.DataFrame], extra: tuple[str, ...] = ()) -> Iterator[tuple[int | None, int, _Part, tuple]]:
    """Conversations of a sorted partition one after the other: id, number of the partition, rows, and the
    first row's value of each further column."""
    names = ("turn", "role", "text", "fault", "n")
    held, key, rest = None, None, ()
    for batch in batches:
        convs = [None if pd.isna(c) else int(c) for c in batch["conv_id"]]
        turns = [None if pd.isna(t) else int(t) for t in batch["turn"]]
        columns = [turns, *(batch[c].tolist() for c in names[1:])]
        start = 0
        for end in range(1, len(convs) + 1):
            if end < len(convs) and convs[end] == convs[start]:
                continue
            if held is None or key[0] != convs[start]:
                if held is not None:
                    yield *key, _Part(held), rest
                held, key, rest = [[] for _ in names], (convs[start], int(batch["part"].iloc[start])), tuple(batch[c].iloc[start] for c in extra)
            for own, column in zip(held, columns):
                own += column[start:end]
            start = end
    if held is not None:
        yield *key, _Part(held), rest


NUMBERS = "blank long, duplicate long, truncated long, illegal long, least long, most long, turns long"
PARTS = f"conv_id long, part long, {NUMBERS}, first_role string, last_role string, matrix array<long>, cost long, audit string, repaired_sha256 string"
JOINED = f"conv_id long, part long, {NUMBERS}, cost long, after array<long>, last boolean"
SHARES = "conv_id long, part int, block long, audit string, body binary"
HASHED = "conv_id long, audit string, repaired_sha256 string"


def _frame(rows: list[dict], schema: str) -> pd.DataFrame:
    fields = [c.split() for c in schema.split(", ")]
    columns = {c: [row.get(c) for row in rows] for c, _ in fields}
    return pd.DataFrame({c: pd.Series(v, dtype="Int64" if kind == "long" else object) for (c, v), (_, kind) in zip(columns.items(), fields)})


def _settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row per conversation of a partition: settled where none of it can lie beyond the
    partition, else its numbers here and its matrix."""
    powers, known, out = Powers(), {}, []
    parts = _parts(batches)
    now, inner = next(parts, None), False
    while now is not None:
        (conv, number, part, _), now = now, next(parts, None)
        row, own = {"conv_id": conv, "part": number, **part.counts()}, part.runs()
        # The first and the last conversation may go on in the neighbouring partitions.
        if inner and now is not None:
            pattern = tuple(own)
            if pattern not in known:
                if len(known) >= PATTERNS_HELD:
                    known.clear()
                known[pattern] = int(come_through(powers, own, END)[0]), unroll(powers, own, 0, END)[0]
            cost, audit = known[pattern]
            text = "\n".join(repaired(audit, 0, part.lines()))
            row |= {"cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(utf8(text)).hexdigest()}
        else:
            row["matrix"] = come_through(powers, own, NO_TURN).ravel().tolist()
        inner = True
        out.append(row)
        if len(out) >= 2_000:
            yield _frame(out, PARTS)
            out = []
    if out:
        yield _frame(out, PARTS)


def _join(group: pd.DataFrame) -> pd.DataFrame:
    """The parts of a conversation (one per partition it reaches): its numbers as a whole, and the
    costs that come after each part."""
    g = group.sort_values("part").reset_index(drop=True)
    after = [END]
    for m in reversed(g["matrix"].tolist()):
        after.append(times(np.array(m, np.int64).reshape(4, 4), after[-1]))
    after.reverse()
    known = [(int(a), int(b), int(n)) for a, b, n in zip(g["least"], g["most"], g["turns"]) if not pd.isna(a)]
    whole = {c: int(g[c].sum()) for c in ("blank", "duplicate", "truncated", "illegal")}
    whole["illegal"] += sum(a + b not in LEGAL for a, b in zip(g["last_role"], g["first_role"][1:]))
    # A turn on a border was counted on both sides of it.
    whole["turns"] = sum(n for _, _, n in known) - sum(a[1] == b[0] for a, b in zip(known, known[1:]))
    whole |= {"least": known[0][0] if known else None, "most": known[-1][1] if known else None, "cost": int(after[0][0])}
    conv = g["conv_id"].iloc[0]
    whole["conv_id"] = None if pd.isna(conv) else int(conv)
    rows = [{**whole, "part": int(p), "after": after[k + 1].tolist(), "last": k == len(g) - 1} for k, p in enumerate(g["part"])]
    return _frame(rows, JOINED)


def _exits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per part the state after it for each state before it."""
    powers = Powers()
    for conv, number, part, (after, last) in _parts(batches, ("after", "last")):
        own, end = part.runs(), np.array(after, np.int64)
        exits = [unroll(powers, own, s, end, bool(last))[1] for s in range(4)]
        yield pd.DataFrame({"conv_id": pd.array([conv], "Int64"), "part": [number], "exits": [exits]})


def _entries(group: pd.DataFrame) -> pd.DataFrame:
    """Per part the state before it."""
    g, states = group.sort_values("part"), [0]
    for exits in g["exits"]:
        states.append(int(exits[states[-1]]))
    return g[["conv_id", "part"]].assign(state=states[:-1]).astype({"conv_id": "Int64"})


def _shares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each part's share of the audit and of the repaired text, in blocks."""
    powers = Powers()
    for conv, number, part, (after, last, state) in _parts(batches, ("after", "last", "state")):
        audit, _ = unroll(powers, part.runs(), int(state), np.array(after, np.int64), bool(last))
        block, size, body = 0, 0, []

        def share():
            letters = audit if block == 0 else ""
            return pd.DataFrame({"conv_id": pd.array([conv], "Int64"), "part": [number], "block": [block], "audit": [letters], "body": [utf8("\n".join(body))]})

        for line in repaired(audit, int(state), part.lines()):
            if body and size + len(line) > BLOCK_CHARS:
                yield share()
                block, size, body = block + 1, 0, []
            body.append(line)
            size += len(line)
        yield share()


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Audit and hash of each conversation from its shares, which come in order."""
    conv, audit, digest, any_line = None, None, None, False

    def done():
        return pd.DataFrame({"conv_id": pd.array([conv], "Int64"), "audit": ["".join(audit)], "repaired_sha256": [digest.hexdigest()]})

    for batch in batches:
        for c, letters, body in zip(batch["conv_id"], batch["audit"], batch["body"]):
            c = None if pd.isna(c) else int(c)
            if audit is None or c != conv:
                if audit is not None:
                    yield done()
                conv, audit, digest, any_line = c, [], hashlib.sha256(), False
            audit.append(letters)
            if body:
                digest.update(b"\n" + body if any_line else body)
                any_line = True
    if audit is not None:
        yield done()


def _same(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join by conv_id, null meeting null, and by part where the right side has one; the right side's other columns are added."""
    keys = [k for k in ("conv_id", "part") if k in right.columns]
    r = right.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    met = F.col("conv_id").eqNullSafe(F.col("_conv_id"))
    if "part" in keys:
        met = met & (F.col("part") == F.col("_part"))
    return left.join(r, met, how).drop("_conv_id", "_part")


def repair_turns(rows: DataFrame) -> DataFrame:
    """Faults, cheapest edits and their outcome per conversation of ``rows`` (conv_id, turn, role, text, and
    n, how often the row is there): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256.

    Rows of a conversation are taken by turn (nulls first), then role, then a digest of the text. Rows
    with a null conv_id are one conversation. Roles are not empty, roles and texts not null. No rows, no result.
    """
    ordered = in_order(with_faults(rows))
    parts = cut(ordered.mapInPandas(_settle, PARTS))
    result = ["conv_id", "blank", "duplicate", "truncated", "illegal", "least", "most", "turns", "cost", "audit", "repaired_sha256"]
    settled = parts.where("matrix is null").select(*result)

    # At most two conversations per partition reach its borders: a proven bound for broadcast.
    joined = cut(parts.where("matrix is not null").groupBy("conv_id").applyInPandas(_join, JOINED))
    info = joined.select("conv_id", "part", "after", "last")
    exits = _same(ordered, F.broadcast(info)).mapInPandas(_exits, "conv_id long, part int, exits array<int>")
    entries = cut(exits.groupBy("conv_id").applyInPandas(_entries, "conv_id long, part int, state int"))
    shares = _same(ordered, F.broadcast(_same(info, entries))).mapInPandas(_shares, SHARES)
    in_turn = shares.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block")
    hashed = in_turn.mapInPandas(_hashed, HASHED)
    crossing = _same(joined.drop("part", "after", "last").distinct(), hashed).select(*result)

    gaps = F.when(F.col("turns") > 0, F.col("most") - F.col("least") + 1 - F.col("turns")).otherwise(0)
    return settled.union(crossing).withColumn("gaps", gaps).drop("least", "most", "turns")


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """``repair_turns`` of the damaged table, with a row for every original conv_id: one without rows after the
    damage has zeros, an empty audit and the hash of nothing. Other columns are not read."""
    done = repair_turns(damaged(conversations))
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return _same(every, done, "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
