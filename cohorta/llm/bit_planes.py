"""Token ids as bit-plane files.

The file format is a Parquet table, so that any store Spark writes to can hold it. A row
is a chunk of CHUNK_IDS consecutive ids (the last one of a shard is shorter):

    shard, chunk          place in the order of all ids
    first_id, n_ids       ids of the shard before the chunk, ids in it: the chunk index
    width                 bits (bit planes) or bytes (byte planes) kept of each id
    planes                array of zstandard frames, highest plane first
    doc_ids, doc_starts   documents that begin in the chunk, and where, from its first id
    doc_open              whether the chunk's first id continues an earlier document

A plane holds the same bit (or byte) of every id of the chunk, packed; planes above the
chunk's largest id are left out. Shards follow each other in the order of document ids.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from codecs import charmap_decode
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import chain
from operator import xor

import numpy as np
import pandas as pd
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from cohorta.llm.registry import cut, texts
from cohorta.llm.udf import chunks
from cohorta.llm.words import utf8

CHUNK_IDS = 65_536
END_ID = 2
LEVEL = 3
CHUNK_SCHEMA = (
    "shard int, chunk int, first_id long, n_ids int, width int, planes array<binary>, "
    "doc_ids array<long>, doc_starts array<int>, doc_open boolean"
)
PIECE_SCHEMA = "doc_id long, shard int, chunk int, opens boolean, lasts boolean, at long, n long, crc long"
#: Words whose ids a task remembers.
WORDS_KEPT = 200_000
#: Bytes of text in a shard: a task learns its words anew, so it should not be small.
SHARD_BYTES = 16_000_000
#: Characters of text that are encoded at once.
ENCODED_CHARS = 500_000
#: Rows, about, that reading hands on at once.
PIECES = 20_000
ASCII_PIECES = re.compile(rb"[a-z]+|[0-9]|[^a-z0-9]+")
#: The pre-tokenizer's characters for bytes: printable ones stand for themselves, the others for those from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_OTHERS = [b for b in range(256) if b not in _PRINTABLE]
BYTE_LEVEL = "".join(chr(256 + _OTHERS.index(b)) if b in _OTHERS else chr(b) for b in range(256))
#: The steps of a tokenizer file that words can be encoded one by one with (fixed values, as the file states them).
KNOWN_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
KNOWN_SPLITTING = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: ASCII signs (no apostrophe) between a letter or digit and white space, or the end, are a word of their own.
LAST_SIGNS = re.compile(rb"""[!-&(-/:-@[-`{-~](?:(?<=[a-z0-9].)|(?<=\xc3[\x9f-\xb6\xb8-\xbf].))[!-&(-/:-@[-`{-~]*(?=\s|\Z)""")
#: Lower-case letters of Latin-1 in UTF-8, which normaliser and pre-tokenizer leave as they are.
LATIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
SIGNS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def split_planes(ids: np.ndarray, by_byte: bool = False, level: int = LEVEL) -> tuple[int, list[bytes]]:
    """Width and compressed planes of a chunk of ids below 2**32."""
    ids = np.ascontiguousarray(ids, "<u4")
    top = int(ids.max()) if ids.size else 0
    pack = zstandard.ZstdCompressor(level=level).compress
    if by_byte:
        width = max(1, -(-top.bit_length() // 8))
        return width, [pack((ids >> np.uint32(8 * k)).astype(np.uint8).tobytes()) for k in reversed(range(width))]
    width = max(1, top.bit_length())
    return width, [pack(np.packbits((ids >> np.uint32(k) & np.uint32(1)).astype(np.uint8)).tobytes()) for k in reversed(range(width))]


def join_planes(width: int, planes: list[bytes], n: int, by_byte: bool = False) -> np.ndarray:
    """The n ids of a chunk from its planes, highest first."""
    unpack = zstandard.ZstdDecompressor().decompress
    ids = np.zeros(n, np.uint32)
    for k, plane in zip(reversed(range(width)), planes):
        raw = np.frombuffer(unpack(plane), np.uint8)
        values = raw if by_byte else np.unpackbits(raw, count=n)
        ids |= values.astype(np.uint32) << np.uint32(8 * k if by_byte else k)
    return ids


def pieces(word: bytes) -> list[bytes]:
    """Parts of a word, lower-cased in ASCII, between which the tokenizer splits anyway."""
    if b"'" in word:
        return [word]
    if word.isascii():
        return ASCII_PIECES.findall(word)
    head = word.rstrip(SIGNS)
    last = head.decode("utf-8", "replace")[-1:]
    plain = last.isalpha() and last < "\u0250" and last != "\u0130"  # whose lower case ends in a mark
    return [head, word[len(head) :]] if plain and len(head) < len(word) else [word]


def _spelled(letters: bytes) -> str:
    """Letters in the characters that the model's vocabulary is written in."""
    return charmap_decode(letters, "strict", BYTE_LEVEL)[0]


def reads_words(path: str) -> bool:
    """Whether a tokenizer file has the normaliser and the splitting that ``WordEncoder``'s short way
    is made for; any other file goes the whole way."""
    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    added = [t["content"] for t in made["added_tokens"]]
    return (
        made["normalizer"] == KNOWN_NORMALIZER and made["pre_tokenizer"] == KNOWN_SPLITTING and made["model"]["type"] == "BPE"
        and not made["model"].get("dropout") and all(t[:2] == "<|" for t in added)
    )


class Places(dict):
    """Numbers of words in the order in which they were first looked up."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n

    def __init__(self, words: dict[bytes, int] | None = None):
        super().__init__(words or {})
        self.new: list[bytes] = []


class WordEncoder:
    """Ids of whole texts, encoded word by word.

    The tokenizer's normaliser and pre-tokenizer work on each run of characters other
    than white space by itself (it splits at white space and drops it, and white space
    takes part in no Unicode composition), so a text's ids are those of its words one
    after the other. It also lower-cases, and splits between letters, single digits and
    other signs, so words come down to fewer pieces: ASCII words without an apostrophe
    fall apart at those places, others only before the ASCII signs at their end, where a
    Latin letter stands before them. Each distinct word is encoded once (pieces of letters
    by the model alone, as the steps before it leave them as they are) and remembered; when there are too
    many, those met more than once stay. Texts that may hold a special token are encoded at once, and
    so is every text with ``whole``, or when the file's steps are not those.
    """

    def __init__(self, path: str, whole: bool | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.whole = not reads_words(path) if whole is None else whole
        self.special = tuple({t.content[:2] for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.parts: dict[bytes, list[int]] = {}  # of words that are not letters only
        self.known = Places()
        self.met = np.zeros(0, np.int32)
        self.lengths = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _ids_of_parts(self, words: list[bytes]) -> list[list[int]]:
        """Ids of words that are not letters only, by their pieces."""
        if len(self.parts) > WORDS_KEPT // 8:
            self.parts.clear()
        parts, tokenize, rest = self.parts, self.tokenizer.model.tokenize, []
        split = [pieces(w) for w in words]
        for p in set(chain.from_iterable(split)).difference(parts):
            if LATIN.fullmatch(p):
                parts[p] = [t.id for t in tokenize(_spelled(p))]
            else:
                rest.append(p)
        got = self.tokenizer.encode_batch_fast([p.decode("utf-8", "replace") for p in rest], add_special_tokens=False)
        parts.update(zip(rest, (e.ids for e in got)))
        return [list(chain.from_iterable(map(parts.__getitem__, own))) for own in split]

    def _learn(self, new: list[bytes]) -> None:
        tokenize, letters = self.tokenizer.model.tokenize, LATIN.fullmatch
        ids = [[t.id for t in tokenize(_spelled(w))] if w.isalpha() or letters(w) else None for w in new]
        others = [k for k, own in enumerate(ids) if own is None]
        for k, own in zip(others, self._ids_of_parts([new[k] for k in others])):
            ids[k] = own
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        self.starts = np.concatenate((self.starts, self.pool.size + np.cumsum(lengths) - lengths))
        self.lengths = np.concatenate((self.lengths, lengths))
        self.pool = np.concatenate((self.pool, np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum()))))
        self.met = np.concatenate((self.met, np.zeros(len(new), np.int32)))

    def _forget(self) -> None:
        """Keep the words met more than once since the last time, or none if those are nearly all."""
        stay = np.flatnonzero(self.met > 1)
        stay = stay if stay.size <= WORDS_KEPT // 2 else stay[:0]
        new_place = np.full(self.lengths.size, -1)
        new_place[stay] = np.arange(stay.size)
        self.known = Places({w: n for w, k in self.known.items() if (n := int(new_place[k])) >= 0})
        n = self.lengths[stay]
        ends = np.cumsum(n)
        self.pool = self.pool[np.repeat(self.starts[stay] - (ends - n), n) + np.arange(int(n.sum()))]
        self.lengths, self.starts, self.met = n, ends - n, np.zeros(stay.size, np.int32)

    def __call__(self, values: list[str]) -> list[np.ndarray]:
        odd = [k for k, t in enumerate(values) if self.whole or any(s in t for s in self.special)]
        at_once = self.tokenizer.encode_batch_fast([values[k] for k in odd], add_special_tokens=False) if odd else []
        if len(odd) == len(values):
            return [np.array(e.ids, np.uint32) for e in at_once]
        if odd:
            rest = iter(self([t for k, t in enumerate(values) if k not in set(odd)]))
            got = {k: np.array(e.ids, np.uint32) for k, e in zip(odd, at_once)}
            return [got[k] if k in got else next(rest) for k in range(len(values))]
        words = [LAST_SIGNS.sub(rb" \g<0>", utf8(t).lower()).split() for t in values]
        flat = list(chain.from_iterable(words))
        if len(self.known) > WORDS_KEPT:
            self._forget()
        at = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        if self.known.new:
            self._learn(self.known.new)
            self.known.new = []
        self.met += np.minimum(np.bincount(at, minlength=self.met.size), 2).astype(np.int32)
        n = self.lengths[at]
        ends = np.cumsum(n)
        ids = self.pool[np.repeat(self.starts[at] - (ends - n), n) + np.arange(int(n.sum()))]
        bounds = np.concatenate(([0], ends))[np.cumsum([len(own) for own in words])[:-1]] if values else []
        return np.split(ids, bounds) if values else []


def _write_chunks(kept: Broadcast, path: str, end_id: int, size: int, by_byte: bool, whole: bool):
    """``kept`` is an empty dictionary, of which each Python process has its own: one encoder for all of its
    tasks, so that the file is read and the usual words are learned once."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if "encoder" not in kept.value:
            kept.value["encoder"] = WordEncoder(path, whole)
        encode, shard = kept.value["encoder"], TaskContext.get().partitionId()
        held, docs, chunk, opened = [], [], 0, False

        def flush(ids, docs, opened):
            width, planes = split_planes(ids, by_byte)
            return {
                "shard": shard, "chunk": chunk, "first_id": chunk * size, "n_ids": len(ids), "width": width, "planes": planes,
                "doc_ids": [d for d, _ in docs], "doc_starts": [at for _, at in docs], "doc_open": opened,
            }

        n_held = 0
        for batch in batches:
            names, at = batch["doc_id"].tolist(), 0
            values = ["" if t is None else t for t in batch["text"]]
            for part in chunks(values, ENCODED_CHARS):
                rows = []
                for ids in encode(part):
                    docs.append((None if pd.isna(names[at]) else int(names[at]), n_held))
                    at += 1
                    held += [ids, np.array([end_id], np.uint32)]
                    n_held += len(ids) + 1
                    if n_held >= size:
                        ids = np.concatenate(held)
                        while ids.size >= size:
                            rows.append(flush(ids[:size], [d for d in docs if d[1] < size], opened))
                            docs = [(d, a - size) for d, a in docs if a >= size]
                            ids, chunk = ids[size:], chunk + 1
                            opened = bool(ids.size) and not (docs and docs[0][1] == 0)
                        held, n_held = [ids], ids.size
                if rows:
                    yield pd.DataFrame(rows)
        if n_held:
            yield pd.DataFrame([flush(np.concatenate(held), docs, opened)])

    return write


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, chunk_ids: int = CHUNK_IDS, by_byte: bool = False, whole: bool = False) -> None:
    """Encode every text and write the ids under ``path``, in ascending doc_id order.

    A null text counts as empty and still gets its end id; a null doc_id comes first;
    rows with the same doc_id follow each other in the order of their texts' hashes. An
    empty table writes a table without chunks. Other columns are not read. A shard is as much text
    as one task encodes, whatever the session's number of partitions.
    """
    rows = texts(docs).withColumn("tie", F.xxhash64("text"))
    shards = 1 + (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_BYTES
    # Equal rows may be many: the number spreads them over shards, which changes no ids.
    order = [F.col("doc_id").asc_nulls_first(), "tie", "spread"]
    rows = rows.withColumn("spread", F.rand(11)).repartitionByRange(shards, *order).sortWithinPartitions(*order)
    whole = whole or not reads_words(tokenizer)  # looked up once, not in every task
    kept = docs.sparkSession.sparkContext.broadcast({})
    write = _write_chunks(kept, tokenizer, end_id, chunk_ids, by_byte, whole)
    rows.select("doc_id", "text").mapInPandas(write, CHUNK_SCHEMA).write.parquet(path)
    kept.destroy()


def _through(matrix: list[int], register: int) -> int:
    return reduce(xor, (m for k, m in enumerate(matrix) if register >> k & 1), 0)


@lru_cache(maxsize=64)
def _zero_bits(power: int) -> list[int]:
    """What 2**power zero bits make of the CRC's register, as a matrix over its bits."""
    if not power:
        return [0xEDB88320] + [1 << k for k in range(31)]
    half = _zero_bits(power - 1)
    return [_through(half, m) for m in half]


def crc_join(first: int, second: int, n: int) -> int:
    """CRC-32 of two byte strings end to end, from theirs and the length of the second: the first one's
    register runs through that many zero bytes, then both are added."""
    bits = 8 * n
    for power in range(bits.bit_length()):
        if bits >> power & 1:
            first = _through(_zero_bits(power), first)
    return first ^ second


def _read_pieces(by_byte: bool):
    """Per document and chunk: where its ids begin, their number and checksum. ``opens`` tells whether the piece
    goes on from the chunk before, ``lasts`` whether it reaches the chunk's end."""

    def frame(parts: list[tuple]) -> pd.DataFrame:
        names, shards, places, opens, at, n, crc = zip(*parts)
        sizes = np.array([len(x) for x in names])
        ends = np.cumsum(sizes)
        first, last = np.zeros(ends[-1], bool), np.zeros(ends[-1], bool)
        first[ends - sizes], last[ends - 1] = opens, True
        return pd.DataFrame({
            "doc_id": pd.array([None if d is None or d != d else int(d) for d in chain.from_iterable(names)], "Int64"),
            "shard": np.repeat(shards, sizes), "chunk": np.repeat(places, sizes), "opens": first, "lasts": last,
            "at": np.concatenate(at), "n": np.concatenate(n), "crc": list(chain.from_iterable(crc)),
        })

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts, rows = [], 0
            for c in batch.itertuples(index=False):
                raw = join_planes(c.width, list(c.planes), c.n_ids, by_byte).astype("<u4", copy=False).data
                bounds = [0, *c.doc_starts, c.n_ids] if c.doc_open else [*c.doc_starts, c.n_ids]
                names = [None, *c.doc_ids] if c.doc_open else list(c.doc_ids)
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(bounds, bounds[1:])]
                parts.append((names, c.shard, c.chunk, c.doc_open, c.first_id + np.array(bounds[:-1], np.int64), np.diff(bounds), crc))
                rows += len(names)
                if rows >= PIECES:
                    yield frame(parts)
                    parts, rows = [], 0
            if parts:
                yield frame(parts)

    return read


def _join_crcs(sizes: pd.Series, crcs: pd.Series) -> pd.Series:
    out = []
    for n, c in zip(sizes, crcs):
        total = int(c[0])
        for size, crc in zip(n[1:], c[1:]):
            total = crc_join(total, int(crc), 4 * int(size))
        out.append(total)
    return pd.Series(out)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a file, in no order: a row per chunk."""
    return spark.read.schema(CHUNK_SCHEMA).parquet(path)


def read_documents(spark: SparkSession, path: str, by_byte: bool = False) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it),
    n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers).

    Chunks are read wherever they lie. A document that crosses chunks has a piece in each, whose
    checksums are joined; no ids are shuffled.
    """
    stored = read_chunks(spark, path)
    # One row per shard from here on: as many as the writing job had tasks.
    totals = stored.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    before = F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select("shard", F.coalesce(before, F.lit(0)).alias("before"))
    found = cut(stored.mapInPandas(_read_pieces(by_byte), PIECE_SCHEMA))  # small rows, read twice below
    # Only the first and the last piece of a chunk can belong to a document that crosses its border.
    crossing = found.where("opens or lasts")
    in_shard = Window.partitionBy("shard").orderBy("chunk", "at", "n")
    numbered = crossing.withColumn("doc", F.sum(F.when(F.col("opens"), 0).otherwise(1)).over(in_shard))
    joined = numbered.groupBy("shard", "doc").agg(F.sort_array(F.collect_list(F.struct("at", "n", "crc", "doc_id"))).alias("p"))
    crc = pandas_udf(_join_crcs, "long")(F.transform("p", lambda x: x["n"]), F.transform("p", lambda x: x["crc"]))
    ends = joined.select(F.col("p")[0]["doc_id"].alias("doc_id"), "shard", F.col("p")[0]["at"].alias("at"), F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n"), crc.alias("crc"))
    whole = found.where("not opens and not lasts").select("doc_id", "shard", "at", "n", "crc")
    out = whole.union(ends).join(offsets, "shard")
    return out.select("doc_id", (F.col("before") + F.col("at")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
