"""Operator 9: byte-level BPE encoding and decoding with the tokenizers library.

The rank file's tokens become a tokenizers BPE model over the byte alphabet (each byte
mapped to one printable character); its merges are all splits of a token into two ranked
tokens, in rank order. Each match of the pattern is encoded separately; a task remembers
the ids of matches it has seen (a bounded memory that never changes a result). Decoding
maps ids to byte strings; a character split over several tokens is whole again once
their bytes are joined.

Defined results: NULL and the empty text have no ids; the file's path is a parameter,
read on the driver and broadcast (its size is the vocabulary's).
"""

from __future__ import annotations

import base64
import hashlib
import re
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens.llm.common import annotate, free_name, share

#: Matches and words whose ids a task remembers at most (each).
MEMORY = 250_000

_SPACE_AFTER_SPACE = re.compile(r"\s ").search


def byte_alphabet() -> list[str]:
    """The printable character of each byte: itself where printable, else 256 and up."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


def build_model(ranks: dict[bytes, int]):
    """A tokenizers BPE model that merges as the ranks say."""
    from tokenizers import models

    alphabet = byte_alphabet()

    def shown(token: bytes) -> str:
        return "".join(map(alphabet.__getitem__, token))

    merges = []
    for token, _ in sorted(ranks.items(), key=lambda x: x[1]):
        splits = sorted((ranks[token[:i]], ranks[token[i:]], i) for i in range(1, len(token))
                        if token[:i] in ranks and token[i:] in ranks)
        merges += [(shown(token[:i]), shown(token[i:])) for _, _, i in splits]
    return models.BPE({shown(t): r for t, r in ranks.items()}, merges, ignore_merges=True,
                      cache_capacity=0)


class _Memory(dict):
    """Ids by key; a missing key is worked out and kept."""

    def __init__(self, work):
        super().__init__()
        self.work = work

    def __missing__(self, key):
        ids = self[key] = self.work(key)
        return ids


class Codec:
    """Encodes and decodes texts; one per task."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.model = build_model(ranks)
        self.find = regex.compile(pattern).findall
        self.shown = {b: c for b, c in enumerate(byte_alphabet())}  # for str.translate
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for token, r in ranks.items():
            self.bytes[r] = token
        self.decimal = [str(i) for i in range(len(self.bytes))]
        self.matches = _Memory(self._encode_match)
        self.words = _Memory(lambda word: self._encode_part(" " + word))

    def _encode_match(self, match: str) -> tuple[int, ...]:
        shown = match.encode().decode("latin-1").translate(self.shown)
        return tuple([t.id for t in self.model.tokenize(shown)])

    def _encode_part(self, part: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(self.matches.__getitem__, self.find(part))))

    def encode(self, text: str) -> list[int]:
        """The ids of a text.

        A space that follows no white space always begins a match of the pattern (only
        white space runs reach over a space), so a text without such a pair falls into
        parts at its spaces; any other text is matched as a whole.
        """
        if not text:
            return []
        if _SPACE_AFTER_SPACE(text) or text[0] == " ":
            ids = list(self._encode_part(text))
        else:
            first, *rest = text.split(" ")
            ids = list(self._encode_part(first))
            ids += chain.from_iterable(map(self.words.__getitem__, rest))
        for memory in (self.matches, self.words):
            if len(memory) > MEMORY:
                memory.clear()
        return ids

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def decode(self, ids) -> str:
        """The text; bytes that make no whole character become U+FFFD."""
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def offsets(self, text: str, ids: list[int]) -> list[tuple[int, int]]:
        """Code point range of each id; a token that starts or ends inside a character
        has the whole character in its range."""
        raw = np.frombuffer(text.encode(), np.uint8)
        begins = np.cumsum((raw & 0xC0) != 0x80)  # characters begun up to each byte
        ends = np.cumsum([len(self.bytes[i]) for i in ids], dtype=np.int64)
        if not len(ids):
            return []
        starts = np.concatenate(([0], ends[:-1]))
        return list(zip((begins[starts] - 1).tolist(), begins[ends - 1].tolist()))

    def ids_sha256(self, ids: list[int]) -> str:
        return hashlib.sha256(",".join(map(self.decimal.__getitem__, ids)).encode()).hexdigest()


def _starter(spark: SparkSession, path: str, pattern: str, work):
    ranks = share(spark, read_ranks(path))

    def start():
        codec = Codec(ranks(), pattern)
        return lambda texts: [work(codec, t) for t in texts]
    return start


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", keep=None,
           offsets: bool = False):
    """(table, name): ``keep`` columns and a struct ids (and code point starts, ends)."""
    name = free_name("bpe_", docs)

    def work(codec, t):
        ids = codec.encode(t)
        if not offsets:
            return (ids,)
        places = codec.offsets(t, ids)
        return (ids, [a for a, _ in places], [b for _, b in places])

    ddl = "ids array<int>" + (", starts array<int>, ends array<int>" if offsets else "")
    start = _starter(docs.sparkSession, path, pattern, work)
    return annotate(docs, text, name, ddl, start, keep=keep, binary=False), name


def decode(tokens: DataFrame, path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """``tokens`` with the decoded text of the id array ``ids`` (NULL: the empty text)."""
    ranks = share(tokens.sparkSession, read_ranks(path))

    @F.pandas_udf("string")
    def text_of(column: pd.Series) -> pd.Series:
        table = {r: token for token, r in ranks().items()}
        return column.map(lambda x: "" if x is None else
                          b"".join(table[i] for i in x).decode("utf-8", "replace"))

    return tokens.withColumn(out, text_of(F.col(f"`{ids}`")))


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", keep=None,
               with_ids: bool = False):
    """(table, name): ids' number and digest, and the digest of the decoded bytes."""
    name = free_name("bpe_", docs)

    def work(codec, t):
        ids = codec.encode(t)
        row = (len(ids), codec.ids_sha256(ids), hashlib.sha256(codec.decode_bytes(ids)).hexdigest())
        return (*row, ids) if with_ids else row

    ddl = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    start = _starter(docs.sparkSession, path, pattern, work)
    return annotate(docs, text, name, ddl, start, keep=keep, binary=False), name
