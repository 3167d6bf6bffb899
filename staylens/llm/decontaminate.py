"""Operator 7: benchmark decontamination with a generalised suffix automaton.

The normalised words of the test items build one suffix automaton (every item restarts
at the root). Document words stream through it; the automaton's state gives the longest
match that ends at each word. Where a match reaches ``window`` words, or a shorter item's
whole length, those words are hit; hit spans are removed when a span or the document's
covered share exceeds its limit.

The items are read in blocks of at most ``max_block_words`` words, one automaton and one
broadcast for each; usually there is one block. With more blocks the hit word ranges and
items of a document are united by a grouping.

Defined results: NULL and empty texts have no words and no hits; items without words are
ignored; items with NULL id count as hits but appear in no id list; repeated items count
once per id; an empty benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens._util import qcol
from staylens.llm.common import annotate, folded_words, free_name, share

WINDOW = 13
MAX_BLOCK_WORDS = 2_000_000


class SuffixAutomaton:
    """Automaton of all items over word ids; per state the items of its windows."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[list[int]] = [[]]  # items with a prefix that ends in the state
        whole: list[tuple[int, int]] = []  # end state and item of items under a window
        self.shortest = window
        self.names = [name for name, _ in items]
        for k, (_, words) in enumerate(items):
            last = 0
            for w in words:
                last = self._add(last, self.ids.setdefault(w, len(self.ids)), ends)
                if self.length[last] >= window:
                    ends[last].append(k)
            if 0 < len(words) < window:
                whole.append((last, k))
                self.shortest = min(self.shortest, len(words))
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True)
        holds: list[set[int]] = [set(e) for e in ends]
        for v in order:  # a state's items also end in its suffix link
            if self.length[self.link[v]] >= window:
                holds[self.link[v]] |= holds[v]
        #: state -> (state whose strings include the last ``window`` words)
        self.full = [0] * len(self.length)
        #: state -> [(item length, item)] of the short items that end its strings
        self.short: list[tuple] = [()] * len(self.length)
        own: dict[int, list[tuple[int, int]]] = {}
        for v, k in whole:
            own.setdefault(v, []).append((len(items[k][1]), k))
        for v in reversed(order):
            up = self.link[v]
            self.full[v] = v if self.length[v] >= window > self.length[up] else self.full[up]
            self.short[v] = (*own.get(v, ()), *self.short[up])
        self.items = [tuple(sorted(h)) if self.length[v] >= window > self.length[self.link[v]]
                      else () for v, h in enumerate(holds)]

    def _state(self, length: int, ends) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        ends.append([])
        return len(self.length) - 1

    def _split(self, p: int, q: int, c: int, ends) -> int:
        clone = self._state(self.length[p] + 1, ends)
        self.next[clone] = dict(self.next[q])
        self.link[clone] = self.link[q]
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _add(self, last: int, c: int, ends) -> int:
        q = self.next[last].get(c)
        if q is not None:  # the string is there already
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, c, ends)
        new = self._state(self.length[last] + 1, ends)
        p = last
        while p != -1 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c, ends)
        return new

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int], int]:
        """Hit word ranges (start, end), numbers of the items found, longest match."""
        get = self.ids.get
        ids = [get(w, -1) for w in words]
        hits: list[tuple[int, int]] = []
        found: set[int] = set()
        longest = 0
        if len(ids) < self.shortest:
            return hits, found, longest
        known = np.fromiter(ids, np.int64, len(ids)) >= 0
        edges = np.flatnonzero(np.diff(np.concatenate(([False], known, [False]))))
        nxt, link, length, window = self.next, self.link, self.length, self.window
        for a, b in edges.reshape(-1, 2).tolist():
            if b - a < self.shortest:  # a run of known words too short for any window
                continue
            v = n = 0
            for i in range(a, b):
                c = ids[i]
                to = nxt[v].get(c)
                if to is None:
                    while v and c not in nxt[v]:
                        v = link[v]
                        n = length[v]
                    to = nxt[v].get(c)
                v, n = to, n + 1
                if n > longest:
                    longest = n
                start = i + 1
                if n >= window:
                    start = i + 1 - window
                    found.update(self.items[self.full[v]])
                for m, k in self.short[v]:
                    if m <= n:
                        found.add(k)
                        start = min(start, i + 1 - m)
                if start <= i:
                    if hits and start <= hits[-1][1]:
                        while hits and start <= hits[-1][1]:
                            start = min(start, hits.pop()[0])
                    hits.append((start, i + 1))
        return hits, found, longest


def _blocks(benchmark: DataFrame, key: str, text: str, max_words: int) -> Iterator[list]:
    """Items (id as string, words) in blocks of bounded size, streamed to the driver."""
    rows = (benchmark.select(qcol(key).cast("string").alias("id"), qcol(text).cast("string").alias("text"))
            .distinct().orderBy("id", "text"))
    block, size = [], 0
    for row in rows.toLocalIterator():
        words = folded_words((row["text"] or "").encode())
        if not words:
            continue
        if block and size + len(words) > max_words:
            yield block
            block, size = [], 0
        block.append((row["id"], words))
        size += len(words)
    if block:
        yield block


_DDL = "n_words bigint, starts array<int>, ends array<int>, items array<string>, longest int"


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id",
            item_text: str = "text", window: int = WINDOW, keep=None,
            max_block_words: int = MAX_BLOCK_WORDS):
    """(table, name): ``keep`` columns and a struct column: words, hit word ranges, items.

    One pass over the documents per block of items. The first block's pass carries the
    columns; further blocks run on the previous pass's rows, so nothing is joined.
    """
    name = free_name("bench_", docs)
    base = list(docs.columns if keep is None else keep)
    out, made = None, []
    for block in _blocks(benchmark, item_key, item_text, max_block_words):
        shared = share(docs.sparkSession, SuffixAutomaton(block, window))  # max_block_words words

        def start(shared=shared):
            machine = shared()

            def work(texts):
                rows = []
                for t in texts:
                    words = folded_words(t)
                    hits, found, longest = machine.match(words)
                    names = sorted({machine.names[k] for k in found} - {None})
                    rows.append((len(words), [a for a, _ in hits], [b for _, b in hits], names, longest))
                return rows
            return work

        col = free_name(f"{name}{len(made)}", docs)
        current = docs if out is None else out
        columns = base + [c for c in made] + ([] if text in base else [text])
        out = annotate(current, text, col, _DDL, start, keep=columns)
        made.append(col)
    if out is None:
        def nothing():
            return lambda texts: [(len(folded_words(t)), [], [], [], 0) for t in texts]
        out = annotate(docs, text, name, _DDL, nothing, keep=base)
        return out, name
    parts = [F.col(f"`{c}`") for c in made]
    if len(made) == 1:
        return out.select(*[qcol(c) for c in base], parts[0].alias(name)), name
    united = F.struct(
        parts[0]["n_words"].alias("n_words"),
        F.concat(*[p["starts"] for p in parts]).alias("starts"),
        F.concat(*[p["ends"] for p in parts]).alias("ends"),
        F.sort_array(F.array_distinct(F.concat(*[p["items"] for p in parts]))).alias("items"),
        F.greatest(*[p["longest"] for p in parts]).alias("longest"))
    return out.select(*[qcol(c) for c in base], united.alias(name)), name


def hit_words(name: str) -> Column:
    """Words inside any hit range (ranges of several blocks may overlap)."""
    c = F.col(f"`{name}`")
    pairs = F.array_sort(F.arrays_zip(c["starts"], c["ends"]))
    return F.aggregate(
        pairs, F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("last")),
        lambda s, p: F.struct(
            (s["n"] + F.greatest(F.lit(0), p["ends"] - F.greatest(p["starts"], s["last"]))).cast("bigint").alias("n"),
            F.greatest(s["last"], p["ends"]).alias("last")),
        lambda s: s["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, max_percent: int = 5, keep=None, **options):
    """(table, name): a struct n_words, n_hit, items, contaminated, ranges per document.

    A document is contaminated when it has a hit and the hit words are ``max_percent``
    percent of its words or more.
    """
    out, name = matches(docs, benchmark, keep=keep, **options)
    c = F.col(f"`{name}`")
    hit = free_name("hit_", docs)
    out = out.withColumn(hit, hit_words(name))
    n = F.col(f"`{hit}`")
    verdict = F.struct(
        c["n_words"].alias("n_words"), n.alias("n_hit"), c["items"].alias("items"),
        ((n > 0) & (100 * n >= max_percent * c["n_words"])).alias("contaminated"),
        c["starts"].alias("starts"), c["ends"].alias("ends"), c["longest"].alias("longest"))
    return out.withColumn(name, verdict).drop(hit), name


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, columns and texts unchanged."""
    out, name = contamination(docs, benchmark, **options)
    return out.where(~F.col(f"`{name}`.contaminated")).select(*[qcol(c) for c in docs.columns])


def cut_spans(text: str, starts: list[int], ends: list[int], max_words: int, max_share: float) -> str:
    """``text`` without hit word ranges over ``max_words``, or without any hit range when
    they cover more than ``max_share`` of its words; the rest is unchanged."""
    import re

    places = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    ranges: list[list[int]] = []
    for a, b in sorted(zip(starts, ends)):
        if ranges and a <= ranges[-1][1]:
            ranges[-1][1] = max(ranges[-1][1], b)
        else:
            ranges.append([a, b])
    share = sum(b - a for a, b in ranges) / max(1, len(places))
    out, at = [], 0
    for a, b in ranges:
        if b - a > max_words or share > max_share:
            out.append(text[at:places[a][0]])
            at = places[b - 1][1]
    return "".join(out) + text[at:]


def remove_spans(docs: DataFrame, benchmark: DataFrame, max_words: int = WINDOW - 1,
                 max_share: float = 0.05, text: str = "text", **options) -> DataFrame:
    """All documents; hit spans over the length or coverage limit are cut from the text."""
    out, name = matches(docs, benchmark, text=text, **options)
    c = F.col(f"`{name}`")

    @F.pandas_udf("string")
    def cut(t: pd.Series, s: pd.Series, e: pd.Series) -> pd.Series:
        return pd.Series([x if x is None or not len(a) else
                          cut_spans(x, list(a), list(b), max_words, max_share)
                          for x, a, b in zip(t, s, e)], dtype=object)

    return out.withColumn(text, cut(qcol(text), c["starts"], c["ends"])).drop(name)

