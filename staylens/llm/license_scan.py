"""Operator 2: license scan by patience alignment.

Words unique to both a stretch of text and a template are anchors; the longest increasing
subsequence of their places keeps the anchors that agree in order, and the gaps between
them are aligned in the same way. Equal words at a gap's ends are matched first; a gap
without anchors is aligned by its longest common subsequence. Coverage is the share of the
template's words that are aligned.

A text is searched in windows of twice the template's length, half a template apart, so
every copy of a template lies whole in some window, copies side by side included. A
window is aligned when enough words of the template occur in it: fewer cannot reach the
least coverage. Of overlapping finds the one with more aligned words stays.

Defined results: NULL and empty texts have no find; equal finds go to the template listed
first; spans are code points, end exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame

from staylens.llm.common import annotate, folded_words, free_name

MIN_COVERAGE = 0.9

# Short notices by which texts name their license.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted "
                    "provided that the following conditions are met",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
           "hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "mit": "Released under the MIT License",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
                "associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "reserved": "All rights reserved",
}

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence (pairs come by first place) whose second places grow."""
    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        n = bisect_left(tails, j)
        tails[n:n + 1] = [j]
        at[n:n + 1] = [k]
        back[k] = at[n - 1] if n else -1
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def _common(a: list, b: list, i0: int, i1: int, j0: int, j1: int) -> list[tuple[int, int]]:
    """Longest common subsequence of two short stretches, as place pairs."""
    n, m = i1 - i0, j1 - j0
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i0 + i] == b[j0 + j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i0 + i] == b[j0 + j]:
            out.append((i0 + i, j0 + j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def align(a: list, b: list, i0: int = 0, i1: int | None = None, j0: int = 0, j1: int | None = None):
    """Place pairs of the words of ``a`` and ``b`` that patience alignment matches."""
    i1 = len(a) if i1 is None else i1
    j1 = len(b) if j1 is None else j1
    head, tail = [], []
    while i0 < i1 and j0 < j1 and a[i0] == b[j0]:
        head.append((i0, j0))
        i0, j0 = i0 + 1, j0 + 1
    while i0 < i1 and j0 < j1 and a[i1 - 1] == b[j1 - 1]:
        i1, j1 = i1 - 1, j1 - 1
        tail.append((i1, j1))
    tail.reverse()
    if i0 == i1 or j0 == j1:
        return head + tail
    places: dict = {}
    for i in range(i0, i1):
        places[a[i]] = -1 if a[i] in places else i
    seen: dict = {}
    for j in range(j0, j1):
        seen[b[j]] = -1 if b[j] in seen else j
    unique = sorted((places[w], j) for w, j in seen.items() if j >= 0 and places.get(w, -1) >= 0)
    anchors = _increasing(unique)
    if not anchors:
        return head + _common(a, b, i0, i1, j0, j1) + tail
    out = head
    for i, j in [*anchors, (i1, j1)]:
        out += align(a, b, i0, i, j0, j)
        if i < i1:
            out.append((i, j))
        i0, j0 = i + 1, j + 1
    return out + tail


class Scanner:
    def __init__(self, templates: dict[str, str] = TEMPLATES, min_coverage: float = MIN_COVERAGE):
        self.templates = []
        for name, text in templates.items():
            words = folded_words(text.encode())
            least = int(np.ceil(min_coverage * len(words)))
            self.templates.append((name, words, frozenset(words), least, len(words) - least))

    def find(self, words: list[bytes]) -> list[tuple[str, float, int, int, int]]:
        """(license, coverage, first word, end word, aligned words), by place."""
        found = []
        present = set(words)
        for order, (name, template, distinct, least, spare) in enumerate(self.templates):
            if len(distinct - present) > spare:  # each missing word is one not aligned
                continue
            size, step = 2 * len(template), max(1, len(template) // 2)
            known = np.concatenate(([0], np.cumsum([w in distinct for w in words])))
            for lo in range(0, max(1, len(words) - size + step), step):
                hi = min(len(words), lo + size)
                if known[hi] - known[lo] < least:
                    continue
                pairs = align(words[lo:hi], template)
                if len(pairs) >= least:
                    found.append((-len(pairs), pairs[-1][0] - pairs[0][0], order, lo + pairs[0][0],
                                  lo + pairs[-1][0] + 1, name, len(pairs) / len(template)))
        out, taken = [], []
        for n, _, _, a, b, name, coverage in sorted(found):
            if all(b <= x or a >= y for x, y in taken):
                taken.append((a, b))
                out.append((name, coverage, a, b, -n))
        return sorted(out, key=lambda x: x[2])


_DDL = ("n_licenses bigint, licenses string, best string, coverage double, finds array<struct<license:string,"
        "coverage:double,start:int,end:int>>")


def scan(docs: DataFrame, text: str = "text", templates: dict[str, str] = TEMPLATES,
         min_coverage: float = MIN_COVERAGE, keep=None):
    """(table, name): ``keep`` columns and a struct with each text's license finds."""
    name = free_name("license_", docs)

    def start():
        scanner = Scanner(templates, min_coverage)

        def work(t: bytes):
            finds = scanner.find(folded_words(t))
            if not finds:
                return 0, "", None, 0.0, []
            places = [m.span() for m in _WORD.finditer(t.decode())]
            spans = [{"license": n, "coverage": c, "start": places[a][0], "end": places[b - 1][1]}
                     for n, c, a, b, _ in finds]
            best = max(finds, key=lambda f: (f[1], f[4], -f[2]))
            return len(finds), ",".join(sorted({f[0] for f in finds})), best[0], best[1], spans
        return lambda texts: [work(t) for t in texts]

    return annotate(docs, text, name, _DDL, start, keep=keep), name
