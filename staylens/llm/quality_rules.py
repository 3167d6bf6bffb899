"""Operator 1: quality rules as a learned decision list.

``text_statistics`` measures every whole text. ``learn`` grows and prunes threshold
conjunctions by sequential covering (FOIL gain to grow, a held-out third to prune) from
labelled statistics; ``DecisionList.column`` emits the ordered Spark conditional.

Labels fit on at most ``max_labelled`` labelled documents, chosen by a hash of doc_id
(the documented bound of the fit); the rules apply to every document.

Defined results: a NULL or empty text has no words (the base rule rejects it); NULL
labels and ids with contradictory labels are not learned from; without labels, or
with one class only, the list is empty and everything passes that the base passes.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens._util import qcol
from staylens.llm.common import annotate, free_name

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_LABELLED = 20_000

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = ("mean_word", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "unique_ratio",
          "top_word_ratio", "upper_ratio", "digit_ratio", "exclaim_ratio", "pipe_ratio",
          "end_ratio", "words_per_line")
FEATURES = ("n_words", *RATIOS)
STATS_DDL = ", ".join([f"{n} bigint" for n in BASE] + [f"{n} double" for n in RATIOS])

_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"


def repeated_words(words: list) -> int:
    """Words inside 3-word windows that the text has twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    covered = bytearray(len(words))
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered[i] = covered[i + 1] = covered[i + 2] = 1
    return sum(covered)


def statistics_of(text: bytes) -> tuple:
    """The values of ``STATS_DDL`` for one text (words split at ASCII white space)."""
    words = text.split()
    n = len(words)
    if not n:
        return (0, 0, 0, 0, 0, *[0.0] * len(RATIOS))
    joined = b"".join(words)
    chars = len(joined.decode("utf-8", "replace"))
    symbols = len(text) - len(text.translate(None, _SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    counts = Counter(words)
    return (
        n, chars, symbols, dup, repeat,
        chars / n, symbols / chars, dup / len(lines), repeat / n, len(counts) / n,
        max(counts.values()) / n,
        (len(joined) - len(joined.translate(None, _UPPER))) / chars,
        (len(joined) - len(joined.translate(None, _DIGITS))) / chars,
        joined.count(b"!") / n, joined.count(b"|") / n,
        sum(1 for w in words if w[-1] in b".!?") / n, n / len(lines),
    )


def text_statistics(df: DataFrame, text: str = "text", out: str = "stats",
                    keep=None) -> DataFrame:
    """Adds a struct ``out`` with the statistics of every whole text."""
    return annotate(df, text, out, STATS_DDL, lambda: lambda ts: [statistics_of(t) for t in ts],
                    keep=keep)


@dataclass
class Rule:
    """A conjunction of (feature, '<=' or '>', threshold) and its verdict."""

    conditions: list[tuple[str, str, float]]
    keep: bool
    covered: int = 0
    right: int = 0

    def column(self, stats: str) -> Column:
        out = F.lit(True)
        for name, op, x in self.conditions:
            value = F.col(f"`{stats}`.{name}").cast("double")
            out = out & ((value <= F.lit(x)) if op == "<=" else (value > F.lit(x)))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {o} {x:.6g}" for n, o, x in self.conditions)


@dataclass
class DecisionList:
    rules: list[Rule] = field(default_factory=list)
    default: bool = True

    def column(self, stats: str) -> Column:
        """Ordered conditional: the verdict of the first rule that holds."""
        if not self.rules:
            return F.lit(self.default)
        first, *rest = self.rules
        out = F.when(first.column(stats), F.lit(first.keep))
        for r in rest:
            out = out.when(r.column(stats), F.lit(r.keep))
        return out.otherwise(F.lit(self.default))

    def number(self, stats: str) -> Column:
        """1, 2, ... for the first rule that holds; 0 for the default."""
        out = None
        for i, r in enumerate(self.rules, 1):
            out = (F if out is None else out).when(r.column(stats), F.lit(i))
        return F.lit(0) if out is None else out.otherwise(F.lit(0))


def _holds(x: np.ndarray, conditions) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, op, t in conditions:
        out &= (x[:, j] <= t) if op == "<=" else (x[:, j] > t)
    return out


def _best_condition(x: np.ndarray, bad: np.ndarray):
    """The threshold test with the highest FOIL gain over these rows, or None."""
    p0, n = bad.sum(), len(bad)
    base = np.log2(p0 / n)
    best, found = 1e-9, None
    for j in range(x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        v, y = x[order, j], bad[order]
        cut = np.flatnonzero(v[1:] > v[:-1])
        if not len(cut):
            continue
        p_low = np.cumsum(y)[cut]
        n_low = cut + 1
        for op, p, m in (("<=", p_low, n_low), (">", p0 - p_low, n - n_low)):
            gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / m) - base), -1.0)
            k = int(gain.argmax())
            if gain[k] > best:
                best, found = gain[k], (j, op, float((v[cut[k]] + v[cut[k] + 1]) / 2))
    return found


def learn(x: np.ndarray, bad: np.ndarray, names=FEATURES, min_precision: float = 0.97,
          min_covered: int = 5, max_rules: int = 24, max_conditions: int = 4) -> DecisionList:
    """Sequential covering of the rows that ``bad`` marks; the default keeps."""
    out = DecisionList()
    part = np.arange(len(x)) % 3 == 2  # rows come in hash order
    rest = np.ones(len(x), bool)
    while len(out.rules) < max_rules:
        grow, prune = rest & ~part, rest & part
        if not bad[grow].any() or bad[grow].all() and bad[prune].all() and not out.rules:
            break
        conditions: list[tuple] = []
        inside = grow.copy()
        while len(conditions) < max_conditions and bad[inside].any() and not bad[inside].all():
            c = _best_condition(x[inside], bad[inside])
            if c is None:
                break
            conditions.append(c)
            inside &= _holds(x, [c])
        if not conditions:
            break

        def worth(cs):
            h = _holds(x, cs) & prune
            p, n = int((h & bad).sum()), int((h & ~bad).sum())
            return (p - n) / (p + n) if p + n else -1.0

        scores = [worth(conditions[:k]) for k in range(1, len(conditions) + 1)]
        conditions = conditions[: 1 + int(np.argmax(scores))]
        hit = _holds(x, conditions) & rest
        covered, right = int(hit.sum()), int((hit & bad).sum())
        if covered < min_covered or right < min_precision * covered:
            break
        out.rules.append(Rule([(names[j], op, t) for j, op, t in conditions], False,
                              covered, right))
        rest &= ~hit
    return out


def fails_base(stats: str) -> Column:
    n, r = F.col(f"`{stats}`.n_words"), F.col(f"`{stats}`.n_repeat_words")
    return (n < MIN_WORDS) | (100 * r > MAX_REPEAT_PERCENT * n)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text",
        key: str = "doc_id", max_labelled: int = MAX_LABELLED) -> DecisionList:
    """Learns from documents that pass the base rule; ``label`` 0 marks a bad one."""
    known = (
        labels.where(qcol(label).isNotNull() & qcol(key).isNotNull())
        .groupBy(qcol(key).alias("id"))
        .agg(F.min(qcol(label)).alias("label"), F.max(qcol(label)).alias("high"))
        .where("label = high").select("id", "label")
    )
    present = docs.select(qcol(key).alias("id")).distinct()
    chosen = (known.join(present, "id", "left_semi")
              .orderBy(F.xxhash64("id"), "id").limit(max_labelled))
    texts = docs.select(qcol(key).alias("id"), qcol(text).alias("text"))
    # the side is bounded by max_labelled rows of two numbers
    labelled = texts.join(F.broadcast(chosen), "id")
    rows = text_statistics(labelled, "text", "stats", keep=["id", "label"])
    rows = (rows.where(~fails_base("stats"))
            .select("id", "label", *[F.col(f"stats.{n}").cast("double").alias(n) for n in FEATURES])
            .orderBy(F.xxhash64("id"), "id", *FEATURES).limit(max_labelled))
    data = rows.toArrow()
    if not data.num_rows:
        return DecisionList()
    return learn(np.stack([data[n].to_numpy() for n in FEATURES], axis=1), data["label"].to_numpy() == 0)


def judge(docs: DataFrame, rules: DecisionList, text: str = "text", keep=None):
    """(table, name): ``keep`` columns and a struct of statistics, base_failed, rule, kept."""
    stats = free_name("quality_", docs)
    out = text_statistics(docs, text, stats, keep=keep)
    base = fails_base(stats)
    verdict = F.struct(
        F.col(f"`{stats}`.*"), base.alias("base_failed"),
        F.when(base, F.lit(-1)).otherwise(rules.number(stats)).alias("rule"),
        F.when(base, F.lit(False)).otherwise(rules.column(stats)).alias("kept"))
    return out.withColumn(stats, verdict), stats


def keep_good(docs: DataFrame, rules: DecisionList, text: str = "text") -> DataFrame:
    """The documents that the base rule and the list keep, columns unchanged."""
    judged, stats = judge(docs, rules, text)
    return judged.where(F.col(f"`{stats}`.kept")).select(*[qcol(c) for c in docs.columns])
