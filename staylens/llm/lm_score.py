"""Operator 8: language-model scoring by cross-entropy difference.

Two bigram models of words, a target model (documents labelled good) and a background
model (all documents), share their words and bigrams and are smoothed in the same way, so
their per-token losses can be compared: a document's score is its mean target loss minus
its mean background loss (lower is closer to the target).

The models hold every counted word and bigram, in tables that grow with the input
(``StoredModels``): bigrams are counted in each task and summed by Spark, word counts are
sums of bigram counts, and each bigram row carries both losses. A document's bigrams are
looked up by a join and summed by document. Two bounded lists only save work: words that
are frequent in a sample get short keys, and the losses of the ``CACHED`` most frequent
bigrams are broadcast, so that only the others travel. Neither changes a result.

The target is every document whose labels are all ``value``; there is no bound on it.

Only on request (``vocabulary`` and ``bigrams`` given) the models are cut to those sizes
and held by each task (``BigramModels``): other words are one unknown word, other bigrams
back off to words.

Defined results: a text without words has losses and score 0; equal counts keep the smaller
word; without labelled documents the target model knows word frequencies 1. One unknown
word of count 0 belongs to the vocabulary; scored bigrams that were never counted back off.
Words without a short key are told apart by 63 hash bits.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens._util import qcol
from staylens.llm.common import annotate, folded_words, free_name, share, stored
from staylens.llm.importance import labelled_ids
from staylens.llm.minhash import mix

#: Words with short keys, and one text in so many that is read to find them.
SHORT_KEYS = 65_536
SAMPLE = 16
#: Bigrams whose losses are broadcast; the others are joined.
CACHED = 1_000_000
#: The key before a text's first word.
START = 0
#: Strength of the back-off to word frequencies, in occurrences.
STRENGTH = 10.0
#: Distinct words or pairs that a task counts before it passes them on.
HELD = 400_000


@dataclass
class BigramModels:
    """Both models: word and context losses by word id, kept bigrams by code."""

    words: dict[bytes, int]
    word_counts: np.ndarray  # (2, words + 1): target, background; the last is the unknown word
    codes: np.ndarray  # sorted first * (words + 1) + second
    code_counts: np.ndarray  # (2, bigrams)

    def __post_init__(self):
        size = len(self.words) + 1
        total = self.word_counts.sum(axis=1, keepdims=True)
        self.p = (self.word_counts + 1.0) / (total + size)
        held = np.zeros((2, size))
        first = self.codes // size
        for m in (0, 1):
            held[m] = np.bincount(first, weights=self.code_counts[m], minlength=size)
        self.held = held + STRENGTH

    def ids(self, words: list[bytes]) -> np.ndarray:
        unknown = len(self.words)
        get = self.words.get
        return np.fromiter((get(w, unknown) for w in words), np.int64, len(words))

    def losses(self, words: list[bytes]) -> tuple[float, float]:
        """Mean loss per word of the target and of the background model, in nats."""
        if not words:
            return 0.0, 0.0
        v = self.ids(words)
        size = len(self.words) + 1
        code = v[:-1] * size + v[1:]
        at = np.searchsorted(self.codes, code)
        at[at == len(self.codes)] = 0
        known = self.codes[at] == code if len(self.codes) else np.zeros(len(code), bool)
        out = []
        for m in (0, 1):
            c = np.where(known, self.code_counts[m][at], 0) if len(self.codes) else np.zeros(len(code))
            p = (c + STRENGTH * self.p[m][v[1:]]) / self.held[m][v[:-1]]
            out.append(float(-(np.log(self.p[m][v[0]]) + np.log(p).sum()) / len(v)))
        return out[0], out[1]


def _marked(docs: DataFrame, target: DataFrame, key: str, text: str) -> DataFrame:
    good = target.select(F.col("id").alias("id_"), F.lit(1).alias("good"))
    return docs.select(qcol(key).alias("id_"), qcol(text).cast("string").alias("text")).join(
        good, "id_", "left").select("text", F.coalesce("good", F.lit(0)).alias("good"))


def _texts(batch):
    for t, g in zip(batch.column(0).cast(pa.binary()), batch.column(1).to_pylist()):
        value = t.as_py()
        if value:
            yield folded_words(value), g


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, good, every) over all texts."""

    def run(batches):
        good, every = Counter(), Counter()

        def flush():
            words = list(every)
            out = pa.RecordBatch.from_arrays(
                [pa.array(words, pa.binary()), pa.array([good[w] for w in words], pa.int64()),
                 pa.array(list(every.values()), pa.int64())], names=["word", "good", "every"])
            good.clear()
            every.clear()
            return out

        for batch in batches:
            for words, g in _texts(batch):
                every.update(words)
                if g:
                    good.update(words)
                if len(every) > HELD:
                    yield flush()
        yield flush()

    return (rows.mapInArrow(run, "word binary, good bigint, every bigint")
            .groupBy("word").agg(F.sum("good").alias("good"), F.sum("every").alias("every")))


def bigram_counts(rows: DataFrame, ids: dict[bytes, int]) -> DataFrame:
    """(code, good, every) of all neighbouring pairs of word ids."""
    size = len(ids) + 1
    shared = share(rows.sparkSession, ids)  # bounded by vocabulary

    def run(batches):
        get = shared().get
        unknown = size - 1
        codes, goods, held = [], [], 0

        def flush():
            code = np.concatenate(codes) if codes else np.zeros(0, np.int64)
            good = np.concatenate(goods) if goods else np.zeros(0, np.int64)
            distinct, back = np.unique(code, return_inverse=True)
            out = pa.RecordBatch.from_arrays(
                [pa.array(distinct), pa.array(np.bincount(back, good, len(distinct)).astype(np.int64)),
                 pa.array(np.bincount(back, minlength=len(distinct)).astype(np.int64))], names=["code", "good", "every"])
            codes.clear()
            goods.clear()
            return out

        for batch in batches:
            for words, g in _texts(batch):
                v = np.fromiter((get(w, unknown) for w in words), np.int64, len(words))
                codes.append(v[:-1] * size + v[1:])
                goods.append(np.full(len(codes[-1]), g, np.int64))
                held += len(codes[-1])
                if held > 10 * HELD:
                    yield flush()
                    held = 0
        yield flush()

    return (rows.mapInArrow(run, "code bigint, good bigint, every bigint")
            .groupBy("code").agg(F.sum("good").alias("good"), F.sum("every").alias("every")))


def least_count(counts: DataFrame, most: int) -> int:
    """The smallest count c for which at most ``most`` rows have ``every >= c``."""
    sizes = (counts.groupBy(F.least("every", F.lit(1_000_000)).alias("every")).count()
             .orderBy(F.desc("every")).toLocalIterator())
    total, least = 0, None
    for row in sizes:  # a row for each distinct count
        total += row["count"]
        if total > most:
            break
        least = row["every"]
    return 1_000_001 if least is None else least


class WordKeys(dict):
    """Word to key: the short keys given, else 63 hash bits and the sign."""

    def __init__(self, short: dict[bytes, int]):
        super().__init__(short)
        self.short = short

    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = self[word] = -1 - (xxhash.xxh3_64_intdigest(word) >> 1)
        return value

    def pairs(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Keys of every word and of the word before it."""
        if len(self) > len(self.short) + HELD:
            self.clear()
            self.update(self.short)
        second = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return np.concatenate(([START], second[:-1])), second


def pair_codes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(mix(first.view(np.uint64)) ^ second.view(np.uint64))


def grouped(first: np.ndarray, second: np.ndarray, *weights: np.ndarray) -> list[np.ndarray]:
    """Pairs and the sums of their weights (a pair may come twice if codes collide)."""
    if not len(first):
        return [first, second, *weights]
    order = np.argsort(pair_codes(first, second))
    first, second = first[order], second[order]
    at = np.flatnonzero(np.concatenate(([True], (first[1:] != first[:-1]) | (second[1:] != second[:-1]))))
    return [first[at], second[at], *(np.add.reduceat(w[order], at) for w in weights)]


@dataclass
class StoredModels:
    """Both models as tables: ``losses`` (first, second, every, target, background) of each
    bigram, ``words`` (key, a, b, held_a, held_b): back-off and context weights of each word."""

    short: dict[bytes, int]  # at most SHORT_KEYS
    losses: DataFrame
    words: DataFrame
    unknown: tuple[float, float]  # back-off weights of a word never counted
    cached: tuple[np.ndarray, ...]  # codes, first, second, target, background; at most CACHED


def short_keys(docs: DataFrame, text: str) -> dict[bytes, int]:
    body = qcol(text).cast("string")
    sample = docs.where(F.pmod(F.xxhash64(body), F.lit(SAMPLE)) == 0).select(body.alias("text"), F.lit(0).alias("good"))
    counts = stored(word_counts(sample).select("word", "every"), "sample")
    least = least_count(counts, SHORT_KEYS)
    return {w: i for i, w in enumerate(sorted(counts.where(F.col("every") >= least).toArrow()["word"].to_pylist()), 1)}


def pair_counts(rows: DataFrame, short: dict[bytes, int]) -> DataFrame:
    """(first, second, good, every) of all words and the words before them."""
    shared = share(rows.sparkSession, short)  # bounded by SHORT_KEYS

    def run(batches):
        keys = WordKeys(shared())
        parts, held = [], 0

        def flush():
            a, b, g = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 3
            out = grouped(a, b, g, np.ones(len(a), np.int64))
            parts.clear()
            return pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["first", "second", "good", "every"])

        for batch in batches:
            for words, g in _texts(batch):
                if words:
                    a, b = keys.pairs(words)
                    parts.append((a, b, np.full(len(a), g, np.int64)))
                    held += len(a)
                if held > 10 * HELD:
                    yield flush()
                    held = 0
        yield flush()

    return (rows.mapInArrow(run, "first bigint, second bigint, good bigint, every bigint")
            .groupBy("first", "second").agg(F.sum("good").alias("good"), F.sum("every").alias("every")))


def _with_words(rows: DataFrame, words: DataFrame, key: str, names: dict[str, str]) -> DataFrame:
    """``rows`` with columns of ``words``, NULL if the word was never counted."""
    side = words.select(F.col("key").alias(key), *[F.col(c).alias(n) for c, n in names.items()])
    # short keys: at most SHORT_KEYS rows
    return (rows.where(F.col(key) >= 0).join(F.broadcast(side.where(F.col(key) >= 0)), key, "left")
            .unionByName(rows.where(F.col(key) < 0).join(side.where(F.col(key) < 0), key, "left")))


def _loss(count, back, held):
    p = count + F.lit(STRENGTH) * F.col(back)
    # the first word of a text has its frequency alone
    return -F.log(F.when(F.col("first") == START, F.col(back)).otherwise(
        p / (F.coalesce(F.col(held), F.lit(0)) + F.lit(STRENGTH))))


def fit_whole(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, value: int) -> StoredModels:
    target = stored(labelled_ids(docs, labels, label, value, key, None), "target")
    short = short_keys(docs, text)
    pairs = stored(pair_counts(_marked(docs, target, key, text), short), "pairs")
    held = (pairs.where(F.col("first") != START).groupBy(F.col("first").alias("key"))
            .agg(F.sum("good").alias("held_a"), F.sum("every").alias("held_b")))
    counts = stored(pairs.groupBy(F.col("second").alias("key"))
                    .agg(F.sum("good").alias("good"), F.sum("every").alias("every")).join(held, "key", "left"), "words")
    size, good, every = counts.agg(F.count("*"), F.sum("good"), F.sum("every")).first()
    total = [(good or 0) + size + 1.0, (every or 0) + size + 1.0]
    words = counts.select("key", ((F.col("good") + 1) / F.lit(total[0])).alias("a"),
                          ((F.col("every") + 1) / F.lit(total[1])).alias("b"), "held_a", "held_b")
    rows = _with_words(pairs, words, "second", {"a": "a", "b": "b"})
    rows = _with_words(rows, words, "first", {"held_a": "held_a", "held_b": "held_b"})
    losses = stored(rows.select("first", "second", "every", _loss(F.col("good"), "a", "held_a").alias("target"),
                                _loss(F.col("every"), "b", "held_b").alias("background")), "losses")
    top = losses.where(F.col("every") >= least_count(losses, CACHED)).drop("every").toArrow()
    first, second, a, b = (top[c].to_numpy() for c in ("first", "second", "target", "background"))
    codes = pair_codes(first, second)
    order = np.argsort(codes)
    return StoredModels(short, losses, words, (1 / total[0], 1 / total[1]),
                        tuple(x[order] for x in (codes, first, second, a, b)))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
        value: int = 1, vocabulary: int | None = None, bigrams: int | None = None) -> StoredModels | BigramModels:
    """The whole models, or models of at most ``vocabulary`` words and ``bigrams`` bigrams."""
    if vocabulary is None and bigrams is None:
        return fit_whole(docs, labels, key, text, label, value)
    if vocabulary is None or bigrams is None:
        raise ValueError("vocabulary and bigrams are given together or not at all")
    target = stored(labelled_ids(docs, labels, label, value, key, None), "target")
    rows = _marked(docs, target, key, text)
    words = stored(word_counts(rows), "words")
    top = words.orderBy(F.desc("every"), "word").limit(vocabulary).toArrow()
    totals = words.agg(F.sum("good"), F.sum("every")).first()
    ids = {w: i for i, w in enumerate(top["word"].to_pylist())}
    counts = np.zeros((2, len(ids) + 1))
    counts[0, :-1], counts[1, :-1] = top["good"].to_numpy(), top["every"].to_numpy()
    counts[:, -1] = np.array([totals[0] or 0, totals[1] or 0], float) - counts[:, :-1].sum(axis=1)
    pairs = stored(bigram_counts(rows, ids), "bigrams")
    least = least_count(pairs, bigrams)
    kept = pairs.where(F.col("every") >= least).toArrow()  # columns, not a row object for each bigram
    codes = kept["code"].to_numpy()
    order = np.argsort(codes)
    return BigramModels(ids, counts, codes[order],
                        np.stack([kept["good"].to_numpy()[order], kept["every"].to_numpy()[order]]).astype(float))


def score_whole(docs: DataFrame, models: StoredModels, text: str = "text", keep=None):
    name, row = free_name("lm_", docs), free_name("row_", docs)
    names = list(docs.columns if keep is None else keep)
    shared = share(docs.sparkSession, (models.short, models.cached))  # bounded by SHORT_KEYS and CACHED

    def start():
        short, (codes, first, second, target, background) = shared()
        keys = WordKeys(short)

        def work(texts):
            out = []
            for t in texts:
                words = folded_words(t)
                if not words:
                    out.append((0, 0.0, 0.0, [], [], []))
                    continue
                a, b = keys.pairs(words)
                if len(codes):
                    at = np.searchsorted(codes, pair_codes(a, b))
                    at[at == len(codes)] = 0
                    known = (first[at] == a) & (second[at] == b)
                    at, a, b = at[known], a[~known], b[~known]
                    sums = float(target[at].sum()), float(background[at].sum())
                else:
                    sums = 0.0, 0.0
                out.append((len(words), *sums, *grouped(a, b, np.ones(len(a), np.int64))))
            return out
        return work

    ddl = "n_words bigint, a double, b double, first array<bigint>, second array<bigint>, n array<bigint>"
    parts = stored(annotate(docs.withColumn(row, F.monotonically_increasing_id()), text, name, ddl, start,
                            keep=[*names, row]), "parts")
    c = F.col(f"`{name}`")
    rest = parts.select(qcol(row).alias("row"), F.explode(F.arrays_zip(
        c["first"].alias("first"), c["second"].alias("second"), c["n"].alias("n"))).alias("z")).select("row", "z.*")
    found = rest.join(models.losses.drop("every"), ["first", "second"], "left")
    n = F.col("n")
    sums = stored(found.groupBy("row").agg(
        F.sum(n * F.col("target")).alias("a"), F.sum(n * F.col("background")).alias("b"),
        F.collect_list(F.when(F.col("target").isNull(), F.struct("first", "second", "n"))).alias("unseen")), "sums")
    unseen = sums.select("row", F.explode("unseen").alias("z")).select("row", "z.*")
    unseen = _with_words(unseen, models.words, "second", {"a": "a", "b": "b"})
    unseen = _with_words(unseen, models.words, "first", {"held_a": "held_a", "held_b": "held_b"})
    unseen = unseen.withColumns({x: F.coalesce(x, F.lit(u)) for x, u in zip("ab", models.unknown)})
    more = unseen.select("row", (n * _loss(F.lit(0), "a", "held_a")).alias("a"), (n * _loss(F.lit(0), "b", "held_b")).alias("b"))
    each = sums.select("row", "a", "b").unionByName(more).groupBy(F.col("row").alias(f"{row}_")).agg(
        F.sum("a").alias(f"{row}a"), F.sum("b").alias(f"{row}b"))
    joined = parts.join(each, qcol(row) == F.col(f"{row}_"), "left")
    words = F.greatest(c["n_words"], F.lit(1))
    a, b = ((c[x] + F.coalesce(F.col(f"{row}{x}"), F.lit(0.0))) / words for x in "ab")
    return joined.select(*[qcol(x) for x in names], F.struct(
        c["n_words"].alias("n_words"), a.alias("target_loss"), b.alias("background_loss"),
        (a - b).alias("difference")).alias(name)), name


def score(docs: DataFrame, models: BigramModels, text: str = "text", keep=None):
    """(table, name): ``keep`` columns and a struct n_words, target and background loss,
    and their difference, of every whole text."""
    if isinstance(models, StoredModels):
        return score_whole(docs, models, text, keep)
    name = free_name("lm_", docs)
    shared = share(docs.sparkSession, models)  # bounded by vocabulary and bigrams

    def start():
        losses = shared().losses

        def work(texts):
            out = []
            for t in texts:
                words = folded_words(t)
                a, b = losses(words)
                out.append((len(words), a, b, a - b))
            return out
        return work

    ddl = "n_words bigint, target_loss double, background_loss double, difference double"
    return annotate(docs, text, name, ddl, start, keep=keep), name
