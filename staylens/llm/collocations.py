"""Operator 12: phrase collocations, counted by a multikey quicksort of suffix pointers.

1. A text (A-Z lower-cased) is split into pieces, pieces into words; every word begins a
   suffix that reaches at most ``depth`` words and never beyond its piece.
2. Chunks of texts pass on their distinct suffixes with counts (pre-aggregation), one row
   for each bucket of leading words; buckets follow the number of words, so each holds about
   ``BUCKET`` suffixes whatever the size of the input.
3. Suffixes are routed by language and leading word. Leading words that hold more than
   1 / ``SHARE`` of all words are routed by their second word as well, and such leading
   pairs by their third: both are told by loads of ``LOAD_SLOTS`` hashed slots, counted
   over all texts, so every task agrees.
4. A task sorts blocks of whole buckets by a three-way multikey quicksort of pointers, all
   partitions of a round at once: a partition of pointers equal in d words is a phrase of d
   words and its weight is the phrase's count; partitions below ``least`` are abandoned.
   Of a split word (or pair) the shorter phrases are partial counts, which are summed, and so
   are all counts of a bucket that is larger than a block.
5. Counts of a candidate's parts are joined by phrase (those of very frequent words, at most
   ``SHARE``, are broadcast), its cuts scored, covered candidates dropped, the best of each
   language ranked in two steps: within salted shares, then over ranges of the rank order.

Defined results: a NULL text is empty, a NULL language is ``und``; a text without words or
a language without candidates adds no row; repeated rows count each time; equal scores are
ordered by count, then by phrase (UTF-8 bytes); an empty table gives an empty result. Very
long texts are counted in overlapping slices, whole.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staylens._util import qcol
from staylens.llm.common import share, stored
from staylens.llm.merkle import numbered
from staylens.llm.minhash import mix

DEPTH = 3
LEAST = 10
TOP = 2_000
#: Hashed slots of words and of pairs whose loads are counted, and the share of all words
#: (one in so many) from which a slot is hot: at most ``SHARE`` slots are.
LOAD_SLOTS = 4_096
SHARE = 1_024
#: Suffixes of a bucket, about.
BUCKET = 400_000
#: Words of a chunk (its distinct words and the end mark have 21-bit numbers).
CHUNK = 1 << 20
#: Distinct suffixes that a task sorts at once, at most and (if there are so many) at least.
BLOCK = 1_500_000
LEAST_BLOCK = 200_000
#: Rows a language's candidates are dealt into before the last ranking.
RANK_SALT = 32

_BITS = 21
_BREAK = b"\xff"  # in no UTF-8 text
# Lower-cases A-Z; piece ends become \n, tabs spaces.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))


def marked_words(text: bytes) -> list[bytes]:
    """The words of a text, with a break after every piece but the last."""
    return text.translate(_FOLD).replace(b"\n", b" \xff ").split()


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = zlib.crc32(word) + 1 if word != _BREAK else 0
        return value


def word_slot(word: np.ndarray, lang: int) -> np.ndarray:
    return (mix(word.astype(np.uint64) ^ np.uint64(lang << 32)) % np.uint64(LOAD_SLOTS)).astype(np.int64)


def pair_slot(first: np.ndarray, second: np.ndarray, lang: int) -> np.ndarray:
    code = (first.astype(np.uint64) << np.uint64(32)) ^ second.astype(np.uint64)
    return (mix(mix(code) ^ np.uint64(lang)) % np.uint64(LOAD_SLOTS)).astype(np.int64)


def _texts(batch):
    langs = batch.column(0).to_pylist()
    for lang, t in zip(langs, batch.column(1).cast(pa.binary())):
        value = t.as_py()
        if value:
            yield lang, marked_words(value)


def loads(rows: DataFrame) -> DataFrame:
    """(kind, lang, slot, n): words of each language (kind 0), loads of the word slots (1) and
    of the pair slots (2). ``rows``: lang, text."""

    def run(batches):
        hashes, total, slots = _Hashes(), {}, np.zeros((2, LOAD_SLOTS), np.int64)
        for batch in batches:
            for lang, words in _texts(batch):
                if len(hashes) > CHUNK:
                    hashes.clear()
                h = np.fromiter(map(hashes.__getitem__, words), np.int64, len(words))
                code = zlib.crc32(lang.encode())
                slots[0] += np.bincount(word_slot(h[h > 0], code), minlength=LOAD_SLOTS)
                inside = (h[:-1] > 0) & (h[1:] > 0)
                slots[1] += np.bincount(pair_slot(h[:-1][inside], h[1:][inside], code), minlength=LOAD_SLOTS)
                total[lang] = total.get(lang, 0) + int((h > 0).sum())
        out = [(0, lang, 0, n) for lang, n in total.items() if n]
        for k in (0, 1):
            out += [(k + 1, "", i, int(slots[k, i])) for i in np.flatnonzero(slots[k]).tolist()]
        yield pa.RecordBatch.from_pylist([dict(zip(("kind", "lang", "slot", "n"), r)) for r in out], schema=pa.schema(
            [("kind", pa.int32()), ("lang", pa.string()), ("slot", pa.int32()), ("n", pa.int64())]))

    return (rows.mapInArrow(run, "kind int, lang string, slot int, n bigint")
            .groupBy("kind", "lang", "slot").agg(F.sum("n").alias("n")))


class _Chunk:
    """Texts of a chunk as word numbers; 0 ends a piece."""

    def __init__(self, hot: np.ndarray, depth: int, buckets: int):
        self.hot, self.depth, self.buckets = hot, depth, buckets
        self.clear()

    def clear(self):
        self.ids: dict[str, dict[bytes, int]] = {}
        self.words, self.langs, self.hashes = [b""], [""], [0]
        self.parts, self.starts, self.size = [], [], 0

    def add(self, lang: str, words: list[bytes]):
        own = self.ids.setdefault(lang, {_BREAK: 0})
        for w in words:
            if w not in own:
                own[w] = len(self.words)
                self.words.append(w)
                self.langs.append(lang)
                self.hashes.append(zlib.crc32(w) + 1)
        self.parts.append(np.fromiter(map(own.__getitem__, words), np.int64, len(words)))

    def suffixes(self):
        """Record batch (bucket, lang, kind, w0, w1, ..., n) of the distinct suffixes: kind 0
        for whole leading words, 1 for words split by the second word, 2 by the third; the
        words of a row are joined by line ends, which no word contains."""
        gap = np.zeros(self.depth - 1, np.int64)
        ids = np.concatenate([x for p in self.parts for x in (p, gap)])
        begins = np.concatenate([np.arange(len(p) + len(gap)) < s for p, s in zip(self.parts, self.starts)])
        at = np.flatnonzero(begins & (ids > 0))
        keys = [ids[at]]
        for d in range(1, self.depth):
            keys.append(np.where(keys[-1] > 0, ids[np.minimum(at + d, len(ids) - 1)], 0))
        keys, n = distinct(keys)
        hashes = np.array(self.hashes, np.int64)
        number: dict[str, int] = {}
        lang = np.array([number.setdefault(x, len(number)) for x in self.langs])[keys[0]]
        bucket, kind = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        for name, code in number.items():
            mine = np.flatnonzero(lang == code)
            crc = zlib.crc32(name.encode())
            h = [hashes[k[mine]] for k in keys]
            hot = self.hot[0][word_slot(h[0], crc)]
            pair = hot & (h[1] > 0) & self.hot[1][pair_slot(h[0], h[1], crc)] & (self.depth > 2)
            route = mix(h[0].astype(np.uint64) ^ np.uint64(crc << 32))
            route = np.where(hot, mix(route ^ h[1].astype(np.uint64)), route)
            if self.depth > 2:
                route = np.where(pair, mix(route ^ h[2].astype(np.uint64)), route)
            bucket[mine] = (route % np.uint64(self.buckets)).astype(np.int64)
            kind[mine] = np.where(pair, 2, np.where(hot, 1, 0))
        order = np.lexsort((kind, lang, bucket))  # stable: suffixes stay sorted in their row
        keys, n, bucket, kind, lang = [k[order] for k in keys], n[order], bucket[order], kind[order], lang[order]
        new = np.ones(len(n), bool)
        new[1:] = (bucket[1:] != bucket[:-1]) | (lang[1:] != lang[:-1]) | (kind[1:] != kind[:-1])
        begin = np.flatnonzero(new)
        offsets = pa.array(np.append(begin, len(n)).astype(np.int32))
        words = pa.array(self.words, pa.binary()).cast(pa.string())
        joined = [pc.binary_join(pa.ListArray.from_arrays(offsets, words.take(pa.array(k))), "\n") for k in keys]
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket[begin]), pa.array(self.langs).take(pa.array(keys[0][begin])), pa.array(kind[begin], pa.int32()),
             *joined, pa.ListArray.from_arrays(offsets, pa.array(n, pa.int32()))],
            names=["bucket", "lang", "kind", *[f"w{d}" for d in range(self.depth)], "n"])


def distinct(keys: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct key tuples, sorted, and how often each occurs."""
    if len(keys) * _BITS < 64:  # one number for the tuple
        code = np.zeros(len(keys[0]), np.int64)
        for k in keys:
            code = (code << _BITS) | k
        code, n = np.unique(code, return_counts=True)
        return [(code >> (_BITS * i)) & ((1 << _BITS) - 1) for i in reversed(range(len(keys)))], n
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    at = np.flatnonzero(new)
    return [k[at] for k in keys], np.diff(np.append(at, len(order)))


def suffix_rows(rows: DataFrame, hot: np.ndarray, depth: int, buckets: int) -> DataFrame:
    """(bucket, lang, kind, w0, w1, ..., n): distinct suffixes of every chunk by bucket."""
    shared = share(rows.sparkSession, hot)  # 2 x LOAD_SLOTS flags

    def run(batches):
        chunk = _Chunk(shared(), depth, buckets)
        for batch in batches:
            for lang, words in _texts(batch):
                for lo in range(0, len(words), CHUNK // 2):
                    part = words[lo:lo + CHUNK // 2 + depth - 1]
                    chunk.add(lang, part)
                    chunk.starts.append(min(len(part), CHUNK // 2))
                    chunk.size += len(part)
                    if chunk.size >= CHUNK:
                        yield chunk.suffixes()
                        chunk.clear()
        if chunk.size:
            yield chunk.suffixes()

    words = "".join(f", w{d} string" for d in range(depth))
    return rows.mapInArrow(run, f"bucket bigint, lang string, kind int{words}, n array<int>")


def multikey_counts(keys: np.ndarray, weight: np.ndarray, least: list[int]):
    """(pointer, length, count) of the phrases that suffixes begin with.

    ``keys``: a row of word numbers for each depth, 0 past the end; ``least[d]``: the smallest
    count that a phrase of d + 1 words is passed on with, and below which a partition whose
    pointers are to be told apart by word d is abandoned (its phrases cannot be more frequent).
    Three-way quicksort of pointers, all partitions of a round at once.
    """
    found = [[], [], []]
    depths = len(keys)
    bound = np.array([*least, 0])
    ptr = np.arange(keys.shape[1])
    size = np.array([len(ptr)])
    depth = np.zeros(1, np.int64)
    if len(ptr) == 0 or weight.sum() < least[0]:
        size = size[:0]
    while len(size):
        segments = len(size)
        start = np.cumsum(size) - size
        seg = np.repeat(np.arange(segments), size)
        k = keys[depth[seg], ptr]
        a, b, c = k[start], k[start + size // 2], k[start + size - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))  # the middle one of three
        p = pivot[seg]
        side = seg * 3 + (k >= p) + (k > p)  # less, equal, greater
        count = np.bincount(side, minlength=3 * segments)
        total = np.bincount(side, weights=weight[ptr], minlength=3 * segments).astype(np.int64)
        first = np.cumsum(count) - count
        moved = np.empty_like(ptr)
        for s in range(3):
            m = np.flatnonzero(side % 3 == s)
            own = count[s::3]
            within = np.arange(len(m)) - np.repeat(np.cumsum(own) - own, own)
            moved[first[side[m]] + within] = ptr[m]
        child = np.repeat(depth, 3)
        child[1::3] += 1
        phrase = (pivot > 0) & (total[1::3] >= bound[depth])
        found[0].append(moved[first[1::3][phrase]])
        found[1].append(child[1::3][phrase])
        found[2].append(total[1::3][phrase])
        live = (count > 0) & (total >= bound[child]) & (child < depths)
        live[1::3] &= pivot > 0
        ptr, size, depth = moved[np.repeat(live, count)], count[live], child[live]
    return [np.concatenate(f) if f else np.zeros(0, np.int64) for f in found]


def _block_counts(rows: pa.Table, depth: int, least: list[int]) -> pa.RecordBatch:
    """Counts (lang, phrase, words, a) of the phrases that the suffixes of ``rows`` begin with."""
    n = rows.column("n").combine_chunks()
    langs = rows.column("lang").combine_chunks()
    row = np.repeat(np.arange(len(langs)), n.value_lengths().to_numpy(zero_copy_only=False))
    flat = [pc.split_pattern(rows.column(f"w{d}").combine_chunks(), "\n").flatten() for d in range(depth)]
    coded = pa.chunked_array(flat).dictionary_encode().combine_chunks()
    number = coded.indices.to_numpy().astype(np.int64).reshape(depth, -1) + 1
    number[number == pc.index(coded.dictionary, "").as_py() + 1] = 0  # past a piece's end
    lang = langs.dictionary_encode().indices.to_numpy().astype(np.int64)
    number[0] += lang[row] * (len(coded.dictionary) + 1)  # words of different languages differ
    pointer, length, count = multikey_counts(number, n.flatten().to_numpy().astype(np.int64), least)
    out = []
    for d in range(1, depth + 1):
        at = np.flatnonzero(length == d)
        to = pa.array(pointer[at])
        out.append(pa.RecordBatch.from_arrays(
            [langs.take(pa.array(row[pointer[at]])), pc.binary_join_element_wise(*[f.take(to) for f in flat[:d]], " "),
             pa.array(np.full(len(at), d), pa.int32()), pa.array(count[at], pa.int64())], names=["lang", "phrase", "words", "a"]))
    return pa.concat_batches(out)


def phrase_counts(rows: DataFrame, hot: np.ndarray, depth: int = DEPTH, least: int = LEAST, buckets: int = 1,
                  block: int = BLOCK) -> DataFrame:
    """(lang, phrase, words, a): all phrases of at most ``depth`` words that occur ``least``
    times or more. ``rows``: lang, text."""
    routed = suffix_rows(rows, hot, depth, buckets).repartition("bucket").sortWithinPartitions("bucket")
    # whole leading words; words split by the second word; by the third; buckets cut by a block's end
    bounds = [[least] * depth, [1] + [least] * (depth - 1), [1, 1] + [least] * (depth - 2), [1] * depth]

    def counted(parts: list, is_cut: bool):
        rows = pa.Table.from_batches(parts)
        kinds = np.full(rows.num_rows, 3) if is_cut else rows.column("kind").to_numpy()
        for k in range(4):
            own = rows.filter(pa.array(kinds == k))
            if own.num_rows:
                yield _block_counts(own, depth, bounds[k])

    def run(batches):
        bucket, own, own_size, cut = None, [], 0, False  # the bucket that is being read
        done, done_size = [], 0  # whole buckets
        for batch in batches:
            number = batch.column(0).to_numpy()
            sizes = batch.column(batch.num_columns - 1).value_lengths().to_numpy(zero_copy_only=False)
            for i in range(batch.num_rows):
                if number[i] != bucket:
                    if cut and own:
                        yield from counted(own, True)
                    elif own:
                        done += own
                        done_size += own_size
                    bucket, own, own_size, cut = number[i], [], 0, False
                    if done_size >= min(block, LEAST_BLOCK):
                        yield from counted(done, False)
                        done, done_size = [], 0
                own.append(batch.slice(i, 1))
                own_size += int(sizes[i])
                if own_size >= block:
                    yield from counted(own, True)
                    own, own_size, cut = [], 0, True
        if cut and own:
            yield from counted(own, True)
        elif own:
            done += own
        if done:
            yield from counted(done, False)

    counted_ = routed.mapInArrow(run, "lang string, phrase string, words int, a bigint")
    return counted_.groupBy("lang", "phrase", "words").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def _looked_up(rows: DataFrame, part: str, out: str, frequent: DataFrame, counts: DataFrame) -> DataFrame:
    """``rows`` with ``out``, the count of the phrase in ``part``."""
    top = frequent.select("lang", F.col("phrase").alias(part), F.col("a").alias("top_"))
    side = counts.select("lang", F.col("phrase").alias("part_"), F.col("a").alias("own_"))
    # rows that the broadcast served get a part that no phrase equals, spread by their phrase
    keyed = rows.join(F.broadcast(top), ["lang", part], "left").withColumn(
        "part_", F.when(F.col("top_").isNull(), F.col(part)).otherwise(F.concat(F.lit(" "), "phrase", F.lit(" "), part)))
    return keyed.join(side, ["lang", "part_"], "left").withColumn(out, F.coalesce("top_", "own_")).drop("top_", "own_", "part_")


def _score() -> Column:
    """floor(1000000 a a / (l r)), exact up to counts of 15 digits."""
    return F.expr("(cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0)))"
                  " div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))")


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", depth: int = DEPTH, least: int = LEAST,
         top: int = TOP, covered: int = 50) -> DataFrame:
    """(lang, rank, phrase, words, a, l, r, n, score): the best phrases of each language.

    A phrase is left out if a phrase one word longer that holds it has ``covered`` percent of
    its count or more (a still longer one is never more frequent).
    """
    rows = docs.select(F.coalesce(qcol(lang).cast("string"), F.lit("und")).alias("lang"), qcol(text).cast("string").alias("text"))
    load = stored(loads(rows), "loads")
    totals = load.where("kind = 0").select("lang", "n")
    every = totals.agg(F.sum("n")).first()[0] or 0
    hot = np.zeros((2, LOAD_SLOTS), bool)
    for r in load.where((F.col("kind") > 0) & (F.col("n") * SHARE > every)).collect():  # at most 2 x SHARE rows
        hot[r["kind"] - 1, r["slot"]] = True
    counts = stored(phrase_counts(rows, hot, depth, least, -(-every // BUCKET) or 1), "counts")
    frequent = counts.where((F.col("words") == 1) & (F.col("a") * SHARE > every))  # at most SHARE rows
    word = F.split("phrase", " ", -1)

    def joined(lo, n):
        return F.array_join(F.slice("word_", lo, n), " ")

    cuts = F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.struct(
        k.alias("k"), joined(F.lit(1), k).alias("left_"), joined(k + 1, F.col("words") - k).alias("right_")))
    candidates = counts.where("words > 1")
    split = candidates.withColumn("word_", word)
    longest = (split.where("words > 2").select("lang", "a", F.explode(F.array(
        joined(F.lit(1), F.col("words") - 1), joined(F.lit(2), F.col("words") - 1))).alias("phrase"))
        .groupBy("lang", "phrase").agg(F.max("a").alias("longest")))
    kept = (candidates.join(longest, ["lang", "phrase"], "left")
            .where(F.col("longest").isNull() | (F.col("longest") * 100 < F.col("a") * covered)).drop("longest"))
    cut = kept.withColumn("word_", word).select("lang", "phrase", "words", "a", F.inline(cuts))
    cut = _looked_up(_looked_up(cut, "left_", "l", frequent, counts), "right_", "r", frequent, counts)
    best = (cut.withColumn("score", _score()).groupBy("lang", "phrase", "words", "a")
            .agg(F.min(F.struct("score", "k", "l", "r")).alias("b")).select("lang", "phrase", "words", "a", "b.score", "b.l", "b.r"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = best.withColumn("salt_", F.pmod(F.xxhash64("phrase"), F.lit(RANK_SALT)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt_").orderBy(*order))).where(F.col("rank") <= top)
    ranked = numbered(first.select(F.col("lang").alias("g"), (-F.col("score")).alias("low_"), (-F.col("a")).alias("few_"), "phrase",
                                   "words", "a", "l", "r", "score"), ["low_", "few_", "phrase"], "ranked")
    ranked = ranked.withColumn("rank", F.col("pos") + 1).where(F.col("rank") <= top).withColumnRenamed("g", "lang")
    sent = totals.select("lang", "n", F.explode(F.sequence(F.lit(0), F.lit(RANK_SALT - 1))).alias("salt_"))
    return ranked.withColumn("salt_", F.col("rank") % RANK_SALT).join(sent, ["lang", "salt_"]).select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "words", "a", "l", "r", "n", "score")
