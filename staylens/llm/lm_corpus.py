"""Operator 8 over a corpus: both whole models fitted and applied to the same documents.

The models and the losses are those of ``lm_score`` (every word and bigram, shared
vocabulary, back-off to word frequencies), but no table of bigrams is built and joined:
a document's bigrams travel to where they are counted, and the losses travel back.

1. One pass counts all words, and the bigrams that are frequent in a sample (both exactly).
   The most frequent words and these bigrams, at most ``FREQUENT`` each, are broadcast.
2. A task reads documents in blocks. What the broadcast counts settle is summed at once; every
   other bigram goes to a bucket, by its hash, or by its second word if that is a rare one.
   A block sends one row to a bucket. The number of buckets grows with the words of the corpus.
3. A bucket holds all occurrences of its bigrams and of its rare words, so it counts them,
   takes the losses and returns a sum for each document of a block.
4. A block adds up what the buckets return for its documents.

Sizes of samples, blocks and buckets, and what is broadcast, change no result. The rows of a
task are sorted, so a block that is made again after a loss is the same.

Defined results: those of ``lm_score``: a text without words (or NULL) has losses and score 0;
repeated rows count each; without labelled documents the target model knows word frequencies
1; an empty table gives no rows. Words are told apart by 64 hash bits.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import NumericType, StructField, StructType

from staylens._util import qcol
from staylens.llm.common import SLICE_ROWS, folded_words, free_name, share, stored
from staylens.llm.importance import labelled_ids
from staylens.llm.lm_score import STRENGTH, least_count
from staylens.llm.minhash import mix

#: Most words, and most bigrams, whose counts are broadcast.
FREQUENT = 1 << 18
#: Characters of the texts in which frequent bigrams are looked for.
SAMPLE_CHARS = 1 << 24
#: Words of a bucket (on average); words and documents after which a block ends.
BUCKET_WORDS = 1 << 21
BLOCK_WORDS = 1 << 19
BLOCK_DOCS = 1 << 15
#: Distinct words that a task holds.
HELD = 200_000
#: Characters of the corpus for each part of the counts.
PART_CHARS = 1 << 25
#: Most labelled ids that are broadcast; more are joined by a shuffle of the texts.
TARGET_IDS = 1 << 21


class Words(dict):
    """Numbers of the words a task has met, and their hashes."""

    def __init__(self):
        super().__init__()
        self.new: list[int] = []
        self.hashes = np.zeros(0, np.uint64)

    def __missing__(self, word: bytes) -> int:
        import xxhash

        self.new.append(xxhash.xxh3_64_intdigest(word))
        value = self[word] = len(self)
        return value

    def read(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of all words, words of each text)."""
        lists = [folded_words(t) if t else [] for t in texts]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        ids = np.fromiter(map(self.__getitem__, chain.from_iterable(lists)), np.int64, int(sizes.sum()))
        if self.new:
            self.hashes = np.concatenate((self.hashes, np.array(self.new, np.uint64)))
            self.new = []
        return ids, sizes


def places(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text of each word, whether it is the first, the last of its text)."""
    who = np.repeat(np.arange(len(sizes)), sizes)
    edge = who[1:] != who[:-1]
    if not len(who):
        return who, np.zeros(0, bool), np.zeros(0, bool)
    return who, np.concatenate(([True], edge)), np.concatenate((edge, [True]))


def bigram_codes(hashes: np.ndarray) -> np.ndarray:
    """Codes of each word with the one before it; the first one's is void."""
    out = hashes.copy()
    out[1:] = mix(mix(hashes[:-1]) ^ hashes[1:])
    return out


def found(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in the sorted table, whether there)."""
    if not len(table):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    return at, table[at] == wanted


def _slices(batch):
    for lo in range(0, batch.num_rows, SLICE_ROWS):
        yield batch.slice(lo, SLICE_ROWS)


def sampled_bigrams(rows: DataFrame, chars: int) -> np.ndarray:
    """Sorted codes of at most ``FREQUENT`` bigrams, the most frequent ones of a sample.
    ``rows``: id, text; ``chars``: the length of all texts."""
    part = max(1, chars // SAMPLE_CHARS)

    def run(batches):
        words = Words()
        for batch in batches:
            codes = [np.zeros(0, np.uint64)]
            for texts in _slices(batch):
                ids, sizes = words.read(texts.column(0).cast(pa.binary()).to_pylist())
                codes.append(bigram_codes(words.hashes[ids])[~places(sizes)[1]])
                if len(words) > HELD:
                    words = Words()
            code, n = np.unique(np.concatenate(codes), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), pa.array(n)], names=["code", "every"])

    sample = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(part)) == 0).select("text")
    counts = stored(sample.mapInArrow(run, "code bigint, every bigint").groupBy("code")
                    .agg(F.sum("every").alias("every")).where("every > 1"), "sample")
    top = counts.where(F.col("every") >= least_count(counts, FREQUENT)).toArrow()
    return np.sort(top["code"].to_numpy().view(np.uint64))


def exact_counts(rows: DataFrame, bigrams: np.ndarray, parts: int) -> DataFrame:
    """(bigram, key, every, good, last_every, last_good) of all words and the given bigrams.
    A task sends one row to each of the ``parts`` that the words and bigrams are dealt over."""
    shared = share(rows.sparkSession, bigrams)  # at most FREQUENT
    names = ["bigram", "key", "every", "good", "last_every", "last_good"]

    def run(batches):
        table = shared()
        words = Words()
        of_words, of_pairs = np.zeros((4, 0), np.int64), np.zeros((2, len(table)), np.int64)

        def batch_of():
            part = (words.hashes % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            ends = np.searchsorted(part[order], np.arange(parts + 1))
            key, counts = words.hashes[order], of_words[:, order].astype(np.int32)
            made = [(p, key[lo:hi].tobytes(), counts[:, lo:hi].tobytes(), of_pairs[:, p::parts].astype(np.int32).tobytes())
                    for p, (lo, hi) in enumerate(zip(ends, ends[1:]))]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*made), (pa.int32(), *[pa.binary()] * 3))],
                names=["part", "keys", "counts", "pairs"])

        for batch in batches:
            for part in _slices(batch):
                ids, sizes = words.read(part.column(0).cast(pa.binary()).to_pylist())
                who, first, last = places(sizes)
                good = part.column(1).to_numpy(zero_copy_only=False).astype(bool)[who]
                size = len(words)
                of_words = np.pad(of_words, ((0, 0), (0, size - of_words.shape[1])))
                for m, which in enumerate((slice(None), good, last, good & last)):
                    of_words[m] += np.bincount(ids[which], minlength=size)
                at, there = found(table, bigram_codes(words.hashes[ids]))
                there &= ~first
                for m, which in enumerate((there, there & good)):
                    of_pairs[m] += np.bincount(at[which], minlength=len(table))[:len(table)]
                if size > HELD:
                    yield batch_of()
                    words, of_words = Words(), np.zeros((4, 0), np.int64)
                    of_pairs[:] = 0
        yield batch_of()

    def total(batches):
        table, part, keys, counts, pairs = shared(), None, [], [], None

        def batch_of():
            key, of = np.unique(np.concatenate(keys), return_inverse=True)
            sums = [np.bincount(of, x, len(key)).astype(np.int64) for x in np.concatenate(counts, axis=1)]
            codes = table[part::parts]
            columns = [np.repeat([False, True], [len(key), len(codes)]), np.concatenate((key, codes)).view(np.int64)]
            more = [*pairs, *np.zeros((2, len(codes)), np.int64)]
            return pa.RecordBatch.from_arrays(
                [pa.array(c) for c in (*columns, *(np.concatenate(x) for x in zip(sums, more)))], names=names)

        for batch in batches:
            for p, key, n, more in zip(*(c.to_pylist() for c in batch.columns)):
                if p != part:
                    if part is not None:
                        yield batch_of()
                    part, keys, counts, pairs = p, [], [], 0
                keys.append(np.frombuffer(key, np.uint64))
                counts.append(np.frombuffer(n, np.int32).reshape(4, -1))
                pairs = pairs + np.frombuffer(more, np.int32).reshape(2, -1).astype(np.int64)
        if part is not None:
            yield batch_of()

    sent = rows.select("text", "good").mapInArrow(run, "part int, keys binary, counts binary, pairs binary")
    return sent.repartition("part").sortWithinPartitions("part").mapInArrow(
        total, "bigram boolean, " + ", ".join(f"{c} bigint" for c in names[1:]))


def _model(counts: DataFrame) -> dict:
    """What tasks know of both models: totals, frequent words, frequent bigrams (sorted by code).
    Row 0 of each array is the target's, row 1 the background's."""
    words = counts.where("not bigram")
    size, good, every = words.agg(F.count("*"), F.sum("good"), F.sum("every")).first()
    total = np.array([[good or 0], [every or 0]]) + size + 1.0
    top = words.where(F.col("every") >= least_count(words, FREQUENT)).toArrow()
    key = top["key"].to_numpy().view(np.uint64)
    order = np.argsort(key)
    n, ends = (np.stack([top[c].to_numpy()[order] for c in pair])
               for pair in (("good", "every"), ("last_good", "last_every")))
    pairs = counts.where("bigram").select("key", "good", "every").toArrow()  # at most FREQUENT
    code = pairs["key"].to_numpy().view(np.uint64)
    by = np.argsort(code)
    return {"total": total, "words": key[order], "p": (n + 1) / total, "held": np.log(n - ends + STRENGTH),
            "bigrams": code[by], "counts": np.stack([pairs[c].to_numpy()[by] for c in ("good", "every")]),
            "buckets": max(1, -(-int(every or 0) // BUCKET_WORDS))}


def _routed(rows: DataFrame, keep: list[str], model) -> DataFrame:
    """Rows of blocks: one with the documents (``home``) and one for each bucket."""
    names = ["bucket", "block", "home", "code", "word", "who", "rare", "edge"]
    width = len(keep)

    def run(batches):
        m = model()
        buckets, task = np.uint64(m["buckets"]), TaskContext.get().partitionId()
        words, place = Words(), np.zeros(0, np.int64)
        blocks, docs, sums, sent, held = 0, [], [], [], 0

        def block():
            nonlocal blocks, docs, sums, sent, held
            number = (task << 32) + blocks
            kept = pa.Table.from_batches(docs).combine_chunks()
            total = np.concatenate(sums, axis=1)
            for i, name in enumerate(("n_", "a_", "b_")):
                kept = kept.append_column(f"{name}{width}", pa.array(total[i]))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, kept.schema) as out:
                out.write_table(kept)
            code, word, who, rare, edge = (np.concatenate(x) for x in zip(*sent))
            to = (np.where(word < 0, rare, code) % buckets).astype(np.int64)
            order = np.argsort(to, kind="stable")
            to, code, word, who, rare, edge = (x[order] for x in (to, code, word, who, rare, edge))
            at = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1]))) if len(to) else np.zeros(0, np.int64)
            made = [(int(number % int(buckets)), number, sink.getvalue().to_pybytes(), *[None] * 5)]
            for lo, hi in zip(at, [*at[1:], len(to)]):
                few = word[lo:hi] < 0
                made.append((int(to[lo]), number, None, code[lo:hi].tobytes(), word[lo:hi].tobytes(), who[lo:hi].tobytes(),
                             rare[lo:hi][few].tobytes(), edge[lo:hi][few].tobytes()))
            blocks, docs, sums, sent, held = blocks + 1, [], [], [], 0
            types = [pa.int32(), pa.int64(), *[pa.binary()] * 6]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), types)], names=names)

        for batch in batches:
            for part in _slices(batch):
                ids, sizes = words.read(part.column(width).cast(pa.binary()).to_pylist())
                if len(place) < len(words):
                    at, there = found(m["words"], words.hashes[len(place):])
                    place = np.concatenate((place, np.where(there, at, -1)))
                who, first, last = places(sizes)
                good = part.column(width + 1).to_numpy(zero_copy_only=False).astype(np.int64)
                hashes, word = words.hashes[ids], place[ids]
                code, often = bigram_codes(hashes), word >= 0
                at, there = found(m["bigrams"], code)
                there &= often & ~first
                begin, context = often & first, often & ~last
                out = [sizes]
                for k in (0, 1):
                    p = m["p"][k]
                    loss = np.zeros(len(ids))
                    loss[there] = -np.log(m["counts"][k][at[there]] + STRENGTH * p[word[there]])
                    loss[begin] = -np.log(p[word[begin]])
                    loss[context] += m["held"][k][word[context]]
                    out.append(np.bincount(who, loss, len(sizes)))
                sums.append(np.stack(out))
                base = sum(d.num_rows for d in docs)
                docs.append(part.select(range(width)).rename_columns([f"c{i}" for i in range(width)]))
                go = ~(there | begin)
                who = (base + who[go]) * 2 + good[who[go]]
                sent.append((code[go], word[go].astype(np.int32), who.astype(np.uint16), hashes[go],
                             (first[go] + 2 * last[go]).astype(np.int8)))
                held += int(go.sum())
                if held > BLOCK_WORDS or base + 2 * SLICE_ROWS > BLOCK_DOCS:
                    yield block()
                if len(words) > HELD:
                    words, place = Words(), np.zeros(0, np.int64)
        if docs:
            yield block()

    ddl = "bucket int, block bigint, home binary, code binary, word binary, who binary, rare binary, edge binary"
    return rows.select(*[qcol(c) for c in keep], "text", "good").mapInArrow(run, ddl)


def _bucket_losses(chunks: list, m: dict) -> list[tuple]:
    """(block, documents, target sums, background sums) of all rows of one bucket."""
    lengths = [len(c[2]) // 8 for c in chunks]
    code, word, who, rare, edge = (np.concatenate([np.frombuffer(c[i], t) for c in chunks]) for i, t in (
        (2, np.uint64), (3, np.int32), (4, np.uint16), (5, np.uint64), (6, np.int8)))
    good = who & 1
    few = np.flatnonzero(word < 0)
    first, last = edge & 1 > 0, edge & 2 > 0
    distinct, of = np.unique(rare, return_inverse=True)
    _, back = np.unique(code, return_inverse=True)
    losses = []
    for k, weight in ((0, good.astype(float)), (1, np.ones(len(code)))):
        n = np.bincount(of, weight[few], len(distinct))
        held = n - np.bincount(of, weight[few] * last, len(distinct))
        p = m["p"][k][word] if len(m["words"]) else np.zeros(len(word))
        p[few] = ((n + 1) / m["total"][k, 0])[of]
        weight[few[first]] = 0.0  # a text's first word is no bigram and has its frequency alone
        loss = np.bincount(back, weight)[back]
        alone = p[few[first]]
        p *= STRENGTH
        loss += p
        loss[few[first]] = alone
        loss = np.negative(np.log(loss, out=loss), out=loss)
        loss[few[~last]] += np.log(held + STRENGTH)[of[~last]]
        losses.append(loss)
    out, lo = [], 0
    for (_, block, *_), size in zip(chunks, lengths):
        part = slice(lo, lo + size)
        docs, at = np.unique(who[part] >> 1, return_inverse=True)
        out.append((block, docs, *(np.bincount(at, x[part]) for x in losses)))
        lo += size
    return out


def _returned(routed: DataFrame, model) -> DataFrame:
    """The homes, and for each block and bucket the sums of the block's documents."""
    names = ["block", "bucket", "home", "who", "a", "b"]

    def run(batches):
        m, bucket, chunks = model(), None, []

        def rows():
            made = [(block, bucket, None, docs.astype(np.uint16).tobytes(), a.tobytes(), b.tobytes())
                    for block, docs, a, b in _bucket_losses(chunks, m)] if chunks else []
            return made

        def batch_of(made):
            types = [pa.int64(), pa.int32(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in made], t) for i, t in enumerate(types)], names=names)

        for batch in batches:
            for i in range(batch.num_rows):
                row = [c[i].as_py() for c in batch.columns]
                if row[0] != bucket:
                    if chunks:
                        yield batch_of(rows())
                    bucket, chunks = row[0], []
                if row[2] is not None:
                    yield batch_of([(row[1], -1, row[2], None, None, None)])
                else:
                    chunks.append((row[0], row[1], *row[3:]))
        if chunks:
            yield batch_of(rows())

    return (routed.repartition("bucket").sortWithinPartitions("bucket", "block")
            .mapInArrow(run, "block bigint, bucket int, home binary, who binary, a binary, b binary"))


def score_corpus(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
                 value: int = 1, keep=None):
    """(table, name): ``keep`` columns and a struct n_words, target and background loss, and their
    difference, of every whole text, by the whole models of these documents. The target is every
    document whose labels are all ``value``."""
    names = list(docs.columns if keep is None else keep)
    name, body, flag, ident = (free_name(x, docs) for x in ("lm_", "text_", "good_", "id_"))
    spark = docs.sparkSession
    good = stored(labelled_ids(docs, labels, label, value, key, None), "target").select(
        F.col("id").alias(ident), F.lit(True).alias(flag))
    if isinstance(good.schema[ident].dataType, NumericType) and good.count() <= TARGET_IDS:
        good = F.broadcast(good)  # at most TARGET_IDS numbers
    marked = (docs.select(*[qcol(c) for c in names], qcol(text).cast("string").alias(body), qcol(key).alias(ident + "k"))
              .join(good, F.col(ident + "k") == F.col(ident), "left").withColumn(flag, F.coalesce(flag, F.lit(False))))
    plain = marked.select(F.col(ident + "k").alias("id"), F.col(body).alias("text"), F.col(flag).alias("good"))
    texts = docs.select(qcol(key).alias("id"), qcol(text).cast("string").alias("text"))
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    counts = stored(exact_counts(plain, sampled_bigrams(texts, chars), max(8, chars // PART_CHARS)), "counts")
    model = share(spark, _model(counts))  # at most FREQUENT words and bigrams
    # a fixed order, so that a task that runs again makes the same blocks
    inner = [f"c{i}" for i in range(len(names))]
    ordered = marked.sortWithinPartitions(ident + "k", F.xxhash64(body)).select(
        *[qcol(c).alias(i) for c, i in zip(names, inner)], F.col(body).alias("text"), F.col(flag).alias("good"))
    back = _returned(_routed(ordered, inner, model), model).repartition("block").sortWithinPartitions("block", "bucket")

    fields = list(docs.select(*[qcol(c) for c in names]).schema.fields)
    struct = StructType.fromDDL("n_words bigint, target_loss double, background_loss double, difference double")
    schema = StructType([*fields, StructField(name, struct)])
    types = to_arrow_schema(schema)
    width = len(names)

    def run(batches):
        block, kept, sums = None, None, None

        def batch_of():
            n = sums[0].astype(np.int64)
            a, b = (x / np.maximum(n, 1) for x in sums[1:])
            made = pa.StructArray.from_arrays([pa.array(x) for x in (n, a, b, a - b)],
                                              fields=list(types.field(width).type))
            columns = [kept.column(i).cast(types.field(i).type) for i in range(width)]
            return pa.Table.from_arrays([*columns, made], names=types.names).combine_chunks().to_batches()

        for batch in batches:
            for i in range(batch.num_rows):
                number, bucket, home, who, a, b = (c[i].as_py() for c in batch.columns)
                if number != block:
                    if block is not None:
                        yield from batch_of()
                    block = number
                    kept = pa.ipc.open_stream(home).read_all()  # bucket -1 comes first
                    sums = [kept.column(width + k).to_numpy().astype(float) for k in range(3)]
                else:
                    at = np.frombuffer(who, np.uint16)
                    sums[1][at] += np.frombuffer(a)
                    sums[2][at] += np.frombuffer(b)
        if block is not None:
            yield from batch_of()

    return back.mapInArrow(run, schema), name
