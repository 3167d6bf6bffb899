"""Operator 5: quality classifier by importance resampling.

Word and word-pair hashes fall into buckets; the target model (documents labelled good)
and the raw model (all documents) are bucket distributions. A document's weight is the
log-likelihood ratio of its n-grams; adding Gumbel noise and taking the k largest keys
draws k documents without replacement in proportion to their weights.

The target is at most ``max_labelled`` labelled documents, chosen by a hash of doc_id (the
documented bound of the fit); the raw counts, the weights and the ranks cover every row.

Defined results: a text without words has weight 0; the noise is a hash of doc_id and the
seed, so a run can be repeated; equal keys rank by doc_id; without labelled documents
every weight is 0.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens._util import qcol
from staylens.llm.common import annotate, folded_words, free_name, stored
from staylens.llm.minhash import mix

BUCKETS = 10_000
MAX_LABELLED = 20_000
#: Weight of the raw model in the target model, in n-grams.
PRIOR = 1000.0


def buckets(words: list[bytes], count: int = BUCKETS) -> np.ndarray:
    """Bucket of every word and every pair of neighbours."""
    h = np.fromiter(map(crc32, words), np.uint64, len(words))
    pairs = mix((h[:-1] << np.uint64(32)) | h[1:]) if len(h) > 1 else h[:0]
    return (np.concatenate((mix(h), pairs)) % np.uint64(count)).astype(np.int64)


def labelled_ids(docs: DataFrame, labels: DataFrame, label: str, value: int, key: str,
                 limit: int | None) -> DataFrame:
    """Ids of documents with that label alone; at most ``limit`` of them, in hash order."""
    known = (labels.where(qcol(label).isNotNull() & qcol(key).isNotNull())
             .groupBy(qcol(key).alias("id")).agg(F.min(qcol(label)).alias("low"), F.max(qcol(label)).alias("high"))
             .where((F.col("low") == value) & (F.col("high") == value)).select("id"))
    present = docs.select(qcol(key).alias("id")).distinct()
    found = known.join(present, "id", "left_semi")
    return found if limit is None else found.orderBy(F.xxhash64("id"), "id").limit(limit)


def bucket_counts(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text",
                  count: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """n-gram counts per bucket of the target documents and of all documents."""
    marked = target.select(F.col("id").alias("id_"), F.lit(1).alias("good"))
    # the broadcast side has at most max_labelled rows of two numbers
    rows = docs.select(qcol(key).alias("id_"), qcol(text).cast("string").alias("text")).join(
        F.broadcast(marked), "id_", "left").select("text", F.coalesce("good", F.lit(0)).alias("good"))

    def run(batches):
        good, every = np.zeros(count, np.int64), np.zeros(count, np.int64)
        for batch in batches:
            for t, g in zip(batch.column(0).cast(pa.binary()), batch.column(1).to_pylist()):
                value = t.as_py()
                if value:
                    b = np.bincount(buckets(folded_words(value), count), minlength=count)
                    every += b
                    if g:
                        good += b
        used = np.flatnonzero(every)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(good[used]), pa.array(every[used])], names=["bucket", "good", "every"])

    sums = (rows.mapInArrow(run, "bucket bigint, good bigint, every bigint")
            .groupBy("bucket").agg(F.sum("good").alias("good"), F.sum("every").alias("every"))).toArrow()
    good, every = np.zeros(count), np.zeros(count)
    at = sums["bucket"].to_numpy()
    good[at] = sums["good"].to_numpy()
    every[at] = sums["every"].to_numpy()
    return good, every


def log_ratio(good: np.ndarray, every: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """Per bucket the log of target over raw probability. The target model starts from
    ``prior`` n-grams spread as in the raw model, so no seen bucket has probability 0."""
    out = np.zeros(len(every))
    seen = every > 0
    if good.sum():
        raw = every[seen] / every.sum()
        out[seen] = np.log((good[seen] + prior * raw) / ((good.sum() + prior) * raw))
    return out


def weigh(docs: DataFrame, ratio: np.ndarray, text: str = "text", keep=None):
    """(table, name): ``keep`` columns and a struct n_grams, log_weight of each text."""
    name = free_name("weight_", docs)

    def start():
        def work(texts):
            out = []
            for t in texts:
                b = buckets(folded_words(t), len(ratio))
                out.append((len(b), float(ratio[b].sum())))
            return out
        return work

    return annotate(docs, text, name, "n_grams bigint, log_weight double", start, keep=keep), name


def ranked(rows: DataFrame, key: str, tie: str, out: str) -> DataFrame:
    """``rows`` with their rank by descending ``key`` then ``tie``, from 1.

    The rows are laid out by ranges of the key and written once; the rows of the earlier
    ranges, a sum for each range, turn the place in a range into the rank.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(key).desc(), F.col(tie).asc_nulls_first()]
    laid = stored(rows.repartitionByRange(n, *order).withColumn("range_", F.spark_partition_id())
                  .withColumn("row_", F.monotonically_increasing_id()), "ranges")
    sizes = [tuple(r) for r in laid.groupBy("range_").count().orderBy("range_").collect()]
    starts, at = [], 0
    for part, size in sizes:  # a row for each range
        starts.append((part, at))
        at += size
    before = rows.sparkSession.createDataFrame(starts, "range_ int, before_ bigint")
    from pyspark.sql import Window

    within = Window.partitionBy("range_").orderBy(*order, "row_")
    return (laid.join(F.broadcast(before), "range_")
            .withColumn(out, F.col("before_") + F.row_number().over(within))
            .drop("range_", "row_", "before_"))


def resample(docs: DataFrame, labels: DataFrame, share: float = 0.5, seed: int = 42, key: str = "doc_id",
             text: str = "text", label: str = "quality", value: int = 1, count: int = BUCKETS,
             max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, n_grams, log_weight, gumbel_key, rank, selected) for every row; the
    ``ceil(share * rows)`` largest keys are selected."""
    target = stored(labelled_ids(docs, labels, label, value, key, max_labelled), "target")
    ratio = log_ratio(*bucket_counts(docs, target, key, text, count))
    out, name = weigh(docs, ratio, text, [key])
    w = F.col(f"`{name}`")
    # 52 hash bits, centred in their cell: strictly between 0 and 1
    u = (F.shiftrightunsigned(F.xxhash64(qcol(key), F.lit(seed)), 12).cast("double") + 0.5) / F.lit(2.0 ** 52)
    rows = out.select(qcol(key).alias("doc_id"), w["n_grams"].alias("n_grams"), w["log_weight"].alias("log_weight"),
                      (w["log_weight"] - F.log(-F.log(u))).alias("gumbel_key"))
    placed = ranked(rows, "gumbel_key", "doc_id", "rank")
    total = docs.count()
    return placed.withColumn("selected", F.col("rank") <= int(np.ceil(share * total)))
