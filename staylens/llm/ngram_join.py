"""Operator 13: exact Jaccard join of word-shingle sets by token-combination prefixes.

Two texts link when 100 * intersection >= percent * union of their sets of distinct
``size``-word shingles (tokens here: 64-bit hashes). Links are found exactly:

1. Tokens are counted over all texts in 2**32 hashed counters. Those that ``FREQUENT``
   texts or more hold are frequent, in classes by the power of two of their count; at most
   ``MOST`` (the most frequent) are told apart and broadcast, all others count as rare. Any
   split into classes gives the same links; a better one gives fewer candidates.
2. Texts with equal sets are one node. A node's tokens are ordered by class, rare ones
   first, then by hash. At most e tokens of a set can be missing in a linked one. A prefix
   is extended until its tokens are worth e + ``SPARE``: a rare token is worth one, and of a
   range of frequent tokens all but one are. The index keys are the rare tokens and all
   2-token combinations within a range. e tokens destroy at most e of that worth, and the
   prefix that ends first lies within the other one, so linked sets share ``SPARE`` keys or
   more (as many as the shorter prefix allows for small sets). Ranges get finer with the
   set's size, in steps of two; sets near a step are indexed under both.
3. Nodes that share a key meet: every node first meets the one leader with which it shares
   most keys (a key's leader is the member with most partners), the pair is verified on the
   whole sets, and components come from star contraction.
4. Keys whose members are still in several components are settled exactly. Those of at
   most ``SMALL`` members pass on pairs of different components whose sizes allow a link;
   pairs that share enough keys are verified. Nodes that meet in larger keys form groups
   (again by star contraction), whose members meet in blocks with their texts: a task counts
   all intersections of two blocks by matrix products and passes on the links alone.

Nothing is capped. The driver gets the frequent tokens (bounded) and row counts of the
contraction only.

Defined results: a text without words (or NULL) has no shingle, links with nothing and is
its own component; a text shorter than a shingle is one shingle; repeated rows share their
component; a component is named by its smallest doc_id, NULLs left out (NULL if it has
none); an empty table gives no rows; other columns of the table do not matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from staylens._util import qcol
from staylens.llm.common import SLICE_ROWS, annotate, free_name, share, stored
from staylens.llm.lm_score import least_count
from staylens.llm.minhash import WordHashes, components, mix, shingles

SIZE = 4
PERCENT = 85
#: Texts from which a token is frequent, and the most frequent tokens that are broadcast.
FREQUENT = 32
MOST = 1 << 20
#: Keys that linked sets share at least.
SPARE = 4
#: Tokens that a task counts before it passes them on.
HELD = 1 << 21
#: Members of a small key; of a group's block; pairs of one leader in a share of the verification.
SMALL = 48
BLOCK = 256
LEADER_SHARE = 200
#: Tokens of two blocks that are multiplied at once.
COLUMNS = 4_096

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SALT = np.uint64(0xD6E8FEB86659FD93)


def words_of(text: bytes) -> list[bytes]:
    """Words of a text with A-Z lower-cased (split at the space and at 0x09 to 0x0D)."""
    return text.translate(_LOWER).split()


def token_counts(texts: DataFrame, size: int, least: int) -> DataFrame:
    """(code, every): 32-bit codes of tokens that ``least`` texts or more hold (copies that
    meet in a task count once). ``texts``: text."""

    def pack(code, n):
        bucket = code >> 20
        at = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(code) else np.zeros(0, np.int64)
        offsets = pa.array(np.append(at, len(code)).astype(np.int32))
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket[at].astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array(code.astype(np.uint32).view(np.int32))),
             pa.ListArray.from_arrays(offsets, pa.array(n.astype(np.int32)))], names=["bucket", "codes", "counts"])

    def count(batches):
        hashes, held, size_, seen = WordHashes(), [], 0, set()
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE_ROWS):
                lists = list({t: words_of(t) for t in batch.column(0).slice(lo, SLICE_ROWS).cast(pa.binary()).to_pylist() if t}.values())
                who, code, _ = shingles(lists, hashes, size)
                for one in np.split(code, np.flatnonzero(np.diff(who)) + 1):
                    key = int(np.bitwise_xor.reduce(mix(one))) if len(one) else 0
                    if key not in seen:
                        seen.add(key)
                        held.append(one >> np.uint64(32))
                        size_ += len(one)
                if size_ > HELD:
                    yield pack(*np.unique(np.concatenate(held).astype(np.int64), return_counts=True))
                    held, size_ = [], 0
                    seen.clear()
        if held:
            yield pack(*np.unique(np.concatenate(held).astype(np.int64), return_counts=True))

    def merged(codes, counts):
        code, back = np.unique(np.concatenate(codes), return_inverse=True)
        return [code], [np.bincount(back, np.concatenate(counts), len(code)).astype(np.int64)]

    def total(batches):
        """Sums a bucket at a time: at most 2**20 counters."""
        bucket, codes, counts, pending = None, [], [], 0

        def out():
            (code,), (n,) = merged(codes, counts)
            often = n >= least
            return pa.RecordBatch.from_arrays([pa.array(code[often]), pa.array(n[often])], names=["code", "every"])

        for batch in batches:
            for i in range(batch.num_rows):
                b = batch.column(0)[i].as_py()
                if b != bucket and codes:
                    yield out()
                    codes, counts, pending = [], [], 0
                bucket = b
                codes.append(batch.column(1)[i].values.to_numpy().view(np.uint32).astype(np.int64))
                counts.append(batch.column(2)[i].values.to_numpy().astype(np.int64))
                pending += len(codes[-1])
                if pending > 1 << 21:
                    codes, counts = merged(codes, counts)
                    pending = 0
        if codes:
            yield out()

    packed = texts.mapInArrow(count, "bucket int, codes array<int>, counts array<int>")
    return packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(total, "code bigint, every bigint")


def frequent_tokens(texts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted codes of the frequent tokens (at most ``MOST``) and their classes (1, 2, ...)."""
    counts = stored(token_counts(texts, size, FREQUENT), "tokens")
    top = counts.where(F.col("every") >= least_count(counts, MOST)).toArrow()
    code, every = top["code"].to_numpy(), top["every"].to_numpy()
    order = np.argsort(code)
    return code[order], (1 + np.log2(every[order] / FREQUENT).astype(np.int64)).astype(np.int8)


def index_keys(code: np.ndarray, level: np.ndarray, percent: int, spare: int = SPARE) -> tuple[np.ndarray, int]:
    """Index keys of a set (distinct token hashes and their classes, 0: rare), and how many of
    them a linked set shares at least. ``percent`` is 67 or more."""
    n = len(code)
    missing, largest = n * (100 - percent) // 100, 100 * n // percent
    if missing == 0 and largest == n:  # no other set can be linked
        return np.zeros(0, np.uint64), 0
    order = np.lexsort((code, level))
    code, frequent = code[order], np.flatnonzero(level[order] > 0)
    often, keys, fewest = code[frequent], [], spare
    for step in range(n.bit_length() - 1, largest.bit_length()):  # sizes from 2**step on
        ranges = max(1, percent * percent * 2 ** step // 20_000)
        of = (often >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
        worth = np.ones(n, np.int64)
        worth[frequent[np.unique(of, return_index=True)[1]]] = 0
        worth = np.cumsum(worth)
        sure = min(spare, int(worth[-1]) - missing)
        fewest = min(fewest, sure)
        end = int(np.searchsorted(worth, missing + sure)) + 1
        inside = int(np.searchsorted(frequent, end))
        rare = np.ones(end, bool)
        rare[frequent[:inside]] = False
        keys.append(mix(code[:end][rare]))
        by = np.lexsort((often[:inside], of[:inside]))
        token, where = often[:inside][by], of[:inside][by]
        for d in range(1, inside):
            same = where[d:] == where[:-d]
            if not same.any():
                break
            keys.append(mix(mix(token[:-d][same] ^ (_SALT + np.uint64(step))) ^ token[d:][same]))
    return np.unique(np.concatenate(keys)), fewest


def _sets(docs: DataFrame, key: str, text: str, size: int, percent: int):
    """Stored (doc_id, mark, set_key, n, sure, keys) of every row; set_key is NULL without words."""
    body = docs.select(qcol(key).alias("doc_id"), qcol(text).cast("string").alias("text"))
    shared = share(docs.sparkSession, frequent_tokens(body.select("text"), size))  # at most MOST tokens

    def start():
        import xxhash

        codes, levels = shared()
        hashes = WordHashes()

        def work(texts):
            lists = [words_of(t) for t in texts]
            who, code, _ = shingles(lists, hashes, size)
            short = (code >> np.uint64(32)).astype(np.int64)
            at = np.minimum(np.searchsorted(codes, short), max(len(codes) - 1, 0))
            level = np.where(codes[at] == short, levels[at], 0) if len(codes) else np.zeros(len(code), np.int8)
            ends = np.searchsorted(who, np.arange(len(texts) + 1))
            out = []
            for i in range(len(texts)):
                own = slice(ends[i], ends[i + 1])
                if ends[i] == ends[i + 1]:
                    out.append((None, 0, 0, []))
                else:
                    keys, sure = index_keys(code[own], level[own], percent)
                    out.append((xxhash.xxh3_128_digest(code[own].tobytes()), len(code[own]), sure, keys.view(np.int64)))
            return out
        return work

    marked = body.withColumn("mark", F.xxhash64("text"))
    out, c = annotate(marked, "text", free_name("set_", marked), "set_key binary, n bigint, sure int, keys array<bigint>",
                      start, keep=["doc_id", "mark"]), free_name("set_", marked)
    return stored(out.select("doc_id", "mark", f"{c}.*"), "sets")


def _texts_of(ids: DataFrame, nodes: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """Stored (id, text) of the distinct ``ids``."""
    rep = nodes.join(ids, "id").select("id", F.col("rep.doc_id").alias("rep_id"), F.col("rep.mark").alias("rep_mark"))
    body = docs.select(qcol(key).alias("doc_id"), qcol(text).cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))
    return stored(body.join(rep, body["doc_id"].eqNullSafe(rep["rep_id"]) & (body["mark"] == rep["rep_mark"]))
                  .select("id", "text").dropDuplicates(["id"]), "texts")


def _verified(pairs: DataFrame, texts_of, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by their whole sets."""
    pairs = stored(pairs.select("a", "b"), "pairs")
    texts = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    # the text of a node with many pairs goes once to every share of them
    sizes = pairs.groupBy("b").agg(F.floor(F.count("*") / LEADER_SHARE).cast("int").alias("shares"))
    dealt = pairs.join(sizes, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("shares") + 1).cast("int").alias("s"))
    left = dealt.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    right = (sizes.select("b", F.explode(F.sequence(F.lit(0), "shares")).alias("s"))
             .join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b"))

    def run(batches):
        hashes, leader, held = WordHashes(), None, None

        def tokens(t):
            return shingles([words_of(t)], hashes, size)[1]

        for batch in batches:
            a, b = batch.column(0), batch.column(1).to_pylist()
            ta, tb = batch.column(2).cast(pa.binary()), batch.column(3).cast(pa.binary())
            good = []
            for i, node in enumerate(b):
                if node != leader:
                    leader, held = node, tokens(tb[i].as_py())
                own = tokens(ta[i].as_py())
                both = len(np.intersect1d(own, held, assume_unique=True))
                good.append(100 * both >= percent * (len(own) + len(held) - both))
            yield pa.RecordBatch.from_arrays([a, batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return left.join(right, ["b", "s"]).select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint")


def _sizes_fit(x, y, percent: int):
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def _leader_pairs(members: DataFrame, percent: int) -> DataFrame:
    """(a, b): each node with the leader with which it shares most keys."""
    mates = members.groupBy("id").agg(F.sum("k").alias("mates"))
    known = members.join(mates, "id")
    first = known.groupBy("key").agg(F.min(F.struct((-F.col("mates")).alias("m"), F.xxhash64("id").alias("h"),
                                                    "id", "n")).alias("f"))
    met = known.join(first.select("key", F.col("f.id").alias("b"), F.col("f.n").alias("nb")), "key")
    met = met.where((F.col("id") != F.col("b")) & _sizes_fit(F.col("n"), F.col("nb"), percent))
    return (met.groupBy(F.col("id").alias("a"), "b").agg(F.count("*").alias("shared"))
            .groupBy("a").agg(F.max_by("b", F.struct("shared", F.xxhash64("b"))).alias("b")))


def _small_pairs(members: DataFrame, percent: int) -> DataFrame:
    """(a, b) of different components that share enough keys; a key has ``SMALL`` members at most."""
    met = members.select("key", "id", "root", "n", "sure").repartition("key").sortWithinPartitions("key", "id")

    def pairs(key, ids, root, n, sure):
        """Pairs of rows of equal keys, by their distance in the sorted rows."""
        found = [(ids[:0], ids[:0], sure[:0])]
        for d in range(1, len(key)):
            p = np.flatnonzero(key[d:] == key[:-d])
            if not len(p):
                break
            q = p + d
            fit = (root[p] != root[q]) & (100 * np.minimum(n[p], n[q]) >= percent * np.maximum(n[p], n[q]))
            p, q = p[fit], q[fit]
            found.append((ids[p], ids[q], np.minimum(sure[p], sure[q])))
        a, b, least = (np.concatenate(x) for x in zip(*found))
        return pa.RecordBatch.from_arrays(
            [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(least, pa.int32())], names=["a", "b", "sure"])

    def run(batches):
        held = None  # the rows of a key that the next batch may go on with
        for batch in batches:
            rows = [c.to_numpy() for c in batch.columns]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows)]
            if not len(rows[0]):
                continue
            last = int(np.searchsorted(rows[0], rows[0][-1]))
            held = [c[last:] for c in rows]
            yield pairs(*[c[:last] for c in rows])
        if held is not None:
            yield pairs(*held)

    return (met.mapInArrow(run, "a bigint, b bigint, sure int").groupBy("a", "b")
            .agg(F.count("*").alias("shared"), F.first("sure").alias("sure")).where("shared >= sure").select("a", "b"))


def _products(who: np.ndarray, number: np.ndarray, n: int) -> np.ndarray:
    """Common numbers of each two of ``n`` sets, given as (set, number) rows."""
    numbers, at, count = np.unique(number, return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    keep = shared[at]
    who, at = who[keep], place[at[keep]]
    order = np.argsort(at, kind="stable")
    who, at = who[order], at[order]
    out = np.zeros((n, n), np.float32)  # whole numbers up to 2**24
    for lo in range(0, int(shared.sum()), COLUMNS):
        part = slice(*np.searchsorted(at, (lo, lo + COLUMNS)))
        held = np.zeros((n, COLUMNS), np.float32)
        held[who[part], at[part] - lo] = 1
        out += held @ held.T
    return out


def _group_links(members: DataFrame, texts_of, size: int, percent: int) -> DataFrame:
    """Links (a, b) of nodes of different components that share a key of ``members``."""
    first = members.groupBy("key").agg(F.min("id").alias("b"))
    groups = stored(components(members.join(first, "key").select(F.col("id").alias("a"), "b"))
                    .select(F.col("key").alias("id"), F.col("root").alias("group")), "groups")
    blocks = groups.groupBy("group").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    held = (members.groupBy("id").agg(F.first("root").alias("root"), F.first("n").alias("n"), F.collect_list("key").alias("keys"))
            .join(groups, "id").join(blocks, "group").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")))
    texts = texts_of(groups.select("id"))
    sent = (held.join(texts, "id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("group", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                    "block", "id", "root", "n", "keys", "text"))
    met = sent.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j", "id")

    def links(group, rows, hashes):
        block, ids, root, n, keys, texts = zip(*rows)
        block, ids, root, n = (np.array(x) for x in (block, ids, root, n))
        least, most = np.minimum.outer(n, n), np.maximum.outer(n, n)
        fit = (root[:, None] < root[None, :]) & (100 * least >= percent * most)
        if group[1] != group[2]:
            fit &= block[:, None] != block[None, :]
        if not fit.any():
            return ids[:0], ids[:0]
        of_key = np.repeat(np.arange(len(ids)), [len(k) for k in keys])
        fit &= _products(of_key, np.concatenate([np.array(k, np.int64) for k in keys]), len(ids)) > 0
        wanted = np.flatnonzero((fit | fit.T).any(axis=1))
        who, code, _ = shingles([words_of(texts[i]) for i in wanted], hashes, size)
        both = _products(who, code, len(wanted)).astype(np.int64)
        n = n[wanted]
        fit = fit[np.ix_(wanted, wanted)] & (100 * both >= percent * (n[:, None] + n[None, :] - both))
        p, q = np.nonzero(fit)
        return ids[wanted[p]], ids[wanted[q]]

    def run(batches):
        hashes, group, held = WordHashes(), None, []

        def batch_of(found):
            a, b = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            found = []
            texts = batch.column(8).cast(pa.binary()).to_pylist()
            for *row, text in zip(*(batch.column(c).to_pylist() for c in range(8)), texts):
                if tuple(row[:3]) != group:
                    if len(held) > 1:
                        found.append(links(group, held, hashes))
                    group, held = tuple(row[:3]), []
                held.append((*row[3:], text))
            yield batch_of(found)
        if len(held) > 1:
            yield batch_of([links(group, held, hashes)])

    return met.mapInArrow(run, "a bigint, b bigint").distinct()


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id): a row for every row of ``docs``."""
    if not 67 <= percent <= 100:
        raise ValueError("percent must be from 67 to 100")
    sets = _sets(docs, key, text, size, percent)
    nodes = stored(sets.where("set_key is not null").groupBy("set_key").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("rep"),
        F.first("n").alias("n"), F.first("sure").alias("sure"), F.first("keys").alias("keys"))
        .withColumn("id", F.monotonically_increasing_id()), "nodes")
    spread = nodes.select("id", "n", "sure", F.explode("keys").alias("key"))
    members = stored(spread.withColumn("k", F.count("*").over(Window.partitionBy("key"))).where("k > 1"), "members")
    def texts_of(ids: DataFrame) -> DataFrame:
        return _texts_of(ids, nodes, docs, key, text)

    links = stored(_verified(_leader_pairs(members, percent), texts_of, size, percent), "links")
    roots = stored(components(links).withColumnRenamed("key", "id"), "roots")
    rest = members.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    mixed = rest.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
    rest = stored(rest.join(mixed, "key"), "mixed")
    small = _verified(_small_pairs(rest.where(F.col("k") <= SMALL), percent), texts_of, size, percent)
    large = _group_links(rest.where(F.col("k") > SMALL), texts_of, size, percent)
    links = stored(links.unionByName(small).unionByName(large), "links")
    roots = stored(components(links).withColumnRenamed("key", "id"), "roots")
    named = nodes.select("id", "set_key", F.col("rep.doc_id").alias("doc_id")).join(roots, "id", "left").select(
        "set_key", F.coalesce("root", "id").alias("root"), "doc_id", F.col("root").isNotNull().alias("linked"))
    # a large component is dealt into shares, its name sent to each
    smallest = (named.where("linked").groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("m")))
    dealt = smallest.select("root", "component_id", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("s"))
    linked = (named.where("linked").withColumn("s", F.pmod(F.xxhash64("set_key"), F.lit(32)).cast("int"))
              .join(dealt, ["root", "s"]).select("set_key", "component_id"))
    of_set = linked.unionByName(named.where("not linked").select("set_key", F.col("doc_id").alias("component_id")))
    found = sets.where("set_key is not null").select("doc_id", "n", "set_key").join(of_set, "set_key")
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(
        sets.where("set_key is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
