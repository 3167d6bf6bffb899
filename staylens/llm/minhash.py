"""Operator 10: near-duplicates by ProbMinHash over weighted five-word shingles.

1. Every text gives its folded words, a 128-bit key of them, its shingles (windows of
   five words; a shorter text is one shingle) weighted by how often they occur, and a
   ProbMinHash signature: each shingle sends exponential arrivals to random registers;
   a text's process stops once the next arrival is later than its last register. Equal
   registers estimate the probability Jaccard similarity.
2. Texts of equal words share a key: a class of copies is one node from here on.
3. Signatures are cut into bands; nodes with an equal band meet in a bucket.
4. Every node meets one leader, the member of its buckets with the most bucket mates (for
   the copies of one base, the base): a pair is a link when the exact similarity of the two
   whole texts reaches the threshold. Components come from star contraction.
5. Buckets that still hold several components are settled exactly, in blocks of members:
   a task gets two blocks of a bucket with their texts, meets the members of different
   components (in the first band that a pair shares), verifies every such
   pair and passes on the links alone.

Nothing is capped: step 4 only lessens what step 5 has to meet. Rows grow with a bucket's
members times its blocks, never with its pairs; no bucket is gathered in one task, and no
link or component passes through the driver.

Defined results: a text without words is in a class of its own; a class is named by its
smallest doc_id (NULL if it has none); repeated rows share their class.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens._util import qcol
from staylens.llm.common import annotate, folded_words, free_name, stored

SHINGLE = 5
THRESHOLD = 0.8
ROUNDING = 1e-9
BANDS = 24
ROWS = 5
#: Members of a bucket's block in step 5.
BLOCK = 256
#: Members of one leader in a share of step 4 (hot leaders are salted).
LEADER_SHARE = 500

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_WORDS_KEPT = 300_000


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = (x + _M1).astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * _M2
        x = (x ^ (x >> np.uint64(27))) * _M3
        return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(lists: list[list[bytes]], hashes: WordHashes, size: int = SHINGLE):
    """(text number, shingle hash, count) of several texts, distinct, sorted."""
    if len(hashes) > _WORDS_KEPT:
        hashes.clear()
    words, owner = [], []
    for i, ws in enumerate(lists):
        if ws:
            words += map(hashes.__getitem__, ws)
            n = max(size, len(ws))
            words += [0] * (n - len(ws))  # a short text is one shingle, padded
            owner.append((i, n))
    if not words:
        z = np.zeros(0, np.int64)
        return z, z.astype(np.uint64), z
    h = np.array(words, np.uint64)
    who = np.repeat([i for i, _ in owner], [n for _, n in owner])
    last = len(h) - size + 1
    code = np.zeros(last, np.uint64)
    for k in range(size):
        code = mix(code ^ h[k:last + k])
    inside = who[:last] == who[size - 1:]
    code, who = code[inside], who[:last][inside]
    order = np.lexsort((code, who))
    code, who = code[order], who[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (who[1:] != who[:-1])
    at = np.flatnonzero(new)
    return who[at], code[at], np.diff(np.append(at, len(code)))


def signatures(who: np.ndarray, code: np.ndarray, weight: np.ndarray, n: int, registers: int):
    """ProbMinHash signatures (uint32) of ``n`` texts; texts without shingles get zeros.

    Each shingle is a Poisson process of rate ``weight`` whose arrivals fall on random
    registers; a register keeps the shingle of its first arrival.
    """
    first = np.full(n * registers, np.inf)
    out = np.zeros(n * registers, np.uint32)
    time = np.zeros(len(code))
    live = np.arange(len(code))
    step = np.uint64(0)
    m = np.uint64(registers)
    while len(live):
        c, w, d = code[live], weight[live], who[live]
        step += np.uint64(1)
        with np.errstate(over="ignore"):
            r = mix(c ^ mix(np.full(1, step, np.uint64)))
        u = ((r >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53
        time[live] += -np.log(u) / w
        t = time[live]
        slot = d * registers + (mix(r) % m).astype(np.int64)
        better = t < first[slot]
        s, t2 = slot[better], t[better]
        np.minimum.at(first, s, t2)
        win = first[s] == t2
        out[s[win]] = (c[better][win] >> np.uint64(32)).astype(np.uint32)
        latest = first.reshape(n, registers).max(axis=1)
        live = live[t < latest[d]]  # early termination
    return out.reshape(n, registers)


def probability_jaccard(ca, wa, cb, wb) -> float:
    """Probability Jaccard of two weighted sets (sorted distinct codes and weights)."""
    common, ia, ib = np.intersect1d(ca, cb, assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    a, b = wa[ia].astype(float), wb[ib].astype(float)
    only_a, only_b = float(wa.sum() - a.sum()), float(wb.sum() - b.sum())
    # sum over e of max(a_e / a_d, b_e / b_d): the a part where a_e / b_e >= a_d / b_d
    ratio = a / b
    order = np.argsort(ratio, kind="stable")
    a, b, ratio = a[order], b[order], ratio[order]
    below_b = np.concatenate(([0.0], np.cumsum(b)))
    above_a = a.sum() - np.concatenate(([0.0], np.cumsum(a)))
    k = np.searchsorted(ratio, ratio, side="left")
    total = (only_a + above_a[k]) / a + (only_b + below_b[k]) / b
    return float((1.0 / total).sum())


def sketches(docs: DataFrame, text: str, keep, bands: int = BANDS, rows: int = ROWS,
             size: int = SHINGLE):
    """(table, name): a struct key (16 bytes), signature and band hashes for each text;
    all NULL for a text without words."""
    name = free_name("sketch_", docs)
    count = bands * rows

    def start():
        import xxhash

        hashes = WordHashes()

        def work(texts):
            lists = [folded_words(t) for t in texts]
            who, code, weight = shingles(lists, hashes, size)
            sig = signatures(who, code, weight, len(lists), count)
            band = band_hashes(sig, rows)
            return [(xxhash.xxh3_128_digest(b" ".join(ws)), sig[i].tobytes(), band[i]) if ws
                    else (None, None, None) for i, ws in enumerate(lists)]
        return work

    ddl = "key binary, signature binary, bands array<bigint>"
    return annotate(docs, text, name, ddl, start, keep=keep), name


def _verify(pairs: DataFrame, texts: DataFrame, threshold: float, size: int) -> DataFrame:
    """The pairs (a, b) whose whole texts are similar. ``texts``: key, text."""
    pairs = stored(pairs.select("a", "b"), "pairs")
    # a leader's text goes once to every share of its members
    shares = (pairs.groupBy("b").count()
              .select("b", F.explode(F.sequence(F.lit(0), F.floor(F.col("count") / LEADER_SHARE).cast("int"))).alias("s"),
                      F.floor(F.col("count") / LEADER_SHARE).cast("int").alias("n")))
    sizes = shares.where("s = 0").select("b", "n")
    salted = pairs.join(sizes, "b").select(
        "a", "b", F.pmod(F.xxhash64("a"), F.col("n") + 1).cast("int").alias("s"))
    left = salted.join(texts.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a")
    right = shares.select("b", "s").join(texts.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b")
    both = left.join(right, ["b", "s"]).select("a", "b", "ta", "tb")

    def run(batches):
        hashes = WordHashes()
        leader, held = None, None

        def sets(t):
            _, code, weight = shingles([folded_words(t)], hashes, size)
            return code, weight

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ta, tb = batch.column(2).cast(pa.binary()), batch.column(3).cast(pa.binary())
            good = []
            for i in range(len(a)):
                if b[i] != leader:
                    leader, held = b[i], sets(tb[i].as_py())
                good.append(probability_jaccard(*sets(ta[i].as_py()), *held) >= threshold - ROUNDING)
            mask = pa.array(good, pa.bool_())
            yield batch.select([0, 1]).filter(mask)

    return both.mapInArrow(run, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """(key, root): the smallest key of each component of the edges (a, b).

    Alternating large-star and small-star contraction until the edges are stars.
    """
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                   .distinct(), "edges")
    state = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        edges = stored(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    roots = edges.groupBy("u").agg(F.min("v").alias("root"))
    tops = edges.select("v").distinct().join(edges.select("u"), F.col("u") == F.col("v"), "left_anti")
    return roots.select(F.col("u").alias("key"), "root").unionByName(tops.select(F.col("v").alias("key"), F.col("v").alias("root")))


def _links(nodes: DataFrame, texts_of, threshold: float, rows: int, leaders: bool, size: int) -> DataFrame:
    """(key, root) of every node that has a link. ``nodes``: key, signature, bands."""
    spread = nodes.select("key", F.posexplode("bands").alias("band", "h"))
    shared = spread.groupBy("band", "h").agg(F.count("*").alias("n")).where("n > 1")
    members = stored(spread.join(shared, ["band", "h"])
                     .select("key", "band", F.xxhash64("band", "h").alias("bucket"), "n"), "members")
    mates = members.groupBy("key").agg(F.sum("n").alias("mates"))
    texts = stored(texts_of(mates.select("key")), "texts")
    members = members.drop("n").join(mates, "key").withColumn("root", F.col("key"))
    links = None
    if leaders:
        order = F.struct((-F.col("mates")).alias("m"), F.xxhash64("bucket", "key").alias("o"), "key")
        first = members.groupBy("bucket").agg(F.min(order).alias("l")).select(
            "bucket", F.col("l.key").alias("b"), F.col("l.m").alias("m"))
        pairs = (members.join(first, "bucket").where(F.col("key") != F.col("b")).groupBy(F.col("key").alias("a"))
                 .agg(F.min_by("b", F.struct("m", F.xxhash64("key", "b"))).alias("b")))
        links = stored(_verify(pairs, texts, threshold, size), "links")
        roots = stored(components(links), "roots")
        members = (members.drop("root").join(roots, "key", "left")
                   .withColumn("root", F.coalesce("root", "key")))
    members = stored(members, "members")
    mixed = (members.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("n"))
             .where("x <> y").select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    rest = members.join(mixed, "bucket").withColumn("block", F.pmod(F.xxhash64("key", F.lit(1)), "blocks").cast("int"))
    body = texts.join(nodes.select("key", "signature"), "key")
    sent = (rest.join(body, "key")
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                    "mates", "key", "root", "band", "block", "signature", "text"))
    met = sent.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", F.desc("mates"), "key")

    def run(batches):
        hashes = WordHashes()
        group, held = None, []
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in range(3)),
                           *(batch.column(c).to_pylist() for c in range(4, 9)), batch.column(9).cast(pa.binary()).to_pylist()):
                if row[:3] != group:
                    out += _meet(group, held, hashes, rows, threshold, size)
                    group, held = row[:3], []
                held.append(row[3:])
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)], names=["a", "b"])
        out = _meet(group, held, hashes, rows, threshold, size)
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.binary()) for k in (0, 1)], names=["a", "b"])

    more = met.mapInArrow(run, "a binary, b binary")
    links = stored(more.distinct() if links is None else links.unionByName(more.distinct()), "links")
    return stored(components(links), "roots")


def band_hashes(sig: np.ndarray, rows: int) -> np.ndarray:
    """The band hashes of signatures, one row a text."""
    band = np.zeros((len(sig), sig.shape[1] // rows), np.uint64)
    for k in range(rows):
        band = mix(band ^ sig[:, k::rows].astype(np.uint64))
    return band.view(np.int64)


def _meet(group, held: list, hashes: WordHashes, rows: int, threshold: float, size: int) -> list:
    """Links between members of two blocks of a bucket that are in different components."""
    if len(held) < 2:
        return []
    _, i, j = group
    keys, roots, bands, blocks, sigs, texts = zip(*held)
    sig = np.stack([np.frombuffer(x, np.uint32) for x in sigs])
    hashed, band = band_hashes(sig, rows), bands[0]
    block = np.array(blocks)
    number: dict = {}
    top = np.array([number.setdefault(r, len(number)) for r in roots])  # the component of each member
    sets: dict[int, tuple] = {}

    def of(k: int) -> tuple:
        if k not in sets:
            _, code, weight = shingles([folded_words(texts[k])], hashes, size)
            plain = set(code.tolist()) if (weight == 1).all() else None
            sets[k] = code, weight, plain
        return sets[k]

    out = []
    for p in range(len(keys) - 1):
        far = top[p + 1:] != top[p]
        if i != j:
            far &= block[p + 1:] != block[p]
        q = np.flatnonzero(far) + p + 1
        if not len(q):
            continue
        q = q[(hashed[q] == hashed[p]).argmax(axis=1) == band]  # met in the first shared band
        agree = (sig[q] == sig[p]).mean(axis=1)  # likely links first: they settle other pairs
        for k in q[np.argsort(-agree, kind="stable")].tolist():
            if top[k] == top[p]:
                continue
            (ca, wa, sa), (cb, wb, sb) = of(p), of(k)
            if sa is not None and sb is not None:  # equal weights: the plain Jaccard similarity
                n = len(sa & sb)
                similar = n >= (threshold - ROUNDING) * (len(sa) + len(sb) - n)
            else:
                similar = probability_jaccard(ca, wa, cb, wb) >= threshold - ROUNDING
            if similar:
                out.append((keys[p], keys[k]))
                top[top == top[k]] = top[p]
    return out


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text",
                    threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS,
                    leaders: bool = True, size: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key, root, class_id): a row for every row of ``docs``.

    ``text_key`` is the 128-bit key of the folded words, ``root`` the smallest key of the
    class (both NULL without words).
    """
    raw, name = sketches(docs, text, [key], bands, rows, size)
    c = F.col(f"`{name}`")
    drawn = stored(raw.select(qcol(key).alias("doc_id"), c["key"].alias("key"),
                              c["signature"].alias("signature"), c["bands"].alias("bands")), "sketches")
    nodes = stored(drawn.where("key is not null").groupBy("key")
                   .agg(F.first("signature").alias("signature"), F.first("bands").alias("bands"),
                        F.min("doc_id").alias("doc_id")), "nodes")

    def texts_of(keys: DataFrame) -> DataFrame:
        """The folded text of one document for each key."""
        wanted = keys.join(nodes.select("key", "doc_id"), "key")
        body = docs.select(qcol(key).alias("id_"), qcol(text).cast("string").alias("text"))
        found = body.join(wanted, body["id_"].eqNullSafe(wanted["doc_id"])).select("key", "text")
        # an id may stand for several texts: keep the one whose words have the key
        return found.mapInArrow(_with_key, "key binary, text string").dropDuplicates(["key"])

    roots = _links(nodes.select("key", "signature", "bands"), texts_of, threshold, rows, leaders, size)
    named = nodes.select("key", "doc_id").join(roots, "key", "left").select(
        "key", F.coalesce("root", "key").alias("root"), "doc_id")
    classes = named.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    by_key = (named.select("key", "root").join(classes, "root")
              .select(F.col("key").alias("text_key"), "root", "class_id"))
    own = drawn.select("doc_id", F.col("key").alias("text_key"))
    with_words = own.where("text_key is not null").join(by_key, "text_key")
    without = own.where("text_key is null").select(
        "doc_id", "text_key", F.lit(None).cast("binary").alias("root"), F.col("doc_id").alias("class_id"))
    return with_words.select(*without.columns).unionByName(without)


def _with_key(batches):
    import xxhash

    for batch in batches:
        keys = batch.column(0).to_pylist()
        texts = batch.column(1).cast(pa.binary()).to_pylist()
        good = [t is not None and xxhash.xxh3_128_digest(b" ".join(folded_words(t))) == k
                for k, t in zip(keys, texts)]
        yield batch.filter(pa.array(good, pa.bool_()))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each class, columns unchanged: the smallest doc_id, then the smallest
    text key; of repeated rows, one. Rows without words all stay."""
    classes = stored(near_duplicates(docs, key, text, **options).where("root is not null"), "classes")
    first = (classes.groupBy("root", "doc_id", "text_key").agg(F.count("*").alias("n"))
             .groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "n")).alias("f"))
             .select(F.col("f.doc_id").alias("id"), F.col("f.text_key").alias("k"), F.col("f.n").alias("n")))
    tag, times, row = (free_name(x, docs) for x in ("key_", "times_", "row_"))

    def start():
        import xxhash

        def work(texts):
            lists = [folded_words(t) for t in texts]
            return [(xxhash.xxh3_128_digest(b" ".join(ws)) if ws else None,) for ws in lists]
        return work

    keyed = annotate(docs, text, tag, "k binary", start)
    of = F.col(f"`{tag}`.k")
    first = first.select(F.col("id").alias(f"{row}id"), F.col("k").alias(f"{row}k"), F.col("n").alias(times))
    found = keyed.join(first, qcol(key).eqNullSafe(F.col(f"{row}id")) & (of == F.col(f"{row}k")), "left")
    columns = [qcol(c) for c in docs.columns]
    single = found.where(of.isNull() | (F.col(times) == 1)).select(*columns)
    repeated = (found.where(F.col(times) > 1).groupBy(qcol(key).alias(f"{row}a"), of.alias(f"{row}b"))
                .agg(F.first(F.struct(*columns)).alias(row)).select(F.col(f"{row}.*")))
    return single.unionByName(repeated)
