import random
import re

from staylens.llm import decontaminate as D

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, window):
    """(words, hit words, ids of the items with an occurring window)."""
    ws, hit, ids = words(text), set(), set()
    for name, item in items:
        iw = words(item)
        k = min(window, len(iw))
        for p in range(len(iw) - k + 1 if iw else 0):
            for q in range(len(ws) - k + 1):
                if ws[q:q + k] == iw[p:p + k]:
                    hit |= set(range(q, q + k))
                    ids.add(str(name))
    return len(ws), len(hit), sorted(ids)


def compare(spark, texts, items, window=3, **options):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    out, c = D.contamination(docs, bench, window=window, **options)
    for r in out.collect():
        n, h, ids = brute(r["text"], items, window)
        v = r[c]
        assert (v["n_words"], v["n_hit"], v["items"], v["contaminated"]) == (n, h, ids, h > 0 and 20 * h >= n), r["text"]


def test_random(spark):
    rng = random.Random(7)
    for window in (1, 2, 3, 4):
        items = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randrange(8)))) for i in range(8)]
        texts = ["-".join(rng.choice("ABcde") for _ in range(rng.randrange(25))) for _ in range(60)]
        compare(spark, texts, items, window)
        compare(spark, texts, items, window, max_block_words=6)  # several blocks agree


def test_defined_cases(spark):
    items = [(1, None), (2, ""), (3, "Größe, ONE two"), (10, "one two three four"), (4, "one two three four"), (5, "solo")]
    texts = [None, "", "größe one two", "GRÖSSE one two", "x one-two;three four", "solo", "é" * 50_000 + " one two three", "one two three four"]
    compare(spark, texts, items)
    compare(spark, texts, [], 3)


def test_rows_and_columns(spark, docs_of):
    docs = docs_of(["one two three four", "clean text here", (1, "clean text here"), None, (None, "one two three four")], extra=["items", "hit_", "bench_"])
    bench = spark.createDataFrame([(1, "one two three four")], "item_id bigint, text string")
    kept = D.clean_documents(docs, bench, window=3)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "1", "3"]
    assert D.clean_documents(docs.where("false"), bench).count() == 0


def test_remove_spans(spark, docs_of):
    docs = docs_of(["Start: One two, three four! end " + "w " * 200, "one two three", "nothing", None])
    bench = spark.createDataFrame([(1, "one two three four five")], "item_id bigint, text string")
    out = {r["doc_id"]: r["text"] for r in D.remove_spans(docs, bench, window=3, max_words=3, max_share=0.5).collect()}
    assert out[0].startswith("Start: ! end w") and out[1] == "" and out[2] == "nothing" and out[3] is None


def test_longest_match():
    machine = D.SuffixAutomaton([("a", [b"x", b"y", b"z", b"x", b"y"]), ("b", [b"y", b"z", b"q"])], window=2)
    assert machine.match([b"y", b"z", b"x", b"n", b"z", b"q"])[2] == 3
    assert machine.match([]) == ([], set(), 0)
