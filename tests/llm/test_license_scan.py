import random

from staylens.llm import license_scan as L


def test_align_is_a_common_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        a = [rng.choice("abcdef") for _ in range(rng.randrange(12))]
        b = [rng.choice("abcdef") for _ in range(rng.randrange(8))]
        pairs = L.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))


def test_align_whole_and_unique():
    b = "the quick brown fox jumps over the lazy dog".split()
    a = "zz the quick red fox jumps over the very lazy dog the".split()
    assert [b[j] for _, j in L.align(a, b)] == "the quick fox jumps over the lazy dog".split()


def test_every_template_is_found():
    scanner = L.Scanner()
    for name, text in L.TEMPLATES.items():
        filler = "lorem ipsum the of and this is work " * 20
        words = L.folded_words(f"{filler}. {text}. {text}. {filler}".encode())
        finds = scanner.find(words)
        assert [f[0] for f in finds] == [name, name], (name, finds)
        assert all(f[1] == 1.0 for f in finds)


def test_near_but_not_a_license():
    scanner = L.Scanner()
    assert scanner.find(L.folded_words(b"released under the old oak tree at noon")) == []
    assert scanner.find([]) == []
    got = scanner.find(L.folded_words(b"This work is licensed under the GNU General Public License, version 4"))
    assert {f[0] for f in got} <= {"gpl-2.0", "gpl-3.0"} and len(got) == 1  # 11 of 12 words


def test_scan_rows(docs_of):
    mit = L.TEMPLATES["mit"]
    docs = docs_of([None, "", f"é {mit}. more", f"x {mit}!\n{L.TEMPLATES['apache-2.0']}.", (9, mit), (9, mit)],
                   extra=["licenses", "best"])
    out, c = L.scan(docs)
    rows = {r["doc_id"]: r[c] for r in out.collect()}
    assert rows[0]["n_licenses"] == rows[1]["n_licenses"] == 0 and rows[0]["best"] is None
    assert rows[2]["finds"][0]["start"] == 2 and rows[2]["finds"][0]["end"] == 2 + len(mit)
    assert rows[3]["licenses"] == "apache-2.0,mit" and rows[9]["best"] == "mit"
    assert out.count() == 6 and L.scan(docs.where("false"))[0].count() == 0
