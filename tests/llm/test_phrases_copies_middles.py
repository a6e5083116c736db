import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tickloom.llm import collocations, exact_dedup, fill_middle

DOCS = "doc_id long, text string, lang string, phrase string, copy string, n int"


def _docs(spark, texts):
    return spark.createDataFrame([(i, t, l, "x", "y", 1) for i, (t, l) in enumerate(texts)], DOCS)


def _lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def _collocations(texts, longest=3, least=10, inside=50, top=2000):
    f, n = collections.Counter(), collections.Counter()
    for t, lang in texts:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", _lower(t or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    found = collections.defaultdict(list)
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    for (lang, p), a in candidates.items():
        score, k = min((1000000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        longer = [b for (o, q), b in candidates.items() if o == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if not any(100 * b >= inside * a for b in longer):
            found[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return {(lang, r, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for lang, v in found.items() for r, x in enumerate(sorted(v)[:top], 1)}


TEXTS = [
    (None, "en"), ("", "en"), (" \t\r\n", None), ("a b c" * 40, "en"), ("Ab ab. AB, ab; É é\x01x\x1fy z\xa0z " * 30, None), ("one\ttwo  three " * 200, "de"),
    ("x. y! z? " * 20, ""), ("the same line again\n" * 25, "en"), ("Dz" * 5000 + " q r" * 12, "en"), (".,;", "fr"), ("und und und\x0bund " * 15, "und"),
]


@pytest.mark.parametrize("longest, trigger", [(3, 16), (4, 2)])
def test_collocations_equal_brute_force(spark, longest, trigger):
    rng = random.Random(longest)
    words = ["alpha", "Beta", "of", "the", "Gamma", "delta.", "ε", "x"]
    texts = TEXTS + [(" ".join(rng.choices(words, [1, 1, 5, 5, 1, 1, 1, 1], k=rng.randint(0, 60))), rng.choice(["en", "de", None])) for _ in range(150)] * 2
    got = [tuple(r) for r in collocations.collocations(_docs(spark, texts), longest, trigger=trigger).collect()]
    assert len(got) == len(set(got)) and set(got) == _collocations(texts, longest)
    assert any(len(r[2].split(" ")) == longest for r in got)


def test_collocations_keep_the_best_by_lang_and_know_empty_tables(spark):
    rng = random.Random(9)
    texts = [(" ".join(rng.choices("abcdefghij", k=400)), "en") for _ in range(20)] + TEXTS[:3]
    got = {tuple(r) for r in collocations.collocations(_docs(spark, texts), top=7).collect()}
    assert got == _collocations(texts, top=7) and len(got) == 7
    assert collocations.collocations(_docs(spark, TEXTS[:3])).count() == 0


def test_parse_tells_passages_by_content_and_owns_each_word_once(spark):
    passage = " ".join(f"w{k}" for k in range(400))
    texts = [(f"head {k} {passage} tail {k}", "en") for k in range(20)]
    rows = collocations.parse(_docs(spark, texts)).collect()
    assert sum(r.own * r.f for r in rows) == 20 * 404
    assert sum(r.own for r in rows if r.f == 20) > 300
    assert max(r.f for r in rows) == 20 and sum(r.own for r in rows) < 20 * 404 / 4


def test_long_texts_are_cut_between_pieces(spark, monkeypatch):
    texts = [(" ".join(f"k{i % 7}{',' if i % 11 == 0 else ''}" for i in range(3000)), "en")]
    monkeypatch.setattr(collocations, "SLICE", 500)
    assert sum(hi - lo for lo, hi in collocations._segments(collocations.np.frombuffer(texts[0][0].encode(), "u1"))) == len(texts[0][0])
    rows = [b for b in collocations._parse(3, 16)(iter([collocations.pa.RecordBatch.from_pylist([{"text": texts[0][0], "lang": "en"}])]))]
    assert len(rows) > 10 and sum(sum(b["own"].to_pylist()) for b in rows) == 3000


BLANKS = "[\x20\x09-\x0d]"


def _owners(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        t = t or ""
        groups[re.sub(BLANKS, "", t)].append((-len(t), i is None, i or 0, i))
    out = []
    for key, g in groups.items():
        g.sort()
        for k, x in enumerate(g):
            out.append((x[3], g[0][3], len(g), k == 0, hashlib.sha256(key.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("budget", [1 << 26, 2000])
def test_owners_equal_brute_force(spark, budget):
    rng = random.Random(budget)
    rows = [(i, rng.choice(["", " ", "a b", "ab", "a\tb ", "abc", "a" * 50, "É\x0bé", "Éé", "\xa0a", "a\x1cb"]) * rng.randint(1, 3) if i % 5 else None) for i in range(300)]
    rows += [(None, "ab"), (None, "only"), (7, "ab"), (7, "ab"), (1000, "ab" + " " * 100), (1001, "ab" + " " * 100), (1002, "z" * 300000), (1003, "z" * 300000 + "\n")]
    rows += [(2000 + i, "common prefix " * 9 + str(i % 40)) for i in range(120)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, copy string, row int").repartition(3)
    got = sorted((tuple(r) for r in exact_dedup.owners(docs, budget).collect()), key=str)
    assert got == _owners(rows)
    kept = exact_dedup.drop_copies(docs.where("doc_id is not null and doc_id <> 7"), budget).count()
    assert kept == len(_owners([r for r in rows if r[0] not in (None, 7)])) - sum(not x[3] for x in _owners([r for r in rows if r[0] not in (None, 7)]))


def test_owners_of_an_empty_table(spark):
    assert exact_dedup.owners(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_tries_hold_all_strings_and_spill_whole_subtrees():
    rng = random.Random(5)
    keys = {bytes(rng.choices(b"ab\x00\xff", k=rng.randint(0, 9))) for _ in range(400)} | {b"", b"x" * 1000, b"x" * 999}
    trie = exact_dedup.Trie()
    for k in list(keys) * 2:
        node = trie.find(k)
        node.end = (node.end or 0) + 1
    assert list(trie.all()) == [(k, 2) for k in sorted(keys)]
    assert trie.size == sum(trie.weights.values())
    heavy = max(trie.weights, key=lambda k: trie.weights[k])
    spilled = [k for k, _ in trie.spill()]
    assert spilled == sorted(k for k in keys if k[:1] == bytes([heavy]))
    assert [k for k, _ in trie.all()] == sorted(keys - set(spilled))
    while trie.weights:
        list(trie.spill())
    assert trie.size == 0 and [k for k, _ in trie.all()] == [b""]


def test_equal_hashes_do_not_make_texts_equal():
    rows = {"length": [3, 3, 3], "hash": [b"h"] * 3, "bytes": [b"abc", b"abd", b"abc"], "copy": [1, 2, 3], "points": [3, 3, 4], "best": [1, 2, 3], "best_row": [1, 2, 3], "n": [1, 1, 1], "digest": ["c", "d", "c"]}
    b = exact_dedup.pa.RecordBatch.from_pydict(rows)
    got = sorted(tuple(r.values()) for out in exact_dedup._own(iter([b.slice(0, 1), b.slice(1)])) for r in out.to_pylist())
    assert got == [(1, 3, 3, 2, "c"), (2, 2, 2, 1, "d"), (3, 3, 3, 2, "c")]


UNITS = re.compile(r"[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")


def _middles(i, t):
    t = t or ""
    u = UNITS.findall(t)
    h = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    lo, hi = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
    if not t or re.search("<[PSM]>", t) or h3 % 100 >= 50:
        return (i, t, "plain", len(u), None, None, None)
    p, m, s = ("".join(x) for x in (u[:lo], u[lo:hi], u[hi:]))
    return (i, f"<S>{s}<P>{p}<M>{m}", "spm", len(u), p, m, s) if h4 % 100 < 80 else (i, f"<P>{p}<S>{s}<M>{m}", "psm", len(u), p, m, s)


def test_middles_equal_brute_force_and_come_back(spark):
    rng = random.Random(6)
    texts = [None, "", " ", "a", " a ", "a\n\n", "<P>", "x <M> y", "< P > <P", "<S", "é\x01 ü\x1f\x7f\x85\xa0 z", "\r\n\t x", "日本 語" * 9, "word " * 40000, "\\1 $1 \\0", "ÿ ÿ"]
    texts += ["".join(rng.choices(["a", "bc", " ", "\n", "\x0b", "<", ">", "P", "S", "é"], k=rng.randint(0, 40))) for _ in range(400)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "some text here"), (3, "a"), (3, "a other")]
    docs = spark.createDataFrame([(i, t, "k", 5) for i, t in rows], "doc_id long, text string, lang string, n int")
    made = fill_middle.rearrange(docs, carry=("lang",)).cache()
    got = made.collect()
    assert sorted((tuple(r)[:7] for r in got), key=str) == sorted((_middles(i, t) for i, t in rows), key=str)
    assert {r.lang for r in got} == {"k"} and {r.form for r in got} == {"plain", "psm", "spm"}
    back = fill_middle.restore(made.select("doc_id", "form", "output")).select("doc_id", "text").collect()
    assert sorted((tuple(r) for r in back), key=str) == sorted(((i, t or "") for i, t in rows), key=str)
    assert fill_middle.restore(fill_middle.rearrange(docs.limit(0))).count() == 0


def test_rates_and_seeds_of_middles(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("a b c d e f").alias("text"))
    forms = lambda **k: {r.form: r["count"] for r in fill_middle.rearrange(docs, **k).groupBy("form").count().collect()}
    assert forms(rate=0) == {"plain": 2000} and forms(rate=100, spm=0) == {"psm": 2000}
    some = forms(rate=50, spm=80)
    assert 900 < some["plain"] < 1100 and 700 < some["spm"] < 900 and forms(seed=7) != some


def test_packed_keys_come_back():
    rng = collocations.np.random.default_rng(1)
    for n, top in ((0, 1), (1, 1 << 62), (5000, 1 << 39), (300, 1 << 62)):
        k = collocations.np.unique(rng.integers(0, top, n))
        f = rng.integers(1, 1 << 40, len(k)) if n == 300 else rng.integers(1, 9, len(k))
        a, b = collocations._unpack(collocations._pack(k, f))
        assert a.tolist() == k.tolist() and b.tolist() == f.tolist()
