import collections
import functools
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickloom.llm import _bytes, _components, embedding_dedup, jaccard_join, suffix_dedup, toxicity

DOCS = "doc_id long, text string, gram string, id int"


def _docs(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS).repartition(parts)


def _corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé日", k=rng.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, rows = text(60), []
    for i in range(60):
        t = text(rng.randint(0, 80))
        if i % 3 == 0:
            t += passage[rng.randint(0, 40) :] + text(5)
        if i % 7 == 0 and rows:
            b = rows[rng.randrange(len(rows))][1]
            k = rng.randint(0, max(0, len(b) - 1))
            t = b[:k] + word() + b[k + rng.randint(0, 3) :]
        rows.append((i, t))
    rows += [(60, rows[3][1]), (61, rows[3][1]), (62, ""), (63, None), (64, "ab" * 400), (65, "z" * 3000), (66, "z" * 150), (67, passage + passage), (68, "É" * 99), (69, "a b c"), (70, "A  b\tc"), (71, " \n")]
    rng.shuffle(rows)
    return rows


def _repeats(rows, length):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        cover = np.zeros(len(b) + 1, int)
        for p in range(len(b) - length + 1):
            if (x := b[p : p + length]) in seen:
                cover[p] += 1
                cover[p + length] -= 1
            seen.add(x)
        gone = np.cumsum(cover)[: len(b)] > 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out[i] = (len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("seed", "length"), [(1, 100), (2, 40), (3, 33)])
def test_repeats_against_brute_force(spark, seed, length):
    rows = _corpus(seed)
    got = suffix_dedup.remove_repeats(_docs(spark, rows), length).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == _repeats(rows, length)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


def test_repeats_across_chunks_ties_and_nothing(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 512)
    rng = np.random.default_rng(5)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    offsets = np.array([0, 1700, 1750, 5000])
    text, s, e, a, gram, stretch = suffix_dedup.elected(data, offsets, 100)
    size = np.diff(offsets)
    seen = np.concatenate([offsets[t] + np.arange(p, q + 1) for t, p, q in zip(text, s, e)])
    assert sorted(seen) == [p for t in range(3) for p in range(offsets[t], offsets[t + 1] - 99)]
    assert ((s <= a) & (e <= a) & (a <= s + 68) & (a <= size[text] - 32)).all()
    rows = [(1, "q" * 200), (1, "q" * 200), (None, "w" * 120)]
    got = sorted((r.doc_id or 0, r.n_removed) for r in suffix_dedup.remove_repeats(_docs(spark, rows)).collect())
    assert got == [(0, 119), (1, 199), (1, 199)]  # the first string of a run of one letter stays uncovered at its first byte
    assert suffix_dedup.remove_repeats(_docs(spark, rows).limit(0)).count() == 0


def test_deep_shallow_sorts():
    rng = random.Random(9)
    for shallow in (8, 16):
        base = [bytes(rng.choices(b"ab\0", k=rng.randint(0, 40))) for _ in range(40)]
        strings = base + [x[: rng.randint(0, 40)] + bytes(rng.choices(b"ab", k=2)) for x in base] + base[:7] + [b"a" * 38] * 3
        strings = [x[:40] for x in strings]
        group = np.array([k % 3 for k in range(len(strings))])
        m = np.array([list(x.ljust(40, b"\0")) for x in strings], np.uint8)
        size = np.array([len(x) for x in strings])
        order, lcp = suffix_dedup.deep_shallow(m, size, group, shallow)
        got = [(group[k], strings[k].ljust(40, b"\0")) for k in order]
        assert got == sorted(got)
        for k in range(1, len(order)):
            x, y = strings[order[k - 1]], strings[order[k]]
            common = next((j for j in range(min(len(x), len(y))) if x[j] != y[j]), min(len(x), len(y)))
            assert lcp[k] == (common if group[order[k]] == group[order[k - 1]] else -1)


def _sets(rows, size):
    sets = {}
    for i, t in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", low) if x]
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    return sets


@functools.cache
def _linked(rows, size):
    sets = _sets(rows, size)
    pairs = ((p, q, len(sets[p] & sets[q])) for p in sets for q in sets if p < q)
    return [(p, q) for p, q, both in pairs if both and 100 * both >= 80 * len(sets[p] | sets[q])]


def _neighbours(rows, size=5):
    out = {i: set() for i, _ in rows}
    for p, q in _linked(tuple(rows), size):
        out[p].add(q)
        out[q].add(p)
    return out


def _links(rows, size=5):
    sets = _sets(rows, size)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for p, q in _linked(tuple(rows), size):
        x, y = find(p), find(q)
        root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("seed", [1, 2])
def test_links_against_brute_force(spark, seed):
    rng, rows = random.Random(seed), _corpus(seed)
    base = [f"w{k}" for k in range(120)]
    for i in range(100, 160):  # near copies around the threshold, in chains
        for _ in range(rng.randint(0, 3)):
            base[rng.randrange(120)] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(base)))
    got = jaccard_join.link_documents(_docs(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == _links(rows)


@pytest.mark.parametrize("run", [12, 1])
def test_all_links_are_counted(spark, monkeypatch, run):
    monkeypatch.setattr(jaccard_join, "RUN", run)  # 1: lists and groups of comparisons are cut into runs of a few sets
    rng, rows = random.Random(8), _corpus(3)
    for i in range(100, 150):
        base = [f"w{k}" for k in range(100)]
        for _ in range(i % 4):
            base[rng.randrange(100)] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(base)))
    got = {r.doc_id: r.n_links for r in jaccard_join.link_counts(_docs(spark, rows)).collect()}
    assert got == {i: len(_neighbours(rows)[i]) for i, _ in rows} and max(got.values()) > 20
    assert jaccard_join.link_counts(_docs(spark, rows).limit(0)).count() == 0


def test_links_of_nothing(spark):
    assert jaccard_join.link_documents(_docs(spark, [(1, "a")]).limit(0)).count() == 0
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (None, None), (2, "A b c d e F")]
    got = sorted(((r.doc_id or 0), r.n_shingles, r.component_id) for r in jaccard_join.link_documents(_docs(spark, rows)).collect() if r.n_shingles)
    assert got == [(0, 2, 2), (2, 2, 2), (5, 2, 2), (5, 2, 2)]


def test_components_of_paths_and_stars(spark):
    rng = random.Random(1)
    path = list(range(100, 164))
    rng.shuffle(path)
    pairs = list(zip(path, path[1:])) + [(1, k) for k in range(2, 60)] + [(7, 7), (None, 3)] + [(200, 201)] * 3
    got = {r.node: r.root for r in _components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: 100 for k in path} | {k: 1 for k in range(1, 60)} | {200: 200, 201: 200}


def _vectors(seed, n=400, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, dim))
    x = centres[rng.integers(0, 20, n)] + rng.normal(size=(n, dim)) * rng.choice([0.02, 0.1, 0.4], n)[:, None]
    x[50:60] = x[50]
    x[60] = x[50] * 3
    rows = [(i, [float(v) for v in x[i].astype(np.float32)], int(rng.integers(0, 3))) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [0.0] * dim, 1), (n + 2, [float("nan")] * dim, 1), (n + 3, rows[50][1], None), (n + 4, [1.0, 2.0], 1), (n + 5, [None] + [1.0] * (dim - 1), 1), (n + 6, rows[0][1], rows[0][2])]
    return rows


@pytest.mark.parametrize("hot", [4096, 3])
def test_vectors_against_brute_force(spark, hot):
    rows = _vectors(3)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("cell", F.lit("clash"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.link_vectors(df, codes=8, hot_cell=hot).collect()}
    good = [(i, np.array(v, float), c) for i, v, c in rows if c is not None and v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    root, links = {i: i for i, *_ in rows}, collections.Counter()

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for p, x, c in good:
        for q, y, d in good:
            if p < q and c == d and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                links[p] += 1
                links[q] += 1
                a, b = find(p), find(q)
                root[max(a, b)] = min(a, b)
    assert sum(links.values()) > 500
    assert got == {i: (links[i], find(i), find(i) == i) for i, *_ in rows}


def test_traversal_visits_cells_by_growing_bound():
    rng = np.random.default_rng(2)
    a, b = rng.random(9), rng.random(7)
    seen = list(embedding_dedup.multi_sequence(a, b, 0.9))
    assert [s for *_, s in seen] == sorted(s for *_, s in seen)
    assert {(i, j) for i, j, _ in seen} == {(i, j) for i in range(9) for j in range(7) if a[i] + b[j] <= 0.9}
    x, c = rng.normal(size=(300, 6)), rng.normal(size=(10, 6))
    home, bound = embedding_dedup.half_bounds(x, c)
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    assert (bound[:, home] <= d + 1e-9).all()


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embedding_dedup.link_vectors(df).count() == 0
    one = spark.createDataFrame([(4, None, 1)], "vec_id long, embedding array<float>, label int")
    assert [tuple(r) for r in embedding_dedup.link_vectors(one).collect()] == [(4, 0, 4, True)]


def test_toxic_texts_are_told_apart(spark):
    rng = random.Random(4)
    common, bad = [f"word{k}" for k in range(400)], ["vile", "scum", "rotter"]
    rows, labels = [], []
    for i in range(1200):
        w = rng.choices(common, k=rng.randint(20, 300)) + [f"rare{rng.randrange(10**6)}" for _ in range(10)]
        toxic = i % 8 == 0
        if toxic:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(bad).title() + ",")
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    rows += [(5000, None), (5001, ""), (5002, "!!! 123"), (None, "word1")]
    docs = _docs(spark, rows)
    table = spark.createDataFrame(labels[:800] + [(3, None), (None, 1), (8, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, table)
    got = {r.doc_id: r.toxicity for r in toxicity.score(docs, model).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    new = [i for i in range(800, 1200)]
    assert np.mean([(got[i] >= 0.3) == (i % 8 == 0) for i in new]) > 0.97
    assert max(got[5000], got[5001], got[5002]) < 0.3
    other = table.withColumn("toxic", F.when(F.expr("pmod(crc32(cast(cast(doc_id as string) as binary)), 4) = 2"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    same = toxicity.train(docs, other)
    assert np.allclose(same.word, model.word) and np.allclose(same.weights, model.weights)


def test_toxicity_without_a_class(spark):
    docs = _docs(spark, [(1, "a"), (2, "b")])
    none = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    assert {r.toxicity for r in toxicity.score(docs, toxicity.train(docs, none)).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), none.limit(0))).count() == 0


@pytest.mark.parametrize("hot", [4096, 16])
def test_visits_to_a_target_recall_reach_it(spark, hot):
    rng = np.random.default_rng(9)
    near = lambda c, s: c + rng.normal(size=c.shape) * s * np.linalg.norm(c) / 32**0.5
    x = np.array([v for c in rng.normal(size=(40, 32)) for v in [c, *(near(c, 0.13) for _ in range(11))]])
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    want = (u @ u.T >= 0.98).sum(1) - 1
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").repartition(3)
    got = {r.vec_id: r.n_links for r in embedding_dedup.link_vectors(df, codes=16, hot_cell=hot).collect()}
    found = np.array([got[i] for i in range(len(x))])
    assert want.sum() > 1000 and (found <= want).all() and found.sum() >= 0.98 * want.sum()


def test_rare_expressions_keep_damped_influence_at_every_size(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices([f"word{k}" for k in range(50)], k=20))) for i in range(2400)]
    for i, slurs in ((0, "scum vile"), (8, "scum"), (16, "vile"), (24, "vile")):
        rows[i] = (i, f"{rows[i][1]} {slurs}")
    docs = _docs(spark, rows)
    for n in (600, 2400):
        table = spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(n)], "doc_id long, toxic int")
        model = toxicity.train(docs, table, held_out=None)
        scum, vile, unknown = model.features(pa.array(["scum", "vile", "nothing"]))[:, 0]
        assert 0 == unknown < scum < vile


def test_either_sides_visit_counts_where_homes_are_low_numbered(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1, 8)) + rng.normal(size=(300, 8)) * np.repeat([0.09, 0.25], 4)
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    # all first halves are at home at the first centre; the others lie around them and are only visited
    half, away = u[:, :4], np.random.default_rng(7).normal(size=(15, 4))
    wide = 2.04 * np.linalg.norm(half - half.mean(0), axis=1).max()
    books = [half.mean(0) + np.r_[np.zeros((1, 4)), away / np.linalg.norm(away, axis=1)[:, None] * wide], u[:16, 4:]]
    turn, limit = iter(books), 0.01
    monkeypatch.setattr(embedding_dedup, "codebook", lambda *a: next(turn))
    monkeypatch.setattr(embedding_dedup, "reach", lambda *a: limit)
    home, b1, b2 = embedding_dedup._cells(u, books)
    visits = np.zeros((300, 256), bool)
    for k in range(300):
        visits[k, [home[k], *(i * 16 + j for i, j, _ in embedding_dedup.multi_sequence(b1[k], b2[k], limit))]] = True
    meets = visits[:, home]
    near = (u @ u.T >= 0.98) & (meets | meets.T) & ~np.eye(300, dtype=bool)
    assert home.max() < 16 and visits[:, 16:].any() and (near & ~meets).sum() > 20
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").repartition(3)
    got = {r.vec_id: r.n_links for r in embedding_dedup.link_vectors(df, codes=16).collect()}
    assert [got[i] for i in range(300)] == near.sum(1).tolist()


def test_backoff_counts_distinct_words_before_a_word(spark):
    rows = [(i, f"common san scum other{i % 40} vile" if i % 8 == 0 else f"common san other{i % 40}") for i in range(400)]
    rows += [(1000, "Vile, san san"), (1001, "vile"), (1002, None), (1003, "")]
    docs = _docs(spark, rows)
    before = collections.defaultdict(set)
    for _, t in rows:
        w = re.findall(r"[a-z]+", (t or "").lower())
        for a, b in zip([None, *w], w):
            before[b].add(a)
    hashed = {w: int(_bytes.words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0][0]) for w in before}
    order = sorted(before, key=hashed.get)
    some = order[::2]  # words outside the vocabulary still come before others
    got = toxicity.continuations(docs, np.array([hashed[w] for w in some], np.uint64))
    assert got.tolist() == [len(before[w]) for w in some]
    many = [(2000 + i, f"{c * 3} vile") for i, c in enumerate("abcdefghijklmnop")]  # unlabelled texts count too
    table = spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(400)], "doc_id long, toxic int").where("doc_id < 390")
    model = toxicity.train(docs.union(_docs(spark, many)), table, held_out=None)
    few, more = model.features(pa.array(["scum", "vile"]))[:, 0]
    assert few > more > 0


def test_class_models_against_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices("abcdefghij", k=rng.randint(0, 12)) + ["vile"] * (i % 4 == 0))) for i in range(120)]
    rows += [(200, None), (201, "")]
    docs, labels = _docs(spark, rows), {i: int(i % 4 == 0) for i in range(90)}
    model = toxicity.train(docs, spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"), held_out=None)
    pairs = {i: set(zip([None, *(t or "").split()], (t or "").split())) for i, t in rows}
    words = sorted({w for i in labels for _, w in pairs[i]}, key=lambda w: int(_bytes.words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0][0]))
    at, d = {w: k for k, w in enumerate(words)} | {None: len(words)}, toxicity.DISCOUNT
    every = {p for x in pairs.values() for p in x}
    shared = {w: (sum(b == w for _, b in every) + 1) / (sum(b in at for _, b in every) + len(words) + 1) for w in words}
    for c in (0, 1):
        n = collections.Counter(p for i, y in labels.items() if y == c for p in pairs[i])
        types = collections.Counter(w for _, w in n)
        free = d * len(types) / sum(types.values())
        word = {w: max(types[w] - d, 0) / sum(types.values()) + free * shared[w] for w in words}
        unknown = free * (1 - sum(shared.values()))
        assert sum(word.values()) + unknown == pytest.approx(1)
        for v in at:
            after = {w: n[v, w] for w in words if n[v, w]}
            total = sum(after.values())
            left = sum(1 if k == 1 else d for k in after.values()) / total if total else 1
            want = [(max(after.get(w, 0) - d, 0) if after.get(w, 0) > 1 else 0) / max(total, 1) + left * word[w] for w in words]
            assert sum(want) + left * unknown == pytest.approx(1)
            got = model.classes[c].pair(np.array([after.get(w, 0) for w in words]), np.full(len(words), at[v]), np.arange(len(words)))
            assert np.allclose(got, want)


@pytest.mark.parametrize("runs", [[], [[0]], [[0, 1, 127, 128, 16384, 2**40, 2**62]], [[5, 6], [0], [300, 2**33]]])
def test_codes_are_packed_whole(runs):
    codes = np.array([c for r in runs for c in r], np.int64)
    cut = np.cumsum([0, *map(len, runs)])[:-1] if runs else np.zeros(0, np.int64)
    got = toxicity._packed(codes, cut)
    assert [toxicity._unpacked(b.as_buffer()).tolist() for b in got] == runs


def test_vectors_of_each_length_are_linked_as_they_are(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 1e-9], 1), (3, [1.0, 0.0, 0.0], 1), (4, [5.0, 0.1, 0.0], 1), (5, [3.0], 1), (6, [0.5], 1), (7, [-1.0], 1), (8, [], 1), (9, [1e300, 1e300], 2), (10, [1e300, 1e300], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.link_vectors(df, recall=1).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3), 5: (1, 5), 6: (1, 5), 7: (0, 7), 8: (0, 8), 9: (1, 9), 10: (1, 9)}


def test_places_for_other_words_grow_with_the_texts():
    bits = [toxicity.other_bits(n) for n in (0, 10**6, 10**9, 10**12, 10**14)]
    assert bits == sorted(bits) and bits[:2] == [24, 24] and bits[3] >= 30 and bits[4] > bits[3]


def test_repeats_are_found_next_to_suffixes_whose_strings_are_partly_settled():
    """A row of which a batch settles most strings must not part rows of other batches by the bytes of those strings."""
    import pyarrow as pa

    from tickloom.llm import suffix_dedup

    gram, y, one, two = "g" * 32, "x" * 12, "p" * 68, "q" * 68
    left = {c: f"{c}" * 56 + y for c in "abc"}
    texts = {1: left["b"] + gram + one, 2: left["b"] + gram + one[:-10] + "r" * 10, 3: left["a"] + gram + two, 4: left["c"] + gram + two}
    kind = pa.list_(pa.struct([("gram", pa.int64()), ("at", pa.int32()), ("lead", pa.int16()), ("tail", pa.int16())]))
    entries = []
    for ids in ([1, 2], [3], [4]):
        batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array([texts[i] for i in ids]), pa.array([[{"gram": 5, "at": 68, "lead": 68, "tail": 0}]] * len(ids), kind)], ["id", "text", "open"])
        entries += suffix_dedup._surroundings(100)(iter([batch]))
    sorted_ = pa.Table.from_batches(entries).sort_by([("gram", "ascending"), ("id", "ascending"), ("at", "ascending")]).combine_chunks()
    spans = [tuple(r.values()) for b in suffix_dedup._settle(100)(iter(sorted_.to_batches())) for r in b.to_pylist()]
    assert sorted(spans) == [(2, 0, 158), (4, 56, 168)]
