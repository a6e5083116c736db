"""Every stage of the corpus pipeline against a brute-force version, on nulls, empty and long texts, ties and repeated rows."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from test_dedup_links_toxicity import _links, _repeats

import corpus_pipeline
from tickloom.llm import toxicity

KIND = "doc_id long, text string, lang string, source string, n_chars long, score double, label int"


def _frame(spark, rows, parts=3):
    """Documents with two more columns, whose names clash with nothing that may be dropped."""
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, f"s{(i or 0) % 3}", len(t or ""), 0.5, 1) for i, t in rows], KIND).repartition(parts)


def _texts(seed=3, n=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgé日", k=rng.randint(2, 8)))
    passage = " ".join(word() for _ in range(60))
    rows = []
    for i in range(n):
        t = " ".join(word() for _ in range(rng.randint(0, 120)))
        if i % 4 == 0:
            t = f"{t}� {passage} {word()}\nshared line\n{word()}"
        if i % 3 == 0:
            t += "\n  Shared LINE \n\n" + word()
        rows.append((i, t))
    rows += [(100, rows[4][1] + " more"), (101, rows[4][1]), (102, rows[4][1]), (103, ""), (104, None), (105, "日" * 4000), (106, " \n\t"), (107, "tiny text")]
    rng.shuffle(rows)
    return rows


def _row(r):
    return (r.doc_id, r.text, r.lang, r.source, r.n_chars)


def _carried(i):
    return ("en" if (i or 0) % 2 else None, f"s{(i or 0) % 3}")


@pytest.fixture
def labels_dir(spark, tmp_path):
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_toxic_documents_go_and_others_stay(spark, tmp_path):
    rng = random.Random(2)
    rows, label = [], {}
    for i in range(600):
        w = rng.choices([f"word{k}" for k in range(300)], k=rng.randint(20, 200))
        if i % 6 == 0:
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(["vile", "scum", "rotter"]))
        rows.append((i, " ".join(w)))
        label[i] = int(i % 6 == 0)
    rows += [(900, None), (901, ""), (902, rows[1][1]), (903, rows[1][1]), (904, rows[6][1])]
    spark.createDataFrame([(i, 1, y) for i, y in label.items()], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = _frame(spark, rows)
    got = {r.doc_id: _row(r) for r in corpus_pipeline.reject_toxic(spark, docs, str(tmp_path)).collect()}
    model = toxicity.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    import pyarrow as pa

    want = {i for (i, _), s in zip(rows, model.score(pa.array([t for _, t in rows], pa.string()))) if s < 0.3}
    assert set(got) == want and {900, 901, 902, 903} <= want and 904 not in want
    held_out = [i for i in label if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(i not in want) == bool(label[i]) for i in held_out]) > 0.97
    assert all(v == (i, dict(rows)[i], *_carried(i), len(dict(rows)[i] or "")) for i, v in got.items())
    assert corpus_pipeline.reject_toxic(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_frequent_lines_go(spark, labels_dir):
    rows = _texts()
    key = lambda x: x.strip(" \t\n\v\f\r").translate({c: c + 32 for c in range(65, 91)})
    found = collections.Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    hot = {k for k, n in found.items() if n >= 10}
    assert hot == {"shared line"}
    want = sorted((i, k, *_carried(i), len(k)) for i, t in rows for k in ["\n".join(x for x in (t or "").split("\n") if key(x) not in hot)])
    assert sorted(map(_row, corpus_pipeline.drop_lines(spark, _frame(spark, rows), labels_dir).collect()), key=lambda r: r[:2]) == want


def test_one_of_each_near_duplicate_group_stays(spark, labels_dir):
    rows = _texts(5)
    want = {i for i, (_, c) in _links(rows).items() if i == c}
    got = sorted(map(_row, corpus_pipeline.drop_near_duplicates(spark, _frame(spark, rows), labels_dir).collect()))
    assert got == sorted((i, t, *_carried(i), len(t or "")) for i, t in rows if i in want) and 101 not in want and 103 in want
    twice = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "A b c d e f"), (None, "x y")]
    assert sorted((r.doc_id or 0, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, _frame(spark, twice), labels_dir).collect()) == [(0, "x y"), (1, "a b c d e f"), (1, "a b c d e f")]


def test_repeated_passages_go_and_characters_stay_whole(spark, labels_dir):
    rows = _texts(7)
    want = _repeats(rows, 100)
    got = {r.doc_id: r for r in corpus_pipeline.drop_repeated_passages(spark, _frame(spark, rows), labels_dir).collect()}
    assert set(got) == set(want) and any(w[1] for w in want.values())
    for i, t in rows:
        if not want[i][1]:
            assert got[i].text == (t or "")
        lost = want[i][0] - want[i][1] - len(got[i].text.encode())
        assert 0 <= lost <= 6 * want[i][2]  # parts of characters at cuts only
        if got[i].text.encode() and not lost:
            assert hashlib.sha256(got[i].text.encode()).hexdigest() == want[i][3]
        assert got[i].n_chars == len(got[i].text) and (got[i].lang, got[i].source) == _carried(i)
    kept = [i for i, t in rows if "�" in (t or "") and "�" in got[i].text]
    assert kept and sum(got[i].text.count("�") for i in got) <= sum((t or "").count("�") for _, t in rows)


def test_all_that_is_left_is_packed(spark, labels_dir):
    from tokenizers import Tokenizer

    rows = _texts(9)
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = collections.defaultdict(int)
    for r in corpus_pipeline.pack(spark, _frame(spark, rows), labels_dir).collect():
        got[r.doc_id] += r.length
    assert got == {i: len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in rows}


def test_run_chains_the_stages(spark, tmp_path):
    rows = _texts(11)
    _frame(spark, rows).drop("score", "label").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i == 107)) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    want = dict(rows)
    docs = _frame(spark, rows).drop("score", "label")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    sums = lambda df: sorted((r.doc_id, r["sum(length)"]) for r in df.groupBy("doc_id").sum("length").collect())
    got = sums(corpus_pipeline.run(spark, str(tmp_path)))
    assert got == sums(docs) and {i for i, _ in got} <= set(want) and 101 not in {i for i, _ in got}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "jaccard_join", "suffix_dedup", "packing"]
    empty = f"{tmp_path}/empty"
    _frame(spark, rows).limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
