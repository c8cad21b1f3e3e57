"""Cases that a plain version decides: long blocks, short items, foreign tokenizers, the classifier's parts, the pipeline."""

import hashlib
import math
import os
import random
import sys
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellarium.llm import containment, packing, quality, search, simhash, suffix, tokens

RND = random.Random(11)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, letters="abcdefgh"):
    return " ".join("".join(RND.choice(letters) for _ in range(RND.randint(2, 8))) for _ in range(n))


def test_anchors_of_full_blocks():
    rng = np.random.default_rng(1)
    texts = [rng.integers(97, 123, n, dtype=np.uint8).tobytes() for n in (suffix.BLOCK - 1, suffix.BLOCK + 400)]
    alone = [{int(a) for _, at, _ in suffix.text_anchors([t]) for a in at} for t in texts]
    both = [set(), set()]
    for own, at, _ in suffix.text_anchors(texts):
        for o, a in zip(own.tolist(), at.tolist()):
            both[o].add(a)
    assert both == alone and max(both[1]) > suffix.BLOCK


def test_repeat_behind_a_block(spark):
    long = "".join(chr(97 + int(x)) for x in np.random.default_rng(2).integers(0, 26, suffix.BLOCK + 900))
    rows = [(1, long), (2, "Q" * 10 + long[-250:] + "Z" * 10)]
    got = {r.doc_id: r.n_removed for r in suffix.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).select("row.doc_id", "n_removed").collect()}
    assert got == {1: 250, 2: 250}


@pytest.mark.parametrize("n", range(1, 9))
def test_short_items_in_short_documents(n):
    items = [(i, " ".join("alpha beta gamma delta eps zeta".split()[:i])) for i in (1, 2, 3, 4, 5)]
    text = " ".join(("x alpha beta gamma delta eps zeta y".split())[:n])
    found = {i for i, _, _ in containment.Sketches(items, 0.8).find(text, containment._Hashes())}
    assert found == {i for i, t in items if f" {t} " in f" {text} "}


def test_foreign_tokenizer_takes_the_library():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    texts = ["Plain words, here.", "", "  don't\n\nÄrger 12  ", words(40)]
    lib = Tokenizer.from_file(path)
    own = tokens.Encoder(path)
    assert [np.frombuffer(x, own.kind).tolist() for x in own.encode(texts)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_shape_reads_whole_words():
    known = quality.Words()
    assert known[b"a" * 70 + b"1"][1] != known[b"a" * 70][1] == known[b"q"][1]
    assert known[b"Ab-" * 100][1] == known[b"Xy-" * 100][1]


def test_classifier_parts(monkeypatch):
    monkeypatch.setattr(quality, "WIDTH", 6)
    rows = [np.array(sorted(RND.sample(range(6), RND.randint(1, 5))), np.int32) for _ in range(40)]
    labels = np.array([int(0 in r) if RND.random() < 0.8 else RND.randint(0, 1) for r in rows])
    ratio = quality.log_count_ratios(rows, labels)
    p, q = (np.array([1 + sum(f in r for r, y in zip(rows, labels) if y == c) for f in range(6)], float) for c in (1, 0))
    assert np.allclose(ratio, np.log((p / p.sum()) / (q / q.sum())), atol=1e-6)

    x = np.zeros((40, 7))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / np.linalg.norm(ratio[r])
        x[i, 6] = 1  # the bias is a weight like any other
    y = np.where(labels == 1, 1.0, -1.0)
    cost = np.where(y > 0, 20 / (y > 0).sum(), 20 / (y < 0).sum())
    goal = lambda w: 0.5 * w @ w + (cost * np.maximum(0, 1 - y * (x @ w))).sum()
    w, bias = quality.hinge_fit(rows, labels, ratio, epochs=400)
    own = goal(np.r_[w, bias])
    plain, best = np.zeros(7), math.inf
    for step in range(1, 20001):  # subgradient descent
        plain -= (plain - ((cost * y)[:, None] * x)[y * (x @ plain) < 1].sum(0)) / step
        best = min(best, goal(plain))
    assert own <= best * 1.01


def _simhash_roots(rows):
    prints = [simhash_of(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                root[top(i)] = top(j)
    return [top(i) for i in range(len(rows))]


def simhash_of(text):
    import re

    import xxhash

    found = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not found:
        return 0
    runs = [b" ".join(found[i : i + 4]) for i in range(max(1, len(found) - 3))]
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_pipeline(spark, tmp_path):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    import corpus_pipeline as pipe

    assert [n for n, _ in pipe.STAGES] == ["quality classifier", "simhash near-dedup", "suffix-array dedup", "decontamination", "packing"]
    item = words(30)
    passage = words(60)
    good = [words(RND.randint(20, 80)) for _ in range(60)]
    bad = ["BUY!! NOW!! " + words(RND.randint(5, 20)).upper() for _ in range(40)]
    texts = good + bad + [good[0], good[0], good[1] + " " + passage, good[2] + " " + passage, good[3] + " " + item, None, ""]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    labels = [(i, int(i < 60), 0) for i in range(100)]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    name = iter(dict(pipe.STAGES))

    def stage(df):
        out = dict(pipe.STAGES)[next(name)](spark, df, str(tmp_path))
        path = f"{tmp_path}/{RND.random()}"
        out.write.parquet(path)
        return spark.read.parquet(path)

    one = stage(table)
    model = quality.train(table, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    want = [d for d in docs if model.score(quality.features((d[1] or "").encode(), quality.Words())) >= 0.7]
    assert sorted(map(tuple, one.collect())) == sorted(want) and one.columns == table.columns
    assert {d[0] for d in want} >= set(range(60)) and not {d[0] for d in want} & set(range(60, 100))

    two = stage(one)
    roots = _simhash_roots([(d[0], d[1]) for d in want])
    first = {}
    for d, r in zip(want, roots):
        first[r] = min(first.get(r, d), d, key=lambda x: x[0])
    assert sorted(r.doc_id for r in two.collect()) == sorted(d[0] for d in first.values())

    three = stage(two)
    kept = {r.doc_id: r.text for r in two.collect()}
    raws = {i: (t or "").encode() for i, t in kept.items()}
    seen = Counter(r[i : i + 200] for r in raws.values() for i in range(len(r) - 199))
    for r in three.collect():
        raw, cover = raws[r.doc_id], bytearray(len(raws[r.doc_id]))
        for i in range(len(raw) - 199):
            if seen[raw[i : i + 200]] > 1:
                cover[i : i + 200] = b"\1" * 200
        plain = bytes(b for b, c in zip(raw, cover) if not c).decode("utf-8", "ignore")
        assert (r.text or "") == plain and (kept[r.doc_id] is None) == (r.text is None)
        assert r.n_chars == len(plain)
    assert three.columns == table.columns and any(len(r.text or "") < len(kept[r.doc_id] or "") for r in three.collect())

    four = stage(three)
    gone = {r.doc_id for r in three.collect()} - {r.doc_id for r in four.collect()}
    assert gone == {r.doc_id for r in three.collect() if item in (r.text or "")} and gone
    five = stage(four)
    assert sorted(r.doc_id for r in five.collect()) == sorted(r.doc_id for r in four.collect())

    empty = spark.createDataFrame([], SCHEMA)
    for _, run in pipe.STAGES:
        assert run(spark, empty, str(tmp_path)).count() == 0
    odd = spark.createDataFrame([(1, None, None, None, None), (1, None, None, None, None), (None, "abc", None, None, None)], SCHEMA).withColumn("row", F.lit("x")).withColumn("kept", F.lit(1)).withColumn("hits", F.lit(2))
    for _, run in pipe.STAGES:
        run(spark, odd, str(tmp_path)).count()


def test_empty_and_clashing_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    items = spark.createDataFrame([], "item_id long, text string")
    assert quality.quality(none, labels).count() == 0
    some = spark.createDataFrame([(1, "one two three", None, None, None), (None, None, None, None, None)], SCHEMA)
    some = some.withColumn("score", F.lit(1)).withColumn("row", F.lit(1)).withColumn("hits", F.lit(1)).withColumn("raw", F.lit(1)).withColumn("fp", F.lit(1))
    assert quality.quality(some, labels).filter("score between 0 and 1").count() == 2
    assert containment.contained(some, items).filter("size(hits) = 0").count() == 2
    assert containment.contaminated_pairs(none, items).count() == 0
    clash = spark.createDataFrame([(1, "one two", "x")], "item_id long, text string, row string")
    assert [tuple(r) for r in containment.contaminated_pairs(some, clash).collect()] == [(1, 1, 1, 1, 1.0)]
    assert packing.pack(none).count() == 0 and packing.pack(some).count() == 2
    assert simhash.near_duplicates(none).count() == 0 and simhash.near_duplicates(some).count() == 2
    assert search.search(some, some).count() == 1
