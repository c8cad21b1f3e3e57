"""Each operator against a plain version on small fixtures, with nulls, ties, repeats and empty tables."""

import hashlib
import os
import random
import re
import struct
import subprocess
import sys
import zlib
from collections import Counter, defaultdict
from itertools import product as every

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cellarium.llm import chat, chunks, common, containment, packing, pages, quality, search, simhash, suffix, tokens

RND = random.Random(3)
SCHEMA = "doc_id long, text string, kept string, score string"


def words(n, letters="abcdef"):
    return " ".join("".join(RND.choice(letters) for _ in range(RND.randint(2, 8))) for _ in range(n))


PASSAGES = [words(k) for k in (35, 36, 38, 45, 60, 100)]
DOCS = [(i, " ".join(x for _ in range(3) for x in (words(RND.randint(0, 30)), RND.choice(PASSAGES)[RND.randint(0, 30):])), "x", "y") for i in range(60)]
DOCS += [(1000, "a" * 3000, "", ""), (1001, "ab" * 400, "", ""), (1002, None, None, None), (1003, "", "", ""), (1003, "", "", ""), (None, words(100), "", "")]
DOCS += [DOCS[5], DOCS[5], (1006, DOCS[7][1], "", ""), (1007, words(3000), "", "")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("most", [512, 5])
def test_suffix_dedup(spark, docs, most):
    raws = [(t or "").encode() for _, t, _, _ in DOCS]
    seen = Counter(r[i : i + 200] for r in raws for i in range(len(r) - 199))
    want = Counter()
    for (doc_id, *_), r in zip(DOCS, raws):
        cover = bytearray(len(r))
        for i in range(len(r) - 199):
            if seen[r[i : i + 200]] > 1:
                cover[i : i + 200] = b"\1" * 200
        kept = bytes(b for b, c in zip(r, cover) if not c)
        spans = sum(c and not p for c, p in zip(cover, b"\0" + cover))
        want[doc_id, len(r), sum(cover), spans, hashlib.sha256(kept).hexdigest()] += 1
    got = suffix.suffix_dedup(docs, most).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert Counter(map(tuple, got.collect())) == want
    assert suffix.suffix_dedup(empty(spark)).count() == 0


def test_merge_never_loses_order():
    keys = [sorted("".join(RND.choice("ab") for _ in range(RND.randint(0, 12))).encode() for _ in range(RND.randint(0, 40))) for _ in range(7)]
    got = list(suffix.merge([suffix.Run(*suffix.front_code(k)) for k in keys]))
    assert [g[1] for g in got] == sorted(sum(keys, []))
    for (_, a, _, _), (n, b, _, _) in zip(got, got[1:]):
        assert n == len(b"".join(bytes([x]) for x, y in zip(a, b) if x == y)[: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))])


def roots(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash_components(spark, docs):
    def plain(text):
        w = (text or "").encode().lower().split()
        s = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0

    more = [(2000 + i, " ".join(DOCS[3][1].split()[:-1] + [words(1)]), "", "") for i in range(5)]
    rows = DOCS + more
    fps = [plain(r[1]) for r in rows]
    root = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 4])
    least = defaultdict(list)
    for r, k in zip(rows, root):
        least[k] += [r[0]] if r[0] is not None else []
    want = Counter((r[0], f"{fp:016x}", min(least[k], default=None)) for r, fp, k in zip(rows, fps, root))
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert Counter(map(tuple, got.collect())) == want
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_simhash_links_lose_nothing(spark):
    base = [RND.getrandbits(64) for _ in range(300)]
    fps = set(base)
    for b in base[:150]:
        for k in range(1, 6):
            x = b
            for bit in RND.sample(range(64), k):
                x ^= 1 << bit
            fps.add(x)
    centre = RND.getrandbits(64)
    fps |= {centre ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(a)}
    fps = sorted(fps)
    arr = np.array(fps, np.uint64)
    links = [(i, int(j)) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(arr[:i] ^ arr[i]) <= 4)]
    df = spark.createDataFrame([(int(x),) for x in arr.view(np.int64)], "fp long")
    at = {int(x): i for i, x in enumerate(arr.view(np.int64))}
    got = [(at[r.a], at[r.b]) for r in simhash.links(df).collect()]
    assert set(map(tuple, map(sorted, got))) <= set(map(tuple, map(sorted, links)))
    assert roots(len(fps), got) == roots(len(fps), links)


def test_one_of_each_keeps_texts_that_share_a_doc_id(spark):
    import corpus_pipeline

    a, b, c = words(200), words(200, "ghijkl"), words(200, "mnopqr")
    rows = [(7, a, "", ""), (7, b, "", ""), (7, b, "", ""), (8, a, "", ""), (9, c, "", ""), (None, c, "", ""), (None, a, "", "")]
    got = corpus_pipeline.one_of_each(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "")
    assert got.columns == ["doc_id", "text", "kept", "score"]
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter([(7, a), (7, b), (9, c), (None, c), (None, a)])


def test_records_round_trip(spark, docs):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    rows = DOCS + [(3000, "It's 12 <|endoftext|> İstanbul ΟΔΟΣ\tx\x01y\n\nZ", "", "")]
    tok = Tokenizer.from_file(path)
    key = lambda r: (r[0] is not None, r[0] or 0, xxhash.xxh64_intdigest((r[1] or "").encode(), 42) - (1 << 64) * (xxhash.xxh64_intdigest((r[1] or "").encode(), 42) >> 63))
    want, start = [], 0
    for r in sorted(rows, key=key):
        ids = [*tok.encode(r[1] or "", add_special_tokens=False).ids, 1]
        want.append((r[0], start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    got = tokens.token_records(spark.createDataFrame(rows, SCHEMA).repartition(3), path).collect()
    assert Counter(map(tuple, got)) == Counter(want)
    framed = tokens.frame(b"abcd") + tokens.frame(b"")
    assert tokens.unframe(framed) == (b"abcd", 20) and tokens.unframe(framed, 20) == (b"", len(framed))
    with pytest.raises(ValueError):
        tokens.unframe(framed[:12] + b"x" + framed[13:])


def test_plain_lines_encode_as_the_library_does():
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tok, words = Tokenizer.from_file(path), tokens.Encoder(path)
    lines = [x for c in map(chr, range(0x20, 0x260)) for x in (c, f"{c}auna", f"the ka{c}no tree", f"AB{c}, {c}{c}")]
    got = words.encode(lines)
    wrong = [x for x, g in zip(lines, got) if np.frombuffer(g, words.kind).tolist() != tok.encode(x, add_special_tokens=False).ids]
    assert not wrong


def test_chunks(spark, docs):
    got = chunks.chunk_dedup(docs).collect()
    order = sorted({(r.row.doc_id, r.row.text or "") for r in got}, key=lambda x: (x[0] is not None, x[0] or 0))
    seen, kept = set(), {}
    for doc_id, text in order:
        raw, at, left = text.encode(), 0, b""
        for end in chunks._ends(raw):
            if raw[at:end] not in seen:
                left += raw[at:end]
                seen.add(raw[at:end])
            at = end
        kept[doc_id, text] = left
    assert len(got) == len(DOCS)
    for r in got:
        assert bytes(r.kept) == kept[r.row.doc_id, r.row.text or ""]
    a = words(400).encode()
    b = a[:900] + b"inserted" + a[900:]
    pieces = lambda x: {x[i:j] for i, j in zip([0, *chunks._ends(x)], chunks._ends(x))}
    assert len(pieces(a) - pieces(b)) <= 4 and b"".join(b[i:j] for i, j in zip([0, *chunks._ends(b)], chunks._ends(b))) == b
    assert chunks.chunk_dedup(empty(spark)).count() == 0


def test_containment(spark):
    items = [(i, words(RND.choice((3, 5, 6, 20, 45)), "abcdefghij")) for i in range(40)] + [(100, None), (101, ""), (5, "x y z u v w")]
    rows = []
    for i in range(120):
        own = RND.choice(items)[1] or ""
        part = own.split()
        if RND.random() < 0.4 and part:
            part[RND.randrange(len(part))] = "changed"
        rows.append((i, words(RND.randint(0, 300)) + " " + " ".join(part).upper() + ", " + words(40), "", ""))
    rows += [(None, None, "", ""), (200, "", "", ""), rows[3]]

    def shingles(w):
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    want = Counter()
    for d, t, *_ in rows:
        w = containment.words_of(t)
        for item, text in set(items):
            q = containment.words_of(text)
            s = shingles(q)
            if not s:
                continue
            have = {tuple(w[i : i + len(q)]) for i in range(len(w) - len(q) + 1)} if len(q) < 5 else shingles(w)
            n = len(s & have)
            if n >= 0.8 * len(s) - 1e-9:
                want[d, item, len(s), n, n / len(s)] += 1
    a = containment.contaminated_pairs(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string"))
    assert Counter(map(tuple, a.collect())) == want and want
    b = containment.contained(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string"), limit=500)
    assert sum(len(r.hits) for r in b.collect()) == sum(want.values())


def _ranked(rows, k):
    """Plain BM25 of each query (doc_id % 20 = 0) against every row: {query: [(doc_id, score)]}."""
    split = [Counter((r[1] or "").lower().split()) for r in rows]
    n, df_, avg = len(rows), Counter(w for c in split for w in c), sum(sum(c.values()) for c in split) / max(1, len(rows))
    found = {}
    for q in (r for r in rows if r[0] % 20 == 0):
        scores = []
        for r, c in zip(rows, split):
            length = sum(c.values())
            s = sum(m * np.log(1 + (n - df_[w] + 0.5) / (df_[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * length / avg)) for w, m in Counter((q[1] or "").lower().split()).items() if w in c)
            if s > 0:
                scores.append((-round(s, 9), r[0]))
        found[q[0]] = [(d, -s) for s, d in sorted(scores)[:k]]
    return found


@pytest.mark.parametrize("alphabet,n", [("abc", 400), ("abcdefghij", 900)])
def test_search(spark, monkeypatch, alphabet, n):
    monkeypatch.setattr(search, "SHARD", 3000)
    monkeypatch.setattr(search, "DOCS", 150)  # many shards: thresholds are carried
    monkeypatch.setattr(search, "HELD", 7)  # many blocks of queries
    rows = [(i, words(RND.randint(0, 60), alphabet), "", "") for i in range(n)] + [(n, None, "", ""), (n + 1, "abc abc", "", ""), (n + 2, "abc abc", "", "")]
    rows += [(n + 10 + i, rows[40][1], "", "") for i in range(25)]  # ties: more copies than places
    rows += [(n + 60, "the " * 3000 + words(4000, alphabet), "", "")] * 2  # long, and a repeated row
    got = search.search(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([r for r in rows if r[0] % 20 == 0][:-1], SCHEMA), 10).collect()
    for q, want in _ranked(rows, 10).items():
        own = sorted((r.rank, r.doc_id, r.score) for r in got if r.query_id == q)
        assert [x[0] for x in own] == list(range(1, len(own) + 1))
        assert [x[1] for x in own] == [d for d, _ in want]
        assert np.allclose([x[2] for x in own], [s for _, s in want])


def test_search_edges(spark):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(1, "one two", "x", "y"), (None, "two three", "x", "y"), (None, None, None, None)], SCHEMA)
    some = some.withColumn("terms", F.lit("clash")).withColumn("score", F.lit(1)).withColumn("shard", F.lit(1)).withColumn("file", F.lit("f"))
    assert search.search(none, none).count() == search.search(some, none).count() == search.search(none, some.drop("terms")).count() == 0
    got = {(r.query_id, r["rank"], r.doc_id) for r in search.search(some, some).collect()}
    assert got == {(1, 1, 1), (1, 2, None), (None, 1, None), (None, 2, 1)}


def test_simhash_writes_few_files_of_few_rows(spark, monkeypatch):
    """However many shuffle partitions there are; the components are those of all pairs."""
    made = []
    monkeypatch.setattr(common, "scratch", lambda spark, name, make=common.scratch: made.append((name, make(spark, name))) or made[-1][1])
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    long = [words(400, "abcdefghij") for _ in range(20)]
    rows = [(i, long[i % 20].replace("a", "b", i // 60), "", "") for i in range(200)]
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    fps, root = {r.doc_id: int(r.fingerprint, 16) for r in got}, {r.doc_id: r.component_id for r in got}
    want = {i: i for i in fps}
    for _ in fps:
        new = {a: min(want[b] for b in fps if (fps[a] ^ fps[b]).bit_count() <= 4) for a in fps}
        if new == want:
            break
        want = new
    assert root == want and len(set(fps.values())) > len(set(want.values()))
    files = {name: len(spark.read.parquet(path).inputFiles()) for name, path in made if name in ("nodes", "edges")}
    assert files == {"nodes": 1, "edges": 1}


def test_search_writes_a_file_for_each_task(spark, monkeypatch):
    """Not one for each group of like documents; runs of like ones that begin and end inside row groups are read whole."""
    made = {}
    monkeypatch.setattr(search, "scratch", lambda spark, name, make=search.scratch: made.setdefault(name, make(spark, name)))
    monkeypatch.setattr(search, "GROUP", 1, raising=False)  # row groups as small as the writer makes them
    monkeypatch.setattr(search, "SHARD", 3000)
    monkeypatch.setattr(search, "DOCS", 150)
    rows = [(i, words(RND.randint(1, 60), RND.choice(["abc", "def", "ghi", "jkl", "mno"])), "", "") for i in range(1200)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = search.search(df, df.filter("doc_id % 20 = 0"), 10).collect()
    want = _ranked(rows, 10)
    for q, best in want.items():
        assert [r.doc_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [d for d, _ in best]
    told = spark.read.parquet(made["terms"])
    assert told.select("like").distinct().count() > 3
    assert len(told.inputFiles()) == 3


def test_search_takes_one_worker_for_each_task(spark, monkeypatch):
    """No Python function feeds another within a task, and no step needs workers of a second kind."""
    plans, rdds = {}, {}

    def told(df, name, make=search.cut):
        plan = df._jdf.queryExecution()
        plans[name], rdds[name] = plan.executedPlan().toString().split("\n"), plan.toRdd().toDebugString()
        return make(df, name)

    monkeypatch.setattr(search, "cut", told)
    df = spark.createDataFrame([(i, words(RND.randint(1, 60), "abc"), "", "") for i in range(100)], SCHEMA)
    assert search.search(df.select("doc_id", "text"), df.filter("doc_id % 20 = 0")).count() == 50
    assert sorted(plans) == ["asked", "home"]
    for plan in plans.values():
        steps = [re.search(r"MapInArrow|Exchange|Scan|QueryStage", x) for x in plan]
        steps = [x[0] for x in steps if x]
        assert "MapInArrow" in steps and ("MapInArrow", "MapInArrow") not in zip(steps, steps[1:])
    own = spark.createDataFrame(DOCS, SCHEMA)._jdf.queryExecution().toRdd().toDebugString().count("PythonRDD")
    assert own > 0 and rdds["home"].count("PythonRDD") == 0


LEAN = """
import re, sys
import numpy as np, pyarrow as pa, pyarrow.parquet as pq
from cellarium.llm import search
def own():
    return sum(map(int, re.findall(r"\\nPss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024
rnd = np.random.default_rng(0)
docs = [" ".join(map(str, np.minimum(rnd.zipf(1.2, 500), 10**6))) for _ in range(6000)]
batches = [pa.RecordBatch.from_pydict({"doc_id": range(i, i + 1000), "text": docs[i : i + 1000]}) for i in range(0, 6000, 1000)]
pq.write_table(pa.Table.from_batches(search._counted(iter(batches))), sys.argv[1] + "/a.parquet", row_group_size=500)
part = dict(file="a.parquet", first=0, run=6000, of=1, rest=0, postings=1_200_000)
began, most = own(), 0
for _ in range(3):
    index = None
    index = search._load(sys.argv[1], [part], 500.0)
    most = max(most, own() - began)
print(most, sum(x.nbytes for x in vars(index).values() if isinstance(x, np.ndarray)) / 2**20)
"""


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="memory can't be read")
def test_search_holds_little_besides_an_index(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(search.__file__))) + "/.."
    run = subprocess.run([sys.executable, "-c", LEAN, str(tmp_path)], env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    held, index = map(float, run.stdout.split())
    assert held < index + 32, (held, index)


def test_packing(spark, docs):
    lengths = np.array(sorted(RND.sample(range(1, 60), 12)))
    counts = np.array([RND.randint(1, 9) for _ in lengths])
    cost = lambda bounds: sum(int(c) * (min(b for b in bounds if b >= x) - int(x)) for x, c in zip(lengths, counts))
    from itertools import combinations

    for k in (1, 2, 3, 4):
        assert cost(packing.boundaries(lengths, counts, k)) == min(cost([*c, lengths[-1]]) for c in combinations(lengths[:-1], k - 1))
    got = packing.pack(docs, 4, 2000).collect()
    assert len(got) == len(DOCS)
    by = defaultdict(list)
    for r in got:
        assert r.n_tokens <= r.bucket_len
        by[r.bucket, r.batch].append(r)
    for rows in by.values():
        assert len(rows) * rows[0].bucket_len <= 2000 or len(rows) == 1
        assert sorted(r.place for r in rows) == list(range(len(rows)))
    assert packing.pack(empty(spark)).count() == 0


def test_packing_is_optimal_above_a_thousand(spark):
    lengths = sorted(RND.sample(range(1030, 1200), 30) + RND.sample(range(1, 6000), 30))
    rows = [(i, "w " * (n - 1)) for i, n in enumerate(n for n in lengths for _ in range(RND.randint(1, 4)))]
    sizes = np.array([len(t.split()) + 1 for _, t in rows])
    distinct, counts = np.unique(sizes, return_counts=True)
    for k in (1, 3, 7, 16):
        best = [0] + [float("inf")] * len(distinct)
        for _ in range(k):  # the least padding of the first j lengths, by trying every cut
            best = [0] + [min(best[i] + int((counts[i:j] * (distinct[j - 1] - distinct[i:j])).sum()) for i in range(j)) for j in range(1, len(distinct) + 1)]
        bounds = np.array(packing.boundaries(distinct, counts, k))
        assert len(bounds) <= k and int((bounds[np.searchsorted(bounds, sizes)] - sizes).sum()) == best[-1]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r.bucket_len - r.n_tokens for r in got) == best[-1]


def test_chat_repair(spark):
    def brute(roles):
        best = chat.FAR
        for states in every((1, 2, 3), repeat=len(roles)):
            cost, a = 0, 0
            for r, b in zip(roles, states):
                if (a, b) not in chat.CHOICES[r]:
                    cost = chat.FAR
                    break
                cost, a = cost + chat.CHOICES[r][a, b][0], b
            best = min(best, cost + chat.FINAL[a])
        return best

    for _ in range(60):
        roles = [RND.randint(0, 3) for _ in range(RND.randint(1, 6))]
        total, steps = chat.repair(roles)
        assert total == brute(roles)
        m = chat.identity()
        for r in roles:
            m = chat.product(m, chat._MATRIX[r])
        assert total == min(m[0, s] + chat.FINAL[s] for s in range(4))
    rows = [(1, i, RND.choice(["user", "assistant", "system", None, "bot"]), f"t{i}") for i in range(300)]
    rows += [(2, 0, "user", "hi"), (2, 1, "user", None), (3, 0, "assistant", ""), (None, None, None, None)]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()
    assert len(got) == len(rows)
    one = "".join(r.rendered for r in sorted((r for r in got if r.conv_id == 1), key=lambda r: r.turn))
    ordered = [r for r in rows if r[0] == 1]
    _, steps = chat.repair([chat.role_of(r[2]) for r in ordered])
    assert one.count("<|end|>") == one.count("<|user|>") + one.count("<|assistant|>") + one.count("<|system|>")
    assert one == "".join(chat.render([r[3] for r in ordered], steps, True, True))


def test_pages(spark):
    page = """<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><a>Home page link</a></nav><div class="ad">Buy this now, please.</div>
    <article><h1>A &amp; B</h1><p>One, two. Three&nbsp;four.<p><b>Bold<br>line</b></article><div id="comments"><p>Nice article, thanks a lot.</p></div><footer>&copy; us</footer>"""
    assert pages.main_text(page) == "A & B\n\nOne, two. Three four.\n\nBold line"
    bare = "<body><ul><li><a>x</a><li><a>y</a></ul><div><h2>Head</h2><p>A long text, with stops. And more of it, again.</p><p>Short.</p></div><form>Name</form></body>"
    assert pages.main_text(bare) == "Head\n\nA long text, with stops. And more of it, again.\n\nShort."
    rows = spark.createDataFrame([(1, None, None), (2, "u", ""), (2, "u", "")], "page_id long, url string, html string")
    assert sorted(tuple(r)[2:] for r in pages.extract(rows).collect()) == [("", 0)] * 3


def test_pages_keep_every_selected_node():
    long = "word, " * 170
    assert pages.main_text(f"<body><div><p>{long}</p><p>short one</p></div></body>").endswith("\n\nshort one")
    # the lead stands outside the element that has 98 % of the text
    lead = "A lead, well selected."
    page = f"<body><div><p>{lead}</p></div><div><section><p>{long}</p><p>{long}</p></section></div></body>"
    node = pages.nodes_of(page)
    assert pages.main_text(page).startswith(lead) and len(node) == 3
    # two articles: the second is as much selected as the first
    assert pages.main_text(f"<body><article><p>{long}</p></article><article><p>{long}</p></article></body>").count("\n\n") == 1
    assert pages.main_text(f"<body><div><h2>Head</h2><p>{long}</p></div></body>").startswith("Head")


@pytest.mark.parametrize("name", ["content has-sidebar", "no-comments", "article-share-enabled", "search-result", "comments"])
def test_pages_names_drop_no_article(name):
    long = "word, " * 170
    page = f'<body><div class="site-footer">All rights, and so on.</div><div class="{name}"><p>{long}</p></div></body>'
    assert pages.main_text(page) == long.strip()
    rows = "".join(f'<li class="{name}">One, two. {i}</li>' for i in range(3))
    assert pages.main_text(f"<body><ul>{rows}</ul></body>").count("One, two.") == 3
    # what the page marks as its article needs no ratio against an advert
    assert pages.main_text(f'<body><div class="ad"><p>{long}</p></div><article><p>Short.</p></article></body>') == "Short."
    assert pages.main_text(f'<body><article><h1>A</h1><div class="{name}"><p>{long}</p></div></article></body>').endswith(long.strip())


def test_quality(spark):
    good = lambda: " ".join(RND.choice(["the", "tree", "grows", "in", "spring", "and", "we", "see", "it"]) for _ in range(40)) + "."
    bad = lambda: " ".join(RND.choice(["BUY", "NOW", "win", "cash", "free"]) + "!!" for _ in range(40))
    rows = [(i, good() if i % 3 else bad(), "", "") for i in range(300)] + [(400, None, "", ""), (None, "", "", "")]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(300)] + [(None, 1), (7, None)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, SCHEMA)
    got = quality.quality(docs, labels).select("row.doc_id", quality.held_out("row.doc_id").alias("held_out"), "score", "predicted").collect()
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 300]
    assert len(got) == len(rows) and held and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == int(r.doc_id % 3 > 0) for r in held)
    assert {r.doc_id for r in got if r.held_out} == {i for i, *_ in rows if i is not None and zlib.crc32(str(i).encode()) % 4 == 2}
