"""Brute-force and edge-case tests of the operators that bring rows together, and of the pipeline."""

import heapq
import math
import random
import tracemalloc
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from utterscope.llm import components as C
from utterscope.llm import common, lm_score, packing, registry, topk
from utterscope.llm import sharding as SH
from utterscope.llm import similar as SM
from utterscope.llm import simhash as SI
from utterscope.llm.common import cut, maybe_among, with_slots

DATA = Path("/root/testdata/sf0.001")
DOCS = "doc_id bigint, text string"


def table_dir(tmp_path, **tables):
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


# --- gapless numbers


def test_slots_are_gapless(spark):
    rng = random.Random(1)
    df = cut(spark.createDataFrame([(rng.choice("aab"), i) for i in range(500)], "k string, i int"))
    rows = with_slots(df, ["k"], F.pmod(F.xxhash64("i"), F.lit(8)), ["i"], "slot").collect()
    for k in "ab":
        own = sorted(r["slot"] for r in rows if r["k"] == k)
        assert own == list(range(len(own))) and len(rows) == 500


# --- rows marked by a bitmap of keys


@pytest.mark.parametrize("blocks", [1, 2048])
def test_no_key_is_missed_and_few_others_are_marked(spark, monkeypatch, blocks):
    monkeypatch.setattr(common, "BLOCKS", blocks)
    df = spark.range(-20_000, 20_000).withColumn("a.b", F.lit("x"))
    got = maybe_among(df, "id", cut(df.where("id % 8 = 3").select(F.col("id").alias("k"))))
    assert got.columns == [*df.columns, "__maybe"] and got.count() == 40_000
    keys = {r["id"] for r in df.where("id % 8 = 3").collect()}
    marked = {r["id"] for r in got.where("__maybe").collect()}
    assert marked >= keys and len(marked - keys) < (2000 if blocks > 1 else 10_000)
    assert maybe_among(df, "id", cut(df.where("false").select("id"))).where("__maybe").count() == 0


# --- sharding


def lpt(sizes, shards):
    heap = [(0, s) for s in range(shards)]
    heapq.heapify(heap)
    for size in sorted(sizes, reverse=True):
        load, s = heapq.heappop(heap)
        heapq.heappush(heap, (load + size, s))
    return sorted(load for load, _ in heap)


def test_deal_is_the_heap_rule():
    rng = random.Random(2)
    for _ in range(200):
        shards = rng.randint(1, 24)
        classes = sorted(({rng.randint(1, rng.choice([20, 3000])): rng.randint(1, rng.choice([5, 800])) for _ in range(rng.randint(0, 15))}).items(), reverse=True)
        dealt = SH.deal(classes, shards)
        assert [sum(c) for c in dealt] == [n for _, n in classes]
        loads = sorted(sum(c[s] * size for c, (size, _) in zip(dealt, classes)) for s in range(shards))
        assert loads == lpt([size for size, n in classes for _ in range(n)], shards)


def test_sharding_against_brute_force(spark, tmp_path):
    rng = random.Random(3)
    texts = ["t" * rng.randint(0, 300) + str(rng.randint(0, 400)) for _ in range(700)] + ["same"] * 350 + [None, "", None, "é" * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS).withColumn("size", F.lit("clash")).withColumn("shard", F.lit(1))
    rows = SH.op3_sharding(spark, table_dir(tmp_path, documents=docs)).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(texts)))
    groups, by_group, loads, slots = Counter(), {}, Counter(), {}
    for r in rows:
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        groups[raw] += r["size"]
        by_group.setdefault(raw, set()).add(r["shard"])
        loads[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(len(s) == 1 for s in by_group.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = lpt(groups.values(), 24)
    assert np.allclose(sorted(loads[s] for s in range(24)), want, atol=8)  # classes of larger sizes share a mean


def test_sharding_of_nothing(spark, tmp_path):
    assert SH.op3_sharding(spark, table_dir(tmp_path, documents=spark.createDataFrame([], DOCS))).count() == 0


# --- components


def brute_components(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(-60, 60), rng.randint(-60, 60)) for _ in range(70)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5), (2000, 2001), (2001, 2000)] + [(3000, 3000 + i) for i in range(1, 90)]
    got = {r["node"]: r["component"] for r in C.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    real = [(u, v) for u, v in edges if u != v]
    assert got == brute_components({n for e in real for n in e}, real)


def test_no_edges(spark):
    assert C.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


# --- simhash


def brute_fingerprint(text, k=4):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def unsigned(x):
    return x & (2**64 - 1)


def test_fingerprints_and_engine_hash(spark):
    texts = ["A b\tC d e", "one", "", "  \n", "İ x y é z w", "r r r r r r r", "no break here"]
    for t in texts + [None]:
        assert unsigned(SI.fingerprint(t)) == brute_fingerprint(t)
    row = spark.createDataFrame([("a b c d",)], "t string").select(F.xxhash64("t")).first()
    assert unsigned(row[0]) == xxhash.xxh64_intdigest(b"a b c d", 42)
    assert SI.fingerprint("w " * 200_000) == SI.fingerprint("w w w w")


def clusters(rng, n, flips):
    base = [rng.getrandbits(64) for _ in range(8)]
    out = set()
    while len(out) < n:
        x = rng.choice(base)
        for _ in range(rng.randint(0, flips)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


def brute_links(fps, d):
    a = np.array(fps, np.uint64)
    return [(i, int(i + 1 + j)) for i in range(len(a)) for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= d)]


@pytest.mark.parametrize("distance, tile", [(4, 20_000), (4, 40), (6, 20_000), (0, 20_000), (8, 60)])
def test_links_lose_nothing(spark, distance, tile):
    rng = random.Random(distance + tile)
    fps = clusters(rng, 500, 10)
    df = cut(spark.createDataFrame([(i, x - 2**64 if x >> 63 else x) for i, x in enumerate(fps)], "node bigint, fp bigint"))
    got = [(r["u"], r["v"]) for r in SI.links(df, distance, tile=tile).collect()]
    a = np.array(fps, np.uint64)
    want = brute_components(range(len(fps)), brute_links(fps, distance))
    assert brute_components(range(len(fps)), got) == want and len(set(want.values())) > 3
    for u, v in got:  # links join only what is linked
        assert want[u] == want[v]
    assert len(a) == 500


def test_masks_cover_every_pair():
    for count in (10, 10**6, 10**9, 10**11):
        masks = [unsigned(m) for m in SI.bit_masks(count, 4)]
        rng = random.Random(count)
        for _ in range(300):
            diff = 0
            for b in rng.sample(range(64), 4):
                diff |= 1 << b
            assert any(diff & m == 0 for m in masks)


def test_near_duplicates(spark):
    rng = random.Random(7)
    long = [f"w{rng.randint(0, 5000)}" for _ in range(900)]
    near = long[:400] + ["changed"] + long[401:]
    texts = [" ".join(long), " ".join(near), "a b c d e", "A  b\nc d e", None, "", "quite another text here", "a b c d e"]
    df = spark.createDataFrame([(10 - i, t, "x") for i, t in enumerate(texts)] + [(None, "a b c d e", "x"), (None, "alone and without id", "x")], DOCS + ", fp string")
    rows = SI.near_duplicates(df).collect()
    fps = sorted({brute_fingerprint(t) for t in [*texts, "alone and without id"]})
    comp = brute_components(range(len(fps)), brute_links(fps, 4))
    ids = {}
    for i, t in enumerate(texts):
        ids.setdefault(comp[fps.index(brute_fingerprint(t))], []).append(10 - i)
    got = {(r["doc_id"], unsigned(r["fp"])): r["component_id"] for r in rows}
    for i, t in enumerate(texts):
        f = brute_fingerprint(t)
        assert got[10 - i, f] == min(ids[comp[fps.index(f)]])
    assert got[None, brute_fingerprint("a b c d e")] == got[8, brute_fingerprint("a b c d e")] and len(rows) == 10
    kept = SI.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == sorted(min(v) for v in ids.values())
    assert kept.where("doc_id is null").count() == 2


def test_near_duplicates_of_nothing(spark):
    assert SI.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def brute_similar(texts, least, k=5):
    def grams(t):
        w = (t or "").lower().split()
        return {" ".join(w[i : i + k]) for i in range(len(w) - k + 1)} or ({" ".join(w)} if w else set())

    sets = [grams(t) for t in texts]
    return [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) - 1e-9]


@pytest.mark.parametrize("tile", [256, 7])
def test_links_are_exact_similarities(spark, monkeypatch, tile):
    monkeypatch.setattr(SM.confirmed_links, "__defaults__", (tile,))
    rng = random.Random(tile)
    texts = []
    for _ in range(6):  # copies with so many changed words that similarities lie on both sides of 0.8, and chains of them
        base = [f"w{rng.randint(0, 9000)}" for _ in range(200)]
        for _ in range(25):
            own = list(base)
            for _ in range(rng.randint(0, 7)):
                own[rng.randrange(len(own))] = f"new{rng.randint(0, 10**6)}"
            texts.append(" ".join(own))
            if rng.random() < 0.2:
                base = own
    texts += [None, "", "a b", "A  b", "alone here"]
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    want = brute_components(range(len(texts)), brute_similar(texts, 0.8))
    kept = SI.deduplicate(df, shingle=5, distance=4, similar=0.8)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values())) and 20 < len(set(want.values())) < 140
    by_bits = SI.deduplicate(df, shingle=5, distance=4)
    assert sorted(r["doc_id"] for r in by_bits.collect()) != sorted(set(want.values()))


# --- top-k


def brute_topk(rows, k=10, every=100):
    whole = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in whole:
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole if i != q and len(a) == len(b))[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def topk_rows(spark, path):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.op6_topk(spark, path).collect())


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 100)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 4)


@pytest.mark.parametrize("blocks", ["small", "large"])
def test_topk_with_repeated_ids(spark, tmp_path, blocks, request):
    if blocks == "small":
        request.getfixturevalue("small_blocks")
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(1, 60)]
    rows += [(0, rng.normal(size=8).tolist()) for _ in range(20)]  # own rows that are no candidates
    rows += [(100, rng.normal(size=8).tolist())] * 2 + [(7, rows[6][1])] * 3  # a repeated query, a repeated candidate
    rows += [(200, [9.0, 9.0])]  # a query without candidates
    path = table_dir(tmp_path, embeddings=spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"))
    assert topk_rows(spark, path) == brute_topk(spark.read.parquet(f"{path}/embeddings.parquet").collect())


def test_topk_of_nothing(spark, tmp_path):
    path = table_dir(tmp_path, embeddings=spark.createDataFrame([], "vec_id bigint, embedding array<float>"))
    assert topk_rows(spark, path) == []


def test_topk(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(0, 900)]
    rows += [(i, rows[100][1]) for i in range(900, 960)]  # one common vector
    rows += [(1000, None), (1001, [1.0, None]), (1100, [float("nan")] * 16), (1200, [float("inf")] * 16), (1300, []), (1400, [0.5, 0.25]), (1401, [-0.5, 2.0]), (None, rows[0][1]), (-100, [0.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("score", F.lit("clash"))
    path = table_dir(tmp_path, embeddings=df)
    for blocks in ((topk.BLOCK_ROWS, topk.BLOCK_QUERIES), (100, 4)):
        monkeypatch.setattr(topk, "BLOCK_ROWS", blocks[0])
        monkeypatch.setattr(topk, "BLOCK_QUERIES", blocks[1])
        assert topk_rows(spark, path) == brute_topk(rows)


def test_index_is_exact_at_any_width():
    rng = np.random.default_rng(6)
    for _ in range(80):
        n, d, span = int(rng.integers(1, 200)), int(rng.integers(1, 12)), int(rng.choice([0, 1, 7, 1000, 10**6]))
        rows = rng.integers(-span, span + 1, size=(n, d))
        if rng.random() < 0.3:
            rows[rng.integers(0, n, size=n // 2)] = rows[0]
        ids, at = rng.permutation(500)[:n], rng.integers(0, n, size=int(rng.integers(1, 80)))
        k = int(rng.integers(1, 12))
        q, found, score = topk.BitSlicedIndex(ids, rows, int(rng.integers(1, 9))).search(ids[at], rows[at], k)
        want = []
        for a, i in enumerate(at):
            s = rows @ rows[i]
            want += [(a, v, -n_) for n_, v in sorted((-int(s[b]), int(ids[b])) for b in range(n) if ids[b] != ids[i])[:k]]
        assert list(zip(q.tolist(), found.tolist(), score.tolist())) == want


# --- packing


def padded(bins, ends):
    return sum(n * min(e for e in ends if e >= longest) for longest, n in bins)


def test_boundaries_are_optimal():
    from itertools import combinations

    rng = random.Random(5)
    for _ in range(60):
        bins = sorted({rng.randint(1, 60): rng.randint(1, 9) for _ in range(rng.randint(1, 9))}.items())
        k = rng.randint(1, 5)
        ends = packing.boundaries(bins, k)
        lengths = [b[0] for b in bins]
        best = min(padded(bins, [*c, lengths[-1]]) for m in range(min(k, len(bins))) for c in combinations(lengths[:-1], m))
        assert padded(bins, ends) == best and len(ends) <= k and ends == sorted(set(ends))


def test_boundaries_of_many_lengths_are_those_of_the_plain_programme():
    rng = np.random.default_rng(7)
    for _ in range(20):
        longest = np.unique(rng.integers(1, 5000, size=int(rng.integers(1, 400))))
        counts = rng.integers(1, 50, size=len(longest))
        upto, n, k = np.concatenate(([0], np.cumsum(counts))), len(longest), int(rng.integers(1, 9))
        best, choices = [0] + [10**18] * n, []
        for _ in range(min(k, n)):
            cost = [[best[i] + int(longest[j - 1] * (upto[j] - upto[i])) for i in range(j)] for j in range(1, n + 1)]
            choices.append([0] + [c.index(min(c)) for c in cost])
            best = [10**18] + [min(c) for c in cost]
        want, j = [], n
        for choice in reversed(choices):
            want.append(int(longest[j - 1]))
            j = choice[j]
        assert packing.boundaries(np.stack([longest, counts], axis=1), k) == want[::-1]


def test_pack(spark):
    rng = random.Random(6)
    lengths = [rng.choice([1, 5, 9, 40, 300]) for _ in range(400)] + [10**6]
    df = cut(spark.createDataFrame([(i if i else None, n) for i, n in enumerate(lengths)], "doc_id bigint, n_tokens bigint"))
    rows = packing.pack(df, buckets=3, budget=100).collect()
    assert sorted((r["n_tokens"] for r in rows)) == sorted(lengths)
    seen = {}
    for r in rows:
        assert r["n_padding"] == r["bucket_len"] - r["n_tokens"] >= 0
        seen.setdefault((r["bucket"], r["bucket_len"], r["batch"]), []).append(r["slot"])
    for (_, longest, _), slots in seen.items():
        assert sorted(slots) == list(range(len(slots))) and (len(slots) * longest <= 100 or len(slots) == 1)
    for bucket in {b for b, _, _ in seen}:
        batches = sorted(n for b, _, n in seen if b == bucket)
        assert batches == list(range(len(batches)))
    assert packing.pack(cut(spark.createDataFrame([], df.schema))).count() == 0


# --- language models


def brute_scores(docs, target, size, alpha):
    def words(t):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()

    counts = Counter(w for t in [*docs, *target] for w in words(t))
    vocab = {w: i for i, (w, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:size], 1)}
    out = len(vocab) + 2

    def pairs(t):
        ids = [0, *(vocab.get(w, 0) for w in words(t)), 0]
        ids[0] = ids[-1] = out - 1
        return list(zip(ids, ids[1:]))

    def model(texts):
        n = Counter(p for t in texts for p in pairs(t))
        before, single = Counter(), Counter()
        for (v, w), c in n.items():
            before[v] += c
            single[w] += c
        total = sum(n.values())
        return lambda v, w: -math.log((n[v, w] + alpha * (single[w] + 1) / (total + out)) / (before[v] + alpha))

    t, b = model(target), model(docs)
    return [(len(pairs(d)), sum(t(*p) for p in pairs(d)) / len(pairs(d)), sum(b(*p) for p in pairs(d)) / len(pairs(d))) for d in docs]


@pytest.mark.parametrize("block", [60, 1 << 22])
def test_cross_entropies(spark, block):
    rng = random.Random(block)
    make = lambda pool, n: [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 20))) for _ in range(n)]
    docs, target = [*make(["a", "B", "c", "é"], 40), None, "", "z " * 20_000], [*make(["a", "b"], 20), None]
    for own in (target, []):
        df = spark.createDataFrame(list(enumerate(docs)), DOCS).withColumn("score", F.lit("clash"))
        got = lm_score.cross_entropy_difference(df, spark.createDataFrame([(t,) for t in own], "text string"), alpha=5.0, block_bytes=block, part_bits=3).collect()
        want = brute_scores(docs, own, 10**9, 5.0)
        for r in got:
            n, t, b = want[r["doc_id"]]
            assert r["n_tokens"] == n and r["ce_target"] == pytest.approx(t) and r["ce_background"] == pytest.approx(b) and r["score"] == pytest.approx(t - b)
        assert len(got) == len(docs)


def test_every_word_is_told_apart(spark):
    rng = random.Random(9)
    docs = [" ".join(f"w{int(rng.paretovariate(0.4))}" for _ in range(rng.randint(0, 60))) for _ in range(150)] + [None, "", "é É\x0ba A", "rare"]
    docs += docs[:2]
    target = [*docs[20:60], "other words", None]
    df = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(docs)], DOCS).withColumn("score", F.lit("clash"))
    for own in (target, []):
        got = lm_score.cross_entropy_difference(df, spark.createDataFrame([(t,) for t in own], "text string"), alpha=5.0, block_bytes=400).collect()
        want = brute_scores(docs, own, 10**9, 5.0)
        assert sorted(r["doc_id"] or 0 for r in got) == list(range(len(docs)))
        for r in got:
            n, t, b = want[r["doc_id"] or 0]
            assert r["n_tokens"] == n and r["ce_target"] == pytest.approx(t) and r["ce_background"] == pytest.approx(b) and r["score"] == pytest.approx(t - b)
    empty = spark.createDataFrame([], DOCS)
    assert lm_score.cross_entropy_difference(empty, empty, block_bytes=400).count() == 0


def test_target_like_documents_score_lower(spark):
    cats, dogs = ["cats purr and sleep"] * 30, ["dogs bark and run"] * 30
    df = spark.createDataFrame(list(enumerate(cats + dogs)), DOCS)
    rows = lm_score.cross_entropy_difference(df, spark.createDataFrame([(t,) for t in cats], "text string")).collect()
    assert max(r["score"] for r in rows if r["doc_id"] < 30) < min(r["score"] for r in rows if r["doc_id"] >= 30)


@pytest.mark.parametrize("x", [1e300, -1e300, 2.0**17, 1e9])
def test_components_that_scores_can_t_hold_are_an_error(spark, x):
    df = spark.createDataFrame([(0, [x, 1.0]), (1, [1.0, 1.0])], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="components must be within"):
        topk.top_k(df, F.col("vec_id") == 0).collect()


@pytest.mark.parametrize("name, value", [("maxPartitionBytes", "2000"), ("minPartitionNum", "50"), ("openCostInBytes", "1"), ("maxPartitionNum", "1")])
def test_files_planned_otherwise_give_the_same_scores(spark, name, value):
    rng = random.Random(3)
    docs = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.randint(0, 200))) for _ in range(300)]
    df, target = spark.createDataFrame(list(enumerate(docs)), DOCS).repartition(7), spark.createDataFrame([(docs[0],)], "text string")
    scores = lambda made: sorted((r["doc_id"], r["score"]) for r in made.collect())
    want = scores(lm_score.cross_entropy_difference(df, target, block_bytes=3000))
    made = lm_score.cross_entropy_difference(df, target, block_bytes=3000)
    spark.conf.set(f"spark.sql.files.{name}", value)
    try:
        assert scores(made) == want == scores(lm_score.cross_entropy_difference(df, target, block_bytes=3000))
    finally:
        spark.conf.unset(f"spark.sql.files.{name}")


def test_blocks_hold_runs_of_whole_texts(monkeypatch):
    texts = ["a" * 30, None, "", "b" * 200, "c" * 10, *["d" * 20] * 9]
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["__k0", "text"])

    task = type("Task", (), {"partitionId": lambda self: 3})
    monkeypatch.setattr("pyspark.TaskContext", type("Context", (), {"get": staticmethod(task)}))
    found = list(lm_score._blocks(iter((rows, rows.slice(0, 0), rows)), 100))
    assert [len(b) for b in found] == [1] * len(found) and len({b.column(0)[0].as_py() for b in found}) == len(found)
    assert [r["text"] for b in found for r in b.column(1)[0].as_py()] == texts * 2
    assert all(len(b.column(1)[0]) == 1 or sum(len(r["text"] or "") + 1 for r in b.column(1)[0].as_py()) <= 100 for b in found)


def traced_peak(run):
    """Peak bytes that Python and numpy allocate in a call."""
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("texts", [["some words " * 100] * 8000, ["some words " * 800_000]])
def test_hashing_texts_takes_memory_for_their_words_only(texts):
    size = sum(map(len, texts))
    assert traced_peak(lambda: lm_score._keys(texts)) < 16 * size


def test_hashes_are_the_same_over_any_length(monkeypatch):
    rng = random.Random(5)
    texts = [" ".join("xyz"[: rng.randint(1, 3)] * rng.randint(1, 9) for _ in range(rng.randint(0, 50))) for _ in range(40)] + [None, "", " \n", "w" * 99]
    want = lm_score._keys(texts)
    for limit in (1, 7, 64):
        monkeypatch.setattr(lm_score, "HASH_BYTES", limit)
        assert all((a == b).all() for a, b in zip(lm_score._keys(texts), want))


def test_a_part_takes_a_bounded_number_of_bytes_for_each_entry():
    rng, n = np.random.default_rng(1), 40_000
    rows = [(b, lm_score._planes(np.diff(np.unique(rng.integers(0, 1 << 50, n, np.uint64)), prepend=np.uint64(0))), lm_score._planes(np.ones(n, np.uint32))) for b in range(20)]
    assert traced_peak(lambda: [None for _ in lm_score._answered(1, rows)]) < 60 * 20 * n


@pytest.mark.parametrize("values", [[0], [1, 255], [256, 0, 7], [(1 << 64) - 1, 1 << 40]])
def test_planes_give_back_their_numbers(values):
    assert lm_score._numbers(lm_score._planes(np.array(values, np.uint64))).tolist() == values


def test_stored_blocks_are_in_small_groups_of_rows(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(lm_score, "written", lambda df, *a: kept.append(made := common.stored(df, *a)) or made[0])
    noise = F.expr("concat_ws(' ', transform(sequence(1, 3000), x -> sha2(concat(id, ':', x), 256)))")
    df = spark.range(0, 160, 1, 1).select(F.col("id").alias("doc_id"), noise.alias("text"))
    scores = lm_score.cross_entropy_difference(df, df.limit(1), block_bytes=2 << 20)
    (file,) = Path(kept[0][1].removeprefix("file:")).glob("*.parquet")
    found = pq.ParquetFile(file).metadata
    assert found.num_rows >= 10 and max(found.row_group(i).total_byte_size for i in range(found.num_row_groups)) < 12 << 20
    assert scores.count() == 160


def test_parts_follow_the_target_too(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(lm_score, "written", lambda df, *a: kept.append(made := common.written(df, *a)) or made)
    monkeypatch.setattr(lm_score, "PART_ENTRIES", 64)
    df = spark.createDataFrame([(1, "a b")], DOCS)
    target = spark.createDataFrame([(" ".join(f"w{i}" for i in range(4000)),)], "text string")
    assert lm_score.cross_entropy_difference(df, target, part_bits=1).count() == 1
    assert kept[1].where("block is null").count() > 8


def test_scores_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert lm_score.cross_entropy_difference(empty, empty).count() == 0


# --- registered queries against SQL


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        duck.sql(f"create view {path.stem} as select * from '{path}'")
    got, want = registry.queries()[name](spark, str(DATA)), duck.sql(registry.oracle_sql()[name])
    order = sorted(want.columns)
    assert sorted(got.columns) == order
    rows = lambda names, found: sorted((tuple(dict(zip(names, r))[c] for c in order) for r in found), key=str)
    assert rows(got.columns, map(tuple, got.collect())) == rows(want.columns, want.fetchall())
