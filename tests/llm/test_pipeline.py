"""The pipeline's stages, each on its own input, and as a whole."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from utterscope.llm import secrets as S
from utterscope.llm.token_count import default_vocabulary, encoder

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Documents with planted cases: junk, copies, benchmark passages and secrets among clean ones."""
    rng = random.Random(8)
    pool = [f"word{i}" for i in range(800)]
    text = lambda n: " ".join(rng.choice(pool) for _ in range(n)).capitalize() + "."
    bench = [text(14) for _ in range(5)]
    clean = [text(rng.randint(60, 200)) for _ in range(80)]
    rows = dict(enumerate(clean))
    rows |= {100 + i: " ".join(w + "###" for w in clean[i].split()) for i in range(30)}  # junk
    rows |= {200 + i: clean[0] for i in range(6)} | {210 + i: clean[1] for i in range(3)}  # copies
    long = text(2000)
    rows |= {220: long, 221: " ".join("changed" if k % 120 == 7 else w for k, w in enumerate(long.split()))}  # near copies
    rows |= {300: f"{clean[2]} {bench[0].upper()} {text(50)}", 301: bench[1]}
    rows |= {400: f"{text(40)} token = 'abcdef0123456789abcdef0123456789' {text(40)}"}
    rows |= {500: None, 501: ""}
    root = tmp_path_factory.mktemp("data")
    docs = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows.items()]
    spark.createDataFrame(docs, SCHEMA).write.parquet(str(root / "documents.parquet"))
    labels = [(i, int(i < 100), 0) for i in rows if i < 130]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(root / "labels.parquet"))
    spark.createDataFrame(list(enumerate(bench)), "item_id bigint, text string").write.parquet(str(root / "benchmark.parquet"))
    return str(root)


def stage(spark, sf_dir, name):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = dict(P.STAGES)[name](spark, docs, sf_dir)
    if name != "packing":
        assert got.columns == docs.columns and [f.dataType for f in got.schema] == [f.dataType for f in docs.schema]
    return {r["doc_id"]: r for r in got.collect()}, {r["doc_id"]: r for r in docs.collect()}


def test_names():
    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "benchmark", "secrets", "packing"]


def test_quality(spark, sf_dir):
    got, _ = stage(spark, sf_dir, "quality")
    assert not any(100 <= i < 130 for i in got) and set(range(80)) <= set(got)


def test_near_duplicates(spark, sf_dir):
    got, docs = stage(spark, sf_dir, "near_duplicates")
    assert not any(200 <= i <= 212 for i in got) and 221 not in got and {220, *range(80)} <= set(got)

    def shingles(text):
        words = (text or "").lower().split()
        return {tuple(words[k : k + P.SHINGLE]) for k in range(max(1, len(words) - P.SHINGLE + 1))} if words else {()}

    sets = {i: shingles(r["text"]) for i, r in docs.items()}

    def linked(i, j):
        return len(sets[i] & sets[j]) >= P.SIMILAR * len(sets[i] | sets[j])

    links = {i: {j for j in docs if linked(i, j)} for i in docs}
    reach = {}
    for i in sorted(docs):
        if i not in reach:
            todo = [i]
            while todo:
                j = todo.pop()
                if j not in reach:
                    reach[j] = i
                    todo += links[j]
    assert set(got) == set(reach.values())


def shuffled(spark):
    """Bytes that tasks have written to shuffles so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return spark.sparkContext._jsc.sc().statusStore().executorList(False).head().totalShuffleWrite()


def test_near_duplicates_leave_other_texts_in_place(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, rng.randbytes(15_000).hex(" ", 3), "en", "s", 1) for i in range(400)]
    rows += [(500 + i, f"{rows[i][1]} tail", "en", "s", 1) for i in range(8)] + [(7, "another text", "en", "s", 1)] * 2
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for many ids
    try:
        start = shuffled(spark)
        got = P.near_duplicates(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), "").collect()
        moved = shuffled(spark) - start
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted(r["doc_id"] for r in got) == list(range(400))
    assert 0 < moved < 0.5 * sum(len(r[1]) for r in rows), moved


def test_benchmark(spark, sf_dir):
    got, docs = stage(spark, sf_dir, "benchmark")
    assert 301 not in got and len(got) == len(docs) - 1
    assert len(got[300]["text"].split()) < len(docs[300]["text"].split()) - 10 and got[300]["n_chars"] == len(got[300]["text"])
    assert all(got[i] == docs[i] for i in got if i != 300)


def test_secrets(spark, sf_dir):
    got, docs = stage(spark, sf_dir, "secrets")
    assert "abcdef0123456789" not in got[400]["text"] and S.scan(got[400]["text"], S.default_model())[1] == []
    assert all(got[i] == docs[i] for i in docs if i != 400) and len(got) == len(docs)


def test_packing(spark, sf_dir):
    got, docs = stage(spark, sf_dir, "packing")
    assert set(got) == set(docs)
    encode = encoder(default_vocabulary()).encode
    assert all(r["n_tokens"] == len(encode(docs[i]["text"] or "")) <= r["bucket_len"] for i, r in got.items())


def test_whole_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, f in P.STAGES:
        docs = spark.createDataFrame(f(spark, docs, sf_dir).collect(), f(spark, docs, sf_dir).schema)
    order = ["doc_id", "n_tokens"]
    assert sorted(map(tuple, P.run(spark, sf_dir).select(order).collect())) == sorted(map(tuple, docs.select(order).collect()))


def test_clashing_columns_nulls_and_repeats(spark, sf_dir):
    rows = [(1, "a text of some words here", None, None, None), (1, "a text of some words here", None, None, None), (None, None, None, None, None), (2, "w " * 50_000, "l", "s", 3)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("fp", F.lit("x")).withColumn("score", F.lit(1)).withColumn("n_tokens", F.lit(1)).withColumn("component_id", F.lit(None).cast("string"))
    for name, f in P.STAGES[:-1]:
        assert f(spark, docs, sf_dir).columns == docs.columns, name
    assert P.packing(spark, docs, sf_dir).count() == 4
    assert P.near_duplicates(spark, docs, sf_dir).count() == 3
    for name, f in P.STAGES:
        assert f(spark, docs.limit(0), sf_dir).count() == 0, name
