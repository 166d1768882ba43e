"""Vector codes, spelling variants and the BPE codec against brute force and the library."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest

from utterscope.llm import bpe as B
from utterscope.llm import spelling as W
from utterscope.llm import token_count as K
from utterscope.llm import vector_codes as V

DATA = Path("/root/testdata/sf0.001")


# --- vector codes


@pytest.mark.parametrize("scale", [1, 40, 2**20, 2**28])
@pytest.mark.parametrize("width", [1, 3, 4, 6, 16])
def test_nearest_entries_are_those_of_all_distances(scale, width):
    rng = np.random.default_rng(width)
    entries = rng.integers(-scale, scale + 1, (50, width))
    entries[7] = entries[20]  # a tie
    rows = np.concatenate([rng.integers(-scale, scale + 1, (700, width)), entries])
    entry, least = V.Codebook(entries).nearest(rows)
    apart = ((rows[:, None].astype(object) - entries[None].astype(object)) ** 2).sum(axis=2)
    assert entry.tolist() == [min(range(50), key=lambda e: (d[e], e)) for d in apart] and least.tolist() == [min(d) for d in apart]


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id bigint, embedding array<float>, label int, __vector string, part int")


def plain_codes(rows, parts, entries, rounds, scale):
    """The contract in plain loops; rows are (id, vector, label)."""
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = [near(c[p], books[p])[1] for c in cut]
            for e in set(own):
                mine = [c[p] for c, o in zip(cut, own) if o == e]
                books[p][e] = [sum(col) // len(mine) for col in zip(*mine)]
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    return [(i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f)) for (i, _, _), f in zip(kept, found)], books


def test_codes_are_those_of_plain_loops(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)], i % 3 or None) for i in range(300)]
    rows += [(7, None, 1), (8, [math.nan] * 8, 1), (9, [None] + [0.0] * 7, 1), (10, [math.inf] * 8, 2), (None, [0.5] * 8, None), (11, rows[11][1], 2)]
    want, books = plain_codes(rows, 4, 16, 4, 1024)
    made = V.train(vectors(spark, rows), entries=16)
    assert [b.entries.tolist() for b in made.books] == books
    got = V.encode(vectors(spark, rows), made, ["vec_id"]).collect()
    assert sorted(map(str, [tuple(r) for r in got])) == sorted(map(str, want))


def test_errors_of_labels_by_either_join(spark):
    rows = [(i, f"c{i}", i * 10, None if i % 4 == 0 else i % 4) for i in range(200)]
    codes = spark.createDataFrame(rows, "vec_id bigint, code string, error bigint, label int")
    total = Counter()
    for *_, error, label in rows:
        total[label] += error
    for bound in (1000, 1):
        got = V.label_errors(codes, bound=bound).collect()
        assert sorted((r["vec_id"], r["label_error"]) for r in got) == [(i, total[label]) for i, _, _, label in rows]


def test_few_no_and_odd_vectors(spark, tmp_path):
    assert V.train(vectors(spark, [(1, None, 1), (2, [], 1), (3, [1.0] * 6, 1)])) is None
    made = V.train(vectors(spark, [(1, [1.0] * 4, 1), (2, [2.0] * 8, 1), (3, [3.0] * 4, 1), (4, [1.0] * 7, 1)]))
    assert made.dim == 4 and [len(b.entries) for b in made.books] == [2] * 4
    got = V.encode(vectors(spark, [(1, [1.0] * 4, 1), (2, [2.0] * 8, 1)]), made, ["vec_id", "part"]).collect()
    assert [tuple(r) for r in got] == [(1, 1, "00000000", 0)]
    vectors(spark, []).write.parquet(str(tmp_path / "embeddings.parquet"))
    empty = V.op11_vector_codes(spark, str(tmp_path))
    assert empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and empty.count() == 0
    with pytest.raises(Exception, match="components must be within"):
        V.encode(vectors(spark, [(1, [1e30] * 4, 1)]), made, ["vec_id"]).collect()


# --- spelling variants


def near(a, b):
    """Whether the words differ by exactly one letter, by a table of all prefixes."""
    if abs(len(a) - len(b)) > 1:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1] == 1


def test_near_pairs_are_all_and_each_once(spark):
    rng = random.Random(3)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(4, 8))) for _ in range(400)}
    words |= {"aaaaaa", "aaaaaaa", "aaaaab", "ÿaaaaa", "z" * 5000, "z" * 4999, "z" * 4998 + "y"}
    words |= {"".join(rng.sample("abcdef", 6)) for _ in range(300)}  # anagrams
    df = spark.createDataFrame([(w, i) for i, w in enumerate(sorted(words))], "word string, n bigint")
    got = [tuple(sorted((r["word"], r["other"]))) for r in W.near_pairs(df).collect()]
    short = sorted(w for w in words if len(w) < 20)
    want = {(a, b) for k, a in enumerate(short) for b in short[k + 1 :] if near(a, b)}
    want |= {("z" * 4999, "z" * 5000), ("z" * 4998 + "y", "z" * 4999)}
    assert len(got) == len(set(got)) and set(got) == {tuple(sorted(p)) for p in want}


def plain_words(docs):
    """The contract in plain loops; docs are (id, text)."""
    count = Counter()
    for doc_id, text in docs:
        for run in re.findall(W.LETTERS, text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            at = h % len(run)
            count[run[:at] + run[at + 1 :] if h % 199 == 0 else run] += 1
    n = {w: k for w, k in count.items() if len(w) >= 6 and k >= 5}
    friends = {w: [x for x in n if near(w, x)] for w in n}
    best = {w: min(f, key=lambda x: (-n[x], x)) for w, f in friends.items() if f}
    form = {w: b if n[b] >= 5 * n[w] else None for w, b in best.items()}
    rows = []
    for w in n:
        root = w
        while form.get(root):
            root = form[root]
        rows.append((w, form.get(w), root, n[w], len(friends[w]), n[form[w]] if form.get(w) else None))
    return rows


def test_words_are_those_of_plain_loops(spark, tmp_path):
    rng = random.Random(8)
    bank = ["running", "runing", "runninge", "Straße", "strasse", "Straßen", "ÉCOLEs", "école", "écoles", "abcdefg", "abcdef", "abcdefgh", "zzzzzzzz"]
    weights = [625, 125, 25, 60, 12, 300, 5, 9, 90, 50, 400, 7, 40]
    texts = [" ".join(rng.choices(bank, weights, k=30)) for _ in range(60)] + [None, "", "×÷×÷×÷ " * 6, "running " * 400, "123"]
    docs = [(i if i % 9 else None, t) for i, t in enumerate(texts)]
    spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id bigint, text string, word string, key int").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in W.op12_spelling(spark, str(tmp_path)).collect()]
    want = plain_words(docs)
    assert sorted(got, key=str) == sorted(want, key=str) and sum(r[1] is not None and r[2] != r[1] for r in want) >= 1


def test_roots_follow_long_chains(spark):
    forms = spark.createDataFrame([(f"w{i}", 5**i, f"w{i + 1}" if i < 20 else None) for i in range(21)], "word string, n bigint, form string")
    assert {r["root"] for r in W.with_roots(forms).collect()} == {"w20"}
    assert W.with_roots(forms.limit(0)).count() == 0


# --- BPE


def encoded(texts):
    v = B.vocabulary(K.default_vocabulary())
    ids, counts = B.encode_batch(v, texts)
    upto = np.concatenate([[0], np.cumsum(counts)])
    return [ids[a:b].tolist() for a, b in zip(upto, upto[1:])], B.decode_batch(v, ids, counts)


def held_to_the_library(texts):
    library = K.encoder(K.default_vocabulary())
    ids, back = encoded(texts)
    for t, own, decoded, want in zip(texts, ids, back, library.encode_batch([t or "" for t in texts], add_special_tokens=False)):
        assert own == want.ids and decoded == library.decode(want.ids, skip_special_tokens=False), repr(t)[:100]


def test_ids_and_texts_are_the_library_s():
    rng = random.Random(1)
    parts = ["a", "B", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", chr(0x2003), "'s", "'", "é", "1", "!", "<|endoftext|>", "<|endo", "x" * 70, "漢", "😀", "\x00", "hello", "ing"]
    held_to_the_library(["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + [None, "", "<|endoftext|>" * 3])


def test_every_kind_of_character():
    chars = [chr(c) for c in (*range(0x3000), *range(0x3000, 0x30000, 37), *range(0xE0000, 0xE0200)) if not 0xD800 <= c <= 0xDFFF]
    held_to_the_library([f"a{c}b 1{c}2 !{c}? {c} {c}{c}" for c in chars])


def test_long_words_and_texts(monkeypatch):
    rng = random.Random(2)
    letters = ["".join(rng.choice("abcdefgh") for _ in range(n)) for n in (63, 64, 65, 1023, 1024, 1025, 5000)]
    held_to_the_library([*letters, " " * 3000, "ab" * 20_000, "word " * 60_000, "e" * 4096])
    monkeypatch.setattr(B, "WORDS", 7)
    monkeypatch.setattr(B, "NEW_WORDS", 3)
    monkeypatch.setattr(B, "KEPT_WORDS", 20)
    B.vocabulary(K.default_vocabulary()).forget()
    held_to_the_library(["the quick brown fox jumps over the lazy dog " * 9, "<|endoftext|>a b", *letters[:3]])


def test_ids_that_are_not_there(spark):
    rows = [(1, [15496, None, 999999, -5, 0], "x"), (2, None, "x"), (3, [], "x"), (4, [128], "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, ids array<int>, __values string")
    library = K.encoder(K.default_vocabulary())
    got = {r["doc_id"]: r["text"] for r in B.decode(df).collect()}
    assert got == {1: library.decode([15496, 0]), 2: "", 3: "", 4: library.decode([128])}
    assert B.encode(df.limit(0), text="__values").count() == 0


def test_codec_query(spark, tmp_path):
    library = K.encoder(K.default_vocabulary())
    texts = [r[0] for r in duckdb.sql(f"select text from '{DATA}/documents.parquet'").fetchall()] + [None, "", "tie", "tie", "é" * 3000]
    spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string").write.parquet(str(tmp_path / "documents.parquet"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, e in enumerate(library.encode_batch([t or "" for t in texts], add_special_tokens=False)):
        want.append((i, len(e.ids), sha(",".join(map(str, e.ids))), sha(library.decode(e.ids, skip_special_tokens=False))))
    got = B.op13_bpe_codec(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and sorted(map(tuple, got.collect())) == want
