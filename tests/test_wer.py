import random

from pyspark.sql import functions as F

from utterscope.functions.wer import rate, word_errors


def expected(reference, hypothesis):
    """Full table, walked back with the order match, substitution, deletion, insertion."""
    n, m = len(reference), len(hypothesis)
    d = [[i + j if 0 in (i, j) else 0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            same = reference[i - 1] == hypothesis[j - 1]
            d[i][j] = d[i - 1][j - 1] if same else 1 + min(d[i - 1][j - 1], d[i - 1][j], d[i][j - 1])
    s = dele = ins = 0
    while n or m:
        if n and m and reference[n - 1] == hypothesis[m - 1]:
            n, m = n - 1, m - 1
        elif n and m and d[n][m] == d[n - 1][m - 1] + 1:
            s, n, m = s + 1, n - 1, m - 1
        elif n and d[n][m] == d[n - 1][m] + 1:
            dele, n = dele + 1, n - 1
        else:
            ins, m = ins + 1, m - 1
    return s, dele, ins


def test_random_pairs(spark):
    rng = random.Random(9)
    pairs = [([rng.choice("abcd") for _ in range(rng.randint(0, 7))], [rng.choice("abcd") for _ in range(rng.randint(0, 7))]) for _ in range(1200)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>")
    got = {r["i"]: (r["e"]["s"], r["e"]["d"], r["e"]["i"], r["e"]["c"]) for r in df.select("i", word_errors(F.col("a"), F.col("b")).alias("e")).collect()}
    for i, (a, b) in enumerate(pairs):
        e = expected(a, b)
        assert got[i] == (*e, sum(e)), (a, b)


def test_rate(spark):
    row = spark.range(1).select(rate(F.lit(1), F.lit(4)).alias("a"), rate(F.lit(1), F.lit(0)).alias("b")).first()
    assert row["a"] == 0.25 and row["b"] is None


def plain_errors(ref, hyp):
    """The same by the table, cell by cell."""
    table = {}
    for x in range(len(ref) + 1):
        for y in range(len(hyp) + 1):
            if not x or not y:
                table[x, y] = (x + y, 0, x, y)
                continue
            diagonal, up, left = table[x - 1, y - 1], table[x - 1, y], table[x, y - 1]
            if ref[x - 1] == hyp[y - 1]:
                table[x, y] = diagonal
            elif diagonal[0] <= up[0] and diagonal[0] <= left[0]:
                table[x, y] = (diagonal[0] + 1, diagonal[1] + 1, diagonal[2], diagonal[3])
            elif up[0] <= left[0]:
                table[x, y] = (up[0] + 1, up[1], up[2] + 1, up[3])
            else:
                table[x, y] = (left[0] + 1, left[1], left[2], left[3] + 1)
    return table[len(ref), len(hyp)]


def test_errors_are_those_of_the_table():
    import random
    import time

    from utterscope.functions.wer import errors

    rng = random.Random(5)
    for _ in range(800):
        ref, hyp = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        assert errors(ref, hyp) == plain_errors(ref, hyp)
    long = [rng.choice("abcdefgh") for _ in range(800)]
    began = time.process_time()
    errors(long, long[5:] + ["z"] * 9)
    assert time.process_time() - began < 0.5
