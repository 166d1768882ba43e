import random

import pytest
from pyspark.sql import functions as F

from utterscope.functions.intent import MAX_TIMER_SECONDS, NUMBERS, TENS, UNIT_SECONDS, slots, with_intent
from utterscope.functions.text import normalized, trimmed
from utterscope.plans.adapter import BANK

CASES = [
    ("сколько сейчас время", "tell_time", None),
    ("подскажи, КОТОРЫЕ сейчас час?", "tell_time", None),
    ("скажи время", "tell_time", None),
    ("текущий час", "tell_time", None),
    ("который день", "unknown", None),
    ("запусти музыку", "play_music", None),
    ("открыть СПОТИФАЙ!", "play_music", None),
    ("музыка", "no_speech", None),
    ("музыка играет", "unknown", None),
    ("поставьте таймер на одну минуту тридцать секунд", "set_timer", 90),
    ("поставить на сорок две секунды", "set_timer", 42),
    ("включить тайга на 3 часа", "set_timer", 10_800),
    ("поставь таймер на 24 часа", "set_timer", 86_400),
    ("поставь таймер на 24 часа 1 секунду", "unknown", None),
    ("поставь таймер на 0 секунд", "unknown", None),
    ("поставь таймер", "unknown", None),
    ("таймер на пять секунд", "unknown", None),
    ("поставь таймер на пять секунд минут", "unknown", None),
    ("поставь таймер на 99999999999999999999 секунд", "unknown", None),
    ("поставь таймер на 9223372036854775807 часов", "unknown", None),
    ("включи музыку через минуту таймер", "play_music", None),
    ("скажи время и поставь таймер на минуту", "tell_time", None),
    ("[a] b [c]", "no_speech", None),
    ("*", "unknown", None),
    ("[]", "unknown", None),
    (" (шум)\t", "no_speech", None),
    ("", "unknown", None),
    (None, None, None),
    *[(r[1], r[4], r[5]) for r in BANK],
]


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_phrases(spark, ansi):
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(CASES)], "i int, t string")
        got = {r["i"]: (r["current_intent"], r["s"]) for r in with_intent(df, "t", seconds="s").collect()}
    finally:
        spark.conf.set("spark.sql.ansi.enabled", "true")
    assert got == {i: (intent, s) for i, (_, intent, s) in enumerate(CASES)}


def _amount(words, i):
    if i < 1:
        return None
    last = words[i - 1]
    if last == "на":
        return 1
    if last.isdigit() and last.isascii():
        return int(last) if int(last) < 2**63 else None
    value = NUMBERS.get(last)
    if value is not None and value < 10 and i >= 2 and words[i - 2] in TENS:
        return TENS[words[i - 2]] + value
    return value


def _seconds(words):
    actions = {"поставь", "поставьте", "поставить"}
    if not (actions | {"запусти", "запустить", "включи", "включить"}) & set(words):
        return None
    if not {"таймер", "таймера", "тайга"} & set(words) and not any(a in actions and b == "на" for a, b in zip(words, words[1:])):
        return None
    total = 0
    for i, w in enumerate(words):
        if w in UNIT_SECONDS:
            n = _amount(words, i)
            if n is None:
                return None
            total += n * UNIT_SECONDS[w]
    return total if 1 <= total <= MAX_TIMER_SECONDS else None


def test_random_timers(spark):
    rng = random.Random(4)
    numbers, units = ["7", "60", "пять", "двадцать", "сорок", "одну", "десять", "двадцать пять", "на", "вот", ""], list(UNIT_SECONDS)
    starts = ["поставь таймер", "поставь", "включи таймер", "таймер", "запусти тайга"]

    def phrase():
        parts = [rng.choice(starts), rng.choice(["на", ""])]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(numbers), rng.choice(units)]
        return " ".join(p for p in parts if p)

    texts = [phrase() for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: r["s"] for r in with_intent(df, "t", seconds="s").collect()}
    assert sum(v is not None for v in got.values()) > 50
    assert got == {i: _seconds(t.split()) for i, t in enumerate(texts)}


def test_slots_and_text(spark):
    row = spark.range(1).select(
        slots(F.lit("set_timer"), F.lit(60)).alias("a"), slots(F.lit("unknown"), F.lit(None).cast("bigint")).alias("b"),
        normalized(F.lit("  Открой, SPOTIFY!  ½ ²x ")).alias("n"), trimmed(F.lit("\t  a b \n")).alias("t"),
    ).first()
    assert row["a"] == {"duration_seconds": "60"} and row["b"] == {}
    assert row["n"] == "открой spotify ½ ²x" and row["t"] == "a b"
