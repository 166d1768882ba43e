"""The rule-based intent parser as column expressions.

`with_intent` first makes the word array a column of its own, so that the rules read it instead of splitting again.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utterscope.functions.text import trimmed, words

PARSER_VERSION = 1
MAX_TIMER_SECONDS = 86_400

# The words of the rules.
SET_ACTIONS = ("поставь", "поставьте", "поставить")
TIMER_ACTIONS = (*SET_ACTIONS, "запусти", "запустить", "включи", "включить")
TIMER_WORDS = ("таймер", "таймера", "тайга")
ON = "на"
MUSIC_ACTIONS = ("включи", "включить", "запусти", "запустить", "открой", "открою", "открыть")
MUSIC_WORDS = ("музыка", "музыку", "spotify", "спотифай", "спотик")
#: A question for the time has a word of each group of one line.
TIME_QUESTIONS = (
    (("сколько",), ("времени", "время")),
    (("который", "которые"), ("час",)),
    (("текущее", "текущий"), ("время", "час")),
    (("скажи",), ("время",)),
)
SOUND_WORDS = ("музыка", "шум", "тишина")
WRAPPERS = (("[", "]"), ("(", ")"), ("*", "*"))
UNIT_SECONDS = {
    "секунда": 1, "секунду": 1, "секунды": 1, "секунд": 1,
    "минута": 60, "минуту": 60, "минуты": 60, "минут": 60,
    "час": 3600, "часа": 3600, "часов": 3600,
}
TENS = {"двадцать": 20, "тридцать": 30, "сорок": 40, "пятьдесят": 50, "шестьдесят": 60, "семьдесят": 70, "восемьдесят": 80, "девяносто": 90}
NUMBERS = {
    "один": 1, "одна": 1, "одну": 1, "два": 2, "две": 2, "три": 3, "четыре": 4, "пять": 5, "шесть": 6, "семь": 7,
    "восемь": 8, "девять": 9, "десять": 10, "одиннадцать": 11, "двенадцать": 12, "тринадцать": 13, "четырнадцать": 14,
    "пятнадцать": 15, "шестнадцать": 16, "семнадцать": 17, "восемнадцать": 18, "девятнадцать": 19, **TENS,
}


def _map(values: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, v)]).cast("map<string,bigint>")


def _any(tokens: Column, wanted: tuple[str, ...]) -> Column:
    return F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in wanted]))


def non_speech(text: Column, tokens: Column) -> Column:
    """A text wrapped in a pair of marks, or the name of a sound alone."""
    bare = trimmed(text)
    wrapped = F.lit(False)
    for start, end in WRAPPERS:
        wrapped = wrapped | (bare.startswith(start) & bare.endswith(end))
    return ((F.size(tokens) > 0) & wrapped) | ((F.size(tokens) == 1) & F.get(tokens, F.lit(0)).isin(*SOUND_WORDS))


def asks_for_time(tokens: Column) -> Column:
    asked = F.lit(False)
    for groups in TIME_QUESTIONS:
        asked = asked | reduce(and_, (_any(tokens, group) for group in groups))
    return asked


def asks_to_play_music(tokens: Column) -> Column:
    return _any(tokens, MUSIC_ACTIONS) & _any(tokens, MUSIC_WORDS)


def amount_before(tokens: Column, i: Column) -> Column:
    """The number that stands before place i: one or two words, digits, or `на` for 1; null if none does."""
    last = F.get(tokens, i - 1)
    value = F.element_at(_map(NUMBERS), last)
    tens = F.element_at(_map(TENS), F.coalesce(F.get(tokens, i - 2), F.lit("")))
    spelled = F.when((value < 10) & tens.isNotNull(), tens + value).otherwise(value)
    return F.when(last.isNull(), F.lit(None).cast("bigint")).when(last == ON, F.lit(1).cast("bigint")).when(last.rlike("^[0-9]+$"), last.try_cast("bigint")).otherwise(spelled)


def timer_seconds(tokens: Column) -> Column:
    """Seconds that a timer phrase asks for; null if it is none, any unit lacks a number, or the sum is out of range."""
    places = F.when(F.size(tokens) > 0, F.sequence(F.lit(0), F.size(tokens) - 1)).otherwise(F.array().cast("array<int>"))
    implicit = F.exists(places, lambda i: F.get(tokens, i).isin(*SET_ACTIONS) & F.coalesce(F.get(tokens, i + 1) == ON, F.lit(False)))
    units = F.filter(places, lambda i: F.get(tokens, i).isin(*UNIT_SECONDS))
    terms = F.transform(units, lambda i: F.try_multiply(amount_before(tokens, i), F.element_at(_map(UNIT_SECONDS), F.get(tokens, i))))
    total = F.aggregate(terms, F.lit(0).cast("bigint"), lambda a, x: F.try_add(a, x))
    return F.when(_any(tokens, TIMER_ACTIONS) & (_any(tokens, TIMER_WORDS) | implicit) & total.between(1, MAX_TIMER_SECONDS), total)


def with_intent(df: DataFrame, text: str, intent: str = "current_intent", seconds: str | None = None) -> DataFrame:
    """Add the parsed intent, and the timer's seconds if a name is given; both are null where the text is."""
    tokens, timer = F.col("__tokens"), F.col("__timer")
    parsed = df.withColumn("__tokens", words(F.col(text))).withColumn("__timer", timer_seconds(tokens))
    name = (
        F.when(F.col(text).isNull(), F.lit(None).cast("string"))
        .when(non_speech(F.col(text), tokens), "no_speech")
        .when(asks_for_time(tokens), "tell_time")
        .when(timer.isNotNull(), "set_timer")
        .when(asks_to_play_music(tokens), "play_music")
        .otherwise("unknown")
    )
    parsed = parsed.withColumn(intent, name)
    if seconds:
        parsed = parsed.withColumn(seconds, F.when(F.col(intent) == "set_timer", timer))
    return parsed.drop("__tokens", "__timer")


def slots(intent: Column, seconds: Column) -> Column:
    """The command's slots: the duration of a timer, else none."""
    none = F.create_map().cast("map<string,string>")
    return F.when(intent == "set_timer", F.create_map(F.lit("duration_seconds"), seconds.cast("string"))).otherwise(none)
