"""Spoken responses and durations as column expressions, and rates as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word forms and responses.
HOURS = ("час", "часа", "часов")
MINUTES = ("минуту", "минуты", "минут")
SECONDS = ("секунду", "секунды", "секунд")
MUSIC_RESPONSE = "Открываю Spotify."
UNSUPPORTED_RESPONSE = "Команда пока не поддерживается."


def plural(value: Column, forms: tuple[str, str, str]) -> Column:
    one, few, many = forms
    last, last_two = value % 10, value % 100
    return (
        F.when((last == 1) & (last_two != 11), one)
        .when(last.between(2, 4) & ~last_two.between(12, 14), few)
        .otherwise(many)
    )


def duration_text(seconds: Column) -> Column:
    """Hours, minutes and seconds in words; the parts that are zero are left out, but for zero seconds alone."""
    hours, minutes, rest = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60

    def part(value: Column, forms: tuple[str, str, str], shown: Column) -> Column:
        return F.when(shown, F.concat_ws(" ", value.cast("bigint").cast("string"), plural(value, forms)))

    return F.concat_ws(" ", part(hours, HOURS, hours > 0), part(minutes, MINUTES, minutes > 0), part(rest, SECONDS, (rest > 0) | (seconds == 0)))


def timer_response(seconds: Column) -> Column:
    return F.concat(F.lit("Таймер установлен на "), duration_text(seconds), F.lit("."))


def time_response(moment: Column) -> Column:
    return F.concat(F.lit("Сейчас "), F.date_format(moment, "HH:mm"), F.lit("."))


def response(intent: Column, seconds: Column, moment: Column) -> Column:
    """What is answered to a command; null for an annotation of non-speech."""
    return (
        F.when(intent == "tell_time", time_response(moment))
        .when(intent == "play_music", MUSIC_RESPONSE)
        .when(intent == "set_timer", timer_response(seconds))
        .when(intent == "unknown", UNSUPPORTED_RESPONSE)
    )


def rate_text(rate: float | None) -> str:
    return "n/a" if rate is None else f"{rate * 100:.1f}%"
