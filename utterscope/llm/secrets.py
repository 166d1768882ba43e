"""Secret scans: character Markov models of random strings and of ordinary identifiers, compared by log-likelihood ratio.

Two first-order character models are trained from a file of labelled samples (key_samples.tsv: 1 or 0 for random or not, and
the text; a fifth of them is held out for tests). They score every long run of key-like characters. A run whose mean ratio
favours the random model is a secret; of another, the stretches are that windows of MIN_RUN characters with such a mean
cover, from where the sum of ratios rises to where it falls, and out to the ends of their words. So ordinary characters
joined to a secret don't water it down. Patterns for assignments, access keys and long hexadecimal runs give the base
spans; the models add spans ("markov") in what those leave of a run. Each character is scored once.

Defined results: a null text is empty and has no spans; positions are code points, ends exclusive; spans of one start are in
the order of their kinds; very long texts are scanned whole; repeated rows are scanned each; an empty table gives an empty
result; further columns of the input are not read by the scan and are kept by `redact`.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import cache, partial
from importlib.resources import files

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from utterscope.llm.arrays import runs
from utterscope.llm.common import map_texts, safe_names, table

#: Patterns of the base kinds, in their order. Fixed values.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run, as [0-9a-f]+ with 24 characters or more is
MIN_ASSIGN, MIN_ACCESS = 6, 20

#: Runs that the models look at: key-like characters, with a letter among them.
MIN_RUN = 20
CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{MIN_RUN},}}", re.ASCII)
LETTER = re.compile(r"[A-Za-z]")
MIN_RATIO = 0.35

_ALPHABET = string.ascii_letters + string.digits + "+/_=-"
_CODE = np.full(128, len(_ALPHABET), dtype=np.int64)
_CODE[[ord(c) for c in _ALPHABET]] = np.arange(len(_ALPHABET))
_STATES = len(_ALPHABET) + 1

HELD_OUT = 5


def labelled_samples(held_out: bool | None = False) -> list[tuple[str, bool]]:
    """(text, is_random) of the sample file: every fifth line if held out, the others if not, all for None."""
    lines = files("utterscope.llm").joinpath("key_samples.tsv").read_text("utf-8").splitlines()
    split = (line.split("\t", 1) for i, line in enumerate(lines) if held_out is None or (i % HELD_OUT == 0) == held_out)
    return [(text, label == "1") for label, text in split]


@dataclass(frozen=True)
class MarkovRatio:
    """Log-likelihood ratio tables of the two models: of the first character and of each transition."""

    first: np.ndarray
    step: np.ndarray

    @classmethod
    def train(cls, samples: Iterable[tuple[str, bool]], smoothing: float = 0.5) -> MarkovRatio:
        first = np.full((2, _STATES), smoothing)
        step = np.full((2, _STATES, _STATES), smoothing)
        for text, is_random in samples:
            codes = encode(text)
            if len(codes):
                first[int(is_random), codes[0]] += 1
                np.add.at(step[int(is_random)], (codes[:-1], codes[1:]), 1)
        logs = [np.log(x / x.sum(axis=-1, keepdims=True)) for x in (first, step)]
        return cls(logs[0][1] - logs[0][0], logs[1][1] - logs[1][0])

    def ratios(self, text: str) -> np.ndarray:
        """The log-likelihood ratio of each character, above 0 where the random model explains it better."""
        codes = encode(text)
        return np.append(self.first[codes[:1]], self.step[codes[:-1], codes[1:]])

    def ratio(self, text: str) -> float:
        """Mean ratio a character."""
        return float(self.ratios(text).mean()) if text else 0.0


def encode(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(points < 128, _CODE[np.minimum(points, 127)], _STATES - 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, leftmost and non-overlapping within each kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def free_runs(text: str, taken: Sequence[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """What the taken spans (in order of their starts) leave of the runs of key-like characters, where that is long enough."""
    k, reach = 0, 0
    for m in CANDIDATE.finditer(text):
        at = max(m.start(), reach)
        while k < len(taken) and taken[k][0] < m.end():
            start, _, end = taken[k]
            if start - at >= MIN_RUN:
                yield at, start
            reach = max(reach, end)
            at = max(at, reach)
            k += 1
        if m.end() - at >= MIN_RUN:
            yield at, m.end()


def model_spans(text: str, model: MarkovRatio, taken: Sequence[tuple[int, int, int]], least: float) -> list[tuple[int, int, int]]:
    return [(s + a, 3, s + b) for s, e in free_runs(text, taken) for a, b in random_parts(text[s:e], model, least)]


def random_parts(run: str, model: MarkovRatio, least: float) -> list[tuple[int, int]]:
    """The run, if the random model explains it better, or else those of its stretches."""
    if not LETTER.search(run):
        return []
    ratios = model.ratios(run)
    if ratios.mean() >= least:
        return [(0, len(run))]
    total = np.concatenate(([0.0], np.cumsum(ratios - least)))
    high = total[MIN_RUN:] >= total[:-MIN_RUN]
    found: list[tuple[int, int]] = []
    for s, e in zip(*runs(high)):
        s, e = int(s), int(e) + MIN_RUN - 1
        start = s + int(np.argmin(total[s : s + MIN_RUN]))
        end = e - MIN_RUN + 1 + int(np.argmax(total[e - MIN_RUN + 1 : e + 1]))
        while start > 0 and run[start - 1].isalnum() and (not found or start > found[-1][1]):
            start -= 1
        while end < len(run) and run[end].isalnum():
            end += 1
        start = max(start, found[-1][1]) if found else start
        if end - start >= MIN_RUN // 2 and LETTER.search(run, start, end):
            found.append((start, end))
    return found


def scan(text: str | None, model: MarkovRatio, least: float = MIN_RATIO) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans, each sorted by start and kind."""
    if not text:
        return [], []
    base = base_spans(text)
    return base, sorted(base + model_spans(text, model, base, least))


def joined(spans: Sequence[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _digest(texts: Sequence[str | None], model: MarkovRatio, least: float) -> dict[str, list]:
    got = [scan(t, model, least) for t in texts]
    columns: dict[str, list] = {f"n_{KINDS[k]}": [sum(x[1] == k for x in base) for base, _ in got] for k in range(3)}
    columns["base_sha256"] = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in got]
    columns["spans"] = [joined(spans) for _, spans in got]
    return columns


@cache
def default_model() -> MarkovRatio:
    return MarkovRatio.train(labelled_samples())


def scan_secrets(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), model: MarkovRatio | None = None, least: float = MIN_RATIO) -> DataFrame:
    """`keep`, n_assign, n_access, n_hex, base_sha256 and spans of each row's whole text."""
    fields = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS[:3]]
    fields += [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
    return map_texts(docs, text, partial(_digest, model=model or default_model(), least=least), fields, keep)


def mask(text: str | None, model: MarkovRatio, least: float, mark: str) -> str | None:
    """The text with each secret, and spans that overlap it, replaced by one mark."""
    spans = scan(text, model, least)[1]
    if not spans:
        return text
    out, at, end = [], 0, -1
    for s, _, e in spans:
        if s >= end:
            out += [text[at:s], mark]
        end = at = max(end, e)
    return "".join(out) + text[at:]


def _masked(texts: Sequence[str | None], model: MarkovRatio, least: float, mark: str) -> dict[str, list]:
    return {"__masked": [mask(t, model, least, mark) for t in texts]}


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]", model: MarkovRatio | None = None, least: float = MIN_RATIO) -> DataFrame:
    """All rows and columns, with the secrets of `text` replaced by `mark`; a null text stays null."""
    plain, names = safe_names(docs)
    masked = partial(_masked, model=model or default_model(), least=least, mark=mark)
    made = map_texts(plain, names[text], masked, [T.StructField("__masked", T.StringType())], [n for c, n in names.items() if c != text])
    return made.select(*[F.col("__masked" if c == text else n).alias(c) for c, n in names.items()])


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))
