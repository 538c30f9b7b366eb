"""Text decoded with the wrong character set, and the text as it was typed (problem 2).

Adjacent character pairs are scored by their mutual information: how much more often a pair stands in clean rows than its
characters' frequencies in all rows would have it. Pairs of damage, however common, stand in no clean row.
Maximum-scoring segments of improbability isolate runs, and inverse mappings (encode by one character set, decode by
another, up to four times) are tried inside the runs only; the reading with the most mutual information wins.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Character sets that text may have been decoded with, and those it may have been written in.
READ_AS = ["cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251", "cp1250", "iso8859-15"]
WRITTEN_IN = ["utf-8", "cp1252", "mac_roman", "cp850"]
MAX_DEPTH = 4
#: Independence weighs this much beside what was counted: a pair that clean rows never show scores log(PRIOR / (1 + PRIOR)).
PRIOR = 0.01
#: The trusted texts weigh this share of the corpus, so that none of their pairs is unseen at any size.
TRUST = 0.05
#: The improbability of a pair is the threshold minus its score.
THRESHOLD = 0.0
#: A restored text must carry this much more mutual information than the damaged one.
GAIN = 2.0
REPLACEMENT = "�"


def _encode(s: str, how: str) -> bytes | None:
    out = bytearray()
    for ch in s:
        try:
            out += ch.encode(how)
        except UnicodeEncodeError:
            # Windows keeps the bytes that its code pages leave undefined as control characters.
            if how in ("cp1252", "cp1250", "cp1251") and 0x80 <= ord(ch) <= 0x9F:
                out.append(ord(ch))
            else:
                return None
    return bytes(out)


def _decode(b: bytes, how: str) -> str | None:
    try:
        return b.decode(how)
    except UnicodeDecodeError:
        if how != "cp1252":
            return None
        return "".join(bytes([x]).decode("cp1252", "ignore") or chr(x) for x in b)


def _reread(s: str, read_as: str, written: str) -> str | None:
    """The text with its bytes by one character set read by another; None if that can't be, or makes anything but text."""
    if written != "utf-8" and "\xa0" in s:
        # Odd spaces are older than the damage.
        parts = [_reread(t, read_as, written) for t in s.split("\xa0")]
        return None if None in parts else "\xa0".join(parts)
    coded = _encode(s, read_as)
    got = _decode(coded, written) if coded is not None else None
    if got is None or any("\x00" <= ch < " " and ch not in "\t\n\r" for ch in got):
        return None
    # Single bytes are believed to be letters only.
    return got if written == "utf-8" or all(ch.isascii() or ch.isalpha() for ch in got) else None


class CorpusModel(NamedTuple):
    """Mutual information of the character pairs of clean text, and that of any other pair."""

    scores: dict[str, float]
    unseen: float


def clean_variants(names: list[str]) -> list[str]:
    """Names in the cases that people type them in."""
    return sorted({v for n in names for v in (n, n.lower(), n.upper(), n.title(), n[:1].lower() + n[1:].upper())})


def _spaced(s: str) -> str:
    return s.translate({9: " ", 0xA0: " "})


def _pairs_of(s: str) -> list[str]:
    s = _spaced(s)
    return [s[i : i + 2] for i in range(len(s) - 1)]


def corpus_model(values: DataFrame, value_col: str, trusted: list[str], count_col: str | None = None) -> CorpusModel:
    """Smoothed pointwise mutual information of character pairs, counted over all rows.

    A row is clean if all that goes beyond ASCII in it are letters of ``trusted`` texts, in any case. A pair's joint
    count is that of the clean rows, its characters' counts are those of all rows; both get the trusted texts in
    addition, with the weight TRUST of the corpus. The score is log((lift + PRIOR) / (1 + PRIOR)), the same for a corpus
    of any size. Scores are kept for the pairs of clean text: ASCII and the letters of the trusted texts, squared.
    """
    letters = frozenset(ch for n in trusted for ch in n.lower() + n.upper() if ch.isalpha() and not ch.isascii())

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            every, clean = Counter(), Counter()
            for v, n in zip(pdf["v"], pdf["n"]):
                pairs = _pairs_of(v)
                ok = all(ch.isascii() or ch in letters for ch in v)
                for p in pairs:
                    every[p] += n
                    if ok:
                        clean[p] += n
            yield pd.DataFrame({"pair": list(every), "n": list(every.values()), "clean": [clean[p] for p in every]}).astype({"pair": str, "n": "int64", "clean": "int64"})

    n = F.col(count_col).cast("long") if count_col else F.lit(1).cast("long")
    rows = values.filter(F.length(value_col) > 1).select(F.col(value_col).cast("string").alias("v"), n.alias("n"))
    pairs = rows.mapInPandas(count, "pair string, n long, clean long").groupBy("pair").agg(F.sum("n").alias("n"), F.sum("clean").alias("clean"))
    kept = pairs.filter("clean > 0")
    # Of the characters only those of clean pairs matter: each side once.
    ends = pairs.select(F.explode(F.array(F.struct(F.lit(0).alias("side"), F.substring("pair", 1, 1).alias("ch")), F.struct(F.lit(1).alias("side"), F.substring("pair", 2, 1).alias("ch")))).alias("e"), "n")
    of_clean = kept.select(F.explode(F.array(F.substring("pair", 1, 1), F.substring("pair", 2, 1))).alias("ch")).distinct()
    sums = ends.groupBy("e.side", "e.ch").agg(F.sum("n").alias("n"))
    total = pairs.agg(F.sum("n")).first()[0] or 0
    joint = {r["pair"]: float(r["clean"]) for r in kept.select("pair", "clean").collect()}
    marginal: dict[tuple[int, str], float] = {(r["side"], r["ch"]): float(r["n"]) for r in sums.join(of_clean, "ch", "left_semi").collect()}
    given = Counter(p for v in clean_variants(trusted) for p in _pairs_of(v))
    weight = TRUST * max(1, total) / max(1, sum(given.values()))
    for p, k in given.items():
        joint[p] = joint.get(p, 0.0) + k * weight
        for side in (0, 1):
            marginal[side, p[side]] = marginal.get((side, p[side]), 0.0) + k * weight
    grand = total + weight * sum(given.values())
    score = lambda lift: math.log((lift + PRIOR) / (1 + PRIOR))
    return CorpusModel({p: score(c * grand / (marginal[0, p[0]] * marginal[1, p[1]])) for p, c in joint.items()}, score(0.0))


class Restorer:
    """Finds and undoes wrong decoding in single texts."""

    def __init__(self, model: CorpusModel):
        self.scores, self.unseen = model
        self.known: dict[str, str | None] = {}

    def pairs(self, s: str) -> list[float]:
        return [self.scores.get(p, self.unseen) for p in _pairs_of(s)]

    def runs(self, s: str) -> list[tuple[int, int]]:
        """Spans of maximum-scoring segments of improbability (Ruzzo and Tompa), where they hold a character beyond ASCII."""
        segments: list[list[float]] = []  # start, end, sum before, sum after
        total = 0.0
        for i, score in enumerate(self.pairs(s)):
            w = THRESHOLD - score
            before, total = total, total + w
            if w <= 0:
                continue
            new = [i, i + 1, before, total]
            while True:
                j = len(segments) - 1
                while j >= 0 and segments[j][2] >= new[2]:
                    j -= 1
                if j < 0 or segments[j][3] >= new[3]:
                    segments.append(new)
                    break
                new = [segments[j][0], new[1], segments[j][2], new[3]]
                del segments[j:]
        spans = [(int(a), int(b) + 1) for a, b, _, _ in segments]
        return [(a, b) for a, b in spans if not s[a:b].isascii()]

    def _value(self, s: str) -> float:
        """The mutual information of the whole text; accents may be composed or not."""
        return sum(self.pairs(unicodedata.normalize("NFC", s)))

    def _odd(self, s: str) -> bool:
        """Whether two letters, not both of ASCII, stand side by side as they hardly ever do in clean text."""
        return any(not p.isascii() and p.isalpha() and self.scores.get(p, self.unseen) < self.unseen + math.log(3) for p in _pairs_of(s))

    def restore(self, s: str) -> str | None:
        """The text before the damage, '' if characters are lost for good, None if it isn't damaged."""
        if s.isascii():
            return None
        if s not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[s] = self._restore(s)
        return self.known[s]

    def _restore(self, s: str) -> str | None:
        if REPLACEMENT in s:
            return ""
        spans = self.runs(s)
        if not spans:
            return None
        best, best_value = None, self._value(s) + GAIN
        # A state: the text of every run, and the number of steps; all runs of a value were damaged alike.
        seen = {tuple(s[a:b] for a, b in spans)}
        level = list(seen)
        for depth in range(MAX_DEPTH):
            nxt = []
            for state in level:
                for read_as in READ_AS:
                    for written in WRITTEN_IN:
                        if written == read_as or (depth and written != "utf-8"):
                            continue
                        got = tuple(_reread(t, read_as, written) for t in state)
                        if None in got or got in seen:
                            continue
                        seen.add(got)
                        text, at = [], 0
                        for (a, b), t in zip(spans, got):
                            text += [s[at:a], t]
                            at = b
                        whole = "".join(text) + s[at:]
                        value = self._value(whole)
                        # Without UTF-8's own structure as proof, nothing improbable may be left.
                        if value > best_value and (written == "utf-8" or not self._odd(whole)):
                            best, best_value = whole, value
                        if written == "utf-8":
                            nxt.append(got)
            level = nxt
        return best


def restore_texts(df: DataFrame, id_col: str, text_cols: list[str], model: CorpusModel) -> DataFrame:
    """One row for each damaged value: ``id_col``, ``campo`` (the column), ``valor``, ``original``.

    ``original`` is '' if characters are lost for good. Nulls, empty texts and undamaged values give no row; a row
    repeated in the input is repeated in the result. Only the named columns are read. Values of any length
    are treated whole. No shuffle: each task decides a distinct value once.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fix = Restorer(model)
        for pdf in frames:
            uniq = {v: fix.restore(v) for v in pd.unique(pdf["valor"])}
            got = pdf["valor"].map(uniq)
            keep = got.notna().to_numpy()
            yield pdf[keep].assign(original=got[keep])

    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("campo"), F.col(c).cast("string").alias("valor")) for c in text_cols]))
    rows = df.select(F.col(id_col).cast("long").alias("id"), pairs.alias("v")).select("id", "v.campo", "v.valor").filter("valor is not null and valor rlike '[^\\\\x00-\\\\x7F]'")
    out = rows.mapInPandas(run, "id long, campo string, valor string, original string")
    return out.withColumnRenamed("id", id_col)
