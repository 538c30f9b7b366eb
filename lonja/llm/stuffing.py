"""Keyword stuffing, link lists, tags and catalogue lines instead of sentences (problem 9).

Texts are cut into blocks of about equal length. A block is compressed twice: as it is, which shows repeated keywords, and
as its skeleton (every run of letters one letter, every run of digits one digit), which shows lists whose lines differ in
words only. Each ratio is set against the mean and spread of all blocks of its language and length. A block that is
extremely redundant either way is flagged, and confirmed by a low density of the punctuation that ends sentences.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lonja.session import reliable_checkpoint

BLOCK_CHARS = 500
#: Standard deviations below the mean ratio of the language and length at which a block is extremely redundant.
REDUNDANT = -2.0
#: A redundant block is confirmed by fewer than one sentence end in this many characters.
CHARS_PER_END = 300
#: A mark ends a sentence if at least so many words stand before it, since the last such mark.
SENTENCE_WORDS = 12
#: Share of a text's characters that must be such matter.
SHARE = 0.5
#: Blocks from which an expectation is taken; below, those of the language at any length, then of all languages, count.
ENOUGH = 30

_END = re.compile(r"[.!?…。！？]+[\"'»”)\]]*(?=\s|$)")
# Letters (and all bytes beyond ASCII) are one class, digits another; marks and white space stay.
_CLASSES = bytes(0x61 if c >= 0x80 or chr(c).isalpha() else 0x39 if chr(c).isdigit() else c for c in range(256))
_RUNS = (re.compile(rb"a+"), re.compile(rb"9+"))
_MEASURES = "array<struct<chars:int,ends:int,ratio:float,skeleton:float>>"


def language_key(lang: str | None) -> str:
    key = (lang or "").strip().lower()[:2]
    return key if key.isalpha() else ""


def _ratio(raw: bytes) -> float:
    return len(zlib.compress(raw, 5)) / max(1, len(raw))


def skeleton(raw: bytes) -> bytes:
    raw = raw.translate(_CLASSES)
    for runs, one in zip(_RUNS, (b"a", b"9")):
        raw = runs.sub(one, raw)
    return raw


def sentence_ends(text: str) -> list[int]:
    """Places of the marks that end a sentence of at least SENTENCE_WORDS words."""
    out, at = [], 0
    for m in _END.finditer(text):
        if len(text[at : m.end()].split()) >= SENTENCE_WORDS:
            out.append(m.start())
        at = m.end()
    return out


def block_measures(text: str) -> list[dict]:
    """Characters, sentence ends and both compression ratios of each block; the blocks make up the whole text."""
    n = max(1, round(len(text) / BLOCK_CHARS))
    edges = [len(text) * k // n for k in range(n + 1)]
    ends = np.searchsorted(edges, sentence_ends(text), side="right") - 1
    count = np.bincount(ends, minlength=n)
    out = []
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        raw = text[a:b].encode("utf-8", "replace")
        out.append({"chars": b - a, "ends": int(count[k]), "ratio": _ratio(raw), "skeleton": _ratio(skeleton(raw))})
    return out


def _bucket(n: int) -> int:
    return n // 100


def measured_documents(df: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """``id``, ``lang`` (two letters) and ``bloques``, the measures of a document's blocks; every text is compressed here and only here."""
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text is not null and trim(text) <> ''")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame({"id": pdf["id"], "lang": [language_key(x) for x in pdf["lang"]], "bloques": [block_measures(t) for t in pdf["text"]]})

    return docs.mapInPandas(run, f"id long, lang string, bloques {_MEASURES}")


def expectations(measured: DataFrame) -> dict:
    """(blocks, mean and spread of the ratio, mean and spread of the skeleton's ratio) by (language, length), (language,) and ().

    At most 677 languages of two letters times ten lengths, whatever the corpus.
    """
    b = measured.select("lang", F.explode("bloques").alias("b")).select("lang", F.floor(F.col("b.chars") / 100).cast("int").alias("largo"), F.col("b.ratio").cast("double").alias("r"), F.col("b.skeleton").cast("double").alias("k"))
    sums = b.groupBy("lang", "largo").agg(F.count("*").alias("n"), *[F.sum(e).alias(a) for a, e in (("r", F.col("r")), ("rr", F.col("r") ** 2), ("k", F.col("k")), ("kk", F.col("k") ** 2))])
    total: dict[tuple, np.ndarray] = {}
    for row in sums.collect():
        for key in ((row["lang"], row["largo"]), (row["lang"],), ()):
            total[key] = total.get(key, 0) + np.array([row["n"], row["r"], row["rr"], row["k"], row["kk"]], float)
    spread = lambda s, q, n: max(0.0, q / n - (s / n) ** 2) ** 0.5
    return {key: (int(n), r / n, spread(r, rr, n), k / n, spread(k, kk, n)) for key, (n, r, rr, k, kk) in total.items()}


def is_matter(block: dict, lang: str, expected: dict) -> bool:
    """Flagged by extreme redundancy, confirmed by missing sentence ends."""
    keys = ((lang, _bucket(block["chars"])), (lang,), ())
    found = next((expected[k] for k in keys if k in expected and expected[k][0] > ENOUGH), None)
    if found is None:
        return False
    _, mean, sd, s_mean, s_sd = found
    z = [(x - m) / s for x, m, s in ((block["ratio"], mean, sd), (block["skeleton"], s_mean, s_sd)) if s > 0]
    return min(z, default=0.0) <= REDUNDANT and block["ends"] * CHARS_PER_END < block["chars"]


def stuffed_documents(df: DataFrame, id_col: str, text_col: str, lang_col: str, share: float = SHARE) -> DataFrame:
    """``id_col`` and ``parte``, the share of keyword stuffing, lists and tags among the characters, of documents above ``share``.

    The expected ratios of a language and block length are measured over all documents; languages are known by their
    first two letters, null and unknown ones are one group. Null and blank texts are no case. In a corpus of at most
    ENOUGH blocks nothing is expected and nothing found. Texts are read whole, however long; repeated rows are
    repeated in the result; other columns are ignored. The texts are read once: their measures, a few numbers for
    each block, are kept in the checkpoint folder.
    """
    measured = reliable_checkpoint(measured_documents(df, id_col, text_col, lang_col))
    expected = expectations(measured)

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            parts = [sum(b["chars"] for b in blocks if is_matter(b, lang, expected)) / sum(b["chars"] for b in blocks) for lang, blocks in zip(pdf["lang"], pdf["bloques"])]
            out = pd.DataFrame({"id": pdf["id"], "parte": np.array(parts, float)})
            yield out[out["parte"] > share]

    return measured.mapInPandas(judge, "id long, parte double").withColumnRenamed("id", id_col)
