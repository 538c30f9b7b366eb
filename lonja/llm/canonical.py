"""Freely typed values mapped to the closest entry of a reference list (problem 3).

The list becomes a symmetric-delete dictionary: every name with up to k letters left out points back to the name, so a
lookup of a typed value with up to k letters left out meets all names within the bounded edit distance. Candidates are
ranked by weighted Damerau-Levenshtein distance, then by how often the entry occurs in the data. What meets nothing
is reported with entry 0. Words that people put before or after names are learnt from the data: they stand beside many entries.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lonja.llm.mojibake import REPLACEMENT, CorpusModel, Restorer
from lonja.session import reliable_checkpoint

#: Dictionary keys in a task at once; a longer reference list is looked up in blocks of that size, one after another.
MAX_KEYS = 500_000
#: Words are an addition if they stand beside this share of the entries, and beside so many at least, ...
AFFIX_SHARE, AFFIX_ENTRIES = 0.1, 3
#: ... in this share of the rows, which bounds their number; and are so many words at most.
AFFIX_ROWS, AFFIX_WORDS = 1e-4, 3

# Neighbours on a Spanish keyboard, by row, and letters that sound alike.
KEY_ROWS = ["qwertyuiop", "asdfghjklñ", "zxcvbnm"]
ALIKE = [("ll", "y"), ("qu", "k"), ("c", "k"), ("c", "s"), ("s", "z"), ("c", "z"), ("b", "v"), ("g", "j"), ("i", "y"), ("h", ""), ("x", "s")]
WILD = "?"


def _neighbours() -> set[tuple[str, str]]:
    at = {ch: (r, c) for r, row in enumerate(KEY_ROWS) for c, ch in enumerate(row)}
    return {(a, b) for a in at for b in at if a != b and abs(at[a][0] - at[b][0]) <= 1 and abs(at[a][1] - at[b][1]) <= 1}


NEAR_KEYS = _neighbours()
SOUNDS = {p for a, b in ALIKE if len(a) == len(b) == 1 for p in ((a, b), (b, a))}
DIGRAPHS = {(a, b) for a, b in ALIKE if len(a) == 2}


def fold(s: str) -> str:
    """Lower case without accents; anything but letters and digits is one space; a lost character is a wildcard."""
    s = unicodedata.normalize("NFKD", s.replace(REPLACEMENT, WILD * (REPLACEMENT in s)))
    s = "".join(ch for ch in s if not unicodedata.combining(ch)).lower()
    return " ".join(re.sub(rf"[^\w{re.escape(WILD)}]+|_", " ", s).split())


def limit(n: int) -> float:
    """Weighted distance allowed for a name of n characters."""
    return 0 if n < 4 else 1 if n < 8 else 2 if n < 10 else 2.5 if n < 15 else 3


def edits(n: int) -> int:
    """Letters left out in the dictionary for a name of n characters."""
    return math.ceil(limit(n))


def weighted_distance(a: str, b: str) -> float:
    """Damerau-Levenshtein, with at most one letter between transposed ones; slips of the finger and alike sounds cost less than other edits."""
    n, m = len(a), len(b)
    d = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        for j in range(m + 1):
            if not i and not j:
                continue
            best = 1e9
            if i:
                best = d[i - 1][j] + (0.1 if a[i - 1] == WILD else 0.7 if i > 1 and a[i - 1] == a[i - 2] else 0.5 if a[i - 1] == "h" else 1.0)
            if j:
                best = min(best, d[i][j - 1] + (0.7 if j > 1 and b[j - 1] == b[j - 2] else 0.5 if b[j - 1] == "h" else 1.0))
            if i and j:
                x, y = a[i - 1], b[j - 1]
                best = min(best, d[i - 1][j - 1] + (0.0 if x == y else 0.1 if x == WILD else 0.5 if (x, y) in SOUNDS else 0.8 if (x, y) in NEAR_KEYS else 1.0))
                if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                    best = min(best, d[i - 2][j - 2] + 0.8)
                if i > 1 and j > 2 and x == b[j - 3] and a[i - 2] == y:
                    best = min(best, d[i - 2][j - 3] + 1.8)
                if i > 2 and j > 1 and x == b[j - 2] and a[i - 3] == y:
                    best = min(best, d[i - 3][j - 2] + 1.8)
                if j > 1 and (b[j - 2 : j], x) in DIGRAPHS:
                    best = min(best, d[i - 1][j - 2] + 0.5)
                if i > 1 and (a[i - 2 : i], y) in DIGRAPHS:
                    best = min(best, d[i - 2][j - 1] + 0.5)
            d[i][j] = best
    return d[n][m]


def _sounded(s: str) -> str:
    for a, b in (("ll", "y"), ("qu", "k")):
        s = s.replace(a, b)
    return s


def deletes(s: str, k: int) -> set[str]:
    """The string with exactly k letters left out."""
    return {"".join(keep) for keep in combinations(s, len(s) - k)} if k < len(s) else set()


def _wild_equal(a: str, b: str) -> bool:
    return len(a) == len(b) and all(x in (y, WILD) for x, y in zip(a, b))


class Entry(NamedTuple):
    ref_id: int
    names: list[str]
    code: str | None
    qualifiers: list[str]
    frequency: int


class Affixes(NamedTuple):
    """Folded words that say nothing, before and after a name."""

    before: frozenset[str] = frozenset()
    after: frozenset[str] = frozenset()

    def readings(self, q: str) -> list[str]:
        """The text, and what is left without an addition before it, after it, or both."""
        w = q.split(" ")
        fits = lambda words, known: any(_wild_equal(words, x) for x in known) if WILD in words else words in known
        starts = [0, *(k for k in range(1, min(AFFIX_WORDS, len(w) - 1) + 1) if fits(" ".join(w[:k]), self.before))]
        stops = [len(w), *(len(w) - k for k in range(1, min(AFFIX_WORDS, len(w) - 1) + 1) if fits(" ".join(w[-k:]), self.after))]
        return [" ".join(w[a:b]) for a in starts for b in stops if a < b]


#: What a lookup finds, the least first: distance, 0 for a name and 1 for a code, minus the entry's frequency, the entry.
Rank = tuple[float, int, int, int]


class Dictionary:
    """A symmetric-delete dictionary over entries. Whether it finds an entry doesn't depend on the other entries in it."""

    def __init__(self, entries: list[Entry], affixes: Affixes = Affixes()):
        self.affixes = affixes
        self.entries = [(-e.frequency, e.ref_id) for e in entries]
        self.codes: dict[str, list[int]] = {}
        self.qualified: dict[str, set[int]] = {}
        self.names: list[tuple[str, int]] = []
        self.exact: dict[str, list[int]] = {}
        self.by_length: dict[int, list[int]] = {}
        self.keys: dict[str, list[int]] = {}
        self.seen: dict[str, Rank | None] = {}
        for at, e in enumerate(entries):
            if e.code and fold(e.code):
                self.codes.setdefault(fold(e.code), []).append(at)
            for q in e.qualifiers:
                if fold(q):
                    self.qualified.setdefault(fold(q), set()).add(at)
            for f in sorted({fold(n) for n in e.names} - {""}):
                k = len(self.names)
                self.names.append((f, at))
                self.exact.setdefault(f, []).append(at)
                self.by_length.setdefault(len(f), []).append(k)
                for key in {key for form in {f, _sounded(f)} for n in range(edits(len(f)) + 1) for key in deletes(form, n)}:
                    self.keys.setdefault(key, []).append(k)

    def __getstate__(self):
        return self.__dict__ | {"seen": {}}

    def _near(self, q: str, among: set[int] | None = None) -> Rank | None:
        """The best entry (of those ``among``) with a name within the limit of that name."""
        same = [at for at in self.exact.get(q, ()) if among is None or at in among]
        if same:
            return min((0.0, 0, *self.entries[at]) for at in same)
        # No name is near a text that is longer than all of them by more than the edits allowed.
        if sum(c != WILD for c in q) < 2 or len(q) > max(self.by_length, default=0) + 6:
            return None
        ranked: dict[int, Rank] = {}
        best = 99.0
        # A letter left out costs this much at least: digraphs take two for a half, lost characters cost a tenth.
        least = 0.1 if WILD in q else 0.25

        def meet(k: int, dist: float | None = None) -> None:
            nonlocal best
            name, at = self.names[k]
            if k not in ranked and (among is None or at in among):
                d = weighted_distance(q, name) if dist is None else dist
                ranked[k] = (d if d <= limit(len(name)) + 1e-9 else 99.0, 0, *self.entries[at])
                best = min(best, ranked[k][0])

        if WILD in q:
            # Lost characters keep their place: names of the same length.
            for k in self.by_length.get(len(q), ()):
                if _wild_equal(q, self.names[k][0]):
                    meet(k, 0.1)
        for n in range(edits(len(q) + 2) + 1):
            if best < least * n:
                break
            for form in {q, _sounded(q)}:
                for key in deletes(form, n):
                    for k in self.keys.get(key, ()):
                        meet(k)
        got = min(ranked.values(), default=(99.0, 0, 0, 0))
        return got if got[0] < 99 else None

    def lookup(self, value: str) -> Rank | None:
        """What a typed value means, or None."""
        value = value.strip().lower()
        if value not in self.seen:
            if len(self.seen) > 500_000:
                self.seen.clear()
            self.seen[value] = self._lookup(fold(value))
        return self.seen[value]

    def _lookup(self, q: str) -> Rank | None:
        found = []
        for text in self.affixes.readings(q) if q else ():
            found += [(0.0, 1, *self.entries[at]) for at in self.codes.get(text, ())]
            found.append(self._near(text))
            # A place that the entry lies in may follow it.
            for place, among in self.qualified.items():
                n = len(place) + 1
                if len(text) > n and (text.endswith(" " + place) or (WILD in text[-n:] and _wild_equal(text[-n:], " " + place))):
                    found.append(self._near(text[:-n], among))
        return min((r for r in found if r), default=None)


def _fold_column(df: DataFrame, column: str, model: CorpusModel | None = None) -> DataFrame:
    """``df`` with the folded form of a text column in ``plano``; damage is undone first where there is a model."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fix = Restorer(model) if model else None
        for pdf in frames:
            yield pdf.assign(plano=[fold((fix.restore(v) if fix else None) or v) if v else "" for v in pdf[column]])

    return df.mapInPandas(run, ", ".join(f"{c} {t}" for c, t in df.dtypes) + ", plano string")


def learn_affixes(values: DataFrame, ref: DataFrame, qualifier_cols: list[str], model: CorpusModel) -> Affixes:
    """Words that stand before or after the names of many entries in ``values`` (valor, n: distinct values and their rows).

    An addition stands beside AFFIX_SHARE of the entries and beside AFFIX_ENTRIES at least, in AFFIX_ROWS of the rows at
    least, so that at most 2 x AFFIX_WORDS / AFFIX_ROWS of them are brought to the driver. Qualifiers are none, as they
    belong to their entries. Values and names are met by a join, whatever the size of either.
    """
    names = _fold_column(ref.select("ref_id", F.explode(F.concat(F.array("nombre"), F.coalesce("otros_nombres", F.array().cast("array<string>")))).alias("nombre")), "nombre").filter("plano <> ''").select("ref_id", F.col("plano").alias("nombre"))
    plain = _fold_column(values.select("valor", F.col("n").cast("long").alias("n")), "valor", model).groupBy("plano").agg(F.sum("n").alias("n"))
    w = F.split("plano", " ")
    whole = plain.join(names.select(F.col("nombre").alias("plano")).distinct(), "plano", "left_anti").withColumn("w", w)
    part = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    cuts = []
    for k in range(1, AFFIX_WORDS + 1):
        rest = F.size("w") - k
        cuts += [F.when(rest > 0, F.struct(F.lit(0).alias("lado"), part(1, k).alias("adorno"), part(k + 1, F.greatest(rest, F.lit(1))).alias("nombre")))]
        cuts += [F.when(rest > 0, F.struct(F.lit(1).alias("lado"), part(F.greatest(rest, F.lit(1)) + 1, k).alias("adorno"), part(1, F.greatest(rest, F.lit(1))).alias("nombre")))]
    beside = whole.select("n", F.explode(F.array_compact(F.array(*cuts))).alias("c")).select("n", "c.*").join(names, "nombre")
    if qualifier_cols:
        places = _fold_column(ref.select(F.explode(F.array_compact(F.array(*qualifier_cols))).alias("q")), "q").select(F.col("plano").alias("adorno")).distinct()
        beside = beside.join(places, "adorno", "left_anti")
    size = ref.agg(F.count_distinct("ref_id")).first()[0]
    rows = values.agg(F.sum("n")).first()[0] or 0
    found = beside.groupBy("lado", "adorno").agg(F.count_distinct("ref_id").alias("entradas"), F.sum("n").alias("n"))
    found = found.filter((F.col("entradas") >= max(AFFIX_ENTRIES, AFFIX_SHARE * size)) & (F.col("n") >= AFFIX_ROWS * rows)).collect()
    return Affixes(*(frozenset(r["adorno"] for r in found if r["lado"] == side) for side in (0, 1)))


def _blocks(ref: DataFrame, frequency: DataFrame, qualifier_cols: list[str], max_keys: int) -> Iterator[list[Entry]]:
    """The list in order of its ids, in blocks of at most ``max_keys`` dictionary keys (or one entry), read one at a time."""
    block: list[Entry] = []
    room = max_keys
    rows = ref.select("ref_id", "nombre", "codigo", "otros_nombres", *qualifier_cols).join(frequency, "ref_id", "left").orderBy("ref_id", "nombre")
    for r in rows.toLocalIterator():
        names = [x for x in [r["nombre"], *(r["otros_nombres"] or [])] if x]
        need = sum(math.comb(len(x), k) for x in names for k in range(edits(len(x)) + 1))
        if need > room and block:
            yield block
            block, room = [], max_keys
        block.append(Entry(r["ref_id"], names, r["codigo"], [r[c] for c in qualifier_cols if r[c]], r["n"] or 0))
        room -= need
    yield block


def map_to_reference(
    df: DataFrame, id_col: str, value_col: str, ref: DataFrame, qualifier_cols: list[str], model: CorpusModel, max_keys: int = MAX_KEYS,
    values: DataFrame | None = None, before: tuple[str, ...] = (), after: tuple[str, ...] = (),
) -> DataFrame:
    """One row for each non-null value that isn't identical to a name of the list: ``id_col``, ``campo``, ``valor`` and
    ``ref_id``, the entry it means or 0.

    ``ref`` has ref_id, nombre, codigo, otros_nombres and ``qualifier_cols`` (places an entry lies in, which may follow
    it). Damaged values are restored first by ``model`` (:func:`lonja.llm.mojibake.corpus_model`); lost characters match
    any one character. Additions before and after names are learnt (:func:`learn_affixes`) from ``values``, the distinct
    values (valor, n) of the column, counted here if not given; ``before`` and ``after`` name more of them. Empty texts mean
    nothing. Ties go to the entry that is more frequent under its own name, then to the smaller id. An empty list maps
    everything to 0.

    The dictionary is broadcast; it has at most ``max_keys`` keys. A longer list is looked up in blocks of that size, one
    in memory at a time, between which the rows lie in the checkpoint folder; the best answer of all blocks holds, the same
    as that of one dictionary.
    """
    spark = df.sparkSession
    typed = df.select(F.col(id_col).cast("long").alias("id"), F.lit(value_col).alias("campo"), F.col(value_col).cast("string").alias("valor")).filter("valor is not null")
    if values is None:
        values = reliable_checkpoint(typed.groupBy("valor").agg(F.count("*").alias("n")))
    nombres = ref.select(F.col("nombre").alias("valor"), "ref_id").filter("valor is not null")
    frequency = values.join(nombres, "valor").groupBy("ref_id").agg(F.sum("n").alias("n"))
    learnt = learn_affixes(values, ref, qualifier_cols, model)
    affixes = Affixes(learnt.before | {fold(x) for x in before}, learnt.after | {fold(x) for x in after})
    kind = "id long, campo string, valor string, d double, k int, f long, r long"
    rows = typed.join(nombres.select("valor"), "valor", "left_anti").select("id", "campo", "valor", F.lit(None).cast("double").alias("d"), F.lit(None).cast("int").alias("k"), F.lit(None).cast("long").alias("f"), F.lit(None).cast("long").alias("r"))
    blocks = _blocks(ref, frequency, qualifier_cols, max_keys)
    block = next(blocks)
    while block is not None:
        after_it = next(blocks, None)
        shared = spark.sparkContext.broadcast(Dictionary(block, affixes))

        def run(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            fix, book, known = Restorer(model), shared.value, {}
            for pdf in frames:
                for v in pd.unique(pdf["valor"]):
                    if v not in known:
                        known[v] = book.lookup(fix.restore(v) or v)
                best = [min((x for x in (known[v], (d, int(k), int(f), int(r)) if d == d and d is not None else None) if x), default=(None,) * 4) for v, d, k, f, r in zip(pdf["valor"], pdf["d"], pdf["k"], pdf["f"], pdf["r"])]
                yield pd.concat([pdf[["id", "campo", "valor"]], pd.DataFrame(best, columns=list("dkfr"), index=pdf.index).astype({"d": "float64", "k": "Int32", "f": "Int64", "r": "Int64"})], axis=1)
                if len(known) > 500_000:
                    known.clear()

        rows = rows.mapInPandas(run, kind)
        if after_it is not None:
            rows = reliable_checkpoint(rows)
            shared.unpersist()
        block = after_it
    return rows.select(F.col("id").alias(id_col), "campo", "valor", F.coalesce("r", F.lit(0)).cast("long").alias("ref_id"))
