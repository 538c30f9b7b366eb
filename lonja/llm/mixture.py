"""Records of several sources combined to target shares of the total size (problem 8).

Weights are propagated through a tree of sources (domain, language, source or any other path). What a leaf can't
supply goes to its siblings first, then to the siblings of its parent, and so on. Each leaf is selected in seeded
epochs: whole passes over it, then a prefix, by tokens, of the pass after. Sizes are tokens of a public tokenizer.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public pattern that byte-level BPE of this vocabulary splits text by.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The cut of a leaf is searched for in so many equal parts of its order at a time, until a part holds at most CUT_ROWS records.
PARTS, CUT_ROWS = 256, 10_000


class TokenCounter:
    """Counts tokens by the tokenizer's own pieces; a piece's count is looked up once in each process."""

    def __init__(self, path: str, pattern: str = PATTERN):
        import base64

        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(pattern).findall
        self.known: dict[str, int] = {}

    def count(self, text: str) -> int:
        known, n = self.known, 0
        for piece in self.split(text):
            c = known.get(piece)
            if c is None:
                c = len(self.encoding.encode_ordinary(piece))
                if len(known) > 1_000_000:
                    known.clear()
                if len(piece) < 64:
                    known[piece] = c
            n += c
        return n


def count_tokens(df: DataFrame, text_col: str, out_col: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``df`` with the number of tokens of a text column; null counts 0. The tokenizer's file must lie at that path on every executor."""

    @F.pandas_udf("long")
    def tokens(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = TokenCounter(tokenizer)
        for s in parts:
            yield pd.Series([counter.count(t) if t else 0 for t in s], dtype="int64")

    return df.withColumn(out_col, tokens(F.col(text_col)))


def allot(leaves: list[dict], budget: float | None = None) -> dict[tuple, float]:
    """Tokens for each leaf: dicts with ``path`` (tuple, root first), ``weight``, ``capacity`` (tokens times repetitions allowed).

    Without a budget it is the greatest total at which no leaf with any capacity falls short. The weight of leaves
    without capacity, and what a leaf lacks, goes to its siblings in proportion to their weights, then to its
    parent's siblings. Returns tokens by path; they sum to the budget where all capacity together allows it.
    """
    weights: dict[tuple, float] = {}
    for leaf in leaves:
        weights[leaf["path"]] = weights.get(leaf["path"], 0.0) + max(0.0, leaf["weight"])
    room = {leaf["path"]: max(0.0, float(leaf["capacity"])) for leaf in leaves}

    def spread(prefix: tuple, amount: float, given: dict[tuple, float]) -> float:
        """Gives ``amount`` to the leaves below, each child its share, shortages to the other children; returns what is left."""
        if prefix in room:
            more = min(amount, room[prefix] - given[prefix]) if weights[prefix] > 0 else 0.0
            given[prefix] += more
            return amount - more
        children: dict[tuple, float] = {}
        for p, w in weights.items():
            if p[: len(prefix)] == prefix:
                children[p[: len(prefix) + 1]] = children.get(p[: len(prefix) + 1], 0.0) + w
        open_ = {c: w for c, w in children.items() if w > 0}
        while amount > 1e-9 and open_:
            total, left = sum(open_.values()), 0.0
            for c, w in list(open_.items()):
                rest = spread(c, amount * w / total, given)
                if rest > 1e-9:
                    left += rest
                    del open_[c]
            amount = left
        return max(0.0, amount)

    if budget is None:
        # Shares after the weight of empty leaves has moved; then the scarcest leaf sets the total.
        full = {p: 1e30 if r > 0 else 0.0 for p, r in room.items()}
        room, real = full, room
        shares = dict.fromkeys(room, 0.0)
        spread((), 1.0, shares)
        room = real
        budget = min((room[p] / s for p, s in shares.items() if s > 1e-12), default=0.0)
    given = dict.fromkeys(room, 0.0)
    spread((), float(budget), given)
    return given


def _cuts(rows: DataFrame, state: dict[tuple, dict]) -> None:
    """Narrows the part of each leaf's order that holds its cut to at most CUT_ROWS records, by sums of tokens over equal parts.

    ``rows`` has the leaf's path as a string in ``hoja``, ``u`` and ``tokens``. Brings PARTS rows for each leaf to the driver.
    """
    spark = rows.sparkSession
    while True:
        open_ = [(s["hoja"], s["lo"], s["bits"] - PARTS.bit_length() + 1) for s in state.values() if s["rest"] > 0 and s["n"] > CUT_ROWS and s["bits"] > PARTS.bit_length()]
        if not open_:
            return
        at = F.broadcast(spark.createDataFrame(open_, "hoja string, lo long, shift int"))  # a row for each leaf
        part = F.expr("shiftright(u - lo, shift)")
        sums = rows.join(at, "hoja").withColumn("part", part).filter((F.col("u") >= F.col("lo")) & (F.col("part") < PARTS)).groupBy("hoja", "part").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
        by_leaf: dict[str, list] = {}
        for r in sums.collect():
            by_leaf.setdefault(r["hoja"], []).append((r["part"], r["t"], r["n"]))
        for s in state.values():
            if s["hoja"] not in by_leaf or (s["hoja"], s["lo"], s["bits"] - PARTS.bit_length() + 1) not in open_:
                continue
            s["bits"] -= PARTS.bit_length() - 1
            for k, t, n in sorted(by_leaf[s["hoja"]]):
                s["n"], here = n, s["lo"] + (k << s["bits"])
                if s["before"] + t >= s["rest"]:
                    break
                s["before"] += t
            s["lo"] = here


def mix_sources(df: DataFrame, id_col: str, size_col: str, leaf_cols: list[str], leaves: DataFrame, seed: int = 0, budget: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(selection, report). ``selection``: ``id_col``, the leaf columns, ``size_col`` and ``copias``, the times a record is used (at least 1).
    ``report``: the leaf columns, ``peso``, ``tokens``, ``parte`` and ``repeticion`` (greatest use of a record).

    ``leaf_cols`` is the path of a leaf, root first; ``leaves`` has these columns, ``peso`` and ``max_repeticiones``. A level that
    ``leaves`` leaves out takes the natural proportions of the records below. Records of a leaf that isn't listed, or
    with a null leaf column that ``leaves`` lists, are unused, as are records of size 0 or null. Ids are unique.

    A leaf of any size is cut by tokens without sorting it in one place: a seeded hash orders its records, sums over equal
    parts of the order find the part that holds the cut, and only the last part, of at most CUT_ROWS records, is put in order.
    ``df`` is read once for each step of that search, so it should be stored. The driver and broadcasts hold rows by leaf only.
    """
    spark = df.sparkSession
    listed = [c for c in leaf_cols if c in leaves.columns]
    rows = df.select(F.col(id_col).alias("id"), F.col(size_col).cast("long").alias("tokens"), *leaf_cols).filter("tokens > 0")
    wanted = leaves.select(*listed, F.col("peso").cast("double").alias("peso"), F.col("max_repeticiones").cast("int").alias("reps"))
    rows = rows.join(wanted, listed).withColumn("hoja", F.to_json(F.array(*[F.col(c).cast("string") for c in leaf_cols])))
    per_leaf = rows.groupBy(*leaf_cols, "hoja", "peso", "reps").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).collect()
    of_listed: dict[tuple, int] = {}
    for r in per_leaf:
        k = tuple(r[c] for c in listed)
        of_listed[k] = of_listed.get(k, 0) + r["t"]
    plan = [{"path": tuple(r[c] for c in leaf_cols), "weight": r["peso"] * r["t"] / of_listed[tuple(r[c] for c in listed)], "capacity": r["t"] * max(0, r["reps"])} for r in per_leaf]
    for r in leaves.collect():
        if tuple(r[c] for c in listed) not in of_listed:
            plan.append({"path": tuple(r[c] if c in listed else None for c in leaf_cols), "weight": r["peso"], "capacity": 0})
    given = allot(plan, budget)
    state: dict[tuple, dict] = {}
    for r in per_leaf:
        p = tuple(r[c] for c in leaf_cols)
        epochs = int(given[p] // r["t"])
        state[p] = {"hoja": r["hoja"], "epochs": epochs, "rest": given[p] - epochs * r["t"], "lo": 0, "bits": 63, "before": 0, "n": r["n"]}
    # Whole passes first, then a prefix by tokens of the pass after, whose order is its own.
    quota = F.broadcast(spark.createDataFrame([(s["hoja"], s["epochs"]) for s in state.values()], "hoja string, epochs int"))
    rows = rows.join(quota, "hoja").withColumn("u", F.expr(f"shiftrightunsigned(xxhash64({int(seed)}, epochs, id), 1)"))
    _cuts(rows, state)
    cut = F.broadcast(spark.createDataFrame([(s["hoja"], s["lo"], s["lo"] + (1 << s["bits"]) - 1, float(s["rest"] - s["before"])) for s in state.values()], "hoja string, desde long, hasta long, resto double"))
    placed = rows.join(cut, "hoja")
    outside = placed.filter("u < desde or u > hasta").withColumn("copias", F.col("epochs") + F.when((F.col("u") < F.col("desde")) & (F.col("resto") > 0), 1).otherwise(0))
    order = Window.partitionBy("hoja").orderBy("u", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = placed.filter("u between desde and hasta")
    # Where nothing is left to give, nothing is put in order.
    some = inside.filter("resto > 0").withColumn("upto", F.sum("tokens").over(order))
    # The record on the cut goes to the side that leaves the total nearer to the target.
    some = some.withColumn("copias", F.col("epochs") + F.when(F.col("upto") - F.col("tokens") / 2 <= F.col("resto"), 1).otherwise(0)).drop("upto")
    none = inside.filter("resto <= 0").withColumn("copias", F.col("epochs"))
    chosen = outside.unionByName(some).unionByName(none).filter("copias > 0").select(F.col("id").alias(id_col), *leaf_cols, F.col("tokens").alias(size_col), F.col("copias").cast("int").alias("copias"))
    used = chosen.groupBy(*listed).agg(F.sum(F.col(size_col) * F.col("copias")).alias("tokens"), F.max("copias").alias("repeticion"))
    report = leaves.select(*listed, F.col("peso").cast("double").alias("peso")).join(used, listed, "left")
    everything = F.coalesce(F.sum("tokens").over(Window.partitionBy(F.lit(1))), F.lit(0))  # a row for each listed source
    report = report.select(*listed, "peso", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("repeticion", F.lit(0)).alias("repeticion"), F.when(everything > 0, F.coalesce("tokens", F.lit(0)) / everything).otherwise(0.0).alias("parte"))
    return chosen, report
