"""Held-out items whose passages occur in a training corpus (problem 7).

The items form a BM25 inverted index in flat arrays: postings by term, cut into blocks of items with the greatest impact
of the term in each. Terms are pairs of adjacent words, which set an item's own wording apart from stock words. Every
passage of every document is a query by block-max WAND (Ding and Suel), for a batch of passages at once: the greatest
impacts of a group of blocks, then of a block, bound a passage's score there; what can't reach the least threshold in it
is skipped, and an item is retrieved if its score reaches its own threshold. The threshold of an item is the least
score that any of its stretches of ``min_words`` words keeps after the loss of the heaviest terms that ``max_edits`` edits
can break, two each, so no leak is lost by retrieval. What is retrieved is verified word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lonja.llm.words import words
from lonja.session import reliable_checkpoint

MIN_WORDS = 25
MAX_EDITS = 2
K1, B = 1.2, 0.75
BLOCK = 16
#: Groups of blocks that are bounded together, for whole batches of documents, before a search: at most so many.
GROUPS = 256
#: Words of items indexed and shipped at once; more items are searched for in several passes of that size.
MAX_INDEX_WORDS = 2_000_000


class ItemIndex:
    """An inverted index of held-out items with BM25 impacts: for each term its blocks of items with the greatest impact in
    each, and for each of these the items and impacts. Everything lies in flat arrays, as long as the items' texts."""

    def __init__(self, items: list[tuple[int, str, str | None]], min_words: int = MIN_WORDS, max_edits: int = MAX_EDITS):
        """``items``: id, text and question (or None)."""
        self.min_words, self.max_edits = min_words, max_edits
        # The shortest exact run that a stretch with that many edits must hold.
        self.seed = max(1, (min_words - max_edits) // (max_edits + 1) + ((min_words - max_edits) % (max_edits + 1) > 0))
        # Passages begin every ``step`` words and are long enough for a stretch that begins anywhere in the first step.
        self.step = max(1, (min_words + max_edits) // 4)
        self.width = -(-(min_words + max_edits + self.step - 1) // self.step)
        self.vocabulary: dict[bytes, int] = {}
        code = self.vocabulary
        coded = lambda w: np.array([code.setdefault(x, len(code)) for x in w], np.int32)
        texts = [(i, coded(w), coded(words(q))) for i, t, q in items if len(w := words(t)) >= min_words]
        n = len(texts)
        pairs = [w[:-1].astype(np.int64) * max(1, len(code)) + w[1:] for _, w, _ in texts]
        self.terms = np.unique(np.concatenate(pairs)) if n else np.zeros(0, np.int64)
        terms = [np.searchsorted(self.terms, t) for t in pairs]
        df = np.zeros(len(self.terms))
        for t in terms:
            df[np.unique(t)] += 1
        mean = sum(map(len, terms)) / max(1, n)
        self.repeated = 0  # terms that a stretch holds again
        scored, theta = [], np.zeros(n)
        for k, t in enumerate(terms):
            own, place, tf = np.unique(t, return_inverse=True, return_counts=True)
            score = np.log(1 + (n - df[own] + 0.5) / (df[own] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(t) / mean))
            scored.append((own, score))
            theta[k] = self._least_score(t, score[place])
        # Items of one language and like thresholds share a block: then few blocks must be opened.
        order = sorted(range(n), key=lambda k: (int(np.bincount(texts[k][1]).argmax()), theta[k], texts[k][0]))
        self.ids, self.questions = [texts[k][0] for k in order], [texts[k][2] for k in order]
        self.words = np.concatenate([texts[k][1] for k in order]) if n else np.zeros(0, np.int32)
        self.begin = np.concatenate([[0], np.cumsum([len(texts[k][1]) for k in order])]).astype(np.int64)
        # Runs of each item by hash; the last seed - 1 places hold none.
        self.run_hash, self.run_place = np.full(len(self.words), 2**64 - 1, np.uint64), np.zeros(len(self.words), np.int32)
        for a, z in zip(self.begin, self.begin[1:]):
            h = self._hashed(self.words[a:z])
            by = np.argsort(h, kind="stable")
            self.run_hash[a : a + len(h)], self.run_place[a : a + len(h)] = h[by], by
        self.theta = theta[order] * 0.9999 if n else theta
        self.block_theta = np.minimum.reduceat(self.theta, np.arange(0, n, BLOCK)) if n else np.zeros(0)
                # Postings by term, then item.
        term = np.concatenate([scored[k][0] for k in order]) if n else np.zeros(0, np.int64)
        item = np.repeat(np.arange(n), [len(scored[k][0]) for k in order]) if n else np.zeros(0, np.int64)
        by = np.lexsort((item, term))
        term, self.post_item = term[by], item[by].astype(np.int32)
        self.post_impact = np.concatenate([scored[k][1] for k in order])[by] if n else np.zeros(0)
        # Blocks by term: where their postings begin, and the greatest impact.
        block = self.post_item // BLOCK
        new = np.flatnonzero(np.r_[True, (np.diff(term) != 0) | (np.diff(block) != 0)]) if len(term) else np.zeros(0, np.int64)
        self.block_id, self.block_post = block[new], np.r_[new, len(term)].astype(np.int64)
        self.block_max = np.maximum.reduceat(self.post_impact, new) if len(new) else np.zeros(0)
        # Groups of blocks by term, at most GROUPS altogether: where their blocks begin, and the greatest impact.
        self.per_group = max(1, -(-len(self.block_theta) // GROUPS))
        group, of = self.block_id // self.per_group, term[new]
        first = np.flatnonzero(np.r_[True, (np.diff(of) != 0) | (np.diff(group) != 0)]) if len(of) else np.zeros(0, np.int64)
        self.group_id, self.group_block = group[first], np.r_[first, len(of)].astype(np.int64)
        self.group_max = np.maximum.reduceat(self.block_max, first) if len(first) else np.zeros(0)
        self.term_group = np.searchsorted(of[first], np.arange(len(self.terms) + 1))
        self.group_theta = np.minimum.reduceat(self.block_theta, np.arange(0, len(self.block_theta), self.per_group)) if n else np.zeros(0)
        # A passage that reaches a threshold has at least as many terms as the stretch that set it keeps.
        self.least_terms = max(1, min_words - 1 - 2 * max_edits - self.repeated) if n else 1

    def _least_score(self, terms: np.ndarray, score: np.ndarray) -> float:
        """The least score of a stretch of min_words words after the loss of the heaviest terms that the edits can break, two each."""
        n = self.min_words - 1
        last, before = {}, np.full(len(terms), -1)
        for i, t in enumerate(terms.tolist()):
            before[i] = last.get(t, -1)
            last[t] = i
        windows = np.lib.stride_tricks.sliding_window_view(score, n)
        again = np.lib.stride_tricks.sliding_window_view(before, n) >= np.arange(len(windows))[:, None]
        self.repeated = max(self.repeated, int(again.sum(axis=1).max()))
        once = np.sort(np.where(again, 0.0, windows), axis=1)
        return float(once[:, : max(0, n - 2 * self.max_edits)].sum(axis=1).min())

    def candidates(self, docs: list[np.ndarray]) -> list[tuple[int, int, int]]:
        """(document, passage, item) with a BM25 score of at least the item's threshold, for coded documents; see passage_span."""
        if not len(self.terms) or not docs:
            return []
        step, width = self.step, self.width
        lengths = np.array([len(d) for d in docs])
        ids = np.concatenate(docs).astype(np.int64)
        if len(ids) < 2:
            return []
        # A passage is ``width`` steps; empty steps behind each document keep passages from crossing documents.
        base = np.concatenate([[0], np.cumsum(lengths // step + width)])
        step_of = np.repeat(base[:-1], lengths) + (np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)) // step
        pair = np.where((ids[:-1] >= 0) & (ids[1:] >= 0), ids[:-1] * len(self.vocabulary) + ids[1:], -1)
        term = np.searchsorted(self.terms, pair)
        term[term == len(self.terms)] = 0
        keep = self.terms[term] == pair
        term, part = term[keep], step_of[:-1][keep]
        begin = np.searchsorted(part, np.arange(int(base[-1]) + width + 1))
        lo, hi = begin[: -width - 1], begin[width:-1]
        windows = np.flatnonzero(hi - lo >= self.least_terms)
        out = []
        # Groups, their blocks, the blocks' items: each is opened only for the passages that it can lift to a threshold.
        entry, at = self._expand(self.term_group, term, part, windows)
        for g, entry_g, at_g, opened in self._reach(self.group_id, self.group_max, entry, at, 0, self.group_theta, windows):
            blocks = [(g, entry_g, at_g, opened)]
            if self.per_group > 1:
                first = g * self.per_group
                entry_g, at_g = self._expand(self.group_block, entry_g, at_g, opened)
                blocks = self._reach(self.block_id, self.block_max, entry_g, at_g, first, self.block_theta[first : first + self.per_group], opened)
            for b, entry_b, at_b, opened_b in blocks:
                post, at_b = self._expand(self.block_post, entry_b, at_b, opened_b)
                first = b * BLOCK
                for i, _, _, found in self._reach(self.post_item, self.post_impact, post, at_b, first, self.theta[first : first + BLOCK], opened_b):
                    d = np.searchsorted(base, found, side="right") - 1
                    out += zip(d.tolist(), (found - base[d]).tolist(), [i] * len(found))
        return out

    def _places(self, windows: np.ndarray) -> np.ndarray:
        """For each step the number of steps before it that lie in a window; one more entry than steps."""
        last = int(windows.max()) + self.width + 1
        return np.r_[0, np.cumsum(np.cumsum(np.bincount(windows, minlength=last) - np.bincount(windows + self.width, minlength=last)) > 0)]

    def _expand(self, begin: np.ndarray, rows: np.ndarray, steps: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entries begin[r] to begin[r + 1] of each row whose step lies in a window, and that step for each of them."""
        if not len(windows) or not len(rows):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = self._places(windows)
        keep = steps < len(place) - 1
        keep[keep] = np.diff(place)[steps[keep]] > 0
        rows, steps = rows[keep], steps[keep]
        count = begin[rows + 1] - begin[rows]
        skip = np.cumsum(count) - count
        return np.repeat(begin[rows] - skip, count) + np.arange(int(count.sum())), np.repeat(steps, count)

    def _reach(self, id_of: np.ndarray, weight_of: np.ndarray, entry: np.ndarray, steps: np.ndarray, first: int, theta: np.ndarray, windows: np.ndarray) -> Iterator[tuple]:
        """Ids from ``first`` on (as many as ``theta``) with their entries, the steps of these, and the windows in which the
        weights of the entries add up to the threshold of the id."""
        if not len(entry):
            return
        place, n = self._places(windows), len(theta)
        m, ids = int(place[-1]), (id_of[entry] - first).astype(np.int16)
        cells = np.bincount(ids * np.int64(m) + place[steps], weights=weight_of[entry], minlength=n * m)
        sums = np.zeros((n, m + 1))
        np.cumsum(cells.reshape(n, m), axis=1, out=sums[:, 1:])
        lo, hi = place[windows], place[windows + self.width]
        got = [np.flatnonzero(row[hi] - row[lo] >= t * 0.9999) for row, t in zip(sums, theta.tolist())]
        order = np.argsort(ids, kind="stable")
        edge = np.r_[0, np.cumsum(np.bincount(ids, minlength=n))]
        for k, w in enumerate(got):
            if len(w):
                mine = order[edge[k] : edge[k + 1]]
                yield k + first, entry[mine], steps[mine], windows[w]

    def asks(self, doc: np.ndarray, item: int) -> float | None:
        """The share of the pairs of adjacent words of the item's question that the document holds; None without a question."""
        q, v = self.questions[item].astype(np.int64), max(1, len(self.vocabulary))
        if len(q) < 2:
            return None
        d = doc.astype(np.int64)
        return float(np.isin(q[:-1] * v + q[1:], np.where((d[:-1] >= 0) & (d[1:] >= 0), d[:-1] * v + d[1:], -1)).mean())

    def coded(self, text: str | None) -> np.ndarray:
        """The words of a text as numbers of the index; words that no item has are -1."""
        w, get = words(text), self.vocabulary.get
        return np.fromiter((get(x, -1) for x in w), np.int32, count=len(w))

    def passage_span(self, passage: int) -> tuple[int, int]:
        return passage * self.step, (passage + self.width) * self.step

    def longest(self, doc: np.ndarray, start: int, end: int, item: int) -> int:
        """Words of the longest stretch of the item that the document holds, with at most max_edits of them altered, left
        out or parted by an added word, grown from exact runs that begin in doc[start:end]."""
        s, a = self.seed, int(self.begin[item])
        z = int(self.begin[item + 1])
        known, order = self.run_hash[a:z], self.run_place[a:z]
        here = self._hashed(doc[start : min(end, len(doc)) + s - 1])
        if not len(here):
            return 0
        k = np.searchsorted(known, here)
        k[k == len(known)] = 0
        best, done = 0, set()
        hits = np.flatnonzero(known[k] == here)
        if not len(hits):
            return 0
        w, d = self.words[a:z].tolist(), doc.tolist()
        for j, k0 in zip((hits + start).tolist(), k[hits].tolist()):
            while k0 < len(known) and known[k0] == here[j - start]:
                i = int(order[k0])
                k0 += 1
                if (i - j, i // s) in done or w[i : i + s] != d[j : j + s]:
                    continue
                done.add((i - j, i // s))
                right = self._grow(w, d, i + s, j + s, 1)
                left = self._grow(w, d, i - 1, j - 1, -1)
                for e in range(self.max_edits + 1):
                    best = max(best, s + right[e] + left[self.max_edits - e])
        return best

    def _hashed(self, w: np.ndarray) -> np.ndarray:
        """A hash of each run of ``seed`` words; equal runs have equal hashes."""
        if len(w) < self.seed:
            return np.zeros(0, np.uint64)
        out = np.zeros(len(w) - self.seed + 1, np.uint64)
        for k in range(self.seed):
            out = out * np.uint64(0x9E3779B97F4A7C15) + (w[k : k + len(out)].astype(np.int64) + 2).astype(np.uint64)
            out ^= out >> np.uint64(29)
        return out

    def _grow(self, w: list[int], d: list[int], i: int, j: int, step: int) -> list[int]:
        """Item words covered beyond a seed, by the number of edits allowed; a stretch ends with a word in place."""
        best = [0] * (self.max_edits + 1)
        n, m, i0 = len(w), len(d), i
        stack = [(i, j, 0, True)]
        while stack:
            i, j, e, ok = stack.pop()
            ran = False
            while 0 <= i < n and 0 <= j < m and w[i] == d[j]:
                i, j, ran = i + step, j + step, True
            if ran or ok:
                for x in range(e, self.max_edits + 1):
                    best[x] = max(best[x], abs(i - i0))
            if e < self.max_edits and 0 <= i < n and 0 <= j < m:
                stack += [(i + step, j + step, e + 1, False), (i + step, j, e + 1, False), (i, j + step, e + 1, False)]
        return best


def _passes(items: DataFrame, item_id: str, item_text: str, question: str | None, most: int) -> Iterator[list[tuple]]:
    """The items in order of their ids, at most ``most`` words (or one item) at a time on the driver."""
    part: list[tuple] = []
    room = most
    for r in items.select(item_id, item_text, (F.col(question) if question else F.lit(None)).cast("string")).filter(F.col(item_text).isNotNull()).orderBy(item_id).toLocalIterator():
        need = r[1].count(" ") + 1
        if need > room and part:
            yield part
            part, room = [], most
        part.append((r[0], r[1], r[2]))
        room -= need
    yield part


def leaked_items(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, min_words: int = MIN_WORDS, max_edits: int = MAX_EDITS, max_index_words: int = MAX_INDEX_WORDS, question: str | None = None) -> DataFrame:
    """One row for each document and each item it leaks: ``doc_id``, ``item_id``, ``palabras``, the longest stretch, and
    ``pregunta``, the share of the item's question (its pairs of adjacent words) that the document holds, null without one.

    A leak is a stretch of at least ``min_words`` consecutive words of the item of which at most ``max_edits`` are
    altered, left out or parted by an added word. Case, accents, punctuation and spacing don't count. Null or empty texts
    and items shorter than that leak nothing; texts of any length are searched whole; the repeated rows of a document
    give one row each. The item list is searched for in passes of at most ``max_index_words`` words, each of which scans the
    corpus once with one index on the driver and in the tasks; the corpus itself is never shuffled. Other columns are ignored.
    """
    spark = docs.sparkSession
    corpus = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("text is not null and text <> ''")
    passes = _passes(items, item_id, item_text, question, max_index_words)
    part, out = next(passes), None
    while part is not None:
        after_it = next(passes, None)
        shared = spark.sparkContext.broadcast(ItemIndex(part, min_words, max_edits))

        def run(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            index = shared.value
            for pdf in frames:
                for k in range(0, len(pdf), 256):
                    ids, docs_ = pdf["doc_id"].to_numpy()[k : k + 256], [index.coded(t) for t in pdf["text"].iloc[k : k + 256]]
                    spans: dict[tuple[int, int], list[int]] = {}
                    for d, passage, item in index.candidates(docs_):
                        a, b = index.passage_span(passage)
                        span = spans.setdefault((d, item), [a, b])
                        span[0], span[1] = min(a, span[0]), max(b, span[1])
                    found = {(d, i): n for (d, i), (a, b) in spans.items() if (n := index.longest(docs_[d], a, b, i)) >= index.min_words}
                    yield pd.DataFrame({"doc_id": [int(ids[d]) for d, _ in found], "item_id": [int(index.ids[i]) for _, i in found], "palabras": list(found.values())}).astype("int64").assign(pregunta=np.array([index.asks(docs_[d], i) for d, i in found], float))

        got = corpus.mapInPandas(run, "doc_id long, item_id long, palabras long, pregunta double")
        if after_it is not None:
            got = reliable_checkpoint(got)
            shared.unpersist()
        out = got if out is None else out.unionAll(got)
        part = after_it
    return out.select(F.col("doc_id").alias(doc_id), F.col("item_id").alias(item_id), "palabras", F.when(~F.isnan("pregunta"), F.col("pregunta")).alias("pregunta"))
