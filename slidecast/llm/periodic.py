"""Periodic runs of words by seed-and-extend on diagonals.

A run is a maximal stretch of words with smallest period q whose length is at
least ``max(MIN_LENGTH, 2 q)``. On diagonal q (word i against word i + q) it
is a stretch of ``max(MIN_LENGTH - q, q)`` equal words at least: the minimum
guaranteed overlap.

1. Lags are taken in classes [K, 2K), K = 1, 2, 4, ... A class indexes the
   k-grams of about half its guaranteed overlap; seeds are taken one in h
   places, with h + k - 1 no more than the overlap, so no stretch can lie between seeds.
   K-grams are named exactly (pairs of names of half the length), so
   equal names are equal words.
2. Occurrence pairs: each seed is paired with the later places of its k-gram
   in the same document that are K to 2K - 1 words on. One place in h is
   a seed and h grows with K, so even a text of one repeated word gives
   a class only a few pairs per word.
3. Pairs are taken by lag and place. What the pairs before them on the same
   lag cover already (the furthest-covered table) is not extended again; the
   rest is extended to both sides by halving steps over the names.
4. A stretch found on several lags keeps the smallest: the run's period.

A document is worked on whole, in arrays of a few numbers per word; short
documents are worked on together, told apart by naming words per document.

Edge cases: words are ``[^\\x20\\x09-\\x0D]+``; a null, empty or blank text has no
runs and an empty collapsed text; rows that repeat an id, rows with a null
id and repeated texts are rows of their own; very long texts are handled
whole; of longest runs that tie the smallest start, then period, is reported;
an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_LENGTH = 12
CHUNK_WORDS = 1 << 17
_SCHEMA = ("doc_id {id}, n_runs long, start long, length long, period long, "
           "runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


class Names:
    """Exact names of the k-grams of a sequence: equal at two places only if the words there are."""

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        self.levels = [words.astype(np.int64)]  # level j names grams of 2^j words
        self.repeated = np.ones(self.n, dtype=bool)

    def level(self, j: int) -> np.ndarray:
        while len(self.levels) <= j:
            half = 1 << (len(self.levels) - 1)
            self.levels.append(self._pair(self.levels[-1], half))
        return self.levels[j]

    def _pair(self, of: np.ndarray, shift: int) -> np.ndarray:
        """Names of (gram at i, gram at i + shift); a gram that runs over the end, or occurs once, has a name of its own."""
        out = -np.arange(1, self.n + 1, dtype=np.int64)
        at = np.flatnonzero((of[: self.n - shift] >= 0) & (of[shift:] >= 0)) if shift < self.n else np.empty(0, dtype=np.int64)
        if len(at):
            _, name, times = np.unique(of[at] * np.int64(self.n + 1) + of[at + shift], return_inverse=True, return_counts=True)
            many = times[name] > 1
            out[at[many]] = name[many]
        return out

    def grams(self, k: int) -> np.ndarray:
        j = k.bit_length() - 1
        return self.level(j) if k == 1 << j else self._pair(self.level(j), k - (1 << j))


def word_names(docs: list[list]) -> tuple[np.ndarray, np.ndarray]:
    """Words of several documents in a row, named per document (words of one use get a negative name), with a break after each."""
    names: list[int] = []
    starts, fresh = [], 0
    for words in docs:
        starts.append(len(names))
        own: dict = {}
        for w in words:
            if w not in own:
                own[w] = fresh
                fresh += 1
            names.append(own[w])
        names.append(-1)
    out = np.array(names, dtype=np.int64)
    used = np.bincount(out[out >= 0], minlength=1) if len(out) else np.zeros(1, dtype=np.int64)
    once = (out < 0) | (used[np.maximum(out, 0)] < 2)
    out[once] = -np.arange(1, len(out) + 1, dtype=np.int64)[once]
    # Names small enough for pairs of them to fit an integer.
    kept = out >= 0
    if kept.any():
        out[kept] = np.unique(out[kept], return_inverse=True)[1]
    return out, np.array(starts, dtype=np.int64)


def _occurrence_pairs(gram: np.ndarray, step: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag) of seeds and the places of the same gram ``low`` to ``high`` words on, by lag and place."""
    n = len(gram)
    at = np.flatnonzero(gram >= 0)
    key = gram[at] * np.int64(n + 1) + at
    order = np.argsort(key, kind="stable")
    key, at = key[order], at[order]
    seeds = np.flatnonzero(at % step == 0)
    # A gram's name is below n, so the places asked for stay within the name's own keys.
    first = np.searchsorted(key, key[seeds] + np.minimum(low, n - at[seeds]))
    last = np.searchsorted(key, key[seeds] + np.minimum(high, n - at[seeds]), side="right")
    many = np.maximum(last - first, 0)
    place = np.repeat(at[seeds], many)
    if not len(place):
        return place, place
    other = at[np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())]
    lag = other - place
    order = np.lexsort((place, lag))
    return place[order], lag[order]


def _extend(names: Names, a: np.ndarray, b: np.ndarray, reach: int, back: bool) -> np.ndarray:
    """How many words (fewer than ``reach``) on from places a and b, or back from them, are equal."""
    far = np.zeros(len(a), dtype=np.int64)
    for j in range(max(reach, 1).bit_length() - 1, -1, -1):
        size, level = 1 << j, names.level(j)
        x, y = (a - far - size, b - far - size) if back else (a + far, b + far)
        inside = (x >= 0) & (y + size <= names.n)
        same = np.zeros(len(a), dtype=bool)
        same[inside] = (level[x[inside]] == level[y[inside]]) & (level[x[inside]] >= 0)
        far += same * size
    return far


def find_runs(words: np.ndarray, longest: int, least: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs in a sequence of word names whose documents have at most ``longest`` words."""
    names = Names(words)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    low = 1
    while 2 * low <= longest:
        high = 2 * low - 1
        overlap = min(max(least - q, q) for q in range(low, high + 1))
        step = max(1, overlap // 2)
        k = overlap - step + 1
        gram = names.grams(k)
        place, lag = _occurrence_pairs(gram, step, low, high) if (gram >= 0).any() else (np.empty(0, np.int64),) * 2
        if len(place):
            # The furthest-covered table: a pair that begins within what its lag's last pair covers is not extended anew.
            new = np.concatenate([[True], (np.diff(lag) != 0) | (np.diff(place) > step)])
            head = np.flatnonzero(new)
            tail = np.concatenate([head[1:] - 1, [len(place) - 1]])
            q = lag[head]
            start = place[head] - _extend(names, place[head], place[head] + q, step, back=True)
            end = place[tail] + k + _extend(names, place[tail] + k, place[tail] + k + q, step, back=False)
            wide = end - start >= np.maximum(least - q, q)
            found.append((start[wide], (end + q)[wide], q[wide]))
        low *= 2
    if not found:
        return (np.empty(0, np.int64),) * 3
    start, end, period = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    first = np.concatenate([[True], (np.diff(start) != 0) | (np.diff(end) != 0)]) if len(start) else np.empty(0, bool)
    return start[first], end[first], period[first]


def periodic_runs(docs: list[list], least: int = MIN_LENGTH) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each document, by start, then period."""
    names, starts = word_names(docs)
    out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    start, end, period = find_runs(names, max(map(len, docs), default=0), least)
    own = np.searchsorted(starts, start, side="right") - 1
    order = np.lexsort((period, start))
    for d, s, e, q in zip(own[order].tolist(), start[order].tolist(), end[order].tolist(), period[order].tolist(), strict=True):
        out[d].append((s - int(starts[d]), e - s, q))
    return out


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    drop = np.zeros(len(words) + 1, dtype=np.int64)
    for s, n, q in runs:
        drop[s + q] += 1
        drop[s + n] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()]


def _chunks(batches: Iterator[pa.RecordBatch], size: int):
    """(ids, word lists) of about ``size`` words."""
    ids, docs, n = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
            if docs and n + len(words) > size:
                yield ids, docs
                ids, docs, n = [], [], 0
            ids.append(doc_id)
            docs.append(words)
            n += len(words)
    if docs:
        yield ids, docs


def _task(id_type: pa.DataType, least: int):
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, docs in _chunks(batches, CHUNK_WORDS):
            runs = periodic_runs(docs, least)
            top = [max(r, key=lambda x: (x[1], -x[0], -x[2])) if r else (None,) * 3 for r in runs]
            texts = [b" ".join(collapsed(w, r)).decode("utf-8", "surrogatepass") for w, r in zip(docs, runs, strict=True)]
            listed = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs]
            table = pa.table([
                pa.array([x.as_py() for x in ids], id_type), pa.array([len(r) for r in runs], pa.int64()),
                *(pa.array([t[i] for t in top], pa.int64()) for i in range(3)),
                pa.array(listed, run_type), pa.array(texts, pa.string())],
                names=["doc_id", "n_runs", "start", "length", "period", "runs", "collapsed"])
            yield from table.to_batches()
    return run


def collapse_periods(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN_LENGTH) -> DataFrame:
    """Per row: doc_id, n_runs, start, length and period of the longest run, all runs, and the text without the repeats."""
    from pyspark.sql.pandas.types import to_arrow_type

    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = base.schema["doc_id"].dataType
    return base.mapInArrow(_task(to_arrow_type(kind), least), _SCHEMA.format(id=kind.simpleString()))


def brute_runs(words: list, least: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """All runs by trying every lag (for tests)."""
    found: dict[tuple[int, int], int] = {}
    n = len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, 2 * q):
                found.setdefault((i, length), q)
            i = j
    return sorted((s, n, q) for (s, n), q in found.items())


def spelled_digest(runs: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
