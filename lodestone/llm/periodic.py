"""Periodic runs of words: Karp-Miller-Rosenberg names of power-of-two blocks, candidates on a grid, all in NumPy.

Blocks of 1, 2, 4, ... words get the same number exactly if they are equal (Karp, Miller and Rosenberg 1972): a block's name
comes from the pair of names of its halves. How far two places agree is read off by descending levels. A run of period q
holds a stretch of q words or more that equal the word q further on, so one of the places 0, q, 2q, ... lies in it: from
those places agreement is extended to both sides. Many texts are searched at once; words of different texts never agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

WORDS = 200_000  # of texts that are searched together; a longer text is searched alone
CANDIDATES = 1 << 20  # of places that are looked at together
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def numbered(texts: list[list[bytes]]) -> np.ndarray:
    """A number for each word of all texts, end to end: equal for equal words of one text, else different."""
    out, at = [], 0
    for words in texts:
        seen: dict[bytes, int] = {}
        out.append(np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words)) + at)
        at += len(seen)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def named(keys: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """Names 0, 1, ... for the places whose key occurs more than once, -1 for all others and one more place at the end."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    often = np.bincount(group, minlength=1) > 1
    name = np.where(often, np.cumsum(often) - 1, -1)
    out = np.full(n + 1, -1, np.int32)
    out[places[order]] = name[group]
    return out


def levels(words: np.ndarray) -> list[np.ndarray]:
    """Names of the blocks of 1, 2, 4, ... words that start at each place, as long as any block occurs twice."""
    n, out = len(words), []
    now = named(words, np.arange(n), n)
    while (now >= 0).any():
        out.append(now)
        size = 1 << (len(out) - 1)
        left = np.flatnonzero(now[: max(0, n - size)] >= 0)
        left = left[now[left + size] >= 0]
        now = named(now[left].astype(np.int64) * (n + 1) + now[left + size], left, n)
    return out


def agreement(names: list[np.ndarray], a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
    """How many words from places a and b on (or before them, if back) are the same; b > a."""
    out = np.zeros(len(a), np.int64)
    for k in range(len(names) - 1, -1, -1):
        size = 1 << k
        x, y = (a - out - size, b - out - size) if back else (a + out, b + out)
        fine = x >= 0
        x = np.where(fine, x, 0)
        got = names[k][x]
        out += size * (fine & (got >= 0) & (got == names[k][np.where(fine, y, 0)]))
    return out


def grid(n: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) for every period up to most and its multiples, some periods at a time."""
    q = 1
    while q <= most:
        last, held = q, 0
        while last <= most and (held == 0 or held + n // last < CANDIDATES):
            held += n // last + 1
            last += 1
        periods = np.arange(q, last)
        count = np.maximum(0, -(-(n - periods) // periods))
        period = np.repeat(periods, count)
        yield (np.arange(len(period)) - np.repeat(np.cumsum(count) - count, count)) * period, period
        q = last


def find(words: np.ndarray, shortest: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs in numbered words, by start and then period."""
    names, n = levels(words), len(words)
    most = min(n // 2, (1 << len(names)) - 1) if names else 0  # no stretch as long as a block beyond the levels occurs twice
    got = []
    for place, period in grid(n, most):
        # a word alone says little, and few words are at both places
        near = np.flatnonzero((names[0][place] >= 0) & (names[0][place] == names[0][place + period]))
        place, period = place[near], period[near]
        before = agreement(names, place, place + period, back=True)
        same = before + agreement(names, place, place + period)
        fits = same >= np.maximum(period, shortest - period)
        got.append(np.stack([place - before, same + period, period])[:, fits])
    start, length, period = np.concatenate(got, axis=1) if got else np.zeros((3, 0), np.int64)
    # a stretch that is found for several periods is a run of the smallest, of which the others are multiples
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    first = np.r_[True, (start[1:] != start[:-1]) | (length[1:] != length[:-1])] if len(start) else np.zeros(0, bool)
    start, length, period = start[first], length[first], period[first]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def repeats(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of n words lie in a run beyond its first period."""
    change = np.bincount(start + period, minlength=n + 1)[: n + 1] - np.bincount(start + length, minlength=n + 1)[: n + 1]
    return np.cumsum(change)[:n] > 0


def searched(texts: list[bytes], shortest: int) -> pa.RecordBatch:
    """(n_words, runs, collapsed) of each text."""
    split = [t.split() for t in texts]  # of bytes: at the ASCII white space
    ends = np.cumsum([len(w) for w in split], dtype=np.int64)
    start, length, period = find(numbered(split), shortest)
    gone = repeats(int(ends[-1]), start, length, period)
    owner = np.searchsorted(ends, start, side="right")
    begins = ends - [len(w) for w in split]
    struct = pa.StructArray.from_arrays([pa.array(start - begins[owner]), pa.array(length), pa.array(period)], fields=list(RUN))
    offsets = np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)
    some = np.add.reduceat(np.r_[gone, False], np.minimum(begins, len(gone))) if len(gone) else np.zeros(len(texts))
    joined = [b" ".join([w for w, g in zip(words, gone[a : a + len(words)].tolist()) if not g] if words and k else words) for words, a, k in zip(split, begins.tolist(), some.tolist())]
    return pa.RecordBatch.from_arrays([pa.array(ends - begins), pa.ListArray.from_arrays(pa.array(offsets), struct), pa.array(joined, pa.binary()).view(pa.string())], ["n_words", "runs", "collapsed"])


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 12) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for each row; words are `[^\\x20\\x09-\\x0D]+`, numbered from 0.

    runs: array of (start, length, period), by start and then period. A run is a stretch of words with smallest period q, of
    max(shortest, 2 q) words or more, that cannot be extended to either side with that period. collapsed: the words joined by
    one space, without those that a run contains after its first q words.

    Null, empty and blank texts have no words, no runs and an empty collapsed text. Rows are searched each on its own, so
    repeated rows and ids and null ids come out as they go in; an empty table gives no rows; other columns are left out. A
    text's names take 4 bytes for each word and level; there are as many levels as doublings of its longest repeated stretch.
    """
    if shortest < 2:
        raise ValueError("a run has two words at least")
    rows = docs.select(docs[f"`{id_col}`"].alias("doc_id"), docs[f"`{text_col}`"].alias("text"))

    def search(batches):
        for batch in batches:
            texts, at = batch.column(1).cast(pa.binary()), 0
            while at < len(texts):
                part, size = [], 0
                while at + len(part) < len(texts) and (not part or size < 6 * WORDS):  # some six bytes a word
                    part.append(texts[at + len(part)].as_py() or b"")
                    size += len(part[-1])
                made = searched(part, shortest)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), *made.columns], ["doc_id", *made.schema.names])
                at += len(part)

    return rows.mapInArrow(search, StructType([rows.schema["doc_id"], *StructType.fromDDL("n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string").fields]))
