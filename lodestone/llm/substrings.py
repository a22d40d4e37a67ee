"""Substring dedup by sliding spans of sentences and of words.

From every sentence the shortest run of consecutive sentences that has min_words words is hashed, and likewise the
shortest run that ends at each sentence. Equal hashes are joined over the corpus; sentences that any occurrence but the
first covers are removed. A repeated passage of at least min_words words, in whole sentences, is thus found whole.

Passages of more than PASSAGE words are found wherever they begin and end. Of every span of PASSAGE + 1 words the least of
the hashes of its GRAM-word parts is its anchor (winnowing, Schleimer et al. 2003); equal spans have equal anchors, and few
parts are anchors. Spans in a row with one anchor are a block. Anchors are joined over the corpus. A block that equals that
of the anchor's first document, as within copies, stands for its spans; where blocks differ, at the ends of a passage,
chunks of spans are joined, cut where the text itself says so, then parts of the chunks that nothing earlier equals, and of
such parts the spans one by one. A common passage thus costs a document few rows, not one for each span at its ends. Words that any occurrence of a span but the first covers are removed.

Texts are hashed many at a time. Hashes travel with their places, so what comes back for a text is a list of places to cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Scratch

BREAK = re.compile(r"[.!?…。！？\n](?:(?<=[.!?…])(\s+)|(?<=[。！？])()|(?<=\n)(\s*))")
LAST_ID = (1 << 63) - 1
WORD = re.compile(r"\S+")
PASSAGE, GRAM = 50, 20
CHUNK, PART = 8, 2  # spans in a chunk and in a part of one, on average; the first is a multiple of the second
FACTOR = 0x9E3779B97F4A7C15  # any odd number whose powers mix well


@lru_cache(maxsize=64)  # one entry for each power of two
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 .. n of FACTOR and of its inverse, mod 2^64."""
    rise, fall = np.full(n + 1, FACTOR, np.uint64), np.full(n + 1, pow(FACTOR, -1, 1 << 64), np.uint64)
    rise[0] = fall[0] = 1
    return np.cumprod(rise), np.cumprod(fall)


def salted(h: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Hashes made different for each owner."""
    return h.view(np.uint64) ^ (owner.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)


class Hashed:
    """Words of several texts, lower case, as sums from which the hash of any stretch follows.

    ends: where the words of each sentence end, counted over all texts, with 0 in front; sents and at: the number of
    the first sentence and of the first word of each text.
    """

    def __init__(self, texts: list[str]):
        words, sizes, self.sents, self.at = [], [], [0], [0]
        for t in texts:
            for s, _ in sentences(t.lower()):
                own = s.split()
                words += own
                sizes.append(len(own))
            self.sents.append(len(sizes))
            self.at.append(len(words))
        self.n = n = len(words)
        self.ends = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))])
        self.sents, self.at = np.array(self.sents), np.array(self.at)
        rise, self.fall = powers(1 << max(12, n.bit_length()))
        self.up = np.zeros(n + 1, np.uint64)
        np.cumsum(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n) * rise[:n], out=self.up[1:])

    def stretches(self, start, end) -> np.ndarray:
        """Hashes of the words start .. end - 1, for arrays or slices of starts and ends."""
        h = (self.up[end] - self.up[start]) * self.fall[start]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return (h ^ (h >> np.uint64(32))).view(np.int64)

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, place, anchor, hash) of the span of PASSAGE + 1 words from each word on, as far as one fits its text."""
        n, none = self.n, np.empty(0, np.int64)
        if n <= PASSAGE:
            return none, none, none, none
        window = lambda size: self.stretches(slice(0, n + 1 - size), slice(size, n + 1))
        least, have, want = window(GRAM).view(np.uint64), 1, PASSAGE + 2 - GRAM
        while have < want:  # minima of ever longer stretches
            step = min(have, want - have)
            least, have = np.minimum(least[:-step], least[step:]), have + step
        owner = np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))
        place = np.flatnonzero(owner[: n - PASSAGE] == owner[PASSAGE:])
        return owner[place], place, least.view(np.int64)[place], window(PASSAGE + 1)[place]

    def blocks(self) -> tuple[np.ndarray, ...]:
        """(text, anchor, hash, place, number of words, whether one of its spans occurs twice in the text)."""
        owner, place, anchor, own = self.spans()
        _, where, count = np.unique(salted(own, owner), return_inverse=True, return_counts=True)
        new = np.ones(len(place), bool)
        new[1:] = (np.diff(place) != 1) | (np.diff(anchor) != 0) | (np.diff(owner) != 0)
        heads = np.flatnonzero(new)
        if not len(heads):
            return owner, anchor, own, place, place, np.empty(0, bool)
        size = np.diff([*heads, len(place)]) + PASSAGE
        first = place[heads]
        return owner[heads], anchor[heads], self.stretches(first, first + size), first, size, np.logical_or.reduceat(count[where] > 1, heads)

    def runs(self, min_words: int) -> tuple[np.ndarray, ...]:
        """(text, hash, first, number of sentences, whether the hash comes earlier in the text) of the shortest runs from and
        to each sentence, each pair of ends once, in order of first."""
        ends = self.ends
        some = np.flatnonzero(np.diff(ends))
        owner = np.searchsorted(self.sents, some, side="right") - 1
        to = np.searchsorted(ends, ends[some] + min_words)  # the least end with enough words from a start
        since = np.searchsorted(ends, ends[some + 1] - min_words, side="right") - 1
        forth, back = to <= self.sents[owner + 1], since >= self.sents[owner]
        pairs = np.unique(np.concatenate([some[forth] * len(ends) + to[forth], since[back] * len(ends) + some[back] + 1]))
        i, j = pairs // len(ends), pairs % len(ends)
        owner, h = np.searchsorted(self.sents, i, side="right") - 1, self.stretches(ends[i], ends[j])
        return owner, h, i - self.sents[owner], j - i, again(salted(h, owner))

    def chunks(self, anchors: np.ndarray, holders: np.ndarray) -> tuple[list[tuple[np.ndarray, ...]], np.ndarray, np.ndarray]:
        """Of the spans that have one of the anchors of their text, the chunks and the parts of these, each as (text, hash,
        first, number of words, whether the hash comes earlier in the text, first of its spans); and (hash, whether it comes
        earlier in the text) of these spans.

        A chunk, or a part, ends before a span whose hash says so, so equal stretches are cut alike but at their ends.
        """
        owner, place, anchor, own = self.spans()
        earlier = again(salted(own, owner))
        ok = np.isin(salted(anchor, owner), salted(anchors, holders))
        owner, place, own, earlier = owner[ok], place[ok], own[ok], earlier[ok]
        new = np.ones(len(own), bool)
        new[1:] = (np.diff(place) != 1) | (np.diff(owner) != 0)
        levels = []
        for each in (CHUNK, PART):
            heads = np.flatnonzero(new | (own.view(np.uint64) % np.uint64(each) == 0))
            size = np.diff(np.r_[heads, len(place)]) + PASSAGE
            first = place[heads]
            h = self.stretches(first, first + size)
            levels.append((owner[heads], h, first, size, again(salted(h, owner[heads])), heads))
        return levels, own, earlier


def sentences(text: str) -> list[tuple[str, str]]:
    """(sentence, white space after it); together they are the text. Sentences end at .!? before a space, or at a line end."""
    out, at = [], 0
    for m in BREAK.finditer(text):
        end = m.end()
        cut = (m.start(1), end, m.start())[m.lastindex - 1]
        if end > at:
            out.append((text[at:cut], text[cut:end]))
        at = end
    if at < len(text):
        out.append((text[at:], ""))
    return out


def again(h: np.ndarray) -> np.ndarray:
    """Whether the same hash comes earlier."""
    out = np.ones(len(h), bool)
    out[np.unique(h, return_index=True)[1]] = False
    return out


def without(sent: str, keep: np.ndarray) -> str:
    """A sentence's words that keep marks, each with the white space after it; none at its end if its last word goes."""
    at = [m.start() for m in WORD.finditer(sent)]
    out = sent[: at[0]] + "".join(sent[i:j] for i, j, k in zip(at, [*at[1:], len(sent)], keep) if k)
    return out if keep[-1] else out.rstrip()


def strip(text: str | None, runs: list[tuple[int, int]], words: list[tuple[int, int]]) -> tuple[str | None, int, int]:
    """Text without the given runs of sentences and stretches of words, both as (first, number); sentence count, count of
    sentences removed in whole or part."""
    if text is None:
        return None, 0, 0
    if not runs and not words:
        at = n = 0
        for m in BREAK.finditer(text):
            at, n = m.end(), n + 1
        return text, n + (at < len(text)), 0
    sents = sentences(text)
    depth = np.zeros(len(sents) + 1, np.int64)
    if runs:
        first, size = np.array(runs, np.int64).T
        np.add.at(depth, first, 1)
        np.add.at(depth, first + size, -1)
    gone = np.cumsum(depth)[:-1] > 0
    keep, counts = None, [0] * len(sents)
    if words:
        counts = [len(s.split()) for s, _ in sents]
        step = np.zeros(sum(counts) + 1, np.int64)
        first, size = np.array(words, np.int64).T
        np.add.at(step, first, 1)
        np.add.at(step, first + size, -1)
        keep = np.cumsum(step)[:-1] == 0
    kept, removed, at = [], 0, 0
    for (a, b), off, n in zip(sents, gone.tolist(), counts):
        left = keep[at : at + n] if n else None
        at += n
        if off or left is not None and not left.any():
            removed += 1
        elif left is None or left.all():
            kept.append(a + b)
        else:
            removed += 1
            kept.append(without(a, left) + b)
    return ("".join(kept).rstrip() if removed else text), len(sents), removed


FOUND = "doc long, key long, kind boolean, h long, block long, at int, size int, again boolean"
CHUNKS = FOUND + ", parts array<struct<h: long, at: int, size: int, again: boolean, spans: array<struct<h: long, again: boolean>>>>"
CHARS = 1 << 20  # characters of text that are hashed at a time


def groups(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch, with the texts in its third column, of about CHARS characters and one text at least."""
    sizes = pc.binary_length(batch.column(2)).to_pylist()
    a = held = 0
    for b, size in enumerate([*sizes, None]):
        if b > a and (size is None or held + size > CHARS):
            part = batch.slice(a, b - a)
            yield part, part.column(2).to_pylist()
            a, held = b, 0
        held += size or 0


def found_batch(part: pa.RecordBatch, kind: bool, owner: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """FOUND from the hashes, blocks, places, sizes and repeats of texts of the slice; places count from each text's start."""
    of = pa.array(owner)
    return pa.RecordBatch.from_arrays(
        [part.column(0).take(of), part.column(1).take(of), pa.array(np.full(len(owner), kind)), *(pa.array(c.astype(t)) for c, t in zip(columns, (np.int64, np.int64, np.int32, np.int32, bool)))],
        [c.split()[0] for c in FOUND.split(", ")],
    )


def shared(found: DataFrame, scratch: Scratch, name: str, how: str = "inner") -> DataFrame:
    """FOUND for the hashes that several documents or one text several times have, with `first`, the least document, `lead`, a
    block of it, and `mixed`, whether blocks differ or a text has one several times. how: left keeps all others too."""
    # minima and maxima are made before the shuffle, so a hash that every document has costs one row a task
    first = found.groupBy("kind", "h").agg(
        F.min("doc").alias("first"), F.max("doc").alias("last"), F.max("again").alias("any"), F.min_by("block", "doc").alias("lead"), (F.min("block") != F.max("block")).alias("differ"),
    )
    first = first.where("first < last or any").select("kind", "h", "first", "lead", F.expr("differ or any").alias("mixed"))
    # a common passage is a key with a row for each document: plain tables on both sides, so that Spark can split it
    return found.join(scratch.table(first, name), ["kind", "h"], how)


def judged(found: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """All of shared(), with `later`, whether the row comes after another of its hash."""
    rows = shared(found, scratch, name, "left")
    return scratch.table(rows.withColumn("later", F.coalesce(F.expr("doc > first or again"), F.lit(False))), "judged")


def repeated_runs(texts: DataFrame, text_col: str, min_words: int, scratch: Scratch, within_sentences: bool) -> DataFrame:
    """(doc, key, runs, words): for each text what is to go, as strip() takes it. texts: doc, key and text."""

    def occurrences(batches):
        for batch in batches:
            for part, texts in groups(batch):
                hashed = Hashed(texts)
                owner, h, first, size, repeats = hashed.runs(min_words)
                yield found_batch(part, False, owner, h, h, first, size, repeats)
                if within_sentences:
                    owner, anchor, block, place, size, twice = hashed.blocks()
                    yield found_batch(part, True, owner, anchor, block, place - hashed.at[owner], size, twice)

    def passages(batches):
        for batch in batches:
            for part, texts in groups(batch):
                hashed = Hashed(texts)
                known = part.column(3)
                holder = np.repeat(np.arange(len(texts)), pc.list_value_length(known).to_numpy())
                levels, own, earlier = hashed.chunks(known.flatten().to_numpy(), holder)
                nested = pa.StructArray.from_arrays([pa.array(own), pa.array(earlier)], ["h", "again"])
                (owner, h, place, size, repeats, heads), (holder, *columns, cuts) = levels
                nested = pa.ListArray.from_arrays(pa.array(np.r_[cuts, len(own)].astype(np.int32)), nested)
                columns[1] = columns[1] - hashed.at[holder]
                columns = [pa.array(c.astype(t)) for c, t in zip(columns, (np.int64, np.int32, np.int32, bool))]
                nested = pa.StructArray.from_arrays([*columns, nested], ["h", "at", "size", "again", "spans"])
                nested = pa.ListArray.from_arrays(pa.array(np.r_[np.searchsorted(cuts, heads), len(cuts)].astype(np.int32)), nested)
                rows = found_batch(part, True, owner, h, h, place - hashed.at[owner], size, repeats)
                yield pa.RecordBatch.from_arrays([*rows.columns, nested], [*rows.schema.names, "parts"])

    found = scratch.table(texts.select("doc", "key", text_col).mapInArrow(occurrences, FOUND), "found")
    both = shared(found, scratch, "repeated").where("doc > first or again or kind and mixed")
    both = scratch.table(both, "shared")
    scratch.drop(found)
    later = both.where("not kind and (doc > first or again) or kind and block = lead and doc > first")
    if within_sentences:
        mixed = both.where("kind and (block <> lead or doc = first and mixed)").groupBy("doc", "key").agg(F.collect_set("h").alias("known"))
        chunks = texts.join(mixed, ["doc", "key"]).select("doc", "key", text_col, "known").mapInArrow(passages, CHUNKS)
        chunks = judged(scratch.table(chunks, "chunks"), scratch, "repeated_chunks")
        # the first occurrence of a span is in no chunk that comes later, so these need not be looked at again; nor need such parts
        parts = chunks.where("not later").select("doc", "key", "kind", F.inline("parts")).withColumn("block", F.col("h"))
        parts = judged(scratch.table(parts, "parts"), scratch, "repeated_parts")
        spanned = parts.where("not later").select("doc", "key", "kind", "at", F.posexplode("spans").alias("k", "span"))
        spanned = spanned.select("doc", "key", "kind", "span.h", F.col("span.h").alias("block"), (F.col("at") + F.col("k")).alias("at"), F.lit(PASSAGE + 1).alias("size"), "span.again")
        spanned = shared(scratch.table(spanned, "spans"), scratch, "repeated_spans").where("doc > first or again")
        later = later.unionByName(chunks.where("later").drop("later", "parts")).unionByName(parts.where("later").drop("later", "spans")).unionByName(spanned)
    # at most two runs for each sentence of a text and a span for each word, whatever the number of rows with that text
    place = F.struct("at", "size")
    return later.groupBy("doc", "key").agg(F.collect_set(F.when(~F.col("kind"), place)).alias("runs"), F.collect_set(F.when(F.col("kind"), place)).alias("words"))


def ranges(col: pa.ListArray) -> list[list[tuple[int, int]]]:
    """The (at, size) of each row."""
    flat, end, out = col.flatten(), 0, []
    pairs = list(zip(flat.field(0).to_numpy(False).tolist(), flat.field(1).to_numpy(False).tolist()))
    for n in pc.fill_null(pc.list_value_length(col), 0).to_pylist():
        out.append(pairs[end : end + n])
        end += n
    return out


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 25, within_sentences: bool = False) -> DataFrame:
    """All columns of docs with repeated passages taken out of text, and n_sentences, n_removed.

    Passages are runs of whole sentences of min_words words or more and, if within_sentences, any stretches of more than
    PASSAGE words; n_removed counts the sentences that lost all or part of their words. Words are compared in lower case,
    whatever white space divides them.

    The first occurrence is that in the document of least id, there the earliest. Null texts stay null, with counts
    0. A null id comes after all others. Rows that share an id count as one document when first occurrences are
    sought, each with its own text. A text that repeats one sentence on and on keeps the first of them: later runs
    overlap the first. Columns n_sentences, n_removed are replaced, others stay whatever their names; an empty table gives
    no rows.
    """
    scratch = Scratch(docs.sparkSession)
    names = [c for c in docs.columns if c.lower() not in ("n_sentences", "n_removed")]
    rows = docs.select(
        F.coalesce(F.col(f"`{id_col}`"), F.lit(LAST_ID)).alias("doc"), F.xxhash64(F.col(f"`{text_col}`")).alias("key"),
        F.col(f"`{text_col}`").alias("text"), F.struct(*[F.col(f"`{c}`") for c in names if c != text_col]).alias("rest"),
    )
    cut = repeated_runs(rows.where("text is not null"), "text", min_words, scratch, within_sentences)
    rows = rows.join(cut, ["doc", "key"], "left").select("text", "rest", "runs", "words")
    rest = rows.schema["rest"]

    def clean(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 500):  # long texts are held a few at a time
                part = batch.slice(a, 500)
                got = [strip(*x) for x in zip(part.column(0).to_pylist(), ranges(part.column(2)), ranges(part.column(3)))]
                text, n, removed = zip(*got)
                yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()), part.column(1), pa.array(n, pa.int64()), pa.array(removed, pa.int64())], ["text", "rest", "n_sentences", "n_removed"])

    made = rows.mapInArrow(clean, StructType([rows.schema["text"], rest, *StructType.fromDDL("n_sentences long, n_removed long").fields]))
    return made.select(*[F.col("text").alias(c) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in names], "n_sentences", "n_removed")
