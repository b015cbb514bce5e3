"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of documents of one task, about SHARD_WORDS words. Its words are numbered by the
benchmark's vocabulary; a word outside it breaks the text, and runs that are shorter than the
shortest test phrase are left out, as no phrase can lie in them. The shard's FM-index is searched
backwards for all test phrases at once, occurrences are located by sampled suffix positions, and
overlapping ones are merged into removal spans. There is no shuffle: only the phrases travel.

The benchmark's phrases go to the executors in blocks of at most BLOCK_BYTES of item text; a larger
benchmark takes several passes, whose spans are merged, so what is broadcast stays bounded. Removal cuts the merged spans
of all passes at once, and takes the passes again over the documents that it cut until no phrase is
left, so the blocks do not show in the result.

Defined results: null and empty texts have no words and are never hit; items without words have no
phrase; an item without an id can hit but is not named or counted; equal items each count; repeated
rows are scanned as they come; a very long text is cut into overlapping segments, so that no
occurrence is lost; an empty benchmark hits nothing. Other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitweave.llm.common import arrow_map, free_of, grouped_batches, session_for_texts, written
from orbitweave.llm.fm_index import FMIndex

#: Words of a phrase.
WINDOW = 10
SHARD_WORDS = 400_000
SLICE_BYTES = 4_000_000
BLOCK_BYTES = 16_000_000
#: A-Z to a-z; every other ASCII character but 0-9 and a-z to a space.
FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))

FOUND = ["n_words", "items", "spans"]
HITS = "n_words bigint, items array<string>, spans array<struct<start: bigint, end: bigint>>"


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


class Phrases:
    """The distinct phrases of a block of items, and which items hold each: one row of numbers for each
    phrase of an item, sorted once."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.ids: list[str | None] = []
        rows, owners = [np.zeros((0, window), np.int32)], [np.zeros(0, np.int64)]
        for item_id, text in items:
            words = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 2) for w in words_of(text or "")], np.int32)
            if len(words):
                # an item of fewer words is one row, filled up with zeros
                own = np.lib.stride_tricks.sliding_window_view(np.pad(words, (0, max(0, window - len(words)))), window)
                rows.append(own)
                owners.append(np.full(len(own), len(self.ids)))
                self.ids.append(item_id)
        self.patterns, phrase = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        self.lengths = (self.patterns > 0).sum(1)
        held = np.unique(np.stack([phrase.ravel(), np.concatenate(owners)], 1), axis=0)
        self.items, self.item_start = held[:, 1], np.searchsorted(held[:, 0], np.arange(len(self.patterns) + 1))
        self.shortest = int(self.lengths.min()) if len(self.lengths) else 0
        self.longest = int(self.lengths.max()) if len(self.lengths) else 0
        self.n_symbols = len(self.vocabulary) + 2

    def numbers(self, text: str) -> np.ndarray:
        """Symbols of a text's words; 1 for words outside the vocabulary. Words exist as Python
        objects for a slice at a time only."""
        raw = text.encode("utf-8", "surrogatepass").translate(FOLD)
        parts, at = [], 0
        while at < len(raw):
            end = len(raw) if len(raw) - at <= SLICE_BYTES else raw.find(b" ", at + SLICE_BYTES)
            end = len(raw) if end < 0 else end
            parts.append(np.fromiter(map(self.vocabulary.get, raw[at:end].split(), repeat(1)), np.int32))
            at = end
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)


def runs_of(symbols: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of vocabulary words that can hold a phrase."""
    known = np.concatenate(([0], (symbols > 1).view(np.int8), [0]))
    edge = np.diff(known)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = end - start >= shortest
    return start[long], end[long]


def occurrences(segments: list[tuple[int, int, np.ndarray]], phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """segments: (document, first word's number, symbols). One shard's index is built and searched;
    returns document, word number and phrase of each occurrence."""
    pieces, docs, words, starts, n = [], [], [], [], 0
    for doc, base, symbols in segments:
        for a, b in zip(*runs_of(symbols, phrases.shortest), strict=True):
            pieces += [symbols[a:b], [1]]
            docs.append(doc)
            words.append(base + a)
            starts.append(n)
            n += b - a + 1
    none = np.zeros(0, np.int64)
    if not pieces:
        return none, none, none
    index = FMIndex(np.concatenate(pieces), phrases.n_symbols)
    low, high = index.ranges(phrases.patterns, phrases.lengths)
    count = high - low
    phrase = np.repeat(np.arange(len(count)), count)
    rows = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
    at = index.locate(rows)
    run = np.searchsorted(np.array(starts), at, "right") - 1
    return np.array(docs)[run], np.array(words)[run] + at - np.array(starts)[run], phrase


def search(texts: list[str], phrases: Phrases, shard_words: int = SHARD_WORDS) -> Iterator[tuple[int, list[str], list[tuple[int, int]]]]:
    """For each text its number of words, the ids of the items that it holds, and merged spans of
    hit words [start, end)."""
    n_words = np.zeros(len(texts), np.int64)
    found, shard, size = [], [], 0
    for i, text in enumerate(texts):
        symbols = phrases.numbers(text)
        n_words[i] = len(symbols)
        for base in range(0, len(symbols) if phrases.shortest else 0, shard_words):
            part = symbols[base : base + shard_words + phrases.longest - 1]
            shard.append((i, base, part))
            size += len(part)
            if size >= shard_words:
                found.append(occurrences(shard, phrases))
                shard, size = [], 0
    if shard:
        found.append(occurrences(shard, phrases))
    doc, word, phrase = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in range(3))
    order = np.lexsort((word, doc))
    doc, word, phrase = doc[order], word[order], phrase[order]
    cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
    for i in range(len(texts)):
        a, b = cuts[i], cuts[i + 1]
        if a == b:
            yield int(n_words[i]), [], []
            continue
        held = np.unique(phrase[a:b])
        items = np.unique(np.concatenate([phrases.items[phrases.item_start[p] : phrases.item_start[p + 1]] for p in held]))
        yield int(n_words[i]), sorted({x for k in items if (x := phrases.ids[k]) is not None}), merged(word[a:b], word[a:b] + phrases.lengths[phrase[a:b]])


def merged(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Overlapping or touching spans, given by rising start, become one."""
    reach = np.maximum.accumulate(end)
    new = np.concatenate(([True], start[1:] > reach[:-1]))
    first = np.flatnonzero(new)
    return list(zip(start[first].tolist(), reach[np.concatenate((first[1:], [len(start)])) - 1].tolist(), strict=True))


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them."""
    raw = text.encode("utf-8", "surrogatepass")
    folded = raw.translate(FOLD)
    import re

    bounds = np.fromiter((x for m in re.finditer(rb"[^ ]+", folded) for x in m.span()), np.int64).reshape(-1, 2)
    kept, at = [], 0
    for a, b in spans:
        kept.append(raw[at : bounds[a, 0]])
        at = int(bounds[b - 1, 1])
    kept.append(raw[at:])
    return b"\n".join(kept).decode("utf-8", "surrogatepass")


def clean(text: str, spans: list[tuple[int, int]], phrases: Phrases) -> str:
    """The text without its spans; where the cut brings a new phrase together, that goes too."""
    while spans:
        text = without_spans(text, spans)
        (_, _, spans), = search([text], phrases)
    return text


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", remove: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with the columns n_words, items (ids of the benchmark items with a phrase in the text,
    sorted) and spans (merged runs of hit words). With remove, the text loses its spans; spans and
    items then still tell what went. Columns of docs that have one of these names are not kept: the new
    ones win."""
    docs = docs.select(free_of(docs.columns, FOUND))
    spark = docs.sparkSession
    session_for_texts(spark)
    source = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).cast("string").alias("t")).where(F.col("t").isNotNull())
    total = source.agg(F.sum(F.octet_length("t")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-total // block_bytes))
    at = docs.columns.index(text)
    if blocks == 1 or not remove:
        return _searched(docs, at, source, blocks, remove)
    # spans of all blocks on one text, then the cut, then all blocks again on what was cut
    found = _searched(docs, at, source, blocks, False)
    out, todo = found.where(F.size("spans") == 0), found.where(F.size("spans") > 0).withColumns({f"_{c}": F.col(c) for c in FOUND})
    while not todo.isEmpty():
        # the found columns of the first round stand after the text's own, those of this round last
        cut = _cut(todo.drop("n_words", "items").select(*(F.col(c) for c in docs.columns), *(F.col(f"_{c}") for c in FOUND), "spans"), at)
        found = _searched(written(cut, "decontaminate"), at, source, blocks, False)
        clean_now = found.where(F.size("spans") == 0)
        out = out.unionByName(clean_now.drop(*FOUND).withColumnsRenamed({f"_{c}": c for c in FOUND}))
        todo = found.where(F.size("spans") > 0)
    return out


def _searched(docs: DataFrame, at: int, source: DataFrame, blocks: int, remove: bool) -> DataFrame:
    """docs with the columns FOUND over all blocks of items; remove is for one block alone."""
    out = docs.withColumns({"n_words": F.lit(0).cast("bigint"), "items": F.array().cast("array<string>"), "spans": F.array().cast("array<struct<start: bigint, end: bigint>>")})
    for k in range(blocks):
        part = source if blocks == 1 else source.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == k)
        rows = part.collect()  # at most about block_bytes of text
        held = docs.sparkSession.sparkContext.broadcast(Phrases([(r["i"], r["t"]) for r in rows]))
        out = _pass(out, at, held, remove)
        if blocks > 1:
            out = written(out, "decontaminate")
            held.unpersist()
    return out


def _cut(docs: DataFrame, at: int) -> DataFrame:
    """docs without the words of spans, their last column, and without that column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, spans = list(batch.columns)[:-1], batch.column(batch.num_columns - 1).to_pylist()
            columns[at] = pa.array([without_spans(t, [(x["start"], x["end"]) for x in s]) for t, s in zip(batch.column(at).to_pylist(), spans, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return arrow_map(docs, run, docs.drop("spans").schema)


def _pass(docs: DataFrame, at: int, held, remove: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = held.value
        for batch in grouped_batches(batches, 2_000_000):
            texts = [x or "" for x in batch.column(at).to_pylist()]
            n_words, items, spans, cleaned = [], [], [], []
            before = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            for text, (n, i, s), i0, s0 in zip(texts, search(texts, phrases), *before, strict=True):
                n_words.append(n)
                items.append(sorted({*i, *i0}))
                if s0:
                    spot = np.array(sorted([*s, *((x["start"], x["end"]) for x in s0)]))
                    spans.append(merged(spot[:, 0], spot[:, 1]))
                else:
                    spans.append(s)
                cleaned.append(clean(text, s, phrases) if remove and s else None)
            columns = list(batch.columns)[:-3]
            if remove and any(x is not None for x in cleaned):
                columns[at] = pa.array([c if c is not None else t for c, t in zip(cleaned, batch.column(at).to_pylist(), strict=True)], pa.string())
            columns += [pa.array(n_words, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return arrow_map(docs, run, docs.schema)


def n_hit(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
