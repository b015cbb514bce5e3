"""How far the sources of a language differ in their words.

A numpy lookup table over the concatenated UTF-8 bytes of many texts tells letters from the rest and
lower-cases A to Z; terms are where runs of letters begin and end. xxhash groups the slices; each is
compared byte for byte with the first of its group, and slices of different bytes under one hash
are told apart by their bytes. Counts of (lang, source, term) are combined inside a task before they
are shuffled, by (lang, term), so that one shuffle serves the counts and the documents of a term.

The terms of a language are dealt by hash into blocks of about BLOCK counts. A block is a CSR matrix,
sources by terms; reduceat over its rows gives each pair's part of the divergence, and parts are
summed over blocks. A term that neither source has gives the same value for all of them, so it is
counted, not visited.

Shares are integers: p = 1 + floor(10**9 (count + 2) / (N + 2 V)), with N the sum of a group's counts
over the V terms that its language keeps. All results are exact, whatever the order of sums.

Defined results: null text, lang and source are empty ones. A group without terms has its share of
smoothing; a language that keeps no term has pairs of value 0 and no term rows. Repeated rows count
each time. Equal values are ranked by the bytes of their items. An empty table gives an empty result.
A text longer than CHUNK is cut alone, whole. Other columns of any name are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbitweave import workers
from orbitweave.llm.common import arrow_map, written

#: Bytes of text that are cut into terms at a time; a longer text is taken alone.
CHUNK = 4_000_000
#: Different (lang, source, term) that a task holds before it sends its counts on.
HELD = 400_000
#: Counts of a block of terms.
BLOCK = 200_000
ONE = 1_000_000_000

#: For each byte: itself if it is part of a term, lower-cased; 0 otherwise.
LETTERS = np.zeros(256, np.uint8)
LETTERS[ord("a") : ord("z") + 1] = LETTERS[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
LETTERS[0x80:] = np.arange(0x80, 0x100)

COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def slices(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """data (bytes) lower-cased, and of its terms: first byte, byte after the last, number of the text.
    offsets: where texts begin, and the end of the last."""
    low = LETTERS[data]
    inside = low != 0
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]  # a term ends with its text
    begins[edges] |= inside[edges]
    ends[edges - 1] |= inside[edges - 1]
    first = np.flatnonzero(begins)
    return low, first, np.flatnonzero(ends) + 1, np.searchsorted(offsets, first, "right") - 1


def grouped(low: np.ndarray, first: np.ndarray, end: np.ndarray, digest: Callable[[bytes], int] = xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, list[bytes]]:
    """For each slice the number of its term, and the terms. Slices meet by hash and are then compared
    with the first of their group; those that differ from it are grouped by their bytes."""
    data = low.tobytes()
    cut = [data[a:b] for a, b in zip(first.tolist(), end.tolist(), strict=True)]
    hashes = np.fromiter(map(digest, cut), np.uint64, len(cut))
    _, head, group = np.unique(hashes, return_index=True, return_inverse=True)
    terms = [cut[k] for k in head.tolist()]
    own: dict[bytes, int] = {}
    for k, (term, g) in enumerate(zip(cut, group.tolist(), strict=True)):
        if term != terms[g]:
            if term not in own:
                own[term] = len(terms)
                terms.append(term)
            group[k] = own[term]
    return group, terms


def counted(lang: list[str], source: list[str], texts: pa.Array) -> pa.Table:
    """COUNTS of some documents: occurrences of terms and documents with them, by lang and source."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32 if texts.type == pa.string() else np.int64)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    low, first, end, doc = slices(data, offsets - offsets[0])
    term, terms = grouped(low, first, end)
    if not terms:
        return COUNTS.empty_table()
    places: dict[tuple[str, str], int] = {}
    place = np.fromiter((places.setdefault(x, len(places)) for x in zip(lang, source, strict=True)), np.int64, len(lang))
    each, n = np.unique(doc * len(terms) + term, return_counts=True)  # documents with their terms
    key = place[each // len(terms)] * len(terms) + each % len(terms)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    names = list(places)
    of, which = key[at] // len(terms), key[at] % len(terms)
    # slices of valid UTF-8 between ASCII bytes are valid UTF-8
    return pa.table([
        pa.array([x[0] for x in names], pa.string()).take(pa.array(of)), pa.array([x[1] for x in names], pa.string()).take(pa.array(of)),
        pa.array(terms, pa.binary()).cast(pa.string()).take(pa.array(which)), pa.array(np.add.reduceat(n, at)), pa.array(np.diff(np.r_[at, len(key)]))], schema=COUNTS)


def combined(tables: list[pa.Table]) -> pa.Table:
    got = pa.concat_tables(tables).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return pa.table([got["lang"], got["source"], got["term"], got["n_sum"], got["docs_sum"]], schema=COUNTS)


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of lang, source, text without nulls to COUNTS, combined over HELD different ones."""
    held: list[pa.Table] = []
    for batch in batches:
        texts = batch.column(2)
        sizes = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(texts):
            done = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, done + CHUNK, "right")))
            held.append(counted(batch.column(0).slice(at, to - at).to_pylist(), batch.column(1).slice(at, to - at).to_pylist(), texts.slice(at, to - at)))
            at = to
            if sum(t.num_rows for t in held) > 2 * HELD:
                held = [combined(held)]
                if held[0].num_rows > HELD:
                    yield from held.pop().combine_chunks().to_batches()
    if held:
        yield from combined(held).combine_chunks().to_batches()


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term."""
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (lang, source, text)))
    parts = arrow_map(rows, count_batches, "lang string, source string, term string, n long, docs long")
    # dealt by (lang, term), of which both the counts and the documents of a term are made
    return parts.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, least_docs: int) -> DataFrame:
    """counts of those terms that stand in at least so many documents of their language; leads marks
    one row of each term of a language."""
    term = Window.partitionBy("lang", "term")
    of = counts.withColumns({"_docs": F.sum("docs").over(term), "_first": F.min("source").over(term)})
    return of.where(F.col("_docs") >= least_docs).select("lang", "source", "term", "n", (F.col("source") == F.col("_first")).alias("leads"))


def shares(counts: np.ndarray, total: int, kept: int) -> np.ndarray:
    """1 + floor(ONE (count + 2) / (total + 2 kept)), exact: 64 bits where they hold the product."""
    if not len(counts) or int(counts.max()) < 9_000_000_000:
        return 1 + ONE * (counts.astype(np.int64) + 2) // (total + 2 * kept)
    return np.array([1 + ONE * (int(c) + 2) // (total + 2 * kept) for c in counts], np.int64)


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)**2 / (p + q)); shares are at most ONE + 1, so 64 bits hold the square."""
    return (p - q) ** 2 // (p + q)


def rows_summed(values: np.ndarray, indptr: np.ndarray) -> np.ndarray:
    """Sums over the rows of a CSR matrix; reduceat has no empty rows, so they are put in after."""
    out = np.zeros(len(indptr) - 1, np.int64)
    full = np.flatnonzero(np.diff(indptr))
    if len(full):
        out[full] = np.add.reduceat(values, indptr[full])
    return out


def block_gaps(groups: pa.Table, counts: pa.Table, top: int) -> Iterator[tuple[str, np.ndarray, list[str], np.ndarray]]:
    """For each source of a block (groups: source, total, kept, lang_total; counts: source, term, n):
    its name; for all sources in the order of groups the sum of gaps over the block's terms; terms
    that may be among its top ones, and their values."""
    names, totals = groups["source"].to_pylist(), groups["total"].to_pylist()
    kept, lang_total = groups["kept"][0].as_py(), groups["lang_total"][0].as_py()
    at = {x: k for k, x in enumerate(names)}
    row = np.fromiter((at[x] for x in counts["source"].to_pylist()), np.int64, counts.num_rows)
    coded = counts["term"].combine_chunks().dictionary_encode()
    terms, column, n = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64), counts["n"].to_numpy()
    order = np.lexsort((column, row))
    row, column, n = row[order], column[order], n[order]
    indptr = np.searchsorted(row, np.arange(len(names) + 1))
    base = np.array([int(shares(np.zeros(1, np.int64), t, kept)[0]) for t in totals], np.int64)
    data = np.concatenate([shares(n[indptr[k] : indptr[k + 1]], totals[k], kept) for k in range(len(names))])
    by_term = np.argsort(column, kind="stable")
    overall = shares(np.add.reduceat(n[by_term], np.searchsorted(column[by_term], np.arange(len(terms)))), lang_total, kept)
    dense, has = np.zeros(len(terms), np.int64), np.zeros(len(terms), bool)
    for k, name in enumerate(names):
        p, own = data[indptr[k] : indptr[k + 1]], column[indptr[k] : indptr[k + 1]]
        dense[:], has[:] = base[k], False
        dense[own], has[own] = p, True
        # terms of the others; own terms, less those that the others have too; terms that neither has
        both = has[column]
        theirs = rows_summed(gap(dense[column], data), indptr)
        each, often = np.unique(p, return_counts=True)
        mine = sum((often[i] * gap(each[i], base) for i in range(len(each))), np.zeros(len(names), np.int64))
        shared = rows_summed(np.where(both, gap(dense[column], base[row]), 0), indptr)
        met = np.diff(indptr) + len(own) - rows_summed(both.astype(np.int64), indptr)
        q = overall[own]
        value = np.where(p > q, gap(p, q), -1)
        some = np.flatnonzero(value >= 0)
        if len(some) > top:
            some = some[value[some] >= np.partition(value[some], len(some) - top)[len(some) - top]]
        yield name, theirs + mine - shared + (len(terms) - met) * gap(base[k], base), [terms[c] for c in own[some]], value[some]


def block_rows(top: int) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    def run(key: tuple, groups: pa.Table, counts: pa.Table) -> pa.Table:
        out: dict[str, list] = {"source": [], "part": [], "item": [], "value": []}
        names = groups["source"].to_pylist()
        if counts.num_rows:
            found = block_gaps(groups, counts, top)
        else:  # pairs of a language that keeps no term
            found = ((x, np.zeros(len(names), np.int64), [], np.zeros(0, np.int64)) for x in (names if key[1].as_py() == 0 else []))
        for name, pairs, items, values in found:
            others = [k for k, x in enumerate(names) if x != name]
            out["part"] += ["pair"] * len(others) + ["term"] * len(items)
            out["item"] += [names[k] for k in others] + items
            out["value"] += [*pairs[others].tolist(), *values.tolist()]
            out["source"] += [name] * (len(others) + len(items))
        columns = [pa.array([key[0].as_py()] * len(out["part"]), pa.string())]
        return pa.table(columns + [pa.array(out[k], pa.int64() if k == "value" else pa.string()) for k in out], names=["lang", *out])

    return run


def audit(docs: DataFrame, least_docs: int = 10, top: int = 10, block: int = BLOCK, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank: for each source of a language its gap to every other source
    (part pair) and the terms that it has more of than its language, up to rank top (part term)."""
    workers.prepare(docs.sparkSession)
    kept = written(kept_terms(term_counts(docs, lang, source, text), least_docs), "terms")
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))]
    of_lang = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if("leads").alias("kept"))
    groups = (
        docs.select(*named).distinct().join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(of_lang, "lang", "left")
        .na.fill(0, ["total", "kept", "lang_total"])
    )
    # languages of more than one block: one for each `block` rows at most
    large = kept.groupBy("lang").agg(F.expr(f"1 + (count(*) - 1) div {block}").alias("_blocks")).where("_blocks > 1").toArrow()
    sizes = F.broadcast(docs.sparkSession.createDataFrame(large) if large.num_rows else docs.sparkSession.createDataFrame([], "lang string, _blocks long"))
    blocks = F.coalesce("_blocks", F.lit(1).cast("long"))
    counts = kept.join(sizes, "lang", "left").select("lang", F.pmod(F.xxhash64("term"), blocks).alias("_block"), "source", "term", "n")
    frames = groups.join(sizes, "lang", "left").select("lang", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("_block"), "source", "total", "kept", "lang_total")
    parts = frames.groupBy("lang", "_block").cogroup(counts.groupBy("lang", "_block")).applyInArrow(block_rows(top), "lang string, source string, part string, item string, value long")
    parts = written(parts, "gaps")
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = parts.where(F.col("part") == "pair").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(order))
    terms = parts.where(F.col("part") == "term").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.unionByName(terms)
