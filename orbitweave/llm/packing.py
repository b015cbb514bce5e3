"""Bulk-synchronous best-fit packing of tokenised documents into sequences of bounded length.

1. Every document is tokenised whole (word by word, with a bounded cache of words per worker), an
   end id is appended and only documents longer than a sequence are cut. The pieces are written
   to the shared folder: (doc_id, piece, start, length, ids_crc32), without texts or ids.
2. A piece longer than half a sequence opens one. Shorter ones follow in scales, long before short:
   (1/4, 1/2], (1/8, 1/4] and (0, 1/8] of a sequence. In each round of a scale every gap offers as
   many equal places as the longest piece left fits into it, one at least, and one distributed sweep
   over places and pieces, sorted by size from large to small, gives each piece the smallest free
   place that holds it. Who gets which place in a conflict of equals follows from ranks: a place
   goes onto a stack, a piece takes what lies on top, so with the stack's height before each size
   (a running sum over at most 2 x capacity sizes and PARTS parts of them) a row knows from its
   rank at which height it stands, and a piece's place is the row before it at that height. Ranks and
   heights are windows over many small groups; nothing is gathered by size. Gaps then lose what
   they took, and the next round follows with the pieces left. Where a round places few of them,
   sequences are opened for the rest. Rounds do not grow with the input, as each places a share.
3. Offsets come last, from the order of rounds and places inside each sequence.

Defined results: null and empty texts are one end id; repeated rows are packed each on its own;
pieces that tie in all columns are interchangeable; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from orbitweave.llm.common import arrow_map, grouped_batches, spans_of_size, texts_of, written

CAPACITY = 4096
END_ID = 1
#: Parts of words that a worker remembers; beyond that it forgets all and starts again.
CACHE_WORDS = 700_000
#: Bytes of batches and characters of texts whose different words are parted together.
TOGETHER = 8_000_000
#: Rows of one size that are ranked together; more are ranked in parts. So that parts stay few, a part
#: is never under one in PARTS of all rows.
RANGE, PARTS = 250, 100_000
#: A round that places less than this share of its pieces is followed by new sequences.
SHARE = 0.3

#: Unicode white space. str.split() also splits at U+001C to U+001F, which are not of it.
SPACE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
SEPARATORS = re.compile("[\\x1c-\\x1f]")

#: Latin letters whose lower-casing and composition need no context, and marks that may stand after a word of
#: them. The ids of such a plain word are those of the lower-cased letters and then those of the marks.
LETTERS = "".join(filter(re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]").match, map(chr, range(0x250))))
MARKS = ".,;:!?#*$%&"
JOINED = 4000

_tokenizers: dict[str, object] = {}
_ends: dict[str, np.ndarray] = {}
#: Parts of words, how many ids each has, and all their ids in turn.
Known = tuple[pa.Array, np.ndarray, np.ndarray]
NOTHING: Known = (pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.uint32))
_known: dict[str, Known] = {}


def tokenizer(path: str):
    """The tokenizer of a file, once per process."""
    if path not in _tokenizers:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
        ids = _tokenizers[path].get_vocab()
        _ends[path] = np.zeros(max(ids.values()) + 1, bool)
        _ends[path][[i for w, i in ids.items() if w.endswith("</w>")]] = True
    return _tokenizers[path]


def token_ids(texts: list[str], path: str) -> list[np.ndarray]:
    """uint32 ids of each whole text, without special tokens. The vocabulary's pre-tokenizer never
    crosses white space, so ids of a text are those of its words, in turn. Each different word is
    parted once, and the ids of all are gathered by number."""
    words, ends = _words(texts)
    parts = pa.concat_arrays(_parted(words.dictionary)).dictionary_encode()
    number, (_, sizes, ids) = _numbers(parts.dictionary, path)
    both = number[parts.indices.to_numpy()].reshape(2, -1)[:, words.indices.to_numpy()].T.ravel()
    lengths = sizes[both]
    upto = np.concatenate(([0], np.cumsum(lengths)))
    # the place of an id among those remembered: where its part's begin, and how far into it
    ids = ids[np.repeat((np.cumsum(sizes) - sizes)[both] - upto[:-1], lengths) + np.arange(upto[-1])]
    bounds = upto[2 * ends].tolist()
    return [ids[a:b] for a, b in zip([0, *bounds], bounds, strict=False)]


def _words(texts: list[str]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all texts, one after another, and how many there are up to the end of each text."""
    if any(map(SEPARATORS.search, texts)):
        split = [[w for w in SPACE.split(t) if w] for t in texts]
        return pa.array([w for words in split for w in words], pa.string()).dictionary_encode(), np.cumsum([len(words) for words in split])
    lists = pc.utf8_split_whitespace(pa.array(texts, pa.string()))  # at the same characters as str.split()
    words, ends = lists.flatten(), lists.offsets.to_numpy()[1:]
    filled = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    if not filled.all():  # white space at an end of a text leaves an empty word there
        words, ends = words.filter(pa.array(filled)), np.concatenate(([0], np.cumsum(filled)))[ends]
    return words.dictionary_encode(), ends


def _parted(words: pa.Array) -> list[pa.Array]:
    """Of each word two parts whose ids follow each other: of a plain one its letters, in lower case, and
    its marks; of any other itself and nothing."""
    marks = pc.utf8_ltrim(words, characters=LETTERS)
    plain = pc.and_(pc.not_equal(marks, words), pc.equal(pc.ascii_trim(marks, characters=MARKS), ""))
    letters = pc.utf8_lower(pc.ascii_rtrim(words, characters=MARKS))
    return [pc.if_else(plain, letters, words), pc.if_else(plain, marks, "")]


def _numbers(parts: pa.Array, path: str) -> tuple[np.ndarray, Known]:
    """The numbers of different parts among those remembered, all of them by now."""
    known = _known[path] if path in _known and len(_known[path][0]) <= CACHE_WORDS else NOTHING
    new = parts.filter(pc.invert(pc.is_in(parts, value_set=known[0])))
    if len(new) or known is NOTHING:
        known = tuple(join([a, b]) for join, a, b in zip((pa.concat_arrays, np.concatenate, np.concatenate), known, _learnt(new, path), strict=True))
        _known[path] = known
    return pc.index_in(parts, value_set=known[0]).to_numpy(), known


def _learnt(new: pa.Array, path: str) -> Known:
    """Letters alone go to the tokenizer together, and their ids are parted at the tokens that end a
    word; all others go one by one."""
    model = tokenizer(path)
    plain = pc.and_(pc.equal(pc.utf8_ltrim(new, characters=LETTERS), ""), pc.not_equal(new, ""))
    together, alone = new.filter(plain), new.filter(pc.invert(plain))
    words, sizes, ids = together.to_pylist(), [], []
    for at in range(0, len(words), JOINED):
        part = words[at : at + JOINED]
        ids.append(np.array(model.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4"))
        sizes.append(np.diff(np.flatnonzero(_ends[path][ids[-1]]), prepend=-1))
        if len(sizes[-1]) != len(part):
            raise ValueError("the tokenizer has no ends of words")
    each = [e.ids for e in model.encode_batch_fast(alone.to_pylist(), add_special_tokens=False)]
    sizes.append(np.fromiter(map(len, each), np.int64, len(each)))
    ids.append(np.fromiter((i for e in each for i in e), np.uint32))
    return pa.concat_arrays([together, alone]), np.concatenate(sizes), np.concatenate(ids)


PIECES = "piece int, start bigint, length bigint, ids_crc32 bigint"
_PIECE_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """docs: (id, text). A row for each piece of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4")
        for batch in grouped_batches(batches, TOGETHER):
            out: list[list] = [[], [], [], [], []]
            texts = texts_of(batch.column(1))
            tokens = (ids for a, b in spans_of_size(texts, TOGETHER) for ids in token_ids(texts[a:b], path))
            for doc, ids in zip(batch.column(0).to_pylist(), tokens, strict=True):
                ids = np.concatenate((ids, end))
                for k, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    for column, x in zip(out, (doc, k, start, len(part), zlib.crc32(part.tobytes())), strict=True):
                        column.append(x)
            types = [batch.schema.field(0).type, *_PIECE_TYPES]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return arrow_map(docs, run, f"doc_id {docs.dtypes[0][1]}, {PIECES}")


def with_heights(tokens: DataFrame) -> DataFrame:
    """tokens: (size, kind, id, ...), kind 0 for places and 1 for pieces. Adds part, the part of its size that
    each row is in, and height: the stack's height before that part."""
    spark = tokens.sparkSession
    counts = tokens.groupBy("size", "kind").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 2 x capacity rows
    total, most = sum(r["n"] for r in counts), max((r["n"] for r in counts), default=0)
    range_ = max(RANGE, -(-total // PARTS))
    if most <= range_:
        # every size is one part, so the counts at hand give the heights
        before, sum_, low, heights = 0, 0, 0, []
        for size, kind, n in sorted(counts, key=lambda r: (-r["size"], r["kind"])):
            heights.append((size, kind, before))
            sum_ += n if kind == 0 else -n
            low = min(low, sum_)
            before = sum_ - low
        return tokens.withColumn("part", F.lit(0)).join(F.broadcast(spark.createDataFrame(heights, "size bigint, kind int, height bigint")), ["size", "kind"])
    classes = spark.createDataFrame(counts, "size bigint, kind int, n bigint").coalesce(1)
    tokens = tokens.join(F.broadcast(classes), ["size", "kind"]).withColumn("part", F.pmod(F.xxhash64("id", "slot"), F.ceil(F.col("n") / F.lit(range_))).cast("int")).drop("n")
    classes = tokens.groupBy("size", "kind", "part").agg(F.count(F.lit(1)).alias("n"))
    # one row for each size and part: the only step in one task, over 2 x capacity + PARTS rows at most
    turn = Window.partitionBy(F.lit(0)).orderBy(F.desc("size"), "kind", "part")
    classes = classes.withColumn("_sum", F.sum(F.when(F.col("kind") == 0, F.col("n")).otherwise(-F.col("n"))).over(turn))
    classes = classes.withColumn("_height", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(turn)))
    heights = classes.select("size", "kind", "part", F.coalesce(F.lag("_height").over(turn), F.lit(0)).alias("height"))
    return tokens.join(F.broadcast(heights), ["size", "kind", "part"])


def sweep(todo: DataFrame, gaps: DataFrame, shortest: int, longest: int) -> DataFrame:
    """todo: pieces with _p, a number of their own, and length; gaps: (sequence_id, gap), both written.
    todo with sequence_id and slot, null for a piece that got no place."""
    offers = F.greatest(F.lit(1), F.floor(F.col("gap") / longest)).cast("int")
    slots = gaps.where(F.col("gap") >= shortest).select(F.floor(F.col("gap") / offers).cast("bigint").alias("size"), F.lit(0).alias("kind"), F.col("sequence_id").alias("id"), F.explode(F.sequence(F.lit(0), offers - 1)).alias("slot"))
    pieces = todo.select(F.col("length").alias("size"), F.lit(1).alias("kind"), F.col("_p").alias("id"), F.lit(0).alias("slot"), *(c for c in todo.columns if c not in ("length", "_p")))
    tokens = with_heights(slots.unionByName(pieces, allowMissingColumns=True))
    rank = F.row_number().over(Window.partitionBy("size", "kind", "part").orderBy("id", "slot")) - 1
    placed = tokens.withColumn("_at", F.when(F.col("kind") == 0, F.col("height") + rank).otherwise(F.col("height") - 1 - rank))
    # below height 0 stand pieces only, which get nothing: anywhere there will do
    placed = placed.withColumn("_at", F.when(F.col("_at") >= 0, F.col("_at")).otherwise(-1 - F.pmod(F.xxhash64("id"), F.lit(1 << 40))))
    before = F.lag(F.struct("kind", "id", "slot")).over(Window.partitionBy("_at").orderBy(F.desc("size"), "kind", "part"))
    got = placed.withColumn("_before", before).where(F.col("kind") == 1).withColumn("_before", F.when(F.col("_before.kind") == 0, F.col("_before")))
    return got.select(*(F.col({"length": "size", "_p": "id"}.get(c, c)).alias(c) for c in todo.columns), F.col("_before.id").alias("sequence_id"), F.col("_before.slot").alias("slot"))


def scales(capacity: int) -> list[tuple[int, int]]:
    """Ranges (shorter than any, longest] of lengths of pieces that are placed together."""
    edges = [e for e in dict.fromkeys((capacity // 2, capacity // 4, capacity // 8)) if e]
    return [(low, high) for high, low in zip(edges, [*edges[1:], 0], strict=False)]


Left = tuple[int, int, int, int]


def observed(pieces: DataFrame, name: str) -> tuple[DataFrame, Left]:
    """pieces, written, and of those without a sequence how many there are, their total, least and largest length."""
    seen = Observation()
    left = F.col("sequence_id").isNull()
    length = F.when(left, F.col("length"))
    out = written(pieces.observe(seen, F.count_if(left).alias("n"), F.coalesce(F.sum(length), F.lit(0)).alias("total"), F.coalesce(F.min(length), F.lit(0)).alias("low"), F.coalesce(F.max(length), F.lit(0)).alias("high")), name)
    r = seen.get
    return out, (r["n"], r["total"], r["low"], r["high"])


def left_over(pieces: DataFrame, scales_: list[tuple[int, int]]) -> list[Left]:
    """The same of pieces of each scale, in one pass."""
    aggs = []
    for k, (low, high) in enumerate(scales_):
        length = F.when((F.col("length") > low) & (F.col("length") <= high), F.col("length"))
        aggs += [F.count(length).alias(f"n{k}"), F.coalesce(F.sum(length), F.lit(0)).alias(f"t{k}"), F.coalesce(F.min(length), F.lit(0)).alias(f"l{k}"), F.coalesce(F.max(length), F.lit(0)).alias(f"h{k}")]
    r = pieces.agg(*aggs).first() if aggs else None
    return [(r[f"n{k}"], r[f"t{k}"], r[f"l{k}"], r[f"h{k}"]) for k in range(len(scales_))]


def pack(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """rows: pieces with length from 1 to capacity. Adds sequence_id and offset."""
    spark, names = rows.sparkSession, rows.columns
    rows = written(rows.withColumn("_p", F.monotonically_increasing_id()), "pieces")
    done = [written(rows.where(F.col("length") > capacity // 2).withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("slot", F.lit(0)), "placed")]
    gaps = written(done[0].select("sequence_id", (capacity - F.col("length")).alias("gap")).where(F.col("gap") > 0), "gaps")
    opened = 0
    parts = scales(capacity)
    for (low, high), (n, total, shortest, longest) in zip(parts, left_over(rows, parts), strict=True):
        todo = rows.where((F.col("length") > low) & (F.col("length") <= high))
        placed_share, tries = 1.0, 0
        while n:
            if placed_share < SHARE:
                # first as many as the pieces fill, then as many as surely hold all
                more = -(-total // capacity) if not tries else -(-n // (capacity // longest))
                gaps = gaps.unionByName(spark.range(-opened - more, -opened).select(F.col("id").alias("sequence_id"), F.lit(capacity).cast("bigint").alias("gap")))
                opened, tries = opened + more, tries + 1
            before = n
            round_, (n, total, shortest, longest) = observed(sweep(todo, gaps, shortest, longest), "round")
            hit = round_.where(F.col("sequence_id").isNotNull())
            done.append(hit)
            gaps = gaps.unionByName(hit.select("sequence_id", (-F.col("length")).alias("gap"))).groupBy("sequence_id").agg(F.sum("gap").alias("gap")).where(F.col("gap") > 0)
            gaps = written(gaps, "gaps")
            todo = round_.where(F.col("sequence_id").isNull()).select(*rows.columns)
            placed_share = 1 - n / before
    every = done[0].withColumn("_round", F.lit(0))
    for k, part in enumerate(done[1:], 1):
        every = every.unionByName(part.withColumn("_round", F.lit(k)))
    turn = Window.partitionBy("sequence_id").orderBy("_round", "slot")
    return every.withColumn("offset", F.sum("length").over(turn) - F.col("length")).select(*names, "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenises and packs whole documents; one row per piece with its place. Ids may be of any type."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return pack(pieces(source, path, capacity, end_id), capacity)
