"""MinHash near-duplicates with odd sketches.

1. Signatures, one pass over the texts: the set of distinct word shingles (64-bit hashes), SAMPLES
   MinHash values, BANDS x ROWS of them as band hashes, and all of them folded into an odd sketch:
   a parity bitmap of BITS bits, in which each sample flips one. A second bitmap of SET_BITS bits
   does the same with the whole set, without the samples' error. Texts with equal sets (exact
   copies among them) become one node before anything is paired.
2. Nodes that share a band hash form a bucket. Each bucket names PIVOTS pivots - others in every
   band - and every member is paired with the pivots only, so pairs grow with members, never with
   their square. The population counts of the XOR of two sketches, and of two set bitmaps, estimate
   the similarity and drop what is clearly below; the rest is confirmed on the full sets.
3. Confirmed links give components: nodes go to their smallest neighbours, and edges are drawn anew
   between what is left, until none are.
4. What pivots can't tell - members of a bucket outside its commonest component - is compared with
   the members of the bucket, in blocks of BLOCK, each pair in the first bucket that it shares,
   bitmaps first and then full sets, pairs already refuted left out. A bucket of more than SMALL
   members is first parted into cells by FINE further hashes of FINE_ROWS samples each, and only
   members that share a cell are compared; so a member meets SMALL others at most, or those that are
   like it. With that a pair of a bucket is linked, refuted, or inside one component already.
   Components are then closed again.

A pair at the threshold of 0.85 shares no band with probability (1 - 0.85^5)^24 < 1e-6 (0.80: 7e-5),
and its sketches differ beyond the limit with about the same. In a bucket of more than SMALL members,
a pair that no pivot decides also needs a shared cell: it has none with probability 3e-6 (5e-4).

No key is hot: a bucket meets its pivots in a merge join, of which adaptive execution splits the
large side; pairs meet their pivot's bitmaps or set by (pivot, block of BLOCK members), so a pivot
travels once for each block and members once for each pivot; buckets are counted before a shuffle.

Defined results: null and empty texts have no shingles and are linked with nothing; a text with
fewer words than a shingle is one shingle; rows without an id take no part, have no component and
are kept; each row is judged by its own text, also where rows repeat an id; ties do not matter, as a
component is named by its smallest id. Other columns pass through if asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitweave.llm.common import arrow_map, free_of, mix64, texts_of, word_hashes, written

WORDS, PERCENT = 5, 80
SAMPLES, BANDS, ROWS, BITS = 200, 24, 5, 512
#: Bits of the parity bitmap of the whole set.
SET_BITS = 1024
#: How far below the threshold an estimate may be and still be checked.
SLACK = 0.17
#: Pivots of a bucket.
PIVOTS = 2
BLOCK = 1024
#: Members of a bucket that are compared without cells, and the hashes of samples that name cells.
SMALL, FINE, FINE_ROWS = 4096, 40, 8
#: Ids that are sent to all executors at most; with more, texts are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Nodes of a component that may meet in one task.
HUB = 256
SLICE_BYTES = 4_000_000
LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))

SKETCH = [f"s{k}" for k in range(BITS // 64)]
WHOLE = [f"t{k}" for k in range(SET_BITS // 64)]
BITMAPS = [*SKETCH, *WHOLE]


def _factors() -> tuple[np.ndarray, np.ndarray]:
    k = np.arange(1, 2 * SAMPLES + 1, dtype=np.uint64)
    x = mix64(k * np.uint64(0x9E3779B97F4A7C15))
    return x[:SAMPLES] | np.uint64(1), x[SAMPLES:]


FACTOR, OFFSET = _factors()
#: The samples of each finer hash: runs of FINE_ROWS, each run with another step between samples.
FINE_AT = (np.arange(FINE)[:, None] * 5 + np.arange(FINE_ROWS) * (1 + 2 * np.arange(FINE)[:, None])) % SAMPLES


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a whole text: words are what white space of ASCII
    parts, A-Z lower-cased. Fewer words than a shingle's are one shingle."""
    raw = text.encode("utf-8", "surrogatepass").translate(LOWER)
    if len(raw) <= SLICE_BYTES:
        h = word_hashes(raw.split())
    else:
        parts, at = [], 0
        while at < len(raw):
            end = at + SLICE_BYTES
            while end < len(raw) and raw[end] not in b" \t\n\r\x0b\x0c":
                end += 1
            parts.append(word_hashes(raw[at:end].split()))
            at = end
        h = np.concatenate(parts)
    if not len(h):
        return h
    n = min(words, len(h))
    x = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        x = mix64(x + h[k : len(h) - n + 1 + k])
    return np.unique(x)


def parity(flips: np.ndarray, owner: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Bitmaps of n owners, (n, bits / 64) int64: a bit is set if it was flipped an odd number of
    times. flips: hashes whose highest bits name the bit."""
    bit = (flips >> np.uint64(64 - int(bits).bit_length() + 1)).astype(np.int64)
    count = np.bincount(owner * bits + bit, minlength=n * bits).reshape(n, bits)
    return np.packbits((count & 1).astype(np.uint8), axis=1, bitorder="little").view(np.int64)


def mixed(low: np.ndarray, samples: np.ndarray, seed: int) -> np.ndarray:
    """One hash of some samples of each set."""
    h = np.full(len(low), seed, np.uint64)
    for r in samples:
        h = mix64(h + low[:, r])
    return h


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of non-empty sets: band hashes (n, BANDS), finer hashes (n, FINE) and the words of both
    bitmaps, all int64."""
    starts = np.cumsum([0, *(len(s) for s in sets)])[:-1]
    x = np.concatenate(sets)
    low = np.empty((len(sets), SAMPLES), np.uint64)
    for k in range(SAMPLES):
        y = x * FACTOR[k]
        y += OFFSET[k]
        y ^= y >> np.uint64(32)
        low[:, k] = np.minimum.reduceat(y, starts)
    bands = np.stack([mixed(low, np.arange(b * ROWS, (b + 1) * ROWS), b + 1) for b in range(BANDS)], 1)
    fine = np.stack([mixed(low, FINE_AT[f], BANDS + f + 1) for f in range(FINE)], 1)
    n = len(sets)
    sketch = parity(mix64(low + FACTOR).ravel(), np.repeat(np.arange(n), SAMPLES), n, BITS)
    whole = parity(mix64(x ^ np.uint64(0x5851F42D4C957F2D)), np.repeat(np.arange(n), [len(s) for s in sets]), n, SET_BITS)
    return bands.view(np.int64), fine.view(np.int64), np.concatenate((sketch, whole), axis=1)


def keys_of(sets: list[np.ndarray]) -> np.ndarray:
    """Two 64-bit hashes of each set, (n, 2) int64; sets with both equal are taken as equal."""
    return np.array([[s.sum(), mix64(s).sum()] for s in sets], np.uint64).reshape(-1, 2).view(np.int64)


def signed(docs: DataFrame, words: int) -> DataFrame:
    """docs: (doc_id, text, others). The set's size and two hashes, band hashes, finer hashes and
    bitmaps of each, and the other columns; null hashes without a shingle."""
    others = docs.columns[2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, words) for t in texts_of(batch.column(1))]
            size = np.array([len(s) for s in sets], np.int64)
            some = np.flatnonzero(size)
            bitmaps = np.zeros((len(sets), len(BITMAPS)), np.int64)
            bands, fine = [None] * len(sets), [None] * len(sets)
            for at in range(0, len(some), 256):
                part = some[at : at + 256]
                b, f, bitmaps[part] = signatures([sets[i] for i in part])
                for i, x, y in zip(part, b, f, strict=True):
                    bands[i], fine[i] = x, y
            k = keys_of(sets)
            hashes = (pa.array(x, pa.list_(pa.int64())) for x in (bands, fine))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(k[:, 0]), pa.array(k[:, 1]), *hashes, *(pa.array(bitmaps[:, k]) for k in range(len(BITMAPS))), *batch.columns[2:]], names=["doc_id", "n", "k1", "k2", "bands", "fine", *BITMAPS, *others])

    kept = "".join(f", `{c}` {t}" for c, t in docs.dtypes[2:])
    return arrow_map(docs, run, f"doc_id {docs.dtypes[0][1]}, n bigint, k1 bigint, k2 bigint, bands array<bigint>, fine array<bigint>, " + ", ".join(f"{s} bigint" for s in BITMAPS) + kept)


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """docs: (doc_id, text). The full set of each with its keys, (doc_id, k1, k2, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, words) for t in texts_of(batch.column(1))]
            k = keys_of(sets)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["doc_id", "k1", "k2", "shingles"])

    return arrow_map(docs, run, f"doc_id {docs.dtypes[0][1]}, k1 bigint, k2 bigint, shingles array<bigint>")


def most_flips(percent: int) -> int:
    """The XOR population count beyond which a pair is not checked: for two sketches of SAMPLES
    samples the similarity is about 1 + BITS / (4 SAMPLES) ln(1 - 2 count / BITS)."""
    lowest = max(0.0, percent / 100 - SLACK)
    return int(BITS / 2 * (1 - np.exp(-4 * SAMPLES * (1 - lowest) / BITS)))


def alike(a: str, b: str, percent: int) -> Column:
    """Whether sizes and bitmaps of two sides allow a link. A link's sets differ in d shingles at
    most; the count of odd bits has the mean and spread below, and 5.5 spreads are allowed."""
    na, nb = F.col(f"{a}_n"), F.col(f"{b}_n")
    flips, whole = (sum((F.bit_count(F.col(f"{a}_{s}").bitwiseXOR(F.col(f"{b}_{s}"))) for s in names), F.lit(0)) for names in (SKETCH, WHOLE))
    d = (na + nb) * F.lit((100 - percent) / (100 + percent))
    mean = F.lit(SET_BITS / 2) * (F.lit(1.0) - F.exp(d * F.lit(-2 / SET_BITS)))
    fall = F.exp(d * F.lit(-4 / SET_BITS))
    spread = F.sqrt(F.greatest(F.lit(0.0), F.lit(SET_BITS / 4) * (F.lit(1.0) - fall) - d * fall))
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (flips <= most_flips(percent)) & (whole <= mean + F.lit(5.5) * spread + F.lit(2.0))


def beside(pairs: DataFrame, of: DataFrame, columns: list[str]) -> DataFrame:
    """pairs (pivot, node, block) with those columns of both, a_... of the pivot's and b_... of the
    node's. A pivot's columns travel once for each of its blocks, not once for each pair."""
    own = pairs.join(of.select("node", *(F.col(c).alias(f"b_{c}") for c in columns)), "node")
    pivots = pairs.select("pivot", "block").distinct().join(of.select(F.col("node").alias("pivot"), *(F.col(c).alias(f"a_{c}") for c in columns)), "pivot")
    return own.join(pivots, ["pivot", "block"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (pivot, node, block) that are links by their full sets, as (a, b)."""
    both = F.size(F.array_intersect("a_shingles", "b_shingles"))
    linked = beside(pairs, sets, ["shingles"]).where(100 * both >= percent * (F.size("a_shingles") + F.size("b_shingles") - both))
    return linked.select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b"))


def block_of(node: Column, size: Column) -> Column:
    """One of so many blocks that each has about BLOCK of size members."""
    return F.pmod(F.xxhash64(node), F.ceil(size / F.lit(BLOCK))).cast("int")


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b): (node, component), the smallest node reachable, for all nodes of edges. In each
    round a node goes to its smallest neighbour's smallest neighbour; then edges are drawn between
    the nodes that are left, and those inside one vanish. Edges and labels are written between
    rounds; both shrink or stay, never grow."""
    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    labels = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b"))).distinct().withColumn("component", F.col("node"))
    while True:
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        low = written(both.groupBy("a").agg(F.min("b").alias("_n")).select(F.col("a").alias("old"), F.least("a", "_n").alias("new")), "steps")
        jump = low.join(low.select(F.col("old").alias("_o"), F.col("new").alias("_n")), F.col("new") == F.col("_o")).select("old", F.col("_n").alias("new"))
        jump = written(jump, "steps")
        # a merge join, so that a component of very many nodes is split
        labels = labels.join(jump.hint("merge"), F.col("component") == F.col("old"), "left").select("node", F.coalesce("new", "component").alias("component"))
        labels = written(labels, "labels")
        left = jump.select(F.col("old").alias("a"), F.col("new").alias("_a"))
        right = jump.select(F.col("old").alias("b"), F.col("new").alias("_b"))
        edges = edges.join(left, "a").join(right, "b").where("_a <> _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct()
        edges = written(edges, "edges")
        if edges.isEmpty():
            return labels


def cells(marked: DataFrame, signs: DataFrame) -> DataFrame:
    """marked: members of buckets in which something is open, with size. (bucket, band, node, ...,
    cell, size): a small bucket is one cell; members of a larger one stand in a cell for each of
    their finer hashes, with the cell's own size, if another member does too."""
    small = marked.where(F.col("size") <= SMALL).withColumn("cell", F.col("bucket"))
    large = marked.where(F.col("size") > SMALL)
    if large.isEmpty():
        return small
    fine = large.join(signs.select("node", "fine"), "node").select(*large.columns, F.posexplode("fine").alias("_k", "_h")).withColumn("cell", F.xxhash64("bucket", "_k", "_h")).drop("_k", "_h")
    fine = written(fine, "fine")
    sizes = fine.groupBy("cell").agg(F.count(F.lit(1)).alias("size"), F.max("rest").alias("_open")).where((F.col("size") > 1) & F.col("_open")).drop("_open")
    return small.unionByName(fine.drop("size").join(sizes.hint("merge"), "cell"))


def with_first(named: DataFrame) -> DataFrame:
    """named (k1, k2, doc_id, _group) with _component, the smallest doc_id of its group. Groups of more
    than HUB nodes, of which there is one for HUB nodes at most, go to all tasks, so that a large
    component does not meet in one; beyond BROADCAST_IDS of them all are joined alike."""
    first = written(named.groupBy("_group").agg(F.min("doc_id").alias("_component"), F.count(F.lit(1)).alias("_n")), "first")
    large = first.where(F.col("_n") > HUB).drop("_n")
    rest = first.drop("_n").hint("merge")
    if not 0 < large.count() <= BROADCAST_IDS:
        return named.join(rest, "_group")
    large = F.broadcast(large)
    return named.join(large, "_group").unionByName(named.join(large.select("_group"), "_group", "left_anti").join(rest, "_group"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, keep: list[str] | None = None) -> DataFrame:
    """A row per row of docs: doc_id, n_shingles, component_id (the smallest id reachable by links),
    kept (component_id = doc_id), and the columns keep, of which those that have one of these names
    are left out. Ids may be of any type that has an order."""
    keep = free_of(keep or [], ("doc_id", "n_shingles", "component_id", "kept"))
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), *(F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)))
    signs = written(signed(source, words), "signs")
    able = signs.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    # equal sets are one node: found before anything is paired, partly before the shuffle; nodes have
    # numbers of their own, as an id may stand for several texts
    heads = written(able.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id")).withColumn("node", F.monotonically_increasing_id()), "heads")
    one_of = able.select("doc_id", "k1", "k2", "n", "bands", "fine", *BITMAPS).join(heads, ["doc_id", "k1", "k2"]).dropDuplicates(["node"])
    nodes = written(one_of, "nodes")

    exploded = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    # pivots are the members whose numbers, XORed with hashes of the bucket, are smallest: any of them
    masks = [F.col("bucket"), *(F.xxhash64("bucket", F.lit(k)) for k in range(1, PIVOTS))]
    buckets = exploded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), *(F.min(F.col("node").bitwiseXOR(m)).alias(f"_x{k}") for k, m in enumerate(masks))).where(F.col("size") > 1)
    pivots = F.array(*(F.col(f"_x{k}").bitwiseXOR(m) for k, m in enumerate(masks)))
    members = written(exploded.join(buckets.select("bucket", "size", pivots.alias("pivots")).hint("merge"), "bucket"), "members")
    slim = written(nodes.select("node", "doc_id", "k1", "k2", "n", "bands", *BITMAPS).join(members.select("node").distinct(), "node", "left_semi"), "slim")
    ids = slim.select("doc_id").distinct()
    if slim.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    found = full_sets(source.select("doc_id", "text").join(ids, "doc_id", "left_semi"), words)
    sets = written(found.join(slim.select("doc_id", "k1", "k2", "node"), ["doc_id", "k1", "k2"]).select("node", "shingles").dropDuplicates(["node"]), "sets")

    pairs = members.select("node", "size", F.explode(F.array_distinct("pivots")).alias("pivot")).where(F.col("node") != F.col("pivot"))
    one = F.min(F.struct("pivot", "node", block_of(F.col("node"), F.col("size")).alias("block"))).alias("p")
    pairs = written(pairs.groupBy(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).agg(one).select("p.*"), "pairs")
    pairs = written(beside(pairs, slim, ["n", *BITMAPS]).where(alike("a", "b", percent)).select("pivot", "node", "block"), "alike")
    labels = components(confirmed(pairs, sets, percent))

    # members outside the commonest component of their bucket, against the members of the bucket
    own = labels.select("node", F.col("component").alias("_c"))
    marked = written(members.select("bucket", "band", "size", "node").join(own, "node", "left").withColumn("_c", F.coalesce("_c", "node")), "marked")
    common = marked.groupBy("bucket", "_c").agg(F.count(F.lit(1)).alias("_n")).groupBy("bucket").agg(F.max(F.struct("_n", "_c"))["_c"].alias("_p"), F.count(F.lit(1)).alias("_parts")).where(F.col("_parts") > 1)
    marked = marked.join(common.select("bucket", "_p").hint("merge"), "bucket").withColumn("rest", F.col("_c") != F.col("_p")).drop("_p")
    placed = written(cells(written(marked, "marked"), nodes), "cells")
    wide = ["n", "bands", *BITMAPS]
    blocks = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
    left = placed.where("rest").join(slim, "node").select("cell", "band", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), F.col("_c").alias("a_c"), F.col("node").alias("a"), *(F.col(c).alias(f"a_{c}") for c in wide))
    right = placed.join(slim, "node").select("cell", block_of(F.col("node"), F.col("size")).alias("block"), F.col("_c").alias("b_c"), F.col("rest").alias("b_rest"), F.col("node").alias("b"), *(F.col(c).alias(f"b_{c}") for c in wide))
    here = ~F.arrays_overlap(F.slice("a_bands", F.lit(1), F.col("band")), F.slice("b_bands", F.lit(1), F.col("band")))
    more = left.join(right, ["cell", "block"]).where((F.col("a_c") != F.col("b_c")) & (~F.col("b_rest") | (F.col("a") < F.col("b"))) & alike("a", "b", percent) & here)
    more = more.select(F.least("a", "b").alias("pivot"), F.greatest("a", "b").alias("node")).distinct()
    done = pairs.select(F.least("pivot", "node").alias("pivot"), F.greatest("pivot", "node").alias("node"))
    # a node has many partners here only if many are nearly like it: they come in blocks
    more = written(more.join(done, ["pivot", "node"], "left_anti").withColumn("block", F.pmod(F.xxhash64("node"), F.lit(64)).cast("int")), "more")
    added = written(confirmed(more, sets, percent), "links")
    # the new links join components as they are
    ends = added.join(labels.select(F.col("node").alias("a"), F.col("component").alias("_a")), "a", "left").join(labels.select(F.col("node").alias("b"), F.col("component").alias("_b")), "b", "left")
    joined = components(ends.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))) if not added.isEmpty() else None

    named = heads.join(labels, "node", "left").select("k1", "k2", "doc_id", F.coalesce("component", "node").alias("_group"))
    if joined is not None:
        named = named.join(joined.select(F.col("node").alias("_group"), F.col("component").alias("_joined")).hint("merge"), "_group", "left").select("k1", "k2", "doc_id", F.coalesce("_joined", "_group").alias("_group"))
    named = written(named, "named")
    named = with_first(named).select("k1", "k2", "_component")
    component = F.when(F.col("n") > 0, F.col("_component")).otherwise(F.col("doc_id"))
    out = signs.select("doc_id", "n", "k1", "k2", *(f"_keep{i}" for i in range(len(keep)))).join(named.hint("merge"), ["k1", "k2"], "left")
    component_id = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", F.col("n").alias("n_shingles"), component_id.alias("component_id"), F.coalesce(F.col("doc_id") == component_id, F.lit(True)).alias("kept"), *(F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)))
