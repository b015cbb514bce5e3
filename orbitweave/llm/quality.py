"""Quality rules: word, symbol and repetition counts, and the perplexity of each document under a
character n-gram model of its own language.

The model is a modified Kneser-Ney model of order ORDER over the characters as they are (case, letters
of all scripts, digits and marks apart; only white space is one symbol). Spark counts the n-grams of
every whole document that passes the base rules; lower orders, discounts, back-off weights and
probabilities are DataFrame operations on the table of distinct n-grams, which grows with the
corpus. Counts of n-grams that start with the padding are not continuation counts, as nothing stands
before them. An n-gram that only one text has is pruned, so no text is judged by what it or its exact
copies alone taught; its probability is that of backing off. Every n-gram of a judged document is in
that table, pruned or not, so its probability is looked up directly: in arrays sorted by 64-bit hashes of n-grams, by binary search. Up to BROADCAST_ENTRIES
n-grams the arrays go to all executors; beyond that documents are put into chunks of CHUNK_BYTES, the
distinct n-grams of each chunk are joined with the table, and each chunk gets arrays of its own. Both
ways give the same log-perplexities.

A document's log-perplexity is in nats per word (a run of non-space with a letter or digit), of which one
adds WORD_NATS at most: marks add to it, but are no words of their own. Each language has an upper and a lower band: its median plus UPPER
and minus LOWER times its distance to the quartile on that side, over all its documents that pass the
base rules; distances are drawn towards those of all languages by the weight of SHRINK documents.
Languages of fewer than POOL documents are counted and judged together as one, so that no document goes
unjudged; one that is alone there is its own median.

Defined results: null, empty and blank texts have no words, fail the base rules and have no
perplexity, as all that fail them; a null language is the language ''; repeated rows are counted
and judged each.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orbitweave.llm.common import arrow_map, free_of, grouped_batches, mix64, texts_of, word_hashes, written

ORDER = 5
#: Stands before a text; control characters of texts are white space.
PAD = "\x00"
#: Characters taken at once, of one text or several; bits for the numbers of an n-gram's characters and its
#: place in such a slice.
SLICE, BITS = 2_000_000, 63
#: N-grams whose probabilities are on an executor at once; 12 bytes each.
BROADCAST_ENTRIES = 6_000_000
#: Text of a chunk of documents.
CHUNK_BYTES = 16_000_000
MIN_WORDS = 50
NOISE = "#*$%&|<>"
SPACES = " \t\n\r\x0b\x0c"
#: Documents of a language that is judged by itself.
POOL = 20
POOLED = "(pooled)"
#: What a word can add at most, so that a key, an address or a number does not condemn a text.
WORD_NATS = 30.0
BROADCAST_LANGUAGES = 10_000
UPPER, LOWER, SHRINK = 7.0, 10.0, 20

_kinds: list[np.ndarray] = []


def _tables() -> np.ndarray:
    """Of each code point: 1 for white space and controls, 2 for letters and digits, else 0."""
    if not _kinds:
        kind = np.zeros(0x110000, np.uint8)
        for c in range(0x110000):
            x = chr(c)
            kind[c] = 1 if x.isspace() or c < 32 or c == 127 else 2 if x.isalnum() else 0
        _kinds.append(kind)
    return _kinds[0]


def code_points(text: str) -> np.ndarray:
    """Code points of a text; runs of white space are one space, none at the start."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    space = _tables()[code] == 1
    keep = ~(space & np.concatenate(([True], space[:-1]))) if len(code) else space
    return np.where(space, 32, code)[keep].astype(np.uint32)


Grams = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def grams(codes: list[np.ndarray]) -> Iterator[Grams]:
    """The n-grams of texts (given as code points), each ending at one of their characters, slice by
    slice: distinct n-grams as rows of ORDER code points; the slice's characters, numbered from 0, by
    n-gram; where each n-gram starts among these; and the text of each character. A slice is halved
    where its n-grams and places need more than BITS bits."""
    todo, size = [], 0
    for i, c in enumerate(codes):
        for at in range(0, len(c), SLICE):
            todo.append((i, at, min(len(c), at + SLICE)))
            size += todo[-1][2] - at
            if size >= SLICE:
                yield from _sorted(codes, todo)
                todo, size = [], 0
    if todo:
        yield from _sorted(codes, todo)


def _sorted(codes: list[np.ndarray], parts: list[tuple[int, int, int]]) -> Iterator[Grams]:
    flat, ends = [], []
    for i, a, b in parts:
        before = codes[i][max(0, a - ORDER + 1) : a]
        flat += [np.zeros(ORDER - 1 - len(before), np.uint32), before, codes[i][a:b]]
        ends += [np.zeros(ORDER - 1, bool), np.ones(b - a, bool)]
    c, end = np.concatenate(flat), np.concatenate(ends)
    number = np.zeros(0x110000, np.int32)
    number[c] = 1
    alphabet = np.flatnonzero(number)
    last = np.flatnonzero(end)
    bits, places = max(1, (len(alphabet) - 1).bit_length()), len(last).bit_length()
    if bits * ORDER + places > BITS and len(last) > 1:
        if len(parts) > 1:
            halves = parts[: len(parts) // 2], parts[len(parts) // 2 :]
        else:
            (i, a, b), = parts
            halves = [(i, a, (a + b) // 2)], [(i, (a + b) // 2, b)]
        for half in halves:
            yield from _sorted(codes, half)
        return
    number[alphabet] = np.arange(len(alphabet), dtype=np.int32)
    c = number[c]
    packed = c[last - (ORDER - 1)].astype(np.int64)
    for k in range(ORDER - 2, -1, -1):
        packed <<= bits
        packed |= c[last - k]
    # sorted with their places, which is faster than sorting places by n-gram
    packed <<= places
    packed |= np.arange(len(last))
    packed.sort()
    order = (packed & ((1 << places) - 1)).astype(np.int32)
    packed >>= places
    start = np.flatnonzero(np.concatenate(([True], packed[1:] != packed[:-1])))
    distinct = packed[start]
    rows = np.stack([alphabet[(distinct >> (bits * (ORDER - 1 - k))) & ((1 << bits) - 1)] for k in range(ORDER)], 1).astype(np.uint32)
    yield rows, order, start, np.repeat(np.array([i for i, _, _ in parts], np.int32), [b - a for _, a, b in parts])


def strings(rows: np.ndarray) -> list[str]:
    """Rows of ORDER code points as strings."""
    text = np.ascontiguousarray(rows, "<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return [text[k : k + ORDER] for k in range(0, len(text), ORDER)]


def hashes(rows: np.ndarray) -> np.ndarray:
    """64-bit hashes of n-grams given as rows of code points."""
    factors = mix64(np.arange(1, ORDER + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return mix64((rows.astype(np.uint64) * factors).sum(1, dtype=np.uint64))


def hashes_of(texts: list[str]) -> np.ndarray:
    return hashes(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, ORDER))


def passes(text: str) -> bool:
    """The base rules."""
    words = text.encode("utf-8", "surrogatepass").split()
    return len(words) >= MIN_WORDS and 100 * repeat_words(words) <= 50 * len(words)


def count_grams(docs: DataFrame) -> DataFrame:
    """docs: (lang, text). Counts of the n-grams of documents that pass the base rules, by language, with
    the least and largest hash of the texts that have them: (lang, gram, n, d0, d1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in grouped_batches(batches, 8_000_000):
            by: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(texts_of(batch.column(0)), texts_of(batch.column(1)), strict=True):
                if passes(text):
                    by.setdefault(lang, []).append(code_points(text))
            for lang, codes in by.items():
                hashed = word_hashes(c.tobytes() for c in codes).view(np.int64)
                for rows, order, start, text in grams(codes):
                    h = hashed[text[order]]
                    found = np.diff(np.concatenate((start, [len(order)]))), np.minimum.reduceat(h, start), np.maximum.reduceat(h, start)
                    for at in range(0, len(rows), 100_000):
                        part = rows[at : at + 100_000]
                        numbers = (pa.array(x[at : at + 100_000], pa.int64()) for x in found)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(strings(part), pa.string()), *numbers], names=["lang", "gram", "n", "d0", "d1"])

    return arrow_map(docs, run, "lang string, gram string, n bigint, d0 bigint, d1 bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.min("d0").alias("d0"), F.max("d1").alias("d1"))


def discounts(c: Column) -> list[Column]:
    """Aggregates D1, D2, D3 of modified Kneser-Ney from the counts of counts; fixed values where a
    count of counts is missing."""
    n1, n2, n3, n4 = (F.count_if(c == k) for k in (1, 2, 3, 4))
    whole = (n1 > 0) & (n2 > 0) & (n3 > 0) & (n4 > 0)
    y = n1 / (n1 + 2 * n2)
    own = [(F.lit(1) - 2 * y * n2 / n1, 0.5), (F.lit(2) - 3 * y * n3 / n2, 0.75), (F.lit(3) - 4 * y * n4 / n3, 0.9)]
    return [F.when(whole, F.least(F.lit(float(k)), F.greatest(F.lit(0.05), d))).otherwise(F.lit(fixed)).alias(f"_d{k}") for k, (d, fixed) in enumerate(own, 1)]


def probabilities(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """counts: count_grams(), written. (lang, gram, log_p): the log-probability of the last character of
    each n-gram given those before it."""
    levels = {order: counts.select("lang", F.col("gram").alias("g"), F.col("n").alias("c"), "d0", "d1")}
    for k in range(order - 1, 0, -1):
        above = levels[k + 1].select("lang", F.substring("g", 2, k).alias("g"), "c", "d0", "d1")
        # in how many contexts an n-gram of the lower order was seen, or how often at a text's start
        c = F.sum(F.when(F.substring("g", 1, 1) == PAD, F.col("c")).otherwise(1)).alias("c")
        levels[k] = written(above.groupBy("lang", "g").agg(c, F.min("d0").alias("d0"), F.max("d1").alias("d1")), f"level{k}")
    below = None
    for k in range(1, order + 1):
        rows = levels[k]
        fixed = written(rows.groupBy("lang").agg(*discounts(F.col("c")), (F.lit(1.0) / (F.count(F.lit(1)) + 1)).alias("_uniform")), "discounts")
        d = F.when(F.col("c") == 1, F.col("_d1")).when(F.col("c") == 2, F.col("_d2")).otherwise(F.col("_d3"))
        rows = rows.join(few(fixed), "lang").withColumn("_d", F.least(d, F.col("c").cast("double"))).withColumn("_c", F.when(F.col("d0") != F.col("d1"), F.col("c")))
        context = Window.partitionBy("lang", F.substring("g", 1, k - 1))
        total, freed = F.sum("_c").over(context), F.sum(F.when(F.col("_c").isNotNull(), F.col("_d"))).over(context)
        rows = rows.select("lang", "g", "_uniform", F.coalesce(F.col("_c") - F.col("_d"), F.lit(0.0)).alias("_left"), total.alias("_total"), freed.alias("_freed"))
        if below is None:
            lower = F.col("_uniform")
        else:
            rows = rows.withColumn("_s", F.substring("g", 2, k - 1)).join(below.select("lang", F.col("g").alias("_s"), F.col("p").alias("_below")), ["lang", "_s"])
            lower = F.col("_below")
        below = written(rows.select("lang", "g", F.coalesce((F.col("_left") + F.col("_freed") * lower) / F.col("_total"), lower).alias("p")), f"p{k}")
    return below.select("lang", F.col("g").alias("gram"), F.log("p").alias("log_p"))


def few(by_language: DataFrame) -> DataFrame:
    """A written table of a row for each language, to be broadcast while languages are few: the rows
    of a hot language then stay where they are."""
    return F.broadcast(by_language) if by_language.count() <= BROADCAST_LANGUAGES else by_language.hint("merge")


Arrays = tuple[np.ndarray, np.ndarray]


def parts_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Of each language in each batch of (lang, gram, log_p) the n-grams' hashes and their log-probabilities."""
    for batch in batches:
        lang = batch.column(0).dictionary_encode()
        at, names = lang.indices.to_numpy(), lang.dictionary.to_pylist()
        h, p = hashes_of(batch.column(1).to_pylist()), batch.column(2).to_numpy().astype(np.float32)
        for k, x in enumerate(names):
            yield x, h[at == k], p[at == k]


def sorted_arrays(parts: Iterable[tuple[str, np.ndarray, np.ndarray]]) -> dict[str, Arrays]:
    """parts_of() as arrays sorted by the n-grams' hashes, for each language."""
    out: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    for x, h, p in parts:
        out.setdefault(x, []).append((h, p))
    found = {}
    for x in list(out):
        own = out.pop(x)
        h, p = np.concatenate([y[0] for y in own]), np.concatenate([y[1] for y in own])
        order = np.argsort(h)
        found[x] = h[order], p[order]
    return found


def arrays_of(table: pa.Table) -> dict[str, Arrays]:
    """(lang, gram, log_p) as arrays sorted by the n-grams' hashes, for each language."""
    return sorted_arrays(parts_of(table.to_batches(100_000)))


def packed(model: DataFrame) -> DataFrame:
    """model: (lang, gram, log_p). A row for each language of each batch: hashes and log-probabilities as bytes, 12
    for each n-gram, and no text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in grouped_batches(batches, 4_000_000):
            parts = list(parts_of([batch]))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _, _ in parts], pa.string()), *(pa.array([y[k].tobytes() for y in parts], pa.binary()) for k in (1, 2))], names=["lang", "h", "p"])

    return arrow_map(model, run, "lang string, h binary, p binary")


def gathered(model: DataFrame) -> dict[str, Arrays]:
    """arrays_of a written model of BROADCAST_ENTRIES n-grams at most, hashed by the tasks that read it."""
    rows = (r for batch in packed(model).toArrow().to_batches() for r in zip(*batch.columns, strict=True))
    return sorted_arrays((x.as_py(), np.frombuffer(h.as_buffer(), np.uint64), np.frombuffer(p.as_buffer(), np.float32)) for x, h, p in rows)


def log_perplexities(codes: list[np.ndarray], arrays: Arrays) -> np.ndarray:
    """Of each text the nats of its words, WORD_NATS at most for each, by the number of those with a letter
    or digit. All n-grams must be in arrays."""
    keys, values = arrays
    sizes = np.array([len(c) for c in codes], np.int64)
    nats, at = np.zeros(sizes.sum(), np.float32), 0
    for rows, order, start, _ in grams(codes):
        h = hashes(rows)
        found = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
        if not len(keys) or (keys[found] != h).any():
            raise ValueError("an n-gram is not in the model")
        nats[at + order] = np.repeat(-values[found], np.diff(np.concatenate((start, [len(order)]))))
        at += len(order)
    out = np.full(len(codes), np.nan)
    some = np.flatnonzero(sizes)
    if len(some):
        # a word starts with the space before it, and where a text does
        flat, begin = np.concatenate(codes), (np.cumsum(sizes) - sizes)[some]
        first = flat == 32
        first[(np.cumsum(sizes) - 1)[some]] = False
        first[begin] = True
        word = np.flatnonzero(first)
        spoken = np.logical_or.reduceat(_tables()[flat] == 2, word)
        capped = np.minimum(np.add.reduceat(nats.astype(np.float64), word), WORD_NATS)
        text = np.searchsorted(word, begin)
        out[some] = np.add.reduceat(capped, text) / np.maximum(1, np.add.reduceat(spoken.astype(np.int64), text))
    return out


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = text.encode("utf-8", "surrogatepass").split()
    word_chars = len(text) - sum(map(text.count, SPACES))
    n_symbols = sum(map(text.count, NOISE))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(words), word_chars, n_symbols, len(lines) - len(set(lines)), repeat_words(words)


def repeat_words(words: list[bytes]) -> int:
    """Words in 3-word windows that are found twice or more, the first included."""
    if len(words) < 4:
        return 0
    h = word_hashes(words)
    w = mix64(mix64(mix64(h[:-2]) + h[1:-1]) + h[2:])
    order = np.argsort(w)
    s = w[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(w), bool)
    twice[order] = np.concatenate((same, [False])) | np.concatenate(([False], same))
    hit = np.zeros(len(words), bool)
    for k in range(3):
        hit[k : len(words) - 2 + k] |= twice
    return int(hit.sum())


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SCORES = ", ".join(f"{c} bigint" for c in COUNTS) + ", log_ppl double"


def judged(langs: list[str], texts: list[str], models: dict[str, Arrays]) -> list[pa.Array]:
    """The columns of SCORES."""
    counts = np.array([base_counts(t) for t in texts], np.int64).reshape(-1, 5)
    log_ppl = np.full(len(texts), np.nan)
    own: dict[str, list[int]] = {}
    for i, x in enumerate(langs):
        if counts[i, 0] >= MIN_WORDS and 100 * counts[i, 4] <= 50 * counts[i, 0]:
            own.setdefault(x, []).append(i)
    for x, at in own.items():
        log_ppl[at] = log_perplexities([code_points(texts[i]) for i in at], models[x])
    return [*(pa.array(counts[:, k]) for k in range(5)), pa.array(log_ppl, from_pandas=True)]


def scored(docs: DataFrame, lang: str, text: str, model: DataFrame, keep: list[str]) -> DataFrame:
    """The columns keep of docs with counts and log-perplexities. model: (lang, gram, log_p), written."""
    names = [*keep, *COUNTS, "log_ppl"]
    schema = "".join(f"`{c}` {dict(docs.dtypes)[c]}, " for c in keep) + SCORES
    at_lang, at_text, at_kept = docs.columns.index(lang), docs.columns.index(text), [docs.columns.index(c) for c in keep]
    if model.count() <= BROADCAST_ENTRIES:
        held = docs.sparkSession.sparkContext.broadcast(gathered(model))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = judged(texts_of(batch.column(at_lang)), texts_of(batch.column(at_text)), held.value)
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in at_kept), *found], names=names)

        return arrow_map(docs, run, schema)
    return by_chunks(docs, at_lang, at_text, at_kept, model, names, schema)


def by_chunks(docs: DataFrame, at_lang: int, at_text: int, at_kept: list[int], model: DataFrame, names: list[str], schema: str) -> DataFrame:
    """scored() for a model of any size."""

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        for k, batch in enumerate(grouped_batches(batches, CHUNK_BYTES)):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([first + k] * batch.num_rows, pa.int64())], names=[*batch.schema.names, "_chunk"])

    rows = written(arrow_map(docs, chunked, "".join(f"`{c}` {t}, " for c, t in docs.dtypes) + "_chunk bigint"), "chunks")

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows of a chunk come together; where a read cuts one in two, some n-grams are asked for twice
        for batch in grouped_batches(batches, CHUNK_BYTES):
            by: dict[tuple[int, str], list[np.ndarray]] = {}
            for chunk, x, t in zip(batch.column(batch.num_columns - 1).to_pylist(), texts_of(batch.column(at_lang)), texts_of(batch.column(at_text)), strict=True):
                if passes(t):
                    by.setdefault((chunk, x), []).append(code_points(t))
            for (chunk, x), codes in by.items():
                for found, *_ in grams(codes):
                    yield pa.RecordBatch.from_arrays([pa.array([chunk] * len(found), pa.int64()), pa.array([x] * len(found), pa.string()), pa.array(strings(found), pa.string())], names=["_chunk", "lang", "gram"])

    asked = arrow_map(rows, wanted, "_chunk bigint, lang string, gram string")
    given = asked.join(model.hint("merge"), ["lang", "gram"]).select("_chunk", "lang", "gram", "log_p")

    def answer(key: tuple, table: pa.Table, given: pa.Table) -> pa.Table:
        found = judged(texts_of(table.column(at_lang)), texts_of(table.column(at_text)), arrays_of(given.drop_columns(["_chunk"])))
        return pa.table([*(table.column(k) for k in at_kept), *found], names=names)

    return rows.groupBy("_chunk").cogroup(given.groupBy("_chunk")).applyInArrow(answer, schema)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > 50 * n_words)


def assess(docs: DataFrame, lang: str = "lang", text: str = "text", upper: float = UPPER, lower: float = LOWER, keep: list[str] | None = None) -> DataFrame:
    """The columns keep (default: all) of docs with counts, log_ppl, base_failed and kept. Every document
    is read twice: to count n-grams, and to be scored; the scored rows are written before the bands
    are taken. A column of docs that has the name of a new one is not kept: the new ones win."""
    keep = free_of(docs.columns if keep is None else keep, (*COUNTS, "log_ppl", "base_failed", "kept"))
    language = F.coalesce(F.col(lang).cast("string"), F.lit(""))
    sizes = written(docs.groupBy(language.alias("_own")).agg(F.count(F.lit(1)).alias("_n")), "languages")
    rare = sizes.where(F.col("_n") < POOL).select("_own", F.lit(POOLED).alias("_pooled"))
    source = docs.select(language.alias("_own"), F.col(text).cast("string").alias("_text"), *(F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)))
    source = source.join(few(rare), "_own", "left").withColumn("_lang", F.coalesce("_pooled", "_own")).drop("_own", "_pooled")
    counts = written(count_grams(source.select(F.col("_lang").alias("lang"), F.col("_text").alias("text"))), "grams")
    rows = written(scored(source, "_lang", "_text", probabilities(counts), ["_lang", *(f"_keep{i}" for i in range(len(keep)))]), "scored")
    return banded(rows, upper, lower).withColumnsRenamed({f"_keep{i}": c for i, c in enumerate(keep)})


def banded(rows: DataFrame, upper: float = UPPER, lower: float = LOWER) -> DataFrame:
    """rows: scored documents with _lang. Adds base_failed and kept, from bands over all of them."""
    fit = rows.where(F.col("log_ppl").isNotNull())
    q = F.percentile_approx("log_ppl", [0.25, 0.5, 0.75], 5000)
    own = fit.groupBy("_lang").agg(F.count(F.lit(1)).alias("_n"), q.alias("_q")).select("_lang", "_n", F.col("_q")[1].alias("_mid"), (F.col("_q")[1] - F.col("_q")[0]).alias("_down"), (F.col("_q")[2] - F.col("_q")[1]).alias("_up"))
    own = written(own, "quartiles")
    share = lambda c: F.sum(F.col("_n") * F.col(c)) / F.sum("_n")
    every = own.agg(share("_down").alias("_all_down"), share("_up").alias("_all_up"))  # one row
    drawn = lambda c: (F.col("_n") * F.col(c) + SHRINK * F.col(f"_all{c}")) / (F.col("_n") + SHRINK)
    bands = own.join(F.broadcast(every)).select("_lang", (F.col("_mid") - lower * drawn("_down")).alias("_low"), (F.col("_mid") + upper * drawn("_up")).alias("_high"))
    bands = written(bands, "bands")
    kept = F.col("log_ppl").isNotNull() & (F.col("log_ppl") >= F.col("_low")) & (F.col("log_ppl") <= F.col("_high"))
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return rows.join(few(bands), "_lang", "left").select(*[c for c in rows.columns if c != "_lang"], failed.alias("base_failed"), F.coalesce(kept, F.lit(False)).alias("kept"))
