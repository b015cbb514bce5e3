"""Operators on whole texts: each against a brute-force version, and on odd input."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitweave.llm import decontaminate, fm_index, langid, near_dups, packing, quality, queries, sharding

ODD = [(1, None, None, "x"), (2, "", "en", "x"), (3, " \n\t ", "en", "x"), (4, "one two", None, "x"), (5, "one two", "en", "x"), (5, "one two", "en", "x"), (None, "no id here", "en", "x"), (7, "Ü Ö # * | 日本 \x00 \x1c a", "de", "x")]
SCHEMA = "doc_id long, text string, lang string, score string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(seed, n, vocabulary=60, longest=120):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    return [" ".join(r.choice(words) for _ in range(r.randint(0, longest))) for _ in range(n)]


def test_suffix_array_and_search():
    r = np.random.default_rng(1)
    t = r.integers(1, 5, 300)
    full = np.concatenate((t, [0]))
    assert fm_index.suffix_array(full).tolist() == sorted(range(301), key=lambda i: full[i:].tolist())
    index = fm_index.FMIndex(t, 5)
    patterns = r.integers(1, 5, (40, 4))
    lengths = r.integers(1, 5, 40)
    low, high = index.ranges(patterns, lengths)
    for p, n, a, b in zip(patterns, lengths, low, high):
        want = [i for i in range(len(t) - n + 1) if t[i : i + n].tolist() == p[:n].tolist()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_decontamination_against_brute_force(spark):
    docs, items = texts(1, 60), texts(2, 8, longest=30) + ["w1 w2", None, "", "w1 w2"]
    docs[3] += " " + items[0] + " " + items[1]
    docs[9] = items[2] * 2
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    phrases = collections.defaultdict(set)
    for i, x in enumerate(items):
        w = (x or "").split()
        for k in range(max(1, len(w) - 9) if w else 0):
            phrases[tuple(w[k : k + 10])].add(str(i))
    want = {}
    for i, x in enumerate(docs):
        w, hit, found = x.split(), set(), set()
        for n in {len(p) for p in phrases}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in phrases:
                    found |= phrases[tuple(w[k : k + n])]
                    hit |= set(range(k, k + n))
        want[i] = (len(w), len(hit), sorted(found))
    for block in (decontaminate.BLOCK_BYTES, 100):  # one pass, and several
        got = decontaminate.scan(d, b, block_bytes=block).withColumn("n_hit", decontaminate.n_hit(decontaminate.F.col("spans"))).collect()
        assert {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in got} == want


def test_decontamination_cuts_until_clean(spark):
    item = " ".join(f"b{i}" for i in range(12))
    # cutting the inner copy brings the outer halves together
    text = "x " + " ".join(f"b{i}" for i in range(6)) + " " + item + " " + " ".join(f"b{i}" for i in range(6, 12)) + " y"
    d = spark.createDataFrame([(1, text), (2, "clean text"), (3, None)], "doc_id long, text string")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["doc_id"]: r["text"] for r in decontaminate.scan(d, b, remove=True).collect()}
    assert got[1].split() == ["x", "y"] and got[2] == "clean text" and got[3] is None


def test_decontamination_removes_the_same_in_one_block_and_in_several(spark):
    w = lambda x, a, b: " ".join(f"{x}{i}" for i in range(a, b))
    # phrases of two items that overlap; one item inside a copy of another, both ways round; all cut
    items = [w("a", 0, 12), w("a", 6, 12) + " " + w("b", 0, 8), w("c", 0, 12), w("d", 0, 12)]
    docs = ["x " + w("a", 0, 12) + " " + w("b", 0, 8) + " y", "x " + w("c", 0, 6) + " " + items[3] + " " + w("c", 6, 12) + " y", "x " + w("d", 0, 6) + " " + items[2] + " " + w("d", 6, 12) + " y", items[0], items[3], "clean text", None, "clean text"]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    one, several = (sorted(map(tuple, decontaminate.scan(d, b, remove=True, block_bytes=n).collect())) for n in (decontaminate.BLOCK_BYTES, 20))
    assert one == several
    assert [r[1].split() if r[1] is not None else None for r in one] == [["x", "y"]] * 3 + [[], []] + [["clean", "text"], None, ["clean", "text"]]
    assert all(r[4] for r in one[:5])


def test_long_text_is_cut_into_overlapping_segments():
    words = [f"v{i % 7}" for i in range(500)]
    phrases = decontaminate.Phrases([("a", " ".join(words[95:105]))])
    whole = list(decontaminate.search([" ".join(words)], phrases))
    parts = list(decontaminate.search([" ".join(words)], phrases, shard_words=100))
    assert whole == parts and whole[0][2]


def test_token_ids_are_those_of_whole_texts():
    path = queries.tokenizer_path()
    model = packing.tokenizer(path)
    r = random.Random(3)
    letters = "ab'sS tré́İİΣσ\x1c\x1f\x85\xa0 　\n\t 19.,!<|endoftext|>日本한\x0b中😀"
    some = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(2000)] + ["Hello, world. it's <|endoftext|>"]
    assert [x.tolist() for x in packing.token_ids(some, path)] == [model.encode(x, add_special_tokens=False).ids for x in some]


def check_packing(rows, documents, capacity):
    model = packing.tokenizer(queries.tokenizer_path())
    want = collections.Counter()
    for i, x in documents:
        ids = np.array([*model.encode(x or "", add_special_tokens=False).ids, 1], "<u4")
        for k, s in enumerate(range(0, len(ids), capacity)):
            want[i, k, s, len(ids[s : s + capacity]), zlib.crc32(ids[s : s + capacity].tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    placed = collections.defaultdict(list)
    for r in rows:
        placed[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in placed.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(placed)


def test_packing_is_exact_and_tight(spark, odd, empty):
    docs = [(i, x) for i, x in enumerate(texts(4, 200, longest=60))]
    got = packing.pack_documents(spark.createDataFrame(docs, "doc_id long, text string"), queries.tokenizer_path(), capacity=64).collect()
    n = check_packing(got, docs, 64)
    assert n <= 1.05 * sum(r["length"] for r in got) / 64 + 1
    check_packing(packing.pack_documents(odd, queries.tokenizer_path()).collect(), [(r[0], r[1]) for r in ODD], 4096)
    assert packing.pack_documents(empty, queries.tokenizer_path()).count() == 0


def best_fit(lengths, capacity):
    """Sequences of best-fit decreasing, one piece after another."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, g in enumerate(gaps) if g >= n]
        if fits:
            gaps[min(fits, key=lambda k: gaps[k])] -= n
        else:
            gaps.append(capacity - n)
    return len(gaps)


@pytest.mark.parametrize("range_", [packing.RANGE, 3])
def test_sweep_is_bracket_matching(spark, monkeypatch, range_):
    monkeypatch.setattr(packing, "RANGE", range_)
    r = random.Random(5)
    todo = [(i, r.randint(3, 20)) for i in range(60)]
    gaps = [(1000 + i, r.randint(1, 45)) for i in range(40)]
    got = packing.sweep(spark.createDataFrame(todo, "_p long, length long"), spark.createDataFrame(gaps, "sequence_id long, gap long"), 3, 20).collect()
    # by hand: pieces from long to short, each takes the smallest free place
    places = sorted(g // max(1, g // 20) for _, g in gaps if g >= 3 for _ in range(max(1, g // 20)))
    want = 0
    for n in sorted((n for _, n in todo), reverse=True):
        if fit := [x for x in places if x >= n]:
            places.remove(fit[0])
            want += 1
    assert len(got) == len(todo) and sum(x["sequence_id"] is not None for x in got) == want
    size = dict(gaps)
    used = collections.Counter((x["sequence_id"], x["slot"]) for x in got if x["sequence_id"] is not None)
    assert max(used.values()) == 1 and all(x["length"] <= size[x["sequence_id"]] // max(1, size[x["sequence_id"]] // 20) for x in got if x["sequence_id"] is not None)


@pytest.mark.parametrize(("capacity", "make"), [(64, lambda r: r.randint(1, 64)), (100, lambda r: r.choice([1, 7, 33, 34, 50, 51, 100])), (1, lambda r: 1)])
def test_packing_is_as_tight_as_best_fit(spark, capacity, make):
    r = random.Random(capacity)
    lengths = [make(r) for _ in range(300)]
    got = packing.pack(spark.createDataFrame(list(enumerate(lengths)), "doc_id long, length long"), capacity).collect()
    assert sorted((x["doc_id"], x["length"]) for x in got) == list(enumerate(lengths))
    placed = collections.defaultdict(list)
    for x in got:
        placed[x["sequence_id"]].append((x["offset"], x["length"]))
    for parts in placed.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    assert len(placed) <= best_fit(lengths, capacity) + 1


def base_by_hand(text):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    seen = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines, dup = set(), 0
    for x in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", x):
            dup += x in lines
            lines.add(x)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def test_base_counts():
    some = texts(6, 50, vocabulary=5, longest=40) + ["a\nb\n\na\n \na", "", "x y | z", "a b c a b c"]
    assert [quality.base_counts(x) for x in some] == [base_by_hand(x) for x in some]


def kneser_ney(found, order):
    """Modified Kneser-Ney by its textbook definition, without n-grams that only one text has: a
    function (context, character) -> p. found: {n-gram: (count, texts)}."""
    c, texts_with = {order: {g: n for g, (n, _) in found.items()}}, {order: {g: set(x) for g, (_, x) in found.items()}}
    for k in range(order - 1, 0, -1):
        c[k], texts_with[k] = collections.Counter(), collections.defaultdict(set)
        for g, n in c[k + 1].items():
            c[k][g[1:]] += n if g[1] == "\x00" else 1
            texts_with[k][g[1:]] |= texts_with[k + 1][g]
    d = {}
    for k in c:
        n = [sum(x == j for x in c[k].values()) for j in range(5)]
        if min(n[1:]) == 0:
            d[k] = [0, 0.5, 0.75, 0.9]
        else:
            y = n[1] / (n[1] + 2 * n[2])
            d[k] = [0] + [min(j, max(0.05, j - (j + 1) * y * n[j + 1] / n[j])) for j in (1, 2, 3)]

    def p(context, x):
        k = len(context) + 1
        lower = p(context[1:], x) if k > 1 else 1 / (len(c[1]) + 1)
        own = {g[-1]: n for g, n in c[k].items() if g[:-1] == context and len(texts_with[k][g]) > 1}
        if not own:
            return lower
        freed = sum(min(n, d[k][min(n, 3)]) for n in own.values())
        kept = max(0, own[x] - d[k][min(own[x], 3)]) if x in own else 0
        return (kept + freed * lower) / sum(own.values())

    return p, set(c[1])


def grams_by_hand(text):
    text = "\x00" * (quality.ORDER - 1) + re.sub(r"[\s\x00-\x1f\x7f]+", " ", text).removeprefix(" ")
    return [text[i : i + quality.ORDER] for i in range(len(text) - quality.ORDER + 1)]


SOME = ["w1 w22  w1\nw3 " + " ".join(f"w{i}" for i in range(60)), "Über ÜBER über, 日本語 の本 " + " ".join(f"ü{i}の" for i in range(60)), "a b c d e f g " * 3 + " ".join(f"abc{i}" for i in range(70)) + "$$$ x\x00y"]


def test_model_against_kneser_ney_by_hand(spark):
    rows = [("en" if i % 2 else "de", x) for i, x in enumerate([*texts(7, 16, vocabulary=30), *SOME, *SOME[::-1], SOME[1] + SOME[0]]) if quality.passes(x)]
    found = {x: collections.defaultdict(lambda: [0, set()]) for x in ("en", "de")}
    for lang, text in rows:
        for g in grams_by_hand(text):
            found[lang][g][0] += 1
            found[lang][g][1].add(text)
    counts = quality.written(quality.count_grams(spark.createDataFrame(rows, "lang string, text string").repartition(3)), "t")
    assert {(r["lang"], r["gram"]): (r["n"], r["d0"] != r["d1"]) for r in counts.collect()} == {(x, g): (n, len(s) > 1) for x in found for g, (n, s) in found[x].items()}
    got = {(r["lang"], r["gram"]): r["log_p"] for r in quality.probabilities(counts).collect()}
    assert len(got) == counts.count()
    for lang in ("en", "de"):
        p, alphabet = kneser_ney(found[lang], quality.ORDER)
        own = [g for x, g in got if x == lang]
        for g in own[::7]:
            assert np.exp(got[lang, g]) == pytest.approx(p(g[:-1], g[-1]), rel=1e-9)
        # with the unseen, all that may follow a context sums to one
        assert sum(p(own[0][:-1], x) for x in alphabet) + p(own[0][:-1], "unseen") == pytest.approx(1)


def test_grams_of_slices(monkeypatch):
    some = [*SOME, "", "x", " \n ", "$$ a| | 日本 "]
    codes = [quality.code_points(x) for x in some]
    every = sorted({g for x in some for g in grams_by_hand(x)})
    order = np.argsort(h := quality.hashes_of(every))
    arrays = h[order], -np.array([len(set(g)) * 3.1 for g in every], np.float32)[order]
    want = []
    for x in some:  # by hand: a word has the space before it, except at the start
        x = re.sub(r"[\s\x00-\x1f\x7f]+", " ", x).removeprefix(" ")
        nats, words = dict(zip(range(len(x)), (len(set(g)) * 3.1 for g in grams_by_hand(x)), strict=True)), [[]]
        for k in range(len(x)):
            if x[k] == " " and 0 < k < len(x) - 1:
                words.append([])
            words[-1].append(k)
        spoken = sum(any(x[k].isalnum() for k in w) for w in words)
        want.append(sum(min(30, sum(nats[k] for k in w)) for w in words) / max(1, spoken) if x else np.nan)
    for size, bits in ((1_000_000, 63), (7, 63), (1, 63), (50, 20), (50, 1)):
        monkeypatch.setattr(quality, "SLICE", size)
        monkeypatch.setattr(quality, "BITS", bits)
        found = [collections.Counter() for _ in some]
        for rows, places, start, text in quality.grams(codes):
            names = quality.strings(rows)
            assert (quality.hashes(rows) == quality.hashes_of(names)).all() and sorted(places) == list(range(len(places)))
            for name, at in zip(names, np.split(places, start[1:]), strict=True):
                for i in text[at].tolist():
                    found[i][name] += 1
        assert found == [collections.Counter(grams_by_hand(x)) for x in some]
        assert quality.log_perplexities(codes, arrays) == pytest.approx(want, rel=1e-5, nan_ok=True)


def prose(seed, n, letters="abcdefghij", longest=200):
    """Texts of words of a made-up language whose letters follow one another by rules."""
    r = random.Random(seed)
    parts = ["".join(r.choice(letters) for _ in range(r.randint(2, 3))) for _ in range(25)]
    short = ["".join(r.choice(letters) for _ in range(2)) for _ in range(8)]
    word = lambda: r.choice(short) if r.random() < 0.4 else "".join(r.choice(parts) for _ in range(r.randint(2, 3)))
    return [" ".join(word() for _ in range(r.randint(60, longest))) for _ in range(n)]


def quality_rows():
    good = [(i, x, "en") for i, x in enumerate(prose(8, 150))] + [(200 + i, x, "de") for i, x in enumerate(prose(9, 60, "klmnopqrst"))]
    r = random.Random(10)
    shuffled = []
    for _, x, _ in good[:3]:  # the same letters and lengths of words, in senseless order
        letters = iter(r.sample(y := x.replace(" ", ""), len(y)))
        shuffled.append("".join(c if c == " " else next(letters) for c in x))
    loud = [x.replace(" ", "### ") for _, x, _ in good[3:6]]
    bad = [(300 + i, x, "en") for i, x in enumerate(shuffled + loud)] + [(310, "ab ab " * 100, "en")]
    common = [w for w, _ in collections.Counter(w for i, x, _ in good if i < 200 for w in x.split()).most_common(7)]
    monotone = [(320, " ".join(r.choice(common) for _ in range(70)), "en")]
    small = [(400 + i, x, f"x{i % 5}" if i % 2 else None) for i, x in enumerate(prose(11, 30, "uvwxyz"))]
    odd_one = [(450, loud[0], "x1")]
    return good, bad, monotone, small, odd_one


def test_quality_bands(spark, odd, empty):
    good, bad, monotone, small, odd_one = quality_rows()
    rows = good + bad + monotone + small + odd_one
    got = {r["doc_id"]: r for r in quality.assess(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()}
    assert sum(got[i]["kept"] for i, *_ in good + small) >= 0.98 * len(good + small)
    assert not any(got[i]["kept"] for i, *_ in bad + odd_one)
    # what has no marks goes too: shuffled letters above the band, a monotone text below it
    middle = sorted(got[i]["log_ppl"] for i, *_ in good if i < 200)[75]
    assert got[300]["log_ppl"] > middle and not got[300]["base_failed"] and got[300]["n_symbols"] == 0
    assert got[320]["log_ppl"] < middle and not got[320]["base_failed"] and not got[320]["kept"]
    odd_rows = quality.assess(odd).collect()
    assert len(odd_rows) == len(ODD) and all(r["base_failed"] and not r["kept"] and r["log_ppl"] is None for r in odd_rows) and quality.assess(empty).count() == 0
    clash = quality.assess(odd.withColumnsRenamed({"score": "Kept"}).withColumn("_own", F.lit("mine")))
    assert [c for c in clash.columns if c.lower() == "kept"] == ["kept"] and {r["_own"] for r in clash.collect()} == {"mine"}


def test_quality_in_chunks_is_the_same(spark, odd, monkeypatch):
    good, bad, monotone, small, odd_one = quality_rows()
    df = spark.createDataFrame([*good[::5], *bad, *monotone, *small, (None, good[0][1], "en"), (5, None, None), (6, "", "en")], "doc_id long, text string, lang string").repartition(3)
    one = sorted(map(tuple, quality.assess(df).collect()), key=repr)
    monkeypatch.setattr(quality, "BROADCAST_ENTRIES", 0)
    monkeypatch.setattr(quality, "CHUNK_BYTES", 20_000)
    two = sorted(map(tuple, quality.assess(df).collect()), key=repr)
    assert [(*r[:8], *r[9:]) for r in one] == [(*r[:8], *r[9:]) for r in two]
    assert all((a[8] is None and b[8] is None) or a[8] == pytest.approx(b[8], rel=1e-6) for a, b in zip(one, two, strict=True))
    monkeypatch.undo()


def test_ranges_of_texts():
    from orbitweave.llm.common import spans_of_size

    assert list(spans_of_size(["aaa", "b", "cc", "ddddddd", ""], 4)) == [(0, 2), (2, 3), (3, 4), (4, 5)] and list(spans_of_size([])) == []


def linked(documents, words, percent):
    sets = {}
    for i, x in documents:
        w = [y.translate({c: c + 32 for c in range(65, 91)}) for y in re.findall("[^\x20\x09-\x0d]+", x or "")]
        sets[i] = {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_near_duplicates_against_brute_force(spark):
    r = random.Random(10)
    docs = [x for x in texts(11, 40, vocabulary=3000) if x]
    base = " ".join(f"t{i}" for i in range(150))
    for _ in range(60):  # a group of near copies, of which some pairs are links and some are not
        w = base.split()
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = f"u{r.randrange(10**6)}"
        docs.append(" ".join(w))
    docs += [base, base, base.upper(), "short", "Short", "two words", "", None]
    rows = list(enumerate(docs))
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for words, percent in ((3, 85), (5, 80)):
        got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in near_dups.near_duplicates(df, words=words, percent=percent).collect()}
        assert got == linked(rows, words, percent)


def test_near_duplicates_blocks_and_shuffled_texts(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "BLOCK", 4)
    monkeypatch.setattr(near_dups, "SMALL", 16)
    monkeypatch.setattr(near_dups, "BROADCAST_IDS", 0)
    test_near_duplicates_against_brute_force(spark)


def test_near_duplicates_of_repeated_ids(spark):
    # 20 ids with two texts each, and a near copy of every text under an id of its own
    base = [" ".join(f"{x}{i}w{k}" for k in range(80)) for i in range(20) for x in "ab"]
    rows = [(i // 2, t) for i, t in enumerate(base)] + [(100 + i, t + " more") for i, t in enumerate(base)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("mark", near_dups.F.col("text"))
    got = {(r["doc_id"], r["mark"]): r["component_id"] for r in near_dups.near_duplicates(df, words=3, percent=85, keep=["mark"]).collect()}
    assert got == {(i, t): (i if i < 100 else (i - 100) // 2) for i, t in rows}


def test_many_unlike_documents_of_one_bucket(spark, monkeypatch):
    # 5,000 texts that share one band and little else, and a near copy of every hundredth
    r = random.Random(21)
    monkeypatch.setattr(near_dups, "SMALL", 1000)
    real = near_dups.signatures

    def one_bucket(sets):
        bands, fine, bitmaps = real(sets)
        bands[:, 3] = 7
        return bands, fine, bitmaps

    monkeypatch.setattr(near_dups, "signatures", one_bucket)
    docs = [" ".join(f"w{r.randrange(4000)}" for _ in range(40)) for _ in range(5000)]
    rows = list(enumerate(docs)) + [(10_000 + i, docs[i] + " end") for i in range(0, 5000, 100)]
    seen = []
    whole = near_dups.written
    monkeypatch.setattr(near_dups, "written", lambda df, name: (seen.append((name, whole(df, name))), seen[-1][1])[1])
    got = {x["doc_id"]: x["component_id"] for x in near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), words=3, percent=85).collect()}
    assert got == {i: i if i < 10_000 else i - 10_000 for i, _ in rows}
    # the remainder stays linear: no more cells than finer hashes, and few pairs
    assert next(d for n, d in seen if n == "more").count() < len(rows)


def test_near_duplicates_on_odd_input(odd, empty):
    got = near_dups.near_duplicates(odd, words=3, percent=85).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["component_id"], r["kept"]) for r in got if r["doc_id"]) == [(False, 1, 1, True), (False, 2, 2, True), (False, 3, 3, True), (False, 4, 4, True), (False, 5, 4, False), (False, 5, 4, False), (False, 7, 7, True)]
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, True)]
    assert near_dups.near_duplicates(empty).count() == 0


def languages(seed, n):
    r = random.Random(seed)
    letters = ["abcde", "eßüöä", "klmno", "uvwxy", "aeiou"]
    make = lambda k: " ".join("".join(r.choice(letters[k]) for _ in range(r.randint(2, 8))) for _ in range(60))
    return [(i, make(i % 5), f"l{i % 5}") for i in range(n)]


LANG = "doc_id long, text string, lang string"


def test_language_model(spark, odd, empty, monkeypatch):
    rows = languages(12, 200)
    train, test = spark.createDataFrame(rows[:150] + [(1, None, "l0"), (2, "x", None), (3, "", "l9")], LANG), spark.createDataFrame(rows[150:], LANG)
    model = langid.fit(train.repartition(3))
    assert model.langs == ["l0", "l1", "l2", "l3", "l4"]
    got = {x["doc_id"]: x for x in langid.identify(test, model).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang in rows[150:])
    # blocks of languages give the same as one block, and both the same as cosines one by one
    whole = next(model.blocks())
    monkeypatch.setattr(langid, "AT_ONCE", 2)
    for x in langid.identify(test, model).collect():
        assert x["lang_pred"] == got[x["doc_id"]]["lang_pred"] and x["score"] == pytest.approx(got[x["doc_id"]]["score"], abs=1e-5)
    for i, text, _ in rows[150:170]:
        v = [float(np.log1p(c)) * float(w) for c, w in zip(langid.counts(text), model.idf, strict=True)]
        norm = sum(x * x for x in v) ** 0.5
        cosines = [sum(x * float(y) for x, y in zip(v, c, strict=True)) / norm for c in whole.centroids]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        assert got[i]["score"] == pytest.approx(cosines[best], abs=1e-5) and got[i]["lang_pred"] == whole.langs[whole.owner[best]]
    # document frequencies are those of all learnable documents
    seen = np.sum([langid.counts(x) > 0 for _, x, lang in rows[:150]], 0)
    assert model.idf == pytest.approx(np.log(151 / (1 + seen)) + 1, rel=1e-5)
    out = langid.identify(odd.drop("score"), model).collect()
    assert len(out) == len(ODD) and {x["lang_pred"] for x in out if x["doc_id"] in (1, 2, 3)} == {"und"} and all(0 <= x["score"] <= 1 for x in out)
    nothing = langid.fit(empty)
    assert {x["lang_pred"] for x in langid.identify(odd.drop("score"), nothing).collect()} == {"und"}
    assert langid.identify(odd, model).columns == ["doc_id", "text", "lang", "lang_pred", "score", "rejected"]


def test_language_sample_is_the_lowest_hashes_of_distinct_texts(spark, monkeypatch):
    rows = [("a" if i % 3 else "b", f"text {i % 200}") for i in range(900)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    got = {(r["lang"], r["hash"]) for r in langid.chosen_texts(df, 7).collect()}
    every = {(r["lang"], r["h"]) for r in df.select("lang", langid.F.xxhash64("text").alias("h")).collect()}
    assert got == {(x, h) for x in "ab" for h in sorted((h for y, h in every if y == x), key=lambda h: h % 2**64)[:7]}
    monkeypatch.setattr(langid, "BROADCAST_TEXTS", 0)
    assert langid.fit(spark.createDataFrame(languages(1, 40), LANG)).langs == [f"l{k}" for k in range(5)]


@pytest.mark.skipif(not __import__("os").path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_language_query_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang", "text")
    rows = queries.op1_centroid_language(spark, "/root/testdata/sf0.001").join(docs, "doc_id").collect()
    assert len(rows) == docs.count() and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"] and r["text"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.93 * len(held) and len(held) > 20


def test_language_counts_are_the_same_in_slices(monkeypatch):
    text = texts(13, 1, longest=119)[0] + " Über ñandú" * 30
    whole = langid.counts(text)
    monkeypatch.setattr(langid, "SLICE", 37)
    assert (langid.counts(text) == whole).all() and whole.sum() > 0


def shard_by_hand(key, weights):
    import math

    scores = []
    for s, w in enumerate(weights):
        u = (int(hashlib.md5(f"{s}:{key}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        scores.append((-w / math.log(u), -s))
    return -max(scores)[1]


def test_sharding(spark, odd, empty):
    from pyspark.sql import functions as F

    keys = spark.range(3000).withColumnRenamed("id", "k")
    equal, more, uneven = [1.0] * 8, [1.0] * 9, [1.0, 2.0, 5.0]
    got = keys.select("k", sharding.rendezvous(F.col("k"), equal).alias("a"), sharding.rendezvous(F.col("k"), more).alias("b"), sharding.rendezvous(F.col("k"), uneven).alias("c")).collect()
    assert all((r["a"], r["b"], r["c"]) == (shard_by_hand(r["k"], equal), shard_by_hand(r["k"], more), shard_by_hand(r["k"], uneven)) for r in got)
    assert all(r["a"] == r["b"] or r["b"] == 8 for r in got) and 0.05 < sum(r["a"] != r["b"] for r in got) / 3000 < 0.17
    share = collections.Counter(r["c"] for r in got)
    assert abs(share[2] / 3000 - 5 / 8) < 0.05
    # a key that repeats thousands of times
    hot = spark.range(9000).select(F.lit(7).alias("k")).unionByName(keys)
    rows = sharding.assign_shards(hot, "k", equal)
    slots = collections.defaultdict(list)
    for r in sharding.numbered(rows, "shard", ["k"], range_=20).collect():
        slots[r["shard"]].append(r["slot"])
    assert sum(map(len, slots.values())) == 12000 and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert sharding.numbered(sharding.assign_shards(odd, "doc_id", equal), "shard", ["doc_id", "text"]).count() == len(ODD)
    assert sharding.numbered(sharding.assign_shards(empty, "doc_id", equal), "shard", ["doc_id"]).count() == 0


def test_names_that_are_taken_and_ids_of_any_type(spark):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [("b", text, "x"), ("a", text + " more", "y"), ("c", "quite another text", "z")]
    for name in ("n_shingles", "KEPT", "component_id", "_keep0"):
        docs = spark.createDataFrame(rows, f"doc_id string, text string, {name} string")
        got = near_dups.near_duplicates(docs, words=3, percent=80, keep=["doc_id", name])
        assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {"a": "a", "b": "a", "c": "c"}
        assert got.columns[4:] == ([name] if name == "_keep0" else [])
        pieces = packing.pack_documents(docs, queries.tokenizer_path()).collect()
        assert sorted(r["doc_id"] for r in pieces) == ["a", "b", "c"]
    docs = spark.createDataFrame(rows, "doc_id string, text string, items string")
    found = decontaminate.scan(docs, spark.createDataFrame([(1, text)], "item_id long, text string"))
    assert {r["doc_id"]: r["items"] for r in found.collect()} == {"a": ["1"], "b": ["1"], "c": []}
    assert {r["items"] for r in sharding.assign_shards(docs, "doc_id", [1.0, 1.0], "items").collect()} <= {0, 1}


def test_a_large_component_is_named_in_all_tasks(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "HUB", 3)
    text = [f"word{i}" for i in range(60)]
    rows = [(i, " ".join([*text, f"end{i}"])) for i in range(20)] + [(100 + i, f"alone {i} {i} {i * 7}") for i in range(5)] + [(200, "two of these are alike here"), (201, "two of these are alike here")]
    got = near_dups.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: 0 if i < 20 else 200 if i >= 200 else i for i, _ in rows}
