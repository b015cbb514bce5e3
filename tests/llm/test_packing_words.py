"""Ids of words by their parts, against the tokenizer on whole texts."""

import numpy as np

from orbitweave.llm import packing, queries

ODD = ["", " ", "\n a  b　", "a\x1cb c\x1f d", "\x1d", "Foo, foo. FOO! foo...", "don't 've 12,5 x1y", "Été; été İstanbul Ǆx ſo", "漢字, ...漢 *a* #b $", "\U0001f600a b\x85c"]


def test_ids_of_parts_are_those_of_whole_texts():
    path = queries.tokenizer_path()
    model = packing.tokenizer(path)
    r = np.random.default_rng(3)
    some = ODD + ["".join(r.choice(list("abÉÉſ.,;#*&-'13 \t\x1c漢İ"), 60)) for _ in range(400)]
    for texts in (ODD, [t for t in some if "\x1c" not in t], some, []):
        assert [x.tolist() for x in packing.token_ids(texts, path)] == [model.encode(x, add_special_tokens=False).ids for x in texts]


def test_a_plain_word_is_tokenised_once_whatever_its_case_and_marks(monkeypatch):
    path, asked = queries.tokenizer_path(), []
    model = packing.tokenizer(path)

    class Counted:
        def encode_batch_fast(self, texts, **options):
            asked.extend(w for t in texts for w in t.split())
            return model.encode_batch_fast(texts, **options)

    monkeypatch.setattr(packing, "_known", {}, raising=False)
    monkeypatch.setitem(packing._tokenizers, path, Counted())
    forms = [f(w) + m for w in ("wordone", "wordtwo", "wordthree") for f in (str.lower, str.upper, str.title) for m in ("", ".", ",", "!?")]
    got = packing.token_ids([" ".join(forms), " ".join(forms)], path)
    assert sorted(asked) == sorted(["wordone", "wordtwo", "wordthree", ".", ",", "!?"])
    assert [x.tolist() for x in got] == [model.encode(" ".join(forms), add_special_tokens=False).ids] * 2
    # what is remembered are parts, not one entry for each form of a word
    assert len(packing._known[path][0]) == 7


def test_more_parts_than_are_remembered(monkeypatch):
    path = queries.tokenizer_path()
    model = packing.tokenizer(path)
    monkeypatch.setattr(packing, "CACHE_WORDS", 5)
    for k in range(4):
        text = " ".join(f"w{chr(97 + k)}{chr(97 + j)}, {j}" for j in range(20))
        assert packing.token_ids([text], path)[0].tolist() == model.encode(text, add_special_tokens=False).ids
