"""Toxicity, HTML, WARC and licences: brute-force versions, round trips, held-out accuracy, odd
input; and the pipeline as a whole."""

import base64
import gzip
import hashlib
import itertools
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitweave.llm import crf, html_text, licences, queries, toxicity, warc

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
ODD = [(1, None, "x"), (2, "", "x"), (3, " \n ", "x"), (None, "no id", "x"), (5, "twice", "x"), (5, "twice", "x"), (7, "long " * 3000, "x")]


def test_marginals_against_enumeration():
    r = np.random.default_rng(1)
    transition, start = r.normal(size=(2, 2)), r.normal(size=2)
    lengths = [1, 5, 3, 1, 7]
    first = np.zeros(sum(lengths), bool)
    first[np.cumsum([0, *lengths])[:-1]] = True
    e = r.normal(size=len(first)) * 2
    got = crf.marginals(e, first, transition, start)
    p, xi, starts = crf.pair_counts(e, first, transition, start)
    want, pairs, begun, at = [], np.zeros((2, 2)), np.zeros(2), 0
    for n in lengths:
        total, on, own_pairs, own_start = 0.0, np.zeros(n), np.zeros((2, 2)), np.zeros(2)
        for s in itertools.product((0, 1), repeat=n):
            w = np.exp(start[s[0]] + sum(e[at + k] * s[k] for k in range(n)) + sum(transition[s[k - 1], s[k]] for k in range(1, n)))
            total += w
            on += w * np.array(s)
            own_start[s[0]] += w
            for k in range(1, n):
                own_pairs[s[k - 1], s[k]] += w
        want += (on / total).tolist()
        pairs += own_pairs / total
        begun += own_start / total
        at += n
    assert got == pytest.approx(want) and p == pytest.approx(want) and xi == pytest.approx(pairs) and starts == pytest.approx(begun)
    assert len(crf.marginals(np.zeros(0), np.zeros(0, bool), transition, start)) == 0


def test_long_sequences_are_stable():
    n = 200_000
    first = np.zeros(n, bool)
    first[0] = True
    e = np.full(n, -3.0)
    e[1000] = 15
    p = crf.marginals(e, first, np.zeros((2, 2)), np.zeros(2))
    assert p[1000] > 0.99 and abs(p[5] - 1 / (1 + np.exp(3))) < 1e-9


def labelled(seed, n):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        w = [r.choice(words) for _ in range(r.randint(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(r.randint(1, 3)):
                w.insert(r.randrange(len(w)), r.choice(["scummy", "grobian" + r.choice("abcdefgh")]))
        rows.append((i, " ".join(w), int(toxic)))
    return rows


def test_toxicity_learns_and_places_spans(spark):
    rows = labelled(2, 400)
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(x[0], x[2]) for x in rows[:280]] + [(0, 1), (1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs.where("doc_id < 280"), labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs.where("doc_id >= 280"), model).collect()}
    right = sum((got[i]["toxic_score"] >= toxicity.THRESHOLD) == bool(y) for i, _, y in rows[280:])
    assert right >= 0.97 * len(got)
    for i, text, y in rows[280:]:
        for s in got[i]["toxic_spans"]:
            assert text[s["start"] : s["end"]].split()[0].startswith(("scum", "grob"))
    odd = toxicity.score(spark.createDataFrame(ODD, "doc_id long, text string, score string"), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r["toxic_score"] < toxicity.THRESHOLD for r in odd)
    none = toxicity.fit(docs.limit(0), labels)
    assert all(r["toxic_score"] == pytest.approx(1e-6, rel=1) for r in toxicity.score(docs, none).collect())
    assert toxicity.score(docs.limit(0), model).count() == 0


PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1><p>Welcome to the site of the year and the place to be.</p></header>
<div id="cookie-notice">We use cookies to make it better for you and all of the others.</div><div class="sidebar"><p>About the author of this</p></div>
<main><div class="entry-header"><h1>Title &amp; more</h1></div><p>First <b>para</b>graph of the text that is here for you.<p>Short.<form><input name=q><p>Subscribe now to the list of</p></form><aside>Related</aside>
<ul><li>one item</li><li><a href=x>link only</a></li></ul><script>var t="<p>no</p>";</script><section class="comments"><p>I like the article and the rest of it.</p></section><p>Last&nbsp;one
   here</main><footer>&copy; x</footer>"""


def test_html_blocks():
    assert html_text.main_text(PAGE) == "Title & more\nFirst paragraph of the text that is here for you.\nShort.\none item\nLast one here"
    prose = "the cat sat on the mat and it was good for the dog to be in the house of the man " * 3
    # without an article: short blocks go with the nearer decided side, links are no text
    assert html_text.main_text(f"<h1>Title</h1><p>{prose}</p><p>short one</p><p>{prose}</p><p>end</p><p><a href=x>Menu</a></p>") == f"Title\n{prose.strip()}\nshort one\n{prose.strip()}\nend"
    assert html_text.main_text(f"<nav><p>a</p></nav><p>b</p><p>c</p><p>d</p><p>{prose}</p>") == f"c\nd\n{prose.strip()}"
    assert html_text.main_text(f"<p>stray</p><article><p>{prose}</p></article><p>stray</p>") == prose.strip()
    assert html_text.main_text("<div id='header'>Site</div><div id='content'><p>x y</p><div class='share'>Share</div></div><div id='sidebar'><p>z</p></div>") == "x y"
    assert html_text.main_text("<p>Ciao mondo questa pagina ha molte parole italiane senza nulla di inglese o altro ancora ecco</p><p>fine</p>").endswith("ecco\nfine")
    for odd in ("", "text", "<", "<p", "<!-- x", "<script>x", "</p></p>", "<a href='>'>x</a>", "&#x110000;", "\x00<p>\ud800</p>", "<nav><p>x</nav>"):
        html_text.main_text(odd)
    assert html_text.main_text("<article>" + "<p>x" * 5000) == "\n".join("x" * 5000)


PROSE = {
    "en": "This is the text of the page and it is for you and all of them, as they said when we were there and had more to do. " * 2,
    "de": "Das ist der Text der Seite und er ist für dich und für alle, die mit uns auf dem Weg in die Stadt sind und nicht zu spät. " * 2,
    "fr": "Le texte de la page est pour vous et pour tous ceux qui sont dans la ville avec nous et qui ne sont pas en retard sur le plan. " * 2,
    "es": "El texto de la página es para todos los que están en la ciudad con nosotros y que no llegan tarde a la cita de la plaza. " * 2,
    "it": "Il testo della pagina è per tutti quelli che sono in città con noi e che non sono in ritardo per la cena di oggi. " * 2,
}


@pytest.mark.parametrize("lang", PROSE)
def test_html_without_telling_names(lang):
    p = PROSE[lang].strip()
    text = html_text.main_text
    menu = "".join(f"<div class='q{i}'>Menu{i}</div>" for i in range(4))
    links = "<div class='x'>" + "".join(f"<a href='{i}'>Item {i} of it</a> " for i in range(9)) + "</div>"
    notice = "<div class='z9'>Xyzzy plugh 2024 frobozz quux corge grault garply waldo fred plugh thud xyzzy barney wibble wobble</div>"
    # outside and inside of an article: menus by their labels and links, prose by its words
    assert text(f"{menu}{links}{notice}<article><h1>Title</h1><p>{p}</p>{menu}<p>{p}</p>{links}<p>Short end</p></article>{notice}{menu}") == f"Title\n{p}\n{p}\nShort end"
    # without an article: density alone
    assert text(f"{links}<div>{notice}</div><div>{p}</div><div>{p}</div><p>So.</p><div>{p}</div>{links}<div>Foo bar</div><div>Contact</div>") == f"{p}\n{p}\nSo.\n{p}"
    # a name that only hints: prose stays, labels go; a name that tells: both go
    assert text(f"<article><p>{p}</p><div class='related-work'><p>{p} {p}</p></div><div class='share'>Share it</div><section class='comments'><p>{p}</p></section></article>") == f"{p}\n{p} {p}"


def test_html_each_pass_counts(monkeypatch):
    p = PROSE["en"].strip()
    page = f"<div>Site of it</div><div><a href=x>Menu</a></div><div>{p}</div><p>so</p><div>{p}</div><div>Xyzzy plugh frobozz quux corge grault garply waldo fred plugh thud xyzzy barney wibble</div><p>end</p>"
    want = f"Site of it\n{p}\nso\n{p}"
    assert html_text.main_text(page) in (want, f"{p}\nso\n{p}")
    whole = html_text.main_text(page)
    with monkeypatch.context() as m:
        m.setattr(html_text, "second_pass", lambda found: None)
        assert html_text.main_text(page) == f"{p}\n{p}"
    with monkeypatch.context() as m:
        m.setattr(html_text, "decide", lambda block, share, scale: "")
        assert html_text.main_text(page) not in (whole, "")


def test_html_of_very_long_blocks(spark):
    p = PROSE["en"] * 20_000
    assert html_text.main_text(f"<article><p>{p}</p></article>") == " ".join(p.split())
    clash = html_text.extract(spark.createDataFrame([(1, "<p>x</p>", "y")], "page_id long, html string, TEXT string"))
    assert clash.columns == ["page_id", "text"]


def test_html_without_end_tags_is_no_prefix():
    prose = "This is the text of the page and it is for you and all of them."
    text = html_text.main_text
    body = f"<article><p>{prose}</p><p>{prose}</p></article>"
    both = f"{prose}\n{prose}"
    assert text(f"<head><title>T</title><body>{body}") == both
    assert text(f"<html><head><meta charset=x><title>T</title><link rel=y>{body}") == both
    assert text(f"<head><noscript><style>p{{}}</style></noscript><script>var x='<p>';</script></head><body>{body}") == both
    assert text(f"<title>T</title><head>{prose}") == prose
    for name in ("button", "option", "select", "svg", "canvas", "template", "noscript"):
        assert text(f"<article><p>{prose} <{name}>Share</p><p>{prose}</p></article>") == both
        assert text(f"<article><{name}>Share<p>{prose}</p><p>{prose}</p></article>") == both
        assert text(f"<article><p>{prose[:30]}<{name}><i>Share</i></{name}>{prose[30:]}</p><p>{prose}</p></article>") == both
    for name in ("math", "video", "audio", "object"):
        assert text(f"<article><p>{prose} <{name}>x</p><p>{prose}</p></article>") == f"{prose} x\n{prose}"
        assert text(f"<article><p>Be <{name}>x</{name}> so.</p></article>") == "Be x so."
    assert text("<article><p>If <math><mrow><mi>x</mi><mo>=</mo><mn>1</mn></mrow></math> then</p></article>") == "If x=1 then"
    assert text("<article><button><div>Share</div></button><select><option>a<option>b</select><embed src=x><p>the end</p></article>") == "the end"
    assert text(f"<article><p>{prose}</p><script>if (a) <p>{prose}") == prose


@needs_data
def test_html_of_given_pages(spark):
    import html
    import re

    rows = queries.op6_two_pass_html(spark, DATA).join(spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "html"), "page_id").collect()
    for r in rows:
        inner = re.search("<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub("</?b>|<br>", "", x)).split()) for x in re.split("</?(?:p|h1)>", inner)]
        assert r["text"] == "\n".join(x for x in parts if x) and r["n_chars"] == len(r["text"])


def test_html_on_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "t"), (2, "", "t"), (2, "", "t")], "page_id long, html string, text string").drop("text")
    assert sorted(tuple(r) for r in html_text.extract(df).collect()) == [(1, ""), (2, ""), (2, "")]
    assert html_text.extract(df.limit(0)).count() == 0


def member(kind, uri, block, **more):
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{uri}>\r\nWARC-Target-URI: {uri}\r\nWARC-Date: 2024-01-02T03:04:05Z\r\n" + "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in more.items()) + f"Content-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def test_warc_round_trip(spark, tmp_path):
    html = "<html><body><p>Grüße &amp; mehr</p><a href='/next'>n</a></body></html>".encode("latin-1")
    chunked = b"5\r\n" + html[:5] + b"\r\n" + f"{len(html) - 5:x}".encode() + b"\r\n" + html[5:] + b"\r\n0\r\n\r\n"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html;\r\n charset=iso-8859-1\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked
    packed = b"HTTP/1.1 404 Not Found\r\nContent-Type: text/plain\r\nContent-Encoding: gzip\r\n\r\n" + gzip.compress(b"plain <b>")
    raw = [member("warcinfo", "i", b"x"), member("response", "http://a/b", http, WARC_Payload_Digest="sha1:ABC"), member("request", "r", b"GET"), member("response", "http://a/c", packed)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, raw)) + gzip.compress(raw[1])[:-9])
    (tmp_path / "b.warc").write_bytes(b"".join(raw) + raw[1][:90])
    responses = warc.read_responses(spark, str(tmp_path / "*.warc*")).cache()
    assert responses.count() == 4 and {r["http_status"] for r in responses.collect()} == {200, 404}
    got = warc.derive(responses).collect()
    assert len(got) == 8
    by = {(r["target_uri"], r["record_type"]): r for r in got}
    text = by["http://a/b", "conversion"]
    assert bytes(text["block"]).decode() == "Grüße & mehr\nn" and text["payload_digest"] == "sha1:ABC" and text["refers_to"] == "<urn:uuid:http://a/b>" and text["refers_to_date"] == "2024-01-02T03:04:05Z"
    fields = bytes(by["http://a/b", "metadata"]["block"]).decode()
    assert "outlink: http://a/next" in fields and "http-header-content-type: text/html; charset=iso-8859-1" in fields
    assert bytes(by["http://a/c", "conversion"]["block"]) == b"plain <b>"
    for r in got:
        assert r["block_digest"] == "sha1:" + base64.b32encode(hashlib.sha1(bytes(r["block"])).digest()).decode() and r["content_length"] == len(r["block"])
    out = str(tmp_path / "out")
    warc.write_records(warc.derive(responses), out)
    back = [x for f in sorted(os.listdir(out)) for x in warc.parse(open(f"{out}/{f}", "rb").read())]
    assert sorted((h["warc-record-id"], b) for h, b in back) == sorted((r["record_id"], bytes(r["block"])) for r in got)
    with pytest.raises(ValueError):
        warc.write_records(warc.derive(responses), "s3://x/y")


def test_warc_reading_is_linear_and_streams(tmp_path):
    import time
    import tracemalloc

    r = random.Random(3)
    block = r.randbytes(60_000)
    one = [member("response", f"http://a/{i}", block) for i in range(8)]
    many = b"".join(gzip.compress(x, 1) for x in one) * 150  # 70 MB, 1,200 members
    start = time.time()
    assert sum(b == block for _, b in warc.parse(many)) == 1200 and time.time() - start < 30
    single = gzip.compress(b"".join(one) * 20, 1)  # all records in one member
    tracemalloc.start()
    assert sum(1 for _ in warc.parse(single)) == 160
    assert tracemalloc.get_traced_memory()[1] < 6_000_000
    tracemalloc.stop()
    assert sum(1 for _ in warc.parse(b"".join(one))) == 8 and sum(1 for _ in warc.parse(b"".join(one)[:-100])) == 7
    assert [len(b) for _, b in warc.parse(gzip.compress(member("response", "u", b"")) + b"junk")] == [0] and list(warc.parse(b"")) == []
    zeros = gzip.compress(member("response", "u", bytes(50_000_000)))
    assert [len(b) for _, b in warc.parse(zeros)] == [50_000_000]


def test_warc_on_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None), (2, "http://[bad", "<a href='http://[x'>q</a>"), (2, "u", ""), (2, "u", "")], "page_id long, url string, html string")
    got = warc.derive(warc.responses_of_pages(df), keep=["page_id"]).collect()
    assert len(got) == 8 and all(r["refers_to"].startswith("<urn:uuid:") for r in got)
    assert warc.derive(warc.responses_of_pages(df.limit(0))).count() == 0
    bare = spark.createDataFrame([(None, None, None, None, None, None, None)], warc.RESPONSES)
    assert warc.derive(bare).count() == 2


def test_licences(spark):
    mit = "Copyright (c) 2020-2024 Some Body. All rights reserved.\r\n\r\n" + licences.MIT.replace("sublicense", "sub-license").replace("Software", "SOFTWARE").replace("\n", "\r\n")
    rows = [(1, mit), (2, "The MIT License (MIT)\n\n(C) 1999 X\n" + licences.MIT), (3, licences.MIT + " more"), (4, "prose\nReleased under the MIT License.\nlicensed under CC BY-NC 4.0"), (5, None), (6, "!?"), (6, "!?"), (None, licences.ISC)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("licence_id_old", F.lit(1))
    got = sorted(((r["doc_id"] or 0, r["licence_id"], r["stated_licences"]) for r in licences.scan(df).collect()), key=repr)
    assert got == sorted([(1, "MIT", []), (2, "MIT", []), (3, None, []), (4, None, ["CC-BY-NC-4.0", "MIT"]), (5, None, []), (6, None, []), (6, None, []), (0, "ISC", [])], key=repr)
    assert licences.scan(df.limit(0)).count() == 0
    plan = licences.scan(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "BroadcastHashJoin" in plan
    digests = [r["known_digest"] for r in licences.known(spark).collect()]
    assert len(digests) == len(licences.KNOWN)


def test_spellings_of_neighbouring_words(spark):
    rows = ["the licence licence of the licence", "Non-commercial non commercial, sub-licence; sub license", "per cent per cent", "non", "commercial"]
    got = [r["c"] for r in spark.createDataFrame([(x,) for x in rows], "t string").select(licences.canonical(licences.F.col("t")).alias("c")).collect()]
    assert got == ["the license license of the license", "noncommercial noncommercial sublicense sublicense", "percent percent", "non", "commercial"]
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    assert [con.execute(f"SELECT {licences.canonical_sql('t')} FROM (SELECT CAST(? AS VARCHAR) AS t)", [x]).fetchone()[0] for x in [*rows, "", "!?", None]] == [*got, "", "", None]


def test_licences_with_marks_between_words(spark):
    lines = ["Released under CC BY 4.0", "Released  under CC BY 4.0", "Released\tunder the CC BY 4.0.", "**Released** under CC BY 4.0", "* Available -- under: the CC BY 4.0", "_Distributed_ under the CC BY 4.0", "RELEASED, under, CC-BY 4.0", "released, but under no licence"]
    got = {r["i"]: r["stated_licences"] for r in licences.scan(spark.createDataFrame(list(enumerate(lines)), "i long, text string")).collect()}
    assert got == {i: ["CC-BY-4.0"] if i < 7 else [] for i in range(8)}


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="no licence texts")
def test_long_licences(spark):
    files = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0"}
    body = {f: open(f"/usr/share/common-licenses/{f}").read() for f in files}
    rows = [(i, t) for f, i in files.items() for t in (body[f], body[f].replace("\n", "\r\n"), body[f] + " more")] + [("MPL-2.0", " ".join(body["MPL-2.0"].upper().split()))]
    got = licences.scan(spark.createDataFrame(rows, "want string, text string")).collect()
    assert all((r["licence_id"] == r["want"]) == (not r["text"].endswith(" more")) for r in got) and len(got) == 19


@needs_data
def test_licences_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = sorted(con.sql(queries.oracle_sql()["op5_licence_digests"]).fetchall(), key=repr)
    got = queries.op5_licence_digests(spark, DATA)
    assert sorted(map(tuple, got.select("doc_id", "canonical_digest", "licence_id", "stated_licences").collect()), key=repr) == want and len({r[3] for r in want}) > 1


@needs_data
def test_pipeline_stages(spark):
    import corpus_pipeline as p

    documents = spark.read.parquet(f"{DATA}/documents.parquet")
    docs, names = documents, [n for n, _ in p.STAGES]
    assert names == ["quality_rules", "toxicity", "near_duplicates", "decontamination", "packing"]
    sizes = [docs.count()]
    for name, stage in p.STAGES[:-1]:
        docs = p.written(stage(spark, docs, DATA), name)
        assert docs.columns == documents.columns
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    ids = {r["doc_id"] for r in docs.collect()}
    packed = p.STAGES[-1][1](spark, docs, DATA).collect()
    assert {r["doc_id"] for r in packed} == ids
    # no benchmark phrase is left, and no near-duplicates
    from orbitweave.llm import decontaminate, near_dups

    assert decontaminate.scan(docs, spark.read.parquet(f"{DATA}/benchmark.parquet")).where(F.size("spans") > 0).count() == 0
    assert sorted(map(tuple, p.run(spark, DATA).select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in packed)
    assert near_dups.near_duplicates(documents).count() == documents.count()


@needs_data
def test_pipeline_on_odd_documents(spark, tmp_path):
    import corpus_pipeline as p

    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    good = spark.read.parquet(f"{DATA}/documents.parquet").limit(30)
    rows = [(None, None, None, None, None), (1_000_000, None, "en", "s", 0), (1_000_001, "", "en", "s", 0), (1_000_002, None, None, None, None)]
    odd = good.unionByName(good.limit(5)).unionByName(spark.createDataFrame(rows, good.schema)).withColumns({"kept": F.lit(1), "n_words": F.lit("x"), "spans": F.lit(0), "toxic_score": F.lit(None).cast("int")})
    for docs in (odd, odd.limit(0)):
        for name, stage in p.STAGES[:-1]:
            docs = p.written(stage(spark, docs, str(tmp_path)), name)
            assert docs.columns == odd.columns
        assert p.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= docs.count()


def test_markup_names_that_are_taken(spark):
    docs = spark.createDataFrame([(1, "Licensed under the MIT License", "mine", "own", "x")], "doc_id long, text string, licence_id string, Stated_Licences string, known_digest string")
    got = licences.scan(docs)
    assert got.columns == ["doc_id", "text", "known_digest", "canonical_digest", "licence_id", "stated_licences"] and got.first()["known_digest"] == "x"
    pages = spark.createDataFrame([(1, "http://a/b", "<p>x</p>")], "page_id long, url string, html string")
    records = warc.derive(warc.responses_of_pages(pages), keep=["page_id", "target_uri", "PAYLOAD_digest", "date"])
    assert records.count() == 2 and len({c.lower() for c in records.columns}) == len(records.columns)
