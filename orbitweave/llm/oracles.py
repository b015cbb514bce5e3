"""DuckDB SQL of the training-data queries that SQL can express."""

from __future__ import annotations

import string

from orbitweave.llm import licences, link_trust, sharding

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase


def words(table: str, key: str, pattern: str) -> str:
    """(key, w): the lower-cased words of whole texts of a table as a list; null texts have none."""
    return f"SELECT {key}, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{pattern}'), []) AS w FROM {table}"


def windows(source: str, key: str, n: int) -> str:
    """(key, i, ahead): from each word of source's lists the next n words, itself included."""
    return f"""SELECT {key}, i, list(word) OVER (PARTITION BY {key} ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) AS ahead
 FROM (SELECT {key}, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM {source})"""


def decontamination(window: int = 10) -> str:
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""
WITH d AS ({words('documents', 'doc_id', pattern)}), b AS ({words('benchmark', 'item_id', pattern)}),
bw AS ({windows('b', 'item_id', window)}),
phrase AS (SELECT DISTINCT item_id, l, array_to_string(ahead, ' ') AS p FROM (SELECT bw.*, least({window}, len(b.w)) AS l FROM bw JOIN b USING (item_id)) WHERE len(ahead) = l),
dw AS ({windows('d', 'doc_id', window)}),
dp AS MATERIALIZED (SELECT doc_id, i, l, array_to_string(ahead[1:l], ' ') AS p FROM dw, (SELECT DISTINCT l FROM phrase) WHERE len(ahead) >= l),
hit AS (SELECT doc_id, i, l, item_id FROM dp JOIN phrase USING (l, p)),
n AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS k FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN items USING (doc_id)"""


def near_duplicates(n: int = 3, percent: int = 85) -> str:
    pattern = r"[^\x20\x09-\x0D]+"
    return f"""
WITH RECURSIVE d AS ({words('documents', 'doc_id', pattern)}), dw AS ({windows('d', 'doc_id', n)}),
s AS (SELECT DISTINCT doc_id, array_to_string(ahead, ' ') AS shingle FROM dw JOIN d USING (doc_id) WHERE len(ahead) = least({n}, len(w)) AND (len(w) >= {n} OR i = 1)),
size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * c >= {percent} * (p.n + q.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
SELECT r.a AS doc_id, coalesce(max(n), 0) AS n_shingles, min(r.b) AS component_id, r.a = min(r.b) AS kept FROM reach r LEFT JOIN size ON size.doc_id = r.a GROUP BY r.a"""


def crc_table() -> list[int]:
    """The table of CRC-32: each byte run through its polynomial."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


def crc32(h: str) -> str:
    """CRC-32 of bytes that column h has in hexadecimal digits."""
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length({h}) // 2), lambda i: ('0x' || substring({h}, 2 * i + 1, 2))::BIGINT)),
 lambda c, x: xor(c >> 8, ({crc_table()}::BIGINT[])[(xor(c, x) & 255) + 1])))"""


def shards(n: int) -> str:
    crc = crc32("h")
    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS key, hex(encode(coalesce(text, ''))) AS h FROM documents),
won AS (SELECT r, arg_max(k, (u, -k)) FILTER (k < {n}) AS shard, arg_max(k, (u, -k)) AS grown_shard FROM (SELECT r, k, substring(md5(k || ':' || key), 1, 13) AS u FROM t, range({n + 1}) x(k)) GROUP BY r),
s AS (SELECT t.*, shard, grown_shard, length(h) // 2 + 16 AS size, {crc} AS text_crc32, ('0x' || substring(md5(key), 1, 8))::BIGINT % (SELECT greatest({sharding.BUCKETS}, count(*) // {sharding.RANGE}) FROM documents) AS bucket FROM t JOIN won USING (r))
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard, row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id, size, text_crc32) - 1 AS slot, grown_shard::INT AS grown_shard FROM s"""


def importance(percent: int = 10, least: int = 20, buckets: int = 10_000, seed: str = "2024") -> str:
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""
WITH d AS ({words('(SELECT row_number() OVER () AS r, text FROM documents)', 'r', pattern)}), b AS ({words('benchmark', 'item_id', pattern)}),
dw AS (SELECT r, unnest(w) AS word FROM d), bw AS (SELECT unnest(w) AS word FROM b),
code AS MATERIALIZED (SELECT word, {crc32('h')} % {buckets} AS bucket FROM (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM dw UNION SELECT word FROM bw))),
n AS (SELECT k AS bucket, coalesce(s, 0)::DOUBLE AS s, coalesce(t, 0)::DOUBLE AS t FROM range({buckets}) x(k)
 LEFT JOIN (SELECT bucket, count(*) AS s FROM dw JOIN code USING (word) GROUP BY bucket) ds ON ds.bucket = k
 LEFT JOIN (SELECT bucket, count(*) AS t FROM bw JOIN code USING (word) GROUP BY bucket) bt ON bt.bucket = k),
gain AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM n) + {buckets}) / ((s + 1) * ((SELECT sum(t) FROM n) + {buckets}))))::BIGINT AS g FROM n),
f AS (SELECT r, count(*) AS n_features, sum(g)::BIGINT AS total FROM dw JOIN code USING (word) JOIN gain USING (bucket) GROUP BY r),
s AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, CASE WHEN n_features > 0 THEN (total - ((total % n_features) + n_features) % n_features) // n_features ELSE 0 END AS weight,
  floor(-1000 * ln(-ln((('0x' || substring(sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT + 0.5E0) / 4294967296.0E0)))::BIGINT AS noise
 FROM (SELECT row_number() OVER () AS r, doc_id FROM documents) LEFT JOIN f USING (r)),
o AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {least} ORDER BY weight + noise DESC, doc_id) AS k, count(*) OVER (PARTITION BY n_features >= {least}) AS fitting FROM s)
SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN n_features >= {least} AND k <= {percent} * fitting // 100 THEN k END AS rank FROM o"""


def link_verdicts(rounds: int = 12) -> str:
    def longest(what: str) -> str:
        """The rules one by one, the longest first."""
        cases = []
        for kind, rule in sorted(link_trust.RULES, key=lambda x: -len(x[1])):
            of, _, start = rule.partition("/")
            cases.append(f"WHEN (host = '{of}' OR ends_with(host, '.{of}')) AND starts_with(path, '/{start}') THEN '{rule if what == 'rule' else kind}'")
        return f"CASE {' '.join(cases)} END"

    num, den = link_trust.DAMPING
    link = link_trust.LINK.replace("'", "''")
    step = f"""m{{k}} AS MATERIALIZED (SELECT kind, host, sum(mass)::BIGINT AS mass FROM (SELECT kind, host, mass FROM m0 UNION ALL
 SELECT e.kind, e.b, (m.mass * {num} // ({den} * o.n)) * e.w FROM m{{j}} m JOIN e ON e.kind = m.kind AND e.a = m.host JOIN o ON o.kind = e.kind AND o.a = e.a) GROUP BY ALL)"""
    return f"""
WITH u AS (SELECT page_id, html, CASE WHEN contains(url, '://') THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, html, translate(regexp_extract(rest, '(?s)^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM u),
j AS MATERIALIZED (SELECT *, {longest('rule')} AS rule, {longest('verdict')} AS ruled FROM p),
h AS (SELECT host, count(*) AS n, count(*) FILTER (ruled = 'allow') AS a, count(*) FILTER (ruled = 'block') AS b FROM j WHERE host <> '' GROUP BY host),
l AS (SELECT host AS a, unnest(list_distinct(list_transform(regexp_extract_all(html, '{link}', 1), lambda x: translate(x, '{UPPER}', '{LOWER}')))) AS b FROM j WHERE host <> ''),
x AS (SELECT host, string_split(host, '.') AS s FROM h),
up AS (SELECT DISTINCT a, b FROM (SELECT unnest(list_transform(range(1, len(s)), lambda k: {{'a': array_to_string(s[k:], '.'), 'b': array_to_string(s[k + 1:], '.')}}), recursive := true) FROM x) WHERE contains(b, '.')),
edge AS (SELECT a, b, sum(w)::BIGINT AS w FROM (SELECT a, b, count(*) AS w FROM l WHERE a <> b GROUP BY ALL UNION ALL SELECT a, b, 1 FROM up UNION ALL SELECT b, a, 1 FROM up) GROUP BY ALL),
e AS MATERIALIZED (SELECT 0 AS kind, a, b, w FROM edge UNION ALL SELECT 1, b, a, w FROM edge),
o AS MATERIALIZED (SELECT kind, a, sum(w)::BIGINT AS n FROM e GROUP BY ALL),
m0 AS MATERIALIZED (SELECT 0 AS kind, host, {link_trust.UNIT} * a // n AS mass FROM h UNION ALL SELECT 1, host, {link_trust.UNIT} * b // n FROM h),
{', '.join(step.format(k=k, j=k - 1) for k in range(1, rounds + 1))},
t AS (SELECT host, coalesce(sum(mass) FILTER (kind = 0), 0)::BIGINT AS trust, coalesce(sum(mass) FILTER (kind = 1), 0)::BIGINT AS distrust FROM m{rounds} GROUP BY host)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN distrust > trust THEN 'block' ELSE 'allow' END) AS verdict, coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust FROM j LEFT JOIN t USING (host)"""


def source_audit(least_docs: int = 10, top: int = 10) -> str:
    pattern = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
    share = "1 + (1000000000::HUGEINT * ({c} + 2)) // ({n} + 2 * v)"
    gap = "((p - q) * (p - q)) // (p + q)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{pattern}')) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= {least_docs}),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
gt AS MATERIALIZED (SELECT lang, source, coalesce(v, 0) AS v, coalesce(l.total, 0) AS lang_total, coalesce(t.total, 0) AS total FROM g LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) t USING (lang, source) LEFT JOIN l USING (lang)),
s AS MATERIALIZED (SELECT gt.lang, gt.source, k.term, coalesce(c.n, 0) AS n, {share.format(c='coalesce(c.n, 0)', n='gt.total')} AS p, {share.format(c='k.n', n='gt.lang_total')} AS q
 FROM gt JOIN k ON k.lang = gt.lang LEFT JOIN c ON c.lang = gt.lang AND c.source = gt.source AND c.term = k.term),
pair AS (SELECT lang, source, item, sum({gap}) AS value FROM (SELECT a.lang, a.source, b.source AS item, a.p, b.p AS q FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source) GROUP BY ALL),
found AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pair.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
 UNION ALL SELECT lang, source, 'term', term, ({gap})::BIGINT FROM s WHERE n > 0 AND p > q)
SELECT * FROM (SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)))::INT AS rank FROM found) WHERE part = 'pair' OR rank <= {top}"""


def all_sql(n_shards: int) -> dict[str, str]:
    return {
        "op3_fm_index_decontamination": decontamination(),
        "op5_licence_digests": licences.oracle_sql(),
        "op9_odd_sketch_near_dups": near_duplicates(),
        "op10_rendezvous_shards": shards(n_shards),
        "op11_importance_resampling": importance(),
        "op12_link_trust": link_verdicts(),
        "op13_source_audit": source_audit(),
    }
