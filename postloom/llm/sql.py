"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from postloom.llm.secrets import BASE_RULES, RULES

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TOKENS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, {_TOKENS} AS ws FROM documents),
b AS (SELECT item_id, {_TOKENS} AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(list_slice(ws, i, i + least(len(ws), 10) - 1), ' ') AS k FROM b, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) t(i) WHERE len(ws) > 0),
dw AS (SELECT doc_id, n, i, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS k FROM d, (SELECT DISTINCT n FROM iw) m, unnest(range(1, len(ws) - n + 2)) t(i)),
found AS (SELECT doc_id, n, i, item_id FROM dw JOIN iw USING (n, k)),
hit AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM found, unnest(range(0, n)) r(j) GROUP BY 1),
items AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM found GROUP BY 1)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(ids), 0) AS n_items, sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""


def _escaped(c: str) -> str:
    for first, rest in (("[", "INST]"), ("[", "/INST]"), ("<", "/s>")):
        c = rf"regexp_replace({c}, '\{first}(\\*){rest.replace(']', chr(92) + ']')}', '{first}\\\1{rest}', 'g')"
    return c


CHATS = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) t(i)),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said, coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS learnt, sum(17 + length({_escaped('role')}) + length({_escaped('text')}))::BIGINT AS formatted_chars, list(role ORDER BY turn, role, text) AS rs FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(learnt) AS loss_chars, sha256(learnt) AS loss_sha256, formatted_chars,
list_contains(['system', 'user'], rs[1]) AND rs[len(rs)] = 'assistant' AND len(list_filter(range(1, len(rs)), lambda i: NOT list_contains(['system>user', 'user>assistant', 'assistant>user'], rs[i] || '>' || rs[i + 1]))) = 0 AS valid FROM g"""

NEAR = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 2), ' ') AS k FROM d, unnest(range(1, greatest(len(ws) - 1, 2))) t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT DISTINCT a AS x, a AS y FROM e UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a),
m AS (SELECT x, min(y) AS c FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.c, d.doc_id) AS component_id, coalesce(m.c, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.x = d.doc_id"""

SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 12), ' ') AS k FROM d, unnest(range(1, len(ws) - 11)) t(i)),
f AS (SELECT k, min(doc_id) AS first FROM w GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + j AS spot FROM w JOIN f USING (k), range(13) r(j) WHERE doc_id > first),
x AS (SELECT doc_id, spot, ws[spot] AS word FROM d, unnest(range(1, len(ws) + 1)) t(spot)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY spot) AS t FROM x ANTI JOIN gone USING (doc_id, spot) GROUP BY 1)
SELECT d.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""


def _spans(rank: int) -> str:
    r = RULES[rank]
    p = "'" + r.pattern.replace("'", "''") + "'"
    parts = f"string_split_regex(t, {p})", f"regexp_extract_all(t, {p}, 0)", f"regexp_extract_all(t, {p}, {r.group})"
    return (
        f"SELECT doc_id, {rank} AS rank, '{r.kind}' AS kind, coalesce(list_sum(list_transform(list_slice(gaps, 1, i), lambda g: length(g))), 0)::BIGINT + coalesce(list_sum(list_transform(list_slice(hits, 1, i - 1), lambda g: length(g))), 0)::BIGINT AS start, length(hits[i]) AS n "
        f"FROM (SELECT doc_id, {parts[0]} AS gaps, {parts[1]} AS hits, {parts[2]} AS part FROM t), unnest(range(1, len(hits) + 1)) u(i) WHERE length(part[i]) >= {r.least}"
    )


SECRETS = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({' UNION ALL '.join(map(_spans, range(len(RULES))))}),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS b, count(*) FILTER (kind = 'hex') AS c, string_agg(kind || ':' || start || ':' || (start + n), ',' ORDER BY start, rank) AS spans, string_agg(kind || ':' || start || ':' || (start + n), ',' ORDER BY start, rank) FILTER (rank < {len(BASE_RULES)}) AS base FROM s GROUP BY 1)
SELECT t.doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN g USING (doc_id)"""

_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"
_SHARE = "(1 + 1000000000::HUGEINT * ({} + 5) // ({} + 5 * v))::BIGINT"

DIVERGENCE = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_TERMS} AS ts FROM documents),
t AS MATERIALIZED (SELECT lang, source, r, unnest(ts) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term, count(*) AS total FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
gn AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {_SHARE.format('coalesce(c.n, 0)', 'coalesce(gn.n, 0)')} AS p, {_SHARE.format('k.total', 'v.n')} AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN gn ON gn.lang = g.lang AND gn.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
every AS (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM every QUALIFY part = 'pair' OR rank <= 50"""


def _clusters(k: int = 8, rounds: int = 10) -> str:
    gap = "list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    steps = [
        "x AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)",
        "e AS MATERIALIZED (SELECT r, unnest(range(1, 65)) AS i, unnest(v) AS x FROM x)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS c, v FROM (SELECT sha256('3:' || vec_id) AS h, v FROM x ORDER BY h NULLS LAST, v LIMIT {k}))",
    ]
    for t in range(rounds + 1):
        steps.append(f"a{t} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT x.r, c.c, {gap} AS d FROM x, c{t} c) GROUP BY r)")
        if t < rounds:
            steps.append(f"m{t} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i)::BIGINT[] AS v FROM (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM a{t} JOIN e USING (r) GROUP BY c, i) GROUP BY c)")
            steps.append(f"c{t + 1} AS MATERIALIZED (SELECT c, coalesce(m.v, o.v) AS v FROM c{t} o LEFT JOIN m{t} m USING (c))")
    return f"WITH {', '.join(steps)} SELECT vec_id, c::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(o.v, ',')) AS centroid_sha256 FROM a{rounds} JOIN x USING (r) JOIN c{rounds} o USING (c)"


def _base32(hex_digits: str) -> str:
    """Of 40 hexadecimal digits: five of them are four letters."""
    letter = lambda i, s: f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr({hex_digits}, {5 * i + 1}, 5))::INTEGER >> {s} & 31) + 1, 1)"
    return " || ".join(letter(i, s) for i in range(8) for s in (15, 10, 5, 0))


ARCHIVES = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT t, max(page_id) AS m FROM p GROUP BY t)
SELECT page_id, strlen(t)::BIGINT AS payload_bytes, {_base32('h')} AS payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM m THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS DISTINCT FROM m THEN m END AS refers_to FROM p JOIN g USING (t)"""

SQL = {"op11_divergence": DIVERGENCE, "op12_clusters": _clusters(), "op13_warc": ARCHIVES, "op2_decontaminate": DECONTAMINATE, "op4_chat_format": CHATS, "op7_near_dedup": NEAR, "op9_substring_dedup": SUBSTRINGS, "op10_secrets": SECRETS}
