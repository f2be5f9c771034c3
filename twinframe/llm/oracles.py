"""DuckDB SQL for the queries of this subpackage whose results SQL can express, written from their contracts."""

from __future__ import annotations

#: Words are what stands between the six ASCII blanks.
_WORD = r"[^\x20\x09-\x0D]+"
_STATED = {"symbols": ("n_symbols", 1000), "marks": ("n_marks", 1000), "dup_lines": ("n_dup_lines", 1000), "length": ("word_chars", 100)}


def quality(shrink: int = 24, spreads: int = 8) -> str:
    """Counts and limits of op2: exact quantiles of values cut to their first seven binary digits."""
    points = (10, 25, 50, 75)
    cut = "(v >> greatest(length(bin(v)) - 7, 0)) << greatest(length(bin(v)) - 7, 0)"
    values = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, {k} * {c} // n_words AS v FROM good" for m, (c, k) in _STATED.items())
    quantile = lambda by: f"SELECT {by}, max(total) AS total, " + ", ".join(f"min(b) FILTER (100 * upto >= {p} * total) AS q{p}" for p in points) + f" FROM (SELECT {by}, b, sum(count(*)) OVER (PARTITION BY {by} ORDER BY b) AS upto, sum(count(*)) OVER (PARTITION BY {by}) AS total FROM cut GROUP BY {by}, b) GROUP BY {by}"
    mix = lambda a, b, n: f"CAST(floor((CAST({n} AS DOUBLE) * {n} * {n} * {a} + {shrink ** 3} * {b}) / (CAST({n} AS DOUBLE) * {n} * {n} + {shrink ** 3})) AS BIGINT)"
    wide = ", ".join(f"CASE WHEN metric IN ('length', 'words') THEN l.q{p} ELSE {mix(f'l.q{p}', f'a.q{p}', 'l.total')} END AS q{p}" for p in points)
    drawn = ", ".join(f"{mix(f'g.q{p}', f'w.q{p}', 'g.total')} AS q{p}" for p in points)
    at = lambda m, p: f"max(q{p}) FILTER (metric = '{m}')"
    one = lambda m: f"{spreads} * {at('length', 50) if m == 'length' else _STATED[m][1]} // {at('words', 10)}"
    limits = ", ".join(f"{at(m, 75)} + {at(m, 75)} // 64 + {spreads} * ({at(m, 75)} - {at(m, 50)}) + {one(m)} AS {m}_max" for m in _STATED)
    passed = " AND ".join(f"{k} * {c} // n_words <= {m}_max" for m, (c, k) in _STATED.items())
    return rf"""WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, COALESCE(text, '') AS text FROM documents),
words AS (SELECT rid, w, row_number() OVER (PARTITION BY rid ORDER BY i) AS i FROM (SELECT rid, unnest(regexp_extract_all(text, '{_WORD}')) AS w, generate_subscripts(regexp_extract_all(text, '{_WORD}'), 1) AS i FROM docs)),
windows AS (SELECT rid, i, w || chr(32) || lead(w, 1) OVER o || chr(32) || lead(w, 2) OVER o || chr(32) || lead(w, 3) OVER o || chr(32) || lead(w, 4) OVER o AS five FROM words WINDOW o AS (PARTITION BY rid ORDER BY i)),
twice AS (SELECT rid, i, COALESCE(five IS NOT NULL AND count(*) OVER (PARTITION BY rid, five) > 1, false) AS t FROM windows),
repeated AS (SELECT rid, count(*) FILTER (r) AS n FROM (SELECT rid, bool_or(t) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS r FROM twice) GROUP BY rid),
lines AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '{_WORD}') GROUP BY rid),
counted AS (SELECT rid, doc_id, lang, source, CAST(len(regexp_extract_all(text, '{_WORD}')) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(COALESCE(l.n, 0) AS BIGINT) AS n_dup_lines, CAST(COALESCE(r.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(regexp_extract_all(text, '!')) AS BIGINT) AS n_marks
  FROM docs LEFT JOIN lines l USING (rid) LEFT JOIN repeated r USING (rid)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted),
good AS (SELECT * FROM judged WHERE NOT base_failed),
cut AS (SELECT lang, source, metric, {cut} AS b FROM ({values} UNION ALL SELECT lang, source, 'words', n_words FROM good)),
own AS ({quantile("lang, source, metric")}), langs AS ({quantile("lang, metric")}), everything AS ({quantile("metric")}),
wide AS (SELECT l.lang, metric, {wide} FROM langs l JOIN everything a USING (metric)),
drawn AS (SELECT g.lang, g.source, g.metric, {drawn} FROM own g JOIN wide w ON g.metric = w.metric AND g.lang IS NOT DISTINCT FROM w.lang),
limits AS (SELECT lang, source, {limits}, {at("length", 25)} - {spreads} * ({at("length", 50)} - {at("length", 25)}) - {one("length")} AS length_min FROM drawn GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_marks,
  CASE WHEN base_failed THEN false ELSE COALESCE({passed} AND 100 * word_chars // n_words >= length_min, true) END AS kept
FROM judged j LEFT JOIN limits m ON j.lang IS NOT DISTINCT FROM m.lang AND j.source IS NOT DISTINCT FROM m.source"""


def vectors(least: float = 0.95) -> str:
    """All pairs of op4, and what their links reach."""
    return f"""WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= {least}),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a), low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT vec_id, CAST(COALESCE(n.n, 0) AS BIGINT) AS n_links, least(vec_id, COALESCE(low.b, vec_id)) AS component_id, vec_id IS NOT DISTINCT FROM least(vec_id, COALESCE(low.b, vec_id)) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN low ON low.a = vec_id"""


def archives(least_bytes: int = 0) -> str:
    """Rows of op5; five hexadecimal digits of a SHA-1 are four letters in base 32."""
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
    four = " || ".join(f"substr({letters}, CAST((n >> {shift}) & 31 AS INT) + 1, 1)" for shift in (15, 10, 5, 0))
    return f"""WITH p AS (SELECT page_id, url, encode(COALESCE(html, '')) AS payload, sha1(COALESCE(html, '')) AS h FROM pages),
parts AS (SELECT h, i, CAST('0x' || substr(h, 5 * i + 1, 5) AS BIGINT) AS n FROM (SELECT DISTINCT h FROM p) CROSS JOIN range(8) r(i)),
names AS (SELECT h, string_agg({four}, '' ORDER BY i) AS digest FROM parts GROUP BY h),
last AS (SELECT payload, max(page_id) AS last FROM p WHERE octet_length(payload) >= {least_bytes} GROUP BY payload)
SELECT page_id, url, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to
FROM p JOIN names USING (h) LEFT JOIN last USING (payload)"""


def shards(limit: int, bits: int = 48) -> str:
    """Rows of op6: for each document, the shortest prefix of its hash under which all documents fit."""
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, CAST(COALESCE(strlen(text), 0) AS BIGINT) AS n_bytes, CAST('0x' || substr(md5(COALESCE(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS h FROM documents),
p AS (SELECT rid, depth, h >> ({bits} - depth) AS shard, n_bytes FROM d CROSS JOIN range({bits + 1}) r(depth)),
s AS (SELECT depth, shard, sum(n_bytes) AS b, count(*) AS k FROM p GROUP BY 1, 2),
best AS (SELECT rid, arg_min(struct_pack(depth := depth, shard := shard, b := b), depth) AS s FROM p JOIN s USING (depth, shard) WHERE b <= {limit} OR k = 1 OR depth = {bits} GROUP BY rid)
SELECT doc_id, n_bytes, CASE WHEN s.depth = 0 THEN '' ELSE lpad(bin(s.shard), CAST(s.depth AS INT), '0') END AS shard, CAST(s.depth AS INT) AS depth, CAST(s.b AS BIGINT) AS shard_bytes, CAST(0 AS BIGINT) AS page FROM d JOIN best USING (rid)"""


def near_copies(k: int = 3, percent: int = 85) -> str:
    """Rows of op10: whole sets of shingles, all pairs that share one, and what their links reach; equal sets are compared once."""
    shingle = " || chr(32) || ".join(["w", *(f"lead(w, {i}) OVER o" for i in range(1, k))])
    return rf"""WITH RECURSIVE words AS (SELECT doc_id, w, i FROM (SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS l FROM documents WHERE text IS NOT NULL))),
rows AS (SELECT doc_id, {shingle} AS s, count(*) OVER (PARTITION BY doc_id) AS n, i FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
sets AS (SELECT DISTINCT doc_id, s FROM rows WHERE s IS NOT NULL UNION SELECT doc_id, string_agg(w, chr(32) ORDER BY i) FROM words GROUP BY doc_id HAVING count(*) < {k}),
sizes AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS fp FROM sets GROUP BY doc_id),
classes AS (SELECT fp, min(doc_id) AS cid, any_value(n) AS n FROM sizes GROUP BY fp),
own AS (SELECT c.cid, c.n, s.s FROM classes c JOIN sets s ON s.doc_id = c.cid),
links AS (SELECT a.cid AS a, b.cid AS b FROM own a JOIN own b ON a.s = b.s AND a.cid <> b.cid AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n) GROUP BY a.cid, b.cid, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT cid, least(cid, COALESCE(min(b), cid)) AS component FROM classes LEFT JOIN reach ON a = cid GROUP BY cid)
SELECT doc_id, CAST(COALESCE(z.n, 0) AS BIGINT) AS n_shingles, COALESCE(component, doc_id) AS component_id, doc_id = COALESCE(component, doc_id) AS kept
FROM documents LEFT JOIN sizes z USING (doc_id) LEFT JOIN classes USING (fp) LEFT JOIN low USING (cid)"""


def phrases(top: int = 2000, least: int = 10, share: int = 50) -> str:
    """Rows of op11: every phrase counted, every cut scored."""
    plain = "translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    exact = lambda a, l, r: f"1000000 * CAST({a} AS HUGEINT) * {a} // (CAST({l} AS HUGEINT) * {r})"
    return rf"""WITH pieces AS (SELECT row_number() OVER () AS rid, lang, piece FROM (SELECT COALESCE(lang, 'und') AS lang, unnest(string_split_regex({plain}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
words AS (SELECT rid, lang, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (SELECT rid, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS l FROM pieces)),
following AS (SELECT lang, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM words WINDOW o AS (PARTITION BY rid ORDER BY i)),
totals AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
f1 AS (SELECT lang, w, count(*) AS c FROM words GROUP BY ALL HAVING count(*) >= {least}),
f2 AS (SELECT lang, w, w2, count(*) AS c FROM following WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= {least}),
f3 AS (SELECT lang, w, w2, w3, count(*) AS c FROM following WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= {least}),
two AS (SELECT p.lang, p.w || ' ' || p.w2 AS phrase, p.c AS a, x.c AS l, y.c AS r, {exact("p.c", "x.c", "y.c")} AS score FROM f2 p JOIN f1 x ON x.lang = p.lang AND x.w = p.w JOIN f1 y ON y.lang = p.lang AND y.w = p.w2
  WHERE NOT EXISTS (SELECT 1 FROM f3 t WHERE t.lang = p.lang AND 100 * t.c >= {share} * p.c AND ((t.w = p.w AND t.w2 = p.w2) OR (t.w2 = p.w AND t.w3 = p.w2)))),
cuts AS (SELECT t.lang, t.w || ' ' || t.w2 || ' ' || t.w3 AS phrase, t.c AS a, x.c AS l1, yz.c AS r1, xy.c AS l2, z.c AS r2, {exact("t.c", "x.c", "yz.c")} AS s1, {exact("t.c", "xy.c", "z.c")} AS s2 FROM f3 t JOIN f1 x ON x.lang = t.lang AND x.w = t.w
  JOIN f2 yz ON yz.lang = t.lang AND yz.w = t.w2 AND yz.w2 = t.w3 JOIN f2 xy ON xy.lang = t.lang AND xy.w = t.w AND xy.w2 = t.w2 JOIN f1 z ON z.lang = t.lang AND z.w = t.w3),
every AS (SELECT * FROM two UNION ALL SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM cuts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM every)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN totals USING (lang) WHERE rank <= {top}"""


def chats() -> str:
    """Rows of op12: digests of the source, which reading back has to give; lengths of what is written, escaped where the plain form is misread."""
    tail = r"(/?INST\]|/?ROLE[=\]]|/?s>|</?SYS>>)"
    escaped = rf"regexp_replace(text, '([\[<])(\\*){tail}', '\1\2\\\3', 'g')"
    turn = lambda t: f"CASE role WHEN 'user' THEN '[INST] ' || {t} || ' [/INST]' WHEN 'system' THEN '<<SYS>> ' || {t} || ' <</SYS>>' WHEN 'assistant' THEN {t} || '</s>' ELSE '[ROLE=' || replace(url_encode(role), '%20', '+') || '] ' || {t} || ' [/ROLE]' END"
    order = "ORDER BY turn NULLS FIRST, role, text"
    form = r"(?s)(?:\[INST\] .*? \[/INST\]|<<SYS>> .*? <</SYS>>|\[ROLE=[^\]]*\] .*? \[/ROLE\]|.*?</s>)"
    inside = rf"regexp_replace(regexp_extract(p, '(?s)^(?:\[INST\] (.*) \[/INST\]|<<SYS>> (.*) <</SYS>>|\[ROLE=[^\]]*\] (.*) \[/ROLE\]|(.*)</s>)$', GROUP), '([\[<])\\(\\*){tail}', '\1\2\3', 'g')"
    text = f"CASE WHEN p LIKE '[INST] % [/INST]' THEN {inside.replace('GROUP', '1')} WHEN p LIKE '<<SYS>> % <</SYS>>' THEN {inside.replace('GROUP', '2')} WHEN p LIKE '[ROLE=% [/ROLE]' THEN {inside.replace('GROUP', '3')} ELSE {inside.replace('GROUP', '4')} END"
    role = r"CASE WHEN p LIKE '[INST] % [/INST]' THEN 'user' WHEN p LIKE '<<SYS>> % <</SYS>>' THEN 'system' WHEN p LIKE '[ROLE=% [/ROLE]' THEN url_decode(replace(regexp_extract(p, '^\[ROLE=([^\]]*)\]', 1), '+', '%20')) ELSE 'assistant' END"
    said = "role || chr(10) || text || chr(10)"
    return rf"""WITH given AS (SELECT conv_id, '' AS own, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 'odd', i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) r(i)),
talks AS (SELECT conv_id, count(*) AS n_turns, string_agg({said}, '' {order}) AS said, COALESCE(string_agg(text, '' {order}) FILTER (role = 'assistant'), '') AS learnt, string_agg({turn("text")}, '' {order}) AS plain, string_agg({turn(escaped)}, '' {order}) AS safe
  FROM given GROUP BY conv_id, own),
read AS (SELECT *, regexp_extract_all(plain, '{form}') AS pieces FROM talks),
judged AS (SELECT *, array_to_string(pieces, '') = plain AND array_to_string(list_transform(pieces, lambda p: {role} || chr(10) || {text} || chr(10)), '') = said AND len(pieces) = n_turns AS fine FROM read)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(learnt) AS loss_chars, sha256(learnt) AS loss_sha256, 3 + length(CASE WHEN fine THEN plain ELSE safe END) AS formatted_chars FROM judged"""


def clusters(k: int = 16, rounds: int = 3, dims: int = 64, steps: int = 64, largest: int = 1 << 27) -> str:
    """Rows of op13: every vector against every centroid, in integers."""
    steps_sql = [f"""kept AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(e, lambda x: CAST(floor(x) AS BIGINT)) AS q FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * {steps}) AS e FROM embeddings)
  WHERE len(e) = {dims} AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR x < -{largest} OR x >= {largest})) = 0)""", f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)), q) - 1 AS c, q FROM kept WHERE vec_id IS NOT NULL QUALIFY c < {k})"]
    for i in range(rounds + 1):
        steps_sql.append(f"d{i} AS (SELECT rid, min(struct_pack(d := list_sum(list_transform(list_zip(v.q, m.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), c := m.c)) AS b FROM kept v CROSS JOIN c{i} m GROUP BY rid)")
        if i < rounds:
            steps_sql.append(f"u{i} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT d.b.c AS c, unnest(q) AS x, unnest(range({dims})) AS i FROM d{i} d JOIN kept USING (rid)) GROUP BY c, i)")
            floored = "CAST(CASE WHEN s % n < 0 THEN s // n - 1 ELSE s // n END AS BIGINT)"
            steps_sql.append(f"c{i + 1} AS (SELECT m.c, COALESCE(u.q, m.q) AS q FROM c{i} m LEFT JOIN (SELECT c, list({floored} ORDER BY i) AS q FROM u{i} GROUP BY c) u ON u.c = m.c)")
    return f"""WITH {", ".join(steps_sql)},
final AS (SELECT vec_id, d.b.c AS cluster, CAST(d.b.d AS BIGINT) AS distance FROM d{rounds} d JOIN kept USING (rid))
SELECT vec_id, CAST(cluster AS INT) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m.q, ',')) AS centroid_sha256 FROM final JOIN c{rounds} m ON m.c = cluster"""
