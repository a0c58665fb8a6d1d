"""DuckDB SQL for the queries that SQL expresses at the size of the correctness check."""

_NORMAL = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"

_CHARS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_AZ, _az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


_LOWER = f"translate(coalesce(text, ''), '{_AZ}', '{_az}')"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _url_sql() -> str:
    """Rules, then the vocabulary as one regular expression for each term."""
    from .url_filter import RULES, SOFT, SOFT_LIMIT, STRICT

    order = sorted(RULES, key=lambda r: -(len(r[1]) + len(r[2])))
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", f"{h}{p}", v) for v, h, p in order]
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{name}'" for f, name, _ in fits) + " END"
    verdict = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, _, v in fits)
    word = lambda t: f"regexp_matches(u, '(^|[^\\p{{L}}\\p{{N}}]){t}($|[^\\p{{L}}\\p{{N}}])')"
    strict = " OR ".join(map(word, STRICT))
    soft = " + ".join(f"({word(t)})::INT" for t in SOFT)
    return f"""
        WITH a AS (SELECT page_id, translate(coalesce(url, ''), '{_AZ}', '{_az}') AS u,
                          CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
             b AS (SELECT page_id, u, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_AZ}', '{_az}') AS host,
                          regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a)
        SELECT page_id, host, path, {rule} AS rule,
               {verdict} WHEN ({strict}) OR ({soft}) >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END AS verdict
        FROM b
    """


#: CTEs r, c(doc, component) over a table ``e(a, b)`` of links and ``nodes(id)``.
_COMPONENTS = """links AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
             r(id, seen) AS (SELECT id, id FROM nodes UNION SELECT links.b, r.seen FROM r JOIN links ON links.a = r.id),
             c AS (SELECT id, min(seen) AS component FROM r GROUP BY id)"""

ORACLES = {
    "op1_jaccard_join": f"""
        WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_AZ}', '{_az}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
             s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                   ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS sh FROM t),
             u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
             e AS (SELECT p.doc_id AS a, q.doc_id AS b FROM u p JOIN u q ON p.x = q.x AND p.doc_id < q.doc_id GROUP BY p.doc_id, q.doc_id, p.n, q.n
                   HAVING 100 * count(*) >= 90 * (p.n + q.n - count(*))),
             nodes AS (SELECT doc_id AS id FROM documents), {_COMPONENTS}
        SELECT doc_id, len(sh)::BIGINT AS n_shingles, component AS component_id FROM s JOIN c ON c.id = s.doc_id
    """,
    "op9_mixing": """
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
             s0 AS (SELECT source, sum(size)::DOUBLE AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nr FROM d GROUP BY source),
             s1 AS (SELECT *, [3, 1, 2][nr % 3 + 1]::DOUBLE AS w, 2 * source_size AS cap FROM s0),
             s2 AS (SELECT *, row_number() OVER o AS k, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
                           sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM s1 WINDOW o AS (ORDER BY cap / w, nr)),
             l AS (SELECT (1.5 * (SELECT sum(size) FROM d) - capped) / free AS level FROM s2 WHERE (1.5 * (SELECT sum(size) FROM d) - capped) / free <= cap / w ORDER BY k LIMIT 1),
             s AS (SELECT source, source_size::BIGINT AS source_size, round(CASE WHEN level IS NULL THEN cap ELSE least(level * w, cap) END, 6) AS target FROM s2 LEFT JOIN l ON true),
             p AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
                          row_number() OVER (PARTITION BY d.source ORDER BY size DESC, doc_id) - 1 AS pos FROM d JOIN s ON s.source IS NOT DISTINCT FROM d.source),
             u0 AS (SELECT source, ('0x' || left(sha256('mix|' || coalesce('=' || source, 'null')), 13))::BIGINT / 4503599627370496.0 AS u FROM s),
             u1 AS (SELECT source, k, CASE WHEN u + k / 32.0::DOUBLE >= 1 THEN u + k / 32.0::DOUBLE - 1 ELSE u + k / 32.0::DOUBLE END AS u FROM u0, range(32) AS r(k)),
             t AS (SELECT u1.source, k, u1.u, abs(sum(size * (floor((pos + 1) * rate + u) - floor(pos * rate + u))) - any_value(target)) AS off
                   FROM p JOIN u1 ON u1.source IS NOT DISTINCT FROM p.source GROUP BY u1.source, k, u1.u),
             u AS (SELECT source, arg_min(u, (off, k)) AS u FROM t GROUP BY source)
        SELECT doc_id, size, source_size, target, (size * (floor((pos + 1) * rate + u) - floor(pos * rate + u)))::BIGINT AS taken
        FROM p JOIN u ON u.source IS NOT DISTINCT FROM p.source
    """,
    "op10_embedding_dedup": f"""
        WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
             e AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id < q.vec_id WHERE list_dot_product(p.x, q.x) / (p.n * q.n) >= 0.9),
             nodes AS (SELECT vec_id AS id FROM v), {_COMPONENTS}
        SELECT id AS vec_id, (SELECT count(*) FROM links WHERE links.a = c.id) AS n_links, component AS component_id, id = component AS kept FROM c
    """,
    "op2_chat_perspectives": """
        WITH t AS (SELECT conv_id, turn, coalesce(nullif(replace(role, '<|', '< |'), ''), 'unknown') AS role,
                          replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
             s AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
             p AS (SELECT s.conv_id, s.speaker, t.turn, t.role, t.text, t.role = s.speaker AS mine,
                          CASE WHEN t.role = s.speaker THEN '<|assistant|>' WHEN t.role = 'system' THEN '<|system|>'
                               ELSE '<|user name=' || t.role || '|>' END || chr(10) AS head, t.text || '<|end|>' AS body
                   FROM s JOIN t ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
             q AS (SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, speaker
                          ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)::BIGINT AS fin FROM p)
        SELECT conv_id, speaker, count(*) AS n_turns,
               string_agg(head || body || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS rendered,
               coalesce(string_agg((fin - 1 - length(body))::VARCHAR || '-' || (fin - 1)::VARCHAR, ',' ORDER BY fin) FILTER (mine), '') AS loss_spans,
               coalesce(sum(length(body)) FILTER (mine), 0)::BIGINT AS n_loss_chars
        FROM q GROUP BY conv_id, speaker
    """,
    "op5_line_dedup": f"""
        WITH l AS (SELECT doc_id, line, nr, translate(trim(line, {_CHARS}), '{_AZ}', '{_az}') AS key
                   FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                                generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS nr FROM documents)),
             f AS (SELECT key FROM l WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
             m AS (SELECT l.*, l.key IN (SELECT key FROM f) AS gone FROM l)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY nr) FILTER (NOT gone), '')) AS kept_sha256
        FROM m GROUP BY doc_id
    """,
    "op6_url_filter": _url_sql(),
    "op8_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_NORMAL} AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM d
    """,
    "op13_decontamination": f"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents),
             i AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM benchmark),
             k AS (SELECT item_id, unnest(list_transform(range(1, greatest(len(w) - 8, 2)), lambda p: w[p:p + 9])) AS x FROM i WHERE len(w) > 0),
             sizes AS (SELECT DISTINCT len(x) AS size FROM k),
             o AS (SELECT doc_id, p, w[p:p + size - 1] AS x FROM d, sizes, unnest(range(1, len(w) - size + 2)) AS r(p)),
             hits AS (SELECT o.doc_id, o.p, len(o.x) AS size, k.item_id FROM o JOIN k ON o.x = k.x),
             n AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS pos FROM hits) GROUP BY doc_id),
             l AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
        SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN l ON l.doc_id = d.doc_id
    """,
    "op12_source_divergence": r"""
        WITH d AS (SELECT doc_id, row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
             w AS (SELECT row_id, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
             v AS (SELECT lang, term, count(*)::HUGEINT AS lang_n FROM w GROUP BY lang, term HAVING count(DISTINCT row_id) >= 3),
             l AS (SELECT lang, count(*)::HUGEINT AS kept, sum(lang_n)::HUGEINT AS lang_total FROM v GROUP BY lang),
             g AS (SELECT DISTINCT lang, source FROM d),
             c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w GROUP BY ALL),
             x AS (SELECT g.lang, g.source, v.term, lang_n, coalesce(n, 0)::HUGEINT AS n FROM g JOIN v ON v.lang = g.lang
                   LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
             p AS (SELECT x.*, 1 + (1000000000::HUGEINT * (n + 1)) // ((sum(n) OVER (PARTITION BY x.lang, source))::HUGEINT + kept) AS p,
                          1 + (1000000000::HUGEINT * (lang_n + 1)) // (lang_total + kept) AS q FROM x JOIN l ON l.lang = x.lang),
             pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value
                       FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
             r AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0) AS value FROM g JOIN g h ON h.lang = g.lang AND h.source <> g.source
                   LEFT JOIN pairs ON pairs.lang = g.lang AND pairs.source = g.source AND pairs.item = h.source
                   UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q),
             k AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM r)
        SELECT * FROM k WHERE part = 'pair' OR rank <= 200
    """,
    "op11_importance_resampling": f"""
        WITH RECURSIVE crc AS (SELECT n, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) AS t FROM range(256) AS r(n)),
             d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents),
             i AS (SELECT regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM benchmark),
             df AS (SELECT doc_id, unnest(flatten([list_transform(range(1, len(w) + 2 - n), lambda p: array_to_string(w[p:p + n - 1], ' ')) for n in [1, 2, 3]])) AS x FROM d),
             tf AS (SELECT unnest(flatten([list_transform(range(1, len(w) + 2 - n), lambda p: array_to_string(w[p:p + n - 1], ' ')) for n in [1, 2, 3]])) AS x FROM i),
             x AS (SELECT x, list_transform(regexp_extract_all(hex(encode(x)), '..'), lambda o: ('0x' || o)::UTINYINT) AS h FROM (SELECT x FROM df UNION SELECT x FROM tf)),
             st(x, h, c) AS (SELECT x, h, 4294967295::BIGINT FROM x UNION ALL SELECT x, h[2:], xor(t, c >> 8) FROM st JOIN crc ON n = xor(c, h[1]::BIGINT) & 255 WHERE len(h) > 0),
             b AS (SELECT x, xor(c, 4294967295) % 10000 AS bucket FROM st WHERE len(h) = 0),
             s AS (SELECT bucket, count(*) AS n FROM df JOIN b ON b.x = df.x GROUP BY bucket),
             t AS (SELECT bucket, count(*) AS n FROM tf JOIN b ON b.x = tf.x GROUP BY bucket),
             g AS (SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT sum(n) FROM s) + 10000)
                                                    / ((s.n + 1)::DOUBLE * (coalesce((SELECT sum(n) FROM t), 0) + 10000))))::BIGINT AS gain FROM s LEFT JOIN t ON t.bucket = s.bucket),
             w AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS weight FROM df JOIN b ON b.x = df.x JOIN g ON g.bucket = b.bucket GROUP BY doc_id),
             sc AS (SELECT d.doc_id, len(d.w) AS n_words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
                           coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('42:' || d.doc_id), 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS score
                    FROM d LEFT JOIN w ON w.doc_id = d.doc_id),
             r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM sc WHERE n_words >= 20)
        SELECT sc.doc_id, n_features, weight, score, CASE WHEN place <= (SELECT 5 * count(*) // 100 FROM r) THEN place END AS rank
        FROM sc LEFT JOIN r ON r.doc_id = sc.doc_id
    """,
}
