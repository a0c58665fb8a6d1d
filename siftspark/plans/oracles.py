"""DuckDB SQL for the registered queries of the retrieval library."""

from __future__ import annotations

from ..functions.porter import _STEP2, _STEP3, _STEP4
from ..functions.query_terms import MONEY_WORDS, NOT_NAMES
from ..functions.text import QUERY_INSTRUCTION, RERANK_INSTRUCTION
from ..operators.answers import DATA_BEGIN, DATA_END
from .archive import KINDS
from .queries import EVERY, TERMS

# white space as Unicode and Python see it, for RE2
_WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '^{_WS}+|{_WS}+$', '', 'g')"


def _collapse(x: str) -> str:
    return _strip(f"regexp_replace(coalesce({x}, ''), '{_WS}+', ' ', 'g')")


def _snippet(x: str, n: int = 180) -> str:
    return f"CASE WHEN length({_collapse(x)}) <= {n} THEN {_collapse(x)} ELSE left({_collapse(x)}, {n - 1}) || '…' END"


def _tokens(x: str) -> str:
    return f"regexp_extract_all(strip_accents(lower(coalesce({x}, ''))), '[\\p{{L}}\\p{{N}}]+')"


_M = f"""m AS (SELECT doc_id AS id, left(string_split(text, chr(10))[1], 120) AS subject, text AS body, source || '@example.com' AS from_addr,
    lang AS lane, strftime(DATE '2024-01-01' + (doc_id % 720)::INT, '%Y-%m-%dT00:00:00Z') AS date_utc,
    CASE WHEN doc_id % 11 <> 0 THEN doc_id - doc_id % 4 END AS thread_id, {_snippet('text')} AS snippet FROM documents)"""
_PAYLOAD = f"""left(CASE WHEN {_strip('subject')} <> '' AND {_strip('body')} <> '' THEN {_strip('subject')} || chr(10) || chr(10) || {_strip('body')}
    ELSE {_strip('subject')} || {_strip('body')} END, 16000)"""
_CLEAN = f"regexp_replace({_strip('body')}, '\\n{{3,}}', chr(10) || chr(10), 'g')"
_META = f"""meta AS (SELECT id AS message_id, CASE WHEN id % 7 = 0 THEN 'stale' ELSE sha256(body) END AS text_hash,
    CASE WHEN id % 5 = 0 THEN NULL WHEN id % 7 = 0 THEN 'stale' ELSE sha256({_CLEAN}) END AS content_hash,
    CASE WHEN id % 5 = 0 THEN 0 ELSE 1 END AS quote_stripped FROM m WHERE id IN (SELECT vec_id FROM embeddings))"""
_ACTIONS = f"""a AS (SELECT m.id, meta.message_id IS NOT NULL AS present, coalesce(meta.content_hash, '') AS stored,
    CASE WHEN meta.message_id IS NULL THEN 'missing' WHEN coalesce(meta.content_hash, '') = '' THEN 'skip'
         WHEN meta.content_hash = sha256({_CLEAN}) AND quote_stripped = 1 THEN 'skip' ELSE 'stale' END AS action
    FROM m LEFT JOIN meta ON meta.message_id = m.id)"""
_REASONS = f"""r AS (SELECT id, message_id IS NOT NULL AND reason = 'due' AS changed, reason FROM (
    SELECT m.id, meta.message_id, CASE WHEN meta.text_hash = sha256({_PAYLOAD}) THEN 'already' WHEN length({_PAYLOAD}) > 4000 THEN 'too_long'
        WHEN length({_PAYLOAD}) < 200 THEN 'too_short' ELSE 'due' END AS reason FROM m LEFT JOIN meta ON meta.message_id = m.id))"""


def _bm25(boost: float, terms: dict[int, str] = TERMS) -> str:
    """CTE s(query_id, id, score) over all messages for ``terms``."""
    words = ", ".join(f"({q}, '{t}')" for q, x in terms.items() for t in dict.fromkeys(x.split()))
    fields = " UNION ALL ".join(f"SELECT id, {w} AS w, unnest({_tokens(f)}) AS term FROM m" for f, w in (("subject", boost), ("body", 1.0), ("from_addr", 1.0)))
    return f"""w(query_id, term) AS (VALUES {words}), occ AS ({fields}),
        dl AS (SELECT m.id, coalesce(n, 0) AS dl FROM m LEFT JOIN (SELECT id, count(*) AS n FROM occ GROUP BY id) USING (id)),
        st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM dl),
        tf AS (SELECT term, id, sum(w)::DOUBLE AS tf FROM occ WHERE term IN (SELECT term FROM w) GROUP BY term, id),
        idf AS (SELECT term, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END AS idf
                FROM (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY term), st),
        s AS (SELECT w.query_id, tf.id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
              FROM w JOIN tf USING (term) JOIN idf USING (term) JOIN dl ON dl.id = tf.id, st
              GROUP BY w.query_id, tf.id HAVING count(*) = (SELECT count(*) FROM w x WHERE x.query_id = w.query_id))"""


def _shape(w: str) -> str:
    """Consonants and vowels of a word; y is the other of what stands before it."""
    x = f"regexp_replace(regexp_replace({w}, '[^aeiouy]', 'c', 'g'), '[aeiou]', 'v', 'g')"
    for _ in range(4):
        x = f"replace(replace(regexp_replace({x}, '^y', 'c'), 'cy', 'cv'), 'vy', 'vc')"
    return x


def _porter(words: str) -> str:
    """CTE stems(term, stem) of ``words`` (term): Porter's steps on one table each. A letter outside ASCII counts as two."""
    cut = lambda x, n: f"left({x}, length({x}) - {n})"
    ends = lambda x: f"suffix(w, '{x}')"
    over = lambda s, n: f"regexp_matches({s}, 'vc{'.*vc' * n}')"
    short_end = lambda w, s: f"(suffix({s}, 'cvc') AND right({w}, 1) NOT IN ('w', 'x', 'y'))"
    out = [f"p0 AS (SELECT term, w, {_shape('w')} AS s FROM (SELECT DISTINCT term, regexp_replace(term, '([^\\x00-\\x7F])', '\\1' || chr(1), 'g') AS w FROM {words}))"]

    def step(value: str) -> None:
        n = len(out)
        out.append(f"p{n} AS (SELECT term, w, {_shape('w')} AS s FROM (SELECT term, CASE WHEN length(w) BETWEEN 3 AND 64 OR {n} > 1 AND length(term) > 2 THEN {value} ELSE w END AS w FROM p{n - 1}))")

    def swapped(table: dict[str, str]) -> str:
        return "CASE " + " ".join(f"WHEN {ends(e)} THEN CASE WHEN {over(cut('s', len(e)), 0)} THEN {cut('w', len(e))} || '{new}' ELSE w END" for e, new in sorted(table.items(), key=lambda x: -len(x[0]))) + " ELSE w END"

    step(f"CASE WHEN {ends('sses')} OR {ends('ies')} AND length(w) > 3 THEN {cut('w', 2)} WHEN {ends('s')} AND NOT {ends('ss')} THEN {cut('w', 1)} ELSE w END")

    def mended(n: int) -> str:
        b, s = cut("w", n), cut("s", n)
        return f"""CASE WHEN regexp_matches({b}, '(at|bl|iz)$') THEN {b} || 'e' WHEN right({b}, 1) = right({cut(f'({b})', 1)}, 1) AND suffix({s}, 'c') AND right({b}, 1) NOT IN ('l', 's', 'z') THEN {cut(f'({b})', 1)}
            WHEN {over(s, 0)} AND NOT {over(s, 1)} AND {short_end(b, s)} THEN {b} || 'e' ELSE {b} END"""

    step(f"""CASE WHEN {ends('eed')} THEN CASE WHEN {over(cut('s', 3), 0)} THEN {cut('w', 1)} ELSE w END
        WHEN {ends('ed')} AND contains({cut('s', 2)}, 'v') THEN {mended(2)} WHEN {ends('ing')} AND contains({cut('s', 3)}, 'v') THEN {mended(3)} ELSE w END""")
    step(f"CASE WHEN {ends('y')} AND contains({cut('s', 1)}, 'v') THEN {cut('w', 1)} || 'i' ELSE w END")
    step(swapped(_STEP2))
    step(swapped(_STEP3))
    fourth = lambda e: f"{over(cut('s', len(e)), 1)}" + (" AND regexp_matches(w, '[st]ion$')" if e == "ion" else "")
    step("CASE " + " ".join(f"WHEN {ends(e)} THEN CASE WHEN {fourth(e)} THEN {cut('w', len(e))} ELSE w END" for e in sorted(_STEP4, key=len, reverse=True)) + " ELSE w END")
    h = cut("s", 1)
    step(f"CASE WHEN {ends('e')} AND ({over(h, 1)} OR {over(h, 0)} AND NOT {short_end(cut('w', 1), h)}) THEN {cut('w', 1)} ELSE w END")
    step(f"CASE WHEN {ends('ll')} AND {over('s', 1)} THEN {cut('w', 1)} ELSE w END")
    return ", ".join(out) + f", stems AS (SELECT term, replace(w, chr(1), '') AS stem FROM p{len(out) - 1})"


def _bm25_phrases(boost: float) -> str:
    """CTE s(query_id, id, score) for one-word phrases ``q(query_id, phrase)``, by the stems of all words."""
    fields = " UNION ALL ".join(f"SELECT id, {w} AS w, unnest({_tokens(f)}) AS term FROM m" for f, w in (("subject", boost), ("body", 1.0), ("from_addr", 1.0)))
    return f"""occ AS ({fields}), {_porter("(SELECT term FROM occ UNION SELECT phrase FROM q)")},
        dl AS (SELECT m.id, coalesce(n, 0) AS dl FROM m LEFT JOIN (SELECT id, count(*) AS n FROM occ GROUP BY id) USING (id)),
        st AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS avgdl FROM dl),
        ph AS (SELECT DISTINCT phrase, stem FROM q JOIN stems ON term = phrase),
        tf AS (SELECT phrase, id, sum(w)::DOUBLE AS tf FROM ph JOIN stems USING (stem) JOIN occ ON occ.term = stems.term GROUP BY phrase, id),
        idf AS (SELECT phrase, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END AS idf
                FROM (SELECT phrase, count(*)::DOUBLE AS df FROM tf GROUP BY phrase), st),
        qs AS (SELECT query_id, count(*) AS n_phrases FROM q GROUP BY query_id),
        s AS (SELECT q.query_id, tf.id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
              FROM q JOIN tf USING (phrase) JOIN idf USING (phrase) JOIN dl ON dl.id = tf.id JOIN qs ON qs.query_id = q.query_id, st
              GROUP BY q.query_id, tf.id, n_phrases HAVING count(*) = n_phrases)"""


def _kinds() -> str:
    said = lambda x: "NULL" if x is None else f"'{x}'"
    return ", ".join(f"({k}, {', '.join(map(said, kind))})" for k, kind in enumerate(KINDS))


def _knn(k: int) -> str:
    return f"""q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % {EVERY} = 0),
        d AS (SELECT query_id, vec_id AS id, 1 - list_dot_product(qv, embedding::DOUBLE[]) /
                     (sqrt(list_dot_product(qv, qv)) * sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS distance FROM q, embeddings),
        v AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 12), id) AS vec_rank FROM d QUALIFY vec_rank <= {k})"""


_FTS = "f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS fts_rank FROM s QUALIFY fts_rank <= 50)"
#: CTE f(query_id, id, score, fts_rank): the list of each vector query's words.
_LISTS = f"""{_FTS.replace("f AS", "f0 AS", 1)},
    asked AS (SELECT vec_id AS query_id, vec_id // {EVERY} % {len(TERMS)} + 1 AS words FROM embeddings WHERE vec_id % {EVERY} = 0),
    f AS (SELECT asked.query_id, id, score, fts_rank FROM asked JOIN f0 ON f0.query_id = words)"""
_RRF = "1.0 / (60 + coalesce(fts_rank, 1000)) + 1.0 / (60 + coalesce(vec_rank, 1000))"
_FUSED = f"""u AS (SELECT query_id, id, coalesce(fts_rank, 1000) AS fts_rank, coalesce(vec_rank, 1000) AS vec_rank, {_RRF} AS rrf
    FROM f FULL JOIN v USING (query_id, id))"""
_AGE = "exp(-0.002 * greatest(epoch_us(TIMESTAMP '{now}') - epoch_us(date_utc::TIMESTAMP), 0) / 86400000000.0)"
_HITS = f"""{_M}, {_bm25(5.0)}, {_LISTS}, {_knn(50)}, {_FUSED},
    h0 AS (SELECT u.query_id, u.id, fts_rank, vec_rank, thread_id, date_utc,
        round(rrf * {_AGE.format(now='2026-01-01 00:00:00')}, 12) AS rrf FROM u LEFT JOIN m ON m.id = u.id),
    h AS (SELECT *, CASE WHEN pos % 7 <> 0 THEN id % 10 / 10.0 END AS rerank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, id) AS pos FROM h0))"""
_CITED = """c AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(rerank, 0) DESC, rrf DESC, id) AS citation
    FROM h {where})"""
_SPINE = """k0 AS (SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY (id <> thread_id)::INT, date_utc NULLS FIRST, id) AS r,
        row_number() OVER (PARTITION BY thread_id ORDER BY date_utc DESC NULLS LAST, id DESC) AS l FROM {members}),
    k AS (SELECT thread_id, id, 0 AS part, 0::BIGINT AS nth FROM k0 WHERE r = 1 UNION ALL SELECT thread_id, id, 1, 3 - l FROM k0 WHERE l <= 3)"""
_PACK = """p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS pack_pos FROM (SELECT * FROM h
        QUALIFY row_number() OVER (PARTITION BY query_id, coalesce(thread_id::VARCHAR, 'msg:' || id) ORDER BY pos) = 1) QUALIFY pack_pos <= {k})"""
#: CTE x: the pack p, then the spines k of its threads and their other hits.
_EXPANDED = """e AS (SELECT p.query_id, k.id, p.pack_pos, k.part, k.nth FROM p JOIN k ON k.thread_id = p.thread_id
              UNION ALL SELECT h.query_id, h.id, p.pack_pos, 2, h.pos FROM h JOIN p ON p.query_id = h.query_id AND p.thread_id = h.thread_id),
        o AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.query_id = e.query_id AND p.id = e.id)
              QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY pack_pos, part, nth) = 1),
        x AS (SELECT query_id, id, 0 AS pack_pos, 0 AS part, pack_pos AS nth, true AS in_pack FROM p UNION ALL SELECT query_id, id, pack_pos, part, nth, false FROM o)"""
_INSIDE = "(want IS NULL OR lower(coalesce(m.lane, '')) = want) AND (lo IS NULL OR coalesce(date_utc, '') >= lo) AND (hi IS NULL OR coalesce(date_utc, '') <= hi)"
_REPLY = r"""'> before' || chr(13) || chr(10) || body || replace(chr(10) || '-- ' || chr(10) || 'Ada' || chr(10) ||
    'On Tue, 1 Apr 2025, Ada <ada@example.com> wrote:' || chr(10) || '> earlier' || chr(10), chr(10), chr(13) || chr(10))"""

_WORD = r"[\p{L}\p{N}_]"
_NAME, _EDGE = "[A-Z][a-z]{2,}", r"[^\p{L}\p{N}_]"


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in sorted(words)) + "]"


_IDENTIFIER = (
    r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b|\b\d{3,4}-\d{3,4}-\d{2,4}\b"
    r"|\b(?i:INV)[-_][A-Za-z0-9][-A-Za-z0-9]{1,}\b|\b(?i:inv(?:oice)?)[\s#:.-]*\d{3,}[A-Za-z0-9-]*\b"
)
_QUERY_READING = f"""WITH b AS (SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'invoice INV-' WHEN 1 THEN 'from Ada Lovelace 123-456-' ELSE '' END || item_id || ' ' || text AS q FROM benchmark),
    w AS (SELECT *, list_transform(regexp_extract_all(lower(q), '[a-z$]+'), lambda x: ltrim(x, '$')) AS low, regexp_extract_all(q, '{_WORD}+') AS words FROM b),
    p AS (SELECT item_id, q, low, words, CASE WHEN len(regexp_extract_all(q, '[A-Za-z0-9_]+(?:[-.][A-Za-z0-9_]+)*')) > 0
        THEN regexp_extract_all(q, '[A-Za-z0-9_]+(?:[-.][A-Za-z0-9_]+)*') ELSE [q] END AS found FROM w)
    SELECT item_id, CASE WHEN contains(q, '$') OR list_has_any(low, {_list(MONEY_WORDS)}) THEN 'money'
        WHEN regexp_matches(q, '(^|{_EDGE}){_NAME}\\s+{_NAME}($|{_EDGE})') OR regexp_matches(q, '(^|{_EDGE})(from|to|fwd|forward(ed)?(\\s+to)?)\\s+{_NAME}($|{_EDGE})') THEN 'people'
        WHEN len(list_filter(words, lambda x: regexp_full_match(x, '{_NAME}') AND NOT list_contains({_list(NOT_NAMES)}, lower(x)))) > 0 THEN 'people' END AS lane,
        regexp_matches(q, '{_IDENTIFIER}') AS is_identifier,
        array_to_string(list_filter(list_transform(found, lambda x: array_to_string(regexp_extract_all(strip_accents(lower(x)), '[\\p{{L}}\\p{{N}}]+'), ' ')), lambda x: x <> ''), '|') AS phrases FROM p"""

ORACLES = {
    "clean_newlines": f"WITH {_M} SELECT id, sha256(replace({_REPLY}, chr(13) || chr(10), chr(10))) AS normal FROM m",
    "clean_body": f"WITH {_M} SELECT id, length({_CLEAN}) AS cleaned_chars, sha256({_CLEAN}) AS content_hash FROM m",
    "strip_signature": f"WITH {_M} SELECT id, subject || chr(10) AS unsigned FROM m",
    "snippet": f"""WITH {_M} SELECT id, snippet, CASE WHEN {_collapse('body')} <> '' THEN snippet WHEN left(subject, 6) <> '' THEN left(subject, 6)
        ELSE subject END AS best FROM m""",
    "embed_text": f"WITH {_M} SELECT id, length({_PAYLOAD}) AS n, sha256({_PAYLOAD}) AS text_hash FROM m",
    "query_text": f"SELECT item_id, '{QUERY_INSTRUCTION}' || {_strip('text')} AS payload FROM benchmark",
    "hit_document": f"""WITH {_M} SELECT id, left(CASE WHEN {_strip('subject')} <> '' AND {_strip('snippet')} <> '' THEN {_strip('subject')} || chr(10) || {_strip('snippet')}
        ELSE {_strip('subject')} || {_strip('snippet')} END, 1500) AS document FROM m""",
    "rerank_pairs": f"""WITH {_M} SELECT id, '<Instruct>: {RERANK_INSTRUCTION}' || chr(10) || '<Query>: the boat' || chr(10) || '<Document>: ' ||
        left(CASE WHEN {_strip('subject')} <> '' AND {_strip('snippet')} <> '' THEN {_strip('subject')} || chr(10) || {_strip('snippet')}
        ELSE {_strip('subject')} || {_strip('snippet')} END, 1500) AS prompt FROM m""",
    "document_text": f"""WITH {_M} SELECT id, lane || ' <' || from_addr || '>' AS sender, sha256(left('Subject: ' || {_strip('subject')} || chr(10) || 'From: ' || lane || ' <' ||
        from_addr || '>' || chr(10) || 'To: bob@example.com' || chr(10) || 'Date: ' || date_utc || chr(10) || 'Lane: ' || lane ||
        CASE WHEN {_strip('body')} <> '' THEN chr(10) || chr(10) || {_strip('body')} ELSE '' END, 16000)) AS text_hash FROM m""",
    "format_date": f"""WITH {_M} SELECT id, left(date_utc, 10) || 'T00:00:00Z' AS day,
        strftime(left(date_utc, 10)::DATE + INTERVAL 1 DAY, '%Y-%m-%dT01:30:00Z') AS zoned, lane AS other FROM m""",
    "model_names": f"""WITH {_M} SELECT id, CASE WHEN id % 2 = 0 THEN 'qwen3-embedding-8b' ELSE lower(lane) || '-v1' END AS model_id,
        CASE WHEN id % 2 = 0 THEN 'qwen3-embedding:8b' ELSE lower(lane) || '-v1' END AS tag FROM m""",
    "redacted_detail": f"WITH {_M} SELECT id, CASE WHEN id % 3 = 0 THEN '<redacted>' ELSE lane END AS detail, left({_collapse('body')}, 60) AS error FROM m",
    "index_tokens": f"WITH {_M} SELECT id, len({_tokens('body')}) AS n_tokens, array_to_string({_tokens('body')}[1:5], ' ') AS head FROM m",
    "thread_fields": f"""WITH {_M} SELECT id, CASE id % 4 WHEN 0 THEN '<r' || id || '@x>' WHEN 1 THEN '<p' || id || '@x>' WHEN 2 THEN '<' || id || '@x>' ELSE id::VARCHAR END AS thread,
        CASE WHEN id % 4 <= 1 THEN '<p' || id || '@x>' END AS in_reply_to, CASE WHEN id % 4 = 0 THEN 2 ELSE 0 END::BIGINT AS n_refs FROM m""",
    "identifier_extract": f"""WITH {_M}, t AS (SELECT id, regexp_extract_all(subject, '(?i)\\bINV[-_][A-Za-z0-9][-A-Za-z0-9]+\\b') AS more FROM m)
        SELECT id, '123-456-78|INV-A' || id || '|Invoice #' || lpad(id::VARCHAR, 5, '0') || '|' || lpad(id::VARCHAR, 5, '0') AS identifiers FROM t""",
    "identifier_report": f"""WITH t AS (SELECT concat_ws(chr(10), nullif(url, ''), nullif(html, '')) AS t FROM pages)
        SELECT count(*) AS examined, count(*) FILTER (regexp_matches(t, '{_IDENTIFIER}')) AS updated, count(*) FILTER (NOT regexp_matches(t, '{_IDENTIFIER}')) AS empty FROM t""",
    "query_reading": _QUERY_READING,
    "scorer_answers": f"""WITH {_M} SELECT id, round(exp(-(id % 7)) / (exp(-(id % 7)) + CASE WHEN id % 3 <> 0 THEN exp(-(id % 5)) ELSE exp(-10.0) END), 9) AS logprobs,
        round(exp(id % 4) / (exp(id % 4) + exp(id % 6)), 9) AS pairs, CASE WHEN id % 2 = 1 THEN 1.0 WHEN id % 100 <= 1 THEN id % 100 ELSE round(id % 100 / 100.0, 9) END::DOUBLE AS said,
        least(greatest(id, 512), 1024)::BIGINT AS tokens FROM m""",
    "clipped_subjects": f"WITH {_M} SELECT id, {_snippet('subject', 40)} AS subject FROM m",
    "message_lookup": f"""WITH {_M}, x AS (SELECT *, CASE WHEN id % 5 = 0 THEN 'short' WHEN id % 5 <> 1 THEN snippet ELSE '' END AS own FROM m)
        SELECT id, subject, from_addr, CASE WHEN length(trim(own)) >= 8 THEN own ELSE coalesce(nullif(snippet, ''), nullif(own, ''), subject) END AS snippet FROM x""",
    "conformed": "SELECT page_id::VARCHAR AS id, url AS from_addr, length(html)::BIGINT AS size_bytes, NULL::VARCHAR AS lane, 0 AS has_attachments FROM pages",
    "migrated": "SELECT doc_id::VARCHAR AS message_id, quality::INTEGER AS quote_stripped, 1024::BIGINT AS dims, 'v1' AS model_version, NULL::VARCHAR AS content_hash, 4::BIGINT AS lacked FROM labels",
    "upserted_records": f"WITH {_M}, {_META} SELECT message_id, CASE WHEN text_hash = 'stale' THEN 'newer' ELSE text_hash END AS text_hash FROM meta",
    "enriched_messages": f"""WITH {_M} SELECT id, CASE WHEN quality IS NULL THEN thread_id::VARCHAR ELSE 't' END AS thread_id, CASE WHEN quality = 1 THEN '<r@x>' ELSE from_addr END AS in_reply_to,
        CASE WHEN quality IS NOT NULL THEN '<s@x>' END AS references_header, CASE WHEN quality IS NULL THEN '' ELSE 'c' END AS cleaned_body, CASE WHEN quality IS NULL THEN 0 ELSE 1 END::BIGINT AS cleaned_chars,
        CASE WHEN quality IS NULL THEN 'old' ELSE 'new' END AS content_hash FROM m LEFT JOIN labels ON labels.doc_id = m.id""",
    "identifier_text": f"""WITH {_M} SELECT id, '<' || id || '@x>' AS message_id, concat_ws(' ', CASE WHEN id % 2 = 0 THEN '123-456-' || lpad((id % 100)::VARCHAR, 2, '0') END,
        CASE WHEN TRUE THEN 'INV-S' || id END, 'invoice ' || lpad(id::VARCHAR, 4, '0'), lpad(id::VARCHAR, 4, '0')) AS identifiers FROM m""",
    "chunk_of_message": "SELECT conv_id AS id, min(conv_id || '-' || lpad(turn::VARCHAR, 4, '0')) AS chunk_id FROM conversations GROUP BY 1",
    "candidate_preview": f"WITH {_M}, {_META}, {_ACTIONS} SELECT id, action FROM a WHERE action <> 'skip' ORDER BY id LIMIT 20",
    "shard_sql": f"WITH {_M} SELECT id, ('0x' || left(sha1(id::VARCHAR), 16))::UBIGINT % 4 = 1 AS mine FROM m",
    "message_by_id": f"WITH {_M} SELECT id, subject, sha256(left(body, 4000)) AS body_hash, false AS auth FROM m WHERE id = 40",
    "draft_of_message": "SELECT sha1('40|2026-01-01T00:00:00Z') AS id, '40' AS message_id, '2026-01-01T00:00:00Z' AS created_at, 'thanks' AS text, 'pending' AS status FROM documents WHERE doc_id = 40",
    "health_report": f"""WITH {_M}, {_META} SELECT 'messages' AS name, count(*) AS n FROM m UNION ALL SELECT 'embeddings', count(*) FROM embeddings UNION ALL SELECT 'embedded_ids', count(DISTINCT message_id) FROM meta
        UNION ALL SELECT 'coverage_gap', count(*) FROM m WHERE id NOT IN (SELECT message_id FROM meta) UNION ALL SELECT 'exit_code', 0 UNION ALL SELECT 'problems', 0""",
    "hits_prompt": """WITH j AS (SELECT conv_id, '[' || string_agg('{"turn": ' || turn || ', "text": ' || to_json(text) || '}', ', ' ORDER BY turn, text) || ']' AS packed FROM conversations GROUP BY 1)
        SELECT conv_id, sha256('Question:' || chr(10) || 'who?' || chr(10) || chr(10) || 'Hits:' || chr(10) || CASE WHEN length(packed) <= 600 THEN packed ELSE left(packed, 600) || '…' END) AS prompt_hash FROM j""",
    "auth_shaped": f"WITH {_M} SELECT id, id % 3 = 0 OR id % 5 = 0 AS auth FROM m",
    "shard_count": f"WITH {_M} SELECT (('0x' || left(sha1(id::VARCHAR), 16))::UBIGINT % 7)::BIGINT AS shard, count(*) AS n FROM m GROUP BY 1",
    "length_bands": f"""WITH {_M}, n AS (SELECT id, length({_PAYLOAD}) AS n FROM m) SELECT id, CASE WHEN n > 1000 THEN 'too_long' ELSE 'due' END AS at_most,
        CASE WHEN n <= 1000 THEN 'too_short' ELSE 'due' END AS "over", CASE WHEN n > 2000 THEN 'too_long' WHEN n < 1500 THEN 'too_short' ELSE 'due' END AS band FROM n""",
    "recency": f"WITH {_M} SELECT id, round(CASE WHEN id % 9 = 0 THEN 1.0 ELSE {_AGE.format(now='2025-06-01 00:00:00')} END, 9) AS recency FROM m",
    "rerank_scores": f"""WITH {_M} SELECT id, CASE id % 8 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 WHEN 2 THEN 0.73 WHEN 3 THEN 0.87 WHEN 4 THEN 0.0 WHEN 7 THEN 1.0 END::DOUBLE AS score,
        round(exp(id % 5 - 2.0) / (exp(id % 5 - 2.0) + exp(2.0 - id % 5)), 9) AS yes_no FROM m""",
    "l2_normalize": """SELECT vec_id AS message_id, 1.0::DOUBLE AS norm,
        round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS "first" FROM embeddings""",
    "adapt_dims": """SELECT vec_id AS message_id, 16::BIGINT AS dims,
        round(embedding[16]::DOUBLE / sqrt(list_dot_product((embedding::DOUBLE[])[1:16], (embedding::DOUBLE[])[1:16])), 6) AS "last" FROM embeddings""",
    "lane_filter": f"WITH {_M} SELECT id, lane FROM m WHERE lower(lane) = 'de'",
    "date_window": f"""WITH {_M}, d AS (SELECT id, coalesce(CASE WHEN id % 13 <> 0 THEN date_utc END, '') AS d FROM m)
        SELECT id, d >= '2024-06-01' AND d <= '2024-06-30T23:59:59.999999Z' AS inside, d <= '2024-06-30T23:59:59.999999Z' AS "before", d >= '2024-06-01' AS "after" FROM d""",
    "text_join": f"WITH {_M} SELECT id, subject, length(body) AS n FROM m WHERE id % 4 <> 0 AND trim(body) <> ''",
    "corpus_counts": f"""WITH {_M} SELECT count(*) AS joined, count(*) FILTER (id IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS auth,
        count(*) FILTER (trim(coalesce(body, '')) = '') AS empty FROM m""",
    "meta_join": f"WITH {_M}, {_META} SELECT m.id, message_id IS NOT NULL AS meta_present, quote_stripped::BIGINT AS quote_stripped FROM m LEFT JOIN meta ON message_id = m.id",
    "coverage": f"""WITH {_M}, {_META} SELECT (SELECT count(*) FROM m) AS messages, (SELECT count(*) FROM embeddings) AS embeddings,
        (SELECT count(DISTINCT message_id) FROM meta) AS embedded_ids, (SELECT count(*) FROM m WHERE id NOT IN (SELECT message_id FROM meta)) AS coverage_gap""",
    "integrity": "SELECT (SELECT count(*) FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1)) AS repeated_ids, (SELECT count(*) FROM documents WHERE doc_id IS NULL) AS null_ids, (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents)) AS orphan_records",
    "vector_dimensions": "SELECT DISTINCT len(embedding) AS dims FROM embeddings",
    "incremental_action": f"WITH {_M}, {_META}, {_ACTIONS} SELECT id, action FROM a",
    "incremental_counts": f"""WITH {_M}, {_META}, {_ACTIONS} SELECT count(*) AS examined, count(*) FILTER (action = 'missing') AS missing, count(*) FILTER (action = 'stale') AS stale,
        count(*) FILTER (action = 'skip' AND stored <> '') AS skipped_quote_stripped, count(*) FILTER (action = 'skip' AND stored = '') AS skipped_legacy_embedded,
        count(*) FILTER (action <> 'skip') AS candidates FROM a""",
    "candidate_reasons": f"WITH {_M}, {_META}, {_REASONS} SELECT id, reason, changed FROM r",
    "candidate_counts": f"""WITH {_M}, {_META}, {_REASONS} SELECT count(*) AS examined, count(*) FILTER (reason = 'already') AS already, count(*) FILTER (reason = 'too_long') AS too_long,
        count(*) FILTER (reason = 'too_short') AS too_short, count(*) FILTER (changed) AS hash_changed, count(*) FILTER (reason = 'due') AS due FROM r""",
    "candidate_batch": f"WITH {_M}, {_META}, {_ACTIONS} SELECT id, action FROM a WHERE action <> 'skip' ORDER BY id LIMIT 100",
    "merge_missing": f"""WITH {_M}, {_META}, o AS (SELECT message_id IN (SELECT doc_id FROM labels) AS known, message_id IN (SELECT page_id FROM pages) AS held FROM meta),
        c AS (SELECT count(*) AS examined, count(*) FILTER (NOT known AND held) AS inserted, count(*) FILTER (known) AS skipped, count(*) FILTER (NOT known AND NOT held) AS missing_vector FROM o)
        SELECT *, skipped + inserted AS records, (SELECT count(*) FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels)) + inserted AS vectors FROM c""",
    "fts_hit_count": f"WITH {_M}, {_bm25(1.0)} SELECT query_id::BIGINT AS query_id, count(*) AS hits FROM s GROUP BY 1",
    "bm25_top50": f"WITH {_M}, {_bm25(1.0)}, {_FTS} SELECT query_id::BIGINT AS query_id, id, score, fts_rank FROM f",
    "bm25_subject_boost": f"WITH {_M}, {_bm25(5.0)}, {_FTS} SELECT query_id::BIGINT AS query_id, id, score, fts_rank FROM f",
    "bm25_lane_filter": f"""WITH {_M}, {_bm25(5.0)} SELECT s.query_id::BIGINT AS query_id, s.id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, s.id) AS fts_rank
        FROM s JOIN m ON m.id = s.id WHERE lane = CASE WHEN query_id = 2 THEN 'de' ELSE 'en' END QUALIFY fts_rank <= 50""",
    "index_upkeep": f"""WITH {_M.replace('m AS (', 'm0 AS (', 1)}, m AS (SELECT id, CASE WHEN contains(lower(subject), 'with') THEN 'with the' WHEN contains(lower(subject), 'that') THEN 'that the' ELSE subject END AS subject,
            CASE WHEN NOT contains(lower(subject), 'with') AND NOT contains(lower(subject), 'that') AND id IN (SELECT doc_id FROM labels) THEN 'that the and with ' ELSE '' END || coalesce(body, '') AS body, from_addr
            FROM m0 WHERE contains(lower(subject), 'with') OR contains(lower(subject), 'that') OR id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)), {_bm25(5.0)}
        SELECT query_id::BIGINT AS query_id, id, score, fts_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS fts_rank FROM s) WHERE fts_rank <= 50""",
    "bm25_stemmed": f"""WITH {_M}, b AS (SELECT item_id AS query_id, array_to_string(list_transform({_tokens('text')}[1:2], lambda x: x || CASE WHEN length(x) % 2 = 0 THEN 's' ELSE 'ing' END), ' ') || ' thes' AS text FROM benchmark),
        q AS (SELECT DISTINCT query_id, unnest({_tokens('text')}) AS phrase FROM b WHERE len(regexp_extract_all(text, '[A-Za-z0-9_]+')) = len({_tokens('text')})
              UNION SELECT query_id, unnest(flatten(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda x: {_tokens('x')}))) FROM b), {_bm25_phrases(5.0)}
        SELECT query_id, id, score, fts_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS fts_rank FROM s) WHERE fts_rank <= 50""",
    "benchmark_batch": f"""WITH {_M}, p AS (SELECT DISTINCT item_id, phrase FROM (SELECT item_id, array_to_string(regexp_extract_all(strip_accents(lower(unnest(
            CASE WHEN regexp_matches(text, '[A-Za-z0-9_]') THEN regexp_extract_all(text, '[A-Za-z0-9_]+(?:[-.][A-Za-z0-9_]+)*') ELSE [coalesce(text, '')] END))), '[\\p{{L}}\\p{{N}}]+'), ' ') AS phrase FROM benchmark) WHERE phrase <> ''),
        f AS (SELECT id, ' ' || unnest([{', '.join(f"array_to_string({_tokens(c)}, ' ')" for c in ('subject', 'body', 'from_addr'))}]) || ' ' AS line FROM m),
        h AS (SELECT DISTINCT x.phrase, f.id FROM (SELECT DISTINCT phrase FROM p) x JOIN f ON contains(f.line, ' ' || x.phrase || ' ')),
        n AS (SELECT item_id, count(*) AS phrases FROM p GROUP BY 1),
        r AS (SELECT item_id, id FROM p JOIN h USING (phrase) JOIN n USING (item_id) GROUP BY item_id, id, phrases HAVING count(*) = phrases)
        SELECT item_id AS query_id, count(*) AS hits FROM r GROUP BY 1""",
    "subject_then_body_hits": f"""WITH {_M}, {_bm25(5.0, {0: 'that the'})}, x AS (SELECT id, 0 AS part, 0::BIGINT AS nth FROM (SELECT id FROM m WHERE lower(subject) LIKE '%that%' AND lower(subject) LIKE '%the%' ORDER BY id LIMIT 20)
            UNION ALL SELECT id, 1, nth FROM (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS nth FROM s) WHERE nth <= 20),
        o AS (SELECT id, part, nth FROM x QUALIFY row_number() OVER (PARTITION BY id ORDER BY part, nth) = 1)
        SELECT id, row_number() OVER (ORDER BY part, nth, id) AS pos FROM o QUALIFY pos <= 20""",
    "stream_available_now": f"""WITH {_M}, c AS (SELECT *, {_CLEAN} AS clean FROM m WHERE trim(coalesce(body, '')) <> ''),
        d AS (SELECT id, clean, left('Subject: ' || {_strip('subject')} || chr(10) || 'From: ' || {_strip('from_addr')} || chr(10) || 'To: ' || chr(10) || 'Date: ' || date_utc || chr(10) || 'Lane: ' || {_strip('lane')} ||
            CASE WHEN clean <> '' THEN chr(10) || chr(10) || clean ELSE '' END, 16000) AS doc FROM c)
        SELECT id::VARCHAR AS message_id, 'qwen3-embedding-8b' AS model, sha256(doc) AS text_hash, length(doc) AS char_count, 2::BIGINT AS dims, 1 AS quote_stripped, sha256(clean) AS content_hash FROM d""",
    "stream_again": f"""WITH {_M} SELECT count(*) AS examined, 0::BIGINT AS missing, 0::BIGINT AS stale, count(*) AS skipped_quote_stripped, 0::BIGINT AS skipped_legacy_embedded, 0::BIGINT AS candidates
        FROM m WHERE trim(coalesce(body, '')) <> ''""",
    "subject_like": f"WITH {_M} SELECT id FROM m WHERE lower(subject) LIKE '%the%' AND lower(subject) LIKE '%re%'",
    "identifier_hits": """WITH i AS (SELECT doc_id AS id, doc_id % 7 = 3 AS a, doc_id = 17 OR doc_id % 7 = 1 AS b FROM documents)
        , r AS (SELECT 1::BIGINT AS query_id, id, row_number() OVER (ORDER BY id) AS ids_rank, count(*) OVER () AS hits, min(id) OVER () AS low, max(id) OVER () AS high FROM i WHERE a
        UNION ALL SELECT 2, id, row_number() OVER (ORDER BY id <> 17, id), count(*) OVER (), min(id) OVER (), max(id) OVER () FROM i WHERE b) SELECT * FROM r WHERE ids_rank <= 50""",
    "knn_top50": f"WITH {_knn(50)} SELECT query_id, id, round(distance, 9) + 0.0::DOUBLE AS distance, vec_rank FROM v",
    "knn_by_cells": f"WITH {_knn(50)} SELECT query_id, id, round(distance, 9) + 0.0::DOUBLE AS distance, vec_rank FROM v",
    "cosine_search": f"""WITH {_M}, {_knn(10)} SELECT query_id, v.id, subject, from_addr, round(1 - distance, 9) AS score, round(distance, 9) + 0.0::DOUBLE AS distance, snippet FROM v LEFT JOIN m ON m.id = v.id""",
    "knn_post_filter": f"""WITH {_M}, {_knn(50)} SELECT query_id, v.id, row_number() OVER (PARTITION BY query_id ORDER BY vec_rank) AS vec_rank
        FROM v LEFT JOIN m ON m.id = v.id WHERE coalesce(lane, '') = 'en' AND coalesce(date_utc, '') >= '2024-02-01'""",
    "rrf_fuse": f"WITH {_M}, {_bm25(5.0)}, {_LISTS}, {_knn(50)}, {_FUSED} SELECT query_id::BIGINT AS query_id, id, fts_rank, vec_rank, 1000::BIGINT AS ids_rank, round(rrf, 9) AS rrf FROM u",
    "rrf_identifiers": f"""WITH {_M}, {_bm25(5.0)}, {_LISTS}, {_knn(50)}, {_FUSED},
        i AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY id) AS ids_rank FROM f WHERE id % 5 = 0)
        SELECT query_id::BIGINT AS query_id, id, fts_rank, vec_rank, coalesce(ids_rank, 1000) AS ids_rank, round(rrf + 1.0 / (60 + coalesce(ids_rank, 1000)), 9) AS rrf
        FROM u LEFT JOIN i USING (query_id, id)""",
    "hybrid_rrf": f"WITH {_HITS} SELECT query_id::BIGINT AS query_id, id, pos, fts_rank, vec_rank, round(rrf, 9) AS rrf FROM h WHERE pos <= 20",
    "rerank_head_tail": f"""WITH {_HITS} SELECT query_id::BIGINT AS query_id, id, CASE WHEN pos <= 20 THEN row_number() OVER (PARTITION BY query_id ORDER BY pos > 20,
        coalesce(rerank, 0) DESC, rrf DESC, id) ELSE pos END AS pos, CASE WHEN pos <= 20 THEN rerank END AS rerank FROM h""",
    "thread_packs": f"WITH {_HITS}, {_PACK.format(k=20)} SELECT query_id::BIGINT AS query_id, id, pack_pos FROM p",
    "thread_root_last3": f"""WITH {_M}, g AS (SELECT thread_id, id, date_utc FROM m WHERE thread_id IS NOT NULL),
        {_SPINE.format(members='g')} SELECT thread_id, id, part, nth FROM k""",
    "conversation_spine": f"""WITH g AS (SELECT conv_id AS thread_id, conv_id * 1000 + turn AS id, CASE WHEN turn <> 1 THEN lpad(turn::VARCHAR, 6, '0') END AS date_utc FROM conversations),
        {_SPINE.format(members='g')} SELECT thread_id, id, part, nth FROM k""",
    "thread_spine": f"""WITH {_HITS}, {_PACK.format(k=5)}, g AS (SELECT thread_id, id, date_utc FROM m WHERE thread_id IS NOT NULL), {_SPINE.format(members='g')},
        {_EXPANDED}
        SELECT x.query_id::BIGINT AS query_id, x.id, row_number() OVER (PARTITION BY x.query_id ORDER BY x.pack_pos, x.part, x.nth) AS out_pos, in_pack,
               coalesce(h.fts_rank, 1000) AS fts_rank, coalesce(h.vec_rank, 1000) AS vec_rank, round(coalesce(h.rrf, 0), 9) AS rrf, h.rerank::DOUBLE AS rerank
        FROM x LEFT JOIN h ON h.query_id = x.query_id AND h.id = x.id""",
    "hybrid_retrieve": f"""WITH {_M}, kinds(k, text, lane, after, before) AS (VALUES {_kinds()}),
        asked AS (SELECT vec_id AS query_id, kinds.* FROM embeddings JOIN kinds ON k = vec_id // {EVERY} % {len(KINDS)} WHERE vec_id % {EVERY} = 0),
        q AS (SELECT DISTINCT query_id, unnest(string_split(text, ' ')) AS phrase FROM asked), {_bm25_phrases(5.0)}, {_knn(50).replace("q AS (", "qv AS (", 1).replace("FROM q,", "FROM qv,", 1)},
        lim AS (SELECT query_id, 0 AS variant, coalesce(lane, CASE WHEN contains(text, 'invoice') THEN 'money' END) AS want, after AS lo, before || 'T23:59:59.999999Z' AS hi FROM asked
                UNION ALL SELECT query_id, 1, NULL, after, before || 'T23:59:59.999999Z' FROM asked WHERE lane IS NULL AND contains(text, 'invoice')),
        f0 AS (SELECT s.query_id, variant, s.id, row_number() OVER (PARTITION BY s.query_id, variant ORDER BY score DESC, s.id) AS fts_rank
               FROM s JOIN lim USING (query_id) LEFT JOIN m ON m.id = s.id WHERE {_INSIDE} QUALIFY fts_rank <= 50),
        v0 AS (SELECT v.query_id, variant, v.id, row_number() OVER (PARTITION BY v.query_id, variant ORDER BY vec_rank) AS vec_rank
               FROM v JOIN lim USING (query_id) LEFT JOIN m ON m.id = v.id WHERE {_INSIDE}),
        turn AS (SELECT query_id, NOT EXISTS (SELECT 1 FROM v0 WHERE v0.query_id = lim.query_id AND variant = 0) AS free_vec,
                        NOT EXISTS (SELECT 1 FROM f0 WHERE f0.query_id = lim.query_id AND variant = 0) AS no_fts FROM lim WHERE variant = 1),
        fc AS (SELECT f0.* FROM f0 LEFT JOIN turn USING (query_id) WHERE variant = coalesce((free_vec AND no_fts)::INT, 0)),
        vc AS (SELECT v0.* FROM v0 LEFT JOIN turn USING (query_id) WHERE variant = coalesce(free_vec::INT, 0)),
        u AS (SELECT query_id, id, coalesce(fts_rank, 1000) AS fts_rank, coalesce(vec_rank, 1000) AS vec_rank, {_RRF} AS rrf FROM fc FULL JOIN vc USING (query_id, id)),
        h0 AS (SELECT u.query_id, u.id, fts_rank, vec_rank, thread_id, date_utc, rrf * CASE WHEN after IS NOT NULL OR before IS NOT NULL OR date_utc IS NULL THEN 1 ELSE {_AGE.format(now='2026-01-01 00:00:00')} END AS rrf
               FROM u JOIN asked ON asked.query_id = u.query_id LEFT JOIN m ON m.id = u.id),
        h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, id) AS pos FROM h0),
        {_PACK.format(k=20)}, g AS (SELECT thread_id, id, date_utc FROM m WHERE thread_id IS NOT NULL), {_SPINE.format(members='g')}, {_EXPANDED},
        z AS (SELECT x.query_id, x.id, row_number() OVER (PARTITION BY x.query_id ORDER BY x.pack_pos, x.part, x.nth) AS out_pos, h.fts_rank, h.vec_rank, h.rrf FROM x LEFT JOIN h ON h.query_id = x.query_id AND h.id = x.id)
        SELECT z.query_id::BIGINT AS query_id, out_pos, z.id AS message_id, NULL::VARCHAR AS chunk_id, thread_id, date_utc AS date, from_addr AS "from", subject, snippet, coalesce(fts_rank, 1000) AS fts_rank,
               coalesce(vec_rank, 1000) AS vec_rank, round(coalesce(rrf, 0), 9) AS rrf, NULL::DOUBLE AS rerank, lane FROM z LEFT JOIN m ON m.id = z.id""",
    "get_thread": f"WITH {_M} SELECT id, thread_id, date_utc FROM m WHERE thread_id = 40 OR id = 40",
    "citation_order": f"WITH {_HITS}, {_CITED.format(where='WHERE pos <= 30')} SELECT query_id::BIGINT AS query_id, id, citation FROM c",
    "allowed_citations": "SELECT doc_id * 3 AS id, doc_id AS pos FROM documents WHERE doc_id * 3 IN (SELECT doc_id FROM documents)",
    "search_smoke": f"WITH {_HITS} SELECT query_id::BIGINT AS query_id, count(*) AS hits, count(*) FILTER (vec_rank < 1000) AS vec_real, count(*) FILTER (vec_rank >= 1000) AS vec_missing FROM h GROUP BY 1",
    "prompt_blocks": f"""WITH {_HITS}, {_CITED.format(where='')}, b AS (SELECT query_id, '{DATA_BEGIN}' || chr(10) || coalesce(string_agg('message_id: ' || id || chr(10) || 'thread_id: ' ||
            coalesce(thread_id::VARCHAR, '') || chr(10) || 'date: ' || date_utc || chr(10) || 'from: ' || from_addr || chr(10) || 'subject: ' || subject || chr(10) || 'body:' || chr(10) ||
            left(coalesce(nullif(body, ''), nullif(snippet, ''), ''), 4000), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY citation) FILTER (id % 4 <> 0), '(no mail data)') || chr(10) || '{DATA_END}' AS block
            FROM c JOIN m USING (id) WHERE citation <= 8 GROUP BY query_id)
        SELECT query_id::BIGINT AS query_id, sha256(block) AS block_hash, length(block) AS n FROM b""",
    "audit_log": f"""WITH {_HITS}, {_CITED.format(where='')}, a AS (SELECT query_id, count(*) AS n, string_agg(id::VARCHAR, ',' ORDER BY citation) AS ids FROM c WHERE citation <= 8 GROUP BY 1),
        texts(words, query) AS (VALUES {', '.join(f"({q}, '{t}')" for q, t in TERMS.items())}),
        all_asked AS (SELECT query_id, query FROM asked JOIN texts USING (words) UNION ALL SELECT -1, 'nothing')
        SELECT '2026-01-01T00:00:00Z' AS ts, 'test' AS actor, query, 8::BIGINT AS k, coalesce(n, 0) AS hit_count, coalesce(ids, '') AS hit_ids,
               '{{"generate_mode":"hits_only"}}' AS detail FROM all_asked LEFT JOIN a USING (query_id)""",
}
