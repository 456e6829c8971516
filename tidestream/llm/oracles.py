"""DuckDB SQL of the operators' queries that SQL can express. What isn't here is held against brute force in tests/llm."""

from __future__ import annotations

from tidestream.llm import audit, chat, fim, mixing, quality, warc

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _rates() -> tuple[str, str, str]:
    """Of each rule: its count of failures, its moments over hosts, its shrunk rate."""
    counts = ", ".join(f"count(*) FILTER (WHERE {c}) AS f_{r}" for r, c in quality.RULES.items())
    moments = ", ".join(f"avg(f_{r} / n) AS m_{r}, var_samp(f_{r} / n) AS v_{r}" for r in quality.RULES)
    strength = {r: f"CASE WHEN v_{r} > 0 THEN least(greatest(m_{r} * (1 - m_{r}) / v_{r} - 1, {quality.PRIOR_LEAST}), {quality.PRIOR_MOST}) ELSE {quality.PRIOR} END" for r in quality.RULES}
    rates = ", ".join(f"(f_{r} + m_{r} * ({s})) / (n + ({s}))" for r, s in strength.items())
    return counts, moments, f"greatest({rates})"


_COUNTS, _MOMENTS, _RATE = _rates()

QUALITY = rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, {_WORDS} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
     windows AS (SELECT r, i, array_to_string(w[i:i + {quality.WINDOW - 1}], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - {quality.WINDOW - 2})) AS i FROM docs)),
     twice AS (SELECT r, i FROM windows WHERE (r, g) IN (SELECT (r, g) FROM windows GROUP BY r, g HAVING count(*) > 1)),
     covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range({quality.WINDOW}) AS t(k) GROUP BY r),
     f AS (SELECT doc_id, source, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(text) - length(regexp_replace(text, '{quality.SYMBOLS}', '', 'g')) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(c.n, 0) AS n_repeat_words FROM docs LEFT JOIN covered c USING (r)),
     hosts AS (SELECT source, count(*)::DOUBLE AS n, {_COUNTS} FROM f GROUP BY source),
     moments AS (SELECT {_MOMENTS} FROM hosts),
     rates AS (SELECT source, {_RATE} AS rate FROM hosts, moments),
     judged AS (SELECT f.*, rate, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f JOIN rates ON f.source IS NOT DISTINCT FROM rates.source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate <= {quality.HOST_LIMIT} AS kept, round(rate, 6) AS host_rate FROM judged"""

SUBSTRING = f"""
WITH docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
     windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM docs)),
     least AS (SELECT g, min(doc_id) AS first FROM windows GROUP BY g HAVING count(*) > 1),
     gone AS (SELECT DISTINCT doc_id, i + k AS i FROM windows JOIN least USING (g), range(13) AS t(k) WHERE doc_id > first),
     words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM docs),
     kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM docs LEFT JOIN kept USING (doc_id)"""

_SAID = "</s>[INST] ok [/INST]"
_ESCAPED = r"regexp_replace(%s, '<(\\*)\|', '<\1\\|', 'g')"

CHAT = f"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
         UNION ALL VALUES (-7, 0, 'user', '{_SAID}'), (-7, 1, 'assistant', '{_SAID}')),
     joined AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS NOT DISTINCT FROM role AS same FROM turns),
     sized AS (SELECT *, length({_ESCAPED % 'text'}) + CASE WHEN same THEN {len(chat.NEXT)} ELSE {len(chat.START + chat.TEXT + chat.END)} + length({_ESCAPED % 'role'}) END AS size FROM joined)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = '{chat.LEARNED}'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = '{chat.LEARNED}'), '')) AS loss_sha256, sum(size)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id"""

NEAR = r"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
     sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS s FROM docs),
     shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
     links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id != b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
         GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
     reach AS (SELECT doc_id AS a, doc_id AS b FROM docs UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT doc_id, len(s) AS n_shingles, c.component_id, doc_id = c.component_id AS kept FROM sets JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)"""

WARC = rf"""
WITH rows AS (SELECT page_id, regexp_replace(coalesce(url, ''), '[\x00-\x20\x7F]', '', 'g') AS url, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
     firsts AS (SELECT *, CASE WHEN payload_bytes >= {warc.LEAST_SHARED} THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first,
         regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)(?::[0-9]*)?([^#]*)', ['host', 'tail']) AS u FROM rows)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first != page_id THEN first END AS refers_to,
       array_to_string(list_reverse(string_split(regexp_replace(lower(u.host), '^www[0-9]*\.', ''), '.')), ',') || ')' || CASE WHEN u.tail = '' THEN '/' ELSE lower(u.tail) END AS url_key,
       strftime(make_timestamp(({warc.EPOCH} + page_id) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS captured
FROM firsts"""


def _mixing() -> str:
    turn = f"(row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % {len(mixing.WEIGHTS)} + 1"
    position = lambda done: f"round(CASE WHEN tilt = 0 THEN ({done}) / target ELSE (sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * ({done}) / target) - (1 - tilt)) / (2 * tilt) END, 9)"
    take = lambda start: f"greatest(0, least(size, floor(target)::BIGINT - {start}))"
    return rf"""
WITH RECURSIVE docs AS (SELECT doc_id, source, len({_WORDS}) AS size, md5(coalesce(doc_id::VARCHAR, '')) AS rank FROM documents),
     sources AS (SELECT source, sum(size)::BIGINT AS source_size, {list(mixing.WEIGHTS)}[{turn}] AS weight, {list(mixing.TILTS)}[{turn}]::DOUBLE AS tilt FROM docs GROUP BY source),
     rounds AS (  -- each round shares what the full sources leave by weight, and fills those it would take above their most
         SELECT 0 AS step, []::VARCHAR[] AS full_, {mixing.SHARE} * sum(source_size)::DOUBLE / sum(weight) AS level FROM sources
         UNION ALL
         SELECT step + 1, full_ || more, (SELECT ({mixing.SHARE} * sum(source_size) - coalesce(sum({mixing.MOST} * source_size) FILTER (WHERE list_contains(full_ || more, coalesce('s' || source, 'n'))), 0))
             / sum(weight) FILTER (WHERE NOT list_contains(full_ || more, coalesce('s' || source, 'n'))) FROM sources)
         FROM (SELECT *, (SELECT list(coalesce('s' || source, 'n')) FROM sources WHERE weight * level > {mixing.MOST} * source_size AND NOT list_contains(full_, coalesce('s' || source, 'n'))) AS more FROM rounds) WHERE len(more) > 0),
     targets AS (SELECT source, source_size, tilt, least(weight * level, {mixing.MOST} * source_size)::DOUBLE AS target FROM sources, (SELECT level FROM rounds ORDER BY step DESC LIMIT 1)),
     placed AS (SELECT doc_id, size, source_size, tilt, target, sum(size) OVER (PARTITION BY docs.source ORDER BY rank, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT - size AS start FROM docs JOIN targets ON docs.source IS NOT DISTINCT FROM targets.source),
     taken AS (SELECT *, {take('start')} AS once, {take('(start + source_size)')} AS again FROM placed)
SELECT doc_id, size, source_size, target, once + again AS taken, CASE WHEN once > 0 THEN {position('start + once / 2')} END AS first_position,
       CASE WHEN again > 0 THEN {position('start + source_size + again / 2')} END AS second_position FROM taken"""


FILL = f"""
WITH docs AS (SELECT coalesce(text, '') AS t, length(coalesce(text, '')) AS n, doc_id, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
     drawn AS (SELECT *, [('0x' || substr(h, 8 * k + 1, 8))::BIGINT FOR k IN [0, 1, 2, 3]] AS x FROM docs),
     cut AS (SELECT *, least(x[1] % (n + 1), x[2] % (n + 1)) AS a, greatest(x[1] % (n + 1), x[2] % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '{fim.PREFIX}') OR contains(t, '{fim.SUFFIX}') OR contains(t, '{fim.MIDDLE}') OR x[3] % 100 >= {100 - fim.PLAIN} THEN 'plain' WHEN x[4] % 100 < {fim.SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM drawn),
     parts AS (SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1, n - b) AS s FROM cut)
SELECT doc_id, n, form, CASE WHEN form != 'plain' THEN a END AS prefix_chars, CASE WHEN form != 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{fim.PREFIX}' || p || '{fim.SUFFIX}' || s || '{fim.MIDDLE}' || m ELSE '{fim.SUFFIX}' || s || '{fim.PREFIX}' || p || '{fim.MIDDLE}' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts"""

_LETTERS = ", ".join(f"('{x}')" for x in audit.FILTERS)

AUDIT = rf"""
WITH RECURSIVE letters(f) AS (VALUES {_LETTERS}),
     docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
     firsts AS (SELECT t, min(doc_id) AS first FROM docs GROUP BY t),
     said AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
     failed AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         [len(w) < {audit.WORDS}, 100 * len(list_distinct(w)) < {audit.DISTINCT} * len(w), 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > {audit.CAPITALS} * length(t), regexp_matches(t, '{audit.SYMBOL}'), coalesce(docs.doc_id > first, false)] AS fails
         FROM docs JOIN firsts USING (t) LEFT JOIN said ON docs.doc_id = said.doc_id),
     cells AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM failed GROUP BY part, fails),
     orders AS (SELECT '' AS o UNION ALL SELECT o || f FROM orders, letters WHERE NOT contains(o, f)),
     steps AS (SELECT o, step, instr('{audit.FILTERS}', o[step]) AS own, [instr('{audit.FILTERS}', o[i]) FOR i IN range(1, step)] AS before FROM orders, range(1, 6) AS r(step) WHERE length(o) = 5),
     rows AS (SELECT part, o, step, own, n, good, toxic, fails[own] AS f, list_any_value(list_filter(list_transform(before, lambda i: fails[i]), lambda x: x)) IS NOT NULL AS gone, len(list_filter(fails, lambda x: x)) = 1 AND fails[own] AS alone FROM steps, cells),
     audit AS (SELECT part, o AS filter_order, step::INT AS step, own, coalesce(sum(n) FILTER (NOT f AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (f AND NOT gone), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (f AND gone), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (alone), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (f AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (f AND NOT gone), 0)::BIGINT AS toxic_lost FROM rows GROUP BY part, o, step, own)
SELECT * EXCLUDE (own), (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM audit"""


ORACLES = {
    "op1_quality_rules": QUALITY,
    "op3_substring_dedup": SUBSTRING,
    "op5_chat_formatting": CHAT,
    "op7_minhash_dedup": NEAR,
    "op8_warc": WARC,
    "op9_source_mixing": _mixing(),
    "op11_fill_in_middle": FILL,
    "op12_filter_audit": AUDIT,
}
