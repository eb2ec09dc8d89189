"""DuckDB SQL for the queries of this package, written from their definitions."""

from __future__ import annotations

P = r"[ \t\r\n]*[^ \t\r\n]+|[ \t\r\n]+"
TOK = f"""tok AS (SELECT CAST(doc_id AS VARCHAR) AS sample_id, unnest(regexp_extract_all(text, '{P}')) AS token,
    CAST(generate_subscripts(regexp_extract_all(text, '{P}'), 1) - 1 AS BIGINT) AS pos FROM documents)"""
ID = "CAST('0x' || md5(token)[1:8] AS BIGINT)"
TAG_ROWS = [("^[ \\t\\r\\n]*[0-9]+[^ \\t\\r\\n]*$", "number"), ("^[ \\t\\r\\n]*[A-Z]+$", "capitals"), ("^[ \\t\\r\\n]*[A-Z][a-z]+$", "title"), ("[.,;:!?]$", "punct"), ("^[ \\t\\r\\n]+$", "whitespace"), ("^[ \\t\\r\\n]*[A-Da-d][.)]?$", "choice_letter"), ("[#$%&*]", "number")]
HITS = "hit AS (" + " UNION ".join(f"SELECT sample_id, pos, '{t}' AS name FROM tok WHERE regexp_matches(token, '{p}')" for p, t in TAG_ROWS) + ")"
# Islands of consecutive positions by sample and name.
ISLANDS = """isl AS (SELECT sample_id, name, min(pos) AS "start", max(pos) + 1 AS "end" FROM (SELECT *, pos - row_number() OVER (PARTITION BY sample_id, name ORDER BY pos) AS g FROM hit) GROUP BY sample_id, name, g)"""
WORDS = f"WITH {TOK}, {HITS}, {ISLANDS}"
MSG = "msg AS (SELECT conv_id, CAST(conv_id AS VARCHAR) AS sample_id, turn, role, text AS content FROM conversations)"
REND = "rend AS (SELECT sample_id, min(conv_id) AS conv_id, '<s>' || string_agg('[' || role || ']' || coalesce(content, '') || '[end]', '' ORDER BY turn) AS text FROM msg GROUP BY sample_id)"
CH = "ch AS (SELECT sample_id, conv_id, unnest(string_split(text, '')) AS token, CAST(generate_subscripts(string_split(text, ''), 1) - 1 AS BIGINT) AS pos FROM rend)"
CHARS = f"WITH {MSG}, {REND}, {CH}"
# Message contents follow each other in the rendering, so their places are running sums.
SPANS = """place AS (SELECT *, CAST(3 + coalesce(sum(length(role) + length(coalesce(content, '')) + 7) OVER (PARTITION BY sample_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s FROM msg),
span AS (SELECT sample_id, turn, role, s + length(role) + 2 AS cs, s + length(role) + 2 + length(content) AS ce FROM place WHERE coalesce(content, '') <> '')"""
ROLES = f"""{CHARS}, {SPANS}, hit AS (SELECT ch.sample_id, ch.pos, coalesce(span.role, 'template') AS name FROM ch LEFT JOIN span ON ch.sample_id = span.sample_id AND pos >= cs AND pos < ce), {ISLANDS}"""
GEN = """gen AS (SELECT span.sample_id, cs, ce FROM span WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY turn DESC) = 1)"""
GRAMS = """k AS (SELECT count(DISTINCT sample_id) AS k FROM ch), f AS (SELECT sample_id FROM rend ORDER BY conv_id LIMIT 1),
gram AS (SELECT sample_id, pos, token || lead(token) OVER w || lead(token, 2) OVER w || lead(token, 3) OVER w || lead(token, 4) OVER w AS gram FROM ch WINDOW w AS (PARTITION BY sample_id ORDER BY pos)),
common AS (SELECT gram FROM gram WHERE gram IS NOT NULL GROUP BY gram HAVING count(DISTINCT sample_id) = (SELECT k FROM k))"""
RUNS = f"""{GRAMS}, hot AS (SELECT gram.* FROM gram JOIN common USING (gram)),
dia AS (SELECT o.sample_id, m.pos AS i, o.pos - m.pos AS d FROM hot o JOIN hot m USING (gram) WHERE m.sample_id = (SELECT sample_id FROM f) AND o.sample_id <> (SELECT sample_id FROM f)),
run AS (SELECT *, i - row_number() OVER (PARTITION BY sample_id, d ORDER BY i) AS g FROM dia),
reach AS (SELECT sample_id, i, max(i) OVER (PARTITION BY sample_id, d, g) - i + 5 AS r FROM run),
runs AS (SELECT i AS pos, CAST(min(r) AS BIGINT) AS len FROM (SELECT sample_id, i, max(r) AS r FROM reach GROUP BY ALL) GROUP BY i HAVING count(*) = (SELECT k FROM k) - 1)"""


def _text_tag(pick: str) -> str:
    group = "" if pick == "all" else f"QUALIFY row_number() OVER (PARTITION BY o.sample_id, s ORDER BY o.pos {'DESC' if pick == 'last' else ''}) = 1"
    return f"""WITH {TOK}, off AS (SELECT sample_id, pos, CAST(sum(length(token)) OVER (PARTITION BY sample_id ORDER BY pos) AS BIGINT) AS ce, length(token) AS n FROM tok),
parts AS (SELECT CAST(doc_id AS VARCHAR) AS sample_id, unnest(string_split(text, 'of th')) AS part, generate_subscripts(string_split(text, 'of th'), 1) AS k, len(string_split(text, 'of th')) AS m FROM documents),
hit AS (SELECT sample_id, sum(length(part) + 5) OVER (PARTITION BY sample_id ORDER BY k) - 5 AS s, k, m FROM parts),
pick AS (SELECT o.sample_id, o.pos FROM off o JOIN hit h ON o.sample_id = h.sample_id AND k < m AND o.ce > s AND o.ce - o.n < s + 5 {group})
SELECT DISTINCT sample_id, pos FROM pick"""


LABELS = "lab AS (SELECT CAST(doc_id AS VARCHAR) AS sample_id, quality = 1 AS verdict FROM labels)"
COUNTS = "cnt AS (SELECT CAST(doc_id AS VARCHAR) AS sample_id, lang, n FROM documents JOIN (SELECT sample_id, count(*) AS n FROM tok GROUP BY sample_id) t ON t.sample_id = CAST(doc_id AS VARCHAR))"
OFFS = f"""WITH {TOK}, n AS (SELECT sample_id, count(*) AS n FROM tok GROUP BY sample_id),
off AS (SELECT CAST(doc_id AS VARCHAR) AS sample_id, CAST(sum(coalesce(n, 0)) OVER (ORDER BY doc_id) - coalesce(n, 0) AS BIGINT) AS "start", CAST(sum(coalesce(n, 0)) OVER (ORDER BY doc_id) AS BIGINT) AS "end" FROM documents LEFT JOIN n ON n.sample_id = CAST(doc_id AS VARCHAR))"""
WINDOWS = f"""WITH {TOK}, win AS (SELECT sample_id, pos AS s, pos + pos % 7 AS e FROM tok WHERE regexp_matches(token, '[.,]$') AND pos % 7 > 0)"""

ORACLES: dict[str, str] = {
    "tokenize_docs": f"WITH {TOK} SELECT sample_id, pos, {ID} AS id, token FROM tok",
    "tag_multi": f'{WORDS} SELECT name, count(*) AS n_ranges, CAST(sum("end" - "start") AS BIGINT) AS n_tokens, count(DISTINCT sample_id) AS n_samples FROM isl GROUP BY name',
    "annotation_ranges": f'{WORDS} SELECT sample_id, name, "start", "end" FROM isl',
    "char_offset_sums": f"WITH {TOK}, o AS (SELECT sample_id, length(token) AS n, sum(length(token)) OVER (PARTITION BY sample_id ORDER BY pos) AS e FROM tok) SELECT sample_id, count(*) AS n, CAST(sum(e - n) AS BIGINT) AS starts, CAST(max(e) AS BIGINT) AS n_chars FROM o GROUP BY sample_id",
    "roundtrip_text": "SELECT CAST(doc_id AS VARCHAR) AS sample_id, md5(text) AS digest FROM documents WHERE text <> ''",
    "vocabulary_ids": f"WITH {TOK}, v AS (SELECT token, count(*) AS n FROM tok GROUP BY token) SELECT token, row_number() OVER (ORDER BY encode(token)) - 1 AS vocab_id, n FROM v",
    "merge_ranges": f"""{WINDOWS}, o AS (SELECT *, max(e) OVER (PARTITION BY sample_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM win),
g AS (SELECT *, sum(CASE WHEN m IS NULL OR s > m THEN 1 ELSE 0 END) OVER (PARTITION BY sample_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM o)
SELECT sample_id, CAST(g - 1 AS BIGINT) AS range_ord, min(s) AS "start", max(e) AS "end" FROM g GROUP BY sample_id, g""",
    "expand_ranges": f"{WINDOWS}, p AS (SELECT DISTINCT sample_id, unnest(range(s, e)) AS pos FROM win) SELECT sample_id, count(*) AS n, CAST(sum(pos) AS BIGINT) AS total FROM p GROUP BY sample_id",
    "annotate_merges": f"""WITH {TOK}, hit AS (SELECT sample_id, pos, 'mark' AS name, regexp_matches(token, '^[ \\t\\r\\n]*[A-Z]') AS old FROM tok WHERE regexp_matches(token, '^[ \\t\\r\\n]*[A-Z]') OR regexp_matches(token, '[.]$')), {ISLANDS},
first AS (SELECT sample_id, CASE WHEN bool_or(old) THEN '{{}}' ELSE '{{"second":1}}' END AS metadata FROM hit GROUP BY sample_id) SELECT sample_id, "start", "end", metadata FROM isl JOIN first USING (sample_id)""",
    "tag_predicate": f"""WITH {TOK}, hit AS (SELECT sample_id, pos, 'long' AS name FROM tok WHERE length(token) > 12 UNION SELECT sample_id, pos, 'rare_id' FROM tok WHERE {ID} % 1000 = 7), {ISLANDS} SELECT sample_id, name, "start", "end" FROM isl""",
    "tag_special_tokens": f"""{CHARS}, hit AS (SELECT sample_id, pos, 'special' AS name FROM ch WHERE token IN ('<', '[')), {ISLANDS} SELECT sample_id, name, "start", "end" FROM isl""",
    "text_regex_all": _text_tag("all"),
    "text_regex_first": _text_tag("first"),
    "text_regex_last": _text_tag("last"),
    "remove_annotation": f"{WORDS} SELECT name, count(*) AS n FROM isl WHERE name <> 'title' GROUP BY name",
    "select_position": f"WITH {TOK} SELECT sample_id, pos, token FROM tok WHERE pos IN (0, 3, 10000)",
    "select_slice": f"WITH {TOK}, n AS (SELECT sample_id, count(*) AS n FROM tok GROUP BY sample_id) SELECT sample_id, pos, token FROM tok JOIN n USING (sample_id) WHERE pos <= n - 2 AND pos > n - 30 AND (n - 2 - pos) % 7 = 0",
    "select_annotation": f"{WORDS} SELECT sample_id, pos, token FROM tok WHERE regexp_matches(token, '^[ \\t\\r\\n]*[A-Z]+$')",
    "select_span": f"{WORDS} SELECT sample_id, pos, token FROM tok JOIN hit USING (sample_id, pos) WHERE name = 'number'",
    "filter_score": "SELECT CAST(doc_id AS VARCHAR) AS sample_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "get_sample": f"WITH {TOK} SELECT sample_id, pos, token FROM tok WHERE sample_id = '7'",
    "subset_samples": f"{CHARS} SELECT sample_id, count(*) AS n, CAST(sum(unicode(token)) AS BIGINT) AS ids FROM ch WHERE sample_id IN (SELECT sample_id FROM msg WHERE role = 'system') GROUP BY sample_id",
    "read_samples_order": "SELECT ord, CAST(doc_id AS VARCHAR) AS sample_id, md5(text) AS digest FROM documents JOIN (VALUES (0, 42), (1, 7), (2, 19)) v(ord, d) ON doc_id = d",
    "position_algebra": f"{WORDS} SELECT sample_id, count(*) AS n, max(pos) AS last FROM (SELECT sample_id, pos FROM hit GROUP BY ALL HAVING bool_or(name IN ('punct', 'choice_letter')) AND NOT bool_or(name = 'number')) GROUP BY sample_id",
    "render_chat": f"WITH {MSG}, {REND} SELECT sample_id, length(text) AS n_chars, md5(text) AS digest FROM rend",
    "name_messages": f"WITH {MSG} SELECT sample_id, turn, role || '_' || (row_number() OVER (PARTITION BY sample_id, role ORDER BY turn) - 1) AS name FROM msg",
    "message_ranges": f"""WITH {MSG}, {SPANS} SELECT sample_id, turn, role, role || '_' || (row_number() OVER (PARTITION BY sample_id, role ORDER BY turn) - 1) AS name,
    CASE WHEN s = 3 THEN 0 ELSE s END AS "start", s + length(role) + length(coalesce(content, '')) + 7 AS "end" FROM place""",
    "role_tags": f'{ROLES} SELECT sample_id, name, "start", "end" FROM isl',
    "role_token_counts": f"{ROLES} SELECT name, count(*) AS n FROM hit GROUP BY name",
    "generated_range": f"""{CHARS}, {SPANS}, {GEN} SELECT sample_id, 'generated' AS name, cs AS "start", ce AS "end" FROM gen""",
    "logprob_attach": f"{CHARS}, {SPANS}, {GEN} SELECT sample_id, cs + k AS pos, k % 5 AS logprob FROM gen, LATERAL (SELECT unnest(range(2, ce - cs)) AS k) WHERE CAST(sample_id AS BIGINT) % 3 <> 0",
    "ngram_intersection": f"{CHARS}, {GRAMS} SELECT gram FROM common",
    "shared_run_lengths": f"{CHARS}, {RUNS} SELECT pos, len FROM runs",
    "dedup_sequences": f"""{CHARS}, {RUNS}, txt AS (SELECT min(pos) AS pos, substr(r.text, pos + 1, len) AS text FROM runs, rend r WHERE r.sample_id = (SELECT sample_id FROM f) GROUP BY 2),
keep AS (SELECT * FROM txt a WHERE NOT EXISTS (SELECT 1 FROM txt b WHERE length(b.text) > length(a.text) AND contains(b.text, a.text)))
SELECT 'seq_' || (row_number() OVER (ORDER BY length(text) DESC, pos) - 1) AS seq_id, length(text) AS n_tokens, text FROM keep""",
    "dedup_roundtrip": f"{CHARS} SELECT sample_id, pos, CAST(unicode(token) AS BIGINT) AS id, token FROM ch",
    "dedup_materialize": f"{CHARS} SELECT sample_id, count(*) AS n, CAST(sum(unicode(token)) AS BIGINT) AS ids, nullif(count(*) FILTER (token = '['), 0) AS n_open FROM ch GROUP BY sample_id",
    "flat_offsets": f'{OFFS} SELECT sample_id, "start", "end" FROM off',
    "flat_tag_counts": f"WITH {TOK}, {HITS} SELECT name, count(*) AS n FROM hit GROUP BY name UNION ALL SELECT name, 0 FROM (VALUES ('never'), ('number'), ('capitals'), ('title'), ('punct'), ('whitespace'), ('choice_letter')) v(name) WHERE name NOT IN (SELECT name FROM hit)",
    "flat_sample_position": f'{OFFS}, ask AS (SELECT doc_id * 37 AS global_pos FROM documents) SELECT global_pos, sample_id, global_pos - "start" AS pos FROM ask JOIN off ON global_pos >= "start" AND global_pos < "end"',
    "flat_to_traces": f'{WORDS} SELECT sample_id, name, "start", "end" FROM isl',
    "sample_summaries": f"""{WORDS}, n AS (SELECT sample_id, count(*) AS n FROM tok GROUP BY sample_id), s AS (SELECT DISTINCT sample_id FROM hit WHERE name = 'number')
SELECT CAST(d.doc_id AS VARCHAR) AS sample_id, coalesce(n.n, 0) AS n_tokens, 1 AS n_texts, CASE WHEN s.sample_id IS NULL THEN 0 ELSE 1 END AS n_spans, CASE WHEN l.doc_id IS NULL THEN 0 ELSE 2 END AS n_scores, md5(substr(text, 1, 1000)) AS preview
FROM documents d LEFT JOIN n ON n.sample_id = CAST(d.doc_id AS VARCHAR) LEFT JOIN s ON s.sample_id = CAST(d.doc_id AS VARCHAR) LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "score_verdicts": f"WITH {LABELS} SELECT CAST(doc_id AS VARCHAR) AS sample_id, verdict FROM documents LEFT JOIN lab ON lab.sample_id = CAST(doc_id AS VARCHAR)",
    "accuracy": f"WITH {TOK}, {LABELS}, {COUNTS} SELECT lang, round(avg(CAST(verdict AS INT)), 6) AS accuracy, round(avg(n) FILTER (verdict), 4) AS right_len, round(avg(n) FILTER (NOT verdict), 4) AS wrong_len FROM cnt JOIN lab USING (sample_id) GROUP BY lang",
    "length_stats": f"WITH {TOK}, {COUNTS} SELECT lang, round(avg(n), 4) AS mean, CAST(median(n) AS DOUBLE) AS median, min(n) AS least, max(n) AS greatest FROM cnt GROUP BY lang",
    "answer_positions": f"""{WORDS}, n AS (SELECT sample_id, count(*) AS n FROM tok GROUP BY sample_id), l AS (SELECT sample_id, max(pos) AS pos FROM hit WHERE name = 'number' GROUP BY sample_id),
r AS (SELECT pos / n AS rel FROM l JOIN n USING (sample_id)) SELECT least(3, CAST(floor(rel * 4) AS BIGINT)) AS bucket, count(*) AS n, round(avg(rel), 6) AS mean FROM r GROUP BY 1""",
    "extra_keys": "SELECT CAST(user_id AS VARCHAR) AS sample_id, key, count(*) AS n FROM (SELECT user_id, unnest(json_keys(props)) AS key FROM events) GROUP BY ALL",
    "planted_faults": f"""{WORDS}, bad AS (SELECT name, sample_id, count(*) AS n, sum("end" - "start") AS k FROM isl WHERE CAST(sample_id AS BIGINT) % 50 = 0 AND name = 'number' GROUP BY ALL)
    SELECT 'annotation_bounds' AS rule, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_samples FROM bad HAVING count(*) > 0
    UNION ALL SELECT 'span_bounds', CAST(sum(k) AS BIGINT), count(*) FROM bad HAVING count(*) > 0
    UNION ALL SELECT 'text_offsets', count(*), count(*) FROM documents WHERE doc_id % 50 = 0 HAVING count(*) > 0""",
    "tokenize_bpe": "SELECT CAST(doc_id AS VARCHAR) AS sample_id, length(text) AS n_chars, md5(text) AS digest FROM documents WHERE text <> ''",
    "messages_to_tokens": f"WITH {MSG}, {REND} SELECT sample_id, n_messages, md5(text) AS digest FROM rend JOIN (SELECT sample_id, count(*) AS n_messages FROM msg GROUP BY sample_id) USING (sample_id)",
    "eval_messages": """SELECT CAST(conv_id AS VARCHAR) AS sample_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn, role, 'why ' || turn AS reasoning,
    md5('<think>' || chr(10) || 'why ' || turn || chr(10) || '</think>' || chr(10) || text || CASE WHEN turn % 3 = 2 THEN CASE WHEN text = '' THEN '' ELSE chr(10) END || 'lookup: {"turn":' || turn || '}' ELSE '' END) AS digest FROM conversations""",
    "eval_scores": """SELECT CAST(conv_id AS VARCHAR) AS sample_id, 'A' AS target, count(*) AS input_tokens, CAST(1 AS BIGINT) AS output_tokens, 'match' AS scorer, CAST(conv_id % 2 AS VARCHAR) AS value, 'A' AS answer FROM conversations GROUP BY conv_id""",
}
