"""What each query must give, as DuckDB SQL over the whole tables."""

from __future__ import annotations

from .license_scan import BASE_PHRASES, key_place, words_of
from .license_texts import TEMPLATES, Template
from .url_filter import BLOCK_ENDINGS, BLOCK_WORDS


def _template_row(template: Template, base: bool) -> str:
    quoted = lambda text: "[" + ", ".join(f"'{w}'" for w in words_of(text)) + "]"
    return f"('{template.label}', {quoted(template.text)}, {quoted(template.key)}, {key_place(template)}, {base})"


_TEMPLATE_ROWS = ", ".join([*(_template_row(Template(label, p, p), True) for p, label in BASE_PHRASES.items()), *(_template_row(t, False) for t in TEMPLATES)])

ORACLE_SQL: dict[str, str] = {
    "op5_jaccard_join": """
        WITH RECURSIVE texts AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
        ), shingles AS (
            SELECT DISTINCT doc_id, ws[pos:pos + 3] AS shingle FROM texts, unnest(range(1, greatest(len(ws) - 2, 2))) AS p(pos) WHERE len(ws) > 0
        ), sizes AS (
            SELECT t.doc_id, count(shingle) AS n FROM texts t LEFT JOIN shingles s ON s.doc_id = t.doc_id GROUP BY t.doc_id
        ), pairs AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
        ), links AS (
            SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * n_both >= 85 * (x.n + y.n - n_both)
        ), reach(doc_id, root) AS (
            SELECT doc_id, doc_id FROM texts UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.doc_id
        )
        SELECT s.doc_id, s.n AS n_shingles, min(root) AS component_id FROM sizes s JOIN reach r ON r.doc_id = s.doc_id GROUP BY s.doc_id, s.n
    """,
    "op3_substring_dedup": """
        WITH texts AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
        ), starts AS (
            SELECT doc_id, pos, row_number() OVER (PARTITION BY ws[pos:pos + 19] ORDER BY doc_id, pos) > 1 AS again
            FROM texts, unnest(range(1, len(ws) - 18)) AS p(pos)
        ), gone AS (
            SELECT DISTINCT doc_id, pos + k AS pos FROM starts, range(20) AS r(k) WHERE again
        ), words AS (
            SELECT doc_id, pos, ws[pos] AS word FROM texts, unnest(range(1, len(ws) + 1)) AS p(pos)
        ), judged AS (
            SELECT w.doc_id, w.pos, w.word, g.pos IS NOT NULL AS removed FROM words w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.pos = w.pos
        ), sums AS (
            SELECT doc_id, count(*) AS n_words, count(*) FILTER (removed) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT removed) AS kept
            FROM judged GROUP BY doc_id
        )
        SELECT t.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM texts t LEFT JOIN sums s ON s.doc_id = t.doc_id
    """,
    "op7_url_filter": f"""
        WITH parsed AS (
            SELECT page_id,
                   translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
            FROM pages
        ), rules(rule_host, rule_path, verdict) AS (
            VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
        ), judged AS (
            SELECT p.*, (
                SELECT {{'rule': rule_host || rule_path, 'verdict': verdict}} FROM rules
                WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
                ORDER BY length(rule_host || rule_path) DESC LIMIT 1
            ) AS best
            FROM parsed p
        )
        SELECT page_id, host, path, best.rule AS rule,
               coalesce(best.verdict, CASE WHEN regexp_matches(translate(host || path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(^|[^a-z0-9])({"|".join(BLOCK_WORDS)})([^a-z0-9]|$)')
                OR regexp_matches(translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '/.*\\.({"|".join(BLOCK_ENDINGS)})$', 's') THEN 'block' ELSE 'allow' END) AS verdict
        FROM judged
    """,
    "op1_line_dedup": """
        WITH lines AS (
            SELECT doc_id, i, line, translate(trim(line, E' \\t\\n\\x0b\\f\\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
        ), repeated AS (
            SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
        ), judged AS (
            SELECT l.doc_id, i, line, keeper IS NOT NULL AND l.doc_id <> keeper AS gone FROM lines l LEFT JOIN repeated r USING (key)
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
        FROM judged GROUP BY doc_id
    """,
    "op6_embedding_dedup": """
        WITH RECURSIVE vectors AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
        ), good AS (
            SELECT * FROM vectors WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.v, b.v) >= 0.93
        ), reach(vec_id, root) AS (
            SELECT vec_id, vec_id FROM vectors UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.vec_id
        ), roots AS (
            SELECT vec_id, min(root) AS component_id FROM reach GROUP BY vec_id
        ), counts AS (
            SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
        )
        SELECT r.vec_id, coalesce(n, 0) AS n_links, component_id, r.vec_id = component_id AS kept FROM roots r LEFT JOIN counts c ON c.vec_id = r.vec_id
    """,
    "op4_license_scan": f"""
        WITH texts AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents
        ), templates(label, words, key, key_at, base) AS (
            VALUES {_TEMPLATE_ROWS}
        ), vocabulary AS (
            SELECT DISTINCT unnest(words) AS w FROM templates
        ), counts AS (
            SELECT w, count(*) AS n FROM (SELECT unnest(list_distinct(ws)) AS w FROM texts) SEMI JOIN vocabulary USING (w) GROUP BY w
        ), idf AS (
            SELECT w, ln(1 + (SELECT count(*) FROM texts) / (1 + coalesce(n, 0))) AS idf FROM vocabulary LEFT JOIN counts USING (w)
        ), places AS (
            SELECT doc_id, ws, pos, ws[pos] AS w FROM texts, unnest(range(1, len(ws) + 1)) AS p(pos)
        ), verified AS (
            SELECT p.doc_id, p.ws, p.pos - 1 AS start, t.* FROM places p JOIN templates t ON t.key[1] = p.w WHERE ws[pos:pos + len(key) - 1] = key
        ), compared AS (
            SELECT v.doc_id, v.start, v.label, v.base, v.words, i, words[i] AS w, start - key_at + i >= 1 AND ws[start - key_at + i] IS NOT DISTINCT FROM words[i] AS same
            FROM verified v, unnest(range(1, len(words) + 1)) AS o(i)
        ), scored AS (
            SELECT doc_id, start, label, base, sum(CASE WHEN same THEN idf ELSE 0 END) / sum(idf) AS share FROM compared JOIN idf USING (w) GROUP BY doc_id, start, label, base, words
        ), found AS (
            SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
                   string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
                   string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base OR share >= 0.8 - 1e-9) AS labels, max(share) FILTER (NOT base) AS score
            FROM scored GROUP BY doc_id
        )
        SELECT t.doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
               coalesce(labels, '') AS labels, coalesce(round(score, 6), 0) AS score
        FROM texts t LEFT JOIN found f ON f.doc_id = t.doc_id
    """,
}
