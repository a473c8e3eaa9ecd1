"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

from readgrove.llm.licenses import ARTICLES, CUES, LEAD, RULES, SENTENCES

ORACLES: dict[str, str] = {}

ORACLES["op5_exact_dedup"] = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""

ORACLES["op7_url_filters"] = """
WITH RECURSIVE rules(verdict, host, path) AS (
    VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
           ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), found AS (
    SELECT DISTINCT url, regexp_extract(url, '^(?s)(.*?)://', 1) AS scheme, regexp_extract(url, '^(?s)(.*?://[^/?#]*)', 1) AS root,
           regexp_extract(url, '^(?s).*?://[^/?#]*([^?#]*)', 1) AS path, regexp_replace(unnest(list_concat(
               list_transform(list_filter(regexp_extract_all(html, '(?is)<link\\b[^>]*>'), lambda tag: regexp_matches(tag, '(?is)\\brel\\s*=\\s*["'']?canonical\\b')),
                              lambda tag: regexp_extract(tag, '(?is)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1)),
               list_transform(list_filter(regexp_extract_all(html, '(?is)<meta\\b[^>]*>'), lambda tag: regexp_matches(tag, '(?is)\\bhttp-equiv\\s*=\\s*["'']?refresh\\b')),
                              lambda tag: regexp_extract(tag, '(?is)\\burl\\s*=\\s*["'']?([^"''\\s>]+)', 1)))), '&(amp|AMP|#38|#x26);', '&', 'g') AS link
    FROM pages WHERE contains(url, '://')
), resolved AS (
    SELECT url, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link WHEN starts_with(link, '//') THEN scheme || ':' || link
                     WHEN starts_with(link, '/') THEN root || link WHEN starts_with(link, '?') THEN root || path || link
                     WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') OR starts_with(link, '#') THEN NULL
                     ELSE root || CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(?s)(.*/)', 1) ELSE '/' END || link END AS target
    FROM found WHERE link <> ''
), parted AS (
    SELECT url, regexp_extract(target, '^(?s)(.*?://[^/?#]*)', 1) AS head, regexp_extract(target, '^(?s).*?://[^/?#]*([^?#]*)', 1) AS path,
           regexp_extract(target, '^(?s).*?://[^/?#]*[^?#]*(.*)$', 1) AS rest
    FROM resolved WHERE target IS NOT NULL
), whole AS (
    SELECT url, head || CASE WHEN NOT contains(path, '/.') THEN path ELSE array_to_string(list_reduce(
               list_transform(string_split(regexp_replace(path, '/(\\.{1,2})$', '/\\1/'), '/'), lambda part: [part]),
               lambda kept, part: CASE WHEN part[1] = '..' THEN kept[1:greatest(len(kept) - 1, 1)] WHEN part[1] = '.' THEN kept ELSE list_concat(kept, part) END), '/') END
           || rest AS target
    FROM parted
), links AS (
    SELECT DISTINCT
           lower(regexp_extract(url, '^(?s)(.*?://[^/?#]*)', 1)) || regexp_extract(url, '^(?s).*?://[^/?#]*([^#]*)', 1) AS s,
           lower(regexp_extract(target, '^(?s)(.*?://[^/?#]*)', 1)) || regexp_extract(target, '^(?s).*?://[^/?#]*([^#]*)', 1) AS t
    FROM whole WHERE contains(target, '://')
), split AS (
    SELECT DISTINCT url,
           translate(regexp_extract(url, '^(?s).*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(url, '^(?s).*?://[^/?#]*([^?#]*)', 1) AS path,
           lower(regexp_extract(url, '^(?s)(.*?://[^/?#]*)', 1)) || regexp_extract(url, '^(?s).*?://[^/?#]*([^#]*)', 1) AS node
    FROM (SELECT url FROM pages WHERE url IS NOT NULL UNION SELECT s FROM links UNION SELECT t FROM links)
), fits AS (
    SELECT s.url, r.verdict, r.host || r.path AS rule,
           row_number() OVER (PARTITION BY s.url ORDER BY length(r.host || r.path) DESC, length(r.host) DESC, r.verdict) AS n
    FROM split s JOIN rules r ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path)
), reach AS (
    SELECT s AS a, t AS b FROM links WHERE s <> t UNION SELECT t, s FROM links WHERE s <> t
    UNION SELECT r.a, l.b FROM reach r JOIN (SELECT s AS a, t AS b FROM links UNION SELECT t, s FROM links) l ON r.b = l.a
), told AS (
    SELECT r.a AS node, bool_or(f.verdict = 'allow') AS allowed, bool_or(f.verdict = 'block') AS blocked
    FROM reach r JOIN split o ON o.node = r.b JOIN fits f ON f.url = o.url AND f.n = 1
    GROUP BY r.a
)
SELECT p.page_id, coalesce(s.host, '') AS host, coalesce(s.path, '') AS path, f.rule,
       CASE WHEN f.verdict IS NOT NULL THEN f.verdict WHEN t.allowed THEN 'allow' WHEN t.blocked THEN 'block' ELSE 'allow' END AS verdict
FROM pages p LEFT JOIN split s ON s.url = p.url LEFT JOIN fits f ON f.url = p.url AND f.n = 1
LEFT JOIN told t ON t.node = s.node AND s.node <> ''
"""


ORACLES["op11_fill_in_middle"] = r"""
WITH units AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
           regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
    FROM documents
), hashed AS (
    SELECT doc_id, text, u, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
           ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
    FROM units
), cut AS (
    SELECT doc_id, text, n,
           CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
           array_to_string(u[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS prefix,
           array_to_string(u[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS middle,
           array_to_string(u[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:n], '') AS suffix
    FROM hashed
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM cut
"""

ORACLES["op12_collocations"] = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), lists AS (
    SELECT lang, row_number() OVER () AS p, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), words AS (
    SELECT lang, p, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM lists
), runs AS (
    SELECT lang, word AS a, lead(word, 1) OVER piece AS b, lead(word, 2) OVER piece AS c, lead(word, 3) OVER piece AS d
    FROM words WINDOW piece AS (PARTITION BY p ORDER BY i)
), grams AS (
    SELECT lang, m, phrase, count(*)::HUGEINT AS a FROM (
        SELECT lang, 1 AS m, a AS phrase FROM runs UNION ALL SELECT lang, 2, a || ' ' || b FROM runs WHERE b IS NOT NULL
        UNION ALL SELECT lang, 3, a || ' ' || b || ' ' || c FROM runs WHERE c IS NOT NULL
        UNION ALL SELECT lang, 4, a || ' ' || b || ' ' || c || ' ' || d FROM runs WHERE d IS NOT NULL)
    GROUP BY ALL
), totals AS (
    SELECT lang, sum(a)::BIGINT AS n FROM grams WHERE m = 1 GROUP BY lang
), often AS (
    SELECT lang, m, phrase, a, string_split(phrase, ' ') AS w FROM grams WHERE a >= 30
), cuts AS (
    SELECT o.lang, o.m, o.phrase, o.a, k, x.a AS l, y.a AS r, (2000000 * o.a) // (x.a + y.a) AS score
    FROM often o JOIN (VALUES (1), (2), (3)) c(k) ON c.k < o.m
    JOIN often x ON x.lang = o.lang AND x.phrase = array_to_string(o.w[1:k], ' ')
    JOIN often y ON y.lang = o.lang AND y.phrase = array_to_string(o.w[k + 1:o.m], ' ')
), worst AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_ones AS (
    SELECT lang, array_to_string(w[s:s + size - 1], ' ') AS phrase, max(a) AS a
    FROM often, (VALUES (2), (3)) t(size), (VALUES (1), (2), (3)) u(s) WHERE m > size AND s + size - 1 <= m GROUP BY ALL
), left_over AS (
    SELECT w.* FROM worst w LEFT JOIN inner_ones i ON i.lang = w.lang AND i.phrase = w.phrase WHERE i.a IS NULL OR 100 * i.a < 80 * w.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
       a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM left_over JOIN totals USING (lang) QUALIFY rank <= 2000
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _normalised(column: str) -> str:
    plain = f"trim(regexp_replace(lower({column}), '[^a-z0-9]+', ' ', 'g'))"
    return f"regexp_replace(regexp_replace({plain}, '{LEAD}', ''), '{ARTICLES}', ' ', 'g')"


def _license_sql() -> str:
    known = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in SENTENCES.items())
    steps, rest = [], "sequence"
    for n, (licence, ids) in enumerate(RULES):
        pattern = _quoted(" " + "  ".join(ids) + " ")
        steps.append(f"CASE WHEN contains({rest}, {pattern}) THEN {_quoted(licence)} END")
        rest = f"replace({rest}, {pattern}, ' | ')"
    return rf"""
WITH known AS (
    SELECT sentence_id, {_normalised('sentence')} AS known FROM (VALUES {known}) AS t(sentence_id, sentence)
), texts AS (
    SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents
), forms AS (
    SELECT n, doc_id, 0 AS form, string_split(regexp_replace(regexp_replace(text, '
[ 	
]*
', chr(1), 'g'), '([.!?])[ 	
]+', '' || chr(1), 'g'), chr(1)) AS list
    FROM texts WHERE regexp_matches(text, '{CUES}')
    UNION ALL
    SELECT n, doc_id, 1, string_split(regexp_replace(regexp_replace(text, '([.!?])[ 	
]+', '' || chr(1), 'g'), '
', chr(1), 'g'), chr(1))
    FROM texts WHERE regexp_matches(text, '{CUES}')
), parts AS (
    SELECT n, form, unnest(list) AS sentence, generate_subscripts(list, 1) AS pos FROM forms
), found AS (
    SELECT n, form, count(*) AS n_sentences, string_agg(' ' || sentence_id || ' ', '' ORDER BY pos) AS sequence
    FROM parts JOIN known ON known.known = {_normalised('sentence')} GROUP BY n, form
), named AS (
    SELECT n, max(n_sentences) AS n_sentences, flatten(list([{', '.join(steps)}])) AS names FROM found GROUP BY n
)
SELECT doc_id, coalesce(n_sentences, 0)::BIGINT AS n_sentences,
       coalesce(array_to_string(list_sort(list_distinct(names)), ','), '') AS licenses
FROM texts LEFT JOIN named USING (n)
"""


ORACLES["op10_license_scans"] = _license_sql()
