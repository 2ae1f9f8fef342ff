"""SQL that the registered queries must equal, where SQL can say it; it shares no code with the operators."""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: All pairs by shared shingles, then everything reachable. The smallest reachable id is the component.
OP1_MINHASH = rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents WHERE text IS NOT NULL),
places AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM words WHERE len(w) > 0),
shingle AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS s FROM places),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM common JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach(a, b) AS (SELECT x, y FROM edge UNION SELECT r.a, e.y FROM reach r JOIN edge e ON e.x = r.b),
least_of AS (SELECT a AS doc_id, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(b, d.doc_id))::BIGINT AS component_id, least(d.doc_id, coalesce(b, d.doc_id)) = d.doc_id AS kept
FROM documents d LEFT JOIN size USING (doc_id) LEFT JOIN least_of USING (doc_id)
"""


def _spans(name: str, flagged: str) -> str:
    """Islands of the stretches that ``flagged`` selects: their number, words and ``start:end`` list by document."""
    return f"""{name}_at AS (SELECT doc_id, k, CASE WHEN k <= lag(k) OVER (PARTITION BY doc_id ORDER BY k) + 50 THEN 0 ELSE 1 END AS new FROM {flagged}),
{name}_island AS (SELECT doc_id, k, sum(new) OVER (PARTITION BY doc_id ORDER BY k) AS island FROM {name}_at),
{name}_ends AS (SELECT doc_id, island, min(k) AS a, max(k) + 49 AS b FROM {name}_island GROUP BY 1, 2),
{name} AS (SELECT e.doc_id, count(*) AS n, sum(b - a + 1) AS words, string_agg(p.start || ':' || q.stop, ',' ORDER BY a) AS spans
    FROM {name}_ends e JOIN word p ON p.doc_id = e.doc_id AND p.k = a JOIN word q ON q.doc_id = e.doc_id AND q.k = b GROUP BY 1)"""


#: Every stretch of 50 words, grouped by its words.
OP4_SUFFIX_DEDUP = rf"""
WITH token AS (SELECT doc_id, generate_subscripts(t, 1) AS i, unnest(t) AS s FROM (SELECT doc_id, regexp_extract_all(text, '[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+') AS t FROM documents WHERE text IS NOT NULL)),
placed AS (SELECT doc_id, i, s, sum(length(s)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM token),
word AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, {_LOWER.replace("text", "s")} AS s, (stop - length(s))::BIGINT AS start, stop::BIGINT AS stop FROM placed WHERE NOT regexp_matches(s, '^[\x20\x09-\x0D]')),
listed AS (SELECT doc_id, list(s ORDER BY k) AS w FROM word GROUP BY doc_id),
stretch AS (SELECT doc_id, k, array_to_string(w[k : k + 49], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS k FROM listed WHERE len(w) >= 50)),
found AS (SELECT s, count(DISTINCT doc_id) AS docs, min(doc_id) AS first FROM stretch GROUP BY s HAVING count(*) > 1),
across AS (SELECT doc_id, k, first FROM stretch JOIN found USING (s) WHERE docs > 1),
within AS (SELECT doc_id, k FROM stretch WHERE (doc_id, s) IN (SELECT (doc_id, s) FROM stretch GROUP BY doc_id, s HAVING count(*) > 1)),
first_of AS (SELECT doc_id, min(first) AS first FROM across GROUP BY doc_id),
{_spans("outer_spans", "across")},
{_spans("own_spans", "within")}
SELECT d.doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(o.n, 0)::BIGINT AS n_spans, coalesce(o.words, 0)::BIGINT AS repeated_words, first::BIGINT AS first_doc_id,
    coalesce(o.spans, '') AS spans, coalesce(i.n, 0)::BIGINT AS n_inner, coalesce(i.spans, '') AS inner_spans
FROM documents d LEFT JOIN listed USING (doc_id) LEFT JOIN first_of USING (doc_id) LEFT JOIN outer_spans o USING (doc_id) LEFT JOIN own_spans i USING (doc_id)
"""

#: The article elements, for pages that have one each: paragraphs, headings and line breaks part blocks, other tags do not.
OP10_HTML_TEXT = r"""
WITH article AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*?)</article>', 1) AS h FROM pages),
bare AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(h, '(?s)<!--.*?-->', '', 'g'), '</?(p|h[1-6]|br|li|ul|ol|div)(\s[^>]*)?/?>', ' ', 'g'), '<[^>]*>', '', 'g') AS h FROM article),
decoded AS (SELECT page_id, url, replace(replace(replace(replace(replace(h, '&quot;', '"'), '&#39;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS h FROM bare)
SELECT page_id, url, trim(regexp_replace(h, '\s+', ' ', 'g')) AS text, length(trim(regexp_replace(h, '\s+', ' ', 'g')))::BIGINT AS n_chars FROM decoded
"""

SQL = {"op1_minhash": OP1_MINHASH, "op4_suffix_dedup": OP4_SUFFIX_DEDUP, "op10_html_text": OP10_HTML_TEXT}
