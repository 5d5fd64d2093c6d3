"""DuckDB SQL for the queries of this subpackage that SQL can express.

The others (entropy trees over parsed html, compression, bottom-k sketches of the library's own
hashes, byte-pair encoding, tables filled by turns) are held against plain versions in tests.
"""

from __future__ import annotations

from . import licenses

_TERM = r"[a-z0-9]+(?:\.[a-z0-9]+)*"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def license_sql() -> str:
    template = ", ".join(f"({_quoted(n)}, {k}, {_quoted(t)}, {c})" for n, k, t, c in licenses.template_terms())
    marks = lambda x: "(" + " OR ".join(f"contains(lower({x}), {_quoted(m)})" for m in licenses.MARKS) + ")"
    stop = ", ".join(map(_quoted, sorted(licenses.STOP)))
    return rf"""WITH tpl AS (SELECT * FROM (VALUES {template}) v(name, number, term, tf)),
d AS (SELECT doc_id, text, coalesce(source, 'none') AS d1, coalesce(lang, 'none') AS d2, CAST(CAST(floor(doc_id / 4096.0) AS BIGINT) AS VARCHAR) AS d3, CAST(CAST(floor(doc_id / 64.0) AS BIGINT) AS VARCHAR) AS d4 FROM documents),
l AS (SELECT *, CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY d1) THEN 1 WHEN doc_id = min(doc_id) OVER (PARTITION BY d1, d2) THEN 2 WHEN doc_id = min(doc_id) OVER (PARTITION BY d1, d2, d3) THEN 3 WHEN doc_id = min(doc_id) OVER (PARTITION BY d1, d2, d3, d4) THEN 4 END AS level FROM d),
files AS (SELECT doc_id, level IS NOT NULL AS is_license, array_to_string(list_slice([d1, d2, d3, d4], 1, coalesce(level, 4)), '/') AS folder FROM l),
lines AS (SELECT doc_id, regexp_split_to_array(text, '\r?\n') AS lines FROM documents WHERE {marks("text")}),
blocks AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(array_to_string(list_transform(lines, lambda x: CASE WHEN regexp_matches(lower(x), '[a-z0-9]') THEN x ELSE '' END), chr(10)), '^\n+|\n+$', '', 'g'), '\n\n+'), lambda x: contains(x, chr(10))) AS blocks FROM lines),
units AS (SELECT doc_id, row_number() OVER () AS unit, u FROM (SELECT doc_id, unnest(lines) AS u FROM lines UNION ALL SELECT doc_id, unnest(blocks) FROM blocks) WHERE {marks("u")}),
words AS (SELECT doc_id, unit, term, count(*) AS tf FROM (SELECT doc_id, unit, unnest(regexp_extract_all(lower(u), '{_TERM}')) AS term FROM units) WHERE term NOT IN ({stop}) GROUP BY ALL),
n AS (SELECT count(DISTINCT unit) AS n FROM words),
df AS (SELECT term, count(*) AS df FROM words GROUP BY 1),
x AS (SELECT doc_id, unit, term, tf * ln(1 + n / CAST(df AS DOUBLE)) AS x FROM words JOIN df USING (term), n),
y AS (SELECT name, number, term, tf * ln(1 + n / CAST(greatest(coalesce(df, 0), 1) AS DOUBLE)) AS y FROM tpl LEFT JOIN df USING (term), n),
ys AS (SELECT number, sqrt(sum(y * y)) AS size FROM y GROUP BY 1),
xs AS (SELECT unit, sqrt(sum(x * x)) AS size FROM x GROUP BY 1),
cosines AS (SELECT x.doc_id, x.unit, y.name, y.number, sum(x.x * y.y) / (max(xs.size) * max(ys.size)) AS score FROM x JOIN y USING (term) JOIN xs USING (unit) JOIN ys USING (number) GROUP BY 1, 2, 3, 4),
best AS (SELECT doc_id, name, score FROM cosines WHERE score >= {licenses.THRESHOLD} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY name = '{licenses.RESERVED}', round(score, 9) DESC, name) = 1),
given AS (SELECT folder, name FROM files JOIN best USING (doc_id) WHERE is_license),
near AS (SELECT f.folder, max_by(g.name, length(g.folder)) AS name, max_by(g.folder, length(g.folder)) AS above FROM (SELECT DISTINCT folder FROM files) f JOIN given g ON f.folder = g.folder OR starts_with(f.folder, g.folder || '/') GROUP BY 1)
SELECT f.doc_id, f.folder || '/' || f.doc_id AS path, b.name AS license, coalesce(round(b.score, 6), 0.0) AS score,
CASE WHEN b.name IS NOT NULL THEN 'own' WHEN g.name IS NOT NULL THEN 'inherited' ELSE 'none' END AS license_source,
CASE WHEN b.name IS NULL THEN g.above END AS inherited_from, coalesce(b.name, g.name) AS effective_license
FROM files f LEFT JOIN best b USING (doc_id) LEFT JOIN near g ON g.folder = f.folder"""


WARC = """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_digest, max(page_id) AS first_id FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT p.page_id, p.payload_bytes, p.payload_digest, CASE WHEN m.first_id <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN m.first_id <> p.page_id THEN m.first_id END AS refers_to
FROM p LEFT JOIN m ON m.payload_digest = p.payload_digest AND p.payload_bytes >= 1000"""

NEAR = r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, a AS node FROM edges UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.node),
c AS (SELECT doc_id, min(node) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id, coalesce(c.component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""

TOP_K = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score FROM e q JOIN e c USING (i) WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id GROUP BY 1, 2)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""

SQL: dict[str, str] = {"op2_license_scan": license_sql(), "op6_warc_revisits": WARC, "op8_minhash_near_dedup": NEAR, "op10_exact_top_k": TOP_K}
