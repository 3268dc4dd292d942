"""The queries that SQL can express, for DuckDB, written apart from the operators."""

from __future__ import annotations

from rainspark.llm.secret_ledger import BASE, RULES

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SUBSTRINGS = f"""
WITH w AS MATERIALIZED (SELECT doc_id, {WORDS} AS ws FROM documents),
windows AS (
  SELECT doc_id, i AS start, array_to_string(ws[i:i + 19], ' ') AS words
  FROM w, unnest(range(1, len(ws) - 18)) t(i) WHERE len(ws) >= 20),
earlier AS MATERIALIZED (
  SELECT doc_id, start, start - lag(start) OVER (PARTITION BY doc_id ORDER BY start) AS step FROM (
    SELECT doc_id, start, row_number() OVER (PARTITION BY words ORDER BY doc_id, start) AS rn FROM windows) WHERE rn > 1),
gone AS (SELECT DISTINCT doc_id, start + j AS pos FROM earlier, range(20) s(j)),
kept AS (
  SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.pos) AS kept, count(*) AS n
  FROM (SELECT doc_id, i AS pos, ws[i] AS word FROM w, unnest(range(1, len(ws) + 1)) t(i)) p
  ANTI JOIN gone g ON g.doc_id = p.doc_id AND g.pos = p.pos GROUP BY p.doc_id),
parts AS (SELECT doc_id, count(*) FILTER (step IS NULL OR step > 1) AS n_factors FROM earlier GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256,
       coalesce(f.n_factors, 0) AS n_factors
FROM w LEFT JOIN kept k ON k.doc_id = w.doc_id LEFT JOIN parts f ON f.doc_id = w.doc_id"""

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
JACCARD = f"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {WORDS.replace("text", _LOWER)} AS ws FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS s FROM w, unnest(range(1, greatest(len(ws) - 1, 2))) t(i) WHERE len(ws) > 0),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * common >= 90 * (p.n + q.n - common)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT w.doc_id, coalesce(max(n), 0) AS n_shingles, least(w.doc_id, coalesce(min(r.b), w.doc_id)) AS component_id
FROM w LEFT JOIN sizes s ON s.doc_id = w.doc_id LEFT JOIN reach r ON r.a = w.doc_id GROUP BY w.doc_id"""


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_PARTS = "\nUNION ALL ".join(
    f"SELECT doc_id, {n} AS kind_no, {_quoted(r.kind)} AS kind, unnest(regexp_extract_all(text, {_quoted(f'(?s:.*?)(?:{r.pattern})')}, 0)) AS part, "
    f"generate_subscripts(regexp_extract_all(text, {_quoted(f'(?s:.*?)(?:{r.pattern})')}, 0), 1) AS n FROM d"
    for n, r in enumerate(RULES)
)
_MATCH, _VALUE, _LEAST = (
    "CASE kind_no " + " ".join(f"WHEN {n} THEN {of(r)}" for n, r in enumerate(RULES)) + " END"
    for of in (
        lambda r: f"regexp_extract(part, {_quoted(r.pattern)}, 0)",
        lambda r: f"regexp_extract(part, {_quoted(r.pattern)}, {r.group})",
        lambda r: str(r.at_least),
    )
)
_LISTED = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, kind_no)"
SECRETS = f"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text FROM documents),
parts AS ({_PARTS}),
spans AS (
  SELECT *, stop - length({_MATCH}) AS start FROM (
    SELECT *, sum(length(part)) OVER (PARTITION BY doc_id, kind_no ORDER BY n) AS stop FROM parts)
  WHERE length({_VALUE}) >= {_LEAST}),
found AS (
  SELECT doc_id, {", ".join(f"count(*) FILTER (kind_no = {n}) AS n_{r.kind}" for n, r in enumerate(BASE))},
         {_LISTED} FILTER (kind_no < {len(BASE)}) AS base, {_LISTED} AS spans
  FROM spans GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN found f ON f.doc_id = d.doc_id"""


def _integers(scale: int) -> str:
    """vec_id, label, v: the integer vectors of the rows that take part."""
    return f"""(
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""


TOP_K = f"""
WITH x AS MATERIALIZED {_integers(256)},
scored AS (
  SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.v, x.v)::BIGINT AS score
  FROM x AS q JOIN x ON q.vec_id <> x.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5"""

_PARTS = """
parts AS MATERIALIZED (
  SELECT vec_id, label, m, v[m * (len(v) // 4) + 1 : (m + 1) * (len(v) // 4)] AS p FROM x, range(4) t(m)),
book0 AS MATERIALIZED (
  SELECT m, e, p FROM parts JOIN (
    SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM x QUALIFY row_number() OVER (ORDER BY vec_id) <= 256) USING (vec_id))"""


def _nearest(n: int) -> str:
    """Each part's nearest entry in the codebooks after n rounds, with its squared distance."""
    return f"""
near{n} AS MATERIALIZED (
  SELECT vec_id, label, m, p, min(struct_pack(d := d, e := e)) AS best FROM (
    SELECT a.vec_id, a.label, a.m, a.p, b.e, list_inner_product(a.p, a.p) - 2 * list_inner_product(a.p, b.p) + list_inner_product(b.p, b.p) AS d
    FROM parts a JOIN book{n} b ON a.m = b.m) GROUP BY vec_id, label, m, p)"""


def _book(n: int) -> str:
    """The codebooks after n rounds: means of the parts of each entry, rounded down; unused entries stay."""
    return f"""
book{n} AS MATERIALIZED (
  SELECT b.m, b.e, coalesce(c.p, b.p) AS p FROM book{n - 1} b LEFT JOIN (
    SELECT m, e, list(mean ORDER BY i) AS p FROM (
      SELECT m, best.e AS e, i, floor(sum(p[i]) / count(*)) AS mean FROM near{n - 1}, unnest(range(1, len(p) + 1)) t(i) GROUP BY 1, 2, 3)
    GROUP BY m, e) c ON c.m = b.m AND c.e = b.e)"""


VECTOR_CODES = f"""
WITH x AS MATERIALIZED {_integers(1024)},{_PARTS},{",".join(_nearest(n - 1) + "," + _book(n) for n in range(1, 5))},{_nearest(4)},
coded AS MATERIALIZED (
  SELECT vec_id, label, string_agg(lpad(lower(to_hex(best.e)), 2, '0'), '' ORDER BY m) AS code, sum(best.d)::BIGINT AS error
  FROM near4 GROUP BY vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(list_transform(p, lambda y: y::BIGINT), ','), ',' ORDER BY m, e)) FROM book4) AS codebooks_sha256
FROM coded"""

FILL_IN_MIDDLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
         sha256('42:' || doc_id) AS digest FROM documents),
h AS (
  SELECT *, len(units) AS n, list_transform(range(4), lambda g: list_sum(list_transform(range(8), lambda i:
    (strpos('0123456789abcdef', digest[8 * g + i + 1]) - 1) * (16 ** (7 - i))::BIGINT))::BIGINT) AS h FROM d),
c AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS one, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS two,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50 THEN 'plain'
              WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
s AS (
  SELECT *, coalesce(array_to_string(units[1:one], ''), '') AS p, coalesce(array_to_string(units[one + 1:two], ''), '') AS m,
         coalesce(array_to_string(units[two + 1:], ''), '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM s"""
