"""DuckDB forms of the derived tables, used as CTEs by the oracle SQL.

The oracle never builds or parses JSON envelopes: classified turns come straight from
``conversations`` (role, text, conv_id, turn)."""

DOC_RECORDS = """
m_ AS (SELECT least((SELECT count(*) FROM embeddings), (SELECT count(*) FROM documents) // 2) AS m),
d_ AS (SELECT doc_id, lang, source, text, doc_id % m_.m AS g, doc_id // m_.m AS r FROM documents CROSS JOIN m_),
z_ AS (SELECT *, CASE WHEN r = 0 THEN 0 ELSE CASE g % 4 WHEN 1 THEN 2 WHEN 2 THEN 6 WHEN 3 THEN 16 ELSE 0 END END AS zeros FROM d_),
doc_records AS (
  SELECT z_.doc_id AS seq, '' AS ns, concat('d', lpad(CAST(z_.doc_id AS VARCHAR), 8, '0')) AS id, z_.text,
    list_transform(e.embedding, lambda x, i: CASE WHEN i <= z_.zeros THEN CAST(0 AS FLOAT) ELSE x END) AS vector,
    CAST(1704067200 + 3600 * (z_.g % 720)
         + 60 * (CASE z_.g % 3 WHEN 0 THEN z_.r WHEN 1 THEN 10 - z_.r ELSE 0 END) AS BIGINT) AS timestamp,
    list_filter([lang, source, CASE WHEN quality = 1 THEN 'hq' END, CASE WHEN toxic = 1 THEN 'toxic' END],
                lambda x: x IS NOT NULL) AS tags
  FROM z_ JOIN embeddings e ON e.vec_id = z_.g LEFT JOIN labels l ON l.doc_id = z_.doc_id)
"""

TURNS = """
turns AS (
  SELECT conv_id, turn, conv_id * 1000 + turn AS seq,
    concat('c', lpad(CAST(conv_id AS VARCHAR), 8, '0'), '-', lpad(CAST(turn AS VARCHAR), 4, '0')) AS id,
    CAST(1704067200 + 3600 * conv_id + 60 * (turn // 2) AS BIGINT) AS timestamp,
    CASE role WHEN 'user' THEN 'user' WHEN 'assistant' THEN 'claude' ELSE 'note' END AS role,
    text AS body,
    CASE WHEN role = 'user' OR (role = 'assistant' AND conv_id % 10 <> 3)
         THEN concat('s', lpad(CAST(conv_id AS VARCHAR), 8, '0')) END AS session_id,
    CASE role WHEN 'user' THEN 'prompt,fixture' WHEN 'assistant' THEN 'response,fixture' ELSE 'note' END AS tags
  FROM conversations)
"""


def cos(a: str, b: str) -> str:
    """Cosine of two FLOAT[] expressions in double precision, 0 for a zero vector."""
    return (
        f"(CASE WHEN list_dot_product(CAST({a} AS DOUBLE[]), CAST({a} AS DOUBLE[])) = 0 "
        f"OR list_dot_product(CAST({b} AS DOUBLE[]), CAST({b} AS DOUBLE[])) = 0 THEN 0.0 ELSE "
        f"list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])) / "
        f"(sqrt(list_dot_product(CAST({a} AS DOUBLE[]), CAST({a} AS DOUBLE[]))) * "
        f"sqrt(list_dot_product(CAST({b} AS DOUBLE[]), CAST({b} AS DOUBLE[])))) END)"
    )


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"
