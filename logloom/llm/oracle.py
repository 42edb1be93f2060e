"""SQL with the rows of the registered queries, where SQL can express them."""

from __future__ import annotations

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = _UPPER.lower()



def _code_rounds(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Codebooks and assignments round by round, each a table of its own."""
    steps = [f"""
        kept AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id, label,
                list_transform(embedding, lambda x: CAST(floor(x::DOUBLE * 4096) AS BIGINT)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), parts AS MATERIALIZED (
            SELECT r, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS x
            FROM kept, (SELECT unnest(range({parts})) AS p)
        ), least AS (
            SELECT r, row_number() OVER (ORDER BY vec_id, v) - 1 AS e FROM kept ORDER BY vec_id, v LIMIT {entries}
        ), book0 AS MATERIALIZED (SELECT p, e, x AS c FROM parts JOIN least USING (r))"""]
    for k in range(rounds + 1):
        steps.append(f"""
        near{k} AS MATERIALIZED (
            SELECT r, p, min({{'d': d, 'e': e}}) AS best FROM (
                SELECT r, parts.p, e,
                    list_sum(list_transform(list_zip(x, c), lambda y: (y[1] - y[2]) * (y[1] - y[2])))::BIGINT AS d
                FROM parts JOIN book{k} ON parts.p = book{k}.p
            ) GROUP BY r, p
        )""")
        if k < rounds:
            steps.append(f"""
        book{k + 1} AS MATERIALIZED (
            SELECT book{k}.p, book{k}.e, coalesce(m.c, book{k}.c) AS c FROM book{k} LEFT JOIN (
                SELECT p, e, list(t ORDER BY i) AS c FROM (
                    SELECT p, best.e AS e, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS t
                    FROM near{k} JOIN parts USING (r, p), (SELECT unnest(range(1, (SELECT max(len(x)) FROM parts) + 1)) AS i)
                    GROUP BY p, best.e, i
                ) GROUP BY p, e
            ) AS m ON book{k}.p = m.p AND book{k}.e = m.e
        )""")
    return f"""
        WITH {", ".join(steps)}, coded AS (
            SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error
            FROM near{rounds} GROUP BY r
        ), books AS (
            SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS h FROM book{rounds}
        )
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
            (SELECT h FROM books) AS codebooks_sha256
        FROM coded JOIN kept USING (r)
    """


ORACLE = {
    "op3_exact_dedup": f"""
        WITH folded AS (
            SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents
        ), groups AS (
            SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM folded GROUP BY t
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
        FROM folded JOIN groups USING (t)
    """,
    "op4_substring_dedup": """
        WITH docs AS (
            SELECT doc_id, string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+') AS raw FROM documents
        ), split AS (
            SELECT doc_id, [w FOR w IN raw IF w <> ''] AS ws FROM docs
        ), starts AS (
            SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM split WHERE len(ws) >= 35
        ), seen AS (
            SELECT doc_id, i, count(*) OVER (PARTITION BY array_to_string(ws[i:i + 34], ' ')) AS n FROM starts
        ), gone AS (
            SELECT DISTINCT doc_id, i + k AS place
            FROM (SELECT doc_id, i FROM seen WHERE n > 1), (SELECT unnest(range(0, 35)) AS k)
        ), words AS (
            SELECT doc_id, unnest(range(1, len(ws) + 1)) AS place, unnest(ws) AS word FROM split
        ), kept AS (
            SELECT words.doc_id, count(*) AS n_words, count(gone.place) AS n_removed,
                coalesce(string_agg(CASE WHEN gone.place IS NULL THEN word END, ' ' ORDER BY words.place), '') AS t
            FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.place = gone.place
            GROUP BY words.doc_id
        )
        SELECT split.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
            sha256(coalesce(t, '')) AS kept_sha256
        FROM split LEFT JOIN kept ON split.doc_id = kept.doc_id
    """,
    "op5_chat_format": """
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', chr(92) || '### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', chr(92) || '### Assistant: </turn> ok'
        ), escaped AS (
            SELECT *,
                replace(replace(replace(text, chr(92), chr(92) || chr(92)), '#', chr(92) || '#'),
                    '<', chr(92) || '<') AS shown,
                replace(replace(replace(replace(role, chr(92), chr(92) || chr(92)), '#', chr(92) || '#'),
                    '<', chr(92) || '<'), ':', chr(92) || ':') AS shown_role
            FROM turns
        )
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
            sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text))
                AS loss_sha256,
            CAST(sum(4 + length(shown_role) + 2 + length(shown) + 9) AS BIGINT) AS formatted_chars
        FROM escaped GROUP BY conv_id
    """,
    "op12_vector_codes": _code_rounds(),
    "op13_resample": f"""
        WITH crc AS (
            SELECT list(c ORDER BY b) AS t FROM (
                SELECT b, list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, i:
                    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) AS c
                FROM (SELECT unnest(range(256)) AS b)
            )
        ), texts AS (
            SELECT 0 AS k, doc_id AS id, row_number() OVER () AS r, text FROM documents
            UNION ALL SELECT 1, item_id, row_number() OVER (), text FROM benchmark
        ), split AS MATERIALIZED (
            SELECT k, id, r, [w FOR w IN string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') IF w <> ''] AS ws FROM texts
        ), words AS (SELECT k, r, unnest(ws) AS w FROM split
        ), coded AS MATERIALIZED (
            SELECT w, xor(list_reduce(
                list_transform(range(length(hex(w)) // 2), lambda i: ('0x' || substr(hex(w), 2 * i + 1, 2))::BIGINT),
                lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8), 4294967295), 4294967295) % 10000 AS b
            FROM (SELECT DISTINCT w FROM words), crc
        ), counted AS (
            SELECT b, sum(1 - k)::DOUBLE AS s, sum(k)::DOUBLE AS t FROM words JOIN coded USING (w) GROUP BY b
        ), gains AS MATERIALIZED (
            SELECT b, CAST(floor(1000 * ln(((t + 1) * ((SELECT sum(s) FROM counted) + 10000))
                / ((s + 1) * ((SELECT sum(t) FROM counted) + 10000)))) AS BIGINT) AS g FROM counted
        ), weighed AS (
            SELECT r, CAST(floor(sum(g) / count(*)) AS BIGINT) AS weight
            FROM words JOIN coded USING (w) JOIN gains USING (b) WHERE k = 0 GROUP BY r
        ), scores AS (
            SELECT id AS doc_id, len(ws) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(
                -1000 * ln(-ln((('0x' || substr(sha256('2024:' || id), 1, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE)))
                AS BIGINT) AS score
            FROM split LEFT JOIN weighed ON split.r = weighed.r WHERE k = 0
        ), places AS (
            SELECT *, CASE WHEN n_features >= 20 THEN
                row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place FROM scores
        )
        SELECT doc_id, n_features, weight, score,
            CASE WHEN place <= (SELECT count(*) FROM scores WHERE n_features >= 20) * 10 // 100 THEN place END AS rank
        FROM places
    """,
}
