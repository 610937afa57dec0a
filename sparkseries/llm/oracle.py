"""DuckDB SQL of the dealt operators that SQL can express."""

# A-Z in lower case, all other characters unchanged
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL: dict[str, str] = {}

# one row per id (the operator keeps one of several), vectors with a null or non-finite component left out
SQL["op5_top_k"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT
    NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON
    q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM pairs QUALIFY rank <= 5
"""

# the plain form does not read back where a turn holds the end mark or a role the mark after roles
SQL["op6_chat"] = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL
    SELECT -7, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) x(turn, role)),
m AS (SELECT *, contains(role || ' ' || text, '</s>') OR contains(role, '[/INST]') AS clash,
    len(regexp_extract_all(role, '[\[<]\\*(/?INST\]|/?s>)')) + len(regexp_extract_all(text, '[\[<]\\*(/?INST\]|/?s>)'))
    AS marks FROM t),
c AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS
    said, coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    sum(length(role) + length(text) + 17) AS chars, bool_or(clash) AS clash, sum(marks) AS marks FROM m GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
    (chars + CASE WHEN clash THEN marks + 3 ELSE 0 END)::BIGINT AS formatted_chars, true AS round_trip FROM c
"""

SQL["op12_collocations"] = rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWER}, '[.,;:!?\x0A-\x0D]')) AS
    piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
grams AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM places, range(1, 6) AS r(m) WHERE i + m
    - 1 <= len(w)),
counts AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL),
total AS (SELECT lang, sum(f) AS n FROM counts WHERE m = 1 GROUP BY lang),
often AS (SELECT * FROM counts WHERE f >= 100),
cuts AS (SELECT lang, m, phrase, f AS a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS lp,
    array_to_string(string_split(phrase, ' ')[k + 1:m], ' ') AS rp FROM often, range(1, 5) AS c(k) WHERE k < m),
scored AS (SELECT c.lang, c.m, c.phrase, c.a, c.k, x.f AS l, y.f AS r, t.n, (1000::HUGEINT * c.a * t.n) //
    (x.f::HUGEINT * y.f) AS score FROM cuts c JOIN often x ON c.lang = x.lang AND c.lp = x.phrase JOIN often y ON
    c.lang = y.lang AND c.rp = y.phrase JOIN total t ON c.lang = t.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (SELECT lang, m, f, array_to_string(string_split(phrase, ' ')[i:j], ' ') AS phrase FROM often, range(1, 6)
    AS a(i), range(1, 6) AS b(j) WHERE i < j AND j <= m AND j - i + 1 < m),
within AS (SELECT lang, phrase, max(f) AS most FROM longer GROUP BY ALL)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase::BLOB) AS rank, phrase, a, l,
    r, n::BIGINT AS n, score::BIGINT AS score
FROM best LEFT JOIN within USING (lang, phrase) WHERE coalesce(100 * most < 100 * a, true) QUALIFY rank <= 2000
"""

SQL["op13_lexical_search"] = rf"""
WITH terms AS (SELECT doc_id, unnest(regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
    FROM documents),
tf AS (SELECT doc_id, t, count(*) AS tf FROM terms GROUP BY ALL),
docs AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
corpus AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM docs),
wanted AS (SELECT item_id, t, count(*) AS c FROM (SELECT item_id, unnest(regexp_extract_all({LOWER},
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY ALL),
weights AS (SELECT t, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT t, count(*) AS
    df FROM tf GROUP BY t), corpus),
scored AS (SELECT item_id, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) //
    ll))))::BIGINT AS score FROM wanted JOIN tf USING (t) JOIN weights USING (t) JOIN docs USING (doc_id), corpus
    GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM
    scored WHERE score > 0 QUALIFY rank <= 10
"""
