"""DuckDB SQL for the queries that SQL can express."""

SPACES = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

WARC = """
    WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
    f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to
    FROM f
"""

SUBSTRINGS = rf"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{SPACES}') AS w FROM documents),
    word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
    win AS (SELECT doc_id, i AS pos, sha256(array_to_string(list_slice(w, i, i + 49), ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
    least AS (SELECT h, min(doc_id) AS first FROM win GROUP BY h),
    gone AS (SELECT DISTINCT doc_id, pos + j AS pos FROM win JOIN least USING (h), (SELECT unnest(range(0, 50)) AS j) WHERE doc_id > first),
    kept AS (SELECT word.doc_id, string_agg(word, ' ' ORDER BY word.pos) AS text, count(*) AS n FROM word ANTI JOIN gone ON word.doc_id = gone.doc_id AND word.pos = gone.pos GROUP BY word.doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
    FROM d LEFT JOIN kept USING (doc_id)
"""

JACCARD = rf"""
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SPACES}') AS w FROM documents),
    s AS (
        SELECT DISTINCT doc_id, sha256(array_to_string(list_slice(w, i, i + 4), ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)
    ),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    link AS (
        SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL)
        JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)
    ),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
    SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c.component_id
    FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
"""

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

WINNOW = rf"""
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
    b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM benchmark),
    item AS (
        SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS span
        FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, least(len(w), 10) AS n FROM b WHERE len(w) > 0))
    ),
    sizes AS (SELECT DISTINCT n FROM item),
    win AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS span FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
    hit AS (SELECT doc_id, item_id, i, n FROM win JOIN item USING (n, span)),
    covered AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM hit) GROUP BY doc_id),
    items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

SUFFIXES = """
    WITH d AS (SELECT doc_id, row_number() OVER () AS r, encode(coalesce(text, '')) AS b FROM documents),
    n AS (SELECT doc_id, r, b, octet_length(b) AS n FROM d),
    win AS (SELECT r, k, i, sha256(array_slice(b, i, i + k - 1)) AS h FROM (SELECT r, b, k, unnest(range(1, n - k + 2)) AS i FROM n, (SELECT unnest([400, 256]) AS k) WHERE n >= k)),
    met AS (SELECT k, h FROM win GROUP BY k, h HAVING CASE WHEN k = 400 THEN count(*) > 1 ELSE min(r) < max(r) END),
    hit AS (SELECT r, k, i FROM win SEMI JOIN met USING (k, h)),
    run AS (SELECT *, sum(CASE WHEN i <= before + k THEN 0 ELSE 1 END) OVER (PARTITION BY r, k ORDER BY i) AS run FROM (SELECT *, lag(i) OVER (PARTITION BY r, k ORDER BY i) AS before FROM hit)),
    span AS (SELECT r, k, min(i) AS a, max(i) + k AS z FROM run GROUP BY r, k, run),
    told AS (SELECT r, k, sum(z - a) AS gone, count(*) AS spans FROM span GROUP BY r, k),
    piece AS (SELECT r, lag(z, 1, 1) OVER (PARTITION BY r ORDER BY a) AS a, a AS z FROM span WHERE k = 400 UNION ALL SELECT r, max(z), NULL FROM span WHERE k = 400 GROUP BY r),
    kept AS (SELECT r, string_agg(hex(array_slice(b, a, coalesce(z, n + 1) - 1)), '' ORDER BY a) AS kept FROM piece JOIN n USING (r) WHERE a < coalesce(z, n + 1) GROUP BY r)
    SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(x.gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(x.spans, 0) AS BIGINT) AS n_spans,
           sha256(CASE WHEN x.gone IS NULL THEN b ELSE unhex(coalesce(kept, '')) END) AS kept_sha256, CAST(coalesce(y.gone, 0) AS BIGINT) AS n_shared
    FROM n LEFT JOIN (SELECT * FROM told WHERE k = 400) x USING (r) LEFT JOIN (SELECT * FROM told WHERE k = 256) y USING (r) LEFT JOIN kept USING (r)
"""

EMBEDDINGS = """
    WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    fine AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
    link AS (SELECT x.vec_id AS a, y.vec_id AS b FROM fine x JOIN fine y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.98),
    reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
    SELECT v.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
    FROM v LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a) USING (vec_id) JOIN (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a) c USING (vec_id)
"""


def balls(clusters: int = 16, rounds: int = 3, dimensions: int = 64, limit: int = 1 << 20) -> str:
    """k-means with every centroid compared; a table for each round."""
    cell = f"greatest(-{limit}, least({limit}, floor(greatest(-{2 * limit}, least({2 * limit}, 64.0 * CAST(x AS DOUBLE))))))"
    text = f"""
    WITH kept AS (
        SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST({cell} AS BIGINT)) AS v FROM embeddings
        WHERE len(embedding) = {dimensions} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dimensions}
    ),
    c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS c, v FROM kept QUALIFY c < {clusters})"""
    for i in range(rounds + 1):
        text += f""",
    a{i} AS MATERIALIZED (
        SELECT rid, vec_id, k.v, c, list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM kept k, c{i} c
        QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, c) = 1
    )"""
        if i < rounds:
            text += f""",
    m{i} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range({dimensions})) AS i FROM a{i}) GROUP BY c, i),
    c{i + 1} AS MATERIALIZED (
        SELECT c, coalesce(m.v, o.v) AS v FROM c{i} o LEFT JOIN (SELECT c, list(CAST((s - ((s % n + n) % n)) // n AS BIGINT) ORDER BY i) AS v FROM m{i} GROUP BY c) m USING (c)
    )"""
    return text + f"""
    SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
           CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(o.v, ',')) AS centroid_sha256
    FROM a{rounds} a JOIN c{rounds} o USING (c)
"""


BALLS = balls()

#: The checksum is a fold over the bits of the bytes, lowest first; the repair a recursion over turns with one row a state.
CONVERSATIONS = r"""
    WITH RECURSIVE named AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')) AS b FROM conversations
    ),
    summed AS (
        SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(8 * octet_length(b)), lambda i:
            (ascii(substr(decode(b), CAST(i // 8 + 1 AS BIGINT), 1)) >> CAST(i % 8 AS INTEGER)) & 1)), lambda c, x: CASE WHEN xor(c, x) & 1 = 1 THEN xor(xor(c, x) >> 1, 3988292384) ELSE xor(c, x) >> 1 END)) % 20 AS k FROM named
    ),
    rows AS (
        SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
        FROM summed, unnest(CASE WHEN k = 3 THEN [0, 1] ELSE [0] END) WHERE k <> 0
    ),
    placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, left(role, 1) AS i FROM rows),
    faulty AS (
        SELECT *, lag(i) OVER (PARTITION BY conv_id ORDER BY n) AS before,
            CASE WHEN bare = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
        FROM placed
    ),
    least AS (
        SELECT conv_id, 0 AS n, q, cost, audit, out FROM (SELECT DISTINCT conv_id FROM conversations),
            (VALUES ('n', 0, '', CAST([] AS VARCHAR[])), ('u', 5, 'I', ['user:']), ('a', 10, 'II', ['user:', 'assistant:'])) s(q, cost, audit, out)
        UNION ALL
        SELECT conv_id, n, q, best.cost, best.audit, best.out FROM (
            SELECT conv_id, n, q, min({'cost': cost, 'audit': audit, 'out': out}) AS best FROM (
                SELECT conv_id, n, unnest([{'q': t.q, 'cost': t.cost, 'audit': t.audit, 'out': t.out},
                    {'q': CASE WHEN t.q IN ('n', 's', 'a') THEN 'u' WHEN t.q = 'u' THEN 'a' END, 'cost': t.cost + 5, 'audit': t.audit || 'I', 'out': list_append(t.out, CASE WHEN t.q = 'u' THEN 'assistant:' ELSE 'user:' END)},
                    {'q': CASE WHEN t.q IN ('n', 's', 'a') THEN 'a' END, 'cost': t.cost + 10, 'audit': t.audit || 'II', 'out': list_append(list_append(t.out, 'user:'), 'assistant:')}], recursive := true)
                FROM (
                    SELECT l.conv_id, f.n, unnest([
                        {'q': l.q, 'cost': l.cost + 2, 'audit': l.audit || 'D', 'out': l.out},
                        {'q': CASE WHEN fault IN ('blank', 'duplicate') THEN NULL WHEN l.q = 'n' AND i = 's' THEN 's' WHEN l.q = 'u' AND i = 'a' THEN 'a' WHEN l.q <> 'u' AND i = 'u' THEN 'u' END,
                         'cost': l.cost + CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END, 'audit': l.audit || 'K', 'out': list_append(l.out, role || ':' || text)},
                        {'q': CASE WHEN fault IN ('blank', 'duplicate') THEN NULL WHEN l.q = 'u' THEN 'a' ELSE 'u' END, 'cost': l.cost + 1 + CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END, 'audit': l.audit || 'R',
                         'out': list_append(l.out, CASE WHEN l.q = 'u' THEN 'assistant:' ELSE 'user:' END || text)}]) AS t
                    FROM least l JOIN faulty f ON l.conv_id IS NOT DISTINCT FROM f.conv_id AND f.n = l.n + 1
                ) WHERE t.q IS NOT NULL
            ) WHERE q IS NOT NULL GROUP BY conv_id, n, q
        )
    ),
    last AS (SELECT conv_id, max(n) AS n FROM least GROUP BY conv_id),
    done AS (SELECT l.conv_id, min({'cost': cost, 'audit': audit, 'out': out}) AS best FROM least l JOIN last ON l.conv_id IS NOT DISTINCT FROM last.conv_id AND l.n = last.n WHERE q IN ('n', 'a') GROUP BY l.conv_id),
    counted AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
            count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before || i NOT IN ('su', 'ua', 'au')) AS illegal FROM faulty GROUP BY conv_id
    )
    SELECT done.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
           CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(best.cost AS BIGINT) AS cost, best.audit AS audit, sha256(array_to_string(best.out, chr(10))) AS repaired_sha256
    FROM done LEFT JOIN counted ON done.conv_id IS NOT DISTINCT FROM counted.conv_id
"""
