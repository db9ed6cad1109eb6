"""DuckDB SQL for the queries that SQL can express."""

MIXING = r"""
    WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
        md5(coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))) || ':mix') AS key FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM d GROUP BY source),
    w AS (SELECT *, [5, 2, 1][(n - 1) % 3 + 1] AS weight, 3 * source_size AS cap, sum(source_size) OVER () AS total FROM s),
    f AS (SELECT *, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
        sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
    l AS (SELECT *, (total - filled)::DOUBLE / rest AS level FROM f),
    m AS (SELECT *, level * weight >= cap AS fills, max(CASE WHEN level * weight < cap THEN level END) OVER () AS top FROM l),
    t AS (SELECT source, n, source_size, CASE WHEN fills THEN cap::DOUBLE ELSE top * weight END AS target FROM m),
    q AS (SELECT d.doc_id, d.size, n, source_size, target, sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS served
        FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
    b AS (SELECT coalesce(sum(size), 0)::BIGINT AS budget, greatest(1, ceil(coalesce(sum(size), 0) / 131072))::BIGINT AS packet FROM d),
    c AS (SELECT *, served - size + copy * source_size AS begins FROM q, (SELECT unnest([0, 1, 2]) AS copy) WHERE size > 0),
    p AS (SELECT *, least(packet, size - piece * packet) AS words FROM (SELECT *, unnest(range(0, ((size - 1) // packet + 1)::BIGINT)) AS piece FROM c, b)),
    z AS (SELECT *, begins + piece * packet + words AS ends, (begins + piece * packet + words) / target AS finish FROM p),
    g AS (SELECT *, sum(words) OVER (ORDER BY finish, n, ends ROWS UNBOUNDED PRECEDING) AS running FROM z),
    k AS (SELECT n, served, sum(least(words, budget - running + words)) AS taken, min(finish) AS first_finish FROM g WHERE running - words < budget GROUP BY n, served)
    SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, first_finish
    FROM q LEFT JOIN k ON q.n = k.n AND q.served = k.served AND q.size > 0
"""

LINES = r"""
    WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
    lines AS (SELECT r, i - 1 AS i, line, len(string_split(text, chr(10))) AS n, ('0x' || substr(md5(line), 1, 7))::BIGINT AS h
        FROM (SELECT r, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs WHERE text <> '')),
    rolled AS (SELECT *, (lag(h, 1, 0) OVER (PARTITION BY r ORDER BY i) * 1000003 + h) % 2147483647 AS x FROM lines),
    ended AS (SELECT *, (i > 0 AND i < n - 2 AND x < lag(x) OVER o AND x <= lead(x) OVER o) OR i = n - 1 AS stop
        FROM rolled WINDOW o AS (PARTITION BY r ORDER BY i)),
    numbered AS (SELECT *, coalesce(sum(CASE WHEN stop THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM ended),
    chunks AS (SELECT r, chunk, count(*) AS lines, string_agg(line, chr(10) ORDER BY i) AS body FROM numbered GROUP BY r, chunk),
    placed AS (SELECT c.*, doc_id, lpad(doc_id::VARCHAR, 20, '0') || md5(text) || lpad(chunk::VARCHAR, 10, '0') AS place FROM chunks c JOIN docs d ON c.r = d.r),
    firsts AS (SELECT body, lines, min(place) AS first FROM placed WHERE lines > 1 GROUP BY body, lines HAVING min(place) <> max(place)),
    marked AS (SELECT p.*, first IS NOT NULL AND place <> first AS gone FROM placed p LEFT JOIN firsts f ON p.body = f.body AND p.lines = f.lines),
    kept AS (SELECT r, sum(lines)::BIGINT AS n_lines, coalesce(sum(lines) FILTER (gone), 0)::BIGINT AS n_removed,
        coalesce(string_agg(body, chr(10) ORDER BY chunk) FILTER (NOT gone), '') AS text FROM marked GROUP BY r)
    SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, md5(coalesce(k.text, '')) AS text_md5
    FROM docs d LEFT JOIN kept k ON d.r = k.r
"""

TOP_K = """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
    SELECT query_id, rank, vec_id, score FROM (
        SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score,
            (row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.v, c.v) DESC, c.vec_id))::INTEGER AS rank
        FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0) WHERE rank <= 20
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
    WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
    items AS (SELECT coalesce(item_id::VARCHAR, 'null') AS item, {_WORDS} AS w FROM benchmark),
    cut AS (SELECT item, w, least(13, len(w)) AS width FROM items WHERE len(w) > 0),
    wins AS (SELECT DISTINCT item, width, array_to_string(w[i:i + width - 1], ' ') AS t FROM (SELECT *, unnest(range(1, len(w) - width + 2)) AS i FROM cut)),
    seen AS (SELECT r, i, width, array_to_string(w[i:i + width - 1], ' ') AS t
        FROM (SELECT r, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM docs, (SELECT DISTINCT width FROM wins) WHERE len(w) >= width)),
    hits AS (SELECT r, i, width, item FROM seen JOIN wins USING (width, t)),
    hit AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + width)) AS p FROM hits) GROUP BY r),
    found AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
        sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM docs LEFT JOIN hit USING (r) LEFT JOIN found USING (r)
"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

IMPACTS = f"""
    WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
    whole AS (SELECT count(*) FILTER (len(w) > 0) AS all_docs, coalesce(sum(len(w)), 0)::BIGINT AS all_terms FROM docs),
    items AS (SELECT q, item_id, t, count(*) AS repeats FROM
        (SELECT row_number() OVER () AS q, item_id, unnest({_TERMS}) AS t FROM benchmark) GROUP BY q, item_id, t),
    held AS (SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS t FROM docs)
        WHERE t IN (SELECT t FROM items) GROUP BY r, doc_id, n, t),
    weights AS (SELECT t, floor(1000 * ln((2 * all_docs + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM held GROUP BY t), whole),
    impacts AS (SELECT r, doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * all_docs) // all_terms))) AS impact FROM held JOIN weights USING (t), whole),
    scores AS (SELECT q, item_id, r, doc_id, sum(repeats * impact)::BIGINT AS score FROM items JOIN impacts USING (t) GROUP BY q, item_id, r, doc_id)
    SELECT item_id, rank, doc_id, score FROM (SELECT *, (row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id))::INTEGER AS rank FROM scores WHERE score > 0)
    WHERE rank <= 20
"""


def _merkle(levels: int = 8, tops: int = 3) -> str:
    """Runs of 8, unrolled: up to 8 ** levels leaves a language and 8 ** tops languages."""
    shown = [f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars")]
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = """xor(4294967295, list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda a, b:
        list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"""
    head = " || ".join(shown)
    text = "coalesce(strlen({0})::VARCHAR || ':' || {0}, '-')"
    parts = [
        f"""d AS (SELECT doc_id, coalesce('=' || lang, '-') AS tree, sha256({head} || {text.format("text")}) AS leaf, sha256({head} || {text.format("changed")}) AS changed
            FROM (SELECT *, CASE WHEN {crc} % 3 = 0 THEN {lower} ELSE text END AS changed FROM documents))""",
        """t0 AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n, leaf AS digest FROM d)""",
    ]

    def climb(name: str, first: str, steps: int) -> None:
        below = first
        for k in range(steps):
            parts.append(f"{name}r{k} AS (SELECT tree, idx // 8 AS up, n, list(digest ORDER BY idx) AS run FROM {below} GROUP BY tree, idx // 8, n)")
            parts.append(f"""{name}{k + 1} AS (SELECT tree, up AS idx, (n + 7) // 8 AS n,
                CASE WHEN n > 1 THEN sha256(array_to_string(run, '')) ELSE run[1] END AS digest FROM {name}r{k})""")
            below = f"{name}{k + 1}"

    def fold(name: str, rows: str, steps: int, out: str) -> None:
        below = rows
        for k in range(steps):
            at = f"((f.at // {8**k}) % 8)"
            left, right = f"array_to_string(run[1:{at}], '')", f"array_to_string(run[{at} + 2:], '')"
            parts.append(f"""{out}{k} AS (SELECT f.* EXCLUDE (proof, folded), CASE WHEN r.n > 1 THEN proof || {left} || {right} ELSE proof END AS proof,
                CASE WHEN r.n > 1 THEN sha256({left} || folded || {right}) ELSE folded END AS folded
                FROM {below} f JOIN {name}r{k} r ON r.tree = f.up_tree AND r.up = f.at // {8 ** (k + 1)})""")
            below = f"{out}{k}"

    climb("t", "t0", levels)
    parts.append(f"u0 AS (SELECT '' AS tree, tree AS of_tree, digest, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM t{levels})")
    climb("u", "u0", tops)
    parts.append("f AS (SELECT doc_id, leaf, tree, tree AS up_tree, idx AS at, '' AS proof, changed AS folded FROM t0)")
    fold("t", "f", levels, "f")
    parts.append(f"""g AS (SELECT doc_id, leaf, u0.digest AS subroot, '' AS up_tree, u0.idx AS at, proof, folded FROM f{levels - 1} JOIN u0 ON of_tree = f{levels - 1}.tree)""")
    fold("u", "g", tops, "g")
    return f"""WITH {", ".join(parts)}
    SELECT doc_id, leaf, subroot, digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = digest AS verified FROM g{tops - 1}, u{tops}"""


MERKLE = _merkle()
