"""DuckDB SQL of the training-data queries that SQL can express."""

ORACLES: dict[str, str] = {}

ORACLES["op1_line_dedup"] = r"""
WITH docs AS (
    SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents
), each_line AS (
    SELECT doc_id, unnest(range(0, len(lines))) AS pos, unnest(lines) AS line
    FROM docs WHERE text IS NOT NULL
), counted AS (
    SELECT doc_id, list(line ORDER BY pos) AS lines,
        list(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) ORDER BY pos) AS words
    FROM each_line GROUP BY doc_id
), blocks AS (
    SELECT doc_id, pos, until, md5(array_to_string(lines[pos + 1 : until], chr(10))) AS block,
        list_sum(words[pos + 1 : until]) AS n_words
    FROM (SELECT *, unnest(range(pos + 1, len(lines) + 1)) AS until
        FROM (SELECT *, unnest(range(0, len(lines))) AS pos FROM counted))
), copies AS (
    SELECT * FROM blocks WHERE n_words >= 10
    QUALIFY row_number() OVER (PARTITION BY block, until - pos ORDER BY doc_id, pos) > 1
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(pos, until)) AS pos FROM copies
), kept AS (
    SELECT e.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed,
        coalesce(string_agg(line, chr(10) ORDER BY e.pos) FILTER (g.pos IS NULL), '') AS text
    FROM each_line e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.pos = g.pos
    GROUP BY e.doc_id
)
SELECT d.doc_id, k.text, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed
FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

ORACLES["op8_benchmark_decontamination"] = r"""
WITH items AS (
    SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark
), sized AS (
    SELECT item_id, w, least(5, len(w)) AS size FROM items WHERE len(w) > 0
), wanted AS (
    SELECT DISTINCT item_id, size, array_to_string(w[pos : pos + size - 1], ' ') AS shingle
    FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS pos FROM sized)
), totals AS (
    SELECT item_id, count(*) AS n_shingles FROM wanted GROUP BY item_id
), texts AS (
    SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents
), lengths AS (
    SELECT DISTINCT size FROM wanted
), held AS (
    SELECT DISTINCT doc_id, size, array_to_string(w[pos : pos + size - 1], ' ') AS shingle
    FROM (
        SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS pos FROM texts, lengths
        WHERE len(w) >= size
    )
)
SELECT doc_id, item_id, n_shingles, count(*) AS n_shared,
    round(count(*) / n_shingles, 6) AS containment
FROM held JOIN wanted USING (size, shingle) JOIN totals USING (item_id)
GROUP BY doc_id, item_id, n_shingles
HAVING 100 * count(*) >= 80 * n_shingles
"""


def _merkle(levels: int, upper: int) -> str:
    """The manifest for trees of up to ``8 ** levels`` leaves and ``8 ** upper`` languages."""
    fields = ["doc_id", "source", "lang", "n_chars"]

    def leaf(text: str) -> str:
        parts = [f"coalesce(strlen({f}::VARCHAR) || ':' || {f}, '-')" for f in (*fields, text)]
        return f"sha256({' || '.join(parts)})"

    checksum = """xor(list_reduce(list_prepend(4294967295::BIGINT,
        [ord(c)::BIGINT FOR c IN string_split(doc_id::VARCHAR, '')]),
        lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
            lambda r, z: xor(r >> 1, 3988292384 * (r & 1)))), 4294967295)"""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    steps = [
        f"""chosen AS (
    SELECT *, coalesce({checksum} % 3 = 0, false) AS tampered FROM documents
), leaves AS (
    SELECT doc_id, coalesce('=' || lang, '') AS tree, {leaf("text")} AS digest,
        CASE WHEN tampered THEN {leaf(lower)} ELSE {leaf("text")} END AS changed
    FROM chosen
), nodes0 AS (
    SELECT *, digest AS own, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos,
        count(*) OVER (PARTITION BY tree) AS n
    FROM leaves
), fold0 AS (
    SELECT doc_id, tree, digest AS leaf, changed AS node, pos, n, '' AS siblings FROM nodes0
)"""
    ]

    def climb(at: int) -> None:
        steps.append(f"""runs{at} AS (
    SELECT tree, pos // 8 AS pos, string_agg(digest, '' ORDER BY pos) AS run, max(n) AS n FROM nodes{at}
    GROUP BY tree, pos // 8
), nodes{at + 1} AS (
    SELECT tree, pos, CASE WHEN n = 1 THEN run ELSE sha256(run) END AS digest, (n + 7) // 8 AS n FROM runs{at}
), cut{at} AS (
    SELECT f.*, CASE WHEN f.n > 1 THEN left(run, 64 * (f.pos % 8)) ELSE '' END AS before,
        CASE WHEN f.n > 1 THEN substr(run, 64 * (f.pos % 8) + 65) ELSE '' END AS after
    FROM fold{at} f JOIN runs{at} r ON f.tree = r.tree AND f.pos // 8 = r.pos
), fold{at + 1} AS (
    SELECT * EXCLUDE (before, after, node, siblings, pos, n), pos // 8 AS pos, (n + 7) // 8 AS n,
        siblings || before || after AS siblings,
        CASE WHEN n > 1 THEN sha256(before || node || after) ELSE node END AS node
    FROM cut{at}
)""")

    for at in range(levels):
        climb(at)
    top = levels + 1
    steps.append(f"""subroots AS (
    SELECT tree, digest AS subroot FROM nodes{levels}
), nodes{top} AS (
    SELECT '' AS tree, tree AS language, subroot AS digest, row_number() OVER (ORDER BY tree) - 1 AS pos,
        count(*) OVER () AS n
    FROM subroots
), fold{top} AS (
    SELECT f.* EXCLUDE (tree, pos, n), '' AS tree, t.pos, t.n, t.digest AS subroot
    FROM fold{levels} f JOIN nodes{top} t ON f.tree = t.language
)""")
    for at in range(top, top + upper):
        climb(at)
    last = top + upper
    return f"""WITH {", ".join(steps)}
SELECT f.doc_id, leaf, subroot, r.digest AS root, sha256(siblings) AS proof_sha256, node AS folded_root,
    node = r.digest AS verified
FROM fold{last} f, nodes{last} r"""


ORACLES["op11_merkle_manifest"] = _merkle(levels=8, upper=3)

ORACLES["op12_source_divergence"] = r"""
WITH docs AS (
    SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents
), used AS (
    SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), counts AS (
    SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS docs FROM used GROUP BY ALL
), kept AS (
    SELECT lang, term, sum(n) AS n FROM counts GROUP BY ALL HAVING sum(docs) >= 30
), groups AS (
    SELECT DISTINCT lang, source FROM docs
), cells AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS lang_n
    FROM groups g JOIN kept k ON g.lang = k.lang
    LEFT JOIN counts c ON g.lang = c.lang AND g.source = c.source AND k.term = c.term
), totalled AS (
    SELECT *, sum(n) OVER g AS total, count(*) OVER g AS v, sum(lang_n) OVER g AS lang_total
    FROM cells WINDOW g AS (PARTITION BY lang, source)
), shares AS (
    SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (total + 5 * v)::HUGEINT AS p,
        1 + (1000000000::HUGEINT * (lang_n + 5)) // (lang_total + 5 * v)::HUGEINT AS q
    FROM totalled
), apart AS (
    SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
    GROUP BY ALL
), parts AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM ranked WHERE part = 'pair' OR rank <= 50
"""
