"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from sitelode.llm import mixing, secrets
from sitelode.llm.common import LOWER, UPPER

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+')"


def _shingles(name: str, key: str, source: str) -> str:
    """A CTE of distinct five-word shingles: (key, s)."""
    return f"""{name} AS (SELECT DISTINCT {key}, unnest(list_transform(range(1, greatest(len(w) - 3, 2)),
        lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM (SELECT {key}, {_WORDS} AS w FROM {source}) WHERE len(w) > 0)"""


def _components(nodes: str, key: str) -> str:
    """CTEs from `link(a, b)` in both directions: component(node, low)."""
    return f"""reach(node, other) AS (SELECT {key}, {key} FROM {nodes} UNION SELECT r.node, l.b FROM reach r JOIN link l ON l.a = r.other),
    component AS (SELECT node, min(other) AS low FROM reach GROUP BY node)"""


OP1 = f"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
{_components('embeddings', 'vec_id')}
SELECT vec_id, (SELECT count(*) FROM link WHERE a = vec_id) AS n_links, low AS component_id, vec_id = low AS kept
FROM embeddings JOIN component ON node = vec_id"""

_CRC_TABLE = """t AS (SELECT list(v ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)))"""

OP4 = f"""WITH RECURSIVE {_CRC_TABLE},
d AS (SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS pairs FROM documents),
c AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(pairs, lambda p: ('0x' || p)::BIGINT)),
    lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32 FROM d, t),
jump(doc_id, n, k, b, j) AS (
    SELECT doc_id, n, doc_id::HUGEINT, -1::BIGINT, 0::BIGINT FROM documents, (VALUES (24), (25)) s(n)
    UNION ALL
    SELECT doc_id, n, k2, j, floor((j + 1) * (2147483648::DOUBLE / ((k2 // 8589934592) + 1)::DOUBLE))::BIGINT
    FROM (SELECT *, ((k % 4294967296) * 2862933555777941757 + (((k // 4294967296) * 2862933555777941757) % 4294967296) * 4294967296 + 1) % 18446744073709551616 AS k2 FROM jump WHERE j < n)),
s AS (SELECT doc_id, max(b) FILTER (n = 24)::INT AS shard, max(b) FILTER (n = 25)::INT AS grown_shard FROM jump WHERE j >= n GROUP BY doc_id)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, grown_shard FROM c JOIN s USING (doc_id)"""

OP5 = f"""WITH RECURSIVE {_shingles('g', 'doc_id', 'documents')},
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
both_have AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM both_have JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
{_components('documents', 'doc_id')}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, low AS component_id FROM documents d JOIN component ON node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""

# Items of fewer than five words are searched as runs of their own length.
OP8 = f"""WITH {_shingles('g5', 'doc_id', 'documents')}, {_shingles('i', 'item_id', 'benchmark')},
short AS (SELECT DISTINCT len({_WORDS}) AS l FROM benchmark WHERE len({_WORDS}) BETWEEN 1 AND 4),
g AS (SELECT * FROM g5 UNION SELECT doc_id, unnest(list_transform(range(1, len(w) - l + 2), lambda i: array_to_string(w[i:i + l - 1], ' ')))
    FROM (SELECT doc_id, {_WORDS} AS w FROM documents), short WHERE len(w) > l),
n AS (SELECT item_id, count(*) AS n_shingles FROM i GROUP BY item_id)
SELECT doc_id, item_id, floor(log2(n_shingles))::INT AS size_class, n_shingles, count(*) AS n_common
FROM g JOIN i USING (s) JOIN n USING (item_id) GROUP BY ALL HAVING 100 * count(*) >= 75 * n_shingles"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _found(kind_no: int, kind: str, pattern: str, test: str) -> str:
    """Spans of one kind: pieces between matches and matches give the offsets."""
    return f"""SELECT row, {kind_no} AS kind_no, '{kind}' AS kind, start, start + length(m) AS stop FROM (
        SELECT row, m, p + list_sum(list_transform(pieces[1:i], lambda x: length(x))) AS start FROM (
            SELECT row, i, matches[i] AS m, pieces, coalesce(list_sum(list_transform(matches[1:i - 1], lambda x: length(x))), 0) AS p FROM (
                SELECT row, matches, pieces, unnest(range(1, len(matches) + 1)) AS i FROM (
                    SELECT row, regexp_extract_all(text, {_quoted(pattern)}) AS matches, regexp_split_to_array(text, {_quoted(pattern)}) AS pieces FROM d)))) WHERE {test}"""


def _op2() -> str:
    kinds = []
    for number, (kind, pattern, group, least) in enumerate(secrets.BASE_KINDS):
        value = f"regexp_extract(m, {_quoted(pattern)}, {group})" if group else "m"
        kinds.append(_found(number, kind, pattern, f"length({value}) >= {least}"))
    allowed = " AND ".join(f"NOT regexp_matches(m, {_quoted(a)})" for a in secrets.ALLOWED)
    weights = "[" + ",".join(map(str, secrets._weights(secrets.WINDOW))) + "]"
    classes = " OR ".join(
        f"""len(list_filter(flatten(list_transform(list_filter(regexp_extract_all(m, '{runs}'), lambda r: length(r) >= {secrets.WINDOW}),
            lambda r: list_transform(range(1, length(r) - {secrets.WINDOW} + 2), lambda i: r[i:i + {secrets.WINDOW - 1}]))),
            lambda x: list_sum(list_transform(list_distinct(string_split(x, '')), lambda c: {weights}[1 + len(x) - len(replace(x, c, ''))])) <= {secrets.least_sum(bits, secrets.WINDOW)})) > 0"""
        for _, runs, bits in secrets.CLASSES
    )
    kinds.append(_found(len(secrets.BASE_KINDS), secrets.ENTROPY_KIND, secrets.CANDIDATE, f"{allowed} AND ({classes})"))
    listed = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, kind_no, stop)"
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in ("assign", "access", "hex", "entropy"))
    return f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
    span AS ({' UNION ALL '.join(kinds)})
    SELECT doc_id, {counts}, sha256(coalesce({listed} FILTER (kind <> 'entropy'), '')) AS base_sha256, coalesce({listed}, '') AS spans
    FROM d LEFT JOIN span USING (row) GROUP BY row, doc_id"""


# Paths are lists of turn digests; every prefix of every rebuilt conversation is listed.
OP11 = f"""WITH {_CRC_TABLE},
turn AS (SELECT conv_id, turn, sha256(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS d, strlen(coalesce(text, '')) AS b
    FROM conversations WHERE conv_id IS NOT NULL),
conv AS (SELECT conv_id, list(d ORDER BY turn NULLS FIRST, d) AS ds, list(b ORDER BY turn NULLS FIRST, d) AS bs FROM turn GROUP BY conv_id),
head AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(conv_id::VARCHAR)), '..'), lambda p: ('0x' || p)::BIGINT)),
    lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % 9 AS h FROM conv, t),
built AS (SELECT a.conv_id, list_concat(coalesce(z.ds[1:a.h], []), a.ds[a.h + 1:]) AS ds, list_concat(coalesce(z.bs[1:a.h], []), a.bs[a.h + 1:]) AS bs
    FROM head a LEFT JOIN conv z ON z.conv_id = a.conv_id - a.conv_id % 5),
pre AS (SELECT conv_id, ds[1:k] AS path, k, len(ds) = k AS ends, CASE WHEN k > 0 THEN bs[k] ELSE 0 END AS b
    FROM (SELECT *, unnest(range(0, len(ds) + 1)) AS k FROM built)),
node AS (SELECT path, k AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(b) AS b,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM pre GROUP BY path, k),
child AS (SELECT path[1:depth - 1] AS path, count(*) AS n FROM node WHERE depth > 0 GROUP BY 1),
full_node AS (SELECT node.*, coalesce(child.n, 0) AS n_children FROM node LEFT JOIN child ON child.path = node.path),
below AS (SELECT path[1:j] AS path, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum((n_convs - 1) * b)::BIGINT AS saved_tokens
    FROM (SELECT *, unnest(range(0, depth + 1)) AS j FROM full_node) GROUP BY 1)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, n.ends_sha256
FROM full_node n JOIN below ON below.path = n.path LEFT JOIN full_node p ON n.depth > 0 AND p.path = n.path[1:n.depth - 1]"""

# A source is full when its cap is at most its share of what the sources full before it leave.
OP13 = f"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    ('0x' || substr(md5(concat('{mixing.SEED}|', coalesce(doc_id::VARCHAR, ''), '|', md5(coalesce(text, '')))), 1, {mixing.DRAW_BITS // 4}))::BIGINT AS draw FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, {mixing.MOST_REPEATS} * source_size::HUGEINT AS cap FROM s),
o AS (SELECT *, sum(source_size) OVER () AS t, sum(weight) OVER () AS ws,
    sum(cap) OVER p - cap AS c_before, sum(weight) OVER p - weight AS w_before
    FROM w WINDOW p AS (ORDER BY cap * 6 // weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
f AS (SELECT *, cap * (ws - w_before) <= (t - c_before) * weight AS is_full FROM o),
g AS (SELECT coalesce(sum(cap) FILTER (is_full), 0) AS c, coalesce(sum(weight) FILTER (is_full), 0) AS cw FROM f),
targets AS (SELECT source, source_size, CASE WHEN is_full THEN cap::DOUBLE ELSE weight::DOUBLE * (t - c)::DOUBLE / greatest(ws - cw, 1)::DOUBLE END AS target FROM f, g),
r AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0.0::DOUBLE END AS rate
    FROM d JOIN targets ON targets.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies, source
FROM (SELECT *, floor(rate)::BIGINT + CASE WHEN draw::DOUBLE / {1 << mixing.DRAW_BITS}::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END AS copies FROM r)"""


SQL: dict[str, str] = {
    "op1_embedding_near_dup": OP1,
    "op2_secret_scan": _op2(),
    "op4_sharding": OP4,
    "op5_ngram_join": OP5,
    "op8_decontamination": OP8,
    "op11_conversation_trie": OP11,
    "op13_source_mixing": OP13,
}
