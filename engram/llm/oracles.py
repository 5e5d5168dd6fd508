"""SQL for DuckDB with the rows of those queries that SQL can say."""

from __future__ import annotations

_AZ, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _level(k: int) -> str:
    """The level's segments, their branches and the longer templates."""
    return f"""s{k} AS (SELECT *, CASE WHEN regexp_matches(seg, '^([0-9][0-9_.-]*|[0-9a-fA-F]{{8,}}|[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}})(\\.[0-9A-Za-z_]{{1,5}})?$') THEN '*' ELSE seg END AS segment
  FROM (SELECT *, CASE WHEN NOT closed THEN parts[{k + 1}] END AS seg FROM l{k})),
c{k} AS (SELECT host, template, segment, segment <> '*' AS named, COUNT(*) AS pages, COUNT(bad) AS n, COALESCE(SUM(bad), 0) AS k FROM s{k} WHERE segment IS NOT NULL GROUP BY 1, 2, 3),
p{k} AS (SELECT host, template, SUM(pages) AS beyond, COUNT(*) FILTER (WHERE named) AS kinds, SUM(n) FILTER (WHERE named) AS all_n, SUM(k) FILTER (WHERE named) AS all_k FROM c{k} GROUP BY 1, 2),
b{k} AS (SELECT *, named AND pages < 8 AND kinds > 24 AS rare, named AND kinds > 1 AND NOT (n > 0 AND all_n - n > 0 AND abs(k / greatest(n, 1) - (all_k - k) / greatest(all_n - n, 1)) > 1.96 * sqrt(p * (1 - p) * (1 / greatest(n, 1) + 1 / greatest(all_n - n, 1)))) AS alike
  FROM (SELECT *, (all_k + 1) / (all_n + 2) AS p FROM c{k} JOIN p{k} USING (host, template))),
w{k} AS (SELECT host, template, segment, beyond < 8 AS ended, rare OR (alike AND COUNT(*) FILTER (WHERE alike AND NOT rare) OVER (PARTITION BY host, template) > 1) AS wild FROM b{k}),
l{k + 1} AS (SELECT page_id, s.host, path, parts, bad, closed OR COALESCE(ended, false) AS closed, s.template || CASE WHEN s.segment IS NULL THEN '' WHEN ended THEN '/**' WHEN wild THEN '/*' ELSE '/' || s.segment END AS template
  FROM s{k} s LEFT JOIN w{k} b ON b.host = s.host AND b.template = s.template AND b.segment = s.segment)"""


#: Levels that the SQL has, at least as many as any path of the tables.
LEVELS = 5
_RULE = """CASE WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/' WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN ends_with('.' || host, '.net') AND starts_with(path, '/es/') THEN 'net/es/' WHEN ends_with('.' || host, '.net') AND starts_with(path, '/fr/') THEN 'net/fr/' WHEN ends_with('.' || host, '.com') AND starts_with(path, '/') THEN 'com/' END"""
OP1 = f"""WITH judged AS (SELECT doc_id, MAX(toxic) AS bad FROM labels WHERE toxic IS NOT NULL GROUP BY 1),
u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_AZ}', '{_LOW}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
l0 AS (SELECT page_id, host, path, string_split(regexp_replace(path, '^/', ''), '/') AS parts, bad, false AS closed, '' AS template FROM h LEFT JOIN judged ON doc_id = page_id),
{", ".join(_level(k) for k in range(LEVELS))},
t AS (SELECT host, template, COUNT(bad) AS n, (COALESCE(SUM(bad), 0) + COALESCE((SELECT AVG(bad) FROM judged), 0) * 4.0) / (COUNT(bad) + 4.0) AS bad_share FROM l{LEVELS} GROUP BY 1, 2)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN n >= 8 AND bad_share > 2.0 * COALESCE((SELECT AVG(bad) FROM judged), 0) THEN 'block' ELSE 'allow' END AS verdict, template, bad_share
FROM (SELECT *, {_RULE} AS rule FROM l{LEVELS} JOIN t USING (host, template))"""

_COMPONENTS = """reach AS (SELECT id AS a, id AS b FROM nodes UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b), least AS (SELECT a AS id, MIN(b) AS component_id FROM reach GROUP BY a)"""
OP2 = f"""WITH RECURSIVE w AS (SELECT doc_id AS id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_AZ}', '{_LOW}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE CAST([] AS VARCHAR[]) END) AS g FROM w),
n AS (SELECT id, COUNT(*) AS n FROM s GROUP BY id), pairs AS (SELECT x.id AS a, y.id AS b, COUNT(*) AS m FROM s x JOIN s y ON x.g = y.g AND x.id <> y.id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE 100 * m >= 75 * (p.n + q.n - m)), nodes AS (SELECT id FROM w), {_COMPONENTS}
SELECT w.id AS doc_id, COALESCE(n.n, 0) AS n_shingles, component_id FROM w LEFT JOIN n ON n.id = w.id JOIN least ON least.id = w.id"""

_HASH = "CAST('0x' || substring(md5({0}), 1, 8) AS BIGINT)"
OP3 = f"""WITH d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k, CAST(COALESCE(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
e AS (SELECT *, length(bin(size)) * 16 + (size >> CAST(greatest(length(bin(size)) - 4, 0) AS INT)) AS class, {_HASH.format("COALESCE(CAST(doc_id AS VARCHAR), '')")} % 256 AS salt FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY class, salt, size, doc_id) AS place FROM e),
z AS (SELECT k, CAST(SUM(size) AS BIGINT) AS source_size FROM d GROUP BY k),
w AS (SELECT *, [1.0, 2.0, 3.0][(row_number() OVER (ORDER BY k) - 1) % 3 + 1]::DOUBLE AS weight, source_size * 3.0::DOUBLE AS fill FROM z),
v AS (SELECT *, fill / weight AS ratio, ((SELECT SUM(source_size) FROM z)::DOUBLE - COALESCE(SUM(fill) OVER (ORDER BY fill / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / SUM(weight) OVER (ORDER BY fill / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT k, source_size, least(fill, COALESCE(weight * (SELECT level FROM v WHERE level <= ratio ORDER BY ratio, k LIMIT 1), fill)) AS target FROM v),
c AS (SELECT r.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS each, {_HASH.format("'1:' || r.k")} / 4294967296.0::DOUBLE AS offset_ FROM r JOIN t USING (k))
SELECT doc_id, size, source_size, target, CAST(floor(offset_ + each * place) - floor(offset_ + each * (place - 1)) AS BIGINT) * size AS taken FROM c"""

OP4 = """WITH RECURSIVE m AS (SELECT *, role = 'assistant' AS is_call, role = 'user' AND turn > 0 AS is_result, turn % 3 = 0 AS lookup FROM conversations),
c AS (SELECT m.*, EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = m.conv_id AND d.turn = m.turn + 1 AND d.role = 'user') AS answered, EXISTS (SELECT 1 FROM conversations d WHERE d.conv_id = m.conv_id AND d.turn = m.turn - 1 AND d.role = 'assistant') AS asked,
  CASE WHEN lookup THEN '{"id":' || CASE WHEN conv_id % 5 = 0 THEN '"' || conv_id || '"' ELSE CAST(conv_id AS VARCHAR) END || ',"strict":true}' ELSE '{"query":"conversation ' || conv_id || '","top":' || turn || '}' END AS args FROM m),
e AS (SELECT DISTINCT a.conv_id, a.turn AS before, b.turn AS after FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 WHERE (a.role = 'assistant' AND b.role = 'user')
  OR (a.role = 'user' AND a.turn > 0 AND b.role = 'assistant')),
chain AS (SELECT DISTINCT conv_id, before AS turn, 0 AS depth FROM e UNION SELECT e.conv_id, after, depth + 1 FROM chain JOIN e ON e.conv_id = chain.conv_id AND e.before = chain.turn),
deepest AS (SELECT conv_id, turn, MAX(depth) AS depth FROM chain GROUP BY 1, 2)
SELECT conv_id, turn, role, CASE WHEN is_result THEN CASE WHEN asked THEN 'linked' ELSE 'orphan' END WHEN is_call THEN CASE WHEN answered THEN 'answered' ELSE 'unanswered' END ELSE 'none' END AS link,
CAST(COALESCE(depth, 0) AS BIGINT) AS depth, CASE WHEN is_call THEN NOT (lookup AND conv_id % 5 = 0) END AS valid, CASE WHEN is_call THEN CASE WHEN lookup AND conv_id % 5 = 0 THEN 'type of id' ELSE '' END END AS errors,
'{' || array_to_string(list_filter(['"content":' || to_json(text)::VARCHAR, '"role":' || to_json(role)::VARCHAR,
  CASE WHEN is_call THEN '"tool_call":{"arguments":' || to_json(args)::VARCHAR || ',"id":"call-' || conv_id || '-' || turn || '","name":"' || CASE WHEN lookup THEN 'lookup' ELSE 'search' END || '"}' END,
  CASE WHEN is_result THEN '"tool_call_id":"call-' || conv_id || '-' || (turn - 1) || '"' END], lambda x: x IS NOT NULL), ',') || '}' AS message_json FROM c LEFT JOIN deepest USING (conv_id, turn)"""

OP5 = f"""WITH RECURSIVE links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id <> y.vec_id AND list_cosine_similarity(CAST(x.embedding AS DOUBLE[]), CAST(y.embedding AS DOUBLE[])) >= 0.98),
nodes AS (SELECT vec_id AS id FROM embeddings), {_COMPONENTS}
SELECT id AS vec_id, (SELECT COUNT(*) FROM links WHERE a = id) AS n_links, component_id, id = component_id AS kept FROM least"""

OP6 = "SELECT doc_id, lang, source, CAST(strlen(text) AS BIGINT) AS n_bytes, md5(text) AS text_md5 FROM documents"

OP10 = """WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages), f AS (SELECT payload AS same, MIN(page_id) AS first_id FROM p WHERE strlen(payload) >= 100 GROUP BY 1)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest, CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first_id < page_id THEN first_id END AS refers_to FROM p LEFT JOIN f ON same = payload"""

#: Levels that the SQL has: 16^4 documents of a source and as many sources.
DEPTH = 4


def _tree(nodes: str, paths: str) -> str:
    """Levels over nodes (g, idx, d, m) as {nodes}0 .., and the leaves' way up through them as {paths}0 ..: rid, idx, folded, proof."""
    out = []
    for k in range(DEPTH):
        out.append(f"""r{nodes}{k} AS (SELECT g, idx // 16 AS up, list(d ORDER BY idx) AS run, any_value(m) AS m FROM {nodes}{k} WHERE m > 1 GROUP BY 1, 2),
{nodes}{k + 1} AS (SELECT g, up AS idx, sha256(array_to_string(run, '')) AS d, (m + 15) // 16 AS m FROM r{nodes}{k} UNION ALL SELECT g, idx, d, m FROM {nodes}{k} WHERE m = 1),
{paths}{k + 1} AS (SELECT rid, g, idx // 16 AS idx, CASE WHEN run IS NULL THEN folded ELSE sha256(lft || folded || rgt) END AS folded, CASE WHEN run IS NULL THEN proof ELSE proof || lft || rgt END AS proof
  FROM (SELECT p.*, run, COALESCE(array_to_string(run[1:p.idx % 16], ''), '') AS lft, COALESCE(array_to_string(run[p.idx % 16 + 2:], ''), '') AS rgt FROM {paths}{k} p LEFT JOIN r{nodes}{k} r ON r.g = p.g AND r.up = p.idx // 16))""")
    return ",\n".join(out)


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR) END"
_FIELDS = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{0}"))
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, range(0, 8 * strlen(CAST(doc_id AS VARCHAR)))), lambda c, i: xor(xor(c, CASE WHEN i % 8 = 0 THEN ascii(CAST(doc_id AS VARCHAR)[i // 8 + 1])::BIGINT ELSE 0::BIGINT END) >> 1,
  3988292384::BIGINT * (xor(c, CASE WHEN i % 8 = 0 THEN ascii(CAST(doc_id AS VARCHAR)[i // 8 + 1])::BIGINT ELSE 0::BIGINT END) & 1))), 4294967295::BIGINT)"""
OP13 = f"""WITH base AS (SELECT row_number() OVER () AS rid, doc_id, CASE WHEN source IS NULL THEN '' ELSE '0' || source END AS g, sha256({_FIELDS.format("text")}) AS leaf,
  sha256({_FIELDS.format(f"translate(text, '{_AZ}', '{_LOW}')")}) AS lowered, COALESCE({_CRC} % 5 = 0, false) AS tampered FROM documents),
n AS (SELECT rid, g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS idx, leaf AS d, COUNT(*) OVER (PARTITION BY g) AS m, CASE WHEN tampered THEN lowered ELSE leaf END AS start FROM base),
n0 AS (SELECT g, idx, d, m FROM n), p0 AS (SELECT rid, g, idx, start AS folded, '' AS proof FROM n), {_tree("n", "p")},
q AS (SELECT g AS source, row_number() OVER (ORDER BY g) - 1 AS idx, d, COUNT(*) OVER () AS m FROM n{DEPTH}),
q0 AS (SELECT '' AS g, idx, d, m FROM q), u0 AS (SELECT rid, '' AS g, q.idx, folded, proof FROM p{DEPTH} p JOIN q ON q.source = p.g), {_tree("q", "u")}
SELECT doc_id, leaf, q.d AS subroot, r.d AS root, sha256(u.proof) AS proof_sha256, u.folded AS folded_root, u.folded = r.d AS verified FROM base JOIN u{DEPTH} u USING (rid) JOIN q ON q.source = base.g CROSS JOIN q{DEPTH} r"""

ORACLE_SQL = {"op1_url_filter": OP1, "op2_jaccard_join": OP2, "op3_mixing": OP3, "op4_chat_formatting": OP4, "op5_embedding_dedup": OP5, "op6_sharding": OP6, "op10_warc": OP10, "op13_merkle_manifest": OP13}
