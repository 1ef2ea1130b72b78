"""DuckDB SQL for the queries of this subpackage that SQL can express on whole tables."""

from __future__ import annotations

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS8 = r"regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP8 = f"""
WITH d AS (SELECT doc_id, {_WORDS8} AS w FROM documents),
b AS (SELECT item_id, {_WORDS8} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n,
              array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS s
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hits AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
        FROM (SELECT DISTINCT doc_id, item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

OP1 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e,
         label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
         AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS usable FROM embeddings),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE a.usable AND b.usable AND list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.98),
reach AS (SELECT vec_id AS node, vec_id AS low FROM v UNION SELECT l.b, r.low FROM reach r JOIN links l ON l.a = r.node WHERE r.low < l.b),
comp AS (SELECT node, min(low) AS component_id FROM reach GROUP BY node),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN comp ON node = vec_id LEFT JOIN n ON a = vec_id
"""


def _escaped(x: str) -> str:
    x = rf"replace({x}, '\', '\\')"
    for control in ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"):
        x = f"replace({x}, '{control}', '{control[0]}\\{control[1:]}')"
    return x


OP5 = f"""
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(8 + length(role) + length({_escaped('text')}))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""

_URN = "'<urn:uuid:'||" + "||'-'||".join(f"substr(m, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + "||'>'"


def _record(html: str) -> str:
    crlf = "chr(13)||chr(10)"
    return (f"'WARC/1.1'||{crlf}||'WARC-Type: resource'||{crlf}||'WARC-Date: 1970-01-01T00:00:00Z'||{crlf}||'WARC-Record-ID: '||{_URN}||{crlf}||'WARC-Target-URI: '||url||{crlf}"
            f"||'Content-Type: text/html'||{crlf}||'Content-Length: '||strlen({html})::VARCHAR||{crlf}||{crlf}||{html}||{crlf}||{crlf}")


_AT = "coalesce(sum(length{0}) OVER (PARTITION BY archive ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT"

OP6 = f"""
WITH n AS (SELECT greatest(1, ceil(count(*) / 1024.0))::BIGINT AS n FROM pages),
d AS (SELECT page_id, url, html, md5(concat_ws(chr(10), page_id::VARCHAR, url)) AS m, page_id % 389 = 7 AS lost,
             CASE page_id % 97 WHEN 13 THEN (CASE WHEN html[1:1] = '#' THEN '%' ELSE '#' END) || html[2:] WHEN 14 THEN html || '<p>grown' WHEN 15 THEN substr(html, 4) ELSE html END AS other FROM pages),
r AS (SELECT page_id, ('0x' || substr(m, 1, 15))::BIGINT % n AS archive, {_URN} AS record_id, lost, {_record('html')} AS rec, {_record('other')} AS rep FROM d, n),
l AS (SELECT page_id, archive, record_id, strlen(rec)::BIGINT AS length, sha256(rec) AS sha_primary,
             CASE WHEN NOT lost THEN strlen(rep)::BIGINT END AS length_replica, CASE WHEN NOT lost THEN sha256(rep) END AS sha_replica FROM r),
p AS (SELECT *, {_AT.format('')} AS start, CASE WHEN sha_replica IS NOT NULL THEN {_AT.format('_replica')} END AS start_replica FROM l)
SELECT archive, record_id, CASE WHEN sha_replica IS NULL THEN 'missing' ELSE 'altered' END AS status, start, length, sha_primary,
       coalesce(start_replica, -1) AS start_replica, coalesce(length_replica, -1) AS length_replica, sha_replica
FROM p WHERE sha_replica IS NULL OR sha_primary <> sha_replica
"""

ORACLES: dict[str, str] = {
    "op1_embeddings": OP1,
    "op5_chat": OP5,
    "op6_warc": OP6,
    "op8_decontaminate": OP8,
}
