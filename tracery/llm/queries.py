"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from . import sharding
from .bpe import op6_bpe
from .embeddings import op4_near_duplicates
from .filter_audit import op12_filters
from .importance import op13_importance
from .jaccard import op10_jaccard
from .jpeg import op7_media
from .langid import op1_language
from .neighbours import op11_neighbours
from .packing import op5_packing
from .sharding import op8_sharding
from .substrings import op3_substrings
from .token_files import op2_token_files
from .toxicity import op9_toxicity


def queries() -> dict:
    ops = [op1_language, op2_token_files, op3_substrings, op4_near_duplicates, op5_packing, op6_bpe, op7_media, op8_sharding, op9_toxicity, op10_jaccard, op11_neighbours, op12_filters, op13_importance]
    return {f.__name__: f for f in ops}


WORD = r"[^\x20\x09-\x0D]+"
OP3 = f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
w AS (SELECT doc_id, len(ws) AS n, unnest(generate_series(1, len(ws))) AS i, unnest(ws) AS word FROM d),
k AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS words FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 19)) AS i FROM d WHERE len(ws) >= 20)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY words ORDER BY doc_id, i) AS nth FROM k) WHERE nth > 1),
g AS (SELECT w.*, max((l.i IS NOT NULL)::INT) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) = 1 AS gone FROM w LEFT JOIN late l ON l.doc_id = w.doc_id AND l.i = w.i),
r AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM g GROUP BY 1)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)"""

#: From pairs (a, b) of linked ids, both ways: the smallest id that each reaches.
REACH = "reach AS (SELECT a AS node, b AS other FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other), low AS (SELECT node, min(other) AS least FROM reach GROUP BY 1)"
OP4 = f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), good AS (SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS size FROM v WHERE x IS NOT NULL AND len([y FOR y IN x IF y IS NULL OR NOT isfinite(y)]) = 0 AND len([y FOR y IN x IF y <> 0]) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_dot_product(a.x, b.x) / (a.size * b.size) >= 0.9::DOUBLE), {REACH}
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(least, vec_id)) AS kept FROM v LEFT JOIN low ON node = vec_id"""

OP10 = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS h FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 3))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1), gn AS (SELECT g.*, n FROM g JOIN n USING (doc_id)),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS common FROM gn a JOIN gn b ON a.h = b.h AND a.doc_id < b.doc_id AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 85 GROUP BY 1, 2),
linked AS (SELECT a, b FROM c WHERE 100 * common >= 85 * (na + nb - common)), links AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked), {REACH}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(least, d.doc_id)) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN low ON node = d.doc_id"""

OP11 = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), good AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND x IS NOT NULL AND len([y FOR y IN x IF y IS NULL OR NOT isfinite(y)]) = 0 AND len([y FOR y IN x IF y <> 0]) > 0),
d AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce([(q.x[i] - c.x[i]) * (q.x[i] - c.x[i]) FOR i IN range(1, len(q.x) + 1)], lambda a, b: a + b)) AS score FROM good q JOIN good c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INT AS rank FROM d) SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""

OP12 = r"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
e AS (SELECT *, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
b AS (SELECT doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, (len(ws) < 50)::INT AS a, (100 * len(list_distinct(ws)) < 65 * len(ws))::INT AS b, (100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * len(text))::INT AS c, regexp_matches(text, '[#$%&*|]')::INT AS d, coalesce(doc_id > least, false)::INT AS e FROM e LEFT JOIN (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1) USING (doc_id)),
m AS (SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM b GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT p.x||q.x||r.x||s.x||t.x AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits FROM l p, l q, l r, l s, l t WHERE p.bit + q.bit + r.bit + s.bit + t.bit = 31 AND p.bit | q.bit | r.bit | s.bit | t.bit = 31),
k AS (SELECT filter_order, i AS step, bits[i] AS bit, coalesce(list_sum(bits[1:i - 1]), 0)::INT AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS i)),
s AS (SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN n ELSE 0 END) AS removed, sum(CASE WHEN mask & before > 0 AND mask & bit > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & before = 0 AND mask & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost FROM m, k GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM s"""


def op8_sql() -> str:
    """The table of slots as one string, a character a slot."""
    table = "".join(chr(48 + k) for k in sharding.lookup_table([f"shard-{i:03d}" for i in range(64)]))
    return f"""WITH s AS (SELECT doc_id, source, octet_length(encode(text)) AS n_bytes, (('0x'||substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT % {sharding.SLOTS})::INT AS slot FROM documents)
SELECT doc_id, source, n_bytes, slot, 'shard-'||lpad((ascii(substr('{table}', slot + 1, 1)) - 48)::VARCHAR, 3, '0') AS shard FROM s"""


def oracle_sql() -> dict[str, str]:
    return {"op3_substrings": OP3, "op4_near_duplicates": OP4, "op8_sharding": op8_sql(), "op10_jaccard": OP10, "op11_neighbours": OP11, "op12_filters": OP12}
