"""DuckDB SQL of the operators that SQL can express whole.

The learned operators (1, 3, 6, 8, 9), the codecs (4, 10) and banded alignment (7) have none;
tests hold them against brute force, round trips and held-out labels.
"""

SPACE = r"[\x09-\x0D ]+"

#: Windows of 20 words that start earlier elsewhere, as a difference array over word places.
OP2 = f"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE}'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS pos, w FROM d WHERE len(w) >= 20),
q AS (SELECT doc_id, pos, array_to_string(w[pos:pos + 19], ' ') AS seq FROM s),
gone AS (SELECT doc_id, pos FROM q QUALIFY row_number() OVER (PARTITION BY seq ORDER BY doc_id, pos) > 1),
edge AS (SELECT doc_id, pos, sum(step) AS step FROM (SELECT doc_id, pos, 1 AS step FROM gone UNION ALL SELECT doc_id, pos + 20, -1 FROM gone) GROUP BY ALL),
word AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
mark AS (SELECT word.doc_id, word.pos, word, sum(coalesce(step, 0)) OVER (PARTITION BY word.doc_id ORDER BY word.pos ROWS UNBOUNDED PRECEDING) > 0 AS off FROM word LEFT JOIN edge ON edge.doc_id = word.doc_id AND edge.pos = word.pos),
run AS (SELECT *, off AND NOT coalesce(lag(off) OVER (PARTITION BY doc_id ORDER BY pos), false) AS begins FROM mark),
kept AS (SELECT doc_id, count(*) FILTER (off) AS n_removed, count(*) FILTER (begins) AS n_repeats, coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT off), '') AS text FROM run GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256, coalesce(n_repeats, 0) AS n_repeats FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

#: Exact links by shared shingles, and the smallest document reachable.
OP5 = f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SPACE}'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 85 * (a.n + b.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT m.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, m.doc_id = component_id AS kept FROM m LEFT JOIN n ON n.doc_id = m.doc_id
"""

#: Cuts between lines by the hash of seed and id; the text of form and output is the text itself.
OP12 = r"""
WITH u AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS l, sha256('7:' || doc_id) AS h FROM documents),
k AS (SELECT *, len(l) AS n, ('0x' || h[1:8])::BIGINT % (len(l) + 1) AS x, ('0x' || h[9:16])::BIGINT % (len(l) + 1) AS y, ('0x' || h[25:32])::BIGINT % 100 AS z FROM u),
f AS (SELECT *, least(x, y) AS a, greatest(x, y) AS b, CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') THEN 'plain' WHEN z < 50 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, array_to_string(l[1:a], '') AS pre, array_to_string(l[a + 1:b], '') AS mid, array_to_string(l[b + 1:n], '') AS suf FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""

CRC32 = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split_regex(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(0, 8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))))"

#: All prefixes of all rebuilt conversations; a subtree's sums by every node's path upwards, on its smallest conversation.
OP13 = f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS k, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
c AS (SELECT conv_id, n, {CRC32} % 6 AS h, conv_id - conv_id % 100 AS p FROM (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id)),
r AS (SELECT c.conv_id, c.h, c.p, least(c.h, coalesce(f.n, 0)) AS m FROM c LEFT JOIN c f ON f.conv_id = c.p),
e AS (SELECT r.conv_id, k AS place, role, text FROM r JOIN t ON t.conv_id = p AND k <= m UNION ALL SELECT r.conv_id, m + k - h, role, text FROM r JOIN t ON t.conv_id = r.conv_id WHERE k > h),
w AS (SELECT r.conv_id, coalesce(s, []) AS s, coalesce(l, []) AS l FROM r LEFT JOIN (SELECT conv_id, list(role || chr(31) || text ORDER BY place) AS s, list(length(text) ORDER BY place) AS l FROM e GROUP BY conv_id) x ON x.conv_id = r.conv_id),
v AS (SELECT conv_id, d, len(s) AS whole, CASE WHEN d > 0 THEN l[d] ELSE 0 END AS chars, md5(array_to_string(s[1:d], chr(30))) AS key, md5(array_to_string(s[1:d - 1], chr(30))) AS up FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM w)),
n AS (SELECT d, key, min(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, min(chars) AS chars, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (whole = d), '') AS ends FROM v GROUP BY d, key),
k AS (SELECT d - 1 AS d, up AS key, count(*) AS n_children FROM n WHERE d > 0 GROUP BY d, up),
o AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON k.d = n.d AND k.key = n.key),
a AS (SELECT v.d, v.key, count(*) FILTER (o.n_children = 0) AS n_leaves, sum((o.n_convs - 1) * o.chars)::BIGINT AS saved_tokens FROM o JOIN v ON v.conv_id = o.conv_id AND v.d <= o.d GROUP BY v.d, v.key)
SELECT o.conv_id, o.d::BIGINT AS depth, q.conv_id AS parent_conv_id, o.n_convs, o.n_children, n_leaves, saved_tokens, sha256(o.ends) AS ends_sha256
FROM o JOIN a ON a.d = o.d AND a.key = o.key LEFT JOIN o q ON q.d = o.d - 1 AND q.key = o.up
"""

ORACLES: dict[str, str] = {"op2_substring_dedup": OP2, "op5_near_dedup": OP5, "op12_fill_in_middle": OP12, "op13_conversation_trie": OP13}
