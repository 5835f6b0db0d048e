"""SQL for the queries that SQL can express on whole tables; the others are tested against brute force in tests/llm."""

from __future__ import annotations

from .mixing import MOST_REPEATS, SCHEDULES, WEIGHTS

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NEAR_DUPLICATES = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM w),
n AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n FROM s), x AS (SELECT doc_id, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 85 * (na.n + nb.n - shared)),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(node, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.node),
c AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT n.doc_id, n.n AS n_shingles, c.root AS component_id, n.doc_id = c.root AS kept FROM n JOIN c ON c.node = n.doc_id"""

TOP_K = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.v, v.v) AS BIGINT) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0 AND len(q.v) = len(v.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10"""


def _time(share: str, nth: str) -> str:
    """The time at which a share of demand is met, by the schedules, as SQL."""
    cases = []
    for which, knots in enumerate(SCHEDULES):
        width = 1.0 / (len(knots) - 1)
        areas = [width * (a + b) / 2 for a, b in zip(knots, knots[1:])]
        total, done, parts = sum(areas), 0.0, []
        for k, area in enumerate(areas):
            a, slope = knots[k], (knots[k + 1] - knots[k]) / width
            rest = f"greatest({share} * {total!r} - {done!r}, 0.0)"
            inside = f"{rest} / {a!r}" if slope == 0 else f"(sqrt({a * a!r} + {2 * slope!r} * {rest}) - {a!r}) / {slope!r}"
            done += area
            last = k == len(areas) - 1
            parts.append(("ELSE " if last else f"WHEN {share} * {total!r} < {done!r} THEN ") + f"{k * width!r} + least({inside}, {width!r})")
        cases.append(f"WHEN {nth} % {len(SCHEDULES)} = {which} THEN CASE {' '.join(parts)} END")
    return f"CASE {' '.join(cases)} END"


_WEIGHT = "CASE " + " ".join(f"WHEN nth % {len(WEIGHTS)} = {k} THEN CAST({w} AS DOUBLE)" for k, w in enumerate(WEIGHTS)) + " END"

MIXING = f"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(COALESCE(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, left(md5(COALESCE(CAST(doc_id AS VARCHAR), '~' || COALESCE(text, ''))), 15) AS place FROM documents),
a AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source), b AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS nth FROM a),
c AS (SELECT *, {_WEIGHT} AS weight, source_size * {MOST_REPEATS} AS cap, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM b),
e AS (SELECT *, COALESCE(CAST(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE), 0.0) AS capped, sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight FROM c WINDOW w AS (ORDER BY cap / weight, nth)),
f AS (SELECT *, CASE WHEN weight * ((total - capped) / open_weight) < cap THEN (total - capped) / open_weight END AS own FROM e),
g AS (SELECT *, first_value(own IGNORE NULLS) OVER (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS level FROM f),
t AS (SELECT source, source_size, nth, CASE WHEN level IS NULL THEN CAST(cap AS DOUBLE) ELSE least(CAST(cap AS DOUBLE), weight * level) END AS target FROM g),
o AS (SELECT d.doc_id, d.source, size, source_size, nth, target, CAST(COALESCE(sum(size) OVER (PARTITION BY nth ORDER BY place, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS earlier, CAST(floor(target + 1e-6) AS BIGINT) AS goal FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
r AS (SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS rounds FROM o), k AS (SELECT *, greatest(0, least(size, goal - rounds * source_size - earlier)) AS part FROM r),
m AS (SELECT *, CASE WHEN size = 0 THEN 0 ELSE rounds + CAST(part > 0 AS BIGINT) END AS copies, earlier / target AS share FROM k), l AS (SELECT *, ((copies - 1) * source_size + earlier) / target AS last_share FROM m)
SELECT doc_id, source, size, source_size, target, CAST(rounds * size + part AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies, CASE WHEN copies > 0 THEN round({_time("share", "nth")}, 9) END AS first_position, CASE WHEN copies > 0 THEN round({_time("last_share", "nth")}, 9) END AS last_position FROM l"""

_CODED = "replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')"

CHAT = f"""WITH rows AS (SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
c AS (SELECT conv_id, count(*) AS n, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns, COALESCE(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS learnt,
sum(length('<|turn|>') + length(replace({_CODED.format(x="role")}, chr(10), '&#10;')) + 1 + length({_CODED.format(x="text")}) + length('<|end|>') + 1) AS chars FROM rows GROUP BY conv_id)
SELECT conv_id, CAST(n AS BIGINT) AS n_turns, sha256(turns) AS turns_sha256, CAST(length(learnt) AS BIGINT) AS loss_chars, sha256(learnt) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM c"""

_TERMS = "regexp_extract_all(translate(COALESCE(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')".format(upper=_UPPER, lower=_LOWER)

DECONTAMINATION = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents), i AS (SELECT item_id, {_TERMS} AS w FROM benchmark),
x AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda k: array_to_string(w[k:k + 9], ' '))) AS t FROM i WHERE len(w) > 0),
n AS (SELECT DISTINCT len(string_split(t, ' ')) AS n FROM x), p AS (SELECT r, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS k FROM d, n),
m AS (SELECT r, k, n, item_id FROM p JOIN x ON array_to_string(w[k:k + n - 1], ' ') = t), h AS (SELECT r, count(DISTINCT spot) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS spot FROM m) GROUP BY r),
o AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY encode(item)) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM m WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(COALESCE(n_hit, 0) AS BIGINT) AS n_hit, CAST(COALESCE(n_items, 0) AS BIGINT) AS n_items, sha256(COALESCE(ids, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (r) LEFT JOIN o USING (r)"""

# CRC-32 of a word: its bytes from hex digits, through a table of 256 numbers that eight steps make
_STEP = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
RESAMPLING = f"""WITH RECURSIVE made(b, k, c) AS (SELECT b, 0, CAST(b AS BIGINT) FROM range(256) t(b) UNION ALL SELECT b, k + 1, {_STEP} FROM made WHERE k < 8), crc AS (SELECT list(c ORDER BY b) AS steps FROM made WHERE k = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents), words AS (SELECT r, unnest(w) AS word FROM d), aims AS (SELECT unnest({_TERMS}) AS word FROM benchmark),
hashed AS (SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, CAST(length(hex(encode(word))) // 2 + 1 AS BIGINT)), lambda i: CAST('0x' || substr(hex(encode(word)), 2 * i - 1, 2) AS BIGINT))), lambda a, x: xor(a // 256, steps[xor(a, x) % 256 + 1])), 4294967295) % 10000 AS bucket FROM (SELECT DISTINCT word FROM (SELECT word FROM words UNION ALL SELECT word FROM aims)), crc),
s AS (SELECT bucket, count(*) AS s FROM words JOIN hashed USING (word) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM aims JOIN hashed USING (word) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((COALESCE(t, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM words) + 10000.0::DOUBLE) / ((COALESCE(s, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM aims) + 10000.0::DOUBLE)))) AS BIGINT) AS gain FROM s FULL JOIN t USING (bucket)),
v AS (SELECT r, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM words JOIN hashed USING (word) JOIN g USING (bucket) GROUP BY r),
e AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n_features, COALESCE(weight, 0) AS weight, COALESCE(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || left(sha256('2024:' || COALESCE(CAST(doc_id AS VARCHAR), '')), 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN v USING (r)),
k AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, r) AS place, count(*) FILTER (n_features >= 20) OVER () AS n FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM k"""

ORACLES = {"op1_minhash_near_dedup": NEAR_DUPLICATES, "op2_exact_top_k": TOP_K, "op3_source_mixing": MIXING, "op7_chat_formatting": CHAT, "op11_benchmark_decontamination": DECONTAMINATION, "op13_importance_resampling": RESAMPLING}
