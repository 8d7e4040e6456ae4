"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from harrow.llm.secret_scan import RULES, Rule


def crc32(text: str) -> str:
    """CRC-32 of an ASCII text: the byte is mixed in, then eight single-bit steps."""
    step = "CASE WHEN e >= 0 THEN xor(c, e) ELSE xor(c >> 1, (c & 1) * 3988292384) END"
    bits = f"flatten(list_transform(string_split({text}, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}), lambda c, e: {step}), 4294967295)"


def sha256_of_list(items: str, order: str) -> str:
    return f"sha256(coalesce(string_agg({items}, ',' ORDER BY {order}), ''))"


# Languages by out-of-place distance: n-grams of 1 to 3 characters around blanked words.
_GRAMS = """
letters AS (
  SELECT doc_id, string_split(' ' || trim(regexp_replace(lower(text), '[^\\p{L}]+', ' ', 'g')) || ' ', '') AS l
  FROM documents WHERE regexp_matches(text, '\\p{L}')),
chars AS (
  SELECT doc_id, c, lead(c, 1) OVER w AS c1, lead(c, 2) OVER w AS c2
  FROM (SELECT doc_id, unnest(l) AS c, generate_subscripts(l, 1) AS pos FROM letters) WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
grams AS (
  SELECT doc_id, g, count(*) AS n FROM (
    SELECT doc_id, c AS g FROM chars WHERE c <> ' '
    UNION ALL SELECT doc_id, c || c1 FROM chars WHERE c1 IS NOT NULL
    UNION ALL SELECT doc_id, c || c1 || c2 FROM chars WHERE c2 IS NOT NULL AND c1 <> ' ') GROUP BY doc_id, g)"""
OP1 = f"""
WITH crc AS (SELECT doc_id, text, lang, {crc32("doc_id::VARCHAR")} % 3 AS r FROM documents),{_GRAMS},
profiles AS (
  SELECT lang, g, rn - 1 AS rank FROM (
    SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, g) AS rn
    FROM grams JOIN crc USING (doc_id) WHERE r <> 1 AND lang IS NOT NULL GROUP BY lang, g) WHERE rn <= 300),
own AS (
  SELECT doc_id, g, rn - 1 AS rank FROM (
    SELECT doc_id, g, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, g) AS rn FROM grams) WHERE rn <= 300),
distances AS (
  SELECT doc_id, l.lang, count(*) AS n_grams, sum(least(300, coalesce(abs(own.rank - p.rank), 300)))::BIGINT AS distance
  FROM own CROSS JOIN (SELECT DISTINCT lang FROM profiles) l LEFT JOIN profiles p ON p.lang = l.lang AND p.g = own.g
  GROUP BY doc_id, l.lang),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY distance, lang) AS rn FROM distances)
SELECT crc.doc_id, r = 1 AS held_out, coalesce(b.lang, 'und') AS lang_pred,
       coalesce(1.0::DOUBLE - b.distance::DOUBLE / (300 * b.n_grams)::DOUBLE, 0) AS score,
       coalesce(b.distance, 0) AS distance, coalesce(b.n_grams, 0) AS n_grams
FROM crc LEFT JOIN (SELECT * FROM best WHERE rn = 1) b USING (doc_id)"""

# Documents that share at least three quarters of their 5-word shingles, and their components.
OP2 = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS l
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(l[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, l, unnest(range(1, greatest(2, len(l) - 3))) AS i FROM w WHERE len(l) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT d.doc_id, coalesce(sizes.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.b, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT a, min(b) AS b FROM reach GROUP BY a) m ON m.a = d.doc_id"""


def _escaped(text: str) -> str:
    doubled = f"replace({text}, '\\', '\\\\')"
    first = f"regexp_replace({doubled}, '<(/?s>)', '<\\\\\\1', 'g')"
    return f"regexp_replace({first}, '\\[(/?(?:INST|ROLE)\\])', '[\\\\\\1', 'g')"


_MARK = f"CASE role WHEN 'user' THEN '[INST]' WHEN 'assistant' THEN '[/INST]' ELSE '[ROLE]' || {_escaped('role')} || '[/ROLE]' END"
OP3 = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
       sum(7 + length({_MARK}) + length({_escaped("text")}))::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id"""


def _kind(place: int, rule: Rule) -> str:
    """Spans of one rule, from the lengths of matches and of what lies between them."""
    pattern = rule.pattern.replace("'", "''")
    group = f"regexp_extract_all(text, '{pattern}', {rule.group})"
    lengths = "list_transform({}, lambda x: length(x))".format
    return f"""
  SELECT doc_id, {place} AS place, '{rule.kind}' AS kind, start, start + m AS stop FROM (
    SELECT doc_id, m, g, sum(b + m) OVER (PARTITION BY doc_id ORDER BY i) - m AS start FROM (
      SELECT doc_id, unnest({lengths(f"regexp_extract_all(text, '{pattern}')")}) AS m, unnest({lengths(group)}) AS g,
             unnest({lengths(f"string_split_regex(text, '{pattern}')")}[:-2]) AS b,
             unnest(range(len(regexp_extract_all(text, '{pattern}')))) AS i
      FROM texts WHERE regexp_matches(text, '{pattern}'))) WHERE g >= {rule.least}"""


_SPAN = "kind || ':' || start::BIGINT || ':' || stop::BIGINT"
OP5 = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
spans AS ({" UNION ALL ".join(_kind(i, r) for i, r in enumerate(RULES))}),
lists AS (
  SELECT doc_id, count(*) FILTER (place = 0) AS n_assign, count(*) FILTER (place = 1) AS n_access, count(*) FILTER (place = 2) AS n_hex,
         string_agg({_SPAN}, ',' ORDER BY start, place) FILTER (place < 3) AS base, string_agg({_SPAN}, ',' ORDER BY start, place) AS spans
  FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN lists USING (doc_id)"""

OP7 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS ints FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_sum(list_transform(range(1, len(q.ints) + 1), lambda i: q.ints[i] * d.ints[i]))::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 10"""


def _words(text: str) -> str:
    low = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"regexp_extract_all({low}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


OP8 = f"""
WITH d AS (SELECT doc_id, {_words("coalesce(text, '')")} AS l FROM documents),
b AS (SELECT item_id, {_words("text")} AS l FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(13, len(l)) AS m, array_to_string(l[i:i + 12], ' ') AS g
  FROM (SELECT item_id, l, unnest(range(1, greatest(2, len(l) - 11))) AS i FROM b WHERE len(l) > 0)),
places AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM d),
hits AS (
  SELECT DISTINCT p.doc_id, p.i, w.m, w.item_id
  FROM (SELECT doc_id, i, m, array_to_string(l[i:i + m - 1], ' ') AS g FROM places CROSS JOIN (SELECT DISTINCT m FROM windows) WHERE i + m - 1 <= len(l)) p
  JOIN windows w ON w.m = p.m AND w.g = p.g),
marked AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT doc_id, i, unnest(range(m)) AS k FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(l)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(l) AS contaminated
FROM d LEFT JOIN marked USING (doc_id) LEFT JOIN items USING (doc_id)"""

# Cut into units, and put together in the order of the form.
OP11 = """
WITH t AS (
  SELECT doc_id, text, l, len(l)::BIGINT AS n, sha256('1:' || doc_id::VARCHAR) AS h
  FROM (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS l FROM documents)),
h AS (
  SELECT *, ('0x' || h[1:8])::BIGINT % (n + 1) AS x, ('0x' || h[9:16])::BIGINT % (n + 1) AS y,
         ('0x' || h[17:24])::BIGINT % 100 AS h3, ('0x' || h[25:32])::BIGINT % 100 AS h4 FROM t),
p AS (
  SELECT doc_id, text, n, array_to_string(l[:least(x, y)], '') AS prefix, array_to_string(l[least(x, y) + 1:greatest(x, y)], '') AS middle,
         array_to_string(l[greatest(x, y) + 1:], '') AS suffix,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 >= 90 THEN 'plain'
              WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
FROM p"""

# Phrases of two and three words with their lowest-scoring cut.
OP13 = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS piece, p
  FROM (SELECT lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
        FROM documents)),
w AS (
  SELECT lang, piece, unnest(l) AS w, generate_subscripts(l, 1) AS pos
  FROM (SELECT lang, piece, regexp_extract_all(p, '[^\x20\x09]+') AS l FROM pieces) WHERE len(l) > 0),
r AS (SELECT lang, w AS w1, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY piece ORDER BY pos)),
f1 AS (SELECT lang, w1, count(*) AS f FROM r GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS f FROM r WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM r WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang),
cuts AS (
  SELECT p.lang, p.w1 || ' ' || p.w2 AS phrase, p.f AS a, x.f AS l, y.f AS r, 1 AS k
  FROM f2 p JOIN f1 x ON x.lang = p.lang AND x.w1 = p.w1 JOIN f1 y ON y.lang = p.lang AND y.w1 = p.w2
  WHERE NOT EXISTS (FROM f3 t WHERE t.lang = p.lang AND 100 * t.f >= 50 * p.f AND (t.w1 = p.w1 AND t.w2 = p.w2 OR t.w2 = p.w1 AND t.w3 = p.w2))
  UNION ALL
  SELECT p.lang, p.w1 || ' ' || p.w2 || ' ' || p.w3, p.f, x.f, y.f, 1
  FROM f3 p JOIN f1 x ON x.lang = p.lang AND x.w1 = p.w1 JOIN f2 y ON y.lang = p.lang AND y.w1 = p.w2 AND y.w2 = p.w3
  UNION ALL
  SELECT p.lang, p.w1 || ' ' || p.w2 || ' ' || p.w3, p.f, x.f, y.f, 2
  FROM f3 p JOIN f2 x ON x.lang = p.lang AND x.w1 = p.w1 AND x.w2 = p.w2 JOIN f1 y ON y.lang = p.lang AND y.w1 = p.w3),
scored AS (SELECT *, ((1000000 * a::HUGEINT * a) // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000"""

SQL = {
    "op1_language_id": OP1, "op2_jaccard_join": OP2, "op3_chat_tree": OP3, "op5_secret_scan": OP5, "op7_cover_tree_top_k": OP7,
    "op8_decontamination": OP8, "op11_fill_in_middle": OP11, "op13_phrase_mining": OP13,
}
