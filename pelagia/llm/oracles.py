"""DuckDB SQL of the queries that SQL can express on whole tables."""

from __future__ import annotations

#: Sets of distinct 5-word shingles, exact Jaccard links, components by recursion.
OP8 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' '))) END AS sh FROM w
), e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
rare AS (SELECT doc_id, n, g, row_number() OVER (PARTITION BY doc_id ORDER BY f, g) AS k
  FROM (SELECT doc_id, n, g, count(*) OVER (PARTITION BY g) AS f FROM e)),
pre AS (SELECT doc_id, n, g FROM rare WHERE k <= n - CAST(ceil(0.75 * n) AS BIGINT) + 1),
cand AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM pre a JOIN pre b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)),
common AS (SELECT c.x, c.y, count(*) AS m, any_value(a.n) AS nx, any_value(b.n) AS ny
  FROM cand c JOIN e a ON a.doc_id = c.x JOIN e b ON b.doc_id = c.y AND b.g = a.g GROUP BY c.x, c.y),
links AS (SELECT x, y FROM common WHERE 100 * m >= 75 * (nx + ny - m)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x),
comp AS (SELECT x AS doc_id, min(least(x, y)) AS c FROM reach GROUP BY x)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, coalesce(c.c, s.doc_id) AS component_id, s.doc_id = coalesce(c.c, s.doc_id) AS kept
FROM s LEFT JOIN comp c ON c.doc_id = s.doc_id
"""

#: Turns, loss text and marked-up length of every conversation; each control string and backslash costs one character more.
OP3 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (SELECT *, coalesce(lag(role) OVER w, '') AS prev, lead(role) OVER w IS NULL AS final,
    length(t) + len(regexp_extract_all(t, '<</?SYS>>|</?s>|\[/?INST\]|\[/?OUT\]|\[/?ROLE\]|\[TEXT\]|\\')) AS body,
    length(role) + len(regexp_extract_all(role, '<</?SYS>>|</?s>|\[/?INST\]|\[/?OUT\]|\[/?ROLE\]|\[TEXT\]|\\')) AS named
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
v AS (SELECT *, CASE role WHEN 'system' THEN prev = '' WHEN 'user' THEN prev IN ('', 'system', 'assistant') WHEN 'assistant' THEN prev = 'user' ELSE false END AND (NOT final OR role = 'assistant') AS ok,
    CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 11 ELSE 19 + named END AS marks FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn)) AS turns_sha256, CAST(coalesce(sum(length(t)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(7 + sum(body + marks) AS BIGINT) AS formatted_chars, bool_and(ok) AS valid
FROM v GROUP BY conv_id
"""

#: Every 50-byte string of every text, two hexadecimal digits a byte; those that start in a smaller doc_id too; their union cut out.
OP9 = r"""
WITH p AS (SELECT doc_id, h, CAST(length(h) // 2 AS BIGINT) AS n FROM (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents)),
s AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS g FROM (SELECT doc_id, h, unnest(range(0, greatest(0, n - 49))) AS i FROM p)),
f AS (SELECT g, min(doc_id) AS first FROM s GROUP BY g HAVING min(doc_id) < max(doc_id)),
m AS (SELECT doc_id, i, lag(i) OVER w AS before, lead(i) OVER w AS after FROM s JOIN f USING (g) WHERE doc_id > first WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
a AS (SELECT doc_id, i AS b, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM m WHERE before IS NULL OR i > before + 50),
z AS (SELECT doc_id, i + 50 AS e, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM m WHERE after IS NULL OR after > i + 50),
r AS (SELECT doc_id, k, b, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY k), 0) AS prior FROM a JOIN z USING (doc_id, k)),
x AS (SELECT doc_id, count(*) AS spans, CAST(sum(e - b) AS BIGINT) AS gone, max(e) AS last, string_agg(substr(h, 2 * prior + 1, 2 * (b - prior)), '' ORDER BY k) AS kept FROM r JOIN p USING (doc_id) GROUP BY doc_id)
SELECT p.doc_id, n AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM p LEFT JOIN x ON x.doc_id = p.doc_id
"""

#: Every line's key; those of at least 10 characters in several documents stay in the first only.
OP11 = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i, ls[i] AS line, translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
f AS (SELECT k, min(doc_id) AS first FROM l WHERE length(k) >= 10 GROUP BY k),
j AS (SELECT l.doc_id, i, line, coalesce(l.doc_id > first, false) AS gone FROM l LEFT JOIN f ON f.k = l.k)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(gone AS INTEGER)) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id
"""

#: Every document's score for every item, in integers.
OP12 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
size AS (SELECT count(*) FILTER (len(ws) > 0) AS docs, CAST(sum(len(ws)) AS BIGINT) AS words FROM d),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n, unnest(ws) AS term FROM d) GROUP BY doc_id, n, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p CROSS JOIN size GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // words)))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN p USING (term) CROSS JOIN size GROUP BY item_id, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""


def _repair_sql() -> str:
    """Faults by crc32 bit by bit; then a row of the programme for each turn and state.

    A state is a string of its cost in six digits, its audit, chr(1) and its lines, so
    that the least string has the least cost and, of equal costs, the least audit.
    """

    def ext(state: str, cost: str, letters: str, lines: str) -> str:
        return f"lpad(CAST(CAST(substr({state}, 1, 6) AS BIGINT) + {cost} AS VARCHAR), 6, '0') || substr({state}, 7, strpos({state}, chr(1)) - 7) || '{letters}' || chr(1) || substr({state}, strpos({state}, chr(1)) + 1) || {lines}"

    line = {"u": "chr(10) || 'user:'", "a": "chr(10) || 'assistant:'"}
    before = {"s": {"z": ""}, "u": {"z": "", "s": "", "a": "", "u": "a"}, "a": {"u": "", "z": "u", "s": "u", "a": "u"}}
    steps = [ext("z", "3", "D", "''") + " AS z"]
    for state, ways in before.items():
        options = [ext(state, "3", "D", "''")]
        for prior, added in ways.items():
            new, cost = "".join(line[x] + " || " for x in added), f"{2 * len(added)} + t"
            options.append(f"CASE WHEN NOT gone AND substr(role, 1, 1) = '{state}' THEN {ext(prior, cost, 'I' * len(added) + 'K', new + 'chr(10) || role || chr(58) || text')} ELSE '999999' || chr(1) END")
            if state != "s":
                options.append(f"CASE WHEN NOT gone THEN {ext(prior, cost + ' + 2', 'I' * len(added) + 'R', new + line[state] + ' || text')} ELSE '999999' || chr(1) END")
        steps.append(f"least({', '.join(options)}) AS {state}")
    ends = ", ".join(["z", "a", ext("u", "2", "I", line["a"]), ext("s", "4", "II", line["u"] + " || " + line["a"])])
    never = "'900000' || chr(1)"
    return rf"""
WITH RECURSIVE k AS (SELECT DISTINCT coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
bits AS (SELECT key, CAST(0 AS BIGINT) AS j, CAST(4294967295 AS BIGINT) AS c FROM k
  UNION ALL SELECT key, j + 1, xor(x // 2, 3988292384 * (x % 2)) FROM (SELECT key, j, CASE WHEN j % 8 = 0 THEN xor(c, CAST(ascii(substr(key, CAST(j // 8 + 1 AS BIGINT), 1)) AS BIGINT)) ELSE c END AS x FROM bits WHERE j < 8 * length(key))),
crc AS (SELECT key, xor(c, CAST(4294967295 AS BIGINT)) % 20 AS fault FROM bits WHERE j = 8 * length(key)),
f AS (SELECT conv_id, turn, fault, CASE WHEN fault = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text
  FROM conversations JOIN crc ON key = coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') WHERE fault <> 0),
c AS (SELECT conv_id, turn, role, text, 0 AS copy FROM f UNION ALL SELECT conv_id, turn, role, text, 1 FROM f WHERE fault = 3),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i FROM c),
m AS (SELECT *, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS bare, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS prior FROM o),
g AS (SELECT conv_id, turn, i, role, text, bare = '' AS blank, again AND bare <> '' AS dup, bare = '' OR again AS gone, CASE WHEN bare <> '' AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS t,
    CASE WHEN prior IS NOT NULL AND substr(prior, 1, 1) || substr(role, 1, 1) NOT IN ('su', 'ua', 'au') THEN 1 ELSE 0 END AS wrong FROM m),
a AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, CAST(sum(t) AS BIGINT) AS truncated, CAST(sum(wrong) AS BIGINT) AS illegal, count(*) AS n FROM g GROUP BY conv_id),
st AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, '000000' || chr(1) AS z, {never} AS s, {never} AS u, {never} AS a FROM a
  UNION ALL SELECT conv_id, i, {', '.join(steps)} FROM (SELECT g.conv_id, g.i, g.role, g.text, g.gone, g.t, st.z, st.s, st.u, st.a FROM st JOIN g ON g.conv_id = st.conv_id AND g.i = st.i + 1)),
e AS (SELECT a.conv_id, gaps, blank, duplicate, truncated, illegal, least({ends}) AS x FROM a JOIN st ON st.conv_id = a.conv_id AND st.i = a.n),
every AS (SELECT DISTINCT conv_id FROM conversations)
SELECT every.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(CAST(substr(x, 1, 6) AS BIGINT), 0) AS cost, coalesce(substr(x, 7, strpos(x, chr(1)) - 7), '') AS audit, sha256(coalesce(substr(x, strpos(x, chr(1)) + 2), '')) AS repaired_sha256
FROM every LEFT JOIN e ON e.conv_id = every.conv_id
"""


#: The cheapest edits of every damaged conversation, state by state.
OP13 = _repair_sql()

SQL = {"op3_chat_format": OP3, "op8_minhash_dedup": OP8, "op9_suffix_dedup": OP9, "op11_line_dedup": OP11, "op12_ranked_search": OP12, "op13_chat_repair": OP13}
