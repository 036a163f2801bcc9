"""SQL of the contracts of operators 11 to 13."""

from __future__ import annotations


def crc32(text: str) -> str:
    """The unsigned crc32 of an ASCII text expression, bit by bit."""
    step = "CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END"
    byte = f"list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, z: {step})"
    codes = f"list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, b: {byte}), 4294967295)"


WORD = r"[^\x20\x09-\x0D]+"

RULES_SQL = rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT r, unnest(x) AS w, generate_subscripts(x, 1) AS i FROM (SELECT r, regexp_extract_all(text, '{WORD}') AS x FROM d)
), g AS (
  SELECT r, i, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY r ORDER BY i)
), t AS (
  SELECT r, i, w, CAST(w3 IS NOT NULL AND count(*) OVER (PARTITION BY r, w, w2, w3) > 1 AS INTEGER) AS twice FROM g
), c AS (
  SELECT r, w, max(twice) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS covered FROM t
), words AS (
  SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars, sum(covered) AS n_repeat_words FROM c GROUP BY r
), l AS MATERIALIZED (
  SELECT r, source, copy, line, len(regexp_extract_all(line, '{WORD}')) AS n,
    trim(regexp_replace(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm
  FROM (SELECT r, source, md5(text) AS copy, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), lines AS (
  SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY r
), hosts AS (
  SELECT source, count(DISTINCT text) AS host_docs FROM d GROUP BY source
), over_limit AS (
  SELECT x.source, x.norm
  FROM (SELECT source, norm, count(DISTINCT copy) AS n_docs FROM l GROUP BY source, norm) x
  JOIN hosts h ON h.source IS NOT DISTINCT FROM x.source
  WHERE x.n_docs > 10 AND x.n_docs * 100 > h.host_docs
), gone AS (
  SELECT l.r, sum(l.n) AS n_removed_words FROM l JOIN over_limit o ON o.source IS NOT DISTINCT FROM l.source AND o.norm = l.norm GROUP BY l.r
), a AS (
  SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(n_removed_words, 0) AS BIGINT) AS n_removed_words
  FROM d LEFT JOIN words USING (r) LEFT JOIN lines USING (r) LEFT JOIN gone USING (r)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * (n_words - n_removed_words) >= 50 * n_words AS kept
FROM a
"""

TRIE_SQL = f"""
WITH t AS MATERIALIZED (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS pos,
    {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS said, length(coalesce(text, '')) AS chars
  FROM conversations WHERE conv_id IS NOT NULL
), own AS MATERIALIZED (
  SELECT c, list(said ORDER BY pos) AS said, {crc32("CAST(c AS VARCHAR)")} % 6 AS h FROM t GROUP BY c
), convs AS MATERIALIZED (
  SELECT o.c, list_concat(coalesce(b.said[1:o.h], []), o.said[o.h + 1:]) AS said FROM own o LEFT JOIN own b ON b.c = o.c - o.c % 100
), p AS MATERIALIZED (
  SELECT c, len(said) AS n, d, sha256(CAST(said[1:d] AS VARCHAR) || '|' || CAST(list_transform(said[1:d], lambda x: [length(x.role), length(x.text)]) AS VARCHAR)) AS key,
    CASE WHEN d = 0 THEN 0 ELSE length(said[d].text) END AS chars
  FROM (SELECT c, said, unnest(range(len(said) + 1)) AS d FROM convs)
), node AS MATERIALIZED (
  SELECT d, key, min(c) AS c, count(*) AS n, (count(*) - 1) * min(chars) AS saved,
    string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = d) AS ends
  FROM p GROUP BY d, key
), up AS MATERIALIZED (
  SELECT node.*, q.key AS above, q.d AS above_d FROM node JOIN p q ON q.c = node.c AND q.d <= node.d
), child AS (
  SELECT above AS key, above_d AS d, count(*) AS n_children FROM up WHERE above_d = d - 1 GROUP BY 1, 2
), fold AS (
  SELECT up.above AS key, up.above_d AS d, sum(up.saved) AS saved_tokens, count(*) FILTER (WHERE ch.key IS NULL) AS n_leaves
  FROM up LEFT JOIN child ch ON ch.key = up.key AND ch.d = up.d GROUP BY 1, 2
), parent AS (
  SELECT up.key, up.d, n.c AS parent FROM up JOIN node n ON n.key = up.above AND n.d = up.above_d WHERE up.above_d = up.d - 1
)
SELECT node.c AS conv_id, node.d AS depth, parent.parent AS parent_conv_id, node.n AS n_convs, coalesce(child.n_children, 0) AS n_children,
  fold.n_leaves, CAST(fold.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(node.ends, '')) AS ends_sha256
FROM node JOIN fold USING (key, d) LEFT JOIN child USING (key, d) LEFT JOIN parent USING (key, d)
"""

REPAIR_SQL = f"""
WITH RECURSIVE raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS fate
  FROM conversations
), ids AS MATERIALIZED (
  SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS c FROM (SELECT DISTINCT conv_id FROM conversations)
), rows_ AS MATERIALIZED (
  SELECT ids.c, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    row_number() OVER (PARTITION BY ids.c ORDER BY turn NULLS FIRST, raw.role, sha256(raw.text), copy) AS pos
  FROM raw JOIN ids ON ids.conv_id IS NOT DISTINCT FROM raw.conv_id, (VALUES (0), (1)) x(copy)
  WHERE fate <> 0 AND (copy = 0 OR fate = 3)
), f AS MATERIALIZED (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
    WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY pos) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
    role[1] AS initial, lag(role[1]) OVER (PARTITION BY c ORDER BY pos) AS before
  FROM rows_
), edit AS (
  -- how the roles end: 0 nothing, 1 system, 2 user, 3 assistant; k turns inserted, then the row's edit
  SELECT s, k, x, CASE WHEN k = 0 THEN s WHEN (s = 2) = (k % 2 = 1) THEN 3 ELSE 2 END AS mid
  FROM range(4) a(s), range(3) b(k), (VALUES ('D'), ('K'), ('R')) e(x)
), step AS MATERIALIZED (
  SELECT f.c, f.pos, edit.s, repeat('I', CAST(k AS INTEGER)) || x AS code,
    CASE WHEN x = 'D' THEN mid WHEN x = 'R' THEN CASE WHEN mid = 2 THEN 3 ELSE 2 END
      WHEN initial = 's' AND mid = 0 THEN 1 WHEN initial = 'u' AND mid <> 2 THEN 2 WHEN initial = 'a' AND mid = 2 THEN 3 END AS into_s,
    2 * k + CASE x WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN fault = 'truncated' AND x <> 'D' THEN 1 ELSE 0 END AS cost,
    CASE WHEN x = 'K' THEN f.role WHEN x = 'R' THEN CASE WHEN mid = 2 THEN 'assistant' ELSE 'user' END END AS new_role, f.text,
    list_transform(range(k), lambda i: CASE WHEN (s = 2) = (i % 2 = 0) THEN 'assistant:' ELSE 'user:' END) AS put
  FROM f, edit WHERE x = 'D' OR fault NOT IN ('blank', 'duplicate')
), best AS (
  SELECT c, CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS s, CAST(0 AS BIGINT) AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS said FROM ids
  UNION ALL
  SELECT c, pos, s, cost, audit, said FROM (
    SELECT b.c, step.pos, CAST(step.into_s AS BIGINT) AS s, CAST(b.cost + step.cost AS BIGINT) AS cost, b.audit || step.code AS audit,
      list_concat(b.said, step.put, CASE WHEN new_role IS NULL THEN [] ELSE [new_role || ':' || step.text] END) AS said,
      row_number() OVER (PARTITION BY b.c, step.into_s ORDER BY b.cost + step.cost, b.audit || step.code) AS place
    FROM best b JOIN step ON step.c = b.c AND step.pos = b.pos + 1 AND step.s = b.s
    WHERE step.into_s IS NOT NULL
  ) WHERE place = 1
), n AS (
  SELECT ids.c, count(f.c) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
    count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM ids LEFT JOIN f ON f.c = ids.c GROUP BY ids.c
), done AS (
  SELECT best.c, cost + CASE s WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 0 END AS cost, audit || CASE s WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END AS audit,
    list_concat(said, CASE s WHEN 1 THEN ['user:', 'assistant:'] WHEN 2 THEN ['assistant:'] ELSE [] END) AS said
  FROM best JOIN n ON n.c = best.c AND n.n = best.pos
)
SELECT conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, sha256(array_to_string(said, chr(10))) AS repaired_sha256
FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY cost, audit) AS place FROM done) JOIN n USING (c) JOIN ids USING (c)
WHERE place = 1
"""
