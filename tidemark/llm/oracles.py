"""The same results in DuckDB SQL, where SQL can say them."""

ORACLES: dict[str, str] = {}

ORACLES["op1_chat_formatting"] = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped AS (
  SELECT *, length(regexp_replace(role, '\\', '\\\\', 'g')) + length(regexp_replace(text, '\\', '\\\\', 'g')) AS chars,
    len(regexp_extract_all(role, '</?s>|\[/?INST\]')) + len(regexp_extract_all(text, '</?s>|\[/?INST\]')) AS controls
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars + controls + length('<s>[INST][/INST]</s>')) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id"""

ORACLES["op10_exact_dedup"] = r"""
WITH digests AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[ \t-\r]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
  count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256
FROM digests"""

# CRC-32 of a text, byte by byte through the table of its 256 remainders (3988292384 is the fixed polynomial).
CRC_TABLE = r"""
crc_steps AS (
  SELECT i, i AS c, 0 AS step FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1 FROM crc_steps WHERE step < 8),
crc_table AS (SELECT list(c ORDER BY i) AS r FROM crc_steps WHERE step = 8)"""


def crc32(text: str) -> str:
    """SQL for the unsigned CRC-32 of ``text``, beside ``crc_table``."""
    hexes = f"hex(encode({text}))"
    codes = (
        f"list_transform(range(0, length({hexes}) // 2), "
        f"lambda i: CAST(('0x' || substr({hexes}, CAST(2 * i + 1 AS BIGINT), 2)) AS BIGINT))"
    )
    step = "lambda c, b: xor(r[(xor(c, b) & 255) + 1], c >> 8)"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), {step}), 4294967295)"


ORACLES["op11_merkle_manifest"] = rf"""
WITH RECURSIVE {CRC_TABLE},
docs AS (
  SELECT doc_id, lang, source, n_chars, text, doc_id IS NOT NULL AND {crc32("coalesce(CAST(doc_id AS VARCHAR), '')")} % 3 = 0 AS chosen
  FROM documents, crc_table),
written AS (
  SELECT doc_id, lang, chosen,
    CASE WHEN doc_id IS NULL THEN '-' ELSE octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id END
      || CASE WHEN source IS NULL THEN '-' ELSE octet_length(encode(source)) || ':' || source END
      || CASE WHEN lang IS NULL THEN '-' ELSE octet_length(encode(lang)) || ':' || lang END
      || CASE WHEN n_chars IS NULL THEN '-' ELSE octet_length(encode(CAST(n_chars AS VARCHAR))) || ':' || n_chars END AS head,
    CASE WHEN text IS NULL THEN '-' ELSE octet_length(encode(text)) || ':' || text END AS body,
    CASE WHEN text IS NULL THEN '-' ELSE octet_length(encode(text)) || ':'
      || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS lowered
  FROM docs),
leaves AS (
  SELECT doc_id, sha256(head || body) AS leaf, CASE WHEN chosen THEN sha256(head || lowered) ELSE sha256(head || body) END AS claimed,
    dense_rank() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS tree,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, sha256(head || body)) - 1 AS place,
    count(*) OVER (PARTITION BY lang) AS width
  FROM written),
nodes AS (
  SELECT tree, 0 AS level, place, leaf AS digest, width FROM leaves
  UNION ALL
  SELECT tree, level + 1, place // 8, sha256(string_agg(digest, '' ORDER BY place)), (width + 7) // 8
  FROM nodes WHERE width > 1 GROUP BY tree, level, place // 8, width),
tops AS (
  SELECT 0 AS level, tree AS place, digest, (SELECT count(DISTINCT tree) FROM leaves) AS width FROM nodes WHERE width = 1
  UNION ALL
  SELECT level + 1, place // 8, sha256(string_agg(digest, '' ORDER BY place)), (width + 7) // 8
  FROM tops WHERE width > 1 GROUP BY level, place // 8, width),
every AS (
  SELECT false AS above, tree, level, place, digest FROM nodes
  UNION ALL SELECT true, 0, level, place, digest FROM tops),
path AS (
  SELECT row_number() OVER () AS row, tree, place, 0 AS level, width, claimed AS digest, false AS above,
    CAST('' AS VARCHAR) AS siblings, leaf, doc_id FROM leaves
  UNION ALL
  SELECT p.row, p.tree,
    CASE WHEN p.width > 1 THEN p.place // 8 ELSE p.tree END,
    CASE WHEN p.width > 1 THEN p.level + 1 ELSE 0 END,
    CASE WHEN p.width > 1 THEN (p.width + 7) // 8 ELSE (SELECT max(width) FROM tops) END,
    CASE WHEN p.width > 1 THEN sha256(string_agg(CASE WHEN n.place = p.place THEN p.digest ELSE n.digest END, '' ORDER BY n.place))
      ELSE p.digest END,
    p.above OR p.width = 1,
    p.siblings || CASE WHEN p.width > 1 THEN coalesce(string_agg(n.digest, '' ORDER BY n.place) FILTER (n.place <> p.place), '') ELSE '' END,
    p.leaf, p.doc_id
  FROM path p JOIN every n
    ON n.above = p.above AND n.tree = CASE WHEN p.above THEN 0 ELSE p.tree END AND n.level = p.level AND n.place // 8 = p.place // 8
  WHERE p.width > 1 OR NOT p.above
  GROUP BY p.row, p.tree, p.place, p.level, p.width, p.digest, p.above, p.siblings, p.leaf, p.doc_id),
ended AS (SELECT * FROM path WHERE above AND width = 1)
SELECT e.doc_id, e.leaf, s.digest AS subroot, t.digest AS root, sha256(e.siblings) AS proof_sha256, e.digest AS folded_root,
  e.digest = t.digest AS verified
FROM ended e JOIN nodes s ON s.tree = e.tree AND s.width = 1 CROSS JOIN (SELECT digest FROM tops WHERE width = 1) t"""

ORACLES["op12_warc"] = r"""
WITH found AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
grouped AS (
  SELECT *, first_value(page_id) OVER same AS first_id, row_number() OVER same = 1 OR payload_bytes < 100 AS own
  FROM found WINDOW same AS (PARTITION BY payload_digest ORDER BY page_id NULLS FIRST))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN own THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN NOT own THEN first_id END AS refers_to
FROM grouped"""

ORACLES["op13_spelling_variants"] = rf"""
WITH RECURSIVE {CRC_TABLE},
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
per_run AS (
  SELECT doc_id, run, count(*) AS times FROM runs WHERE length(run) >= 6 GROUP BY doc_id, run),
hashed AS (
  SELECT run, times, {crc32("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h FROM per_run, crc_table),
words AS (
  SELECT word, CAST(sum(times) AS BIGINT) AS n FROM (
    SELECT times, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
    FROM hashed) WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
cut AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT DISTINCT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
    AND length(a.word) = length(b.word)
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.rest = w.word),
best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS form_n, arg_min(other, (-other_n, encode(other))) AS form FROM near GROUP BY word),
judged AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * n THEN form END AS form,
    CASE WHEN form_n >= 5 * n THEN form_n END AS form_n
  FROM words LEFT JOIN best USING (word)),
follow AS (
  SELECT word, word AS root FROM judged
  UNION ALL SELECT f.word, j.form FROM follow f JOIN judged j ON j.word = f.root WHERE j.form IS NOT NULL)
SELECT j.word, j.form, f.root, j.n, j.n_near, j.form_n
FROM judged j JOIN follow f USING (word) JOIN judged k ON k.word = f.root AND k.form IS NULL"""
