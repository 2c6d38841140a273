"""The results of the chat, phrase and prefix operators stated in SQL."""

_ESCAPED = r"replace(replace(replace(replace(replace(replace(X, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), " \
    r"'[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '[ROLE]', '[\ROLE]')"

CHAT_FORMAT = f"""WITH said AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
  counted AS (SELECT *, role = 'assistant' AS answer, length({_ESCAPED.replace("X", "text")})
    + CASE WHEN role = 'assistant' THEN 7 ELSE 19 + length({_ESCAPED.replace("X", "role")}) END AS chars FROM said)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, sha256(text))) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE answer), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, sha256(text)) FILTER (WHERE answer), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM counted GROUP BY conv_id"""

COLLOCATIONS = r"""WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents),
  words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
  starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
  grams AS (SELECT lang, w[i:i + k - 1] AS p, k FROM starts, (SELECT unnest([1, 2, 3]) AS k) WHERE i + k - 1 <= len(w)),
  f AS (SELECT lang, p, k, count(*) AS f FROM grams GROUP BY lang, p, k),
  total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
  cuts AS (SELECT c.lang, c.p, c.k, c.f AS a, unnest(range(1, c.k)) AS cut FROM f c WHERE c.k > 1 AND c.f >= 10),
  scores AS (SELECT c.lang, c.p, c.k, c.a, c.cut, l.f AS l, r.f AS r,
      CAST(1000000::HUGEINT * c.a * c.a // (l.f::HUGEINT * r.f) AS BIGINT) AS score
    FROM cuts c JOIN f l ON l.lang = c.lang AND l.p = c.p[1:c.cut] JOIN f r ON r.lang = c.lang AND r.p = c.p[c.cut + 1:]),
  lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1),
  around AS (SELECT lang, unnest([p[1:2], p[2:3]]) AS p, f FROM f WHERE k = 3 AND f >= 10),
  kept AS (SELECT * FROM lowest c WHERE NOT EXISTS (
    SELECT 1 FROM around x WHERE x.lang = c.lang AND x.p = c.p AND 100 * x.f >= 50 * c.a)),
  ranked AS (SELECT *, array_to_string(p, ' ') AS phrase, row_number() OVER (
    PARTITION BY lang ORDER BY score DESC, a DESC, encode(array_to_string(p, ' '))) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000"""

PREFIX_TRIE = r"""WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
  own AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role, text) AS t,
      CAST(conv_id AS VARCHAR) AS s FROM turns GROUP BY conv_id),
  crc AS (SELECT *, xor(4294967295::BIGINT, list_reduce(
      list_concat([4294967295::BIGINT], list_transform(range(1, len(s) + 1), lambda i: ascii(s[i])::BIGINT)),
      lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)),
        lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END))) % 6 AS h FROM own),
  rebuilt AS (SELECT c.conv_id, list_concat(coalesce(b.t, [])[1:c.h], c.t[c.h + 1:]) AS t
    FROM crc c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 100),
  steps AS (SELECT conv_id, len(t) AS n, unnest(range(len(t) + 1)) AS depth, t FROM rebuilt),
  nodes AS (SELECT depth, t[1:depth] AS p, min(conv_id) AS conv_id, count(*) AS n_convs,
      coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = depth), '') AS ends FROM steps GROUP BY ALL),
  kids AS (SELECT p[1:depth - 1] AS p, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
  known AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.p = n.p),
  up AS (SELECT unnest(range(depth + 1)) AS d, p, n_children,
      (n_convs - 1) * CASE WHEN depth = 0 THEN 0 ELSE length(p[depth]['text']) END AS saving FROM known),
  sums AS (SELECT p[1:d] AS p, count(*) FILTER (WHERE n_children = 0) AS n_leaves, CAST(sum(saving) AS BIGINT) AS saved_tokens
    FROM up GROUP BY 1)
SELECT n.conv_id, n.depth, o.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, sha256(n.ends) AS ends_sha256
FROM known n JOIN sums s ON s.p = n.p LEFT JOIN nodes o ON n.depth > 0 AND o.p = n.p[1:n.depth - 1]"""
