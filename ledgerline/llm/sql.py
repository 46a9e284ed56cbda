"""DuckDB SQL for the queries whose results SQL can express."""

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s
)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM r WHERE place <= 5
"""

_SHINGLES = """
  SELECT DISTINCT id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS shingle
  FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i
        FROM (SELECT {id} AS id, regexp_extract_all(lower(text), '[^\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+') AS w
              FROM {table}) WHERE len(w) > 0)
"""

DECONTAMINATION = f"""
WITH d AS ({_SHINGLES.format(id="doc_id", table="documents")}),
     b AS ({_SHINGLES.format(id="item_id", table="benchmark")}),
     n AS (SELECT id, count(*) AS n FROM b GROUP BY id),
     x AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS k FROM d JOIN b ON d.shingle = b.shingle GROUP BY d.id, b.id)
SELECT doc_id, item_id, CAST(k AS INTEGER) AS n_shared, CAST(n AS INTEGER) AS n_shingles,
       CAST(k AS DOUBLE) / n AS containment
FROM x JOIN n ON n.id = x.item_id WHERE 10 * k >= 8 * n
"""

SUBSTRING_DEDUP = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), k AS (
  SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS seq
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20)
), m AS (
  SELECT doc_id, s, row_number() OVER (PARTITION BY seq ORDER BY doc_id, s) AS turn FROM k
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM m WHERE turn > 1
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d
), kept AS (
  SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.p) AS text, count(*) AS n
  FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p WHERE gone.p IS NULL
  GROUP BY words.doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

PHRASES = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i
        FROM (SELECT lang, w, unnest([1, 2, 3, 4]) AS k FROM w) WHERE len(w) >= k)
), f AS MATERIALIZED (
  SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY lang, k, phrase
), n AS (
  SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang
), c AS MATERIALIZED (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30
), inside AS (
  SELECT lang, a, array_to_string(w[i:i + j - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(1, k - j + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS j FROM c))
), cuts AS (
  SELECT lang, phrase, a, w, i, array_to_string(w[1:i], ' ') AS head, array_to_string(w[i + 1:k], ' ') AS tail
  FROM (SELECT *, unnest(range(1, k)) AS i FROM c) AS c
  WHERE NOT EXISTS (SELECT 1 FROM inside WHERE inside.lang = c.lang AND inside.phrase = c.phrase
                    AND 100::HUGEINT * inside.a >= 80::HUGEINT * c.a)
), scored AS (
  SELECT cuts.lang, cuts.phrase, a, x.f AS l, y.f AS r, i, ((2000000::HUGEINT * a) // (x.f + y.f))::BIGINT AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = head JOIN f y ON y.lang = cuts.lang AND y.phrase = tail
), worst AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1
), best AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS place FROM worst
)
SELECT best.lang, place::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score
FROM best JOIN n ON n.lang = best.lang WHERE place <= 2000
"""


def _crc32(text: str) -> str:
    """Unsigned crc32 of an ASCII string, bit by bit: the bytes are xored in, -1 stands for one shift."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    return (f"xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], {steps}), lambda c, x: CASE WHEN x >= 0 "
            "THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))")


def _field(value: str) -> str:
    return (f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(({value})::VARCHAR)::VARCHAR || ':' || ({value})::VARCHAR END")


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


def _climb(name: str, levels: int) -> str:
    """CTEs {name}0 .. {name}{levels}: the nodes (grp, pos, h) of each level; a single node stays as it is."""
    out = []
    for k in range(levels):
        out.append(f"""{name}{k + 1} AS MATERIALIZED (
  SELECT grp, pos // 16 AS pos, CASE WHEN max(m) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h
  FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS m FROM {name}{k}) GROUP BY grp, pos // 16
)""")
    return ",\n".join(out)


def _walk(name: str, start: str, node: str, levels: int) -> str:
    """CTEs that carry (key, grp, pos, proof, x) of ``start`` up the levels of ``node``; x is the digest recomputed."""
    out = []
    for k in range(levels):
        before = start if k == 0 else f"{name}{k}"
        out.append(f"""{name}{k + 1} AS MATERIALIZED (
  SELECT key, s.grp, s.pos // 16 AS pos, any_value(proof) || coalesce(string_agg(h, '' ORDER BY n.pos)
           FILTER (WHERE n.pos <> s.pos), '') AS proof,
         CASE WHEN any_value(m) = 1 THEN any_value(x)
              ELSE sha256(string_agg(CASE WHEN n.pos = s.pos THEN x ELSE h END, '' ORDER BY n.pos)) END AS x
  FROM {before} s JOIN (SELECT *, count(*) OVER (PARTITION BY grp) AS m FROM {node}{k}) n
    ON n.grp = s.grp AND n.pos // 16 = s.pos // 16
  GROUP BY key, s.grp, s.pos
)""")
    return ",\n".join(out)


MERKLE = f"""
WITH leaves AS MATERIALIZED (
  SELECT row_number() OVER () AS key, doc_id, coalesce('=' || source, '') AS grp, {_leaf('text')} AS leaf,
         CASE WHEN {_crc32('doc_id::VARCHAR')} % 5 = 0
              THEN {_leaf(f"translate(text, '{_UPPER}', '{_UPPER.lower()}')")} END AS altered
  FROM documents
), placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf, key) - 1 AS pos FROM leaves
), a0 AS (SELECT grp, pos, leaf AS h FROM placed),
{_climb('a', 8)},
sources AS MATERIALIZED (
  SELECT grp AS source, '' AS grp, row_number() OVER (ORDER BY grp) - 1 AS pos, h FROM a8
), b0 AS (SELECT grp, pos, h FROM sources),
{_climb('b', 8)},
u0 AS (SELECT key, grp, pos, '' AS proof, coalesce(altered, leaf) AS x FROM placed),
{_walk('u', 'u0', 'a', 8)},
v0 AS (SELECT key, sources.grp, sources.pos, proof, x FROM u8 JOIN sources ON sources.source = u8.grp),
{_walk('v', 'v0', 'b', 8)}
SELECT doc_id, leaf, sources.h AS subroot, b8.h AS root, sha256(v8.proof) AS proof_sha256, v8.x AS folded_root,
       v8.x = b8.h AS verified
FROM placed JOIN sources ON sources.source = placed.grp JOIN v8 ON v8.key = placed.key CROSS JOIN b8
"""
