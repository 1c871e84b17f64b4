"""SQL for the queries that it can express, in DuckDB's dialect."""

from __future__ import annotations

from alertloom.llm import chat_format, license_scan, license_table, mixing

W = r"[^\x20\x09-\x0D]+"
SPACE = r"chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1 = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (SELECT doc_id, pos, line, translate(trim(line, {SPACE}), '{UPPER}', '{LOWER}') AS k FROM lines),
held AS (SELECT k, min(doc_id) AS lo, max(doc_id) AS hi FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING min(doc_id) < max(doc_id)),
marked AS (SELECT doc_id, pos, line, held.lo IS NOT NULL AND held.lo < doc_id AS gone FROM keyed LEFT JOIN held ON keyed.k = held.k AND length(keyed.k) >= 10)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP2 = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS norm FROM v WHERE e IS NOT NULL AND len(e) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE a.norm > 0 AND b.norm > 0 AND round(list_inner_product(a.e, b.e) / (a.norm * b.norm), 12) >= 0.9
), reach(id, other) AS (SELECT a, b FROM links UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a),
low AS (SELECT id, min(other) AS lo FROM reach GROUP BY id), deg AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(deg.n, 0) AS n_links, least(vec_id, coalesce(low.lo, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(low.lo, vec_id)) AS kept
FROM v LEFT JOIN deg ON vec_id = deg.a LEFT JOIN low ON vec_id = low.id
"""

_q = lambda s: s.replace("'", "''")
_copyright = license_scan.COPYRIGHT_LINE


def _canonical(text: str) -> str:
    t = f"lower(regexp_replace(coalesce({text}, ''), '{_q(_copyright)}', '', 'g'))"
    t = rf"regexp_replace({t}, '[^\p{{L}}\p{{N}}\n]+', ' ', 'g')"
    return rf"' ' || regexp_replace({t}, ' ?\n ?', ' ' || chr(10) || ' ', 'g') || ' '"


def _spelled(text: str) -> str:
    for a, b in license_scan.SPELLINGS.items():
        text = f"replace({text}, ' {a} ', ' {b} ')"
    return text


_KNOWN = ", ".join(f"('{_q(n)}', '{_q(t)}')" for n, t in [*license_scan.LICENSES.items(), *((b, a) for a, b in license_scan.NOTICES.items())])
_PLAIN = "sha256(trim(" + _spelled(r"regexp_replace(t, '[ \n]+', ' ', 'g')") + "))"
_LINES = ", ".join(f"('{_q(x)}')" for x in license_table.IDENTIFIERS)
_LONG = ", ".join(f"('{_q(n)}', '{g}')" for n, g in license_table.DIGESTS)
OP3 = f"""
WITH texts AS (SELECT license, text, 0 AS rank FROM (VALUES {_KNOWN}) AS x(license, text) UNION ALL SELECT license, 'SPDX-License-Identifier: ' || license, 1 FROM (VALUES {_LINES}) AS y(license)),
digests AS (SELECT license, rank, {_PLAIN} AS digest FROM (SELECT license, rank, {_canonical("text")} AS t FROM texts) UNION ALL SELECT license, 1, digest FROM (VALUES {_LONG}) AS z(license, digest)),
known AS (SELECT digest, arg_min(license, (rank, license)) AS license FROM digests GROUP BY digest),
d AS (SELECT doc_id, {_canonical("text")} AS t FROM documents),
lines AS (SELECT doc_id, sha256(trim(unnest(string_split({_spelled("t")}, chr(10))))) AS digest FROM d),
named AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS line_licenses FROM lines JOIN known USING (digest) WHERE digest <> sha256('') GROUP BY doc_id)
SELECT d.doc_id, {_PLAIN} AS digest, known.license, known.license IS NOT NULL AS is_license, named.line_licenses
FROM d LEFT JOIN known ON known.digest = {_PLAIN} AND known.digest <> sha256('') LEFT JOIN named ON named.doc_id = d.doc_id
"""

_extra = len(chat_format.OPEN) + len(chat_format.MIDDLE) + len(chat_format.CLOSE)
_size = lambda c: rf"2 * length({c}) - length(translate({c}, '\<[]', ''))"
OP5 = f"""
WITH rows AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1::BIGINT, 0::BIGINT, 'user', '</s>[INST] ok [/INST]'), (-1::BIGINT, 1::BIGINT, 'assistant', '</s>[INST] ok [/INST]')
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({_extra} + {_size("role")} + {_size("text")})::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""

_M, _P = mixing.MIX, mixing.PRIME
_k = f"((((key + r * {_M[1]}) % {_P} * {_M[0]}) % {_P} * {_P} + ((key + r * {_M[2]}) % {_P} * {_M[3]}) % {_P}) % n)"
_o = f"(({_k} - x + n) % n)"
_bit = f"(((greatest(x, {_o}) % {_P} * {_M[4]} + key + r * {_M[0]}) % {_P} * {_M[2]} % {_P}) // 128 % 2)"
_round = f"(CASE WHEN {_bit} = 1 THEN {_o} ELSE x END)"
OP6 = f"""
WITH RECURSIVE sizes AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{W}'))::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank, sum(source_size) OVER ()::DOUBLE AS total FROM per),
weighed AS (SELECT *, [{", ".join(map(str, mixing.WEIGHTS))}][rank % {len(mixing.WEIGHTS)} + 1]::DOUBLE AS w, {mixing.MAX_EPOCHS}.0::DOUBLE * source_size AS cap FROM ranked),
run AS (SELECT *, sum(cap) OVER o - cap AS filled, sum(w) OVER () - sum(w) OVER o + w AS open_w FROM weighed WINDOW o AS (ORDER BY cap / w, rank)),
lev AS (SELECT coalesce(arg_min((total - filled) / open_w, (cap / w, rank)) FILTER ((total - filled) / open_w * w <= cap), 0) AS lv FROM run),
sources AS (SELECT source, source_size, rank, CASE WHEN source_size = 0 THEN 0 ELSE least(cap, lv * w) END AS target FROM run, lev),
shape AS (SELECT *, ceil(source_size / {mixing.BLOCK}.0)::BIGINT AS blocks, least(floor(target / source_size), {mixing.MAX_EPOCHS})::BIGINT AS passes FROM sources WHERE source_size > 0),
plan AS (SELECT *, CASE WHEN passes < {mixing.MAX_EPOCHS} THEN least(floor((target - passes * source_size) / {mixing.BLOCK} + 0.5)::BIGINT, blocks) ELSE 0 END AS rest FROM shape),
slot AS (SELECT rank, blocks AS n, unnest(range(passes * blocks + rest)) AS slot FROM plan),
start AS (SELECT rank, n, slot % n AS x, ({mixing.SEED} + (rank + 1) % {_P} * {_M[2]} + slot // n * {_M[3]}) % {_P} AS key FROM slot),
rounds AS (SELECT rank, n, x, key, 1::BIGINT AS r FROM start UNION ALL SELECT rank, n, {_round} AS x, key, r + 1 FROM rounds WHERE r <= {mixing.ROUNDS}),
drawn AS (SELECT rank, x AS block, count(*) AS times FROM rounds WHERE r = {mixing.ROUNDS + 1} GROUP BY ALL),
cnt AS (SELECT greatest(1, (count(*) + {mixing.BUCKET_ROWS - 1}) // {mixing.BUCKET_ROWS}) AS b FROM sizes),
placed AS (
  SELECT doc_id, s.source, size, source_size, target, rank, sum(size) OVER (PARTITION BY rank ORDER BY (coalesce(doc_id, 0) % {_P} + {_P}) % {_P} * {_M[0]} % {_P} % b, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING)::BIGINT - size AS off
  FROM sizes s JOIN sources t ON s.source IS NOT DISTINCT FROM t.source, cnt
), pieces AS (SELECT doc_id, rank, off, size, unnest(range(off // {mixing.BLOCK}, (off + size - 1) // {mixing.BLOCK} + 1)) AS block FROM placed WHERE size > 0),
taken AS (
  SELECT rank, off, sum(times * (least((block + 1) * {mixing.BLOCK}, off + size) - greatest(block * {mixing.BLOCK}, off)))::BIGINT AS taken
  FROM pieces JOIN drawn USING (rank, block) GROUP BY rank, off
)
SELECT doc_id, size, source_size, round(target, 6) AS target, coalesce(taken, 0) AS taken, source
FROM placed LEFT JOIN taken ON placed.rank = taken.rank AND placed.off = taken.off AND placed.size > 0
"""

OP7 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{W}') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, hash(list_slice(w, i, i + 3)) AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM w WHERE len(w) >= 4)
  UNION ALL SELECT doc_id, hash(w) FROM w WHERE len(w) BETWEEN 1 AND 3
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach(id, other) AS (SELECT a, b FROM links UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.other = l.a),
low AS (SELECT id, min(other) AS lo FROM reach GROUP BY id),
same AS (SELECT doc_id, list(s ORDER BY s) AS k FROM sh GROUP BY doc_id), firsts AS (SELECT k, min(doc_id) AS set_id FROM same GROUP BY k)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(lo, w.doc_id)) AS component_id, coalesce(set_id, w.doc_id) AS set_id
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN low ON w.doc_id = low.id LEFT JOIN same ON same.doc_id = w.doc_id LEFT JOIN firsts ON firsts.k = same.k
"""

_part = lambda c: f"coalesce(strlen({c}) || ':' || {c}, '-')"
_leaf12 = lambda n: "sha256(" + " || ".join(_part(c) for c in ("doc_id::VARCHAR", "source", "lang", f"{n}::VARCHAR", "text")) + ")"
_crc = "list_reduce(flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ord(c), -1, -1, -1, -1, -1, -1, -1, -1])), lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, 4294967295)"
_tree = lambda start: f"SELECT * FROM ({start}) UNION ALL SELECT g, l + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (max(n) + 1) // 2 FROM {{0}} WHERE n > 1 GROUP BY g, l, i // 2"
_walk = lambda start, tree: f"SELECT * FROM ({start}) UNION ALL SELECT w.row, w.g, w.l + 1, w.i // 2, w.proof || coalesce(s.h, ''), sha256(CASE WHEN s.i < w.i THEN s.h || w.folded ELSE w.folded || coalesce(s.h, '') END), (w.n + 1) // 2 FROM {{0}} w LEFT JOIN {tree} s ON s.g = w.g AND s.l = w.l AND s.i = xor(w.i, 1) WHERE w.n > 1"
OP12 = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce('=' || lang, '') AS g, {_leaf12("n_chars")} AS leaf,
    CASE WHEN n_chars IS NOT NULL AND doc_id IS NOT NULL AND xor({_crc}, 4294967295) % 7 = 0 THEN {_leaf12("(n_chars + 1)")} END AS bad FROM documents
), p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM d),
tree AS ({_tree("SELECT g, 0 AS l, i, leaf AS h, n FROM p").format("tree")}),
sub AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
over_tree AS ({_tree("SELECT '' AS g, 0 AS l, i, h, n FROM sub").format("over_tree")}),
walk AS ({_walk("SELECT row, g, 0 AS l, i, '' AS proof, coalesce(bad, leaf) AS folded, n FROM p", "tree").format("walk")}),
over_walk AS ({_walk("SELECT w.row, '' AS g, 0 AS l, sub.i, w.proof, w.folded, sub.n FROM walk w JOIN sub USING (g) WHERE w.n = 1", "over_tree").format("over_walk")})
SELECT p.doc_id, p.leaf, sub.h AS subroot, r.h AS root, sha256(o.proof) AS proof_sha256, o.folded AS folded_root, o.folded = r.h AS verified
FROM p JOIN sub USING (g) JOIN over_walk o ON o.row = p.row AND o.n = 1, (SELECT h FROM over_tree WHERE n = 1) r
"""

SQL = {"op1_line_dedup": OP1, "op2_embedding_near_dedup": OP2, "op3_license_scan": OP3, "op5_chat_format": OP5, "op6_source_mixing": OP6, "op7_ngram_jaccard_join": OP7, "op12_merkle_manifest": OP12}
