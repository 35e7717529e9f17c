"""DuckDB equivalents of those queries of this subpackage that SQL can express."""

from __future__ import annotations

_WORDS = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def _ascii_lower(column: str) -> str:
    return (
        f"translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    )


def _shingles(table: str, key: str) -> str:
    """Distinct 5-word shingles (id, s) of a table; a shorter text is one shingle."""
    return f"""
    SELECT DISTINCT id, s FROM (
        SELECT id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1),
                                         lambda i: array_to_string(w[i:i + 4], ' '))) AS s
        FROM (SELECT {key} AS id, regexp_extract_all({_ascii_lower("text")}, '{_WORDS}') AS w
              FROM {table})
        WHERE len(w) > 0)"""


def _words(table: str, key: str) -> str:
    """The words of each row as a list, and in one text with a blank on either side."""
    return f"""
    SELECT {key} AS id, w, ' ' || array_to_string(w, ' ') || ' ' AS line
    FROM (SELECT {key}, regexp_extract_all({_ascii_lower("text")}, '{_WORDS}') AS w FROM {table})"""


# Items of one to four words are contained where these follow each other.
OP1 = f"""
WITH item AS (SELECT * FROM ({_shingles("benchmark", "item_id")}) WHERE len(string_split(s, ' ')) >= 5),
sizes AS (SELECT id, count(*) AS n_item FROM item GROUP BY id),
doc AS ({_shingles("documents", "doc_id")}),
shared AS (
    SELECT doc.id AS doc_id, item.id AS item_id, count(*) AS n_shared
    FROM doc JOIN item USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n_item, n_shared, n_shared / n_item AS containment
FROM shared JOIN sizes ON item_id = sizes.id
WHERE 100 * n_shared >= 80 * n_item
UNION ALL
SELECT d.id, i.id, 1, 1, 1.0::DOUBLE
FROM ({_words("documents", "doc_id")}) AS d
JOIN (SELECT DISTINCT id, line FROM ({_words("benchmark", "item_id")}) WHERE len(w) BETWEEN 1 AND 4) AS i
ON contains(d.line, i.line)
"""

OP5 = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n,
           sha1(coalesce(html, '')) AS d
    FROM pages),
f AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS first_page FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> first_page THEN 'revisit' ELSE 'response' END
           AS record_type,
       CASE WHEN n >= 1000 AND page_id <> first_page THEN first_page END AS refers_to,
       true AS complete
FROM f
"""

# Sizes of sets bound their similarity, so only sets of near sizes are compared.
OP7 = f"""
WITH RECURSIVE words AS (
    SELECT doc_id AS id, regexp_extract_all({_ascii_lower("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w
    FROM documents),
shingle AS (
    SELECT DISTINCT id, s FROM (
        SELECT id, unnest(list_transform(range(1, greatest(len(w) - 1, 1) + 1),
                                         lambda i: array_to_string(w[i:i + 1], ' '))) AS s
        FROM words WHERE len(w) > 0)),
sizes AS (SELECT id, count(*) AS n FROM shingle GROUP BY id),
sized AS (SELECT id, s, n FROM shingle JOIN sizes USING (id)),
links AS (
    SELECT x.id AS a, y.id AS b
    FROM sized AS x JOIN sized AS y
        ON x.s = y.s AND x.id <> y.id AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
    GROUP BY x.id, y.id, x.n, y.n
    HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))),
reach AS (
    SELECT id AS a, id AS b FROM words
    UNION
    SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)
SELECT id AS doc_id, coalesce(n, 0) AS n_shingles, component_id, id = component_id AS kept
FROM least LEFT JOIN sizes USING (id)
"""

OP10 = """
WITH RECURSIVE hashed AS (
    SELECT k, ('0x' || substr(md5(name || '/offset'), 1, 15))::BIGINT % 4099 AS first_slot,
           ('0x' || substr(md5(name || '/skip'), 1, 15))::BIGINT % 4098 + 1 AS step
    FROM (SELECT k, 'shard-' || lpad(k::VARCHAR, 2, '0') AS name FROM range(32) AS t(k))),
prefers AS (
    SELECT n, list(first_slot ORDER BY k) AS firsts, list(step ORDER BY k) AS steps
    FROM hashed, (VALUES (31), (32)) AS v(n) WHERE k < n GROUP BY n),
fill AS (
    SELECT n, 0 AS turn, firsts, steps, list_transform(range(4099), lambda x: -1) AS held FROM prefers
    UNION ALL
    SELECT n, turn + 1, firsts, steps,
           list_transform(held, lambda v, i: CASE WHEN i - 1 = claim THEN turn % n ELSE v END)
    FROM (SELECT *, list_filter(
              list_transform(range(4099),
                             lambda j: (firsts[turn % n + 1] + j * steps[turn % n + 1]) % 4099),
              lambda p: held[p + 1] < 0)[1] AS claim
          FROM fill WHERE turn < 4099)),
slots AS (
    SELECT n, unnest(range(4099)) AS slot, unnest(held) AS k FROM fill WHERE turn = 4099),
placed AS (
    SELECT doc_id, (('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT % 4099)::INTEGER AS slot
    FROM documents)
SELECT doc_id, placed.slot, 'shard-' || lpad(a.k::VARCHAR, 2, '0') AS shard,
       'shard-' || lpad(b.k::VARCHAR, 2, '0') AS shard_after, a.k <> b.k AS moved
FROM placed JOIN slots AS a ON a.slot = placed.slot AND a.n = 32
JOIN slots AS b ON b.slot = placed.slot AND b.n = 31
"""

OP11 = """
WITH h AS (
    SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
           list_transform(range(4), lambda k: ('0x' || substr(sha256('1:' || coalesce(doc_id::VARCHAR, '')),
                                                              8 * k + 1, 8))::BIGINT) AS h
    FROM documents),
c AS (
    SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
           CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                     OR h[3] % 100 >= 90 THEN 'plain'
                WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM h),
p AS (
    SELECT *, '<P>' || substr(t, 1, a) AS pre, '<M>' || substr(t, a + 1, b - a) AS mid,
           '<S>' || substr(t, b + 1) AS suf
    FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN pre || suf || mid ELSE suf || pre || mid END)
           AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({value}::VARCHAR) || ':' || {value} END"


def _leaf(text: str) -> str:
    fields = ("doc_id", "source", "lang", "n_chars", text)
    return f"sha256({' || '.join(_field(f) for f in fields)})"


def _tree(name: str, nodes: str) -> str:
    """CTEs: every level of the trees over ``nodes`` (k, place, n, node), and each node's siblings."""
    run = "PARTITION BY lv, k, place // 16 ORDER BY place ROWS BETWEEN"
    return f"""
{name} AS (
    SELECT 0 AS lv, k, place, n, node FROM {nodes}
    UNION ALL
    SELECT lv + 1, k, place // 16, any_value((n + 15) // 16), sha256(string_agg(node, '' ORDER BY place))
    FROM {name} WHERE n > 1 GROUP BY lv, k, place // 16),
{name}_sides AS (
    SELECT lv, k, place,
           coalesce(string_agg(node, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
           coalesce(string_agg(node, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
    FROM {name} WHERE n > 1)"""


def _walk(name: str, starts: str, tree: str) -> str:
    """CTE: every start (id, k, place, node, proof) on its way up; the last level is the top."""
    return f"""
{name} AS (
    SELECT 0 AS lv, id, k, place, node, proof FROM {starts}
    UNION ALL
    SELECT w.lv + 1, id, w.k, w.place // 16, sha256(l || node || r), proof || l || r
    FROM {name} AS w JOIN {tree}_sides AS s ON s.lv = w.lv AND s.k = w.k AND s.place = w.place)"""


OP13 = f"""
WITH RECURSIVE tab AS (
    SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384)
                                                        ELSE c >> 1 END, b) ORDER BY b) AS t
    FROM range(256) AS r(b)),
d AS (
    SELECT row_number() OVER () AS id, *, coalesce('1' || source, '0') AS tree, {_leaf("text")} AS leaf,
           xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
                           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)
               % 5 = 0 AS tampered
    FROM documents, tab),
leaves AS (
    SELECT id, tree AS k, leaf AS node,
           row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
           count(*) OVER (PARTITION BY tree) AS n
    FROM d),{_tree("sub", "leaves")},
sources AS (
    SELECT 0 AS k, k AS tree, row_number() OVER (ORDER BY k) - 1 AS place, count(*) OVER () AS n, node
    FROM sub WHERE n = 1),{_tree("top", "sources")},
bent AS (
    SELECT id, k, place, '' AS proof,
           CASE WHEN tampered THEN {_leaf(_ascii_lower("text"))} ELSE node END AS node
    FROM leaves JOIN d USING (id)),{_walk("up", "bent", "sub")},
half AS (
    SELECT id, s.k, s.place, arg_max(up.node, lv) AS node, arg_max(proof, lv) AS proof
    FROM up JOIN sources AS s ON s.tree = up.k GROUP BY id, s.k, s.place),{_walk("upper", "half", "top")},
done AS (
    SELECT id, arg_max(node, lv) AS folded, arg_max(proof, lv) AS proof FROM upper GROUP BY id)
SELECT doc_id, leaf, sources.node AS subroot, top.node AS root, sha256(proof) AS proof_sha256,
       folded AS folded_root, folded = top.node AS verified
FROM d JOIN done USING (id) JOIN sources USING (tree) JOIN top ON top.n = 1
"""

LLM_ORACLES: dict[str, str] = {
    "op1_benchmark_decontamination": OP1,
    "op5_warc_segments": OP5,
    "op7_minhash_near_dedup": OP7,
    "op10_shard_placement": OP10,
    "op11_fill_in_middle": OP11,
    "op13_merkle_manifest": OP13,
}
