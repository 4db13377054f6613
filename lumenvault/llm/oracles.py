"""DuckDB SQL with the rows of the text queries that SQL can express."""

from .merkle import LEAF, PARAGRAPH, SECTION, PHRASE
from .pii import IBAN_LENGTHS

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP4 = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, w, least(13, len(w)) AS k FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) q WHERE item_id IS NOT NULL AND len(w) > 0),
iw AS MATERIALIZED (SELECT DISTINCT item, k, array_to_string(w[pos : pos + k - 1], ' ') AS win FROM (SELECT item, k, w, unnest(range(1, len(w) - k + 2)) AS pos FROM i) q),
dw AS (SELECT doc_id, k, pos, array_to_string(w[pos : pos + k - 1], ' ') AS win FROM (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS pos FROM d CROSS JOIN (SELECT DISTINCT k FROM iw) ks WHERE len(w) >= k) q),
hit AS MATERIALIZED (SELECT doc_id, item, pos, k FROM dw JOIN iw USING (k, win)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + k)) AS p FROM hit) q GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) q GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
 coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""


def _print(tree: str) -> str:
    paragraph = "sha256(array_to_string(p, ''))"
    section = f"sha256(array_to_string(list_transform(ps, lambda p: {paragraph}), ''))"
    return f"""sha256(array_to_string(list_transform({tree}, lambda ps: {section}), '')) || array_to_string(list_transform({tree}, lambda ps: '/' || left({section}, 16) ||
 array_to_string(list_transform(ps, lambda p: ';' || left({paragraph}, 16) || array_to_string(list_transform(p, lambda x: '.' || left(x, 12)), '')), '')), '')"""


def _tree(text: str) -> str:
    return f"list_transform(regexp_extract_all({text}, '{SECTION}'), lambda s: list_transform(regexp_extract_all(s, '{PARAGRAPH}'), lambda p: list_transform(regexp_extract_all(p, '{PHRASE}'), lambda x: sha256(x))))"


def _leaves(fingerprint: str) -> str:
    return f"list_distinct(regexp_extract_all({fingerprint}, '{LEAF}', 1))"


def _like(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect({a}, {b})) / (len({a}) + len({b})) END"


def _edit(level: str, a: str, b: str) -> str:
    """Columns i, r, n of `level`: length of the common head of lists a and b, and what is left of each without their common tail."""
    least = f"least(len({a}), len({b}))"
    i = f"coalesce(list_min(list_filter(range(0, {least}), lambda q: {a}[q + 1] <> {b}[q + 1])), {least})"
    k = f"coalesce(list_min(list_filter(range(0, {least} - {i}), lambda q: {a}[len({a}) - q] <> {b}[len({b}) - q])), {least} - {i})"
    return f"{i} AS i{level}, len({a}) - {i} - {k} AS r{level}, len({b}) - {i} - {k} AS n{level}"


_STEPS = f"""e1 AS MATERIALIZED (SELECT *, {_edit('1', 'a1', 'b1')} FROM (SELECT *, string_split(fa, '/')[2:] AS a1, string_split(fb, '/')[2:] AS b1 FROM g) q),
e2 AS MATERIALIZED (SELECT *, {_edit('2', 'a2', 'b2')} FROM (SELECT *, string_split(a1[i1 + 1], ';')[2:] AS a2, string_split(b1[i1 + 1], ';')[2:] AS b2 FROM e1) q),
e3 AS MATERIALIZED (SELECT *, {_edit('3', 'a3', 'b3')} FROM (SELECT *, string_split(a2[i2 + 1], '.')[2:] AS a3, string_split(b2[i2 + 1], '.')[2:] AS b3 FROM e2) q),
e AS MATERIALIZED (SELECT doc_id, CASE WHEN left(fa, 64) = left(fb, 64) THEN '' WHEN r1 <> 1 OR n1 <> 1 THEN 'section:' || i1 || '-' || r1 || '+' || n1
 WHEN r2 <> 1 OR n2 <> 1 THEN 'paragraph:' || i1 || ':' || i2 || '-' || r2 || '+' || n2 ELSE 'phrase:' || i1 || ':' || i2 || ':' || i3 || '-' || r3 || '+' || n3 END AS edit_at FROM e3)"""

OP5 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n FROM documents),
x AS (SELECT doc_id, t, n, left(t, n - n // 2) || left(coalesce(lead(t) OVER w, first_value(t) OVER w), n // 2) AS x FROM d WINDOW w AS (ORDER BY doc_id DESC)),
f AS MATERIALIZED (SELECT doc_id, n, sha256(x) AS edited_sha256, {_tree('t')} AS a, {_tree('x')} AS b FROM x),
g AS MATERIALIZED (SELECT doc_id, n, edited_sha256, {_print('a')} AS fa, {_print('b')} AS fb FROM f),
{_STEPS},
h AS MATERIALIZED (SELECT g.*, edit_at, {_leaves('fa')} AS la, {_leaves('fb')} AS lb FROM g JOIN e USING (doc_id)),
k AS (SELECT *, coalesce(lead(la) OVER w, first_value(la) OVER w) AS ln FROM h WINDOW w AS (ORDER BY doc_id DESC))
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, edited_sha256, fa AS fingerprint, fb AS edited_fingerprint, {_like('la', 'lb')} AS near_edited, {_like('la', 'ln')} AS near_next, edit_at FROM k
"""

OP10 = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS MATERIALIZED (SELECT r, s, md5(array_slice(b, s + 1, s + 400)) AS m FROM (SELECT r, b, unnest(range(0, n - 399)) AS s FROM d WHERE n >= 400) q),
hit AS (SELECT r, s FROM w WHERE m IN (SELECT m FROM w GROUP BY m HAVING count(*) > 1)),
runs AS (SELECT r, s, sum(CASE WHEN s <= before + 400 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY s) AS g FROM (SELECT r, s, coalesce(lag(s) OVER (PARTITION BY r ORDER BY s), -1000) AS before FROM hit) q),
spans AS (SELECT r, list(s ORDER BY s) AS ss, list(e ORDER BY s) AS es, sum(e - s) AS removed FROM (SELECT r, min(s) AS s, max(s) + 400 AS e FROM runs GROUP BY r, g) q GROUP BY r)
SELECT doc_id, n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(len(ss), 0) AS BIGINT) AS n_spans,
 CASE WHEN ss IS NULL THEN sha256(b) ELSE sha256(unhex(array_to_string(list_transform(range(0, len(ss) + 1), lambda i: hex(array_slice(b, CASE WHEN i = 0 THEN 1 ELSE es[i] + 1 END, CASE WHEN i = len(ss) THEN n ELSE ss[i + 1] END))), ''))) END AS kept_sha256
FROM d LEFT JOIN spans USING (r)
"""

#: Plain forms of the patterns, with the test that a match must pass.
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_LUHN = f"list_sum(list_transform(string_split(reverse({_DIGITS}), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN CAST(c AS INT) ELSE 2 * CAST(c AS INT) - CASE WHEN CAST(c AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
_MOD97 = """list_reduce(list_transform(string_split(substring(replace(m, ' ', ''), 5) || left(replace(m, ' ', ''), 4), ''), lambda c: ascii(c)), lambda z, c: CASE WHEN c < 58 THEN (z * 10 + c - 48) % 97 ELSE (z * 100 + c - 55) % 97 END, 0) = 1"""
def _iban() -> str:
    """Numbers of their country's length, of other countries as far as they go; the latter's codes are those not in the list."""
    known = {n: codes.split() for n, codes in IBAN_LENGTHS.items()}
    taken = {c for codes in known.values() for c in codes}
    rest = "|".join(f"{a}[{''.join(b for b in _LETTERS if a + b not in taken)}]" for a in _LETTERS)
    return rf"\b(?:{'|'.join(rf'(?:{"|".join(codes)})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}' for n, codes in known.items())}|(?:{rest})[0-9]{{2}}(?: ?[A-Z0-9]){{11,30}})\b"


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Name, plain pattern, test of a match m, score, and words that raise it by 0.3 in the 40 characters before.
_KINDS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true", 0.9, "mail|contact|write"),
    ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", rf"regexp_full_match(m, '{_PART}(?:\.{_PART}){{3}}')", 0.6, r"\bip\b|address|host|server"),
    ("card", r"[0-9](?:[ -]?[0-9])+", f"length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}", 0.7, "card|visa|credit|payment"),
    ("phone", r"\+[0-9][ ().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 10 AND 15", 0.6, "phone|call|tel|mobile"),
    ("iban", _iban(), f"length(replace(m, ' ', '')) BETWEEN 15 AND 34 AND {_MOD97}", 0.8, "iban|account|bank"),
    ("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "true", 0.5, "ssn|social security"),
)
_MATCHED = " UNION ALL ".join(
    f"""SELECT r, s, e, '{kind}' AS kind, {rank} AS rank, {prior} AS prior, '{context}' AS context FROM (SELECT r, m, sum(length(g) + length(m)) OVER w - length(m) AS s, sum(length(g) + length(m)) OVER w AS e FROM (
 SELECT r, i, ms[i] AS m, gs[i] AS g FROM (SELECT r, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT r, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS gs FROM d) a) b) c WINDOW w AS (PARTITION BY r ORDER BY i)) q WHERE {test}"""
    for rank, (kind, pattern, test, prior, context) in enumerate(_KINDS)
)
_FOUND = f"""SELECT * FROM (SELECT r, s, e, kind, rank, least(100, CAST(round(100 * prior) AS INT) + CASE WHEN regexp_matches(lower(right(left(t, CAST(s AS BIGINT)), 40)), context) THEN 30 ELSE 0 END) AS score FROM ({_MATCHED}) m JOIN d USING (r)) f WHERE rank < 4 OR score >= 75"""
OP8 = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), f AS MATERIALIZED ({_FOUND}),
g AS (SELECT r, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k, *_ in _KINDS[:4])},
 string_agg(kind || ':' || CAST(s AS VARCHAR) || ':' || CAST(e AS VARCHAR), ',' ORDER BY s, rank) FILTER (rank < 4) AS base, string_agg(kind || ':' || CAST(s AS VARCHAR) || ':' || CAST(e AS VARCHAR), ',' ORDER BY s, rank) AS spans, string_agg(CAST(score AS VARCHAR), ',' ORDER BY s, rank) AS scores FROM f GROUP BY r)
SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k, *_ in _KINDS[:4])}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores FROM d LEFT JOIN g USING (r)
"""

_SHARE = "1 + (1000000000::HUGEINT * ({c} + 1)) // ({n} + v)"
OP11 = f"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS MATERIALIZED (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term, count(*)::HUGEINT AS cl FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(cl)::HUGEINT AS nl FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS MATERIALIZED (SELECT lang, source, term, count(*)::HUGEINT AS c FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
n AS (SELECT lang, source, coalesce(sum(c), 0)::HUGEINT AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS MATERIALIZED (SELECT lang, source, term, coalesce(c, 0) AS c, {_SHARE.format(c='coalesce(c, 0)', n='n')} AS p, {_SHARE.format(c='cl', n='nl')} AS q FROM n JOIN kept USING (lang) JOIN l USING (lang) LEFT JOIN c USING (lang, source, term)),
pv AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pr AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source),
tm AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value FROM p WHERE c > 0 AND p > q),
u AS (SELECT * FROM pr UNION ALL SELECT * FROM tm)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u) q WHERE part = 'pair' OR rank <= 200
"""

OP12 = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
 ('0x' || left(md5(concat_ws(':', CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 15))::BIGINT AS draw FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM s),
c AS (SELECT *, 3 * source_size AS ceiling, sum(w) OVER a AS ws, sum(3 * source_size) OVER a AS cs FROM w WINDOW a AS (ORDER BY 30 * source_size // w, source NULLS LAST)),
v AS (SELECT max(((SELECT sum(source_size) FROM s) - (cs - ceiling))::DOUBLE / ((SELECT sum(w) FROM w) - (ws - w))::DOUBLE) AS level FROM c),
p AS (SELECT source, source_size, least(ceiling::DOUBLE, level * w) AS target, CAST(floor(least(ceiling::DOUBLE, level * w) + 0.5) AS BIGINT) AS budget FROM c, v),
x AS (SELECT d.*, source_size, target, budget, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs, sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id, size, r) - size AS ahead FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - ahead)) AS BIGINT) AS taken FROM x
"""

OP13 = """
WITH h AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
i AS (SELECT *, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM h),
j AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM i),
k AS (SELECT *, left(t, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1) AS x FROM j)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || x || '<M>' || m ELSE '<S>' || x || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM k
"""
