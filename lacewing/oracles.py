"""DuckDB SQL for the matcher's queries, over the same tables."""

from __future__ import annotations

from lacewing.functions.text import LEGAL, LONG_LEGAL, ORDINALS, TURKISH_LEGAL

TAIL = "CASE p_partkey % 5 WHEN 0 THEN ' Ltd.' WHEN 1 THEN ' LIMITED' WHEN 2 THEN '  Sanayi ve Tic. A.S.' WHEN 3 THEN ' 2' ELSE '' END"
PARTS = f"SELECT p_partkey AS id, p_name || {TAIL} AS name FROM part"
PLAIN = "SELECT p_partkey AS id, p_name AS name FROM part"
ORDINAL = "SELECT p_partkey AS id, p_name || CASE p_partkey % 5 WHEN 0 THEN ' Onbirinci' WHEN 1 THEN ' İKİNCİ Fon' WHEN 2 THEN ' yuz' WHEN 3 THEN ' 3 YÜZÜNCÜ' ELSE ' Kırkbeşinci' END AS name FROM part"
DISTINCT = "SELECT min(p_partkey) AS id, p_name AS name FROM part GROUP BY p_name"
TURNED = "SELECT min(p_partkey) AS id, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE array_to_string(list_reverse(string_split(p_name, ' ')), ' ') END AS name FROM part GROUP BY 2"
URLS = "SELECT page_id AS id, url AS name FROM pages"
SUPPLIERS = "SELECT s_suppkey AS id, s_name AS name FROM supplier"


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def split(text: str) -> str:
    return rf"list_filter(string_split_regex({text}, '\s+'), lambda w: w <> '')"


def lowered(turkish: bool) -> str:
    return "translate(lower(translate(name, 'Iİ', 'ıi')), 'çğıöşüâîû', 'cgiosuaiu')" if turkish else "lower(name)"


def pieces(word: str) -> str:
    """Parts between points and commas, neighbouring single characters joined."""
    cut = f"list_filter(string_split(regexp_replace({word}, '[.,]+', '.', 'g'), '.'), lambda p: p <> '')"
    glued = f"array_to_string(list_transform({cut}, lambda p, i: p || CASE WHEN length(p) = 1 AND length(({cut})[i + 1]) = 1 THEN '' ELSE '.' END), '')"
    return f"list_filter(string_split({glued}, '.'), lambda p: p <> '')"


def listed(word: str, turkish: bool) -> str:
    near = f" OR list_contains({_list(TURKISH_LEGAL)}, {word}) OR (length({word}) >= 6 AND len(list_filter({_list(LONG_LEGAL)}, lambda l: damerau_levenshtein({word}, l) <= 1)) > 0)"
    return f"(list_contains({_list(LEGAL)}, {word})" + (near if turkish else "") + ")"


def normal_rows(source: str, token_sort: bool = False, strip: bool = False, turkish: bool = False) -> str:
    """id and s. Words are judged one by one, in rows; the legal ones at the end go, but for the first word."""
    joined = "string_agg(w, ' ' ORDER BY w)" if token_sort else "string_agg(w, ' ' ORDER BY i)"
    words = f"SELECT id, unnest({split(lowered(turkish))}) AS w, generate_subscripts({split(lowered(turkish))}, 1) AS i FROM ({source})"
    if not strip:
        return f"SELECT o.id, coalesce(n.s, '') AS s FROM ({source}) o LEFT JOIN (SELECT id, {joined} AS s FROM ({words}) GROUP BY id) n ON o.id = n.id"
    bare = "regexp_replace(w, '[.,]', '', 'g')"
    told = f"SELECT DISTINCT w, {listed(bare, turkish)} AS whole, {pieces('w')} AS ps FROM ({words})"
    part = f"SELECT w, bool_and({listed('p', turkish)}) AS every FROM (SELECT w, unnest(ps) AS p FROM ({told})) GROUP BY w"
    legal = f"SELECT t.w, t.whole OR coalesce(p.every, FALSE) AS legal FROM ({told}) t LEFT JOIN ({part}) p ON t.w = p.w"
    kept = f"SELECT id, w, i FROM (SELECT x.id, x.w, x.i, greatest(1, coalesce(max(CASE WHEN l.legal THEN NULL ELSE x.i END) OVER (PARTITION BY x.id), 1)) AS last FROM ({words}) x JOIN ({legal}) l ON x.w = l.w) WHERE i <= last"
    return f"SELECT o.id, coalesce(n.s, '') AS s FROM ({source}) o LEFT JOIN (SELECT id, {joined} AS s FROM ({kept}) GROUP BY id) n ON o.id = n.id"


def score(a: str, b: str) -> str:
    return f"CASE WHEN greatest(length({a}), length({b})) = 0 THEN 0.0::DOUBLE ELSE levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b})) END"


def numbers(text: str, turkish: bool = False) -> str:
    return f"list_sort(list_filter(string_split({text}, ' '), lambda w: regexp_matches(w, '[0-9]')" + (f" OR list_contains({_list(ORDINALS)}, w)" if turkish else "") + "))"


def leftover(a: str, b: str) -> str:
    left = f"list_transform(list_distinct(string_split({a}, ' ')), lambda w: list_transform(range(greatest(0, len(list_filter(string_split({a}, ' '), lambda x: x = w AND x <> '')) - len(list_filter(string_split({b}, ' '), lambda x: x = w)))), lambda i: w))"
    return f"array_to_string(list_sort(flatten({left})), ' ')"


def pairs(source: str, t: float, extra: str = "TRUE", **normal) -> str:
    """Scores are found once for each pair of different strings, then spread over the rows that hold them."""
    return f"""WITH n AS MATERIALIZED ({normal_rows(source, **normal)}), d AS (SELECT DISTINCT s FROM n),
p AS MATERIALIZED (SELECT a.s AS sa, b.s AS sb, {score('a.s', 'b.s')} AS score FROM d a, d b WHERE abs(length(a.s) - length(b.s)) <= {t}::DOUBLE * greatest(length(a.s), length(b.s)) + 0.001),
q AS MATERIALIZED (SELECT * FROM p WHERE score <= {t}::DOUBLE AND {extra})
SELECT a.id AS id_a, b.id AS id_b, score FROM q JOIN n a ON a.s = sa JOIN n b ON b.s = sb WHERE a.id < b.id"""


def across(left: str, right: str, t: float, names: tuple[str, str], left_join: bool = False) -> str:
    """Pairs of two tables; left_join: left rows without any too, with nulls."""
    a, b = names
    return f"""WITH l AS MATERIALIZED ({normal_rows(left)}), r AS MATERIALIZED ({normal_rows(right)}),
q AS MATERIALIZED (SELECT sa, sb, score FROM (SELECT a.s AS sa, b.s AS sb, {score('a.s', 'b.s')} AS score FROM (SELECT DISTINCT s FROM l) a, (SELECT DISTINCT s FROM r) b) WHERE score <= {t}::DOUBLE)
SELECT l.id AS {a}, m.id AS {b}, m.score FROM l {'LEFT ' if left_join else ''}JOIN (SELECT q.sa, r.id, q.score FROM q JOIN r ON r.s = q.sb) m ON m.sa = l.s"""


def stored(source: str, first: int | str = 0) -> str:
    return f"SELECT row_number() OVER (ORDER BY id, name) - 1 + {first} AS id, name FROM ({source})"


def max_edits(length: str, t: float) -> str:
    return f"(SELECT max(e) FROM range(0, {length} + 1) AS r(e) WHERE {length} = 0 OR e::DOUBLE / {length} <= {t}::DOUBLE)"


def verified(t: float) -> str:
    """Pairs of URLs of which a segment of the shorter stands in the longer, at a place that the budget allows."""
    return f"""WITH n AS (SELECT id, lower(url) AS s, length(url) AS len FROM (SELECT page_id AS id, url FROM pages)),
k AS (SELECT len, {max_edits('len', t)} AS k FROM (SELECT DISTINCT len FROM n)),
m AS (SELECT a.id AS a, b.id AS b, a.s AS s, b.s AS r, a.len AS small, b.len AS big, k FROM n a JOIN n b ON a.len < b.len OR (a.len = b.len AND a.id < b.id) JOIN k ON k.len = b.len WHERE b.len - k <= a.len AND a.len > k),
g AS (SELECT *, unnest(range(0, k + 1)) AS seg FROM m),
c AS (SELECT *, small // (k + 1) + (seg >= k + 1 - small % (k + 1))::INT AS size, seg * (small // (k + 1)) + greatest(0, seg - (k + 1 - small % (k + 1))) AS start FROM g),
p AS (SELECT *, unnest(range(greatest(start - seg, start + big - small - (k - seg), 0), least(start + seg, start + big - small + (k - seg), big - size) + 1)) AS pos FROM c)
SELECT DISTINCT a, b FROM p WHERE substr(s, start + 1, size) = substr(r, pos + 1, size)"""


def oracle_sql() -> dict[str, str]:
    pair = f"WITH p AS ({DISTINCT}) SELECT a.id AS id_a, b.id AS id_b, {{}} FROM p a JOIN p b ON a.id < b.id"
    same_words = f"{score(leftover('sa', 'sb'), leftover('sb', 'sa'))} <= 0.34::DOUBLE"
    same_numbers = f"{numbers('sa')} = {numbers('sb')}"
    truth = "SELECT a.s_suppkey AS id_a, b.s_suppkey AS id_b FROM supplier a JOIN supplier b ON a.s_suppkey % 10 = b.s_suppkey % 10 AND a.s_suppkey < b.s_suppkey"
    component = f"WITH RECURSIVE e AS ({pairs(URLS, 0.1)}), u AS (SELECT id_a AS a, id_b AS b FROM e UNION SELECT id_b, id_a FROM e), r AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a), c AS (SELECT a AS id, least(a, min(b)) AS group_id FROM r GROUP BY a) "
    counts = "SELECT id, name, list_transform(range(32), lambda k: len(list_filter(string_split(name, ''), lambda c: ascii(c) % 32 = k))) AS n"
    lengths = "SELECT DISTINCT length(url) AS len FROM pages"
    all_stored = f"{stored(DISTINCT)} UNION ALL {stored(URLS, f'(SELECT count(*) FROM ({DISTINCT}))')}"
    hundredth = f"SELECT * FROM ({PARTS}) WHERE id % 100 = 0"
    normal = lambda **options: f"SELECT id, s AS norm FROM ({normal_rows(PARTS, **options)})"
    return {
        "normalize_default": normal(), "normalize_token_sort": normal(token_sort=True), "normalize_strip": normal(strip=True), "normalize_turkish": normal(turkish=True), "normalize_all": normal(token_sort=True, strip=True, turkish=True),
        "suffix_pieces": f"SELECT id, array_to_string({pieces('lower(name)')}, '|') AS pieces FROM ({PARTS})",
        "number_words": f"SELECT id, array_to_string({numbers('s')}, ' ') AS numbers FROM ({normal_rows(PARTS)})",
        "tokens": f"SELECT id, array_to_string(list_sort(string_split(s, ' ')), '|') AS tokens FROM ({normal_rows(PARTS)})",
        "turkish_ordinal": f"SELECT id, array_to_string({numbers('s', True)}, ' ') AS numbers FROM ({normal_rows(ORDINAL, turkish=True)})",
        "levenshtein": pair.format("levenshtein(a.name, b.name)::BIGINT AS distance"), "levenshtein_bounded": pair.format("CASE WHEN levenshtein(a.name, b.name) <= 3 THEN levenshtein(a.name, b.name) ELSE -1 END::BIGINT AS distance"),
        "pair_score": pair.format("levenshtein(a.name, b.name)::DOUBLE / greatest(length(a.name), length(b.name)) AS score"),
        "leftover_words": f"WITH p AS (SELECT id, lower(name) AS name FROM ({DISTINCT})) SELECT a.id AS id_a, b.id AS id_b, {leftover('a.name', 'b.name')} AS leftover FROM p a JOIN p b ON a.id < b.id",
        "sketch_bound": f"WITH p AS ({counts} FROM ({DISTINCT})) SELECT a.id AS id_a, b.id AS id_b, ceil(list_sum(list_transform(range(1, 33), lambda k: abs(a.n[k] - b.n[k]))) / 2)::BIGINT AS bound, ceil(list_sum(list_transform(range(1, 33), lambda k: abs(a.n[k] - b.n[k]))) / 2) <= levenshtein(a.name, b.name) AS holds FROM p a JOIN p b ON a.id < b.id",
        "osa_le1": f"SELECT id, damerau_levenshtein(name, 'small ring') <= 1 OR damerau_levenshtein(name, 'large bolt') <= 1 AS near FROM ({DISTINCT})",
        "max_edits": f"SELECT len::BIGINT AS len, {max_edits('len', 0.1)}::BIGINT AS k FROM range(200) AS t(len)",
        "index_ks": f"SELECT DISTINCT n::BIGINT AS len, k::BIGINT AS k FROM (SELECT n, big, {max_edits('big', 0.2)} AS k FROM (SELECT n, unnest(range(n, 2 * n + 2)) AS big FROM range(1, 60) AS t(n))) WHERE big - k <= n AND n > k",
        "segments": f"SELECT len::BIGINT AS len, seg::BIGINT AS seg, (sum(size) OVER (PARTITION BY len ORDER BY seg) - size)::BIGINT AS start, size::BIGINT AS size FROM (SELECT len, seg, len // 4 + (seg >= 4 - len % 4)::INT AS size FROM ({lengths}), range(4) AS t(seg))",
        "length_histogram": "SELECT length(url)::BIGINT AS len, count(*)::BIGINT AS n FROM pages GROUP BY 1",
        "dedupe_brute": pairs(URLS, 0.1), "dedupe_indexed": pairs(URLS, 0.1), "find_duplicates_auto": pairs(URLS, 0.2), "find_duplicates_wide": pairs(URLS, 0.6),
        "find_duplicates_token_sort": pairs(TURNED, 0.1, token_sort=True), "find_duplicates_strip": pairs(PARTS, 0.1, strip=True), "find_duplicates_turkish": pairs(PARTS, 0.1, strip=True, turkish=True), "find_duplicates_suppliers": pairs(SUPPLIERS, 0.1),
        "rule_numbers": pairs(PARTS, 0.1, same_numbers), "rule_words": pairs(PARTS, 0.1, same_words), "rule_precise": pairs(PARTS, 0.1, f"{same_numbers} AND {same_words}"),
        "link_brute": across(PLAIN, PARTS, 0.2, ("id_left", "id_right")), "link_indexed": across(PLAIN, PARTS, 0.2, ("id_left", "id_right")), "link_auto": across(PLAIN, PARTS, 0.3, ("id_left", "id_right")),
        "cluster_pairs": component + "SELECT group_id, id FROM c", "cluster_groups": component + "SELECT group_id, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids FROM c GROUP BY group_id",
        "stats": f"SELECT (SELECT count(*) FROM ({pairs(URLS, 0.1)})) AS found, (SELECT count(*) FROM ({verified(0.1)})) AS verified, (SELECT count(*) * (count(*) - 1) // 2 FROM pages)::BIGINT AS all_pairs",
        "auto_strategy": f"WITH n AS (SELECT length(url) AS len, row_number() OVER (ORDER BY length(url)) - 1 AS i, count(*) OVER () AS total FROM pages) SELECT coalesce(max(total), 0) < 2 OR (bool_or(i = total // 2 AND {max_edits('len', 0.1)} >= 16) AND max(total) <= 20000) AS brute FROM n",
        "index_query_many": across(hundredth, stored(PARTS), 0.2, ("query_id", "id"), True), "index_query_wide": across(hundredth, stored(PARTS), 0.6, ("query_id", "id"), True),
        "index_add_query": across(URLS, all_stored, 0.2, ("query_id", "id")), "index_build": stored(DISTINCT), "index_roundtrip": stored(DISTINCT),
        "index_query": f"SELECT id, score FROM (SELECT id, {score('name', chr(39) + 'small rings' + chr(39))} AS score FROM ({stored(DISTINCT)})) WHERE score <= 0.2::DOUBLE",
        "truth_pairs": truth,
        "pair_quality": f"WITH f AS ({pairs(SUPPLIERS, 0.06)}), t AS ({truth}), n AS (SELECT (SELECT count(*) FROM f JOIN t USING (id_a, id_b)) AS tp, (SELECT count(*) FROM f) AS n, (SELECT count(*) FROM t) AS m), s AS (SELECT tp, CASE WHEN n = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / n END AS p, CASE WHEN m = 0 THEN 0.0::DOUBLE ELSE tp::DOUBLE / m END AS r FROM n) SELECT tp, p AS precision, r AS recall, CASE WHEN p + r = 0 THEN 0.0::DOUBLE ELSE 2 * p * r / (p + r) END AS f1 FROM s",
    }
