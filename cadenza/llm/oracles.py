"""DuckDB SQL for the queries that SQL can express.

Left out: op2 and op7 (trained models), op3 (its account numbers need look-around) and op10 (a tokenizer); their tests
compare with brute force. op4's and op8's SQL compare all pairs that share a shingle, and all vectors with each query:
exact, and meant for small tables only.
"""

import math

from cadenza.llm.chat import CLOSE, CONTROLS, MARK, MIDDLE, OPEN
from cadenza.llm.licences import PHRASES, TEMPLATES
from cadenza.llm.quality_rules import CLASS_SHARES, COMMON_WORDS

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: Sources reach their caps in the order of cap by weight; the level is that of the first source which keeps below its cap.
MIX = rf"""
WITH d AS (SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '-' || md5(coalesce(text, ''))) || ':1') AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source),
r AS (SELECT *, source_size * 3 / CAST(w AS DOUBLE) AS ratio,
  coalesce(sum(source_size * 3) OVER o, 0) AS filled, coalesce(sum(w) OVER o, 0) AS gone, sum(source_size) OVER () AS total, sum(w) OVER () AS all_w
  FROM s WINDOW o AS (ORDER BY source_size * 3 / CAST(w AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min((total - filled) / CAST(all_w - gone AS DOUBLE), ratio) FILTER (ratio >= (total - filled) / CAST(all_w - gone AS DOUBLE)) AS level FROM r),
t AS (SELECT source, source_size, least(CAST(source_size * 3 AS DOUBLE), (SELECT level FROM l) * w) AS target FROM r),
b AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS budget,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN source_size > 0 THEN budget // source_size * size + least(size, greatest(0, budget - budget // source_size * source_size - before)) ELSE 0 END AS BIGINT) AS taken FROM b
"""


def _js(counts: list[str], reference: list[float]) -> str:
    """Jensen-Shannon distance, base 2, of counts to shares; null without counts."""
    total = "(" + " + ".join(counts) + ")"
    terms = []
    for c, q in zip(counts, reference):
        share, mid = f"({c} / CAST({total} AS DOUBLE))", f"(({c} / CAST({total} AS DOUBLE) + {q:.17e}) / 2e0)"
        terms.append(f"CASE WHEN {c} > 0 THEN {share} * ln({share} / {mid}) ELSE 0e0 END" + (f" + {q:.17e} * ln({q:.17e} / {mid})" if q > 0 else ""))
    return f"(CASE WHEN {total} > 0 THEN sqrt(greatest(0e0, ({' + '.join(terms)}) / {2 * math.log(2):.17e})) END)"


def _quality() -> str:
    listed = sorted({w for words in COMMON_WORDS.values() for w in words})
    column = {w: f"c{i}" for i, w in enumerate(listed)}
    classes = {"lower": "[a-z]", "space": r"[\x20\x09-\x0D]", "upper": "[A-Z]", "digit": "[0-9]", "mark": r"""[.,;:!?''"()-]""", "latin": "[À-ɏ]"}
    sizes = ", ".join(f"length(t) - length(regexp_replace(t, '{p}', '', 'g')) AS k_{n}" for n, p in classes.items())
    kinds = [f"k_{n}" for n in ("lower", "space", "upper", "mark", "latin", "ascii", "rest")]
    shares = {}
    for lang, words in COMMON_WORDS.items():
        ranks = [1 / (i + 2) for i in range(len(words))]
        shares[lang] = [0.40 * r / sum(ranks) for r in ranks] + [0.60]
    word = []
    for lang, words in COMMON_WORDS.items():
        own = [f"coalesce({column[w]}, 0)" for w in words]
        word.append(_js([*own, f"greatest(n_words - ({' + '.join(own)}), 0)"], shares[lang]))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, hash(list_slice(w, i, i + 7))) AS c FROM d, unnest(generate_series(1, len(w) - 7)) u(i)),
r AS (SELECT rid, sum(least(8, coalesce(n - i, 8))) AS covered FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS n FROM g WHERE c > 1) x GROUP BY rid),
f AS (SELECT rid, {", ".join(f"count(*) FILTER (x = '{w}') AS {c}" for w, c in column.items())} FROM (SELECT rid, lower(unnest(w)) AS x FROM d) y GROUP BY rid),
k AS (SELECT rid, doc_id, t, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l, length(t) - length(regexp_replace(t, '[\x00-\x7F]', '', 'g')) AS k_all, {sizes} FROM d),
a AS (SELECT *, k_all - k_lower - k_space - k_upper - k_digit - k_mark AS k_ascii, length(t) - k_all - k_latin AS k_rest FROM k),
j AS (SELECT doc_id, n_words, word_chars, n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, CAST(coalesce(covered, 0) AS BIGINT) AS n_repeat_words, length(t) AS n,
  round(least({", ".join(_js(kinds, list(CLASS_SHARES[x])) for x in CLASS_SHARES)}), 6) AS class_distance, round(least({", ".join(word)}), 6) AS word_distance
  FROM a LEFT JOIN r USING (rid) LEFT JOIN f USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM j)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (n >= 200 AND coalesce(class_distance, 1e0) > 17e-2 OR n_words >= 60 AND coalesce(word_distance, 1e0) > 44e-2) AS kept, class_distance, word_distance FROM b
"""


def _licences() -> str:
    texts = [(label, text, "TRUE") for text, label in PHRASES.items()] + [(label, text, "FALSE") for label, text in TEMPLATES]
    values = ", ".join(f"({i}, '{label}', {exact}, '{text}')" for i, (label, text, exact) in enumerate(texts))
    return rf"""
WITH t AS (SELECT template, label, exact, string_split(words, ' ') AS w FROM (VALUES {values}) v(template, label, exact, words)),
p AS (SELECT template, label, exact, len(w) - 2 AS n_grams, a, list_slice(w, a + 1, a + 3) AS gram FROM t, unnest(generate_series(0, len(w) - 3)) u(a)),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
h AS (SELECT rid, template, label, exact, n_grams, pos, a, pos - a AS diagonal FROM (SELECT rid, pos, list_slice(w, pos + 1, pos + 3) AS gram FROM d, unnest(generate_series(0, len(w) - 3)) u(pos)) g JOIN p USING (gram)),
v AS (SELECT *, lag(diagonal) OVER (PARTITION BY rid, template ORDER BY diagonal) AS was FROM (SELECT DISTINCT rid, template, exact, diagonal FROM h) x),
s AS (SELECT rid, template, diagonal, sum(CASE WHEN exact OR was IS NULL OR diagonal - was > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY rid, template ORDER BY diagonal) AS span FROM v),
c AS (SELECT rid, template, span, any_value(label) AS label, any_value(exact) AS exact, any_value(n_grams) AS n_grams, count(DISTINCT a) / CAST(any_value(n_grams) AS DOUBLE) AS share, min(pos) AS first_word FROM h JOIN s USING (rid, template, diagonal) GROUP BY 1, 2, 3),
f AS (SELECT rid, count(*) FILTER (exact) AS n_base, min(first_word) FILTER (exact) AS first_word, max(first_word) FILTER (exact) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact), '') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM c WHERE share >= CASE WHEN exact OR n_grams < 10 THEN 1e0 ELSE 7e-1 END GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0e0) AS score FROM d LEFT JOIN f USING (rid)
"""


def _escaped(x: str) -> str:
    x = f"replace({x}, '{MARK}', '{MARK}{MARK}')"
    for c in CONTROLS:
        x = f"replace({x}, '{c}', '{c[0]}{MARK}{c[1:]}')"
    return x


def _chat() -> str:
    said = "</s>[INST] ok [/INST]"
    order = "ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST"
    return f"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -1, 0, 'user', '{said}' UNION ALL SELECT -1, 1, 'assistant', '{said}')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(coalesce(role, '') || chr(10) || coalesce(text, '') || chr(10), '' {order})) AS turns_sha256,
  CAST(coalesce(sum(length(coalesce(text, ''))) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(coalesce(text, ''), '' {order}) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(OPEN + MIDDLE + CLOSE)} + length({_escaped("coalesce(role, '')")}) + length({_escaped("coalesce(text, '')")})) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id
"""


#: Sets as sorted texts of shingles; documents of one set are one node; reach is the closure of the links.
COPIES = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT rid, array_to_string(list_slice(w, i, i + 2), ' ') AS gram FROM d, unnest(generate_series(1, greatest(len(w) - 2, 1))) u(i) WHERE len(w) > 0),
m AS (SELECT rid, doc_id, coalesce(n, 0) AS n, CASE WHEN doc_id IS NOT NULL THEN grams END AS node FROM d LEFT JOIN (SELECT rid, count(*) AS n, sha256(string_agg(gram, chr(10) ORDER BY gram)) AS grams FROM g GROUP BY rid) s USING (rid)),
o AS (SELECT node, min(rid) AS rid, any_value(n) AS n, min(doc_id) AS least FROM m WHERE node IS NOT NULL GROUP BY node),
t AS (SELECT node, n, gram FROM o JOIN g USING (rid)),
p AS (SELECT a.node AS x, b.node AS y FROM t a JOIN t b ON a.gram = b.gram AND a.node < b.node GROUP BY a.node, b.node HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))),
e AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
reach(x, y) AS (SELECT node, node FROM o UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x),
c AS (SELECT reach.x AS node, min(o.least) AS first FROM reach JOIN o ON o.node = reach.y GROUP BY reach.x)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, coalesce(first, doc_id) AS component_id FROM m LEFT JOIN c USING (node)
"""

#: Squares are added component after component, as the engine does, so both ends of the comparison are equal to the bit.
NEAREST = """
WITH v AS (SELECT DISTINCT vec_id, e FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) x
  WHERE vec_id IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda c: c IS NOT NULL AND isfinite(c))) = len(e) AND len(list_filter(e, lambda c: c <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, sqrt(list_reduce(list_transform(list_zip(q.e, c.e), lambda z: (z[2] - z[1]) * (z[2] - z[1])), lambda a, b: a + b)) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e))
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM s) r WHERE rank <= 10
"""


ORACLES: dict[str, str] = {
    "op1_quality_rules": _quality(),
    "op4_ngram_jaccard": COPIES,
    "op5_source_mix": MIX,
    "op6_licence_scan": _licences(),
    "op8_nearest_vectors": NEAREST,
    "op9_chat_format": _chat(),
}
