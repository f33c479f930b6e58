"""The subpackage's named queries and, where SQL can state them, their equivalents."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..plans.inputs import WS, nfkc_sql, tokens_sql
from . import distinctive, frequencies, lookalikes, mixing, overlaps, packing, sentences, splits

MODULES = (lookalikes, frequencies, splits, distinctive, overlaps, packing, mixing, sentences)

# Look-alike forms for the characters of the test tables, apart from the operator's own table: letters by their names, width forms, spaces;
# invisible ones have no counterpart and go. Letters of other scripts by the Latin letter they are drawn like.
_CAPITAL = {"A": "CYRILLIC A, GREEK ALPHA", "B": "CYRILLIC VE, GREEK BETA", "C": "CYRILLIC ES", "E": "CYRILLIC IE, GREEK EPSILON", "H": "CYRILLIC EN, GREEK ETA", "I": "CYRILLIC BYELORUSSIAN-UKRAINIAN I, GREEK IOTA", "J": "CYRILLIC JE", "K": "CYRILLIC KA, GREEK KAPPA", "M": "CYRILLIC EM, GREEK MU", "N": "GREEK NU", "O": "CYRILLIC O, GREEK OMICRON", "P": "CYRILLIC ER, GREEK RHO", "S": "CYRILLIC DZE", "T": "CYRILLIC TE, GREEK TAU", "X": "CYRILLIC HA, GREEK CHI", "Y": "GREEK UPSILON", "Z": "GREEK ZETA"}
_SMALL = {"a": "CYRILLIC A", "c": "CYRILLIC ES", "e": "CYRILLIC IE", "g": "LATIN SCRIPT G", "h": "CYRILLIC SHHA", "i": "CYRILLIC BYELORUSSIAN-UKRAINIAN I", "j": "CYRILLIC JE", "o": "CYRILLIC O, GREEK OMICRON, ARMENIAN OH", "p": "CYRILLIC ER", "s": "CYRILLIC DZE", "v": "GREEK NU", "x": "CYRILLIC HA", "y": "CYRILLIC U"}
_LIKE = [("\u03f2", "c")] + [(unicodedata.lookup(x.replace(" ", f" {case} LETTER ", 1)), latin) for case, table in (("CAPITAL", _CAPITAL), ("SMALL", _SMALL)) for latin, names in table.items() for x in names.split(", ")]
_SEEN = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F) if c != 0x27) + "\u00a0\u2002\u2007\u2009\u202f\u205f\u3000" + "".join(c for c, _ in _LIKE)
_AS = "".join(chr(c) for c in range(0x21, 0x7F) if c != 0x27) + " " * 7 + "".join(x for _, x in _LIKE)
_UNSEEN = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
FORM = f"trim(nfc_normalize(replace(replace(translate(text, '{_SEEN}{_UNSEEN}', '{_AS}'), '\uff07', \'\'\'\'), '\ufb01', 'fi')), ' ')"
FORMS = " UNION ALL ".join(f"SELECT '{t}' AS table_name, row_no, text, {FORM} AS form FROM {t} WHERE text IS NOT NULL" for t in ("intents_v1", "ood_test_v3"))
V3_WORDS = f"list_distinct({tokens_sql(nfkc_sql('text'))})"
OVERLAPS = f"WITH s AS (SELECT row_no, split_name, group_id, {V3_WORDS} AS w FROM grouped_examples WHERE text IS NOT NULL AND split_name IS NOT NULL), u AS (SELECT row_no, split_name = 'train' AS tr, len(w) AS n, unnest(w) AS w FROM s), c AS (SELECT a.row_no AS a, b.row_no AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k FROM u a JOIN u b ON a.w = b.w AND a.tr AND NOT b.tr GROUP BY ALL), f AS (SELECT a, b FROM c WHERE k * 10 >= 7 * (na + nb - k))"
GRAMS = f"WITH t AS (SELECT row_no, {tokens_sql('text')} AS t FROM intents_v1 WHERE text IS NOT NULL), p AS (SELECT row_no, t, unnest(range(1, len(t) + 1)) AS i FROM t), g AS (SELECT row_no, k - i + 1 AS n, array_to_string(t[i:k], ' ') AS ngram FROM (SELECT *, unnest(range(i, len(t) + 1)) AS k FROM p))"

WORDS = r"list_filter(list_transform(regexp_split_to_array(lower(text), '[^\p{L}\p{N}'']+'), lambda w: trim(w, '''')), lambda w: w <> '')"
TOKENS = "coalesce(n_tokens, octet_length(encode(text)) + 1)"
SEVEN = "('greeting', 'feeling', 'reason', 'ownership', 'question', 'goal', 'observation')"
KEYED = " UNION ALL ".join(f"SELECT '{t}' AS table_name, lower(trim({k}, ' ')) AS entity_key, split_name FROM {t}" for t, k in (("grouped_examples", "group_id"), ("ood_test_v3", "family_id"), ("contrast_test_v3", "pair_id")))

MIXED = f"WITH t AS (SELECT m.source, target_share, max_repeats, coalesce(sum({TOKENS}), 0) AS k FROM mix_targets m LEFT JOIN documents USING (source) GROUP BY ALL)"
_V3 = tokens_sql(nfkc_sql("text"))
COVERAGE = f"""WITH k AS (SELECT row_no, split_name = 'train' AS tr, {_V3} AS t FROM grouped_examples WHERE text IS NOT NULL AND split_name IS NOT NULL),
 g AS (SELECT row_no, tr, len(t) AS m, least(5, len(t)) AS need, t, unnest(range(1, len(t) + 1)) AS i FROM k), tg AS (SELECT DISTINCT unnest([array_to_string(t[i:i + n - 1], ' ') FOR n IN range(1, 6) IF i + n - 1 <= m]) AS gram FROM g WHERE tr),
 h AS (SELECT row_no, i, need FROM g WHERE NOT tr AND i + need - 1 <= m AND array_to_string(t[i:i + need - 1], ' ') IN (SELECT gram FROM tg)), c AS (SELECT DISTINCT row_no, unnest(range(i, i + need)) AS j FROM h), b AS (SELECT row_no, j, lag(j) OVER (PARTITION BY row_no ORDER BY j) IS DISTINCT FROM j - 1 AS begins FROM c)
 SELECT k.row_no, len(any_value(t))::BIGINT AS n_words, count(j)::BIGINT AS covered, count(*) FILTER (begins)::BIGINT AS spans FROM k LEFT JOIN b USING (row_no) WHERE NOT tr GROUP BY k.row_no"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in vars(m).items() if name[0] == "p" and name[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    counts = f"WITH w AS (SELECT row_no, unnest({WORDS}) AS term FROM intents_v1 WHERE text IS NOT NULL), c AS (SELECT term, count(*)::BIGINT AS occurrences, count(DISTINCT row_no)::BIGINT AS records FROM w GROUP BY term), m AS (SELECT *, CASE WHEN records = 1 THEN 'rare' WHEN records > 0.05::DOUBLE * (SELECT count(text) FROM intents_v1) THEN 'common' END AS mark FROM c)"
    per_row = f"WITH w AS (SELECT row_no, label, unnest({WORDS}) AS term FROM intents_v1 WHERE text IS NOT NULL), c AS (SELECT row_no, label, term, count(*) AS n FROM w GROUP BY ALL), d AS (SELECT term, count(*) AS d FROM c GROUP BY term), t AS (SELECT count(text)::DOUBLE AS total FROM intents_v1)"
    tfn = "n * log2(1 + {average} / {length})"
    score = "(log2(1 + {rate}) + {tfn} * log2((1 + {rate}) / {rate})) / ({tfn} + 1)"
    of_record = score.format(rate="(f / total)", tfn="(" + tfn.format(average="(words / total)", length="l") + ")")
    of_label = score.format(rate="(f / 7)", tfn="(" + tfn.format(average="avg_l", length="l") + ")")
    return {
        "p1_found": f"WITH f AS ({FORMS}) SELECT a.table_name, a.row_no AS row_a, b.row_no AS row_b FROM f a JOIN f b ON a.table_name = b.table_name AND a.form = b.form AND a.row_no < b.row_no AND a.text <> b.text",
        "p1_forms": f"SELECT table_name, row_no, form FROM ({FORMS})",
        "p2_ngrams": f"{GRAMS} SELECT n::INTEGER AS n, ngram, count(*)::BIGINT AS occurrences, count(DISTINCT row_no)::BIGINT AS records FROM g GROUP BY ALL HAVING count(DISTINCT row_no) >= 2",
        "p4_record_scores": f"{per_row}, l AS (SELECT row_no, sum(n) AS l FROM c GROUP BY row_no), ff AS (SELECT term, sum(n) AS f FROM c GROUP BY term), ww AS (SELECT sum(n) AS words FROM c) SELECT row_no, term, n::BIGINT AS n, d::BIGINT AS d, round({of_record}, 6) AS score FROM c JOIN d USING (term) JOIN l USING (row_no) JOIN ff USING (term), t, ww",
        "p4_label_scores": f"{per_row}, k AS (SELECT label, term, count(*)::BIGINT AS dl, sum(n) AS n FROM c WHERE label IN {SEVEN} GROUP BY ALL), l AS (SELECT label, sum(n) AS l FROM k GROUP BY label), av AS (SELECT avg(l) AS avg_l FROM l), a AS (SELECT term, sum(dl)::BIGINT AS d_all, sum(n) AS f FROM k GROUP BY term) SELECT label, term, n::BIGINT AS n, dl AS d_label, d_all, round({of_label}, 6) AS score FROM k JOIN l USING (label) JOIN a USING (term), av",
        "p6_found": f"{OVERLAPS} SELECT least(a, b) AS row_a, greatest(a, b) AS row_b FROM f",
        "p6_report": f"{OVERLAPS} SELECT split_name, lower(trim(group_id, ' ')) AS group_id, count(DISTINCT row_no)::BIGINT AS n_rows, count(*)::BIGINT AS links FROM f JOIN s ON s.row_no = f.b GROUP BY ALL",
        "p2_found": f"{counts} SELECT term, mark FROM m WHERE mark IS NOT NULL",
        "p2_counts": f"{counts} SELECT term, occurrences, records, mark FROM m",
        "p3_found": f"SELECT table_name, entity_key FROM ({KEYED}) WHERE entity_key IS NOT NULL GROUP BY ALL HAVING count(DISTINCT split_name) > 1",
        "p4_found": f"{per_row}, l AS (SELECT label, term, count(*) AS dl FROM c WHERE label IN {SEVEN} GROUP BY ALL) SELECT 'record' AS scope, row_no::VARCHAR AS unit_key, term FROM c JOIN d USING (term), t WHERE n * ln(total / d) >= 2.1::DOUBLE * ln(total) UNION ALL SELECT 'label', label, term FROM l JOIN (SELECT term, sum(dl) AS da FROM l GROUP BY term) USING (term) WHERE dl >= 4 AND dl * 10 >= da * 9",
        "p7_found": f"SELECT container_kind, doc_id FROM documents JOIN pack_specs ON {TOKENS} > capacity_tokens",
        "p3_check": f"SELECT table_name, count(*)::BIGINT AS n_rows, 0::BIGINT AS unassigned, 0::BIGINT AS parted, true AS shares_met FROM ({KEYED}) GROUP BY table_name",
        "p6_coverage": COVERAGE,
        "p7_check": f"SELECT container_kind, count(*)::BIGINT AS n_docs, sum({TOKENS})::BIGINT AS n_tokens, count(*) FILTER ({TOKENS} > capacity_tokens)::BIGINT AS cut_docs, 0::BIGINT AS misplaced, 0::BIGINT AS over_full FROM documents, pack_specs WHERE {TOKENS} IS NOT NULL GROUP BY container_kind",
        "p8_check": f"{MIXED}, s AS (SELECT *, k * max_repeats < target_share * (SELECT sum(k) FROM t) AS short FROM t) SELECT source, k::BIGINT AS source_tokens, short, CASE WHEN short THEN (k * max_repeats)::BIGINT END AS short_tokens, true AS within_repeats, true AS within_share FROM s",
        "p9_check": f"SELECT doc_id, length(regexp_replace(text, '{WS}', '', 'g'))::BIGINT AS held_chars, (length(text) - length(regexp_replace(text, '^{WS}', '')))::BIGINT AS first_start, length(regexp_replace(text, '{WS}$', ''))::BIGINT AS last_end, 0::BIGINT AS loose_ends, 0 AS crossed FROM documents WHERE length(regexp_replace(text, '{WS}', '', 'g')) > 0",
        "p8_found": f"{MIXED} SELECT source FROM t WHERE k * max_repeats < target_share * (SELECT sum(k) FROM t)",
    }
