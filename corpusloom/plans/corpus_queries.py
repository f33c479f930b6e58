"""Queries over features, set similarity, contracts and hash splits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize, tokens, word_ngrams
from ..operators import contracts as C
from ..operators import features as V
from ..operators import partitions as P
from ..operators import similarity as S
from ..operators.layout import spread
from .inputs import LABELLED, PROMPTS, labelled, nfkc_sql, norm_sql, prompts, table, tokens_sql
from .text_queries import ORACLE as TEXT_ORACLE
from .text_queries import SEED, fnv_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


WIDE = V.Vectorizer(max_features=4096, min_df=2)
# Features. The SQL form repeats the chain: terms, frequencies, vocabulary, weights.
TERMS = TEXT_ORACLE["extract_terms"].removesuffix(" SELECT row_no, term, count(*)::BIGINT AS n FROM x GROUP BY ALL") + ", tc AS (SELECT row_no, term, count(*)::BIGINT AS n FROM x GROUP BY ALL), dfs AS (SELECT term, count(*)::BIGINT AS df FROM tc GROUP BY term)"
VOCAB = TERMS + f", top AS (SELECT term, df FROM dfs WHERE df >= 2 ORDER BY df DESC, term LIMIT 4096), voc AS (SELECT (row_number() OVER (ORDER BY df DESC, term) - 1)::INTEGER AS position, term, df, ln((1.0::DOUBLE + (SELECT count(*) FROM ({PROMPTS}))) / (1.0::DOUBLE + df)) + 1.0::DOUBLE AS idf FROM top)"
WEIGHTS = VOCAB + ", wt AS (SELECT row_no, position, (1.0::DOUBLE + ln(n)) * idf AS value FROM tc JOIN voc USING (term))"


@query(f"{TERMS} SELECT term, df FROM dfs")
def document_frequency(s, d):
    return V.document_frequency(V.term_counts(prompts(s, d), "row_no"))


@query(f"{VOCAB} SELECT position, term, df FROM voc")
def vocabulary_topk(s, d):
    return V.fit(prompts(s, d), "row_no", vectorizer=WIDE).select("position", "term", "df")


@query(f"{VOCAB} SELECT term, round(idf, 6) AS idf FROM voc")
def idf(s, d):
    return V.fit(prompts(s, d), "row_no", vectorizer=WIDE).select("term", F.round("idf", 6).alias("idf"))


@query(f"{WEIGHTS} SELECT row_no, position, round(value, 6) AS value FROM wt")
def tfidf_transform(s, d):
    rows = prompts(s, d)
    return V.weights(V.term_counts(rows, "row_no"), V.fit(rows, "row_no", vectorizer=WIDE), "row_no").select("row_no", "position", F.round("value", 6).alias("value"))


@query(f"{WEIGHTS} SELECT row_no, position, round(value / sqrt(sum(value * value) OVER (PARTITION BY row_no)), 6) AS value FROM wt")
def tfidf_l2(s, d):
    rows = prompts(s, d)
    return V.transform(rows, V.fit(rows, "row_no", vectorizer=WIDE), "row_no").select("row_no", F.explode("features").alias("f")).select("row_no", "f.position", F.round("f.value", 6).alias("value"))


# Set similarity over the grouped prompts: their words and word pairs as sets.
NEAR = 0.8


def _feature_sets(s: SparkSession, d: str) -> DataFrame:
    rows = spread(table(s, d, "grouped_examples").select("row_no", "group_id", "label", "text")).where("text IS NOT NULL")
    return rows.select("row_no", "group_id", "label", F.array_distinct(word_ngrams(tokens("text"), 1, 2)).alias("members"))


_SET_TERMS = "SELECT row_no, group_id, label, concat('w1:', unnest(t)) AS term FROM q UNION SELECT row_no, group_id, label, unnest(list_transform(range(1, len(t)), lambda i: concat('w2:', t[i], '_', t[i + 1]))) FROM q"
SETS = f"WITH q AS (SELECT row_no, group_id, label, {tokens_sql('text')} AS t FROM grouped_examples WHERE text IS NOT NULL), f AS ({_SET_TERMS})"
LINKS = ", n AS (SELECT row_no, any_value(group_id) AS g, count(*) AS n FROM {f} GROUP BY row_no), i AS (SELECT a.row_no AS a, b.row_no AS b, count(*) AS k FROM {f} a JOIN {f} b ON a.term = b.term AND a.row_no <> b.row_no GROUP BY ALL), h AS (SELECT a, b FROM i JOIN n x ON x.row_no = a JOIN n y ON y.row_no = b WHERE k >= {t}::DOUBLE * (x.n + y.n - k) - 1e-12 AND coalesce(x.g, concat(chr(30), a)) <> coalesce(y.g, concat(chr(30), b))) SELECT a AS row_no, count(*)::BIGINT AS links FROM h GROUP BY a"


@query(SETS + LINKS.format(f="f", t=NEAR))
def jaccard_self_join(s, d):
    """For every prompt the number of near ones in other families."""
    return S.similar_row_links(_feature_sets(s, d), "row_no", "group_id", "members", NEAR)


RESIDUAL = SETS + ", sh AS (SELECT label, term FROM f WHERE label IS NOT NULL AND group_id IS NOT NULL GROUP BY label, term HAVING count(DISTINCT group_id) >= 3), rs AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM sh WHERE sh.label = f.label AND sh.term = f.term))"


@query(RESIDUAL + " SELECT row_no, term FROM rs")
def residual_features(s, d):
    return S.residual_members(_feature_sets(s, d), "row_no", "label", "group_id", "members").select("row_no", F.explode("members").alias("term"))


@query(RESIDUAL + LINKS.format(f="rs", t=NEAR))
def residual_jaccard_join(s, d):
    return S.similar_row_links(S.residual_members(_feature_sets(s, d), "row_no", "label", "group_id", "members"), "row_no", "group_id", "members", NEAR)


@query(SETS + f", dfq AS (SELECT term, count(*) AS df FROM f GROUP BY term), o AS (SELECT row_no, term, row_number() OVER (PARTITION BY row_no ORDER BY df, term) - 1 AS place, count(*) OVER (PARTITION BY row_no) AS n FROM f JOIN dfq USING (term)) SELECT row_no, term AS member, place::INTEGER AS place, n::INTEGER AS n FROM o WHERE place < n - ceil({NEAR}::DOUBLE * n - 1e-9) + 1")
def prefix_candidates(s, d):
    """The rare features that any near set must meet."""
    return S.prefixes(_feature_sets(s, d), "row_no", "members", NEAR)


# Contracts.
@query("SELECT id, count(*)::BIGINT AS n, min(row_no) AS first_row FROM intents_v1 WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1")
def duplicate_ids(s, d):
    return C.repeated(table(s, d, "intents_v1"), F.col("id"), "row_no", "id")


@query(f"SELECT {norm_sql('text')} AS normal, count(*)::BIGINT AS n, min(row_no) AS first_row FROM ({PROMPTS}) GROUP BY 1 HAVING count(*) > 1")
def duplicate_texts(s, d):
    return C.repeated(prompts(s, d), normalize("text"), "row_no", "normal")


@query("SELECT DISTINCT label FROM intents_v1 WHERE label IS NOT NULL")
def distinct_labels(s, d):
    return table(s, d, "intents_v1").where("label IS NOT NULL").select("label").distinct()


@query("SELECT label, count(*)::BIGINT AS n FROM intents_v1 GROUP BY label")
def class_counts(s, d):
    return table(s, d, "intents_v1").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT group_id, count(DISTINCT label)::BIGINT AS labels FROM grouped_examples WHERE group_id IS NOT NULL GROUP BY group_id HAVING count(DISTINCT label) > 1")
def group_label_conflicts(s, d):
    return C.label_conflicts(table(s, d, "grouped_examples"), "group_id", "label")


@query("SELECT label, count(*)::BIGINT AS n FROM intents_v1 WHERE label IS NOT NULL GROUP BY label HAVING count(*) < 5")
def class_support(s, d):
    return C.class_support(table(s, d, "intents_v1"), "label")


@query("SELECT label, count(DISTINCT group_id)::BIGINT AS groups FROM grouped_examples WHERE label IS NOT NULL AND group_id IS NOT NULL GROUP BY label HAVING count(DISTINCT group_id) NOT BETWEEN 4 AND 20000")
def group_support(s, d):
    return C.group_support(table(s, d, "grouped_examples"), "label", "group_id")


@query("WITH z AS (SELECT family_id, count(*)::BIGINT AS n FROM ood_test_v3 WHERE family_id IS NOT NULL GROUP BY family_id) SELECT * FROM z WHERE n <> (SELECT max(n) FROM z) OR n < 3")
def family_size_contract(s, d):
    return C.family_sizes(table(s, d, "ood_test_v3"), "family_id")


def _owned(by: str, what: str, rule: str, bad: str) -> str:
    return f"SELECT '{rule}' AS rule, {by} AS key, count(DISTINCT {what})::BIGINT AS n FROM k GROUP BY {by} HAVING count(DISTINCT {what}) {bad}"


@query(
    "WITH k AS (SELECT * FROM ood_test_v3 WHERE family_id IS NOT NULL AND domain_group IS NOT NULL AND stratum IS NOT NULL), z AS (SELECT family_id, count(*)::BIGINT AS n FROM k GROUP BY family_id), "
    "st AS (SELECT s.stratum, count(k.stratum)::BIGINT AS r, count(DISTINCT domain_group)::BIGINT AS dm FROM (VALUES ('semantic'), ('capability'), ('noise')) s(stratum) LEFT JOIN k USING (stratum) GROUP BY s.stratum) "
    + " UNION ALL ".join([_owned("family_id", "domain_group", "family-domain", "> 1"), _owned("family_id", "stratum", "family-stratum", "> 1"), _owned("domain_group", "stratum", "domain-stratum", "> 1"), _owned("domain_group", "family_id", "domain-families", "< 2")])
    + " UNION ALL SELECT 'family-size', family_id, n FROM z WHERE n <> (SELECT max(n) FROM z) OR n < 3 UNION ALL SELECT 'stratum-rows', stratum, r FROM st WHERE r = 0 OR r <> (SELECT max(r) FROM st) UNION ALL SELECT 'stratum-domains', stratum, dm FROM st WHERE dm = 0 OR dm <> (SELECT max(dm) FROM st)"
)
def ood_contract(s, d):
    return C.ood_contract(table(s, d, "ood_test_v3"))


@query("SELECT pair_id, count(*)::BIGINT AS members FROM contrast_test_v3 WHERE pair_id IS NOT NULL GROUP BY pair_id HAVING NOT coalesce(count(*) = 2 AND bool_or(variant_ab = 'a') AND bool_or(variant_ab = 'b') AND min(label) <> max(label), false)")
def contrast_contract(s, d):
    return C.contrast_contract(table(s, d, "contrast_test_v3"))


POPULATIONS = {"intents_v1": (["id"], []), "ood_test_v3": (["id"], ["family_id", "domain_group"]), "contrast_test_v3": (["id"], ["pair_id"]), "grouped_examples": (["id"], ["group_id"]), "replayed": (["id"], ["pair_id"])}
# The contrast rows once more under other ids, pairs and layout, so that texts do overlap.
REPLAYED = "SELECT concat('r-', id) AS id, concat('r-', pair_id) AS pair_id, concat('  ', text, ' !') AS text FROM contrast_test_v3"


@query(
    f"WITH replayed AS ({REPLAYED}), u AS ("
    + " UNION ".join(
        f"SELECT '{t}' AS p, kind, key FROM (SELECT 'text' AS kind, nullif(array_to_string({tokens_sql(nfkc_sql('text'))}, ' '), '') AS key FROM {t}" + "".join(f" UNION ALL SELECT 'id', {c} FROM {t}" for c in ids) + "".join(f" UNION ALL SELECT 'group', {c} FROM {t}" for c in groups) + ") WHERE key IS NOT NULL"
        for t, (ids, groups) in POPULATIONS.items()
    )
    + ") SELECT kind, key, count(*)::BIGINT AS populations FROM u GROUP BY ALL HAVING count(*) > 1"
)
def cross_dataset_overlap(s, d):
    replayed = table(s, d, "contrast_test_v3").selectExpr("concat('r-', id) AS id", "concat('r-', pair_id) AS pair_id", "concat('  ', text, ' !') AS text")
    rows = lambda t: replayed if t == "replayed" else table(s, d, t)
    return C.cross_overlap({t: C.corpus_keys(rows(t), ids, groups, profile="v3") for t, (ids, groups) in POPULATIONS.items()})


# Outside rows, and the prompts once more among them under other ids and with more blanks.
OUTSIDE = "SELECT row_no, id, text FROM ood_test_v3 UNION ALL SELECT -1 - row_no, concat('r-', id), concat('  ', text, ' ') FROM intents_v1"


@query(f"SELECT DISTINCT row_no FROM ({OUTSIDE}) WHERE id IN (SELECT id FROM intents_v1 WHERE id IS NOT NULL) OR {norm_sql('text')} IN (SELECT {norm_sql('text')} FROM intents_v1 WHERE text IS NOT NULL)")
def ood_overlap_v1(s, d):
    known = table(s, d, "intents_v1")
    outside = table(s, d, "ood_test_v3").select("row_no", "id", "text").unionByName(known.selectExpr("-1 - row_no AS row_no", "concat('r-', id) AS id", "concat('  ', text, ' ') AS text"))
    ood = outside.select("row_no", "id", normalize("text").alias("normal"))
    by_id = ood.join(known.select("id").distinct(), "id", "left_semi").select("row_no")
    by_text = ood.join(known.select(normalize("text").alias("normal")).distinct(), "normal", "left_semi").select("row_no")
    return by_id.union(by_text).distinct()


# Splits.
HOLDOUT = 0.2
SPLIT = f"WITH h AS (SELECT row_no, label, id, {fnv_sql(f'concat(id, chr(31), label, chr(31), {norm_sql(chr(116) + chr(101) + chr(120) + chr(116))})', SEED)} AS h FROM ({LABELLED})), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, id, row_no) AS k, count(*) OVER (PARTITION BY label) AS n FROM h), sp AS (SELECT row_no, label, CASE WHEN k <= greatest(1, least(round(n * {HOLDOUT}::DOUBLE), n - 1)) THEN 'holdout' ELSE 'train' END AS part FROM r)"


@query(f"{SPLIT} SELECT * FROM sp")
def stratified_split(s, d):
    return P.stratified_split(labelled(s, d), SEED, HOLDOUT)


@query(f"{SPLIT}, st AS (SELECT row_no, label, CASE WHEN label = 'goal' AND part = 'holdout' THEN 'train' ELSE part END AS part FROM sp) SELECT side, label, part, count(*)::BIGINT AS n FROM (SELECT 'left' AS side, * FROM (FROM st EXCEPT ALL FROM sp) UNION ALL SELECT 'right', * FROM (FROM sp EXCEPT ALL FROM st)) GROUP BY ALL")
def split_provenance(s, d):
    """A stored split, with one label's holdout moved to training, against the split rebuilt: the rows in only one of them, counted."""
    split = P.stratified_split(labelled(s, d), SEED, HOLDOUT)
    stored = split.withColumn("part", F.when((F.col("label") == "goal") & (F.col("part") == "holdout"), F.lit("train")).otherwise(F.col("part")))
    return C.mismatch(stored, split).groupBy("side", "label", "part").agg(F.count(F.lit(1)).alias("n"))


_GROUPS = f"WITH g AS (SELECT DISTINCT label, group_id FROM grouped_examples WHERE label IS NOT NULL AND group_id IS NOT NULL), h AS (SELECT *, {fnv_sql('concat(label, chr(31), group_id)', SEED)} AS h FROM g), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, group_id) AS k, count(*) OVER (PARTITION BY label) AS n FROM h), q AS (SELECT *, least(greatest((n + 5) // 10, 1), (n - 1) // 3) AS q FROM r), gs AS (SELECT label, group_id, CASE WHEN k <= q THEN 'id-test' WHEN k <= 2 * q THEN 'calibration' WHEN k <= 3 * q THEN 'development' ELSE 'train' END AS part FROM q)"


@query(f"{_GROUPS} SELECT * FROM gs")
def group_split(s, d):
    return P.group_split(table(s, d, "grouped_examples"), SEED)


@query(
    "WITH k AS (SELECT * FROM grouped_examples WHERE split_name IS NOT NULL), w AS (SELECT label, p FROM (SELECT DISTINCT label FROM k WHERE label IS NOT NULL), (VALUES ('train'), ('development'), ('calibration'), ('id-test')) v(p)) "
    "SELECT 'group-partition' AS rule, group_id AS key FROM k WHERE group_id IS NOT NULL GROUP BY group_id HAVING count(DISTINCT split_name) > 1 UNION ALL SELECT 'group-label', group_id FROM k WHERE group_id IS NOT NULL GROUP BY group_id HAVING count(DISTINCT label) > 1 "
    "UNION ALL SELECT 'repeated-row', row_no::VARCHAR FROM k GROUP BY row_no HAVING count(*) > 1 UNION ALL SELECT DISTINCT 'unknown-partition', split_name FROM k WHERE split_name NOT IN ('train', 'development', 'calibration', 'id-test') "
    "UNION ALL SELECT 'label-missing', concat(label, '/', p) FROM w WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.label = w.label AND k.split_name = w.p)"
)
def split_plan_contract(s, d):
    return P.split_plan_violations(table(s, d, "grouped_examples"))


@query("SELECT split_name, count(*)::BIGINT AS n_rows, count(DISTINCT group_id)::BIGINT AS families, count(DISTINCT label)::BIGINT AS labels FROM grouped_examples GROUP BY split_name")
def population_counts(s, d):
    return table(s, d, "grouped_examples").groupBy("split_name").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("group_id").alias("families"), F.count_distinct("label").alias("labels"))


@query(f"{_GROUPS} SELECT DISTINCT label, group_id, split_name, part AS rebuilt FROM grouped_examples JOIN gs USING (label, group_id) WHERE split_name <> part")
def split_assignment(s, d):
    """Groups whose stored split isn't the one that the split by hash gives them."""
    return P.assignment_violations(table(s, d, "grouped_examples"), SEED)


@query("SELECT stratum, count(*)::BIGINT AS n_rows, count(DISTINCT family_id)::BIGINT AS families, count(DISTINCT domain_group)::BIGINT AS domains FROM ood_test_v3 GROUP BY stratum")
def outside_counts(s, d):
    return table(s, d, "ood_test_v3").groupBy("stratum").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("family_id").alias("families"), F.count_distinct("domain_group").alias("domains"))
