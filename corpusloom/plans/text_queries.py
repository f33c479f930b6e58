"""Queries over the text functions, digests, draws and routing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import text as T
from ..operators import digests
from ..operators import router as R
from .inputs import PROMPTS, UTTERANCES, nfkc_sql, norm_sql, prompts, table, tokens_sql, utterances

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
SEED = 20260722


def _per_prompt(name: str, value: Callable[[Column], Column], sql: str, out: str = "value") -> None:
    QUERIES[name] = lambda s, d: prompts(s, d).select("row_no", value(F.col("text")).alias(out))
    ORACLE[name] = f"SELECT row_no, {sql} AS {out} FROM ({PROMPTS})"


TOK = tokens_sql("text")
_per_prompt("text_normalize", T.normalize, norm_sql("text"))
_per_prompt("tokenize", lambda c: F.array_join(T.tokens(c), "|"), f"array_to_string({TOK}, '|')")
_per_prompt("feature_identity", lambda c: T.feature_identity(T.tokens(c)), f"array_to_string({TOK}, ' ')")
_per_prompt("contains_word", lambda c: F.array_contains(T.tokens(c), "the"), f"list_contains({TOK}, 'the')")
_per_prompt("reflect", lambda c: T.reflect(T.tokens(c)), f"array_to_string(list_transform({TOK}, lambda w: CASE w WHEN 'i' THEN 'you' WHEN 'me' THEN 'you' WHEN 'my' THEN 'your' WHEN 'mine' THEN 'yours' WHEN 'am' THEN 'are' WHEN 'you' THEN 'I' WHEN 'your' THEN 'my' WHEN 'yours' THEN 'mine' WHEN 'are' THEN 'am' ELSE w END), ' ')")
QUERIES["input_boundary"] = lambda s, d: table(s, d, "documents").where("text IS NOT NULL").select("doc_id", (F.length("text") > T.MAX_CHARS).alias("oversize"))
ORACLE["input_boundary"] = "SELECT doc_id, length(text) > 512 AS oversize FROM documents WHERE text IS NOT NULL"


_per_prompt("text_normalize_nfkc", T.normalize_nfkc, norm_sql(nfkc_sql("text")))


def _terms(name: str, value: Callable[[Column], Column], sql: str) -> None:
    QUERIES[name] = lambda s, d: prompts(s, d).select("row_no", F.explode(value(T.tokens("text"))).alias("term")).groupBy("row_no", "term").agg(F.count(F.lit(1)).alias("n"))
    ORACLE[name] = f"WITH p AS (SELECT row_no, {TOK} AS t FROM ({PROMPTS})), q AS (SELECT row_no, t, concat('^', array_to_string(t, ' '), '$') AS c FROM p WHERE len(t) > 0), x AS ({sql}) SELECT row_no, term, count(*)::BIGINT AS n FROM x GROUP BY ALL"


_W = "SELECT row_no, concat('w1:', unnest(t)) AS term FROM q UNION ALL SELECT row_no, unnest(list_transform(range(1, len(t)), lambda i: concat('w2:', t[i], '_', t[i + 1]))) FROM q"
_C = " UNION ALL ".join(f"SELECT row_no, unnest(list_transform(range(1, length(c) - {n} + 2), lambda i: concat('c{n}:', substring(c, i, {n})))) AS term FROM q" for n in (3, 4, 5))
_terms("word_ngrams", lambda t: T.word_ngrams(t, 1, 2), _W)
_terms("char_ngrams", lambda t: F.when(F.size(t) > 0, T.char_ngrams(t, 3, 5)), _C)
_terms("extract_terms", lambda t: T.extract_terms(t), f"{_W} UNION ALL {_C}")


def valid_feature_name(s: SparkSession, d: str) -> DataFrame:
    """Real terms and damaged ones with the verdict on their shape."""
    terms = prompts(s, d).select(F.explode(T.extract_terms(T.tokens("text"))).alias("term")).distinct()
    damaged = terms.select(F.explode(F.array("term", F.substring("term", 2, 99), F.concat("term", F.lit(":")), F.concat(F.lit("w3"), F.substring("term", 3, 99)))).alias("name"))
    return damaged.distinct().select("name", T.valid_feature_name("name").alias("valid"))


QUERIES["valid_feature_name"] = valid_feature_name
_EDGE = r"[\p{L}\p{N}](?:[\p{L}\p{N}'']*[\p{L}\p{N}])?"
ORACLE["valid_feature_name"] = (
    ORACLE["extract_terms"].split(" SELECT row_no, term, count")[0]
    + ", y AS (SELECT DISTINCT term FROM x), z AS (SELECT DISTINCT unnest([term, substring(term, 2, 99), concat(term, ':'), concat('w3', substring(term, 3, 99))]) AS name FROM y) "
    + "SELECT name, (" + " OR ".join([rf"regexp_full_match(name, 'w{n}:{'_'.join([_EDGE] * n)}')" for n in (1, 2, 3)] + [rf"regexp_full_match(name, 'c{n}:[\p{{L}}\p{{N}}''^$ ]{{{n}}}')" for n in (2, 3, 4, 5, 6)])
    + ") AS valid FROM z"
)


def quantize(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "lineitem").select("l_orderkey", "l_linenumber", T.quantize(F.col("l_extendedprice") / F.col("l_quantity") - F.lit(1000.0)).alias("value"))


QUERIES["quantize"] = quantize
ORACLE["quantize"] = "SELECT l_orderkey, l_linenumber, round((l_extendedprice / l_quantity - 1000::DOUBLE) * 1e12::DOUBLE) / 1e12::DOUBLE AS value FROM lineitem"

# Digests.
_BYTES = "list_transform(range(1, octet_length(encode({0})) + 1), lambda i: ('0x' || substring(hex(encode({0})), (2 * i - 1)::INTEGER, 2))::UBIGINT)"


def fnv_sql(value: str, seed: int = 0) -> str:
    start = (0xCBF29CE484222325 ^ seed) & (1 << 64) - 1
    return f"lower(lpad(hex(list_reduce({_BYTES.format(value)}, lambda h, b: (((xor(h, b))::UHUGEINT * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT, {start}::UBIGINT)), 16, '0'))"


_per_prompt("fnv1a64", lambda c: H.fnv1a64(c, SEED), fnv_sql("text", SEED))
_per_prompt("sha256_hex", H.sha256_hex, "sha256(text)")
QUERIES["split_hash"] = lambda s, d: prompts(s, d).where("label IS NOT NULL").select("row_no", H.split_hash(F.col("id"), F.col("label"), T.normalize("text"), SEED).alias("value"))
ORACLE["split_hash"] = f"SELECT row_no, {fnv_sql(f'concat(id, chr(31), label, chr(31), {norm_sql(chr(116) + chr(101) + chr(120) + chr(116))})', SEED)} AS value FROM ({PROMPTS}) WHERE label IS NOT NULL"
QUERIES["group_split_hash"] = lambda s, d: table(s, d, "grouped_examples").where("label IS NOT NULL AND group_id IS NOT NULL").select("label", "group_id").distinct().select("label", "group_id", H.group_split_hash(F.col("label"), F.col("group_id"), SEED).alias("value"))
ORACLE["group_split_hash"] = f"SELECT label, group_id, {fnv_sql('concat(label, chr(31), group_id)', SEED)} AS value FROM (SELECT DISTINCT label, group_id FROM grouped_examples WHERE label IS NOT NULL AND group_id IS NOT NULL)"


def dataset_fingerprint_v1(s: SparkSession, d: str) -> DataFrame:
    """The fingerprint of each contrast pair taken as a corpus of its own."""
    rows = table(s, d, "contrast_test_v3").where("pair_id IS NOT NULL AND label IS NOT NULL AND text IS NOT NULL")
    return digests.grouped_digests(rows, "pair_id", F.concat_ws("\t", "id", "label", T.normalize("text")), digests.fnv1a64, "fingerprint")


QUERIES["dataset_fingerprint_v1"] = dataset_fingerprint_v1
ORACLE["dataset_fingerprint_v1"] = f"WITH r AS (SELECT pair_id, concat(id, chr(9), label, chr(9), {norm_sql('text')}) AS x FROM contrast_test_v3 WHERE pair_id IS NOT NULL AND label IS NOT NULL AND text IS NOT NULL), j AS (SELECT pair_id, string_agg(x, chr(10) ORDER BY x) AS y FROM r GROUP BY pair_id) SELECT pair_id, concat('fnv1a64:', {fnv_sql('y')}) AS fingerprint FROM j"


def dataset_sha256(s: SparkSession, d: str) -> DataFrame:
    """The digest of each family's rows taken as a corpus of its own."""
    rows = table(s, d, "ood_test_v3").where("family_id IS NOT NULL AND text IS NOT NULL")
    line = F.concat_ws("\t", "id", "family_id", F.coalesce("domain_group", F.lit("")), F.coalesce("stratum", F.lit("")), T.feature_identity(T.tokens("text", "v3")))
    return digests.grouped_digests(rows, "family_id", line, digests.sha256, "digest")


QUERIES["dataset_sha256"] = dataset_sha256
ORACLE["dataset_sha256"] = f"WITH r AS (SELECT family_id, concat(id, chr(9), family_id, chr(9), coalesce(domain_group, ''), chr(9), coalesce(stratum, ''), chr(9), array_to_string({tokens_sql(nfkc_sql('text'))}, ' ')) AS x FROM ood_test_v3 WHERE family_id IS NOT NULL AND text IS NOT NULL) SELECT family_id, sha256(string_agg(x, chr(10) ORDER BY x)) AS digest FROM r GROUP BY family_id"

def corpus_digests(s: SparkSession, d: str) -> DataFrame:
    """The digests of the two corpora as a whole, with the lines of ``dataset_fingerprint_v1`` and ``dataset_sha256``; no row is left out."""
    blank = lambda c: F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    contrast, ood = table(s, d, "contrast_test_v3"), table(s, d, "ood_test_v3")
    fnv_line = F.concat_ws("\t", blank("id"), blank("label"), blank(T.normalize("text")))
    sha_line = F.concat_ws("\t", blank("id"), blank("family_id"), blank("domain_group"), blank("stratum"), blank(T.feature_identity(T.tokens("text", "v3"))))
    found = [("contrast_test_v3", digests.corpus_digest(contrast, fnv_line, digests.fnv1a64)), ("ood_test_v3", digests.corpus_digest(ood, sha_line, digests.sha256))]
    return s.createDataFrame(found, "corpus string, digest string")


QUERIES["corpus_digests"] = corpus_digests
_V3TOK = tokens_sql(nfkc_sql("text"))
ORACLE["corpus_digests"] = (
    f"WITH c AS (SELECT concat(coalesce(id, ''), chr(9), coalesce(label, ''), chr(9), coalesce({norm_sql('text')}, '')) AS x FROM contrast_test_v3), o AS (SELECT concat(coalesce(id, ''), chr(9), coalesce(family_id, ''), chr(9), coalesce(domain_group, ''), chr(9), coalesce(stratum, ''), chr(9), coalesce(array_to_string({_V3TOK}, ' '), '')) AS x FROM ood_test_v3), "
    f"y AS (SELECT string_agg(x, chr(10) ORDER BY x) AS y FROM c) SELECT 'contrast_test_v3' AS corpus, concat('fnv1a64:', {fnv_sql('y')}) AS digest FROM y UNION ALL SELECT 'ood_test_v3', sha256(string_agg(x, chr(10) ORDER BY x)) FROM o"
)

QUERIES["splitmix_index"] = lambda s, d: table(s, d, "orders").select("o_orderkey", H.splitmix_index(F.col("o_orderkey"), F.lit(97), SEED).alias("draw"))


def _mod64(x: str) -> str:
    return f"(({x}) % 18446744073709551616::UHUGEINT)::UBIGINT"


ORACLE["splitmix_index"] = (
    f"WITH a AS (SELECT o_orderkey, {_mod64(f'{SEED}::UHUGEINT + (o_orderkey + 1)::UHUGEINT * 11400714819323198485::UHUGEINT')} AS z FROM orders), "
    f"b AS (SELECT o_orderkey, {_mod64('(xor(z, z >> 30))::UHUGEINT * 13787848793156543929::UHUGEINT')} AS z FROM a), "
    f"c AS (SELECT o_orderkey, {_mod64('(xor(z, z >> 27))::UHUGEINT * 10723151780598845931::UHUGEINT')} AS z FROM b) "
    "SELECT o_orderkey, (xor(z, z >> 31) % 97)::BIGINT AS draw FROM c"
)

# Routing.
SAFETY = [p.replace("'", "''") for p in R.SAFETY_PHRASES]


def safety_phrase_match(s: SparkSession, d: str) -> DataFrame:
    """Comments made from order priorities with and without a phrase in them."""
    phrase = F.element_at(F.array(*map(F.lit, [*R.SAFETY_PHRASES, "skill myself"])), (F.pmod("o_orderkey", F.lit(15)) + 1).cast("int"))
    text = F.when(F.pmod("o_orderkey", F.lit(2)) == 0, F.concat("o_orderpriority", F.lit(": "), phrase, F.lit("!"))).otherwise(F.concat(phrase, F.lit("x")))
    return table(s, d, "orders").select("o_orderkey", R.safety_match(T.tokens(text)).alias("hit"))


QUERIES["safety_phrase_match"] = safety_phrase_match
ORACLE["safety_phrase_match"] = (
    f"WITH r AS (SELECT o_orderkey, ['{chr(39).join([chr(39) + ', ' + chr(39)]).join([*SAFETY, 'skill myself'])}'][o_orderkey % 15 + 1] AS p, o_orderpriority FROM orders), "
    "u AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN concat(o_orderpriority, ': ', p, '!') ELSE concat(p, 'x') END AS text FROM r) "
    f"SELECT o_orderkey, ({' OR '.join(f'''contains(concat(' ', array_to_string({TOK}, ' '), ' '), ' {p} ')''' for p in SAFETY)}) AS hit FROM u"
)

_REF = "array_to_string(list_transform({0}, lambda w: CASE w WHEN 'i' THEN 'you' WHEN 'me' THEN 'you' WHEN 'my' THEN 'your' WHEN 'mine' THEN 'yours' WHEN 'am' THEN 'are' WHEN 'you' THEN 'I' WHEN 'your' THEN 'my' WHEN 'yours' THEN 'mine' WHEN 'are' THEN 'am' ELSE w END), ' ')"


def route_sql(source: str, turn: str) -> str:
    q = lambda x: "'" + x.replace("'", "''") + "'"
    safety = " OR ".join(f"contains(concat(' ', array_to_string(w, ' '), ' '), ' {p} ')" for p in SAFETY)
    fragment = f"CASE rule_id WHEN 'feeling-reflection' THEN {_REF.format(tokens_sql('rest'))} WHEN 'because-probe' THEN {_REF.format(tokens_sql('why'))} WHEN 'ownership-reflection' THEN {_REF.format(tokens_sql('own'))} END"
    fixed = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in R.REPLIES.items())
    falls = ", ".join(map(q, R.FALLBACKS))
    return f"""WITH u AS ({source}), n AS (SELECT *, {norm_sql('text')} AS n, {tokens_sql('text')} AS w FROM u),
 r AS (SELECT *, CASE WHEN starts_with(n, 'i feel ') THEN n[8:] WHEN starts_with(n, 'i am ') THEN n[6:] WHEN starts_with(n, 'i''m ') THEN n[5:] END AS rest,
 CASE WHEN starts_with(n, 'i feel ') THEN 'i feel' WHEN starts_with(n, 'i am ') THEN 'i am' WHEN starts_with(n, 'i''m ') THEN 'i''m' END AS prefix,
 CASE WHEN contains(n, ' because ') THEN n[strpos(n, ' because ') + 9:] END AS why, CASE WHEN starts_with(n, 'my ') THEN n[4:] END AS own FROM n),
 s AS (SELECT *, CASE WHEN trim(text) = '' THEN 'empty-input' WHEN length(trim(text)) > 512 THEN 'input-boundary' WHEN {safety} THEN 'safety-boundary' WHEN list_contains(w, 'hello') OR list_contains(w, 'hi') OR n = 'hey' THEN 'greeting'
 WHEN rest IS NOT NULL THEN 'feeling-reflection' WHEN why IS NOT NULL THEN 'because-probe' WHEN own IS NOT NULL THEN 'ownership-reflection' WHEN ends_with(n, '?') THEN 'question-return' ELSE 'fallback' END AS rule_id FROM r),
 f AS (SELECT *, {fragment} AS fragment FROM s)
 SELECT event_id, {turn} rule_id, fragment, CASE rule_id WHEN 'safety-boundary' THEN 'matched safety phrase' WHEN 'greeting' THEN 'hello' WHEN 'feeling-reflection' THEN prefix WHEN 'because-probe' THEN 'because' WHEN 'ownership-reflection' THEN 'my' WHEN 'question-return' THEN 'question' END AS keyword,
 CASE rule_id {fixed} WHEN 'feeling-reflection' THEN concat('What makes you feel ', fragment, '?') WHEN 'because-probe' THEN concat('What makes ', fragment, ' an important reason for you?') WHEN 'ownership-reflection' THEN concat('How does your ', fragment, ' affect you?') ELSE [{falls}][(turn - 1) % 4 + 1] END AS reply FROM f"""


QUERIES["rule_route"] = lambda s, d: R.rule_route(utterances(s, d)).select("event_id", "rule_id", "fragment", "keyword", "reply")
ORACLE["rule_route"] = route_sql(f"SELECT *, 1 AS turn FROM ({UTTERANCES})", "")
QUERIES["rule_route_session"] = lambda s, d: R.rule_route_session(utterances(s, d), "user_id", ["ts", "event_id"]).select("event_id", F.col("turn").cast("bigint").alias("turn"), "rule_id", "fragment", "keyword", "reply")
ORACLE["rule_route_session"] = route_sql(f"SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn FROM ({UTTERANCES})", "turn,")
