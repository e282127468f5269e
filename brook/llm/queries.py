"""Queries over the whole tables of a folder, one for each operator, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brook.llm import decontamination, jaccard_join, license_scan, packing, pii, quality_classifier, quality_rules, substring_dedup, toxicity, warc
from brook.llm._shared import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), edit_share=0.2, recall=0.98)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels"), sample=12_000))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_spans(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_classifier.train(docs, table(spark, sf_dir, "labels"), sample=8_000)
    return quality_classifier.score(docs, model)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"), shingle=5, similarity=75).drop("text_hash")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "warc")
    warc.write_archives(warc.plan_records(table(spark, sf_dir, "pages")), path)
    responses = warc.read_archives(spark, path, wanted_headers={"WARC-Type": "response"})
    return warc.verified(responses.unionByName(warc.read_archives(spark, path, payload=False, wanted_headers={"WARC-Type": "revisit"})))


def tokenizer_paths() -> tuple[str, str]:
    """The public byte-level vocabulary, as a tokenizer file and as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), *tokenizer_paths(), capacity=1024, end_id=2, keep_ids=False)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeated_windows(table(spark, sf_dir, "documents"), length=35, keep_text=False)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules.learn_from(docs, table(spark, sf_dir, "labels"), sample=20_000)
    return quality_rules.apply_rules(docs, rules)


# The parts of operators 3, 4 and 10 that SQL can express: what is there before anything is learned or parsed.


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_base(table(spark, sf_dir, "documents"))


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.apply_rules(table(spark, sf_dir, "documents"), quality_rules.DecisionList([]))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_decontamination, op2_toxicity, op3_pii, op4_license_scan, op5_quality_classifier, op6_jaccard_join, op7_warc, op8_packing, op9_substring_dedup, op10_quality_rules, pii_base, license_base, quality_counts)}
WORDS = r"list_filter(string_split_regex(coalesce({}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
FOLDED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP6 = f"""
WITH RECURSIVE words AS MATERIALIZED (SELECT doc_id, {WORDS.format(FOLDED)} AS w FROM documents),
sets AS MATERIALIZED (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words),
one AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
links AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y FROM one a JOIN one b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id, doc_id AS r FROM sets UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON reach.r = links.x)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, CASE WHEN len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY s) END AS class_id
FROM sets JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
"""

BITS = "CAST(CAST(unhex(sha1(html)) AS BIT) AS VARCHAR)"
BASE32 = f"list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_sum(list_transform(range(0, 5), lambda j: CAST(substr({BITS}, CAST(1 + 5 * i + j AS BIGINT), 1) AS BIGINT) * CAST(pow(2, 4 - j) AS BIGINT))) AS BIGINT), 1)), 'string_agg', '')"
OP7 = f"""
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {BASE32} AS payload_digest, CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> largest THEN largest END AS refers_to
FROM (SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS largest FROM pages)
"""

OP9 = f"""
WITH words AS MATERIALIZED (SELECT doc_id, {WORDS.format('text')} AS w FROM documents),
windows AS MATERIALIZED (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM words WHERE len(w) >= 35)),
gone AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM windows WHERE h IN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1)),
each_word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM words),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM each_word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM words LEFT JOIN kept USING (doc_id)
"""

#: Kinds in their order: number, name, pattern, and what a match x must pass.
PART = "0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
DIGITS = "regexp_replace(x, '[^0-9]', '', 'g')"
DIGIT = f"CAST(substr(reverse({DIGITS}), CAST(i + 1 AS BIGINT), 1) AS INTEGER)"
LUHN = f"list_sum(list_transform(range(0, len({DIGITS})), lambda i: CASE WHEN i % 2 = 0 THEN {DIGIT} WHEN {DIGIT} > 4 THEN 2 * {DIGIT} - 9 ELSE 2 * {DIGIT} END)) % 10 = 0"
BASE_KINDS = (
    (0, "email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    (1, "ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", rf"regexp_full_match(x, '({PART}\.){{3}}{PART}')"),
    (2, "card", r"[0-9](?:[\x20-]?[0-9])+", f"CASE WHEN len({DIGITS}) BETWEEN 12 AND 19 THEN {LUHN} ELSE false END"),
    (3, "phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"len({DIGITS}) BETWEEN 9 AND 15"),
)
#: A match starts behind the gaps up to it (of a split by the same pattern) and the matches before it.
PLACED = """list_filter(list_transform(range(1, len(m{0}) + 1), lambda j: {{'s': CAST(list_sum(list_transform(g{0}[1:j], lambda x: len(x))) + coalesce(list_sum(list_transform(m{0}[1:j - 1], lambda x: len(x))), 0) AS BIGINT),
  'k': {0}, 'x': m{0}[j]}}), lambda r: list_transform([r.x], lambda x: {1})[1])"""
PII = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
matches AS MATERIALIZED (SELECT doc_id, {", ".join(f"regexp_extract_all(t, '{p}') AS m{n}, string_split_regex(t, '{p}') AS g{n}" for n, _, p, _ in BASE_KINDS)} FROM texts),
placed AS MATERIALIZED (SELECT doc_id, {", ".join(f"{PLACED.format(n, check)} AS {name}" for n, name, _, check in BASE_KINDS)} FROM matches)
SELECT doc_id, {", ".join(f"CAST(len({name}) AS BIGINT) AS n_{name}" for _, name, _, _ in BASE_KINDS)},
  sha256(array_to_string(list_transform(list_sort({" || ".join(name for _, name, _, _ in BASE_KINDS)}), lambda r: ['email', 'ip', 'card', 'phone'][r.k + 1] || ':' || r.s || ':' || (r.s + len(r.x))), ',')) AS base_sha256
FROM placed
"""

PHRASES = {"apache": ["apache", "license"], "cc-by": ["cc", "by"], "gpl": ["gnu", "general", "public", "license"], "mit": ["mit", "license"]}
AT = "list_filter(range(0, len(w)), lambda i: w[i + 1:i + {}] = {}) AS \"{}\""
LICENSE = f"""
WITH words AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce({FOLDED}, ''), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
places AS MATERIALIZED (SELECT doc_id, w, {", ".join(AT.format(len(p), p, label) for label, p in PHRASES.items())} FROM words),
found AS (SELECT *, {" || ".join(f'"{label}"' for label in PHRASES)} AS p FROM places)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(p) AS BIGINT) AS n_base, CAST(list_min(p) AS BIGINT) AS first_word, CAST(list_max(p) AS BIGINT) AS last_word,
  concat_ws(',', {", ".join(f"""CASE WHEN len("{label}") > 0 THEN '{label}' END""" for label in PHRASES)}) AS base_labels
FROM found
"""

QUALITY = f"""
WITH words AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {WORDS.format('text')} AS w FROM documents),
windows AS MATERIALIZED (SELECT r, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) >= 3)),
again AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest(range(i, i + 3)) AS p FROM windows SEMI JOIN (SELECT r, g FROM windows GROUP BY r, g HAVING count(*) > 1) USING (r, g)) GROUP BY r),
counted AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM words LEFT JOIN again USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
"""

#: The other operators learn, tokenise or parse, which SQL can't express; their tests compare with brute force.
ORACLES: dict[str, str] = {"op6_jaccard_join": OP6, "op7_warc": OP7, "op9_substring_dedup": OP9, "pii_base": PII, "license_base": LICENSE, "quality_counts": QUALITY}
