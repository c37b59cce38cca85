"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import (
    alignment, decontamination, fingerprints, lines, mixing, near_duplicates, periodic, quality, repeats, token_counts,
    tokens, toxicity, url_lists,
)

TOKENIZER = "byte_bpe_50k.json"
VOCABULARY = "piece_bpe_32k.model"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """Documents without the strings of 200 bytes that occur more than once."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return repeats.without_repeats(docs, length=200, with_bytes=False).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256"
    )


def op2_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with the words that the mix takes of each."""
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_size") * F.col("_copies")).alias("taken"),
    )


OP2_SQL = """
WITH sized AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
         md5(concat_ws(' ', CAST(doc_id AS VARCHAR), text)) AS digest
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE row_number() OVER (ORDER BY source NULLS LAST) % 3
              WHEN 1 THEN 3.0::DOUBLE WHEN 2 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight
  FROM sized GROUP BY source),
rates AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS level,
         coalesce(sum(2.0::DOUBLE * source_size) OVER lower, 0) AS capped,
         sum(weight) OVER () - coalesce(sum(weight) OVER lower, 0) AS weights,
         1.5::DOUBLE * sum(source_size) OVER () AS budget
  FROM sources
  WINDOW lower AS (ORDER BY 2.0::DOUBLE * source_size / weight
                   RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP)),
rate AS (
  SELECT arg_min((budget - capped) / weights, level) FILTER ((budget - capped) / weights <= level) AS rate
  FROM rates),
targets AS (
  SELECT source, source_size, least(cap, rate * weight) AS target FROM rates, rate),
plans AS (
  SELECT *, least(floor(target / greatest(source_size, 1)), 1) AS whole FROM targets),
places AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS budget,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY substr(d.digest, 1, 15)
                           RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS until,
         sum(d.size) OVER (PARTITION BY d.source, substr(d.digest, 1, 15)) AS own
  FROM sized d JOIN plans p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (whole + CASE WHEN 2 * until - own <= 2 * budget THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM places
"""


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity scores, learned from the labels that are not held out."""
    labels = table(spark, folder, "labels").select("doc_id", "toxic")
    return toxicity.toxicity(table(spark, folder, "documents"), labels)


def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality scores from weak labels."""
    found = quality.quality(table(spark, folder, "documents"))
    return found.select("doc_id", "votes", "weak_label", "score", (F.col("score") >= 0.5).alias("kept"))


def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of each document under a unigram vocabulary."""
    return token_counts.token_counts(table(spark, folder, "documents"), tokenizer_path(VOCABULARY))


def op6_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Each capture against the list entries of the day it was fetched.

    The pages have neither dates nor a list, so both are derived from them: a
    page's number gives its day, and each page gives a dated entry for its host,
    its domain or its first path.
    """
    pages = table(spark, folder, "pages").select("page_id", "url")
    start = F.lit("2024-01-01").cast("date")
    captures = pages.select("page_id", "url", F.date_add(start, F.pmod(F.col("page_id") * 37, F.lit(365)).cast("int")).alias("fetched"))
    name, number = url_lists.host(F.col("url")), F.col("page_id")
    pattern = (
        F.when(name == "", None)
        .when(F.pmod(number, F.lit(4)) == 0, F.regexp_extract(name, r"([^.]+\.[^.]+)$", 1))
        .when(F.pmod(number, F.lit(4)) == 1, F.concat_ws("/", name, F.get(url_lists.segments(F.col("url")), F.lit(0))))
        .otherwise(name)
    )
    rules = F.array(F.lit(url_lists.BLOCK), F.lit(url_lists.ALLOW), F.lit(url_lists.END))
    entries = pages.select(
        number.alias("entry_id"), F.nullif(pattern, F.lit("")).alias("pattern"),
        F.get(rules, F.pmod(F.floor(number / 4), F.lit(3)).cast("int")).alias("rule"),
        F.date_add(start, F.pmod(number * 53, F.lit(360)).cast("int")).alias("day"),
    )
    judged = url_lists.judge(captures, entries)
    return judged.withColumn("blocked", F.coalesce(F.col("rule") == url_lists.BLOCK, F.lit(False)))


OP6_SQL = """
WITH parsed AS (
  SELECT page_id, url, DATE '2024-01-01' + CAST(page_id * 37 % 365 AS INTEGER) AS fetched,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)) AS host,
         list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)', 1), '/'),
                     lambda s: s <> '') AS parts
  FROM pages),
entries AS (
  SELECT page_id AS entry_id, ['block', 'allow', 'end'][(page_id // 4) % 3 + 1] AS rule,
         DATE '2024-01-01' + CAST(page_id * 53 % 360 AS INTEGER) AS day,
         nullif(CASE WHEN host = '' THEN NULL
              WHEN page_id % 4 = 0 THEN regexp_extract(host, '([^.]+\\.[^.]+)$', 1)
              WHEN page_id % 4 = 1 THEN concat_ws('/', host, parts[1]) ELSE host END, '') AS pattern
  FROM parsed),
daily AS (
  SELECT pattern, day, arg_max(rule, entry_id) AS rule FROM entries WHERE pattern IS NOT NULL GROUP BY ALL),
held AS (
  SELECT pattern, rule, day AS valid_from, lead(day) OVER (PARTITION BY pattern ORDER BY day) AS valid_to FROM daily),
captures AS (
  SELECT page_id, url, fetched, host, parts, string_split(host, '.') AS labels FROM parsed),
keys AS (
  SELECT page_id, fetched, unnest(list_concat(
           list_transform(range(1, greatest(len(labels) - 1, 1) + 1), lambda i: array_to_string(labels[i:], '.')),
           list_transform(range(1, len(parts) + 1), lambda i: host || '/' || array_to_string(parts[1:i], '/')))) AS pattern
  FROM captures WHERE host <> ''),
found AS (
  SELECT k.page_id, h.* FROM keys k JOIN held h ON k.pattern = h.pattern AND h.rule <> 'end'
   AND h.valid_from <= k.fetched AND (h.valid_to IS NULL OR k.fetched < h.valid_to)),
best AS (SELECT page_id, arg_max(found, len(pattern)) AS entry FROM found GROUP BY page_id)
SELECT c.page_id, c.url, c.fetched, entry.pattern AS pattern, entry.rule AS rule, entry.valid_from AS valid_from,
       entry.valid_to AS valid_to, coalesce(entry.rule = 'block', false) AS blocked
FROM captures c LEFT JOIN best USING (page_id)
"""


def op7_token_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids written as directly addressable codes and read back."""
    shards = tokens.write_ids(table(spark, folder, "documents").select("doc_id", "text"), tokenizer_path())
    return tokens.read_ids(shards)


def op8_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of documents and of their edited texts, and how alike they are."""
    rows = fingerprints.texts(table(spark, folder, "documents"))
    pairs = fingerprints.with_next(rows, "doc_id", ["fingerprint", "text"], fingerprints.fingerprints)
    length = F.char_length("text")
    changed = F.floor(length / 3).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), length - changed), F.substring("next_text", F.lit(1), changed)
    )
    done = pairs.withColumn("edited", edited).withColumn("edited_fingerprint", fingerprints.fingerprint("edited"))
    return done.select(
        "doc_id",
        length.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        fingerprints.likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        fingerprints.likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )


def op9_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents whose three-word shingles are 85 % alike."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = near_duplicates.near_duplicates(docs, words=3, percent=85)
    return found.select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )


OP9_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
         ELSE list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' ')) END) AS shingle
  FROM words WHERE len(words) > 0),
sizes AS (SELECT doc_id, count(*) AS size FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * n >= 85 * (x.size + y.size - n)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT r.a AS doc_id, coalesce(any_value(s.size), 0) AS n_shingles, min(r.b) AS component_id,
       r.a = min(r.b) AS kept
FROM reach r LEFT JOIN sizes s ON s.doc_id = r.a GROUP BY r.a
"""


def op10_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Words of documents inside occurrences of benchmark windows."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontamination.report(docs, table(spark, folder, "benchmark"))
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP10_SQL = """
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS words
  FROM documents),
items AS (
  SELECT item_id, list_filter(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS words
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(words), 10) AS size,
         unnest(list_transform(range(1, greatest(len(words) - 10, 0) + 2),
                               lambda i: array_to_string(words[i:i + 9], ' '))) AS phrase
  FROM items WHERE len(words) > 0),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT doc_id, size, unnest(range(1, len(words) - size + 2)) AS place, words
  FROM words, sizes WHERE len(words) >= size),
phrases AS (SELECT doc_id, size, place, array_to_string(words[place:place + size - 1], ' ') AS phrase FROM places),
found AS (SELECT p.doc_id, p.size, p.place, w.item_id FROM phrases p JOIN windows w USING (size, phrase)),
hit AS (
  SELECT doc_id, count(DISTINCT word) AS n_hit
  FROM (SELECT doc_id, unnest(range(place, place + size)) AS word FROM found) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
         string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names
  FROM found GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def op11_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Documents without the lines that three documents or more share."""
    found = lines.report(table(spark, folder, "documents").select("doc_id", "text"), least_chars=20, least_docs=3)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP11_SQL = """
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
placed AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM split),
keyed AS (
  SELECT doc_id, line, place,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM placed),
common AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (
  SELECT k.doc_id, k.line, k.place, coalesce(k.doc_id <> c.last, false) AS lost
  FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN lost THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT lost), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Periodic runs of words, some planted."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = periodic.periodic_runs(periodic.planted(docs))
    # Quotients of numbers below 2**26 are equal only if the fractions are.
    by_exponent = F.transform("runs", lambda r: F.struct(
        (r["length"] / r["period"]).alias("exponent"), (-r["start"]).alias("start"), (-r["period"]).alias("period"),
        r["length"].alias("length"),
    ))
    named = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    # The best run is taken after the projection, so that it is found once.
    best = found.select("*", F.array_max(by_exponent).alias("best"))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("(1000 * best.length) div (-best.period)").alias("exponent_milli"),
        F.sha2(F.array_join(named, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of two tokenizers that cover the same bytes."""
    found = alignment.align(table(spark, folder, "documents"), tokenizer_path(), tokenizer_path(VOCABULARY))
    return found.drop("groups")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_repeats": op1_repeats,
        "op2_mix": op2_mix,
        "op3_toxicity": op3_toxicity,
        "op4_quality": op4_quality,
        "op5_token_counts": op5_token_counts,
        "op6_url_filter": op6_url_filter,
        "op7_token_ids": op7_token_ids,
        "op8_fingerprints": op8_fingerprints,
        "op9_near_duplicates": op9_near_duplicates,
        "op10_decontaminate": op10_decontaminate,
        "op11_line_dedup": op11_line_dedup,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_alignment": op13_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_mix": OP2_SQL, "op6_url_filter": OP6_SQL, "op9_near_duplicates": OP9_SQL, "op10_decontaminate": OP10_SQL,
        "op11_line_dedup": OP11_SQL,
    }
