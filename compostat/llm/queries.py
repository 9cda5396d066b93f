"""The registered queries: each operator with production parameters over its whole
table, and the columns of its contract."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, dialogues, divergence, langid, licences, linededup, sharding, simhash, substrings, tiff, toxicity, warc
from .shared import files_for


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache
def ranks(name: str = "byte_bpe_50k.tiktoken") -> bytes:
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_bytes()


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def fold(id_col: str, folds: int) -> Column:
    """CRC-32 of the id as text, modulo ``folds``; null ids are in fold 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds, F.lit(0))


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # Digests are small: tasks take several partitions each, so few files are written.
    return bpe.encode_documents(docs, ranks(), pattern(), with_ids=False).coalesce(files_for(docs))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op3_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.documents_to_shards(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").filter(fold("doc_id", 5) != 0)
    model = toxicity.fit(docs.filter(fold("doc_id", 5) != 0), labels)
    held = fold("doc_id", 5) == 0
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def language_model(docs: DataFrame) -> langid.LanguageModel:
    return langid.fit(docs.filter(fold("doc_id", 4) != 2), key=F.col("doc_id"))


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = linededup.clean(docs)
    digests = done.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2("__kept", 256).alias("kept_sha256"))
    # Rows without texts are small: tasks of the last join take several partitions each.
    return digests.coalesce(linededup.files_for(docs))


def op8_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.text_media(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, language_model(docs))
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op11_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogues.repair(table(spark, sf_dir, "conversations"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substrings.clean(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("doc_id", F.col("__n_words").alias("n_words"), F.col("__n_removed").alias("n_removed"), F.sha2("__kept", 256).alias("kept_sha256"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_warc": op2_warc,
    "op3_resharding": op3_resharding,
    "op4_simhash": op4_simhash,
    "op5_toxicity": op5_toxicity,
    "op6_licence_scan": op6_licence_scan,
    "op7_line_dedup": op7_line_dedup,
    "op8_tiff": op8_tiff,
    "op9_decontamination": op9_decontamination,
    "op10_language": op10_language,
    "op11_dialogue_repair": op11_dialogue_repair,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_divergence": op13_divergence,
}

ORACLES: dict[str, str] = {
    "op6_licence_scan": licences.oracle_sql(),
    # The line rules of op7, with a window over all documents in place of runs.
    "op7_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, pos, line, translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
owners AS (SELECT k, min(doc_id) AS owner FROM lines WHERE length(k) >= 10 GROUP BY k),
marked AS (SELECT l.doc_id, l.pos, l.line, (length(l.k) >= 10 AND o.owner < l.doc_id) IS TRUE AS gone
           FROM lines l LEFT JOIN owners o ON l.k = o.k)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    # Without revisit threshold; SHA-1 in base32 is put together from 5-bit groups.
    "op2_warc": r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, url, html, octet_length(encode(html)) AS n,
        list_aggregate(list_transform(string_split(regexp_replace(sha1(html), '(.)', '\1,', 'g'), ',')[1:40],
          lambda x: right('000' || CAST(bin(CAST('0x' || x AS INTEGER)) AS VARCHAR), 4)), 'string_agg', '') AS bits FROM p),
d AS (SELECT *, list_aggregate(list_transform(range(0, 32),
        lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST('0b' || substr(bits, CAST(1 + 5 * i AS BIGINT), 5) AS INTEGER), 1)), 'string_agg', '') AS digest FROM h),
f AS (SELECT html AS fh, min(page_id) AS first FROM d GROUP BY html)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to,
       url AS target_uri, TRUE AS digest_ok
FROM d JOIN f ON d.html = f.fh""",
    # Windows as texts, joined whole; positions of a hit are spread and counted once.
    "op9_decontamination": r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (SELECT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS t FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM (SELECT *, least(10, len(w)) AS n FROM iw WHERE len(w) > 0))),
cand AS (SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS t FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM dw, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n)),
hits AS (SELECT doc_id, p, c.n, item_id FROM cand c JOIN wins USING (n, t)),
pos AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)""",
    # Every window as a text, joined with its owner.
    "op12_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
wins AS (SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d WHERE len(w) >= 13)),
owners AS (SELECT t, min(doc_id) AS owner FROM wins GROUP BY t),
gone AS (SELECT DISTINCT doc_id, q FROM (SELECT doc_id, unnest(range(p, p + 13)) AS q FROM wins JOIN owners USING (t) WHERE owner < doc_id)),
words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS q FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY q) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, q) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    # Every share of every kept term, whole; no blocks.
    "op13_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
occ AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS c FROM occ GROUP BY 1, 2 HAVING count(DISTINCT r) >= 30),
tot AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM d),
cnt AS (SELECT o.lang, source, o.term, count(*) AS c FROM occ o JOIN kept k ON o.lang = k.lang AND o.term = k.term GROUP BY 1, 2, 3),
gn AS (SELECT lang, source, sum(c) AS n FROM cnt GROUP BY 1, 2),
dense AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + (1000000000 * (coalesce(c.c, 0) + 5)::HUGEINT) // (coalesce(gn.n, 0) + 5 * t.v) AS p, 1 + (1000000000 * (k.c + 5)::HUGEINT) // (t.n + 5 * t.v) AS q
  FROM grp g JOIN kept k ON g.lang = k.lang JOIN tot t ON t.lang = g.lang LEFT JOIN gn ON gn.lang = g.lang AND gn.source = g.source
       LEFT JOIN cnt c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
dist AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(x.value, 0) AS BIGINT) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN dist x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST(p - q AS BIGINT) AS value FROM dense WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= 50""",
}
