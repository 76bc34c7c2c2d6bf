"""The registered queries of the text operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, fuzzy_hash, html_extract, minhash, mixing, quality, secrets, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's toxicity, by a model of the labelled rows that aren't held out.

    Null, empty and blank texts get the model's prior; long ones are scored whole; repeated rows score alike, ties don't
    arise; no documents give no rows, and no labels the score 0. Columns besides doc_id, text and the labels' doc_id and toxic play no part.
    """
    return toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's number of shingles and its group of near copies.

    Null and empty texts have no shingles and are groups of their own; long texts count whole; links at exactly 75 % hold;
    repeated ids share a decision; no documents give no rows. Columns besides doc_id and text play no part.
    """
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's record, written to an archive and read back.

    Null html is an empty payload, equal to other empty ones; long pages are written whole; of equal payloads the largest
    page_id is the response, and so are all rows repeated with it; no pages give no rows. Columns besides page_id, url and html play no part.
    """
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op4_fuzzy_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and how alike they and the next document's are.

    Null texts count as empty; long ones are read whole; equal ids follow one another by a hash of the text; a single
    document is its own next one; no documents give no rows. Columns besides doc_id and text play no part.
    """
    return fuzzy_hash.compare_edited(_table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document encoded and decoded.

    Null and empty texts have no tokens; long ones are encoded whole; repeated rows have equal results; of merges that tie,
    the leftmost comes first; no documents give no rows. Columns besides doc_id and text play no part.
    """
    return bpe.encode_table(_table(spark, sf_dir, "documents"), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's main text.

    Null and empty html give an empty text; long and deep pages are read whole; repeated rows have equal texts; ties for a
    host's reference page go by page_id; no pages give no rows. Columns besides page_id, url and html play no part.
    """
    return html_extract.extract_text(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's weak label, score and decision.

    Null and empty texts have bad votes alone; long ones count whole; repeated rows score alike; a score of exactly 0.5 is
    kept; no documents give no rows. Columns besides doc_id and text play no part.
    """
    return quality.score_quality(_table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's group of equal texts; the largest doc_id stays.

    Null texts equal empty ones; long ones are compared whole; rows repeated with the doc_id that stays are all kept; no
    documents give no rows. Columns besides doc_id and text play no part.
    """
    return exact_dedup.exact_plan(_table(spark, sf_dir, "documents"), keep="largest")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's words and how many of them the mix takes.

    Null and empty texts have size 0 and are never taken; long ones count whole; a null source comes last; repeated ids are
    taken alike; ties of finish time go by source, place and doc_id; no documents give no rows. Columns besides doc_id, text and source play no part.
    """
    return mixing.mix_plan(_table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's secrets.

    Null and empty texts have none; long ones are scanned whole; spans that start together go by kind; repeated rows have
    equal results; no documents give no rows. Columns besides doc_id and text play no part.
    """
    return secrets.scan(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_warc": op3_warc,
    "op4_fuzzy_hash": op4_fuzzy_hash,
    "op5_bpe": op5_bpe,
    "op6_html_text": op6_html_text,
    "op7_quality": op7_quality,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_mix_sources": op9_mix_sources,
    "op10_secret_scan": op10_secret_scan,
}

ORACLE_SQL: dict[str, str] = {
    "op2_minhash_near_dedup": r"""
        WITH RECURSIVE worded AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
          FROM documents),
        sets AS (
          SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                 ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM worded),
        held AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
        shared AS (SELECT doc_id, n, dense_rank() OVER (ORDER BY shingle) AS k FROM held QUALIFY count(*) OVER (PARTITION BY shingle) > 1),
        near AS (
          SELECT a.doc_id AS a, b.doc_id AS b FROM shared a JOIN shared b ON a.k = b.k AND a.doc_id < b.doc_id
          GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
        links AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
        reached AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a)
        SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
        FROM sets JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a) USING (doc_id)
    """,
    "op3_warc": """
        WITH hashed AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
        named AS (SELECT *, max(page_id) OVER (PARTITION BY payload) AS first FROM hashed)
        SELECT page_id, octet_length(encode(payload))::BIGINT AS payload_bytes,
               array_to_string(list_transform(range(32), lambda j:
                 substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, (1 + 5 * (j // 4))::BIGINT, 5))::BIGINT >> (15 - 5 * (j % 4))) & 31) + 1, 1)), '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM named
    """,
    "op8_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "op9_mix_sources": r"""
        WITH sized AS (
          SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                 ('0x' || substr(md5('mix' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS place
          FROM documents),
        ranked AS (
          SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank
          FROM sized GROUP BY source),
        caps AS (
          SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap,
                 (SELECT sum(source_size) FROM ranked)::BIGINT AS total FROM ranked),
        levels AS (
          SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
                 / (sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM caps),
        shares AS (
          SELECT *, weight * (SELECT min(level) FROM levels WHERE cap >= level * weight
                              AND cap / weight = (SELECT min(cap / weight) FROM levels WHERE cap >= level * weight)) AS share FROM levels),
        targets AS (SELECT *, CASE WHEN cap <= share THEN cap::DOUBLE ELSE share END AS target FROM shares),
        queued AS (
          SELECT s.*, rank, source_size, target, total, sum(size) OVER (PARTITION BY rank ORDER BY place, doc_id) AS through
          FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
        items AS (
          SELECT *, (r * source_size + through)::DOUBLE / target AS finish FROM queued, (VALUES (0), (1), (2)) AS rounds(r) WHERE size > 0),
        run AS (
          SELECT *, sum(size) OVER (ORDER BY finish, rank, place, doc_id, r ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS so_far
          FROM items WHERE finish <= 2),
        taken AS (SELECT doc_id, sum(size)::BIGINT AS taken FROM run WHERE so_far <= total GROUP BY doc_id)
        SELECT q.doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM queued q LEFT JOIN taken USING (doc_id)
    """,
}
