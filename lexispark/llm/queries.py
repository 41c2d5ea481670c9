"""The queries of this subpackage's operators, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, jaccard_join, language, line_dedup, media, packing, secrets, sharding, warc
from .common import Scratch, octets, read_table

#: A pair of rows that the formatting query adds, as its contract says.
PROBE_CONV, PROBE_TEXT = -7, r"\### Assistant: </turn> ok"


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document becomes a page that shows its text and, in a figure, its payload; the payload is found again by parsing the page."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text", F.sha2(octets(F.col("text")), 256).alias("digest"))
    shown = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    pages = docs.select("doc_id", F.concat(F.lit("<article><p>"), shown, F.lit(f'</p><figure><img src="{media.SCHEME}'), "digest", F.lit('"><figcaption>text of the page</figcaption></figure></article>')).alias("html"))
    scratch = Scratch(spark, "media")
    columns = ["n_bytes", *media.FEATURES]
    payloads = scratch.table(media.described(media.store_payloads(docs, scratch)), "described", keep=True)
    found = media.resolve(media.parse_sequences(pages, "doc_id"), payloads, columns)
    return found.select(F.col("id").alias("doc_id"), *columns, "position", "caption")


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.range(2).select(
        F.lit(PROBE_CONV).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE_TEXT).alias("text"),
    )
    rows = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(probe)
    made = chat_format.format_conversations(rows).select("conv_id", "formatted", chat_format.parse_formatted(F.col("formatted")).alias("turns"), chat_format.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss_text"))
    turns_text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return made.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns_text, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = octets(F.col("text"))
    docs = read_table(spark, sf_dir, "documents").select("doc_id", (F.length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    laid = sharding.assign_shards(docs, ["doc_id", "text_crc32", "size"], shards=8, seed=17)
    return laid.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contained_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "item_shingles", "shared_shingles", "containment")


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path(), closing_id=1, capacity=2048)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(read_table(spark, sf_dir, "pages"))
    return warc.read_records(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return jaccard_join.link_components(docs, k=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = language.KernelModel.fit(*language.labelled_sample(docs.where(~held_out).select(F.col("doc_id").alias("key"), "text", "lang")))
    found = language.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.drop_recurring_lines(read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.length("text").cast("long").alias("kept_chars"), F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratios = secrets.train(secrets.sample_tokens(spark))
    found = secrets.scan(read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text"), ratios)
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == secrets.KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, ("assign", "access", "hex")), F.sha2(secrets.joined(F.col("base_spans")), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_media_columns": op1_media_columns,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_sharding": op3_sharding,
    "op4_decontamination": op4_decontamination,
    "op5_packing": op5_packing,
    "op6_warc": op6_warc,
    "op7_language_id": op7_language_id,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_line_dedup": op9_line_dedup,
    "op10_secret_scans": op10_secret_scans,
}

_PROBE_SQL = PROBE_TEXT.replace("'", "''")
ORACLE: dict[str, str] = {
    "op2_chat_formatting": rf"""
        WITH told AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT {PROBE_CONV}, 0, 'user', '{_PROBE_SQL}' UNION ALL SELECT {PROBE_CONV}, 1, 'assistant', '{_PROBE_SQL}'
        ), marked AS (
            SELECT *, length(regexp_replace(text, '(\\*)(### |</turn>|<next/>)', '\\\1\2', 'g')) AS shielded,
                lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before
            FROM told
        )
        SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(shielded + 9 + CASE WHEN before IS NULL OR before <> role THEN length(role) + 6 ELSE 0 END) AS BIGINT) AS formatted_chars
        FROM marked GROUP BY conv_id""",
    "op4_decontamination": """
        WITH told AS (
            SELECT doc_id AS id, FALSE AS item, text FROM documents UNION ALL SELECT item_id, TRUE, text FROM benchmark
        ), words AS (
            SELECT id, item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM told
        ), shingles AS (
            SELECT DISTINCT id, item, w[i : i + 4] AS s FROM (SELECT id, item, w, unnest(range(1, len(w) - 3)) AS i FROM words) AS p
        ), sizes AS (
            SELECT id, count(*) AS n FROM shingles WHERE item GROUP BY id
        )
        SELECT d.id AS doc_id, i.id AS item_id, z.n AS item_shingles, count(*) AS shared_shingles, CAST(count(*) AS DOUBLE) / z.n AS containment
        FROM shingles AS i JOIN shingles AS d ON i.s = d.s JOIN sizes AS z ON z.id = i.id
        WHERE i.item AND NOT d.item GROUP BY d.id, i.id, z.n HAVING 100 * count(*) >= 80 * z.n""",
    "op8_ngram_jaccard_join": """
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
        ), shingles AS (
            SELECT DISTINCT doc_id, w[i : i + 2] AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM words WHERE len(w) > 0) AS p
        ), sizes AS (
            SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
        ), sized AS (
            SELECT doc_id, s, n FROM shingles JOIN sizes USING (doc_id)
        ), links AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM sized AS a JOIN sized AS b ON a.s = b.s AND a.doc_id <> b.doc_id AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
        ), reached AS (
            SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reached AS r JOIN links AS l ON r.b = l.a
        )
        SELECT d.doc_id, coalesce(any_value(z.n), 0) AS n_shingles, min(r.b) AS component_id
        FROM documents AS d JOIN reached AS r ON r.a = d.doc_id LEFT JOIN sizes AS z ON z.doc_id = d.doc_id GROUP BY d.doc_id""",
    "op9_line_dedup": """
        WITH texts AS (
            SELECT coalesce(text, '') AS text, min(doc_id) AS first FROM documents GROUP BY coalesce(text, '')
        ), cut AS (
            SELECT text, first, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM texts
        ), words AS (
            SELECT *, regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM cut
        ), lines AS (
            SELECT text, first, i, w, len(w) AS n, CASE WHEN len(w) < 4 AND length(array_to_string(w, '')) < 24 THEN 8 ELSE 2 END AS least,
                string_split(regexp_replace(array_to_string(w, ' '), '[^ ]*[0-9][^ ]*', '', 'g'), ' ') AS m
            FROM words WHERE len(w) > 0
        ), whole AS (
            SELECT w, count(DISTINCT text) AS texts, arg_min(text, first) AS owner FROM lines GROUP BY w
        ), masked AS (
            SELECT m, count(DISTINCT text) AS texts, arg_min(text, first) AS owner FROM lines WHERE n >= 4 GROUP BY m
        ), members AS (
            SELECT *, count(*) OVER (PARTITION BY len(m), m[1:3]) AS size FROM masked
        ), places AS (
            SELECT m, size, unnest(m) AS token, unnest(range(len(m))) AS place FROM members WHERE size >= 4
        ), fixed AS (
            SELECT *, count(*) OVER (PARTITION BY len(m), m[1:3], place, token) AS have FROM places
        ), template AS (
            SELECT m, len(m) AS n, m[1:3] AS head, list({'place': place, 'token': token} ORDER BY place) AS kept
            FROM fixed WHERE have >= 4 AND have * 100 >= size * 5 GROUP BY m HAVING count(*) * 100 >= len(m) * 75
        ), general AS (
            SELECT t.n, t.head, t.kept, count(DISTINCT text) AS texts, arg_min(text, first) AS owner FROM lines AS l JOIN template AS t ON l.m = t.m WHERE l.n >= 4 GROUP BY t.n, t.head, t.kept
        ), gone AS (
            SELECT l.text, l.i FROM lines AS l JOIN whole AS o ON l.w = o.w WHERE o.texts >= l.least AND o.owner <> l.text
            UNION SELECT l.text, l.i FROM lines AS l JOIN masked AS o ON l.m = o.m WHERE l.n >= 4 AND o.texts >= 4 AND o.owner <> l.text
            UNION SELECT l.text, l.i FROM lines AS l JOIN template AS t ON l.m = t.m JOIN general AS o ON o.n = t.n AND o.head = t.head AND o.kept = t.kept WHERE l.n >= 4 AND o.texts >= 4 AND o.owner <> l.text
        ), kept AS (
            SELECT c.text, count(*) AS n_lines, count(g.i) AS n_dropped, coalesce(string_agg(c.line, chr(10) ORDER BY c.i) FILTER (WHERE g.i IS NULL), '') AS left_over
            FROM cut AS c LEFT JOIN gone AS g ON g.text = c.text AND g.i = c.i GROUP BY c.text
        )
        SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE k.n_lines END AS n_lines, CASE WHEN d.text IS NULL THEN 0 ELSE k.n_dropped END AS n_dropped,
            CASE WHEN d.text IS NOT NULL THEN CAST(length(k.left_over) AS BIGINT) END AS kept_chars, CASE WHEN d.text IS NOT NULL THEN sha256(k.left_over) END AS kept_sha256
        FROM documents AS d JOIN kept AS k ON k.text = coalesce(d.text, '')""",
    "op6_warc": """
        WITH told AS (SELECT page_id, coalesce(html, '') AS html FROM pages), first AS (SELECT html, min(page_id) AS least FROM told GROUP BY html)
        SELECT page_id, CAST(strlen(t.html) AS BIGINT) AS payload_bytes, sha256(t.html) AS payload_digest,
            CASE WHEN strlen(t.html) >= 100 AND page_id <> least THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN strlen(t.html) >= 100 AND page_id <> least THEN least END AS refers_to
        FROM told AS t JOIN first AS f ON t.html = f.html""",
}
