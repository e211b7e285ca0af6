"""The registered queries of the training-data operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.llm import alignment, chat, exact_dedup, html_text, importance, licenses, mixing, near_dedup, packing, quality, rules, secrets, warc
from loreweave.llm.common import scratch_path, table


def op1_warc_seekable(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.read_archive(spark, path, payloads=False).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    sure = F.filter("licences", lambda x: x["confirmed"])
    return found.select(
        "doc_id",
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",").alias("families"),
        F.size("licences").cast("long").alias("n_paragraphs"),
        F.size(sure).cast("long").alias("n_confirmed"),
        F.round(F.array_max(F.transform("licences", lambda x: x["probability"])), 6).alias("top_probability"),
        F.array_join(F.transform("licences", lambda x: F.concat_ws(":", x["place"].cast("string"), x["family"], x["confirmed"].cast("string"))), ",").alias("paragraphs"),
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).drop("row")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(table(spark, sf_dir, "documents"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_components(table(spark, sf_dir, "documents"), near_dedup.Near(words=4)).drop("row", "first")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, q = table(spark, sf_dir, "documents").select("doc_id", "text"), quality.Quality()
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels"), q))
    return scored.select("doc_id", (quality.fold(F.col("doc_id"), q.folds) == 0).alias("held_out"), "score", (F.col("score") >= q.threshold).cast("int").alias("predicted"))


def op9_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = secrets.BASE + secrets.EXTRA
    found = secrets.scan(table(spark, sf_dir, "documents"), used)
    base = F.filter("spans", lambda s: s["rank"] < len(secrets.BASE))
    of = lambda k: F.size(F.filter("spans", lambda s: s["rank"] == k)).cast("long")
    counts = [of(k).alias(f"n_{r.kind}") for k, r in enumerate(secrets.BASE)]
    return found.select("doc_id", *counts, F.sha2(secrets.written(base, used), 256).alias("base_sha256"), secrets.written(F.col("spans"), used).alias("spans"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = rules.statistics(table(spark, sf_dir, "documents"))
    learned = rules.fit(stats, table(spark, sf_dir, "labels"))
    return rules.judged(stats, learned).select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_align_tokenizers(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = alignment.Pair(tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    return alignment.align(table(spark, sf_dir, "documents"), pair)


def op12_format_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = chat.Chat(tokenizer_path("byte_bpe_50k.json"))
    rows = chat.with_control_strings(spark, table(spark, sf_dir, "conversations"))
    return chat.read_back(chat.formatted(rows, own), own).drop("n_tokens", "loss_tokens")


def op13_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_warc_seekable, op2_quality_classifier, op3_license_scan, op4_exact_dedup, op5_mix_sources, op6_secret_scan, op7_quality_rules, op8_near_dedup, op9_html_main_text, op10_pack_sequences, op11_align_tokenizers, op12_format_chats, op13_importance_resample)}

ORACLES = {
    "op1_warc_seekable": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS last FROM p)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
               CASE WHEN n >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id <> last THEN last END AS refers_to
        FROM m""",
    "op4_exact_dedup": r"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars,
                          sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS digest FROM documents),
        k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY digest ORDER BY chars DESC, doc_id) AS keep_id,
                     count(*) OVER (PARTITION BY digest) AS n FROM d)
        SELECT doc_id, keep_id, n AS group_size, doc_id = keep_id AS kept, digest AS text_sha256 FROM k""",
    "op12_format_chats": r"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -1, x, CASE WHEN x = 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) r(x)),
        w AS (SELECT *, length(text) + len(regexp_extract_all(text, '<\\*(/?s>|</?SYS>>)|\[\\*(/?INST\]|/?ROLE\])')) + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 4 WHEN 'system' THEN 15
                ELSE 17 + length(role) + len(regexp_extract_all(role, '<\\*(/?s>|</?SYS>>)|\[\\*(/?INST\]|/?ROLE\])')) END AS chars FROM c)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(3 + sum(chars) AS BIGINT) AS formatted_chars
        FROM w GROUP BY conv_id""",
    "op13_importance_resample": r"""
        WITH crc AS (SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS steps FROM range(256) t(b)),
        lower_case AS (SELECT doc_id, row_number() OVER () AS row, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
        words AS (SELECT row, unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM lower_case),
        target AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
        known AS (SELECT word, hex(encode(word)) AS code FROM (SELECT word FROM words UNION SELECT word FROM target)),
        bucket AS (SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(code), 2), lambda k: CAST('0x' || code[k + 1 : k + 2] AS BIGINT))), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM known, crc),
        s AS (SELECT bucket, count(*) AS n FROM words JOIN bucket USING (word) GROUP BY bucket), t AS (SELECT bucket, count(*) AS n FROM target JOIN bucket USING (word) GROUP BY bucket),
        gain AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(n), 0) FROM s)::DOUBLE + 10000) / ((s.n + 1.0::DOUBLE) * ((SELECT coalesce(sum(n), 0) FROM t)::DOUBLE + 10000)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
        weight AS (SELECT row, count(*) AS n_features, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight FROM words JOIN bucket USING (word) JOIN gain USING (bucket) GROUP BY row),
        scored AS (SELECT doc_id, row, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                     coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM lower_case LEFT JOIN weight USING (row)),
        ranked AS (SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) END AS place FROM scored)
        SELECT doc_id, n_features, weight, score, CASE WHEN place <= (SELECT 10 * count(*) // 100 FROM scored WHERE n_features >= 20) THEN place END AS rank FROM ranked""",
}
