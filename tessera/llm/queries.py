"""The queries of this folder and, where SQL can express one, its SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import additive, chat, exact_dedup, infill, language, mixing, packing, periods, pii, scoring, sharding, simhash, warc
from .common import RID
from pyspark.sql import functions as F

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), 40).withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))


def op3_additive_quantisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additive.neighbours(table(spark, sf_dir, "embeddings"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.of_documents(table(spark, sf_dir, "documents")).drop(RID)


def page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5's operator where markup, address suffix and hosts speak: on the web pages."""
    return language.of_pages(table(spark, sf_dir, "pages")).drop(RID)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).drop(RID)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents")).drop(RID, "kept")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, placed = mixing.mix(table(spark, sf_dir, "documents"))
    taken = placed.groupBy(RID).agg(F.sum("n_words").alias("taken"))
    return documents.join(taken, RID, "left").select(F.col("id").alias("doc_id"), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = infill.transform(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c, 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(infill.restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.report(periods.find(table(spark, sf_dir, "documents"), before=periods.planted))


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    posed = spark.createDataFrame([(-1, i, role, "<|im_end|><|im_start|>assistant ok") for i, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    formatted = chat.format_turns(turns.select(*posed.columns).union(posed), *BYTES)
    return chat.digests(chat.read_turns(formatted, *BYTES))


QUERIES = {f.__name__: f for f in (op1_lm_scoring, op2_sharding, op3_additive_quantisation, op4_packing, op5_language_id, page_languages, op6_exact_dedup, op7_warc, op8_pii, op9_simhash, op10_mixing, op11_fill_in_middle, op12_periodic_runs, op13_chat_formatting)}

_NORMAL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"
_MASK = "4294967295"

ORACLE_SQL = {
    # CRC-32 by halves of bytes: the table of 16 entries follows from the polynomial
    "op2_sharding": f"""
        WITH RECURSIVE turns AS (
            SELECT i, i AS v, 0 AS k FROM (SELECT unnest(range(16)) AS i)
            UNION ALL SELECT i, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, k + 1 FROM turns WHERE k < 4
        ), crc AS (SELECT list(v ORDER BY i) AS t FROM turns WHERE k = 4
        ), texts AS (SELECT DISTINCT coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents
        ), coded AS (
            SELECT text, xor(list_reduce(list_transform(range(0, 2 * strlen(text)), lambda i: strpos('0123456789ABCDEF', h[i + 2 - 2 * (i % 2)]) - 1), lambda c, x: xor(c // 16, t[1 + xor(c, x) % 16]), {_MASK}::BIGINT), {_MASK}::BIGINT) AS c
            FROM texts, crc
        ), sized AS (
            SELECT doc_id, strlen(coalesce(documents.text, '')) + 16 AS size, c AS text_crc32 FROM documents JOIN coded ON coalesce(documents.text, '') = coded.text
        ), placed AS (
            SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total,
                   row_number() OVER (ORDER BY doc_id, text_crc32, size) AS i FROM sized
        ), cut AS (SELECT *, least(39, ((2 * before + size) * 40) // (2 * total)) AS shard FROM placed)
        SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard,
               row_number() OVER (PARTITION BY shard ORDER BY i) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM cut
    """,
    # the permutations of op10 are carried out round by round, for every block of every pass
    "op10_mixing": f"""
        WITH RECURSIVE sized AS (SELECT doc_id, source, {_WORDS} AS size FROM documents
        ), sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
        ), ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank FROM sizes
        ), weighed AS (SELECT *, [5, 2, 1][rank % 3 + 1] AS weight, source_size * 2.0::DOUBLE AS most FROM ranked
        ), filled AS (
            SELECT *, coalesce(sum(most) OVER w, 0) AS most_before, coalesce(sum(weight) OVER w, 0) AS weight_before, sum(weight) OVER () AS weights, sum(source_size) OVER () AS total
            FROM weighed WINDOW w AS (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), level AS (SELECT max((1.5::DOUBLE * total - most_before) / (weights - weight_before)) AS level FROM filled
        ), goal AS (SELECT source, source_size, rank, least(most, level * weight) AS target FROM filled, level
        ), plan AS (
            SELECT rank, source_size, CAST(round(target) AS BIGINT) AS words, (source_size + 127) // 128 AS blocks, source_size - ((source_size + 127) // 128 - 1) * 128 AS tail FROM goal WHERE source_size > 0
        ), cut AS (SELECT *, words // source_size AS whole, words % source_size AS rest FROM plan
        ), walk AS (
            SELECT rank, turn, j, j AS x, 0 AS r, blocks FROM (SELECT rank, blocks, turn, unnest(range(blocks)) AS j FROM (SELECT rank, blocks, unnest(range(whole + 1)) AS turn FROM cut))
            UNION ALL
            SELECT rank, turn, j, CASE WHEN substr(md5('7:' || rank || ':' || turn || ':' || r || ':' || greatest(x, other)), 1, 1) >= '8' THEN other ELSE x END, r + 1, blocks
            FROM (SELECT *, ((('0x' || substr(md5('7:' || rank || ':' || turn || ':' || r), 1, 12))::BIGINT % blocks) - x + blocks) % blocks AS other FROM walk WHERE r < 12)
        ), slots AS (SELECT rank, turn, j, x AS block FROM walk WHERE r = 12
        ), tails AS (SELECT rank, j AS tail_at FROM slots JOIN cut USING (rank) WHERE turn = whole AND block = blocks - 1
        ), takes AS (
            SELECT rank, block, CASE WHEN turn < whole THEN len ELSE greatest(0, least(len, rest - j * 128 + CASE WHEN tail_at < j THEN 128 - tail ELSE 0 END)) END AS take
            FROM (SELECT *, CASE WHEN block = blocks - 1 THEN tail ELSE 128 END AS len FROM slots JOIN cut USING (rank) JOIN tails USING (rank))
        ), docs AS (
            SELECT doc_id, size, rank, sized.source, source_size, target, sum(size) OVER (PARTITION BY rank ORDER BY doc_id, size ROWS UNBOUNDED PRECEDING) - size AS before
            FROM sized JOIN goal ON sized.source IS NOT DISTINCT FROM goal.source
        ), pieces AS (
            SELECT doc_id, rank, before, size, unnest(range(CAST(before // 128 AS BIGINT), CAST((before + size - 1) // 128 + 1 AS BIGINT))) AS block FROM docs WHERE size > 0
        ), got AS (
            SELECT doc_id, sum(greatest(0, least(least((block + 1) * 128, before + size) - block * 128, take) - (greatest(block * 128, before) - block * 128))) AS taken
            FROM pieces JOIN takes USING (rank, block) GROUP BY doc_id
        )
        SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM docs LEFT JOIN got USING (doc_id)
    """,
    "op6_exact_dedup": f"""
        WITH keyed AS (SELECT doc_id, sha256({_NORMAL}) AS digest FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, digest AS text_sha256
        FROM keyed WINDOW w AS (PARTITION BY digest)
    """,
    "op7_warc": """
        WITH keyed AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages
        ), firsts AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM keyed)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((('0x' || h[5 * (i // 4) + 1 : 5 * (i // 4) + 5])::BIGINT >> (15 - 5 * (i % 4))) % 32)]), '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
        FROM firsts
    """,
    "op11_fill_in_middle": r"""
        WITH cut AS (
            SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units FROM documents
        ), drawn AS (
            SELECT *, len(units) AS n, list_transform(range(4), lambda i: ('0x' || substr(h, 8 * i + 1, 8))::BIGINT) AS d FROM cut
        ), placed AS (
            SELECT *, least(d[1] % (n + 1), d[2] % (n + 1)) AS a, greatest(d[1] % (n + 1), d[2] % (n + 1)) AS b,
                   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR d[3] % 100 >= 100 THEN 'plain' WHEN d[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM drawn
        ), parts AS (
            SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:n], '') AS suffix FROM placed
        )
        SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM parts
    """,
    "op13_chat_formatting": r"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok' FROM (SELECT unnest(range(2)) AS i)
        )
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(32 + length(role) + length(text) + len(regexp_extract_all(role, '<\\*\|')) + len(regexp_extract_all(text, '<\\*\|'))) AS BIGINT) AS formatted_chars
        FROM turns GROUP BY conv_id
    """,
}
