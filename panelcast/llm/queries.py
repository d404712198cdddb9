"""One query per operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import scan
from . import chat, decontaminate, html_text, language, licenses, line_dedup, ngram_join, packing, quality, repair, resample, token_files, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return add


@query("op7_decontaminate")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find_passages(scan(spark, folder, "documents"), scan(spark, folder, "benchmark")))


@query("op5_token_files")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.digest(token_files.read_documents(spark, token_files.write_documents(scan(spark, folder, "documents"))))


@query("op4_packing")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(scan(spark, folder, "documents"))[1]


@query("op2_quality")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return quality.digest(quality.quality(scan(spark, folder, "documents")))


@query("op6_language")
def _(spark: SparkSession, folder: str) -> DataFrame:
    documents = scan(spark, folder, "documents")
    return language.digest(language.classify(documents, language.fit(documents)))


@query("op8_ngram_join")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.near_duplicates(scan(spark, folder, "documents"))


@query("op3_warc", """
    WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
    f AS (SELECT digest, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY digest)
    SELECT page_id, n AS payload_bytes, p.digest AS payload_digest,
           CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN page_id > first THEN first END AS refers_to
    FROM p LEFT JOIN f ON p.digest = f.digest AND n >= 100
""")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return warc.digest(warc.read_archives(spark, warc.write_archives(scan(spark, folder, "pages"))))


@query("op9_chat", r"""
    WITH c AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) t(i)
    )
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
           CAST(sum(14 + length(regexp_replace(role, '[\\#<:]', 'xx', 'g')) + length(regexp_replace(text, '[\\#<]', 'xx', 'g'))) AS BIGINT) AS formatted_chars
    FROM c GROUP BY conv_id
""")
def _(spark: SparkSession, folder: str) -> DataFrame:
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    rows = scan(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.digest(chat.formatted_conversations(rows))


@query("op10_html_text")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.digest(html_text.extract(scan(spark, folder, "pages")))


def document_files(documents: DataFrame) -> DataFrame:
    """``path, text``: the documents as files of repositories, one per source.

    A document that begins with a licence line stands for the licence file of the directory
    of its thousand; all others lie one level deeper.
    """
    number = F.col("doc_id")
    top = F.concat(F.coalesce("source", F.lit("none")), F.lit("/d"), F.floor(number / 1000))
    first = F.substring_index(F.col("text"), "\n", 1)
    is_license = F.coalesce((F.length(first) < 200) & first.rlike(licenses.CUE), F.lit(False))
    path = F.when(is_license, F.concat(top, F.lit("/LICENSE-"), number)).otherwise(F.concat(top, F.lit("/d"), F.floor(number / 100) % 10, F.lit("/"), number, F.lit(".txt")))
    return documents.select(path.alias("path"), "text")


@query("op1_licenses")
def _(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan_licenses(document_files(scan(spark, folder, "documents")))
    number = F.regexp_extract("path", r"(\d+)(\.txt)?$", 1).try_cast("long")
    return found.select(number.alias("doc_id"), "path", "license", "score", "origin", "from_folder")


@query("op11_resample", r"""
    WITH RECURSIVE bytes AS (
        SELECT b, list_reduce(range(8), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)), b) AS after FROM range(256) t(b)
    ),
    crc_table AS (SELECT list(after ORDER BY b) AS crc FROM bytes),
    words AS (
        SELECT 'd' AS side, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
        UNION ALL
        SELECT 't', NULL, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark
    ),
    counted AS (SELECT side, doc_id, word, count(*) AS n FROM words GROUP BY ALL),
    hashed AS (
        SELECT word, xor(4294967295, list_reduce(list_transform(range(octet_length(encode(word))), lambda i: CAST('0x' || substr(hex(encode(word)), 2 * i + 1, 2) AS BIGINT)),
            lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT))) % 10000 AS bucket
        FROM (SELECT DISTINCT word FROM counted), crc_table
    ),
    buckets AS (
        SELECT b AS bucket, coalesce(s, 0) AS s, coalesce(t, 0) AS t FROM range(10000) r(b) LEFT JOIN (
            SELECT bucket, sum(n) FILTER (WHERE side = 'd') AS s, sum(n) FILTER (WHERE side = 't') AS t FROM counted JOIN hashed USING (word) GROUP BY bucket
        ) ON b = bucket
    ),
    gains AS (
        SELECT bucket, floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(sum(s) OVER () + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(sum(t) OVER () + 10000 AS DOUBLE)))) AS gain FROM buckets
    ),
    weighed AS (SELECT doc_id, sum(n) AS n_features, sum(n * gain) AS weight FROM counted JOIN hashed USING (word) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY doc_id),
    scored AS (
        SELECT d.doc_id, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
               CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
        FROM documents d LEFT JOIN weighed w ON d.doc_id = w.doc_id
    ),
    placed AS (
        SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS able FROM scored
    )
    SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * able // 100 THEN place END AS rank FROM placed
""")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return resample.digest(resample.resample(scan(spark, folder, "documents"), scan(spark, folder, "benchmark")))


@query("op13_line_dedup", r"""
    WITH lines AS (
        SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS position FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
    ),
    keyed AS (
        SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
    ),
    repeated AS (SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
    marked AS (SELECT doc_id, line, position, coalesce(doc_id <> top, false) AS dropped FROM keyed LEFT JOIN repeated USING (key))
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY position) FILTER (WHERE NOT dropped), '')) AS kept_sha256
    FROM marked GROUP BY doc_id
""")
def _(spark: SparkSession, folder: str) -> DataFrame:
    documents = scan(spark, folder, "documents")
    return line_dedup.digest(line_dedup.kept_text(documents, line_dedup.keep_maps(documents)))


def _grown(path: str, cost: str, edit: str) -> str:
    """SQL of a path, nine digits of cost and then the audit, with one more edit."""
    return f"lpad(CAST(CAST(substr({path}, 1, 9) AS INTEGER) + {cost} AS VARCHAR), 9, '0') || substr({path}, 10) || '{edit}'"


_RULED_OUT = "f IN ('b', 'd')"
_REROLED = {q: f"CASE WHEN NOT {_RULED_OUT} THEN {_grown(q, '2 + t', 'R')} END" for q in ("q0", "q1", "q2", "q3")}
_KEPT = {(q, r): f"CASE WHEN NOT {_RULED_OUT} AND r = '{r}' THEN {_grown(q, 't', 'K')} END" for q in ("q0", "q1", "q2", "q3") for r in "sua"}


@query("op12_repair", rf"""
    WITH RECURSIVE bytes AS (
        SELECT b, list_reduce(range(8), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)), b) AS after FROM range(256) t(b)
    ),
    crc_table AS (SELECT list(after ORDER BY b) AS crc FROM bytes),
    keyed AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
    ),
    hashed AS (
        SELECT keyed.*, xor(4294967295, list_reduce(list_transform(range(length(k)), lambda i: CAST(ascii(k[i + 1]) AS BIGINT)),
            lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT))) % 20 AS kind FROM keyed, crc_table
    ),
    damaged AS (
        SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
               CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
               unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
        FROM hashed WHERE kind <> 0
    ),
    ordered AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 64), sha256(text), copy) AS i,
               left(role, 1) AS r, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core FROM damaged
    ),
    faults AS (
        SELECT *, CASE WHEN core = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
                       WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS f,
               lag(r) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM ordered
    ),
    figures AS (
        SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
               count(*) FILTER (WHERE f = 'b') AS blank, count(*) FILTER (WHERE f = 'd') AS duplicate, count(*) FILTER (WHERE f = 't') AS truncated,
               count(*) FILTER (WHERE before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS illegal
        FROM faults GROUP BY conv_id
    ),
    paths AS (  -- the lightest path to each state, with insertions, after i rows
        SELECT conv_id, CAST(0 AS BIGINT) AS i, '000000000' AS q0, CAST(NULL AS VARCHAR) AS q1, '000000002I' AS q2, '000000004II' AS q3 FROM figures
        UNION ALL
        SELECT conv_id, i, n0, n1, least(n2, {_grown('n0', '2', 'I')}, {_grown('n1', '2', 'I')}, {_grown('n3', '2', 'I')}),
               least(n3, {_grown('n2', '2', 'I')}, {_grown('n0', '4', 'II')}, {_grown('n1', '4', 'II')})
        FROM (
            SELECT paths.conv_id, faults.i, {_grown('q0', '3', 'D')} AS n0,
                   least({_grown('q1', '3', 'D')}, {_KEPT['q0', 's']}) AS n1,
                   least({_grown('q2', '3', 'D')}, {', '.join([_REROLED[q] for q in ('q0', 'q1', 'q3')] + [_KEPT[q, 'u'] for q in ('q0', 'q1', 'q3')])}) AS n2,
                   least({_grown('q3', '3', 'D')}, {_REROLED['q2']}, {_KEPT['q2', 'a']}) AS n3
            FROM paths JOIN (SELECT *, CASE WHEN f = 't' THEN 1 ELSE 0 END AS t FROM faults) faults ON faults.conv_id = paths.conv_id AND faults.i = paths.i + 1
        )
    ),
    goals AS (
        SELECT conv_id, CAST(substr(least(q0, q3), 1, 9) AS BIGINT) AS cost, substr(least(q0, q3), 10) AS audit
        FROM paths JOIN figures USING (conv_id) WHERE i = n
    ),
    edits AS (SELECT conv_id, unnest(range(1, length(audit) + 1)) AS p, audit[p] AS e FROM goals),
    numbered AS (SELECT *, sum(CASE WHEN e <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY p) AS i FROM edits),
    messages AS (
        SELECT n.conv_id, p, CASE WHEN e = 'I' THEN '' ELSE text END AS text, e, role,
               CASE WHEN e = 'K' AND r = 's' THEN 0 ELSE 1 END AS turn
        FROM numbered n LEFT JOIN faults ON n.conv_id = faults.conv_id AND n.i = faults.i WHERE e <> 'D'
    ),
    told AS (
        SELECT conv_id, p, text, CASE WHEN e = 'K' THEN role WHEN sum(turn) OVER (PARTITION BY conv_id ORDER BY p) % 2 = 1 THEN 'user' ELSE 'assistant' END AS role FROM messages
    ),
    texts AS (SELECT conv_id, sha256(string_agg(role || ':' || text, chr(10) ORDER BY p)) AS repaired_sha256 FROM told GROUP BY conv_id)
    SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
           coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN figures USING (conv_id) LEFT JOIN goals USING (conv_id) LEFT JOIN texts USING (conv_id)
""")
def _(spark: SparkSession, folder: str) -> DataFrame:
    conversations = scan(spark, folder, "conversations")
    _, plan, parts = repair.repair(repair.damaged(conversations))
    return repair.report(conversations, plan, parts)
