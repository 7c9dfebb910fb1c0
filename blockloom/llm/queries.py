"""One registered query per operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm.collocations import collocations
from blockloom.llm.exact_dedup import exact_dedup
from blockloom.llm.html_extract import extract_pages
from blockloom.llm.language_id import held_out, identify, learn_from_documents
from blockloom.llm.manifest import merkle_manifest
from blockloom.llm.near_dedup import near_duplicates
from blockloom.llm.order_minhash import edit_report
from blockloom.llm.packing import pack
from blockloom.llm.pieces import encode_and_decode
from blockloom.llm.pitman_yor import score_documents
from blockloom.llm.registry import ORACLES, QUERIES, query
from blockloom.llm.secret_scan import scan_report
from blockloom.llm.suffix_dedup import repeated_spans
from blockloom.llm.tables import documents, table
from blockloom.llm.token_counts import token_counts

__all__ = ["ORACLES", "QUERIES"]


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file, which every machine has with its package."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query(
    "op10_exact_dedup",
    r"""
    WITH texts AS (
        SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
    )
    SELECT doc_id,
           min(doc_id) OVER same AS keep_id,
           count(*) OVER same AS group_size,
           doc_id = min(doc_id) OVER same AS kept,
           sha256(t) AS text_sha256
    FROM texts WINDOW same AS (PARTITION BY t)
    """,
)
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


@query(
    "op9_near_dedup",
    r"""
    WITH RECURSIVE parts AS (
        SELECT doc_id, list_filter(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
        FROM documents
    ),
    shingles AS (
        SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 3) - 1], ' ') AS s
        FROM parts, unnest(range(1, greatest(len(w) - 1, least(len(w) + 1, 2)))) AS r(i)
    ),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    common AS (
        SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k
        FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
    ),
    links AS (
        SELECT x, y FROM common JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y
        WHERE 100 * k >= 85 * (a.n + b.n - k)
    ),
    ends AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
    reached(doc_id, other) AS (
        SELECT doc_id, doc_id FROM parts
        UNION SELECT r.doc_id, e.y FROM reached r JOIN ends e ON e.x = r.other
    ),
    classes AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
    FROM classes LEFT JOIN sizes USING (doc_id)
    """,
)
def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), words=3, percent=85)


@query("op7_secret_scan")
def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_report(documents(spark, sf_dir))


@query("op2_language_id")
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = identify(docs.select("doc_id", "text"), learn_from_documents(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "lang_rejected")


@query("op6_best_fit_packing")
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"), capacity=2048)


@query("op5_piece_encoding")
def op5_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = tokenizer_file("piece_bpe_32k.model")
    found = encode_and_decode(documents(spark, sf_dir), model)
    return found.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        F.sha2(F.concat("starts", "ends"), 256).alias("spans_sha256"),
    )


@query("op8_html_extraction")
def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query("op3_order_minhash")
def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_report(documents(spark, sf_dir))


@query("op4_suffix_dedup")
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(documents(spark, sf_dir), length=200).drop("spans")


@query("op1_pitman_yor")
def op1_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))


@query("op11_token_counts")
def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"), limit=1024)


@query(
    "op12_collocations",
    r"""
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents
    ),
    worded AS (
        SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
    ),
    grams AS (
        SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase
        FROM worded, unnest(range(1, 6)) AS s(size), unnest(range(1, len(w) - size + 2)) AS r(i)
    ),
    counts AS (SELECT lang, phrase, size, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
    totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM worded GROUP BY lang),
    cuts AS (
        SELECT lang, phrase, size, f, k, array_to_string(p[1 : k], ' ') AS head, array_to_string(p[k + 1 : size], ' ') AS tail
        FROM (SELECT *, string_split(phrase, ' ') AS p FROM counts WHERE size > 1), unnest(range(1, size)) AS c(k)
    ),
    scored AS (
        SELECT c.lang, c.phrase, c.size, c.f AS a, h.f AS l, t.f AS r, n, k,
               ((1000::HUGEINT * c.f * n) // (h.f::HUGEINT * t.f))::BIGINT AS score
        FROM cuts c
        JOIN counts h ON h.lang = c.lang AND h.phrase = c.head
        JOIN counts t ON t.lang = c.lang AND t.phrase = c.tail
        JOIN totals ON totals.lang = c.lang
    ),
    least_cut AS (
        SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
    ),
    inside AS (
        SELECT lang, f, array_to_string(p[i : i + s - 1], ' ') AS phrase
        FROM (SELECT *, string_split(phrase, ' ') AS p FROM counts WHERE size > 2),
             unnest(range(2, size)) AS x(s), unnest(range(1, size - s + 2)) AS y(i)
    ),
    covered AS (SELECT lang, phrase, max(f) AS f FROM inside GROUP BY ALL),
    kept AS (
        SELECT c.* FROM least_cut c LEFT JOIN covered o ON o.lang = c.lang AND o.phrase = c.phrase
        WHERE o.f IS NULL OR 100 * o.f < 100 * c.a
    )
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
    FROM kept QUALIFY rank <= 2000
    """,
)
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir), min_count=100, longest=5, top=2000)


@query(
    "op13_merkle_manifest",
    r"""
    WITH RECURSIVE rows AS (
        SELECT doc_id, lang, list_reduce(
            flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [unicode(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
            lambda crc, x: CASE WHEN x >= 0 THEN xor(crc, x) ELSE xor(crc >> 1, 3988292384 * (crc & 1)) END, 4294967295
        ) AS crc,
        concat_ws('', coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
            coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head,
        text
        FROM documents
    ),
    leaves AS (
        SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
               CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN sha256(head || coalesce(strlen(text) || ':' ||
                   translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS tampered
        FROM rows
    ),
    placed AS (
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
               count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g
        FROM leaves
    ),
    nodes(g, level, pos, n, digest) AS (
        SELECT g, 0, pos, n, leaf FROM placed
        UNION ALL
        SELECT g, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos))
        FROM nodes WHERE n > 1 GROUP BY g, level, pos // 8, n
    ),
    subroots AS (SELECT g, digest, count(*) OVER () AS n FROM nodes WHERE n = 1),
    tops(level, pos, n, digest) AS (
        SELECT 0, g, n, digest FROM subroots
        UNION ALL
        SELECT level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY pos))
        FROM tops WHERE n > 1 GROUP BY level, pos // 8, n
    ),
    every AS (SELECT g, level, pos, n, digest FROM nodes UNION ALL SELECT -1, level, pos, n, digest FROM tops),
    sides AS (
        SELECT g, level, pos, n,
               coalesce(string_agg(digest, '') OVER (run ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
               coalesce(string_agg(digest, '') OVER (run ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
        FROM every WINDOW run AS (PARTITION BY g, level, pos // 8)
    ),
    walk(start, g, home, level, pos, node, proof, done) AS (
        SELECT pos, g, g, 0, pos, coalesce(tampered, leaf), '', false FROM placed
        UNION ALL
        SELECT start, CASE WHEN s.n > 1 THEN w.g ELSE -1 END, home, CASE WHEN s.n > 1 THEN w.level + 1 ELSE 0 END,
               CASE WHEN s.n > 1 THEN w.pos // 8 ELSE home END,
               CASE WHEN s.n > 1 THEN sha256(before || node || after) ELSE node END,
               CASE WHEN s.n > 1 THEN proof || before || after ELSE proof END, s.n = 1 AND w.g = -1
        FROM walk w JOIN sides s ON s.g = w.g AND s.level = w.level AND s.pos = w.pos WHERE NOT done
    )
    SELECT doc_id, leaf, subroots.digest AS subroot, (SELECT digest FROM tops WHERE n = 1) AS root,
           sha256(proof) AS proof_sha256, node AS folded_root, node = (SELECT digest FROM tops WHERE n = 1) AS verified
    FROM walk JOIN subroots ON subroots.g = home
    JOIN placed ON placed.g = home AND placed.pos = start
    WHERE done
    """,
)
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest(documents(spark, sf_dir))
