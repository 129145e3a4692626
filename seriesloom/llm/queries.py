"""The registered queries of the text operators, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ball_search, brown_lm, chat_format, chunk_codec, collocations, digest, group_join, hyperlang, packing, quality, spelling, token_counts, token_efficiency
from .shared import table

WORD_BPE = "word_bpe_49k.json"
PIECE_BPE = "piece_bpe_32k.model"


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), WORD_BPE, window=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), PIECE_BPE, limit=4096)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold=(3, 1))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    compared = digest.compare_with_next(table(spark, sf_dir, "documents"))
    return compared.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op5_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.score_texts(table(spark, sf_dir, "documents"), fold=(7, 2))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperlang.predict_languages(table(spark, sf_dir, "documents"), fold=(4, 2))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_join.similarity_classes(table(spark, sf_dir, "documents"), width=5, percent=80)


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_search.top_k(table(spark, sf_dir, "embeddings"), k=5, every=50).select("query_id", "rank", "vec_id", "score")  # the operator tells "compared" too; SQL could not


def op9_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = chunk_codec.encode_documents(table(spark, sf_dir, "documents"), PIECE_BPE)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_efficiency.find_secrets(table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "sparse")
    return found.select(
        "doc_id",
        count("assign"),
        count("access"),
        count("hex"),
        F.sha2(token_efficiency.spans_text(base).cast("binary"), 256).alias("base_sha256"),
        token_efficiency.spans_text(F.col("spans")).alias("spans"),
    )


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_phrases(table(spark, sf_dir, "documents"), longest=5, least=100, top=2000)


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ("conv_id", "turn", "role", "text")
    said = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    same = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", same), (-1, 1, "assistant", same)], said.schema)
    # null fields are written too, so that all rows have the same fields
    records = said.unionByName(more).select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("record"))
    turns = chat_format.canonical_turns(records)
    told = chat_format.conversation_digests(chat_format.read_back(chat_format.format_turns(turns)))
    return told.select(F.col("conv").cast("long").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = {
    "op1_packing": op1_packing,
    "op2_token_counts": op2_token_counts,
    "op3_quality": op3_quality,
    "op4_fingerprints": op4_fingerprints,
    "op5_brown": op5_brown,
    "op6_language": op6_language,
    "op7_jaccard": op7_jaccard,
    "op8_top_k": op8_top_k,
    "op9_piece_codec": op9_piece_codec,
    "op10_secrets": op10_secrets,
    "op11_collocations": op11_collocations,
    "op12_chat_format": op12_chat_format,
    "op13_spelling": op13_spelling,
}
ORACLE_SQL: dict[str, str] = {
    "op8_top_k": """
        WITH good AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
            FROM good q JOIN good c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
            WHERE q.vec_id % 50 = 0
        )
        SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
        FROM scored
        QUALIFY rank <= 5
    """,
    "op11_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang,
                   unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]')) AS piece
            FROM documents
        ), numbered AS MATERIALIZED (
            SELECT lang, row_number() OVER () AS number, piece FROM pieces
        ), split AS (
            SELECT lang, number, unnest(regexp_split_to_array(piece, '[ \t]')) AS word, generate_subscripts(regexp_split_to_array(piece, '[ \t]'), 1) AS spot FROM numbered
        ), w1 AS MATERIALIZED (
            SELECT lang, number, row_number() OVER (PARTITION BY number ORDER BY spot) AS spot, word FROM split WHERE word <> ''
        ), next_words AS MATERIALIZED (
            SELECT lang, word AS p1, lead(word, 1) OVER w AS w2, lead(word, 2) OVER w AS w3, lead(word, 3) OVER w AS w4, lead(word, 4) OVER w AS w5 FROM w1 WINDOW w AS (PARTITION BY number ORDER BY spot)
        ), f AS MATERIALIZED (
            SELECT lang, p1 AS phrase, 1 AS size, count(*) AS a FROM next_words GROUP BY ALL
            UNION ALL SELECT lang, p1 || ' ' || w2, 2, count(*) FROM next_words WHERE w2 IS NOT NULL GROUP BY ALL
            UNION ALL SELECT lang, p1 || ' ' || w2 || ' ' || w3, 3, count(*) FROM next_words WHERE w3 IS NOT NULL GROUP BY ALL
            UNION ALL SELECT lang, p1 || ' ' || w2 || ' ' || w3 || ' ' || w4, 4, count(*) FROM next_words WHERE w4 IS NOT NULL GROUP BY ALL
            UNION ALL SELECT lang, p1 || ' ' || w2 || ' ' || w3 || ' ' || w4 || ' ' || w5, 5, count(*) FROM next_words WHERE w5 IS NOT NULL GROUP BY ALL
        ), totals AS (
            SELECT lang, sum(a) AS n FROM f WHERE size = 1 GROUP BY lang
        ), frequent AS MATERIALIZED (
            SELECT * FROM f WHERE a >= 100
        ), candidates AS MATERIALIZED (
            SELECT *, string_split(phrase, ' ') AS words FROM frequent WHERE size >= 2
        ), cut AS MATERIALIZED (
            SELECT lang, phrase, size, a, k, array_to_string(words[1:k], ' ') AS first_part, array_to_string(words[k + 1:], ' ') AS rest
            FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates)
        ), cuts AS (
            SELECT c.lang, c.phrase, c.size, c.a, k, l.a AS l, r.a AS r, n, ((1000::HUGEINT * c.a * n) // (l.a::HUGEINT * r.a))::BIGINT AS score
            FROM cut c JOIN frequent l ON l.lang = c.lang AND l.phrase = first_part JOIN frequent r ON r.lang = c.lang AND r.phrase = rest JOIN totals t ON t.lang = c.lang
        ), lowest AS (
            SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
        ), covered AS (
            SELECT lang, array_to_string(words[1:size - 1], ' ') AS phrase, a FROM candidates UNION SELECT lang, array_to_string(words[2:], ' '), a FROM candidates
        )
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score
        FROM lowest ANTI JOIN covered USING (lang, phrase, a)
        QUALIFY rank <= 2000
    """,
    "op12_chat_format": r"""
        WITH said AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
        ), marked AS (
            SELECT *, len(regexp_extract_all(text, '<\\*(?:\|[A-Za-z0-9_]+\|>|/?s>|unk>|pad>|</?SYS>>)|\[\\*/?INST\]')) AS controls FROM said
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(len('<|turn|>') + len(role) + 1 + len(text) + controls + len('<|end|>') + 1)::BIGINT AS formatted_chars
        FROM marked GROUP BY conv_id
    """,
}
