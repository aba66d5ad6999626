"""The registered queries of this package, each over its whole tables, and the SQL twins of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyweave.llm import (
    bitsliced, chat_format, decontaminate, html_text, langid, ngram_trie, packing, pair_maxscore, rank_queue, setm, simhash,
    suffix_dedup, toxicity)
from tallyweave.llm.common import table


def tokenizer_path() -> str:
    """The public byte-level vocabulary that the contract of `op10_best_fit_packing` names."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_bitsliced_top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return bitsliced.top_inner_products(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op2_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.removal_report(table(spark, folder, "documents"), length=400)


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op4_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    turns = chat_format.format_turns(chat_format.with_probe(table(spark, folder, "conversations")))
    return chat_format.conversation_digests(turns).drop("rewrites")


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.held_out_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op6_ngram_scores(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_trie.held_out_scores(table(spark, folder, "documents"))


def op7_simhash_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"), shingle=3, max_bits=2)


def op8_language(spark: SparkSession, folder: str) -> DataFrame:
    return langid.held_out_languages(table(spark, folder, "documents"))


def op9_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(table(spark, folder, "pages"))


def op10_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.digests(packing.pack(table(spark, folder, "documents"), tokenizer_path()))


def op11_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return setm.collocations(table(spark, folder, "documents"), least=10, longest=3, top=2000, share=50)


def op12_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    return rank_queue.digests(rank_queue.round_trip(table(spark, folder, "documents"), *vocabulary))


def op13_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return pair_maxscore.ranked_search(table(spark, folder, "documents"), table(spark, folder, "benchmark"), k=10)


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (op1_bitsliced_top_k, op2_suffix_dedup, op3_decontamination, op4_chat_format, op5_toxicity, op6_ngram_scores,
            op7_simhash_near_duplicates, op8_language, op9_html_text, op10_best_fit_packing,
            op11_phrase_collocations, op12_bpe_round_trip, op13_ranked_search, pipeline)
    return {f.__name__: f for f in made}



def _escaped(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for control in chat_format.CONTROL:
        out = f"replace({out}, '{control}', '{control[0]}\\{control[1:]}')"
    return out


SQL = {
    "op1_bitsliced_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op4_chat_format": f"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        e AS (
            SELECT *, length(replace({_escaped('role')}, chr(10), '\\' || chr(10))) + length({_escaped('text')}) + 24 AS n FROM t)
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(n) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op11_phrase_collocations": """
        WITH d AS (
            SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(9), 'abcdefghijklmnopqrstuvwxyz ') AS text FROM documents),
        p AS (SELECT d, lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece, generate_subscripts(
            regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]'), 1) AS p FROM d),
        s AS (SELECT d, lang, p, list_filter(string_split(piece, ' '), lambda x: x <> '') AS ws FROM p),
        w1 AS (SELECT d, lang, p, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM s),
        f AS (
            SELECT lang, w, lead(w) OVER o AS x, lead(w, 2) OVER o AS y FROM w1 WINDOW o AS (PARTITION BY d, p ORDER BY i)),
        n AS (SELECT lang, count(*) AS n FROM f GROUP BY lang),
        a1 AS (SELECT lang, w, count(*)::HUGEINT AS a FROM f GROUP BY ALL),
        a2 AS (SELECT lang, w, x, count(*)::HUGEINT AS a FROM f WHERE x IS NOT NULL GROUP BY ALL),
        a3 AS (SELECT lang, w, x, y, count(*)::HUGEINT AS a FROM f WHERE y IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
        m AS (SELECT lang, w, x, max(a) AS m FROM (
            SELECT lang, w, x, a FROM a3 UNION ALL SELECT lang, x, y, a FROM a3) GROUP BY ALL),
        c AS (
            SELECT b.lang, b.w || ' ' || b.x AS phrase, b.a, l.a AS l, r.a AS r, 1 AS k FROM a2 b
            JOIN a1 l ON l.lang = b.lang AND l.w = b.w JOIN a1 r ON r.lang = b.lang AND r.w = b.x
            LEFT JOIN m ON m.lang = b.lang AND m.w = b.w AND m.x = b.x
            WHERE b.a >= 10 AND (m.m IS NULL OR 100 * m.m < 50 * b.a)
            UNION ALL
            SELECT b.lang, b.w || ' ' || b.x || ' ' || b.y, b.a, l.a, r.a, 1 FROM a3 b
            JOIN a1 l ON l.lang = b.lang AND l.w = b.w JOIN a2 r ON r.lang = b.lang AND r.w = b.x AND r.x = b.y
            UNION ALL
            SELECT b.lang, b.w || ' ' || b.x || ' ' || b.y, b.a, l.a, r.a, 2 FROM a3 b
            JOIN a2 l ON l.lang = b.lang AND l.w = b.w AND l.x = b.x JOIN a1 r ON r.lang = b.lang AND r.w = b.y),
        e AS (SELECT *, (1000000 * a * a) // (l * r) AS score FROM c),
        t AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS cut FROM e),
        z AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM t
            WHERE cut = 1)
        SELECT z.lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l,
            CAST(r AS BIGINT) AS r, n, CAST(score AS BIGINT) AS score FROM z JOIN n ON n.lang = z.lang WHERE rank <= 2000""",
    "op13_ranked_search": """
        WITH terms AS (
            SELECT row_number() OVER () AS d, doc_id, unnest(regexp_extract_all(translate(text,
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
        tf AS (SELECT d, doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
        nd AS (SELECT d, sum(tf)::BIGINT AS n FROM tf GROUP BY d),
        g AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS big_l FROM nd),
        dw AS (SELECT term, CAST(floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
            FROM tf, g GROUP BY term, big_n),
        q AS (SELECT row_number() OVER () AS q, item_id, list_distinct(regexp_extract_all(translate(text,
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS ts FROM benchmark),
        qt AS (SELECT q, item_id, unnest(ts) AS term FROM q),
        s AS (
            SELECT q, item_id, d, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l)))) AS score
            FROM qt JOIN tf USING (term) JOIN dw USING (term) JOIN nd USING (d), g GROUP BY q, item_id, d, doc_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 10""",
}


def all_sql() -> dict[str, str]:
    return dict(SQL)
