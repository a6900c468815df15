"""The queries of this subpackage and, where SQL can express one, its DuckDB text."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, cross_polytope, histogram_shard, merkle, ngram_join, packing, pareto_mix, pii, token_count, toxicity, voronoi_knn, warc

WORDS = r"[^\x20\x09-\x0D]+"
BPE_RANKS, BPE_JSON, WORD_JSON, PIECES = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"

#: The chain's categories in order, from the columns of ``labels``.
TOXIC_CATEGORIES = {"low_quality": "1 - quality", "toxic": "toxic"}


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = _table(spark, sf_dir, "documents", "doc_id", "text").select(
        "doc_id",
        (F.octet_length(text) + F.lit(16)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("text_hash"),
    )
    out = histogram_shard.shard(docs, 40, group="text_hash", ident="doc_id", size="size")
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op2_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find(_table(spark, sf_dir, "documents", "doc_id", "text"), keep_text=False)
    return out.select(
        "doc_id",
        *[f"n_{k}" for k in pii.BASE],
        F.sha2(pii.digest(F.filter("spans", lambda c: c["base"])).cast("binary"), 256).alias("base_sha256"),
        pii.digest(F.col("spans")).alias("spans"),
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    out = token_count.count_tokens(docs, public_tokenizers.path(BPE_JSON), pattern=public_tokenizers.PATTERN)
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op4_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages", "page_id", "url", "html")
    return warc.round_trip(pages, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op5_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text", "source").select(
        "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("long").alias("size")
    )
    return pareto_mix.mix(docs, "size").select("doc_id", "size", "source_size", "target", "taken")


def op6_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    out = voronoi_knn.top_k(rows, "vec_id", "embedding", F.col("id") % 20 == 0, k=20, scale=64)
    return out.withColumn("score", F.col("score").cast("long"))


def op7_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    chain = toxicity.fit(docs, _table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"), TOXIC_CATEGORIES)
    scored = toxicity.predict(docs, chain)
    return scored.select("doc_id", "low_quality", F.col("toxic").alias("toxicity"), (F.col("toxic") >= chain.cuts["toxic"]).alias("toxic"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    vocab, pattern = public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN
    out = bpe.encode(docs, vocab, pattern, joined="said", decoded="decoded")
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.col("said").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return cross_polytope.search(rows, "vec_id", "embedding", F.col("id") % 20 == 0, k=20)


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(_table(spark, sf_dir, "documents", "doc_id", "text"), num=90, den=100, n=3)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    docs = _table(spark, sf_dir, "documents", *columns)
    fifth = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    lowered = F.translate("text", ascii_uppercase, ascii_lowercase)
    return merkle.manifest(docs, columns, "source", "doc_id", (fifth, {"text": lowered}))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path(WORD_JSON))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents", "doc_id", "text")
    out = alignment.align(docs, public_tokenizers.path(BPE_JSON), public_tokenizers.path(PIECES))
    return out.select("doc_id", *alignment.COUNTS, "groups_sha256")


QUERIES = {
    "op1_histogram_sort": op1_histogram_sort,
    "op2_pii_spans": op2_pii_spans,
    "op3_token_counts": op3_token_counts,
    "op4_warc_round_trip": op4_warc_round_trip,
    "op5_pareto_mix": op5_pareto_mix,
    "op6_voronoi_knn": op6_voronoi_knn,
    "op7_toxicity_chain": op7_toxicity_chain,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_cross_polytope": op9_cross_polytope,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_packing": op12_packing,
    "op13_alignment": op13_alignment,
}

ORACLE: dict[str, str] = {
    "op4_warc_round_trip": """
        WITH p AS (
          SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d
          FROM pages),
        f AS (SELECT d, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY d)
        SELECT p.page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
          CASE WHEN p.page_id <> f.first_id THEN 'revisit' ELSE 'response' END AS record_type,
          CASE WHEN p.page_id <> f.first_id THEN f.first_id END AS refers_to
        FROM p LEFT JOIN f ON p.d = f.d AND p.n >= 100
    """,
    # the remaining words of a source are filled by Pareto rank; v, u and the cut are those of the operator
    "op5_pareto_mix": r"""
        WITH d AS (
          SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
            CAST('0x' || substr(md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS u
          FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        w AS (SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS w FROM s),
        l AS (
          SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - CAST(coalesce(sum(source_size) OVER (
                ORDER BY source_size / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) * 3.0)
              / sum(w) OVER (ORDER BY source_size / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
          FROM w),
        t AS (SELECT source, source_size, least(source_size * CAST(3 AS DOUBLE), w * max(level) OVER ()) AS target FROM l),
        p AS (
          SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
        q AS (SELECT *, greatest(target - whole * source_size, 0.0) AS rest FROM p),
        r AS (SELECT *, CASE WHEN source_size > 0 THEN rest / source_size ELSE 0.0 END AS share FROM q),
        o AS (
          SELECT d.doc_id, d.source, d.size, source_size, target, whole, rest, share,
            (u + CAST(0.5 AS DOUBLE)) / CAST(281474976710656 AS DOUBLE) AS x
          FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source),
        k AS (SELECT *, CASE WHEN share > 0 AND share < 1 THEN (x / (1 - x)) / (share / (1 - share)) END AS ratio FROM o),
        v AS (SELECT *, CAST(floor(ratio / (1 + ratio) * CAST(281474976710656 AS DOUBLE)) AS BIGINT) AS v FROM k),
        c AS (
          SELECT *, sum(size) OVER (PARTITION BY source, v IS NULL ORDER BY v, doc_id NULLS FIRST
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM v)
        SELECT doc_id, size, source_size, target,
          CAST(size * (whole + CASE WHEN v IS NOT NULL AND upto * 2 - size <= rest * 2 THEN 1 ELSE 0 END) AS BIGINT) AS taken
        FROM c
    """,
    "op6_voronoi_knn": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings),
        p AS (
          SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
          vec_id, score
        FROM p QUALIFY rank <= 20
    """,
    "op10_ngram_jaccard": r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        g AS (
          SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
            ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g
          FROM w),
        s AS (SELECT doc_id, unnest(g) AS s FROM g),
        n AS (SELECT doc_id, CAST(len(g) AS BIGINT) AS n FROM g),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (
          SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
        r AS (SELECT doc_id, doc_id AS root FROM n UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id AND r.root < l.b)
        SELECT n.doc_id, n.n AS n_shingles, min(r.root) AS component_id
        FROM n JOIN r ON r.doc_id = n.doc_id GROUP BY ALL
    """,
    # nodes of all trees level by level; then each leaf's siblings; then tampered leaves folded level by level
    "op11_merkle_manifest": r"""
        WITH RECURSIVE d AS (
          SELECT *, CAST(doc_id AS VARCHAR) AS i, CAST(n_chars AS VARCHAR) AS c,
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
        h AS (
          SELECT *, coalesce(strlen(i) || ':' || i, '-') || coalesce(strlen(source) || ':' || source, '-')
            || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(c) || ':' || c, '-') AS head,
            -- CRC-32 bit by bit: a byte is mixed in, then eight steps
            xor(list_reduce([CAST(4294967295 AS BIGINT)] || flatten(list_transform(string_split(i, ''),
              lambda x: [CAST(ord(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
              lambda r, x: CASE WHEN x >= 0 THEN xor(r, x) WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END), 4294967295) AS crc
          FROM d),
        l AS (
          SELECT doc_id, coalesce('s' || source, 'n') AS tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
            CASE WHEN crc % 5 = 0 THEN sha256(head || coalesce(strlen(low) || ':' || low, '-')) END AS seen
          FROM h),
        p AS (
          SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n
          FROM l),
        t AS (
          SELECT tree, 0 AS lvl, pos, n, leaf AS d FROM p
          UNION ALL
          SELECT tree, any_value(lvl) + 1, pos // 16, (any_value(n) + 15) // 16, sha256(string_agg(d, '' ORDER BY pos))
          FROM t WHERE n > 1 GROUP BY tree, pos // 16),
        s AS (SELECT tree, lvl AS height, d AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
        u AS (
          SELECT 0 AS lvl, pos, n, subroot AS d FROM s
          UNION ALL
          SELECT any_value(lvl) + 1, pos // 16, (any_value(n) + 15) // 16, sha256(string_agg(d, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY pos // 16),
        r AS (SELECT d AS root, lvl AS top FROM u WHERE n = 1),
        -- the runs that each leaf's way up passes, own digests left out or not
        w AS (
          SELECT p.tree, p.pos AS leaf_pos, t.lvl AS step, t.pos, t.d, t.pos = p.pos // (16 ** t.lvl)::BIGINT AS own
          FROM p JOIN s USING (tree) JOIN t ON t.tree = p.tree AND t.lvl < s.height AND t.pos // 16 = p.pos // (16 ** (t.lvl + 1))::BIGINT
          UNION ALL
          SELECT p.tree, p.pos, s.height + u.lvl, u.pos, u.d, u.pos = s.pos // (16 ** u.lvl)::BIGINT
          FROM p JOIN s USING (tree) CROSS JOIN r JOIN u ON u.lvl < r.top AND u.pos // 16 = s.pos // (16 ** (u.lvl + 1))::BIGINT),
        runs AS (
          SELECT tree, leaf_pos, step, coalesce(string_agg(d, '' ORDER BY pos) FILTER (WHERE NOT own), '') AS others,
            coalesce(string_agg(d, '' ORDER BY pos) FILTER (WHERE pos < own_pos), '') AS before, coalesce(string_agg(d, '' ORDER BY pos) FILTER (WHERE pos > own_pos), '') AS after
          FROM (SELECT *, max(CASE WHEN own THEN pos END) OVER (PARTITION BY tree, leaf_pos, step) AS own_pos FROM w) GROUP BY ALL),
        proofs AS (SELECT tree, leaf_pos, string_agg(others, '' ORDER BY step) AS proof FROM runs GROUP BY ALL),
        f AS (
          SELECT tree, pos, 0 AS step, coalesce(seen, leaf) AS d FROM p
          UNION ALL
          SELECT f.tree, f.pos, f.step + 1, sha256(runs.before || f.d || runs.after)
          FROM f JOIN runs ON runs.tree = f.tree AND runs.leaf_pos = f.pos AND runs.step = f.step),
        folded AS (SELECT tree, pos, arg_max(d, step) AS folded_root FROM f GROUP BY ALL)
        SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = root AS verified
        FROM p JOIN s USING (tree) CROSS JOIN r JOIN folded ON folded.tree = p.tree AND folded.pos = p.pos
        LEFT JOIN proofs ON proofs.tree = p.tree AND proofs.leaf_pos = p.pos
    """,
}
