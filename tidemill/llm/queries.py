"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import exact, html, language, lines, merkle, minhash, mixing, nearest, packing, periods, substrings, toxicity, warc
from tidemill.session import read_table, scratch_path


def tokenizer_json(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_text(encoding="utf-8")


def op1_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.neighbours(read_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op2_min_max_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op3_ecoc_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read_table(spark, sf_dir, "documents"))


def op4_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(read_table(spark, sf_dir, "documents")).drop("n_chunks")


def op6_site_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = lines.remove_boilerplate(read_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars_kept"), F.sha2("text", 256).alias("kept_sha256"))


def op7_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).drop("copies")


def op8_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read_table(spark, sf_dir, "pages"))


def op9_prefix_free_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(read_table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_json())


def op11_warc_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    warc.write_archives(read_table(spark, sf_dir, "pages"), folder)
    records = warc.read_archives(spark, folder)
    return records.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op12_harmonic_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.periodic_runs(read_table(spark, sf_dir, "documents"), edit=True)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(read_table(spark, sf_dir, "documents"), tamper=True)


QUERIES = {"op1_cross_polytope": op1_cross_polytope, "op2_min_max_hash": op2_min_max_hash, "op3_ecoc_language": op3_ecoc_language, "op4_ftrl_toxicity": op4_ftrl_toxicity, "op5_chunk_recipes": op5_chunk_recipes, "op6_site_spread": op6_site_spread, "op7_pareto_mixing": op7_pareto_mixing, "op8_site_style_tree": op8_site_style_tree, "op9_prefix_free_parsing": op9_prefix_free_parsing, "op10_best_fit_packing": op10_best_fit_packing, "op11_warc_shards": op11_warc_shards, "op12_harmonic_grid": op12_harmonic_grid, "op13_merkle_manifest": op13_merkle_manifest}
ORACLES: dict[str, str] = {
    "op5_chunk_recipes": """
        WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents),
        g AS (SELECT doc_id, points, norm, count(*) OVER (PARTITION BY norm) AS group_size, first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id FROM t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g""",
    "op7_pareto_mixing": """
        WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        w AS (SELECT *, list_extract([3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE], CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)) AS weight FROM s),
        c AS (SELECT *, CAST(2 * source_size AS DOUBLE) AS cap FROM w),
        f AS (SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * 150 / 100 - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level FROM c
            WINDOW before AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        l AS (SELECT arg_min(level, cap / weight) AS level FROM f WHERE level * weight <= cap),
        t AS (SELECT f.source, source_size, least(coalesce(l.level * weight, cap), cap) AS target FROM f, l),
        r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t),
        p AS (SELECT *, floor(rate) AS whole, target - floor(rate) * source_size AS remain FROM r),
        z AS (SELECT source, size, count(*) AS n FROM d WHERE size > 0 GROUP BY ALL),
        y AS (SELECT z.source, z.size, p.remain, CAST(coalesce(sum(n * size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS before,
            CAST(sum(n * size * size) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS squares FROM z JOIN p ON z.source IS NOT DISTINCT FROM p.source WINDOW w AS (PARTITION BY z.source ORDER BY z.size DESC)),
        e AS (SELECT source, arg_max((remain - before) / squares, size) AS c, arg_max(before, size) AS sure FROM y WHERE (remain - before) / squares * size < 1 GROUP BY source),
        i AS (SELECT p.*, greatest(coalesce(e.c, CASE WHEN remain > 0 THEN 1 ELSE 0 END), 0) AS c, greatest(remain - coalesce(e.sure, 0), 0) AS rest FROM p LEFT JOIN e ON p.source IS NOT DISTINCT FROM e.source),
        u AS (SELECT d.*, i.source_size, i.target, i.whole, i.rest, least(i.c * d.size, 1) AS part, (CAST(CAST('0x' || substr(md5('7:' || d.doc_id), 1, 12) AS BIGINT) AS DOUBLE) + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u FROM d JOIN i ON d.source IS NOT DISTINCT FROM i.source),
        o AS (SELECT *, part > 0 AND part < 1 AS ranked, CASE WHEN part > 0 AND part < 1 THEN (u / (1 - u)) * ((1 - part) / part) END AS odds FROM u),
        q AS (SELECT *, sum(size) OVER (PARTITION BY source, ranked ORDER BY coalesce(odds / (1 + odds), 1), doc_id, size ROWS UNBOUNDED PRECEDING) AS reached FROM o)
        SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN part >= 1 OR (ranked AND reached - rest <= size / 2) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM q""",
    "op6_site_spread": """
        WITH l AS (SELECT doc_id, coalesce(source, 'null') AS site, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM documents),
        k AS (SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l),
        w AS (SELECT *, len(list_filter(string_split_regex(key, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS words FROM k),
        b AS (SELECT key, min(doc_id) AS keeper FROM w WHERE words >= 3 GROUP BY key HAVING count(DISTINCT site) >= 10),
        m AS (SELECT w.doc_id, w.i, w.line, b.key IS NOT NULL AND (w.doc_id <> b.keeper OR row_number() OVER (PARTITION BY w.doc_id, w.key ORDER BY w.i) > 1) AS gone FROM w LEFT JOIN b ON w.key = b.key),
        t AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS kept FROM m GROUP BY doc_id)
        SELECT doc_id, n_lines, n_removed, length(kept) AS n_chars_kept, sha256(kept) AS kept_sha256 FROM t""",
    "op11_warc_shards": """
        WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to
        FROM (SELECT *, payload_bytes >= 100 AND page_id <> first AS again FROM f)""",
    "op13_merkle_manifest": """
        WITH RECURSIVE c AS (SELECT *, xor(4294967295, list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
                lambda r, x: list_reduce([1, 2, 3, 4, 5, 6, 7, 8]::BIGINT[], lambda s, i: CASE WHEN s % 2 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END, xor(r, x)), 4294967295)) AS crc FROM documents),
        e AS (SELECT doc_id, source, text, crc, list_aggregate(list_transform([CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR)], lambda v: coalesce(CAST(strlen(v) AS VARCHAR) || ':' || v, '-')), 'string_agg', '') AS head FROM c),
        f AS (SELECT *, sha256(head || coalesce(CAST(strlen(text) AS VARCHAR) || ':' || text, '-')) AS leaf, CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS after FROM e),
        l AS (SELECT doc_id, source, leaf, sha256(head || coalesce(CAST(strlen(after) AS VARCHAR) || ':' || after, '-')) AS other,
            row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM f),
        u(level, source, i, hash, n) AS (SELECT 0, source, i, leaf, n FROM l
            UNION ALL SELECT level + 1, source, i // 3, sha256(string_agg(hash, '' ORDER BY i)), (n + 2) // 3 FROM u WHERE n > 1 GROUP BY level, source, i // 3, n),
        s AS (SELECT source, hash AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM u WHERE n = 1),
        r(level, i, hash, n) AS (SELECT 0, i, subroot, n FROM s
            UNION ALL SELECT level + 1, i // 3, sha256(string_agg(hash, '' ORDER BY i)), (n + 2) // 3 FROM r WHERE n > 1 GROUP BY level, i // 3, n),
        a AS (SELECT 0 AS part, level, source, i, hash FROM u WHERE n > 1 UNION ALL SELECT 1, level, NULL, i, hash FROM r WHERE n > 1),
        b AS (SELECT x.part, x.level, x.source, x.i, coalesce(string_agg(y.hash, '' ORDER BY y.i) FILTER (y.i < x.i), '') AS before, coalesce(string_agg(y.hash, '' ORDER BY y.i) FILTER (y.i > x.i), '') AS after
            FROM a x LEFT JOIN a y ON x.part = y.part AND x.level = y.level AND x.source IS NOT DISTINCT FROM y.source AND x.i // 3 = y.i // 3 AND x.i <> y.i GROUP BY x.part, x.level, x.source, x.i),
        p(source, i, part, level, spot, acc, proof) AS (SELECT source, i, 0, 0, i, other, '' FROM l
            UNION ALL (WITH q AS (SELECT p.*, b.before, b.after, s.i AS place FROM p JOIN s ON p.source IS NOT DISTINCT FROM s.source
                LEFT JOIN b ON b.part = p.part AND b.level = p.level AND b.i = p.spot AND (p.part = 1 OR b.source IS NOT DISTINCT FROM p.source))
            SELECT source, i, CASE WHEN before IS NULL THEN part + 1 ELSE part END, CASE WHEN before IS NULL THEN 0 ELSE level + 1 END, CASE WHEN before IS NULL THEN place ELSE spot // 3 END,
                CASE WHEN before IS NULL THEN acc ELSE sha256(before || acc || after) END, proof || coalesce(before || after, '') FROM q WHERE part < 2)),
        t AS (SELECT hash AS root FROM r WHERE n = 1)
        SELECT l.doc_id, l.leaf, s.subroot, t.root, sha256(p.proof) AS proof_sha256, p.acc AS folded_root, p.acc = t.root AS verified
        FROM l JOIN s ON l.source IS NOT DISTINCT FROM s.source JOIN p ON p.part = 2 AND p.source IS NOT DISTINCT FROM l.source AND p.i = l.i, t""",
}
