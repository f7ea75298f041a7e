"""The queries of the training-data operators: each applies its operator to the whole table and derives the digest columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collide, infill, knlm, licenses, lines, omh, phrases, repeats, secrets, site_tree, vantage, warc
from .common import fresh_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return omh.classes(table(spark, sf_dir, "documents"))


def op2_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collide.near_vectors(table(spark, sf_dir, "embeddings"))


def op3_license_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("first_word")


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return knlm.classify(table(spark, sf_dir, "documents"), labels.where("quality <=> 1 AND toxic <=> 0"), labels=labels)


def op5_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.parse(warc.read_archive(spark, path)).drop("payload", "url")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda x: x["kind"] != "literal")
    counts = [secrets.count_of(F.col("secrets"), kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("secrets")).alias("spans"))


def op7_benchmark_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrases.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)
    return found.withColumnRenamed("kept", "kept_sha256")


def op10_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_tree.extract(table(spark, sf_dir, "pages"))


def op11_line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = lines.LineIndex(spark, fresh_path(spark, "lines"))
    index.insert(docs)
    return index.apply(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.fill_in_middle(table(spark, sf_dir, "documents"))


def op13_vantage_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vantage.clusters(table(spark, sf_dir, "embeddings"))
    return found.withColumn("centroid_sha256", F.sha2(F.array_join("centroid", ","), 256)).drop("centroid")


QUERIES = {
    f.__name__: f
    for f in (
        op1_order_minhash, op2_collision_counting, op3_license_windows, op4_kneser_ney, op5_warc_archive, op6_secret_scan, op7_benchmark_phrases,
        op8_byte_bpe, op9_repeated_passages, op10_site_style_tree, op11_line_counts, op12_fill_in_middle, op13_vantage_clusters,
    )
}

#: DuckDB SQL with the same result, where SQL can express it on whole tables.
SQL: dict[str, str] = {
    "op2_collision_counting": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), l AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_cosine_similarity(a.e, b.e) >= 0.93
        ), r(id, c) AS (
            SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.id
        )
        SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, vec_id = c AS kept
        FROM embeddings JOIN (SELECT id AS vec_id, min(c) AS c FROM r GROUP BY id) USING (vec_id)
        LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a) USING (vec_id)
    """,
    "op9_repeated_passages": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), windows AS (
            SELECT doc_id, i, md5(array_to_string(w[i : i + 34], ' ')) AS path FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)
        ), gone AS (
            SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM windows JOIN (SELECT path FROM windows GROUP BY path HAVING count(*) > 1) USING (path)
        ), kept AS (
            SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY p) AS kept
            FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d) LEFT JOIN (SELECT doc_id, p, true AS hit FROM gone) USING (doc_id, p)
            WHERE hit IS NULL GROUP BY doc_id
        )
        SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n_kept, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)
    """,
    "op7_benchmark_phrases": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), b AS (
            SELECT item_id, w, least(13, len(w)) AS size FROM (
                SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
            ) WHERE len(w) > 0
        ), bw AS (
            SELECT DISTINCT item_id, size, array_to_string(w[i : i + size - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM b)
        ), dw AS (
            SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS phrase
            FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM b) AS s WHERE len(w) >= size)
        ), hits AS (
            SELECT doc_id, item_id, i, size FROM dw JOIN bw USING (size, phrase)
        ), words AS (
            SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT doc_id, i, size FROM hits)) GROUP BY doc_id
        ), items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
        )
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
            sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    "op5_warc_archive": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html FROM pages
        ), d AS (
            SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS sha1, min(page_id) OVER (PARTITION BY html) AS first FROM p
        )
        SELECT page_id, payload_bytes,
            array_to_string([
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((('0x' || sha1[1 + 5 * (i // 4) : 5 + 5 * (i // 4)])::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER]
                for i in range(32)
            ], '') AS payload_digest,
            CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> first THEN first END AS refers_to
        FROM d
    """,
}

#: Containment of every template in every run of its words' number, and of the number of words of its scale's windows.
SQL["op3_license_windows"] = """
    WITH t(license_id, own, size, step) AS (VALUES {values}),
    d AS (
        SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents
    ), s AS (
        SELECT row, doc_id, len(w) AS n, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) AS shingles FROM d WHERE len(w) >= 5
    ), near AS (
        SELECT s.*, t.* FROM s, t WHERE list_has_any(shingles, own)
    ), windows AS (
        SELECT row, doc_id, license_id, own, shingles[i : i + size - 5] AS seen FROM (SELECT *, unnest(range(1, n - 3, step)) AS i FROM near)
    )
    SELECT doc_id, license_id, max(len(list_intersect(own, seen)) / len(own)) AS containment
    FROM windows GROUP BY row, doc_id, license_id HAVING max(len(list_intersect(own, seen)) / len(own)) >= 0.8
""".format(
    values=", ".join(f"('{n}', {licenses.template_shingles(t)!r}, {s.words}, {s.step})" for (n, t), s in zip(licenses.NOTICES.items(), licenses.scales(licenses.NOTICES, 0.8, 0.999).values(), strict=True))
)

SQL["op11_line_counts"] = r"""
    WITH l AS (
        SELECT doc_id, i, line, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
        FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)
    ), common AS (
        SELECT k, max(doc_id) AS holder FROM l WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
    ), judged AS (
        SELECT l.*, holder IS NOT NULL AND doc_id <> holder AS gone FROM l LEFT JOIN common USING (k)
    )
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
    FROM judged GROUP BY doc_id
"""

SQL["op12_fill_in_middle"] = r"""
    WITH d AS (
        SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^
]*
|[^
]+') AS u, sha256('7:' || doc_id) AS s FROM documents
    ), h AS (
        SELECT *, ('0x' || s[1:8])::BIGINT % (len(u) + 1) AS h1, ('0x' || s[9:16])::BIGINT % (len(u) + 1) AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM d
    ), f AS (
        SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
            array_to_string(u[1 : least(h1, h2)], '') AS prefix, array_to_string(u[least(h1, h2) + 1 : greatest(h1, h2)], '') AS middle, array_to_string(u[greatest(h1, h2) + 1 : len(u)], '') AS suffix FROM h
    )
    SELECT doc_id, len(u)::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
        sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
    FROM f
"""


def clusters_sql(k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """Each round as two tables: the nearest centroids, and the floors of their means."""
    away = "list_sum(list_transform(list_zip(v, x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    parts = [
        f"""k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: floor({scale} * e::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS c, v AS x FROM k ORDER BY sha256('{seed}:' || vec_id), v LIMIT {k})",
    ]
    nearest = lambda i: f"a{i} AS MATERIALIZED (SELECT r, min((d, c)) AS best FROM (SELECT r, c, {away}::BIGINT AS d FROM k, c{i}) GROUP BY r)"
    for i in range(rounds):
        parts += [
            nearest(i),
            f"m{i} AS (SELECT c, j, sum(e) AS s, count(*) AS n FROM (SELECT best[2] AS c, unnest(v) AS e, generate_subscripts(v, 1) AS j FROM k JOIN a{i} USING (r)) GROUP BY c, j)",
            f"c{i + 1} AS MATERIALIZED (SELECT c, coalesce(y, x) AS x FROM c{i} LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS y FROM m{i} GROUP BY c) USING (c))",
        ]
    parts.append(nearest(rounds))
    return f"""WITH {", ".join(parts)}
        SELECT vec_id, best[2]::INTEGER AS cluster, best[1]::BIGINT AS distance, (sum(best[1]) OVER (PARTITION BY best[2]))::BIGINT AS cluster_inertia, (sum(best[1]) OVER ())::BIGINT AS inertia, sha256(array_to_string(x, ',')) AS centroid_sha256
        FROM k JOIN a{rounds} USING (r) JOIN c{rounds} ON c = best[2]"""


SQL["op13_vantage_clusters"] = clusters_sql()
