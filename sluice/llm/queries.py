"""Registered queries of the training-data operators, over whole driver tables, with DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block")]


@register("op4_url_rules", """
WITH u AS (SELECT page_id, lower(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '')) AS host,
                  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path, row_number() OVER () AS k FROM pages),
     r(h, p, action) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                                ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
     m AS (SELECT k, h || p AS rule, action, row_number() OVER (PARTITION BY k ORDER BY length(h || p) DESC) AS nth
           FROM u JOIN r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM u LEFT JOIN (FROM m WHERE nth = 1) USING (k)
""")
def op4_url_rules(spark, sf_dir):
    from sluice.llm.url_rules import judge_urls
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


@register("op7_best_fit_packing")
def op7_best_fit_packing(spark, sf_dir):
    import public_tokenizers as P
    from sluice.llm.packing import pack
    return pack(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


@register("op8_weak_supervision")
def op8_weak_supervision(spark, sf_dir):
    from sluice.llm.quality_rules import MEASURES, quality_rules
    return quality_rules(table(spark, sf_dir, "documents"), keep_text=False).select("doc_id", *MEASURES, "base_failed", "kept", "p_good")


@register("op9_warc", """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS raw FROM pages),
     d AS (SELECT page_id, octet_length(raw)::BIGINT AS payload_bytes, sha1(raw) AS payload_digest FROM p),
     m AS (SELECT payload_digest, max(page_id) AS best FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT d.page_id, payload_bytes, d.payload_digest, CASE WHEN best IS NOT DISTINCT FROM d.page_id OR best IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN best IS DISTINCT FROM d.page_id THEN best END AS refers_to
FROM d LEFT JOIN m ON d.payload_digest = m.payload_digest AND d.payload_bytes >= 1000
""")
def op9_warc(spark, sf_dir):
    from sluice.llm.warc import read_warc, write_warc
    from sluice.session import scratch_root
    out = scratch_root(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), out)
    return read_warc(spark, out, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register("op10_recompression", """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
     win AS (SELECT doc_id, i, hash(array_to_string(w[i:i + 12], ' ')) AS g, md5(array_to_string(w[i:i + 12], ' ')) AS f
             FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM d WHERE len(w) >= 13)),
     rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY f) AS least FROM win) WHERE least < doc_id),
     gone AS (SELECT DISTINCT doc_id, i + k AS j FROM rep, (SELECT unnest(generate_series(0, 12)) AS k)),
     lost AS (SELECT doc_id, list(j) AS js FROM gone GROUP BY 1),
     j AS (SELECT doc_id, w, coalesce(js, []) AS js FROM d LEFT JOIN lost USING (doc_id)),
     words AS (SELECT doc_id, unnest(w) AS x, unnest(generate_series(1, len(w))) AS i FROM d),
     kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone ON words.doc_id = gone.doc_id AND words.i = gone.j GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, len(js)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM j LEFT JOIN kept USING (doc_id)
""")
def op10_recompression(spark, sf_dir):
    from sluice.llm.substring_dedup import substring_dedup
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


@register("op2_jaccard_join")
def op2_jaccard_join(spark, sf_dir):
    from sluice.llm.jaccard_join import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents"), links=True)


@register("op1_brown_lm")
def op1_brown_lm(spark, sf_dir):
    from sluice.llm.brown_lm import score_texts
    return score_texts(table(spark, sf_dir, "documents"))


@register("op3_quality_gam")
def op3_quality_gam(spark, sf_dir):
    from sluice.llm.quality_gam import classify
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op5_line_dedup")
def op5_line_dedup(spark, sf_dir):
    from sluice.llm.line_dedup import line_dedup
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.size("runs").alias("n_runs"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


@register("op6_decontamination")
def op6_decontamination(spark, sf_dir):
    from sluice.llm.decontaminate import matches
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op11_baier_runs")
def op11_baier_runs(spark, sf_dir):
    from sluice.llm.periodic_runs import periodic_runs, report, with_planted_runs
    return report(periodic_runs(with_planted_runs(table(spark, sf_dir, "documents"))))


@register("op12_burst_trie", """
WITH t AS (SELECT conv_id, turn, length(coalesce(text, '')) AS chars, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS id
           FROM conversations WHERE conv_id IS NOT NULL),
     k AS (SELECT conv_id, id, chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) AS pos FROM t),
     c AS (SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END)),
                  4294967295::BIGINT) % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
     s AS (SELECT conv_id, pos, id, chars FROM k JOIN c USING (conv_id) WHERE pos > h
           UNION ALL SELECT c.conv_id, pos, id, chars FROM c JOIN k ON k.conv_id = c.conv_id - c.conv_id % 100 WHERE pos <= h),
     m AS (SELECT conv_id, coalesce(ids, []) AS ids, cs FROM c LEFT JOIN (SELECT conv_id, list(id ORDER BY pos) AS ids, list(chars ORDER BY pos) AS cs FROM s GROUP BY 1) USING (conv_id)),
     p AS (SELECT conv_id, d, sha256(array_to_string(ids[1:d], ',')) AS node, CASE WHEN d > 0 THEN sha256(array_to_string(ids[1:d - 1], ',')) END AS parent,
                  CASE WHEN d > 0 THEN cs[d] ELSE 0 END AS chars, len(ids) = d AS ends FROM (SELECT *, unnest(generate_series(0, len(ids))) AS d FROM m)),
     n AS (SELECT node, any_value(d) AS depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
                  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY node),
     ch AS (SELECT parent, count(*) AS n_children FROM n WHERE parent IS NOT NULL GROUP BY 1),
     u AS (SELECT b.node, sum(CASE WHEN ch.parent IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum((n_convs - 1) * n.chars)::BIGINT AS saved_tokens
           FROM n JOIN p b ON b.conv_id = n.conv_id AND b.d <= n.depth LEFT JOIN ch ON ch.parent = n.node GROUP BY 1)
SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, n.ends_sha256
FROM n JOIN u USING (node) LEFT JOIN ch ON ch.parent = n.node LEFT JOIN n up ON up.node = n.parent
""")
def op12_burst_trie(spark, sf_dir):
    from sluice.llm.conversation_trie import prefix_trie, sequences, with_shared_openings
    return prefix_trie(with_shared_openings(sequences(table(spark, sf_dir, "conversations"))))


@register("op13_piece_codec")
def op13_piece_codec(spark, sf_dir):
    import public_tokenizers as P
    from sluice.llm.piece_codec import encode_texts, report
    return report(encode_texts(table(spark, sf_dir, "documents"), P.path("piece_bpe_32k.model")))


register("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
