"""The contract queries of the ten operators and the pipeline.

Each thin ``opN_<name>(spark, sf_dir)`` applies its operator, with production
parameters, to the whole of its table and derives the digest columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.llm.common import table

URL_RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def pii_key(spark: SparkSession) -> str:
    """The secret of the surrogates, from the session; the same surrogates come back only with the same secret."""
    return spark.conf.get("spark.inkloom.surrogates.key", "no secret: set spark.inkloom.surrogates.key")


def op1_pq_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkloom.llm.pq_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkloom.llm.mil_quality import judged

    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkloom.llm.hash_search import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkloom.llm.suffix_dedup import dedup

    return dedup(table(spark, sf_dir, "documents"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkloom.llm.jaccard_join import similar

    return similar(table(spark, sf_dir, "documents"))


def op6_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    from inkloom.llm import warc
    from inkloom.llm.common import settle, shared_dir

    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    manifest = settle(warc.write_archives(warc.plan_records(table(spark, sf_dir, "pages")), folder), "manifest")
    read = warc.read_archives(manifest.repartition(spark.sparkContext.defaultParallelism * 2), payloads=False)
    number = lambda c: F.expr(f"try_cast(substring({c}, 10) as bigint)")  # noqa: E731  after urn:page:
    return read.where("gap is null").select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to")
    )


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkloom.llm.mixing import taken

    return taken(table(spark, sf_dir, "documents"))


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkloom.llm.surrogates import anonymise

    return anonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), pii_key(spark))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from inkloom.llm.bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkloom.llm.url_templates import judge_urls

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "template")


def op11_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from inkloom.llm.piece_bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkloom.llm.merkle import hex_of, manifest, proof_digest

    docs = table(spark, sf_dir, "documents")
    hit = F.coalesce(F.crc32(docs["doc_id"].cast("string").cast("binary")) % 7 == 0, F.lit(False))
    n_chars = docs["n_chars"].cast("decimal(20,0)")
    claimed = [docs["doc_id"], docs["source"], docs["lang"], F.when(hit, n_chars + 1).otherwise(n_chars), docs["text"]]
    x = manifest(docs, claimed=claimed)
    digests = [hex_of(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")]
    return x.select("doc_id", *digests, proof_digest(F.col("path")).alias("proof_sha256"), hex_of(F.col("claimed_root")).alias("folded_root"), "verified")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkloom.llm.whitening import integers, whiten

    x = integers(table(spark, sf_dir, "embeddings"), scale=1024, shift=100_000)
    return whiten(x, components=8).withColumn("deviation", F.col("deviation").cast("long"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


COMPONENTS = """r(n, c) AS (SELECT id, id FROM nodes UNION SELECT e.b, r.c FROM r JOIN e ON r.n = e.a WHERE r.c < e.b),
            low AS (SELECT n, min(c) AS component_id FROM r GROUP BY n)"""


def manifest_sql() -> str:
    """Both trees level by level, then every leaf's way up: through its language's tree and the one above."""
    coded = lambda c: f"coalesce(octet_length(encode({c})) || ':' || {c}, '-')"
    leaf = lambda n: f"sha256({' || '.join(map(coded, ('id', 'source', 'lang', n, 'text')))})"
    parent = lambda t: f"sha256(CASE WHEN {t}.i % 2 = 1 THEN coalesce(s.h, '') || {t}.x ELSE {t}.x || coalesce(s.h, '') END)"
    return f"""
        WITH RECURSIVE d AS (SELECT doc_id, source, lang, n_chars, text, row_number() OVER () AS r FROM documents),
            v AS (SELECT *, CAST(doc_id AS VARCHAR) AS id, CAST(n_chars AS VARCHAR) AS n FROM d),
            crc AS (SELECT r, coalesce(xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(id, ''), lambda c: CAST(ascii(c) AS BIGINT)),
                lambda a, b: list_reduce([xor(a, b)] || list_transform(range(8), lambda i: CAST(i AS BIGINT)), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, CAST(3988292384 AS BIGINT)) ELSE x // 2 END)), CAST(4294967295 AS BIGINT)) % 7 = 0, false) AS hit FROM v),
            e AS (SELECT v.*, CASE WHEN hit THEN CAST(n_chars + 1 AS VARCHAR) ELSE n END AS n2 FROM v JOIN crc USING (r)),
            leaves AS (SELECT r, doc_id, lang, {leaf('n')} AS leaf, {leaf('n2')} AS claim FROM e),
            placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves),
            nodes AS (
                SELECT lang, 0 AS level, i, leaf AS h, count(*) OVER (PARTITION BY lang) AS size FROM placed
                UNION ALL
                SELECT lang, level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (size + 1) // 2 FROM nodes WHERE size > 1 GROUP BY lang, level, size, i // 2),
            subroots AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS j FROM nodes WHERE size = 1),
            tops AS (
                SELECT 0 AS level, j AS i, subroot AS h, count(*) OVER () AS size FROM subroots
                UNION ALL
                SELECT level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (size + 1) // 2 FROM tops WHERE size > 1 GROUP BY level, size, i // 2),
            steps AS (
                SELECT lang, level, i, size, h FROM nodes WHERE size > 1),
            walk AS (
                SELECT r, lang, 0 AS level, i, claim AS x, '' AS proof FROM placed
                UNION ALL
                SELECT w.r, w.lang, w.level + 1, w.i // 2, {parent('w')}, w.proof || coalesce(s.h, '')
                FROM walk w JOIN (SELECT DISTINCT lang, level FROM steps) t ON t.lang IS NOT DISTINCT FROM w.lang AND t.level = w.level
                LEFT JOIN steps s ON s.lang IS NOT DISTINCT FROM w.lang AND s.level = w.level AND s.i = xor(w.i, 1)),
            ends AS (SELECT w.r, w.lang, w.x, w.proof FROM walk w WHERE NOT EXISTS (SELECT 1 FROM steps t WHERE t.lang IS NOT DISTINCT FROM w.lang AND t.level = w.level)),
            climb AS (
                SELECT r, 0 AS level, j AS i, x, proof FROM ends JOIN subroots s ON s.lang IS NOT DISTINCT FROM ends.lang
                UNION ALL
                SELECT c.r, c.level + 1, c.i // 2, {parent('c')}, c.proof || coalesce(s.h, '')
                FROM climb c JOIN (SELECT DISTINCT level FROM tops WHERE size > 1) t ON t.level = c.level LEFT JOIN tops s ON s.level = c.level AND s.i = xor(c.i, 1)),
            done AS (SELECT r, x, proof FROM climb WHERE level = (SELECT max(level) FROM tops))
        SELECT p.doc_id, p.leaf, s.subroot, root.h AS root, sha256(done.proof) AS proof_sha256, done.x AS folded_root, done.x = root.h AS verified
        FROM placed p JOIN done USING (r) JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang, (SELECT h FROM tops WHERE size = 1) root"""


def oracle_sql() -> dict[str, str]:
    """SQL for operators whose results are exact: plain comparison of all pairs, or of all strings, where the tables are small."""
    return {
        "op1_pq_near_dedup": f"""
            WITH RECURSIVE v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
            nodes AS (SELECT id FROM v),
            ok AS (SELECT * FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(x) > 0 AND len([c for c in x if c IS NULL OR NOT isfinite(c)]) = 0 AND list_dot_product(x, x) > 0),
            e AS (SELECT p.id AS a, q.id AS b FROM ok p JOIN ok q ON p.label = q.label AND p.id <> q.id AND len(p.x) = len(q.x) WHERE list_cosine_similarity(p.x, q.x) >= 0.93),
            {COMPONENTS},
            links AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
            SELECT id AS vec_id, coalesce(n_links, 0) AS n_links, component_id, component_id = id AS kept FROM nodes JOIN low ON low.n = id LEFT JOIN links ON links.a = id""",
        "op4_suffix_dedup": """
            WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n_bytes FROM documents),
            s AS (SELECT doc_id, unnest(range(0, n_bytes - 199)) AS i, h FROM d WHERE n_bytes >= 200),
            k AS (SELECT doc_id, i, md5(substr(h, CAST(2 * i + 1 AS BIGINT), 400)) AS m FROM s),
            again AS (SELECT doc_id, i FROM k QUALIFY count(*) OVER (PARTITION BY m) > 1),
            b AS (SELECT doc_id, unnest(range(0, n_bytes)) AS i FROM d),
            t AS (SELECT b.doc_id, b.i, max(again.i) OVER (PARTITION BY b.doc_id ORDER BY b.i) AS last FROM b LEFT JOIN again ON again.doc_id = b.doc_id AND again.i = b.i),
            g AS (SELECT *, coalesce(i - last < 200, false) AS gone FROM t),
            f AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins FROM g),
            w AS (SELECT f.doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans, coalesce(string_agg(substr(d.h, CAST(2 * f.i + 1 AS BIGINT), 2), '' ORDER BY f.i) FILTER (NOT gone), '') AS kept
              FROM f JOIN d USING (doc_id) WHERE f.doc_id IN (SELECT doc_id FROM again) GROUP BY f.doc_id)
            SELECT d.doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN w USING (doc_id)""",
        "op5_jaccard_join": f"""
            WITH RECURSIVE d AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
            nodes AS (SELECT id FROM d),
            s AS (SELECT id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i : i + 4], ' ') for i in range(1, len(w) - 3)] END) AS sh FROM d),
            n AS (SELECT id, len(sh) AS n_shingles FROM s),
            x AS (SELECT id, unnest(sh) AS g FROM s),
            p AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM x a JOIN x b ON a.g = b.g AND a.id < b.id GROUP BY 1, 2),
            half AS (SELECT p.a, p.b FROM p JOIN n na ON na.id = p.a JOIN n nb ON nb.id = p.b WHERE 100 * k >= 80 * (na.n_shingles + nb.n_shingles - k)),
            e AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
            {COMPONENTS}
            SELECT id AS doc_id, CAST(n_shingles AS BIGINT) AS n_shingles, component_id FROM n JOIN low ON low.n = id""",
        "op6_warc_salvage": """
            WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
            q AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha256(h) AS payload_digest FROM p),
            r AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM q)
            SELECT page_id, payload_bytes, payload_digest,
                CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
                CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
            FROM r""",
        "op12_merkle_manifest": manifest_sql(),
    }
