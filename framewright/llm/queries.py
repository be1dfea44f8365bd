"""One query per operator, over the whole of its table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm import (
    bpe_codec,
    divergence,
    embedding_join,
    html_extract,
    language,
    license_scan,
    manifest,
    merkle,
    mixing,
    ngram_join,
    simple8b,
    token_counts,
    toxicity,
)
from framewright.llm.registry import LLM_QUERIES, llm_query

__all__ = ["LLM_QUERIES"]

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"
END_ID = 2


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@llm_query()
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(BYTE_BPE)
    encoded = bpe_codec.encode(_table(spark, sf_dir, "documents"), path)
    decoded = bpe_codec.decode(encoded, path)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@llm_query()
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(BYTE_BPE)
    counted = token_counts.prefix_counts(_table(spark, sf_dir, "documents"), path)
    n_tokens = token_counts.tokens_of("counts")
    return counted.select(
        "doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > 512).alias("over_limit")
    )


@llm_query()
def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.neighbour_edits(_table(spark, sf_dir, "documents"))


@llm_query("""
    WITH sized AS (
        SELECT doc_id, source,
               len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size
        FROM documents),
    sources AS (
        SELECT source, sum(size)::BIGINT AS source_size,
               (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
                    WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::BIGINT AS weight
        FROM sized GROUP BY source),
    ordered AS (
        SELECT *, row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS place
        FROM sources),
    levels AS (
        SELECT (a.total - coalesce(sum(3 * b.source_size), 0))::DOUBLE
                   / (a.weights - coalesce(sum(b.weight), 0))::DOUBLE AS level
        FROM (SELECT o.place, t.* FROM ordered o,
                     (SELECT sum(source_size) AS total, sum(weight) AS weights FROM ordered) t) a
        LEFT JOIN ordered b ON b.place < a.place
        GROUP BY a.place, a.total, a.weights),
    targets AS (
        SELECT source, source_size,
               least(3 * source_size, weight * (SELECT max(level) FROM levels))::DOUBLE AS target
        FROM ordered),
    rated AS (
        SELECT doc_id, size, source_size, target,
               CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
               ('0x' || substr(md5('mix-1:' || doc_id), 1, 13))::BIGINT / 16.0::DOUBLE ** 13 AS u
        FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source)
    SELECT doc_id, size, source_size, target,
           (size * (floor(rate) + (u < rate - floor(rate))::INT))::BIGINT AS taken
    FROM rated
""")
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.repetitions(_table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


@llm_query()
def op2_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(WORD_BPE)
    written = simple8b.write_ids(_table(spark, sf_dir, "documents"), path, END_ID)
    return simple8b.read_ids(spark, written).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


@llm_query("""
    WITH RECURSIVE words AS (
        SELECT doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\\x20\\x09-\\x0D]+') AS w
        FROM documents),
    shingles AS (
        SELECT DISTINCT doc_id, unnest(
            CASE WHEN len(w) = 0 THEN []
                 WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                 ELSE [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]
            END) AS s
        FROM words),
    sizes AS (
        SELECT doc_id, count(s) AS n FROM documents LEFT JOIN shingles USING (doc_id) GROUP BY doc_id),
    shared AS (
        SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
        FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
        GROUP BY a.doc_id, b.doc_id),
    links AS (
        SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
        WHERE 100 * k >= 75 * (x.n + y.n - k)),
    reached(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a)
    SELECT doc_id, n AS n_shingles, least(doc_id, coalesce(min(b), doc_id)) AS component_id
    FROM sizes LEFT JOIN reached ON a = doc_id GROUP BY doc_id, n
""")
def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_table(spark, sf_dir, "documents"))


@llm_query()
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    machine = toxicity.fitted(documents, _table(spark, sf_dir, "labels"))
    return toxicity.scores(documents, machine).select(
        "doc_id",
        toxicity.held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@llm_query()
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language.fitted(_table(spark, sf_dir, "documents"))
    host = language.host_of(F.col("url"))
    found = F.regexp_extract("html", language.DECLARED, 1)
    return language.identify(
        _table(spark, sf_dir, "pages"),
        model,
        "page_id",
        "html",
        declared=F.when(found != "", found),
        host=host,
        domain=language.domain_of(host),
        suffix=language.suffix_of(host),
        markup=True,
    ).select("page_id", "language", "confidence")


@llm_query("""
    WITH RECURSIVE vectors AS (
        SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL),
    links AS (
        SELECT a.vec_id AS a, b.vec_id AS b
        FROM vectors a JOIN vectors b ON a.label = b.label AND a.vec_id <> b.vec_id
        WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
    reached(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
    least_of AS (SELECT a, min(b) AS b FROM reached GROUP BY a),
    counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
    SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(b, vec_id)) AS component_id,
           vec_id = least(vec_id, coalesce(b, vec_id)) AS kept
    FROM embeddings LEFT JOIN least_of ON least_of.a = vec_id LEFT JOIN counts ON counts.a = vec_id
""")
def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_join.near_duplicates(_table(spark, sf_dir, "embeddings"))


@llm_query()
def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


@llm_query("""
    WITH RECURSIVE parts AS (
        SELECT *, list_reduce(
            list_prepend(4294967295::UBIGINT, flatten(list_transform(
                string_split(doc_id::VARCHAR, ''),
                lambda c: list_prepend(ascii(c)::UBIGINT, list_resize([]::UBIGINT[], 8, 256::UBIGINT))))),
            lambda crc, x: CASE WHEN x < 256 THEN xor(crc, x) WHEN crc & 1 = 1
                                THEN xor(crc >> 1, 3988292384::UBIGINT) ELSE crc >> 1 END) AS crc,
            coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-')
                || coalesce(strlen(source) || ':' || source, '-')
                || coalesce(strlen(lang) || ':' || lang, '-')
                || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
        FROM documents),
    hashed AS (
        SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
               CASE WHEN xor(crc, 4294967295::UBIGINT) % 3 = 0
                    THEN sha256(head || coalesce(strlen(low) || ':' || low, '-')) END AS altered
        FROM parts),
    leaves AS (
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
               count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree
        FROM hashed),
    nodes(tree, level, place, n, node) AS (
        SELECT tree, 0, place, n, leaf FROM leaves
        UNION ALL
        SELECT tree, level + 1, place // 8, (n + 7) // 8, sha256(string_agg(node, '' ORDER BY place))
        FROM nodes WHERE n > 1 GROUP BY tree, level, place // 8, n),
    subroots AS (SELECT tree, node, count(*) OVER () AS n FROM nodes WHERE n = 1),
    tops(level, place, n, node) AS (
        SELECT 0, tree, n, node FROM subroots
        UNION ALL
        SELECT level + 1, place // 8, (n + 7) // 8, sha256(string_agg(node, '' ORDER BY place))
        FROM tops WHERE n > 1 GROUP BY level, place // 8, n),
    beside AS (
        SELECT tree, level, place,
               coalesce(string_agg(node, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a,
               coalesce(string_agg(node, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b
        FROM (SELECT tree, level, place, n, node FROM nodes
              UNION ALL SELECT -1, level, place, n, node FROM tops) WHERE n > 1
        WINDOW w AS (PARTITION BY tree, level, place // 8 ORDER BY place)),
    paths AS (
        SELECT l.tree, l.place, list(a || ',' || b ORDER BY s.tree DESC, s.level) AS path,
               string_agg(a || b, '' ORDER BY s.tree DESC, s.level) AS others
        FROM leaves l JOIN beside s
          ON s.tree = l.tree AND s.place = l.place >> (3 * s.level)
          OR s.tree = -1 AND s.place = l.tree >> (3 * s.level)
        GROUP BY l.tree, l.place),
    proven AS (
        SELECT doc_id, leaf, u.node AS subroot, (SELECT node FROM tops WHERE n = 1) AS root,
               sha256(coalesce(others, '')) AS proof_sha256,
               list_reduce(list_prepend(coalesce(altered, leaf), coalesce(path, [])),
                   lambda h, x: sha256(split_part(x, ',', 1) || h || split_part(x, ',', 2))) AS folded_root
        FROM leaves l LEFT JOIN paths USING (tree, place) JOIN subroots u USING (tree))
    SELECT *, folded_root = root AS verified FROM proven
""")
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    altered = manifest.tampered_leaf(manifest.FIELDS, "doc_id", "text")
    return manifest.manifest(_table(spark, sf_dir, "documents"), altered=altered)


@llm_query("""
    WITH texts AS (
        SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS doc,
               regexp_extract_all(
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
        FROM documents),
    occurring AS (SELECT DISTINCT lang, source FROM texts),
    words AS (SELECT lang, source, doc, unnest(w) AS term FROM texts),
    kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM words
             GROUP BY lang, term HAVING count(DISTINCT doc) >= 3),
    langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(n) AS total FROM kept GROUP BY lang),
    counts AS (SELECT w.lang, w.source, w.term, count(*)::HUGEINT AS n
               FROM words w JOIN kept USING (lang, term) GROUP BY w.lang, w.source, w.term),
    sizes AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source),
    shares AS (
        SELECT o.lang, o.source, k.term, coalesce(c.n, 0) AS n,
               1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (coalesce(s.total, 0) + l.v) AS p,
               1 + (1000000000 * (k.n + 1)) // (l.total + l.v) AS q
        FROM occurring o JOIN kept k USING (lang) JOIN langs l USING (lang)
        LEFT JOIN sizes s ON s.lang = o.lang AND s.source = o.source
        LEFT JOIN counts c ON c.lang = o.lang AND c.source = o.source AND c.term = k.term),
    sums AS (
        SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
        FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
        GROUP BY a.lang, a.source, b.source),
    found AS (
        SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
        FROM occurring a JOIN occurring b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
        UNION ALL
        SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM shares WHERE n > 0 AND p > q),
    ranked AS (
        SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
        FROM found)
    SELECT * FROM ranked WHERE part = 'pair' OR rank <= 200
""")
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


@llm_query()
def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))
