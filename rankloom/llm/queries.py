"""Queries of the operators on their whole tables, with SQL where SQL can state the result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import curves, exact, hilbert, minhash, mixing, phrases, pieces, pii, repair, suffix, toxicity, warc, whitening
from .common import table

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


@query(
    "op1_minhash_near_dedup",
    r"""
    WITH RECURSIVE docs AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x20\x09-\x0D]+') AS w FROM documents),
    sets AS (
        SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END)) AS shingle FROM docs),
    sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
    shared AS (SELECT row_number() OVER () AS id, list(doc_id) AS docs FROM sets GROUP BY shingle HAVING count(*) > 1),
    uses AS (SELECT id, unnest(docs) AS doc_id FROM shared),
    met AS (
        SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM uses a JOIN uses b ON a.id = b.id AND a.doc_id < b.doc_id
        GROUP BY a.doc_id, b.doc_id),
    half AS (
        SELECT a, b FROM met JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * met.n >= 85 * (p.n + q.n - met.n)),
    links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
    roots AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
    SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, component_id = d.doc_id AS kept
    FROM documents d JOIN roots r ON d.doc_id = r.doc_id LEFT JOIN sizes s ON d.doc_id = s.doc_id
    """,
)
def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_groups(table(spark, sf_dir, "documents"), width=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query("op2_ordinal_toxicity")
def ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    found = toxicity.with_severity(docs, model, keep=["doc_id"])
    return found.select("doc_id", F.round("severity", 6).alias("severity"), (F.col("severity") >= toxicity.LIMIT).alias("toxic"))


@query("op3_repair_shards")
def repair_shards(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    found = repair.round_trip(table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("word_bpe_49k.json"), end=2)
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


@query("op4_hilbert_shards")
def hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = hilbert.sharded(docs, hilbert.document_dims(docs), shards=16)
    law, grown = F.lit("rows").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return found.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown, "place")


@query("op5_lattice_pieces")
def lattice_pieces(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    vocabulary = pieces.Pieces.load(model or public_tokenizers.path("piece_bpe_32k.model"))
    found = pieces.decode(pieces.encode(table(spark, sf_dir, "documents"), vocabulary), vocabulary)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


@query(
    "op6_repeated_strings",
    """
    WITH docs AS (SELECT doc_id, encode(coalesce(text, '')) AS raw, hex(encode(coalesce(text, ''))) AS x FROM documents),
    starts AS (SELECT doc_id, raw, unnest(range(0, octet_length(raw) - 199)) AS pos FROM docs WHERE octet_length(raw) >= 200),
    windows AS (SELECT doc_id, pos, md5(array_slice(raw, pos + 1, pos + 200)) AS w FROM starts),
    again AS (SELECT doc_id, pos FROM windows WHERE w IN (SELECT w FROM windows GROUP BY w HAVING count(*) > 1)),
    steps AS (SELECT *, pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS gap FROM again),
    runs AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM steps),
    spans AS (SELECT doc_id, min(pos) AS a, max(pos) + 200 AS b FROM runs GROUP BY doc_id, run),
    gaps AS (
        SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM spans),
    kept AS (
        SELECT g.doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans,
            string_agg(substr(x, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS rest
        FROM gaps g JOIN docs d ON g.doc_id = d.doc_id GROUP BY g.doc_id)
    SELECT d.doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
        coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(rest, x))) AS kept_sha256
    FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id
    """,
)
def repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.without_repeats(table(spark, sf_dir, "documents"))


@query(
    "op7_content_addressed_warc",
    """
    WITH pages AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    facts AS (
        SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS payload_digest,
            max(page_id) OVER (PARTITION BY html) AS response FROM pages),
    typed AS (SELECT *, payload_bytes >= 1000 AND page_id <> response AS again FROM facts)
    SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
        CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN response END AS refers_to
    FROM typed
    """,
)
def content_addressed_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archived(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query(
    "op8_weighted_mix",
    r"""
    WITH docs AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
            md5(coalesce(text, '')) AS digest
        FROM documents),
    quality AS (
        SELECT doc_id, max(CASE quality WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END) AS weight FROM labels GROUP BY doc_id),
    keyed AS (
        SELECT d.*, -ln((('0x' || substr(md5(concat('42|', coalesce(d.doc_id::VARCHAR, ''), '|', coalesce(source, ''), '|', digest)), 1, 13))::BIGINT + 0.5)
            / 4503599627370496.0::DOUBLE) / coalesce(weight, 1.0::DOUBLE) AS key
        FROM docs d LEFT JOIN quality q ON d.doc_id = q.doc_id),
    sizes AS (
        SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1 AS place
        FROM docs GROUP BY source),
    ranked AS (
        SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][place % 3 + 1] AS weight, 2.0::DOUBLE * source_size AS cap,
            1.5::DOUBLE * sum(source_size) OVER () AS budget FROM sizes),
    filled AS (
        SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ranked),
    level AS (SELECT min_by(level, (cap / weight, place)) AS rest FROM filled WHERE cap > level * weight),
    goal AS (
        SELECT source, source_size, CASE WHEN cap <= f.level * weight THEN cap ELSE least(cap, rest * weight) END AS target
        FROM filled f CROSS JOIN level),
    parts AS (
        SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM goal),
    placed AS (
        SELECT k.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM keyed k)
    SELECT doc_id, size, source_size, round(target, 6) AS target,
        (epochs * size + greatest(0, least(size, round(target - epochs * source_size)::BIGINT - start)))::BIGINT AS taken
    FROM placed p JOIN parts g ON p.source IS NOT DISTINCT FROM g.source
    """,
)
def weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    quality = mixing.label_quality(table(spark, sf_dir, "labels"))
    found = mixing.mix(table(spark, sf_dir, "documents"), quality)
    return found.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


@query("op9_shifted_curves")
def shifted_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


@query(
    "op10_block_naming_dedup",
    r"""
    WITH docs AS (
        SELECT doc_id, coalesce(text, '') AS raw, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
    grouped AS (
        SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(raw) DESC, doc_id NULLS LAST) AS keep_id,
            count(*) OVER (PARTITION BY norm) AS group_size FROM docs)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM grouped
    """,
)
def block_naming_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.exact_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query(
    "op11_phrase_collocations",
    r"""
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS p FROM documents),
    words AS (SELECT lang, regexp_extract_all(p, '[^ 	]+') AS w FROM pieces),
    grams AS (
        SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
        FROM words, (VALUES (1), (2), (3), (4), (5)) t(m) WHERE len(w) >= m),
    f AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY lang, m, phrase),
    sizes AS (SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY lang),
    found AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 100),
    cuts AS (SELECT *, unnest(range(1, m)) AS k FROM found),
    scored AS (
        SELECT c.lang, c.m, c.phrase, a, k, l.f AS l, r.f AS r, n, (1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f) AS score
        FROM cuts c JOIN f l ON l.lang = c.lang AND l.m = k AND l.phrase = array_to_string(w[1:k], ' ')
        JOIN f r ON r.lang = c.lang AND r.m = c.m - k AND r.phrase = array_to_string(w[k + 1:], ' ') JOIN sizes s ON s.lang = c.lang),
    best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    covered AS (
        SELECT DISTINCT s.lang, s.phrase FROM found s JOIN found q
        ON q.lang = s.lang AND q.m > s.m AND 100 * q.a >= 100 * s.a AND contains(concat(' ', q.phrase, ' '), concat(' ', s.phrase, ' '))),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank
        FROM best b WHERE NOT EXISTS (SELECT 1 FROM covered c WHERE c.lang = b.lang AND c.phrase = b.phrase))
    SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
    FROM ranked WHERE rank <= 2000
    """,
)
def phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


@query("op12_candidate_boosting")
def candidate_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


@query("op13_refined_whitening")
def refined_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=32)
