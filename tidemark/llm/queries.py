"""The registered queries of this subpackage. Each runs its operator over its whole table with production parameters."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, hamming, lines, negatives, packing, passages, quality, secrets, simhash, sketches, toxicity
from .common import read


def op1_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest other rows of each embedding whose vec_id is divisible by 20, by Hamming distance of sign codes."""
    codes = hamming.binary_codes(read(spark, sf_dir, "embeddings"))
    return hamming.top_k(codes, codes.where("id % 20 = 0"), k=10)


def op2_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best-fit packed sequences of all documents: id matrix rows, cumulative segment lengths, position resets."""
    return packing.pack_best_fit(read(spark, sf_dir, "documents"))


def op3_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in near-equal windows of at most 2048 ids."""
    return packing.pack_balanced(read(spark, sf_dir, "documents"), with_ids=False)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every document."""
    return toxicity.scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that near-repeat across documents, each linked to the first document that has it."""
    return passages.repeated_passages(read(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines of chunks that came before, and how many went."""
    out = lines.deduplicated(read(spark, sf_dir, "documents"), counts=True)
    return out.select("doc_id", "text", "removed_chunks", "removed_lines")


def op7_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document."""
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op8_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, from a ledger that has all blobs under the rules as they were before: the second scan takes
    only the pairs of a blob and a rule version that are new."""
    docs, ledger = read(spark, sf_dir, "documents"), secrets.new_ledger(spark)
    where = secrets.paths(docs)
    ledger.scan(docs, secrets.EARLIER_RULES, where)
    found = ledger.scan(docs, where=where)
    # filter() gives a function of two parameters the place as the second, so the rank is bound outside
    counted = lambda rank: F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")
    count = {f"n_{kind}": counted(rank) for rank, kind in enumerate(secrets.BASE)}
    base = secrets.as_string(F.filter("spans", lambda s: s["rank"] < len(secrets.BASE)))
    return found.select("doc_id", *[c.alias(n) for n, c in count.items()], F.sha2(base, 256).alias("base_sha256"), secrets.as_string(F.col("spans")).alias("spans"))


def op9_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, their likeness, and how much of the one the other contains."""
    rows = sketches.fingerprints(read(spark, sf_dir, "documents"))
    own, edited, after = F.col("sketch"), F.col("edited_sketch"), F.col("next_sketch")
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        sketches.as_string(own).alias("fingerprint"),
        sketches.as_string(edited).alias("edited_fingerprint"),
        sketches.likeness(own, edited).alias("near_edited"),
        sketches.likeness(own, after).alias("near_next"),
        sketches.containment(edited, own).alias("edited_contained"),
        sketches.containment(after, own).alias("next_contained"),
    )


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and what they decode to, as digests."""
    return bpe.encoded(read(spark, sf_dir, "documents"), with_ids=False)


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster and squared distance of every vector of 64 components, after 10 rounds from 8 first centroids."""
    rows, final, sums = centroids.clustered(centroids.prepared(read(spark, sf_dir, "embeddings")), k=8, rounds=10, salt="3:")
    # a row for each cluster, so all that it says is a literal; without any there are no rows
    of_cluster = lambda values, kind: F.get(F.array(*[F.lit(x) for x in values or [None]]), F.col("cluster")).cast(kind)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in final]
    return rows.select(F.col("id").alias("vec_id"), "cluster", "distance", of_cluster(sums, "long").alias("cluster_inertia"), F.lit(sum(sums)).cast("long").alias("inertia"), of_cluster(digests, "string").alias("centroid_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hardest negatives of each positive of the embeddings whose vec_id is divisible by 50; every seventh label is changed."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mined(negatives.prepared(read(spark, sf_dir, "embeddings"), label=label), F.col("id") % 50 == 0)


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score of every document."""
    return quality.scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py, one after the other."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_hamming_topk, op2_packed_sequences, op3_balanced_packing, op4_toxicity, op5_repeated_passages, op6_line_dedup, op7_simhash_groups, op8_secret_ledger, op9_scaled_sketch, op10_byte_bpe, op11_centroid_clusters, op12_hard_negatives, op13_quality, pipeline)}

_CODES = """
signs AS (
  SELECT vec_id AS id, list_transform(generate_series(0, 63), lambda i: coalesce(list_sum(list_transform(generate_series(i + 1, greatest(len(embedding), i + 1), 64), lambda j: coalesce(embedding[j], 0)::DOUBLE)), 0) > 0) AS s
  FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
), bits AS (
  SELECT DISTINCT id, array_to_string(list_transform(s, lambda x: CASE WHEN x THEN '1' ELSE '0' END), '')::BIT AS code FROM signs
)"""



def _clusters(rounds: int = 10) -> str:
    """Lloyd's rounds, one after the other, with every distance computed."""
    steps = [
        """kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: coalesce(isfinite(x::DOUBLE), false))) = 64
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS c, v AS m FROM kept QUALIFY c < 8
)"""
    ]
    for n in range(rounds + 1):
        steps.append(f"""a{n} AS MATERIALIZED (
  SELECT r, vec_id, v, c, list_sum(list_transform(generate_series(1, 64), lambda i: (v[i] - m[i]) * (v[i] - m[i])))::BIGINT AS d FROM kept, c{n}
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1
)""")
        if n < rounds:
            steps.append(f"""s{n} AS (
  SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(generate_series(1, 64)) AS i FROM a{n}) GROUP BY c, i
), n{n} AS (
  SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS m FROM s{n} GROUP BY c
), c{n + 1} AS MATERIALIZED (
  SELECT c{n}.c, coalesce(n{n}.m, c{n}.m) AS m FROM c{n} LEFT JOIN n{n} USING (c)
)""")
    return f"""
WITH {", ".join(steps)}
SELECT vec_id, a.c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} USING (c)"""


ORACLE_SQL = {
    "op11_centroid_clusters": _clusters(),
    "op12_hard_negatives": """
WITH kept AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: coalesce(isfinite(x::DOUBLE), false))) = len(embedding)
), scored AS (
  SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, list_sum(list_transform(generate_series(1, len(a.v)), lambda i: a.v[i] * b.v[i]))::BIGINT AS score
  FROM kept a JOIN kept b ON a.id <> b.id WHERE a.id % 50 = 0
), positive AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id))::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN scored USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3""",
    "op1_hamming_topk": f"""
WITH {_CODES}, near AS (
  SELECT q.id AS query_id, b.id AS neighbor_id, bit_count(xor(q.code, b.code))::INTEGER AS distance
  FROM bits q JOIN bits b ON q.id <> b.id WHERE q.id % 20 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM near
)
SELECT query_id, rank::INTEGER AS rank, neighbor_id, distance FROM ranked WHERE rank <= 10""",
}
