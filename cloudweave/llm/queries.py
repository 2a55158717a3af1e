"""The operators' queries: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloudweave.llm import bins, fingerprints, jaccard, packing, passages, pieces, quality, resampling, secret_scan, simhash, substrings, topk, whitening
from cloudweave.llm.common import documents


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(documents(spark, sf_dir))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(documents(spark, sf_dir))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir)).drop("ids")


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.near_passages(documents(spark, sf_dir))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(documents(spark, sf_dir))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(documents(spark, sf_dir))


def op8_id_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bins.digests(documents(spark, sf_dir))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op10_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(documents(spark, sf_dir))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


def op12_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_suffix_array_dedup, op2_secret_scan, op3_packing, op4_top_k, op5_compact_windows, op6_jaccard_join, op7_fingerprints, op8_id_matrices, op9_quality, op10_sentence_pieces, op11_importance_resampling, op12_simhash_golay, op13_whitening, pipeline)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op4_top_k": TOP_K_SQL, "op6_jaccard_join": JACCARD_SQL, "op11_importance_resampling": RESAMPLING_SQL, "op12_simhash_golay": SIMHASH_SQL}


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256.0 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(generate_series(1, len(q.v)), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5
"""

JACCARD_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), links AS (
  SELECT p.x, p.y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2) p
  JOIN sizes m ON m.doc_id = p.x JOIN sizes n ON n.doc_id = p.y WHERE 100 * c >= 75 * (m.n + n.n - c)
), reached AS (
  SELECT doc_id, doc_id AS root FROM documents
  UNION
  SELECT l.y, r.root FROM reached r JOIN links l ON l.x = r.doc_id
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT doc_id, min(root) AS component_id FROM reached GROUP BY 1) c ON c.doc_id = d.doc_id
"""

RESAMPLING_SQL = rf"""
WITH words AS (
  SELECT row_number() OVER () AS k, doc_id, part, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT doc_id, text, 1 AS part FROM documents UNION ALL SELECT NULL, text, 2 FROM benchmark)
), features AS (
  SELECT k, doc_id, part, unnest(list_concat(w, list_transform(generate_series(1, len(w) - 1), lambda i: array_to_string(w[i:i + 1], ' ')), list_transform(generate_series(1, len(w) - 2), lambda i: array_to_string(w[i:i + 2], ' ')))) AS f FROM words
), hashed AS (
  SELECT f, CAST(xor(4294967295, list_reduce(list_transform(generate_series(1, 2 * octet_length(encode(f)) - 1, 2), lambda i: CAST('0x' || substr(hex(encode(f)), i, 2) AS BIGINT)),
    lambda c, b: xor(c >> 8, ({[*map(int, resampling.byte_crcs())]})[xor(c, b) % 256 + 1]), CAST(4294967295 AS BIGINT))) AS BIGINT) % {resampling.BUCKETS} AS bucket
  FROM (SELECT DISTINCT f FROM features)
), placed AS (SELECT k, part, bucket FROM features JOIN hashed USING (f)
), counts AS (SELECT b AS bucket, count(bucket) FILTER (part = 1) AS s, count(bucket) FILTER (part = 2) AS t FROM range({resampling.BUCKETS}) r(b) LEFT JOIN placed ON bucket = b GROUP BY b
), gains AS (SELECT bucket, CAST(floor(1000 * ln((t + 1.0::DOUBLE) * (sum(s) OVER () + {resampling.BUCKETS}) / ((s + 1.0::DOUBLE) * (sum(t) OVER () + {resampling.BUCKETS})))) AS BIGINT) AS gain FROM counts
), weights AS (SELECT k, count(*) AS n, sum(gain) AS weight FROM placed JOIN gains USING (bucket) WHERE part = 1 GROUP BY k
), scored AS (
  SELECT w.k, doc_id, len(w) AS words, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
         CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{resampling.SEED}:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM words w LEFT JOIN weights x ON w.k = x.k WHERE part = 1
), drawn AS (
  SELECT k, row_number() OVER (ORDER BY score DESC, doc_id, n_features) AS rank FROM scored WHERE words >= {resampling.LEAST_WORDS} AND doc_id IS NOT NULL
  QUALIFY rank <= {resampling.PER_CENT} * (count(*) OVER ()) // 100
)
SELECT doc_id, n_features, weight, score, rank FROM scored LEFT JOIN drawn USING (k)
"""


def _xxh64_sql(b: str, n: str, seed: int) -> str:
    """XXH64, as a 128-bit unsigned number, of the list of bytes b of length n."""
    whole, (p1, p2, p3, p4, p5) = 2**64, ((f"{int(p)}::UHUGEINT") for p in simhash.PRIMES)
    times = lambda x, y: f"(({x}) * {y} % {whole}::UHUGEINT)"
    plus = lambda *x: f"(({' + '.join(x)}) % {whole}::UHUGEINT)"
    first = lambda k: f"{k % whole}::UHUGEINT"
    # A rotation names its operand twice, so it goes through a list of one.
    turn = lambda x, r: f"list_transform([{x}], lambda t: (t * {2**r}::UHUGEINT) % {whole}::UHUGEINT + t // {2 ** (64 - r)}::UHUGEINT)[1]"
    shift = lambda x, r, p: f"list_transform([{x}], lambda t: (xor(t, t // {2**r}::UHUGEINT) * {p}) % {whole}::UHUGEINT)[1]"
    lane = lambda at, size=8: " + ".join(f"{b}[{at} + {i + 1}]::UHUGEINT * {256**i}::UHUGEINT" for i in range(size))
    turned = lambda acc, x: times(turn(plus(acc, times(x, p2)), 31), p1)
    P1, P2 = (int(p) for p in simhash.PRIMES[:2])
    starts = (seed + P1 + P2, seed + P2, seed, seed - P1)
    stripes = lambda j: f"list_transform(generate_series(0, {n} // 32 - 1), lambda s: {lane(f'32 * s + {8 * j}')})"
    accs = [f"list_reduce({stripes(j)}, lambda acc, x: {turned('acc', 'x')}, {first(k)})" for j, k in enumerate(starts)]
    merged = f"list_reduce(a, lambda acc, x: {plus(times(f'xor(acc, {turned(first(0), chr(120))})', p1), p4)}, {plus(*(turn(f'a[{j + 1}]', r) for j, r in enumerate((1, 7, 12, 18))))})"
    begun = f"CASE WHEN {n} >= 32 THEN list_transform([[{', '.join(accs)}]], lambda a: {merged})[1] ELSE {first(seed + int(simhash.PRIMES[4]))} END"
    h = plus(begun, f"{n}::UHUGEINT")
    at = f"({n} // 32 * 32)"
    h = f"list_reduce(list_transform(generate_series(0, {n} % 32 // 8 - 1), lambda s: {lane(f'{at} + 8 * s')}), lambda acc, x: {plus(times(turn(f'xor(acc, {turned(first(0), chr(120))})', 27), p1), p4)}, {h})"
    h = f"list_reduce(list_transform(generate_series(0, {n} % 8 // 4 - 1), lambda s: {lane(f'({n} // 8 * 8)', 4)}), lambda acc, x: {plus(times(turn(f'xor(acc, {times(chr(120), p1)})', 23), p2), p3)}, {h})"
    h = f"list_reduce(list_transform(generate_series({n} // 4 * 4 + 1, {n}), lambda s: {b}[s]::UHUGEINT), lambda acc, x: {times(turn(f'xor(acc, {times(chr(120), p5)})', 11), p1)}, {h})"
    h = shift(shift(h, 33, p2), 29, p3)
    return f"list_transform([{h}], lambda t: xor(t, t // {2**32}::UHUGEINT))[1]"


SIMHASH_SQL = rf"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT k, unnest(CASE WHEN len(w) >= 3 THEN list_transform(generate_series(1, len(w) - 2), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words
), bytes AS (
  SELECT s, list_transform(generate_series(1, 2 * octet_length(encode(s)) - 1, 2), lambda i: CAST('0x' || substr(hex(encode(s)), i, 2) AS INTEGER)) AS b, octet_length(encode(s)) AS n FROM (SELECT DISTINCT s FROM shingles)
), hashed AS (SELECT s, {_xxh64_sql("b", "n", simhash.SEED)} AS h FROM bytes
), halves AS (SELECT s, CAST(h // 4294967296::UHUGEINT AS BIGINT) AS high, CAST(h % 4294967296::UHUGEINT AS BIGINT) AS low FROM hashed
), bits AS (
  SELECT k, i, 2 * sum((high >> i) & 1) > count(*) AS high, 2 * sum((low >> i) & 1) > count(*) AS low FROM shingles JOIN halves USING (s), generate_series(0, 31) g(i) GROUP BY 1, 2
), prints AS (
  SELECT w.k, doc_id, CAST(coalesce(sum(CASE WHEN high THEN 1::BIGINT << i ELSE 0 END), 0) AS BIGINT) AS high, CAST(coalesce(sum(CASE WHEN low THEN 1::BIGINT << i ELSE 0 END), 0) AS BIGINT) AS low FROM words w LEFT JOIN bits ON bits.k = w.k GROUP BY 1, 2
), classes AS (SELECT high, low, min(doc_id) AS root FROM prints WHERE doc_id IS NOT NULL GROUP BY 1, 2
), links AS (SELECT a.root AS x, b.root AS y FROM classes a JOIN classes b ON a.root <> b.root AND bit_count(xor(a.high, b.high)) + bit_count(xor(a.low, b.low)) <= {simhash.ERRORS}
), reached AS (
  SELECT root AS id, root FROM classes
  UNION
  SELECT l.y, r.root FROM reached r JOIN links l ON l.x = r.id
)
SELECT doc_id, format('{{:08x}}{{:08x}}', p.high, p.low) AS fingerprint, component_id
FROM prints p JOIN classes c ON p.high = c.high AND p.low = c.low JOIN (SELECT id, min(root) AS component_id FROM reached GROUP BY 1) m ON m.id = c.root
"""
