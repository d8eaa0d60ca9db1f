"""The registered queries ``opN_<name>`` over the corpus tables: each calls
its operator with production parameters on whole tables and derives the
contract's columns from the operator's own output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (chat, decontam, divergence, mixing, orchard, pages, quality, sentencepiece_bpe, sharding, simhash, spans, topk,
               toxicity)
from .common import table


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    """A vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"), 64)
    return topk.search(vectors, F.col("vec_id") % 20 == 0, 20)


OP1_SQL = """
WITH e AS (
  SELECT vec_id, embedding FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM e),
s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pages.extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = r"\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(
        spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                              F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                              F.lit(probe).alias("text")))
    back = chat.read_back(chat.windows(rows))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
                       F.length("loss_text").cast("long").alias("loss_chars"),
                       F.sha2(F.col("loss_text"), 256).alias("loss_sha256"), "formatted_chars")


OP3_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, '### ' || replace(replace(replace(replace(role, '\', '\b'), '#', '\h'), '<', '\l'), ':', '\c') || ': '
            || replace(replace(replace(text, '\', '\b'), '#', '\h'), '<', '\l') || '</turn>' || chr(10) AS line FROM c),
t AS (
  SELECT *, turn // 64 AS blk, CAST(ceil(strlen(line) / 4) AS BIGINT) AS tokens FROM e),
u AS (
  SELECT *, CAST(sum(tokens) OVER (PARTITION BY conv_id, blk ORDER BY turn, role, tokens, text ROWS UNBOUNDED PRECEDING) AS BIGINT)
            - tokens AS before, CAST(sum(tokens) OVER (PARTITION BY conv_id, blk) AS BIGINT) AS total,
         blk = min(blk) OVER (PARTITION BY conv_id) AS first FROM t),
b AS (SELECT *, first AND before = 0 AND role = 'system' AS system FROM u),
p AS (SELECT conv_id, greatest(2048 - 256 - coalesce(max(tokens) FILTER (system), 0), 512) AS step FROM b GROUP BY conv_id),
w AS (
  SELECT b.*, 2 * (before // step) + CASE WHEN (before + tokens - 1) // step > before // step THEN 1 ELSE 0 END AS w
  FROM b JOIN p ON p.conv_id IS NOT DISTINCT FROM b.conv_id),
s AS (SELECT conv_id, blk, w, first, min(before) AS start FROM w GROUP BY ALL),
n AS (SELECT conv_id, blk, lead(blk) OVER (PARTITION BY conv_id ORDER BY blk) AS next FROM (SELECT DISTINCT conv_id, blk FROM t)),
shown AS (
  SELECT conv_id, length(line) AS n FROM w
  UNION ALL SELECT w.conv_id, length(line) FROM w JOIN s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.blk = w.blk
    AND NOT system AND start BETWEEN before + tokens AND before + 256
  UNION ALL SELECT w.conv_id, length(line) FROM w JOIN n ON n.conv_id IS NOT DISTINCT FROM w.conv_id AND n.blk = w.blk
    JOIN s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.blk = n.next AND NOT system AND total - before + start <= 256
  UNION ALL SELECT w.conv_id, length(line) FROM w JOIN s ON s.conv_id IS NOT DISTINCT FROM w.conv_id
    AND system AND (start > 0 OR NOT s.first)),
f AS (SELECT conv_id, CAST(sum(n) AS BIGINT) AS formatted_chars FROM shown GROUP BY conv_id),
d AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS told,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss
  FROM c GROUP BY conv_id)
SELECT d.conv_id, n_turns, sha256(told) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
FROM d JOIN f ON f.conv_id IS NOT DISTINCT FROM d.conv_id
"""


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.components(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sentencepiece_bpe.tokenize(table(spark, sf_dir, "documents"), tokenizer_path())
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                      F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spans.duplicates(table(spark, sf_dir, "documents"))
    chars = F.aggregate("removed", F.lit(0), lambda n, r: n + r["chars"])
    return out.select("doc_id", "n_sentences", chars.alias("removed_chars"), "removed", "kept_in", "text")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents")).select("doc_id", "slot", "shard")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, books = orchard.compress(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", orchard.hex_code("code").alias("code"), "error", "label_error",
                      F.lit(orchard.books_sha256(books)).alias("codebooks_sha256"))


def op11_sql(parts: int = 8, width: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """The codes in DuckDB SQL, every distance computed; for vectors of
    ``parts * width`` components."""
    d = " + ".join(f"(x[{i}] - c[{i}]) * (x[{i}] - c[{i}])" for i in range(1, width + 1))
    mean = ", ".join(f"(sum(x[{i}]) - ((sum(x[{i}]) % count(*)) + count(*)) % count(*)) // count(*)" for i in range(1, width + 1))
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (
          SELECT r, part, min({{'d': {d}, 'e': entry}}) AS best FROM p JOIN b{k} USING (part) GROUP BY r, part)""")
        if k < rounds:
            steps.append(f"""b{k + 1} AS MATERIALIZED (
          SELECT part, entry, coalesce(m, c) AS c FROM b{k} LEFT JOIN (
            SELECT part, best.e AS entry, CAST([{mean}] AS BIGINT[]) AS m FROM a{k} JOIN p USING (r, part) GROUP BY part, best.e)
          USING (part, entry))""")
    return f"""
    WITH e AS (
      SELECT vec_id, label, [CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    k AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS r FROM e),
    p AS MATERIALIZED (SELECT r, part, v[part * {width} + 1 : (part + 1) * {width}] AS x FROM k, (SELECT unnest(range({parts})) AS part)),
    b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, x AS c FROM p WHERE r <= {entries}),
    {", ".join(steps)},
    s AS (
      SELECT r, string_agg(lpad(format('{{:x}}', best.e), 2, '0'), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error
      FROM a{rounds} GROUP BY r),
    h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds}),
    l AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM s JOIN k USING (r) GROUP BY label)
    SELECT k.vec_id, s.code, s.error, l.label_error, h.codebooks_sha256
    FROM k JOIN s USING (r) JOIN l ON l.label IS NOT DISTINCT FROM k.label, h"""


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (
  SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
c AS MATERIALIZED (SELECT w.lang, source, w.term, count(*) AS n FROM w JOIN k ON k.lang = w.lang AND k.term = w.term GROUP BY ALL),
g AS MATERIALIZED (
  SELECT d.lang, d.source, coalesce(any_value(t.total), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM d) d
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL) t ON t.lang = d.lang AND t.source = d.source GROUP BY ALL),
p AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 2)) // (g.total + 2 * l.v) AS p,
         1 + (CAST(1000000000 AS HUGEINT) * (k.n + 2)) // (l.total + 2 * l.v) AS q
  FROM g JOIN l ON l.lang = g.lang JOIN k ON k.lang = g.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (
  SELECT a.lang, a.source, b.source AS item, CAST(sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS BIGINT) AS value
  FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value FROM p WHERE n > 0 AND p > q),
r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10
"""


QUERIES = {f.__name__: f for f in (
    op1_topk, op2_html, op3_chat, op4_decontamination, op5_simhash, op6_toxicity, op7_quality, op8_sentencepiece,
    op9_substring_dedup, op10_sharding, op11_vector_codes, op12_mixing, op13_divergence)}
ORACLES = {"op1_topk": OP1_SQL, "op3_chat": OP3_SQL, "op10_sharding": sharding.placement_sql(), "op11_vector_codes": op11_sql(),
           "op13_divergence": OP13_SQL}
