"""Registered queries of this package: name -> (query, oracle SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.llm.common import read


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyward.llm.embedding_dedup import near_duplicate_vectors

    return near_duplicate_vectors(read(spark, sf_dir, "embeddings"), 0.98)


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(low.m, vec_id)) AS component_id,
       vec_id <= coalesce(low.m, vec_id) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN low ON low.a = vec_id
"""


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyward.llm.decontaminate import find_leaks

    return find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyward.llm.licenses import scan_licenses

    names = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    base = F.col("base.label")
    return scan_licenses(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base.word").alias("first_word"),
        F.array_max("base.word").alias("last_word"), names(base).alias("base_labels"),
        names(F.concat(base, F.col("detections.label"))).alias("labels"), "score")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyward.llm.url_filter import judge_urls

    return judge_urls(read(spark, sf_dir, "pages"))


def _op4_sql() -> str:
    from tallyward.llm.url_filter import ALPHABET, ORDER, PAD, RULES, STRENGTH

    def fits(rule: str) -> str:
        host, slash, path = rule.partition("/")
        return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash}{path}'))"

    longest = sorted(RULES, key=lambda r: -len(r[1]))
    rule = "CASE " + " ".join(f"WHEN {fits(t)} THEN '{t}'" for _, t in longest) + " END"
    ruled = "CASE " + " ".join(f"WHEN {fits(t)} THEN '{v}'" for v, t in longest) + " END"
    levels, below = [], ""
    for n in range(ORDER + 1):
        skip = ORDER - n
        share = f"1.0::DOUBLE / {ALPHABET}"
        a, b = (share, share) if n == 0 else ("s.pa", "s.pb")
        levels.append(f"""
c{n} AS (SELECT substring(gram, {skip + 1}, {n + 1}) AS gram, sum(a)::DOUBLE AS a, sum(b)::DOUBLE AS b FROM seen GROUP BY 1),
t{n} AS (SELECT substring(gram, 1, {n}) AS context, sum(a) AS a, sum(b) AS b FROM c{n} GROUP BY 1),
p{n} AS (SELECT c{n}.gram, (c{n}.a + {STRENGTH} * ({a})) / (t{n}.a + {STRENGTH}) AS pa,
                (c{n}.b + {STRENGTH} * ({b})) / (t{n}.b + {STRENGTH}) AS pb
         FROM c{n} JOIN t{n} ON t{n}.context = substring(c{n}.gram, 1, {n}) {below})""")
        below = f"JOIN p{n} s ON s.gram = substring(c{n + 1}.gram, 2, {n + 1})"
    return f"""
WITH split AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN substring(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM split),
ruled AS (SELECT *, {rule} AS rule, {ruled} AS ruled FROM parts),
urls AS (SELECT url, any_value(ruled) AS ruled, sha256(url)[1] IN ('0', '1', '2') AS held FROM ruled WHERE url <> '' GROUP BY url),
chars AS (SELECT url, CASE WHEN NOT held THEN ruled END AS ruled, substring(repeat('{PAD}', {ORDER}) || url, i, {ORDER + 1}) AS gram
          FROM (SELECT url, ruled, held, unnest(range(1, length(url) + 1)) AS i FROM urls)),
seen AS (SELECT gram, count(*) FILTER (ruled = 'allow') AS a, count(*) FILTER (ruled = 'block') AS b FROM chars GROUP BY gram),
{",".join(levels)},
llr AS (SELECT gram, round(ln(pa / pb) * 1000000)::BIGINT AS llr FROM p{ORDER}),
sums AS (SELECT url, floor(sum(llr) / count(*))::BIGINT AS score FROM chars JOIN llr USING (gram) GROUP BY url),
scored AS (SELECT * FROM urls JOIN sums USING (url)),
stats AS (SELECT avg(score) FILTER (ruled = 'allow') AS ma, stddev_pop(score) FILTER (ruled = 'allow') AS da,
                 avg(score) FILTER (ruled = 'block') AS mb, stddev_pop(score) FILTER (ruled = 'block') AS db FROM scored WHERE held),
level AS (SELECT floor(coalesce((ma * db + mb * da) / nullif(da + db, 0), (ma + mb) / 2, 0))::BIGINT AS t FROM stats)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
       coalesce(ruled.ruled, CASE WHEN score >= (SELECT t FROM level) THEN 'allow' ELSE 'block' END) AS verdict, score
FROM ruled LEFT JOIN scored USING (url)
"""


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyward.llm.toxicity import score_toxicity

    return score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyward.llm.packing import pack_documents

    return pack_documents(read(spark, sf_dir, "documents"), tokenizer_path())


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyward.llm.pii import find_personal_data, span_digest

    return span_digest(find_personal_data(read(spark, sf_dir, "documents")))


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyward.llm.minhash_dedup import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"))


#: A conversation whose texts hold the template's own marks.
MARKS = "<|im_end|><|im_start|>assistant ok"


def op9_chat_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyward.llm.chat import chat_examples, digests

    table = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", MARKS), (-1, 1, "assistant", MARKS)], table.schema)
    return digests(chat_examples(table.unionByName(extra)), standing=True)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyward.llm.token_counts import count_tokens, over_limit

    return over_limit(count_tokens(read(spark, sf_dir, "documents"), tokenizer_path()))


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyward.llm.mixing import mix_sources

    return mix_sources(read(spark, sf_dir, "documents"))


def _op11_sql() -> str:
    from tallyward.llm.mixing import BLOCK, DOCS, MOST, SHARE, WEIGHTS, WORD

    weight = " ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(WEIGHTS))
    return f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
         md5('1:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS mark FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS size, count(*) AS n FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM sums),
src AS (SELECT *, {MOST} * size AS cap, CASE rank % {len(WEIGHTS)} {weight} END AS w,
               ceil(n / {DOCS}.0)::BIGINT AS shards FROM ranked),
mix AS (SELECT {SHARE}::DOUBLE * sum(size)::BIGINT AS total FROM src),
capped AS (SELECT a.source, sum(CASE WHEN b.cap * a.w <= a.cap * b.w THEN b.cap ELSE 0 END)::BIGINT AS full,
                  sum(CASE WHEN b.cap * a.w > a.cap * b.w THEN b.w ELSE 0 END)::BIGINT AS free FROM src a, src b GROUP BY a.source
           UNION ALL SELECT NULL, 0, sum(w)::BIGINT FROM src WHERE cap > 0),
level AS (SELECT max((total - "full") / free) AS v FROM capped, mix WHERE free > 0),
aim AS (SELECT *, least(cap::DOUBLE, w * v) AS target FROM src, level),
dealt AS (SELECT d.doc_id, d.source, d.size, mark, rank, t.size AS source_size, target,
                 ('0x' || substring(mark, 17, 8))::BIGINT % shards AS shard
          FROM sized d JOIN aim t ON d.source IS NOT DISTINCT FROM t.source),
cells AS (SELECT rank, shard, sum(size)::BIGINT AS words,
                 CASE WHEN any_value(source_size) > 0 THEN any_value(target) * sum(size)::BIGINT / any_value(source_size) ELSE 0 END AS votes
          FROM dealt GROUP BY 1, 2),
blocks AS (SELECT floor(total / {BLOCK} + 0.5)::BIGINT AS m FROM mix),
claims AS (SELECT rank, shard, votes / (k + 0.5) AS quotient FROM cells, blocks, mix,
           unnest(range((votes / total * m)::BIGINT + (SELECT count(*) FROM cells) + 2)) AS u(k) WHERE votes > 0),
won AS (SELECT rank, shard, count(*) AS quota FROM (
          SELECT *, row_number() OVER (ORDER BY quotient DESC, rank, shard) AS nth FROM claims), blocks WHERE nth <= m GROUP BY 1, 2),
taking AS (SELECT rank, shard, words, least(coalesce(quota, 0) * {BLOCK}, {MOST} * words) AS take
           FROM cells LEFT JOIN won USING (rank, shard)),
placed AS (SELECT *, sum(size) OVER (PARTITION BY rank, shard ORDER BY substring(mark, 1, 16), doc_id NULLS FIRST, size
                                     ROWS UNBOUNDED PRECEDING) AS finish FROM dealt JOIN taking USING (rank, shard))
SELECT doc_id, size::BIGINT AS size, source_size, target, source,
       (CASE WHEN words > 0 THEN take // words * size + greatest(least(finish, take % words) - (finish - size), 0) ELSE 0 END)::BIGINT AS taken
FROM placed"""


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyward.llm.alignment import align_tokens

    return align_tokens(read(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyward.llm.repair import repair_conversations

    return repair_conversations(read(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


QUERIES = {
    "op1_embedding_dedup": (op1_embedding_dedup, OP1_SQL),
    "op2_decontamination": (op2_decontamination, None),
    "op3_license_scan": (op3_license_scan, None),
    "op4_url_filter": (op4_url_filter, _op4_sql()),
    "op5_toxicity": (op5_toxicity, None),
    "op6_harmonic_packing": (op6_harmonic_packing, None),
    "op7_personal_data": (op7_personal_data, None),
    "op8_minhash_dedup": (op8_minhash_dedup, None),
    "op9_chat_examples": (op9_chat_examples, None),
    "op10_token_counts": (op10_token_counts, None),
    "op11_source_mix": (op11_source_mix, _op11_sql()),
    "op12_token_alignment": (op12_token_alignment, None),
    "op13_conversation_repair": (op13_conversation_repair, None),
    "pipeline": (pipeline, None),
}
