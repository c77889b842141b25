"""Registered queries of the text operators and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelframe.llm.byte_bpe import decode, encode
from duelframe.llm.common import remainder, table
from duelframe.llm.embedding_tiles import link_embeddings
from duelframe.llm.hard_negatives import mine_negatives
from duelframe.llm.line_dedup import dedup_lines
from duelframe.llm.merkle_manifest import verify_documents
from duelframe.llm.ngram_trie import number_corpus, score_corpus
from duelframe.llm.quality_fm import score_quality, train_quality
from duelframe.llm.simhash_trie import simhash_components
from duelframe.llm.spaced_seeds import EXCERPT, find_overlaps
from duelframe.llm.toxicity_mil import score_toxicity, train_toxicity
from duelframe.llm.url_rules import judge_urls
from duelframe.llm.warc import archive_round_trip
from duelframe.llm.word_bpe import decode as decode_words
from duelframe.llm.word_bpe import encode as encode_words

URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = encode(table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN, ["doc_id"])
    return encoded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(decode(F.col("ids"), vocabulary), 256).alias("decoded_sha256"),
    )


def op2_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = number_corpus(table(spark, sf_dir, "documents"), remainder("doc_id", 10) != 0)
    return score_corpus(numbered).select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known",
        F.lit(numbered.vocabulary.tokens).cast("bigint").alias("train_tokens"), "base_score", "score",
    )


def op3_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), remainder("doc_id", 3) == 1
    model = train_quality(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = score_quality(docs, model, ["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"))


def op5_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op6_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), EXCERPT)
    return found.select("doc_id", "item_id", "start", "compared", "matched")


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    judged = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = dedup_lines(table(spark, sf_dir, "documents"))
    lines = F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, r: n + r["last"] - r["first"] + 1)
    return cleaned.select("doc_id", "n_lines", lines.alias("n_removed"), "removed", F.sha2("text", 256).alias("text_sha256"))


def op9_embedding_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_embeddings(table(spark, sf_dir, "embeddings"))


def op10_toxicity_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), remainder("doc_id", 4) == 2
    model = train_toxicity(docs, table(spark, sf_dir, "labels"), ~held_out)
    scored = score_toxicity(docs, model, ["doc_id"])
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_sentences", "offending",
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_negatives(table(spark, sf_dir, "embeddings").select("vec_id", moved.alias("label"), "embedding"), F.col("id") % 100 == 0)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify_documents(table(spark, sf_dir, "documents"), remainder("doc_id", 5) == 0)


def op13_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    encoded = encode_words(table(spark, sf_dir, "documents"), vocabulary, ["doc_id"])
    return encoded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(decode_words(F.col("ids"), vocabulary).cast("binary"), 256).alias("decoded_sha256"),
    )


def _manifest_sql(levels: int = 6) -> str:
    """SQL of op 12 for up to 16^levels leaves and sources."""
    def hashed(text: str) -> str:
        fields = ["doc_id", "source", "lang", "n_chars", text]
        parts = [f"CASE WHEN {f} IS NULL THEN '-' ELSE strlen(CAST({f} AS VARCHAR)) || ':' || CAST({f} AS VARCHAR) END" for f in fields]
        return f"sha256({' || '.join(parts)})"

    def climb(start: str, name: str, group: str) -> list[str]:
        """CTEs of the levels of trees over (g, idx, n, digest): name_k, and name_top with each tree's last digest."""
        out = [f"{name}_0 AS (SELECT g, idx, n, digest FROM {start})"]
        for k in range(1, levels + 1):
            out.append(f"""{name}_{k} AS (
  SELECT g, idx // 16 AS idx, CAST(ceil(max(n) / 16) AS BIGINT) AS n, sha256(string_agg(digest, '' ORDER BY idx)) AS digest
  FROM {name}_{k - 1} WHERE n > 1 GROUP BY g, idx // 16)""")
        tops = " UNION ALL ".join(f"SELECT g, digest FROM {name}_{k} WHERE n = 1" for k in range(levels + 1))
        out.append(f"{name}_top AS ({tops})")
        return out

    def fold(name: str, source: str, g: str, idx: str) -> list[str]:
        """CTEs that fold column f of ``source`` through the levels and add the siblings to column p."""
        out, last = [], source
        for k in range(levels):
            out.append(f"""{name}_f{k} AS (
  SELECT s.* EXCLUDE (f, p), CASE WHEN r.kids IS NULL THEN s.f ELSE sha256(r.lefts || s.f || r.rights) END AS f,
    s.p || coalesce(r.lefts || r.rights, '') AS p
  FROM {last} s LEFT JOIN (
    SELECT g, idx, 1 AS kids, coalesce(string_agg(digest, '' ORDER BY idx) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lefts,
      coalesce(string_agg(digest, '' ORDER BY idx) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rights
    FROM {name}_{k} WHERE n > 1 WINDOW w AS (PARTITION BY g, idx // 16 ORDER BY idx)
  ) r ON r.g = s.{g} AND r.idx = s.{idx} // {16 ** k})""")
            last = f"{name}_f{k}"
        return out

    # crc32 bit by bit over the digits of doc_id.
    bits = "list_reduce([c] || range(8), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)"
    crc = f"""list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ord(s) AS BIGINT)),
      lambda a, s: {bits.replace('[c]', '[xor(a, s)]')})"""
    ctes = [
        f"""leaf AS (SELECT doc_id, source, {hashed('text')} AS leaf,
    CASE WHEN xor({crc}, 4294967295) % 5 = 0
      THEN {hashed("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}
      ELSE {hashed('text')} END AS start FROM documents)""",
        """named AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS g FROM (SELECT DISTINCT source FROM documents))""",
        """placed AS (SELECT l.*, named.g, row_number() OVER (PARTITION BY named.g ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY named.g) AS n,
    l.leaf AS digest FROM leaf l JOIN named ON l.source IS NOT DISTINCT FROM named.source)""",
        *climb("placed", "own", "g"),
        "tops AS (SELECT 0 AS g, g AS idx, (SELECT count(*) FROM named) AS n, digest FROM own_top)",
        *climb("tops", "top", "g"),
        "begin AS (SELECT doc_id, leaf, g, idx, 0 AS one, start AS f, '' AS p FROM placed)",
        *fold("own", "begin", "g", "idx"),
        *fold("top", f"own_f{levels - 1}", "one", "g"),
    ]
    return "WITH " + ",\n".join(ctes) + f"""
SELECT doc_id, leaf, own_top.digest AS subroot, top_top.digest AS root, sha256(p) AS proof_sha256, f AS folded_root, f = top_top.digest AS verified
FROM top_f{levels - 1} e JOIN own_top ON own_top.g = e.g JOIN top_top ON top_top.g = 0
"""


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_ngram_trie": op2_ngram_trie,
    "op3_quality_fm": op3_quality_fm,
    "op4_warc_salvage": op4_warc_salvage,
    "op5_simhash_trie": op5_simhash_trie,
    "op6_spaced_seeds": op6_spaced_seeds,
    "op7_url_rules": op7_url_rules,
    "op8_line_dedup": op8_line_dedup,
    "op9_embedding_tiles": op9_embedding_tiles,
    "op10_toxicity_mil": op10_toxicity_mil,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_word_bpe": op13_word_bpe,
}

SQL = {
    "op4_warc_salvage": """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages
), h AS (SELECT d, max(page_id) AS head, count(*) AS k FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN k > 1 AND page_id IS DISTINCT FROM head THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN k > 1 AND page_id IS DISTINCT FROM head THEN head END AS refers_to
FROM p LEFT JOIN h USING (d)
""",
    "op7_url_rules": """
WITH cut AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    row_number() OVER () AS rn
  FROM pages
), rules(rhost, rpath, rverdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), best AS (
  SELECT rn, arg_max(rhost || rpath, length(rhost) * 100000 + length(rpath)) AS rule,
    arg_max(rverdict, length(rhost) * 100000 + length(rpath)) AS verdict
  FROM cut JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY rn
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM cut LEFT JOIN best USING (rn)
""",
    "op11_hard_negatives": """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER w <= 10
""",
    "op12_merkle_manifest": _manifest_sql(),
}
