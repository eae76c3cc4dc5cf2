"""The training-data queries and, where SQL can say it, their oracles."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanlake.llm import (
    ann, bpe, conversation_trie, decontamination, hard_negatives, html_blocks, langid, lines, lm, sharding, simhash, url_rules,
    word_bpe,
)
from scanlake.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


@query()
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in 16 shards that all match the mixture of sources."""
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        "source",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
    )
    placed = sharding.interleave(rows, 16, "source", ["doc_id", "size", "text_crc32"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "source",
    )


@query()
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the public ranks, and its ids decoded again."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, ranks, public_tokenizers.PATTERN, keep=["doc_id"]).select(
        "doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


#: Verdict, host and path of the given URL rules.
URL_RULES = [
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


@query()
def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@query()
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line that isn't blank, and the document and position of the one kept in its place."""
    found = lines.judge_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("doc").alias("doc_id"), "line_no", F.col("kept_doc").alias("kept_doc_id"), F.col("kept_no").alias("kept_line_no"), "kept")


def language_model_of(documents: DataFrame):
    """Language probabilities learned from the documents that aren't held out."""
    tokens = list(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    return langid.fit(documents.where(~held_out(4, 2)), tokens)


def held_out(parts: int, part: int) -> Column:
    """Whether the CRC-32 of doc_id as text leaves this remainder; a null id counts as no text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % parts == part


@query()
def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), language_model_of(docs), drop_text=True)
    return found.select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")


@query()
def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    texts = html_blocks.extract(pages, html_blocks.train(pages), drop_html=True)
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query()
def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document by single counts and by the model."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out(5, 1).alias("held_out"))
    return lm.fit_and_score(docs, ~F.col("held_out"))


@query()
def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    docs = table(spark, sf_dir, "documents")
    return simhash.group_near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


@query()
def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows found for every vector whose id is divisible by 20."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(ann.build(rows), rows.where(F.col("vec_id") % 20 == 0))


@query(
    r"""
    WITH d AS (
      SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
    ), b AS (
      SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
    ), win AS (
      SELECT DISTINCT item, least(len(w), 13) AS k, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS s
      FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
    ), found AS (
      SELECT r, i, c.k, item
      FROM (SELECT r, k, unnest(range(1, len(w) - k + 2)) AS i, w FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k) c
      JOIN win ON win.k = c.k AND win.s = array_to_string(w[i:i + c.k - 1], ' ')
    ), hits AS (
      SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM found) GROUP BY r
    ), items AS (
      SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM found) GROUP BY r
    )
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hits.n, 0) AS BIGINT) AS n_hit,
      CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
      coalesce(hits.n, 0) > 0 AND 20 * coalesce(hits.n, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN hits USING (r) LEFT JOIN items USING (r)
    """
)
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents hold windows of which benchmark items, and how many words those cover."""
    marked = decontamination.mark_contaminated(
        table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    )
    return marked.select(
        "doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        decontamination.is_contaminated().alias("contaminated"),
    )


@query()
def op11_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the public tokenizer of words, and its ids decoded again."""
    tokenizer = word_bpe.read_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    encoded = word_bpe.encode(table(spark, sf_dir, "documents"), tokenizer, keep=["doc_id"])
    ids = F.array_join(F.col("token_ids").cast("array<string>"), " ")
    digests = encoded.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), "token_ids")
    return word_bpe.decode(digests, tokenizer).select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256")
    )


@query(
    r"""
    WITH RECURSIVE t AS (
      SELECT c, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, s) - 1 AS p, s, w
      FROM (
        SELECT conv_id AS c, turn, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w,
          md5(concat(strlen(role), ':', role, strlen(text), ':', text)) AS s
        FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
      )
    ), crc AS (
      SELECT c, 0 AS bit, 4294967295 AS v FROM (SELECT DISTINCT c FROM t)
      UNION ALL
      SELECT c, bit + 1, CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END
      FROM (
        SELECT c, bit, CASE WHEN bit % 8 = 0 THEN xor(v, CAST(ascii(substr(CAST(c AS VARCHAR), bit // 8 + 1, 1)) AS BIGINT)) ELSE v END AS x
        FROM crc WHERE bit < 8 * length(CAST(c AS VARCHAR))
      )
    ), ids AS (
      SELECT c, xor(v, 4294967295) % 4 AS h FROM crc WHERE bit = 8 * length(CAST(c AS VARCHAR))
    ), rebuilt AS (
      SELECT ids.c, p, s, w FROM ids JOIN t ON t.c = ids.c - ids.c % 20 AND p < h
      UNION ALL
      SELECT c, p, s, w FROM ids JOIN t USING (c) WHERE p >= h
    ), told AS (
      SELECT c, coalesce(ss, []) AS ss, coalesce(ws, []) AS ws
      FROM ids LEFT JOIN (SELECT c, list(s ORDER BY p) AS ss, list(w ORDER BY p) AS ws FROM rebuilt GROUP BY c) USING (c)
    ), m AS (
      SELECT c, d, len(ss) AS size, md5(array_to_string(ss[1:d], '')) AS node, md5(array_to_string(ss[1:d - 1], '')) AS parent, ws[d] AS w
      FROM (SELECT *, unnest(range(0, len(ss) + 1)) AS d FROM told)
    ), v AS (
      SELECT node, any_value(d) AS d, any_value(parent) AS parent, min(c) AS c, count(*) AS n, coalesce(any_value(w), 0) AS w FROM m GROUP BY node
    ), k AS (
      SELECT parent AS node, count(*) AS k FROM v WHERE d > 0 GROUP BY parent
    ), below AS (
      SELECT a.node, sum(CASE WHEN k IS NULL THEN 1 ELSE 0 END) AS leaves, sum((n - 1) * v.w) AS saved
      FROM v LEFT JOIN k USING (node) JOIN m a ON a.c = v.c AND a.d <= v.d GROUP BY a.node
    ), e AS (
      SELECT node, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM m WHERE d = size GROUP BY node
    )
    SELECT v.c AS conv_id, CAST(v.d AS BIGINT) AS depth, CASE WHEN v.d > 0 THEN p.c END AS parent_conv_id, CAST(v.n AS BIGINT) AS n_convs,
      CAST(coalesce(k, 0) AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
      sha256(coalesce(ids, '')) AS ends_sha256
    FROM v LEFT JOIN v p ON p.node = v.parent AND p.d = v.d - 1 LEFT JOIN k ON k.node = v.node JOIN below ON below.node = v.node
      LEFT JOIN e ON e.node = v.node
    """
)
def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations."""
    turns = conversation_trie.read_turns(table(spark, sf_dir, "conversations"))
    nodes = conversation_trie.build(*conversation_trie.borrow_heads(turns))
    return nodes.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )


@query(
    """
    WITH r AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
      FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    ), s AS (
      SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
      FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
    ), p AS (
      SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place
      FROM s WHERE same
    ), n AS (
      SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
        vec_id AS negative_id, positive_score, score AS negative_score
      FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
      WHERE place <= 5
    )
    SELECT * FROM n WHERE rank <= 5
    """
)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hardest rows of other labels below each of an anchor's nearest rows of its own."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return hard_negatives.mine(rows, F.col("id") % 100 == 0)
