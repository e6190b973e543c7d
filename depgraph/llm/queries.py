"""Registry of the corpus queries: one callable (spark, sf_dir) for each operator, SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depgraph.llm import (
    chat, decontamination, fp_tree, lm_scores, mixing, quality, resampling, search, sharding, shingle_join, token_files, toxicity,
    urls,
)
from depgraph.llm.common import prepare, table

#: Rules of the url query: host, path, verdict.
URL_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
]


def op1_vector_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 under the law ``bytes``: the shards' sizes are near equal."""
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), 8)
    return placed.select(
        "doc_id", F.col("bytes").alias("size"), "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "words",
    )


def op2_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade of every document, its tail probabilities, and whether it is kept (all are, unless
    good and worse documents are labelled)."""
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, quality.ratings_of(table(spark, sf_dir, "labels")), 3)
    graded = quality.grade(docs, model, carry=["doc_id"])
    tails = F.col("quality.tails")
    return graded.select(
        "doc_id", F.col("quality.expected_grade").alias("expected_grade"),
        tails[0].alias("p_not_toxic"), tails[1].alias("p_good"), quality.good(model, tails, 0.5).alias("keep"),
    )


def op3_shingle_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document; links need 100 * intersection >= 85 * union."""
    joined = shingle_join.similar_documents(table(spark, sf_dir, "documents"))
    return joined.select("doc_id", "n_shingles", "component_id", "n_links")


def op4_transcript_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all conversations, shown as raw transcripts, with the roles and turns found in them."""
    shown = chat.as_transcripts(table(spark, sf_dir, "conversations"))
    lines = chat.transcript_lines(shown)
    found = chat.canonical(chat.recover_roles(lines, chat.fit(lines)))
    return found.select(
        F.expr("try_cast(conv AS BIGINT)").alias("conv_id"), "turn", "at", "message", F.col("role").alias("given_role"), "found_role", "piece",
    )


def op5_mix_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    mix = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixing.taken_words(mix).select("doc_id", "size", "source_size", "target", "taken")


def op6_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in verbatim matches of benchmark windows, and the items matched."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    report = decontamination.annotate(docs, items, carry=["doc_id"])
    found = F.col("contamination.items")
    return report.select(
        "doc_id", "contamination.n_words", "contamination.n_hit",
        F.size(found).cast("long").alias("n_items"),
        F.sha2(F.array_join(found, ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("contamination.n_hit") > 0).alias("contaminated"),
    )


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict and rule of every page's url."""
    prepare(spark)
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op8_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stupid-backoff log score of every document against all others, in total and by word."""
    scored = lm_scores.score_documents(table(spark, sf_dir, "documents"))
    return scored.select(
        "doc_id", "n_words", "n_full", F.round("log_score", 4).alias("log_score"),
        F.round(F.col("log_score") / F.greatest(F.col("n_words"), F.lit(1)), 6).alias("log_score_per_word"),
    )


def op9_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document, found in flat token files written from all documents, whose last ones stay open.

    A last document without tokens leaves no trace in its file; the names tell that it is there."""
    written = token_files.write_token_files(table(spark, sf_dir, "documents"), leave_open=True)
    counts = token_files.token_counts(token_files.token_blocks(written.files))
    return token_files.named_counts(written.names, counts)


_OP7_SQL = """
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), rules(rule_host, rule_path, rule_verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), numbered AS (SELECT row_number() OVER () AS row_no, * FROM split),
fits AS (
  SELECT row_no, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(rule_verdict, length(rule_host || rule_path)) AS rule_verdict
  FROM numbered JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY row_no
)
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict
FROM numbered LEFT JOIN fits USING (row_no)
"""

def op10_bm25_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every document whose number is divisible by 50, taken as a query."""
    docs = table(spark, sf_dir, "documents")
    queries = docs.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "text")
    return search.top_k(docs, queries, 10)


def op11_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; the labels of held-out documents are never read."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    detector = toxicity.train(docs, labels.filter(~toxicity.is_held_out(F.col("doc_id"))))
    scored = toxicity.score(docs, detector, carry=["doc_id"], name="score")
    return scored.select(
        "doc_id", toxicity.is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op12_document_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty highest-scoring documents of every benchmark item."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return fp_tree.rank_documents(docs, items, 50).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and place in the draw of every document, with the benchmark as the target."""
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    weighed = resampling.resample(docs, target, carry=["doc_id"])
    return weighed.select("doc_id", *(f"importance.{c}" for c in ("n_features", "weight", "score", "rank")))


_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"

_OP3_SQL = f"""
WITH RECURSIVE listed AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM listed WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_have
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY x, y
),
links AS (
  SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * both_have >= 85 * (p.n + q.n - both_have)
),
reach AS (
  SELECT doc_id AS start, doc_id AS node FROM documents
  UNION SELECT start, y FROM reach JOIN links ON node = x
),
degrees AS (SELECT x, count(*) AS n_links FROM links GROUP BY x)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.component_id, coalesce(g.n_links, 0) AS n_links
FROM documents d LEFT JOIN sizes s USING (doc_id)
JOIN (SELECT start, min(node) AS component_id FROM reach GROUP BY start) r ON r.start = d.doc_id
LEFT JOIN degrees g ON g.x = d.doc_id
"""

_OP6_WORDS = (
    "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)

_OP6_SQL = f"""
WITH listed AS (SELECT doc_id, coalesce({_OP6_WORDS}, []) AS w FROM documents),
items AS (SELECT item_id, {_OP6_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS win
  FROM (SELECT item_id, w, least(len(w), 10) AS m, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i
        FROM items WHERE len(w) > 0)
),
lengths AS (SELECT DISTINCT m FROM windows),
places AS (
  SELECT doc_id, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') AS win
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM listed, lengths WHERE len(w) >= m)
),
hits AS (SELECT doc_id, m, i, item_id FROM places JOIN windows USING (m, win)),
covered AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM (SELECT DISTINCT doc_id, m, i FROM hits)) GROUP BY doc_id
),
found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS joined
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY doc_id
)
SELECT l.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(joined, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM listed l LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

_OP8_SQL = f"""
WITH listed AS (SELECT doc_id, coalesce({_WORDS}, []) AS words FROM documents),
places AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM listed),
history AS (
  SELECT *, lag(w) OVER p AS v, lag(w, 2) OVER p AS u FROM places WINDOW p AS (PARTITION BY doc_id ORDER BY i)
),
counted AS (
  SELECT *,
    count(*) OVER (PARTITION BY w) - count(*) OVER (PARTITION BY w, doc_id) AS c1,
    count(*) OVER (PARTITION BY v, w) - count(*) OVER (PARTITION BY v, w, doc_id) AS c2,
    count(*) OVER (PARTITION BY u, v, w) - count(*) OVER (PARTITION BY u, v, w, doc_id) AS c3,
    count(*) OVER () - count(*) OVER (PARTITION BY doc_id) AS n
  FROM history
),
ordered AS (
  SELECT *, lag(c1) OVER p AS h1, lag(c2) OVER p AS h2 FROM counted WINDOW p AS (PARTITION BY doc_id ORDER BY i)
),
scored AS (
  SELECT doc_id, i, c3,
    CASE
      WHEN i >= 3 AND c3 > 0 THEN ln(c3 / h2)
      ELSE CASE WHEN i >= 3 THEN ln(0.4) ELSE 0 END + CASE
        WHEN i >= 2 AND c2 > 0 THEN ln(c2 / h1)
        ELSE CASE WHEN i >= 2 THEN ln(0.4) ELSE 0 END + CASE WHEN c1 > 0 THEN ln(c1 / n) ELSE ln(1 / (n + 1)) END
      END
    END AS log_score
  FROM ordered
),
summed AS (
  SELECT doc_id, sum(log_score) AS log_score, count(*) FILTER (i >= 3 AND c3 > 0) AS n_full FROM scored GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_full, 0) AS n_full,
       round(coalesce(log_score, 0), 4) AS log_score,
       round(coalesce(log_score, 0) / greatest(len(words), 1), 6) AS log_score_per_word
FROM listed LEFT JOIN summed USING (doc_id)
"""

_OP10_SQL = f"""
WITH listed AS (SELECT doc_id, coalesce({_WORDS}, []) AS words FROM documents),
terms AS (SELECT doc_id, w, count(*) AS tf FROM (SELECT doc_id, unnest(words) AS w FROM listed) GROUP BY doc_id, w),
stats AS (SELECT count(*) AS n, sum(len(words)) / count(*) AS mean FROM listed),
idfs AS (SELECT w, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM terms, stats GROUP BY w, n),
parts AS (
  SELECT t.doc_id, t.w,
    round(idf * (tf * 2.2::DOUBLE) / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(words) / mean)) * 1000000)::BIGINT AS part
  FROM terms t JOIN idfs USING (w) JOIN listed USING (doc_id), stats
),
scored AS (
  SELECT q.doc_id AS query_id, p.doc_id, sum(part)::BIGINT AS score
  FROM terms q JOIN parts p USING (w) WHERE q.doc_id % 50 = 0 GROUP BY q.doc_id, p.doc_id
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS "rank" FROM scored WHERE score > 0
)
SELECT query_id, "rank", doc_id, score FROM ranked WHERE "rank" <= 10
"""

_OP12_TERMS = (
    "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
)

_OP12_SQL = f"""
WITH listed AS (
  SELECT row_number() OVER () AS row_no, doc_id, coalesce({_OP12_TERMS}, []) AS terms FROM documents
),
items AS (SELECT DISTINCT item_id, unnest({_OP12_TERMS}) AS term FROM benchmark),
stats AS (SELECT count(*) FILTER (len(terms) > 0) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM listed),
held AS (SELECT row_no, term, count(*) AS tf FROM (SELECT row_no, unnest(terms) AS term FROM listed) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM held, stats GROUP BY term, n_docs
),
figures AS (SELECT row_no, doc_id, 50 + (50 * len(terms) * n_docs) // n_terms AS m FROM listed, stats WHERE len(terms) > 0),
scored AS (
  SELECT item_id, row_no, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM items JOIN held USING (term) JOIN weights USING (term) JOIN figures USING (row_no) GROUP BY ALL
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""

# CRC-32 of a word's bytes, by the table of its polynomial
_OP13_SQL = f"""
WITH crc_table AS (
  SELECT list(list_reduce(list_prepend(k, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
              ORDER BY k) AS entry
  FROM (SELECT unnest(range(256)) AS k)
),
listed AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce({_OP6_WORDS}, []) AS words FROM documents),
places AS (SELECT row_no, unnest(words) AS word FROM listed),
wanted AS (SELECT unnest({_OP6_WORDS}) AS word FROM benchmark),
known AS (SELECT DISTINCT word, hex(encode(word)) AS raw FROM (SELECT word FROM places UNION ALL SELECT word FROM wanted)),
hashed AS (
  SELECT word, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(range(1, len(raw) // 2 + 1), lambda i: ('0x' || substr(raw, 2 * i - 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, entry[(xor(c, b) & 255) + 1]))) % 10000 AS bucket
  FROM known, crc_table
),
own AS (SELECT bucket, count(*) AS s FROM places JOIN hashed USING (word) GROUP BY bucket),
other AS (SELECT bucket, count(*) AS t FROM wanted JOIN hashed USING (word) GROUP BY bucket),
totals AS (SELECT (SELECT count(*) FROM places) AS all_s, (SELECT count(*) FROM wanted) AS all_t),
gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (all_s + 10000)::DOUBLE
                                 / ((coalesce(s, 0) + 1)::DOUBLE * (all_t + 10000)::DOUBLE)))::BIGINT AS gain
  FROM own FULL JOIN other USING (bucket), totals
),
weighed AS (
  SELECT row_no, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
  FROM places JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY row_no
),
scored AS (
  SELECT doc_id, row_no, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256(concat('2024:', doc_id)), 8))::BIGINT + 0.5::DOUBLE)
                                               / 4294967296::DOUBLE)))::BIGINT AS score
  FROM listed LEFT JOIN weighed USING (row_no)
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS place,
    count(*) FILTER (n_features >= 20) OVER () AS n
  FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= (10 * n) // 100 THEN place END AS rank
FROM ranked
"""

QUERIES = {
    "op1_vector_bin_packing": op1_vector_bin_packing,
    "op2_ordinal_quality": op2_ordinal_quality,
    "op3_shingle_jaccard": op3_shingle_jaccard,
    "op4_transcript_roles": op4_transcript_roles,
    "op5_mix_to_weights": op5_mix_to_weights,
    "op6_suffix_decontamination": op6_suffix_decontamination,
    "op7_url_rules": op7_url_rules,
    "op8_backoff_scores": op8_backoff_scores,
    "op9_separator_scan": op9_separator_scan,
    "op10_bm25_top_k": op10_bm25_top_k,
    "op11_weak_toxicity": op11_weak_toxicity,
    "op12_document_tree": op12_document_tree,
    "op13_importance_resampling": op13_importance_resampling,
}

ORACLES = {
    "op3_shingle_jaccard": _OP3_SQL, "op6_suffix_decontamination": _OP6_SQL, "op7_url_rules": _OP7_SQL,
    "op8_backoff_scores": _OP8_SQL, "op10_bm25_top_k": _OP10_SQL,
    "op12_document_tree": _OP12_SQL, "op13_importance_resampling": _OP13_SQL,
}
