"""The operators applied to the given tables, each over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .conversations import repair_structure
from .decontaminate import benchmark_matches
from .exact import exact_duplicates
from .html import extract_main_text
from .language import held_out, predict_language, train_language_model
from .lines import repeated_lines
from .lm import score_texts
from .mixing import mixed
from .negatives import hard_negatives
from .neighbours import nearest
from .ngram_join import similar_classes
from .substring import repeated_sequences
from .suffix import repeated_bytes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with its SQL where SQL can say it."""

    def register(build: Query) -> Query:
        QUERIES[build.__name__] = build
        if oracle is not None:
            ORACLES[build.__name__] = oracle
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
rows AS (SELECT row_number() OVER () AS row, doc_id, w FROM d),
p AS (SELECT row, unnest(w) AS word, unnest(generate_series(1, len(w))) AS i, len(w) AS n FROM rows),
g AS (SELECT row, i, n, word, string_agg(word, ' ') OVER
  (PARTITION BY row ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) AS run FROM p),
c AS (SELECT row, i, n, word, CASE WHEN i + 34 <= n THEN count(*) OVER (PARTITION BY i + 34 <= n, run) > 1 ELSE false END
  AS twice FROM g),
r AS (SELECT row, i, word, bool_or(twice) OVER (PARTITION BY row ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW)
  AS gone FROM c),
k AS (SELECT row, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept
  FROM r GROUP BY row)
SELECT rows.doc_id, len(rows.w)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed,
  sha256(coalesce(k.kept, '')) AS kept_sha256 FROM rows LEFT JOIN k USING (row)"""
)
def op1_substring_dedup(spark, sf_dir):
    """Words left after removing every run of 35 words that stands at another place too."""
    found = repeated_sequences(table(spark, sf_dir, "documents"), length=35)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        F.col("id").alias("doc_id"), "n_words", removed.alias("n_removed"),
        F.sha2("kept_text", 256).alias("kept_sha256"),
    )


@query(
    """SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""
)
def op8_exact_dedup(spark, sf_dir):
    """Every document with the row that stays of its class of equal texts."""
    return exact_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@query(
    r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [list_aggregate(w, 'string_agg', ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: list_aggregate(w[i:i + 4], 'string_agg', ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.a = d.doc_id GROUP BY 1"""
)
def op3_ngram_join(spark, sf_dir):
    """Every document with the least document that a chain of similar documents leads to."""
    found = similar_classes(table(spark, sf_dir, "documents"), n=5, percent=75)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


@query()
def op4_suffix_dedup(spark, sf_dir):
    """Bytes left after removing every string of 400 bytes that stands at another place too."""
    found = repeated_bytes(table(spark, sf_dir, "documents"), length=400)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"),
    )


def language_rows(docs: DataFrame) -> DataFrame:
    """The documents as the language model reads them; those held out carry a mark."""
    return docs.select(
        F.col("doc_id").alias("id"), "text", "lang", held_out("doc_id", 4, 2).alias("held_out")
    )


@query()
def op5_language_id(spark, sf_dir):
    """The language of every document, learned from three quarters of them."""
    rows = language_rows(table(spark, sf_dir, "documents"))
    model = train_language_model(rows.where("NOT held_out"))
    return predict_language(rows.drop("lang"), model).withColumnRenamed("id", "doc_id")


@query()
def op6_html_extract(spark, sf_dir):
    """The main text of every page."""
    found = extract_main_text(table(spark, sf_dir, "pages"))
    return found.withColumnRenamed("id", "page_id").withColumn("n_chars", F.length("text").cast("long"))


@query()
def op10_lm_score(spark, sf_dir):
    """Log-probabilities of every document under the training counts and under the trained model."""
    rows = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), "text", held_out("doc_id", 10, 0).alias("held")
    )
    return score_texts(rows).withColumnRenamed("id", "doc_id")


@query()
def op2_decontaminate(spark, sf_dir):
    """Every document with the benchmark items in it, nearest first by place, and whether there is any."""
    found = benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), (F.size("matches") > 0).alias("contaminated"),
        F.size("matches").cast("long").alias("n_matches"), F.sort_array(F.array_distinct("matches.item_id")).alias("item_ids"),
    )


def source_targets(docs: DataFrame) -> DataFrame:
    """Target weights of the sources: 1 to 4, by the last letter of the name."""
    sources = docs.select(F.coalesce("source", F.lit("")).alias("source")).distinct()
    return sources.withColumn("weight", 1 + F.ascii(F.substring("source", -1, 1)) % 4)


@query(
    """WITH RECURSIVE w AS (SELECT source, 1 + ascii(right(source, 1)) % 4 AS weight FROM
  (SELECT DISTINCT coalesce(source, '') AS source FROM documents)),
o AS (SELECT *, row_number() OVER (ORDER BY weight DESC, source) AS i FROM w),
a AS (SELECT list(weight::BIGINT ORDER BY i) AS ws, sum(weight)::BIGINT AS h, count(*) AS n FROM o),
c(slot, done, chosen) AS (SELECT -1::BIGINT, list_transform(ws, lambda x: 0::BIGINT), 0::BIGINT FROM a UNION ALL
  SELECT slot + 1, list_transform(range(1, n + 1), lambda j: done[j] + (CASE WHEN j = p THEN 1 ELSE 0 END)::BIGINT), p FROM (
    SELECT slot, done, n, h, list_position(dues, list_min(dues))::BIGINT AS p FROM (
      SELECT slot, done, n, h, list_transform(range(1, n + 1), lambda j: CASE WHEN (done[j] * h) // ws[j] <= slot + 1
        THEN ((done[j] + 1) * h + ws[j] - 1) // ws[j] END) AS dues FROM c, a WHERE slot + 1 < h))),
s AS (SELECT source, weight, h, done[chosen] - 1 AS k, slot AS first FROM c JOIN o ON o.i = chosen, a WHERE slot >= 0),
r AS (SELECT doc_id, coalesce(source, '') AS source, greatest(coalesce(length(text), 0), 1) AS size,
  md5('42:' || doc_id) AS m FROM documents),
p AS (SELECT doc_id, source, coalesce(sum(size) OVER (PARTITION BY source ORDER BY m, doc_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place FROM r)
SELECT doc_id, p.source, place // 65536 AS block, (place // 65536) // o.weight * h + first AS slot, place
FROM p JOIN o USING (source) JOIN s ON s.source = p.source AND s.k = (place // 65536) % o.weight"""
)
def op9_mixing(spark, sf_dir):
    """Every document with its block of its source and the slot of that block in the mixture."""
    docs = table(spark, sf_dir, "documents")
    return mixed(docs, source_targets(docs)).withColumnRenamed("id", "doc_id")


@query()
def op7_line_dedup(spark, sf_dir):
    """The lines of every document that go because a like line stays elsewhere."""
    found = repeated_lines(table(spark, sf_dir, "documents"), min_bytes=1)
    return found.select(
        F.col("id").alias("doc_id"), "n_lines", F.size("removed").cast("long").alias("n_removed"),
        F.col("removed").alias("removed_lines"),
    )


@query(
    """WITH v AS (SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)),
s AS (SELECT a.row, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
  list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.row <> b.row AND len(a.e) = len(b.e) WHERE a.vec_id % 100 = 0),
p AS (SELECT row, anchor_id, id AS positive_id, score AS positive_score,
  row_number() OVER (PARTITION BY row ORDER BY score DESC, id) AS place FROM s WHERE same QUALIFY place <= 5),
n AS (SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.row, p.place ORDER BY s.score DESC, s.id)::INT AS rank,
  s.id AS negative_id, p.positive_score, s.score AS negative_score FROM p JOIN s ON s.row = p.row AND NOT s.same
  AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score)
SELECT * FROM n WHERE rank <= 5"""
)
def op11_hard_negatives(spark, sf_dir):
    """Negatives that score from 80 % of a positive up to it, for the positives of every hundredth vector."""
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, shifted)


@query()
def op12_nearest(spark, sf_dir):
    """The 20 vectors of greatest inner product with every twentieth one."""
    found = nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)
    return found.withColumnRenamed("id", "vec_id")


@query(
    r"""WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(list_reduce(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
    lambda x: ord(x)::BIGINT), lambda a, b: list_reduce(range(8), lambda h, k: CASE WHEN h & 1 = 1 THEN xor(h >> 1, 3988292384)
    ELSE h >> 1 END, xor(a, b)), 4294967295::BIGINT), 4294967295) % 20 AS x FROM conversations),
harmed AS (SELECT conv_id, turn, CASE WHEN x = 4 THEN 'user' ELSE role END AS role, CASE x WHEN 1 THEN ''
  WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE x WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM raw),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM harmed),
seen AS (SELECT *, left(role, 1) AS c, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before,
  NOT regexp_matches(text, '[^ 	-]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
  NOT regexp_matches(text, '[.!?][ 	-]*$') AS cut FROM placed),
faults AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) AS n,
  count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
  count(*) FILTER (cut AND NOT again AND NOT blank) AS truncated,
  count(*) FILTER (before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal FROM seen GROUP BY conv_id),
ins(p, q, k) AS (VALUES (0, 0, 0), (0, 2, 1), (0, 3, 2), (1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 2, 0), (2, 3, 1), (3, 3, 0), (3, 2, 1)),
edit(p, c, letter, q, cost) AS (VALUES (0, 's', 'K', 1, 0), (0, 'u', 'K', 2, 0), (1, 'u', 'K', 2, 0), (2, 'a', 'K', 3, 0),
  (3, 'u', 'K', 2, 0), (0, '', 'R', 2, 1), (1, '', 'R', 2, 1), (2, '', 'R', 3, 1), (3, '', 'R', 2, 1),
  (0, '', 'D', 0, 2), (1, '', 'D', 1, 2), (2, '', 'D', 2, 2), (3, '', 'D', 3, 2)),
way(conv_id, i, q, cost, audit, kept) AS (SELECT conv_id, 0::BIGINT, 0, 0, '', []::VARCHAR[] FROM faults
  UNION ALL SELECT w.conv_id, s.i, e.q, w.cost + 5 * n.k + e.cost + CASE WHEN s.cut AND e.letter <> 'D' THEN 5 ELSE 0 END AS total,
    w.audit || repeat('I', n.k) || e.letter AS whole,
    w.kept || CASE n.k WHEN 0 THEN [] WHEN 1 THEN [CASE n.q WHEN 2 THEN 'user:' ELSE 'assistant:' END] ELSE ['user:', 'assistant:'] END
      || CASE e.letter WHEN 'D' THEN [] WHEN 'K' THEN [s.role || ':' || s.text]
      ELSE [CASE e.q WHEN 2 THEN 'user:' ELSE 'assistant:' END || s.text] END
  FROM way w JOIN seen s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.i = w.i + 1 JOIN ins n ON n.p = w.q
  JOIN edit e ON e.p = n.q AND (e.c = '' OR e.c = s.c) AND (e.letter = 'D' OR NOT (s.blank OR s.again))
  QUALIFY row_number() OVER (PARTITION BY s.conv_id, s.i, e.q ORDER BY total, whole) = 1),
last AS (SELECT w.conv_id, w.cost + 5 * n.k AS cost, w.audit || repeat('I', n.k) AS audit, w.kept || CASE n.k WHEN 0 THEN []
  WHEN 1 THEN [CASE n.q WHEN 2 THEN 'user:' ELSE 'assistant:' END] ELSE ['user:', 'assistant:'] END AS kept
  FROM way w JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.n = w.i JOIN ins n ON n.p = w.q AND n.q IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY w.conv_id ORDER BY w.cost + 5 * n.k, w.audit || repeat('I', n.k)) = 1)
SELECT c.conv_id, coalesce(f.gaps, 0)::BIGINT AS gaps, coalesce(f.blank, 0)::BIGINT AS blank, coalesce(f.duplicate, 0)::BIGINT AS duplicate,
  coalesce(f.truncated, 0)::BIGINT AS truncated, coalesce(f.illegal, 0)::BIGINT AS illegal, coalesce(l.cost, 0)::BIGINT AS cost,
  coalesce(l.audit, '') AS audit, sha256(coalesce(array_to_string(l.kept, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN last l ON l.conv_id IS NOT DISTINCT FROM c.conv_id"""
)
def op13_conversation_repair(spark, sf_dir):
    """Faults of every conversation after a fixed damage to its rows, and its cheapest repair."""
    return repair_structure(damaged(table(spark, sf_dir, "conversations")), copies=F.col("copies"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows dropped (``copies`` 0), emptied, without sentence ends, repeated (2) or made the user's, by a hash of conversation and turn."""
    spaced = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    kind = F.crc32(F.concat_ws(":", spaced["conv_id"], spaced["turn"])) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(spaced["text"], "[.!?]", "")).otherwise(spaced["text"])
    return conversations.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(spaced["role"]).alias("role"), text.alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )
