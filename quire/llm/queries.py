"""Registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import balance, balltree, bpe, debruijn, filters, html, infill, minhash, mixing, quality, suffix, urls, vptree
from quire.session import table_path


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, "documents"))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text and what they decode to, as digests."""
    return bpe.round_trip(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every whole text; a fifth of the labels never teaches."""
    documents = _documents(spark, sf_dir)
    trees = quality.fit(documents, spark.read.parquet(table_path(sf_dir, "labels")))
    scored = quality.classify(documents.select("doc_id", "text"), trees, threshold=0.3)
    return scored.select("row.doc_id", quality.held_out(F.col("row.doc_id")).alias("held_out"), "score", "predicted")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = spark.read.parquet(table_path(sf_dir, "pages")).select("page_id", "url", "html")
    return html.extract(pages, html.train()).select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest inner products found for every twentieth vector; measured recall is 0.98 or more at this factor."""
    embeddings = spark.read.parquet(table_path(sf_dir, "embeddings"))
    return vptree.nearest(embeddings, F.col("vec_id") % 20 == 0, k=20, factor=0.17)


def op7_balltree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 highest whole-number inner products of every hundredth vector."""
    embeddings = spark.read.parquet(table_path(sf_dir, "embeddings"))
    return balltree.top_k(embeddings, F.col("vec_id") % 100 == 0, k=10)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards with counts at most one apart; equal texts together as far as there is room."""
    return balance.balanced_shards(_documents(spark, sf_dir), shards=8).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without bytes of 100-byte strings that also start earlier."""
    out = suffix.remove_repeats(_documents(spark, sf_dir), width=100)
    return out.select(
        "row.doc_id",
        "n_bytes",
        "n_removed",
        "n_spans",
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    mixed = mixing.pareto_mix(_documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of five-word shingles are similar to 0.85 or more."""
    out = minhash.near_duplicates(_documents(spark, sf_dir), percent=85, size=5)
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op9_debruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each document without words of 13-word windows that also start in a smaller document."""
    out = debruijn.remove_repeats(_documents(spark, sf_dir), width=13)
    return out.select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters does at each step of all their orders, per source."""
    rules = filters.conditions(F.coalesce(F.col("text"), F.lit("")))
    masks = filters.failed(_documents(spark, sf_dir), spark.read.parquet(table_path(sf_dir, "labels")), rules)
    return filters.audit(masks, [*rules, "E"])


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill-in-middle form of every whole text, and the text rebuilt from it, as digests."""
    out = infill.restore(infill.transform(_documents(spark, sf_dir).select("doc_id", "text"), seed=42, cut=50, spm=80))
    digests = [F.sha2(c, 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return out.select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, fitting rule and verdict of every url; where no rule fits, the purity of its path template decides."""
    out = urls.judge(spark.read.parquet(table_path(sf_dir, "pages")))
    return out.select("page_id", "host", "path", "rule", "template", "verdict")


OP6_SQL = r"""
WITH body AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
windows AS (SELECT doc_id, i, md5_number(substr(h, (2 * i + 1)::BIGINT, 200)) AS k FROM (SELECT *, unnest(range(n - 99)) AS i FROM body)),
later AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1),
marked AS (SELECT *, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100, true)::INT AS opens FROM later),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM marked)
  GROUP BY doc_id, g),
gaps AS (SELECT spans.doc_id, a, b, substr(h, 2 * coalesce(lag(b) OVER w, 0) + 1, 2 * (a - coalesce(lag(b) OVER w, 0))) AS gap,
  CASE WHEN lead(a) OVER w IS NULL THEN substr(h, 2 * b + 1) ELSE '' END AS rest
  FROM spans JOIN body USING (doc_id) WINDOW w AS (PARTITION BY spans.doc_id ORDER BY a)),
cut AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(gap || rest, '' ORDER BY a) AS kept FROM gaps GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM body LEFT JOIN cut USING (doc_id)
"""

OP10_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id
  GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sizes p ON x = p.doc_id JOIN sizes q ON y = q.doc_id WHERE 100 * k >= 85 * (p.n + q.n - k)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, y FROM reach JOIN edges ON other = x)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(other) AS component_id, d.doc_id = min(other) AS kept
FROM documents d JOIN reach USING (doc_id) LEFT JOIN sizes USING (doc_id) GROUP BY d.doc_id, n
"""

OP9_SQL = r"""
WITH listed AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS j FROM listed),
windows AS (SELECT doc_id, j, w[j] AS word,
  CASE WHEN j + 12 <= len(w) THEN md5_number(array_to_string(w[j:j + 12], ' ')) END AS k FROM words),
marked AS (SELECT doc_id, j, word, (k IS NOT NULL AND min(doc_id) OVER (PARTITION BY k) < doc_id)::INT AS gone FROM windows),
cut AS (SELECT doc_id, j, word, max(gone) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone
  FROM marked),
kept AS (SELECT doc_id, count(*) AS n_words, sum(gone) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (gone = 0) AS kept
  FROM cut GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN kept USING (doc_id)
"""

OP7_SQL = """
WITH whole AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""

OP8_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
weighed AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT]::DOUBLE AS w,
  source_size * 3.0::DOUBLE AS cap FROM per),
level AS (SELECT *, row_number() OVER (ORDER BY cap / w, source IS NULL, source) AS place,
  (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS lev
  FROM weighed WINDOW before AS (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
edge AS (SELECT min(place) AS place, min_by(lev, place) AS lev FROM level WHERE cap > lev * w),
target AS (SELECT source, source_size, CASE WHEN edge.place IS NULL OR level.place < edge.place THEN cap
  ELSE edge.lev * w END AS target FROM level, edge),
drawn AS (
  SELECT doc_id, s.source, size, source_size, target, floor(copies) AS sure, copies - floor(copies) AS pi,
    ('0x' || substr(md5('17|' || doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM (SELECT sizes.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS copies
    FROM sizes JOIN target ON sizes.source IS NOT DISTINCT FROM target.source) s),
odds AS (SELECT *, CASE WHEN pi > 0 THEN (u / (1 - u)) / (pi / (1 - pi)) END AS q, target - sure * source_size AS rest FROM drawn),
run AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY q, doc_id, size
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM odds)
SELECT doc_id, size, source_size, target,
  (size * (sure + CASE WHEN q IS NOT NULL AND before + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM run
"""

OP11_SQL = r"""
WITH listed AS (SELECT d.doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM documents d LEFT JOIN (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id) l
  ON d.doc_id = l.doc_id),
fails AS (SELECT part, good, toxic, MAP {
  'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w),
  'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t), 'D': regexp_matches(t, '[#$%&*|]'),
  'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)} AS f FROM listed),
masks AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders),
seen AS (SELECT filter_order, step, substr(filter_order, step::BIGINT, 1) AS x,
  string_split(substr(filter_order, 1, step::BIGINT - 1), '') AS before FROM steps),
counted AS (SELECT part, filter_order, step, x AS filter,
  sum(CASE WHEN NOT f[x] AND NOT hit THEN n ELSE 0 END) AS kept, sum(CASE WHEN f[x] AND NOT hit THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN f[x] AND hit THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN f[x] AND len(list_filter(map_values(f), lambda v: v)) = 1 THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN f[x] AND NOT hit THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN f[x] AND NOT hit THEN toxic ELSE 0 END) AS toxic_lost
  FROM (SELECT *, len(list_filter(before, lambda b: b <> '' AND f[b])) > 0 AS hit FROM masks, seen) GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, filter, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM counted
"""

OP12_SQL = r"""
WITH cut AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
  regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w FROM documents),
drawn AS (SELECT *, len(w) AS n, [('0x' || substr(h, 1, 8))::BIGINT % (len(w) + 1), ('0x' || substr(h, 9, 8))::BIGINT % (len(w) + 1)] AS c,
  CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 50 THEN 'plain'
    WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM cut),
parts AS (SELECT *, array_to_string(w[1:list_min(c)], '') AS p, array_to_string(w[list_min(c) + 1:list_max(c)], '') AS m,
  array_to_string(w[list_max(c) + 1:], '') AS s FROM drawn)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM parts
"""

_OP13_LEVEL = r"""
open{i} AS (SELECT *,
  CASE WHEN regexp_matches(rest[1], '\A(?:[0-9]+(?:[.][A-Za-z]+)?|[0-9]{{4}}-[0-9]{{2}}(?:-[0-9]{{2}})?|[0-9a-fA-F-]{{36}}|[*~])\z')
  OR length(rest[1]) >= 8 AND regexp_matches(rest[1], '\A[0-9a-fA-F]*[0-9][0-9a-fA-F]*\z') THEN '*' ELSE rest[1] END AS s FROM lvl{i} WHERE len(rest) > 0),
kids{i} AS (SELECT host, node, s, count(*)::BIGINT AS k, sum(good)::BIGINT AS g, sum(bad)::BIGINT AS b, any_value(purity) AS up
  FROM open{i} GROUP BY host, node, s),
named{i} AS (SELECT *, CASE WHEN s <> '*' AND k >= 3 AND k * 50 >= sum(k) OVER w THEN s ELSE '*' END AS name,
  (sum(g) OVER w)::DOUBLE AS gt, (sum(b) OVER w)::DOUBLE AS bt FROM kids{i} WINDOW w AS (PARTITION BY host, node)),
branch{i} AS (SELECT host, node, name, any_value(up) AS up, any_value(gt) AS gt, any_value(bt) AS bt, sum(g)::DOUBLE AS g, sum(b)::DOUBLE AS b
  FROM named{i} GROUP BY host, node, name),
like{i} AS (SELECT *, g + b = 0 OR gt + bt - g - b = 0 OR
  pow((g + h) / (g + b + 2 * h) - (gt - g + h) / (gt + bt - g - b + 2 * h), 2) <=
  3.84::DOUBLE * ((gt + h) / (gt + bt + 2 * h)) * (2 * h - (gt + h) / (gt + bt + 2 * h)) *
  (2 * h / (g + b + 2 * h) + 2 * h / (gt + bt - g - b + 2 * h)) AS alike FROM (SELECT *, 0.5::DOUBLE AS h FROM branch{i})),
joint{i} AS (SELECT *, alike AND sum(alike::INT) OVER w > 1 AS m, sum(g) FILTER (alike) OVER w AS jg, sum(b) FILTER (alike) OVER w AS jb
  FROM like{i} WINDOW w AS (PARTITION BY host, node)),
lvl{j} AS (SELECT page_id, host, path, rule, verdict, good, bad, rest[2:] AS rest, node || '/' || CASE WHEN m THEN '~' ELSE name END AS node,
  (CASE WHEN m THEN jg ELSE joint{i}.g END + 4 * joint{i}.up)
  / (CASE WHEN m THEN jg + jb ELSE joint{i}.g + joint{i}.b END + 4) AS purity
  FROM open{i} JOIN named{i} USING (host, node, s) JOIN joint{i} USING (host, node, name)),"""

OP13_SQL = (
    r"""
WITH cut AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)\A.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '(?s)\A.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
fit AS (SELECT *, CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
  WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule,
  list_filter(string_split(path, '/'), lambda x: x <> '') AS every FROM cut),
base AS (SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' ELSE 'block' END END
  AS verdict, coalesce(rule IN ('org/', 'com/fr/'), false)::INT AS good, coalesce(rule NOT IN ('org/', 'com/fr/'), false)::INT AS bad,
  CASE WHEN len(every) > 6 THEN list_append(every[1:5], array_to_string(every[6:], '/')) ELSE every END AS rest FROM fit),
whole AS (SELECT CASE WHEN sum(good + bad) > 0 THEN sum(good)::DOUBLE / sum(good + bad) ELSE 0.5::DOUBLE END AS prior FROM base),
hosts AS (SELECT host, (sum(good) + 4 * (SELECT prior FROM whole)) / (sum(good + bad) + 4) AS purity FROM base GROUP BY host),
lvl0 AS (SELECT base.*, '' AS node, purity FROM base JOIN hosts USING (host)),"""
    + "".join(_OP13_LEVEL.format(i=i, j=i + 1) for i in range(urls.DEPTH))
    + "\nlast AS ("
    + " UNION ALL BY NAME ".join(f"SELECT * FROM lvl{i} WHERE len(rest) = 0" for i in range(urls.DEPTH + 1))
    + ")\nSELECT page_id, host, path, rule, node AS template, "
    "coalesce(verdict, CASE WHEN purity < 0.5::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict FROM last"
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_quality": op2_quality,
    "op3_html": op3_html,
    "op4_vptree": op4_vptree,
    "op5_sharding": op5_sharding,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_balltree": op7_balltree,
    "op8_mixing": op8_mixing,
    "op9_debruijn": op9_debruijn,
    "op10_minhash": op10_minhash,
    "op11_filters": op11_filters,
    "op12_infill": op12_infill,
    "op13_urls": op13_urls,
    "pipeline": corpus_pipeline.run,
}
SQL: dict[str, str] = {
    "op6_suffix_dedup": OP6_SQL,
    "op7_balltree": OP7_SQL,
    "op8_mixing": OP8_SQL,
    "op9_debruijn": OP9_SQL,
    "op10_minhash": OP10_SQL,
    "op11_filters": OP11_SQL,
    "op12_infill": OP12_SQL,
    "op13_urls": OP13_SQL,
}
