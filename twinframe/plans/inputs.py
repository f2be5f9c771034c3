"""The library's inputs as views of the driver's tables; the SQL of each view stands beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Documents as samples: source is the experiment, language the category, their pair the clip.
SAMPLES = """samples AS (SELECT 'd' || CAST(d.doc_id AS VARCHAR) AS sample_id, d.source AS experiment_key, d.lang AS category, d.source || '_' || d.lang AS clip_id,
  'group-' || CAST(CAST(substr(d.source, 4) AS INT) % 10 AS VARCHAR) AS leakage_group_id, COALESCE(l.quality, 1) = 1 AS usable, sha256(d.text) AS sha, sha256(replace(d.text, ' ', '')) AS bare_sha, d.n_chars AS n_chars
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


#: Two contents of a sample: its whole text, and that without blanks.
CONTENT = {"ir": "sha", "rgb": "bare_sha"}


def samples(spark, sf_dir) -> DataFrame:
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    return d.join(l, "doc_id", "left").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("sample_id"), F.col("source").alias("experiment_key"), F.col("lang").alias("category"), F.concat("source", F.lit("_"), "lang").alias("clip_id"),
        F.concat(F.lit("group-"), (F.expr("cast(substr(source, 4) as int)") % 10).cast("string")).alias("leakage_group_id"), (F.coalesce("quality", F.lit(1)) == 1).alias("usable"), F.sha2("text", 256).alias("sha"), F.sha2(F.replace("text", F.lit(" "), F.lit("")), 256).alias("bare_sha"), "n_chars")


#: A fixed split by the last digit of the group.
SPLITS = """group_splits AS (SELECT DISTINCT leakage_group_id, CASE WHEN right(leakage_group_id, 1) IN ('0', '1') THEN 'test' ELSE 'train_pool' END AS outer_split,
  CASE WHEN right(leakage_group_id, 1) IN ('0', '1') THEN 'test' WHEN right(leakage_group_id, 1) IN ('2', '3') THEN 'val' ELSE 'train' END AS inner_split FROM samples),
members AS (SELECT sample_id, inner_split AS split FROM samples JOIN group_splits USING (leakage_group_id) WHERE usable
  UNION ALL SELECT sample_id, 'train_pool' FROM samples JOIN group_splits USING (leakage_group_id) WHERE usable AND outer_split = 'train_pool')"""


def group_splits(rows: DataFrame) -> DataFrame:
    last = F.substring("leakage_group_id", -1, 1)
    return rows.select("leakage_group_id").distinct().select("leakage_group_id", F.when(last.isin("0", "1"), "test").otherwise("train_pool").alias("outer_split"), F.when(last.isin("0", "1"), "test").when(last.isin("2", "3"), "val").otherwise("train").alias("inner_split"))


#: Vectors as 8 x 8 images.
GRID = """grid AS (SELECT frame_id, i // 8 AS y, i % 8 AS x, v FROM (SELECT vec_id AS frame_id, unnest(range(0, 64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings))"""


def grid(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_id"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").alias("clip"))


#: The frame after a frame, as its other modality.
OTHER = "other AS (SELECT frame_id - 1 AS frame_id, y, x, v FROM grid)"


def size():
    return F.col("height"), F.col("width")


def both(spark, sf_dir, how: str = "inner") -> DataFrame:
    """Frames with their other modality as u."""
    g = grid(spark, sf_dir)
    return g.join(g.select((F.col("frame_id") - 1).alias("frame_id"), F.col("v").alias("u")), "frame_id", how)


#: Vectors as corner points that a fixed matrix maps, but for a little noise.
POINTS = """points AS (SELECT CAST(label AS BIGINT) AS grp, vec_id AS pt, vec_id % 5 AS pair, CAST(embedding[1] AS DOUBLE) AS ir_x, CAST(embedding[2] AS DOUBLE) AS ir_y,
  (1.1 * embedding[1]::DOUBLE + 0.02 * embedding[2]::DOUBLE + 3) / (1 + 0.001 * embedding[1]::DOUBLE) + 0.001 * embedding[3]::DOUBLE AS rgb_x,
  (0.03 * embedding[1]::DOUBLE + 0.9 * embedding[2]::DOUBLE + 2) / (1 + 0.001 * embedding[1]::DOUBLE) + 0.001 * embedding[4]::DOUBLE AS rgb_y FROM embeddings)"""


def points(spark, sf_dir) -> DataFrame:
    e = [F.col("embedding")[i].cast("double") for i in range(4)]
    d = 1 + 0.001 * e[0]
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("bigint").alias("grp"), F.col("vec_id").alias("pt"), (F.col("vec_id") % 5).alias("pair"), e[0].alias("ir_x"), e[1].alias("ir_y"), ((1.1 * e[0] + 0.02 * e[1] + 3) / d + 0.001 * e[2]).alias("rgb_x"), ((0.03 * e[0] + 0.9 * e[1] + 2) / d + 0.001 * e[3]).alias("rgb_y"))


MODEL = [1.1, 0.02, 3.0, 0.03, 0.9, 2.0, 0.001, 0.0, 1.0]

#: Two hashes of each vector: bits of values above the median of all but the first, and the same with three values negated.
HASHES = """raw AS (SELECT vec_id AS id, 'a' AS modality, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  UNION ALL SELECT vec_id + 1000000, 'a', list_concat(list_transform(embedding[1:3], lambda x: -CAST(x AS DOUBLE)), list_transform(embedding[4:], lambda x: CAST(x AS DOUBLE))) FROM embeddings),
bits AS (SELECT id, modality, list_transform(v, lambda x: CASE WHEN x > list_median(v[2:]) THEN '1' ELSE '0' END) AS b FROM raw),
hashes AS (SELECT id, modality, array_to_string(b, '') AS h FROM bits)"""


def hashes(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    raw = e.union(e.select(F.col("id") + 1000000, F.concat(F.transform(F.slice("v", 1, 3), lambda x: -x), F.expr("slice(v, 4, 64)"))))
    # the median of 63 values is the 32nd
    median = F.element_at(F.array_sort(F.expr("slice(v, 2, 63)")), 32)
    bits = F.array_join(F.transform("v", lambda x: F.when(x > median, "1").otherwise("0")), "")
    half = lambda at: F.conv(F.substring(bits, at, 32), 2, 10).cast("bigint")
    return raw.select("id", F.lit("a").alias("modality"), half(1).alias("hi"), half(33).alias("lo"))


#: Daily sums of two kinds of events, as the motion of two streams.
SERIES = """series AS (SELECT 'all' AS clip, CAST(date_diff('day', TIMESTAMP '2024-01-01', ts) AS INT) AS t, round(sum(CASE WHEN event_type = 'click' THEN value ELSE 0 END), 6) AS a,
  round(sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END), 6) AS b FROM events GROUP BY 2)"""


def series(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("t", F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")))
    total = lambda k: F.round(F.sum(F.when(F.col("event_type") == k, F.col("value")).otherwise(0.0)), 6)
    return rows.groupBy("t").agg(total("click").alias("a"), total("purchase").alias("b")).select(F.lit("all").alias("clip"), "t", "a", "b")


#: The events of a user as the frames of a clip.
FRAMES = """frames AS (SELECT user_id AS clip, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, round(value, 6) AS s1, 1.0 + CAST(hour(ts) AS DOUBLE) AS s2 FROM events)"""


def frames(spark, sf_dir) -> DataFrame:
    from pyspark.sql import Window as W

    rows = table(spark, sf_dir, "events")
    return rows.select(F.col("user_id").alias("clip"), (F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("bigint").alias("idx"), F.round("value", 6).alias("s1"), (1.0 + F.hour("ts").cast("double")).alias("s2"))
