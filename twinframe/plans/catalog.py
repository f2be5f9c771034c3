"""All queries of the library's own operators, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import keys
from ..operators import audit, augment, geometry, grid, neardup, pairing, resample, series, split
from ..sources import scans, sinks
from ..sources.scans import import_blockers, plan_import
from ..sources.sinks import plan_copies
from ..sources.steps import new_path
from ..streaming.intake import start_intake
from . import inputs as I
from .inputs import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    """Registers a function (spark, sf_dir) with its SQL."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def r6(df, *cols):
    """Doubles to six places; null stays null and minus zero becomes zero."""
    return df.withColumns({c: F.round(F.col(c), 6) + F.lit(0.0) for c in cols})


def flagship(spark, sf_dir):
    """Pairs and groups of each split and category under the searched split, beside the number of exact duplicates that leak."""
    rows = I.samples(spark, sf_dir)
    groups = split.nested_group_split(rows)
    members = pairing.split_members(rows, groups)
    leaks = audit.exact_duplicates(rows, members, I.CONTENT).where("level = 'fatal'").agg(F.count("*").alias("leaks"))
    return audit.category_counts(rows, members).join(leaks).orderBy("split", "category")


# --- projections -------------------------------------------------------------------------------------------


@query("""SELECT c_custkey, 'customer' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS id, CASE WHEN n % 3 <> 0 THEN 'day' || CAST(n AS VARCHAR) END AS day, 'experiment' || CAST(n AS VARCHAR) AS experiment,
  CASE WHEN n % 2 = 0 OR n % 5 <> 0 THEN CASE WHEN n < 100 THEN lpad(CAST(n AS VARCHAR), 2, '0') ELSE CAST(n AS VARCHAR) END END AS clip
  FROM (SELECT c_custkey, CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT) AS n FROM customer)""")
def p1_p2_norm_ids(spark, sf_dir):
    """Days that lack their word and clips with a blank inside are refused."""
    c = table(spark, sf_dir, "customer").withColumn("d", F.regexp_extract("c_name", "([0-9]+)$", 1)).withColumn("n", F.col("d").cast("bigint"))
    day = F.concat(F.when(F.col("n") % 3 != 0, "DAY").otherwise(""), "d")
    clip = F.when(F.col("n") % 2 == 0, F.col("d")).when(F.col("n") % 5 != 0, F.concat(F.lit("Clip"), "d")).otherwise(F.concat(F.lit("clip "), "d"))
    return c.select("c_custkey", keys.norm_id(F.concat(F.lit(" Customer"), "d"), "customer").alias("id"), keys.norm_day(day).alias("day"), keys.norm_experiment(F.col("d")).alias("experiment"), keys.norm_clip(clip).alias("clip"))


@query("SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'N' THEN 'none' END AS slug, CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'N' THEN 'N' END AS label, CASE l_returnflag WHEN 'A' THEN 'accepted' WHEN 'N' THEN 'none' END AS again FROM lineitem")
def p3_category_map(spark, sf_dir):
    slugs = {"A": "accepted", "N": "none"}
    rows = table(spark, sf_dir, "lineitem").withColumn("slug", keys.norm_category(F.col("l_returnflag"), slugs))
    return rows.select("l_orderkey", "l_linenumber", "slug", keys.category_label(F.col("slug"), slugs).alias("label"), keys.norm_category(F.col("slug"), slugs).alias("again"))


@query("SELECT doc_id, source || '__' || lang || '__c__k__' || CASE WHEN doc_id < 1000000 THEN lpad(CAST(doc_id AS VARCHAR), 6, '0') ELSE CAST(doc_id AS VARCHAR) END AS sample_id, source || '__' || lang AS experiment_key FROM documents")
def p4_sample_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", keys.sample_id(F.col("source"), F.col("lang"), F.lit("c"), F.lit("k"), F.col("doc_id")).alias("sample_id"), keys.experiment_key(F.col("source"), F.col("lang")).alias("experiment_key"))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN false END AS flag FROM events")
def p5_parse_bool(spark, sf_dir):
    words = F.element_at(F.array(*(F.lit(x) for x in (" Yes", "1", "no", "", "maybe"))), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", keys.parse_bool(words).alias("flag"))


@query("""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN p WHEN page_id % 4 = 3 THEN replace(p, '/', '\\') END IS NOT NULL AND p NOT LIKE '%//%' AND p NOT LIKE '%/' AND p <> '' AS safe,
  CASE WHEN p LIKE '%/%' THEN regexp_extract(p, '[^/]*$') ELSE p END AS ref FROM (SELECT page_id, regexp_replace(url, '^https?://', '') AS p FROM pages)""")
def p6_p7_paths(spark, sf_dir):
    p = F.regexp_replace("url", "^https?://", "")
    made = F.expr("case page_id % 4 when 0 then p when 1 then concat('/', p) when 2 then concat(p, '/../x') else replace(p, '/', '\\\\') end")
    return table(spark, sf_dir, "pages").select("page_id", p.alias("p")).select("page_id", keys.safe_path(made).isNotNull().alias("safe"), keys.source_ref(F.col("p")).alias("ref"))


@query("""SELECT l_orderkey, l_linenumber, '{"flag":"' || l_returnflag || '","key":' || CAST(l_orderkey AS VARCHAR) || ',"line":' || CAST(l_linenumber AS VARCHAR) || '}' AS json FROM lineitem""")
def p9_stable_json(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", keys.stable_json(line=F.col("l_linenumber"), key=F.col("l_orderkey"), flag=F.col("l_returnflag")).alias("json"))


@query("""SELECT doc_id, lower(source) AS task, CASE WHEN doc_id % 2 = 0 THEN lang || '/' || CAST(doc_id AS VARCHAR) ELSE CAST(doc_id AS VARCHAR) END AS path, sha256(text) AS sha256 FROM documents""")
def p8_normalise_summary(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.lit("C:"), F.when(F.col("doc_id") % 2 == 0, "input"), "lang", F.col("doc_id").cast("string"))
    side = F.struct(path.alias("path"), F.sha2("text", 256).alias("sha256"))
    d = d.select("doc_id", keys.normalise_summary(F.struct(side.alias("ir"), side.alias("rgb")), F.concat(F.lit(" "), F.upper("source"))).alias("s"))
    return d.select("doc_id", "s.task", "s.rgb.path", "s.ir.sha256")


@query(f"WITH {I.HASHES} SELECT a.id, CAST(hamming(a.h, b.h) AS BIGINT) AS distance FROM hashes a JOIN hashes b ON b.id = a.id + 1")
def p18_hamming(spark, sf_dir):
    h = I.hashes(spark, sf_dir)
    b = h.select((F.col("id") - 1).alias("id"), F.col("hi").alias("hi_b"), F.col("lo").alias("lo_b"))
    return h.join(b, "id").select("id", keys.hamming(F.col("hi"), F.col("lo"), F.col("hi_b"), F.col("lo_b")).cast("bigint").alias("distance"))


@query("SELECT event_id, event_id % 3 <> 1 AS matches, 'day1/clip/previews/' || CASE WHEN event_id < 1000000 THEN lpad(CAST(event_id AS VARCHAR), 6, '0') ELSE CAST(event_id AS VARCHAR) END || '.png' AS preview FROM events")
def p10_p11_names(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("f", F.concat(F.format_string("%06d", F.col("event_id").cast("int")), F.lit(".png")))
    return e.select("event_id", keys.name_matches_sequence(F.col("f"), F.col("event_id") + F.when(F.col("event_id") % 3 == 1, 1).otherwise(0)).alias("matches"), keys.preview_path(F.concat(F.lit("day1/clip/ir/"), "f")).alias("preview"))


@query("SELECT l_orderkey, l_linenumber, concat_ws(';', CASE WHEN l_discount > 0.08 THEN 'discount' END, CASE WHEN l_tax > 0.06 THEN 'tax' END, CASE WHEN l_returnflag = 'R' THEN 'returned' END) AS reason, NOT (l_discount > 0.08 OR l_tax > 0.06 OR l_returnflag = 'R') AS usable FROM lineitem")
def p12_usability(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("r", keys.reasons(discount=F.col("l_discount") > 0.08, tax=F.col("l_tax") > 0.06, returned=F.col("l_returnflag") == "R"))
    return rows.select("l_orderkey", "l_linenumber", F.array_join("r", ";").alias("reason"), (F.size("r") == 0).alias("usable"))


@query("""WITH m AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 1280 ELSE 640 END AS iw, CASE WHEN p_size % 7 = 0 THEN 25.1 ELSE 25.0 END AS rf, p_size % 11 = 0 AS lone, p_size % 13 = 0 AS odd FROM part)
SELECT p_partkey AS pair_key, 'error' AS level, 'ir_size' AS code FROM m WHERE iw <> 640 UNION ALL SELECT p_partkey, 'error', 'fps_differ' FROM m WHERE rf <> 25.0 AND NOT lone UNION ALL SELECT p_partkey, 'error', 'missing_rgb' FROM m WHERE lone UNION ALL SELECT p_partkey, 'error', 'unknown_category' FROM m WHERE odd""")
def p13_media_contract(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    side = lambda m, w, f: p.select(F.col("p_partkey").alias("pair_key"), F.lit(m).alias("modality"), w.alias("width"), F.lit(480).alias("height"), f.alias("fps"), F.lit(100).alias("frame_count"), F.when(F.col("p_size") % 13 == 0, "x").otherwise("health").alias("category"))
    ir = side("ir", F.when(F.col("p_size") % 5 == 0, 1280).otherwise(640), F.lit(25.0))
    p = p.where("p_size % 11 <> 0")
    return audit.check_media_pair(ir.union(side("rgb", F.lit(640), F.when(F.col("p_size") % 7 == 0, 25.1).otherwise(25.0))), 640, 480, categories=["health", "sick"])


@query("""SELECT p_partkey, round(p_size / 25.0, 6) AS seconds, abs(p_size / 10.0 - p_size * 1.004 / 10.0) <= 0.005 * (p_size * 1.004 / 10.0) AS aspect_ok, CAST(ceil(p_size * 20 / 16.0) * 16 AS BIGINT) AS padded_width,
  CASE WHEN ceil(p_size * 20 / 16.0) * 16 * ceil(p_size * 15 / 16.0) * 16 / 16 <= 12544 THEN 'full' ELSE 'sliding' END AS mode FROM part""")
def p14_p16_media_plan(spark, sf_dir):
    s = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(keys.duration(s, F.lit(25.0)), 6).alias("seconds"), keys.aspect_within(s, F.lit(10.0), s * 1.004, F.lit(10.0)).alias("aspect_ok"), keys.padded(s * 20, 16).alias("padded_width"), keys.inference_mode(s * 20, s * 15).alias("mode"))


@query(f"WITH {I.GRID}, {I.OTHER} SELECT frame_id, round(avg(0.299 * g.v + 0.587 * o.v + 0.114 * g.v), 6) + 0.0 AS luma FROM grid g JOIN other o USING (frame_id, y, x) GROUP BY frame_id")
def p17_luma(spark, sf_dir):
    grey = grid.luma(F.col("v"), F.col("u"), F.col("v"))
    return r6(I.both(spark, sf_dir).select("frame_id", grid.mean(grey).alias("luma")), "luma")


@query(f"WITH {I.GRID} SELECT frame_id, min(v) >= 0 AND max(v) <= 1 AS valid FROM (SELECT frame_id, CASE WHEN frame_id % 2 = 0 THEN abs(v) / 10 ELSE v END AS v FROM grid) GROUP BY frame_id")
def p19_unit_range(spark, sf_dir):
    v = F.when(F.col("frame_id") % 2 == 0, F.transform("v", lambda x: F.abs(x) / 10)).otherwise(F.col("v"))
    return I.grid(spark, sf_dir).select("frame_id", grid.check_unit_range(v).alias("valid"))


# --- joins and pairing ----------------------------------------------------------------------------------------

_SIDES = "a AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 7 <> 0), b AS (SELECT DISTINCT l_orderkey AS k FROM lineitem), c AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 11 <> 0)"


def _sides(spark, sf_dir):
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    key = lambda n: o.where(F.col("o_orderkey") % n != 0).select(F.col("o_orderkey").alias("k"))
    return key(7), l.select(F.col("l_orderkey").alias("k")).distinct(), key(11)


@query(f"""WITH {_SIDES}, j AS (SELECT k, a.k IS NULL AS na, b.k IS NULL AS nb, c.k IS NULL AS nc FROM a FULL JOIN b USING (k) FULL JOIN c USING (k))
SELECT k, concat_ws(';', CASE WHEN na THEN 'missing_ir' END, CASE WHEN nb THEN 'missing_rgb' END, CASE WHEN nc THEN 'missing_frame_metadata' END) AS reason, NOT (na OR nb OR nc) AS usable FROM
 (SELECT k, max(CASE WHEN s = 1 THEN 1 END) IS NULL AS na, max(CASE WHEN s = 2 THEN 1 END) IS NULL AS nb, max(CASE WHEN s = 3 THEN 1 END) IS NULL AS nc FROM (SELECT k, 1 AS s FROM a UNION ALL SELECT k, 2 FROM b UNION ALL SELECT k, 3 FROM c) GROUP BY k)""")
def j1_pair_samples(spark, sf_dir):
    return pairing.pair_samples(*_sides(spark, sf_dir), ["k"]).select("k", F.array_join("exclusion_reasons", ";").alias("reason"), "usable")


@query(f"WITH {_SIDES} SELECT 'only_left' AS code, k FROM a WHERE k NOT IN (SELECT k FROM b) UNION ALL SELECT 'only_right', k FROM b WHERE k NOT IN (SELECT k FROM a)")
def j2_pair_strict(spark, sf_dir):
    a, b, _ = _sides(spark, sf_dir)
    return pairing.pair_strict(a, b, ["k"])[1]


@query(f"WITH {_SIDES} SELECT k FROM a JOIN b USING (k)")
def j2_pair_strict_pairs(spark, sf_dir):
    a, b, _ = _sides(spark, sf_dir)
    return pairing.pair_strict(a, b, ["k"])[0]


_FILES = """files AS (SELECT CAST(s_nationkey AS INT) AS g, CASE WHEN s_suppkey % 2 = 0 THEN 'ir' ELSE 'rgb' END AS modality, CASE WHEN s_suppkey % 10 = 9 THEN 'x' || CAST(s_suppkey AS VARCHAR) ELSE lpad(CAST(s_suppkey // 2 % 7 AS VARCHAR), 2, '0') END AS stem FROM supplier)"""


def _files(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("int").alias("g"), F.when(k % 2 == 0, "ir").otherwise("rgb").alias("modality"), F.when(k % 10 == 9, F.concat(F.lit("x"), k.cast("string"))).otherwise(F.lpad(F.expr("s_suppkey div 2 % 7").cast("string"), 2, F.lit("0"))).alias("stem"))


@query(f"""WITH {_FILES}, n AS (SELECT g, modality, CAST(stem AS INT) AS number, count(*) AS c FROM files WHERE stem NOT LIKE 'x%' GROUP BY 1, 2, 3)
SELECT a.g, a.number FROM n a JOIN n b ON a.g = b.g AND a.number = b.number WHERE a.modality = 'ir' AND b.modality = 'rgb' AND a.c = 1 AND b.c = 1""")
def j3_pair_numeric(spark, sf_dir):
    return pairing.pair_numeric(_files(spark, sf_dir), ["g"])[0].select("g", "number")


@query(f"""WITH {_FILES}, n AS (SELECT g, modality, CAST(stem AS INT) AS number, min(stem) AS stem, count(*) AS c FROM files WHERE stem NOT LIKE 'x%' GROUP BY 1, 2, 3), s AS (SELECT * FROM n WHERE c = 1)
SELECT 'not_a_number' AS code, g, stem FROM files WHERE stem LIKE 'x%' UNION ALL SELECT 'ambiguous_number', g, stem FROM n WHERE c > 1
UNION ALL SELECT 'unpaired', g, stem FROM s WHERE NOT EXISTS (SELECT 1 FROM s t WHERE t.g = s.g AND t.number = s.number AND t.modality <> s.modality)""")
def j3_pair_numeric_issues(spark, sf_dir):
    return pairing.pair_numeric(_files(spark, sf_dir), ["g"])[1]


@query("""WITH a AS (SELECT lower(p_brand || p_type) AS stem_key, min(upper(p_brand || p_type)) AS a_stem, count(*) AS n FROM part WHERE p_size % 2 = 0 GROUP BY 1), b AS (SELECT lower(p_brand || p_type) AS stem_key, min(p_brand || p_type) AS b_stem, count(*) AS m FROM part WHERE p_size % 3 = 0 GROUP BY 1)
SELECT stem_key, a_stem, b_stem, COALESCE(n, 0) > 1 OR COALESCE(m, 0) > 1 AS is_duplicate FROM a FULL JOIN b USING (stem_key)""")
def j4_pair_casefold(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("s", F.concat("p_brand", "p_type"))
    return pairing.pair_casefold(p.where("p_size % 2 = 0").select(F.upper("s").alias("s")), p.where("p_size % 3 = 0").select("s"), "s")


@query("""WITH a AS (SELECT l_orderkey AS clip, l_linenumber AS k FROM lineitem WHERE l_linenumber % 2 = 0), b AS (SELECT l_orderkey AS clip, CASE WHEN l_orderkey % 3 = 0 THEN l_linenumber ELSE l_linenumber + 100 END AS k FROM lineitem WHERE l_linenumber % 4 < 3),
x AS (SELECT clip, a.k FROM a JOIN b USING (clip) WHERE a.k = b.k)
SELECT clip, k AS a_key, k AS b_key, 'key' AS how FROM x UNION ALL SELECT clip, p.k, q.k, 'position' FROM (SELECT clip, k, row_number() OVER (PARTITION BY clip ORDER BY k) AS i FROM a) p JOIN (SELECT clip, k, row_number() OVER (PARTITION BY clip ORDER BY k) AS i FROM b) q USING (clip, i) WHERE clip NOT IN (SELECT clip FROM x)""")
def j5_pair_or_zip(spark, sf_dir):
    """Lines of an order as the frames of a clip; an order may have a line number twice."""
    n = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("clip"), F.col("l_linenumber").alias("k"))
    return pairing.pair_or_zip(n.where("k % 2 = 0"), n.where("k % 4 < 3").withColumn("k", F.when(F.col("clip") % 3 == 0, F.col("k")).otherwise(F.col("k") + 100)), "clip", "k")


@query("""SELECT c_custkey, n_name AS leakage_group_id, CASE WHEN n_name IS NULL THEN 'unmatched' END AS issue FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 5 <> 0) ON c_nationkey = n_nationkey""")
def j6_attach_groups(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("k"))
    n = table(spark, sf_dir, "nation").where("n_nationkey % 5 <> 0").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("leakage_group_id"))
    return pairing.attach_groups(c, n, ["k"]).select("c_custkey", "leakage_group_id", "issue")


@query("""WITH e AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_nationkey % 3 <> 0), m AS (SELECT n_nationkey AS k FROM nation WHERE n_nationkey % 4 <> 0)
SELECT COALESCE(e.k, m.k) AS k, CASE WHEN m.k IS NULL THEN 'experiment_without_model' WHEN e.k IS NULL THEN 'model_without_experiment' ELSE 'matched' END AS status FROM e FULL JOIN m ON e.k = m.k""")
def j7_match_models(spark, sf_dir):
    s, n = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")), table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    return pairing.match_models(s.where("k % 3 <> 0"), n.where("k % 4 <> 0"), ["k"])


@query("""WITH o AS (SELECT user_id, event_type, 0 AS r, event_id, value FROM events WHERE event_id % 2 = 0 UNION ALL SELECT user_id, event_type, 1, event_id, value FROM events WHERE event_id % 3 = 0)
SELECT user_id, event_type, event_id, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY r DESC, event_id DESC) AS i FROM o) WHERE i = 1""")
def j8_upsert(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return r6(pairing.upsert_pairs(e.where("event_id % 2 = 0"), e.where("event_id % 3 = 0"), ["user_id", "event_type"]), "value")


@query("""WITH f AS (SELECT o_custkey AS task, CASE WHEN o_orderkey % 2 = 0 THEN 'ir' ELSE 'rgb' END AS modality, CAST(o_orderkey % 5 AS INT) AS number FROM orders), n AS (SELECT task, modality, number, count(*) AS c FROM f GROUP BY 1, 2, 3)
SELECT a.task, 2 AS schema_version, string_agg(lpad(CAST(a.number AS VARCHAR), 2, '0'), ',' ORDER BY a.number) AS clips FROM n a JOIN n b ON a.task = b.task AND a.number = b.number AND a.modality = 'ir' AND b.modality = 'rgb' WHERE a.c = 1 AND b.c = 1 GROUP BY a.task""")
def j9_migrate_jobs(spark, sf_dir):
    """A customer's orders as the files of a job."""
    f = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("task"), F.struct(F.when(F.col("o_orderkey") % 2 == 0, "ir").otherwise("rgb").alias("modality"), (F.col("o_orderkey") % 5).cast("string").alias("stem")).alias("f"))
    v2 = pairing.migrate_jobs(f.groupBy("task").agg(F.collect_list("f").alias("files")))
    return v2.select("task", "schema_version", F.array_join(F.transform("pairs", lambda p: F.format_string("%02d", p["clip"])), ",").alias("clips"))


@query("""WITH m AS (SELECT user_id AS clip, count(*) AS n FROM events GROUP BY 1), f AS (SELECT clip, n, unnest(range(0, n)) AS i FROM m)
SELECT clip, CAST(i AS INT) AS base_index, round(i / 10.0, 6) AS t, CAST(least(n + 4, round_even(i / 10.0 * 15.0, 0)) AS BIGINT) AS other_index FROM f WHERE i < floor(least(n / 10.0, (n + 5) / 15.0) * 10.0)""")
def j10_align_streams(spark, sf_dir):
    m = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("clip")).agg(F.count("*").alias("base_frames"))
    return pairing.align_streams(m.select("clip", F.lit(10.0).cast("double").alias("base_fps"), "base_frames", F.lit(15.0).cast("double").alias("other_fps"), (F.col("base_frames") + 5).alias("other_frames")))


@query("""WITH e AS (SELECT user_id, event_id FROM events) SELECT user_id, CAST(count(CASE WHEN event_id % 6 = 0 THEN 1 END) AS BIGINT) AS common, CAST(count(CASE WHEN event_id % 2 = 0 THEN 1 END) AS BIGINT) AS n_a, CAST(count(CASE WHEN event_id % 3 = 0 THEN 1 END) AS BIGINT) AS n_b,
 count(CASE WHEN event_id % 2 = 0 THEN 1 END) <> count(CASE WHEN event_id % 3 = 0 THEN 1 END) AS ended_early FROM e WHERE event_id % 2 = 0 OR event_id % 3 = 0 GROUP BY user_id""")
def j11_align_by_index(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id")
    return pairing.align_by_index(e.where("event_id % 2 = 0"), e.where("event_id % 3 = 0"), "user_id", "event_id")


@query(f"WITH {I.SAMPLES}, {I.SPLITS} SELECT sample_id, split FROM members")
def j12_split_members(spark, sf_dir):
    s = I.samples(spark, sf_dir)
    return pairing.split_members(s, I.group_splits(s))


@query(f"WITH {I.SAMPLES}, {I.SPLITS} SELECT sample_id, experiment_key, category FROM samples JOIN members USING (sample_id) WHERE split = 'val'")
def j13_select_split(spark, sf_dir):
    s = I.samples(spark, sf_dir)
    return pairing.select_split(s, pairing.split_members(s, I.group_splits(s)), "val")[0].select("sample_id", "experiment_key", "category")


@query("""WITH d AS (SELECT a.label AS grp, a.vec_id AS a_id, b.vec_id AS b_id, sqrt(list_sum(list_transform(range(1, 65), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) * (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE)))) AS d FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 2 = 0 AND b.vec_id % 2 = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY grp, a_id ORDER BY d, b_id) AS r FROM d)
SELECT x.grp, x.a_id, x.b_id, round(x.d, 6) AS d1 FROM r x JOIN r y ON x.a_id = y.a_id AND x.r = 1 AND y.r = 2 WHERE x.d < 0.95 * y.d""")
def j14_ratio_match(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("grp"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return r6(neardup.ratio_match(e.where("id % 2 = 0"), e.where("id % 2 = 1"), ["grp"], 0.95).select("grp", "a_id", "b_id", "d1"), "d1")


# --- near duplicates --------------------------------------------------------------------------------------------


@query(f"WITH {I.HASHES} SELECT a.modality, a.id AS id_a, b.id AS id_b, CAST(hamming(a.h, b.h) AS BIGINT) AS distance FROM hashes a JOIN hashes b ON a.id < b.id WHERE hamming(a.h, b.h) <= 5")
def n2_near_duplicates(spark, sf_dir):
    return neardup.near_duplicates(I.hashes(spark, sf_dir), 5)


@query(f"""WITH {I.HASHES}, shared AS (SELECT modality, CASE WHEN id % 7 = 0 THEN repeat('0', 64) ELSE h END AS h, id FROM hashes), c AS (SELECT modality, h, min(id) AS class, CAST(count(*) AS BIGINT) AS n FROM shared GROUP BY 1, 2)
SELECT a.modality, a.class AS class_a, b.class AS class_b, CAST(hamming(a.h, b.h) AS BIGINT) AS distance, a.n AS n_a, b.n AS n_b FROM c a JOIN c b ON a.modality = b.modality AND (a.class < b.class OR (a.class = b.class AND a.n > 1)) WHERE hamming(a.h, b.h) <= 5""")
def n2_near_classes(spark, sf_dir):
    """A seventh of the hashes are those of a flat frame."""
    flat = lambda c: F.when(F.col("id") % 7 == 0, F.lit(0).cast("bigint")).otherwise(F.col(c))
    return neardup.near_classes(I.hashes(spark, sf_dir).withColumns({"hi": flat("hi"), "lo": flat("lo")}), 5)


@query(f"""WITH {I.HASHES}, s AS (SELECT id, 'g' || CAST(id % 10 AS VARCHAR) AS grp, CASE WHEN id % 10 < 2 THEN 'test' WHEN id % 10 < 4 THEN 'val' ELSE 'train' END AS split FROM hashes WHERE id % 9 <> 0)
SELECT a.modality, a.id AS id_a, b.id AS id_b, CAST(hamming(a.h, b.h) AS BIGINT) AS distance, x.grp AS group_a, y.grp AS group_b, x.split AS split_a, y.split AS split_b, x.split <> y.split AS cross_split
FROM hashes a JOIN hashes b ON a.id < b.id JOIN s x ON x.id = a.id JOIN s y ON y.id = b.id WHERE hamming(a.h, b.h) <= 22""")
def n2_annotated_duplicates(spark, sf_dir):
    """With groups and splits by the last digit of the id; every ninth sample is unusable. The threshold is wide, so that pairs cross splits."""
    h = I.hashes(spark, sf_dir)
    digit = F.col("id") % 10
    s = h.select(F.col("id").alias("sample_id"), F.concat(F.lit("g"), digit.cast("string")).alias("leakage_group_id"), (F.col("id") % 9 != 0).alias("usable"), F.when(digit < 2, "test").when(digit < 4, "val").otherwise("train").alias("split"))
    m = s.select("sample_id", "split").union(s.where("split <> 'test'").select("sample_id", F.lit("train_pool")))
    return neardup.duplicate_report(h, s, m, 22)


def _weights(name, size, out, how):
    """SQL of name (o, i, w): what pixel i of size adds to pixel o of out."""
    if how == "area":
        raw = f"greatest(0.0, least((o + 1) * {size} / {out}.0, i + 1) - greatest(o * {size} / {out}.0, i))"
    else:
        wide, reach = max(1.0, size / out), {"lanczos": 3, "bilinear": 1}[how]
        x = f"((i + 0.5 - (o + 0.5) * {size} / {out}.0) / {wide})"
        sinc = lambda x: f"(CASE WHEN {x} = 0 THEN 1.0 ELSE sin(pi() * {x}) / (pi() * {x}) END)"
        kernel = f"CASE WHEN abs({x}) < 3 THEN {sinc(x)} * {sinc(f'({x} / 3)')} ELSE 0.0 END" if how == "lanczos" else f"greatest(0.0, 1 - abs({x}))"
        raw = f"CASE WHEN i >= floor((o + 0.5) * {size} / {out}.0 - {reach * wide} + 0.5) AND i < floor((o + 0.5) * {size} / {out}.0 + {reach * wide} + 0.5) THEN {kernel} ELSE 0.0 END"
    return f"{name} AS (SELECT o, i, w / sum(w) OVER (PARTITION BY o) AS w FROM (SELECT o, i, {raw} AS w FROM range({out}) a(o), range({size}) b(i)))"


def _resampled(name, of, weights, round_to=""):
    """SQL of name (frame_id, y, x, v): pixels of a table in another size, along rows, then columns."""
    cut = "least(255.0, greatest(0.0, floor({} + 0.5)))" if round_to else "{}"
    return f"{name}_x AS (SELECT frame_id, y, o AS x, {cut.format('sum(w * v)')} AS v FROM {of} JOIN {weights} ON i = x AND w <> 0 GROUP BY 1, 2, 3), {name} AS (SELECT frame_id, o AS y, x, {cut.format('sum(w * v)')} AS v FROM {name}_x JOIN {weights} ON i = y AND w <> 0 GROUP BY 1, 2, 3)"


_BYTES = f"{I.GRID}, bytes AS (SELECT frame_id, y, x, CASE WHEN hi > lo THEN floor((v - lo) / (hi - lo) * 255) ELSE 0.0 END AS v FROM (SELECT *, min(v) OVER (PARTITION BY frame_id) AS lo, max(v) OVER (PARTITION BY frame_id) AS hi FROM grid))"


@query(f"""WITH {_BYTES}, {_weights('wide', 8, 32, 'lanczos')}, {_resampled('big', 'bytes', 'wide', '255')},
c AS (SELECT i, k, cos(pi() * (2 * i + 1) * k / 64) * sqrt(2 / 32.0) * CASE k WHEN 0 THEN 1 / sqrt(2) ELSE 1 END AS c FROM range(32) a(i), range(8) b(k)),
r AS (SELECT frame_id, y, k AS kx, sum(v * c) AS v FROM big JOIN c ON x = i GROUP BY 1, 2, 3), t AS (SELECT frame_id, k AS ky, kx, sum(v * c) AS v FROM r JOIN c ON y = i GROUP BY 1, 2, 3),
m AS (SELECT frame_id, median(v) AS m FROM t WHERE ky + kx > 0 GROUP BY 1)
SELECT frame_id, CAST(sum(CASE WHEN ky < 4 AND v > m THEN 1::BIGINT << (31 - (ky * 8 + kx)) ELSE 0 END) AS BIGINT) AS hi, CAST(sum(CASE WHEN ky >= 4 AND v > m THEN 1::BIGINT << (63 - (ky * 8 + kx)) ELSE 0 END) AS BIGINT) AS lo FROM t JOIN m USING (frame_id) GROUP BY 1""")
def n1_phash(spark, sf_dir):
    """Frames of 8 x 8 bytes, brought to 32 x 32."""
    return I.grid(spark, sf_dir).withColumn("v", grid.normalise_8bit(F.col("v"))).select("frame_id", neardup.phash(F.col("v"), F.col("height"), F.col("width")).alias("h")).select("frame_id", "h.hi", "h.lo")


@query(f"""WITH {I.GRID}, {_weights('l', 8, 5, 'lanczos')}, {_weights('b', 8, 5, 'bilinear')}, {_weights('a', 8, 5, 'area')}, {_resampled('x', 'grid', 'l')}, {_resampled('z', 'grid', 'b')}, {_resampled('q', 'grid', 'a')}
SELECT frame_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, round(x.v, 6) + 0.0 AS lanczos, round(z.v, 6) + 0.0 AS bilinear, round(q.v, 6) + 0.0 AS area FROM x JOIN z USING (frame_id, y, x) JOIN q USING (frame_id, y, x)""")
def s3_resample(spark, sf_dir):
    """Frames of 8 shrunk to 5 by every kernel."""
    to = F.lit(5)
    rows = I.grid(spark, sf_dir).select("frame_id", *(resample.resample(F.col("v"), *I.size(), to, to, how).alias(how) for how in ("lanczos", "bilinear", "area")))
    at = rows.select("frame_id", F.posexplode(F.arrays_zip("lanczos", "bilinear", "area")).alias("i", "p"))
    return r6(at.select("frame_id", F.expr("cast(i div 5 as int)").alias("y"), F.expr("cast(i % 5 as int)").alias("x"), "p.*"), "lanczos", "bilinear", "area")


# --- aggregations and audit ----------------------------------------------------------------------------------------

_REQUIRED = ["de", "en", "es", "fr"]


@query(f"""WITH {I.SAMPLES}, c AS (SELECT experiment_key, category, count(DISTINCT clip_id) AS n FROM samples GROUP BY 1, 2), g AS (SELECT experiment_key, count(DISTINCT leakage_group_id) AS n_groups FROM samples GROUP BY 1),
w AS (SELECT experiment_key, 4 - count(*) FILTER (category IN ('de', 'en', 'es', 'fr')) AS lacking, count(*) FILTER (n <> 1) AS bad FROM c GROUP BY 1)
SELECT experiment_key, CAST(lacking AS BIGINT) AS n_missing, CAST(bad AS BIGINT) AS bad_clip_counts, CAST(n_groups AS BIGINT) AS n_groups, lacking = 0 AND bad = 0 AND n_groups = 1 AS ok FROM w JOIN g USING (experiment_key)""")
def a1_experiment_contract(spark, sf_dir):
    n = F.when(F.col("missing") == "", 0).otherwise(F.size(F.split("missing", ","))).cast("bigint")
    return audit.experiment_contract(I.samples(spark, sf_dir), _REQUIRED).select("experiment_key", n.alias("n_missing"), "bad_clip_counts", "n_groups", "ok")


@query(f"""WITH {I.SAMPLES} SELECT leakage_group_id, string_agg(DISTINCT experiment_key, ',' ORDER BY experiment_key) AS experiment_keys, string_agg(DISTINCT category, ',' ORDER BY category) AS categorys, CAST(count(*) FILTER (usable) AS BIGINT) AS pair_count,
 concat_ws(',', CASE WHEN count(DISTINCT experiment_key) > 1 THEN 'experiment_key' END, CASE WHEN count(DISTINCT category) > 1 THEN 'category' END) AS not_single FROM samples GROUP BY 1""")
def a2_group_rollup(spark, sf_dir):
    return audit.group_rollup(I.samples(spark, sf_dir), ["experiment_key", "category"], ["experiment_key", "category"])


_FEATURES = """u AS (SELECT * FROM samples WHERE usable), features AS (SELECT leakage_group_id, 'pairs' AS kind, 'all' AS name, CAST(count(*) AS DOUBLE) AS value FROM u GROUP BY 1
 UNION ALL SELECT leakage_group_id, 'experiments', 'all', CAST(count(DISTINCT experiment_key) AS DOUBLE) FROM u GROUP BY 1 UNION ALL SELECT leakage_group_id, 'category', category, CAST(count(*) AS DOUBLE) FROM u GROUP BY 1, 3)"""


@query(f"WITH {I.SAMPLES}, {_FEATURES} SELECT * FROM features")
def a3_group_features(spark, sf_dir):
    return split.group_features(I.samples(spark, sf_dir))


_LIGHT = "CASE CAST(substr(sample_id, 2) AS BIGINT) % 3 WHEN 0 THEN '' WHEN 1 THEN category END"


@query(f"WITH {I.SAMPLES}, {_FEATURES} SELECT * FROM features UNION ALL SELECT DISTINCT leakage_group_id, 'metadata', 'light=' || light, 1.0 FROM (SELECT *, {_LIGHT} AS light FROM u) WHERE light <> ''")
def a3_metadata_features(spark, sf_dir):
    """A field that is empty in a third of the samples and null in another."""
    n = F.substring("sample_id", 2, 20).cast("bigint") % 3
    return split.group_features(I.samples(spark, sf_dir).withColumn("light", F.when(n == 0, "").when(n == 1, F.col("category"))), ("light",))


@query(f"WITH {I.SAMPLES}, {I.SPLITS} SELECT split, category, CAST(count(*) AS BIGINT) AS pairs, CAST(count(DISTINCT leakage_group_id) AS BIGINT) AS groups FROM members JOIN samples USING (sample_id) GROUP BY 1, 2")
def a4_category_counts(spark, sf_dir):
    s = I.samples(spark, sf_dir)
    return audit.category_counts(s, pairing.split_members(s, I.group_splits(s)))


@query(f"WITH {I.SAMPLES} SELECT CAST(count(DISTINCT leakage_group_id) AS BIGINT) AS groups, count(DISTINCT leakage_group_id) >= 6 AS enough FROM samples WHERE usable")
def a5_sufficiency(spark, sf_dir):
    return audit.sufficiency(I.samples(spark, sf_dir), 6)


_ODD_CLIPS = """odd AS (SELECT experiment_key, CASE WHEN leakage_group_id = 'group-3' AND n % 40 = 0 THEN 'xx' ELSE category END AS category, clip_id || CASE WHEN leakage_group_id IN ('group-1', 'group-2') THEN CAST(n % 2 AS VARCHAR) ELSE '' END AS clip_id FROM (SELECT *, CAST(substr(sample_id, 2) AS BIGINT) AS n FROM samples))"""


def _odd_clips(spark, sf_dir):
    """Samples of which two groups have two clips in a category, and one a category that nobody asked for."""
    n = F.substring("sample_id", 2, 20).cast("bigint")
    s = I.samples(spark, sf_dir).withColumn("clip_id", F.concat("clip_id", F.when(F.col("leakage_group_id").isin("group-1", "group-2"), (n % 2).cast("string")).otherwise("")))
    return s.withColumn("category", F.when((F.col("leakage_group_id") == "group-3") & (n % 40 == 0), "xx").otherwise(F.col("category")))


@query(f"""WITH {I.SAMPLES}, {_ODD_CLIPS}, k AS (SELECT experiment_key, category, count(DISTINCT clip_id) AS clips FROM odd GROUP BY 1, 2),
c AS (SELECT count(*) AS n FROM (SELECT experiment_key FROM k GROUP BY 1 HAVING list_sort(list(category)) = ['de', 'en', 'es', 'fr'] AND bool_and(clips = 1)))
SELECT category, CAST(count(DISTINCT clip_id) AS BIGINT) AS clips, CAST((SELECT n FROM c) AS BIGINT) AS complete_experiments FROM odd GROUP BY 1""")
def a6_readiness(spark, sf_dir):
    return audit.readiness(_odd_clips(spark, sf_dir), _REQUIRED)


@query("""WITH r AS (SELECT sha256('{"l_orderkey":"' || CAST(l_orderkey AS VARCHAR) || '","l_linenumber":"' || CAST(l_linenumber AS VARCHAR) || '","l_returnflag":"' || l_returnflag || '"}') AS h FROM lineitem)
SELECT sha256(concat_ws(':', count(*), sum(CAST('0x' || substr(h, 1, 15) AS HUGEINT)), sum(CAST('0x' || substr(h, 16, 15) AS HUGEINT)), sum(CAST('0x' || substr(h, 31, 15) AS HUGEINT)), sum(CAST('0x' || substr(h, 46, 15) AS HUGEINT)))) AS digest FROM r""")
def a7_table_digest(spark, sf_dir):
    return audit.table_digest(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_returnflag"])


@query(f"""WITH {I.SAMPLES}, {I.SPLITS}, h AS (SELECT sample_id, leakage_group_id, 'ir' AS modality, sha FROM samples UNION ALL SELECT sample_id, leakage_group_id, 'rgb', CASE WHEN n_chars % 5 <> 0 THEN bare_sha END FROM samples)
SELECT modality, sha, CAST(count(DISTINCT leakage_group_id) AS BIGINT) AS groups, CAST(count(DISTINCT split) AS BIGINT) AS splits, CAST(count(DISTINCT sample_id) AS BIGINT) AS copies, CASE WHEN count(DISTINCT split) > 1 THEN 'fatal' ELSE 'warning' END AS level,
 CASE WHEN count(DISTINCT split) > 1 THEN 'cross_split_exact_duplicate' ELSE 'cross_group_exact_duplicate' END AS code FROM h LEFT JOIN (SELECT * FROM members WHERE split <> 'train_pool') USING (sample_id) WHERE sha IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT leakage_group_id) > 1""")
def a8_exact_duplicates(spark, sf_dir):
    """One in five samples lacks its second hash."""
    s = I.samples(spark, sf_dir)
    return audit.exact_duplicates(s.withColumn("bare_sha", F.when(F.col("n_chars") % 5 != 0, F.col("bare_sha"))), pairing.split_members(s, I.group_splits(s)), I.CONTENT)


@query("""SELECT sha256(text) AS sha, CAST(count(DISTINCT source) AS BIGINT) AS tasks, CAST(count(*) AS BIGINT) AS files FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1""")
def a9_duplicate_media(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("task"), F.col("n_chars").alias("length"), "text")
    return audit.duplicate_media(d, lambda f: f.select("task", F.sha2("text", 256).alias("sha")))


@query(f"""WITH {I.SAMPLES}, {I.SPLITS} SELECT sha AS fp, CAST(count(DISTINCT inner_split) AS BIGINT) AS splits FROM samples JOIN group_splits USING (leakage_group_id) GROUP BY 1 HAVING count(DISTINCT inner_split) > 1""")
def a10_fingerprint_leaks(spark, sf_dir):
    s = I.samples(spark, sf_dir)
    return audit.fingerprint_leaks(s.select("leakage_group_id", F.array("sha").alias("fingerprints")), I.group_splits(s))


@query("""WITH e AS (SELECT p_brand, abs(l_extendedprice - l_quantity * p_retailprice) / 1000 AS e FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT p_brand, round(sqrt(avg(e * e)), 8) AS rmse, round(quantile_cont(e, 0.5), 8) AS median, round(quantile_cont(e, 0.95), 8) AS p95, round(max(e), 8) AS max_error, CAST(count(*) FILTER (e <= 1) AS BIGINT) AS within_1 FROM e GROUP BY 1""")
def a11_error_metrics(spark, sf_dir):
    l, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    e = l.join(p, l.l_partkey == p.p_partkey).select("p_brand", (F.abs(F.col("l_extendedprice") - F.col("l_quantity") * F.col("p_retailprice")) / 1000).alias("e"))
    return series.error_metrics(e, ["p_brand"]).select("p_brand", *(F.round(c, 8).alias(c) for c in ("rmse", "median", "p95", "max_error")), "within_1")


@query("""SELECT l_linestatus, round(sqrt(avg(e * e)), 8) AS rmse, round(quantile_cont(e, 0.5), 8) AS median, round(quantile_cont(e, 0.95), 8) AS p95, round(max(e), 8) AS max_error, CAST(count(*) FILTER (e <= 1) AS BIGINT) AS within_1 FROM (SELECT l_linestatus, l_extendedprice / 10000 AS e FROM lineitem) GROUP BY 1""")
def a11_error_metrics_by_selection(spark, sf_dir):
    """Two large groups, whose quantiles are found by narrowing."""
    e = table(spark, sf_dir, "lineitem").select("l_linestatus", (F.col("l_extendedprice") / 10000).alias("e"))
    return series.error_metrics(e, ["l_linestatus"], large=1000).select("l_linestatus", *(F.round(c, 8).alias(c) for c in ("rmse", "median", "p95", "max_error")), "within_1")


@query("SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n, round(min(l_quantity / 50), 6) AS min_ratio, round(avg(l_quantity / 50), 6) AS mean_ratio, round(max(l_quantity / 50), 6) AS max_ratio, CAST(count(*) FILTER (l_quantity / 50 < 0.5) AS BIGINT) AS warnings FROM lineitem GROUP BY 1")
def a12_coverage_summary(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumn("ratio", F.col("l_quantity") / 50)
    return r6(series.coverage_summary(l, "l_returnflag", "ratio"), "min_ratio", "mean_ratio", "max_ratio")


@query("SELECT r_name, n_name, CAST(count(*) AS BIGINT) AS pairs FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def a13_preflight(spark, sf_dir):
    c, n, r = (table(spark, sf_dir, x) for x in ("customer", "nation", "region"))
    return series.preflight(c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey), ["r_name", "n_name"])


@query("""WITH m AS (SELECT event_type AS run, CAST(day(ts) AS INT) AS epoch, round(sum(value * n) / sum(n), 6) AS mean_loss FROM (SELECT *, 1 + event_id % 4 AS n FROM events) GROUP BY 1, 2)
SELECT run, epoch, mean_loss, COALESCE(mean_loss < min(mean_loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved FROM m""")
def a14_metric_history(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("event_type").alias("run"), F.dayofmonth("ts").alias("epoch"), F.col("value").alias("loss"), (1 + F.col("event_id") % 4).alias("n"))
    return r6(series.metric_history(log), "mean_loss")


@query(f"""WITH {I.GRID} SELECT frame_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, CAST(CASE WHEN hi > lo THEN floor((v - lo) / (hi - lo) * 255) ELSE 0 END AS INT) AS v FROM (SELECT *, min(v) OVER (PARTITION BY frame_id) AS lo, max(v) OVER (PARTITION BY frame_id) AS hi FROM grid)""")
def a15_normalise_8bit(spark, sf_dir):
    return grid.to_pixels(I.grid(spark, sf_dir).withColumn("v", grid.normalise_8bit(F.col("v"))))


# --- windows and series ----------------------------------------------------------------------------------------------

_JOINT = f"""{I.FRAMES}, m AS (SELECT clip, greatest(median(s1), 1e-9) AS ma, greatest(median(s2), 1e-9) AS mb FROM frames GROUP BY 1), j AS (SELECT clip, idx, CASE WHEN s1 / ma + s2 / mb > 0 THEN 2 * (s1 / ma) * (s2 / mb) / (s1 / ma + s2 / mb) ELSE 0 END AS joint FROM frames JOIN m USING (clip))"""


@query(f"WITH {_JOINT} SELECT clip, idx, round(joint, 6) AS joint FROM j")
def w1_joint_score(spark, sf_dir):
    return r6(series.joint_score(I.frames(spark, sf_dir), "clip", "s1", "s2").select("clip", "idx", "joint"), "joint")


@query(f"""WITH {_JOINT}, b AS (SELECT *, ntile(4) OVER (PARTITION BY clip ORDER BY idx) AS bin, count(*) OVER (PARTITION BY clip) AS n FROM j), p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY clip, bin ORDER BY round(joint, 9) DESC, idx) AS r FROM b WHERE n >= 4) WHERE r = 1),
s AS (SELECT clip, idx, CAST(row_number() OVER (PARTITION BY clip ORDER BY idx) AS INT) AS sequence, round(idx / 10.0, 6) AS timestamp_seconds FROM p)
SELECT clip, idx, sequence, lpad(CAST(sequence AS VARCHAR), 6, '0') || '.png' AS filename, timestamp_seconds, round(abs(timestamp_seconds - lag(timestamp_seconds) OVER (PARTITION BY clip ORDER BY idx)), 6) AS delta_seconds FROM s""")
def w2_w3_selected_frames(spark, sf_dir):
    j = series.joint_score(I.frames(spark, sf_dir), "clip", "s1", "s2").withColumn("joint", F.round("joint", 9))
    picked = series.select_bin_maxima(j, "clip", "idx", "joint", 4)[0].select("clip", "idx")
    return series.selected_frames(picked, "clip", "idx", 10.0)


@query(f"""WITH {I.FRAMES} SELECT 'error' AS level, 'fewer_rows_than_bins' AS code, clip, CAST(count(*) AS BIGINT) AS rows FROM frames GROUP BY clip HAVING count(*) < 70""")
def w2_short_clips(spark, sf_dir):
    return series.select_bin_maxima(I.frames(spark, sf_dir), "clip", "idx", "s1", 70)[1]


_LAG = f"""{I.SERIES}, c AS (SELECT a.clip, g.lag, a.a, b.b FROM series a CROSS JOIN (SELECT CAST(unnest(range(-5, 6)) AS INT) AS lag) g JOIN series b ON b.t = a.t + g.lag),
r AS (SELECT clip, lag, CAST(count(*) AS BIGINT) AS n, CASE WHEN count(*) >= 3 AND stddev_pop(a) * stddev_pop(b) > 1e-12 THEN covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) END AS r FROM c GROUP BY 1, 2)"""


@query(f"WITH {_LAG} SELECT clip, lag, n, round(r, 6) AS r FROM r")
def w5_lag_correlation(spark, sf_dir):
    return r6(series.lag_correlation(I.series(spark, sf_dir), "clip"), "r")


@query(f"""WITH s0 AS (SELECT user_id % 20 AS clip, CAST(date_diff('day', TIMESTAMP '2024-01-01', ts) AS INT) AS t, round(sum(CASE WHEN event_type = 'click' THEN value ELSE 0 END), 6) AS a, round(sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END), 6) AS b FROM events WHERE user_id % 20 > 1 OR ts < TIMESTAMP '2024-01-07' GROUP BY 1, 2),
n AS (SELECT *, count(*) OVER (PARTITION BY clip) AS n, row_number() OVER (PARTITION BY clip ORDER BY t) - 1 AS i FROM s0),
p AS (SELECT clip, 0 AS seg, t, a, b FROM n UNION ALL SELECT clip, CASE WHEN i < n // 3 THEN 1 WHEN i < 2 * n // 3 THEN 2 ELSE 3 END, t, a, b FROM n),
c AS (SELECT x.clip, x.seg, g.lag, count(*) AS n, CASE WHEN count(*) >= 3 AND stddev_pop(x.a) * stddev_pop(y.b) > 1e-12 THEN covar_pop(x.a, y.b) / (stddev_pop(x.a) * stddev_pop(y.b)) END AS r FROM p x CROSS JOIN (SELECT CAST(unnest(range(-5, 6)) AS INT) AS lag) g JOIN p y ON x.clip = y.clip AND x.seg = y.seg AND y.t = x.t + g.lag GROUP BY 1, 2, 3),
best AS (SELECT clip, seg, lag FROM (SELECT *, row_number() OVER (PARTITION BY clip, seg ORDER BY round(r, 9) DESC, lag) AS k FROM c WHERE r IS NOT NULL) WHERE k = 1)
SELECT CAST(clip AS VARCHAR) AS key, CAST(count(*) AS BIGINT) AS points, CASE WHEN count(*) >= 9 THEN (SELECT lag FROM best WHERE best.clip = s0.clip AND seg = 0) END AS lag, CASE WHEN count(*) >= 9 THEN (SELECT bool_or(lag <> 0) FROM best WHERE best.clip = s0.clip) END AS warning, count(*) >= 9 AS available FROM s0 GROUP BY clip""")
def w6_sync_diagnostic(spark, sf_dir):
    """Daily sums of two kinds of events, for twenty sets of users, two of which have a few days alone."""
    rows = table(spark, sf_dir, "events").withColumn("t", F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))).withColumn("clip", F.col("user_id") % 20).where("clip > 1 or t < 6")
    total = lambda k: F.round(F.sum(F.when(F.col("event_type") == k, F.col("value")).otherwise(0.0)), 6)
    return series.sync_diagnostic(rows.groupBy("clip", "t").agg(total("click").alias("a"), total("purchase").alias("b")), "clip")


@query(f"""WITH {I.FRAMES}, n AS (SELECT *, count(*) OVER (PARTITION BY clip) AS n FROM frames) SELECT clip, idx, CASE WHEN idx = 0 THEN 'first' WHEN idx = n - 1 THEN 'last' ELSE 'middle' END AS place FROM n WHERE idx IN (0, n // 2, n - 1)""")
def w7_representatives(spark, sf_dir):
    return series.representatives(I.frames(spark, sf_dir), "clip", "idx")


@query("SELECT doc_id, CAST(row_number() OVER (ORDER BY sha256('42:3:' || CAST(doc_id AS VARCHAR))) AS BIGINT) AS place FROM documents")
def o2_epoch_order(spark, sf_dir):
    return series.epoch_order(table(spark, sf_dir, "documents"), "doc_id", 42, 3)


@query("SELECT s_nationkey, s_suppkey, s_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS r FROM supplier) WHERE r = 1")
def o4_best_candidate(spark, sf_dir):
    return series.best_candidate(table(spark, sf_dir, "supplier"), "s_nationkey", ["s_acctbal"], "s_suppkey")


@query(f"""WITH {I.GRID}, f AS (SELECT vec_id AS frame_id, label AS clip, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM embeddings), r AS (SELECT clip, i, y, x, v FROM grid JOIN f USING (frame_id))
SELECT r.clip, CAST(r.i AS INT) AS i, round(avg(abs(r.v - p.v)), 6) AS motion FROM r JOIN r p ON r.clip = p.clip AND r.i = p.i + 1 AND r.y = p.y AND r.x = p.x GROUP BY 1, 2""")
def w4_motion_signal(spark, sf_dir):
    return r6(grid.motion_signal(I.grid(spark, sf_dir), "clip", "frame_id"), "motion")


# --- sets, splits, gates ------------------------------------------------------------------------------------------------


@query(f"""WITH {I.SAMPLES}, {I.SPLITS}, s AS (SELECT DISTINCT sha, split FROM members JOIN samples USING (sample_id) WHERE split <> 'train_pool')
SELECT CASE WHEN a.split = 'train' OR b.split = 'train' THEN 'train' ELSE 'val' END AS split_a, CASE WHEN a.split = 'test' OR b.split = 'test' THEN 'test' ELSE 'val' END AS split_b, CAST(count(*) AS BIGINT) AS shared FROM s a JOIN s b ON a.sha = b.sha AND a.split < b.split GROUP BY 1, 2""")
def u1_split_overlaps(spark, sf_dir):
    s = I.samples(spark, sf_dir)
    m = pairing.split_members(s, I.group_splits(s)).where("split <> 'train_pool'").join(s.select("sample_id", "sha"), "sample_id")
    return audit.split_overlaps(m, "sha")


@query(f"""WITH {I.SAMPLES}, {I.SPLITS} SELECT DISTINCT sample_id, 'missing_in_pool' AS code FROM members WHERE split IN ('train', 'val') AND right(sample_id, 1) = '7'""")
def u2_pool_consistency(spark, sf_dir):
    s = I.samples(spark, sf_dir)
    m = pairing.split_members(s, I.group_splits(s))
    return audit.pool_consistency(m.where("split <> 'train_pool' or substring(sample_id, -1, 1) <> '7'"))


@query(f"""WITH {_SIDES}, e AS (SELECT k, k % 10 AS g FROM a), f AS (SELECT k, CASE WHEN k % 13 = 0 THEN -1 ELSE k % 10 END AS g FROM b UNION ALL SELECT k, k % 10 FROM b WHERE k % 17 = 0)
SELECT k, CASE WHEN a IS NULL THEN 'missing' WHEN e IS NULL THEN 'unknown' WHEN a > 1 THEN 'duplicate' ELSE 'mismatch' END AS code FROM (SELECT k, count(*) AS e, min(g) AS eg FROM e GROUP BY k) FULL JOIN (SELECT k, count(*) AS a, min(g) AS ag FROM f GROUP BY k) USING (k) WHERE a IS NULL OR e IS NULL OR a > 1 OR eg <> ag""")
def u3_assignment_coverage(spark, sf_dir):
    """Orders with a group each, against lines, of which some have another group and some come twice."""
    a, b, _ = _sides(spark, sf_dir)
    actual = b.withColumn("g", F.when(F.col("k") % 13 == 0, -1).otherwise(F.col("k") % 10)).union(b.where("k % 17 = 0").withColumn("g", F.col("k") % 10))
    return audit.assignment_coverage(a.withColumn("g", F.col("k") % 10), actual, "k", "g")


@query(f"""WITH {I.SAMPLES} SELECT 'val' AS split, sample_id, 'excluded' AS code FROM samples WHERE NOT usable UNION ALL SELECT 'val', 'x' || CAST(n_nationkey AS VARCHAR), 'unknown' FROM nation""")
def u4_member_issues(spark, sf_dir):
    s = I.samples(spark, sf_dir)
    listed = s.select("sample_id").union(table(spark, sf_dir, "nation").select(F.concat(F.lit("x"), F.col("n_nationkey").cast("string"))))
    return audit.member_issues(listed.withColumn("split", F.lit("val")), s)


def _search(name, groups, seed, ratio, names=("first", "second"), greedy=0):
    """SQL of a stage's search over the features of groups: name_trials (trial, leakage_group_id, second) and name_scores (trial, score)."""
    square = lambda have, share: f"(({have}) - total * {share}) / greatest(1.0, total * {share})"
    own, rest = square("got", ratio), square("total - got", 1 - ratio)
    raw, part = {1: f"n * {1 - ratio}", 2: f"n * {ratio}"}, lambda k: f"greatest(1, CAST(floor({k}) AS INT))"
    over = f"{part(raw[1])} + {part(raw[2])} < n AND ({raw[2]} - floor({raw[2]}) > {raw[1]} - floor({raw[1]}) OR ({raw[2]} - floor({raw[2]}) = {raw[1]} - floor({raw[1]}) AND {ratio} > {1 - ratio}))"
    second = f"(SELECT least(n - 1, {part(raw[2])} + CASE WHEN {over} THEN 1 ELSE 0 END) FROM {name}_n)"
    if greedy:  # one group after another goes where the score is lower and there is room
        of = lambda have, share: f"list_sum(list_transform(range(1, len(total) + 1), lambda i: weight[i] * pow(({have} - total[i] * {share}) / greatest(1.0, total[i] * {share}), 2)))"
        to = [f"{of('a[i] + x[i]', 1 - ratio)} + {of('b[i]', ratio)}", f"{of('a[i]', 1 - ratio)} + {of('b[i] + x[i]', ratio)}"]
        plus = lambda have, side: f"CASE WHEN side = {side} THEN list_transform(range(1, len(x) + 1), lambda i: {have}[i] + x[i]) ELSE {have} END"
        trials = f"""{name}_j AS (SELECT kind, name, sum(value) AS total, CASE kind WHEN 'pairs' THEN 4.0 WHEN 'experiments' THEN 3.0 WHEN 'category' THEN 2.0 ELSE 0.2 END AS weight FROM {name}_f GROUP BY 1, 2),
{name}_all AS (SELECT list(total ORDER BY kind, name) AS total, list(weight ORDER BY kind, name) AS weight FROM {name}_j),
{name}_x AS (SELECT g.leakage_group_id, list(COALESCE(f.value, 0.0) ORDER BY j.kind, j.name) AS x, max(f.value) FILTER (j.kind = 'pairs') AS pairs, max(f.value) FILTER (j.kind = 'experiments') AS experiments FROM (SELECT DISTINCT leakage_group_id FROM {name}_f) g CROSS JOIN {name}_j j LEFT JOIN {name}_f f ON f.leakage_group_id = g.leakage_group_id AND f.kind = j.kind AND f.name = j.name GROUP BY 1),
{name}_order AS (SELECT trial, leakage_group_id, x, h, row_number() OVER (PARTITION BY trial ORDER BY pairs DESC, experiments DESC, h) AS place FROM (SELECT *, sha256('{seed}:' || CAST(trial AS VARCHAR) || ':' || leakage_group_id) AS h FROM {name}_x CROSS JOIN (SELECT unnest(range(0, {greedy})) AS trial))),
{name}_run AS (SELECT CAST(trial AS BIGINT) AS trial, CAST(0 AS BIGINT) AS place, '' AS leakage_group_id, 0 AS side, list_transform(total, lambda t: 0.0::DOUBLE) AS a, list_transform(total, lambda t: 0.0::DOUBLE) AS b, CAST(0 AS BIGINT) AS m FROM {name}_all CROSS JOIN (SELECT unnest(range(0, {greedy})) AS trial)
 UNION ALL SELECT trial, place, leakage_group_id, side, {plus('a', 0)}, {plus('b', 1)}, m + side FROM (SELECT *, CASE WHEN m >= {second} THEN 0 WHEN place - 1 - m >= (SELECT n FROM {name}_n) - {second} THEN 1 WHEN abs(s0 - s1) < 1e-12 THEN CAST('0x' || substr(h, 1, 2) AS INT) & 1 WHEN s1 < s0 THEN 1 ELSE 0 END AS side
  FROM (SELECT r.trial, o.place, o.leakage_group_id, o.x, o.h, r.a, r.b, r.m, {to[0]} AS s0, {to[1]} AS s1 FROM {name}_run r JOIN {name}_order o ON o.trial = r.trial AND o.place = r.place + 1 CROSS JOIN {name}_all))),
{name}_trials AS (SELECT trial, leakage_group_id, side = 1 AS second FROM {name}_run WHERE place > 0)"""
    else:
        trials = f"{name}_trials AS (SELECT t.trial, leakage_group_id, row_number() OVER (PARTITION BY trial ORDER BY sha256('{seed}:' || CAST(t.trial AS VARCHAR) || ':' || leakage_group_id)) <= {second} AS second FROM (SELECT DISTINCT leakage_group_id FROM {name}_f) CROSS JOIN (SELECT unnest(range(0, 256)) AS trial) t)"
    return f"""{name}_f AS (SELECT * FROM features WHERE leakage_group_id IN (SELECT leakage_group_id FROM {groups})), {name}_n AS (SELECT count(DISTINCT leakage_group_id) AS n FROM {name}_f),
{trials},
{name}_totals AS (SELECT kind, name, sum(value) AS total FROM {name}_f GROUP BY 1, 2), {name}_got AS (SELECT trial, kind, name, sum(CASE WHEN second THEN value ELSE 0 END) AS got FROM {name}_trials JOIN {name}_f USING (leakage_group_id) GROUP BY 1, 2, 3),
{name}_scores AS (SELECT trial, round(sum(CASE kind WHEN 'pairs' THEN 4.0 WHEN 'experiments' THEN 3.0 WHEN 'category' THEN 2.0 ELSE 0.2 END * (pow({own}, 2) + pow({rest}, 2))), 9) AS score FROM {name}_got JOIN {name}_totals USING (kind, name) GROUP BY 1),
{name}_signed AS (SELECT trial, list(CASE WHEN second THEN '{names[1]}' ELSE '{names[0]}' END ORDER BY leakage_group_id) AS signature FROM {name}_trials GROUP BY 1),
{name}_best AS (SELECT leakage_group_id, second FROM {name}_trials WHERE trial = (SELECT trial FROM {name}_scores JOIN {name}_signed USING (trial) ORDER BY score, signature, trial LIMIT 1))"""


_TRIALS = f"{I.SAMPLES}, {_FEATURES}, {_search('outer', 'features', 42, 0.2)}"
_NESTED = f"""{I.SAMPLES}, {_FEATURES}, {_search('outer', 'features', 42, 0.2, ('train_pool', 'test'))}, pool AS (SELECT leakage_group_id FROM outer_best WHERE NOT second), {_search('inner', 'pool', 42 * 7919 + 17, 0.2, ('train', 'val'))},
nested AS (SELECT o.leakage_group_id, CASE WHEN o.second THEN 'test' ELSE 'train_pool' END AS outer_split, CASE WHEN o.second THEN 'test' WHEN i.second THEN 'val' ELSE 'train' END AS inner_split FROM outer_best o LEFT JOIN inner_best i USING (leakage_group_id))"""


@query(f"WITH {_TRIALS} SELECT trial, round(score, 6) AS score FROM outer_scores")
def g2_stage_score(spark, sf_dir):
    f = split.group_features(I.samples(spark, sf_dir))
    n = f.select("leakage_group_id").distinct().count()
    return r6(split.stage_score(f, split.trial_table(f, 42, 256, split.target_groups(n, 0.2)), 0.2), "score")


@query(f"WITH {_TRIALS} SELECT * FROM outer_best")
def g3_assign_stage(spark, sf_dir):
    return split.assign_stage(split.group_features(I.samples(spark, sf_dir)), 0.2, 42)


@query(f"WITH {I.SAMPLES}, {_FEATURES}, {_search('outer', 'features', 3, 0.25)} SELECT * FROM outer_best")
def g3_assign_stage_half_groups(spark, sf_dir):
    """A quarter of ten groups is two and a half: what is left over goes to the larger share."""
    return split.assign_stage(split.group_features(I.samples(spark, sf_dir)), 0.25, 3)


@query(f"""WITH {I.SAMPLES}, features AS (SELECT DISTINCT leakage_group_id, 'pairs' AS kind, 'all' AS name, 1.0 AS value FROM samples), {_search('outer', 'features', 8, 0.5, ('train_pool', 'test'))} SELECT * FROM outer_best""")
def g3_assign_stage_equal_trials(spark, sf_dir):
    """Groups of one pair each: all trials score the same, and the outcomes' names decide."""
    f = I.samples(spark, sf_dir).select("leakage_group_id", F.lit("pairs").alias("kind"), F.lit("all").alias("name"), F.lit(1.0).alias("value")).distinct()
    return split.assign_stage(f, 0.5, 8, names=("train_pool", "test"))


@query(f"WITH RECURSIVE {I.SAMPLES}, {_FEATURES}, {_search('outer', 'features', 42, 0.2, greedy=64)} SELECT * FROM outer_best")
def g3_assign_stage_greedy(spark, sf_dir):
    """The search whose trials take the largest groups first."""
    return split.assign_stage(split.group_features(I.samples(spark, sf_dir)), 0.2, 42, 64, greedy=True)


@query(f"WITH {_NESTED} SELECT * FROM nested")
def g4_nested_group_split(spark, sf_dir):
    return split.nested_group_split(I.samples(spark, sf_dir))


@query(f"WITH {I.SAMPLES}, {I.SPLITS} SELECT DISTINCT experiment_key, leakage_group_id, outer_split, inner_split FROM samples JOIN group_splits USING (leakage_group_id)")
def g5_experiment_assignments(spark, sf_dir):
    s = I.samples(spark, sf_dir)
    return split.experiment_assignments(s, I.group_splits(s))


@query(f"""WITH {I.SAMPLES} SELECT sample_id, 'warning' AS level, 'excluded_sample' AS code FROM samples WHERE NOT usable UNION ALL SELECT sample_id, 'fatal', 'short_file' FROM samples WHERE n_chars < 100""")
def q1_row_issues(spark, sf_dir):
    return audit.row_issues(I.samples(spark, sf_dir), {"excluded_sample": ("warning", ~F.col("usable")), "short_file": ("fatal", F.col("n_chars") < 100)})


@query("""WITH s AS (SELECT 'd' || CAST(doc_id AS VARCHAR) AS sample_id, doc_id AS n, doc_id % 6 <> 0 AS usable FROM documents UNION ALL SELECT 'd' || CAST(doc_id AS VARCHAR), doc_id, doc_id % 6 <> 0 FROM documents WHERE doc_id % 41 = 0),
safe AS (SELECT *, n % 17 <> 0 AS ok, n % 7 <> 0 AS ir_there, n % 11 <> 0 AS rgb_there, n % 13 <> 0 AS readable FROM s), seen AS (SELECT *, usable AND ok AND n % 19 <> 0 AND ir_there AND rgb_there AND readable AS seen, usable AND ok AS looked FROM safe)
SELECT sample_id, level, code FROM (
SELECT sample_id, 'fatal' AS level, 'duplicate_sample_id' AS code FROM s WHERE n % 41 = 0 UNION ALL SELECT sample_id, 'fatal', 'sample_missing_group' FROM s WHERE n % 23 = 0 UNION ALL SELECT sample_id, 'fatal', 'unknown_group' FROM s WHERE n % 23 <> 0 AND n % 29 = 0
UNION ALL SELECT sample_id, 'fatal', 'preview_in_samples' FROM s WHERE n % 19 = 0 UNION ALL SELECT sample_id, 'warning', 'excluded_sample' FROM s WHERE NOT usable UNION ALL SELECT sample_id, 'fatal', 'invalid_path' FROM safe WHERE usable AND NOT ok
UNION ALL SELECT sample_id, 'fatal', 'stem_mismatch' FROM seen WHERE looked AND n % 19 = 0 UNION ALL SELECT sample_id, 'fatal', 'missing_ir' FROM seen WHERE looked AND (NOT ir_there OR n % 19 = 0) UNION ALL SELECT sample_id, 'fatal', 'missing_rgb' FROM seen WHERE looked AND NOT rgb_there
UNION ALL SELECT sample_id, 'fatal', 'unreadable_image' FROM seen WHERE looked AND n % 19 <> 0 AND ir_there AND rgb_there AND NOT readable UNION ALL SELECT sample_id, 'fatal', 'size_mismatch' FROM seen WHERE seen AND n % 5 = 0 UNION ALL SELECT sample_id, 'fatal', 'ir_mode_mismatch' FROM seen WHERE seen AND n % 3 = 0)""")
def q1_sample_issues(spark, sf_dir):
    """Documents as samples with every fault, each by a divisor of the id."""
    n = F.col("doc_id")
    by = lambda k: n % k == 0
    d = table(spark, sf_dir, "documents").select("doc_id")
    name = F.concat(F.format_string("%06d", n.cast("int")), F.lit(".png"))
    path = lambda m: F.concat(F.when(by(17), "../").otherwise("a/"), F.lit(f"{m}/"), name)
    ir = F.when(by(19) & ~by(17), F.concat(F.lit("a/ir/sync_preview"), name)).when(by(19), F.concat(F.lit("../sync_preview"), name)).otherwise(path("ir"))
    s = d.union(d.where(by(41))).select(F.concat(F.lit("d"), n.cast("string")).alias("sample_id"), F.when(by(23), "").when(by(29), "other").otherwise("g").alias("leakage_group_id"), ir.alias("ir_path"), path("rgb").alias("rgb_path"), (~by(6)).alias("usable"))
    file = lambda m, k, w, mode: d.where(~by(k)).select(F.concat(F.lit(f"a/{m}/"), name).alias("path"), (~by(13)).alias("readable"), w.alias("width"), F.lit(64).alias("height"), mode.alias("mode"))
    files = file("ir", 7, F.when(by(5), 32).otherwise(64), F.when(by(3), "L").otherwise("RGB")).union(file("rgb", 11, F.lit(64), F.lit("RGB")))
    return audit.sample_issues(s, table(spark, sf_dir, "region").select(F.lit("g").alias("leakage_group_id")), files, ["RGB"], ["RGB"])


@query(f"""WITH {I.SAMPLES} SELECT CAST(count(*) FILTER (n_chars < 100) AS BIGINT) AS fatals, CAST(0 AS BIGINT) AS errors, CAST(count(*) FILTER (NOT usable) AS BIGINT) AS warnings, count(*) FILTER (n_chars < 100) = 0 AS formal_ready FROM samples""")
def q4_audit_summary(spark, sf_dir):
    return audit.audit_summary(q1_row_issues(spark, sf_dir), True)


@query(f"""WITH {I.SAMPLES}, {I.SPLITS}, bad AS (SELECT * FROM members WHERE split <> 'val' OR sample_id IN (SELECT sample_id FROM samples WHERE category <> 'de') UNION ALL SELECT sample_id, 'test' FROM members WHERE split = 'val' AND sample_id LIKE '%7' UNION ALL SELECT sample_id, 'train_pool' FROM members WHERE split = 'test' AND sample_id LIKE '%3'),
i AS (SELECT DISTINCT b.sample_id, split, leakage_group_id, category FROM bad b JOIN samples USING (sample_id) WHERE split <> 'train_pool'), p AS (SELECT DISTINCT sample_id FROM bad WHERE split = 'train_pool'), t AS (SELECT DISTINCT sample_id FROM bad WHERE split IN ('train', 'val'))
SELECT DISTINCT 'fatal' AS level, 'shared_sample' AS code, least_split || '/' || most_split AS key FROM (SELECT CASE WHEN a.split = 'train' OR b.split = 'train' THEN 'train' ELSE 'val' END AS least_split, CASE WHEN a.split = 'test' OR b.split = 'test' THEN 'test' ELSE 'val' END AS most_split FROM i a JOIN i b ON a.sample_id = b.sample_id AND a.split < b.split)
UNION ALL SELECT DISTINCT 'fatal', 'shared_group', least_split || '/' || most_split FROM (SELECT CASE WHEN a.split = 'train' OR b.split = 'train' THEN 'train' ELSE 'val' END AS least_split, CASE WHEN a.split = 'test' OR b.split = 'test' THEN 'test' ELSE 'val' END AS most_split FROM (SELECT DISTINCT leakage_group_id, split FROM i) a JOIN (SELECT DISTINCT leakage_group_id, split FROM i) b ON a.leakage_group_id = b.leakage_group_id AND a.split < b.split)
UNION ALL SELECT 'fatal', 'pool_only', sample_id FROM p WHERE sample_id NOT IN (SELECT sample_id FROM t) UNION ALL SELECT 'fatal', 'missing_in_pool', sample_id FROM t WHERE sample_id NOT IN (SELECT sample_id FROM p) UNION ALL SELECT DISTINCT 'fatal', 'pool_and_test', sample_id FROM p WHERE sample_id IN (SELECT sample_id FROM bad WHERE split = 'test')
UNION ALL SELECT 'fatal', 'category_missing', s.split || '/' || c.category FROM (SELECT DISTINCT split FROM i) s CROSS JOIN (SELECT DISTINCT category FROM i) c WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.split = s.split AND i.category = c.category)""")
def q5_basic_audit(spark, sf_dir):
    """A split with faults of each kind: validation lacks a language, some of its samples are in test too, some of test are in the pool."""
    s = I.samples(spark, sf_dir)
    m = pairing.split_members(s, I.group_splits(s))
    no_german = m.join(s.select("sample_id", "category"), "sample_id").where("split <> 'val' or category <> 'de'").select("sample_id", "split")
    more = m.where("split = 'val' and sample_id like '%7'").select("sample_id", F.lit("test")).union(m.where("split = 'test' and sample_id like '%3'").select("sample_id", F.lit("train_pool")))
    return audit.basic_audit(s, no_german.union(more))


def _version(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sample_id"))
    return audit.table_digest(rows, ["sample_id"]).withColumns({"formal": F.lit(True), "schema_version": F.lit(1)})


@query("""SELECT count(*) AS usable_rows FROM orders""")
def q6_assert_usable(spark, sf_dir):
    """Orders as a version that its digest opens; a wrong digest, tried first, is refused."""
    version = _version(spark, sf_dir)
    none = version.select(F.lit("fatal").alias("level"), F.lit("x").alias("code")).where("false")
    try:
        audit.assert_usable(version, "0", none)
    except ValueError:
        audit.assert_usable(version, version.first()["digest"], none)
        return table(spark, sf_dir, "orders").agg(F.count("*").alias("usable_rows"))
    raise AssertionError("a wrong digest was accepted")


@query(f"""WITH {I.SAMPLES}, {I.SPLITS} SELECT sample_id, experiment_key, category, CAST(count(*) OVER () AS BIGINT) AS pairs FROM samples JOIN members USING (sample_id) WHERE split = 'test'""")
def q7_collect_heldout(spark, sf_dir):
    s = I.samples(spark, sf_dir)
    version = _version(spark, sf_dir)
    none = version.select(F.lit("fatal").alias("level"), F.lit("x").alias("code")).where("false")
    rows, about = audit.collect_heldout(version, version.first()["digest"], none, s, pairing.split_members(s, I.group_splits(s)))
    return rows.select("sample_id", "experiment_key", "category").join(about.select("pairs"))


def _imports(spark, sf_dir):
    """Documents as files: every seventh has no second modality, and a ninth of the languages is unknown."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("sha256"), F.substring("source", 4, 2).cast("int").alias("e"))
    side = lambda m, rows: rows.select(F.format_string("in/day%d/experiment%d/%s/clip%d/%s/%06d.png", (F.col("doc_id") % 2).cast("int"), "e", F.when(F.col("lang") == "fr", "xx").otherwise(F.col("lang")), (F.col("doc_id") % 3).cast("int"), F.lit(m), F.col("doc_id").cast("int")).alias("path"), "sha256")
    return side("ir", d).union(side("rgb", d.where("doc_id % 7 <> 0")))


_IMPORTS = """d AS (SELECT doc_id, 'day' || CAST(doc_id % 2 AS VARCHAR) AS day, 'experiment' || CAST(CAST(substr(source, 4, 2) AS INT) AS VARCHAR) AS experiment, CASE WHEN lang <> 'fr' THEN 'slug_' || lang END AS category, lpad(CAST(doc_id % 3 AS VARCHAR), 2, '0') AS clip FROM documents),
c AS (SELECT day, experiment, category, clip, CAST(count(*) FILTER (doc_id % 7 <> 0) AS BIGINT) AS pairs, CAST(count(*) FILTER (doc_id % 7 = 0) AS BIGINT) AS one_sided FROM d GROUP BY 1, 2, 3, 4)"""
_SLUGS = {"de": "slug_de", "en": "slug_en", "es": "slug_es"}


@query(f"WITH {_IMPORTS} SELECT *, concat_ws('/', 'out', day, experiment, category, clip) AS target FROM c")
def q11_plan_import(spark, sf_dir):
    f = _imports(spark, sf_dir)
    return plan_import(f, f.limit(0), _SLUGS, list(_SLUGS.values()), "out")[0]


@query(f"""WITH {_IMPORTS}, f AS (SELECT doc_id, concat_ws('/', 'out', day, experiment, category, clip, m, lpad(CAST(doc_id AS VARCHAR), 6, '0') || '.png') AS path, m FROM d CROSS JOIN (VALUES ('ir'), ('rgb')) x(m) WHERE category IS NOT NULL AND (m = 'ir' OR doc_id % 7 <> 0))
SELECT path, CASE WHEN doc_id % 4 = 0 AND m = 'ir' THEN 'identical' WHEN doc_id % 4 = 1 AND m = 'ir' THEN 'conflict' ELSE 'copy' END AS action FROM f""")
def q11_import_copies(spark, sf_dir):
    """Some files are there already, some with other content."""
    f = _imports(spark, sf_dir)
    n = F.regexp_extract("path", r"([0-9]+)\.png$", 1).cast("int")
    target = F.regexp_replace(F.regexp_replace(F.regexp_replace("path", "^in/", "out/"), "/clip([0-9])/", "/0$1/"), "/(de|en|es)/", "/slug_$1/")
    there = f.where(n.isNotNull() & (n % 4 < 2) & F.col("path").contains("/ir/")).select(target.alias("path"), F.when(n % 4 == 0, F.col("sha256")).otherwise("x").alias("sha256"))
    return plan_import(f, there, _SLUGS, list(_SLUGS.values()), "out")[1]


@query(f"""WITH {_IMPORTS}, w AS (SELECT day || '__' || experiment AS e, category, count(*) AS clips FROM c WHERE category IS NOT NULL AND pairs > 0 AND one_sided = 0 GROUP BY 1, 2), r AS (SELECT count(*) AS n FROM (SELECT e FROM w GROUP BY e HAVING count(*) = 3 AND bool_and(clips = 2)))
SELECT category, CAST(sum(clips) AS BIGINT) AS clips, CAST((SELECT n FROM r) AS BIGINT) AS complete_experiments FROM w GROUP BY category""")
def q11_import_readiness(spark, sf_dir):
    f = _imports(spark, sf_dir)
    return plan_import(f, f.limit(0), _SLUGS, list(_SLUGS.values()), "out", 2)[2]


@query(f"""WITH {_IMPORTS}, w AS (SELECT day || '__' || experiment AS e, category, count(*) AS clips FROM c WHERE category IS NOT NULL AND pairs > 0 AND one_sided = 0 GROUP BY 1, 2), r AS (SELECT e FROM w GROUP BY e HAVING count(*) = 3 AND bool_and(clips = 2)),
n AS (SELECT CAST(count(*) AS BIGINT) AS n FROM r)
SELECT 'too_few_complete_experiments' AS code, n AS found, CAST(1000 AS BIGINT) AS needed FROM n WHERE n < 1000 UNION ALL SELECT 'group_assignments_missing', NULL, NULL UNION ALL SELECT 'edges_not_audited', NULL, NULL UNION ALL SELECT 'complete ' || e, NULL, NULL FROM r""")
def q11_import_blockers(spark, sf_dir):
    """What keeps a split from being made, beside the experiments that are complete."""
    f = _imports(spark, sf_dir)
    done, blockers = import_blockers(plan_import(f, f.limit(0), _SLUGS, list(_SLUGS.values()), "out")[0], list(_SLUGS.values()), 2, 1000)
    none = F.lit(None).cast("long")
    return blockers.union(done.select(F.concat(F.lit("complete "), "experiment_key"), none, none))


@query("""SELECT o_orderkey AS task, CASE WHEN present >= expected THEN 'skip' WHEN present > 0 THEN 'fail' ELSE 'run' END AS action FROM (SELECT o_orderkey, count(l_orderkey) FILTER (l_linestatus = 'F') AS present, CASE WHEN count(l_orderkey) = 0 THEN 1 ELSE count(l_orderkey) END AS expected FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)""")
def q8_pending_tasks(spark, sf_dir):
    out = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("task")).agg(F.count("*").alias("expected"), F.count_if(F.col("l_linestatus") == "F").alias("present"))
    return audit.pending_tasks(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task")), out)


@query("SELECT doc_id AS task, CAST(doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 5 = 0 THEN 'missing' ELSE 'changed' END AS code FROM documents WHERE doc_id % 5 = 0 OR doc_id % 3 = 0")
def q9_task_issues(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("task"), F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("sha"))
    return audit.task_issues(d, d.where("task % 5 <> 0").select("path", F.when(F.col("task") % 3 == 0, F.lit("x")).otherwise(F.col("sha")).alias("sha")))


@query("""WITH f AS (SELECT l_suppkey AS task, l_linenumber AS name, count(DISTINCT l_linestatus) AS m, bool_and(l_tax < 0.08 AND NOT (l_linenumber = 7 AND l_suppkey % 2 = 0)) AS ok FROM lineitem GROUP BY 1, 2)
SELECT task, CAST(count(*) AS BIGINT) AS names, CAST(count(*) FILTER (m <> 2) AS BIGINT) AS one_sided, CAST(count(*) FILTER (NOT ok) AS BIGINT) AS unreadable, count(*) = 7 AND count(*) FILTER (m <> 2) = 0 AND count(*) FILTER (NOT ok) = 0 AS valid FROM f GROUP BY 1""")
def q10_output_validation(spark, sf_dir):
    """Of some files nothing is known: they aren't readable."""
    unknown = (F.col("l_linenumber") == 7) & (F.col("l_suppkey") % 2 == 0)
    f = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("task"), F.col("l_linestatus").alias("modality"), F.col("l_linenumber").alias("name"), F.when(~unknown, F.col("l_tax") < 0.08).alias("readable"))
    return audit.output_validation(f, 7)


@query("""SELECT CAST(d.doc_id AS VARCHAR) AS path, CASE WHEN d.doc_id % 4 = 0 THEN 'copy' WHEN d.doc_id % 4 = 1 THEN 'conflict' ELSE 'identical' END AS action FROM documents d""")
def k4_plan_copies(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("sha256"))
    there = d.where("doc_id % 4 <> 0").select("path", F.when(F.col("doc_id") % 4 == 1, F.lit("x")).otherwise(F.col("sha256")).alias("sha256"))
    return plan_copies(d.select("path", "sha256"), there)


# --- sinks and files, by writing tables and reading them back -----------------------------------------------------------------


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def k1_k2_publish_version(spark, sf_dir):
    """A version of two tables; a second one of the same name is refused and leaves the first as it is."""
    root = new_path(spark, "versions")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    about = audit.table_digest(o, ["o_orderkey"])
    sinks.publish_version(spark, root, "v1", {"orders": o, "keys": o.select("o_orderkey")}, about, {"orders": ["o_orderkey"]})
    try:
        sinks.publish_version(spark, root, "v1", {"orders": o.limit(0)}, about)
    except AnalysisException:
        return sinks.read_version(spark, root, "v1", "orders")
    raise AssertionError("a version was written twice")


@query("SELECT c_custkey, c_nationkey FROM customer")
def k3_replace_run(spark, sf_dir):
    """The second of two runs is current."""
    root = new_path(spark, "runs")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    sinks.replace_run(c.where("c_custkey % 2 = 0"), root)
    sinks.replace_run(c, root)
    return sinks.current_run(spark, root)


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey % 2 = 0")
def k3_restore_run(spark, sf_dir):
    """The first of two runs, made current again."""
    root = new_path(spark, "runs")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    first = sinks.replace_run(c.where("c_custkey % 2 = 0"), root)
    sinks.replace_run(c, root)
    sinks.restore_run(spark, root, first)
    return sinks.current_run(spark, root)


@query("SELECT o_orderkey AS task, CASE WHEN o_orderstatus = 'F' THEN 'success' ELSE 'failed' END AS status, run_id FROM orders CROSS JOIN (VALUES ('a'), ('b')) r(run_id)")
def k5_run_report(spark, sf_dir):
    path = new_path(spark, "reports")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task"), F.when(F.col("o_orderstatus") == "F", "success").otherwise("failed").alias("status"), F.lit("").alias("message"))
    for run in ("a", "b"):
        sinks.write_run_report(o, path, run)
    return spark.read.parquet(path).select("task", "status", "run_id")


@query(f"WITH {I.HASHES}, r AS (SELECT a.modality, a.id AS id_a, b.id AS id_b, CAST(hamming(a.h, b.h) AS BIGINT) AS distance FROM hashes a JOIN hashes b ON a.id < b.id WHERE hamming(a.h, b.h) <= 5) SELECT *, CAST(row_number() OVER (ORDER BY distance, modality, id_a, id_b) AS BIGINT) AS place FROM r")
def k6_o1_sorted_audit(spark, sf_dir):
    """The report of near duplicates in its order: each row with its place in the files, one after another."""
    path = new_path(spark, "audit")
    sinks.write_audit({"near": neardup.near_duplicates(I.hashes(spark, sf_dir), 5)}, path, {"near": neardup.REPORT_ORDER})
    rows = spark.read.parquet(f"{path}/near").select("*", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("row"))
    own = rows.withColumn("at", F.row_number().over(W.partitionBy("file").orderBy("row")))
    sizes = rows.groupBy("file").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return own.join(sizes, "file").select("modality", "id_a", "id_b", "distance", (F.col("before") + F.col("at")).alias("place"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name ELSE '' END AS p_name FROM part")
def s4_read_table(spark, sf_dir):
    path = new_path(spark, "csv")
    table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_name")).alias("p_name")).write.csv(path, header=True)
    return scans.read_table(spark, path, ["p_partkey", "p_name"])


def _file_name():
    """A name of its own for each row of a table, a thousand to a folder."""
    return F.format_string("%d/part-%d", F.expr("monotonically_increasing_id() div 1000"), F.monotonically_increasing_id()).alias("name")


@query("""SELECT sha256(CAST(c_custkey AS VARCHAR) || chr(10) || c_mktsegment || chr(10)) AS sha256, CAST(strlen(CAST(c_custkey AS VARCHAR) || c_mktsegment) + 2 AS BIGINT) AS length FROM customer""")
def s1_scan_fingerprints(spark, sf_dir):
    """A file for each customer, read in chunks by tasks of many files."""
    root = new_path(spark, "files")
    sinks.write_files(table(spark, sf_dir, "customer").select(_file_name(), F.concat(F.concat_ws("\n", F.col("c_custkey").cast("string"), "c_mktsegment"), F.lit("\n")).alias("content")).repartition(32), root)
    return scans.scan_fingerprints(spark, root, "part-*").select("sha256", "length")


@query("SELECT DISTINCT sha256(c_mktsegment || '/' || CAST(c_custkey % 150 AS VARCHAR) || chr(10)) AS sha256, CAST(strlen(c_mktsegment || CAST(c_custkey % 150 AS VARCHAR)) + 2 AS BIGINT) AS length FROM customer")
def s1_t1_intake(spark, sf_dir):
    """A file for each customer, in two halves, which repeat contents of their own and of each other; the intake takes each content once."""
    root, to, checkpoint = (new_path(spark, n) for n in ("files", "intake", "checkpoint"))
    for n in (0, 1):
        rows = table(spark, sf_dir, "customer").where(F.col("c_custkey") % 2 == n)
        sinks.write_files(rows.select(_file_name(), F.concat("c_mktsegment", F.lit("/"), (F.col("c_custkey") % 150).cast("string"), F.lit("\n")).alias("content")).repartition(32), f"{root}/{n}")
        start_intake(spark, root, to, checkpoint, "part-*").awaitTermination()
    return spark.read.parquet(to).select("sha256", "length")


@query("""SELECT CAST(p_size AS INT) AS width, CAST(p_partkey % 7 + 1 AS INT) AS height, CAST(8 AS INT) AS bit_depth, CASE p_partkey % 3 WHEN 0 THEN 'L' WHEN 1 THEN 'RGB' ELSE 'RGBA' END AS mode, CAST(count(*) AS BIGINT) AS files FROM part WHERE p_partkey % 10 <> 0 GROUP BY ALL
UNION ALL SELECT NULL, NULL, NULL, NULL, CAST(count(*) AS BIGINT) FROM part WHERE p_partkey % 10 = 0""")
def s2_png_headers(spark, sf_dir):
    """A PNG header for each part, as the only row of its file; a tenth of the files holds something else."""
    four = lambda n: F.lpad(F.hex(n), 8, F.lit("0"))
    kind = F.element_at(F.array(F.lit("00"), F.lit("02"), F.lit("06")), (F.col("p_partkey") % 3 + 1).cast("int"))
    head = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), four(F.col("p_size").cast("bigint")), four(F.col("p_partkey") % 7 + 1), F.lit("08"), kind, F.lit("00000000000000"))
    p = table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 10 == 0, F.encode(F.lit("no image at all, but as long as a header is"), "utf-8")).otherwise(F.unhex(head)).alias("content"))
    found = scans.scan_png_headers(p.select(F.lit("x").alias("path"), "content"))
    return found.groupBy("width", "height", "bit_depth", "mode").agg(F.count("*").alias("files"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS task, CAST(count(*) AS INT) AS frames, '' AS code FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 20 = 1 AND (o_orderkey // 20) % 5 <> 0 GROUP BY 1
UNION ALL SELECT NULL, NULL, 'not_an_object' FROM orders WHERE o_orderkey % 20 = 1 AND (o_orderkey // 20) % 5 = 0""")
def s5_read_summaries(spark, sf_dir):
    """A JSON document for each order of a twentieth, as a file of its own; a fifth of them is a list or cut off."""
    root = new_path(spark, "summaries")
    o = table(spark, sf_dir, "orders").where("o_orderkey % 20 = 1").select("o_orderkey", _file_name())
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").cast("int").alias("frames"))
    good = F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("task"), "frames"))
    bad = F.when(F.col("o_orderkey") % 3 == 0, "[1, 2]").otherwise('{"task": "x", ')
    rows = o.join(n, "o_orderkey", "left").select("name", F.when(F.expr("(o_orderkey div 20) % 5 = 0"), bad).when(F.col("frames").isNotNull(), good).alias("value")).where("value is not null")
    sinks.write_files(rows.select("name", F.concat("value", F.lit("\n")).alias("content")).repartition(32), root)
    documents, issues = scans.read_summaries(spark, root, "task string, frames int")
    return documents.select("task", "frames", F.lit("").alias("code")).union(issues.select(F.lit(None).cast("string"), F.lit(None).cast("int"), "code"))


# --- scans of tables of paths, frames and jobs ------------------------------------------------------------------------------


@query("""SELECT CAST(n % 6 AS INT) AS clip, CASE WHEN n % 50 = 0 THEN '' ELSE CAST(n % 90 AS VARCHAR) || '.png' END AS filename, CASE WHEN n % 50 = 0 THEN 'empty_filename' ELSE 'duplicate_filename' END AS code FROM (SELECT doc_id AS n FROM documents)
GROUP BY 1, 2, 3 HAVING any_value(n % 50) = 0 OR count(*) > 1""")
def s6_frame_issues(spark, sf_dir):
    n = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select((n % 6).cast("int").alias("clip"), F.when(n % 50 == 0, "").otherwise(F.concat((n % 90).cast("string"), F.lit(".png"))).alias("filename"), n.alias("source_frame_0_based"))
    frames, issues = scans.read_frames(d)
    if "source_frame_index_0_based" not in frames.columns:
        raise AssertionError("the index column has neither of its names")
    return issues


@query(f"WITH {_IMPORTS} SELECT DISTINCT day, experiment, clip, 'ir' AS modality, lpad(CAST(doc_id AS VARCHAR), 6, '0') || '.png' AS file FROM d")
def s7_parse_paths(spark, sf_dir):
    f = _imports(spark, sf_dir).where(F.col("path").contains("/ir/"))
    return scans.parse_paths(f).where("parsed").select("day", "experiment", "clip", "modality", "file")


@query("""SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN 'day' || CAST(doc_id AS VARCHAR) END AS day, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN 'experiment' || CAST(doc_id % 7 AS VARCHAR) ELSE 'experiment1' END AS experiment, CASE WHEN doc_id % 5 <> 0 AND lang IN ('de', 'en') THEN lang END AS category FROM documents""")
def s8_loose_identity(spark, sf_dir):
    """A folder before the day is never an experiment or a category, and one after the category no experiment; 'day 7' is no day."""
    n = F.col("doc_id")
    day = F.when(n % 5 == 0, F.concat(F.lit("day "), n.cast("string"))).otherwise(F.concat(F.lit("Day0"), n.cast("string")))
    own = F.when(n % 6 == 0, (n % 7).cast("string")).when(n % 3 == 0, F.concat(F.lit("Experiment"), (n % 7).cast("string")))
    folder = F.concat_ws("/", F.lit("de/experiment9"), day, own, F.lit("x"), "lang", F.lit("experiment8"))
    d, e, c = scans.parse_loose_identity(folder, ["de", "en"])
    return table(spark, sf_dir, "documents").select("doc_id", d.alias("day"), e.alias("experiment"), c.alias("category"))


@query("SELECT o_orderkey AS task FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 = 0")
def s9_ready_tasks(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task"))
    return scans.ready_tasks(o.where("task % 2 = 0").withColumn("name", F.lit("READY")).union(o.where("task % 3 = 0").withColumn("name", F.lit("job.json"))))


def _jobs(spark, sf_dir):
    """Customers' orders as jobs: a third is of version 1 and finds its pairs among files, the others list them with every kind of fault."""
    n, k = F.col("o_custkey"), F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    clip = F.when(k % 19 == 0, "x").otherwise(F.concat(F.lit("clip"), (k % 50).cast("string")))
    pair = F.struct(clip.alias("clip"), F.when(k % 7 == 0, "other").otherwise("health").alias("category"), F.when(k % 11 == 0, "../a").otherwise("a").alias("ir"), F.lit("b").alias("rgb"), (k % 5 != 0).alias("user_confirmed"))
    lists = o.where(n % 3 != 0).groupBy(n.alias("task")).agg(F.collect_list(pair).alias("pairs"))
    old = o.where(n % 3 == 0).select(n.alias("task")).distinct()
    jobs = lists.select("task", F.lit("experiment").alias("job_type"), F.lit(2).alias("schema_version"), "pairs").unionByName(old.select("task", F.lit("experiment").alias("job_type"), F.lit(None).cast("int").alias("schema_version")), allowMissingColumns=True)
    files = o.where(n % 3 == 0).select(n.alias("task"), F.lit("health").alias("category"), F.when(k % 2 == 0, "ir").otherwise("rgb").alias("modality"), (k % 6).cast("string").alias("stem"))
    return scans.read_job_pairs(jobs, files, ["health", "sick"])


_JOBS = """v AS (SELECT o_custkey AS task, o_orderkey AS k, CASE WHEN o_orderkey % 19 <> 0 THEN lpad(CAST(o_orderkey % 50 AS VARCHAR), 2, '0') END AS clip, CASE WHEN o_orderkey % 7 = 0 THEN 'other' ELSE 'health' END AS category FROM orders WHERE o_custkey % 3 <> 0),
w AS (SELECT *, CASE WHEN clip IS NULL THEN 'not_a_number' WHEN category = 'other' THEN 'unknown_category' WHEN count(*) OVER (PARTITION BY task, category, clip) > 1 THEN 'duplicate_clip' WHEN k % 5 = 0 THEN 'not_confirmed' WHEN k % 11 = 0 THEN 'unsafe_path' END AS code FROM v),
f AS (SELECT o_custkey AS task, CASE WHEN o_orderkey % 2 = 0 THEN 'ir' ELSE 'rgb' END AS modality, o_orderkey % 6 AS stem, count(*) AS c FROM orders WHERE o_custkey % 3 = 0 GROUP BY 1, 2, 3)"""


@query(f"WITH {_JOBS} SELECT task, clip, 'a' AS ir FROM w WHERE code IS NULL UNION ALL SELECT a.task, lpad(CAST(a.stem AS VARCHAR), 2, '0'), CAST(a.stem AS VARCHAR) FROM f a JOIN f b ON a.task = b.task AND a.stem = b.stem AND a.modality = 'ir' AND b.modality = 'rgb' WHERE a.c = 1 AND b.c = 1")
def s10_job_pairs(spark, sf_dir):
    return _jobs(spark, sf_dir)[0].select("task", "clip", "ir")


@query(f"""WITH {_JOBS} SELECT task, COALESCE(clip, 'x') AS clip, code FROM w WHERE code IS NOT NULL UNION ALL SELECT task, CAST(stem AS VARCHAR), 'ambiguous_number' FROM f WHERE c > 1
UNION ALL SELECT task, CAST(stem AS VARCHAR), 'unpaired' FROM f WHERE c = 1 AND NOT EXISTS (SELECT 1 FROM f g WHERE g.task = f.task AND g.stem = f.stem AND g.modality <> f.modality AND g.c = 1)""")
def s10_job_issues(spark, sf_dir):
    return _jobs(spark, sf_dir)[1]


@query("SELECT 'only_left' AS code, 'x/' || CAST(doc_id AS VARCHAR) AS key FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 4 = 0 UNION ALL SELECT 'only_right', 'x/' || CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id % 3 = 0 AND doc_id % 4 <> 0")
def s11_pair_folders(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    side = lambda root, k: d.where(F.col("doc_id") % k != 0).select(F.lit(root).alias("root"), F.concat(F.lit(f"{root}/x/"), F.col("doc_id").cast("string")).alias("path"))
    return scans.scan_pair_folders(side("/vis", 3), side("/ir/deep", 4))[1]


# --- grids and tiles --------------------------------------------------------------------------------------------------------

_LAPLACE = "SELECT frame_id, y, x, sum(w * v) AS v FROM (SELECT g.frame_id, t.y, t.x, t.w, g.v FROM (SELECT f.frame_id, p.y, p.x, k.w, CASE p.y + k.dy WHEN 8 THEN 6 ELSE abs(p.y + k.dy) END AS sy, CASE p.x + k.dx WHEN 8 THEN 6 ELSE abs(p.x + k.dx) END AS sx FROM (SELECT DISTINCT frame_id FROM grid) f CROSS JOIN (SELECT i // 8 AS y, i % 8 AS x FROM range(64) r(i)) p CROSS JOIN (VALUES (0, 0, -4.0), (0, 1, 1.0), (0, -1, 1.0), (1, 0, 1.0), (-1, 0, 1.0)) k(dy, dx, w)) t JOIN grid g ON g.frame_id = t.frame_id AND g.y = t.sy AND g.x = t.sx) GROUP BY 1, 2, 3"


@query(f"WITH {I.GRID}, c AS ({_LAPLACE}) SELECT frame_id, round(var_pop(v), 6) AS sharpness FROM c GROUP BY 1")
def x1_x2_sharpness(spark, sf_dir):
    return r6(I.grid(spark, sf_dir).select("frame_id", grid.sharpness(F.col("v"), *I.size()).alias("sharpness")), "sharpness")


@query(f"WITH {I.GRID}, {_weights('a', 8, 6, 'area')}, {_resampled('small', 'grid', 'a')}, c AS ({_LAPLACE.replace('grid', 'small').replace('i // 8', 'i // 6').replace('i % 8', 'i % 6').replace('range(64)', 'range(36)').replace('WHEN 8 THEN 6', 'WHEN 6 THEN 4')}) SELECT frame_id, round(var_pop(v), 6) AS sharpness FROM c GROUP BY 1")
def x2_sharpness_of_wide_frames(spark, sf_dir):
    """Frames wider than six pixels are shrunk first."""
    return r6(I.grid(spark, sf_dir).select("frame_id", grid.sharpness(F.col("v"), *I.size(), 6).alias("sharpness")), "sharpness")


@query(f"WITH {I.GRID}, k(dy, dx, w) AS (VALUES (0, 0, 0.5), (-1, 2, 0.25), (1, 0, -1.0)) SELECT a.frame_id, CAST(a.y AS INT) AS y, CAST(a.x AS INT) AS x, round(sum(w * b.v), 6) + 0.0 AS v FROM grid a JOIN k ON true JOIN grid b ON a.frame_id = b.frame_id AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY 1, 2, 3")
def x1_convolve(spark, sf_dir):
    v = grid.convolve(F.col("v"), *I.size(), {(0, 0): 0.5, (-1, 2): 0.25, (1, 0): -1.0})
    return r6(grid.to_pixels(I.grid(spark, sf_dir).withColumn("v", v)), "v")


_GRAD = """SELECT frame_id, y, x, sqrt(gy * gy + gx * gx) AS g FROM (SELECT frame_id, y, x, CASE WHEN yb IS NULL THEN ya - v WHEN ya IS NULL THEN v - yb ELSE (ya - yb) / 2 END AS gy, CASE WHEN xb IS NULL THEN xa - v WHEN xa IS NULL THEN v - xb ELSE (xa - xb) / 2 END AS gx
 FROM (SELECT *, lag(v) OVER (PARTITION BY frame_id, x ORDER BY y) AS yb, lead(v) OVER (PARTITION BY frame_id, x ORDER BY y) AS ya, lag(v) OVER (PARTITION BY frame_id, y ORDER BY x) AS xb, lead(v) OVER (PARTITION BY frame_id, y ORDER BY x) AS xa FROM {0}))"""


_EDGES = f"{I.GRID}, {I.OTHER}, {_weights('b6', 8, 6, 'bilinear')}, {_resampled('g6', 'grid', 'b6')}, {_resampled('o6', 'other', 'b6')}, a AS ({_GRAD.format('g6')}), b AS ({_GRAD.format('o6')})"


@query(f"""WITH {_EDGES}
SELECT a.frame_id, round(CASE WHEN stddev_pop(a.g) >= 1e-8 AND stddev_pop(b.g) >= 1e-8 THEN covar_pop(a.g, b.g) / (stddev_pop(a.g) * stddev_pop(b.g)) END, 6) AS edge_correlation FROM a LEFT JOIN b USING (frame_id, y, x) GROUP BY 1""")
def x3_edge_correlation(spark, sf_dir):
    """Both brought to a width of six. The last frame has no other modality, so no correlation."""
    return r6(I.both(spark, sf_dir, "left").select("frame_id", grid.edge_correlation(F.col("v"), F.col("u"), *I.size(), 6).alias("edge_correlation")), "edge_correlation")


@query(f"""WITH {_EDGES}, e AS (SELECT a.frame_id, round(CASE WHEN stddev_pop(a.g) >= 1e-8 AND stddev_pop(b.g) >= 1e-8 THEN covar_pop(a.g, b.g) / (stddev_pop(a.g) * stddev_pop(b.g)) END, 6) AS c FROM a LEFT JOIN b USING (frame_id, y, x) GROUP BY 1)
SELECT frame_id, CASE WHEN c >= 0.1 THEN 'pass_information_only' ELSE 'manual_review' END AS review, concat_ws(';', CASE WHEN frame_id % 4 = 0 THEN 'missing_sync_preview' END, CASE WHEN c IS NULL THEN 'edge_correlation_unavailable' END) AS note FROM e WHERE frame_id % 5 <> 0""")
def q3_registration_review(spark, sf_dir):
    """A fifth of the frames isn't usable, a quarter has no preview."""
    rows = x3_edge_correlation(spark, sf_dir).withColumns({"usable": F.col("frame_id") % 5 != 0, "preview_exists": F.col("frame_id") % 4 != 0})
    return audit.registration_review(rows).select("frame_id", "review", "note")


def _ssim(a, b, name):
    """SQL of name (frame_id, s): structural similarity of two tables of pixels, as sums over all 121 weights of the two-dimensional window."""
    sums = ", ".join(f"sum(w * {e}) AS {n}" for n, e in {"ma": "a", "mb": "b", "aa": "a * a", "bb": "b * b", "ab": "a * b"}.items())
    return f"""{name}_p AS (SELECT frame_id, y, x, a.v AS a, b.v AS b FROM {a} a JOIN {b} b USING (frame_id, y, x)),
{name}_m AS (SELECT t.frame_id, t.y, t.x, {sums} FROM (SELECT p.frame_id, q.y, q.x, g.w * h.w AS w, p.a, p.b FROM {name}_p p JOIN {name}_p q ON p.frame_id = q.frame_id JOIN gauss g ON g.d = p.y - q.y JOIN gauss h ON h.d = p.x - q.x) t GROUP BY 1, 2, 3),
{name} AS (SELECT frame_id, avg(((2 * ma * mb + 1e-4) * (2 * (ab - ma * mb) + 9e-4)) / ((ma * ma + mb * mb + 1e-4) * ((aa - ma * ma) + (bb - mb * mb) + 9e-4))) AS s FROM {name}_m GROUP BY 1)"""


_GAUSS = "gauss AS (SELECT i - 5 AS d, exp(-((i - 5) ** 2) / 4.5) / (SELECT sum(exp(-((j - 5) ** 2) / 4.5)) FROM range(11) s(j)) AS w FROM range(11) r(i))"


@query(f"WITH {I.GRID}, {I.OTHER}, {_GAUSS}, {_ssim('grid', 'other', 's')} SELECT frame_id, round(s, 6) AS ssim FROM s")
def x4_ssim(spark, sf_dir):
    return r6(I.both(spark, sf_dir).select("frame_id", grid.ssim(F.col("v"), F.col("u"), *I.size()).alias("ssim")), "ssim")


_FORWARD = "SELECT frame_id, y, x, sqrt(pow(COALESCE(lead(v) OVER (PARTITION BY frame_id, y ORDER BY x), v) - v, 2) + pow(COALESCE(lead(v) OVER (PARTITION BY frame_id, x ORDER BY y), v) - v, 2) + 1e-8) AS v FROM {0}"


def _against(of):
    """SQL: mean error of three tables of pixels made by of(table), the first against the larger of the others."""
    return f"(SELECT frame_id, avg(abs(f.v - greatest(i.v, r.v))) AS e FROM ({of('fused')}) f JOIN ({of('grid')}) i USING (frame_id, y, x) JOIN ({of('other')}) r USING (frame_id, y, x) GROUP BY 1)"


@query(f"""WITH {I.GRID}, {I.OTHER}, {_GAUSS}, fused AS (SELECT frame_id, y, x, (a.v + b.v) / 2 AS v FROM grid a JOIN other b USING (frame_id, y, x)), {_ssim('fused', 'grid', 's')}, {_ssim('fused', 'other', 't')},
m AS (SELECT p.frame_id, p.e AS intensity, q.e AS gradient, 1 - greatest(s.s, t.s) AS structure, z.e AS edge FROM {_against(lambda t: f'SELECT * FROM {t}')} p JOIN {_against(_FORWARD.format)} q USING (frame_id) JOIN s USING (frame_id) JOIN t USING (frame_id)
 JOIN {_against(lambda t: f'SELECT a.frame_id, a.y, a.x, abs(sum(w * b.v)) AS v FROM {t} a JOIN (VALUES (0, 0, -4.0), (0, 1, 1.0), (0, -1, 1.0), (1, 0, 1.0), (-1, 0, 1.0)) k(dy, dx, w) ON true JOIN {t} b ON a.frame_id = b.frame_id AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY 1, 2, 3')} z USING (frame_id))
SELECT frame_id, round(intensity, 6) AS intensity, round(gradient, 6) AS gradient, round(structure, 6) AS structure, round(edge, 6) AS edge, round(intensity + 10 * gradient + 5 * structure + 2 * edge, 6) AS total FROM m""")
def x5_fusion_quality(spark, sf_dir):
    b = I.both(spark, sf_dir)
    q = grid.fusion_quality(grid.baseline(F.col("v"), F.col("u")), F.col("v"), F.col("u"), *I.size())
    return r6(b.select("frame_id", q.alias("q")).select("frame_id", "q.*"), "intensity", "gradient", "structure", "edge", "total")


_WARPED = """t AS (SELECT DISTINCT frame_id, y, x, (1.0 * x + 0.1 * y + 0.25) / (0.01 * x + 1.0) AS sx, (0.05 * x + 1.1 * y - 0.5) / (0.01 * x + 1.0) AS sy FROM grid)"""


def _warped(spark, sf_dir):
    h = F.array(*(F.lit(x) for x in (1.0, 0.1, 0.25, 0.05, 1.1, -0.5, 0.01, 0.0, 1.0)))
    return I.grid(spark, sf_dir).withColumn("w", grid.warp(F.col("v"), *I.size(), h))


@query(f"WITH {I.GRID}, {_WARPED} SELECT frame_id, round(avg(CASE WHEN floor(sx + 0.5) BETWEEN 0 AND 7 AND floor(sy + 0.5) BETWEEN 0 AND 7 THEN 1.0 ELSE 0.0 END), 6) AS overlap FROM t GROUP BY 1")
def x19_warp_overlap(spark, sf_dir):
    return r6(_warped(spark, sf_dir).select("frame_id", "w.overlap"), "overlap")


@query(f"""WITH {I.GRID}, {_WARPED} SELECT t.frame_id, CAST(t.y AS INT) AS y, CAST(t.x AS INT) AS x, round(sum((1 - abs(sx - g.x)) * (1 - abs(sy - g.y)) * v), 6) + 0.0 AS v FROM t CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) k(dy, dx) JOIN grid g ON g.frame_id = t.frame_id AND g.y = floor(sy) + dy AND g.x = floor(sx) + dx GROUP BY 1, 2, 3""")
def x19_warp(spark, sf_dir):
    return r6(grid.to_pixels(_warped(spark, sf_dir).withColumn("v", F.col("w.v"))), "v")


@query("""SELECT clip, y, x, CAST(count(DISTINCT frame) AS BIGINT) AS frames FROM (SELECT l_returnflag AS clip, l_orderkey % 3 AS frame, CAST(l_quantity AS INT) AS y, l_linenumber AS x FROM lineitem WHERE l_discount > 0.05) GROUP BY 1, 2, 3 HAVING count(DISTINCT frame) >= 2""")
def x20_temporal_consensus(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").where("l_discount > 0.05").select(F.col("l_returnflag").alias("clip"), (F.col("l_orderkey") % 3).alias("frame"), F.col("l_quantity").cast("int").alias("y"), F.col("l_linenumber").alias("x"))
    return grid.temporal_consensus(p, 2)


@query(f"WITH {I.GRID} SELECT CAST(frame_id // 5 AS BIGINT) AS clip, CAST(y AS INT) AS y, CAST(x AS INT) AS x, round(median(v), 6) + 0.0 AS v FROM grid GROUP BY 1, 2, 3")
def x20_median_background(spark, sf_dir):
    """Five frames to a clip."""
    m = grid.median_background(I.grid(spark, sf_dir).withColumn("clip", F.expr("frame_id div 5")), "clip")
    return r6(grid.to_pixels(m.withColumnRenamed("clip", "frame_id")).withColumnRenamed("frame_id", "clip"), "v")


_SETS = """p AS (SELECT p_brand AS grp, p_size AS y, CAST(floor(p_retailprice / 20) AS INT) + CASE WHEN p_partkey % 14 = 0 THEN 150 ELSE 0 END AS x, p_partkey % 2 = 0 AS even FROM part WHERE p_brand NOT LIKE '%1' OR p_partkey % 2 = 0),
a AS (SELECT DISTINCT grp, y, x FROM p WHERE even), b AS (SELECT DISTINCT grp, y, x FROM p WHERE NOT even)"""


@query(f"""WITH {_SETS}, d AS (SELECT a.grp, a.y, a.x, min(sqrt((a.y - b.y) ** 2 + (a.x - b.x) ** 2)) AS d FROM a JOIN b USING (grp) GROUP BY 1, 2, 3 UNION ALL SELECT b.grp, b.y, b.x, min(sqrt((a.y - b.y) ** 2 + (a.x - b.x) ** 2)) FROM a JOIN b USING (grp) GROUP BY 1, 2, 3),
m AS (SELECT g.grp, quantile_cont(d, 0.5) AS median, quantile_cont(d, 0.75) AS p75, quantile_cont(d, 0.9) AS p90, COALESCE(avg(CASE WHEN d IS NOT NULL THEN CASE WHEN d <= 1.5 THEN 1.0 ELSE 0.0 END END), 0.0) AS within FROM (SELECT grp FROM a UNION SELECT grp FROM b) g LEFT JOIN d USING (grp) GROUP BY 1)
SELECT grp, CASE WHEN median IS NULL THEN 'unavailable' WHEN median <= 1 AND p75 <= 4 THEN 'excellent' WHEN median <= 2 AND p75 <= 8 THEN 'good' WHEN median <= 4 THEN 'fair' ELSE 'poor' END AS rating, round(median, 6) AS median, round(p75, 6) AS p75, round(p90, 6) AS p90, round(within, 6) AS within FROM m""")
def x21_chamfer(spark, sf_dir):
    """Some points lie far from all others, and some brands have points on one side alone."""
    p = table(spark, sf_dir, "part").where("p_brand not like '%1' or p_partkey % 2 = 0")
    p = p.select("p_partkey", F.col("p_brand").alias("grp"), F.col("p_size").alias("y"), (F.floor(F.col("p_retailprice") / 20) + F.when(F.col("p_partkey") % 14 == 0, 150).otherwise(0)).cast("int").alias("x"))
    return r6(grid.chamfer_rating(grid.chamfer(p.where("p_partkey % 2 = 0"), p.where("p_partkey % 2 = 1"), "grp")), "median", "p75", "p90", "within")


@query(f"""WITH {I.GRID}, {I.OTHER}, ok AS (SELECT * FROM grid WHERE NOT (y = 0 AND x < 3)), a AS (SELECT frame_id, y, x FROM ok WHERE v > 0.15), b AS (SELECT o.frame_id, o.y, o.x FROM other o JOIN ok USING (frame_id, y, x) WHERE o.v > 0.2),
d AS (SELECT a.frame_id, a.y, a.x, min(sqrt((a.y - b.y) ** 2 + (a.x - b.x) ** 2)) AS d FROM a JOIN b USING (frame_id) GROUP BY 1, 2, 3 UNION ALL SELECT b.frame_id, b.y, b.x, min(sqrt((a.y - b.y) ** 2 + (a.x - b.x) ** 2)) FROM a JOIN b USING (frame_id) GROUP BY 1, 2, 3)
SELECT f.frame_id, round(quantile_cont(d, 0.5), 6) AS median, round(quantile_cont(d, 0.75), 6) AS p75, round(quantile_cont(d, 0.9), 6) AS p90, round(COALESCE(avg(CASE WHEN d IS NOT NULL THEN CASE WHEN d <= 1.5 THEN 1.0 ELSE 0.0 END END), 0.0), 6) AS within
FROM (SELECT DISTINCT frame_id FROM grid JOIN other USING (frame_id)) f LEFT JOIN d USING (frame_id) GROUP BY 1""")
def x21_edge_agreement(spark, sf_dir):
    """Edges of whole frames outside a corner that isn't valid."""
    above = lambda c, least: F.transform(c, lambda x: F.when(x > least, 1.0).otherwise(0.0))
    valid = F.transform("v", lambda x, i: F.when(i < 3, 0.0).otherwise(1.0))
    d = grid.edge_agreement(above("v", 0.15), above("u", 0.2), valid, *I.size())
    return r6(I.both(spark, sf_dir).select("frame_id", d.alias("d")).select("frame_id", "d.*"), "median", "p75", "p90", "within")


_TILES = "f AS (SELECT p_partkey AS frame_id, p_size + 40 AS h, p_size * 2 + 35 AS w FROM part), ys AS (SELECT DISTINCT frame_id, w, unnest(list_append(range(0, h - 32 + 1, 24), h - 32)) AS y0 FROM f), t AS (SELECT DISTINCT frame_id, CAST(y0 AS INT) AS y0, CAST(unnest(list_append(range(0, w - 32 + 1, 24), w - 32)) AS INT) AS x0 FROM ys)"


@query(f"WITH {_TILES} SELECT * FROM t")
def x23_plan_tiles(spark, sf_dir):
    f = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("frame_id"), (F.col("p_size") + 40).alias("height"), (F.col("p_size") * 2 + 35).alias("width"))
    return grid.plan_tiles(f, 32, 8)


@query(f"WITH {I.GRID} SELECT frame_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, round(v, 6) + 0.0 AS v FROM grid")
def x24_blend_identity(spark, sf_dir):
    """Tiles of 4 with an overlap of 2, scored by the identity, blend to the frame itself."""
    return r6(grid.to_pixels(grid.score_tiled(I.grid(spark, sf_dir), lambda tiles: tiles, 4, 2)), "v")


@query(f"""WITH {I.GRID}, t AS (SELECT y0, x0 FROM (VALUES (0), (3), (4)) a(y0) CROSS JOIN (VALUES (0), (3), (4)) b(x0)), k AS (SELECT i, 0.5 - 0.5 * cos(2 * pi() * i / 3) AS w FROM range(4) r(i)),
p AS (SELECT frame_id, g.y, g.x, v, y0, x0, greatest(1e-3, a.w * b.w) AS w, max(v) OVER (PARTITION BY frame_id, y0, x0) AS m FROM grid g JOIN t ON g.y BETWEEN y0 AND y0 + 3 AND g.x BETWEEN x0 AND x0 + 3 JOIN k a ON a.i = g.y - y0 JOIN k b ON b.i = g.x - x0)
SELECT frame_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, round(sum(w * (m - v)) / sum(w), 6) + 0.0 AS v FROM p GROUP BY 1, 2, 3""")
def x24_x25_score_tiled(spark, sf_dir):
    """Tiles of 4 with an overlap of 1, each scored by its distance to the tile's largest value."""
    return r6(grid.to_pixels(grid.score_tiled(I.grid(spark, sf_dir), lambda tiles: tiles.max(axis=(1, 2), keepdims=True) - tiles, 4, 1)), "v")


@query(f"WITH {I.GRID}, {I.OTHER} SELECT frame_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, round(CASE WHEN o.v IS NULL THEN g.v ELSE 0.5 * g.v + 0.5 * o.v END, 6) + 0.0 AS v FROM grid g LEFT JOIN (SELECT * FROM other WHERE v > 0) o USING (frame_id, y, x)")
def x26_blend_masked(spark, sf_dir):
    """Pixels of the other modality above zero are valid; the last frame has none."""
    b = I.both(spark, sf_dir, "left").withColumn("u", F.transform("u", lambda x: F.when(x > 0, x)))
    return r6(grid.to_pixels(b.withColumn("v", grid.blend_masked(F.col("v"), F.col("u")))), "v")


_DRAWS = """u AS (SELECT 'd' || CAST(doc_id AS VARCHAR) AS sample_id FROM documents), d AS (SELECT sample_id, salt, CAST(('0x' || substr(sha256('42:1:' || sample_id || ':' || salt), 1, 12)) AS BIGINT) / 281474976710656.0 AS u FROM u CROSS JOIN (VALUES ('y'), ('x'), ('flip'), ('flip_v'), ('rotate'), ('angle'), ('colour'), ('brightness'), ('contrast'), ('saturation'), ('hue')) s(salt)),
p AS (PIVOT d ON salt IN ('y', 'x', 'flip', 'flip_v', 'rotate', 'angle', 'colour', 'brightness', 'contrast', 'saturation', 'hue') USING max(u) GROUP BY sample_id)"""


@query(f"""WITH {_DRAWS} SELECT sample_id, CAST(floor(y * 33) AS INT) AS crop_y, CAST(floor(x * 65) AS INT) AS crop_x, flip < 0.5 AS flip, flip_v < 0.25 AS flip_v, round(CASE WHEN rotate < 0.4 THEN 5 * (2 * angle - 1) ELSE 0.0 END, 6) AS angle,
 round(CASE WHEN colour < 0.5 THEN 1 + 0.1 * (2 * brightness - 1) ELSE 1.0 END, 6) AS brightness, round(CASE WHEN colour < 0.5 THEN 1 + 0.1 * (2 * contrast - 1) ELSE 1.0 END, 6) AS contrast, round(CASE WHEN colour < 0.5 THEN 1 + 0.1 * (2 * saturation - 1) ELSE 1.0 END, 6) AS saturation, round(CASE WHEN colour < 0.5 THEN 0.02 * (2 * hue - 1) ELSE 0.0 END, 6) AS hue FROM p""")
def x27_augment_params(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("sample_id"), F.lit(96).alias("height"), F.lit(128).alias("width"))
    return r6(augment.augment_params(s, 42, 1, 64, flip_v=0.25, rotate=0.4), "angle", "brightness", "contrast", "saturation", "hue")


@query(f"WITH {I.GRID} SELECT frame_id, CAST(CASE WHEN frame_id % 3 = 0 THEN 5 - (y - 1) ELSE y - 1 END AS INT) AS y, CAST(CASE WHEN frame_id % 2 = 0 THEN 5 - (x - 2) ELSE x - 2 END AS INT) AS x, v FROM grid WHERE y BETWEEN 1 AND 6 AND x BETWEEN 2 AND 7")
def x28_apply_geometry(spark, sf_dir):
    g = I.grid(spark, sf_dir)
    return grid.to_pixels(augment.apply_geometry(g, g.select("frame_id", F.lit(1).alias("crop_y"), F.lit(2).alias("crop_x"), (F.col("frame_id") % 2 == 0).alias("flip"), (F.col("frame_id") % 3 == 0).alias("flip_v")), 6))


@query(f"WITH {I.GRID}, m AS (SELECT i, CASE WHEN i < 2 THEN 2 - i WHEN i > 9 THEN 16 - i ELSE i - 2 END AS s FROM range(12) r(i)) SELECT frame_id, CAST(a.i AS INT) AS y, CAST(b.i AS INT) AS x, v FROM grid JOIN m a ON y = a.s JOIN m b ON x = b.s")
def x28_pad(spark, sf_dir):
    """Frames of 8 for a crop of 12 are mirrored by two pixels on every side."""
    g = I.grid(spark, sf_dir)
    return grid.to_pixels(augment.apply_geometry(g, g.select("frame_id", F.lit(0).alias("crop_y"), F.lit(0).alias("crop_x"), F.lit(False).alias("flip")), 12))


@query(f"""WITH {I.GRID}, c AS (SELECT frame_id, y - 1 AS y, x AS x, v FROM grid WHERE y BETWEEN 1 AND 6 AND x <= 5), f AS (SELECT frame_id, radians(frame_id % 61 - 30) AS a FROM c GROUP BY 1), rim AS (SELECT *, greatest(1, CAST(ceil(6 * sin(abs(a))) AS INT)) AS r FROM f),
t AS (SELECT frame_id, y, x, r, CASE WHEN a = 0 THEN y ELSE sin(a) * (x - 2.5) + cos(a) * (y - 2.5) + 2.5 END AS sy, CASE WHEN a = 0 THEN x ELSE cos(a) * (x - 2.5) - sin(a) * (y - 2.5) + 2.5 END AS sx FROM rim CROSS JOIN (SELECT i // 6 AS y, i % 6 AS x FROM range(36) g(i)) p),
n AS (SELECT *, CAST(floor(sy) AS INT) + dy AS iy, CAST(floor(sx) AS INT) + dx AS ix FROM t CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) k(dy, dx)),
s AS (SELECT *, CASE WHEN abs(iy) > 5 THEN 10 - abs(iy) ELSE abs(iy) END AS my, CASE WHEN abs(ix) > 5 THEN 10 - abs(ix) ELSE abs(ix) END AS mx, (1 - abs(sy - iy)) * (1 - abs(sx - ix)) AS w FROM n WHERE iy BETWEEN -r AND 5 + r AND ix BETWEEN -r AND 5 + r)
SELECT s.frame_id, CAST(s.y AS INT) AS y, CAST(s.x AS INT) AS x, round(sum(w * c.v), 6) + 0.0 AS v FROM s JOIN c ON c.frame_id = s.frame_id AND c.y = my AND c.x = mx GROUP BY 1, 2, 3""")
def x28_rotation(spark, sf_dir):
    """Crops of 6, turned by -30 to 30 degrees by their number; what comes in at the corners is mirrored."""
    g = I.grid(spark, sf_dir)
    p = g.select("frame_id", F.lit(1).alias("crop_y"), F.lit(0).alias("crop_x"), F.lit(False).alias("flip"), (F.col("frame_id") % 61 - 30).cast("double").alias("angle"))
    return r6(grid.to_pixels(augment.apply_geometry(g, p, 6)), "v")


_GREY = "0.2989 * r + 0.587 * g + 0.114 * b"
_CUT = "least(1.0, greatest(0.0, {}))"


def _mixed(with_, k):
    return ", ".join(f"{_CUT.format(f'{k} * {c} + (1 - {k}) * ({with_})')} AS {c}" for c in "rgb")


@query(f"""WITH {I.GRID}, k AS (SELECT frame_id, 0.8 + 0.1 * (frame_id % 5) AS kb, 0.9 + 0.1 * (frame_id % 3) AS kc, 0.5 + 0.25 * (frame_id % 4) AS ks, 0.1 * (frame_id % 11) - 0.5 AS kh FROM grid GROUP BY 1),
unit AS (SELECT frame_id, y, x, {_CUT.format('0.5 + v')} AS v FROM grid),
c0 AS (SELECT a.frame_id, a.y, a.x, a.v AS r, b.v AS g, c.v AS b FROM unit a JOIN unit b ON b.frame_id = a.frame_id AND b.y = a.y AND b.x = 7 - a.x JOIN unit c ON c.frame_id = a.frame_id AND c.y = 7 - a.y AND c.x = a.x),
c1 AS (SELECT frame_id, y, x, {_mixed('0.0', 'kb')} FROM c0 JOIN k USING (frame_id)), c2 AS (SELECT frame_id, y, x, {_mixed('m', 'kc')} FROM (SELECT *, avg({_GREY}) OVER (PARTITION BY frame_id) AS m FROM c1) JOIN k USING (frame_id)), c3 AS (SELECT frame_id, y, x, {_mixed(_GREY, 'ks')} FROM c2 JOIN k USING (frame_id)),
h AS (SELECT frame_id, y, x, r, g, b, kh, greatest(r, g, b) AS top, greatest(r, g, b) - least(r, g, b) AS span FROM c3 JOIN k USING (frame_id)),
hue AS (SELECT *, CASE WHEN span = 0 THEN 0.0 WHEN r = top THEN (g - b) / span WHEN g = top THEN 2 + (b - r) / span ELSE 4 + (r - g) / span END / 6 + kh AS t FROM h), six AS (SELECT *, 6 * (t - floor(t)) AS s FROM hue)
SELECT frame_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, {", ".join(f"round(CASE WHEN kh = 0 THEN {c} ELSE top - span * greatest(0.0, least(1.0, {k}, 4 - {k})) END, 6) + 0.0 AS {c}" for c, k in ((c, f"CASE WHEN s + {n} >= 6 THEN s + {n} - 6 ELSE s + {n} END") for c, n in zip("rgb", (5, 3, 1))))} FROM six""")
def x28_colour(spark, sf_dir):
    """Three channels made of a frame and its mirror images, with factors by its number."""
    at = lambda i: F.expr(f"transform(sequence(0, 63), k -> element_at(v, cast({i} + 1 as int)))")
    unit = F.transform("v", lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + x)))
    f = I.grid(spark, sf_dir).select("frame_id", "width", unit.alias("v")).select("frame_id", "width", F.col("v").alias("r"), at("(k div 8) * 8 + 7 - k % 8").alias("g"), at("(7 - k div 8) * 8 + k % 8").alias("b"))
    n = F.col("frame_id")
    p = f.select("frame_id", (0.8 + 0.1 * (n % 5)).alias("brightness"), (0.9 + 0.1 * (n % 3)).alias("contrast"), (0.5 + 0.25 * (n % 4)).alias("saturation"), (0.1 * (n % 11) - 0.5).alias("hue"))
    rows = augment.apply_colour(f, p).select("frame_id", F.posexplode(F.arrays_zip("r", "g", "b")).alias("i", "p"))
    return r6(rows.select("frame_id", F.expr("cast(i div 8 as int)").alias("y"), F.expr("cast(i % 8 as int)").alias("x"), "p.*"), "r", "g", "b")


# --- geometry -----------------------------------------------------------------------------------------------------------------


def _models(p):
    return p.select("grp").distinct().select("grp", F.array(*(F.lit(x) for x in I.MODEL)).alias("h"))


@query(f"""WITH {I.POINTS}, e AS (SELECT grp, sqrt((((1.1 * ir_x + 0.02 * ir_y + 3.0) / (0.001 * ir_x + 1.0)) - rgb_x) ** 2 + (((0.03 * ir_x + 0.9 * ir_y + 2.0) / (0.001 * ir_x + 1.0)) - rgb_y) ** 2) AS e FROM points)
SELECT grp, round(sqrt(avg(e * e)), 6) AS rmse, round(quantile_cont(e, 0.5), 6) AS median, round(quantile_cont(e, 0.95), 6) AS p95, round(max(e), 6) AS max_error, CAST(count(*) FILTER (e <= 1) AS BIGINT) AS within_1 FROM e GROUP BY 1""")
def x8_x15_projection_errors(spark, sf_dir):
    p = I.points(spark, sf_dir)
    return r6(series.error_metrics(geometry.project_points(p, _models(p), ["grp"]), ["grp"]), "rmse", "median", "p95", "max_error")


@query("SELECT p_partkey, round(2.2 * 1.1 * s, 6) AS h11, round(0.03 * s / 2, 6) AS h21, round(0.001 * s, 9) AS h31, s > 0 AS valid FROM (SELECT p_partkey, CAST(p_size % 10 AS DOUBLE) AS s FROM part)")
def x6_x7_adapt_homography(spark, sf_dir):
    s = (F.col("p_size") % 10).cast("double")
    rows = table(spark, sf_dir, "part").withColumn("h", F.array(*(F.lit(x) for x in I.MODEL)))
    rows = rows.withColumn("a", geometry.scale_homography(F.col("h"), s, s, F.lit(2.2), F.lit(0.5)))
    return rows.select("p_partkey", F.round(F.col("a")[0], 6).alias("h11"), F.round(F.col("a")[3], 6).alias("h21"), F.round(F.col("a")[6], 9).alias("h31"), geometry.is_valid(F.col("a")).alias("valid"))


@query("""WITH s AS (SELECT s_suppkey, s_suppkey % 25 AS n, s_acctbal / 12000 AS e, s_suppkey % 5 = 0 AS w, s_suppkey % 3 = 0 AS b, s_suppkey % 13 / 20.0 AS cov, 0.5 + s_suppkey % 12 / 10.0 AS area FROM supplier), r AS (SELECT *, n >= 10 AND abs(e) * 3 <= 2.0 AND cov >= 0.15 AND area BETWEEN 0.7 AND 1.4 AS ok FROM s)
SELECT s_suppkey, CASE WHEN n < 4 THEN 'failed' WHEN w OR e > 0.75 OR e * 1.5 > 1.2 OR e * 3.5 > 2.25 OR e * 1.7 > 1.2 THEN 'provisional_warning' WHEN n >= 18 THEN 'formal' ELSE 'provisional' END AS status,
 n >= 10 AND abs(e) * 3 <= 2.0 AND cov >= 0.15 AND area BETWEEN 0.7 AND 1.4 AS accepted,
 CASE WHEN b AND e * 3 <= 1 THEN 'excellent' WHEN b AND e * 3 <= 2 THEN 'good' WHEN b THEN 'review_required' WHEN ok AND abs(e) * 3 <= 0.5 AND cov >= 0.5 THEN 'excellent' WHEN ok THEN 'good' WHEN n % 2 = 0 THEN 'calibration_model_passed' ELSE 'calibration_fallback_review_required' END AS rating FROM r""")
def x17_x18_x22_status(spark, sf_dir):
    e = F.col("s_acctbal") / 12000
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 25).alias("pairs"), e.alias("rmse"), (e * 1.5).alias("p95"), (e * 3.5).alias("max_error"), (e * 1.7).alias("left_out"), (F.col("s_suppkey") % 5 == 0).alias("warning"), (F.col("s_suppkey") % 3 == 0).alias("board_accepted"))
    rows = geometry.quality_status(s).withColumns({"inliers": F.col("pairs") * 2, "matches": F.col("pairs") * 4, "coverage": F.col("s_suppkey") % 13 / 20, "median_error": F.abs("rmse") * 3, "area_ratio": F.lit(0.5) + F.col("s_suppkey") % 12 / 10, "board_rmse": F.col("rmse") * 3, "calibration_good": F.col("pairs") % 2 == 0})
    return geometry.geometric_rating(geometry.refine_gate(rows).withColumn("refined", F.col("accepted"))).select("s_suppkey", "status", "accepted", "rating")


_LINEAR = [["ir_x", "ir_y", "1.0", "0.0", "0.0", "0.0", "-rgb_x * ir_x", "-rgb_x * ir_y", "rgb_x"], ["0.0", "0.0", "0.0", "ir_x", "ir_y", "1.0", "-rgb_y * ir_x", "-rgb_y * ir_y", "rgb_y"]]


def _solved(points, by, rows=_LINEAR, name=""):
    """SQL of sums, elimination and models (by, h): least squares over 44 sums, by eliminating one unknown after another."""
    cells = ", ".join(f"sum(({rows[0][i]}) * ({rows[0][j]}) + ({rows[1][i]}) * ({rows[1][j]}))" for i in range(8) for j in range(9))
    return f"""sums{name} AS (SELECT {by}, [{cells}] AS m FROM {points} GROUP BY {by}),
steps{name} AS (SELECT {by}, 0 AS k, m FROM sums{name} UNION ALL SELECT {by}, k + 1, list_transform(range(0, 72), lambda i: CASE WHEN i // 9 = k THEN m[i + 1] / m[k * 10 + 1] ELSE m[i + 1] - m[(i // 9) * 9 + k + 1] * m[k * 9 + i % 9 + 1] / m[k * 10 + 1] END) FROM steps{name} WHERE k < 8),
models{name} AS (SELECT {by}, list_transform(range(0, 8), lambda i: m[i * 9 + 9]) AS h FROM steps{name} WHERE k = 8)"""


def _refined(points, by, times=3):
    """SQL of models (by, h) moved by so many Gauss-Newton steps on the reprojection error, the last as refined."""
    rows = [["d * ir_x", "d * ir_y", "d", "0.0", "0.0", "0.0", "-px * d * ir_x", "-px * d * ir_y", "rgb_x - px"], ["0.0", "0.0", "0.0", "d * ir_x", "d * ir_y", "d", "-py * d * ir_x", "-py * d * ir_y", "rgb_y - py"]]
    out, now = [_solved(points, by)], "models"
    for i in range(times):
        out.append(f"seen{i} AS (SELECT p.*, {_PX.format('ir_x', 'ir_y')} AS px, {_PY.format('ir_x', 'ir_y')} AS py, 1 / (h[7] * ir_x + h[8] * ir_y + 1) AS d FROM {points} p JOIN {now} USING ({by}))")
        out.append(_solved(f"seen{i}", by, rows, f"_{i}"))
        out.append(f"moved{i} AS (SELECT {by}, list_transform(range(1, 9), lambda k: a.h[k] + b.h[k]) AS h FROM {now} a JOIN models_{i} b USING ({by}))")
        now = f"moved{i}"
    return ", ".join([*out, f"refined AS (SELECT * FROM {now})"])


_PX, _PY = (f"(h[{i}] * {{0}} + h[{i + 1}] * {{1}} + h[{i + 2}]) / (h[7] * {{0}} + h[8] * {{1}} + 1)" for i in (1, 4))
_ERROR = f"(({_PX.format('ir_x', 'ir_y')}) - rgb_x) ** 2 + (({_PY.format('ir_x', 'ir_y')}) - rgb_y) ** 2"


@query(f"WITH RECURSIVE {I.POINTS}, {_solved('points', 'grp')} SELECT grp, round(sqrt(avg({_ERROR})), 6) AS rmse FROM points JOIN models USING (grp) GROUP BY grp")
def x10_fit_homography(spark, sf_dir):
    """Errors of the fitted matrices: as low as the noise that the points were given."""
    p = I.points(spark, sf_dir)
    return r6(series.error_metrics(geometry.project_points(p, geometry.fit_homography(p, ["grp"]), ["grp"]), ["grp"]).select("grp", "rmse"), "rmse")


@query(f"WITH RECURSIVE {I.POINTS}, {_refined('points', 'grp')} SELECT grp, round(sqrt(avg({_ERROR})), 8) AS rmse FROM points JOIN refined USING (grp) GROUP BY grp")
def x10_refined_homography(spark, sf_dir):
    """Matrices of the least reprojection error."""
    p = I.points(spark, sf_dir)
    models = geometry.fit_homography(p, ["grp"], 10)
    return series.error_metrics(geometry.project_points(p, models, ["grp"]), ["grp"]).select("grp", F.round("rmse", 8).alias("rmse"))


_DRAWN = f"""factors(trial, a, b) AS (VALUES {", ".join(f"({t}, {a}, {b})" for t, (a, b) in enumerate(geometry.draw_factors(64, 7)))}),
drawn AS (SELECT * FROM (SELECT p.*, trial, row_number() OVER (PARTITION BY grp, trial ORDER BY (a * x + b) % {geometry.PRIME}, x) AS place FROM (SELECT *, CAST('0x' || substr(sha256(CAST(pt AS VARCHAR)), 1, 15) AS BIGINT) % {geometry.PRIME} AS x FROM points) p CROSS JOIN factors) WHERE place <= 4)"""


@query(f"WITH {I.POINTS}, {_DRAWN} SELECT grp, CAST(trial AS INT) AS trial, pt FROM drawn")
def x11_drawn_points(spark, sf_dir):
    return geometry.draw_points(I.points(spark, sf_dir), ["grp"], key=["pt"]).select("grp", "trial", "pt")


@query(f"""WITH RECURSIVE {I.POINTS}, {_DRAWN}, {_solved('drawn', 'grp, trial')}, s AS (SELECT grp, trial, round(sum(CASE WHEN {_ERROR} <= 0.0025 THEN 1 - ({_ERROR}) / 0.0025 ELSE 0.0 END), 9) AS score, count(*) FILTER ({_ERROR} <= 0.0025) AS inliers FROM points JOIN models USING (grp) GROUP BY 1, 2)
SELECT grp, CAST(arg_max(inliers, struct_pack(score := score, trial := -trial)) AS BIGINT) AS inliers FROM s WHERE inliers > 0 GROUP BY grp""")
def x11_fit_robust(spark, sf_dir):
    return geometry.fit_robust(I.points(spark, sf_dir), ["grp"], threshold=0.05, key=["pt"]).select("grp", "inliers")


@query(f"WITH {I.POINTS} SELECT DISTINCT grp, pair, 'robust_global' AS stage FROM points WHERE pair = grp % 5")
def x12_filter_pairs(spark, sf_dir):
    """One pair of each group is shifted by 5 pixels and goes; the others, which a matrix maps, stay."""
    p = I.points(spark, sf_dir).withColumn("rgb_x", F.col("rgb_x") + F.when(F.col("pair") == F.col("grp") % 5, 5.0).otherwise(0.0))
    return geometry.filter_pairs(p, ["grp"], "pair", 0.1, 0.2, 0.4, threshold=0.05)[1]


@query(f"""WITH RECURSIVE {I.POINTS}, other AS (SELECT a.grp, a.pair, b.ir_x, b.ir_y, b.rgb_x, b.rgb_y FROM (SELECT DISTINCT grp, pair FROM points) a JOIN points b ON a.grp = b.grp AND a.pair <> b.pair), {_refined('other', 'grp, pair')}
SELECT grp, pair, round(sqrt(avg({_ERROR})), 8) AS rmse FROM points JOIN refined USING (grp, pair) GROUP BY 1, 2""")
def x13_refined_leave_one_out(spark, sf_dir):
    return geometry.leave_one_out(I.points(spark, sf_dir), ["grp"], "pair", 10).select("grp", "pair", F.round("rmse", 8).alias("rmse"))


@query(f"""WITH RECURSIVE {I.POINTS}, other AS (SELECT a.grp, a.pair, b.ir_x, b.ir_y, b.rgb_x, b.rgb_y FROM (SELECT DISTINCT grp, pair FROM points) a JOIN points b ON a.grp = b.grp AND a.pair <> b.pair), {_solved('other', 'grp, pair')}
SELECT grp, pair, round(sqrt(avg({_ERROR})), 6) AS rmse FROM points JOIN models USING (grp, pair) GROUP BY 1, 2""")
def x13_leave_one_out(spark, sf_dir):
    return r6(geometry.leave_one_out(I.points(spark, sf_dir), ["grp"], "pair"), "rmse")


_SEEN = f"""{_solved('points', 'grp, pair')}, seen AS (SELECT grp, pair, k, {_PX.format('(k % 3)', '(k // 3)')} AS x, {_PY.format('(k % 3)', '(k // 3)')} AS y FROM models CROSS JOIN range(9) r(k) WHERE (SELECT count(*) FROM points p WHERE p.grp = models.grp AND p.pair = models.pair) >= 4)"""


@query(f"""WITH RECURSIVE {I.POINTS}, {_SEEN}, d AS (SELECT a.grp, a.pair, b.pair AS o, CASE WHEN a.pair = b.pair THEN 0.0 ELSE median(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) END AS d FROM seen a JOIN seen b ON a.grp = b.grp AND a.k = b.k GROUP BY 1, 2, 3),
s AS (SELECT grp, pair, median(d) AS spread, max(d) AS widest FROM d GROUP BY 1, 2) SELECT grp, arg_min(pair, struct_pack(spread := spread, pair := pair)) AS medoid, round(min(spread), 4) AS spread, round(arg_min(widest, struct_pack(spread := spread, pair := pair)), 4) AS widest FROM s GROUP BY 1""")
def x14_medoid(spark, sf_dir):
    p = I.points(spark, sf_dir)
    models = geometry.fit_homography(p, ["grp", "pair"]).where("h is not null")
    return geometry.select_medoid(models, ["grp"], "pair", 3.0, 3.0).select("grp", "medoid", F.round("spread", 4).alias("spread"), F.round("widest", 4).alias("widest"))


@query(f"""WITH RECURSIVE {I.POINTS}, {_SEEN}, whole AS (SELECT grp, k, (1.1 * (k % 3) + 0.02 * (k // 3) + 3.0) / (0.001 * (k % 3) + 1) AS x, (0.03 * (k % 3) + 0.9 * (k // 3) + 2.0) / (0.001 * (k % 3) + 1) AS y FROM (SELECT DISTINCT grp FROM points) CROSS JOIN range(9) r(k)),
d AS (SELECT grp, pair, median(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS d FROM seen a JOIN whole b USING (grp, k) GROUP BY 1, 2) SELECT grp, arg_min(pair, struct_pack(d := d, pair := pair)) AS medoid, round(median(d), 4) AS spread, round(max(d), 4) AS widest FROM d GROUP BY 1""")
def x14_medoid_of_reference(spark, sf_dir):
    """Against the group's global model."""
    p = I.points(spark, sf_dir)
    models = geometry.fit_homography(p, ["grp", "pair"]).where("h is not null")
    return geometry.select_medoid(models, ["grp"], "pair", 3.0, 3.0, _models(p)).select("grp", "medoid", F.round("spread", 4).alias("spread"), F.round("widest", 4).alias("widest"))


@query(f"""WITH {I.POINTS}, e AS (SELECT a.grp, a.pair, sum(a.rgb_x * b.rgb_y - b.rgb_x * a.rgb_y) / 2 AS area FROM points a JOIN points b ON a.grp = b.grp AND a.pair = b.pair AND a.pt <> b.pt
 WHERE NOT EXISTS (SELECT 1 FROM points c WHERE c.grp = a.grp AND c.pair = a.pair AND (b.rgb_x - a.rgb_x) * (c.rgb_y - a.rgb_y) - (b.rgb_y - a.rgb_y) * (c.rgb_x - a.rgb_x) < 0) GROUP BY 1, 2),
c AS (SELECT grp, pair, avg(rgb_x) AS cx, avg(rgb_y) AS cy FROM points GROUP BY 1, 2), r AS (SELECT grp, (max(cx) - min(cx)) / 4 AS sx, (max(cy) - min(cy)) / 2 AS sy, max(area) / min(area) AS q FROM c JOIN e USING (grp, pair) GROUP BY 1)
SELECT grp, round(sx, 6) AS span_x, round(sy, 6) AS span_y, round(q, 6) AS area_ratio, greatest(sx, sy) < 0.05 AND q < 1.05 AS warning FROM r""")
def x16_diversity(spark, sf_dir):
    return r6(geometry.diversity(I.points(spark, sf_dir), ["grp"], "pair", 4.0, 2.0), "span_x", "span_y", "area_ratio")


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'same' WHEN 1 THEN 'reversed' WHEN 2 THEN 'rows_reversed' ELSE 'columns_reversed' END AS turn, CAST(12 AS BIGINT) AS corners FROM part WHERE p_partkey % 4 < 4")
def x9_order_corners(spark, sf_dir):
    """Boards of 4 x 3 corners, one for each part, whose second camera lists them in one of the four orders."""
    i = F.col("idx")
    p = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("idx"), F.col("p_size").cast("double").alias("s"))
    at = F.when(F.col("p_partkey") % 4 == 0, i).when(F.col("p_partkey") % 4 == 1, 11 - i).when(F.col("p_partkey") % 4 == 2, F.expr("(2 - idx div 4) * 4 + idx % 4")).otherwise(F.expr("(idx div 4) * 4 + 3 - idx % 4"))
    x = lambda k: (k % 4) * 20.0 + 100
    y = lambda k: F.floor(k / 4) * 20.0 + 50
    rows = p.withColumn("at", at).select("p_partkey", "idx", x(i).alias("ir_x"), y(i).alias("ir_y"), (x(F.col("at")) + F.col("s") + 0.001 * x(F.col("at")) * y(F.col("at"))).alias("rgb_x"), (y(F.col("at")) * 1.1 + 0.002 * x(F.col("at"))).alias("rgb_y"))
    return geometry.order_corners(rows, ["p_partkey"], 4, 3).groupBy("p_partkey").agg(F.min("turn").alias("turn"), F.count("*").alias("corners"))
