"""Registered queries and their SQL.

No table of the test data holds a bitstream. The queries of this module check closed-form
arithmetic and relational patterns with unrelated columns as arguments: they say that both
sides compute the same formula (tests hold the decoder's own versions to the same functions).
Queries on bitstreams stand in bitstreams.py.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import arith
from strandlake.kernel import tables
from strandlake.operators import framestate
from strandlake.plans import bitstreams

FLAGSHIP = "dpb_slots"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def image_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_orderkey") % 8192 + 1).cast("int").alias("w"), (F.col("l_partkey") % 4320 + 1).cast("int").alias("h"))
    sizes = arith.image_size(F.col("w"), F.col("h"))
    return t.select("l_orderkey", "l_linenumber", *(c.alias(n) for n, c in sizes.items()), (F.col("w").cast("long") * F.col("h") > arith.MAX_SAMPLES).alias("too_large"))


def tile_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 2048 + 1).cast("int").alias("mis"))
    t = t.withColumn("sbs", F.shiftright(F.col("mis") + 7, 3))
    t = t.select("p_partkey", "mis", arith.min_log2_tile_cols(F.col("sbs")).alias("least_log2"), arith.max_log2_tile_cols(F.col("sbs")).alias("most_log2"))
    t = t.withColumn("tile", F.explode(F.sequence(F.lit(0), F.pow(F.lit(2), F.col("most_log2")).cast("int"))))
    return t.select("p_partkey", "least_log2", "most_log2", "tile", arith.tile_offset(F.col("tile"), F.col("mis"), F.col("most_log2")).alias("first_mi"))


def clip_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("l_quantity").cast("int") * 7 - 100
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", arith.clip3(-50, 200, x).alias("clipped"), arith.round2(x, 0).alias("round0"), arith.round2(x, 3).alias("round3"))


def merge_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("ct0"), F.sum(F.when(F.col("l_returnflag") == "A", 1).otherwise(0)).alias("ct1")
    )
    pre = F.col("l_suppkey") % 255 + 1
    return t.select("l_suppkey", "ct0", "ct1", arith.merge_prob(pre, F.col("ct0"), F.col("ct1")).alias("prob"), arith.merge_prob(pre, F.col("ct0"), F.col("ct1"), 24, 112).alias("coef_prob"))


def counts_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of workers summed: partial sums per user, then their sum."""
    partial = _table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return partial.groupBy("event_type").agg(F.sum("n").alias("n"))


def qindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, "part")
    base, data = (F.col("p_partkey") % 256).cast("int"), F.col("p_size") * 11 - 255
    return t.select("p_partkey", arith.qindex(base, F.col("p_partkey") % 3 > 0, F.col("p_partkey") % 3 == 1, data).alias("qindex"))


def lf_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, "lineitem")
    out = arith.filter_strength((F.col("l_partkey") % 64).cast("int"), F.col("l_linenumber"), (8 + 2 * (F.col("l_orderkey") % 3)).cast("int"))
    return t.select("l_orderkey", "l_linenumber", *(c.alias(n) for n, c in out.items()))


def lf_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 64).cast("int").alias("frame"))
    t = t.withColumn("segment", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumn("ref", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("mode", F.explode(F.sequence(F.lit(0), F.lit(1))))
    level = arith.clip3(0, 63, F.col("frame") + (F.col("segment") - 4) * 9)
    return t.select("p_partkey", "segment", "ref", "mode", arith.filter_level(F.col("frame"), level, F.col("ref"), F.col("ref") * -7 + 8, F.col("mode") * 5 - 3).alias("level"))


def mv_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, "lineitem")
    mv, mi = ((F.col("l_suppkey") * 97 + F.col("l_partkey")) % 20001 - 10000).cast("int"), (F.col("l_partkey") % 68).cast("int")
    return t.select("l_orderkey", "l_linenumber", arith.clamp_mv(mv, 1248, mi, F.col("l_linenumber"), F.lit(68)).alias("mv"))


def recenter(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, m = (F.col("p_partkey") % 254).cast("int"), (F.col("p_partkey") * 31 % 128).cast("int")
    return _table(spark, sf_dir, "part").select("p_partkey", arith.inv_recenter(v, m).alias("value"))


def compound_setup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = arith.compound_setup(*(F.expr(f"shiftright(cast(o_orderkey as int), {i}) & 1") for i in range(3)))
    return _table(spark, sf_dir, "orders").select("o_orderkey", *(c.alias(n) for n, c in out.items()))


def context_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return _table(spark, sf_dir, "orders").select("o_orderkey", arith.context_reset(k % 7 == 0, k % 5 == 0, F.expr("o_orderkey div 8 % 4")).alias("contexts"))


def segment_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, "part")
    # the previous map is a grid of 46 x 42 units; a unit that several rows fall on has the least of their segments
    cells = t.select(F.expr("cast(p_partkey div 42 % 46 as int)").alias("row"), (F.col("p_partkey") % 42).cast("int").alias("col"), (F.col("p_size") % 8).alias("segment"))
    cells = cells.groupBy("row", "col").agg(F.min("segment").alias("segment"))
    blocks = t.select(F.col("p_partkey").alias("block"), (F.col("p_partkey") * 7 % 38).cast("int").alias("row"), (F.col("p_partkey") * 11 % 38).cast("int").alias("col"), (F.col("p_size") % 8 + 1).alias("rows"), (F.col("p_size") % 5 + 1).alias("cols"))
    return framestate.segment_minimum(blocks, cells)


def last_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_type") == "click").alias("shown"))
    return framestate.last_shown(t, ["user_id"], "event_id", "shown").select("event_id", "keeps_pixels")


def dpb_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 256).alias("mask"))
    return framestate.reference_slots(t, "user_id", "event_id", "event_id", "mask").select("event_id", "slot", "held")


def color_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 5 == 0, F.col("event_type")).alias("config"))
    return framestate.carried(t, "user_id", ["event_id"], "config", F.lit("none"), "config_now").select("event_id", "config_now")


def gop_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 6 == 0).alias("key"))
    return framestate.group_of_pictures(t, "user_id", ["event_id"], "key").select("event_id", "gop_id")


def prev_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 3).alias("width"), (F.col("event_id") % 2).alias("height"), (F.col("event_type") != "click").alias("show_frame"), (F.col("event_id") % 7 == 0).alias("frame_is_intra"), (F.col("event_id") % 5 == 0).alias("error_resilient"))
    return framestate.uses_previous_motion(t, "user_id", ["event_id"]).select("event_id", "use_prev_mvs")


def mv_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ((F.col("l_partkey") * 13) % 301 - 150).cast("int").alias("a"), ((F.col("l_suppkey") * 17) % 401 - 200).cast("int").alias("b"))
    a, b = F.col("a"), F.col("b")
    context = arith.effective_context(a % 4 == 0, b % 3 == 0, F.col("l_linenumber") % 4)
    return t.select("l_orderkey", "l_linenumber", arith.scaled_mv(a, a % 2, b % 2).alias("scaled"), arith.precise_mv(a, b).alias("precise"), arith.mean_mv(a + b, 2).alias("mean2"), arith.mean_mv(a + b, 4).alias("mean4"), context.alias("context"))


def dequant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantizer steps by lookup; the table has 768 rows whatever the data, and Spark sees its size."""
    t = _table(spark, sf_dir, "part")
    table = spark.createDataFrame(_steps(), "depth int, q int, dc int, ac int")
    t = t.select("p_partkey", (F.col("p_partkey") % 3).cast("int").alias("depth"), arith.clip3(0, 255, (F.col("p_partkey") * 7 % 300 - 20).cast("int")).alias("q"))
    return t.join(table, ["depth", "q"]).select("p_partkey", "q", "dc", "ac")


def _steps() -> list[tuple[int, int, int, int]]:
    """The format's quantizer steps: depth (8, 10, 12 bits), index, step of the first and of the other coefficients."""
    steps = tables.load(None)
    return [(d, i, steps.dc_quant[d][i], steps.ac_quant[d][i]) for d in range(3) for i in range(256)]


def dequant_sql() -> str:
    return f"""
        WITH steps(d, i, dc, ac) AS (VALUES {", ".join(map(str, _steps()))}),
        t AS (SELECT p_partkey, (p_partkey % 3)::INT AS d, greatest(0, least(255, (p_partkey * 7 % 300 - 20)::INT)) AS q FROM part)
        SELECT p_partkey, q, dc, ac FROM t JOIN steps ON steps.d = t.d AND i = q"""


def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("digest"))


def bt601(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, u, v = (F.col("l_orderkey") % 256).cast("int"), (F.col("l_partkey") % 256).cast("int"), (F.col("l_suppkey") % 256).cast("int")
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(c.alias(n) for n, c in arith.yuv_to_rgb(y, u, v).items()))


_CLIP = "greatest(0, least(63, {}))"
SQL = {
    "image_size": """
        SELECT l_orderkey, l_linenumber, (w + 7) >> 3 AS mi_cols, (h + 7) >> 3 AS mi_rows, (((w + 7) >> 3) + 7) >> 3 AS sb64_cols, (((h + 7) >> 3) + 7) >> 3 AS sb64_rows,
               w::BIGINT * h > 134217728 AS too_large
        FROM (SELECT l_orderkey, l_linenumber, (l_orderkey % 8192 + 1)::INT AS w, (l_partkey % 4320 + 1)::INT AS h FROM lineitem)""",
    "tile_offsets": """
        WITH t AS (SELECT p_partkey, (p_partkey % 2048 + 1)::INT AS mis, ((p_partkey % 2048 + 1)::INT + 7) >> 3 AS sbs FROM part),
        l AS (SELECT *, (SELECT min(k) FROM range(0, 8) r(k) WHERE (64 << k) >= sbs)::INT AS least_log2, coalesce((SELECT max(k) FROM range(0, 8) r(k) WHERE (sbs >> k) >= 4), 0)::INT AS most_log2 FROM t)
        SELECT p_partkey, least_log2, most_log2, tile::INT AS tile, least(((tile * sbs) >> most_log2) << 3, mis)::BIGINT AS first_mi
        FROM (SELECT *, unnest(range(0, (1 << most_log2) + 1)) AS tile FROM l)""",
    "clip_round": """
        SELECT l_orderkey, l_linenumber, greatest(-50, least(200, x)) AS clipped, x AS round0, (x + 4) >> 3 AS round3
        FROM (SELECT l_orderkey, l_linenumber, l_quantity::INT * 7 - 100 AS x FROM lineitem)""",
    "merge_prob": """
        WITH t AS (SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R') AS ct0, count(*) FILTER (WHERE l_returnflag = 'A') AS ct1, l_suppkey % 255 + 1 AS pre FROM lineitem GROUP BY l_suppkey),
        s AS (SELECT *, CASE WHEN ct0 + ct1 = 0 THEN 128 ELSE greatest(1, least(255, (ct0 * 256 + ((ct0 + ct1) >> 1)) // (ct0 + ct1))) END AS seen, 128 * least(ct0 + ct1, 20) // 20 AS a, 112 * least(ct0 + ct1, 24) // 24 AS b FROM t)
        SELECT l_suppkey, ct0, ct1, (pre * (256 - a) + seen * a + 128) >> 8 AS prob, (pre * (256 - b) + seen * b + 128) >> 8 AS coef_prob FROM s""",
    "counts_merge": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
    "qindex": """
        SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN base WHEN 1 THEN greatest(0, least(255, data)) ELSE greatest(0, least(255, base + data)) END AS qindex
        FROM (SELECT p_partkey, (p_partkey % 256)::INT AS base, p_size * 11 - 255 AS data FROM part)""",
    "lf_strength": """
        WITH t AS (SELECT l_orderkey, l_linenumber, (l_partkey % 64)::INT AS lvl, l_linenumber AS sharp, (2 * (l_orderkey % 3))::INT AS depth FROM lineitem),
        s AS (SELECT *, lvl >> (CASE WHEN sharp > 4 THEN 2 WHEN sharp > 0 THEN 1 ELSE 0 END) AS scaled FROM t),
        m AS (SELECT *, CASE WHEN sharp > 0 THEN greatest(1, least(9 - sharp, scaled)) ELSE greatest(1, scaled) END AS l FROM s)
        SELECT l_orderkey, l_linenumber, l << depth AS lim, (2 * (lvl + 2) + l) << depth AS blimit, (lvl >> 4) << depth AS thresh FROM m""",
    "lf_levels": f"""
        WITH t AS (SELECT p_partkey, (p_partkey % 64)::INT AS frame FROM part),
        g AS (SELECT p_partkey, frame, segment::INT AS segment, ref::INT AS ref, mode::INT AS mode FROM t, range(0, 8) a(segment), range(0, 4) b(ref), range(0, 2) c(mode))
        SELECT p_partkey, segment, ref, mode, {_CLIP.format(_CLIP.format("frame + (segment - 4) * 9") + " + (8 - 7 * ref) * (1 << (frame >> 5)) + CASE WHEN ref = 0 THEN 0 ELSE (5 * mode - 3) * (1 << (frame >> 5)) END")} AS level FROM g""",
    "mv_clamp": """
        SELECT l_orderkey, l_linenumber, greatest(-(mi * 64) - 1248, least((68 - l_linenumber - mi) * 64 + 1248, mv)) AS mv
        FROM (SELECT l_orderkey, l_linenumber, ((l_suppkey * 97 + l_partkey) % 20001 - 10000)::INT AS mv, (l_partkey % 68)::INT AS mi FROM lineitem)""",
    "recenter": """
        SELECT p_partkey, CASE WHEN v > 2 * m THEN v WHEN v % 2 = 1 THEN m - ((v + 1) >> 1) ELSE m + (v >> 1) END AS value
        FROM (SELECT p_partkey, (p_partkey % 254)::INT AS v, (p_partkey * 31 % 128)::INT AS m FROM part)""",
    "compound_setup": """
        SELECT o_orderkey, CASE WHEN a = b THEN 3 WHEN a = c THEN 2 ELSE 1 END AS fixed_ref, CASE WHEN a = b OR a = c THEN 1 ELSE 2 END AS var_ref0, CASE WHEN a = b THEN 2 ELSE 3 END AS var_ref1
        FROM (SELECT o_orderkey, o_orderkey & 1 AS a, (o_orderkey >> 1) & 1 AS b, (o_orderkey >> 2) & 1 AS c FROM orders)""",
    "context_reset": """
        SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 OR o_orderkey // 8 % 4 = 3 THEN 'all' WHEN o_orderkey // 8 % 4 = 2 THEN 'slot' ELSE 'none' END AS contexts FROM orders""",
    "segment_min": """
        WITH c AS (SELECT p_partkey // 42 % 46 AS r, p_partkey % 42 AS c, min(p_size % 8) AS segment FROM part GROUP BY ALL),
        b AS (SELECT p_partkey AS block, p_partkey * 7 % 38 AS br, p_partkey * 11 % 38 AS bc, p_size % 8 + 1 AS nr, p_size % 5 + 1 AS nc FROM part)
        SELECT block, min(segment) AS segment FROM b JOIN c ON r >= br AND r < br + nr AND c >= bc AND c < bc + nc GROUP BY block""",
    "last_shown": """
        SELECT event_id, coalesce(event_id = max(event_id) FILTER (WHERE event_type = 'click') OVER (PARTITION BY user_id), false) AS keeps_pixels FROM events""",
    "dpb_slots": """
        WITH s AS (SELECT user_id, event_id, slot::INT AS slot, CASE WHEN (event_id % 256 >> slot) & 1 = 1 THEN event_id END AS w FROM events, range(0, 8) r(slot))
        SELECT event_id, slot, last_value(w IGNORE NULLS) OVER (PARTITION BY user_id, slot ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM s""",
    "color_carry": """
        SELECT event_id, coalesce(last_value(CASE WHEN event_id % 5 = 0 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 'none') AS config_now FROM events""",
    "gop_ids": "SELECT event_id, (sum(CASE WHEN event_id % 6 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS gop_id FROM events",
    "prev_motion": """
        SELECT event_id, coalesce(event_id % 7 <> 0 AND event_id % 5 <> 0 AND lag(event_id % 3) OVER w = event_id % 3 AND lag(event_id % 2) OVER w = event_id % 2 AND lag(event_type <> 'click') OVER w, false) AS use_prev_mvs
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""",
    "mv_tools": """
        SELECT l_orderkey, l_linenumber, CASE WHEN a % 2 <> b % 2 THEN -a ELSE a END AS scaled, (abs(a) >> 3) < 8 AND (abs(b) >> 3) < 8 AS precise,
               CASE WHEN a + b < 0 THEN (a + b - 1) // 2 ELSE (a + b + 1) // 2 END AS mean2, CASE WHEN a + b < 0 THEN (a + b - 2) // 4 ELSE (a + b + 2) // 4 END AS mean4,
               CASE WHEN a % 4 = 0 OR b % 3 = 0 THEN 0 ELSE l_linenumber % 4 END AS context
        FROM (SELECT l_orderkey, l_linenumber, (l_partkey * 13 % 301 - 150)::INT AS a, (l_suppkey * 17 % 401 - 200)::INT AS b FROM lineitem)""",
    "digest": "SELECT doc_id, md5(text) AS digest FROM documents",
    "bt601": """
        WITH t AS (SELECT l_orderkey, l_linenumber, 1.164::DOUBLE * ((l_orderkey % 256)::INT - 16) AS c, (l_partkey % 256)::INT - 128 AS d, (l_suppkey % 256)::INT - 128 AS e FROM lineitem)
        SELECT l_orderkey, l_linenumber, greatest(0, least(255, floor(c + 1.596::DOUBLE * e + 0.5::DOUBLE)))::INT AS r,
               greatest(0, least(255, floor(c - 0.392::DOUBLE * d - 0.813::DOUBLE * e + 0.5::DOUBLE)))::INT AS g, greatest(0, least(255, floor(c + 2.017::DOUBLE * d + 0.5::DOUBLE)))::INT AS b FROM t""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in [*SQL, "dequant"]} | bitstreams.QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL | {"dequant": dequant_sql()} | bitstreams.sql()
