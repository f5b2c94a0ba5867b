"""Decisions: modes, plans, backends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats
from ..plans import decisions
from .common import Registry, pick, sql_known, sql_pick, table

R = Registry()
OUTPUTS = [None, "out.tar.gz", "out", "out.ZIP"]


def bit(name: str, k: int):
    return F.shiftright(F.col(name), k) % 2 == 1


_O = sql_pick(OUTPUTS, "event_id")


@R.add(f"""
WITH f AS (SELECT event_id, event_id >> 2 & 1 = 1 AS c, event_id >> 3 & 1 = 1 AS x, event_id >> 4 & 1 = 1 AS a, event_id >> 5 & 1 = 1 AS r, event_id >> 6 & 1 = 1 AS d, {_O} AS o FROM events),
m AS (SELECT *, CASE WHEN c THEN CASE WHEN a OR coalesce({sql_known("o")}, false) THEN 'compress' END WHEN x THEN 'extract'
  WHEN coalesce({sql_known("o")}, false) OR (a AND o IS NOT NULL) THEN 'compress' WHEN r AND (d OR a) THEN 'extract' END AS mode FROM f)
SELECT event_id, mode, CASE WHEN mode IS NULL THEN CASE WHEN c THEN 'no-target' WHEN r THEN 'unrecognised-input' ELSE 'unreadable-input' END END AS error,
       CASE WHEN mode IS NULL THEN 'usage' END AS error_kind FROM m""")
def q_infer_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = "event_id"
    m = decisions.infer_mode(bit(i, 2), bit(i, 3), bit(i, 4), pick(OUTPUTS, F.col(i)), bit(i, 5), bit(i, 6))
    t = table(spark, sf_dir, "events").select(i, m.alias("m"))
    return t.select(i, "m.mode", "m.error", decisions.error_kind(F.col("m.error")).alias("error_kind"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that exist: for each nation a folder, with numbered names."""
    c = table(spark, sf_dir, "customer")
    k = (F.col("c_custkey") % 9).cast("string")
    name = F.concat(F.lower("c_mktsegment"), F.when(k == "1", F.lit("")).otherwise(F.concat(F.lit(" "), k)), pick([".zip", ".tar.zst", ".zst", ""], F.col("c_custkey") % 7))
    return c.select(F.col("c_nationkey").cast("string").alias("dir"), name.alias("name"))


_K = "CAST(c_custkey % 9 AS VARCHAR)"
SQL_FILES = f"""files AS (SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS dir, lower(c_mktsegment) || CASE WHEN {_K} = '1' THEN '' ELSE ' ' || {_K} END
  || {sql_pick([".zip", ".tar.zst", ".zst", ""], "(c_custkey % 7)")} AS name FROM customer)"""


def sql_unique(requests: str) -> str:
    """requests: id, dir, stem, ext."""
    return f"""{SQL_FILES}, q AS ({requests}), c AS (
  SELECT id, stem || CASE WHEN k > 1 THEN ' ' || k ELSE '' END || ext AS name, k, dir FROM q, range(1, 12) r(k)
), u AS (
  SELECT id, min_by(c.name, c.k) AS name FROM c LEFT JOIN files f ON f.dir = c.dir AND f.name = c.name WHERE f.name IS NULL GROUP BY id
)"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("string").alias("dir"), F.lower("c_mktsegment").alias("stem"))


@R.add(f"""
WITH {sql_unique("SELECT c_custkey AS id, CAST(c_nationkey AS VARCHAR) AS dir, lower(c_mktsegment) AS stem, " + sql_pick([".zip", "", ".tar.zst"], "c_custkey") + " AS ext FROM customer")}
SELECT id, name FROM u""")
def q_unique_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = requests(spark, sf_dir).withColumn("ext", pick([".zip", "", ".tar.zst"], F.col("id")))
    return decisions.unique_names(asked, files(spark, sf_dir)).select("id", "name")


PREFERRED = [None, "zip", "zstd", "nope", "tar.gz"]
_BUNDLE = "(c_custkey % 4 > 1 OR c_custkey % 3 = 0)"
_FMT = f"CASE {sql_pick(PREFERRED, 'c_custkey')} WHEN 'zip' THEN 'zip' WHEN 'tar.gz' THEN 'tar.gz' ELSE CASE WHEN {_BUNDLE} THEN 'tar.zst' ELSE 'zstd' END END"
_EXT = f"CASE {_FMT} WHEN 'zstd' THEN '.zst' ELSE '.' || {_FMT} END"


@R.add(f"""
WITH {sql_unique(f"SELECT c_custkey AS id, CAST(c_nationkey AS VARCHAR) AS dir, CASE WHEN c_custkey % 4 <= 1 THEN lower(c_mktsegment) ELSE 'archive' END AS stem, {_EXT} AS ext FROM customer")}
SELECT id, {_FMT} AS format, name FROM u JOIN customer ON c_custkey = id""")
def q_plan_compress(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    asked = requests(spark, sf_dir).select(
        "id", "dir", F.col("stem").alias("first_name"), F.when(i % 4 <= 1, 1).otherwise(2).alias("n_inputs"), (i % 3 == 0).alias("first_is_dir"), pick(PREFERRED, i).alias("preferred")
    )
    return decisions.plan_compress(asked, files(spark, sf_dir)).select("id", "format", "name")


_ROOT = "CASE WHEN c_custkey % 5 = 0 THEN lower(c_mktsegment) WHEN c_custkey % 5 = 1 THEN 'readme' END"


@R.add(f"""
WITH {sql_unique("SELECT c_custkey AS id, CAST(c_nationkey AS VARCHAR) AS dir, lower(c_mktsegment) AS stem, '' AS ext FROM customer")},
s AS (SELECT c_custkey AS id, CAST(c_nationkey AS VARCHAR) AS dir, CASE WHEN c_custkey % 5 = 4 THEN lower(c_mktsegment) ELSE {_ROOT} END AS single FROM customer),
b AS (SELECT s.*, single IS NOT NULL AND f.name IS NULL AS beside FROM s LEFT JOIN files f ON f.dir = s.dir AND f.name = s.single)
SELECT id, CASE WHEN beside THEN b.dir ELSE b.dir || '/' || u.name END AS dest, CASE WHEN beside THEN single ELSE u.name END AS result FROM b JOIN u USING (id)""")
def q_plan_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    root = F.when(i % 5 == 0, F.col("stem")).when(i % 5 == 1, F.lit("readme"))
    n = F.when(i % 5 <= 1, 1).when(i % 5 == 4, None).otherwise(i % 5)
    asked = requests(spark, sf_dir).select("id", "dir", F.concat("stem", F.lit(".tar.gz")).alias("file_name"), n.alias("n_roots"), root.alias("root"))
    return decisions.plan_extract(asked, files(spark, sf_dir)).select("id", "dest", "result")


TEXTS = ["metal:0", "wgpu:a:b", "cpu", ":x", "x:", "AUTO", "required", "Off", "gpu", "enabled"]


@R.add(f"""
WITH t AS (SELECT event_id, {sql_pick(TEXTS, "event_id")} AS t FROM events)
SELECT event_id, CASE WHEN t IN ('metal:0', 'wgpu:a:b') THEN string_split(t, ':')[1] END AS provider_id, CASE WHEN t = 'metal:0' THEN '0' WHEN t = 'wgpu:a:b' THEN 'a:b' END AS device_id,
       CASE lower(t) WHEN 'cpu' THEN 'cpu' WHEN 'off' THEN 'cpu' WHEN 'auto' THEN 'auto' WHEN 'enabled' THEN 'auto' WHEN 'required' THEN 'required' WHEN 'gpu' THEN 'required' END AS preference
FROM t""")
def q_parse_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = pick(TEXTS, F.col("event_id"))
    rows = table(spark, sf_dir, "events").select("event_id", decisions.parse_target(t).alias("t"), decisions.parse_preference(t).alias("preference"))
    return rows.select("event_id", "t.provider_id", "t.device_id", "preference")


def capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as providers and nations as their devices, each with lz4 or
    zstd encoding at some levels."""
    n, k = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    return n.select(
        F.col("n_regionkey").cast("long").alias("registration"), k.cast("long").alias("ordinal"), F.concat(F.lit("p"), F.col("n_regionkey").cast("string")).alias("provider_id"),
        F.concat(F.lit("d"), k.cast("string")).alias("device_id"), F.when(k % 3 == 0, F.lit("zstd")).otherwise(F.lit("lz4")).alias("codec"),
        F.when(k % 2 == 0, F.lit("tar")).alias("container"), F.lit("encode").alias("direction"),
        F.when(k % 5 == 0, F.array(F.lit("fast"), F.lit("best"))).otherwise(F.array(F.lit("fast"))).alias("levels"),
        F.when(k % 4 == 0, F.lit("supported")).otherwise(F.lit("experimental")).alias("maturity"), F.lit(1 << 16).alias("block_size"),
    )


_CAPS = """caps AS (SELECT n_regionkey AS position, n_nationkey AS ordinal, 'p' || n_regionkey AS p, 'd' || n_nationkey AS d, CASE WHEN n_nationkey % 3 = 0 THEN 'zstd' ELSE 'lz4' END AS c_codec,
  CASE WHEN n_nationkey % 2 = 0 THEN 'tar' END AS c_container, CASE WHEN n_nationkey % 5 = 0 THEN ['fast', 'best'] ELSE ['fast'] END AS levels, n_nationkey % 4 > 0 AS experimental FROM nation)"""
_REQ = f"""r AS (SELECT event_id AS request_id, {sql_pick(["cpu", "auto", "required"], "event_id")} AS preference, CASE WHEN event_id % 5 = 0 THEN 'p' || (event_id // 5) % 7 END AS provider_id,
  CASE WHEN event_id % 5 = 0 THEN 'd' || (event_id // 5) % 26 END AS device_id, {sql_pick(["lz4", "zstd", "xz"], "(event_id // 2)")} AS codec, {sql_pick([None, "tar", "zip"], "(event_id // 3)")} AS container,
  {sql_pick(["encode", "encode", "decode"], "(event_id // 7)")} AS direction, {sql_pick([None, "fast", "best", "edge"], "(event_id // 11)")} AS level FROM events)"""
_AIM = "(r.provider_id IS NULL OR (p = r.provider_id AND d = r.device_id))"


@R.add(f"""
WITH {_CAPS}, {_REQ}, j AS (
  SELECT r.*, position, ordinal, p, d, experimental, codec = c_codec AND {_AIM} AS m1, codec = c_codec AND {_AIM} AND container IS NOT DISTINCT FROM c_container AS m2,
         codec = c_codec AND {_AIM} AND container IS NOT DISTINCT FROM c_container AND direction = 'encode' AS m3,
         codec = c_codec AND {_AIM} AND container IS NOT DISTINCT FROM c_container AND direction = 'encode' AND (level IS NULL OR list_contains(levels, level)) AS m4,
         p = r.provider_id AS kp, p = r.provider_id AND d = r.device_id AS kd FROM r CROSS JOIN caps
), g AS (
  SELECT request_id, any_value(preference) AS preference, any_value(provider_id) AS provider_id, bool_or(m1) AS m1, bool_or(m2) AS m2, bool_or(m3) AS m3, bool_or(m4) AS m4, bool_or(kp) AS kp, bool_or(kd) AS kd,
         min_by(p || ':' || d, position * 1000 + ordinal) FILTER (m4 AND (preference <> 'auto' OR NOT experimental)) AS found FROM j GROUP BY request_id)
SELECT request_id, CASE WHEN preference = 'cpu' THEN 'cpu' WHEN found IS NOT NULL THEN found WHEN preference = 'auto' THEN 'cpu' END AS backend,
       CASE WHEN preference = 'cpu' OR found IS NOT NULL THEN NULL WHEN provider_id IS NOT NULL AND NOT kp THEN 'provider' WHEN provider_id IS NOT NULL AND NOT kd THEN 'device'
            WHEN NOT m1 THEN 'codec' WHEN NOT m2 THEN 'format' WHEN NOT m3 THEN 'direction' WHEN NOT m4 THEN 'level' ELSE 'experimental' END AS reason
FROM g""")
def q_capability_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.match_backends(asked_backends(spark, sf_dir), capabilities(spark, sf_dir)).select("request_id", "backend", "reason")


def asked_backends(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    n = lambda k: F.floor(i / k)
    return table(spark, sf_dir, "events").select(
        i.alias("request_id"), pick(["cpu", "auto", "required"], i).alias("preference"),
        F.when(i % 5 == 0, F.concat(F.lit("p"), (n(5) % 7).cast("string"))).alias("provider_id"), F.when(i % 5 == 0, F.concat(F.lit("d"), (n(5) % 26).cast("string"))).alias("device_id"),
        pick(["lz4", "zstd", "xz"], n(2)).alias("codec"), pick([None, "tar", "zip"], n(3)).alias("container"), pick(["encode", "encode", "decode"], n(7)).alias("direction"),
        pick([None, "fast", "best", "edge"], n(11)).alias("level"),
    )


_WHAT = "CASE WHEN container IS NULL THEN codec ELSE container || '.' || CASE codec WHEN 'zstd' THEN 'zst' ELSE codec END END || ' ' || direction || 'ing'"
_LEVELS = f"""(SELECT array_to_string(list_sort(list_distinct(flatten(list(list_transform(levels, lambda x: upper(x[1]) || x[2:]))))), ' or ') FROM caps
  WHERE c_codec = g.codec AND g.container IS NOT DISTINCT FROM c_container AND g.direction = 'encod' AND (g.provider_id IS NULL OR (p = g.provider_id AND d = g.device_id)))"""


@R.add(f"""
WITH {_CAPS}, {_REQ}, j AS (
  SELECT r.*, experimental, codec = c_codec AND {_AIM} AS m1, codec = c_codec AND {_AIM} AND container IS NOT DISTINCT FROM c_container AS m2,
         codec = c_codec AND {_AIM} AND container IS NOT DISTINCT FROM c_container AND direction = 'encode' AS m3,
         codec = c_codec AND {_AIM} AND container IS NOT DISTINCT FROM c_container AND direction = 'encode' AND (level IS NULL OR list_contains(levels, level)) AS m4,
         p = r.provider_id AND d = r.device_id AS kd FROM r CROSS JOIN caps WHERE preference = 'required'
), g AS (
  SELECT request_id, any_value(provider_id) AS provider_id, any_value(device_id) AS device_id, any_value(codec) AS codec, any_value(container) AS container,
         left(any_value(direction), 5) AS direction, any_value(level) AS level, bool_or(m1) AS m1, bool_or(m2) AS m2, bool_or(m3) AS m3, bool_or(m4) AS m4, bool_or(kd) AS kd
  FROM j GROUP BY request_id
), m AS (
  SELECT request_id, m1 AND m2 AND m3 AS by_level, NOT kd AS unknown, provider_id || ':' || device_id AS target, {_WHAT.replace("direction", "g.direction")} AS what,
         CASE WHEN level IS NULL THEN '' ELSE ' at ' || upper(level[1]) || level[2:] || ' level' END AS at_level, {_LEVELS} AS levels FROM g WHERE NOT m4
)
SELECT request_id, CASE
  WHEN target IS NULL AND by_level THEN 'no compatible hardware accelerator is available for ' || what || at_level || '; hardware supports ' || what || ' only at ' || levels || ' level'
  WHEN target IS NULL THEN 'no compatible hardware accelerator is available for ' || what || at_level
  WHEN unknown THEN 'requested accelerator `' || target || '` was not found'
  WHEN by_level THEN 'requested accelerator `' || target || '` supports ' || what || ' only at ' || levels || ' level'
  ELSE 'requested accelerator `' || target || '` does not support ' || what END AS message
FROM m""")
def q_backend_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why requests that require a device get none."""
    caps = capabilities(spark, sf_dir)
    failed = decisions.match_backends(asked_backends(spark, sf_dir).where("preference = 'required'"), caps).where("reason IS NOT NULL")
    levels = decisions.missed_levels(caps).select(*(F.col(c).alias(f"m_{c}") for c in ("codec", "container", "direction", "provider_id", "device_id")), "levels")
    same = [F.col(c).eqNullSafe(F.col(f"m_{c}")) for c in ("codec", "container", "direction", "provider_id", "device_id")]
    target = F.concat_ws(":", "provider_id", "device_id")
    fmt = formats.format_name(formats.make_format(F.col("container"), F.col("codec")))
    message = decisions.backend_message(F.col("reason"), F.when(target != "", target), fmt, F.col("direction"), F.col("level"), F.col("levels"))
    return failed.join(levels, same, "left").select("request_id", message.alias("message"))


@R.add("""
SELECT 'p' || n_regionkey AS provider_id, 'd' || n_nationkey AS device_id,
  'capability: ' || CASE WHEN n_nationkey % 2 = 0 THEN 'tar.' || CASE WHEN n_nationkey % 3 = 0 THEN 'zst' ELSE 'lz4' END WHEN n_nationkey % 3 = 0 THEN 'zstd' ELSE 'lz4' END || ' encoding levels=fast'
  || CASE WHEN n_nationkey % 5 = 0 THEN ',best' ELSE '' END || ' block=65536 maturity=' || CASE WHEN n_nationkey % 4 = 0 THEN 'Supported' ELSE 'Experimental' END AS line
FROM nation""")
def q_hardware_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.inventory(capabilities(spark, sf_dir)).select("provider_id", "device_id", "line")
