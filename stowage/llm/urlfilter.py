"""URL rules by a sort-merge range join, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Ends each label of a reversed host; ESCAPE stands before these two where a label itself has them.
LABEL_END, ESCAPE = "\x01", "\x02"


def host_of(url):
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased.
    Empty if the url is null or has no `://`."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url):
    """After the host up to `?`, `#` or the end; empty as for the host."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def reversed_key(host):
    """`a.example.org` as org|example|a|, in UTF-8, with a mark after each
    label: a host's subdomains are the keys that start with its own."""
    plain = F.replace(F.replace(host, F.lit(ESCAPE), F.lit(ESCAPE * 2)), F.lit(LABEL_END), F.lit(ESCAPE + LABEL_END))
    return F.concat(F.array_join(F.reverse(F.split(plain, r"\.")), LABEL_END), F.lit(LABEL_END)).cast("binary")


def after(key):
    """Sorts after all keys that start with `key` and before all others that
    sort after it: no UTF-8 text has the byte."""
    return F.concat(key, F.lit(b"\xff"))


def swept(rows: DataFrame, order: list[str], state: str) -> DataFrame:
    """`rows` with `state`, where it is null, taken from the last row before,
    in the `order`, that has one.

    Rows are dealt by ranges of the order, so that no task gets more than its
    share however often a key occurs (the order's last column must tell rows
    apart), and each range starts from the state that the ranges before it
    ended with: a row for each range is all that passes between them.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(rows.repartitionByRange(n, *order).withColumn("range", F.spark_partition_id()), "sweep")
    ends = dealt.groupBy("range").agg(F.max_by(state, F.when(F.col(state).isNotNull(), F.struct(*order))).alias("ended"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    begun = ends.select("range", F.last("ended", ignorenulls=True).over(before).alias("begun"))
    along = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = F.coalesce(F.last(state, ignorenulls=True).over(along), "begun")
    return dealt.join(F.broadcast(begun), "range").withColumn(state, found).drop("range", "begun")  # as many rows as partitions


def host_events(rules: DataFrame) -> DataFrame:
    """(key, stack): from `key` on, `stack` holds the active rule hosts.

    A rule host opens an interval at its key and closes it after the last key
    that starts so; intervals nest or are disjoint. A stack is a host and the
    rule hosts that enclose it, at most as many as it has labels, found by an
    equi-join of its suffixes. At a close, the enclosing host's stack returns.
    """
    own = rules.select("host").distinct()
    n = F.size(F.split("host", r"\."))
    suffixes = own.withColumn("n", F.explode(F.sequence(F.lit(1), n))).select("host", F.expr("substring_index(host, '.', -n)").alias("outer"))
    stacks = suffixes.join(own.withColumnRenamed("host", "outer"), "outer").groupBy("host").agg(F.collect_list("outer").alias("stack"))
    key = reversed_key(F.col("host"))
    opens = stacks.select(key.alias("key"), "stack")
    closes = stacks.select(after(key).alias("key"), F.filter("stack", lambda h: h != F.col("host")).alias("stack"))
    return opens.union(closes)


def path_events(rules: DataFrame) -> DataFrame:
    """(within, key, top): from `key` on, `top` is the innermost active rule
    of the host `within`, with nulls in it where none is. A rule's path opens
    an interval likewise; at its close the longest rule path that is a part of
    it returns."""
    rule = rules.select("host", "path", F.struct("host", "path", "verdict").alias("rule"))
    parts = rules.select("host", "path", F.explode(F.sequence(F.lit(0), F.length("path"))).alias("n"))
    parts = parts.where(F.col("n") < F.length("path")).select("host", "path", F.col("path").substr(F.lit(1), F.col("n")).alias("part"))
    outer = rule.select("host", F.col("path").alias("part"), F.col("rule").alias("outer"))
    outer = parts.join(outer, ["host", "part"]).groupBy("host", "path").agg(F.max_by("outer", F.length("part")).alias("outer"))
    none = F.lit(None).cast("string")
    none = F.struct(none.alias("host"), none.alias("path"), none.alias("verdict"))
    key = F.col("path").cast("binary")
    opens = rule.select(F.col("host").alias("within"), key.alias("key"), F.col("rule").alias("top"))
    closes = rule.join(outer, ["host", "path"], "left").select(F.col("host").alias("within"), after(key).alias("key"), F.coalesce("outer", none).alias("top"))
    return opens.union(closes)


def judge_urls(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict): the rule that fits each url.

    rules: host, path, verdict (`allow` or `block`). A rule fits its host and
    all subdomains if the url's path starts with the rule's. Of several the
    one of the longest host and path together wins, on a tie the one of the
    longer host, then `block`. No rule: null and `default`.

    Two sorted sweeps. Urls and the ends of the rule hosts' intervals are
    sorted by the reversed host: each url gets the stack of rule hosts that
    enclose it. For each of these, its path and the ends of that host's path
    intervals are sorted: it gets the innermost rule, the longest that fits
    there. (A rule's path holds for all subdomains, whose keys lie apart, so
    that host and path together are no single interval.) Rules are dealt like
    urls, none is copied to all tasks.

    A null url, or one without `://`, has an empty host and path. Urls are
    read whole, however long. Repeated rows and null ids stay as they are. An
    empty table gives no rows, an empty rule table the default for all. Rules
    with a null in a column or an empty host fit nothing; of equal ones with
    both verdicts `block` holds. Other columns are not read.
    """
    rules = rules.select("host", "path", "verdict").dropna().where("host <> ''")
    rules = rules.groupBy("host", "path").agg(F.max(F.struct((F.col("verdict") == "block").alias("b"), "verdict")).alias("v")).select("host", "path", "v.verdict")
    url = F.col(url_col).cast("string")
    urls = pages.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    hosts = host_events(rules)
    asked = urls.select(reversed_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), F.lit(None).cast("array<string>").alias("stack"), "rid", "page_id", "host", "path")
    ends = hosts.select("key", F.lit(0).alias("kind"), "stack", *(F.lit(None).cast(kind).alias(c) for c, kind in urls.dtypes))
    urls = swept(ends.union(asked), ["key", "kind", "rid"], "stack").where("kind = 1").select("rid", "page_id", "host", "path", "stack")

    paths = path_events(rules)
    asked = urls.select(F.explode_outer("stack").alias("within"), F.col("path").cast("binary").alias("key"), F.lit(1).alias("kind"), F.lit(None).cast(paths.schema["top"].dataType).alias("top"), "rid", "page_id", "host", "path")
    ends = paths.select("within", "key", F.lit(0).alias("kind"), "top", *(F.lit(None).cast(kind).alias(c) for c, kind in urls.drop("stack").dtypes))
    probed = swept(ends.union(asked), ["within", "key", "kind", "rid"], "top").where("kind = 1")
    rank = F.struct(
        (F.length("top.host") + F.length("top.path")).alias("n"), F.length("top.host").alias("h"), (F.col("top.verdict") == "block").alias("b"),
        F.col("top.host").alias("host"), F.col("top.path").alias("path"), F.col("top.verdict").alias("verdict"),
    )
    fits = F.col("within").isNotNull() & F.col("top.host").isNotNull()
    best = probed.groupBy("rid", "page_id", "host", "path").agg(F.max(F.when(fits, rank)).alias("best"))
    rule = F.concat(F.col("best.host"), F.col("best.path"))
    return best.select("page_id", "host", "path", rule.alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
