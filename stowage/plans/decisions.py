"""Decision tables: what a request means, where its result goes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import formats, paths


def infer_mode(compress_flag: Column, extract_flag: Column, has_algo: Column, output: Column, readable: Column, detects: Column) -> Column:
    """struct<mode, error>: `compress` or `extract`, from the flags, then from
    what the output's name says, then from what the input is. error names the
    rule that leaves it open: `no-target` (told to compress, not into what),
    `unrecognised-input`, `unreadable-input`."""
    suffix = formats.format_of_name(output).isNotNull()
    mode = (
        F.when(compress_flag, F.when(has_algo | suffix, F.lit("compress")))
        .when(extract_flag, F.lit("extract"))
        .when(suffix | (has_algo & output.isNotNull()), F.lit("compress"))
        .when(readable & (detects | has_algo), F.lit("extract"))
    )
    error = F.when(compress_flag, F.lit("no-target")).when(readable, F.lit("unrecognised-input")).otherwise(F.lit("unreadable-input"))
    return F.struct(mode.alias("mode"), F.when(mode.isNull(), error).alias("error"))


def unique_names(requests: DataFrame, existing: DataFrame) -> DataFrame:
    """`requests` (dir, stem, ext, ...) and `name`: `stem` and `ext`, or with
    the first number from 2 that makes a name that `existing` (dir, name)
    doesn't have.

    An existing name is read as the names it could take away: itself, and, if
    it ends in a number, that number of its stem. Both meet the requests by
    equality. Of a request's taken numbers in order, those that equal their
    place are an unbroken run from 1; the next number is free.
    """
    known = existing.select("dir", "name").distinct()
    asked = requests.select("dir", "stem", "ext").distinct()
    exts = asked.select("dir", "ext").distinct()
    cut = known.join(exts, "dir").where(F.endswith("name", F.col("ext"))).select("dir", "ext", F.left("name", F.length("name") - F.length("ext")).alias("body"))
    number = F.regexp_extract("body", "(?s)^.* ([1-9][0-9]{0,8})$", 1)
    taken = cut.select("dir", "ext", F.col("body").alias("stem"), F.lit(1).alias("k")).union(
        cut.where(number != "").select("dir", "ext", F.left("body", F.length("body") - F.length(number) - 1).alias("stem"), number.cast("int").alias("k")).where("k > 1")
    )
    used = taken.join(asked, ["dir", "stem", "ext"], "left_semi").distinct()
    place = F.row_number().over(Window.partitionBy("dir", "stem", "ext").orderBy("k"))
    run = used.withColumn("place", place).groupBy("dir", "stem", "ext").agg((F.count_if(F.col("k") == F.col("place")) + 1).alias("free"))
    out = requests.join(run, ["dir", "stem", "ext"], "left")
    k = F.coalesce("free", F.lit(1))
    return out.withColumn("name", F.concat("stem", F.when(k > 1, F.concat(F.lit(" "), k.cast("string"))).otherwise(F.lit("")), "ext")).drop("free")


def plan_compress(requests: DataFrame, existing: DataFrame) -> DataFrame:
    """`requests` (dir, first_name, n_inputs, first_is_dir, preferred, ...)
    with format and the new archive's `name`: zstd for a file, tar.zst for a
    folder or several inputs, or the preferred format, over a tar if need be."""
    bundle = (F.col("n_inputs") > 1) | F.col("first_is_dir")
    asked = formats.parse_format(F.col("preferred"))
    automatic = F.when(bundle, formats.make_format("tar", "zstd")).otherwise(formats.make_format(None, "zstd"))
    fmt = F.coalesce(formats.promoted(asked, bundle), automatic)
    stem = F.when(F.col("n_inputs") == 1, F.col("first_name")).otherwise(F.lit("archive"))
    r = requests.withColumn("fmt", fmt).withColumn("stem", stem).withColumn("ext", formats.extension(F.col("fmt")))
    return unique_names(r, existing).withColumn("format", formats.format_name(F.col("fmt"))).drop("fmt", "stem", "ext")


def plan_extract(requests: DataFrame, existing: DataFrame) -> DataFrame:
    """`requests` (dir, file_name, n_roots, root, ...) with dest and result: an
    archive's one root goes beside it unless its name is taken; all else goes
    into a new folder of the archive's name. A null n_roots is a single
    compressed file, whose root is its stem."""
    stem = paths.wrap_dir_name(F.col("file_name"))
    single = F.when(F.col("n_roots").isNull(), stem).when(F.col("n_roots") == 1, F.col("root"))
    r = requests.withColumn("single", single).withColumn("stem", stem).withColumn("ext", F.lit(""))
    there = existing.select("dir", F.col("name").alias("single"), F.lit(True).alias("is_taken")).distinct()
    r = unique_names(r.join(there, ["dir", "single"], "left"), existing)
    beside = F.col("single").isNotNull() & F.col("is_taken").isNull()
    r = r.withColumn("result", F.when(beside, F.col("single")).otherwise(F.col("name")))
    return r.withColumn("dest", F.when(beside, F.col("dir")).otherwise(F.concat_ws("/", "dir", "name"))).drop("single", "is_taken", "stem", "ext", "name")


def error_kind(error: Column) -> Column:
    """Whether an error is the caller's (`usage`, exit code 2) or the work's
    (`operation`, exit code 1); null for none."""
    usage = ["invalid-glob", "ambiguous", "invalid-sidecar", "no-target", "unrecognised-input", "unreadable-input", "duplicate-input"]
    return F.when(error.isin(*usage), F.lit("usage")).when(error.isNotNull(), F.lit("operation"))


# backends

PREFERENCES = {"cpu": "cpu", "off": "cpu", "disabled": "cpu", "auto": "auto", "on": "auto", "enabled": "auto", "required": "required", "require": "required", "gpu": "required"}


def parse_preference(text: Column) -> Column:
    return formats.looked_up(PREFERENCES, formats.ascii_lower(text))


def parse_target(text: Column) -> Column:
    """struct<provider_id, device_id> of `provider:device`, cut at the first
    colon; null if either is missing."""
    parts = F.split(text, ":", 2)
    both = (F.size(parts) == 2) & (parts[0] != "") & (F.try_element_at(parts, F.lit(2)) != "")
    return F.when(both, F.struct(parts[0].alias("provider_id"), F.try_element_at(parts, F.lit(2)).alias("device_id")))


def registered(capabilities: DataFrame) -> DataFrame:
    """Providers by order of registration: one registered again takes the
    place of the earlier one and its capabilities. capabilities:
    registration, provider_id, device_id, ..."""
    w = Window.partitionBy("provider_id")
    out = capabilities.withColumn("position", F.min("registration").over(w)).withColumn("latest", F.max("registration").over(w))
    return out.where("registration = latest").drop("latest")


def match_backends(requests: DataFrame, capabilities: DataFrame) -> DataFrame:
    """`requests` (request_id, preference, provider_id, device_id, codec,
    container, direction, level) with backend and reason.

    A request gets the first capability, by registration and ordinal, that
    fits it; null target columns fit any device, a null level any level.
    `auto` passes over experimental ones. Without one the backend is `cpu`
    (`auto`) or null (`required`), and reason says the first thing that no
    capability had: provider, device, codec, format, direction, level; or
    that all that fits is experimental. `cpu` needs none.

    What is asked for is decided once, whatever the number of requests that
    ask for it: distinct wishes meet the capabilities of their codec by
    equality, and the requests meet the wishes. Repeated requests stay.
    """
    wish = ["preference", "provider_id", "device_id", "codec", "container", "direction", "level"]
    wishes = requests.select(*wish).distinct()
    decided = decide(wishes, registered(capabilities)).select(*(F.col(c).alias(f"{c}_") for c in wish), "backend", "reason")
    same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in wish]
    return requests.join(decided, same, "left").drop(*(f"{c}_" for c in wish))


def decide(wishes: DataFrame, caps: DataFrame) -> DataFrame:
    """Distinct wishes, each with backend and reason; see `match_backends`."""
    caps = caps.select(
        "position", "ordinal", F.col("provider_id").alias("p"), F.col("device_id").alias("d"), F.col("codec").alias("c_codec"),
        F.col("container").alias("c_container"), F.col("direction").alias("c_direction"), "levels", "maturity",
    )
    has_target = F.col("provider_id").isNotNull()
    targets = caps.select(F.col("p").alias("provider_id"), F.col("d").alias("device_id"), F.lit(True).alias("known")).distinct()
    providers = targets.select("provider_id", F.lit(True).alias("known_provider")).distinct()
    r = wishes.join(targets, ["provider_id", "device_id"], "left").join(providers, "provider_id", "left")
    j = r.join(caps, r.codec == caps.c_codec, "left")
    aimed = F.coalesce(~has_target | ((F.col("p") == F.col("provider_id")) & (F.col("d") == F.col("device_id"))), F.lit(False)) & F.col("c_codec").isNotNull()
    fmt = aimed & F.col("container").eqNullSafe(F.col("c_container"))
    way = fmt & (F.col("direction") == F.col("c_direction"))
    lvl = way & (F.col("level").isNull() | F.array_contains("levels", F.col("level")))
    usable = lvl & ((F.col("preference") != "auto") | (F.col("maturity") != "experimental"))
    first = F.min(F.when(usable, F.struct("position", "ordinal", "p", "d")))
    g = j.groupBy(*r.columns).agg(
        first.alias("first"), *(F.max(F.coalesce(c, F.lit(False))).alias(n) for c, n in ((aimed, "m_codec"), (fmt, "m_format"), (way, "m_direction"), (lvl, "m_level")))
    )
    reason = (
        F.when((F.col("preference") == "cpu") | F.col("first").isNotNull(), None)
        .when(has_target & F.col("known_provider").isNull(), F.lit("provider"))
        .when(has_target & F.col("known").isNull(), F.lit("device"))
        .when(~F.col("m_codec"), F.lit("codec")).when(~F.col("m_format"), F.lit("format"))
        .when(~F.col("m_direction"), F.lit("direction")).when(~F.col("m_level"), F.lit("level")).otherwise(F.lit("experimental"))
    )
    found = F.concat_ws(":", F.col("first.p"), F.col("first.d"))
    backend = F.when(F.col("preference") == "cpu", F.lit("cpu")).when(F.col("first").isNotNull(), found).when(F.col("preference") == "auto", F.lit("cpu"))
    return g.select(*wishes.columns, backend.alias("backend"), reason.alias("reason"))


# The wording of the messages.


def direction_name(direction: Column) -> Column:
    return F.when(direction == "encode", F.lit("encoding")).when(direction == "decode", F.lit("decoding"))


def backend_message(reason: Column, target: Column, fmt: Column, direction: Column, level: Column, levels: Column) -> Column:
    """Why no device serves a request that requires one; null for no reason.

    target: `provider:device`, or null if any would do. levels: those of the
    capabilities that fit but for the level, as an array."""
    what = F.concat(fmt, F.lit(" "), direction_name(direction))
    none = F.concat(F.lit("no compatible hardware accelerator is available for "), what, F.coalesce(F.concat(F.lit(" at "), F.initcap(level), F.lit(" level")), F.lit("")))
    only = F.concat(F.lit("supports "), what, F.lit(" only at "), F.array_join(F.transform(levels, F.initcap), " or "), F.lit(" level"))
    asked = F.concat(F.lit("requested accelerator `"), target, F.lit("` "))
    by_level = reason == "level"
    return F.when(reason.isNull(), None).otherwise(
        F.when(target.isNull(), F.when(by_level, F.concat(none, F.lit("; hardware "), only)).otherwise(none))
        .when(reason.isin("provider", "device"), F.concat(asked, F.lit("was not found")))
        .when(by_level, F.concat(asked, only))
        .otherwise(F.concat(asked, F.lit("does not support "), what))
    )


def missed_levels(capabilities: DataFrame) -> DataFrame:
    """(codec, container, direction, provider_id, device_id, levels): the
    distinct levels of the capabilities by what else they serve, sorted; a row
    for each device, and one of null device for all together."""
    caps = registered(capabilities).select("codec", "container", "direction", "provider_id", "device_id", F.explode("levels").alias("level"))
    every = caps.withColumn("provider_id", F.lit(None).cast("string")).withColumn("device_id", F.lit(None).cast("string"))
    levels = F.array_sort(F.collect_set("level")).alias("levels")
    return caps.unionByName(every).groupBy("codec", "container", "direction", "provider_id", "device_id").agg(levels)


def inventory(capabilities: DataFrame) -> DataFrame:
    """(provider_id, device_id, line): each capability of each registered
    device as a line of the inventory."""
    fmt = formats.format_name(formats.make_format(F.col("container"), F.col("codec")))
    line = F.concat(
        F.lit("capability: "), fmt, F.lit(" "), direction_name(F.col("direction")), F.lit(" levels="), F.array_join("levels", ","),
        F.lit(" block="), F.col("block_size").cast("string"), F.lit(" maturity="), F.initcap("maturity"),
    )
    return registered(capabilities).select("provider_id", "device_id", line.alias("line"))
