"""Input devices, their configurations, presets and entitlements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelspark.functions import formats

C = F.col

# Fixed values.
REJECTED = r"(?i)阵列|array|senary|bluetooth|hands-?free|headset|communications|立体声混音|stereo mix|what u hear|wave out"
DISCOURAGED = r"(?i)built-?in|internal microphone|内置|realtek"
PROBE_RATE = 48_000
REQUIRED_RATES, REQUIRED_DEPTHS = (44_100, 48_000, 96_000), (16, 24, 32)


def device_class(name: Column) -> Column:
    n = F.trim(F.coalesce(name, F.lit("")))
    return (F.when(n == "", "discouraged").when(n.rlike(REJECTED), "rejected").when(n.rlike(DISCOURAGED), "discouraged").otherwise("production"))


def class_rank(name: Column) -> Column:
    k = device_class(name)
    return F.when(k == "production", 0).when(k == "discouraged", 1).otherwise(2)


def preferred_device(devices: DataFrame) -> DataFrame:
    """Best class on the host, there the default device, else the first one listed."""
    rank = F.struct(class_rank(C("name")), (~C("is_default")).alias("d"), "position")
    return devices.groupBy("host_id").agg(F.min_by(F.struct("position", "device_id", "name"), rank).alias("p")).select("host_id", "p.*")


def config_match(rate: Column, channel: Column, mode: Column) -> Column:
    mode_ok = mode.isNull() | C("share_mode").isNull() | (C("share_mode") == mode)
    return mode_ok & (C("min_sample_rate") <= rate) & (C("max_sample_rate") >= rate) & (C("channels") >= channel)


def rank_configurations(configs: DataFrame, score: Column, exclusive: bool, top: int | None = None) -> DataFrame:
    """Configurations ranked per host: format score, in exclusive mode then channels; with ``top`` only the best."""
    order = [F.desc("score"), *([F.desc("channels")] if exclusive else []), F.asc("position")]
    w = Window.partitionBy("host_id").orderBy(*order)
    ranked = configs.withColumn("score", score).withColumn("rn", F.row_number().over(w))
    return ranked if top is None else ranked.where(C("rn") <= top)


def preferred_format(configs: DataFrame) -> DataFrame:
    rank = formats.format_rank(C("sample_format"))
    return configs.groupBy("host_id").agg(F.min_by(formats.normal_format(C("sample_format")), rank).alias("preferred"))


def probe_issues(devices: DataFrame) -> DataFrame:
    """Devices whose exclusive mode failed to probe, lacks 48 kHz or is empty.

    ``exclusive_rates`` is the probed rate list, ``configurations`` the enumerated ranges.
    """
    exclusive = F.filter("configurations", lambda c: c["share_mode"] == "exclusive")
    has_rate = F.array_contains("exclusive_rates", PROBE_RATE) | F.exists(
        exclusive, lambda c: F.lit(PROBE_RATE).between(c["min_sample_rate"], c["max_sample_rate"]))
    available = C("exclusive_available") | (F.size("exclusive_rates") > 0)
    error = F.when(F.trim("probe_error") != "", F.trim("probe_error"))
    kind = (F.when(error.isNotNull(), "exclusive_probe_error").when(available & ~has_rate, "exclusive_missing_48k").when(~available, "exclusive_empty"))
    out = devices.where(F.trim("name") != "").select("*", kind.alias("kind"), error.alias("error")).where("kind is not null")
    key = F.concat_ws("|", "kind", F.trim("name"), F.array_join(C("exclusive_rates").cast("array<string>"), ","), F.coalesce("error", F.lit("")))
    return out.withColumn("issue_key", key)


INVENTORY_SCHEMA = ("id string, name string, is_default boolean, "
                    "configurations array<struct<min_sample_rate:bigint, max_sample_rate:bigint, channels:bigint, sample_format:string, share_mode:string>>")


def read_inventory(documents: DataFrame) -> DataFrame:
    """Configurations of device documents (host_id, position, text); a device without any stays."""
    d = documents.select("host_id", "position", F.from_json("text", INVENTORY_SCHEMA).alias("d"))
    return d.select("host_id", "position", "d.id", "d.name", "d.is_default", F.explode_outer("d.configurations").alias("c")).select(
        "host_id", "position", "id", "name", "is_default", "c.*")


def missing_cells(configs: DataFrame, hosts: DataFrame, channels: tuple[int, ...]) -> DataFrame:
    """Required (rate, channel) cells of each host that no configuration covers.

    Every configuration names the few fixed cells it covers; one distinct per host and
    cell follows, so a host with very many devices forms no pairs.
    """
    cells = F.array(*[F.struct(F.lit(r).cast("long").alias("rate"), F.lit(c).cast("long").alias("channel")) for r in REQUIRED_RATES for c in channels])
    inside = F.filter(cells, lambda x: (C("min_sample_rate") <= x["rate"]) & (C("max_sample_rate") >= x["rate"]) & (C("channels") >= x["channel"]))
    covered = configs.select("host_id", F.inline(inside)).distinct()
    return hosts.select("host_id", F.inline(cells)).join(covered, ["host_id", "rate", "channel"], "left_anti")


def required_matrix(hosts: DataFrame, channels: tuple[int, ...]) -> DataFrame:
    """Every required combination of channel, rate and depth for each host."""
    lit = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    m = hosts.select("host_id", F.explode(lit(channels)).alias("channel"))
    m = m.select("*", F.explode(lit(REQUIRED_RATES)).alias("sample_rate"))
    return m.select("*", F.explode(lit(REQUIRED_DEPTHS)).alias("bit_depth"))


def preset_valid() -> Column:
    """Validity of a preset row; lengths count trimmed text."""
    t = lambda n: F.length(F.trim(F.coalesce(C(n), F.lit(""))))
    fmt = F.when(F.coalesce(C("input_sample_format"), F.lit("")) == "", formats.format_of_depth(C("bit_depth"))).otherwise(C("input_sample_format"))
    mode = F.coalesce("capture_share_mode", F.lit("exclusive"))
    return F.coalesce(
        t("id").between(1, 128) & t("name").between(1, 40) & t("device_id").between(1, 8192) & t("device_name").between(1, 1024)
        & C("sample_rate").between(8000, 384_000) & C("bit_depth").isin(16, 24, 32) & fmt.isin("i16", "i24", "i32", "f32")
        & C("input_channel").between(1, 65_535) & C("silence_duration_ms").between(200, 5000)
        & C("silence_threshold_dbfs").between(-96, -6) & mode.isin("exclusive", "shared"), F.lit(False))


def preset_clashes(presets: DataFrame) -> DataFrame:
    """Name keys and ids used more than once in a store."""
    both = presets.select("store", F.explode(F.array(
        F.struct(F.lit("name").alias("field"), F.lower(F.trim("name")).alias("key")), F.struct(F.lit("id").alias("field"), F.trim("id").alias("key")))).alias("k"))
    return both.groupBy("store", "k.field", "k.key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
