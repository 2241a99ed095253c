"""Which device decodes fast enough for which link: occupancy, two bounds, and a verdict for each pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Kernels (backend, k low, k high, expansion, achieved fraction, lanes, table bytes, bytes a group,
# threads of a block, least blocks at the measurement), devices (name, GB/s, units, pool a unit, cap a block, threads a
# unit, GHz, occupancy read off the device, backend), links (name, GB/s), and the coded share of plain bytes.
KERNELS = [("cuda", 217.0, 248.0, 2.88, 0.59, 8, 16384, 640, 192, 3), ("metal", 269.4, 313.1, 2.975, 0.59, 8, 17408, 128, 128, 1)]
DEVICES = [
    ("RTX 5080 (dGPU)", 960.0, 84, 102400, 101376, 1536, 2.66, True, "cuda"),
    ("Apple M4 (unified)", 120.0, 10, 77824, 32768, 1024, 1.578, True, "metal"),
    ("M4 Max (unified)", 546.0, None, None, None, None, None, False, "metal"),
    ("Strix Halo (unified)", 256.0, None, None, None, None, None, False, "vulkan"),
    ("Radeon 780M (iGPU)", 60.0, None, None, None, None, None, False, "vulkan"),
    ("Phone SoC GPU (class)", 68.0, None, None, None, None, None, False, "vulkan"),
    ("Radeon 2-CU (iGPU)", 59.4, 2, None, 32768, 2048, 2.2, False, "vulkan"),
]
LINKS = [("NVMe Gen5", 12.0), ("NVMe Gen4 (this box)", 6.34), ("UFS 4.0 (phone)", 4.0), ("M4 NVMe (Mac mini internal)", 3.12), ("SATA SSD", 0.55), ("M4 USB SSD (exFAT)", 0.373), ("eMMC / SD", 0.30)]
CODED_SHARE = 0.653
#: The unit of k that the model is written in; a published k in another unit is refused.
K_UNIT = "lane-cycles per decoded byte"


def kernels(spark: SparkSession, rows=KERNELS) -> DataFrame:
    return spark.createDataFrame(rows, "backend string, k_low double, k_high double, expansion double, fraction double, lanes int, lut_bytes int, group_bytes int, block_threads int, blocks_lo int")


def devices(spark: SparkSession, rows=DEVICES) -> DataFrame:
    return spark.createDataFrame(rows, "device string, gb_s double, units int, pool int, cap int, max_threads int, ghz double, verified boolean, backend string")


def links(spark: SparkSession, rows=LINKS) -> DataFrame:
    return spark.createDataFrame(rows, "link string, link_gb_s double")


def published(kernel_rows: DataFrame, costs: DataFrame) -> DataFrame:
    """Kernels with published fields in place of the fallbacks, field by field; k only in the right unit."""
    c = costs.select(F.col("backend").alias("_b"), *[F.col(x).alias(f"p_{x}") for x in ("k_low", "k_high", "unit", "expansion", "fraction")])
    rows = kernel_rows.join(c, kernel_rows["backend"] == c["_b"], "left")
    right = F.coalesce((F.col("p_unit") == K_UNIT) & (F.col("p_k_low") != 0), F.lit(False))
    return rows.withColumns({
        "k_low": F.when(right, F.col("p_k_low")).otherwise(F.col("k_low")), "k_high": F.when(right, F.col("p_k_high")).otherwise(F.col("k_high")),
        "expansion": F.coalesce("p_expansion", "expansion"), "fraction": F.coalesce("p_fraction", "fraction"), "refused": F.col("p_k_low").isNotNull() & ~right,
    }).select(*kernel_rows.columns, "refused")


def predict(device_rows: DataFrame, kernel_rows: DataFrame, default: str = "cuda") -> DataFrame:
    """Per device: blocks and lanes resident, both bounds, the rate as [low, high] and what bounds it."""
    own = kernel_rows.withColumnRenamed("backend", "kb")
    with_own = device_rows.join(F.broadcast(own.select("kb")), F.col("backend") == F.col("kb"), "left").withColumn("use", F.coalesce("kb", F.lit(default))).drop("kb")
    d = with_own.join(F.broadcast(own), F.col("use") == F.col("kb")).drop("kb")
    shm = F.col("lut_bytes") + F.expr("block_threads div lanes") * F.col("group_bytes")
    d = d.withColumn("shmem", shm.cast("long"))
    d = d.withColumn("by_memory", F.expr("pool div shmem")).withColumn("by_threads", F.expr("max_threads div block_threads"))
    has = F.col("pool").isNotNull() & F.col("cap").isNotNull() & F.col("max_threads").isNotNull()
    d = d.withColumn("blocks", F.when(has, F.when(F.col("shmem") > F.col("cap"), F.lit(0).cast("long")).otherwise(F.least("by_memory", "by_threads"))))
    d = d.withColumn("binds", F.when(F.col("by_memory") <= F.col("by_threads"), "shared memory").when(F.col("by_memory").isNotNull() & F.col("by_threads").isNotNull(), "threads per unit"))
    d = d.withColumn("resident", F.col("units") * F.col("blocks") * F.col("block_threads"))
    d = d.withColumn("bandwidth", F.col("gb_s") * F.col("fraction") / (1 + 1 / F.col("expansion")))
    live = F.nullif(F.col("resident"), F.lit(0).cast("long")) * F.col("ghz")
    d = d.withColumn("compute_lo", live / F.col("k_high")).withColumn("compute_hi", live / F.col("k_low"))
    claims = F.col("verified") & (F.col("blocks") >= F.col("blocks_lo"))
    hi = F.least("compute_hi", "bandwidth")
    lo = F.when(F.coalesce(claims, F.lit(False)) & F.col("compute_hi").isNotNull(), F.least("compute_lo", "bandwidth")).otherwise(0.0)
    d = d.withColumn("lo", lo).withColumn("hi", hi)
    near = F.col("bandwidth") - 1e-9
    why = F.when(F.col("compute_hi").isNull(), "no compute term").when(~F.coalesce(claims, F.lit(False)), "ceiling").when((F.col("hi") >= near) & (F.col("lo") >= near), "bandwidth").when(F.col("hi") >= near, "both").otherwise("compute")
    return d.withColumn("why", why).withColumn("margin", F.col("bandwidth") / F.col("compute_hi")).withColumn("borrowed", F.col("use") != F.col("backend"))


def verdict(lo: Column, hi: Column, link: Column) -> Column:
    return F.when(lo > link, "pays").when(hi <= link, "tax").otherwise("measure")


def verdicts(predicted: DataFrame, link_rows: DataFrame) -> DataFrame:
    """Every device with every link: two small dimension tables."""
    return predicted.crossJoin(F.broadcast(link_rows)).withColumn("verdict", verdict(F.col("lo"), F.col("hi"), F.col("link_gb_s"))).withColumn("speedup", F.least(F.lit(1 / CODED_SHARE), F.col("hi") / F.col("link_gb_s")))


def table(verdict_rows: DataFrame) -> DataFrame:
    """One row for each device, one column for each link."""
    return verdict_rows.groupBy("device").pivot("link", [name for name, _ in LINKS]).agg(F.first("verdict"))
