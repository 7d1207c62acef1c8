"""Per-source window vectors, entropy and window labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowtide import schema as S
from flowtide.functions import tumbling_floor

ATTACKS = [c for c in S.CLASSES if c != S.BENIGN]
MEANS = [c for c in S.GOLDEN12 if c != "flow_duration"]


def entropy_of_counts(n: Column) -> Column:
    """Shannon entropy in bits from value counts: log2(N) - sum(n log2 n) / N.

    The nine-digit rounding removes the noise that would make a one-valued
    group slightly negative.
    """
    total = F.sum(n)
    return F.greatest(F.round(F.log2(total) - F.sum(n * F.log2(n)) / total, 9), F.lit(0.0))


def shannon_entropy(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Entropy of ``column`` per group; nulls are not counted.

    The value counts are aggregated first, so a hot group reaches the second
    step as one row per distinct value.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*keys).agg(entropy_of_counts(F.col("n")).alias("entropy"))


def label_from_counts(counts: dict[str, Column]) -> Column:
    """Most frequent attack class, ties to the alphabetically first, else benign."""
    top = F.greatest(*[counts[c] for c in ATTACKS])
    out = F.when(top == 0, S.BENIGN)
    for c in sorted(ATTACKS):
        out = out.when(counts[c] == top, c)
    return out


def _class_counts(label: str) -> list[Column]:
    return [F.count_if(F.col(label) == c).alias(f"n_{c}") for c in ATTACKS]


def window_label(df: DataFrame, keys: list[str], label: str = "unified_label") -> DataFrame:
    """"Any attack present" label of each group."""
    counts = df.groupBy(*keys).agg(*_class_counts(label))
    return counts.select(*keys, label_from_counts({c: F.col(f"n_{c}") for c in ATTACKS}).alias("window_label"))


def attack_fraction(df: DataFrame, keys: list[str], label: str = "unified_label") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg((F.col(label) != S.BENIGN).cast("double")).alias("attack_flow_fraction"))


def window_cardinality(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct sources, windows, ports and (source, window) groups.

    The exact form first reduces to the distinct (source, window, port)
    triples, so each further distinct runs on far fewer rows.
    """
    base = df.select("src_ip", "window_start", "dst_port")
    if approximate:
        return base.agg(
            F.approx_count_distinct("src_ip").alias("sources"),
            F.approx_count_distinct("window_start").alias("windows"),
            F.approx_count_distinct("dst_port").alias("ports"),
            F.approx_count_distinct(F.struct("src_ip", "window_start")).alias("groups"),
        )
    return base.distinct().agg(
        F.count_distinct("src_ip").alias("sources"),
        F.count_distinct("window_start").alias("windows"),
        F.count_distinct("dst_port").alias("ports"),
        F.count_distinct(F.struct("src_ip", "window_start")).alias("groups"),
    )


def with_window_start(df: DataFrame, ts: str = "ts", width: str = "5 minutes") -> DataFrame:
    return df.withColumn("window_start", tumbling_floor(ts, width))


def tier2_windows(df: DataFrame, ts: str = "ts", width: str = "5 minutes", label: str = "unified_label") -> DataFrame:
    """Sixteen features, label and attack share per source and window.

    Step 1 counts per (source, window, port, protocol) with map-side partial
    sums: a source that sends a third of all flows leaves it as at most one
    row per port and protocol.  Those rows are then placed once by (source,
    window), and both remaining aggregates run on that placement without
    another shuffle.
    """
    keys = ["src_ip", "window_start"]
    sums = [F.sum(c).alias(f"s_{c}") for c in S.GOLDEN12]
    fine = with_window_start(df, ts, width).groupBy(*keys, "dst_port", "protocol").agg(
        F.count(F.lit(1)).alias("n"), *sums, *_class_counts(label))

    carried = ["n"] + [f"s_{c}" for c in S.GOLDEN12] + [f"n_{c}" for c in ATTACKS]
    # every fine row counts once for its port and once for its protocol; the
    # sums ride along with the port copy only
    copies = fine.select(
        *keys, *carried,
        F.explode(F.array(
            F.struct(F.lit(True).alias("is_port"), F.col("dst_port").cast("int").alias("v")),
            F.struct(F.lit(False).alias("is_port"), F.col("protocol").cast("int").alias("v")),
        )).alias("d"))
    port = F.col("d.is_port")
    placed = copies.select(
        *keys, port.alias("is_port"), F.col("d.v").alias("v"), "n",
        *[F.when(port, F.col(c)).alias(c) for c in carried[1:]],
    ).repartition(*keys)
    per_value = placed.groupBy(*keys, "is_port", "v").agg(*[F.sum(c).alias(c) for c in carried])

    def entropy(side: Column) -> Column:
        # null values take part in the means but not in the entropy
        n = F.when(side & F.col("v").isNotNull(), F.col("n"))
        return F.coalesce(entropy_of_counts(n), F.lit(0.0))

    is_port = F.col("is_port")
    total = F.sum(F.when(is_port, F.col("n")))
    grouped = per_value.groupBy(*keys).agg(
        total.alias("flow_count"),
        (F.sum("s_flow_duration") / total).alias("mean_flow_duration"),
        entropy(~is_port).alias("protocol_entropy"),
        entropy(is_port).alias("destination_port_entropy"),
        *[(F.sum(f"s_{c}") / total).alias(f"mean_{c}") for c in MEANS],
        F.count_if(is_port & F.col("v").isNotNull()).alias("unique_destination_ports"),
        *[F.sum(f"n_{c}").alias(f"n_{c}") for c in ATTACKS],
    )
    attacks = sum((F.col(f"n_{c}") for c in ATTACKS[1:]), F.col(f"n_{ATTACKS[0]}"))
    return grouped.withColumns({
        "window_label": label_from_counts({c: F.col(f"n_{c}") for c in ATTACKS}),
        "attack_flow_fraction": attacks / F.col("flow_count"),
    }).drop(*[f"n_{c}" for c in ATTACKS])
