"""Mixing sources to target weights by Sainte-Laguë apportionment, DataFrame functions only.

Sources, in code-point order with null last, weigh 1, 2, 3 in turn and share as
many words as the corpus has; a target stops at ``REPEATS`` times its source's
words and the excess goes to the others by weight.

The words of the mix are cut into equal blocks.  Blocks go to sources by the
highest quotients target / (2 k + 1), and each source's blocks to its shards by
the highest quotients of the shards' words, which gives one integer quota per
shard.  In a shard documents stand in seeded order and form one stream of blocks.
The quota takes the whole stream as often as it holds it, and the rest as seeded
blocks: with r of m blocks to take and a seeded offset c, block j is taken if
floor(((j + 1) r + c) / m) > floor((j r + c) / m).  A document's taken words follow
from the two ends of its place in the stream, so no block is ever listed.

Plain rounding comes first: it is at most half a unit per source off in sum, so
only the next quotients of each unit, a number proportional to its share, compete
for the difference.  The rank over all sources is taken over range blocks.
Documents meet their source's row by (source, salt); a source has as many shards
as the root of its words asks for, so a source with a third of all rows spreads.

Defined results: a null text has size 0; sources that are null form one source;
a source without words has target 0; equal quotients go to the unit that comes
first; rows of equal id are told apart by their text, and rows equal in both may
swap places, which changes no result; an empty table gives no rows; other columns
stay out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowtide.llm.common import pick
from flowtide.operators.ordering import BLOCK, block_window, carry_sum, ordered_blocks
from flowtide.session import cut

WEIGHTS = (1, 2, 3)
REPEATS = 3
# Longest block; a smaller one is taken where some source's target is below 128 blocks.
BLOCK_WORDS = 256
SALTS = 32
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def seeded(*parts: Column | str) -> Column:
    """Sixty bits of the md5 of the parts, as a long."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(SEED), *parts).cast("binary")), 1, 15), 16, 10).cast("long")


def _ranked(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Number the rows from 1 along ``keys``, over range blocks; ``keys`` must end in a unique column."""
    blocks = ordered_blocks(df, keys)
    carry = carry_sum(blocks, F.lit(1), "_before")
    place = F.row_number().over(block_window(keys))
    return blocks.withColumn("_place", place).join(carry, BLOCK).withColumn(name, F.col("_place") + F.col("_before")).drop("_place", "_before", BLOCK)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """unit (1, 2, ...), source, source_size, weight, capped, target for a table of sources and their words.

    Each round caps the sources whose share is above ``repeats`` times their words,
    until none is; a round is one aggregate of one row.
    """
    listed = sizes.withColumn("none", F.col("source").isNull().cast("int")).withColumn("name", F.coalesce("source", F.lit("")))
    ranked = _ranked(listed, ["none", "name"], "unit")
    kinds = F.array(*[F.lit(w) for w in weights])
    table = cut(ranked.select("unit", "source", "source_size", F.element_at(kinds, ((F.col("unit") - 1) % len(weights) + 1).cast("int")).cast("long").alias("weight")))
    wide = "decimal(38,0)"
    words, left, shares = table.agg(F.sum("source_size"), F.sum("source_size"), F.sum("weight")).first()
    capped = F.lit(False)
    while shares:
        # weight * left / shares > repeats * source_size, in integers
        over = (F.col("weight") * F.lit(left).cast("decimal(20,0)")).cast(wide) > (F.col("source_size") * F.lit(repeats * shares).cast("decimal(18,0)")).cast(wide)
        held, rest = table.agg(F.sum(F.when(over, repeats * F.col("source_size")).otherwise(0)), F.sum(F.when(~over, F.col("weight")).otherwise(0))).first()
        capped = over
        if rest == shares:
            break
        left, shares = words - held, rest
    share = F.col("weight") * F.lit(float(left or 0)) / F.lit(float(shares or 1))
    return table.withColumn("capped", capped).withColumn("target", F.when(F.col("capped"), (repeats * F.col("source_size")).cast("double")).otherwise(share))


def _with_totals(df: DataFrame, keys: list[str], **totals: Column) -> DataFrame:
    """Every row with the aggregates of its group; without a group, of the table."""
    if keys:
        return df.join(df.groupBy(*keys).agg(*[c.alias(n) for n, c in totals.items()]), keys)
    values = df.agg(*[c.alias(n) for n, c in totals.items()]).first()
    return df.withColumns({n: F.lit(0 if values[n] is None else values[n]) for n in totals})


def apportion(units: DataFrame, total: str, share: str, group: str | None) -> DataFrame:
    """Add seats: Sainte-Laguë's division of ``total`` by ``share`` among the units of each group.

    ``units`` has unit (unique in its group), ``share`` and the group's ``total``.
    Without a group all units are one group, ranked over range blocks.
    """
    keys = [group] if group else []
    base = _with_totals(units, keys, _all=F.sum(share), _units=F.count("*"))
    part = F.when(F.col("_all") > 0, F.col(share) / F.col("_all")).otherwise(0.0)
    base = cut(base.withColumn("_part", part).withColumn("_plain", F.floor(F.col(total) * F.col("_part") + 0.5)))
    rows = _with_totals(base, keys, _gap=F.max(total) - F.sum("_plain")).filter("_gap <> 0 AND _part > 0")
    most = F.floor(F.col("_part") * F.col("_units") / 2).cast("long") + 2
    more = F.when(F.col("_gap") > 0, F.sequence(F.lit(0).cast("long"), most - 1)).otherwise(
        F.sequence(F.lit(-1).cast("long"), -F.least(most, F.col("_plain")), F.lit(-1).cast("long")))
    rows = rows.filter("_gap > 0 OR _plain > 0").select(*keys, "unit", "_gap", "_plain", share, F.explode(more).alias("_step"))
    quotient = F.col(share) / (2 * (F.col("_plain") + F.col("_step")) + 1)
    # The highest quotients are added, the lowest taken away; of equal ones the first unit keeps its seat.
    rows = rows.withColumn("_order", F.when(F.col("_gap") > 0, -quotient).otherwise(quotient)).withColumn("_tie", F.when(F.col("_gap") > 0, F.col("unit")).otherwise(-F.col("unit")))
    if group:
        ranked = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy("_order", "_tie", F.abs("_step"))))
    else:
        ranked = _ranked(rows.withColumn("_far", F.abs("_step")), ["_order", "_tie", "_far"], "_rank")
    changed = ranked.filter(F.col("_rank") <= F.abs("_gap")).groupBy(*keys, "unit").agg(F.sum(F.signum("_gap")).cast("long").alias("_change"))
    return base.join(changed, [*keys, "unit"], "left").withColumn("seats", F.col("_plain") + F.coalesce("_change", F.lit(0))).drop("_all", "_units", "_part", "_plain", "_change")


def block_words(targets: DataFrame, longest: int = BLOCK_WORDS) -> int:
    """The largest power of two up to ``longest`` of which the smallest target above 0 has 128, at least 1."""
    least = targets.filter("target > 0").agg(F.min("target")).first()[0] or 1.0
    size = 1
    while 2 * size <= longest and 2 * size * 128 <= least:
        size *= 2
    return size


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, longest: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken for every row of ``docs``."""
    d = pick(docs, id_col, text_col, source_col).toDF("doc_id", "text", "source")
    mark = seeded(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    base = cut(d.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), mark.alias("mark")))
    by_source = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = cut(source_targets(by_source, weights, repeats))
    size = block_words(targets, longest)
    words = targets.agg(F.sum("target")).first()[0] or 0.0
    seats = cut(apportion(targets.withColumn("_blocks", F.lit(int(words / size + 0.5)).cast("long")), "_blocks", "target", None).drop("_blocks"))

    # About one shard for every eight times the root of a source's words.
    shards = F.greatest(F.floor(F.sqrt("source_size") / 8), F.lit(1)).cast("long")
    known = seats.select("unit", F.col("source").alias("of"), "source_size", "target", "capped", F.col("seats").alias("source_seats"), shards.alias("shards"))
    salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    own = base.withColumn("own_salt", (F.col("mark") % SALTS).cast("int"))
    placed = own.join(salted, F.col("source").eqNullSafe(F.col("of")) & (F.col("own_salt") == F.col("salt")))
    placed = placed.withColumn("shard", F.expr(f"mark DIV {SALTS}") % F.col("shards"))
    placed = cut(placed.select("doc_id", "size", "mark", "unit", "shard", "source_size", "target", "capped", "source_seats"))
    quotas = placed.groupBy(F.col("unit").alias("of"), F.col("shard").alias("unit")).agg(F.sum("size").alias("words"), F.max("source_seats").alias("source_seats"))
    quotas = apportion(quotas, "source_seats", "words", "of").select(F.col("of").alias("unit"), F.col("unit").alias("shard"), "words", "seats")

    at = Window.partitionBy("unit", "shard").orderBy("mark", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    streams = placed.join(quotas, ["unit", "shard"]).withColumn("end", F.sum("size").over(at)).withColumn("start", F.col("end") - F.col("size"))
    quota = F.when(F.col("capped"), repeats * F.col("words")).otherwise(F.least(F.col("seats") * size, repeats * F.col("words")))
    streams = streams.withColumn("quota", quota).withColumn("whole", F.when(F.col("words") > 0, F.expr("quota DIV words")).otherwise(0))
    streams = streams.withColumn("m", F.ceil(F.col("words") / size).cast("long")).withColumn("r", F.floor((F.col("quota") - F.col("whole") * F.col("words")) / size + 0.5).cast("long"))
    streams = streams.withColumn("r", F.least("r", "m")).withColumn("c", F.when(F.col("m") > 0, seeded("unit", "shard") % F.col("m")).otherwise(0))

    def before(x: str) -> Column:
        """Words of chosen blocks before place x of the stream."""
        j, chosen = f"({x} DIV {size})", "(({0}) * r + c) DIV m"
        here = f"({chosen.format(j + ' + 1')} - {chosen.format(j)})"
        return F.expr(f"CASE WHEN m > 0 THEN {size} * ({chosen.format(j)}) + {here} * ({x} % {size}) ELSE 0 END")

    taken = F.col("whole") * F.col("size") + before("end") - before("start")
    return streams.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))
