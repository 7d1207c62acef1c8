"""Live plans: label a capture by its attack log, evaluate old models on it, adapt them to it."""

from __future__ import annotations

from pyspark.sql import DataFrame

from flowtide import schema as S
from flowtide.operators.features import impute_zero
from flowtide.operators.intervals import align_clocks, label_by_interval, pick_session, sessionize
from flowtide.operators.models import evaluate_model, stack_reports, train_binary, train_multiclass
from flowtide.operators.sampling import stratified_split
from flowtide.operators.setops import union_sources
from flowtide.session import cut
from flowtide.sources.flows import scale_time_units


def prepare_live(flows: DataFrame, seconds: bool = True) -> DataFrame:
    """Zero the missing features; bring times to microseconds where they are in seconds."""
    filled = impute_zero(flows)
    return scale_time_units(filled) if seconds else filled


def ground_truth(flows: DataFrame, log: DataFrame, session_id: int | None = None, align: bool = True,
                 gap_seconds: float = 60.0) -> DataFrame:
    """Flows labelled by the log, or by one session of it moved onto the flows' clock.

    The log is stored once: alignment and segments read it several times.
    """
    part = cut(log)
    if session_id is not None:
        part = pick_session(sessionize(part, gap_seconds), session_id)
    if align:
        part = align_clocks(flows, part)
    return label_by_interval(flows, part)


def zero_shot_eval(tier1, tier3, labelled: DataFrame, label: str = "ground_truth_label") -> DataFrame:
    """Report of models trained elsewhere on labelled live flows."""
    return stack_reports([
        evaluate_model(tier1, labelled, "tier1_zero_shot", label, binary=True),
        evaluate_model(tier3, labelled, "tier3_zero_shot", label),
    ])


ADAPT = {"adapt": 0.3, "holdout": 0.7}
FIT_ROWS = 50_000  # training rows of a task; every level of every tree reads all of them


def domain_adapt(history: DataFrame, live: DataFrame, row_id: str = "flow_id", label: str = "unified_label",
                 live_label: str = "ground_truth_label", rounds: int = 100, depth: int = 6, seed: int = 42):
    """Train on history plus 30 % of the live flows, report on the other 70 %.

    Returns (tier-1 model, tier-3 model, report).  The training rows are stored
    once.  A small table trains in few tasks and more classes at a time instead:
    each tree is one job per level, whose tasks would be mostly overhead.
    """
    rows = live.select(*dict.fromkeys([row_id, *S.GOLDEN12, live_label]))
    split = stratified_split(rows, live_label, row_id, ADAPT, seed).withColumnRenamed(live_label, "_truth")
    cols = [*S.GOLDEN12, label]
    adapt = split.where("split = 'adapt'").withColumn(label, split["_truth"]).select(*cols)
    hold = split.where("split = 'holdout'").withColumn(label, split["_truth"]).select(*cols)
    train = cut(union_sources(history.select(*cols), adapt))
    tasks = max(1, -(-train.count() // FIT_ROWS))
    train = train.coalesce(tasks)
    at_a_time = min(len(S.CLASSES), max(2, 2 * train.sparkSession.sparkContext.defaultParallelism // tasks))
    tier1 = train_binary(train, label, rounds, depth, seed=seed)
    tier3 = train_multiclass(train, label, rounds, depth, seed=seed, learners=("boosted",), parallel=at_a_time)["boosted"]
    report = stack_reports([
        evaluate_model(tier1, hold, "tier1_adapted", label, binary=True),
        evaluate_model(tier3, hold, "tier3_adapted", label),
    ])
    return tier1, tier3, report
