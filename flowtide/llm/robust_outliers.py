"""Quality rules: robust multivariate outliers, all in DataFrame functions.

Five transformed statistics of a text form a vector.  Each group (language and
source) gets a minimum-covariance-determinant estimate: three deterministic starts
(lower quartiles, medians, upper quartiles, with median absolute deviations), two
concentration steps each on the half of the rows that lies nearest, then from the
start with the least determinant on until the determinant no longer falls, and one
reweighting.  Up to half of a group may be junk; a group that is junk throughout is
its own measure.  A document is rejected if its squared Mahalanobis distance to its
group exceeds ``CUTOFF``.

Each language as a whole and all rows together get such an estimate too.  The
moments of a group are drawn towards those of its language, and these towards
those of all rows, with weight n / (n + ``PRIOR_ROWS``) for the own ones, so
every document is judged and nothing switches at a size.  Medians, ranks and
moments are counts and sums, combined inside the tasks before the shuffle, so a
source that holds a third of all rows costs no more than others.  Quantiles come
from counts over a fine fixed grid and do not depend on the order of rows; those of
languages and of all rows are summed from the groups' counts.  A row meets its
estimates of all levels in one join by its group, broadcast where the stored table
has at most ``BROADCAST_GROUPS`` rows; estimates that settled leave the passes.

Defined results: a null text has no words; null language and source form a group
of their own with the empty name; repeated rows each keep their row; an empty
table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowtide.session import cut

P = 5
VECTOR = [f"z{i}" for i in range(P)]
MEANS = [f"m{i}" for i in range(P)]
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
MOMENTS = [*MEANS, *[f"c{i}{j}" for i, j in PAIRS]]
# Least standard deviations.  Each statistic alone can pass the cutoff within what the base rules let through.
FLOOR = (0.25, 0.05, 0.03, 0.1, 0.1)
# Share of a group that an estimate rests on, steps that every start takes, and the fall of log determinants that counts.
SHARE = 0.5
FIRST_STEPS = 2
FALL = 0.01
# Quantiles the starts are centred on.
STARTS = (0.5, 0.25, 0.75)
BROADCAST_GROUPS = 10_000
# Rows at which a group's own moments weigh as much as those of the level above.
PRIOR_ROWS = 100
WHITE = " \t\n\x0b\x0c\r"
GRID = 256


def chi2_below(x: float, k: int) -> float:
    """Distribution function of chi-square with an odd number k of degrees of freedom."""
    total, term = math.erf(math.sqrt(x / 2)), math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    for i in range(1, k, 2):
        total -= term
        term *= x / (i + 2)
    return total


def chi2_at(share: float, k: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_below(mid, k) < share else (lo, mid)
    return lo


def consistency(share: float) -> float:
    """Factor that makes the covariance of the nearest ``share`` of normal rows unbiased."""
    return share / chi2_below(chi2_at(share, P), P + 2)


CUTOFF = chi2_at(0.999, P)
REWEIGHT = 0.975


def statistics(text: Column) -> list[Column]:
    """Words, n_symbols and lines with a word of a text column, by functions that scan the text without a table per character."""
    t = F.coalesce(text, F.lit(""))
    return [
        F.array_remove(F.split(t, "[\\x20\\x09-\\x0D]+"), "").alias("_words"),
        F.length(F.regexp_replace(t, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.filter(F.split(t, "\n"), lambda x: F.ltrim(x, F.lit(WHITE)) != "").alias("_lines"),
    ]


def _windows(hashes: str) -> Column:
    """Hash of every eight neighbouring word hashes; the shifted lists are zipped, so no list is sliced per window."""
    shifted = [F.slice(hashes, k + 1, F.size(hashes) - 7) for k in range(8)]
    return F.when(F.size(hashes) >= 9, F.transform(F.arrays_zip(*shifted), lambda w: F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))


def _covered(windows: Column) -> Column:
    """Words covered by the windows at the given sorted starts."""
    gaps = F.aggregate(
        windows, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-8).cast("long").alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(8).cast("long"), p - a["last"])).alias("n"), p.alias("last")))
    return gaps["n"]


def with_statistics(docs: DataFrame) -> DataFrame:
    """The input with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the vector.

    Words are hashed once, and windows of eight words are compared by 64-bit hashes
    of these.  Only a text with a repeated window sorts its windows.
    """
    s = docs.select("*", *statistics(F.col("text")))
    s = s.select(
        "*", F.size("_words").cast("long").alias("n_words"), F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.size("_lines").cast("long").alias("_n_lines"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    ).drop("_words", "_lines")
    s = s.withColumn("_windows", _windows("_hashes")).drop("_hashes")
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    empty = F.array().cast("array<struct<h:bigint,at:bigint>>")
    s = s.withColumn("_sorted", F.when(repeats, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("at"))))).otherwise(empty)).drop("_windows")
    last = F.size("_sorted") - 1
    same = F.filter("_sorted", lambda x, i: (
        ((i > 0) & (F.get("_sorted", i - 1)["h"] == x["h"])) | ((i < last) & (F.get("_sorted", i + 1)["h"] == x["h"]))))
    s = s.withColumn("_starts", F.sort_array(F.transform(same, lambda x: x["at"]))).drop("_sorted")
    s = s.withColumn("n_repeat_words", _covered(F.col("_starts"))).drop("_starts")
    words, chars = F.greatest(F.col("n_words"), F.lit(1)).cast("double"), F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    lines = F.greatest(F.col("_n_lines"), F.lit(1)).cast("double")
    vector = [
        F.log1p(F.col("n_words").cast("double")), F.log(chars / words), F.sqrt(F.col("n_symbols") / chars),
        F.sqrt(F.col("n_dup_lines") / lines), F.sqrt(F.col("n_repeat_words") / words),
    ]
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return s.select("*", failed.alias("base_failed"), *[v.alias(z) for v, z in zip(vector, VECTOR)]).drop("_n_lines")


KEYS = ["e_level", "e_lang", "e_source"]
# Levels of estimates: a language and source, a language, all rows.
LEVELS = [(2, "g_lang", "g_source"), (1, "g_lang", None), (0, None, None)]


def _keys(level: int, lang: str | None, source: str | None) -> list[Column]:
    return [F.lit(level).alias("e_level"), (F.col(lang) if lang else F.lit("")).alias("e_lang"), (F.col(source) if source else F.lit("")).alias("e_source")]


def _quantiles(counts: DataFrame, keys: list[str], shares: tuple) -> DataFrame:
    """keys, q0, q1, ...: upper edges of the cells in which the shares of the rows are reached; ``c`` counts per ``bin``."""
    run = Window.partitionBy(*keys).orderBy("bin")
    placed = counts.withColumn("run", F.sum("c").over(run)).withColumn("all", F.sum("c").over(Window.partitionBy(*keys)))
    edges = [F.min(F.when(F.col("run") >= F.ceil(F.col("all") * share), F.col("bin"))).alias(f"q{i}") for i, share in enumerate(shares)]
    return placed.groupBy(*keys).agg(*edges)


def _log_cell(d: Column) -> Column:
    return F.floor(F.log2(d + 1e-9) * 64)


def _raw_moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows n, means m_i and covariances c_ij of the rows as they are, per estimate."""
    firsts = [F.sum(z).alias(f"t{i}") for i, z in enumerate(VECTOR)]
    seconds = [F.sum(F.col(VECTOR[i]) * F.col(VECTOR[j])).alias(f"s{i}{j}") for i, j in PAIRS]
    e = rows.groupBy(*keys).agg(F.count("*").alias("n"), *firsts, *seconds)
    e = e.select(*keys, "n", *[(F.col(f"t{i}") / F.col("n")).alias(f"m{i}") for i in range(P)], *[f"s{i}{j}" for i, j in PAIRS])
    return e.select(*keys, "n", *MEANS, *[(F.col(f"s{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")).alias(f"c{i}{j}") for i, j in PAIRS])


def _factored(e: DataFrame, keys: list[str], factor: float = 1.0) -> DataFrame:
    """Means m_i and the Cholesky factor l_ij of ``factor`` times the covariance c_ij."""
    for j in range(P):
        for i in range(j, P):
            c = factor * F.col(f"c{i}{j}")
            for k in range(j):
                c = c - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            # The floor keeps groups without spread in a statistic invertible.
            e = e.withColumn(f"l{i}{j}", F.sqrt(F.greatest(c, F.lit(FLOOR[i] ** 2))) if i == j else c / F.col(f"l{j}{j}"))
    return e.select(*keys, *MEANS, *[f"l{i}{j}" for i, j in PAIRS])


def _shrunk(own: DataFrame, above: DataFrame, keys: list[str]) -> DataFrame:
    """Moments of ``own`` drawn towards those of ``above`` (columns u_...), joined on ``keys``."""
    w = F.col("n") / (F.col("n") + PRIOR_ROWS)
    mix = lambda x: w * F.col(x) + (1 - w) * F.col(f"u_{x}")
    up = above.select(*keys, *[F.col(x).alias(f"u_{x}") for x in MOMENTS])
    both = own.join(up, keys) if keys else own.crossJoin(up)
    return both.select(*[c for c in own.columns if c not in MOMENTS], *[mix(x).alias(x) for x in MOMENTS])


def _distance(rows: DataFrame) -> DataFrame:
    """``rows`` (joined to their estimate) with d, the squared Mahalanobis distance."""
    for i in range(P):
        y = F.col(VECTOR[i]) - F.col(f"m{i}")
        for k in range(i):
            y = y - F.col(f"l{i}{k}") * F.col(f"y{k}")
        rows = rows.withColumn(f"y{i}", y / F.col(f"l{i}{i}"))
    d = sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, P)), F.col("y0") * F.col("y0"))
    return rows.withColumn("d", d)


FACTORS = [f"l{i}{j}" for i, j in PAIRS]
STARTED = [*KEYS, "s"]


def _with_keys(groups: DataFrame) -> DataFrame:
    """``groups`` (g_lang, g_source, ...) once per level, with the keys of that level."""
    e = F.explode(F.array(*[F.struct(*_keys(*level)) for level in LEVELS])).alias("e")
    return groups.select("*", e).select(*groups.columns, "e.*")


def _meet(stats: DataFrame, groups: DataFrame, est: DataFrame) -> DataFrame:
    """Every row once per estimate in ``est`` that its group takes part in, with that estimate's columns."""
    entry = F.collect_list(F.struct(*est.columns)).alias("est")
    wide = cut(_with_keys(groups).join(est, KEYS).groupBy("g_lang", "g_source").agg(entry))
    if wide.count() <= BROADCAST_GROUPS:  # an entry has at most levels x starts estimates
        wide = F.broadcast(wide)
    met = stats.select("g_lang", "g_source", *VECTOR).join(wide, ["g_lang", "g_source"])
    return met.select(F.explode("est").alias("e"), *VECTOR).select("e.*", *VECTOR)


def _starts(stats: DataFrame) -> DataFrame:
    """Estimates s = 0, 1, ... of every key: quantiles as centres, median absolute deviations as scales."""
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.floor(F.col(z) * GRID).alias("bin")) for i, z in enumerate(VECTOR)])).alias("x")
    by_group = stats.select("g_lang", "g_source", cells).groupBy("g_lang", "g_source", "x.i", "x.bin").agg(F.count("*").alias("c"))
    counts = cut(_with_keys(by_group).groupBy(*KEYS, "i", "bin").agg(F.sum("c").alias("c")))
    centres = cut(_quantiles(counts, [*KEYS, "i"], STARTS))
    away = counts.join(centres, [*KEYS, "i"]).groupBy(*KEYS, "i", F.abs(F.col("bin") - F.col("q0")).alias("bin")).agg(F.sum("c").alias("c"))
    scales = _quantiles(away, [*KEYS, "i"], (0.5,)).withColumnRenamed("q0", "mad")
    at = lambda i, x: F.max(F.when(F.col("i") == i, x))
    grid = lambda x: (F.col(x) + 0.5) / GRID
    both = centres.join(scales, [*KEYS, "i"]).groupBy(*KEYS).agg(
        *[at(i, grid(f"q{s}")).alias(f"m{i}_{s}") for i in range(P) for s in range(len(STARTS))],
        *[at(i, F.greatest(grid("mad") * 1.4826, F.lit(FLOOR[i]))).alias(f"a{i}") for i in range(P)])
    scale = [(F.col(f"a{i}") if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i, j in PAIRS]
    each = [F.struct(F.lit(s).alias("s"), *[F.col(f"m{i}_{s}").alias(f"m{i}") for i in range(P)]) for s in range(len(STARTS))]
    spread = both.select(*KEYS, F.explode(F.array(*each)).alias("x"), *scale)
    return cut(spread.select(*KEYS, "x.*", *FACTORS, F.lit(math.inf).alias("ld")))


def _step(stats: DataFrame, groups: DataFrame, now: DataFrame) -> DataFrame:
    """One concentration step of each estimate, with the log determinant ``ld`` of what it comes to."""
    near = _distance(_meet(stats, groups, now.drop("ld"))).groupBy(*STARTED, _log_cell(F.col("d")).alias("bin")).agg(F.count("*").alias("c"))
    edged = cut(now.drop("ld").join(_quantiles(near, STARTED, (SHARE,)), STARTED))
    inner = _distance(_meet(stats, groups, edged)).filter(_log_cell(F.col("d")) <= F.col("q0"))
    new = _factored(_raw_moments(inner, STARTED), STARTED, consistency(SHARE))
    ld = sum((2 * F.log(f"l{i}{i}") for i in range(1, P)), 2 * F.log("l00"))
    return cut(new.select(*STARTED, *MEANS, *FACTORS, ld.alias("ld")))


def concentrated(stats: DataFrame, groups: DataFrame) -> DataFrame:
    """The estimate of least determinant of every key: KEYS, s (its start), means, factors, ld."""
    now = _starts(stats)
    for _ in range(FIRST_STEPS):
        now = _step(stats, groups, now)
    best = Window.partitionBy(*KEYS).orderBy("ld", "s")  # one row per start
    now = cut(now.withColumn("r", F.row_number().over(best)).filter("r = 1").drop("r"))
    settled, whole = None, [*MEANS, *FACTORS, "ld"]
    # Every round an estimate falls by FALL or leaves; the floors bound determinants from below.
    while True:
        new = _step(stats, groups, now)
        old = now.select(*STARTED, F.struct(*whole).alias("old"))
        pair = cut(old.join(new.select(*STARTED, F.struct(*whole).alias("new")), STARTED).withColumn("falls", F.col("new.ld") < F.col("old.ld") - FALL))
        kept = pair.filter(~F.col("falls")).select(*STARTED, F.when(F.col("new.ld") < F.col("old.ld"), F.col("new")).otherwise(F.col("old")).alias("x"))
        kept = kept.select(*STARTED, "x.*")
        settled = kept if settled is None else settled.unionByName(kept)
        now = pair.filter("falls").select(*STARTED, "new.*")
        if now.isEmpty():
            return cut(settled)


def estimates(stats: DataFrame) -> DataFrame:
    """Means and Cholesky factor for each g_lang, g_source of a stored table with the vector."""
    groups = cut(stats.select("g_lang", "g_source").distinct())
    inner = _distance(_meet(stats, groups, concentrated(stats, groups).drop("s", "ld"))).filter(F.col("d") <= chi2_at(REWEIGHT, P))
    fitted = cut(_raw_moments(inner, KEYS).select(*KEYS, "n", *MEANS, *[(consistency(REWEIGHT) * F.col(f"c{i}{j}")).alias(f"c{i}{j}") for i, j in PAIRS]))
    # A group without an inner row has weight 0 and takes the level above as it is.
    filled = lambda keys: keys.join(fitted, KEYS, "left").fillna(0, ["n", *MOMENTS])
    langs = groups.select("g_lang").distinct()
    top = fitted.filter("e_level = 0")
    by_lang = _shrunk(filled(langs.select(*_keys(*LEVELS[1]))), top, [])
    by_group = _shrunk(filled(groups.select(*_keys(*LEVELS[0]))), by_lang, ["e_lang"])
    return cut(_factored(by_group.withColumnsRenamed({"e_lang": "k_lang", "e_source": "k_source"}), ["k_lang", "k_source"]))


def _keyed(stats: DataFrame) -> DataFrame:
    return stats.withColumn("g_lang", F.coalesce("lang", F.lit(""))).withColumn("g_source", F.coalesce("source", F.lit("")))


def verdicts(stats: DataFrame, fitted: DataFrame) -> DataFrame:
    """``stats`` (keyed, with the vector) and distance, kept."""
    rows = stats.join(fitted, (F.col("g_lang") == F.col("k_lang")) & (F.col("g_source") == F.col("k_source")), "left")
    rows = _distance(rows)
    kept = ~F.col("base_failed") & (F.col("d") <= CUTOFF)
    return rows.select(*stats.columns, F.col("d").alias("distance"), kept.alias("kept"))


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the five counts, base_failed, kept, distance: one row per document."""
    stats = cut(_keyed(with_statistics(docs.select("doc_id", "text", "lang", "source")).drop("text")))
    judged = verdicts(stats, estimates(stats))
    return judged.select("doc_id", *COUNTS, "base_failed", "kept", "distance")


def accepted(docs: DataFrame) -> DataFrame:
    """The documents, all columns, that the rules keep.

    Statistics are computed once and stored beside the row, which is never shuffled.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), "text", "lang", "source")
    stats = cut(_keyed(with_statistics(whole).drop("text")))
    return verdicts(stats, estimates(stats)).filter("kept").select("_row.*")
