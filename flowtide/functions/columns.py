"""Built-in expressions only, so that all of them stay inside codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowtide import schema as S

# How a UTF-8 replacement mark reads after a Latin-1 decode.
_BROKEN_DASH = "ï¿½"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_label(label: Column | str) -> Column:
    """Lower-case key with broken dashes, dashes and runs of blanks folded to one blank."""
    text = F.lower(_c(label).cast("string"))
    text = F.replace(text, F.lit(_BROKEN_DASH), F.lit(" "))
    text = F.replace(text, F.lit("-"), F.lit(" "))
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def inf_to_null(c: Column | str) -> Column:
    c = _c(c)
    return F.when(F.abs(c) != F.lit(float("inf")), c).when(F.isnan(c), c)


def zero_if_missing(c: Column | str) -> Column:
    """Live policy: null, NaN and both infinities become 0.0."""
    c = _c(c).cast("double")
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(0.0)).otherwise(c)


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch; the session runs in UTC."""
    return F.unix_micros(_c(ts).cast("timestamp"))


def parse_timestamp(c: Column | str, fmt: str = "dd/MM/yyyy HH:mm:ss") -> Column:
    """Day-first parse; text that does not parse becomes null."""
    return F.try_to_timestamp(_c(c), F.lit(fmt))


def tumbling_floor(ts: Column | str, width: str = "5 minutes") -> Column:
    return F.window(_c(ts), width)["start"]


def class_code(label: Column | str) -> Column:
    """Fixed class code; an unknown class counts as benign (0)."""
    c = _c(label)
    out = F.when(c == S.CLASSES[0], 0)
    for name in S.CLASSES[1:]:
        out = out.when(c == name, S.CLASS_CODES[name])
    return out.otherwise(0).cast("int")


def class_name(code: Column | str) -> Column:
    return F.get(F.array(*[F.lit(n) for n in S.CLASSES]), _c(code).cast("int"))


def binary_target(label: Column | str, positive: str = S.DOS) -> Column:
    return F.coalesce((_c(label) == positive).cast("int"), F.lit(0))


def decide(score: Column | str, threshold: float = 0.5, strict: bool = True) -> Column:
    """1 where the score passes the threshold; NaN does not, null stays null."""
    c = _c(score)
    return (((c > threshold) if strict else (c >= threshold)) & ~F.isnan(c)).cast("int")


def predict_class(probs: Column | str) -> Column:
    """Struct of class and confidence of the largest probability, first one on ties.

    NaN does not compete; both fields are null where no number is left.
    """
    p = _c(probs)
    # NaN counts as the largest number, so only rows that hold one are rebuilt
    numbers = F.when(F.isnan(F.array_max(p)), F.transform(p, lambda x: F.when(~F.isnan(x), x))).otherwise(p)
    at = (F.array_position(numbers, F.array_max(numbers)) - 1).cast("int")
    return F.struct(class_name(at).alias("predicted_class"), F.array_max(numbers).alias("confidence"))


def severity(tier1_hit: Column, predicted: Column) -> Column:
    """CRITICAL, HIGH, MEDIUM, or null where no alert is due."""
    return (
        F.when(tier1_hit, "CRITICAL")
        .when(predicted.isin(S.HIGH_SEVERITY), "HIGH")
        .when(predicted != S.BENIGN, "MEDIUM")
    )


def hash_key(row_id: Column | str, seed: int) -> Column:
    """Reproducible random order of rows: md5 over id and seed."""
    return F.md5(F.concat_ws("|", _c(row_id).cast("string"), F.lit(str(seed))))


def hash_unit(row_id: Column | str, seed: int) -> Column:
    """Reproducible uniform number in [0, 1)."""
    head = F.conv(F.substring(hash_key(row_id, seed), 1, 8), 16, 10).cast("double")
    return head / F.lit(4294967296.0)
