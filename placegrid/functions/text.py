"""Column expressions that clean and type published text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from placegrid.rules import INT_MAX


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def squeeze(col: Column | str) -> Column:
    """Tabs and no-break spaces to spaces, runs collapsed, trimmed."""
    return F.trim(F.regexp_replace(F.translate(_c(col), "\t\u00a0", "  "), " +", " "))


def clean_text(col: Column | str) -> Column:
    """C-1: squeezed text, a blank as NULL."""
    return F.nullif(squeeze(col), F.lit(""))


def repair_text(col: Column | str, pairs: Sequence[tuple[str, str]]) -> Column:
    """C-2: wrongly decoded sequences replaced from a reviewed list, in list order."""
    out = _c(col)
    for wrong, right in pairs:
        out = F.replace(out, F.lit(wrong), F.lit(right))
    return out


def placeholder_to_null(col: Column | str, placeholders: Sequence[str]) -> Column:
    """C-3: values such as '-' or 'n/a' carry no information."""
    return F.when(~_c(col).isin(*placeholders), _c(col))


def map_label(col: Column | str, labels: Mapping[str, object]) -> Column:
    """C-4/C-11: published label to standard value; an unmapped label is NULL, which the gate reports."""
    pairs = [F.lit(x) for item in labels.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), _c(col))


def label_unmapped(published: Column | str, labels: Mapping[str, object]) -> Column:
    """Q-11: a published label the mapping does not know."""
    return F.coalesce(~_c(published).isin(*labels), F.lit(False))


def map_boolean(col: Column | str, true_labels: Sequence[str], false_labels: Sequence[str]) -> Column:
    """C-5: three-valued, NULL when neither list holds the label."""
    return F.when(_c(col).isin(*true_labels), True).when(_c(col).isin(*false_labels), False)


def strict_int(col: Column | str) -> Column:
    """C-6: digits only, at most nine of them."""
    return F.when(_c(col).rlike("^[0-9]{1,9}$"), _c(col).try_cast("int"))


def integral_decimal(col: Column | str) -> Column:
    """C-7: '5' and '5.0' are whole numbers, '5.5' is not; nothing above the INT range."""
    number = F.when(_c(col).rlike("^[0-9]{1,28}([.][0-9]{1,10})?$"), _c(col).try_cast("decimal(38,10)"))
    return F.when((number == F.floor(number)) & (number <= F.lit(INT_MAX)), number.try_cast("int"))


DOUBLE_PATTERN = "^-?[0-9]+([.][0-9]+)?([eE][-+]?[0-9]{1,3})?$"


def strict_double(col: Column | str) -> Column:
    """C-8: a plain or exponent number, nothing else."""
    return F.when(_c(col).rlike(DOUBLE_PATTERN), _c(col).try_cast("double"))


def strict_decimal(col: Column | str, precision: int, scale: int) -> Column:
    """C-9: exact digits that fit, or NULL; never rounded."""
    fits = f"^-?[0-9]{{1,{precision - scale}}}([.][0-9]{{1,{scale}}})?$"
    return F.when(_c(col).rlike(fits), _c(col).try_cast(f"decimal({precision},{scale})"))


def strict_date(col: Column | str) -> Column:
    """C-9: an ISO date that exists."""
    return F.when(_c(col).rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), _c(col).try_cast("date"))


def null_reason(value: Column | str, published: Column | str, reasons: Mapping[str, str],
                otherwise: str | None = None) -> Column:
    """C-10: why a typed value is NULL, from the published text."""
    said = F.coalesce(map_label(published, reasons), F.lit(otherwise) if otherwise else F.lit(None).cast("string"))
    return F.when(_c(value).isNull(), said)


def pad_code(col: Column | str, lengths: tuple[int, int]) -> Column:
    """C-19: a code that lost leading zeros gets them back; anything malformed is NULL."""
    shortest, full = lengths
    return F.when(_c(col).rlike(f"^[0-9]{{{shortest},{full}}}$"), F.lpad(_c(col), full, "0"))


def has_prefix(col: Column | str, prefix: str) -> Column:
    return F.coalesce(_c(col).startswith(prefix), F.lit(False))


def recode_prefix(col: Column | str, old: str, new: str) -> Column:
    """C-20: units moved to another parent keep their own digits."""
    return F.when(has_prefix(col, old), F.concat(F.lit(new), F.substring(_c(col), len(old) + 1, 1000))).otherwise(_c(col))


def ancestor_code(col: Column | str, digits: int, length: int) -> Column:
    """C-21/I-11: the code of the unit that owns the first ``digits`` positions."""
    return F.rpad(F.substring(_c(col), 1, digits), length, "0")


def inside_parent(child: Column | str, parent: Column | str, digits: int) -> Column:
    """C-22: child code begins with its parent's significant digits (NULL-safe, false when unknown)."""
    return F.coalesce(F.substring(_c(child), 1, digits) == F.substring(_c(parent), 1, digits), F.lit(False))


def coordinate_flag(lon: Column | str, lat: Column | str, box: tuple[float, float, float, float],
                    outside: str = "outside_box") -> Column:
    """C-23: missing, zero, or outside the (west, south, east, north) box; NULL for a usable point."""
    west, south, east, north = box
    lon, lat = _c(lon), _c(lat)
    return (F.when(lon.isNull() | lat.isNull(), "missing").when((lon == 0) & (lat == 0), "zero")
            .when(~(lon.between(west, east) & lat.between(south, north)), outside))


def at_length_cap(col: Column | str, cap: int) -> Column:
    """C-24: published text as long as the field allows may be cut."""
    return F.coalesce(F.length(_c(col)) == cap, F.lit(False))


def any_filled(cols: Sequence[str]) -> Column:
    """C-17: a value is published in at least one of the columns."""
    return F.exists(F.array(*[F.coalesce(_c(c).cast("string"), F.lit("")) for c in cols]), lambda x: x != "")


def any_above(cols: Sequence[str], limit: float) -> Column:
    """C-18: a count above its plausible maximum."""
    return F.exists(F.array(*[F.coalesce(_c(c).cast("double"), F.lit(0.0)) for c in cols]), lambda x: x > limit)


def lenient_sum(cols: Sequence[Column | str]) -> Column:
    """G-8: the parts that are known; NULL only when none is."""
    columns = [_c(c) for c in cols]
    total = sum((F.coalesce(c, F.lit(0)) for c in columns), F.lit(0).cast("bigint"))
    return F.when(F.coalesce(*columns).isNotNull(), total)


def strict_sum(cols: Sequence[Column | str]) -> Column:
    """NULL as soon as one part is."""
    columns = [_c(c).cast("bigint") for c in cols]
    total = columns[0]
    for c in columns[1:]:
        total = total + c
    return total


def count_status(cols: Sequence[str], in_scope: Column | None = None) -> Column:
    """C-25: out_of_scope, no_counts, all_zero or has_learners for a row of counts."""
    total = lenient_sum(cols)
    status = F.when(total.isNull(), "no_counts").when(total == 0, "all_zero").otherwise("has_learners")
    return status if in_scope is None else F.when(in_scope, status).otherwise("out_of_scope")


def total_differs(parts: Sequence[str], published: Column | str) -> Column:
    """C-27: the recomputed total is not the published one (false when none is published)."""
    return F.coalesce(lenient_sum(parts) != _c(published), F.lit(False))


def error_disagrees(estimate: Column, variation: Column, error: Column, tolerance: float = 0.05) -> Column:
    """C-28: a standard error that its estimate and coefficient of variation do not explain."""
    return F.coalesce(F.abs(_c(error) - _c(estimate) * _c(variation) / 100) > tolerance, F.lit(False))


def estimate_status(measures: Sequence[Column | str]) -> Column:
    """C-29: estimated, no_estimate or partial_estimate by which measures are there."""
    missing = sum((_c(m).isNull().cast("int") for m in measures), F.lit(0))
    return (F.when(missing == 0, "estimated").when(missing == len(measures), "no_estimate")
            .otherwise("partial_estimate"))


def footnote(col: Column | str) -> Column:
    """C-34: the trailing marker of a label, such as '2/'."""
    return F.nullif(F.regexp_extract(_c(col), " ([a-z0-9]{1,2}/)$", 1), F.lit(""))


CAPITAL_MARK = "[(] *[Cc][Aa][Pp][Ii][Tt][Aa][Ll] *[)]"


def is_capital(col: Column | str) -> Column:
    """C-34: the label says the place is a capital."""
    return F.coalesce(_c(col).rlike(CAPITAL_MARK), F.lit(False))


def old_names(col: Column | str) -> Column:
    """C-34: bracketed names that are not the capital mark, joined by ', '."""
    rest = F.regexp_replace(F.regexp_replace(_c(col), " ([a-z0-9]{1,2}/)$", ""), " *" + CAPITAL_MARK, "")
    found = F.regexp_extract_all(rest, F.lit("[(] *([^()]*[^() ]) *[)]"), F.lit(1))
    return F.nullif(F.array_join(found, ", "), F.lit(""))


def bare_name(col: Column | str) -> Column:
    """C-34: the label without marker and brackets, upper case."""
    rest = F.regexp_replace(F.regexp_replace(_c(col), " ([a-z0-9]{1,2}/)$", ""), " *[(][^()]*[)]", "")
    return F.nullif(F.upper(F.trim(F.regexp_replace(rest, " +", " "))), F.lit(""))
