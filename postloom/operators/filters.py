"""Row filters on postings and jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom import schemas
from postloom.functions.text import col, norm, nz, strip, words


def _target(terms: Sequence[str]) -> list[str]:
    return sorted({t.strip().lower() for t in terms if t.strip()})


def _lit_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def _tags(stack: Column | str) -> Column:
    tags = F.coalesce(col(stack), F.array().cast("array<string>"))
    return F.array_compact(F.transform(tags, lambda t: strip(F.lower(t))))


def stack_overlap(target: Sequence[str], stack: Column | str = "stack", role: Column | str = "role") -> Column:
    """Tags or words of the role meet the target; an empty target passes everything."""
    wanted = _target(target)
    if not wanted:
        return F.lit(True)
    return F.arrays_overlap(F.concat(_tags(stack), words(F.lower(nz(role)))), _lit_array(wanted))


def stack_filter(df: DataFrame, target: Sequence[str]) -> DataFrame:
    return df.where(stack_overlap(target))


def stack_matches(target: Sequence[str], stack: Column | str = "stack", lenient: bool = False) -> Column:
    """Tags alone meet the target; ``lenient`` also passes postings without tags."""
    wanted = _target(target)
    if not wanted:
        return F.lit(True)
    test = F.arrays_overlap(_tags(stack), _lit_array(wanted))
    if lenient:
        test = test | (F.coalesce(F.size(col(stack)), F.lit(0)) <= 0)
    return test


def role_matches(target_role: str, role: Column | str = "role") -> Column:
    """Any word of the target occurs inside the lower-case role; an empty target passes."""
    wanted = target_role.lower().split()
    if not target_role:
        return F.lit(True)
    low = F.lower(nz(role))
    test = F.lit(False)
    for word in wanted:
        test = test | F.contains(low, F.lit(word))
    return test


def check_choice(value: str | None, allowed: Sequence[str], what: str) -> None:
    """Refuse an unknown status, order or template before a plan is made."""
    if value and value not in allowed:
        raise ValueError(f"{what} must be one of {', '.join(allowed)}: {value!r}")


def split_guarded(df: DataFrame, column: str, allowed: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with an allowed value, and the rest for quarantine."""
    good = F.coalesce(F.col(column).isin(*allowed), F.lit(False))
    return df.where(good), df.where(~good)


def job_predicate(
    role: str | None = None, stack: Sequence[str] | str | None = None, status: str | None = None
) -> Column:
    """AND of the given filters. ``role`` is a substring pattern, ``stack`` must all be present."""
    check_choice(status, schemas.JOB_STATUSES, "status")
    test = F.lit(True)
    if status:
        test = test & (F.col("status") == status)
    if role:
        test = test & F.col("role").ilike(f"%{role}%")
    if isinstance(stack, str):
        stack = [s.strip() for s in stack.split(",")] if stack else None
    if stack:
        for tag in stack:
            test = test & F.coalesce(F.array_contains("stack", tag), F.lit(False))
    return test
