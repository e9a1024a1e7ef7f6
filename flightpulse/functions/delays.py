"""Delay minutes and delay categories of one flight, as SQL expressions."""

from __future__ import annotations

from ..vocabulary import (
    CATEGORY_BEYOND_BANDS,
    CATEGORY_NO_ACTUAL,
    CATEGORY_NO_SCHEDULE,
    DELAY_BANDS,
    NEXT_DAY_ABOVE_MIN,
)


def delay_minutes(scheduled: str, actual: str) -> str:
    """Whole minutes from scheduled to actual, half away from zero, BIGINT.

    ``unix_timestamp`` of a TIMESTAMP_NTZ is a plain division of the stored
    value, so neither the session time zone nor calendar objects take part.
    """
    seconds = f"(unix_timestamp({actual}) - unix_timestamp({scheduled}))"
    return (
        f"CASE WHEN {seconds} < 0 THEN -((30 - {seconds}) div 60) "
        f"ELSE ({seconds} + 30) div 60 END"
    )


def delay_category(scheduled: str, actual: str, delay: str) -> str:
    bands = " ".join(f"WHEN {delay} < {upper} THEN '{name}'" for upper, name in DELAY_BANDS)
    return (
        f"CASE WHEN {actual} IS NULL THEN '{CATEGORY_NO_ACTUAL}' "
        f"WHEN {scheduled} IS NULL THEN '{CATEGORY_NO_SCHEDULE}' "
        f"{bands} ELSE '{CATEGORY_BEYOND_BANDS}' END"
    )


def is_next_day(delay: str) -> str:
    return f"coalesce({delay} > {NEXT_DAY_ABOVE_MIN}, false)"
