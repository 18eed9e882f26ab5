"""Composable predicates over speeches. Every leaf is two-valued (null counts as false) so that ``~`` is safe."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Spec:
    """A predicate; combine with & | ~ and give ``column`` to ``filter``, so it is pushed down."""

    column: Column

    def __and__(self, other: Spec) -> Spec:
        return Spec(self.column & other.column)

    def __or__(self, other: Spec) -> Spec:
        return Spec(self.column | other.column)

    def __invert__(self) -> Spec:
        return Spec(~self.column)


def _leaf(c: Column) -> Spec:
    return Spec(F.coalesce(c, F.lit(False)))


def speaker_name(part: str, c: str = "name") -> Spec:
    return _leaf(F.lower(F.col(c)).contains(part.lower()))


def date_range(start: str, end: str, c: str = "speech_date") -> Spec:
    return _leaf(F.col(c).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def institution(code: str, c: str = "code", fallback: str | None = None) -> Spec:
    own = F.coalesce(F.col(c), F.col(fallback)) if fallback else F.col(c)
    return _leaf(F.upper(own) == code.upper())


def stance(value: str, c: str = "stance") -> Spec:
    return _leaf(F.col(c) == value)


def score_range(low: float, high: float, c: str = "score") -> Spec:
    return _leaf(F.col(c).between(low, high))


def status(value: str, c: str = "status") -> Spec:
    return _leaf(F.col(c) == value)


def tag(part: str, c: str = "tags") -> Spec:
    return _leaf(F.exists(F.col(c), lambda t: F.lower(t).contains(part.lower())))


def topic(part: str, c: str = "topics") -> Spec:
    return tag(part, c)


def word_count(low: int, high: int, c: str = "word_count") -> Spec:
    return _leaf(F.coalesce(F.col(c), F.lit(0)).between(low, high))


def confidence_at_least(least: float, c: str = "confidence") -> Spec:
    return _leaf(F.col(c) >= least)


def uncertainty_range(low: float, high: float, c: str = "uncertainty") -> Spec:
    return _leaf(F.col(c).between(low, high))


def has_analysis(c: str = "score") -> Spec:
    return Spec(F.col(c).isNotNull())


def has_content(c: str = "text") -> Spec:
    return _leaf(F.trim(F.col(c)) != "")


def validation_status(value: str, c: str = "validation_status") -> Spec:
    return _leaf(F.lower(F.col(c)) == value.lower())


def recent(days: int, as_of: str, c: str = "speech_date") -> Spec:
    return _leaf(F.col(c) >= F.date_sub(F.lit(as_of).cast("date"), days))


# Presets.
def analysed() -> Spec:
    return has_analysis()


def high_confidence() -> Spec:
    return confidence_at_least(0.8)


def hawkish() -> Spec:
    return stance("hawkish")


def dovish() -> Spec:
    return stance("dovish")


def recent_of(code: str, as_of: str, days: int = 30) -> Spec:
    return institution(code) & recent(days, as_of)


def analysed_hawkish() -> Spec:
    return analysed() & hawkish()
