"""Reading sessions (E3): role filter, range or page, token budget, detail; messages and one meta row a session."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import presets
from ..functions.schemas import KEY
from . import slicing as S


@dataclass
class Read:
    """What a read gives: the messages in order, the meta row of each session, what the preset hides, and invalid ranges."""

    messages: DataFrame
    meta: DataFrame
    hint: DataFrame
    invalid: DataFrame | None = None


def read_sessions(
    messages: DataFrame,
    roles: str | list[str] | None = None,
    first: int | None = None,
    last: int | None = None,
    before: int | None = None,
    after: int | None = None,
    page: int | None = None,
    query: str | None = None,
    anchor: str = "head",
    budget: int | None = None,
    preset: str | None = None,
    detail: str | None = None,
) -> Read:
    """Roles are filtered first, then comes the page or the range (F3), then the budget.

    A page goes before a range, a search before an anchor, a detail level before a preset. Sessions for which the range is
    invalid are left out and listed in ``invalid``. A page read shows whole messages whatever the detail.
    """
    shown, most = presets.for_read(preset, detail), presets.read_budget(budget)
    listed = S.by_role(messages, roles)
    invalid = None
    if page is not None:
        chosen = S.read_page(listed, page, most, shown)
        meta = S.page_meta(S.costed(listed, shown), chosen, most)
    else:
        totals = messages.groupBy(*KEY).agg(F.count("*").alias("total"))
        places = S.with_position(listed.select(*KEY, "idx"))
        invalid = S.invalid_ranges(places, totals, first, last, before, after)
        ranged = S.in_range(places, totals, first, last, before, after).select(*KEY, "idx")
        listed = listed.join(ranged, [*KEY, "idx"])
        anchor = "search" if query else anchor
        chosen = S.slice_sessions(listed, most, anchor, query, shown)
        meta = S.slice_meta(S.costed(listed, shown, query), chosen, most, anchor)
    got = listed.join(chosen.select(*KEY, "idx"), [*KEY, "idx"])
    told = S.project_detail(got, detail) if detail and page is None else got
    return Read(told, meta, S.detail_hint(got, shown), invalid)
