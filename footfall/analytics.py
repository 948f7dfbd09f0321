"""All queries of one project behind one object."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from footfall.operators import funnel, identity, listings, retention, segmentation, sessions
from footfall.operators.scope import Dedup
from footfall.plans.requests import (
    FunnelQuery,
    ListingQuery,
    RetentionQuery,
    SegmentationQuery,
    SessionsQuery,
)


@dataclass(frozen=True)
class ProjectAnalytics:
    """Queries over the events of one project.

    ``links`` is a stored table of identity links; without it the links are found in ``events``
    by each query, over all time. ``dedup`` may name the months compaction has settled.
    """

    events: DataFrame
    project_id: str
    links: DataFrame | None = None
    dedup: Dedup = True

    @property
    def _source(self) -> tuple[DataFrame, str]:
        return self.events, self.project_id

    def segmentation(self, query: SegmentationQuery, approximate: bool = False) -> DataFrame:
        return segmentation.segmentation(
            *self._source, query, self.links, self.dedup, approximate
        )

    def funnel(self, query: FunnelQuery, stretch: int | None = None) -> DataFrame:
        return funnel.funnel(*self._source, query, self.links, self.dedup, stretch)

    def retention(self, query: RetentionQuery) -> DataFrame:
        return retention.retention(*self._source, query, self.links, self.dedup)

    def sessions(self, query: SessionsQuery) -> DataFrame:
        return sessions.session_report(*self._source, query, self.links, self.dedup)

    def session_totals(self, query: SessionsQuery) -> DataFrame:
        return sessions.session_totals(*self._source, query, self.links, self.dedup)

    def event_names(self, query: ListingQuery) -> DataFrame:
        return listings.event_names(*self._source, query)

    def violation_counts(self, query: ListingQuery) -> DataFrame:
        return listings.violation_counts(*self._source, query)

    def identity_links(self) -> DataFrame:
        # Stored links have one part for each micro-batch that saw the pair.
        links = identity.identity_links(self.events) if self.links is None else identity.merge_links(self.links)
        return identity.list_links(links, self.project_id)
