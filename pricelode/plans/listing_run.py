"""One complete run over a batch of listings, from requirements to alerts.

The steps are lazy DataFrames; tables are written only where results are kept
(state, log, alerts) or where the grouping cuts its lineage.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelode.config import Params, RequirementParams, WatchRule
from pricelode.operators import clean, cluster, extract, funnel, history, market, score, state, trend
from pricelode.schema import LISTING, conform
from pricelode.session import materialize
from pricelode.sources import observation_log, records
from pricelode.sources.state_store import StateStore


@dataclass(frozen=True)
class RunResult:
    listings: DataFrame
    candidates: DataFrame
    alerts: DataFrame
    statistics: DataFrame
    trends: DataFrame


@dataclass(frozen=True)
class PageSource:
    """Search pages (``page_id``, ``html``) of a site for one model.

    Without ``details`` the pages hold labelled cards; with them they hold links, and the facts are on the
    detail pages (``page_id``, ``url``, ``html``).
    """

    name: str
    rule: WatchRule
    pages: DataFrame
    base: str = ""
    details: DataFrame | None = None

    def listings(self, params: RequirementParams) -> DataFrame:
        if self.details is None:
            found = extract.card_listings(extract.cards(self.pages, self.rule, self.base), self.rule, self.name)
            return extract.complete(found, params, "full_title")
        found = extract.slugs(self.pages, self.rule, self.base)
        return extract.complete(extract.slug_listings(found, self.details, self.rule, self.name), params)


def listings_of_pages(sources: list[PageSource], params: RequirementParams) -> DataFrame:
    """Listings of all sources, in the order of the sources, pages and places on them (``seq``)."""
    tables = {f"{i}": s.listings(params) for i, s in enumerate(sources)}
    rows = records.union_sources(tables, list(tables))
    return conform(rows.withColumn("seq", F.struct("source_rank", "page_id", "pos")), LISTING).select(*LISTING.fieldNames(), "seq")


def run_pages(
    sources: list[PageSource], store: StateStore, log_root: str, as_of: Column, run_ts: Column,
    params: Params | None = None, run_id: str | None = None,
) -> RunResult:
    """:func:`run` from search pages to alerts."""
    params = params or Params()
    found = materialize(listings_of_pages(sources, params.requirements), "page-listings")
    return run(found, store, log_root, as_of, run_ts, params, run_id)


def run(
    listings: DataFrame, store: StateStore, log_root: str, as_of: Column, run_ts: Column,
    params: Params | None = None, run_id: str | None = None,
) -> RunResult:
    """Process ``listings``; state and log below the given places are advanced.

    A run that is repeated under its ``run_id`` replaces its log records.
    """
    params, run_id = params or Params(), run_id or uuid.uuid4().hex
    spark = listings.sparkSession
    kept = clean.meets_requirements(listings, params.requirements)
    unique = cluster.survivors(kept, params.matching, nested=False)

    rows, after = state.update_state(unique, store.load(), as_of, params.state)
    rows = materialize(rows.withColumn("listing_key", history.observation_key()), "run-listings")
    after = materialize(after, "run-state")

    # History describes earlier runs; the trend includes this one.
    observation_log.append(observation_log.listing_records(rows, run_ts), log_root, params.trend.timezone, f"{run_id}-listings")
    log = observation_log.scan_log(spark, log_root)
    own = observation_log.scan_log(spark, log_root, rows.select("listing_key"))
    rows = history.with_history(rows, history.history_metrics(own, run_ts))
    trends = trend.trend_table(log, params.trend)
    rows = trend.with_trend(rows, trends, params.trend)

    valued = market.value_listings(rows, as_of, params.market, details=True)
    staged = funnel.stages(score.with_score(valued, params.score), params.score)
    staged = score.with_display_title(staged, params.requirements.watch_list)
    staged = materialize(staged, "run-staged")
    observation_log.append(
        observation_log.valuation_records(
            staged.filter(~F.col("stage").isin("leasing", "mileage", "valuation_error")), run_ts
        ),
        log_root, params.trend.timezone, f"{run_id}-values",
    )

    decided = materialize(
        state.alert_decisions(staged.filter("stage = 'sent'"), after, params.state), "run-decisions"
    )
    staged = funnel.with_alert_decisions(staged, decided)
    sent = decided.filter("alert")
    store.write(state.mark_alerted(after, sent))
    return RunResult(
        listings=staged,
        candidates=funnel.candidate_records(staged, as_of, params.market, params.score),
        alerts=score.alert_messages(sent),
        statistics=funnel.statistics(staged, params.score),
        trends=trends,
    )
