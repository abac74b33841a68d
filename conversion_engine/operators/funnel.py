"""Funnel counting: events to days, days to windows after the install.

A ``FunnelSpec`` says which events belong to a funnel step and what to count.
Any number of specs is counted in one pass over the event log:

1. one row per (day, profile, user key) with partial counts,
2. missing profiles are looked up by user key,
3. one row per (day, profile).

After step 3 a profile has at most one row per calendar day, which bounds
every later join, however many events the profile has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from conversion_engine.functions.semantics import (
    DAY_BUCKETS,
    FULL_WINDOW,
    Bucket,
    ColumnLike,
    as_col,
    day_buckets,
    day_offset,
    div0,
    flag,
    like_any,
)
from conversion_engine.operators.identity import resolve_identity
from conversion_engine.operators.joins import banded_join

DAY, PROFILE, USER = "event_date", "profile_id", "user_key"
SEARCH = "search"


@dataclass(frozen=True)
class Measure:
    """A number per day: ``sum``, ``avg`` or ``any`` (1 if it happened that day)."""

    name: str
    expr: Column
    kind: str = "sum"


@dataclass(frozen=True)
class FunnelSpec:
    """Events of one funnel step and what to count on them.

    With ``distinct_on`` events of one user and day that agree in these columns
    count once; the measures then read those columns through the ``search``
    struct. ``by`` names those of them that ``late`` measures need: the distinct
    events are first counted per day, profile and ``by``, and the late measures
    read these counts.
    """

    name: str
    where: Column
    measures: tuple[Measure, ...]
    distinct_on: tuple[str, ...] = ()
    by: tuple[str, ...] = ()
    late: tuple[Measure, ...] = ()
    events: tuple[str, ...] = ()
    any_case: bool = False
    texts: tuple[str, ...] = ()


def event_filter(specs: Iterable[FunnelSpec], parameters: str = "event_parameters") -> Column | None:
    """A condition on raw columns that all events of ``specs`` meet; None if one of them says nothing about them.

    An event of a spec has one of its ``events`` as name, or one of its ``texts`` in the unparsed parameters. A letter
    written as an escape there is as good as any.
    """
    specs = list(specs)
    if not all(s.events or s.texts for s in specs):
        return None
    met = []
    names = {e for s in specs for e in s.events}
    if names and any(s.any_case for s in specs):
        met.append(F.lower("event_name").isin(*sorted({e.lower() for e in names})))
    elif names:
        met.append(F.col("event_name").isin(*sorted(names)))
    texts = sorted({t for s in specs for t in s.texts})
    met += [F.col(parameters).contains(t) for t in [*texts, "\\u"]] if texts else []
    return reduce(lambda a, b: a | b, met) if met else None


def _partials(spec: FunnelSpec, where: Column | None = None) -> list[Column]:
    out = []
    for m in spec.measures:
        value = F.when(spec.where if where is None else where, m.expr)
        if m.kind == "avg":
            out += [F.sum(value.cast("double")).alias(f"{m.name}__sum"), F.count(value).alias(f"{m.name}__n")]
        else:
            out.append((F.sum if m.kind == "sum" else F.max)(value).alias(m.name))
    return out


def _merged(spec: FunnelSpec, final: bool, copies: Column | None = None) -> list[Column]:
    def total(column: Column | str) -> Column:
        column = as_col(column)
        return F.sum(column if copies is None else column * copies)

    out = []
    for m in spec.measures:
        if m.kind == "avg":
            value, n = total(f"{m.name}__sum"), total(f"{m.name}__n")
            out += [F.try_divide(value, n).alias(m.name)] if final else [
                value.alias(f"{m.name}__sum"), n.alias(f"{m.name}__n")]
        else:
            out.append((total(m.name) if m.kind == "sum" else F.max(m.name)).alias(m.name))
    return out + [total(m.expr).alias(m.name) for m in spec.late if final]


def _found(specs: Iterable[FunnelSpec], distinct: FunnelSpec | None) -> Column:
    """Does a row count anything? Events whose condition holds may still lack every measure."""
    names = [m.name for s in specs for m in s.measures if m.kind != "avg"] + ([SEARCH] if distinct else [])
    return reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in names])


def daily_partials(events: DataFrame, specs: Iterable[FunnelSpec], distinct: FunnelSpec | None = None) -> DataFrame:
    """Partial counts of all specs per (day, profile, user key), and per distinct event of ``distinct``.

    Rows of a day depend on that day's events alone, so they can be kept by day and merged later (``merged_days``).
    """
    specs, keys = list(specs), [DAY, PROFILE, USER]
    wanted = [s.where for s in specs] + ([distinct.where] if distinct is not None else [])
    rows = events.where(reduce(lambda a, b: a | b, wanted))
    if distinct is not None:
        rows = rows.withColumn(SEARCH, F.when(distinct.where, F.struct(*distinct.distinct_on)))
        keys = [*keys, SEARCH]
    counts = [c for s in specs for c in _partials(s)]
    partial = rows.groupBy(*keys).agg(*counts) if counts else rows.select(*keys).distinct()
    return partial.where(_found(specs, distinct))


def merged_days(partial: DataFrame, specs: Iterable[FunnelSpec], user_map: DataFrame | None = None,
                distinct: FunnelSpec | None = None, enrich: Callable[[DataFrame], DataFrame] | None = None,
                profiles: DataFrame | None = None) -> DataFrame:
    """Measures per (day, profile) from partial counts, which may hold those of further specs.

    See ``daily_rollup`` for the arguments.
    """
    specs, keys = list(specs), [DAY, PROFILE, USER] + ([SEARCH] if distinct is not None else [])
    partial = partial.where(_found(specs, distinct))
    if user_map is not None:
        spread = [DAY, USER] + ([SEARCH] if distinct is not None else [])
        partial = resolve_identity(partial, user_map, spread)
    if profiles is not None:
        known = profiles.select(F.col(PROFILE).alias("__wanted"))
        partial = partial.join(known, F.col(PROFILE).try_cast("bigint") == F.col("__wanted"), "left_semi")
    finals = [c for s in specs for c in _merged(s, final=True)]
    if distinct is None:
        return partial.groupBy(DAY, PROFILE).agg(*finals)
    # Once more distinct, now that logged-out events have their profile.
    merged = [c for s in specs for c in _merged(s, final=False)]
    partial = partial.groupBy(*keys).agg(*merged) if merged else partial.select(*keys).distinct()
    by = [F.col(SEARCH).getField(c).alias(c) for c in distinct.by]
    per_place = partial.groupBy(DAY, PROFILE, *by).agg(
        *_partials(distinct, F.col(SEARCH).isNotNull()), *merged)
    copies = None
    if enrich is not None:
        per_place, copies = enrich(per_place), F.col("copies")
    return per_place.groupBy(DAY, PROFILE).agg(*_merged(distinct, final=True, copies=copies), *finals)


def daily_rollup(events: DataFrame, specs: Iterable[FunnelSpec], user_map: DataFrame | None = None,
                 distinct: FunnelSpec | None = None,
                 enrich: Callable[[DataFrame], DataFrame] | None = None,
                 profiles: DataFrame | None = None) -> DataFrame:
    """Measures of all specs per (day, profile); NULL where a spec has no event that day.

    ``distinct`` is one spec with ``distinct_on``. ``enrich`` adds the columns its
    late measures need, among them ``copies``, to rows per day, profile and
    ``by`` columns; how often a distinct event counts is up to ``copies``.
    Events of no spec go before the first aggregation, profiles that are not in ``profiles``
    (numbers, in a column of the profile's name) as soon as logged-out events have theirs.
    """
    specs = list(specs)
    return merged_days(daily_partials(events, specs, distinct), specs, user_map, distinct, enrich, profiles)


# --- trip type -------------------------------------------------------------


def trip_type(country: ColumnLike, region: ColumnLike, home_country: ColumnLike, home_region: ColumnLike) -> Column:
    """How far a searched destination is from the user's home country."""
    def low(c):
        return F.lower(as_col(c))

    return (
        F.when(low(country) == low(home_country), "domestic")
        .when(low(region) == low(home_region), "short-haul")
        .when(low(region) != low(home_region), "long-haul")
        .otherwise("not-defined")
    )


# --- the funnels -----------------------------------------------------------

# Names, page types and actions of the app's event log.
SEARCH_COLUMNS = ("arrival_date", "departure_date", "destination_city", "destination_country",
                  "lead_time", "number_guests")
SEARCH_STEP_ACTIONS = ("Search Activated", "Search Step", "Invalid Destination Displayed", "Destination Selected")
PROPERTY_ACTIONS = {
    "property_page_map_clicks": ("Map View Clicked",),
    "add_to_wish_list_clicks": ("Added to Wishlist Clicked",),
    "propt_read_more_clicks": ("About Read More Clicked",),
    "propt_house_rules_clicks": ("View All House Rules Clicked",),
    "propt_facilities_clicks": ("View All Facilities Clicked",),
    "propt_reviews_clicks": ("View Main Reviews Clicked", "View All Reviews Clicked"),
}
CHECKOUT_STEPS = {
    "started_email_step_count": "email",
    "started_name_step_count": "full_name",
    "started_nationality_step_count": "nationality",
    "started_payment_details_step_count": "payment_details",
    "started_confirm_details_step_count": "confirm_details",
}

# The funnels of ``count_specs``.
COUNT_FUNNELS = ("search_steps", "destination_pages", "sort_filter", "recent_search", "property_views",
                 "property_actions", "linkups", "checkout_starts", "checkout_steps")


def search_spec() -> FunnelSpec:
    """Submitted searches; identical searches of a user on a day count once.

    The trip counts need a ``trip`` column from ``enrich``.
    """
    los = F.datediff(F.col(f"{SEARCH}.departure_date"), F.col(f"{SEARCH}.arrival_date"))
    trip, searches = F.col("trip"), F.col("searches_submitted")
    return FunnelSpec(
        "search",
        (F.col("action") == "Search Submitted") & F.col("destination_country").isNotNull(),
        (
            Measure("searches_submitted", F.lit(1)),
            Measure("search_avg_lead_time", F.col(f"{SEARCH}.lead_time").try_cast("double"), "avg"),
            Measure("search_avg_los", los, "avg"),
            Measure("search_avg_pax", F.col(f"{SEARCH}.number_guests"), "avg"),
        ),
        texts=("Search Submitted",),
        distinct_on=SEARCH_COLUMNS,
        by=("destination_country",),
        late=(
            Measure("search_domestic_trip", searches * flag(trip == "domestic")),
            Measure("search_short_haul_trip", searches * flag(trip == "short-haul")),
            Measure("search_long_haul_trip", searches * flag(trip == "long-haul")),
        ),
    )


def count_specs() -> dict[str, FunnelSpec]:
    """The funnels that count every event, by name."""
    action, step, page = F.col("action"), F.col("step_name"), F.col("page_type")
    name, category, rooms = F.col("event_name"), F.col("item_category"), F.col("checkout_room_types")
    has_country = F.col("destination_country").isNotNull()
    one = F.lit(1)
    in_checkout = name == "begin_checkout"
    labels = [label for group in PROPERTY_ACTIONS.values() for label in group]
    specs = [
        FunnelSpec(
            "search_steps", (page == "Search") & action.isin(*SEARCH_STEP_ACTIONS),
            (
                Measure("search_activated_count", flag(action == "Search Activated")),
                Measure("started_destn_step_count", flag((action == "Search Step") & (step == "destination"))),
                Measure("invalid_destn_displayed_count", flag(action == "Invalid Destination Displayed")),
                Measure("destn_selected_step_count", flag((action == "Destination Selected") & (step == "destination"))),
                Measure("started_dates_step_count", flag((action == "Search Step") & (step == "dates"))),
                Measure("started_guests_step_count", flag((action == "Search Step") & (step == "guests"))),
            ), texts=SEARCH_STEP_ACTIONS),
        FunnelSpec(
            "destination_pages",
            (name == "Destination_Search_Page_Viewed") & (page == "Destination Search") & has_country,
            (
                Measure("destination_search_pages_viewed", one),
                Measure("avg_number_properties_returned", F.col("number_results"), "avg"),
            ), events=("Destination_Search_Page_Viewed",)),
        FunnelSpec(
            "sort_filter",
            (name == "Destination_Search_Page_Event") & action.isin("Filter Used", "Sort Used") & has_country,
            (
                Measure("filter_used_count", flag(action == "Filter Used")),
                Measure("sort_used_count", flag(action == "Sort Used")),
            ), events=("Destination_Search_Page_Event",)),
        FunnelSpec(
            "recent_search",
            (name == "Homepage_Event") & (page == "Homepage") & (action == "Home Panel Clicked")
            & F.col("panel_clicked").ilike("Searches%"),
            (Measure("recent_search_clicks", one),), events=("Homepage_Event",)),
        FunnelSpec(
            "property_views", name.ilike("view_item"),
            (
                Measure("property_page_views", one),
                Measure("hostels_viewed", flag(category.ilike("%hostel%"))),
                Measure("non_hostels_viewed", flag(~category.ilike("%hostel%"))),
                Measure("viewed_property_avg_position", F.col("position").try_cast("double"), "avg"),
            ), events=("view_item",), any_case=True),
        FunnelSpec(
            "property_actions",
            (name == "Property_Details_Page_Event") & (page == "Property Details")
            & like_any(action, labels, ignore_case=True),
            # The event filter ignores letter case, the single actions do not.
            tuple(Measure(out, flag(action.isin(*group)), "any") for out, group in PROPERTY_ACTIONS.items()),
            events=("Property_Details_Page_Event",)),
        FunnelSpec(
            "linkups", (page == "Linkups View") & (name == "Property_Details_Linkups_View"),
            (Measure("linkups_view_propt_page", one),), events=("Property_Details_Linkups_View",)),
        FunnelSpec(
            "checkout_starts", name.ilike("begin_checkout"),
            (Measure("checkout_starts", one),), events=("begin_checkout",), any_case=True),
        FunnelSpec(
            "checkout_steps",
            (action == "Checkout Step Viewed") | name.isin("begin_checkout", "Checkout_Confirm_Clicked"),
            (
                Measure("checkout_dorms_selected_count", flag(in_checkout & rooms.ilike("%dorm%"))),
                Measure("checkout_privates_selected_count", flag(in_checkout & ~rooms.ilike("%dorm%"))),
                Measure("checkout_hostels_selected_count", flag(in_checkout & category.ilike("%hostel%"))),
                Measure("checkout_non_hostels_selected_count", flag(in_checkout & ~category.ilike("%hostel%"))),
                *[Measure(out, flag(step == value)) for out, value in CHECKOUT_STEPS.items()],
                Measure("checkout_confirm_clicked_count", flag(name == "Checkout_Confirm_Clicked")),
            ), events=("begin_checkout", "Checkout_Confirm_Clicked"), texts=("Checkout Step Viewed",)),
    ]
    return {s.name: s for s in specs}


# --- windows ---------------------------------------------------------------


@dataclass(frozen=True)
class WindowSpec:
    """What to report of a funnel over the window after the install."""

    funnel: str
    present: str
    first_date: str | None = None
    first_offset: str | None = None
    bucket_suffix: str | None = None
    totals: tuple[str, ...] = ()
    means: tuple[str, ...] = ()
    shares: Mapping[str, tuple[str, str]] = field(default_factory=dict)


# The names of the report's columns, per funnel.
WINDOW_SPECS = {
    s.funnel: s
    for s in (
        WindowSpec("search", "searches_submitted", "first_search_post_install", "days_to_first_search_post_install",
                   "searches_made", ("search_domestic_trip", "search_short_haul_trip", "search_long_haul_trip"),
                   ("search_avg_lead_time", "search_avg_los", "search_avg_pax"),
                   {"search_domestict_trip_share": ("search_domestic_trip", "searches_submitted"),
                    "search_short_haul_trip_share": ("search_short_haul_trip", "searches_submitted"),
                    "search_long_haul_trip_share": ("search_long_haul_trip", "searches_submitted")}),
        WindowSpec("search_steps", "search_activated_count",
                   totals=("search_activated_count", "started_destn_step_count", "invalid_destn_displayed_count",
                           "destn_selected_step_count", "started_dates_step_count", "started_guests_step_count")),
        WindowSpec("destination_pages", "destination_search_pages_viewed", "first_dstn_search_page_viewed_date",
                   "days_to_first_dstn_search_page_viewed", totals=("destination_search_pages_viewed",),
                   means=("avg_number_properties_returned",)),
        WindowSpec("sort_filter", "filter_used_count", "first_sort_or_filter_date",
                   totals=("filter_used_count", "sort_used_count")),
        WindowSpec("recent_search", "recent_search_clicks", "first_recent_search_date",
                   "days_to_first_recent_search_days", totals=("recent_search_clicks",)),
        WindowSpec("property_views", "property_page_views", "first_prop_view_post_install_date",
                   "days_to_first_prop_view_post_install", "property_views",
                   ("hostels_viewed", "non_hostels_viewed"), ("viewed_property_avg_position",),
                   {"share_hostels_viewed": ("hostels_viewed", "property_page_views"),
                    "share_non_hostels_viewed": ("non_hostels_viewed", "property_page_views")}),
        WindowSpec("linkups", "linkups_view_propt_page", "first_linkup_view_date", "first_linkup_view_days",
                   totals=("linkups_view_propt_page",)),
        WindowSpec("checkout_starts", "checkout_starts", "first_checkout_start_post_install", None,
                   "checkout_starts"),
        WindowSpec("checkout_steps", "checkout_confirm_clicked_count",
                   totals=("checkout_dorms_selected_count", "checkout_privates_selected_count",
                           "checkout_hostels_selected_count", "checkout_non_hostels_selected_count",
                           *CHECKOUT_STEPS, "checkout_confirm_clicked_count")),
    )
}
# First date and offset of every property action.
ACTION_DATES = {
    "property_page_map_clicks": ("first_prop_map_view_post_install_date", "first_prop_map_view_post_install_days"),
    "add_to_wish_list_clicks": ("first_whishlist_click_date", "first_whishlist_click_days"),
    "propt_read_more_clicks": ("first_propt_read_more_date", "first_propt_read_more_days"),
    "propt_house_rules_clicks": ("first_house_rules_click_date", "first_house_rules_click_days"),
    "propt_facilities_clicks": ("first_propt_facilities_click_date", "first_propt_facilities_click_days"),
    "propt_reviews_clicks": ("first_propt_reviews_click_date", "first_propt_reviews_click_days"),
}
BUCKETS: tuple[Bucket, ...] = (*DAY_BUCKETS, FULL_WINDOW)


def window_columns(spec: WindowSpec, offset: Column, copies: Column | None = None) -> list[Column]:
    """Aggregates of one funnel over its days in the window.

    ``copies`` repeats a day row that many times in every sum.
    """
    def times(column: str) -> Column:
        return F.col(column) if copies is None else F.col(column) * copies

    out = []
    if spec.first_date:
        out.append(F.min(F.when(F.col(spec.present).isNotNull(), F.col(DAY))).alias(spec.first_date))
    if spec.bucket_suffix:
        out += day_buckets(offset, times(spec.present), spec.bucket_suffix, BUCKETS)
    out += [F.sum(times(m)).alias(m) for m in spec.totals]
    out += [F.avg(m).alias(m) for m in spec.means]
    out += [div0(F.sum(n), F.sum(d)).alias(name) for name, (n, d) in spec.shares.items()]
    return out


def action_columns(copies: Column | None = None) -> list[Column]:
    """First day and number of days of every property action."""
    out = []
    for clicks, (first, _) in ACTION_DATES.items():
        out.append(F.min(F.when(F.col(clicks) == 1, F.col(DAY))).alias(first))
        out.append(F.sum(F.col(clicks) if copies is None else F.col(clicks) * copies).alias(clicks))
    return out


def _with_offsets(df: DataFrame, offsets: Mapping[str, str], install_date: str = "install_date") -> DataFrame:
    return df.select("*", *[day_offset(first, install_date).alias(out) for first, out in offsets.items()])


def window_rollup(keys: DataFrame, daily: DataFrame, specs: Iterable[WindowSpec] = (), actions: bool = False,
                  lo: int = 0, hi: int = 28, copies: str | None = None) -> DataFrame:
    """Window report of any number of funnels, one row per (profile, install date).

    ``keys`` has distinct ``profile_id, install_date`` rows. A key without any
    funnel day in its window has no row.
    """
    specs = list(specs)
    rows = banded_join(keys, daily, PROFILE, "install_date", DAY, lo, hi)
    times = F.col(copies) if copies else None
    offset = day_offset(DAY, "install_date")
    columns = [c for s in specs for c in window_columns(s, offset, times)]
    offsets = {s.first_date: s.first_offset for s in specs if s.first_offset}
    if actions:
        columns += action_columns(times)
        offsets |= dict(ACTION_DATES.values())
    return _with_offsets(rows.groupBy(PROFILE, "install_date").agg(*columns), offsets)


def funnel_steps(keys: DataFrame, daily: DataFrame, spec: WindowSpec, lo: int = 0, hi: int = 28) -> DataFrame:
    """Step counters of one funnel, summed per profile over its windows."""
    rows = banded_join(keys, daily, PROFILE, "install_date", DAY, lo, hi)
    return rows.groupBy(PROFILE).agg(*window_columns(spec, day_offset(DAY, "install_date")))


def action_flags(keys: DataFrame, daily: DataFrame, lo: int = 0, hi: int = 28) -> DataFrame:
    """One row per (profile, install date, day) with a date and a 0/1 column per action."""
    rows = banded_join(keys, daily, PROFILE, "install_date", DAY, lo, hi)
    return rows.select(PROFILE, "install_date", DAY, *PROPERTY_ACTIONS,
                       *[F.when(F.col(c) == 1, F.col(DAY)).alias(c.replace("_clicks", "_date")) for c in PROPERTY_ACTIONS])
