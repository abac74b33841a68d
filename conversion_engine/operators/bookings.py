"""Bookings: the filtered star, and what they say about an installed device."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from conversion_engine.functions.semantics import (
    DAY_BUCKETS,
    FULL_WINDOW,
    WINDOW_DAYS,
    ColumnLike,
    as_col,
    bucket_flags,
    day_offset,
    flag,
    least_strict,
)
from conversion_engine.operators.joins import in_calendar, left_join_sparse


@dataclass(frozen=True)
class BookingFilters:
    """Which bookings count. The codes are fixed values of the booking system."""

    start: dt.date
    end: dt.date
    site_brand: str
    platform: str = "APP"
    statuses: tuple[int, ...] = (1, 2, 5)
    types: tuple[int, ...] = (1, 3)
    excluded_site_type: int = 33


def booking_star(booking: DataFrame, attribution: DataFrame, customer: DataFrame, site: DataFrame,
                 calendar: DataFrame, filters: BookingFilters) -> DataFrame:
    """Bookings that count, with platform and the customer's first booking.

    All joins are inner. Customers whose first booking date is missing or not
    in the calendar are left out, and their bookings with them.
    """
    counted = booking.where(
        F.col("booked_date").between(F.lit(filters.start), F.lit(filters.end))
        & F.col("id_booking_status").isin(*filters.statuses)
        & F.col("id_booking_type").isin(*filters.types)
        & (F.col("id_site_type") != filters.excluded_site_type)
        & (F.col("bednights") > 0)
    )
    on_platform = attribution.where(F.col("booking_platform") == filters.platform)
    own_sites = site.where(F.col("site_brand") == filters.site_brand).select("id_site_name")
    known_customers = in_calendar(customer, "id_date_first_booking", calendar)
    return (
        counted.join(own_sites, "id_site_name")
        .join(on_platform, "id_booking")
        .join(known_customers, "id_customer")
        .select("id_profile", "id_customer", "id_date_first_booking", "id_first_booking", "id_booking",
                "booked", "booked_date", "arrival_date", "departure_date", "booking_platform")
    )


# --- expressions -----------------------------------------------------------


def first_known_booking(first_ever: ColumnLike = "id_date_first_booking",
                        first_booked: ColumnLike = "first_booked_date") -> Column:
    return least_strict(first_ever, first_booked)


def customer_status(first_ever: ColumnLike = "id_date_first_booking", first_booked_date: ColumnLike = "first_booked_date",
                    first_booked: ColumnLike = "first_booked", install_ts: ColumnLike = "install_timestamp") -> Column:
    """Existing, new or no customer, seen from the moment of the install."""
    first, installed = first_known_booking(first_ever, first_booked_date), F.to_date(as_col(install_ts))
    return (
        F.when((first < installed) | (as_col(first_booked) < as_col(install_ts)), "Existing Customer")
        .when(first >= installed, "New Customer")
        .when(first.isNull(), "Not a Customer")
    )


def days_to_booking(booked: ColumnLike = "booked", install_ts: ColumnLike = "install_timestamp") -> Column:
    """Calendar days from install to booking; NULL for a booking before the install."""
    booked, install_ts = as_col(booked), as_col(install_ts)
    return F.when(booked < install_ts, None).otherwise(day_offset(booked, install_ts))


def trip_pending(booked: ColumnLike = "booked", arrival: ColumnLike = "arrival_date",
                 install_ts: ColumnLike = "install_timestamp") -> Column:
    """1 if the app was installed between booking and arrival."""
    return flag(as_col(install_ts).between(as_col(booked), as_col(arrival).cast("timestamp_ntz")))


def booking_day_flags(platform: str = "APP") -> list[Column]:
    counts = (F.col("booking_platform") == platform) & (F.col("booked") > F.col("install_timestamp"))
    return bucket_flags(day_offset("booked_date", "install_date"), counts, "app_bookings",
                        (*DAY_BUCKETS, FULL_WINDOW))


def first_booking_day_flags() -> list[Column]:
    first = first_known_booking()
    counts = first >= F.to_date("install_timestamp")
    return bucket_flags(day_offset(first, "install_date"), counts, "first_bkg", DAY_BUCKETS)


# --- relations -------------------------------------------------------------


def bookings_after_first_install(installs: DataFrame, star: DataFrame) -> DataFrame:
    """Bookings no earlier than the first install of their profile, each once.

    Adds ``profile_install_timestamp``, that first install. Both sides are joined
    on one row per profile, so nothing multiplies, however many devices it has.
    """
    first_install = (
        installs.where(F.col("profile_id").isNotNull())
        .groupBy(F.col("profile_id").alias("id_profile"))
        .agg(F.min("install_timestamp").alias("profile_install_timestamp"))
    )
    return star.join(first_install, "id_profile").where(
        F.to_date("booked") >= F.to_date("profile_install_timestamp"))


def add_first_bookings(bookings: DataFrame) -> DataFrame:
    """Add the customer's first booking of all: ``first_booked``, ``first_booked_date``,
    and ``first_cust_install_timestamp``, the first install of any of its profiles.

    One grouped aggregation and a join back, instead of a window that would
    gather all bookings of a customer in one task.
    """
    dated = F.col("booked_date").isNotNull()
    per_customer = bookings.groupBy("id_customer").agg(
        F.min("booked").alias("first_booked"),
        F.min(F.when(dated, F.struct("booked", "booked_date"))).getField("booked_date").alias("first_booked_date"),
        F.min("profile_install_timestamp").alias("first_cust_install_timestamp"),
    )
    return bookings.join(per_customer, "id_customer").drop("profile_install_timestamp")


def attach_bookings(installs: DataFrame, bookings: DataFrame) -> DataFrame:
    """Every install with every booking its profile made on or after the install day.

    Grain: install x booking, installs without booking once. This is the
    detailed relation with all day flags; ``booking_summary`` gives the device
    facts without building these pairs. ``bookings`` comes from
    ``bookings_after_first_install``.
    """
    joined = left_join_sparse(
        installs, add_first_bookings(bookings), "profile_id", "id_profile", ["device_id"],
        extra=F.to_date(F.col("booked")) >= F.col("install_date"))
    return joined.select(
        "*",
        *booking_day_flags(),
        *first_booking_day_flags(),
        days_to_booking().alias("days_to_app_booking_post_install"),
        customer_status().alias("customer_status"),
        trip_pending().alias("trip_pending_yn"),
    )


def _same_day_after_install(installs: DataFrame, bookings: DataFrame) -> DataFrame:
    """Per device: bookings of the install day that were made after the install.

    Installs and bookings of one profile and hour are put in one order by time,
    and a running sum counts the later bookings, instead of pairing them; the
    day's later hours add their totals.
    """
    in_window = flag(day_offset("booked_date", "day").between(0, WINDOW_DAYS)).cast("bigint")
    marks = (
        bookings.withColumn("day", F.to_date("booked"))
        .groupBy(F.col("id_profile").alias("profile_id"), "day", F.col("booked").alias("at"))
        .agg(F.sum(in_window).alias("n"))
        .select("profile_id", "day", "at", F.lit(None).cast("string").alias("device_id"), "n")
    )
    starts = installs.where(F.col("profile_id").isNotNull()).select(
        "profile_id", F.col("install_date").alias("day"), F.col("install_timestamp").alias("at"),
        "device_id", F.lit(0).cast("bigint").alias("n"))
    hour = ["profile_id", "day", "hour"]
    # Latest first; at the same instant the install comes first, so that a
    # booking at that very instant is not counted as later.
    order = Window.partitionBy(*hour).orderBy(F.desc("at"), F.desc(F.col("device_id").isNotNull()))
    later = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = marks.unionByName(starts).withColumn("hour", F.hour("at"))
    # At most 24 rows for a profile and day.
    down = Window.partitionBy("profile_id", "day").orderBy(F.desc("hour")).rowsBetween(Window.unboundedPreceding, -1)
    hours = rows.groupBy(*hour).agg(F.sum("n").alias("total")).select(
        *hour, F.coalesce(F.sum("total").over(down), F.lit(0)).alias("later_hours"))
    counted = rows.withColumn("same_hour", later).where(F.col("device_id").isNotNull()).join(hours, hour)
    return (counted.select("device_id", (F.col("same_hour") + F.col("later_hours")).alias("same_day_bookings"))
            .where(F.col("same_day_bookings") > 0))


def booking_summary(installs: DataFrame, bookings: DataFrame) -> DataFrame:
    """Installs, one row per device, with what their bookings say.

    Adds ``owners`` (0, 1 or 2 for "more than one" customer), the facts of the
    only customer, ``customer_status`` and ``days0to28_app_bookings``. The
    customer facts are meaningful for ``owners <= 1``.

    Bookings are first reduced to one row per profile and day, then joined to
    the distinct install days of the profile: for one profile the work is
    bounded by calendar days, not by devices times bookings. Both inputs
    (``bookings`` comes from ``bookings_after_first_install``) are read by
    several branches: pass written tables.
    """
    per_day = add_first_bookings(bookings).groupBy(
        F.col("id_profile").alias("__profile"), F.to_date("booked").alias("__day"), "booked_date"
    ).agg(
        F.count("*").alias("__n"),
        F.min("id_customer").alias("__lo"), F.max("id_customer").alias("__hi"),
        F.min("id_date_first_booking").alias("id_date_first_booking"),
        F.min("first_booked").alias("first_booked"),
        F.min("first_booked_date").alias("first_booked_date"),
    )
    install_days = installs.where(F.col("profile_id").isNotNull()).select("profile_id", "install_date").distinct()
    later_day = (F.col("__day") > F.col("install_date")) & day_offset("booked_date", "install_date").between(0, WINDOW_DAYS)
    summary = (
        install_days.join(per_day, (F.col("profile_id") == F.col("__profile")) & (F.col("__day") >= F.col("install_date")))
        .groupBy("profile_id", "install_date")
        .agg(
            F.when(F.min("__lo") == F.max("__hi"), 1).otherwise(2).alias("owners"),
            F.min("id_date_first_booking").alias("id_date_first_booking"),
            F.min("first_booked").alias("first_booked"),
            F.min("first_booked_date").alias("first_booked_date"),
            F.sum(F.when(later_day, F.col("__n")).otherwise(0)).alias("__later"),
        )
        .select(F.concat_ws("|", "profile_id", "install_date").alias("__key"),
                "owners", "id_date_first_booking", "first_booked", "first_booked_date", "__later")
    )
    same_day = _same_day_after_install(installs, bookings).withColumnRenamed("device_id", "__device")
    key = F.concat(F.col("profile_id").cast("string"), F.lit("|"), F.col("install_date").cast("string"))
    joined = left_join_sparse(installs, summary, key, "__key", ["device_id"])
    joined = joined.join(same_day, F.col("device_id") == F.col("__device"), "left").drop("__device")
    return joined.select(
        *installs.columns,
        F.coalesce("owners", F.lit(0)).alias("owners"),
        "id_date_first_booking", "first_booked", "first_booked_date",
        customer_status().alias("customer_status"),
        (F.coalesce("__later", F.lit(0)) + F.coalesce("same_day_bookings", F.lit(0))).alias("days0to28_app_bookings"),
    )
