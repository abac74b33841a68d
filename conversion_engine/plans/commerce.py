"""The domain tables, derived from a generic commerce data set.

The analysis needs install logs, app events and bookings. This module reads
them out of the tables ``events``, ``orders``, ``customer``, ``supplier``,
``nation`` and ``region``, so that the whole analysis can run, and be checked,
on data that is at hand. Every derived row comes from one source row; the
event's user, type and ``k`` property decide its role.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from conversion_engine.functions.semantics import json_fields, typed_text
from conversion_engine.operators.attribution import OwnedChannels
from conversion_engine.operators.identity import ZERO_DEVICE
from conversion_engine.plans.conversion import ConversionPeriod
from conversion_engine.sources.logs import latest_complete_day

OWNED = OwnedChannels(prefixes={"Own Web": "Own Web", "Social Test": "Social Test"},
                      exact={"Own Web": ("Blog - organic links",)})
PERIOD = ConversionPeriod(
    install_start=dt.date(2024, 1, 3),
    install_end=dt.date(2024, 1, 20),
    data_end=latest_complete_day("2024-01-29"),
    identity_start=dt.date(2023, 1, 1),
    usage_start=dt.date(2021, 1, 1),
    site_brand="MAIN",
    owned=OWNED,
)
PROFILE_BASE = 1_000_000


def choose(index: Column, *values: str | None) -> Column:
    """The value at a position; NULL past the end."""
    return F.try_element_at(F.array(*[F.lit(v).cast("string") for v in values]), (index + 1).cast("int"))


def text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# Columns of the source tables that are read here. A declared
# schema spares the job that would look into the files for it.
SOURCE_SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": """o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double,
                 o_orderdate timestamp_ntz, o_orderpriority string""",
    "lineitem": "l_orderkey bigint, l_linenumber int, l_shipdate timestamp_ntz",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(SOURCE_SCHEMAS[name]).parquet(f"{root}/{name}.parquet")


def files(spark: SparkSession, root: str) -> list[tuple]:
    """Paths, sizes and times of the source tables' files."""
    folder, found = spark._jvm.org.apache.hadoop.fs.Path, []
    for name in SOURCE_SCHEMAS:
        path = folder(f"{root}/{name}.parquet")
        fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        if fs.exists(path):
            found += [(s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(path)]
    return found


def base_events(spark: SparkSession, root: str) -> DataFrame:
    """Events with ``u`` (user), ``k`` (property) and ``day``."""
    return read(spark, root, "events").select(
        "event_id", "ts", "event_type",
        F.col("user_id").alias("u"),
        typed_text(json_fields("props", ["k"]).getField("k"), "int").alias("k"),
        F.to_date("ts").alias("day"),
    )


def install_log(events: DataFrame) -> DataFrame:
    u, k = F.col("u"), F.col("k")
    second_android = (u % 10 == 1) & k.between(50, 59)
    nation = (u + F.when(k >= 50, 1).otherwise(0)) % 25
    names = {"signup": "INSTALL", "view": "OPEN", "click": "LOGIN"}
    name = F.upper("event_type")
    for source, target in names.items():
        name = F.when(F.col("event_type") == source, target).otherwise(name)
    return events.select(
        name.alias("name"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp_iso"),
        F.when(k == 10, ZERO_DEVICE).when((u % 2 == 0) & (k < 60), text("aaid-", u)).alias("user_data_aaid"),
        F.when((u % 2 == 1) & (k < 60) & ~second_android, text("idfa-", u)).alias("user_data_idfa"),
        F.when(second_android, text("andr-", u)).alias("user_data_android_id"),
        F.when(k.between(60, 79), text("idfv-", u)).alias("user_data_idfv"),
        text("10.0.0.", F.floor(u / 5)).alias("user_data_ip"),
        F.when(k.between(80, 84), "TV_APP").when((k < 60) & (u % 2 == 0), "ANDROID").otherwise("IOS")
        .alias("user_data_platform"),
        F.when(k % 7 != 0, text("brand-", u % 4)).alias("user_data_brand"),
        F.when(k % 9 != 0, F.when(nation == 0, "GB").otherwise(text("N", F.lpad(nation.cast("string"), 2, "0"))))
        .alias("user_data_geo_country_code"),
        choose((k + u) % 8, None, "spring_rtg", "my_brand_eu", "broad_match", "competitors_1", "generics_2",
               "summer", "x_RTG").alias("campaign"),
        choose((k + u * 3) % 6, None, "Affiliates", "newsletter", "CRM_spring", "Blog", "Own Web").alias("channel"),
        choose((k + u * 5) % 7, None, "paid advertising", "undisclosed", "email", "organic links", "journeys",
               "referral").alias("feature"),
        choose((k * 3 + u) % 8, None, "Google AdWords", "Apple Search Ads", "undisclosed", "InMobi",
               "Push Notifications", "Partner Six", "Undisclosed").alias("advertising_partner_name"),
        F.when(k % 5 != 0, text("title-", k % 3)).alias("marketing_title"),
        F.create_map(
            F.lit("customer_id"),
            F.when(k % 6 == 0, None).when(k % 6 == 1, "undefined").when(k % 6 == 2, "12345")
            .when(k == 99, text(u + PROFILE_BASE + 1)).otherwise(text(u + PROFILE_BASE)),
        ).alias("custom_data"),
    )


def event_log(events: DataFrame) -> DataFrame:
    u, k, kind = F.col("u"), F.col("k"), F.col("event_type")
    part, rest = k % 4, F.floor(k / 4).cast("int")
    is_view, is_click, is_buy, is_error = (kind == t for t in ("view", "click", "purchase", "error"))
    event_name = (
        F.when(is_view, choose(part, "view_item", "Destination_Search_Page_Viewed", "View_Item",
                               "Property_Details_Linkups_View"))
        .when(is_click, choose(part, "Search_Event", "Search_Event", "Destination_Search_Page_Event",
                               "Property_Details_Page_Event"))
        .when(is_buy, choose(part, "begin_checkout", "Checkout_Event", "Begin_Checkout", "Checkout_Confirm_Clicked"))
        .when(is_error, "Homepage_Event").otherwise("first_open")
    )
    page_type = (
        F.when(is_view, choose(part, None, "Destination Search", None, "Linkups View"))
        .when(is_click, choose(part, "Search", "Search", "Destination Search", "Property Details"))
        .when(is_error, "Homepage")
    )
    action = (
        F.when(is_click & (part == 0), choose(rest % 5, "Search Activated", "Search Step", "Search Step",
                                              "Invalid Destination Displayed", "Destination Selected"))
        .when(is_click & (part == 1), "Search Submitted")
        .when(is_click & (part == 2), choose(rest % 3, "Filter Used", "Sort Used", "Map Opened"))
        .when(is_click & (part == 3), choose(
            rest % 8, "Map View Clicked", "Added to Wishlist Clicked", "About Read More Clicked",
            "View All House Rules Clicked", "View All Facilities Clicked", "View Main Reviews Clicked",
            "View All Reviews Clicked", "map view clicked"))
        .when(is_buy & (part == 1), "Checkout Step Viewed")
        .when(is_error, "Home Panel Clicked")
    )
    step = (
        F.when(is_click, choose(rest % 3, "destination", "dates", "guests"))
        .when(is_buy & (part == 1), choose(rest % 5, "email", "full_name", "nationality", "payment_details",
                                           "confirm_details"))
    )
    nation = (u + F.floor(k / 10)) % 27
    params = F.struct(
        F.when(k % 8 == 0, text("an-", u)).alias("segment_anonymous_id"),
        F.when(k % 5 != 0, text("s", k % 5)).alias("ga_session_id"),
        F.date_add("day", k % 20).cast("string").alias("arrival_date"),
        F.date_add("day", k % 20 + 1 + k % 6).cast("string").alias("departure_date"),
        text("city-", k % 5).alias("destination_city"),
        F.when(nation < 25, text("nation_", nation)).when(nation == 25, "Atlantis").alias("destination_country"),
        F.when(k % 11 == 0, "abc").otherwise(text(k % 20)).alias("lead_time"),
        (k % 4 + 1).alias("number_guests"),
        action.alias("action"),
        F.when(k % 10 != 0, k).alias("number_results"),
        page_type.alias("page_type"),
        F.when(is_error, choose(part, "Searches recent", "searches saved", "Deals")).alias("panel_clicked"),
        text("p-", k % 50).alias("item_id"),
        choose(F.floor(k / 2) % 4, "Hostel", "HOSTEL party", "Hotel").alias("item_category"),
        F.when(k % 13 != 0, text(k % 9)).alias("position"),
        step.alias("step_name"),
        choose(rest % 3, "Mixed Dorm", "private").alias("checkout_room_types"),
    )
    user_properties = F.struct(
        F.when(k % 3 == 1, text("u", k % 3)).alias("ga_session_id"),
        F.when(k % 12 != 4, text("f", u)).alias("first_open_time"),
        text("acc-", u).alias("userId"),
    )
    version = (
        F.when(k % 20 == 7, "2.1-staging").when(k % 20 == 9, None)
        .when(k % 50 == 13, "12.4").when(k % 50 == 16, "9.3").otherwise("15.2")
    )
    return events.select(
        F.col("day").alias("event_date"),
        event_name.alias("event_name"),
        F.when(k % 10 < 5, "iOS").when(k % 10 < 9, "Android").otherwise("web").alias("platform"),
        F.when(k % 3 != 0, text(u + PROFILE_BASE)).alias("profile_id"),
        F.when(k % 4 != 0, text("ps-", u, "-", k % 2)).alias("user_pseudo_id"),
        F.to_json(params).alias("event_parameters"),
        F.to_json(user_properties).alias("user_properties"),
        F.to_json(F.struct(version.alias("version"))).alias("app_info"),
    )


def booking(events: DataFrame, orders: DataFrame) -> DataFrame:
    u, k = F.col("u"), F.col("k")
    bought = events.where(F.col("event_type") == "purchase")
    joined = bought.join(orders, bought.event_id == orders.o_orderkey)
    return joined.select(
        F.col("event_id").alias("id_booking"),
        (u + PROFILE_BASE).alias("id_profile"),
        F.when(k == 97, u + 1).otherwise(u).alias("id_customer"),
        (k % 20).alias("id_site_name"),
        F.col("ts").alias("booked"),
        F.col("day").alias("booked_date"),
        F.date_add("day", k % 30).alias("arrival_date"),
        F.date_add("day", k % 30 + 1 + k % 7).alias("departure_date"),
        F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2)
        .when(k % 2 == 0, 5).otherwise(3).alias("id_booking_status"),
        F.when(F.col("o_orderpriority") == "5-LOW", 2).when(F.col("o_orderpriority") == "2-HIGH", 3).otherwise(1)
        .alias("id_booking_type"),
        F.when(k % 25 == 8, 33).otherwise(1).alias("id_site_type"),
        (k % 12).alias("bednights"),
    )


class CommerceTables:
    """The twelve domain tables, each derived when it is first asked for."""

    def __init__(self, spark: SparkSession, root: str):
        self._spark, self._root = spark, root

    def _read(self, name: str) -> DataFrame:
        return read(self._spark, self._root, name)

    @cached_property
    def _events(self) -> DataFrame:
        return base_events(self._spark, self._root)

    def _events_of(self, kind: str) -> DataFrame:
        return self._events.where(F.col("event_type") == kind)

    @cached_property
    def install_log(self) -> DataFrame:
        return install_log(self._events)

    @cached_property
    def event_log(self) -> DataFrame:
        return event_log(self._events)

    @cached_property
    def booking(self) -> DataFrame:
        return booking(self._events, self._read("orders"))

    @cached_property
    def booking_attribution(self) -> DataFrame:
        platform = F.when(F.col("k") % 3 == 0, "WEB").otherwise("APP")
        return self._events_of("purchase").select(
            F.col("event_id").alias("id_booking"), platform.alias("booking_platform"))

    @cached_property
    def customer(self) -> DataFrame:
        first = F.date_add(F.lit(dt.date(2023, 12, 22)), (F.col("c_custkey") % 45).cast("int"))
        return self._read("customer").select(
            F.col("c_custkey").alias("id_customer"),
            F.when(F.col("c_mktsegment") != "MACHINERY", first).alias("id_date_first_booking"),
            (F.col("c_custkey") * 10).alias("id_first_booking"))

    @cached_property
    def site(self) -> DataFrame:
        return self._read("supplier").select(
            F.col("s_suppkey").cast("int").alias("id_site_name"),
            F.when(F.col("s_nationkey") % 5 == 0, "OTHER").otherwise("MAIN").alias("site_brand"))

    @cached_property
    def calendar(self) -> DataFrame:
        iddate = F.to_date(F.add_months(F.to_date("o_orderdate"), 27 * 12))
        return self._read("orders").select(iddate.alias("iddate")).distinct().select(
            "iddate", F.year("iddate").alias("idyear"), F.month("iddate").alias("idmonth"),
            F.date_format("iddate", "MMM").alias("monthnameshort"))

    @cached_property
    def country(self) -> DataFrame:
        return self._read("nation").select(
            text("N", F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("countryiso2"),
            F.col("n_name").alias("country"), F.col("n_regionkey").alias("id_subcontinent"))

    @cached_property
    def subcontinent(self) -> DataFrame:
        return self._read("region").select(
            F.col("r_regionkey").alias("id_subcontinent"), F.col("r_name").alias("subcontinent"))

    @cached_property
    def push_status(self) -> DataFrame:
        return self._events_of("error").select(
            (F.col("u") + PROFILE_BASE).alias("id_profile"), F.col("day").alias("date_push"),
            F.when(F.col("k") % 2 == 0, "TRUE").otherwise("FALSE").alias("push_opt_in"))

    @cached_property
    def social_auth(self) -> DataFrame:
        k = F.col("k")
        return self._events_of("signup").select(
            (F.col("u") + PROFILE_BASE).alias("id_profile"), F.col("day").alias("created_at"),
            F.when(k % 5 == 0, "Profiles with Photos").otherwise("Profiles with Initials").alias("photo_flag"),
            F.when(k % 5 == 1, "Social Toggle On").otherwise("Social Toggle Off").alias("social_flag"))

    @cached_property
    def profile_attributes(self) -> DataFrame:
        k = F.col("k")

        def bit(condition: Column) -> Column:
            return F.when(condition, 1).otherwise(0)

        return self._events_of("view").select(
            (F.col("u") + PROFILE_BASE).alias("profile_id"), F.col("day").alias("event_date"),
            F.when(k != 50, bit(k % 6 == 0)).alias("language_flag"), bit(k % 8 == 0).alias("bio_flag"),
            bit(k % 10 == 0).alias("city_flag"), bit(k % 12 == 0).alias("interests_flag"))


def tables(spark: SparkSession, root: str) -> CommerceTables:
    return CommerceTables(spark, root)
