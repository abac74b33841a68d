"""The wide feature table and its preparation for training."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conversion_engine.functions.semantics import ColumnLike, as_col, flag

# The columns of the wide table, in report order.
COHORT_COLUMNS = """
    device_id idprofile install_date installed_on_weekend platform install_source install_source_detail
    ip_country ip_region brand customer_status profile_created_yn push_yn first_booked_date_post_install
    days0to28_app_bookings
    first_app_open_date days_to_first_app_open app_open_count app_open_days avg_app_opens_per_day
    last_app_open_date days_to_last_app_open days_of_inactivity
    first_login_post_install did_user_ever_logged_in days_to_first_login login_count
    profile_info_date days_to_first_profile_info language_flag bio_flag city_flag interest_flag
    all_attributes_flag pic_uploaded_date days_to_first_pic_uploaded
    social_toggle_date days_to_first_social_toggle_on social_member_yn
""".split()
ACTIVITY_COLUMNS = """
    search_activated_count started_destn_step_count invalid_destn_displayed_count destn_selected_step_count
    search_domestic_trip search_short_haul_trip search_long_haul_trip
    search_domestict_trip_share search_short_haul_trip_share search_long_haul_trip_share
    started_dates_step_count search_avg_lead_time search_avg_los started_guests_step_count search_avg_pax
    first_search_post_install days_to_first_search_post_install
    day0_searches_made day1_searches_made days2to5_searches_made days6to13_searches_made
    days14to20_searches_made days21to28_searches_made days0to28_searches_made
    first_dstn_search_page_viewed_date days_to_first_dstn_search_page_viewed
    destination_search_pages_viewed avg_number_properties_returned
    first_sort_or_filter_date filter_used_count sort_used_count
    first_recent_search_date days_to_first_recent_search_days recent_search_clicks
    first_prop_view_post_install_date days_to_first_prop_view_post_install
    day0_property_views day1_property_views days2to5_property_views days6to13_property_views
    days14to20_property_views days21to28_property_views days0to28_property_views
    hostels_viewed share_hostels_viewed non_hostels_viewed share_non_hostels_viewed viewed_property_avg_position
    first_prop_map_view_post_install_date first_prop_map_view_post_install_days property_page_map_clicks
    first_whishlist_click_date first_whishlist_click_days add_to_wish_list_clicks
    first_linkup_view_date first_linkup_view_days linkups_view_propt_page
    first_propt_read_more_date first_propt_read_more_days propt_read_more_clicks
    first_house_rules_click_date first_house_rules_click_days propt_house_rules_clicks
    first_propt_facilities_click_date first_propt_facilities_click_days propt_facilities_clicks
    first_propt_reviews_click_date first_propt_reviews_click_days propt_reviews_clicks
    first_checkout_start_post_install day0_checkout_starts day1_checkout_starts days2to5_checkout_starts
    days6to13_checkout_starts days14to20_checkout_starts days21to28_checkout_starts days0to28_checkout_starts
    checkout_dorms_selected_count checkout_privates_selected_count checkout_hostels_selected_count
    checkout_non_hostels_selected_count started_email_step_count started_name_step_count
    started_nationality_step_count started_payment_details_step_count started_confirm_details_step_count
    checkout_confirm_clicked_count
""".split()
WIDE_COLUMNS = [*COHORT_COLUMNS, *ACTIVITY_COLUMNS]

#: Identifiers, dates, and columns that the label is computed from.
IDENTIFIER_COLUMNS = ("device_id", "idprofile", "install_date")
LABEL_DERIVED_COLUMNS = ("customer_status", "first_booked_date_post_install", "days0to28_app_bookings",
                         "profile_created_yn")
#: Property-page actions that only the iOS app reports.
IOS_ONLY_COLUMNS = ("first_prop_map_view_post_install_days", "property_page_map_clicks",
                    "first_propt_read_more_days", "propt_read_more_clicks",
                    "first_house_rules_click_days", "propt_house_rules_clicks",
                    "first_propt_facilities_click_days", "propt_facilities_clicks",
                    "first_propt_reviews_click_days", "propt_reviews_clicks")


def assemble_features(cohort: DataFrame, blocks: Iterable[DataFrame], keys: Iterable[str]) -> DataFrame:
    """Left join every feature block onto the cohort.

    A block with the keys plus its feature columns should be unique on the
    keys; blocks that are not will repeat cohort rows.
    """
    keys = list(keys)
    return reduce(lambda left, block: left.join(block, keys, "left"), blocks, cohort)


def feature_types(df: DataFrame, exclude: Iterable[str] = ()) -> tuple[list[str], list[str]]:
    """Text columns and numeric columns, in schema order."""
    fields = [f for f in df.schema.fields if f.name not in set(exclude)]
    text = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
    numeric = [f.name for f in fields if isinstance(f.dataType, T.NumericType)]
    return text, numeric


def split_bucket(key: ColumnLike, buckets: int = 100) -> Column:
    """A stable bucket per key, from the first eight digits of its MD5; the same on every engine."""
    digits = F.substring(F.md5(as_col(key).cast("string").cast("binary")), 1, 8)
    return (F.conv(digits, 16, 10).cast("bigint") % buckets).cast("int")


def assign_split(df: DataFrame, key: ColumnLike, validation_percent: int = 20, out: str = "split") -> DataFrame:
    """Mark rows 'train' or 'validation' by key, so that all rows of a key stay together."""
    return df.withColumn(out, F.when(split_bucket(key) < validation_percent, "validation").otherwise("train"))


def prepare_features(wide: DataFrame, label: Column, drop: Iterable[str] = (*IDENTIFIER_COLUMNS, *LABEL_DERIVED_COLUMNS),
                     keep: Iterable[str] = (), missing_number: float = -1.0, missing_text: str = "missing",
                     fills: Mapping[str, float | str] | None = None) -> DataFrame:
    """Label and model-ready columns: dates and dropped columns go, NULLs are filled.

    ``keep`` names columns that survive unchanged, such as the key of the split.
    ``fills`` overrides the filling value of single columns. Measurements that the row's
    platform does not report become text (``mark_unavailable``).
    """
    reported = [c for c in IOS_ONLY_COLUMNS if c in wide.columns]
    if "platform" in wide.columns and reported:
        wide = mark_unavailable(wide, reported)
    keep, fills = list(keep), dict(fills or {})
    dropped = {*drop, *keep}
    text, numeric = feature_types(wide, exclude=dropped)
    columns = []
    for name in wide.columns:
        if name in text:
            columns.append(F.coalesce(name, F.lit(fills.get(name, missing_text))).alias(name))
        elif name in numeric:
            columns.append(F.coalesce(F.col(name).cast("double"), F.lit(float(fills.get(name, missing_number)))).alias(name))
    return wide.select(*keep, label.cast("int").alias("label"), *columns)


def mark_unavailable(wide: DataFrame, columns: Iterable[str] = IOS_ONLY_COLUMNS, platform: str = "platform",
                     unavailable_on: str = "android", text: str = "non_available") -> DataFrame:
    """Turn measurements a platform does not report into text, with a mark for that platform."""
    columns = set(columns)
    marked = F.col(platform).ilike(unavailable_on)
    return wide.select(*[
        F.when(marked, F.lit(text)).otherwise(F.col(c).cast("string")).alias(c) if c in columns else F.col(c)
        for c in wide.columns
    ])


def new_customer_label(status: ColumnLike = "customer_status") -> Column:
    return flag(as_col(status) == "New Customer")
