"""The analysis once more, as plain SQL relations for DuckDB.

Written row by row and window by window, without the reductions the Spark
operators make, so that the two agree only if those reductions are right.
``select`` puts the relations a statement needs in front of it.
"""

from __future__ import annotations

import re

from conversion_engine.operators.funnel import ACTION_DATES, PROPERTY_ACTIONS, WINDOW_SPECS
from conversion_engine.plans.conversion import PROFILE_BLOCKS

# Event names, actions, channel labels and column names in the statements below are
# those of the app's log and of the report.
START, INSTALL_END, DATA_END = "DATE '2024-01-03'", "DATE '2024-01-20'", "DATE '2024-01-27'"
BUCKETS = {"day0": (0, 0), "day1": (1, 1), "days2to5": (2, 5), "days6to13": (6, 13),
           "days14to20": (14, 20), "days21to28": (21, 28), "days0to28": (0, 28)}


def pick(index: str, *values: str | None) -> str:
    items = ", ".join("NULL" if v is None else f"'{v}'" for v in values)
    return f"([{items}])[({index}) + 1]"


def offset(later: str, earlier: str) -> str:
    return f"CAST(date_diff('day', CAST({earlier} AS DATE), CAST({later} AS DATE)) AS INTEGER)"


def big(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def share(n: str, d: str) -> str:
    return f"CASE WHEN sum({d}) = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(sum({n}) AS DOUBLE) / sum({d}) END"


def bucket_sums(off: str, value: str, suffix: str) -> list[str]:
    return [f"{big(f'sum(CASE WHEN {off} BETWEEN {lo} AND {hi} THEN {value} ELSE 0 END)')} AS {name}_{suffix}"
            for name, (lo, hi) in BUCKETS.items()]


DEVICE = "coalesce(aaid, idfa, android_id, idfv, ip)"
TOUCHED = ("campaign", "channel", "feature", "ad_partner", "marketing_title", "platform", "brand", "ip_country_code")

RELATIONS: dict[str, str] = {}
R = RELATIONS

# --- domain tables from the given ones -------------------------------------

R["d_events"] = """
SELECT event_id, ts, event_type, value, user_id AS u, CAST(props ->> '$.k' AS INTEGER) AS k, CAST(ts AS DATE) AS day
FROM events"""
R["d_install_log"] = f"""
SELECT CASE event_type WHEN 'signup' THEN 'INSTALL' WHEN 'view' THEN 'OPEN' WHEN 'click' THEN 'LOGIN'
         ELSE upper(event_type) END AS name,
  ts, day, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS timestamp_iso,
  CASE WHEN k = 10 THEN '00000000-0000-0000-0000-000000000000' WHEN u % 2 = 0 AND k < 60 THEN 'aaid-' || u END AS aaid,
  CASE WHEN u % 2 = 1 AND k < 60 AND NOT (u % 10 = 1 AND k >= 50) THEN 'idfa-' || u END AS idfa,
  CASE WHEN u % 10 = 1 AND k BETWEEN 50 AND 59 THEN 'andr-' || u END AS android_id,
  CASE WHEN k BETWEEN 60 AND 79 THEN 'idfv-' || u END AS idfv,
  '10.0.0.' || (u // 5) AS ip,
  CASE WHEN k BETWEEN 80 AND 84 THEN 'TV_APP' WHEN k < 60 AND u % 2 = 0 THEN 'ANDROID' ELSE 'IOS' END AS platform,
  CASE WHEN k % 7 <> 0 THEN 'brand-' || (u % 4) END AS brand,
  CASE WHEN k % 9 = 0 THEN NULL WHEN (u + CASE WHEN k >= 50 THEN 1 ELSE 0 END) % 25 = 0 THEN 'GB'
    ELSE 'N' || lpad(CAST((u + CASE WHEN k >= 50 THEN 1 ELSE 0 END) % 25 AS VARCHAR), 2, '0') END AS ip_country_code,
  {pick('(k + u) % 8', None, 'spring_rtg', 'my_brand_eu', 'broad_match', 'competitors_1', 'generics_2', 'summer', 'x_RTG')} AS campaign,
  {pick('(k + u * 3) % 6', None, 'Affiliates', 'newsletter', 'CRM_spring', 'Blog', 'Own Web')} AS channel,
  {pick('(k + u * 5) % 7', None, 'paid advertising', 'undisclosed', 'email', 'organic links', 'journeys', 'referral')} AS feature,
  {pick('(k * 3 + u) % 8', None, 'Google AdWords', 'Apple Search Ads', 'undisclosed', 'InMobi', 'Push Notifications', 'Partner Six', 'Undisclosed')} AS partner,
  CASE WHEN k % 5 <> 0 THEN 'title-' || (k % 3) END AS marketing_title,
  CASE k % 6 WHEN 0 THEN NULL WHEN 1 THEN 'undefined' WHEN 2 THEN '12345'
    ELSE CAST(u + CASE WHEN k = 99 THEN 1000001 ELSE 1000000 END AS VARCHAR) END AS customer_id
FROM d_events"""
_rest = "(k // 4)"
R["d_event_log"] = f"""
SELECT day AS event_date, u, k,
  CASE event_type
    WHEN 'view' THEN {pick('k % 4', 'view_item', 'Destination_Search_Page_Viewed', 'View_Item', 'Property_Details_Linkups_View')}
    WHEN 'click' THEN {pick('k % 4', 'Search_Event', 'Search_Event', 'Destination_Search_Page_Event', 'Property_Details_Page_Event')}
    WHEN 'purchase' THEN {pick('k % 4', 'begin_checkout', 'Checkout_Event', 'Begin_Checkout', 'Checkout_Confirm_Clicked')}
    WHEN 'error' THEN 'Homepage_Event' ELSE 'first_open' END AS event_name,
  CASE event_type
    WHEN 'view' THEN {pick('k % 4', None, 'Destination Search', None, 'Linkups View')}
    WHEN 'click' THEN {pick('k % 4', 'Search', 'Search', 'Destination Search', 'Property Details')}
    WHEN 'error' THEN 'Homepage' END AS page_type,
  CASE WHEN event_type = 'click' AND k % 4 = 0 THEN {pick(_rest + ' % 5', 'Search Activated', 'Search Step', 'Search Step', 'Invalid Destination Displayed', 'Destination Selected')}
    WHEN event_type = 'click' AND k % 4 = 1 THEN 'Search Submitted'
    WHEN event_type = 'click' AND k % 4 = 2 THEN {pick(_rest + ' % 3', 'Filter Used', 'Sort Used', 'Map Opened')}
    WHEN event_type = 'click' THEN {pick(_rest + ' % 8', 'Map View Clicked', 'Added to Wishlist Clicked', 'About Read More Clicked', 'View All House Rules Clicked', 'View All Facilities Clicked', 'View Main Reviews Clicked', 'View All Reviews Clicked', 'map view clicked')}
    WHEN event_type = 'purchase' AND k % 4 = 1 THEN 'Checkout Step Viewed'
    WHEN event_type = 'error' THEN 'Home Panel Clicked' END AS action,
  CASE WHEN event_type = 'click' THEN {pick(_rest + ' % 3', 'destination', 'dates', 'guests')}
    WHEN event_type = 'purchase' AND k % 4 = 1 THEN {pick(_rest + ' % 5', 'email', 'full_name', 'nationality', 'payment_details', 'confirm_details')} END AS step_name,
  CASE WHEN event_type = 'error' THEN {pick('k % 4', 'Searches recent', 'searches saved', 'Deals')} END AS panel_clicked,
  CASE WHEN k % 10 < 5 THEN 'iOS' WHEN k % 10 < 9 THEN 'Android' ELSE 'web' END AS platform,
  CASE WHEN k % 3 <> 0 THEN CAST(u + 1000000 AS VARCHAR) END AS profile_id,
  CASE WHEN k % 4 <> 0 THEN 'ps-' || u || '-' || (k % 2) END AS pseudo_id,
  CASE WHEN k % 8 = 0 THEN 'an-' || u END AS anonymous_id,
  CASE WHEN k % 5 <> 0 THEN 's' || (k % 5) WHEN k % 3 = 1 THEN 'u1' END AS ga_session,
  CASE WHEN k % 12 <> 4 THEN 'f' || u END AS first_open_time,
  'acc-' || u AS account_id,
  CASE WHEN k % 20 = 7 THEN '2.1-staging' WHEN k % 20 = 9 THEN NULL WHEN k % 50 = 13 THEN '12.4'
    WHEN k % 50 = 16 THEN '9.3' ELSE '15.2' END AS version,
  day + (k % 20) AS arrival_date, day + (k % 20 + 1 + k % 6) AS departure_date,
  'city-' || (k % 5) AS destination_city,
  CASE WHEN (u + k // 10) % 27 < 25 THEN 'nation_' || ((u + k // 10) % 27) WHEN (u + k // 10) % 27 = 25 THEN 'Atlantis' END AS destination_country,
  CASE WHEN k % 11 = 0 THEN 'abc' ELSE CAST(k % 20 AS VARCHAR) END AS lead_time,
  CAST(k % 4 + 1 AS INTEGER) AS number_guests,
  CASE WHEN k % 10 <> 0 THEN k END AS number_results,
  'p-' || (k % 50) AS item_id,
  {pick('(k // 2) % 4', 'Hostel', 'HOSTEL party', 'Hotel')} AS item_category,
  CASE WHEN k % 13 <> 0 THEN CAST(k % 9 AS VARCHAR) END AS position,
  {pick(_rest + ' % 3', 'Mixed Dorm', 'private')} AS checkout_room_types
FROM d_events"""
R["d_booking"] = """
SELECT event_id AS id_booking, u + 1000000 AS id_profile, CASE WHEN k = 97 THEN u + 1 ELSE u END AS id_customer,
  k % 20 AS id_site_name, ts AS booked, day AS booked_date,
  day + (k % 30) AS arrival_date, day + (k % 30 + 1 + k % 7) AS departure_date,
  CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE CASE WHEN k % 2 = 0 THEN 5 ELSE 3 END END AS status,
  CASE o_orderpriority WHEN '5-LOW' THEN 2 WHEN '2-HIGH' THEN 3 ELSE 1 END AS type,
  CASE WHEN k % 25 = 8 THEN 33 ELSE 1 END AS site_type, k % 12 AS bednights
FROM d_events JOIN orders ON o_orderkey = event_id WHERE event_type = 'purchase'"""
R["d_customer"] = """
SELECT c_custkey AS id_customer, CASE WHEN c_mktsegment <> 'MACHINERY'
    THEN DATE '2023-12-22' + CAST(c_custkey % 45 AS INTEGER) END AS id_date_first_booking,
  c_custkey * 10 AS id_first_booking FROM customer"""
R["d_calendar"] = """
SELECT DISTINCT CAST(o_orderdate + INTERVAL 27 YEAR AS DATE) AS iddate FROM orders"""
R["d_geo"] = """
SELECT 'N' || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS iso, n_name AS country, r_name AS subcontinent
FROM nation LEFT JOIN region ON r_regionkey = n_regionkey"""
R["d_push"] = """
SELECT u + 1000000 AS id_profile, day AS date_push, CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS push_yn
FROM d_events WHERE event_type = 'error'"""
R["d_social"] = """
SELECT u + 1000000 AS id_profile, day AS created_at, k % 5 = 0 AS photo, k % 5 = 1 AS social
FROM d_events WHERE event_type = 'signup'"""
R["d_attributes"] = """
SELECT u + 1000000 AS profile_id, day AS event_date, CASE WHEN k <> 50 THEN CASE WHEN k % 6 = 0 THEN 1 ELSE 0 END END AS language_flag,
  CASE WHEN k % 8 = 0 THEN 1 ELSE 0 END AS bio_flag, CASE WHEN k % 10 = 0 THEN 1 ELSE 0 END AS city_flag,
  CASE WHEN k % 12 = 0 THEN 1 ELSE 0 END AS interests_flag
FROM d_events WHERE event_type = 'view'"""

# --- installs --------------------------------------------------------------

R["o_devices"] = f"""
SELECT *, {DEVICE} AS device_id,
  coalesce(CASE WHEN lower(partner) = 'undisclosed' THEN 'Facebook' ELSE partner END, 'Unpopulated') AS ad_partner
FROM d_install_log"""
R["o_first_touch"] = f"""
SELECT device_id, {', '.join(f"first({c} ORDER BY ts, {c}) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in TOUCHED)},
  min(ts) AS install_timestamp, CAST(min(ts) AS DATE) AS install_date
FROM o_devices
WHERE name = 'INSTALL' AND platform <> 'TV_APP' AND day BETWEEN {START} AND {INSTALL_END}
  AND device_id <> '00000000-0000-0000-0000-000000000000'
GROUP BY device_id"""
R["o_identity"] = f"""
SELECT device_id, CAST(max(customer_id) AS BIGINT) AS profile_id FROM o_devices
WHERE length(customer_id) > 5 AND customer_id <> 'undefined' AND day BETWEEN DATE '2023-01-01' AND {DATA_END}
  AND device_id <> '00000000-0000-0000-0000-000000000000'
GROUP BY device_id"""
R["o_detail"] = """
SELECT *, CASE
  WHEN ad_partner = 'Google AdWords' AND campaign ILIKE '%_rtg' THEN 'Google - Retargeting'
  WHEN ad_partner = 'Google AdWords' AND campaign NOT ILIKE '%_rtg' THEN 'Google - Prospecting'
  WHEN ad_partner = 'Apple Search Ads' THEN CASE WHEN campaign ILIKE '%brand%' THEN 'ASA - Brand'
    WHEN campaign ILIKE '%broad%' THEN 'ASA - Broad' WHEN campaign ILIKE '%competitors%' THEN 'ASA - Competitors'
    WHEN campaign ILIKE '%generics%' THEN 'ASA - Generics' ELSE 'ASA - Other' END
  WHEN feature IN ('paid advertising', 'undisclosed') AND ad_partner <> 'Push Notifications' THEN ad_partner || ' - paid advertising'
  WHEN channel = 'Affiliates' THEN campaign
  WHEN channel = 'newsletter' OR starts_with(channel, 'CRM') OR (feature = 'email' AND channel IS NULL) THEN 'CRM / Newsletter'
  WHEN feature IN ('marketing', 'organic links', 'Social Media', 'journeys') THEN coalesce(channel, 'Other') || ' - ' || feature
  WHEN coalesce(campaign, channel, feature) IS NULL THEN 'Unknown' ELSE 'Other' END AS install_source_detail
FROM o_first_touch"""
R["o_source"] = """
SELECT *, CASE
  WHEN ad_partner IN ('InMobi', 'Flymobi') THEN 'InMobi / Flymobi'
  WHEN starts_with(install_source_detail, 'Facebook') THEN 'Facebook'
  WHEN starts_with(install_source_detail, 'Own Web') OR install_source_detail = 'Blog - organic links' THEN 'Own Web'
  WHEN starts_with(install_source_detail, 'TikTok') THEN 'TikTok'
  WHEN starts_with(install_source_detail, 'Social Test') THEN 'Social Test'
  WHEN ad_partner IN ('Apple Search Ads', 'Google AdWords') THEN install_source_detail
  WHEN ad_partner NOT IN ('Unpopulated', 'Push Notifications') THEN ad_partner
  WHEN install_source_detail IN ('Unknown', 'CRM / Newsletter') THEN install_source_detail
  ELSE 'Other' END AS install_source
FROM o_detail"""
R["o_placed"] = """
SELECT s.*, CASE WHEN ip_country_code = 'GB' THEN 'UK' ELSE country END AS ip_country,
  CASE WHEN ip_country_code = 'GB' THEN 'UK' ELSE subcontinent END AS ip_region
FROM o_source s LEFT JOIN d_geo ON iso = ip_country_code"""
R["o_installs"] = "SELECT p.*, i.profile_id FROM o_placed p LEFT JOIN o_identity i USING (device_id)"

# --- bookings --------------------------------------------------------------

R["o_star"] = f"""
SELECT b.id_profile, b.id_customer, c.id_date_first_booking, c.id_first_booking, b.id_booking, b.booked, b.booked_date,
  b.arrival_date, b.departure_date, 'APP' AS booking_platform
FROM d_booking b
JOIN d_events a ON a.event_id = b.id_booking AND a.k % 3 <> 0
JOIN d_customer c ON c.id_customer = b.id_customer
JOIN supplier s ON s.s_suppkey = b.id_site_name AND s.s_nationkey % 5 <> 0
JOIN d_calendar d ON d.iddate = c.id_date_first_booking
WHERE b.status IN (1, 2, 5) AND b.type IN (1, 3) AND b.site_type <> 33 AND b.bednights > 0
  AND b.booked_date BETWEEN {START} AND {DATA_END}"""
R["o_pairs"] = """
SELECT i.*, s.* EXCLUDE (id_profile),
  first(s.booked_date ORDER BY s.booked, s.booked_date) OVER (PARTITION BY s.id_customer) AS first_booked_date_any,
  min(s.booked) OVER (PARTITION BY s.id_customer) AS first_booked,
  min(i.install_timestamp) OVER (PARTITION BY s.id_customer) AS first_install_any
FROM o_installs i LEFT JOIN o_star s ON s.id_profile = i.profile_id AND s.booked >= i.install_date"""
_first = "CASE WHEN id_date_first_booking IS NOT NULL AND first_booked_date IS NOT NULL THEN least(id_date_first_booking, first_booked_date) END"
R["o_level"] = f"""
WITH p AS (SELECT * EXCLUDE (first_booked_date_any, first_install_any),
    CASE WHEN id_customer IS NOT NULL THEN first_booked_date_any END AS first_booked_date,
    CASE WHEN id_customer IS NOT NULL THEN first_install_any END AS first_cust_install_timestamp FROM o_pairs),
q AS (SELECT *, {_first} AS first_known, booked_date - install_date AS off,
    booking_platform = 'APP' AND booked > install_timestamp AS counts FROM p)
SELECT *,
  {', '.join(f"CASE WHEN counts AND off BETWEEN {lo} AND {hi} THEN 1 ELSE 0 END AS {b}_app_bookings" for b, (lo, hi) in BUCKETS.items())},
  {', '.join(f"CASE WHEN first_known >= install_date AND first_known - install_date BETWEEN {lo} AND {hi} THEN 1 ELSE 0 END AS {b}_first_bkg" for b, (lo, hi) in BUCKETS.items() if b != 'days0to28')},
  CASE WHEN booked < install_timestamp THEN NULL ELSE {offset('booked', 'install_timestamp')} END AS days_to_app_booking_post_install,
  CASE WHEN first_known < install_date OR first_booked < install_timestamp THEN 'Existing Customer'
    WHEN first_known >= install_date THEN 'New Customer' WHEN first_known IS NULL THEN 'Not a Customer' END AS customer_status,
  CASE WHEN install_timestamp BETWEEN booked AND CAST(arrival_date AS TIMESTAMP) THEN 1 ELSE 0 END AS trip_pending_yn
FROM q"""
R["o_owners"] = "SELECT device_id, count(DISTINCT id_customer) AS owners FROM o_level GROUP BY device_id HAVING count(DISTINCT id_customer) <= 1"
R["o_push"] = """
SELECT DISTINCT p.id_profile, p.date_push, p.push_yn FROM d_push p
JOIN (SELECT id_profile, max(date_push) AS last FROM d_push GROUP BY id_profile) m
  ON m.id_profile = p.id_profile AND m.last = p.date_push"""
_cohort_keys = "device_id, profile_id, install_date, platform, install_source, install_source_detail, ip_country, ip_region, brand, customer_status"


def _install_cohort(push: str) -> str:
    return f"""
SELECT {', '.join('l.' + c.strip() for c in _cohort_keys.split(','))},
  CASE WHEN dayofweek(install_date) IN (0, 6) THEN 1 ELSE 0 END AS installed_on_weekend,
  CASE WHEN l.profile_id IS NULL THEN 0 ELSE 1 END AS profile_created_yn,
  max(coalesce(push_yn, 0)) AS push_yn, min(first_booked_date) AS first_booked_date_post_install,
  {big('sum(days0to28_app_bookings)')} AS days0to28_app_bookings
FROM o_level l JOIN o_owners USING (device_id)
JOIN d_calendar ON iddate = install_date
LEFT JOIN {push} p ON p.id_profile = l.profile_id
WHERE install_date BETWEEN {START} AND {INSTALL_END}
GROUP BY ALL"""


R["o_install_cohort"] = _install_cohort("(SELECT id_profile, max(push_yn) AS push_yn FROM o_push GROUP BY id_profile)")
R["o_install_cohort_parity"] = _install_cohort("o_push")
R["o_earliest"] = f"""
SELECT profile_id, min(event_date) AS earliest_app_usage FROM d_event_log
WHERE event_date BETWEEN DATE '2021-01-01' AND {INSTALL_END}
  AND ((lower(platform) = 'ios' AND (version LIKE '12%' OR version LIKE '13%'))
    OR (lower(platform) = 'android' AND version LIKE '9%')) AND version NOT ILIKE '%staging%'
GROUP BY profile_id"""

# --- activity and milestones ----------------------------------------------


def _activity(name: str, cohort: str) -> str:
    return f"""
SELECT device_id, install_date, min(day) AS first_date, {offset('min(day)', 'install_date')} AS days_to_first,
  max(day) AS last_date, {offset('max(day)', 'install_date')} AS days_to_last, count(*) AS actions,
  count(DISTINCT day) AS active_days, CAST(count(*) AS DOUBLE) / count(DISTINCT day) AS actions_per_active_day
FROM (SELECT DISTINCT device_id, day, ts FROM o_devices WHERE name = '{name}' AND day BETWEEN {START} AND {DATA_END}) a
JOIN {cohort} USING (device_id)
WHERE day - install_date BETWEEN 0 AND 28 GROUP BY device_id, install_date"""


R["o_changes"] = f"""
WITH acc AS (SELECT profile_id, event_date, {', '.join(f"max({f}) OVER w AS {f}" for f in ('language_flag', 'bio_flag', 'city_flag', 'interests_flag'))}
    FROM d_attributes WINDOW w AS (PARTITION BY profile_id ORDER BY event_date RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
sig AS (SELECT DISTINCT *, CAST(language_flag AS VARCHAR) || bio_flag || city_flag || interests_flag AS s FROM acc),
prev AS (SELECT *, lag(s) OVER (PARTITION BY profile_id ORDER BY event_date) AS p FROM sig)
SELECT profile_id, event_date, language_flag, bio_flag, city_flag, interests_flag,
  CASE WHEN language_flag + bio_flag + city_flag + interests_flag = 4 THEN 1 ELSE 0 END AS all_attributes
FROM prev WHERE (s <> p OR p IS NULL) AND language_flag + bio_flag + city_flag + interests_flag > 0
  AND event_date BETWEEN {START} AND {DATA_END}"""
R["o_photos"] = f"SELECT DISTINCT id_profile, created_at, 'Photo Uploaded' AS label FROM d_social WHERE photo AND created_at BETWEEN {START} AND {DATA_END}"
R["o_social"] = f"SELECT DISTINCT id_profile, created_at, 'Y' AS label FROM d_social WHERE social AND created_at BETWEEN {START} AND {DATA_END}"


def _analysis(cohort: str, opens: str, logins: str) -> str:
    return f"""
SELECT *, {offset('profile_info_date', 'install_date')} AS days_to_first_profile_info,
  {offset('pic_uploaded_date', 'install_date')} AS days_to_first_pic_uploaded,
  {offset('social_toggle_date', 'install_date')} AS days_to_first_social_toggle_on
FROM (
SELECT c.*, a.first_date AS first_app_open_date, a.days_to_first AS days_to_first_app_open, a.actions AS app_open_count,
  a.active_days AS app_open_days, a.actions_per_active_day AS avg_app_opens_per_day, a.last_date AS last_app_open_date,
  a.days_to_last AS days_to_last_app_open, {offset('c.install_date + 28', 'a.last_date')} AS days_of_inactivity,
  l.first_date AS first_login_post_install, CASE WHEN l.first_date IS NULL THEN 0 ELSE 1 END AS did_user_ever_logged_in,
  l.days_to_first AS days_to_first_login, l.actions AS login_count,
  min(o.event_date) AS profile_info_date,
  max(o.language_flag) AS language_flag, max(o.bio_flag) AS bio_flag, max(o.city_flag) AS city_flag,
  max(o.interests_flag) AS interest_flag, max(o.all_attributes) AS all_attributes_flag,
  min(ph.created_at) AS pic_uploaded_date, min(so.created_at) AS social_toggle_date,
  max(so.label) AS social_member_yn
FROM {cohort} c
LEFT JOIN {opens} a ON a.device_id = c.device_id
LEFT JOIN {logins} l ON l.device_id = c.device_id
LEFT JOIN o_changes o ON o.profile_id = c.profile_id AND o.event_date - c.install_date BETWEEN 0 AND 28
LEFT JOIN o_photos ph ON ph.id_profile = c.profile_id AND ph.created_at - c.install_date BETWEEN 0 AND 28
LEFT JOIN o_social so ON so.id_profile = c.profile_id AND so.created_at - c.install_date BETWEEN 0 AND 28
LEFT JOIN o_earliest e ON CAST(e.profile_id AS BIGINT) = c.profile_id
WHERE (earliest_app_usage IS NULL OR earliest_app_usage - c.install_date BETWEEN 0 AND 28)
  AND (customer_status = 'Not a Customer' OR (customer_status = 'New Customer' AND days0to28_app_bookings > 0))
  AND profile_created_yn = 1
GROUP BY ALL)"""


for _suffix in ("", "_parity"):
    R[f"o_opens{_suffix}"] = _activity("OPEN", f"o_install_cohort{_suffix}")
    R[f"o_logins{_suffix}"] = _activity("LOGIN", f"o_install_cohort{_suffix}")
    R[f"o_cohort{_suffix}"] = _analysis(f"o_install_cohort{_suffix}", f"o_opens{_suffix}", f"o_logins{_suffix}")

# --- events ----------------------------------------------------------------

R["o_events"] = f"""
SELECT *, coalesce(anonymous_id, pseudo_id, ga_session || first_open_time, profile_id, account_id) AS user_key,
  coalesce(anonymous_id, pseudo_id, ga_session || first_open_time, profile_id, account_id)
    || coalesce(ga_session, first_open_time) || CAST(event_date AS VARCHAR) AS session_key
FROM d_event_log
WHERE event_date BETWEEN {START} AND {DATA_END} AND lower(platform) IN ('ios', 'android') AND version NOT ILIKE '%staging%'"""
R["o_user_map"] = """
SELECT user_key, profile_id, sessions FROM (
  SELECT user_key, profile_id, count(DISTINCT session_key) AS sessions,
    row_number() OVER (PARTITION BY user_key ORDER BY count(DISTINCT session_key) DESC, profile_id DESC) AS rn
  FROM o_events WHERE profile_id IS NOT NULL GROUP BY user_key, profile_id) WHERE rn = 1"""
R["o_resolved"] = """
SELECT e.* EXCLUDE (profile_id), coalesce(e.profile_id, m.profile_id) AS profile_id
FROM o_events e LEFT JOIN o_user_map m USING (user_key)"""


def flag(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 1 ELSE 0 END"


def count_of(condition: str, name: str) -> str:
    return f"{big(f'sum({flag(condition)})')} AS {name}"


HOSTEL, DORM = "item_category ILIKE '%hostel%'", "checkout_room_types ILIKE '%dorm%'"
ACTIONS = {name: "action IN ({})".format(", ".join(f"'{a}'" for a in labels)) for name, labels in PROPERTY_ACTIONS.items()}
DAILY = {
    "search_steps": (
        "page_type = 'Search' AND action IN ('Search Activated', 'Search Step', 'Invalid Destination Displayed', 'Destination Selected')",
        [count_of("action = 'Search Activated'", "search_activated_count"),
         count_of("action = 'Search Step' AND step_name = 'destination'", "started_destn_step_count"),
         count_of("action = 'Invalid Destination Displayed'", "invalid_destn_displayed_count"),
         count_of("action = 'Destination Selected' AND step_name = 'destination'", "destn_selected_step_count"),
         count_of("action = 'Search Step' AND step_name = 'dates'", "started_dates_step_count"),
         count_of("action = 'Search Step' AND step_name = 'guests'", "started_guests_step_count")]),
    "destination_pages": (
        "event_name = 'Destination_Search_Page_Viewed' AND page_type = 'Destination Search' AND destination_country IS NOT NULL",
        ["count(*) AS destination_search_pages_viewed", "avg(number_results) AS avg_number_properties_returned"]),
    "sort_filter": (
        "event_name = 'Destination_Search_Page_Event' AND action IN ('Filter Used', 'Sort Used') AND destination_country IS NOT NULL",
        [count_of("action = 'Filter Used'", "filter_used_count"), count_of("action = 'Sort Used'", "sort_used_count")]),
    "recent_search": (
        "event_name = 'Homepage_Event' AND page_type = 'Homepage' AND action = 'Home Panel Clicked' AND panel_clicked ILIKE 'searches%'",
        ["count(*) AS recent_search_clicks"]),
    "property_views": (
        "lower(event_name) = 'view_item'",
        ["count(*) AS property_page_views", count_of(HOSTEL, "hostels_viewed"), count_of(f"NOT {HOSTEL}", "non_hostels_viewed"),
         "avg(TRY_CAST(position AS DOUBLE)) AS viewed_property_avg_position"]),
    "property_actions": (
        "event_name = 'Property_Details_Page_Event' AND page_type = 'Property Details' AND (lower(action) = 'map view clicked' OR "
        + " OR ".join(ACTIONS.values()) + ")",
        [f"max({flag(c)}) AS {n}" for n, c in ACTIONS.items()]),
    "linkups": ("page_type = 'Linkups View' AND event_name = 'Property_Details_Linkups_View'",
                ["count(*) AS linkups_view_propt_page"]),
    "checkout_starts": ("lower(event_name) = 'begin_checkout'", ["count(*) AS checkout_starts"]),
    "checkout_steps": (
        "action = 'Checkout Step Viewed' OR event_name IN ('begin_checkout', 'Checkout_Confirm_Clicked')",
        [count_of(f"event_name = 'begin_checkout' AND {DORM}", "checkout_dorms_selected_count"),
         count_of(f"event_name = 'begin_checkout' AND NOT {DORM}", "checkout_privates_selected_count"),
         count_of(f"event_name = 'begin_checkout' AND {HOSTEL}", "checkout_hostels_selected_count"),
         count_of(f"event_name = 'begin_checkout' AND NOT {HOSTEL}", "checkout_non_hostels_selected_count"),
         *[count_of(f"step_name = '{v}'", f"started_{n}_step_count") for n, v in (
             ("email", "email"), ("name", "full_name"), ("nationality", "nationality"),
             ("payment_details", "payment_details"), ("confirm_details", "confirm_details"))],
         count_of("event_name = 'Checkout_Confirm_Clicked'", "checkout_confirm_clicked_count")]),
}
for _name, (_where, _measures) in DAILY.items():
    R[f"o_daily_{_name}"] = (f"SELECT event_date, profile_id, {', '.join(_measures)} FROM o_resolved "
                             f"WHERE {_where} GROUP BY event_date, profile_id")
R["o_searches"] = """
SELECT DISTINCT event_date, user_key, profile_id, arrival_date, departure_date, destination_city, destination_country,
  subcontinent AS destination_region, lead_time, number_guests
FROM o_resolved LEFT JOIN d_geo ON lower(country) = lower(destination_country)
WHERE action = 'Search Submitted' AND destination_country IS NOT NULL"""
R["o_homes"] = """
SELECT profile_id, first(ip_country ORDER BY install_date, device_id) AS ip_country, first(ip_region ORDER BY install_date, device_id) AS ip_region
FROM o_install_cohort WHERE profile_id IS NOT NULL GROUP BY profile_id"""
R["o_homes_parity"] = "SELECT profile_id, ip_country, ip_region FROM o_install_cohort_parity WHERE profile_id IS NOT NULL"
for _suffix in ("", "_parity"):
    R[f"o_trips{_suffix}"] = f"""
SELECT s.*, CASE WHEN lower(destination_country) = lower(ip_country) THEN 'domestic'
  WHEN lower(destination_region) = lower(ip_region) THEN 'short-haul'
  WHEN lower(destination_region) <> lower(ip_region) THEN 'long-haul' ELSE 'not-defined' END AS trip
FROM o_searches s LEFT JOIN o_homes{_suffix} h ON h.profile_id = TRY_CAST(s.profile_id AS BIGINT)"""
    R[f"o_daily_search{_suffix}"] = f"""
SELECT event_date, profile_id, count(*) AS searches_submitted, avg(TRY_CAST(lead_time AS DOUBLE)) AS search_avg_lead_time,
  avg(departure_date - arrival_date) AS search_avg_los, avg(number_guests) AS search_avg_pax,
  {count_of("trip = 'domestic'", 'search_domestic_trip')}, {count_of("trip = 'short-haul'", 'search_short_haul_trip')},
  {count_of("trip = 'long-haul'", 'search_long_haul_trip')}
FROM o_trips{_suffix} GROUP BY event_date, profile_id"""

# --- windows ---------------------------------------------------------------

# The columns' names are the report's; what is in them is written out here once more.
# funnel: (value, first date, offset, bucket suffix, totals, means, shares)
WINDOWS = {f: (w.present, w.first_date, w.first_offset, w.bucket_suffix, w.totals, w.means,
               {name: part for name, (part, _) in w.shares.items()}) for f, w in WINDOW_SPECS.items()}
FIRST_ACTION = ACTION_DATES
PER_PROFILE = PROFILE_BLOCKS


def window_sql(funnel: str, cohort: str, daily: str, per_install: bool = True) -> str:
    value, first, days, suffix, totals, means, shares = WINDOWS[funnel]
    off = "(d.event_date - c.install_date)"
    columns = ["c.profile_id"] + (["c.install_date"] if per_install else [])
    keys = len(columns)
    if first:
        columns.append(f"min(d.event_date) AS {first}")
    if days:
        columns.append(f"{offset('min(d.event_date)', 'c.install_date')} AS {days}")
    if suffix:
        columns += bucket_sums(off, value, suffix)
    columns += [f"{big(f'sum({t})')} AS {t}" for t in totals]
    columns += [f"avg({m}) AS {m}" for m in means]
    columns += [f"{share(n, value)} AS {name}" for name, n in shares.items()]
    return (f"SELECT {', '.join(columns)} FROM {cohort} c JOIN {daily} d ON TRY_CAST(d.profile_id AS BIGINT) = c.profile_id "
            f"AND {off} BETWEEN 0 AND 28 GROUP BY {', '.join(str(i + 1) for i in range(keys))}")


R["o_keys"] = "SELECT DISTINCT profile_id, install_date FROM o_cohort WHERE first_app_open_date IS NOT NULL"
for _name in WINDOWS:
    R[f"o_window_{_name}"] = window_sql(_name, "o_keys", f"o_daily_{_name}")
    R[f"o_parity_{_name}"] = window_sql(_name, "o_cohort_parity", f"o_daily_{_name}{'_parity' if _name == 'search' else ''}",
                                        _name not in PER_PROFILE)
_action_rows = ", ".join(f"CASE WHEN {n} = 1 THEN d.event_date END AS {n}_date, {n}" for n in ACTIONS)
_action_sums = ", ".join(
    f"min({n}_date) AS {first}, {offset(f'min({n}_date)', 'c.install_date')} AS {days}, {big(f'sum({n})')} AS {n}"
    for n, (first, days) in FIRST_ACTION.items())
R["o_action_flags"] = f"""
SELECT c.profile_id, c.install_date, d.event_date, {_action_rows}
FROM o_keys c JOIN o_daily_property_actions d
  ON TRY_CAST(d.profile_id AS BIGINT) = c.profile_id AND d.event_date - c.install_date BETWEEN 0 AND 28"""
R["o_window_actions"] = f"SELECT c.profile_id, c.install_date, {_action_sums} FROM o_action_flags c GROUP BY 1, 2"
R["o_parity_actions"] = f"""
SELECT c.profile_id, c.install_date, {_action_sums} FROM o_cohort_parity c JOIN (
  SELECT c.profile_id, c.install_date AS seen_from, d.event_date, {_action_rows}
  FROM (SELECT DISTINCT profile_id, install_date FROM o_cohort_parity) c JOIN o_daily_property_actions d
    ON TRY_CAST(d.profile_id AS BIGINT) = c.profile_id AND d.event_date - c.install_date BETWEEN 0 AND 28) pi
  ON pi.profile_id = c.profile_id
GROUP BY 1, 2"""


def wide_sql(columns: list[str]) -> str:
    joins = " ".join(f"LEFT JOIN o_window_{n} USING (profile_id, install_date)" for n in [*WINDOWS, "actions"])
    return f"SELECT {', '.join(columns)} FROM (SELECT *, profile_id AS idprofile FROM o_cohort) {joins} WHERE first_app_open_date IS NOT NULL"


def parity_sql(columns: list[str]) -> str:
    joins = " ".join(
        f"LEFT JOIN {f'o_parity_{n}' if n in PER_PROFILE else f'(SELECT * EXCLUDE (install_date) FROM o_parity_{n})'} USING (profile_id)"
        for n in [*WINDOWS, "actions"])
    return f"SELECT {', '.join(columns)} FROM (SELECT *, profile_id AS idprofile FROM o_cohort_parity) {joins} WHERE first_app_open_date IS NOT NULL"


def select(body: str) -> str:
    """The statement with the relations it needs, in order of their definition."""
    needed: set[str] = set()
    todo = [body]
    while todo:
        for name in set(re.findall(r"\b[do]_[a-z_]+\b", todo.pop())):
            if name in RELATIONS and name not in needed:
                needed.add(name)
                todo.append(RELATIONS[name])
    ordered: list[str] = []

    def place(name: str) -> None:
        if name in ordered:
            return
        for used in sorted(set(re.findall(r"\b[do]_[a-z_]+\b", RELATIONS[name]))):
            if used in RELATIONS and used != name:
                place(used)
        ordered.append(name)

    for name in sorted(needed):
        place(name)
    ctes = ",\n".join(f"{n} AS ({RELATIONS[n].strip()})" for n in ordered)
    return f"WITH {ctes}\n{body}" if ctes else body
