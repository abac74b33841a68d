"""Declared schemas of the domain tables, so that no scan infers types."""

from __future__ import annotations

SCHEMAS: dict[str, str] = {
    "install_log": """
        name string, timestamp_iso string, user_data_aaid string, user_data_idfa string,
        user_data_android_id string, user_data_idfv string, user_data_ip string,
        user_data_platform string, user_data_brand string, user_data_geo_country_code string,
        campaign string, channel string, feature string, advertising_partner_name string,
        marketing_title string, custom_data map<string,string>""",
    "event_log": """
        event_date date, event_name string, platform string, profile_id string,
        user_pseudo_id string, event_parameters string, user_properties string, app_info string""",
    "booking": """
        id_booking bigint, id_profile bigint, id_customer bigint, id_site_name int,
        booked timestamp_ntz, booked_date date, arrival_date date, departure_date date,
        id_booking_status int, id_booking_type int, id_site_type int, bednights int""",
    "booking_attribution": "id_booking bigint, booking_platform string",
    "customer": "id_customer bigint, id_date_first_booking date, id_first_booking bigint",
    "site": "id_site_name int, site_brand string",
    "calendar": "iddate date, idyear int, idmonth int, monthnameshort string",
    "country": "countryiso2 string, country string, id_subcontinent int",
    "subcontinent": "id_subcontinent int, subcontinent string",
    "push_status": "id_profile bigint, date_push date, push_opt_in string",
    "social_auth": "id_profile bigint, created_at date, photo_flag string, social_flag string",
    "profile_attributes": """
        profile_id bigint, event_date date, language_flag int, bio_flag int,
        city_flag int, interests_flag int""",
}

# The five identifiers of an install-log row, most stable first.
DEVICE_ID_COLUMNS = (
    "user_data_aaid",
    "user_data_idfa",
    "user_data_android_id",
    "user_data_idfv",
    "user_data_ip",
)
