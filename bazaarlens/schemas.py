"""Table schemas of the marketplace star and the vocabulary shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(),
    "date": T.DateType(), "boolean": T.BooleanType(), "timestamp_ntz": T.TimestampNTZType(),
}


def _struct(text: str) -> T.StructType:
    pairs = [part.split() for part in text.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


DIM_LISTING = _struct(
    "item_id string, seller_id string, category int, title string, seller_type string, ad_type string, "
    "ad_status string, area_sqm double, bedrooms double, bathrooms double, floors double, width_m double, "
    "direction string, legal_status string, house_type string, furnishing string, city_name string, "
    "district_name string, ward_name string, project_id string, price_bucket string, images_count double, "
    "posted_date date, expected_expired_date date"
)
LISTING_SNAPSHOT = _struct(
    "item_id string, date date, views_24h double, contacts_24h double, listing_age_days double"
)
POST_CONTACT = _struct(
    "user_id string, item_id string, date date, adview_count double, lead_count double, "
    "chat_message_count double, chat_turn_count double, chat_lead double, purchased boolean, category int"
)
USER_EVENTS = _struct(
    "is_login string, user_id string, session_id string, event_id string, item_id string, city_name string, "
    "category int, event_type string, query string, event_ts timestamp_ntz, surface string, position double, "
    "device string, dwell_time_sec double, is_contact int, date date"
)
TEST_USERS = _struct("user_id string")
RANKED_LIST = _struct("ID long, user_id string, rank int, item_id string")
CITY_REGION = _struct("city_name_raw string, region string, is_hcmc int")
CITY_ALIAS = _struct("city_name_raw string, name_vi_geo string")

STAR = {
    "dim_listing": DIM_LISTING,
    "fact_listing_snapshot": LISTING_SNAPSHOT,
    "fact_post_contact_interactions": POST_CONTACT,
    "fact_user_events": USER_EVENTS,
    "test_users": TEST_USERS,
}

# Fixed values of the marketplace.
PAGEVIEW = "pageview"
OTHER = "other_interaction"
EXPLICIT = ["view_phone", "contact_chat", "contact_zalo", "contact_sms"]
POSITIVE = ["view_phone", "contact_chat", "other_interaction", "contact_zalo", "contact_sms"]
LOGIN = "login"
CATEGORIES = [1010, 1020, 1030, 1040, 1050]
