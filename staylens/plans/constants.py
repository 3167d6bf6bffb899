"""Report parameters.

Fixed values (they must equal the original analysis for equal results):

- top-k for every ranking: 10
- vacancy thresholds: below 0.6 for all listings, below 0.51 for the popular ones
- review features: review_scores_accuracy, review_scores_checkin,
  review_scores_cleanliness, review_scores_communication,
  review_scores_location, review_scores_rating, review_scores_value
- review sentinel for a missing score: -1
- number-of-reviews bucket width: 10 (function default 50)
- numbers parsed from text: cleaning_fee, security_deposit,
  host_acceptance_rate, host_response_rate, extra_people
- phrase-list columns: host_verifications, amenities
- sparse-column share: 0.5
- split: 30% test, seed 42
- forest: 400 trees, depth 6, seed 42
- redundant columns dropped before the model: the list below
"""

TOP_K = 10
LOW_VACANCY = 0.6
LOW_VACANCY_POPULAR = 0.51
REVIEW_FEATURES = (
    "review_scores_accuracy", "review_scores_checkin", "review_scores_cleanliness",
    "review_scores_communication", "review_scores_location", "review_scores_rating",
    "review_scores_value",
)
REVIEW_SENTINEL = -1
REVIEW_BUCKET_WIDTH = 10
DEFAULT_BUCKET_WIDTH = 50
NUMBER_TEXT_FEATURES = (
    "cleaning_fee", "security_deposit", "host_acceptance_rate", "host_response_rate",
    "extra_people",
)
PHRASE_FEATURES = ("host_verifications", "amenities")
SPARSE_SHARE = 0.5
TEST_SHARE = 0.3
SEED = 42
FOREST_TREES = 400
FOREST_DEPTH = 6
REDUNDANT_COLUMNS = (
    "weekly_price", "monthly_price", "first_review", "last_review",
    "calendar_last_scraped", "calendar_updated",
    "country", "country_code", "smart_location", "market", "state", "city",
    "neighbourhood_group_cleansed", "neighbourhood", "street", "host_neighbourhood",
    "host_picture_url", "host_thumbnail_url", "host_about", "host_location",
    "host_since", "host_name", "host_url", "xl_picture_url", "picture_url", "medium_url",
    "thumbnail_url", "transit", "notes", "neighborhood_overview", "description",
    "space", "summary", "name", "last_scraped", "listing_url", "zipcode",
    "calculated_host_listings_count", "host_total_listings_count", "host_listings_count",
    "id", "scrape_id", "host_id",
)
