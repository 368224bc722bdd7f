"""Names, formats and limits that results have to agree on."""

# Keys of the JSON task parameter.
PARAM_START_DATE = "startDate"
PARAM_END_DATE = "endDate"
PARAM_START_AGE = "startAge"
PARAM_END_AGE = "endAge"
PARAM_PROFESSIONALS = "professionals"
PARAM_CITIES = "cities"
PARAM_SEX = "sex"
PARAM_KEYWORDS = "keywords"
PARAM_CATEGORY_IDS = "categoryIds"
PARAM_TARGET_PAGE_FLOW = "targetPageFlow"

# Date and time formats. A single H reads both "5:03:09" and "05:03:09".
TIME_PARSE_FORMAT = "yyyy-MM-dd H:mm:ss"
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
DATE_FORMAT = "yyyy-MM-dd"
DATE_HOUR_FORMAT = "yyyy-MM-dd_HH"
DATE_KEY_FORMAT = "yyyyMMdd"
MINUTE_KEY_FORMAT = "yyyyMMddHHmm"

# Visit-length buckets in seconds, inclusive; None means open. Zero is in no bucket.
VISIT_LENGTH_BUCKETS = (
    ("1s_3s", 1, 3),
    ("4s_6s", 4, 6),
    ("7s_9s", 7, 9),
    ("10s_30s", 10, 30),
    ("30s_60s", 31, 60),
    ("1m_3m", 61, 180),
    ("3m_10m", 181, 600),
    ("10m_30m", 601, 1800),
    ("30m", 1801, None),
)

# Step-length buckets in actions, inclusive; None means open.
STEP_LENGTH_BUCKETS = (
    ("1_3", 1, 3),
    ("4_6", 4, 6),
    ("7_9", 7, 9),
    ("10_30", 10, 30),
    ("30_60", 31, 60),
    ("60", 61, None),
)

# Level labels per area; the letter case is part of the result.
AREA_LEVELS = (
    ("A level", ("China North", "China East")),
    ("B Level", ("China South", "China Middle")),
    ("C Level", ("West North", "West South")),
)
OTHER_AREA_LEVEL = "D Level"

# Product status labels.
OWN_PRODUCT_FLAG = "0"
OWN_PRODUCT = "Self"
THIRD_PARTY_PRODUCT = "Third Party"

# Sizes of the reports.
EXTRACT_SESSIONS = 100
TOP_CATEGORIES = 10
TOP_SESSIONS_PER_CATEGORY = 10
TOP_PRODUCTS_PER_AREA = 3
TOP_ADS_PER_PROVINCE = 3
TREND_MINUTES = 60
