"""Fixed limits of queries and of ingestion."""

# Queries
MAX_RANGE_DAYS = 366
MAX_BUCKETS = 1_000
MAX_FILTERS = 10
MIN_FUNNEL_STEPS = 2
MAX_FUNNEL_STEPS = 10
MAX_FUNNEL_WINDOW_SECONDS = 90 * 86_400
MAX_PERIODS = 52
MAX_INACTIVITY_MINUTES = 240
MAX_LISTING_DAYS = 90
BREAKDOWN_LIMIT = 10

# Names
MAX_EVENT_NAME = 128
MAX_PROPERTY_NAME = 128
MAX_DISTINCT_ID = 255

# Ingestion
MAX_BATCH_EVENTS = 500
MAX_PROPERTIES_BYTES = 32_000
MAX_FUTURE_SKEW_SECONDS = 60
QUOTA_EVENTS_PER_SECOND = 5_000.0
QUOTA_BURST = 50_000
MAX_PLAN_EVENTS = 1_000

# Stream
DEDUP_WINDOW = "24 hours"
# A micro-batch pays off from many rows on; a consumer that polls takes 5,000 at a time.
MAX_RECORDS_PER_TRIGGER = 1_000_000

# Report histogram edges
BATCH_SIZE_EDGES = (1, 5, 10, 25, 50, 100, 250, 500)
FRESHNESS_EDGES = (0.1, 0.25, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0, 60.0, 300.0)
