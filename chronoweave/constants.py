"""Fixed values that define results."""

SECOND = 1000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR

MERGE_GAP = 5 * MINUTE
MIN_PERIOD = 10 * MINUTE
SOFT_CLOSE = 30 * MINUTE
BUCKET_SLACK = 60 * SECOND
DAY_START_HOUR = 6
PROXIMITY = 10 * MINUTE
MIN_SESSION = 60 * SECOND
HALF_LIFE_DAYS = 14
CLUSTER_THRESHOLD = 3600.0
COCOA_EPOCH_S = 978_307_200
OPEN_PERIOD_SLACK = 5 * SECOND
COVERAGE_SLACK = 5 * MINUTE
REFRESH_TTL = 5 * MINUTE
ARCHIVE_LOOKBACK_DAYS = 2
#: Labels of intervals, in the order of their codes.
LABELS = ("active", "break", "transit")
#: Version of tables whose places are named with their kind.
PLACE_VERSION = 1
