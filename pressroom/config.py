"""Fixed values of the pipeline's stages."""

VAL_FRACTION = 0.10  # of the earlier period's time span
POPULARITY_TOP = 500
POSITIONAL_DECAY = 0.9
ENGAGEMENT_HALFLIFE_HOURS = 168.0
SESSION_GAP_MINUTES = 30
CTR_PRIOR = 50.0
CANDIDATES_K = 200
POOL_HOURS, BACKFILL_HOURS, CLICK_LAG_MINUTES = 1, 24, 10
BM25_K1, BM25_B = 1.5, 0.75
QUERY_WINDOW, KEYWORDS = 10, 10
POOL_DECAY = 0.7
NEGATIVES_HARD, NEGATIVES_RANDOM, WU_NEGATIVES = 0, 49, 4
HISTORY_LENGTH, TITLE_TOKENS = 20, 30
COLD_HISTORY, HEAD_FRACTION, MIN_SLICE = 5, 0.2, 30
BOOTSTRAP_DRAWS, CONFIDENCE, SEED = 1000, 0.95, 42

MICROS_HOUR = 3_600_000_000
MICROS_MINUTE = 60_000_000
