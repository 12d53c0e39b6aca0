"""Fixed values that decide results, kept together and stated plainly."""

# --- fixed values: market data -------------------------------------------------
PRICE_COLUMNS = ["symbol", "bar_date", "open", "high", "low", "close", "adj_close", "volume"]
CSV_COLUMNS = ["symbol", "date", "open", "high", "low", "close", "adj_close", "volume"]
ISO_DATE_PATTERN = r"^\d{4}-\d{2}-\d{2}$"
UNAVAILABLE_STATUS = "no-yahoo-data"
MAX_DAILY_MOVE = 0.5
MIN_TRAINING_ROWS = 500
SPARSE_COVERAGE = 0.4
UNIVERSE_TOP_N = 30

# --- fixed values: proposals and execution -------------------------------------
MIN_REWARD_RISK = 1.05
MIN_STOP_DISTANCE = 0.0025
BROKERAGE_PER_SIDE = 3.0
SLIPPAGE_BPS_PER_SIDE = 5.0
INITIAL_CAPITAL = 10_000.0
MAX_POSITIONS = 2
MIN_AVG_TRADED_VALUE = 2_000_000.0
LOOKBACK_BARS = 90
TRADED_VALUE_BARS = 10
MAX_SCREEN_HORIZON = 30
SCREEN_MIN_SIGNALS = 30

# --- fixed values: ensemble grading --------------------------------------------
BASE_RATE = 0.45
ENSEMBLE_LAMBDA = 0.5
LOGIT_EPS = 1e-3

# --- fixed values: scoring -------------------------------------------------------
PROFILE_WEIGHTS = {"conservative": 2, "moderate": 3, "aggressive": 1}
TIME_WINDOWS = 6
TRADE_TRIM_SHARE = 0.05
TIME_FACTOR_FLOOR = 0.80
RECENCY_DECAY = 0.85
RECENCY_RANGE = (0.90, 1.05)
SYMBOL_FACTOR_FLOOR = 0.85
MIN_TRADES_FOR_SCORE = 8
FULL_CONFIDENCE_TRADES = 20
PERFORMANCE_WINDOW = 20
PERFORMANCE_MIN_SAMPLE = 10
PERFORMANCE_MIN_WIN_RATE = 0.35
PERFORMANCE_MAX_DRAWDOWN_R = 5.0

# --- fixed values: gates and audits ---------------------------------------------
MIN_POSITIVE_FOLD_RATE = 0.6
MAX_FOLD_DRAWDOWN_PCT = 30.0
MIN_TOTAL_TRADES = 30
MAX_SINGLE_TRADE_SHARE = 0.5
REDUNDANCY_CORRELATION = 0.9
REDUNDANCY_MAX_JACCARD = 0.1

# --- fixed values: resampling ----------------------------------------------------
COUNTER_STEP = 0x6D2B79F5
BOOTSTRAP_SEED = 0xC0FFEE
BOOTSTRAP_DRAWS = 1000
BOOTSTRAP_BLOCK = 10
BOOTSTRAP_QUANTILE = 0.9
MIN_INCUMBENT_TRADES = 8
CORRELATION_SEED = 0xBEEF
CORRELATION_RESAMPLES = 2000
CORRELATION_ALPHA = 0.05
RUIN_PATHS = 500
RUIN_DRAWDOWN = 0.5
RUIN_QUANTILE = 0.95
RISK_RATES = [0.005, 0.01, 0.015, 0.02]
HURDLE_RATE = 5.0
SESSIONS_PER_YEAR = 252
PERTURB_AMPLITUDE = 0.002
PARAMETER_POINTS = 8

# --- fixed values: risk choice per profile (ruin ceiling, drawdown ceiling) ------
RISK_CEILINGS = {
    "conservative": (0.004, 0.25),
    "moderate": (0.01, 0.35),
    "aggressive": (0.02, 0.45),
}
SORTINO_TIE = 0.01

# --- fixed values: forecasts -----------------------------------------------------
QUANTILE_LEVELS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
FORECAST_HORIZONS = [1, 5, 10, 20]
FEATURE_HORIZON = 10
ERROR_TEXT_LIMIT = 240
