"""Public column vocabulary and policy constants. Results depend on these names and numbers."""

TECHNICAL = [
    "returns", "volatility", "rsi", "macd", "macd_signal", "macd_hist", "sma_20", "sma_50", "sma_200",
    "bb_upper", "bb_lower", "bb_width", "momentum",
]
FUNDAMENTAL = ["pe_ratio", "eps", "revenue_growth", "roe", "debt_to_equity"]
SENTIMENT = ["sentiment_score", "news_count", "positive_ratio", "negative_ratio", "sentiment_std"]
LAG = [
    "returns_lag1", "returns_lag2", "returns_lag3", "returns_lag5", "volatility_lag5", "rsi_lag3",
    "volume_change", "volume_lag1",
]
PRICE = [
    "returns_3d", "returns_10d", "returns_20d", "dist_52w_high", "dist_52w_low", "volume_ratio", "obv_change", "bb_pct",
]
SECTOR = ["ret1d_vs_sector", "ret5d_vs_sector", "sector_ret1d", "sector_vol5d", "sector_rsi"]
MACRO = [
    "spy_return", "spy_vol_5d", "vix_level", "vix_change", "qqq_return", "tlt_return", "gld_return",
    "spy_qqq_spread", "vix_spy_ratio",
]
# features whose percentile rank among the tickers of a date is a feature of its own
RANKED = [
    "returns", "returns_3d", "returns_10d", "returns_20d", "rsi", "momentum", "volatility", "volume_ratio", "macd_hist", "bb_pct",
    "dist_52w_high", "obv_change",
]
CROSS_SECTION = [f"{c}_rank" for c in RANKED]

GROUPS = {
    "Technical": TECHNICAL + LAG,
    "Macro": MACRO,
    "Sector": SECTOR,
    "Price patterns": PRICE,
    "Fundamental": FUNDAMENTAL,
    "Sentiment": SENTIMENT,
}

# accepted source keys for each ratio, first non-blank wins
RATIO_KEYS = {
    "pe_ratio": ["PERatio", "PERatioTTM", "PE"],
    "eps": ["EPS", "DilutedEPS"],
    "revenue_growth": ["QuarterlyRevenueGrowthYOY", "RevenueGrowthYOY", "RevenueGrowth"],
    "roe": ["ReturnOnEquityTTM", "ReturnOnEquity", "ROE"],
    "debt_to_equity": ["DebtToEquityRatio", "QuarterlyDebtToEquity", "DebtToEquity"],
}

# vendor fundamentals field -> table column
FUNDAMENTAL_FIELDS = {
    "trailingPE": "pe_ratio",
    "trailingEps": "eps",
    "returnOnEquity": "roe",
    "debtToEquity": "debt_to_equity",
    "revenueGrowth": "revenue_growth",
    "marketCap": "market_cap",
    "dividendYield": "dividend_yield",
    "priceToBook": "price_to_book",
    "earningsGrowth": "earnings_growth",
    "currentRatio": "current_ratio",
    "grossMargins": "gross_margin",
    "operatingMargins": "operating_margin",
    "shortName": "name",
    "sector": "sector",
    "industry": "industry",
}

PERIOD_ROWS = {"1m": 22, "3m": 66, "6m": 126, "1y": 252, "2y": 504, "max": None}
SIGNAL_LEVELS = [(0.70, "Strong Buy"), (0.55, "Buy"), (0.45, "Hold")]
SIGNAL_FLOOR = "Sell"
TRADING_DAYS = 252
