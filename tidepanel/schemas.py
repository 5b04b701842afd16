"""Dimensions and constants of the market model."""

from __future__ import annotations

from pyspark.sql import types as T

# Sectors in the order that decides ties, pivots and matrices, their tickers and keywords.
SECTORS = ("Banking", "RealEstate", "SteelMaterials", "Technology", "ConsumerStaples", "ConsumerDiscretionary", "Energy", "IndustrialLogistics", "Healthcare", "Utilities")
SECTOR_TICKERS = {
    "Banking": ("VCB", "BID", "CTG"),
    "RealEstate": ("VIC", "VHM", "NVL"),
    "SteelMaterials": ("HPG", "HSG", "NKG"),
    "Technology": ("FPT", "CMG", "VGI"),
    "ConsumerStaples": ("MSN", "SAB", "VNM"),
    "ConsumerDiscretionary": ("MWG", "PNJ", "DGW"),
    "Energy": ("GAS", "PLX", "PVD"),
    "IndustrialLogistics": ("GMD", "HAH", "ACV"),
    "Healthcare": ("DHG", "IMP", "DMC"),
    "Utilities": ("POW", "NT2", "REE"),
}
SECTOR_KEYWORDS = {
    "Banking": ("ngân hàng", "bank"),
    "RealEstate": ("bất động sản", "địa ốc", "nhà ở", "khu công nghiệp", "kcn"),
    "SteelMaterials": ("thép", "vật liệu", "vật liệu xây dựng", "hóa chất", "cao su", "xi măng", "nhựa"),
    "Technology": ("công nghệ", "viễn thông", "phần mềm", "điện tử"),
    "ConsumerStaples": ("thực phẩm", "đồ uống", "sữa", "bia", "hàng tiêu dùng thiết yếu", "nông nghiệp"),
    "ConsumerDiscretionary": ("bán lẻ", "hàng tiêu dùng", "vàng bạc", "phân phối", "ô tô", "xe"),
    "Energy": ("dầu khí", "xăng dầu", "khí", "nhiên liệu"),
    "IndustrialLogistics": ("logistics", "cảng", "cảng biển", "hàng không", "vận tải", "giao thông vận tải", "sân bay", "kho vận"),
    "Healthcare": ("y tế", "dược", "bệnh viện", "chăm sóc sức khỏe"),
    "Utilities": ("điện", "nước", "tiện ích", "năng lượng tái tạo"),
}
MACRO_KEYWORDS = ("vĩ mô", "kinh tế vĩ mô", "lãi suất", "tỷ giá", "cpi", "gdp", "thuế", "chính sách", "thị trường chung", "chứng khoán", "tài chính")
MACRO, UNMAPPED = "MarketMacro", "Unmapped"
# Columns that may name the tickers of an article, in the order in which they are tried.
TICKER_COLUMNS = ("summary_json.tickers", "summary_tickers", "tickers", "ticker", "ticker_raw")
# Words of the three sentiments, folded.
SENTIMENT_LABELS = {
    "Positive": ("positive", "tich cuc"),
    "Neutral": ("neutral", "trung lap", "trung tinh"),
    "Negative": ("negative", "tieu cuc"),
}
# Names of price columns, lower case, letters and digits alone.
OHLCV_ALIASES = {
    "trade_date": ("time", "date", "tradingdate", "tradedate"),
    "open": ("open", "openprice"),
    "high": ("high", "highprice"),
    "low": ("low", "lowprice"),
    "close": ("close", "closeprice"),
    "volume": ("volume", "vol", "totalvolume"),
}
MARKET_ZONE = "Asia/Ho_Chi_Minh"
SESSION_CUTS = ("09:00:00", "11:30:00", "14:45:00")
NEUTRAL_EPS = 0.05
MAX_LAG, MIN_OBSERVATIONS, ALPHA = 5, 60, 0.05
LEAD_LAG_MIN_OBSERVATIONS = 30
QAP_PERMUTATIONS, QAP_SEED = 2000, 42
P_FLOOR = 1e-12
CONSTANT_SIGMA = 1e-12
# Columns of the prices.
OHLCV = "trade_date date, ticker string, open double, high double, low double, close double, volume double"
# Columns of the daily sentiment of an entity.
SENTIMENT_METRICS = ("article_count", "row_count", "weighted_article_count", "sentiment_mean", "sentiment_sum", "weighted_sentiment_sum", "sentiment_weighted_mean", "positive_count", "neutral_count", "negative_count", "positive_weighted_count", "neutral_weighted_count", "negative_weighted_count")

SUMMARY = T.StructType(
    [
        T.StructField("summary", T.ArrayType(T.StringType())),
        T.StructField("tickers", T.ArrayType(T.StringType())),
        T.StructField("impact", T.StringType()),
        T.StructField("sentiment_score", T.DoubleType()),
        T.StructField("key_metrics", T.MapType(T.StringType(), T.StringType())),
        T.StructField("sector", T.StringType()),
    ]
)
