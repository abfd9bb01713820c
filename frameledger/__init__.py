"""frameledger: a PySpark-native ledger of image frames and the judgments made about them."""

__version__ = "0.1.0"
