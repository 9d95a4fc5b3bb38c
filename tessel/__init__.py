"""Panel analytics on PySpark: daily bars, cross-sectional factors, portfolios, models and their tests."""
