"""tillcast: merchant revenue analytics and probabilistic forecasting on Spark.

Raw payment attempts become a merchant-day fact, the fact becomes a dense daily
panel, the panel becomes quantile forecasts, and actuals plus forecasts become
merchant-months.  Every operator takes DataFrames and returns a DataFrame.
"""

from tillcast.config import Config

__all__ = ["Config"]
