"""An analytics engine on Spark that decides whether sequence resources share one coordinate system."""
