"""Monitoring analytics for deployed classifiers, as DataFrame-in, DataFrame-out operators."""
