"""Cadenza: analytics for ride recordings and road networks on Spark."""
