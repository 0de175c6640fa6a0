"""Listing-price analytics as Spark jobs."""
