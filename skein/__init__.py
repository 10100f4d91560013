"""Skein: FLWOR queries over typed collections, lowered to Spark DataFrames."""
