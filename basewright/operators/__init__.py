"""Pileup, peaks, classification and interval operators over DataFrames."""
