"""Spectral Lake: mass-spectrometry-imaging data as Spark DataFrames."""

__version__ = "0.2.0"
