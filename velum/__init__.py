"""velum: personal-data detection, pseudonymisation and text preparation on Spark DataFrames."""

__version__ = "0.1.0"
