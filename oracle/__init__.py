"""Independent SQL for every query, run by DuckDB on the same Parquet tables.

Money is carried in whole cents and ratios in whole hundredths, so both engines
agree to the last digit.
"""

from oracle.compose import compose

__all__ = ["compose"]
