"""Writers of the two Parquet layouts, and how a result is published."""
