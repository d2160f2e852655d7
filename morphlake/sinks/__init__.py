"""Writers: prediction logs as Parquet, JSON or compatible JSON lines."""
