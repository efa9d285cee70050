"""Price-bar analytics on Spark: bars, indicators, signals, waves, patterns."""
