"""Match-event analytics on Spark: DataFrame in, DataFrame out, all matches at once."""
