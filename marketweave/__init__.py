"""Spark-native market and text analytics: DataFrame in, DataFrame out."""
