"""punctua: Spark-native reliability analytics for scheduled and live mobility data."""
