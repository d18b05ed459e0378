"""PySpark-native analytics for latent-ability measurement, release forecasting and corpus preparation."""
