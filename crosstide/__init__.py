"""Point-in-time screening and cross-sectional research as Spark DataFrame operators."""
