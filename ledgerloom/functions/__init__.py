"""Column builders: money, dates and banking days, narrations, fees, stable ids."""
