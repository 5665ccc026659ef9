"""Country-level risk analytics over coded event records, as Spark DataFrame operators."""
