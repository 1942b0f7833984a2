"""Order analytics over change streams, written as Spark DataFrame operators."""
