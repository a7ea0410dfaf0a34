"""notefold: a Spark-first analytics engine for captured web-note archives."""
