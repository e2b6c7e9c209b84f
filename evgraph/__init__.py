"""Evidence graphs on Spark: ingestion rules, signals, an event-folded graph and its views."""
