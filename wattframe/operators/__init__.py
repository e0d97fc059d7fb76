"""DataFrame-to-DataFrame operators.  All lazy; only ``store`` reads and writes paths."""
