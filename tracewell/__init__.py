"""Search over large collections of log lines, and corpus operators, on Spark."""
