"""Plan building blocks shared by the operators: skew handling, ordered scans, storage."""
