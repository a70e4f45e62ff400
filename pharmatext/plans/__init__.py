"""Scale helpers (joins, ranks, shared storage) and the dataset / classifier front end."""
