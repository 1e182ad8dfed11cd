"""Column-level building blocks; everything here is native Spark unless it says otherwise."""
