"""chronofold: versioned and branched data, and decision-support SQL, as Spark jobs."""
