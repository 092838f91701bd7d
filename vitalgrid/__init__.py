"""Clinical event jobs on Spark: raw tables to events, concepts, time grids, severity scores and shards."""
