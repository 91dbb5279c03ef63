"""No operator here needs a stream: snapshots and feeds arrive as files and are read in batches."""
