"""DataFrame operators of a sync: extract, augment, upsert, fan out, check, and query the run log."""
