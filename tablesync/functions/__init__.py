"""Column-level building blocks: types, checksums, identifiers, time helpers, join sizing."""
