"""Lookups over streams: an extension, as maps themselves don't stream."""
