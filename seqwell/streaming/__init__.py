"""Open-ended inserts, reads, writes and takes."""
