"""DataFrame operators. None of them runs a job; the caller decides when to write."""
