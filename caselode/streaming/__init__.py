"""Structured Streaming forms of batch operators: an extension, the batch semantics being the contract."""
