"""Event windows over batches and streams (an extension: the batch reference has none)."""
