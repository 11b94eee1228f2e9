"""Nothing is streamed: the surveyed work has no streaming operators."""
