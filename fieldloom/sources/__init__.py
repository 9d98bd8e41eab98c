"""Sources of pages, tokens, requests and work queues."""
