"""DataFrame operators: enrichment, roles, state, feed, discovery."""
