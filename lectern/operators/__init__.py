"""DataFrame operators. Rows are keyed by ``doc_id``; order is always an explicit column."""
