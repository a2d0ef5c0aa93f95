"""Sources: tables, page files, cache shards."""
