"""All registered queries and their check SQL."""

from billweave.plans import catalog_layout, catalog_outcome, catalog_tags, catalog_text

_ENTRIES = {
    **catalog_text.ENTRIES, **catalog_layout.ENTRIES, **catalog_tags.ENTRIES, **catalog_outcome.ENTRIES,
}

QUERIES = {name: query for name, (query, _) in _ENTRIES.items()}
CHECK_SQL = {name: sql for name, (_, sql) in _ENTRIES.items() if sql}
