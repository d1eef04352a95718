"""Query plans over event tables: pages, groups, facets, folded state, reports."""
