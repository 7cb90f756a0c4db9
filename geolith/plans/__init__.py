"""From a selector's text to a column."""
