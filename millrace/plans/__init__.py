"""From statements to plans: parsing, the catalog and the change log."""
