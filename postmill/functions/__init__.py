"""Column transforms: ``Column -> Column``, evaluated inside whole-table jobs."""
