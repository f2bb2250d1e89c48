"""Files assembled byte by byte from the formats' descriptions, not by the library's writers."""

from statloom.plans.samples import as_cells, catalog, doubles, nan, rdc, rle_literal, sas7bdat, sav

__all__ = ["as_cells", "catalog", "doubles", "nan", "rdc", "rle_literal", "sas7bdat", "sav"]
