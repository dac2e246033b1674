"""Spark jobs for seismic-hazard data: catalogs, completeness, declustering, rates, hazard curves."""
