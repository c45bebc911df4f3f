"""Catalogs: relations that can be pruned by their file table and split into files."""

from splitfold.sources.base import CatalogTable
from splitfold.sources.delta_log import DeltaCatalog
from splitfold.sources.registry import named, register
from splitfold.sources.static import CatalogFile, StaticCatalog
from splitfold.sources.virtual import VirtualCatalog

__all__ = ["CatalogFile", "CatalogTable", "DeltaCatalog", "StaticCatalog", "VirtualCatalog", "named", "register"]
