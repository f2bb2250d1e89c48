"""statloom: a Spark-native engine for statistical files and large text corpora."""

from .api import StatReader, batches, foreach_batch, metadata_json, read, scan, schema, write, write_parts, write_por, write_sas_bundle, write_xpt
from .options import Compress, InformativeNulls, PreserveOrder
from .sources.sas7bcat import read_sas7bcat

__version__ = "0.1.0"
__all__ = ["Compress", "InformativeNulls", "PreserveOrder", "StatReader", "batches", "foreach_batch", "metadata_json", "read", "read_sas7bcat", "scan", "schema", "write", "write_parts", "write_por", "write_sas_bundle", "write_xpt"]
