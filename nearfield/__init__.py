"""nearfield: top-k similarity search over dense float vectors, as ordinary Spark plans."""

from nearfield import logs
from nearfield.api import VectorSearch
from nearfield.plans.index import VectorIndex, build_index, open_index

__all__ = ["VectorIndex", "VectorSearch", "build_index", "open_index"]

logs.setup()
