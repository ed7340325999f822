"""The one-line interface: build or reuse an index from memory or a file, and ask it for neighbours."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from nearfield.functions import vectors as V
from nearfield.plans.index import VectorIndex, build_index
from nearfield.sources import files

# The lengths that the interface takes, and the only similarity.
MIN_DIMS, MAX_DIMS = 8, 4096
SIMILARITY = "cosine"
READERS = {".npy": files.read_npy, ".csv": files.read_csv}


def _frame(spark: SparkSession, embeddings) -> DataFrame:
    """Vectors as rows. Files are read by the executors."""
    if isinstance(embeddings, DataFrame):
        return embeddings
    if isinstance(embeddings, str):
        reader = next((r for end, r in READERS.items() if embeddings.endswith(end)), None)
        if reader is None:
            raise ValueError(f"a path must end in {' or '.join(READERS)}")
        return reader(spark, embeddings)
    if not isinstance(embeddings, list | np.ndarray):
        raise TypeError("embeddings must be a list, an array, a frame or a path")
    matrix = np.asarray(embeddings, dtype=np.float32)
    if matrix.ndim != 2 or not matrix.size:
        raise ValueError("embeddings must have two dimensions and at least one row")
    return files.from_matrix(spark, matrix)


class VectorSearch:
    """Scores are dot products of the unit query with the rows as stored: cosines only if the rows have unit length or normalize_rows is set."""

    def __init__(self, index: VectorIndex, level: str):
        self.index, self.level = index, level

    @classmethod
    def from_embeddings(cls, embeddings, level: str = "f32", similarity: str = SIMILARITY, use_ann: bool = True, base_name: str = "default", base_dir: str | None = None, normalize_rows: bool = False, spark: SparkSession | None = None) -> VectorSearch:
        """embeddings: list of lists, 2-D array, frame (vec_id, embedding), or the path of a .npy or .csv file. An index under base_dir/base_name/level is reused only if it holds the same data.

        base_dir: a folder that the executors see; nearfield_indexes in the session's warehouse if not given."""
        if similarity != SIMILARITY:
            raise ValueError(f"similarity must be {SIMILARITY!r}")
        V.check_level(level)
        spark = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        base_dir = base_dir or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/nearfield_indexes"
        index = build_index(_frame(spark, embeddings), f"{base_dir}/{base_name}/{level}", level, use_ann, normalize_rows, reuse=True, least_dims=MIN_DIMS, most_dims=MAX_DIMS)
        return cls(index, level)

    def query(self, query_vector, top_k: int = 5, method: str = "simd") -> list[dict]:
        """[{"idx": row, "score": dot}], best first. The caller's array is left as it is."""
        if not isinstance(query_vector, list | np.ndarray):
            raise TypeError("the query must be a list or an array")
        q = np.asarray(query_vector, dtype=np.float32)
        if q.ndim != 1:
            raise ValueError("the query must have one dimension")
        found = self.index.search(V.normalize_query(q, "facade"), top_k, method=method)
        return [{"idx": r.vec_id, "score": r.score} for r in found.orderBy("rnk").collect()]  # top_k rows
