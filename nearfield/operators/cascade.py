"""Coarse-to-fine search: each level keeps a fraction of what the level before it kept, for each query by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.operators import search as S
from nearfield.plans.index import VectorIndex

# Level order and the fraction each level keeps.
KEEP = {"f8": 0.01, "f16": 0.1, "f32": 1.0, "f64": 1.0}


class Cascade:
    """Indexes by level, searched in order. Unknown level names are ignored; without any known one it is an error."""

    def __init__(self, indexes: dict[str, VectorIndex], disable_ann: bool = False):
        self.indexes = {level: indexes[level] for level in KEEP if level in indexes}
        if not self.indexes:
            raise ValueError("no known level among the indexes")
        self.use_ann = not disable_ann

    def search(self, query, path: list[str] | None = None, top_k: int = 10) -> DataFrame:
        """(qid, rnk, vec_id, score) of the last level, at most top_k; often fewer, as the fractions multiply."""
        path = list(path or self.indexes)
        if missing := [level for level in path if level not in self.indexes]:
            raise ValueError(f"levels without an index: {missing}")
        found, kept = None, 0
        for level in path:
            index = self.indexes[level]
            kept = max(1, int((kept if found is not None else index.rows()) * KEEP[level]))
            if found is None:
                found = index.search(query, kept, use_ann=self.use_ann)
                kept = min(kept, index.rows())
            else:
                found = S.topk_candidates(index.vectors, found.select("qid", "vec_id"), index.unit_query(query, strict=False), kept)
        return found.where(F.col("rnk") <= top_k)

    def get_vector(self, level: str, vec_id: int) -> list[float]:
        return self.indexes[level].get_vector(vec_id)

    def dims(self) -> dict[str, int]:
        """By level."""
        return {level: index.dims() for level, index in self.indexes.items()}

    def rows(self) -> dict[str, int]:
        """By level."""
        return {level: index.rows() for level, index in self.indexes.items()}

    def __repr__(self) -> str:
        return f"Cascade(levels={', '.join(self.indexes)}, ann={self.use_ann})"
