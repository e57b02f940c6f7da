"""SQL table functions over a table argument that is partitioned by query: one call answers all queries.

Each takes rows of scored candidates, `TABLE(...) PARTITION BY query_id ORDER BY ...`, and keeps no more than the best of
one query at a time. They hold no data and read no views, so any number of callers share them in a session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

#: The most rows that each function gives for a query.
MOST = {"match_chunks": 20, "semantic_search": 200, "lexical_search": 200, "hybrid_search": 100}


def _best(top: int, least_given: bool):
    """A class that numbers the rows (query_id, id, score) of a query, best first; rows below a floor end it."""

    class Best:
        def __init__(self) -> None:
            self.place = 0

        def eval(self, row, most: int = 5, floor: float = float("-inf")):
            if row["score"] is None or (least_given and row["score"] < floor) or self.place >= min(max(most, 1), top):
                return
            self.place += 1
            yield row["query_id"], row["id"], row["score"], self.place

    return Best


class Fused:
    """Both branches of a query (query_id, branch, id, score, place) by reciprocal ranks; a branch that lacks an id adds nothing."""

    def __init__(self) -> None:
        self.query, self.found, self.most, self.k = None, {}, 20, 60

    def eval(self, row, most: int = 20, k: int = 60):
        self.query, self.most, self.k = row["query_id"], min(max(most, 1), MOST["hybrid_search"]), max(k, 1)
        self.found.setdefault(row["id"], {})[row["branch"]] = (row["place"], row["score"])

    def terminate(self):
        rows = []
        for i, of in self.found.items():
            score = round(sum(1 / (self.k + place) for place, _ in (of[b] for b in ("lexical", "semantic") if b in of)), 6)
            similarity = of["semantic"][1] if "semantic" in of else None
            rows.append((-score, similarity is None, -(similarity or 0.0), i, of.get("lexical", (None,))[0], of.get("semantic", (None,))[0]))
        for n, (score, _, _, i, lexical, semantic) in enumerate(sorted(rows)[: self.most]):
            yield self.query, i, lexical, semantic, -score, n + 1


def register_functions(spark: SparkSession) -> None:
    """match_chunks(t, most, floor), semantic_search(t, most), lexical_search(t, most), hybrid_search(t, most, k)."""
    shape = "query_id: bigint, id: bigint, score: double, place: bigint"
    for name in ("match_chunks", "semantic_search", "lexical_search"):
        spark.udtf.register(name, udtf(_best(MOST[name], name == "match_chunks"), returnType=shape))
    spark.udtf.register("hybrid_search", udtf(Fused, returnType="query_id: bigint, id: bigint, lexical_place: bigint, semantic_place: bigint, score: double, place: bigint"))


def called(spark: SparkSession, name: str, rows: DataFrame, order: str, *arguments) -> DataFrame:
    """A function over rows, partitioned by query_id and ordered within a query."""
    told = "".join(f", {a!r}D" if isinstance(a, float) else f", {a!r}" for a in arguments)
    return spark.sql(f"SELECT * FROM {name}(TABLE(SELECT * FROM {{rows}}) PARTITION BY query_id ORDER BY ({order}){told})", rows=rows)
