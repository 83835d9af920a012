"""The best rows per query and project, scored block by block where they lie."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType, StructType

#: Numbers of one dense block of rows by columns (16 MB), and candidates held before all but the best are dropped.
BLOCK, HELD = 2_000_000, 200_000


def ranked(scored: DataFrame, k: int, digits: int) -> DataFrame:
    """(query_id, project_id, chunk_id, score, rank): the k best. Ranking by the rounded score keeps equal sums equal, whatever the order of addition."""
    order = Window.partitionBy("query_id", "project_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("score", F.round("score", digits)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _rounded(scores: pd.Series, digits: int) -> pd.Series:
    """Rounded as F.round does it: half up, from the decimal form."""
    unit = Decimal(1).scaleb(-digits)
    known = {x: float(Decimal(repr(x)).quantize(unit, ROUND_HALF_UP)) for x in scores.unique().tolist()}
    return scores.map(known)


def best_rows(table: DataFrame, rows: Callable[[pa.RecordBatch, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]], asks: np.ndarray, queries: list[tuple], projects: list, query_type: DataType, k: int, digits: int) -> DataFrame:
    """(query_id, project_id, chunk_id, score, rank): the k rows of table (project_id, chunk_id, ...) of greatest sum of value * asks, per query and project.

    rows gives the (row, column, value) of a batch, of which each row has its
    place in projects or -1. asks is columns x queries; queries are (query_id,
    project_id), None where all projects are meant. A row that shares no column
    with a query is none of its hits. Each task drops what k others of its own
    beat for certain, so what it passes on does not grow with the table.
    """
    ids = table.select("project_id", "chunk_id").schema
    schema = StructType().add("query_id", query_type).add(ids["project_id"]).add(ids["chunk_id"]).add("score", "double")
    meant = np.array([[p is None or p == own for own in projects] for _, p in queries], dtype=bool).reshape(len(queries), len(projects)).T
    touches = (asks != 0).astype(np.float32)
    places = {p: i for i, p in enumerate(projects)}
    names = ["project", "query", "chunk_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # What is certain to be under the k best known scores is under them after rounding too.
        floor, slack = np.full(meant.shape, -np.inf), 2 * 10.0**-digits
        held: list[pd.DataFrame] = []

        def settle() -> pd.DataFrame:
            found = pd.concat(held) if held else pd.DataFrame(columns=names)
            found = found.assign(rounded=_rounded(found["score"], digits)).sort_values(["project", "query", "rounded", "chunk_id"], ascending=[True, True, False, True])
            found = found.groupby(["project", "query"]).head(k)
            last = found[found.groupby(["project", "query"]).cumcount() == k - 1]
            floor[last["project"].to_numpy(int), last["query"].to_numpy(int)] = last["rounded"].to_numpy(float)
            held[:] = [found[names]]
            return held[0]

        size, waiting = max(1, BLOCK // max(1, asks.shape[0])), 0
        for whole in batches:
            for at in range(0, whole.num_rows, size):
                batch = whole.slice(at, size)
                owners = np.array([places.get(p, -1) for p in batch.column("project_id").to_pylist()], dtype=np.int64)
                row, column, value = rows(batch, owners)
                dense, marks = np.zeros((batch.num_rows, asks.shape[0])), np.zeros((batch.num_rows, asks.shape[0]), np.float32)
                dense[row, column], marks[row, column] = value, 1
                scores = dense @ asks
                hit = (marks @ touches > 0) & meant[owners] & (owners >= 0)[:, None] & (scores >= floor[owners] - slack)
                r, q = np.nonzero(hit)
                if len(r):
                    held.append(pd.DataFrame({"project": owners[r], "query": q, "chunk_id": batch.column("chunk_id").take(pa.array(r)).to_pandas().to_numpy(), "score": scores[r, q]}))
                    waiting += len(r)
                if waiting > HELD:
                    settle()
                    waiting = 0
        out = settle()
        if len(out):
            query, project = out["query"].tolist(), out["project"].tolist()
            yield pa.RecordBatch.from_pydict({"query_id": [queries[i][0] for i in query], "project_id": [projects[i] for i in project], "chunk_id": out["chunk_id"].tolist(), "score": out["score"].tolist()}, schema=arrow)

    arrow = to_arrow_schema(schema)
    return ranked(table.mapInArrow(run, schema), k, digits)
