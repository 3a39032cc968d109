"""Dense fits as grouped steps: one group is one small grid, fitted on one worker.

Cells arrive as rows (keys, gx, gy, v); a grid has a fixed number of cells, so a group is small,
and sessions, frames and candidate centres are as many independent tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import solvers as S


def grid_of(pdf: pd.DataFrame, value: str, gw: int, gh: int) -> np.ndarray:
    out = np.full((gh, gw), np.nan)
    out[pdf.gy.to_numpy(), pdf.gx.to_numpy()] = pdf[value].to_numpy(dtype=float)
    return out


def _rows(keys: dict, **grids: np.ndarray) -> pd.DataFrame:
    shape = next(iter(grids.values())).shape
    gy, gx = (a.ravel() for a in np.mgrid[: shape[0], : shape[1]])
    return pd.DataFrame({**{k: np.repeat(v, gx.size) for k, v in keys.items()}, "gx": gx, "gy": gy, **{n: g.ravel() for n, g in grids.items()}})


def _schema(cells: DataFrame, by: list[str], *names: str) -> str:
    kinds = dict(cells.dtypes)
    return ", ".join([*(f"{k} {kinds[k]}" for k in by), "gx int, gy int", *(f"{n} double" for n in names)])


def smooth_models(cells: DataFrame, by: list[str], gw: int, gh: int, block: int, value: str = "v") -> DataFrame:
    """Cubic and radial model of each group's grid about its middle: fitted, resid of every cell."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        seen = grid_of(pdf, value, gw, gh)
        model = S.fit_smooth(seen, block, gw * block / 2, gh * block / 2, 2.0 * block)
        fitted = model.at(*S.centres(gw, gh, block))
        return _rows({k: pdf[k].iloc[0] for k in by}, fitted=fitted, resid=seen - fitted)

    return cells.groupBy(*by).applyInPandas(run, _schema(cells, by, "fitted", "resid"))


def surfaces(cells: DataFrame, by: list[str], gw: int, gh: int, block: int, step_cells: int, stiffness: float, value: str = "v") -> DataFrame:
    """Bilinear surface of each group's grid: fitted at every cell."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        seen = grid_of(pdf, value, gw, gh)
        surface, _ = S.fit_surface(seen, np.isfinite(seen), block, step_cells, stiffness, symmetric=True)
        return _rows({k: pdf[k].iloc[0] for k in by}, fitted=surface.at(*S.centres(gw, gh, block)))

    return cells.groupBy(*by).applyInPandas(run, _schema(cells, by, "fitted"))


def foreground_masks(cells: DataFrame, gw: int, gh: int, block: int, value: str = "v") -> DataFrame:
    """Foreground cells of each frame."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mask = S.foreground(grid_of(pdf, value, gw, gh), block)
        return _rows({"frame_idx": pdf.frame_idx.iloc[0]}, masked=mask.astype(float))

    out = cells.groupBy("frame_idx").applyInPandas(run, _schema(cells, ["frame_idx"], "masked"))
    return out.withColumn("masked", F.col("masked") > 0)


ANOMALY = "gain double, dome double, pedestal double, spread double, level_ratio double"


def frame_anomalies(cells: DataFrame, session: np.ndarray, model: S.Glare, mode: str = "full", value: str = "v") -> DataFrame:
    """Facts of each frame's anomaly against the session's map and model (both a few kilobytes, sent with the function)."""
    gh, gw = session.shape
    kind = dict(cells.dtypes)["frame_idx"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        seen = grid_of(pdf, value, gw, gh)
        sky = np.isfinite(seen) & np.isfinite(session)
        a = S.fit_anomaly(np.where(sky, seen, 0.0), np.where(sky, session, 0.0), sky, model, mode)
        return pd.DataFrame({"frame_idx": [pdf.frame_idx.iloc[0]], "gain": [a.gain], "dome": [a.dome], "pedestal": [a.pedestal], "spread": [a.range], "level_ratio": [a.level_ratio]})

    return cells.groupBy("frame_idx").applyInPandas(run, f"frame_idx {kind}, {ANOMALY}")


def packed_anomalies(cells: DataFrame, sessions: list[np.ndarray], model: list[S.Glare], mode: str = "full") -> DataFrame:
    """(frame_idx, anomaly): each frame's anomaly of all three channels (columns r, g, b of the cells) as one array, for ``images.clean``."""
    gh, gw = sessions[0].shape
    kind = dict(cells.dtypes)["frame_idx"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        for name, session, m in zip("rgb", sessions, model, strict=True):
            seen = grid_of(pdf, name, gw, gh)
            sky = np.isfinite(seen) & np.isfinite(session)
            found.append(S.fit_anomaly(np.where(sky, seen, 0.0), np.where(sky, session, 0.0), sky, m, mode).packed())
        return pd.DataFrame({"frame_idx": [pdf.frame_idx.iloc[0]], "anomaly": [np.concatenate(found)]})

    return cells.groupBy("frame_idx").applyInPandas(run, f"frame_idx {kind}, anomaly array<double>")


def centre_search(spark, values: np.ndarray, block: int, exclude: np.ndarray | None = None, levels: int = 4) -> tuple[float, float]:
    """The optical centre, its candidates scored in parallel, one grid of candidates after the other."""

    def scores(candidates: np.ndarray) -> np.ndarray:
        rows = [(k, float(x), float(y)) for k, (x, y) in enumerate(candidates)]
        df = spark.createDataFrame(rows, "k int, x double, y double").repartition(min(len(rows), spark.sparkContext.defaultParallelism))

        def run(batches):
            for pdf in batches:
                yield pdf.assign(s=[S.fit_smooth(values, block, x, y, 2.0 * block, exclude).spread for x, y in zip(pdf.x, pdf.y, strict=True)])[["k", "s"]]

        found = df.mapInPandas(run, "k int, s double").collect()  # a number per candidate
        return np.array([r.s for r in sorted(found, key=lambda r: r.k)])

    return S.find_centre(values, block, exclude, levels, scores)
