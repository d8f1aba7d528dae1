"""Whole-tensor metrics and frame conversion; numpy works on Arrow batches inside tasks.

One tensor is one row.  Spark joins and groups the rows; the functions here only reduce the
values of a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.functions.scalars import (
    CHROMA_CENTRE, CHROMA_RANGE, CODE_MAX, LUMA_MIN, LUMA_RANGE,
)
from fleetgauge.sources.files import open_store

COMPARE = "elements long, finite boolean, exact boolean, mae double, rmse double, p99_abs double, max_abs double, psnr_db double"
DRIFT = "max_abs double, mean_abs double, rmse double, relative_l2 double, psnr_db double"


def _rows(schema: str, one: Callable[..., tuple]) -> Callable:
    names = [part.split()[0] for part in schema.split(", ")]

    @F.pandas_udf(schema)
    def reduce(*columns: pd.Series) -> pd.DataFrame:
        found = [one(*[np.asarray([] if v is None else v, dtype=np.float32) for v in row]) for row in zip(*columns)]
        return pd.DataFrame(found, columns=names).astype({n: "object" for n in names})

    return reduce


def _compare(reference: np.ndarray, candidate: np.ndarray) -> tuple:
    count = int(reference.size)
    finite = bool(np.isfinite(reference).all() and np.isfinite(candidate).all())
    if not finite or reference.size != candidate.size or not count:
        return (count, finite, False, None, None, None, None, None)
    # The difference is taken in single precision, sums in double precision.
    error = np.abs(reference - candidate)
    mse = float(np.mean(np.square(error, dtype=np.float64)))
    psnr = None if mse == 0 else 10 * float(np.log10(1.0 / mse))
    return (count, True, mse == 0, float(np.mean(error, dtype=np.float64)), mse**0.5,
            float(np.percentile(error, 99)), float(error.max()), psnr)


def _drift(reference: np.ndarray, candidate: np.ndarray) -> tuple:
    if reference.size != candidate.size or not reference.size:
        return (None, None, None, None, None)
    delta = (candidate - reference).astype(np.float64)
    size = float(np.sqrt(np.sum(np.square(reference, dtype=np.float64))))
    gone = float(np.sqrt(np.sum(np.square(delta))))
    rmse = float(np.sqrt(np.mean(np.square(delta))))
    psnr = 200.0 if rmse == 0 else 20.0 * float(np.log10(1.0 / rmse))
    return (float(np.abs(delta).max()), float(np.abs(delta).mean()), rmse, gone / size if size else gone, psnr)


def tensor_compare(reference: Column, candidate: Column) -> Column:
    """Struct of error metrics of two float32 arrays (peak 1.0); null where sizes differ or are zero."""
    return _rows(COMPARE, _compare)(reference, candidate)


def _load(path: str) -> np.ndarray:
    store, name, _ = open_store(path)
    with store.open_input_stream(name) as stream:
        content = stream.read()
    if len(content) % 4:
        raise ValueError(f"{path} is not a float32 file")
    return np.frombuffer(content, dtype="<f4")


def _range(values: np.ndarray) -> tuple:
    if not values.size or not np.isfinite(values).all():
        return (None, None, None)
    return (float(values.min()), float(values.max()), float(np.mean((values < 0) | (values > 1))))


FILE_FACTS = (f"{COMPARE}, sizes_differ boolean, reference_min double, reference_max double, reference_outside double, "
              "candidate_min double, candidate_max double, candidate_outside double, read_error string")


def compare_tensor_files(reference: Column, candidate: Column, equal: Column) -> Column:
    """Struct of error metrics and range facts of two float32 files, loaded by path inside the task.

    Only paths reach Python, and two tensors are held at a time.  Files known to be ``equal`` by
    their hashes are loaded once.  A null path gives null facts, a file that cannot be read a
    ``read_error``.
    """
    names = [part.split()[0] for part in FILE_FACTS.split(", ")]

    def one(left: str | None, right: str | None, same: bool | None) -> tuple:
        if left is None or right is None:
            return (None,) * len(names)
        try:
            a = _load(left)
            b = a if same else _load(right)
        except (OSError, ValueError) as error:
            return (*(None,) * (len(names) - 1), str(error))
        return (*_compare(a, b), a.size != b.size, *_range(a), *_range(b), None)

    @F.pandas_udf(FILE_FACTS)
    def facts(left: pd.Series, right: pd.Series, same: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(*row) for row in zip(left, right, same)], columns=names).astype({n: "object" for n in names})

    return facts(reference, candidate, equal)


def tensor_summary(values: Column) -> Column:
    """Struct of range facts of one float32 array, in the JVM; an empty array has a count only."""
    infinite = float("inf")
    finite = F.coalesce(F.forall(values, lambda x: ~F.isnan(x) & (F.abs(x) < infinite)), F.lit(False))
    count = F.size(values).cast("long")
    usable = finite & (count > 0)
    part = lambda bad: F.when(usable, F.size(F.filter(values, bad)) / count)
    return F.struct(
        count.alias("elements"), finite.alias("finite"), F.when(usable, F.array_min(values).cast("double")).alias("min"),
        F.when(usable, F.array_max(values).cast("double")).alias("max"), part(lambda x: x < 0.0).alias("below_zero_fraction"),
        part(lambda x: x > 1.0).alias("above_one_fraction"), part(lambda x: (x < 0.0) | (x > 1.0)).alias("outside_unit_interval_fraction"))


def output_drift(reference: Column, candidate: Column) -> Column:
    """Struct of drift metrics; an exact match has 200 dB, arrays of different or zero size have none."""
    return _rows(DRIFT, _drift)(reference, candidate)


def set_digest(artifacts: DataFrame, keys: Sequence[str], stage: str = "stage", index: str = "frame_index",
               sha: str = "sha256") -> DataFrame:
    """SHA-256 over the sorted ``stage TAB index TAB sha LF`` lines of each capture.

    Partitions are sorted by Spark (spilling where needed) and hashed as they stream by, so a
    capture of any length takes constant memory.
    """
    key = "_key"
    data = artifacts.select(
        F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias(key), F.struct(*keys).alias("_keys"),
        F.col(stage).cast("string").alias("_stage"), F.col(index).cast("long").alias("_index"), F.col(sha).cast("string").alias("_sha"),
    )
    lines = data.repartition(key).sortWithinPartitions(key, "_stage", "_index", "_sha").select(
        key, F.concat_ws("\t", "_stage", F.col("_index").cast("string"), "_sha").alias("line"))

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, lines_seen = None, None, 0
        for batch in batches:
            done = []
            # Sorted input: groupby with sort=False keeps the runs of equal keys in order.
            for name, run in batch.groupby(key, sort=False)["line"]:
                if name != current:
                    if current is not None:
                        done.append((current, state.hexdigest(), lines_seen))
                    current, state, lines_seen = name, hashlib.sha256(), 0
                state.update(("\n".join(run) + "\n").encode())
                lines_seen += len(run)
            if done:
                yield pd.DataFrame(done, columns=[key, "digest", "artifacts"])
        if current is not None:
            yield pd.DataFrame([(current, state.hexdigest(), lines_seen)], columns=[key, "digest", "artifacts"])

    hashed = lines.mapInPandas(digest, f"{key} string, digest string, artifacts long")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in artifacts.select(*keys).schema)
    return hashed.select(F.from_json(key, types).alias("_k"), "digest", "artifacts").select("_k.*", "digest", "artifacts")


# --- frames -----------------------------------------------------------------------------

# Luma weights (red, blue) of the colour families.
LUMA_WEIGHTS = {"bt601": (0.299, 0.114), "bt709": (0.2126, 0.0722), "bt2020": (0.2627, 0.0593)}


def _codes(values: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(values), 0, 255)


def nv12_to_rgb(frame: np.ndarray, height: int, width: int, family: str, limited: bool) -> np.ndarray:
    """8-bit NV12 codes (luma plane, interleaved chroma) as planar RGB float32 in 0..1."""
    y = frame[: height * width].reshape(height, width).astype(np.float64)
    uv = frame[height * width :].reshape(height // 2, width // 2, 2).astype(np.float64)
    if limited:
        k = CODE_MAX / CHROMA_RANGE
        y = _codes((y - LUMA_MIN) * CODE_MAX / LUMA_RANGE)
        uv = _codes(uv * k + CHROMA_CENTRE * (1.0 - k))
    chroma = uv.repeat(2, axis=0).repeat(2, axis=1) - CHROMA_CENTRE
    kr, kb = LUMA_WEIGHTS[family]
    u, v = chroma[..., 0], chroma[..., 1]
    red, blue = y + 2 * (1 - kr) * v, y + 2 * (1 - kb) * u
    green = (y - kr * red - kb * blue) / (1 - kr - kb)
    return (_codes(np.stack([red, green, blue])) / 255.0).astype(np.float32).ravel()


def rgb_to_nv12(planes: np.ndarray, height: int, width: int, family: str, limited: bool) -> np.ndarray:
    """Planar RGB float32 as 8-bit NV12 codes; chroma is the mean of each 2x2 block."""
    red, green, blue = _codes(planes.reshape(3, height, width).astype(np.float64) * 255.0)
    kr, kb = LUMA_WEIGHTS[family]
    y = kr * red + (1 - kr - kb) * green + kb * blue
    u, v = (blue - y) / (2 * (1 - kb)), (red - y) / (2 * (1 - kr))
    small = lambda p: p.reshape(height // 2, 2, width // 2, 2).mean(axis=(1, 3))
    uv = _codes(np.stack([small(u), small(v)], axis=-1) + CHROMA_CENTRE)
    y = _codes(y)
    if limited:
        k = CHROMA_RANGE / CODE_MAX
        y = _codes(y * LUMA_RANGE / CODE_MAX + LUMA_MIN)
        uv = _codes(uv * k + CHROMA_CENTRE * (1.0 - k))
    return np.concatenate([y.ravel(), uv.ravel()]).astype(np.int32)


def _map_values(df: DataFrame, column: str, out: str, kind: str, fn: Callable[[np.ndarray, pd.Series], np.ndarray],
                needs: Sequence[str]) -> DataFrame:
    rest = [n for n in df.columns if n != column]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*rest).schema)

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            facts = batch[list(needs)].to_dict("records") if needs else [{}] * len(batch)
            made = [fn(np.asarray(v), fact) for v, fact in zip(batch[column], facts)]
            yield batch[rest].assign(**{out: made})

    return df.mapInPandas(convert, f"{schema}, `{out}` array<{kind}>")


def preprocess_frames(df: DataFrame, column: str, out: str = "rgb") -> DataFrame:
    """NV12 frames to model input.  Columns: height, width, family, limited, and the codes."""
    return _map_values(df, column, out, "float", lambda v, r: nv12_to_rgb(v, r["height"], r["width"], r["family"], r["limited"]),
                       ("height", "width", "family", "limited"))


def postprocess_frames(df: DataFrame, column: str, out: str = "nv12") -> DataFrame:
    """Model output to NV12 frames, the reverse of ``preprocess_frames``."""
    return _map_values(df, column, out, "int", lambda v, r: rgb_to_nv12(v, r["height"], r["width"], r["family"], r["limited"]),
                       ("height", "width", "family", "limited"))


def score_frames(df: DataFrame, model: Callable[[np.ndarray], np.ndarray], height: int, width: int, scale: int,
                 column: str = "values", out: str = "output") -> DataFrame:
    """Apply a per-frame model [1, 3, H, W] -> [1, 3, sH, sW] with values in 0..1.

    The contract is checked on every result; a model that breaks it fails the job.
    """
    if min(height, width, scale) <= 0:
        raise ValueError("shapes must be static and positive")
    expected = (1, 3, height * scale, width * scale)

    def run(values: np.ndarray, _: dict) -> np.ndarray:
        result = np.asarray(model(values.astype(np.float32).reshape(1, 3, height, width)), dtype=np.float32)
        if result.shape != expected:
            raise ValueError(f"model returned {result.shape}, the contract says {expected}")
        return np.clip(result, 0.0, 1.0).ravel()

    return _map_values(df, column, out, "float", run, ())


def _ssim_plane(a: np.ndarray, b: np.ndarray) -> float:
    """Mean structural similarity of 8x8 windows at every fourth pixel (8-bit peak)."""
    height, width = (a.shape[0] // 4) * 4, (a.shape[1] // 4) * 4
    if height < 8 or width < 8:
        raise ValueError("a plane must be at least 8 x 8")
    blocks = lambda p: p[:height, :width].reshape(height // 4, 4, width // 4, 4).sum(axis=(1, 3))
    window = lambda p: p[:-1, :-1] + p[1:, :-1] + p[:-1, 1:] + p[1:, 1:]
    a, b = a.astype(np.float64), b.astype(np.float64)
    s1, s2 = window(blocks(a)), window(blocks(b))
    ss, s12 = window(blocks(a * a + b * b)), window(blocks(a * b))
    c1, c2 = np.floor(0.01**2 * 255**2 * 64 + 0.5), np.floor(0.03**2 * 255**2 * 64 * 63 + 0.5)
    variance, covariance = ss * 64 - s1 * s1 - s2 * s2, s12 * 64 - s1 * s2
    return float(np.mean((2 * s1 * s2 + c1) * (2 * covariance + c2) / ((s1 * s1 + s2 * s2 + c1) * (variance + c2))))


def frame_quality(pairs: DataFrame, reference: str, candidate: str) -> DataFrame:
    """PSNR and SSIM of decoded frame pairs; columns height, width and two code arrays.

    The array holds whole planes: luma of height x width, then chroma planes of a quarter size.
    """
    rest = [n for n in pairs.columns if n not in (reference, candidate)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.select(*rest).schema)

    def planes(values: np.ndarray, height: int, width: int) -> list[np.ndarray]:
        out, at, shape = [], 0, (height, width)
        while at < values.size:
            out.append(values[at : at + shape[0] * shape[1]].reshape(shape))
            at += shape[0] * shape[1]
            shape = (height // 2, width // 2)
        return out

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for ref, cand, height, width in zip(batch[reference], batch[candidate], batch["height"], batch["width"]):
                a, b = np.asarray(ref, dtype=np.float64), np.asarray(cand, dtype=np.float64)
                mse = float(np.mean(np.square(a - b)))
                parts = [(_ssim_plane(p, q), p.size) for p, q in zip(planes(a, height, width), planes(b, height, width))]
                ssim = sum(s * n for s, n in parts) / sum(n for _, n in parts)
                rows.append((mse == 0, None if mse == 0 else 10 * float(np.log10(255.0**2 / mse)), ssim))
            found = pd.DataFrame(rows, columns=["exact", "psnr_db", "ssim"], index=batch.index)
            yield pd.concat([batch[rest], found.astype({"psnr_db": "float64"})], axis=1)

    return pairs.mapInPandas(score, f"{schema}, exact boolean, psnr_db double, ssim double")
