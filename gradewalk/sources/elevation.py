"""Heights of points: a constant, or a service that is asked once a distinct point, through a Parquet cache."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from functools import partial
from urllib.error import HTTPError
from urllib.parse import urlencode
from urllib.request import urlopen

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradewalk.storage import shared_path, stored

EPQS, OPEN_METEO = "https://epqs.nationalmap.gov/v1/json", "https://api.open-meteo.com/v1/elevation"


def point_key(lat: Column, lon: Column) -> Column:
    return F.format_string("%.7f,%.7f", lat, lon)


def flat(points: DataFrame, z_m: float = 0.0) -> DataFrame:
    return points.withColumn("z_m", F.lit(float(z_m)))


def parse_point_answer(payload: Column) -> Column:
    """Height in a point service's answer: ``value``, or the older nested form; anything else fails."""
    old = "$.USGS_Elevation_Point_Query_Service.Elevation_Query.Elevation"
    z = F.coalesce(*(F.get_json_object(payload, p).try_cast("double") for p in ("$.value", old, "$.Elevation_Query.Elevation")))
    return F.coalesce(z, F.raise_error(F.lit("no height in the answer")).cast("double"))


def parse_batch_answer(payload: Column) -> Column:
    """Heights in a batch service's answer: a number, a list, or a list of objects; anything else fails."""
    inner = F.get_json_object(payload, "$.elevation")
    texts = F.coalesce(F.from_json(inner, "array<string>"), F.when(inner.isNotNull(), F.array(inner)), F.transform(F.from_json(payload, "array<struct<elevation:string>>"), lambda x: x["elevation"]))
    heights = F.transform(texts, lambda t: t.try_cast("double"))
    bad = heights.isNull() | F.exists(heights, lambda h: h.isNull())
    return F.when(bad, F.raise_error(F.lit("no heights in the answer")).cast("array<double>")).otherwise(heights)


def ask_point_service(keys: list[str], retries: int = 2, timeout_s: float = 15) -> list[float]:
    out = []
    for key in keys:
        lat, lon = key.split(",")
        url = f"{EPQS}?{urlencode({'x': lon, 'y': lat, 'units': 'Meters', 'wkid': 4326})}"
        for attempt in range(retries + 1):
            try:
                with urlopen(url, timeout=timeout_s) as answer:
                    got = json.loads(answer.read())
                old = got.get("USGS_Elevation_Point_Query_Service", got).get("Elevation_Query", {})
                out.append(float(got.get("value", old.get("Elevation"))))
                break
            except OSError:
                if attempt == retries:
                    raise
                time.sleep(0.5 * (attempt + 1))
    return out


def ask_batch_service(keys: list[str], batch: int = 25, retries: int = 4, timeout_s: float = 30, pause_s: float = 0.25) -> list[float]:
    out: list[float] = []
    for at in range(0, len(keys), batch):
        lats, lons = zip(*(k.split(",") for k in keys[at : at + batch]), strict=True)
        url = f"{OPEN_METEO}?{urlencode({'latitude': ','.join(lats), 'longitude': ','.join(lons)})}"
        for attempt in range(retries + 1):
            try:
                with urlopen(url, timeout=timeout_s) as answer:
                    got = json.loads(answer.read())["elevation"]
                if len(got) != len(lats):
                    raise ValueError("the answer has another number of heights")
                out += map(float, got)
                break
            except HTTPError as e:
                if e.code != 429 or attempt == retries:
                    raise
                time.sleep(float(e.headers.get("Retry-After") or attempt + 1))
            except OSError:
                if attempt == retries:
                    raise
                time.sleep(attempt + 1)
        time.sleep(pause_s)
    return out


#: How a provider is asked, keys a request, and requests a second that all tasks share (None: no bound).
PROVIDERS: dict[str, tuple[Callable[[list[str]], list[float]], int, float | None]] = {"usgs": (ask_point_service, 1, None), "open-meteo": (partial(ask_batch_service, pause_s=0.0), 25, 4.0)}


def provided(points: DataFrame, provider: str, cache_path: str | None = None, z_m: float = 0.0) -> DataFrame:
    """``points`` with the heights of a provider by name; ``flat`` gives all the same one."""
    if provider == "flat":
        return flat(points, z_m)
    if provider not in PROVIDERS:
        raise ValueError(f"no provider of heights is named {provider}")
    ask, batch, rate = PROVIDERS[provider]
    return heights(points, ask, cache_path=cache_path, batch=batch, rate=rate)


def cached(points: DataFrame, path: str) -> DataFrame | None:
    """The heights kept at a path, or None where there are none yet."""
    try:
        return points.sparkSession.read.schema("key string, z_m double").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def answers_folder(path: str) -> tuple[fs.FileSystem, str]:
    """A folder that tasks write to, by its path or URI."""
    uri = "file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path
    return fs.FileSystem.from_uri(uri)


def asking(ask: Callable[[list[str]], list[float]], folder: str, tasks: int, batch: int, rate: float | None) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """What a task does with its keys: asks for those that have no answer yet, a batch at a time, and keeps each answer at once.

    An answer is a file of its slot in ``folder``, so a task that runs again, here or elsewhere, reads what was answered
    before and asks for the rest alone.  Of ``rate`` requests a second each of ``tasks`` tasks takes its share, at times of its own.
    """
    def keep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = answers_folder(folder)
        period = tasks / rate if rate else 0.0
        context = TaskContext.get()
        # an attempt that failed may have asked just now
        due = time.monotonic() + period * (context.partitionId() / tasks + (context.attemptNumber() > 0))
        there: dict[int, set[str]] = {}
        for frame in frames:
            for slot, rows in frame.groupby("slot"):
                home = f"{root}/slot-{slot}"
                if slot not in there:
                    found = files.get_file_info(fs.FileSelector(home, allow_not_found=True))
                    there[slot] = {k for f in found if f.path.endswith(".parquet") for k in pq.read_table(f.path, columns=["key"], filesystem=files)["key"].to_pylist()}
                    files.create_dir(home, recursive=True)
                keys = [k for k in rows["key"] if k not in there[slot]]
                for at in range(0, len(keys), batch):
                    time.sleep(max(0.0, due - time.monotonic()))
                    due = time.monotonic() + period
                    asked = keys[at : at + batch]
                    answer = pa.table({"key": asked, "z_m": pa.array(ask(asked), pa.float64())})
                    name = f"{home}/{uuid.uuid4().hex}"
                    pq.write_table(answer, name + ".part", filesystem=files)
                    files.move(name + ".part", name + ".parquet")  # whole, or not seen
                yield pd.DataFrame({"slot": [slot], "n": [len(keys)]})

    return keep


def heights(points: DataFrame, ask: Callable[[list[str]], list[float]], cache: DataFrame | None = None, at_once: int = 4, cache_path: str | None = None, batch: int = 25, rate: float | None = None) -> DataFrame:
    """``points`` (lat, lon) with z_m.  Each distinct point that the cache (key, z_m) lacks is asked for once, by ``at_once`` tasks.

    With ``cache_path`` the cache is the Parquet table there, and what was asked for is added to it.  Answers are kept beside
    it as they come, ``batch`` points each; those of a run that failed are found by the next one (once its
    killed tasks have ended).  All tasks together send
    ``rate`` requests a second at most (with speculative tasks up to twice that).
    """
    spark = points.sparkSession
    folder = f"{cache_path}.answers" if cache_path is not None else shared_path(spark)
    if cache_path is not None:
        cache = cached(points, cache_path)
    keyed = points.withColumn("key", point_key(F.col("lat"), F.col("lon")))
    wanted = keyed.select("key").distinct()
    if cache is not None:
        wanted = wanted.join(cache, "key", "left_anti")
    slots = wanted.select("key", F.pmod(F.xxhash64("key"), F.lit(at_once)).alias("slot"))
    slots.repartition(at_once, "slot").mapInPandas(asking(ask, folder, at_once, batch, rate), "slot long, n long").write.format("noop").mode("overwrite").save()
    files, root = answers_folder(folder)
    kept = spark.read.schema("key string, z_m double").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
    got = kept.parquet(folder) if files.get_file_info(root).type != fs.FileType.NotFound else spark.createDataFrame([], "key string, z_m double")
    got = stored(got.groupBy("key").agg(F.first("z_m").alias("z_m")))
    if cache_path is not None:
        if cache is not None:
            cache = stored(cache)  # what it held before this
            got = got.join(cache.select("key"), "key", "left_anti")
        got = stored(got)
        got.write.mode("append").parquet(cache_path)
        if files.get_file_info(root).type != fs.FileType.NotFound:
            files.delete_dir(root)  # the cache has them now
    return keyed.join(got if cache is None else got.union(cache.select("key", "z_m")), "key", "left").drop("key")
