"""Saved models and their call quota, as files below one folder.

``models/<key>`` holds a trained model, ``registry/<key>.json`` its manifest
and ``calls/<key>/<slot>`` a file of one byte for every prediction call. The
manifest is written last and appears at once, so readers see whole models only.
A call claims the next free slot by creating its file, which succeeds for one
caller alone: callers that come together cannot use more calls than there are.
A model has no more slots than its limit, and a check lists its own only.
"""

from __future__ import annotations

import json
import secrets
import string
import uuid
from collections.abc import Mapping
from dataclasses import fields, is_dataclass
from datetime import datetime, timezone
from urllib.parse import unquote, urlparse

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.ml import classification, regression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.operators import dates, encode, place, scale, steps, weight
from coppice.operators.lookup import KeyedTable, local_frame, reopen
from coppice.plans import assemble, roles as roles_module
from coppice.plans.boosting import SoftmaxModel
from coppice.plans.forest import ForestModel
from coppice.plans.model import Trained
from coppice.plans.residuals import ResidualModel
from coppice.plans.roles import Roles

# Characters and length of a model key, calls per model.
KEY_CHARACTERS = string.ascii_uppercase + string.digits
KEY_LENGTH = 24
CALL_LIMIT = 100

REGISTRY = (
    "model_key string, created_at timestamp, target string, target_is_categorical boolean, date string, "
    "latitude string, longitude string, groups array<string>, features array<string>, call_limit bigint"
)
CALLS = "model_key string, called_at timestamp"
PROBLEM = ["target", "target_is_categorical", "date", "latitude", "longitude", "groups"]

_MODULES = (assemble, dates, encode, place, scale, steps, weight, roles_module)
_PARTS = {c.__name__: c for m in _MODULES for c in vars(m).values() if isinstance(c, type) and is_dataclass(c)}


def new_key() -> str:
    return "".join(secrets.choice(KEY_CHARACTERS) for _ in range(KEY_LENGTH))


def _describe(value, tables: list[KeyedTable]):
    """A fitted object as JSON; the keyed tables it holds are listed in ``tables``."""
    if isinstance(value, KeyedTable):
        tables.append(value)
        return {"table": len(tables) - 1, "keys": list(value.keys)}
    if is_dataclass(value):
        return {
            "part": type(value).__name__,
            "fields": {f.name: _describe(getattr(value, f.name), tables) for f in fields(value)},
        }
    if isinstance(value, (tuple, list)):
        return [_describe(v, tables) for v in value]
    return value


def _rebuild(value, open_table):
    if isinstance(value, list):
        return tuple(_rebuild(v, open_table) for v in value)
    if isinstance(value, Mapping) and "table" in value:
        return reopen(open_table(value["table"]), value["keys"])
    if isinstance(value, Mapping) and "part" in value:
        return _PARTS[value["part"]](**{k: _rebuild(v, open_table) for k, v in value["fields"].items()})
    return value


def save_trained(spark: SparkSession, trained: Trained, path: str) -> None:
    tables: list[KeyedTable] = []
    parts = {
        name: _describe(getattr(trained, name), tables)
        for name in ("roles", "model_roles", "features", "vector", "target", "dropped_rows")
    }
    parts["model"] = type(trained.model).__name__
    if isinstance(trained.model, SoftmaxModel | ResidualModel):
        trained.model.save(spark, f"{path}/model")
    else:
        trained.model.write().save(f"{path}/model")
    for i, table in enumerate(tables):
        table.frame.write.parquet(f"{path}/table_{i}")
    local_frame(spark, [{"parts": json.dumps(parts)}], "parts string").write.parquet(f"{path}/parts")


def load_trained(spark: SparkSession, path: str) -> Trained:
    parts = json.loads(spark.read.parquet(f"{path}/parts").first()["parts"])
    kind = parts.pop("model")
    own = {c.__name__: c for c in (SoftmaxModel, ForestModel, ResidualModel)}
    if kind in own:
        model = own[kind].load(spark, f"{path}/model")
    else:
        loader = getattr(regression, kind, None) or getattr(classification, kind)
        model = loader.load(f"{path}/model")

    def open_table(i: int) -> DataFrame:
        return spark.read.parquet(f"{path}/table_{i}")

    return Trained(model=model, **{k: _rebuild(v, open_table) for k, v in parts.items()})


class Folder:
    """The few file operations of the registry, on the driver, in any store that Spark's paths name."""

    def __init__(self, spark: SparkSession, folder: str):
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        root = self._path(folder)
        self.files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.root = self.files.makeQualified(root).toString()
        self.local = self.files.getUri().getScheme() == "file"

    def _of(self, name: str):
        return self._path(f"{self.root}/{name}")

    def names(self, name: str) -> list[str]:
        """What stands in a folder; nothing if there is none."""
        where = self._of(name)
        return [s.getPath().getName() for s in self.files.listStatus(where)] if self.files.exists(where) else []

    def claim(self, name: str) -> bool:
        """Create a file of one byte, as Spark's readers skip empty ones; False if it is there already. Of several callers one succeeds."""
        where = self._of(name)
        self.files.mkdirs(where.getParent())
        if self.local:  # Hadoop's local file system looks first and creates then, so the machine's own call decides
            try:
                with open(unquote(urlparse(where.toString()).path), "xb") as out:
                    out.write(b"1")
            except FileExistsError:
                return False
            return True
        try:
            out = self.files.create(where, False)
            out.write(49)
            out.close()
        except Py4JJavaError:
            if self.files.exists(where):
                return False
            raise
        return True

    def publish(self, name: str, text: str) -> None:
        """Write a file under a name that Spark's readers skip, then give it its own."""
        where = self._of(name)
        hidden = self._path(where.getParent(), f"_{uuid.uuid4().hex}")
        self.files.mkdirs(where.getParent())
        out = self.files.create(hidden, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if not self.files.rename(hidden, where):
            raise OSError(f"cannot publish {name}")


class Registry:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._files = Folder(spark, self.folder)

    def _found(self, read, schema: str) -> DataFrame:
        try:
            return read()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return local_frame(self.spark, [], schema)

    def models(self) -> DataFrame:
        return self._found(lambda: self.spark.read.schema(REGISTRY).json(f"{self.folder}/registry"), REGISTRY)

    def calls(self) -> DataFrame:
        """One row per call: the model and when its slot was claimed. File contents are not read."""
        def read() -> DataFrame:
            slots = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{self.folder}/calls")
            return slots.select(F.element_at(F.split("path", "/"), -2).alias("model_key"), F.col("modificationTime").alias("called_at"))

        return self._found(read, CALLS)

    def write_model(self, trained: Trained, created_at: datetime | None = None, call_limit: int = CALL_LIMIT) -> str:
        """Save the model, then list it; returns its key. What fails on the way is never listed."""
        key = new_key()
        while not self._files.claim(f"keys/{key}"):
            key = new_key()
        save_trained(self.spark, trained, f"{self.folder}/models/{key}")
        role_values = {f.name: getattr(trained.roles, f.name) for f in fields(Roles)}
        for name in ("groups", "features"):
            role_values[name] = list(role_values[name]) if role_values[name] is not None else None
        created = (created_at or datetime.now(timezone.utc)).astimezone(timezone.utc)
        row = {"model_key": key, "created_at": created.isoformat(timespec="microseconds"), "call_limit": call_limit, **role_values}
        self._files.publish(f"registry/{key}.json", json.dumps(row))
        return key

    def _limit(self, key: str) -> int:
        row = self.models().filter(F.col("model_key") == key).select("call_limit").first()
        if row is None:
            raise KeyError(key)
        return row["call_limit"]

    def read_model(self, key: str) -> Trained:
        self._limit(key)
        return load_trained(self.spark, f"{self.folder}/models/{key}")

    def remaining_calls(self, key: str) -> int:
        return self._limit(key) - len(self._files.names(f"calls/{key}"))

    def record_call(self, key: str) -> int:
        """Count one prediction; refuses with ``PermissionError`` once none is left."""
        limit = self._limit(key)
        for slot in range(len(self._files.names(f"calls/{key}")), limit):
            if self._files.claim(f"calls/{key}/{slot}"):
                return limit - slot - 1
        raise PermissionError(f"model {key} has no calls left")

    def list_models(self) -> DataFrame:
        return list_models(self.models(), self.calls())


def _with_remaining(models: DataFrame, calls: DataFrame) -> DataFrame:
    """Calls are counted before they are joined, so a busy model costs no more than an idle one."""
    made = calls.groupBy("model_key").agg(F.count(F.lit(1)).alias("made"))
    left = (F.col("call_limit") - F.coalesce("made", F.lit(0))).cast("bigint")
    return models.join(made, "model_key", "left").withColumn("remaining_calls", left).drop("made", "call_limit")


def quota(models: DataFrame, calls: DataFrame) -> DataFrame:
    """``(model_key, remaining_calls)``: the limit minus the calls made."""
    return _with_remaining(models.select("model_key", "call_limit"), calls)


def list_models(models: DataFrame, calls: DataFrame) -> DataFrame:
    """The registry with remaining calls, newest first."""
    return _with_remaining(models, calls).orderBy(F.col("created_at").desc(), "model_key")


def same_problem_models(models: DataFrame) -> DataFrame:
    """Models that agree in all roles but the features: one row per problem."""
    return models.groupBy(*PROBLEM).agg(
        F.count(F.lit(1)).alias("n_models"),
        F.min("model_key").alias("first_key"),
        F.max("created_at").alias("newest"),
    )
