"""Tables in versions, and files that appear whole or not at all, in any store that Spark's file systems reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Row, SparkSession


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def work_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; local sessions without one use a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"{tempfile.gettempdir()}/checkpoints"
    return f"{root.rstrip('/')}/segmill/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table of its own in the shared folder, for what is read more than once; a lost executor costs no recomputation."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Store:
    """Versions of one table under a path. A version counts once its mark is there, so readers never see half of one.

    Marks are made exclusively: of two writers of a version, one fails. The version before the current one stays for readers.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _at(self, n: int) -> str:
        return f"{self.path}/v{n:08d}"

    def version(self) -> int | None:
        """The current version, None without any."""
        fs, p = _fs(self.spark, self.path)
        if not fs.exists(p):
            return None
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return max((int(x[1:-5]) for x in names if x.startswith("v") and x.endswith(".done")), default=None)

    def create(self) -> None:
        """An empty first version, if there is none."""
        if self.version() is None:
            self.clear()

    def read(self) -> DataFrame:
        """The current version; empty if there is none."""
        n = self.version()
        return self.spark.read.schema(self.schema).parquet(self._at(n)) if n is not None else self.spark.createDataFrame([], self.schema)

    def write(self, rows: DataFrame) -> int:
        """rows as the next version, which may be made from the current one."""
        n = (self.version() or 0) + 1
        rows.write.mode("overwrite").parquet(self._at(n))
        fs, mark = _fs(self.spark, f"{self._at(n)}.done")
        fs.create(mark, False).close()
        if n > 2:
            for old in (f"{self._at(n - 2)}.done", self._at(n - 2)):
                fs.delete(_fs(self.spark, old)[1], True)
        return n

    def clear(self) -> int:
        """An empty version: all is to be done again."""
        return self.write(self.spark.createDataFrame([], self.schema))


def reusable(spark: SparkSession, path: str, overwrite: bool = False) -> bool:
    """Whether a file of an earlier run can be used: it is there, holds something, and is not to be made again."""
    fs, p = _fs(spark, path)
    return not overwrite and fs.exists(p) and fs.getContentSummary(p).getLength() > 0


def publish(spark: SparkSession, source: str, target: str, overwrite: bool = False) -> None:
    """Copy a file or folder beside its target and rename it there; an existing target is an error unless it may be replaced."""
    (fs, src), (to, dst) = _fs(spark, source), _fs(spark, target)
    if to.exists(dst) and not overwrite:
        raise FileExistsError(target)
    folder, _, name = target.rstrip("/").rpartition("/")
    _, tmp = _fs(spark, f"{folder}/.{name}.tmp")
    to.delete(tmp, True)
    jvm = spark.sparkContext._jvm
    if not jvm.org.apache.hadoop.fs.FileUtil.copy(fs, src, to, tmp, False, spark.sparkContext._jsc.hadoopConfiguration()):
        raise OSError(f"could not copy {source}")
    to.delete(dst, True)
    if not to.rename(tmp, dst):
        raise OSError(f"could not rename to {target}")


def append_lines(lines: DataFrame, path: str) -> None:
    """Add lines to a log; a log is a folder."""
    lines.select("line").write.mode("append").text(path)


def single(rows: DataFrame, what: str = "row") -> Row:
    """The only row; none or several are an error."""
    two = rows.head(2)
    if len(two) != 1:
        raise ValueError(f"expected one {what}, found {'none' if not two else 'several'}")
    return two[0]


def environment(spark: SparkSession, path: str) -> dict[str, str]:
    """The settings of a file of KEY=value lines; blank lines and comments are skipped, quotes around a value go."""
    out = {}
    for r in spark.read.text(path).collect():
        key, eq, value = r.value.strip().removeprefix("export ").partition("=")
        if eq and not key.startswith("#"):
            value = value.strip()
            out[key.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value
    return out
