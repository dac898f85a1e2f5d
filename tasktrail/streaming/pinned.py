"""The school as a batch saw it at its first try.

A batch that is run again must give the messages it gave before, even if a name or the list
of administrators has changed in between. So before a batch writes anything, the rows of the
school that its flagged changes refer to, and the administrators, are written to a folder of
its number; a rerun reads them from there. They are as many as the batch refers to, and go
once a later batch starts, for then this one is committed and never runs again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tasktrail.functions.constants import ADMINISTRATOR
from tasktrail.operators.alerts import flagged
from tasktrail.sources.schemas import TABLES
from tasktrail.sources.school import School

# The lookups of each table's alerts and the columns that refer to them.
REFERRED = {
    "attendance": {"students": "studentId", "staff": "staffId"},
    "task_evaluations": {
        "students": "studentId",
        "staff": "staffId",
        "evaluations": "evaluationId",
        "tasks": "taskId",
    },
}


class PinnedSchools:
    """Snapshots below ``folder``, one per batch that is not yet committed."""

    def __init__(self, spark: SparkSession, folder: str, table: str):
        self.spark, self.folder, self.table = spark, folder.rstrip("/"), table
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._path = path
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._files = path(self.folder).getFileSystem(conf)

    def school(self, build: Callable[[], School], changes: DataFrame, batch: int) -> School:
        """The school of ``batch``: recorded if it ran before, else built and recorded now."""
        own = f"{self.folder}/batch={batch}"
        # The administrators are written last, so their mark stands for all.
        if not self._files.exists(self._path(f"{own}/users.parquet/_SUCCESS")):
            self._record(build(), flagged(changes), own)
        self._forget(batch)
        names = [*REFERRED[self.table], "users"]
        return School(
            {
                name: self.spark.read.schema(TABLES[name]).parquet(f"{own}/{name}.parquet")
                for name in names
            }
        )

    def _record(self, school: School, changes: DataFrame, own: str) -> None:
        for name, key in REFERRED[self.table].items():
            wanted = changes.select(key).filter(F.col(key).isNotNull()).distinct()
            rows = getattr(school, name).join(wanted, key, "left_semi").select(*TABLES[name].names)
            rows.write.mode("overwrite").parquet(f"{own}/{name}.parquet")
        users = school.users.filter(F.col("userType") == ADMINISTRATOR)
        users.write.mode("overwrite").parquet(f"{own}/users.parquet")

    def _forget(self, batch: int) -> None:
        for status in self._files.listStatus(self._path(self.folder)):
            number = status.getPath().getName().removeprefix("batch=")
            if number.isdigit() and int(number) < batch:
                self._files.delete(status.getPath(), True)
