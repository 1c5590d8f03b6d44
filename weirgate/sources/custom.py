"""A table whose rows come from user code, read in parallel through Spark's Python data source API."""

from __future__ import annotations

import pickle
import sys
from base64 import b64decode, b64encode
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from weirgate.contracts import Contract

# Python workers get these classes with their code, so the package need not be installed on executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class _Slice(InputPartition):
    def __init__(self, parent: object):
        super().__init__(parent)


class _ResolverReader(DataSourceReader):
    def __init__(self, resolver: Callable, parents: list, names: list[str]):
        self._resolver, self._parents, self._names = resolver, parents, names

    def partitions(self) -> list[InputPartition]:
        return [_Slice(p) for p in self._parents]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for item in self._resolver(partition.value):
            yield item if isinstance(item, pa.RecordBatch) else tuple(item.get(n) for n in self._names)


class ResolverSource(DataSource):
    """Each parent (account, page range, region) is one partition and is resolved on an executor."""

    @classmethod
    def name(cls) -> str:
        return "weirgate_resolver"

    def schema(self) -> str:
        return self.options["ddl"]

    def reader(self, schema) -> DataSourceReader:
        resolver, parents = pickle.loads(b64decode(self.options["payload"]))
        return _ResolverReader(resolver, parents, schema.fieldNames())


def read_resolved(
    spark: SparkSession, contract: Contract, resolver: Callable[[object], Iterator[dict]], parents: list
) -> DataFrame:
    """Rows that ``resolver(parent)`` yields for every parent, with the contract's columns.

    The resolver yields dicts, or Arrow record batches where there are many rows.
    """
    spark.dataSource.register(ResolverSource)
    payload = b64encode(cloudpickle.dumps((resolver, list(parents)))).decode()
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in contract.schema.fields)
    return spark.read.format(ResolverSource.name()).option("ddl", ddl).option("payload", payload).load()
