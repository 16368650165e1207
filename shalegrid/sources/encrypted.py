"""Encrypted Parquet files: footer and column keys, modular encryption as in the file format, by Arrow on the executors.

Data keys are wrapped under master keys that the caller has (id -> 16, 24 or 32 bytes); here the wrapping is a keyed stream
with a tag. A deployment with a key service puts its own client in the place of LocalKeys.
"""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage


def _client(keys: dict[str, bytes]):
    import pyarrow.parquet.encryption as pe

    class LocalKeys(pe.KmsClient):
        def __init__(self, _config):
            pe.KmsClient.__init__(self)

        def _stream(self, master: bytes, salt: bytes, n: int) -> bytes:
            return hashlib.shake_256(master + salt).digest(n)

        def wrap_key(self, key_bytes, master_key_identifier):
            master, salt = keys[master_key_identifier], os.urandom(16)
            body = bytes(a ^ b for a, b in zip(key_bytes, self._stream(master, salt, len(key_bytes)), strict=True))
            return base64.b64encode(salt + hmac.digest(master, salt + body, "sha256") + body)

        def unwrap_key(self, wrapped_key, master_key_identifier):
            if master_key_identifier not in keys:
                raise ValueError(f"no master key {master_key_identifier!r}")
            raw, master = base64.b64decode(wrapped_key), keys[master_key_identifier]
            salt, tag, body = raw[:16], raw[16:48], raw[48:]
            if not hmac.compare_digest(tag, hmac.digest(master, salt + body, "sha256")):
                raise ValueError("the master key does not fit the wrapped key")
            return bytes(a ^ b for a, b in zip(body, self._stream(master, salt, len(body)), strict=True))

    return pe.CryptoFactory(LocalKeys), pe.KmsConnectionConfig()


def _keys(options: dict) -> dict[str, bytes]:
    raw = options.get("keys")
    if not raw:
        raise ValueError("encrypted files need the option keys: a JSON object of master key ids and base64 keys")
    return {k: base64.b64decode(v) for k, v in json.loads(raw).items()}


class _Part(InputPartition):
    pass


class EncryptedReader(DataSourceReader):
    def __init__(self, path: str, keys: dict[str, bytes], schema: T.StructType):
        self.path, self.keys, self.columns = path, keys, schema

    def partitions(self):
        from shalegrid.sources.files import data_files

        return [_Part(p) for p in data_files(self.path)]

    def read(self, partition):
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import to_arrow_schema

        from shalegrid.sources.files import filesystem

        factory, kms = _client(self.keys)
        names = to_arrow_schema(self.columns)
        system, plain = filesystem(partition.value)
        with system.open_input_file(plain) as f:
            for batch in pq.ParquetFile(f, decryption_properties=factory.file_decryption_properties(kms)).iter_batches(8192, columns=names.names):
                yield batch.select(names.names).cast(names)


class _Written(WriterCommitMessage):
    def __init__(self, temporary: str, final: str):
        self.temporary, self.final = temporary, final


class EncryptedWriter(DataSourceArrowWriter):
    """Each task writes a file of its own under a temporary name; commit renames those of the tasks that count. Names hold the
    write's own id, so that no write replaces another's files; with overwrite, files that were there go once the new ones stand."""

    def __init__(self, path: str, keys: dict[str, bytes], options: dict, schema: T.StructType, overwrite: bool):
        import uuid

        self.path, self.keys, self.columns, self.overwrite, self.id = path, keys, schema, overwrite, uuid.uuid4().hex
        self.footer, self.by_key, self.plain = options.get("footer_key"), json.loads(options.get("column_keys", "{}")), options.get("plaintext_footer", "false") == "true"

    def write(self, iterator):
        import uuid

        import pyarrow.parquet as pq
        import pyarrow.parquet.encryption as pe
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        from shalegrid.sources.files import filesystem

        factory, kms = _client(self.keys)
        config = pe.EncryptionConfiguration(footer_key=self.footer, column_keys=self.by_key or None, plaintext_footer=self.plain, uniform_encryption=not self.by_key)
        system, plain = filesystem(self.path)
        system.create_dir(plain, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}-{self.id}.parquet"
        temporary = f"{plain}/.{uuid.uuid4().hex}.{name}"
        names = to_arrow_schema(self.columns)
        with system.open_output_stream(temporary) as f, pq.ParquetWriter(f, names, encryption_properties=factory.file_encryption_properties(kms, config)) as out:
            for batch in iterator:
                out.write_batch(batch.cast(names))
        return _Written(temporary, f"{plain}/{name}")

    def commit(self, messages):
        from pyarrow import fs

        from shalegrid.sources.files import data_files, filesystem

        system, plain = filesystem(self.path)
        system.create_dir(plain, recursive=True)
        before = data_files(self.path) if self.overwrite else []
        for m in messages:
            if m is not None:
                if system.get_file_info(m.final).type != fs.FileType.NotFound:
                    raise FileExistsError(m.final)
                system.move(m.temporary, m.final)
        for old in before:
            system.delete_file(filesystem(old)[1])

    def abort(self, messages):
        from shalegrid.sources.files import filesystem

        system, _ = filesystem(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(m.temporary)


class EncryptedParquet(DataSource):
    """format("encrypted_parquet"), options keys, and for writes footer_key, column_keys (JSON: key id -> columns) and
    plaintext_footer."""

    @classmethod
    def name(cls):
        return "encrypted_parquet"

    def reader(self, schema):
        return EncryptedReader(self.options["path"], _keys(self.options), schema)

    def writer(self, schema, overwrite):
        return EncryptedWriter(self.options["path"], _keys(self.options), self.options, schema, overwrite)


def _option(keys: dict[str, bytes]) -> str:
    return json.dumps({k: base64.b64encode(v).decode() for k, v in keys.items()})


def write_encrypted(df: DataFrame, path: str, keys: dict[str, bytes], footer_key: str, column_keys: dict[str, list[str]] | None = None, plaintext_footer: bool = False, mode: str = "append") -> None:
    df.sparkSession.dataSource.register(EncryptedParquet)
    options = {"keys": _option(keys), "footer_key": footer_key, "column_keys": json.dumps(column_keys or {}), "plaintext_footer": str(plaintext_footer).lower()}
    df.write.format("encrypted_parquet").mode(mode).options(**options).save(path)


def read_encrypted(spark: SparkSession, path: str, keys: dict[str, bytes], schema: T.StructType) -> DataFrame:
    spark.dataSource.register(EncryptedParquet)
    return spark.read.format("encrypted_parquet").option("keys", _option(keys)).schema(schema).load(path)
