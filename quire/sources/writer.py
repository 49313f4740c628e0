"""One file a document and format: a data source that stages files, and renames them into place when all tasks are done."""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

ERRORS, DONE, STAGING = "_errors", "_SUCCESS", "_staging-"
#: Renames at a time.
RENAMES = 16


@dataclass
class Staged(WriterCommitMessage):
    folder: str
    files: int
    failed: int


class DocumentFiles(DataSource):
    """Rows (name, format, content) as files ``name.format`` below ``path``; content is text or bytes.

    Options: path, a folder that all executors reach (a local path, or a URI that pyarrow knows); existing: "replace" (the
    default), "keep" or "error" for files that are there already. Every task writes below a staging folder; only
    when all are done does the driver rename the files of the tasks that count into place, each at once, so a reader sees
    a whole file, old or new, and a lost executor or a task that ran twice leaves nothing. A document that can't be written (no name,
    no content, a name outside the folder, one that is taken) is a row of ``failures`` and stops no other.
    """

    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return "name string, format string, content string"

    def writer(self, schema: StructType, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options, schema)


class DocumentWriter(DataSourceArrowWriter):
    def __init__(self, options, schema: StructType):
        if "path" not in options:
            raise ValueError("documents: the option path is missing")
        self.path, self.existing = options["path"], options.get("existing", "replace")
        if self.existing not in ("replace", "keep", "error"):
            raise ValueError(f"documents: existing can't be {self.existing}")
        if missing := {"name", "format", "content"} - set(schema.names):
            raise ValueError(f"documents: no column {', '.join(sorted(missing))}")
        self.job = uuid.uuid4().hex

    def _root(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def _target(self, name, kind, content) -> str:
        """The file below the folder that a row is for; ValueError says why there is none."""
        if not name:
            raise ValueError("no name")
        if content is None:
            raise ValueError("no content")
        target = f"{name}.{kind}" if kind else name
        if target.startswith(("/", "_", ".")) or posixpath.normpath(target) != target or ".." in target.split("/"):
            raise ValueError("not a name below the folder")
        return target

    def write(self, iterator: Iterator) -> Staged:
        store, root = self._root()
        folder = f"{STAGING}{self.job}/{uuid.uuid4().hex}"
        store.create_dir(f"{root}/{folder}/files", recursive=True)
        files = failed = 0
        made = set()
        with store.open_output_stream(f"{root}/{folder}/errors.json") as errors:
            for batch in iterator:
                columns = [batch.column(batch.schema.get_field_index(c)) for c in ("name", "format", "content")]
                for row in zip(*columns):
                    name, kind, content = (x.as_py() for x in row)
                    try:
                        target = self._target(name, kind, content)
                        if self.existing == "error" and store.get_file_info(f"{root}/{target}").type != fs.FileType.NotFound:
                            raise ValueError("there is such a file")
                        if (parent := posixpath.dirname(target)) not in made:
                            store.create_dir(f"{root}/{folder}/files/{parent}", recursive=True)
                            made.add(parent)
                        with store.open_output_stream(f"{root}/{folder}/files/{target}") as out:
                            out.write(content.encode() if isinstance(content, str) else content)
                        files += 1
                    except (ValueError, OSError) as e:
                        failed += 1
                        errors.write((json.dumps({"name": name, "format": kind, "error": str(e)}) + "\n").encode())
        return Staged(folder, files, failed)

    def commit(self, messages: list[Staged | None]) -> None:
        store, root = self._root()
        store.create_dir(f"{root}/{ERRORS}", recursive=True)
        for info in store.get_file_info(fs.FileSelector(f"{root}/{ERRORS}")):
            store.delete_file(info.path)
        made = set()

        def place(source: str, base: str) -> None:
            target = f"{root}/{source.removeprefix(base)}"
            if self.existing == "keep" and store.get_file_info(target).type != fs.FileType.NotFound:
                return
            store.move(source, target)

        with ThreadPoolExecutor(RENAMES) as pool:
            for k, m in enumerate(x for x in messages if x):
                base = f"{root}/{m.folder}/files/"
                found = store.get_file_info(fs.FileSelector(base.rstrip("/"), recursive=True)) if m.files else []
                for d in sorted(i.path for i in found if i.type == fs.FileType.Directory):
                    if (below := d.removeprefix(base)) not in made:
                        store.create_dir(f"{root}/{below}", recursive=True)
                        made.add(below)
                for done in [pool.submit(place, i.path, base) for i in found if i.type == fs.FileType.File]:
                    done.result()
                if m.failed:
                    store.move(f"{root}/{m.folder}/errors.json", f"{root}/{ERRORS}/part-{k:05d}.json")
        store.delete_dir(f"{root}/{STAGING}{self.job}")
        with store.open_output_stream(f"{root}/{DONE}"):
            pass

    def abort(self, messages: list[Staged | None]) -> None:
        store, root = self._root()
        if store.get_file_info(f"{root}/{STAGING}{self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/{STAGING}{self.job}")


def save(df: DataFrame, path: str, existing: str = "replace") -> None:
    """Writes (name, format, content) as files; needs no registration by the caller."""
    df.sparkSession.dataSource.register(DocumentFiles)
    df.select("name", "format", "content").write.format("documents").mode("append").option("path", path).option("existing", existing).save()


def failures(spark: SparkSession, path: str) -> DataFrame:
    """(name, format, error) of the last save: documents and formats that couldn't be written."""
    return spark.read.schema("name string, format string, error string").json(f"{path.rstrip('/')}/{ERRORS}")
