"""Files in a folder that driver and executors share, through Hadoop's file system: local, HDFS or an object store alike.

Spark writes tables and parts; this is for what stands beside them: manifests, marks, logs, and delivery files made of parts.
Files that belong together take their names together: `publish` leaves a journal while it renames, undoes all of it when
a rename fails, and `recover` undoes what a driver that died left half done.  A folder has one writer at a time.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

_JOURNAL = re.compile(r"\.publish-[0-9a-f]+\.json")


class Folder:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self._jvm = spark, str(root).rstrip("/") or "/", spark._jvm

    def at(self, name: str = "") -> str:
        """The whole path of a name in this folder; a path that is already whole stays."""
        if not name:
            return self.root
        return name if re.match(r"/|[A-Za-z][A-Za-z0-9+.-]*:/", name) else f"{self.root.rstrip('/')}/{name}"

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self.at(name))

    def _files(self, name: str):
        return self._path(name).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        return self._files(name).exists(self._path(name))

    def names(self, name: str = "") -> list[tuple[str, int]]:
        """(name, time of change in ms) of what lies in a folder, by name; nothing where there is none."""
        if not self.exists(name):
            return []
        return sorted((s.getPath().getName(), s.getModificationTime()) for s in self._files(name).listStatus(self._path(name)))

    def size(self, name: str) -> int:
        return self._files(name).getFileStatus(self._path(name)).getLen()

    def read(self, name: str) -> str:
        if not self.exists(name):
            raise FileNotFoundError(self.at(name))
        stream = self._files(name).open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self._files(name).delete(self._path(name), True)

    def rename(self, name: str, to: str, over: bool = False) -> None:
        """A file takes another name in one step, in place of the file that has it where `over` is set."""
        self._files(to).mkdirs(self._path(to).getParent())
        kinds = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(kinds, 1)
        how[0] = kinds.OVERWRITE if over else kinds.NONE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files(to).getUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(self._path(name), self._path(to), how)

    def _create(self, name: str):
        return self._files(name).create(self._path(name), True)

    def make(self, name: str, text: str) -> str:
        """Writes text under a passing name beside `name` and returns that, for `publish`."""
        made = self._beside(name, "tmp")
        stream = self._create(made)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self._plain(made)
        return made

    def _plain(self, name: str) -> None:
        """A local file without the checksum that Hadoop puts beside it, so that it can be edited by hand."""
        top, last = self.at(name).rsplit("/", 1)
        if self.exists(f"{top}/.{last}.crc"):
            self.delete(f"{top}/.{last}.crc")

    def write(self, name: str, text: str) -> None:
        """A small file that is there whole or not at all."""
        self.rename(self.make(name, text), name, over=True)

    def _beside(self, name: str, kind: str) -> str:
        whole = self.at(name) if "/" in self.at(name) else f"./{name}"
        return f"{whole.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}.{kind}"

    def make_table(self, name: str, df: DataFrame, fmt: str) -> str:
        """One file of a DataFrame in its order, under a passing name: parts are written side by side, then their bytes are joined.

        csv: a header line, then the rows.  json: an array of objects.  documents: an array of the objects in the one text column.
        """
        parts, made = self._beside(name, "parts"), self._beside(name, "tmp")
        if fmt == "csv":
            df.write.option("header", False).option("escape", '"').csv(parts)
            head, tail, cut = ",".join(df.columns) + "\n", "", 0
        else:
            writer = df.write.option("lineSep", ",\n")
            writer.text(parts) if fmt == "documents" else writer.option("ignoreNullFields", False).json(parts)
            head, tail, cut = "[", "]", 2
        files = [f"{parts}/{n}" for n, _ in self.names(parts) if n.startswith("part-")]
        files = [f for f in files if self.size(f)]
        out = self._create(made)
        try:
            out.write(bytearray(head.encode()))
            for k, f in enumerate(files):
                stream = self._files(f).open(self._path(f))
                try:
                    # the last row has no separator behind it
                    self._jvm.org.apache.commons.io.IOUtils.copyLarge(stream, out, 0, self.size(f) - (cut if k + 1 == len(files) else 0))
                finally:
                    stream.close()
            out.write(bytearray(tail.encode()))
        finally:
            out.close()
        self._plain(made)
        self.delete(parts)
        return made

    def sha256(self, name: str) -> str:
        """Of a file's bytes, read as a stream."""
        digest = self._jvm.java.security.MessageDigest.getInstance("SHA-256")
        stream = self._jvm.java.security.DigestInputStream(self._files(name).open(self._path(name)), digest)
        try:
            stream.transferTo(self._jvm.java.io.OutputStream.nullOutputStream())
        finally:
            stream.close()
        return bytes(digest.digest()).hex()

    def publish(self, files: list[tuple[str, str]], over: bool = True) -> None:
        """(made, name) of files that take their names together, all or none; without `over` none of the names may be taken."""
        taken = [name for _, name in files if self.exists(name)]
        if taken and not over:
            for made, _ in files:
                self.delete(made)
            raise FileExistsError(self.at(taken[0]))
        steps = [{"made": self.at(made), "name": self.at(name), "kept": self._beside(name, "kept") if name in taken else None} for made, name in files]
        journal = f".publish-{uuid.uuid4().hex}.json"
        self.write(journal, json.dumps(steps))
        try:
            for step in steps:
                if step["kept"]:
                    self.rename(step["name"], step["kept"])
                self.rename(step["made"], step["name"])
        except Exception:
            self._undo(journal, steps)
            raise
        self.delete(journal)
        for step in steps:
            if step["kept"]:
                self.delete(step["kept"])

    def _undo(self, journal: str, steps: list[dict]) -> None:
        for step in reversed(steps):
            if self.exists(step["made"]):
                self.delete(step["made"])
            elif self.exists(step["name"]) and (not step["kept"] or self.exists(step["kept"])):
                self.delete(step["name"])
            if step["kept"] and self.exists(step["kept"]):
                self.rename(step["kept"], step["name"])
        self.delete(journal)

    def recover(self) -> int:
        """Undoes what a driver that died left half published; returns how many sets of files that were."""
        left = [n for n, _ in self.names() if _JOURNAL.fullmatch(n)]
        for n in left:
            self._undo(n, json.loads(self.read(n)))
        return len(left)
