"""A vault: an encrypted, versioned catalog kept as Parquet tables, changed by Spark jobs.

Folders below the vault's path (any file system that Spark writes and that creates a file only if it is not there):

    files/gen=N     the whole listing of generation N, names sealed
    seals/gen=N     its count, keyed digest and stored bytes; written after the listing, so its _SUCCESS publishes N
    mirror/gen=N    the listing again, written last, read if files/gen=N is lost
    chunks/gen=N    the sealed chunks that generation N wrote; survivors stay where they are
    claims/gen=N    a file that the writer of N creates first; who finds it there doesn't write N
    keys/gen=K      the master key under the password's key; the latest K counts

A change claims generation N + 1, reads N, writes its new chunks, the listing, the seal, then the mirror.  A job that dies before the
seal leaves N in force, and its claim, which ``break_claim`` removes; one that fails removes it itself.  What ``open`` returns has the
listing that was sealed: a row that is lost, doubled, changed or of another version shows.
The master key stays on the driver but for literals in plans (see ``functions.keyed``).  The password key is scrypt's.
"""

from __future__ import annotations

import hashlib
import hmac
import os
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strongroom.functions import layout
from strongroom.functions.keyed import ContentKey, NameKey, hkdf, hmac256
from strongroom.functions.text import ERRORS
from strongroom.model import CHUNK, CHUNKS, COMPACT_RATIO, FILES, FIRST_GENERATION, HEADER, MAX_CHUNKS, MAX_FILES, MAX_METADATA, OVERHEAD
from strongroom.operators.digest import row_mac, table_digest


#: Stored chunks, with the generation that their folder says.
STORED = T.StructType([*CHUNKS.fields, T.StructField("gen", T.LongType())])


class VaultError(Exception):
    pass


class WrongPassword(VaultError):
    pass


class NotFound(VaultError):
    pass


class InvalidArgument(VaultError):
    pass


class Corrupt(VaultError):
    pass


class TooLarge(VaultError):
    pass


class Rollback(VaultError):
    pass


class Claimed(VaultError):
    """Another writer has the generation."""


#: The wire code of each error.
CODES = {WrongPassword: "WRONG_PASSWORD", NotFound: "NOT_FOUND", InvalidArgument: "INVALID_ARGUMENT", Corrupt: "CRYPTO", TooLarge: "METADATA_TOO_LARGE", Rollback: "CRYPTO", Claimed: "IO", OSError: "IO"}


def error_code(error: BaseException, opening: bool = False) -> int:
    """The wire code; what doesn't authenticate while opening means a wrong password."""
    if opening and isinstance(error, Corrupt):
        return ERRORS["WRONG_PASSWORD"]
    return ERRORS[next((code for kind, code in CODES.items() if isinstance(error, kind)), "INTERNAL")]


SEAL = ("generation", "rows", "stored", "digest", "mac")


def _in_order(chunks: DataFrame) -> DataFrame:
    """Sorted by file and place inside the files that tasks write, so that a read of one file skips most of them."""
    return chunks.sortWithinPartitions("file_id", "chunk_idx")


def _outside(name: Column) -> Column:
    return F.startswith(name, F.lit("/")) | F.array_contains(F.split(F.replace(name, F.lit("\\"), F.lit("/")), "/"), "..")


def _writer(folder: str):
    def write(rows) -> None:
        from itertools import groupby

        for _, group in groupby(rows, key=lambda r: r["file_id"]):
            head = next(group)
            path = os.path.join(folder, head["name"])
            os.makedirs(os.path.dirname(path), exist_ok=True)
            part, n = f"{path}.{uuid.uuid4().hex}.part", 0
            with open(part, "wb") as file:
                for r in group:
                    if r["plain"] is None or r["chunk_idx"] != n:
                        break
                    file.write(r["plain"])
                    n += 1
            if n != head["n"]:
                os.remove(part)
                raise Corrupt(f"chunk {n} of {head['name']}")
            os.replace(part, path)

    return write


@dataclass(frozen=True)
class KdfParams:
    memory_mib: int = 256
    t: int = 4
    p: int = 4

    def describe(self) -> str:
        return f"scrypt, {self.memory_mib} MiB, parallelism {self.p}"

    def derive(self, password: str, salt: bytes) -> bytes:
        if self.memory_mib not in (128, 256, 512):
            raise InvalidArgument("memory is 128, 256 or 512 MiB")
        n = self.memory_mib * 1024 * 1024 // (128 * 8)
        n = 1 << (n.bit_length() - 1)
        return hashlib.scrypt(password.encode(), salt=salt, n=n, r=8, p=max(1, self.p), maxmem=2 * self.memory_mib * 1024 * 1024 + (1 << 20), dklen=32)


class Vault:
    def __init__(self, spark: SparkSession, path: str, master: bytes, generation: int):
        self.spark, self.path, self.generation = spark, path.rstrip("/"), generation
        self._master, self._names, self._content, self._seal_key = master, NameKey(master), ContentKey(master), hkdf(master, b"listing")
        self.auto_compact_ratio: float | None = COMPACT_RATIO

    # --- opening

    @classmethod
    def create(cls, spark: SparkSession, path: str, password: str, params: KdfParams | None = None) -> Vault:
        """A new, empty vault; one that was there is replaced."""
        vault = cls(spark, path, os.urandom(32), FIRST_GENERATION)
        for folder in ("seals", "files", "mirror", "chunks", "claims", "staged", "keys"):
            vault._delete(folder)
        vault._write_key(password, params or KdfParams(), 1)
        empty = spark.createDataFrame([], FILES)
        with vault._claimed(FIRST_GENERATION):
            vault._publish(empty, FIRST_GENERATION, 0)
        return vault

    @classmethod
    def open(cls, spark: SparkSession, path: str, password: str, min_generation: int = FIRST_GENERATION) -> Vault:
        vault = cls(spark, path, bytes(32), 0)
        keys = vault._generations("keys")
        if not keys:
            raise NotFound(path)
        row = spark.read.json(f"{vault.path}/keys/gen={max(keys)}").first()
        kek = KdfParams(row["memory_mib"], row["t"], row["p"]).derive(password, bytes.fromhex(row["salt"]))
        master = spark.range(1).select(F.try_aes_decrypt(F.lit(bytes.fromhex(row["wrapped"])), F.lit(kek), F.lit("GCM"))).first()[0]
        if master is None:
            raise WrongPassword(path)
        generation = max(vault._generations("seals"), default=0)
        if generation < min_generation:
            raise Rollback(f"generation {generation}, expected {min_generation} at least")
        opened = cls(spark, path, bytes(master), generation)
        opened.verify()
        return opened

    def verify(self) -> None:
        """Fails unless the listing is the one that was sealed: its count, its digest and its generation under the vault's key."""
        seal = self._seal()
        found = self._digest(self._rows())
        if any(found[name] != seal[name] for name in ("rows", "digest")):
            raise Corrupt(f"the listing of generation {self.generation} is not the sealed one")

    def change_password(self, password: str, params: KdfParams | None = None) -> None:
        """Wraps the master key anew; contents and generation stay, the old password no longer opens."""
        at = max(self._generations("keys")) + 1
        self._write_key(password, params or KdfParams(), at)
        for old in self._generations("keys"):
            if old < at:
                self._delete(f"keys/gen={old}")

    # --- reading

    def files(self) -> DataFrame:
        """The listing with opened names; a name that doesn't open fails the query."""
        name = self._names.open(F.col("name_enc"), F.lit("name"))
        return self._rows().withColumn("name", F.coalesce(name, F.raise_error(F.lit("a sealed name does not open")).cast("string")))

    def _rows(self) -> DataFrame:
        folder = "files" if self.generation in self._generations("files") else "mirror"
        return self.spark.read.schema(FILES).parquet(f"{self.path}/{folder}/gen={self.generation}")

    def list_file_info(self) -> DataFrame:
        return self.files().select("ordinal", "name", "size", "created_at", "modified_at", layout.storage_used(F.col("size")).alias("storage_used"))

    def size(self, name: str) -> int:
        return self._first(name)["size"]

    def chunks(self, files: DataFrame, wanted: Column | None = None) -> DataFrame:
        """file_id, version, chunk_idx, plain of the files' chunks; a chunk that doesn't open gives null.

        Joined on file and version, which is also the folder, so folders of other versions are pruned; ``wanted`` is a filter on
        file_id, chunk_idx and gen that reaches the scan.
        """
        if not self._generations("chunks"):
            return self.spark.createDataFrame([], "file_id string, version long, chunk_idx long, plain binary")
        stored = self.spark.read.schema(STORED).parquet(f"{self.path}/chunks")
        if wanted is not None:
            stored = stored.where(wanted)
        live = files.select("file_id", F.col("version").alias("gen")).join(stored.where("version = gen"), ["file_id", "gen"])
        return live.select("file_id", "version", "chunk_idx", self._content.open(F.col("sealed"), F.col("file_id"), F.col("chunk_idx"), F.col("version")).alias("plain"))

    def contents(self, files: DataFrame | None = None) -> DataFrame:
        """``name, content`` of files; content is null if a chunk is lost or doesn't open."""
        files = self.files() if files is None else files
        parts = F.array_sort(F.collect_list(F.struct("chunk_idx", "plain")))
        joined = self.chunks(files).groupBy("file_id").agg(F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["plain"])).alias("content"), F.count("plain").alias("n"))
        whole = files.join(joined, "file_id", "left")
        complete = F.coalesce("n", F.lit(0)) == layout.chunk_count(F.col("size"))
        return whole.select("name", F.when(complete, F.coalesce("content", F.lit(b""))).alias("content"))

    def get(self, name: str) -> bytes:
        return b"".join(self.read_windows(name))

    def read_range(self, name: str, offset: int, length: int) -> tuple[bytes, int]:
        """The bytes there, and where they end; only the chunks that overlap are read."""
        f = self._first(name)
        if offset >= f["size"] or length <= 0:
            return b"", min(offset, f["size"])
        end = min(f["size"], offset + length)
        first, last = offset // CHUNK, (end - 1) // CHUNK
        return b"".join(self._pieces(f, first, last))[offset - first * CHUNK : end - first * CHUNK], end

    def read_windows(self, name: str, width: int = 1 << 20, progress: Callable[[int, int], None] | None = None) -> Iterator[bytes]:
        """The file's bytes, ``width`` at a time; progress is told how many of how many there have been.

        One job sorts the chunks, and its partitions come one after the other, so a file of any size passes through.
        """
        f = self._first(name)
        held, done = bytearray(), 0
        for piece in self._pieces(f, 0, -(-f["size"] // CHUNK) - 1):
            held += piece
            while len(held) >= width or done + len(held) == f["size"] and held:
                window = bytes(held[:width])
                del held[:width]
                done += len(window)
                if progress:
                    progress(done, f["size"])
                yield window

    def _pieces(self, f, first: int, last: int) -> Iterator[bytes]:
        """The plain bytes of the chunks of a row of the listing, in order; fails where one is lost or doesn't open."""
        if last < first:
            return
        row = self._rows().where(F.col("file_id") == f["file_id"])
        wanted = (F.col("file_id") == f["file_id"]) & (F.col("gen") == f["version"]) & F.col("chunk_idx").between(first, last)
        expected = first
        for r in self.chunks(row, wanted).orderBy("chunk_idx").toLocalIterator():
            if r["chunk_idx"] != expected or r["plain"] is None:
                break
            yield bytes(r["plain"])
            expected += 1
        if expected != last + 1:
            raise Corrupt(f"chunk {expected} of {f['name']}")

    def extract(self, folder: str, files: DataFrame | None = None) -> None:
        """Writes each of the files (all of them) below a folder that all executors share, under its name.

        A task writes a file's chunks in order to a name of its own and renames it when it is whole, so one that runs again does no harm.
        """
        files = self.files() if files is None else files
        if not files.where(_outside(F.col("name"))).isEmpty():
            raise InvalidArgument("a name leads out of the folder")
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        chunks = self.chunks(files).select("file_id", "chunk_idx", "plain")
        heads = files.select("file_id", F.lit(-1).cast("long").alias("chunk_idx"), F.lit(b"").alias("plain"), "name", layout.chunk_count(F.col("size")).alias("n"))
        rows = heads.unionByName(chunks, allowMissingColumns=True)
        rows.repartition(tasks, "file_id").sortWithinPartitions("file_id", "chunk_idx").foreachPartition(_writer(folder))

    def info(self) -> dict:
        """Figures of the listing; the stored bytes are the seal's, so no chunk is read."""
        size, n = F.col("size"), layout.chunk_count(F.col("size"))
        m = self.files().agg(
            F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("size_bytes"), F.coalesce(F.sum(layout.storage_used(size)), F.lit(0)).alias("live"),
            (F.coalesce(F.sum(layout.manifest_entry_len(F.octet_length("name").cast("long"), n)), F.lit(0)) + 10).alias("manifest"), (F.coalesce(F.sum(layout.store_entry_len(n)), F.lit(0)) + 80).alias("store"),
        ).withColumn("region", layout.region_len(F.col("manifest"), F.col("store"))).first()
        stored = self._seal()["stored"]
        garbage = max(0, stored - m["live"])
        total = HEADER + m["region"] + stored
        mirrored = self.generation in self._generations("mirror")
        return {"generation": self.generation, "files": m["files"], "size_bytes": m["size_bytes"], "garbage_bytes": garbage, "garbage_ratio": garbage / total, "metadata_mirror": mirrored}

    # --- changing

    def add_paths(self, items: DataFrame) -> int:
        """Upsert items(name, content) with an order in ``pos``; returns how many there were, repeated names included.

        Of a repeated name the last wins.  A name that exists keeps its place, id and created_at; an empty name fails.
        """
        return self._add(items, replace=True)

    def append_paths(self, items: DataFrame) -> int:
        """The same as new files at the end, whatever names there are already."""
        return self._add(items, replace=False)

    def _add(self, items: DataFrame, replace: bool) -> int:
        g, now = self.generation + 1, int(time.time())
        with self._claimed(g):
            # Written once and read back, so that the listing and the chunks are of the same items.
            items.select("name", F.col("pos").cast("long").alias("pos"), "content").write.mode("overwrite").parquet(f"{self.path}/staged/gen={g}")
            items = self.spark.read.parquet(f"{self.path}/staged/gen={g}")
            count, bad = items.agg(F.count(F.lit(1)), F.count(F.when(F.coalesce("name", F.lit("")) == "", 1))).first()
            if bad:
                raise InvalidArgument("a stored name is empty")
            if not count:
                self._unclaim(g)
                return 0
            old = self._rows()
            top = old.agg(F.max("ordinal")).first()[0]
            base = -1 if top is None else top
            of_item = F.struct(F.col("content"), F.octet_length("content").cast("long").alias("size"))
            last = items.groupBy("name").agg(F.min("pos").alias("pos"), F.max_by(of_item, "pos").alias("item")) if replace else items.select("name", "pos", of_item.alias("item"))
            new = last.select("name", "pos", F.col("item.content").alias("content"), F.coalesce("item.size", F.lit(0)).cast("long").alias("new_size"), self._names.lookup(F.col("name")).alias("token"))
            firsts = old.groupBy("name_lookup").agg(F.min_by(F.struct("ordinal", "file_id", "created_at"), "ordinal").alias("old"))
            matched = new.join(firsts if replace else firsts.where("false"), F.col("token") == F.col("name_lookup"), "left")
            # Ids follow from the name, the place and the generation, so a task that runs again writes the same.
            rows = matched.select(
                F.coalesce("old.ordinal", F.lit(base + 1) + F.col("pos")).alias("ordinal"), F.coalesce("old.file_id", F.md5(F.concat_ws(":", "token", F.lit(str(g)), F.col("pos").cast("string")))).alias("file_id"),
                self._names.seal(F.col("name"), F.lit("name")).alias("name_enc"), F.col("token").alias("name_lookup"), F.col("new_size").alias("size"),
                F.coalesce("old.created_at", F.lit(now)).cast("long").alias("created_at"), F.lit(now).cast("long").alias("modified_at"), F.lit(g).cast("long").alias("version"), "content",
            )
            self._write_chunks(rows.select("file_id", "version", "size", "content"), g)
            survivors = old.join(rows.select("file_id"), "file_id", "left_anti")
            written = rows.agg(F.coalesce(F.sum(layout.storage_used(F.col("size"))), F.lit(0))).first()[0]
            self._commit(survivors.unionByName(rows.drop("content")), g, self._seal()["stored"] + written)
            self._delete(f"staged/gen={g}")
        self._tidy()
        return count

    def put(self, name: str, content: bytes) -> None:
        self.add_paths(self._item(name, content))

    def append(self, name: str, content: bytes) -> None:
        """A new file at the end, whether or not the name is there."""
        self.append_paths(self._item(name, content))

    def _item(self, name: str, content: bytes) -> DataFrame:
        return self.spark.createDataFrame([(name, 0, bytearray(content))], "name string, pos long, content binary")

    def delete(self, name: str) -> None:
        """All files of the name go."""
        token = self._names.lookup_value(name)
        rows = self._rows()
        if rows.where(F.col("name_lookup") == token).isEmpty():
            raise NotFound(name)
        self._change(rows.where(F.col("name_lookup") != token))

    def rename(self, name: str, new_name: str) -> None:
        """The name's first file gets the new name; whether the new name is taken is not asked."""
        f, now = self._first(name), int(time.time())
        hit = F.col("file_id") == f["file_id"]
        rows = self._rows()
        new = F.lit(new_name)
        changed = {"name_enc": self._names.seal(new, F.lit("name")), "name_lookup": self._names.lookup(new), "modified_at": F.lit(now).cast("long")}
        self._change(rows.select(*(F.when(hit, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in rows.columns)))

    def compact(self) -> None:
        """Live chunks sealed anew for the next generation; what is older goes once that is published."""
        g = self.generation + 1
        with self._claimed(g):
            rows = self._rows()
            plain = F.coalesce("plain", F.raise_error(F.lit("a chunk does not open")).cast("binary"))
            version = F.lit(g).cast("long")
            sealed = self.chunks(rows).select("file_id", version.alias("version"), "chunk_idx", self._content.seal(plain, F.col("file_id"), F.col("chunk_idx"), version).alias("sealed"))
            _in_order(sealed).write.mode("overwrite").parquet(f"{self.path}/chunks/gen={g}")
            live = rows.agg(F.coalesce(F.sum(layout.storage_used(F.col("size"))), F.lit(0))).first()[0]
            self._commit(rows.withColumn("version", version), g, live)
        for folder in ("chunks", "files", "seals", "mirror"):
            for old in self._generations(folder):
                if old < g:
                    self._delete(f"{folder}/gen={old}")

    def remirror(self) -> None:
        self.spark.read.schema(FILES).parquet(f"{self.path}/files/gen={self.generation}").write.mode("overwrite").parquet(f"{self.path}/mirror/gen={self.generation}")

    # --- inside

    def _first_rows(self, name: str) -> DataFrame:
        return self.files().where(F.col("name_lookup") == self._names.lookup_value(name)).orderBy("ordinal").limit(1)

    def _first(self, name: str):
        row = self._first_rows(name).first()
        if row is None:
            raise NotFound(name)
        return row

    def _write_chunks(self, rows: DataFrame, g: int) -> None:
        cut = rows.select("file_id", "version", F.explode(layout.chunk_indices(F.col("size"))).alias("chunk_idx"), "content")
        plain = F.substring(F.col("content"), (F.col("chunk_idx") * CHUNK + 1).cast("int"), F.lit(CHUNK))
        sealed = self._content.seal(plain, F.col("file_id"), F.col("chunk_idx"), F.col("version"))
        _in_order(cut.select("file_id", "version", "chunk_idx", sealed.alias("sealed"))).write.mode("overwrite").parquet(f"{self.path}/chunks/gen={g}")

    def _change(self, rows: DataFrame) -> None:
        """Publish rows as the next generation, which stores no new bytes."""
        g = self.generation + 1
        with self._claimed(g):
            self._commit(rows, g, self._seal()["stored"])
        self._tidy()

    def _tidy(self) -> None:
        if self.auto_compact_ratio is not None and self.info()["garbage_ratio"] > self.auto_compact_ratio:
            self.compact()

    def _commit(self, rows: DataFrame, g: int, stored: int) -> None:
        n = layout.chunk_count(F.col("size"))
        m = rows.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.max(n), F.lit(0)).alias("longest"), F.coalesce(F.sum(layout.manifest_entry_len(F.octet_length("name_enc").cast("long") - OVERHEAD, n) + layout.store_entry_len(n)), F.lit(0)).alias("metadata")).first()
        if m["files"] > MAX_FILES or m["longest"] > MAX_CHUNKS or m["metadata"] > MAX_METADATA:
            raise TooLarge(f"{m['files']} files, {m['longest']} chunks in one, {m['metadata']} bytes of metadata")
        self._publish(rows, g, stored)
        self.generation = g

    def _publish(self, rows: DataFrame, g: int, stored: int) -> None:
        rows.select(*FILES.fieldNames()).write.mode("overwrite").parquet(f"{self.path}/files/gen={g}")
        listing = self.spark.read.schema(FILES).parquet(f"{self.path}/files/gen={g}")
        seal = {"generation": g, "stored": stored} | self._digest(listing)
        seal["mac"] = self._mac_of(seal)
        self.spark.createDataFrame([tuple(seal[c] for c in SEAL)], "generation long, rows long, stored long, digest string, mac string").coalesce(1).write.mode("overwrite").json(f"{self.path}/seals/gen={g}")
        listing.write.mode("overwrite").parquet(f"{self.path}/mirror/gen={g}")

    def _digest(self, rows: DataFrame) -> dict:
        values = [F.hex(c) if c == "name_enc" else F.col(c) for c in FILES.fieldNames()]
        macs = rows.select(row_mac(lambda x: hmac256(self._seal_key, x), *values).alias("mac"))
        return table_digest(macs, "mac").first().asDict()

    def _mac_of(self, seal: dict) -> str:
        return hmac.new(self._seal_key, ":".join(str(seal[c]) for c in SEAL[:-1]).encode(), hashlib.sha512).hexdigest()

    def _seal(self) -> dict:
        """The seal of this generation, if it is the vault's own."""
        row = self.spark.read.json(f"{self.path}/seals/gen={self.generation}").first()
        seal = row.asDict() if row is not None and set(SEAL) <= set(row.asDict()) else dict.fromkeys(SEAL)
        if seal["generation"] != self.generation or not hmac.compare_digest(str(seal["mac"]), self._mac_of(seal)):
            raise Corrupt(f"the seal of generation {self.generation}")
        return seal

    @contextmanager
    def _claimed(self, g: int) -> Iterator[None]:
        """Generation g for this writer alone; a change that fails gives it back, with what it wrote."""
        if g <= max(self._generations("seals"), default=0):
            raise Rollback(f"generation {g} is there already")
        fs, path = self._fs(f"claims/gen={g}")
        fs.mkdirs(path.getParent())
        try:
            out = fs.create(path, False)
            out.write(bytearray(uuid.uuid4().bytes))
            out.close()
        except Py4JJavaError as error:
            if not fs.exists(path):
                raise
            raise Claimed(f"generation {g} has a writer") from error
        if g <= max(self._generations("seals"), default=0):  # published between the look and the claim
            self._unclaim(g)
            raise Rollback(f"generation {g} is there already")
        try:
            yield
        except BaseException:
            if g not in self._generations("seals"):
                for folder in ("files", "chunks", "staged"):
                    self._delete(f"{folder}/gen={g}")
                self._unclaim(g)
            raise

    def _unclaim(self, g: int) -> None:
        self._delete(f"claims/gen={g}")
        self._delete(f"staged/gen={g}")

    def break_claim(self) -> None:
        """Give up the next generation's claim, once its writer is known to be dead."""
        self._unclaim(self.generation + 1)

    def _write_key(self, password: str, params: KdfParams, at: int) -> None:
        salt = os.urandom(32)
        kek = params.derive(password, salt)
        wrapped = self.spark.range(1).select(F.hex(F.aes_encrypt(F.lit(self._master), F.lit(kek), F.lit("GCM")))).first()[0]
        row = [(params.memory_mib, params.t, params.p, salt.hex(), wrapped)]
        self.spark.createDataFrame(row, "memory_mib int, t int, p int, salt string, wrapped string").coalesce(1).write.mode("overwrite").json(f"{self.path}/keys/gen={at}")

    def _fs(self, folder: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), path

    def _generations(self, folder: str) -> list[int]:
        """Those that were written to the end."""
        fs, path = self._fs(folder)
        if not fs.exists(path):
            return []
        names = [s.getPath() for s in fs.listStatus(path)]
        done = [p for p in names if p.getName().startswith("gen=") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName()[4:]) for p in done)

    def _delete(self, folder: str) -> None:
        fs, path = self._fs(folder)
        fs.delete(path, True)
