"""Token ids in Arrow files of equal-length sequences.

Documents are encoded, put in ascending order of their id by a range partitioning,
and each partition writes one Arrow file: record batches of two columns of fixed-size
lists, ``ids`` (uint16 or uint32) and ``mask`` (uint8, 0 on the padding of the last
sequence, else 1). The mask's lists are run-end encoded: those of all ones are stored
once a batch. The files are not compressed, so a memory map gives any sequence and its
mask without a copy. A second small file beside each holds the documents' places.

Special tokens are taken as ordinary text (the library's ``encode_special_tokens``): a
document that spells one, such as an end mark, cannot put a control id into the stream.

A text is encoded by its pre-tokens: byte-level merges never cross them, so each
distinct one is encoded once in a table that a worker's tasks share. The texts are
ordered first and encoded where their file is written, so ids never move. A file gets
its final name when it is complete, so a task that runs again after the loss of an
executor replaces what it has written.

Where Arrow has no access to the folder's file system (viewfs, or HDFS without its native
client) but Spark has, the same files are written and read by Spark: a file's bytes are
then one row, less than 2 GB of them, which ``files`` can see to.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazegrid.llm.common import field, map_arrow, pieces, staged, strings
from hazegrid.llm.token_counts import byte_alphabet
from hazegrid.session import new_path, qualified

SEQUENCE = 2048
BATCH_SEQUENCES = 512
#: Distinct words and pre-tokens a worker keeps (about 200 bytes each).
TABLE_WORDS = 600_000
LONGEST_KEPT = 64
_SIMPLE_ENDS = frozenset(".,;:!?")


class TokenTable:
    """Ids of texts, as bytes, from the ids of their distinct pre-tokens.

    Pre-tokens have at most one space, at their start. A space between two characters
    that are not white space therefore begins a pre-token, and the words between such
    spaces are looked up whole.
    """

    def __init__(self, path: str, pattern: str):
        from tokenizers import Tokenizer

        lib = Tokenizer.from_file(path)
        self.lib, self.tokenize = lib, lib.model.tokenize
        self.find = regex.compile(pattern).findall
        self.words: dict[str, bytes] = {}
        self.tokens: dict[str, bytes] = {}
        self.width = "<u2" if lib.get_vocab_size() <= 1 << 16 else "<u4"
        self.kind = "H" if self.width == "<u2" else "I"
        stand_in = {b: c for c, b in byte_alphabet().items()}
        self.letters = [stand_in[b] for b in range(256)]

    def _encoded(self, stand_ins: str) -> bytes:
        return array(self.kind, [p.id for p in self.tokenize(stand_ins)]).tobytes()

    def _token(self, token: str) -> bytes:
        if (found := self.tokens.get(token)) is None:
            found = self._encoded("".join(map(self.letters.__getitem__, token.encode())))
            if len(token) <= LONGEST_KEPT:
                self.tokens[token] = found
        return found

    def _letters(self, word: str) -> bytes:
        """Ids of letters with a space before them."""
        if (found := self.words.get(word)) is None:
            # ASCII letters stand for themselves in a byte-level vocabulary.
            plain = word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))
            found = self._encoded(self.letters[32] + plain)
            if len(word) <= LONGEST_KEPT:
                self.words[word] = found
        return found

    def _word(self, word: str) -> bytes:
        """Ids of any word with a space before it."""
        if word.isalpha():
            return self._letters(word)
        if word[-1:] in _SIMPLE_ENDS and word[:-1].isalpha():
            return self._letters(word[:-1]) + self._token(word[-1])
        return b"".join([self._token(t) for t in self.find(" " + word)])

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if len(self.words) + len(self.tokens) > TABLE_WORDS:
            self.words.clear()
            self.tokens.clear()
        first, *rest = text.split(" ")
        if not rest or first[-1:].isspace():
            return self._plain(text)
        last = rest.pop()
        words = self.words
        out = list(map(words.get, rest))
        if None in out:
            for i, found in enumerate(out):
                if found is None:
                    w = rest[i]
                    if not w or w[0].isspace() or w[-1].isspace():
                        return self._plain(text)  # a space beside other white space
                    out[i] = found = self._word(w)
                    if len(w) <= LONGEST_KEPT:
                        words[w] = found
        if last[:1].isspace():
            return self._plain(text)
        return b"".join([self._plain(first), *out, self._plain(" " + last)])

    def _plain(self, text: str) -> bytes:
        return b"".join([self._token(t) for t in self.find(text)])


@lru_cache(2)
def token_table(path: str, pattern: str) -> TokenTable:
    return TokenTable(path, pattern)


def _open(uri: str):
    """File system and path of a full URI, by Arrow's own names for the schemes that Hadoop names otherwise."""
    from pyarrow import fs

    scheme, _, path = uri.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + path.lstrip("/")
    return fs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}:{path}")


#: Hadoop's names of file systems that Arrow names otherwise.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "wasbs": "abfs"}


def _reached(uri: str) -> bool:
    """Whether Arrow has access to a URI's file system."""
    try:
        system, path = _open(uri)
        system.get_file_info(path)
    except (OSError, ValueError, NotImplementedError):
        return False
    return True


#: A part's files: its sequences, and the places of its documents.
KINDS = ("arrow", "docs")
#: What Arrow files end with. Spark's writer of text puts it behind each row.
_MAGIC = "ARROW1"


class _Sequences:
    """Writes ids one after the other as sequences of one length."""

    def __init__(self, sink, width: str, length: int):
        kind = pa.uint16() if width == "<u2" else pa.uint32()
        self.width, self.length, self.kind = width, length, kind
        masks = pa.run_end_encoded(pa.int32(), pa.list_(pa.uint8(), length))
        self.schema = pa.schema([("ids", pa.list_(kind, length)), ("mask", masks)])
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.parts, self.held = [], 0

    def add(self, ids: np.ndarray) -> None:
        self.parts.append(ids)
        self.held += len(ids)
        if self.held >= self.length * BATCH_SEQUENCES:
            self._write(self.held // self.length * self.length)

    def _write(self, n: int, used: int | None = None) -> None:
        flat = np.concatenate(self.parts) if self.parts else np.empty(0, self.width)
        rest, flat = flat[n:], flat[:n]
        self.parts, self.held = [rest], len(rest)
        full = (n if used is None else used) // self.length
        ends = sorted({full, n // self.length} - {0})
        # One list for the full sequences, one for the padded one.
        mask = np.ones(len(ends) * self.length, np.uint8)
        if used is not None and used < n:
            mask[used - n :] = 0
        masks = pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)
        columns = [
            pa.FixedSizeListArray.from_arrays(pa.array(flat, self.kind), self.length),
            pa.RunEndEncodedArray.from_arrays(pa.array(ends, pa.int32()), masks),
        ]
        self.writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        if self.held:
            used, pad = self.held, -self.held % self.length
            self.parts.append(np.zeros(pad, self.width))
            self._write(used + pad, used)
        self.writer.close()


def write_token_files(
    docs: DataFrame,
    tokenizer: str,
    pattern: str,
    id: str = "doc_id",
    text: str = "text",
    end: int = 0,
    length: int = SEQUENCE,
    folder: str | None = None,
    files: int | None = None,
) -> DataFrame:
    """Write the files; returns their manifest: ``file``, ``part``, ``n_docs``, ``n_ids``, ``first_id``.

    ``folder`` is a URI, or a path of Hadoop's default file system, that all executors
    reach; by default one below the session's shared folder. There are ``files`` files,
    or as many as the session has shuffle partitions. A null or empty text is the end id
    alone. Null ids come first; documents of one id stand in any order beside each other,
    each of them once. An empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    folder = qualified(spark, folder) if folder else qualified(spark, new_path(spark, "token-files"), shared=True)
    files = files or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Beside the id, a hash keeps many documents of one id from meeting in one file.
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange(files, "id", F.xxhash64("text")).sortWithinPartitions("id")
    id_type = docs.schema[id].dataType
    manifest = T.StructType(
        [field("file", "string"), field("part", "int"), field("n_docs", "bigint"), field("n_ids", "bigint"),
         T.StructField("first_id", id_type)]
    )

    def encoded(batches, sink_of: Callable[[str], object]):
        """Write a part's files; their documents, ids and first id, or None without documents."""
        table = token_table(tokenizer, pattern)
        width = table.width
        last = np.array([end], width).tobytes()
        sequences, places, at, n_docs, first = None, None, 0, 0, None
        for batch in batches:
            for rows in pieces(batch):
                if sequences is None:
                    sinks = [sink_of(kind) for kind in KINDS]
                    sequences = _Sequences(sinks[0], width, length)
                    place_schema = pa.schema([("id", rows.schema.field(0).type), ("start", pa.int64()), ("n", pa.int64())])
                    places = pa.ipc.new_file(sinks[1], place_schema)
                    first = rows.column(0)[0]
                starts, counts = [], []
                for value in strings(rows, "text"):
                    ids = np.frombuffer(table.ids(value) + last, width)
                    starts.append(at)
                    counts.append(len(ids))
                    at += len(ids)
                    sequences.add(ids)
                n_docs += rows.num_rows
                columns = [rows.column(0), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())]
                places.write_batch(pa.RecordBatch.from_arrays(columns, schema=place_schema))
        if sequences is None:
            return None
        for writer in (sequences, places):
            writer.close()
        for s in sinks:
            s.close()
        return n_docs, at, first.as_py()

    def run(batches):
        import uuid

        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        system, base = _open(folder)
        system.create_dir(base, recursive=True)
        own = f"{base}/.{part}-{uuid.uuid4().hex}"
        made = encoded(batches, lambda kind: system.open_output_stream(f"{own}.{kind}"))
        if made is None:
            return
        for kind in KINDS:
            system.move(f"{own}.{kind}", f"{base}/part-{part:06d}.{kind}")
        yield _row(manifest, [f"{folder}/part-{part:06d}", part, *made])

    if _reached(folder):
        return staged(map_arrow(ordered, run, manifest), "token-manifest")

    def run_to_rows(batches):
        from pyspark import TaskContext

        sinks: dict[str, pa.BufferOutputStream] = {}
        if encoded(batches, lambda kind: sinks.setdefault(kind, pa.BufferOutputStream())) is None:
            return
        for kind in KINDS:
            content = sinks.pop(kind).getvalue()
            yield _row(contents, [kind, TaskContext.get().partitionId(), content[: len(content) - len(_MAGIC)].to_pybytes()])

    contents = T.StructType([field("kind", "string"), field("part", "int"), field("value", "binary")])
    parts = map_arrow(ordered, run_to_rows, contents).withColumn("value", F.col("value").cast("string"))
    return _written_by_spark(parts, folder, manifest)


def _row(schema: T.StructType, values: list) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(values, target, strict=True)], schema=target)


def _written_by_spark(parts: DataFrame, folder: str, manifest: T.StructType) -> DataFrame:
    """Write the files' bytes (``kind``, ``part``, ``value``) to a file system that only Spark has access to."""
    import uuid

    spark = parts.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    own = f"{folder}/.{uuid.uuid4().hex}"
    parts.write.option("lineSep", _MAGIC).option("compression", "none").partitionBy("kind", "part").text(own)
    system = hadoop.Path(own).getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(hadoop.Path(f"{own}/kind=docs")):
        system.delete(hadoop.Path(own), True)
        return spark.createDataFrame([], manifest)

    def run(batches):
        for batch in batches:
            for part, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                places = pa.ipc.open_file(content.as_buffer()).read_all()
                n_ids, first = int(places["n"].to_numpy().sum()), places["id"][0].as_py()
                yield _row(manifest, [f"{folder}/part-{part:06d}", part, len(places), n_ids, first])

    docs = spark.read.format("binaryFile").load(f"{own}/kind=docs").select(F.col("part").cast("int"), "content")
    found = staged(map_arrow(docs, run, manifest), "token-manifest")
    for kind in KINDS:
        for at in system.listStatus(hadoop.Path(f"{own}/kind={kind}")):
            part = int(at.getPath().getName().partition("=")[2])
            to = hadoop.Path(f"{folder}/part-{part:06d}.{kind}")
            system.delete(to, False)  # of an earlier run
            if not system.rename(system.listStatus(at.getPath())[0].getPath(), to):
                raise OSError(f"{to} could not be written")
    system.delete(hadoop.Path(own), True)
    return found


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document, read back from the files: ``id``, ``start``, ``n_tokens`` and ``ids_crc32``.

    ``start`` counts the ids of all documents before it; ``ids_crc32`` is taken over
    the ids as little-endian 32-bit integers. Files are read by memory map where they
    are local, one task each.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files = manifest.withColumn("offset", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    n_files = max(1, manifest.count())
    schema = T.StructType(
        [T.StructField("id", manifest.schema["first_id"].dataType), field("start", "bigint"),
         field("n_tokens", "bigint"), field("ids_crc32", "bigint")]
    )

    def documents(sequences: SequenceFile, offset: int):
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for places in sequences.documents():
            starts = places.column(1).to_numpy()
            counts = places.column(2).to_numpy()
            sums = [
                zlib.crc32(sequences.ids(int(s), int(n)).astype("<u4").tobytes())
                for s, n in zip(starts, counts, strict=True)
            ]
            columns = [
                places.column(0).cast(target.field(0).type), pa.array(starts + offset),
                pa.array(counts), pa.array(sums, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=target)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                with SequenceFile(row["file"]) as sequences:
                    yield from documents(sequences, row["offset"])

    def run_on_rows(batches):
        held = {}  # a part's files stand beside each other
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                held[row["kind"].as_py()] = row["content"].as_buffer()
                if row["kind"].as_py() == KINDS[-1]:
                    with SequenceFile(row["file"].as_py(), held) as sequences:
                        yield from documents(sequences, row["offset"].as_py())
                    held = {}

    some = manifest.select("file").first()
    if some is None or _reached(some.file):
        # A number of its own keeps adaptive execution from reading all files in one task.
        return map_arrow(files.select("file", "offset", "part").repartitionByRange(n_files, "part"), run, schema)
    folders = [r.folder for r in manifest.select(F.regexp_extract("file", "^(.*)/", 1).alias("folder")).distinct().collect()]
    stored = manifest.sparkSession.read.format("binaryFile").option("pathGlobFilter", f"part-*.{{{','.join(KINDS)}}}").load(folders)
    name, kind = (F.regexp_extract("path", r"^(.*)\.(\w+)$", i) for i in (1, 2))
    stored = stored.select(name.alias("file"), kind.alias("kind"), "content")
    met = stored.join(F.broadcast(files.select("file", "offset")), "file").repartition(n_files, "file")
    return map_arrow(met.sortWithinPartitions("file", "kind"), run_on_rows, schema)


class SequenceFile:
    """Random access to one file: sequences and masks by number, ids by place.

    ``contents`` has the bytes of its two files where Arrow cannot open them.
    """

    def __init__(self, file: str, contents: dict[str, pa.Buffer] | None = None):
        if contents is None:
            system, path = _open(file)
            local = system.type_name == "local"
            self._source = pa.memory_map(f"{path}.arrow") if local else system.open_input_file(f"{path}.arrow")
            self._places = lambda: system.open_input_file(f"{path}.docs")
        else:
            local = True
            self._source = pa.BufferReader(contents["arrow"])
            self._places = lambda: pa.BufferReader(contents["docs"])
        reader = pa.ipc.open_file(self._source)
        self.length = reader.schema.field("ids").type.list_size
        self._batches = [reader.get_batch(i) for i in range(reader.num_record_batches)] if local else None
        self._reader = reader
        sizes = [self._batch(i).num_rows for i in range(reader.num_record_batches)]
        self._bounds = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        self._last: tuple[int, pa.RecordBatch] | None = None

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self._batches = self._last = self._reader = None
        self._source.close()

    def __len__(self) -> int:
        return int(self._bounds[-1])

    def _batch(self, i: int) -> pa.RecordBatch:
        if self._batches is not None:
            return self._batches[i]
        if getattr(self, "_last", None) is None or self._last[0] != i:
            self._last = i, self._reader.get_batch(i)
        return self._last[1]

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence ``i``, both views of the file."""
        at = int(np.searchsorted(self._bounds, i, "right")) - 1
        batch, k = self._batch(at), i - int(self._bounds[at])
        ids, mask = batch.column(0), batch.column(1)
        run = int(np.searchsorted(mask.run_ends.to_numpy(), k, "right"))
        own, shared = (slice(j * self.length, (j + 1) * self.length) for j in (k, run))
        return ids.values.to_numpy()[own], mask.values.values.to_numpy()[shared]

    def ids(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from ``start`` on, counted from the file's first."""
        out, per = [], self.length
        while n > 0:
            at = int(np.searchsorted(self._bounds * per, start, "right")) - 1
            values = self._batch(at).column(0).values.to_numpy()
            local = start - int(self._bounds[at]) * per
            some = values[local : local + n]
            out.append(some)
            start, n = start + len(some), n - len(some)
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.empty(0, np.uint16)

    def documents(self):
        """Batches of ``id``, ``start``, ``n``."""
        with self._places() as f:
            reader = pa.ipc.open_file(f)
            for i in range(reader.num_record_batches):
                yield reader.get_batch(i)
