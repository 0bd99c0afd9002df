"""Token ids in Arrow stream files of fixed-size-list batches.

A file holds sequences of ``LENGTH`` ids, two bytes each if the vocabulary allows,
with a bit mask of the same length.  Every
record batch but the last has ``ROWS`` sequences, and the values lie in one flat
buffer, so the token at any place of a memory-mapped file is found by arithmetic.
A second stream file next to it lists the documents.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint_folder, materialised
from .common import slices

LENGTH = 2048
ROWS = 256
END_ID = 2
CACHE_WORDS = 1_200_000

# pieces of the tokenizer's own pattern over lower-case Latin text
_PIECE = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ƿǀ-ɏ]+|[0-9²³¹¼½¾]|[^\\sa-z0-9ªµºß-öø-ƿǀ-ɏ²³¹¼½¾]+"
)
_OTHER = re.compile("[^\\x00-\\xff]|[\\x1c-\\x1f]|<\\|")


class WordEncoder:
    """Encode texts with a word-end BPE tokenizer, each distinct word once.

    The tokenizer cuts a text into pieces that it encodes one by one, so the ids
    of a text are those of its pieces in a row.  Texts outside Latin-1, and those
    with a special token's string, go to the tokenizer as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        size = max([*vocabulary.values(), *self.tokenizer.get_added_tokens_decoder()]) + 1
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.ends = np.zeros(size, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        # the same model for pieces that are cut and spelt in its byte letters already
        self.pieces = Tokenizer.from_file(path)
        self.pieces.normalizer = normalizers.Sequence([])
        self.pieces.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.letters = {c: spell(chr(c))[0][0] for c in range(256) if not chr(c).isspace()}
        self.known: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        for k in range(0, len(words), 2000):
            part = words[k:k + 2000]
            spelt = [w.translate(self.letters) for w in part]
            ids = np.array(self.pieces.encode(spelt, is_pretokenized=True, add_special_tokens=False).ids, self.dtype)
            raw, width = ids.tobytes(), self.dtype.itemsize
            cuts = ((np.flatnonzero(self.ends[ids]) + 1) * width).tolist()
            if len(cuts) != len(part):
                raise ValueError("the tokenizer does not end every piece with a word end")
            for word, a, b in zip(part, [0, *cuts], cuts):
                self.known[word] = raw[a:b]

    def _found(self, texts: list[str]) -> list[list[bytes] | None]:
        """Ids of the pieces of each text; None for a text that goes as a whole."""
        cut = [None if _OTHER.search(t) else _PIECE.findall(t.lower()) for t in texts]
        find = self.known.get
        out = [None if pieces is None else list(map(find, pieces)) for pieces in cut]
        again = [i for i, found in enumerate(out) if found is not None and None in found]
        if again:
            missing = {p for i in again for p, found in zip(cut[i], out[i]) if found is None}
            if len(self.known) + len(missing) > CACHE_WORDS:
                self.known.clear()
                missing = {p for i in again for p in cut[i]}
            self._learn(sorted(missing))
            for i in again:
                out[i] = list(map(find, cut[i]))
        return out

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        return [
            self._whole(text) if found is None else np.frombuffer(b"".join(found), self.dtype)
            for text, found in zip(texts, self._found(texts))
        ]

    def lengths(self, texts: list[str]) -> list[int]:
        """Number of ids of each text."""
        width = self.dtype.itemsize
        return [
            len(self._whole(text)) if found is None else sum(map(len, found)) // width
            for text, found in zip(texts, self._found(texts))
        ]


@lru_cache(maxsize=1)
def encoder_of(path: str) -> WordEncoder:
    """The encoder of a Python worker, which keeps its words from task to task."""
    return WordEncoder(path)


def token_lengths(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Input columns with ``length``, the number of token ids of ``text`` (null: 0)."""
    plain = docs.drop("length")

    def run(batches):
        encoder = encoder_of(tokenizer)
        for batch, texts in slices(batches, 2_000_000):
            n = encoder.lengths(texts)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(n, pa.int64())], names=[*batch.schema.names, "length"]
            )

    schema = plain.withColumn("length", F.lit(0).cast("bigint")).schema
    return plain.mapInArrow(run, schema)


class _SequenceWriter:
    """Fill fixed-size lists with token ids and write them batch by batch."""

    def __init__(self, fs, path: str, length: int, rows: int, dtype: np.dtype):
        self.length, self.rows, self.dtype = length, rows, dtype
        self.schema = pa.schema([
            ("tokens", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length)),
        ])
        self.sink = fs.open_output_stream(path)
        self.writer = pa.ipc.new_stream(self.sink, self.schema)
        self.parts: list[np.ndarray] = []
        self.held = self.written = 0

    def add(self, ids: np.ndarray) -> None:
        self.parts.append(ids)
        self.held += len(ids)
        size = self.length * self.rows
        if self.held >= size:
            flat = np.concatenate(self.parts)
            full = len(flat) // size * size
            for at in range(0, full, size):
                self._write(flat[at:at + size], size)
            self.parts, self.held = [flat[full:]], len(flat) - full

    def _write(self, ids: np.ndarray, size: int) -> None:
        tokens = np.zeros(size, self.dtype)
        tokens[: len(ids)] = ids
        mask = pa.array(np.arange(size) < len(ids))
        self.writer.write_batch(pa.RecordBatch.from_arrays(
            [pa.FixedSizeListArray.from_arrays(tokens, self.length), pa.FixedSizeListArray.from_arrays(mask, self.length)],
            schema=self.schema,
        ))
        self.written += len(ids)

    def close(self) -> int:
        if self.held:
            self._write(np.concatenate(self.parts), -(-self.held // self.length) * self.length)
        self.writer.close()
        self.sink.close()
        return self.written


def _filesystem(folder: str):
    return pafs.FileSystem.from_uri(folder if "://" in folder else re.sub("^file:/*", "file:///", "file:" * (folder[:5] != "file:") + folder))


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str, *, end_id: int = END_ID, length: int = LENGTH, rows: int = ROWS
) -> DataFrame:
    """Write token files in ascending doc_id order; returns their manifest.

    Manifest: part, tokens, documents and the two paths, one row per file.  Rows
    are range-partitioned by doc_id (nulls first; ties and repeated rows go by the
    hash of the text).  Null texts count as empty and give the end id alone.  A
    task writes under a name of its own attempt and renames at the end, so that a
    rerun replaces its file.
    """
    order = ["doc_id", "__h"]
    sorted_docs = (
        docs.select("doc_id", "text").withColumn("__h", F.xxhash64("text"))
        .repartitionByRange(*order).sortWithinPartitions(*order).drop("__h")
    )
    id_type = pa.int64()

    def run(batches):
        fs, root = _filesystem(folder)
        fs.create_dir(root, recursive=True)
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        final = [f"{root}/{kind}-{part:06d}.arrows" for kind in ("tokens", "documents")]
        temporary = [f"{f}.{attempt}" for f in final]
        encoder = encoder_of(tokenizer)
        writer = _SequenceWriter(fs, temporary[0], length, rows, encoder.dtype)
        end = np.array([end_id], encoder.dtype)
        index = fs.open_output_stream(temporary[1])
        schema = pa.schema([("doc_id", id_type), ("start", pa.int64()), ("n_tokens", pa.int64())])
        entries = pa.ipc.new_stream(index, schema)
        start = documents = 0
        for batch, texts in slices(batches, 2_000_000):
            sizes = []
            for ids in encoder.encode(texts):
                sizes.append(len(ids) + 1)
                writer.add(np.concatenate((ids, end)))
            starts = start + np.cumsum(sizes) - sizes
            entries.write_batch(pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(id_type), pa.array(starts), pa.array(sizes, pa.int64())], schema=schema
            ))
            start += sum(sizes)
            documents += len(texts)
        tokens = writer.close()
        entries.close()
        index.close()
        for a, b in zip(temporary, final):
            fs.move(a, b)
        if documents:
            yield pa.RecordBatch.from_arrays(
                [pa.array([part]), pa.array([tokens]), pa.array([documents]), pa.array([final[0]]), pa.array([final[1]])],
                ["part", "tokens", "documents", "token_path", "document_path"],
            )

    return materialised(sorted_docs.mapInArrow(
        run, "part bigint, tokens bigint, documents bigint, token_path string, document_path string"
    ))


class TokenFile:
    """Random access to one token file; a local file is mapped, not read."""

    def __init__(self, fs, path: str):
        local = isinstance(fs, pafs.LocalFileSystem)
        self.source = pa.memory_map(path) if local else fs.open_input_file(path)
        self.batches = list(pa.ipc.open_stream(self.source))
        first = self.batches[0].column("tokens") if self.batches else None
        self.span = len(first) * first.type.list_size if self.batches else 1
        self.values = [b.column("tokens").values.to_numpy() for b in self.batches]

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids of the places start .. stop; within one batch a view of the buffer."""
        a, b = start // self.span, max(start, stop - 1) // self.span
        parts = [
            self.values[k][max(start - k * self.span, 0): min(stop - k * self.span, self.span)] for k in range(a, b + 1)
        ]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the files.

    ``start`` counts the ids of all documents before it.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    files = manifest.withColumn("offset", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    spread = files.select("offset", "token_path", "document_path").repartition(
        max(1, manifest.sparkSession.sparkContext.defaultParallelism), "token_path"
    )

    def run(batches: Iterator[pa.RecordBatch]):
        fs, _ = _filesystem(folder)
        for batch in batches:
            for row in batch.to_pylist():
                tokens = TokenFile(fs, row["token_path"])
                with fs.open_input_stream(row["document_path"]) as source:
                    for entries in pa.ipc.open_stream(source):
                        start = entries.column("start").to_numpy()
                        n = entries.column("n_tokens").to_numpy()
                        crc = [zlib.crc32(tokens.read(a, a + k).astype("<u4", copy=False)) for a, k in zip(start, n)]
                        yield pa.RecordBatch.from_arrays(
                            [entries.column("doc_id"), pa.array(start + row["offset"]), entries.column("n_tokens"),
                             pa.array(crc, pa.int64())],
                            ["doc_id", "start", "n_tokens", "ids_crc32"],
                        )

    return spread.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_folder(spark: SparkSession) -> str:
    """A new folder for token files in the shared folder of the cluster."""
    return f"{checkpoint_folder(spark)}/tokens-{uuid.uuid4().hex}"
