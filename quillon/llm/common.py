"""What the operators of this subpackage share: tables, the shared folder, words and tokens."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A word is a run of bytes that are not ASCII white space; `bytes.split()` splits at exactly these.
WORD = r"[^\x20\x09-\x0D]+"
#: Text that is encoded at once.
RUN_BYTES = 10 << 20
#: Bytes of an Arrow batch.
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only where that is unset and Spark is local, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_folders: dict[tuple[str, str], str] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's own folder of the shared one, which goes when the driver's JVM ends."""
    key = spark.sparkContext.applicationId, shared_folder(spark)
    if key not in _folders:
        _folders[key] = f"{key[1]}/quillon-{key[0]}-{uuid.uuid4().hex[:8]}"
        path = spark._jvm.org.apache.hadoop.fs.Path(_folders[key])
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(path)
        system.deleteOnExit(path)
    return f"{_folders[key]}/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches that go to Python workers hold so many bytes, not only so many rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends there and lost executors recompute nothing before it."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def as_bytes(column: pa.Array) -> list[bytes]:
    """Whole texts as UTF-8; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def pieces_of(batch: pa.RecordBatch, max_bytes: int = 16 << 20):
    """The batch in runs of rows with about max_bytes of text each, so that working memory follows the run, not the batch."""
    yield from _halves(batch, max_bytes)
    freed()


def _halves(batch: pa.RecordBatch, max_bytes: int):
    column = batch.column("text")
    if column.nbytes <= max_bytes or batch.num_rows <= 1:
        yield batch
        return
    half = batch.num_rows // 2
    for part in (batch.slice(0, half), batch.slice(half)):
        # nbytes of a slice counts only what the slice uses
        yield from _halves(part, max_bytes)


def word_hashes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, one after the other, and the number of each text's words; null counts as empty.

    Each distinct word of the run is hashed once. lower: A-Z count as a-z.
    """
    texts = texts.cast(pa.string()).fill_null("")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    words, offsets = lists.flatten(), np.asarray(lists.offsets).astype(np.int64)
    real = pc.greater(pc.binary_length(words), 0)
    count = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    coded = words.filter(real).dictionary_encode()
    distinct = coded.dictionary.cast(pa.binary()).to_pylist()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))
    return hashes[np.asarray(coded.indices)], np.diff(count[offsets - offsets[0]])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(words: np.ndarray, width: int, seed: int) -> np.ndarray:
    """Hashes of all runs of `width` consecutive word hashes (multilinear with odd random factors, then mixed)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factors = np.random.default_rng(seed).integers(0, 2**63, width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    total = np.full(n, np.uint64(seed * 2 + 1))
    for k in range(width):
        total += words[k : k + n] * factors[k]
    return mix(total)


#: White space that makes a text go through the library whole: anything but single spaces and newlines between visible characters.
ODD = r"\A[ \n]|[ \n]\z|[ \n][ \n]|[\x00\t\x0B-\x0D\x1C-\x1F\x{85}\x{A0}\x{1680}\x{180E}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Letters of long-settled scripts (Latin, Greek, Cyrillic, Han) and signs of ASCII: a run of the first and a run of the second after it are two pre-tokens.
LETTERS = r"A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}\x{3B1}-\x{3C9}\x{410}-\x{44F}\x{4E00}-\x{9FA5}"
SIGNS = r"!-/:-@\[-`{-~"


class Tokens:
    """Token ids of whole texts by the tokenizers library, by Arrow batch.

    For a byte-level pre-tokenizer: it never joins a visible character with the white space after it, so a text's ids are
    the ids of its pieces " word" and "\\nword" one after the other; nor a letter with the signs after it, so a word and its
    signs are two units. A batch is split and its units numbered by Arrow; the library encodes each distinct unit
    once (many in one call, a newline between them), and numpy gathers the ids of the texts. Units of earlier batches are remembered up to UNITS of
    them and UNIT_BYTES of text, in Arrow arrays. A text in which white space is anything else than single spaces and newlines between visible
    characters goes through the library whole, and so do all texts of other tokenizers. An added token that a text holds literally is that token, as
    the library has it by default (such texts go through it whole); with added=False it is text like any other.
    """

    UNITS = 500_000
    UNIT_BYTES = 8 << 20
    CALL = 1000

    def __init__(self, path: str, added: bool = True):
        import json

        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = not added
        self.dtype = np.uint32 if self.library.get_vocab_size() > 1 << 16 else np.uint16
        said = json.loads(self.library.to_str())
        kind = said.get("pre_tokenizer") or {}
        self.added = [t["content"] for t in said.get("added_tokens") or [] if added or not t["special"]]
        self.split = kind.get("type") == "ByteLevel" and kind.get("use_regex") and not kind.get("add_prefix_space") and said.get("normalizer") is None and said["model"]["type"] == "BPE"
        line = self._whole("\n")
        self.line = line[0] if len(line) == 1 else None
        self.split = self.split and self.line is not None
        self.units, self.starts, self.ids = pa.array([], pa.string()), np.zeros(1, np.int64), np.zeros(0, self.dtype)

    def _whole(self, text: str) -> np.ndarray:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, self.dtype)

    def _encoded(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ids of units (none empty, no newlines in them), by the library."""
        words = units.to_pylist()
        found = [np.zeros(0, self.dtype)]
        for a in range(0, len(words), self.CALL * 16):
            runs = ["\n".join(words[i : i + self.CALL]) + "\n" for i in range(a, min(a + self.CALL * 16, len(words)), self.CALL)]
            found += [np.asarray(e.ids, self.dtype) for e in self.library.encode_batch_fast(runs, add_special_tokens=False)]
        flat = np.concatenate(found)
        ends = np.flatnonzero(flat == self.line)
        starts = np.concatenate([[0], ends - np.arange(len(ends))])
        return starts, np.delete(flat, ends)

    def _known(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First id, number of ids, and the ids, of distinct units."""
        place = pc.index_in(units, value_set=self.units) if len(self.units) else pa.nulls(len(units), pa.int32())
        new = units.filter(place.is_null())
        starts, ids = self._encoded(new)
        room = min(len(new), self.UNITS - len(self.units)) if self.units.nbytes < self.UNIT_BYTES else 0
        base = len(self.ids)
        lengths_old, lengths_new = np.diff(self.starts), np.diff(starts)
        at = place.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        at[at < 0] = len(lengths_old) + np.arange(len(new))
        first = np.concatenate([self.starts[:-1], base + starts[:-1]])[at]
        length = np.concatenate([lengths_old, lengths_new])[at]
        both = np.concatenate([self.ids, ids])
        if room > 0:
            self.units = pa.concat_arrays([self.units, new.slice(0, room)])
            self.starts = np.concatenate([self.starts, base + starts[1 : room + 1]])
            self.ids = both[: self.starts[-1]].copy()
        return first, length, both

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As _known, of distinct words: "\x00" marks a text's first word, "\n" a line's; other words have had a space before them."""
        parts = pc.extract_regex(words, f"\\A(?P<lead>[\\x00\\n]?)(?P<bare>[{LETTERS}]+)(?P<tail>[{SIGNS}]*)\\z")
        simple = parts.is_valid()
        lead = pc.starts_with(words, "\n")
        spaced = pc.invert(pc.or_(lead, pc.starts_with(words, "\x00")))
        bare = pc.if_else(simple, pc.struct_field(parts, "bare"), pc.if_else(spaced, words, pc.utf8_slice_codeunits(words, 1)))
        units = pc.if_else(spaced, pc.binary_join_element_wise(" ", bare, ""), bare)
        tails = pc.struct_field(parts, "tail")
        tails = pc.if_else(pc.equal(pc.binary_length(tails), 0), None, tails)
        coded = pa.concat_arrays([units, tails]).dictionary_encode()
        first, length, ids = self._known(coded.dictionary)
        # after the units: a newline, and nothing
        n, line, nothing = len(words), len(first), len(first) + 1
        first, length, ids = np.append(first, [len(ids), 0]), np.append(length, [1, 0]), np.append(ids, self.dtype(self.line))
        index = coded.indices.fill_null(nothing).to_numpy(zero_copy_only=False)
        three = np.empty((n, 3), np.int64)
        three[:, 0] = np.where(lead.to_numpy(zero_copy_only=False), line, nothing)
        three[:, 1], three[:, 2] = index[:n], index[n:]
        flat, _ = gathered(first, length, ids, three.reshape(-1))
        sizes = length[three].sum(1)
        return np.cumsum(sizes) - sizes, sizes, flat

    def flat(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of all texts, one after the other; null counts as empty; with end, each is followed by it."""
        texts = texts.cast(pa.string()).fill_null("")
        n = len(texts)
        empty = pc.equal(pc.binary_length(texts), 0)
        odd = pc.match_substring_regex(texts, ODD) if self.split else pa.array(np.ones(n, bool))
        for token in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, token))
        odd = pc.and_(odd, pc.invert(empty))
        plain = pc.invert(pc.or_(odd, empty))
        counts, ids = np.zeros(n, np.int64), np.zeros(0, self.dtype)
        if pc.any(plain).as_py():
            lists = pc.split_pattern(pc.binary_join_element_wise("\x00", pc.replace_substring(texts.filter(plain), "\n", " \n"), ""), " ")
            coded = lists.flatten().dictionary_encode()
            first, length, known = self._words(coded.dictionary)
            index = np.asarray(coded.indices)
            ids, sizes = gathered(first, length, known, index)
            offsets = np.asarray(lists.offsets).astype(np.int64)
            counts[plain.to_numpy(zero_copy_only=False)] = np.add.reduceat(sizes, offsets[:-1] - offsets[0])
        whole = {int(i): self._whole(texts[int(i)].as_py()) for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False))}
        for i, x in whole.items():
            counts[i] = len(x)
        if whole or end is not None:
            sizes = counts + (end is not None)
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            out = np.full(offsets[-1], 0 if end is None else end, self.dtype)
            kept = np.ones(len(out), bool)
            if end is not None:
                kept[offsets[1:] - 1] = False
            for i, x in whole.items():
                out[offsets[i] : offsets[i] + len(x)] = x
                kept[offsets[i] : offsets[i] + len(x)] = False
            out[kept] = ids
            return offsets, out
        return np.concatenate([[0], np.cumsum(counts)]), ids

    def of(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; null counts as empty."""
        offsets, ids = self.flat(pa.array(texts, pa.string()))
        return [ids[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def gathered(first: np.ndarray, length: np.ndarray, values: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[first[i] : first[i] + length[i]] for each i of index, one after the other, and their lengths."""
    sizes = length[index]
    ends = np.cumsum(sizes)
    small = np.int32 if len(values) < 1 << 31 and (not len(ends) or ends[-1] < 1 << 31) else np.int64
    place = np.repeat((first[index] - (ends - sizes)).astype(small), sizes)
    place += np.arange(len(place), dtype=small)
    return values[place], sizes


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_tokens: dict[tuple[str, bool], Tokens] = {}
_owner: list[str] = [""]
_cleared: list[dict] = [_tokens]


def freed() -> None:
    """What Arrow and the C library hold but don't use goes back to the system; workers outlive tasks, stages and operators."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:
        pass


def claim(name: str, caches: dict | None = None) -> None:
    """Called where an operator begins in a Python worker: what other operators remembered there goes.

    Workers outlive tasks and stages; without this, the caches of all operators of a job would add up.
    """
    if caches is not None and not any(c is caches for c in _cleared):
        _cleared.append(caches)
    if _owner[0] != name:
        _owner[0] = name
        for c in _cleared:
            c.clear()
        freed()


def tokens(path: str, added: bool = True) -> Tokens:
    """One encoder for a Python worker."""
    claim("tokens")
    if (path, added) not in _tokens:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _tokens[path, added] = Tokens(path, added)
    return _tokens[path, added]
