"""Token ids of texts: encoding by distinct words, token files (operator 9) and token counts (operator 3).

Encoding.  Public tokenizers whose pieces never cross ASCII white space give a text the ids of its words, one after the
other.  So distinct words are encoded once for each Python worker, and texts are put together from a table of words by
NumPy.  A hash finds a word, and words are then compared as they are.  ``words_stand_alone`` reads that property from the tokenizer's file;
where it doesn't hold, whole texts are encoded.

Operator 9: bit-plane shuffling.  A token file is a Parquet table of segments; a segment holds whole documents in ascending
doc_id order, cut into blocks of ``BLOCK_IDS`` ids.  A block's ids are transposed into byte or bit planes, each plane is
compressed with zstandard, and the segment's index gives every plane's place, so that a block is read without the others.
Parquet gives the file atomic writes and any store that Spark reads.

Operator 3: separator scan.  A flat token file is a sequence of 32-bit ids in which every document ends with a separator,
without any index.  Blocks are scanned on their own: NumPy finds the separators, and documents inside the block are
counted at once.  Each block also gives its length and its last separator; a prefix scan over these few numbers tells how
many ids of a document stand in the blocks before, which completes the first document of each block.

Edge cases.  Null text is empty text and has only its end id.  Rows of equal doc_id are ordered by text; a null doc_id comes
first.  A document larger than a segment or block is handled whole.  Ids after the last separator of a flat file form a
last document without one.  Empty tables give empty files and results.  Other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from array import array
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treekin.llm.wordhash import array_hashes, distinct_words, text_groups
from treekin.shared import small_batches, stage, table

BLOCK_IDS = 1 << 16
SEGMENT_IDS = 1 << 21
#: Distinct words that a Python worker remembers; beyond that it starts anew.
WORDS_HELD = 1_500_000


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Parts of a tokenizer that look at one character, or at white space, at a time.
_LOCAL_NORMALIZERS = {"NFC", "NFD", "Lowercase", "StripAccents"}
#: Alternatives of a split pattern that match no white space: plain letters, Unicode classes, and all but white space and some classes.
_NO_SPACE = re.compile(r"'?[A-Za-z]+|\[(?:\\p\{\w+\})+\]\+?|\[\^\\s(?:\\p\{\w+\})*\]\+?")


def _sequence(part: dict | None, name: str) -> list[dict]:
    return [] if part is None else part[name] if part["type"] == "Sequence" else [part]


def words_stand_alone(spec: dict) -> bool:
    """Whether a tokenizer gives each text the ids of its words, as its file says; False where it isn't clear.

    Normalizers must keep words apart, the first pre-tokenizer must drop white space, and no added token may hold or eat any.
    """
    for step in _sequence(spec.get("normalizer"), "normalizers"):
        spaces = step["type"] == "Replace" and step.get("pattern") == {"Regex": "\\s+"} and step.get("content") == " "
        if step["type"] not in _LOCAL_NORMALIZERS and not spaces:
            return False
    steps = _sequence(spec.get("pre_tokenizer"), "pretokenizers")
    if not steps:
        return False
    pattern = steps[0].get("pattern", {}).get("Regex", "")
    drops = steps[0]["type"] in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer")
    drops |= steps[0]["type"] == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert") is True and bool(pattern) and all(_NO_SPACE.fullmatch(x) for x in pattern.split("|"))
    rest = all(x["type"] == "ByteLevel" and not x.get("add_prefix_space") and not x.get("use_regex") for x in steps[1:])
    plain = all(not (t.get("lstrip") or t.get("rstrip") or t.get("single_word")) and not re.search(r"\s", t["content"]) for t in spec.get("added_tokens") or [])
    whole = not spec.get("truncation") and not spec.get("padding") and not spec.get("model", {}).get("dropout")
    return drops and rest and plain and whole


class Encoder:
    """Ids of texts by the tokenizers library, without special tokens."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.by_word = words_stand_alone(json.load(f))
        self.size = self.tokenizer.get_vocab_size()
        self._clear()

    def _clear(self):
        self.keys, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted hashes of the words, and where these are
        self.words = pa.array([], pa.large_string())
        self.begin = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.flat = np.zeros(1, np.int32)  # the end id, and the ids of the words

    def _find(self, keys: np.ndarray, words: pa.Array) -> np.ndarray:
        """The place of each word, -1 where it isn't known: a hash finds a word, and the words themselves are compared."""
        if not len(self.keys):
            return np.full(len(words), -1, np.int64)
        order, at = np.argsort(keys), np.empty(len(keys), np.int64)
        at[order] = np.searchsorted(self.keys, keys[order])  # in order, it reads the keys from one end to the other
        at = np.minimum(at, len(self.keys) - 1)
        found = np.where(self.keys[at] == keys, self.places[at], -1)
        hit = np.flatnonzero(found >= 0)
        same = pc.equal(self.words.take(pa.array(found[hit])), words.take(pa.array(hit))).to_numpy(zero_copy_only=False)
        found[hit[~same]] = -1
        return found

    def _learn(self, keys: np.ndarray, words: pa.Array) -> np.ndarray:
        """The places of new words.  A word whose hash is another's gets a place too, though it won't be found again."""
        ids, sizes = array("i"), []
        for e in self.tokenizer.encode_batch_fast(words.to_pylist(), add_special_tokens=False):
            one = e.ids
            sizes.append(len(one))
            ids.fromlist(one)
        count = np.array(sizes, np.int64)
        begin = len(self.flat) + np.concatenate([[0], np.cumsum(count)[:-1]])
        places = len(self.begin) + np.arange(len(words))
        self.flat = np.concatenate([self.flat, np.frombuffer(ids, np.int32)])
        self.begin, self.count = np.concatenate([self.begin, begin]), np.concatenate([self.count, count])
        self.words = pa.concat_arrays([self.words, words])
        order = np.argsort(keys, kind="stable")
        at = np.searchsorted(self.keys, keys[order])
        self.keys, self.places = np.insert(self.keys, at, keys[order]), np.insert(self.places, at, places[order])
        return places

    def encode(self, data: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of consecutive texts, each followed by `end`, and where each begins (and the end of the last)."""
        if not self.by_word:
            raw = data.tobytes()
            texts = [raw[a:b].decode() for a, b in zip(offsets, offsets[1:], strict=False)]
            ids = [np.array([*e.ids, end], np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return np.concatenate(ids), np.concatenate([[0], np.cumsum([len(x) for x in ids])])
        first, codes, words = distinct_words(data, offsets)
        if len(self.words) + len(words) > WORDS_HELD:
            self._clear()
        keys = array_hashes(words)
        at = self._find(keys, words)
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = self._learn(keys[new], words.take(pa.array(new)))
        at = at[codes]
        # every text gets one more "word": its end, the first of the flat ids
        n = np.diff(first)
        slots = np.arange(len(at)) + np.repeat(np.arange(len(n)), n)
        sizes, begin = np.ones(len(at) + len(n), np.int64), np.zeros(len(at) + len(n), np.int64)
        sizes[slots], begin[slots] = self.count[at], self.begin[at]
        stops = np.concatenate([[0], np.cumsum(sizes)])
        self.flat[0] = end
        out = self.flat[np.repeat(begin - stops[:-1], sizes) + np.arange(stops[-1])]
        return out, stops[np.concatenate([[0], first[1:] + np.arange(1, len(n) + 1)])]


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


# --- planes


def to_planes(ids: np.ndarray, unit: str = "byte") -> tuple[int, list[bytes]]:
    """The width in bytes and the planes of ids: bytes (or bits) of equal rank together, lowest first."""
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    rows = ids.astype("<u2" if width == 2 else "<u4").view(np.uint8).reshape(-1, width)
    if unit == "byte":
        return width, [np.ascontiguousarray(rows[:, i]).tobytes() for i in range(width)]
    bits = np.unpackbits(rows, axis=1, bitorder="little")
    return width, [np.packbits(bits[:, i]).tobytes() for i in range(8 * width)]


def from_planes(planes: list[bytes], n: int, width: int, unit: str = "byte") -> np.ndarray:
    if unit == "byte":
        rows = np.stack([np.frombuffer(p, np.uint8) for p in planes], 1) if n else np.zeros((0, width), np.uint8)
    else:
        rows = np.packbits(np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes], 1), axis=1, bitorder="little")
    return np.ascontiguousarray(rows).view("<u2" if width == 2 else "<u4").reshape(-1).astype(np.uint32)


def pack_segment(ids: np.ndarray, unit: str, level: int) -> tuple[bytes, bytes]:
    """(payload, index); the index has, for each block, the ids in it, the width, and the length of each plane."""
    z = zstandard.ZstdCompressor(level=level)
    body, index = [], []
    for i in range(0, len(ids), BLOCK_IDS):
        block = ids[i : i + BLOCK_IDS]
        width, planes = to_planes(block, unit)
        packed = [z.compress(p) for p in planes]
        body += packed
        index.append([len(block), width, *map(len, packed)])
    return b"".join(body), json.dumps({"unit": unit, "blocks": index}).encode()


def read_segment(payload: bytes, index: bytes, blocks: range | None = None) -> np.ndarray:
    """The ids of a segment, or of some of its blocks."""
    head, z, at, out = json.loads(index), zstandard.ZstdDecompressor(), 0, []
    for k, (n, width, *sizes) in enumerate(head["blocks"]):
        if blocks is None or k in blocks:
            places = np.concatenate([[0], np.cumsum(sizes)]) + at
            out.append(from_planes([z.decompress(payload[a:b]) for a, b in zip(places, places[1:], strict=False)], n, width, head["unit"]))
        at += sum(sizes)
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


SEGMENTS = "part int, segment int, n_ids long, doc_ids array<long>, lengths array<long>, index binary, payload binary"


def _segment_writer(path: str, end: int, unit: str, level: int):
    def run(batches):
        from pyspark import TaskContext

        part, segment = TaskContext.get().partitionId(), 0
        docs, lengths, ids, held = [], [], [], 0

        def made():
            payload, index = pack_segment(np.concatenate(ids).view(np.uint32), unit, level)
            return pa.record_batch(
                [
                    pa.array([part], pa.int32()), pa.array([segment], pa.int32()), pa.array([held], pa.int64()), pa.array([docs], pa.list_(pa.int64())),
                    pa.array([lengths], pa.list_(pa.int64())), pa.array([index], pa.binary()), pa.array([payload], pa.binary()),
                ],
                ["part", "segment", "n_ids", "doc_ids", "lengths", "index", "payload"],
            )

        for batch in batches:
            names = batch.column(0).to_pylist()
            for i, j, data, offsets in text_groups(batch.column(1)):
                out, stops = encoder(path).encode(data, offsets, end)
                docs += names[i:j]
                lengths += np.diff(stops).tolist()
                ids.append(out)
                held += len(out)
                if held >= SEGMENT_IDS:
                    yield made()
                    segment += 1
                    docs, lengths, ids, held = [], [], [], 0
        if docs:
            yield made()

    return run


def write_token_file(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = 2, id_col: str = "doc_id", text_col: str = "text", unit: str = "byte", level: int = 3) -> None:
    """Write the ids of all texts in ascending order of the ids of the documents."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(_segment_writer(tokenizer or tokenizer_path(), end, unit, level), SEGMENTS).write.option("compression", "none").parquet(path)


def _read_back(batches):
    for batch in batches:
        for r in range(batch.num_rows):
            ids = read_segment(batch.column("payload")[r].as_py(), batch.column("index")[r].as_py())
            lengths = np.array(batch.column("lengths")[r].as_py(), np.int64)
            stops = np.concatenate([[0], np.cumsum(lengths)])
            raw = ids.astype("<u4").tobytes()
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(stops.tolist(), stops[1:].tolist(), strict=False)]
            first = batch.column("first")[r].as_py()
            yield pa.record_batch([batch.column("doc_ids")[r].values, pa.array(stops[:-1] + first), pa.array(lengths), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a token file: (doc_id, start, n_tokens, ids_crc32), from the ids read back.

    The places of segments come from a scan of their sizes: within each part by a window over its few segments, across
    parts by one over the parts' sums.
    """
    segments = spark.read.schema(SEGMENTS).parquet(path)
    sizes = segments.select("part", "segment", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("inside", F.coalesce(F.sum("n_ids").over(within), F.lit(0))).join(parts, "part")
    places = stage(sizes.select("part", "segment", (F.col("base") + F.col("inside")).alias("first")), "token-places")
    return segments.join(places, ["part", "segment"]).mapInArrow(_read_back, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from treekin.shared import new_path

    path = new_path(spark, "token-file")
    write_token_file(table(spark, sf_dir, "documents"), path)
    return read_token_file(spark, path)


# --- flat files and their separators


def _flat_writer(path: str, separator: int, block: int):
    def run(batches):
        from pyspark import TaskContext

        part, number, rest, docs = TaskContext.get().partitionId(), 0, np.zeros(0, np.int32), 0

        def row(kind, no, data, ids):
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([no], pa.int64()), pa.array([data], pa.binary()), pa.array([ids], pa.list_(pa.int64()))], ["file", "block", "data", "doc_ids"])

        for batch in batches:
            names = batch.column(0).to_pylist()
            yield row("names", docs, None, names)
            docs += len(names)
            for _, _, data, offsets in text_groups(batch.column(1)):
                ids, _ = encoder(path).encode(data, offsets, separator)
                rest = np.concatenate([rest, ids])
                while len(rest) >= block:
                    yield row("ids", number, rest[:block].astype("<u4").tobytes(), None)
                    number, rest = number + 1, rest[block:]
        if len(rest):
            yield row("ids", number, rest.astype("<u4").tobytes(), None)

    return run


FLAT = "file int, block long, data binary, doc_ids array<long>"


def _ranges(size: int):
    """(file, block, offset, length) -> (file, block, data): byte ranges of files, read by pyarrow, whole files never."""

    def run(batches):
        import pyarrow.fs as fs

        name, source = None, None
        for batch in batches:
            for path, block, at, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if path != name:
                    if source is not None:
                        source.close()
                    scheme, rest = path.split(":", 1)
                    where, inside = fs.FileSystem.from_uri(f"{scheme}:{quote(rest)}")
                    name, source = path, where.open_input_file(inside)
                source.seek(at)
                data = source.read(min(size, length - at))
                yield pa.record_batch([pa.array([path]), pa.array([block], pa.int64()), pa.array([data], pa.binary())], ["file", "block", "data"])
        if source is not None:
            source.close()

    return run


#: Stores of which pyarrow reads byte ranges; of others, Spark reads each file as a whole, up to 2 GB.
RANGED = ("file", "hdfs", "s3", "gs", "abfss")


def flat_blocks_from_files(spark: SparkSession, path: str, ids_in_block: int = BLOCK_IDS) -> DataFrame:
    """(file, block, data) of flat files of little-endian 32-bit ids, of any size; a shorter last block is what is left.

    Only names and lengths of files are listed; blocks are dealt out, and each task reads the ranges of its own.
    """
    size = 4 * ids_in_block
    files = spark.read.format("binaryFile").load(path).where("length > 0").select(F.col("path").alias("file"), "length")
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / size)))
    places = files.select("file", blocks.alias("block"), "length").select("file", "block", (F.col("block") * size).alias("offset"), "length")
    ranged = F.col("file").rlike(rf"^(?:{'|'.join(RANGED)}):")
    dealt = places.where(ranged).repartitionByRange("file", "block").sortWithinPartitions("file", "block")
    near = dealt.mapInArrow(_ranges(size), "file string, block long, data binary")
    whole = spark.read.format("binaryFile").load(path).where("length > 0").withColumnRenamed("path", "file").where(~ranged)
    whole = whole.select("file", blocks.alias("block"), "content").select("file", "block", F.expr(f"substring(content, cast(block * {size} + 1 as int), {size})").alias("data"))
    return near.union(whole)


def _scan(separator: int):
    """(file, block, n, head, tail, inner): ids in the block, those up to its first separator (null: none), those after its
    last one, and the lengths of the documents that begin and end in it."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for x in batch.column("data"):
                ids = np.frombuffer(x.as_py(), "<u4")
                at = np.flatnonzero(ids == separator)
                out[0].append(len(ids))
                out[1].append(int(at[0]) + 1 if len(at) else None)
                out[2].append(len(ids) - int(at[-1]) - 1 if len(at) else len(ids))
                out[3].append(np.diff(at).tolist())
            yield pa.record_batch([batch.column("file"), batch.column("block"), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.list_(pa.int64()))], ["file", "block", "n", "head", "tail", "inner"])

    return run


def token_counts(blocks: DataFrame, separator: int) -> DataFrame:
    """blocks: (file, block, data).  Per document: (file, doc_no, n_tokens), the separator not counted.

    The windows run over one small row for each block of a file.
    """
    kind = blocks.schema["file"].dataType.simpleString()
    found = stage(blocks.select("file", "block", "data").mapInArrow(_scan(separator), f"file {kind}, block long, n long, head long, tail long, inner array<long>"), "token-scan")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    full = Window.partitionBy("file")
    has = F.col("head").isNotNull()
    small = found.select("file", "block", "n", "head", "tail", F.size("inner").alias("inside"))
    # ids before the block, and ids before the end of the last separator before it
    small = small.withColumn("ids", F.coalesce(F.sum("n").over(before), F.lit(0)))
    small = small.withColumn("done", F.when(has, F.col("ids") + F.col("n") - F.col("tail")))
    small = small.withColumn("open", F.col("ids") - F.coalesce(F.max("done").over(before), F.lit(0)))
    small = small.withColumn("docs", F.coalesce(F.sum(F.when(has, F.col("inside") + 1).otherwise(0)).over(before), F.lit(0)))
    small = small.withColumn("end", F.max("block").over(full))
    left = F.when(has, F.col("tail")).otherwise(F.col("open") + F.col("n"))
    small = small.withColumn("last", F.when((F.col("block") == F.col("end")) & (left > 0), left))
    joined = found.select("file", "block", "inner").join(small.drop("inner"), ["file", "block"])
    head = F.when(has, F.array(F.col("open") + F.col("head") - 1)).otherwise(F.array().cast("array<long>"))
    tail = F.when(F.col("last").isNotNull(), F.array("last")).otherwise(F.array().cast("array<long>"))
    lengths = F.concat(head, F.transform("inner", lambda x: x - 1), tail)
    return joined.select("file", "docs", F.posexplode(lengths).alias("i", "n_tokens")).select("file", (F.col("docs") + F.col("i")).alias("doc_no"), "n_tokens")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    separator = encoder(path).size
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    flat = stage(rows.mapInArrow(_flat_writer(path, separator, BLOCK_IDS), FLAT), "token-flat")
    counts = token_counts(flat.where("data IS NOT NULL").drop("doc_ids"), separator)
    names = flat.where("data IS NULL").select("file", F.col("block").alias("docs"), F.posexplode("doc_ids").alias("i", "doc_id"))
    names = names.select("file", (F.col("docs") + F.col("i")).alias("doc_no"), "doc_id")
    return names.join(counts, ["file", "doc_no"]).select("doc_id", "n_tokens")
