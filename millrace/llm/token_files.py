"""Token-ID / binary output.

Texts are tokenised once, ids are re-ranked by their frequency in the whole corpus, and the
ranks are written in ascending document order as raw binary files: byte-aligned
variable-length integers whose two-bit lengths stand in separate control bytes. Readers
decode with one numpy table lookup per control byte.

One file is a sequence of blocks, one block a run of whole documents:

    magic "MRT1" | documents u32 | ids u64 | control bytes u64 | data bytes u64
    document ids i64[documents] | null flags u8[documents] | lengths u64[documents]
    control bytes (four lengths each, two bits a length, lowest bits first)
    data bytes (1 to 4 little-endian bytes an id's rank)
    pad byte 0x0A

The rank-to-id table (one row per vocabulary entry that occurs) is a Parquet table beside them.
Files are written by Spark's text writer, whose line end is the pad byte, and read by the
binaryFile source, so both ends work on any file system that Spark reaches.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import ranges, spread, stage_table, table, trimmed, with_sums_before, work_path, worker_state

HEAD = struct.Struct("<4sIQQQ")
MAGIC = b"MRT1"
#: Lengths of the four ids that a control byte describes.
LENGTHS = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)
BLOCK_IDS = 1 << 18
FILE_IDS = 6_000_000
#: Words whose ids a worker remembers, the most bytes of such a word, and the room for their ids.
MEMORY_WORDS, MEMORY_LENGTH = 1 << 20, 15
MEMORY_IDS = 4 * MEMORY_WORDS
#: Bytes of text that a worker encodes at once.
GROUP_BYTES = 1 << 22
END_ID = 0
#: Texts that hold other white space than spaces and newlines are tokenised whole; so are those where such stand at an end or together.
ODD_SPACE = r"[\t\x0b\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]"

#: Space and newline as byte-level vocabularies write them (fixed values).
SPACES = ("\u0120", "\u010a")
#: Words that one string hands to the tokenizer at once.
JOINED = 1024


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Memory:
    """Ids of words, in arrays of a fixed size: a word's bytes and length are its key, so that no two words share one.

    A full memory keeps the words that were in use since it was last full, or none if those are most.
    """

    def __init__(self, kind: np.dtype):
        self.kind = kind
        self.words = np.empty((MEMORY_WORDS, 2), np.uint64)
        self.used = np.zeros(MEMORY_WORDS, bool)
        self.start = np.empty(MEMORY_WORDS, np.int64)
        self.size = np.empty(MEMORY_WORDS, np.int64)
        self.ids = np.empty(MEMORY_IDS, kind)
        self._sort(0, 0)

    def _sort(self, n: int, filled: int) -> None:
        self.n, self.filled = n, filled
        key = _mixed(self.words[:n])
        self.row = np.argsort(key, kind="stable")
        self.key = key[self.row]

    def _forget(self) -> None:
        keep = np.nonzero(self.used[: self.n])[0]
        self.used[:] = False
        size = self.size[keep]
        if len(keep) > MEMORY_WORDS // 2 or size.sum() > MEMORY_IDS // 2:
            return self._sort(0, 0)
        self.ids[: size.sum()] = self.ids[ranges(self.start[keep], size)]
        n = len(keep)
        self.words[:n], self.size[:n], self.start[:n] = self.words[keep], size, np.cumsum(size) - size
        self._sort(n, int(size.sum()))

    def values(self, words: pa.Array, make) -> pa.Array:
        """The ids of each of the distinct words, as binary; make gives those of the words that are not remembered."""
        length = pc.binary_length(words).to_numpy()
        short = np.nonzero(length <= MEMORY_LENGTH)[0]
        fixed = np.frombuffer(pc.ascii_rpad(words.take(pa.array(short)), MEMORY_LENGTH + 1, "\0").buffers()[2] or b"", np.uint8, (MEMORY_LENGTH + 1) * len(short)).reshape(-1, MEMORY_LENGTH + 1).copy()
        fixed[:, MEMORY_LENGTH] = length[short]
        fixed = fixed.view("<u8")
        key = _mixed(fixed)
        row = np.append(self.row, -1)[np.searchsorted(self.key, key)]
        known = row >= 0
        known[known] = (self.words[row[known]] == fixed[known]).all(axis=1)
        hit, row = short[known], row[known]
        self.used[row] = True
        new = np.ones(len(words), bool)
        new[hit] = False
        new = np.nonzero(new)[0]
        made = make(words.take(pa.array(new)).to_pylist())
        fresh_ids = np.frombuffer(b"".join(made), self.kind)
        size = np.zeros(len(words), np.int64)
        size[hit] = self.size[row]
        size[new] = np.fromiter(map(len, made), np.int64, len(made)) // self.kind.itemsize
        end = np.cumsum(size)
        out = np.empty(int(end[-1]) if len(end) else 0, self.kind)
        out[ranges((end - size)[hit], size[hit])] = self.ids[ranges(self.start[row], size[hit])]
        out[ranges((end - size)[new], size[new])] = fresh_ids
        bounds = np.concatenate([[0], end * self.kind.itemsize]).astype(np.int32)
        self._learn(short[~known], fixed[~known], key[~known], end - size, size, out)
        return pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(bounds), pa.py_buffer(out)])

    def _learn(self, at: np.ndarray, fixed: np.ndarray, key: np.ndarray, start: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        total = int(size[at].sum())
        if self.n + len(at) > MEMORY_WORDS or self.filled + total > MEMORY_IDS:
            self._forget()
        if self.n + len(at) > MEMORY_WORDS or self.filled + total > MEMORY_IDS or not len(at):
            return
        a, n = self.n, self.n + len(at)
        own = size[at]
        self.words[a:n], self.size[a:n], self.start[a:n], self.used[a:n] = fixed, own, self.filled + np.cumsum(own) - own, False
        self.ids[self.filled : self.filled + total] = ids[ranges(start[at], own)]
        order = np.argsort(key, kind="stable")
        place = np.searchsorted(self.key, key[order])
        self.key, self.row = np.insert(self.key, place, key[order]), np.insert(self.row, place, a + order)
        self.n, self.filled = n, self.filled + total


def _mixed(words: np.ndarray) -> np.ndarray:
    """A number of each word's two halves that sorts words evenly."""
    x = words[:, 0] * np.uint64(0x9E3779B97F4A7C15) ^ words[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ x >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(32)


def _tokenizer(path: str):
    """This worker's tokenizer, its memory of words, which ids begin a word, the type of ids and a pattern of what must be tokenised whole.

    The memory serves byte-level BPE with the usual pattern, which never matches across a
    single newline nor across the place before a single space, so that a word's first id alone
    begins with one of them; no ids are given for others. Texts that hold a token which the
    tokenizer was given beside its vocabulary are tokenised whole.
    """
    def made():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        spec = json.loads(tok.to_str())
        cut = spec["pre_tokenizer"] or {}
        plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not spec["normalizer"]
        kind = np.dtype("<u2" if tok.get_vocab_size() <= 1 << 16 else "<u4")
        starts = np.zeros(1 + max(tok.get_vocab().values()), bool)
        starts[[k for w, k in tok.get_vocab().items() if w[:1] in SPACES]] = True
        whole = "|".join([ODD_SPACE, *(re.sub(r"([^0-9A-Za-z])", r"\\\1", t["content"]) for t in spec["added_tokens"])])
        return tok, Memory(kind), starts if plain else None, kind, whole

    return worker_state(("tokenizer", path), made)


def _word_ids(tok, new: list[str], starts: np.ndarray, kind: np.dtype) -> list[bytes]:
    """Ids of new words, many in one string; starts tells of each id whether it begins a word there.

    A word that stands after a newline, or first, has a newline in front; others stand for the word behind a space.
    """
    found: list[bytes | None] = [None] * len(new)
    line = [k for k, w in enumerate(new) if w[:1] == "\n"]
    word = [k for k, w in enumerate(new) if w[:1] != "\n"]
    for at, mark in ((line, ""), (word, " ")):
        for low in range(0, len(at), JOINED):
            group = at[low : low + JOINED]
            texts = [mark + new[k] for k in group]
            ids = np.array(tok.encode_batch_fast(["".join(texts)], add_special_tokens=False)[0].ids, kind)
            cut = (kind.itemsize * np.flatnonzero(starts[ids])).tolist()
            if len(cut) == len(group):
                raw = ids.tobytes()
                got = [raw[x:y] for x, y in zip(cut, [*cut[1:], len(raw)], strict=True)]
            else:
                got = [np.array(tok.encode(t, add_special_tokens=False).ids, kind).tobytes() for t in texts]
            for k, v in zip(group, got, strict=True):
                found[k] = v
    return found


def _encode_regular(texts: pa.Array, path: str) -> tuple[list[np.ndarray], np.ndarray]:
    """Ids of texts whose white space is single spaces and newlines between words, and where it isn't.

    Words are told apart, coded and joined by Arrow; only distinct ones are looked up.
    """
    tok, memory, starts, kind, _ = _tokenizer(path)
    words = pc.split_pattern(pc.binary_join_element_wise("", pc.replace_substring(texts, "\n", " \n"), "\n"), " ")
    coded, bounds = words.flatten().dictionary_encode(), words.offsets.to_numpy()
    values = memory.values(coded.dictionary, lambda new: _word_ids(tok, new, starts, kind))
    taken = values.take(coded.indices)
    ids = np.frombuffer(taken.buffers()[2] or b"", kind)
    at = np.frombuffer(taken.buffers()[1], np.int32, len(taken) + 1)[bounds - bounds[0]] // kind.itemsize
    lone = np.flatnonzero(pc.is_in(coded.dictionary, pa.array(["", "\n"])).to_numpy(zero_copy_only=False))
    odd = np.zeros(len(texts), bool)
    if len(lone):
        odd[np.searchsorted(bounds - bounds[0], np.flatnonzero(np.isin(coded.indices.to_numpy(), lone)), side="right") - 1] = True
    return [ids[a + 1 : b] for a, b in zip(at.tolist(), at[1:].tolist(), strict=False)], odd


def encode_texts(texts: pa.Array, path: str) -> list[np.ndarray]:
    """Ids of each text, without special tokens; none for null."""
    tok, _, starts, kind, pattern = _tokenizer(path)
    texts = pc.fill_null(texts, "")
    whole = np.full(len(texts), True) if starts is None else pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False)
    out: list[np.ndarray | None] = [None] * len(texts)
    at = np.flatnonzero(~whole)
    if len(at):
        found, odd = _encode_regular(texts.take(pa.array(at)), path)
        for k, ids in zip(at.tolist(), found, strict=True):
            out[k] = ids
        whole[at[odd]] = True
    # One at a time, for the library's own tables of a text are many times its size.
    for k in np.flatnonzero(whole).tolist():
        out[k] = np.array(tok.encode_batch_fast([texts[k].as_py()], add_special_tokens=False)[0].ids, kind)
    return out


#: One row for each document, and one for each task with how often it has seen each id.
STAGE = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("n", pa.int64()), ("width", pa.int32()), ("ids", pa.binary()), ("counts", pa.binary())])
STAGE_SQL = "doc_id long, mark long, n long, width int, ids binary, counts binary"


def _groups(texts: pa.Array, limit: int = GROUP_BYTES):
    """Slices of about limit bytes, so that a batch of long texts stays bounded."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + limit)))
        yield slice(at, end)
        at = end


def tokenise(path: str):
    """Adds the end id to each text's ids, packs them and counts them."""

    def run(batches):
        pack, seen = zstandard.ZstdCompressor(level=1), np.zeros(1, np.int64)
        for batch in batches:
            texts = batch.column(2)
            for part in _groups(texts):
                found = [np.append(ids, ids.dtype.type(END_ID)) for ids in encode_texts(texts[part], path)]
                got = np.bincount(np.concatenate(found))
                if len(got) > len(seen):
                    seen = np.append(seen, np.zeros(len(got) - len(seen), np.int64))
                seen[: len(got)] += got
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[part], batch.column(1)[part], pa.array([len(x) for x in found], pa.int64()), pa.array([x.itemsize for x in found], pa.int32()),
                        pa.array([pack.compress(x) for x in found], pa.binary()), pa.nulls(len(found), pa.binary()),
                    ], schema=STAGE,
                )
        yield pa.RecordBatch.from_arrays([pa.nulls(1, f.type) for f in STAGE][:-1] + [pa.array([pack.compress(seen.astype("<i8"))], pa.binary())], schema=STAGE)

    return run


def _unpacked(width: int, blob: bytes, unpack) -> np.ndarray:
    return np.frombuffer(unpack.decompress(blob), f"<u{width}")


def count_ids(batches):
    """Rows (id, n) of the counts of some tasks."""
    unpack, total = zstandard.ZstdDecompressor(), np.zeros(1, np.int64)
    for batch in batches:
        for blob in batch.column(0).to_pylist():
            got = np.frombuffer(unpack.decompress(blob), "<i8")
            if len(got) > len(total):
                total = np.append(total, np.zeros(len(got) - len(total), np.int64))
            total[: len(got)] += got
    ids = np.nonzero(total)[0]
    yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "n": pa.array(total[ids], pa.int64())})


def pack_block(doc_ids: list[int | None], lengths: list[int], ranks: np.ndarray) -> bytes:
    """One block of whole documents."""
    n = len(ranks)
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-n // 4) * 4, np.uint8)
    codes[:n] = size - 1
    q = codes.reshape(-1, 4)
    control = q[:, 0] | q[:, 1] << 2 | q[:, 2] << 4 | q[:, 3] << 6
    ends = np.cumsum(size, dtype=np.int64)
    data, starts = np.zeros(int(ends[-1]) if n else 0, np.uint8), ends - size
    for k in range(4):
        at = size > k
        data[starts[at] + k] = ranks[at] >> 8 * k & 0xFF
    return b"".join(
        [
            HEAD.pack(MAGIC, len(doc_ids), n, len(control), len(data)),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            bytes(d is None for d in doc_ids),
            np.array(lengths, "<u8").tobytes(),
            control.astype(np.uint8).tobytes(),
            data.tobytes(),
        ]
    )


def unpack_blocks(content: bytes):
    """(document ids, lengths, ranks) of each block of a file."""
    at = 0
    while at < len(content):
        magic, docs, n, n_control, n_data = HEAD.unpack_from(content, at)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at += HEAD.size
        ids = np.frombuffer(content, "<i8", docs, at)
        null = np.frombuffer(content, np.uint8, docs, at := at + 8 * docs)
        lengths = np.frombuffer(content, "<u8", docs, at := at + docs).astype(np.int64)
        control = np.frombuffer(content, np.uint8, n_control, at := at + 8 * docs)
        data = np.frombuffer(content, np.uint8, n_data, at := at + n_control)
        at += n_data + 1
        size = LENGTHS[control].ravel()[:n]
        starts = np.cumsum(size, dtype=np.int64) - size
        ranks = data[starts].astype(np.uint32) if n else np.zeros(0, np.uint32)
        for k in range(1, int(size.max()) if n else 0):
            more = size > k
            ranks[more] |= data[starts[more] + k].astype(np.uint32) << np.uint32(8 * k)
        yield [None if z else int(d) for d, z in zip(ids, null, strict=True)], lengths, ranks


BLOCKS = pa.schema([("block", pa.binary())])


def _encode(order):
    """Blocks of a sorted partition. order: broadcast ids in rank order."""

    def run(batches):
        ids = order.value
        rank = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.uint32)
        rank[ids] = np.arange(len(ids), dtype=np.uint32)
        unpack, docs, lengths, parts, n = zstandard.ZstdDecompressor(), [], [], [], 0
        for batch in batches:
            for d, w, b in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                got = rank[_unpacked(w, b, unpack)]
                docs.append(d), lengths.append(len(got)), parts.append(got)
                n += len(got)
                if n >= BLOCK_IDS:
                    yield pa.RecordBatch.from_arrays([pa.array([pack_block(docs, lengths, np.concatenate(parts))], pa.binary())], schema=BLOCKS)
                    docs, lengths, parts, n = [], [], [], 0
        if docs:
            yield pa.RecordBatch.from_arrays([pa.array([pack_block(docs, lengths, np.concatenate(parts))], pa.binary())], schema=BLOCKS)

    return run


def write_token_files(docs: DataFrame, out: str, tokenizer: str | None = None) -> None:
    """Write docs (doc_id long, text string; other columns are ignored) below the folder out.

    Null and empty texts give the end id alone; null ids come first; equal ids keep a
    defined order by length and hash; an empty table gives files without blocks. A very long text is
    encoded whole and stands in one block.
    """
    spark = docs.sparkSession
    staged = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").mapInArrow(trimmed(tokenise(tokenizer or default_tokenizer())), STAGE_SQL)
    staged = stage_table(staged, "tokens", "snappy", f"{out}/staged")
    counts = staged.where("counts IS NOT NULL").select("counts").mapInArrow(count_ids, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    # One row per vocabulary entry: bounded by the tokenizer, not by the corpus.
    ranked = counts.orderBy(F.desc("n"), "id").collect()
    spark.createDataFrame([(k, r["id"], r["n"]) for k, r in enumerate(ranked)], "rank int, id long, n long").coalesce(1).write.parquet(f"{out}/ranks")
    order = spark.sparkContext.broadcast(np.array([r["id"] for r in ranked], np.int64))
    total = sum(r["n"] for r in ranked)
    n_files = max(1, -(-total // FILE_IDS))
    sorted_docs = staged.where("counts IS NULL").drop("counts").repartitionByRange(n_files, "doc_id", "n", "mark").sortWithinPartitions("doc_id", "n", "mark")
    blocks = sorted_docs.select("doc_id", "width", "ids").mapInArrow(trimmed(_encode(order)), "block binary")
    blocks.select(F.col("block").cast("string").alias("value")).write.option("lineSep", "\n").text(f"{out}/files")


READ = pa.schema([("file", pa.int64()), ("start_in_file", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def _decode(order, digest: bool):
    def run(batches):
        ids_of = order.value
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                file, start = int(re.search(r"part-(\d+)", path.rpartition("/")[2])[1]), 0
                for docs, lengths, ranks in unpack_blocks(content.as_buffer()):
                    ids, out = ids_of[ranks].astype("<u4"), []
                    ends = np.cumsum(lengths)
                    for d, n, end in zip(docs, lengths.tolist(), ends.tolist(), strict=True):
                        raw = ids[end - n : end].tobytes()
                        out.append((file, start + end - n, d, n, zlib.crc32(raw) if digest else raw))
                    start += int(ends[-1]) if len(ends) else 0
                    last = pa.int64() if digest else pa.binary()
                    kinds = [*[f.type for f in READ][:4], last]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["file", "start_in_file", "doc_id", "n_tokens", "ids_crc32" if digest else "ids"])

    return run


def read_token_files(spark: SparkSession, out: str, digest: bool = False) -> DataFrame:
    """Rows (file, start_in_file, doc_id, n_tokens, ids as little-endian u32), or their crc32 instead of the ids."""
    ranks = spark.read.schema("rank int, id long, n long").parquet(f"{out}/ranks").orderBy("rank").select("id").collect()
    order = spark.sparkContext.broadcast(np.array([r["id"] for r in ranks], np.int64))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{out}/files").where("length > 0").select("path", "content")
    last = "ids_crc32 long" if digest else "ids binary"
    return files.mapInArrow(trimmed(_decode(order, digest)), f"file long, start_in_file long, doc_id long, n_tokens long, {last}")


def token_index(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone."""
    rows = stage_table(read_token_files(spark, out, digest=True), "token-index", path=f"{out}/index")
    starts = with_sums_before(rows.groupBy("file").agg(F.sum("n_tokens").alias("n")), "file-starts", "n", "file").drop("n")
    return rows.join(starts, "file").select("doc_id", (F.col("before") + F.col("start_in_file")).alias("start"), "n_tokens", "ids_crc32")


def encode_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write docs as token files in the shared folder and index them from what was written."""
    out = work_path(docs.sparkSession, "token-files")
    write_token_files(docs, out, tokenizer)
    return token_index(docs.sparkSession, out)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, and what they hold of each: encode_documents()."""
    return encode_documents(spread(table(spark, sf_dir, "documents")))
